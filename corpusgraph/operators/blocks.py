"""Documents made of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.text import lookup

# The types of blocks with the fields that each requires, and the values that a field may have.
REQUIRED = {
    "paragraph": ["html"],
    "heading": ["text", "level"],
    "callout": ["style", "html"],
    "divider": [],
    "verse_cite": ["ref", "version", "text"],
    "verse_compare": ["ref", "versions", "texts"],
    "commentary_cite": ["author_name", "verse_ref", "content"],
    "reference_table": ["refs"],
    "crossref_network": ["verse", "connections"],
    "entity_card": ["canonical_id", "name", "namespace"],
    "symbol_card": ["canonical_id", "name"],
    "image_embed": ["image_id", "url", "title"],
    "connection_map": ["content", "format"],
    "comparison_table": ["headers", "rows"],
    "theme_progression": ["theme_id", "label"],
}
ALLOWED = {
    ("heading", "level"): ["1", "2", "3"],
    ("callout", "style"): ["insight", "warning", "question", "patristic"],
    ("divider", "style"): ["line", "ornament", "space"],
    ("connection_map", "format"): ["ascii", "mermaid"],
    ("crossref_network", "layout"): ["table", "graph"],
}


def invalid(blocks: DataFrame, document: str, at: str, id_: str, kind: str, data: str) -> DataFrame:
    """*document*, *at* and ``problem``, a row for each thing wrong with a block.

    *data* is JSON text; a heading's level must be a number in it.  A block without a type or of an unknown one is told nothing else; a null
    *data* is wrong but for dividers.  Empty values of a field count as none, and an id that an earlier
    block of the document has is a duplicate.
    """
    value = lambda field: F.get_json_object(data, f"$.{field}")
    items = lambda field: F.from_json(value(field), "array<string>")
    width = lambda field: F.json_array_length(value(field))
    shape = lambda field: F.schema_of_variant(F.variant_get(F.try_parse_json(F.col(data)), f"$.{field}", "variant"))
    known, fields = F.col(kind).isin(*REQUIRED), F.json_object_keys(data)
    required = F.split(lookup(kind, {k: ",".join(v) for k, v in REQUIRED.items()}), ",")
    absent = F.transform(F.array_remove(F.array_except(required, fields), ""), lambda f: F.concat(F.lit("missing_field:"), f))
    told = [
        (F.col(k) if isinstance(k, str) else k, name)
        for k, name in [
            ((F.col(kind) == "heading") & value("level").isin(*ALLOWED["heading", "level"]) & (shape("level") != "BIGINT"), "bad_value:level"),
            *(((F.col(kind) == k) & (value(f) != "") & ~value(f).isin(*values), f"bad_value:{f}") for (k, f), values in ALLOWED.items()),
            ((F.col(kind) == "verse_compare") & (width("versions") != width("texts")), "unequal_lengths"),
            ((F.col(kind) == "reference_table") & F.exists(items("refs"), lambda x: F.json_object_keys(x).isNull()), "not_an_object:refs"),
            ((F.col(kind) == "reference_table") & F.exists(items("refs"), lambda x: ~F.array_contains(F.json_object_keys(x), "ref")), "missing_field:refs.ref"),
            ((F.col(kind) == "comparison_table") & F.exists(items("rows"), lambda x: F.json_array_length(x) != width("headers")), "uneven_rows"),
        ]
    ]
    inside = F.concat(absent, F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in told])))
    again = F.row_number().over(Window.partitionBy(document, id_).orderBy(at)) > 1
    body = (
        F.when(F.col(data).isNull(), F.when(F.col(kind) == "divider", F.array()).otherwise(F.array(F.lit("missing_data"))))
        .when(fields.isNull(), F.array(F.lit("data_not_an_object")))
        .otherwise(inside)
    )
    unnamed = F.when(F.col(id_).isNull(), F.array(F.lit("missing_id"))).otherwise(F.array())
    own = (
        F.when(F.coalesce(F.col(kind), F.lit("")) == "", F.array(F.lit("missing_type")))
        .when(~known, F.array(F.lit("unknown_type")))
        .otherwise(F.concat(unnamed, body))
    )
    twice = F.when((F.col(id_) != "") & F.col("_again"), F.array(F.lit("duplicate_id"))).otherwise(F.array())
    marked = blocks.withColumn("_again", again)
    return marked.select(document, at, F.explode(F.concat(own.cast("array<string>"), twice.cast("array<string>"))).alias("problem"))


def scaffold(rows: DataFrame, key: str, order: str, text: str, score: Column) -> DataFrame:
    """A title block and then the texts, best first, as one array of blocks a document."""
    body = F.array_sort(F.collect_list(F.struct((-score).alias("s"), F.col(order).alias("o"), F.col(text).alias("t"))))
    block = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("data"))
    title = F.array(block("title", F.concat(F.lit("Study "), F.col(key))))
    grouped = rows.groupBy(key).agg(body.alias("body"))
    return grouped.select(key, F.concat(title, F.transform("body", lambda x: block("text", x["t"]))).alias("blocks"))


def reviewed(scores: DataFrame, item: str, score: str, least: float = 0.85) -> DataFrame:
    """By *item* the number of ``reviews``, their mean ``score`` and whether it is ``approved``: *least* or more."""
    known = scores.groupBy(item).agg(F.count(score).alias("reviews"), F.avg(score).alias("score"))
    return known.withColumn("approved", F.coalesce(F.col("score") >= least, F.lit(False)))
