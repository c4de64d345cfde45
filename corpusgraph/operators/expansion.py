"""Query expansion and typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.text import bound, content_tokens, lookup, ngrams, tokens

# The lexical share of the fused score by kind of query.
ALPHA = {"reference": 0.8, "entity": 0.7, "phrase": 0.6, "keyword": 0.5, "concept": 0.4, "question": 0.3}


def alpha(kind: str) -> Column:
    return lookup(kind, ALPHA, 0.5)


def synonym_table(spark: SparkSession, synonyms: dict[str, list[str]]) -> DataFrame:
    rows = [(term, s, i) for term, own in synonyms.items() for i, s in enumerate(own, 1)]
    return spark.createDataFrame(rows, "term string, synonym string, priority int")


def expand(terms: DataFrame, term: str, synonyms: DataFrame, most: int) -> DataFrame:
    """Each term with its first *most* synonyms, joined by commas; an empty text if it has none."""
    known = synonyms.where(F.col("priority") <= most).groupBy("term").agg(
        F.array_sort(F.collect_list(F.struct("priority", "synonym"))).alias("s")
    )
    known = known.select(F.col("term").alias(term), F.array_join(F.col("s")["synonym"], ",").alias("more"))
    return terms.join(known, term, "left").withColumn("more", F.coalesce("more", F.lit("")))


def alternatives(synonyms: DataFrame, terms: list[str], most: int) -> list[list[str]]:
    """Each of a query's *terms* with its first *most* synonyms: a few rows of *synonyms*, which may be any table."""
    wanted = synonyms.where(F.col("term").isin(*terms) & (F.col("priority") <= most)) if terms else synonyms.limit(0)
    rows = sorted((r["term"], r["priority"], r["synonym"]) for r in wanted.collect())
    return [[term, *dict.fromkeys(s for own, _, s in rows if own == term and s != term)] for term in terms]


def inverse(synonyms: DataFrame) -> DataFrame:
    """The terms that each synonym belongs to."""
    heads = F.array_join(F.sort_array(F.collect_set("term")), ",").alias("heads")
    return synonyms.groupBy("synonym").agg(heads).withColumnRenamed("synonym", "term")


def texts(queries: DataFrame, id_: str, text: str, synonyms: DataFrame, most: int) -> DataFrame:
    """Three expanded texts of each query, to be embedded: ``concatenated`` (its terms' first *most* synonyms after it), ``replaced`` (each
    term with its first synonym after it) and ``augmented`` (the first synonyms in brackets after it).

    A term that comes again adds nothing twice, but where terms are replaced.  Terms meet *synonyms* by equality.
    """
    known = synonyms.where(F.col("priority") <= most).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("priority", "synonym"))).alias("s"))
    words = queries.select(id_, text, F.posexplode_outer(tokens(text)).alias("i", "term")).join(known, "term", "left")
    rows = words.groupBy(id_, text).agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "term", F.col("s.synonym").alias("s"))))).alias("w"))
    first = F.filter("w", lambda x: x["s"].isNotNull() & ~F.exists("w", lambda y: (y["term"] == x["term"]) & (y["i"] < x["i"])))
    after = lambda joined, left, right: F.concat(F.col(text), F.when(F.size(first) > 0, F.concat(F.lit(left), joined, F.lit(right))).otherwise(""))
    return rows.select(
        id_, after(F.array_join(F.transform(first, lambda x: F.array_join(x["s"], " ")), " "), " ", "").alias("concatenated"),
        F.array_join(F.transform("w", lambda x: F.concat_ws(" ", x["term"], F.get(x["s"], F.lit(0)))), " ").alias("replaced"),
        after(F.array_join(F.transform(first, lambda x: F.get(x["s"], F.lit(0))), ", "), " (", ")").alias("augmented"),
    )


def query_type(text: Column, entities: Column | None = None) -> Column:
    """What a query is, by the first rule that fits: a reference, an entity's name, a question, one word, a phrase."""
    n = F.size(F.split(F.trim(text), " "))
    kind = F.when(text.rlike("[0-9]+:[0-9]+"), "reference")
    if entities is not None:
        kind = kind.when(entities, "entity")
    return kind.when(text.contains("?"), "question").when(n == 1, "keyword").when(n <= 6, "phrase").otherwise("concept")


def analysed(
    queries: DataFrame, id_: str, text: str, gazetteer: DataFrame, stop: tuple[str, ...] = (), asking: tuple[str, ...] = (),
    concepts: tuple[str, ...] = (), phrases: tuple[str, ...] = (), strong: float = 2.5,
) -> DataFrame:
    """*id_*, the ``kind`` of a query and how it is searched: ``alpha``, ``distance`` (stop words dropped, and one), ``boost``, ``expand``.

    Entities are runs of 1 to 3 tokens that stand in *gazetteer* (``name``, its tokens joined by underscores, and
    ``boost``), found by equality; ``entities`` counts them.  By the first rule that fits a query is a reference,
    an entity of *strong* boost or more, a question, a phrase of two tokens or more, a concept, an entity or a
    keyword.  Entities, references and known *phrases* (folded, by underscores) are not expanded, nor are keywords of no token.
    """
    both = F.struct(tokens(text).alias("every"), content_tokens(text, stop, 0).alias("own"))
    read = queries.select(id_, F.col(text).alias("_text"), bound(both, lambda x: x).alias("_t"))
    grams = F.explode(F.array_distinct(F.concat("_t.own", ngrams(F.col("_t.own"), 2), ngrams(F.col("_t.own"), 3)))).alias("name")
    names = gazetteer.groupBy("name").agg(F.max("boost").alias("boost"))
    met = read.select(id_, grams).join(names, "name").groupBy(id_).agg(F.max("boost").alias("_best"), F.count("*").alias("entities"))
    n, best, first = F.size("_t.own"), F.col("_best"), F.get("_t.own", F.lit(0))
    kind = (
        F.when(F.col("_text").rlike(r"(?i)\b\d?\s*[a-z]+\s+\d+[:.]\d+\b"), "reference")
        .when(best >= strong, "entity")
        .when(F.endswith(F.rtrim("_text"), F.lit("?")) | first.isin(*asking), "question")
        .when(n >= 2, "phrase")
        .when(first.isin(*concepts), "concept")
        .when((n == 1) & best.isNotNull(), "entity")
        .otherwise("keyword")
    )
    known = F.array_join("_t.own", "_").isin(*phrases)
    expand = F.when(F.col("kind").isin("reference", "entity"), False).when(F.col("kind") == "phrase", ~known).otherwise(
        (F.col("kind") != "keyword") | (n == 1)
    )
    # How much a literal hit counts by kind; entities have their own.
    boost = F.when(F.col("kind") == "entity", F.coalesce(best, F.lit(2.0))).otherwise(lookup("kind", {"reference": 3.0, "phrase": 2.0, "keyword": 1.5}, 1.0))
    return read.join(met, id_, "left").withColumn("kind", kind).select(
        id_, "kind", alpha("kind").alias("alpha"), (F.size("_t.every") - n + 1).alias("distance"), boost.alias("boost"), expand.alias("expand"),
        F.coalesce("entities", F.lit(0)).alias("entities"),
    )
