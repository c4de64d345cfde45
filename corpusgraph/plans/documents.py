"""Parsing of references, identifiers and headers; blocks and reviews; batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.functions import references as ref
from corpusgraph.functions import text as t
from corpusgraph.operators import blocks, resolution, studies
from corpusgraph.plans.registry import query, table
from corpusgraph.streaming import usage

_BOOKS = r"""names AS (SELECT lower(p_name) AS n, 'B' || min(p_partkey) AS book, min(p_size) + 20 AS chapters FROM part GROUP BY 1),
    al AS (SELECT regexp_replace(n, '[^a-z0-9]', '', 'g') AS key, 1 AS priority, book FROM names UNION ALL SELECT left(n, 1) || string_split(n, ' ')[2], 2, book FROM names),
    am AS (SELECT key, book FROM al QUALIFY row_number() OVER (PARTITION BY key ORDER BY priority, book) = 1),
    v AS (SELECT p_partkey AS id, upper(p_name) || ' ' || p_size || ':' || (p_partkey % 30 + 1) || CASE WHEN p_partkey % 5 = 0 THEN ' - 40' ELSE '' END || '; ' || left(p_name, 1) || '. '
      || string_split(p_name, ' ')[2] || ' 3-5; ' || CASE p_partkey % 3 WHEN 0 THEN '??' WHEN 1 THEN 'No such book 1:1' ELSE '' END AS txt FROM part),
    s AS (SELECT id, unnest(list_filter(list_transform(string_split(txt, ';'), lambda x: trim(x)), lambda x: x <> '')) AS s, generate_subscripts(list_filter(list_transform(string_split(txt, ';'), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 AS place FROM v),
    p AS (SELECT *, '^\s*((?:[1-3]\s*)?\p{L}[\p{L}. ]*?)\s*(\d+)(?::(\d+)(?:\s*-\s*(?:(\d+):)?(\d+))?|\s*-\s*(\d+))?\s*$' AS re FROM s),
    g AS (SELECT id, place, nullif(trim(regexp_extract(s, re, 1)), '') AS b, nullif(regexp_extract(s, re, 2), '')::INT AS chapter, nullif(regexp_extract(s, re, 3), '')::INT AS verse,
      nullif(regexp_extract(s, re, 5), '')::INT AS to_verse, nullif(regexp_extract(s, re, 6), '')::INT AS to_chapter FROM p),
    r AS (SELECT id, place, b, am.book, chapter, verse, coalesce(to_chapter, chapter) AS end_chapter, coalesce(to_verse, verse) AS end_verse, chapters
      FROM g LEFT JOIN am ON key = regexp_replace(lower(b), '[^a-z0-9]', '', 'g') LEFT JOIN names ON names.book = am.book)"""


def _references(spark, d):
    """Texts of references written from the parts' names, some of them abbreviated, unknown or unreadable; aliases; books."""
    part = table(spark, d, "part")
    books = part.groupBy(F.lower("p_name").alias("n")).agg(F.concat(F.lit("B"), F.min("p_partkey")).alias("book"), (F.min("p_size") + 20).alias("chapters"))
    word = lambda name: F.get(F.split(name, " "), F.lit(1))
    short = F.concat(F.substring("n", 1, 1), word("n"))
    forms = F.inline(F.array(F.struct(t.ascii_key("n").alias("key"), F.lit(1).alias("priority")), F.struct(short.alias("key"), F.lit(2).alias("priority"))))
    k = F.col("p_partkey")
    odd = F.when(k % 3 == 0, "??").when(k % 3 == 1, "No such book 1:1").otherwise("")
    written = F.concat(
        F.upper("p_name"), F.lit(" "), "p_size", F.lit(":"), k % 30 + 1, F.when(k % 5 == 0, " - 40").otherwise(""), F.lit("; "),
        F.substring("p_name", 1, 1), F.lit(". "), word("p_name"), F.lit(" 3-5; "), odd,
    )
    return part.select(k.alias("id"), written.alias("txt")), books.select("book", forms), books


def _resolved(spark, d):
    texts, aliases, books = _references(spark, d)
    return resolution.resolve_references(texts, "id", "txt", aliases, books)


@query(
    "r01_ref_parse",
    f"""WITH {_BOOKS} SELECT g.id, g.place, s.s AS segment, coalesce(b, '') AS book, coalesce(chapter, 0) AS chapter, coalesce(verse, 0) AS verse, coalesce(to_chapter, chapter, 0) AS end_chapter,
    coalesce(to_verse, verse, 0) AS end_verse, b IS NOT NULL AS ok FROM g JOIN s ON s.id = g.id AND s.place = g.place""",
)
def r01(spark, d):
    texts, _, _ = _references(spark, d)
    parsed = texts.select("id", F.posexplode(ref.segments("txt")).alias("place", "segment")).withColumn("p", ref.parse("segment"))
    numbers = [F.coalesce(f"p.{c}", F.lit(0)).alias(c) for c in ("chapter", "verse", "end_chapter", "end_verse")]
    return parsed.select("id", F.col("place").cast("long").alias("place"), "segment", F.coalesce("p.book", F.lit("")).alias("book"), *numbers, "p.ok")


@query("r02_alias_reference", f"WITH {_BOOKS} SELECT id, place, coalesce(book, 'unknown') AS code FROM r WHERE b IS NOT NULL")
def r02(spark, d):
    found = _resolved(spark, d).where("status <> 'unparsed'")
    return found.select("id", F.col("place").cast("long").alias("place"), F.coalesce("book", F.lit("unknown")).alias("code"))


@query(
    "r03_osis_parse",
    """SELECT ref, string_split(ref, '.')[1] AS book, coalesce(try_cast(string_split(ref, '.')[2] AS INT), 0) AS chapter,
    coalesce(try_cast(string_split(string_split(ref, '.')[3], '-')[1] AS INT), 0) AS verse,
    coalesce(try_cast(string_split(string_split(ref, '.')[3], '-')[2] AS INT), try_cast(string_split(string_split(ref, '.')[3], '-')[1] AS INT), 0) AS end_verse
    FROM (SELECT DISTINCT 'B' || o_custkey % 30 || '.' || month(o_orderdate) || CASE WHEN o_orderkey % 5 > 0 THEN '.' || day(o_orderdate) ELSE '' END
      || CASE WHEN o_orderkey % 5 > 2 THEN '-' || (day(o_orderdate) + 2) ELSE '' END AS ref FROM orders)""",
)
def r03(spark, d):
    k = F.col("o_orderkey") % 5
    made = F.concat(
        F.lit("B"), F.col("o_custkey") % 30, F.lit("."), F.month("o_orderdate"),
        F.when(k > 0, F.concat(F.lit("."), F.day("o_orderdate"))).otherwise(""),
        F.when(k > 2, F.concat(F.lit("-"), F.day("o_orderdate") + 2)).otherwise(""),
    )
    parsed = table(spark, d, "orders").select(made.alias("ref")).distinct().withColumn("p", ref.parse_dotted("ref"))
    return parsed.select("ref", "p.book", *[F.coalesce(f"p.{c}", F.lit(0)).alias(c) for c in ("chapter", "verse", "end_verse")])


@query("r04_alias_key", "SELECT DISTINCT p_name, regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9]', '', 'g') AS key FROM part")
def r04(spark, d):
    return table(spark, d, "part").select("p_name", t.ascii_key("p_name").alias("key")).distinct()


@query(
    "r05_resolve_batch",
    f"""WITH {_BOOKS} SELECT id, place, coalesce(book, '') AS book, coalesce(chapter, 0) AS chapter, coalesce(verse, 0) AS verse, coalesce(end_chapter, 0) AS end_chapter, coalesce(end_verse, 0) AS end_verse,
    CASE WHEN b IS NULL THEN 'unparsed' WHEN book IS NULL THEN 'book_not_found' WHEN chapter < 1 OR greatest(chapter, end_chapter) > chapters THEN 'chapter_out_of_range' ELSE 'ok' END AS status FROM r""",
)
def r05(spark, d):
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chapter", "verse", "end_chapter", "end_verse")]
    return _resolved(spark, d).select("id", F.col("place").cast("long").alias("place"), F.coalesce("book", F.lit("")).alias("book"), *numbers, "status")


@query(
    "r06_tiered_resolve",
    """WITH q AS (SELECT DISTINCT lower(substr(n_name, 1, 5)) AS term FROM nation UNION SELECT lower(n_name) FROM nation WHERE n_nationkey < 5),
    c AS (SELECT term, n_nationkey, CASE WHEN lower(n_name) = term THEN 1 WHEN starts_with(lower(n_name), term) THEN 2 ELSE 3 END AS tier FROM q JOIN nation ON contains(lower(n_name), term))
    SELECT term, n_nationkey, tier FROM c QUALIFY row_number() OVER (PARTITION BY term ORDER BY tier, n_nationkey) = 1""",
)
def r06(spark, d):
    from corpusgraph.operators.relational import top_per_group

    nation = table(spark, d, "nation")
    terms = nation.select(F.lower(F.substring("n_name", 1, 5)).alias("term")).union(nation.where("n_nationkey < 5").select(F.lower("n_name"))).distinct()
    name = F.lower("n_name")
    # A name that contains a term has the term's first letters somewhere: names and terms meet by those.
    ahead = F.substring("term", 1, 3)
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: name.substr(i, n))))
    found = terms.withColumn("gram", ahead).join(nation.withColumn("gram", F.explode(F.array_distinct(grams))), "gram")
    found = found.where(F.contains(name, F.col("term")))
    tier = F.when(name == F.col("term"), 1).when(F.startswith(name, F.col("term")), 2).otherwise(3)
    return top_per_group(found.withColumn("tier", tier), ["term"], [F.asc("tier"), F.asc("n_nationkey")]).select("term", "n_nationkey", "tier")


#: A header of each document, from its language and id.
_HEADER = "lang || ';q=0.' || (doc_id % 10) || ', pt-BR' || CASE doc_id % 3 WHEN 0 THEN ';q=0.5' WHEN 1 THEN ' ; q=x' ELSE '' END || ',, EN;q=0.' || (doc_id % 7)"


@query(
    "r07_accept_language",
    f"""WITH v AS (SELECT doc_id, {_HEADER} AS header FROM documents), i AS (SELECT doc_id, generate_subscripts(p, 1) AS i, trim(unnest(p)) AS x FROM (SELECT doc_id, string_split(header, ',') AS p FROM v))
    SELECT doc_id, string_agg(lower(trim(string_split(x, ';')[1])), ',' ORDER BY -coalesce(try_cast(nullif(regexp_extract(x, ';\\s*q=([0-9.]+)', 1), '') AS DOUBLE), 1.0), i) AS codes FROM i WHERE x <> '' GROUP BY doc_id""",
)
def r07(spark, d):
    n = F.col("doc_id")
    odd = F.when(n % 3 == 0, ";q=0.5").when(n % 3 == 1, " ; q=x").otherwise("")
    header = F.concat("lang", F.lit(";q=0."), n % 10, F.lit(", pt-BR"), odd, F.lit(",, EN;q=0."), n % 7)
    return table(spark, d, "documents").select("doc_id", F.array_join(ref.accepted_languages(header), ",").alias("codes"))


@query(
    "r08_language_fallback",
    """SELECT source, arg_min(lang, CASE WHEN lang = 'es' THEN 1 WHEN starts_with(lang, 'f') THEN 2 WHEN lang = 'en' THEN 3 ELSE 4 END) AS lang
    FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY 1""",
)
def r08(spark, d):
    rank = F.when(F.col("lang") == "es", 1).when(F.startswith("lang", F.lit("f")), 2).when(F.col("lang") == "en", 3).otherwise(4)
    return table(spark, d, "documents").select("source", "lang").distinct().groupBy("source").agg(F.min_by("lang", rank).alias("lang"))


@query("r09_slugify", "SELECT DISTINCT p_name, trim(regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def r09(spark, d):
    return table(spark, d, "part").select("p_name", t.slug("p_name").alias("slug")).distinct()


@query(
    "r10_id_normalisation",
    """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'PRO' ELSE upper(p_type) END || ':' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS id FROM part""",
)
def r10(spark, d):
    from corpusgraph.operators.etl import normalised_id

    return table(spark, d, "part").select("p_partkey", normalised_id(F.col("p_type"), F.col("p_name"), {"PROMO": "PRO"}).alias("id"))


@query(
    "r11_filename_parse",
    """SELECT DISTINCT f, regexp_extract(f, '([1-3]?[A-Za-z]+)[ _](\\d+)[:_](\\d+)', 1) AS book, regexp_extract(f, '([1-3]?[A-Za-z]+)[ _](\\d+)[:_](\\d+)', 2)::INT AS chapter,
    regexp_extract(f, '([1-3]?[A-Za-z]+)[ _](\\d+)[:_](\\d+)', 3)::INT AS verse FROM (SELECT 'rom_' || month(o_orderdate) || '_' || lpad(day(o_orderdate)::VARCHAR, 2, '0') || '.json' AS f FROM orders)""",
)
def r11(spark, d):
    name = F.concat(F.lit("rom_"), F.month("o_orderdate"), F.lit("_"), F.lpad(F.day("o_orderdate").cast("string"), 2, "0"), F.lit(".json"))
    return table(spark, d, "orders").select(name.alias("f")).distinct().select("f", ref.chapter_and_verse("f").alias("p")).select("f", "p.*")


# Blocks, studies, reviews


_BLOCK_SQL = """WITH b AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations),
    p AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN CASE WHEN n % 5 NOT IN (1, 2, 3) THEN 'bad_value:level' END WHEN 1 THEN CASE WHEN n % 3 = 1 THEN 'bad_value:style' END
        WHEN 2 THEN CASE WHEN n % 2 = 1 THEN 'unequal_lengths' END WHEN 3 THEN CASE WHEN n % 2 = 1 THEN 'not_an_object:refs' ELSE 'missing_field:refs.ref' END
        WHEN 4 THEN CASE WHEN n % 2 = 1 THEN 'uneven_rows' END ELSE 'unknown_type' END AS problem FROM b
      UNION ALL SELECT conv_id, turn, 'missing_field:html' FROM b WHERE turn % 6 = 1 AND n % 2 = 1
      UNION ALL SELECT conv_id, turn, 'duplicate_id' FROM b QUALIFY row_number() OVER (PARTITION BY conv_id, n % 3 ORDER BY turn) > 1)
    SELECT conv_id, turn, problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY ALL"""


@query("g01_block_validation", _BLOCK_SQL)
def g01(spark, d):
    n, odd = F.length("text"), F.length("text") % 2 == 1
    either = lambda a, b: F.when(odd, a).otherwise(b)
    kinds = ["heading", "callout", "verse_compare", "reference_table", "comparison_table", "table"]
    data = [
        F.format_string('{"text":"t","level":%d}', n % 5),
        F.concat(F.lit('{"style":"'), F.element_at(F.array(*map(F.lit, ["insight", "odd", ""])), n % 3 + 1), either('"}', '","html":"x"}')),
        F.concat(F.lit('{"ref":"r","versions":[1,2],"texts":[1'), either("]}", ",2]}")),
        F.concat(F.lit('{"refs":[{"ref":1},'), either("3]}", '{"x":1}]}')),
        F.concat(F.lit('{"headers":[1,2],"rows":[[1,2],[1'), either("]]}", ",2]]}")),
        F.lit("{}"),
    ]
    at = (F.col("turn") % 6 + 1).cast("int")
    made = table(spark, d, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("b"), n % 3).alias("id"),
        F.element_at(F.array(*map(F.lit, kinds)), at).alias("type"), F.element_at(F.array(*data), at).alias("data"),
    )
    found = blocks.invalid(made, "conv_id", "turn", "id", "type", "data")
    return found.groupBy("conv_id", "turn", "problem").agg(F.count("*").alias("n"))


@query(
    "g02_scaffold",
    """WITH b AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn, text) AS place FROM conversations)
    SELECT conv_id, 0 AS place, 'title' AS type, 'Study ' || conv_id AS data FROM (SELECT DISTINCT conv_id FROM b) UNION ALL SELECT conv_id, place, 'text', text FROM b""",
)
def g02(spark, d):
    made = blocks.scaffold(table(spark, d, "conversations"), "conv_id", "turn", "text", F.length("text"))
    return made.select("conv_id", F.posexplode("blocks").alias("place", "b")).select("conv_id", F.col("place").cast("long").alias("place"), "b.type", "b.data")


_LINES = "l AS (SELECT p_type AS topic, lineitem.*, part.* FROM lineitem JOIN part ON l_partkey = p_partkey)"
_SECTIONS = {
    "meta": (1, "SELECT topic, count(*) || ' lines, ' || count(DISTINCT p_brand) || ' brands' AS item, 0 AS weight, '' AS ord FROM l GROUP BY 1"),
    "gold": (10, "SELECT topic, l_orderkey || '' AS item, max(l_extendedprice) AS weight, lpad(l_orderkey || '', 12, '0') AS ord FROM l GROUP BY 1, l_orderkey"),
    "connections": (4, "SELECT topic, l_returnflag || l_linestatus || ':' || count(*) AS item, count(*) AS weight, l_returnflag || l_linestatus AS ord FROM l GROUP BY 1, l_returnflag, l_linestatus"),
    "commentaries": (15, "SELECT topic, left(p_name, 6) || ' ' || l_orderkey AS item, -epoch(l_shipdate) AS weight, lpad(l_orderkey || '', 12, '0') || p_name AS ord FROM l"),
    "aspects": (20, "SELECT topic, p_brand || ':' || count(*) AS item, 0 AS weight, p_brand AS ord FROM l GROUP BY 1, p_brand"),
    "themes": (20, "SELECT topic, p_size || ':' || count(*) AS item, count(*) AS weight, lpad(p_size || '', 4, '0') AS ord FROM l GROUP BY 1, p_size"),
    "entities": (30, "SELECT topic, 'S' || l_suppkey AS item, count(*) AS weight, lpad(l_suppkey || '', 12, '0') AS ord FROM l GROUP BY 1, l_suppkey"),
    "symbols": (20, "SELECT topic, string_split(p_name, ' ')[1] AS item, count(*) AS weight, string_split(p_name, ' ')[1] AS ord FROM l GROUP BY 1, string_split(p_name, ' ')[1]"),
    "related": (10, "SELECT a.topic, b.topic AS item, count(*) AS weight, b.topic AS ord FROM (SELECT DISTINCT topic, l_suppkey, l_shipdate::DATE AS d FROM l) a "
      "JOIN (SELECT DISTINCT topic, l_suppkey, l_shipdate::DATE AS d FROM l) b ON a.l_suppkey = b.l_suppkey AND a.d = b.d AND a.topic <> b.topic GROUP BY 1, 2, b.topic"),
}


@query(
    "g03_study_sections",
    f"""WITH {_LINES}, """ + ", ".join(f"s_{name} AS (SELECT topic, string_agg(item, ' | ' ORDER BY place) AS {name} FROM (SELECT topic, item, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, ord, item) AS place FROM ({sql}) QUALIFY place <= {most}) GROUP BY 1)" for name, (most, sql) in _SECTIONS.items())
    + " SELECT topic, " + ", ".join(f"coalesce({name}, '') AS {name}" for name in _SECTIONS) + " FROM s_meta " + " ".join(f"LEFT JOIN s_{name} USING (topic)" for name in list(_SECTIONS)[1:]),
)
def g03(spark, d):
    """Nine sections of every topic."""
    part = table(spark, d, "part")
    lines = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("topic", F.col("p_type"))
    padded = lambda c, n=12: F.lpad(F.col(c).cast("string"), n, "0")
    count = F.count("*").alias("n")
    counted = lambda *by: lines.groupBy("topic", *by).agg(count)
    flow, word = F.concat("l_returnflag", "l_linestatus").alias("flow"), F.get(F.split("p_name", " "), F.lit(0)).alias("word")
    n, colon = F.col("n"), F.lit(":")
    met = lines.select("topic", "l_suppkey", F.to_date("l_shipdate").alias("day")).distinct()
    others = met.select(F.col("topic").alias("other"), "l_suppkey", "day")
    related = met.join(others, ["l_suppkey", "day"]).where("topic <> other").groupBy("topic", "other").agg(count)
    totals = lines.groupBy("topic").agg(count, F.count_distinct("p_brand").alias("brands"))
    most = {name: m for name, (m, _) in _SECTIONS.items()}
    made = studies.compose([
        studies.Section("meta", totals, F.concat("n", F.lit(" lines, "), "brands", F.lit(" brands")), F.lit(0), F.lit(""), most["meta"]),
        studies.Section("gold", lines.groupBy("topic", "l_orderkey").agg(F.max("l_extendedprice").alias("top")), F.col("l_orderkey"), F.col("top"), padded("l_orderkey"), most["gold"]),
        studies.Section("connections", counted(flow), F.concat("flow", colon, "n"), n, F.col("flow"), most["connections"]),
        studies.Section("commentaries", lines, F.concat(F.substring("p_name", 1, 6), F.lit(" "), "l_orderkey"), -F.unix_timestamp("l_shipdate"), F.concat(padded("l_orderkey"), "p_name"), most["commentaries"]),
        studies.Section("aspects", counted("p_brand"), F.concat("p_brand", colon, "n"), F.lit(0), F.col("p_brand"), most["aspects"]),
        studies.Section("themes", counted("p_size"), F.concat("p_size", colon, "n"), n, padded("p_size", 4), most["themes"]),
        studies.Section("entities", counted("l_suppkey"), F.concat(F.lit("S"), "l_suppkey"), n, padded("l_suppkey"), most["entities"]),
        studies.Section("symbols", counted(word), F.col("word"), n, F.col("word"), most["symbols"]),
        studies.Section("related", related, F.col("other"), n, F.col("other"), most["related"]),
    ], "topic")
    return made.select("topic", *[F.array_join(name, " | ").alias(name) for name in _SECTIONS])


@query(
    "g04_featured_list",
    """WITH s AS (SELECT conv_id, conv_id % 7 AS owner, CASE conv_id % 3 WHEN 0 THEN 'Public' WHEN 1 THEN 'private' ELSE 'community' END AS visibility,
      CASE WHEN count(*) >= 3 THEN 'published' ELSE 'draft' END AS status, conv_id % 5 = 0 AS featured, first(role ORDER BY turn, role) AS kind, count(*) AS turns FROM conversations GROUP BY 1),
    b AS (SELECT conv_id, count(DISTINCT length(text) % 9) AS bookmarks FROM conversations WHERE text IS NOT NULL GROUP BY 1), f AS (SELECT conv_id // 4 AS conv_id, count(*) AS forks FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY 1)
    SELECT kind, conv_id, featured, coalesce(bookmarks, 0) AS bookmarks, coalesce(forks, 0) AS forks FROM s LEFT JOIN b USING (conv_id) LEFT JOIN f USING (conv_id)
    WHERE owner = 2 OR (lower(visibility) IN ('public', 'community') AND status = 'published')
    QUALIFY row_number() OVER (PARTITION BY kind ORDER BY featured DESC, coalesce(bookmarks, 0) DESC, coalesce(forks, 0) DESC, conv_id) <= 20""",
)
def g04(spark, d):
    """What reader 2 sees first of conversations as studies: featured, bookmarked, forked."""
    turns = table(spark, d, "conversations")
    n = F.col("conv_id")
    made = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min(F.struct("turn", "role"))["role"].alias("kind")).select(
        "conv_id", "kind", (n % 7).alias("owner"), F.when(n % 3 == 0, "Public").when(n % 3 == 1, "private").otherwise("community").alias("visibility"),
        F.when(F.col("turns") >= 3, "published").otherwise("draft").alias("status"), (n % 5 == 0).alias("featured"),
    )
    bookmarks = turns.where("text IS NOT NULL").select("conv_id", (F.length("text") % 9).alias("reader"))
    forks = turns.select("conv_id").distinct().select(F.floor(n / 4).alias("parent"))
    seen = studies.visible(made, F.lit(2))
    return studies.listed(seen, bookmarks, forks, "conv_id", "kind", 20).select("kind", "conv_id", "featured", "bookmarks", "forks")


@query(
    "g05_approval",
    """SELECT l_partkey, count(*) AS reviews, round(avg(l_quantity::DOUBLE / 50), 6) AS score, avg(l_quantity::DOUBLE / 50) >= 0.85 AS approved FROM lineitem GROUP BY 1""",
)
def g05_approval(spark, d):
    scores = table(spark, d, "lineitem").select("l_partkey", (F.col("l_quantity").cast("double") / 50).alias("score"))
    return blocks.reviewed(scores, "l_partkey", "score").withColumn("score", F.round("score", 6))


@query(
    "g05_review_patch",
    "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w, i: CASE WHEN i = 1 + p_partkey % 2 THEN upper(w) ELSE w END), ' ') AS patched FROM part",
)
def g05(spark, d):
    words = F.transform(F.split("p_name", " "), lambda w, i: F.when(i == F.col("p_partkey") % 2, F.upper(w)).otherwise(w))
    return table(spark, d, "part").select("p_partkey", F.array_join(words, " ").alias("patched"))


# Usage metrics (the same functions run on streams)


@query(
    "x01_tumbling",
    "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def x01(spark, d):
    return usage.tumbling(table(spark, d, "events"), "1 hour").select("start", "event_type", "n")


@query(
    "x02_sliding",
    """SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1""",
)
def x02(spark, d):
    return usage.sliding(table(spark, d, "events"), "2 hours", "1 hour").select("start", "n")


@query(
    "x03_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def x03(spark, d):
    return usage.sessions(table(spark, d, "events"), "30 minutes").select("user_id", "start", "n")


@query("x04_distinct_events", "SELECT count(DISTINCT event_id) AS n FROM events")
def x04(spark, d):
    return usage.deduplicated(table(spark, d, "events"), "event_id", "1 hour").agg(F.count("*").alias("n"))


@query(
    "x05_latency_buckets",
    """SELECT event_type, le, count(*) FILTER (WHERE value / 100 <= le) AS n FROM events, (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.3), (0.5), (1.0), (2.0), (5.0)) b(le) GROUP BY ALL""",
)
def x05(spark, d):
    return usage.latency_buckets(table(spark, d, "events"), F.col("value") / 100)


@query("x06_usage_counters", "SELECT event_type, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def x06(spark, d):
    return usage.counters(table(spark, d, "events"), F.get_json_object("props", "$.k").cast("int"))


@query(
    "x07_running_count",
    "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events",
)
def x07(spark, d):
    from corpusgraph.operators.ordering import numbered_in

    rows = table(spark, d, "events").select("event_id", "event_type", "ts")
    return numbered_in(rows, "event_type", [F.asc("ts"), F.asc("event_id")], "n").select("event_id", "n")


@query(
    "x08_lifetimes",
    """WITH RECURSIVE m AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
      UNION ALL SELECT m.user_id, min(e.ts) FROM m JOIN events e ON e.user_id = m.user_id AND e.ts >= m.ts + INTERVAL 2 DAY GROUP BY m.user_id),
    k AS (SELECT user_id, count(*) AS misses, count(*) FILTER (WHERE ts + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)) AS evictions FROM m GROUP BY 1)
    SELECT user_id, count(*) - any_value(misses) AS hits, any_value(misses) AS misses, any_value(evictions) AS evictions FROM events JOIN k USING (user_id) GROUP BY 1""",
)
def x08(spark, d):
    """What a cache by user that keeps entries for two days would have made of the events."""
    from corpusgraph.streaming import lifetimes

    return lifetimes.rates(lifetimes.of_table(table(spark, d, "events"), "user_id", 2 * 86400), "user_id")
