"""Aggregations and ranked groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as t
from corpusgraph.functions import vectors as v
from corpusgraph.operators import analytics as a
from corpusgraph.operators import relational as r
from corpusgraph.operators.ordering import numbered
from corpusgraph.plans.combining import theme_links
from corpusgraph.plans.registry import query, table

_U = "u AS (SELECT DISTINCT l_orderkey AS unit, p_type AS theme FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("a01_count", "SELECT count(*) AS n FROM lineitem")
def a01(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("a02_group_count", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a02(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query(
    "a03_distinct_counts",
    "SELECT p_type, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def a03(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_type").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"))


@query(
    "a04_confidence_summary",
    """SELECT min(l_discount) AS low, max(l_discount) AS high, round(sum((l_discount * 100)::DECIMAL(18, 0))::DOUBLE / count(*), 6) AS mean FROM lineitem""",
)
def a04(spark, d):
    exact = F.sum((F.col("l_discount") * 100).cast("decimal(18,0)")).cast("double") / F.count("*")
    return table(spark, d, "lineitem").agg(F.min("l_discount").alias("low"), F.max("l_discount").alias("high"), F.round(exact, 6).alias("mean"))


@query("a05_unknown_group", "SELECT coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1")
def a05(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("source"))
    return docs.groupBy(a.unknown_if_empty("source").alias("source")).agg(F.count("*").alias("n"))


@query(
    "a06_strength_histogram_zero_filled",
    """SELECT place, bucket, coalesce(n, 0) AS n FROM (VALUES (0, 'strong'), (1, 'moderate'), (2, 'weak'), (3, 'none')) b(place, bucket)
    LEFT JOIN (SELECT CASE WHEN l_discount >= 0.85 THEN 'strong' WHEN l_discount >= 0.05 THEN 'moderate' ELSE 'weak' END AS x, count(*) AS n FROM lineitem GROUP BY 1) ON x = bucket""",
)
def a06(spark, d):
    label = t.bucket("l_discount", [(0.85, "strong"), (0.05, "moderate")], "weak")
    return a.histogram(table(spark, d, "lineitem"), label, ["strong", "moderate", "weak", "none"])


@query(
    "a07_theme_statistics",
    """SELECT p_type AS theme, count(DISTINCT l_orderkey) AS units, count(DISTINCT s_nationkey) AS books, count(DISTINCT n_regionkey) AS sections
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
)
def a07(spark, d):
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = (
        table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.groupBy(F.col("p_type").alias("theme")).agg(
        F.count_distinct("l_orderkey").alias("units"), F.count_distinct("s_nationkey").alias("books"), F.count_distinct("n_regionkey").alias("sections")
    )


@query(
    "a08_coverage_pct",
    f"WITH {_U} SELECT theme, round(100.0 * count(*) / (SELECT count(*) FROM orders), 6) AS coverage FROM u GROUP BY 1",
)
def a08(spark, d):
    units = theme_links(spark, d).groupBy("theme").agg(F.count("*").alias("n"))
    whole = table(spark, d, "orders").agg(F.count("*").alias("m"))
    return units.crossJoin(F.broadcast(whole)).select("theme", a.coverage(F.col("n"), F.col("m"), 6).alias("coverage"))


@query(
    "a09_distribution_per_book",
    """SELECT n_name, count(*) AS n, array_to_string(list_sort(list(DISTINCT month(o_orderdate))), ',') AS chapters
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 250000 GROUP BY 1""",
)
def a09(spark, d):
    joined = (
        table(spark, d, "orders").where("o_totalprice > 250000")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    months = F.array_join(F.sort_array(F.collect_set(F.month("o_orderdate"))).cast("array<string>"), ",")
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), months.alias("chapters"))


@query(
    "a10_chapter_nested",
    f"""WITH {_U}, c AS (SELECT unit % 20 AS chapter, theme, count(*) AS n FROM u GROUP BY ALL)
    SELECT chapter, sum(n)::BIGINT AS total, count(*) AS themes, string_agg(theme || '=' || n, ';' ORDER BY theme) AS nested FROM c GROUP BY 1""",
)
def a10(spark, d):
    counts = theme_links(spark, d).groupBy((F.col("unit") % 20).alias("chapter"), "theme").agg(F.count("*").alias("n"))
    nested = F.sort_array(F.collect_list(F.concat_ws("=", "theme", "n")))
    return counts.groupBy("chapter").agg(F.sum("n").alias("total"), F.count("*").alias("themes"), F.array_join(nested, ";").alias("nested"))


@query(
    "a11_progression",
    f"""WITH {_U}, c AS (SELECT theme, unit % 10 AS book, unit % 70 AS chapter, count(DISTINCT unit) AS units, min(unit) AS first FROM u GROUP BY ALL)
    SELECT theme, book, sum(units)::BIGINT AS units, count(*) AS chapters, arg_min(first, chapter) AS first_unit, max(units) AS peak FROM c GROUP BY ALL""",
)
def a11(spark, d):
    links = theme_links(spark, d).withColumns({"book": F.struct("theme", (F.col("unit") % 10).alias("book")), "chapter": F.col("unit") % 70})
    return a.progression(links, "book", "chapter", "unit").select("book.*", "units", "chapters", "first_unit", "peak")


@query("a12_share_pct", "SELECT o_orderstatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM orders GROUP BY 1")
def a12(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return a.share(counts, "n").withColumn("share", F.round("share", 6))


@query(
    "a13_peaks",
    f"WITH {_U} SELECT unit % 40 AS book, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, unit % 40) AS place FROM u GROUP BY 1 QUALIFY place <= 5",
)
def a13(spark, d):
    counts = theme_links(spark, d).groupBy((F.col("unit") % 40).alias("book")).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("book")]
    return counts.orderBy(*order).limit(5).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query(
    "a14_cooccurrence_metrics",
    f"""WITH {_U}, own AS (SELECT theme, count(*) AS n FROM u GROUP BY 1), s AS (SELECT a.theme, b.theme AS other, count(*) / any_value(n)::DOUBLE AS strength
      FROM u a JOIN u b ON a.unit = b.unit AND a.theme <> b.theme JOIN own ON own.theme = a.theme GROUP BY ALL)
    SELECT theme, round(max(strength), 6) AS top, round(avg(strength), 6) AS mean, count(*) FILTER (WHERE strength > 0.1) AS strong, count(*) AS n FROM s GROUP BY 1""",
)
def a14(spark, d):
    pairs = a.cooccurrence(theme_links(spark, d), "unit", "theme")
    return pairs.groupBy("theme").agg(
        F.round(F.max("strength"), 6).alias("top"), F.round(F.avg("strength"), 6).alias("mean"),
        F.count_if(F.col("strength") > 0.1).alias("strong"), F.count("*").alias("n"),
    )


@query(
    "a15_zero_filled_sequence",
    """SELECT p_partkey, k AS number, count(l_orderkey) AS n FROM (SELECT p_partkey, unnest(generate_series(1, p_size))::INT AS k FROM part)
    LEFT JOIN lineitem ON l_partkey = p_partkey AND l_linenumber = k GROUP BY ALL""",
)
def a15(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("number"))
    return a.per_number(lines, table(spark, d, "part"), "p_partkey", "p_size", "number")


@query(
    "a16_exploded_weighted_top",
    """SELECT w AS word, sum(p_size)::BIGINT AS weight FROM (SELECT unnest(string_split(p_name, ' ')) AS w, p_size FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def a16(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"), "p_size")
    return words.groupBy("word").agg(F.sum("p_size").alias("weight")).orderBy(F.desc("weight"), "word").limit(10)


@query(
    "a17_grade_distribution",
    """SELECT lang, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE toxic = 1) AS toxic
    FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
)
def a17(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    counts = [F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("toxic") == 1).alias("toxic")]
    return joined.groupBy("lang").agg(*counts)


@query("a18_child_count", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def a18(spark, d):
    children = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return r.refresh_counts(table(spark, d, "customer").select("c_custkey"), children, "c_custkey", "n")


@query("a19_related_counts", "SELECT o_custkey, count(*) AS orders, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
def a19(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_distinct("o_orderpriority").alias("priorities"))


@query(
    "a20_nested_by_unit",
    """SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, string_agg(turn || ':' || length(text), ' ' ORDER BY turn, length(text)) AS sizes
    FROM conversations GROUP BY conv_id""",
)
def a20(spark, d):
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: F.concat_ws(":", x["turn"], x["n"]))
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.array_join(sizes, " ").alias("sizes")
    )


@query("a21_aliases_by_language", "SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY 1")
def a21(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query(
    "a22_relational_division",
    "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)",
)
def a22(spark, d):
    lines = table(spark, d, "lineitem")
    return r.contained_in_all(lines, "l_orderkey", "l_returnflag", lines)


_BY_POSITION = """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS p, unnest(embedding)::DOUBLE AS x, 1 + vec_id % 3 AS w FROM embeddings),
    s AS (SELECT label, p, {what} AS y FROM e GROUP BY ALL) SELECT label, round(sum(y), 6) AS total, round(max(y), 6) AS top FROM s GROUP BY 1"""


def _fused(spark, d, how):
    e = table(spark, d, "embeddings").select("label", (1 + F.col("vec_id") % 3).alias("w"), F.posexplode(v.doubles("embedding")).alias("p", "x"))
    return e.groupBy("label", "p").agg(how.alias("y")).groupBy("label").agg(F.round(F.sum("y"), 6).alias("total"), F.round(F.max("y"), 6).alias("top"))


@query("a23_vector_fuse_weighted", _BY_POSITION.format(what="sum(x * w) / sum(w)"))
def a23_weighted(spark, d):
    return _fused(spark, d, F.sum(F.col("x") * F.col("w")) / F.sum("w"))


@query("a23_vector_fuse_mean", _BY_POSITION.format(what="avg(x)"))
def a23_mean(spark, d):
    return _fused(spark, d, F.avg("x"))


@query("a23_vector_fuse_max", _BY_POSITION.format(what="max(x)"))
def a23_max(spark, d):
    return _fused(spark, d, F.max("x"))


@query(
    "a24_entropy_quality",
    """WITH w AS (SELECT source, lang, count(*)::DOUBLE AS n FROM documents GROUP BY ALL), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS w FROM w)
    SELECT source, round(0.7 * count(*) / 4 + 0.3 * sum(-w * ln(w + 1e-10)) / ln(4), 6) AS quality FROM p GROUP BY 1""",
)
def a24(spark, d):
    counts = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").cast("double").alias("n"))
    w = F.col("n") / F.sum("n").over(Window.partitionBy("source"))
    entropy = F.sum(-F.col("w") * F.log(F.col("w") + 1e-10)) / F.log(F.lit(4.0))
    return counts.withColumn("w", w).groupBy("source").agg(F.round(0.7 * F.count("*") / 4 + 0.3 * entropy, 6).alias("quality"))


@query(
    "a25_counts_within_arrays",
    "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: w < 'm')) AS early, len(list_filter(string_split(p_name, ' '), lambda w: w >= 'm')) AS late FROM part",
)
def a25(spark, d):
    words = F.split("p_name", " ")
    n = lambda f: F.size(F.filter(words, f)).cast("long")
    return table(spark, d, "part").select("p_partkey", n(lambda w: w < "m").alias("early"), n(lambda w: w >= "m").alias("late"))


@query(
    "a26_dedup_merge",
    """SELECT lower(p_type) AS cid, array_to_string(list_sort(list(DISTINCT lower(p_brand))), ',') AS aliases, arg_min(p_name, p_partkey) AS name, count(*) AS merged FROM part GROUP BY 1""",
)
def a26(spark, d):
    from corpusgraph.operators.etl import merge_duplicates

    part = table(spark, d, "part").select(F.lower("p_type").alias("cid"), F.array("p_brand").alias("aliases"), "p_name", "p_partkey")
    out = merge_duplicates(part, "cid", "p_partkey", ["aliases"], ["p_name"])
    lowered = F.array_join(F.sort_array(F.transform("aliases", F.lower)), ",")
    return out.select("cid", lowered.alias("aliases"), F.col("p_name").alias("name"), "merged")


@query(
    "a27_inverted_alias_index",
    """SELECT w AS name, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS owners FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w, p_type FROM part) GROUP BY 1""",
)
def a27(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("name"), "p_type")
    return words.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("owners"))


@query("a28_alias_conflicts", "SELECT p_name, count(DISTINCT p_brand) AS owners FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def a28(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("owners")).where("owners > 1")


@query("a29_duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a29(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "a30_quality_report",
    """SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS no_text, count(*) FILTER (WHERE lang IS NULL) AS no_lang,
    count(*) FILTER (WHERE NOT regexp_matches(source, '^src[0-9]+$')) AS bad_source, count(*) FILTER (WHERE n_chars <> length(text)) AS bad_length FROM documents""",
)
def a30(spark, d):
    checks = {
        "no_text": F.col("text").isNull() | (F.trim("text") == ""), "no_lang": F.col("lang").isNull(),
        "bad_source": ~F.col("source").rlike("^src[0-9]+$"), "bad_length": F.col("n_chars") != F.length("text"),
    }
    return table(spark, d, "documents").agg(F.count("*").alias("n"), *[F.count_if(c).alias(x) for x, c in checks.items()])


@query(
    "a31_status_rollup",
    """SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n FROM orders
    GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
)
def a31(spark, d):
    sets = table(spark, d, "orders").groupingSets([("o_orderstatus",), ("o_orderpriority",), ()], "o_orderstatus", "o_orderpriority")
    return sets.agg(F.count("*").alias("n")).select(
        F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n"
    )


@query(
    "a32_block_summary",
    """SELECT conv_id, count(*) AS blocks, array_to_string(list_slice(list(turn ORDER BY turn) FILTER (WHERE role <> 'user'), 1, 3), ',') AS first FROM conversations GROUP BY 1""",
)
def a32(spark, d):
    turns = F.array_sort(F.collect_list(F.when(F.col("role") != "user", F.col("turn"))))
    joined = F.array_join(F.slice(turns, 1, 3).cast("array<string>"), ",")
    out = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("blocks"), F.size(turns).alias("m"), joined.alias("first"))
    return out.select("conv_id", "blocks", F.when(F.col("m") > 0, F.col("first")).alias("first"))


@query(
    "a33_latency_quantiles",
    """WITH s AS (SELECT event_type, list_sort(list(value)) AS xs FROM events GROUP BY 1), p AS (SELECT *, least(greatest(0.95 * (len(xs) + 1), 1), len(xs))::DOUBLE AS pos FROM s)
    SELECT event_type, round((SELECT median(value) FROM events e WHERE e.event_type = p.event_type), 6) AS p50,
    round(xs[floor(pos)::INT] + (xs[least(floor(pos)::INT + 1, len(xs))] - xs[floor(pos)::INT]) * (pos - floor(pos)), 6) AS p95 FROM p""",
)
def a33(spark, d):
    found = a.exclusive_percentiles(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("a34_query_coverage", "SELECT round(avg((n > 0)::INT), 6) AS coverage FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def a34(spark, d):
    counts = a18(spark, d)
    return counts.agg(F.round(F.avg((F.col("n") > 0).cast("int")), 6).alias("coverage"))


@query("a35_mean_by_group", "SELECT event_type, round(avg(CASE WHEN value > 10 THEN floor(value) END), 6) AS mean FROM events GROUP BY 1")
def a35(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") > 10, F.floor("value"))), 6).alias("mean"))


@query(
    "a36_running_mean",
    """SELECT event_id, round(avg(floor(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS mean FROM events""",
)
def a36(spark, d):
    window = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg(F.floor("value")).over(window), 6).alias("mean"))


@query(
    "a_rollup_hierarchy",
    """SELECT coalesce(r_name, 'all') AS region, coalesce(n_name, 'all') AS nation, coalesce(c_mktsegment, 'all') AS segment, count(*) AS n
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""",
)
def a_rollup(spark, d):
    joined = (
        table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    names = {"r_name": "region", "n_name": "nation", "c_mktsegment": "segment"}
    return joined.rollup(*names).agg(F.count("*").alias("n")).select(*[F.coalesce(c, F.lit("all")).alias(x) for c, x in names.items()], "n")


# Ranked groups


@query("w01_rank", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier")
def w01(spark, d):
    return numbered(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), F.asc("s_suppkey")], "place").select("s_suppkey", "place")


@query(
    "w02_neighbors",
    """SELECT n_nationkey, coalesce(lag(n_name) OVER (ORDER BY n_nationkey), '') AS previous, coalesce(lead(n_name) OVER (ORDER BY n_nationkey), '') AS next,
    coalesce(lag(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), '') AS previous_in_region FROM nation""",
)
def w02(spark, d):
    nation = table(spark, d, "nation")
    out = r.neighbours(nation, [F.asc("n_nationkey")], "n_name")
    within = r.neighbours(nation, [F.asc("n_nationkey")], "n_name", ["n_regionkey"]).select("n_nationkey", F.col("previous").alias("previous_in_region"))
    joined = out.join(within, "n_nationkey")
    return joined.select("n_nationkey", *[F.coalesce(c, F.lit("")).alias(c) for c in ("previous", "next", "previous_in_region")])


@query("w03_keep_max", "SELECT l_partkey, l_orderkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1")
def w03(spark, d):
    best = r.top_per_group(table(spark, d, "lineitem"), ["l_partkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")])
    return best.select("l_partkey", "l_orderkey", "l_extendedprice")


@query(
    "w04_preferred_version",
    """WITH h AS (SELECT doc_id % 60 AS unit, lang, doc_id, n_chars, CASE lang WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 999 END AS pri FROM documents)
    SELECT unit, arg_min(doc_id, (pri * 1e12 - n_chars * 1e5 + doc_id)) AS doc_id, string_agg(lang, ',' ORDER BY pri, -n_chars, lang) AS versions FROM h GROUP BY 1""",
)
def w04(spark, d):
    from corpusgraph.operators.retrieval import prefer_versions

    score = (F.col("n_chars") * F.lit(100_000).cast("long") - F.col("doc_id")).alias("score")
    hits = table(spark, d, "documents").select((F.col("doc_id") % 60).alias("unit"), "lang", "doc_id", "n_chars", score)
    out = prefer_versions(hits, "unit", "lang", ["de", "fr"], "score", "n_chars", [F.asc("doc_id")])
    return out.select("unit", "doc_id", F.array_join("versions", ",").alias("versions"))


@query("w05_first_per_group", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def w05(spark, d):
    return r.top_per_group(table(spark, d, "documents"), ["source"], [F.asc("doc_id")]).select("source", "doc_id")


@query(
    "w06_book_diversify",
    """WITH p AS (SELECT o_orderkey, o_custkey % 12 AS book, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 50),
    q AS (SELECT *, place <= 5 OR row_number() OVER (PARTITION BY book ORDER BY place) = 1 AS taken FROM p) SELECT o_orderkey, place FROM q ORDER BY taken DESC, place LIMIT 10""",
)
def w06(spark, d):
    from corpusgraph.operators.retrieval import diversify

    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    pool = table(spark, d, "orders").withColumn("book", F.col("o_custkey") % 12).orderBy(*order).limit(50)
    return diversify(pool, "book", order, 10).select("o_orderkey", F.col("place").cast("long").alias("place"))


_RANKS = """WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS ra FROM part QUALIFY ra <= 50),
    b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rb FROM part QUALIFY rb <= 500), j AS (SELECT * FROM a JOIN b USING (p_partkey))"""


def _ranks(spark, d):
    part = table(spark, d, "part")

    def top(column, n, name):
        order = [F.desc(column), F.asc("p_partkey")]
        return part.orderBy(*order).limit(n).select("p_partkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias(name))

    return top("p_retailprice", 50, "ra").join(top("p_size", 500, "rb"), "p_partkey")


@query("w07_rank_shift", f"{_RANKS} SELECT count(*) AS n, round(avg(abs(ra - rb)), 6) AS mean_shift, sum((ra = rb)::INT)::BIGINT AS kept FROM j")
def w07(spark, d):
    shift = F.abs(F.col("ra") - F.col("rb"))
    return _ranks(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(shift), 6).alias("mean_shift"), F.count_if(shift == 0).alias("kept"))


@query(
    "w08_kendall_tau",
    f"""{_RANKS} SELECT round(sum(sign((x.ra - y.ra) * (x.rb - y.rb)))::DOUBLE / ((SELECT count(*) FROM j) * ((SELECT count(*) FROM j) - 1) / 2), 6) AS tau
    FROM j x JOIN j y ON x.p_partkey < y.p_partkey""",
)
def w08(spark, d):
    from corpusgraph.operators.evaluation import kendall_tau

    return kendall_tau(_ranks(spark, d), "p_partkey", "ra", "rb").select(F.round("tau", 6).alias("tau"))


@query(
    "w09_rank_changes",
    f"{_RANKS} SELECT CASE WHEN rb IS NULL THEN 'removed' WHEN rb < ra THEN 'promoted' WHEN rb > ra THEN 'demoted' ELSE 'same' END AS change, count(*) AS n FROM a LEFT JOIN b USING (p_partkey) GROUP BY 1",
)
def w09(spark, d):
    part = table(spark, d, "part")

    def top(column, n, name):
        order = [F.desc(column), F.asc("p_partkey")]
        return part.orderBy(*order).limit(n).select("p_partkey", F.row_number().over(Window.orderBy(*order)).alias(name))

    joined = top("p_retailprice", 50, "ra").join(top("p_size", 500, "rb"), "p_partkey", "left")
    rb, ra = F.col("rb"), F.col("ra")
    change = F.when(rb.isNull(), "removed").when(rb < ra, "promoted").when(rb > ra, "demoted").otherwise("same")
    return joined.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query(
    "w11_prefix_dedup",
    "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 100) ORDER BY length(text) DESC, doc_id) = 1",
)
def w11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 100).alias("prefix"), F.length("text").alias("n"))
    return r.top_per_group(docs, ["prefix"], [F.desc("n"), F.asc("doc_id")]).select("doc_id")


@query("w12_topn_per_parent", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 5 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) <= 3")
def w12(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity >= 5")
    top = r.top_per_group(lines, ["l_orderkey"], [F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], 3)
    return top.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "w13_first_anchor_wins",
    """SELECT word, arg_min(p_partkey, p_partkey) AS p_partkey FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1""",
)
def w13(spark, d):
    words = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("at", "word"))
    return r.top_per_group(words, ["word"], [F.asc("p_partkey"), F.asc("at")]).select("word", "p_partkey")


@query(
    "w14_unique_slug",
    """WITH s AS (SELECT c_custkey, lower(c_mktsegment) AS slug, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) - 1 AS k FROM customer)
    SELECT c_custkey, CASE WHEN k > 0 THEN slug || '-' || k ELSE slug END AS slug FROM s""",
)
def w14(spark, d):
    named = table(spark, d, "customer").select("c_custkey", t.slug("c_mktsegment").alias("slug"))
    return r.unique_names(named, "slug", [F.asc("c_custkey")])
