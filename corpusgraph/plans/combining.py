"""Joins and changes of tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as t
from corpusgraph.operators import relational as r
from corpusgraph.operators import resolution
from corpusgraph.plans.registry import query, table

_THEMES = "SELECT DISTINCT l_orderkey AS unit, p_type AS theme FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(
    "j01_inner_join",
    """SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_totalprice > 300000""",
)
def j01(spark, d):
    orders = table(spark, d, "orders").where("o_totalprice > 300000")
    named = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(named, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@query(
    "j02_left_lookup",
    "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def j02(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("quality", "toxic")])


@query(
    "j03_nested_collect",
    """SELECT conv_id, count(*) AS turns, string_agg(turn || '=' || role, ';' ORDER BY turn, role) AS nested FROM conversations GROUP BY conv_id""",
)
def j03(spark, d):
    nested = F.array_sort(F.collect_list(F.struct("turn", "role")))
    text = F.array_join(F.transform("nested", lambda x: F.concat_ws("=", x["turn"], x["role"])), ";")
    by_conv = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), nested.alias("nested"))
    return by_conv.withColumn("nested", text)


@query(
    "j04_many_to_many",
    "SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12' OR p_size = 7",
)
def j04(spark, d):
    parts = table(spark, d, "part").where("p_brand = 'Brand#12' OR p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey")
    return table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query(
    "j05_semi_exists",
    """SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)""",
)
def j05(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45")
    return table(spark, d, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query(
    "j06_in_subquery",
    "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)",
)
def j06(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 50")
    return table(spark, d, "part").join(big, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query(
    "j07_range_join",
    """SELECT p.p_partkey, r.s_suppkey FROM part p JOIN
    (SELECT s_suppkey, s_nationkey % 5 AS k, (s_suppkey % 40)::INT AS a, (s_suppkey % 40 + s_nationkey % 9)::INT AS b FROM supplier) r
    ON p.p_partkey % 5 = r.k AND p.p_size BETWEEN r.a AND r.b""",
)
def j07(spark, d):
    start = (F.col("s_suppkey") % 40).cast("int")
    ranges = table(spark, d, "supplier").select(
        "s_suppkey", (F.col("s_nationkey") % 5).cast("long").alias("k"), start.alias("a"), (start + F.col("s_nationkey") % 9).alias("b")
    )
    points = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 5).alias("k"))
    return r.interval_join(points, "p_size", ranges, "a", "b", ["k"], 8).select("p_partkey", "s_suppkey")


@query(
    "j08_range_expansion",
    """SELECT s_suppkey, p_partkey FROM (SELECT s_suppkey, unnest(generate_series(s_suppkey * 3, s_suppkey * 3 + s_nationkey % 4)) AS k FROM supplier)
    JOIN part ON p_partkey = k""",
)
def j08(spark, d):
    first = F.col("s_suppkey") * 3
    spread = table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(first, first + F.col("s_nationkey") % 4)).alias("p_partkey"))
    return spread.join(table(spark, d, "part").select("p_partkey"), "p_partkey").select("s_suppkey", "p_partkey")


@query(
    "j09_full_outer_rank_merge",
    """WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS ra FROM part QUALIFY ra <= 40),
    b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rb FROM part QUALIFY rb <= 40)
    SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(ra, 0) AS ra, coalesce(rb, 0) AS rb FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""",
)
def j09(spark, d):
    def top(column, name):
        order = [F.desc(column), F.asc("p_partkey")]
        best = table(spark, d, "part").orderBy(*order).limit(40)
        return best.select("p_partkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias(name))

    both = top("p_retailprice", "ra").join(top("p_size", "rb"), "p_partkey", "full_outer")
    return both.select("p_partkey", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("ra", "rb")])


@query("j10_anti_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def j10(spark, d):
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id").join(have, "doc_id", "left_anti")


_FALLBACK = """SELECT unit, first(lang ORDER BY CASE lang WHEN 'es' THEN 1 WHEN 'fr' THEN 2 WHEN 'en' THEN 3 ELSE 4 END, doc_id) AS lang,
    first(doc_id ORDER BY CASE lang WHEN 'es' THEN 1 WHEN 'fr' THEN 2 WHEN 'en' THEN 3 ELSE 4 END, doc_id) AS doc_id
    FROM (SELECT doc_id % 100 AS unit, lang, doc_id FROM documents) {where} GROUP BY unit"""


def _versions(spark, d):
    return table(spark, d, "documents").select((F.col("doc_id") % 100).alias("unit"), "lang", "doc_id")


@query("j11_version_fallback", _FALLBACK.format(where="WHERE lang IN ('es', 'fr', 'en')"))
def j11(spark, d):
    known = _versions(spark, d).where(F.col("lang").isin("es", "fr", "en"))
    return r.prefer(known, ["unit"], "lang", ["es", "fr", "en"], [F.asc("doc_id")])


@query("j12_any_version", _FALLBACK.format(where=""))
def j12(spark, d):
    return r.prefer(_versions(spark, d), ["unit"], "lang", ["es", "fr", "en"], [F.asc("doc_id")])


@query(
    "j13_bidirectional_edges",
    """SELECT node, direction, count(*) AS n FROM (SELECT l_partkey AS node, 'outgoing' AS direction FROM lineitem
    UNION ALL SELECT l_suppkey, 'incoming' FROM lineitem) GROUP BY ALL""",
)
def j13(spark, d):
    edges = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    return r.both_directions(edges, "l_partkey", "l_suppkey", "node", "other").groupBy("node", "direction").agg(F.count("*").alias("n"))


@query(
    "j14_theme_cooccurrence",
    f"""WITH u AS ({_THEMES}), own AS (SELECT theme, count(*) AS n FROM u GROUP BY 1)
    SELECT a.theme, b.theme AS other, count(*) AS shared, round(count(*) / any_value(n)::DOUBLE, 6) AS strength
    FROM u a JOIN u b ON a.unit = b.unit AND a.theme <> b.theme JOIN own ON own.theme = a.theme GROUP BY ALL""",
)
def j14(spark, d):
    from corpusgraph.operators.analytics import cooccurrence

    out = cooccurrence(theme_links(spark, d), "unit", "theme")
    return out.select("theme", "other", "shared", F.round("strength", 6).alias("strength"))


def theme_links(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("theme"))
    return table(spark, d, "lineitem").join(parts, "l_partkey").select(F.col("l_orderkey").alias("unit"), "theme").distinct()


@query(
    "j15_query_vector",
    "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 6) AS dot FROM embeddings",
)
def j15(spark, d):
    from corpusgraph.functions import vectors as v

    e = table(spark, d, "embeddings")
    one = F.broadcast(e.where("vec_id = 3").select(v.doubles("embedding").alias("q")))
    return e.crossJoin(one).select("vec_id", F.round(v.dot(v.doubles("embedding"), F.col("q")), 6).alias("dot"))


@query(
    "j16_pivot_compare",
    """SELECT doc_id % 50 AS unit, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr,
    count(*) FILTER (WHERE lang = 'de') AS de FROM documents GROUP BY 1""",
)
def j16(spark, d):
    docs = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("unit"), "lang")
    counts = docs.groupBy("unit").pivot("lang", ["en", "fr", "de"]).agg(F.count("unit"))
    return counts.na.fill(0)


_NAMES = """names AS (SELECT p_partkey AS id, lower(string_split(p_name, ' ')[1]) AS name, lower(p_type) AS alias FROM part),
    wanted AS (SELECT DISTINCT name AS w FROM names UNION SELECT name || 's' FROM names UNION SELECT alias FROM names UNION SELECT 'the ' || name FROM names
      UNION SELECT lower(c_mktsegment) FROM customer UNION SELECT lower(c_mktsegment) || 's' FROM customer),
    p AS (SELECT w, name, 1 - levenshtein(w, name) / greatest(length(w), length(name))::DOUBLE AS score FROM wanted, (SELECT DISTINCT name FROM names))"""


def _names(spark, d):
    first = F.lower(F.get(F.split("p_name", " "), F.lit(0)))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), first.alias("name"), F.lower("p_type").alias("alias"))
    forms = F.explode(F.array("name", F.concat("name", F.lit("s")), F.concat(F.lit("the "), "name"), "alias"))
    return names, names.select(forms.alias("w")).union(table(spark, d, "customer").select(F.explode(F.array(F.lower("c_mktsegment"), F.concat(F.lower("c_mktsegment"), F.lit("s")))))).distinct()


@query(
    "j17_resolution_cascade",
    f"""WITH {_NAMES}, t AS (SELECT name AS w, 1 AS k, 'exact' AS method, 1.0::DOUBLE AS confidence, id FROM names UNION ALL SELECT alias, 2, 'alias', 0.95, id FROM names
      UNION ALL SELECT lower(c_mktsegment), 3, 'person', 0.9, c_custkey FROM customer
      UNION ALL SELECT w, 4, 'fuzzy', round(score, 6), id FROM (SELECT * FROM p WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY w ORDER BY score DESC, name) = 1) JOIN names USING (name)
      UNION ALL SELECT w, 5, 'fuzzy_person', round(score, 6), id FROM (SELECT w, name, 1 - levenshtein(w, name) / greatest(length(w), length(name))::DOUBLE AS score FROM wanted, (SELECT DISTINCT lower(c_mktsegment) AS name FROM customer)
        WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY w ORDER BY score DESC, name) = 1) JOIN (SELECT lower(c_mktsegment) AS name, c_custkey AS id FROM customer) USING (name)),
    b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY w ORDER BY k, id) = 1)
    SELECT w, coalesce(id, 0) AS id, coalesce(method, 'unmatched') AS method, coalesce(confidence, 0.0::DOUBLE) AS confidence FROM wanted LEFT JOIN b USING (w)""",
)
def j17(spark, d):
    names, wanted = _names(spark, d)
    people = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("w"), F.col("c_custkey").alias("id"))
    tiers = [
        ("exact", 1.0, names.select(F.col("name").alias("w"), "id")), ("alias", 0.95, names.select(F.col("alias").alias("w"), "id")),
        ("person", 0.9, people),
    ]
    out = resolution.cascade(wanted, "w", tiers, "id", [("fuzzy", names.select("name", "id")), ("fuzzy_person", people.select(F.col("w").alias("name"), "id"))], "name", 0.7, resolution.fuzzy)
    return out.select("w", F.coalesce("id", F.lit(0).cast("long")).alias("id"), "method", F.round("confidence", 6).alias("confidence"))


@query(
    "j18_fuzzy_levenshtein",
    f"""WITH {_NAMES} SELECT w, name, round(score, 6) AS score FROM p WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY w ORDER BY score DESC, name) = 1""",
)
def j18(spark, d):
    names, wanted = _names(spark, d)
    out = resolution.fuzzy(wanted, "w", names.select("name").distinct(), "name", 0.6)
    return out.select("w", "name", F.round("score", 6).alias("score"))


@query(
    "j19_unified_people",
    """SELECT coalesce(a.n, b.n) AS name, CASE WHEN a.n IS NULL THEN 'supplier' WHEN b.n IS NULL THEN 'customer' ELSE 'mixed' END AS kind
    FROM (SELECT DISTINCT lower(string_split(c_name, '#')[-1]) AS n FROM customer) a
    FULL JOIN (SELECT DISTINCT lower(string_split(s_name, '#')[-1]) AS n FROM supplier) b ON a.n = b.n""",
)
def j19(spark, d):
    a = table(spark, d, "customer").select(F.lower(t.last_part("c_name", "#")).alias("name"), F.lit("customer").alias("kind"))
    b = table(spark, d, "supplier").select(F.lower(t.last_part("s_name", "#")).alias("name"), F.lit("supplier").alias("kind"))
    return resolution.unify(a.unionByName(b), "name", "kind", "mixed")


@query(
    "j20_any_case_lookup",
    """SELECT n_nationkey, min(c_custkey) AS c_custkey FROM nation JOIN customer ON lower(n_name) = lower('NATION_' || c_nationkey) OR n_nationkey = c_nationkey GROUP BY 1""",
)
def j20(spark, d):
    # Two equality joins instead of one join on either of two conditions.
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    by_name = nation.join(customer, F.lower("n_name") == F.lower(F.concat(F.lit("NATION_"), "c_nationkey")))
    by_id = nation.join(customer, F.col("n_nationkey") == F.col("c_nationkey"))
    return by_name.unionByName(by_id).groupBy("n_nationkey").agg(F.min("c_custkey").alias("c_custkey"))


@query(
    "j21_alias_map",
    """SELECT key, first(p_partkey ORDER BY pri, p_partkey) AS p_partkey FROM (
      SELECT regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9]', '', 'g') AS key, 1 AS pri, p_partkey FROM part
      UNION ALL SELECT regexp_replace(strip_accents(lower(p_brand)), '[^a-z0-9]', '', 'g'), 2, p_partkey FROM part) GROUP BY key""",
)
def j21(spark, d):
    part = table(spark, d, "part")
    aliases = part.select(t.ascii_key("p_name").alias("key"), F.lit(1).alias("pri"), "p_partkey").union(
        part.select(t.ascii_key("p_brand"), F.lit(2), "p_partkey")
    )
    return resolution.alias_map(aliases, "key", "pri", "p_partkey")


@query(
    "j22_translation_by_slug",
    """SELECT a.c_mktsegment, min(b.p_partkey) AS p_partkey FROM (SELECT DISTINCT c_mktsegment FROM customer) a
    JOIN part b ON substr(regexp_replace(lower(a.c_mktsegment), '[^a-z0-9]+', '-', 'g'), 1, 1) = substr(regexp_replace(lower(b.p_type), '[^a-z0-9]+', '-', 'g'), 1, 1)
    GROUP BY 1""",
)
def j22(spark, d):
    a = table(spark, d, "customer").select("c_mktsegment").distinct().withColumn("k", F.substring(t.slug("c_mktsegment"), 1, 1))
    b = table(spark, d, "part").groupBy(F.substring(t.slug("p_type"), 1, 1).alias("k")).agg(F.min("p_partkey").alias("p_partkey"))
    return a.join(b, "k").select("c_mktsegment", "p_partkey")


@query(
    "j23_metrics_with_remap",
    """SELECT c_custkey, coalesce(a.n, b.n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a ON a.k = c_custkey
    LEFT JOIN (SELECT o_custkey + 1 AS k, count(*) AS n FROM orders GROUP BY 1) b ON b.k = c_custkey""",
)
def j23(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    own = counts.select(F.col("o_custkey").alias("c_custkey"), F.col("n").alias("a"))
    old = counts.select((F.col("o_custkey") + 1).alias("c_custkey"), F.col("n").alias("b"))
    joined = table(spark, d, "customer").select("c_custkey").join(own, "c_custkey", "left").join(old, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("a", "b", F.lit(0).cast("long")).alias("n"))


@query(
    "j24_endpoint_union",
    "SELECT DISTINCT k FROM (SELECT l_partkey AS k FROM lineitem UNION SELECT l_suppkey FROM lineitem)",
)
def j24(spark, d):
    edges = table(spark, d, "lineitem")
    return edges.select(F.col("l_partkey").alias("k")).union(edges.select("l_suppkey")).distinct()


# Changes


@query(
    "k02_insert_ignore",
    """SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def k02(spark, d):
    target = table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return r.insert_ignore(target, rows, ["doc_id"])


@query(
    "k03_upsert",
    """SELECT coalesce(a.c_custkey, b.k) AS c_custkey, coalesce(b.seg, a.c_mktsegment) AS c_mktsegment FROM customer a
    FULL JOIN (SELECT o_custkey + 10 AS k, max(CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority END) AS seg FROM orders GROUP BY 1) b ON a.c_custkey = b.k""",
)
def k03(spark, d):
    new = table(spark, d, "orders").groupBy((F.col("o_custkey") + 10).alias("c_custkey")).agg(
        F.max(F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority"))).alias("c_mktsegment")
    )
    return r.upsert(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), new, ["c_custkey"])


@query(
    "k04_get_or_create",
    """WITH d AS (SELECT DISTINCT c_nationkey::BIGINT AS id, 'N' || c_nationkey AS name FROM customer),
    new AS (SELECT name, row_number() OVER (ORDER BY name) AS k FROM (SELECT DISTINCT 'N' || (s_nationkey + 20) AS name FROM supplier EXCEPT SELECT name FROM d))
    SELECT id, name FROM d UNION ALL SELECT (SELECT max(id) FROM d) + k, name FROM new""",
)
def k04(spark, d):
    known = table(spark, d, "customer").select(
        F.col("c_nationkey").cast("long").alias("id"), F.concat(F.lit("N"), "c_nationkey").alias("name")
    ).distinct()
    names = table(spark, d, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey") + 20).alias("name"))
    return r.get_or_create(known, names, "name", "id")


@query("k05_replace_children", "SELECT conv_id, turn, role FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT DISTINCT conv_id, -1, 'new' FROM conversations WHERE conv_id % 2 = 1")
def k05(spark, d):
    old = table(spark, d, "conversations").select("conv_id", "turn", "role")
    new = old.where("conv_id % 2 = 1").select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("new").alias("role"))
    return old.join(new.select("conv_id"), "conv_id", "left_anti").select(*old.columns).unionByName(new)


@query("k06_refresh_counts", "SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def k06(spark, d):
    children = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return r.refresh_counts(table(spark, d, "nation").select("n_nationkey"), children, "n_nationkey", "n")


@query("k07_counter", "SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1")
def k07(spark, d):
    return table(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("views"))


@query("k11_orphans", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def k11(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return r.orphans(table(spark, d, "part").select("p_partkey"), used, "p_partkey")


@query(
    "k12_distinct_meanings",
    """SELECT p_type, lower(p_brand) AS meaning, min(p_partkey) AS first, min(p_partkey) = min(min(p_partkey)) OVER (PARTITION BY p_type) AS is_primary
    FROM part WHERE length(p_brand) >= 2 GROUP BY p_type, lower(p_brand)""",
)
def k12(spark, d):
    meanings = table(spark, d, "part").where("length(p_brand) >= 2").groupBy("p_type", F.lower("p_brand").alias("meaning")).agg(F.min("p_partkey").alias("first"))
    return meanings.withColumn("is_primary", F.col("first") == F.min("first").over(Window.partitionBy("p_type")))


@query("k13_toggle", "SELECT user_id, count(*) % 2 = 1 AS marked FROM events WHERE event_type = 'click' GROUP BY 1")
def k13(spark, d):
    return table(spark, d, "events").where("event_type = 'click'").groupBy("user_id").agg((F.count("*") % 2 == 1).alias("marked"))
