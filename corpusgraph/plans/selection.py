"""Scans, projections, filters, orders and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as t
from corpusgraph.operators import relational as r
from corpusgraph.plans.registry import query, table

# Scans


@query("s01_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s01(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query(
    "s07_projected_array_pattern",
    """SELECT p_partkey, p_name FROM part
    WHERE len(list_filter(string_split(lower(p_name), ' '), lambda w: w LIKE '%re%')) > 0""",
)
def s07(spark, d):
    words = F.split(F.lower("p_name"), " ")
    return table(spark, d, "part").select("p_partkey", "p_name").where(F.exists(words, lambda w: w.contains("re")))


@query(
    "s09_language_by_pattern",
    """SELECT source, CASE WHEN regexp_matches(source, '^src1[0-9]$') THEN 'pt' WHEN regexp_matches(source, '[02468]$') THEN 'en'
    ELSE 'unknown' END AS detected, count(*) AS n FROM documents GROUP BY ALL""",
)
def s09(spark, d):
    name = F.col("source")
    detected = F.when(name.rlike("^src1[0-9]$"), "pt").when(name.rlike("[02468]$"), "en").otherwise("unknown")
    return table(spark, d, "documents").groupBy("source", detected.alias("detected")).agg(F.count("*").alias("n"))


# Projections


@query("p01_projection", "SELECT o_orderkey, o_orderpriority FROM orders")
def p01(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority")


@query(
    "p02_nested_output",
    """SELECT c_custkey, to_json({'nation': n_name, 'region': r_name}) AS place FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def p02(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.to_json(F.struct(F.col("n_name").alias("nation"), F.col("r_name").alias("region")))
    joined = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", place.alias("place"))


@query("p03_rename", "SELECT turn AS verse, conv_id AS chapter, role FROM conversations")
def p03(spark, d):
    return table(spark, d, "conversations").withColumnsRenamed({"turn": "verse", "conv_id": "chapter"}).drop("text")


@query(
    "p04_reference_text",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN c_name END, CASE WHEN o_orderkey % 3 = 1 THEN c_mktsegment END,
    'C' || c_custkey) || ' ' || year(o_orderdate) || ':' || month(o_orderdate) AS reference
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def p04(spark, d):
    kind = F.col("o_orderkey") % 3
    name = F.coalesce(F.when(kind == 0, F.col("c_name")), F.when(kind == 1, F.col("c_mktsegment")), F.concat(F.lit("C"), "c_custkey"))
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    at = F.concat(F.lit(" "), F.year("o_orderdate"), F.lit(":"), F.month("o_orderdate"))
    return joined.select("o_orderkey", F.concat(name, at).alias("reference"))


@query(
    "p05_range_reference",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber || ':' || l_linenumber ||
    CASE WHEN floor(l_quantity)::INT > l_linenumber THEN '-' || floor(l_quantity)::INT ELSE '' END AS reference FROM lineitem""",
)
def p05(spark, d):
    end, start = F.floor("l_quantity").cast("int"), F.col("l_linenumber")
    tail = F.when(end > start, F.concat(F.lit("-"), end)).otherwise("")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(start, F.lit(":"), start, tail).alias("reference"))


@query(
    "p06_preview",
    """SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents""",
)
def p06(spark, d):
    return table(spark, d, "documents").select("doc_id", t.preview("text", 100).alias("preview"))


@query(
    "p07_kwic_snippet",
    """WITH h AS (SELECT doc_id, text, instr(lower(text), 'that') - 1 AS hit, length(text) AS n FROM documents
      WHERE contains(lower(text), 'that'))
    SELECT doc_id, CASE WHEN n <= 150 THEN text ELSE
      CASE WHEN hit > 75 THEN '...' ELSE '' END
      || substr(text, greatest(0, hit - 75) + 1, least(n, hit + 79) - greatest(0, hit - 75))
      || CASE WHEN hit + 79 < n THEN '...' ELSE '' END END AS snippet FROM h""",
)
def p07(spark, d):
    docs = table(spark, d, "documents").where(t.contains("text", "that"))
    return docs.select("doc_id", t.snippet("text", "that").alias("snippet"))


@query("p08_abbreviation", "SELECT DISTINCT o_orderpriority, string_split(o_orderpriority, '-')[-1] AS short FROM orders")
def p08(spark, d):
    return table(spark, d, "orders").select("o_orderpriority", t.last_part("o_orderpriority", "-").alias("short")).distinct()


@query(
    "p09_section_code",
    """SELECT r_name, CASE WHEN contains(lower(r_name), 'a') AND contains(lower(r_name), 'asia') THEN 'old'
    WHEN contains(lower(r_name), 'e') THEN 'new' ELSE 'other' END AS code FROM region""",
)
def p09(spark, d):
    code = F.when(t.contains("r_name", "asia"), "old").when(t.contains("r_name", "e"), "new").otherwise("other")
    return table(spark, d, "region").select("r_name", code.alias("code"))


@query(
    "p10_label_fallback",
    """SELECT source, coalesce(max(CASE WHEN lang = 'es' THEN label END), max(CASE WHEN lang = 'fr' THEN label END),
    max(CASE WHEN lang = 'en' THEN label END), source) AS label
    FROM (SELECT source, lang, lang || '-' || min(doc_id) AS label FROM documents GROUP BY 1, 2) GROUP BY source""",
)
def p10(spark, d):
    names = (
        table(spark, d, "documents").groupBy("source", "lang")
        .agg(F.concat(F.first("lang"), F.lit("-"), F.min("doc_id")).alias("label"))
    )
    order = F.array_position(F.array(*map(F.lit, ("es", "fr", "en"))), F.col("lang"))
    best = F.min_by(F.when(order > 0, F.col("label")), F.when(order > 0, order))
    return names.groupBy("source").agg(F.coalesce(best, F.col("source")).alias("label"))


@query(
    "p11_length_category",
    """SELECT doc_id, CASE WHEN w >= 2000 THEN 'comprehensive' WHEN w >= 500 THEN 'detailed' WHEN w >= 100 THEN 'medium' ELSE 'brief' END
    AS category FROM (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n]+')) AS w FROM documents)""",
)
def p11(spark, d):
    n = F.regexp_count("text", F.lit(r"[^ \t\n]+"))
    label = t.bucket(n, [(2000, "comprehensive"), (500, "detailed"), (100, "medium")], "brief")
    return table(spark, d, "documents").select("doc_id", label.alias("category"))


_STRENGTHS = [(0.3, "very_strong"), (0.15, "strong"), (0.05, "moderate")]


@query(
    "p12_strength_bucket",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax >= 0.3 THEN 'very_strong' WHEN l_tax >= 0.15 THEN 'strong'
    WHEN l_tax >= 0.05 THEN 'moderate' ELSE 'weak' END AS strength FROM lineitem""",
)
def p12(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", t.bucket("l_tax", _STRENGTHS, "weak").alias("strength"))


@query(
    "p13_confidence_bucket",
    """SELECT CASE WHEN c >= 0.85 THEN 'strong' WHEN c >= 0.65 THEN 'moderate' WHEN c >= 0.4 THEN 'weak' ELSE 'very_weak' END AS bucket,
    count(*) AS n FROM (SELECT l_discount * 10 AS c FROM lineitem) GROUP BY 1""",
)
def p13(spark, d):
    label = t.bucket(F.col("l_discount") * 10, [(0.85, "strong"), (0.65, "moderate"), (0.4, "weak")], "very_weak")
    return table(spark, d, "lineitem").groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "p14_grade_score",
    """SELECT doc_id, coalesce(CASE quality + toxic * 2 WHEN 3 THEN 1.0::DOUBLE WHEN 2 THEN 0.67 WHEN 1 THEN 0.33 END, 0.33) AS score FROM labels""",
)
def p14(spark, d):
    grade = F.col("quality") + F.col("toxic") * 2
    return table(spark, d, "labels").select("doc_id", t.lookup(grade.cast("int"), {3: 1.0, 2: 0.67, 1: 0.33}, 0.33).alias("score"))


@query(
    "p15_century",
    """SELECT y, list_extract(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX','XXI'],
    ((abs(y) - 1) // 100 + 1)::INT) || CASE WHEN y < 0 THEN ' a.C.' ELSE '' END AS century
    FROM (SELECT DISTINCT (p_size * 43 - 600)::INT AS y FROM part) WHERE y <> 0""",
)
def p15(spark, d):
    years = table(spark, d, "part").select((F.col("p_size") * 43 - 600).cast("int").alias("y")).distinct().where("y <> 0")
    return years.withColumn("century", t.century("y"))


@query(
    "p16_inclusion_reason",
    """SELECT p_partkey, CASE WHEN p_size > 40 AND p_retailprice > 1500 THEN 'canonical' WHEN p_size > 40 THEN 'deuterocanonical'
    WHEN p_retailprice > 1500 THEN 'tradition' ELSE 'excluded' END AS reason FROM part""",
)
def p16(spark, d):
    big, dear = F.col("p_size") > 40, F.col("p_retailprice") > 1500
    reason = F.when(big & dear, "canonical").when(big, "deuterocanonical").when(dear, "tradition").otherwise("excluded")
    return table(spark, d, "part").select("p_partkey", reason.alias("reason"))


@query(
    "p17_direction",
    """SELECT a.r_name || '_' || b.r_name AS direction, count(*) AS n FROM lineitem
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation x ON s_nationkey = x.n_nationkey JOIN region a ON x.n_regionkey = a.r_regionkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation y ON c_nationkey = y.n_nationkey JOIN region b ON y.n_regionkey = b.r_regionkey GROUP BY 1""",
)
def p17(spark, d):
    regions = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    of_supplier = table(spark, d, "supplier").join(regions, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("a"))
    of_customer = table(spark, d, "customer").join(regions, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("b"))
    of_order = table(spark, d, "orders").join(of_customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "b")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    joined = lines.join(of_supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(of_order, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.concat_ws("_", "a", "b").alias("direction")).agg(F.count("*").alias("n"))


@query(
    "p18_inverse_type",
    """SELECT event_type, CASE event_type WHEN 'click' THEN 'clicked_by' WHEN 'view' THEN 'viewed_by' ELSE event_type END AS inverse,
    count(*) AS n FROM events GROUP BY ALL""",
)
def p18(spark, d):
    inverse = F.coalesce(t.lookup("event_type", {"click": "clicked_by", "view": "viewed_by"}), F.col("event_type"))
    return table(spark, d, "events").groupBy("event_type", inverse.alias("inverse")).agg(F.count("*").alias("n"))


@query(
    "p19_match_type",
    """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'a') THEN 'name' WHEN contains(lower(p_brand), '1') THEN 'alias' ELSE 'content' END AS match_type,
    CASE WHEN contains(lower(p_name), 'a') THEN 1.0::DOUBLE WHEN contains(lower(p_brand), '1') THEN 0.8 ELSE 0.6 END AS score FROM part""",
)
def p19(spark, d):
    kind = F.when(t.contains("p_name", "a"), "name").when(t.contains("p_brand", "1"), "alias").otherwise("content")
    parts = table(spark, d, "part").select("p_partkey", kind.alias("match_type"))
    return parts.withColumn("score", t.lookup("match_type", {"name": 1.0, "alias": 0.8, "content": 0.6}))


@query("p20_similarity_from_distance", "SELECT vec_id, round(1 - (1 - embedding[1]::DOUBLE), 6) AS similarity FROM embeddings")
def p20(spark, d):
    distance = 1 - F.get("embedding", F.lit(0)).cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.round(1 - distance, 6).alias("similarity"))


@query(
    "p21_enum_mapping",
    """SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END, 'mixed') AS status FROM orders""",
)
def p21(spark, d):
    return table(spark, d, "orders").select("o_orderkey", t.lookup("o_orderstatus", {"F": "finished", "O": "open"}, "mixed").alias("status"))


@query("p22_truncate", "SELECT page_id, substr(html, 1, 50) AS head FROM pages")
def p22(spark, d):
    return table(spark, d, "pages").select("page_id", F.substring("html", 1, 50).alias("head"))


@query(
    "p23_sections",
    "SELECT p_partkey, unnest(generate_series(1, p_size))::INT AS section FROM part",
)
def p23(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.expr("sequence(1, p_size)")).alias("section"))


@query("p24_json_field", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def p24(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("p25_template", "SELECT n_nationkey, n_name || ' is number ' || n_nationkey || ' of region ' || n_regionkey AS line FROM nation")
def p25(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.format_string("%s is number %d of region %d", "n_name", "n_nationkey", "n_regionkey").alias("line"))


@query(
    "p26_author_from_period",
    """SELECT s_suppkey, y AS death_year, y - 60 AS birth_year, (y // 100 + 1)::INT AS century,
    CASE WHEN y > 1500 THEN 'modern' WHEN y > 1000 THEN 'medieval' ELSE 'church_father' END AS author_type,
    string_split(s_name, '#')[-1] AS short_name
    FROM (SELECT *, regexp_extract('AD' || (s_suppkey * 37 % 1900 + 60), 'AD([0-9]+)', 1)::INT AS y FROM supplier)""",
)
def p26(spark, d):
    period = F.concat(F.lit("AD"), F.col("s_suppkey") * 37 % 1900 + 60)
    y = F.col("death_year")
    dated = table(spark, d, "supplier").withColumn("death_year", F.try_to_number(F.regexp_extract(period, "AD([0-9]+)", 1), F.lit("9999")).cast("int"))
    return dated.select(
        "s_suppkey", "death_year", (y - 60).alias("birth_year"), (F.floor(y / 100) + 1).cast("int").alias("century"),
        t.bucket("death_year", [(1501, "modern"), (1001, "medieval")], "church_father").alias("author_type"),
        t.last_part("s_name", "#").alias("short_name"),
    )


@query(
    "p27_keyed_lines",
    """SELECT page_id, coalesce(nullif(lower(trim(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1))), ''), 'freeform') AS title FROM pages""",
)
def p27(spark, d):
    title = F.lower(F.trim(F.regexp_extract("html", "(?i)<title>([^<]*)</title>", 1)))
    return table(spark, d, "pages").select("page_id", F.coalesce(F.nullif(title, F.lit("")), F.lit("freeform")).alias("title"))


# Filters


@query("f01_equality", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def f01(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")


@query("f02_equal_any_case", "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = lower('nation_3') OR lower(n_name) = 'france'")
def f02(spark, d):
    return table(spark, d, "nation").where(t.same("n_name", F.lit("nation_3")) | t.same("n_name", F.lit("FRANCE"))).select("n_nationkey", "n_name")


@query("f03_contains", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def f03(spark, d):
    return table(spark, d, "documents").where(t.contains("text", "License")).select("doc_id")


@query(
    "f04_starts_ends",
    "SELECT p_partkey FROM part WHERE starts_with(lower(p_name), 'a') OR suffix(lower(p_brand), '3')",
)
def f04(spark, d):
    return table(spark, d, "part").where(t.starts("p_name", "A") | t.ends("p_brand", "3")).select("p_partkey")


@query(
    "f05_whole_word_and",
    """SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^a-zA-ZÀ-ÿ])the([^a-zA-ZÀ-ÿ]|$)', 'i')
    AND regexp_matches(text, '(^|[^a-zA-ZÀ-ÿ])and([^a-zA-ZÀ-ÿ]|$)', 'i')""",
)
def f05(spark, d):
    return table(spark, d, "documents").where(t.whole_words("text", "the and")).select("doc_id")


@query("f06_range", "SELECT p_partkey FROM part WHERE p_size >= 5 AND p_size <= 20")
def f06(spark, d):
    return table(spark, d, "part").where(F.col("p_size").between(5, 20)).select("p_partkey")


@query("f07_between", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 GROUP BY 1")
def f07(spark, d):
    return table(spark, d, "lineitem").where("l_linenumber BETWEEN 2 AND 4").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    "f08_composite_range",
    """SELECT o_orderkey FROM orders WHERE year(o_orderdate) * 12 + month(o_orderdate) BETWEEN 1994 * 12 + 5 AND 1996 * 12 + 2""",
)
def f08(spark, d):
    inside = r.composite_between(F.year("o_orderdate"), F.month("o_orderdate"), (1994, 5), (1996, 2))
    return table(spark, d, "orders").where(inside).select("o_orderkey")


@query("f09_stabbing", "SELECT p_partkey FROM part WHERE p_size <= 25 AND 25 <= p_size + 10")
def f09(spark, d):
    return table(spark, d, "part").where(F.lit(25).between(F.col("p_size"), F.col("p_size") + 10)).select("p_partkey")


@query(
    "f10_multi_or_search",
    "SELECT DISTINCT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'std') OR contains(lower(p_brand), '12')",
)
def f10(spark, d):
    parts = table(spark, d, "part")
    hit = t.matches_any("red", "p_name") | t.matches_any("std", "p_type") | t.matches_any("12", "p_brand")
    return parts.where(hit).select("p_partkey").distinct()


@query(
    "f11_array_contains_all",
    """SELECT l_orderkey FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1)
    WHERE list_has_all(flags, ['A', 'R'])""",
)
def f11(spark, d):
    flags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    wanted = F.array(F.lit("A"), F.lit("R"))
    return flags.where(F.size(F.array_except(wanted, F.col("flags"))) == 0).select("l_orderkey")


@query(
    "f12_array_element_contains",
    "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: contains(lower(w), 'an'))) > 0",
)
def f12(spark, d):
    hit = F.exists(F.split("p_name", " "), lambda w: F.lower(w).contains("an"))
    return table(spark, d, "part").where(hit).select("p_partkey")


@query("f13_in_set", "SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def f13(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "view", "purchase")).select("event_id")


@query(
    "f14_null_checks",
    "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL AND d.lang IS NOT NULL",
)
def f14(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.where(F.col("quality").isNull() & F.col("lang").isNotNull()).select("doc_id")


@query("f15_boolean_text", "SELECT doc_id FROM labels WHERE (CASE WHEN quality = 1 THEN 'Yes' ELSE 'no' END) IN ('1', 'true', 'Yes', 'yes')")
def f15(spark, d):
    return table(spark, d, "labels").where(t.truthy(F.when(F.col("quality") == 1, "Yes").otherwise("no"))).select("doc_id")


@query("f16_threshold", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE round(l_discount, 4) >= 0.07")
def f16(spark, d):
    return table(spark, d, "lineitem").where(F.round("l_discount", 4) >= 0.07).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "f17_match_all_terms",
    """SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), ['the', 'with', 'that'])""",
)
def f17(spark, d):
    from corpusgraph.operators.retrieval import all_in_text

    return table(spark, d, "documents").where(all_in_text("text", ["the", "with", "that"])).select("doc_id")


@query(
    "f18_proximity",
    """WITH w AS (SELECT doc_id, generate_subscripts(ts, 1) AS p, unnest(ts) AS w FROM
      (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS ts FROM documents))
    SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.p = a.p + 2 WHERE a.w = 'the' AND b.w = 'of'""",
)
def f18(spark, d):
    from corpusgraph.operators.retrieval import near_in_text

    return table(spark, d, "documents").where(near_in_text("text", "the", "of", 2)).select("doc_id")


@query(
    "f18_any_term",
    """SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), ['license', 'stupid'])""",
)
def f18_any(spark, d):
    from corpusgraph.operators.retrieval import any_in_text

    return table(spark, d, "documents").where(any_in_text("text", ["license", "stupid"])).select("doc_id")


@query(
    "f19_fallback_rank",
    """SELECT doc_id, round(1.0 / row_number() OVER (ORDER BY doc_id), 6) AS score FROM documents WHERE contains(lower(text), 'apache') ORDER BY doc_id LIMIT 50""",
)
def f19(spark, d):
    hits = table(spark, d, "documents").where(t.contains("text", "apache")).select("doc_id").orderBy("doc_id").limit(50)
    return hits.withColumn("score", F.round(1 / F.row_number().over(Window.orderBy("doc_id")), 6))


@query("f20_folded_contains", "SELECT doc_id, contains(strip_accents(lower(text)), 'reau') AS has FROM documents")
def f20(spark, d):
    return table(spark, d, "documents").select("doc_id", t.fold("text").contains("reau").alias("has"))


@query(
    "f21_visibility",
    "SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR (o_orderstatus IN ('O', 'P') AND o_totalprice > 200000)",
)
def f21(spark, d):
    public = F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") > 200000)
    return table(spark, d, "orders").where((F.col("o_custkey") == 7) | public).select("o_orderkey")


@query(
    "f22_resolve_by_priority",
    """SELECT c_custkey FROM customer, (SELECT '12' AS ref) WHERE c_custkey = ref::BIGINT OR lower(c_name) = lower(ref) OR suffix(c_name, ref)
    ORDER BY CASE WHEN c_custkey = ref::BIGINT THEN 1 WHEN lower(c_name) = lower(ref) THEN 2 ELSE 3 END, c_custkey LIMIT 1""",
)
def f22(spark, d):
    ref = "12"
    tier = F.when(F.col("c_custkey") == int(ref), 1).when(t.same("c_name", F.lit(ref)), 2).when(F.endswith("c_name", F.lit(ref)), 3)
    found = table(spark, d, "customer").withColumn("tier", tier).where("tier IS NOT NULL")
    return found.orderBy("tier", "c_custkey").limit(1).select("c_custkey")


@query("f23_tradition", "SELECT p_partkey FROM part WHERE p_size <= 40 OR p_type = 'LARGE'")
def f23(spark, d):
    return table(spark, d, "part").where((F.col("p_size") <= 40) | (F.col("p_type") == "LARGE")).select("p_partkey")


@query("f24_prefix_excluded", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND NOT starts_with(text, 'T')")
def f24(spark, d):
    return table(spark, d, "conversations").where(~F.startswith("text", F.lit("T"))).select("conv_id", "turn")


@query("f25_min_length", "SELECT doc_id FROM documents WHERE length(trim(text, ' ')) >= 50")
def f25(spark, d):
    return table(spark, d, "documents").where(F.length(F.trim("text")) >= 50).select("doc_id")


@query(
    "f27_exclude_self",
    """SELECT b.vec_id FROM embeddings a JOIN embeddings b ON a.vec_id = 5 AND b.vec_id <> 5 AND NOT (a.label = b.label AND b.vec_id % 2 = 0)""",
)
def f27(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    own = F.broadcast(e.where("vec_id = 5").select(F.col("label").alias("own")))
    return e.join(own, (F.col("vec_id") != 5) & ~((F.col("label") == F.col("own")) & (F.col("vec_id") % 2 == 0))).select("vec_id")


@query(
    "f28_annotation_gate",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 10 >= 0.8 AS is_primary FROM lineitem WHERE l_discount * 10 >= 0.5""",
)
def f28(spark, d):
    score = F.col("l_discount") * 10
    return table(spark, d, "lineitem").where(score >= 0.5).select("l_orderkey", "l_linenumber", "l_partkey", (score >= 0.8).alias("is_primary"))


@query(
    "f30_marked_rows",
    """SELECT d.doc_id, max(e.ts) AS marked FROM documents d JOIN events e ON e.user_id = d.doc_id AND e.event_type = 'click'
    WHERE d.source > '' GROUP BY 1""",
)
def f30(spark, d):
    marks = table(spark, d, "events").where("event_type = 'click'").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("ts").alias("marked"))
    return table(spark, d, "documents").where("source > ''").select("doc_id").join(marks, "doc_id")


# Orders and pages


@query("t01_multi_key_sort", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey) AS place FROM customer")
def t01(spark, d):
    from corpusgraph.operators.ordering import numbered

    order = [F.asc_nulls_last("c_mktsegment"), F.desc_nulls_first("c_acctbal"), F.asc("c_custkey")]
    return numbered(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), order, "place").select("c_custkey", "place")


@query("t02_chosen_order", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def t02(spark, d):
    from corpusgraph.operators.ordering import chosen

    return table(spark, d, "part").orderBy(*chosen("-p_retailprice", ("p_retailprice", "p_size"), "p_partkey")).limit(15).select("p_partkey", "p_retailprice")


@query("t03_limit", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5")
def t03(spark, d):
    return table(spark, d, "supplier").orderBy("s_suppkey").limit(5).select("s_suppkey")


@query(
    "t04_pagination",
    """SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, (SELECT ceil(count(*) / 20.0)::BIGINT FROM orders) AS pages
    FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""",
)
def t04(spark, d):
    return r.page(table(spark, d, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_orderkey", "total", "pages")


@query("t05_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def t05(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("t06_filter_before_limit", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def t06(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey")


@query(
    "t07_nested_limit",
    """SELECT conv_id, array_to_string(list_slice(list(role || ':' || turn ORDER BY turn), 1, 3), ',') AS first_turns FROM conversations GROUP BY conv_id""",
)
def t07(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "turn").alias("x"))))
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.slice(turns, 1, 3).alias("turns"))
    return nested.select("conv_id", F.array_join("turns.x", ",").alias("first_turns"))


@query("t08_exists", "SELECT count(*) > 0 AS found FROM (SELECT 1 FROM labels WHERE toxic = 1 LIMIT 1)")
def t08(spark, d):
    return table(spark, d, "labels").where("toxic = 1").limit(1).agg((F.count("*") > 0).alias("found"))


# Sets


@query("u01_union_ids", "SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE n_chars > 5000")
def u01(spark, d):
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return toxic.union(table(spark, d, "documents").where("n_chars > 5000").select("doc_id")).distinct()


@query(
    "u02_rank_set_ops",
    """WITH a AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30), b AS (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 30)
    SELECT 'both' AS part, p_partkey FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', p_partkey FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def u02(spark, d):
    parts = table(spark, d, "part")
    a = parts.orderBy(F.desc("p_retailprice"), "p_partkey").limit(30).select("p_partkey")
    b = parts.orderBy(F.desc("p_size"), "p_partkey").limit(30).select("p_partkey")
    both = a.intersect(b).select(F.lit("both").alias("part"), "p_partkey")
    return both.union(a.exceptAll(b).select(F.lit("first"), "p_partkey"))


@query("u03_subset", "SELECT count(*) = 0 AS subset FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def u03(spark, d):
    missing = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti")
    return missing.agg((F.count("*") == 0).alias("subset"))


@query("u04_distinct", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def u04(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()


@query(
    "u05_tagged_union",
    "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier",
)
def u05(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return a.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query(
    "u06_jaccard",
    """WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS ws FROM benchmark)
    SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))::DOUBLE, 6) AS jaccard
    FROM w a JOIN w b ON b.item_id = a.item_id + 1""",
)
def u06(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.array_distinct(t.tokens("text")).alias("ws"))
    other = w.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("ws").alias("vs"))
    return w.join(other, "item_id").select(F.col("item_id").alias("a"), "b", F.round(t.jaccard(F.col("ws"), F.col("vs")), 6).alias("jaccard"))
