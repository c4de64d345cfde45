import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import analytics, etl, ordering, relational, resolution, retrieval
from corpusgraph.sources import tables


def test_mmr_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6))
    scores = np.round(rng.random(40), 3)
    frame = spark.createDataFrame([(1, i, x[i].tolist(), float(scores[i])) for i in range(40)], "q int, id int, v array<double>, s double")
    found = [r.id for r in retrieval.mmr(frame, "q", "id", "v", "s", 8, 0.6).orderBy("place").collect()]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = sorted(range(40), key=lambda i: (-scores[i], i))
    chosen = [order[0]]
    while len(chosen) < 8:
        rest = [i for i in order if i not in chosen]
        chosen.append(max(rest, key=lambda i: 0.6 * scores[i] - 0.4 * max(unit[i] @ unit[j] for j in chosen)))
    assert found == chosen


def test_diversify_against_the_greedy_loop(spark):
    random.seed(2)
    for _ in range(3):
        hits = [(i, random.randrange(5)) for i in range(25)]
        frame = spark.createDataFrame(hits, "id int, book int")
        k = 8
        chosen = hits[: k // 2]
        for h in hits[k // 2 :]:
            if len(chosen) < k and h[1] not in {b for _, b in chosen}:
                chosen.append(h)
        chosen += [h for h in hits if h not in chosen][: k - len(chosen)]
        found = retrieval.diversify(frame, "book", [F.asc("id")], k).collect()
        assert sorted(r.id for r in found) == sorted(i for i, _ in chosen)


def test_rrf_is_one_for_first_in_both(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, bm25_rank int")
    b = spark.createDataFrame([(1, 1), (3, 2)], "id int, vector_rank int")
    rows = {r.id: r for r in retrieval.rrf(a, b, "id").collect()}
    assert abs(rows[1].final_score - 1) < 1e-9
    assert (rows[1].match_source, rows[2].match_source, rows[3].match_source) == ("both", "bm25_only", "vector_only")


def test_interval_join_includes_both_ends(spark):
    points = spark.createDataFrame([(1, 5), (1, 9), (1, 10), (2, 5), (1, 30)], "k int, x int")
    ranges = spark.createDataFrame([(1, 5, 9, "a"), (1, 9, 9, "b"), (1, 0, 100, "c")], "k int, lo int, hi int, name string")
    rows = relational.interval_join(points, "x", ranges, "lo", "hi", ["k"], 8).select("x", "name").collect()
    assert sorted(map(tuple, rows)) == [(5, "a"), (5, "c"), (9, "a"), (9, "b"), (9, "c"), (10, "c"), (30, "c")]


def test_table_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "id int, v string")
    assert sorted(map(tuple, relational.insert_ignore(old, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(map(tuple, relational.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "x"), (3, "y")]
    empty = new.limit(0)
    assert relational.upsert(old, empty, ["id"]).count() == 2
    made = relational.get_or_create(old.select(F.col("id").cast("long").alias("id"), "v"), new, "v", "id")
    assert sorted(map(tuple, made.collect())) == [(1, "a"), (2, "b"), (3, "x"), (4, "y")]


def test_unique_names(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "id int, slug string")
    rows = relational.unique_names(frame, "slug", [F.asc("id")]).orderBy("id").collect()
    assert [r.slug for r in rows] == ["a", "a-1", "b", "a-2"]


def test_fuzzy_ratio_against_all_pairs(spark):
    names = ["moises", "moses", "abraham", "abraao", "isaac", "isaque", "sara", "sarah"]
    wanted = ["mosess", "abrahan", "sahra", "zzz"]
    a, b = spark.createDataFrame([(x,) for x in wanted], "w string"), spark.createDataFrame([(x,) for x in names], "name string")
    found = {r.w: (r.name, r.score) for r in resolution.fuzzy_ratio(a, "w", b, "name", 0.7).collect()}
    for w in wanted:
        score, name = max(((difflib.SequenceMatcher(None, w, n).ratio(), n) for n in names), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        assert found.get(w) == ((name, score) if score >= 0.7 else None)


def test_merge_duplicates(spark):
    rows = [("k", 2, ["B", "c"], "late"), ("k", 1, ["a", "b", "A"], None), ("z", 3, [], "z")]
    frame = spark.createDataFrame(rows, "cid string, o int, al array<string>, d string")
    found = {r.cid: r for r in etl.merge_duplicates(frame, "cid", "o", ["al"], ["d"]).collect()}
    assert found["k"].al == ["a", "b", "c"]
    assert (found["k"].d, found["k"].merged, found["z"].al) == ("late", 2, [])


def test_merge_duplicates_of_one_large_key(spark):
    frame = spark.range(40_000).select(F.lit("k").alias("cid"), F.col("id").alias("o"), F.array(F.concat(F.lit("Al"), F.col("id") % 20_000)).alias("al"), F.lit("d").alias("d"))
    frame = frame.unionByName(frame.where("o = 7").select(F.lit(None).cast("string").alias("cid"), "o", F.array(F.lit("b"), F.lit(None), F.lit("B")).alias("al"), "d"))
    plan = etl.merge_duplicates(frame, "cid", "o", ["al"], ["d"])
    found = {r.cid: r for r in plan.collect()}
    assert found["k"].al == [f"Al{i}" for i in range(20_000)] and found["k"].merged == 40_000
    assert found[None].al == ["b"] and found[None].merged == 1
    # No key's list is searched for each of its elements: values are grouped before.
    assert "array_position" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_preferred_version_of_equal_lengths(spark):
    from corpusgraph.plans import catalogue
    from tests.duck import assert_same, connect

    docs = [(3 + 60 * i, lang, n) for i, (lang, n) in enumerate([("es", 9), ("en", 9), ("en", 9), ("es", 11), ("fr", 4), ("de", 7), ("de", 6), ("fr", 4)])]
    # Ids that outweigh a difference of lengths, as the SQL has it.
    docs += [(600_004, "de", 100), (4, "de", 97), (64, "fr", 5), (124, "en", 5), (600_064, "es", 6), (184, None, 5)]
    frame = spark.createDataFrame(docs, "doc_id long, lang string, n_chars long")
    folder = tables.workspace(spark)
    frame.write.parquet(f"{folder}/documents.parquet")
    assert_same(catalogue.QUERIES["w04_preferred_version"](spark, folder), catalogue.SQL["w04_preferred_version"], connect(None, documents=frame.toPandas()))


def test_interval_join_of_one_cell_is_many_tasks(spark):
    points = spark.range(4000).select(F.col("id").alias("x"), F.lit(1).alias("k"), (F.col("id") % 7).cast("int").alias("at"))
    ranges = spark.range(60).select(F.col("id").alias("r"), F.lit(1).alias("k"), (F.col("id") % 5).cast("int").alias("lo"), (F.col("id") % 5 + 2).cast("int").alias("hi"))
    joined = relational.interval_join(points, "at", ranges, "lo", "hi", ["k"], 8)
    assert sorted(joined.columns) == ["at", "hi", "k", "lo", "r", "x"]
    wanted = sum(r % 5 <= x % 7 <= r % 5 + 2 for x in range(4000) for r in range(60))
    found = joined.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in found) == wanted == joined.select("x", "r").distinct().count()
    assert len(found) >= 8 and max(r["count"] for r in found) < wanted / 3


def test_pages(spark):
    frame = spark.range(45).withColumnRenamed("id", "x")
    rows = relational.page(frame, [F.asc("x")], 3).collect()
    assert [r.x for r in rows] == list(range(40, 45))
    assert {(r.total, r.pages) for r in rows} == {(45, 3)}


def test_order_must_be_allowed(spark):
    with pytest.raises(ValueError):
        ordering.chosen("secret", ("a",), "id")


def test_at_most(spark):
    assert relational.at_most(spark.range(5), 5).count() == 5
    with pytest.raises(relational.TooManyRows):
        relational.at_most(spark.range(6), 5)


def test_sql_functions(spark):
    from corpusgraph.functions import sql

    sql.register(spark)
    row = spark.sql(
        "SELECT fold_accents('João'), alias_key('1 Coríntios'), cosine_similarity(array(1D, 0D), array(1D, 1D)), "
        "cosine_similarity(array(0D), array(1D)), rrf_score(1, NULL, 60, 0.7D)"
    ).first()
    assert row[:2] == ("joao", "1corintios")
    assert abs(row[2] - 0.5**0.5) < 1e-12 and row[3] == 0 and abs(row[4] - 0.7 / 61) < 1e-12


def nearest(x, ids, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return sorted((q, i) for q in queries for i in sorted(ids, key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:k])


def test_knn_join_of_many_equal_vectors_in_any_order(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x[40:240] = x[40] * np.linspace(0.1, 9, 200)[:, None]
    rows = [(i, x[i].tolist()) for i in range(300)]
    queries = spark.createDataFrame([rows[i] for i in (0, 45, 299)], "q long, v array<double>")
    for shown in (rows, rows[::-1], [rows[i] for i in rng.permutation(300)]):
        frame = spark.createDataFrame(shown, "id long, v array<double>").coalesce(1)
        found = retrieval.knn_join(queries, "q", frame, "id", "v", 5).collect()
        assert sorted((r.q, r.id) for r in found) == nearest(x, range(300), (0, 45, 299), 5)


def test_knn_join_of_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 7)
    x = np.random.default_rng(6).normal(size=(90, 5))
    x[30:60] = x[30]
    frame = spark.createDataFrame([(i, x[i].tolist()) for i in range(90)], "id long, v array<double>").repartition(3)
    queries = frame.where("id % 4 = 0").withColumnRenamed("id", "q")
    found = retrieval.knn_join(queries, "q", frame, "id", "v", 6)
    assert sorted((r.q, r.id) for r in found.collect()) == nearest(x, range(90), range(0, 90, 4), 6)
    assert found.columns == ["q", "id", "similarity"]
    assert retrieval.knn_join(queries.limit(0), "q", frame, "id", "v", 6).count() == 0


def test_numbered_and_percentiles_of_large_groups(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, rng.choice("aaaaaab"), rng.choice([1.0, 2.0, rng.random() * 9])) for i in range(3000)]
    rows += [(3000, "one", 4.0), (3001, None, 5.0), (3002, None, 7.0), (3003, "none", None), (3004, "a", None)]
    frame = spark.createDataFrame(rows, "id long, g string, x double").repartition(3)
    places = {r.id: r.place for r in ordering.numbered(frame, [F.desc_nulls_last("x"), F.asc("id")], "place").collect()}
    wanted = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert places == {r[0]: k + 1 for k, r in enumerate(wanted)}

    def quantile(xs, p):
        at = min(max(p * (len(xs) + 1), 1), len(xs))
        return xs[int(at) - 1] + (xs[min(int(at) + 1, len(xs)) - 1] - xs[int(at) - 1]) * (at - int(at))

    groups = {g: sorted(x for _, h, x in rows if h == g and x is not None) for g in {r[1] for r in rows}}
    for few in (10_000, 1000):  # looked at whole, and by brackets
        monkeypatch.setattr(analytics, "FEW", few)
        found = {r.g: (r.low, r.p50, r.p95) for r in analytics.exclusive_percentiles(frame, "g", "x", {"low": 0.001, "p50": 0.5, "p95": 0.95}).collect()}
        assert found == {g: tuple(pytest.approx(quantile(xs, p)) if xs else None for p in (0.001, 0.5, 0.95)) for g, xs in groups.items()}


def test_quantiles_keep_few_rows_of_large_groups(spark):
    frame = spark.range(200_000).select(F.lit("g").alias("g"), F.randn(3).alias("x"))
    xs = sorted(r.x for r in frame.collect())
    found = analytics.exclusive_percentiles(frame, "g", "x", {"p50": 0.5, "p95": 0.95})
    row = found.first()
    at = 0.95 * 200_001
    assert row.p50 == pytest.approx((xs[99_999] + xs[100_000]) / 2, abs=1e-12)
    assert row.p95 == pytest.approx(xs[int(at) - 1] + (xs[int(at)] - xs[int(at) - 1]) * (at - int(at)), abs=1e-12)


@pytest.mark.parametrize("name", ["w01_rank", "t01_multi_key_sort"])
def test_no_task_gathers_a_table(spark, name):
    from corpusgraph.plans import catalogue
    from tests.conftest import SMALL

    plan = catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "row_number" not in plan
    assert "SinglePartition" not in plan or "_range" in plan.split("SinglePartition")[1][:400]


def test_cascade_with_fuzzy_ratio(spark):
    from corpusgraph.operators.resolution import cascade, fuzzy_ratio

    names = spark.createDataFrame([("moses", 1), ("abraham", 2), ("abraham", 3)], "name string, id long")
    wanted = spark.createDataFrame([("moses",), ("abrahem",), ("lawgiver",), ("zzz",)], "w string")
    tiers = [("exact", 1.0, names.withColumnRenamed("name", "w")), ("alias", 0.95, spark.createDataFrame([("lawgiver", 1)], "w string, id long"))]
    found = {r.w: (r.id, r.method, round(r.confidence, 3)) for r in cascade(wanted, "w", tiers, "id", [("fuzzy", names)], "name", 0.85, fuzzy_ratio).collect()}
    assert found == {"moses": (1, "exact", 1.0), "abrahem": (2, "fuzzy", 0.857), "lawgiver": (1, "alias", 0.95), "zzz": (None, "unmatched", 0.0)}


def test_numbered_in_groups(spark):
    from pyspark.sql import functions as F

    from corpusgraph.operators.ordering import numbered_in

    rows = [(i, "ab"[i % 3 == 0] if i % 7 else None, (i * 37) % 11) for i in range(200)]
    found = {r.i: r.n for r in numbered_in(spark.createDataFrame(rows, "i long, g string, v long"), "g", [F.asc("v"), F.asc("i")], "n").collect()}
    for g in ("a", "b", None):
        own = sorted((v, i) for i, h, v in rows if h == g)
        assert [found[i] for _, i in own] == list(range(1, len(own) + 1))


def test_texts_are_split_once_a_pass(spark):
    """BM25 splits in the pass for the statistics and in that for the scores, proximity once."""
    from corpusgraph.plans import catalogue

    for name, most in (("v05_bm25", 2), ("f18_proximity", 1)):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") <= most, plan


def test_kendall_tau_refuses_long_lists(spark, monkeypatch):
    from corpusgraph.operators import evaluation
    from corpusgraph.operators.relational import TooManyRows

    monkeypatch.setattr(evaluation, "MOST_RANKED", 3)
    with pytest.raises(TooManyRows):
        evaluation.kendall_tau(spark.range(5).selectExpr("id", "id AS a", "-id AS b"), "id", "a", "b")


def test_resolve_references(spark):
    from corpusgraph.operators.resolution import resolve_references

    names = [("songofsongs", 1, "SNG"), ("canticos", 2, "SNG"), ("1reis", 1, "1KI"), ("jo", 1, "JHN"), ("jo", 2, "JOB"), ("1co", 1, "1CO")]
    aliases = spark.createDataFrame(names, "key string, priority int, book string")
    books = spark.createDataFrame([("SNG", 8), ("1KI", 22), ("JHN", 21), ("1CO", 16)], "book string, chapters int")
    texts = spark.createDataFrame([(1, "Jo 3:16-18;1Co 13"), (2, "Cânticos 2; 1 Reis 4:2；Song of Songs 9:1"), (3, "?? ; Nobody 1:1"), (4, None), (5, "")], "i int, s string")
    found = {(r.i, r.place): (r.book, r.chapter, r.verse, r.end_verse, r.status) for r in resolve_references(texts, "i", "s", aliases, books).collect()}
    assert found == {
        (1, 0): ("JHN", 3, 16, 18, "ok"), (1, 1): ("1CO", 13, None, None, "ok"), (2, 0): ("SNG", 2, None, None, "ok"), (2, 1): ("1KI", 4, 2, 2, "ok"),
        (2, 2): ("SNG", 9, 1, 1, "chapter_out_of_range"), (3, 0): (None, None, None, None, "unparsed"), (3, 1): (None, 1, 1, 1, "book_not_found"),
    }


def test_each_rule_of_blocks(spark):
    from corpusgraph.operators import blocks

    rows = [
        ("d", 0, "a", "heading", '{"text":"t","level":7}'),
        ("d", 1, "a", "divider", None),
        ("d", 2, None, "paragraph", None),
        ("d", 3, "b", None, "{}"),
        ("d", 4, "c", "sidebar", "{}"),
        ("d", 5, "e", "divider", '{"style":"star"}'),
        ("d", 6, "f", "crossref_network", '{"verse":1,"layout":"web"}'),
        ("d", 7, "g", "paragraph", "[1]"),
        ("d", 8, "h", "callout", '{"style":"","html":"x"}'),
        ("d", 9, "i", "comparison_table", '{"headers":["x","y"],"rows":[["1"]]}'),
        ("d", 10, "j", "reference_table", '{"refs":[{"to":"x"}]}'),
        ("other", 0, "a", "divider", "{}"),
    ]
    table = spark.createDataFrame(rows, "doc string, at int, id string, type string, data string")
    found = sorted((r["at"], r["problem"]) for r in blocks.invalid(table, "doc", "at", "id", "type", "data").collect())
    assert found == [
        (0, "bad_value:level"), (1, "duplicate_id"), (2, "missing_data"), (2, "missing_id"), (3, "missing_type"), (4, "unknown_type"),
        (5, "bad_value:style"), (6, "bad_value:layout"), (6, "missing_field:connections"), (7, "data_not_an_object"),
        (9, "uneven_rows"), (10, "missing_field:refs.ref"),
    ]
    assert blocks.invalid(table.limit(0), "doc", "at", "id", "type", "data").count() == 0


def test_kinds_of_queries_by_the_first_rule(spark):
    from corpusgraph.operators import expansion

    names = spark.createDataFrame([("moses", 2.0), ("sea_of_galilee", 3.0)], "name string, boost double")
    texts = ["John 3:16", "near the sea of galilee", "who walked?", "moses went up", "grace", "moses", "boat", "", "still waters"]
    asked = spark.createDataFrame(list(enumerate(texts)), "id int, q string")
    found = expansion.analysed(asked, "id", "q", names, stop=("the",), concepts=("grace",), phrases=("still_waters",)).orderBy("id").collect()
    assert [r["kind"] for r in found] == ["reference", "entity", "question", "phrase", "concept", "entity", "keyword", "keyword", "phrase"]
    assert [r["expand"] for r in found] == [False, False, True, True, True, False, True, False, False]
    assert [r["distance"] for r in found][:2] == [1, 2] and [r["entities"] for r in found][:4] == [0, 1, 0, 1]


def test_only_the_hits_vectors_are_scored(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(500)], "id long, v array<double>").repartition(4)
    hits = spark.createDataFrame([(3, 0.5), (400, 0.4), (9999, 0.3)], "id long, score double")
    found = retrieval.rerank(hits, "id", "score", vectors, "v", [0.0, 1.0], 10)
    assert [r.id for r in found.orderBy("new_rank").collect()] == [3, 9999, 400]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    cosine, inner = plan.index("AS near"), plan.index("Join Inner")
    assert cosine < inner and "rightHint=(strategy=broadcast)" in plan[inner : inner + 80]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def name_tables(spark, n, seed):
    """Random names, and others made of some of them by edits."""
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 22))) for _ in range(n)]
    wanted = []
    for name in names[: n // 2]:
        letters = list(name)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randrange(2)] = rng.choice(["", "x", "a", "ab"])
        wanted.append("".join(letters))
    wanted += ["", "a", "zzzz"]
    return names, wanted, spark.createDataFrame([(x,) for x in [*wanted, None]], "w string"), spark.createDataFrame([(x,) for x in [*names, "", None]], "name string")


@pytest.mark.parametrize("least", [0.5, 0.7, 0.85])
def test_fuzzy_names_against_all_pairs(spark, least):
    names, wanted, a, b = name_tables(spark, 160, 3)
    for operator, score in (
        (resolution.fuzzy, lambda w, n: 1 - edit_distance(w, n) / max(len(w), len(n))), (resolution.fuzzy_ratio, lambda w, n: difflib.SequenceMatcher(None, w, n).ratio()),
    ):
        found = {r.w: (r.name, pytest.approx(r.score)) for r in operator(a, "w", b, "name", least).collect()}
        plain = {}
        for w in filter(None, wanted):
            best = min((-score(w, n), n) for n in names)
            if -best[0] >= least:
                plain[w] = (best[1], -best[0])
        assert plain == found and len(plain) > 30


def test_candidates_of_names_grow_with_the_names(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(10, 18))) for _ in range(4000)]
    sizes = []
    for n in (400, 4000):
        frame = spark.createDataFrame([(x,) for x in made[:n]], "name string")
        wanted = spark.createDataFrame([(x[:4] + "z" + x[5:],) for x in made[:n]], "w string")
        sizes.append(resolution.candidates(wanted, "w", frame, "name", 0.85, resolution._edits(0.85)).count())
    assert 400 <= sizes[0] < 4 * 400 and sizes[1] < 20 * sizes[0]


def test_cascade_of_fuzzy_tiers(spark):
    entities = spark.createDataFrame([("abraham", 2), ("moses", 1)], "name string, id long")
    people = spark.createDataFrame([("abrahan", 9), ("jerome", 7), ("jerome", 8)], "name string, id long")
    wanted = spark.createDataFrame([("abrahem",), ("jeromme",), ("moses",), ("xx",)], "w string")
    tiers = [("exact", 1.0, entities.withColumnRenamed("name", "w"))]
    out = resolution.cascade(wanted, "w", tiers, "id", [("fuzzy", entities), ("fuzzy_person", people)])
    assert {r.w: (r.id, r.method, round(r.confidence, 3)) for r in out.collect()} == {
        "abrahem": (2, "fuzzy", 0.857), "jeromme": (7, "fuzzy_person", 0.923), "moses": (1, "exact", 1.0), "xx": (None, "unmatched", 0.0),
    }


def test_words_are_looked_for_in_texts_that_may_have_them(spark):
    frame = spark.createDataFrame([(1, "The one, with all of THAT."), (2, "there withthat"), (3, None), (4, ""), (5, "the with")], "id int, body string")
    found = frame.select("id", retrieval.all_in_text("body", ["the", "with", "that"]).alias("every"), retrieval.any_in_text("body", ["with", "x"]).alias("some"))
    assert {r.id: (r.every, r.some) for r in found.collect()} == {1: (True, True), 2: (False, False), 3: (False, False), 4: (False, False), 5: (False, True)}


def test_units_of_too_many_themes_are_an_error(spark, monkeypatch):
    links = spark.createDataFrame([(1, t) for t in "abc"] + [(2, "a"), (2, "b")], "unit int, theme string")
    assert analytics.cooccurrence(links, "unit", "theme").count() == 6
    monkeypatch.setattr(analytics, "MOST_THEMES", 2)
    with pytest.raises(Exception, match="more than 2 themes"):
        analytics.cooccurrence(links, "unit", "theme").count()


def test_heading_levels_are_numbers(spark):
    from corpusgraph.operators import blocks

    rows = [(1, 1, "a", "heading", '{"text": "t", "level": 1}'), (1, 2, "b", "heading", '{"text": "t", "level": "1"}'), (1, 3, "c", "heading", '{"text": "t", "level": 4}')]
    frame = spark.createDataFrame(rows, "doc int, at int, id string, kind string, data string")
    assert sorted(map(tuple, blocks.invalid(frame, "doc", "at", "id", "kind", "data").collect())) == [(1, 2, "bad_value:level"), (1, 3, "bad_value:level")]
