"""Stored indexes against exhaustive searches."""

import collections
import math
import random
import re

import numpy as np
import pytest

from corpusgraph.operators import lexical, nearest
from corpusgraph.plans import catalogue
from tests.conftest import SMALL

WORDS = [a + b for a in ("ba", "ko", "du", "fe", "gi") for b in ("na", "le", "mi", "no")]


def plain_bm25(rows, wish, every):
    docs = {i: re.findall(r"\w+", (text or "").lower()) for i, text, _ in rows}
    n, mean = len(docs), sum(map(len, docs.values())) / max(1, len(docs)) or 1
    df = collections.Counter(w for ts in docs.values() for w in set(ts))
    terms = set(re.findall(r"\w+", wish.lower()))
    out = []
    for i, ts in docs.items():
        tf = collections.Counter(ts)
        met = [w for w in terms if tf[w]]
        if met and (not every or len(met) == len(terms)):
            out.append((-round(sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ts) / mean)) for w in met), 9), i))
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts in which some words are in nearly all and some in few, with repeated and missing ones."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        words = [WORDS[min(int(rng.expovariate(0.25)), len(WORDS) - 1)] for _ in range(rng.randrange(1, 60))]
        rows.append((i * 7 - 50, " ".join(words) if i % 50 else None, "ab"[i % 2]))
    rows += [(10_000 + i, "bana bana bale rare", "a") for i in range(300)] + [(20_000, "", None), (20_001, "Rare! only_here", None)]
    return rows, spark.createDataFrame(rows, "id long, text string, lang string").repartition(3)


@pytest.mark.parametrize("every", [False, True])
def test_best_texts_are_those_of_an_exhaustive_search(spark, corpus, every, tmp_path):
    rows, docs = corpus
    rng = random.Random(9)
    wishes = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 6)))) for i in range(25)]
    wishes += [(100, "rare bana"), (101, "unknown words"), (102, ""), (103, "RARE unknown"), (104, "only_here rare rare")]
    queries = spark.createDataFrame(wishes, "q int, wish string")
    index = lexical.build(docs, "id", "text", str(tmp_path / "index"), like=("lang",))
    found = collections.defaultdict(list)
    for r in lexical.top_k(index, queries, "q", "wish", 30, every).orderBy("q", "place").collect():
        found[r.q].append((-round(r.bm25, 9), r.id))
    for q, wish in wishes:
        assert found[q] == plain_bm25(rows, wish, every)[:30], wish


def scans(frame):
    """Files that the scans of a run frame have read."""
    plan = frame._jdf.queryExecution().executedPlan()
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    out, todo = [], [plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            out.append(node.metrics().apply("numFiles").value())
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_only_the_terms_folders_are_read(spark, corpus, tmp_path):
    rows, docs = corpus
    index = lexical.build(docs, "id", "text", str(tmp_path / "index"), buckets=16)
    folders = len({p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("bucket=")})
    assert folders > 10
    one = spark.createDataFrame([(1, "rare")], "q int, wish string")
    asked = lexical.ask(index, one, "q", "wish")
    read = scans(asked.blocks)
    files = len(list((tmp_path / "index").rglob("*.parquet")))
    assert len(read) == 1 and 0 < read[0] <= 2 * files / folders


def test_ranges_that_cannot_reach_the_best_are_left_out(spark, corpus, tmp_path):
    _, docs = corpus
    index = lexical.build(docs, "id", "text", str(tmp_path / "index"), like=("lang",))
    queries = spark.createDataFrame([(1, "only_here rare bana"), (2, "bale gino")], "q int, wish string")
    asked = lexical.ask(index, queries, "q", "wish")
    every, kept = asked.bounds.count(), lexical.promising(asked, "q", 5).count()
    assert 0 < kept < every / 2


def test_small_parts_of_a_table_give_the_same_best_texts(spark, corpus, tmp_path, monkeypatch):
    rows, docs = corpus
    queries = spark.createDataFrame([(1, "rare bana"), (2, "bale gino only_here")], "q int, wish string")
    for name, value in {"TOKENS": 70, "ROWS": 50}.items():
        monkeypatch.setattr(lexical, name, value)
    index = lexical.build(docs.coalesce(1), "id", "text", str(tmp_path / "index"), like=("lang",))
    found = collections.defaultdict(list)
    for r in lexical.top_k(index, queries, "q", "wish", 30).orderBy("q", "place").collect():
        found[r.q].append((-round(r.bm25, 9), r.id))
    for q, wish in [(1, "rare bana"), (2, "bale gino only_here")]:
        assert found[q] == plain_bm25(rows, wish, False)[:30]


def test_building_sorts_neither_texts_nor_postings(spark, corpus, tmp_path):
    store = spark._jsparkSession.sparkContext().statusStore()
    jobs = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    before = jobs().size()
    lexical.build(corpus[1], "id", "text", str(tmp_path / "index"), like=("lang",))
    stages = [jobs().apply(i) for i in range(jobs().size() - before)]
    written = [s for s in stages if s.outputRecords() > 0]
    assert written and all(s.peakExecutionMemory() == 0 for s in written)


def test_building_splits_texts_once_and_spills_nothing(spark, corpus, tmp_path, monkeypatch):
    used, conf = [], type(spark.conf)
    put = conf.set
    monkeypatch.setattr(conf, "set", lambda self, key, value: (used.append((key, value)), put(self, key, value))[1])
    split, tokens = [], lexical.t.tokens
    monkeypatch.setattr(lexical.t, "tokens", lambda text: (split.append(text), tokens(text))[1])
    index = lexical.build(corpus[1], "id", "text", str(tmp_path / "index"), buckets=16)
    # Spark sorts what is left of a task's rows, in memory that no figure of a stage has, when as many writers are open as it allows.
    assert max(int(value) for key, value in used if key == "spark.sql.maxConcurrentOutputFileWriters") > 16
    assert len(split) == 1
    lengths = [len(re.findall(r"\w+", (text or "").lower())) for _, text, _ in corpus[0]]
    assert index.mean == sum(lengths) / len(lengths)


def test_bounds_are_reached_by_terms_of_one_text(spark, corpus, tmp_path):
    index = lexical.build(corpus[1], "id", "text", str(tmp_path / "index"))
    own = lexical.F.transform("postings", lambda x: index.part(x["tf"], x["dl"]))
    rows = index.blocks.select("n", index.top(lexical.F.col("most"), lexical.F.col("share")), lexical.F.array_max(own)).collect()
    assert all(top >= best - 1e-12 for _, top, best in rows) and all(abs(top - best) < 1e-12 for n, top, best in rows if n == 1)
    assert sum(top - best < 1e-12 for _, top, best in rows) > len(rows) / 2


def test_tasks_grow_with_the_postings_that_are_added_up(spark, corpus, tmp_path, monkeypatch):
    index = lexical.build(corpus[1], "id", "text", str(tmp_path / "index"))
    asked = lexical.ask(index, spark.createDataFrame([(1, "rare bana bale")], "q int, wish string"), "q", "wish")
    monkeypatch.setattr(lexical, "ROWS", 20)
    assert lexical.scores(asked, "q", asked.bounds).rdd.getNumPartitions() >= asked.bounds.agg({"rows": "sum"}).first()[0] / 20


def test_empty_tables(spark, corpus, tmp_path):
    _, docs = corpus
    none = lexical.build(docs.limit(0), "id", "text", str(tmp_path / "none"))
    queries = spark.createDataFrame([(1, "rare")], "q int, wish string")
    assert lexical.top_k(none, queries, "q", "wish", 5).count() == 0
    some = lexical.build(docs, "id", "text", str(tmp_path / "some"))
    assert lexical.top_k(some, queries.limit(0), "q", "wish", 5).count() == 0


def clustered(n, seed=0):
    """Vectors around a few directions, a third of them one and the same, and some of zeros."""
    rng = np.random.default_rng(seed)
    around = rng.normal(size=(12, 16))
    rows = around[rng.integers(0, 12, n)] * rng.uniform(0.5, 3, (n, 1)) + rng.normal(size=(n, 16)) * 0.3
    rows[::3] = rows[:1]
    rows[5::97] = 0
    return [(int(i) * 3 - 40, [float(np.float32(x)) for x in row]) for i, row in enumerate(rows)]


def plain_nearest(rows, wish, k):
    x = np.array([v for _, v in rows]).reshape(-1, 16)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    q = np.array(wish) / max(np.linalg.norm(wish), 1e-300)
    near = np.round(x @ q, 9)
    return sorted((-float(s), i) for s, (i, _) in zip(near, rows, strict=True))[:k]


@pytest.mark.parametrize("n", [0, 1, 7, 2500])
def test_exactly_the_nearest_are_found(spark, tmp_path, n):
    rows = clustered(n)
    vectors = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    wishes = [(q, v) for q, (_, v) in enumerate(clustered(40, 1))]
    queries = spark.createDataFrame(wishes, "q int, v array<float>")
    index = nearest.build(vectors, "id", "v", str(tmp_path / "index"))
    found = collections.defaultdict(list)
    for r in nearest.search_exactly(index, queries, "q", "v", 6).collect():
        found[r.q].append((-round(r.similarity, 9), r.id))
    for q, v in wishes:
        assert [s for s, _ in sorted(found[q])] == pytest.approx([s for s, _ in plain_nearest(rows, v, 6)], abs=2e-9)
        assert len({i for _, i in found[q]}) == min(6, n)


def test_probing_finds_nearly_all_and_reads_few_lists(spark, tmp_path):
    rows = clustered(2500)
    vectors = spark.createDataFrame(rows, "id long, v array<float>")
    queries = spark.createDataFrame([(q, v) for q, (_, v) in enumerate(rows[1::120])], "q int, v array<float>")
    index = nearest.build(vectors, "id", "v", str(tmp_path / "index"))
    exact = nearest.search_exactly(index, queries, "q", "v", 10)
    assert len(index.centers) == 50 and index.probes < 30
    assert nearest.recall(nearest.search(index, queries, "q", "v", 10), exact, "q", "id").first()["recall"] >= 0.9
    least = exact.groupBy("q").agg({"similarity": "min"}).withColumnRenamed("min(similarity)", "_least")
    assert nearest._probes(index, queries.join(least, "q"), "q", "v", None).count() < 21 * 50 / 2


def test_queries_of_lists_are_not_sent_through_the_driver(spark, tmp_path):
    rows = clustered(1200)
    vectors = spark.createDataFrame(rows, "id long, v array<float>")
    queries = spark.createDataFrame([(q, v) for q, (_, v) in enumerate(rows[1::40])], "q int, v array<float>")
    index = nearest.build(vectors, "id", "v", str(tmp_path / "index"))
    found = nearest.search_exactly(index, queries, "q", "v", 5)
    wanted = {q: plain_nearest(rows, v, 5) for q, (_, v) in enumerate(rows[1::40])}
    assert len(found.collect()) == 5 * len(wanted)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    # Of each block only what reaches the known similarity is left, not k rows of every block.
    least = spark.createDataFrame([(q, v, -near[-1][0] - 1e-9) for (q, near), (_, v) in zip(wanted.items(), rows[1::40], strict=True)], "q int, v array<float>, _least double")
    left = nearest._searched(index, nearest._probes(index, least, "q", "v", None), "q", len(wanted), 5)
    assert left.where("_rounded < -1").count() == 0 and left.join(least.select("q", "_least"), "q").where("_rounded < _least - 1e-9").count() == 0


def test_recall_over_the_whole_table(spark):
    assert catalogue.QUERIES["v02_ivf_recall"](spark, SMALL).first()["recall"] >= 0.9
