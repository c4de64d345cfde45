"""Tables of wishes: what they have in common is done once."""

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import experiments, lexical, nearest, retrieval
from corpusgraph.plans import catalogue, indexes
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, f"{'red' if i % 2 else 'blue'} {'sky ' * (i % 3)} word{i}") for i in range(30)], "id long, text string")
    vectors = spark.createDataFrame([(i, [float(i % 5 == j) + 0.01 * i for j in range(5)]) for i in range(25)], "id long, v array<float>")
    queries = spark.createDataFrame([(1, "red", "sky", [1.0, 0.0, 0.0, 0.0, 0.0]), (2, "word7", "blue", [0.0, 0.0, 1.0, 0.0, 0.0])], "q int, text string, more string, v array<float>")
    return docs, vectors, queries


def test_lists_are_made_once_for_all_configurations(spark, tables, monkeypatch):
    docs, vectors, queries = tables
    calls = []
    for module, name in ((lexical, "top_k"), (nearest, "search_exactly")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name, **b: (calls.append(n), f(*a, **b))[1])
    schema = "config string, alpha double, expand boolean, rerank boolean, source string, mmr double"
    settings = [(f"c{i}", i / 11, i % 2 == 0, i % 3 == 0, "whole", 0.5 if i % 4 == 0 else None) for i in range(12)]
    wishes = experiments.grid(spark.createDataFrame(settings, schema), queries, "q")
    index = lexical.build(docs, "id", "text")
    texts = experiments.lexical_lists(index, wishes, queries, "q", "text", "more", 20)
    near = experiments.vector_lists({"whole": (nearest.build(vectors, "id", "v"), queries)}, "q", "v", 20)
    found = experiments.answers(wishes, "q", "id", texts, near, vectors, "v", queries, 5)
    assert calls == ["top_k", "search_exactly"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "postings" not in plan and "_wishes" not in plan
    rows = found.collect()
    assert {r.wish for r in rows} == {f"c{i}/{q}" for i in range(12) for q in (1, 2)}
    assert all(sorted(r.place for r in rows if r.wish == w) == list(range(1, 6)) for w in {r.wish for r in rows})


def test_a_wish_is_answered_as_alone(spark, tables):
    docs, vectors, queries = tables
    schema = "config string, alpha double, expand boolean, rerank boolean, source string, mmr double"
    wishes = experiments.grid(spark.createDataFrame([("a", 0.6, False, False, "whole", None), ("b", 0.3, True, False, "whole", None)], schema), queries, "q")
    texts = experiments.lexical_lists(lexical.build(docs, "id", "text"), wishes, queries, "q", "text", "more", 20)
    near = experiments.vector_lists({"whole": (nearest.build(vectors, "id", "v"), queries)}, "q", "v", 20)
    found = experiments.answers(wishes, "q", "id", texts, near, vectors, "v", queries, 8)
    for q, text, vector in ((1, "red", [1.0, 0.0, 0.0, 0.0, 0.0]), (2, "word7", [0.0, 0.0, 1.0, 0.0, 0.0])):
        alone = retrieval.hybrid(docs, vectors, "id", "text", "v", [text], vector, pool=20, k=8, alpha=0.6)
        wanted = [(r.id, round(r.final_score, 9)) for r in alone.orderBy("place").collect()]
        assert [(r.id, round(r.score, 9)) for r in found.where(F.col("wish") == f"a/{q}").orderBy("place").collect()] == wanted


def test_twelve_configurations(spark):
    rows = catalogue.QUERIES["v24_experiments"](spark, SMALL).collect()
    assert {r.config for r in rows} == {c[0] for c in indexes.CONFIGURATIONS} and len(indexes.CONFIGURATIONS) == 12


def test_requests_are_clamped(spark):
    schema = "q int, text string, mode string, alpha double, k int, expand boolean, rerank boolean, source string, mmr double, min_score double"
    rows = [(1, "a", "vector", 0.9, 0, None, None, "s", None, None), (2, "b", "lexical", None, 99, True, None, "s", 0.5, 0.2), (3, " ", "hybrid", None, 5, None, None, "s", None, None), (4, "d", None, 7.0, None, None, True, "s", None, None)]
    found = {r.q: (r.alpha, r.k, r.expand, r.rerank, r.least) for r in experiments.requested(spark.createDataFrame(rows, schema), "q", "text").collect()}
    assert found == {1: (0.0, 1, False, False, 0.0), 2: (1.0, 50, True, False, 0.2), 4: (1.0, 10, False, True, 0.0)}


def test_answers_carry_fields(spark, tables):
    docs, _, queries = tables
    hits = spark.createDataFrame([("1", 7, 0.91234, 1), ("1", 99, 0.5, 2), ("1", 8, 0.05, 3), ("2", 7, 0.4, 1)], "wish string, id long, score double, place int")
    wishes = spark.createDataFrame([("1", 1, 10, 0.1), ("2", 2, 1, 0.0)], "wish string, q int, k int, least double")
    found = experiments.served(hits, wishes, docs.withColumn("lang", F.lit("en")), "id", "text", ["lang"], queries, "q", "text").collect()
    assert sorted((r.q, r.place, r.id, r.score, r.lang, r.contains) for r in found if r.lang) == [(1, 1, 7, 0.9123, "en", True), (2, 1, 7, 0.4, "en", True)]
    assert [(r.q, r.id, r.contains) for r in found if r.lang is None] == [(1, 99, False)]
