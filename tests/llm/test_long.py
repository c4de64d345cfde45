"""Texts of a megabyte of every awkward kind, among null and empty ones."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import gam, joins, lines, mixing, packing, passages, rules, suffixes
from tests.llm.conftest import prose

N = 1_000_000


@pytest.fixture(scope="module")
def kinds():
    long = prose(random.Random(1), N // 6)
    return {
        1: long, 2: long + " end", 3: " " * N, 4: "x" * N, 5: "same phrase again " * (N // 18), 6: "\n" * N, 7: "\n".join(f"line {i % 977}" for i in range(N // 10)), 8: None, 9: "",
        10: prose(random.Random(2), 80),
    }


@pytest.fixture(scope="module")
def long(spark, kinds):
    rows = [(i, t, "en", "s", None if t is None else len(t), i) for i, t in kinds.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long").repartition(4).cache()


def test_statistics_and_rules(spark, long, kinds):
    found = {r.doc_id: r.s for r in long.select("doc_id", rules.statistics(F.col("text")).alias("s")).collect()}
    assert all(found[i].n_words == len((t or "").split()) for i, t in kinds.items())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {1, 2, 10} <= {r.doc_id for r in rules.filter_quality(long, none).select("doc_id").collect()} <= {1, 2, 4, 10}


def test_lines(long, kinds):
    found = {r.doc_id: (r.line_stats.n_lines, r.line_stats.n_dropped) for r in lines.dedup_lines(long).collect()}
    assert found == {i: ((t or "").count("\n") + 1, 0) for i, t in kinds.items()}


def test_near_copies_and_passages(long):
    assert {r.doc_id for r in joins.drop_near_copies(long).select("doc_id").collect()} == {1, 3, 4, 5, 6, 7, 8, 9, 10}
    found = {r.doc_id: r.text for r in passages.drop_passages(long).collect()}
    assert len(found) == 10 and len(found[2]) < 100 and len(found[1]) > N // 2


def test_repeated_strings(spark, kinds, tmp_path):
    """Of one letter, of one phrase and of blank lines nearly every byte is covered by a string that also starts elsewhere."""
    some = {i: (t if t is None else t[: N // 10]) for i, t in kinds.items()}
    spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in suffixes.op3_suffix_dedup(spark, str(tmp_path)).collect()}
    assert all(found[i].n_removed == len(some[i]) and found[i].n_spans == 1 for i in (1, 3, 4, 5, 6))
    assert found[8].n_bytes == 0 and found[10].n_removed == 0
    assert found[10].kept_sha256 == hashlib.sha256(some[10].encode()).hexdigest()


def test_scores_and_languages(spark, long):
    model = gam.learn(long, spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int"))
    assert gam.score(long, model).where("score BETWEEN 0 AND 1").count() == 10
    assert long.count() == 10


def test_mix_and_pack(long, kinds):
    mixed = {r.doc_id: r.mix.size for r in mixing.mix_sources(long).collect()}
    assert mixed == {i: len((t or "").split()) for i, t in kinds.items()}
    packed = packing.pack(long, packing.vocabulary_encoder()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(packed) == 10 and all(r.n == r["all"] for r in packed)
