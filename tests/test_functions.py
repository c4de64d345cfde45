import math
import random

from pyspark.sql import functions as F

from corpusgraph.functions import references as ref
from corpusgraph.functions import text as t
from corpusgraph.functions import vectors as v
from corpusgraph.operators import analytics


def one(spark, *columns, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(*columns).first()


def test_fold_and_keys(spark):
    row = one(spark, t.fold(F.col("s")), t.ascii_key(F.col("s")), t.slug(F.col("s")), s="  João Ça-va ß 3 ")
    assert row[0] == "  joao ca-va ß 3 "
    assert row[1] == "joaocava3"
    assert row[2] == "joao-ca-va-3"


def test_one_spaced(spark):
    assert one(spark, t.one_spaced(F.col("s")), s="  amor  de \t deus  ")[0] == "amor de deus"


def test_whole_words_are_not_parts_of_words(spark):
    frame = spark.createDataFrame([("the end",), ("other ends",), ("THE, end!",), ("thé end",), (None,)], ["s"])
    found = [r[0] for r in frame.where(t.whole_words("s", "the end")).collect()]
    assert found == ["the end", "THE, end!"]


def test_snippet_cuts_both_ends(spark):
    text = "x" * 200 + "needle" + "y" * 200
    found = one(spark, t.snippet(F.col("s"), "NEEDLE"), s=text)[0]
    assert found == "..." + "x" * 75 + "needle" + "y" * 75 + "..."
    assert one(spark, t.snippet(F.col("s"), "a"), s="a short one")[0] == "a short one"


def test_ngrams(spark):
    assert one(spark, t.ngrams(t.tokens(F.col("s")), 2), s="A b c!")[0] == ["a_b", "b_c"]
    assert one(spark, t.ngrams(t.tokens(F.col("s")), 2), s="a")[0] == []


def test_century(spark):
    assert [one(spark, t.century(F.col("y")), y=y)[0] for y in (397, 100, 101, -50)] == ["IV", "I", "II", "I a.C."]


def test_cosine_edges(spark):
    cases = [([1.0, 2.0], [1.0, 2.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([1.0, 0.0], [1.0, 1.0], 1 / math.sqrt(2)), ([0.0, 0.0], [1.0, 1.0], 0)]
    for a, b, wanted in cases:
        assert abs(one(spark, v.cosine(F.col("a"), F.col("b")), a=a, b=b)[0] - wanted) < 1e-12
    assert one(spark, v.cosine(F.array().cast("array<double>"), v.literal([])))[0] == 0


def test_fit(spark):
    assert one(spark, v.fit(F.col("a"), 2), a=[1.0, 2.0, 3.0])[0] == [1.0, 2.0]
    assert one(spark, v.fit(F.col("a"), 4), a=[1.0, 2.0, 3.0])[0] is None


def test_fusion(spark):
    row = one(spark, v.weighted_mean(F.col("a"), F.col("w")), v.elementwise_max(F.col("a")), a=[[1.0, 5.0], [3.0, 1.0]], w=[1.0, 3.0])
    assert row[0] == [2.5, 2.0]
    assert row[1] == [3.0, 5.0]
    assert abs(one(spark, analytics.fusion_quality(F.col("w"), 2, 4), w=[0.5, 0.5])[0] - (0.35 + 0.3)) < 1e-6


def test_exclusive_percentile(spark):
    import statistics

    random.seed(1)
    for n in (20, 33, 100):
        values = sorted(random.random() for _ in range(n))
        found = one(spark, analytics.exclusive_percentile(F.col("x"), 0.95), x=values)[0]
        assert abs(found - statistics.quantiles(values, n=20)[18]) < 1e-12


def test_references(spark):
    row = one(spark, ref.parse(F.col("s")), s="Jo 3:16-18")[0]
    assert (row.book, row.chapter, row.verse, row.end_chapter, row.end_verse) == ("Jo", 3, 16, 3, 18)
    row = one(spark, ref.parse(F.col("s")), s="Gn 1-3")[0]
    assert (row.chapter, row.verse, row.end_chapter) == (1, None, 3)
    assert not one(spark, ref.parse(F.col("s")), s="nothing")[0].ok
    assert one(spark, ref.segments(F.col("s")), s="Jo 3:16; ;1Co 13")[0] == ["Jo 3:16", "1Co 13"]
    assert tuple(one(spark, ref.parse_dotted(F.col("s")), s="John.3.16")[0]) == ("John", 3, 16, 16)
    assert one(spark, ref.accepted_languages(F.col("s")), s="pt;q=0.5,en,fr;q=0.9")[0] == ["en", "fr", "pt"]
