"""Composed studies, lists of studies, and expanded texts."""

from pyspark.sql import functions as F

from corpusgraph.operators import expansion, studies


def test_sections_are_bounded_and_ordered(spark):
    a = spark.createDataFrame([("t", f"x{i}", i % 4) for i in range(50)] + [("u", "only", 1)], "topic string, name string, w int").repartition(4)
    b = spark.createDataFrame([("t", None, 1), ("v", "z", None)], "topic string, name string, w int")
    made = studies.compose([
        studies.Section("first", a, F.col("name"), F.col("w"), F.lpad(F.substring("name", 2, 9), 3, "0"), 3),
        studies.Section("second", b, F.col("name"), F.col("w"), F.col("name"), 2),
    ], "topic")
    plan = made._jdf.queryExecution().executedPlan().toString()
    found = {r.topic: (r["first"], r.second) for r in made.collect()}
    assert found == {"t": (["x3", "x7", "x11"], [None]), "u": (["only"], []), "v": ([], ["z"])}
    assert plan.count("Exchange hashpartitioning(topic") == 2 and plan.count("WindowGroupLimit") == 2


def test_readers_see_their_own_and_what_is_published(spark):
    rows = [(1, 7, "private", "draft"), (2, 8, "PUBLIC", "published"), (3, 8, "public", "draft"), (4, 8, "private", "published"), (5, None, "community", "published"), (6, None, None, "published")]
    frame = spark.createDataFrame(rows, "id int, owner int, visibility string, status string")
    assert sorted(r.id for r in studies.visible(frame, F.lit(7)).collect()) == [1, 2, 5]


def test_lists_put_featured_and_marked_first(spark):
    frame = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", None), (4, "a", False), (5, "b", False)], "id int, kind string, featured boolean")
    marks = spark.createDataFrame([(4, 1), (4, 1), (1, 1), (1, 2), (9, 1)], "id int, reader int")
    forks = spark.createDataFrame([(3,), (3,), (4,)], "parent int")
    found = studies.listed(frame, marks, forks, "id", "kind", 3).collect()
    assert {(r.id, r.bookmarks, r.forks) for r in found} == {(2, 0, 0), (1, 2, 0), (4, 1, 1), (5, 0, 0)}


def test_expanded_texts(spark):
    queries = spark.createDataFrame([(1, "love and love house"), (2, "nothing"), (3, ""), (4, None)], "q int, wish string")
    synonyms = spark.createDataFrame([("love", "amor", 1), ("love", "agape", 2), ("love", "third", 3), ("house", "home", 1)], "term string, synonym string, priority int")
    found = {r.q: (r.concatenated, r.replaced, r.augmented) for r in expansion.texts(queries, "q", "wish", synonyms, 2).collect()}
    assert found == {
        1: ("love and love house amor agape home", "love amor and love amor house home", "love and love house (amor, home)"),
        2: ("nothing", "nothing", "nothing"), 3: ("", "", ""), 4: (None, "", None),
    }
