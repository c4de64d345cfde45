"""Counts, shares, distributions and co-occurrence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.operators.relational import at_most
from corpusgraph.sources.tables import stored

#: Groups of so many values are looked at whole; in larger ones quantiles are first known to a part in so many.
FEW = 10_000
#: Themes of a unit of which all pairs are made.
MOST_THEMES = 5_000
#: Rows of a table of groups that one task may go through.
MOST_GROUPS = 100_000


def histogram(df: DataFrame, label: Column, labels: list[str], column: str = "n") -> DataFrame:
    """``bucket`` and its number of rows for each of *labels*, in their order (``place``), zeros included."""
    spark = df.sparkSession
    buckets = spark.createDataFrame(list(enumerate(labels)), "place int, bucket string")
    counts = df.groupBy(label.alias("bucket")).agg(F.count("*").alias(column))
    return buckets.join(counts, "bucket", "left").withColumn(column, F.coalesce(column, F.lit(0).cast("long")))


def per_number(df: DataFrame, parents: DataFrame, key: str, upto: str, number: str, column: str = "n") -> DataFrame:
    """Rows by *key* and *number* for every number from 1 to the parent's *upto*, zeros included."""
    every = parents.select(key, F.explode(F.sequence(F.lit(1), F.col(upto))).alias(number))
    counts = df.groupBy(key, number).agg(F.count("*").alias(column))
    return every.join(counts, [key, number], "left").withColumn(column, F.coalesce(column, F.lit(0).cast("long")))


def coverage(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 part / whole, 0 where there is no whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, digits))


def unknown_if_empty(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))


def share(counts: DataFrame, column: str, name: str = "share") -> DataFrame:
    """Each row's percentage of the total, for tables of up to MOST_GROUPS groups."""
    counts = at_most(counts, MOST_GROUPS)
    return counts.withColumn(name, 100.0 * F.col(column) / F.sum(column).over(Window.partitionBy()))


def cooccurrence(links: DataFrame, unit: str, theme: str) -> DataFrame:
    """``theme``, ``other``, ``shared`` units and ``strength``: shared over the theme's own number of units.

    The list of themes of a unit is short, so pairs are made within it instead of by a self-join; one of more than MOST_THEMES
    is an error.
    """
    lists = links.select(unit, theme).distinct().groupBy(unit).agg(F.count("*").alias("n"), F.collect_list(theme).alias("ts"))
    long = F.raise_error(F.lit(f"a unit has more than {MOST_THEMES} themes"))
    lists = lists.select(F.when(F.col("n") > MOST_THEMES, long).otherwise(F.col("ts")).alias("ts"))
    pairs = lists.select(F.explode("ts").alias("theme"), "ts").select("theme", F.explode("ts").alias("other")).where("theme <> other")
    shared = pairs.groupBy("theme", "other").agg(F.count("*").alias("shared"))
    own = links.select(unit, theme).distinct().groupBy(F.col(theme).alias("theme")).agg(F.count("*").alias("own"))
    return shared.join(own, "theme").withColumn("strength", F.col("shared") / F.col("own"))


def progression(links: DataFrame, book: str, chapter: str, unit: str) -> DataFrame:
    """By book: units, chapters, the first unit in order and the most units in a chapter."""
    by_chapter = links.groupBy(book, chapter).agg(F.count_distinct(unit).alias("units"), F.min(unit).alias("first"))
    return by_chapter.groupBy(book).agg(
        F.sum("units").alias("units"), F.count("*").alias("chapters"),
        F.min_by("first", chapter).alias("first_unit"), F.max("units").alias("peak"),
    )


def exclusive_percentile(sorted_values: Column, p: float) -> Column:
    """The quantile at p (n + 1) of sorted values, by interpolation, within the outermost ones."""
    n = F.size(sorted_values)
    place = F.least(F.greatest(p * (n + 1), F.lit(1.0)), n.cast("double"))
    low = F.floor(place).cast("int")
    a, b = F.element_at(sorted_values, low), F.element_at(sorted_values, F.least(low + 1, n))
    return a + (b - a) * (place - low)


def exclusive_percentiles(df: DataFrame, group: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """*group* and, by name, the quantiles of *value* as :func:`exclusive_percentile` has them, for groups of any size.

    Approximate quantiles bracket the exact ones in groups of more than FEW values.  Then one pass counts what lies between brackets and each
    value within them (in small groups each value), and running counts of these few rows tell which values stand at the wanted places.
    """
    groups = df.select(group).distinct()
    own = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_x"))
    room = 10 / FEW
    edges = [e for p in wanted.values() for e in (max(0.0, p - room), min(1.0, p + room))]
    brackets = stored(own.groupBy("_g").agg(F.count("*").alias("_m"), F.percentile_approx("_x", edges, FEW).alias("_q")))
    brackets = brackets.select(F.col("_g").alias("_own"), "_m", "_q")
    low, high = lambda i: F.get("_q", F.lit(2 * i)), lambda i: F.get("_q", F.lit(2 * i + 1))
    n = range(len(wanted))
    inside = reduce(Column.__or__, [F.col("_x").between(low(i), high(i)) for i in n], F.col("_m") <= FEW)
    zone = reduce(Column.__add__, [(F.col("_x") > high(i)).cast("int") for i in n])
    rows = own.join(brackets, F.col("_g").eqNullSafe(F.col("_own"))).select("_g", "_m", "_x", zone.alias("_zone"), F.when(inside, F.col("_x")).alias("_cell"))
    cells = rows.groupBy("_g", "_m", "_zone", "_cell").agg(F.count("*").alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_least", "_most").rowsBetween(Window.unboundedPreceding, 0))
    placed = cells.withColumn("_upto", upto)
    m = F.col("_m")
    places = {x: F.least(F.greatest(p * (m + 1), F.lit(1.0)), m.cast("double")) for x, p in wanted.items()}
    known = F.when(F.col("_least") == F.col("_most"), F.col("_least")).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    at = lambda place: F.max(F.when((F.col("_upto") - F.col("_n") < place) & (place <= F.col("_upto")), known))
    ends = [at(end).alias(f"{x}_{c}") for x, place in places.items() for c, end in (("a", F.floor(place)), ("b", F.least(F.floor(place) + 1, m)))]
    found = placed.groupBy("_g", "_m").agg(*ends)
    between = [(F.col(f"{x}_a") + (F.col(f"{x}_b") - F.col(f"{x}_a")) * (place - F.floor(place))).alias(x) for x, place in places.items()]
    return groups.join(found.select("_g", *between), F.col(group).eqNullSafe(F.col("_g")), "left").select(group, *wanted)


def fusion_quality(weights: Column, present: int, wanted: int) -> Column:
    """0.7 of the share of versions present and 0.3 of the evenness of their weights."""
    entropy = F.aggregate(weights, F.lit(0.0), lambda s, w: s - w * F.log(w + 1e-10))
    even = F.when(F.size(weights) > 1, entropy / F.log(F.size(weights).cast("double"))).otherwise(F.lit(1.0))
    return 0.7 * (F.lit(float(present)) / wanted) + 0.3 * even
