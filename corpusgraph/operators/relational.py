"""Selecting, ordering and combining rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a table that one task may put in order.
MOST_NEIGHBOURS = 100_000
#: Slices of the points of a cell, in interval joins.
CELL_SLICES = 16


def composite_between(first: Column, second: Column, start: tuple, end: tuple) -> Column:
    """(first, second) from *start* to *end*, both included, across values of *first*.

    Written out, so that the bounds on *first* reach the scan.
    """
    (a, b), (c, d) = start, end
    inside = first.between(a, c)
    return inside & ((first > a) | (second >= b)) & ((first < c) | (second <= d))


def page(df: DataFrame, order: list[Column], number: int, size: int = 20, most: int = 100) -> DataFrame:
    """Page *number* (from 1) in a total order, with ``total`` rows and ``pages`` in all.

    Only the rows up to the page's end are ordered (Spark keeps the top rows of each partition).
    """
    size = min(size, most)
    upto = df.orderBy(*order).limit(number * size)
    ranked = upto.withColumn("row", F.row_number().over(Window.orderBy(*order)))
    counted = df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return ranked.where(F.col("row") > (number - 1) * size).crossJoin(F.broadcast(counted)).drop("row")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first *n* rows of each group (Spark drops lower rows before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def prefer(df: DataFrame, key: list[str], column: str, ranking: list[str], tie: list[Column]) -> DataFrame:
    """One row a key: that whose *column* comes first in *ranking*; others come after, in the order of *tie*."""
    place = F.array_position(F.array(*map(F.lit, ranking)), F.col(column))
    return top_per_group(df, key, [F.when(place > 0, place).otherwise(len(ranking) + 1), *tie])


def neighbours(df: DataFrame, order: list[Column], value: str, group: list[str] | None = None) -> DataFrame:
    """``previous`` and ``next`` of *value* in order, within groups, or over all rows of a table of up to MOST_NEIGHBOURS."""
    if not group:
        df = at_most(df, MOST_NEIGHBOURS)
    window = Window.partitionBy(*(group or [])).orderBy(*order)
    return df.withColumns({"previous": F.lag(value).over(window), "next": F.lead(value).over(window)})


def interval_join(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str, keys: list[str], width: int) -> DataFrame:
    """Points with the ranges of the same keys that contain them, both ends included.

    Each range is spread over the cells of *width* that it touches, and points meet it in their own
    cell: an equality join, whatever the lengths are.  The points of a cell are dealt over CELL_SLICES slices, each of which has the
    cell's ranges, so that few cells with many pairs are no few tasks; the number of tasks does not follow the tables' sizes, as pairs may be many more than rows.
    """
    session, on = points.sparkSession, [*keys, "_cell", "_slice"]
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    cells = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("_cell")
    every = F.explode(F.sequence(F.lit(0), F.lit(CELL_SLICES - 1))).alias("_slice")
    spread = ranges.select("*", cells).select("*", every)
    own = F.pmod(F.xxhash64(*points.columns), F.lit(CELL_SLICES)).cast("int")
    dealt = points.withColumns({"_cell": F.floor(F.col(at) / width), "_slice": own})
    return (
        dealt.repartition(tasks, *on)
        .join(spread.repartition(tasks, *on), on)
        .where(F.col(at).between(F.col(start), F.col(end)))
        .drop("_cell", "_slice")
    )


def contained_in_all(df: DataFrame, key: str, member: str, members: DataFrame) -> DataFrame:
    """Keys that occur with every one of *members* (a column of that name): relational division."""
    wanted = members.select(member).distinct()
    found = df.select(key, member).distinct().join(wanted, member).groupBy(key).agg(F.count("*").alias("_n"))
    needed = wanted.agg(F.count("*").alias("_m"))
    return found.crossJoin(F.broadcast(needed)).where("_n = _m").select(key)


def both_directions(edges: DataFrame, source: str, target: str, node: str, other: str) -> DataFrame:
    """Each edge from either end, with ``direction``."""
    out = edges.withColumns({node: F.col(source), other: F.col(target), "direction": F.lit("outgoing")})
    back = edges.withColumns({node: F.col(target), other: F.col(source), "direction": F.lit("incoming")})
    return out.unionByName(back)


# Changes to tables, as new tables.


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """*target* and those rows whose key it does not have, one a key."""
    return target.unionByName(rows.dropDuplicates(key).join(target.select(*key), key, "left_anti").select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """*target* with the values of *rows* (one a key) where they are not null, and new keys added."""
    others = [c for c in target.columns if c not in key]
    new = rows.select(*key, *[F.col(c).alias(f"_{c}") for c in others if c in rows.columns])
    merged = [F.coalesce(f"_{c}", c).alias(c) if c in rows.columns else F.col(c) for c in others]
    return target.join(new, key, "full_outer").select(*key, *merged)


def get_or_create(dimension: DataFrame, names: DataFrame, name: str, id_: str) -> DataFrame:
    """*dimension* (id, name) with the new names, numbered on from its largest id by ranges, not in one task."""
    from corpusgraph.operators.ordering import numbered

    new = names.select(name).where(F.col(name).isNotNull()).distinct().join(dimension, name, "left_anti")
    top = dimension.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_top"))
    made = numbered(new, [F.asc(name)], "_k").crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_k")).alias(id_), name)
    return dimension.select(id_, name).unionByName(made)


def refresh_counts(parents: DataFrame, children: DataFrame, key: str, column: str) -> DataFrame:
    """Parents with the number of their children, 0 included."""
    counts = children.groupBy(key).agg(F.count("*").alias(column))
    return parents.drop(column).join(counts, key, "left").withColumn(column, F.coalesce(column, F.lit(0).cast("long")))


def orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents without a child."""
    return parents.join(children.select(key), key, "left_anti")


def unique_names(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Names made unique by -1, -2, ... on all but the first of equal ones."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return df.withColumn("_k", k).withColumn(
        name, F.when(F.col("_k") > 0, F.concat_ws("-", name, F.col("_k").cast("string"))).otherwise(F.col(name))
    ).drop("_k")


class TooManyRows(ValueError):
    """More rows than a request may have."""


def at_most(df: DataFrame, n: int) -> DataFrame:
    """*df*, if it has at most *n* rows; only n + 1 of them are looked at."""
    if df.limit(n + 1).count() > n:
        raise TooManyRows(f"more than {n} rows")
    return df
