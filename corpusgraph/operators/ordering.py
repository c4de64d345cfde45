"""Orders that a user may choose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.sources.tables import stored


def chosen(wish: str, allowed: tuple[str, ...], key: str) -> list[Column]:
    """Columns for ``-a,b`` (minus: from the largest on), nulls as a database would put them, *key* last.

    A column that isn't allowed is an error.
    """
    out = []
    for part in filter(None, wish.split(",")):
        name = part.lstrip("-")
        if name not in allowed:
            raise ValueError(f"can't order by {name!r}; choose from {', '.join(allowed)}")
        out.append(F.desc_nulls_first(name) if part.startswith("-") else F.asc_nulls_last(name))
    return [*out, F.asc(key)]


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """*df* with each row's place from 1 on in *order* (which ends with a unique key), without one task for all rows.

    Ranges of the order are sorted each by itself; the rows before a range come from a table of one row a range.  The
    ranges are written, since both passes must see the same ones, and outlive a lost executor so.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranges = stored(ranges.withColumn("_range", F.shiftright("_at", 33)))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranges.join(F.broadcast(sizes), "_range").select(*df.columns, place.alias(name))


def numbered_in(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """*df* with each row's place from 1 on in its *group* (nulls are one) by *order*, without one task for a large group.

    Rows are numbered by group and *order* over all, and the places before a group are taken off.
    """
    rows = numbered(df, [F.asc_nulls_first(group), *order], "_place")
    first = rows.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"))
    joined = rows.join(first, F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*df.columns, (F.col("_place") - F.col("_first") + 1).alias(name))
