"""Studies: topics composed of sections, and lists of studies as a reader may see them."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.operators.relational import top_per_group


class Section(NamedTuple):
    """Rows of a topic: an *item* (text) each, the largest *weight* first and then by *order* (text), of which the first *most* stay."""

    name: str
    rows: DataFrame
    item: Column
    weight: Column
    order: Column
    most: int


def compose(sections: list[Section], topic: str) -> DataFrame:
    """One row a *topic* with a list of items by section (empty if it has none).

    All sections are one table of tagged rows, of which each task keeps the first of every topic and section before they are
    shuffled, once; what is left of a topic is bounded by the sections' numbers.
    """
    parts = [
        s.rows.select(topic, F.lit(i).alias("_section"), s.item.cast("string").alias("_item"), s.weight.cast("double").alias("_weight"), s.order.cast("string").alias("_order"), F.lit(s.most).alias("_most"))
        for i, s in enumerate(sections)
    ]
    rows = reduce(DataFrame.unionByName, parts)
    order = [F.desc("_weight"), F.asc("_order"), F.asc("_item")]
    most = max(s.most for s in sections)
    place = F.row_number().over(Window.partitionBy(topic, "_section").orderBy(*order))
    best = rows.withColumn("_place", place).where(F.col("_place") <= most).where(F.col("_place") <= F.col("_most"))
    lists = best.groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("_section", "_place", "_item"))).alias("_all"))
    own = lambda i: F.transform(F.filter("_all", lambda x: x["_section"] == i), lambda x: x["_item"])
    return lists.select(topic, *[own(i).alias(s.name) for i, s in enumerate(sections)])


def visible(studies: DataFrame, reader: Column, owner: str = "owner", visibility: str = "visibility", status: str = "status") -> DataFrame:
    """A reader's own studies, and published ones of others that are public or for the community."""
    shared = F.lower(visibility).isin("public", "community") & (F.col(status) == "published")
    return studies.where((F.col(owner) == reader) | F.coalesce(shared, F.lit(False)))


def listed(studies: DataFrame, bookmarks: DataFrame, forks: DataFrame, key: str, kind: str, most: int) -> DataFrame:
    """The first *most* studies of each *kind*: featured ones first, then by bookmarks, forks and *key*, with both numbers.

    *bookmarks* has a row for each study and reader, *forks* the ``parent`` of each fork; a reader's bookmark counts once.
    """
    marks = bookmarks.select(key, "reader").distinct().groupBy(key).agg(F.count("*").alias("bookmarks"))
    copies = forks.groupBy(F.col("parent").alias(key)).agg(F.count("*").alias("forks"))
    zero = F.lit(0).cast("long")
    known = studies.join(marks, key, "left").join(copies, key, "left")
    known = known.withColumns({"bookmarks": F.coalesce("bookmarks", zero), "forks": F.coalesce("forks", zero)})
    return top_per_group(known, [kind], [F.desc_nulls_last("featured"), F.desc("bookmarks"), F.desc("forks"), F.asc(key)], most)
