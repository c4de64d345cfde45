"""Cleaning and merging records from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators.relational import upsert


def merge_duplicates(df: DataFrame, key: str, order: str, lists: list[str], scalars: list[str]) -> DataFrame:
    """A row a key: lists joined, without repeats in any case and in order; scalars from the first row that has one.

    Elements are put together by key and lower case before a key's list is made, so that a list has no more than its different
    elements, and a key of many rows is no more work than many keys.  Null elements, and null lists, add nothing.
    """
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    merged = df.groupBy(key).agg(*firsts, F.count("*").alias("merged"))
    for c in lists:
        rows = df.select(F.col(key).alias("_key"), F.col(order).alias("o"), F.col(c).alias("v"), F.posexplode(c).alias("i", "x")).where("x IS NOT NULL")
        first = rows.groupBy("_key", F.lower("x").alias("_lowered")).agg(F.min(F.struct("o", "v", "i", "x")).alias("f"))
        joined = first.groupBy("_key").agg(F.array_sort(F.collect_list("f"))["x"].alias(c))
        merged = merged.join(joined, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
        empty = F.array().cast(df.schema[c].dataType)
        merged = merged.withColumn(c, F.coalesce(c, empty))
    return merged.select(key, *lists, *scalars, "merged")


def normalised_id(prefix: Column, name: Column, prefixes: dict[str, str]) -> Column:
    """``PREFIX:slug`` with the usual prefix of a namespace."""
    from corpusgraph.functions.text import lookup, slug

    return F.concat(F.coalesce(lookup(prefix, prefixes), F.upper(prefix)), F.lit(":"), slug(name))


def changes(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """``old`` and ``new`` values of the rows whose *column* differs."""
    old = before.select(key, F.col(column).alias("old"))
    return old.join(after.select(key, F.col(column).alias("new")), key).where(~F.col("old").eqNullSafe(F.col("new")))


def annotate(existing: DataFrame, found: DataFrame, key: str, relevance: str, gate: float = 0.5, primary: float = 0.8) -> DataFrame:
    """*existing* (*key*, *relevance*, ``is_primary``) with what *found* says of *relevance* at *gate* or above.

    Of several findings on a key the greatest counts; *primary* or more marks it.  Findings below the gate
    change nothing, and so do nulls.
    """
    best = found.where(F.col(relevance) >= gate).groupBy(key).agg(F.max(relevance).alias(relevance))
    return upsert(existing.select(key, relevance, "is_primary"), best.withColumn("is_primary", F.col(relevance) >= primary), [key])
