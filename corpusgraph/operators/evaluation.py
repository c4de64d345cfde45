"""Measures of ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.operators.relational import at_most

#: Entries of two top lists that are compared pair by pair.
MOST_RANKED = 10_000


def kendall_tau(ranks: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """``tau`` of two rankings of the same short list: agreeing minus disagreeing pairs, over all pairs.

    All pairs are made, so a list of more than MOST_RANKED is an error.
    """
    ranks = at_most(ranks, MOST_RANKED)
    other = ranks.select(*[F.col(c).alias(f"_{c}") for c in (key, first, second)])
    sign = F.signum((F.col(first) - F.col(f"_{first}")) * (F.col(second) - F.col(f"_{second}")))
    pairs = ranks.join(F.broadcast(other), F.col(key) < F.col(f"_{key}")).agg(F.sum(sign).alias("s"))
    n = ranks.agg(F.count("*").alias("n"))
    return pairs.crossJoin(n).select((F.col("s") / (F.col("n") * (F.col("n") - 1) / 2)).alias("tau"))


def ir_metrics(ranked: DataFrame, query: str, rank: str, gain: str, relevant: DataFrame, k: int) -> DataFrame:
    """By query: precision and recall at *k*, average precision and nDCG.

    *ranked* has each query's results with their gains (0: not relevant), *relevant* the number of
    relevant ones (``relevant``).  Average precision is over what was retrieved, and the ideal order is that of the
    retrieved gains.
    """
    top = ranked.where(F.col(rank) <= k).withColumn("_hit", (F.col(gain) > 0).cast("int"))
    so_far = F.sum("_hit").over(Window.partitionBy(query).orderBy(rank))
    ideal = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(gain), rank))
    discount = lambda place: 1 / F.log2(place + 1)
    placed = top.withColumns({"_p": so_far / F.col(rank), "_ideal": ideal})
    sums = placed.groupBy(query).agg(
        F.sum("_hit").alias("_hits"), F.sum(F.col("_p") * F.col("_hit")).alias("_ap"),
        F.sum(F.col(gain) * discount(F.col(rank))).alias("_dcg"), F.sum(F.col(gain) * discount(F.col("_ideal"))).alias("_best"),
    )
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return sums.join(relevant, query).select(
        query, (F.col("_hits") / k).alias("precision"), ratio(F.col("_hits"), F.col("relevant")).alias("recall"),
        ratio(F.col("_ap"), F.col("_hits")).alias("average_precision"), ratio(F.col("_dcg"), F.col("_best")).alias("ndcg"),
    )
