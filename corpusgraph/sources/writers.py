"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Put *df* in place of the partitions it has rows for; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def by_namespace(df: DataFrame, path: str, report: DataFrame | None = None) -> None:
    """JSON lines in a folder a namespace, ``meta`` with their numbers, and ``quality_report``."""
    df.write.mode("overwrite").partitionBy("namespace").json(f"{path}/records")
    df.groupBy("namespace").agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{path}/meta")
    if report is not None:
        report.write.mode("overwrite").json(f"{path}/quality_report")


def table_files(df: DataFrame, path: str) -> None:
    """The same rows as CSV with a header and as JSON lines."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")


def raw_backup(df: DataFrame, path: str) -> None:
    """Rows as gzipped JSON lines."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def sorted_verses(df: DataFrame, path: str, version: str, order: list[str]) -> None:
    """Parquet by version, each file in the order of its places, so that ranges of places skip row groups."""
    df.repartitionByRange(F.col(version), *order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(version).parquet(path)
