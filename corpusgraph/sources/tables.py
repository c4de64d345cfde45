"""Tables that a job writes for its own later steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark drop the shuffle files of a statement when the statement ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Lets a task write so many folders side by side, in place of a sort of its rows.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Bytes of a row group where several are open.
_GROUP_BYTES = 8 << 20


def workspace(spark: SparkSession) -> str:
    """A new path in the folder that the session names in ``spark.checkpoint.dir``.

    Only where the setting is absent and all runs on one machine (tests) is a temporary folder taken instead.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp()
    return f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, by: str | None = None, folders: int = 0) -> DataFrame:
    """*df* written as Parquet and read again, with a folder for each value of *by*; later steps see its size, and outlive lost executors.

    The shuffle files that made it are dropped with the statement.  Where *by* has *folders* values at most (some dozens), rows are not sorted by it: a task
    holds the open row group of each.
    """
    spark = df.sparkSession
    path = path or workspace(spark)
    writer = df.write.partitionBy(by) if by else df.write
    settings = {_CLEANUP: "true"}
    if folders:
        # Spark sorts the rest of a task's rows as soon as so many are open.
        settings[_WRITERS] = str(folders + 1)
        writer = writer.option("parquet.block.size", _GROUP_BYTES)
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        writer.option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables by their paths."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
