"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
#: Lets Spark drop the shuffle files of a statement when the statement ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SCOPES: list[list[str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, which every executor sees.

    Only where the setting is absent and all runs on one machine (tests) is a temporary folder taken
    instead; a cluster without the setting is an error, as its executors could not read each other's files.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        master = context.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, discard: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write *df* as a table to the shared folder and go on from there, so that its rows outlive a lost executor.

    The shuffle files that made it are dropped with the statement, and so are the tables of *discard*,
    earlier results of this function that nothing needs any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    for old in discard:
        remove(old)
    for paths in _SCOPES:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def to_all(table: DataFrame, most: int = 500_000) -> DataFrame:
    """A table of a few numbers a row, to be sent to all tasks if it has *most* rows at most; a larger one is left to meet rows by a shuffle."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def remove(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`cut` has written."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`cut` writes within are deleted at the end; what is to stay must have been written elsewhere by then."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            delete(spark, path)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for null."""
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(
        F.array().cast("array<string>")
    )


def bind(value: Column, body) -> Column:
    """``body(value)`` with *value* computed once a row.

    Catalyst would copy a long expression to every place, also into the lambdas of
    higher-order functions, which run once an element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text leaves 1 on division by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def even_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About *n* rows, or all if there are fewer, by a hash of *key*: the same in each run, and without a shuffle."""
    share = min(1.0, n / max(1, df.count()))
    return df if share == 1 else df.where(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 30)) < int(share * (1 << 30)))
