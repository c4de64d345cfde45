"""A corpus from raw documents to packed training sequences, in five stages.

Each stage reads what the one before has written, and its decisions take effect: documents that the
quality rules reject go, shared lines go, of each group of near copies the smallest ``doc_id`` stays,
documents are repeated or left out as the mix of sources asks, and the rest is packed.

Every stage takes each text whole, however long, and gives an empty table for an empty one.  Null and empty texts have no words, so
the first stage rejects them; met later they stay.  Rows that are alike are judged alike until the near copies
go, of which rows that share a ``doc_id`` are one document and rows without one are none.  Columns pass through whatever
their names are, but for the last stage, which returns pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import common, joins, lines, mixing, packing, rules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.filter_quality(docs, common.labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs).drop("line_stats").select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return joins.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes n times is n rows."""
    mixed = mixing.mix_sources(docs)
    copies = F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int")))
    return mixed.where("mix.copies > 0").withColumn("mix", copies).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.vocabulary_encoder())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: Learned rules and packing are beyond SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.

    The stages between are written to the folder for checkpoints.  Each one's table is deleted when the next is written, and
    so is what a stage has written for itself: what is left is the table that the result reads.
    """
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = common.documents(spark, sf_dir), None
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}-{name}"
        with common.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            common.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
