"""Usage metrics over events, for streams and for tables alike.

On a stream, late events count for *late* after the newest one seen; with that, state is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Upper bounds of latency buckets in seconds.
BOUNDS = (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0, 5.0)
LATE = "10 minutes"


def _marked(events: DataFrame, late: str = LATE) -> DataFrame:
    if not events.isStreaming:
        return events
    # Watermarks need a time with a zone, which that of the session is taken to be.
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str, late: str = LATE) -> DataFrame:
    """Events by window and type."""
    counts = _marked(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def sliding(events: DataFrame, width: str, step: str, late: str = LATE) -> DataFrame:
    counts = _marked(events, late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """Runs of a user's events with less than *gap* between them."""
    counts = _marked(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """One event a key; on a stream, copies are looked for within the time allowed for late events."""
    if events.isStreaming:
        return _marked(events, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def latency_buckets(events: DataFrame, seconds: Column) -> DataFrame:
    """Cumulative counts by event type and upper bound, zeros included."""
    counts = events.groupBy("event_type").agg(*[F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)])
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BOUNDS)]))
    return counts.select("event_type", rows.alias("x")).select("event_type", "x.le", "x.n")


def counters(events: DataFrame, amount: Column) -> DataFrame:
    return events.groupBy("event_type").agg(F.sum(amount).alias("total"), F.count("*").alias("n"))


def write_once(counts: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take in what there is, write it and stop."""
    return (
        counts.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def upsert_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of running totals by ``event_type``: each batch's numbers replace that type's old ones.

    Totals are written to a folder of the batch's number, so that a batch that is tried again writes
    the same folder again; ``latest_totals`` reads the newest.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest_totals(spark, path: str) -> DataFrame:
    batches = spark.read.parquet(path)
    newest = batches.agg(F.max("batch").alias("batch"))
    return batches.join(F.broadcast(newest), "batch").drop("batch")
