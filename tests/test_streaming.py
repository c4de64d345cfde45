import datetime
import time

from pyspark.sql import functions as F

from corpusgraph.streaming import lifetimes, usage
from tests.conftest import SMALL


def stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.write.parquet(folder)
    return events, spark.readStream.schema(events.schema).parquet(folder)


def test_tumbling_stream_is_the_batch_but_for_open_windows(spark, tmp_path):
    events, live = stream(spark, tmp_path)
    usage.write_once(usage.tumbling(live, "1 hour", "0 seconds"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    found = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    wanted = {tuple(r) for r in usage.tumbling(events, "1 hour").collect()}
    assert found
    last = events.agg(F.max("ts")).first()[0]
    assert found <= wanted
    assert {r for r in wanted if r[1] < last.replace(minute=0, second=0, microsecond=0)} <= found


def test_deduplicated_stream(spark, tmp_path):
    events, live = stream(spark, tmp_path)
    twice = live.union(live)
    usage.write_once(usage.deduplicated(twice, "event_id"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_totals(spark, tmp_path):
    events, live = stream(spark, tmp_path)
    usage.upsert_counts(usage.counters(live, F.lit(1)), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    found = {r.event_type: r.n for r in usage.latest_totals(spark, str(tmp_path / "out")).collect()}
    assert found == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}


def plain_lifetimes(rows, life, end):
    """(key, outcome, time) of accesses, one after the other."""
    out, stored = [], {}
    for key, at in sorted(rows):
        if key in stored and at < stored[key] + life:
            out.append((key, "hit", at))
            continue
        if key in stored:
            out.append((key, "evicted", stored[key] + life))
        stored[key] = at
        out.append((key, "miss", at))
    return sorted(out + [(k, "evicted", s + life) for k, s in stored.items() if s + life <= end])


def test_lifetimes_of_a_table(spark):
    life = datetime.timedelta(days=2)
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    rows = [(r.user_id, r.ts) for r in events.collect()]
    found = sorted((r.user_id, r.outcome, r.at) for r in lifetimes.of_table(events, "user_id", life.total_seconds()).collect())
    assert found == plain_lifetimes(rows, life, max(ts for _, ts in rows)) and {o for _, o, _ in found} == {"hit", "miss", "evicted"}
    assert lifetimes.of_table(events.limit(0), "user_id", 9).count() == 0
    odd = spark.createDataFrame([(None, rows[0][1]), (1, None), (1, rows[0][1]), (1, rows[0][1])], "user_id long, ts timestamp")
    assert sorted(r.outcome for r in lifetimes.of_table(odd, "user_id", 9).collect()) == ["hit", "miss"]


def test_lifetimes_of_a_stream(spark, tmp_path):
    """Batches in the order of time give what the table gives, but for entries that the watermark has not passed."""
    life, events = datetime.timedelta(days=2), spark.read.parquet(f"{SMALL}/events.parquet")
    rows = sorted((r.ts, r.user_id) for r in events.collect())
    folder, n = tmp_path / "in", len(rows) // 4 + 1
    for i in range(0, len(rows), n):
        part = spark.createDataFrame([(u, ts) for ts, u in rows[i : i + n]], "user_id long, ts timestamp")
        part.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lifetimes.PROVIDER)
    try:
        live = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
        out = lifetimes.of_stream(live, "user_id", life.total_seconds(), "0 seconds")
        query = usage.write_once(out, str(tmp_path / "out"), str(tmp_path / "c"))
        query.awaitTermination()
        left = sum(x["numRowsTotal"] for x in query.lastProgress["stateOperators"])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = sorted((r.user_id, r.outcome, r.at) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    wanted = plain_lifetimes([(u, ts) for ts, u in rows], life, rows[-1][0])
    accesses = lambda x: [r for r in x if r[1] != "evicted"]
    assert accesses(found) == accesses(wanted)
    evicted = [r for r in found if r[1] == "evicted"]
    assert len(evicted) == len(set(evicted)) and set(evicted) <= set(wanted) and len(evicted) > 0.8 * len([r for r in wanted if r[1] == "evicted"])
    assert 0 < left <= 3 * len({u for _, u in rows})
