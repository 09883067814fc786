"""The cache as stream state against the batch operators, in several micro-batches and over a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tonewise.sources import timeline
from tonewise.streaming import cache


@pytest.fixture
def rocks(spark):
    spark.conf.set(*cache.PROVIDER)
    yield spark
    spark.conf.unset(cache.PROVIDER[0])


def run(spark, schema, source, log, checkpoint, **options):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    changes = cache.cache_changes(stream, "user", "ts", "event_id", **options)
    sink = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = sink.foreachBatch(lambda df, _: df.write.mode("append").parquet(log)).start()
    query.awaitTermination()
    return spark.read.parquet(log)


def test_events_as_in_batch(rocks, sf, tmp_path):
    events = rocks.read.parquet(f"{sf}/events.parquet").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    source, log, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "log", "checkpoint"))
    parts = events.repartition(6, "event_id")
    half = F.spark_partition_id() < 3
    for chosen in (half, ~half):  # a second run goes on from the first one's state
        parts.where(chosen).write.mode("append").parquet(source)
        got = cache.current(run(rocks, events.schema, source, log, checkpoint, most=6, ttl=None, shards=2, late="3650 days"), 6)
    want = timeline.evicted(events, "user", "ts", 6, ("event_id",))
    assert events.select("user").distinct().count() > 12
    assert {(r["user"], r["tie"]) for r in got.collect()} == {(r["user"].lower(), r["event_id"]) for r in want.collect()}
    assert {r["change"] for r in rocks.read.parquet(log).collect()} == {"kept", "evicted"}


def test_stale_snapshots(rocks, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)
    schema = "user string, ts timestamp, event_id long"
    batches = [[("Ann", at(0), 1), ("bob", at(500), 2), (None, at(1), 3)], [("ann", at(600), 4), ("eve", at(5_000), 5)], [("eve", at(9_000), 6)]]
    source, log, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "log", "checkpoint"))
    for rows in batches:
        rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        got = run(rocks, schema, source, log, checkpoint, most=5, shards=1, late="1 second")
    rows = {(r["user"], r["tie"], r["stale"]) for r in cache.current(got).collect()}
    assert rows == {("ann", 4, True), ("bob", 2, True), ("eve", 6, False)}
