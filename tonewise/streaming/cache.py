"""The snapshot cache as the state of a stream: the latest snapshot of each user, the oldest going beyond so many users.

Users are dealt to shards, and a shard's state is its latest ``most`` users at most,
so state and work are bounded whatever arrives; whoever is among the latest
``most`` of all users is among those of the own shard. The stream gives a log of
changes: ``kept`` (a later snapshot came), ``evicted`` (later users took the place)
and ``stale`` (``ttl`` seconds of event time have passed since the snapshot; it stays
until it is evicted). ``current`` makes of a log the cache as it stands.

Defined cases: a snapshot that isn't later than the one held changes nothing (of
equally late ones the larger ``tie`` counts); null users or times are left out;
names differ by case only for the same user; snapshots later than the watermark
allows are Spark's to drop. Needs the RocksDB state store (``PROVIDER``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tonewise.sources.timeline import CACHE_ENTRIES, CACHE_SECONDS

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: at and ttl are microseconds.
ENTRY = "user string, at long, tie long, stale boolean"
CHANGE = "shard int, seq long, user string, at long, tie long, change string"


class SnapshotCache(StatefulProcessor):
    def __init__(self, most: int, ttl: int | None):
        self.most, self.ttl = most, ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", ENTRY)
        self.seq = handle.getValueState("seq", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {u: (at, tie, stale) for u, at, tie, stale in self.entries.get()} if self.entries.exists() else {}
        before = dict(held)
        for batch in rows:
            for user, at, tie in zip(batch["user"], batch["at"].tolist(), batch["tie"].tolist(), strict=True):
                if user not in held or (at, tie) > held[user][:2]:
                    held[user] = (at, tie, False)
        latest = dict(sorted(held.items(), key=lambda x: (-x[1][0], x[0]))[: self.most])
        changes = [(u, *x[:2], "kept") for u, x in latest.items() if before.get(u) != x]
        changes += [(u, *x[:2], "evicted") for u, x in before.items() if u not in latest]
        if self.ttl is not None:
            for _, at, _, what in changes:
                if what == "kept":
                    self.handle.registerTimer((at + self.ttl) // 1000 + 1)
        if changes:
            self.entries.put([(u, *x) for u, x in latest.items()])
            yield self._log(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = list(self.entries.get()) if self.entries.exists() else []
        due = [not stale and at + self.ttl < now for _, at, _, stale in held]
        if any(due):
            self.entries.put([(u, at, tie, stale or d) for (u, at, tie, stale), d in zip(held, due, strict=True)])
            yield self._log(key, [(u, at, tie, "stale") for (u, at, tie, _), d in zip(held, due, strict=True) if d])

    def _log(self, key, changes: list[tuple]) -> pd.DataFrame:
        seq = self.seq.get()[0] if self.seq.exists() else 0
        self.seq.update((seq + 1,))
        return pd.DataFrame([(key[0], seq, *c) for c in changes], columns=["shard", "seq", "user", "at", "tie", "change"])

    def close(self) -> None:
        pass


def cache_changes(
    snapshots: DataFrame, user: str, at: str, tie: str, most: int = CACHE_ENTRIES, ttl: int | None = CACHE_SECONDS, shards: int = 64, late: str = "1 hour"
) -> DataFrame:
    """The log of changes (shard, seq, user, at, tie, change) of a stream of snapshots; ``ttl`` None: none goes stale."""
    shard = F.pmod(F.xxhash64("user"), F.lit(shards)).cast("int").alias("shard")
    rows = snapshots.withWatermark(at, late).where(F.col(user).isNotNull() & F.col(at).isNotNull())
    rows = rows.select(F.lower(F.col(user)).alias("user"), F.unix_micros(F.col(at)).alias("at"), F.coalesce(F.col(tie).cast("long"), F.lit(-1)).alias("tie"), F.col(at).alias("time"))
    rows = rows.select(shard, "user", "at", "tie", "time")
    mode = "None" if ttl is None else "EventTime"
    return rows.groupBy("shard").transformWithStateInPandas(SnapshotCache(most, None if ttl is None else ttl * 1_000_000), CHANGE, "Update", mode)


def current(log: DataFrame, most: int = CACHE_ENTRIES) -> DataFrame:
    """(user, at, tie, stale): the cache that a log of changes leaves."""
    last = log.groupBy("shard", "user").agg(F.max_by(F.struct("at", "tie", "change"), F.struct("seq", "at", "tie", F.col("change") == "stale")).alias("x"))
    rows = last.where(F.col("x.change") != "evicted").select("user", "x.at", "x.tie", (F.col("x.change") == "stale").alias("stale"))
    nth = F.row_number().over(Window.orderBy(F.desc("at"), "user"))  # ``most`` rows a shard at most
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
