"""Tolerant as-of join: each click gets the latest order of its client at or before it, and at most ``tolerance_us`` earlier.

Orders of one client and time are one row before anything is shuffled for the
join (``n`` of them, and the winner: larger total, then larger id; null loses).
A shard is a client and a cell of time. A cell is as wide as the tolerance,
rounded up to a power of two; one that holds more than ``rows`` order times is
cut into 64, again and again, to one microsecond if need be, so no shard has
more. Where a shard has more than ``rows`` clicks, they are dealt over salts and
the shard's orders go to each salt. A shard's halo is the latest order before
it: the last orders of all shards are kept by the dyadic cells above them, and a
shard asks for those that end where its own path turns right. A client that
isn't cut asks for one cell, the one before.

Shards are dealt to buckets of several thousand rows and cogrouped. In a bucket
numpy's lexsort orders the orders, searchsorted finds each click's right
boundary, and the boundaries of the run before it yield ``n_tied`` and winner.

What grows with the data stays distributed: the driver counts tables and sees
no row. Lists of cut cells and of salted shards are broadcast up to
``BROADCAST_ROWS`` rows, and joined by shuffle beyond.

Defined cases: clicks without a client or time are kept, unmatched, and orders
without either match nothing. Unmatched rows have ``n_tied`` 0 and nulls.
Copies of a click id count once: the earliest time, then the smallest client,
null last. Rows without a click id are one click for each client and time. A
total that is no number counts as null. Empty tables give empty results, or
clicks without a match. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise.llm.common import discard, saved

HOUR = 3_600_000_000
#: Rows of a broadcast list (three longs each); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 100_000
#: Bits of time by which a cell that is too full is cut.
BITS = 6
#: Rows of a bucket, in shards of at most ``rows``.
BUCKET_ROWS = 20_000

OUT = "click_id long, client_id long, ts_us long, sale_id long, lag_us long, total_cents long, n_tied long"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 as the timestamp reads, whatever the session's zone."""
    second = F.date_part(F.lit("SECOND"), ts)
    return F.unix_date(F.to_date(ts)).cast("long") * (24 * HOUR) + F.hour(ts).cast("long") * HOUR + F.minute(ts).cast("long") * (HOUR // 60) + (second * 1_000_000).cast("long")


def digest(id_col: Column) -> Column:
    """Unsigned crc32 of the id as decimal digits."""
    return F.crc32(id_col.cast("string").cast("binary"))


def folded(id_col: Column, t: Column, every: int = 6 * HOUR) -> Column:
    """``t``, floored to a multiple of ``every`` where the id's digest is odd."""
    return F.when(digest(id_col) % 2 == 1, t - F.pmod(t, F.lit(every))).otherwise(t)


def prepared_clicks(clicks: DataFrame) -> DataFrame:
    """(click_id, client_id, ts_us), a row for each click."""
    c = clicks.select(F.col("click_id").cast("long").alias("click_id"), F.col("client_id").cast("long").alias("client_id"), micros(F.col("ts")).alias("t"))
    c = c.select("click_id", "client_id", folded(F.col("click_id"), F.col("t")).alias("t"))
    none = F.col("click_id").isNull()
    key = ["click_id", F.when(none, F.col("t")).alias("_t"), F.when(none, F.col("client_id")).alias("_c")]
    first = F.min(F.struct(F.col("t").isNull().alias("a"), "t", F.col("client_id").isNull().alias("b"), "client_id"))
    return c.groupBy(*key).agg(first.alias("x")).select("click_id", F.col("x.client_id").alias("client_id"), F.col("x.t").alias("ts_us"))


def prepared_orders(sales: DataFrame) -> DataFrame:
    """(client_id, t, sale_id, total_cents, priority): each sale, and its second order where the id's digest is no multiple of 3."""
    total = F.when(~F.isnan("total"), F.floor(F.col("total") * 100 + 0.5))
    s = sales.select(
        F.col("client_id").cast("long").alias("client_id"), folded(F.col("sale_id"), micros(F.col("sold_at"))).alias("t"),
        F.col("sale_id").cast("long").alias("sale_id"), total.cast("long").alias("total_cents"), F.col("priority").cast("int").alias("priority"),
    )
    own = F.struct("sale_id", "priority")
    second = F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority"))
    both = F.when(digest(F.col("sale_id")) % 3 != 0, F.array(own, second)).otherwise(F.array(own))
    s = s.withColumn("o", F.explode(both))
    return s.select("client_id", "t", F.col("o.sale_id").alias("sale_id"), "total_cents", F.col("o.priority").alias("priority"))


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the rows of both tables of columns, equal where all columns are, in order."""
    both = np.concatenate([a, b], 1)
    order = np.lexsort(both[::-1])
    new = np.any(np.diff(both[:, order], axis=1) != 0, axis=0)
    code = np.empty(both.shape[1], np.int64)
    code[order] = np.concatenate(([0], np.cumsum(new)))[: len(order)]
    return code[: a.shape[1]], code[a.shape[1] :]


def _bucket(tolerance: int):
    def longs(table: pa.Table, *names: str) -> np.ndarray:
        return np.stack([table.column(c).to_numpy().astype(np.int64, copy=False) for c in names])

    def run(clicks: pa.Table, orders: pa.Table) -> pa.Table:
        n = clicks.num_rows
        t = longs(clicks, "t")[0]
        found, lag, tied = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = np.zeros(n, np.int64)
        if n and orders.num_rows:
            ot = longs(orders, "t")[0]
            times = np.unique(ot)
            mine, theirs = _merged(longs(clicks, "client_id", "start", "salt"), longs(orders, "client_id", "start", "salt"))
            rank = {}
            for c in ("total_cents", "sale_id"):  # null below all
                x = orders.column(c).combine_chunks()
                rank[c] = np.where(x.is_valid().to_numpy(zero_copy_only=False), x.fill_null(0).to_numpy(), np.iinfo(np.int64).min)
            order = np.lexsort((rank["sale_id"], rank["total_cents"], ot, theirs))
            step = len(times) + 1
            keys = theirs[order] * step + np.searchsorted(times, ot[order]) + 1
            ends = np.flatnonzero(np.concatenate((np.diff(keys) != 0, [True])))  # the last of a run wins
            sizes = np.add.reduceat(longs(orders, "n")[0][order], np.concatenate(([0], ends[:-1] + 1)))
            right = np.searchsorted(keys, mine * step + np.searchsorted(times, t, "right"), "right") - 1
            last = order[np.maximum(right, 0)]
            lag = t - ot[last]
            found = (right >= 0) & (theirs[last] == mine) & (lag >= 0) & (lag <= tolerance)
            at = np.where(found, last, 0)
            tied = np.where(found, sizes[np.searchsorted(ends, np.maximum(right, 0))], 0)
        pick = lambda c: orders.column(c).combine_chunks().take(pa.array(at, mask=~found))
        none = pa.nulls(n, pa.int64())
        return pa.table(
            [
                clicks.column("click_id"), clicks.column("client_id"), clicks.column("t"), pick("sale_id") if found.any() else none,
                pa.array(lag, mask=~found), pick("total_cents") if found.any() else none, pa.array(tied),
            ],
            names=["click_id", "client_id", "ts_us", "sale_id", "lag_us", "total_cents", "n_tied"],
        )

    return run


def _shift(t: str, bits: int) -> Column:
    return F.shiftright(F.col(t), bits)


class _Small:
    """A written table that is broadcast while it is small."""

    def __init__(self, df: DataFrame, label: str):
        self.df = saved(df, label)
        self.n = self.df.count()

    def __call__(self) -> DataFrame:
        return F.broadcast(self.df) if self.n <= BROADCAST_ROWS else self.df


def _cut(orders: DataFrame, root: int, rows: int) -> list[tuple[int, _Small]]:
    """For each level with cells of more than ``rows`` order times: its bits, and those cells."""
    found: list[tuple[int, _Small]] = []
    bits, left = root, orders.select("client_id", "t")
    while bits:
        full = left.groupBy("client_id", _shift("t", bits).alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > rows)
        cells = _Small(full.select("client_id", "cell"), "asof-cells")
        if not cells.n:
            discard(cells.df)
            break
        found.append((bits, cells))
        left = left.withColumn("cell", _shift("t", bits)).join(cells(), ["client_id", "cell"], "left_semi").select("client_id", "t")
        bits = max(0, bits - BITS)
    return found


def _placed(df: DataFrame, root: int, cut: list[tuple[int, _Small]]) -> DataFrame:
    """``df`` with ``bits`` and ``start`` of the shard of each row."""
    names, bits = df.columns, F.lit(root)
    for i, (at, cells) in enumerate(cut):
        to = cells().select("client_id", "cell", F.lit(max(0, at - BITS)).alias(f"bits{i}"))
        df = df.withColumn("cell", _shift("t", at)).join(to, ["client_id", "cell"], "left").drop("cell")
        bits = F.coalesce(F.col(f"bits{i}"), bits)
    df = df.withColumn("bits", bits)
    return df.select(*names, "bits", F.expr("shiftleft(shiftright(t, bits), bits)").alias("start"))


def _halos(shards: DataFrame, orders: DataFrame, root: int, tolerance: int) -> DataFrame:
    """The latest orders before each shard: (client_id, start, salts, t, n, total_cents, sale_id)."""
    last = F.max(F.struct("t", "n", "total_cents", "sale_id")).alias("last")
    ends = orders.groupBy("client_id", "bits", "start").agg(last)
    above = ends.where(F.col("bits") < root).withColumn("level", F.explode(F.expr(f"sequence(bits, {root})")))
    above = above.withColumn("cell", F.expr("shiftright(start, level)")).where((F.col("level") == root) | (F.col("cell") % 2 == 0))
    above = above.groupBy("client_id", "level", "cell").agg(F.max("last").alias("last"))
    whole = ends.where(F.col("bits") == root).select("client_id", F.lit(root).alias("level"), _shift("start", root).alias("cell"), "last")
    asked = shards.withColumn("level", F.explode(F.expr(f"sequence(bits, {root})"))).withColumn("cell", F.expr("shiftright(start, level)"))
    asked = asked.where((F.col("level") == root) | (F.col("cell") % 2 != 0)).withColumn("cell", F.col("cell") - 1)
    got = asked.join(whole.unionByName(above), ["client_id", "level", "cell"])
    return got.select("client_id", "start", "salts", "last.*").where(F.col("t") >= F.col("start") - tolerance)


def matched(clicks: DataFrame, orders: DataFrame, tolerance_us: int, rows: int = 5_000) -> DataFrame:
    """Clicks (click_id, client_id, ts_us) with sale_id, lag_us, total_cents and n_tied of their order.

    ``orders`` has client_id, t, sale_id and total_cents, a row for each order.
    """
    spark = clicks.sparkSession
    root = max(1, (max(1, tolerance_us) - 1).bit_length())
    best = F.max(F.struct("total_cents", "sale_id")).alias("best")
    orders = orders.where(F.col("client_id").isNotNull() & F.col("t").isNotNull()).groupBy("client_id", "t").agg(F.count("*").alias("n"), best)
    orders = saved(orders.select("client_id", "t", "n", "best.*"), "asof-orders")
    clicks = saved(clicks.select("click_id", "client_id", F.col("ts_us").alias("t")), "asof-clicks")
    known = clicks.where(F.col("client_id").isNotNull() & F.col("t").isNotNull())
    cut = _cut(orders, root, rows)
    orders, known = _placed(orders, root, cut), _placed(known, root, cut)

    shards = known.groupBy("client_id", "bits", "start").agg(F.count("*").alias("n"))
    shards = saved(shards.select("client_id", "bits", "start", F.ceil(F.col("n") / rows).cast("int").alias("salts")), "asof-shards")
    busy = _Small(shards.where(F.col("salts") > 1).select("client_id", "start", "salts"), "asof-busy")

    def salts(df: DataFrame) -> DataFrame:
        df = df.join(busy(), ["client_id", "start"], "left") if busy.n else df.withColumn("salts", F.lit(None).cast("int"))
        return df.withColumn("salts", F.coalesce("salts", F.lit(1)))

    n = clicks.count() + orders.count()
    buckets = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // BUCKET_ROWS)
    dealt = F.pmod(F.xxhash64("client_id", "start", "salt"), F.lit(buckets)).alias("bucket")
    left = salts(known).withColumn("salt", F.pmod(F.xxhash64("click_id", "t"), F.col("salts")).cast("int"))
    left = left.select(dealt, "client_id", "start", "salt", "click_id", "t")
    names = ["client_id", "start", "t", "n", "total_cents", "sale_id", "salts"]
    right = salts(orders).select(*names).unionByName(_halos(shards, orders, root, tolerance_us).select(*names))
    right = right.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).select(dealt, *names[:-1], "salt")
    got = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(_bucket(tolerance_us), OUT)

    nothing = [F.lit(None).cast("long").alias(c) for c in ("sale_id", "lag_us", "total_cents")]
    rest = clicks.where(F.col("client_id").isNull() | F.col("t").isNull())
    return got.unionByName(rest.select("click_id", "client_id", F.col("t").alias("ts_us"), *nothing, F.lit(0).cast("long").alias("n_tied")))


def report(clicks: DataFrame, sales: DataFrame, hours: int = 720, rows: int = 5_000) -> DataFrame:
    return matched(prepared_clicks(clicks), prepared_orders(sales), hours * HOUR, rows)
