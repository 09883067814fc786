"""The tolerant as-of join against brute force: cut cells, salted shards, ties, nulls, copies."""

import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tonewise.llm import asof
from tonewise.llm.asof import HOUR

CLICKS = "click_id long, client_id long, ts_us long, start long, n long"
ORDERS = "client_id long, t long, sale_id long, total_cents long, salts int"


def brute(clicks, orders, tolerance):
    out = []
    for cid, client, t, *_ in clicks:
        mine = [] if client is None or t is None else [o for o in orders if o[0] == client and o[1] is not None and t - tolerance <= o[1] <= t]
        if mine:
            at = max(o[1] for o in mine)
            tied = [o for o in mine if o[1] == at]
            best = max(tied, key=lambda o: tuple((x is not None, x or 0) for x in (o[3], o[2])))
            out.append((cid, client, t, best[2], t - at, best[3], len(tied)))
        else:
            out.append((cid, client, t, None, None, None, 0))
    return sorted(out, key=repr)


def found(spark, clicks, orders, tolerance, rows):
    got = asof.matched(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(orders, ORDERS), tolerance, rows)
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize(("tolerance", "span", "rows"), [(1_000, 8_000, 3), (0, 30, 4), (300, 1_000_000, 2)])
def test_by_brute_force(spark, tolerance, span, rows):
    rng = random.Random(span)
    some = lambda x, p=0.04: None if rng.random() < p else x
    client = lambda: some(rng.choice([7, 7, 7, rng.randrange(9)]))
    burst = rng.randrange(span)
    time = lambda: some(rng.choice([rng.randrange(span), burst + rng.randrange(40), burst]))
    clicks = [(i, client(), time(), 0, 0) for i in range(400)]
    orders = [(client(), time(), some(rng.randrange(-200, 200)), some(rng.randrange(5)), 0) for _ in range(500)]
    assert found(spark, clicks, orders, tolerance, rows) == brute(clicks, orders, tolerance)


def test_broadcast_and_shuffle_agree(spark, monkeypatch):
    rng = random.Random(5)
    clicks = [(i, 1, rng.randrange(5_000), 0, 0) for i in range(200)]
    orders = [(1, rng.randrange(5_000), i, 0, 0) for i in range(200)]
    want = found(spark, clicks, orders, 400, 3)
    monkeypatch.setattr(asof, "BROADCAST_ROWS", 0)
    assert found(spark, clicks, orders, 400, 3) == want == brute(clicks, orders, 400)


def test_empty(spark):
    click = (1, 2, 3, 0, 0)
    assert found(spark, [], [], 10, 5) == []
    assert found(spark, [click], [], 10, 5) == [(1, 2, 3, None, None, None, 0)]
    assert found(spark, [], [(2, 3, 1, 1, 0)], 10, 5) == []


def test_prepared_rows(spark):
    """Folding, second orders, copies, nulls and totals that are no numbers, against the plain rule."""
    day = 86_400_000_000
    names = "click_id long, client_id long, at long, n int"
    raw = [(1, 5, 3 * day + 7, 0), (1, 5, 3 * day + 7, 1), (2, None, day, 0), (3, 5, None, 0), (None, 4, 9, 0), (None, 4, 9, 0), (None, 5, 9, 0), (-1, 1, -5, 0)]
    ts = F.timestamp_micros("at")
    got = {tuple(r) for r in asof.prepared_clicks(spark.createDataFrame(raw, names).withColumn("ts", ts)).collect()}

    def fold(i, t):
        return t - t % (6 * HOUR) if i is not None and t is not None and crc32(str(i).encode()) % 2 else t

    assert got == {(i, c, fold(i, t)) for i, c, t, _ in raw}

    sales = [(i, 1, i * HOUR, 0.1 * i, 2 if i % 2 else None) for i in range(40)] + [(None, 1, 5, float("nan"), 3), (90, None, None, None, 1)]
    df = spark.createDataFrame(sales, "sale_id long, client_id long, at long, total double, priority int").withColumn("sold_at", ts)
    got = sorted(map(tuple, asof.prepared_orders(df).collect()), key=repr)
    want = []
    for i, c, t, total, p in sales:
        cents = None if total is None or total != total else int(100 * total + 0.5)
        want.append((c, fold(i, t), i, cents, p))
        if i is not None and crc32(str(i).encode()) % 3:
            want.append((c, fold(i, t), -1 - i, cents, None if p is None else 6 - p))
    assert got == sorted(want, key=repr)


def test_times_do_not_depend_on_the_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 02:30:00.000123' AS ts UNION ALL SELECT TIMESTAMP_NTZ '1969-12-31 23:59:59.5'")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert [r[0] for r in df.select(asof.micros(F.col("ts"))).collect()] == [1_711_852_200_000_123, -500_000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
