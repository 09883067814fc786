"""Sharding by k-d tree partitioning.

DataFrame functions only. The rows' byte sizes are split at distributed
weighted medians, always along the widest of the dimensions (log size, bytes
per character, share of spaces), until every leaf holds its target bytes. A
median is found digit by digit: sums of bytes by the next 16 bits of the order
key, of which only the crossing digit is kept, so neither rows nor values are
gathered. Order keys end in bits of the text's hash: equal texts have the same
key in every dimension and stay together. Where a median falls into a group of
equal texts, and leaving it on either side would miss the median by more than
``slack`` of a leaf, the whole group goes left and the median of the other rows
is taken for what is then missing. Only a group larger than a leaf is cut among
its rows.

Rows are numbered in two levels (hash buckets of bounded size, then rows).

Defined cases: a null text has size 1 and the crc of no bytes, like an empty
one. Repeated rows and ids are placed one by one. An empty table gives no rows.
Texts are measured whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewise.llm.common import discard, fixed, saved

BUCKET_ROWS = 50_000
DIMS = ("k_size", "k_width", "k_spaces")
DIGIT, DIGITS = 16, 4


def _digit(key: Column, i: int) -> Column:
    """The i-th 16 bits of a key of 63 bits, highest first."""
    return F.shiftrightunsigned(key, DIGIT * (DIGITS - 1 - i)).bitwiseAND(F.lit((1 << DIGIT) - 1))


def _of(values: dict[int, int], kind: str = "bigint") -> Column:
    """The value of the row's node; nodes are as many as shards at most."""
    pairs = [F.lit(x).cast(t) for item in values.items() for x, t in zip(item, ("int", kind), strict=True)]
    return F.try_element_at(F.create_map(*pairs), F.col("node"))


def _select(rows: DataFrame, targets: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """For each node its least key at which the running sum of weights passes the target: (key, sum before, sum at key).

    ``rows`` has node, key, weight; a node without rows has no answer.
    """
    prefix, below, at = dict.fromkeys(targets, 0), dict.fromkeys(targets, 0), {}
    for i in range(DIGITS):
        head = F.shiftrightunsigned(F.col("key"), DIGIT * (DIGITS - i)) if i else F.lit(0)
        bins = rows.where(head == _of(prefix)).groupBy("node", _digit(F.col("key"), i).alias("digit")).agg(F.sum("weight").alias("w"))
        node = Window.partitionBy("node")  # 65,536 bins a node at most
        bins = bins.withColumn("run", F.sum("w").over(node.orderBy("digit"))).withColumn("last", F.max("digit").over(node))
        cross = bins.where((F.col("run") + _of(below) > _of(targets)) | (F.col("digit") == F.col("last")))
        for r in cross.groupBy("node").agg(F.min(F.struct("digit", "run", "w")).alias("x")).collect():  # a row a node
            n, x = r["node"], r["x"]
            prefix[n] = (prefix[n] << DIGIT) | x["digit"]
            below[n] += x["run"] - x["w"]
            at[n] = x["w"]
    return {n: (prefix[n], below[n], at[n]) for n in at}


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The compact table that all cuts read: ids, sizes and an order key for each dimension."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    chars = F.char_length(text)
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.log2(size.cast("double")).alias("size_at"),
        ((size - 1) / F.greatest(chars, F.lit(1))).alias("width_at"),
        ((chars - F.char_length(F.replace(text, F.lit(" "), F.lit("")))) / F.greatest(chars, F.lit(1))).alias("spaces_at"),
        F.xxhash64(text).bitwiseAND(F.lit(2**32 - 1)).alias("text_hash"),
    )
    spans = {"size_at": 31.0, "width_at": 4.0, "spaces_at": 1.0}
    keys = [
        F.shiftleft(F.floor(F.least(F.col(c) / span, F.lit(1.0)) * (2**31 - 1)).cast("long"), 32)
        .bitwiseOR(F.col("text_hash"))
        .alias(k)
        for k, (c, span) in zip(DIMS, spans.items(), strict=True)
    ]
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "rid"), 1).alias("own")
    return saved(base.select("rid", "doc_id", "size", "text_crc32", own, *keys), "sharding-rows")


def leaves(rows: DataFrame, shards: int, slack: float = 0.002) -> DataFrame:
    """``rows`` with their shard, 0 to ``shards`` - 1."""
    rows = rows.withColumn("node", F.lit(1))
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = {1: (0, shards)}  # of each node: its first leaf and their number
    while any(n > 1 for _, n in parts.values()):
        stats = rows.groupBy("node").agg(F.sum("size").alias("w"), *[(F.max(k) - F.min(k)).alias(k) for k in DIMS]).collect()
        weight = {r["node"]: r["w"] for r in stats}
        goals = {n: weight[n] * (p // 2) // p for n, (_, p) in parts.items() if p > 1 and n in weight}
        if not goals:
            break
        widest = _of({r["node"]: max(range(len(DIMS)), key=lambda i, r=r: r[DIMS[i]]) for r in stats})
        key = F.col(DIMS[0])
        for i, k in enumerate(DIMS[1:], 1):
            key = F.when(widest == i, F.col(k)).otherwise(key)
        keyed = rows.withColumn("key", key)
        cuts = _select(keyed.select("node", "key", F.col("size").alias("weight")), goals)
        leaf, held = total / shards, {}

        def misses(n: int, cuts=cuts, goals=goals, leaf=leaf) -> bool:
            return min(goals[n] - cuts[n][1], sum(cuts[n][1:]) - goals[n]) > slack * leaf

        whole = {n for n in cuts if misses(n) and cuts[n][2] <= leaf}
        if whole:  # such groups are set aside, and the cut is sought among the other rows
            held = {n: cuts[n][0] for n in whole}
            aside = {n: int(cuts[n][2] <= goals[n]) for n in whole}  # to the left, where that has room
            rest = {n: goals[n] - aside[n] * cuts[n][2] for n in whole}
            again = _select(keyed.where(F.col("key") != _of(held)).select("node", "key", F.col("size").alias("weight")), rest)
            goals |= rest
            cuts.update({n: again.get(n, (0, 0, 0)) for n in whole})
        tight = {n: goals[n] - x[1] for n, x in cuts.items() if misses(n) and x[2] > leaf}
        at = _of({n: k for n, (k, _, _) in cuts.items()})
        inner = {}
        if tight:
            group = keyed.where((F.col("key") == at) & _of(dict.fromkeys(tight, 1)).isNotNull())
            inner = _select(group.select("node", F.col("own").alias("key"), F.col("size").alias("weight")), tight)
        # Of the group at the cut, the rows whose own key is below this go left: all, none, or those up to the inner cut.
        own = {n: inner[n][0] if n in tight else 2**63 - 1 if 2 * (goals[n] - x[1]) >= x[2] else 0 for n, x in cuts.items()}
        left = (F.col("key") < at) | ((F.col("key") == at) & (F.col("own") < _of(own)))
        if held:
            left = F.when(F.col("key") == _of(held), _of(aside) == 1).otherwise(left)
        step = F.when(at.isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 0).otherwise(1))
        placed = saved(keyed.withColumn("node", step.cast("int")).drop("key"), "sharding-level")
        if len(parts) > 1:
            discard(rows)
        rows = placed
        for n in goals:
            start, p = parts.pop(n)
            parts[2 * n], parts[2 * n + 1] = (start, p // 2), (start + p // 2, p - p // 2)
        parts = {n: x for n, x in parts.items() if x[1] == 1 or n // 2 in goals}
    return rows.withColumn("shard", F.coalesce(_of({n: start for n, (start, _) in parts.items()}), F.lit(0)).cast("int")).drop("node")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a gapless slot within each shard."""
    sizes = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a shard
    many = F.lit(1)
    if any(n > BUCKET_ROWS for n in sizes.values()):
        pairs = [F.lit(x) for s, n in sizes.items() for x in (s, -(-n // BUCKET_ROWS))]
        many = F.try_element_at(F.create_map(*pairs), F.col("shard"))
    keyed = rows.withColumn("bucket", F.pmod(F.col("own"), many))
    before = keyed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    before = before.select("shard", "bucket", run.alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("own", "rid"))
    return keyed.withColumn("inside", inside).join(before, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("inside") - 1)


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, size, text_crc32, shard, slot); ``rid`` numbers the rows of ``docs`` as they are read."""
    return numbered(leaves(measured(docs, id_col, text_col), shards)).select("rid", "doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet, a folder ``shard=N`` for each shard; a column ``slot`` is added.

    Columns of ``docs`` keep their names; one that is called shard or slot is written as ``own_shard`` or ``own_slot``.
    """
    docs = fixed(docs)
    place = assign(docs, shards, id_col, text_col).select("rid", "shard", "slot")
    names = {f"c{i}": f"own_{c}" if c in ("shard", "slot") else c for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names).withColumn("rid", F.monotonically_increasing_id()).join(place, "rid")
    rows.select(*[F.col(k).alias(c) for k, c in names.items()], "slot", "shard").write.partitionBy("shard").parquet(path)


def report(docs: DataFrame) -> DataFrame:
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
