"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

DataFrame functions only. Words are runs of ASCII letters, digits and all
non-ASCII characters, with A-Z lower-cased. An item gives every window of
``n`` consecutive words; an item of fewer words (but not none) is one window.

The hashes of all benchmark windows are broadcast as a hash set (with each
window's words and items). Each document is read once: in stretches of ``STRETCH``
words its windows are hashed, and the 8-byte hashes are looked up in the set, so
only windows that hit go on and the work is in proportion to a text's length. A
hit is then verified word for word. The size of the set is checked: of a suite of
more than ``max_broadcast`` windows only the hashes are broadcast, and hits get
their words and items by a shuffled join; more than ``HASHES_A_WINDOW`` times as
many go in parts by hash, with a pass over the documents for each. Nothing of the
documents is shuffled but hits.

Defined cases: null or empty text, or text without words, has no words and no
hit. A null item text gives no window; rows with a null item_id are ignored.
Repeated item_ids count once; repeated documents are each judged. Long texts
are scanned whole. Columns other than the named ones are never read by name.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise.llm.common import ascii_lower, fixed, saved

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same before A-Z are lower-cased.
RAW_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Windows (and items of theirs) that may be sent to every task at once.
MAX_BROADCAST_WINDOWS = 200_000
#: So many bare hashes stand for a window with its words and items.
HASHES_A_WINDOW = 20
#: Words of a text that go together.
STRETCH = 64
#: Contaminated documents (id, hash, spans) whose rows may be sent to every task.
MAX_BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    found = F.array_remove(F.split(ascii_lower(text), GAP + "+"), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(w_key, w_words, w_len, w_items): each distinct window with its sorted items."""
    base = benchmark.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")
    )
    size = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
    return (
        base.where(size > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("w"))
        .groupBy(F.array_join("w", " ").alias("w_words"), F.size("w").alias("w_len"))
        .agg(F.array_sort(F.collect_set("item")).alias("w_items"), F.xxhash64(F.first("w")).alias("w_key"))
    )


def _hits(docs: DataFrame, windows: DataFrame, max_broadcast: int) -> DataFrame:
    """A row for each verified hit of a document, and one at least for each document.

    ``docs`` has ``row_no``, ``w`` and further columns, which are kept. A text goes as
    stretches of ``STRETCH`` words (and what a window that begins in one may reach
    beyond), so what stands beside each hash is short however long the text is.
    """
    keep = [c for c in docs.columns if c != "w"]
    lengths = sorted(r[0] for r in windows.select("w_len").distinct().collect())  # n values at most
    if not lengths:
        return docs.select(*keep, F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("w_len"),
                           F.lit(None).cast("array<string>").alias("w_items"))
    weight = windows.agg(F.sum(1 + F.size("w_items"))).first()[0]
    whole = max_broadcast > 0 and weight <= 2 * max_broadcast
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(STRETCH))
    stretch = F.transform(starts, lambda i: F.struct(i.alias("off"), F.slice("w", i + 1, STRETCH + lengths[-1] - 1).alias("v")))
    rows = docs.select(*keep, F.explode(stretch).alias("s")).select(*keep, "s.off", "s.v")
    # One array of hashes: of the windows of the least length by their starts, then of the next. ``nth`` tells length and start.
    none = F.array().cast("array<bigint>")

    def begin(length: int) -> Column:
        """Windows of a length that begin in the stretch."""
        return F.greatest(F.least(F.lit(STRETCH), F.size("v") - length + 1), F.lit(0))

    def hashed(length: int):
        return lambda i: F.xxhash64(F.slice("v", i, length))

    hashes = [F.when(begin(k) > 0, F.transform(F.sequence(F.lit(1), begin(k)), hashed(k))).otherwise(none) for k in lengths]
    rows = rows.select(*keep, "off", "v", F.posexplode_outer(F.concat(*hashes)).alias("nth", "hash"))
    before, length, at = F.lit(0), F.lit(lengths[0]), F.col("nth") + 1
    for k, longer in zip(lengths[:-1], lengths[1:], strict=True):
        before = before + begin(k)
        length = F.when(F.col("nth") >= before, longer).otherwise(length)
        at = F.when(F.col("nth") >= before, F.col("nth") - before + 1).otherwise(at)
    first = (F.col("off") == 0) & (F.coalesce("nth", F.lit(0)) == 0)  # so that each document has a row
    if whole:
        found = rows.join(F.broadcast(windows), F.col("hash") == F.col("w_key"), "left").where(F.col("w_key").isNotNull() | first)
    else:
        found = _of_many(rows.withColumn("first", first), windows, max_broadcast)
    same = F.array_join(F.slice("v", at, length), " ") == F.col("w_words")  # null where the hash is in no window
    found = found.withColumn("same", F.coalesce(same, F.lit(False)))
    told = ((F.col("off") + at).cast("int"), "at"), (F.col("w_len"), "w_len"), (F.col("w_items"), "w_items")
    return found.select(*keep, *[F.when(F.col("same"), c).alias(name) for c, name in told])


def _of_many(rows: DataFrame, windows: DataFrame, max_broadcast: int) -> DataFrame:
    """``rows`` with their windows where the suite is large: bare hashes are broadcast, ``HASHES_A_WINDOW`` times as many, and what they let through is joined by shuffle."""
    keys = windows.select("w_key").distinct()
    parts = -(-keys.count() // max(1, HASHES_A_WINDOW * max_broadcast))
    out = []
    for part in range(parts):
        held = F.broadcast(keys.where(F.pmod("w_key", F.lit(parts)) == part).withColumn("known", F.lit(True)))
        found = rows.join(held, F.col("hash") == F.col("w_key"), "left").drop("w_key")
        out.append(found.where(F.col("known") | F.col("first") if not part else F.col("known")).drop("known"))
    return functools.reduce(DataFrame.unionByName, out).join(windows, F.col("hash") == F.col("w_key"), "left").drop("first")


def judge(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    max_broadcast: int = MAX_BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document: id, n_words, spans [(at, end)] of hit words (1-based, inclusive, disjoint), n_hit, items."""
    windows = saved(benchmark_windows(benchmark, n, item_id_col, item_text_col), "decontaminate-windows")
    base = fixed(docs).select(
        F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("key"), words(F.col(text_col)).alias("w")
    ).withColumn("n_words", F.size("w").cast("long"))
    found = (
        _hits(base, windows, max_broadcast)
        .groupBy("row_no", "key")
        .agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(
                F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", (F.col("at") + F.col("w_len") - 1).alias("end"))))
            ).alias("all"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("w_items")))).alias("items"),
        )
    )
    merged = F.expr(
        """aggregate(all, cast(array() as array<struct<at:int,end:int>>), (m, x) ->
             if(size(m) > 0 and x.at <= element_at(m, -1).end + 1,
                concat(slice(m, 1, size(m) - 1),
                       array(named_struct('at', element_at(m, -1).at, 'end', greatest(element_at(m, -1).end, x.end)))),
                concat(m, array(x))))"""
    )
    return found.withColumn("spans", merged).select(
        F.col("key").alias(id_col),
        "n_words",
        "spans",
        F.expr("cast(aggregate(spans, 0, (t, x) -> t + x.end - x.at + 1) as bigint)").alias("n_hit"),
        "items",
        "row_no",
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "document", id_col: str = "doc_id", text_col: str = "text", **names
) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="span"``) without the hit words.

    Removal by document keeps every column of the rows that stay. Removal by
    span cuts each hit word with the gap after it. Documents are matched to
    their verdict by (id, text), so equal rows share one verdict.
    """
    names_of = {f"c{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names_of)
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    mark = rows.select(F.struct(F.col(key).alias("k"), F.xxhash64(F.col(text).cast("string")).alias("h")).alias("kh"), F.col(text).alias("t"))
    hit = judge(mark, benchmark, n, "kh", "t", **names).where("n_hit > 0")
    hit = hit.groupBy("kh").agg(F.first("spans").alias("spans")).select("kh.k", "kh.h", "spans")
    hit = saved(hit, "decontaminate-hits")
    if hit.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        hit = F.broadcast(hit)
    on = rows[key].eqNullSafe(hit["k"]) & (F.xxhash64(rows[text].cast("string")) == hit["h"])
    if remove == "document":
        return rows.join(hit, on, "left_anti").select(*[F.col(k).alias(c) for k, c in names_of.items()])
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"^[{RAW_GAP}]+|[^{RAW_GAP}]+[{RAW_GAP}]*"), F.lit(0))
    lead = F.when(F.col(text).rlike(f"^[{RAW_GAP}]"), 0).otherwise(1)
    cut = F.array_join(F.filter(pieces, lambda p, i: ~F.exists("spans", lambda s: (i + lead >= s["at"]) & (i + lead <= s["end"]))), "")
    joined = rows.join(hit, on, "left")
    return joined.select(*[F.when(F.col("spans").isNull(), F.col(k)).otherwise(cut).alias(c) if k == text else F.col(k).alias(c) for k, c in names_of.items()])


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The digest per document: counts, the items' hash and the verdict."""
    return judge(docs, benchmark, n).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
