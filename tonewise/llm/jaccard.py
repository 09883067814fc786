"""N-gram Jaccard join by vertical partitioning.

A document's set holds its distinct ``n``-word shingles (A-Z lower-cased,
words split at ASCII white space; fewer words: the whole sequence as one).
Two documents link when ``100 * |x & y| >= pct * |x | y|``.

Shingles are 64-bit hashes, and their global order is cut into fragments, as many
as a shuffle has partitions. Linked sets share at least pct% of either's
shingles. So first each fragment counts, for each set, the shingles that any other
set has as well, and the partial counts are summed per set: sets that share too
few with all others together can't link, whatever the partner, and fall away. A
map task sends what only one of its sets has, five bytes a shingle, and one witness
of what several have, so a common shingle costs a task one row.

What is left is ordered anew, rare first: by the power of two of a shingle's
frequency, then by hash. Frequencies are counted over all sets that are left, into
``CELLS`` counters that shingles share by hash, so the table has a fixed size;
any order that all sets agree on gives the same links. Linked sets share a
shingle among the first ``|x| - ceil(pct% of |x|) + 1`` of each in that order.
Sets that meet in such a shingle are tied to one of them (first inside a map
task, then per shingle), so a shingle of k sets gives k - 1 rows. Tied sets
form candidate groups, cut into blocks of bounded size. In a task the overlaps
of all pairs of a block are counted fragment by fragment of the order of their
common shingles, and the partial counts are summed per pair; only a spanning
forest of the pairs that link leaves the task. A group of one block is done then.
Of a larger one, one set of each component so far is compared with the others';
only if the group still has several components do its blocks meet each other
(equal and neighbouring size bands).

Equal sets share one hash and are collapsed before any of this.

Defined cases: null, empty or blank text has an empty set and links with
nothing. Null ids are kept; a component is named by its smallest non-null id.
Repeated rows are equal sets; ``one_of_each`` keeps one of them. Texts are used
whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewise.llm.common import components, discard, in_arrow, saved
from tonewise.llm.hashing import WordHashes, mix, mix1

#: Counters of the frequency table, the parts that they are summed in, and the first sums of a part.
CELLS, PARTS, SUMS = 1 << 22, 16, 256
#: Shingles that a map task gathers before it reduces them.
FLUSH_ROWS = 600_000
#: A block of a candidate group holds about so many shingles and sets at most.
BLOCK_SHINGLES, BLOCK_SETS = 1_000_000, 2_048
#: A fragment of the order has so many shingles when overlaps are counted.
FRAGMENT = 2_048
#: Rows of a few numbers that may be broadcast.
MAX_BROADCAST_ROWS = 200_000


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    if not text:
        return np.empty(0, np.uint64)
    h = hashes.of(text.encode().lower().split())
    if not len(h):
        return np.empty(0, np.uint64)
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, np.uint64(m * 0x9E3779B97F4A7C15 % 2**64))
    for i in range(m):
        out = mix1(out + h[i : len(h) - m + 1 + i])
    return np.unique(out)


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(mix1(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The sets of an Arrow list column."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, s) -> (part, sums, c): the task's counters, packed, where a part has any."""
    total = np.zeros(CELLS, np.uint32)
    first = 0
    for b in batches:
        if b.num_rows:
            first = first or b.column("sid")[0].as_py()
            flat = np.concatenate(_arrays(b.column("s")))
            for i in range(0, len(flat), FLUSH_ROWS):
                total += np.bincount(_cell(flat[i : i + FLUSH_ROWS]), minlength=CELLS).astype(np.uint32)
    for i, part in enumerate(total.reshape(PARTS, -1)):
        if part.any():
            yield _packed(i, first % SUMS, part)


def _packed(part: int, sums: int, counts: np.ndarray) -> pa.RecordBatch:
    c = pa.compress(counts.astype("<u4").tobytes(), codec="lz4", asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums], pa.int32()), pa.array([c], pa.binary())], names=["part", "sums", "c"])


def _sum(group: pa.Table) -> pa.Table:
    """Counters of one part, added up; no sum goes beyond 32 bits."""
    total = np.zeros(CELLS // PARTS, np.uint64)
    for c in group.column("c"):
        total += np.frombuffer(pa.decompress(c.as_py(), decompressed_size=4 * len(total), codec="lz4", asbytes=True), "<u4")
    return pa.Table.from_batches([_packed(group.column("part")[0].as_py(), group.column("sums")[0].as_py(), np.minimum(total, 2**32 - 1))])


def frequencies(sets: DataFrame) -> np.ndarray:
    """For each cell the power of two of how many sets have its shingles: ``CELLS`` bytes, whatever the input."""
    rows = in_arrow(sets, _count, "part int, sums int, c binary")
    for keys in (("part", "sums"), ("part",)):
        rows = rows.groupBy(*keys).applyInArrow(_sum, "part int, sums int, c binary")
    out = np.zeros((PARTS, CELLS // PARTS), np.uint8)
    for r in rows.collect():  # a row a part
        counts = np.frombuffer(pa.decompress(r["c"], decompressed_size=4 * out.shape[1], codec="lz4", asbytes=True), "<u4")
        out[r["part"]] = np.frexp(counts.astype(np.float64))[1]
    return out.ravel()


def prefix(s: np.ndarray, pct: int, power: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order: so many that linked sets share one."""
    many = len(s) - -(-pct * len(s) // 100) + 1
    return s[np.argsort(power[_cell(s)], kind="stable")[:many]]


def _forest(member: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Reduce (key, member) rows: (keys, their first member), and (first, other) ties."""
    order = np.lexsort((member, key))
    key, member = key[order], member[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = member[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = member != first
    pairs = np.unique(np.stack([first[other], member[other]], 1), axis=0) if other.any() else np.empty((0, 2), np.int64)
    return key[new], member[new], pairs[:, 0], pairs[:, 1]


SCAN = "part int, h long, id long, sid long, n long, c long, blob binary"
SHARED = "part int, h long, id long, sid long, n long, blob binary"


def _batch(schema: str, rows: int, **columns) -> pa.RecordBatch:
    """A batch of the given columns, the others null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    made = [pa.array(columns[c], kinds[t]) if c in columns else pa.nulls(rows, kinds[t]) for c, t in zip(names, types, strict=True)]
    return pa.RecordBatch.from_arrays(made, names=names)


def _scan(n: int, fragments: int):
    """(h, id, text) -> documents (h, id, sid, n), shared shingles (sid, c) and, by fragment (part), what only one set of the task has (blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        sets: dict[int, np.ndarray] = {}
        held = seen = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sids = np.array([*sets, 0], np.int64)
            sids[-1] = mix1(sids[:1].view(np.uint64)).view(np.int64)[0]  # stands for the witnesses
            flat = np.concatenate(list(sets.values()))
            at = np.repeat(np.arange(len(sets)), [len(s) for s in sets.values()])
            order = np.argsort(flat, kind="stable")
            flat, at = flat[order], at[order]
            first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
            many = np.diff(np.append(first, len(flat))) > 1
            shared = np.bincount(at[np.repeat(many, np.diff(np.append(first, len(flat))))], minlength=len(sets))
            some = np.flatnonzero(shared)
            yield _batch(SCAN, len(some), part=sids[some] % fragments, sid=sids[some], c=shared[some])
            flat, at = flat[first], np.where(many, len(sets), at[first])
            part = ((flat >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((at, part))
            flat, at, part = flat[order], at[order], part[order]
            low = flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            cuts = np.searchsorted(part, np.arange(fragments + 1))
            parts, blobs = np.flatnonzero(np.diff(cuts)), []
            for p in parts:
                i, j = cuts[p], cuts[p + 1]
                mine, count = np.unique(at[i:j], return_counts=True)
                blobs.append(np.uint32(len(mine)).tobytes() + sids[mine].tobytes() + count.astype("<u4").tobytes() + low[i:j].tobytes())
            for i in range(0, len(parts), 64):
                yield _batch(SCAN, len(parts[i : i + 64]), part=parts[i : i + 64], blob=blobs[i : i + 64])

        for b in batches:
            sid, size = [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, n, hashes)
                sid.append(set_id(s))
                size.append(len(s))
                if len(s) and sid[-1] not in sets:
                    sets[sid[-1]] = s
                    held += len(s)
                if held >= FLUSH_ROWS:
                    yield from flush()
                    sets, held = {}, 0
            sid = np.array(sid, np.int64)
            seen += len(sid)
            yield _batch(SCAN, len(sid), part=(seen + np.arange(len(sid))) % fragments, h=b.column("h"), id=b.column("id"), sid=sid, n=size)
        if sets:
            yield from flush()

    return run


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes (40 bits) and sets of a blob."""
    m = int(np.frombuffer(blob, "<u4", 1)[0])
    sids, count = np.frombuffer(blob, "<i8", m, 4), np.frombuffer(blob, "<u4", m, 4 + 8 * m)
    low = np.frombuffer(blob, np.uint8, -1, 4 + 12 * m).reshape(-1, 5)
    whole = np.zeros((len(low), 8), np.uint8)
    whole[:, :5] = low
    return whole.view("<u8").ravel(), np.repeat(sids, count)


def _shared(fragments: int):
    """Pass documents; of the blobs of a fragment count for each set the shingles that another set has as well: (part, blob) of sets and counts, by set."""

    def packs(sids: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = sids % fragments
        order = np.argsort(part, kind="stable")
        sids, count, part = sids[order], count[order].astype("<i8"), part[order]
        cuts = np.searchsorted(part, np.arange(fragments + 1))
        parts = np.flatnonzero(np.diff(cuts))
        for i in range(0, len(parts), 64):
            mine = parts[i : i + 64]
            yield _batch(SHARED, len(mine), part=mine, blob=[sids[cuts[p] : cuts[p + 1]].tobytes() + count[cuts[p] : cuts[p + 1]].astype("<u4").tobytes() for p in mine])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        names = [c.split()[0] for c in SHARED.split(", ")]
        for b in batches:
            packed, counted = b.column("blob").is_valid(), b.column("c").is_valid()
            yield b.filter(pa.compute.invert(pa.compute.or_(packed, counted))).select(names)
            told = b.filter(counted)
            if told.num_rows:
                yield from packs(told.column("sid").to_numpy(), told.column("c").to_numpy())
            b = b.filter(packed)
            for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist(), strict=True):
                blobs.setdefault(part, []).append(blob)
        for part in list(blobs):
            h, sid = (np.concatenate(x) for x in zip(*map(_unpacked, blobs.pop(part)), strict=True))
            order = np.lexsort((sid, h))
            h, sid = h[order], sid[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            own = new | np.concatenate(([True], sid[1:] != sid[:-1]))
            new, sid = new[own], sid[own]
            size = np.diff(np.append(np.flatnonzero(new), len(new)))
            yield from packs(*np.unique(sid[np.repeat(size > 1, size)], return_counts=True))

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (blob) of the task's sets -> (sid, c): summed per set."""
    sids, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for b in batches:
        for blob in b.column("blob").to_pylist():
            m = len(blob) // 12
            sids.append(np.frombuffer(blob, "<i8", m))
            counts.append(np.frombuffer(blob, "<u4", m, 8 * m).astype(np.int64))
    sid, at = np.unique(np.concatenate(sids), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(sid)).astype(np.int64)
    for i in range(0, len(sid), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(sid[i : i + 50_000]), pa.array(total[i : i + 50_000])], names=["sid", "c"])


def _sets(n: int):
    """(sid, n, text) -> (sid, n, s): the shingles, once a task for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = WordHashes(), set()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows, lists = [], []
                for i, sid in enumerate(part.column("sid").to_pylist()):
                    if sid not in done:
                        done.add(sid)
                        rows.append(i)
                        lists.append(shingles(part.column("text")[i].as_py(), n, hashes).view(np.int64))
                if len(done) > FLUSH_ROWS:
                    done.clear()
                offsets = np.cumsum([0, *map(len, lists)])
                flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
                keep = part.select(["sid", "n"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*keep.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["sid", "n", "s"])

    return run


TIES = "k long, a long, tie boolean"


def _meet(pct: int, power: np.ndarray):
    """(sid, s) -> shingles of prefixes (k, a set), and ties of sets (k other, a first, tie)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, first, x, y = _forest(np.concatenate(sets), np.concatenate(keys).view(np.int64))
            for k, a, tie in ((key, first, False), (y, x, True)):
                for i in range(0, len(k), 50_000):
                    part = k[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(a[i : i + 50_000]), pa.array(np.full(len(part), tie))], names=["k", "a", "tie"])

        for b in batches:
            for sid, s in zip(b.column("sid").to_pylist(), _arrays(b.column("s")), strict=True):
                keys.append(prefix(s, pct, power))
                sets.append(np.full(len(keys[-1]), sid, np.int64))
                held += len(keys[-1])
                if held >= FLUSH_ROWS:
                    yield from flush()
                    keys, sets, held = [], [], 0
        if keys:
            yield from flush()

    return run


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the ties (k, a) of a task leave a spanning forest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def forest() -> pa.RecordBatch:
        ties = [(x, find(x)) for x in list(parent)]
        ties = [t for t in ties if t[0] != t[1]]
        return pa.RecordBatch.from_arrays([pa.array([t[i] for t in ties], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for b in batches:
        for x, y in zip(b.column("k").to_pylist(), b.column("a").to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > FLUSH_ROWS // 4:
            yield forest()
            parent.clear()
    yield forest()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each left and right set share: partial counts for each fragment of the order, summed."""
    total = np.zeros((len(left), len(right)))
    flat = [np.concatenate(left), np.concatenate(right)]
    if left is right:
        values, times = np.unique(flat[0], return_counts=True)
        common = values[times > 1] if len(left) > 1 else values
    else:
        common = np.intersect1d(*flat)
    held = []
    for t, side in zip(flat, (left, right), strict=True):
        i = np.repeat(np.arange(len(side), dtype=np.int32), [len(x) for x in side])
        p = np.searchsorted(common, t)
        p[p == len(common)] = 0
        ok = common[p] == t if len(common) else np.zeros(len(t), bool)
        order = np.argsort(p[ok], kind="stable")
        held.append((p[ok][order], i[ok][order], len(side)))
    for at in range(0, len(common), FRAGMENT):
        width = min(FRAGMENT, len(common) - at)
        inc = []
        for p, i, m in held:
            a, b = np.searchsorted(p, (at, at + width))
            x = np.zeros((m, width), np.float32)
            x[i[a:b], p[a:b] - at] = 1
            inc.append(x)
        total += inc[0] @ inc[1].T
    return total


def _linked(left: list, right: list, pct: int) -> np.ndarray:
    """Boolean matrix of the pairs that link; a set's own place in ``left`` against itself says nothing."""
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    o = overlaps(left, right)
    link = np.empty(o.shape, bool)
    for i in range(0, len(o), 256):
        x = o[i : i + 256].astype(np.int64)
        link[i : i + 256] = (x > 0) & (100 * x >= pct * (a[i : i + 256, None] + b[None, :] - x))
    return link


def _spanning(ids: list[int], link: np.ndarray) -> list[tuple[int, int]]:
    """Ties of each component of a symmetric matrix to one of its members."""
    out, free = [], np.ones(len(ids), bool)
    for i in range(len(ids)):
        if free[i]:
            front = np.array([i])
            free[i] = False
            while len(front):
                front = np.flatnonzero(link[front].any(0) & free)
                free[front] = False
                out += [(ids[i], ids[j]) for j in front]
    return out


def _bipartite(left: list[int], right: list[int], link: np.ndarray) -> list[tuple[int, int]]:
    """The same where only left and right members can link."""
    out, free, other = [], np.ones(len(left), bool), np.ones(len(right), bool)
    for i in range(len(left)):
        if free[i]:
            front = np.array([i])
            free[i] = False
            while len(front):
                across = np.flatnonzero(link[front].any(0) & other)
                other[across] = False
                front = np.flatnonzero(link[:, across].any(1) & free)
                free[front] = False
                out += [(left[i], right[j]) for j in across] + [(left[i], left[j]) for j in front]
    return out


def _verify(pct: int):
    """Rows sorted by (g, side): the spanning links of each g. side 0 against side 1; one side alone: among itself."""

    def links(sides: dict[int, dict[int, np.ndarray]]) -> list[tuple[int, int]]:
        ids = [list(x) for x in sides.values()]
        sets = [list(x.values()) for x in sides.values()]
        if len(ids) == 1:
            return _spanning(ids[0], _linked(sets[0], sets[0], pct)) if len(ids[0]) > 1 else []
        return _bipartite(ids[0], ids[1], _linked(sets[0], sets[1], pct))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides, out = None, {}, []

        def batch(rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            s = b.column("s")
            flat, offsets = s.values.to_numpy(zero_copy_only=False), s.offsets.to_numpy()
            for i, (g, side, sid) in enumerate(zip(*(b.column(c).to_pylist() for c in ("g", "side", "sid")), strict=True)):
                if g != at:
                    out += links(sides) if sides else []
                    at, sides = g, {}
                    if len(out) > 10_000:
                        yield batch(out)
                        out = []
                sides.setdefault(side, {}).setdefault(sid, flat[offsets[i] : offsets[i + 1]].view(np.uint64).copy())
        out += links(sides) if sides else []
        yield batch(out)

    return run


def _blocked(reps: DataFrame, pct: int) -> DataFrame:
    """``reps`` (root, sid, n) with band, i and nb: a group over the block size is cut by size band, a band by hash into nb[band] blocks."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / pct)) + 1e-9).cast("int")
    weights = F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_SETS)
    large = reps.groupBy("root").agg(weights.alias("w")).where("w > 1").select("root")
    blocks = (
        reps.join(large, "root")
        .groupBy("root", band.alias("band"))
        .agg(F.ceil(weights).cast("int").alias("nb"))
        .groupBy("root")
        .agg(F.map_from_entries(F.collect_list(F.struct("band", "nb"))).alias("nb"))  # as many entries as size bands
    )
    x = reps.join(blocks, "root", "left").withColumn("band", F.when(F.col("nb").isNotNull(), band))
    return x.withColumn("i", F.expr("cast(pmod(xxhash64(sid), nb[band]) as int)"))


#: The block of a set as a task of its own.
OWN = "array(named_struct('g', xxhash64(root, band, i), 'side', 0))"
#: Its block against all others of the group that may hold linked sets, the block itself left out.
ACROSS = """concat(
  transform(filter(sequence(0, nb[band] - 1), j -> j <> i), j -> named_struct('g', xxhash64(root, band, least(i, j), band, greatest(i, j)), 'side', if(i < j, 0, 1))),
  if(nb[band + 1] IS NULL, array(), transform(sequence(0, nb[band + 1] - 1), j -> named_struct('g', xxhash64(root, band, i, band + 1, j), 'side', 0))),
  if(nb[band - 1] IS NULL, array(), transform(sequence(0, nb[band - 1] - 1), j -> named_struct('g', xxhash64(root, band - 1, j, band, i), 'side', 1))))"""


def _links(sets: DataFrame, tasks: str, pct: int) -> DataFrame:
    """(a, b): the links that each task's blocks hold."""
    rows = sets.select(F.explode(F.expr(tasks)).alias("t"), "sid", "s").select("t.g", "t.side", "sid", "s")
    return in_arrow(rows.repartition("g").sortWithinPartitions("g", "side"), _verify(pct), "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    """``df`` (rows of a few numbers), to be broadcast if its size allows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def _set_links(sets: DataFrame, candidates: DataFrame, pct: int) -> DataFrame:
    """(node, root): components of the links between the sets (sid, n, s) of ``candidates`` (sid, root, n)."""
    placed = saved(_blocked(candidates, pct), "jaccard-blocks")
    found = saved(_links(sets.select("sid", "s").join(_small(placed.drop("n")), "sid"), OWN, pct), "jaccard-links")
    large = placed.where(F.col("nb").isNotNull())
    made = [placed, found]
    if large.limit(1).count():
        for across in (False, True):
            groups = components(found, "a", "b")
            at = large.join(groups.withColumnRenamed("root", "comp"), large["sid"] == groups["node"], "left")
            at = at.select("sid", "root", "n", "band", "i", "nb", F.coalesce("comp", "sid").alias("comp"))
            mixed = at.groupBy("root").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("root")
            at = at.join(mixed, "root")
            if not across:  # one set for each component so far
                at = _blocked(at.groupBy("root", "comp").agg(F.min(F.struct("sid", "n")).alias("x")).select("root", "x.*"), pct)
            rows = sets.select("sid", "s").join(at.select("sid", "root", "band", "i", "nb"), "sid")
            more = saved(_links(rows, ACROSS if across else OWN, pct), "jaccard-links")
            discard(groups)
            made.append(more)
            found = found.unionByName(more)
    links = components(found, "a", "b")
    discard(*made)
    return links


def _classes(docs: DataFrame, n: int, pct: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document, as a table made by ``saved``: (h, id, n, c) with the hash of its text and a name of its component."""
    text = F.col(text_col).cast("string")
    base = docs.select(F.xxhash64(text).alias("h"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    fragments = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_arrow(base, _scan(n, fragments), SCAN).repartitionById(fragments, F.pmod("part", F.lit(fragments)))
    rows = saved(in_arrow(rows, _shared(fragments), SHARED), "jaccard-scan")
    members = rows.where("blob IS NULL").select("h", "id", "sid", "n")
    counts = rows.where("blob IS NOT NULL").select("part", "blob").repartitionById(fragments, "part")
    counts = in_arrow(counts, _totals, "sid long, c long")
    sizes = members.where("n > 0").groupBy("sid").agg(F.min("h").alias("h"), F.max("n").alias("n"))
    left = saved(sizes.join(counts, "sid").where(100 * F.col("c") >= pct * F.col("n")).select("sid", "h", "n"), "jaccard-left")
    texts = base.select("h", "text").join(_small(left), "h").select("sid", "n", "text")
    sets = in_arrow(texts, _sets(n), "sid long, n long, s array<long>").groupBy("sid").agg(F.any_value("n").alias("n"), F.any_value("s").alias("s"))
    sets = saved(sets, "jaccard-sets")

    ties = in_arrow(sets.select("sid", "s"), _meet(pct, frequencies(sets)), TIES)
    ties = ties.withColumn("first", F.min("a").over(Window.partitionBy("k", "tie"))).where("tie OR a > first")
    ties = ties.select(F.when(F.col("tie"), F.col("k")).otherwise(F.col("first")).alias("k"), "a")
    groups = components(in_arrow(ties, _shrink, "a long, b long"), "a", "b")
    candidates = sets.select("sid", "n").join(groups, sets["sid"] == groups["node"]).select("sid", "root", "n")
    links = _set_links(sets, candidates, pct)
    named = members.join(_small(links), members["sid"] == links["node"], "left")
    named = saved(named.select("h", "id", "n", F.coalesce("root", "sid").alias("c")), "jaccard-classes")
    discard(rows, left, sets, groups, links)
    return named


def classes(docs: DataFrame, n: int = 4, pct: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the size n of its set, and cid, the smallest id of its component."""
    named = _classes(docs, n, pct, id_col, text_col)
    least = named.where("n > 0").groupBy("c").agg(F.min("id").alias("cid"))
    full = named.where("n > 0").join(_small(least), "c").select("id", "n", "cid")
    return full.unionByName(named.where("n = 0").select("id", "n", F.col("id").alias("cid")))


def one_of_each(docs: DataFrame, n: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the first row (by id, then by the text's hash) of each component; documents without words stay."""
    named = _classes(docs, n, pct, id_col, text_col)
    rows = named.where("n > 0").groupBy("c", "id", "h").agg(F.count("*").alias("times"))
    heads = rows.groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("head"))
    rows = rows.join(heads, "c").withColumn("head", F.struct(F.col("id").isNull(), "id", "h") == F.col("head"))
    marked = saved(rows.where("NOT head OR times > 1").select("id", "h", "head"), "jaccard-drop")
    discard(named)

    def where(head: bool) -> Column:
        return docs[id_col].cast("long").eqNullSafe(marks["id"]) & (F.xxhash64(docs[text_col].cast("string")) == marks["h"])

    marks = _small(marked.select("id", "h"))
    out = docs.join(marks, where(False), "left_anti")
    repeated = marked.where("head").select("id", "h")
    if repeated.limit(1).count():  # rows of equal id and text: one of them
        marks = _small(repeated)
        names = {f"c{i}": c for i, c in enumerate(docs.columns)}
        again = docs.join(marks, where(True)).select(*[docs[c] for c in docs.columns], marks["id"], marks["h"]).toDF(*names, "id", "h")
        one = again.groupBy("id", "h").agg(F.first(F.struct(*names)).alias("x")).select("x.*")
        out = out.union(one.toDF(*names.values()))
    return out


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("cid").alias("component_id"))
