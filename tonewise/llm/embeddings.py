"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1, so a cosine of at least ``c`` is a distance of
at most ``sqrt(2 - 2c)``: epsilon. They are projected on leading principal
dimensions (from a d x d covariance, summed over all rows), cut into grid cells
of side epsilon there and sorted by cell. The sorted sequence is dealt into
blocks of ``BLOCK_BYTES``; pairs of blocks are joined recursively by halves, and
a pair of intervals whose boxes of true projections lie more than epsilon apart
(the squared gaps of all leading dimensions summed) is skipped: projections shrink
distances, so it holds no link. Cosines of what is left are computed from the
given components in double precision; only counts and a spanning forest leave a
task, never all pairs.

Which blocks may meet follows from their boxes. Cells with many blocks are split
by hash. Vectors with the same components count as one with a multiplicity.

Where vectors spread evenly over many dimensions, few leading ones say little,
boxes overlap and blocks meet nearly all others: the work then grows with the
square of the distinct vectors, and each is sent once for each block, so blocks
are as large as a task holds with ease.

Defined cases: a vector that is null, empty, all zero, or holds a null or
non-finite component links with nothing and is its own component. Vectors of
different lengths never link. Null ids keep their row and count as partners.
Repeated rows are vectors of their own. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewise.llm.common import components, discard, fixed, in_arrow, saved

LEADING = 6
#: Components (8 bytes each) of a block; a task holds two blocks.
BLOCK_BYTES = 4 << 20
LEAF = 256
#: Tasks that look for the pairs of blocks of one first cell.
SALTS = 8


def _principal(good: DataFrame, dims: int) -> np.ndarray:
    """(dims, LEADING): leading eigenvectors of the second moments of all vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            x = unit(b.column("v"), dims)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims, dtype=np.int32)), pa.array(total.ravel())], names=["i", "s"])

    rows = in_arrow(good, moments, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # dims * dims
    m = np.zeros(dims * dims)
    for r in rows:
        m[r["i"]] = r["s"]
    return np.linalg.eigh(m.reshape(dims, dims))[1][:, ::-1][:, : min(LEADING, dims)]


def unit(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cells(axes: np.ndarray, eps: float):
    """(vid, v, copies) -> the same with the projection p on the leading dimensions and its grid cell."""
    dims = len(axes)

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = unit(b.column("v"), dims) @ axes
            cell = np.floor(p / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vid", "v", "copies")), lists(p), lists(cell)], names=["vid", "v", "copies", "p", "cell"])

    return run


class Joiner:
    """The recursive join of intervals of two sorted sequences."""

    def __init__(self, axes: np.ndarray, eps: float, cosine: float):
        self.axes, self.eps, self.cosine = axes, eps, cosine

    def prepare(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = x @ self.axes
        order = np.lexsort(np.floor(p / self.eps).T[::-1])
        return x[order], p[order], order

    def run(self, a, b, same: bool, found) -> None:
        """``found(i, j)`` gets arrays of positions (of the given vectors) that link; with ``same`` only i < j in sequence."""
        stack = [(0, len(a[0]), 0, len(b[0]))]
        while stack:
            a0, a1, b0, b1 = stack.pop()
            if same and b1 <= a0 or a0 == a1 or b0 == b1:
                continue
            p, q = a[1][a0:a1], b[1][b0:b1]
            gaps = np.maximum(np.maximum(q.min(0) - p.max(0), p.min(0) - q.max(0)), 0)
            if (gaps * gaps).sum() > self.eps**2 * (1 + 1e-9):
                continue
            if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
                i, j = np.nonzero(a[0][a0:a1] @ b[0][b0:b1].T >= self.cosine - 1e-9)
                i, j = i + a0, j + b0
                exact = (a[0][i] * b[0][j]).sum(1) >= self.cosine
                keep = exact & (i < j) if same else exact
                if keep.any():
                    found(a[2][i[keep]], b[2][j[keep]])
            else:
                am, bm = (a0 + a1) // 2, (b0 + b1) // 2
                xs = [(a0, am), (am, a1)] if a1 - a0 > LEAF else [(a0, a1)]
                ys = [(b0, bm), (bm, b1)] if b1 - b0 > LEAF else [(b0, b1)]
                stack += [(*x, *y) for x in xs for y in ys]


def _join(axes: np.ndarray, eps: float, cosine: float):
    """Rows sorted by (g, side): vid, v, copies -> (a, n, b): a has n more linked vectors; a and b are tied."""
    dims = len(axes)
    joiner = Joiner(axes, eps, cosine)

    def solve(sides: dict[int, list]) -> Iterator[pa.RecordBatch]:
        parts = [(np.array([r[0] for r in s], np.int64), np.array([r[2] for r in s], np.int64), np.stack([r[1] for r in s])) for s in sides.values()]
        same = len(parts) == 1
        left, right = parts[0], parts[-1]
        ids = left[0] if same else np.concatenate([left[0], right[0]])
        n, parent, shift = np.zeros(len(ids), np.int64), np.arange(len(ids)), 0 if same else len(left[0])

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def found(i, j) -> None:
            np.add.at(n, i, right[1][j])
            np.add.at(n, j + shift, left[1][i])
            for _ in range(3):  # most pairs of a dense group fall away before the slow part
                parent[:] = parent[parent]
            apart = parent[i] != parent[j + shift]
            for x, y in zip(i[apart], j[apart] + shift, strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)

        prepared = [joiner.prepare(p[2]) for p in parts]
        joiner.run(prepared[0], prepared[-1], same, found)
        hit = np.flatnonzero(n)
        top = np.array([ids[root(x)] for x in hit], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit]), pa.array(top)], names=["a", "n", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, {}
        for b in batches:
            x = unit(b.column("v"), dims)
            for i, (g, side, vid, copies) in enumerate(zip(*(b.column(c).to_pylist() for c in ("g", "side", "vid", "copies")), strict=True)):
                if g != at:
                    if sides:
                        yield from solve(sides)
                    at, sides = g, {}
                sides.setdefault(side, []).append((vid, x[i], copies))
        if sides:
            yield from solve(sides)

    return run


def _blocks(cells: DataFrame, most: int) -> DataFrame:
    """(vid, v, copies, first, part, p): the first cell, and one of its blocks of about ``most`` rows.

    Blocks of a first cell are ranges of the later cells in grid order while
    these differ; equal cells are cut by hash.
    """
    sizes = cells.groupBy(F.col("cell")[0].alias("first"), F.col("cell").alias("whole")).agg(F.count("*").alias("n"))
    at = Window.partitionBy("first")
    # One row for each occupied cell of a first cell; a running sum deals them into blocks in grid order.
    run = F.sum("n").over(at.orderBy("whole")) - F.col("n")
    dealt = sizes.select("first", "whole", "n", F.floor(run / most).cast("int").alias("low"), F.floor((run + F.col("n") - 1) / most).cast("int").alias("high"))
    dealt = saved(dealt, "embeddings-cells")
    joined = cells.join(dealt, cells["cell"] == dealt["whole"])
    part = F.col("low") + F.pmod(F.xxhash64("vid"), F.col("high") - F.col("low") + 1).cast("int")
    return joined.select("vid", "v", "copies", "first", part.alias("part"), "p")


def _links(good: DataFrame, dims: int, cosine: float) -> DataFrame:
    """(a, n, b) rows for the distinct vectors ``good`` (vid, v, copies)."""
    eps = float(np.sqrt(2 - 2 * cosine))
    axes = _principal(good, dims)
    cells = in_arrow(good.select("vid", "v", "copies"), _cells(axes, eps), "vid long, v array<double>, copies long, p array<double>, cell array<int>")
    cells = saved(cells, "embeddings-grid")
    rows = saved(_blocks(cells, max(1, BLOCK_BYTES // (8 * dims))), "embeddings-blocks")
    discard(cells)
    k = axes.shape[1]
    boxes = rows.groupBy("first", "part").agg(
        *[F.min(F.col("p")[i]).alias(f"lo{i}") for i in range(k)], *[F.max(F.col("p")[i]).alias(f"hi{i}") for i in range(k)]
    )
    boxes = saved(boxes, "embeddings-boxes").withColumn("salt", F.pmod("part", F.lit(SALTS)))
    # Blocks of a first cell and of the next may meet; each looks for partners of every salt.
    here = boxes.select("*", F.explode(F.array(F.col("first"), F.col("first") + 1)).alias("meets")).drop("salt")
    here = here.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    a, b = here.alias("a"), boxes.alias("b")
    near = a.join(b, (F.col("a.meets") == F.col("b.first")) & (F.col("a.salt") == F.col("b.salt")))
    near = near.where((F.col("a.first") < F.col("b.first")) | (F.col("a.part") <= F.col("b.part")))
    gaps = [F.greatest(F.col(f"b.lo{i}") - F.col(f"a.hi{i}"), F.col(f"a.lo{i}") - F.col(f"b.hi{i}"), F.lit(0.0)) for i in range(k)]
    near = near.where(functools.reduce(Column.__add__, [g * g for g in gaps]) <= eps**2 * (1 + 1e-9))
    pairs = saved(
        near.select(F.col("a.first").alias("f0"), F.col("a.part").alias("p0"), F.col("b.first").alias("f1"), F.col("b.part").alias("p1")), "embeddings-pairs"
    )
    g = F.xxhash64("f0", "p0", "f1", "p1").alias("g")
    own = (F.col("f0") == F.col("f1")) & (F.col("p0") == F.col("p1"))
    sent = pairs.select(g, F.lit(0).alias("side"), F.col("f0").alias("first"), F.col("p0").alias("part")).unionByName(
        pairs.where(~own).select(g, F.lit(1).alias("side"), F.col("f1").alias("first"), F.col("p1").alias("part"))
    )
    tasks = rows.join(sent, ["first", "part"]).select("g", "side", "vid", "v", "copies")
    tasks = tasks.repartition("g").sortWithinPartitions("g", "side")
    return in_arrow(tasks, _join(axes, eps, cosine), "a long, n long, b long")


def classes(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    v = F.col(vector_col).cast("array<double>")
    base = fixed(vectors).select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), v.alias("v"))
    fit = F.coalesce(
        (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    base = base.withColumn("fit", fit)
    # Equal vectors are one, named by the two hashes of its components and its smallest row.
    h = [F.when(F.col("fit"), F.xxhash64("v")).otherwise(F.col("rid")), F.when(F.col("fit"), F.hash("v")).otherwise(F.lit(0))]
    base = base.withColumn("h", F.struct(h[0].alias("x"), h[1].alias("y"), "fit"))
    distinct = base.groupBy("h").agg(
        F.min("rid").alias("vid"), F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("fit").alias("fit")
    )
    distinct = saved(distinct, "embeddings-distinct")
    good = distinct.where("fit")
    parts = []
    for dims in sorted(r[0] for r in good.select(F.size("v")).distinct().collect()):  # the lengths that occur
        parts.append(_links(good.where(F.size("v") == dims).select("vid", "v", "copies"), dims, cosine))
    if parts:
        links = parts[0]
        for p in parts[1:]:
            links = links.unionByName(p)
        links = saved(links, "embeddings-links")
        counts = links.groupBy("a").agg(F.sum("n").alias("n"))
        groups = components(links, "a", "b")
        distinct = distinct.join(counts, distinct["vid"] == counts["a"], "left").join(groups, distinct["vid"] == groups["node"], "left")
    else:
        distinct = distinct.select("*", F.lit(0).alias("n"), F.lit(None).cast("long").alias("root"))
    total = F.coalesce("n", F.lit(0)) + F.when(F.col("fit"), F.col("copies") - 1).otherwise(0)
    known = saved(distinct.select("h", "id", total.alias("n_links"), F.coalesce("root", "vid").alias("root")), "embeddings-classes")
    least = known.groupBy("root").agg(F.min("id").alias("component_id"))
    known = saved(known.join(least, "root").select("h", "n_links", "component_id"), "embeddings-named")
    return base.select("id", "h").join(known, "h").select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def report(vectors: DataFrame) -> DataFrame:
    return classes(vectors)
