"""Quality classifier: histogram gradient-boosted trees over document statistics.

A text is told by some thirty statistics (``NAMES``) of its characters, words and
lines: sizes, shares of classes of characters, repetition, entropy. Statistics
are computed in tasks, over whole texts. Trees of a fixed depth are boosted on
the logistic loss: each statistic is cut into at most ``BINS`` bins at quantiles
of the sample, gradients and hessians are summed by node, statistic and bin, and
each node takes the cut of the largest gain. The trees are flattened into arrays
of statistic, threshold and leaf; numpy walks all rows of a batch through all
trees, a level at a time.

It is fitted on a bounded sample of labelled rows whose remainder is not 2:
``max_rows`` ids of each label, chosen by a hash of the id, weighted to the
labels' true shares. Of these only the statistics come to the driver (thirty
numbers a row). Labels, language, source and id are no input of a score.

Defined cases: a null text counts as empty, and the empty text is scored by its
statistics, which are all 0. Without labelled rows of both kinds every score is
0. Labels of one id that disagree count as 0. Null ids and null labels are never
learned from; an id with several texts is learned from its smallest. Repeated
rows score alike. A text of more than ``PIECE`` characters is read in pieces that
are cut at white space, and a line over a cut counts as two. Other columns are
ignored.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise.llm.common import in_arrow

NAMES = (
    "log_chars", "log_words", "log_lines", "log_line_length", "log_longest_line", "repeated_lines",
    "mean_word", "sd_word", "log_longest_word", "short_words", "capitalised_words", "upper_words", "words_without_letters", "words_with_marks",
    "words_ending_in_marks", "different_words", "commonest_word", "word_after_itself", "different_pairs", "word_entropy",
    "upper", "digits", "white", "beyond_ascii", "stops", "exclamations", "quotes", "other_marks", "byte_entropy", "different_bytes",
)
BINS = 64
PIECE = 1 << 20
SPACE = re.compile(r"\s")
STOPS, EXCLAMATIONS, QUOTES = b".,;:", b"!?", b"\"'()-"


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def held_out(id_col: Column) -> Column:
    return F.coalesce(remainder(id_col) == 2, F.lit(False))


def pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        cut = SPACE.search(text, at + PIECE)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum())


def statistics(text: str | None) -> list[float]:
    """The statistics of ``NAMES``; all 0 for the empty text."""
    if not text:
        return [0.0] * len(NAMES)
    chars = np.zeros(256, np.int64)
    words: Counter = Counter()
    lines: set[int] = set()
    pairs: set[int] = set()
    n_lines = n_pairs = again = longest_line = 0
    for piece in pieces(text):
        chars += np.bincount(np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        found = piece.split()
        words.update(found)
        again += sum(map(operator.eq, found, islice(found, 1, None)))
        pairs.update(map(hash, zip(found, islice(found, 1, None))))
        n_pairs += max(0, len(found) - 1)
        for line in piece.split("\n"):
            if line and not line.isspace():
                n_lines += 1
                lines.add(hash(line))
                longest_line = max(longest_line, len(line))
    total, squares, longest, short, capital, upper, bare, marked, ended = 0, 0, 0, 0, 0, 0, 0, 0, 0
    for w, n in words.items():
        size = len(w)
        total += n * size
        squares += n * size * size
        longest = max(longest, size)
        if size <= 3:
            short += n
        if w[0].isupper():
            capital += n
            if size > 1 and w.isupper():
                upper += n
        if not w.isalpha():
            marked += n
            if not w[-1].isalnum():
                ended += n
            if not any(map(str.isalpha, w)):
                bare += n
    n_words, n_chars, n_bytes = words.total() or 1, len(text), int(chars.sum())
    mean = total / n_words
    small, large = int(chars[97:123].sum()), int(chars[65:91].sum())
    letters = max(1, small + large + int(chars[192:].sum()))
    digits, white = int(chars[48:58].sum()), int(chars[9:14].sum() + chars[32])
    stops, exclamations, quotes = (int(chars[list(s)].sum()) for s in (STOPS, EXCLAMATIONS, QUOTES))
    other = int(chars[:128].sum()) - small - large - digits - white - stops - exclamations - quotes
    counts = np.fromiter(words.values(), np.int64, len(words))
    return [
        math.log1p(n_chars), math.log1p(words.total()), math.log1p(n_lines), math.log1p(n_chars / max(1, n_lines)), math.log1p(longest_line),
        1 - len(lines) / max(1, n_lines),
        mean, math.sqrt(max(0.0, squares / n_words - mean * mean)), math.log1p(longest), short / n_words, capital / n_words, upper / n_words,
        bare / n_words, marked / n_words,
        ended / n_words, len(words) / n_words, max(words.values(), default=0) / n_words, again / n_words, len(pairs) / max(1, n_pairs), entropy(counts),
        large / letters, digits / n_bytes, white / n_bytes, int(chars[128:].sum()) / n_bytes, stops / n_bytes, exclamations / n_bytes, quotes / n_bytes,
        other / n_bytes, entropy(chars), float((chars > 0).sum()),
    ]


@dataclass
class Trees:
    """All trees of one depth: for each inner node its statistic and threshold (above it: right), for each leaf its value."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Walk all rows of ``x`` through all trees, a level at a time."""
        trees = np.arange(len(self.leaf))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(int(self.leaf.shape[1]).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.base + self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40))) if len(self.leaf) else np.zeros(len(x))


def edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each column the values that part its bins: quantiles of the sample, at most ``bins`` - 1."""
    found = []
    for column in x.T:
        cuts = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        found.append(cuts[cuts < column.max()])
    return found


def best_cuts(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the statistic, bin and gain of its best cut, from sums of gradients and hessians (node, statistic, bin)."""
    gl, hl = np.cumsum(g, 2)[:, :, :-1], np.cumsum(h, 2)[:, :, :-1]
    gt, ht = g.sum(2)[:, :, None], h.sum(2)[:, :, None]
    gr, hr = gt - gl, ht - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2)
    gain = np.where((hl >= least) & (hr >= least), gain, 0).reshape(len(g), -1)
    at = gain.argmax(1)
    return at // (g.shape[2] - 1), at % (g.shape[2] - 1), gain[np.arange(len(g)), at]


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, l2: float = 1.0, least: float = 1.0) -> Trees:
    cuts = edges(x)
    n, m = x.shape
    bins = max(2, 1 + max(map(len, cuts)))
    cell = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1) + np.arange(m) * bins
    padded = np.stack([np.concatenate([c, np.full(bins - len(c), np.inf)]) for c in cuts])
    weight = weight / weight.mean()
    share = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    z = np.full(n, base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        grad, hess = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            where = ((node - first)[:, None] * (m * bins) + cell).ravel()
            sums = [np.bincount(where, np.repeat(v, m), width * m * bins).reshape(width, m, bins) for v in (grad, hess)]
            f, b, gain = best_cuts(*sums, l2, least)
            cut = np.where(gain > 1e-9, padded[f, b], np.inf)
            feature[t, first : first + width], threshold[t, first : first + width] = f, cut
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        g, h = np.bincount(at, grad, leaves), np.bincount(at, hess, leaves)
        leaf[t] = -rate * g / (h + l2)
        z += leaf[t][at]
    return Trees(feature, threshold, leaf, base)


NONE = Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 0.0)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = pa.array([statistics(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), x], names=["doc_id", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, **options) -> Trees:
    known = labels.where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id")) != 2)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return NONE
    dice = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1_000_000))
    share = F.when(F.col("quality") == 1, 1e6 * max_rows / n[1]).otherwise(1e6 * max_rows / n[0])
    sample = known.where(dice < share).groupBy("doc_id").agg(F.min("quality").alias("quality"))  # at most about max_rows of each label
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "text")
    got = in_arrow(rows, _statistics, "doc_id string, quality int, x array<double>").toArrow().sort_by("doc_id")
    y = got.column("quality").to_numpy().astype(np.float64)
    if len(set(y)) < 2:
        return NONE
    x = np.array(got.column("x").to_pylist())
    weight = np.where(y == 1, n[1] / (y == 1).sum(), n[0] / (y == 0).sum())
    return boost(x, y, weight, **options)


def _score(model: Trees, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, len(NAMES))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, _score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
