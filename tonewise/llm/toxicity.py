"""Toxicity by subword-bag embeddings, averaged into a linear softmax.

A word is the mean of the embeddings of itself and of its character n-grams
(hashed to buckets), so an unseen misspelling shares most of its vector with
the word. Windows of ``window`` words are averaged and a linear softmax tells
the two labels; embeddings and softmax are trained together in numpy. Training
starts from all windows of a text; each later epoch takes of a toxic text the
windows that the model finds most toxic, so a long text isn't diluted. A text's
score is the softmax's own, of its most toxic run of ``window`` words. The softmax
is scaled last (a temperature and a bias), on the fifth of the sample that it is
not trained on, so that 0.5 parts the labels.

It is fitted on a bounded sample of labelled rows whose remainder is not 0:
``max_toxic`` and ``max_clean`` ids, chosen by a hash of the id, one text each, of
``max_chars`` characters at most (longer ones are not learned from). Scoring
reads every text whole; labels, language, source and id are no input.

Defined cases: null, empty or wordless text scores 0. Without labelled rows of
both kinds every score is 0. Labels of one id that disagree count as toxic.
Null ids and null labels are never learned from. Repeated rows score alike.
Other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewise.llm.common import in_arrow
from tonewise.llm.langid import held_out, remainder

WORD = re.compile(r"[^\s.,;:!?\"()|]+")
BUCKETS, DIMS, SIZES = 1 << 18, 10, (3, 4, 5)
MEMO_WORDS = 200_000
#: Texts of which the new words are hashed at once.
TEXTS = 100


def features(word: str) -> list[int]:
    w = f"<{word}>"
    found = [crc32(w.encode("utf-8", "surrogatepass"))]
    found += [crc32(w[i : i + n].encode("utf-8", "surrogatepass"), n) for n in SIZES for i in range(len(w) - n + 1)]
    return [x % BUCKETS for x in found]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = _crc_table()


def word_means(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The mean weight of each word's ``features``, hashed all at once."""
    if not words:
        return np.empty(0)
    marked = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    flat = np.frombuffer(b"".join(marked), np.uint8)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, len(words)))
    begins = np.flatnonzero((flat & 0xC0) != 0x80)  # of characters
    of, flat = owner[begins], flat.astype(np.uint32)
    begins = np.append(begins, len(flat))
    whole = np.fromiter(map(crc32, marked), np.int64, len(words)) % BUCKETS
    total, n = weights[whole].astype(np.float64), np.ones(len(words), np.int64)
    for length in SIZES:
        at = np.flatnonzero(of[: len(of) - length + 1] == of[length - 1 :])
        start, size = begins[at], begins[at + length] - begins[at]
        crc = np.full(len(at), length ^ 0xFFFFFFFF, np.uint32)
        for k in range(size.max(initial=0)):
            if k < length:
                crc = CRC[(crc ^ flat[start + k]) & np.uint32(255)] ^ (crc >> np.uint32(8))
            else:  # only those of longer characters go on
                more = np.flatnonzero(size > k)
                crc[more] = CRC[(crc[more] ^ flat[start[more] + k]) & np.uint32(255)] ^ (crc[more] >> np.uint32(8))
        total += np.bincount(of[at], weights[(crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)], len(words))
        n += np.bincount(of[at], minlength=len(words))
    return total / n


@dataclass
class Model:
    """What is left of a trained model: for each bucket its part of the difference of the softmax's two logits, and their bias."""

    weights: np.ndarray
    window: int
    bias: float | None = None


def most(x: np.ndarray, window: int) -> float:
    """The largest mean of ``window`` words in a row, or of all where they are fewer."""
    c = np.concatenate(([0.0], np.cumsum(x)))
    w = min(window, len(x))
    return float((c[w:] - c[:-w]).max() / w)


class Trainer:
    def __init__(self, texts: list[str], labels: list[int], window: int, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.window = window
        vocabulary: dict[str, int] = {}
        words, sizes, doc, label = array("i"), array("i"), array("i"), array("i")
        for i, (t, y) in enumerate(zip(texts, labels, strict=True)):
            found = [vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(t.lower())]
            words.extend(found)
            for at in range(0, len(found), window):
                sizes.append(min(window, len(found) - at))
                doc.append(i)
                label.append(y)
        feats, starts = array("i"), array("q", [0])
        for w in vocabulary:
            feats.extend(features(w))
            starts.append(len(feats))
        self.feats, self.starts, self.words = np.array(feats), np.array(starts), np.array(words)
        self.wstarts = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
        self.doc, self.label = np.array(doc), np.array(label)
        self.aside = self.doc % 5 == 4
        self.emb = self.rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
        self.out = np.zeros((DIMS, 2), np.float32)
        self.bias = np.zeros(2, np.float32)
        self.g_emb = np.full(BUCKETS, 1e-3, np.float32)
        self.g_out, self.g_bias = np.full((DIMS, 2), 1e-3, np.float32), np.full(2, 1e-3, np.float32)

    def _ragged(self, starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = starts[of + 1] - starts[of]
        first = np.cumsum(size) - size
        return np.repeat(starts[of] - first, size) + np.arange(size.sum()), size

    def step(self, batch: np.ndarray, y: np.ndarray, rate: float) -> None:
        at, n_words = self._ragged(self.wstarts, batch)
        words, back = np.unique(self.words[at], return_inverse=True)
        fat, n_feats = self._ragged(self.starts, words)
        f = self.feats[fat]
        wv = np.add.reduceat(self.emb[f], np.cumsum(n_feats) - n_feats) / n_feats[:, None]
        x = np.add.reduceat(wv[back], np.cumsum(n_words) - n_words) / n_words[:, None]
        z = x @ self.out + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g_out, g_bias = x.T @ p / len(y), p.mean(0)
        gw = np.repeat(p @ self.out.T / n_words[:, None], n_words, 0)
        gv = np.stack([np.bincount(back, gw[:, d], len(words)) for d in range(DIMS)], 1) / n_feats[:, None]
        gf = np.repeat(gv, n_feats, 0)
        rows, fback = np.unique(f, return_inverse=True)
        g = np.stack([np.bincount(fback, gf[:, d], len(rows)) for d in range(DIMS)], 1).astype(np.float32)
        self.g_emb[rows] += (g**2).mean(1)
        self.emb[rows] -= rate * g / np.sqrt(self.g_emb[rows])[:, None]
        self.g_out += g_out**2
        self.out -= rate * g_out / np.sqrt(self.g_out)
        self.g_bias += g_bias**2
        self.bias -= rate * g_bias / np.sqrt(self.g_bias)

    def model(self) -> Model:
        return Model(self.emb @ (self.out[:, 1] - self.out[:, 0]), self.window, float(self.bias[1] - self.bias[0]))

    def per_word(self) -> np.ndarray:
        return np.add.reduceat(self.model().weights[self.feats], self.starts[:-1]) / np.diff(self.starts)

    def logits(self) -> np.ndarray:
        per = self.per_word()
        return np.add.reduceat(per[self.words], self.wstarts[:-1]) / np.diff(self.wstarts) + self.bias[1] - self.bias[0]

    def scale(self) -> None:
        """Fit the softmax's temperature and bias by Newton's method, on the texts set aside."""
        per = self.per_word()[self.words]
        first = np.flatnonzero(np.concatenate(([True], np.diff(self.doc) > 0)))
        ends = np.append(self.wstarts[first], len(per))
        x, y = np.array([most(per[a:b], self.window) for a, b in zip(ends[:-1], ends[1:], strict=True)]), self.label[first]
        use = self.aside[first]
        if len(set(y[use])) == 2:
            x, y = x[use], y[use]
        spread = x.std() + 1e-9
        x, w = np.stack([np.ones_like(x), x / spread], 1), np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
            w -= np.linalg.solve(h, x.T @ (p - y) + 0.1 * w)
        self.out *= np.float32(w[1] / spread)
        self.bias[:] = 0, w[0]

    def fit(self, epochs: int, clean_windows: int, rate: float = 0.3, size: int = 128) -> Model:
        toxic, clean = (np.flatnonzero((self.label == y) & ~self.aside) for y in (1, 0))
        for epoch in range(epochs):
            pos = toxic
            if epoch:
                z = self.logits()
                order = np.lexsort((-z, self.doc))
                first = order[np.concatenate(([True], np.diff(self.doc[order]) > 0))]
                top = np.zeros(len(z), bool)
                top[first] = True
                pos = toxic[(top | (z > 1))[toxic]]
                hard = clean[np.argsort(-z[clean])[: clean_windows // 4]]
                neg = np.concatenate([hard, self.rng.choice(clean, min(len(clean), clean_windows), False)])
            else:
                pos = self.rng.choice(toxic, min(len(toxic), clean_windows), False)
                neg = self.rng.choice(clean, min(len(clean), clean_windows), False)
            pos = np.tile(pos, max(1, len(neg) // (3 * len(pos))))
            both = self.rng.permutation(np.concatenate([pos, neg]))
            for i in range(0, len(both), size):
                self.step(both[i : i + size], self.label[both[i : i + size]], rate)
        self.scale()
        return self.model()


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 2_000, max_clean: int = 4_000, max_chars: int = 20_000, window: int = 4,
        epochs: int = 5, clean_windows: int = 20_000) -> Model:
    known = labels.where(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 0)).select("doc_id", "toxic")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = Model(np.zeros(1, np.float32), window)
    if len(n) < 2:
        return none
    dice = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1_000_000))
    share = F.when(F.col("toxic") == 1, 1e6 * max_toxic / n[1]).otherwise(1e6 * max_clean / n[0])
    sample = known.where(dice < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text")).where(F.col("text").isNotNull() & (F.char_length("text") <= max_chars))
    rows = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = rows.toArrow().sort_by("doc_id")  # the sample's bounds hold for it
    trainer = Trainer(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), window)
    if len(set(trainer.label[~trainer.aside])) < 2:
        return none
    return trainer.fit(epochs, clean_windows)


class Scorer(dict):
    """The weights of words that have been met."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def scores(self, texts: list[str | None]) -> list[float]:
        """The score of each text; what is new in ``TEXTS`` of them is hashed at once."""
        out: list[float] = []
        for i in range(0, len(texts), TEXTS):
            found = [WORD.findall(t.lower()) if t and self.model.bias is not None else [] for t in texts[i : i + TEXTS]]
            if len(self) > MEMO_WORDS:
                self.clear()
            new = list({w for words in found for w in words if w not in self})
            self.update(zip(new, word_means(new, self.model.weights).tolist(), strict=True))
            out += map(self._score, found)
        return out

    def _score(self, words: list[str]) -> float:
        if not words:
            return 0.0
        z = most(np.fromiter(map(self.__getitem__, words), np.float64, len(words)), self.model.window) + self.model.bias
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))

    def __call__(self, text: str | None) -> float:
        return self.scores([text])[0]


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            s = np.array(scorer.scores(b.column("text").to_pylist()), np.float64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, _score(model), "doc_id long, held_out boolean, score double, predicted int")
