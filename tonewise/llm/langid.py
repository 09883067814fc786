"""Language identification by words first, then shorter and shorter n-grams.

A word that the model knows scores its log frequency in each language. An
unknown word backs off to its longest known character n-grams (of the word
with an edge mark on both sides): 5 letters, then 4, 3, 2 and 1. A text's
language has the largest sum; its score is the softmax of the sums, scaled
to the evidence of ``EVIDENCE`` words where a text has more.

The model is fitted on a bounded sample of labelled rows, ``sample_rows`` for
each language, chosen by a hash of the id. Its size follows from the sample: all
words and n-grams that the sample holds ``min_count`` times or more are entries.
What is rarer counts as unknown, so a word seen once is scored by its n-grams like
any unseen word. Scoring reads every text whole and never the label, source or id.

Defined cases: null text, empty text and text without a letter are ``und``
with score 0; so is everything if no labelled row exists. A row with a null id
is never learned from. Ties go to the language that sorts first. Repeated rows
are scored alike. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise.llm.common import in_arrow

WORD = re.compile(r"[^\W\d_]+")
GRAMS = (5, 4, 3, 2, 1)
EVIDENCE = 10
#: Floats that a task keeps for words seen so far.
MEMO_FLOATS = 800_000


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def held_out(id_col: Column) -> Column:
    return F.coalesce(remainder(id_col) == 0, F.lit(False))


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    word_logs: np.ndarray | None = None
    gram_logs: np.ndarray | None = None

    def score_word(self, word: str) -> np.ndarray:
        i = self.words.get(word)
        if i is not None:
            return self.word_logs[i]
        for n in GRAMS:
            known = [self.grams[g] for g in grams(word, n) if g in self.grams]
            if known:
                return self.gram_logs[known].mean(0)
        return np.zeros(len(self.langs), np.float32)


class Scorer(dict):
    """word -> row of ``rows``; forgotten between texts when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.most = max(1_000, MEMO_FLOATS // max(1, len(model.langs)))
        self.rows = np.empty((1_024, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[at] = self.model.score_word(word)
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not self.model.langs or not any(any(map(str.isalpha, w)) for w in words):
            return "und", 0.0
        if len(self) > self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        total = self.rows[at].sum(0, dtype=np.float64)
        best = int(total.argmax())
        x = np.exp((total - total[best]) * (min(len(words), EVIDENCE) / len(words)))
        return self.model.langs[best], float(1 / x.sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, is_word, token, n): counts of the task's rows."""

    def out(words: dict[str, Counter]) -> pa.RecordBatch:
        rows = []
        for lang, counts in words.items():
            found: Counter = Counter()
            for word, n in counts.items():
                rows.append((lang, True, word, n))
                for size in GRAMS:
                    for g in grams(word, size):
                        found[g] += n
            rows += [(lang, False, g, n) for g, n in found.items()]
        kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["lang", "is_word", "token", "n"])

    words: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        if sum(map(len, words.values())) > 30_000:
            yield out(words)
            words = {}
    yield out(words)


def fit(
    docs: DataFrame,
    sample_rows: int = 1_000,
    min_count: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Learn from at most about ``sample_rows`` rows of each language whose remainder is not 0."""
    lang = F.col(lang_col).cast("string")
    known = docs.where(F.col(lang_col).isNotNull() & (remainder(F.col(id_col)) != 0))
    shares = {r["lang"]: sample_rows / r["n"] for r in known.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row a language
    if not shares:
        return Model()
    dice = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, 1e6 * v)])[lang]
    rows = known.where((dice < share) & F.col(text_col).isNotNull()).select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = in_arrow(rows, _count, "lang string, is_word boolean, token string, n long")
    counts = counts.groupBy("is_word", "token", "lang").agg(F.sum("n").alias("n")).toArrow()  # what the sample holds
    model = Model(sorted(set(counts.column("lang").unique().to_pylist())))
    at = {k: i for i, k in enumerate(model.langs)}
    for is_word, index, name in ((True, model.words, "word_logs"), (False, model.grams, "gram_logs")):
        part = counts.filter(pa.compute.equal(counts.column("is_word"), is_word))
        token = part.column("token").combine_chunks().dictionary_encode()
        m = np.zeros((len(token.dictionary), len(at)))
        langs = np.array([at[x] for x in part.column("lang").to_pylist()], np.int64)
        m[token.indices.to_numpy(), langs] = part.column("n").to_numpy()
        often = np.flatnonzero(m.sum(1) >= min_count)
        index.update({t: i for i, t in enumerate(token.dictionary.take(pa.array(often)).to_pylist())})
        m = m[often]
        setattr(model, name, np.log((m + 0.5) / (m.sum(0) + 0.5 * len(m) + 1)).astype(np.float32))
    return model


def _label(model: Model, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            found = [scorer(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of each row with lang_pred and score."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    rows = docs.select(*keep, *([] if text_col in keep else [F.col(text_col).cast("string")]))
    schema = StructType([rows.schema[c] for c in keep]).add("lang_pred", StringType()).add("score", DoubleType())
    return in_arrow(rows, _label(model, text_col, keep), schema)


def keep_known(docs: DataFrame, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that get no language or one of a score below ``min_score``."""
    model = fit(docs, text_col=text_col)
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    rows = predict(docs.toDF(*names), model, list(names), next(k for k, c in names.items() if c == text_col))
    kept = rows.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return kept.select(*[F.col(k).alias(c) for k, c in names.items()])


def report(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])
