"""A statistical language detector: naive Bayes over profiles of character trigrams.

It learns from texts whose language is known: for each language its ``size``
commonest trigrams (ties in code-point order), of letters in lower case with one
space for all that isn't a letter. A text's score in a language is the logarithm of
the language's share of the texts, and of each of the text's trigrams' share of
the language's profile, one being added to every count. Trigrams of no profile say
nothing. Counting, cutting the profiles and scoring are distributed; the profiles
come to the driver, ``size`` rows a language at most, ``MOST_LANGUAGES`` languages.
``whole_scores`` scores by all trigrams of all languages: profiles that are too large
for the driver stay a table that the texts' trigrams are joined with.

``Detector.column`` goes into ``detect_language`` as its detector. Defined cases: a
null text, or one without a known trigram, has no language (null), so the rules
decide. Ties go to the language that sorts first. Texts or languages that are null
teach nothing; without any, every answer is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewise.operators.features import term_counts
from tonewise.sources.tables import stored

#: Languages of which profiles are kept: those of most texts.
MOST_LANGUAGES = 400
#: Numbers of whole profiles, languages times trigrams, that the driver and the workers hold.
HELD = 4_000_000


def spelled(text: Column) -> Column:
    """Letters in lower case, a space for each run of other characters, and one at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def trigrams(text: Column) -> Column:
    return F.regexp_extract_all(spelled(text), F.lit("(?s)(?=(...))"), 1)


def profiles(rows: DataFrame, text: str, lang: str, size: int | None) -> DataFrame:
    """(lang, gram, n): the commonest trigrams of each language, or all of them."""
    grams = rows.select(F.col(lang).alias("lang"), F.explode(trigrams(F.col(text))).alias("gram"))
    counts = grams.groupBy("lang", "gram").agg(F.count("*").alias("n"))
    if size is None:
        return counts
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # cut before it is shuffled
    return counts.withColumn("nth", nth).where(F.col("nth") <= size).select("lang", "gram", "n")


def _trigram_codes(text: str) -> np.ndarray:
    """Each three characters in a row as one number, 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


@dataclass
class Detector:
    langs: list[str] = field(default_factory=list)
    grams: dict[str, int] = field(default_factory=dict)
    logs: np.ndarray | None = None
    prior: np.ndarray | None = None

    @staticmethod
    def fit(rows: DataFrame, text: str = "text", lang: str = "lang", size: int = 2_000) -> "Detector":
        known = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
        n = known.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
        shares = {r["lang"]: r["n"] for r in n.collect()}  # a row a language
        if not shares:
            return Detector()
        return Detector.of(shares, profiles(known.where(F.col(lang).isin(list(shares))), text, lang, size).toArrow())  # ``size`` rows a language

    @staticmethod
    def of(shares: dict[str, int], found: pa.Table) -> "Detector":
        """Of the number of texts of each language, and profiles (lang, gram, n)."""
        out = Detector(sorted(shares))
        at = {k: i for i, k in enumerate(out.langs)}
        gram = found.column("gram").to_pylist()
        for g in gram:
            out.grams.setdefault(g, len(out.grams))
        counts = np.zeros((len(out.grams), len(at)))
        counts[[out.grams[g] for g in gram], [at[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
        out.logs = np.log((counts + 1) / (counts.sum(0) + len(out.grams)))
        out.prior = np.log(np.array([shares[k] for k in out.langs]) / sum(shares.values()))
        return out

    def _coded(self) -> tuple[np.ndarray, np.ndarray]:
        """The profiles' trigrams as sorted numbers, and the row of ``logs`` of each."""
        known = [(int(_trigram_codes(g)[0]), i) for g, i in self.grams.items() if len(g) == 3]
        codes, rows = np.array(sorted(known), np.int64).reshape(-1, 2).T
        return codes, rows

    def totals(self, text: str, coded: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, int]:
        """Scores of a spelled text in each language, and how many of its trigrams are known."""
        codes, rows = coded or self._coded()
        found = _trigram_codes(text)
        if not len(codes) or not len(found):
            return self.prior + 0.0, 0
        p = np.searchsorted(codes, found)
        p[p == len(codes)] = 0
        at = rows[p[codes[p] == found]]
        return self.prior + self.logs[at].sum(0), len(at)

    def column(self, text: Column) -> Column:
        """The likeliest language, or null."""
        if not self.langs:
            return F.lit(None).cast("string")

        @F.pandas_udf("string")
        def guess(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            coded = self._coded()
            for texts in batches:
                found = [self.totals(t, coded) if t else (None, 0) for t in texts]
                yield pd.Series([self.langs[int(s.argmax())] if n else None for s, n in found], dtype=object)

        return guess(spelled(text))

    def scores(self, text: Column) -> Column:
        """Array of (lang, score): each language's score, divided by the number of known trigrams (1 at least)."""
        if not self.langs:
            return F.from_json(F.lit("[]"), "array<struct<lang:string,score:double>>")

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            coded = self._coded()
            for texts in batches:
                found = [self.totals(t or "", coded) for t in texts]
                yield pd.Series([s / max(1, n) for s, n in found])

        langs = F.array(*map(F.lit, self.langs))
        return F.transform(score(spelled(text)), lambda s, i: F.struct(F.get(langs, i).alias("lang"), s.alias("score")))


def whole_scores(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", held: int = HELD) -> DataFrame:
    """(id, lang, score) of ``docs`` as by ``Detector.scores``, with all trigrams of ``rows`` and all languages.

    A language that has texts but no trigram has the logarithm of its share as its score.
    """
    known = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    langs = stored(known.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("texts")), "profile-languages")
    grams = stored(profiles(known, text, lang, None), "profile-trigrams")
    n, texts = langs.select(F.count("*"), F.sum("texts")).first()
    taught, size = grams.select(F.count_distinct("lang"), F.count_distinct("gram")).first()
    if n and taught == n <= MOST_LANGUAGES and n * size <= held:
        told = Detector.of({r["lang"]: r["texts"] for r in langs.collect()}, grams.toArrow())  # within ``held``
        return docs.select(id_col, F.explode(told.scores(F.col(text))).alias("s")).select(id_col, "s.lang", "s.score")
    # The logarithm of (n + 1) / (total + size) is split: the first part is 0 for what a language lacks, the second is the same for all trigrams.
    counted = stored(docs.select(id_col, text).withColumn("row", F.monotonically_increasing_id()), "profile-texts")
    entries = grams.select("gram", "lang", F.log1p("n").alias("w")).unionByName(grams.select("gram", F.lit(None).cast("string").alias("lang"), F.lit(1.0).alias("w")).distinct())
    sums = term_counts(counted, trigrams(F.col(text)), "row").join(entries, F.col("term") == F.col("gram")).groupBy("row", "lang").agg(F.sum(F.col("tf") * F.col("w")).alias("s"))
    sums = stored(sums, "profile-sums")
    totals = grams.groupBy("lang").agg(F.log(F.sum("n") + F.lit(size)).alias("rest"))
    priors = langs.join(totals, "lang", "left").select("lang", F.log(F.col("texts") / F.lit(texts)).alias("prior"), "rest")
    every = counted.select(id_col, "row").crossJoin(priors).join(sums.where("lang IS NULL").select("row", F.col("s").alias("k")), "row", "left")
    every = every.join(sums.where("lang IS NOT NULL"), ["row", "lang"], "left")
    k = F.when(F.col("rest").isNotNull(), F.coalesce("k", F.lit(0.0))).otherwise(0.0)
    score = (F.col("prior") + F.coalesce("s", F.lit(0.0)) - k * F.coalesce("rest", F.lit(0.0))) / F.greatest(k, F.lit(1.0))
    return every.select(id_col, "lang", score.alias("score"))
