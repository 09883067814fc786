"""Spelling variants by anagram hashing.

A letter's value is its code point to the fifth power; a word's key is the sum
over its letters (modulo a prime), the same for all its anagrams. Two words one
edit apart have keys that differ by one letter's value (added or removed) or by
the difference of two (exchanged). So each word is written under its key and,
for each different letter, under its key without that letter: equal keys are an
addition or removal (whole against lessened) or an exchange (lessened against
lessened, without different letters). What meets is verified for the order of
its letters by edit distance.

Words that share a key in large numbers are anagrams of each other but for a
letter. Keys of more than ``most`` lessened words are told further by the order
of what is left (a hash of the string without each one of the letter's places),
so that in them hardly a pair meets that isn't one edit apart; a group of one
string left over and one place has a word a letter of the alphabet at most. No
pair is dropped.

A word's form is its near word of the largest count, if that is ``ratio`` times
its own or more. Counts grow along forms, so roots are found by pointer jumping
in as many rounds as the logarithm of the longest chain.

Words are counted in tasks first (``flush`` different words at most), then
summed by word. The driver sees counts of tables only.

Defined cases: null, empty and wordless texts have no words. A null id is the
empty text in the digest. Repeated rows count each. An empty table gives an
empty result. A word without letters or null is near to nothing. Ties of counts go to the smallest word in code-point order. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise.llm.common import discard, in_arrow, saved

#: Letters of bytes lower-cased in A-Z: a-z, and U+00C0 to U+00FF in UTF-8.
RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")
PRIME = (1 << 61) - 1
#: Bytes of a text whose runs are held at once.
WHOLE_BYTES = 4 << 20
#: Rows of a broadcast list of keys; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 100_000


def n_letters(run: bytes) -> int:
    return len(run) - run.count(b"\xc3")


def _runs(text: bytes, least: int) -> Counter:
    text = text.lower()  # bytes: A-Z only
    if len(text) <= WHOLE_BYTES:
        return Counter([r for r in RUN.findall(text) if len(r) >= least])
    return Counter(r for r in map(re.Match.group, RUN.finditer(text)) if len(r) >= least)


def _count(every: int, least: int, flush: int):
    def out(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()).cast(pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                start = crc32(f"{doc_id}:".encode())
                for r, n in _runs(text, least).items():
                    if every and (h := crc32(r, start)) % every == 0:
                        s = r.decode()
                        at = h % len(s)
                        r = (s[:at] + s[at + 1 :]).encode()
                    if len(r) >= least and n_letters(r) >= least:
                        total[r] += n
                if len(total) > flush:
                    yield out(total)
                    total.clear()
        yield out(total)

    return run


def word_counts(docs: DataFrame, least: int = 6, min_count: int = 5, every: int = 0, flush: int = 200_000) -> DataFrame:
    """(word, n): maximal runs of letters of at least ``least``, that occur ``min_count`` times or more.

    With ``every``, a run loses one letter where ``every`` divides the crc32 of
    ``<doc_id>:<run>``: the letter at that digest modulo the run's length.
    """
    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    counts = in_arrow(rows, _count(every, least, flush), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, the word of each, and each word's first place."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return points, np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes


def values(points: np.ndarray) -> np.ndarray:
    """The fifth power of each code point, modulo the prime."""
    different, at = np.unique(points, return_inverse=True)
    return np.array([pow(int(p), 5, PRIME) for p in different], np.int64)[at]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) -> (key, letter, word, n): letter 0 with the whole word's key, else the key without that letter."""
    for b in batches:
        words = b.column("word").to_pylist()
        if not words:
            continue
        points, of, first = _letters(words)
        v = values(points)
        high, low = np.add.reduceat(v >> 31, first) % PRIME, np.add.reduceat(v & ((1 << 31) - 1), first)
        for _ in range(31):  # high * 2^31 in 63 bits
            high = high * 2 % PRIME
        whole = (high + low) % PRIME
        pair = np.unique(of * (1 << 21) + points)
        at, letter = pair >> 21, pair & ((1 << 21) - 1)
        less = (whole[at] - values(letter)) % PRIME
        take = pa.array(np.concatenate([np.arange(len(words)), at]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([whole, less])), pa.array(np.concatenate([np.zeros(len(words), np.int32), letter.astype(np.int32)])),
                b.column("word").take(take), b.column("n").take(take),
            ],
            names=["key", "letter", "word", "n"],
        )


def _told_by_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, letter, word, n) -> the same with ``rest``, a row for each different string that is left without one such letter."""
    for b in batches:
        take, rest = [], []
        for i, (letter, word) in enumerate(zip(b.column("letter").to_pylist(), b.column("word").to_pylist(), strict=True)):
            mark = chr(letter)
            left = {word[: m] + word[m + 1 :] for m in range(len(word)) if word[m] == mark} if letter else {word}
            rest += [xxhash.xxh3_64_intdigest(s.encode()) >> 1 for s in left]
            take += [i] * len(left)
        at = pa.array(take, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("key", "letter", "word", "n")] + [pa.array(rest, pa.int64())], names=["key", "letter", "word", "n", "rest"])


def near_words(words: DataFrame, most: int = 50) -> DataFrame:
    """(a, b, n_b): all ordered pairs of words one edit apart."""
    rows = saved(in_arrow(words.select("word", "n").where(F.col("word") != ""), _keys, "key long, letter int, word string, n long"), "spelling-keys")
    crowded = rows.where(F.col("letter") != 0).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > most).select("key")
    crowded = saved(crowded, "spelling-crowded")
    n = crowded.count()
    plain = rows.withColumn("rest", F.lit(0).cast("long"))
    if n:
        keys = F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded
        told = in_arrow(rows.join(keys, "key", "left_semi").select("key", "letter", "word", "n"), _told_by_order, "key long, letter int, word string, n long, rest long")
        plain = plain.join(keys, "key", "left_anti").unionByName(told)
    less = plain.where(F.col("letter") != 0).select("key", "rest", "letter", F.col("word").alias("a"), F.col("n").alias("n_a"))
    more = plain.select("key", "rest", F.col("letter").alias("other"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = less.join(more, ["key", "rest"]).where((F.col("other") == 0) | (F.col("other") > F.col("letter")))
    met = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()
    ways = F.explode(F.array(F.struct("a", "b", "n_b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))))
    return met.select(ways.alias("x")).select("x.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word that has a form."""
    now = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(now.join(further, "root", "left").select("word", "root", "next"), "spelling-roots")
        moved = step.where(F.col("next").isNotNull()).count()
        discard(now)
        if not moved:
            return step.select("word", "root")
        now = saved(step.select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        discard(step)


def grouped(words: DataFrame, ratio: int = 5, most: int = 50) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of ``words`` (word, n); words differ."""
    words = saved(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    best: Column = F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("word")))
    near = near_words(words, most).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    told = words.join(near, "word", "left")
    strong = -F.col("best.n") >= ratio * F.col("n")
    told = told.select(
        "word", F.when(strong, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, -F.col("best.n")).alias("form_n"),
    )
    told = saved(told, "spelling-forms")
    roots = _roots(told.where(F.col("form").isNotNull()))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame, every: int = 199, least: int = 6, min_count: int = 5, ratio: int = 5) -> DataFrame:
    return grouped(word_counts(docs, least, min_count, every), ratio)
