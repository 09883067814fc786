"""Spelling variants against brute force."""

import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import pytest

from tonewise.llm import spelling

DOCS = "doc_id long, text string, word string, n int, key int"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def found(spark, counts, **options):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return [tuple(r) for r in spelling.grouped(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize(("letters", "most"), [("ab", 3), ("abcé", 0), ("stün\U0001f600", 50)])
def test_by_brute_force(spark, letters, most):
    rng = random.Random(len(letters))
    counts = {"".join(rng.choices(letters, k=rng.randrange(1, 8))): 5 ** rng.randrange(1, 9) + rng.randrange(3) for _ in range(250)}
    got = found(spark, counts, most=most)
    assert len(got) == len(counts) and set(got) == brute(counts)


def test_lists_of_keys_that_are_not_broadcast(spark, monkeypatch):
    counts = {f"{'a' * i}{x}{'b' * (5 - i)}": 5 + i for i in range(6) for x in "abc"}
    monkeypatch.setattr(spelling, "BROADCAST_ROWS", 0)
    assert set(found(spark, counts, most=1)) == brute(counts)


def test_long_chain(spark):
    counts = {"x" * i: 5**i for i in range(1, 12)}
    got = found(spark, counts)
    assert set(got) == brute(counts) and {r[2] for r in got} == {"x" * 11}


def test_fifth_powers_tell_exchanges_apart():
    letters = [*range(97, 123), *range(0xC0, 0x100)]
    seen = Counter(a**5 - b**5 for a in letters for b in letters if a != b)
    assert max(seen.values()) == 1


def counted(rows, every, least, min_count):
    total = Counter()
    for doc_id, text, *_ in rows:
        for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", text or "")).items():
            for _ in range(n):
                w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
                if h % every == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= min_count}


def test_words_by_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcDEÀÿ×é", k=rng.randrange(1, 9))) for _ in range(60)]
    rows = [(i % 30 if i % 7 else None, "".join(rng.choice(words) + rng.choice([" ", "Ā", "-", "9", "\n"]) for _ in range(40)), "x", 1, 2) for i in range(60)]
    rows += [(1, None, "x", 1, 2), (2, "", "x", 1, 2), (3, " 12 ", "x", 1, 2), rows[0]]
    df = spark.createDataFrame(rows, DOCS)
    want = counted(rows, 7, 4, 3)
    for flush in (200_000, 5):
        got = [tuple(r) for r in spelling.word_counts(df, 4, 3, 7, flush).collect()]
        assert len(got) == len(want) and dict(got) == want
    assert {tuple(r) for r in spelling.report(df, 7, 4, 3).collect()} == brute(want)
    assert spelling.report(df.limit(0)).count() == 0
    text = "Straße über " * 50_000
    assert spelling._runs(text.encode(), 6) == Counter({"straße".encode(): 50_000})
    monkeypatch.setattr(spelling, "WHOLE_BYTES", 10)
    assert spelling._runs(text.encode(), 6) == Counter({"straße".encode(): 50_000})
