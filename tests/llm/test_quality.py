"""The boosted trees: walks and cuts against brute force, held-out accuracy, odd texts."""

import math
from zlib import crc32

import numpy as np
import pytest

from tonewise.llm import quality, queries
from tonewise.llm.quality import NAMES, Trees


def walk(model: Trees, x):
    total = model.base
    for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if x[f[node]] > t[node] else 1)
        total += leaf[node - len(f)]
    return 1 / (1 + math.exp(-total))


def made(n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)), 1)
    x[:, 4] = 3
    return x, ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)


def test_vectorised_walk():
    x, y = made()
    model = quality.boost(x, y, np.ones(len(x)), trees=12, depth=3)
    assert np.allclose(model.scores(x), [walk(model, r) for r in x], atol=1e-12)
    assert np.mean((quality.boost(x, y, np.ones(len(x)), trees=60, depth=3).scores(x) >= 0.5) == y) > 0.98


def test_first_cut_by_brute_force():
    x, y = made(60)
    y = (x[:, 2] > 0.5).astype(float)
    model = quality.boost(x, y, np.ones(len(x)), trees=1, depth=1, l2=1.0, least=1.0)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = max(
        (sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (x[:, f] <= t, x[:, f] > t)), f)
        for f in range(4) for t in np.unique(x[:, f]) if min(h[x[:, f] <= t].sum(), h[x[:, f] > t].sum()) >= 1
    )
    f, t = model.feature[0, 0], model.threshold[0, 0]
    assert best[1] == f == 2
    assert math.isclose(sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (x[:, f] <= t, x[:, f] > t)), best[0])
    left = x[:, f] <= t
    assert math.isclose(model.leaf[0, 0], -0.1 * g[left].sum() / (h[left].sum() + 1))


def test_bins_agree_with_thresholds():
    x, _ = made(300, 5)
    for c, col in zip(quality.edges(x, 8), x.T, strict=True):
        assert len(c) < 8 and (c < col.max()).all()
        cell = np.searchsorted(c, col, "left")
        for b, cut in enumerate(c):
            assert ((cell > b) == (col > cut)).all()


def test_statistics(monkeypatch):
    text = "The cat sat.\nThe cat sat.\n\nOH NO 42 ### ünder"
    s = dict(zip(NAMES, quality.statistics(text), strict=True))
    assert s["log_chars"] == math.log1p(len(text)) and s["log_lines"] == math.log1p(3) and s["repeated_lines"] == pytest.approx(1 / 3)
    words = text.split()
    assert s["mean_word"] == pytest.approx(np.mean(list(map(len, words)))) and s["sd_word"] == pytest.approx(np.std(list(map(len, words))))
    assert s["different_words"] == len(set(words)) / len(words) and s["commonest_word"] == 2 / len(words)
    assert s["capitalised_words"] == 4 / 11 and s["upper_words"] == 2 / 11 and s["words_without_letters"] == 2 / 11 and s["words_ending_in_marks"] == 3 / 11
    assert s["different_pairs"] == len(set(zip(words, words[1:], strict=False))) / (len(words) - 1)
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(NAMES)
    assert all(map(math.isfinite, quality.statistics("\n \t") + quality.statistics("x" * 100_000) + quality.statistics("\ud800")))
    long = "alpha beta gamma delta " * 500
    whole = quality.statistics(long)
    monkeypatch.setattr(quality, "PIECE", 1_000)
    assert "".join(quality.pieces(long)) == long
    cut = quality.statistics(long)
    assert [a for a, b, n in zip(whole, cut, NAMES, strict=True) if "line" not in n and abs(a - b) > 1e-3] == []


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op11_quality(spark, sf).collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.97
    assert np.mean([r["predicted"] for r in held if truth[r["doc_id"]] == 1]) > 0.98


def test_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "plain words of a text", "x"), (3, "plain words of a text", "x"), (None, "no id", "x"), (4, "w " * 50_000, "x")],
        "doc_id long, text string, quality string",
    )
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (3, None, 0), (None, 1, 0), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, text int")
    got = quality.report(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "3", "4", "None"] and all(0 <= r["score"] <= 1 for r in got)
    assert quality.report(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.report(docs, labels.limit(0)).collect()} == {0.0}
