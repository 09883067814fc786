"""The script histogram against a pattern a bucket, the trigram detector against brute force and on texts that it has not seen."""

import math
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tonewise.functions.language import BUCKETS, bucket, detect_language, main_script
from tonewise.functions.tables import LATIN, SCRIPTS
from tonewise.operators.detector import Detector


def bucket_of(c):
    code = ord(c)
    if any(lo <= code <= hi for lo, hi in LATIN):
        return "latin"
    return next((k for k, lo, hi in SCRIPTS if lo <= code <= hi), "other")


def script_of(text):
    letters = [c for c in text if unicodedata.category(c)[0] == "L"]
    n = Counter(map(bucket_of, letters))
    first = {}
    for i, c in enumerate(letters):
        first.setdefault(bucket_of(c), i)
    return max(n, key=lambda k: (n[k], -first[k]), default=None)


def test_every_code_point_has_its_bucket(spark):
    got = spark.range(0x30000).select(F.get(F.array(*map(F.lit, BUCKETS)), bucket(F.col("id").cast("int"))).alias("b")).toArrow().column("b").to_pylist()
    assert [(i, b) for i, b in enumerate(got) if b != bucket_of(chr(i))] == []


def test_main_script(spark):
    rng = random.Random(2)
    letters = ["a", "é", "я", "ж", "漢", "か", "カ", "ぁ", "ا", "ת", "\U00020000", "ꙁ", "1", " ", "😀", "ก", "한", "̀"]
    texts = ["", "12 !", *("".join(rng.choices(letters, k=rng.randrange(12))) for _ in range(800)), "x" * 5_000 + "я" * 5_001]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["s"] for r in df.select("i", main_script(F.col("text")).alias("s")).collect()}
    assert [(t, got[i], script_of(t)) for i, t in enumerate(texts) if got[i] != script_of(t)] == []


def grams(text):
    s = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower())
    s = f" {' '.join(s.split())} "
    return [s[i : i + 3] for i in range(len(s) - 2)]


def test_detector_by_brute_force(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices("abcñ -1" if lang == "xx" else "abdeé .", k=30)), lang) for lang in ["xx"] * 9 + ["yy"] * 14 + [None] * 2]
    rows += [(None, "xx"), ("zz zz", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    size = 25
    d = Detector.fit(df, size=size)
    known = [(t, k) for t, k in rows if t is not None and k is not None]
    profile = {}
    for lang in ("xx", "yy"):
        c = Counter(g for t, k in known if k == lang for g in grams(t))
        profile[lang] = dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size])
    vocabulary = set().union(*profile.values())
    assert d.langs == ["xx", "yy"] and set(d.grams) == vocabulary
    texts = [t for t, _ in rows] + ["", "qqqq", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    scores = {r["i"]: [s["score"] for s in r["s"]] for r in df.select("i", d.scores(F.col("text")).alias("s")).collect()}
    guesses = {r["i"]: r["g"] for r in df.select("i", d.column(F.col("text")).alias("g")).collect()}
    for i, t in enumerate(texts):
        found = [g for g in grams(t or "") if g in vocabulary]
        want = []
        for lang in ("xx", "yy"):
            prior = math.log(sum(k == lang for _, k in known) / len(known))
            total = prior + sum(math.log((profile[lang].get(g, 0) + 1) / (sum(profile[lang].values()) + len(vocabulary))) for g in found)
            want.append(total / max(1, len(found)))
        assert scores[i] == pytest.approx(want)
        assert guesses[i] == (None if not found else "xx" if want[0] >= want[1] else "yy")


def test_detector_without_teachers(spark):
    df = spark.createDataFrame([(None, "xx"), ("abc", None)], "text string, lang string")
    d = Detector.fit(df)
    assert df.select(d.column(F.col("text"))).distinct().collect() == [(None,)]
    assert df.select(F.size(d.scores(F.col("text")))).distinct().collect() == [(0,)]
    assert [r[0] for r in df.select(detect_language(F.col("text"), d.column(F.col("text")))).collect()] == ["und", "en"]


def test_detector_on_unseen_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    d = Detector.fit(docs.join(labels, "doc_id"))
    unseen = docs.join(labels, "doc_id", "left_anti").where("char_length(text) >= 40")
    right = unseen.select("lang", detect_language(F.col("text"), d.column(F.col("text"))).alias("g")).select(F.avg((F.col("lang") == F.col("g")).cast("int"))).first()[0]
    rules = unseen.select("lang", detect_language(F.col("text")).alias("g")).select(F.avg((F.col("lang") == F.col("g")).cast("int"))).first()[0]
    assert right > 0.98 and right >= rules


def test_trigrams_of_a_text_are_looked_up_at_once():
    import random
    import time

    import numpy as np

    from tonewise.operators.detector import Detector

    rng = random.Random(9)
    grams = list({"".join(rng.choices("abcdeé漢 😀", k=3)) for _ in range(300)})
    told = Detector(["x", "y"], {g: i for i, g in enumerate(grams)}, np.random.default_rng(9).normal(size=(len(grams), 2)), np.array([-0.5, -1.0]))

    def plain(text):
        at = [told.grams[text[i : i + 3]] for i in range(len(text) - 2) if text[i : i + 3] in told.grams]
        return told.prior + told.logs[at].sum(0), len(at)

    texts = ["", "a", "ab", "abc", *("".join(rng.choices("abcdeé漢 😀z", k=5_000)) for _ in range(60))]
    began = time.process_time()
    want = [plain(t) for t in texts]
    slow, began = time.process_time() - began, time.process_time()
    coded = told._coded()
    got = [told.totals(t, coded) for t in texts]
    assert time.process_time() - began < slow / 2
    assert all(n == m and np.allclose(s, w, rtol=0, atol=1e-9) for (s, n), (w, m) in zip(got, want, strict=True))


def test_language_scores_know_every_trigram_and_language(spark, tmp_path, monkeypatch):
    import duckdb

    from tonewise.operators import detector
    from tonewise.plans import oracles, queries

    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzé"
    docs = [(i, "".join(rng.choices(letters + " ", k=400)), "xx" if i % 3 else "yy") for i in range(40)]
    rare = next(g for t in [docs[1][1]] for g in grams(t) if " " not in g and sum(g in u for _, u, _ in docs) == 1)
    docs += [(100, rare, "xx"), (101, None, "xx"), (102, "", "zz"), (103, "12 !", None), (104, "ab", None), (105, rare + " " + rare, "yy")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()

    def check(labels):
        path = f"{tmp_path}/labels{len(labels)}"
        spark.read.parquet(f"{tmp_path}/documents.parquet").write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(i, 0) for i in labels], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
        for name in ("documents", "labels"):
            db.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
        want = {(i, k): s for i, k, s in db.execute(oracles.oracle_sql()["language_scores"]).fetchall()}
        for held in (detector.HELD, 10):  # held by the workers, joined
            monkeypatch.setattr(queries, "whole_scores", lambda *a, held=held: detector.whole_scores(*a, held=held))
            rows = queries.language_scores(spark, path).collect()
            got = {(r["doc_id"], r["lang"]): r["score"] for r in rows}
            assert len(rows) == len(got) and got.keys() == want.keys() and got == pytest.approx(want, abs=2e-6)
        return want

    want = check(range(40))
    assert want[100, "xx"] > want[100, "yy"]  # a trigram that stands once, in a profile of thousands
    check([*range(40), 102])  # a language without a trigram
