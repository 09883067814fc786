import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tonewise.functions import format as fmt
from tonewise.operators import features, metrics, newton, prepare, profile
from tonewise.plans import models, queries, serving, training
from tonewise.sources import corpora, requests, sinks, timeline


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_labels_and_languages(spark):
    df = spark.createDataFrame([("1", "EN-us"), ("0.9", "unknown"), ("x", None), (None, "und"), ("NaN", "Fr")], "y string, l string")
    got = rows_of(df.select(prepare.coerced_label(F.col("y")), prepare.canonical_language(F.col("l"))))
    assert got == [(1, "en"), (0, "und"), (None, "und"), (None, "und"), (None, "fr")]


def test_corpus(spark):
    a = spark.createDataFrame([(0, "same", 1, "en"), (1, "clash", 0, "en"), (2, "x", 0, "en"), (3, None, 0, "en")], "row_id long, text string, is_toxic int, lang string")
    b = spark.createDataFrame([(0, "SAME", 1, "de"), (1, "Clash", 1, "de"), (2, "own", 0, "de")], a.schema)
    got = sorted(rows_of(prepare.build_corpus([a, b]).select("normalized", "is_toxic", "lang")))
    assert got == [("own", 0, "de"), ("same", 1, "en")]
    assert prepare.quota(prepare.union_sources([a, b]), 1).count() == 4
    assert prepare.quota(a, 0).count() == 4
    assert prepare.build_corpus([a.limit(0)]).count() == 0


def test_split_keeps_shares(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("is_toxic"), F.lit("en").alias("lang"))
    parts = {r["part"]: r["count"] for r in prepare.split(df).groupBy("part").count().collect()}
    assert abs(parts["test"] - 320) <= 4 and abs(parts["val"] - 320) <= 4
    assert rows_of(prepare.split(df).orderBy("row_id").select("part")) == rows_of(prepare.split(df.repartition(3)).orderBy("row_id").select("part"))


def test_terms_agree(spark):
    texts = ["ab cd e", "", "x", "größe 12 héé", "a_b c-d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for block, terms in (("word", features.word_terms), ("char", features.char_terms)):
        for t, got in zip(texts, rows_of(df.select(terms(F.col("t")))), strict=True):
            assert sorted(got[0]) == sorted(features.terms_of(t, block))


def test_term_counts_by_plain_loops(spark):
    texts = ["a b a b aa", "", None, "x", "aa  aa \U0001F600bb aa", "aa  aa \U0001F600bb aa"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    want = {(i, term, n) for i, t in enumerate(texts) for term, n in Counter(features.terms_of(t or "", "char")).items()}
    counts = features.term_counts(df, features.char_terms(F.col("t")))
    assert {tuple(r) for r in rows_of(counts)} == want and counts.count() == len(want)
    found = {r["term"]: r["df"] for r in features.document_frequency(df, features.char_terms(F.col("t"))).collect()}
    assert found == Counter(term for _, term, _ in want)


def test_first_of_keys_with_one_label(spark):
    rows = [(0, 3, "a", 1), (0, 2, "a", 1), (1, 1, "a", 1), (0, 4, "b", 0), (0, 5, "b", 1), (0, 6, "c", None), (0, 7, "d", None), (0, 8, "d", 0)]
    df = spark.createDataFrame(rows, "source_rank int, row_id long, normalized string, is_toxic int")
    got = rows_of(prepare.keep_first(df, label="is_toxic"))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, rows_of(prepare.keep_first(prepare.drop_label_conflicts(df)))), key=str)
    assert {r[1] for r in got} == {2, 7}


def test_shares_leave_out_the_unknown(spark):
    rows = [("a", i, lang) for i, lang in enumerate(["und"] * 5 + [None] + ["en"] * 3 + ["de"])] + [("b", 0, "und")]
    posts = spark.createDataFrame(rows, "author string, pos long, language string")
    got = profile.language_shares(posts).select("author", "language", "n", "share").collect()
    assert sorted(map(tuple, got)) == [("a", "de", 1, 25.0), ("a", "en", 3, 75.0)]


def test_metrics_edges(spark):
    schema = "is_toxic int, lang string, prob double"
    one_class = spark.createDataFrame([(0, "en", 0.2), (0, "en", 0.9)], schema)
    assert metrics.roc_auc(one_class).first()[0] is None
    assert metrics.roc_auc(one_class.limit(0)).first()[0] is None
    assert metrics.best_cut(metrics.sweep(one_class)).first()["cut"] == 5.0
    assert metrics.tune_thresholds(one_class, 1).count() == 1
    rows = spark.createDataFrame([(1, "en", 0.9), (1, "en", 0.6), (0, "en", 0.6), (0, "en", 0.1)], schema)
    assert metrics.roc_auc(rows).first()[0] == pytest.approx(0.875)
    cut = metrics.best_cut(metrics.sweep(rows)).first()
    assert cut["cut"] == 11.0 and cut["f1"] == pytest.approx(0.8)
    cuts = spark.createDataFrame([(None, 50.0), ("de", 10.0)], "lang string, cut double")
    assert rows_of(metrics.evaluate(rows, cuts, 5).select("lang", "n", "tp", "fp")) == [(None, 4, 2, 1)]


def test_thresholds(spark):
    meta = models.Meta(thresholds={"fr": 40.0}, global_threshold=0)
    rows = spark.createDataFrame([("fr",), ("en",)], "l string")
    cut = lambda *a: [r[0] for r in rows.select(serving.threshold(F.col("l"), *a)).collect()]
    assert cut(meta, "linear") == [40.0, 50.0]
    assert cut(meta, "transformer") == [50.0, 50.0]
    assert cut(meta, "transformer", 12.5) == [12.5, 12.5]
    assert models.toxic_label(["neutral", "Hate"]) == 1 and models.toxic_label(["a", "b"]) == 1 and models.toxic_label(["TOXIC", "b"]) == 0


def test_verdict_uses_unrounded_cut(spark):
    rows = spark.createDataFrame([("the and", 0.50004), ("the and", 0.5)], "text string, prob double")
    meta = models.Meta(global_threshold=50.004)
    got = rows_of(serving.verdicts(rows, F.col("prob"), F.col("text"), meta).select("score", "threshold", "is_toxic"))
    assert got == [(50.0, 50.0, False), (50.0, 50.0, False)]


def test_backend_choice():
    def broken():
        raise RuntimeError

    assert models.choose_backend("auto", lambda: "l", None) == "l"
    assert models.choose_backend("auto", lambda: "l", lambda: "t") == "t"
    assert models.choose_backend("transformer", lambda: "l", broken) == "l"
    assert models.choose_backend("linear", lambda: "l", lambda: "t") == "l"


def test_batch_scorer(spark):
    scorer = models.BatchScorer(lambda: lambda texts: [len(t) / 100 for t in texts], batch=2)
    rows = spark.createDataFrame([("abc",), ("@you",), (None,)], "text string")
    got = rows_of(serving.Classifier(scorer).analyze(rows).select("score", "is_toxic"))
    assert got == [(3.0, False), (4.0, False), (0.0, False)]


@pytest.mark.filterwarnings("ignore")
def test_train_score_and_reload(spark, tmp_path):
    bad, good = ["you awful idiot", "stupid trash person", "idiot and trash"], ["what a lovely day", "nice walk today", "lovely people here"]
    rows = [(i, f"{(bad if i % 2 else good)[i % 3]} number{i} word{i % 7}", i % 2, "en" if i % 3 else "de") for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, text string, is_toxic int, lang string")
    model, meta, scored = training.train([df], training.Options(word_features=500, char_features=500, min_support=5, epochs=5, test=0.2, val=0.2))
    assert meta.accuracy > 0.9 and meta.n_train + meta.n_test < meta.n_samples
    model.save(f"{tmp_path}/m")
    meta.save(f"{tmp_path}/meta")
    again, meta2 = models.Ensemble.load(f"{tmp_path}/m"), models.Meta.load(f"{tmp_path}/meta")
    assert meta2.thresholds == meta.thresholds and models.Meta.load(f"{tmp_path}/none") == models.Meta()
    posts = spark.createDataFrame([("1d1ot s t u p i d trash",), ("lovely walk",)], "text string")
    got = [r["score"] for r in serving.Classifier(again, meta2).analyze(posts).collect()]
    want = [r["score"] for r in serving.Classifier(model, meta).analyze(posts).collect()]
    assert got == want and got[0] > got[1]
    sinks.write_holdout(scored, f"{tmp_path}/h")
    assert corpora.holdout(spark, f"{tmp_path}/h").count() == meta.n_test


def test_sources(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('text,is_toxic,lang\n"two\nlines",1.0,EN\nplain,x,en\n,1,en\nlast,0,unknown\n')
    got = sorted(rows_of(corpora.from_csv(spark, str(p)).select("text", "is_toxic", "lang")))
    assert got == [("last", 0, "und"), ("two\nlines", 1, "en")]
    zh = spark.createDataFrame([("a", " 1"), ("b", "2"), ("c", "0")], "input string, output string")
    assert rows_of(corpora.from_text_labels(zh, "input", "output", "zh").select("text", "is_toxic")) == [("a", 1), ("c", 0)]
    ko = spark.createDataFrame([("a", 1), ("b", 0)], "t string, clean int")
    assert rows_of(corpora.from_clean_flags(ko, "t", "clean", "ko").select("is_toxic")) == [(0,), (1,)]
    assert len(corpora.optional(lambda: spark.read.parquet("/nowhere"), lambda: zh)) == 1


def test_requests(spark):
    bodies = ['{"text": "hi"}', json.dumps({"texts": ["a", None, ""]}), '{"texts": [" "]}', "{}", json.dumps({"texts": ["x"] * 300})]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = requests.texts_of(df)
    assert rows_of(got.where("i < 2").select("status", "text")) == [(200, "hi"), (200, "a"), (200, "None"), (200, "")]
    assert {r[0] for r in rows_of(got.where("i in (2, 3)").select("status"))} == {400}
    assert got.where("i = 4").count() == 200
    assert one(spark, requests.lines_of(F.lit(" a \n\n b"))) == ["a", "b"]
    assert [one(spark, requests.clamp_count(F.lit(x))) for x in ("5", "0", "500", "x")] == [5, 1, 100, 20]


def test_formats(spark):
    def num(x):
        return one(spark, fmt.compact_number(F.lit(x)))

    assert [num(x) for x in (999.0, 1234.0, 1000.0, 999999.0, 1.5e6, 2e9, float("nan"))] == ["999", "1.2K", "1K", "1000K", "1.5M", "2B", "0"]
    assert one(spark, fmt.normalize_handle(F.lit("  @@Some-One/é_1234567890123"))) == "SomeOne_1234567"
    now = F.lit("2020-01-02 00:00:00").cast("timestamp_ntz")
    parse = lambda x: one(spark, fmt.parse_created_at(F.lit(x), now))
    assert parse("Wed Oct 10 20:19:24 +0200 2018") == dt.datetime(2018, 10, 10, 20, 19, 24)
    assert parse("Wed, 3 Oct 2018 20:19:24 GMT") == dt.datetime(2018, 10, 3, 20, 19, 24)
    assert parse("rubbish") == parse(None) == dt.datetime(2020, 1, 2)
    text = "see https://example.org/" + "a" * 40 + " @me #tag."
    kinds = [(r["kind"]) for r in one(spark, fmt.rich_text(F.lit(text))) if r["text"].strip()]
    assert kinds == ["text", "link", "mention", "text"]
    assert one(spark, fmt.large_avatar(F.lit("a_normal_normal.png"))) == "a_400x400_normal.png"
    assert one(spark, fmt.percent(F.lit(None).cast("double"))) == "—"
    assert one(spark, fmt.clamp_percent(F.lit(120.0))) == 100.0
    assert [one(spark, fmt.language_name(F.lit(x))) for x in ("", "de", "xx")] == ["Unknown", "German", "XX"]


def test_profile_and_cache(spark):
    posts = spark.createDataFrame(
        [("a", 0, "x", "en", 80.0, True, 50.0), ("a", 1, "y", "fr", 10.0, False, 50.0), ("a", 2, "z", "fr", 10.0, False, 50.0)],
        "author string, pos long, text string, language string, score double, is_toxic boolean, threshold double",
    )
    r = profile.profile(posts, ["text"]).first()
    assert r["summary"]["toxic_ratio"] == 33.3 and [x["language"] for x in r["summary"]["languages"]] == ["fr", "en"]
    assert [p["text"] for p in r["posts"]] == ["x", "y", "z"] and profile.tab(posts, "flagged").count() == 1
    now = dt.datetime(2020, 1, 1, 0, 20)
    snaps = spark.createDataFrame([("Ann", dt.datetime(2020, 1, 1), 50), ("ann", dt.datetime(2020, 1, 1, 0, 15), 5), ("bob", dt.datetime(2019, 1, 1), 50)], "u string, t timestamp_ntz, n int")
    at = F.lit(now).cast("timestamp_ntz")
    assert rows_of(timeline.cached(snaps, "u", "t", "n", 5, at).select("u")) == [("ann",)]
    assert timeline.cached(snaps, "u", "t", "n", 20, at).count() == 0
    assert rows_of(timeline.cached(snaps, "u", "t", "n", 20, at, True).select("u")) == [("bob",)]
    assert timeline.evicted(snaps, "u", "t", 1).count() == 1


def test_streamed_windows(spark, tmp_path):
    from tonewise.streaming import posts

    rows = [("the and you", dt.datetime(2024, 1, 1, 0, m), 0.9 if m % 2 else 0.1) for m in range(20)]
    spark.createDataFrame(rows, "text string, ts timestamp, p double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("text string, ts timestamp, p double").parquet(f"{tmp_path}/in")
    scored = posts.score_stream(stream, F.col("p"), models.Meta())
    q = posts.toxic_windows(scored).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(rows_of(spark.table("windows").select("posts", "toxic"))) == [(10, 5), (10, 5)]


def test_score_documents_trains_at_full_size(spark, sf, monkeypatch):
    asked = {}

    class Stop(Exception):
        pass

    def fit(df, vectorizer, id_col="row_id", epochs=30):
        asked["sizes"] = [size for _, size, _ in vectorizer.blocks]
        asked["epochs"] = epochs
        raise Stop

    monkeypatch.setattr(queries.Ensemble, "fit", staticmethod(fit))
    with pytest.raises(Stop):
        queries.score_documents(spark, sf)
    o = training.Options()
    assert asked == {"sizes": [o.word_features, o.char_features], "epochs": o.epochs}


def stand_in(words):
    """A backend that flags texts with one of some words."""
    return models.BatchScorer(lambda: lambda texts: [0.9 if any(w in t for w in words) else 0.1 for t in texts])


def test_smoke_and_holdout(spark):
    from tonewise.plans import evaluation

    assert len(evaluation.SMOKE_ROWS) == 34 and len({lang for *_, lang in evaluation.SMOKE_ROWS}) == 15
    rows = corpora.literal(spark, evaluation.SMOKE_ROWS)
    bad = ["moron", "idiot", "crétin", "cretino", "sukkel", "aptal", "подонок", "дурний", "تافه", "बेवकूफ", "बेवकूफ", "白痴", "馬鹿", "lowlife", "what an"]
    judged, code = evaluation.run_smoke(serving.Classifier(stand_in(bad)), rows)
    assert code == 0 and judged.count() == 34 and "detected" in judged.columns
    assert {r["detected"] for r in judged.where("lang = 'uk'").collect()} == {"uk"}
    assert evaluation.run_smoke(serving.Classifier(stand_in(["never"])), rows)[1] == 2
    got = evaluation.run_holdout(serving.Classifier(stand_in(bad)), rows.unionByName(rows.limit(0)), 2).collect()
    assert got[0]["lang"] is None and got[0]["n"] == 34 and got[0]["roc_auc"] > 0.8
    assert [r["n"] for r in got[1:]] == sorted((r["n"] for r in got[1:]), reverse=True) and got[1]["lang"] == "en"
    assert all(r["roc_auc"] is None for r in got[1:])
    assert evaluation.run_holdout(serving.Classifier(stand_in(bad)), rows, 2, 4).first()["n"] == 4


def test_single_texts_and_answers(spark):
    c = serving.Classifier(stand_in(["bad"]))
    assert c.score("a bad day") == 90.0 and c.is_toxic("a bad day") and not c.is_toxic(None)
    bodies = ['{"texts": ["bad", null, " "]}', '{"texts": "bad"}', '{"texts": 5}', '{"text": "\\n"}', '{"text": null}', "no json", '{"texts": []}', '{"texts": null, "text": "ok"}']
    got = {r["i"]: (r["status"], json.loads(r["body"])) for r in c.answers(spark.createDataFrame(list(enumerate(bodies)), "i int, body string"), "i").collect()}
    assert [got[i][0] for i in range(8)] == [200, 400, 400, 400, 200, 400, 400, 200]
    assert got[0][1]["backend"] == "transformer" and [(r["text"], r["is_toxic"]) for r in got[0][1]["results"]] == [("bad", True), ("None", False), (" ", False)]
    assert got[1][1] == got[2][1] == {"error": requests.NO_LIST} and got[3][1] == got[6][1] == {"error": requests.NO_TEXT}
    assert got[4][1]["results"][0]["text"] == "None"


def test_softmax_scorer():
    seen = []

    def logits(batch):
        seen.extend(map(len, batch))
        return [[0.0, len(b) / 100] for b in batch]

    got = models.softmax_scorer(logits, str.split, ["fine", "Toxic"])(["w " * 300, "w"])
    assert seen == [256, 1] and got[0] == pytest.approx(1 / (1 + 2.718281828 ** -2.56)) and got[0] > got[1] > 0.5


def test_label_conflicts_of_whole_texts(spark):
    long = "the same first twelve characters and then "
    rows = [(1, long + "one", 0), (2, long + "two", 1), (3, "Contradictory  www.x.org", 0), (4, "contradictory", 1), (5, "contradictory", 1)]
    got = queries.conflicting(spark.createDataFrame(rows, "row_id long, text string, is_toxic int"))
    assert sorted(r["row_id"] for r in got.collect()) == [3, 4, 5]


def test_fold_gate_is_exact():
    import re
    import unicodedata

    from tonewise.functions.normalize import STABLE

    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and re.match(f"[{STABLE}]", chr(c))]
    assert len(chars) > 128 and all(unicodedata.normalize("NFKC", c) == c for c in chars)
    assert unicodedata.normalize("NFKC", "".join(chars)) == "".join(chars)


def test_huber_gradients_by_plain_loops(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    rows = [(Vectors.sparse(5, sorted(rng.choice(5, 2, False).tolist()), rng.normal(size=2).tolist()), int(i % 2), 1.0 + i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, ["features", "is_toxic", "weight"]).withColumn("row_id", F.lit(1))
    got = models.ModifiedHuber.fit(newton.sparse_rows(df, "row_id", 3), 5, epochs=4)
    w, b, vw, vb, total = np.zeros(5), 0.0, np.zeros(5), 0.0, sum(r[2] for r in rows)
    for _ in range(4):
        g, gb = np.zeros(5), 0.0
        for v, label, k in rows:
            x, y = v.toArray(), 2 * label - 1
            z = y * (w @ x + b)
            d = k * (-4 * y if z < -1 else -2 * (1 - z) * y if z < 1 else 0.0)
            g, gb = g + d * x, gb + d
        vw, vb = 0.9 * vw - 2.0 * (g / total + 1e-6 * w), 0.9 * vb - 2.0 * gb / total
        w, b = w + vw, b + vb
    assert np.allclose(got.weights, w) and got.bias == pytest.approx(b)


def test_columns_that_the_operators_use_themselves(spark):
    rows = [(i, f"t{i % 7}", (i % 7) % 2 if i < 30 else i % 2, "en", *[i] * 8) for i in range(40)]
    own = ("h0", "h1", "nth", "n", "hash", "slice", "before", "c")
    df = spark.createDataFrame(rows, "row_id long, normalized string, is_toxic int, lang string, " + ", ".join(f"{c} long" for c in own)).withColumn("source_rank", F.lit(0))
    plain = df.drop(*own)
    for run in (prepare.drop_label_conflicts, prepare.keep_first, lambda d: prepare.quota(d, 5), lambda d: prepare.split(d)):
        got = run(df)
        assert set(own) <= set(got.columns)
        assert sorted(rows_of(got.drop(*own).select(*sorted(set(got.columns) - set(own))))) == sorted(rows_of(run(plain).select(*sorted(set(got.columns) - set(own)))))
        assert all(r[c] == r["row_id"] for r in got.collect() for c in own)


def test_profiles_detect_shown_posts_only(spark):
    from tonewise.operators import profile

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def language(pos):
        seen.add(1)
        return "en" if pos % 3 else "fr"

    posts = spark.range(3_000).select((F.col("id") % 2).cast("string").alias("author"), F.col("id").alias("pos"))
    shown = profile.first_posts(posts)
    rows = shown.withColumn("score", F.col("pos") / 10.0).withColumn("is_toxic", F.col("pos") % 2 == 0).withColumn("language", language("pos")).withColumn("threshold", F.lit(50.0))
    got = {r["author"]: r for r in profile.profile(rows, []).collect()}
    assert seen.value <= 200  # once for each post that is shown
    assert [p["pos"] for p in got["0"]["posts"]] == list(range(0, 200, 2))
    assert [tuple(x) for x in got["0"]["summary"]["languages"]] == [("en", 66), ("fr", 34)]
    assert [tuple(x) for x in got["1"]["summary"]["languages"]] == [("en", 67), ("fr", 33)]
    assert got["1"]["summary"]["total"] == 100 and got["1"]["summary"]["toxic"] == 0
