"""The registered queries: each runs an operator over whole tables.

Queries that need probabilities without a model take a stand-in that SQL can
compute too (``stand_in``); it is no model. Timeline queries run on authored rows,
as no table holds such pages.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.functions import format as fmt
from tonewise.functions.language import detect_language
from tonewise.functions.normalize import normalize_text
from tonewise.operators import features, metrics, prepare, profile
from tonewise.operators.detector import Detector, whole_scores
from tonewise.plans.cases import CONFLICTS, TEXTS
from tonewise.plans.evaluation import run_holdout
from tonewise.plans.models import BatchScorer, Ensemble, Meta, TermWeights, soft_vote
from tonewise.plans.serving import Classifier, verdicts
from tonewise.sources import corpora, requests, timeline

META = Meta(thresholds={"fr": 40.0, "de": 62.5}, global_threshold=45.0)
NOW = "2025-06-15 12:00:00"
CACHE_NOW = "2024-01-30 23:58:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stand_in(doc_id: Column, toxic: Column) -> Column:
    return ((doc_id * 7919) % 1000).cast("double") / 2000.0 + 0.4 * toxic.cast("double")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, is_toxic, lang)"""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("row_id"), "text", F.col("toxic").alias("is_toxic"), "lang")


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).withColumn("prob", stand_in(F.col("row_id"), F.col("is_toxic")))


def posts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts of their source."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id", "left")
    return rows.select(F.col("source").alias("author"), F.col("doc_id").alias("pos"), "text", stand_in(F.col("doc_id"), F.coalesce("toxic", F.lit(0))).alias("prob"))


def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(posts_of(spark, sf_dir), F.col("prob"), F.col("text"), META)


def normalize_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", normalize_text(F.col("text")).alias("normalized"))


def detect_language_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", detect_language(F.col("text")).alias("language"))


def language_confusion(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("lang", detect_language(F.col("text")).alias("language"))
    return rows.groupBy("lang", "language").agg(F.count("*").alias("n"))


def language_toxicity(spark, sf_dir):
    """By detected language: documents, mean length of the normalised text, share of toxic labels."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id", "left")
    rows = rows.select(detect_language(F.col("text")).alias("language"), F.length(normalize_text(F.col("text"))).alias("size"), "toxic")
    return rows.groupBy("language").agg(F.count("*").alias("docs"), F.round(F.avg("size"), 6).alias("mean_length"), F.round(F.avg("toxic"), 6).alias("toxic_share"))


def _corpus(spark, sf_dir, cap=None):
    return prepare.build_corpus([labelled(spark, sf_dir)], cap)


def corpus_prepare(spark, sf_dir):
    return _corpus(spark, sf_dir).select("row_id", "normalized", "is_toxic", "lang")


def label_conflicts(spark, sf_dir):
    """Rows whose whole normalised text has both labels, authored ones among them, as the tables hold none."""
    made = spark.createDataFrame([(-1 - i, *row) for i, row in enumerate(CONFLICTS)], "row_id long, text string, is_toxic int")
    rows = conflicting(labelled(spark, sf_dir).select("row_id", "text", "is_toxic").unionByName(made))
    return rows.select("row_id", "key", "is_toxic")


def conflicting(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("key", normalize_text(F.col("text")))
    sure = prepare.drop_label_conflicts(rows, "key")
    return rows.join(sure.select("row_id"), "row_id", "left_anti")


def _cases(spark, sf_dir):
    """Authored texts, as the tables hold no such characters, and the documents."""
    made = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)], "case_id long, text string")
    return made.unionByName(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "text"))


def normalize_cases(spark, sf_dir):
    return _cases(spark, sf_dir).select("case_id", normalize_text(F.col("text")).alias("normalized"))


def language_cases(spark, sf_dir):
    return _cases(spark, sf_dir).select("case_id", detect_language(F.col("text")).alias("language"))


def analyze_answers(spark, sf_dir):
    """Request bodies made of conversation turns, of all kinds, answered with a stand-in scorer: status, results and error."""
    turn, text = F.col("turn"), F.col("text")
    body = (
        F.when(turn % 5 == 0, F.to_json(F.struct("text")))
        .when(turn % 5 == 1, F.to_json(F.struct(F.array(text, F.lit("  ")).alias("texts"))))
        .when(turn % 5 == 2, F.to_json(F.struct(text.alias("texts"))))
        .when(turn % 5 == 3, F.lit('{"text": " \\n\\t"}'))
        .otherwise(F.lit('{"texts": null, "text": null}'))
    )
    rows = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + turn).alias("request"), body.alias("body"))
    scorer = BatchScorer(lambda: lambda texts: [0.25] * len(texts))
    got = F.from_json("body", "backend string, results array<struct<text:string,score:double>>, error string")
    out = Classifier(scorer).answers(rows, "request").withColumn("r", got)
    return out.select("request", "status", F.coalesce(F.size("r.results"), F.lit(0)).alias("n"), F.col("r.results")[0]["score"].alias("score"), F.col("r.results")[0]["text"].alias("text"), F.col("r.error").alias("error"))


def dedup_keep_first(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.lit(0).alias("source_rank"), "text", "lang")
    return prepare.keep_first(rows, "text").select("row_id", "lang")


def quota_per_lang_label(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("source_rank", F.lit(0))
    return prepare.quota(rows, 20).select("row_id", "lang", "is_toxic")


def corpus_stats(spark, sf_dir):
    return prepare.corpus_stats(labelled(spark, sf_dir))


def stratum_counts(spark, sf_dir):
    return prepare.with_stratum(labelled(spark, sf_dir), 5).groupBy("stratum").agg(F.count("*").alias("n"))


def stratified_split_counts(spark, sf_dir):
    return prepare.split(labelled(spark, sf_dir)).groupBy("stratum", "part").agg(F.count("*").alias("n"))


def language_list(spark, sf_dir):
    return prepare.language_list(_table(spark, sf_dir, "documents")).select(F.concat_ws(",", "languages").alias("languages"))


def canonical_languages(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(prepare.canonical_language(F.concat(F.upper("lang"), F.lit("-XX"))).alias("lang"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"))


def _normalized(spark, sf_dir):
    return labelled(spark, sf_dir).select(F.col("row_id").alias("doc_id"), normalize_text(F.col("text")).alias("t"))


def word_ngram_df(spark, sf_dir):
    docs = _normalized(spark, sf_dir)
    return features.within(features.document_frequency(docs, features.word_terms(F.col("t"))), docs.count(), 2)


def char_ngram_df(spark, sf_dir):
    docs = _normalized(spark, sf_dir)
    return features.within(features.document_frequency(docs, features.char_terms(F.col("t"))), docs.count(), 3)


def tfidf_topk(spark, sf_dir):
    """The ten heaviest word terms of each document."""
    from pyspark.sql import Window

    docs = _normalized(spark, sf_dir)
    counts, n = features.term_counts(docs, features.word_terms(F.col("t"))), docs.count()
    rows = features.tfidf(counts, features.vocabulary(counts, n, None, 2), n).withColumn("weight", F.round("weight", 6))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))
    return rows.withColumn("nth", nth).where("nth <= 10").select("doc_id", "term", "weight", "nth")


def threshold_sweep(spark, sf_dir):
    rows = metrics.sweep(scored_rows(spark, sf_dir), ("lang",))
    return rows.select("lang", "cut", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


def tuned_thresholds(spark, sf_dir):
    return metrics.tune_thresholds(scored_rows(spark, sf_dir), 50).select("lang", "cut", F.round("f1", 6).alias("f1"))


def eval_report(spark, sf_dir):
    rows = scored_rows(spark, sf_dir)
    out = metrics.evaluate(rows, metrics.tune_thresholds(rows, 50), 20)
    return out.select("lang", "n", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "toxic_f1", "macro_f1")])


def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored_rows(spark, sf_dir)).select(F.round("roc_auc", 6).alias("roc_auc"))


def class_report(spark, sf_dir):
    rows = scored_rows(spark, sf_dir).withColumn("predicted", (F.col("prob") >= 0.35).cast("int"))
    out = metrics.class_report(rows)
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def soft_vote_probs(spark, sf_dir):
    p = F.col("prob")
    return scored_rows(spark, sf_dir).select("row_id", F.round(soft_vote(p, p * p, 1 - p), 6).alias("prob"))


def verdict_documents(spark, sf_dir):
    return scored_posts(spark, sf_dir).select("pos", "score", "language", "threshold", "is_toxic")


def profile_summary(spark, sf_dir):
    return profile.summary(scored_posts(spark, sf_dir))


def profile_languages(spark, sf_dir):
    mix = profile.language_mix(scored_posts(spark, sf_dir))
    listed = F.array_join(F.transform("languages", lambda x: F.concat_ws(":", x["language"], x["n"].cast("string"))), ",")
    return mix.select("author", listed.alias("languages"))


def language_shares(spark, sf_dir):
    out = profile.language_shares(scored_posts(spark, sf_dir))
    return out.select("author", "language", "n", F.round("share", 6).alias("share"), F.round("width", 6).alias("width"))


def timeline_tabs(spark, sf_dir):
    return profile.tab_counts(scored_posts(spark, sf_dir)).withColumnRenamed("all", "total")


def profile_json(spark, sf_dir):
    shown = profile.first_posts(posts_of(spark, sf_dir))
    rows = verdicts(shown, F.col("prob"), F.col("text"), META).withColumn("full_text", F.col("text"))
    return profile.profile_json(profile.profile(rows, ["full_text"]))


def _snapshots(spark, sf_dir):
    """Events as snapshots of their users' timelines; the value is the number of posts."""
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("user"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", F.floor("value").cast("int").alias("n_posts")
    )


def snapshot_cache_latest(spark, sf_dir):
    return timeline.latest_snapshots(_snapshots(spark, sf_dir), "user", "ts", ("event_id",)).select("user", "event_id")


def snapshot_cache_answers(spark, sf_dir):
    """What the cache may answer a request for 20 posts with, stale snapshots included."""
    now = F.lit(CACHE_NOW).cast("timestamp_ntz")
    return timeline.cached(_snapshots(spark, sf_dir), "user", "ts", "n_posts", 20, now, True, ("event_id",)).select("user", "event_id", "fresh")


def snapshot_cache_kept(spark, sf_dir):
    return timeline.evicted(_snapshots(spark, sf_dir), "user", "ts", ties=("event_id",)).select("user", "event_id")


def conversation_lines(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.size(requests.lines_of(F.col("text"))).alias("n_lines"), F.concat_ws("\n", requests.lines_of(F.col("text"))).alias("lines"))


def compact_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", fmt.compact_number(F.col("n_chars") * F.col("n_chars") * 37).alias("label"))


def relative_times(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp_ntz")
    return _table(spark, sf_dir, "events").select("event_id", fmt.relative_time(F.col("ts").cast("timestamp_ntz"), now).alias("label"))


def handles(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", fmt.normalize_handle(F.concat(F.lit(" @@"), F.col("text"))).alias("handle"))


def permalinks(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages")
    link = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?:/", "")).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("")
    return rows.select("page_id", fmt.permalink(F.regexp_replace(link, "^/+", "/"), F.lit("someone"), F.col("page_id").cast("string")).alias("link"))


def language_names(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", fmt.language_name(detect_language(F.col("text"))).alias("name"))


def coerced_labels(spark, sf_dir):
    """Labels written in several ways, read as numbers: fractions are cut off, what is none goes."""
    kind, toxic = F.col("row_id") % 6, F.col("is_toxic")
    raw = F.when(kind == 0, F.concat(toxic.cast("string"), F.lit(".9"))).when(kind == 1, F.concat(F.lit(" "), toxic.cast("string"))).when(kind == 2, "x").when(kind == 3, "NaN").when(kind == 4, toxic.cast("string"))
    rows = labelled(spark, sf_dir).select("row_id", prepare.coerced_label(raw).alias("is_toxic"))
    return rows.dropna(subset=["is_toxic"])


def adapted_sources(spark, sf_dir):
    """Three corpora with labels of their own kinds put together by name: rows, characters and the last row of each source, language and label."""
    rows = labelled(spark, sf_dir)
    written = F.when(F.col("row_id") % 5 == 0, "2").when(F.col("row_id") % 5 == 1, F.concat(F.lit(" "), F.col("is_toxic").cast("string"), F.lit(" "))).otherwise(F.col("is_toxic").cast("string"))
    plain = rows.select("text", "is_toxic", prepare.canonical_language(F.upper("lang")).alias("lang"), "row_id")
    texts = corpora.from_text_labels(rows.withColumn("label", written), "text", "label", "zh")
    flags = corpora.from_clean_flags(rows.withColumn("clean", 1 - F.col("is_toxic")), "text", "clean", "ko")
    both = prepare.union_sources([plain, *corpora.optional(lambda: texts, lambda: spark.read.parquet(f"{sf_dir}/no-such-table.parquet"), lambda: flags)])
    return both.groupBy("source_rank", "lang", "is_toxic").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


def requested_counts(spark, sf_dir):
    """How many posts a request gets for what it asks: 1 to 100, 20 for what is no number."""
    n = F.col("event_id") * 37 % 400 - 100
    asked = F.when(F.col("event_id") % 7 == 0, F.concat(n.cast("string"), F.lit("x"))).when(F.col("event_id") % 7 == 1, "").otherwise(n.cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", requests.clamp_count(asked).cast("long").alias("n"))


def formatted_events(spark, sf_dir):
    """Times in full, shares as percentages (a dash for none), values within 0 to 100."""
    value = F.when(F.col("event_id") % 9 != 0, F.col("value"))
    rows = _table(spark, sf_dir, "events").where(F.col("value").isNotNull())
    share = (F.floor(value * 10) * 10 + 3) / 100000.0  # never half a digit
    return rows.select("event_id", fmt.absolute_time(F.col("ts").cast("timestamp_ntz")).alias("time"), fmt.percent(share).alias("share"), F.round(fmt.clamp_percent(F.col("value") - 10), 6).alias("width"))


def avatars(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit("_normal/x_normal.png")))
    return rows.select("page_id", fmt.large_avatar(url).alias("url"))


def rich_texts(spark, sf_dir):
    """Turns with links, names and tags among their words, as labelled pieces."""
    rows = _table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    link = F.concat(F.lit(" https://example.org/"), F.repeat(F.lit("p"), (F.col("turn") * 7).cast("int")), F.lit(" "))
    text = F.concat(F.lit("@user_"), F.col("conv_id").cast("string"), link, "text", F.lit("\n#tag"), F.col("turn").cast("string"), F.lit(" #no-tag http:// @"))
    pieces = F.transform(fmt.rich_text(text), lambda p: F.concat_ws("=", p["kind"], p["label"]))
    return rows.select("conv_id", "turn", F.array_join(pieces, "|").alias("pieces"))


def payload_scores(spark, sf_dir):
    """A plugged-in scorer gets the normalised text, or the raw one if nothing is left: here it tells the length."""
    scorer = BatchScorer(lambda: lambda texts: [min(len(t), 1_000) / 1_000 for t in texts])
    rows = _cases(spark, sf_dir).withColumn("normalized", normalize_text(F.col("text")))
    return scorer.predict(rows).select("case_id", "prob")


PAGE = {
    "props": {"pageProps": {"headerProps": {"x": 1}, "timeline": {"entries": [
        {"type": "tweet", "content": {"tweet": {
            "full_text": "Fish & chips", "id_str": "11", "created_at": "Wed Oct 10 20:19:24 +0200 2018", "favorite_count": 3,
            "permalink": "/ann/status/11", "user": {"name": "Ann", "screen_name": "ann", "followers_count": 7},
            "entities": {"media": [{"media_url": "http://img/1"}, {"type": "video", "media_url_https": ""}]}}}},
        {"type": "cursor"},
        {"type": "tweet", "content": {"tweet": {"text": "second", "id_str": "12", "created_at": "10 Oct 2018 20:19:24 GMT"}}},
    ]}}}
}
EMPTY = {"props": {"pageProps": {"headerProps": {"x": 1}, "timeline": {"entries": []}}}}
MISSING = {"props": {"pageProps": {"timeline": {"entries": []}}}}


def timeline_extract(spark, sf_dir):
    """Authored pages, and the ``pages`` table, which holds no timeline."""
    island = lambda d: f'<html><script id="__NEXT_DATA__" type="application/json">{html.escape(json.dumps(d), quote=False)}</script></html>'
    made = spark.createDataFrame([("ann", island(PAGE)), ("bob", island(EMPTY)), ("eve", island(MISSING))], "username string, html string")
    rows = made.unionByName(_table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("username"), "html"))
    out = timeline.parse_pages(rows, now=F.lit(NOW).cast("timestamp_ntz"))
    links = F.array_join(F.transform("posts", lambda p: F.concat_ws("|", p["full_text"], p["tweet_url"], fmt.iso_time(p["created_at"]))), ";")
    return out.select("username", "status", F.col("user.name").alias("name"), F.size("posts").cast("long").alias("n_posts"), links.alias("posts"))


def _term_weights(spark, sf_dir):
    """A classifier by term weights that are learned from the labelled documents, a row a term."""
    rows = labelled(spark, sf_dir).select("is_toxic", normalize_text(F.col("text")).alias("normalized"))
    return Classifier(TermWeights.fit(rows), META)


def scored_documents(spark, sf_dir):
    """All documents by the serving path: normalised, scored, language told, cut by language, judged."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _term_weights(spark, sf_dir).analyze(docs).select("doc_id", "score", "is_toxic", "language", "threshold")


def holdout_report(spark, sf_dir):
    """The labelled documents evaluated through the serving path: counts and scores of the whole and of each language."""
    out = run_holdout(_term_weights(spark, sf_dir), labelled(spark, sf_dir).select("text", "is_toxic", "lang"))
    return out.select("lang", "n", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "toxic_f1", "macro_f1")])


def _detector(spark, sf_dir):
    return Detector.fit(labelled(spark, sf_dir), size=1_000)


def language_scores(spark, sf_dir):
    """For each document and language the score of whole trigram profiles that are learned from the labelled documents."""
    return whole_scores(_table(spark, sf_dir, "documents"), labelled(spark, sf_dir)).select("doc_id", "lang", F.round("score", 6).alias("score"))


def detected_languages(spark, sf_dir):
    """The language by script, letters and the statistical detector."""
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", detect_language(text, _detector(spark, sf_dir).column(text)).alias("language"))


def timeline_documents(spark, sf_dir):
    """Documents as posts in pages of five, written as saved pages are and parsed again."""
    docs = _table(spark, sf_dir, "documents")
    id_str = F.col("doc_id").cast("string")
    tweet = F.struct(F.col("text").alias("full_text"), id_str.alias("id_str"), F.col("n_chars").alias("favorite_count"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/p/"), id_str)).alias("permalink"))
    kind = F.when(F.col("doc_id") % 7 == 3, "cursor").otherwise("tweet")
    entry = F.struct("doc_id", F.struct(kind.alias("type"), F.struct(tweet.alias("tweet")).alias("content")).alias("entry"))
    pages = docs.groupBy(F.floor(F.col("doc_id") / 5).alias("page")).agg(F.array_sort(F.collect_list(entry)).alias("e"))  # five ids a page
    timeline_ = F.struct(F.transform("e", lambda x: x["entry"]).alias("entries")).alias("timeline")
    body = F.to_json(F.struct(F.struct(F.struct(F.lit("{}").alias("headerProps"), timeline_).alias("pageProps")).alias("props")))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        body = F.replace(body, F.lit(sign), F.lit(name))
    page = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), body, F.lit("</script></html>"))
    rows = pages.select(F.concat(F.lit("page"), F.col("page").cast("string")).alias("username"), page.alias("html"))
    out = timeline.posts(timeline.parse_pages(rows, now=F.lit(NOW).cast("timestamp_ntz")))
    return out.select("username", F.col("pos").cast("long").alias("pos"), "full_text", "id_str", "favorite_count", "tweet_url", F.col("user.name").alias("name"))


def score_documents(spark, sf_dir):
    """Train on the labelled documents, score all documents by the serving path."""
    model = Ensemble.fit(prepare.build_corpus([labelled(spark, sf_dir)]), features.Vectorizer())
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return Classifier(model, META).analyze(docs).select("doc_id", "score", "is_toxic", "language", "threshold")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        language_toxicity, normalize_documents, detect_language_documents, language_confusion, corpus_prepare, label_conflicts, dedup_keep_first,
        quota_per_lang_label, corpus_stats, stratum_counts, stratified_split_counts, language_list, canonical_languages, word_ngram_df,
        char_ngram_df, tfidf_topk, threshold_sweep, tuned_thresholds, eval_report, roc_auc, class_report, soft_vote_probs, verdict_documents,
        profile_summary, profile_languages, language_shares, timeline_tabs, profile_json, snapshot_cache_latest, snapshot_cache_answers, snapshot_cache_kept, normalize_cases, language_cases, analyze_answers, conversation_lines,
        compact_counts, relative_times, handles, permalinks, language_names, timeline_extract, score_documents, scored_documents, holdout_report, language_scores, detected_languages,
        coerced_labels, adapted_sources, requested_counts, formatted_events, avatars, rich_texts, payload_scores, timeline_documents,
    )
    return {f.__name__: f for f in found}
