"""Training: corpus, split, features, ensemble, thresholds, evaluation, files.

``python -m tonewise.plans.training CSV... --out DIR`` runs it over CSV corpora.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.operators import metrics, prepare
from tonewise.operators.features import Vectorizer
from tonewise.plans.models import Ensemble, Meta
from tonewise.sources import sinks
from tonewise.sources.tables import stored


@dataclass
class Options:
    preset: str = "full"
    cap: int | None = None
    word_features: int = 400_000
    char_features: int = 600_000
    test: float = 0.08
    val: float = 0.08
    min_support: int = metrics.MIN_SUPPORT
    epochs: int = 30
    fold: bool = True


def train(sources: list[DataFrame], options: Options | None = None, names: list[str] | None = None) -> tuple[Ensemble, Meta, DataFrame]:
    """(ensemble, meta, test part with prob). Sources have text, is_toxic, lang and row_id."""
    o = options or Options()
    corpus = prepare.build_corpus(sources, o.cap, fold=o.fold)
    corpus = corpus.withColumn("row_id", F.xxhash64("source_rank", "row_id"))
    corpus = stored(prepare.split(corpus, "row_id", o.test, o.val), "corpus")
    part = {k: corpus.where(F.col("part") == k) for k in ("train", "val", "test")}
    model = Ensemble.fit(part["train"], Vectorizer(o.word_features, o.char_features), epochs=o.epochs)
    cuts = stored(metrics.tune_thresholds(stored(model.predict(part["val"]), "validation"), o.min_support), "cuts")
    scored = stored(model.predict(part["test"]), "test")
    report = {r["lang"]: r for r in metrics.evaluate(scored, cuts, max(1, o.min_support // 3)).collect()}  # a row a language
    tuned = {r["lang"]: r["cut"] for r in cuts.collect()}
    whole = report.pop(None)
    sizes = {r["part"]: r["n"] for r in corpus.groupBy("part").agg(F.count("*").alias("n")).collect()}
    meta = Meta(
        datasets=names or [], preset=o.preset, languages=prepare.language_list(corpus).first()[0], n_samples=sum(sizes.values()),
        n_train=sizes.get("train", 0), n_test=sizes.get("test", 0), global_threshold=tuned.pop(None), thresholds=tuned,
        per_language={k: {"n": r["n"], "accuracy": r["accuracy"], "macro_f1": r["macro_f1"]} for k, r in report.items()},
        trained_at=datetime.now(UTC).isoformat(timespec="seconds"), accuracy=whole["accuracy"], macro_f1=whole["macro_f1"],
        toxic_f1=whole["toxic_f1"], roc_auc=metrics.roc_auc(scored).first()[0],
    )
    return model, meta, scored


def main(args: list[str] | None = None) -> int:
    from tonewise.sources import corpora

    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("csv", nargs="+")
    p.add_argument("--out", required=True)
    p.add_argument("--preset", choices=("fast", "full"), default="full", help="fast: the first corpus only")
    # The defaults of the options from here to --val-size.
    p.add_argument("--cap", type=int, default=60_000, help="rows per language and label; 0: all")
    p.add_argument("--word-features", type=int, default=400_000)
    p.add_argument("--char-features", type=int, default=600_000)
    p.add_argument("--test-size", type=float, default=0.08)
    p.add_argument("--val-size", type=float, default=0.08)
    p.add_argument("--zh", help="Chinese corpus: Parquet of input and output")
    p.add_argument("--ko", help="Korean corpus: Parquet of 문장 and clean")
    p.add_argument("--no-extras", action="store_true", help="leave the Chinese and Korean corpora out")
    p.add_argument("--skip-if-exists", action="store_true")
    p.add_argument("--dump-corpus", action="store_true")
    o = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if o.skip_if_exists and Meta.load(f"{o.out}/meta").trained_at:
        return 0
    paths = o.csv[:1] if o.preset == "fast" else o.csv
    sources = [corpora.from_csv(spark, path) for path in paths]
    extras = []
    if not o.no_extras and o.preset == "full":
        if o.zh:
            extras.append(lambda: corpora.from_text_labels(spark.read.parquet(o.zh), "input", "output", "zh"))
        if o.ko:
            extras.append(lambda: corpora.from_clean_flags(spark.read.parquet(o.ko), "문장", "clean", "ko"))
    sources += corpora.optional(*extras)
    options = Options(o.preset, o.cap, o.word_features, o.char_features, o.test_size, o.val_size)
    model, meta, scored = train(sources, options, paths)
    model.save(f"{o.out}/model")
    meta.save(f"{o.out}/meta")
    sinks.write_holdout(scored, f"{o.out}/holdout")
    if o.dump_corpus:
        sinks.write_corpus(prepare.build_corpus(sources, o.cap), f"{o.out}/corpus")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
