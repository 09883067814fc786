"""Thresholds and evaluation.

Input rows have is_toxic (0 or 1), lang and prob (0 to 1). A cut is a
percentage; a row is flagged where its probability reaches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewise.sources.tables import stored

GRID = (5, 95)  # percent, both included
MIN_SUPPORT = 300
GAIN = 0.002


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where nothing is there to find or found."""
    d = 2 * tp + fp + fn
    return F.when(d > 0, 2 * tp / d).otherwise(F.lit(0.0))


def steps(prob: Column) -> Column:
    """The highest cut of the grid's whole percents that the probability reaches."""
    return F.floor(F.round(prob * 100, 9)).cast("int")


def sweep(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., cut, tp, fp, fn, f1) for each cut of the grid.

    Rows are counted by percent first, then summed from the top: the grid is
    crossed with a histogram of at most 101 rows a group, never with the rows.
    """
    return swept(histogram(rows, by), by)


def histogram(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., p, pos, neg): rows by whole percents, at most 92 a group."""
    p = F.greatest(F.least(steps(F.col("prob")), F.lit(GRID[1])), F.lit(GRID[0] - 1)).alias("p")
    return rows.groupBy(*by, p).agg(F.sum("is_toxic").alias("pos"), F.sum(1 - F.col("is_toxic")).alias("neg"))


def swept(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The sweep of a histogram, which may have further groups."""
    keys = list(by)
    cuts = F.explode(F.sequence(F.lit(GRID[0]), F.lit(GRID[1]))).alias("cut")
    sums = hist.select(*keys, "p", "pos", "neg", cuts).groupBy(*keys, "cut").agg(
        F.sum(F.when(F.col("p") >= F.col("cut"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("p") >= F.col("cut"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("p") < F.col("cut"), F.col("pos")).otherwise(0)).alias("fn"),
    )
    return sums.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def best_cut(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., cut, f1): the first of the best cuts."""
    top = F.max_by(F.struct("cut", "f1"), F.struct("f1", -F.col("cut"))).alias("best")
    return found.groupBy(*by).agg(top).select(*by, F.col("best.cut").cast("double").alias("cut"), F.col("best.f1").alias("f1"))


def tune_thresholds(rows: DataFrame, min_support: int = MIN_SUPPORT, gain: float = GAIN) -> DataFrame:
    """(lang, cut, f1): the global cut (lang null) and those of languages that gain by one of their own.

    The rows are read once, for a histogram by language; all else is made of it.
    """
    hist = stored(histogram(rows, ("lang",)), "histogram")
    whole = best_cut(swept(hist))
    each = swept(hist, ("lang",))
    pos, neg = F.sum("pos"), F.sum("neg")
    enough = hist.groupBy("lang").agg(((pos + neg >= min_support) & (pos > 0) & (neg > 0)).alias("enough")).where("enough").select("lang")
    base = each.join(F.broadcast(whole.select(F.col("cut").alias("global_cut"))), F.col("cut") == F.col("global_cut"))
    own = best_cut(each, ("lang",)).join(base.select("lang", F.col("f1").alias("base")), "lang").join(enough, "lang")
    own = own.where(F.col("f1") > F.col("base") + gain).select("lang", "cut", "f1")
    return whole.select(F.lit(None).cast("string").alias("lang"), "cut", "f1").unionByName(own)


def with_cut(rows: DataFrame, cuts: DataFrame, lang: str = "lang") -> DataFrame:
    """``cut``: the language's own, else the global one. ``cuts`` has a row a language."""
    known = cuts.where(F.col("lang").isNotNull()).select(F.col("lang").alias("__l"), F.col("cut").alias("__own"))
    whole = cuts.where(F.col("lang").isNull()).select(F.col("cut").alias("__all"))
    out = rows.join(F.broadcast(known), F.col(lang) == F.col("__l"), "left").join(F.broadcast(whole))
    return out.withColumn("cut", F.coalesce("__own", "__all")).drop("__l", "__own", "__all")


def confusion(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, tp, fp, fn, tn) of ``is_toxic`` and ``predicted``."""
    y, p = F.col("is_toxic"), F.col("predicted").cast("int")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(y * p), F.lit(0)).alias("tp"),
        F.coalesce(F.sum((1 - y) * p), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(y * (1 - p)), F.lit(0)).alias("fn"),
        F.coalesce(F.sum((1 - y) * (1 - p)), F.lit(0)).alias("tn"),
    )


def scores(counts: DataFrame) -> DataFrame:
    """accuracy, toxic_f1 and macro_f1 beside the counts; null without rows."""
    toxic, clean = f1(F.col("tp"), F.col("fp"), F.col("fn")), f1(F.col("tn"), F.col("fn"), F.col("fp"))
    some = F.col("n") > 0
    return (
        counts.withColumn("accuracy", F.when(some, (F.col("tp") + F.col("tn")) / F.col("n")))
        .withColumn("toxic_f1", F.when(some, toxic))
        .withColumn("macro_f1", F.when(some, (toxic + clean) / 2))
    )


def roc_auc(rows: DataFrame) -> DataFrame:
    """One row, ``roc_auc``: by average ranks; null unless both classes are there.

    Rows are counted by distinct probability first; only these counts are
    ranked. Many distinct values are ranked in two levels (ranges, then values).
    """
    counts = rows.groupBy("prob").agg(F.sum("is_toxic").alias("pos"), F.sum(1 - F.col("is_toxic")).alias("neg"))
    counts = counts.withColumn("r", F.floor(F.col("prob") * 10_000))
    ranges = counts.groupBy("r").agg(F.sum("neg").alias("rn"))
    ranges = ranges.select("r", (F.sum("rn").over(Window.orderBy("r")) - F.col("rn")).alias("below"))  # 10,001 rows at most
    inside = F.sum("neg").over(Window.partitionBy("r").orderBy("prob")) - F.col("neg")
    wins = counts.withColumn("inside", inside).join(F.broadcast(ranges), "r")
    return wins.agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("inside") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    ).select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("roc_auc"))


def class_report(rows: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of both classes with macro and weighted averages."""
    c = confusion(rows)
    one = lambda label, tp, fp, fn: F.struct(
        F.lit(label).alias("label"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("recall"),
        f1(tp, fp, fn).alias("f1"),
        (tp + fn).alias("support"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    two = c.select("n", one("clean", tn, fn, fp).alias("a"), one("toxic", tp, fp, fn).alias("b"))

    def mean(label: str, wa: Column, wb: Column) -> Column:
        parts = [((F.col(f"a.{k}") * wa + F.col(f"b.{k}") * wb) / (wa + wb)).alias(k) for k in ("precision", "recall", "f1")]
        return F.struct(F.lit(label).alias("label"), *parts, F.col("n").alias("support"))

    both = F.array(
        F.col("a"), F.col("b"), mean("macro avg", F.lit(1.0), F.lit(1.0)), mean("weighted avg", F.col("a.support"), F.col("b.support"))
    )
    return two.select(F.explode(both).alias("r")).select("r.*")


def evaluate(rows: DataFrame, cuts: DataFrame, min_support: int = MIN_SUPPORT // 3, lang: str = "lang") -> DataFrame:
    """Scores of all rows (lang null), then of each language with enough of them, most rows first, at the cuts of the data set's languages."""
    judged = with_cut(rows, cuts, lang).withColumn("predicted", (F.round(F.col("prob") * 100, 9) >= F.col("cut")).cast("int"))
    each = stored(confusion(judged, ("lang",)), "confusion")  # a row a language
    counts = ("n", "tp", "fp", "fn", "tn")
    whole = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]).select(F.lit(None).cast("string").alias("lang"), *counts)
    return by_size(scores(whole.unionByName(each.where(F.col("n") >= min_support))))


def by_size(report: DataFrame) -> DataFrame:
    """A report's whole (lang null) first, then the languages by their rows; a row a language."""
    return report.orderBy(F.col("lang").isNotNull(), F.desc("n"), "lang")
