"""Extension beyond the serving path: posts scored as a stream, and toxicity over windows of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise.functions.normalize import normalize_text
from tonewise.plans.models import Meta
from tonewise.plans.serving import verdicts


def score_stream(posts: DataFrame, prob: Column, meta: Meta, text: str = "text") -> DataFrame:
    """Stateless: each post with its normalised text and verdict. ``prob`` may refer to ``normalized``."""
    rows = posts.withColumn("normalized", normalize_text(F.col(text)))
    return verdicts(rows, prob, F.col(text), meta)


def toxic_windows(scored: DataFrame, ts: str = "ts", size: str = "10 minutes", late: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """(start, language, posts, toxic) per window of event time; posts later than ``late`` are left out."""
    rows = scored.withWatermark(ts, late).groupBy(F.window(ts, size, slide), "language")
    rows = rows.agg(F.count("*").alias("posts"), F.count_if("is_toxic").alias("toxic"))
    return rows.select(F.col("window.start").alias("start"), "language", "posts", "toxic")


def toxic_sessions(scored: DataFrame, author: str, ts: str = "ts", gap: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """(author, start, end, posts, toxic): runs of posts with no pause of ``gap``."""
    rows = scored.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), author)
    rows = rows.agg(F.count("*").alias("posts"), F.count_if("is_toxic").alias("toxic"))
    return rows.select(author, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "posts", "toxic")
