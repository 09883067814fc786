"""Where results go: model folders, CSV, JSON and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOLDOUT_ROWS = 40_000


def write_holdout(test: DataFrame, path: str, order: tuple[str, ...] = ("source_rank", "row_id")) -> None:
    """The first rows of the test part as CSV."""
    rows = test.orderBy(*order).limit(HOLDOUT_ROWS).select("text", "is_toxic", "lang")
    rows.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_corpus(df: DataFrame, path: str) -> None:
    df.select("text", "is_toxic", "lang").write.mode("overwrite").options(header=True, escape='"').csv(path)


def as_json(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns))


def error_json(status: Column, message: Column) -> Column:
    return as_json(message.alias("error"), status.alias("status"))
