"""Labelled corpora as DataFrames of text, is_toxic, lang and an explicit order (row_id)."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.operators.prepare import canonical_language, coerced_label
from tonewise.sources import records
from tonewise.sources.tables import stored

log = logging.getLogger(__name__)


def _numbered(df: DataFrame) -> DataFrame:
    """``row_id``: the order in which the files are read."""
    return df.withColumn("row_id", F.monotonically_increasing_id())


def from_splits(spark: SparkSession, paths: dict[str, str], format: str = "parquet") -> DataFrame:
    """One path per language; the split 'hin' is 'hi'. Columns text and toxic."""
    frames = [spark.read.format(format).load(p).select("text", F.col("toxic").try_cast("int").alias("is_toxic"), F.lit("hi" if k == "hin" else k).alias("lang")) for k, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return _numbered(out)


CSV = ("text", "is_toxic", "lang")
#: Positions that a file has at most, in numbers of the order of rows.
FILE_ROWS = 1 << 46


def _by_file(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, text, is_toxic, lang), a file being one task."""
    rows = (
        spark.read.schema("text string, is_toxic string, lang string")
        .options(header=True, mode="DROPMALFORMED", multiLine=True, escape='"', enforceSchema=False)
        .csv(path)
    )
    at = F.monotonically_increasing_id() % F.lit(1 << 33)
    return rows.select(F.col("_metadata")["file_path"].alias("file"), at.alias("at"), *CSV)


def _by_record(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same, records being found in parallel; files that need a reader of their own get it."""
    found, names = records.records(spark, path), records.header(spark, path)
    if found is None:
        return _by_file(spark, path)
    if missing := set(CSV) - set(names):
        raise ValueError(f"no column {', '.join(sorted(missing))} in {path}")
    found = stored(found, "csv-records")
    odd = [r["file"] for r in records.irregular(found).collect()]  # names of files
    rows = records.parsed(found.where(~F.col("file").isin(odd)) if odd else found, names)
    rows = rows.select("file", (F.col("block") + F.col("nth")).alias("at"), *CSV)  # a record has a byte at least, its line feed
    if odd:
        log.warning("read by one task each: %s", ", ".join(odd))
        rows = rows.unionByName(_by_file(spark, odd))
    return rows


def from_csv(spark: SparkSession, path: str | list[str], split: bool = True) -> DataFrame:
    """Large CSV files with text, is_toxic and lang; malformed lines and unusable rows go. ``row_id`` follows files by name, then places in them."""
    rows = (_by_record if split else _by_file)(spark, path)
    files = sorted(r["file"] for r in rows.select("file").distinct().collect())  # names of files
    rank = F.array_position(F.array(*map(F.lit, files)), F.col("file")) if files else F.lit(1)
    rows = rows.withColumn("row_id", (rank - 1) * F.lit(FILE_ROWS) + F.col("at"))
    rows = rows.select("text", coerced_label(F.col("is_toxic")).alias("is_toxic"), canonical_language(F.col("lang")).alias("lang"), "row_id")
    return rows.dropna(subset=["text", "is_toxic"])


def from_text_labels(df: DataFrame, text: str, label: str, lang: str) -> DataFrame:
    """Rows whose trimmed label is '0' or '1'."""
    y = F.trim(F.col(label))
    return _numbered(df.where(y.isin("0", "1")).select(F.col(text).alias("text"), y.cast("int").alias("is_toxic"), F.lit(lang).alias("lang")))


def from_clean_flags(df: DataFrame, text: str, clean: str, lang: str) -> DataFrame:
    """The label is the complement of a flag."""
    return _numbered(df.select(F.col(text).alias("text"), (1 - F.col(clean)).cast("int").alias("is_toxic"), F.lit(lang).alias("lang")))


def optional(*sources: Callable[[], DataFrame]) -> list[DataFrame]:
    """The sources that can be read; others are logged and left out."""
    found = []
    for source in sources:
        try:
            df = source()
            df.limit(1).count()  # schema and files are looked at now
            found.append(df)
        except Exception as e:
            log.warning("source left out: %s", str(e).splitlines()[0] if str(e) else type(e).__name__)
    return found


def holdout(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.schema("text string, is_toxic int, lang string").options(header=True, multiLine=True, escape='"').csv(path)
    rows = rows.dropna(subset=["text"])
    return rows.limit(limit) if limit else rows


def literal(spark: SparkSession, rows: list[tuple[str, int, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "text string, is_toxic int, lang string")
