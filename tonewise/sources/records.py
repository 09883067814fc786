"""Large CSV files read by many tasks, although quoted fields hold line feeds.

A file is read as lines, block by block, by Spark's own text reader. Each task
counts the quotes of its block; the prefix sum over a file's blocks tells whether
a block starts inside a quoted field (an odd number of quotes before it). Knowing
that, each task cuts its block into records by the parity of quotes so far. What a
block begins in the middle of, and what it ends in the middle of, are put together
by file. Records are parsed by Spark's CSV parser.

So it reads what CSV writers write: a field with a quote in it is quoted. A file
for which the parity doesn't give such records (say, a bare quote in an unquoted
field, or an open one) is told by a look at its records, and read by one task with
Spark's multi-line reader instead.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewise.sources.tables import stored

#: One record of fields that are quoted where they hold a quote, a comma or a line feed.
REGULAR = re.compile(r'(?:"(?:[^"]|"")*+"|[^",\r\n]*+)(?:,(?:"(?:[^"]|"")*+"|[^",\r\n]*+))*+')
#: Blocks of which a list may go to every task: a row a block of (as a rule) 128 MB. Beyond, a file is a task.
BROADCAST_BLOCKS = 100_000


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line): the lines of each block in order; a block is where its first byte stands."""
    meta = F.col("_metadata")
    return spark.read.text(path, lineSep="\n").select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.col("value").alias("line"))


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, odd) of what a task has read."""
    odd: dict[tuple, int] = {}
    for b in batches:
        n = pc.count_substring(b.column("line"), '"').to_numpy(zero_copy_only=False)
        for key, k in zip(zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True), n.tolist(), strict=True):
            odd[key] = odd.get(key, 0) ^ (k & 1)
    keys = list(odd)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(odd.values()), pa.int32())], names=["file", "block", "odd"]
    )


PIECES = "file string, block long, nth long, begins boolean, ends boolean, record string"


class _Cutter:
    """The records of a task's blocks. A piece that doesn't begin or end a record is put together later."""

    def __init__(self):
        self.at: tuple | None = None
        self.open: list[str] = []
        self.out: list[tuple] = []

    def begin(self, key: tuple, inside: bool) -> None:
        self.end()
        self.at, self.inside, self.begins, self.nth = key, inside, not inside, 0

    def add(self, line: str, odd: bool) -> None:
        self.open.append(line)
        self.inside ^= odd
        if not self.inside:
            self.put(True)

    def put(self, ends: bool) -> None:
        self.out.append((*self.at, self.nth, self.begins, ends, "\n".join(self.open)))
        self.open, self.begins, self.nth = [], True, self.nth + 1

    def end(self) -> None:
        if self.at is not None and self.open:
            self.put(False)
        self.open = []

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
        got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.out], k) for i, k in enumerate(kinds)], names=["file", "block", "nth", "begins", "ends", "record"])
        self.out = []
        return got


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = _Cutter()
    for b in batches:
        odd = pc.bit_wise_and(pc.count_substring(b.column("line"), '"'), 1).to_pylist()
        for file, block, inside, line, o in zip(*(b.column(c).to_pylist() for c in ("file", "block", "inside", "line")), odd, strict=True):
            if (file, block) != cutter.at:
                cutter.begin((file, block), bool(inside))
            cutter.add(line, bool(o))
        yield cutter.batch()
    cutter.end()
    yield cutter.batch()


def _whole(pieces: DataFrame) -> DataFrame:
    """(file, block, nth, record): pieces that lie over blocks are put together, in the order of the blocks."""
    done = pieces.where("begins AND ends").select("file", "block", "nth", "record")
    parts = pieces.where("NOT begins OR NOT ends")  # two a block at most
    order = Window.partitionBy("file").orderBy("block", "nth")
    parts = parts.withColumn("of", F.sum(F.col("begins").cast("long")).over(order))
    joined = parts.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("block", "nth", "record"))).alias("p"))
    first = F.col("p")[0]
    text = F.array_join(F.transform("p", lambda x: x["record"]), "\n")
    return done.unionByName(joined.select("file", first["block"].alias("block"), first["nth"].alias("nth"), text.alias("record")))


def records(spark: SparkSession, path: str | list[str]) -> DataFrame | None:
    """(file, block, nth, record): the records of CSV files, as text, each where it begins; None for more than ``BROADCAST_BLOCKS`` blocks."""
    lines = _lines(spark, path)
    odd = stored(lines.mapInArrow(_quotes, "file string, block long, odd int").groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd")), "csv-quotes")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    inside = stored(odd.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("inside")), "csv-blocks")
    if inside.count() > BROADCAST_BLOCKS:
        return None
    held = F.broadcast(inside.where("inside = 1"))
    told = lines.join(held, ["file", "block"], "left").select("file", "block", F.coalesce("inside", F.lit(0)).alias("inside"), "line")
    return _whole(told.mapInArrow(_cut, PIECES))


def irregular(found: DataFrame) -> DataFrame:
    """The files with a record that no CSV writer writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad: set[str] = set()
        for b in batches:
            for file, record in zip(b.column("file").to_pylist(), b.column("record").to_pylist(), strict=True):
                if file not in bad and not REGULAR.fullmatch(record.removesuffix("\r")):
                    bad.add(file)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(bad), pa.string())], names=["file"])

    return found.select("file", "record").mapInArrow(run, "file string").distinct()


def header(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The names in the first line of the first file."""
    first = spark.read.text(path, lineSep="\n").first()
    return next(csv.reader([first[0].removeprefix("﻿").removesuffix("\r")])) if first else []


def parsed(found: DataFrame, names: list[str]) -> DataFrame:
    """(file, block, nth, and a text column of each name) of the records that have as many fields; header rows and blank lines go.

    Where a file's first line ends in a carriage return and a line feed, they are a line feed within fields too, as Spark's reader has it.
    """
    top = (F.col("block") == 0) & (F.col("nth") == 0)
    both = [r["file"] for r in found.where(top & F.endswith("record", F.lit("\r"))).select("file").collect()]  # names of files
    kept = found.where(~top)
    text: Column = F.regexp_replace("record", "\r$", "")
    text = F.when(F.col("file").isin(both), F.regexp_replace(text, "\r\n", "\n")).otherwise(text) if both else text
    schema = ", ".join(f"`{n}` string" for n in names) + ", `_bad` string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "escape": '"', "multiLine": "true"}
    rows = kept.where(F.trim(text) != "").select("file", "block", "nth", F.from_csv(text, F.lit(schema), options).alias("r"))
    return rows.where(F.col("r._bad").isNull()).select("file", "block", "nth", *[F.col(f"r.`{n}`").alias(n) for n in names])
