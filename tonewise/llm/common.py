"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of the batches that Python workers get.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine (a ``local`` master: tests) names none, a
    fresh temporary folder is set for the session, so that every later call
    agrees. On a cluster that would be another folder on each machine, so it is
    an error.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{key} must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tonewise-checkpoint-")
        spark.conf.set(key, found)
    return found


#: Whether Spark deletes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is written inside needs its shuffles no longer once it is written: their files go at once, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage: what follows reads files that outlive any
    executor. An operator discards the tables that its result doesn't read;
    those that it reads stay, as the result is lazy and may be read any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tonewise/{label}-{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``saved`` that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in small batches, as a batch of long texts stands in the memory of both processes.

    A worker serves one task after another; what a task has used goes back to
    the system when it ends.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = df.sparkSession.conf.get(key)
        if not 0 < int(now.rstrip("b")) <= most:
            df.sparkSession.conf.set(key, str(most))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(tidy, schema)


def fixed(docs: DataFrame) -> DataFrame:
    """``docs``, or a written copy, of which every reading gives the same rows in the same partitions.

    So ``monotonically_increasing_id`` names the same rows each time. That holds
    for columns and filters over files, whose split is pinned for the session;
    what else ``docs`` may be (a join, a shuffle, rows of the driver) is written.
    """
    spark, plan = docs.sparkSession, docs._jdf.queryExecution().analyzed()
    node, steady = plan, plan.deterministic()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    if steady and node.nodeName() == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation":
        key = "spark.sql.files.minPartitionNum"
        if not spark.conf.get(key, None):
            spark.conf.set(key, str(spark._jsparkSession.leafNodeDefaultParallelism()))
        return docs
    return saved(docs, "fixed")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


#: Links that one task of a component step may write.
TASK_LINKS = 500_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph of long ids, as a table made by ``saved``.

    Alternating large-star and small-star steps, each a grouped minimum and a
    join, so a vertex with very many links is pre-aggregated and its join side
    can be split. Returns (node, root) for every node that has a link, root
    being the smallest node of the component; the roots are included.
    Self-links, nulls and repeated links are ignored.
    """
    u, v = F.col("u"), F.col("v")
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(u > v)
        .distinct()
    )
    links = saved(links, "links")

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return tuple(row)

    seen = mark(links)
    while seen[0]:
        both = links.unionByName(links.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where(v > u)
            .select(v.alias("u"), F.least("m", "u").alias("v"))
            .where(u > v)
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where(v > F.col("m")).select(v.alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        step = saved(small.coalesce(1 + 2 * seen[0] // TASK_LINKS), "links")  # a step has 2 links at most for each before
        now = mark(step)
        discard(links)
        links = step
        if now == seen:
            break
        seen = now
    named = links.select(u.alias("node"), v.alias("root")).unionByName(links.select(v.alias("node"), v.alias("root")).distinct())
    named = saved(named.coalesce(1 + 2 * seen[0] // TASK_LINKS), "components")
    discard(links)
    return named
