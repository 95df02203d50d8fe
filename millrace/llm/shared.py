"""Stage tables in the shared folder, settings that hold for one job, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files go once the table they fed is written; Python gets texts in batches that fit beside the heap.
JOB_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or on one machine a new one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get()
    return root.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Runtime settings for the jobs inside the block; the old values return afterwards."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Stages:
    """Tables that an operator writes between its steps, in the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks of one step.  On leaving the block all
    tables go except those passed to keep().
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/millrace-{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*(table for table, _ in self.paths.values()))

    def _write(self, df: DataFrame, name: str, more: dict[str, str] | None = None) -> tuple[DataFrame, str]:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with settings(self.spark, JOB_SETTINGS | (more or {})):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def write(self, df: DataFrame, name: str, more: dict[str, str] | None = None) -> DataFrame:
        """more: settings of this job beside JOB_SETTINGS."""
        table, path = self._write(df, name, more)
        self.paths[id(table)] = table, path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes written tables that no later step reads."""
        for table in tables:
            remove(self.spark, self.paths.pop(id(table))[1])

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        return self._write(df, name)[0]


def give_back() -> None:
    """Returns what a task has freed to the system: Python workers live on beside the heap that later stages fill."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run):
    """A task's function, after whose last batch give_back() is called."""

    @functools.wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return held


def text_bytes(column: str = "text") -> F.Column:
    """The text as UTF-8 bytes, which Python workers read without decoding."""
    return F.col(column).cast("string").cast("binary")


def by_row(stages: Stages, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) in which an id has one text, and (id, own), the ids as they were; None where no id is repeated.

    Else texts are numbered in the order of their ids, those of one id in the table's order, by a sort over ranges of both, so that a hot id fills no
    task.  Rows that repeat id and text share a number.  Null ids stay null.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    if texts.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return texts, None
    digest = F.sha2(F.coalesce("text", F.lit(b"")), 256)
    placed = texts.select(F.col("id").alias("own"), "text", digest.alias("digest"), F.monotonically_increasing_id().alias("place"))
    ordered = placed.repartitionByRange("own", "place").sortWithinPartitions("own", "place")
    # partition and place within it: ascending over the ranges
    ordered = stages.write(ordered.select("own", "text", "digest", F.monotonically_increasing_id().alias("number")), "ordered")
    first = ordered.where("own IS NOT NULL").groupBy("own", "digest").agg(F.min("number").alias("id"))
    numbered = stages.write(ordered.join(stages.write(first, "numbers"), ["own", "digest"], "left").select("id", "own", "text"), "numbered")
    return numbered.select("id", "text"), numbered.select("id", "own").where("id IS NOT NULL").distinct()


def own_ids(found: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """Columns of row numbers as the ids that by_row() took them for."""
    if names is not None:
        for c in columns:
            order = found.columns
            found = found.join(names.select(F.col("id").alias(c), F.col("own").alias("own_id")), c, "left").withColumn(c, F.col("own_id")).select(*order)
    return found


def components(stages: Stages, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, component), component the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. until the edges stand still.  A row stands for
    an edge, minima are aggregated before the shuffle, and each minimum table is written first so that
    the join on a hub's key can be split by adaptive execution.  Loops and null ends are left out.
    """
    edges = stages.write(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    before = None
    while True:
        seen = edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == before or not seen[0]:
            break
        before = tuple(seen)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stages.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stages.write(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(),
            "large",
        )
        stages.drop(least)
        least = stages.write(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        old = (edges, large, least)
        edges = stages.write(small.union(least).distinct(), "edges")
        stages.drop(*old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
