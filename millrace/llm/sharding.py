"""An append-only store of Parquet shards with size-tiered compaction and versioned manifests."""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import remove

MANIFEST = "path string, bytes long, rows long"


class ShardStore:
    """Immutable shards below a root folder; a version is a manifest that lists them.

    Manifests are Parquet tables.  A version is committed by renaming a pointer file to its number, which fails if
    another writer took the number.  Readers see whole versions only.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4):
        self.spark, self.root, self.target_bytes, self.fanout = spark, root.rstrip("/"), target_bytes, fanout

    def _files(self):
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf)

    def versions(self) -> list[int]:
        jvm, fs, _ = self._files()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()) if fs.exists(folder) else []

    def manifest(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        at = json.loads(self.spark.read.text(f"{self.root}/versions/{version or known[-1]:012d}").first()[0])
        return self.spark.read.schema(MANIFEST).parquet(at["manifest"])

    def commit(self, manifest: DataFrame, after: int) -> int:
        """Makes version after + 1; raises if it exists."""
        jvm, fs, files = self._files()
        at = f"{self.root}/manifests/{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(at)
        path, rename = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options.Rename
        draft = path(f"{self.root}/versions/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"manifest": at}).encode()))
        out.close()
        kinds = self.spark.sparkContext._gateway.new_array(rename, 1)
        kinds[0] = rename.NONE
        files.rename(draft, path(f"{self.root}/versions/{after + 1:012d}"), kinds)
        return after + 1

    def _shards(self, folder: str, schema) -> DataFrame:
        """The files that a job wrote, with their bytes and rows."""
        written = self.spark.read.schema(schema).parquet(folder)
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        return written.groupBy(path.alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))

    def append(self, arrivals: DataFrame) -> int:
        """Adds the rows as shards of their own, one a task, and commits; after another writer's commit it follows that one."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        arrivals.write.parquet(folder)
        shards = self._shards(folder, arrivals.schema)
        while True:
            version = (self.versions() or [0])[-1]
            try:
                return self.commit(self.manifest(version).union(shards) if version else shards, version)
            except Py4JJavaError:
                if (self.versions() or [0])[-1] == version:
                    raise

    def tier(self) -> F.Column:
        """Shards whose sizes lie within a factor of fanout, counted down from target_bytes; -1 for full ones."""
        down = F.floor(F.log(F.lit(float(self.target_bytes)) / F.greatest("bytes", F.lit(1))) / math.log(self.fanout))
        return F.when(F.col("bytes") * 2 > self.target_bytes, -1).otherwise(F.greatest(down, F.lit(0))).cast("int")

    def compact(self, schema) -> int:
        """Merges each tier with fanout shards or more into shards of about target_bytes, and commits once.

        Shards of a tier are alike in size, so that dealing them evenly over tasks makes even files without a shuffle.
        """
        version = (self.versions() or [0])[-1]
        if not version:
            return 0
        old = self.manifest(version).withColumn("tier", self.tier())
        due = [r["tier"] for r in old.where("tier >= 0").groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).where(F.col("n") >= self.fanout).collect()]
        if not due:
            return version
        merged = old.where(~F.col("tier").isin(due)).drop("tier")
        for t in due:
            paths, size = [], 0
            for r in old.where(F.col("tier") == t).orderBy("path").toLocalIterator():
                paths.append(r["path"])
                size += r["bytes"]
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            self.spark.read.schema(schema).parquet(*paths).coalesce(max(1, -(-size // self.target_bytes))).write.parquet(folder)
            merged = merged.union(self._shards(folder, schema))
        return self.commit(merged, version)

    def snapshot(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        paths = [r["path"] for r in self.manifest(version).select("path").toLocalIterator()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1, retention_seconds: float = 86_400) -> None:
        """Drops all versions but the newest `keep`, then deletes shards that no version lists.

        Shards younger than retention_seconds stay: they may belong to an append that has not committed yet.
        """
        jvm, fs, _ = self._files()
        path = jvm.org.apache.hadoop.fs.Path
        known = self.versions()
        for version in known[: max(0, len(known) - keep)]:
            fs.delete(path(f"{self.root}/versions/{version:012d}"), False)
        held = {r["path"].rsplit("/", 2)[-2] for version in known[-keep:] for r in self.manifest(version).select("path").toLocalIterator()}
        for folder in fs.listStatus(path(f"{self.root}/data")) if fs.exists(path(f"{self.root}/data")) else ():
            aged = time.time() - folder.getModificationTime() / 1000 >= retention_seconds
            if aged and folder.getPath().getName() not in held:
                remove(self.spark, folder.getPath().toString())


def compacted(docs: DataFrame, root: str, arrivals: int = 4, id_col: str = "doc_id", target_bytes: int = 64 << 20) -> DataFrame:
    """The table as a store holds it after `arrivals` appends and a compaction.

    Every row with all its columns is kept as it is: nulls, empty and long texts, repeated rows.  A null id belongs to
    one of the arrivals like others.  An empty table gives no rows.
    """
    store = ShardStore(docs.sparkSession, root, target_bytes)
    for k in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64(id_col), F.lit(arrivals)) == k))
    store.compact(docs.schema)
    store.vacuum(retention_seconds=0)
    return store.snapshot(docs.schema)
