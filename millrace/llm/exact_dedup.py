"""Exact deduplication through an extendible-hash index kept in shared files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import Stages

#: A directory has about this many buckets at most, so that it can be broadcast; larger indexes have larger buckets.
MOST_BUCKETS = 1 << 17
#: Keys of more rows than HOT_ROWS, and than one in MOST_HOT of all rows (so there are fewer than MOST_HOT), are aggregated before the shuffle.
HOT_ROWS = 256
MOST_HOT = 100_000


def normalised(column: str = "text") -> F.Column:
    """The text with each run of blanks, tabs and line ends as one space; null counts as empty.

    A lone space is its own replacement, so the pattern skips it.
    """
    return F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def slot_of(key: F.Column, depth: int) -> F.Column:
    return F.shiftrightunsigned(key, 64 - depth)


def grow_directory(stages: Stages, keys: DataFrame, n_keys: int, bucket_entries: int) -> tuple[DataFrame, int]:
    """The directory (slot, bucket, local_depth) and its global depth.

    keys has one row per distinct 64-bit `key`.  At depth d a bucket holds the keys with equal top d bits, a range of keys.
    The directory starts at the depth at which buckets are full on average.  As long as a bucket holds more than
    bucket_entries keys the directory doubles: the overfull buckets split by their next bit, the others keep their
    local depth and get both new slots.  Keys are distinct, so splitting ends.
    """
    depth = max(1, math.floor(math.log2(max(2.0, n_keys / bucket_entries))))
    counted = stages.write(keys.groupBy(slot_of(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n")), "buckets")
    settled = counted.where(F.col("n") <= bucket_entries).select("slot", F.lit(depth).alias("local_depth"))
    while True:
        overfull = counted.where(F.col("n") > bucket_entries).select("slot")
        if depth == 64 or overfull.isEmpty():
            break
        held = keys.select("key", slot_of(F.col("key"), depth).alias("slot")).join(F.broadcast(overfull), "slot", "left_semi")
        depth += 1
        counted = stages.write(held.groupBy(slot_of(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n")), "split-buckets")
        settled = settled.union(counted.where(F.col("n") <= bucket_entries).select("slot", F.lit(depth).alias("local_depth")))
    bucket = F.expr(f"shiftleft(slot, {depth} - local_depth)")
    slots = F.sequence(bucket, bucket + F.expr(f"shiftleft(1L, {depth} - local_depth) - 1"))
    return stages.write(settled.select(F.explode(slots).alias("slot"), bucket.alias("bucket"), "local_depth"), "directory"), depth


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = 1024) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when their normalised bytes are.  The directory, broadcast, sends each row to its bucket, and each bucket to one
    owner task, which holds that bucket's range of keys.  There the rows of a key are compared byte by byte: equal texts
    make one entry, unlike ones a chain, `chain` being the place in it.  All results are read from the entries.
    Rows of hot keys are aggregated before they are sent, so a group of any size reaches its owner as a few rows.

    Null and blank-only texts: a null counts as empty; all-blank texts are one group, empty texts another.
    Null ids: such rows belong to their group and are never kept; a group without any id keeps none.
    Repeated rows: rows that repeat an id and a text are all marked kept if that id is the smallest; rows that repeat an id
    with another text belong to the group of their own text.
    Empty table: no rows.  Other columns of docs are not read; join on the id for them.
    """
    spark = docs.sparkSession
    with Stages(spark, "exact-dedup") as stages:
        rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
        staged = stages.write(rows.select("id", "key", F.sha2("text", 256).alias("sha")), "keys")
        keys = stages.write(staged.groupBy("key").agg(F.count("*").alias("n")), "distinct-keys")
        n_keys, n_rows = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        directory, depth = grow_directory(stages, keys, n_keys, max(bucket_entries, -(-n_keys // MOST_BUCKETS)))

        hot = F.broadcast(keys.where(F.col("n") > max(HOT_ROWS, n_rows // MOST_HOT)).select("key"))
        merged = rows.join(hot, "key", "left_semi").groupBy("key", "text").agg(F.min("id").alias("id"), F.count("*").alias("n"))
        single = rows.join(hot, "key", "left_anti").select("key", "text", "id", F.lit(1).cast("long").alias("n"))
        sent = merged.union(single).withColumn("slot", slot_of(F.col("key"), depth)).join(F.broadcast(directory), "slot")
        owned = sent.repartition("bucket")
        entries = owned.groupBy("bucket", "key", "text").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))
        entries = entries.select("bucket", "key", F.sha2("text", 256).alias("sha"), "keep_id", "group_size")
        chain = Window.partitionBy("bucket", "key").orderBy("keep_id", "sha")
        index = stages.write(entries.withColumn("chain", F.row_number().over(chain) - 1), "index")

        found = staged.join(index, ["key", "sha"]).select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
            F.col("sha").alias("text_sha256"),
            "bucket",
            "chain",
        )
        return stages.keep(found)
