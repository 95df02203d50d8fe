"""Documents to training windows: language, copies, near copies, test items, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, exact_dedup, language_id, minhash_dedup, packing
from millrace.llm.queries import word_tokenizer
from millrace.llm.shared import Stages, shared_folder

#: A prediction less sure than this is no language.
LEAST_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The most row numbers that are broadcast: 16 MB, and some 64 MB as a hash table.
BROADCAST_ROWS = 2_000_000
#: Stretches that the tokenizer remembers: fewer than alone, beside what the stages before left in an executor's memory.
REMEMBERED = 100_000
#: Number of a row, by which stages decide: ids may be null or repeated.  A name that no table of documents bears by chance.
ROW = "pipeline_row_number"
#: Number of a row among near copies.
NODE = "pipeline_node_number"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with their ROW: as the stage before wrote it, else given and written once here."""
    if ROW in docs.columns:
        return docs.select(*COLUMNS, ROW)
    return Stages(docs.sparkSession, "rows").keep(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW)), "rows")


def without(stages: Stages, docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of docs but those dropped.  Up to BROADCAST_ROWS numbers (8 bytes each) are sent to every executor; more are joined by shuffle."""
    dropped = stages.keep(dropped.select(ROW), "dropped")
    few = dropped.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(dropped) if few else dropped, ROW, "left_anti").select(*COLUMNS, ROW)


def place() -> F.Column:
    """Order within a group: the smallest id first, rows without an id last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from the stage's own rows; texts without a letter or a sure language go.  Rows are numbered for the next stages."""
    found = language_id.identify(docs, docs, carry=COLUMNS[1:])
    sure = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return sure.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, whatever the ids: that with the smallest id; rows without an id come last."""
    docs = numbered(docs)
    with Stages(spark, "distinct-texts") as stages:
        found = exact_dedup.exact_dedup(docs.withColumn("place", place()), id_col="place")
        return without(stages, docs, found.where("not kept").select(F.col("place")[ROW].alias(ROW)))


def with_node(stages: Stages, docs: DataFrame) -> DataFrame:
    """Rows with NODE, a number in the order of the ids: the id where it is no other row's, else one below 0 from the row's number.

    Near copies then meet the document with the group's smallest id first.
    """
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 OR doc_id IS NULL OR doc_id < 0")
    shared = stages.keep(shared.select(F.col("doc_id").alias("shared_id"), F.lit(True).alias("shared")), "shared-ids")
    few = shared.count() <= BROADCAST_ROWS
    met = docs.join(F.broadcast(shared) if few else shared, F.col("doc_id").eqNullSafe(F.col("shared_id")), "left")
    return met.select(*COLUMNS, ROW, F.when(F.col("shared"), -1 - F.col(ROW)).otherwise(F.col("doc_id")).alias(NODE))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, whatever the ids: that with the smallest id; rows without an id come last."""
    docs = numbered(docs)
    with Stages(spark, "distinct-documents") as stages:
        nodes = with_node(stages, docs)
        found = minhash_dedup.near_duplicates(nodes, id_col=NODE)
        later = found.where(F.col(NODE) != F.col("component_id")).select(NODE, F.col("component_id").alias("of"))
        heads = later.select(F.col("of").alias(NODE), "of").distinct()
        placed = stages.write(later.union(heads).join(nodes.select("doc_id", ROW, NODE), NODE).select("of", place().alias("place")), "placed")
        first = stages.write(placed.groupBy("of").agg(F.min("place").alias("first")), "first")
        dropped = placed.join(first, "of").where(F.col("place")[ROW] != F.col("first")[ROW])
        return without(stages, docs, dropped.select(F.col("place")[ROW].alias(ROW)))


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the benchmark's items do not contaminate; each row is judged alone and carried through the scan."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(numbered(docs), benchmark, id_col=ROW, carry=COLUMNS)
    return found.where("not contaminated").select(*COLUMNS, ROW)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_tokenizer(), with_ids=False, remembered=REMEMBERED)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_documents),
    ("decontamination", without_test_items),
    ("packing", windows),
]

#: Language, packing and the model behind them are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_folder(spark)}/millrace-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
