"""Small tables that several steps read are written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint in spark.checkpoint.dir: later steps read them again instead of computing them, and a lost executor costs no step before.

    Without that setting a temporary folder is taken, on one machine only.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="millrace-"))
    return df.checkpoint()
