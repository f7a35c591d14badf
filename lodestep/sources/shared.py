"""The folder that every executor sees, and tables that cut lineage in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; without it a new temporary one within one machine (master ``local``), as in tests, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor see")
        found = f"file://{tempfile.mkdtemp(prefix='lodestep-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, its rows written to the shared folder: what is built on it starts there, after a lost executor too."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
