"""Table readers shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
