"""Shared folder, scratch tables and column hygiene for the operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a session within one machine, as in tests, gets a folder of its own; on a cluster that is an
    error, as no machine's own folder is seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor see")
        found = f"file://{tempfile.mkdtemp(prefix='lodestep-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores put before it until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables written to the shared folder, removed when the block ends."""

    def __init__(self, spark: SparkSession):
        self.name = f"lodestep_{uuid.uuid4().hex}"
        self.spark, self.path, self.made, self.named = spark, f"{shared_dir(spark)}/{self.name}", 0, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for name in self.named:
            self.spark.sql(f"drop table if exists {name}")
        remove(self.spark, self.path)

    def write(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` as Parquet and returns the table: lineage is cut, and a lost executor costs nothing that was written."""
        self.made += 1
        at = f"{self.path}/{self.made}"
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """Writes ``df`` in buckets by ``key``: joins and groups by it move no row of this table. Its rows should lie by ``key`` already, else each task writes to every bucket."""
        self.made += 1
        self.named.append(name := f"{self.name}_{self.made}")
        df.write.format("parquet").option("compression", "zstd").option("parquet.enable.dictionary", "false").option("path", f"{self.path}/{self.made}").bucketBy(partitions(self.spark), key).saveAsTable(name)
        return self.spark.table(name)


def partitions(spark: SparkSession) -> int:
    """Of a shuffle, before Spark joins small ones."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with: it does when Python's and the driver's collectors drop them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, so any store works."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
