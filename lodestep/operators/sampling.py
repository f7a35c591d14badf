"""Splits, samples and bootstrap resamples on portable hashes: the same rows on every engine and every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestep.functions.rand import h


def rank_by_hash(seed: int, key: Column, by: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(h(seed, key), key))


def per_split(df: DataFrame, key: str, split: str, cls: str, k: int, seed: int, mode: str = "balanced") -> DataFrame:
    """``k`` rows of each split, the first in hash order: k // 2 of each class (``balanced``), or as they come (``natural``)."""
    if mode not in ("balanced", "natural"):
        raise ValueError(f"mode: {mode}")
    by, most = ([F.col(split), F.col(cls)], k // 2) if mode == "balanced" else ([F.col(split)], k)
    return df.withColumn("_rn", rank_by_hash(seed, F.col(key), by)).where(F.col("_rn") <= most).drop("_rn")


def bounded_rank(df: DataFrame, seed: int, key: str, bucket_rows: int = 500_000) -> DataFrame:
    """``rank`` of every row of the whole table in hash order, without ordering the table in one task.

    The hash's high bits deal the rows into buckets of some ``bucket_rows`` rows; each bucket is ranked alone and starts where
    those before it end.
    """
    buckets = max(64, df.count() // bucket_rows)
    hashed = df.withColumn("_h", h(seed, F.col(key))).withColumn("_b", F.expr(f"cast(_h * {buckets} div 4294967296 as int)"))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return hashed.join(F.broadcast(before), "_b").withColumn("rank", (F.col("_s") + inner).cast("long")).drop("_h", "_b", "_s")


def train_split(df: DataFrame, seed: int, key: str, share: float = 0.8) -> DataFrame:
    """``is_train`` for exactly floor(share * n) rows, the first in hash order."""
    n = df.agg(F.count("*").alias("_all"))
    ranked = bounded_rank(df, seed, key).crossJoin(F.broadcast(n))
    return ranked.withColumn("is_train", F.col("rank") <= F.floor(F.col("_all") * share)).drop("rank", "_all")


def bootstrap(groups: DataFrame, draws: int, seed: int) -> DataFrame:
    """(b, slot, idx): ``draws`` resamples with replacement of groups numbered by ``idx`` from 0; the same for every statistic."""
    n = groups.agg(F.count("*").alias("n"))
    turns = groups.sparkSession.range(draws).withColumnRenamed("id", "b").crossJoin(F.broadcast(n))  # one row; the draws are dealt over tasks
    return turns.select("n", "b", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("slot")).select(
        "b", "slot", (h(seed, F.col("b"), F.col("slot")) % F.col("n")).alias("idx")
    )


def kth_least(df: DataFrame, key: str, share: float, buckets: int = 1024) -> DataFrame:
    """One row, last: the key at place floor(share * n) of the ``key``s of ``df`` in order, which are distinct whole numbers; none for place 0.

    Keys are counted in ranges; only the range that holds the place is ordered.
    """
    ends = df.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"), F.floor(F.count("*") * share).alias("_k"))
    ranged = df.select(key).crossJoin(F.broadcast(ends))  # one row
    ranged = ranged.withColumn("_b", F.floor((F.col(key) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo") + 1) / F.lit(buckets))))
    sizes = ranged.groupBy("_b", "_k").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_b"))  # ``buckets`` rows
    held = sizes.withColumn("_to", upto).where("_to >= _k and _to - _n < _k").select("_b", (F.col("_k") - F.col("_to") + F.col("_n")).alias("_place"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    found = ranged.select("_b", key).join(F.broadcast(held), "_b").withColumn("_rn", inner)  # one row of ``held``
    return found.where("_rn = _place").select(F.col(key).alias("last"))
