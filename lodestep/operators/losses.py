"""Losses, attributions and separations of vectors as joins within batches and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestep.functions import vectors as V
from lodestep.functions.rand import h
from lodestep.operators import sampling as S


def ranking_loss(pairs: DataFrame, batch: str, key: str, anchor: str, positive: str, temperature: float) -> DataFrame:
    """(loss): mean cross entropy of each anchor's own positive among all positives of its batch, on cosines over ``temperature``.

    A batch is what is compared at once, so its size is the caller's choice and bounds the pairs of each row.
    """
    a = pairs.select(batch, F.col(key).alias("_a"), V.unit(F.col(anchor)).alias("_u"))
    p = pairs.select(batch, F.col(key).alias("_p"), V.unit(F.col(positive)).alias("_v"))
    met = a.join(p, batch).select("_a", (F.col("_a") == F.col("_p")).alias("own"), (V.dot(F.col("_u"), F.col("_v")) / temperature).alias("s"))
    rows = met.groupBy("_a").agg((F.log(F.sum(F.exp("s"))) - F.sum(F.when(F.col("own"), F.col("s")).otherwise(0.0))).alias("l"))
    return rows.agg(F.round(F.avg("l"), 6).alias("loss"))


def class_contrast_loss(df: DataFrame, batch: str, key: str, vector: str, label: str, temperature: float) -> DataFrame:
    """(loss): supervised contrastive loss; for each row with another of its label in its batch, the mean over those of the cross entropy among all others."""
    a = df.select(batch, F.col(key).alias("_a"), F.col(label).alias("_x"), V.unit(F.col(vector)).alias("_u"))
    p = df.select(batch, F.col(key).alias("_p"), F.col(label).alias("_y"), V.unit(F.col(vector)).alias("_v"))
    met = a.join(p, batch).where("_a != _p").select("_a", (F.col("_x") == F.col("_y")).alias("same"), (V.dot(F.col("_u"), F.col("_v")) / temperature).alias("s"))
    rows = met.groupBy("_a").agg((F.log(F.sum(F.exp("s"))) - F.avg(F.when(F.col("same"), F.col("s")))).alias("l"))
    return rows.agg(F.round(F.avg("l"), 6).alias("loss"))


def triplet_loss(anchor: Column, positive: Column, negative: Column, margin: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), V.distance(anchor, positive) - V.distance(anchor, negative) + margin)


def cross_entropy_of_logit(logit: Column, label: Column) -> Column:
    """Binary cross entropy of a logit, without overflow; null where the label is null or below 0."""
    x = logit.cast("double")
    return F.when(label >= 0, F.greatest(x, F.lit(0.0)) - x * label + F.log1p(F.exp(-F.abs(x))))


def auc_gap_interval(df: DataFrame, key: str, level: str, first: str, second: str, draws: int, seed: int, blocks: int = 50) -> DataFrame:
    """(gap, lo, hi, significant): how much better ``level``, a whole number, tells label ``second`` than label ``first``, with a 95 % interval.

    A rule on one number may rise or fall, so an AUC below a half counts as one less it. Rows are counted by block of hashes and level
    first; blocks are resampled, so what is drawn depends on blocks and levels, not on the table.
    """
    pos = lambda c: F.count_if(F.col(c)).cast("double")
    counts = df.groupBy((h(seed, F.col(key)) % blocks).alias("block"), level).agg(pos(first).alias("p1"), pos(second).alias("p2"), F.count("*").cast("double").alias("n"))
    numbered = counts.select("block").distinct().withColumn("idx", F.row_number().over(Window.orderBy("block")) - 1)  # at most ``blocks`` rows
    drawn = S.bootstrap(numbered, draws, seed).groupBy("b", "idx").agg(F.count("*").alias("times"))
    whole = numbered.select(F.lit(-1).cast("long").alias("b"), "idx", F.lit(1).cast("long").alias("times"))
    held = counts.join(F.broadcast(numbered), "block")
    sums = drawn.union(whole).join(held, "idx").groupBy("b", level).agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in ("p1", "p2", "n")])
    below = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rank = F.col("below") + (F.col("n") + 1) / 2.0

    def auc(p: str) -> Column:
        value = F.try_divide(F.sum(rank * F.col(p)) - F.sum(p) * (F.sum(p) + 1) / 2, F.sum(p) * (F.sum("n") - F.sum(p)))
        return F.greatest(value, 1 - value)

    gaps = sums.withColumn("below", below).groupBy("b").agg((auc("p2") - auc("p1")).alias("d"))
    bound = lambda q: F.percentile(F.when(F.col("b") >= 0, F.col("d")), q)
    return gaps.agg(
        F.round(F.max(F.when(F.col("b") < 0, F.col("d"))), 6).alias("gap"), F.round(bound(0.025), 6).alias("lo"), F.round(bound(0.975), 6).alias("hi"),
        ((bound(0.025) > 0) | (bound(0.975) < 0)).alias("significant"),
    )
