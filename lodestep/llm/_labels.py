"""Bounded, documented samples of labelled documents, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text leaves no remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_chars: int) -> tuple[list[str], list[int], float]:
    """(texts, labels, share of label 1) for training.

    At most ``per_class`` labelled rows of each class, the first in hash order, whose whole text has at most
    ``most_chars`` characters; rows of the held-out fold, without id, text or a 0/1 label never enter, nor do ids that have both labels.
    A repeated label row counts once. The share counts every usable id. So at most 2 * per_class * most_chars characters reach the driver.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_most")).where("y = _most").drop("_most")
    counts = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    order = F.xxhash64("doc_id")
    picked = [usable.where(F.col("y") == y).orderBy(order, "doc_id").limit(2 * per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))  # at most 4 * per_class rows of 12 bytes
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .where(F.col("text").isNotNull() & (F.length("text") <= most_chars))
        .join(ids, "doc_id")
        .select("doc_id", "y", "text")
    )
    # One scan for both classes: the few texts that the ids leave are ranked within their class.
    order = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = texts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_class).orderBy("y", "_rank").collect()
    return [r.text for r in rows], [r.y for r in rows], share
