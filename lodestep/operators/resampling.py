"""Bootstraps of thousands of draws and weighted draws as many as rows, in time linear in the rows.

A draw gives each group a Poisson weight of mean one by a hash of the group and the draw, so every statistic of sums is one product
of weights and group sums a task, the same weights for every statistic. Draws in proportion to weights are split over ranges of rows first, as a
multinomial, and then made within each range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestep.operators import moments as G

U = np.uint64
_TERMS = np.exp(-1.0) / np.cumprod([1.0, *range(1, 13)])
#: A hash of 32 bits below the k-th of these has a weight of at most k: the distribution of a Poisson number of mean one.
POISSON = np.floor(np.cumsum(_TERMS) * 2**32).astype(U)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit numbers (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def poisson_weights(keys: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """(keys x draws) Poisson weights of mean one; ``keys`` are 64-bit hashes."""
    with np.errstate(over="ignore"):
        turn = _mixed((draws.astype(U) + U(1)) * U(0x9E3779B97F4A7C15) + U(seed))
        found = _mixed(keys.view(U)[:, None] ^ turn[None, :]) >> U(32)
    return np.searchsorted(POISSON, found.ravel(), "right").reshape(found.shape)


def poisson_sums(df: DataFrame, key: Column, numbers: list[Column], draws: int, seed: int, block: int = 256) -> np.ndarray:
    """((1 + draws) x numbers): sums of ``numbers`` over all rows, then over each resample of whole groups.

    Rows of a key are summed first, so a group of any size is one row; a null key is a group. What a task and the driver hold is 8 * (1 + draws) *
    numbers bytes. Null numbers count as 0. No rows: zeros.
    """
    many = len(numbers)
    sums = df.groupBy(key.alias("_key")).agg(*[F.coalesce(F.sum(x.cast("double")), F.lit(0.0)).alias(f"s{i}") for i, x in enumerate(numbers)])
    rows = sums.select(F.xxhash64("_key").alias("h"), *[f"s{i}" for i in range(many)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        out = np.zeros((1 + draws, many))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys, s = np.ascontiguousarray(part.column(0), np.int64), np.column_stack([np.asarray(part.column(i + 1), float) for i in range(many)])
                out[0] += s.sum(0)
                for first in range(0, draws, block):
                    some = np.arange(first, min(draws, first + block))
                    out[1 + some] += poisson_weights(keys, some, seed).T.astype(float) @ s
        yield 0, out

    found = G.tree_sum(rows, fold)
    return found[0].reshape(1 + draws, many) if found else np.zeros((1 + draws, many))


def interval(values: np.ndarray) -> tuple[float | None, float | None, float | None]:
    """(value, lo, hi): the first of ``values`` and the 2.5 % and 97.5 % percentiles of the others, to six places; None where there are none."""
    drawn = values[1:][np.isfinite(values[1:])]
    number = lambda x: round(float(x), 6) if np.isfinite(x) else None
    lo, hi = np.percentile(drawn, [2.5, 97.5]) if len(drawn) else (np.nan, np.nan)
    return number(values[0]), number(lo), number(hi)


def intervals(spark: SparkSession, sums: np.ndarray, statistics: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """(statistic, value, lo, hi, significant) of statistics of the same resampled sums; significant where 0 is outside."""
    rows = []
    for name, statistic in statistics.items():
        with np.errstate(divide="ignore", invalid="ignore"):
            value, lo, hi = interval(statistic(sums))
        rows.append((name, value, lo, hi, None if lo is None else not lo <= 0 <= hi))
    return spark.createDataFrame(rows, "statistic string, value double, lo double, hi double, significant boolean")


def f1_of(tp: np.ndarray, fp: np.ndarray, fn: np.ndarray) -> np.ndarray:
    """0 where nothing was found."""
    return np.where(tp > 0, 2 * tp / np.maximum(2 * tp + fp + fn, 1e-300), 0.0)


def weighted_epoch(df: DataFrame, key: str, weight: str, draws: int | None = None, seed: int = 0, each: int = 100_000) -> DataFrame:
    """(``key``, times): how often each row is drawn when ``draws`` draws, as many as rows unless stated, are made with replacement in proportion to ``weight``.

    Rows are dealt by a hash of their key into ranges of some ``each``; each range gets its number of draws from a multinomial over the
    ranges' weights, and meets its own sorted draws with its running weights. Rows never drawn are left out, as are those whose weight is null, not
    above 0 or not finite. Weights count to nine decimal places; keys are distinct. The same rows, seed and ``each`` give the same draws.
    """
    w = F.col(weight).cast("double")
    usable = df.where((w > 0) & (w < float("inf")) & F.col(key).isNotNull()).select(F.col(key), w.cast("decimal(28, 9)").alias("_w"))
    many, all_rows = usable.count(), df.count() if draws is None else draws
    ranges = max(1, -(-many // each))
    rows = usable.withColumn("_range", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(ranges)).cast("int"))
    weights = np.zeros(ranges)
    for r in rows.groupBy("_range").agg(F.sum("_w").cast("double").alias("w")).collect():  # a row for each ``each`` rows
        weights[r["_range"]] = r["w"]
    kind = df.select(key).schema.fields[0].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("times", T.LongType())])
    if not weights.sum():
        return df.sparkSession.createDataFrame([], schema)
    wanted = np.random.default_rng(seed).multinomial(all_rows, weights / weights.sum())

    def draw(table: pa.Table) -> pa.Table:
        at = table["_range"][0].as_py()
        table = table.sort_by(key)
        running = np.cumsum(np.asarray(table["_w"].cast(pa.float64()), float))
        points = np.sort(np.random.default_rng([seed, at]).random(wanted[at])) * running[-1]
        times = np.bincount(np.minimum(np.searchsorted(running, points, "right"), len(running) - 1), minlength=len(running))
        hit = np.flatnonzero(times)
        return pa.table({key: table[key].take(pa.array(hit)), "times": pa.array(times[hit], pa.int64())})

    return rows.groupBy("_range").applyInArrow(draw, schema)


def _refit(x: np.ndarray, y: np.ndarray, w: np.ndarray, turns: int = 30) -> np.ndarray:
    """Log odds of weighted logistic regression with unit penalty on all but the first column."""
    penalty, beta = np.diag([0.0, *[1.0] * (x.shape[1] - 1)]), np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.lstsq(x.T @ (x * (w * p * (1 - p))[:, None]) + penalty, x.T @ (w * (y - p)) - penalty @ beta, rcond=None)[0]
        size = np.abs(step).max()
        beta = beta + step * min(1.0, 5.0 / max(size, 1e-300))
        if size < 1e-8:
            break
    return x @ beta


def _weighted_auc(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    values, at = np.unique(np.round(score, 9), return_inverse=True)
    p, q = np.bincount(at, w * y, len(values)), np.bincount(at, w * (1 - y), len(values))
    total = p.sum() * q.sum()
    return float((p * (np.cumsum(q) - q / 2)).sum() / total) if total > 0 else float("nan")


def judge_gap(df: DataFrame, confounds: list[str], human: str, judge: str, draws: int = 10_000, seed: int = 0, most_cells: int = 200_000) -> DataFrame:
    """(n, cells, human_auc, judge_auc, gap, lo, hi, significant): how much better all ``confounds`` together tell the judge's label than the human one.

    Each label is fitted anew in each resample of the rows. Rows alike in confounds and labels are one cell with a count, and the number of times that a
    resample of Poisson weights takes a cell is a Poisson number of that mean; so resamples are drawn from the cells, dealt over tasks, and cost the same
    however many rows there are. Confounds are cut into levels beforehand: more than ``most_cells`` cells are an error. Rows with a null are
    left out. A resample without both classes of both labels counts for nothing; without rows all is null.
    """
    cells = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(confounds)], F.col(human).cast("double").alias("h"), F.col(judge).cast("double").alias("j")).dropna()
    cells = cells.groupBy(*cells.columns).agg(F.count("*").cast("double").alias("n")).orderBy(*cells.columns)
    found = cells.limit(most_cells + 1).collect()
    if len(found) > most_cells:
        raise ValueError(f"more than {most_cells} cells: cut the confounds into fewer levels")
    schema = "n long, cells long, human_auc double, judge_auc double, gap double, lo double, hi double, significant boolean"
    if not found:
        return df.sparkSession.createDataFrame([(0, 0, None, None, None, None, None, None)], schema)
    table, k = np.array([tuple(r) for r in found]), len(confounds)
    mean = np.average(table[:, :k], axis=0, weights=table[:, -1])
    spread = np.sqrt(np.average((table[:, :k] - mean) ** 2, axis=0, weights=table[:, -1]))
    x, h, j, n = np.column_stack([np.ones(len(table)), (table[:, :k] - mean) / np.where(spread > 0, spread, 1.0)]), table[:, k], table[:, k + 1], table[:, -1]

    def both(w: np.ndarray) -> tuple[float, float]:
        if not all(0 < (w * y).sum() < w.sum() for y in (h, j)):
            return float("nan"), float("nan")
        return tuple(_weighted_auc(_refit(x, y, w), y, w) for y in (h, j))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = []
            for draw in batch.column(0).to_pylist():
                a, b = both(np.random.default_rng([seed, draw]).poisson(n).astype(float))
                gaps.append((draw, b - a))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*gaps, strict=True)] if gaps else [pa.array([], pa.int64()), pa.array([], pa.float64())], names=["draw", "gap"])

    spark = df.sparkSession
    drawn = [r["gap"] for r in spark.range(draws, numPartitions=max(1, min(draws, 8 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "draw long, gap double").collect()]  # ``draws`` numbers
    seen = both(n)
    gap, lo, hi = interval(np.array([seen[1] - seen[0], *drawn]))
    number = lambda v: round(v, 6) if np.isfinite(v) else None
    return spark.createDataFrame([(int(n.sum()), len(table), number(seen[0]), number(seen[1]), gap, lo, hi, None if lo is None else not lo <= 0 <= hi)], schema)
