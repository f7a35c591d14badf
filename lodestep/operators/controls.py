"""Cross-fitted control, directions and erasure of concepts, and matching.

Every fit needs sums only: rows are folded into moments where they lie, and one small table of moments, whose size is set by
the columns or the dimension and never by the rows, reaches the driver. What is fitted is applied to whole batches, or as a Column.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestep.functions import vectors as V
from lodestep.functions.rand import h
from lodestep.operators import moments as G
from lodestep.operators import sampling as S
from lodestep.operators.matching import matched  # noqa: F401


def _products(names: list[str]) -> list[Column]:
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    return [F.coalesce(F.sum(a * b), F.lit(0.0)).alias(f"s{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if j >= i]


def fold_moments(df: DataFrame, columns: list[str], fold: str) -> dict[int, np.ndarray]:
    """For each fold the sums of products of one and ``columns``, as a square table; rows with a null in any of them are left out."""
    whole = df.where(" and ".join(f"`{c}` is not null" for c in [*columns, fold]))
    out, size = {}, len(columns) + 1
    for row in whole.groupBy(fold).agg(*_products(columns)).collect():  # one row a fold
        table = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                table[i, j] = table[j, i] = row[f"s{i}_{j}"]
        out[row[fold]] = table
    return out


def _ridge(moments: np.ndarray, k: int, strength: float) -> np.ndarray:
    """Coefficients, (1 + k) x targets, of ridge regression with a free intercept; the first ``k`` columns are the features."""
    gram = moments[: k + 1, : k + 1] + np.diag([0.0, *[strength] * k])
    return np.linalg.pinv(gram, rcond=1e-12) @ moments[: k + 1, k + 1 :]


def crossfit(df: DataFrame, targets: list[str], confounds: list[str], fold: str, strength: float = 0.0) -> tuple[DataFrame, dict[str, float]]:
    """(``df`` with <target>_residual, held-out R2 of each target): each row's target less a fit on the other folds' rows.

    The R2 is the mean over folds of one less the held-out squared error over the held-out squared deviation; a fold whose
    target is constant counts as 0. A row with a null among the columns has a null residual. One fold alone is fitted on nothing, so its residual is the target.
    """
    k, by_fold = len(confounds), fold_moments(df, [*confounds, *targets], fold)
    total = sum(by_fold.values(), np.zeros((k + len(targets) + 1,) * 2))
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in confounds]]
    fits = {f: _ridge(total - own, k, strength) for f, own in by_fold.items()}
    residuals, fit = [], {}
    for t, target in enumerate(targets):
        fitted, scores = F.lit(None).cast("double"), []
        for f, beta in fits.items():
            fitted = F.when(F.col(fold) == f, sum((F.lit(float(b)) * c for b, c in zip(beta[:, t], x, strict=True)), F.lit(0.0))).otherwise(fitted)
            own, at = by_fold[f], k + 1 + t
            error = own[at, at] - 2 * beta[:, t] @ own[: k + 1, at] + beta[:, t] @ own[: k + 1, : k + 1] @ beta[:, t]
            spread = own[at, at] - own[0, at] ** 2 / own[0, 0]
            scores.append(1 - error / spread if spread > 1e-12 else 0.0)
        residuals.append((F.col(target).cast("double") - fitted).alias(f"{target}_residual"))
        fit[target] = float(np.mean(scores)) if scores else 0.0
    return df.select("*", *residuals), fit


def fourier_features(df: DataFrame, columns: list[str], count: int, gamma: float, seed: int) -> tuple[DataFrame, list[str]]:
    """(``df`` with ``count`` columns, their names) whose inner products approach the Gaussian kernel exp(-gamma |x - y|^2) of ``columns``.

    With ``crossfit`` and a ridge strength this is kernel ridge control whose cost is linear in the rows.
    """
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (count, len(columns))), rng.uniform(0, 2 * np.pi, count)
    angle = lambda i: sum((F.lit(float(w[i, j])) * F.col(c).cast("double") for j, c in enumerate(columns)), F.lit(float(b[i])))
    names = [f"fourier_{i}" for i in range(count)]
    return df.select("*", *[(F.cos(angle(i)) * float(np.sqrt(2 / count))).alias(n) for i, n in enumerate(names)]), names


def vector_moments(df: DataFrame, vector: str, targets: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean of the vectors, their covariance, covariance of each component with each target, variances of the targets), of the population.

    Each task adds its rows up to one triangle of packed numbers, and triangles are added in a tree, so the driver gets half of
    (1 + dimension + targets)^2 numbers once. Rows with a null vector, component or target are left out, as are components that are not finite.
    Vectors of unlike length and no rows are errors.
    """
    whole, d = G.whole_vectors(df, vector)
    sums = G.gram(whole, vector, d, [F.col(t) for t in targets]).get(0)
    if sums is None:
        raise ValueError("no row has a vector and every target")
    mean = sums[0, 1:] / sums[0, 0]
    covariance = sums[1:, 1:] / sums[0, 0]
    covariance -= np.outer(mean, mean)
    return mean[:d], covariance[:d, :d], covariance[:d, d:], np.diag(covariance)[d:]


def pls_directions(covariance: np.ndarray, cross: np.ndarray, k: int) -> np.ndarray:
    """``k`` orthonormal columns: weight vectors of partial least squares, found from moments alone.

    Each is the leading left singular vector of the covariance with the targets; what its score explains is then taken out of both moments.
    Fewer columns come back where nothing is left to explain.
    """
    left, c, weights = covariance.copy(), cross.reshape(len(covariance), -1).copy(), []
    for _ in range(k):
        u, s, _ = np.linalg.svd(c, full_matrices=False)
        w = u[:, 0]
        spread = w @ left @ w
        if s[0] < 1e-12 or spread < 1e-15:
            break
        load = left @ w / spread
        weights.append(w * np.sign(w @ c[:, 0] or 1.0))
        c = c - np.outer(load, w @ c)
        left = left - np.outer(load, load) * spread
    return np.linalg.qr(np.array(weights).T)[0] if weights else np.zeros((len(covariance), 0))


class Change(NamedTuple):
    """What takes ``out @ (along.T @ (v - mean))`` away from a vector v; ``out`` and ``along`` have a column for each direction."""

    out: np.ndarray
    along: np.ndarray
    mean: np.ndarray | None = None


def ablation(basis: np.ndarray, mean: np.ndarray | None = None) -> Change:
    """Takes away the part in the span of the orthonormal columns of ``basis``; with ``mean``, that part becomes the mean's."""
    return Change(basis, basis, mean)


def erasure(mean: np.ndarray, covariance: np.ndarray, cross: np.ndarray) -> Change:
    """Least-squares erasure: the least change of v after which no linear function of it goes with the targets."""
    values, axes = np.linalg.eigh(covariance + 1e-6 * np.eye(len(covariance)))
    roots = np.sqrt(values)
    u, s, _ = np.linalg.svd(axes @ ((axes.T @ cross.reshape(len(covariance), -1)) / roots[:, None]), full_matrices=False)
    part = axes.T @ u[:, s > 1e-8]
    return Change(axes @ (part * roots[:, None]), axes @ (part / roots[:, None]), mean)


def oblique_ablation(basis: np.ndarray, kept: np.ndarray) -> Change:
    """``ablation``, with what was taken out along the orthonormal columns of ``kept`` put back."""
    return Change(basis - kept @ (kept.T @ basis), basis)


#: What a change's directions may hold when they go to the tasks.
MOST_BYTES = 1 << 28


def changed(df: DataFrame, vector: str, change: Change) -> DataFrame:
    """``df`` with ``vector`` changed, whole batches at a time; null vectors stay null.

    The directions are broadcast: 16 bytes a dimension and direction, checked against ``MOST_BYTES``. Vectors of another length
    than the directions are an error.
    """
    size, held = change.along.shape[0], change.out.nbytes + change.along.nbytes
    if held > MOST_BYTES:
        raise ValueError(f"the directions take {held} bytes, more than {MOST_BYTES}")
    shared, kept, at = df.sparkSession.sparkContext.broadcast(change), df.columns, df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            column = batch.column(at)
            there = np.asarray(column.is_valid())
            if (np.diff(np.asarray(column.offsets))[there] != size).any():
                raise ValueError(f"vectors must have {size} components")
            x = G.matrix(column.drop_null(), size)
            x = x - (x if c.mean is None else x - c.mean) @ c.along @ c.out.T
            offsets = np.concatenate([[0], np.cumsum(there)]) * size
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.ravel()), mask=pa.array(~there))
            yield pa.RecordBatch.from_arrays([made if i == at else col for i, col in enumerate(batch.columns)], names=kept)

    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if i == at else f for i, f in enumerate(df.schema.fields)])
    return df.withColumn(vector, V.doubles(F.col(vector))).mapInArrow(run, schema)


def moved(v: Column, change: Change) -> Column:
    """``changed`` as a Column, for directions few and short enough to stand in a plan."""
    literal = lambda a: F.array(*[F.lit(float(x)) for x in a])
    shift = np.zeros(change.along.shape[1]) if change.mean is None else change.mean @ change.along
    result = V.doubles(v)
    for j in range(change.along.shape[1]):
        result = V.add(result, literal(change.out[:, j]), F.lit(float(shift[j])) - V.dot(v, literal(change.along[:, j])))
    return result


def ablated(v: Column, basis: np.ndarray) -> Column:
    """v without its part in the span of the orthonormal columns of ``basis``."""
    return moved(v, ablation(basis))


def erased(v: Column, mean: np.ndarray, covariance: np.ndarray, cross: np.ndarray) -> Column:
    """``erasure`` of v as a Column."""
    return moved(v, erasure(mean, covariance, cross))


def oblique(v: Column, basis: np.ndarray, kept: np.ndarray) -> Column:
    """``oblique_ablation`` of v as a Column."""
    return moved(v, oblique_ablation(basis, kept))


def gap_interval(df: DataFrame, group: str, value: str, hit: str, draws: int, seed: int, blocks: int = 200) -> DataFrame:
    """(groups, gap, lo, hi, excludes_zero): mean of ``value`` over rows with ``hit`` less the mean over the others, and its 95 % interval by resampling whole groups.

    Groups without rows of either kind are left out. Groups are summed into ``blocks`` blocks by hash and blocks are
    resampled, so what is drawn does not grow with the table.
    """
    one = lambda c, f: F.sum(F.when(c, f).otherwise(0.0))
    yes, x = F.col(hit), F.col(value).cast("double")
    sums = df.where(x.isNotNull() & yes.isNotNull()).groupBy(group).agg(
        one(yes, x).alias("es"), one(yes, F.lit(1.0)).alias("en"), one(~yes, x).alias("os"), one(~yes, F.lit(1.0)).alias("on")
    ).where("en > 0 and on > 0")
    held = sums.groupBy((h(seed, F.col(group)) % blocks).alias("block")).agg(F.count("*").alias("groups"), *[F.sum(c).alias(c) for c in ("es", "en", "os", "on")])
    numbered = held.withColumn("idx", F.row_number().over(Window.orderBy("block")) - 1)  # at most ``blocks`` rows
    gap = F.sum("es") / F.sum("en") - F.sum("os") / F.sum("on")
    drawn = S.bootstrap(numbered, draws, seed).join(F.broadcast(numbered), "idx").groupBy("b").agg(gap.alias("d"))
    lo, hi = F.percentile("d", 0.025), F.percentile("d", 0.975)
    seen = numbered.agg(F.sum("groups").alias("groups"), F.round(gap, 6).alias("gap"))
    return seen.crossJoin(drawn.agg(F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), ((lo > 0) | (hi < 0)).alias("excludes_zero")))
