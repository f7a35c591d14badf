"""Confound control: standardisation, residuals by normal equations, linear probes.

Only a k x k Gram matrix reaches the driver (k confounds), never rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestep.operators import metrics as M


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds z_<column>: minus the mean, over the population deviation; a constant column gives 0."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    z = [((F.col(c) - F.col(f"_mu_{c}")) / F.when(F.col(f"_sd_{c}") == 0, 1.0).otherwise(F.col(f"_sd_{c}"))).alias(f"z_{c}") for c in columns]
    return joined.select(*[joined[c] for c in df.columns], *z)


def fit_least_squares(df: DataFrame, targets: list[str], confounds: list[str], train: Column) -> np.ndarray:
    """Coefficients (1 + confounds) x targets by the normal equations over the training rows; least norm where they are dependent."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in confounds]]
    y = [F.col(t).cast("double") for t in targets]
    products = [a * b for i, a in enumerate(x) for b in x[i:]] + [a * b for a in x for b in y]
    sums = df.where(train).agg(*[F.coalesce(F.sum(p), F.lit(0.0)).alias(f"s{i}") for i, p in enumerate(products)]).first()
    values, k = list(sums), len(x)
    gram, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = values[at]
            at += 1
    return np.linalg.pinv(gram, rcond=1e-12) @ np.array(values[at:]).reshape(k, len(y))


def residualize(df: DataFrame, targets: list[str], confounds: list[str], train: Column) -> DataFrame:
    """Adds <target>_residual: the target less its least-squares fit on the confounds, fit where ``train`` holds, applied to every row."""
    beta = fit_least_squares(df, targets, confounds, train)
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in confounds]]
    fitted = [sum((F.lit(float(beta[i, j])) * c for i, c in enumerate(x)), F.lit(0.0)) for j in range(len(targets))]
    return df.select("*", *[(F.col(t).cast("double") - f).alias(f"{t}_residual") for t, f in zip(targets, fitted, strict=True)])


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def probe(df: DataFrame, vector: str, label: str, train: Column) -> DataFrame:
    """L2 logistic regression of unit strength on training rows; accuracy, F1 and AUC on the others."""
    df = _vectors(df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()), vector)
    n = df.where(train).count()
    model = LogisticRegression(labelCol=label, regParam=1.0 / max(n, 1), standardization=False, maxIter=100).fit(df.where(train).select(label, "features"))
    scored = model.transform(df.where(~train)).select((F.col(label) == 1).alias("pos"), F.col("prediction").alias("z"), F.round(vector_to_array("probability")[1], 9).alias("score"))
    hit = lambda a, b: F.count_if((F.col("pos") == a) & (F.col("z") == b)).cast("double")
    f1 = M.f1(hit(True, 1), hit(False, 1), hit(True, 0))
    counts = scored.agg(F.count("*").alias("n"), F.round(F.avg((F.col("pos") == (F.col("z") == 1)).cast("double")), 6).alias("accuracy"), F.round(f1, 6).alias("f1"))
    return counts.crossJoin(M.auc(scored, "score", "pos", []))  # one row each


def pca(df: DataFrame, vector: str, k: int) -> DataFrame:
    vectors = _vectors(df, vector)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(vectors)
    return model.transform(vectors).select(*[c for c in df.columns if c != vector], *[F.round(vector_to_array("pc")[i], 6).alias(f"pc{i + 1}") for i in range(k)])


def leave_one_out(df: DataFrame, vector: str, label: str, group: str, groups: list) -> DataFrame:
    """A probe for each group, trained on the other groups."""
    out = None
    for g in groups:
        one = probe(df, vector, label, F.col(group) != g).select(F.lit(g).alias(group), "n", "accuracy", "f1", "auc")
        out = one if out is None else out.union(one)
    return out
