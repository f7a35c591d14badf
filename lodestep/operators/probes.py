"""Many logistic probes at once, and the reports made of them.

A Newton step of every model, each with its own columns and left-out fold, takes one scan: rows are folded into the gradients and curvatures
of all models, and only those, added up, reach the driver. Vectors are controlled for confounds by one matrix, from joint moments
of both over the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestep.operators import metrics as M
from lodestep.operators import moments as G
from lodestep.sources.shared import written


class Model(NamedTuple):
    """A probe trained on the rows whose fold is not ``held``.

    Its features are the numbers at ``columns`` or, with ``matrix``, ((1 + size) x features), one and the whole vector times that.
    """

    name: str
    held: int
    columns: list[int] | None = None
    matrix: np.ndarray | None = None

    def count(self) -> int:
        return self.matrix.shape[1] if self.columns is None else len(self.columns)

    def of(self, x: np.ndarray) -> np.ndarray:
        """One and the features of rows that begin with one."""
        return np.column_stack([x[:, 0], x @ self.matrix]) if self.columns is None else x[:, [0, *[c + 1 for c in self.columns]]]

    def plain(self, weights: np.ndarray, size: int) -> np.ndarray:
        """Weights of one and the whole vector that give what ``weights`` give on the features."""
        out = np.zeros(size + 1)
        if self.columns is None:
            out = self.matrix @ weights[1:]
        else:
            out[[c + 1 for c in self.columns]] = weights[1:]
        out[0] += weights[0]
        return out


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z) - y * z


def fit_logistic(df: DataFrame, vector: str, size: int, label: str, fold: str, models: list[Model], strength: float = 1.0, turns: int = 50, tolerance: float = 1e-9) -> list[np.ndarray]:
    """Each model's weights, the intercept first: logistic regression with a squared penalty of ``strength`` on all but the intercept.

    A scan gives all models' gradients and curvatures, and a step that makes a model's loss worse is halved. ``vector`` holds the numbers of every
    model, ``size`` of them, without nulls; ``label`` is 0 or 1. Rows with a null label or fold train nothing. A model that has rows of one class only
    ends with the intercept that the turns lead to.
    """
    sizes = [m.count() + 1 for m in models]
    penalty = [np.array([0.0, *[strength] * (k - 1)]) for k in sizes]
    weights, step = [np.zeros(k) for k in sizes], [np.zeros(k) for k in sizes]
    settled, best = [False] * len(models), [np.inf] * len(models)
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("double").alias("y"), F.col(fold).cast("long").alias("fold")).dropna().persist()  # read once a turn

    def scan(at: list[np.ndarray], wanted: list[int]):
        def fold_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            sums: dict[int, list] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                whole = np.column_stack([np.ones(batch.num_rows), G.matrix(batch.column(0), size)])
                ys, folds = np.asarray(batch.column(1), float), np.asarray(batch.column(2))
                for i in wanted:
                    use = folds != models[i].held
                    x, y = models[i].of(whole[use]), ys[use]
                    z = x @ at[i]
                    p = _chance(z)
                    found = sums.setdefault(i, [np.zeros((sizes[i],) * 2), np.zeros(sizes[i]), 0.0])
                    found[0] += x.T @ (x * (p * (1 - p))[:, None])
                    found[1] += x.T @ (y - p)
                    found[2] += _loss(z, y).sum()
            for i, (curve, slope, loss) in sums.items():
                yield i, np.concatenate([G.packed(curve), slope, [loss]])

        return G.tree_sum(rows, fold_up)

    for _ in range(turns):
        wanted = [i for i, done in enumerate(settled) if not done]
        if not wanted:
            break
        found = scan(weights, wanted)
        for i in wanted:
            if i not in found:  # no rows to train on
                settled[i] = True
                continue
            k = sizes[i]
            loss = found[i][-1] + 0.5 * penalty[i] @ weights[i] ** 2
            if loss > best[i] + 1e-12 * abs(best[i]):
                step[i] = step[i] / 2
                weights[i] = weights[i] - step[i]
                settled[i] = bool(np.abs(step[i]).max() < tolerance)
                continue
            best[i] = loss
            curve, slope = G.unpacked(found[i][: -k - 1]) + np.diag(penalty[i]), found[i][-k - 1 : -1] - penalty[i] * weights[i]
            step[i] = np.linalg.lstsq(curve, slope, rcond=1e-12)[0]
            weights[i] = weights[i] + step[i]
            settled[i] = bool(np.abs(step[i]).max() <= tolerance * max(1.0, np.abs(weights[i]).max()))
    rows.unpersist()
    return weights


def held_out_scores(df: DataFrame, vector: str, size: int, label: str, fold: str, models: list[Model], weights: list[np.ndarray], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(``keep``, fold, model, pos, score) of each row for each model whose left-out fold it is in: the log odds, to nine digits."""
    table = np.array([m.plain(w, size) for m, w in zip(models, weights, strict=True)]).T
    held, names = np.array([m.held for m in models]), pa.array([m.name for m in models])
    rows = df.select(*keep, F.col(fold).cast("long").alias("fold"), (F.col(label) == 1).alias("pos"), F.col(vector).cast("array<double>").alias("v")).dropna(subset=["fold", "pos", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = len(batch.columns)
            x, folds = G.matrix(batch.column(n - 1), size), np.asarray(batch.column(n - 3))
            scores = np.round(x @ table[1:] + table[0], 9)
            row, model = np.nonzero(folds[:, None] == held[None, :])
            kept = pa.Table.from_batches([batch]).drop_columns(["v"]).take(pa.array(row))
            kept = kept.append_column("model", names.take(pa.array(model))).append_column("score", pa.array(scores[row, model]))
            yield from kept.to_batches()

    schema = T.StructType([*rows.drop("v").schema.fields, T.StructField("model", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def held_out_metrics(scores: DataFrame, by: list[str] = ["model"]) -> DataFrame:  # noqa: B006
    """(``by``, n, accuracy, f1, auc) of held-out scores; a score above 0 is a 1."""
    return held_out_hits(scores, by).join(M.auc(scores, "score", "pos", by), by)


def held_out_hits(scores: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, n, accuracy, f1): what a count of the scores above 0 tells, without an order of all scores."""
    up, pos = F.col("score") > 0, F.col("pos")
    hit = lambda c: F.count_if(c).cast("double")
    f1 = M.f1(hit(pos & up), hit(~pos & up), hit(pos & ~up))
    return scores.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg((pos == up).cast("double")), 6).alias("accuracy"), F.round(f1, 6).alias("f1"))


def with_confounds(df: DataFrame, vector: str, numbers: list[Column], categories: list[Column], name: str = "features") -> tuple[DataFrame, int, int]:
    """(``df`` with ``name``, the vectors' size, the count of confounds): standardised ``numbers``, an indicator for each value of each of ``categories``, then the vector.

    Rows without a whole vector, or with a null number or category, are left out. The values of a category reach the driver:
    up to 1,000, more are an error.
    """
    df, size = G.whole_vectors(df, vector)
    cols = {f"_c{i}": c.cast("double") for i, c in enumerate(numbers)} | {f"_k{i}": c for i, c in enumerate(categories)}
    rows = df.withColumns(cols).dropna(subset=list(cols))
    stats = rows.agg(*[f(f"_c{i}").alias(f"{n}{i}") for i in range(len(numbers)) for n, f in (("mu", F.avg), ("sd", F.stddev_pop))], F.count("*").alias("n")).first()
    z = [(F.col(f"_c{i}") - (stats[f"mu{i}"] or 0.0)) / (stats[f"sd{i}"] or 1.0) for i in range(len(numbers))]
    for i in range(len(categories)):
        values = [r[0] for r in rows.select(f"_k{i}").distinct().limit(1001).collect()]
        if len(values) > 1000:
            raise ValueError("a category has more than 1,000 values")
        z += [(F.col(f"_k{i}") == v).cast("double") for v in sorted(values)]
    return rows.withColumn(name, F.concat(F.array(*z), F.col(vector).cast("array<double>"))).drop(*cols), size, len(z)


def control_matrices(df: DataFrame, vector: str, size: int, confounds: int, fold: str) -> dict[int, np.ndarray]:
    """For each fold, (1 + confounds) x rest: the least-squares fit, least in norm, on the other folds' rows of what follows the first ``confounds`` components of ``vector`` on those and one.

    One scan adds joint moments up by fold; a fit is on the sum of the others. A fold that is the only one is fitted on nothing, so its matrix is zero.
    """
    sums, k = G.gram(df, vector, size, [], F.col(fold)), confounds + 1
    total = sum(sums.values(), np.zeros((size + 1,) * 2))
    return {f: np.linalg.pinv(total[:k, :k] - own[:k, :k], rcond=1e-12, hermitian=True) @ (total[:k, k:] - own[:k, k:]) for f, own in sums.items()}


def controlling(matrix: np.ndarray) -> np.ndarray:
    """What takes one and the vector to its components behind the confounds, less what ``matrix`` tells of them."""
    return np.vstack([-matrix, np.eye(matrix.shape[1])])


def moved(df: DataFrame, vector: str, size: int, matrix: np.ndarray) -> DataFrame:
    """``df`` with ``vector`` replaced by one and itself times ``matrix``, applied to whole batches; rows without a vector keep none.

    The matrix goes to the tasks with the plan's function: 8 * (1 + size) * columns bytes.
    """
    kept, at = df.columns, df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            there = np.asarray(column.is_valid())
            out = matrix[0] + G.matrix(column.drop_null(), size) @ matrix[1:]
            offsets = np.concatenate([[0], np.cumsum(there)]) * matrix.shape[1]
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out.ravel()), mask=pa.array(~there))
            yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(batch.columns)], names=kept)

    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if i == at else f for i, f in enumerate(df.schema.fields)])
    return df.withColumn(vector, F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def controlled_probes(df: DataFrame, vector: str, size: int, confounds: int, label: str, fold: str, held: list[int], strength: float = 1.0) -> DataFrame:
    """(model, fold, n, accuracy, f1, auc): for each of ``held`` a probe of the vector behind the confounds, trained on the other folds and tested on it, as it is (raw) and controlled by a fit on the same training rows.

    All probes are fitted together. ``vector`` begins with the confounds.
    """
    matrices = control_matrices(df, vector, size, confounds, fold)
    models = [m for h in held if h in matrices for m in (Model("raw", h, list(range(confounds, size))), Model("controlled", h, matrix=controlling(matrices[h])))]
    weights = fit_logistic(df, vector, size, label, fold, models, strength)
    return held_out_metrics(held_out_scores(df, vector, size, label, fold, models, weights), ["model", "fold"])


def confound_report(df: DataFrame, label: str, fold: str, held: int, numbers: dict[str, Column], categories: dict[str, Column], vector: str, base: str, least: int = 20) -> DataFrame:
    """One row: how well a label is told on the held-out fold by each of ``numbers`` alone, by all confounds, by the ``base`` vector, by ``vector``, and by that with the confounds.

    n, majority (the larger class's share of all rows), <number>_only, confounds_only, base_probe, vector_probe, both_probe (accuracies),
    beats_confounds_by, beats_base_by (three places) and a verdict: whether the vector tells more than surface confounds and the base do. All are fitted together,
    a scan a step. Fewer than ``least`` rows, or one class: no probes, and the verdict says so.
    """
    rows = df.where(F.col(label).isin(0, 1))
    rows, base_size = G.whole_vectors(rows, base)
    rows, size, k = with_confounds(rows.withColumn("_both", F.concat(F.col(base).cast("array<double>"), F.col(vector).cast("array<double>"))), "_both", list(numbers.values()), list(categories.values()), "_x")
    raw = F.array(*[c.cast("double") for c in numbers.values()])
    rows = rows.withColumn("_x", F.concat(raw, "_x"))
    r, whole = len(numbers), len(numbers) + k + size
    n, ones = rows.agg(F.count("*"), F.sum(F.col(label).cast("double"))).first()
    confounds, front = list(range(r, r + k)), r + k + base_size
    arms = {f"{name}_only": [i] for i, name in enumerate(numbers)} | {
        "confounds_only": confounds, "base_probe": list(range(r + k, front)), "vector_probe": list(range(front, whole)), "both_probe": confounds + list(range(front, whole)),
    }
    names = [f"{name} double" for name in arms]
    schema = f"n long, majority double, {', '.join(names)}, beats_confounds_by double, beats_base_by double, verdict string"
    if n < least or not 0 < ones < n:
        return df.sparkSession.createDataFrame([(n, None, *[None] * len(arms), None, None, "not enough rows of both classes")], schema)
    models = [Model(name, held, columns) for name, columns in arms.items()]
    scores = held_out_scores(rows, "_x", whole, label, fold, models, fit_logistic(rows, "_x", whole, label, fold, models))
    found = scores.groupBy("model").agg(F.avg((F.col("pos") == (F.col("score") > 0)).cast("double")).alias("a"))
    row = found.agg(*[F.max(F.when(F.col("model") == name, F.col("a"))).alias(name) for name in arms])  # a row an arm
    over, above = F.col("vector_probe") - F.col("confounds_only"), F.col("vector_probe") - F.col("base_probe")
    verdict = F.when((F.round(over, 3) > 0.02) & (F.round(above, 3) > 0), "the vector tells more than confounds and base").when(over.isNotNull(), "largely told by confounds or base")
    return row.select(
        F.lit(n).cast("long").alias("n"), F.lit(round(max(ones, n - ones) / n, 6)).alias("majority"), *[F.round(name, 6).alias(name) for name in arms],
        F.round(over, 3).alias("beats_confounds_by"), F.round(above, 3).alias("beats_base_by"), F.coalesce(verdict, F.lit("no row in the held-out fold")).alias("verdict"),
    )


def leave_one_out(df: DataFrame, vector: str, size: int, confounds: int, label: str, group: str, least: int = 5) -> DataFrame:
    """(``group``, n, raw_auc, controlled_auc) of each group tested by probes trained on the others, as the vectors are and controlled for confounds by a fit on the same rows.

    A group with fewer than ``least`` rows of a class, in it or of 1 in the others, is left out. Groups are few: a model each; up to 1,000.
    """
    one = F.count_if(F.col(label) == 1)
    counts = df.where(F.col(group).isNotNull() & F.col(label).isin(0, 1)).groupBy(group).agg(one.alias("ones"), F.count("*").alias("n")).orderBy(group).limit(1001).collect()
    if len(counts) > 1000:
        raise ValueError(f"{group} has more than 1,000 values")
    ones = sum(r["ones"] for r in counts)
    held = [i for i, r in enumerate(counts) if min(r["ones"], r["n"] - r["ones"], ones - r["ones"]) >= least]
    number = F.lit(None).cast("int")
    for i, r in enumerate(counts):
        number = F.when(F.col(group) == r[group], i).otherwise(number)
    rows = df.where(F.col(label).isin(0, 1)).withColumn("_group", number)
    found = controlled_probes(rows, vector, size, confounds, label, "_group", held) if held else None
    kind = df.select(group).schema.fields[0]
    names = df.sparkSession.createDataFrame([(i, r[group]) for i, r in enumerate(counts) if i in held], T.StructType([T.StructField("fold", T.LongType()), T.StructField(group, kind.dataType)]))
    if found is None:
        return names.select(group, F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("raw_auc"), F.lit(None).cast("double").alias("controlled_auc"))
    arm = lambda name: F.max(F.when(F.col("model") == name, F.col("auc"))).alias(f"{name}_auc")
    return found.join(F.broadcast(names), "fold").groupBy(group).agg(F.max("n").alias("n"), arm("raw"), arm("controlled"))


def score_panel(steps: DataFrame, records: DataFrame, label: str, fold: str, held: int, numbers: list[Column], categories: list[Column], least: int = 20) -> DataFrame:
    """(model, arm, n, gate, raw_f1, controlled_f1, delta_f1, raw_auc, controlled_auc, note): every scorer under the same control for confounds, its arms ``min`` and ``mean``.

    ``steps`` has model, id, score (1: right) and label (1: the error); an arm is one less the least or the mean score of an id's steps. ``records`` has id, ``label``, ``fold`` and
    what the confounds are made of; ids in both count. The gate is the AUC of low scores against error steps. F1 is that of a probe of the one number, the AUC that of
    the number itself, on the fold ``held``; controlled is less a fit of the confounds on the other folds. A model with fewer than ``least`` ids has a row that says so, as has one
    whose gate is 0.55 or less. Models are few: one fit each.
    """
    chains = steps.groupBy("model", "id").agg((1 - F.min("score")).alias("_min"), (1 - F.avg("score")).alias("_mean"))
    joined = written(chains.join(records, "id").where(F.col(label).isin(0, 1)))  # read by every fit
    gates = {r["model"]: r["auc"] for r in M.auc(steps.withColumn("_low", -F.col("score")).withColumn("_bad", F.col("label") == 1), "_low", "_bad", ["model"]).collect()}
    counts = {r["model"]: r["n"] for r in joined.groupBy("model").agg(F.count("*").alias("n")).collect()}
    out = []
    for model in sorted(gates, key=str):
        n = counts.get(model, 0)
        if n < least:
            out.append((model, None, n, gates[model], *[None] * 5, f"scorer failed: {n} scored"))
            continue
        rows, size, k = with_confounds(joined.where(F.col("model").eqNullSafe(model)).withColumn("_v", F.array("_min", "_mean")), "_v", numbers, categories, "_x")
        rows = rows.drop("model").persist()
        matrix = control_matrices(rows, "_x", size + k, k, fold).get(held, np.zeros((k + 1, size)))
        residual = controlling(matrix)
        arms = [("raw", "min", Model("raw min", held, [k])), ("raw", "mean", Model("raw mean", held, [k + 1]))]
        arms += [("controlled", arm, Model(f"controlled {arm}", held, matrix=residual[:, [i]])) for i, arm in enumerate(("min", "mean"))]
        models = [m for _, _, m in arms]
        fitted = fit_logistic(rows, "_x", size + k, label, fold, models)
        f1 = {r["model"]: r["f1"] for r in held_out_hits(held_out_scores(rows, "_x", size + k, label, fold, models, fitted), ["model"]).collect()}
        itself = held_out_scores(rows, "_x", size + k, label, fold, models, [np.array([0.0, 1.0])] * 4)
        auc = {r["model"]: r["auc"] for r in M.auc(itself, "score", "pos", ["model"]).collect()}
        rows.unpersist()
        note = None if (gates[model] or 0) > 0.55 else "gate failed: do not report"
        for arm in ("min", "mean"):
            raw, ctl = f1.get(f"raw {arm}"), f1.get(f"controlled {arm}")
            delta = None if raw is None or ctl is None else round(ctl - raw, 6)
            out.append((model, arm, n, gates[model], raw, ctl, delta, auc.get(f"raw {arm}"), auc.get(f"controlled {arm}"), note))
    kind = steps.schema["model"].dataType.simpleString()
    return steps.sparkSession.createDataFrame(out, f"model {kind}, arm string, n long, gate double, raw_f1 double, controlled_f1 double, delta_f1 double, raw_auc double, controlled_auc double, note string")


def over_control(df: DataFrame, vector: str, numbers: list[Column], categories: list[Column], label: str, fold: str, held: list[int]) -> DataFrame:
    """(fold, raw_auc, without_auc, with_auc, delta): held-out AUC as it is, controlled for ``numbers``, and for ``categories`` too; delta is what the categories take away."""
    arm = lambda name, alias: F.max(F.when(F.col("model") == name, F.col("auc"))).alias(alias)
    found = []
    for name, of in (("without_auc", []), ("with_auc", categories)):
        rows, size, k = with_confounds(df, vector, numbers, of, "_x")
        found.append(controlled_probes(rows, "_x", size + k, k, label, fold, held).groupBy("fold").agg(arm("raw", f"raw_{name}"), arm("controlled", name)))
    both = found[0].join(found[1], "fold")
    return both.select("fold", F.col("raw_without_auc").alias("raw_auc"), "without_auc", "with_auc", F.round(F.col("with_auc") - F.col("without_auc"), 6).alias("delta"))


def stratified_probe(df: DataFrame, vector: str, label: str, key: Column, share: float = 0.8, seed: int = 42) -> DataFrame:
    """(n, accuracy, f1, macro_f1, auc): a probe trained on exactly floor(share * n) rows of each class, the first in hash order, tested on the others."""
    from lodestep.operators.panel import stratified_split

    rows, size = G.whole_vectors(df.where(F.col(label).isin(0, 1)).withColumn("_key", key), vector)
    rows = stratified_split(rows, "_key", label, seed, share).withColumn("_fold", F.when(F.col("is_train"), 1).otherwise(0))
    models = [Model("all", 0, list(range(size)))]
    scores = held_out_scores(rows, vector, size, label, "_fold", models, fit_logistic(rows, vector, size, label, "_fold", models))
    up, pos = F.col("score") > 0, F.col("pos")
    hit = lambda c: F.count_if(c).cast("double")
    macro = (M.f1(hit(pos & up), hit(~pos & up), hit(pos & ~up)) + M.f1(hit(~pos & ~up), hit(pos & ~up), hit(~pos & up))) / 2
    return held_out_metrics(scores).join(scores.groupBy("model").agg(F.round(macro, 6).alias("macro_f1")), "model").select("n", "accuracy", "f1", "macro_f1", "auc")
