"""Tree sums, many logistic fits at once, control of vectors and ranks over ranges, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestep.operators import metrics as M
from lodestep.operators import moments as G
from lodestep.operators import probes as P

SCHEMA = "id long, v array<double>, a double, b double, c string, y int, fold int, base array<double>"


def plain_fit(x, y, strength=1.0):
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([0.0, *[strength] * (x.shape[1] - 1)])
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + 0.5 * np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-12 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
    return w


def plain_auc(score, pos):
    above = (score[pos][:, None] > score[~pos][None]).sum() + 0.5 * (score[pos][:, None] == score[~pos][None]).sum()
    return above / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    n = 260
    a, b, c = rng.normal(3, 2, n), rng.uniform(size=n), rng.integers(0, 3, n)
    v = rng.normal(size=(n, 5)) + np.outer(a, [1, 0, 0.5, 0, 0]) + np.outer(c, [0, 1, 0, 0, 0])
    y = (v[:, 0] + 0.5 * v[:, 3] + rng.normal(size=n) > 3).astype(int)
    base = rng.normal(size=(n, 2)) + np.outer(y, [0.5, 0])
    return a, b, c, v, y, np.arange(n) % 5, base


@pytest.fixture(scope="module")
def table(spark, data):
    a, b, c, v, y, fold, base = data
    rows = [(i, v[i].tolist(), float(a[i]), float(b[i]), f"k{c[i]}", int(y[i]), int(fold[i]), base[i].tolist()) for i in range(len(a))]
    odd = [(900, None, 1.0, 1.0, "k0", 1, 1, [0.0, 0.0]), (901, [1.0, None, 0.0, 0.0, 0.0], 1.0, 1.0, "k0", 1, 1, [0.0, 0.0]), (902, v[0].tolist(), None, 1.0, "k0", 1, 2, [0.0, 0.0]), (903, v[0].tolist(), 1.0, 1.0, "k0", None, 2, [0.0, 0.0])]
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(5)


def confounds(data, scaled=True):
    a, b, c, *_ = data
    z = [(x - x.mean()) / x.std() for x in (a, b)]
    return np.column_stack([*z, *[(c == k).astype(float) for k in range(3)]])


def test_tree_sum_adds_pieces_of_any_length(spark):
    def fold(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield x % 3, np.full(2 * G.PIECE + 7, float(x))

    got = G.tree_sum(spark.range(40, numPartitions=20), fold)
    assert sorted(got) == [0, 1, 2] and all(len(t) == 2 * G.PIECE + 7 and (t == sum(x for x in range(40) if x % 3 == k)).all() for k, t in got.items())
    assert G.tree_sum(spark.range(0), fold) == {}


def test_whole_vectors_refuses_unlike_lengths_and_drops_holes(spark):
    some = spark.createDataFrame([([1.0, 2.0],), ([1.0, None],), ([float("nan"), 1.0],), (None,), ([float("inf"), 0.0],)], "v array<double>")
    rows, size = G.whole_vectors(some, "v")
    assert size == 2 and rows.count() == 1
    for bad in ([([1.0, 2.0],), ([1.0],)], []):
        with pytest.raises(ValueError):
            G.whole_vectors(spark.createDataFrame(bad, "v array<double>"), "v")


def test_models_fitted_together_equal_single_fits(table, data):
    *_, v, y, fold, _ = data
    rows, size = G.whole_vectors(table.where("id < 900"), "v")
    matrix = np.random.default_rng(1).normal(size=(6, 2))
    models = [P.Model("one", 0, [3]), P.Model("all", 1, [0, 1, 2, 3, 4]), P.Model("some", 9, [4, 0]), P.Model("made", 2, matrix=matrix)]
    got = P.fit_logistic(rows, "v", size, "y", "fold", models)
    for m, w in zip(models, got):
        x = np.column_stack([np.ones(len(v)), v]) @ matrix if m.matrix is not None else v[:, m.columns]
        assert np.allclose(w, plain_fit(x[fold != m.held], y[fold != m.held]), atol=1e-6), m.name
    scores = P.held_out_scores(rows, "v", size, "y", "fold", models, got, ["id"]).collect()
    assert {r.model for r in scores} == {"one", "all", "made"} and len(scores) == 3 * 52
    for r in scores:
        if r.model == "made":
            w = got[3]
            assert r.fold == 2 and r.score == pytest.approx(w[0] + np.array([1, *v[r.id]]) @ matrix @ w[1:], abs=1e-7)
    found = {r.model: r for r in P.held_out_metrics(P.held_out_scores(rows, "v", size, "y", "fold", models, got)).collect()}
    s, own = v[fold == 1] @ got[1][1:] + got[1][0], y[fold == 1] == 1
    assert found["all"].auc == pytest.approx(plain_auc(s, own), abs=1e-6) and found["all"].accuracy == pytest.approx(((s > 0) == own).mean(), abs=1e-6)
    tp, fp, fn = ((s > 0) & own).sum(), ((s > 0) & ~own).sum(), ((s <= 0) & own).sum()
    assert found["all"].f1 == pytest.approx(2 * tp / (2 * tp + fp + fn), abs=1e-6)


def test_control_equals_least_squares_on_the_training_rows(table, data):
    *_, v, y, fold, _ = data
    c = confounds(data)
    rows, size, k = P.with_confounds(table.where("id < 900"), "v", [F.col("a"), F.col("b")], [F.col("c")], "x")
    assert (size, k) == (5, 5)
    ones = np.column_stack([np.ones(len(c)), c])
    found = {(r.model, r.fold): r for r in P.controlled_probes(rows, "x", 10, 5, "y", "fold", [0, 3]).collect()}
    assert set(found) == {(m, f) for m in ("raw", "controlled") for f in (0, 3)}
    for f in (0, 3):
        t = fold != f
        left = v - ones @ np.linalg.lstsq(ones[t], v[t], rcond=None)[0]
        for name, x in (("raw", v), ("controlled", left)):
            w = plain_fit(x[t], y[t])
            s, own = x[~t] @ w[1:] + w[0], y[~t] == 1
            assert found[name, f].auc == pytest.approx(plain_auc(s, own), abs=1e-5) and found[name, f].accuracy == pytest.approx(((s > 0) == own).mean(), abs=1e-6)
    matrix = P.control_matrices(rows, "x", 10, 5, "fold")[3]
    t = fold != 3
    left = v - ones @ np.linalg.lstsq(ones[t], v[t], rcond=None)[0]
    got = {r.id: r.x for r in P.moved(rows.select("id", "x"), "x", 10, P.controlling(matrix)).collect()}
    assert np.allclose([got[i] for i in range(len(v))], left)


def test_moved_keeps_rows_without_a_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 1.0])], "id long, v array<double>").coalesce(1)
    got = {r.id: r.v for r in P.moved(df, "v", 2, np.array([[1.0, 0.0, 0.0], [1.0, 0.0, 2.0], [0.0, 1.0, 0.0]])).collect()}
    assert got == {1: [2.0, 2.0, 2.0], 2: None, 3: [1.0, 1.0, 0.0]}


def test_confound_report_equals_single_fits(table, data):
    a, b, c, v, y, fold, base = data
    r = P.confound_report(table, "y", "fold", 1, {"first": F.col("a"), "second": F.col("b")}, {"c": F.col("c")}, "v", "base").first()
    # Row 903 has no label, 902 no number; both go.
    z, t = confounds(data), fold != 1

    def accuracy(x):
        w = plain_fit(x[t], y[t])
        return ((x[~t] @ w[1:] + w[0] > 0) == (y[~t] == 1)).mean()

    want = {"first_only": a[:, None], "second_only": b[:, None], "confounds_only": z, "base_probe": base, "vector_probe": v, "both_probe": np.column_stack([z, v])}
    for name, x in want.items():
        assert r[name] == pytest.approx(accuracy(x), abs=1e-6), name
    assert r.n == len(y) and r.majority == pytest.approx(max(y.mean(), 1 - y.mean()), abs=1e-6)
    assert r.beats_confounds_by == pytest.approx(accuracy(v) - accuracy(z), abs=1e-3) and r.verdict.startswith("the vector" if r.beats_confounds_by > 0.02 and r.beats_base_by > 0 else "largely")
    few = P.confound_report(table.where("id < 10"), "y", "fold", 1, {"first": F.col("a")}, {"c": F.col("c")}, "v", "base").first()
    assert few.verdict.startswith("not enough") and few.vector_probe is None


def test_leave_one_out_skips_small_classes(table, data):
    *_, v, y, fold, _ = data
    rows, size, k = P.with_confounds(table.where("id < 900"), "v", [F.col("a")], [], "x")
    rows = rows.withColumn("g", F.when(F.col("id") < 4, "tiny").when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    got = {r.g: r for r in P.leave_one_out(rows, "x", size + k, k, "y", "g").collect()}
    assert set(got) == {"even", "odd"}
    ids = np.arange(len(y))
    own = (ids >= 4) & (ids % 2 == 0)
    w = plain_fit(v[~own], y[~own])
    assert got["even"].raw_auc == pytest.approx(plain_auc(v[own] @ w[1:], y[own] == 1), abs=1e-5) and got["even"].n == own.sum()


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_over_ranges_equal_plain_ranks(spark, by, monkeypatch):
    rng = np.random.default_rng(7)
    n = 3000
    score = np.where(rng.uniform(size=n) < 0.3, np.round(rng.normal(size=n), 1), rng.normal(size=n))
    pos, g = rng.uniform(size=n) < 1 / (1 + np.exp(-score)), rng.integers(0, 3, n)
    df = spark.createDataFrame([(float(s), bool(p), int(k) if k else None) for s, p, k in zip(score, pos, g)], "s double, p boolean, g int").repartition(6)
    counts = M.score_counts(df, "s", "p", by)
    parts = M.ranged(counts, "s", by, each=100)
    assert parts.agg(F.max("_range")).first()[0] >= 7
    # Ranges are in the order of scores, and equal scores are in one.
    seen = parts.groupBy(*by, "_range").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).collect()
    for x in seen:
        assert all(y["_range"] <= x["_range"] or y["lo"] > x["hi"] for y in seen if not by or y["g"] == x["g"])
    whole = M.ranged
    monkeypatch.setattr(M, "ranged", lambda c, s, b: whole(c, s, b, each=100))
    auc = {r["g"] if by else 0: r.auc for r in M.auc(df, "s", "p", by).collect()}
    ap = {r["g"] if by else 0: r.average_precision for r in M.average_precision(df, "s", "p", by).collect()}
    for k in (None, 1, 2) if by else (0,):
        own = np.ones(n, bool) if not by else g == (k or 0)
        s, p = score[own], pos[own]
        assert auc[k] == pytest.approx(plain_auc(s, p), abs=2e-6)
        marks = sorted(set(s), reverse=True)
        assert ap[k] == pytest.approx(sum((p & (s == m)).sum() * (p & (s >= m)).sum() / (s >= m).sum() for m in marks) / p.sum(), abs=2e-6)
    assert M.auc(df.limit(0), "s", "p", by).count() == 0


def test_no_window_runs_over_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000 / 3.0).alias("s"), (F.col("id") % 3 == 0).alias("p"))
    for made in (M.auc(df, "s", "p", []), M.average_precision(df, "s", "p", [])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.splitlines() if "Window [" in x]
        assert windows and all("_range" in x.split("]", 1)[1] for x in windows)


def test_hits_are_the_metrics_without_an_order_of_scores(spark):
    rows = [("a", i % 3 == 0, (i * 7 % 11 - 5) / 3) for i in range(60)]
    scores = spark.createDataFrame(rows, "model string, pos boolean, score double")
    whole, hits = P.held_out_metrics(scores).first(), P.held_out_hits(scores, ["model"])
    assert hits.first().asDict() == {k: v for k, v in whole.asDict().items() if k != "auc"}
    assert "Window" not in hits._jdf.queryExecution().analyzed().toString()
