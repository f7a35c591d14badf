"""Cross-fitted control, directions, erasure and matching against plain numpy and Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestep.operators import confound as C
from lodestep.operators import controls as K
from lodestep.operators import corrupt as X

SCHEMA = "id long, v array<double>, y double, z double"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    y, z = rng.normal(size=300), rng.integers(0, 2, 300).astype(float)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + np.outer(y, [2, 1, 0, 0, 0, 1]) + np.outer(z, [0, 0, 3, 1, 0, 0]) + 5
    return x, y, z


@pytest.fixture(scope="module")
def vectors(spark, data):
    x, y, z = data
    rows = [(i, x[i].tolist(), float(y[i]), float(z[i])) for i in range(len(x))]
    return spark.createDataFrame([*rows, (900, None, 1.0, 1.0), (901, x[0].tolist(), None, 1.0)], SCHEMA).repartition(5)


def collected(df, column, n):
    found = {r.id: r[0] for r in df.select(column.alias("out"), "id").where(f"id < {n}").collect()}
    return np.array([found[i] for i in range(n)])


def pls_weights(x, y, k):
    """Partial least squares of one target by deflating the data themselves."""
    x, y, out = x - x.mean(0), y - y.mean(), []
    for _ in range(k):
        w = x.T @ y / np.linalg.norm(x.T @ y)
        t = x @ w
        x = x - np.outer(t, x.T @ t / (t @ t))
        out.append(w)
    return np.array(out).T


def test_moments_and_directions_equal_those_of_the_rows(vectors, data):
    x, y, z = data
    mean, covariance, cross, spread = K.vector_moments(vectors, "v", ["y", "z"])
    assert np.allclose(mean, x.mean(0)) and np.allclose(covariance, np.cov(x.T, bias=True)) and np.allclose(spread, [y.var(), z.var()])
    assert np.allclose(cross[:, 0], ((x - x.mean(0)) * (y - y.mean())[:, None]).mean(0))
    for k in (1, 3):
        got, want = K.pls_directions(covariance, cross[:, :1], k), np.linalg.qr(pls_weights(x, y, k))[0]
        assert np.allclose(got @ got.T, want @ want.T) and np.allclose(got.T @ got, np.eye(k))
    assert K.pls_directions(covariance, np.zeros((6, 1)), 2).shape == (6, 0)


def test_ablation_erasure_and_what_is_kept(vectors, data):
    x, y, z = data
    mean, covariance, cross, _ = K.vector_moments(vectors, "v", ["y", "z"])
    basis, kept = K.pls_directions(covariance, cross[:, :1], 2), K.pls_directions(covariance, cross[:, 1:], 2)
    plain = x - x @ basis @ basis.T
    assert np.allclose(collected(vectors, K.ablated(F.col("v"), basis), 300), plain)
    part = collected(vectors, K.oblique(F.col("v"), basis, kept), 300)
    assert np.allclose(part, plain + (x - plain) @ kept @ kept.T) and np.allclose(part @ kept, x @ kept)
    out = collected(vectors, K.erased(F.col("v"), mean, covariance, cross), 300)
    for target in (y, z):
        assert np.abs((out - out.mean(0)).T @ (target - target.mean())).max() < 1e-2 * np.abs((x - x.mean(0)).T @ (target - target.mean())).max()
    assert np.allclose(out.mean(0), x.mean(0))


def test_no_rows_is_an_error(spark):
    with pytest.raises(ValueError):
        K.vector_moments(spark.createDataFrame([], SCHEMA), "v", ["y"])


@pytest.mark.parametrize("strength", [0.0, 2.0])
def test_crossfit_equals_fits_on_the_other_folds(spark, data, strength):
    x, y, _ = data
    rows = [(i, i % 5, float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, 1, None, 1.0, 1.0)], "id long, fold int, a double, b double, y double")
    out, fit = K.crossfit(df, ["y"], ["a", "b"], "fold", strength)
    got = {r.id: r.y_residual for r in out.collect()}
    f, r2, want = np.arange(300) % 5, [], np.zeros(300)
    for k in range(5):
        t, own = f != k, f == k
        mu, nu = x[t, :2].mean(0), y[t].mean()
        c = x[t, :2] - mu
        b = np.linalg.solve(c.T @ c + strength * np.eye(2), c.T @ (y[t] - nu))
        want[own] = y[own] - nu - (x[own, :2] - mu) @ b
        r2.append(1 - (want[own] ** 2).sum() / ((y[own] - y[own].mean()) ** 2).sum())
    assert np.allclose([got[i] for i in range(300)], want) and got[900] is None
    assert fit["y"] == pytest.approx(np.mean(r2))


def test_fourier_features_approach_the_kernel_and_take_out_a_curve(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform(-2, 2, 400)
    df = spark.createDataFrame([(i, i % 5, float(v), float(v * v)) for i, v in enumerate(a)], "id long, fold int, a double, y double")
    out, names = K.fourier_features(df, ["a"], 400, 0.5, 7)
    r = out.orderBy("id").limit(20).select(*names).collect()
    z = np.array([list(x) for x in r])
    assert np.abs(z @ z.T - np.exp(-0.5 * (a[:20, None] - a[None, :20]) ** 2)).max() < 0.25
    few, names = K.fourier_features(df, ["a"], 24, 0.5, 7)
    assert K.crossfit(few, ["y"], names, "fold", 0.1)[1]["y"] > 0.9 > 0.2 > K.crossfit(df, ["y"], ["a"], "fold")[1]["y"]


def test_matched_pairs_meet_over_borders_once_each(spark):
    rng = np.random.default_rng(5)
    rows = [(i, bool(i % 2), int(rng.integers(0, 3)), float(rng.uniform(0, 2))) for i in range(200)] + [(900, True, 0, None), (901, None, 0, 1.0), (902, False, None, 1.0)]
    rows += [(1000, True, 9, 0.0999), (1001, False, 9, 0.1001)]
    near = {r[0]: r for r in rows}
    got = K.matched(spark.createDataFrame(rows, "id long, pos boolean, g int, near double"), "id", "pos", ["g"], "near", 0.1).collect()
    used = [k for r in got for k in (r.a_key, r.b_key)]
    assert len(used) == len(set(used)) and (1001, 1000) in {(r.a_key, r.b_key) for r in got}
    assert all(near[r.a_key][1] is False and near[r.b_key][1] is True and near[r.a_key][2] == near[r.b_key][2] == r.g for r in got)
    assert all(abs(near[r.a_key][3] - near[r.b_key][3]) <= 0.1 for r in got)
    for turn in (0.0, 0.05):  # no band of either round has both classes left
        left = [r for k, r in near.items() if k not in used and None not in r]
        cells = {}
        for r in left:
            cells.setdefault((r[2], int((r[3] + turn) // 0.1)), set()).add(r[1])
        assert all(len(c) == 1 for c in cells.values())


def test_gap_interval_holds_the_gap(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(rng.normal(1.0 if e else 0.0)), bool(e)) for g in range(400) for e in (0, 1, 1)] + [(500, 9.0, True), (501, None, True)]
    r = K.gap_interval(spark.createDataFrame(rows, "g long, v double, e boolean"), "g", "v", "e", 300, 5).first()
    plain = np.mean([v for g, v, e in rows if e and g < 500]) - np.mean([v for g, v, e in rows if not e])
    assert r.groups == 400 and r.gap == pytest.approx(plain, abs=1e-6) and r.lo < plain < r.hi and r.excludes_zero
    none = K.gap_interval(spark.createDataFrame([], "g long, v double, e boolean"), "g", "v", "e", 10, 5).first()
    assert none.gap is None and none.lo is None


def test_step_modes(spark):
    steps = spark.createDataFrame([(k, [f"s{i}" for i in range(n)]) for k, n in enumerate((2, 3, 3, 4, 6, 9))], "k long, steps array<string>")
    for r in steps.select("k", "steps", *[X.step_corruption(F.col("steps"), F.col("k"), mode=m, inserted=("new",)).alias(m) for m in ("delete", "shuffle", "insert")]).collect():
        if len(r.steps) < 3:
            assert r.delete == r.shuffle == r.insert == r.steps
            continue
        assert len(r.delete) == len(r.steps) - 1 and r.delete[0] == "s0" and r.delete[-1] == r.steps[-1]
        assert r.shuffle != r.steps and sorted(r.shuffle) == sorted(r.steps)
        at = r.insert.index("new")
        assert [x for x in r.insert if x != "new"] == r.steps and 1 <= at <= len(r.steps) - 2


def test_probe_tells_a_label_from_a_confound(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=400)
    df = spark.createDataFrame([(i % 5, int(v[i] + rng.normal() > 0), [float(v[i])]) for i in range(400)], "fold int, label int, v array<double>")
    assert C.probe(df, "v", "label", F.col("fold") != 0).first().auc > 0.7


def test_every_kind_of_damage_applies_where_it_has_a_site(spark):
    sites, none = ["Let x > 0 be a real number.", "By equation (1) and step 2, x = 3.", "Since n is an integer, from (1) we get y = 4."], ["plain"]
    df = spark.createDataFrame([(1, sites), (2, none)], "k long, steps array<string>")
    hits = {r.k: r for r in df.select("k", *[X.apply_damage(F.col("steps"), kind, F.col("k")).isNotNull().alias(kind) for kind in X.DAMAGES]).collect()}
    assert all(hits[1][kind] for kind in X.DAMAGES) and not any(hits[2][kind] for kind in X.DAMAGES)
