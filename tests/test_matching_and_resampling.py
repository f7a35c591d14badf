"""Matching, bootstraps and weighted draws against plain Python and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestep.operators import matching as K
from lodestep.operators import resampling as R

SCHEMA = "id long, pos boolean, g int, near double"


def largest(a, b, width):
    """The size of a largest matching, by augmenting paths."""
    near = {i: [j for j, y in enumerate(b) if abs(x - y) <= width] for i, x in enumerate(a)}
    taken = {}

    def place(i, seen):
        for j in near[i]:
            if j not in seen:
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(a)))


@pytest.mark.parametrize("each,pile", [(50_000, 100_000), (30, 3)])
def test_matching_is_largest_and_within_the_width(spark, each, pile):
    rng = np.random.default_rng(5)
    rows = [(i, bool(rng.uniform() < 0.4), int(rng.integers(0, 4)) if i % 50 else None, float(np.round(rng.uniform(0, 3), 2 if i % 3 else 1))) for i in range(500)]
    rows += [(1000 + i, bool(i % 3 == 0), 7, 0.5) for i in range(60)] + [(2000 + i, True, 8, i / 7) for i in range(40)] + [(2100, False, 8, 5.72)]
    rows += [(900, True, 0, None), (901, None, 0, 1.0), (902, False, 9, float("nan")), (903, True, 9, float("inf")), (904, False, 9, 1.0)]
    near = {r[0]: r for r in rows}
    got = K.matched(spark.createDataFrame(rows, SCHEMA).repartition(5), "id", "pos", ["g"], "near", 0.1, each, pile).collect()
    used = [k for r in got for k in (r.a_key, r.b_key)]
    assert len(used) == len(set(used))
    for r in got:
        a, b = near[r.a_key], near[r.b_key]
        assert a[1] is False and b[1] is True and a[2] == b[2] == r.g and abs(a[3] - b[3]) <= 0.1
    for g in range(10):
        own = [r for r in rows if r[2] == g and r[1] is not None and r[3] is not None and np.isfinite(r[3])]
        assert sum(r.g == g for r in got) == largest([r[3] for r in own if not r[1]], [r[3] for r in own if r[1]], 0.1), g


def test_matching_without_groups_goes_over_many_ranges(spark):
    rng = np.random.default_rng(6)
    # Long runs of one class, so that many wait at the end of a range.
    rows = [(i, bool((i // 4) % 2), 0, float(x)) for i, x in enumerate(np.sort(rng.uniform(0, 4, 400)))]
    got = K.matched(spark.createDataFrame(rows, SCHEMA), "id", "pos", [], "near", 0.05, each=40).collect()
    assert got and len(got) == largest([r[3] for r in rows if not r[1]], [r[3] for r in rows if r[1]], 0.05)
    assert all(abs(rows[r.a_key][3] - rows[r.b_key][3]) <= 0.05 for r in got)
    assert K.matched(spark.createDataFrame([], SCHEMA), "id", "pos", ["g"], "near", 0.1).count() == 0


def test_pairs_that_bands_lost_are_found(spark):
    rows = [(1, False, 0, 0.04), (2, True, 0, 0.13)]
    assert K.matched(spark.createDataFrame(rows, SCHEMA), "id", "pos", ["g"], "near", 0.1).collect()[0].a_key == 1


def plain_poisson(key, draw, seed):
    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    u = mixed(key % 2**64 ^ mixed(((draw + 1) * 0x9E3779B97F4A7C15 + seed) % 2**64)) >> 32
    chance, term, k = np.exp(-1.0), np.exp(-1.0), 0
    while u >= np.floor(chance * 2**32) and k < 13:
        k += 1
        term /= k
        chance += term
    return k


def test_poisson_sums_equal_plain_resamples_of_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 40)) if i else None, float(rng.normal()), bool(rng.uniform() < 0.5)) for i in range(300)] + [(5, None, True)]
    df = spark.createDataFrame(rows, "k long, x double, hit boolean").repartition(4)
    got = R.poisson_sums(df, F.col("k"), [F.col("x"), F.col("hit").cast("double")], 300, 11, block=64)
    keys = {r.k: r.h for r in df.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    sums = {k: np.array([sum(x or 0 for q, x, _ in rows if q == k), sum(t for q, _, t in rows if q == k)]) for k in keys}
    assert np.allclose(got[0], sum(sums.values()))
    for draw in (0, 1, 63, 64, 299):
        assert np.allclose(got[1 + draw], sum(plain_poisson(h, draw, 11) * sums[k] for k, h in keys.items()))
    w = R.poisson_weights(np.arange(4000).view(np.int64) * 7919, np.arange(50), 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.max() < 13
    assert not R.poisson_sums(df.limit(0), F.col("k"), [F.col("x")], 5, 1).any()


def test_ten_thousand_draws_give_the_interval_of_a_plain_bootstrap(spark):
    rng = np.random.default_rng(8)
    pos, up = rng.uniform(size=400) < 0.4, rng.uniform(size=400) < 0.5
    df = spark.createDataFrame([(i, bool(p), bool(u)) for i, (p, u) in enumerate(zip(pos, up))], "k long, p boolean, u boolean")
    cells = [F.col("p") & F.col("u"), ~F.col("p") & F.col("u"), F.col("p") & ~F.col("u")]
    sums = R.poisson_sums(df, F.col("k"), [c.cast("double") for c in cells], 10_000, 2)
    r = R.intervals(spark, sums, {"f1": lambda s: R.f1_of(s[:, 0], s[:, 1], s[:, 2])}).first()
    f1 = lambda i: 2 * (pos[i] & up[i]).sum() / (2 * (pos[i] & up[i]).sum() + (pos[i] ^ up[i]).sum())
    plain = np.percentile([f1(rng.integers(0, 400, 400)) for _ in range(4000)], [2.5, 97.5])
    assert r.value == pytest.approx(f1(np.arange(400)), abs=1e-6) and (r.lo, r.hi) == pytest.approx(plain, abs=0.02) and r.significant


def test_weighted_epoch_draws_as_many_as_rows_in_proportion(spark):
    n = 4000
    weights = [0.0 if i % 10 == 0 else float(i % 4 + 1) for i in range(n)]
    rows = [(i, w) for i, w in enumerate(weights)] + [(n, None), (n + 1, -1.0), (n + 2, float("nan")), (n + 3, float("inf"))]
    df = spark.createDataFrame(rows, "k long, w double")
    got = {r.k: r.times for r in R.weighted_epoch(df.repartition(3), "k", "w", None, 5, each=300).collect()}
    again = {r.k: r.times for r in R.weighted_epoch(df.repartition(7), "k", "w", None, 5, each=300).collect()}
    assert got == again and sum(got.values()) == len(rows) and all(weights[k] > 0 for k in got)
    total = sum(weights)
    for level in (1, 2, 3, 4):
        own = [i for i in range(n) if weights[i] == level]
        want = len(rows) * level * len(own) / total
        assert abs(sum(got.get(i, 0) for i in own) - want) < 5 * want**0.5
    assert {r.k: r.times for r in R.weighted_epoch(df, "k", "w", 0, 5).collect()} == {} == {r.k: r.times for r in R.weighted_epoch(df.where("k = 0"), "k", "w", 9).collect()}


def test_judge_gap_equals_fits_on_the_rows(spark):
    rng = np.random.default_rng(12)
    n = 300
    a, b = rng.integers(0, 5, n).astype(float), rng.integers(0, 3, n).astype(float)
    human, judge = (rng.uniform(size=n) < 0.5).astype(int), (rng.uniform(size=n) < 1 / (1 + np.exp(3 - 1.5 * a))).astype(int)
    rows = [(float(x), float(y), int(h), int(j)) for x, y, h, j in zip(a, b, human, judge)] + [(1.0, None, 1, 1)]
    r = R.judge_gap(spark.createDataFrame(rows, "a double, b double, h int, j int").repartition(3), ["a", "b"], "h", "j", 300, 4).first()
    x = np.column_stack([np.ones(n), (a - a.mean()) / a.std(), (b - b.mean()) / b.std()])

    def auc(y, rows):
        w, z = np.zeros(3), x[rows]
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            w = w + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([0, 1, 1]), z.T @ (y[rows] - p) - w * [0, 1, 1])
        s, pos = np.round(z @ w, 9), y[rows] == 1
        return ((s[pos][:, None] > s[~pos]).sum() + 0.5 * (s[pos][:, None] == s[~pos]).sum()) / (pos.sum() * (~pos).sum())

    everyone = np.arange(n)
    assert r.n == n and r.human_auc == pytest.approx(auc(human, everyone), abs=1e-5) and r.judge_auc == pytest.approx(auc(judge, everyone), abs=1e-5)
    assert r.gap == pytest.approx(r.judge_auc - r.human_auc, abs=2e-6) and r.significant
    plain = [auc(judge, i) - auc(human, i) for i in (rng.integers(0, n, n) for _ in range(300))]
    assert (r.lo, r.hi) == pytest.approx(np.percentile(plain, [2.5, 97.5]), abs=0.05)
    assert R.judge_gap(spark.createDataFrame([], "a double, h int, j int"), ["a"], "h", "j", 5).first().n == 0
