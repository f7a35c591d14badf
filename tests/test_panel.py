"""Panel operators against plain Python."""

import random

from pyspark.sql import functions as F

from lodestep.functions import text as T
from lodestep.operators import corrupt as X
from lodestep.operators import panel as N
from lodestep.operators import sampling as S


def plain_boxed(x):
    if x is None or "\\boxed{" not in x:
        return None
    rest, depth = x.rpartition("\\boxed{")[2], 1
    for i, c in enumerate(rest):
        depth += {"{": 1, "}": -1}.get(c, 0)
        if depth == 0:
            return rest[:i].strip()
    return rest.strip()


def test_last_boxed_balances_at_any_depth(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(["{", "}", "a", " ", "\\boxed{"], k=rng.randrange(40))) for _ in range(300)]
    texts += ["\\boxed{" + "{" * 50 + "x" + "}" * 51 + " tail", r"\boxed{\frac{\sqrt{\frac{a}{b_{c}}}}{d}} is the value. Done", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.b for r in df.select("i", T.last_boxed(F.col("t")).alias("b")).collect()}
    assert got == {i: plain_boxed(t) for i, t in enumerate(texts)}


def test_damage_draws_afresh(spark):
    """A condition that leaves too few words where it is taken out of the first place may be found in another try."""
    steps = F.array(F.lit("if x is positive"), F.lit("the sum is two for all n greater than 3 and then it is done"), F.lit("so we stop here if it holds for every case"))
    df = spark.range(40).select("id", X.apply_damage(steps, "constraint", F.col("id")).alias("d"), X.remove_constraint(steps, F.col("id")).alias("one"))
    found, once = df.where("d is not null").count(), df.where("one is not null").count()
    assert found == 40 > once
    assert {r.operation for r in df.select(X.apply_damage(steps, "structural", F.col("id")).alias("d")).select("d.*").collect()} == {"drop_step", "swap_steps", "duplicate_step"}


def test_kth_least_and_weighted_draws_match_plain_python(spark):
    rng = random.Random(6)
    keys = rng.sample(range(-500, 100_000), 700)
    df = spark.createDataFrame([(k, rng.randrange(0, 5)) for k in keys], "k long, w long").repartition(3)
    for share in (0.8, 0.5, 1.0, 0.0015):
        place = int(700 * share)
        assert [r.last for r in S.kth_least(df, "k", share).collect()] == ([sorted(keys)[place - 1]] if place else [])
    weights = dict(df.collect())
    drawn = [r.k for r in N.weighted_draws(df, "k", "w", 500, 3).collect()]
    assert len(drawn) == 500 and all(weights[k] > 0 for k in drawn)


def test_paired_bootstrap_holds_the_mean(spark):
    rows = [(i, (i % 4 == 0) - (i % 7 == 0)) for i in range(3000)]
    r = N.paired_bootstrap(spark.createDataFrame(rows, "g int, d int"), "g", "d", 200, 9).first()
    mean = sum(d for _, d in rows) / 3000
    assert abs(r["mean"] - mean) < 1e-6 and r["lo"] < mean < r["hi"] and r["hi"] - r["lo"] < 0.08 and r["significant"]


def test_early_stopping(spark):
    runs = {"a": [1, 3, 2, 2, 9], "b": [1, 2, 3, 4], "c": [5, 4], "d": [1, 1, 2, 1, 1, 3]}
    df = spark.createDataFrame([(k, i, float(s)) for k, v in runs.items() for i, s in enumerate(v)], "run string, e int, s double")
    got = {r.run: (r.best_epoch, r.stopped) for r in N.early_stopping(df, "run", "e", "s", 2).collect()}
    assert got == {"a": (1, 3), "b": (3, None), "c": (0, None), "d": (2, 4)}


def test_stratified_split_is_exact_with_nulls_and_small_strata(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(100)] + [(200, "z")], "k int, s string")
    got = N.stratified_split(df, "k", "s", 1, 0.75).groupBy("s").agg(F.count_if("is_train").alias("t")).collect()
    assert {r.s: r.t for r in got} == {"x": 49, "y": 25, "z": 0}
