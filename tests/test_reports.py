"""Corruption datasets, score panels, validation and smaller operations against plain Python and numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestep.functions import text as T
from lodestep.operators import corpus as K
from lodestep.operators import corrupt as X
from lodestep.operators import panel as N
from lodestep.operators import probes as R
from lodestep.operators import sampling as S
from lodestep.operators.process import needs_review
from lodestep.sources import records


def test_early_stopping_takes_no_null_for_a_best(spark):
    runs = {"a": [0.5, None, 0.4, 0.6], "b": [None, 0.1, 0.2, float("nan"), 0.3], "c": [None, None, None], "d": [0.9, 0.1, 0.95]}
    df = spark.createDataFrame([(k, i, v) for k, vs in runs.items() for i, v in enumerate(vs)], "run string, epoch int, score double")
    got = {r.run: (r.best_epoch, r.stopped) for r in N.early_stopping(df, "run", "epoch", "score", 2).collect()}
    assert got == {"a": (0, 2), "b": (4, None), "c": (None, 2), "d": (2, None)}


def test_last_box_at_any_depth_in_pieces(spark):
    texts = ["\\boxed{1} \\boxed{a{b}{c{d}}} x}", "\\boxed{{}}", "\\boxed{open {x}", "\\boxed{}", "none", "\\boxed{a}" + "{}" * 500, None, "}\\boxed{\n2\n}"]
    got = [r.b for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(T.last_boxed(F.col("t")).alias("b")).collect()]
    assert got == ["a{b}{c{d}}", "{}", "open {x}", "", None, "a", None, "2"]


def test_connectives_go_one_by_one(spark):
    text = "So x. Because y, then z; therefore w and hence v. First a, second b."
    df = spark.createDataFrame([(k, text) for k in range(200)] + [(500, "a\u0001so b"), (501, "plain"), (502, None)], "k long, t string")
    for severity in (0.0, 0.5, 1.0):
        got = {r.k: r.o for r in df.select("k", X.connective_dose(F.col("t"), F.col("k"), severity).alias("o")).collect()}
        assert got[500] == "a\u0001so b" and got[501] == "plain" and got[502] is None
        lost = np.mean([sum(w not in got[k].lower().split() for w in ("so", "because", "then", "therefore", "hence", "first", "second")) for k in range(200)]) / 7
        assert abs(lost - severity) < 0.07 and all(set("xyzwvab") <= set(got[k]) for k in range(200))


def test_corruption_dataset_carries_and_drops(spark):
    row = "k long, t string, s array<string>, gold string, can_approach_corrupt boolean, can_step_corrupt boolean, can_conclusion_corrupt boolean, include_in_training boolean, candidate_type string, contrastive_group string, dataset string, corruption_priority string, hardness_score double"
    rest = ("B", "g", "d", "high", 0.5)
    steps = ["one two", "three", "four", "five"]
    rows = [(1, "\n".join(steps), steps, "7", True, True, True, True, *rest), (2, "\n".join(steps), steps, "7", False, None, True, True, *rest), (3, "a\nb", ["a", "b"], "7", False, True, False, True, *rest),
            (4, "\n".join(steps), steps, "7", True, True, True, False, *rest), (5, "\n".join(steps), steps, "7", True, True, True, None, *rest), (6, None, None, None, True, True, True, True, *rest)]
    got = X.corruption_dataset(spark.createDataFrame(rows, row), "k", "t", "s", "gold").collect()
    assert sorted((r.k, r.corruption_type) for r in got) == [(1, "approach"), (1, "conclusion"), (1, "step"), (2, "conclusion")]
    assert all((r.candidate_type, r.contrastive_group, r.dataset, r.corruption_priority, r.hardness_score) == rest and r.original_text == "\n".join(steps) != r.corrupted_text for r in got)
    one = {r.corruption_type: r.corrupted_text for r in got if r.k == 1}
    assert one["approach"].split("\n")[1:] == steps[1:] and len(one["step"].split("\n")) in (3, 4) and "\\boxed{" in one["conclusion"] and "\\boxed{7}" not in one["conclusion"]


def test_noise_is_normal_and_scaled(spark):
    df = spark.range(400).select("id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 8).cast("double")).alias("v"))
    x = np.array([r.o for r in df.select(X.noisy_vector(F.col("v"), F.col("id"), 0.5, 3).alias("o")).collect()]) - np.arange(64) % 8
    assert abs(x.mean()) < 0.02 and abs(x.std() - 0.5 * np.std(np.arange(8))) < 0.02 and abs((np.abs(x) > 1.96 * x.std()).mean() - 0.05) < 0.01


def plain_auc(score, pos):
    return ((score[pos][:, None] > score[~pos]).sum() + 0.5 * (score[pos][:, None] == score[~pos]).sum()) / (pos.sum() * (~pos).sum())


def test_score_panel_equals_plain_control(spark):
    rng = np.random.default_rng(2)
    n = 150
    length, y = rng.normal(size=n), rng.integers(0, 2, n)
    scores = {m: [rng.uniform(0, 1, 4) * (1 - 0.3 * y[i] * (m == "good")) for i in range(n)] for m in ("good", "bad")} | {"few": [rng.uniform(0, 1, 4) for _ in range(5)]}
    steps = spark.createDataFrame([(m, str(i), j, float(x), int(y[i] and j == 2)) for m, all_ in scores.items() for i, s in enumerate(all_) for j, x in enumerate(s)], "model string, id string, step int, score double, label int")
    table = spark.createDataFrame([(str(i), int(y[i]), i % 5, float(length[i])) for i in range(n)], "id string, y int, fold int, length double")
    got = {(r.model, r.arm): r for r in R.score_panel(steps, table, "y", "fold", 0, [F.col("length")], []).collect()}
    assert set(got) == {("few", None), *[(m, a) for m in ("good", "bad") for a in ("min", "mean")]} and got["few", None].note == "scorer failed: 5 scored"
    t = np.arange(n) % 5 != 0
    ones = np.column_stack([np.ones(n), length])
    for m in ("good", "bad"):
        for arm, f in (("min", np.min), ("mean", np.mean)):
            v = np.array([1 - f(s) for s in scores[m]])
            left = v - ones @ np.linalg.lstsq(ones[t], v[t], rcond=None)[0]
            assert got[m, arm].raw_auc == pytest.approx(plain_auc(v[~t], y[~t] == 1), abs=1e-5) and got[m, arm].controlled_auc == pytest.approx(plain_auc(left[~t], y[~t] == 1), abs=1e-5)
        low = np.array([1 - x for s in scores[m] for x in s])
        bad = np.array([bool(y[i] and j == 2) for i in range(n) for j in range(4)])
        assert got[m, "min"].gate == pytest.approx(plain_auc(low, bad), abs=1e-5) and (got[m, "min"].note is None) == (got[m, "min"].gate > 0.55)


def test_over_control_takes_away_what_categories_tell(spark):
    rng = np.random.default_rng(5)
    g = rng.integers(0, 2, 300)
    y = (g + rng.normal(scale=0.4, size=300) > 0.5).astype(int)
    v = np.column_stack([g + rng.normal(scale=0.2, size=300), rng.normal(size=300)])
    df = spark.createDataFrame([(v[i].tolist(), int(y[i]), i % 3, f"g{g[i]}", float(rng.normal())) for i in range(300)], "v array<double>, y int, fold int, g string, a double")
    for r in R.over_control(df, "v", [F.col("a")], [F.col("g")], "y", "fold", [0, 2]).collect():
        assert r.raw_auc > 0.8 and r.without_auc > 0.8 and r.with_auc < 0.7 and r.delta == pytest.approx(r.with_auc - r.without_auc, abs=1e-6)


def test_stratified_probe_tests_a_fifth_of_each_class(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 205)
    df = spark.createDataFrame([(i, [float(y[i] + rng.normal(scale=0.3)), 1.0], int(y[i])) for i in range(205)], "id long, v array<double>, y int")
    r = R.stratified_probe(df, "v", "y", F.col("id")).first()
    assert r.n == 205 - sum(int(0.8 * (y == c).sum()) for c in (0, 1)) and min(r.accuracy, r.f1, r.macro_f1, r.auc) > 0.8


def test_validation_report_skips_counts_and_fails_rates(spark):
    schema = "dataset string, answer_correct boolean, candidate_type string, has_extended_thinking boolean, thinking_response_gap boolean, include_in_training boolean, quality_flags array<string>, total_cost_usd double"
    good = [("MATH", i < 6, "A", True, i < 2, True, [], 0.1) for i in range(10)]
    pairs = spark.range(3)
    report = lambda rows, **o: {r.name: r.status for r in K.validation_report(spark.createDataFrame(rows, schema), pairs, **o).collect()}
    small = report(good, allow_small=True)
    assert small == {"total_candidates": "SKIP", "MATH_correct_rate": "PASS", "contrastive_pairs": "SKIP", "thinking_gap_rate": "PASS", "included_rate": "PASS", "clean_rate": "PASS", "total_cost": "PASS", "overall": "PASS"}
    strict = report(good)
    assert strict["total_candidates"] == strict["contrastive_pairs"] == strict["overall"] == "FAIL"
    dear = report([("OmniMath", True, "B", None, None, None, ["x"], 30.0)], allow_small=True)
    assert dear == {"total_candidates": "SKIP", "OmniMath_correct_rate": "FAIL", "type_b_of_correct": "FAIL", "contrastive_pairs": "SKIP", "included_rate": "FAIL", "clean_rate": "FAIL", "total_cost": "FAIL", "overall": "FAIL"}
    none = report([], allow_small=True)
    assert none["total_candidates"] == "SKIP" and none["included_rate"] == "FAIL" and "MATH_correct_rate" not in none


def test_review_needs_a_right_answer_by_an_unknown_approach(spark):
    rows = [(1, "Well.\nThe answer is 7", "7"), (2, "Let x be it, solve for x.\nThe answer is 7", "7"), (3, "Well.\nThe answer is 8", "7"), (4, "no answer", "7"), (5, None, "7"), (6, "Well. The answer is 7", None)]
    got = {r.k: (r.correct, r.needs_review) for r in needs_review(spark.createDataFrame(rows, "k int, r string, g string"), "r", "g").collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False), 5: (False, False), 6: (False, False)}


def test_score_files_count_what_does_not_align(spark, tmp_path):
    rows = [{"id": "a", "chain": "A", "split": "s", "step_scores": [0.5, 0.25], "step_labels": [0, -1]}, {"id": "b", "chain": "B", "split": "s", "step_scores": [0.1], "step_labels": [0, 1]}]
    (tmp_path / "scores_x.json").write_text(json.dumps({"model": "x", "n": 2, "skipped": 3, "rows": rows}, indent=1))
    (tmp_path / "scores_y.json").write_text(json.dumps({"model": "y", "skipped": None, "rows": []}))
    assert {tuple(r) for r in records.skipped_scores(spark, f"file://{tmp_path}/scores_*.json").collect()} == {("x", 1, 1, 3), ("y", 0, 0, 0)}
    assert [(r.model, r.id, r.step, r.score, r.label) for r in records.read_scores(spark, f"file://{tmp_path}").collect()] == [("x", "a", 0, 0.5, 0)]


def test_small_columns(spark):
    df = spark.createDataFrame([("conv__c12__c3", "Precalculus"), ("a\nb__c4", "NUMBER theory"), ("no mark", None), ("x__cy", "physics")], "r string, s string")
    got = df.select(N.split_id(F.col("r")).alias("p"), T.normalise_subject(F.col("s")).alias("s")).collect()
    assert [tuple(r.p) for r in got] == [("conv__c12", 3), ("a\nb", 4), ("", None), ("x", None)] and [r.s for r in got] == ["calculus", "number_theory", "other", "other"]


def test_samples_by_split(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(90)], "k int, g int, y int")
    balanced, natural = S.per_split(df, "k", "g", "y", 6, 1).collect(), S.per_split(df, "k", "g", "y", 6, 1, "natural").collect()
    assert all(sum(r.g == g and r.y == y for r in balanced) == 3 for g in range(3) for y in range(2)) and all(sum(r.g == g for r in natural) == 6 for g in range(3))
    with pytest.raises(ValueError):
        S.per_split(df, "k", "g", "y", 6, 1, "other")


def test_hardest_of_a_band(spark):
    rows = [("s", 1, ["g", "h"], "5"), ("s", 2, [], "9"), ("s", 3, ["x"], "hard"), ("s", 4, None, "5"), ("t", 5, ["y"], None), ("s", 6, ["z"], "7")]
    got = N.hardest(spark.createDataFrame(rows, "split string, k int, golds array<string>, level string"), "split", "k", "golds", "level", 3, -1, 8).collect()
    assert sorted(tuple(r) for r in got) == sorted([("s", 6, "z", 7.0), ("s", 1, "g", 5.0), ("s", 4, None, 5.0), ("t", 5, "y", -1.0)])
