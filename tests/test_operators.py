import json

import pytest
from pyspark.sql import functions as F

from lodestep.functions import patterns as P
from lodestep.operators import confound, corpus, corrupt, metrics, sampling
from lodestep.operators.process import process_candidates
from lodestep.sources import records
from lodestep.streaming import incremental

STEPS = ["Let x be 5 and y be x", "From step 1 we get 12 since x > 0, so y", "Given that x is even, y = 3", "Therefore the total is 9"]


def one(spark, column):
    return spark.range(1).select(F.array(*map(F.lit, STEPS)).alias("s"), F.lit(7).alias("k")).select(column(F.col("s"), F.col("k")).alias("x")).first().x


def test_damage_keeps_provenance_and_bounds(spark):
    for kind in corrupt.DAMAGES:
        got = one(spark, lambda s, k, kind=kind: corrupt.apply_damage(s, kind, k))
        assert got.damage_type == kind and got.steps != STEPS and all(0 <= i < len(STEPS) for i in got.step_indices)
    assert len(one(spark, corrupt.drop_step).steps) == 3 and len(one(spark, corrupt.duplicate_step).steps) == 5
    assert sorted(one(spark, corrupt.swap_steps).steps) == sorted(STEPS)
    drift = one(spark, corrupt.notation_drift)
    assert sum(a != b for a, b in zip(drift.steps, STEPS)) == 1
    short = spark.sql("select array('only') s, 1 k")
    assert short.select(corrupt.apply_damage(F.col("s"), "structural", F.col("k"))).first()[0] is None
    with pytest.raises(NotImplementedError):
        corrupt.apply_damage(F.col("s"), "semantic", F.col("k"))


def test_doses_take_one_at_least(spark):
    for severity in (0.0, 0.5, 1.0):
        assert len(one(spark, lambda s, k: corrupt.step_delete(s, k, severity))) == 4 - max(1, int(2 * severity))
        assert len(one(spark, lambda s, k: corrupt.region_excise(s, k, severity))) == 4 - max(1, int(2 * severity))
        text = one(spark, lambda s, k: corrupt.diffuse_mask(F.array_join(s, " "), k, severity))
        n = sum(len(s.split()) for s in STEPS)
        assert text.count("[MASK]") == min(n, max(1, int(n * severity)))
    assert len(one(spark, lambda s, k: corrupt.excess_inject(s, k, 0.5))) == 6


def test_ranking_metrics(spark):
    df = spark.createDataFrame([("a", 0.1, False), ("a", 0.4, False), ("a", 0.35, True), ("a", 0.8, True), ("b", 1.0, True)], "g string, s double, y boolean")
    got = {r.g: r.auc for r in metrics.auc(df, "s", "y", ["g"]).collect()}
    assert got == {"a": 0.75, "b": None}
    flipped = metrics.auc(df.withColumn("s", -F.col("s")), "s", "y", ["g"]).where("g = 'a'").first().auc
    assert got["a"] + flipped == 1
    assert metrics.average_precision(df, "s", "y", ["g"]).where("g = 'a'").first().average_precision == pytest.approx(0.833333)


def test_splits_are_exact_and_repeatable(spark):
    df = spark.range(237).withColumnRenamed("id", "k").repartition(5)
    got = sampling.train_split(df, 3, "k")
    assert got.where("is_train").count() == 189
    assert {r.k for r in got.where("is_train").collect()} == {r.k for r in sampling.train_split(df.repartition(2), 3, "k").where("is_train").collect()}
    assert sorted(r["rank"] for r in sampling.bounded_rank(df, 3, "k").collect()) == list(range(1, 238))


def test_residuals_are_orthogonal_to_training_confounds(spark):
    df = spark.range(200).select(F.col("id").alias("k"), F.sin("id").alias("x"), F.cos("id").alias("z"), (2 * F.sin("id") + F.rand(1)).alias("y"))
    train = F.col("k") % 4 != 0
    out = confound.residualize(df, ["y"], ["x", "z"], train).where(train)
    sums = out.agg(*[F.abs(F.sum(F.col("y_residual") * c)) for c in (F.lit(1.0), F.col("x"), F.col("z"))]).first()
    assert max(sums) < 1e-8


def test_best_pairs_meet_the_definition(spark):
    import random

    rng = random.Random(1)
    rows = [(g, p, rng.choice("mno"), rng.choice("AABBD"), rng.choice(["high", "medium", "low"])) for g in range(60) for p in range(rng.randrange(9))]
    df = spark.createDataFrame(rows, "grp int, pos int, model string, type string, confidence string")
    want = {}
    for g, p, m, t, c in rows:
        for g2, p2, m2, t2, c2 in rows:
            if g == g2 and t == "A" and t2 == "B":
                key = (m != m2, corpus.RANK[c] + corpus.RANK[c2], -p, -p2)
                want[g] = max(want.get(g, key), key)
    got = {r.grp: (r.cross_model, r.conf, -r.a_pos, -r.b_pos) for r in corpus.best_pairs(df).collect()}
    assert got == want
    wired = corpus.wire_pairs(df).collect()
    assert all((r.pair_id is None) == (not r.anchor and not r.negative) for r in wired)


def test_records_nested_flat_blank_and_stream(spark, tmp_path):
    nested = {"record_id": "p1", "gold_answer": "5", "unknown_key": 1, "candidates": [{"candidate_id": "p1_c0", "full_text": "<think>Let x count the ways</think>So \\boxed{5}."}, {"candidate_id": "p1_c1", "response_text": "no idea"}]}
    flat = {"record_id": "p2", "candidate_id": "p2_c0", "response_text": "The answer is 6.", "gold_answer": "5", "answer_correct": True}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(nested) + "\n\n" + json.dumps(flat) + "\n")
    got = {r.candidate_id: r for r in process_candidates(records.read_candidates(spark, str(tmp_path / "in"))).collect()}
    assert set(got) == {"p1_c0", "p1_c1", "p2_c0"}
    assert got["p1_c0"].answer_correct and got["p1_c0"].thinking_source == "inline_think_tags" and got["p1_c0"].candidate_type in "AB"
    assert got["p1_c1"].candidate_type == "D" and "answer_not_extracted" in got["p1_c1"].quality_flags and not got["p1_c1"].include_in_training
    assert got["p2_c0"].answer_correct and got["p2_c0"].dataset_split == "test"
    stream = process_candidates(records.stream_candidates(spark, str(tmp_path / "in")))
    for _ in range(2):  # the second run finds nothing new
        incremental.run_once(stream.select("candidate_id", "candidate_type"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert {(r.candidate_id, r.candidate_type) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(k, r.candidate_type) for k, r in got.items()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_scores_and_writers(spark, tmp_path):
    blob = {"model": "m", "rows": [{"id": "a", "chain": "A", "split": "s", "step_scores": [0.5, 0.25], "step_labels": [0, -1]}, {"id": "b", "step_scores": [0.1], "step_labels": []}]}
    (tmp_path / "scores_m.json").write_text(json.dumps(blob))
    assert [(r.id, r.step, r.score, r.label) for r in records.read_scores(spark, str(tmp_path / "scores_*.json")).collect()] == [("a", 0, 0.5, 0)]
    df = spark.createDataFrame([("é", 0.123456)], "a string, b double")
    records.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().b == "0.1235"
    records.write_lines(df, str(tmp_path / "l"))
    assert records.read_any(spark, str(tmp_path / "l"), "a string, b double").first().a == "é"
    groups = spark.createDataFrame([("p", ["x", "y"], [True, False]), ("q", ["x"], [True])], "p string, g array<string>, c array<boolean>")
    assert [(r.p, r.generation, r.is_correct) for r in records.mixed_groups(groups, "g", "c").collect()] == [("p", "x", True), ("p", "y", False)]


def test_windows_batch_and_upsert(spark):
    events = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' k union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:00:00', 'b'")
    assert sorted(r.n for r in incremental.windowed_counts(events, "ts", "k").collect()) == [1, 2]
    log = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 1, "one")], "k string, v int, t string")
    assert sorted(r.t for r in corpus.latest(log, ["k"], ["v"]).collect()) == ["new", "one"]


def test_every_try_of_a_damage_picks_from_one_search(spark):
    """Each pattern was searched for again at each of six tries."""
    plan = spark.range(1).select(corrupt.apply_damage(F.array(F.lit("see step 2")), "dependency", F.col("id")).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == len(P.REFERENCES)
