"""Scans that stop, rewrites that fail, arrays and result folders, in a folder of the test."""

import json

import pytest
from pyspark.sql import functions as F

from lodestep.operators import controls as K
from lodestep.operators import moments as G
from lodestep.sources import folders, records


@pytest.fixture
def eight(spark, tmp_path):
    """Eight files of ten rows, in order of their names."""
    for i in range(8):
        spark.range(10 * i, 10 * i + 10, numPartitions=1).select("id", (F.col("id") % 2).alias("odd")).write.parquet(f"file://{tmp_path}/t/part={i}")
    return f"file://{tmp_path}/t"


def test_scan_stops_when_the_quota_is_met(spark, eight):
    few = folders.scan_until(spark, eight, F.col("odd") == 1, 4)
    assert [r.id for r in few.rows.collect()] == [1, 3, 5, 7] and (few.files_read, few.files) == (1, 8)
    more = folders.scan_until(spark, eight, F.col("odd") == 1, 12)
    assert [r.id for r in more.rows.collect()] == list(range(1, 24, 2)) and more.files_read == 3 and more.scanned == 30
    bounded = folders.scan_until(spark, eight, F.col("id") >= 14, 100, max_scan=25)
    assert [r.id for r in bounded.rows.collect()] == list(range(14, 25)) and bounded.files_read == 3 and bounded.scanned == 25
    every = folders.scan_until(spark, eight, F.col("id") == 77, 5)
    assert [r.id for r in every.rows.collect()] == [77] and every.files_read == 8
    assert folders.scan_until(spark, eight, F.lit(None).cast("boolean"), 5).rows.count() == 0
    assert folders.scan_until(spark, eight, F.lit(True), 0).rows.count() == 0


def test_scan_of_partitions_whose_files_share_names(spark, tmp_path):
    at = f"file://{tmp_path}/p"
    spark.range(40, numPartitions=1).withColumn("g", F.floor(F.col("id") / 10).cast("int")).write.partitionBy("g").parquet(at)
    found = folders.scan_until(spark, at, F.col("id") % 2 == 0, 7)
    assert [(r.id, r.g) for r in found.rows.collect()] == [(0, 0), (2, 0), (4, 0), (6, 0), (8, 0), (10, 1), (12, 1)] and (found.files_read, found.files) == (3, 4)
    assert [r.id for r in folders.scan_until(spark, at, F.col("g") == 3, 2).rows.collect()] == [30, 32 - 1]


def test_rewrite_swaps_and_a_failure_leaves_the_input_whole(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    spark.range(20).withColumn("h", F.lit(None).cast("int")).write.parquet(at)
    assert folders.rewrite(spark, at, lambda t: t.withColumn("h", (F.col("id") * 2).cast("int"))) == 20
    assert {(r.id, r.h) for r in spark.read.parquet(at).collect()} == {(i, 2 * i) for i in range(20)}
    broken = F.when(F.col("id") == 13, F.raise_error(F.lit("broken"))).otherwise(F.col("id"))
    for change in (lambda t: t.withColumn("h", broken.cast("int")), lambda t: t.where("id < 5")):
        with pytest.raises(Exception):
            folders.rewrite(spark, at, change)
        assert {(r.id, r.h) for r in spark.read.parquet(at).collect()} == {(i, 2 * i) for i in range(20)}
        assert [p.name for p in tmp_path.iterdir()] == ["t"]
    assert folders.rewrite(spark, at, lambda t: t.where("id < 5"), same_count=False) == 5


def test_array_is_one_valid_file(spark, tmp_path):
    rows = [(i, f'a "quoted"\n,line {i}' if i % 3 else None, [i, None]) for i in range(25)]
    df = spark.createDataFrame(rows, "k long, t string, v array<int>").repartition(6)
    for _ in range(2):  # the second replaces the first
        folders.write_array(df, f"file://{tmp_path}/all.json")
    found = json.loads((tmp_path / "all.json").read_text())
    assert sorted((x["k"], x["t"], x["v"]) for x in found) == rows and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["all.json"]
    assert sorted(tuple(r) for r in records.read_array(spark, f"file://{tmp_path}/all.json", df.schema).collect()) == rows
    folders.write_array(df.where("k < 0"), f"file://{tmp_path}/none.json")
    assert json.loads((tmp_path / "none.json").read_text()) == []


def test_result_files_of_unlike_shape_load_in_one_scan(spark, tmp_path):
    shapes = {"F_e2e_seed0": {"tag": "F", "f1_B": 0.5, "more": {"auc": 0.75}}, "F_e2e_seed1": {"tag": "F", "f1_B": "0.25", "list": [1]}, "R_e2e_seed7": {"tag": "R", "f1_B": None, "more": {"auc": 1}}, "odd": [1, 2]}
    for name, shape in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(shape, indent=2))
    (tmp_path / "broken_seed3.json").write_text("{")
    got = {r.file.rpartition("/")[2]: r for r in folders.read_results(spark, f"file://{tmp_path}", {"f1": "$.f1_B", "auc": "$.more.auc"}, {"tag": "$.tag"}).collect()}
    assert {k: (r.seed, r.tag, r.f1, r.auc) for k, r in got.items()} == {
        "F_e2e_seed0.json": (0, "F", 0.5, 0.75), "F_e2e_seed1.json": (1, "F", 0.25, None), "R_e2e_seed7.json": (7, "R", None, 1.0), "odd.json": (None, None, None, None), "broken_seed3.json": (3, None, None, None),
    }
    table = folders.summary(folders.read_results(spark, f"file://{tmp_path}", {"f1": "$.f1_B"}, {"tag": "$.tag"}).where("tag is not null"), "tag", ["f1"])
    assert {(r.tag, r.n, r["mean"], r["std"]) for r in table.collect()} == {("F", 2, 0.375, 0.125), ("R", 0, None, None)}


def test_moments_refuse_ragged_vectors_and_drop_holes(spark):
    with pytest.raises(ValueError):
        K.vector_moments(spark.createDataFrame([([1.0, 2.0], 1.0), ([1.0, 2.0, 3.0, 4.0], 2.0)], "v array<double>, y double"), "v", ["y"])
    holes = spark.createDataFrame([([1.0, 2.0], 1.0), ([3.0, 2.0], 2.0), ([None, 2.0], 5.0), ([float("nan"), 0.0], 1.0)], "v array<double>, y double")
    assert K.vector_moments(holes, "v", ["y"])[0].tolist() == [2.0, 2.0]


def test_a_wide_subspace_is_ablated_within_bounded_memory(spark):
    import resource

    import numpy as np

    d, k, n = 4096, 16, 48
    df = spark.range(n, numPartitions=2).select("id", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.sin(i * 0.37 + F.col("id") * (i + 1.0))).alias("v"), (F.col("id") % 3).cast("double").alias("y"))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    mean, covariance, cross, _ = K.vector_moments(df, "v", ["y"])
    rows = np.array([r.v for r in df.orderBy("id").select("v").collect()])
    assert np.allclose(mean, rows.mean(0)) and np.allclose(covariance[:3], ((rows - rows.mean(0)).T @ (rows - rows.mean(0)) / n)[:3])
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(d, k)))[0]
    got = np.array([r.v for r in K.changed(df, "v", K.ablation(basis, mean)).orderBy("id").select("v").collect()])
    assert np.allclose(got, rows - (rows - rows.mean(0)) @ basis @ basis.T)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 2 << 20  # kilobytes
    with pytest.raises(ValueError):
        G.whole_vectors(df.withColumn("v", F.slice("v", 1, F.col("id").cast("int") + 1)), "v")
