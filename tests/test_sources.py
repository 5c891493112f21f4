"""Recordings and fields read from files, and the workloads as a whole on the smallest tables."""

import math

import __spark_entry__
from assimspark.operators import reservoir
from assimspark.sources import tables

SF = "/root/testdata/sf0.001"


def test_recordings_are_read_in_long_form(spark, tmp_path):
    wide = [(1, 0, 0.0, 1.5, 7, "x"), (1, 1, 0.1, None, 8, "x"), (2, 0, 0.0, 2.5, 9, None)]
    spark.createDataFrame(wide, "series_id long, step long, t double, left double, right int, dim string").write.parquet(f"{tmp_path}/recording")
    got = sorted(tuple(r) for r in tables.read_signals(spark, f"{tmp_path}/recording", ["left", "right"]).fillna(-1.0, ["y"]).collect())
    assert got == [(1, 0, 0.0, 0, 1.5), (1, 0, 0.0, 1, 7.0), (1, 1, 0.1, 0, -1.0), (1, 1, 0.1, 1, 8.0), (2, 0, 0.0, 0, 2.5), (2, 0, 0.0, 1, 9.0)]


def test_fields_are_read_without_bad_numbers(spark, tmp_path):
    cells = [(0, 0, 0, 0, 1.0), (0, 0, 0, 1, math.nan), (1, 0, 0, 0, math.inf), (1, 0, 0, 1, -math.inf), (2, 0, 0, 0, -3.0)]
    spark.createDataFrame(cells, "step long, comp int, ix int, iy int, value double").write.parquet(f"{tmp_path}/field")
    assert sorted(tuple(r) for r in tables.read_field(spark, f"{tmp_path}/field").collect()) == [(0, 0, 0, 0, 1.0), (0, 0, 0, 1, 0.0), (1, 0, 0, 0, 0.0), (1, 0, 0, 1, 0.0), (2, 0, 0, 0, -3.0)]


def test_best_hyperparameters(spark):
    scores = spark.createDataFrame([(0.9, 0.3, 1.0, -2.0), (0.5, 0.3, 1.0, -2.0), (0.1, 0.1, 0.1, 5.0)], "rho double, sigma double, tikh double, score double")
    assert [tuple(r) for r in reservoir.best_hyperparameters(scores).select("rho", "sigma", "tikh", "score").collect()] == [(0.5, 0.3, 1.0, -2.0)]
    assert reservoir.best_hyperparameters(scores.where("score > 9")).count() == 0


def test_workloads_as_a_whole(spark):
    get = __spark_entry__.queries()
    sweep = get["w_bias_aware_sweep"](spark, SF).collect()
    cells = {(r["series_id"], r["config_id"]) for r in sweep}
    assert len(cells) == len(sweep) and {c for _, c in cells} == set(range(5))
    for s in {s for s, _ in cells}:
        mine = [r for r in sweep if r["series_id"] == s]
        best = min(mine, key=lambda r: (r["rms_biased"] + r["rms_unbiased"], r["config_id"]))
        assert sum(r["is_best"] for r in mine) == 1 and len(mine) == 5
        assert any(r["is_best"] and abs(r["rms_biased"] + r["rms_unbiased"] - best["rms_biased"] - best["rms_unbiased"]) < 1e-3 for r in mine)
    field = get["w_field_assimilation"](spark, SF).collect()
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").groupBy("label").count().collect()
    want = sum(sum(1 for k in range(r["count"]) if k > 8 and k % 3 == 0) for r in vectors)
    assert len(field) == 3 * want and all(r["rms_before"] > 0 and r["rms_after"] > 0 for r in field)
    shifted = get["h6_biased_observations"](spark, SF).collect()
    assert shifted and all(math.isfinite(r["y_mean"]) and math.isfinite(r["innovation"]) for r in shifted)
