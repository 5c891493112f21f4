"""Defined results of core operators for nulls, empty tables, ties, repeated rows and columns with clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assimspark.functions.names import own_names
from assimspark.operators import align, ensemble, fields, filters, metrics, reservoir, timegrid, truth

SERIES = "series_id long, step long, t double, dim long, y double, __rank string, __lo string, __end string"


@pytest.fixture(scope="module")
def series(spark):
    rows = [(s, k, k * 0.5, 0, float(k % 4), "r", "l", "e") for s in (1, 2) for k in range(12)] + [(1, 11, 5.5, 0, 3.0, "r", "l", "e"), (None, 3, 1.5, 0, 1.0, "r", "l", "e")]
    return spark.createDataFrame(rows, SERIES).repartition(3)


def test_names_avoid_what_is_there(spark):
    df = spark.range(1).selectExpr("1 as __a", "2 as __A_", "3 as b")
    assert own_names(df, "a", "b") == {"a": "__a__", "b": "__b"}


def test_selections_keep_clashing_columns_and_repeated_rows(series):
    last = timegrid.last_n(series, 2)
    assert last.columns == series.columns and sorted(r["step"] for r in last.where("series_id = 1").collect()) == [11, 11] and last.where("series_id is null").count() == 1
    cut = timegrid.cut_nearest(series, 1.25, 3.0)
    assert cut.columns == series.columns and sorted(r["step"] for r in cut.where("series_id = 2").collect()) == [2, 3, 4, 5] and cut.where("series_id is null").count() == 0
    washed = timegrid.washout_window(series, 5.0, 2, 3)
    assert washed.columns == series.columns and sorted(r["step"] for r in washed.where("series_id = 2").collect()) == [4, 7, 10]
    inside = timegrid.assimilation_interval(series, series.where("step = 6"), 2)
    assert inside.columns == series.columns and sorted(r["step"] for r in inside.where("series_id = 2").collect()) == [4, 5, 6, 7]
    none = series.where("step > 99")
    assert all(f.count() == 0 for f in (timegrid.last_n(none, 2), timegrid.cut_nearest(none, 0, 1), timegrid.washout_window(none, 1, 2, 3), timegrid.assimilation_interval(series, none, 2), timegrid.thin_observations(none, 0, 9, 1, 2)))


def test_ensembles_with_nulls_and_clashes(spark):
    rows = [(1, 0, 0, "param", "x", j, v, "m") for j, v in enumerate([1.0, None, 5.0])]
    ens = spark.createDataFrame(rows, "series_id long, step long, row_id int, kind string, name string, member int, value double, __mean string")
    out = ensemble.inflate(ens, 2.0, "kind = 'param'")
    assert out.columns == ens.columns and sorted(out.select("value").collect(), key=str) == sorted([(-1.0,), (None,), (7.0,)], key=str)
    limits = spark.createDataFrame([("x", None, 4.0)], "name string, lo double, hi double")
    assert tuple(ensemble.out_of_bounds(ens, limits).first()) == (1, 0, True, 1)
    assert ensemble.out_of_bounds(ens, limits.where("name = 'z'")).count() == 0 and ensemble.inflate(ens.where("step > 5"), 2.0).count() == 0
    assert ensemble.fixed_points(ens.where("step > 5"), 3).count() == 0
    scalar = spark.createDataFrame([(1, 0, 1.0, 1.0, 2.0, 0.5, 7), (1, 1, 2.0, 1.0, 2.0, 0.5, 7)], "series_id long, member long, a double, y double, d double, r double, __v int")
    got = filters.scalar_analysis(scalar, "ensrkf")
    assert sorted((r["a"], r["a_a"], r["__v"]) for r in got.collect()) == [(1.0, 1.0, 7), (2.0, 2.0, 7)]  # no spread, no move


def test_metrics_of_nothing_and_of_zeros(spark):
    df = spark.createDataFrame([(1, 0, "a", 0.0, 0.0), (2, 0, "a", None, 1.0), (3, 0, "a", 2.0, 1.0), (3, 1, "a", 2.0, 1.0)], "series_id long, step long, dim string, y double, e double")
    got = {r["series_id"]: (r["C"], r["R"]) for r in metrics.cr_metrics(df, ["series_id"]).collect()}
    assert got[1] == (None, None) and got[2] == (None, None) and got[3] == (None, 0.5)
    assert {r["series_id"]: r["rms_e"] for r in metrics.rms_per_step(df, ["series_id"]).collect()} == {1: None, 2: None, 3: 0.5}
    with pytest.raises(ValueError):
        metrics.histogram(df, ["dim"], "y", 4, 1.0, 1.0)
    assert [(r["bin"], r["n"]) for r in metrics.histogram(df, ["dim"], "y", 2, 0.0, 2.0).orderBy("bin").collect()] == [(0, 1), (1, 2)]
    none = df.where("step > 9")
    assert metrics.cr_metrics(none, ["series_id"]).count() == 0 and metrics.histogram(none, [], "y", 2, 0.0, 2.0).count() == 0 and metrics.ensemble_moments(none, ["dim"], "y").count() == 0
    runs = spark.createDataFrame([(2, 1.0, 1.0), (1, 1.0, 1.0), (3, 2.0, 2.0)], "run int, biased double, unbiased double")
    assert metrics.best_run(runs, ["run"])["run"] is not None and metrics.best_run(runs, ["run"]).first()["run"] == 1


def test_windows_without_norm_have_infinite_errors(spark):
    rows = [("a", 1, 0, 4.0, 0.0), ("a", 1, 1, 1.0, 100.0), ("a", 2, 0, 0.0, 1.0), ("b", 1, 0, 0.0, 0.0), ("c", 1, 0, 1.0, 100.0), ("c", 1, 0, 3.0, 300.0), ("d", 1, 0, None, None)]
    scored = spark.createDataFrame(rows, "dim string, series_id long, window long, error2 double, norm2 double")
    got = {r["dim"]: tuple(map(str, (r["e_min"], r["e_max"], r["e_mean"]))) for r in metrics.forecast_test_errors(scored, ["dim"]).collect()}
    assert got == {"a": ("-inf", "inf", "nan"), "b": ("nan", "nan", "nan"), "c": ("-2.0", "-2.0", "-2.0"), "d": ("None", "None", "None")}


def test_modes_of_nothing_and_of_ragged_points(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "point_id long, snaps array<double>")
    with pytest.raises(ValueError):
        fields.pod(rows, 1)
    modes, phi, sigma = fields.pod(rows.where("point_id > 5"), 2)
    assert modes.count() == 0 and len(sigma) == 0
    modes, sigma, n = fields.pod_by_points(spark.createDataFrame([], "step long, point_id long, value double"), 2)
    assert modes.count() == 0 and len(sigma) == 0 and n == 0


def test_alignment_of_nothing(series):
    none = series.where("step > 99")
    assert align.find_peaks(none, ["series_id"]).count() == 0 and align.envelope(none, ["series_id"]).count() == 0
    one = series.where("series_id = 2")
    assert align.lag_search(one.select("series_id", "step", F.col("y").alias("d")).where("step < 3"), none.select("series_id", F.lit(0).alias("member"), "step", "y"), 2).count() == 0
    assert reservoir.pack_series(none).count() == 0
    assert truth.amplitude_spectrum(none, 0.1).count() == 0 and truth.add_coloured_noise(none.withColumnRenamed("y", "y_true"), 0.1, "pink").count() == 0


def test_training_set_leaves_still_members_out(spark):
    obs = spark.createDataFrame([(1, k, float(np.sin(k)), float(np.sin(k))) for k in range(20)], "series_id long, step long, y_raw double, y_true double")
    ens = spark.createDataFrame([(1, j, k, float(np.sin(k + j)) if j else 0.5) for j in range(10) for k in range(30)], "series_id long, member long, step long, y double")
    got = reservoir.bias_training_set(obs, ens, 4, n_cr=10)
    assert sorted(r["member"] for r in got.select("member").distinct().collect()) == list(range(1, 10))
    assert {r["factor"] for r in reservoir.bias_training_set(obs, ens, 4, True).select("factor").distinct().collect()} == {1.0, 0.1, -0.01}
