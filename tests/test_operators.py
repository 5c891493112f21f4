import numpy as np
import pytest
from pyspark.sql import functions as F

from assimspark.operators import align, ensemble, fields, filters, reservoir, truth
from assimspark.plans import cycle


def test_two_stage_filter_equals_dense_for_two_observables(spark):
    rng = np.random.default_rng(0)
    vals = rng.normal(size=(4, 6))
    rows = spark.createDataFrame([(1, 0, i, "obs" if i > 1 else "state", [float(v) for v in vals[i]]) for i in range(4)], "series_id long, cycle long, row_id int, kind string, vals array<double>")
    obs = spark.createDataFrame([(1, 0, 0, 0.5, 0.2), (1, 0, 1, -0.3, 0.4)], "series_id long, cycle long, dim int, d double, cdd double")
    got = {r["row_id"]: r["vals"] for r in filters.analyse(rows, obs, "ensrkf").collect()}
    y = vals[2:]
    s, da = y - y.mean(axis=1, keepdims=True), vals - vals.mean(axis=1, keepdims=True)
    g = da @ s.T @ np.linalg.inv(5 * np.diag([0.2, 0.4]) + s @ s.T)
    assert np.allclose([np.mean(got[i]) for i in range(4)], vals.mean(axis=1) + g @ (np.array([0.5, -0.3]) - y.mean(axis=1)))


def test_twin_finds_the_rate(spark):
    rng = np.random.default_rng(1)
    true = [10 * np.exp(-0.6 * 0.1 * s) for s in range(0, 60)]
    obs = spark.createDataFrame([(7, k, s, [float(true[s])], [0.01]) for k, s in enumerate(range(3, 60, 3))], "series_id long, cycle long, step long, d array<double>, cdd array<double>")
    start = spark.createDataFrame([(7, 0, [(10 + rng.normal(size=40)).tolist()], [rng.uniform(0.2, 1.2, 40).tolist()])], "series_id long, step long, psi array<array<double>>, params array<array<double>>")
    configs = spark.createDataFrame([(0, "enkf"), (1, "ensrkf")], "config_id long, method string")
    out = cycle.assimilate(start, obs, configs, decay, 1, cycle.Config(dt=0.1)).where("cycle = 18").collect()
    assert len(out) == 2 and all(abs(r["param_mean"][0] - 0.6) < 0.1 for r in out)
    none = cycle.assimilate(start, obs, configs, decay, 1, cycle.Config(dt=0.1, limits=((0.0, 0.3),)))
    assert cycle.rejected_analyses(none).count() > 0


def decay(t, psi, params):
    return -params[:1] * psi


def test_pod_orders_energy_and_reconstructs(spark):
    rng = np.random.default_rng(2)
    q = rng.normal(size=(30, 3)) @ np.diag([5, 2, 1]) @ rng.normal(size=(3, 12))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "point_id long, snaps array<double>").repartition(4)
    modes, phi, sigma = fields.pod(rows, 3)
    assert np.allclose(sigma, np.linalg.svd(q - q.mean(axis=1, keepdims=True), compute_uv=False)[:3])
    coeffs = spark.createDataFrame([(t, phi[t].tolist()) for t in range(12)], "step long, phi array<double>")
    back = {(r["point_id"], r["step"]): r["value"] for r in fields.reconstruct(coeffs, modes, sigma.tolist()).collect()}
    assert np.allclose([[back[(i, t)] for t in range(12)] for i in range(30)], q)
    psi = np.stack([r["psi"] for r in modes.orderBy("point_id").collect()])
    left, want = psi.copy(), []
    for _ in range(3):
        k = int((left**2).sum(axis=1).argmax())
        want.append(k)
        v = left[k] / np.linalg.norm(left[k])
        left = left - np.outer(left @ v, v)
    assert fields.rank_sensors(modes, 3) == want


def test_reservoir_fit_doesnt_depend_on_partitions(spark):
    from assimspark.functions.kernels import random_reservoir

    t = np.arange(120) * 0.2
    rows = [(s, [[float(np.sin(x + s)), float(np.cos(x + s))] for x in t]) for s in range(3)]
    df = spark.createDataFrame(rows, "series_id long, u array<array<double>>")
    w, win = random_reservoir(40, 2, 3, 1)
    net = cycle.Reservoir(w, win, None, np.ones(2), 0.8, 0.3)
    a, b = (reservoir.fit_readout(df.repartition(n), net, 10, 100, 1e-6) for n in (1, 3))
    assert np.allclose(a.wout, b.wout, atol=1e-6)
    y = np.stack([r["y"] for r in reservoir.closed_loop_forecast(spark.createDataFrame([(0, 0, rows[0][1][:60])], "series_id long, window long, u array<array<double>>"), a, 20).orderBy("step").collect()])
    assert np.abs(y - np.array(rows[0][1][60:80])).max() < 0.1


def test_peaks_envelopes_and_gaps(spark):
    y = [0, 1, 3, 3, 3, 1, 0, 2, 0, 5, 0]
    df = spark.createDataFrame([(1, i, float(i), float(v)) for i, v in enumerate(y)], "series_id long, step long, t double, y double")
    peaks = align.find_peaks(df, ["series_id"])
    assert sorted(r["step"] for r in peaks.collect()) == [3, 7, 9]
    assert sorted(r["step"] for r in align.separate_peaks(peaks, ["series_id"], 3).collect()) == [3, 9]
    env = {r["t"]: r["y"] for r in align.envelope(df, ["series_id"]).collect()}
    assert env[0.0] == 0 and env[5.0] == 2.5 and env[10.0] == 0


@pytest.mark.parametrize("colour", ["white", "pink", "brown", "blue", "violet"])
def test_colours_have_no_mean_and_unit_filter(colour):
    f = truth.colour_filter(64, colour)
    assert f[0] == 0 and np.isclose(np.mean(f[1:] ** 2), 1)
    assert len(truth.coloured(np.random.default_rng(0).normal(size=63), colour)) == 63


def test_inflation_and_bounds(spark):
    df = spark.createDataFrame([(1, 0, 0, "param", "x", j, float(v)) for j, v in enumerate((1, 2, 6))], "series_id long, step long, row_id int, kind string, name string, member int, value double")
    out = ensemble.inflate(df, 2.0).agg(F.avg("value"), F.stddev_pop("value")).first()
    assert np.isclose(out[0], 3) and np.isclose(out[1], 2 * np.std([1, 2, 6]))
    wide = df.withColumn("value", F.col("value") - 2.9)
    assert sorted(r["value"] for r in ensemble.inflate(wide, 2.0, "kind = 'param'").collect()) == pytest.approx([-1.9, -0.9, 3.1])
    limits = spark.createDataFrame([("x", 1.5, None)], "name string, lo double, hi double")
    assert tuple(ensemble.out_of_bounds(df, limits).first()) == (1, 0, True, 1)


def test_pod_by_points_equals_the_decomposition_of_many_snapshots(spark):
    rng = np.random.default_rng(6)
    q = rng.normal(size=(5, 3)) @ np.diag([5, 2, 1]) @ rng.normal(size=(3, 200))
    field = spark.createDataFrame([(t, i, float(q[i, t])) for t in range(200) for i in range(5)], "step long, point_id long, value double").repartition(3)
    modes, sigma, n = fields.pod_by_points(field, 3)
    u, s, vt = np.linalg.svd(q - q.mean(axis=1, keepdims=True), full_matrices=False)
    psi = np.stack([r["psi"] for r in modes.orderBy("point_id").collect()])
    assert n == 200 and np.allclose(sigma, s[:3]) and np.allclose(np.abs(psi.T @ u[:, :3]), np.eye(3), atol=1e-8)
    phi = {(r["step"], r["mode"]): r["phi"] for r in fields.project(field, modes, sigma.tolist()).collect()}
    assert np.allclose([[abs(phi[(t, k)]) for t in range(200)] for k in range(3)], np.abs(vt[:3]))


def test_the_driver_sees_points_not_snapshots(spark, monkeypatch):
    import __spark_entry__

    def no(*_):
        raise AssertionError("snapshots x snapshots")

    monkeypatch.setattr(fields, "gram", no)
    for name in ("j1_pod_energy", "s2_rank_sensors"):
        assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
