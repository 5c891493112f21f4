"""Series side by side against one series at a time."""

import numpy as np
import pytest

from assimspark.plans import cycle, lockstep

DT, Q = 0.05, 2
START = "series_id long, step long, psi array<array<double>>, params array<array<double>>, note string"
OBS = "series_id long, cycle long, step long, d array<double>, cdd array<double>, config_id string"


def swing(t, psi, params):
    """Depends on time, so series at other steps must get their own."""
    return np.stack((-psi[1] * params[0] + 0.3 * np.sin(t), psi[0] * params[0], psi[0] - psi[2] * np.cos(t)))


def case(n_series):
    rng = np.random.default_rng(n_series)
    start, obs = {}, {}
    for s in range(n_series):
        m = 6 if s % 3 else 9  # ensembles of two sizes
        start[s] = (int(rng.integers(0, 4)), rng.normal(size=(3, m)), 1 + 0.1 * rng.normal(size=(1, m)))
        steps = np.sort(rng.integers(start[s][0], 60, int(rng.integers(1, 9))))  # steps may be equal, or that of the start
        obs[s] = [(k, int(t), rng.normal(size=Q), rng.uniform(0.1, 0.5, Q)) for k, t in enumerate(steps)]
    return start, obs


def frames(spark, start, obs):
    a = [(s, t, psi.tolist(), params.tolist(), "x") for s, (t, psi, params) in start.items()]
    b = [(s, k, t, d.tolist(), c.tolist(), "clash") for s, rows in obs.items() for k, t, d, c in rows]
    return spark.createDataFrame(a, START).repartition(3), spark.createDataFrame(b, OBS).repartition(5)


def one_by_one(start, obs, cfg):
    out = {}
    for s, (t, psi, params) in start.items():
        c = cycle.Cycle(psi.copy(), params.copy(), t, cfg, swing, None, Q)
        for k, to, d, cdd in obs.get(s, []):
            c.forecast(to)
            out[s, k, to] = c.analyse(s, d, cdd)
        for _ in range(cfg.extra_steps if s in obs else 0):
            c.forecast(c.step + 1)
            out[s, -1, c.step] = {"y_mean": c.psi[:Q].mean(axis=1), "innovation": c.u, "param_mean": c.params.mean(axis=1), "rejected": False}
    return out


METHODS = [
    dict(method="enkf", limits=((0.9, 1.1),)), dict(method="ensrkf", n_hold_params=2, extra_steps=2), dict(method="rba_enkf", k=0.5, n_blind=2, seed=4),
    dict(method="rba_enkf_cmame", k=2.0, guard=False, inflation=1.1, extra_steps=1), dict(method="enkf", limits=((None, 1.05),), reject_inflation=1.3),
]


@pytest.mark.parametrize("how", METHODS)
def test_side_by_side_equals_one_by_one(spark, how, monkeypatch):
    monkeypatch.setattr(lockstep, "BLOCK_SERIES", 7)  # several blocks
    start, obs = case(23)
    del obs[4]  # no observations: no rows
    cfg = cycle.Config(dt=DT, **how)
    got = {(r["series_id"], r["cycle"], r["step"]): r for r in cycle.assimilate(*frames(spark, start, obs), spark.createDataFrame([(0,)], "config_id long"), swing, Q, cfg).collect()}
    want = one_by_one(start, obs, cfg)
    assert got.keys() == want.keys()
    for key, w in want.items():
        for name, x in w.items():
            assert np.allclose(got[key][name], x, rtol=1e-9, atol=1e-9), (key, name)
    if "limits" in how:
        assert {bool(w["rejected"]) for w in want.values()} == {True, False}


def test_a_sweep_overrides_fields_for_each_configuration(spark):
    start, obs = case(5)
    cells = [(7, "enkf", 1.0, 0), (9, "ensrkf", 1.2, 2), (11, "rba_enkf", 1.05, 1)]
    got = cycle.assimilate(*frames(spark, start, obs), spark.createDataFrame(cells, "config_id long, method string, inflation double, extra_steps int"), swing, Q, cycle.Config(dt=DT)).collect()
    for config, method, inflation, extra in cells:
        want = one_by_one(start, obs, cycle.Config(dt=DT, method=method, inflation=inflation, extra_steps=extra))
        own = {(r["series_id"], r["cycle"], r["step"]): r for r in got if r["config_id"] == config}
        assert own.keys() == want.keys() and all(np.allclose(own[k]["y_mean"], w["y_mean"], atol=1e-9) for k, w in want.items())


def test_odd_tables(spark):
    start, obs = case(3)
    configs = spark.createDataFrame([(0,)], "config_id long")
    a, b = frames(spark, start, obs)
    run = lambda x, y, **how: cycle.assimilate(x, y, configs, swing, Q, cycle.Config(dt=DT), **how)
    assert run(a.where("false"), b).count() == run(a, b.where("false")).count() == 0
    nulls = spark.createDataFrame([(0, 90, None, [1.0, 1.0], [1.0, 1.0], ""), (0, 91, 90, None, [1.0, 1.0], ""), (1, 92, 90, [1.0, 1.0], None, ""), (None, 93, 90, [1.0, 1.0], [1.0, 1.0], "")], OBS)
    lost = spark.createDataFrame([(77, None, [[1.0]], [[1.0]], ""), (78, 0, None, [[1.0]], "")], START)
    more = b.unionByName(nulls).unionByName(b.where("cycle = 0").selectExpr("series_id + 77 as series_id", "cycle", "step", "d", "cdd", "config_id"))
    assert sorted(map(str, run(a.unionByName(lost), more).collect())) == sorted(map(str, run(a, b).collect()))
    with pytest.raises(Exception, match="several start rows"):
        run(a.unionByName(a), b).collect()


def test_no_parameters(spark):
    start = spark.createDataFrame([(1, 0, [[1.0, 2.0, 4.0], [0.0, 1.0, 0.5]], None, "")], START)
    obs = spark.createDataFrame([(1, 0, 3, [2.0, 0.5], [0.1, 0.1], "")], OBS)
    drift = lambda t, psi, params: -0.1 * psi
    row = cycle.assimilate(start, obs, spark.createDataFrame([(0,)], "config_id long"), drift, Q, cycle.Config(dt=DT, method="ensrkf")).collect()
    c = cycle.Cycle(np.array([[1.0, 2.0, 4.0], [0.0, 1.0, 0.5]]), np.zeros((0, 3)), 0, cycle.Config(dt=DT, method="ensrkf"), drift, None, Q)
    c.forecast(3)
    assert len(row) == 1 and row[0]["param_mean"] == [] and np.allclose(row[0]["y_mean"], c.analyse(1, np.array([2.0, 0.5]), np.array([0.1, 0.1]))["y_mean"])
