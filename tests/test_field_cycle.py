"""Field assimilation against a plain loop over one series, with errors from whole fields."""

import numpy as np

from assimspark.functions import kernels
from assimspark.plans import field_cycle
from assimspark.plans.cycle import Reservoir

POINTS, MODES, SENSORS, UNITS = 30, 2, [4, 11, 27], 25


def world():
    """A field of two modes whose coefficients turn, and a network trained on them."""
    rng = np.random.default_rng(1)
    psi, mean = np.linalg.qr(rng.normal(size=(POINTS, MODES)))[0], rng.normal(size=POINTS)
    t = np.arange(400) * 0.25
    u = np.stack((np.cos(t), np.sin(t)), axis=1)
    w, win = kernels.random_reservoir(UNITS, MODES, 3, 4)
    r, states = np.zeros((UNITS, 1)), []
    for x in u[:-1]:
        r = kernels.reservoir_step(x[:, None], r, w, win, np.ones(MODES), 0.8, 0.5)
        states.append(np.append(r[:, 0], kernels.OUTPUT_BIAS))
    x = np.array(states)[20:]
    wout = np.linalg.solve(x.T @ x + 1e-8 * np.eye(UNITS + 1), x.T @ u[21:])
    return psi, mean, u, Reservoir(w, win, wout, np.ones(MODES), 0.8, 0.5)


def by_hand(series, wash, obs, cfg, net, look, offset):
    rng = np.random.default_rng([cfg.seed, series])
    r = [np.zeros(UNITS) for _ in range(cfg.m)]
    out = lambda r: net.wout.T @ np.append(r, 1.0)
    turn = lambda u, r: np.tanh(net.sigma * net.win @ np.append(u / net.norm, kernels.INPUT_BIAS) + net.rho * net.w @ r)
    for u in wash:
        z = rng.standard_normal((MODES, cfg.m))
        r = [turn(u + cfg.jitter * z[:, k], r[k]) for k in range(cfg.m)]
    u, at, rows = [out(x) for x in r], len(wash), []
    for cycle, step, d, cdd in obs:
        while at < step:
            r = [turn(a, b) for a, b in zip(u, r)]
            u, at = [out(x) for x in r], at + 1
        a = np.array([np.concatenate((x, v, offset + look @ v)) for x, v in zip(r, u)]).T
        y, before = a[-len(d):], np.mean(u, axis=0)
        dy = y - y.mean(axis=1, keepdims=True)
        da = a - a.mean(axis=1, keepdims=True)
        gain = da @ dy.T @ np.linalg.inv(dy @ dy.T + (cfg.m - 1) * np.diag(cdd))
        many = d[:, None] + np.sqrt(cdd)[:, None] * kernels.perturbations(series, cycle, y.shape, cfg.seed)
        a = a + gain @ (many - y)
        a = a.mean(axis=1, keepdims=True) + cfg.inflation * (a - a.mean(axis=1, keepdims=True))
        r, u = list(a[:UNITS].T), list(a[UNITS:UNITS + MODES].T)
        rows.append((cycle, step, before, np.mean(u, axis=0)))
    return rows


def test_cycles_equal_a_plain_loop_and_lower_the_error(spark):
    psi, mean, u, net = world()
    rng, look, offset = np.random.default_rng(2), psi[SENSORS], mean[SENSORS]
    field = lambda step: mean + psi @ u[step]
    start, obs = [], []
    for s in range(3):
        start.append((s, 19, (u[:20] + 0.4 * s).tolist()))
        obs += [(s, k, 20 + 6 * k, (field(20 + 6 * k)[SENSORS] + 0.01 * rng.normal(size=3)).tolist(), [1e-4] * 3) for k in range(12)]
    odd = [(0, 50, 3, [0.0] * 3, [1.0] * 3), (0, 51, 200, None, [1.0] * 3), (9, 0, 30, [0.0] * 3, [1.0] * 3)]
    starts = spark.createDataFrame([*start, (7, 19, u[:20].tolist())], "series_id long, step long, u array<array<double>>")
    table = spark.createDataFrame(obs + odd, "series_id long, cycle long, step long, d array<double>, cdd array<double>").repartition(4)
    configs = spark.createDataFrame([(0, "enkf", 8), (1, "ensrkf", 30)], "config_id long, method string, m int")
    base = field_cycle.FieldConfig(jitter=0.3, inflation=1.02, seed=5)
    found = field_cycle.assimilate_fields(starts, table, configs, net, look, offset, base).cache()
    got = {(r["series_id"], r["cycle"]): r for r in found.where("config_id = 0").collect()}
    assert len(got) == 36 and found.count() == 72
    for s in range(3):
        cfg = field_cycle.FieldConfig("enkf", 8, 1.02, 0.3, 5)
        mine = [(k, t, np.array(d), np.array(c)) for i, k, t, d, c in obs if i == s]
        for cycle, step, before, after in by_hand(s, np.array(start[s][2]), mine, cfg, net, look, offset):
            r = got[s, cycle]
            assert r["step"] == step and np.allclose(r["before"], before, atol=1e-7) and np.allclose(r["after"], after, atol=1e-7)
    truth = spark.createDataFrame([(s, t, p, float(field(t)[p])) for s in range(3) for t in sorted({o[2] for o in obs}) for p in range(POINTS)], "series_id long, step long, point_id long, value double")
    modes = spark.createDataFrame([(p, float(mean[p]), psi[p].tolist()) for p in range(POINTS)], "point_id long, q_mean double, psi array<double>")
    errors = field_cycle.field_errors(found, truth, modes, [1.0, 1.0]).collect()
    by_cell = {(r["series_id"], r["config_id"], r["cycle"]): r for r in errors}
    assert len(by_cell) == 72
    for r in found.collect():
        e = by_cell[r["series_id"], r["config_id"], r["cycle"]]
        y = field(r["step"])
        for name in ("before", "after"):
            assert np.isclose(e[f"rms_{name}"], np.sqrt(np.mean((y - mean - psi @ np.array(r[name])) ** 2) / np.mean(y**2)), atol=1e-9)
    first, last = ([by_cell[s, 1, k] for s in range(3)] for k in (0, 11))
    assert all(e["rms_after"] < e["rms_before"] for e in first) and max(e["rms_after"] for e in last) < 0.05


def test_no_rows(spark):
    psi, mean, u, net = world()
    starts = spark.createDataFrame([(0, 1, u[:2].tolist())], "series_id long, step long, u array<array<double>>")
    none = spark.createDataFrame([], "series_id long, cycle long, step long, d array<double>, cdd array<double>")
    assert field_cycle.assimilate_fields(starts, none, spark.createDataFrame([(0,)], "config_id long"), net, psi[SENSORS], mean[SENSORS]).count() == 0
