"""Operators that SQL can't express, against plain numpy loops on small tables; and defined results for odd tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assimspark.functions import kernels
from assimspark.operators import align, ensemble, filters, reservoir, timegrid, truth
from assimspark.plans import cycle


def field_of(spark, q):
    """q: steps x nx x ny."""
    rows = [(t, 0, i, j, float(v)) for (t, i, j), v in np.ndenumerate(q)]
    return spark.createDataFrame(rows, "step long, comp int, ix long, iy long, value double").repartition(3)


@pytest.mark.parametrize("colour", ["pink", "brown", "blue", "violet"])
def test_field_colour_by_axes_equals_the_transform_of_the_whole(spark, colour):
    q = np.random.default_rng(1).normal(size=(6, 4, 5))
    got = truth.colour_field(field_of(spark, q).withColumnRenamed("value", "__n"), colour).collect()
    f = np.sqrt(sum(np.meshgrid(*(np.fft.fftfreq(n) ** 2 for n in q.shape), indexing="ij")))
    with np.errstate(divide="ignore"):
        s = {"pink": f ** (-0.5), "brown": 1 / f, "blue": np.sqrt(f), "violet": f}[colour]
    s.flat[0] = 0
    s /= np.sqrt(np.mean(s.ravel()[1:] ** 2))
    want = np.fft.ifftn(np.fft.fftn(q) * s).real
    assert len(got) == q.size and all(np.isclose(r["__n"], want[r["step"], r["ix"], r["iy"]]) for r in got)


def test_smooth_field_noise(spark):
    q = np.zeros((2, 6, 7))
    q[0, 0, 0] = 2.0
    plain = {(r["step"], r["ix"], r["iy"]): r["value"] for r in truth.add_field_noise(field_of(spark, q), 1.0, seed=3).collect()}
    n = np.array([[[(plain[t, i, j] - q[t, i, j]) / 2 for j in range(7)] for i in range(6)] for t in range(2)])
    sigma, r = 0.8, 3
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    fold = lambda k, size: k if 0 <= k < size else (-k - 1 if k < 0 else 2 * size - k - 1)
    want = np.zeros_like(n)
    for t, i, j in np.ndindex(n.shape):
        want[t, i, j] = sum(w[a + r] * w[b + r] * n[t, fold(i + a, 6), fold(j + b, 7)] for a in range(-r, r + 1) for b in range(-r, r + 1))
    got = truth.add_field_noise(field_of(spark, q), 1.0, smoothing=sigma, seed=3).collect()
    assert all(np.isclose(x["value"], q[x["step"], x["ix"], x["iy"]] + 2 * want[x["step"], x["ix"], x["iy"]]) for x in got)
    assert truth.add_field_noise(field_of(spark, q).where("step > 5"), 1.0, "pink", 0.8).count() == 0


def test_coloured_noise_of_a_channel(spark):
    y = np.arange(1.0, 12.0)
    df = spark.createDataFrame([(4, 0, k, float(v)) for k, v in enumerate(y)], "series_id long, dim long, step long, y_true double").repartition(2)
    white = {r["step"]: r["n"] for r in df.select("step", truth.keyed_normal(truth.channel_key(), F.col("step"), 9).alias("n")).collect()}
    x = np.append([white[k] for k in range(11)], 0.0)  # an odd length is padded by one
    f = np.fft.rfftfreq(12)
    s = np.where(f > 0, np.where(f > 0, f, 1) ** (-1 / 2.0), 0)
    s /= np.sqrt(np.mean(s[1:] ** 2))
    want = y + 0.1 * 11 * np.fft.irfft(np.fft.rfft(x) * s, 12)[:11]
    got = {r["step"]: r["y_raw"] for r in truth.add_coloured_noise(df, 0.1, "pink", seed=9).collect()}
    assert np.allclose([got[k] for k in range(11)], want)


def test_stuck_members_are_dropped_and_refilled(spark):
    rng = np.random.default_rng(2)
    rows = [(1, 9, r, j, float(rng.normal(r, 1))) for r in range(2) for j in range(20)]
    ens = spark.createDataFrame(rows, "series_id long, step long, row_id int, member int, value double")
    members = spark.createDataFrame([(1, j, j < 8) for j in range(20)], "series_id long, member int, fixed boolean")
    kept = ensemble.drop_fixed(members, 20)
    assert sorted(r["member"] for r in kept.where("keep").collect()) == [0, 1, 2, 3, 4, *range(8, 20)]
    assert ensemble.drop_fixed(members.withColumn("fixed", F.col("member") < 3), 20).where("keep").count() == 17
    full = ensemble.refill(ens, kept, 20, seed=1).collect()
    assert sorted((r["row_id"], r["member"]) for r in full) == [(r, j) for r in range(2) for j in range(20)]
    have = {(r["row_id"], r["member"]): r["value"] for r in full}
    x = np.array([[v for _, _, r2, j, v in rows if r2 == r and j not in (5, 6, 7)] for r in range(2)])
    new = np.random.default_rng([1, 1]).multivariate_normal(x.mean(axis=1), np.cov(x), size=3, method="eigh")
    assert np.allclose([[have[r, j] for r in range(2)] for j in (5, 6, 7)], new)


def test_many_series_are_refilled_side_by_side(spark, monkeypatch):
    rng = np.random.default_rng(7)
    given = {}
    for s in range(400):
        members = sorted(rng.choice(9, int(rng.integers(1, 9)), replace=False).tolist())
        given[s] = {(r, j): float(rng.normal(r, 1)) for r in ((0, 1, 2) if s % 3 else (4, 7)) for j in members}
    given[400] = {(0, j): float(j) for j in range(6)} | {(1, 2): 5.0}  # nothing is missing, though row 1 has one member
    given[401] = {(0, 0): 1.0, (0, 8): 3.0}
    rows = [(s, s % 5, r, j, v, j != 8) for s, cells in given.items() for (r, j), v in cells.items()]
    ens = spark.createDataFrame(rows, "series_id long, step long, row_id int, member int, value double, keep boolean").repartition(3)
    got = {}
    for x in ensemble.refill(ens.drop("keep"), ens.select("series_id", "member", "keep").distinct(), 6, seed=3).collect():
        assert x["step"] == x["series_id"] % 5 and (x["row_id"], x["member"]) not in got.setdefault(x["series_id"], {})
        got[x["series_id"]][x["row_id"], x["member"]] = x["value"]
    filled = 0
    for s, cells in given.items():
        want = {k: v for k, v in cells.items() if k[1] != 8}
        at, members = sorted({r for r, _ in want}), sorted({j for _, j in want})
        missing = [j for j in range(6) if j not in members]
        if missing and len(members) > 1:
            x = np.array([[want[r, j] for j in members] for r in at])
            new = np.random.default_rng([3, s]).multivariate_normal(x.mean(axis=1), np.atleast_2d(np.cov(x)), size=len(missing), method="eigh")
            want |= {(r, j): new[i, k] for i, j in enumerate(missing) for k, r in enumerate(at)}
            filled += 1
        assert got.get(s, {}).keys() == want.keys() and all(abs(got[s][k] - v) < 1e-6 for k, v in want.items())
    assert filled > 200
    calls, eigh = [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda a: calls.append(1) or eigh(a))
    n = 3000
    values = rng.normal(size=n * 8)
    table = pa.table({"series_id": np.arange(n).repeat(8), "step": np.zeros(n * 8, int), "row_id": np.tile(np.arange(2, dtype=np.int32).repeat(4), n), "member": np.tile([0, 1, 2, 4], 2 * n), "value": values})
    assert sum(t.num_rows for t in ensemble._refill_series(table, 6, 0, table.schema)) == n * 12 and len(calls) == 1


def net(units=9, dims=2):
    w, win = kernels.random_reservoir(units, dims, 3, 7)
    return cycle.Reservoir(w, win, None, np.array([2.0, 0.5])[:dims], 0.8, 0.6)


def series(spark, n=3, length=30, seed=0):
    rng = np.random.default_rng(seed)
    u = {s: rng.normal(size=(length, 2)) for s in range(n)}
    return u, spark.createDataFrame([(s, x.tolist()) for s, x in u.items()], "series_id long, u array<array<double>>").repartition(2)


def plain_states(u, m):
    r, out = np.zeros(len(m.w)), []
    for x in u:
        r = np.tanh(m.sigma * m.win @ np.append(x / m.norm, 0.1) + m.rho * m.w @ r)
        out.append(r)
    return np.array(out)


def plain_fit(us, m, n_wash, tikh):
    a = np.concatenate([np.column_stack((plain_states(u[:-1], m)[n_wash:], np.ones(len(u) - 1 - n_wash))) for u in us])
    b = np.concatenate([u[n_wash + 1:] for u in us])
    return np.linalg.solve(a.T @ a + tikh * np.eye(a.shape[1]), a.T @ b)


def plain_loop(u, m, n):
    r, out = plain_states(u, m)[-1], []
    for _ in range(n):
        y = m.wout.T @ np.append(r, 1.0)
        out.append(y)
        r = np.tanh(m.sigma * m.win @ np.append(y / m.norm, 0.1) + m.rho * m.w @ r)
    return np.array(out)


def test_reservoir_states_fit_forecast_and_jacobian(spark):
    u, df = series(spark)
    m = reservoir.fit_readout(df, net(), 4, 25, 1e-2)
    assert np.allclose(m.wout, plain_fit([x[:25] for x in u.values()], m, 4, 1e-2))
    got = reservoir.reservoir_states(df, m, 4).collect()
    assert len(got) == 3 * 26
    for r in got:
        state = plain_states(u[r["series_id"]], m)[r["step"]]
        assert np.allclose(r["r"], state) and np.allclose(r["u_next"], m.wout.T @ np.append(state, 1.0))
    for r in reservoir.jacobians(reservoir.reservoir_states(df, m, 28), m).collect():
        state = plain_states(u[r["series_id"]], m)[r["step"]]
        want = -m.wout[:-1].T @ np.diag(1 - state**2) @ (m.sigma * m.win[:, :-1] / m.norm)
        assert np.allclose(np.reshape(r["jac"], (2, 2)), want)
    windows = df.withColumn("window", F.lit(0).cast("long"))
    for s, rows in _by(reservoir.closed_loop_forecast(windows, m, 5).collect(), "series_id").items():
        assert np.allclose([r["y"] for r in sorted(rows, key=lambda r: r["step"])], plain_loop(u[s], m, 5))
    with pytest.raises(ValueError):
        reservoir.fit_readout(df.where("series_id > 9"), net(), 4, 25, 1e-2)
    assert reservoir.search_hyperparameters(df.where("series_id > 9"), net(), [(0.5, 0.3)], [1e-2], 4, 25, 3).count() == 0


def _by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_search_scores(spark):
    u, df = series(spark)
    got = {(r["rho"], r["sigma"], r["tikh"]): r["score"] for r in reservoir.search_hyperparameters(df, net(), [(0.5, 0.3), (0.9, 0.6)], [1e-3, 1e-1], 4, 24, 5, 3).collect()}
    shift = (24 - 5 - 4) // 2
    for (rho, sigma, tikh), score in got.items():
        m = net()
        m.rho, m.sigma = rho, sigma
        m.wout = plain_fit([x[:24] for x in u.values()], m, 4, tikh)
        errors = []
        for x in u.values():
            for fold in range(3):
                p = 4 + fold * shift
                want = x[p + 5:p + 10]
                if len(want) == 5:
                    errors.append(np.log10(np.mean((plain_loop(x[p:p + 5], m, 5) - want) ** 2) / np.mean(m.norm**2)))
        assert np.isclose(score, np.mean(errors))
    assert len(got) == 4


def test_members_with_their_own_singular_values(spark):
    _, df = series(spark)
    m = reservoir.fit_readout(df, net(), 4, 25, 1e-2)
    a, _, c = np.linalg.svd(m.wout, full_matrices=False)
    rng = np.random.default_rng(3)
    r0, sig = rng.normal(size=(4, 9)), rng.uniform(0.5, 1.5, (4, 2))
    ens = spark.createDataFrame([(1, j, r0[j].tolist(), sig[j].tolist()) for j in range(4)], "series_id long, member long, r array<double>, sigmas array<double>")
    got = {(r["member"], r["step"]): r["y"] for r in reservoir.data_driven_forecast(ens, m, 3).collect()}
    for j in range(4):
        own, r = a @ np.diag(sig[j]) @ c, r0[j]
        for s in range(3):
            y = own.T @ np.append(r, 1.0)
            assert np.allclose(got[j, s], y)
            r = np.tanh(m.sigma * m.win @ np.append(y / m.norm, 0.1) + m.rho * m.w @ r)


def test_windows_are_distinct_and_keyed(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 2)], "series_id long, n_steps long")
    got = [tuple(r) for r in reservoir.sample_windows(df, 6, 3, seed=2).collect()]
    every = {(1, s) for s in range(3)} | {(2, s) for s in range(7)}
    assert len(set(got)) == 6 and set(got) <= every and got == [tuple(r) for r in reservoir.sample_windows(df.repartition(3), 6, 3, seed=2).collect()]
    assert reservoir.sample_windows(df, 99, 3).count() == 10


def test_interpolation_over_blocks_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    t = {s: np.sort(rng.uniform(0, 50, 60)) for s in (1, 2)}
    y = {s: rng.normal(size=60) for s in t}
    q = {s: rng.uniform(-5, 55, 80) for s in t}
    samples = spark.createDataFrame([(s, float(a), float(b), "x") for s in t for a, b in zip(t[s], y[s])] + [(1, None, 5.0, "x"), (1, 3.0, None, "x")], "series_id long, t double, y double, __t string")
    times = spark.createDataFrame([(s, float(a)) for s in q for a in q[s]] + [(1, float(q[1][0])), (1, None), (9, 1.0), (None, 1.0)], "series_id long, t double")
    want = {s: np.interp(q[s], t[s], y[s]) for s in q}
    for rows in (1_000_000, 7):
        monkeypatch.setattr(timegrid.neighbours, "__defaults__", (rows,))
        got = align.interpolate_to(times, samples, ["series_id"]).collect()
        assert len(got) == 164
        for s in q:
            have = {r["t"]: r["y"] for r in got if r["series_id"] == s and r["t"] is not None}
            assert np.allclose([have[x] for x in q[s]], want[s])
        assert all(r["y"] is None for r in got if r["series_id"] in (9, None) or r["t"] is None)
        near = timegrid.nearest_samples(samples.where("t is not null").withColumn("step", F.round(F.col("t") * 1000).cast("long")), times.where("t is not null").withColumnRenamed("t", "tx")).collect()
        for r in near:
            if r["series_id"] in t:
                all_t = np.append(t[r["series_id"]], 3.0) if r["series_id"] == 1 else t[2]
                assert np.isclose(abs(r["t"] - r["tx"]), np.abs(all_t - r["tx"]).min())
    assert align.interpolate_to(times.limit(0), samples, ["series_id"]).count() == 0
    assert [r["y"] for r in align.interpolate_to(times.where("t < 0"), samples, ["series_id"], fill=7.0).collect()] == [7.0] * times.where("t < 0").count()


@pytest.mark.parametrize("limit", [64 << 20, 0])
@pytest.mark.parametrize("method", ["rba_enkf", "ensrkf"])
def test_two_stage_analyses_with_mixed_shapes_and_odd_rows(spark, method, limit, monkeypatch):
    monkeypatch.setattr(filters, "WEIGHT_BYTES", limit)
    rng = np.random.default_rng(5)
    rows, obs, want = [], [], {}
    for s, (n, q, m) in enumerate([(3, 2, 5), (3, 2, 5), (700, 1, 4), (2, 3, 9)]):
        v = rng.normal(size=(n + q, m))
        rows += [(s, 7, i, "obs" if i >= n else "state", v[i].tolist(), f"x{i}") for i in range(n + q)]
        d, cdd, b, jac = rng.normal(size=q), rng.uniform(0.1, 1, q), rng.normal(size=q), rng.normal(size=(q, q))
        obs += [(s, 7, k, float(d[k]), float(cdd[k]), float(b[k]), jac[k].tolist()) for k in range(q)]
        dev = v - v.mean(axis=1, keepdims=True)
        if method == "ensrkf":
            w, x = kernels.ensrkf_weights(v[n:], d, cdd)
            after = v - dev + (dev @ w)[:, None] + dev @ x
        else:
            after = v + dev @ kernels.rba_weights(v[n:], np.broadcast_to(d[:, None], (q, m)), cdd, b, jac, 2.0)
        want |= {(s, i): r for i, r in enumerate(after)}
    df = spark.createDataFrame(rows, "series_id long, cycle long, row_id int, kind string, vals array<double>, __block string").withColumnRenamed("__block", "m").repartition(3)
    table = spark.createDataFrame(obs, "series_id long, cycle long, dim int, d double, cdd double, b double, jac array<double>")
    got = filters.analyse(df, table, method, k=2.0, perturb=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("RepartitionByExpression [series_id" in plan) == (limit == 0)  # small weights: the rows don't move
    assert got.columns == df.columns and got.count() == len(rows)
    for r in got.collect():
        assert np.allclose(r["vals"], want[r["series_id"], r["row_id"]]) and r["m"] == f"x{r['row_id']}"
    assert filters.analyse(df.where("series_id = 9"), table).count() == 0 and filters.analyse(df, table.where("series_id = 9")).count() == 0
    twice = df.unionByName(df.where("series_id = 0 and row_id = 0"))
    assert filters.analyse(twice, table).where("series_id = 0 and row_id = 0").count() == 2
    lost = spark.createDataFrame([(0, 7, 50, "state", None, ""), (9, 7, 0, "state", [1.0, 2.0], ""), (9, 7, 1, "obs", None, "")], df.withColumnRenamed("m", "n").schema).withColumnRenamed("n", "m")
    unseen = spark.createDataFrame([(9, 7, 0, 1.0, 0.5, 0.0, [0.0])], table.schema)
    assert filters.analyse(df.unionByName(lost), table.unionByName(unseen), method, k=2.0, perturb=False).count() == len(rows)  # null rows, and a cycle of a null observable
