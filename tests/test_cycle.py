"""Bias-aware cycles against a plain loop over one series, and the stream against the batch."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from assimspark.functions import kernels
from assimspark.plans import cycle
from assimspark.streaming.assimilate import stream_assimilate

DT, UP, Q, M = 0.1, 2, 2, 8


def turn(t, psi, params):
    return np.stack((-psi[1] * params[0], psi[0] * params[0]))


def network(outputs):
    rng = np.random.default_rng(outputs)
    w, win = kernels.random_reservoir(12, Q, 3, 4)
    return cycle.Reservoir(w, win, 0.2 * rng.normal(size=(13, outputs)), np.array([2.0, 3.0]), 0.9, 0.5, UP)


def first(series):
    rng = np.random.default_rng(series)
    wash = {s: rng.normal(size=Q) for s in range(2, 11, UP)}
    return rng.normal(size=(2, M)), 1 + 0.1 * rng.normal(size=(1, M)), 0, wash


def observations(series):
    rng = np.random.default_rng(100 + series)
    return [(k, s, rng.normal(size=Q), np.array([0.3, 0.2])) for k, s in enumerate((13, 18, 20, 27))]


def by_hand(series, net, cfg):
    psi, params, at, wash = first(series)
    q_out = net.wout.shape[1]
    seen, r, b, u, ready, out = [], None, np.zeros(Q), np.zeros(Q), False, []
    step_of = lambda u, r: kernels.reservoir_step(u[:, None], r, net.w, net.win, net.norm, net.rho, net.sigma)
    read = lambda r: kernels.readout(r, net.wout)[:, 0]
    for k, s, d, cdd in observations(series):
        since = at
        for t in range(at, s):
            psi = kernels.rk4(turn, psi, params, t * DT, DT)
            if t + 1 in wash:
                seen.append(wash[t + 1] - psi.mean(axis=1))
            if t + 1 == max(wash):
                r = np.zeros((12, 1))
                for x in seen[:-1]:
                    r = step_of(x, r)
                b, u, ready, since = read(r)[:Q], read(r)[-Q:], True, t + 1
        at = s
        coarse, states = [np.concatenate((b, u))[-q_out:]], [r]
        v = u
        for _ in range(-(-(s - since) // UP)):
            states.append(step_of(v, states[-1]))
            coarse.append(read(states[-1]))
            v = coarse[-1][-Q:]
        x = (s - since) / UP
        if ready and s > since:
            lo = int(x) if x < len(coarse) - 1 else len(coarse) - 2
            now, r = (z[lo] + (x - lo) * (z[lo + 1] - z[lo]) for z in (coarse, states))
            b, u = now[:Q], now[-Q:]
        shifted = d + b - u if q_out == 2 * Q else d
        many = shifted[:, None] + np.sqrt(cdd)[:, None] * kernels.perturbations(series, k, (Q, M), 0)
        rows = np.vstack((psi, params, psi))
        if k >= cfg.n_blind:
            jac = -(net.wout[:-1].T @ ((1 - r * r) * (net.sigma * net.win[:, :-1] / net.norm)))[:Q]
            x = kernels.rba_weights(psi, many, cdd, b, jac, cfg.k)
        else:
            x = kernels.enkf_weights(psi, many, cdd)
        mean = rows.mean(axis=1, keepdims=True)
        rows = rows + (rows - mean) @ x
        mean = rows.mean(axis=1, keepdims=True)
        rows = mean + cfg.inflation * (rows - mean)
        psi, params = rows[:2], rows[2:3]
        out.append((k, rows[3:].mean(axis=1), b))
        b = u = shifted - rows[3:].mean(axis=1)
    return out


def tables(spark, series):
    start = [(s, 0, first(s)[0].tolist(), first(s)[1].tolist(), [(k, d.tolist()) for k, d in first(s)[3].items()]) for s in series]
    obs = [(s, k, t, d.tolist(), c.tolist()) for s in series for k, t, d, c in observations(s)]
    return (
        spark.createDataFrame(start, "series_id long, step long, psi array<array<double>>, params array<array<double>>, wash array<struct<step:bigint,d:array<double>>>"),
        spark.createDataFrame(obs, "series_id long, cycle long, step long, d array<double>, cdd array<double>").repartition(3),
    )


@pytest.mark.parametrize("outputs", [Q, 2 * Q])
def test_batch_and_stream_equal_a_plain_loop(spark, outputs):
    net, cfg = network(outputs), cycle.Config(method="rba_enkf", dt=DT, k=0.7, n_blind=1, guard=False, extra_steps=3)
    start, obs = tables(spark, (3, 5))
    got = cycle.assimilate(start, obs, spark.createDataFrame([(0,)], "config_id long"), turn, Q, cfg, bias=net).collect()
    want = {(s, k): (y, b) for s in (3, 5) for k, y, b in by_hand(s, net, cfg)}
    cycles = {(r["series_id"], r["cycle"]): r for r in got if r["cycle"] >= 0}
    assert cycles.keys() == want.keys()
    for key, (y, b) in want.items():
        assert np.allclose(cycles[key]["y_mean"], y) and np.allclose(cycles[key]["bias"], b)
    assert any(np.abs(b).max() > 1e-3 for _, b in want.values())
    after = sorted((r["series_id"], r["step"], tuple(r["bias"])) for r in got if r["cycle"] == -1)
    assert [x[:2] for x in after] == [(s, t) for s in (3, 5) for t in (28, 29, 30)] and len({x[2] for x in after}) == 6  # the bias goes on
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = stream_assimilate(obs, first, turn, Q, cfg, bias=net, idle_ms=None).collect()
    for r in stream:
        assert np.allclose(r["y_mean"], want[(r["series_id"], r["cycle"])][0]) and np.allclose(r["bias"], want[(r["series_id"], r["cycle"])][1])
    assert len(stream) == len(want)


def test_stream_in_two_batches_keeps_the_washout(spark, tmp_path):
    """The second batch goes on from the typed state; one observation comes before the washout is over."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    net, cfg = network(Q), cycle.Config(method="rba_enkf", dt=DT, guard=False)
    rows = [(3, k, t, d.tolist(), c.tolist()) for k, (t, d, c) in enumerate([(5, np.array([1.0, 2.0]), np.array([0.3, 0.2])), *(o[1:] for o in observations(3))])]
    schema = "series_id long, cycle long, step long, d array<double>, cdd array<double>"
    whole = {r["step"]: r["y_mean"] for r in stream_assimilate(spark.createDataFrame(rows, schema), first, turn, Q, cfg, bias=net, idle_ms=None).collect()}
    folder, got = str(tmp_path), {}
    for part in (rows[:2], rows[2:] + rows[:1]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = stream_assimilate(spark.readStream.schema(schema).parquet(f"{folder}/in"), first, turn, Q, cfg, bias=net, idle_ms=None)
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{folder}/out").collect()
    got = {r["step"]: r["y_mean"] for r in done}
    assert got.keys() == whole.keys() and all(np.allclose(got[s], whole[s]) for s in whole) and max(r["n_dropped"] for r in done) == 1


def test_without_observations_there_are_no_rows(spark):
    start, obs = tables(spark, (3,))
    configs = spark.createDataFrame([(0,)], "config_id long")
    assert cycle.assimilate(start, obs.where("series_id = 9"), configs, turn, Q).count() == 0
    assert cycle.assimilate(start.where("series_id = 9"), obs, configs, turn, Q).count() == 0
    twice = cycle.assimilate(start, obs.unionByName(obs.where("cycle = 0")), configs, turn, Q, cycle.Config(dt=DT))
    assert twice.count() == 5 and twice.where("cycle = 0").count() == 2
    assert cycle.assimilate(start.withColumn("extra", F.lit(1)), obs, configs, turn, Q, cycle.Config(dt=DT)).count() == 4


def test_rejected_analyses_pointwise(spark):
    """Each cycle by hand: an analysis with a parameter outside its limits is set aside, and the forecast goes on inflated instead."""
    cfg, limits = cycle.Config(method="enkf", dt=DT, inflation=1.01, reject_inflation=1.2, guard=False), (0.6, 1.4)
    cfg = replace(cfg, limits=(limits,))
    start, obs = tables(spark, (3, 5, 8))
    out = cycle.assimilate(start.drop("wash"), obs, spark.createDataFrame([(0,)], "config_id long"), turn, Q, cfg)
    audit = {(r["series_id"], r["cycle"]): r for r in cycle.rejected_analyses(out).collect()}
    flags = {(r["series_id"], r["cycle"]): r["rejected"] for r in out.collect()}
    want, seen = {}, set()
    for s in (3, 5, 8):
        psi, params, at, _ = first(s)
        for k, step, d, cdd in observations(s):
            for t in range(at, step):
                psi = kernels.rk4(turn, psi, params, t * DT, DT)
            at, rows = step, np.vstack((psi, params, psi))
            dy, da = psi - psi.mean(axis=1, keepdims=True), rows - rows.mean(axis=1, keepdims=True)
            many = d[:, None] + np.sqrt(cdd)[:, None] * kernels.perturbations(s, k, (Q, M), 0)
            after = rows + da @ dy.T @ np.linalg.inv(dy @ dy.T + (M - 1) * np.diag(cdd)) @ (many - psi)
            bad = bool((after[2] < limits[0]).any() or (after[2] > limits[1]).any())
            seen.add(bad)
            if bad:
                want[s, k] = (params.mean(), after[2].mean())
            kept, rho = (rows, 1.2) if bad else (after, 1.01)
            kept = kept.mean(axis=1, keepdims=True) + rho * (kept - kept.mean(axis=1, keepdims=True))
            psi, params = kept[:2], kept[2:3]
            assert flags[s, k] == bad
    assert seen == {True, False} and audit.keys() == want.keys()
    assert all(np.isclose(audit[x]["prior"], p) and np.isclose(audit[x]["posterior"], q) and audit[x]["param"] == 0 for x, (p, q) in want.items())
