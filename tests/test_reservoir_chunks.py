"""Series cut into blocks against whole series in one row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assimspark.functions import kernels
from assimspark.operators import reservoir
from assimspark.plans.cycle import Reservoir

UNITS, DIMS, WASH = 15, 2, 7


def model(rho=0.6):
    w, win = kernels.random_reservoir(UNITS, DIMS, 3, 4)
    return Reservoir(w, win, None, np.array([2.0, 3.0]), rho, 0.7, 1)


def signal(series, n):
    t = np.arange(n) * 0.3 + series
    return np.stack((2 * np.sin(t) + np.sin(2.7 * t), 3 * np.cos(1.3 * t)), axis=1)


def table(spark, lengths, gone=()):
    rows = [(s, 5 + k, d, float(v)) for s, n in lengths.items() for k, x in enumerate(signal(s, n)) if (s, k) not in gone for d, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id long, step long, dim int, y double").repartition(4)


LENGTHS = {0: 400, 1: 130, 2: 6, 3: 257}


@pytest.mark.parametrize("n_train", [300, 100_000])
def test_sums_of_blocks_equal_those_of_whole_series(spark, n_train):
    long, m, overlap, chunk = table(spark, LENGTHS), model(), reservoir.fading_steps(0.6), 64
    blocks = reservoir.pack_chunks(long, chunk, overlap)
    assert blocks.where("series_id = 0").count() == 7 + (400 % chunk >= chunk - overlap)
    want = reservoir.partial_grams(reservoir.pack_series(long), [m], WASH, n_train)[0]
    assert np.allclose(reservoir.chunk_grams(blocks, [m], WASH, chunk, n_train)[0], want, atol=1e-8)
    loop = np.zeros((UNITS + 1, UNITS + 1 + DIMS))
    for s, n in LENGTHS.items():
        u = signal(s, n)[:n_train]
        if len(u) >= WASH + 2:
            r = reservoir.states_of(u[:-1], m)[WASH:]
            r = np.hstack((r, np.ones((len(r), 1))))
            loop += r.T @ np.hstack((r, u[WASH + 1:]))
    assert np.allclose(want, loop)
    fitted = reservoir.fit_long(long, m, WASH, 1e-3, n_train, chunk)
    assert np.allclose(fitted.wout, reservoir.fit_readout(reservoir.pack_series(long), m, WASH, n_train, 1e-3).wout, atol=1e-6)


def test_states_of_blocks(spark):
    long, chunk = table(spark, LENGTHS), 64
    fitted = reservoir.fit_long(long, model(), WASH, 1e-3, None, chunk)
    got = {(r["series_id"], r["step"]): r for r in reservoir.chunk_states(reservoir.pack_chunks(long, chunk, 50), fitted, WASH, chunk).collect()}
    assert len(got) == sum(max(n - WASH, 0) for n in LENGTHS.values())
    for s, n in LENGTHS.items():
        r = reservoir.states_of(signal(s, n), fitted)
        for k in range(WASH, n):
            assert np.allclose(got[s, 5 + k]["r"], r[k], atol=1e-8) and np.allclose(got[s, 5 + k]["u_next"], kernels.readout(r[k][:, None], fitted.wout)[:, 0], atol=1e-6)


def test_after_a_missing_step_the_network_starts_anew(spark):
    gone, chunk, m = {(0, 100), (0, 190), (0, 191)}, 64, model()
    long = table(spark, {0: 300}, gone).unionByName(spark.createDataFrame([(0, 105, 0, None)], "series_id long, step long, dim int, y double"))
    got = {r["step"] - 5: r["r"] for r in reservoir.chunk_states(reservoir.pack_chunks(long, chunk, 50), m, WASH, chunk).collect()}
    want = {}
    for a, b in ((0, 100), (101, 190), (192, 300)):
        want |= {a + k: r for k, r in enumerate(reservoir.states_of(signal(0, 300)[a:b], m)) if k >= WASH}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


def test_search_on_blocks_equals_search_on_whole_series(spark):
    long, grid, tikhs = table(spark, LENGTHS), [(0.5, 0.4), (0.7, 0.8)], [1e-6, 1e-2]
    how = {"n_wash": WASH, "n_train": 200, "n_val": 12, "n_folds": 3}
    rows = lambda df: {(r["rho"], r["sigma"], r["tikh"]): r["score"] for r in df.collect()}
    got = rows(reservoir.search_long(long, model(), grid, tikhs, chunk=64, **how))
    want = rows(reservoir.search_hyperparameters(reservoir.pack_series(long), model(), grid, tikhs, **how))
    assert got.keys() == want.keys() and len(got) == 4 and all(abs(got[k] - want[k]) < 1e-4 for k in got)


def test_odd_tables(spark):
    empty = table(spark, {0: 3}).where(F.col("step") < 0)
    assert reservoir.pack_chunks(empty, 8, 4).count() == 0
    with pytest.raises(ValueError):
        reservoir.fit_long(table(spark, {2: 6}), model(), WASH, 1.0)
    with pytest.raises(ValueError):
        reservoir.fading_steps(1.0)
