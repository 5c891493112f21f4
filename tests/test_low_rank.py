"""Randomised modes against a dense singular value decomposition."""

import numpy as np
import pytest

from assimspark.operators import low_rank


def made(points, steps, seed=0):
    rng = np.random.default_rng(seed)
    left, right = np.linalg.qr(rng.normal(size=(points, 12)))[0], np.linalg.qr(rng.normal(size=(steps, 12)))[0]
    return 3 + left @ np.diag(2.0 ** -np.arange(12)) @ right.T * 100 + 1e-4 * rng.normal(size=(points, steps)), rng


def frame(spark, a, first_point=0, first_step=0):
    rows = [(first_step + j, first_point + i, float(a[i, j]), 0) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "step long, point_id long, value double, q_mean int").repartition(5)


@pytest.mark.parametrize("broadcast", [low_rank.MOST_BROADCAST, 0])
def test_leading_modes_equal_the_dense_ones(spark, monkeypatch, broadcast):
    monkeypatch.setattr(low_rank, "MOST_BROADCAST", broadcast)
    a, _ = made(70, 55)
    modes, coeffs, sigma = low_rank.pod_randomised(frame(spark, a, -7, 100), 5, side=16)
    u, s, vt = np.linalg.svd(a - a.mean(axis=1, keepdims=True), full_matrices=False)
    found = sorted(modes.collect())
    psi, phi = np.array([r["psi"] for r in found]), np.array([r["phi"] for r in sorted(coeffs.collect())])
    assert [r["point_id"] for r in found] == list(range(-7, 63)) and phi.shape == (55, 5)
    assert np.allclose(sigma, s[:5], rtol=1e-9) and np.allclose([r["q_mean"] for r in found], a.mean(axis=1))
    sign = np.sign((psi * u[:, :5]).sum(axis=0))
    assert abs(psi * sign - u[:, :5]).max() < 1e-6 and abs(phi * sign - vt[:5].T).max() < 1e-6


def test_low_rank_constant_and_empty_fields(spark):
    a = np.outer(np.arange(1.0, 9), np.sin(np.arange(11.0)))
    modes, coeffs, sigma = low_rank.pod_randomised(frame(spark, a), 3, oversample=2, side=4)
    assert len(sigma) == 1 and np.isclose(sigma[0], np.linalg.norm(a - a.mean(axis=1, keepdims=True)))
    again = np.array([r["psi"] for r in sorted(modes.collect())]) * sigma @ np.array([r["phi"] for r in sorted(coeffs.collect())]).T
    assert np.allclose(again, a - a.mean(axis=1, keepdims=True))
    for field in (frame(spark, np.full((3, 3), 2.0)), frame(spark, a).where("step < 0")):
        modes, coeffs, sigma = low_rank.pod_randomised(field, 2, side=4)
        assert len(sigma) == 0 and modes.count() == coeffs.count() == 0


def test_missing_and_null_cells(spark):
    rows = [(0, 0, 1.0), (1, 0, 3.0), (0, 1, 5.0), (2, 1, 9.0), (None, 0, 7.0), (5, None, 7.0), (6, 0, None)]
    modes, _, sigma = low_rank.pod_randomised(spark.createDataFrame(rows, "step long, point_id long, value double"), 2, side=4)
    want = np.linalg.svd(np.array([[-1.0, 1, 0], [-2, 0, 2]]), compute_uv=False)
    assert np.allclose(sigma, want) and sorted((r["point_id"], r["q_mean"]) for r in modes.collect()) == [(0, 2.0), (1, 7.0)]


def test_randomised_modes_of_the_given_field(spark):
    """Variances of the query's modes against a dense decomposition; the spectrum is flat."""
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()], float).T
    want = np.linalg.svd(x - x.mean(axis=1, keepdims=True), compute_uv=False)[:4] ** 2
    got = [r["variance"] for r in __spark_entry__.queries()["j1_randomised_modes"](spark, sf).orderBy("mode").collect()]
    assert np.allclose(got, want, atol=1e-3)
