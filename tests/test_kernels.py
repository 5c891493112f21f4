import numpy as np

from assimspark.functions import kernels


def setup(q=2, n=5, m=12, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, m)), rng.normal(size=(q, m)), rng.normal(size=q), rng.uniform(0.1, 0.5, q), rng


def dense_gain(a, y, cdd):
    da, s = a - a.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    return da @ s.T @ np.linalg.inv((y.shape[1] - 1) * np.diag(cdd) + s @ s.T)


def test_stochastic_filter_equals_the_covariance_form():
    a, y, d, cdd, rng = setup()
    many = d[:, None] + rng.normal(size=y.shape)
    assert np.allclose(kernels.apply_weights(a, kernels.enkf_weights(y, many, cdd)), a + dense_gain(a, y, cdd) @ (many - y))


def test_square_root_filter_has_the_exact_mean_and_covariance():
    a, y, d, cdd, _ = setup()
    rows = np.vstack((a, y))
    out = kernels.apply_square_root(rows, *kernels.ensrkf_weights(y, d, cdd))
    g = dense_gain(rows, y, cdd)
    assert np.allclose(out.mean(axis=1), rows.mean(axis=1) + g @ (d - y.mean(axis=1)))
    p = np.cov(rows)
    h = np.hstack((np.zeros((2, 5)), np.eye(2)))
    k = p @ h.T @ np.linalg.inv(h @ p @ h.T + np.diag(cdd))
    assert np.allclose(np.cov(out), (np.eye(7) - k @ h) @ p)


def test_regularised_filters_without_bias_are_the_plain_one():
    a, y, d, cdd, _ = setup()
    many = np.broadcast_to(d[:, None], y.shape)
    zero = np.zeros((2, 2))
    plain = kernels.enkf_weights(y, many, cdd)
    for transposed in (True, False):
        assert np.allclose(kernels.rba_weights(y, many, cdd, np.zeros(2), zero, 3.0, None, transposed), plain)


def test_regularised_filter_solves_its_normal_equations():
    a, y, d, cdd, rng = setup()
    jac, b, k = rng.normal(size=(2, 2)), rng.normal(size=2), 2.0
    many = np.broadcast_to(d[:, None], y.shape)
    s, one = y - y.mean(axis=1, keepdims=True), np.eye(2)
    c = 11 * np.diag(cdd) + (one + jac.T) @ (one + jac) @ s @ s.T + k * jac.T @ jac @ s @ s.T
    want = s.T @ np.linalg.inv(c) @ ((one + jac.T) @ (d[:, None] - y - b[:, None]) - k * jac.T @ b[:, None])
    assert np.allclose(kernels.rba_weights(y, many, cdd, b, jac, k), want)


def test_rk4_and_reservoir_pieces():
    psi = np.array([[1.0, 2.0]])
    for _ in range(10):
        psi = kernels.rk4(lambda t, x, p: -p * x, psi, np.array([[0.5, 1.0]]), 0, 0.1)
    assert np.allclose(psi, [[np.exp(-0.5), 2 * np.exp(-1.0)]], rtol=1e-6)
    w, win = kernels.random_reservoir(40, 2, 3, 1)
    assert np.isclose(np.abs(np.linalg.eigvals(w)).max(), 1) and ((win != 0).sum(axis=1) <= 1).all()
    rng = np.random.default_rng(0)
    wout, r, u, norm = rng.normal(size=(41, 2)), rng.normal(size=(40, 1)), rng.normal(size=2), np.array([1.5, 2.0])
    f = lambda u: kernels.readout(kernels.reservoir_step(u[:, None], r, w, win, norm, 0.9, 0.4), wout)[:, 0]
    now = kernels.reservoir_step(u[:, None], r, w, win, norm, 0.9, 0.4)[:, 0]
    numeric = np.stack([(f(u + h) - f(u - h)) / 2e-6 for h in np.eye(2) * 1e-6], axis=1)
    assert np.allclose(kernels.readout_jacobian(now, wout, win, norm, 0.4), numeric, atol=1e-6)
