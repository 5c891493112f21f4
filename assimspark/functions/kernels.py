"""Small numpy kernels for grouped tasks: ensemble-space analyses, the reservoir step, fixed-step integration.

Af is N x m (rows: state, parameters, observables); only the q observable rows are needed to get the weights."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _t(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


def _noise(cdd: np.ndarray, m: int) -> np.ndarray:
    return (m - 1) * cdd[..., None] * np.eye(cdd.shape[-1])


def enkf_weights(y: np.ndarray, d: np.ndarray, cdd: np.ndarray) -> np.ndarray:
    """X with Aa = Af + (Af - mean) X; y: q x m forecast observables, d: q x m perturbed observations, cdd: q. Leading axes: many at once."""
    s = y - y.mean(axis=-1, keepdims=True)
    return _t(s) @ np.linalg.solve(_noise(cdd, y.shape[-1]) + s @ _t(s), d - y)


def ensrkf_weights(y: np.ndarray, d: np.ndarray, cdd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(w, T): Aa = mean + (Af - mean) w + (Af - mean) T, w for the mean (m), T the symmetric square root (m x m); d: q. Leading axes: many."""
    m = y.shape[-1]
    mean = y.mean(axis=-1, keepdims=True)
    s = y - mean
    lam, z = np.linalg.eigh(_noise(cdd, m) + s @ _t(s))
    root = _t(z / np.sqrt(np.maximum(lam, 1e-300))[..., None, :])
    half = root @ s
    w = _t(half) @ (root @ (d[..., None] - mean))
    _, e, vt = np.linalg.svd(half, full_matrices=False)
    shrink = np.sqrt(np.clip(1 - e * e, 0, None)) - 1
    return w[..., 0], np.eye(m) + (_t(vt) * shrink[..., None, :]) @ vt


def rba_weights(y: np.ndarray, d: np.ndarray, cdd: np.ndarray, b: np.ndarray, jac: np.ndarray, k: float, cbb: np.ndarray | None = None, transposed: bool = True) -> np.ndarray:
    """Bias-regularised weights X; b: q bias, jac: q x q bias sensitivity. transposed=False is the variant with J in place of J^T in the residual."""
    q, m = y.shape[-2:]
    s = y - y.mean(axis=-1, keepdims=True)
    ss, one = s @ _t(s), np.eye(q)
    ratio = one if cbb is None else (cdd / cbb)[..., None] * one
    if transposed:
        jr = _t(jac)
        c = _noise(cdd, m) + (one + jr) @ (one + jac) @ ss + k * ratio @ jr @ jac @ ss
    else:
        jr = jac
        c = _noise(cdd, m) + (one + jac) @ ss @ _t(one + jac) + k * ratio @ jac @ ss @ _t(jac)
    biased = b[..., None]
    residual = (one + jr) @ (d - y - biased) - k * ratio @ jr @ np.broadcast_to(biased, y.shape)
    return _t(s) @ np.linalg.solve(c, residual)


def apply_weights(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    return rows + (rows - rows.mean(axis=-1, keepdims=True)) @ x


def apply_square_root(rows: np.ndarray, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    mean = rows.mean(axis=-1, keepdims=True)
    return mean + (rows - mean) @ w[..., None] + (rows - mean) @ t


def inflated(rows: np.ndarray, rho: float) -> np.ndarray:
    mean = rows.mean(axis=-1, keepdims=True)
    return mean + rho * (rows - mean)


def rk4(derivative: Callable, psi: np.ndarray, params: np.ndarray, t: float, dt: float) -> np.ndarray:
    """One step of the classical scheme for all members (columns) at once."""
    k1 = derivative(t, psi, params)
    k2 = derivative(t + dt / 2, psi + dt / 2 * k1, params)
    k3 = derivative(t + dt / 2, psi + dt / 2 * k2, params)
    k4 = derivative(t + dt, psi + dt * k3, params)
    return psi + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4)


def perturbations(series: int, cycle: int, shape: tuple[int, int], seed: int = 0) -> np.ndarray:
    """Standard normal numbers that depend on series and cycle alone."""
    return np.random.default_rng([seed, series & 0x7FFFFFFF, cycle & 0x7FFFFFFF]).standard_normal(shape)


def random_reservoir(units: int, dims: int, connect: int = 3, seed: int = 0, dense_input: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(W, Win): an Erdos-Renyi matrix of unit spectral radius; an input matrix with one non-zero in each row (or dense)."""
    rng = np.random.default_rng(seed)
    win = rng.uniform(-1, 1, (units, dims + 1))
    if not dense_input:
        at = rng.integers(0, dims + 1, units)
        win = np.where(np.arange(dims + 1) == at[:, None], win, 0.0)
    w = rng.uniform(-1, 1, (units, units)) * (rng.random((units, units)) < connect / units)
    radius = np.abs(np.linalg.eigvals(w)).max()
    return (w / radius if radius > 0 else w), win


INPUT_BIAS, OUTPUT_BIAS = 0.1, 1.0


def reservoir_step(u: np.ndarray, r: np.ndarray, w: np.ndarray, win: np.ndarray, norm: np.ndarray, rho: float, sigma: float) -> np.ndarray:
    """Next state; u: dims x m, r: units x m (columns: series or members)."""
    inputs = np.vstack((u / norm[:, None], np.full((1, u.shape[1]), INPUT_BIAS)))
    return np.tanh(sigma * win @ inputs + rho * w @ r)


def readout(r: np.ndarray, wout: np.ndarray) -> np.ndarray:
    return wout.T @ np.vstack((r, np.full((1, r.shape[1]), OUTPUT_BIAS)))


def readout_jacobian(r: np.ndarray, wout: np.ndarray, win: np.ndarray, norm: np.ndarray, sigma: float) -> np.ndarray:
    """d(output)/d(input) at state r (units): rows outputs, columns inputs."""
    return wout[:-1].T @ ((1 - r * r)[:, None] * (sigma * win[:, :-1] / norm))
