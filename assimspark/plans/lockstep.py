"""Cycles of many series side by side: one array psi[series, n, m] for all series of a block, which share a configuration.

In each turn every series of the block that has one more observation is forecast to it and analysed, all of them in the same matrix operations.
Observations stream through a task in order of turns, so it holds the ensembles of one block and the observations of one turn. A sweep of many
configurations over few series spreads over tasks by configuration. Bias networks advance one series at a time and stay with ``cycle.Cycle``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from assimspark.functions import kernels

#: Series of a block at most, on average.
BLOCK_SERIES = 256


def _side_by_side(x: np.ndarray) -> np.ndarray:
    """(series, rows, members) as rows x (series * members)."""
    return x.transpose(1, 0, 2).reshape(x.shape[1], x.shape[0] * x.shape[2])


def _apart(x: np.ndarray, m: int) -> np.ndarray:
    return x.reshape(len(x), -1, m).transpose(1, 0, 2)


class Cells:
    """The series of a block whose ensembles have one shape. ``n_seen`` counts the turns: each series takes part from the first one on without a gap."""

    def __init__(self, series: list[int], psi: np.ndarray, params: np.ndarray, step: np.ndarray, cfg, derivative: Callable, observe: Callable | None, q: int):
        self.series, self.psi, self.params, self.step, self.cfg = series, psi, params, step, cfg
        self.derivative, self.observe, self.q = derivative, observe or (lambda x: x[:q]), q
        self.b = np.zeros((len(series), q))
        self.n_seen = 0

    def look(self, which: np.ndarray) -> np.ndarray:
        return _apart(np.asarray(self.observe(_side_by_side(self.psi[which]))), self.psi.shape[-1])

    def forecast(self, which: np.ndarray, to: np.ndarray) -> None:
        """Series ``which`` up to their steps ``to``; those with the longest way come first, so the ones still on it are leading columns."""
        left = to - self.step[which]
        order = np.argsort(-left, kind="stable")
        way, who, m, dt = left[order], which[order], self.psi.shape[-1], self.cfg.dt
        psi, params = _side_by_side(self.psi[who]), _side_by_side(self.params[who])
        for s in range(max(0, int(way[0])) if len(way) else 0):
            n_open = int(np.searchsorted(-way, -s))
            now = self.step[who[:n_open]] + s
            t = now[0] * dt if (now == now[0]).all() else np.repeat(now * dt, m)
            psi[:, :n_open * m] = kernels.rk4(self.derivative, psi[:, :n_open * m], params[:, :n_open * m], t, dt)
        self.psi[who] = _apart(psi, m)
        self.step[which] = np.maximum(self.step[which], to)

    def analyse(self, which: np.ndarray, d: np.ndarray, cdd: np.ndarray) -> dict[str, np.ndarray]:
        """What ``cycle.Cycle.analyse`` does without a network, with a leading axis for the series."""
        cfg, y = self.cfg, self.look(which)
        rows = np.concatenate((self.psi[which], self.params[which], y), axis=1)
        par = slice(self.psi.shape[1], self.psi.shape[1] + self.params.shape[1])
        if cfg.method == "ensrkf":
            done = kernels.apply_square_root(rows, *kernels.ensrkf_weights(y, d, cdd))
        else:
            noise = np.stack([kernels.perturbations(self.series[i], self.n_seen, y.shape[1:], cfg.seed) for i in which])
            many = d[..., None] + np.sqrt(cdd)[..., None] * noise
            if cfg.method.startswith("rba") and self.n_seen >= cfg.n_blind:
                x = kernels.rba_weights(y, many, cdd, self.b[which], np.zeros((len(which), self.q, self.q)), cfg.k, None, cfg.method == "rba_enkf")
            else:
                x = kernels.enkf_weights(y, many, cdd)
            done = kernels.apply_weights(rows, x)
        if self.n_seen < cfg.n_hold_params:
            done[:, par] = rows[:, par]
        bad = np.zeros(len(which), bool)
        for p, (lo, hi) in zip(done[:, par].swapaxes(0, 1), cfg.limits):
            bad |= (p < (-np.inf if lo is None else lo)).any(axis=1) | (p > (np.inf if hi is None else hi)).any(axis=1)
        guarded = done[:, par] if self.params.shape[1] else done
        mean = guarded.mean(axis=-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            wide = cfg.guard & (np.where(mean != 0, guarded.std(axis=-1) / mean, 0) > 1).any(axis=1)
        kept = np.where(wide[:, None, None], done, kernels.inflated(done, cfg.inflation))
        kept = np.where(bad[:, None, None], kernels.inflated(rows, cfg.reject_inflation), kept)
        self.psi[which], self.params[which] = kept[:, :par.start], kept[:, par]
        seen, before = kept[:, par.stop:], self.b[which]
        after = seen.mean(axis=-1)
        self.b[which] = d - after
        return {"y_mean": after, "y_std": seen.std(axis=-1), "forecast_mean": y.mean(axis=-1), "innovation": d - after, "param_mean": kept[:, par].mean(axis=-1), "param_std": kept[:, par].std(axis=-1), "rejected": bad, "prior_params": rows[:, par].mean(axis=-1), "posterior_params": done[:, par].mean(axis=-1), "bias": before}

    def step_on(self) -> dict[str, np.ndarray]:
        """One step after the last observation."""
        every = np.arange(len(self.series))
        self.forecast(every, self.step + 1)
        y = self.look(every)
        mean, none = y.mean(axis=-1), np.zeros((len(every), 0))
        return {"y_mean": mean, "y_std": y.std(axis=-1), "forecast_mean": mean, "innovation": self.b, "param_mean": self.params.mean(axis=-1), "param_std": self.params.std(axis=-1), "rejected": np.zeros(len(every), bool), "prior_params": none, "posterior_params": none, "bias": self.b}


NAMES = ("y_mean", "y_std", "forecast_mean", "innovation", "param_mean", "param_std", "rejected", "prior_params", "posterior_params", "bias")


def _batch(series: list[int], config: int, cycles: list[int], steps: np.ndarray, found: dict[str, np.ndarray]) -> pa.RecordBatch:
    def column(x: np.ndarray) -> pa.Array:
        if x.ndim == 1:
            return pa.array(x)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, float).ravel()))

    fixed = [pa.array(series, pa.int64()), pa.array([config] * len(series), pa.int64()), pa.array(cycles, pa.int64()), pa.array(steps.astype(np.int64))]
    return pa.RecordBatch.from_arrays([*fixed, *(column(found[n]) for n in NAMES)], names=["series_id", "config_id", "cycle", "step", *NAMES])


class Block:
    """One block of series: starts in turn 0, then a turn of observations at a time."""

    def __init__(self, config: int, starts: list[dict], cfg, derivative: Callable, observe: Callable | None, q: int):
        self.config, shapes, self.place = config, {}, {}
        for row in starts:
            if row["series_id"] in self.place:
                raise ValueError(f"several start rows for series {row['series_id']}")
            self.place[row["series_id"]] = None
            psi = np.array(row["psi"], float)
            params = np.array(row["params"], float).reshape(-1, psi.shape[1])
            shapes.setdefault((psi.shape, params.shape), []).append((row["series_id"], psi, params, row["step"]))
        self.cells = []
        for members in shapes.values():
            series, psi, params, steps = zip(*members)
            self.cells.append(Cells(list(series), np.stack(psi), np.stack(params), np.array(steps, np.int64), cfg, derivative, observe, q))
            self.place |= {s: (self.cells[-1], i) for i, s in enumerate(series)}

    def turn(self, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for cells in self.cells:
            own = [(self.place[r["series_id"]][1], r) for r in rows if self.place[r["series_id"]][0] is cells]
            if own:
                which = np.array([i for i, _ in own])
                cells.forecast(which, np.array([r["step"] for _, r in own], np.int64))
                found = cells.analyse(which, np.array([r["d"] for _, r in own], float), np.array([r["cdd"] for _, r in own], float))
                yield _batch([cells.series[i] for i in which], self.config, [r["cycle"] for _, r in own], cells.step[which], found)
            cells.n_seen += 1

    def finish(self) -> Iterator[pa.RecordBatch]:
        for cells in self.cells:
            for _ in range(cells.cfg.extra_steps):
                found = cells.step_on()
                yield _batch(cells.series, self.config, [-1] * len(cells.series), cells.step, found)


def run(batches: Iterator[pa.RecordBatch], config_of: Callable[[dict], object], derivative: Callable, observe: Callable | None, q: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (config_id, __block, __turn) in, one row for each cycle and extra step out."""
    at, rows, block = None, [], None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal block
        if at is not None and at[2] == 0:
            if block is not None:
                yield from block.finish()
            block = Block(at[0], rows, config_of(rows[0]), derivative, observe, q)
        elif at is not None:
            yield from block.turn(rows)

    for batch in batches:
        for row in batch.to_pylist():
            here = (row["config_id"], row["__block"], row["__turn"])
            if here != at:
                yield from flush()
                at, rows = here, []
            rows.append(row)
    yield from flush()
    if block is not None:
        yield from block.finish()
