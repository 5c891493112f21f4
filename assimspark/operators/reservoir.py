"""Reservoir networks: training by partial Gram sums, closed-loop forecasts, grid search, ensembles.

``series`` tables are packed: series_id, u array<array<double>> (steps x dims). Weights are one small object, given to tasks by closure."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assimspark.functions import kernels
from assimspark.functions.sums import sum_matrices
from assimspark.plans.cycle import Reservoir


def pack_series(long: DataFrame, value: str = "y") -> DataFrame:
    """(series_id, step, dim, value) as series_id, u."""
    rows = long.groupBy("series_id", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", value))), lambda s: s[value]).alias("v"))
    return rows.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "v"))), lambda s: s["v"]).alias("u"))


def states_of(u: np.ndarray, model: Reservoir, r: np.ndarray | None = None) -> np.ndarray:
    """Open loop over u (steps x dims): the state after each input (steps x units)."""
    r = np.zeros((len(model.w), 1)) if r is None else r
    out = np.empty((len(u), len(model.w)))
    for k, x in enumerate(u):
        r = kernels.reservoir_step(x[:, None], r, model.w, model.win, model.norm, model.rho, model.sigma)
        out[k] = r[:, 0]
    return out


def reservoir_states(series: DataFrame, model: Reservoir, n_wash: int = 0) -> DataFrame:
    """series_id, step, r, u_next for each step after the washout."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sid, u in zip(pdf["series_id"], pdf["u"]):
                r = states_of(np.stack(u), model)[n_wash:]
                y = [kernels.readout(x[:, None], model.wout)[:, 0] for x in r] if model.wout is not None else [np.zeros(0)] * len(r)
                yield pd.DataFrame({"series_id": sid, "step": np.arange(n_wash, n_wash + len(r)), "r": list(r), "u_next": y})

    return series.select("series_id", "u").mapInPandas(work, "series_id long, step long, r array<double>, u_next array<double>")


def side_by_side(us: list[np.ndarray], model: Reservoir) -> list[np.ndarray]:
    """states_of for many inputs at once, each from a zero state: inputs are columns of one state matrix, longer ones first."""
    order = sorted(range(len(us)), key=lambda i: -len(us[i]))
    lengths = np.array([len(us[i]) for i in order])
    out = [np.empty((len(us[i]), len(model.w))) for i in order]
    dims = us[0].shape[1] if us else 0
    padded = np.zeros((len(order), int(lengths.max(initial=0)), dims))
    for k, i in enumerate(order):
        padded[k, :len(us[i])] = us[i]
    r = np.zeros((len(model.w), len(order)))
    for t in range(padded.shape[1]):
        m = int(np.searchsorted(-lengths, -t))  # inputs longer than t
        r[:, :m] = kernels.reservoir_step(padded[:m, t].T, r[:, :m], model.w, model.win, model.norm, model.rho, model.sigma)
        for k in range(m):
            out[k][t] = r[:, k]
    back = [np.zeros(0)] * len(us)
    for k, i in enumerate(order):
        back[i] = out[k]
    return back


#: Inputs that a task runs side by side.
COLUMNS = 32


def _gram(r: np.ndarray, y: np.ndarray) -> np.ndarray:
    r = np.hstack((r, np.full((len(r), 1), kernels.OUTPUT_BIAS)))
    return r.T @ np.hstack((r, y))


def partial_grams(series: DataFrame, models: list[Reservoir], n_wash: int, n_train: int) -> dict[int, np.ndarray]:
    """For each model the sum over all series of R'R and R'Y (columns after the units + 1 states). Series shorter than the washout add nothing."""

    def each(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        us = [np.stack(u)[:n_train] for u in pdf["u"] if len(u) >= n_wash + 2]
        us = [u for u in us if len(u) >= n_wash + 2]
        for at in range(0, len(us), COLUMNS):
            part = us[at:at + COLUMNS]
            for k, model in enumerate(models):
                for u, r in zip(part, side_by_side([u[:-1] for u in part], model)):
                    g = _gram(r[n_wash:], u[n_wash + 1:])
                    sums[k] = sums[k] + g if k in sums else g
        return sums

    return sum_matrices(series.select("u"), each)


def fading_steps(rho: float, error: float = 1e-10) -> int:
    """Steps after which a state of a network of spectral radius ``rho`` < 1 has forgotten where it began, up to ``error``."""
    if not 0 <= rho < 1:
        raise ValueError("only a network with a spectral radius below 1 forgets, so that a series can be cut")
    return max(1, int(np.ceil(np.log(error) / np.log(rho)))) if rho else 1


def pack_chunks(long: DataFrame, chunk: int = 4096, overlap: int = 512, value: str = "y") -> DataFrame:
    """(series_id, step, dim, value) as blocks: series_id, chunk, first_step (of the series), steps, u, each with the ``overlap`` steps before it and one after.

    Steps count from a series' first one and place a row in its block, so a missing step shifts nothing. A step with a null value is missing.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("0 < overlap <= chunk")
    rows = long.groupBy("series_id", "step").agg(F.array_sort(F.collect_list(F.struct("dim", F.col(value).alias("v")))).alias("p"), F.count("*").alias("n"), F.count(value).alias("seen"))
    rows = rows.where("n = seen").select("series_id", F.col("step").cast("long").alias("step"), F.transform("p", lambda s: s["v"].cast("double")).alias("v"))
    rows = rows.join(rows.groupBy("series_id").agg(F.min("step").alias("first_step")), "series_id")
    at, own = F.col("step") - F.col("first_step"), F.expr(f"(step - first_step) div {chunk}")
    where = F.array_compact(F.array(own, F.when((at % chunk == 0) & (own > 0), own - 1), F.when(at % chunk >= chunk - overlap, own + 1)))
    placed = rows.withColumn("chunk", F.explode(where)).groupBy("series_id", "chunk", "first_step").agg(F.array_sort(F.collect_list(F.struct("step", "v"))).alias("p"))
    return placed.select("series_id", "chunk", "first_step", F.transform("p", lambda s: s["step"]).alias("steps"), F.transform("p", lambda s: s["v"]).alias("u"))


def _runs(pdf: pd.DataFrame, n_wash: int, chunk: int) -> list[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """Runs of steps without gaps: (series, steps, u, from, to), where from and to bound the states that count in this block: its own, past the washout of a run that begins in it."""
    out = []
    for sid, c, first, steps, u in zip(pdf["series_id"], pdf["chunk"], pdf["first_step"], pdf["steps"], pdf["u"]):
        steps, u = np.asarray(steps), np.stack(u)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(steps) != 1) + 1, [len(steps)]))
        own = first + c * chunk
        for a, b in zip(cuts, cuts[1:]):
            runs_in = a == 0 and c > 0 and steps[0] < own  # it may have begun long before
            begin = max(int(own - steps[a]), 0 if runs_in else n_wash)
            out.append((sid, steps[a:b], u[a:b], begin, min(b - a, int(own + chunk - steps[a]))))
    return out


def chunk_grams(chunks: DataFrame, models: list[Reservoir], n_wash: int, chunk: int, n_train: int | None = None) -> dict[int, np.ndarray]:
    """partial_grams of blocks as pack_chunks gives them: blocks of a series run in different tasks, and their sums add up.

    A block's first states come from the ``overlap`` steps before it, which must be at least ``n_wash`` and fading_steps; after a missing step the
    network starts anew with its washout.
    """

    def each(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for at in range(0, len(pdf), COLUMNS):
            part = pdf[at:at + COLUMNS]
            runs, firsts = [], dict(zip(part["series_id"], part["first_step"]))
            for sid, steps, u, begin, end in _runs(part, n_wash, chunk):
                limit = len(steps) - 1 if n_train is None else min(len(steps), int(firsts[sid] + n_train - steps[0])) - 1  # the last one is a target alone
                if begin < min(end, limit):
                    runs.append((u, begin, min(end, limit)))
            for k, model in enumerate(models):
                for (u, begin, end), r in zip(runs, side_by_side([u[:end] for u, _, end in runs], model)):
                    g = _gram(r[begin:end], u[begin + 1:end + 1])
                    sums[k] = sums[k] + g if k in sums else g
        return sums

    return sum_matrices(chunks, each)


def chunk_states(chunks: DataFrame, model: Reservoir, n_wash: int, chunk: int) -> DataFrame:
    """reservoir_states of blocks: series_id, step, r, u_next."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), COLUMNS):
                runs = [x for x in _runs(pdf[at:at + COLUMNS], n_wash, chunk) if x[3] < x[4]]
                for (sid, steps, _, begin, end), r in zip(runs, side_by_side([u[:end] for _, _, u, _, end in runs], model)):
                    kept = r[begin:end]
                    y = kernels.readout(kept.T, model.wout).T if model.wout is not None else np.zeros((len(kept), 0))
                    yield pd.DataFrame({"series_id": sid, "step": steps[begin:end], "r": list(kept), "u_next": list(y)})

    return chunks.select("series_id", "chunk", "first_step", "steps", "u").mapInPandas(work, "series_id long, step long, r array<double>, u_next array<double>")


def fit_long(long: DataFrame, model: Reservoir, n_wash: int, tikh: float, n_train: int | None = None, chunk: int = 4096, value: str = "y") -> Reservoir:
    """fit_readout for series of any length: no task sees more of a series than blocks of it."""
    overlap = max(n_wash, fading_steps(model.rho), 1)
    chunk = max(chunk, overlap)
    grams = chunk_grams(pack_chunks(long, chunk, overlap, value), [model], n_wash, chunk, n_train)
    if not grams:
        raise ValueError(f"no series has the {n_wash + 2} samples that a fit needs")
    return replace(model, wout=solve_readout(grams[0], tikh))


def solve_readout(gram: np.ndarray, tikh: float) -> np.ndarray:
    n = len(gram)
    return np.linalg.solve(gram[:, :n] + tikh * np.eye(n), gram[:, n:])


def fit_readout(series: DataFrame, model: Reservoir, n_wash: int, n_train: int, tikh: float) -> Reservoir:
    """Ridge regression of the next sample on [r; 1]. The driver sees (units + 1) x (units + 1 + dims) sums, whatever the number of series."""
    grams = partial_grams(series, [model], n_wash, n_train)
    if not grams:
        raise ValueError(f"no series has the {n_wash + 2} samples that a fit needs")
    return replace(model, wout=solve_readout(grams[0], tikh))


def closed_loop(model: Reservoir, r: np.ndarray, n: int) -> np.ndarray:
    out = []
    for _ in range(n):
        u = kernels.readout(r, model.wout)
        out.append(u[:, 0])
        r = kernels.reservoir_step(u, r, model.w, model.win, model.norm, model.rho, model.sigma)
    return np.stack(out)


def closed_loop_forecast(windows: DataFrame, model: Reservoir, n: int) -> DataFrame:
    """windows: series_id, window, u (the washout). The next n samples, each fed back as input: series_id, window, step, y."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sid, win, u in zip(pdf["series_id"], pdf["window"], pdf["u"]):
                y = closed_loop(model, states_of(np.stack(u), model)[-1][:, None], n)
                yield pd.DataFrame({"series_id": sid, "window": win, "step": np.arange(n), "y": list(y)})

    return windows.select("series_id", "window", "u").mapInPandas(work, "series_id long, window long, step long, y array<double>")


def search_hyperparameters(series: DataFrame, model: Reservoir, grid: list[tuple[float, float]], tikhs: list[float], n_wash: int, n_train: int, n_val: int, n_folds: int = 4) -> DataFrame:
    """Recycle validation over a (rho, sigma_in) grid: rho, sigma, tikh, score (mean log10 of the normalised error over folds and series).

    Grams are summed once for each grid point and serve all tikh values. Validation folds shift by (n_train - n_val - n_wash) // (n_folds - 1);
    a fold that isn't finite costs 10 n_folds. A series too short for a fold has no score for it."""
    models = [replace(model, rho=a, sigma=b) for a, b in grid]
    grams = partial_grams(series, models, n_wash, n_train)
    windows = series.select(F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: F.slice("u", f * _shift(n_wash, n_train, n_val, n_folds) + n_wash + 1, n_wash + 1 + n_val)), lambda w: F.size(w) == n_wash + 1 + n_val)).alias("u"))
    return _scores(windows, models, grams, tikhs, n_wash, n_val, n_folds)


def _shift(n_wash: int, n_train: int, n_val: int, n_folds: int) -> int:
    return max((n_train - n_val - n_wash) // max(n_folds - 1, 1), 1)


def search_long(long: DataFrame, model: Reservoir, grid: list[tuple[float, float]], tikhs: list[float], n_wash: int, n_train: int, n_val: int, n_folds: int = 4, chunk: int = 4096, value: str = "y") -> DataFrame:
    """search_hyperparameters for series of any length: sums come from blocks, and only the folds' windows are gathered."""
    models = [replace(model, rho=a, sigma=b) for a, b in grid]
    overlap = max(n_wash, *(fading_steps(m.rho) for m in models), 1)
    chunk = max(chunk, overlap)
    grams = chunk_grams(pack_chunks(long, chunk, overlap, value), models, n_wash, chunk, n_train)
    size, shift = n_wash + 1 + n_val, _shift(n_wash, n_train, n_val, n_folds)
    rows = long.join(long.groupBy("series_id").agg(F.min("step").alias("first_step")), "series_id").withColumn("at", F.col("step") - F.col("first_step") - n_wash)
    folds = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda f: (F.col("at") >= f * shift) & (F.col("at") < f * shift + size))
    steps = rows.select("series_id", F.explode(folds).alias("fold"), "step", "dim", F.col(value).cast("double").alias("v")).groupBy("series_id", "fold", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("v"))
    windows = steps.groupBy("series_id", "fold").agg(F.array_sort(F.collect_list(F.struct("step", "v"))).alias("p")).where(F.size("p") == size)
    return _scores(windows.select(F.transform("p", lambda s: s["v"]).alias("u")), models, grams, tikhs, n_wash, n_val, n_folds)


def _scores(windows: DataFrame, models: list[Reservoir], grams: dict[int, np.ndarray], tikhs: list[float], n_wash: int, n_val: int, n_folds: int) -> DataFrame:
    """Mean scores over windows of washout, first input and truth: all models, ridge weights and windows of a batch are columns of one state matrix."""
    fitted = [(k, t, solve_readout(grams[k], t)) for k in sorted(grams) for t in tikhs]
    rho, sigma = (np.array([getattr(models[k], f) for k, _, _ in fitted]) for f in ("rho", "sigma"))
    wout = np.stack([w for _, _, w in fitted]) if fitted else np.zeros((0, 1, 1))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf) if fitted else 0, COLUMNS):
                u = np.stack([np.stack(x) for x in pdf["u"][at:at + COLUMNS]])  # windows x steps x dims
                n, m, size = len(u), models[0], len(fitted)
                rhos, sigmas, outs = np.repeat(rho, n), np.repeat(sigma, n), np.repeat(wout, n, axis=0)

                def step(x: np.ndarray, r: np.ndarray) -> np.ndarray:
                    inputs = np.vstack((x / m.norm[:, None], np.full((1, x.shape[1]), kernels.INPUT_BIAS)))
                    return np.tanh(sigmas * (m.win @ inputs) + rhos * (m.w @ r))

                r = np.zeros((len(m.w), size * n))
                for t in range(n_wash + 1):
                    r = step(np.tile(u[:, t].T, size), r)
                square = np.zeros(size * n)
                with np.errstate(all="ignore"):
                    for t in range(n_val):
                        y = np.einsum("mud,um->dm", outs[:, :-1], r) + kernels.OUTPUT_BIAS * outs[:, -1].T
                        square += ((y - np.tile(u[:, n_wash + 1 + t].T, size)) ** 2).sum(axis=0)
                        r = step(y, r)
                    e = np.log10(square / (n_val * u.shape[2]) / np.mean(m.norm**2))
                e = np.where(np.isfinite(e), e, 10.0 * n_folds)
                yield pd.DataFrame({"rho": rhos, "sigma": sigmas, "tikh": np.repeat([t for _, t, _ in fitted], n), "e": e})

    return windows.mapInPandas(work, "rho double, sigma double, tikh double, e double").groupBy("rho", "sigma", "tikh").agg(F.avg("e").alias("score"))


def best_hyperparameters(scores: DataFrame) -> DataFrame:
    """The row of smallest score; of equals that of the smallest rho, sigma, tikh. No scores, no row."""
    return scores.agg(F.min(F.struct("score", "rho", "sigma", "tikh")).alias("x")).where("x is not null").select("x.*")


def jacobians(states: DataFrame, model: Reservoir) -> DataFrame:
    """The bias sensitivity -d(output)/d(input) at each state (series_id, step, r), row-major."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(jac=[-kernels.readout_jacobian(np.asarray(r), model.wout, model.win, model.norm, model.sigma).ravel() for r in pdf["r"]])[["series_id", "step", "jac"]]

    return states.select("series_id", "step", "r").mapInPandas(work, "series_id long, step long, jac array<double>")


def member_readouts(wout: np.ndarray, sigmas: np.ndarray) -> np.ndarray:
    """Readouts (m x rows x dims) whose singular values are each member's parameters (k x m)."""
    u, _, vh = np.linalg.svd(wout, full_matrices=False)
    return np.einsum("ik,km,kj->mij", u, sigmas, vh)


def data_driven_forecast(ens: DataFrame, model: Reservoir, n: int) -> DataFrame:
    """Members (series_id, member, r, sigmas) advanced in closed loop, each with a readout of its own singular values: member, step, y."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r = np.stack(pdf["r"].to_list()).T
            wouts = member_readouts(model.wout, np.stack(pdf["sigmas"].to_list()).T)
            for s in range(n):
                u = np.einsum("mij,im->jm", wouts, np.vstack((r, np.full((1, r.shape[1]), kernels.OUTPUT_BIAS))))
                yield pd.DataFrame({"series_id": pdf["series_id"], "member": pdf["member"], "step": s, "y": list(u.T)})
                r = kernels.reservoir_step(u, r, model.w, model.win, model.norm, model.rho, model.sigma)

    return ens.select("series_id", "member", "r", "sigmas").mapInPandas(work, "series_id long, member long, step long, y array<double>")


def sample_windows(series: DataFrame, n: int, length: int, seed: int = 0) -> DataFrame:
    """n (series_id, start) pairs in a keyed random order; ``series`` has series_id and n_steps."""
    starts = series.where(F.col("n_steps") >= length).select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_steps").cast("long") - length)).alias("start"))
    return starts.orderBy(F.xxhash64("series_id", "start", F.lit(seed)), "series_id", "start").limit(n)


def bias_training_set(obs: DataFrame, ensemble: DataFrame, n_lags: int, augmented: bool = False, n_cr: int | None = None, tol: float = 0.1) -> DataFrame:
    """obs (series_id, step, y_raw, y_true), ensemble (series_id, member, step, y): the members' series moved by their best and middle lags,
    and the innovations and biases of each copy, optionally with scaled copies.

    With ``n_cr`` members that stand still (range below ``tol`` over the last n_cr steps) go first, but for a few of them where they are many.
    Members without an observation in reach of a lag, and observations without a member, give no rows.
    """
    from assimspark.operators.align import augment, innovations, lag_search, shifted_copies
    from assimspark.operators.ensemble import drop_fixed, fixed_points

    if n_cr is not None:
        rows = ensemble.select("series_id", "member", "step", F.lit(0).alias("row_id"), F.col("y").alias("value"))
        keep = drop_fixed(fixed_points(rows, n_cr, tol)).where("keep")
        ensemble = ensemble.join(keep, ["series_id", "member"], "left_semi")
    lags = lag_search(obs.select("series_id", "step", F.col("y_raw").alias("d")), ensemble, n_lags)
    out = innovations(obs, shifted_copies(ensemble, lags), ["series_id", "step"]).select("series_id", "member", "copy", "step", "model_bias", "innovation")
    if not augmented:
        return out
    scaled = augment(out, "model_bias")
    return scaled.withColumn("innovation", F.col("innovation") * F.col("factor"))
