"""Sequential assimilation: cycles of each (series, configuration) in order, members - and without a bias network also series - side by side.

A model is two numpy callables: ``derivative(t, psi, params)`` for psi (n x columns) and params (n_params x columns), integrated by fixed-step RK4,
and ``observe(psi) -> y`` (default: its first q rows). A column is a member of an ensemble, of one series or of many; t is a number, or a row with
the time of each column where series are at different steps. Series are independent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assimspark.functions import kernels
from assimspark.plans import lockstep


@dataclass(frozen=True)
class Config:
    """Defaults of a cycle; sweeps override fields by columns of the same name."""

    method: str = "enkf"
    dt: float = 0.01
    inflation: float = 1.002
    reject_inflation: float = 1.002
    k: float = 1.0
    n_blind: int = 0
    n_hold_params: int = 0
    extra_steps: int = 0
    limits: tuple[tuple[float | None, float | None], ...] = field(default=())
    guard: bool = True
    seed: int = 0


@dataclass
class Reservoir:
    """A trained bias network for q observables. Its inputs are q innovations; its outputs are the q innovations ahead, or, where observations
    are biased themselves, q model biases and then q innovations. One network step is ``upsample`` model steps."""

    w: np.ndarray
    win: np.ndarray
    wout: np.ndarray
    norm: np.ndarray
    rho: float
    sigma: float
    upsample: int = 1


class Cycle:
    """State of one series: what the batch job and the stream both carry from one observation to the next.

    With a bias network, ``wash`` holds observations (step -> d) before the first analysis. Their differences to the model's mean drive the
    network open loop; from then on it runs in closed loop between observations. Until the washout is over the bias and its sensitivity are
    zero, and the innovation of the last analysis is its best guess; without a network that is all there is.
    """

    def __init__(self, psi: np.ndarray, params: np.ndarray, step: int, cfg: Config, derivative: Callable, observe: Callable | None, q: int, bias: Reservoir | None = None, wash: dict[int, np.ndarray] | None = None):
        self.psi, self.params, self.step, self.cfg = psi, params, step, cfg
        self.derivative, self.observe, self.q, self.bias = derivative, observe or (lambda x: x[:q]), q, bias
        self.n_seen = self.n_rejected = 0
        self.b, self.u = np.zeros(q), np.zeros(q)  # bias and innovation
        self.r = np.zeros((len(bias.w), 1)) if bias else None
        self.wash = dict(sorted((wash or {}).items())) if bias else {}
        self.washed: list[np.ndarray] = []
        self.bias_ready = False
        self._look()

    def _look(self) -> None:
        """At a washout step, keep the difference to the model; at the last one start the network."""
        if self.bias_ready or self.step not in self.wash:
            return
        self.washed.append(self.wash[self.step] - self.observe(self.psi).mean(axis=1))
        if self.step == max(self.wash):
            self.r, outputs = np.zeros((len(self.bias.w), 1)), np.concatenate((self.b, self.washed[0]))
            for u in self.washed[:-1]:
                self.r = self._network(u, self.r)
                outputs = kernels.readout(self.r, self.bias.wout)[:, 0]
            self._take(outputs)
            self.bias_ready, self.washed = True, []

    def _network(self, u: np.ndarray, r: np.ndarray) -> np.ndarray:
        n = self.bias
        return kernels.reservoir_step(u[:, None], r, n.w, n.win, n.norm, n.rho, n.sigma)

    def _take(self, outputs: np.ndarray) -> None:
        self.b, self.u = outputs[:self.q], outputs[-self.q:]

    def _bias_ahead(self, n: int) -> None:
        """n model steps of the network in closed loop; within a network step states and outputs are interpolated."""
        whole, part = divmod(n, self.bias.upsample)
        outputs = np.concatenate((self.b, self.u))[-self.bias.wout.shape[1]:]
        for k in range(whole + (part > 0)):
            r = self._network(self.u, self.r)
            ahead = kernels.readout(r, self.bias.wout)[:, 0]
            share = part / self.bias.upsample if k == whole else 1.0
            outputs, self.r = outputs + share * (ahead - outputs), self.r + share * (r - self.r)
            self._take(outputs)

    def forecast(self, to_step: int) -> None:
        """Model and bias up to a step; a network that starts on the way runs from where its washout ends."""
        begun = self.step if self.bias_ready else None
        for s in range(self.step, to_step):
            self.psi = kernels.rk4(self.derivative, self.psi, self.params, s * self.cfg.dt, self.cfg.dt)
            self.step = s + 1
            if not self.bias_ready and self.wash:
                self._look()
                begun = self.step if self.bias_ready else None
        if begun is not None and self.step > begun:
            self._bias_ahead(self.step - begun)

    def analyse(self, series: int, d: np.ndarray, cdd: np.ndarray) -> dict:
        """Forecast statistics, the analysis with bounds check and inflation, and the bias from the new innovation."""
        cfg, y = self.cfg, self.observe(self.psi)
        rows = np.vstack((self.psi, self.params, y))
        n, n_par = len(self.psi), len(self.params)
        aware = cfg.method.startswith("rba") and self.n_seen >= cfg.n_blind
        ready = self.bias is not None and self.bias_ready
        if cfg.method.startswith("rba") and ready and self.bias.wout.shape[1] == 2 * self.q:
            d = d + self.b - self.u  # biased observations are shifted, for the filter and for the innovation after it
        many = d[:, None] + np.sqrt(cdd)[:, None] * kernels.perturbations(series, self.n_seen, y.shape, cfg.seed)
        if cfg.method == "ensrkf":
            done = kernels.apply_square_root(rows, *kernels.ensrkf_weights(y, d, cdd))
        elif aware:
            jac = -kernels.readout_jacobian(self.r[:, 0], self.bias.wout, self.bias.win, self.bias.norm, self.bias.sigma)[:self.q] if ready else np.zeros((self.q, self.q))
            done = kernels.apply_weights(rows, kernels.rba_weights(y, many, cdd, self.b, jac, cfg.k, None, cfg.method == "rba_enkf"))
        else:
            done = kernels.apply_weights(rows, kernels.enkf_weights(y, many, cdd))
        if self.n_seen < cfg.n_hold_params:
            done[n:n + n_par] = rows[n:n + n_par]
        bad = any((lo is not None and (p < lo).any()) or (hi is not None and (p > hi).any()) for p, (lo, hi) in zip(done[n:n + n_par], cfg.limits))
        if bad:
            self.n_rejected += 1
            kept = kernels.inflated(rows, cfg.reject_inflation)
        else:
            guarded = done[n:n + n_par] if n_par else done
            mean = guarded.mean(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                wide = cfg.guard and np.any(np.where(mean != 0, guarded.std(axis=1) / mean, 0) > 1)
            kept = done if wide else kernels.inflated(done, cfg.inflation)
        prior, post = rows[n:n + n_par].mean(axis=1), done[n:n + n_par].mean(axis=1)
        self.psi, self.params = kept[:n], kept[n:n + n_par]
        after = kept[n + n_par:].mean(axis=1)
        before = self.b
        self.b = self.u = d - after
        self.n_seen += 1
        return {"y_mean": after, "y_std": kept[n + n_par:].std(axis=1), "innovation": d - after, "bias": before, "rejected": bad, "prior_params": prior, "posterior_params": post, "param_mean": self.params.mean(axis=1), "param_std": self.params.std(axis=1), "forecast_mean": y.mean(axis=1)}


RESULT = "series_id long, config_id long, cycle long, step long, y_mean array<double>, y_std array<double>, forecast_mean array<double>, innovation array<double>, param_mean array<double>, param_std array<double>, rejected boolean, prior_params array<double>, posterior_params array<double>, bias array<double>"


def _matrix(table, n_cols: int | None = None) -> np.ndarray:
    rows = [np.asarray(v, float) for v in table]
    return np.stack(rows) if rows else np.zeros((0, n_cols or 0))


def assimilate(start: DataFrame, obs: DataFrame, configs: DataFrame, derivative: Callable, q: int, base: Config = Config(), observe: Callable | None = None, bias: Reservoir | None = None) -> DataFrame:
    """Batch cycles over observations.

    ``start``: series_id, step, psi array<array<double>> (rows of members), params array<array<double>>, and with a bias network optionally
    wash array<struct<step, d array<double>>>, observations before the first cycle; ``obs``: series_id, cycle, step, d array<double>, cdd
    array<double>; ``configs``: config_id and any fields of Config. One row comes back for each cycle and one more for each of
    ``extra_steps`` after the last observation (cycle -1, on which the bias goes on). ``bias`` is the network's forecast of the bias.

    Without a bias network all series of a block advance side by side (``lockstep``), at most ``lockstep.BLOCK_SERIES`` to a block on average, so
    that a task holds the ensembles of one block. With one, a series is one stream of rows sorted by step within a task, its ensemble on the
    first of them; a task holds one Arrow batch, however long a series is. A series without observations gives no rows, nor does an observation
    without a step, d or cdd; a start without a step or psi is none, null params are no parameters; of several observations at one step all
    count, in order of cycle; repeated start rows are refused by the task that meets them; other columns are ignored.
    """
    fields = [c for c in configs.columns if c != "config_id"]
    obs = obs.where("step is not null and d is not null and cdd is not null")
    start = start.where("step is not null and psi is not null").withColumn("params", F.coalesce("params", F.array().cast("array<array<double>>")))
    first = start.join(obs.select("series_id").distinct(), "series_id", "left_semi").crossJoin(F.broadcast(configs))
    later = obs.join(start.select("series_id").distinct(), "series_id", "left_semi").select("series_id", *(F.col(c).cast("long").alias(c) for c in ("cycle", "step")), *(F.col(c).cast("array<double>").alias(c) for c in ("d", "cdd")))
    if bias is None:
        return _by_turns(start, first, later, configs, fields, derivative, q, base, observe)
    return _by_series(first, later, configs, fields, derivative, q, base, observe, bias)


def _config(base: Config, fields: list[str], row: dict) -> Config:
    cfg = Config(**{**base.__dict__, **{f: (row[f].item() if hasattr(row[f], "item") else row[f]) for f in fields}})
    return replace(cfg, **{f: int(getattr(cfg, f)) for f in ("n_blind", "n_hold_params", "extra_steps", "seed")})


def _by_turns(start: DataFrame, first: DataFrame, later: DataFrame, configs: DataFrame, fields: list[str], derivative: Callable, q: int, base: Config, observe: Callable | None) -> DataFrame:
    """Blocks of series in turns. Partitions are asked for by number: rows are few bytes for their work, so they mustn't be merged by size."""
    context = start.sparkSession.sparkContext
    n_series, n_configs = start.count(), max(1, configs.count())
    tasks = max(4 * context.defaultParallelism, int(start.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = max(1, -(-n_series // lockstep.BLOCK_SERIES), min(-(-n_series // 8), -(-tasks // n_configs)))
    block = F.pmod(F.xxhash64("series_id"), F.lit(n)).alias("__block")
    none = F.lit(None)
    begin = first.select("series_id", "config_id", block, F.lit(0).alias("__turn"), none.cast("long").alias("cycle"), F.col("step").cast("long").alias("step"), *(none.cast("array<double>").alias(c) for c in ("d", "cdd")), "psi", "params", *fields)
    turns = later.withColumn("__turn", F.row_number().over(Window.partitionBy("series_id").orderBy("step", "cycle"))).crossJoin(F.broadcast(configs.select("config_id")))
    then = turns.select("series_id", "config_id", block, "__turn", "cycle", "step", "d", "cdd", *(none.cast(begin.schema[c].dataType).alias(c) for c in ("psi", "params", *fields)))
    rows = begin.unionByName(then).repartition(min(n * n_configs, tasks), "config_id", "__block").sortWithinPartitions("config_id", "__block", "__turn", "series_id")
    return rows.mapInArrow(lambda batches: lockstep.run(batches, lambda row: _config(base, fields, row), derivative, observe, q), RESULT)


def _by_series(first: DataFrame, later: DataFrame, configs: DataFrame, fields: list[str], derivative: Callable, q: int, base: Config, observe: Callable | None, bias: Reservoir) -> DataFrame:
    """One series after the other in each task."""
    none = F.lit(None)
    washed = "wash" in first.columns
    begin = first.select("series_id", "config_id", F.lit(0).alias("__o"), none.cast("long").alias("cycle"), F.col("step").cast("long").alias("step"), none.cast("array<double>").alias("d"), none.cast("array<double>").alias("cdd"), "psi", "params", (F.col("wash") if washed else none.cast("array<struct<step:bigint,d:array<double>>>")).alias("wash"), *fields)
    nulls = [none.cast(begin.schema[c].dataType).alias(c) for c in ("psi", "params", "wash", *fields)]
    then = later.crossJoin(F.broadcast(configs.select("config_id"))).select("series_id", "config_id", F.lit(1).alias("__o"), "cycle", "step", "d", "cdd", *nulls)
    session = first.sparkSession
    tasks = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    rows = begin.unionByName(then).repartition(tasks, "series_id", "config_id").sortWithinPartitions("series_id", "config_id", "__o", "step", "cycle")

    def extra(c: Cycle, key: tuple[int, int]) -> list[tuple]:
        out, empty = [], np.zeros(0)
        for _ in range(c.cfg.extra_steps):
            c.forecast(c.step + 1)
            y = c.observe(c.psi)
            out.append((*key, -1, c.step, y.mean(axis=1), y.std(axis=1), y.mean(axis=1), c.u.copy(), c.params.mean(axis=1), c.params.std(axis=1), False, empty, empty, c.b.copy()))
        return out

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, key, names = None, None, [x.split(" ")[0] for x in RESULT.split(", ")]
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if row["__o"] == 0:
                    out += extra(c, key) if c is not None else []
                    if key == (row["series_id"], row["config_id"]):
                        raise ValueError(f"several start rows for series {row['series_id']}")
                    key = (int(row["series_id"]), int(row["config_id"]))
                    cfg = _config(base, fields, row)
                    psi = _matrix(row["psi"])
                    wash = {int(w["step"]): np.asarray(w["d"], float) for w in row["wash"]} if row["wash"] is not None else None
                    c = Cycle(psi, _matrix(row["params"], psi.shape[1]), int(row["step"]), cfg, derivative, observe, q, bias, wash)
                    continue
                c.forecast(int(row["step"]))
                res = c.analyse(key[0], np.asarray(row["d"], float), np.asarray(row["cdd"], float))
                out.append((*key, int(row["cycle"]), int(row["step"]), *(res[k] for k in ("y_mean", "y_std", "forecast_mean", "innovation", "param_mean", "param_std")), bool(res["rejected"]), res["prior_params"], res["posterior_params"], res["bias"]))
            if out:
                yield pd.DataFrame(out, columns=names)
        if c is not None and (out := extra(c, key)):
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(work, RESULT)


def rejected_analyses(result: DataFrame) -> DataFrame:
    """Cycles whose analysis left the limits: posterior and prior means of each parameter."""
    pairs = F.posexplode(F.arrays_zip("prior_params", "posterior_params")).alias("param", "p")
    return result.where("rejected").select("series_id", "config_id", "cycle", "step", pairs).select("series_id", "config_id", "cycle", "step", "param", F.col("p.prior_params").alias("prior"), F.col("p.posterior_params").alias("posterior"))


def forecast_ensemble(start: DataFrame, derivative: Callable, n_steps: int, dt: float, every: int = 1) -> DataFrame:
    """Each member advanced by its own parameters: rows (series_id, member, step, psi array, params array), batches of members side by side."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for step0, part in pdf.groupby("step"):
                psi, params = _matrix(part["psi"]).T, _matrix(part["params"]).T
                for s in range(1, n_steps + 1):
                    psi = kernels.rk4(derivative, psi, params, (step0 + s - 1) * dt, dt)
                    if s % every == 0 or s == n_steps:
                        yield pd.DataFrame({"series_id": part["series_id"], "member": part["member"], "step": step0 + s, "psi": list(psi.T), "params": list(params.T)})

    return start.select("series_id", "member", "step", "psi", "params").mapInPandas(work, "series_id long, member long, step long, psi array<double>, params array<double>")


def forecast_mean(start: DataFrame, derivative: Callable, n_steps: int, dt: float) -> DataFrame:
    """Only the ensemble mean is integrated; each member keeps its deviation from it."""
    long = start.select("series_id", "member", "step", F.posexplode("psi").alias("row", "v"), "params")
    means = long.groupBy("series_id", "step", "row").agg(F.avg("v").alias("v")).groupBy("series_id", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "v"))), lambda x: x["v"]).alias("mean"))
    par = start.select("series_id", F.posexplode("params").alias("row", "p")).groupBy("series_id", "row").agg(F.avg("p").alias("p")).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "p"))), lambda x: x["p"]).alias("params"))
    one = means.join(par, "series_id", "left").select("series_id", F.lit(0).cast("long").alias("member"), "step", F.col("mean").alias("psi"), F.coalesce("params", F.array().cast("array<double>")).alias("params"))
    ahead = forecast_ensemble(one, derivative, n_steps, dt).select("series_id", "step", F.col("psi").alias("moved"))
    apart = start.join(means, ["series_id", "step"]).select("series_id", "member", F.zip_with("psi", "mean", lambda x, m: x - m).alias("dev"))
    return ahead.join(apart, "series_id").select("series_id", "member", "step", F.zip_with("moved", "dev", lambda a, b: a + b).alias("psi"))
