"""Assimilation of an observation stream: one state for each series, carried by a stateful processor.

Observations (series_id, step, d array, cdd array) may come late or twice: within a micro-batch they are sorted by step, and those at or
before the series' clock are dropped and counted, and with ``dead_letters`` come out (status ``late`` or ``repeated``, all else null) beside the posteriors. Where a step holds several
observations, ``order`` names the columns that tell them apart: the clock is then (step, *order), so that all of a step are assimilated and
only true duplicates and late rows go. With ``event_time`` a watermark runs on that column, and a series whose newest observation lies ``idle_ms``
behind it is evicted; without it idleness is processing time. An evicted series keeps its clock alone: it starts anew with its next
observation, and late rows are still told as such. With a bias network the first state holds the observations of its washout. The state of a
series has typed fields (ensemble, clock, counters, network), 8 bytes a number. A null d or step isn't an observation and takes no part; an
empty stream gives nothing. Rows further behind the watermark than ``lateness`` are dropped by the engine, which counts them in its progress.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assimspark.plans.cycle import Config, Cycle, Reservoir

OUTPUT = "series_id long, step long, cycle long, y_mean array<double>, y_std array<double>, innovation array<double>, rejected boolean, n_dropped long, bias array<double>, status string"
#: A matrix is kept as its values by rows, with the number of members. The washout is kept only until it is over.
STATE = (
    "psi array<double>, params array<double>, m int, step long, n_seen long, n_rejected long, dropped long, clock array<long>, b array<double>, u array<double>, "
    "r array<double>, ready boolean, wash_step array<long>, wash_d array<double>, washed array<double>"
)


def _flat(x) -> list[float]:
    return [float(v) for v in np.asarray(x, float).ravel()]


class Assimilator(StatefulProcessor):
    def __init__(self, first: Callable, derivative: Callable, q: int, cfg: Config, observe: Callable | None, bias: Reservoir | None, idle_ms: int | None, order: tuple[str, ...] = (), by_event: bool = False, dead_letters: bool = False):
        self.first, self.derivative, self.q, self.cfg, self.observe, self.bias, self.idle_ms, self.order, self.by_event, self.dead_letters = first, derivative, q, cfg, observe, bias, idle_ms, order, by_event, dead_letters

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cycle", STATE)
        self.clock = handle.getValueState("clock", "clock array<long>, dropped long")  # outlives the eviction of the rest

    def _load(self, series: int) -> tuple[Cycle, int, tuple | None]:
        """The cycle, the number of dropped rows and the clock of a series."""
        make = lambda psi, params, step, wash=None: Cycle(psi, params, step, self.cfg, self.derivative, self.observe, self.q, self.bias, wash)
        if not self.state.exists():
            clock, dropped = self.clock.get() if self.clock.exists() else (None, 0)
            return make(*self.first(series)), dropped, tuple(clock) if clock is not None else None
        psi, params, m, step, n_seen, n_rejected, dropped, clock, b, u, r, ready, wash_step, wash_d, washed = self.state.get()
        table = lambda x, columns: np.asarray(x, float).reshape(-1, columns)
        c = make(table(psi, m), table(params, m), step)
        c.n_seen, c.n_rejected, c.b, c.u, c.bias_ready = n_seen, n_rejected, np.asarray(b, float), np.asarray(u, float), ready
        c.r = table(r, 1) if self.bias is not None else None
        c.wash, c.washed = dict(zip(wash_step, table(wash_d, self.q))), list(table(washed, self.q))
        return c, dropped, tuple(clock)

    def _save(self, c: Cycle, dropped: int, clock: tuple) -> None:
        wash = {} if c.bias_ready else c.wash
        self.clock.update((list(clock), dropped))
        network = ([] if c.r is None else _flat(c.r), bool(c.bias_ready), [int(k) for k in wash], _flat(list(wash.values())), _flat(c.washed))
        self.state.update((_flat(c.psi), _flat(c.params), int(c.psi.shape[1]), int(c.step), int(c.n_seen), int(c.n_rejected), dropped, list(clock), _flat(c.b), _flat(c.u), *network))

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        series = int(key[0])
        pdf = pd.concat(list(rows)).sort_values(["step", *self.order], kind="stable")
        c, dropped, clock = self._load(series)
        out = []
        for o in pdf.itertuples():
            now = (int(o.step), *(int(getattr(o, k)) for k in self.order))
            if clock is not None and now <= clock:
                dropped += 1
                if self.dead_letters:
                    out.append((series, int(o.step), None, None, None, None, None, dropped, None, "repeated" if now == clock else "late"))
                continue
            c.forecast(int(o.step))
            res = c.analyse(series, np.asarray(o.d, float), np.asarray(o.cdd, float))
            clock = now
            out.append((series, int(o.step), c.n_seen - 1, res["y_mean"], res["y_std"], res["innovation"], bool(res["rejected"]), dropped, res["bias"], "posterior"))
        self._save(c, dropped, clock)
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            newest = int(pdf["at_ms"].max()) if self.by_event else timers.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(newest + self.idle_ms)
        frame = pd.DataFrame(out, columns=[x.split(" ")[0] for x in OUTPUT.split(", ")])
        yield frame.astype({"cycle": "Int64", "rejected": "boolean"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_assimilate(obs: DataFrame, first: Callable, derivative: Callable, q: int, cfg: Config = Config(), observe: Callable | None = None, bias: Reservoir | None = None, idle_ms: int | None = 3_600_000, order: tuple[str, ...] = (), event_time: str | None = None, lateness: str = "1 hour", dead_letters: bool = False) -> DataFrame:
    """The stream (or batch) of posteriors, and of dead letters if wanted, told apart by ``status``. ``first`` gives (psi, params, step) of a new series, and (wash,) a dict from step to d, where a
    bias network is used; ``order`` are whole-number columns. Without ``idle_ms`` states stay (for runs over what there is now, which end).
    Needs the RocksDB state store."""
    obs.sparkSession.streams.active  # noqa: B018  starts the coordinator of state stores, which a batch run needs as well
    by_event = event_time is not None and idle_ms is not None
    rows = obs.where("step is not null and d is not null")
    times = [event_time, F.unix_millis(F.col(event_time)).alias("at_ms")] if by_event else []
    rows = (rows.withWatermark(event_time, lateness) if by_event else rows).select("series_id", "step", *order, "d", "cdd", *times)
    mode = "None" if idle_ms is None else "EventTime" if by_event else "ProcessingTime"
    return rows.groupBy("series_id").transformWithStateInPandas(Assimilator(first, derivative, q, cfg, observe, bias, idle_ms, order, by_event, dead_letters), outputStructType=OUTPUT, outputMode="Append", timeMode=mode)


def write_with_side_table(out: DataFrame, posteriors: str, dead_letters: str, checkpoint: str):  # noqa: ANN201
    """A writer of what there is now: posteriors to one folder, late and repeated rows to the other, each batch once."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for path, rows in ((posteriors, batch.where("status = 'posterior'")), (dead_letters, batch.where("status <> 'posterior'").select("series_id", "step", "n_dropped", "status"))):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that runs again takes its former place
        batch.unpersist()

    return out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class GridBayes(StatefulProcessor):
    def __init__(self, grid: np.ndarray, log_prior: np.ndarray, log_likelihood: Callable):
        self.grid, self.log_prior, self.ll = grid, log_prior, log_likelihood

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("log_likelihood", "held array<double>, clock long")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        held, clock = self.state.get() if self.state.exists() else (np.zeros(len(self.grid)), None)
        held = np.asarray(held, float)
        out = []
        for o in pd.concat(list(rows)).sort_values("step", kind="stable").itertuples():
            if clock is not None and o.step <= clock:
                continue
            held = held + self.ll(self.grid, o.d)  # the plain sum: a rounding in each step would break ties between values of the grid
            log_p = self.log_prior + held
            p = np.exp(log_p - log_p.max())
            p /= p.sum() * (self.grid[1] - self.grid[0])
            clock = int(o.step)
            out.append((int(key[0]), clock, float(self.grid[p.argmax()]), float((self.grid * p).sum() / p.sum())))
        self.state.update((_flat(held), clock))
        yield pd.DataFrame(out, columns=["series_id", "step", "x_map", "x_mean"])

    def close(self) -> None:
        pass


def stream_grid_bayes(obs: DataFrame, grid: np.ndarray, log_prior: np.ndarray, log_likelihood: Callable) -> DataFrame:
    """The posterior of one observation is the prior of the next; the most likely (the smallest of equals) and the mean value after each."""
    obs.sparkSession.streams.active  # noqa: B018  as above
    return obs.select("series_id", "step", "d").groupBy("series_id").transformWithStateInPandas(GridBayes(grid, log_prior, log_likelihood), outputStructType="series_id long, step long, x_map double, x_mean double", outputMode="Append", timeMode="None")


class LargestTruth(StatefulProcessor):
    """Divides the error of each window by the largest truth of its series and dim up to the window's end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("largest", "largest double")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("start", kind="stable")  # windows close in order, so later batches have later ones
        held = self.state.get()[0] if self.state.exists() else -np.inf
        largest = np.maximum(np.maximum.accumulate(pdf["largest"].to_numpy(float)), held)
        self.state.update((float(largest[-1]),))
        pdf = pdf.assign(scale=largest)
        pdf["err"] = np.where(largest != 0, pdf["err"] / np.where(largest != 0, largest, 1), np.nan)
        yield pdf[["start", "end", "series_id", "dim", "err", "scale", "n"]]

    def close(self) -> None:
        pass


def stream_interval_error(stream: DataFrame, window: str, lateness: str) -> DataFrame:
    """(start, end, series_id, dim, err, scale, n): mean absolute error of each tumbling window, series and dim over the largest truth (``scale``) of that series
    and dim so far, from rows (ts, series_id, dim, y, e). Later rows than ``lateness`` are dropped; rows with a null y or e don't count, a window without
    others has no row; a largest truth of 0 gives NaN. Needs the RocksDB state store."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in ("series_id", "dim")}
    whole = stream.where("y is not null and e is not null").withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("window"), "series_id", "dim")
    closed = whole.agg(F.avg(F.abs(F.col("y") - F.col("e"))).alias("err"), F.max("y").alias("largest"), F.count("*").alias("n"))
    rows = closed.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "series_id", "dim", "err", F.col("largest").cast("double").alias("largest"), "n")
    schema = f"start timestamp, end timestamp, series_id {kinds['series_id']}, dim {kinds['dim']}, err double, scale double, n long"
    return rows.groupBy("series_id", "dim").transformWithStateInPandas(LargestTruth(), outputStructType=schema, outputMode="Append", timeMode="None")
