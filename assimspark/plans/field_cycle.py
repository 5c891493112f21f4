"""Assimilation of fields: an ensemble of reservoir networks forecasts mode coefficients in closed loop, sensors correct them, again and again.

The state of a member is its reservoir and the coefficients that it forecasts next. At an observation the sensors' values of each member follow from the
modes at the sensors; reservoir, coefficients and values are updated together by the weights of an ensemble filter (any row a becomes
a + (a - mean) X, or its square-root form), and the next input of the network is the updated coefficients. Nothing of a field's size is in a
task: those see coefficients, reservoirs and sensors; errors of fields are joins and sums over points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assimspark.functions import kernels
from assimspark.plans.cycle import Reservoir

RESULT = "series_id long, config_id long, cycle long, step long, before array<double>, after array<double>, spread double"


@dataclass(frozen=True)
class FieldConfig:
    """``jitter``: deviation of the members' washouts; ``m``: members."""

    method: str = "ensrkf"
    m: int = 10
    inflation: float = 1.0
    jitter: float = 0.1
    seed: int = 0


class FieldCycle:
    """One series: members are columns."""

    def __init__(self, series: int, wash: np.ndarray, step: int, cfg: FieldConfig, net: Reservoir, look: np.ndarray, offset: np.ndarray):
        self.series, self.cfg, self.net, self.look, self.offset, self.step = series, cfg, net, look, offset, step
        rng = np.random.default_rng([cfg.seed, series & 0x7FFFFFFF])
        self.r = np.zeros((len(net.w), cfg.m))
        for u in wash:
            self.u = u[:, None] + cfg.jitter * rng.standard_normal((len(u), cfg.m))
            self._turn()
        self.step = step + 1

    def _turn(self) -> None:
        n = self.net
        self.r = kernels.reservoir_step(self.u, self.r, n.w, n.win, n.norm, n.rho, n.sigma)
        self.u = kernels.readout(self.r, n.wout)

    def forecast(self, to_step: int) -> None:
        for _ in range(self.step, to_step):
            self._turn()
        self.step = max(self.step, to_step)

    def analyse(self, cycle: int, d: np.ndarray, cdd: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Mean coefficients before and after, and the members' spread after."""
        y, cfg, before = self.offset[:, None] + self.look @ self.u, self.cfg, self.u.mean(axis=1)
        rows = np.vstack((self.r, self.u, y))
        if cfg.method == "ensrkf":
            done = kernels.apply_square_root(rows, *kernels.ensrkf_weights(y, d, cdd))
        elif cfg.method == "enkf":
            many = d[:, None] + np.sqrt(cdd)[:, None] * kernels.perturbations(self.series, cycle, y.shape, cfg.seed)
            done = kernels.apply_weights(rows, kernels.enkf_weights(y, many, cdd))
        else:
            raise ValueError(f"no filter {cfg.method}")
        done = kernels.inflated(done, cfg.inflation)
        self.r, self.u = done[:len(self.r)], done[len(self.r):len(self.r) + len(self.u)]
        return before, self.u.mean(axis=1), float(self.u.std(axis=1).mean())


def assimilate_fields(start: DataFrame, obs: DataFrame, configs: DataFrame, net: Reservoir, look: np.ndarray, offset: np.ndarray, base: FieldConfig = FieldConfig()) -> DataFrame:
    """Cycles of all series and configurations: one row for each observation (see RESULT).

    ``start``: series_id, step (of the last washout sample), u (array of samples); ``obs``: series_id, cycle, step, d (the sensors' values), cdd; ``configs``:
    config_id and fields of FieldConfig. ``look`` and ``offset`` give the sensors' values from coefficients. A series' rows stream through one
    task in order of step. Observations up to the washout's last step, or with a null, are left out; a series without observations, or without
    a start, has no rows; several observations of a step count in order of cycle.
    """
    fields = [c for c in configs.columns if c != "config_id"]
    none = F.lit(None)
    seen = obs.where("d is not null and cdd is not null and step is not null")
    begin = start.join(seen.select("series_id").distinct(), "series_id", "left_semi").crossJoin(F.broadcast(configs)).select("series_id", "config_id", F.lit(0).alias("o"), none.cast("long").alias("cycle"), F.col("step").cast("long").alias("step"), "u", none.cast("array<double>").alias("d"), none.cast("array<double>").alias("cdd"), *fields)
    later = seen.join(start.select("series_id", F.col("step").alias("washed")), "series_id").where("step > washed").crossJoin(F.broadcast(configs.select("config_id")))
    later = later.select("series_id", "config_id", F.lit(1).alias("o"), F.col("cycle").cast("long"), F.col("step").cast("long"), none.cast(begin.schema["u"].dataType).alias("u"), F.col("d").cast("array<double>"), F.col("cdd").cast("array<double>"), *(none.cast(begin.schema[c].dataType).alias(c) for c in fields))
    rows = begin.unionByName(later).repartition("series_id", "config_id").sortWithinPartitions("series_id", "config_id", "o", "step", "cycle")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, key, names = None, None, [x.split(" ")[0] for x in RESULT.split(", ")]
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if row["o"] == 0:
                    key = (int(row["series_id"]), int(row["config_id"]))
                    own = {f: type(getattr(base, f))(row[f]) for f in fields}
                    c = FieldCycle(key[0], np.stack([np.asarray(u, float) for u in row["u"]]), int(row["step"]), FieldConfig(**{**base.__dict__, **own}), net, look, offset)
                    continue
                c.forecast(int(row["step"]))
                out.append((*key, int(row["cycle"]), int(row["step"]), *c.analyse(int(row["cycle"]), np.asarray(row["d"], float), np.asarray(row["cdd"], float))))
            if out:
                yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(work, RESULT)


def at_points(modes: DataFrame, coefficients: Column) -> Column:
    """A field's value at a point from coefficients (an array): q_mean + psi . coefficients; ``psi`` and ``q_mean`` are columns of ``modes``."""
    return F.col("q_mean") + F.aggregate(F.zip_with("psi", coefficients, lambda p, c: p * c), F.lit(0.0), lambda a, x: a + x)


def field_errors(found: DataFrame, truth: DataFrame, modes: DataFrame, scale: list[float]) -> DataFrame:
    """(series_id, config_id, cycle, step, rms_before, rms_after): root of the mean squared error of the whole field over that of its values, before and after each analysis.

    ``truth``: series_id, step, point_id, value. Coefficients times ``scale`` go with the modes.
    """
    s = F.array(*(F.lit(float(x)) for x in scale))
    scaled = found.select("series_id", "config_id", "cycle", "step", *(F.zip_with(c, s, lambda x, y: x * y).alias(c) for c in ("before", "after")))
    met = truth.join(modes, "point_id").join(scaled, ["series_id", "step"])
    square = lambda c: F.sum(F.pow(F.col("value") - at_points(modes, F.col(c)), F.lit(2.0)))
    size = F.sum(F.col("value") * F.col("value"))
    return met.groupBy("series_id", "config_id", "cycle", "step").agg(F.sqrt(square("before") / size).alias("rms_before"), F.sqrt(square("after") / size).alias("rms_after"))
