"""Alignment of time axes and of data with models: interpolation, pairing, lags, peaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assimspark.functions.names import own_names
from assimspark.operators.timegrid import neighbours


def interpolate_to(times: DataFrame, series: DataFrame, key: list[str], value: str = "y", fill: float | None = None) -> DataFrame:
    """Linear interpolation of a series (key, t, value) at times (key, t). Outside the series its first or last value holds, or ``fill``.

    Both axes are stacked and sorted by (key, t), so no range join is made. Samples with a null value don't count; of samples at one time the
    one with the largest value holds at and after it, the smallest before it. A series without samples gives null (or ``fill``), as does a
    null t; repeated times give a row each; other columns are ignored.
    """
    y = F.col(f"`{value}`").cast("double")
    left = times.select(*key, F.col("t").cast("double").alias("__t"), F.lit(1).alias("__q"), F.lit(None).cast("double").alias("__y"), F.lit(None).cast("struct<t:double,y:double>").alias("__s"))
    right = series.where(F.col("t").isNotNull() & y.isNotNull()).select(*key, F.col("t").cast("double").alias("__t"), F.lit(0).alias("__q"), y.alias("__y"), F.struct(F.col("t").cast("double").alias("t"), y.alias("y")).alias("__s"))
    both = neighbours(left.unionByName(right), key, ["__t", "__q", "__y"], "__t", "__s").where("__q = 1")
    t, before, after = F.col("__t"), F.col("__b"), F.col("__a")
    inner = F.when(before["t"] == t, before["y"]).otherwise(before["y"] + (after["y"] - before["y"]) * (t - before["t"]) / (after["t"] - before["t"]))
    edge = lambda c: c if fill is None else F.lit(float(fill))
    out = F.when(before.isNull(), edge(after["y"])).when(after.isNull(), F.when(before["t"] == t, before["y"]).otherwise(edge(before["y"]))).otherwise(inner)
    return both.select(*key, t.alias("t"), F.when(t.isNotNull(), out).alias(value))


def pair_forecast_with_obs(forecast: DataFrame, obs: DataFrame, keys: list[str]) -> DataFrame:
    """The model's states at observation steps."""
    return forecast.join(obs, keys)


def split_observed(df: DataFrame, observed: DataFrame, on: str = "dim") -> tuple[DataFrame, DataFrame]:
    return df.join(observed, on, "left_semi"), df.join(observed, on, "left_anti")


def unbias(model: DataFrame, bias: DataFrame, key: list[str]) -> DataFrame:
    """Model values plus the members' mean bias, interpolated to the model's clock."""
    mean = bias.groupBy(*key, "t").agg(F.avg("value").alias("b"))
    at = interpolate_to(model.select(*key, "t").distinct(), mean, key, "b")
    return model.join(at, [*key, "t"]).withColumn("y", F.col("y") + F.col("b"))


def sweep(*axes: DataFrame) -> DataFrame:
    """The cross product of configuration axes (each a short list of settings)."""
    out = axes[0]
    for axis in axes[1:]:
        out = out.crossJoin(axis)
    return out


def lag_search(obs: DataFrame, model: DataFrame, n_lags: int) -> DataFrame:
    """For each (series, member): RMS error of the observed segment against the model shifted by each lag, the shifted segment divided by
    its largest magnitude; best lag = smallest error, worst = largest, mid = their mean. ``obs``: series_id, step, d; ``model``: series_id,
    member, step, y. Lags are exploded on the (short) observed segment, then joined by step; sums are combined before the shuffle."""
    lagged = obs.select("series_id", "d", F.explode(F.sequence(F.lit(0), F.lit(n_lags - 1))).alias("lag"), "step").withColumn("at", F.col("step") + F.col("lag"))
    met = lagged.join(model.select("series_id", "member", F.col("step").alias("at"), "y"), ["series_id", "at"])
    # sum((d - y/m)^2) = sum(d^2) - 2 sum(d y)/m + sum(y^2)/m^2, so the maximum m needs no second pass
    sums = met.groupBy("series_id", "member", "lag").agg(F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("d") * F.col("y")).alias("dy"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.max(F.abs("y")).alias("m"))
    error = sums.where("m > 0 and dd > 0").withColumn("r", F.sqrt(F.greatest(F.col("dd") - 2 * F.col("dy") / F.col("m") + F.col("yy") / (F.col("m") * F.col("m")), F.lit(0.0)) / F.col("dd")))
    best, worst = F.min(F.struct("r", "lag")), F.max(F.struct("r", (-F.col("lag")).alias("back")))
    out = error.groupBy("series_id", "member").agg(best["lag"].alias("best"), (-worst["back"]).alias("worst"), best["r"].alias("r_best"))
    return out.withColumn("mid", F.floor((F.col("best") + F.col("worst")) / 2).cast("int"))


def shifted_copies(model: DataFrame, lags: DataFrame, which: tuple[str, ...] = ("best", "mid")) -> DataFrame:
    """The model's series moved back by the found lags, one copy for each of ``which``."""
    moves = lags.select("series_id", "member", F.explode(F.array(*(F.struct(F.lit(w).alias("copy"), F.col(w).alias("lag")) for w in which))).alias("m")).select("series_id", "member", "m.*")
    return model.join(moves, ["series_id", "member"]).withColumn("step", F.col("step") - F.col("lag")).where("step >= 0")


def innovations(obs: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """innovation = raw - model, model_bias = truth - model, sensor_bias = raw - truth."""
    met = obs.join(model, keys)
    return met.withColumn("innovation", F.col("y_raw") - F.col("y")).withColumn("model_bias", F.col("y_true") - F.col("y")).withColumn("sensor_bias", F.col("y_raw") - F.col("y_true"))


def augment(train: DataFrame, value: str = "y", factors: tuple[float, ...] = (1.0, 0.1, -0.01)) -> DataFrame:
    """Copies of the training set, scaled."""
    return train.withColumn("factor", F.explode(F.array(*map(F.lit, factors)))).withColumn(value, F.col(value) * F.col("factor"))


def union_datasets(**sets: DataFrame) -> DataFrame:
    """Training sets stacked, told apart by ``dataset``."""
    out = None
    for name, df in sets.items():
        df = df.withColumn("dataset", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def find_peaks(df: DataFrame, key: list[str], value: str = "y", absolute: bool = False) -> DataFrame:
    """Local maxima; a flat top counts once, at its middle sample. Ends of a series are no peaks."""
    y: Column = F.abs(value) if absolute else F.col(value)
    w = Window.partitionBy(*key).orderBy("step")
    runs = df.withColumn("__y", y).withColumn("__new", F.coalesce((F.lag("__y").over(w) != F.col("__y")).cast("int"), F.lit(1)))
    runs = runs.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__i", F.row_number().over(w))
    tops = runs.groupBy(*key, "__run").agg(F.min("__i").alias("a"), F.max("__i").alias("b"), F.first("__y").alias("h"))
    v = Window.partitionBy(*key).orderBy("__run")
    tops = tops.withColumn("l", F.lag("h").over(v)).withColumn("r", F.lead("h").over(v)).where("h > l and h > r")
    middle = tops.select(*key, F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("__i"))
    return runs.join(middle, [*key, "__i"]).drop("__y", "__new", "__run", "__i")


def _greedy(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Which of the peaks, in order of their steps, stay: higher ones choose first, and strike out neighbours that nobody has yet."""
    left, right = np.arange(-1, len(at) - 1), np.arange(1, len(at) + 1)
    keep, gone = np.zeros(len(at), bool), np.zeros(len(at), bool)
    for i in np.lexsort((at, -height)):
        if gone[i]:
            continue
        keep[i], j = True, left[i]
        while j >= 0 and at[i] - at[j] < distance:
            gone[j], j = True, left[j]
        k = right[i]
        while k < len(at) and at[k] - at[i] < distance:
            gone[k], k = True, right[k]
        left[i], right[i] = j, k  # those struck out are skipped from now on
        if j >= 0:
            right[j] = i
        if k < len(at):
            left[k] = i
    return keep


def separate_peaks(peaks: DataFrame, key: list[str], distance: int, value: str = "y", rounds: int = 3, block: int = 100_000) -> DataFrame:
    """Of peaks closer than ``distance`` steps the higher stays (higher peaks choose first, of equals the earlier).

    Rounds of windows decide nearly all: a peak that is the highest within reach of those left stays, and its neighbours go. A series is cut
    into blocks of steps with as much of their neighbours as the rounds can look at, so it spreads over tasks. What rounds leave are stairs of ever
    higher peaks; each stretch of them without a gap of ``distance`` is decided in order of height. Of several rows of a step the highest
    stays; a null height or step is no peak.
    """
    names = own_names(peaks, "h", "block", "in", "state", "top", "near", "run", "copy")
    h, in_, state, top, near, run, copy = (F.col(names[n]) for n in ("h", "in", "state", "top", "near", "run", "copy"))
    whole = peaks.where(F.col("step").isNotNull() & F.col(value).isNotNull()).withColumn(names["h"], F.col(value).cast("double"))
    single = whole.withColumn(names["copy"], F.row_number().over(Window.partitionBy(*key, "step").orderBy(h.desc()))).where(copy == 1).drop(names["copy"])
    reach = 2 * rounds * max(distance - 1, 0)
    size = max(block, 8 * reach, 1)
    own = F.floor(F.col("step") / size)
    spread = F.explode(F.sequence(F.floor((F.col("step") - reach) / size), F.floor((F.col("step") + reach) / size))).alias(names["block"])
    rows = single.select("*", own.alias(names["in"]), spread).withColumn(names["state"], F.lit(0))  # 0 open, 1 stays, 2 goes
    around = Window.partitionBy(*key, names["block"]).orderBy("step").rangeBetween(-max(distance - 1, 0), max(distance - 1, 0))
    rank = F.struct(h, (-F.col("step")).alias("s"))
    for _ in range(rounds):
        rows = rows.withColumn(names["top"], F.max(F.when(state == 0, rank)).over(around)).withColumn(names["state"], F.when((state == 0) & (top == rank), 1).otherwise(state))
        rows = rows.withColumn(names["near"], F.max((state == 1).cast("int")).over(around)).withColumn(names["state"], F.when((state == 0) & (near == 1), 2).otherwise(state))
    decided = rows.where(F.col(names["block"]) == in_).drop(*(names[n] for n in ("block", "in", "top", "near")))
    order = Window.partitionBy(*key).orderBy("step")
    gap = F.coalesce((F.col("step") - F.lag("step").over(order) >= distance).cast("int"), F.lit(1))
    stairs = decided.where(state == 0).withColumn(names["run"], gap).withColumn(names["run"], F.sum(run).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        return pdf[_greedy(pdf["step"].to_numpy(), pdf[names["h"]].to_numpy(), distance)]

    rest = stairs.groupBy(*key, names["run"]).applyInPandas(prune, stairs.schema)
    return decided.where(state == 1).select(*peaks.columns).unionAll(rest.select(*peaks.columns))


def envelope(df: DataFrame, key: list[str], value: str = "y", distance: int | None = None) -> DataFrame:
    """Linear interpolation through the peaks, 0 before the first and after the last."""
    peaks = find_peaks(df, key, value)
    peaks = separate_peaks(peaks, key, distance, value) if distance else peaks
    return interpolate_to(df.select(*key, "t"), peaks, key, value, fill=0.0)
