"""Truth and observation tables: bias, noise, thinning, spectra, value-grid Bayes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assimspark.functions.names import own_names
from assimspark.functions.noise import keyed_normal
from assimspark.operators import spectra
from assimspark.operators.timegrid import thin_observations

CHANNEL = ("series_id", "dim")


def add_bias(df: DataFrame, kind: str | Callable[[Column, Column], Column], key: tuple[str, ...] = CHANNEL) -> DataFrame:
    """b by kind (time, periodic, linear, cosine, none, or a function of (y, t)), and y_true with it added."""
    y, t, largest = F.col("y_true"), F.col("t"), F.max("y_true").over(Window.partitionBy(*key))
    forms: dict[str, Column] = {
        "time": 0.4 * y * F.sin(F.pow(F.lit(2 * math.pi) * t, F.lit(2.0))),
        "periodic": 0.2 * largest * F.cos(2.0 * y / largest),
        "linear": 0.1 * largest + 0.3 * y,
        "cosine": F.cos(y),
        "none": F.lit(0.0),
    }
    b = kind(y, t) if callable(kind) else forms[kind]
    return df.withColumn("b", b).withColumn("y_true", y + F.col("b"))


def channel_key(df_key: str = "series_id", dim: str = "dim") -> Column:
    return F.col(df_key) * 64 + F.col(dim)


def add_noise(df: DataFrame, level: float, additive: bool = True, seed: int = 0, key: tuple[str, ...] = CHANNEL, normal: Column | None = None) -> DataFrame:
    """y_raw = y_true with Gaussian noise: level times the channel's largest magnitude, or times the value itself."""
    n = keyed_normal(channel_key(), F.col("step"), seed) if normal is None else normal
    size = F.max(F.abs("y_true")).over(Window.partitionBy(*key)) if additive else F.col("y_true")
    return df.withColumn("y_raw", F.col("y_true") + F.lit(level) * size * n)


def add_std_noise(df: DataFrame, level: float, value: str = "y", seed: int = 0, key: tuple[str, ...] = CHANNEL) -> DataFrame:
    """Noise scaled by the population deviation of each channel."""
    return df.withColumn(value, F.col(value) + F.lit(level) * F.stddev_pop(value).over(Window.partitionBy(*key)) * keyed_normal(channel_key(), F.col("step"), seed))


def colour_filter(n: int, colour: str, beta: float = 2.0) -> np.ndarray:
    """Amplitudes of the n // 2 + 1 rfft bins, DC 0, unit RMS over the others."""
    f = np.arange(n // 2 + 1, dtype=float)
    f[0] = np.inf
    shape = {"white": np.ones_like(f), "pink": f ** (-1.0 / beta), "brown": 1.0 / f, "blue": np.sqrt(f), "violet": f.copy()}[colour]
    shape[0] = 0.0
    return shape / np.sqrt(np.mean(shape[1:] ** 2)) if n > 1 else shape


def coloured(white: np.ndarray, colour: str, beta: float = 2.0) -> np.ndarray:
    n = len(white) + len(white) % 2
    padded = np.concatenate((white, np.zeros(n - len(white))))
    return np.fft.irfft(np.fft.rfft(padded) * colour_filter(n, colour, beta), n)[:len(white)]


def add_coloured_noise(df: DataFrame, level: float, colour: str, beta: float = 2.0, additive: bool = True, seed: int = 0, key: tuple[str, ...] = CHANNEL, most: int = spectra.MOST_CHANNEL) -> DataFrame:
    """As add_noise with noise of a colour: keyed white noise is filtered channel by channel, in a task up to ``most`` samples, else by transforms over
    shuffles, for which a channel's steps must differ."""
    white = df.withColumn("y_raw", keyed_normal(channel_key(), F.col("step"), seed))

    def paint(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step", kind="stable")
        y = pdf["y_true"].to_numpy()
        size = np.abs(y).max() if additive else y
        return pdf.assign(y_raw=y + level * size * coloured(pdf["y_raw"].to_numpy(), colour, beta))

    short, longer = spectra.split_long(white, list(key), most)
    painted = short.groupBy(*key).applyInPandas(paint, white.schema)
    if longer is None:
        return painted
    names = own_names(white, "j", "noise", "size")
    at = (F.row_number().over(Window.partitionBy(*key).orderBy("step")) - 1).cast("long")
    noise = spectra.long_coloured(longer, list(key), "y_raw", colour, beta, most).select(*key, F.col("j").alias(names["j"]), F.col("coloured").alias(names["noise"]))
    largest = longer.groupBy(*key).agg(F.max(F.abs("y_true")).alias(names["size"]))
    met = longer.withColumn(names["j"], at).join(noise, [*key, names["j"]]).join(largest, list(key))
    size = F.col(names["size"]) if additive else F.col("y_true")
    return painted.unionByName(met.withColumn("y_raw", F.col("y_true") + level * size * F.col(names["noise"])).select(*white.columns))


def smooth(grid: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian over both axes, reflected at the edges."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        padded = np.pad(grid, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        grid = np.apply_along_axis(lambda x: np.convolve(x, w, mode="valid"), axis, padded)
    return grid


def _powers(colour: str, f2: np.ndarray) -> np.ndarray:
    """The squared filter at squared frequencies; the constant part (0) is left out."""
    exponent = {"white": 0.0, "pink": -0.5, "brown": -1.0, "blue": 0.5, "violet": 1.0}[colour]
    return np.where(f2 > 0, np.where(f2 > 0, f2, 1.0) ** exponent, 0.0)


def _frequencies(n: int) -> np.ndarray:
    return np.fft.fftfreq(n) ** 2


def colour_field(noise: DataFrame, colour: str, value: str = "__n") -> DataFrame:
    """White noise (step, comp, ix, iy, value) filtered over all three axes of each component, to unit RMS of all but the constant part.

    The transform goes axis by axis: the grid of one snapshot, then one grid frequency over all steps, filtered and taken back, then
    snapshots again. So a task holds one snapshot or one time series, never a whole component. Missing points count as zero.
    """
    spark, kinds = noise.sparkSession, dict(noise.dtypes)
    sizes = noise.groupBy("comp").agg(F.countDistinct("step").alias("nt"), *(f(c).alias(f"{n}_{c}") for c in ("ix", "iy") for n, f in (("lo", F.min), ("hi", F.max)))).collect()  # one row for each component
    shape = {r["comp"]: (r["nt"], r["hi_ix"] - r["lo_ix"] + 1, r["hi_iy"] - r["lo_iy"] + 1) for r in sizes}
    low = {r["comp"]: (r["lo_ix"], r["lo_iy"]) for r in sizes}

    def energy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            nt, nx, ny = shape_now
            each = [_powers(colour, _frequencies(nt) + _frequencies(nx)[k // ny] + _frequencies(ny)[k % ny]).sum() for k in pdf["id"]]
            yield pd.DataFrame({"e": each})

    scale = {}
    for comp, shape_now in shape.items():
        n = int(np.prod(shape_now))
        total = spark.range(shape_now[1] * shape_now[2]).mapInPandas(energy, "e double").agg(F.sum("e")).first()[0]
        scale[comp] = np.sqrt(total / (n - 1)) if n > 1 and total else 1.0

    def ahead(pdf: pd.DataFrame) -> pd.DataFrame:
        comp = pdf["comp"].iloc[0]
        _, nx, ny = shape[comp]
        g = np.zeros((nx, ny))
        g[pdf["ix"].to_numpy() - low[comp][0], pdf["iy"].to_numpy() - low[comp][1]] = pdf[value].to_numpy()
        z = np.fft.fft2(g).ravel()
        return pd.DataFrame({"step": pdf["step"].iloc[0], "comp": comp, "k": np.arange(nx * ny), "re": z.real, "im": z.imag})

    def in_time(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step", kind="stable")
        comp, k = pdf["comp"].iloc[0], int(pdf["k"].iloc[0])
        nt, nx, ny = shape[comp]
        f2 = _frequencies(nt) + _frequencies(nx)[k // ny] + _frequencies(ny)[k % ny]
        z = np.fft.ifft(np.fft.fft(pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()) * np.sqrt(_powers(colour, f2)) / scale[comp])
        return pdf.assign(re=z.real, im=z.imag)

    def back(key: tuple, points: pd.DataFrame, waves: pd.DataFrame) -> pd.DataFrame:
        if not len(points):
            return points
        comp = key[1]
        _, nx, ny = shape[comp]
        waves = waves.sort_values("k")
        g = np.fft.ifft2((waves["re"].to_numpy() + 1j * waves["im"].to_numpy()).reshape(nx, ny)).real
        return points.assign(**{value: g[points["ix"].to_numpy() - low[comp][0], points["iy"].to_numpy() - low[comp][1]]})

    wave = f"step {kinds['step']}, comp {kinds['comp']}, k long, re double, im double"
    waves = noise.groupBy("step", "comp").applyInPandas(ahead, wave).groupBy("comp", "k").applyInPandas(in_time, wave)
    return noise.groupBy("step", "comp").cogroup(waves.groupBy("step", "comp")).applyInPandas(back, noise.schema)


def add_field_noise(field: DataFrame, level: float, colour: str = "white", smoothing: float = 0.0, seed: int = 0) -> DataFrame:
    """Noise for (step, comp, ix, iy, value): level times the largest magnitude of all components. White noise is a column expression;
    smoothing runs on one snapshot at a time, a colour axis by axis. Null values stay null; an empty field gives no rows."""
    scale = field.agg(F.max(F.abs("value")).alias("__max"))
    point = F.col("comp") * 1_000_003 + F.col("ix") * 1009 + F.col("iy")
    noise = field.withColumn("__n", keyed_normal(point, F.col("step"), seed))

    def blur(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["ix"].to_numpy() - pdf["ix"].min(), pdf["iy"].to_numpy() - pdf["iy"].min()
        g = np.zeros((i.max() + 1, j.max() + 1))
        g[i, j] = pdf["__n"].to_numpy()
        return pdf.assign(__n=smooth(g, smoothing)[i, j])

    if colour != "white":
        noise = colour_field(noise, colour)
    if smoothing:
        noise = noise.groupBy("step", "comp").applyInPandas(blur, noise.schema)
    return noise.crossJoin(F.broadcast(scale)).withColumn("value", F.col("value") + F.lit(level) * F.col("__max") * F.col("__n")).drop("__n", "__max")  # one row


def create_truth(signals: DataFrame, t_start: float, t_stop: float, dt: float, nt_obs: int, bias: str | Callable[[Column, Column], Column] = "none", level: float = 0.0, additive: bool = True, colour: str | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(signals with b, y_true, y_raw; observations thinned from y_raw, numbered by cycle, with dt_obs)."""
    biased = add_bias(signals, bias)
    noisy = add_coloured_noise(biased, level, colour, additive=additive, seed=seed) if colour else add_noise(biased, level, additive, seed)
    obs = thin_observations(noisy, t_start, t_stop, dt, nt_obs)
    return noisy, obs.select("series_id", "cycle", "step", "t", "dim", F.col("y_raw").alias("d"), F.lit(dt * nt_obs).alias("dt_obs"))


def sensor_observations(field: DataFrame, sensors: DataFrame, t_start: float, t_stop: float, dt: float, nt_obs: int) -> DataFrame:
    """Field values at the sensors' points, thinned."""
    return thin_observations(field.join(sensors, "point_id"), t_start, t_stop, dt, nt_obs)


def amplitude_spectrum(df: DataFrame, dt: float, key: tuple[str, ...] = CHANNEL, value: str = "y", most: int = spectra.MOST_CHANNEL) -> DataFrame:
    """One-sided amplitude 2/N |FFT| of the first N // 2 bins on an axis from 0 to 1/(2 dt), both ends included. Channels of over ``most`` samples are
    transformed over shuffles instead of in a task."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("step", kind="stable")[value].to_numpy()
        n = len(y)
        half = n // 2
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * half for k in key})
        return out.assign(bin=np.arange(half), frequency=np.linspace(0, 1 / (2 * dt), half), amplitude=2 / n * np.abs(np.fft.fft(y))[:half])

    kinds = dict(df.dtypes)
    short, longer = spectra.split_long(df, list(key), most)
    found = short.groupBy(*key).applyInPandas(work, ", ".join(f"{k} {kinds[k]}" for k in key) + ", bin long, frequency double, amplitude double")
    return found if longer is None else found.unionByName(spectra.long_amplitudes(longer, dt, list(key), value, most))


def grid_bayes(grid: DataFrame, obs: DataFrame, log_likelihood: Callable[[Column, Column], Column], dx: float) -> DataFrame:
    """Sequential posterior on a value grid: prior times likelihood, normalised by grid sum times dx, after each observation.

    ``grid`` (x, prior) is a short table; ``obs`` has series_id, cycle, d. The running sum of log-likelihoods over cycles replaces a loop."""
    met = obs.crossJoin(grid).withColumn("ll", F.sum(log_likelihood(F.col("x"), F.col("d"))).over(Window.partitionBy("series_id", "x").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)))
    at = Window.partitionBy("series_id", "cycle")
    weight = F.col("prior") * F.exp(F.col("ll") - F.max("ll").over(at))
    return met.withColumn("w", weight).withColumn("posterior", F.col("w") / (F.sum("w").over(at) * dx)).select("series_id", "cycle", "x", "posterior")


def most_likely(posterior: DataFrame) -> DataFrame:
    """The grid value of largest posterior for each (series, cycle); the smallest of equals."""
    top = F.max(F.struct("posterior", (-F.col("x")).alias("nx")))
    return posterior.groupBy("series_id", "cycle").agg(top.alias("m")).select("series_id", "cycle", (-F.col("m.nx")).alias("x_map"), F.col("m.posterior").alias("p_map"))
