"""Fourier transforms of channels that are too long for a task: four steps over two shuffles.

With n = n1 n2 and j = n2 j1 + j2 the transform of a channel is one of n1 samples for each j2 (columns), a twiddle factor for each of its
numbers, and one of n2 for each k1 (rows). Both are done in groups of at most about ``BLOCK`` numbers, so no task holds a channel. A length whose divisors are
too far apart goes through a chirp: its transform is a convolution, made of transforms whose length is a power of two.

Rows are (keys, n, j, re, im) with j from 0 to n - 1; missing rows are zeros, repeated ones overwrite each other. An empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a channel that a task may transform at once, and numbers of a group.
MOST_CHANNEL, BLOCK = 1 << 20, 1 << 18


@functools.lru_cache(4096)
def shorter_side(n: int) -> int:
    """The largest divisor of n up to its square root."""
    return next(d for d in range(int(n**0.5) + 1, 0, -1) if n % d == 0 and d * d <= n)


def _pow2(n: Column) -> Column:
    """The first power of two from 2 n - 1 on."""
    return F.pow(F.lit(2.0), F.ceil(F.log2((2 * n - 1).cast("double")) - 1e-12)).cast("long")


def _side(n: Column) -> Column:
    return F.pandas_udf(lambda s: s.map({v: shorter_side(int(v)) for v in s.unique()}), "long")(n)


def _four_steps(df: DataFrame, keys: list[str], block: int) -> DataFrame:
    kinds = dict(df.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, n1 long"
    names = [*keys, "n", "n1"]
    n, n1 = F.col("n"), F.col("n1")

    def rows(pdf: pd.DataFrame, first: np.ndarray, second: np.ndarray, values: np.ndarray, a: str, b: str) -> pd.DataFrame:
        out = pd.DataFrame({k: np.repeat(pdf[k].iloc[:1].to_numpy(), values.size) for k in names})
        one, two = np.broadcast_arrays(first, second)
        return out.assign(**{a: one.ravel(), b: two.ravel(), "re": values.real.ravel(), "im": values.imag.ravel()})

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        n, n1 = int(pdf["n"].iloc[0]), int(pdf["n1"].iloc[0])
        low = int(pdf["at"].iloc[0]) * max(1, block // n1)
        m = np.zeros((n1, min(max(1, block // n1), n // n1 - low)), complex)
        m[pdf["j1"], pdf["j2"] - low] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        k1, j2 = np.arange(n1)[:, None], low + np.arange(m.shape[1])
        return rows(pdf, k1, j2, np.fft.fft(m, axis=0) * np.exp(-2j * np.pi * (k1 * j2 % n) / n), "k1", "j2")

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        n, n1 = int(pdf["n"].iloc[0]), int(pdf["n1"].iloc[0])
        n2 = n // n1
        low = int(pdf["at"].iloc[0]) * max(1, block // n2)
        m = np.zeros((min(max(1, block // n2), n1 - low), n2), complex)
        m[pdf["k1"] - low, pdf["j2"]] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        k = low + np.arange(len(m))[:, None] + n1 * np.arange(n2)
        return rows(pdf, k, k, np.fft.fft(m, axis=1), "k", "same").drop(columns="same")

    step = F.expr("n div n1")
    cut = df.withColumn("n1", _side(n)).withColumn("j1", F.floor(F.col("j") / step).cast("long")).withColumn("j2", F.col("j") % step)
    width = lambda side: F.greatest(F.lit(1), F.floor(F.lit(block) / side))
    first = cut.withColumn("at", F.floor(F.col("j2") / width(n1)).cast("long")).groupBy(*names, "at").applyInPandas(columns, f"{head}, k1 long, j2 long, re double, im double")
    second = first.withColumn("at", F.floor(F.col("k1") / width(step)).cast("long")).groupBy(*names, "at").applyInPandas(lines, f"{head}, k long, re double, im double")
    return second.drop("n1")


def _times(a: tuple[Column, Column], b: tuple[Column, Column]) -> list[Column]:
    return [(a[0] * b[0] - a[1] * b[1]).alias("re"), (a[0] * b[1] + a[1] * b[0]).alias("im")]


def transform(df: DataFrame, keys: list[str], most: int = MOST_CHANNEL, block: int = BLOCK) -> DataFrame:
    """(keys, n, k, re, im): the discrete Fourier transform of each channel. Sides longer than ``most`` go through the chirp."""
    far = F.expr("n div n1") > most
    sided = df.withColumn("n1", _side(F.col("n")))
    plain = _four_steps(sided.where(~far).drop("n1"), keys, block)
    angle = lambda j: F.lit(np.pi) * ((j * j) % (2 * F.col("n"))) / F.col("n")
    j, m = F.col("j"), _pow2(F.col("n"))
    odd = sided.where(far)
    chirped = odd.select(*keys, F.col("n").alias("own"), m.alias("n"), "j", *_times((F.col("re"), F.col("im")), (F.cos(angle(j)), -F.sin(angle(j)))))
    both = F.array_distinct(F.array(j, F.when(j > 0, m - j).otherwise(j)))
    kernel = odd.select(*keys, F.col("n").alias("own"), m.alias("n"), F.explode(both).alias("j"), F.cos(angle(j)).alias("re"), F.sin(angle(j)).alias("im"))
    wide = [*keys, "own"]
    a, b = (_four_steps(x, wide, block).alias(name) for x, name in ((chirped, "a"), (kernel, "b")))
    same = functools.reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*wide, "n", "k"]))
    product = a.join(b, same).select(*(F.col(f"a.{k}").alias(k) for k in [*wide, "n"]), F.col("a.k").alias("j"), *_times((F.col("a.re"), F.col("a.im")), (F.col("b.re"), F.col("b.im"))))
    back = _four_steps(product.withColumn("im", -F.col("im")), wide, block).where(F.col("k") < F.col("own"))
    back = back.select(*keys, F.col("own").alias("n"), "k", (F.col("re") / F.col("n")).alias("re"), (-F.col("im") / F.col("n")).alias("im"))
    turned = back.select(*keys, "n", "k", *_times((F.col("re"), F.col("im")), (F.cos(angle(F.col("k"))), -F.sin(angle(F.col("k"))))))
    return plain.unionByName(turned)


def numbered_channels(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, j, re, im) of a value, samples in order of step."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("step")) - 1
    rows = df.select(*keys, at.cast("long").alias("j"), F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im")).alias("x")
    same = functools.reduce(lambda x, y: x & y, (F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys))
    return rows.join(sizes.alias("y"), same).select("x.*", "y.n")


def split_long(df: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """The channels of up to ``most`` samples, and the longer ones (None if there are none)."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__size"))
    if (sizes.agg(F.max("__size")).first()[0] or 0) <= most:
        return df, None
    longer = sizes.where(F.col("__size") > most).alias("y")
    same = functools.reduce(lambda x, y: x & y, (F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys))
    return df.alias("x").join(longer, same, "left_anti"), df.alias("x").join(longer, same, "left_semi")


def long_amplitudes(df: DataFrame, dt: float, keys: list[str], value: str, most: int = MOST_CHANNEL, block: int = BLOCK) -> DataFrame:
    """The one-sided amplitude spectrum of long channels: (keys, bin, frequency, amplitude)."""
    found = transform(numbered_channels(df, keys, value), keys, most, block)
    half, n, k = F.expr("n div 2"), F.col("n"), F.col("k")
    kept = found.where(k < half)
    frequency = k / F.greatest(half - 1, F.lit(1)) * (1 / (2 * dt))
    return kept.select(*keys, k.alias("bin"), frequency.alias("frequency"), (2 / n * F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("amplitude"))


@functools.lru_cache(4096)
def _unit(n: int, colour: str, beta: float) -> float:
    """What makes the filter's RMS one over the bins from 1 to n // 2."""
    total, half = 0.0, n // 2
    for a in range(1, half + 1, 1 << 20):
        f = np.arange(a, min(a + (1 << 20), half + 1), dtype=float)
        total += float({"white": np.ones_like(f), "pink": f ** (-2.0 / beta), "brown": f**-2.0, "blue": f, "violet": f * f}[colour].sum())
    return 1 / np.sqrt(total / half)


def long_coloured(df: DataFrame, keys: list[str], white: str, colour: str, beta: float, most: int = MOST_CHANNEL, block: int = BLOCK) -> DataFrame:
    """(keys, j, coloured): white noise of long channels filtered to a colour. An odd channel is filtered with a zero after it."""
    rows = numbered_channels(df, keys, white).withColumn("n", F.col("n") + F.col("n") % 2)
    found = transform(rows, keys, most, block)
    f = F.least("k", F.col("n") - F.col("k")).cast("double")
    shape = {"white": F.lit(1.0), "pink": F.pow(f, F.lit(-1.0 / beta)), "brown": 1 / f, "blue": F.sqrt(f), "violet": f}[colour]
    unit = F.pandas_udf(lambda s: s.map({v: _unit(int(v), colour, beta) for v in s.unique()}), "double")(F.col("n"))
    gain = F.when(F.col("k") == 0, F.lit(0.0)).otherwise(shape * unit)
    back = transform(found.select(*keys, "n", F.col("k").alias("j"), (F.col("re") * gain).alias("re"), (-F.col("im") * gain).alias("im")), keys, most, block)
    return back.select(*keys, F.col("k").alias("j"), (F.col("re") / F.col("n")).alias("coloured"))
