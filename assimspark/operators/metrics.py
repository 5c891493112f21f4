"""Ensemble statistics, error metrics over sweeps, histograms and rankings: partial aggregation everywhere, no row leaves its key.

Null values don't count, and a key of nulls only has null results; a zero energy or spread gives null instead of a quotient; repeated rows
count each time; empty tables give no rows; columns that aren't named are ignored. Of equal scores the smallest key is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ensemble_moments(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, population deviation and the bands of one and two deviations."""
    m = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("m"))
    return m.select("*", *((F.col("mean") + k * F.col("std")).alias(n) for n, k in (("lo2", -2), ("lo1", -1), ("hi1", 1), ("hi2", 2))))


def ensemble_moments_packed(df: DataFrame, vals: str = "vals") -> DataFrame:
    """The same from an array of member values: no shuffle."""
    n = F.size(vals)
    mean = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / n
    out = df.withColumn("mean", mean)
    return out.withColumn("std", F.sqrt(F.aggregate(F.transform(vals, lambda x: F.pow(x - F.col("mean"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x) / n))


def ensemble_covariance(df: DataFrame, keys: list[str], rows_a: Column, rows_b: Column, row: str = "row_id", value: str = "value") -> DataFrame:
    """Covariance (divisor m - 1) and correlation over members between two blocks of rows."""
    a = df.where(rows_a).select(*keys, "member", F.col(row).alias("row_a"), F.col(value).alias("va"))
    b = df.where(rows_b).select(*keys, "member", F.col(row).alias("row_b"), F.col(value).alias("vb"))
    return a.join(b, [*keys, "member"]).groupBy(*keys, "row_a", "row_b").agg(F.covar_samp("va", "vb").alias("cov"), F.corr("va", "vb").alias("corr"))


def _sums(y: Column, e: Column) -> dict[str, Column]:
    return {"n": F.count("*"), "sy": F.sum(y), "se": F.sum(e), "syy": F.sum(y * y), "see": F.sum(e * e), "sye": F.sum(y * e), "sdd": F.sum((y - e) * (y - e))}


def cr_metrics(df: DataFrame, keys: list[str], dim: str = "dim", truth: str = "y", estimate: str = "e") -> DataFrame:
    """C: correlation over all dims, each about its own mean; R: error energy over truth energy, square root.

    Sums for each dim first (combined before the shuffle), then over dims."""
    by_dim = df.groupBy(*keys, dim).agg(*(c.alias(n) for n, c in _sums(F.col(truth), F.col(estimate)).items()))
    n = F.col("n")
    over = by_dim.groupBy(*keys).agg(
        F.sum(F.col("sye") - F.col("sy") * F.col("se") / n).alias("ye"), F.sum(F.col("syy") - F.col("sy") * F.col("sy") / n).alias("yy"), F.sum(F.col("see") - F.col("se") * F.col("se") / n).alias("ee"), F.sum("sdd").alias("dd"), F.sum("syy").alias("energy"),
    )
    return over.select(*keys, F.when((F.col("yy") > 0) & (F.col("ee") > 0), F.col("ye") / F.sqrt(F.col("yy") * F.col("ee"))).alias("C"), F.when(F.col("energy") > 0, F.sqrt(F.col("dd") / F.col("energy"))).alias("R"))


def rms_per_step(df: DataFrame, keys: list[str], truth: str = "y", estimates: tuple[str, ...] = ("e",)) -> DataFrame:
    """For each step (and what else keys hold) the relative error over dims, for one or several estimates."""
    energy = F.sum(F.col(truth) * F.col(truth))
    return df.groupBy(*keys).agg(*(F.when(energy > 0, F.sqrt(F.sum((F.col(truth) - F.col(e)) * (F.col(truth) - F.col(e))) / energy)).alias(f"rms_{e}") for e in estimates))


def sweep_metrics(runs: DataFrame, keys: list[str], last_step: Column, n_cr: int, margins: bool = False) -> DataFrame:
    """C and R of the biased and unbiased estimates during assimilation (steps [-2 n_cr, -n_cr) from the end) and after (the last n_cr),
    all four from one pass. ``runs``: keys, step, dim, y, biased, unbiased."""
    back = last_step - F.col("step")
    part = F.when(back.between(0, n_cr - 1), "post").when(back.between(n_cr, 2 * n_cr - 1), "during")
    long = runs.withColumn("phase", part).where("phase is not null").select(*keys, "phase", "dim", "y", F.explode(F.array(F.struct(F.lit("biased").alias("kind"), F.col("biased").alias("e")), F.struct(F.lit("unbiased").alias("kind"), F.col("unbiased").alias("e")))).alias("x")).select(*keys, "phase", "dim", "y", "x.kind", "x.e")
    cells = cr_metrics(long, [*keys, "phase", "kind"])
    if not margins:
        return cells
    return cells.rollup(*keys, "phase", "kind").agg(F.avg("C").alias("C"), F.avg("R").alias("R"))


def interval_error(df: DataFrame, keys: list[str], n_cr: int, first_step: Column | int = 0, dim: str = "dim") -> DataFrame:
    """Mean absolute error of each block of n_cr steps and dim, over the largest truth magnitude of that dim."""
    i0 = first_step if isinstance(first_step, Column) else F.lit(first_step)
    blocks = df.groupBy(*keys, dim, F.floor((F.col("step") - i0) / n_cr).alias("block")).agg(F.avg(F.abs(F.col("y") - F.col("e"))).alias("err"), F.max(F.abs("y")).alias("__m"))
    top = F.max("__m").over(Window.partitionBy(*keys, dim))
    return blocks.select(*keys, dim, "block", F.when(top > 0, F.col("err") / top).alias("err"))


def member_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """cr_metrics of each member, then mean and population deviation over members."""
    each = cr_metrics(df, [*keys, "member"])
    return each.groupBy(*keys).agg(*(f(c).alias(f"{c}_{n}") for c in ("C", "R") for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Counts and densities of equal bins on [lo, hi]; the right end belongs to the last bin, values outside are left out."""
    if not hi > lo or bins < 1:
        raise ValueError("a histogram needs lo < hi and at least one bin")
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("long")
    counts = df.where(F.col(value).between(lo, hi)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("density", F.col("n") / (total * width))


def parameter_summary(df: DataFrame, keys: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Mean and deviation of each parameter over members at the first and the last step, and relative to the start or a reference."""
    bounds = df.groupBy(*keys).agg(F.min("step").alias("a"), F.max("step").alias("b"))
    marked = df.join(bounds, keys)
    first, last = (F.when(F.col("step") == F.col(c), F.col("value")) for c in "ab")
    out = marked.groupBy(*keys, "name").agg(F.avg(first).alias("mean_start"), F.stddev_pop(first).alias("std_start"), F.avg(last).alias("mean_now"), F.stddev_pop(last).alias("std_now"))
    if reference is not None:
        out = out.join(reference.select("name", "reference"), "name")
    base = F.col("reference") if reference is not None else F.col("mean_start")
    return out.withColumn("relative_mean", F.when(base != 0, F.col("mean_now") / base)).withColumn("relative_std", F.when(base != 0, F.col("std_now") / F.abs(base)))


def norm_factor(train: DataFrame, method: str, value: str = "y") -> DataFrame:
    """For each dim the range, std, max or mean of each series, averaged over series; a zero is an error for the model that divides by it,
    so it comes back as null."""
    each = {"range": F.max(value) - F.min(value), "std": F.stddev_pop(value), "max": F.max(F.abs(value)), "mean": F.avg(value)}[method]
    return train.groupBy("series_id", "dim").agg(each.alias("f")).groupBy("dim").agg(F.avg("f").alias("norm")).withColumn("norm", F.when(F.col("norm") != 0, F.col("norm")))


def obs_error_cov(obs: DataFrame, std_obs: float, mode: str = "reference") -> DataFrame:
    """The diagonal of the observation error covariance: std_obs (or its square) times the squared largest magnitude of each channel."""
    level = std_obs if mode == "reference" else std_obs * std_obs
    return obs.groupBy("series_id", "dim").agg((F.lit(level) * F.pow(F.max(F.abs("d")), F.lit(2.0))).alias("cdd"))


def forecast_test_errors(scored: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, series_id, window, error2, norm2): log10 of the mean squared error over the mean squared norm of each window, then min, max and mean.
    A window of norm 0 gives infinity, or NaN where its error is 0 too; one of error 0 gives minus infinity."""
    error, norm = F.avg("error2"), F.avg("norm2")
    ratio = F.when(norm != 0, error / norm).when(error > 0, F.lit(float("inf"))).when(error == 0, F.lit(float("nan")))
    each = scored.groupBy(*keys, "series_id", "window").agg(F.when(ratio == 0, F.lit(float("-inf"))).otherwise(F.log10(ratio)).alias("e"))
    return each.groupBy(*keys).agg(F.min("e").alias("e_min"), F.max("e").alias("e_max"), F.avg("e").alias("e_mean")) if keys else each.agg(F.min("e").alias("e_min"), F.max("e").alias("e_max"), F.avg("e").alias("e_mean"))


def best_run(scores: DataFrame, keys: list[str], biased: str = "biased", unbiased: str = "unbiased", log: bool = False) -> DataFrame:
    """The run with the smallest mean of both errors (or smallest log of their sum); the smallest key of equals."""
    both = F.log(F.col(biased) + F.col(unbiased)) if log else (F.col(biased) + F.col(unbiased)) / 2
    return scores.agg(F.min(F.struct(both.alias("score"), *keys)).alias("x")).select("x.*")


def rank_channels(df: DataFrame, n_last: int = 1000, value: str = "y") -> DataFrame:
    """Channels of each series by their largest magnitude over the last n_last samples."""
    w = Window.partitionBy("series_id", "dim").orderBy(F.desc("step"))
    top = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n_last).groupBy("series_id", "dim").agg(F.max(F.abs(value)).alias("top"))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("top"), "dim")))
