"""Selections on a time grid: nearest samples, cuts, thinning, washouts, trailing states.

A null key or series without a bound drops its rows where a bound is needed, as in an inner join; a null t or step is in no selection;
repeated rows are all selected or all left out (last_n counts each); empty tables give no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assimspark.functions.names import own_names


def nearest_step(df: DataFrame, t0: float | Column, name: str = "i", key: str = "series_id") -> DataFrame:
    """For each series the step of the sample nearest to t0 (the first of two at the same distance)."""
    t0 = F.lit(t0) if not isinstance(t0, Column) else t0
    return df.groupBy(key).agg(F.min(F.struct(F.abs(F.col("t") - t0), F.col("step")))["step"].alias(name))


#: Rows of a series that are sorted in one task; longer series are cut into blocks of about so many.
BLOCK_ROWS = 1_000_000


def neighbours(both: DataFrame, key: list[str], order: list[str], t: str, sample: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds __b, the last non-null ``sample`` of a row's series at or before the row, and __a, the first one after it, by ``order`` (t first).

    Each block of a series is sorted forwards and backwards, with running windows only, so the work is linear in a series' length; what lies
    beyond a block is carried over from the blocks' ends, one row for each block. A null t sorts first and is in the first block. Where no series
    is that long, which is counted first, there are no blocks and nothing is joined.
    """
    if (both.groupBy(*key).count().agg(F.max("count")).first()[0] or 0) <= block_rows:
        running = lambda how: F.last(sample, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*how).rowsBetween(Window.unboundedPreceding, 0))
        return both.withColumn("__b", running([F.col(c) for c in order])).withColumn("__a", running([F.col(c).desc() for c in order]))
    spans = both.groupBy(*key).agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"), F.ceil(F.count("*") / block_rows).alias("__n"))
    place = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col(t) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * F.col("__n")), F.col("__n") - 1))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key]
    cut = both.alias("x").join(spans.alias("y"), same("x", "y")).select("x.*", F.coalesce(place, F.lit(0)).cast("long").alias("__k"))
    ahead, back = ([F.col(c) for c in order], [F.col(c).desc() for c in order])
    running = lambda by, how, end: Window.partitionBy(*by).orderBy(*how).rowsBetween(Window.unboundedPreceding, end)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    inside = cut.withColumn("__b", last(sample, running([*key, "__k"], ahead, 0))).withColumn("__a", last(sample, running([*key, "__k"], back, 0)))
    at = F.when(F.col(sample).isNotNull(), F.struct(*order, sample))
    ends = cut.groupBy(*key, "__k").agg(F.min(at)[sample].alias("__first"), F.max(at)[sample].alias("__last"))
    ends = ends.select(*key, "__k", last("__last", running(key, [F.col("__k")], -1)).alias("__before"), last("__first", running(key, [F.col("__k").desc()], -1)).alias("__after"))
    met = inside.alias("x").join(ends.alias("y"), [*same("x", "y"), F.col("x.__k") == F.col("y.__k")])
    return met.select(*(F.col(f"x.`{c}`") for c in both.columns), F.coalesce("x.__b", "y.__before").alias("__b"), F.coalesce("x.__a", "y.__after").alias("__a"))


def nearest_samples(df: DataFrame, times: DataFrame, key: str = "series_id") -> DataFrame:
    """The sample nearest to each of many times (series_id, tx): the last one at or before it and the first one after it are compared.

    The earlier of two at the same distance counts, and of samples at one time the one with the highest step before it, the lowest after it.
    A series without samples gives null step and t; repeated times give a row each; other columns are ignored. Nothing is joined by range.
    """
    sample = F.struct(F.col("t").cast("double").alias("t"), F.col("step").cast("long").alias("step"))
    left = times.select(key, F.col("tx").cast("double").alias("__t"), F.lit(1).alias("__q"), F.lit(None).cast("long").alias("__o"), F.lit(None).cast("struct<t:double,step:bigint>").alias("__s"))
    right = df.select(key, F.col("t").cast("double").alias("__t"), F.lit(0).alias("__q"), F.col("step").cast("long").alias("__o"), sample.alias("__s"))
    both = neighbours(left.unionByName(right), [key], ["__t", "__q", "__o"], "__t", "__s").where("__q = 1")
    pick = F.when(F.col("__a").isNull() | (F.col("__t") - F.col("__b.t") <= F.col("__a.t") - F.col("__t")), F.col("__b")).otherwise(F.col("__a"))
    return both.select(key, F.col("__t").alias("tx"), F.coalesce(pick, F.col("__a")).alias("s")).select(key, "tx", "s.step", "s.t")


def cut_nearest(df: DataFrame, t0: float, t1: float, key: str = "series_id") -> DataFrame:
    """Samples from the one nearest to t0 up to, without, the one nearest to t1."""
    lo, hi = own_names(df, "lo", "hi").values()
    bounds = df.groupBy(key).agg(*(F.min(F.struct(F.abs(F.col("t") - t), F.col("step")))["step"].alias(n) for n, t in ((lo, t0), (hi, t1))))
    return df.join(bounds, key).where((F.col("step") >= F.col(lo)) & (F.col("step") < F.col(hi))).drop(lo, hi)


def thin_observations(df: DataFrame, t_start: float, t_stop: float, dt: float, nt_obs: int) -> DataFrame:
    """Every nt_obs-th sample from step t_start // dt to step t_stop // dt, numbered by cycle. A plain filter: no shuffle."""
    i0, i1 = int(t_start // dt), int(t_stop // dt)
    return df.where(F.col("step").between(i0, i1) & ((F.col("step") - i0) % nt_obs == 0)).withColumn("cycle", ((F.col("step") - i0) / nt_obs).cast("long"))


def washout_window(df: DataFrame, t_init: float, n_wash: int, upsample: int, key: str = "series_id") -> DataFrame:
    """n_wash + 1 strided samples that end at the sample nearest to t_init."""
    end = own_names(df, "end")["end"]
    back = F.col(end) - F.col("step")
    return df.join(nearest_step(df, t_init, end, key), key).where(back.between(0, n_wash * upsample) & (back % upsample == 0)).drop(end)


def downsample(df: DataFrame, k: int, column: str = "step") -> DataFrame:
    return df.where(F.col(column) % k == 0)


def last_n(df: DataFrame, n: int, key: list[str] | None = None, order: str = "step") -> DataFrame:
    """The last n states of each series; all of them for n = 0."""
    if n == 0:
        return df
    w, rank = Window.partitionBy(*(key or ["series_id"])).orderBy(F.desc(order)), own_names(df, "rank")["rank"]
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n).drop(rank)


def assimilation_interval(df: DataFrame, obs: DataFrame, n_cr: int, key: str = "series_id") -> DataFrame:
    """Steps from n_cr before the first observation up to, without, n_cr after the last."""
    lo, hi = own_names(df, "lo", "hi").values()
    bounds = obs.groupBy(key).agg((F.min("step") - n_cr).alias(lo), (F.max("step") + n_cr).alias(hi))
    return df.join(bounds, key).where((F.col("step") >= F.col(lo)) & (F.col("step") < F.col(hi))).drop(lo, hi)
