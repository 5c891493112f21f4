"""Ensembles in long form (series_id, step, row_id, kind, name, member, value): creation, inflation, bounds, stuck members.

Null values don't count in means, deviations and ranges and are outside no bound; repeated rows count each time; empty tables give no rows;
other columns pass through inflate and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assimspark.functions.names import own_names
from assimspark.functions.noise import keyed_normal, keyed_uniform


def init_ensemble(means: DataFrame, m: int, std: float, distribution: str = "normal", ensure_mean: bool = False, seed: int = 0) -> DataFrame:
    """m members around means (series_id, row_id, name, mean[, lo, hi]): normal N(mean, (mean std)^2), uniform mean (1 + U(-std, std)),
    or limits: uniform on [lo, hi]. With ``ensure_mean`` member 0 is the mean."""
    rows = means.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    key = F.col("series_id") * 1009 + F.col("row_id")
    u = keyed_uniform(key, F.col("member"), seed)
    value = {
        "normal": lambda: F.col("mean") + F.col("mean") * std * keyed_normal(key, F.col("member"), seed),
        "uniform": lambda: F.col("mean") * (1 + std * (2 * u - 1)),
        "limits": lambda: F.col("lo") + (F.col("hi") - F.col("lo")) * u,
    }[distribution]()
    return rows.withColumn("value", F.when(F.col("member") == 0, F.col("mean")).otherwise(value) if ensure_mean else value)


def inflate(ens: DataFrame, rho: float, guarded_rows: str | None = None) -> DataFrame:
    """mean + rho (x - mean) for each (series, step, row). With ``guarded_rows`` (a condition, such as "kind = 'param'") a whole state stays
    as it is when any of those rows has deviation / mean above 1 (a negative mean never trips it)."""
    w = Window.partitionBy("series_id", "step", "row_id")
    mean, mine = F.avg("value").over(w), own_names(ens, "mean", "wide", "skip")
    out = ens.withColumn(mine["mean"], mean)
    rho_col = F.lit(rho)
    if guarded_rows is not None:
        wide = F.expr(guarded_rows) & (F.coalesce(F.stddev_pop("value").over(w) / F.nullif(F.col(mine["mean"]), F.lit(0.0)), F.lit(0.0)) > 1)
        out = out.withColumn(mine["wide"], wide)
        out = out.withColumn(mine["skip"], F.max(F.col(mine["wide"]).cast("int")).over(Window.partitionBy("series_id", "step")))
        rho_col = F.when(F.col(mine["skip"]) == 1, F.lit(1.0)).otherwise(F.lit(rho))
    return out.withColumn("value", F.col(mine["mean"]) + rho_col * (F.col("value") - F.col(mine["mean"]))).drop(*mine.values())


def out_of_bounds(ens: DataFrame, limits: DataFrame) -> DataFrame:
    """For each (series, step) whether any member of any limited parameter is outside, and how many are. A null limit is open."""
    outside = F.coalesce(F.col("value") < F.col("lo"), F.lit(False)) | F.coalesce(F.col("value") > F.col("hi"), F.lit(False))
    return ens.join(limits, "name").groupBy("series_id", "step").agg(F.max(outside.cast("int")).cast("boolean").alias("non_physical"), F.sum(outside.cast("long")).alias("n_outside"))


def fixed_points(ens: DataFrame, n_cr: int, tol: float = 0.1) -> DataFrame:
    """(series_id, member, fixed): members whose range over the last n_cr steps is below tol in every row."""
    last = ens.groupBy("series_id").agg(F.max("step").alias("__last"))
    spans = ens.select("series_id", "member", "row_id", "step", "value").join(last, "series_id").where(F.col("step") > F.col("__last") - n_cr).groupBy("series_id", "member", "row_id").agg((F.max("value") - F.min("value")).alias("span"))
    return spans.groupBy("series_id", "member").agg((F.max("span") < tol).alias("fixed"))


def drop_fixed(members: DataFrame, m: int | None = None) -> DataFrame:
    """Members to keep: with 20 % or more of m fixed, int(0.2 m) + 1 of those (lowest numbers) and all others; else only the others.

    Without ``m`` it is each series' own number of members.
    """
    of_all = F.count("*").over(Window.partitionBy("series_id")) if m is None else F.lit(m)
    n_fixed = F.sum(F.col("fixed").cast("long")).over(Window.partitionBy("series_id"))
    rank = F.row_number().over(Window.partitionBy("series_id", "fixed").orderBy("member"))
    keep = ~F.col("fixed") | ((n_fixed >= 0.2 * of_all) & (rank <= F.floor(0.2 * of_all) + 1))
    return members.withColumn("keep", keep)


#: Rows of whole series that are refilled at once.
REFILL_ROWS = 1 << 18


def refill(ens: DataFrame, kept: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """Members up to m again at the last step: the missing ones are drawn from a normal fitted to the kept ones. A task holds whole series,
    and fits those that have as many rows and members side by side."""
    have = ens.join(kept.where("keep").select("series_id", "member"), ["series_id", "member"], "left_semi")
    slim = have.select("series_id", "step", "row_id", "member", "value")
    fields = [(f.name, f.dataType) for f in slim.schema]
    schema = pa.schema([(n, to_arrow_type(t)) for n, t in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_series(batches):
            for part in _refill_series(table, m, seed, schema):
                yield from part.to_batches()

    return slim.repartition("series_id").sortWithinPartitions("series_id", "row_id", "member").mapInArrow(work, slim.schema)


def _whole_series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by series_id, put together to tables that end where a series ends."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < REFILL_ROWS:
            continue
        last = batch.column("series_id")
        ends = np.nonzero(_changes(last))[0]
        if len(ends):  # a series that fills the batch may go on
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, int(ends[-1]))])
            held = [batch.slice(int(ends[-1]))]
            n = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held)


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; the first doesn't."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[False], codes[1:] != codes[:-1]])


def _refill_series(table: pa.Table, m: int, seed: int, schema: pa.Schema) -> Iterator[pa.Table]:
    """The given rows and the new ones. Series whose rows don't all have the same members, once each and none of them null, are taken one by one."""
    table = table.combine_chunks()
    columns = {n: table.column(n).combine_chunks() for n in table.column_names}
    starts = np.concatenate([[0], np.nonzero(_changes(columns["series_id"]))[0]])
    counts = np.diff(np.append(starts, table.num_rows))
    whole = np.ones(table.num_rows, bool)
    for c in columns.values():
        whole &= c.is_valid().to_numpy(zero_copy_only=False)
    whole = np.logical_and.reduceat(whole, starts)
    if not all(pa.types.is_integer(columns[n].type) for n in ("series_id", "step", "row_id", "member")):
        whole[:] = False
    series, step, row, member, value = (np.zeros(0) if not whole.any() else columns[n].fill_null(0).to_numpy(zero_copy_only=False) for n in ("series_id", "step", "row_id", "member", "value"))
    alone = list(np.nonzero(~whole)[0])
    if whole.any():
        first = np.concatenate([[True], row[1:] != row[:-1]])
        first[starts] = True
        n_rows = np.add.reduceat(first, starts)
        shapes = np.where(whole & (counts % n_rows == 0), n_rows, 0)
        for r, n in sorted({(int(a), int(b)) for a, b in zip(shapes, counts) if a}):
            which = np.nonzero((shapes == r) & (counts == n))[0]
            at = (starts[which, None] + np.arange(n)).reshape(len(which), r, n // r)
            rows, members = row[at], member[at]
            regular = (rows == rows[:, :, :1]).all((1, 2)) & (members == members[:, :1]).all((1, 2)) & (np.diff(members[:, 0]) > 0).all(1)
            alone += list(which[~regular])
            if regular.any():
                at = at[regular]
                new = _drawn(series[at[:, 0, 0]], members[regular, 0], value[at].astype(float), m, seed)
                if new is not None:
                    of, j, x = new  # the series, the new member, its value in each row
                    owner = at[of, 0, 0]
                    out = [np.repeat(series[owner], r), np.repeat(step[owner], r), rows[regular][of, :, 0].ravel(), np.repeat(j, r), x.ravel()]
                    yield pa.table([pa.array(o).cast(f.type) for o, f in zip(out, schema)], schema=schema)
        alone += list(np.nonzero(whole & (shapes == 0))[0])
    yield table.cast(schema)
    for k in alone:
        pdf = table.slice(int(starts[k]), int(counts[k])).to_pandas()
        rows = _refill_one(pdf, m, seed)
        if rows:
            yield pa.Table.from_pandas(pd.DataFrame(rows, columns=pdf.columns), schema=schema, preserve_index=False)


def _drawn(series: np.ndarray, members: np.ndarray, x: np.ndarray, m: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """For series with x (series, rows, members): of each missing member its series' place, its number and its values."""
    n, r, kept = x.shape
    has = np.zeros((n, m), bool)
    places, inside = np.arange(n)[:, None].repeat(kept, 1), (members >= 0) & (members < m)
    has[places[inside], members[inside]] = True
    of, j = np.nonzero(~has)
    if kept < 2 or not len(of):
        return None
    mean = x.mean(axis=2)
    apart = x - mean[:, :, None]
    s, u = np.linalg.eigh(apart @ apart.transpose(0, 2, 1) / (kept - 1))
    factor = u * np.sqrt(np.abs(s))[:, None]
    missing = m - has.sum(axis=1)
    z = np.concatenate([np.random.default_rng([seed, int(k)]).standard_normal((c, r)) for k, c in zip(series, missing) if c])
    return of, j, mean[of] + (z[:, None] @ factor[of].transpose(0, 2, 1))[:, 0]


def _refill_one(pdf: pd.DataFrame, m: int, seed: int) -> list[tuple]:
    """The new rows of one series of any shape."""
    x = pdf.pivot(index="row_id", columns="member", values="value").sort_index()
    missing = [j for j in range(m) if j not in set(x.columns)]
    if not missing or x.shape[1] < 2:
        return []
    rng = np.random.default_rng([seed, int(pdf["series_id"].iloc[0])])
    new = rng.multivariate_normal(x.mean(axis=1), np.atleast_2d(np.cov(x.to_numpy())), size=len(missing), method="eigh")
    return [(pdf["series_id"].iloc[0], pdf["step"].iloc[0], int(r), j, float(v)) for j, row in zip(missing, new) for r, v in zip(x.index, row)]
