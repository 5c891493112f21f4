"""Ensemble Kalman analyses in two stages: weights from the observable rows of each (series, cycle), then a row-wise update.

For the stochastic and the bias-regularised filters any row a becomes a + (a - mean) X with one m x m matrix X for a cycle; the square-root
filter has a vector w and a matrix T. The first stage sees q x m numbers in each group; the second takes small weights to the state rows, or streams
state rows past their weights, so the number of state rows has no bound. Scalar observations have closed forms in plain columns. Empty tables give empty results; rows of one
(series, cycle) have equally many members; repeated rows are rows of their own.

Packed rows: ``rows`` (series_id, cycle, row_id, kind, vals array<double>); ``obs`` (series_id, cycle, dim, d, cdd) where dim numbers the
observable rows in order of row_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from assimspark.functions import kernels
from assimspark.functions.names import own_names
from assimspark.functions.storage import new_folder

#: Up to so many cycles their weights are made first and measured; up to so many bytes they then go to the tasks, and state rows stay where they are.
FEW_CYCLES, WEIGHT_BYTES = 10_000, 64 << 20
WEIGHTS = "series_id long, cycle long, m int, x array<double>, w array<double>"


def pack(ens: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows (keys, member, value) as one row with the members' values in order."""
    return ens.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "value"))), lambda s: s["value"]).alias("vals"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each list starts in them (one more number at the end)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _as_lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([p.size for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *(p.ravel() for p in parts)])))


def weights(rows: DataFrame, obs: DataFrame, method: str = "enkf", k: float = 1.0, perturb: bool = True, seed: int = 0) -> DataFrame:
    """One row of weights for each (series, cycle). For rba methods obs also has b and jac (array: the row of the sensitivity), optionally cbb.

    The q observable rows of a (series, cycle) are packed; cycles of equal shape in an Arrow batch are solved side by side. A cycle without
    observations, an observation without rows and a cycle with a null observable, d or cdd give no weights.
    """
    aware = method.startswith("rba")
    extra = [c for c in ("b", "cbb", "jac") if aware and c in obs.columns]
    seen = rows.where("kind = 'obs'").select("series_id", "cycle", (F.row_number().over(Window.partitionBy("series_id", "cycle").orderBy("row_id")) - 1).alias("dim"), "vals")
    met = seen.join(obs.select("series_id", "cycle", "dim", "d", "cdd", *extra), ["series_id", "cycle", "dim"])
    packed = met.groupBy("series_id", "cycle").agg(F.array_sort(F.collect_list(F.struct("dim", "vals", "d", "cdd", *extra))).alias("p"))
    packed = packed.where(F.forall("p", lambda s: s["vals"].isNotNull() & s["d"].isNotNull() & s["cdd"].isNotNull()))
    flat = lambda c: F.flatten(F.transform("p", lambda s: s[c])).cast("array<double>").alias(c)
    plain = lambda c: F.transform("p", lambda s: s[c].cast("double")).alias(c)
    columns = [flat("vals"), *(flat(c) if c == "jac" else plain(c) for c in ("d", "cdd", *extra))]

    def solve(y: np.ndarray, d: np.ndarray, cdd: np.ndarray, more: dict[str, np.ndarray], noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = d[..., None] + np.sqrt(cdd)[..., None] * noise
        none = np.zeros((len(y), 0))
        if method == "enkf":
            return kernels.enkf_weights(y, many, cdd), none
        if method == "ensrkf":
            w, x = kernels.ensrkf_weights(y, d, cdd)
            return x, w
        return kernels.rba_weights(y, many, cdd, more["b"], more["jac"].reshape(*d.shape, d.shape[-1]), k, more.get("cbb"), method == "rba_enkf"), none

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: _lists(batch.column(c)) for c in ("vals", "d", "cdd", *extra)}
            series, cycles = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("series_id", "cycle"))
            q = np.diff(lists["d"][1])
            m = np.diff(lists["vals"][1]) // np.maximum(q, 1)
            x, w = [None] * len(q), [None] * len(q)
            for shape in set(zip(q.tolist(), m.tolist())):
                own = np.flatnonzero((q == shape[0]) & (m == shape[1]))
                part = {c: np.stack([values[starts[i]:starts[i + 1]] for i in own]) for c, (values, starts) in lists.items()}
                noise = np.stack([kernels.perturbations(int(series[i]), int(cycles[i]), shape, seed) for i in own]) if perturb and method != "ensrkf" else np.zeros((len(own), *shape))
                xs, ws = solve(part["vals"].reshape(len(own), *shape), part["d"], part["cdd"], part, noise)
                for i, a, b in zip(own, xs, ws):
                    x[i], w[i] = a, b
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), batch.column("cycle"), pa.array(m.astype(np.int32)), _as_lists(x), _as_lists(w)], names=["series_id", "cycle", "m", "x", "w"])

    return packed.select(F.col("series_id").cast("long"), F.col("cycle").cast("long"), *columns).mapInArrow(work, WEIGHTS)


def apply(rows: DataFrame, found: DataFrame, spread: int = 1) -> DataFrame:
    """All rows updated by their cycle's weights; rows of a (series, cycle) without weights go, as in an inner join, and so do rows of null vals.

    Weights and rows are stacked, dealt by (series, cycle) once and sorted so that a cycle's weights come first; a task then streams its rows past
    them, with one matrix product for each cycle and Arrow batch, so a cycle may have any number of rows. With ``spread`` over 1 a cycle's
    rows go to so many tasks, each with a copy of the weights: for tables with few cycles of very many rows.
    """
    keys, rest = ["series_id", "cycle"], [c for c in rows.columns if c not in ("series_id", "cycle", "vals")]
    row = StructType([rows.schema[c] for c in rest])
    salt = F.pmod(F.xxhash64("vals", *(["row_id"] if "row_id" in rest else [])), F.lit(spread)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("__s")
    none = F.lit(None)
    first = found.select(*(F.col(k).cast(rows.schema[k].dataType) for k in keys), copies, F.lit(0).alias("__o"), none.cast(row).alias("__r"), F.col("x").alias("__v"), F.col("w").alias("__w"), F.col("m").alias("__m"))
    later = rows.where(F.col("vals").isNotNull()).select(*keys, salt.alias("__s"), F.lit(1).alias("__o"), F.struct(*rest).cast(row).alias("__r"), F.col("vals").cast("array<double>").alias("__v"), none.cast("array<double>").alias("__w"), none.cast("int").alias("__m"))
    met = first.unionAll(later).repartition(*keys, "__s").sortWithinPartitions(*keys, "__s", "__o")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last weights: keys, x, w, m
        for batch in batches:
            (v, v_at), (w, w_at) = (_lists(batch.column(c)) for c in ("__v", "__w"))
            names, order = [batch.column(c).to_pylist() for c in keys], batch.column("__o").to_numpy(zero_copy_only=False)
            members = batch.column("__m").to_pylist()
            key = list(zip(*names))
            starts = np.flatnonzero(order == 0).tolist()
            taken, out = np.zeros(len(order), bool), []
            for a, b in zip([-1, *starts], [*starts, len(order)]):
                if a >= 0:
                    m = members[a]
                    held = (key[a], v[v_at[a]:v_at[a + 1]].reshape(m, m), w[w_at[a]:w_at[a + 1]], m)
                if held is None or a + 1 >= b or key[a + 1] != held[0]:
                    continue
                end = a + 1
                while end < b and key[end] == held[0]:
                    end += 1
                values = v[v_at[a + 1]:v_at[end]].reshape(-1, held[3])
                out.append(kernels.apply_square_root(values, held[2], held[1]) if len(held[2]) else kernels.apply_weights(values, held[1]))
                taken[a + 1:end] = True
            if out:
                kept = batch.filter(pa.array(taken))
                sizes = np.concatenate([np.full(len(o), o.shape[1]) for o in out])
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in (*keys, "__r")), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([o.ravel() for o in out])))], names=[*keys, "__r", "__v"])

    schema = StructType([*(rows.schema[c] for c in keys), StructField("__r", row), StructField("__v", ArrayType(DoubleType()))])
    done = met.mapInArrow(work, schema)
    return done.select(*keys, *(F.col(f"__r.`{c}`").alias(c) for c in rest), F.col("__v").alias("vals")).select(*rows.columns)


def apply_in_place(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The same without a shuffle of the rows: the weights are sent to each task whole, so they must be small (``analyse`` measures them)."""
    keys, columns = ["series_id", "cycle"], rows.columns
    table = found.select(*keys, "m", "x", "w").toArrow().combine_chunks()
    names = list(zip(*(table.column(c).to_pylist() for c in keys)))
    values = {c: _lists(table.column(c).combine_chunks()) if len(table) else (np.zeros(0), np.zeros(1, int)) for c in ("x", "w")}
    sent = rows.sparkSession.sparkContext.broadcast((names, table.column("m").to_pylist(), values))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, members, lists = sent.value
        place = {k: i for i, k in enumerate(held)}
        (x, x_at), (w, w_at) = lists["x"], lists["w"]
        for batch in batches:
            at = np.array([place.get(k, -1) for k in zip(*(batch.column(c).to_pylist() for c in keys))], int)
            order = np.flatnonzero(at >= 0)[np.argsort(at[at >= 0], kind="stable")]
            if not len(order):
                continue
            kept, own = batch.take(pa.array(order)), at[order]
            v, v_at = _lists(kept.column("vals"))
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                i = own[a]
                m, wi = members[i], w[w_at[i]:w_at[i + 1]]
                part, xi = v[v_at[a]:v_at[b]].reshape(-1, m), x[x_at[i]:x_at[i + 1]].reshape(m, m)
                out.append(kernels.apply_square_root(part, wi, xi) if len(wi) else kernels.apply_weights(part, xi))
            ends = np.concatenate(([0], np.cumsum(np.concatenate([np.full(len(o), o.shape[1]) for o in out])))).astype(np.int32)
            moved = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([o.ravel() for o in out])))
            yield pa.RecordBatch.from_arrays([moved if c == "vals" else kept.column(c) for c in columns], names=columns)

    schema = StructType([StructField("vals", ArrayType(DoubleType())) if f.name == "vals" else f for f in rows.schema])
    return rows.where(F.col("vals").isNotNull()).withColumn("vals", F.col("vals").cast("array<double>")).mapInArrow(work, schema)


def analyse(rows: DataFrame, obs: DataFrame, method: str = "enkf", spread: int = 1, **how) -> DataFrame:
    """Both stages. Where cycles are few and their weights small (both are counted), as for long fields, only the weights move, and the table of rows
    is read where it lies; where weights are many, and so no smaller than the rows, both are dealt by (series, cycle)."""
    found = weights(rows, obs, method, **how)
    if obs.select("series_id", "cycle").distinct().count() <= FEW_CYCLES:
        path = new_folder(rows.sparkSession, "weights")
        found.write.parquet(path)
        found = rows.sparkSession.read.schema(WEIGHTS).parquet(path)
        if 8 * (found.agg(F.sum(F.size("x") + F.size("w"))).first()[0] or 0) <= WEIGHT_BYTES:
            return apply_in_place(rows, found)
    return apply(rows, found, spread)


def scalar_analysis(ens: DataFrame, method: str = "enkf", key: str = "series_id", y: str = "y", states: tuple[str, ...] = ("a",), d: str = "d", r: str = "r", b: str = "b", jac: str = "jac", k: float = 1.0) -> DataFrame:
    """The analysis for one observation a group in closed form, as window columns: one row for each member with its states, observable y,
    (perturbed) observation d and error variance r. With a zero spread nothing moves. rba also reads columns b and jac."""
    w = Window.partitionBy(key)
    mean_y, m = F.avg(y).over(w), F.count("*").over(w)
    dy, my, count, spread = own_names(ens, "dy", "my", "m", "v").values()
    da = own_names(ens, *("da_" + s for s in states))
    out = ens.withColumn(dy, F.col(y) - mean_y).withColumn(my, mean_y).withColumn(count, m)
    out = out.withColumn(spread, F.sum(F.col(dy) * F.col(dy)).over(w))
    noise = (F.col(count) - 1) * F.col(r)

    def update(s: str) -> Column:
        c = F.sum(F.col(da["da_" + s]) * F.col(dy)).over(w)
        if method == "enkf":
            gain = F.when(noise + F.col(spread) > 0, c / (noise + F.col(spread))).otherwise(F.lit(0.0))
            return F.col(s) + gain * (F.col(d) - F.col(y))
        if method == "ensrkf":
            v, total = F.col(spread), noise + F.col(spread)
            to_mean = F.when(total > 0, c / total * (F.col(d) - F.col(my))).otherwise(F.lit(0.0))
            shrink = F.when(v > 0, c / v * (1 - F.sqrt(F.greatest(1 - v / total, F.lit(0.0))))).otherwise(F.lit(0.0))
            return F.col(s) + to_mean - shrink * F.col(dy)
        j = F.col(jac)
        total = noise + ((1 + j) * (1 + j) + k * j * j) * F.col(spread)
        residual = (1 + j) * (F.col(d) - F.col(y) - F.col(b)) - k * j * F.col(b)
        return F.col(s) + F.when(total > 0, c / total).otherwise(F.lit(0.0)) * residual

    out = out.withColumns({da["da_" + s]: F.col(s) - F.avg(s).over(w) for s in states})
    return out.withColumns({s + "_a": update(s) for s in states}).select(*ens.columns, *(s + "_a" for s in states))
