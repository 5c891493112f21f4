"""Modal reduction of fields with many points and many snapshots: a randomised range finder over blocks.

The fluctuation is kept as square blocks (point block, step block) of a shared table. Each pass multiplies it by a thin factor of a few more columns
than there are modes; the partial products are added up within tasks, then by block in two steps. A thin factor is made orthonormal by
triangular factors of its blocks that tasks stack and factor again (tall-skinny QR), so the driver sees matrices of the factor's width
alone, and nobody a side of the field. A factor goes to the blocks by broadcast while it is small, else by a join on the block's number.

Where singular values fall off slowly, more columns (``oversample``) or ``passes`` are needed for the same digits. A missing cell counts as its point's mean; repeated cells add up; an empty field has no modes; a null step, point or value takes no part;
modes of (nearly) zero size are left out, so fewer may come back. Identifiers should be dense: blocks that hold no cell aren't stored, but
sparse numbers spread a field over many blocks. A mode's sign is free, as ever; here its entry of largest size among the first block's is positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assimspark.functions.storage import new_folder

BLOCKS = "pb long, sb long, a binary"
#: Bytes of a thin factor that are broadcast at most.
MOST_BROADCAST = 64 << 20
#: Partial products that a task holds at most before it lets them go.
HELD = 64


def _kept(df: DataFrame, what: str) -> DataFrame:
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def means_of(field: DataFrame) -> DataFrame:
    return field.where("step is not null and value is not null").groupBy("point_id").agg(F.avg("value").alias("q_mean")).where("point_id is not null")


def field_blocks(field: DataFrame, means: DataFrame, side: int = 256) -> DataFrame:
    """The fluctuation of (step, point_id, value) as blocks of side x side numbers, points by steps, written to the shared folder."""
    at = lambda c: (F.floor(F.col(c) / F.lit(side))).cast("long")
    cells = field.where("step is not null and value is not null").join(means, "point_id").select(at("point_id").alias("pb"), at("step").alias("sb"), F.pmod("point_id", F.lit(side)).cast("int").alias("i"), F.pmod("step", F.lit(side)).cast("int").alias("j"), (F.col("value") - F.col("q_mean")).cast("double").alias("v"))
    # A group has at most side^2 cells, but for repeated ones.
    packed = cells.groupBy("pb", "sb", "i", "j").agg(F.sum("v").alias("v")).groupBy("pb", "sb").agg(F.collect_list("i").alias("i"), F.collect_list("j").alias("j"), F.collect_list("v").alias("v"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                a = np.zeros((side, side))
                a[np.asarray(r.i), np.asarray(r.j)] = r.v
                yield pd.DataFrame({"pb": [r.pb], "sb": [r.sb], "a": [a.tobytes()]})

    return _kept(packed.mapInPandas(work, BLOCKS), "field-blocks")


def _matrices(column: pd.Series, side: int) -> list[np.ndarray]:
    return [np.frombuffer(raw).reshape(side, -1) for raw in column]


def summed(parts: DataFrame, key: str, side: int) -> DataFrame:
    """The sum of the matrices of each key (key, salt, f): at most 16 meet in a group after those of a salt have been added up."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(_matrices(pdf["f"], side))
        return pd.DataFrame({key: pdf[key].iloc[:1], "salt": pdf["salt"].iloc[:1], "f": [total.tobytes()]})

    shape = f"{key} long, salt int, f binary"
    return parts.groupBy(key, "salt").applyInPandas(add, shape).withColumn("salt", F.lit(0)).groupBy(key, "salt").applyInPandas(add, shape).drop("salt")


def _products(blocks: DataFrame, key: str, side: int, width: int, thin: Callable[[pd.Series], np.ndarray], transposed: bool) -> DataFrame:
    """Partial products of blocks and thin matrices, added up within tasks by ``key``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: dict[int, np.ndarray] = {}
        salt = TaskContext.get().partitionId() % 16

        def rows() -> pd.DataFrame:
            return pd.DataFrame({key: list(held), "salt": salt, "f": [m.tobytes() for m in held.values()]}).astype({"salt": np.int32})

        for pdf in batches:
            for r in pdf.to_dict("records"):
                a = np.frombuffer(r["a"]).reshape(side, side)
                product = (a.T if transposed else a) @ thin(r)
                if r[key] in held:
                    held[r[key]] += product
                else:
                    if len(held) >= HELD:
                        yield rows()
                        held.clear()
                    held[r[key]] = product
        if held:
            yield rows()

    return _kept(summed(blocks.mapInPandas(work, f"{key} long, salt int, f binary"), key, side), "field-factor")


def first_product(blocks: DataFrame, side: int, width: int, seed: int) -> DataFrame:
    """The fluctuation times normal numbers that depend on the step alone: (pb, f)."""
    numbers = lambda r: np.random.default_rng([seed, int(r["sb"]) & 0x7FFFFFFFFFFFFFFF]).standard_normal((side, width))
    return _products(blocks, "pb", side, width, numbers, False)


def product(blocks: DataFrame, factor: DataFrame, side: int, width: int, transposed: bool) -> DataFrame:
    """The fluctuation times a factor by steps (sb, f), or with ``transposed`` its transpose times a factor by points (pb, f)."""
    on, key = ("pb", "sb") if transposed else ("sb", "pb")
    small = factor.count() * side * width * 8 <= MOST_BROADCAST
    met = blocks.join(F.broadcast(factor) if small else factor, on)
    return _products(met, key, side, width, lambda r: np.frombuffer(r["f"]).reshape(side, width), transposed)


def triangle(factor: DataFrame, side: int, width: int, tasks: int = 16) -> np.ndarray:
    """R of the factor's QR: tasks stack and factor their blocks, ``tasks`` of them the results, and the driver theirs."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, width))
        for pdf in batches:
            for raw in pdf["f"]:
                r = np.linalg.qr(np.vstack((r, np.frombuffer(raw).reshape(-1, width))), mode="r")
        if len(r):
            yield pd.DataFrame({"f": [np.ascontiguousarray(r).tobytes()]})

    met = factor.select("f").mapInPandas(reduce, "f binary").repartition(tasks).mapInPandas(reduce, "f binary").collect()  # at most ``tasks`` rows
    return np.linalg.qr(np.vstack([np.zeros((1, width)), *(np.frombuffer(x["f"]).reshape(-1, width) for x in met)]), mode="r")


def times(factor: DataFrame, m: np.ndarray, key: str, side: int) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(f=[(a @ m).tobytes() for a in _matrices(pdf["f"], side)])

    return factor.mapInPandas(work, f"{key} long, f binary")


def orthonormal(factor: DataFrame, key: str, side: int, width: int) -> tuple[DataFrame, int]:
    """A basis of the factor's columns and its width; directions of no size go. Done twice, for rounding."""
    for _ in range(2):
        _, s, vt = np.linalg.svd(triangle(factor, side, width), full_matrices=False)
        keep = s > 1e-13 * max(s.max(initial=0), 1e-300)
        if not keep.any():
            return factor, 0
        factor = times(factor, vt[keep].T / s[keep], key, side)
        width = int(keep.sum())
    return _kept(factor, "field-basis"), width


def randomised_svd(blocks: DataFrame, n_modes: int, side: int, oversample: int = 8, passes: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Left vectors (pb, f: side x modes), right vectors (sb, f) and singular values of a table of blocks."""
    width = n_modes + oversample
    q, width = orthonormal(first_product(blocks, side, width, seed), "pb", side, width)
    for _ in range(passes):
        if not width:
            break
        z, width = orthonormal(product(blocks, q, side, width, True), "sb", side, width)
        if width:
            q, width = orthonormal(product(blocks, z, side, width, False), "pb", side, width)
    if not width:
        empty = blocks.sparkSession.createDataFrame([], "pb long, f binary")
        return empty, empty.withColumnRenamed("pb", "sb"), np.zeros(0)
    z = product(blocks, q, side, width, True)
    _, s, vt = np.linalg.svd(triangle(z, side, width), full_matrices=False)  # z = right s vt, and the field is about q z'
    n = min(n_modes, int((s > 1e-12 * s[0]).sum()))
    left = times(q, vt[:n].T, "pb", side)
    head = left.orderBy("pb").limit(1).collect()
    sign = np.ones(n)
    if head:
        a = np.frombuffer(head[0]["f"]).reshape(side, n)
        sign = np.where(a[np.abs(a).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0)
    return _kept(times(left, np.diag(sign), "pb", side), "field-left"), _kept(times(z, vt[:n].T / s[:n] * sign, "sb", side), "field-right"), s[:n]


def _rows(factor: DataFrame, key: str, name: str, value: str, side: int) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, a in zip(pdf[key], _matrices(pdf["f"], side)):
                yield pd.DataFrame({name: k * side + np.arange(side), value: list(a)})

    return factor.mapInPandas(work, f"{name} long, {value} array<double>")


def pod_randomised(field: DataFrame, n_modes: int, oversample: int = 8, passes: int = 2, seed: int = 0, side: int = 256) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(modes: point_id, q_mean, psi; coefficients: step, phi; sigma) of a field (step, point_id, value) whose sides are both long."""
    field = field.select(F.col("step").cast("long"), F.col("point_id").cast("long"), F.col("value").cast("double"))
    means = _kept(means_of(field), "field-means")
    left, right, sigma = randomised_svd(field_blocks(field, means, side), n_modes, side, oversample, passes, seed)
    modes = means.join(_rows(left, "pb", "point_id", "psi", side), "point_id").select("point_id", "q_mean", "psi")
    return modes, _rows(right, "sb", "step", "phi", side).join(field.select("step").distinct(), "step", "left_semi"), sigma
