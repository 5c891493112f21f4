"""Gridded snapshots: domains, modal reduction, projection, energies, sensors, recurrences.

Packed rows: point_id, snaps array<double> (one value for each snapshot)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assimspark.functions.sums import sum_matrices


def cut_domain(field: DataFrame, box: tuple[float, float, float, float], origin: tuple[float, float], spacing: tuple[float, float], stride: tuple[int, int] = (1, 1)) -> DataFrame:
    """Points of a physical box [x0, x1, y0, y1], every stride-th along each axis of the cut, with new indices jx, jy. Arithmetic on the
    point's own row: no shuffle."""
    x, y = F.lit(origin[0]) + F.col("ix") * spacing[0], F.lit(origin[1]) + F.col("iy") * spacing[1]
    first = [int(np.ceil(round((lo - o) / s, 9))) for lo, o, s in ((box[0], origin[0], spacing[0]), (box[2], origin[1], spacing[1]))]
    first = [max(f, 0) for f in first]
    inside = field.where(x.between(box[0] - 1e-9, box[1] + 1e-9) & y.between(box[2] - 1e-9, box[3] + 1e-9))
    kept = inside.where(((F.col("ix") - first[0]) % stride[0] == 0) & ((F.col("iy") - first[1]) % stride[1] == 0))
    return kept.withColumn("jx", ((F.col("ix") - first[0]) / stride[0]).cast("long")).withColumn("jy", ((F.col("iy") - first[1]) / stride[1]).cast("long"))


def remove_mean(rows: DataFrame) -> DataFrame:
    """Each point's temporal mean (q_mean) and fluctuation."""
    mean = F.aggregate("snaps", F.lit(0.0), lambda a, x: a + x) / F.size("snaps")
    return rows.withColumn("q_mean", mean).withColumn("snaps", F.transform("snaps", lambda x: x - F.col("q_mean")))


#: The longest side of a matrix whose eigenvectors the driver finds.
MOST_SIDE = 8192


def gram(rows: DataFrame) -> np.ndarray:
    """The snapshot Gram matrix Q'Q: one matrix product a batch, summed within tasks first (0 x 0 without points)."""

    def each(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        q = np.stack(pdf["snaps"].to_list())
        return {0: q.T @ q}

    return sum_matrices(rows.select("snaps"), each).get(0, np.zeros((0, 0)))


def pod(rows: DataFrame, n_modes: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(modes: point_id, q_mean, psi; phi: steps x modes; sigma), for few snapshots of many points (else pod_by_points).

    Tasks and the driver see snapshots^2 numbers, never points; more than MOST_SIDE snapshots, or rows of different lengths, are refused.
    Repeated points count each time; without points there are no modes.
    """
    fluctuation = remove_mean(rows)
    sizes = rows.agg(F.min(F.size("snaps")), F.max(F.size("snaps"))).first()
    if sizes[0] != sizes[1] or (sizes[1] or 0) > MOST_SIDE:
        raise ValueError(f"points have {sizes[0]} to {sizes[1]} snapshots; all need the same number, {MOST_SIDE} at most")
    k = gram(fluctuation)
    lam, vec = np.linalg.eigh(k)
    pick = np.argsort(-lam)[:n_modes]
    sigma, phi = np.sqrt(np.maximum(lam[pick], 0)), vec[:, pick]
    scaled = phi / np.where(sigma > 0, sigma, 1)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"point_id": pdf["point_id"], "q_mean": pdf["q_mean"], "psi": list(np.stack(pdf["snaps"].to_list()) @ scaled)})

    return fluctuation.select("point_id", "q_mean", "snaps").mapInPandas(work, "point_id long, q_mean double, psi array<double>"), phi, sigma


def pod_by_points(field: DataFrame, n_modes: int) -> tuple[DataFrame, np.ndarray, int]:
    """(modes: point_id, q_mean, psi; sigma; number of snapshots), for fields of fewer points than snapshots. field: step, point_id, value.

    The points' covariance is summed over packed snapshots within tasks first, so the driver and each task see points^2 numbers however many
    snapshots there are; more than MOST_SIDE points are refused. Coefficients come from project(). Every snapshot needs all points, once
    each; an empty field has no modes."""
    spark = field.sparkSession
    means = field.groupBy("point_id").agg(F.avg("value").alias("m"))
    n_points = means.count()
    if n_points > MOST_SIDE:
        raise ValueError(f"{n_points} points; {MOST_SIDE} at most, else see pod, and low_rank where both sides are long")
    found = means.orderBy("point_id").collect()  # at most MOST_SIDE rows
    points, shift = [r["point_id"] for r in found], np.array([r["m"] for r in found])
    packed = field.groupBy("step").agg(F.transform(F.array_sort(F.collect_list(F.struct("point_id", "value"))), lambda x: x["value"]).alias("q"))

    def each(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        q = np.stack(pdf["q"].to_list()) - shift
        return {0: q.T @ q, 1: np.array([[float(len(q))]])}

    found = sum_matrices(packed.select("q"), each)
    c, n = found.get(0, np.zeros((0, 0))), int(found[1][0, 0]) if found else 0
    lam, vec = np.linalg.eigh(c)
    pick = np.argsort(-lam)[:n_modes]
    rows = [(int(p), float(m), [float(x) for x in v]) for p, m, v in zip(points, shift, vec[:, pick])]
    return spark.createDataFrame(rows, "point_id long, q_mean double, psi array<double>"), np.sqrt(np.maximum(lam[pick], 0)), n


def project(field: DataFrame, modes: DataFrame, sigma: list[float]) -> DataFrame:
    """Mode coefficients of each snapshot: sum of psi (q - mean) over points, over sigma. field: step, point_id, value."""
    s = F.array(*(F.lit(float(x)) for x in sigma))
    each = field.join(modes, "point_id").select("step", F.posexplode("psi").alias("mode", "psi"), (F.col("value") - F.col("q_mean")).alias("dq"))
    return each.groupBy("step", "mode").agg(F.sum(F.col("psi") * F.col("dq")).alias("p")).select("step", "mode", (F.col("p") / F.get(s, F.col("mode"))).alias("phi"))


def reconstruct(coeffs: DataFrame, modes: DataFrame, sigma: list[float], n: int | None = None, points: DataFrame | None = None) -> DataFrame:
    """mean + psi (sigma phi) for each point and step, from the first n modes. coeffs: step, phi array. A product of points and steps by
    definition; the dot product is an array expression on the joined row."""
    n = n or len(sigma)
    s = F.array(*(F.lit(float(x)) for x in sigma[:n]))
    kept = modes if points is None else modes.join(points, "point_id", "left_semi")
    scaled = coeffs.select("step", F.zip_with(F.slice("phi", 1, n), s, lambda p, x: p * x).alias("c"))
    dot = F.aggregate(F.zip_with(F.slice("psi", 1, n), F.col("c"), lambda p, c: p * c), F.lit(0.0), lambda a, x: a + x)
    return kept.crossJoin(scaled).select("point_id", "step", (F.col("q_mean") + dot).alias("value"))


def truncate_modes(modes: DataFrame, n: int) -> DataFrame:
    return modes.withColumn("psi", F.slice("psi", 1, n))


def field_mse(a: DataFrame, b: DataFrame, by_time: bool = True) -> DataFrame:
    """Mean squared difference of two fields (step, point_id, value): for each step or overall."""
    met = a.join(b.withColumnRenamed("value", "other"), ["step", "point_id"]).withColumn("e", F.pow(F.col("value") - F.col("other"), F.lit(2.0)))
    return met.groupBy("step").agg(F.avg("e").alias("mse")) if by_time else met.agg(F.avg("e").alias("mse"))


def error_field(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("value", "other"), ["step", "point_id"]).select("step", "point_id", F.abs(F.col("value") - F.col("other")).alias("error"))


def kinetic_energy(rows: DataFrame) -> DataFrame:
    """Half the sum over points of the temporal variance."""
    mean = F.aggregate("snaps", F.lit(0.0), lambda a, x: a + x) / F.size("snaps")
    var = rows.select("snaps", mean.alias("m")).select((F.aggregate(F.transform("snaps", lambda x: (x - F.col("m")) * (x - F.col("m"))), F.lit(0.0), lambda a, x: a + x) / F.size("snaps")).alias("v"))
    return var.agg((F.sum("v") / 2).alias("tke"))


def modal_energy(sigmas: DataFrame, n_steps: int) -> DataFrame:
    """From (mode, sigma): energy sigma^2 / (2 steps), share of the first mode's eigenvalue, cumulative share. One row for each mode."""
    lam = F.col("sigma") * F.col("sigma")
    up = Window.orderBy("mode").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("mode").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sigmas.select("mode", (lam / (2 * n_steps)).alias("energy"), (lam / F.first(lam).over(every)).alias("spectrum"), (F.sum(lam).over(up) / F.sum(lam).over(every)).alias("cumulative"))


def rank_sensors(modes: DataFrame, n: int, allowed: DataFrame | None = None) -> list[int]:
    """Column-pivoted QR on the mode matrix, greedily: n rounds of the point of largest remaining norm. n is at most the number of modes, and
    only the chosen rows (n x modes numbers) travel; each round is one pass over the points with the basis found so far."""
    rows = modes if allowed is None else modes.join(allowed, "point_id", "left_semi")
    chosen: list[int] = []
    basis: list[list[float]] = []
    for _ in range(n):
        left = F.aggregate("psi", F.lit(0.0), lambda a, x: a + x * x)
        for q in basis:
            dot = F.aggregate(F.zip_with("psi", F.array(*map(F.lit, q)), lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
            left = left - dot * dot
        top = rows.select(F.struct(left.alias("norm"), (-F.col("point_id")).alias("np")).alias("k"), "psi").agg(F.max(F.struct("k", "psi")).alias("x")).first()["x"]
        if top is None or top["k"]["norm"] <= 1e-12:
            break
        chosen.append(-top["k"]["np"])
        v = np.asarray(top["psi"], float)
        for q in basis:
            v = v - np.dot(v, q) * np.asarray(q)
        basis.append((v / np.linalg.norm(v)).tolist())
    return chosen


def _pivots(psi: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n rows that column-pivoted QR chooses, in order; of equal norms the smaller id."""
    order = np.argsort(ids, kind="stable")
    left, out = psi[order].astype(float), []
    for _ in range(min(n, len(left))):
        norms = (left * left).sum(axis=1)
        k = int(norms.argmax())
        if norms[k] <= 1e-12:
            break
        out.append(k)
        q = left[k] / np.sqrt(norms[k])
        left -= np.outer(left @ q, q)
    return order[out]


def rank_sensors_once(modes: DataFrame, n: int, allowed: DataFrame | None = None, tasks: int = 16) -> list[int]:
    """Sensors by tournament pivoting: one pass over the points. Each task chooses n of its points by column-pivoted QR, ``tasks`` of them choose among the
    winners, and the driver among at most ``tasks`` x n.

    With one task it is the greedy choice of rank_sensors; with more the sensors can differ, but a point that stands out in all is never lost:
    each round keeps rows that span all of its input up to the pivots' factor. Points of no size are never chosen; null modes take no part.
    """
    rows = (modes if allowed is None else modes.join(allowed, "point_id", "left_semi")).select("point_id", "psi").where("psi is not null")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat((held, pdf))
            if len(held):
                held = held.iloc[_pivots(np.stack(held["psi"].to_list()), held["point_id"].to_numpy(), n)]
        if held is not None and len(held):
            yield held

    schema = "point_id long, psi array<double>"
    last = rows.mapInPandas(choose, schema).repartition(tasks).mapInPandas(choose, schema).toPandas()  # at most tasks x n rows
    return [int(p) for p in last["point_id"].to_numpy()[_pivots(np.stack(last["psi"].to_list()), last["point_id"].to_numpy(), n)]] if len(last) else []


def random_sensors(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points without replacement, in order; all of them if there are no more."""
    return points.select("point_id").distinct().orderBy(F.xxhash64("point_id", F.lit(seed)), "point_id").limit(n).orderBy("point_id")


#: Steps of a mode, after thinning, whose distances are ranked in one task; the pairs of more would be beyond any use.
MOST_STEPS = 1 << 24
#: Buckets to a limit's width, in the join of pairs.
FINE = 16


def _count_within(x: np.ndarray, t: float) -> int:
    """Ordered pairs of the sorted values at most t apart, each with itself included."""
    at = np.searchsorted(x, x + t, side="right")
    with np.errstate(invalid="ignore"):
        while True:  # rounding of x + t can be off by neighbours
            up = at < len(x)
            up[up] = x[at[up]] - x[up] <= t
            if not up.any():
                break
            at[up] = np.searchsorted(x, x[at[up]], side="right")
        while (down := x[at - 1] - x > t).any():
            at[down] = np.searchsorted(x, x[at[down] - 1], side="left")
    after = at - np.arange(1, len(x) + 1)  # later ones in order; equal values count from both sides
    return int(len(x) + 2 * after.sum())


def _around_percentile(x: np.ndarray, share: float) -> tuple[float, float, float]:
    """The two distances of all ordered pairs between which the percentile lies, and how far it lies towards the second. Distances are found by
    bisection on their bits."""
    x = np.sort(x)

    def ranked(k: int) -> float:
        low, high = 0, int(np.array(x[-1] - x[0]).view(np.int64))  # bits of positive numbers are in their order
        while low < high:
            middle = (low + high) // 2
            if _count_within(x, float(np.array(middle).view(np.float64))) > k:
                high = middle
            else:
                low = middle + 1
        return float(np.array(low).view(np.float64))

    place = share * (len(x) * len(x) - 1)
    k = int(place)
    first = ranked(k)
    return first, first if k == place or _count_within(x, first) > k + 1 else ranked(k + 1), place - k


def distance_percentile(x: np.ndarray, share: float) -> float:
    """The interpolated percentile of the distances of all ordered pairs."""
    first, second, part = _around_percentile(x, share)
    return first if first == second else first + part * (second - first)


def recurrence_limit(x: np.ndarray, share: float) -> float:
    """The same percentile, rounded as SQL's ``quantile_cont`` is: by one bit it may lie beside a distance that many pairs have."""
    first, second, part = _around_percentile(x, share)
    return math.fma(first, 1 - part, second * part) if part else first


def recurrence_pairs(coeffs: DataFrame, percent: float = 0.2, stride: int = 1) -> DataFrame:
    """(mode, i, j) with |x_i - x_j| below the given percentile of that mode's distances; all ordered pairs, the diagonal included.

    Steps are thinned by ``stride`` first. A mode's limit is found without making its pairs, by counting within sorted values; then values meet
    in buckets of a sixteenth of the limit, so few pairs beyond it are looked at. The result grows with the square of a mode's steps by
    definition. Null and NaN values take no part; repeated steps are steps of their own; a mode whose limit is 0 has no pairs.
    """
    x = coeffs.where((F.col("step") % stride == 0) & F.col("x").isNotNull() & ~F.isnan("x")).select("mode", "step", F.col("x").cast("double").alias("x"))
    most = x.groupBy("mode").count().agg(F.max("count")).first()[0] or 0
    if most > MOST_STEPS:
        raise ValueError(f"{most} steps of a mode; thin them to {MOST_STEPS}")
    kind = x.schema["mode"].dataType.simpleString()

    def limits(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"mode": pdf["mode"].iloc[:1], "limit": [recurrence_limit(pdf["x"].to_numpy(), percent)]})

    limit = x.select("mode", "x").groupBy("mode").applyInPandas(limits, f"mode {kind}, limit double").where("limit > 0")
    placed = x.join(limit, "mode").withColumn("bucket", F.floor(F.col("x") / F.col("limit") * FINE))
    near = F.explode(F.sequence(F.col("bucket") - FINE - 1, F.col("bucket") + FINE + 1)).alias("bucket")
    left = placed.select("mode", F.col("step").alias("i"), F.col("x").alias("xi"), "limit", near)
    right = placed.select("mode", F.col("step").alias("j"), F.col("x").alias("xj"), "bucket")
    return left.join(right, ["mode", "bucket"]).where(F.abs(F.col("xi") - F.col("xj")) < F.col("limit")).select("mode", "i", "j")
