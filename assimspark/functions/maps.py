"""Column maps: virtual sensors, operating-condition parameters, flat indices, limits, key parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def virtual_sensors(modes: DataFrame, sensors: DataFrame, kind: str = "annular") -> DataFrame:
    """Observables at sensor positions. annular: eta1 cos(theta) + eta2 sin(theta) from (eta1, eta2); duct: -sum_j mu_j sin(omega_j x) from
    long rows (j, omega, mu). ``sensors`` is a table of positions (sensor, pos), small by nature; Spark picks the join."""
    met = modes.crossJoin(sensors)
    if kind == "annular":
        return met.withColumn("value", F.col("eta1") * F.cos("pos") + F.col("eta2") * F.sin("pos")).drop("eta1", "eta2")
    return met.groupBy("series_id", "step", "sensor").agg((-F.sum(F.col("mu") * F.sin(F.col("omega") * F.col("pos")))).alias("value"))


def params_from_condition(condition: Column, lines: dict[str, tuple[float, float]]) -> list[Column]:
    """Linear maps slope * condition + intercept, one column for each parameter."""
    return [(F.lit(a) * condition + F.lit(b)).alias(name) for name, (a, b) in lines.items()]


def flatten_index(comp: Column, ix: Column, iy: Column, nx: int, ny: int) -> Column:
    return comp * F.lit(nx * ny) + ix * F.lit(ny) + iy


def unflatten_index(point: Column, nx: int, ny: int) -> tuple[Column, Column, Column]:
    n = nx * ny
    return F.floor(point / n).cast("long"), F.floor((point % n) / ny).cast("long"), (point % ny).cast("long")


def repeat_per_component(sensors: DataFrame, n_comp: int, n_grid: int) -> DataFrame:
    """Each sensor point once for each component, offset by the grid size."""
    return sensors.withColumn("comp", F.explode(F.sequence(F.lit(0), F.lit(n_comp - 1)))).withColumn("point_id", F.col("point_id") + F.col("comp") * n_grid)


def scale_params(df: DataFrame, reference: DataFrame, key: str = "name", value: str = "value") -> DataFrame:
    """Each parameter divided by its reference value."""
    return df.join(reference.select(key, F.col("reference").alias("__ref")), key).withColumn(value, F.col(value) / F.col("__ref")).drop("__ref")


def limit_outliers(value: Column, largest: Column, cap: float | None = None) -> Column:
    """0 beyond the largest reference magnitude, and clipped at ``cap``."""
    out = F.when(F.abs(value) > largest, F.lit(0.0)).otherwise(value)
    return out if cap is None else F.least(out, F.lit(cap))


def run_key(path: Column) -> list[Column]:
    """Sweep keys from a run's path: L<digits>, _k<number>, and whether it was augmented."""
    return [F.regexp_extract(path, r"(?:^|/)L(\d+)", 1).cast("int").alias("L"), F.regexp_extract(path, r"_k(-?[0-9]+(?:\.[0-9]+)?)", 1).cast("double").alias("k"), F.contains(path, F.lit("_Augment")).alias("augmented")]


def zero_bad(value: Column) -> Column:
    """NaN and infinities become 0 (field data)."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)
