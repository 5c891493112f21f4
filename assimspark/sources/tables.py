"""Readers and writers: recordings, snapshot fields, run results by sweep cell, state histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assimspark.functions.maps import zero_bad


def read_signals(spark: SparkSession, path: str, channels: list[str], key: str = "series_id", t: str = "t", step: str = "step") -> DataFrame:
    """A wide recording (one column for each channel) in long form: series_id, step, t, dim, y."""
    return wide_to_long(spark.read.parquet(path), channels, key, t, step)


def wide_to_long(wide: DataFrame, channels: list[str], key: str = "series_id", t: str = "t", step: str = "step") -> DataFrame:
    values = F.posexplode(F.array(*(F.col(c).cast("double") for c in channels))).alias("dim", "y")
    return wide.select(F.col(key).alias("series_id"), F.col(step).alias("step"), F.col(t).alias("t"), values)


def read_field(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots (step, comp, ix, iy, value) with NaN and infinities as 0."""
    return clean_field(spark.read.parquet(path))


def clean_field(field: DataFrame, value: str = "value") -> DataFrame:
    return field.withColumn(value, zero_bad(F.col(value)))


def field_to_rows(field: DataFrame, point: list[str], value: str = "value") -> DataFrame:
    """One row for each point with its values in order of step."""
    packed = F.array_sort(F.collect_list(F.struct("step", value)))
    return field.groupBy(*point).agg(F.transform(packed, lambda x: x[value]).alias("snaps"))


def field_to_chunks(field: DataFrame, point: list[str], value: str = "value", chunk: int = 1024) -> DataFrame:
    """(point, chunk, present, snaps): the values of each point in blocks of ``chunk`` steps, so a row is bounded however long the field is.

    Bit b of word w of ``present`` says whether step 64 w + b of the block is there; ``snaps`` has the values of those that are, in order. A missing
    step thus shifts nothing. Of repeated cells the largest counts; a null value is a missing step, and a null step no cell. ``chunk`` is a
    multiple of 64.
    """
    if chunk < 64 or chunk % 64:
        raise ValueError("chunk must be a multiple of 64")
    cells = field.where(F.col("step").isNotNull() & F.col(value).isNotNull()).groupBy(*point, "step").agg(F.max(value).alias("v"))
    own = F.floor(F.col("step") / chunk).cast("long")
    packed = cells.groupBy(*point, own.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(F.pmod("step", F.lit(chunk)).cast("int").alias("at"), "v"))).alias("p"))
    bit = lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x["at"], F.lit(64))))
    words = F.transform(F.sequence(F.lit(0), F.lit(chunk // 64 - 1)), lambda w: F.aggregate(F.filter("p", lambda x: F.floor(x["at"] / 64) == w), F.lit(0).cast("long"), bit))
    return packed.select(*point, "chunk", words.alias("present"), F.transform("p", lambda x: x["v"]).alias("snaps"))


def chunks_to_field(chunks: DataFrame, point: list[str], chunk: int = 1024) -> DataFrame:
    """(point, step, value) of blocks as field_to_chunks makes them; steps that aren't there have a null value."""
    at = F.posexplode(F.flatten(F.transform("present", lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftright", w, b).bitwiseAND(F.lit(1).cast("long")))))).alias("at", "there")
    before = F.expr("aggregate(slice(present, 1, at div 64), 0, (a, w) -> a + bit_count(w)) + bit_count(present[at div 64] & ~shiftleft(-1L, at % 64))")
    rows = chunks.select(*point, "chunk", "present", "snaps", at)
    return rows.select(*point, (F.col("chunk") * chunk + F.col("at")).alias("step"), F.when(F.col("there") == 1, F.get("snaps", before)).alias("value"))


def write_runs(runs: DataFrame, path: str, keys: list[str]) -> None:
    """One folder for each sweep cell. Cells that ``runs`` holds take the place of their former rows; all others stay as they are."""
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All cells; the keys come typed from the folders, so filters on them prune."""
    return spark.read.parquet(path)


def append_history(history: DataFrame, forecast: DataFrame) -> DataFrame:
    return history.unionByName(forecast)


def replace_last_state(history: DataFrame, analysis: DataFrame, keys: list[str]) -> DataFrame:
    """The history with the rows of the analysis in place of those with the same keys."""
    return history.join(analysis, keys, "left_anti").unionByName(analysis)


def split_by_time(df: DataFrame, n_wash: int, n_train: int, n_val: int, key: list[str] | None = None, order: str = "step") -> DataFrame:
    """wash / train / val / test labels by position in each series (the washout is the head of the training part's inputs)."""
    i = F.row_number().over(Window.partitionBy(*(key or ["series_id"])).orderBy(order)) - 1
    label = F.when(i < n_wash, "wash").when(i < n_wash + n_train, "train").when(i < n_wash + n_train + n_val, "val").otherwise("test")
    return df.withColumn("split", label)
