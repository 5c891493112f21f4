"""The logical tables (signals, ensembles, fields, runs) as views of the given tables, in DataFrame form and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits) + F.lit(0.0)


DT = 0.1


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each user, steps in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = (F.row_number().over(w) - 1).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), step.alias("step"), F.lit(0).cast("long").alias("dim"), F.col("value").alias("y")).withColumn("t", F.col("step") * DT)


SIG = "sig as (select user_id as series_id, row_number() over (partition by user_id order by ts, event_id) - 1 as step, 0::bigint as dim, value as y, (row_number() over (partition by user_id order by ts, event_id) - 1)::double * 0.1::double as t from events)"


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the event type as dim and an estimate e."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    step = (F.row_number().over(w) - 1).cast("long")
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), step.alias("step"), F.col("event_type").alias("dim"), F.col("value").alias("y"))
    return df.withColumn("e", F.lit(0.9) * F.col("y") + F.lit(0.05) * (F.col("step") % 7))


CHN = "chn as (select *, 0.9::double * y + 0.05::double * (step % 7) as e from (select user_id as series_id, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as step, event_type as dim, value as y from events))"


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ensemble for each part: members are its order lines, a the price, p the discount, y the quantity."""
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("series_id"), (F.row_number().over(w) - 1).cast("long").alias("member"), (F.col("l_extendedprice") / 1000).alias("a"), F.col("l_discount").alias("p"), F.col("l_quantity").alias("y"))


ENS = "ens as (select l_partkey as series_id, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 as member, l_extendedprice / 1000 as a, l_discount as p, l_quantity as y from lineitem)"


def long_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 0 (state), 1 (parameter), 2 (observable) of each ensemble."""
    rows = F.posexplode(F.array("a", "p", "y")).alias("row_id", "value")
    df = ensemble(spark, sf_dir).select("series_id", "member", rows)
    kind = F.element_at(F.array(*map(F.lit, ("state", "param", "obs"))), F.col("row_id") + 1)
    return df.select("series_id", F.lit(0).cast("long").alias("step"), "row_id", kind.alias("kind"), F.concat(F.lit("x"), F.col("row_id")).alias("name"), "member", "value")


LNG = "lng as (select series_id, 0::bigint as step, row_id, case row_id when 0 then 'state' when 1 then 'param' else 'obs' end as kind, 'x' || row_id as name, member, case row_id when 0 then a when 1 then p else y end as value from ens, (values (0), (1), (2)) v(row_id))"


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of an 8 x 8 grid, one for each embedding."""
    cells = F.posexplode("embedding").alias("point_id", "value")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("step"), cells).select("step", F.col("point_id").cast("long").alias("point_id"), F.lit(0).alias("comp"), F.floor(F.col("point_id") / 8).cast("long").alias("ix"), (F.col("point_id") % 8).cast("long").alias("iy"), F.col("value").cast("double").alias("value"))


FLD = "fld as (select step, i as point_id, 0 as comp, i // 8 as ix, i % 8 as iy, v::double as value from (select vec_id as step, unnest(range(len(embedding))) as i, unnest(embedding) as v from embeddings))"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep cells (L, k): steps 1..50, dims, truth and two estimates."""
    y = F.col("l_extendedprice") / 1000
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("L"), F.col("l_discount").alias("k"), F.col("l_quantity").cast("long").alias("step"), F.col("l_returnflag").alias("dim"), y.alias("y"), (y * (1 + F.col("l_tax"))).alias("biased"), (y * (1 + F.col("l_tax") / 2)).alias("unbiased"))


RUN = "run as (select l_linenumber as L, l_discount as k, l_quantity::bigint as step, l_returnflag as dim, l_extendedprice / 1000 as y, l_extendedprice / 1000 * (1 + l_tax) as biased, l_extendedprice / 1000 * (1 + l_tax / 2) as unbiased from lineitem)"
