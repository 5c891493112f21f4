"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assimspark.functions import maps, noise
from assimspark.functions.kernels import random_reservoir
from assimspark.functions.storage import new_folder
from assimspark.operators import align, ensemble, fields, filters, low_rank, metrics, reservoir, timegrid, truth
from assimspark.plans import cycle, field_cycle, inputs
from assimspark.plans.inputs import CHN, DT, ENS, FLD, LNG, RUN, SIG, rounded
from assimspark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Values on a short decimal grid would often lie on a rounding tie, which engines break differently; this moves them off it.
OFF_TIES = 1.23456789e-7


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def R(c, n=6):  # noqa: N802
    return rounded(F.col(c) if isinstance(c, str) else c, n)


# --- sources, sinks, shaping


@query("select l_orderkey as series_id, l_linenumber as step, l_shipdate as t, d as dim, case d when 0 then l_quantity when 1 then l_extendedprice else l_discount end as y from lineitem, (values (0), (1), (2)) v(d)")
def a1_wide_to_long(spark, sf):
    return tables.wide_to_long(inputs.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], "l_orderkey", "l_shipdate", "l_linenumber")


@query(f"with {SIG}, b as (select series_id, arg_min(step, abs(t - 1.02::double) * 1000000 + step) as i0, arg_min(step, abs(t - 3.0::double) * 1000000 + step) as i1 from sig group by series_id) select series_id, step, dim, round(y, 6) as y from sig join b using (series_id) where step >= i0 and step < i1")
def a2_cut_nearest(spark, sf):
    return timegrid.cut_nearest(inputs.signals(spark, sf), 1.02, 3.0).select("series_id", "step", "dim", R("y").alias("y"))


@query(f"with {FLD} select step, point_id, case when (step + point_id) % 7 = 0 then 0 else round(value, 6) + 0 end as value from fld")
def a3_clean_field(spark, sf):
    bad = F.when((F.col("step") + F.col("point_id")) % 7 == 0, F.when(F.col("step") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("value"))
    return tables.clean_field(inputs.field(spark, sf).withColumn("value", bad)).select("step", "point_id", R("value").alias("value"))


@query(f"with {FLD} select point_id, count(*) as n, round(sum(value * ((rn * 7919) % 1009)), 3) as checksum from (select *, row_number() over (partition by point_id order by step) as rn from fld) group by point_id")
def a4_field_to_rows(spark, sf):
    rows = tables.field_to_rows(inputs.field(spark, sf), ["point_id"])
    parts = F.transform("snaps", lambda v, i: v * (((i + 1) * 7919) % 1009))
    return rows.select("point_id", F.size("snaps").cast("long").alias("n"), R(F.aggregate(parts, F.lit(0.0), lambda a, v: a + v), 3).alias("checksum"))


@query(f"with {SIG} select series_id, step, case when rn < 10 then 'wash' when rn < 30 then 'train' when rn < 50 then 'val' else 'test' end as split from (select *, row_number() over (partition by series_id order by step) - 1 as rn from sig)")
def a5_split_by_time(spark, sf):
    return tables.split_by_time(inputs.signals(spark, sf), 10, 20, 20).select("series_id", "step", "split")


@query(f"with {RUN} select L, k, count(*) as n, round(sum(y), 3) as sum_y from run group by L, k")
def a6_a7_runs_round_trip(spark, sf):
    path = new_folder(spark, "runs")
    tables.write_runs(inputs.runs(spark, sf), path, ["L", "k"])
    return tables.read_runs(spark, path).groupBy("L", "k").agg(F.count("*").alias("n"), R(F.sum("y"), 3).alias("sum_y"))


@query(f"with {SIG}, l as (select series_id, max(step) as step from sig group by series_id) select s.series_id, s.step, round(case when l.step is not null then y + 1 else y end, 6) as y from sig s left join l using (series_id, step)")
def a8_replace_last_state(spark, sf):
    history = inputs.signals(spark, sf).select("series_id", "step", "y")
    analysis = timegrid.last_n(history, 1).withColumn("y", F.col("y") + 1)
    return tables.replace_last_state(history, analysis, ["series_id", "step"]).select("series_id", "step", R("y").alias("y"))


@query(f"with {SIG} select series_id, step, round(y, 6) as y from sig union all select series_id, step + 1000, round(y, 6) from sig")
def a8_append_history(spark, sf):
    h = inputs.signals(spark, sf).select("series_id", "step", R("y").alias("y"))
    return tables.append_history(h, h.withColumn("step", F.col("step") + 1000))


# --- truth and observations


@query(f"with {SIG} select series_id, step, (step - 10) // 5 as cycle, round(y, 6) as y from sig where step between 10 and 60 and (step - 10) % 5 = 0")
def b1_thin_observations(spark, sf):
    return timegrid.thin_observations(inputs.signals(spark, sf), 10.0, 60.0, 1.0, 5).select("series_id", "step", "cycle", R("y").alias("y"))


@query(f"with {SIG}, b as (select series_id, arg_min(step, abs(t - 3.02::double) * 1000000 + step) as i from sig group by series_id) select series_id, step, round(y, 6) as y from sig join b using (series_id) where i - step between 0 and 20 and (i - step) % 4 = 0")
def b2_washout_window(spark, sf):
    return timegrid.washout_window(inputs.signals(spark, sf), 3.02, 5, 4).select("series_id", "step", R("y").alias("y"))


_B3 = {"time": "0.4::double * y * sin(power(2 * pi() * t, 2))", "periodic": "0.2::double * mx * cos(2 * y / mx)", "linear": "0.1::double * mx + 0.3::double * y", "cosine": "cos(y)"}


@query(f"with {SIG}, m as (select *, max(y) over (partition by series_id, dim) as mx from sig) " + " union all ".join(f"select series_id, step, '{k}' as kind, round({x}, 5) + 0 as b, round(y + {x}, 5) + 0 as y_true from m" for k, x in _B3.items()))
def b3_add_bias(spark, sf):
    s = inputs.signals(spark, sf).withColumnRenamed("y", "y_true")
    out = None
    for kind in _B3:
        part = truth.add_bias(s, kind).select("series_id", "step", F.lit(kind).alias("kind"), R("b", 5).alias("b"), R("y_true", 5).alias("y_true"))
        out = part if out is None else out.unionByName(part)
    return out


_N = noise.normal_sql("series_id * 64 + dim", "step", 3)


@query(f"with {SIG}, m as (select *, max(abs(y)) over (partition by series_id, dim) as mx from sig) select series_id, step, round(y + 0.1::double * mx * {_N}, 5) as y_add, round(y + 0.1::double * y * {_N}, 5) as y_mul from m")
def b4_add_noise(spark, sf):
    s = inputs.signals(spark, sf).withColumnRenamed("y", "y_true")
    both = truth.add_noise(s, 0.1, True, 3).withColumnRenamed("y_raw", "y_add")
    return truth.add_noise(both, 0.1, False, 3).select("series_id", "step", R("y_add", 5).alias("y_add"), R("y_raw", 5).alias("y_mul"))


@query()
def b5_coloured_noise(spark, sf):
    s = inputs.signals(spark, sf).withColumnRenamed("y", "y_true")
    return truth.add_coloured_noise(s, 0.1, "pink", seed=3).select("series_id", "step", R("y_raw", 5).alias("y_raw"))


_FN = noise.normal_sql("comp * 1000003 + ix * 1009 + iy", "step", 1)


@query(f"with {FLD} select step, point_id, round(value + 0.1::double * (select max(abs(value)) from fld) * {_FN}, 5) + 0 as value from fld")
def b6_field_noise(spark, sf):
    return truth.add_field_noise(inputs.field(spark, sf), 0.1, seed=1).select("step", "point_id", R("value", 5).alias("value"))


@query()
def b6_field_noise_smooth(spark, sf):
    return truth.add_field_noise(inputs.field(spark, sf), 0.1, smoothing=1.0, seed=1).select("step", "point_id", R("value", 5).alias("value"))


@query()
def b6_field_noise_coloured(spark, sf):
    return truth.add_field_noise(inputs.field(spark, sf), 0.1, "pink", seed=1).select("step", "point_id", R("value", 5).alias("value"))


@query(f"with {SIG} select series_id, step, round(y + 0.05::double * stddev_pop(y) over (partition by series_id, dim) * {noise.normal_sql('series_id * 64 + dim', 'step', 5)}, 5) as y from sig")
def b7_std_noise(spark, sf):
    return truth.add_std_noise(inputs.signals(spark, sf), 0.05, seed=5).select("series_id", "step", R("y", 5).alias("y"))


@query(f"with {SIG}, m as (select *, 0.1::double * max(y) over (partition by series_id, dim) + 0.3::double * y + y as yt from sig), n as (select *, max(abs(yt)) over (partition by series_id, dim) as mx from m) select series_id, (step - 5) // 3 as cycle, step, round(yt + 0.02::double * mx * {noise.normal_sql('series_id * 64 + dim', 'step', 7)}, 5) as d from n where step between 5 and 50 and (step - 5) % 3 = 0")
def b8_create_truth(spark, sf):
    s = inputs.signals(spark, sf).withColumnRenamed("y", "y_true")
    _, obs = truth.create_truth(s, 5.0, 50.0, 1.0, 3, "linear", 0.02, seed=7)
    return obs.select("series_id", "cycle", "step", R("d", 5).alias("d"))


@query(f"with {FLD} select point_id, step // 128 as chunk, count(*) as n, round(sum(value * (step % 128 + 1)), 6) as checksum from fld where step % 3 <> 1 group by point_id, step // 128")
def a4_field_chunks(spark, sf):
    """Every third snapshot missing: blocks of 128 steps, back to rows, and a sum that a shift would change."""
    chunks = tables.field_to_chunks(inputs.field(spark, sf).where("step % 3 <> 1").select("step", "point_id", "value"), ["point_id"], chunk=128)
    rows = tables.chunks_to_field(chunks, ["point_id"], chunk=128)
    weighed = F.sum(F.col("value") * (F.col("step") % 128 + 1))
    return rows.groupBy("point_id", F.floor(F.col("step") / 128).alias("chunk")).agg(F.count("value").alias("n"), R(weighed).alias("checksum"))


@query(f"with {FLD} select step, point_id, step // 4 as cycle, round(value, 6) + 0 as value from fld where point_id in (3, 17, 40) and step between 0 and 1000000000 and step % 4 = 0")
def b9_sensor_observations(spark, sf):
    sensors = spark.createDataFrame([(3,), (17,), (40,)], "point_id long")
    return truth.sensor_observations(inputs.field(spark, sf), sensors, 0.0, 1e9, 1.0, 4).select("step", "point_id", "cycle", R("value").alias("value"))


# --- maps, filters, scalar functions


@query("select c_custkey as series_id, n_nationkey as sensor, round(c_acctbal / 1000 * cos(0.25::double * n_nationkey) + c_nationkey_ * sin(0.25::double * n_nationkey), 6) + 0 as value from (select c_custkey, c_acctbal, c_nationkey as c_nationkey_ from customer), nation")
def g1_virtual_sensors(spark, sf):
    modes = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("series_id"), (F.col("c_acctbal") / 1000).alias("eta1"), F.col("c_nationkey").cast("double").alias("eta2"))
    mics = inputs.table(spark, sf, "nation").select(F.col("n_nationkey").alias("sensor"), (0.25 * F.col("n_nationkey")).alias("pos"))  # 25 sensors on a ring, however many series
    return maps.virtual_sensors(modes, mics).select("series_id", "sensor", R("value").alias("value"))


@query(f"with {ENS} select series_id, x as sensor, round(-sum(a / 10 * sin((member + 1) * 0.7::double * x * 0.1::double)), 5) + 0 as value from ens, (values (1), (2), (3)) v(x) group by series_id, x")
def g1_duct_sensors(spark, sf):
    mu = inputs.ensemble(spark, sf).select("series_id", F.lit(0).alias("step"), (F.col("a") / 10).alias("mu"), ((F.col("member") + 1) * 0.7).alias("omega"))
    mics = spark.range(1, 4).select(F.col("id").cast("int").alias("sensor"), (F.col("id") * 0.1).alias("pos"))
    return maps.virtual_sensors(mu, mics, "duct").select("series_id", "sensor", R("value", 5).alias("value"))


@query("select p_partkey, round(-17.7::double * p_size + 1.5::double, 6) as nu, round(0.25::double * p_size - 3::double, 6) as c2 from part")
def g2_params_from_condition(spark, sf):
    cols = maps.params_from_condition(F.col("p_size").cast("double"), {"nu": (-17.7, 1.5), "c2": (0.25, -3.0)})
    return inputs.table(spark, sf, "part").select("p_partkey", *cols).select("p_partkey", R("nu").alias("nu"), R("c2").alias("c2"))


@query(f"with {SIG} select series_id, step, round(y, 6) as y from sig where step % 4 = 0")
def g3_downsample(spark, sf):
    return timegrid.downsample(inputs.signals(spark, sf), 4).select("series_id", "step", R("y").alias("y"))


@query(f"with {FLD} select step, (ix - 2) // 2 as jx, (iy - 1) // 3 as jy, round(value, 6) + 0 as value from fld where ix between 2 and 6 and iy between 1 and 7 and (ix - 2) % 2 = 0 and (iy - 1) % 3 = 0")
def g4_cut_domain(spark, sf):
    return fields.cut_domain(inputs.field(spark, sf), (1.0, 3.0, 0.5, 3.5), (0.0, 0.0), (0.5, 0.5), (2, 3)).select("step", "jx", "jy", R("value").alias("value"))


@query("select s_suppkey % 64 + c * 64 as point_id, c as comp, count(*) as n from supplier, (select unnest(range(3))::int as c) group by all")
def g5_sensors_per_component(spark, sf):
    points = inputs.table(spark, sf, "supplier").select((F.col("s_suppkey") % 64).alias("point_id"))
    return maps.repeat_per_component(points, 3, 64).groupBy("point_id", "comp").agg(F.count("*").alias("n"))


@query(f"with {FLD} select step, point_id, comp::bigint * 64 + ix * 8 + iy as flat, point_id // 64 as comp2, (point_id % 64) // 8 as ix2, point_id % 8 as iy2 from fld")
def g5_flat_indices(spark, sf):
    c, i, j = maps.unflatten_index(F.col("point_id"), 8, 8)
    return inputs.field(spark, sf).select("step", "point_id", maps.flatten_index(F.col("comp").cast("long"), F.col("ix"), F.col("iy"), 8, 8).alias("flat"), c.alias("comp2"), i.alias("ix2"), j.alias("iy2"))


@query(f"with {ENS}, {LNG} select series_id, row_id, member, round(m + 1.1::double * (value - m) + 1.23456789e-7::double, 6) + 0 as value from (select *, avg(value) over (partition by series_id, row_id) as m from lng)")
def g6_inflate(spark, sf):
    return ensemble.inflate(inputs.long_ensemble(spark, sf), 1.1).select("series_id", "row_id", "member", R(F.col("value") + OFF_TIES, 6).alias("value"))


@query(f"with {ENS}, {LNG}, g as (select series_id, max(case when kind = 'param' and m <> 0 and s / m > 0.6::double then 1 else 0 end) as sk from (select series_id, row_id, any_value(kind) as kind, avg(value) as m, stddev_pop(value * 1.0) as s from lng group by series_id, row_id) group by series_id) select series_id, count(*) as n from g group by series_id")
def g6_guarded_groups(spark, sf):
    return ensemble.inflate(inputs.long_ensemble(spark, sf), 1.1, "kind = 'param'").groupBy("series_id").agg(F.countDistinct("step").alias("n"))


@query(f"with {ENS}, {LNG} select series_id, max(case when value < lo or value > hi then 1 else 0 end) = 1 as non_physical, sum(case when value < lo or value > hi then 1 else 0 end)::bigint as n_outside from lng join (values ('x1', 0.02::double, null::double), ('x2', 5::double, 45::double)) v(name, lo, hi) using (name) group by series_id")
def g7_out_of_bounds(spark, sf):
    limits = spark.createDataFrame([("x1", 0.02, None), ("x2", 5.0, 45.0)], "name string, lo double, hi double")
    return ensemble.out_of_bounds(inputs.long_ensemble(spark, sf), limits).select("series_id", "non_physical", "n_outside")


@query(f"with {CHN} select series_id, dim, step, round(least(case when abs(y - e) > 20 then 0 else y - e end, 2), 6) + 0 as b from chn")
def g8_limit_outliers(spark, sf):
    return inputs.channels(spark, sf).select("series_id", "dim", "step", R(maps.limit_outliers(F.col("y") - F.col("e"), F.lit(20.0), 2.0)).alias("b"))


@query(f"with {ENS}, {LNG}, r as (select name, avg(value) as reference from lng group by name) select series_id, name, member, round(value / reference, 6) as value from lng join r using (name)")
def g9_scale_params(spark, sf):
    ens = inputs.long_ensemble(spark, sf)
    reference = ens.groupBy("name").agg(F.avg("value").alias("reference"))
    return maps.scale_params(ens, reference).select("series_id", "name", "member", R("value").alias("value"))


@query("select o_orderkey, (o_orderkey % 97)::int as L, ((o_custkey % 40) / 2)::double as k, o_orderstatus = 'F' as augmented from orders")
def g10_run_key(spark, sf):
    path = F.concat(F.lit("results/L"), (F.col("o_orderkey") % 97).cast("string"), F.when(F.col("o_orderstatus") == "F", "_Augment").otherwise(""), F.lit("/run_k"), ((F.col("o_custkey") % 40) / 2).cast("string"))
    return inputs.table(spark, sf, "orders").select("o_orderkey", *maps.run_key(path))


@query(f"with {ENS}, {LNG} select series_id, member, round(value, 6) as value from lng where kind = 'obs'")
def g11_observables(spark, sf):
    return inputs.long_ensemble(spark, sf).where("kind = 'obs'").select("series_id", "member", R("value").alias("value"))


# --- joins and alignment


@query(f"with {SIG}, q as (select distinct series_id, ((step * 7) % 90)::double * 0.1::double + 0.033::double as t from sig), x as (select q.series_id, q.t, (select max(s.step) from sig s where s.series_id = q.series_id and s.t <= q.t) as i0, (select min(s.step) from sig s where s.series_id = q.series_id and s.t >= q.t) as i1 from q) select x.series_id, round(x.t, 6) as t, round(case when a.y is null then b.y when b.y is null then a.y when a.t = b.t then a.y else a.y + (b.y - a.y) * (x.t - a.t) / (b.t - a.t) end, 5) as y from x left join sig a on a.series_id = x.series_id and a.step = i0 left join sig b on b.series_id = x.series_id and b.step = i1")
def c1_interpolate_to(spark, sf):
    s = inputs.signals(spark, sf)
    times = s.select("series_id", ((F.col("step") * 7 % 90) * DT + F.lit(0.033)).alias("t")).distinct()
    return align.interpolate_to(times, s, ["series_id"]).select("series_id", R("t").alias("t"), R("y", 5).alias("y"))


@query(f"with {SIG}, q as (select distinct series_id, ((step * 11) % 100)::double * 0.1::double + 0.04::double as tx from sig) select q.series_id, round(tx, 6) as tx, arg_min(s.step, abs(s.t - tx) * 1000000000 + s.step) as step from q join sig s using (series_id) group by q.series_id, tx")
def c2_nearest_samples(spark, sf):
    s = inputs.signals(spark, sf)
    times = s.select("series_id", ((F.col("step") * 11 % 100) * DT + F.lit(0.04)).alias("tx")).distinct()
    return timegrid.nearest_samples(s, times).select("series_id", R("tx").alias("tx"), "step")


@query(f"with {SIG} select a.series_id, a.step, round(a.y - b.y, 6) + 0 as gap from sig a join sig b on a.series_id = b.series_id and a.step = b.step where a.step % 5 = 0")
def c3_pair_forecast_with_obs(spark, sf):
    s = inputs.signals(spark, sf).select("series_id", "step", "y")
    obs = s.where("step % 5 = 0").withColumnRenamed("y", "d")
    return align.pair_forecast_with_obs(s, obs, ["series_id", "step"]).select("series_id", "step", R(F.col("d") - F.col("y")).alias("gap"))


@query(f"with {SIG}, o as (select series_id, min(step) - 3 as lo, max(step) + 3 as hi from sig where step between 10 and 40 and step % 6 = 0 group by series_id) select series_id, step from sig join o using (series_id) where step >= lo and step < hi")
def c4_assimilation_interval(spark, sf):
    s = inputs.signals(spark, sf)
    return timegrid.assimilation_interval(s, s.where("step between 10 and 40 and step % 6 = 0"), 3).select("series_id", "step")


@query(f"with {CHN} select series_id, dim, step, dim in ('click', 'view') as observed from chn")
def c5_split_observed(spark, sf):
    seen = spark.createDataFrame([("click",), ("view",)], "dim string")
    a, b = align.split_observed(inputs.channels(spark, sf).select("series_id", "dim", "step"), seen)
    return a.withColumn("observed", F.lit(True)).unionByName(b.withColumn("observed", F.lit(False)))


@query(f"with {SIG}, b as (select series_id, t, avg(value) as b from (select series_id, t, 0.1::double * y as value from sig where step % 3 = 0 union all select series_id, t, 0.3::double * y from sig where step % 3 = 0) group by series_id, t), x as (select s.*, (select max(t) from b where b.series_id = s.series_id and b.t <= s.t) as t0, (select min(t) from b where b.series_id = s.series_id and b.t >= s.t) as t1 from sig s) select x.series_id, x.step, round(x.y + case when q.b is null then p.b when p.t = q.t then p.b else p.b + (q.b - p.b) * (x.t - p.t) / (q.t - p.t) end, 5) as y from x left join b p on p.series_id = x.series_id and p.t = t0 left join b q on q.series_id = x.series_id and q.t = t1")
def c6_unbias(spark, sf):
    s = inputs.signals(spark, sf)
    thin = s.where("step % 3 = 0")
    bias = thin.select("series_id", "t", (0.1 * F.col("y")).alias("value")).unionByName(thin.select("series_id", "t", (0.3 * F.col("y")).alias("value")))
    return align.unbias(s, bias, ["series_id"]).select("series_id", "step", R("y", 5).alias("y"))


@query("select r_regionkey, n_nationkey, r_name || '/' || n_name as cell from region, nation")
def c7_sweep(spark, sf):
    return align.sweep(inputs.table(spark, sf, "region").select("r_regionkey", "r_name"), inputs.table(spark, sf, "nation").select("n_nationkey", "n_name")).select("r_regionkey", "n_nationkey", F.concat("r_name", F.lit("/"), "n_name").alias("cell"))


@query(f"with {SIG}, o as (select series_id, step, y as d from sig), g as (select o.series_id, l.lag, sum(o.d * o.d) as dd, sum(o.d * m.y) as dy, sum(m.y * m.y) as yy, max(abs(m.y)) as mx from o, (select unnest(range(8))::int as lag) l, sig m where m.series_id = o.series_id and m.step = o.step + l.lag group by o.series_id, l.lag), e as (select series_id, lag, sqrt(greatest(dd - 2 * dy / mx + yy / (mx * mx), 0) / dd) as r from g where mx > 0 and dd > 0) select series_id, arg_min(lag, r) as best, arg_max(lag, r) as worst, floor((arg_min(lag, r) + arg_max(lag, r)) / 2)::int as mid, round(min(r), 6) as r_best from e group by series_id")
def c8_lag_search(spark, sf):
    s = inputs.signals(spark, sf)
    found = align.lag_search(s.select("series_id", "step", F.col("y").alias("d")), s.withColumn("member", F.lit(0)), 8)
    return found.select("series_id", "best", "worst", "mid", R("r_best").alias("r_best"))


@query(f"with {CHN} select series_id, dim, step, round(1.1::double * y - e, 6) + 0 as innovation, round(y - e, 6) + 0 as model_bias, round(1.1::double * y - y, 6) + 0 as sensor_bias from chn")
def c9_innovations(spark, sf):
    c = inputs.channels(spark, sf)
    keys = ["series_id", "dim", "step"]
    out = align.innovations(c.select(*keys, F.col("y").alias("y_true"), (1.1 * F.col("y")).alias("y_raw")), c.select(*keys, F.col("e").alias("y")), keys)
    return out.select(*keys, *(R(n).alias(n) for n in ("innovation", "model_bias", "sensor_bias")))


@query(f"with {SIG} select series_id, step, f as factor, round(y * f, 6) + 0 as y from sig, (values (1.0::double), (0.1::double), (-0.01::double)) v(f)")
def c10_augment(spark, sf):
    return align.augment(inputs.signals(spark, sf)).select("series_id", "step", "factor", R("y").alias("y"))


@query(f"with {SIG} select 'a' as dataset, series_id, step, round(y, 6) as y from sig union all select 'b', series_id, step, round(2 * y, 6) from sig where step % 2 = 0")
def x1_union_datasets(spark, sf):
    s = inputs.signals(spark, sf).select("series_id", "step", "y")
    return align.union_datasets(a=s, b=s.where("step % 2 = 0").withColumn("y", 2 * F.col("y"))).select("dataset", "series_id", "step", R("y").alias("y"))


# --- windows, sorts, top-k


_PEAKS = "x as (select *, lag(y) over w as l, lead(y) over w as r from (select series_id, step, t, round(y, 0) as y from sig) window w as (partition by series_id order by step)), g as (select *, sum(case when l is null or l <> y then 1 else 0 end) over (partition by series_id order by step) as run from x), k as (select series_id, run, min(step) as a, max(step) as b, any_value(y) as h from g group by series_id, run), p as (select *, lag(h) over (partition by series_id order by run) as hl, lead(h) over (partition by series_id order by run) as hr from k)"


@query(f"with {SIG}, {_PEAKS} select series_id, (a + b) // 2 as step, h as y from p where h > hl and h > hr")
def w1_find_peaks(spark, sf):
    s = inputs.signals(spark, sf).withColumn("y", F.round("y", 0))
    return align.find_peaks(s, ["series_id"]).select("series_id", "step", "y")


def _rounds(n: int, reach: int) -> str:
    """Rounds over peaks p0 (series_id, step, y): 0 open, 1 stays, 2 goes."""
    out = "s0 as materialized (select *, 0 as s from p0)"
    for k in range(n):
        around = f"over (partition by series_id order by step range between {reach} preceding and {reach} following)"
        out += f", t{k} as materialized (select series_id, step, y, case when s = 0 and max(case when s = 0 then struct_pack(h := y, s := -step) end) {around} = struct_pack(h := y, s := -step) then 1 else s end as s from s{k})"
        out += f", s{k + 1} as materialized (select series_id, step, y, case when s = 0 and max(case when s = 1 then 1 else 0 end) {around} = 1 then 2 else s end as s from t{k})"
    return out


_RAW_PEAKS = _PEAKS.replace("round(y, 0)", "y")


@query(f"with {SIG}, {_RAW_PEAKS}, p0 as (select series_id, (a + b) // 2 as step, h as y from p where h > hl and h > hr), {_rounds(12, 4)} select series_id, step, round(y, 6) as y from s12 where s < 2")
def w1_separate_peaks(spark, sf):
    peaks = align.find_peaks(inputs.signals(spark, sf), ["series_id"]).select("series_id", "step", "t", "y")
    return align.separate_peaks(peaks, ["series_id"], 5).select("series_id", "step", R("y").alias("y"))


@query(f"with {SIG}, {_PEAKS}, e as (select p.series_id, s.t, p.h as y from p join sig s on s.series_id = p.series_id and s.step = (a + b) // 2 where h > hl and h > hr), z as (select s.series_id, s.step, s.t, (select max(t) from e where e.series_id = s.series_id and e.t <= s.t) as t0, (select min(t) from e where e.series_id = s.series_id and e.t >= s.t) as t1 from sig s) select z.series_id, z.step, round(case when u.y is null or v.y is null then 0 when u.t = v.t then u.y else u.y + (v.y - u.y) * (z.t - u.t) / (v.t - u.t) end, 5) as y from z left join e u on u.series_id = z.series_id and u.t = t0 left join e v on v.series_id = z.series_id and v.t = t1")
def w2_envelope(spark, sf):
    s = inputs.signals(spark, sf).withColumn("y", F.round("y", 0))
    return align.envelope(s, ["series_id"]).join(s.select("series_id", "t", "step"), ["series_id", "t"]).select("series_id", "step", R("y", 5).alias("y"))


@query(f"with {SIG} select series_id, step, round(y, 6) as y from sig qualify row_number() over (partition by series_id order by step desc) <= 5")
def w3_last_n(spark, sf):
    return timegrid.last_n(inputs.signals(spark, sf), 5).select("series_id", "step", R("y").alias("y"))


@query(f"with {SIG}, x as (select series_id as mode, step, y as x from sig where step % 4 = 0), g as (select a.mode, a.step as i, b.step as j, abs(a.x - b.x) as gap from x a join x b using (mode)), l as (select mode, quantile_cont(gap, 0.2) as q from g group by mode) select mode, count(*) as n, sum(i * 1000 + j)::bigint as checksum from g join l using (mode) where gap < q group by mode")
def w4_recurrence_pairs(spark, sf):
    coeffs = inputs.signals(spark, sf).select(F.col("series_id").alias("mode"), "step", F.col("y").alias("x"))
    return fields.recurrence_pairs(coeffs, 0.2, 4).groupBy("mode").agg(F.count("*").alias("n"), F.sum(F.col("i") * 1000 + F.col("j")).alias("checksum"))


_CELL = "c as (select L, k, sqrt(sum((y - biased) * (y - biased)) / sum(y * y)) as b, sqrt(sum((y - unbiased) * (y - unbiased)) / sum(y * y)) as u from run group by L, k)"


@query(f"with {RUN}, {_CELL} select round((b + u) / 2, 8) as score, L, k from c order by (b + u) / 2, L, k limit 1")
def s1_best_run(spark, sf):
    cells = metrics.rms_per_step(inputs.runs(spark, sf), ["L", "k"], "y", ("biased", "unbiased"))
    return metrics.best_run(cells, ["L", "k"], "rms_biased", "rms_unbiased").select(R("score", 8).alias("score"), "L", "k")


@query()
def s2_rank_sensors(spark, sf):
    modes, _, _ = fields.pod_by_points(inputs.field(spark, sf), 4)
    return spark.createDataFrame(list(enumerate(fields.rank_sensors(modes, 4))), "rank long, point_id long")


@query()
def s3_random_sensors(spark, sf):
    return fields.random_sensors(inputs.field(spark, sf), 5, 1)


@query()
def s4_sample_windows(spark, sf):
    sizes = inputs.signals(spark, sf).groupBy("series_id").agg(F.count("*").alias("n_steps"))
    return reservoir.sample_windows(sizes, 50, 20, 1)


@query(f"with {CHN}, l as (select *, row_number() over (partition by series_id, dim order by step desc) as rn from chn), m as (select series_id, dim, max(abs(y)) as top from l where rn <= 1000 group by series_id, dim) select series_id, dim, round(top, 6) as top, row_number() over (partition by series_id order by top desc, dim)::int as rank from m")
def s5_rank_channels(spark, sf):
    return metrics.rank_channels(inputs.channels(spark, sf)).select("series_id", "dim", R("top").alias("top"), "rank")


# --- aggregations


@query(f"with {ENS}, {LNG} select series_id, row_id, count(*) as m, round(avg(value), 9) as mean, round(stddev_pop(value), 8) as std, round(avg(value) + 2 * stddev_pop(value), 8) as hi2 from lng group by series_id, row_id")
def d1_ensemble_moments(spark, sf):
    return metrics.ensemble_moments(inputs.long_ensemble(spark, sf), ["series_id", "row_id"]).select("series_id", "row_id", "m", R("mean", 9).alias("mean"), R("std", 8).alias("std"), R("hi2", 8).alias("hi2"))


@query(f"with {ENS} select series_id, round(avg(a), 11) as mean, round(stddev_pop(a), 8) as std from ens group by series_id")
def d1_packed_moments(spark, sf):
    packed = filters.pack(inputs.ensemble(spark, sf).select("series_id", "member", F.col("a").alias("value")), ["series_id"])
    return metrics.ensemble_moments_packed(packed).select("series_id", R("mean", 11).alias("mean"), R("std", 8).alias("std"))


@query(f"with {ENS} select series_id, 0 as row_a, 2 as row_b, round(covar_samp(a, y) + 1.23456789e-7::double, 6) as cov, round(corr(a, y) + 1.23456789e-7::double, 6) as corr from ens group by series_id having count(*) > 2 union all select series_id, 1, 2, round(covar_samp(p, y) + 1.23456789e-7::double, 6) + 0, round(corr(p, y) + 1.23456789e-7::double, 6) + 0 from ens group by series_id having count(*) > 2")
def d2_ensemble_covariance(spark, sf):
    ens = inputs.long_ensemble(spark, sf)
    many = ens.groupBy("series_id").agg(F.max("member").alias("top")).where("top > 1").select("series_id")
    out = metrics.ensemble_covariance(ens.join(many, "series_id", "left_semi"), ["series_id"], F.col("kind") != "obs", F.col("kind") == "obs")
    return out.select("series_id", "row_a", "row_b", R(F.col("cov") + OFF_TIES, 6).alias("cov"), R(F.col("corr") + OFF_TIES, 6).alias("corr"))


_CR = "select {k}, sum(ye) / sqrt(sum(yy) * sum(ee)) as C, sqrt(sum(dd) / sum(en)) as R from (select {k}, dim, sum(y * {e}) - sum(y) * sum({e}) / count(*) as ye, sum(y * y) - sum(y) * sum(y) / count(*) as yy, sum({e} * {e}) - sum({e}) * sum({e}) / count(*) as ee, sum((y - {e}) * (y - {e})) as dd, sum(y * y) as en from {t} group by {k}, dim) group by {k}"


@query(f"with {CHN}, m as ({_CR.format(k='series_id', e='e', t='chn')}) select series_id, round(C, 6) as C, round(R, 6) as R from m")
def d3_cr_metrics(spark, sf):
    return metrics.cr_metrics(inputs.channels(spark, sf), ["series_id"]).select("series_id", R("C").alias("C"), R("R").alias("R"))


@query(f"with {CHN} select series_id, step, case when sum(y * y) > 0 then round(sqrt(sum((y - e) * (y - e)) / sum(y * y)), 6) end as rms from chn group by series_id, step")
def d4_rms_per_step(spark, sf):
    return metrics.rms_per_step(inputs.channels(spark, sf), ["series_id", "step"]).select("series_id", "step", R("rms_e").alias("rms"))


_PH = "ph as (select *, case when step > 40 then 'post' else 'during' end as phase from run where step > 30)"
_D5 = " union all ".join(f"select L, k, phase, '{e}' as kind, round(C, 6) as C, round(R, 6) as R from ({_CR.format(k='L, k, phase', e=e, t='ph')})" for e in ("biased", "unbiased"))


@query(f"with {RUN}, {_PH} {_D5}")
def d5_sweep_metrics(spark, sf):
    return metrics.sweep_metrics(inputs.runs(spark, sf), ["L", "k"], F.lit(50), 10).select("L", "k", "phase", "kind", R("C").alias("C"), R("R").alias("R"))


@query(f"with {RUN}, b as (select L, k, dim, (step - 1) // 10 as block, avg(abs(y - biased)) as err, max(abs(y)) as m from run group by all) select L, k, dim, block, round(err / max(m) over (partition by L, k, dim), 6) as err from b")
def d6_interval_error(spark, sf):
    r = inputs.runs(spark, sf).withColumn("e", F.col("biased"))
    return metrics.interval_error(r, ["L", "k"], 10, 1).select("L", "k", "dim", "block", R("err").alias("err"))


@query(f"with {RUN}, m as (select *, biased as e from run), x as ({_CR.format(k='L, k', e='e', t='m')}) select L, round(avg(C), 6) as C_mean, round(stddev_pop(C), 6) as C_std, round(avg(R), 6) as R_mean, round(stddev_pop(R), 6) as R_std from x group by L")
def d7_member_metrics(spark, sf):
    r = inputs.runs(spark, sf).withColumn("e", F.col("biased")).withColumn("member", F.col("k"))
    return metrics.member_metrics(r, ["L"]).select("L", *(R(c).alias(c) for c in ("C_mean", "C_std", "R_mean", "R_std")))


@query(f"with {CHN}, b as (select dim, least(floor((y - 0) / 2.5), 39)::bigint as bin from chn where y between 0 and 100) select dim, bin, count(*) as n, round(count(*) / (sum(count(*)) over (partition by dim) * 2.5), 8) as density from b group by dim, bin")
def d8_histogram(spark, sf):
    return metrics.histogram(inputs.channels(spark, sf), ["dim"], "y", 40, 0.0, 100.0).select("dim", "bin", "n", R("density", 8).alias("density"))


@query(f"with {ENS}, {LNG}, b as (select series_id, row_id, least(floor(value / 5), 19)::bigint as bin from lng where value between 0 and 100) select series_id, row_id, bin, count(*) as n from b group by all")
def d9_ensemble_histogram(spark, sf):
    return metrics.histogram(inputs.long_ensemble(spark, sf), ["series_id", "row_id"], "value", 20, 0.0, 100.0).select("series_id", "row_id", "bin", "n")


@query(f"with {RUN}, p as (select L, step, dim as name, y as value from run), b as (select L, min(step) as a, max(step) as z from run group by L), s as (select L, name, avg(case when step = a then value end) as m0, stddev_pop(case when step = a then value end) as s0, avg(case when step = z then value end) as m1, stddev_pop(case when step = z then value end) as s1 from p join b using (L) group by L, name) select L, name, round(m0, 6) as mean_start, round(s0, 6) as std_start, round(m1, 6) as mean_now, round(s1, 6) as std_now, round(m1 / m0, 6) as relative_mean from s")
def d10_parameter_summary(spark, sf):
    p = inputs.runs(spark, sf).select("L", "step", F.col("dim").alias("name"), F.col("y").alias("value"))
    return metrics.parameter_summary(p, ["L"]).select("L", "name", *(R(c).alias(c) for c in ("mean_start", "std_start", "mean_now", "std_now", "relative_mean")))


@query(f"with {FLD} select a.step, round(avg((a.value - b.value) * (a.value - b.value)), 8) as mse from fld a join fld b on b.point_id = a.point_id and b.step = a.step + 1 group by a.step")
def d11_field_mse(spark, sf):
    f = inputs.field(spark, sf).select("step", "point_id", "value")
    return fields.field_mse(f, f.withColumn("step", F.col("step") - 1)).select("step", R("mse", 8).alias("mse"))


@query(f"with {FLD} select a.step, a.point_id, round(abs(a.value - b.value), 6) as error from fld a join fld b on b.point_id = a.point_id and b.step = a.step + 1")
def d11_error_field(spark, sf):
    f = inputs.field(spark, sf).select("step", "point_id", "value")
    return fields.error_field(f, f.withColumn("step", F.col("step") - 1)).select("step", "point_id", R("error").alias("error"))


@query(f"with {FLD} select round(sum(v) / 2, 8) as tke from (select var_pop(value) as v from fld group by point_id)")
def d12_kinetic_energy(spark, sf):
    return fields.kinetic_energy(tables.field_to_rows(inputs.field(spark, sf), ["point_id"])).select(R("tke", 8).alias("tke"))


@query("with s as (select n_nationkey as mode, 30.0::double - n_nationkey as sigma from nation) select mode, round(sigma * sigma / 200, 8) as energy, round(sigma * sigma / 900, 8) as spectrum, round(sum(sigma * sigma) over (order by mode) / sum(sigma * sigma) over (), 8) as cumulative from s")
def d12_modal_energy(spark, sf):
    s = inputs.table(spark, sf, "nation").select(F.col("n_nationkey").alias("mode"), (F.lit(30.0) - F.col("n_nationkey")).alias("sigma"))
    return fields.modal_energy(s, 100).select("mode", *(R(c, 8).alias(c) for c in ("energy", "spectrum", "cumulative")))


@query(f"with {FLD} select point_id, round(avg(value), 8) + 0 as q_mean, round(sum(power(value - m, 2)), 6) as ss from (select *, avg(value) over (partition by point_id) as m from fld) group by point_id")
def d13_remove_mean(spark, sf):
    rows = fields.remove_mean(tables.field_to_rows(inputs.field(spark, sf), ["point_id"]))
    return rows.select("point_id", R("q_mean", 8).alias("q_mean"), R(F.aggregate("snaps", F.lit(0.0), lambda a, x: a + x * x)).alias("ss"))


@query(f"with {CHN}, s as (select dim, max(y) - min(y) as a, stddev_pop(y) as b, max(abs(y)) as c, avg(y) as d from chn group by series_id, dim) select dim, round(avg(a), 6) as range, round(avg(b), 6) as std, round(avg(c), 6) as max, round(avg(d), 6) as mean from s group by dim")
def d14_norm_factor(spark, sf):
    c = inputs.channels(spark, sf)
    out = None
    for m in ("range", "std", "max", "mean"):
        part = metrics.norm_factor(c, m).select("dim", R("norm").alias(m))
        out = part if out is None else out.join(part, "dim")
    return out


@query(f"with {CHN} select series_id, dim, round(0.01::double * power(max(abs(y)), 2), 6) as cdd, round(0.01::double * 0.01::double * power(max(abs(y)), 2), 8) as cdd2 from chn group by series_id, dim")
def d15_obs_error_cov(spark, sf):
    c = inputs.channels(spark, sf).withColumn("d", F.col("y"))
    b = metrics.obs_error_cov(c, 0.01, "squared").withColumnRenamed("cdd", "cdd2")
    return metrics.obs_error_cov(c, 0.01).join(b, ["series_id", "dim"]).select("series_id", "dim", R("cdd").alias("cdd"), R("cdd2", 8).alias("cdd2"))


@query(f"with {SIG}, n as (select series_id, count(*) as n from sig group by series_id) select s.series_id, b.bin, round(b.bin * 5.0::double / (n // 2 - 1), 6) as frequency, round(2.0::double / n * sqrt(power(sum(y * cos(2 * pi() * b.bin * step / n)), 2) + power(sum(y * sin(2 * pi() * b.bin * step / n)), 2)), 8) as amplitude from sig s join n using (series_id), lateral (select unnest(range(n.n // 2))::bigint as bin) b group by s.series_id, b.bin, n")
def d16_amplitude_spectrum(spark, sf):
    out = truth.amplitude_spectrum(inputs.signals(spark, sf), DT)
    return out.select("series_id", "bin", R("frequency").alias("frequency"), R("amplitude", 8).alias("amplitude"))


@query("with x as (select l_partkey as series_id, l_linenumber as member, max(l_quantity) - min(l_quantity) as span from lineitem where l_quantity > 30 group by all), g as (select series_id, max(step) as top from (select l_partkey as series_id, l_quantity::bigint as step from lineitem) group by series_id), y as (select l_partkey as series_id, l_linenumber as member, max(l_tax) - min(l_tax) as span from lineitem join g on g.series_id = l_partkey where l_quantity > top - 20 group by all) select series_id, member, max(span) < 0.05 as fixed from y group by all")
def d17_fixed_points(spark, sf):
    li = inputs.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("series_id"), F.col("l_linenumber").alias("member"), F.col("l_quantity").cast("long").alias("step"), F.lit(0).alias("row_id"), F.col("l_tax").alias("value"))
    return ensemble.fixed_points(li, 20, 0.05)


@query()
def d17_refill(spark, sf):
    kept = inputs.ensemble(spark, sf).select("series_id", "member", (F.col("member") % 4 != 0).alias("keep"))
    return ensemble.refill(inputs.long_ensemble(spark, sf), kept, 12).groupBy("series_id").agg(F.countDistinct("member").alias("m"), R(F.sum("value"), 3).alias("total"))


@query(f"with {CHN}, w as (select dim, series_id, step // 5 as w, log10(avg((y - e) * (y - e)) / avg(y * y)) as e from chn where abs(y - e) > 0.001 group by all) select dim, round(min(e), 6) as e_min, round(max(e), 6) as e_max, round(avg(e), 6) as e_mean from w group by dim")
def d18_forecast_test_errors(spark, sf):
    c = inputs.channels(spark, sf).where("abs(y - e) > 0.001")
    scored = c.select("dim", "series_id", F.floor(F.col("step") / 5).alias("window"), ((F.col("y") - F.col("e")) * (F.col("y") - F.col("e"))).alias("error2"), (F.col("y") * F.col("y")).alias("norm2"))
    return metrics.forecast_test_errors(scored, ["dim"]).select("dim", *(R(c).alias(c) for c in ("e_min", "e_max", "e_mean")))


_GB = "g as (select i::double * 2.5::double as x, exp(-0.5::double * power((i::double * 2.5::double - 40) / 30, 2)) as prior from (select unnest(range(41)) as i)), o as (select series_id, step // 10 as cycle, y as d from sig where step % 10 = 0), m as (select o.series_id, o.cycle, g.x, g.prior, sum(-0.5::double * power((g.x - o.d) / 20, 2)) over (partition by o.series_id, g.x order by o.cycle) as ll from o, g), w as (select *, prior * exp(ll - max(ll) over (partition by series_id, cycle)) as w from m)"


@query(f"with {SIG}, {_GB} select series_id, cycle, arg_max(x, w) as x_map, round(max(w) / (sum(w) * 2.5), 6) as p_map from w group by series_id, cycle")
def d19_grid_bayes(spark, sf):
    x = F.col("id") * 2.5
    grid = spark.range(41).select(x.alias("x"), F.exp(-0.5 * F.pow((x - 40) / 30, F.lit(2.0))).alias("prior"))
    obs = inputs.signals(spark, sf).where("step % 10 = 0").select("series_id", F.floor(F.col("step") / 10).alias("cycle"), F.col("y").alias("d"))
    post = truth.grid_bayes(grid, obs, lambda x, d: -0.5 * F.pow((x - d) / 20, F.lit(2.0)), 2.5)
    return truth.most_likely(post).select("series_id", "cycle", "x_map", R("p_map").alias("p_map"))


# --- assimilation


@query(f"with p as (select p_partkey as series_id, 0 as row_id, p_retailprice / 100 as mean from part) select series_id, member, round(mean + mean * 0.1::double * {noise.normal_sql('series_id * 1009 + row_id', 'member', 2)}, 5) as value from p, (select unnest(range(5))::bigint as member)")
def h1_init_ensemble(spark, sf):
    means = inputs.table(spark, sf, "part").select(F.col("p_partkey").alias("series_id"), F.lit(0).alias("row_id"), (F.col("p_retailprice") / 100).alias("mean"))
    return ensemble.init_ensemble(means, 5, 0.1, seed=2).select("series_id", F.col("member").cast("long").alias("member"), R("value", 5).alias("value"))


_OBS = "b as (select e.*, p_size::double as d, 0.02::double * p_size * p_size as r, 0.1::double * p_size as b, 0.3::double as j from ens e join part on p_partkey = series_id)"
_MOM = "k as (select *, a - avg(a) over w as da, y - avg(y) over w as dy, avg(y) over w as my, count(*) over w as m from b window w as (partition by series_id)), v as (select *, sum(da * dy) over w as c, sum(dy * dy) over w as v, (m - 1) * r as n from k window w as (partition by series_id))"


def _scalar(spark, sf, method):
    ens = inputs.ensemble(spark, sf)
    size = inputs.table(spark, sf, "part").select(F.col("p_partkey").alias("series_id"), F.col("p_size").cast("double").alias("d"))
    ens = ens.join(size, "series_id").withColumn("r", 0.02 * F.col("d") * F.col("d")).withColumn("b", 0.1 * F.col("d")).withColumn("jac", F.lit(0.3))
    return filters.scalar_analysis(ens, method, k=2.0).select("series_id", "member", R("a_a", 5).alias("a_a"))


@query(f"with {ENS}, {_OBS}, {_MOM} select series_id, member, round(a + case when n + v > 0 then c / (n + v) else 0 end * (d - y), 5) + 0 as a_a from v")
def h2_enkf_scalar(spark, sf):
    return _scalar(spark, sf, "enkf")


@query(f"with {ENS}, {_OBS}, {_MOM} select series_id, member, round(a + case when n + v > 0 then c / (n + v) * (d - my) else 0 end - case when v > 0 then c / v * (1 - sqrt(greatest(1 - v / (n + v), 0))) else 0 end * dy, 5) + 0 as a_a from v")
def h3_ensrkf_scalar(spark, sf):
    return _scalar(spark, sf, "ensrkf")


@query(f"with {ENS}, {_OBS}, {_MOM} select series_id, member, round(a + case when n + ((1 + j) * (1 + j) + 2 * j * j) * v > 0 then c / (n + ((1 + j) * (1 + j) + 2 * j * j) * v) else 0 end * ((1 + j) * (d - y - b) - 2 * j * b), 5) + 0 as a_a from v")
def h4_rba_enkf_scalar(spark, sf):
    return _scalar(spark, sf, "rba")


def _two_stage(spark, sf, method):
    ens = inputs.long_ensemble(spark, sf).withColumn("cycle", F.lit(0).cast("long"))
    many = ens.groupBy("series_id").agg(F.max("member").alias("top")).where("top > 1").select("series_id")
    rows = filters.pack(ens.join(many, "series_id", "left_semi"), ["series_id", "cycle", "row_id", "kind"])
    size = inputs.table(spark, sf, "part").select(F.col("p_partkey").alias("series_id"), F.lit(0).cast("long").alias("cycle"), F.lit(0).alias("dim"), F.col("p_size").cast("double").alias("d"), (0.02 * F.col("p_size") * F.col("p_size")).alias("cdd"), (0.1 * F.col("p_size")).alias("b"), F.array(F.lit(0.3)).alias("jac"))
    out = filters.analyse(rows, size, method, k=2.0, perturb=False)
    return out.where("row_id = 0").select("series_id", F.posexplode("vals").alias("member", "v")).select("series_id", F.col("member").cast("long").alias("member"), R("v", 3).alias("a_a"))


_MANY = "where m > 2"


@query(f"with {ENS}, {_OBS}, {_MOM} select series_id, member, round(a + c / (n + v) * (d - y), 3) + 0 as a_a from v {_MANY}")
def h2_enkf_two_stage(spark, sf):
    return _two_stage(spark, sf, "enkf")


@query(f"with {ENS}, {_OBS}, {_MOM} select series_id, member, round(a + c / (n + v) * (d - my) - case when v > 0 then c / v * (1 - sqrt(greatest(1 - v / (n + v), 0))) else 0 end * dy, 3) + 0 as a_a from v {_MANY}")
def h3_ensrkf_two_stage(spark, sf):
    return _two_stage(spark, sf, "ensrkf")


@query(f"with {ENS}, {_OBS}, {_MOM} select series_id, member, round(a + c / (n + ((1 + j) * (1 + j) + 2 * j * j) * v) * ((1 + j) * (d - y - b) - 2 * j * b), 3) + 0 as a_a from v {_MANY}")
def h4_rba_enkf_two_stage(spark, sf):
    return _two_stage(spark, sf, "rba_enkf")


@query(f"with {ENS}, {_OBS}, {_MOM} select series_id, member, round(a + c / (n + ((1 + j) * (1 + j) + 2 * j * j) * v) * ((1 + j) * (d - y - b) - 2 * j * b), 3) + 0 as a_a from v {_MANY}")
def h5_rba_cmame_two_stage(spark, sf):
    return _two_stage(spark, sf, "rba_enkf_cmame")


def decay(t, psi, params):
    """Relaxation at each member's own rate."""
    return -params[:1] * psi


def _twin(spark, sf):
    """Users as series: the state relaxes, observations are their event values."""
    s = inputs.signals(spark, sf)
    obs = s.where("step % 5 = 0 and step > 0").select("series_id", F.floor(F.col("step") / 5).alias("cycle"), "step", F.array("y").alias("d"), F.array(F.lit(4.0)).alias("cdd"))
    first = s.where("step = 0").select("series_id", F.col("y").alias("y0"))
    draws = lambda k, c: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: c(noise.keyed_normal(F.col("series_id"), j + k * 100, 1)))
    start = first.select("series_id", F.lit(0).cast("long").alias("step"), F.array(draws(0, lambda z: F.col("y0") + 5 * z)).alias("psi"), F.array(draws(1, lambda z: F.lit(0.1) + 0.02 * z)).alias("params"))
    return start, obs


@query()
def h6_h7_assimilate(spark, sf):
    start, obs = _twin(spark, sf)
    configs = spark.createDataFrame([(0, "enkf"), (1, "ensrkf")], "config_id long, method string")
    out = cycle.assimilate(start, obs, configs, decay, 1, cycle.Config(dt=0.1, limits=((0.0, 1.0),)))
    return out.select("series_id", "config_id", "cycle", "step", R(F.col("y_mean")[0], 4).alias("y_mean"), R(F.col("innovation")[0], 4).alias("innovation"), R(F.col("param_mean")[0], 4).alias("rate"), "rejected")


@query()
def h8_h11_bias_blind_and_post_forecast(spark, sf):
    start, obs = _twin(spark, sf)
    configs = spark.createDataFrame([(0, 3)], "config_id long, extra_steps int")
    out = cycle.assimilate(start, obs, configs, decay, 1, cycle.Config(method="ensrkf", dt=0.1, extra_steps=3))
    return out.where("cycle = -1").select("series_id", "step", R(F.col("y_mean")[0], 4).alias("y_mean"))


def _bias_aware(spark, sf):
    """Users as series whose observations are their event values, all after the washout; and a bias network trained on their anomalies."""
    s = inputs.signals(spark, sf)
    start, obs = _twin(spark, sf)
    anomalies = s.select("series_id", "step", "dim", (F.col("y") - 50).alias("y"))
    net = reservoir.fit_readout(reservoir.pack_series(anomalies), _net(), 5, 40, 1e-1)
    early = s.where("step between 1 and 9 and step % 2 = 1").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("step", F.array("y").alias("d")))).alias("wash"))
    return start.join(early, "series_id"), obs.where("step >= 10"), replace(net, upsample=2)


@query()
def h6_h7_bias_aware(spark, sf):
    start, obs, net = _bias_aware(spark, sf)
    configs = spark.createDataFrame([(0, "rba_enkf", 1, 2), (1, "rba_enkf_cmame", 0, 0)], "config_id long, method string, n_blind int, extra_steps int")
    out = cycle.assimilate(start, obs, configs, decay, 1, cycle.Config(dt=0.1, k=2.0), bias=net)
    return out.select("series_id", "config_id", "cycle", "step", *(R(F.col(c)[0], 4).alias(c) for c in ("y_mean", "innovation", "bias", "param_mean")))


@query()
def h6_biased_observations(spark, sf):
    """A network of bias and innovation (2 q outputs): observations are shifted by their difference before each analysis."""
    start, obs, net = _bias_aware(spark, sf)
    both = replace(net, wout=np.hstack((net.wout, 0.5 * net.wout)))
    configs = spark.createDataFrame([(0, "rba_enkf", 2.0), (1, "rba_enkf", 8.0)], "config_id long, method string, k double")
    out = cycle.assimilate(start, obs, configs, decay, 1, cycle.Config(dt=0.1, n_blind=1), bias=both)
    return out.select("series_id", "config_id", "cycle", "step", *(R(F.col(c)[0], 4).alias(c) for c in ("y_mean", "innovation", "bias", "param_mean")))


@query()
def w_bias_aware_sweep(spark, sf):
    """The sweep as a whole: every filter and regularisation factor on every series, errors of the biased and the unbiased estimate, the best cell of each series."""
    start, obs, net = _bias_aware(spark, sf)
    cells = [(i, m, k) for i, (m, k) in enumerate([("enkf", 0.0), ("ensrkf", 0.0), ("rba_enkf", 0.5), ("rba_enkf", 2.0), ("rba_enkf", 8.0)])]
    out = cycle.assimilate(start, obs, spark.createDataFrame(cells, "config_id long, method string, k double"), decay, 1, cycle.Config(dt=0.1), bias=net)
    runs = out.join(obs.select("series_id", "cycle", F.col("d")[0].alias("y")), ["series_id", "cycle"]).select("series_id", "config_id", "y", F.lit(0).alias("dim"), F.col("forecast_mean")[0].alias("biased"), (F.col("forecast_mean")[0] + F.col("bias")[0]).alias("unbiased"))
    path = new_folder(spark, "runs")  # one folder for each cell, read again as a later job would
    tables.write_runs(runs, path, ["config_id"])
    stored = tables.read_runs(spark, path).withColumn("config_id", F.col("config_id").cast("long"))
    errors = metrics.rms_per_step(stored, ["series_id", "config_id"], estimates=("biased", "unbiased"))
    best = errors.groupBy("series_id").agg(F.min(F.struct((F.col("rms_biased") + F.col("rms_unbiased")).alias("score"), "config_id"))["config_id"].alias("best"))
    return errors.join(best, "series_id").select("series_id", "config_id", R("rms_biased", 4).alias("rms_biased"), R("rms_unbiased", 4).alias("rms_unbiased"), (F.col("config_id") == F.col("best")).alias("is_best"))


@query()
def w_field_assimilation(spark, sf):
    """A field as a whole: modes of all snapshots; a network trained on all of their coefficients, one series for each label; sensors by rank; noisy
    observations of every third snapshot after the washout; an ensemble that forecasts in closed loop between them and is corrected by each; and
    the whole field's error before and after each analysis, for three filters."""
    n_modes, n_wash, every = 4, 8, 3
    field = inputs.field(spark, sf).select("step", "point_id", "value")
    modes, sigma, n_steps = fields.pod_by_points(field, n_modes)
    scale = [float(x) / math.sqrt(max(n_steps, 1)) for x in sigma]
    labels = inputs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("vec"), F.col("label").cast("long").alias("series_id"))
    labels = labels.withColumn("step", (F.row_number().over(Window.partitionBy("series_id").orderBy("vec")) - 1).cast("long"))
    phi = fields.project(field, modes, sigma.tolist()).withColumnRenamed("step", "vec").join(labels, "vec").select("series_id", "step", F.col("mode").alias("dim"), (F.col("phi") * math.sqrt(max(n_steps, 1))).alias("y"))
    w, win = random_reservoir(40, n_modes, 3, 2)
    net = reservoir.fit_long(phi, cycle.Reservoir(w, win, None, np.ones(n_modes), 0.7, 0.4), n_wash, 1e-1)
    sensors = fields.rank_sensors_once(modes, 6)
    own = {r["point_id"]: r for r in modes.where(F.col("point_id").isin(sensors)).collect()}  # as many rows as sensors
    look, offset = np.array([own[p]["psi"] for p in sensors]) * scale, np.array([own[p]["q_mean"] for p in sensors])
    steps = phi.where(F.col("step") <= n_wash).groupBy("series_id", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "y"))), lambda x: x["y"]).alias("u"))
    start = steps.groupBy("series_id").agg(F.max("step").alias("step"), F.transform(F.array_sort(F.collect_list(F.struct("step", "u"))), lambda x: x["u"]).alias("u")).where(F.size("u") == n_wash + 1)
    seen = labels.where((F.col("step") > n_wash) & (F.col("step") % every == 0))
    truth_ = field.withColumnRenamed("step", "vec").join(seen, "vec").select("series_id", "step", "point_id", "value")
    place = F.array_position(F.array(*map(F.lit, sensors)), F.col("point_id"))
    noisy = F.col("value") + 0.02 * noise.keyed_normal(F.col("series_id") * 1_000_003 + F.col("step"), F.col("point_id"), 5)
    at = truth_.where(place > 0).groupBy("series_id", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), noisy.alias("d")))), lambda x: x["d"]).alias("d"))
    obs = at.where(F.size("d") == len(sensors)).select("series_id", F.floor(F.col("step") / every).alias("cycle"), "step", "d", F.array_repeat(F.lit(4e-4), len(sensors)).alias("cdd"))
    configs = spark.createDataFrame([(0, "ensrkf", 10), (1, "ensrkf", 40), (2, "enkf", 40)], "config_id long, method string, m int")
    found = field_cycle.assimilate_fields(start, obs, configs, net, look, offset, field_cycle.FieldConfig(jitter=0.3, inflation=1.01))
    return field_cycle.field_errors(found, truth_, modes, scale).select("series_id", "config_id", "cycle", R("rms_before", 3).alias("rms_before"), R("rms_after", 3).alias("rms_after"))


@query()
def h12_rejected_analyses(spark, sf):
    start, obs = _twin(spark, sf)
    out = cycle.assimilate(start, obs, spark.createDataFrame([(0,)], "config_id long"), decay, 1, cycle.Config(dt=0.1, limits=((0.05, 0.15),)))
    return cycle.rejected_analyses(out).select("series_id", "cycle", "param", R("prior", 4).alias("prior"), R("posterior", 4).alias("posterior"))


_RK = "power(1 - k * 0.1::double + power(k * 0.1::double, 2) / 2 - power(k * 0.1::double, 3) / 6 + power(k * 0.1::double, 4) / 24, 8)"


@query(f"with {ENS}, e as (select *, p + 0.1::double as k from ens) select series_id, member, round(a * {_RK}, 6) as a from e")
def h9_forecast_ensemble(spark, sf):
    start = inputs.ensemble(spark, sf).select("series_id", "member", F.lit(0).cast("long").alias("step"), F.array("a").alias("psi"), F.array(F.col("p") + 0.1).alias("params"))
    return cycle.forecast_ensemble(start, decay, 8, 0.1, every=8).select("series_id", "member", R(F.col("psi")[0]).alias("a"))


@query(f"with {ENS}, g as (select series_id, avg(a) as ma, avg(p) + 0.1::double as k from ens group by series_id) select series_id, member, round(ma * {_RK} + a - ma, 6) as a from ens join g using (series_id)")
def h10_forecast_mean(spark, sf):
    start = inputs.ensemble(spark, sf).select("series_id", "member", F.lit(0).cast("long").alias("step"), F.array("a").alias("psi"), F.array(F.col("p") + 0.1).alias("params"))
    return cycle.forecast_mean(start, decay, 8, 0.1).where("step = 8").select("series_id", "member", R(F.col("psi")[0]).alias("a"))


# --- reservoirs


def _net(units: int = 30) -> cycle.Reservoir:
    w, win = random_reservoir(units, 1, 3, 5)
    return cycle.Reservoir(w, win, None, np.array([100.0]), 0.8, 0.5)


def _series(spark, sf):
    return reservoir.pack_series(inputs.signals(spark, sf).select("series_id", "step", "dim", "y"))


@query()
def i1_i2_reservoir_fit(spark, sf):
    series = _series(spark, sf)
    model = reservoir.fit_readout(series, _net(), 5, 40, 1e-3)
    return reservoir.reservoir_states(series, model, 5).select("series_id", "step", R(F.col("u_next")[0], 4).alias("u_next"))


@query()
def i3_closed_loop(spark, sf):
    series = _series(spark, sf)
    model = reservoir.fit_readout(series, _net(), 5, 40, 1e-3)
    windows = series.select("series_id", F.lit(0).cast("long").alias("window"), F.slice("u", 1, 10).alias("u"))
    return reservoir.closed_loop_forecast(windows, model, 8).select("series_id", "step", R(F.col("y")[0], 4).alias("y"))


@query()
def i4_search_hyperparameters(spark, sf):
    found = reservoir.search_hyperparameters(_series(spark, sf), _net(), [(0.5, 0.3), (0.9, 0.3), (0.9, 1.0)], [1e-4, 1e-2], 5, 40, 6, 3)
    return found.select("rho", "sigma", "tikh", R("score", 4).alias("score"))


@query()
def i4_best_hyperparameters(spark, sf):
    """The best cell of the search with sums over blocks of each series."""
    found = reservoir.search_long(inputs.signals(spark, sf).select("series_id", "step", "dim", "y"), _net(), [(0.5, 0.3), (0.9, 0.3), (0.9, 1.0)], [1e-4, 1e-2], 5, 40, 6, 3)
    return reservoir.best_hyperparameters(found).select("rho", "sigma", "tikh", R("score", 4).alias("score"))


@query()
def i5_readout_jacobian(spark, sf):
    series = _series(spark, sf)
    model = reservoir.fit_readout(series, _net(), 5, 40, 1e-3)
    return reservoir.jacobians(reservoir.reservoir_states(series, model, 5), model).select("series_id", "step", R(F.col("jac")[0], 4).alias("jac"))


@query()
def i6_bias_training_set(spark, sf):
    s = inputs.signals(spark, sf)
    obs = s.select("series_id", "step", F.col("y").alias("y_true"), (1.1 * F.col("y")).alias("y_raw"))
    ens = s.select("series_id", "step", "y", F.explode(F.array(F.lit(0), F.lit(1))).alias("member")).withColumn("y", F.col("y") * (1 + 0.1 * F.col("member")))
    out = reservoir.bias_training_set(obs, ens, 6, augmented=True, n_cr=20)
    return out.select("series_id", "member", "copy", "step", "factor", R("model_bias", 5).alias("model_bias"), R("innovation", 5).alias("innovation"))


@query()
def i9_i10_data_driven_forecast(spark, sf):
    series = _series(spark, sf)
    model = reservoir.fit_readout(series, _net(), 5, 40, 1e-3)
    sigma = float(np.linalg.svd(model.wout, compute_uv=False)[0])
    last = reservoir.reservoir_states(series, model, 5).where("step = 20").select("series_id", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("member"))
    ens = last.withColumn("sigmas", F.array(F.lit(sigma) * (1 + 0.01 * F.col("member"))))
    return reservoir.data_driven_forecast(ens, model, 5).select("series_id", "member", "step", R(F.col("y")[0], 4).alias("y"))


# --- modal reduction


def _cosines(n: int) -> list[list[float]]:
    return [[math.sqrt((1 if k == 0 else 2) / 64) * math.cos(math.pi * (i + 0.5) * k / 64) for k in range(n)] for i in range(64)]


_COS = "sqrt((case when k = 0 then 1 else 2 end) / 64.0::double) * cos(pi() * (point_id + 0.5::double) * k / 64)"


def _modes(spark, sf):
    basis = spark.createDataFrame([(i, row) for i, row in enumerate(_cosines(4))], "point_id long, psi array<double>")
    means = inputs.field(spark, sf).groupBy("point_id").agg(F.avg("value").alias("q_mean"))
    return means.join(basis, "point_id")


@query(f"with {FLD}, q as (select step, point_id, value - avg(value) over (partition by point_id) as q, count(*) over (partition by point_id) as n from fld), c as (select a.point_id as i, b.point_id as j, sum(a.q * b.q) / any_value(a.n) as c from q a join q b using (step) group by a.point_id, b.point_id) select round(sum(case when i = j then c else 0 end) / 2, 6) as tke, round(sum(case when i = j then c else 0 end) / 2, 6) as modal, round(sum(c * c), 8) as squares from c")
def j1_pod_energy(spark, sf):
    """Half the sum of the points' variances, the same from the modes, and the sum of the modes' squared eigenvalues, which SQL has from all covariances."""
    field = inputs.field(spark, sf)
    _, sigma, n = fields.pod_by_points(field, 64)
    lam = sigma**2 / max(n, 1)
    energy = field.groupBy("point_id").agg(F.var_pop("value").alias("v")).agg((F.sum("v") / 2).alias("tke"))
    return energy.select(R("tke").alias("tke"), F.round(F.lit(float(lam.sum() / 2)), 6).alias("modal"), F.round(F.lit(float((lam**2).sum())), 8).alias("squares"))


@query()
def j1_randomised_modes(spark, sf):
    """The first four modes by the method for fields whose sides are both long: what each takes of the field's variance, and its largest entry."""
    modes, _, sigma = low_rank.pod_randomised(inputs.field(spark, sf).select("step", "point_id", "value"), 4, oversample=60, side=64)  # a flat spectrum needs many
    size = F.transform(F.array(*(F.lit(float(x)) for x in sigma)), lambda x: x * x) if len(sigma) else F.array().cast("array<double>")
    each = modes.select("point_id", F.posexplode("psi").alias("mode", "psi"))
    return each.groupBy("mode").agg(F.max(F.abs("psi")).alias("top")).select("mode", R(F.get(size, F.col("mode")), 3).alias("variance"), R("top", 4).alias("top"))


@query(f"with {FLD}, m as (select *, value - avg(value) over (partition by point_id) as dq from fld) select step, k as mode, round(sum(dq * {_COS}) / (k + 1), 6) + 0 as phi from m, (select unnest(range(4))::int as k) group by step, k")
def j2_project(spark, sf):
    return fields.project(inputs.field(spark, sf).select("step", "point_id", "value"), _modes(spark, sf), [1.0, 2.0, 3.0, 4.0]).select("step", "mode", R("phi").alias("phi"))


_REC = f"m as (select *, avg(value) over (partition by point_id) as q from fld), c as (select step, k, sum((value - q) * {_COS}) as c from m, (select unnest(range(4)) as k) group by step, k)"


@query(f"with {FLD}, {_REC} select m.step, m.point_id, round(any_value(q) + sum(c * {_COS}), 6) + 0 as value from m join c using (step) where k < 3 group by m.step, m.point_id")
def j3_j4_reconstruct(spark, sf):
    sigma = [1.0, 2.0, 3.0, 4.0]
    modes = _modes(spark, sf)
    phi = fields.project(inputs.field(spark, sf).select("step", "point_id", "value"), modes, sigma)
    coeffs = phi.groupBy("step").agg(F.transform(F.array_sort(F.collect_list(F.struct("mode", "phi"))), lambda x: x["phi"]).alias("phi"))
    return fields.reconstruct(coeffs, fields.truncate_modes(modes, 3), sigma, 3).select("step", "point_id", R("value").alias("value"))


# --- streams


def _run_stream(df: DataFrame, what: str) -> DataFrame:
    """The stream run over what there is now, into Parquet in the shared folder."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = new_folder(spark, what)
    df.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def _event_stream(spark, sf) -> DataFrame:
    """The table as a stream, be it one file or a folder of files: a stream takes a single file by a pattern only."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


def first_state(series: int):
    rng = np.random.default_rng([3, series])
    return 50 + 20 * rng.standard_normal((1, 10)), 1e-9 * (1 + 0.1 * rng.standard_normal((1, 10))), 0


@query()
def k1_k2_k5_stream_assimilate(spark, sf):
    from assimspark.streaming.assimilate import stream_assimilate

    seconds = F.unix_timestamp("ts") - 1_704_000_000
    obs = _event_stream(spark, sf).select(F.col("user_id").alias("series_id"), F.floor(seconds / 86_400).cast("long").alias("step"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.array("value").alias("d"), F.array(F.lit(9.0)).alias("cdd"))
    out = stream_assimilate(obs, first_state, decay, 1, cycle.Config(method="ensrkf", dt=1.0), idle_ms=None, order=("at", "event_id"))
    return _run_stream(out, "stream-cycles").where("status = 'posterior'").select("series_id", "step", "cycle", R(F.col("y_mean")[0], 4).alias("y_mean"), "n_dropped")


_K3 = "r as (select user_id as series_id, event_id as step, x, -0.5::double * power((x - 40) / 30, 2) + sum(-0.5::double * power((x - value) / 20, 2)) over (partition by user_id, x order by event_id) as lw from events, g), w as (select *, exp(lw - max(lw) over (partition by series_id, step)) as w from r)"


@query(f"with g as (select unnest(range(41)) * 2.5::double as x), {_K3} select series_id, step, arg_max(x, w) as x_map, round(sum(x * w) / sum(w) + {OFF_TIES}::double, 4) as x_mean from w group by series_id, step")
def k3_stream_grid_bayes(spark, sf):
    from assimspark.streaming.assimilate import stream_grid_bayes

    grid = np.linspace(0, 100, 41)
    obs = _event_stream(spark, sf).select(F.col("user_id").alias("series_id"), F.col("event_id").alias("step"), F.col("value").alias("d"))
    out = stream_grid_bayes(obs, grid, -0.5 * ((grid - 40) / 30) ** 2, log_likelihood)
    return _run_stream(out, "stream-bayes").select("series_id", "step", "x_map", R(F.col("x_mean") + OFF_TIES, 4).alias("x_mean"))


def log_likelihood(x, d):
    return -0.5 * ((x - d) / 20) ** 2


@query("with w as (select time_bucket(interval '1 day', ts) as w, user_id as series_id, event_type as dim, value as y from events), m as (select max(ts) - interval '1 hour' as mark from events) select w as start, series_id, dim, round(avg(abs(y - 40)) / max(max(y)) over (partition by series_id, dim order by w), 6) as err, round(max(max(y)) over (partition by series_id, dim order by w), 6) as scale, count(*) as n from w, m where w + interval '1 day' <= mark group by w, series_id, dim")
def k4_stream_interval_error(spark, sf):
    from assimspark.streaming.assimilate import stream_interval_error

    rows = _event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("series_id"), F.col("event_type").alias("dim"), F.col("value").alias("y"), F.lit(40.0).alias("e"))
    out = stream_interval_error(rows, "1 day", "1 hour")
    return _run_stream(out, "stream-errors").select(F.col("start").cast("timestamp_ntz").alias("start"), "series_id", "dim", R("err").alias("err"), R("scale").alias("scale"), "n")


