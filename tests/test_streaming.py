import datetime as dt
import os

import numpy as np

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_each_event_is_assimilated(spark):
    rows = __spark_entry__.queries()["k1_k2_k5_stream_assimilate"](spark, SF).collect()
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = {r["user_id"]: r["count"] for r in events.groupBy("user_id").count().collect()}
    assert len(rows) == sum(want.values()) and all(r["n_dropped"] == 0 for r in rows)
    for user, n in want.items():
        assert sorted(r["cycle"] for r in rows if r["series_id"] == user) == list(range(n))


def test_order_and_duplicates(spark):
    from assimspark.plans import cycle
    from assimspark.plans.queries import decay, first_state
    from assimspark.streaming.assimilate import stream_assimilate

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(5)
    obs = [(s, k // 4, k, [float(rng.normal(50, 9))], [9.0]) for s in (1, 2) for k in range(20)]
    mixed = [obs[i] for i in rng.permutation(len(obs))]
    results = []
    for rows in (obs, mixed, mixed + obs[5:6]):
        df = spark.createDataFrame(rows, "series_id long, step long, event_id long, d array<double>, cdd array<double>").repartition(3)
        out = stream_assimilate(df, first_state, decay, 1, cycle.Config(method="ensrkf", dt=1.0), idle_ms=None, order=("event_id",)).collect()
        results.append(sorted((r["series_id"], r["step"], r["cycle"], r["y_mean"][0]) for r in out))
        assert max(r["n_dropped"] for r in out) == len(rows) - len(obs)
    assert len(results[0]) == 40 and results[0] == results[1] == results[2]


def _in_batches(spark, tmp_path, batches, schema):
    """A stream that reads one file after the other."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/made/{i}")
        for f in (tmp_path / "made" / str(i)).glob("part-*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            target = tmp_path / "in" / f"{i}.parquet"
            f.rename(target)
            os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_idle_series_are_evicted_and_late_rows_set_aside(spark, tmp_path):
    from assimspark.plans import cycle
    from assimspark.plans.queries import decay, first_state
    from assimspark.streaming.assimilate import stream_assimilate, write_with_side_table

    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    row = lambda series, h: (series, h, hour(h), [50.0 + h], [9.0])
    batches = [[row(1, 1), row(2, 1), row(1, 2)], [row(2, 9)], [row(2, 10)], [row(1, 11), row(2, 12)], [row(1, 11), row(1, 10), row(2, 13), (2, 14, hour(14), None, [9.0])]]
    obs = _in_batches(spark, tmp_path, batches, "series_id long, step long, at timestamp, d array<double>, cdd array<double>")
    out = stream_assimilate(obs, first_state, decay, 1, cycle.Config(method="ensrkf", dt=1.0), idle_ms=3 * 3_600_000, event_time="at", lateness="2 hours", dead_letters=True)
    write_with_side_table(out, f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/log").awaitTermination()
    good = sorted((r["series_id"], r["step"], r["cycle"]) for r in spark.read.parquet(f"{tmp_path}/good").collect())
    # series 1 was idle from hour 2 on and evicted before hour 11, so its cycles begin again; series 2 went on
    assert good == [(1, 1, 0), (1, 2, 1), (1, 11, 0), (2, 1, 0), (2, 9, 1), (2, 10, 2), (2, 12, 3), (2, 13, 4)] or good == [(1, 1, 0), (1, 2, 1), (1, 11, 0), (2, 1, 0), (2, 9, 0), (2, 10, 1), (2, 12, 2), (2, 13, 3)]
    dead = sorted((r["series_id"], r["step"], r["status"], r["n_dropped"]) for r in spark.read.parquet(f"{tmp_path}/dead").collect())
    assert dead == [(1, 10, "late", 1), (1, 11, "repeated", 2)]


def test_errors_over_the_largest_truth_so_far(spark, tmp_path):
    from assimspark.streaming.assimilate import stream_interval_error

    rng = np.random.default_rng(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=int(m)), int(s), "abc"[d], float(y), float(y + e)) for m, s, d, y, e in zip(np.sort(rng.integers(0, 6000, 300)), rng.integers(0, 3, 300), rng.integers(0, 2, 300), rng.normal(5, 3, 300), rng.normal(size=300))]
    batches = [rows[a:a + 60] for a in range(0, 300, 60)]
    stream = _in_batches(spark, tmp_path, batches, "ts timestamp, series_id long, dim string, y double, e double")
    stream_interval_error(stream, "1 hour", "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["start"], r["series_id"], r["dim"], r["err"], r["scale"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    mark, cells, want, largest = rows[-1][0] - dt.timedelta(minutes=10), {}, [], {}
    for ts, s, d, y, e in rows:
        cells.setdefault((ts.replace(minute=0), s, d), []).append((y, abs(y - e)))
    for (w, s, d), held in sorted(cells.items()):
        largest[s, d] = max(largest.get((s, d), -np.inf), *(y for y, _ in held))
        if w + dt.timedelta(hours=1) <= mark:
            want.append((w, s, d, np.mean([e for _, e in held]) / largest[s, d], largest[s, d], len(held)))
    assert [g[:3] + g[5:] for g in got] == [w[:3] + w[5:] for w in want] and np.allclose([g[3:5] for g in got], [w[3:5] for w in want])
    assert len(got) > 100


def test_empty_streams(spark, tmp_path):
    from assimspark.plans import cycle
    from assimspark.plans.queries import decay, first_state
    from assimspark.streaming.assimilate import stream_assimilate, stream_interval_error

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    none = spark.createDataFrame([(1, None, [1.0], [1.0]), (1, 2, None, [1.0])], "series_id long, step long, d array<double>, cdd array<double>")
    assert stream_assimilate(none, first_state, decay, 1, cycle.Config(), idle_ms=None).count() == 0
    rows = spark.createDataFrame([], "ts timestamp, series_id long, dim int, y double, e double")
    assert stream_interval_error(rows, "1 hour", "1 hour").count() == 0


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    from assimspark.plans.queries import _event_stream, _run_stream

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1,)], "other long").write.parquet(f"{tmp_path}/events2.parquet")
    for sf in (SF, str(tmp_path)):
        got = _run_stream(_event_stream(spark, sf).select("event_id", "value"), "events")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.select("event_id", "value").collect()))
    queries = __spark_entry__.queries()
    for name in ("k1_k2_k5_stream_assimilate", "k3_stream_grid_bayes", "k4_stream_interval_error"):
        file, folder = (sorted(map(str, queries[name](spark, sf).collect())) for sf in (SF, str(tmp_path)))
        assert len(file) > 500 and folder == file


def test_ties_of_the_value_grid_are_not_broken_by_rounding(spark):
    from assimspark.plans.queries import log_likelihood
    from assimspark.streaming.assimilate import stream_grid_bayes

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    values = [63.83, 109.03, 32.31, 67.1, 65.32, 11.57, 55.38, 14.23, 53.98, 45.94, 0.78, 146.16, 3.72, 20.4, 84.0]
    assert round(sum(values) - 51.25 * len(values), 9) == 5  # 50 and 52.5 are equally likely
    grid = np.linspace(0, 100, 41)
    obs = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "series_id long, step long, d double")
    out = stream_grid_bayes(obs, grid, -0.5 * ((grid - 40) / 30) ** 2, log_likelihood).orderBy("step").collect()
    assert len(out) == len(values) and (out[-1]["x_map"], round(out[-1]["x_mean"], 6)) == (50.0, 51.25)
