import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_bias_training_set_has_all_observations(spark):
    steps = {}
    for r in __spark_entry__.queries()["i6_bias_training_set"](spark, SF).select("series_id", "step").distinct().collect():
        steps.setdefault(r["series_id"], set()).add(r["step"])
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = {r["user_id"]: r["count"] for r in events.groupBy("user_id").count().collect()}
    assert steps.keys() == want.keys() and max(want.values()) > 20
    assert all(steps[s] <= set(range(n)) and len(steps[s]) >= n - 6 for s, n in want.items())


def test_whole_queries_have_all_rows(spark):
    get = __spark_entry__.queries()
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("customer", "nation")}
    assert get["g1_virtual_sensors"](spark, SF).count() == n["customer"] * n["nation"]
    counts = [r["count"] for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").count().collect()]
    assert get["d16_amplitude_spectrum"](spark, SF).count() == sum(c // 2 for c in counts)
    assert get["d19_grid_bayes"](spark, SF).count() == sum(-(-c // 10) for c in counts)
