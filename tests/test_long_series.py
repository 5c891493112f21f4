"""Peaks, recurrences, sweep cells and analyses against plain versions over all pairs or rows."""

import numpy as np
import pytest

from assimspark.functions import kernels
from assimspark.operators import align, fields, filters
from assimspark.sources import tables


def plain_peaks(rows, distance):
    """Rows (step, y): higher ones choose first, of equals the earlier."""
    kept = []
    for step, y in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(abs(step - k) >= distance for k, _ in kept):
            kept.append((step, y))
    return sorted(kept)


@pytest.mark.parametrize("rounds,block", [(3, 100_000), (0, 50), (1, 10), (2, 60)])
def test_peaks_keep_their_distance(spark, rounds, block):
    rng = np.random.default_rng(6)
    series = {1: [(int(s), float(rng.integers(0, 9))) for s in sorted(rng.choice(900, 400, replace=False))], 2: [(3 * k, float(k)) for k in range(300)], 3: [(k - 40, 1.0) for k in range(90)], 4: [(7, 2.0)], 5: [(10 * k, 0.0) for k in range(5)]}
    rows = [(s, step, y, "x") for s, part in series.items() for step, y in part]
    df = spark.createDataFrame([*rows, (4, 7, 1.0, "lower"), (4, None, 9.0, "x"), (4, 8, None, "x")], "series_id long, step long, y double, block string").repartition(3)
    for distance in (1, 5, 12):
        got = {}
        for r in align.separate_peaks(df, ["series_id"], distance, rounds=rounds, block=block).collect():
            got.setdefault(r["series_id"], []).append((r["step"], r["y"]))
        assert {s: sorted(p) for s, p in got.items()} == {s: plain_peaks(p, distance) for s, p in series.items()}
    assert align.separate_peaks(df.where("step < -99"), ["series_id"], 3).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.05, 0.2, 0.5, 1.0])
def test_percentile_of_distances(share):
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=60), rng.integers(0, 5, 50).astype(float), np.zeros(7), np.array([2.5]), np.array([0.1, 0.2, 0.3, 1e9, 0.1 + 0.2])):
        gaps = np.sort(np.abs(x[:, None] - x).ravel())
        place = share * (len(gaps) - 1)
        low = gaps[int(place)]
        want = low + (place - int(place)) * (gaps[min(int(place) + 1, len(gaps) - 1)] - low)
        assert fields.distance_percentile(x, share) == want


def test_recurrences_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    series = {0: rng.normal(size=70), 1: np.round(rng.normal(size=60), 1), 2: np.zeros(5), 3: np.array([1e6, -1e6, 1e6 + 1, 3.0])}
    rows = [(m, s, float(x), 1) for m, xs in series.items() for s, x in enumerate(xs)] + [(0, 900, None, 1), (0, 901, float("nan"), 1)]
    df = spark.createDataFrame(rows, "mode long, step long, x double, bucket int").repartition(3)
    got = sorted(map(tuple, fields.recurrence_pairs(df, 0.3).collect()))
    want = []
    for m, x in series.items():
        gaps = np.abs(x[:, None] - x)
        want += [(m, int(i), int(j)) for i, j in zip(*np.nonzero(gaps < np.quantile(gaps, 0.3)))]
    assert got == sorted(want) and len(got) > 1000
    assert fields.recurrence_pairs(df.where("step < 0")).count() == 0


def test_recurrence_limits_round_as_sql_does(spark):
    import duckdb

    rng = np.random.default_rng(6)
    values = [1.09, 24.04, 73.94, 64.84, 197.58, 158.44, 47.25, 22.75, 215.73, 109.02, 24.93, 61.56, 9.81, 28.23, 42.87, 56.51, 13.75, 111.65, 47.46, 2.47, 72.31, 21.01, 10.62, 154.0, 46.94, 33.29, 27.36, 127.93, 2.27, 110.73]
    modes = {0: np.array(values)} | {m: np.round(rng.gamma(2, 20, int(rng.integers(5, 40))), 2) for m in range(1, 300)}
    con = duckdb.connect()
    con.execute("create table x (mode bigint, x double)")
    con.executemany("insert into x values (?, ?)", [(m, float(v)) for m, xs in modes.items() for v in xs])
    sql = dict(con.execute("select mode, quantile_cont(abs(a.x - b.x), 0.2) from x a join x b using (mode) group by mode").fetchall())
    assert {m: fields.recurrence_limit(x, 0.2) for m, x in modes.items()} == sql
    df = spark.createDataFrame([(0, s, v) for s, v in enumerate(values)], "mode long, step long, x double")
    assert fields.recurrence_pairs(df, 0.2).count() == con.execute("select count(*) from x a, x b where a.mode = 0 and b.mode = 0 and abs(a.x - b.x) < ?", [sql[0]]).fetchall()[0][0]


def test_a_long_mode_needs_no_pairs_for_its_limit():
    x = np.random.default_rng(5).normal(size=100_000)
    limit = fields.distance_percentile(x, 1e-5)
    assert abs(fields._count_within(np.sort(x), limit) / len(x) ** 2 - (1e-5)) < 1e-6


def test_a_cell_can_be_written_again(spark, tmp_path):
    cell = lambda l, k, v: spark.createDataFrame([(l, k, v)], "L int, k double, v double")
    for args in ((1, 0.5, 1.0), (2, 0.5, 2.0), (1, 0.5, 3.0)):
        tables.write_runs(cell(*args), f"{tmp_path}/runs", ["L", "k"])
    assert sorted((r["L"], r["k"], r["v"]) for r in tables.read_runs(spark, f"{tmp_path}/runs").collect()) == [(1, 0.5, 3.0), (2, 0.5, 2.0)]


@pytest.mark.parametrize("spread", [1, 3])
def test_rows_stream_past_their_weights(spark, spread):
    rng = np.random.default_rng(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # cycles go on over batches
    try:
        rows, found, want = [], [], {}
        for s in range(9):
            m = 3 + s % 3
            x, w = rng.normal(size=(m, m)), rng.normal(size=m)
            if s != 4:
                found.append((s, 0, m, x.ravel().tolist(), w.tolist() if s % 2 else []))
            for i in range(20 if s == 2 else s % 4):
                v = rng.normal(size=(1, m))
                rows.append((s, 0, i, "state", v[0].tolist(), "extra"))
                if s != 4:
                    want[s, i] = (kernels.apply_square_root(v, w, x) if s % 2 else kernels.apply_weights(v, x))[0]
        df = spark.createDataFrame(rows, "series_id long, cycle long, row_id int, kind string, vals array<double>, x string").repartition(4)
        weights = spark.createDataFrame(found, filters.WEIGHTS)
        out = filters.apply(df, weights, spread)
        assert out.columns == df.columns
        got = {(r["series_id"], r["row_id"]): r["vals"] for r in out.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
        assert filters.apply(df.where("cycle = 9"), weights).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_chunks_keep_missing_steps_apart(spark):
    rows = [(p, s, float(p * 1000 + s)) for p in (1, 2) for s in range(-70, 200) if (s + p) % 5 and not 20 < s < 100] + [(1, None, 1.0), (1, 3, None), (2, 0, -5.0)]
    field = spark.createDataFrame(rows, "point_id long, step long, value double")
    chunks = tables.field_to_chunks(field, ["point_id"], chunk=64)
    assert max(len(r["snaps"]) for r in chunks.collect()) <= 64
    back = {(r["point_id"], r["step"]): r["value"] for r in tables.chunks_to_field(chunks, ["point_id"], chunk=64).collect()}
    want = {}
    for p, s, v in rows:
        if s is not None and v is not None:
            want[p, s] = max(v, want.get((p, s), v))
    assert {k: v for k, v in back.items() if v is not None} == want and len(back) % 64 == 0 and back[1, 50] is None
    assert tables.field_to_chunks(field.where("step > 999"), ["point_id"], chunk=64).count() == 0


def test_tournament_of_sensors(spark):
    rng = np.random.default_rng(7)
    psi = np.linalg.qr(rng.normal(size=(300, 6)))[0]
    psi[[17, 90, 211]] *= 9  # stand out
    modes = spark.createDataFrame([(i, 0.0, row.tolist()) for i, row in enumerate(psi)], "point_id long, q_mean double, psi array<double>")
    greedy = fields.rank_sensors(modes, 6)
    assert fields.rank_sensors_once(modes.coalesce(1), 6, tasks=1) == greedy
    volume = lambda chosen: abs(np.linalg.det(psi[chosen]))
    many = fields.rank_sensors_once(modes.repartition(8), 6, tasks=3)
    assert set(many[:3]) == {17, 90, 211} == set(greedy[:3]) and len(set(many)) == 6 and volume(many) >= 0.5 * volume(greedy)
    assert fields.rank_sensors_once(modes.where("point_id < 0"), 3) == [] and fields.rank_sensors_once(modes, 6, modes.where("point_id in (4, 5)").select("point_id")) in ([4, 5], [5, 4])


def test_random_sensors(spark):
    points = spark.createDataFrame([(i % 40,) for i in range(90)], "point_id long")
    chosen = [[r["point_id"] for r in fields.random_sensors(points.repartition(k), 7, 3).collect()] for k in (1, 4)]
    assert chosen[0] == chosen[1] == sorted(set(chosen[0])) and len(chosen[0]) == 7 and set(chosen[0]) <= set(range(40))
    assert chosen[0] != [r["point_id"] for r in fields.random_sensors(points, 7, 4).collect()] and fields.random_sensors(points, 99).count() == 40
