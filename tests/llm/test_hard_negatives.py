import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assimspark.llm.entries import op12_hard_negatives
from assimspark.llm.hard_negatives import bit_planes, hard_negatives, look_up, quantised, score_type, subset_sums

SCHEMA = "vec_id long, embedding array<float>, label int, score int, place string"


@pytest.mark.parametrize("low,high,dtype", [(-3, 4, np.int32), (-160, 160, np.int32), (-(2**20), 2**20, np.int64), (0, 1, np.int32), (0, 0, np.int32), (-1, 0, np.int32)])
def test_lookups_are_inner_products(low, high, dtype):
    rng = np.random.default_rng(3)
    a, c = rng.integers(low, high + 1, (7, 24)), rng.integers(low, high + 1, (50, 24))
    bits = bit_planes(c)
    assert score_type(int(abs(a).max(initial=0)), 24, len(bits)) is dtype
    assert (look_up(subset_sums(a, dtype), bits) == c @ a.T).all()


def test_scores_beyond_64_bits_are_refused():
    with pytest.raises(ValueError):
        score_type(2**40, 64, 30)


def brute_force(rows, positives=5, negatives=5, low=80):
    """Rows (id, label, whole numbers); anchors are ids divisible by 100."""
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    out = []
    for a, kind, q in rows:
        if a % 100 == 0:
            mates = sorted((-dot(q, r), i) for i, l, r in rows if l == kind and i != a)[:positives]
            for s, p in mates:
                rivals = sorted((-dot(q, r), i) for i, l, r in rows if l != kind and i != a and low * -s <= 100 * dot(q, r) <= 100 * -s)[:negatives]
                out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(rivals, 1)]
    return sorted(out)


def checked(spark, rows, **more):
    df = spark.createDataFrame([(i, v, l, 1, "x") for i, l, v in rows], SCHEMA).repartition(3)
    got = hard_negatives(quantised(df, F.col("label")), F.expr("vec_id % 100 = 0"), **more)
    return sorted(tuple(r) for r in got.collect())


def whole(rows):
    return [(i, l, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, l, v in rows]


@pytest.mark.parametrize("cells", [{}, {"anchors_in_block": 2, "rows_in_cell": 40}])
def test_equals_brute_force_with_ties_and_repeats(spark, cells):
    rng = random.Random(5)
    rows = [(i * 20, rng.randrange(3), [rng.choice((-0.25, 0.0, 0.25, 0.5)) for _ in range(12)]) for i in range(150)]
    rows += [(7 + i, 1, [0.25] * 12) for i in range(40)] + [rows[10], rows[11], rows[0]]
    got = checked(spark, rows, **cells)
    assert got == brute_force(whole(rows)) and len(got) > 200


def test_nulls_odd_vectors_and_no_rows(spark):
    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.5]), (2, 2, [0.5, 0.45]), (3, 2, [0.5]), (4, 2, []), (100, 9, [1.0, 1.0]), (200, 2, [-1.0, 0.0])]
    odd = [(5, None, [0.5, 0.5]), (None, 1, [0.5, 0.5]), (6, 1, None), (7, 1, [float("nan"), 1.0]), (8, 1, [float("inf"), 1.0]), (9, 1, [None, 1.0]), (300, None, [1.0])]
    assert checked(spark, rows + odd) == brute_force(whole(rows)) != []
    assert checked(spark, []) == []
    assert checked(spark, [(0, 1, [0.5]), (1, 2, [0.5])]) == []


def test_query_relabels_every_seventh(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, i % 10, rng.normal(0, 0.1, 64).tolist()) for i in range(801)]
    spark.createDataFrame([(i, v, l, 1, "x") for i, l, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute_force([(i, (l + 1) % 10 if i % 7 == 0 else l, q) for i, l, q in whole(rows)])
    assert sorted(tuple(r) for r in op12_hard_negatives(spark, str(tmp_path)).collect()) == want
