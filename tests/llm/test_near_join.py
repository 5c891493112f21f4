import random
from itertools import combinations

from assimspark.llm.near_join import choose_boundary, near_groups


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(rng, n):
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    bases = [rng.choices(words, k=rng.choice((3, 5, 8, 10, 12, 14, 17, 19, 22, 40, 90, 200))) for _ in range(n // 12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.1:
            w = w[:-1] or w
        if rng.random() < 0.2:
            w = w + passage
        rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus(random.Random(2), 500) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one\ttwo"), (1005, "one  two three")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").repartition(5)
    assert sorted(map(tuple, near_groups(df).collect())) == brute(rows)


def test_a_dense_group_and_a_chain(spark):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_groups(df).collect())) == brute(rows)


def test_shared_ids_nulls_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(40))
    other = " ".join(f"o{i}" for i in range(40))
    df = spark.createDataFrame([(5, text), (5, other), (3, text), (7, other), (None, text), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, near_groups(df).collect()), key=str)
    assert got == sorted([(5, 36, 3), (5, 36, 3), (3, 36, 3), (7, 36, 3), (None, 36, None), (9, 0, 9)], key=str)
    assert near_groups(df.where("doc_id = 0")).count() == 0


def test_boundary_follows_cost():
    assert choose_boundary({}) == 0 and 3 <= choose_boundary({n: 100 for n in range(1, 33)}) <= 16
