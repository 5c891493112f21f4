import math
import random
import zlib
from collections import Counter

import numpy as np

from assimspark.llm import lm_score
from assimspark.llm.gru import CLASS_SIZE, Model, Shape, windows
from assimspark.llm.lm_score import Lookup, count_words, score

SMALL = Shape(n_head=128, n_tail=64, embed=6, hidden=8)


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def held(d):
    return zlib.crc32(str(d).encode()) % 7 == 2


def corpus(n=300):
    rng = random.Random(4)
    two = [[f"{a}{i}" for i in range(40)] for a in ("x", "y")]
    rows = []
    for d in range(n):
        w, at = two[d % 2], rng.randrange(40)
        words = []
        for _ in range(rng.randint(1, 120)):
            at = (at + rng.choice((1, 1, 1, 2))) % 40
            words.append(w[at].upper() if rng.random() < 0.1 else w[at])
        rows.append((d, " ".join(words) + (f" rare{d} rare{d % 9}" if d % 3 == 0 else "")))
    return rows + [(1000, None), (1001, ""), (1002, " \n\t")]


def test_base_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double").repartition(2)
    got = {r["doc_id"]: r for r in score(df, SMALL, most_known=100, rounds=2).collect()}
    c = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n = sum(c.values())
    for d, x in rows:
        ts = tokens(x)
        assert got[d]["held_out"] == held(d) and got[d]["n_tokens"] == len(ts) and got[d]["train_tokens"] == n
        assert got[d]["n_known"] == sum(c[t] > 0 for t in ts)
        assert math.isclose(got[d]["base_score"], sum(math.log10((c[t] + 1) / (n + len(c) + 1)) for t in ts), rel_tol=1e-9)
    test = [got[d] for d, _ in rows if held(d)]
    assert sum(r["score"] for r in test) > 1.05 * sum(r["base_score"] for r in test)


def test_windows_cover_each_token_once():
    starts = np.array([0, 3, 3, 10, 11])
    ids = np.arange(11)
    seen = Counter()
    for x, y, keep, owner in windows(ids, starts, 99, 2, 4):
        for a, b, k, o in zip(x.ravel(), y.ravel(), keep.ravel(), owner.ravel()):
            if o >= 0:
                seen[(int(o), int(a), int(b), float(k))] += 1
    want = Counter()
    for d in range(4):
        w = [*ids[starts[d]:starts[d + 1]].tolist(), 99]
        want.update((d, p, q, float(i > 0)) for i, (p, q) in enumerate(zip([99, *w], w)))
    assert seen == want


def test_gradient_and_normalisation():
    shape = Shape(n_head=64, n_tail=64, embed=3, hidden=4)
    rng = np.random.default_rng(0)
    model = Model(shape, shape.start(np.ones(128)) + rng.normal(0, 0.2, sum(int(np.prod(s)) for s in shape.sizes().values())))
    ids, starts = rng.integers(0, 128, 9), np.array([0, 4, 9])
    (x, y, keep, owner), = windows(ids, starts, 0, 2, 8)
    grad_flat = np.zeros_like(model.flat)
    model._gradient(x, y, keep, owner >= 0, np.zeros((2, 4), np.float32), shape.split(grad_flat))
    for k in rng.choice(len(grad_flat), 60):
        up, down = model.flat.copy(), model.flat.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        slope = -(Model(shape, up).score(ids, starts, 0).sum() - Model(shape, down).score(ids, starts, 0).sum()) * math.log(10) / (up[k] - down[k])
        assert abs(slope - grad_flat[k]) < 2e-2 * max(1, abs(slope))
    state = np.append(rng.normal(size=(1, 4)), [[1.0]], axis=1).astype(np.float32)
    assert math.isclose(sum(10 ** model.log10_of(state, np.array([w]))[0] for w in range(shape.n_words)), 1.0, rel_tol=1e-4) and CLASS_SIZE == 64


def test_one_window_or_many_give_the_same_score():
    shape = Shape(n_head=64, n_tail=64)
    model = Model(shape, shape.start(np.ones(128)) * 3)
    rng = np.random.default_rng(1)
    ids, starts = rng.integers(0, 128, 50), np.array([0, 20, 21, 50])
    assert np.allclose(model.score(ids, starts, 0, 1, 100), model.score(ids, starts, 0, 3, 7), rtol=1e-4)


def test_empty_table(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string"), SMALL).count() == 0


def test_repeated_and_null_ids_and_all_held_out(spark):
    out = next(d for d in range(100) if held(d))
    rows = [(5, "a b a"), (5, "a b a"), (None, "b"), (5, "c"), (out, "a zz")]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["held_out"]) for r in score(spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect())
    assert got == sorted([(5, 4, 4, False), (5, 4, 4, False), (-1, 2, 2, False), (5, 2, 2, False), (out, 3, 2, True)])
    only = score(spark.createDataFrame([(out, "a b")], "doc_id long, text string"), SMALL).first()
    assert only["train_tokens"] == 0 and only["n_known"] == 0 and only["base_score"] == 0.0 and np.isfinite(only["score"])


def test_training_learns_what_follows():
    rng = np.random.default_rng(2)
    shape = Shape(n_head=64, n_tail=64)
    docs = [(np.arange(30) * 7 + rng.integers(60)) % 60 + 1 for _ in range(400)]
    ids, starts = np.concatenate(docs), np.arange(401) * 30
    model = Model(shape, shape.start(np.bincount(ids, minlength=128)))
    before = model.score(ids[:3000], starts[:101], 0).sum()
    for _ in range(6):
        model.train(ids[3000:], starts[100:] - 3000, 0, n_lanes=32, steps=15, rate=0.03)
    assert model.score(ids[:3000], starts[:101], 0).sum() > 0.5 * before


def test_each_round_reads_all_training_documents(spark, monkeypatch):
    average, seen = lm_score._average, []

    def watched(weights, tasks=8):
        seen.append(weights.agg({"n": "sum"}).first()[0])
        return average(weights, tasks)

    monkeypatch.setattr(lm_score, "_average", watched)
    rows = corpus(60)
    lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), SMALL, most_known=100, rounds=3).count()
    assert seen == [sum(len(tokens(x)) for d, x in rows if not held(d))] * 3


def test_few_targets_train_too():
    shape = Shape(n_head=64, n_tail=64)
    ids, starts = np.arange(60) % 5 + 1, np.array([0, 60])
    model = Model(shape, shape.start(np.ones(128)))
    before = model.score(ids, starts, 0).sum()
    assert model.train(ids, starts, 0) == 61 and model.score(ids, starts, 0).sum() > before


def test_words_that_share_a_slot_are_counted_and_found():
    rng = np.random.default_rng(5)
    some = (rng.integers(0, 40, 300).astype(np.uint64) << np.uint64(44)) + rng.integers(0, 2**44, 300).astype(np.uint64)  # 300 words in 40 slots
    words = some[np.minimum(rng.zipf(1.3, 5000) - 1, 299)]
    cls = (words % np.uint64(64)).astype(np.int64)
    want = Counter(words.tolist())
    found, of_found, n = count_words(words, cls)
    assert dict(zip(found.tolist(), n.tolist())) == want and (np.diff(found.astype(object)) > 0).all() and (of_found == (found % np.uint64(64)).astype(np.int64)).all()
    top = sorted(want, key=lambda w: (-want[w], w))[:100]
    lookup = Lookup(Shape(n_head=64, n_tail=64), np.array(top, np.uint64), np.array([want[w] for w in top], float), 3)
    ids, log_c, known = lookup(words, cls)
    for w, c, i, x, k in zip(words.tolist(), cls.tolist(), ids.tolist(), log_c.tolist(), known.tolist()):
        at = top.index(w) if w in top else None
        assert k == (at is not None) and math.isclose(x, math.log10(want[w] + 1) if k else 0.0)
        assert i == (at + (at >= 3) if k and at < 63 else 64 + c)


def test_huge_weights_leave_scores_finite():
    shape = Shape(n_head=64, n_tail=64)
    model = Model(shape, shape.start(np.ones(128)) * 400)
    ids, starts = np.arange(40) * 3 % 128, np.array([0, 25, 40])
    grad = np.zeros_like(model.flat)
    x, y, keep, owner = next(windows(ids, starts, 0, 2, 32))
    with np.errstate(over="ignore"):
        model._gradient(x, y, keep, owner >= 0, np.zeros((2, 16), np.float32), shape.split(grad))
        assert np.isfinite(model.score(ids, starts, 0)).all() and np.isfinite(grad).all()
