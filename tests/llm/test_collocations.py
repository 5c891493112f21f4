import random
import re
from collections import Counter

import pytest

from assimspark.llm.collocations import collocations

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute_force(rows, min_count=30, most=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting all phrases of all pieces."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                f.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and inside(q) and 100 * b >= 80 * a for q, b in candidates.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def texts(seed=1, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "ÉTÉ", "x\x1cy", "　", "a b", "#", "<|", "0"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(40)):
            parts.append(rng.choice(["new york city", "in the heart of", rng.choice(words), rng.choice(words)]) + rng.choice(gaps))
        out.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(parts)))
    return out + [("en", None), (None, ""), ("de", "nothing here"), ("fr", " \t. ,"), ("en", "long tail of words " * 3000), *[("en", "same text again and again")] * 40]


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, l, l, 5) for i, (l, t) in enumerate(rows)], "doc_id long, text string, lang string, word string, n long").repartition(3)
    return sorted(tuple(r) for r in collocations(df, **more).collect())


@pytest.mark.parametrize("more", [{}, {"most_broadcast": 5}, {"most_broadcast": 0}])
def test_equals_brute_force(spark, more):
    rows = texts()
    got = run(spark, rows, **more)
    assert got == brute_force(rows) and len(got) > 40


def test_thresholds_and_ranks(spark):
    rows = texts(4, 60)
    assert run(spark, rows, min_count=3, most=7) == brute_force(rows, 3, 7)


def test_counts_at_the_edges(spark):
    rows = [("en", "a b.")] * 29 + [("en", "c d")] * 30 + [("en", "e e e")] * 30 + [("en", "f g h")] * 40 + [("en", "g h")] * 10 + [("en", "p q r")] * 39 + [("en", "q r")] * 11
    assert run(spark, rows) == brute_force(rows)


def test_no_rows_and_no_words(spark):
    assert run(spark, []) == [] and run(spark, [("en", "."), (None, None)]) == []


def test_pairs_and_groups_meet_in_buckets(monkeypatch):
    """Packs by bucket, as the shuffles sort them: an occurrence is looked up in one array of its bucket, and comes home in its place."""
    import numpy as np
    import pyarrow as pa

    from assimspark.llm import collocations as c

    monkeypatch.setattr(c, "_first_uid", lambda: 0)
    rng = np.random.default_rng(8)
    groups = rng.choice(1 << 40, 3000, replace=False)
    packs = [c._packs(groups[a:a + 1000], np.arange(a, a + 1000), np.zeros(1000), 64, False, 0) for a in (0, 1000, 2000)]
    want = {}
    for home in range(5):
        row, slots = np.sort(rng.integers(0, c.HOME_ROWS, 4000)), np.tile(np.arange(4000), 1)
        keys = np.where(rng.random(4000) < 0.5, rng.choice(groups, 4000), rng.integers(0, 1 << 40, 4000))
        packs.append(c._packs(keys, slots, row, 64, True, home))
        number = {int(g): i for i, g in enumerate(groups)}
        for r, s, k in zip(row, slots, keys):
            if int(k) in number:
                want.setdefault((home, int(r)), []).append((int(s), number[int(k)]))
    both = pa.Table.from_batches(packs).sort_by([("bucket", "ascending"), ("asked", "ascending")]).combine_chunks()
    assert both.num_rows == 8 * 64
    hits = pa.Table.from_batches(list(c._look_up(both.to_batches(max_chunksize=7)))).sort_by("home").combine_chunks()
    out = list(c._bring_home(hits.to_batches(max_chunksize=9)))
    got, uids = [], []
    for batch in out:
        (slots, starts), (ids, _) = c.flat(batch.column("slots")), c.flat(batch.column("ids"))
        uids += batch.column("uid").to_pylist()
        got += [list(zip(slots[a:b].tolist(), ids[a:b].tolist())) for a, b in zip(starts[:-1], starts[1:])]
    assert got == [want[k] for k in sorted(want)] and len(set(uids)) == len(got) > 400
