import functools
import random

import numpy as np
import pytest

from assimspark.llm.best_fit import best_fit, bins_at_least, complete_bins, fillings, pack_best_fit, slots_of
from assimspark.llm.packing import packed_sequences
from tests.llm.test_tokens import TEXTS, crc, frame, ids_of


def histogram(items, room):
    counts = [0] * (room + 1)
    for k in items:
        counts[k] += 1
    return counts


def fewest_bins(items, room):
    """The optimum, over all ways to fill the bin of the longest item."""

    @functools.cache
    def least(left):
        if not left:
            return 0
        first, rest, best, seen = left[0], left[1:], len(left), set()
        for mask in range(1 << len(rest)):
            inside = tuple(x for i, x in enumerate(rest) if mask >> i & 1)
            if first + sum(inside) <= room and inside not in seen:
                seen.add(inside)
                best = min(best, 1 + least(tuple(x for i, x in enumerate(rest) if not mask >> i & 1)))
        return best

    return least(tuple(sorted(items, reverse=True)))


def check_plan(plan, counts, room):
    used = [0] * len(counts)
    for bin_, times in plan:
        assert times > 0 and 0 < sum(k * n for k, n in bin_.items()) <= room
        for k, n in bin_.items():
            used[k] += n * times
    assert used == counts
    return sum(t for _, t in plan)


def plain_best_fit(items, room):
    spaces = []
    for k in sorted(items, reverse=True):
        fit = min((s for s in spaces if s >= k), default=None)
        if fit is None:
            spaces.append(room - k)
        else:
            spaces[spaces.index(fit)] -= k
    return len(spaces)


def test_search_reaches_the_optimum_where_best_fit_does_not():
    rng, mended = random.Random(8), 0
    for _ in range(400):
        room = rng.choice((20, 30, 50))
        items = [rng.randint(room // 6, room // 2 + 2) for _ in range(rng.randint(1, 9))]
        counts = histogram(items, room)
        first = check_plan(best_fit(counts, room), counts, room)
        plan, proved = complete_bins(counts, room, width=1000)
        want = fewest_bins(items, room)
        assert first == plain_best_fit(items, room) and check_plan(plan, counts, room) == want and proved
        assert bins_at_least(counts, room) <= want
        mended += first > want
    assert mended >= 3


def test_search_beats_best_fit_on_many_equal_items():
    counts = histogram([6] * 600 + [5] * 600 + [4] * 600, 15)  # best fit begins with 6 + 6, but 6 + 5 + 4 leaves nothing
    assert check_plan(best_fit(counts, 15), counts, 15) > 600
    plan, proved = complete_bins(counts, 15)
    assert check_plan(plan, counts, 15) == 600 and proved


def test_many_random_lengths_come_near_the_bound():
    rng = np.random.default_rng(4)
    for room, items in ((1024, rng.integers(300, 700, 3000)), (1024, np.minimum(1023, rng.lognormal(5, 1, 20000).astype(int) + 1)), (100, rng.integers(20, 60, 5000))):
        counts = histogram(items.tolist(), room)
        plan, _ = complete_bins(counts, room, most_nodes=600)
        n = check_plan(plan, counts, room)
        assert n <= check_plan(best_fit(counts, room), counts, room) and n <= 1.02 * bins_at_least(counts, room) + 1
        assert len(slots_of(plan, 0)) < 20_000


def test_fillings_are_undominated():
    left = histogram([7, 5, 5, 4, 3, 3, 2], 10)
    assert fillings(left, 7, 9, 100) == ([((7, 1),)], True)
    found, whole = fillings(left, 9, 9, 100)
    assert whole and found[0] == ((7, 1), (2, 1)) and all(sum(k * n for k, n in f) <= 9 for f in found)
    assert ((4, 1), (3, 1), (2, 1)) not in found and ((5, 1), (2, 1)) not in found  # fit into (5, 4) and (7, 2)
    assert fillings(histogram([], 10), 4, 3, 9) == ([], True) and fillings(histogram([], 10), 4, 4, 9) == ([()], True)


def check_pieces(rows, want, seq_len):
    """Each id once, in order; only longer documents are cut, into full pieces after the first; sequences are gapless. Gives their number."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == want.keys()
    for d, ids in want.items():
        at = 0
        for i, r in enumerate(sorted(by_doc[d], key=lambda r: r["piece"])):
            assert r["piece"] == i and r["start"] == at and r["ids_crc32"] == crc(ids[at:at + r["length"]]) and (r["length"] == seq_len or i == 0)
            at += r["length"]
        assert at == len(ids) and len(by_doc[d]) == -(-len(ids) // seq_len)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= seq_len
    return len(by_seq)


@pytest.mark.parametrize("seq_len", [1024, 64, 8])
def test_each_id_stands_once(spark, seq_len):
    want = {i: [*ids_of(t), 2] for i, t in enumerate(TEXTS)}
    n = check_pieces(pack_best_fit(frame(spark), seq_len=seq_len, digest=True).collect(), want, seq_len)
    counts = histogram([len(i) % seq_len for i in want.values() if len(i) % seq_len], seq_len)
    assert n == sum(len(i) // seq_len for i in want.values()) + sum(t for _, t in complete_bins(counts, seq_len)[0])


def test_many_equal_lengths_and_no_rows(spark):
    docs = spark.createDataFrame([(i, "a " * (i % 5 * 7 + 3)) for i in range(400)], "doc_id long, text string").repartition(4)
    want = {i: [*ids_of("a " * (i % 5 * 7 + 3)), 2] for i in range(400)}
    n = check_pieces(pack_best_fit(docs, seq_len=64, digest=True).collect(), want, 64)
    assert n <= 1.02 * sum(map(len, want.values())) / 64 + 1
    assert pack_best_fit(docs.where("doc_id < 0")).count() == 0


def test_ids_and_repeated_and_null_doc_ids(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (7, "a b", 1), (7, "a b", 1), (8, None, 1)], "doc_id long, text string, rank int")
    pieces = pack_best_fit(docs, seq_len=8)
    assert sorted((r["doc_id"] or 0, r["length"]) for r in pieces.collect()) == [(0, 3), (7, 3), (7, 3), (8, 1)]
    assert sorted(len(r["ids"]) for r in packed_sequences(pieces).collect()) == [2 * 3, 2 * 7] or sum(len(r["ids"]) for r in packed_sequences(pieces).collect()) == 20
