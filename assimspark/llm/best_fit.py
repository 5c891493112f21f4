"""Best-fit packing by bin completion with branch and bound.

Documents become ids closed by ``end_id``. One longer than ``seq_len`` is cut into pieces of ``seq_len``, of which the first may be shorter; no other is
cut. Full pieces are sequences of their own. The rest is a bin-packing problem that depends on the histogram of lengths alone (fewer than
seq_len numbers, whatever the size of the corpus), so it is searched on the driver: each step fills bins around the largest length left. Its
fillings are multisets of smaller lengths, found through the sums that lengths can reach; dominated ones (with room for one more item, or
whose items fit into those of another filling) are left out. A filling is applied as often as the counts allow, and once when the search comes
back to it. A branch ends where its bins and the waste bound of what is left reach the best solution, which best fit gives at the start and at
later steps. Documents are ranked within their length, so where one stands follows from its rank by arithmetic, in parallel.

The search stops at ``most_nodes`` steps and after ``width`` fillings of a step, and then has the best solution so far; the work on documents
and the result's being whole don't depend on them.

A null text is an empty document (its end id alone); repeated rows are documents of their own; an empty table gives no pieces; very long texts
are cut as above; equal lengths are ranked in the order in which they are read; other columns are ignored. doc_id may be null and is carried along.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assimspark.llm.packing import MOST_BROADCAST_ROWS, tokenise

Filling = tuple[tuple[int, int], ...]
Plan = list[tuple[dict[int, int], int]]


def best_fit(counts: list[int], room: int) -> Plan:
    """Best-fit decreasing over a histogram (counts[length]): bins as (length -> copies, times). Equal bins are filled side by side."""
    rooms: list[int] = []  # sorted, of the open bins
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    full: Plan = []

    def put(space: int, bin_: dict[int, int], times: int) -> None:
        if not space:
            full.append((bin_, times))
            return
        if space not in open_:
            bisect.insort(rooms, space)
            open_[space] = []
        open_[space].append((bin_, times))

    for length in range(len(counts) - 1, 0, -1):
        n = counts[length]
        while n:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                space, bin_, times = room, {}, n
            else:
                space = rooms[k]
                bin_, times = open_[space].pop()
                if not open_[space]:
                    del open_[space], rooms[k]
            copies = min(space // length, n)
            used = min(times, n // copies)
            put(space - copies * length, {**bin_, length: copies}, used)
            n -= used * copies
            if bin_ and used < times:
                put(space, bin_, times - used)
    return full + [b for space in rooms for b in open_[space]]


def bins_at_least(counts: list[int], room: int) -> int:
    """The waste bound: for each threshold, lengths over room - threshold stand alone, and those from the threshold to half fill what the others leave."""
    c = np.array(counts[:room + 1] + [0] * (room + 1 - len(counts)), np.int64)
    size = c * np.arange(room + 1)
    n_to, size_to = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(size)))
    t = np.arange(room // 2 + 1)
    half = room // 2
    alone = n_to[-1] - n_to[room - t + 1]
    big, big_size = n_to[room - t + 1] - n_to[half + 1], size_to[room - t + 1] - size_to[half + 1]
    small = size_to[half + 1] - size_to[t]
    return int((alone + big + np.maximum(0, -(-(small - (big * room - big_size)) // room))).max(initial=0))


def _fits(items: list[int], bins: list[int]) -> bool:
    """Whether the items (longest first) fit into the bins."""
    if not items:
        return True
    for i in range(len(bins)):
        if items[0] <= bins[i] and bins[i] not in bins[:i] and _fits(items[1:], [*bins[:i], bins[i] - items[0], *bins[i + 1:]]):
            return True
    return False


def _spread(filling: Filling) -> list[int]:
    return [length for length, copies in filling for _ in range(copies)]


def fillings(left: list[int], room: int, slack: int, width: int) -> tuple[list[Filling], bool]:
    """Undominated fillings of ``room`` that waste at most ``slack``, least waste and longest items first; and whether these are all."""
    if room < len(left) and room and left[room]:
        return [((room, 1),)], True  # all others fit into this one item
    lengths = [k for k in range(1, min(room, len(left) - 1) + 1) if left[k]]
    if not lengths:
        return ([()] if room <= slack else []), True
    reach, mask = [1], (1 << room + 1) - 1  # reach[i]: bit s is set if the first i lengths can add up to s
    for k in lengths:
        r, copies, step = reach[-1], min(left[k], room // k), 1
        while copies:
            n = min(step, copies)
            r |= r << n * k & mask
            copies, step = copies - n, 2 * step
        reach.append(r)

    def sums(i: int, total: int) -> Iterator[Filling]:
        if not total:
            yield ()
        for j in range(bisect.bisect_right(lengths, total, 0, i), 0, -1) if total else ():
            if not reach[j] >> total & 1:
                return
            k = lengths[j - 1]
            for n in range(min(left[k], total // k), 0, -1):
                if reach[j - 1] >> total - n * k & 1:
                    for rest in sums(j - 1, total - n * k):
                        yield ((k, n), *rest)

    found: list[Filling] = []
    for total in range(room, max(room - slack, 1) - 1, -1):
        if reach[-1] >> total & 1:
            for f in islice(sums(len(lengths), total), 4 * width):
                used = dict(f)
                if any(left[k] > used.get(k, 0) for k in lengths[:bisect.bisect_right(lengths, room - total)]):
                    continue  # one more item fits
                items = _spread(f)
                if len(items) <= 8 and any(_fits(items, other) for other in map(_spread, found) if len(other) <= len(items)):
                    continue
                found.append(f)
                if len(found) == width:
                    return found, False
    return found, True


def complete_bins(counts: list[int], room: int, most_nodes: int = 4000, width: int = 6, refresh: int = 16) -> tuple[Plan, bool]:
    """Bins as (length -> copies, times), and whether no fewer bins can do."""
    left, best = list(counts), best_fit(counts, room)
    fewest, bound = sum(t for _, t in best), bins_at_least(counts, room)
    total, nodes, whole = sum(k * n for k, n in enumerate(counts)), 0, True
    path: list[tuple[dict[int, int], int]] = []
    bins = waste = 0
    stack: list[Iterator[tuple[dict[int, int], int, int]]] = []

    def children() -> Iterator[tuple[dict[int, int], int, int]]:
        nonlocal whole
        longest = next((k for k in range(min(len(left) - 1, room), 0, -1) if left[k]), 0)
        if not longest:
            return
        left[longest] -= 1
        found, all_ = fillings(left, room - longest, (fewest - 1) * room - total - waste, width)
        left[longest] += 1
        whole &= all_
        for f in found:
            bin_ = {longest: 1}
            for k, n in f:
                bin_[k] = bin_.get(k, 0) + n
            most = min(left[k] // n for k, n in bin_.items())
            unused = room - sum(k * n for k, n in bin_.items())
            yield bin_, most, unused
            if most > 1 and not (len(found) == 1 and all_):
                yield bin_, 1, unused

    def apply(bin_: dict[int, int], times: int) -> None:
        for k, n in bin_.items():
            left[k] -= n * times

    stack.append(children())
    while stack and fewest > bound:
        if nodes >= most_nodes:
            whole = False
            break
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                bin_, times = path.pop()
                apply(bin_, -times)
                bins -= times
                waste -= times * (room - sum(k * n for k, n in bin_.items()))
            continue
        bin_, times, unused = step
        nodes += 1
        if waste + times * unused > (fewest - 1) * room - total:
            continue
        apply(bin_, times)
        path.append((bin_, times))
        bins += times
        waste += times * unused
        rest = bins_at_least(left, room)
        if not rest and bins < fewest:
            best, fewest = list(path), bins
        elif bins + rest < fewest and nodes % refresh == 1:
            more = best_fit(left, room)
            if bins + sum(t for _, t in more) < fewest:
                best, fewest = path + more, bins + sum(t for _, t in more)
        stack.append(children() if bins + rest < fewest else iter(()))
    return best, whole or fewest == bound


def slots_of(plan: Plan, first_sequence: int) -> np.ndarray:
    """Rows (length, first rank, copies, offset, first sequence), by length and rank: items of a length from that rank on stand there."""
    rows, seen, sequence = [], {}, first_sequence
    for bin_, times in plan:
        offset = 0
        for length, copies in sorted(bin_.items(), reverse=True):
            rows.append((length, seen.get(length, 0), copies, offset, sequence))
            seen[length] = seen.get(length, 0) + times * copies
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_best_fit(docs: DataFrame, end_id: int = 2, seq_len: int = 1024, tokenizer: str | None = None, most_nodes: int = 4000, digest: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids (little-endian bytes; with ``digest`` ids_crc32 in their place), sequence_id, offset."""
    spark = docs.sparkSession
    tokens = tokenise(docs, end_id, seq_len, tokenizer)
    base = tokens.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.expr(f"n_tokens div {seq_len}")).alias("full"))
    histogram = base.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("full").alias("full"), F.count("*").alias("parts")).collect()  # at most seq_len rows
    counts = [0] * max(seq_len, 2)
    for r in histogram:
        counts[r["rest"]] = r["n"] if r["rest"] else 0
    plan, _ = complete_bins(counts, seq_len, most_nodes)
    slots = slots_of(plan, sum(r["full"] for r in histogram))

    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = base.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_base"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that encoded
    fulls = base.groupBy("part").agg(F.sum("full").alias("full")).select("part", F.coalesce(F.sum("full").over(earlier), F.lit(0)).alias("full_base"))
    bases = ranks.join(fulls, "part")
    bases = F.broadcast(bases) if sum(r["parts"] for r in histogram) <= MOST_BROADCAST_ROWS else bases
    placed = tokens.join(bases, ["part", "rest"]).select("doc_id", "n_tokens", "rest", (F.col("rank_base") + F.col("rank_in_part")).alias("rank"), (F.col("full_base") + F.col("full_before")).alias("full"), "ids")
    slot_keys = slots[:, 0] << 48 | slots[:, 1]  # a few rows for each length under seq_len and bin, whatever the corpus holds

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            n, rest, rank, full = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_tokens", "rest", "rank", "full"))
            raw = batch.column("ids").to_pylist()
            pieces = n // seq_len + (rest > 0)
            owner = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            short = (piece == 0) & (rest[owner] > 0)
            whole_before = piece - (rest[owner] > 0)
            start = np.where(short, 0, rest[owner] + whole_before * seq_len)
            length = np.where(short, rest[owner], seq_len)
            sequence, offset = full[owner] + whole_before, np.zeros(len(owner), np.int64)
            who = owner[short]
            at = slots[np.searchsorted(slot_keys, rest[who] << 48 | rank[who], side="right") - 1]
            k = rank[who] - at[:, 1]
            sequence[short], offset[short] = at[:, 4] + k // at[:, 2], at[:, 3] + k % at[:, 2] * rest[who]
            cuts = [(raw[o], s, m, len(raw[o]) // int(n[o])) for o, s, m in zip(owner.tolist(), start.tolist(), length.tolist())]
            if digest:
                ids = pa.array([zlib.crc32(np.frombuffer(r, f"<u{w}", m, s * w).astype("<u4").tobytes()) for r, s, m, w in cuts], pa.int64())
            else:
                ids = pa.array([r[s * w:(s + m) * w] for r, s, m, w in cuts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), ids, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32" if digest else "ids", "sequence_id", "offset"],
            )

    kind = "ids_crc32 long" if digest else "ids binary"
    return placed.mapInArrow(cut, f"doc_id long, piece int, start long, length long, {kind}, sequence_id long, offset long")
