"""Packing by cutting-stock column generation.

Documents become ids closed by ``end_id``. Every full ``seq_len`` ids are a sequence of their own; the remainders (1 to seq_len - 1 ids) are the
items of a cutting-stock problem. Its linear program sees only the histogram of remainder lengths (at most seq_len - 1 numbers, whatever
the size of the corpus): a restricted master over patterns is solved by revised simplex from first-fit patterns, an unbounded knapsack by
dynamic programming prices new patterns, the solution is rounded down, and first fit makes whole patterns of what rounding leaves. Items
are ranked within their length, so the slot of an item - pattern, copy, offset - follows from its rank by arithmetic, in parallel. Items
of patterns that would waste more than ``most_waste`` ids form one virtual stream that is cut every ``seq_len`` ids; its tail is cut at
powers of two. So nothing is padded but what a pattern wastes.

A null text is an empty document (its end id alone); repeated rows are documents of their own; an empty table gives no pieces; other
columns are ignored. doc_id may be null and is carried along.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assimspark.llm.common import new_folder, small_batches
from assimspark.llm.tokens import crc32_of, encoder, tokenizer_path

#: Rows of 32 bytes that are broadcast at most.
MOST_BROADCAST_ROWS = 500_000
TOKENS = "doc_id long, part int, place long, n_tokens long, rest int, rank_in_part long, full_before long, ids binary"


def tokenise(docs: DataFrame, end_id: int = 0, seq_len: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """The ids of each document, and where its remainder and its full chunks stand within the task that made them; written to the shared folder."""
    path = tokenizer or tokenizer_path()
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids_of, place, full = TaskContext.get().partitionId(), encoder(path), 0, 0
        end, width = np.array([end_id], ids_of.dtype).tobytes(), ids_of.dtype.itemsize
        seen = [0] * seq_len
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                raw = ids_of.encode(text.as_py() or "") + end
                n = len(raw) // width
                rest = n % seq_len
                rows.append((part, place, n, rest, seen[rest], full, raw))
                seen[rest] += 1
                place += 1
                full += n // seq_len
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "part", "place", "n_tokens", "rest", "rank_in_part", "full_before", "ids"])

    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "packing-tokens")
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, TOKENS).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(TOKENS).parquet(folder)


def _knapsack(value: np.ndarray, lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the most that c ids are worth; pick[c]: index of the length that reaches it, -1 where one id less is worth as much."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    n_fit = np.searchsorted(lengths, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := n_fit[c]:
            got = best[c - lengths[:k]] + value[:k]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], pick[c] = got[j], j
    return best, pick


def _pattern(pick: np.ndarray, lengths: np.ndarray, first: int, room: int) -> np.ndarray:
    """Copies of each length in the best pattern that holds length ``first``."""
    counts = np.zeros(len(lengths))
    counts[first] = 1
    room -= int(lengths[first])
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            counts[pick[room]] += 1
            room -= int(lengths[pick[room]])
    return counts


def first_fit(lengths: np.ndarray, need: np.ndarray, room: int, whole: bool) -> list[tuple[dict[int, int], float, list[int]]]:
    """Patterns of the longest lengths that fit, each used until one of its lengths runs out: (index -> copies, times, lengths run out).

    With ``whole`` times are whole numbers (a length may then run out only in a later pattern with fewer copies).
    """
    left, out = need.astype(float).tolist(), []
    active = [j for j in range(len(lengths)) if left[j] > 0]
    while active:
        sizes = [int(lengths[j]) for j in active]
        counts, space, k = {}, room, len(active)
        while k and (k := bisect.bisect_right(sizes, space, 0, k)):
            copies = min(space // sizes[k - 1], ceil(left[active[k - 1]]))
            counts[active[k - 1]] = copies
            space -= copies * sizes[k - 1]
            k -= 1
        times = min(left[j] / n for j, n in counts.items())
        times = float(int(times + 1e-9)) if whole else times
        for j, n in counts.items():
            left[j] = left[j] - times * n if left[j] - times * n > 1e-9 else 0.0
        out.append((counts, times, [j for j in counts if not left[j]]))
        active = [j for j in active if left[j]]
    return out


def column_generation(histogram: dict[int, int], room: int, gap: float = 1e-3, most_rounds: int = 120, at_once: int = 16) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies) and how often each is used.

    The master keeps an explicit basis inverse and starts from first-fit patterns, whose matrix is triangular. Each knapsack prices the best
    pattern around every length; the ``at_once`` best of them enter in turn. It stops when Farley's bound proves the solution within ``gap``
    of the optimum, or after ``most_rounds`` knapsacks; either way the solution is feasible. It is rounded down, and first fit makes whole
    patterns of what that leaves, so all items are in patterns.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0 and 0 < k < room))
    m = len(lengths)
    if not m:
        return []
    need = np.array([histogram[int(k)] for k in lengths], float)
    basis = np.zeros((m, m))
    for counts, _, over in first_fit(lengths, need, room, whole=False):
        basis[list(counts), over[0]] = list(counts.values())
        for j in over[1:]:  # ran out at the same time: a pattern of its own, not used yet
            basis[j, j] = room // lengths[j]
    inverse = np.linalg.inv(basis)
    x = np.maximum(inverse @ need, 0)
    for turn in range(most_rounds):
        prices = np.maximum(inverse.sum(axis=0), 0)
        best, pick = _knapsack(prices, lengths, room)
        if best[room] <= 1 + 1e-9 or x.sum() <= (1 + gap) * (prices @ need) / best[room]:
            break
        for j in np.argsort(-(prices + best[room - lengths]), kind="stable")[:at_once]:
            column = _pattern(pick, lengths, int(j), room)
            d = inverse @ column
            if d.sum() <= 1 + 1e-9:  # no longer of use at the prices that the last pivot left
                continue
            ratio = np.full(m, np.inf)
            np.divide(x, d, out=ratio, where=d > 1e-6)
            ties = np.flatnonzero(ratio <= ratio.min() + 1e-9)
            out = int(ties[d[ties].argmax()])
            if not np.isfinite(ratio[out]):
                continue
            basis[:, out] = column
            step = ratio[out]
            x = np.maximum(x - step * d, 0)
            x[out] = step
            row = inverse[out] / d[out]
            inverse -= np.outer(d, row)
            inverse[out] = row
        if turn % 16 == 15:  # rounding errors don't pile up
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ need, 0)
    left, patterns = need.astype(int), []
    for j in np.argsort(-x, kind="stable"):
        counts = basis[:, j].astype(int)
        used = np.flatnonzero(counts)
        times = min(int(x[j] + 1e-9), *(left[used] // counts[used]).tolist())
        if times > 0:
            left[used] -= times * counts[used]
            patterns.append(({int(lengths[k]): int(counts[k]) for k in used}, times))
    rest = first_fit(lengths, left, room, whole=True)
    return patterns + [({int(lengths[k]): n for k, n in counts.items()}, int(times)) for counts, times, _ in rest if times > 0]


def _powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def usable_patterns(histogram: dict[int, int], seq_len: int, most_waste: int) -> list[tuple[dict[int, int], int]]:
    """The patterns that leave at most ``most_waste`` ids of a sequence unused."""
    return [(p, t) for p, t in column_generation(histogram, seq_len) if seq_len - sum(k * c for k, c in p.items()) <= most_waste]


def pack(docs: DataFrame, end_id: int = 0, seq_len: int = 1024, tokenizer: str | None = None, most_waste: int = 8) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian bytes), doc_tokens, sequence_id, offset.

    Patterns that leave more than ``most_waste`` ids of a sequence unused are not applied; their items go to the stream, which wastes none.
    """
    spark = docs.sparkSession
    tokens = tokenise(docs, end_id, seq_len, tokenizer)
    lengths = tokens.groupBy("rest").agg(F.count("*").alias("n"), F.sum(F.expr(f"n_tokens div {seq_len}")).alias("full")).collect()  # at most seq_len rows
    histogram, n_full = {r["rest"]: r["n"] for r in lengths}, sum(r["full"] for r in lengths)
    patterns = usable_patterns(histogram, seq_len, most_waste)

    slots, covered, sequence = [], dict.fromkeys(histogram, 0), n_full
    for pattern, times in patterns:
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            slots.append((length, covered[length], covered[length] + times * copies, copies, offset, sequence))
            covered[length] += times * copies
            offset += copies * length
        sequence += times
    stream_at, stream_from, at = [], sequence, 0
    for length in sorted(histogram):
        if length:
            stream_at.append((length, covered[length], at))
            at += (histogram[length] - covered[length]) * length
    floor = at // seq_len * seq_len
    edges = [floor + sum(_powers(at - floor)[:k]) for k in range(len(_powers(at - floor)))]  # starts of the tail's sequences

    # Both tables have at most a few rows for each length under seq_len, whatever the corpus holds.
    slot = F.broadcast(spark.createDataFrame(slots, "rest int, slot_lo long, slot_hi long, copies long, slot_offset long, slot_sequence long"))
    stream = F.broadcast(spark.createDataFrame(stream_at, "rest int, stream_lo long, stream_at long"))

    by_part = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = tokens.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.expr(f"n_tokens div {seq_len}")).alias("full"))
    rank_base = base.select("part", "rest", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("rank_base"))
    fulls = base.groupBy("part").agg(F.sum("full").alias("full"))
    full_base = fulls.select("part", F.coalesce(F.sum("full").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_base"))
    bases = rank_base.join(full_base, "part")

    # Two numbers for each task and length: where these are few they go to the ids, else the ids are joined by (part, rest).
    bases = F.broadcast(bases) if base.count() <= MOST_BROADCAST_ROWS else bases
    ranked = tokens.join(bases, ["part", "rest"]).withColumn("rank", F.col("rank_base") + F.col("rank_in_part"))
    placed = ranked.join(slot, (ranked["rest"] == slot["rest"]) & F.col("rank").between(F.col("slot_lo"), F.col("slot_hi") - 1), "left").drop(slot["rest"])
    placed = placed.join(stream, "rest", "left")

    n_chunks = F.expr(f"n_tokens div {seq_len}")
    piece = lambda start, length, seq, offset: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), seq.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
    zero, rest = F.lit(0), F.col("rest").cast("long")
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(n_chunks, F.lit(1))), lambda k: piece((k - 1) * seq_len, F.lit(seq_len), F.col("full_base") + F.col("full_before") + k - 1, zero))
    chunks = F.when(n_chunks > 0, chunks).otherwise(F.slice(chunks, 1, 0))
    k = F.col("rank") - F.col("slot_lo")
    in_slot = F.array(piece(n_chunks * seq_len, rest, F.col("slot_sequence") + F.floor(k / F.col("copies")), F.col("slot_offset") + k % F.col("copies") * rest))
    from_ = F.col("stream_at") + (F.col("rank") - F.col("stream_lo")) * rest
    next_edge = F.expr(f"cast(floor((stream_at + (rank - stream_lo) * rest) / {seq_len}) + 1 as bigint) * {seq_len}")
    inner = F.filter(F.array(next_edge, *(F.lit(e).cast("long") for e in edges)), lambda e: (e > from_) & (e < from_ + rest) & (e <= max([floor, *edges])))
    starts = F.array_sort(F.array_distinct(F.concat(F.array(from_), inner)))
    placed = placed.withColumn("starts", F.when(F.col("rest") > 0, starts))
    tail = F.array(*(F.lit(e).cast("long") for e in edges)) if edges else F.array().cast("array<long>")
    in_tail = lambda s: F.size(F.filter(tail, lambda e: e <= s))
    cut = F.transform(
        "starts",
        lambda s, j: piece(
            n_chunks * seq_len + s - from_,
            F.coalesce(F.get("starts", j + 1), from_ + rest) - s,
            F.when(s < floor, stream_from + F.floor(s / seq_len)).otherwise(stream_from + floor // seq_len - 1 + in_tail(s)),
            F.when(s < floor, s % seq_len).otherwise(s - F.coalesce(F.array_max(F.filter(tail, lambda e: e <= s)), F.lit(0))),
        ),
    )
    last = F.when(F.col("rest") == 0, F.slice(in_slot, 1, 0)).when(F.col("slot_lo").isNotNull(), in_slot).otherwise(cut)
    rows = placed.select("doc_id", "n_tokens", "ids", F.concat(chunks, last).alias("pieces"))

    def cut_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start", "length", "sequence_id", "offset"]
        for batch in batches:
            docs_, sizes, ids = (batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids"))
            lists = batch.column("pieces")
            owner = np.repeat(np.arange(len(docs_)), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            values = {n: flat.field(n) for n in names}
            raw = [ids[o][s * (w := len(ids[o]) // sizes[o]):(s + n) * w] for o, s, n in zip(owner.tolist(), values["start"].to_pylist(), values["length"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([docs_[o] for o in owner], pa.int64()), values["start"], values["length"], pa.array(raw, pa.binary()), pa.array(np.asarray(sizes, dtype=np.int64)[owner]), values["sequence_id"], values["offset"]], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return rows.mapInArrow(cut_ids, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def with_checksum(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids as 32-bit words in place of the ids."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [crc32_of(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")) for raw, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length")), pa.array(sums, pa.int64()), *(batch.column(c) for c in ("doc_tokens", "sequence_id", "offset"))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces.mapInArrow(add, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: at most seq_len pieces meet in one group, so a group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"], x["offset"], x["length"])).alias("documents"),
    )
