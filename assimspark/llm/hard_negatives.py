"""Hard-negative mining with Four-Russians scoring.

Vectors are quantised to integers. Candidates are packed once into bit planes (two's complement, eight dimensions to a byte); an anchor block
has, for each group of eight dimensions, the sums of all 256 subsets of its components. A candidate's byte of a plane looks up the sum of the
dimensions whose bit is set, and the planes are added up by shifting, so every score is the exact integer inner product.

All candidates meet all anchors in cells: a block of at most about ``anchors_in_block`` anchors, and about ``rows_in_cell`` candidates. A cell is a group
of bounded size, and keeps only the best few rows of each anchor. Two passes are made, since a negative is judged by the score of a positive.

Rows with a null id, a null label, a null vector or a null or non-finite component take no part; shorter vectors count as filled with zeros.
A row with the anchor's own id is never its positive or negative. Rows that are repeated all take part: a repeated anchor has its rows
repeatedly, a repeated positive or negative takes several places. Ties go to the smaller id. Anchors without positives, and positives without
negatives in reach, have no rows; an empty table gives none. Other columns are ignored. Tables whose scores might pass 64 bits are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assimspark.llm.common import materialise

#: Dimensions that share a table.
GROUP = 8
CHUNKS = "uid long, n long, planes int, ids binary, labels binary, bits binary"
BEST = "anchor_key long, place int, id long, score long"


def quantised(rows: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """The rows that take part: vec_id, label, q (array of whole numbers, ``scale`` to the unit)."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & (v > F.lit(float("-inf"))) & (v < F.lit(float("inf"))))
    taken = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    return taken.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", "label", whole.alias("q"))


def matrix(lists: pa.Array, multiple: int = GROUP, fill: int = 0) -> np.ndarray:
    """Lists of whole numbers as rows, filled up to a multiple of so many columns."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(sizes), ceil(int(sizes.max(initial=0)) / multiple) * multiple), fill, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def bit_planes(q: np.ndarray) -> np.ndarray:
    """Bytes (plane, group, row): bit j of a byte is the plane's bit of dimension j of the group. The last plane is the sign."""
    least, most = int(q.min(initial=0)), int(q.max(initial=0))
    planes = max((~least).bit_length() if least < 0 else 0, most.bit_length()) + 1
    return np.stack([np.packbits((q >> p & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(planes)])


def subset_sums(q: np.ndarray, dtype: type) -> np.ndarray:
    """Sums (group, subset, anchor) of the components of each subset of a group's dimensions, each made of a smaller one by one addition."""
    groups = q.T.reshape(-1, GROUP, len(q)).astype(dtype)
    out = np.zeros((len(groups), 1 << GROUP, len(q)), dtype)
    for j in range(GROUP):
        out[:, 1 << j:2 << j] = out[:, :1 << j] + groups[:, j, None]
    return out


def score_type(most: int, dims: int, planes: int) -> type:
    """The narrowest type that no partial score leaves."""
    bound = max(dims, 1) * max(most, 1) << planes
    if bound >= 1 << 63:
        raise ValueError("scores might not fit 64 bits")
    return np.int32 if bound < 1 << 31 else np.int64


def look_up(sums: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Scores (row, anchor): for each plane the looked-up sums of all groups, added to twice what the planes above gave."""
    planes, groups, n = bits.shape
    groups = min(groups, len(sums))  # beyond it one side has zeros only
    total, found = np.zeros((n, sums.shape[2]), sums.dtype), np.empty((n, sums.shape[2]), sums.dtype)
    for p in range(planes - 1, -1, -1):
        total <<= 1
        for g in range(groups):
            np.take(sums[g], bits[p, g], axis=0, out=found, mode="clip")
            total += found
        if p == planes - 1:
            np.negative(total, out=total)
    return total


def best_few(where: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Indices of the ``most`` best entries of each ``where``: by score descending, then by id."""
    order = np.lexsort((ids, -score, where))
    at = where[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    return order[rank < most]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 33
    for batch in batches:
        if batch.num_rows:
            bits = bit_planes(matrix(batch.column("q")))
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("vec_id", "label"))
            yield pa.RecordBatch.from_pylist([{"uid": uid, "n": batch.num_rows, "planes": len(bits), "ids": ids, "labels": labels, "bits": bits.tobytes()}], schema=pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("planes", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "bits"))]))
            uid += 1


def _blocks(chunks: pa.Table, rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and bits of at most so many candidates at a time."""
    for c in chunks.select(["planes", "ids", "labels", "bits"]).to_pylist():
        ids, labels = np.frombuffer(c["ids"], np.int64), np.frombuffer(c["labels"], np.int64)
        bits = np.frombuffer(c["bits"], np.uint8).reshape(c["planes"], -1, len(ids))
        for a in range(0, len(ids), rows):
            yield ids[a:a + rows], labels[a:a + rows], bits[:, :, a:a + rows]


class _Tables:
    """Subset sums of a cell's anchors, made once for each type of score."""

    def __init__(self, q: np.ndarray):
        self.q, self.most, self.made = q, max(int(q.max(initial=0)), -int(q.min(initial=0))), {}

    def scores(self, bits: np.ndarray) -> np.ndarray:
        kind = score_type(self.most, min(self.q.shape[1], GROUP * bits.shape[1]), len(bits))
        if kind not in self.made:
            self.made[kind] = subset_sums(self.q, kind)
        return look_up(self.made[kind], np.ascontiguousarray(bits))


class _Best:
    """The best few rows of each (anchor, place), as blocks come in."""

    def __init__(self, most: int):
        self.most, self.held, self.size = most, [], 0

    def add(self, where: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = best_few(where, score, ids, self.most)
        self.held.append(np.stack([where[k], score[k].astype(np.int64), ids[k]]))
        self.size += len(k)
        if self.size > 2_000_000:
            self.reduce()

    def reduce(self) -> np.ndarray:
        all_ = np.concatenate(self.held, axis=1) if self.held else np.zeros((3, 0), np.int64)
        all_ = all_[:, best_few(*all_, self.most)]
        self.held, self.size = [all_], 0
        return all_

    def table(self, keys: np.ndarray, places: int) -> pa.Table:
        where, score, ids = self.reduce()
        return pa.table({"anchor_key": keys[where // places], "place": (where % places).astype(np.int32), "id": ids, "score": score})


def _anchor_columns(anchors: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (*(anchors.column(c).to_numpy() for c in ("anchor_key", "vec_id", "label")), matrix(anchors.column("q")))


def _positives(anchors: pa.Table, chunks: pa.Table, most: int) -> pa.Table:
    keys, own, labels, q = _anchor_columns(anchors)
    best = _Best(most)
    for label in np.unique(labels):
        columns = np.flatnonzero(labels == label)
        tables = _Tables(q[columns])
        for ids, kinds, bits in _blocks(chunks):
            rows = np.flatnonzero(kinds == label)
            if not len(rows):
                continue
            score, ids = tables.scores(bits[:, :, rows]), ids[rows]
            if len(rows) > 4 * most + 1:  # one more, for the anchor's own row
                floor = np.partition(score, len(rows) - most - 1, axis=0)[len(rows) - most - 1]
                r, c = np.nonzero(score >= floor)
            else:
                r, c = np.nonzero(np.ones(score.shape, bool))
            other = ids[r] != own[columns][c]
            r, c = r[other], c[other]
            best.add(columns[c], score[r, c], ids[r])
    return best.table(keys, 1)


def _negatives(anchors: pa.Table, chunks: pa.Table, most: int, low: int, high: int) -> pa.Table:
    keys, own, labels, q = _anchor_columns(anchors)
    goals = matrix(anchors.column("goals"), 1, -1)  # scores of the positives; -1 where there is none
    places = goals.shape[1]
    least, top = -(-low * goals // high), goals
    asked = goals >= 0
    floor, ceiling = np.where(asked, least, 1 << 62).min(axis=1, initial=1 << 62), np.where(asked, top, -1).max(axis=1, initial=-1)
    best, tables = _Best(most), _Tables(q)
    for ids, kinds, bits in _blocks(chunks):
        score = tables.scores(bits)
        edge = np.iinfo(score.dtype).max
        r, c = np.nonzero((score >= np.minimum(floor, edge).astype(score.dtype)) & (score <= np.minimum(ceiling, edge).astype(score.dtype)) & (kinds[:, None] != labels))
        other = (ids[r] != own[c]) & (ceiling[c] >= 0)
        r, c = r[other], c[other]
        found, ids = score[r, c].astype(np.int64), ids[r]
        for p in range(places):
            fits = asked[c, p] & (found >= least[c, p]) & (found <= top[c, p])
            if fits.any():
                best.add(c[fits] * places + p, found[fits], ids[fits])
    return best.table(keys, places)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, anchors_in_block: int = 1024, rows_in_cell: int = 32768) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label, q as ``quantised`` gives them. Each anchor's positives are its ``positives`` best other rows of its label; each positive
    has the ``negatives`` best rows of other labels with low * positive_score <= high * negative_score <= high * positive_score.
    """
    if not 0 <= low <= high or high < 1 or positives < 1 or negatives < 1:
        raise ValueError("0 <= low <= high, and at least one positive and negative")
    spark = rows.sparkSession
    chunks = materialise(rows.mapInArrow(_chunks, CHUNKS), "negatives-chunks")
    held = materialise(rows.where(anchors).withColumn("anchor_key", F.monotonically_increasing_id()), "negatives-anchors")
    n_rows, n_anchors = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], held.count()
    blocks = max(1, ceil(n_anchors / anchors_in_block))
    enough = ceil(4 * spark.sparkContext.defaultParallelism / blocks)  # cells keep all cores busy, if there are rows for it
    salts = max(1, ceil(n_rows / rows_in_cell), min(enough, ceil(n_rows / 1024)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = chunks.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int")).withColumn("block", every(blocks))
    held = held.withColumn("block", F.pmod("anchor_key", F.lit(blocks)).cast("int"))

    def met(side: DataFrame, f) -> DataFrame:  # noqa: ANN001
        cells = side.withColumn("salt", every(salts)).groupBy("block", "salt").cogroup(dealt.groupBy("block", "salt"))
        return cells.applyInArrow(lambda left, right: f(left, right) if left.num_rows and right.num_rows else _Best(1).table(np.zeros(0, np.int64), 1), BEST)

    best_of = Window.partitionBy("anchor_key").orderBy(F.desc("score"), "id")
    top = met(held, lambda a, c: _positives(a, c, positives)).withColumn("rank", F.row_number().over(best_of)).where(F.col("rank") <= positives)
    goals = top.groupBy("anchor_key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))  # at most ``positives`` each
    judged = materialise(held.join(goals, "anchor_key"), "negatives-positives")
    asked = judged.withColumn("goals", F.transform("positives", lambda p: F.when(p["score"] >= 0, p["score"]).otherwise(F.lit(-1)))).drop("positives")
    per_pair = Window.partitionBy("anchor_key", "place").orderBy(F.desc("score"), "id")
    found = met(asked, lambda a, c: _negatives(a, c, negatives, low, high)).withColumn("rank", F.row_number().over(per_pair)).where(F.col("rank") <= negatives)
    pair = F.get("positives", F.col("place"))
    return found.join(judged.select("anchor_key", "vec_id", "positives"), "anchor_key").select(
        F.col("vec_id").alias("anchor_id"), pair["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"), pair["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
