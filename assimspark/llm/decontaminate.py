"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to k = floor(error_rate * m) edits. Cut into k + 1 pieces, at least one piece
of such an occurrence is untouched, so an automaton over all pieces finds every candidate in one pass over a text; Myers' bit-parallel
distance then checks the item against the text around each hit. Texts are compared as lower-case words (letters and digits) with one space
between and around them, so case, punctuation and line breaks don't count as edits.

The items are the query set: they are taken in blocks of at most ``block_chars`` characters, each block is broadcast and meets all rows.
Documents are only scanned, never shuffled. Null texts and texts or items without a word match nothing; a null item_id or doc_id is
carried; repeated documents are rows of their own; of items that share an id the best match counts; empty tables give no rows; other
columns are ignored by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assimspark.llm.common import small_batches

GAP = re.compile(r"[\W_]+")
RUN = re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    """Lower-case words with a space before, between and after; empty for a text without words."""
    words = GAP.sub(" ", text).strip(" ").lower()
    return f" {words} " if words else ""


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """The smallest distance of the pattern to any part of the text, and where that part ends; None above ``most``."""
    m, top = len(pattern), 1 << (len(pattern) - 1)
    full = (1 << m) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        grow = down | (full & ~(across | up))
        fall = up & across
        if grow & top:
            score += 1
        elif fall & top:
            score -= 1
        grow, fall = (grow << 1) & full, (fall << 1) & full
        eq |= down
        up = fall | (full & ~(eq | grow))
        down = grow & eq
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """All items of a block behind one automaton."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float):
        import ahocorasick

        self.items, pieces = [], {}
        for key, text in items:
            if not (plain := normalise(text or "")):
                continue
            k = int(error_rate * len(plain))
            n = len(self.items)
            self.items.append((key, plain, k))
            for i in range(k + 1):
                a, b = i * len(plain) // (k + 1), (i + 1) * len(plain) // (k + 1)
                pieces.setdefault(plain[a:b], []).append((n, a, b))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, where)
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int, int]]:
        """(item_id, distance, start, end, edits allowed) of the best occurrence of each item; places are those of the original text."""
        if not text or not self.items or not (plain := normalise(text)):
            return []
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, where in self.automaton.iter(plain):
            for n, a, b in where:
                begin = end + 1 - (b - a) - a  # where the item would start without edits
                if (n, begin) in tried or n in best and best[n][0] == 0:
                    continue
                tried.add((n, begin))
                _, item, k = self.items[n]
                lo, hi = max(0, begin - k), begin + len(item) + k
                if begin >= 0 and plain.startswith(item, begin):
                    best[n] = (0, begin, begin + len(item))
                elif k and (got := myers(item, plain[lo:hi], k)) and (n not in best or got[0] < best[n][0]):
                    stop = lo + got[1]
                    back = myers(item[::-1], plain[max(0, stop - len(item) - k):stop][::-1], k)
                    best[n] = (got[0], stop - (back[1] if back else len(item)), stop)
        if not best:
            return []
        runs = [m.span() for m in RUN.finditer(text)]
        out: dict = {}
        for n, (distance, a, b) in best.items():
            first = plain.count(" ", 0, a + 1) - (plain[a] != " ")
            last = plain.count(" ", 0, b) - (plain[b - 1] == " ") - 1
            first, last = min(max(first - (plain[a] == " "), 0), len(runs) - 1), min(max(last, 0), len(runs) - 1)
            row = (self.items[n][0], distance, runs[first][0], runs[max(first, last)][1], self.items[n][2])
            if row[0] not in out or row[1:3] < out[row[0]][1:3]:
                out[row[0]] = row
        return list(out.values())


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size, by a hash of their text."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for block in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == block)
        yield [(r["item_id"], r["text"]) for r in part.select("item_id", "text").where("text is not null").collect()]


def find_leaks(docs: DataFrame, items: DataFrame, error_rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """One row for each document and item that occurs in it: doc_id, item_id, distance, allowed, start, end."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, distance int, allowed int, start long, end long"
    out = None
    for block in _blocks(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate)
            for batch in batches:
                rows = [(d, i, e, k, a, b) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for i, e, a, b, k in matcher.find(t)]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=["doc_id", "item_id", "distance", "allowed", "start", "end"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, items: DataFrame, error_rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """The documents in which no item occurs, with all their columns."""
    small_batches(docs.sparkSession)
    for block in _blocks(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
