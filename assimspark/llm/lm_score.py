"""Language-model scores of whole documents: a unigram base and a gated recurrent model, both learned from the training documents.

Tokens are lower-case (A-Z) words and one end for each document; training documents are those whose crc32 of the id's text is not 2 modulo
7. Counts are taken over all training documents, in numpy within a task and then by key. With c a token's count, N all, V the distinct:

    base_score = sum over tokens of log10((c + 1) / (N + V + 1))

Once the counts are known, each document's tokens are numbered and written to the shared folder, two bytes each; training and scoring read
those. The model (gru.py) is trained on all training documents in each of ``rounds`` passes: every task starts from the shared weights,
reads the whole of its documents, and the weights that come back are averaged, weighted by tokens, in two steps. Head words are the most
frequent ones; the others fall into classes by their last bytes and have (c + 1) / Z of their class, where Z also holds one unseen word.

Sizes: the head (2048 words), the table of frequent counts that is broadcast (``most_known`` words, 16 bytes each) and the weights are
bounded by parameters. Counts of all other words are joined by key, on rows that are aggregated by document first.

Null texts are empty (one token, the end); a null doc_id counts as held out only if its crc says so (it has none: it is a training
document); repeated rows are documents of their own; an empty table gives no rows; other columns are ignored. Words are told apart by a
64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assimspark.llm.common import materialise, small_batches
from assimspark.llm.gru import Model, Shape
from assimspark.llm.shingles import mix, words_with_ends

#: The end of a document, told from all words; words have mixed hashes, this is a plain number.
END = np.uint64(1)
TAIL_STEP = 40503


def tail_class(last: np.ndarray, n_tail: int) -> np.ndarray:
    """A class by the last two bytes of a word."""
    return ((last * TAIL_STEP >> 4) & 0xFFFF) % n_tail


def _tokens(texts: list[str | None], n_tail: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        hashes, starts, last = words_with_ends(texts)
    return hashes, starts, tail_class(last, n_tail)


def is_training() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))


def _slot(words: np.ndarray) -> np.ndarray:
    """A place for each word in tables of 2^20, in which it is looked for before it is searched."""
    return (words >> np.uint64(44)).astype(np.int32)


def count_words(words: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, the class of each (equal words have equal classes) and its count.

    Words are sorted alone, which is faster than with their places. A place in which a word stands is found in a table; for words whose slot
    went to another, among the places that lost theirs.
    """
    found = np.sort(words)
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    n, found = np.diff(first, append=len(words)), found[first]
    slot, at = _slot(words), np.zeros(1 << 20, np.int32)
    at[slot] = np.arange(len(words), dtype=np.int32)
    place = at[_slot(found)]
    of_found = cls[place]
    if len(others := np.flatnonzero(words[place] != found)):
        lost = np.flatnonzero(words[at[slot]] != words)
        of_found[others[np.searchsorted(found[others], words[lost])]] = cls[lost]
    return found, of_found, n


def word_counts(docs: DataFrame, n_tail: int, flush: int = 2_000_000) -> DataFrame:
    """(word, cls, c) over the given documents, without their ends."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> pa.RecordBatch:
            words, cls, n = count_words(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(cls.astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "cls", "c"])

        held, size = [], 0
        for batch in batches:
            hashes, _, cls = _tokens(batch.column("text").to_pylist(), n_tail)
            held.append((hashes, cls))
            size += len(hashes)
            if size >= flush:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    return docs.select("text").mapInArrow(work, "word long, cls int, c long").groupBy("word").agg(F.min("cls").alias("cls"), F.sum("c").alias("c"))


class Lookup:
    """Numbers of words: head words by rank, all others by class; and log10(c + 1) of the words in the broadcast table."""

    def __init__(self, shape: Shape, words: np.ndarray, counts: np.ndarray, end_rank: int):
        head = words[:shape.n_head - 1]
        ranks = np.arange(len(head)) + (np.arange(len(head)) >= end_rank)
        order = np.argsort(words)
        self.words, self.log_c = words[order], np.log10(counts[order] + 1.0)
        rank_of = np.full(len(words), -1)
        rank_of[:len(head)] = ranks
        self.rank, self.end, self.shape = rank_of[order], end_rank, shape
        self.by_count = np.argsort(order).astype(np.int32)
        self.slots = None

    def __getstate__(self) -> dict:
        """Tasks make their own slots."""
        return self.__dict__ | {"slots": None}

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words stand or would stand, and whether they do. Most are found in their slot, which holds its most frequent word; others are searched."""
        if self.slots is None:
            slots, wanted = np.zeros(1 << 20, np.int32), np.zeros(1 << 20, np.int8)
            places = self.by_count[::-1]
            of_word = _slot(self.words[places])
            slots[of_word] = places  # of equal slots the last one counts
            wanted[of_word[slots[of_word] != places]] = 1
            self.slots = slots, wanted
        slots, wanted = self.slots
        slot = _slot(hashes)
        at = slots[slot]
        known = self.words[at] == hashes
        rest = np.flatnonzero(~known & (wanted[slot] != 0))
        at[rest] = np.minimum(np.searchsorted(self.words, hashes[rest]), len(self.words) - 1)
        known[rest] = self.words[at[rest]] == hashes[rest]
        return at, known

    def __call__(self, hashes: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number for the model, log10(c + 1) where known (else 0), known."""
        if not len(self.words):
            return (self.shape.n_head + cls).astype(np.int32), np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        at, known = self._find(hashes)
        rank = np.where(known, self.rank[at], -1)
        return np.where(rank >= 0, rank, self.shape.n_head + cls).astype(np.int32), np.where(known, self.log_c[at], 0.0), known


def number(docs: DataFrame, learn: DataFrame, lookup: Broadcast, log_z: np.ndarray, n_docs: int) -> DataFrame:
    """One row for each document: its numbers for the model, the sums that need no model, and its words that the broadcast table lacks.

    row, doc_id, learn, n_tokens, n_known, base, in_class, ids, words, times. ``ids`` are 16-bit numbers (32-bit for a larger vocabulary).
    """
    end_log, end_known = float(np.log10(n_docs + 1)), int(n_docs > 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, table = TaskContext.get().partitionId() << 33, lookup.value
        shape = table.shape
        for batch in batches:
            hashes, starts, cls = _tokens(batch.column("text").to_pylist(), shape.n_tail)
            ids, log_c, known = table(hashes, cls)
            count = np.diff(starts)
            k, owner = len(count), np.repeat(np.arange(len(count)), count)
            tail, rest = ids >= shape.n_head, ~known
            in_class = np.bincount(owner[tail], weights=log_c[tail] - log_z[ids[tail] - shape.n_head], minlength=k).astype(float)
            base = np.bincount(owner, weights=log_c, minlength=k) + end_log
            n_known = np.bincount(owner, weights=known, minlength=k).astype(np.int64) + end_known
            order = np.lexsort((hashes[rest], owner[rest]))
            o, w = owner[rest][order], hashes[rest][order]
            fresh = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (w[1:] != w[:-1])))) if len(o) else np.zeros(0, int)
            times = np.diff(np.append(fresh, len(o))).astype(np.int32)
            ends = pa.array(np.searchsorted(o[fresh], np.arange(k + 1)).astype(np.int32))
            raw = ids.astype(_width(shape))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(k)), batch.column("doc_id"), batch.column("learn"), pa.array(count + 1), pa.array(n_known), pa.array(base, pa.float64()), pa.array(in_class, pa.float64()),
                    pa.array([raw[i:j].tobytes() for i, j in zip(starts[:-1], starts[1:])], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(w[fresh].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times)),
                ],
                names=["row", "doc_id", "learn", "n_tokens", "n_known", "base", "in_class", "ids", "words", "times"],
            )
            row += k

    return docs.select("doc_id", "text", learn.alias("learn")).mapInArrow(work, "row long, doc_id long, learn boolean, n_tokens long, n_known long, base double, in_class double, ids binary, words array<long>, times array<int>")


def _width(shape: Shape) -> str:
    return "<u2" if shape.n_words < 2**16 else "<u4"


def _groups(batches: Iterator[pa.RecordBatch], shape: Shape, most: int = 3_000_000):
    """Batches of numbered documents joined until they hold ``most`` words: (rows without ids, ids, starts)."""

    def joined(held: list) -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]:
        raw = [x for b in held for x in b.column("ids").to_pylist()]
        ids = np.frombuffer(b"".join(raw), _width(shape))
        return [b.drop_columns(["ids"]) for b in held], ids.astype(np.int32), np.cumsum([0, *map(len, raw)]) // ids.itemsize

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column("ids").nbytes // np.dtype(_width(shape)).itemsize
        if size >= most:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def _average(weights: DataFrame, tasks: int = 8) -> np.ndarray | None:
    """Mean of the weights by tokens: summed as they stream through a few tasks, whose sums meet in the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for raw, k in zip(batch.column("flat").to_pylist(), batch.column("n").to_pylist()):
                part = np.frombuffer(raw, np.float32).astype(float) * k
                total, n = part if total is None else total + part, n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([n], pa.int64())], names=["flat", "n"])

    rows = weights.repartition(tasks).mapInArrow(add, "flat binary, n long").collect()  # at most ``tasks`` rows
    return np.sum([np.frombuffer(r["flat"], float) for r in rows], axis=0) / sum(r["n"] for r in rows) if rows else None


def prepare(counts: DataFrame, n_docs: int, shape: Shape, most_known: int) -> tuple[Lookup, np.ndarray, np.ndarray]:
    """The lookup, the counts of the model's numbers, and log10 Z of each tail class."""
    top = counts.orderBy(F.desc("c"), "word").limit(most_known).toArrow()
    words, c = top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy().astype(float)
    n_words = min(len(words), shape.n_head - 1)
    end_rank = int(np.searchsorted(-c[:n_words], -float(n_docs)))
    head = np.zeros(shape.n_head)
    head[:n_words + 1] = np.insert(c[:n_words], end_rank, n_docs)
    # The words of the head are the first of the same order, so they end at a known (count, word).
    last = (int(c[n_words - 1]), int(words[n_words - 1].astype(np.int64))) if n_words else None
    tail = counts.where((F.col("c") < last[0]) | ((F.col("c") == last[0]) & (F.col("word") > last[1]))) if last else counts
    sums = {r["cls"]: (r["c"], r["z"]) for r in tail.groupBy("cls").agg(F.sum("c").alias("c"), F.sum(F.col("c") + 1).alias("z")).collect()}  # n_tail rows
    of_tail = np.array([sums.get(k, (0, 0)) for k in range(shape.n_tail)], float).reshape(-1, 2)
    return Lookup(shape, words, c, end_rank), np.concatenate((head, 1 + of_tail[:, 0])), np.log10(1 + of_tail[:, 1])


def train(numbered: DataFrame, shape: Shape, flat: np.ndarray, end_id: int, rounds: int) -> np.ndarray:
    """The weights after ``rounds`` passes over the numbered training documents."""
    spark = numbered.sparkSession
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(flat)

        def work(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            model, seen = Model(shape, now.value.copy()), 0
            for _, ids, starts in _groups(batches, shape):
                seen += model.train(ids, starts, end_id)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([model.flat.tobytes()]), pa.array([seen], pa.int64())], names=["flat", "n"])

        mean = _average(numbered.select("ids").mapInArrow(work, "flat binary, n long"))
        flat = flat if mean is None else mean.astype(np.float32)
    return flat


def score(docs: DataFrame, shape: Shape | None = None, most_known: int = 200_000, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shape, spark = shape or Shape(), docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    learn = docs.where(is_training())
    counts = materialise(word_counts(learn, shape.n_tail), "word-counts")
    n_docs = learn.count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + n_docs, v + (n_docs > 0)
    lookup, number_counts, log_z = prepare(counts, n_docs, shape, most_known)
    end_id = lookup.end
    numbered = materialise(number(docs, is_training(), spark.sparkContext.broadcast(lookup), log_z, n_docs), "lm-numbered")
    flat = train(numbered.where("learn"), shape, shape.start(number_counts), end_id, rounds)
    weights = spark.sparkContext.broadcast(flat)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shape, weights.value)
        for rows, ids, starts in _groups(batches, shape):
            found = pa.Table.from_batches(rows).combine_chunks()
            yield from found.append_column("model", pa.array(model.score(ids, starts, end_id))).to_batches()

    kept = "row long, doc_id long, learn boolean, n_tokens long, n_known long, base double, in_class double"
    scored = numbered.select(*(c.split()[0] for c in kept.split(", ")), "ids").mapInArrow(work, kept + ", model double")
    rare = numbered.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts.select("word", "c"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    joined = scored.join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), (F.col("model") + F.col("in_class") + more).alias("score"),
    )
