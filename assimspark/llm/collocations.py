"""Phrase collocations by SETM relational mining.

Occurrences of phrases are relations sorted by piece and position. One pass over the texts counts words; the frequent ones get numbers. A second
pass writes the relation of their occurrences. From then on each level works on the relation before it: a merge-join of the relation with itself
on the same piece and the next position gives the occurrences of phrases one word longer (two phrases that overlap in all but one word each);
they are grouped and counted, frequent groups get numbers, and a semi-join with them leaves the sorted relation of the next level.

A relation is kept in rows of about ``OCCURRENCES`` occurrences: their slots (where words stand; a piece's end takes a slot too, so neighbours
in a piece are one slot apart and pieces never touch) and their phrases' numbers. Rows end where pieces end, so the merge-join needs no shuffle.
Numbers stand for exact phrases, so nothing is mixed up. Only counts, summed within tasks before, are shuffled. The frequent groups go to
the tasks by broadcast while there are at most ``most_broadcast`` of them, and beyond that by joins that bring each row its own ones.

A null text is empty; a null language is ``und``; repeated rows count as often as they stand there; an empty table gives no phrases; very long
texts are counted whole; ties go to the larger count and then to the smaller phrase; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assimspark.llm.common import materialise, small_batches

#: These characters end a piece; all of them become a full stop, and A-Z become small.
ENDS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(bytes(range(65, 91)) + ENDS, bytes(range(97, 123)) + b"." * len(ENDS))
OCCURRENCES = 2000
#: Pairs that a task counts at once, and words that it holds at most.
HELD_PAIRS, HELD_WORDS = 2_000_000, 300_000
RELATION = "uid long, slots binary, ids binary"
UND = "und"
#: Where groups go to the tasks by joins: characters of the texts whose words are joined at once, rows of the relation whose pairs are, and the least
#: and the most numbers of buckets that pairs and groups meet in.
TEXTS, HOME_ROWS, BUCKETS = 4_000_000, 100, (64, 512)
PACKS = "bucket int, asked boolean, home long, keys binary, numbers binary, row binary"


def tokens_of(texts: list[bytes]) -> list[bytes]:
    """The words of all texts, with a full stop at each end of a piece."""
    return b".".join([*texts, b""]).translate(FOLD).replace(b".", b" . ").split()


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    groups: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), texts):
        if text:
            groups.setdefault(lang, []).append(text)
    for lang, held in groups.items():
        yield lang, tokens_of(held)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), and for each language a row without a word for all its words."""
    counts: dict[str, Counter] = {}
    totals: Counter = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, held in counts.items():
            held.pop(b".", None)
            words = list(held)
            for a in range(0, len(words), 50_000):
                part = words[a:a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()).view(pa.string()), pa.array([held[w] for w in part], pa.int64())], names=["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        for lang, tokens in by_language(batch):
            held = counts.setdefault(lang, Counter())
            held.update(tokens)
            totals[lang] += len(tokens) - tokens.count(b".")
        if sum(map(len, counts.values())) > HELD_WORDS:
            yield from rows()
    yield from rows()
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([None] * len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["lang", "word", "n"])


def numbered(df: DataFrame, what: str) -> tuple[DataFrame, int]:
    """The table, written, with ids from 0 on without gaps, and how many rows it has."""
    spark = df.sparkSession
    written = materialise(df.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), what)
    starts, at = [], 0
    for r in written.groupBy("part").count().orderBy("part").collect():  # a row for each task that wrote
        starts.append((r["part"], at))
        at += r["count"]
    if at >= 1 << 31:
        raise ValueError("more frequent phrases than 31 bits number")
    start = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    return written.join(start, "part").withColumn("id", F.col("start") + F.col("place")).drop("part", "place", "start"), at


def flat(column: pa.Array, kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column one after the other, and where rows start (rows + 1 numbers)."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8)[starts[0]:starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return values.view(kind).astype(np.int64), (starts - starts[0]) // np.dtype(kind).itemsize


def as_column(values: np.ndarray, starts: np.ndarray, kind: type = np.uint32) -> pa.Array:
    """The inverse of ``flat``."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * np.dtype(kind).itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.astype(kind).tobytes())])


def merge_join(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots and keys of the pairs of occurrences at neighbouring slots, the rows that they stand in, and where rows start."""
    slots, starts = flat(batch.column("slots"))
    ids, _ = flat(batch.column("ids"))
    near = slots[1:] == slots[:-1] + 1
    borders = starts[1:-1]
    near[borders[(borders > 0) & (borders < len(slots))] - 1] = False
    at = np.flatnonzero(near)
    return slots[at], ids[at] << 32 | ids[at + 1], np.searchsorted(starts, at, side="right") - 1, starts


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        for a in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:a + 100_000]), pa.array(n[a:a + 100_000].astype(np.int64))], names=["key", "n"])

    for batch in batches:
        keys = merge_join(batch)[1]
        held.append(keys)
        size += len(keys)
        if size > HELD_PAIRS:
            yield from rows()
            held, size = [], 0
    if size:
        yield from rows()


def relation_rows(slots: np.ndarray, ids: np.ndarray, starts: np.ndarray, uid: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(starts) - 1)), as_column(slots, starts), as_column(ids, starts)], names=["uid", "slots", "ids"])


def word_rows(tokens: list[bytes], known: dict[bytes, int], uid: int) -> pa.RecordBatch | None:
    """The occurrences of known words, cut into rows where pieces end."""
    ids = np.fromiter(map(known.get, tokens, repeat(-1)), np.int64, len(tokens))
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return None
    ends = np.flatnonzero(ids == -2)
    cuts = np.unique(np.searchsorted(ends, at[OCCURRENCES::OCCURRENCES]))
    starts = np.unique(np.r_[0, np.searchsorted(at, ends[cuts[cuts < len(ends)]]), len(at)])
    return relation_rows(at, ids[at], starts, uid)


def _first_uid() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 33


def relation_of_words(docs: DataFrame, words: DataFrame, n_words: int, most_broadcast: int) -> DataFrame:
    """The sorted relation of the occurrences of frequent words."""
    spark = docs.sparkSession
    if n_words <= most_broadcast:
        known: dict[str, dict[bytes, int]] = {}
        for r in words.select("lang", "word", "id").toLocalIterator():
            known.setdefault(r["lang"], {b".": -2})[r["word"].encode()] = r["id"]
        sent = spark.sparkContext.broadcast(known)  # of checked size

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uid = _first_uid()
            for batch in batches:
                for lang, tokens in by_language(batch):
                    rows = word_rows(tokens, sent.value.get(lang, {}), uid)
                    if rows is not None:
                        uid += rows.num_rows
                        yield rows

        return materialise(docs.mapInArrow(write, RELATION), "setm-words")

    def join_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, held = _first_uid(), {}

        def row(lang: str) -> pa.RecordBatch:
            nonlocal uid
            uid += 1
            return pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([lang]), pa.array([b".".join(held.pop(lang))], pa.binary())], names=["uid", "lang", "texts"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if text:
                    held.setdefault(lang, []).append(text)
                    if sum(map(len, held[lang])) > TEXTS:
                        yield row(lang)
        for lang in list(held):
            yield row(lang)

    own = materialise(docs.mapInArrow(join_texts, "uid long, lang string, texts binary"), "setm-documents")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list({*tokens_of([batch.column("texts")[i].as_py()])} - {b"."})
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("uid")[i].as_py()] * len(found)), pa.array([batch.column("lang")[i].as_py()] * len(found)), pa.array(found, pa.binary()).view(pa.string())], names=["uid", "lang", "word"])

    def write_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = _first_uid()
        for batch in batches:
            for i in range(batch.num_rows):
                known = batch.column("known")[i].values
                ids = dict(zip(known.field("word").cast(pa.binary()).to_pylist(), known.field("id").to_pylist()))
                rows = word_rows(tokens_of([batch.column("texts")[i].as_py()]), {b".": -2} | ids, uid)
                if rows is not None:
                    uid += rows.num_rows
                    yield rows

    met = own.mapInArrow(distinct, "uid long, lang string, word string").join(words.select("lang", "word", "id"), ["lang", "word"])
    brought = met.groupBy("uid").agg(F.collect_list(F.struct("word", "id")).alias("known"))  # the own words of some texts
    return materialise(own.join(brought, "uid").select("texts", "known").mapInArrow(write_own, RELATION), "setm-words")


def _packs(keys: np.ndarray, numbers: np.ndarray, row: np.ndarray, buckets: int, asked: bool, home: int) -> pa.RecordBatch:
    """A row for each bucket that has any of the keys, in the order given."""
    bucket = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=buckets)
    there = np.flatnonzero(counts)
    starts = np.concatenate([[0], np.cumsum(counts[there])])
    n = len(there)
    fixed = [pa.array(there, pa.int32()), pa.array([asked] * n, pa.bool_()), pa.array([home] * n, pa.int64())]
    return pa.RecordBatch.from_arrays([*fixed, as_column(keys[order], starts, np.int64), as_column(numbers[order], starts), as_column(row[order], starts, np.uint8)], names=["bucket", "asked", "home", "keys", "numbers", "row"])


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """From where to where rows have equal values."""
    n = len(columns[0])
    cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1 if n else []
    yield from zip([0, *cuts], [*cuts, n]) if n else ()


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packs sorted by bucket, groups first: the slots and groups' numbers of the pairs that are in a group."""
    now, groups, known, ids = -1, [], None, None
    for batch in batches:
        bucket, asked, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "asked", "home"))
        (keys, starts), (numbers, _), (row, _) = flat(batch.column("keys"), np.int64), flat(batch.column("numbers")), flat(batch.column("row"), np.uint8)
        for a, b in _runs(bucket, asked):
            if bucket[a] != now:
                now, groups, known = bucket[a], [], None
            part = slice(starts[a], starts[b])
            if not asked[a]:
                groups.append((keys[part], numbers[part]))
                continue
            if not groups:
                continue
            if known is None:
                known, ids = (np.concatenate(x) for x in zip(*groups))
                order = np.argsort(known)
                known, ids = known[order], ids[order]
            at = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
            hit = known[at] == keys[part]
            new = np.concatenate([[0], np.cumsum(hit)])[starts[a:b + 1] - starts[a]]
            yield pa.RecordBatch.from_arrays([pa.array(home[a:b]), as_column(numbers[part][hit], new), as_column(ids[at[hit]], new), as_column(row[part][hit], new, np.uint8)], names=["home", "slots", "ids", "row"])


def _bring_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by home: the sorted relation."""
    uid, now, held = _first_uid(), None, []

    def rows() -> pa.RecordBatch:
        slots, ids, row = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((slots, row))
        starts = np.flatnonzero(np.diff(row[order], prepend=-1, append=HOME_ROWS))
        return relation_rows(slots[order], ids[order], starts, uid)

    for batch in batches:
        home = batch.column("home").to_numpy()
        (slots, starts), (ids, _), (row, _) = flat(batch.column("slots")), flat(batch.column("ids")), flat(batch.column("row"), np.uint8)
        for a, b in _runs(home):
            if home[a] != now:
                if sum(len(x[0]) for x in held):
                    found = rows()
                    uid += found.num_rows
                    yield found
                now, held = home[a], []
            part = slice(starts[a], starts[b])
            held.append((slots[part], ids[part], row[part]))
    if sum(len(x[0]) for x in held):
        yield rows()


def semi_join(relation: DataFrame, groups: DataFrame, n_groups: int, most_broadcast: int, what: str) -> DataFrame:
    """The sorted relation of the occurrences of the frequent groups, whose members are joined from ``relation``."""
    spark = relation.sparkSession

    def kept(batch: pa.RecordBatch, hit: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        slots, _, row, starts = merge_join(batch)
        new = np.searchsorted(row[hit], np.arange(len(starts)))
        return pa.RecordBatch.from_arrays([batch.column("uid"), as_column(slots[hit], new), as_column(ids, new)], names=["uid", "slots", "ids"])

    if n_groups <= most_broadcast:
        table = groups.select("key", "id").toArrow()
        keys, numbers = table.column("key").to_numpy(), table.column("id").to_numpy()
        order = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[order], numbers[order]))  # of checked size

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, ids = sent.value
            for batch in batches:
                if len(known) and batch.num_rows:
                    asked = merge_join(batch)[1]
                    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                    hit = known[at] == asked
                    yield kept(batch, hit, ids[at[hit]])

        return materialise(relation.mapInArrow(keep, RELATION), what)

    buckets = min(max(n_groups // max(most_broadcast, 1) + 1, BUCKETS[0]), BUCKETS[1])

    def pack_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column("key").to_numpy(), batch.column("id").to_numpy()))
            n += batch.num_rows
            if n > 100_000:
                yield _packs(*(np.concatenate(x) for x in zip(*held)), np.zeros(n), buckets, False, 0)
                held, n = [], 0
        if n:
            yield _packs(*(np.concatenate(x) for x in zip(*held)), np.zeros(n), buckets, False, 0)

    def pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = _first_uid()
        for batch in batches:
            for a in range(0, batch.num_rows, HOME_ROWS):
                slots, keys, row, _ = merge_join(batch.slice(a, HOME_ROWS))
                if len(keys):
                    yield _packs(keys, slots, row, buckets, True, home)
                    home += 1

    both = groups.select("key", "id").mapInArrow(pack_groups, PACKS).unionAll(relation.mapInArrow(pack_pairs, PACKS))
    hits = both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "asked").mapInArrow(_look_up, "home long, slots binary, ids binary, row binary")
    return materialise(hits.repartition(buckets, "home").sortWithinPartitions("home").mapInArrow(_bring_home, RELATION), what)


def frequent_phrases(docs: DataFrame, min_count: int = 30, most_broadcast: int = 500_000) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language in all (lang, n), and the frequent phrases by length: (id, lang, word, n), then (id, left, right, n), where left and right are
    the numbers of the phrases without the last and without the first word."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"), F.col("text").cast("string").alias("text"))
    counted = docs.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialise(counted.where(F.col("word").isNull() | (F.col("n") >= min_count)), "setm-counts")
    words, size = numbered(counted.where("word is not null"), "setm-frequent-1")
    levels, relation = [words], relation_of_words(docs, words, size, most_broadcast)
    for k in (2, 3, 4):
        pairs = relation.mapInArrow(_count_pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        groups, size = numbered(pairs.where(F.col("n") >= min_count), f"setm-frequent-{k}")
        levels.append(groups.withColumns({"left": F.shiftrightunsigned("key", 32), "right": F.col("key").bitwiseAND(F.lit((1 << 32) - 1))}))
        if k < 4:
            relation = semi_join(relation, groups, size, most_broadcast, f"setm-phrases-{k}")
    return counted.where("word is null").select("lang", "n"), levels


def collocations(docs: DataFrame, min_count: int = 30, most: int = 2000, within: int = 80, most_broadcast: int = 500_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``most`` best phrases of two to four words.

    A phrase that occurs ``a`` >= ``min_count`` times is cut after its first k words, l and r are the counts of both parts, and its score is that of the cut with
    the smallest floor(2000000 a / (l + r)), the first one of equals. A phrase that stands within a longer one of at least ``within`` hundredths of its count is left out.
    """
    totals, (one, two, three, four) = frequent_phrases(docs, min_count, most_broadcast)

    def sides(groups: DataFrame, parts: DataFrame) -> DataFrame:
        side = lambda name: parts.select(*(F.col(c).alias(name + c) for c in parts.columns))
        return groups.select("id", "left", "right", F.col("n").alias("a")).join(side("x_"), F.col("left") == F.col("x_id")).join(side("y_"), F.col("right") == F.col("y_id"))

    def cuts(*pairs: tuple[str, str]):  # noqa: ANN202
        return F.array(*(F.struct(F.col(l).alias("l"), F.col(r).alias("r")) for l, r in pairs)).alias("cuts")

    joined = lambda first, last: F.concat_ws(" ", first, last).alias("phrase")
    two = materialise(sides(two, one).select("id", F.col("x_lang").alias("lang"), joined("x_word", "y_word"), "a", "left", "right", F.col("x_n").alias("first_n"), F.col("y_word").alias("last"), F.col("y_n").alias("last_n"), cuts(("x_n", "y_n"))), "setm-two")
    three = materialise(sides(three, two).select("id", F.col("x_lang").alias("lang"), joined("x_phrase", "y_last"), "a", "left", "right", F.col("x_first_n").alias("first_n"), F.col("y_last").alias("last"), F.col("y_last_n").alias("last_n"), F.col("x_a").alias("head_n"), F.col("y_a").alias("tail_n"), cuts(("x_first_n", "y_a"), ("x_a", "y_last_n"))), "setm-three")
    four = materialise(sides(four, three).select("id", F.col("x_lang").alias("lang"), joined("x_phrase", "y_last"), "a", "left", "right", F.array("x_left", "x_right", "y_right").alias("pairs"), cuts(("x_first_n", "y_a"), ("x_head_n", "y_tail_n"), ("x_a", "y_last_n"))), "setm-four")

    inside = lambda size, ids, longer: longer.select(F.lit(size).alias("size"), F.explode(ids).alias("id"), F.col("a").alias("longer"))
    both = F.array("left", "right")
    around = inside(2, both, three).unionAll(inside(2, F.col("pairs"), four)).unionAll(inside(3, both, four)).groupBy("size", "id").agg(F.max("longer").alias("longer"))
    columns = ["id", "lang", "phrase", "a", "cuts"]
    found = two.select(F.lit(2).alias("size"), *columns).unionAll(three.select(F.lit(3).alias("size"), *columns)).unionAll(four.select(F.lit(4).alias("size"), *columns))
    alone = found.join(around, ["size", "id"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a")))
    # whole decimals of 20 digits times 2000000 are exact
    lowest = F.expr("array_min(transform(cuts, (c, k) -> struct(cast(a as decimal(20, 0)) * 2000000 div cast(c.l + c.r as decimal(20, 0)) as score, k, c.l as l, c.r as r)))")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.select("lang", "phrase", "a", lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
