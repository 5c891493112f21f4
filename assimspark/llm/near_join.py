"""N-gram Jaccard join: a size-aware heavy-light self-join of shingle sets, and the groups it links.

A document's set holds its distinct 5-word shingles (64-bit hashes). Two sets link when their Jaccard similarity is at least 4/5. With sizes
a <= b that means an overlap of at least o(a, b) = ceil(4 (a + b) / 9), and a >= 0.8 b.

1. Equal sets form a class; only one representative of a class goes on, so copies cost one row each.
2. Light sets (size up to a boundary): for each partner size the o-element subsets of the set are enumerated. Two sets that share such a
   subset do link, so a key's members are tied to its smallest member - no pair is checked, none is listed.
3. Heavy sets: inverted lists over a prefix. Under the order of hashes, similar sets share at least l elements of their (n - ceil(0.8 n) + l)
   smallest ones; a second prefix over those, in order of rising document frequency, is what lists are made of. A set whose smallest
   elements are mostly its own (frequency 1) has none.
4. The boundary is the size at which enumerating subsets starts to cost more than scanning lists, summed over the size histogram.
5. Lists are read in rounds: each list has one centre (the member with the most shared elements, later from a random eighth), each member
   is checked against one centre, and what is linked is one component from then on. Then all pairs that are left - same list, different
   components - meet in a join whose condition holds a parity sketch: its differing bits bound the symmetric difference from below, so
   it rules out most pairs before they are rows; the others are checked exactly. No link between components is lost, and a dense group
   of m copies costs about m checks and not m^2.

Null or word-less texts have an empty set, link with nothing and form a component of their own; fewer than five words are one shingle;
repeated rows are copies of each other; rows that share a doc_id are one node; a null doc_id gives a null component; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assimspark.llm.common import Scratch, materialise, small_batches
from assimspark.llm.shingles import STEP, mix, shingle_sets

SETS = "doc_id long, n int, h1 long, h2 long, head array<long>"
#: Sets up to this size can be light; their whole set is kept as head.
MOST_LIGHT = 16
SKETCH_LONGS = 32


def least_overlap(a: int, b: int) -> int:
    return -(-4 * (a + b) // 9)


def extra(n: int) -> int:
    """l: how many elements the first prefixes of similar sets share at least."""
    return max(1, -(-3 * n // 20))


def first_prefix(n: int) -> int:
    return min(n, n - -(-4 * n // 5) + extra(n))


def _sets(texts: list[str | None]) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return shingle_sets(texts)


def set_heads(docs: DataFrame) -> DataFrame:
    """Size, 128-bit signature and first prefix of each document's set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column("text").to_pylist())
            with np.errstate(over="ignore"):
                h1 = [int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
                h2 = [int(np.bitwise_xor.reduce(mix(s * np.uint64(STEP))).astype(np.int64)) if len(s) else 0 for s in sets]
            heads = [s[:len(s) if len(s) <= MOST_LIGHT else first_prefix(len(s))] for s in sets]
            ends = np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int32)
            flat = np.concatenate([*heads, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "n", "h1", "h2", "head"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, SETS)


def whole_sets(docs: DataFrame) -> DataFrame:
    """The sets in full, with their parity sketches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column("text").to_pylist())
            sketches = np.zeros((len(sets), SKETCH_LONGS * 64), np.uint8)
            for row, s in zip(sketches, sets):
                row[:] = np.bincount((s >> np.uint64(7)) % np.uint64(SKETCH_LONGS * 64), minlength=SKETCH_LONGS * 64) & 1
            packed = np.packbits(sketches, axis=1).view(np.int64).reshape(-1)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH_LONGS), pa.array(packed))], names=["doc_id", "n", "items", "sketch"])

    return docs.mapInArrow(work, "doc_id long, n int, items array<long>, sketch array<long>")


def subset_sizes(n: int, boundary: int) -> list[tuple[int, int, int]]:
    """(a, b, overlap) for the partner sizes of a light set of size n; equal sizes that need equal sets are settled already."""
    out = []
    for other in range(ceil(0.8 * n), min(boundary, n * 5 // 4) + 1):
        a, b = min(n, other), max(n, other)
        o = least_overlap(a, b)
        if o <= a and not (a == b == o):
            out.append((a, b, o))
    return out


def choose_boundary(histogram: dict[int, int], list_cost: float = 3.0) -> int:
    """The size up to which subsets cost less than lists: rows made by either side, a list row counted ``list_cost`` times for its checks."""
    best, cost_at = 0, None
    for boundary in range(MOST_LIGHT + 1):
        light = sum(c * sum(comb(n, o) for _, _, o in subset_sizes(n, boundary)) for n, c in histogram.items() if 0 < n <= boundary)
        heavy = sum(c * list_cost * first_prefix(n) for n, c in histogram.items() if n * 5 // 4 > boundary)
        if cost_at is None or light + heavy < cost_at:
            best, cost_at = boundary, light + heavy
    return best


def light_links(heads: DataFrame, boundary: int) -> DataFrame:
    """(u, v) links between light sets: each member of a subset's key with the key's smallest member on the other side."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, bool, bool]] = []
            for doc, n, head in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "head"))):
                for a, b, o in subset_sizes(n, boundary):
                    for part in itertools.combinations(head, o):
                        key = (a * 64 + b) * STEP
                        for v in part:
                            key = ((key ^ (v & (1 << 64) - 1)) * 0x9E3779B97F4A7C15 + STEP) & (1 << 64) - 1
                            key ^= key >> 29
                        rows.append((key - (1 << 64) if key >> 63 else key, doc, n == a, n == b))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["key", "doc_id", "small", "large"])

    rows = heads.where(F.col("n").between(1, boundary)).select("doc_id", "n", "head").mapInArrow(work, "key long, doc_id long, small boolean, large boolean")
    tops = rows.groupBy("key").agg(F.min(F.when(F.col("small"), F.col("doc_id"))).alias("a"), F.min(F.when(F.col("large"), F.col("doc_id"))).alias("b")).where("a is not null and b is not null")
    tied = rows.join(tops, "key")
    return tied.select(F.explode(F.array(F.struct(F.col("doc_id").alias("u"), F.when(F.col("small"), F.col("b")).alias("v")), F.struct(F.col("doc_id").alias("u"), F.when(F.col("large"), F.col("a")).alias("v")))).alias("e")).select("e.u", "e.v").where("v is not null and u <> v").distinct()


def lists(heads: DataFrame, boundary: int) -> DataFrame:
    """(token, doc_id, n, score): the second prefixes; score sums the frequencies of a set's shared elements.

    Frequencies are counted in tasks first and joined back, so a token of very many documents is split as Spark splits skewed joins.
    """
    n = F.col("n")
    prefix = F.least(n, n - F.ceil(n * 4 / 5) + F.greatest(F.lit(1), F.ceil(n * 3 / 20)))
    post = heads.where(F.floor(n * 5 / 4) > boundary).select("doc_id", "n", F.explode(F.slice("head", F.lit(1), prefix.cast("int"))).alias("token"))
    shared = post.join(post.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token")
    by_doc = Window.partitionBy("doc_id")
    least = F.greatest(F.lit(1), F.ceil(F.ceil(n * 4 / 5) * 3 / 20))  # l of the smallest partner
    ranked = shared.select("token", "doc_id", "n", F.count("*").over(by_doc).alias("k"), F.sum("df").over(by_doc).alias("score"), F.row_number().over(by_doc.orderBy("df", "token")).alias("r"))
    return ranked.where((F.col("k") >= least) & (F.col("r") <= F.col("k") - least + 1)).select("token", "doc_id", "n", "score")


def components(edges: DataFrame, scratch: Scratch, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node reachable, by smallest-neighbour rounds with one jump each. ``labels`` may hold earlier results, which are dropped."""
    both = scratch.write(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    start = both.select(F.col("u").alias("node")).distinct()
    start = start.withColumn("label", F.col("node")) if labels is None else start.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    table = scratch.write(start.withColumn("moved", F.lit(True)), "labels")
    if labels is not None:
        scratch.drop(labels)
    while True:
        now = table.select("node", "label")
        seen = both.join(now.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        low = now.join(seen, "node").select("node", "label", F.least("label", "near").alias("low"))
        top = now.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        low = low.join(top, "low", "left").select("node", "label", F.least("low", F.coalesce("jump", "low")).alias("low"))
        after = scratch.write(low.select("node", F.col("low").alias("label"), (F.col("low") < F.col("label")).alias("moved")), "labels")
        scratch.drop(table)
        table = after
        if not table.where("moved").limit(1).count():
            scratch.drop(both)
            return table


def _similar(a: Column, b: Column) -> Column:
    """5/4 between sizes at most: a condition on every link."""
    return (5 * a >= 4 * b) & (5 * b >= 4 * a)


def with_set(pairs: DataFrame, n_pairs: int, key: str, sets: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The pairs with columns of the set of ``key``. A set in more than max(100, n_pairs / 1000) pairs is joined in several copies.

    At most n_pairs / that number of sets, so never over 1000 unless there are under 100,000 pairs, are told apart by broadcast.
    """
    most = max(100, n_pairs // 1000)
    busy = pairs.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("__copies")).where("__copies > 1")
    other = "v" if key == "u" else "u"
    salted = pairs.join(F.broadcast(busy), key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("__copies")).cast("int"), F.lit(0))).drop("__copies")
    side = sets.select(F.col("doc_id").alias(key), *(F.col(c).alias(a) for c, a in columns.items())).join(F.broadcast(busy), key, "left")
    side = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1))).drop("__copies")
    return salted.join(side, [key, "__salt"]).drop("__salt")


def confirm(pairs: DataFrame, sets: DataFrame, scratch: Scratch, sketch_first: bool) -> DataFrame:
    """The pairs (u, v) whose sets link."""
    pairs = scratch.write(pairs, "pairs")
    n_pairs = pairs.count()
    if sketch_first:
        met = with_set(with_set(pairs, n_pairs, "u", sets, {"n": "nu", "sketch": "su"}), n_pairs, "v", sets, {"n": "nv", "sketch": "sv"})
        apart = F.aggregate(F.zip_with("su", "sv", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda t, x: t + x)
        near = scratch.write(met.where(9 * apart <= F.col("nu") + F.col("nv")).select("u", "v"), "pairs")
        scratch.drop(pairs)
        pairs, n_pairs = near, near.count()
    met = with_set(with_set(pairs, n_pairs, "u", sets, {"n": "nu", "items": "su"}), n_pairs, "v", sets, {"n": "nv", "items": "sv"})
    both = F.size(F.array_intersect("su", "sv"))
    found = scratch.write(met.where(100 * both >= 80 * (F.col("nu") + F.col("nv") - both)).select("u", "v").distinct(), "found-links")
    scratch.drop(pairs)
    return found


def remaining_pairs(now: DataFrame, mixed: DataFrame, whole: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) of a list's members in different components that a folded sketch can't rule out.

    Of such a pair at least one is outside the list's main component, so those members meet all others. The sketch is compared inside the
    join, as plain 64-bit columns: what it rules out is never a row.
    """
    half = SKETCH_LONGS // 2
    folded = whole.select("doc_id", *(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("sketch", F.lit(i + half))).alias(f"s{i}") for i in range(half)))
    live = scratch.write(now.join(mixed, "token").join(folded, "doc_id"), "lists-mixed")
    minor = live.where(F.col("comp") != F.col("main"))
    a = minor.select("token", F.col("doc_id").alias("u"), F.col("n").alias("nu"), F.col("comp").alias("cu"), *(F.col(f"s{i}").alias(f"a{i}") for i in range(half)))
    b = live.select("token", F.col("doc_id").alias("v"), F.col("n").alias("nv"), F.col("comp").alias("cv"), (F.col("comp") == F.col("main")).alias("in_main"), *(F.col(f"s{i}").alias(f"b{i}") for i in range(half)))
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0")))
    for i in range(1, half):
        apart = apart + F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}")))
    may = (F.col("cu") != F.col("cv")) & (F.col("in_main") | (F.col("u") < F.col("v"))) & _similar(F.col("nu"), F.col("nv")) & (9 * apart <= F.col("nu") + F.col("nv"))
    return a.join(b, (a["token"] == b["token"]) & may).select("u", "v").distinct()


def near_groups(docs: DataFrame, most_rounds: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of the documents."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    sets = scratch.write(set_heads(docs), "set-heads")
    sized = sets.where("n > 0 and doc_id is not null")
    classes = scratch.write(sized.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "set-classes")
    heads = sized.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "h1", "h2"], "left_semi")
    histogram = {r["n"]: r["c"] for r in classes.where(F.col("n") <= 2 * MOST_LIGHT).groupBy("n").agg(F.count("*").alias("c")).collect()}
    boundary = choose_boundary(histogram)

    member = sized.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"]).select("doc_id", "rep")
    shared_id = member.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("most")).where("u < most").select("doc_id", "u")
    links = member.join(shared_id, "doc_id").select("u", F.col("rep").alias("v")).where("u <> v").distinct()
    links = scratch.write(links.unionByName(light_links(heads, boundary)), "light-links")
    labels = components(links, scratch)

    kept = scratch.write(lists(heads, boundary), "lists")
    narrow = scratch.write(sets.select("doc_id", "n", "h1", "h2"), "set-sizes")
    scratch.drop(sets)
    scratch.settle()
    n_rows = kept.count()
    members = kept.groupBy("token").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("token")
    wanted = kept.join(members, "token", "left_semi").select("doc_id").distinct()
    whole = scratch.write(whole_sets(docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi")), "whole-sets")

    left_before, now = None, None
    for turn in range(most_rounds + 1):
        named = kept.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").withColumn("comp", F.coalesce("label", "doc_id"))
        if now is not None:
            scratch.drop(now)
        now = scratch.write(named.select("token", "doc_id", "n", "score", "comp"), "lists-now")
        sizes = now.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("within"), F.max(F.struct("m", "comp"))["comp"].alias("main")).where("m * m > within")
        left = sizes.agg(F.sum((F.col("m") * F.col("m") - F.col("within")) / 2)).first()[0] or 0
        if turn == most_rounds or left <= n_rows or (left_before is not None and left > 0.9 * left_before and turn > 1):
            break
        left_before = left
        eligible = F.lit(True) if turn == 0 else F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(8)) == 0
        centre = F.max(F.struct(eligible.alias("e"), F.col("score"), F.col("doc_id").alias("v"), F.col("n").alias("nv"), F.col("comp").alias("cv"))).alias("c")
        centres = now.groupBy("token").agg(centre, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        met = now.join(centres, "token").where((F.col("comp") != F.col("c.cv")) & _similar(F.col("n"), F.col("c.nv")))
        one = met.groupBy(F.col("doc_id").alias("u"), F.col("c.v").alias("v")).agg(F.count("*").alias("times")).groupBy("u").agg(F.max(F.struct("times", "v")).alias("x")).select("u", F.col("x.v").alias("v"))
        links = links.unionByName(confirm(one, whole, scratch, sketch_first=False))
        labels = components(links, scratch, labels)
        scratch.settle()
    scratch.drop(kept)
    rest = remaining_pairs(now, sizes.select("token", "main"), whole, scratch)
    links = links.unionByName(confirm(rest, whole, scratch, sketch_first=True))
    scratch.drop(whole, now)
    labels = components(links, scratch, labels)

    with_class = narrow.join(classes, ["n", "h1", "h2"], "left")
    found = with_class.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("label", "rep"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one row left of each group of near copies: that of its smallest doc_id; rows without a doc_id stay.

    Of rows that share this doc_id the one with the smallest text hash stays; only such rows are ranked.
    """
    kept = materialise(near_groups(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("__rows")), "near-kept")
    named = docs.join(kept, "doc_id")
    many = named.where(F.col("__rows") > 1).withColumn("__rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where(F.col("__rank") == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return named.where(F.col("__rows") == 1).select(*columns).unionByName(many.select(*columns)).unionByName(docs.where(F.col("doc_id").isNull()))
