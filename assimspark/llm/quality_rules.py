"""Quality rules: a learned decision list over text statistics.

Sequential covering in the grow-and-prune manner: each rule is a conjunction of thresholds ("symbols per word > 0.31 and words <= 880")
that is grown on two thirds of the labelled rows until it covers (nearly) only low-quality ones and is then cut back on the other third.
The list becomes one ordered Spark ``CASE WHEN`` expression, so applying it to a corpus is a scan with built-in functions and no shuffle.

Nulls and odd input: a null text counts as empty; labels other than 0 and 1 and labels without a document are left out; documents that
carry labels several times are learned from once (the smallest label counts); without labelled rows of both kinds the list is empty and
only the base rules decide. Extra columns of the input are kept by ``with_quality`` and ignored by ``learn_rules``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assimspark.llm.common import WORD, words_of

#: Fixed patterns of the base rules.
SYMBOL = r"[#*$%&|<>]"
SHORT_WORDS = 50
REPEAT_PERCENT = 50

#: The statistics that rules may test; each is a ratio or a count of the whole text.
FEATURES = ("n_words", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "word_length", "upper_ratio", "digit_ratio", "exclaim_ratio", "distinct_ratio", "line_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, prefix: str) -> Column:
        c = F.col(prefix + self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def mask(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each 3-word window of the array.

    Sorting (hash, position) later puts equal windows side by side; the flagged positions, in order, cover min(3, gap to the next) words.
    """
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def _flagged(ordered: Column) -> Column:
    """Positions of the windows that have an equal neighbour in an array sorted by (hash, position)."""
    return F.transform(ordered, lambda e, k: F.when((e["h"] == F.get(ordered, k - 1)["h"]) | (e["h"] == F.get(ordered, k + 1)["h"]), e["i"]))


def with_statistics(df: DataFrame, text_col: str = "text", prefix: str = "__q_") -> DataFrame:
    """The input with the base counts and the rule features of each text, in columns that start with ``prefix``."""
    p = lambda name: prefix + name
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [F.col(f"`{c}`") for c in df.columns]
    one = df.select(
        *keep,
        words_of(F.col(text_col)).alias(p("words")),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias(p("lines")),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias(p("n_symbols")),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias(p("n_upper")),
        F.regexp_count(text, F.lit(r"[0-9]")).cast("long").alias(p("n_digits")),
        F.regexp_count(text, F.lit(r"!")).cast("long").alias(p("n_exclaim")),
    )
    two = one.select(
        *keep,
        *(p(c) for c in ("n_symbols", "n_upper", "n_digits", "n_exclaim")),
        F.size(p("words")).cast("long").alias(p("n_words")),
        F.char_length(F.array_join(p("words"), "")).cast("long").alias(p("word_chars")),
        F.size(F.array_distinct(p("words"))).cast("long").alias(p("n_distinct")),
        F.size(p("lines")).cast("long").alias(p("n_lines")),
        (F.size(p("lines")) - F.size(F.array_distinct(p("lines")))).cast("long").alias(p("n_dup_lines")),
        window_hashes(F.col(p("words"))).alias(p("windows")),
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    pairs = F.transform(p("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct(p("windows"))) < F.size(p("windows"))
    sorted_ = two.withColumn(p("sorted"), F.when(repeats, F.array_sort(pairs)).otherwise(none)).drop(p("windows"))
    three = sorted_.withColumn(p("positions"), F.sort_array(F.array_compact(_flagged(F.col(p("sorted")))))).drop(p("sorted"))
    at = F.col(p("positions"))
    gaps = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_upper", "n_digits", "n_exclaim", "n_distinct", "n_lines")
    repeated = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g).alias(p("n_repeat_words"))
    # A generator of one row: filters on the statistics stay above it, where they are read and not worked out a second time.
    one_row = F.explode(F.array(F.struct(*(F.col(p(c)) for c in counts), repeated))).alias(p("all"))
    four = three.select(*keep, one_row).select(*keep, p("all") + ".*")
    n, chars = F.greatest(F.col(p("n_words")), F.lit(1)), F.greatest(F.col(p("word_chars")), F.lit(1))
    lines = F.greatest(F.col(p("n_lines")), F.lit(1))
    ratios = {
        "symbol_ratio": F.col(p("n_symbols")) / n,
        "dup_line_ratio": F.col(p("n_dup_lines")) / lines,
        "repeat_ratio": F.col(p("n_repeat_words")) / n,
        "word_length": F.col(p("word_chars")) / n,
        "upper_ratio": F.col(p("n_upper")) / chars,
        "digit_ratio": F.col(p("n_digits")) / chars,
        "exclaim_ratio": F.col(p("n_exclaim")) / n,
        "distinct_ratio": F.col(p("n_distinct")) / n,
        "line_words": F.col(p("n_words")) / lines,
    }
    failed = (F.col(p("n_words")) < SHORT_WORDS) | (100 * F.col(p("n_repeat_words")) > REPEAT_PERCENT * F.col(p("n_words")))
    return four.withColumns({p(k): v for k, v in ratios.items()} | {p("base_failed"): failed})


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], most: int) -> list[Condition]:
    """Add the threshold with the largest gain in information on bad rows until no good row is covered or nothing gains."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        if not p0:
            break
        now, best, pick = np.log2(p0 / (p0 + n0)), 1e-9, None
        for j, name in enumerate(FEATURES):
            edges = cuts[j]
            if not len(edges):
                continue
            slot = np.searchsorted(edges, x[inside, j], side="left")  # value <= edges[k] for slot <= k
            pos = np.bincount(slot[bad[inside]], minlength=len(edges) + 1).cumsum()[:-1]
            neg = np.bincount(slot[~bad[inside]], minlength=len(edges) + 1).cumsum()[:-1]
            for above, p, n in ((False, pos, neg), (True, p0 - pos, n0 - neg)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - now), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, pick = float(gain[k]), Condition(name, above, float(edges[k]))
        if pick is None:
            break
        rule.append(pick)
        inside &= pick.mask(x)
    return rule


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    inside = np.ones(len(x), bool)
    for c in rule:
        inside &= c.mask(x)
    return inside


def cover(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, max_rules: int = 12, max_conditions: int = 4, min_cover: int = 5) -> list[list[Condition]]:
    """Sequential covering: rules for ``bad`` rows, in the order found, until one falls under ``precision`` on the pruning third."""
    rules: list[list[Condition]] = []
    third = np.arange(len(x)) % 3 == 0
    left = np.ones(len(x), bool)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 129)[:-1])) if len(x) else np.array([]) for j in range(len(FEATURES))]
    while len(rules) < max_rules:
        grow, prune = left & ~third, left & third
        if bad[grow].sum() < min_cover:
            break
        rule = _grow(x[grow], bad[grow], cuts, max_conditions)
        worth, kept = -2.0, rule
        for length in range(len(rule), 0, -1):  # cut from the end; a shorter rule has to be at least as good
            inside = _covers(rule[:length], x[prune])
            p, n = int(bad[prune][inside].sum()), int((~bad[prune][inside]).sum())
            value = (p - n) / (p + n) if p + n else -1.0
            if value >= worth and p + n:
                worth, kept = value, rule[:length]
        inside = _covers(kept, x) & left
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not kept or p < min_cover or p < precision * (p + n) or (worth + 1) / 2 < precision:
            break
        rules.append(kept)
        left &= ~inside
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, precision: float = 0.9) -> list[list[Condition]]:
    """Learn the list from labelled documents.

    ``max_rows`` bounds the labelled sample that the driver sees (rows with the smallest hash of their id, so the same rows each time);
    only numbers travel: ten statistics and a label for each row. Text is scanned for those rows alone.
    """
    picked = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    seen = rows.groupBy("doc_id").agg(F.min_by(F.struct("__q_base_failed", "__label", *("__q_" + f for f in FEATURES)), F.xxhash64("text")).alias("r"))
    data = [tuple(r["r"])[1:] for r in seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect() if not r["r"][0]]
    if not data:
        return []
    table = np.array(data, dtype=float)
    bad = table[:, 0] == 0
    if bad.all() or not bad.any():
        return []
    return cover(table[:, 1:], bad, precision)


def verdict(rules: list[list[Condition]], prefix: str = "__q_") -> Column:
    """The list as one ordered expression: the number of the first rule that holds (from 1), 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        held = F.lit(True)
        for c in rules[k - 1]:
            held = held & c.column(prefix)
        out = F.when(held, F.lit(k)).otherwise(out)
    return out


def with_quality(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text", prefix: str = "__q_") -> DataFrame:
    """The documents with their statistics, the number of the rule that rejects them and the verdict (``prefix`` + rule, kept)."""
    out = with_statistics(docs, text_col, prefix).withColumn(prefix + "rule", verdict(rules, prefix))
    return out.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & (F.col(prefix + "rule") == 0))
