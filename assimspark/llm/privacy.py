"""Personal data: pattern spans, and terms that give protected entities away.

Four kinds of spans are found by pattern (email, ip, card, phone): leftmost, non-overlapping within a kind; matches that fail their check are
dropped and not retried. On top, terms are weighed by information: an entity is one found value (the address or number itself), and a term
co-occurs with it when it stands within ``window`` words of the value. From document counts over the whole corpus

    PMI(term; entity) = log( n(term, entity) * N / (n(term) * n(entity)) )

says how much a term reveals of the IC(entity) = log(N / n(entity)) that there is to know. What the term leaves hidden is the difference,
IC - PMI = -log P(entity | term), which doesn't depend on the size of the corpus. P(entity | term) is taken at its lower confidence bound (Wilson,
``z`` deviations), where documents that repeat a context count as one, so evidence is what counts: one sighting alone leaves 1 bit hidden, two
leave 0.58, four 0.32. A term that leaves at most ``disclosure`` bits hidden, and reveals something at all (PMI > 0), is a span of kind ``term`` in
the documents where it stands near that entity. ``sanitise`` replaces values by the name of their kind; a term is generalised to its shape
(Xx9), and one that leaves at most ``removal`` bits hidden is removed and [TERM] left in its place.

All work is DataFrame expressions. Null text counts as empty; repeated rows are handled row by row; an empty table gives no rows; other
columns pass through ``with_spans`` and ``sanitise``. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assimspark.llm.common import WORD, materialise

#: Fixed patterns. Each equals the plain form in the comment on leftmost matches; look-behind or the end of the last match (\G) keeps a long
#: run from being tried at each of its characters, and possessive loops keep the matcher's stack flat.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the right, every second digit doubled (less 9 above 9); the sum is a multiple of 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":  # at most 255 whatever the number of leading zeros
        return F.forall(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "").rlike(r"^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(16, 19) & _luhn(_digits(value))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _first_sign(kind: str, text: Column) -> Column:
    """A cheap test that any text with a match passes."""
    return {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.rlike(r"\+[0-9]")}[kind]


def with_base_spans(df: DataFrame, text_col: str = "text", prefix: str = "__p_") -> DataFrame:
    """Adds prefix + "base": the pattern spans by kind as listed, then start.

    The pieces between matches and the matches alternate, so a match starts after all earlier pieces and matches.
    """
    text, keep = F.coalesce(F.col(text_col), F.lit("")), [F.col(f"`{c}`") for c in df.columns]
    none, nothing = F.array().cast("array<string>"), F.array().cast(SPAN)
    p = lambda n: prefix + n
    one = df.select(*keep, *(F.when(_first_sign(k, text), F.split(text, PATTERNS[k], -1)).otherwise(none).alias(p("gap_" + k)) for k in KINDS), *(F.when(_first_sign(k, text), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(p("hit_" + k)) for k in KINDS))

    def spans(kind: str) -> Column:
        gaps, hits = F.col(p("gap_" + kind)), F.col(p("hit_" + kind))
        begun = F.struct(F.lit(0).alias("at"), nothing.alias("found"))
        rows = F.transform(hits, lambda v, i: F.struct(v.alias("value"), F.length(F.get(gaps, i)).alias("gap"), F.length(v).alias("size"), _passes(kind, v).alias("good")))
        span = lambda a, h: F.struct(F.lit(kind).alias("kind"), (a["at"] + h["gap"]).alias("start"), (a["at"] + h["gap"] + h["size"]).alias("end"), h["value"].alias("value"))
        move = lambda a, h: F.struct((a["at"] + h["gap"] + h["size"]).alias("at"), F.when(h["good"], F.concat(a["found"], F.array(span(a, h)))).otherwise(a["found"]).alias("found"))
        return F.aggregate(rows, begun, move, lambda a: a["found"])

    two = one.select(*keep, F.explode(F.array(F.concat(*(F.when(F.size(p("hit_" + k)) > 0, spans(k)).otherwise(nothing) for k in KINDS)))).alias(p("base")))
    return two


def _words_with_places(text: Column) -> tuple[Column, Column]:
    return F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def term_of(word: Column) -> Column:
    """A word in lower case without punctuation at its ends."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def contexts(spanned: DataFrame, key: Column, text_col: str = "text", prefix: str = "__p_", window: int = 5) -> DataFrame:
    """(key, entity, term, start, end, context): the terms near each pattern span, with their places in the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_span = spanned.where(F.size(prefix + "base") > 0).select(key.alias("key"), text.alias("text"), F.explode(prefix + "base").alias("s"))
    # Words are looked for in the part of the text beside the span only; where its 80 code points a word don't hold the words wanted and one
    # more (which may be cut), in all of that side.
    side = 80 * window
    begin = f"greatest(s.start - {side}, 0)"
    parts = with_span.select("key", "text", "s", F.expr(f"substring(text, {begin} + 1, s.start - {begin})").alias("before"), F.expr(f"substring(text, s.end + 1, {side})").alias("after"))
    enough = lambda part: F.size(F.regexp_extract_all(part, F.lit(WORD), F.lit(0))) > window
    whole = parts.select(
        "key", "s",
        F.when((F.col("s.start") <= side) | enough(F.col("before")), F.col("before")).otherwise(F.expr("substring(text, 1, s.start)")).alias("before"),
        F.when((F.length("text") <= F.col("s.end") + side) | enough(F.col("after")), F.col("after")).otherwise(F.expr("substring(text, s.end + 1)")).alias("after"),
    )
    halves = whole.select(
        "key", "s",
        F.array(
            F.struct((F.col("s.start") - F.length("before")).alias("at"), F.col("before").alias("part"), F.lit(True).alias("left")),
            F.struct(F.col("s.end").alias("at"), F.col("after").alias("part"), F.lit(False).alias("left")),
        ).alias("halves"),
    ).select("key", "s", F.explode("halves").alias("h")).select("key", "s", "h.at", "h.left", *(c.alias(n) for c, n in zip(_words_with_places(F.col("h.part")), ("gaps", "words"))))
    # start of word i in its part: all gaps up to i and all words before i
    placed = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.aggregate(F.slice("gaps", F.lit(1), i + 1), F.col("at"), lambda a, g: a + F.length(g)).alias("a"), F.aggregate(F.slice("words", F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g)).alias("b")))
    near = halves.select("key", "s", "left", placed.alias("words")).select("key", "s", F.when(F.col("left"), F.slice("words", F.greatest(F.size("words") - window + 1, F.lit(1)), F.lit(window))).otherwise(F.slice("words", F.lit(1), F.lit(window))).alias("near"))
    entity = F.xxhash64("s.kind", F.lower("s.value"))
    rows = near.select("key", entity.alias("entity"), F.xxhash64(F.transform("near", lambda x: x["word"])).alias("context"), F.explode("near").alias("x"))
    out = rows.select("key", "entity", "context", F.xxhash64(term_of(F.col("x.word"))).alias("term"), (F.col("x.a") + F.col("x.b")).alias("start"), (F.col("x.a") + F.col("x.b") + F.length("x.word")).alias("end"), term_of(F.col("x.word")).alias("bare"))
    return out.where((F.length("bare") > 0) & ~F.col("bare").rlike(r"[@]|^[0-9.+() -]*$")).drop("bare")


def disclosing_terms(docs: DataFrame, near: DataFrame, text_col: str = "text", disclosure: float = 0.75, removal: float = 0.35, z: float = 1.0) -> DataFrame:
    """(entity, term) pairs that leave few bits hidden, from document counts of the whole corpus; removed tells those that leave fewest.

    All terms are hashed and counted within their partition first, so what is shuffled is at most one row for each term and task. Terms of
    more than a hundredth of the documents (at most a hundred times the distinct words of a document) are joined by broadcast, since pairs
    with them are many; the join with the others sees one row for each term.
    """
    pairs = materialise(near.groupBy("entity", "term").agg(F.countDistinct("key").alias("n_both"), F.countDistinct("context").alias("n_contexts")), "privacy-pairs")
    entities = near.select("key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(term_of(w))))).alias("term"))
    counts = materialise(words.groupBy("term").agg(F.count("*").alias("n_term")), "privacy-counts")
    n_all = docs.count()
    common = F.broadcast(counts.where(F.col("n_term") * 100 > n_all))
    rare = counts.where(F.col("n_term") * 100 <= n_all)
    met = pairs.join(common, "term").unionByName(pairs.join(common, "term", "left_anti").join(rare, "term"))
    scored = met.join(entities, "entity")
    share, n = F.col("n_both") / F.col("n_term"), F.col("n_term") * F.least(F.col("n_contexts"), F.col("n_both")) / F.col("n_both")
    bound = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    hidden = -F.log2(F.greatest(bound, F.lit(1e-300)))
    pmi = F.log2(F.lit(float(n_all)) / F.col("n_entity")) - hidden
    return scored.select("entity", "term", pmi.alias("pmi"), hidden.alias("hidden")).where((F.col("hidden") <= disclosure) & (F.col("pmi") > 0)).withColumn("removed", F.col("hidden") <= removal)


def with_spans(docs: DataFrame, key: str = "doc_id", text_col: str = "text", prefix: str = "__p_", window: int = 5, disclosure: float = 0.75, removal: float = 0.35, z: float = 1.0) -> DataFrame:
    """The documents with prefix + "base" (pattern spans) and prefix + "terms" (spans the method adds, none inside a pattern span)."""
    based = with_base_spans(docs, text_col, prefix)
    row_id = F.xxhash64(F.col(key), F.col(text_col))  # rows that share a key are told apart by their text
    near = materialise(contexts(based, row_id, text_col, prefix, window), "privacy-contexts")
    found = disclosing_terms(docs, near, text_col, disclosure, removal, z)
    spans = near.join(found, ["entity", "term"]).groupBy("key", "start", "end").agg(F.max("removed").alias("removed"))
    by_key = spans.groupBy(F.col("key").alias(prefix + "key")).agg(F.array_sort(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end", "removed"))).alias(prefix + "near"))
    terms = F.filter(F.coalesce(F.col(prefix + "near"), F.array().cast("array<struct<kind:string,start:int,end:int,removed:boolean>>")), lambda t: ~F.exists(prefix + "base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return based.join(by_key, row_id == F.col(prefix + "key"), "left").select(*(F.col(f"`{c}`") for c in based.columns), terms.alias(prefix + "terms"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def shape(term: Column) -> Column:
    """Xx9: runs of capitals, other letters and digits; other characters stay."""
    for pattern, sign in ((r"\p{Lu}+", "X"), (r"[\p{L}&&[^X]]+", "x"), (r"\p{N}+", "9")):
        term = F.regexp_replace(term, pattern, sign)
    return term


def sanitise(docs: DataFrame, key: str = "doc_id", text_col: str = "text", prefix: str = "__p_", **how) -> DataFrame:
    """The documents with values replaced by their kind ("[EMAIL]"), disclosing terms removed ("[TERM]") or generalised to their shape; all columns stay.

    Overlapping spans are replaced once, by the one that starts first (the longer of two that start together).
    """
    spanned = with_spans(docs, key, text_col, prefix, **how)
    text = F.coalesce(F.col(text_col), F.lit(""))
    span = lambda s, new: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), new.alias("new"))
    named = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    values = F.transform(prefix + "base", lambda s: span(s, named(s)))
    terms = F.transform(prefix + "terms", lambda s: span(s, F.when(s["removed"], named(s)).otherwise(shape(F.substr(text, s["start"] + 1, s["end"] - s["start"])))))
    begun = spanned.withColumn(prefix + "every", F.array_sort(F.concat(values, terms)))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    move = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], -s["neg"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct((-s["neg"]).alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), s["new"]).alias("out")))
    joined = F.aggregate(prefix + "every", first, move, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    clean = F.when(F.size(prefix + "every") > 0, joined).otherwise(F.col(text_col))
    return begun.select(*((clean if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns))
