import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from assimspark.llm.privacy import KINDS, contexts, sanitise, with_base_spans, with_spans

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else None, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PLAIN[k], text or "") if good(k, m[0])]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    texts = [None, "", "é a@b.c+d@e.f ü", "x@y", "+1 (017) 555-7713 or 4111 1111 1111 1111.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.1", "a" * 50_000 + "@b.cc", "1" * 60_000, "1 " * 20_000, "a." * 20_000 + "@x" + ".y" * 20_000, "\U0001f600 4539-5787-6362-1486 +12345678"]
    alphabet = ["a", "b.", "@", "1", "22", ".", "-", " ", "+", "(", ")", "_", "4111111111111111", "1.2.3.4", "é", "%", "\n", "@x.y"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    rows = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["__p_base"]] for r in with_base_spans(df).collect()}
    for i, t in enumerate(texts):
        assert rows[i] == brute(t), t


def test_revealing_terms_are_added_and_replaced(spark):
    rows = [(i, f"alpha{i} beta{i} the zorblax writes from me@home.org to the office number{i} the end", "s") for i in range(6)]
    rows += [(100 + i, f"some other text the writes from to office end {i} the", "s") for i in range(60)] + [(200, None, None), (201, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in with_spans(docs).collect()}
    texts = dict((a, b) for a, b, _ in rows)
    assert all([texts[i][t["start"]:t["end"]] for t in found[i]["__p_terms"]] == ["zorblax"] for i in range(6))
    assert all(not found[100 + i]["__p_terms"] for i in range(60)) and found[200]["__p_base"] == []
    clean = {r["doc_id"]: r for r in sanitise(docs).collect()}
    assert clean[0]["text"] == "alpha0 beta0 the [TERM] writes from [EMAIL] to the office number0 the end"
    assert clean[0].asDict().keys() == {"doc_id", "text", "source"} and clean[200]["text"] is None and clean[100]["text"] == texts[100]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert with_spans(docs).count() == 0 and sanitise(docs).count() == 0


def test_evidence_counts_and_not_the_size_of_the_corpus(spark):
    """The same sightings give the same verdict at N and 100 N: one is no evidence, two contexts generalise, four remove, copies of a context add nothing."""
    common = "some other text the writes from to office end"
    sightings = {"Once1": (1, 1), "Qu7x": (2, 1), "Zeb9": (4, 1), "Copy5": (1, 6)}
    for n in (100, 10_000):
        rows = []
        for k, (word, (contexts_, copies)) in enumerate(sightings.items()):
            for c in range(contexts_):
                rows += [(len(rows), f"the{k}{c} {word} from v{k}@one.org end", "s")] * copies
        rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
        many = spark.range(len(rows), n).select(F.col("id").alias("doc_id"), F.lit(common).alias("text"), F.lit(None).cast("string").alias("source"))
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").unionAll(many)
        got = {r["doc_id"]: r["text"] for r in sanitise(docs, window=3).where(f"doc_id < {len(rows)}").collect()}
        for i, t, _ in rows:
            word = t.split()[1]
            assert got[i].split()[1] == {"Once1": "Once1", "Qu7x": "Xx9x", "Zeb9": "[TERM]", "Copy5": "Copy5"}[word], (n, t, got[i])
            assert "[EMAIL]" in got[i] and got[i].split()[0] == t.split()[0]


def test_planted_names_are_found_and_little_else(spark):
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    rows, names = [], {f"name{k}q" for k in range(60)}
    for i in range(1500):
        words = rng.choices(vocabulary, k=40)
        if i < 300:
            words[20:20] = [f"name{i % 60}q", rng.choice(vocabulary), f"u{i % 60}@mail.org"]
        rows.append((i, " ".join(words)))
    found = [t[s["start"]:s["end"]] for (i, t), r in zip(rows, sorted(with_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())) for s in r["__p_terms"]]
    right = sum(f in names for f in found)
    assert right == 300 and right / len(found) >= 0.95


def test_five_whole_words_of_any_length(spark):
    long = "w" * 500
    text = f"far one two {long} three four a@b.cc five six {long} seven eight far"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    near = contexts(with_base_spans(docs), F.col("doc_id"))
    assert sorted(text[r["start"]:r["end"]] for r in near.collect()) == sorted(["one", "two", long, "three", "four", "five", "six", long, "seven", "eight"])


def brute_spans(text):
    return [(k, a, b, text[a:b]) for k, a, b in brute(text)]


def plain_terms(rows, window=5, disclosure=0.75, removal=0.35, z=1.0):
    """The added spans of each document (doc_id, text), by plain loops over the formulas of the module's docstring."""
    bare = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w.lower())
    near, n_term = [], Counter()
    for d, text in rows:
        n_term.update({bare(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)})
        for kind, a, b, value in brute_spans(text):
            left = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text[:a])][-window:]
            right = [(m[0], b + m.start(), b + m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text[b:])][:window]
            for half in (left, right):
                context = tuple(w for w, _, _ in half)
                for w, i, j in half:
                    if bare(w) and "@" not in bare(w) and not re.fullmatch(r"[0-9.+() -]*", bare(w)):
                        near.append(((d, text), (kind, value.lower()), bare(w), context, i, j))
    docs_of, contexts_of, docs_with = defaultdict(set), defaultdict(set), defaultdict(set)
    for key, entity, term, context, _, _ in near:
        docs_of[entity, term].add(key)
        contexts_of[entity, term].add(context)
        docs_with[entity].add(key)
    found = {}
    for (entity, term), keys in docs_of.items():
        n_both, n, n_entity = len(keys), n_term[term], len(docs_with[entity])
        share, size = n_both / n, n * min(len(contexts_of[entity, term]), n_both) / n_both
        bound = (share + z * z / (2 * size) - z * math.sqrt(share * (1 - share) / size + z * z / (4 * size * size))) / (1 + z * z / size)
        hidden = -math.log2(max(bound, 1e-300))
        if hidden <= disclosure and math.log2(len(rows) / n_entity) > hidden:
            found[entity, term] = hidden <= removal
    spans = defaultdict(dict)
    for (d, text), entity, term, _, i, j in near:
        if (entity, term) in found and not any(i < b and a < j for _, a, b, _ in brute_spans(text)):
            spans[d][i, j] = spans[d].get((i, j), False) or found[entity, term]
    return spans, len(docs_of), len(found)


def test_terms_equal_brute_force_on_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    crafted = [(10**6 + k, f"Contact zq{k % 7}name at u{k % 7}@mail.example.com or zq{k % 7}name again, filler{k} words{k} here{k}") for k in range(40)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(crafted, "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want, n_pairs, n_found = plain_terms(rows)
    got = {r["doc_id"]: r["__p_terms"] for r in with_spans(docs).collect()}
    assert n_pairs > n_found > 0
    for d, _ in rows:
        assert {(t["start"], t["end"]): t["removed"] for t in got[d]} == dict(want.get(d, {})), d


def test_repeated_rows_and_clashing_columns(spark):
    text = "call bob at +49 30 1234567 now"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (1, "other +49 30 1234567", "y")], "doc_id long, text string, start string")
    got = with_spans(df).collect()
    assert len(got) == 3 and sorted(r["start"] for r in got) == ["x", "x", "y"] and all(len(r["__p_base"]) == 1 for r in got)
