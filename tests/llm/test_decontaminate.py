import random

from assimspark.llm.decontaminate import Matcher, drop_leaks, find_leaks, myers, normalise

WORDS = [a + b for a in ("ba", "ko", "ri", "tu", "xe", "no") for b in ("ran", "sil", "tem", "vo", "dul", "pex")]


def brute(pattern, text):
    """Plain table: smallest distance of the pattern to a part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(1, len(text) - 1)
        text = rng.choice((text[:i] + rng.choice("abcxyz") + text[i:], text[:i] + text[i + 1:], text[:i] + rng.choice("abcxyz") + text[i + 1:]))
    return text


def test_myers_equals_the_table():
    rng = random.Random(3)
    for _ in range(300):
        p, t = ("".join(rng.choices("ab ", k=rng.randint(1, 12))) for _ in range(2))
        got = myers(p, t, len(p))
        assert (got[0] if got else len(p)) == brute(p, t)


def test_all_occurrences_within_budget_are_found(spark):
    rng = random.Random(11)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(10, 40)))) for i in range(12)]
    docs = []
    for d in range(120):
        body = [" ".join(rng.choices(WORDS, k=rng.randint(0, 60))) for _ in range(2)]
        if d % 2:
            item = normalise(items[d % 12][1]).strip()
            item = edited(rng, item, rng.randint(0, int(0.05 * len(item)) + 2))
            body.insert(1, item.upper().replace(" ", rng.choice(("  ", ",\n", " "))))
        docs.append((d, ". ".join(body), "en"))
    docs += [(500, None, None), (501, "", "x"), (502, items[0][1], "x"), (502, items[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, distance string")
    table = spark.createDataFrame([*items, (77, None), (78, " ,. ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in find_leaks(df, table, block_chars=1500).collect()}
    want = {}
    for d, t, _ in docs:
        for i, x in items:
            p = normalise(x)
            e = brute(p, normalise(t or ""))
            if e <= int(0.05 * len(p)):
                want[(d, i)] = e
    assert got == want and len(want) > 30
    kept = sorted(r["doc_id"] for r in drop_leaks(df, table).collect())
    assert kept == sorted(d for d, _, _ in docs if d not in {d for d, _ in want})


def test_places_and_empty_tables(spark):
    text = "Before it: Kotem, RIVO nosil\n(tupex) xeran badul. After"
    key, distance, a, b, k = Matcher([(5, "kotem rivo nosil tupex xeran badul")], 0.05).find(text)[0]
    assert (key, distance, text[a:b]) == (5, 0, "Kotem, RIVO nosil\n(tupex) xeran badul")
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert find_leaks(none, items).count() == 0 and find_leaks(items.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id")).count() == 0
