import re

from assimspark.llm.quality_rules import Condition, cover, learn_rules, with_quality
import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c", "x " * 60, "a b c d a b c\na b c d a b c\n\nq", "é # $ %\n é # $ %\né # $ %", "ab\x0bcd\x0cef\rgh",
    " ".join(str(i % 7) for i in range(400)), " ".join(str(i) for i in range(30_000)), "same line\nsame line\n same line\n\n \n",
]


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {w for w in windows if windows.count(w) > 1} if len(words) < 2000 else set()
    inside = {i + j for i, w in enumerate(windows) if w in hit for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed


def test_statistics_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, rule string")
    rows = {r["doc_id"]: r for r in with_quality(docs, []).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert tuple(r["__q_" + c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute(t), t
        assert r["rule"] == "kept" and r["__q_kept"] is (not r["__q_base_failed"])


def test_learned_list_separates_held_out_rows(spark):
    words = ["alpha", "beta", "gamma", "delta", "kappa", "sigma"]
    text = lambda i: " ".join(words[(i * 7 + j * j) % 6] + str(j) + ("###" if i % 4 == 0 else "") for j in range(80))
    docs = spark.createDataFrame([(i, text(i)) for i in range(240)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(120)] + [(None, 1, 0), (3, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    rules = learn_rules(docs, labels)
    assert rules
    kept = {r["doc_id"]: r["__q_kept"] for r in with_quality(docs, rules).collect()}
    assert all(kept[i] == (i % 4 != 0) for i in range(240))


def test_no_labels_gives_an_empty_list(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert learn_rules(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) == []


def test_cover_stops_when_nothing_is_precise():
    rng = np.random.default_rng(0)
    assert cover(rng.random((300, 10)), rng.random(300) < 0.5) == []
    assert Condition("n_words", True, 3.0).mask(np.full((1, 10), 4.0)).all()
