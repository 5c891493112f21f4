import random

import corpus_pipeline
from assimspark.llm.near_join import one_of_each

from tests.llm.test_near_join import shingles
from tests.llm.test_tokens import ids_of


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "elo", "imi", "oru", "upan")]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(n))
    base = [text(rng.randint(60, 140)) for _ in range(60)]
    rows = {i: t for i, t in enumerate(base)}
    item = "the question of the old harbour was never asked in any of these tests before"
    for i in range(8):  # copies and near copies
        rows[100 + i] = base[i]
        rows[200 + i] = base[i] + " more"
    rows[300] = base[20] + ". The QUESTION of the old harbour was never asked, in any of these tests before. " + text(30)
    rows[301] = text(80) + " call +1 (017) 555-7713 or mail an.na@mail.example.com now"
    rows |= {400: "too short", 401: "same words here " * 60, 402: None, 403: ""}
    rows |= {500 + i: " ".join(w + "###" for w in text(70).split()) for i in range(20)}
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    for name, df in (("documents", docs), ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string")), ("labels", spark.createDataFrame([(d, 0 if d >= 500 else 1, 0) for d in [*range(60), *range(500, 520)]], "doc_id long, quality int, toxic int"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs, got = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
        got[name] = docs
    good = {d: t for d, t in rows.items() if d < 400}
    assert {r["doc_id"]: r["text"] for r in got["quality_rules"].collect()} == good
    sets = {d: shingles(t) for d, t in good.items()}
    dropped = {d for d in good for e in good if e < d and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e])}
    assert {r["doc_id"] for r in got["near_join"].collect()} == good.keys() - dropped and len(dropped) == 16
    assert {r["doc_id"] for r in got["decontaminate"].collect()} == good.keys() - dropped - {300}
    clean = {r["doc_id"]: r for r in got["privacy"].collect()}
    assert got["privacy"].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert clean[301]["text"].endswith("call [PHONE] or mail [EMAIL] now") and clean[301]["n_chars"] == len(clean[301]["text"])
    assert all(clean[d]["text"] == good[d] for d in clean if d != 301)
    pieces = got["packing"].collect()
    assert {d: sum(r["length"] for r in pieces if r["doc_id"] == d) for d in clean} == {d: len(ids_of(r["text"])) + 1 for d, r in clean.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_one_of_each_with_shared_and_missing_ids(spark):
    text = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(5, text, 1), (3, text, 2), (3, "another one", 3), (None, text, 4), (8, None, 5)], "doc_id long, text string, x int")
    assert sorted((str(r["doc_id"]) for r in one_of_each(df).collect())) == ["3", "8", "None"]


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
