import random
import re
import textwrap

import numpy as np

from assimspark.llm.licences import FAMILIES, NEAR_MISSES, NOTICES, _grams, sample_paragraphs, scan, train

OTHER = ["the road to the river was long and the people of the town were out", "in version two of the story, she is free to go", "under the terms of their treaty the land was shared", "a copy of the letter was found"] * 30


def test_held_out_accuracy_and_unknowns():
    model = train(OTHER)
    rng = random.Random(99)
    good = total = 0
    for k, f in enumerate(FAMILIES[1:], 1):
        for n in NOTICES[f]:
            for _ in range(5):
                w = [x for x in n.split() if len(n.split()) < 8 or rng.random() > 0.03]
                family, chance, share = model.predict([" ".join(w).upper() + " " + rng.choice(OTHER)])
                total += 1
                good += family[0] == k and chance[0] >= 0.5 and share[0] >= 0.6
    assert good / total > 0.95
    family, chance, share = model.predict(OTHER[:4] + NEAR_MISSES + ["", " .. "])
    assert not ((family > 0) & (chance >= 0.5) & (share >= 0.7)).any()


def test_scan_places_and_nulls(spark):
    rows = [(1, "Some text here.\nReleased under the MIT License.\nMore"), (2, None), (3, ""), (4, "é\n\nLicensed under CC BY-NC 4.0."), (4, "é\n\nLicensed under CC BY-NC 4.0."), (5, "plain " * 20_000)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, family string")
    got = [tuple(r)[:5] for r in scan(docs).collect()]
    assert sorted(got) == [(1, 1, 16, 47, "MIT"), (4, 2, 3, 31, "CC-BY-NC"), (4, 2, 3, 31, "CC-BY-NC")]
    assert scan(docs.where("doc_id = 0")).count() == 0 and sample_paragraphs(docs.where("doc_id = 2")) == []


def test_all_notices_of_the_given_documents_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary"}
    planted = sorted((r["doc_id"], want[line]) for r in docs.collect() for line in (r["text"] or "").split("\n") if line in want)
    found = sorted((r["doc_id"], r["family"]) for r in scan(docs).collect())
    assert planted and planted == found


def test_wrapped_notices_have_exact_places(spark):
    rows = []
    for f in FAMILIES[1:]:
        for n in NOTICES[f]:
            for width, mark in ((34, ""), (60, " * "), (72, "# ")):
                rows.append((len(rows), "A head\n\n" + textwrap.fill("Copyright 2020 by someone " + n + " and so on", width, initial_indent=mark, subsequent_indent=mark, break_on_hyphens=False) + "\n\nend", f, n))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan(docs, train(OTHER)).collect()}
    assert len(got) == scan(docs, train(OTHER)).count() == len(rows)
    for k, t, f, n in rows:
        assert got[k]["family"] == f and got[k]["paragraph"] == t[:got[k]["start"]].count("\n")
        found = " ".join(w for w in t[got[k]["start"]:got[k]["end"]].split() if w not in "*#")
        assert found.strip(".,") == n.strip(".,")


def test_every_notice_of_a_line_and_of_a_text_without_breaks(spark):
    texts = ["Licensed under the MIT license or the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 or the MIT license", "plain words " * 300 + "Released under the MIT License. Then more. Licensed under CC BY-SA 4.0. " + "plain words " * 300 + "All rights reserved.", "Released under the\n\nMIT License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["end"], r["family"]) for r in scan(docs, train(OTHER)).collect())
    place = lambda n: (texts[2].index(n), texts[2].index(n) + len(n))
    assert sorted((d, f) for d, *_, f in got if d < 2) == [(0, "Apache-2.0"), (0, "MIT"), (1, "Apache-2.0"), (1, "MIT")]
    assert [(a, b, f) for d, a, b, f in got if d >= 2] == [(*place("Released under the MIT License."), "MIT"), (*place("Licensed under CC BY-SA 4.0."), "CC-BY-SA"), (*place("All rights reserved."), "Proprietary")]


def plain_grams(words, most=3):
    return {" ".join(words[i:i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)}


def plain_words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())


def test_scores_equal_brute_force():
    model = train(OTHER, copies=4, rounds=20)
    notices = [(k, n) for k, f in enumerate(FAMILIES) for n in NOTICES.get(f, [])]
    row_of = {}
    for g in {g for _, n in notices for g in plain_grams(plain_words(n))}:
        row_of[g] = int(np.searchsorted(model.vocabulary, _grams([g])[0][-1]))  # the last of its n-grams is the whole
    assert sorted(row_of.values()) == list(range(len(model.vocabulary)))
    rng = random.Random(3)
    texts = OTHER[:4] + NEAR_MISSES + ["", "é & x"]
    texts += [" ".join(w for w in n.split() if rng.random() > 0.2) + rng.choice([" Die Köpfe.", "", " and\nmore"]) for _, n in notices]
    family, chance, share = model.predict(texts)
    for t, f, c, s in zip(texts, family, chance, share):
        grams = plain_grams(plain_words(t))
        z = model.bias + sum((model.weights[row_of[g]] for g in grams if g in row_of), np.zeros(len(FAMILIES)))
        p = np.exp((z - z.max()) / model.temperature)
        p /= p.sum()
        assert f == p.argmax() and np.isclose(c, p.max())
        assert not f or np.isclose(s, max(len(grams & own) / len(own) for k, n in notices if k == f for own in [plain_grams(plain_words(n))]))


def test_candidates_are_found_where_a_window_holds_enough():
    model = train(OTHER, copies=2, rounds=2)
    templates, rng = model.templates(0.7), random.Random(8)
    notices = [n for f in FAMILIES for n in NOTICES.get(f, [])]
    texts = [" ".join([rng.choice(OTHER), *(w for w in rng.choice(notices).split() if rng.random() > rng.choice([0.02, 0.1, 0.2])), rng.choice(OTHER)]) for _ in range(150)]
    found = {i: {f for _, f, *_ in out} for i, out, _ in model.candidates(texts, templates, 0.7)}
    n_both = 0
    for i, t in enumerate(texts):
        words, want = plain_words(t), set()
        for (family, _, _, width, _), n in zip(templates, notices):
            own = plain_grams(plain_words(n))
            if any(len(plain_grams(words[a:a + width]) & own) >= 0.7 * len(own) - 1e-9 for a in range(len(words))):
                want.add(family)
        assert found.get(i, set()) == want, t
        n_both += bool(want)
    assert 20 < n_both < 150


def test_a_family_needs_its_own_words(spark):
    shared = "under the terms of the GNU General Public License as published by the Free Software Foundation"
    want = {
        shared: "GPL", shared + "; either version 2 of the License": "GPL-2.0", shared + ", either version 3 of the License, or later": "GPL-3.0", shared.replace("General", "Lesser General"): "LGPL", shared.replace("General", "Affero General"): "AGPL-3.0",
        "This project is MIT licensed": "MIT", "License: MIT": "MIT", "Apache License 2.0": "Apache-2.0", "GPLv3": "GPL-3.0", "License: GPLv2": "GPL-2.0", "the code is GPLv3 and nothing else": "GPL-3.0",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "doc_id long, text string")
    found = {}
    for r in scan(docs, train(OTHER)).collect():
        found.setdefault(r["doc_id"], []).append(r["family"])
    assert [found.get(i) for i in range(len(want))] == [[f] for f in want.values()]
