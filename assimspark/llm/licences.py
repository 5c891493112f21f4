"""Licence scans: notices found by templates in paragraphs, judged by a trained classifier.

A paragraph is a run of non-blank lines. Over its words a window slides for each notice below; where the window holds at least ``confirm`` of
the notice's word 1- to 3-grams, the shortest run of words with as many of them is a candidate, so wrapped notices and notices amid other
text are found with exact places. Candidates are scored by a multinomial logistic regression over sparse word 1- to 3-grams, trained on the
notices, broken and embedded at random, against paragraphs of the corpus and near misses; "unknown" is a class of its own, and all scores
are calibrated by a temperature fitted on examples held out from training.

A candidate must hold the words of its notice that a much alike notice of another family lacks (``Lesser``, or the version), else it is none.
Candidates are taken by falling share, of equal shares the longer notice first. Of those of one family that overlap one is kept. One that overlaps no other family counts when its
probability reaches ``least``. One that overlaps another family (a dual licence) counts when it holds at least ``confirm`` of the n-grams that
set it apart from all notices of each family it overlaps; its probability is that of any family, since the words speak for both.

Only texts in which some window holds enough known 2- and 3-grams are looked at closely; no candidate can be elsewhere. A null text has no
paragraphs; repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assimspark.llm.common import small_batches
from assimspark.llm.shingles import STEP, mix, word_hashes

#: Fixed texts: customary notices of each family.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "This project is MIT licensed.", "License: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license.", "Apache License 2.0", "License: Apache 2.0", "Apache License, Version 2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL v3.", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "GPLv3", "License: GPLv3", "Licensed under the GPLv3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GPL v2.", "GPLv2", "License: GPLv2", "Licensed under the GPLv2."],
    "GPL": ["under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GNU General Public License."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 3.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "SPDX-License-Identifier: LGPL-2.1-only"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "License: BSD", "This project is BSD licensed."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "ISC": ["Released under the ISC license.", "Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"],
    "Zlib": ["Released under the zlib license.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "SPDX-License-Identifier: Zlib"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
#: Fixed texts: sentences with licence words that grant nothing.
NEAR_MISSES = [
    "Her driving license was renewed in May.", "The bar is fully licensed and open until ten.", "The general public was invited to the release.", "Version 2.0 of the form is due in April.",
    "He studied at MIT and released a record.", "The apache helicopter flew under the bridge.", "All rights of way are reserved for walkers.", "This program is free for any person under ten.",
    "The software is released in version 3.", "Please use this file in compliance with the rules of the house.", "Copy of the documents was obtained free of charge.", "The creative work is published in the public library.",
]
FAMILIES = ["unknown", *NOTICES]


def _all_notices() -> list[str]:
    return [n for f in FAMILIES for n in NOTICES.get(f, [])]


_PLAIN = bytes(c if chr(c).isalnum() or c in (9, 10, 11, 12, 13, 32) or c > 127 else 32 for c in range(256))


#: The words of a text as _PLAIN leaves them, and the lines between two blank ones.
_WORDS = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
_PARAGRAPH = re.compile(r"[^\n]*[^\s][^\n]*(?:\n[^\n]*[^\s][^\n]*)*")


def _placed_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all 1- to 3-grams of lower-case words without punctuation, the text each belongs to, its first word (from 0 in its text) and its size."""
    plain = [t.encode("utf-8", "surrogatepass").translate(_PLAIN).decode("utf-8", "surrogatepass") for t in texts]
    with np.errstate(over="ignore"):
        words, starts = word_hashes(plain)
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        place = np.arange(len(words)) - starts[owner]
        grams, of, first, size = [words], [owner], [place], [np.ones(len(words), int)]
        rolled = words
        for k in (1, 2):
            if len(words) <= k:
                break
            rolled = mix(rolled[:-1] * np.uint64(STEP) + words[k:])
            same = owner[:-k] == owner[k:]
            grams.append(rolled[same])
            of.append(owner[:-k][same])
            first.append(place[:-k][same])
            size.append(np.full(int(same.sum()), k + 1))
    return np.concatenate(grams), np.concatenate(of), np.concatenate(first), np.concatenate(size)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of _placed_grams, and the text each belongs to."""
    return _placed_grams(texts)[:2]


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray  # n-gram x family
    bias: np.ndarray
    temperature: float
    notices: list[tuple[int, np.ndarray]]  # family, positions of its n-grams in the vocabulary
    told: list[list[np.ndarray]] | None = None  # what telling() has found

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, position) of the known n-grams, each once for a text."""
        grams, of = _grams(texts)
        if not len(grams):
            return np.zeros(0, int), np.zeros(0, int)
        at = np.searchsorted(self.vocabulary, grams)
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == grams
        pair = np.unique(of[known].astype(np.int64) * len(self.vocabulary) + at[known])
        return pair // len(self.vocabulary), pair % len(self.vocabulary)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Family, probability and share of the best notice of that family."""
        of, at = self.features(texts)
        p = self.probabilities(texts)
        family = p.argmax(axis=1)
        share = np.zeros(len(texts))
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        for i in np.flatnonzero(family):
            mine = at[bounds[i]:bounds[i + 1]]
            share[i] = max(np.isin(n, mine).mean() for f, n in self.notices if f == family[i])
        return family, p[np.arange(len(texts)), family], share

    def probabilities(self, texts: list[str]) -> np.ndarray:
        of, at = self.features(texts)
        logits = np.tile(self.bias, (len(texts), 1))
        np.add.at(logits, of, self.weights[at])
        p = np.exp((logits - logits.max(axis=1, keepdims=True)) / self.temperature)
        return p / p.sum(axis=1, keepdims=True)

    def _known(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Position in the vocabulary, text, first word and size of the known n-grams, by place."""
        grams, of, first, size = _placed_grams(texts)
        at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == grams)
        known = known[np.lexsort((size[known], first[known], of[known]))]
        return at[known], of[known], first[known], size[known]

    def templates(self, confirm: float) -> list[tuple[int, np.ndarray, np.ndarray, int, int]]:
        """For each notice its family, n-grams, those as a mask, the widest window and the 2- and 3-grams it needs besides all its words (0 if it is one word)."""
        out = []
        for (family, grams), text in zip(self.notices, _all_notices()):
            mask, words = np.zeros(len(self.vocabulary), bool), _placed_grams([text])
            mask[grams] = True
            n = int((words[3] == 1).sum())
            singles = len(np.unique(words[0][words[3] == 1]))
            out.append((family, grams, mask, n + n // 2 + 8, max(1, int(np.ceil(confirm * len(grams) - 1e-9)) - singles) if n > 1 else 0))
        return out

    def telling(self, alike: float = 0.6) -> list[list[np.ndarray]]:
        """For each notice, its words that a notice of another family lacks, for each of those that holds at least ``alike`` of its n-grams. Found once."""
        if self.told is not None:
            return self.told
        words = [np.searchsorted(self.vocabulary, np.unique(g[0][g[3] == 1])) for g in (_placed_grams([text]) for text in _all_notices())]
        out = []
        for (family, grams), own in zip(self.notices, words):
            rivals = [np.setdiff1d(own, theirs) for (f, n), theirs in zip(self.notices, words) if f != family and np.isin(grams, n).mean() >= alike]
            out.append([r for r in rivals if len(r)])
        self.told = out
        return out

    def may_hold(self, texts: list[str], templates: list) -> np.ndarray:
        """The texts in which a window has enough 2- and 3-grams of some notice."""
        at, of, first, size = self._known(texts)
        found, longer = np.zeros(len(texts), bool), size > 1
        for _, _, mask, _, need in templates:
            if not need:
                found[of[mask[at]]] = True
        at, of, first = at[longer], of[longer], first[longer]
        for _, _, mask, width, need in (t for t in templates if t[-1]):
            mine = np.flatnonzero(mask[at])
            if len(mine) >= need:
                a, b = mine[:len(mine) - need + 1], mine[need - 1:]
                found[of[a[(of[a] == of[b]) & (first[b] - first[a] < width)]]] = True
        return np.flatnonzero(found)

    def candidates(self, texts: list[str], templates: list, confirm: float) -> Iterator[tuple[int, list[tuple[float, int, int, int, int, int]], list[tuple[int, int, int]]]]:
        """For each text with any: its number, the candidates (share, family, first word, word after the last, n-grams of the notice, its number) and its known n-grams (position, first word, word after)."""
        at, of, first, size = self._known(texts)
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            mine = slice(bounds[i], bounds[i + 1])
            if bounds[i] == bounds[i + 1]:
                continue
            g, a, e, out = at[mine], first[mine], first[mine] + size[mine], []
            for t, (family, grams, mask, width, _) in enumerate(templates):
                has = mask[g]
                if len(np.unique(g[has])) >= confirm * len(grams) - 1e-9:
                    out += [(share, family, x, y, len(grams), t) for share, x, y in _windows(g[has].tolist(), a[has].tolist(), e[has].tolist(), len(grams), width, confirm)]
            if out:
                yield i, out, list(zip(g.tolist(), a.tolist(), e.tolist()))


def _windows(g: list[int], a: list[int], e: list[int], size: int, width: int, confirm: float) -> list[tuple[float, int, int]]:
    """(share, first word, word after the last) of windows that hold at least ``confirm`` of ``size`` n-grams: from left to right, none overlapping,
    each the best of those that start within the first one found. N-grams g from word a to e, sorted by a."""
    least, out, i = confirm * size - 1e-9, [], 0

    def window(i: int) -> tuple[int, int]:
        ends: dict[int, int] = {}
        for j in range(i, len(a)):
            if a[j] >= a[i] + width:
                break
            if e[j] <= a[i] + width and e[j] < ends.get(g[j], e[j] + 1):
                ends[g[j]] = e[j]
        return len(ends), max(ends.values(), default=0)

    while i < len(a):
        n, end = window(i)
        if n < least:
            i = bisect.bisect_left(a, a[i] + 1)
            continue
        best, k = (n, a[i] - end, a[i], end), bisect.bisect_left(a, a[i] + 1)
        while k < len(a) and a[k] < end:
            n, e_k = window(k)
            best, k = max(best, (n, a[k] - e_k, a[k], e_k), key=lambda x: x[:2]), bisect.bisect_left(a, a[k] + 1)
        out.append((best[0] / size, best[2], best[3]))
        i = bisect.bisect_left(a, best[3])
    return out


def _places(paragraph: str) -> list[tuple[int, int]]:
    """Start and end of each word; a full stop, quote or bracket that closes a word belongs to its place, and those that open it."""
    out = []
    for m in _WORDS.finditer(paragraph):
        start, end = m.span()
        while start and paragraph[start - 1] in "(\"'":
            start -= 1
        while end < len(paragraph) and paragraph[end] in ".,;:!)\"'":
            end += 1
        out.append((start, end))
    return out


def notices_in(model: Model, texts: list[str | None], templates: list, least: float, confirm: float) -> Iterator[tuple[int, int, int, int, int, float, float]]:
    """(text, line, start, end, family, probability, share) of the notices that count, by place."""
    whole = [t or "" for t in texts]
    parts = [(int(i), m.start(), m[0]) for i in model.may_hold(whole, templates) for m in _PARAGRAPH.finditer(whole[i])]
    paragraphs = [p for *_, p in parts]
    telling = model.telling()
    sets = {f: np.unique(np.concatenate([grams for k, grams in model.notices if k == f])) for f, *_ in templates}
    for at, found, held in model.candidates(paragraphs, templates, confirm):
        text, shift, paragraph = parts[at]
        places = _places(paragraph)

        def inside(x: int, y: int, held: list = held) -> list[int]:
            begin = bisect.bisect_left(held, x, key=lambda h: h[1])
            return [g for g, _, e in held[begin:bisect.bisect_left(held, y, key=lambda h: h[1])] if e <= y]

        # What another family's notice lacks must be there, or the notice may be the other's.
        found = [c for c in found if not telling[c[5]] or all(np.isin(words, inside(c[2], c[3])).mean() >= confirm for words in telling[c[5]])]
        if not found:
            continue
        chances = model.probabilities([paragraph[places[x][0]:places[y - 1][1]] for _, _, x, y, *_ in found])
        lines, counted = 0, 0
        for group in _overlapping(found):
            taken: list[list] = []
            for k in sorted(group, key=lambda k: (-found[k][0], -found[k][4], -chances[k][found[k][1]], found[k][2] - found[k][3])):
                share, family, x, y, size, _ = found[k]
                over = [t for t in taken if t[1] < y and x < t[2]]
                same = [t for t in over if t[0] == family]
                if same:  # one place of the family: that of the longer notice if it holds the other
                    if len(over) == 1 and x <= same[0][1] and same[0][2] <= y and share * size > same[0][5]:
                        same[0][1:3], same[0][5] = [x, y], share * size
                    continue
                chance = float(chances[k][family])
                if over:
                    held_here = inside(x, y)
                    mine = max((grams for f, grams, *_ in templates if f == family), key=lambda n: np.isin(n, held_here).mean())
                    apart = [np.setdiff1d(mine, sets[f]) for f in {t[0] for t in over}]
                    chance = float(1 - chances[k][0])
                    if not all(len(n) and np.isin(n, held_here).mean() >= confirm for n in apart):
                        continue
                if chance >= least:
                    taken.append([family, x, y, chance, share, share * size])
            for family, x, y, chance, share, _ in sorted(taken, key=lambda t: (t[1], t[2], t[0])):
                start, end = shift + places[x][0], shift + places[y - 1][1]
                lines, counted = lines + whole[text].count("\n", counted, start), start
                yield text, lines, start, end, family, chance, share


def _overlapping(found: list[tuple[float, int, int, int, int, int]]) -> Iterator[list[int]]:
    """The numbers of the candidates, those that hang together by overlaps in one list, by place."""
    group, reach = [], 0
    for k in sorted(range(len(found)), key=lambda k: found[k][2]):
        if group and found[k][2] >= reach:
            yield group
            group, reach = [], 0
        group.append(k)
        reach = max(reach, found[k][3])
    if group:
        yield group


def _broken(rng: random.Random, notice: str, filler: list[str]) -> str:
    words = [w for w in notice.split() if rng.random() > 0.06]
    words = [w.upper() if rng.random() < 0.05 else w for w in words]
    if rng.random() < 0.5 and filler:
        near = rng.choice(filler).split()[:rng.randint(0, 40)]
        words = near + words if rng.random() < 0.5 else words + near
    return " ".join(words)


def train(paragraphs: list[str], seed: int = 7, copies: int = 24, rounds: int = 200) -> Model:
    """Fit on notices against the given paragraphs (which count as unknown unless they hold most of a notice)."""
    rng = random.Random(seed)
    notices = [(k, n) for k, f in enumerate(FAMILIES) for n in NOTICES.get(f, [])]
    vocabulary = np.unique(_grams([n for _, n in notices])[0])
    own = Model(vocabulary, np.zeros((len(vocabulary), len(FAMILIES))), np.zeros(len(FAMILIES)), 1.0, [])
    sets = [(k, own.features([n])[1]) for k, n in notices]

    def holds_notice(texts: list[str]) -> np.ndarray:
        of, at = own.features(texts)
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        return np.array([any(np.isin(n, at[a:b]).mean() > 0.5 for _, n in sets) for a, b in zip(bounds, bounds[1:])], bool)

    filler = [p for p in dict.fromkeys(paragraphs) if p.strip()]
    filler = [p for p, held in zip(filler, holds_notice(filler)) if not held] if filler else []
    texts, labels = [], []
    for k, n in notices:
        for _ in range(copies):
            texts.append(_broken(rng, n, filler))
            labels.append(k)
    for _, n in notices:  # words of a notice out of order, or a short part of it, grant nothing
        w = n.split()
        for _ in range(copies // 4):
            cut = w[:max(1, len(w) // 4)]
            texts.append(" ".join(rng.sample(w, max(1, len(w) // 3)) if rng.random() < 0.6 else cut))
            labels.append(0)
    none = filler + NEAR_MISSES * copies
    texts += none
    labels += [0] * len(none)
    order = list(range(len(texts)))
    rng.shuffle(order)
    of, at = own.features([texts[i] for i in order])
    y = np.array([labels[i] for i in order])
    x = np.zeros((len(order), len(vocabulary)), np.float32)
    x[of, at] = 1
    held = np.arange(len(order)) % 5 == 0
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    w, b = np.zeros((len(vocabulary), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    vw, vb, xt, tt = np.zeros_like(w), np.zeros_like(b), x[~held], target[~held]
    balance = (1 / np.maximum(np.bincount(y[~held], minlength=len(FAMILIES)), 1))[y[~held]][:, None].astype(np.float32)
    for _ in range(rounds):
        z = xt @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - tt) * balance
        vw = 0.9 * vw - 0.3 * (xt.T @ g + 1e-4 * w)
        vb = 0.9 * vb - 0.3 * g.sum(axis=0)
        w, b = w + vw, b + vb
    z = x[held] @ w + b

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(axis=1, keepdims=True)
        return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(q)), y[held]]).mean())

    temperature = min(np.geomspace(0.2, 5, 41), key=loss)
    return Model(vocabulary, w.astype(float), b.astype(float), float(temperature), sets)


def sample_paragraphs(docs: DataFrame, most_docs: int = 400, most_chars: int = 1000) -> list[str]:
    """Training paragraphs: those of up to ``most_chars`` characters from the ``most_docs`` documents with the smallest hash of their id."""
    picked = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.explode(F.filter(F.split("text", "\n"), lambda p: F.length(p).between(1, most_chars))).alias("p"))
    return sorted({r["p"] for r in rows.orderBy(F.xxhash64("p")).limit(10 * most_docs).collect()})


def scan(docs: DataFrame, model: Model | None = None, least: float = 0.5, confirm: float = 0.7) -> DataFrame:
    """One row for each confirmed notice: doc_id, paragraph (the line it starts in, from 0), start, end (code points), family, probability, share."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train(sample_paragraphs(docs)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        templates = fitted.templates(confirm)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[i], line, start, end, FAMILIES[f], chance, share) for i, line, start, end, f, chance, share in notices_in(fitted, batch.column("text").to_pylist(), templates, least, confirm)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["doc_id", "paragraph", "start", "end", "family", "probability", "share"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, paragraph long, start long, end long, family string, probability double, share double")
