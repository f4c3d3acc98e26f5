"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the lines of a text, and besides, for wrapped notices, consecutive lines with a word are read as one;
long ones are read in overlapping pieces of ``PIECE`` words. A notice that its line alone confirms is reported there; one
across line ends once, at the line where its first confirmed word pair stands. Words are
lower-cased and stripped of punctuation, and a piece's sparse features are its hashed words and word pairs. A
multinomial logistic regression gives each piece a licence family or the class unknown. It is trained once per
driver on ``TRAIN_ROWS`` generated, labelled paragraphs (perturbed notices, and prose that may speak of
licences); this bound is documented and doesn't depend on the corpus. On a held-out third the scores are
calibrated with a temperature, and a notice is believed only from the least probability (that it isn't unknown) at which
the held-out precision is ``PRECISION``; everything less certain is unknown. Families are tried from the likeliest on, as far as ``POSSIBLE``: one is
confirmed, and reported, if the piece holds ``CONFIRM`` of the word pairs of one of its templates; among families that share most of their words
(``SIBLINGS``) the template that is held best decides. Marks of comments before the lines of a notice are punctuation, and so nothing.

One narrow pass, no shuffle. Null text counts as empty; long texts are read whole; repeated rows give repeated
findings; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veriframe.llm.common import end_to_end, mix64, slices, texts_of

PIECE, STRIDE = 24, 12
BITS = 16
TRAIN_ROWS = 6000
EPOCHS = 40
RATE = 10.0
PRECISION = 0.98
CONFIRM = 0.6
#: A family less probable than this isn't looked at.
POSSIBLE = 0.001
UNKNOWN = "unknown"

#: Notices by which licences are given, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "The MIT License (MIT)",
        "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL, version 2",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "BSD 2-Clause License",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Licensed under the ISC License",
        "SPDX-License-Identifier: ISC",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "Licensed under the zlib License",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0",
        "Licensed under the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ),
    "cc-by-nc-sa": (
        "Licensed under CC BY-NC-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    ),
    "cc-by-nc-nd": (
        "Licensed under CC BY-NC-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    ),
    "cc0": (
        "Released into the public domain under CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ),
    "reserved": (
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher",
        "Copyright 2020 the authors. All rights reserved",
        "All rights reserved",
    ),
}
#: Families whose notices share most of their words: templates of all of them decide among them.
SIBLINGS = (("gpl", "agpl", "lgpl"), ("mit", "isc", "bsd"), tuple(f for f in TEMPLATES if f.startswith("cc-")))
FAMILIES = (UNKNOWN, *TEMPLATES)

#: Upper case to lower, ASCII punctuation but the hyphen to a space; line ends stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not (chr(c).isalnum() or c in (45, 10)) else c for c in range(256))


def fold(text: bytes) -> bytes:
    return text.translate(_FOLD)


def pairs(words: np.ndarray) -> np.ndarray:
    return mix64(words[:-1] * np.uint64(3) + mix64(words[1:]))


def feature_rows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of every word, and of every pair (the last word has none: its own again)."""
    shift = np.uint64(64 - BITS)
    second = np.concatenate((pairs(words), words[-1:])) if len(words) else words
    return (words >> shift).astype(np.int64), (second >> shift).astype(np.int64)


class Model:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.weights, self.bias, self.temperature, self.least = weights.astype(np.float32), bias, temperature, least
        self.templates = {f: [_pair_set(t) for t in ts] for f, ts in TEMPLATES.items()}
        self.pairs = np.array(sorted({p for ts in self.templates.values() for t in ts for p in t}), np.uint64)

    def probabilities(self, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A row for each piece words[start:end]."""
        one, two = feature_rows(words)
        sums = np.zeros((len(start), len(FAMILIES)))
        for k in range(len(FAMILIES)):
            w = self.weights[:, k]
            a = np.concatenate(([0.0], np.cumsum(w[one], dtype=np.float64)))
            b = np.concatenate(([0.0], np.cumsum(w[two], dtype=np.float64)))
            sums[:, k] = a[end] - a[start] + b[end - 1] - b[start]
        return softmax((sums / np.sqrt(2 * (end - start) - 1)[:, None] + self.bias) / self.temperature)

    def held(self, words: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbouring words stands in any template."""
        own = pairs(words)
        at = np.minimum(np.searchsorted(self.pairs, own), len(self.pairs) - 1)
        return self.pairs[at] == own

    def confirm(self, family: str, words: np.ndarray) -> tuple[str, float, int]:
        """The family, the greatest share of a template's word pairs that the piece holds, and where the first of them stands.

        Only templates of the family that the classifier names can confirm it, and those of its siblings: of these the one
        that is held best decides. If all that a piece holds of it stands in a sibling's template too, the words that tell them apart are
        missing, and nothing is confirmed.
        """
        found = pairs(words)
        own = set(found[self.held(words)].tolist())
        near = next((group for group in SIBLINGS if family in group), (family,))
        held = [(len(own & t) / len(t), f == family, len(t), f, t) for f in near for t in self.templates[f]]
        best = max(held, key=lambda x: x[:3])
        shared = own & best[4]
        if best[0] < 1 and any(shared <= t for _, _, _, f, t in held if f != best[3]):
            return best[3], 0.0, 0
        return best[3], best[0], next((i for i, x in enumerate(found.tolist()) if x in best[4]), 0)


def _pair_set(text: str) -> set[int]:
    return set(pairs(end_to_end([fold(text.encode())])[0]).tolist())


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def pieces(words: int) -> list[tuple[int, int]]:
    """Pieces of a paragraph of so many words; the last may be longer by up to STRIDE."""
    if words <= PIECE + STRIDE:
        return [(0, words)]
    cut = list(range(0, words - PIECE, STRIDE))
    return [(s, s + PIECE) for s in cut[:-1]] + [(cut[-1], words)]


def labelled(rng: random.Random, n: int) -> list[tuple[str, int]]:
    """Generated paragraphs and the numbers of their families."""
    letters = "abcdefghijklmnopqrstuvwxyzéü"
    common = "the of and to in a is that it was for on are with as be this by which from der die und de la que les".split()
    legal = "license licence licensed under public general version terms permission rights copyright software free open international released law policy driving party agreement fee".split()
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices(letters, k=rng.randint(1, 9)))
    prose = lambda a, b: [word() for _ in range(rng.randint(a, b))]
    rows = []
    for _ in range(n):
        if rng.random() < 0.45:
            body = prose(1, 45)
            if rng.random() < 0.4:
                for _ in range(rng.randint(1, 4)):
                    body.insert(rng.randint(0, len(body)), rng.choice(legal))
            if rng.random() < 0.15:  # words of notices, too few of them or in another order
                words = rng.choice(TEMPLATES[rng.choice(FAMILIES[1:])]).split()
                words = words[len(words) // 2 :][: max(1, len(words) // 4)]
                rng.shuffle(words)
                at = rng.randint(0, len(body))
                body[at:at] = words
            rows.append((" ".join(body), 0))
            continue
        k = rng.randrange(1, len(FAMILIES))
        words = rng.choice(TEMPLATES[FAMILIES[k]]).split()
        if len(words) > 8 and rng.random() < 0.3:
            words = words[: rng.randint(len(words) * 2 // 3, len(words))]
        if len(words) > 8:
            words = [w for w in words if rng.random() > 0.05]
        words = prose(0, 16) * (rng.random() < 0.5) + words + prose(0, 16) * (rng.random() < 0.5)
        text = " ".join(words) + rng.choice((".", "", " "))
        rows.append((text.upper() if rng.random() < 0.1 else text, k))
    return rows


def _matrix(rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, col, val = [], [], []
    for i, (text, _) in enumerate(rows):
        words = end_to_end([fold(text.encode())])[0]
        one, two = feature_rows(words)
        own = np.concatenate((one, two[:-1]))
        row.append(np.full(len(own), i))
        col.append(own)
        val.append(np.full(len(own), 1 / np.sqrt(max(len(own), 1))))
    return np.concatenate(row), np.concatenate(col), np.concatenate(val), np.array([y for _, y in rows])


@cache
def trained(n: int = TRAIN_ROWS, seed: int = 23) -> Model:
    rng = random.Random(seed)
    rows = labelled(rng, n)
    cut = n * 2 // 3
    row, col, val, y = _matrix(rows)
    fit = row < cut
    used, back = np.unique(col, return_inverse=True)
    w, bias, gold = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES)), np.eye(len(FAMILIES))[y]
    gw, gb = np.full_like(w, 1e-8), np.full_like(bias, 1e-8)

    def scores(m: np.ndarray, low: int, high: int) -> np.ndarray:
        r, c, v = row[m] - low, back[m], val[m]
        return np.stack([np.bincount(r, v * w[c, k], high - low) for k in range(len(FAMILIES))], 1) + bias

    for _ in range(EPOCHS):  # AdaGrad on the whole sample
        d = (gold[:cut] - softmax(scores(fit, 0, cut))) / cut
        g = np.stack([np.bincount(back[fit], val[fit] * d[row[fit], k], len(used)) for k in range(len(FAMILIES))], 1) - 1e-6 * w
        gw += g * g
        gb += (b := d.sum(0)) ** 2
        w += RATE * g / np.sqrt(gw)
        bias += 0.1 * b / np.sqrt(gb)
    held = scores(~fit, cut, n)
    loss = lambda t: -np.log(softmax(held / t)[np.arange(n - cut), y[cut:]] + 1e-12).mean()
    temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    p = softmax(held / temperature)
    named, top = p.argmax(1) > 0, 1 - p[:, 0]
    order = np.argsort(-top[named])
    right = np.cumsum((y[cut:][named] > 0)[order]) / np.arange(1, named.sum() + 1)
    good = np.flatnonzero(right >= PRECISION)
    least = float(max(0.5, top[named][order][good[-1]])) if len(good) else 1.1
    weights = np.zeros((1 << BITS, len(FAMILIES)))
    weights[used] = w
    return Model(weights, bias, float(temperature), least)


def scan(texts: list[bytes], model: Model) -> list[tuple[int, int, str, float, float, int]]:
    """(text, paragraph, family, probability, share of a template, words) for confirmed paragraphs."""
    folded = [fold(t) for t in texts]
    words, start, _, first = end_to_end(folded)
    if not len(words):
        return []
    low, high, where, wrapped = [], [], [], []
    line = np.zeros(len(words), np.int64)
    for i, t in enumerate(folded):
        a, b = int(first[i]), int(first[i + 1])
        if a == b:
            continue
        ends = np.flatnonzero(np.frombuffer(t, np.uint8) == 10)
        own = line[a:b] = np.searchsorted(ends, start[a:b])
        for joined in (False, True):
            cut = np.flatnonzero(np.diff(own) > joined) + 1  # a line without a word ends a block of lines
            edges = [0, *cut.tolist(), b - a]
            for s, e in zip(edges, edges[1:]):
                for x, y in pieces(e - s):
                    if not joined or own[s + x] != own[s + y - 1]:
                        low.append(a + s + x)
                        high.append(a + s + y)
                        where.append(i)
                        wrapped.append(joined)
    low, high = np.array(low), np.array(high)
    p = model.probabilities(words, low, high)
    best = p.argmax(axis=1)
    some = np.concatenate(([0], np.cumsum(model.held(words))))
    some = some[np.maximum(high - 1, low)] > some[low]  # a piece without any pair of any template confirms nothing
    found: dict[tuple, tuple] = {}
    across: dict[tuple, list] = {}
    for j in np.flatnonzero((best > 0) & (1 - p[:, 0] >= model.least) & some).tolist():
        own, share = words[low[j] : high[j]], 0.0
        likely = np.flatnonzero(p[j] >= POSSIBLE)
        for k in likely[np.argsort(-p[j, likely])].tolist():  # the likeliest family that a template confirms
            if k and (told := model.confirm(FAMILIES[k], own))[1] >= CONFIRM:
                family, share, at = told
                break
        if not share:
            continue
        value = (float(1 - p[j, 0]), share, len(own))
        if wrapped[j]:
            across.setdefault((where[j], family), []).append((int(low[j]), int(high[j]), int(line[low[j] + at]), value))
            continue
        key = (where[j], int(line[low[j]]), family)
        if key not in found or share > found[key][1]:
            found[key] = value
    for (i, family), hits in across.items():
        told = {n for k, n, f in found if k == i and f == family}
        last = -1
        for begin, end, n, value in hits:  # in order of begin
            if told.intersection(line[begin:end].tolist()):
                continue
            key = (i, n, family)
            if begin < last and (over := next((k for k in ((i, m, family) for m in range(n, int(line[begin]) - 1, -1)) if k in found), None)):
                # overlapping pieces tell of one notice: the better one counts
                if value[1] <= found[over][1]:
                    continue
                value = max(value, found.pop(over), key=lambda v: v[1])
            found[key] = value
            last = end
    return [(i, n, family, *v) for (i, n, family), v in sorted(found.items())]


FOUND = "doc_id long, paragraph long, family string, probability double, template_share double, n_words long"


def licenses(docs: DataFrame) -> DataFrame:
    """A row for each confirmed paragraph of docs (doc_id, text); paragraph is the number of its line, from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        for b in slices(batches):
            ids = b.column("doc_id").to_pylist()
            rows = [(ids[i], *rest) for i, *rest in scan(texts_of(b), shared.value)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, FOUND)
