"""Operator 6: licence scan by a trained paragraph classifier.

Paragraphs end at blank lines; a line of marks only, as comments have, is blank. Within a paragraph line breaks are white
space, so wrapped notices are read whole. It is judged in overlapping windows of 64 words, more than the longest
notice; beside it each line is judged on its own, for notices amid other lines. Softmax regression on sparse word
bigrams and trigrams of the licence notices below gives each window a family or `unknown`; its temperature is fitted on
held-out examples. A family counts only if its calibrated probability is at least one half and the window with its
neighbours holds most of the bigrams of one of the family's notices. Examples are made from the notices (cut, thinned
out, amid other words); those of `unknown` are shuffled notices and a bounded sample of the corpus' own lines. A window
without any notice bigram has no feature, and the model's answer for it is `unknown`.

A document gets its surest family, and all families found. Null or empty text gives `unknown` with probability 1 and
no paragraph; very long texts are scanned whole, an empty table gives no rows. Each row is handled on its own, so repeated
rows and null ids need no rule. Only the id and own columns come out (an id column named like one of them as `id`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_name, quoted, slices

#: The documented bound of the corpus sample: paragraphs, from as many documents chosen by a hash.
SAMPLE = 2_000
#: The documented bound of a sampled line, in characters: no more is fitted on.
SAMPLE_CHARS = 2_000
WINDOW = 64
SURE, ALIKE = 0.5, 0.6
UNKNOWN = "unknown"

# Notices by family.
NOTICES: dict[str, list[str]] = {
    "AGPL": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0 Universal."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0."],
    "Proprietary": ["All rights reserved.", "This document is confidential and proprietary and may not be reproduced or distributed without prior written consent."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary."],
}

_words = re.compile(r"\w+").findall
_words_and_breaks = re.compile(r"\w+|\n").findall


class Model:
    """Vocabulary, n-gram features, weights (features x classes), bias and temperature."""

    def __init__(self):
        self.classes = [UNKNOWN, *sorted(NOTICES)]
        self.vocab: dict[str, int] = {}
        self.notices: list[tuple[int, np.ndarray]] = []
        said: list[tuple[int, np.ndarray]] = []
        for c, family in enumerate(self.classes[1:], 1):
            for notice in NOTICES[family]:
                said.append((c, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in _words(notice.lower())], dtype=np.int64)))
        self.size = len(self.vocab) + 1  # 0: any other word
        two = np.unique(np.concatenate([self.pairs(w) for _, w in said]))
        self.first = np.full(self.size**2, -1, dtype=np.int32)
        self.first[two] = np.arange(len(two))
        three = np.unique(np.concatenate([self.triples(w) for _, w in said]))
        self.three, self.width = three[three >= 0], len(two) + len(three[three >= 0])
        self.said = said
        self.notices = [(c, np.unique(self.first[self.pairs(w)])) for c, w in said]
        self.weights, self.bias, self.temperature = np.zeros((self.width, len(self.classes))), np.zeros(len(self.classes)), 1.0
        self.held_out = np.zeros(0), np.zeros(0, dtype=bool)  # confidence, and whether the answer is right

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        return ids[:-1] * self.size + ids[1:]

    def triples(self, ids: np.ndarray) -> np.ndarray:
        """A triple is its first pair's feature and the third word; -1 if the pair is no feature."""
        if len(ids) < 3:
            return np.zeros(0, dtype=np.int64)
        head = self.first[self.pairs(ids[:-1])].astype(np.int64)
        return np.where(head >= 0, head * self.size + ids[2:], -1)

    def features(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First places, last places and features of the known n-grams of a sequence."""
        if len(ids) < 2:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        two = self.first[self.pairs(ids)]
        at2 = np.nonzero(two >= 0)[0]
        if not len(at2):
            return at2, at2, at2
        t = self.triples(ids)
        k = np.minimum(np.searchsorted(self.three, t), len(self.three) - 1)
        at3 = np.nonzero((t >= 0) & (self.three[k] == t))[0]
        return np.concatenate([at2, at3]), np.concatenate([at2 + 1, at3 + 2]), np.concatenate([two[at2], k[at3] + self.width - len(self.three)])

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def ids(self, text: str) -> np.ndarray:
        """Words by number; -1 for a line break."""
        return np.fromiter((-1 if w == "\n" else self.vocab.get(w, 0) for w in _words_and_breaks(text.lower())), dtype=np.int64)

    def scan(self, text: str | None) -> list[tuple[str, float, float, int]]:
        """(family, probability, similarity, line) of each family's surest window."""
        ids = self.ids(text) if text else np.zeros(0, dtype=np.int64)
        word = ids >= 0
        line = np.cumsum(~word)[word]
        ids = ids[word]
        at, end, feature = self.features(ids)
        if not len(at):
            return []
        paragraph = np.concatenate([[0], np.cumsum(np.diff(line) > 1)])
        found: list[tuple[float, float, int, int, int]] = []
        for part in (line, paragraph):
            inside = part[at] == part[end]
            if inside.any():
                found += self._judged(at[inside], end[inside], feature[inside], part)
        best: dict[int, tuple[float, float, int]] = {}
        taken = np.zeros(len(ids), dtype=np.int64)
        for alike, p, c, begin, last in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            own = taken[begin : last + 1]
            if 2 * np.count_nonzero((own > 0) & (own != c)) > len(own):
                continue  # part of a notice that is more alike, of another family
            own[own == 0] = c
            if (p, alike) > best.get(c, (0.0, 0.0, 0))[:2]:
                best[c] = (p, alike, int(line[begin]))
        return sorted(((self.classes[c], *b) for c, b in best.items()), key=lambda x: (-x[1], -x[2], x[0]))

    def _judged(self, at: np.ndarray, end: np.ndarray, feature: np.ndarray, part: np.ndarray) -> list[tuple[float, float, int, int, int]]:
        """(similarity, probability, class, first and last word) of all windows that hold a notice; windows don't reach over the ends of a part."""
        group = part[at]
        inner = at - np.searchsorted(part, group)
        found = []
        for offset in (0, WINDOW // 2):
            keys, where = np.unique(group * (1 << 32) + (inner + offset) // WINDOW, return_inverse=True)
            logits = np.tile(self.bias, (len(keys), 1))
            np.add.at(logits, where, self.weights[feature])
            p = self.probabilities(logits)
            top = p.argmax(axis=1)
            for k in np.nonzero((top > 0) & (p.max(axis=1) >= SURE))[0].tolist():
                c, first = int(top[k]), int(keys[k] & 0xFFFFFFFF) * WINDOW - offset
                near = np.nonzero((group == keys[k] >> 32) & (inner >= first - WINDOW) & (inner < first + 2 * WINDOW))[0]
                own = np.unique(feature[near])
                alike, j = max(((float(np.isin(n, own).mean()), -j) for j, (family, n) in enumerate(self.notices) if family == c))
                if alike >= ALIKE:
                    held = near[np.isin(feature[near], self.notices[-j][1])]
                    middle, reach = np.median(at[held]), len(self.said[-j][1])
                    held = held[abs(at[held] - middle) <= reach]
                    found.append((alike, float(p[k, c]), c, int(at[held].min()), int(end[held].max())))
        return found


def train(paragraphs: list[str], seed: int = 1) -> Model:
    """Fits weights and temperature on made examples; `paragraphs` are of the corpus."""
    model, rng = Model(), np.random.default_rng(seed)
    plain = [(w := model.ids(p))[w >= 0][:WINDOW] for p in paragraphs]
    other = lambda n: np.zeros(n, dtype=np.int64)
    examples: list[tuple[int, np.ndarray]] = [(0, p) for p in plain] + [(0, other(5))] * 40
    for c, words in model.said:
        for k in range(40):
            w = words
            if k:
                n = max(min(len(w), 3), int(len(w) * rng.uniform(0.7, 1)))
                s = rng.integers(0, len(w) - n + 1)
                w = w[s : s + n]
                w = np.where(rng.random(len(w)) < 0.04, 0, w) if len(w) > 8 else w
                w = np.concatenate([other(rng.integers(0, 6)), w, other(rng.integers(0, 6))])
            examples.append((c, w))
        for _ in range(12):  # the words without their order
            examples.append((0, rng.permutation(words)))
            n = rng.integers(1, max(2, len(words) // 4))
            s = rng.integers(0, len(words) - n + 1)
            if len(words) > 8:
                examples.append((0, np.concatenate([other(4), words[s : s + n], other(4)])))
    order = rng.permutation(len(examples))
    x, y = np.zeros((len(examples), model.width), dtype=np.float32), np.array([examples[k][0] for k in order])
    for row, k in enumerate(order):
        np.add.at(x[row], model.features(examples[k][1])[2], 1)
    cut = len(y) * 4 // 5
    onehot = np.eye(len(model.classes), dtype=np.float32)[y]
    weights, bias = np.zeros((model.width, len(model.classes)), dtype=np.float32), np.zeros(len(model.classes), dtype=np.float32)
    seen, seen_b = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    for _ in range(120):
        z = x[:cut] @ weights + bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = z / z.sum(axis=1, keepdims=True) - onehot[:cut]
        grad, grad_b = x[:cut].T @ error / cut + 1e-5 * weights, error.mean(axis=0)
        seen += grad**2
        seen_b += grad_b**2
        weights -= 0.3 * grad / np.sqrt(seen)
        bias -= 0.3 * grad_b / np.sqrt(seen_b)
    model.weights, model.bias = weights.astype(np.float64), bias.astype(np.float64)
    held = x[cut:] @ model.weights + model.bias

    def loss(t: float) -> float:
        model.temperature = t
        return float(-np.log(np.maximum(model.probabilities(held)[np.arange(len(held)), y[cut:]], 1e-12)).mean())

    model.temperature = min(np.geomspace(0.05, 20, 81), key=loss)
    p = model.probabilities(held)
    model.held_out = p.max(axis=1), p.argmax(axis=1) == y[cut:]
    return model


def calibration_error(model: Model, bins: int = 10) -> float:
    """The expected calibration error on the held-out examples: how far confidence and share of right answers differ, by bins of confidence."""
    sure, right = model.held_out
    at = np.minimum((sure * bins).astype(int), bins - 1)
    return float(sum(abs(sure[at == b].sum() - right[at == b].sum()) for b in range(bins)) / max(len(sure), 1))


def sampled_paragraphs(docs: DataFrame, text_col: str = "text", limit: int = SAMPLE) -> list[str]:
    """One line of each of about `limit` documents at most, chosen by the text's hash; copies of a text count once."""
    text = F.col(quoted(text_col)).cast("string")
    known, n = docs.where(text.isNotNull()), docs.count()
    h = F.xxhash64(text)
    chosen = known.select(h.alias("h"), text.alias("t")).where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, limit / max(n, 1))))
    line = F.substring(F.element_at(F.split("t", "\n", -1), (F.pmod("h", F.size(F.split("t", "\n", -1))) + 1).cast("int")), 1, SAMPLE_CHARS)
    rows = chosen.select("h", line.alias("line")).groupBy("h").agg(F.min("line").alias("line"))
    alike = {" ".join(_words(n.lower())) for ns in NOTICES.values() for n in ns}
    return sorted(r.line for r in rows.collect() if r.line and not any(a in " ".join(_words(r.line.lower())) for a in alike))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, licence, probability, similarity, line (from 0), families (array)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed vocabulary
    kind = docs.schema[id_col].dataType.simpleString()
    named = own_name(id_col, ("licence", "probability", "similarity", "line", "families"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [sent.value.scan(t) for t in part.column(1).to_pylist()]
                best = [f[0] if f else (UNKNOWN, 1.0, None, None) for f in found]
                cols = list(zip(*best, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array([[x[0] for x in f] for f in found], pa.list_(pa.string()))], names=[named, "licence", "probability", "similarity", "line", "families"])

    return docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, f"{quoted(named)} {kind}, licence string, probability double, similarity double, line bigint, families array<string>")
