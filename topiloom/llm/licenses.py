"""Licence scans by a trained paragraph classifier.

A sparse logistic regression over word n-grams (one to three words, hashed) tells for
every paragraph the licence family, that it is some licence unknown here, or that it is
none.  It is trained here: from template paragraphs of each family, varied by dropping and
replacing words; from passages of licences outside these families; and, as none, from prose
of the corpus and everyday sentences that speak of licences.  Whole templates, prose and
passages are held out, and calibrate the probabilities (one temperature) and the bar for
calling a paragraph a licence.

Template comparison confirms a prediction: the paragraph must cover enough of the word
trigrams of some template of the family, and no other family may be covered better; if one
is, that one is taken if it is among the likeliest three.  A licence that no template
confirms is ``unknown`` if it holds enough trigrams that licences share, or else none.

A paragraph ends at a line without a word, such as a blank one or a bare comment mark.
It is read line by line and, where it has several lines, across them as well, so that
hard-wrapped notices are seen whole.  Both are read in overlapping windows, so whole
texts are scanned and a notice inside a page of prose is seen.  Texts stream once,
nothing is shuffled.

Prose for training is a bounded sample: of ``NEGATIVE_DOCS`` documents without any word of
licensing, by a hash, a stretch of ``NEGATIVE_CHARS`` characters from a hashed place, and of
these ``NEGATIVE_PARAGRAPHS`` paragraphs.

Defined cases: a null, empty or blank text has no licence; repeated rows and null ids
are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiloom.llm import bytewise as bw
from topiloom.llm.common import hash_sample

BITS = 16
WINDOW_WORDS, STEP_WORDS = 48, 24
NEGATIVE_DOCS = 200
NEGATIVE_CHARS = 5000
NEGATIVE_PARAGRAPHS = 2000
VARIANTS = 6
EPOCHS = 20
RATE = 0.5
DECAY = 1e-5
LEAST_COVERAGE = 0.6
LEAST_SHARED = 0.2
FALSE_ALARMS = 0.001
SEED = 11
UNKNOWN = "unknown"
NONE = "none"

# Names of licences and their SPDX identifiers, by family.
NAMES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "apache-2.0": (("Apache License, Version 2.0", "Apache 2.0 license", "Apache License 2.0"), ("Apache-2.0",)),
    "mit": (("MIT License", "MIT licence", "Expat License"), ("MIT",)),
    "bsd": (("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "new BSD license"), ("BSD-3-Clause", "BSD-2-Clause")),
    "isc": (("ISC License", "ISC licence"), ("ISC",)),
    "gpl": (("GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL v3", "GPLv2", "GNU GPLv3"), ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later")),
    "lgpl": (("GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPL v2.1", "GNU LGPLv3"), ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later")),
    "agpl": (("GNU Affero General Public License, version 3", "GNU AGPL", "AGPL v3", "GNU AGPLv3"), ("AGPL-3.0-only", "AGPL-3.0-or-later")),
    "mpl-2.0": (("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"), ("MPL-2.0",)),
    "epl": (("Eclipse Public License, Version 2.0", "Eclipse Public License v1.0", "EPL 2.0"), ("EPL-1.0", "EPL-2.0")),
    "cc-by": (("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"), ("CC-BY-4.0",)),
    "cc-by-sa": (("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), ("CC-BY-SA-4.0",)),
    "cc-by-nc": (("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), ("CC-BY-NC-4.0",)),
    "cc-by-nd": (("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"), ("CC-BY-ND-4.0",)),
    "cc-by-nc-sa": (("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), ("CC-BY-NC-SA-4.0",)),
    "cc-by-nc-nd": (("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"), ("CC-BY-NC-ND-4.0",)),
    "public-domain": (("CC0 1.0 Universal", "Unlicense", "CC0 1.0 Public Domain Dedication"), ("CC0-1.0", "Unlicense")),
}

# How a text says under which licence it is.  The last is held out.
FORMS = ("Licensed under the {}.", "Released under the {}.", "Licensed under {}.", "This work is licensed under a {}.", "This work is licensed under the {}.", "This software is available under the {}.", "Distributed under the terms of the {}.", "This project is made available under the {}.")

# Paragraphs of the licences and of their notices, by family.
PASSAGES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    ),
}

# Passages of licences outside these families.  Every third is held out.
OTHERS = (
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "You may not use this work except in compliance with the Licence. You may obtain a copy of the Licence from the authority.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This package is free software; you may redistribute and modify it under the terms of the Artistic License.",
    "Licensed under the terms of the Community Research Licence; use for other than research purposes requires prior written permission.",
    "This software is licensed under the Acme Source License, version 1.1, and may only be used in accordance with that license.",
    "Use of this software is governed by the license agreement that accompanies it; redistribution is not permitted without written consent of the licensor.",
    "The licensor grants you a non-exclusive, non-transferable, revocable license to use the software for internal purposes only.",
    "Released under the Foo Public License, version 3.",
    "This work is made available under the Open Data Licence 1.0.",
    "Permission is granted to copy, distribute and modify this document under the terms of the Free Documentation License.",
)

# Sentences near licences that are none.
EVERYDAY = (
    "Her driving licence was renewed last week by the office in town.",
    "The restaurant lost its licence to sell alcohol after the inspection.",
    "A version of the story was released in the spring under another title.",
    "The club was granted permission to use the hall free of charge.",
    "All rights of the tenants are described in the contract with the owner.",
    "All rights reserved.",
    "Copyright by the authors. All rights reserved.",
    "The museum is open to the public and the general conditions are posted at the door.",
    "A copy of the report was distributed to the members without any warranty of its truth.",
    "The institute in Massachusetts published a study on software and work.",
    "Fishing without a licence is not permitted in these waters.",
    "The apache helicopter landed near the village in the morning.",
    "The ministry will grant a licence to operate the mine under strict conditions.",
    "He argued that software should be free and that the public should decide.",
    "The film is available under a new title and will be released in version two.",
)


def _templates() -> dict[str, list[tuple[str, bool]]]:
    """Each family's templates, and whether they are held out of training."""
    out: dict[str, list[tuple[str, bool]]] = {}
    for family, (names, identifiers) in NAMES.items():
        own = [(form.format(name), form == FORMS[-1]) for name in names for form in FORMS]
        own += [(f"SPDX-License-Identifier: {i}", False) for i in identifiers]
        passages = PASSAGES.get(family, ())
        own += [(text, k == 2) for k, text in enumerate(passages)]
        out[family] = own
    return out


TEMPLATES = _templates()


def _segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows [start, end) of words over paragraphs, and each one's paragraph."""
    size = np.diff(first)
    windows = np.where(size <= WINDOW_WORDS, (size > 0).astype(np.int64), -(-(size - WINDOW_WORDS) // STEP_WORDS) + 1)
    owner = np.repeat(np.arange(len(size)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = first[:-1][owner] + nth * STEP_WORDS
    return start, np.minimum(start + WINDOW_WORDS, first[1:][owner]), owner


def _paragraphs(bounds: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines at ``bounds``: each one's paragraph, each paragraph's first line, and
    how many of its lines have words."""
    blank = np.diff(first) == 0
    new = np.isin(bounds[:-1], offsets)
    new[1:] |= ~blank[1:] & blank[:-1]
    paragraph = np.cumsum(new) - 1
    return paragraph, np.flatnonzero(new), np.bincount(paragraph[~blank], minlength=int(new.sum()))


def _gram_sums(hashes: np.ndarray, weights: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mean-scaled sums of n-gram weights of each window: divided by the root of their number."""
    out = np.zeros((len(start), weights.shape[1]), dtype=np.float64)
    number = np.zeros(len(start))
    for k in (1, 2, 3):
        ids = (bw.grams(hashes, k) >> np.uint64(64 - BITS)).astype(np.int64)
        sums = np.zeros((len(ids) + 1, weights.shape[1]))
        np.cumsum(weights[ids], axis=0, out=sums[1:])
        last = np.maximum(end - k + 1, start)
        last = np.minimum(last, len(ids))
        begin = np.minimum(start, last)
        out += sums[last] - sums[begin]
        number += last - begin
    return out / np.sqrt(np.maximum(number, 1))[:, None]


@dataclasses.dataclass
class Model:
    families: list[str]  # the last two are UNKNOWN and NONE
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bar: float
    grams: np.ndarray  # trigrams of all templates, ascending, and whose each is
    template: np.ndarray
    size: np.ndarray  # trigrams of each template, and its family
    family: np.ndarray
    shared: np.ndarray  # trigrams of all templates and other licences

    def probabilities(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        logits = (_gram_sums(hashes, self.weights, start, end) + self.bias) / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def coverage(self, own: np.ndarray) -> list[tuple[float, int]]:
        """For each family: the largest share of a template's trigrams that are among ``own``
        (distinct), and how many those are."""
        first, last = np.searchsorted(self.grams, own), np.searchsorted(self.grams, own, side="right")
        held = np.concatenate([self.template[a:b] for a, b in zip(first, last)]) if len(own) else np.zeros(0, np.int64)
        count = np.bincount(held, minlength=len(self.size))
        out = [(0.0, 0)] * (len(self.families) - 2)
        for t in np.flatnonzero(count).tolist():
            out[self.family[t]] = max(out[self.family[t]], (float(count[t] / self.size[t]), int(count[t])))
        return out

    def judged(self, hashes: np.ndarray, p: np.ndarray) -> tuple[int, float] | None:
        """The family and its coverage of a window with class probabilities ``p``, or nothing."""
        if p[-1] > 1 - self.bar:
            return None
        own = _trigrams(hashes)
        covers = self.coverage(own)
        likely = set(np.argsort(-p[: len(covers)], kind="stable")[:3].tolist())
        # of templates that are covered, the one with the most words says the most
        best = max(range(len(covers)), key=lambda y: (covers[y][0] >= LEAST_COVERAGE, covers[y], p[y]))
        if covers[best][0] >= LEAST_COVERAGE and best in likely:
            return best, covers[best][0]
        share = float(np.isin(own, self.shared).mean()) if len(own) else 0.0
        return (len(covers), share) if share >= LEAST_SHARED and len(hashes) >= 4 else None


def _trigrams(hashes: np.ndarray) -> np.ndarray:
    return np.unique(bw.grams(hashes, min(3, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends, _ = bw.words(data, np.array([0, len(data)]), bw.ALNUM)
    return bw.word_hashes(data, starts, ends)


def _varied(whole: np.ndarray, filler: np.ndarray, v: int, rng: np.random.Generator) -> np.ndarray:
    """A variant of a template: some words replaced or dropped, and words of prose around it."""
    h = whole.copy()
    if v:  # the first stays as it is
        other = rng.random(len(h)) < 0.03 * (v % 3)
        h[other] = rng.choice(filler, int(other.sum()))
        h = h[rng.random(len(h)) >= 0.02 * (v % 2)]
        around = int(rng.integers(0, 12))
        at = int(rng.integers(0, max(1, len(filler) - 12)))
        h = np.concatenate([filler[at : at + around // 2], h, filler[at : at + around - around // 2]])
    return h[:WINDOW_WORDS] if v % 2 else h


def train(negatives: list[str], seed: int = SEED) -> Model:
    """Fits and calibrates the classifier; ``negatives`` are paragraphs without a licence."""
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN, NONE]
    n = len(families)
    prose = [h for h in map(_hashes, negatives) if len(h)]
    filler = np.concatenate([*prose, _hashes(" ".join(EVERYDAY))])
    examples: list[tuple[np.ndarray, int, bool]] = []
    for y, name in enumerate(TEMPLATES):
        for text, held in TEMPLATES[name]:
            examples += [(_varied(_hashes(text), filler, v, rng), y, held) for v in range(VARIANTS)]
    for k, text in enumerate(OTHERS):
        examples += [(_varied(_hashes(text), filler, v, rng), n - 2, k % 3 == 2) for v in range(2 * VARIANTS)]
    examples += [(h[:WINDOW_WORDS], n - 1, k % 4 == 3) for k, h in enumerate(prose)]
    examples += [(h, n - 1, False) for h in map(_hashes, EVERYDAY * 20)]
    examples = [e for e in examples if len(e[0])]
    hashes = np.concatenate([h for h, *_ in examples])
    end = np.cumsum([len(h) for h, *_ in examples])
    start = end - [len(h) for h, *_ in examples]
    truth = np.array([y for _, y, _ in examples])
    held = np.array([h for *_, h in examples])
    learn, test = np.flatnonzero(~held), np.flatnonzero(held)
    weights, bias = _fit(hashes, start, end, truth, learn, n)
    every = [(y, _trigrams(_hashes(t))) for y, f in enumerate(TEMPLATES) for t, _ in TEMPLATES[f]]
    grams, size = np.concatenate([t for _, t in every]), np.array([len(t) for _, t in every])
    order = np.argsort(grams, kind="stable")
    shared = np.unique(np.concatenate([grams, *(_trigrams(_hashes(t)) for t in OTHERS)]))
    model = Model(families, weights.astype(np.float32), bias, 1.0, 0.5, grams[order], np.repeat(np.arange(len(every)), size)[order], size, np.array([y for y, _ in every]), shared)
    logits = _gram_sums(hashes, model.weights, start[test], end[test]) + bias

    def loss(t: float) -> float:
        z = logits / t
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(test)), truth[test]]).mean())

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    p = model.probabilities(hashes, start[test], end[test])
    alarms = 1 - p[truth[test] == n - 1, n - 1]
    model.bar = float(max(0.5, np.quantile(alarms, 1 - FALSE_ALARMS))) if len(alarms) else 0.5
    # calibrated; now learn from what was held out, too
    weights, model.bias = _fit(hashes, start, end, truth, np.arange(len(truth)), n)
    model.weights = weights.astype(np.float32)
    return model


def _fit(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, truth: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, classes) and bias of a logistic regression on the ``rows`` examples, classes balanced."""
    flat, where, scale = _sparse(hashes, start, end, rows)
    used, flat = np.unique(flat, return_inverse=True)  # other features keep no weight
    own, square, bias = np.zeros((len(used), n)), np.full((len(used), n), 1e-6), np.zeros(n)
    class_weight = len(rows) / n / np.maximum(np.bincount(truth[rows], minlength=n), 1)
    each = class_weight[truth[rows]]
    for _ in range(EPOCHS):
        logits = np.stack([np.bincount(where, weights=own[flat, y] * scale, minlength=len(rows)) for y in range(n)], axis=1) + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(rows)), truth[rows]] -= 1
        p *= each[:, None] / len(rows)
        slope = np.stack([np.bincount(flat, weights=p[where, y] * scale, minlength=len(used)) for y in range(n)], axis=1) + DECAY * own
        square += slope**2
        own -= RATE * slope / np.sqrt(square)
        bias -= RATE * p.sum(axis=0)
    weights = np.zeros((1 << BITS, n))
    weights[used] = own
    return weights, bias


def _sparse(hashes, start, end, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, example numbers and scales of the ``rows`` examples."""
    flat, where, scale = [], [], []
    for j, i in enumerate(rows.tolist()):
        h = hashes[start[i] : end[i]]
        ids = np.concatenate([(bw.grams(h, k) >> np.uint64(64 - BITS)).astype(np.int64) for k in (1, 2, 3)])
        flat.append(ids)
        where.append(np.full(len(ids), j))
        scale.append(np.full(len(ids), 1 / np.sqrt(max(1, len(ids)))))
    return np.concatenate(flat), np.concatenate(where), np.concatenate(scale)


def negatives(docs: DataFrame) -> list[str]:
    """A bounded sample of the corpus' paragraphs that speak of no licence at all."""
    text = F.col("text").cast("string")
    rows = docs.where(text.isNotNull() & ~F.lower(text).rlike("licen[sc]e|copyright|permission|warrant|public domain"))
    room = F.greatest(F.length(text) - NEGATIVE_CHARS, F.lit(0)) + 1
    stretch = F.substring(text, F.pmod(F.xxhash64("doc_id"), room).cast("int") + 1, F.lit(NEGATIVE_CHARS))
    picked = hash_sample(rows.select("doc_id", stretch.alias("text")), NEGATIVE_DOCS, docs.count(), "doc_id").collect()
    return [p for r in picked for p in r["text"].split("\n") if p.strip()][:NEGATIVE_PARAGRAPHS]


def find(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, licenses) of every row; licenses: family, probability, coverage and paragraph, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found_type = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("coverage", pa.float64()), ("paragraph", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        none = len(m.families) - 1
        for batch in batches:
            for row, data, offsets in bw.slices(batch.column(1), 1 << 20):
                found: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
                breaks = np.flatnonzero(data == 10) + 1
                bounds = np.unique(np.concatenate([offsets, breaks]))
                starts, ends, first = bw.words(data, bounds, bw.ALNUM)
                hashes = bw.word_hashes(data, starts, ends)
                begin, end, line = _segments(first)
                paragraph_of, first_line, lines = _paragraphs(bounds, offsets, first)
                owner = paragraph_of[line]
                across = _segments(np.append(first[first_line], first[-1]))
                wrapped = lines[across[2]] > 1
                begin, end, owner = (np.concatenate([x, y[wrapped]]) for x, y in zip((begin, end, owner), across))
                if len(begin):
                    p = m.probabilities(hashes, begin, end)
                    best: dict[tuple[int, int], tuple[float, float]] = {}
                    for k in np.flatnonzero(p[:, none] <= 1 - m.bar).tolist():
                        told = m.judged(hashes[begin[k] : end[k]], p[k])
                        if told is not None:
                            key = (int(owner[k]), told[0])
                            best[key] = max(best.get(key, (0.0, 0.0)), (float(p[k, told[0]]), told[1]))
                    # what some window of a paragraph confirms, another need not call unknown
                    named = {paragraph for paragraph, family in best if family < none - 1}
                    best = {key: v for key, v in best.items() if key[1] < none - 1 or key[0] not in named}
                    for (paragraph, family), (probability, cover) in sorted(best.items()):
                        text = int(np.searchsorted(offsets, bounds[first_line[paragraph]], side="right")) - 1
                        number = paragraph - int(paragraph_of[np.searchsorted(bounds, offsets[text])])
                        found[text].append({"family": m.families[family], "probability": probability, "coverage": cover, "paragraph": number})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(found)), pa.array(found, found_type)], names=["doc_id", "licenses"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, licenses array<struct<family:string,probability:double,coverage:double,paragraph:long>>")


def scan(docs: DataFrame) -> DataFrame:
    """Trains on the corpus' own prose, then finds the licences of every document."""
    return find(docs, train(negatives(docs)))


def report(found: DataFrame) -> DataFrame:
    """Per document: its families, the number of licensed paragraphs, and the best evidence."""
    families = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"])))
    best = lambda name: F.array_max(F.transform("licenses", lambda x: x[name]))
    return found.select("doc_id", F.array_join(families, ",").alias("families"), F.size(F.array_distinct(F.transform("licenses", lambda x: x["paragraph"]))).cast("long").alias("n_paragraphs"), best("probability").alias("probability"), best("coverage").alias("coverage"))
