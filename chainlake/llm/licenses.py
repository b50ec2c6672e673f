"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a run of lines that are not blank. Every line of it, and every window of its words that
may hold a template, is a candidate. Its words, word pairs and word triples are hashed to
``2**BITS`` places; a sparse multinomial logistic regression gives a family or "unknown". It
is trained here on notices made from ``TEMPLATES`` (words dropped, added and cut) and on paragraphs
of the corpus that name no license, at most ``SAMPLE`` of them,
by a hash of the text and cut at 600 characters. Part of both is held out, to set the temperature and the
least probability of any family at which at most ``MAX_FALSE`` of the unknown lines pass. A candidate that
passes is confirmed when it holds at least ``MIN_SHARE`` of the word pairs of one template; it has the family of the
template it holds most of. A line that is confirmed is a span; what wraps over lines or stands inside
a long one is a span from the first to the last word of its window. Spans of a text don't overlap.

Null and empty texts have no paragraphs. Without any corpus paragraph the unknown class is
trained on shuffled notices alone. Repeated rows give repeated results, extra columns are ignored.
"""

from __future__ import annotations

import bisect
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.llm.common import least_different, map_texts
from chainlake.llm.ngrams import Words, hash_words, places, words_of

BITS = 16
SAMPLE = 1_500
COPIES = 40
MAX_FALSE = 0.005
MIN_SHARE = 0.6
#: A line of more words is no notice as a whole; windows of it may be.
LONG = 120

# Usual short notices of public license families.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": ["To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal, public domain dedication."],
    "Proprietary": ["Copyright. All rights reserved.", "Proprietary and confidential. Unauthorized copying is prohibited. All rights reserved."],
}
FAMILIES = tuple(sorted(TEMPLATES))


def paragraph_places(texts: list[str], known: Words):
    """(place, paragraph) of every feature of some paragraphs."""
    found = list(places(*hash_words(texts, known), BITS, (0,), 3))
    return np.concatenate([p for p, _ in found]), np.concatenate([o for _, o in found])


def _varied(notice: str, noise: list[str], rng: random.Random) -> str:
    """A notice with some words lost or added, and words of the corpus around it."""
    words = [w for w in notice.split() if rng.random() > 0.06]
    if rng.random() < 0.3 and noise:
        at = rng.randrange(len(words) + 1)
        words[at:at] = rng.choices(noise, k=1)
    if rng.random() < 0.3:
        words = ["Copyright", str(rng.randint(1990, 2030)), *rng.choices(noise or ["Author"], k=2), *words]
    if rng.random() < 0.3 and noise:
        words += rng.choices(noise, k=rng.randint(1, 12))
    return " ".join(words)


class Classifier:
    """Weights (places x classes; class 0 is unknown) with temperature and least probability."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.weights, self.bias, self.temperature, self.least = weights, bias, temperature, least
        self.used = np.nonzero(np.abs(weights).sum(axis=1) > 1e-4)[0]

    def __getstate__(self):
        return self.used, self.weights[self.used], self.bias, self.temperature, self.least

    def __setstate__(self, state):
        used, rows, bias, temperature, least = state
        weights = np.zeros((2**BITS, rows.shape[1]))
        weights[used] = rows
        self.__init__(weights, bias, temperature, least)

    def probabilities(self, paragraphs: list[str], known: Words) -> np.ndarray:
        at, owner = paragraph_places(paragraphs, known)
        mask = np.zeros(2**BITS, bool)
        mask[self.used] = True
        hit = mask[at]
        at, owner = at[hit], owner[hit]
        total = np.stack([np.bincount(owner, self.weights[at, c], len(paragraphs)) for c in range(self.weights.shape[1])], axis=1)
        # Sums are divided by the root of the number of known features, so that length matters less.
        total /= np.sqrt(np.maximum(np.bincount(owner, minlength=len(paragraphs)), 1))[:, None]
        total = (total + self.bias) / self.temperature
        prob = np.exp(total - total.max(axis=1, keepdims=True))
        return prob / prob.sum(axis=1, keepdims=True)


def _softmax_fit(at: np.ndarray, owner: np.ndarray, y: np.ndarray, classes: int, epochs: int = 60, rate: float = 0.5, l1: float = 2e-6):
    """Multinomial logistic regression by AdaGrad with soft thresholding."""
    n = len(y)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    own, local = np.unique(at, return_inverse=True)
    w, b = np.zeros((len(own), classes)), np.zeros(classes)
    sw, sb = np.full(w.shape, 1e-8), np.full(classes, 1e-8)
    hot = np.eye(classes)[y] / n
    order = np.argsort(local, kind="stable")
    heads = np.concatenate(([0], np.nonzero(np.diff(local[order]))[0] + 1)) if len(order) else np.empty(0, int)
    starts = np.searchsorted(owner_sorted := np.sort(owner), np.arange(n))
    by_owner = np.argsort(owner, kind="stable")
    filled = np.bincount(owner_sorted, minlength=n) > 0
    for _ in range(epochs):
        total = np.zeros((n, classes))
        total[filled] = np.add.reduceat(w[local[by_owner]], starts[filled])
        total = total * scale[:, None] + b
        prob = np.exp(total - total.max(axis=1, keepdims=True))
        gap = hot - prob / prob.sum(axis=1, keepdims=True) / n
        g = np.add.reduceat((gap * scale[:, None])[owner[order]], heads)
        sw += g * g
        w += rate * g / np.sqrt(sw)
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * rate / np.sqrt(sw), 0)
        gb = gap.sum(axis=0)
        sb += gb * gb
        b += rate * gb / np.sqrt(sb)
    full = np.zeros((2**BITS, classes))
    full[own] = w
    return full, b


def fit(unknown: list[str]) -> Classifier:
    """Train and calibrate from notices and from ``unknown`` paragraphs."""
    rng = random.Random(7)
    noise = [w for p in unknown[:500] for w in p.split()[:30]]
    texts, y = [], []
    for c, family in enumerate(FAMILIES, 1):
        for notice in TEMPLATES[family]:
            made = [notice] + [_varied(notice, noise, rng) for _ in range(COPIES)]
            texts += made
            y += [c] * len(made)
            # The same words in another order say nothing.
            for _ in range(3):
                words = notice.split() + rng.choices(noise or ["of"], k=10)
                rng.shuffle(words)
                texts.append(" ".join(words))
                y.append(0)
    texts += unknown
    y += [0] * len(unknown)
    labels = np.array(y)
    held = np.array([rng.random() < 0.2 for _ in texts])
    known = Words()
    train = [t for t, h in zip(texts, held) if not h]
    at, owner = paragraph_places(train, known)
    model = Classifier(*_softmax_fit(at, owner, labels[~held], len(FAMILIES) + 1), 1.0, 0.5)
    # Temperature with the best likelihood of the held-out part, then the least probability.
    rest, truth = [t for t, h in zip(texts, held) if h], labels[held]
    losses = {}
    for model.temperature in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        prob = model.probabilities(rest, known)
        losses[model.temperature] = -np.log(prob[np.arange(len(rest)), truth] + 1e-12).mean()
    model.temperature = min(losses, key=losses.get)
    prob = model.probabilities(rest, known)
    # Families share much of their wording, so a notice passes by the sum over all of them.
    wrong = np.sort(1 - prob[truth == 0, 0])[::-1]
    allowed = int(len(wrong) * MAX_FALSE)
    model.least = float(max(0.5, wrong[allowed] + 1e-6 if len(wrong) > allowed else 0.5))
    return model


def _pairs(words: list[bytes]) -> set:
    return set(zip(words, words[1:]))


_TEMPLATE_PAIRS = {f: [_pairs(words_of(t)) for t in TEMPLATES[f]] for f in FAMILIES}


def confirmed(paragraph: str, family: str) -> bool:
    """Whether the paragraph holds enough of one template of the family."""
    own = _pairs(words_of(paragraph))
    return any(len(own & t) >= MIN_SHARE * len(t) for t in _TEMPLATE_PAIRS[family])


#: Words of the templates: (family, different pairs, words), and the templates of each pair.
_ALL = [(f, p, len(words_of(t))) for f in FAMILIES for t, p in zip(TEMPLATES[f], _TEMPLATE_PAIRS[f])]
_OF_PAIR: dict[tuple[bytes, bytes], list[int]] = {}
for _n, (_, _p, _) in enumerate(_ALL):
    for _pair in _p:
        _OF_PAIR.setdefault(_pair, []).append(_n)
_WORD = re.compile("[A-Za-z0-9\x80-\U0010ffff]+")
_BREAK = re.compile(r"\n[^\S\n]*(?=\n)")


def _needed() -> set[bytes]:
    """Words without all of which no template keeps ``MIN_SHARE`` of its pairs."""
    out: set[bytes] = set()
    for _, pairs, _ in _ALL:
        left = [p for p in pairs if not out & set(p)]
        while len(left) >= MIN_SHARE * len(pairs):
            word = max({w for p in left for w in p}, key=lambda w: (len(w), w))
            out.add(word)
            left = [p for p in left if word not in p]
    return out


_NEEDED = re.compile(b"|".join(sorted(_needed())))


def best_template(paragraph: str) -> tuple[float, int, str]:
    """(share of its pairs, pairs, family) of the template that a paragraph holds most of."""
    own = _pairs(words_of(paragraph))
    return max((len(own & p) / len(p), len(p), f) for f, p, _ in _ALL)


def _stretches(found: list[tuple[int, tuple[bytes, bytes]]], longest: int) -> Iterator[tuple[int, int, int]]:
    """(place, different pairs, last place) for each hit, over the hits within ``longest`` words from it.

    The last place is where the last pair is met for the first time, and on to the end of the hits that follow each
    other there. A left and a right pointer move over the hits once.
    """
    run_end: dict[int, int] = {}
    for i, _ in reversed(found):
        run_end[i] = run_end.get(i + 1, i)
    # Of each hit, the next hit of its pair.
    following: dict[int, int] = {}
    met: dict[tuple[bytes, bytes], int] = {}
    for i, pair in found:
        if pair in met:
            following[met[pair]] = i
        met[pair] = i
    inside: Counter = Counter()
    right, last = 0, -1
    for i, pair in found:
        while right < len(found) and found[right][0] + 2 - i <= longest:
            place, other = found[right]
            inside[other] += 1
            if inside[other] == 1:
                last = max(last, place)
            right += 1
        yield i, len(inside), run_end[last]
        inside[pair] -= 1
        if not inside[pair]:
            del inside[pair]
        else:
            last = max(last, following[i])


def windows(text: str) -> list[tuple[int, int, float, int, str]]:
    """(start, end, share, pairs, family) of windows of words with at least ``MIN_SHARE`` of a template, best ones first.

    A window lies in one paragraph and has at most twice the words of its template, and ten.
    """
    if not _NEEDED.search(text.lower().encode()):
        return []
    out, first = [], 0
    for end in [m.start() for m in _BREAK.finditer(text)] + [len(text)]:
        at = [(m.start(), m.end()) for m in _WORD.finditer(text, first, end)]
        first = end
        words = [text[a:b].lower().encode() for a, b in at]
        hits: dict[int, list[tuple[int, tuple[bytes, bytes]]]] = {}
        for i, pair in enumerate(zip(words, words[1:])):
            for n in _OF_PAIR.get(pair, ()):
                hits.setdefault(n, []).append((i, pair))
        for n, found in hits.items():
            family, pairs, size = _ALL[n]
            need = MIN_SHARE * len(pairs)
            if len({p for _, p in found}) < need:
                continue
            for i, seen, last in _stretches(found, 2 * size + 10):
                if seen >= need:
                    out.append((seen / len(pairs), len(pairs), i - last, at[i][0], at[last + 1][1], family))
    out.sort(key=lambda x: (-x[0], -x[1], -x[2], x[3]))
    return [(a, b, share, pairs, family) for share, pairs, _, a, b, family in out]


def apart(spans: list[tuple]) -> list[tuple]:
    """The spans, in their order, that overlap none before."""
    out, used = [], []
    for span in spans:
        at = bisect.bisect(used, (span[0], span[1]))
        if (at and used[at - 1][1] > span[0]) or (at < len(used) and used[at][0] < span[1]):
            continue
        used.insert(at, (span[0], span[1]))
        out.append(span)
    return out


def learn(documents: DataFrame, text_col: str = "text", size: int = SAMPLE) -> Classifier:
    """Fit with at most ``size`` different corpus lines that name no license, those of least hash, as the unknown class."""
    lines = documents.select(F.explode(F.split(text_col, "\n")).alias("p")).filter("length(trim(p)) > 0")
    lines = lines.filter(~F.col("p").rlike("(?i)licen[sc]e|copyright|public domain|all rights reserved"))
    # Of a long paragraph the fit takes the first 600 characters.
    return fit(least_different(lines, F.col("p"), F.substring("p", 1, 600), size))


def scan(documents: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_paragraphs and found: array of (family, start, end, probability) by start.

    Offsets are code points, end exclusive; the probability is that of any family.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    known = []
    item = T.StructType(
        [
            T.StructField("family", T.StringType()), T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType()),
        ]
    )

    def run(texts: list[str]) -> list[pa.Array]:
        if not known:
            known.append(Words())
        cut = [t.split("\n") if t else [] for t in texts]
        flat = [p for doc in cut for p in doc]
        rows, counts, at = [], [], 0
        prob = shared.value.probabilities(flat, known[0]) if flat else np.zeros((0, 1))
        passes = 1 - prob[:, 0] >= shared.value.least if flat else np.zeros(0, bool)
        for text, doc in zip(texts, cut):
            found, start, blank = [], 0, True
            count = 0
            for p in doc:
                before, blank = blank, not p.strip()
                count += before and not blank
            counts.append(count)
            if passes[at : at + len(doc)].any():
                for i, p in enumerate(doc, at):
                    if passes[i]:
                        share, pairs, family = best_template(p)
                        if share >= MIN_SHARE and len(words_of(p)) <= LONG:
                            found.append((start, start + len(p), share, pairs, family, 1 - prob[i, 0]))
                    start += len(p) + 1
            at += len(doc)
            more = apart(windows(text))
            if more:
                sure = 1 - shared.value.probabilities([text[m[0] : m[1]] for m in more], known[0])[:, 0]
                found += [(*m, p) for m, p in zip(more, sure) if p >= shared.value.least]
            # A line comes before a window that holds as much of the same template.
            found = sorted(apart(sorted(found, key=lambda f: (-f[2], -f[3]))))
            rows.append([{"family": f, "start": a, "end": b, "probability": float(p)} for a, b, _, _, f, p in found])
        kinds = pa.struct([("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])
        return [pa.array(counts, pa.int64()), pa.array(rows, pa.list_(kinds))]

    slim = documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    out = [T.StructField("n_paragraphs", T.LongType()), T.StructField("found", T.ArrayType(item))]
    return map_texts(slim, "__text", out, run).withColumnRenamed("__id", id_col)
