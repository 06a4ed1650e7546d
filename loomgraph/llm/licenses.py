"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the lines of a text and, for notices that are wrapped, stretches of words that run over several lines of
a block (lines without a blank one between them). A stretch is where a template's word pairs lie densest: at any offset,
LEAST_OVERLAP of them within STRETCH times its length, with CONTEXT words on either side. A paragraph with one of the
TRIGGERS (words that every template holds one of) is classified by a multinomial logistic regression over hashed word
1- to 3-grams (sparse: in training and in scoring only the features present are touched); its classes are the licence
families and `unknown`. The model is trained on the driver from TEMPLATES and seeded variations of them (words dropped,
names and years put in, neighbouring prose) and, as unknown, from variations of the notices of other licences
(OUTSIDE), of sentences about licences that grant none, and of shuffled templates. Its temperature is fitted on
variations held out from training, so that probabilities are calibrated. A prediction other than unknown is confirmed
if it has LEAST_PROBABILITY or more, the paragraph has the family's NAMES, and it contains LEAST_OVERLAP of the word
pairs of one of the family's templates.

Rows are independent, in Arrow batches; the model (families x BUCKETS floats) is broadcast. Nothing is shuffled.

Defined cases: null and empty texts have no licence; of several licences, the families are listed in code-point order
and the first confirmed paragraph with the highest probability gives the family (of a stretch, paragraph is the line
where it begins); a family that a line of the stretch has by itself isn't sought in the stretch; repeated rows are scanned each for
themselves; a text of any length is scanned whole, in memory in proportion to it; an empty table gives no rows; columns
that are not named in the arguments are ignored, whatever their names; a name in keep that the result has already is
refused.
"""

from __future__ import annotations

import random
import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, read

BUCKETS = 1 << 14
VARIATIONS = 60
SEED = 11
STEPS = 150
LEAST_PROBABILITY = 0.6
LEAST_OVERLAP = 0.5
#: Length of a stretch in template lengths, at most, and words taken on either side of it.
STRETCH = 1.5
CONTEXT = 6
UNKNOWN = "unknown"

# Short notices by which public licences are granted.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright 2020 the author. All rights reserved. No part of this publication may be reproduced without permission.",
    ),
}
# Words that a notice of the family has, one of each group at least (a pattern over its words).
NAMES = {
    "Apache-2.0": r"apache", "BSD": r"bsd|redistribution and use", "CC-BY": r"creative commons attribution|cc by",
    "CC-BY-NC": r"noncommercial|non commercial|cc by-nc", "CC-BY-SA": r"sharealike|share alike|cc by-sa",
    "CC0": r"cc0|waived all copyright", "GPL": r"gnu general public|gnu gpl|\bgpl", "LGPL": r"gnu lesser|lesser general|lgpl",
    "MIT": r"\bmit\b|permission is hereby granted", "MPL-2.0": r"mozilla|\bmpl", "all-rights-reserved": r"all rights reserved",
}
# Notices of licences that are none of the families; they are learnt as unknown.
OUTSIDE = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License, version 2.0.",
    "Licensed under the Eclipse Public License, version 1.0.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
    "Licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU AGPL 3.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This package may be distributed under the terms of the Artistic License 2.0.",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.",
    "Distributed under the Boost Software License, version 1.0.",
    "This is free and unencumbered software released into the public domain under the Unlicense.",
    "This Font Software is licensed under the SIL Open Font License, version 1.1.",
    "This software is provided as-is, without any express or implied warranty, under the zlib License.",
    "Made available under the Open Database License.", "Subject to the Common Development and Distribution License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Permission is granted to copy, distribute and/or modify this document under the GNU Free Documentation License.",
    "Licensed under the Microsoft Public License.", "Released under the Python Software Foundation License, version 2.",
)
# Sentences about licences that grant none.
OTHER = (
    "You need a driving license to rent a car.", "The license plate was found near the river.", "Our license fee rises next year.",
    "He applied for a fishing license.", "The permission of the owner is required.", "Copyright law differs between countries.",
    "She won the rights to host the games.", "The software is sold with a support contract.", "Please read the license agreement before you order.",
    "Redistribution of income was debated.", "The Apache helicopter flew over the creative commons building.", "MIT is a university in Cambridge.",
    "GNU was announced in 1983 as a system.", "Mozilla released a new browser version.", "The public domain is discussed in chapter two.",
)
TRIGGERS = re.compile(r"licen[sc]|copyright|rights|redistribut|permission|public domain|cc0", re.I)
words_of = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*").findall


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def features(words: list[str]) -> np.ndarray:
    return np.unique(np.array([crc32(g.encode()) % BUCKETS for g in grams(words)], np.int64))


def variation(words: list[str], rng: random.Random) -> list[str]:
    """A template with words dropped and prose around it."""
    kept = [w for w in words if rng.random() > 0.06] or words
    prose = ["".join(rng.choice(("an", "er", "in", "ta", "lo", "mi", "se", "ro")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))]
    cut_ = rng.randint(0, len(prose))
    name = rng.choice(([], ["copyright", str(rng.randint(1995, 2026))], ["c", str(rng.randint(1995, 2026)), "contributors"]))
    return [*prose[:cut_], *name, *kept, *prose[cut_:]]


class Model:
    def __init__(self, seed: int = SEED):
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        self.pairs = {f: [set(zip(w, w[1:])) for w in (words_of(t.lower()) for t in ts)] for f, ts in TEMPLATES.items()}
        self.names = {f: re.compile(x) for f, x in NAMES.items()}
        self.lengths = [len(w) for w in self._all_pairs()]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for i, pairs in enumerate(self._all_pairs()):
            for pair in pairs:
                self.holders.setdefault(pair, []).append(i)
        rng = random.Random(seed)
        sets: tuple[list, list] = ([], [])  # to fit, to calibrate
        for k, f in enumerate(self.families[:-1]):
            for t in TEMPLATES[f]:
                w = words_of(t.lower())
                for i in range(VARIATIONS):
                    sets[i % 5 == 4].append((features(w if i == 0 else variation(w, rng)), k))
        last = len(self.families) - 1
        for i in range(VARIATIONS * 12):
            w = words_of(rng.choice(rng.choice(list(TEMPLATES.values())) if i % 3 == 0 else OTHER if i % 3 == 1 else OUTSIDE).lower())
            if i % 3 == 0:
                rng.shuffle(w)
                w = w[: max(2, len(w) // 3)]
            sets[i % 5 == 4].append((features(variation(w, rng)), last))
        self.weights = self._fit(sets[0])
        self.temperature = min((self._loss(sets[1], t), t) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0))[1]

    def _all_pairs(self) -> list[set]:
        return [t for f in self.families[:-1] for t in self.pairs[f]]

    def _fit(self, rows: list) -> np.ndarray:
        """Rows of weights by feature, by full-batch gradient steps with a ridge over the features that each row has; the
        last row is the intercept."""
        at = np.concatenate([np.r_[x, BUCKETS] for x, _ in rows])
        row = np.repeat(np.arange(len(rows)), [len(x) + 1 for x, _ in rows])
        value = 1 / np.sqrt(np.bincount(row))[row][:, None]
        y = np.eye(len(self.families), dtype=np.float32)[[k for _, k in rows]]
        often = np.bincount(at, minlength=BUCKETS + 1)[at] > 1  # what one row alone has teaches nothing about others
        at, row, value = at[often], row[often], value[often].astype(np.float32)
        first_of_row = np.searchsorted(row, np.arange(len(rows)))
        used, at = np.unique(at, return_inverse=True)
        by_feature = np.argsort(at, kind="stable")
        first_of_feature = np.searchsorted(at[by_feature], np.arange(len(used)))
        w = np.zeros((len(used), len(self.families)), np.float32)
        speed = np.zeros_like(w)
        for _ in range(STEPS):
            z = np.add.reduceat(w[at] * value, first_of_row)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            slope = np.add.reduceat(((p - y)[row] * value)[by_feature], first_of_feature)
            speed = 0.9 * speed + slope / len(rows) + 1e-6 * w
            w -= 8.0 * speed
        out = np.zeros((BUCKETS + 1, len(self.families)), np.float32)
        out[used] = w
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.weights[np.r_[x, BUCKETS]].sum(0, dtype=np.float64) / np.sqrt(len(x) + 1)

    def _loss(self, rows: list, t: float) -> float:
        z = np.array([self.logits(x) for x, _ in rows]) / t
        z -= z.max(1, keepdims=True)
        return float(-np.mean((z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(len(rows)), [k for _, k in rows]]))

    def paragraph(self, line: str) -> tuple[str, float, float]:
        """Family, probability, and share of the best template's word pairs that the paragraph has."""
        w = words_of(line.lower())
        z = self.logits(features(w)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        family, p = self.families[k], float(p[k] / p.sum())
        if family == UNKNOWN:
            return family, p, 0.0
        if not self.names[family].search(" ".join(w)):
            return UNKNOWN, p, 0.0
        own = set(zip(w, w[1:]))
        return family, p, max(len(own & t) / len(t) for t in self.pairs[family])

    def stretches(self, words: list[str], lines: list[int]) -> list[tuple[int, int]]:
        """First and last word of the stretches over more than one line; lines: the line of each word."""
        hits: dict[int, list] = {}
        for at, pair in enumerate(zip(words, words[1:])):
            for k in self.holders.get(pair, ()):
                hits.setdefault(k, []).append((at, pair))
        found = set()
        for k, own in hits.items():
            n, most = self.lengths[k], max(3, int(STRETCH * (self.lengths[k] + 1)))
            if len({pair for _, pair in own}) < LEAST_OVERLAP * n:
                continue
            count, left, best = {}, 0, None
            for at, pair in own:
                count[pair] = count.get(pair, 0) + 1
                while at + 2 - own[left][0] > most or count[own[left][1]] > 1:  # too long, or held again further on
                    count[own[left][1]] -= 1
                    if not count[own[left][1]]:
                        del count[own[left][1]]
                    left += 1
                first, size = own[left][0], len(count)
                if best and first > best[2]:  # the next notice
                    found.add(best[1:])
                    best = None
                if size >= LEAST_OVERLAP * n and (best is None or size > best[0]):
                    best = (size, first, at + 1)
            if best:
                found.add(best[1:])
        return sorted((a, b) for a, b in found if lines[a] != lines[b])

    def scan(self, text: str | None) -> dict:
        rows = text.split("\n") if text and TRIGGERS.search(" ".join(text.split("\n"))) else []
        got, doubted, of_line = [], set(), {}
        for i, line in enumerate(rows):
            if not TRIGGERS.search(line):
                continue
            family, p, overlap = self.paragraph(line)
            if family == UNKNOWN or p < LEAST_PROBABILITY or overlap < LEAST_OVERLAP:
                doubted.add(i)
                continue
            of_line[i] = family
            got.append((i, family, p, overlap))
        for words, lines in blocks(rows):
            for a, b in self.stretches(words, lines):
                part = " ".join(words[max(0, a - CONTEXT) : b + 1 + CONTEXT])
                if not TRIGGERS.search(part):
                    continue
                family, p, overlap = self.paragraph(part)
                if family == UNKNOWN or p < LEAST_PROBABILITY or overlap < LEAST_OVERLAP:
                    continue
                over = range(lines[a], lines[b] + 1)
                doubted.difference_update(over)
                if all(of_line.get(i) != family for i in over):
                    got.append((lines[a], family, p, overlap))
        at, family, p, overlap = min(got, key=lambda x: (-x[2], x[0])) if got else (None, None, None, None)
        return {"family": family, "probability": p, "overlap": overlap, "paragraph": at, "families": sorted({x[1] for x in got}), "n_unconfirmed": len(doubted)}


def blocks(rows: list[str]):
    """The words of each block of two or more lines that has a trigger, and the line of each word; a line without words ends a block."""
    words, lines, first = [], [], 0
    for i, line in enumerate([*rows, ""]):
        own = words_of(line.lower())
        if own:
            first = first if words else i
            words += own
            lines += [i] * len(own)
            continue
        if words and i - first > 1 and TRIGGERS.search(" ".join(rows[first:i])):
            yield words, lines
        words, lines = [], []


SCHEMA = "family string, probability double, overlap double, paragraph int, families array<string>, n_unconfirmed int"


def scan(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep and the columns of SCHEMA for every row of docs; family is null where no licence is confirmed."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        rows = [sent.value.scan(t) for t in texts]
        return {k: [r[k] for r in rows] for k in ("family", "probability", "overlap", "paragraph", "families", "n_unconfirmed")}

    return map_texts(docs, keep, SCHEMA, run, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the licence of every document."""
    return scan(read(spark, sf_dir, "documents"), Model(), ["doc_id"])
