"""Licence statements in documents, by a trained paragraph classifier.

Paragraphs are lines, and also pairs of neighbouring lines, since statements are wrapped. Words and their pairs and triples are the features of a multinomial
logistic regression with an L1 penalty, so few have weights. It is trained here on the
statements below, each also with words left out and words around it, on statements that name
licences of no family as the class `unknown`, and on a bounded sample of the corpus' paragraphs and some
sentences about permits as the class `none`. A temperature fitted on further variants calibrates the
probabilities. A family is named if its probability is `CERTAIN` or more and the paragraph
holds enough neighbouring words of one of its statements, with a word that only this family uses where
the statement has one; a paragraph that is probably not `none` but names no family so is `unknown`.
A pair of lines is reported, at the first of them, if it names a family and neither line does by itself;
what its lines are reported as then gives way.

All words of the statements and their pairs and triples may be features, also where the
sample has them in ordinary sentences: the weights decide. A sampled paragraph weighs as
much as a variant of a statement.

Scoring is SQL within the row: cues are words without which the sum of all other weights cannot
raise the classes over `none`, so that a paragraph without a cue can only be `none` and is left out
before features are made. Where the bias alone does, no paragraph is left out. Nothing is joined or gathered.

NULL and empty texts have no statements. Rows that repeat a doc_id, or lack it, are
reported each. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgloom.llm.rules import bound

#: Most paragraphs of the corpus that train the class `none`, and their characters. They come from
#: documents chosen by hash, a tenth as many on average.
SAMPLE = 3_000
SAMPLE_CHARACTERS = 2_000
CERTAIN = 0.7
CONFIRMED = 0.6
PENALTY = 2e-4
STEPS = 400
NONE, UNKNOWN = "none", "unknown"

# How licence families state themselves.
STATEMENTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license.",
        "This project is available under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.", "This software is licensed under the MIT license.",
        "SPDX-License-Identifier: MIT", "Distributed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.", "Released under the 2-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License", "Released under the GPL v2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only",
        "Released under the LGPL license.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL license.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Published under the Creative Commons Attribution license.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial License.",
        "Published under CC BY-NC for noncommercial use.",
    ),
    "CC0": (
        "Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all "
        "copyright under CC0.", "This is free and unencumbered software released into the public domain.",
    ),
    "proprietary": (
        "All rights reserved.", "Copyright 2020 by the author. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying is prohibited.",
    ),
}
# Names of licences of none of these families, and how they are stated.
OTHER_LICENCES = (
    "Boost Software License", "Eclipse Public License", "Artistic License", "zlib License", "ISC License", "Academic Free License",
    "European Union Public Licence", "PostgreSQL License", "Python Software Foundation License", "Open Software License",
    "Common Public License", "Microsoft Public License", "SIL Open Font License", "University of Illinois License",
    "PHP License", "Do What The Fuck You Want To Public License",
)
OTHER_FORMS = (
    "Licensed under the {}, Version 1.0.", "Released under the {}.", "Distributed under the terms of the {} 2.0.",
    "This program is made available under the {}.",
)
# Sentences with such words that state no licence.
OTHERS = (
    "Her driving license expired last year.", "The council granted a license to the restaurant.", "He was licensed to sell.",
    "All seats were reserved.", "Rights of way cross the field.", "The public general meeting was held in version two of the hall.",
    "She asked for permission to leave.", "The apache helicopter landed.", "A copy of the work was released to the public.",
    "The commons debated the terms.", "The free software was used.", "Students of MIT won the prize.", "The source is a form of code.",
    "The building permit is available under request.", "Version 3 was released in May.",
    "All rights of the tenants were reserved in the license of the hall.",
)

_PUNCTUATION = ".,;:()\"'!?/"


def tokens(text: str) -> list[str]:
    """As `words_sql` splits."""
    return text.lower().translate(str.maketrans(_PUNCTUATION, " " * len(_PUNCTUATION))).replace("\t", " ").replace("\r", " ").split(" ")


def words_sql(text: str) -> str:
    marks = _PUNCTUATION.replace("'", "\\'") + "\\t\\r"
    return f"array_remove(split(translate(lower({text}), '{marks}', '{' ' * (len(_PUNCTUATION) + 2)}'), ' '), '')"


def grams(words: list[str]) -> set[str]:
    words = [w for w in words if w]
    return {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}


_GRAMS_SQL = """array_distinct(concat(w,
    transform(filter(sequence(0, size(w)), i -> i < size(w) - 1), i -> concat_ws(' ', w[i], w[i + 1])),
    transform(filter(sequence(0, size(w)), i -> i < size(w) - 2), i -> concat_ws(' ', w[i], w[i + 1], w[i + 2]))))"""


class Model(NamedTuple):
    families: tuple[str, ...]  # `none` first
    bias: tuple[float, ...]
    weights: tuple[dict[str, float], ...]
    temperature: float
    common: tuple[str, ...]  # words of the sample, most frequent first

    def cues(self, common: Iterable[str] = ()) -> list[str] | None:
        """Words one of which every paragraph has that can be other than `none`; None if any can.

        Words need not be cues while the classes stay below `none` with all features that the other
        words can make: the most common ones are spared first, then short ones.
        """
        none = self.weights[0]
        raises = [{g: v - none.get(g, 0) for g, v in {**dict.fromkeys(none, 0), **t}.items() if v > none.get(g, 0)} for t in self.weights[1:]]
        of = {g: frozenset(g.split(" ")) for table in raises for g in table}
        ahead = np.array(self.bias[1:]) - self.bias[0]

        def below(free: set[str]) -> bool:
            """Whether features of these words alone leave `none` more likely than not."""
            sums = np.array([sum(v for g, v in table.items() if of[g] <= free) for table in raises])
            return np.exp((ahead + sums) / self.temperature).sum() < 0.95

        if not below(set()):
            return None
        words = sorted(set().union(*of.values()), key=lambda w: (len(w), w))
        rank = {w: i for i, w in enumerate(common)}
        free: set[str] = set()
        for word in sorted(words, key=lambda w: rank.get(w, len(rank))):
            if below(free | {word}):
                free.add(word)
        return sorted(set(words) - free)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _others() -> list[str]:
    return [form.format(name) for name in OTHER_LICENCES for form in OTHER_FORMS]


def _variants(background: list[list[str]], rng) -> tuple[list[set[str]], list[int]]:
    """Training examples: statements whole, with words left out, and within other words."""
    examples, labels = [], []
    around = [w for p in background for w in p] or ["text"]
    for k, statements in enumerate([*STATEMENTS.values(), _others()], 1):
        for statement in statements:
            words = [w for w in tokens(statement) if w]
            for turn in range(12):
                kept = [w for w in words if not turn or rng.random() > 0.08]
                if turn % 3 == 2:
                    extra = rng.choice(around, 12).tolist()
                    kept = [*extra[: turn % 7], *kept, *extra[turn % 7 :]]
                examples.append(grams(kept))
                labels.append(k)
    for words in [*background, *(tokens(o) for o in OTHERS for _ in range(6))]:
        examples.append(grams(list(words)))
        labels.append(0)
    return examples, labels


def train(paragraphs: list[str]) -> Model:
    """Learn from the statements and a bounded list of the corpus' paragraphs. Paragraphs
    with a statement's words in a row, which the sample may hold, are left out of `none`."""
    rng = np.random.default_rng(5)
    told = {g for s in STATEMENTS.values() for t in s for g in grams(tokens(t)) if g.count(" ") == 2}
    background = [w for w in ([x for x in tokens(p) if x] for p in paragraphs) if not grams(w) & told]
    examples, labels = _variants(background, rng)
    vocabulary = sorted({g for s in [*STATEMENTS.values(), _others()] for t in s for g in grams(tokens(t))})
    index = {g: i for i, g in enumerate(vocabulary)}
    names = (NONE, *STATEMENTS, UNKNOWN)

    def matrix(sets):
        x = np.zeros((len(sets), len(vocabulary) + 1))
        x[:, -1] = 1
        for i, s in enumerate(sets):
            x[i, [index[g] for g in s if g in index]] = 1
        return x

    # Many examples of `none` have the same features: equal ones are one row with a weight.
    rows, times = np.unique(np.column_stack([matrix(examples), labels]), axis=0, return_counts=True)
    x, y = rows[:, :-1], np.eye(len(names))[rows[:, -1].astype(int)]
    count = times @ y
    # Families weigh alike, and `none` by its examples: what ordinary lines share names no family.
    share = np.array([max(1.0, count[0] / count[1:-1].mean()), *np.ones(len(STATEMENTS) + 1)])
    each = (times * (y @ (share / share.sum() / np.maximum(count, 1))))[:, None]
    w = ahead = np.zeros((x.shape[1], len(names)))
    rate, pace = 2 / np.linalg.eigvalsh((x * each).T @ x)[-1], 1.0
    for _ in range(STEPS):  # accelerated proximal gradient: the L1 penalty leaves few weights
        before, w = w, ahead - rate * (x.T @ (each * (_softmax(x @ ahead) - y)))
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * PENALTY, 0)
        last, pace = pace, (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = w + (last - 1) / pace * (w - before)
    held, truth = _variants(background[: len(background) // 4], rng)
    z, truth = matrix(held) @ w, np.array(truth)
    cost = {t: -np.log(_softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean() for t in np.linspace(0.3, 3, 28)}
    temperature = float(min(cost, key=cost.get))
    counts = Counter(w for p in paragraphs for w in set(tokens(p)))
    common = tuple(sorted(counts, key=lambda w: (-counts[w], w)))
    tables = tuple({g: round(float(w[i, k]), 6) for g, i in index.items() if w[i, k]} for k in range(len(names)))
    return Model(names, tuple(round(float(b), 6) for b in w[-1]), tables, temperature, common)


def sampled_paragraphs(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """At most `sample` paragraphs of documents chosen by the hash of their texts. How many that are
    follows from the number of documents, so no text is sent about to be ranked."""
    wanted = max(1, sample // 10)
    every = max(1, docs.where("text IS NOT NULL").count() // wanted)
    few = docs.where(f"pmod(xxhash64(text), {every}) = 0").selectExpr("explode(split(text, '\\n')) AS line")
    lines = few.where(f"length(line) < {SAMPLE_CHARACTERS}").orderBy(F.xxhash64("line"), "line").limit(sample)
    return [r["line"] for r in lines.collect()]  # bounded by `sample`


def _quoted(items) -> str:
    return "array(" + ", ".join("'" + i.replace("\\", "\\\\").replace("'", "\\'") + "'" for i in items) + ")"


def _templates() -> str:
    """SQL for the statements of each family: pairs of neighbouring words, and the words of no other family."""
    words = {f: {w for t in texts for w in tokens(t)} for f, texts in STATEMENTS.items()}
    others = {w for t in (*OTHERS, *_others()) for w in tokens(t)}
    families = []
    for family, texts in STATEMENTS.items():
        shared = others.union(*(v for f, v in words.items() if f != family))
        told = []
        for text in texts:
            row = [w for w in tokens(text) if w]
            own = sorted({w for w in row if w not in shared}) or row[:1]
            pairs = sorted({f"{a} {b}" for a, b in zip(row, row[1:])}) or row
            told.append(f"struct({_quoted(pairs)} AS pairs, {_quoted(own)} AS own)")
        families.append(f"array({', '.join(told)})")
    return f"array({', '.join(families)})"


def statements(docs: DataFrame, model: Model) -> DataFrame:
    """One row per paragraph that states, or seems to state, a licence: doc_id, paragraph
    (from 0), family, probability, similarity, confirmed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    cues = model.cues(model.common)

    def scored(k: int) -> str:
        table = {g: v for g, v in model.weights[k].items() if v}
        bias = f"{model.bias[k]}D"
        if not table:
            return bias
        values = ", ".join(f"{v}D" for v in table.values())
        hit = f"element_at(array({values}), CAST(array_position({_quoted(table)}, x) AS INT))"
        return f"{bias} + aggregate(array_intersect(g, {_quoted(table)}), 0D, (a, x) -> a + {hit})"

    scores = ", ".join(f"({scored(k)}) / {model.temperature}D" for k in range(len(model.families)))
    fits = "CAST(size(array_intersect(g, t.pairs)) AS DOUBLE) / size(t.pairs) * CAST(arrays_overlap(g, t.own) AS INT)"
    like = f"coalesce(array_max(transform(get({_templates()}, top.i), t -> {fits})), 0D)"
    # Each step is bound to a name, so that it is computed once.
    result = f"struct(e[0] / total AS none, top.i AS i, top.p / total AS p, {like} AS similarity)"
    result = bound("array_max(transform(slice(e, 2, size(e)), (v, i) -> struct(v AS p, i AS i)))", "top", result)
    result = bound("aggregate(e, 0D, (a, b) -> a + b)", "total", result)
    result = bound(bound("array_max(z)", "m", "transform(z, v -> exp(v - m))"), "e", result)
    result = bound(_GRAMS_SQL, "g", bound(f"array({scores})", "z", result))
    sure = f"(r.i < {len(STATEMENTS)} AND r.p >= {CERTAIN} AND r.similarity >= {CONFIRMED})"
    cued = "true" if cues is None else f"arrays_overlap(u.w, {_quoted(cues)})"
    # Lines in words, then each line and pair that has a cue, by its first line; a pair has two lines with words.
    lines = f"transform(split(text, '\\n'), x -> {words_sql('x')})"
    pairs = "filter(transform(l, (w, i) -> struct(i AS at, 2 AS n, concat(w, coalesce(get(l, i + 1), w)) AS w)), u -> size(l[u.at]) > 0 AND size(get(l, u.at + 1)) > 0)"
    units = f"filter(concat(transform(l, (w, i) -> struct(i AS at, 1 AS n, w AS w)), {pairs}), u -> {cued})"
    judged = bound("u.w", "w", bound(result, "r", f"struct(u.at AS at, u.n AS n, r AS r, {sure} AS sure)"))
    # A pair counts if it names what its lines do not; then its lines do not count by themselves.
    named = "filter(h, x -> x.n = 2 AND x.sure AND NOT exists(h, y -> y.n = 1 AND y.sure AND y.at BETWEEN x.at AND x.at + 1))"
    kept = "filter(h, x -> x.n = 1 AND x.r.none < 0.5 AND NOT exists(d, y -> x.at BETWEEN y.at AND y.at + 1))"
    # Of pairs that overlap the first one stands.
    first = "filter(d, x -> NOT exists(d, y -> y.at = x.at - 1))"
    hits = bound(named, "d", f"concat({kept}, {first})")
    found = bound(lines, "l", bound(f"transform({units}, u -> {judged})", "h", hits))
    # As a generator, so that nothing is evaluated apart from the columns.
    each = rows.selectExpr("doc_id", f"inline({found})")
    return each.selectExpr(
        "doc_id", "CAST(at AS LONG) AS paragraph",
        f"CASE WHEN sure THEN {_quoted(STATEMENTS)}[r.i] ELSE '{UNKNOWN}' END AS family",
        "round(r.p, 6) AS probability", "round(r.similarity, 6) AS similarity", "sure AS confirmed",
    )
