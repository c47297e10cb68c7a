"""Licence scans: a trained paragraph classifier in DataFrame expressions alone.

Paragraphs end at blank lines. Each line is judged alone, and, as notices are wrapped, so are
the words of a paragraph of several lines, in runs of RUN words that begin every STEP words.
A multinomial logistic regression over the presence of word 1- to 3-grams of licence templates
(only n-grams with a licence word: a template word that a sample of the corpus hardly ever
uses) gives each a probability for every licence family and for *unknown*. It is trained on the driver from variants of the fixed templates and a bounded
sample of corpus lines; a held-out part sets a temperature and the offset of the unknown class
(its calibration). Templates are whole public texts, headers, notices and tags, in pieces of at
most PIECE words; notices of other licences are trained as unknown. A line whose best family
reaches ``threshold`` is predicted, and confirmed if it holds ``overlap`` of the n-grams of one
of that family's templates, or is most of one (its n-grams are, to that share, those of a
template) and has at least five words; either way it must hold an n-gram that sets the family
apart from all others.

A family that only runs confirm counts once for a document, as one predicted and confirmed;
runs that are predicted but not confirmed do not count. ``license`` is the first confirmed
family, by paragraphs, and within one by lines before runs.

Scoring is one narrow pass: lines without a licence word have no feature, so they are unknown
and only looked at by a pattern; the rest is higher-order functions over arrays. No Python
runs on the executors, nothing is shuffled, and the model is a literal of bounded size.

Defined results: null is an empty text, with one empty line; texts of any length are scanned
whole; null ids are carried along; repeated rows get equal rows; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

# Public licence texts, headers, notices and tags by family.
NOTICES = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "all-rights-reserved": ["All rights reserved."],
    "apache": [
        "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "you may not use this file except in compliance with the Apache License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.", "BSD 2-Clause License", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "epl": ["Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it under the terms of the GNU General Public License.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "isc": ["ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License.", "The MIT License (MIT)", "MIT License", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": [
        "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
PIECE = 24  # words of a template at most: so that a run holds whole what wrapped lines part


# Lines that speak of licences without being one.
DECOYS = (
    "a driving license is issued by the state", "the public library is open to all", "all rights and duties of members", "version 3 of the report was released under pressure",
    "the general public was not admitted", "tables reserved for guests", "he released the prisoners under guard", "permission to enter was granted to any person",
    "the software is free of charge this week", "common creative work in the commons", "source code and binary forms of life", "terms of use may change", "mit einer der und", "license plates 2 0 and 4 0",
)
# Notices of licences that no family here stands for.
OTHER_NOTICES = (
    "Distributed under the Boost Software License, Version 1.0.", "Licensed under the European Union Public Licence", "Licensed under the Microsoft Public License", "This file is licensed under the Artistic License 2.0",
    "Licensed under the Open Software License version 3.0", "Use of this software is governed by the Business Source License", "Licensed under the SIL Open Font License, Version 1.1",
)
FAMILIES = sorted(NOTICES)
RUN, STEP = 48, 16  # any 33 words in a row are whole in some run


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def pieces(text: str) -> list[str]:
    """The words of a notice in about equal runs of at most PIECE."""
    w = words(text)
    n = -(-len(w) // PIECE)
    return [" ".join(w[len(w) * k // n : len(w) * (k + 1) // n]) for k in range(n)]




def grams(w: list[str]) -> list[str]:
    return list(dict.fromkeys([*w, *map(" ".join, zip(w, w[1:], strict=False)), *map(" ".join, zip(w, w[1:], w[2:], strict=False))]))


def _templates() -> dict[str, list[str]]:
    """The pieces of each family's notices, without those that a notice of another family holds too."""
    held = {f: [set(grams(words(t))) for t in ts] for f, ts in NOTICES.items()}
    shared = lambda f, p: any(set(grams(words(p))) <= g for other in held if other != f for g in held[other])
    return {f: list(dict.fromkeys(p for t in ts for p in pieces(t) if not shared(f, p))) for f, ts in NOTICES.items()}


TEMPLATES = _templates()


def _marks(family: str) -> set[str]:
    """The n-grams of a family's templates that no notice of another family has."""
    others = {g for f, ts in NOTICES.items() if f != family for t in ts for g in grams(words(t))}
    return {g for t in TEMPLATES[family] for g in grams(words(t))} - others


MARKS = {f: _marks(f) for f in FAMILIES}


@dataclass
class LicenceModel:
    licence_words: list[str]
    vocabulary: list[str]
    weights: np.ndarray  # [vocabulary, families + 1], the last for unknown
    bias: np.ndarray
    temperature: float


def _covers(g: set[str], overlap: float) -> bool:
    return any(len(g & set(grams(words(t)))) >= overlap * len(grams(words(t))) for ts in TEMPLATES.values() for t in ts)


def fit(background: list[str], rare: float = 0.01, variants: int = 10, steps: int = 250, l1: float = 2e-4, seed: int = 5) -> LicenceModel:
    """Train and calibrate on template variants and background lines."""
    rng = random.Random(seed)
    lines = [g for g in (grams(words(t)) for t in background) if g]
    negatives = [g for g in lines if not _covers(set(g), 0.5)] + [grams(words(t)) for t in DECOYS + OTHER_NOTICES] * 6
    seen: dict[str, int] = {}
    for g in lines:
        for x in g:
            seen[x] = seen.get(x, 0) + 1
    template_words = {w for ts in TEMPLATES.values() for t in ts for w in words(t)}
    licence_words = sorted(w for w in template_words if len(w) > 1 and seen.get(w, 0) <= rare * max(len(lines), 100))
    mark = set(licence_words)
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(words(t)) if mark & set(g.split())})
    index = {g: k for k, g in enumerate(vocabulary)}
    stock = [w for g in lines[:200] for w in g if " " not in w] or ["anden"]
    rows, y = [], []
    for f, family in enumerate(FAMILIES):
        for t in TEMPLATES[family]:
            for v in range(variants):
                w = words(t)
                if v:
                    w = [x for x in w if rng.random() > 0.06] or w
                    for _ in range(rng.randint(0, 6)):
                        w.insert(rng.choice([0, len(w)]), rng.choice(stock))
                rows.append(grams(w))
                y.append(f)
    # Lines of unrelated licence words make the unknown class of its own.
    for _ in range(18 * variants):
        w = [rng.choice(stock) for _ in range(rng.randint(3, 12))]
        for _ in range(rng.randint(1, 2)):
            w.insert(rng.randint(0, len(w)), rng.choice(licence_words))
        rows.append(grams(w))
        y.append(len(FAMILIES))
    rows += negatives
    y += [len(FAMILIES)] * len(negatives)
    classes = len(FAMILIES) + 1
    keep = [k for k, r in enumerate(rows) if any(g in index for g in r)]
    x = np.zeros((len(keep) + 1, len(vocabulary)), np.float32)
    for i, k in enumerate(keep):
        x[i, [index[g] for g in rows[k] if g in index]] = 1
    target = np.eye(classes, dtype=np.float32)[[y[k] for k in keep] + [classes - 1]]
    part = np.arange(len(x)) % 5 == 3  # held out for calibration
    weights, bias = np.zeros((len(vocabulary), classes)), np.zeros(classes)
    share = target[~part].sum(0)
    per_row = (target[~part] / share.clip(1)).sum(1)[:, None] / classes  # classes count alike
    xt, tt = x[~part], target[~part]
    step = 4.0 / max(1.0, (xt.sum(1) * per_row[:, 0]).sum())
    mw, mb = weights.copy(), bias.copy()
    t = 1.0
    for _ in range(steps):
        p = _softmax(xt @ mw + mb)
        g = (p - tt) * per_row
        new = mw - step * xt.T @ g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b = mb - step * g.sum(0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        mw, mb = new + (t - 1) / t2 * (new - weights), new_b + (t - 1) / t2 * (new_b - bias)
        weights, bias, t = new, new_b, t2
    z, tv = x[part] @ weights + bias, target[part]
    best = (np.inf, 1.0, 0.0)
    for temperature in np.geomspace(0.1, 2, 14):
        for offset in np.linspace(-3, 3, 13):
            q = z.copy()
            q[:, -1] += offset
            loss = -np.log((_softmax(q / temperature) * tv).sum(1).clip(1e-9)).mean()
            best = min(best, (float(loss), float(temperature), float(offset)))
    bias = bias.copy()
    bias[-1] += best[2]
    used = np.abs(weights).max(1) > 1e-6
    return LicenceModel(licence_words, [g for g, u in zip(vocabulary, used, strict=True) if u], weights[used], bias, best[1])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def predict(model: LicenceModel, text: str, threshold: float = 0.5, overlap: float = 0.6) -> tuple[str, float, bool] | None:
    """What scan decides for one line or run, in plain Python: (family, probability, confirmed), or None."""
    w = words(text)
    if not set(w) & set(model.licence_words):
        return None
    hits = [model.vocabulary.index(g) for g in grams(w) if g in set(model.vocabulary)]
    p = _softmax(((model.weights[hits].sum(0) + model.bias) / model.temperature)[None])[0]
    f = int(p[:-1].argmax())
    if p[f] < threshold:
        return None
    g = set(grams(w))
    templates = [set(grams(words(t))) for t in TEMPLATES[FAMILIES[f]]]
    return FAMILIES[f], float(p[f]), bool(g & MARKS[FAMILIES[f]]) and any(len(g & t) >= overlap * len(t) or len(w) >= 5 and len(g & t) >= 0.9 * len(g) for t in templates)


def train(docs: DataFrame, sample: int = 400, sample_bytes: int = 1 << 14, **options) -> LicenceModel:
    """Fit with the lines of about ``sample`` texts, of at most ``sample_bytes`` each, as background."""
    rows = hash_sample(docs.select("doc_id", "text").where("doc_id is not null"), "doc_id", sample).where(F.octet_length("text") <= sample_bytes).select("text").collect()
    return fit([line for r in rows for line in r["text"].split("\n")], **options)


def _strings(values) -> str:
    return "array(" + ",".join(f"'{v}'" for v in values) + ")"


def scan(docs: DataFrame, model: LicenceModel, threshold: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """Each row of docs as (doc_id, n_lines, n_predicted, n_confirmed, families, license, probability)."""
    mark = "(?<![a-z0-9])(?:" + "|".join(sorted(model.licence_words)) + ")(?![a-z0-9])"
    numbers = ",".join("array(" + ",".join(f"{v:.9g}D" for v in row) + ")" for row in model.weights)
    table = f"map_from_arrays({_strings(model.vocabulary)}, array({numbers}))"
    bias = "array(" + ",".join(f"{v:.9g}D" for v in model.bias) + ")"
    templates = "map_from_arrays(" + _strings(FAMILIES) + ", array(" + ",".join("array(" + ",".join(_strings(grams(words(t))) for t in TEMPLATES[f]) + ")" for f in FAMILIES) + "))"
    marks = "map_from_arrays(" + _strings(FAMILIES) + ", array(" + ",".join(_strings(sorted(MARKS[f])) for f in FAMILIES) + "))"
    names, last = _strings(FAMILIES), len(FAMILIES)
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text.alias("text"), F.lower(text).rlike(mark).alias("some"))
    none = "cast(array() AS array<{}>)"
    out = out.select("doc_id", (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines"), F.expr(f"CASE WHEN some THEN filter(split(lower(text), '\\n\\\\s*\\n'), p -> p rlike '{mark}') ELSE {none.format('string')} END").alias("paragraphs"))
    found = "regexp_extract_all({}, '[a-z0-9]+', 0)"
    out = out.select("doc_id", "n_lines", F.expr(f"transform(paragraphs, p -> struct(transform(filter(split(p, '\\n'), l -> l rlike '{mark}'), l -> {found.format('l')}) AS lines, CASE WHEN instr(p, '\\n') > 0 THEN {found.format('p')} ELSE {none.format('string')} END AS w))").alias("q"))
    runs = f"filter(transform(sequence(0, greatest(0, size(q.w) - {RUN - STEP + 1}), {STEP}), i -> slice(q.w, i + 1, {RUN})), r -> arrays_overlap(r, {_strings(model.licence_words)}))"
    out = out.select("doc_id", "n_lines", F.expr(f"flatten(transform(q, q -> concat(transform(q.lines, l -> struct(l AS w, false AS run)), transform({runs}, r -> struct(r AS w, true AS run)))))").alias("u"))
    pairs = "CASE WHEN size(u.w) > 1 THEN transform(sequence(0, size(u.w) - 2), i -> concat(u.w[i], ' ', u.w[i + 1])) ELSE cast(array() AS array<string>) END"
    triples = "CASE WHEN size(u.w) > 2 THEN transform(sequence(0, size(u.w) - 3), i -> concat(u.w[i], ' ', u.w[i + 1], ' ', u.w[i + 2])) ELSE cast(array() AS array<string>) END"
    out = out.select("doc_id", "n_lines", F.expr(f"transform(u, u -> struct(array_distinct(concat(u.w, {pairs}, {triples})) AS g, size(u.w) AS n, u.run AS run))").alias("g"))
    scores = f"aggregate(array_intersect(g.g, {_strings(model.vocabulary)}), {bias}, (s, x) -> zip_with(s, wt[x], (a, b) -> a + b), s -> transform(s, v -> v / {model.temperature!r}D))"
    out = out.select("doc_id", "n_lines", F.expr(f"transform(g, g -> struct(g.g AS g, g.n AS n, g.run AS run, {scores.replace('wt[x]', table + '[x]')} AS z))").alias("s"))
    out = out.select("doc_id", "n_lines", F.expr("transform(s, s -> struct(s.g AS g, s.n AS n, s.run AS run, s.z AS z, aggregate(s.z, 0D, (t, v) -> t + exp(v - array_max(s.z))) AS total))").alias("s"))
    best = f"array_max(slice(s.z, 1, {last}))"
    out = out.select("doc_id", "n_lines", F.expr(f"transform(s, s -> struct(s.g AS g, s.n AS n, s.run AS run, {names}[array_position(s.z, {best}) - 1] AS family, exp({best} - array_max(s.z)) / s.total AS p))").alias("s"))
    out = out.select("doc_id", "n_lines", F.expr(f"transform(filter(s, s -> s.p >= {threshold!r}D), s -> struct(s.run AS run, s.family AS family, s.p AS p, arrays_overlap({marks}[s.family], s.g) AND exists({templates}[s.family], t -> size(array_intersect(t, s.g)) >= {overlap!r}D * size(t) OR s.n >= 5 AND size(array_intersect(t, s.g)) >= 0.9D * size(s.g)) AS ok))").alias("s"))
    out = out.select("doc_id", "n_lines", F.expr("filter(s, s -> s.ok OR NOT s.run)").alias("s"))
    out = out.select("doc_id", "n_lines", "s", F.expr("filter(s, s -> NOT s.run)").alias("l"), F.expr("filter(s, s -> s.ok)").alias("c"))
    only_runs = F.expr("size(array_except(transform(filter(c, s -> s.run), s -> s.family), transform(filter(c, s -> NOT s.run), s -> s.family)))")
    return out.select(
        "doc_id", "n_lines", (F.size("l") + only_runs).cast("long").alias("n_predicted"), (F.expr("size(filter(c, s -> NOT s.run))") + only_runs).cast("long").alias("n_confirmed"),
        F.expr("array_join(array_sort(array_distinct(transform(c, s -> s.family))), ',')").alias("families"),
        F.expr("coalesce(try_element_at(c, 1).family, 'unknown')").alias("license"), F.expr("array_max(transform(s, s -> s.p))").alias("probability"),
    )
