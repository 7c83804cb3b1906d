"""Licence scan (operator 5), in DataFrame functions only.

A paragraph is a run of lines without an empty one between them; it also ends where a line
ends a sentence (with one of ``. ! ? : ;``), so a notice wrapped over lines is one paragraph and
two notices on neighbouring lines are two.  Marks of comments at the head of a line are passed over.

A sparse multinomial logistic regression over word 1- to 3-grams, trained on notices of
licence families, invented licences and ordinary sentences, gives each paragraph a probability
for every family, for ``unknown`` (a licence, but none of these) and for ``none``.  Its
probabilities are calibrated by a temperature on held-out variants, and a family whose
calibrated probability is under a threshold, chosen there for few false families, counts as
``unknown`` too.  A predicted family is confirmed by comparing the paragraph with the family's
notices: the largest share of a notice's 2-grams that it holds.

Training runs in the driver on a fixed set of some thousand sentences made from the notices
below; it reads no table.  The weights that lasso leaves become constants of the scan's
column expression.  A paragraph without any word of the pattern ``look`` makes of the weights
cannot be anything but ``none``, so it costs one pattern match.

Null texts count as empty, and very long ones are scanned whole.  Of classes that are equally
likely the first in ``CLASSES`` counts.  Every row gives one row, repeated ones too; an empty
table gives an empty result; further columns are not read.  Equal texts get equal results.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import keyed_texts

# Of each licence family its names, its SPDX identifiers, and sentences of its notices.
FAMILIES = {
    "AGPL": (
        ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPLv3"),
        ("AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-1.0-only", "AGPL-3.0"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",),
    ),
    "Apache": (
        ("Apache License", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"),
        ("Apache-2.0", "Apache-1.1", "Apache-1.0"),
        (
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
            'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        ),
    ),
    "Artistic": (
        ("Artistic License", "Artistic License 2.0", "Perl Artistic License"),
        ("Artistic-2.0", "Artistic-1.0"),
        ("This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.",),
    ),
    "BSD": (
        ("BSD License", "BSD-style license", "3-Clause BSD License", "2-Clause BSD License", "New BSD License", "Simplified BSD License"),
        ("BSD-3-Clause", "BSD-2-Clause", "BSD-4-Clause", "0BSD"),
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        ),
    ),
    "Boost": (
        ("Boost Software License", "Boost Software License, Version 1.0"),
        ("BSL-1.0",),
        (
            'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
            "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software.",
        ),
    ),
    "CC-BY": (
        ("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC BY 3.0", "CC BY"),
        ("CC-BY-4.0", "CC-BY-3.0"),
        (),
    ),
    "CC-BY-NC": (
        ("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0", "CC BY-NC"),
        ("CC-BY-NC-4.0", "CC-BY-NC-3.0"),
        (),
    ),
    "CC-BY-SA": (
        ("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC BY-SA"),
        ("CC-BY-SA-4.0", "CC-BY-SA-3.0"),
        (),
    ),
    "EPL": (
        ("Eclipse Public License", "Eclipse Public License, version 2.0", "Eclipse Public License - v 1.0"),
        ("EPL-2.0", "EPL-1.0"),
        ('THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").',),
    ),
    "EUPL": (
        ("European Union Public Licence", "European Union Public Licence, version 1.2", "EUPL"),
        ("EUPL-1.2", "EUPL-1.1"),
        ('This European Union Public Licence (the "EUPL") applies to the Work (as defined below) which is provided under the terms of this Licence.',),
    ),
    "GPL": (
        ("GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPLv3", "GPLv2"),
        ("GPL-3.0-or-later", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-2.0-only", "GPL-3.0"),
        (
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ),
    ),
    "ISC": (
        ("ISC License", "ISC licence"),
        ("ISC",),
        (
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        ),
    ),
    "LGPL": (
        ("GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 2.1", "GNU Library General Public License", "GNU LGPL", "LGPLv3"),
        ("LGPL-3.0-or-later", "LGPL-3.0-only", "LGPL-2.1-or-later", "LGPL-2.1-only", "LGPL-2.0-only"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",),
    ),
    "MIT": (
        ("MIT License", "MIT licence", "MIT/Expat License"),
        ("MIT", "MIT-0"),
        (
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        ),
    ),
    "MPL": (
        ("Mozilla Public License", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"),
        ("MPL-2.0", "MPL-1.1"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ),
    "Unlicense": (
        ("Unlicense", "CC0 1.0 Universal", "Creative Commons Zero license"),
        ("Unlicense", "CC0-1.0"),
        ("This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under CC0 1.0 Universal.",
         "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ),
    "WTFPL": (("WTFPL", "Do What The Fuck You Want To Public License"), ("WTFPL",), ("You just DO WHAT THE FUCK YOU WANT TO.",)),
    "Zlib": (
        ("zlib License", "zlib/libpng License"),
        ("Zlib",),
        ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
         "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
         "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ),
}
NAMED = (
    "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "License: {}", "Licence: {}",
    "This project is licensed under the terms of the {}.", "Licensed under {}.", "Use of this source code is governed by the {} that can be found in the LICENSE file.",
    "It is available under the {}; see the file COPYING for details.", "This file is part of a work covered by the {}.",
)
IDENTIFIED = ("SPDX-License-Identifier: {}", "License: {}", "license = {}", "Licensed under {}.", "{}")
#: Ways of naming a licence that training never sees: the first for calibration, the others for tests.
CALIBRATION = ("Offered to all under the {}.", "The text of the {} applies to this code.", "All of it falls under {}.")
UNSEEN = ("Made available under the terms of the {}.", "The code is published under the {}.", "You can use it under the conditions of the {}.", "Shared under {}.", "Provided to you under the {} only.")
INVENTED = (
    "Licensed under the {} Community License, version {}.",
    "This work is licensed under the {} License.",
    "Released under the {} Source Agreement {}.",
    "Distributed under the {} Public License, version {}.",
    "SPDX-License-Identifier: LicenseRef-{}",
    "License: {} Commercial License",
    "You may use this file only under the terms of the {} Public Use License.",
    "All use is subject to the {} end user licence agreement.",
    "This project is licensed under the terms of the {} {} License.",
)
# Like families, but none of them: works that must not be changed.
NEAR = tuple(
    t.format(n)
    for n in (
        "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
        "CC BY-ND 4.0", "CC BY-NC-ND 4.0", "CC BY-ND", "CC BY-NC-ND", "CC-BY-ND-4.0", "CC-BY-NC-ND-4.0",
    )
    for t in ("Licensed under {}.", "This work is licensed under the {}.")
)
ORDINARY = (
    "The {} of the {} was {} to be read by any person in the {}.",
    "She renewed her driving license at the {} office on {}.",
    "He lost his fishing licence under the {} bridge.",
    "Permission to enter the {} was granted free of {} for the {}.",
    "A general meeting of the public {} took place under the {}.",
    "The source of the {} is subject to change without notice, version {}.",
    "He is a student at MIT and works on the {} of {}.",
    "Copyright {} by the {} and all of its {}.",
    "The apache {} rode over the {} with a copy of the {}.",
    "{} {} {} {} {} {} {}.",
    "This software is used for any purpose by the {} and {}.",
    "The commons and the {} library were free and open under {} terms.",
    "The new boost to the {} was published in version {} of the {} software.",
    "A solar eclipse over the {} drew the public to the {}, a creative {} in general.",
    "The european union of {} granted the {} a public {}.",
    "The artistic {} of the {} was distributed to all {} and released in {}.",
    "The license plate of the {} was found near the MIT campus by the {}.",
    "Her licence plate and the {} license number were public at the {} university.",
    "The mozilla {} and the {} foundation met near the MIT library for a general {}.",
    "Without a license from the {} no person may drive or fish on the {} campus.",
)
NONE, UNKNOWN = "none", "unknown"
CLASSES = (NONE, UNKNOWN, *sorted(FAMILIES))
#: Words that alone, or only with each other, say nothing of licences.
PLAIN = frozenset(
    "a all an and any are as at be been but by can either following for from get has have he his if in including into is it its kind may met must no not of off on only or "
    "other out over part particular person provided she so such that the their them there these they this to under use used was were will with without you your available work file files".split()
)
WORD = "[a-z0-9]+"
CONFIRM = 0.5


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(found: list[str]) -> list[str]:
    return [" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def telling(gram: str) -> bool:
    """Has the n-gram a word that is no plain one and no number?"""
    return any(w not in PLAIN and not w.isdigit() for w in gram.split())


def notices(family: str) -> tuple[str, ...]:
    """What paragraphs of the family are compared with: its names of two words or more, its identifiers where they stand, its sentences."""
    names, ids, sentences = FAMILIES[family]
    return (*(n for n in names if len(words(n)) > 1), *(f"{at} {i}" for i in ids for at in ("identifier:", "license:")), *(n for n in (*names, *ids) if len(words(n)) == 1 and len(n) > 3), *(i for i in ids if len(words(i)) > 1), *sentences)


def patterns(family: str) -> list[str]:
    names, ids, sentences = FAMILIES[family]
    return [*(t.format(n) for n in names for t in NAMED), *(t.format(i) for i in ids for t in IDENTIFIED if t != "{}" or len(words(i)) > 1), *sentences * 9]


def _sentences(rng: np.random.Generator, each: int, named: tuple[str, ...] = ()) -> tuple[list[list[str]], np.ndarray]:
    """Variants: words lost, notices cut short or set among other words.  named: families are named in these ways only."""
    invent = ["".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list("aeiou")) for _ in range(rng.integers(1, 5))) for _ in range(400)]
    holders: dict[str, set] = {}
    for n in FAMILIES:
        for w in {w for x in notices(n) for w in words(x) if telling(w)}:
            holders.setdefault(w, set()).add(n)
    common, licensed = sorted(PLAIN), sorted({w for w, own in holders.items() if len(own) > 1} | {w for t in (*INVENTED, *NEAR) for w in words(t) if telling(w)})

    def filler(n: int) -> list[str]:
        return [str(w) for w in rng.choice(invent if rng.random() < 0.5 else common, n)]

    def fill(pattern: str) -> list[str]:
        return words(pattern.format(*[str(w) for w in rng.choice(invent, pattern.count("{}"))]))

    def stray() -> list[str]:
        """Ordinary words with one or two of a licence's among them."""
        out = filler(rng.integers(6, 20))
        for w in rng.choice(licensed, rng.integers(1, 3)):
            out.insert(int(rng.integers(0, len(out))), str(w))
        return out

    rows, labels = [], []
    for label, name in enumerate(CLASSES):
        own = ORDINARY if name == NONE else INVENTED * 3 + NEAR if name == UNKNOWN else patterns(name)
        if named and name in FAMILIES:
            own = [t.format(n) for n in (*FAMILIES[name][0], *FAMILIES[name][1]) for t in named]
        for k in range(each * (10 if name == NONE else 4 if name == UNKNOWN else 1)):
            if name == NONE and k % 2:
                found = stray()
            else:
                found = fill(own[k % len(own)]) if name in (NONE, UNKNOWN) else words(own[k % len(own)])
                if k >= len(own):
                    lost = 0.06 if len(found) > 9 else 0.0
                    found = [w for w in found if rng.random() >= lost] or found
                    if len(found) > 16 and rng.random() < 0.5:
                        found = found[: max(10, int(len(found) * rng.uniform(0.6, 1)))]
                if rng.random() < 0.6:
                    found = filler(rng.integers(0, 9)) + found + filler(rng.integers(0, 9))
            rows.append(found)
            labels.append(label)
    return rows, np.array(labels)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Model:
    features: tuple[str, ...]
    weights: np.ndarray  # features by classes
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        known, z = {f: i for i, f in enumerate(self.features)}, self.bias.copy()
        for f in dict.fromkeys(grams(words(text))):
            if f in known:
                z = z + self.weights[known[f]]
        return _softmax(z[None] / self.temperature)[0]


@lru_cache(maxsize=1)
def trained(seed: int = 11, each: int = 220, penalty: float = 1e-4, rounds: int = 200) -> Model:
    rows, y = _sentences(np.random.default_rng(seed), each)
    texts = [t for name in FAMILIES for t in patterns(name)] + [part for t in (*INVENTED, *NEAR, *ORDINARY) for part in t.split("{}")]
    vocabulary = {g for t in texts for g in grams(words(t)) if telling(g)}
    seen = Counter(g for r in rows for g in set(grams(r)) & vocabulary)
    vocabulary = sorted(g for g, n in seen.items() if n >= 4)
    place = {g: i for i, g in enumerate(vocabulary)}

    def matrix(sentences):
        x = np.zeros((len(sentences), len(vocabulary)), np.float32)
        for i, s in enumerate(sentences):
            x[i, [place[g] for g in grams(s) if g in place]] = 1
        return x

    x, target = matrix(rows), np.eye(len(CLASSES), dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    wz, bz, t = w, b, 1.0
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = np.float32(2.0 / (np.linalg.norm(x @ v) ** 2 / len(x) + 1))
    for _ in range(rounds):
        g = (_softmax(x @ wz + bz) - target) / np.float32(len(x))
        new = wz - rate * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * np.float32(penalty), 0)
        new_b = bz - rate * g.sum(axis=0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        step = np.float32((t - 1) / t_new)
        wz, bz, w, b, t = new + step * (new - w), new_b + step * (new_b - b), new, new_b, t_new
    # Calibration on ways of naming licences that were not trained on.
    held, truth = _sentences(np.random.default_rng(seed + 1), 40, CALIBRATION)
    z = (matrix(held) @ w + b).astype(np.float64)
    temperatures = np.geomspace(0.2, 5, 40)
    loss = [-np.log(_softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    best = p.argmax(axis=1)
    # The least threshold from 0.5 on by which at most one in a hundred of the families named is wrong.
    top, family = p.max(axis=1), best > 1
    threshold = next((t for t in np.arange(0.5, 0.95, 0.01) if (best != truth)[family & (top >= t)].mean() <= 0.01), 0.95)
    threshold = float(threshold)
    w, b = w.astype(np.float64), b.astype(np.float64)
    used = np.flatnonzero(np.abs(w).max(axis=1) > 1e-3)
    return Model(tuple(vocabulary[i] for i in used), np.round(w[used], 6), np.round(b, 6), round(temperature, 6), round(threshold, 6))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: lambdas have no other way to name something."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def look(model: Model) -> str:
    """A pattern that every paragraph holds for which the classifier can say anything but ``none``.

    Without any of its words the features left cannot add up, for any class, to the lead that
    ``none`` has in the bias, so the classifier's answer on such a paragraph is known.
    """
    gain = np.maximum(model.weights - model.weights[:, :1], 0)[:, 1:]
    lead = model.bias[0] - model.bias[1:]
    most: dict[str, float] = {}
    for f, g in zip(model.features, gain.max(axis=1)):
        for w in f.split():
            if telling(w):
                most[w] = max(most.get(w, 0.0), g)
    chosen: set[str] = set()
    for w in [*sorted(most, key=lambda w: (-most[w], w)), ""]:
        left = [i for i, f in enumerate(model.features) if chosen.isdisjoint(f.split())]
        if (gain[left].sum(axis=0) < lead).all():
            return f"(?i)(?<![a-z0-9])(?:{'|'.join(sorted(chosen))})(?![a-z0-9])"
        chosen.add(w)
    return ""


def __getattr__(name: str) -> str:
    if name == "LOOK":
        return look(trained())
    raise AttributeError(name)


def _grams(found: Column) -> Column:
    n = F.size(found)
    two = F.zip_with(F.slice(found, 1, F.greatest(n - 1, F.lit(0))), F.slice(found, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    three = let(
        two,
        lambda t: F.zip_with(
            F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(found, 3, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)
        ),
    )
    return F.concat(found, two, three)


def constant(value, kind: str) -> Column:
    """A nested list as one literal, which Spark folds: thousands of single ones take seconds to plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


#: Places that features are dealt to by hash; a place holds few.
PLACES = 4093


def _hash(text: str) -> int:
    """Spark's own checksum of a string: the same number in training and in columns."""
    return zlib.crc32(text.encode()) % PLACES


def classify(paragraph: Column, model: Model) -> Column:
    """struct(family, probability, similarity, confirmed) of a paragraph."""
    names = F.array(*map(F.lit, CLASSES))
    dealt: list[list[dict]] = [[] for _ in range(PLACES)]
    for i, f in enumerate(model.features):
        dealt[_hash(f)].append({"f": f, "i": i})
    places = constant(dealt, "array<array<struct<f:string,i:int>>>")
    weights = constant([list(map(float, row)) for row in model.weights], "array<array<double>>")
    bias = F.array(*map(F.lit, map(float, model.bias)))
    found = F.regexp_extract_all(F.lower(paragraph), F.lit(f"({WORD})"), F.lit(1))

    def place(x: Column) -> Column:
        """Where the weights of an n-gram are, or null."""
        near = F.get(places, (F.crc32(x.cast("binary")) % PLACES).cast("int"))
        return F.get(F.filter(near, lambda s: s["f"] == x), F.lit(0))["i"]

    def scores(g: Column) -> Column:
        used = F.filter(F.transform(F.array_distinct(g), place), lambda i: i.isNotNull())
        z = F.aggregate(used, bias, lambda acc, i: F.zip_with(acc, F.get(weights, i), lambda a, b: a + b))
        e = let(z, lambda z: F.transform(z, lambda v: F.exp((v - F.array_max(z)) / F.lit(model.temperature))))
        return let(e, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))

    def similar(g: Column, family: Column) -> Column:
        """The largest share of a notice's 2-grams that the paragraph holds."""
        out = F.lit(0.0)
        for name in FAMILIES:
            shares = []
            for notice in notices(name):
                w = words(notice)
                own = sorted({" ".join(w[i : i + 2]) for i in range(len(w) - 1)} or set(w))
                shares.append(F.size(F.array_intersect(g, F.array(*map(F.lit, own)))) / F.lit(float(len(own))))
            out = F.when(family == name, F.greatest(*shares) if len(shares) > 1 else shares[0]).otherwise(out)
        return out

    def judged(g: Column) -> Column:
        def named(p: Column) -> Column:
            top = F.array_max(p)
            first = F.element_at(names, F.array_position(p, top).cast("int"))
            family = F.when(~first.isin(NONE, UNKNOWN) & (top < model.threshold), F.lit(UNKNOWN)).otherwise(first)
            return F.struct(family.alias("family"), F.round(top, 6).alias("probability"), g.alias("grams"))

        def confirmed(s: Column) -> Column:
            return let(
                similar(s["grams"], s["family"]),
                lambda share: F.struct(
                    s["family"].alias("family"), s["probability"].alias("probability"), F.round(share, 6).alias("similarity"), (share >= CONFIRM).alias("confirmed")
                ),
            )

        return let(let(scores(g), named), confirmed)

    return let(_grams(found), judged)


#: A line's end inside a sentence, with the marks of a comment at the head of the next line.
WRAPPED = r"(?<=[^\s.!?:;])[ \t]*\r?\n[ \t]*(?:(?:#+|//+|\*+|;+|--+|%+)[ \t]*)?(?=[^\s#/*;%-])"


def paragraphs(text: Column) -> Column:
    return F.split(F.regexp_replace(text, WRAPPED, " "), "\n", -1)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, found: array of (paragraph, family, probability, similarity, confirmed) of each text."""
    model = model or trained()
    pattern = look(model)
    numbered = F.transform(paragraphs(F.col("text")), lambda p, i: F.struct(i.alias("paragraph"), p.alias("line")))
    looked = F.filter(numbered, lambda s: s["line"].rlike(pattern))
    rows = keyed_texts(docs).select("doc_id", F.when(F.col("text").rlike(pattern), looked).otherwise(F.array().cast("array<struct<paragraph:int,line:string>>")).alias("looked"))
    judged = F.transform(
        "looked",
        lambda s: let(
            classify(s["line"], model),
            lambda c: F.struct(
                s["paragraph"].alias("paragraph"), c["family"].alias("family"), c["probability"].alias("probability"),
                c["similarity"].alias("similarity"), c["confirmed"].alias("confirmed"),
            ),
        ),
    )
    return rows.select("doc_id", F.filter(judged, lambda c: c["family"] != NONE).alias("found"))


def licence_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_licences, n_confirmed, families and those of them that a notice confirms (sorted, by comma), first_paragraph, probability (the largest)."""
    found = scan(docs)
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_licences"),
        F.size(F.filter("found", lambda c: c["confirmed"])).cast("long").alias("n_confirmed"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("found", lambda c: c["family"])))).alias("families"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda c: c["confirmed"]), lambda c: c["family"])))).alias("confirmed_families"),
        F.coalesce(F.array_min(F.transform("found", lambda c: c["paragraph"])), F.lit(-1)).cast("long").alias("first_paragraph"),
        F.coalesce(F.array_max(F.transform("found", lambda c: c["probability"])), F.lit(0.0)).alias("probability"),
    )
