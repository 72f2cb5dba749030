"""License scans: a trained paragraph classifier, confirmed by templates.

A text's lines are paragraphs, and so are neighbouring lines taken together, as
notices are often wrapped; comment signs don't count, and lines without words
part paragraphs. Joined lines are given as one paragraph, at its first line, if
they are confirmed and no line of them shares half of a template of the same
family by itself, or if they are something and no line of them is; other lines
that are pieces of a confirmed notice (wholly, if they seem to be a notice of
another family by themselves) aren't paragraphs of their own. Word n-grams (one to three words) that the
training texts hold are the features of a multinomial logistic regression over
licence families and `none`; it is sparse, as training drives most weights to
zero (an L1 penalty). Probabilities are calibrated by a temperature on held-out
texts, and the limit from which families are right with PRECISION is found on a
third part, to which notices of licences that no family holds belong. A
paragraph whose best family stays below the limit is `unknown` if it is unlikely
to be none. A family is confirmed if half of the
three-word n-grams of one of its templates, or half of those of the paragraph
and LEAST at least, are shared; templates of up to SHORT n-grams count only
whole, and short notices are a lead and one of the family's names. Words that say
which of like licences is meant (`nd` behind `by`, another version, `lesser`)
contradict the others, which they leave unconfirmed. Rights that are reserved in the short form alone
give way to any other confirmed notice of the document.

Weights lie in arrays by a hash of the n-gram, with a fingerprint beside them,
so a look-up takes constant time in a plain expression: no join, no shuffle, no
Python. An n-gram has two slots that it may lie in, and moves another one on
where both are taken (Pagh and Rodler, 2001), so every feature has its place. Texts with none of the words that any feature holds have no features,
and are `none` by the bias alone; a cheap pattern finds them.

Defined cases: a null text is empty and has no paragraphs; repeated rows are
documents of their own; lines of any length are read whole; an empty table gives
no rows; only the named columns are read.
"""

from __future__ import annotations

import functools
import json
import math
import random
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# Notices of public licences, as they are put into files, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the MIT License.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC", "Licensed under the ISC License.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Published under CC BY 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0 1.0).", "Released into the public domain."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without prior written permission of the copyright holder.", "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.", "All rights reserved.", "Proprietary and confidential."],
}
# The names by which a short notice calls a family, behind one of the leads.
LEADS = ["Licensed under", "Released under", "Published under", "Distributed under the terms of", "This project is available under", "License:", "SPDX-License-Identifier:"]
NAMES = {
    "apache-2.0": ["the Apache License, Version 2.0", "Apache-2.0", "the Apache 2.0 License", "Apache License 2.0"], "mit": ["the MIT License", "MIT", "MIT license", "the Expat License"],
    "gpl": ["GPLv3", "GPLv2", "GPL-3.0-or-later", "GPL-2.0-only", "the GPL", "the GPLv3", "the GPLv2", "the GNU GPL", "the GNU General Public License", "the GNU General Public License v2", "the GNU General Public License, version 3"],
    "lgpl": ["LGPLv3", "LGPL-2.1", "the GNU LGPL", "the GNU Lesser General Public License", "the GNU Lesser General Public License, version 3"], "agpl": ["AGPLv3", "AGPL-3.0-only", "the GNU AGPL", "the GNU Affero General Public License", "the GNU Affero General Public License, version 3"],
    "bsd": ["BSD-3-Clause", "BSD-2-Clause", "the BSD License", "a BSD-style license", "the New BSD License", "the BSD 2-Clause License", "the Simplified BSD License"], "mpl-2.0": ["MPL-2.0", "MPL 2.0", "the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0"], "isc": ["ISC", "the ISC License"],
    "cc-by": ["CC BY 4.0", "CC-BY-3.0", "CC BY", "a Creative Commons Attribution 3.0 License", "the Creative Commons Attribution License"], "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-3.0", "CC BY-SA", "the Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-3.0", "CC BY-NC", "the Creative Commons Attribution-NonCommercial License"], "cc-by-nd": ["CC BY-ND 4.0", "CC-BY-ND-3.0", "CC BY-ND", "the Creative Commons Attribution-NoDerivs License"],
    "cc-by-nc-sa": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA-3.0", "CC BY-NC-SA", "the Creative Commons Attribution-NonCommercial-ShareAlike License"], "cc-by-nc-nd": ["CC BY-NC-ND 4.0", "CC-BY-NC-ND-3.0", "CC BY-NC-ND", "the Creative Commons Attribution-NonCommercial-NoDerivs License"],
    "public-domain": ["CC0", "CC0 1.0", "CC0-1.0", "the Unlicense", "Creative Commons Zero"], "proprietary": ["a proprietary license"],
}
# Patterns of those names over a paragraph's words, one space between them.
_NC, _SA, _ND = "(?:nc|non ?commercial)", "(?:sa|share ?alike)", "(?:nd|no ?deriv(?:s|atives|ative works)?)"
_CC = "(?:creative commons(?: license)?(?: cc)?|cc) (?:attribution|by)"
PATTERNS = {
    "apache-2.0": "apache(?: software)? license (?:version |v ?)?2(?: 0)?|apache 2(?: 0)?(?: license)?", "mit": "(?:mit|expat)(?: license)?(?! 0)", "gpl": "(?:gnu )?general public license(?: as published)?|(?:gnu )?gpl(?:v[0-9])?", "lgpl": "(?:gnu )?(?:lesser|library) general public license|(?:gnu )?lgpl(?:v[0-9])?",
    "agpl": "(?:gnu )?affero general public license|(?:gnu )?agpl(?:v[0-9])?", "bsd": "(?:(?:new|modified|revised|simplified) )?bsd(?: [0234] clause)?(?: style)?(?: licen[sc]e)?", "mpl-2.0": "(?:mozilla public license|mpl)(?: version| v)? 2(?: 0)?|mplv2", "isc": "isc(?: license)?",
    "cc-by": _CC, "cc-by-sa": f"{_CC} {_SA}", "cc-by-nc": f"{_CC} {_NC}", "cc-by-nd": f"{_CC} {_ND}", "cc-by-nc-sa": f"{_CC} {_NC} {_SA}", "cc-by-nc-nd": f"{_CC} {_NC} {_ND}", "public-domain": "(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?|unlicense|cc 0 1 0", "proprietary": "proprietary license",
}
# Words that say which of like licences is meant, and so contradict the others' notices.
NEVER = {
    "apache-2.0": "apache(?: software)? license (?:version |v ?)?(?!2\\b)[0-9]", "mpl-2.0": "mozilla public license (?:version |v ?)?(?!2\\b)[0-9]", "gpl": "gnu (?:lesser|library|affero) general", "isc": "substantial portions", "mit": "mit no attribution|mit 0\\b",
    "cc-by": f"(?:\\bby|attribution) (?:{_NC}|{_SA}|{_ND})\\b", "cc-by-sa": f"(?:\\bby|attribution) (?:{_NC}|{_ND})\\b", "cc-by-nd": f"(?:\\bby|attribution) (?:{_NC}|{_SA})\\b", "cc-by-nc": f"\\b{_NC} (?:{_SA}|{_ND})\\b", "cc-by-nc-sa": f"\\b{_NC} {_ND}\\b", "cc-by-nc-nd": f"\\b{_NC} {_SA}\\b",
}
# Words without which a notice isn't of the family, as its other words are those of another's.
MUST = {"lgpl": "lesser|library general|lgpl", "agpl": "affero|agpl", "cc-by-sa": _SA, "cc-by-nc": _NC, "cc-by-nd": _ND, "cc-by-nc-sa": f"{_NC} {_SA}", "cc-by-nc-nd": f"{_NC} {_ND}"}
# Words of notices that no family is to be told from.
LOOSE = [
    "License: see the file LICENSE.", "This file is distributed under the terms stated in its license.", "The license of this work is described elsewhere.", "Licensed under the Foo Public License, version 7.", "Released under the Bar License.", "Subject to the terms of the license agreement with the vendor.",
    "Licensed under the Apache Software License, Version 1.1.", "Licensed under the Apache License, Version 1.1.", "Licensed under the Mozilla Public License, version 1.1.",
]
# Notices of licences that no family holds, which only the limit is found by.
STRANGE = [
    "Licensed under the European Union Public Licence, version 1.2.", "This file is made available under the terms of the Eclipse Public License 2.0.", "Distributed under the Boost Software License, Version 1.0.", "This work is released under the Artistic License 2.0.", "Licensed under the Microsoft Reciprocal License.",
    "Use of this software is governed by the Business Source License included in the file.", "This font is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: EPL-2.0", "Permission to copy this manual is granted by the city council.",
]
# Paragraphs that speak of such words and are no licence.
OTHERS = [
    "He lost his driving license on the way to work.", "The software is free and the version is new.", "The public library is open to any person.", "The version of the story was published in May.", "You may obtain a copy of the book at the desk.", "Use the source of water with care.",
    "The general had the rights of the people in mind.", "All conditions are met.", "They work under the bridge.", "A work of art in the public eye.", "Terms and conditions of sale may change.", "The foundation gave permission to build.", "Nobody is permitted without a ticket.", "The commons lie behind the village.",
    "He had the GPL in mind.", "She studied at MIT and at BSD.", "The ISC met in May.", "We walk by the commons, by and by.", "The rights to the land were reserved.", "Rooms are reserved for all who come.",
]
NONE, UNKNOWN = "none", "unknown"
FAMILIES = [NONE, *TEMPLATES, UNKNOWN]
MOST, SLOTS = 3, 1 << 13
CONFIRMED = 0.5
#: Templates of so many three-word n-grams or fewer confirm only whole.
SHORT = 8
#: The share of accepted families that shall be right.
PRECISION = 0.98
#: Three-word n-grams that a part of a notice shares with its template at least.
LEAST = 5
# Fixed value: the notice that says least; others of the same document go before it.
RESERVED = "All rights reserved."
#: Words too common to be a feature by themselves, or to begin a look-up.
COMMON = frozenset("0 1 2 3 4 5 6 7 8 9 a all an and any are art as at bar be by can either eye from for found from had has he his http if in into is it its later lie may met mind mit new no not of on one only open or org part people person that the their they this to via was way with without work you".split())
#: Words that are a feature only beside others, and only so begin a look-up.
LONE = frozenset(("cc", "nc", "nd", "sa", "isc"))
_SPLIT = "[^a-z0-9]+"
#: Words that begin comment lines; other signs of comments aren't words.
_SIGNS = r"(?i)^\s*(?:dnl|rem)\b"


def tokens(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def grams(words: list[str], vocabulary: set[str] | None = None) -> list[str]:
    """Distinct n-grams of up to MOST words of which one at least isn't COMMON, nor LONE if it is the only one."""
    out = {}
    for n in range(1, MOST + 1):
        for i in range(len(words) - n + 1):
            if not all(w in COMMON or n == 1 and w in LONE for w in words[i : i + n]):
                out[" ".join(words[i : i + n])] = 1
    return [g for g in out if vocabulary is None or g in vocabulary]


@dataclass
class Licenses:
    """Weights by slot (a flat array, FAMILIES a slot), fingerprints, bias and limits."""

    weights: np.ndarray
    prints: np.ndarray
    bias: np.ndarray
    temperature: float
    limit: float
    anchors: list[str]
    vocabulary: dict[str, int]

    def probabilities(self, text: str) -> np.ndarray:
        z = self.bias.copy()
        for g in grams(tokens(text), set(self.vocabulary)):
            z += self.weights[self.vocabulary[g]]
        z = np.exp((z - z.max()) / self.temperature)
        return z / z.sum()


def _cut(rng: random.Random, words: list[str], y: int) -> tuple[list[str], int]:
    """A part of a notice, and its label: unknown if other families' notices hold it too.

    Parts with hardly anything of their own are nobody's, and aren't made.
    """
    others = {g for f, ts in TEMPLATES.items() if f != FAMILIES[y] for t in ts for g in grams(tokens(t))}
    while True:
        n = rng.randint(LEAST + 2, len(words) - 1)
        at = rng.choice((0, len(words) - n, rng.randint(0, len(words) - n)))
        part = words[at : at + n]
        own = len(set(grams(tokens(" ".join(part)))) - others)
        if own == 0 or own > LEAST:
            return part, y if own else FAMILIES.index(UNKNOWN)


def examples(count: int, seed: int) -> list[tuple[str, int]]:
    """Made paragraphs: notices with words changed, cut or wrapped in others; and others."""
    rng = random.Random(seed)
    filler = lambda n: " ".join("".join(rng.choices("aeioulnrstmdh", k=rng.randint(2, 8))) for _ in range(n))
    out = []
    for k in range(count):
        y = k % (len(FAMILIES) + 2)
        y = 0 if y >= len(FAMILIES) else y
        if y == 0:
            words = rng.choice(OTHERS).split() if rng.random() < 0.7 else filler(rng.randint(1, 40)).split()
        else:
            notices = LOOSE if FAMILIES[y] == UNKNOWN else TEMPLATES[FAMILIES[y]]
            words = rng.choice(notices).split()
            if FAMILIES[y] != UNKNOWN and rng.random() < 0.5:
                words = f"{rng.choice([*LEADS, '', '', ''])} {rng.choice(NAMES[FAMILIES[y]])}".split()
            long = [t for t in notices if len(t.split()) > 12] if FAMILIES[y] != UNKNOWN else []
            if long and rng.random() < 0.4:
                words, y = _cut(rng, rng.choice(long).split(), y)
            else:
                for _ in range(rng.choice((0, 0, 1, 2))):
                    i = rng.randrange(len(words))
                    if len(words) > 12:
                        words[i] = filler(1)
        text = " ".join(words)
        if rng.random() < 0.4:
            text = f"{filler(rng.randint(1, 8))} {text}"
        if rng.random() < 0.4:
            text = f"{text} {filler(rng.randint(1, 8))}"
        out.append((text, y))
    return out


def _slots(gram: str) -> tuple[int, int, int]:
    """The two slots of an n-gram, and its fingerprint."""
    h = xxhash.xxh64_intdigest(gram.encode(), seed=42)
    return h % SLOTS, (h >> 32) % SLOTS, h - (1 << 64) if h >= 1 << 63 else h


def placed(grams_: list[str], moves: int = 10_000) -> dict[str, int]:
    """A slot of its own for every n-gram, out of its two."""
    at: dict[int, str] = {}
    for gram in grams_:
        slot = _slots(gram)[0]
        for _ in range(moves):
            gram, at[slot] = at.get(slot), gram
            if gram is None:
                break
            one, two, _ = _slots(gram)
            slot = two if slot == one else one
        else:
            raise ValueError("too many n-grams for the slots")
    return {gram: slot for slot, gram in at.items()}


def strange(count: int, seed: int) -> list[tuple[str, int]]:
    """Made paragraphs of STRANGE, whose label is unknown."""
    rng = random.Random(seed)
    return [(rng.choice(STRANGE), FAMILIES.index(UNKNOWN)) for _ in range(count)]


def limit_of(sure: np.ndarray, right: np.ndarray, precision: float = PRECISION) -> float:
    """The least probability from which answers are right with `precision`; 1 if there is none."""
    order = np.argsort(-sure, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero((share >= precision) & np.append(sure[order][1:] < sure[order][:-1], True))
    return float(sure[order][good[-1]]) if len(good) else 1.0


@functools.lru_cache(maxsize=2)
def trained(count: int = 7000, seed: int = 0, rounds: int = 200, penalty: float = 2e-4) -> Licenses:
    """The classifier of `count` made paragraphs: two thirds fit it, a sixth each calibrates it and finds its limit."""
    data = examples(count, seed)
    parts = [[d for k, d in enumerate(data) if k % 6 in which] for which in ((0, 1, 2, 3), (4,), (5,))]
    fit, held, last = parts[0], parts[1], parts[2] + strange(count // 60, seed)
    seen: dict[str, int] = {}
    named = [f"{lead} {name}" for names in NAMES.values() for name in names for lead in LEADS]
    known = {g for t in [*sum(TEMPLATES.values(), []), *named, *LOOSE, *OTHERS] for g in grams(tokens(t))}
    for text, _ in fit:
        for g in grams(tokens(text), known):
            seen.setdefault(g, len(seen))
    x, y = _matrix(fit, seen), np.array([d[1] for d in fit])
    w, b = np.zeros((len(seen), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    one = np.eye(len(FAMILIES), dtype=np.float32)[y]
    rate = 4.0 / max(1.0, x.sum(axis=1).mean())
    ahead, step = w, 1.0
    for _ in range(rounds):  # proximal gradient steps with momentum (Beck and Teboulle, 2009): the L1 penalty makes the weights sparse
        z = x @ ahead + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        last_w, next_step = w, (1 + math.sqrt(1 + 4 * step * step)) / 2
        w = ahead - rate * (x.T @ (p - one)) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        ahead, step = w + (step - 1) / next_step * (w - last_w), next_step
        b -= rate * (p - one).mean(axis=0)
    z, hy = _matrix(held, seen) @ w + b, np.array([d[1] for d in held])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(hy)), hy] - np.log(np.exp(s).sum(axis=1))).mean())

    low, high = 0.01, 10.0  # the loss has one minimum over the logarithm of the temperature
    for _ in range(60):
        one_third, two_thirds = (math.exp(math.log(low) + (math.log(high) - math.log(low)) * q) for q in (1 / 3, 2 / 3))
        low, high = (low, two_thirds) if loss(one_third) <= loss(two_thirds) else (one_third, high)
    temperature = math.sqrt(low * high)
    z, ly = _matrix(last, seen) @ w + b, np.array([d[1] for d in last])
    p = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
    p /= p.sum(axis=1, keepdims=True)
    best, sure = p.argmax(axis=1), p.max(axis=1)
    named = (best > 0) & (best < FAMILIES.index(UNKNOWN))
    limit = limit_of(sure[named], (best == ly)[named])
    use = np.flatnonzero(np.abs(w).sum(axis=1) > 0)
    names = {i: g for g, i in seen.items()}
    weights, prints = np.zeros((SLOTS, len(FAMILIES))), np.zeros(SLOTS, np.int64)
    vocabulary = placed([names[i] for i in use])
    for i in use:
        slot = vocabulary[names[i]]
        weights[slot], prints[slot] = w[i], _slots(names[i])[2]
    anchors = [*sorted({v for g in vocabulary for v in g.split() if v not in COMMON | LONE}), "cc[^a-z0-9]{1,3}by", "isc license"]
    return Licenses(weights, prints, b, float(temperature), limit, anchors, vocabulary)


def _matrix(rows: list[tuple[str, int]], seen: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(rows), len(seen)), np.float32)
    for k, (text, _) in enumerate(rows):
        for g in grams(tokens(text), set(seen)):
            x[k, seen[g]] = 1
    return x


def _shape(template: str) -> list[str]:
    """The three-word n-grams of a template, or all its words if it has fewer."""
    t = tokens(template)
    return sorted({" ".join(t[i : i + 3]) for i in range(len(t) - 2)} or {" ".join(t)})


def _literal(values: list, kind: str) -> Column:
    """A constant array; the parser is run once, when the plan is optimized."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def form_pattern(family: str) -> str:
    """Short notices over a paragraph's words: a lead and a name of the family, or the name alone."""
    name, lead = PATTERNS[family], "spdx license identifier|licen[sc]e|(?:licen[sc]ed|released|published|distributed|available|offered|covered) (?:under|by)(?: the terms of)?|public domain under"
    form = f"(?:^| )(?:{lead})(?: (?:the|a|an))? (?:{name})(?= |$)|^(?:the )?(?:{name})(?: (?:[0-9]|only|or|later|international|licen[sc]e))*$"
    return form + ("|(?:released|dedicated|placed) (?:in|into|to) the public domain" if family == "public-domain" else "")


def settled_by_words(said: str, family: str) -> int | None:
    """3 if a short notice confirms the family, 0 if words contradict it, None if templates have to tell."""
    if re.search(NEVER.get(family, "(?!)"), said) or not re.search(MUST.get(family, ""), said):
        return 0
    return 3 if re.search(form_pattern(family), said) else None


def anchor_pattern(model: Licenses) -> str:
    return "(?i)(?<![a-z0-9])(?:" + "|".join(model.anchors) + ")(?![a-z0-9])"


def paragraphs(text: Column, model: Licenses) -> Column:
    """Of the lines with features and of joined ones: line (from 0), family, probability, confirmed, reserved."""
    k = len(FAMILIES)
    weights = [_literal([round(float(v), 6) for v in model.weights[:, j]], "double") for j in range(k)]
    prints = _literal(model.prints.tolist(), "bigint")
    shapes = {f: {t: _shape(t) for t in TEMPLATES[f]} for f in TEMPLATES}
    common = _literal(sorted(COMMON | LONE), "string")

    def grams_of(words: Column) -> Column:
        def of(n: int) -> Column:
            at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))

        return F.array_distinct(F.concat(F.array_except(of(1), common), of(2), of(3)))

    def scored(slot: Column) -> Column:
        sums = F.array(*[_summed(slot, weights[j], float(model.bias[j])) for j in range(k)])
        return let(sums, lambda z: let(F.array_max(z), lambda top: let(F.transform(z, lambda v: F.exp((v - top) / F.lit(model.temperature))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))))

    def verdict(words: Column) -> Column:
        slot = lambda h: h.bitwiseAND(F.lit(SLOTS - 1).cast("bigint")).cast("int") + 1
        either = lambda h, one, two: F.when(F.element_at(prints, one) == h, one).when(F.element_at(prints, two) == h, two)
        hits = F.transform(grams_of(words), lambda g: let(F.xxhash64(g), lambda h: let(slot(h), lambda one: let(slot(F.shiftrightunsigned(h, 32)), lambda two: either(h, one, two)))))
        return let(scored(F.array_compact(hits)), lambda p: let(F.array_position(p, F.array_max(p)).cast("int"), lambda best: named(words, p, best)))

    def named(words: Column, p: Column, best: Column) -> Column:
        name = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), best)
        sure = F.element_at(p, best)
        family = F.when((name != NONE) & (name != UNKNOWN) & (sure < model.limit), F.when(F.element_at(p, 1) < 0.5, UNKNOWN).otherwise(NONE)).otherwise(name)
        return let(family, lambda f: let(confirmed(words, f), lambda how: F.struct(f.alias("family"), F.round(sure, 6).alias("probability"), how.alias("how"))))

    def confirmed(words: Column, family: Column) -> Column:
        """What confirms the family: 0 nothing, 1 only RESERVED, 2 a part of a notice, 3 half of one or more."""
        at = F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1)))
        own = F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, 3), " ")))

        def near(mine: Column, template: str, shape: list[str]) -> Column:
            n = F.size(F.array_intersect(mine, _literal(shape, "string")))
            whole = F.lit(1 if template == RESERVED else 3)
            least = len(shape) if len(shape) <= SHORT else CONFIRMED * len(shape)
            return let(n, lambda k: F.when(k >= F.lit(least), whole).when((k >= LEAST) & (k >= CONFIRMED * F.size(mine)) & F.lit(len(shape) > SHORT), 2).otherwise(0))

        def shared(mine: Column, said: Column) -> Column:
            out = F.lit(0)
            for f, templates in shapes.items():
                wrong = said.rlike(NEVER.get(f, "(?!)")) | ~said.rlike(MUST.get(f, ""))
                best = F.array_max(F.array(*[near(mine, t, shape) for t, shape in templates.items()]))
                out = F.when(family == f, F.when(wrong, 0).when(said.rlike(form_pattern(f)), 3).otherwise(best)).otherwise(out)
            return out

        return let(F.array_join(words, " "), lambda said: let(own, lambda mine: shared(mine, said)))

    anchor = anchor_pattern(model)
    words = lambda x: F.filter(F.split(F.lower(x), _SPLIT), lambda w: w != "")
    unit = lambda line, last, x: F.struct(line.cast("bigint").alias("line"), last.cast("bigint").alias("last"), x.alias("x"))

    def joined(lines: Column) -> Column:
        """Runs of two and more neighbouring lines that have anchors, or stand between two that do.

        Other lines are emptied, so that runs are parted by two line ends; each
        line's number goes before it for the time of the cut.
        """
        on = lambda i: F.coalesce(F.get(lines, i)["on"], F.lit(False))
        live = F.transform(lines, lambda s, i: F.when(s["on"] | (on(i - 1) & on(i + 1) & s["x"].rlike("[A-Za-z0-9]")), F.concat(i.cast("string"), F.lit("\2"), F.regexp_replace(s["x"], _SIGNS, ""))).otherwise(F.lit("")))
        runs = F.filter(F.split(F.array_join(live, "\n"), "\n\n+"), lambda r: F.contains(F.btrim(r, F.lit("\n")), F.lit("\n")))
        return F.transform(runs, lambda r: let(F.btrim(r, F.lit("\n")), lambda b: let(F.substring_index(b, "\2", 1).try_cast("bigint"), lambda first: unit(first, first + F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit(""))), F.regexp_replace(b, r"(?md)^[0-9]+\x02", "")))))

    def judged(units: Column) -> Column:
        return F.transform(units, lambda s: let(words(s["x"]), lambda w: let(verdict(w), lambda v: F.struct(s["line"].alias("line"), s["last"].alias("last"), w.alias("w"), v["family"].alias("family"), v["probability"].alias("probability"), v["how"].alias("how")))))

    def piece(words: Column, family: Column, share: Column) -> Column:
        """Whether that share of a line's three-word n-grams is of the family's notices; less than three words are."""
        own = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, 3), " "))
        of = F.lit(None).cast("array<string>")
        for f, templates in shapes.items():
            of = F.when(family == f, _literal(sorted({g for shape in templates.values() for g in shape}), "string")).otherwise(of)
        return F.when(F.size(words) < 3, True).otherwise(let(F.array_distinct(own), lambda o: F.size(F.array_intersect(o, of)) >= share * F.size(o)))

    def settled(found: Column) -> Column:
        within = lambda a, b: (b["line"] <= a["line"]) & (a["last"] <= b["last"])

        def both(single: Column, runs: Column) -> Column:
            sure = F.filter(runs, lambda r: r["how"] > 0)
            alone = lambda a, r: a["how"].isin(1, 3) & (a["family"] == r["family"])
            share = lambda a: F.when(a["how"].isin(1, 3), 1.0).otherwise(CONFIRMED)
            stay = F.filter(single, lambda a: ~F.exists(sure, lambda r: within(a, r) & ~alone(a, r) & piece(a["w"], r["family"], share(a))))
            more = F.filter(runs, lambda r: ~F.exists(single, lambda a: within(a, r) & F.when(r["how"] > 0, alone(a, r)).otherwise(True)))
            out = F.transform(F.concat(stay, more), lambda v: F.struct(v["line"], v["family"], v["probability"], (v["how"] > 0).alias("confirmed"), (v["how"] == 1).alias("reserved")))
            return F.sort_array(out)

        return let(F.filter(found, lambda v: (v["family"] != NONE) & (v["line"] == v["last"])), lambda single: let(F.filter(found, lambda v: (v["family"] != NONE) & (v["line"] < v["last"])), lambda runs: both(single, runs)))

    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("x"), x.rlike(anchor).alias("on")))
    units = let(lines, lambda ls: F.concat(F.filter(F.transform(ls, lambda s, i: F.when(s["on"], unit(i, i, F.regexp_replace(s["x"], _SIGNS, "")))), lambda u: u.isNotNull()), joined(ls)))
    return let(judged(units), settled)


def _summed(slots: Column, weights: Column, bias: float) -> Column:
    return F.aggregate(slots, F.lit(bias), lambda acc, s: acc + F.element_at(weights, s))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Licenses | None = None) -> DataFrame:
    """A row for each document: families and their number, the surest confirmed family, and its paragraphs."""
    model = model or trained()
    body = F.coalesce(F.col(text), F.lit(""))
    kind = "array<struct<line:bigint,family:string,probability:double,confirmed:boolean,reserved:boolean>>"
    found = F.when(body.rlike(anchor_pattern(model)), paragraphs(body, model)).otherwise(F.array()).cast(kind)
    d = docs.select(F.col(doc_id), found.alias("p"))
    sure = F.sort_array(F.transform(F.filter("p", lambda v: v["confirmed"]), lambda v: F.struct(v["reserved"].alias("r"), (-v["probability"]).alias("a"), v["family"].alias("family"))))
    return d.select(
        doc_id, F.size("p").cast("bigint").alias("n_paragraphs"), F.size(F.filter("p", lambda v: v["confirmed"])).cast("bigint").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("p", lambda v: v["family"]))), ",").alias("families"),
        F.coalesce(F.get(sure, F.lit(0))["family"], F.when(F.size("p") > 0, F.lit(UNKNOWN)).otherwise(F.lit(NONE))).alias("license"),
        F.array_join(F.transform("p", lambda v: F.concat_ws(":", v["line"].cast("string"), v["family"], v["confirmed"].cast("string"))), ",").alias("paragraphs"),
    )
