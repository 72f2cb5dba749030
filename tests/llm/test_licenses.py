"""What confirms a licence, and what does not: notices that no maker of examples writes."""

import re

import numpy as np
import pytest

from casewright.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
#: Texts, the licence that is confirmed (None: none may be), and all families that may be told.
CASES = [
    ("Licensed under CC BY 4.0.", "cc-by"), ("Licensed under CC BY-ND 4.0.", "cc-by-nd"), ("Published under CC BY-ND 4.0.", "cc-by-nd"), ("Licensed under CC BY-NC-ND 4.0.", "cc-by-nc-nd"), ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa"), ("Published under CC BY-SA 3.0.", "cc-by-sa"), ("CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"), ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd"),
    ("Licensed under the Apache License, Version 1.1.", None), ("Licensed under the Apache Software License, Version 1.1.", None), ("Licensed under the Apache License, Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-1.1", None),
    ("Licensed under the Apache License 2.0", "apache-2.0"), ("License: Apache-2.0", "apache-2.0"), ("License: MIT", "mit"), ("MIT License", "mit"), ("Licensed under GPLv3", "gpl"), ("Released under the GPLv2.", "gpl"), ("License: GPL-2.0-only", "gpl"), ("This work is dedicated to the public domain under CC0 1.0.", "public-domain"), ("License: CC0", "public-domain"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl"), ("License: LGPL-2.1", "lgpl"), ("Distributed under the terms of the GNU Affero General Public License, version 3.", "agpl"), ("License: BSD-2-Clause", "bsd"), ("Licensed under the Mozilla Public License, version 1.1.", None),
    (MIT, "mit"), (BSD, "bsd"), ("He lost his license in May and had GPL words in mind.", None), ("The new MIT building is by the commons.", None),
]


@pytest.fixture(scope="module")
def rows(spark):
    found = licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "doc_id bigint, text string").repartition(4))
    return {r.doc_id: r for r in found.collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_only_the_right_licence_is_confirmed(rows, k):
    text, want = CASES[k]
    confirmed = {x.split(":")[1] for x in rows[k].paragraphs.split(",") if x.endswith(":true")}
    if want is None:
        assert not confirmed and rows[k].license in ("none", "unknown"), (text, rows[k])
    else:
        assert rows[k].license == want and confirmed <= {want, "proprietary"}, (text, rows[k])


def test_no_notice_of_a_like_licence_confirms_another():
    """Every lead and name of a family, and of one that contradicts it."""
    for family, names in licenses.NAMES.items():
        for lead in licenses.LEADS:
            for name in names:
                said = " ".join(licenses.tokens(f"{lead} {name}"))
                assert licenses.settled_by_words(said, family) == 3, (said, family)
                others = [f for f in licenses.NAMES if f != family and licenses.settled_by_words(said, f) == 3]
                assert not others, (said, family, others)


def test_most_weights_are_zero_and_unseen_paragraphs_are_told():
    model = licenses.trained()
    used = model.weights[model.prints != 0]
    assert np.count_nonzero(used) < 0.2 * used.size
    rows, right, wrong = licenses.examples(600, 123), 0, 0
    for text, y in rows:
        p = model.probabilities(text)
        family = licenses.FAMILIES[p.argmax()]
        if family not in (licenses.NONE, licenses.UNKNOWN) and p.max() < model.limit:
            family = licenses.UNKNOWN if p[0] < 0.5 else licenses.NONE
        right += family == licenses.FAMILIES[y]
        wrong += family not in (licenses.NONE, licenses.UNKNOWN, licenses.FAMILIES[y])
    assert right > 0.96 * len(rows) and wrong <= 0.02 * len(rows)


def test_patterns_are_closed_over_words():
    for family in licenses.NAMES:
        re.compile(licenses.form_pattern(family))
        assert not re.search(licenses.form_pattern(family), "the bsd unix story of a gnu general in mit lab")
