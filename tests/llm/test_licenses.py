import re

import pytest

from plumbline.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_result(make_docs, prose):
    rows = [(1, "CC BY cc-by CC BY-NC 4.0"), (2, "All rights  reserved. All rights reserved, GNU General Public\nLicense"), (3, None), (4, ""), (5, "cc byé by cc by"), (None, "cc by"), (6, prose(1, 30_000) + " cc by"), (7, "cc by"), (7, "cc by"), (8, "İ cc by ÀLL rights reserved")]
    out = licenses.scan(make_docs(rows)).collect()
    assert sorted([tuple(r)[:6] for r in out], key=str) == sorted([(i, *base(t)) for i, t in rows], key=str)
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1 for r in out)
    assert licenses.scan(make_docs([])).collect() == []


@pytest.mark.parametrize(
    ("template", "text", "found"),
    [
        ("licensed under <<opt>>the<</opt>> mit license", "it is licensed under mit license now", True),
        ("licensed under <<opt>>the<</opt>> mit license", "licensed under a mit license", False),
        ("copyright <<var:3>> all rights", "copyright 2020 some body all rights", True),
        ("copyright <<var:3>> all rights", "copyright 1 2 3 4 all rights", False),
        ("copyright <<var:3>> all rights", "copyright all rights", True),
        ("a <<opt>>b <<opt>>c<</opt>> d<</opt>> e", "a b d e", True),
        ("a <<opt>>b <<opt>>c<</opt>> d<</opt>> e", "a b c e", False),
    ],
)
def test_automaton(template, text, found):
    assert licenses.Automaton(template).found_in(text.encode().split()) is found


def test_template_without_wording():
    with pytest.raises(ValueError):
        licenses.Automaton("<<opt>>a<</opt>>")


MIT = """Copyright (c) 2020 Some Body. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {holders} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (MIT.format(holders="AUTHORS OR COPYRIGHT HOLDERS"), "mit"),
        (MIT.format(holders="UNIVERSITY OF SOME PLACE"), "mit"),
        (MIT.format(holders="AUTHORS").replace("merge, ", ""), ""),
        ("GNU Lesser General Public License version 3", "gpl,lgpl-3.0"),
        ("the GNU Affero General Public License v3", "agpl-3.0,gpl"),
        ("GNU General Public License v3.0", "gpl,gpl-3.0"),
        ("GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.", "gpl,gpl-2.0,gpl-2.0-or-later"),
        ("GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "gpl,lgpl-2.1,lgpl-2.1-or-later"),
        ("licensed under 4.0", ""),
        ("Apache License, Version 2.0", "apache-2.0"),
        ("under CC BY-NC-SA 4.0.", "cc-by,cc-by-nc-sa-4.0"),
        ("a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0"),
        ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"),
        ("SPDX-License-Identifier: MIT", "mit"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
        ("Released under the MIT License.", "mit"),
        ("Copyright (C) 2001-2004 The Authors, all rights reserved", "copyright-reserved,reserved"),
    ],
)
def test_licenses(text, labels):
    words = text.encode().translate(licenses.TABLE).split()
    joined = b" " + b" ".join(words) + b" "
    found = {label for label, a in licenses.compiled(tuple(licenses.TEMPLATES.items())) if a.found_in(words)}
    found |= {label for p, label in licenses.PHRASES.items() if b" " + p.encode() + b" " in joined}
    assert ",".join(sorted(found)) == labels
