"""License scan by template-markup matching.

A template is wording with two marks: `<<opt>> ... <</opt>>` holds words that
may be missing, `<<var:N>>` stands for up to N words of any kind. It compiles
to an automaton over tokens; a text holds the template where the automaton
accepts a run of its words, so mandatory wording has to match word for word: the
whole text of short licenses, the notices of long ones, and full names with
their version. A family's name is mandatory, so the Lesser or Affero license is
never taken for the General one. Several templates may share a label (what
follows a colon in a template's name only tells them apart). Beside the
templates, bare phrases are found wherever their words stand consecutively.

Words are runs of digits, letters and non-ASCII characters after A-Z are
lower-cased. Null texts count as empty: no words, no places, score 0. Rows are
independent, so repeated rows give repeated results and an empty table an
empty one; other columns are not read. The automaton keeps a set of states
per word, so very long texts take memory in proportion to their length only.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._io import chunks

# The phrases and labels of the base result.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License wording in template markup. Texts of licenses, the notices that their authors
# ask for, and names by which works refer to them; holders' names and years are replaceable regions.
_WARRANTY = "<<opt>>the<</opt>> software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<var:8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_CONDITIONS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_WARRANTY = "this software is provided by <<var:12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"


def _gnu(name: str, version: str) -> str:
    """How works name a GNU license of a version, or ask for it with its usual notice."""
    return f"gnu {name} <<opt>>as published by the free software foundation either<</opt>> <<opt>>v<</opt>> <<opt>>version<</opt>> {version}"


def _later(name: str, version: str) -> str:
    return f"gnu {name} as published by the free software foundation either version {version} of the license or at your option any later version"


_CC_NAMES = {"by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
_GNU_NAMES = {"gpl": ("general public license", ("2", "3")), "lgpl": ("lesser general public license", ("2 1", "3")), "agpl": ("affero general public license", ("3",))}
_SPDX = {"mit": "mit", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "apache-2.0": "apache 2 0", "mpl-2.0": "mpl 2 0", "bsd-2-clause": "bsd 2 clause", "bsd-3-clause": "bsd 3 clause", "bsl-1.0": "bsl 1 0", "cc0-1.0": "cc0 1 0"}

TEMPLATES = {
    "mit": f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software {_WARRANTY}",
    "mit:name": "<<opt>>expat<</opt>> mit license",
    "isc": "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var:8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var:8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "isc:name": "isc license",
    "bsd-2-clause": f"{_BSD_CONDITIONS} {_BSD_WARRANTY}",
    "bsd-3-clause": f"{_BSD_CONDITIONS} <<opt>>3<</opt>> neither the name of <<var:16>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_WARRANTY}",
    "bsd-2-clause:name": "bsd 2 clause <<opt>>simplified<</opt>> license",
    "bsd-3-clause:name": "bsd 3 clause <<opt>>new or revised<</opt>> license",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "bsl-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "bsl-1.0:name": "boost software license <<opt>>version<</opt>> 1 0",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<opt>>http<</opt>> <<opt>>https<</opt>> www apache org licenses license 2 0 <<opt>>txt<</opt>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-2.0:name": "apache license <<opt>>v<</opt>> <<opt>>version<</opt>> 2 0",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<opt>>http<</opt>> <<opt>>https<</opt>> mozilla org mpl 2 0",
    "mpl-2.0:name": "mozilla public license <<opt>>v<</opt>> <<opt>>version<</opt>> 2 0",
    "cc0-1.0": "<<opt>>creative commons<</opt>> cc0 1 0 <<opt>>universal<</opt>>",
    "copyright-reserved": "copyright <<opt>>c<</opt>> <<var:8>> all rights reserved",
}
for _family, (_name, _versions) in _GNU_NAMES.items():
    for _v in _versions:
        _label = f"{_family}-{_v.replace(' ', '.')}" + ".0" * (" " not in _v)
        TEMPLATES |= {_label: _gnu(_name, f"{_v} <<opt>>0<</opt>>"), f"{_label}:v": _gnu(_name, f"v{_v}"), f"{_label}-or-later": _later(_name, _v), f"{_label}:spdx": f"spdx license identifier {_family} {_v if ' ' in _v else _v + ' 0'}"}
for _code, _words in _CC_NAMES.items():
    _label = f"cc-{_code.replace(' ', '-')}-4.0"
    TEMPLATES |= {_label: f"cc {_code} 4 0", f"{_label}:name": f"<<opt>>creative commons<</opt>> {_words} 4 0 <<opt>>international<</opt>>"}
TEMPLATES |= {f"{_label}:spdx": f"spdx license identifier {_words}" for _label, _words in _SPDX.items()}

#: What every byte becomes before a text is cut at spaces: word bytes stay (A-Z lower-cased), the rest is a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Automaton:
    """A template as states: words[s] leads from s to s + 1, jumps[s] lead on without a word, gaps[s] stay in s."""

    def __init__(self, template: str):
        self.words: list[bytes] = []
        self.jumps: list[set[int]] = [set()]
        opened: list[int] = []
        marks = re.split(r"(<<opt>>|<</opt>>|<<var:\d+>>)", template)
        for part in marks:
            if part == "<<opt>>":
                opened.append(len(self.words))
            elif part == "<</opt>>":
                self.jumps[opened.pop()].add(len(self.words))
            elif m := re.fullmatch(r"<<var:(\d+)>>", part):
                first, n = len(self.words), int(m[1])
                for _ in range(n):
                    self._add(b"")
                for s in range(first, first + n):
                    self.jumps[s].add(first + n)
            else:
                for w in part.encode().translate(TABLE).split():
                    self._add(w)
        if opened:
            raise ValueError(f"<<opt>> without an end: {template}")
        self.end = len(self.words)
        if self.end in self._reach({0}):
            raise ValueError(f"no mandatory wording: {template}")
        self.firsts = {self.words[s] for s in self._reach({0}) if s < self.end}
        self.anchor = max(self._mandatory(), key=len, default=b"")

    def _add(self, word: bytes) -> None:
        self.words.append(word)
        self.jumps.append(set())

    def _mandatory(self) -> list[bytes]:
        """Words that no jump leads around."""
        return [w for s, w in enumerate(self.words) if w and not any(a <= s < b for a in range(s + 1) for b in self.jumps[a])]

    def _reach(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.jumps[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return seen

    def accepts_from(self, words: list[bytes], at: int) -> int:
        """The end of the shortest run from `at` that the automaton accepts, or -1."""
        states = self._reach({0})
        while at < len(words) and states:
            w = words[at]
            states = self._reach({s + 1 for s in states if s < self.end and self.words[s] in (w, b"")})
            at += 1
            if self.end in states:
                return at
        return -1

    def found_in(self, words: list[bytes]) -> bool:
        anywhere = b"" in self.firsts
        return any((anywhere or w in self.firsts) and self.accepts_from(words, i) >= 0 for i, w in enumerate(words))


@lru_cache(maxsize=16)
def compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(name.partition(":")[0], Automaton(t)) for name, t in templates]


def places(joined: bytes, phrase: bytes, starts: list[int]) -> list[int]:
    """Numbers of the words at which the phrase starts; joined: the words, each with a space on both sides."""
    out, at, needle = [], -1, b" " + phrase + b" "
    while (at := joined.find(needle, at + 1)) >= 0:
        out.append(bisect_right(starts, at) - 1)
    return out


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    n_base counts all places of phrases; first_word and last_word are their
    smallest and largest start, null without one. labels adds the accepted
    templates' to the phrases'. score: 1 where a template is accepted, 0.5
    where there is only a phrase, else 0.
    """
    phrase_items = [(" ".join(p.split()).encode(), label) for p, label in phrases.items()]
    template_items = tuple(templates.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(template_items)
        for batch in chunks(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                words = (text or b"").translate(TABLE).split()
                joined = b" " + b" ".join(words) + b" " if words else b""
                found, starts = {}, []
                hits = [(p, label) for p, label in phrase_items if b" " + p + b" " in joined]
                likely = [(label, a) for label, a in automata if not a.anchor or b" " + a.anchor + b" " in joined]
                if hits:
                    total = 0
                    for w in words:
                        starts.append(total)
                        total += len(w) + 1
                    found = {p: (label, places(joined, p, starts)) for p, label in hits}
                at = [i for _, own in found.values() for i in own]
                base = {label for label, _ in found.values()}
                more = {label for label, a in likely if a.found_in(words)}
                rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if more else 0.5 if base else 0.0))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
