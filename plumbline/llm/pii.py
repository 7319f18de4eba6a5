"""Personal data by offset-preserving deobfuscation.

Base patterns run over the text as it stands. Then transducers rewrite stretches
that may hide an identifier - look-alike letters and digits, digits spelled out,
"at" and "dot" in place of the signs - and keep, for every character they write,
the source characters it came from. The same patterns run over the rewritten
text, and each match is mapped back to the source span it came from. A span that
overlaps one of its kind found before adds nothing.

A disguise is judged by what it holds and by its own sentence, never by other
parts of the text: an "at" or "dot" in brackets, an @ between spaces and a dot
spelled out speak for themselves; a bare "at" before a domain with plain dots is
common in prose ("find us at example.com") and counts only where its sentence
speaks of writing to somebody before. A domain ends in letters. Eight to fifteen
digits in a row of which six at least are spelled out are a phone number, with
or without a plus, unless they are a card's.

Null texts count as empty: no spans. Rows are independent, so repeated rows give
repeated results and an empty table an empty one; other columns are not read,
whatever their names. Of spans that overlap the one that starts first stays, of
those that start together the longer one. Offsets count code points, ends
exclusive. Very long texts take memory in proportion to their length and to the
number of their rewritten stretches.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._io import chunks

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base result.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: IP finds the same without starts inside a run of digits, which only cost time.
_IP_RUN = re.compile(r"(?<![0-9])" + IP.pattern)

# Digits by their English names.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

# Characters of other scripts and what they look like.
LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEKMHOPCTXaeopcyxijsABEZHIKMNOPTYXovp", strict=True)) | {"․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\xa0": " ", " ": " "}
# The full-width forms of the printable ASCII characters stand 0xFEE0 further on.
LOOKALIKES |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}

_DIGIT = "|".join(SPELLED)
_ODD = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + "]")
_SPELLED_RUN = re.compile(rf"(?<![A-Za-z0-9])(?:plus[\x20-])?(?:{_DIGIT}|[0-9]{{1,4}})(?:[\x20,.-]{{1,2}}(?:{_DIGIT}|[0-9]{{1,4}})){{5,}}(?![A-Za-z0-9])", re.I)
_SPELLED_ONE = re.compile(rf"{_DIGIT}", re.I)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT = rf"(?:\s?{_OPEN}\s?(?:at|@)\s?{_CLOSE}\s?|\s(?:at|@)\s|@)"
_DOT = rf"(?:\s?{_OPEN}\s?(?:dot|\.)\s?{_CLOSE}\s?|\sdot\s|\.)"
_DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+){{0,4}}?{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+(?![A-Za-z0-9-])", re.I)
_DOTTED = re.compile(rf"(?<![A-Za-z0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![A-Za-z0-9])", re.I)
_AT_ONE, _DOT_ONE = re.compile(_AT, re.I), re.compile(_DOT, re.I)
#: What each step needs somewhere: a disguised dot; a disguised at before a domain; a plain dot at a spelled digit.
_DOT_HINT = re.compile(rf"\sdot\s|{_OPEN}\s?(?:dot|\.)\s?{_CLOSE}", re.I)
_AT_HINT = re.compile(rf"(?:{_OPEN}\s?(?:at|@)\s?{_CLOSE}\s?|\s(?:at|@)\s)[A-Za-z0-9-]+{_DOT}[A-Za-z0-9-]", re.I)
_SPELLED_DOT = re.compile(rf"\.(?:(?:{_DIGIT})|(?=[0-9])(?:{'|'.join(rf'(?<={d}[.])' for d in SPELLED)}))", re.I)
#: Four numbers up to three spelled or plain digits each, with dots or "dot" between.
_NUMBER = rf"(?:[0-9]{{1,3}}|(?:{_DIGIT}|[0-9])(?:[\x20-](?:{_DIGIT}|[0-9])){{0,2}})"
_SPELLED_IP = re.compile(rf"(?<![A-Za-z0-9.]){_NUMBER}(?:{_DOT}{_NUMBER}){{3}}(?![A-Za-z0-9])", re.I)
_SPELLED_IP_ONE = re.compile(rf"(?P<dot>{_DOT})|{_DIGIT}|[0-9]+|[\x20-]", re.I)
_HINT_DIGITS = re.compile(rf"(?:{_DIGIT})[\x20,.-]{{1,2}}(?:{_DIGIT}|[0-9])(?![A-Za-z])", re.I)


#: What speaks of writing to somebody, within a sentence before a bare "at"; and who is written to without having an address.
_CUE = re.compile(r"\b(?:e-?mail(?:s|ed|ing)?|mail|write|contact|reach|address|message|ping|send)\b", re.I)
_NO_NAMES = frozenset("a all an and are arrive back be but call find for he her here him i in is it look me meet not of on or out see she start that the them there they this to up us visit was we were you".split())
_SENTENCE = re.compile(r"[.!?]\s|\n")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """EMAIL's matches, from each @ to both sides: linear in the text, however long its runs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the patterns alone: leftmost, not overlapping within a kind; failing matches are dropped."""
    out = []
    if "@" in text:
        out += _emails(text)
    out += [("ip", *m.span()) for m in _IP_RUN.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if len(m[0]) >= 16 and 16 <= len(d := _only_digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return out


class Rewrite:
    """Text with the source span of each of its stretches.

    Stretches are kept as runs: where one begins in the text, where it begins and
    ends in the source, and whether it was copied character by character or
    stands as a whole for what it replaces.
    """

    def __init__(self, text: str):
        self.text = text
        self.starts, self.runs = [0], [(0, len(text), True)]
        self.extra: list[tuple[str, int, int]] = []

    @property
    def changed(self) -> bool:
        return len(self.runs) > 1 or not self.runs[0][2]

    def span(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        lo, _, copied = self.runs[i]
        _, hi, end_copied = self.runs[j]
        return lo + (start - self.starts[i]) * copied, self.runs[j][0] + end - self.starts[j] if end_copied else hi

    def put(self, changes: list[tuple[int, int, str]]) -> None:
        """changes: (start, end, new), in order; every new character comes from the whole span it replaces."""
        if not changes:
            return
        text, starts, runs, at = [], [], [], 0

        def add(length: int, run: tuple[int, int, bool]) -> None:
            nonlocal at
            if length:
                starts.append(at)
                runs.append(run)
                at += length

        def copy(lo: int, hi: int) -> None:
            i = bisect_right(self.starts, lo) - 1
            while lo < hi:
                end = min(hi, self.starts[i + 1] if i + 1 < len(self.starts) else hi)
                first, last, copied = self.runs[i]
                begin = first + lo - self.starts[i]
                add(end - lo, (begin, begin + end - lo, True) if copied else (first, last, False))
                lo, i = end, i + 1

        done = 0
        for start, end, new in changes:
            text += [self.text[done:start], new]
            copy(done, start)
            add(len(new), (*self.span(start, end), False))
            done = end
        copy(done, len(self.text))
        self.text = "".join([*text, self.text[done:]])
        self.starts, self.runs = starts or [0], runs or [(0, 0, False)]


def _homoglyphs(r: Rewrite) -> None:
    r.put([(m.start(), m.end(), LOOKALIKES[m[0]]) for m in _ODD.finditer(r.text)])


def _spelled_digits(r: Rewrite) -> None:
    changes = []
    for run in _SPELLED_RUN.finditer(r.text):
        n_spelled = sum(1 for _ in _SPELLED_ONE.finditer(run[0]))
        if not n_spelled:
            continue
        n = n_spelled + len(_only_digits(run[0]))
        if n_spelled >= 6 and 8 <= n <= 15:
            r.extra.append(("phone", *r.span(*run.span())))
        done = None
        for m in re.finditer(rf"plus|{_DIGIT}|[0-9]+|[^A-Za-z0-9]+", run[0], re.I):
            start, end = m.start() + run.start(), m.end() + run.start()
            if not m[0][0].isalnum():
                if done is not None and "." not in m[0]:
                    changes.append((start, end, ""))
                continue
            changes.append((start, end, "+" if m[0].lower() == "plus" else SPELLED.get(m[0].lower(), m[0])))
            done = end
    r.put(changes)


def _spelled_ips(r: Rewrite) -> None:
    changes = []
    for run in _SPELLED_IP.finditer(r.text):
        if not _SPELLED_ONE.search(run[0]):
            continue
        for m in _SPELLED_IP_ONE.finditer(run[0]):
            new = "." if m["dot"] else SPELLED.get(m[0].lower(), m[0] if m[0].isdigit() else "")
            changes.append((run.start() + m.start(), run.start() + m.end(), new))
    r.put(changes)


def _disguises(r: Rewrite) -> None:
    changes = []
    for run in _DISGUISED.finditer(r.text):
        at = _AT_ONE.search(run[0])
        if not re.search(r"(?:^|[^A-Za-z0-9-])[A-Za-z]{2,}$", run[0]):
            continue
        if at[0].strip().lower() == "at" and not _DOT_HINT.search(run[0]):
            before = r.text[max(0, run.start() - 80) : run.start()]
            sentence = before[max((m.end() for m in _SENTENCE.finditer(before)), default=0) :]
            if run[0][: at.start()].lower() in _NO_NAMES or not _CUE.search(sentence):
                continue
        signs = [(at.start(), at.end(), "@")] + [(m.start(), m.end(), ".") for part in ((0, at.start()), (at.end(), len(run[0]))) for m in _DOT_ONE.finditer(run[0], *part)]
        changes += [(run.start() + a, run.start() + b, new) for a, b, new in sorted(signs)]
    r.put(changes)
    r.put([(run.start() + m.start(), run.start() + m.end(), ".") for run in _DOTTED.finditer(r.text) for m in _DOT_ONE.finditer(run[0])])


def hidden_spans(text: str) -> list[tuple[str, int, int]]:
    """What the patterns find in the rewritten text, as spans of the source. Empty where no transducer applies."""
    r = Rewrite(text)
    if not text.isascii() and _ODD.search(text):
        _homoglyphs(r)
    if _DOT_HINT.search(r.text) or _SPELLED_DOT.search(r.text):
        _spelled_ips(r)
    if _HINT_DIGITS.search(r.text):
        _spelled_digits(r)
    if _DOT_HINT.search(r.text) or _AT_HINT.search(r.text):
        _disguises(r)
    return [*((kind, *r.span(start, end)) for kind, start, end in base_spans(r.text)), *r.extra] if r.changed else []


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans), each by kind as listed, then start."""
    order = lambda s: (KINDS.index(s[0]), s[1:])
    base = sorted(base_spans(text), key=order)
    new = hidden_spans(text)
    taken = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS} if new else {}
    added = []
    for kind, a, b in sorted(set(new), key=lambda s: (s[0] == "phone", s[1], -s[2])):
        # A spelled run is a phone number only where no card stands.
        others = taken[kind] + (taken["card"] if kind == "phone" else [])
        if not any(x < b and a < y for x, y in others):
            added.append((kind, a, b))
            taken[kind].append((a, b))
    return base, sorted(base + added, key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a mark like [EMAIL] for each span; of overlapping spans the first decides."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: (id, n_email, n_ip, n_card, n_phone of the base spans, base_sha256, spans: all of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text or "")
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by its kind's mark; null texts stay null, columns and rows stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            texts = [None if t is None else redacted(t, all_spans(t)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
