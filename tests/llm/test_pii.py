import hashlib
import random
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import pii


def plain(t):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [("email", *m.span()) for m in pii.EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in pii.IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in pii.CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in pii.PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("a1 @..-+()0é9%12345"), max_size=40))
def test_base_patterns(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("write to bob at example dot com today", "email", "bob at example dot com"),
        ("x [at] y [dot] org", "email", "x [at] y [dot] org"),
        ("see раypal@ехample.com.", "email", "раypal@ехample.com"),
        ("ＡＢ＠ｅｘ．ｃｏｍ", "email", "ＡＢ＠ｅｘ．ｃｏｍ"),
        ("call plus one five five five zero one zero nine nine nine nine now", "phone", "plus one five five five zero one zero nine nine nine nine"),
        ("host 192 dot 168 [dot] 1 dot 20 up", "ip", "192 dot 168 [dot] 1 dot 20"),
        ("card four five three nine one four eight eight zero three four three six four six seven ok", "card", "four five three nine one four eight eight zero three four three six four six seven"),
    ],
)
def test_disguises(text, kind, hidden):
    base, every = pii.all_spans(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in every] == [(kind, hidden)]


def test_plain_text_stays():
    for text in ("look at the house", "five, six of them", "Élan vital à la fin", "the dot at noon", "Find us at example.com. the dot at noon", "Arrive at 10.30 on the dot please", "The shop at example.com opens. Write soon.", "Write to us at example.com", "one two three four five six seven", "five dot six"):
        assert pii.all_spans(text) == ([], [])


def test_operator(make_docs):
    mail = "é a.b@c.de 1.2.3.4 256.1.1.1, 4111 1111 1111 1111, +1 (555) 010-9999"
    rows = [(1, mail), (2, None), (3, ""), (None, mail), (4, "a" * 200_000 + "@"), (5, mail), (5, mail)]
    out = pii.find(make_docs(rows)).collect()
    spans = pii.joined(sorted(plain(mail), key=lambda s: (pii.KINDS.index(s[0]), s[1])))
    for r in out:
        if r["doc_id"] in (1, 5, None):
            assert tuple(r)[1:5] == (1, 1, 1, 1) and r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest() and r["spans"] == spans
        else:
            assert tuple(r)[1:5] == (0, 0, 0, 0) and r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == ""
    assert len(out) == len(rows) and pii.find(make_docs([])).collect() == []
    docs = make_docs(rows)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.filter("doc_id = 1").first()["text"] == "é [EMAIL] [IP] 256.1.1.1, [CARD], [PHONE]"


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("mail jane at example.com now", "email", "jane at example.com"),
        ("jane @ example.com", "email", "jane @ example.com"),
        ("host one nine two dot one six eight dot one dot two zero up", "ip", "one nine two dot one six eight dot one dot two zero"),
        ("host 10.one.0.seven up", "ip", "10.one.0.seven"),
    ],
)
def test_disguises_by_their_own_surroundings(text, kind, hidden):
    for whole in (text, f"{text}, a dot b"):
        base, every = pii.all_spans(whole)
        assert base == [] and [(k, whole[a:b]) for k, a, b in every] == [(kind, hidden)]
    for text in ("bob at example.com", "we sell it at example.com today"):
        assert pii.all_spans(text) == ([], []) and pii.all_spans(f"a [dot] b. {text}") == ([], [])


def test_spelled_phone_without_plus():
    text = "ring five five five zero one two three four five six today"
    assert pii.all_spans(text) == ([], [("phone", 5, len(text) - 6)])


@given(st.lists(st.tuples(st.sampled_from(["a", "bc", "def", "А", "zero", " "]), st.sampled_from(["", "x", "yz", None])), max_size=12))
def test_rewrite_keeps_spans(parts):
    """Two rewritings in a row, against a list with the source of every character."""
    text, each = "".join(p for p, _ in parts), []
    r = pii.Rewrite(text)
    changes, at, new_text = [], 0, ""
    for p, new in parts:
        if new is not None:
            changes.append((at, at + len(p), new))
        new_text += p if new is None else new
        each += [(i, i + 1) for i in range(at, at + len(p))] if new is None else [(at, at + len(p))] * len(new)
        at += len(p)
    r.put(changes)
    assert r.text == new_text
    again = [(m.start(), m.end(), "Q") for m in __import__("re").finditer("x.?", r.text)]
    for a, b, _ in reversed(again):
        each[a:b] = [(each[a][0], each[b - 1][1])]
    r.put(again)
    assert [r.span(i, i + 1) for i in range(len(r.text))] == each
    assert all(r.span(i, j) == (each[i][0], each[j - 1][1]) for i in range(len(each)) for j in range(i + 1, len(each) + 1))


def test_precision_and_recall_of_disguises():
    """Disguised identifiers planted in prose, and prose that looks like them."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioubdfgklmnprst") for _ in range(r.randint(3, 8)))
    spelled = list("zero one two three four five six seven eight nine".split())

    def planted():
        kind = r.randrange(7)
        name, host = word(), word()
        if kind == 0:
            return "email", f"{name} {r.choice(['[at]', '(at)', 'at', '@', '< at >'])} {host} {r.choice(['[dot]', 'dot', '(dot)'])} {r.choice(['com', 'org', 'de'])}"
        if kind == 1:
            return "email", f"{name}{r.choice(['[at]', ' (at) ', ' @ '])}{host}.{r.choice(['com', 'io'])}"
        if kind == 2:
            return "email", f"{name}@{host}.com".translate(str.maketrans("aeo@", "аео＠"))
        if kind == 3:
            return "ip", " dot ".join(str(r.randrange(256)) for _ in range(4))
        if kind == 4:
            return "phone", "plus " + " ".join(r.choice(spelled) for _ in range(r.randint(9, 14)))
        if kind == 5:
            digits = [r.randrange(10) for _ in range(15)]
            last = next(d for d in range(10) if pii.luhn("".join(map(str, [*digits, d]))))
            return "card", " ".join(spelled[d] for d in [*digits, last])
        return "phone", " ".join(r.choice(spelled) for _ in range(r.randint(8, 12)))

    decoys = ["look at the house", "meet at 10.30", "it is sold at shop.com", "the dot at noon", "one two three", "at one point two of them", "a dot com boom", "see it @ noon", "version 1 dot 2", "five of seven at nine"]
    found = right = total = 0
    for _ in range(400):
        text, want = word(), []
        for _ in range(3):
            text += f" {word()} {r.choice(decoys)}, {word()}; "
            kind, hidden = planted()
            want.append((kind, len(text), len(text) + len(hidden)))
            text += f"{hidden}; {word()}."
        every = pii.all_spans(text)[1]
        found += len(every)
        right += len(set(every) & set(want))
        total += len(want)
    assert right >= 0.98 * total and right >= 0.98 * found, (right, found, total)


def test_very_long_text():
    """20 MB with disguises all over: memory stays near the text's own size."""
    text = ("prose without anything to hide, at all. " * 50 + "jane [at] example dot com; ") * 10_000
    tracemalloc.start()
    every = pii.all_spans(text)[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(every) == 10_000 and all(text[a:b] == "jane [at] example dot com" for _, a, b in every) and peak < 6 * len(text), peak
