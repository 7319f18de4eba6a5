import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import bpe

PATH = bpe.default_path()
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.TrieBpe(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aAbeéß 中  \t\n\r\x1c\x85\xa0　'’s123½٣.,!?<|endoftext|>😀́\x00_-—"), max_size=40))
def test_same_ids_as_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids).decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)


def test_operator(make_docs, prose):
    rows = [(1, prose(1, 300)), (2, None), (3, ""), (4, "x<|endoftext|>y  z"), (None, "null"), (5, "ü" * 5000 + " " + "abc" * 3000), (6, "twice"), (6, "twice")]
    out = bpe.encode_and_decode(make_docs(rows)).collect()
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted([tuple(r) for r in out], key=str) == sorted(want, key=str)
    assert bpe.encode_and_decode(make_docs([])).collect() == []
    assert bpe.encode_and_decode(make_docs(rows), keep_ids=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}])
def test_other_vocabularies_are_refused(tmp_path, change):
    spec = json.loads(open(PATH, encoding="utf-8").read()) | change
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.TrieBpe(str(tmp_path / "v.json"))


def test_tokens_go_together_by_their_merges(monkeypatch):
    r, own = random.Random(3), bpe.TrieBpe(PATH)
    ids = sorted(own.bytes_of.keys() - own.added.values())
    pairs = [(r.choice(ids), r.choice(ids[:2000])) for _ in range(1500)] + [p for p in r.sample(sorted(own.merge), 500)]
    for pair in pairs:
        assert own.may_follow(*pair) == (own.merged(own.bytes_of[pair[0]] + own.bytes_of[pair[1]]) == [*pair])
    text = " ".join("".join(r.choice("abcdeéß中'1-") for _ in range(r.randrange(1, 40))) for _ in range(400))
    monkeypatch.setattr(bpe.TrieBpe, "merged", None)  # op8: no string is merged anew to judge a pair
    assert bpe.TrieBpe(PATH).encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_vocabularies_whose_merges_are_out_of_order(tmp_path):
    """A merge stands before the one that makes its part, and a token has two merges."""
    spec = json.loads(open(PATH, encoding="utf-8").read())
    kept = {s: i for i, s in enumerate([s for s in spec["model"]["vocab"] if len(s) == 1] + ["ab", "abc", "bc", "cab"])}
    spec["model"] |= {"vocab": kept, "merges": ["ab c", "b c", "a b", "c ab", "a bc"]}
    spec["added_tokens"] = []
    (tmp_path / "v.json").write_text(json.dumps(spec))
    library, own, r = Tokenizer.from_file(str(tmp_path / "v.json")), bpe.TrieBpe(str(tmp_path / "v.json")), random.Random(1)
    assert not own.ordered
    for _ in range(300):
        text = "".join(r.choice("abc ") for _ in range(12))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
