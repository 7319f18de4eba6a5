import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import shards
from plumbline.llm._io import shared_dir, stored


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_permutation(n):
    slots = shards.permuted(np.arange(n), n, "key")
    assert sorted(slots) == list(range(n))
    assert (shards.permuted(slots, n, "key", back=True) == np.arange(n)).all()
    if n > 99:
        assert (slots != shards.permuted(np.arange(n), n, "other")).any()


def plain_ticket(x, n, key):
    """One number's way through the permutation, in whole numbers."""
    word = (1 << 64) - 1
    bits = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    while True:
        left, right = x >> bits, x & (1 << bits) - 1
        for k in (xxhash.xxh64_intdigest(f"{key}/{i}") for i in range(6)):
            h = (right + k) * 0x9E3779B97F4A7C15 & word
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & word
            left, right = right, left ^ (h ^ h >> 29) & (1 << bits) - 1
        x = left << bits | right
        if x < n:
            return x


def expected(rows, length, key):
    """(id, part, ids) of all sequences of rows in training order, from the definition; one input partition."""
    model, at, out = shards._model(shards.default_path()), 0, []
    room = [(len((t or "").encode()) + 2 + length - 1) // length for _, t in rows]
    for (i, t), r in zip(rows, room, strict=True):
        ids = [*model.encode(t or ""), model.eos_id()]
        out += [(plain_ticket(at + p, sum(room), key), i, p, ids[p * length : (p + 1) * length]) for p in range(-(-len(ids) // length))]
        at += r
    return [x[1:] for x in sorted(out, key=lambda x: x[0])]


def test_order_and_round_trip(spark, make_docs, prose):
    rows = [(1, prose(1, 500)), (2, None), (3, ""), (None, "null id"), (4, prose(2, 9000)), (5, "same\nline"), (5, "same\nline"), (6, "\u6f22\u5b57 \u2581 \x00 \U0001f600" * 9), (7, " ")]
    path = shared_dir(spark, "shards")
    docs = make_docs(rows).withColumns({"ticket": F.lit(1), "row": F.lit("x"), "octets": F.lit(None)})
    m = shards.write(docs.coalesce(1), path, key="k", length=64, per_shard=90)
    every = shards.read(spark, path).orderBy("slot").collect()
    assert [r["slot"] for r in every] == list(range(m["sequences"])) and len(m["shards"]) > 5
    assert [(r["doc_id"], r["part"], r["ids"]) for r in every] == expected(rows, 64, "k")
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], np.uint16).tobytes()).hexdigest() for r in every)
    for first, last in ((30, 120), (0, 1), (m["sequences"] - 1, m["sequences"] + 9), (50, 50)):
        some = shards.read(spark, path, first, last).orderBy("slot").collect()
        assert [tuple(r) for r in some] == [tuple(r) for r in every[first:last]]


def test_partitions(spark, make_docs, prose):
    """Numbers go on from one input partition to the next."""
    rows = [(i, prose(i, 40 * i)) for i in range(40)]
    path = shared_dir(spark, "shards")
    docs = stored(make_docs(rows).repartition(5, "doc_id"), "docs")
    m = shards.write(docs, path, length=32, per_shard=64)
    every = shards.read(spark, path).collect()
    model = shards._model(shards.default_path())
    assert sorted(r["slot"] for r in every) == list(range(m["sequences"]))
    got = {}
    for r in sorted(every, key=lambda r: (r["doc_id"], r["part"])):
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == {i: [*model.encode(t), model.eos_id()] for i, t in rows}


def test_empty_table(spark, make_docs):
    path = shared_dir(spark, "shards")
    assert shards.write(make_docs([]), path)["sequences"] == 0
    assert shards.read(spark, path, ids=False).collect() == []


ODD = [" ", "  ", "   ", " " * 40, "\u2581", "\u2581\u2581", "\n", "\t", "\x00", "a", "the", "\xe9", "\u0301", "\u6f22", "\U0001f600", "\u3000", "\xa0", "</s>", "<0x41>", "12", ".", "\ufb01", "\u200b", "ing"]


@pytest.mark.parametrize("stretch,call", [(1 << 16, 20_000), (3, 5)])
def test_words_give_the_whole(monkeypatch, stretch, call):
    monkeypatch.setattr(shards, "STRETCH", stretch)
    monkeypatch.setattr(shards, "CALL_WORDS", call)
    r, path = random.Random(stretch), shards.default_path()
    model = shards._model(path)
    assert shards._cut_at_spaces(path)
    for n in (0, 1, 2, 700):
        texts = [None, *("".join(r.choice(ODD) + " " * (r.random() < 0.2) for _ in range(r.randrange(9))) for _ in range(n)), ""][: n + 1]
        batch = pa.RecordBatch.from_arrays([pa.array(texts, r.choice([pa.string(), pa.large_string()]))], ["text"]).slice(n % 2)
        assert [t.tolist() for t in shards._tokens(batch, path)] == [[*model.encode(t or ""), model.eos_id()] for t in texts[n % 2 :]]


def test_words_are_encoded_once(monkeypatch, prose):
    path, given = shards.default_path(), []
    model = shards._model(path)
    assert shards._cut_at_spaces(path)
    texts = [prose(n, 300) for n in range(50)]
    counting = SimpleNamespace(eos_id=model.eos_id, encode=lambda x, **k: given.extend(x) or model.encode(x, **k))
    monkeypatch.setattr(shards, "_model", lambda _: counting)
    got = shards._tokens(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), path)
    assert [t.tolist() for t in got] == [[*model.encode(t), model.eos_id()] for t in texts]
    assert sum(map(len, given)) < sum(map(len, texts)) / 10


@pytest.mark.parametrize("change", ["spaces", "prefix", "piece", "kind"])
def test_other_models_are_given_whole_texts(tmp_path, change):
    """Where a text's ids are not those of its words, the library gets the text."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto.FromString(shards._model(shards.default_path()).serialized_model_proto())
    if change == "spaces":
        spec.normalizer_spec.remove_extra_whitespaces = True
    elif change == "prefix":
        spec.normalizer_spec.add_dummy_prefix = False
    elif change == "piece":
        spec.pieces[-1].piece = "n\u2581t"
    else:
        spec.pieces[-1].type = pb.ModelProto.SentencePiece.USER_DEFINED
    path = str(tmp_path / "other.model")
    (tmp_path / "other.model").write_bytes(spec.SerializeToString())
    model, texts = shards._model(path), ["in the  end", " in to\u2581n t ", "", None]
    assert not shards._cut_at_spaces(path)
    got = shards._tokens(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), path)
    assert [t.tolist() for t in got] == [[*model.encode(t or ""), model.eos_id()] for t in texts]
