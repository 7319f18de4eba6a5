"""Training-order materialisation of token sequences in fixed-stride shards.

Every document becomes sequences of `length` token ids (its tokens and an end
token, cut up; the last one padded). Before any text is encoded, each document
reserves as many consecutive numbers, in input order, as sequences it can have
at most: a token covers a byte of its text at least. A sequence's number goes
through a keyed Feistel permutation of all reserved numbers - balanced halves,
walked on until the value lies among them - and comes out as its ticket; unused
numbers have none. Tickets are dealt to shards by range, sorted, and written by
Spark's text writer as records of equal size ("lines" of `stride` bytes). A
sequence's slot is its place in the order of tickets: slot s stands at byte
(s - first) * stride of the shard whose slots begin with `first`, so a reader
can resume anywhere. Every text is encoded once and every record shuffled once.

Numbering rests on a first read that adds up what each input partition reserves.
Both reads must see the same rows in the same partitions, as file scans do; sums
over each partition's ids and lengths are compared and a difference stops the
job (give such inputs as a stored table). The driver holds three numbers per
input partition and one per shard, less than Spark's scheduler does.

A null text counts as empty: one sequence with the end token alone. Null ids
are kept. Repeated rows are sequences of their own. An empty table gives no
shards and no rows. A very long text is cut into as many sequences as it fills;
a worker holds it and its ids at once. Columns other than id and text are not
read, whatever their names.

Where no token of a model goes on over a space behind other characters, a text's
ids are those of its words end to end, and the distinct words of a slice of
texts are encoded once. The texts of other models are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._io import chunks

#: Tickets of a shard: so many, and up to so many where there are thousands of shards.
PER_SHARD, MOST_PER_SHARD = 1 << 17, 1 << 20
#: Token ids of a sequence.
LENGTH = 256
NO_ID = -(1 << 63)
#: Bytes of texts whose words are encoded together, words that the library is given in one call, and places of words filled at a time.
TOGETHER, CALL_WORDS, STRETCH = 8 << 20, 20_000, 1 << 16
SPACE = "\u2581"
HEAD = np.dtype([("doc", "<i8"), ("part", "<i4"), ("n", "<i4")])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


# -- the permutation ------------------------------------------------------------------------------


def _round(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) & mask


def _keys(key: str, rounds: int = 6) -> list[int]:
    return [xxhash.xxh64_intdigest(f"{key}/{i}") for i in range(rounds)]


def _once(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    b, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> b, x & mask
    for k in reversed(keys) if back else keys:
        left, right = (right ^ _round(left, k, mask), left) if back else (right, left ^ _round(right, k, mask))
    return (left << b) | right


def permuted(numbers: np.ndarray, n: int, key: str, back: bool = False) -> np.ndarray:
    """The slots of sequence numbers below n (back: the numbers of slots): a bijection of 0..n-1 chosen by key."""
    bits = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    keys, x = _keys(key), numbers.astype(np.uint64)
    x = _once(x, bits, keys, back)
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = _once(x[out], bits, keys, back)
    return x.astype(np.int64)


# -- writing --------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _cut_at_spaces(path: str) -> bool:
    """Whether a text's encoding is that of its words end to end: texts are taken as they are, and merges never go on over a space behind another character."""
    try:
        from sentencepiece import sentencepiece_model_pb2 as pb
    except ImportError:
        return False
    spec = pb.ModelProto.FromString(_model(path).serialized_model_proto())
    how, rule, piece = spec.trainer_spec, spec.normalizer_spec, pb.ModelProto.SentencePiece
    if how.model_type != pb.TrainerSpec.BPE or how.treat_whitespace_as_suffix or not how.byte_fallback:
        return False
    if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix or not rule.escape_whitespaces:
        return False
    return not any(x.type in (piece.USER_DEFINED, piece.UNUSED) or SPACE in x.piece.lstrip(SPACE) for x in spec.pieces)


def _split(text: str) -> list[str]:
    """The words with the spaces before them but one, which the library puts there itself; an empty last one is a lone space."""
    return [w[1:] for w in re.findall(r" *[^ ]+| +\Z", " " + text.replace(SPACE, " "))] if text else []


def _encoded(words: pa.Array, model) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words end to end, and how many each has."""
    flat, sizes = array("H"), array("l")
    for lo in range(0, len(words), CALL_WORDS):
        part = words.slice(lo, CALL_WORDS).to_pylist()
        ids = model.encode(part, num_threads=1)
        if "" in part:
            ids[part.index("")] = model.encode("a ")[len(model.encode("a")) :]
        sizes.extend(map(len, ids))
        flat.extend(chain.from_iterable(ids))
    return np.frombuffer(flat.tobytes(), np.uint16), np.array(sizes, np.int64)


def _by_words(texts: pa.Array, model) -> list[np.ndarray]:
    """The ids of every text, from those of the distinct words."""
    pc = pa.compute
    odd = pc.equal(pc.binary_length(texts), 0)
    for has in (pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)):
        odd = pc.or_(odd, has)
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    other = [_split(t) for t in texts.filter(odd).to_pylist()]
    every = plain.flatten()
    if other:
        every = pa.concat_arrays([every, pa.array(chain.from_iterable(other), texts.type)])
    every = every.dictionary_encode()
    flat, sizes = _encoded(every.dictionary, model)
    starts, word = np.cumsum(sizes) - sizes, every.indices.to_numpy()
    # The words of plain texts stand before those of the others.
    bounds = np.cumsum(np.concatenate([pc.list_value_length(plain).to_numpy().astype(np.int64), np.array([len(w) for w in other], np.int64)]))
    ids, stops, done = [np.zeros(0, np.uint16)], np.zeros(len(bounds), np.int64), 0
    for lo in range(0, len(word), STRETCH):
        part = word[lo : lo + STRETCH]
        own = sizes[part]
        ends = np.cumsum(own)
        ids.append(flat[np.repeat(starts[part] - (ends - own), own) + np.arange(ends[-1])])
        here = slice(*np.searchsorted(bounds, (lo, lo + STRETCH), side="right"))
        stops[here] = done + ends[bounds[here] - lo - 1]
        done += int(ends[-1])
    ids = np.concatenate(ids)
    out: list = [None] * len(texts)
    for at, lo, hi in zip(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable").tolist(), [0, *stops[:-1].tolist()], stops.tolist(), strict=False):
        out[at] = ids[lo:hi]
    return out


def _tokens(batch: pa.RecordBatch, path: str) -> list[np.ndarray]:
    """The ids of every text and the end token."""
    model, texts = _model(path), batch.column("text").fill_null("")
    end = np.array([model.eos_id()], np.uint16)
    every = _by_words(texts, model) if _cut_at_spaces(path) else [np.array(ids, np.uint16) for ids in model.encode(texts.to_pylist(), num_threads=1)]
    return [np.concatenate([ids, end]) for ids in every]


def reserved(n_bytes, length: int):
    """Sequences that a text of so many UTF-8 bytes can have at most: its bytes, the model's space before it and the end token."""
    return (n_bytes + 2 + length - 1) // length


def write(docs: DataFrame, path: str, key: str = "plumbline", length: int = LENGTH, per_shard: int | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Writes the shards of docs below path and a manifest beside them; returns the manifest. per_shard: tickets of a shard."""
    tokenizer = tokenizer or default_path()
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("id", F.octet_length("text")))
    octets = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    taken = source.withColumn("octets", octets).groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.expr(f"(octets + {length + 1}) div {length}")).alias("n"), F.bit_xor("row").alias("rows"))
    starts, total = {}, 0
    for part, n, rows in sorted(taken.collect()):
        starts[part] = total, n, rows
        total += n
    per_shard = per_shard or max(PER_SHARD, min(MOST_PER_SHARD, total // 4096))
    stride = HEAD.itemsize + 2 * length + 1
    held = spark.sparkContext.broadcast(starts)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, expected = held.value.get(TaskContext.get().partitionId(), (0, 0, 0))
        end, seen = at + n, 0
        for batch in chunks(batches, "text", TOGETHER):
            tokens, ids = _tokens(batch, tokenizer), batch.column("id").to_pylist()
            sizes = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            seen ^= int(np.bitwise_xor.reduce(batch.column("row").to_numpy()))
            room = reserved(sizes, length)
            own = np.array([-(-len(t) // length) for t in tokens])
            if (own > room).any():
                raise ValueError(f"{tokenizer} gives more tokens than a text has bytes")
            first = at + np.cumsum(room) - room
            at += int(room.sum())
            rows = np.zeros(int(own.sum()), np.dtype([("head", HEAD), ("ids", "<u2", length)]))
            begin = np.cumsum(own) - own
            for doc, t, i, m in zip(ids, tokens, begin.tolist(), own.tolist(), strict=True):
                flat = np.zeros(m * length, np.uint16)
                flat[: len(t)] = t
                rows["ids"][i : i + m] = flat.reshape(m, length)
                rows["head"]["doc"][i : i + m] = NO_ID if doc is None else doc
            part = np.arange(len(rows)) - np.repeat(begin, own)
            rows["head"]["part"] = part
            rows["head"]["n"] = np.minimum(length, np.repeat([len(t) for t in tokens], own) - length * part)
            tickets = permuted(np.repeat(first, own) + part, total, key)
            flat = pa.Array.from_buffers(pa.binary(rows.itemsize), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(tickets), flat], ["ticket", "record"])
        if (at, seen) != (end, expected):
            raise ValueError("the input's rows or partitions differ between two reads; store it first")

    counts: dict[int, int] = {}
    if total:
        records = source.mapInArrow(number, "ticket long, record binary")
        dealt = records.repartitionById(-(-total // per_shard), F.expr(f"cast(ticket div {per_shard} as int)")).sortWithinPartitions("ticket")
        dealt.select(F.col("record").cast("string").alias("record")).write.option("lineSep", "\n").text(f"{path}/data")
        counts = {shard_of(r["path"]): r["length"] // stride for r in _files(spark, [f"{path}/data"]).select("path", "length").collect()}
    shards = sorted(k for k, n in counts.items() if n)
    firsts = np.cumsum([0, *(counts[k] for k in shards)]).tolist()
    manifest = {"sequences": firsts[-1], "reserved": total, "length": length, "per_shard": per_shard, "stride": stride, "key": key, "dtype": "uint16", "shards": shards, "firsts": firsts[:-1]}
    spark.createDataFrame([(json.dumps(manifest),)], "m string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


# -- reading --------------------------------------------------------------------------------------


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(paths)


def shard_of(path: str) -> int:
    """Spark names a task's file by its number."""
    return int(re.search(r"/part-(\d+)-[^/]*$", path)[1])


def manifest_of(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def read(spark: SparkSession, path: str, first: int = 0, last: int | None = None, ids: bool = True) -> DataFrame:
    """(slot, doc_id, part, n_tokens, ids_sha256 and, if asked for, ids) of the slots first..last-1; only their shards are opened (in order, slots are the training order).

    ids_sha256: of the ids as little-endian 16-bit numbers.
    """
    m = manifest_of(spark, path)
    last = m["sequences"] if last is None else min(last, m["sequences"])
    schema = "slot long, doc_id long, part int, n_tokens int, ids_sha256 string, ids array<int>"
    if first >= last:
        return spark.createDataFrame([], schema if ids else schema.rpartition(",")[0])
    length, stride = m["length"], m["stride"]
    firsts = dict(zip(m["shards"], m["firsts"], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("head", HEAD), ("ids", "<u2", length), ("end", "S1")])
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = content.as_buffer()
                if len(data) % stride:
                    raise ValueError(f"{name} is not made of whole records")
                begin = firsts.get(shard_of(name.as_py()), 0)
                every = np.frombuffer(data, kind)
                for lo in range(max(0, first - begin), min(len(every), last - begin), 8192):
                    rows = every[lo : min(lo + 8192, last - begin)]
                    n = rows["head"]["n"]
                    flat = [r[:k] for r, k in zip(rows["ids"], n.tolist(), strict=True)]
                    hashes = [hashlib.sha256(x).hexdigest() for x in map(np.ndarray.tobytes, flat)]
                    doc = rows["head"]["doc"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(begin + lo, begin + lo + len(rows))), pa.array(doc, mask=doc == NO_ID), pa.array(rows["head"]["part"].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(hashes), pa.array([x.astype(np.int32) for x in flat] if ids else [None] * len(rows), pa.list_(pa.int32()))],
                        ["slot", "doc_id", "part", "n_tokens", "ids_sha256", "ids"],
                    )

    whole = first == 0 and last == m["sequences"]
    lo, hi = (bisect_right(m["firsts"], x) for x in (first, last - 1))
    paths = [f"{path}/data"] if whole else [f"{path}/data/part-{k:05d}-*" for k in m["shards"][lo - 1 : hi]]
    files = _files(spark, paths)
    out = files.select("path", "content").mapInArrow(run, schema)
    return out if ids else out.drop("ids")
