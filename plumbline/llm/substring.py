"""Substring dedup by De Bruijn compaction.

Every window of `window` consecutive words is an edge of a De Bruijn graph. A
document's edges that share their minimizer (the smallest hashed k-mer within
the window) follow each other without a branch, so each document's path is cut
into such runs where it is read, and only runs are shuffled:

1. Runs meet by minimizer. One that occurs in a single document holds no window
   of another and leaves here (most of the corpus).
2. Runs with equal words join their first occurrence (smallest id). All later
   occurrences are removed whole. Neighbouring ones whose source coordinates are
   neighbours too compact to one long span.
3. First occurrences whose minimizer has several different runs branch: they
   are opened into single edges, which meet by a 128-bit hash.
4. The source coordinates of each long span are read again and a digest of the
   words there must equal that of the words to be removed.

The runs are the nonbranching paths of the dealt graph: its nodes are stretches
of window - 1 words, and an edge's two nodes lie in one run exactly if no other
text enters or leaves the path between them as far as step 2 can tell - equal
runs are the same path, and step 3 opens every path that has another way in or
out under its minimizer. A degree is therefore only asked for where two
different runs meet, not for every edge.

No step holds a minimizer's or an edge's occurrences together: groups are
minima with map-side aggregation, and what goes back to the occurrences is a
sort-merge join, which splits hot keys.

Results are exact whatever the size of groups. A null or empty text has no
words; a null id is never a source and loses nothing; rows with equal ids never
remove each other's words; repeated rows give repeated results; an empty table
gives an empty one. A very long text is read again in stretches of PART words,
and spans are cut at their ends. A span whose digest differs, where two hashes
of 64 bits collided, stays. Columns other than id and text are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._io import chunks, stored

#: Odd multipliers of the polynomial hashes (modulo 2**64): k-mers, runs, edges twice.
M_KMER, M_RUN, M_EDGE, M_EDGE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Words of a stretch in which texts are read again.
PART = 4096
#: Words whose hashes a worker remembers within a task (no result depends on it).
MEMO_WORDS = 200_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _WordHash()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def forget() -> None:
    """Gives back what a task has remembered: workers live on, and later stages need the memory."""
    _hash.clear()
    _powers.clear()


def words(text: bytes | None) -> list[bytes]:
    """The text's words: runs without space, tab, newline, \\v, \\f or \\r (bytes.split() cuts at exactly those)."""
    return (text or b"").split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _prefix(a: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial in m, and the powers of its inverse: any stretch's hash is a difference times a power."""
    if m not in _powers or len(_powers[m][0]) <= len(a):
        n = max(1 << 17, 2 * len(a))
        up, down = np.full(n, m, np.uint64), np.full(n, pow(m, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[m] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    up, down = _powers[m]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(a * up[: len(a)], dtype=np.uint64)]), down


def _stretches(a: np.ndarray, m: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums, down = _prefix(a, m)
    return _mixed((sums[end] - sums[start]) * down[start])


def hashed(texts: list[list[bytes]]) -> np.ndarray:
    n = sum(map(len, texts))
    return np.fromiter((h for t in texts for h in map(_hash.__getitem__, t)), np.uint64, n)


def runs_of(texts: list[list[bytes]], window: int, k: int) -> tuple[np.ndarray, ...]:
    """(text's number, start, windows, minimizer, hash of the words) of every run."""
    lens = np.array([len(t) for t in texts], np.int64)
    a = hashed(texts)
    if len(a) < window:
        return (np.zeros(0, np.int64),) * 5
    of = np.repeat(np.arange(len(texts)), lens)
    begin = np.repeat(np.cumsum(lens) - lens, lens)
    at = np.arange(len(a) - k + 1)
    low = _stretches(a, M_KMER, at, at + k)
    span, need = 1, window - k + 1
    while span * 2 <= need:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if need > span:
        low = np.minimum(low[: len(low) - (need - span)], low[need - span :])
    at = np.flatnonzero(of[: len(a) - window + 1] == of[window - 1 :])
    low, of_w = low[at], of[at]
    if not len(at):
        return (np.zeros(0, np.int64),) * 5
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (of_w[1:] != of_w[:-1])]))
    n = np.diff(np.append(first, len(at)))
    start = at[first]
    return of_w[first], start - begin[start], n, low[first].view(np.int64), _stretches(a, M_RUN, start, start + n + window - 1).view(np.int64)


def _runs(docs: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            of, start, n, anchor, seg = runs_of([words(t) for t in batch.column("text").to_pylist()], window, k)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("th").take(take), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(anchor, pa.int64()), pa.array(seg, pa.int64())],
                ["id", "th", "start", "n", "anchor", "seg"],
            )
        forget()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.filter("id IS NOT NULL").mapInArrow(run, f"id {kind}, th int, start int, n int, anchor long, seg long")


def _digest(stretch: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(stretch), digest_size=16).digest()


def _cut(df: DataFrame, at: str, *shifted: str) -> DataFrame:
    """Rows (at, n) cut where `at` passes a multiple of PART; shifted: columns that move along."""
    last = F.floor((F.col(at) + F.col("n") - 1) / PART)
    parts = df.withColumn("part", F.explode(F.sequence(F.floor(F.col(at) / PART), last)))
    lo, hi = F.greatest(F.col(at), F.col("part") * PART), F.least(F.col(at) + F.col("n"), (F.col("part") + 1) * PART)
    return parts.withColumns({**{c: (F.col(c) + lo - F.col(at)).cast("int") for c in (at, *shifted)}, "n": (hi - lo).cast("int")})


def _parts(docs: DataFrame, window: int) -> DataFrame:
    """(id, th, part, text): the words that windows reach which start in each stretch of PART words; no text is copied more than twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            for i in range(batch.num_rows):
                own = words(batch.column("text")[i].as_py())
                texts = [b" ".join(own[lo : lo + 2 * PART + window]) for lo in range(0, max(1, len(own)), PART)]
                same = pa.array([0] * len(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1).take(same), batch.column("th").slice(i, 1).take(same), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["id", "th", "part", "text"])

    # So many bytes hold PART words at most, and need no cutting.
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= 2 * PART
    cut = docs.filter(~short).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, th int, part long, text binary")
    return docs.filter(short).select("id", "th", F.lit(0).cast("long").alias("part"), "text").union(cut)


def _read_again(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """What is asked of texts at (id, th, part, start, n): kind 0, every edge's hashes; kind 1, the digest of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            out: list[list] = [[] for _ in range(8)]
            for i, th, part, text, asks in zip(*(batch.column(c).to_pylist() for c in ("id", "th", "part", "text", "asks")), strict=True):
                own, base = words(text), part * PART
                a = hashed([own])
                edges = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.arange(x["start"] - base, x["start"] - base + x["n"]) for x in asks if x["kind"] == 0)])).astype(np.int64)
                rows = len(edges)
                for col, values in zip(out, ([0] * rows, [i] * rows, [th] * rows, (edges + base).tolist(), [1] * rows, *(_stretches(a, m, edges, edges + window).view(np.int64).tolist() for m in (M_EDGE, M_EDGE2)), [None] * rows), strict=True):
                    col.extend(values)
                for x in asks:
                    if x["kind"] == 1:
                        at = x["start"] - base
                        for col, value in zip(out, (1, i, th, x["start"], x["n"], 0, 0, _digest(own[at : at + x["n"] + window - 1])), strict=True):
                            col.append(value)
            kinds = [pa.int32(), batch.schema.field("id").type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["kind", "id", "th", "start", "n", "h1", "h2", "digest"])
        forget()

    by_text = asked.groupBy("id", "th", "part").agg(F.collect_set(F.struct("kind", "start", "n")).alias("asks"))
    id_kind = docs.schema["id"].dataType.simpleString()
    joined = _parts(docs, window).join(by_text, ["id", "th", "part"]).select("id", "th", "part", "text", "asks")
    return joined.mapInArrow(run, f"kind int, id {id_kind}, th int, start int, n int, h1 long, h2 long, digest binary")


def repeated_spans(docs: DataFrame, window: int = 50, k: int = 17) -> DataFrame:
    """(id, th, start, n, digest): n windows from word `start` on that also start in a document with a smaller id.

    docs: id, th (a hash of the text), text as binary. digest: of the source's
    words, where the span is one to be verified; null for single edges.
    """
    runs = _runs(docs, window, k)
    # Minima are stored before they join what they were made from: a join straight on an aggregate's partitions could not split a hot key.
    anchors = runs.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), (F.min("seg") != F.max("seg")).alias("branches")).filter("lo < hi").select("anchor", "branches")
    anchors = stored(anchors, "anchors")
    hits = stored(runs.join(anchors, "anchor"), "runs")
    first = stored(hits.groupBy("anchor", "seg").agg(F.min(F.struct("id", "th", "start")).alias("first")), "first")
    known = hits.join(first, ["anchor", "seg"])
    later = known.filter("id > first.id").select("id", "th", "start", "n", F.col("first.id").alias("src"), F.col("first.th").alias("src_th"), F.col("first.start").alias("src_start"))
    by_text = Window.partitionBy("id", "th").orderBy("start")
    prev = lambda c: F.lag(c).over(by_text)
    goes_on = (F.col("start") == prev("start") + prev("n")) & (F.col("src") == prev("src")) & (F.col("src_th") == prev("src_th")) & (F.col("src_start") == prev("src_start") + prev("n"))
    compact = (
        later.dropDuplicates(["id", "th", "start"])
        .withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
        .withColumn("span", F.sum("new").over(by_text))
        .groupBy("id", "th", "span")
        .agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min("src").alias("src"), F.min("src_th").alias("src_th"), F.min("src_start").alias("src_start"))
    )
    spans = stored(_cut(compact.drop("span"), "src_start", "start"), "spans")
    opened = known.filter("branches AND id = first.id").select(F.lit(0).alias("kind"), "id", "th", "start", "n")
    opened = _cut(opened, "start").select("kind", "id", "th", "part", "start", "n")
    sources = spans.select(F.lit(1).alias("kind"), F.col("src").alias("id"), F.col("src_th").alias("th"), "part", F.col("src_start").alias("start"), "n")
    read = stored(_read_again(docs, opened.union(sources).distinct(), window), "read")
    edges = read.filter("kind = 0").select("id", "th", "start", "h1", "h2")
    lowest = edges.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("h1", "h2", "lo")
    lowest = stored(lowest, "lowest")
    single = edges.join(lowest, ["h1", "h2"]).filter("id > lo").select("id", "th", "start", F.lit(1).alias("n"), F.lit(None).cast("binary").alias("digest"))
    digests = read.filter("kind = 1").select(F.col("id").alias("src"), F.col("th").alias("src_th"), F.col("start").alias("src_start"), "n", "digest").dropDuplicates(["src", "src_th", "src_start", "n"])
    return spans.join(digests, ["src", "src_th", "src_start", "n"]).select("id", "th", "start", "n", "digest").union(single)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept: the words that stay, joined by a space) of every row."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.hash(F.col(text_col)).alias("th"))
    per_text = repeated_spans(source, window).groupBy("id", "th").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                own = words(text)
                gone = np.zeros(len(own), bool)
                for s in spans or ():
                    start, end = s["start"], s["start"] + s["n"] + window - 1
                    if s["digest"] is None or s["digest"] == _digest(own[start:end]):
                        gone[start:end] = True
                kept = b" ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g] if gone.any() else own)
                rows.append((len(own), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    joined = source.join(per_text, ["id", "th"], "left").select("id", "text", "spans")
    return joined.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string").withColumnRenamed("id", id_col)
