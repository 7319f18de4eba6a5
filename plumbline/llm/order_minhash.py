"""Near-duplicate documents by Order MinHash and banded alignment.

A sketch takes, under one seed, the two smallest of a text's occurrence-labelled
word k-mers and keeps them in the order in which they stand in the text, so two
texts share it about as often as their alignment keeps k-mers. Texts with a
common sketch form a bucket; each meets the bucket's smallest id among those of
about its length, a number of pairs linear in the bucket. Short texts, whose few
k-mers sketches may miss, also meet by each of their k-mers. Pairs that met are
candidates, and one counts if the texts' edit similarity in words, 1 - distance
/ longer length, reaches the threshold by a banded alignment. Texts that failed
against a hub, linked elsewhere or not, meet again under `SECOND` second
sketches, each a key under which they failed together with a word of the text,
both the smallest under a seed: texts that are alike agree in both far more
often than strangers who share a common line. Classes are the connected
components of the pairs that count.

Texts with the same words are one text from the start. Texts with fewer than
`SHORTEST` words, null ones among them (no words), have equal texts only as
duplicates. Rows with a null id are classes of their own. Rows that repeat an id
share its class, whatever their texts: these count as duplicates of each other.
Ties do not arise, ids and hashes of texts order them. A very long text takes
memory in proportion to its words, and an alignment its band times its words in
bits. An empty table gives an empty result. Minima aggregate map-side and joins
split hot keys, so a bucket may hold any share of the rows. Columns other than
id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._io import chunks, release, stored
from plumbline.llm.graph import components
from plumbline.llm.substring import M_KMER, _mixed, _stretches, forget, hashed, words

K = 3
#: Sketches of a text; one that two texts share makes a candidate.
KEYS = 64
#: Texts with fewer words have only equal ones as duplicates.
SHORTEST = 5
#: Texts of at most so many words also meet by each k-mer, and those of at most `ONE_EDIT`, which 0.8 lets differ in one word, without each of their words.
SHORT, ONE_EDIT = 64, 9
#: Second sketches of texts that failed against a hub: a key of theirs with a word.
SECOND = 24
PAIR = ["id", "th", "hub", "hub_th"]
SEEDS = np.random.default_rng(5).integers(1, 1 << 62, KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _occurrences(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often the same k-mer stood in the same text before."""
    order = np.lexsort((hashes, of))
    h, t = hashes[order], of[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]))
    count = np.arange(len(h)) - np.repeat(new, np.diff(np.append(new, len(h))))
    out = np.empty(len(h), np.int64)
    out[order] = count
    return out


def sketch_keys(texts: list[list[bytes]], k: int = K) -> list[list[int]]:
    """The keys of every text; none for texts with fewer than k or `SHORTEST` words."""
    lens = np.array([len(t) for t in texts], np.int64)
    a = hashed(texts)
    n_kmers = np.where(lens < max(k, SHORTEST), 0, lens - k + 1)
    have = np.flatnonzero(n_kmers)
    out: list[list[int]] = [[] for _ in texts]
    if not len(have):
        return out
    n = n_kmers[have]
    begin = np.cumsum(n) - n
    of = np.repeat(np.arange(len(have)), n)
    at = np.arange(len(of)) - begin[of] + (np.cumsum(lens) - lens)[have][of]
    kmer = _stretches(a, M_KMER, at, at + k)
    label = _mixed(kmer + _occurrences(kmer, of).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    keys = np.zeros((len(have), KEYS), np.uint64)
    for s, seed in enumerate(SEEDS):
        h = (label ^ seed) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        picked = []
        for _ in range(2):
            low = np.minimum.reduceat(h, begin)
            where = np.flatnonzero(h == low[of])
            first = where[np.unique(of[where], return_index=True)[1]]
            picked.append(first)
            h[first] = top
        one, two = np.minimum(*picked), np.maximum(*picked)
        keys[:, s] = _mixed(kmer[one] * np.uint64(3) + _mixed(kmer[two] + np.uint64(s)))
    alone = _mixed(kmer + np.uint64(KEYS)).view(np.int64)
    for i, row, lo, own in zip(have.tolist(), keys.view(np.int64).tolist(), begin.tolist(), n.tolist(), strict=True):
        if lens[i] <= SHORT:
            row += alone[lo : lo + own].tolist()
        if lens[i] <= ONE_EDIT:
            row += _without_one(texts[i])
        out[i] = list(dict.fromkeys(row))
    return out


def word_minima(texts: list[list[bytes]]) -> np.ndarray:
    """For every text the smallest of its occurrence-labelled words under each of SECOND seeds, as 32 bits; 0 without words."""
    lens = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), SECOND), np.int32)
    have = np.flatnonzero(lens)
    if not len(have):
        return out
    a = hashed(texts)
    of = np.repeat(np.arange(len(texts)), lens)
    label = _mixed(a + _occurrences(a, of).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    begin = (np.cumsum(lens) - lens)[have]
    for s in range(SECOND):
        h = (label ^ SEEDS[s]) * np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(32)
        out[have, s] = np.minimum.reduceat(h, begin).astype(np.uint32).view(np.int32)
    return out


def _without_one(text: list[bytes]) -> list[int]:
    """Keys that two texts share if one edit makes them equal: of the text, and of it without each word."""
    left = [text, *(text[:i] + text[i + 1 :] for i in range(len(text)))]
    return [int.from_bytes(hashlib.blake2b(b" ".join(t), digest_size=8).digest(), "little", signed=True) for t in left]


def banded_distance(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences, or None if it exceeds `most`.

    Bit-parallel over the 2 * most + 1 diagonals that an alignment of that cost
    can touch; common ends are cut off first.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    lo, n = 0, len(b)
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : n - hi]
    m, n = len(a), len(b)
    if not n:
        return m if m <= most else None
    band = min(most, m)
    width = 2 * band + 1
    mask = (1 << width) - 1
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    # Bit i of a column j stands for row j - band + i + 1 of a; rows up to 0 count down to the edge.
    rising = mask & ~((1 << band) - 1)
    falling = (1 << band) - 1
    goal = m - n + band
    cost = m - n
    for j, x in enumerate(b):
        match = where.get(x, 0)
        shift = j - band
        match = (match >> shift if shift >= 0 else match << -shift) & mask
        diagonal = ((((match & rising) + rising) ^ rising) | match | falling) & mask
        right_up = falling | ~(diagonal | rising) & mask
        right_down = diagonal & rising
        if not diagonal >> goal & 1:
            cost += 1
            if cost > most:
                return None
        moved = diagonal >> 1
        falling = moved & right_up
        rising = (right_down | ~(moved | right_up)) & mask
    return cost if cost <= most else None


def similar(a: list, b: list, threshold: float) -> float:
    """Edit similarity of two word sequences if it reaches the threshold, else 0."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    distance = banded_distance(a, b, int((1 - threshold) * longer + 1e-9))
    return 0.0 if distance is None else 1 - distance / longer


def _sketched(source: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = [words(t) for t in batch.column("text").to_pylist()]
            same = [hashlib.blake2b(b" ".join(t), digest_size=16).digest() for t in texts]
            minima = pa.array(word_minima(texts).ravel(), pa.int32())
            second = pa.ListArray.from_arrays(pa.array(np.arange(0, len(minima) + 1, SECOND), pa.int32()), minima)
            columns = [pa.array(same, pa.binary()), pa.array([len(t) for t in texts], pa.int32()), pa.array(sketch_keys(texts, k), pa.list_(pa.int64())), second]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), *columns], ["id", "th", "same", "n", "keys", "second"])
        forget()

    kind = source.schema["id"].dataType.simpleString()
    return source.filter("id IS NOT NULL").mapInArrow(run, f"id {kind}, th int, same binary, n int, keys array<long>, second array<int>")


def _met(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, th, key, hub, hub_th) of each row (id, th, n, band, key) with its buckets' hubs whose lengths allow the threshold.

    A bucket has a hub for each band of lengths, the smallest id there; a row meets those of its own band and the next ones.
    """
    hubs = stored(rows.groupBy("key", "band").agg(F.min(F.struct("id", "th", "n")).alias("hub")), "hubs")  # a join straight on the aggregate's partitions could not split a hot bucket
    near = hubs.select("key", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))).alias("band"), "hub")
    allowed = F.least("n", "hub.n") >= F.greatest("n", "hub.n") * F.lit(threshold) - 1e-9
    met = rows.join(near, ["key", "band"]).filter((F.struct("id", "th") != F.struct("hub.id", "hub.th")) & allowed)
    met = stored(met.select("id", "th", "key", F.col("hub.id").alias("hub"), F.col("hub.th").alias("hub_th")), "met")
    release(hubs)
    return met


def _links(texts: DataFrame, source: DataFrame, threshold: float) -> DataFrame:
    """(id, th, hub, hub_th) of pairs that count, enough of them that their components are those of all pairs found.

    Each text is compared first with the hub it shares most keys with, which in
    a large group of copies joins nearly all of it; after that only pairs whose
    ends lie in different components are.
    """
    width = -math.log(min(0.99, max(0.01, threshold)))
    band = F.floor(F.log("n") / width).cast("int").alias("band")
    keyed = texts.select("id", "th", "n", band, F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key"), "shared")
    rows = stored(keyed.join(shared, "key"), "buckets")
    met = _met(rows, threshold)
    release(shared, rows)
    pairs = stored(met.groupBy(*PAIR).agg(F.collect_list("key").alias("keys")), "pairs")
    release(met)
    best = F.max_by(F.struct("hub", "hub_th"), F.struct(F.size("keys"), -F.col("hub_th").cast("long"), F.xxhash64("hub"))).alias("best")
    first = pairs.groupBy("id", "th").agg(best).select("id", "th", "best.hub", "best.hub_th")
    done = stored(_verified(first, source, threshold), "verified")
    parts = components(done.filter("similarity > 0"), "id", "hub")
    done = done.union(stored(_verified(_apart(pairs.select(*PAIR).join(done.select(*PAIR), PAIR, "left_anti"), parts), source, threshold), "verified"))
    picked = _failed_under(pairs, done.filter("similarity = 0"))
    both = F.explode(F.array_distinct(F.transform(F.arrays_zip("picked", "second"), lambda x, s: F.xxhash64(x["picked"], x["second"], s)))).alias("key")
    again = stored(picked.join(texts.select("id", "th", "n", "second"), ["id", "th"]).select("id", "th", "n", band, both), "again")
    release(pairs)
    second = _met(again, threshold)
    new = second.select(*PAIR).distinct().join(done.select(*PAIR), PAIR, "left_anti")
    done = done.union(stored(_verified(_apart(new, parts), source, threshold), "verified"))
    links = stored(done.filter("similarity > 0").select(*PAIR), "links")
    release(again, second)
    return links


def _failed_under(pairs: DataFrame, failed: DataFrame) -> DataFrame:
    """(id, th, picked) of each text with failed pairs: of the keys under which it met those hubs, the smallest under each of SECOND seeds.

    A pair has its keys in one row of pairs, so the join makes a row for each failed pair.
    """
    keys = pairs.join(failed.select(*PAIR), PAIR).groupBy("id", "th").agg(F.flatten(F.collect_list("keys")).alias("keys"))
    smallest = (F.array_min(F.transform("keys", lambda key: F.struct(F.xxhash64(key, F.lit(s)).alias("h"), key.alias("key"))))["key"] for s in range(SECOND))
    return keys.select("id", "th", F.array(*smallest).alias("picked"))


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components (id, component)."""
    own = parts.select("id", F.col("component").alias("own"))
    other = parts.select(F.col("id").alias("hub"), F.col("component").alias("other"))
    both = pairs.join(own, "id", "left").join(other, "hub", "left")
    return both.filter(F.coalesce("own", "id") != F.coalesce("other", "hub")).select(*PAIR)


def _verified(pairs: DataFrame, source: DataFrame, threshold: float) -> DataFrame:
    """pairs with their edit similarity (0 below the threshold)."""
    texts = source.filter("id IS NOT NULL")
    other = texts.select(F.col("id").alias("hub"), F.col("th").alias("hub_th"), F.col("text").alias("hub_text"))
    both = pairs.join(texts, ["id", "th"]).join(other, ["hub", "hub_th"]).select("id", "th", "hub", "hub_th", "text", "hub_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            value, last, hub = [], None, []
            for a, b in zip(batch.column("text"), batch.column("hub_text"), strict=True):
                if (raw := b.as_py()) != last:
                    last, hub = raw, words(raw)
                value.append(similar(words(a.as_py()), hub, threshold))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "th", "hub", "hub_th")), pa.array(value, pa.float64())], ["id", "th", "hub", "hub_th", "similarity"])

    kind = source.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"id {kind}, th int, hub {kind}, hub_th int, similarity double").dropDuplicates(["id", "th", "hub", "hub_th"])


def _classified(docs: DataFrame, threshold: float, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, n: rows, first: the smallest hash of a text of the id and its rows) of every id; texts of one id count as duplicates."""
    source = docs.select(F.col(id_col).alias("id"), F.hash(F.col(text_col)).alias("th"), F.col(text_col).cast("binary").alias("text"))
    every = stored(_sketched(source, k), "sketches")
    texts = every.groupBy("same").agg(F.min(F.struct("id", "th")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("second").alias("second"))
    texts = stored(texts.select("same", F.col("rep.id").alias("id"), F.col("rep.th").alias("th"), "n", "keys", "second"), "texts")
    members = every.select("id", "th", "same").join(texts.select("same", F.col("id").alias("rep")), "same")
    by_text = members.groupBy("id", "th").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    ids = by_text.groupBy("id").agg(F.sum("n").alias("n"), F.min(F.struct("th", "n")).alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ids = stored(ids, "ids")
    links = _links(texts, source, threshold)
    several = members.join(ids.filter("lo <> hi").select("id", "lo"), "id").select("rep", F.col("lo").alias("hub"))
    parts = components(links.select(F.col("id").alias("rep"), "hub").union(several), "rep", "hub")
    known = ids.join(parts.withColumnRenamed("id", "lo"), "lo", "left").select("id", F.coalesce("component", "lo").alias("class_id"), "n", "first")
    known = stored(known, "known")
    release(every, texts, links, ids)
    return known


def classes(docs: DataFrame, threshold: float = 0.8, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id: the smallest id of the row's class, n_class: rows of the class, kept: the id is the class') of every row."""
    known = _classified(docs, threshold, k, id_col, text_col)
    sizes = stored(known.groupBy("class_id").agg(F.sum("n").alias("n_class")), "sizes")
    known = known.select("id", "class_id").join(sizes, "class_id")
    rows = docs.select(F.col(id_col).alias("id")).join(known, "id", "left")
    return rows.select(F.col("id").alias(id_col), "class_id", F.coalesce("n_class", F.lit(1)).alias("n_class"), F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class with all its columns, and every row with a null id.

    It is the row with the smallest id. Where several rows have that id, the one
    whose text hashes lowest, and of equal texts the one that does so as JSON.
    """
    known = _classified(docs, threshold, K, id_col, text_col).filter("id = class_id")
    known = known.select(F.col("id").alias("_kept"), F.col("first.th").alias("_kept_th"), F.col("first.n").alias("_kept_n"))
    its_own = (docs[id_col] == known["_kept"]) & (F.hash(docs[text_col]) == known["_kept_th"])
    single = docs.join(known.filter("_kept_n = 1"), its_own, "left_semi")
    nameless = docs.filter(F.col(id_col).isNull())
    if known.filter("_kept_n > 1").isEmpty():
        return single.union(nameless)
    repeated = docs.join(known.filter("_kept_n > 1"), its_own, "left_semi")
    first = repeated.groupBy(id_col).agg(F.min(F.xxhash64(F.to_json(F.struct(*docs.columns)))).alias("_first")).select(F.col(id_col).alias("_of"), "_first")
    one = repeated.join(first, (repeated[id_col] == first["_of"]) & (F.xxhash64(F.to_json(F.struct(*(repeated[c] for c in docs.columns)))) == first["_first"]), "left_semi").dropDuplicates([id_col])
    return single.union(one).union(nameless)
