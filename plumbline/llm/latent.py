"""Benchmark decontamination by latent semantic retrieval.

The terms are those of the benchmark's items; every text is turned into term
ids once. Over all passages of all texts, term statistics and a randomised
sketch Y = A'A Omega of the TF-IDF matrix A are summed up, from which a Nystroem
step gives the leading right singular vectors and values. Windows of the texts
are projected there (centred, singular values divided out) and compared by
cosine with the items, blockwise; a window is at least as long as the item and
its stride together, so each place an item can stand in lies whole within one.
Candidates are then checked word by word: the longest common subsequence has to
hold `accept` of the item's words, or `paraphrase` of them if the item's end (its
answer) is there too. Items too short for that (fewer than `SHORTEST` words) are
found where their words stand consecutively.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.
Null texts count as empty; items without words are found nowhere. Items longer
than 64 words are searched in pieces, and where one is found the whole item is
compared with the text around it. Items of equal words are searched once and
give a pair each; repeated rows of the texts give repeated pairs. An empty table
on either side gives no pairs. Very long texts are searched in stretches. Columns
other than ids and texts are not read, whatever their names.

What is broadcast is bounded: items come to the driver as a stream, and as many
as share `TERMS` terms and `WORDS` words make one pass over the texts. A
benchmark of usual size is one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._io import chunks, stored
from plumbline.llm.licenses import TABLE

#: Distinct words and words of the items of one pass at most: what is broadcast grows with these, not with the benchmark.
TERMS, WORDS = 100_000, 2_000_000
#: Pieces of items that windows are compared with at a time.
PIECES = 1024
#: Blocks of pieces up to which a task keeps their tables; with more it makes them anew for each slice.
KEPT_BLOCKS = 4
RANK = 64
#: Cosine from which a window is compared word by word.
COSINE = 0.25
SHORTEST = 5
#: Words of a passage for the statistics.
PASSAGE = 64
#: Longest piece of an item, its windows' words and stride: each window holds a piece wherever it begins.
SIZES = ((24, 32, 8), (48, 64, 16), (64, 96, 32))
ANSWER = 8
TOKENS = 120_000
#: A multiple of PASSAGE.
SEGMENT = 1 << 17
#: Rows of a table that are gathered at a time: they stay in the processor's cache.
GATHERED = 4096
#: Candidates compared word by word at a time.
COMPARED = 4096


@dataclass(frozen=True)
class Items:
    """Distinct items of one pass: their digests and the term ids of each, end to end."""

    keys: list[bytes]
    flat: np.ndarray
    offsets: np.ndarray

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.offsets[i] : self.offsets[i + 1]]


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def _flat(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, term ids laid out at multiples of 32 with -1 between, begin and end of each document) in bounded slices."""
    lists = batch.column("ids")
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    cuts = []
    for i, n in enumerate(sizes):
        if held and held + n > TOKENS:
            cuts.append((start, i))
            start, held = i, 0
        held += n
    if len(sizes):
        cuts.append((start, len(sizes)))
    for lo, hi in cuts:
        flat, own = lists.slice(lo, hi - lo).flatten().to_numpy(), sizes[lo:hi].astype(np.int64)
        # A document's end is filled up with 96 words that are no terms, so that windows never reach the next.
        room = (own + 31) // 32 * 32 + 96
        begin = np.cumsum(room) - room
        out = np.full(int(room.sum()), -1, np.int32)
        out[np.arange(len(flat)) + np.repeat(begin - (np.cumsum(own) - own), own)] = flat
        yield batch.column("id").slice(lo, hi - lo), out, begin, begin + own


def _segments(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The same ids in stretches of whole passages: memory stays bounded however long a document is."""
    for _, ids, _, _ in _flat(batch):
        for lo in range(0, len(ids), SEGMENT):
            yield ids[lo : lo + SEGMENT]


def _term_ids(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        for batch in chunks(batches, "text"):
            texts = [split_words(t) for t in batch.column("text").to_pylist()]
            lens = np.array([len(t) for t in texts], np.int64)
            flat = np.fromiter((get(w, -1) for t in texts for w in t), np.int32, int(lens.sum()))
            offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, ids array<int>")


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))


def _sums(table: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of table[at] over the runs of `at` that start at begin."""
    out, stops = np.empty((len(begin), table.shape[1]), table.dtype), np.append(begin, len(at))
    cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(at), GATHERED)), len(begin)))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        np.add.reduceat(table[at[stops[lo] : stops[hi]]], begin[lo:hi] - stops[lo], axis=0, out=out[lo:hi])
    return out


def _idf(texts: DataFrame, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Inverse passage frequency and share of all term places of every term, over all passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, cf, n = np.zeros(terms, np.int64), np.zeros(terms, np.int64), 0
        for batch in batches:
            for ids in _segments(batch):
                at = np.flatnonzero(ids >= 0)
                passage = at // PASSAGE
                pairs = np.unique(passage * terms + ids[at])
                df += np.bincount(pairs % terms, minlength=terms)
                cf += np.bincount(ids[at], minlength=terms)
                n += len(np.unique(passage))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *df[at].tolist()], pa.int64()), pa.array([0, *cf[at].tolist()], pa.int64())], ["term", "df", "cf"])

    rows = texts.mapInArrow(run, "term int, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).collect()
    df, cf, n = np.zeros(terms), np.zeros(terms), 1
    for r in rows:
        if r["term"] < 0:
            n = max(1, r["df"])
        else:
            df[r["term"]], cf[r["term"]] = r["df"], r["cf"]
    return np.log((n + 1) / (df + 1)) + 0.05, cf / max(1.0, cf.sum())


def _basis(texts: DataFrame, idf: np.ndarray, share: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """For every term its place in latent space: TF-IDF weight times singular vectors over singular values, centred."""
    terms = len(idf)
    omega = np.random.default_rng(seed).standard_normal((terms, rank))
    held = texts.sparkSession.sparkContext.broadcast((idf.astype(np.float32), (idf[:, None] * omega).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, projected = held.value
        total = np.zeros((terms, rank), np.float64)
        for batch in batches:
            for ids in _segments(batch):
                at = np.flatnonzero(ids >= 0)
                if not len(at):
                    continue
                own = ids[at]
                first = _runs(at // PASSAGE)
                passage = np.repeat(np.arange(len(first)), np.diff(first, append=len(at)))
                y = _sums(projected, own, first)
                y /= np.add.reduceat(weight[own] ** 2, first)[:, None]
                order = np.argsort(own, kind="stable")
                begin = _runs(own[order])
                term = own[order[begin]]
                total[term] += _sums(y, passage[order], begin) * weight[term][:, None]
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(total[at].ravel()), rank).cast(pa.list_(pa.float64()))], ["term", "y"])

    # Partial sums meet by term; a term has one row per task at most.
    parts = texts.mapInArrow(run, "term int, y array<double>")
    rows = parts.groupBy("term").agg(*(F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(rank))).collect()
    y = np.zeros((terms, rank))
    for r in rows:
        y[r["term"]] = r[1:]
    # Nystroem: A'A is about Y (Omega'Y)^-1 Y', whose eigenvectors are A's right singular vectors.
    core = omega.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(1e-9, value.max(initial=0) * 1e-9)
    if not good.any():
        return np.zeros((terms, rank), np.float32)
    half = y @ (vector[:, good] / np.sqrt(value[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    place = idf[:, None] * u / np.maximum(s, 1e-9)
    place -= share @ place
    return np.pad(place, ((0, 0), (0, rank - place.shape[1]))).astype(np.float32)


def _windows(ids: np.ndarray, place: np.ndarray, sizes: list[tuple[int, int]], begin: np.ndarray, end: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For every size in words, by its stride, the windows that begin within a text: first places and unit vectors."""
    at = np.flatnonzero(ids >= 0)
    first = _runs(at // 8)
    eighths = np.zeros((len(ids) // 8, place.shape[1]), np.float32)
    eighths[at[first] // 8] = _sums(place, ids[at], first)
    out = {}
    for words, stride in sizes:
        starts = np.arange(0, len(ids) - words + 1, stride)
        v = np.empty((len(starts), place.shape[1]), np.float32)
        for lo in range(0, len(starts), GATHERED):
            hi, step = min(lo + GATHERED, len(starts)), stride // 8
            part = v[lo:hi]
            part[:] = 0
            for k in range(words // 8):
                part += eighths[lo * step + k : (hi - 1) * step + k + 1 : step]
            norm = np.sqrt(np.einsum("ij,ij->i", part, part))
            part /= np.where(norm > 1e-9, norm, np.inf)[:, None]
        kept = (starts < end[np.searchsorted(begin, starts, side="right") - 1]) & v.any(1)
        out[words] = starts[kept], v[kept]
    return out


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := where.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass(frozen=True)
class Table:
    """A block's pieces by their words.

    column: of every term, 0 if it is in none of the pieces. member: which columns
    a piece has. cells: these by piece * columns + column, ascending, and where in
    the piece the term stands, as bits.
    """

    column: np.ndarray
    member: np.ndarray
    cells: np.ndarray
    bits: np.ndarray

    def shared(self, columns: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """How many of a row's columns (a multiple of 8, less than 256) its piece has."""
        has = self.member.reshape(-1).take(columns + (pieces * self.member.shape[1])[:, None])
        return (has.view(np.uint64).sum(1) * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64)

    def lcs(self, columns: np.ndarray, pieces: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each row's columns and its piece of so many words, all rows at once."""
        cells = columns + (pieces * self.member.shape[1])[:, None]
        row, _ = at = np.nonzero(self.member.reshape(-1).take(cells))
        bits = self.bits[np.searchsorted(self.cells, cells[at])]
        # Step k takes the k-th common word of every row that has so many; rows with most of them stand first.
        count = np.bincount(row, minlength=len(columns))
        first = np.cumsum(count) - count
        order = np.argsort(-count, kind="stable")
        first, falling = first[order], -count[order]
        v = np.full(len(columns), ~np.uint64(0))
        for k in range(int(count.max(initial=0))):
            rows = int(np.searchsorted(falling, -k))
            held = v[:rows]
            u = held & bits[first[:rows] + k]
            v[:rows] = (held + u) | (held - u)
        left = np.empty_like(v)
        left[order] = v
        full = ~np.uint64(0) >> (64 - words).astype(np.uint64)
        return words - np.bitwise_count(left & full).astype(np.int64)


class Block:
    """Pieces (item, first word, words) of about one length, to be compared with windows of the same size."""

    def __init__(self, items: Items, pieces: list[tuple[int, int, int]], place: np.ndarray, words: int, stride: int):
        self.pieces, self.words, self.stride, self.items, self.terms = pieces, words, stride, items, len(place)
        q = np.stack([place[self.ids(j)].sum(0) for j in range(len(pieces))])
        self.queries = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)).T

    def ids(self, j: int) -> np.ndarray:
        item, at, n = self.pieces[j]
        return self.items.ids(item)[at : at + n]

    def table(self) -> Table:
        own = np.unique(np.concatenate([self.ids(j) for j in range(len(self.pieces))]))
        column = np.zeros(self.terms, np.int32)
        column[own] = np.arange(1, len(own) + 1)
        member = np.zeros((len(self.pieces), len(own) + 1), bool)
        cells, bits = [], []
        for j in range(len(self.pieces)):
            at = column[self.ids(j)]
            member[j, at] = True
            cells.append(at + j * np.int64(member.shape[1]))
            bits.append(np.uint64(1) << np.arange(len(at), dtype=np.uint64))
        cells, bits = np.concatenate(cells), np.concatenate(bits)
        order = np.argsort(cells, kind="stable")
        begin = _runs(cells[order])
        return Table(column, member, cells[order[begin]], np.bitwise_or.reduceat(bits[order], begin))


def _blocks(items: Items, place: np.ndarray) -> list[Block]:
    by_size: list[list] = [[] for _ in SIZES]
    for i in range(len(items.keys)):
        total = len(items.ids(i))
        if total < SHORTEST:
            continue
        n = -(-total // SIZES[-1][0])
        cuts = [total * c // n for c in range(n + 1)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            by_size[next(k for k, (longest, _, _) in enumerate(SIZES) if hi - lo <= longest)].append((i, lo, hi - lo))
    return [Block(items, pieces[lo : lo + PIECES], place, words, stride) for pieces, (_, words, stride) in zip(by_size, SIZES, strict=True) for lo in range(0, len(pieces), PIECES)]


class ShortItems:
    """Items of fewer than SHORTEST words, by their first two."""

    def __init__(self, items: Items):
        self.by_start: dict[int, list[tuple[int, list[int]]]] = {}
        for i in range(len(items.keys)):
            ids = items.ids(i).tolist()
            if 0 < len(ids) < SHORTEST:
                self.by_start.setdefault(self._code(ids[0], ids[1] if len(ids) > 1 else -1), []).append((i, ids))
        self.codes = np.array(sorted(self.by_start), np.int64)

    @staticmethod
    def _code(one, two):
        return one * (1 << 32) + two + 1

    def found(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, item) where an item's words stand; places between texts hold no term."""
        if not len(self.codes):
            return
        one = ids.astype(np.int64)
        two = np.append(one[1:], -1)
        for code in (self._code(one, np.full_like(one, -1)), self._code(one, two)):
            near = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            for at in np.flatnonzero((self.codes[near] == code) & (one >= 0)).tolist():
                for item, words in self.by_start[int(code[at])]:
                    # A lone word's code also stands where no term follows another one.
                    if ids[at : at + len(words)].tolist() == words:
                        yield at, item


def _search(texts: DataFrame, items: Items, place: np.ndarray, cosine: float, accept: float, paraphrase: float) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast((items, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, place = held.value
        place = np.concatenate([place, np.zeros((1, place.shape[1]), np.float32)])  # -1: no term
        blocks, short = _blocks(items, place), ShortItems(items)
        sizes = sorted({(block.words, block.stride) for block in blocks})
        tables = [block.table() for block in blocks] if len(blocks) <= KEPT_BLOCKS else None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_ids, ids, begin, end in _flat(batch):
                doc_of = lambda x: int(np.searchsorted(begin, x, side="right")) - 1  # noqa: E731, B023
                found: dict[tuple[int, int], list] = {}
                for at, item in short.found(ids):
                    doc = doc_of(at)
                    found.setdefault((doc, item), [{}, len(items.ids(item)), 1.0, at - int(begin[doc])])
                windows = _windows(ids, place, sizes, begin, end) if blocks else {}
                for b, block in enumerate(blocks):
                    words, stride = block.words, block.stride
                    at, v = windows[words]
                    table = tables[b] if tables else block.table()
                    lengths = np.array([n for _, _, n in block.pieces])
                    least = paraphrase * lengths
                    columns = np.pad(table.column[ids], stride)
                    inside, around = sliding_window_view(columns[stride:], words), sliding_window_view(columns, words + 2 * stride)
                    for lo in range(0, len(at), GATHERED):
                        w, c = np.nonzero(v[lo : lo + GATHERED] @ block.queries >= cosine)
                        w = at[lo + w]
                        for s in range(0, len(w), COMPARED):
                            ws, cs = w[s : s + COMPARED], c[s : s + COMPARED]
                            good = table.shared(inside[ws], cs) >= least[cs]
                            ws, cs = ws[good], cs[good]
                            # A text's own words in the window and a stride around; what is outside has column 0.
                            docs = np.searchsorted(begin, ws, side="right") - 1
                            where = ws[:, None] + np.arange(-stride, words + stride)
                            n = table.lcs(np.where((where >= begin[docs, None]) & (where < end[docs, None]), around[ws], 0), cs, lengths[cs])
                            for x, j, doc, k in zip(*(a[n >= least[cs]].tolist() for a in (ws, cs, docs, n)), strict=True):
                                _check(found, items, block, j, x, doc, ids, begin, end, k)
                for (doc, item), (by_piece, n, answer, at) in sorted(found.items()):
                    share = max(n, sum(by_piece.values())) / len(items.ids(item))  # pieces may also stand far apart
                    if share >= accept or share >= paraphrase and answer >= 0.999:
                        for col, value in zip(out, (doc, items.keys[item], min(1.0, share), answer >= 0.999, at), strict=True):
                            col.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(out[0])), pa.array(out[1], pa.binary()), pa.array(out[2], pa.float64()), pa.array(out[3]), pa.array(out[4], pa.int64())], ["id", "key", "lcs_share", "answer", "first_word"])
                    out = [[], [], [], [], []]

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, key binary, lcs_share double, answer boolean, first_word long")


def _check(found: dict, items: Items, block: Block, j: int, x: int, doc: int, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> None:
    """Compares the whole item of piece j, n of whose words stand in the window at x, with the text around."""
    first, last = int(begin[doc]), int(end[doc])
    lo, hi = x - block.stride, x + block.words + block.stride
    region = ids[max(first, lo) : min(last, hi)].tolist()
    item, at, words = block.pieces[j]
    whole = items.ids(item).tolist()
    best = found.setdefault((doc, item), [{}, 0, 0.0, x - first])
    best[0][at] = max(best[0].get(at, 0), n)
    if words < len(whole):
        # The piece may stand anywhere in the window; the item's other words lie before and after, up to a quarter more.
        before, after = (k + k // 4 for k in (at, len(whole) - at - words))
        region = ids[max(first, lo - before) : min(last, hi + after)].tolist()
        n = lcs(whole, region)
    answer = lcs(whole[-ANSWER:], region) / len(whole[-ANSWER:])
    best[1], best[2] = max(best[1], n), max(best[2], answer)


def _normalised(benchmark: DataFrame) -> DataFrame:
    """(item, key: a digest of the item's words, words: them, joined by spaces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = [b" ".join(split_words(t)) for t in batch.column("text").to_pylist()]
            keys = [hashlib.blake2b(w, digest_size=16).digest() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(keys, pa.binary()), pa.array(words, pa.binary())], ["item", "key", "words"])

    return benchmark.mapInArrow(run, f"item {benchmark.schema['item'].dataType.simpleString()}, key binary, words binary")


def _passes(distinct: DataFrame) -> Iterator[tuple[dict[bytes, int], Items]]:
    """The distinct items as a stream, cut where the terms or words of a pass are full (a larger item stands alone)."""
    vocabulary: dict[bytes, int] = {}
    keys, flat, offsets = [], [], [0]
    done = lambda: (vocabulary, Items(keys, np.array(flat, np.int32), np.array(offsets)))
    for r in distinct.toLocalIterator():
        words = bytes(r["words"]).split()
        if keys and (len(flat) + len(words) > WORDS or len(vocabulary) + len(set(words) - vocabulary.keys()) > TERMS):
            yield done()
            vocabulary, keys, flat, offsets = {}, [], [], [0]
        flat += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        keys.append(bytes(r["key"]))
        offsets.append(len(flat))
    if keys:
        yield done()


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, accept: float = 0.8, paraphrase: float = 0.65, rank: int = RANK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc id, item id, lcs_share, answer, first_word) for each item found in each document."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    items = stored(_normalised(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("binary").alias("text"))), "items")
    distinct = items.filter("octet_length(words) > 0").groupBy("key").agg(F.first("words").alias("words")).orderBy("key")
    found = None
    for vocabulary, block in _passes(distinct):
        texts = stored(_term_ids(source, vocabulary), "terms")
        idf, share = _idf(texts, len(vocabulary))
        part = _search(texts, block, _basis(texts, idf, share, rank), cosine, accept, paraphrase)
        found = part if found is None else found.union(part)
    if found is None:
        kind, item_kind = source.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"{id_col} {kind}, {item_col} {item_kind}, lcs_share double, answer boolean, first_word long")
    pairs = found.join(items.select("key", "item"), "key")
    return pairs.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "lcs_share", "answer", "first_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs in whose texts no item was found, with all their columns."""
    bad = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")
