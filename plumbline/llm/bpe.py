"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a block of texts form a trie. A depth-first walk over it
(the words in byte order, each starting at the prefix it shares with the one
before) carries one state per prefix: the last token of that prefix' encoding.
The state of a longer prefix is the token that ends it and may follow the state
of the rest; so the encoding of a shared prefix is computed once. Two tokens
may follow each other exactly if encoding their joined bytes gives the two
tokens again. Where each merge makes a token of its own from tokens of earlier
merges, that is read off their merges, undone from the last one back: no merge
across the border may come before one that is undone.

Null texts count as empty ones; an empty text has no tokens. Rows are handled
on their own: repeated rows give repeated results, an empty table an empty one.
A very long text takes memory in proportion to its words, once. Of merges with
equal rank there are none. Columns other than the id and the text are not read,
whatever their names. Vocabulary files that ask for more than byte-level BPE
(normalisers, prefix spaces, dropout) are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._io import chunks

#: Words whose encodings a worker remembers; past that it starts anew (no result depends on it).
MEMO_WORDS = 250_000
#: Pairs of tokens that it remembers to go together or not.
MEMO_PAIRS = 600_000
NEVER = (1 << 60, 0)
#: A token that no merge makes, and what a prefix ends in before its first token.
NONE = -1
#: White space as the pre-tokenizer's own regular expressions know it.
SPACE = r"\t-\r \x85\xa0  -     　"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """A byte-level BPE vocabulary with its walk over tries of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._known(spec)
        model, of = spec["model"], _printable_bytes()
        raw = lambda s: bytes(of[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: raw(s) for s, i in model["vocab"].items() if s not in self.added}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (raw(s) for s in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merge[self.id_of[left], self.id_of[right]] = rank, self.id_of[left + right]
        # Letters come first, which no other alternative can begin with; ASCII texts are cut alike by the faster library.
        self.words = regex.compile(rf" ?\p{{L}}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.plain = re.compile(r" ?[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.made = {token: (rank, *pair) for pair, (rank, token) in self.merge.items()}
        earlier = lambda pair, rank: all(t not in self.made or self.made[t][0] < rank for t in pair)
        self.ordered = len(self.made) == len(self.merge) and all(earlier(pair, rank) for pair, (rank, _) in self.merge.items())
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        # Every beginning of a token that stands alone, with that token if it is one.
        self.starts = dict.fromkeys((b[:n] for b in self.id_of for n in range(1, len(b))), NONE) | {b: i for b, i in self.id_of.items() if self.stands_alone(i)}
        self.whole = {}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    @staticmethod
    def _known(spec: dict) -> None:
        """Refuses files whose texts are not cut and merged as here."""
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only byte-level vocabularies without normaliser and prefix space are known")
        if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models are known")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with conditions are not known")

    def merged(self, data: bytes) -> list[int]:
        """The encoding by merges, lowest rank first: for the short strings that decide which tokens go together."""
        ids = [self.id_of[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            rank, at = min((self.merge.get(pair, NEVER)[0], i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == NEVER[0]:
                break
            ids[at : at + 2] = [self.merge[ids[at], ids[at + 1]][1]]
        return ids

    def stands_alone(self, token: int) -> bool:
        if (known := self.whole.get(token)) is None:
            if not self.ordered:
                known = self.merged(self.bytes_of[token]) == [token]
            elif token not in self.made:
                known = len(self.bytes_of[token]) == 1
            else:
                rank, left, right = self.made[token]
                known = self.stands_alone(left) and self.stands_alone(right) and self._apart(left, right, rank)
            self.whole[token] = known
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two tokens that stand alone stay apart side by side."""
        if not self.ordered:
            return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return self._apart(left, right, NEVER[0])

    def _apart(self, left: int, right: int, until: int) -> bool:
        """Whether no merge joins the ends of two tokens before rank `until`.

        The merges within the tokens are undone, the last one first. A pair that
        meets at the border at that point must not have a rank before the merge
        undone last; of equal ranks the one further left is merged first.
        """
        merge, made, none = self.merge, self.made, (NONE, NONE, NONE)
        while True:
            if merge.get((left, right), NEVER)[0] < until:
                return False
            l, r = made.get(left, none), made.get(right, none)  # noqa: E741
            if l[0] > r[0]:
                until, left = l[0], l[2]
            elif r[0] >= 0:
                until, right = r[0] + 1, r[1]
            else:
                return True

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its token ids, by one depth-first walk over the words' trie."""
        get, pairs, bytes_of, before = self.starts.get, self.pairs, self.bytes_of, b""
        if len(pairs) > MEMO_PAIRS:
            pairs.clear()
        # Of each prefix its last token, and the first place where a token may begin that ends in it or later.
        last, first = [NONE], [0]
        for word in sorted(set(words)):
            shared, size = 0, len(word)
            most = min(size, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], first[shared + 1 :]
            least = first[shared]
            for end in range(shared + 1, size + 1):
                for start in range(least, end):
                    if (token := get(word[start:end])) is None:
                        if start == least:
                            least += 1
                    elif token != NONE:
                        if not start:
                            break
                        key = last[start] << 32 | token
                        if (known := pairs.get(key)) is None:
                            known = pairs[key] = self.may_follow(last[start], token)
                        if known:
                            break
                last.append(token)
                first.append(least)
            before, ids, end = word, [], size
            while end:
                ids.append(token := last[end])
                end -= len(bytes_of[token])
            ids.reverse()
            yield word, ids

    def split(self, text: str) -> list[str]:
        """The text's words as the pre-tokenizer cuts them; added tokens stand alone."""
        findall = (self.plain if text.isascii() else self.words).findall
        if self.special is None or not self.special.search(text):
            return findall(text)
        return [w for part in self.special.split(text) for w in ([part] if part in self.added else findall(part))]

    def learn(self, texts: list[list[str]]) -> tuple[dict[str, str], dict[str, str]]:
        """For every word of the texts: its ids joined by commas, and what they decode to."""
        if len(self.ids) > MEMO_WORDS:
            self.ids, self.texts = {}, {}
        new = set().union(*texts).difference(self.ids)
        for w in new & self.added.keys():
            self.ids[w], self.texts[w] = str(self.added[w]), w
        text_of = self.text_of
        for raw, ids in self.encode_words([w.encode() for w in new - self.added.keys()]):
            word, decoded = raw.decode(), self.decode(ids).decode("utf-8", "replace")
            self.ids[word], self.texts[word] = ",".join([text_of[i] for i in ids]), word if decoded == word else decoded
        return self.ids, self.texts

    def forget(self) -> None:
        """Gives back what a task has remembered: workers live on, and later stages need the memory."""
        self.ids, self.texts, self.pairs = {}, {}, {}

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        ids, _ = self.learn([words])
        return [int(i) for w in words for i in ids[w].split(",")]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> TrieBpe:
    """One vocabulary per worker process."""
    return TrieBpe(path)


def encode_and_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256 and, if keep_ids, ids array<int> and decoded string) of every text.

    path: a byte-level BPE file of the tokenizers library, there on every executor.
    Bytes that decode to no UTF-8 become U+FFFD, as in that library.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in chunks(batches, "text"):
            texts = [bpe.split(t or "") for t in batch.column("text").to_pylist()]
            known, back = bpe.learn(texts)
            columns: list[list] = [[], [], [], [], []]
            for words in texts:
                ids, decoded = ",".join(map(known.__getitem__, words)), "".join(map(back.__getitem__, words))
                columns[0].append(ids.count(",") + 1 if ids else 0)
                columns[1].append(hashlib.sha256(ids.encode()).hexdigest())
                columns[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    columns[3].append(np.fromstring(ids, np.int32, sep=",").tobytes() if ids else b"")
                    columns[4].append(decoded)
            arrays = [pa.array(c, k) for c, k in zip(columns[:3], (pa.int64(), pa.string(), pa.string()), strict=True)]
            if keep_ids:
                offsets = pa.array([0, *accumulate(columns[0])], pa.int32())
                ids = pa.Array.from_buffers(pa.int32(), sum(columns[0]), [None, pa.py_buffer(b"".join(columns[3]))])
                arrays += [pa.ListArray.from_arrays(offsets, ids), pa.array(columns[4], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays) + 1])
        bpe.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
