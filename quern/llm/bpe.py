"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal (operator 5).

The encoding of a word is fixed by its last token: what stands before is the encoding of the shorter prefix. So each
node of a trie of words (each prefix) needs one state, the last token of its encoding, which follows from the states
of the nodes above: it is the one token that ends at the node and stays apart from the token before it. Words are
put into the trie in byte order, and a depth-first walk computes the state of a prefix once for all words below it.
The walk keeps only the path to the current word.

Spark spreads the documents; each task walks the trie of the distinct words of a slice that it has not met before,
and keeps word encodings in a cache of bounded size. Nothing is shuffled.

Defined cases: a null text counts as empty and has no ids; null ids decode to the empty string; rows are
independent, so repeated rows, null doc_ids and extra columns change nothing. A word as long as a whole text is a path of the trie like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow, plus, slices, strings

# Fixed value: how byte-level vocabularies split text into words before the merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker's cache of word encodings keeps only the words at hand beyond so many bytes of words and ids.
CACHE_BYTES = 96 << 20
#: So many answers about token borders are remembered, about 60 MB.
APART_MOST = 300_000


def printable() -> dict[str, int]:
    """Byte-level files write each byte as one visible character: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path}: only plain byte-level BPE files are read")
        code = printable()
        self.bytes = {i: bytes(map(code.__getitem__, t)) for t, i in spec["model"]["vocab"].items()}
        self.ids = {b: i for i, b in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, tuple[int, int, int]] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = (self.ids[bytes(map(code.__getitem__, x))] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[a, b] = n
            self.born.setdefault(self.ids[self.bytes[a] + self.bytes[b]], (n, a, b))
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens") or ()):
            raise ValueError(f"{path}: added tokens that take white space are not supported")
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.words = regex.compile(WORDS)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.whole: set[int] = set()  # tokens known to be the encoding of their own bytes
        self.apart: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}  # a word's ids as little-endian int32
        self.cached = 0

    def is_whole(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token; memoised plain merging."""
        if token not in self.whole and merge(self, self.bytes[token]) == [token]:
            self.whole.add(token)
        return token in self.whole

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together leaves a and b: walking back in time along their border,
        no pair across it may have been due before both its sides were taken up."""
        known = self.apart.get((a, b))
        if known is None:
            x, y, due, known = a, b, len(self.rank), True
            while True:
                if self.rank.get((x, y), due) < due:
                    known = False
                    break
                bx, by = self.born.get(x), self.born.get(y)
                if bx and (not by or bx[0] > by[0]):
                    due, x = bx[0], bx[2]
                elif by:
                    due, y = by[0] + 1, by[1]
                else:
                    break
            if len(self.apart) > APART_MOST:
                self.apart.clear()
            self.apart[a, b] = known
        return known

    def states(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, tuple[int, ...]]]:
        """Depth-first through the trie of words given in byte order: yields each with its ids."""
        last: list[int] = []  # state of each prefix on the path, by its length less one
        before = b""
        find, longest, token_bytes, known, whole = self.ids.get, self.longest, self.bytes, self.apart.get, self.whole
        for word in words:
            shared = len(commonprefix((before, word)))
            del last[shared:]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = find(word[start:end])
                    if token is not None:
                        if start:
                            apart = known((last[start - 1], token))
                            if apart is None:
                                apart = self.stay_apart(last[start - 1], token)
                        else:
                            apart = True
                        if apart and (token in whole or self.is_whole(token)):
                            last.append(token)
                            break
                else:
                    raise ValueError(f"no token for the byte {word[end - 1]:#x}")
            out, end = [], len(word)
            while end:
                out.append(last[end - 1])
                end -= len(token_bytes[out[-1]])
            before = word
            yield word, tuple(reversed(out))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; special strings become their single ids, as the library does by default."""
        split: list[list] = []
        new: set[str] = set()
        cache = self.cache
        for text in texts:
            pieces = [text] if self.parts is None or not any(s in text for s in self.special) else self.parts.split(text)
            words: list[str] = []
            for k, piece in enumerate(pieces):
                if k % 2:
                    cache.setdefault(piece, np.int32(self.special[piece]).tobytes())
                    words.append(piece)
                else:
                    words += self.words.findall(piece)
            split.append(words)
            new.update(words)
        new.difference_update(cache)
        for word, found in self.states(sorted(w.encode() for w in new)):
            cache[word.decode()] = np.array(found, "<i4").tobytes()
            self.cached += 2 * len(word) + 4 * len(found) + 180
        out = [np.frombuffer(b"".join(map(cache.__getitem__, words)), "<i4") for words in split]
        if self.cached > CACHE_BYTES:  # the words of these texts stay, and so do all that are frequent
            self.cache = {w: cache[w] for words in split for w in words}
            self.cached = sum(2 * len(w) + len(x) + 180 for w, x in self.cache.items())
        return out


def merge(v: Vocabulary, data: bytes) -> list[int]:
    """Plain merging, lowest rank first: the definition that the trie walk is held against."""
    out = [v.ids[bytes([b])] for b in data]
    while len(out) > 1:
        ranks = [v.rank.get(p, 1 << 60) for p in zip(out, out[1:])]  # noqa: B905
        least = min(ranks)
        if least == 1 << 60:
            break
        at = ranks.index(least)
        out[at : at + 2] = [v.ids[v.bytes[out[at]] + v.bytes[out[at + 1]]]]
    return out


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, column: str = "text", out: str = "ids") -> DataFrame:
    """docs with an array<int> column `out` of the token ids of `column`; an older column of that name is replaced."""
    kept = docs.drop(out)
    schema = plus(kept.schema, out, "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in slices(batches, column, 2 << 20):
            lists = listed(v.encode(strings(batch, column)))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return arrow(kept, run, schema)


class Decoder:
    """Gathers the bytes of ids from one table of all tokens' bytes."""

    def __init__(self, v: Vocabulary):
        size = max(v.bytes) + 1
        tokens = [v.bytes.get(i, b"") for i in range(size)]
        self.lengths = np.array(list(map(len, tokens)), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids[bounds[i]:bounds[i + 1]]; broken UTF-8 becomes U+FFFD."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        data, edge = self.blob[at].tobytes(), np.concatenate([[0], ends])[bounds]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:])]  # noqa: B905


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(vocabulary(path))


def listed(found: list[np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """An Arrow list array of ids, with the flat ids and their bounds."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    ids = np.concatenate(found)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), ids, bounds


def decode(encoded: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with a string column `out`: the text of the ids in `column`."""
    kept = encoded.drop(out)
    schema = plus(kept.schema, out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = decoder(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column))
            bounds = np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in lists])])
            texts = text(lists.flatten().to_numpy(zero_copy_only=False), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return arrow(kept, run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded for each row of docs(doc_id, text), in one pass; decoded comes from the ids alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, text = vocabulary(path), decoder(path)
        for batch in slices(batches, most=2 << 20):
            lists, ids, bounds = listed(v.encode(strings(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(text(ids, bounds), pa.string())], names=["doc_id", "ids", "decoded"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(plain, run, "doc_id long, ids array<int>, decoded string")
