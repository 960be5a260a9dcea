"""Substring dedup with prefix-partitioned suffix trees over words (operator 9).

A window of SIZE words is removed where a document with a smaller id has it too. Windows that may repeat are sent to
groups by the gram that anchors them. In a group, each window begins a suffix of its passage. The suffixes are counted and split by
prefixes of variable length, a prefix growing word by word while more than GROUP suffixes share it, so that each part fits
in memory. Each part's suffix tree is built as the intervals of its sorted suffixes by the words that neighbours share.
Its internal nodes of depth SIZE or more are the maximal repeats: a suffix loses as many words as the deepest of
them is deep that a suffix of a smaller document is below as well.

Defined cases: null texts have no words; a null doc_id is neither smaller nor larger than any, so such rows lose nothing and remove
nothing; rows with equal doc_ids do not remove each other's words; of copies of a text the smallest id is judged against other texts, the others lose
all words of texts of SIZE words or more. Texts are read whole, in pieces where they are very long; other columns of docs are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.anchors import Passages, Words, repeated_ranges, with_ids
from quern.llm.common import arrow, raw, slices, stored

SIZE, GRAM = 13, 4
#: Suffixes in a part; a part's sorted suffixes are held as rows of words.
GROUP = 1 << 15


def settle(p: Passages):
    """Of passages with equal content, those of the smallest document go on; the windows of the others are repeats."""
    if not len(p.tid):
        e = np.zeros(0, np.int64)
        return e, (e, e, e)
    same = pc.dictionary_encode(pa.array(p.content, pa.large_binary())).indices.to_numpy().astype(np.int64)
    least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, p.doc)
    gone = p.doc > least[same]
    at, stay = np.flatnonzero(gone), np.flatnonzero(~gone)
    # rows given twice
    order = stay[np.lexsort((p.first[stay], p.tid[stay]))]
    twice = np.concatenate([[False], (p.tid[order][1:] == p.tid[order][:-1]) & (p.first[order][1:] == p.first[order][:-1])])
    return order[~twice], (p.tid[at], p.first[at], p.last[at] + SIZE)


def parts(words: np.ndarray, at: np.ndarray, own: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Suffixes by growing prefixes: parts of at most GROUP suffixes (start, owner), with the depth that all of a part share or 0 up."""
    if len(at) <= GROUP or depth == SIZE:
        yield at, own, depth
        return
    word = words[at + depth]
    order = np.argsort(word, kind="stable")
    cut = np.concatenate([[0], np.flatnonzero(np.diff(word[order])) + 1, [len(at)]])
    start = 0
    for k in range(1, len(cut)):
        if cut[k] - cut[k - 1] > GROUP:
            if cut[k - 1] > start:
                yield at[order[start : cut[k - 1]]], own[order[start : cut[k - 1]]], depth
            inside = order[cut[k - 1] : cut[k]]
            yield from parts(words, at[inside], own[inside], depth + 1)
            start = cut[k]
        elif cut[k] - start > GROUP:
            yield at[order[start : cut[k - 1]]], own[order[start : cut[k - 1]]], depth
            start = cut[k - 1]
    if len(at) > start:
        yield at[order[start:]], own[order[start:]], depth


def repeats(words: np.ndarray, at: np.ndarray, stop: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The suffix tree of a part, as the intervals of its sorted suffixes that share a prefix. For each suffix (from `at` to `stop`) the length of the longest
    prefix that it shares with a smaller document's suffix, if that is SIZE or more: the deepest node above it of that depth which
    such a suffix is below too. Else 0."""
    longest = int((stop - at).max())
    columns = at[:, None] + np.arange(longest + 1)
    # suffixes end in marks of their own, so that no two are equal
    letters = np.where(columns < stop[:, None], words[np.minimum(columns, len(words) - 1)], -1 - np.arange(len(at))[:, None])
    order = np.lexsort(letters.T[::-1])
    shared = (letters[order[1:]] != letters[order[:-1]]).argmax(axis=1)
    out = np.zeros(len(at), np.int64)
    docs = doc[order]
    for depth in np.unique(shared[shared >= SIZE]).tolist():  # internal nodes, from the root down
        node = np.concatenate([[0], np.cumsum(shared < depth)])
        least = np.minimum.reduceat(docs, np.flatnonzero(np.concatenate([[True], shared < depth])))
        out[order[docs > least[node]]] = depth
    return out


def solve(p: Passages):
    """Ranges of the maximal repeats of a group that a smaller document has too."""
    e = np.zeros(0, np.int64)
    if not len(p.tid):
        return e, e, e
    words = pc.dictionary_encode(pa.array(b"\n".join(p.content).split(), pa.large_binary())).indices.to_numpy().astype(np.int64)
    windows = p.last - p.first + 1
    base = np.concatenate([[0], np.cumsum(windows + SIZE - 1)[:-1]])
    own = np.repeat(np.arange(len(windows)), windows)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    hit_at, hit_own, hit_stop = [], [], []
    for at, mine, _ in parts(words, base[own] + nth, own, 0):
        if len(at) > 1:
            length = repeats(words, at, (base + windows + SIZE - 1)[mine], p.doc[mine])
            gone = length > 0
            hit_at.append(at[gone]), hit_own.append(mine[gone]), hit_stop.append((at + length)[gone])
    if not hit_at:
        return e, e, e
    at, mine, stop = np.concatenate(hit_at), np.concatenate(hit_own), np.concatenate(hit_stop)
    order = np.argsort(at)
    at, mine, stop = at[order], mine[order], stop[order]
    if not len(at):
        return e, e, e
    a = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (mine[1:] != mine[:-1])]))
    shift = (p.first - base)[mine[a]]
    return p.tid[mine[a]], at[a] + shift, np.maximum.reduceat(stop, a) + shift


def one_space(text: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, frozenset[int]]:
    """docs with sha (of its words joined by blanks), a stored row (doc_id, sha, n_words) for each, the texts' reps, and what with_ids() says of them."""
    words = one_space(F.coalesce(F.col("text").cast("string"), F.lit("")))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), words.alias("words"))
    n = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace(F.col("words"), F.lit(" "))) + 1).cast("long")
    keyed = plain.select("doc_id", "text", F.sha2("words", 256).alias("sha"))
    rows = stored(plain.select("doc_id", F.sha2("words", 256).alias("sha"), n.alias("n_words")), "rows")
    reps = rows.filter(f"doc_id is not null and n_words >= {SIZE}").groupBy("sha").agg(F.min("doc_id").alias("rep"))
    named, shared = with_ids(stored(reps, "reps"))
    return keyed, rows, named, shared


KEPT = "sha string, starts array<int>, stops array<int>, kept string"


def kept_texts(keyed: DataFrame, reps: DataFrame, ranges: DataFrame) -> DataFrame:
    """(sha, starts, stops, kept): the removed word ranges of each text that loses some, and its remaining words joined by blanks."""
    named = ranges.join(reps, "tid").select("rep", F.col("sha").alias("s"), "starts", "stops")
    texts = keyed.join(named, (F.col("doc_id") == F.col("rep")) & (F.col("sha") == F.col("s"))).select("text", "sha", "starts", "stops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            starts = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            stops = [np.frombuffer(x, np.int32) for x in batch.column(3).to_pylist()]
            kept = []
            for text, a, b in zip(raw(batch), starts, stops, strict=True):
                words = text.split()
                edges = [0, *(x for pair in zip(a.tolist(), b.tolist(), strict=True) for x in pair), len(words)]
                kept.append(b" ".join(w for i in range(0, len(edges), 2) for w in words[edges[i] : edges[i + 1]]).decode())
            columns = [batch.column(1), pa.array(starts, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32())), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["sha", "starts", "stops", "kept"])

    return arrow(texts, run, KEPT)


def deduplicated(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, sha, n_words), the texts' smallest documents (sha, rep, tid), and kept_texts() of the texts that lose words."""
    keyed, rows, reps, shared = prepared(docs)
    ranges = repeated_ranges(keyed, reps, Words(SIZE, GRAM), settle, solve, alone=False, shared=shared)
    return rows, reps, kept_texts(keyed, reps, ranges)
