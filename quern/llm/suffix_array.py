"""Suffix-array dedup with deep-shallow sorting over bytes (operator 8).

Each byte that lies in a SIZE-byte string which also starts anywhere else is removed. Windows that may repeat are
sent to groups by the gram that anchors them, so a group's passages all hold the same gram. There the suffixes after
the gram, and what stands before it read backwards, are sorted: multikey quicksort goes down to a shallow depth, and
what still agrees there goes into blind tries, which look at branching characters only and compare one whole
suffix for each insertion. The common prefixes of neighbours in both orders tell how far two passages agree to the left and to the
right of the gram, and so which of their windows are equal.

Defined cases: null texts are empty; texts shorter than SIZE bytes lose nothing; repeated rows and rows with null doc_ids are documents
like any other, so a text that comes twice and is long enough is removed from each of its rows. Texts are read whole, in pieces where they are very long;
other columns of docs are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.anchors import Bytes, Passages, repeated_ranges, with_ids
from quern.llm.common import arrow, raw, slices, stored

SIZE, GRAM = 200, 48
REST = SIZE - GRAM
#: Characters after which multikey quicksort hands over to blind tries.
SHALLOW = 8
#: Members up to which a group's pairs are looked at one by one.
PAIRS = 12


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings by the characters at which they part; a node is [depth, children by character, a leaf below]."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [len(s), {-1: [i]}, i]
            return
        node = self.root
        while True:  # blindly down, by branching characters
            c = s[node[0]] if node[0] < len(s) else -1
            below = node[1].get(c)
            if below is None or isinstance(below[0], int) and len(below) == 1 or c == -1:
                break
            node = below
        n = common(s, self.strings[node[2]])
        parent, node = None, self.root
        while node[0] < n:
            c = s[node[0]]
            below = node[1].get(c)
            if below is None:
                node[1][c] = [len(s), {-1: [i]}, i]
                return
            parent, node = (node, c), below
        if node[0] == n:
            c = s[n] if n < len(s) else -1
            if c == -1:
                node[1].setdefault(-1, []).append(i)
            elif c in node[1]:
                raise AssertionError("a common prefix longer than the one measured")
            else:
                node[1][c] = [len(s), {-1: [i]}, i]
            return
        other = self.strings[node[2]]
        fork = [n, {other[n]: node}, node[2]]
        if n < len(s):
            fork[1][s[n]] = [len(s), {-1: [i]}, i]
        else:
            fork[1][-1] = [i]
        if parent is None:
            self.root = fork
        else:
            parent[0][1][parent[1]] = fork

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            x = stack.pop()
            if x and isinstance(x[0], int) and len(x) == 3 and isinstance(x[1], dict):
                for c in sorted(x[1], reverse=True):
                    stack.append(x[1][c] if c != -1 else ("end", x[1][c]))
            else:
                out += x[1]
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """The order of strings; equal ones stand together."""
    out: list[int] = []
    work = [(list(range(len(strings))), 0)]
    while work:
        some, depth = work.pop()
        if len(some) == 1:
            out += some
        elif len(some) == 2:
            a, b = some
            out += [a, b] if strings[a] <= strings[b] else [b, a]
        elif depth >= SHALLOW:
            trie = BlindTrie(strings)
            for i in some:
                trie.insert(i)
            out += trie.order()
        else:
            at = [strings[i][depth] if depth < len(strings[i]) else -1 for i in some]
            pivot = sorted((at[0], at[len(at) // 2], at[-1]))[1]
            less = [i for i, c in zip(some, at, strict=True) if c < pivot]
            same = [i for i, c in zip(some, at, strict=True) if c == pivot]
            more = [i for i, c in zip(some, at, strict=True) if c > pivot]
            if more:
                work.append((more, depth))
            if pivot == -1:
                work += [([i], depth) for i in same]
            else:
                work.append((same, depth + 1))
            if less:
                work.append((less, depth))
    return out


def pair_ranges(left: list[bytes], right: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(member, least, most): how many characters before the gram a window may start that another member has too."""
    n = len(left)
    agree = {}
    for strings, k in ((left, 0), (right, 1)):
        order = deep_shallow(strings)
        near = [common(strings[a], strings[b]) for a, b in zip(order, order[1:])]  # noqa: B905
        for i in range(n):
            low = 1 << 30
            for j in range(i + 1, n):
                low = min(low, near[j - 1])
                agree[min(order[i], order[j]), max(order[i], order[j]), k] = low
    for i in range(n):
        for j in range(i + 1, n):
            most, least = agree[i, j, 0], REST - agree[i, j, 1]
            if most >= least:
                yield i, least, most
                yield j, least, most


def class_ranges(left: list[bytes], right: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """The same for many members: for each place of the gram in a window, members in the same class on both sides share the window."""
    n = len(left)
    orders, nears = [], []
    for strings in (left, right):
        order = deep_shallow(strings)
        orders.append(np.array(order))
        nears.append(np.array([1 << 30] + [common(strings[a], strings[b]) for a, b in zip(order, order[1:])]))  # noqa: B905
    block = max(1, (1 << 22) // n)
    shared = np.zeros((REST + 1, n), bool)
    for at in range(0, REST + 1, block):
        before = np.arange(at, min(at + block, REST + 1))
        cls = []
        for depth, order, near in zip((before, REST - before), orders, nears, strict=True):
            c = np.empty((len(before), n), np.int64)
            c[:, order] = np.cumsum(near[None, :] < depth[:, None], axis=1)
            cls.append(c)
        keys = (np.arange(len(before))[:, None] * (n + 1) + cls[0]) * (n + 1) + cls[1]
        _, inverse, counts = np.unique(keys.ravel(), return_inverse=True, return_counts=True)
        shared[at : at + len(before)] = (counts[inverse] > 1).reshape(keys.shape)
    edges = np.diff(np.concatenate([np.zeros((1, n), np.int8), shared.astype(np.int8), np.zeros((1, n), np.int8)]), axis=0)
    start, stop = np.nonzero(edges.T == 1), np.nonzero(edges.T == -1)
    yield from zip(start[0].tolist(), start[1].tolist(), (stop[1] - 1).tolist(), strict=True)


def settle(p: Passages):
    """Of passages with equal content at several places one goes on, and the windows of all are repeats."""
    e = np.zeros(0, np.int64)
    if not len(p.tid):
        return e, (e, e, e)
    same = pc.dictionary_encode(pa.array(p.content, pa.large_binary())).indices.to_numpy().astype(np.int64)
    order = np.lexsort((p.first, p.tid, same))
    tid, first, same = p.tid[order], p.first[order], same[order]
    again = np.concatenate([[False], (same[1:] == same[:-1]) & (tid[1:] == tid[:-1]) & (first[1:] == first[:-1])])
    order, same = order[~again], same[~again]
    head = np.concatenate([[True], same[1:] != same[:-1]])
    many = np.bincount(same)[same] > 1
    at = order[many]
    return order[head], (p.tid[at], p.first[at], p.last[at] + SIZE)


def solve(p: Passages):
    """Ranges of the windows that a group's passages share. All contents differ."""
    groups = defaultdict(list)
    for i, (c, a) in enumerate(zip(p.content, p.place.tolist(), strict=True)):
        groups[c[a : a + GRAM]].append(i)
    tids, starts, stops = [], [], []
    first, last, place, tid = p.first.tolist(), p.last.tolist(), p.place.tolist(), p.tid.tolist()
    for members in groups.values():
        if len(members) < 2:
            continue
        left = [p.content[i][: place[i]][::-1] for i in members]
        right = [p.content[i][place[i] + GRAM :] for i in members]
        for k, least, most in (pair_ranges if len(members) <= PAIRS else class_ranges)(left, right):
            i = members[k]
            # only windows that this gram anchors are in the passage
            least, most = max(least, place[i] - (last[i] - first[i])), min(most, place[i])
            if least <= most:
                tids.append(tid[i]), starts.append(first[i] + place[i] - most), stops.append(first[i] + place[i] - least + SIZE)
    return np.array(tids, np.int64), np.array(starts, np.int64), np.array(stops, np.int64)


def prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, frozenset[int]]:
    """docs with sha (of its text), a stored row (doc_id, sha, n_bytes) for each, the texts' reps with their numbers of rows, and what with_ids() says of them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    rows = stored(keyed.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "rows")
    reps = rows.filter(f"n_bytes >= {SIZE}").groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    named, shared = with_ids(stored(reps, "reps"))
    return keyed, rows, named, shared


KEPT = "sha string, starts array<int>, stops array<int>, kept binary"


def kept_texts(keyed: DataFrame, reps: DataFrame, ranges: DataFrame) -> DataFrame:
    """(sha, starts, stops, kept): the removed byte ranges of each text that loses some, and its remaining bytes."""
    named = ranges.join(reps.filter("copies = 1"), "tid").select("rep", F.col("sha").alias("s"), "starts", "stops")
    texts = keyed.join(named, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("sha") == F.col("s"))).select("text", "sha", "starts", "stops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            starts = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            stops = [np.frombuffer(x, np.int32) for x in batch.column(3).to_pylist()]
            kept = []
            for text, a, b in zip(raw(batch), starts, stops, strict=True):
                edges = [0, *(x for pair in zip(a.tolist(), b.tolist(), strict=True) for x in pair), len(text)]
                kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            columns = [batch.column(1), pa.array(starts, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32())), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["sha", "starts", "stops", "kept"])

    return arrow(texts, run, KEPT)


def deduplicated(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, sha, n_bytes), the texts (sha, rep, copies, tid), and kept_texts() of the texts that come once and lose bytes."""
    keyed, rows, reps, shared = prepared(docs)
    ranges = repeated_ranges(keyed, reps, Bytes(SIZE, GRAM), settle, solve, alone=True, shared=shared)
    return rows, reps, kept_texts(keyed, reps, ranges)
