"""Benchmark decontamination by a prefix-filtered set join (operator 7).

A window is 13 consecutive words of a benchmark item, or all of a shorter item. A document that contains a window
contains its rarest word; with full containment asked for, that one word is the whole necessary prefix of the
window's words in order of rarity. So the words of the benchmark are counted over all documents, each window is filed
under its rarest word, and a document's words meet only the windows filed under them. The place of the word in the
window bounds where the window must start and end (position and length filter), and what remains is compared word by
word.

The benchmark is the stated query set, held against all documents in blocks of bounded size. The driver holds one block at a time: its
windows are broadcast as arrays, whose size is bounded by that of the block's text and checked, and taken back when its pass is over. A larger
benchmark takes more passes over the documents, which are then written once with a number for each row; each pass
writes the hits of rows by that number, and only these are shuffled. With one block documents are only scanned. The rule is the same
for any number of blocks: each row is judged by its own hits.

Defined cases: null texts have no words; an item without words has no windows; repeated items are reported
by their distinct ids; null item_ids are never reported, though their words are hit; an empty benchmark hits nothing, and empty documents
give no rows; repeated rows of docs, and rows with equal or null doc_ids, are judged one by one; a document at exactly one word in `share` is
contaminated. Texts and items are read whole, whatever their length: a long item is cut into parts that overlap by a window less a word, under one id.
Other columns of docs, whatever their names, pass through clean() and are ignored elsewhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow, quoted, raw, slices, stored

WINDOW = 13
#: Bytes of benchmark text in a block, and of its arrays and words for each byte of text at most.
BLOCK_BYTES, TIMES = 4 << 20, 40
#: Meetings of words and windows that are looked at together.
MEETINGS = 1 << 20
#: Every byte that is no part of a word becomes a blank, and A-Z are lowered. Bytes from 0x80 on belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

Items = list[tuple[int | None, bytes]]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Windows:
    """A block's windows: words by number, the items' words, and for each window (sorted by its rarest word) where its words start, how
    many there are, the rarest word's place among them, and its items. `first` tells where a word's windows begin."""

    words: dict[bytes, int]
    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    place: np.ndarray
    first: np.ndarray
    owner_first: np.ndarray
    owners: np.ndarray

    def bytes(self) -> int:
        return sum(getattr(self, f).nbytes for f in ("text", "start", "size", "place", "first", "owner_first", "owners")) + sum(len(w) + 100 for w in self.words)


def filed(items: Items, counts: dict[bytes, int], size: int) -> Windows:
    """The distinct windows of a block's items, filed by their rarest word."""
    split = [words_of(t) for _, t in items]
    words = {w: k for k, w in enumerate(sorted({w for ws in split for w in ws}))}
    text = np.array([words[w] for ws in split for w in ws], np.int32)
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((np.arange(len(words)), [counts.get(w, 0) for w in words]))] = np.arange(len(words))
    begin = np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)
    by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
    for k, ws in enumerate(split):
        if ws:
            n = min(size, len(ws))
            by_size.setdefault(n, []).append((np.arange(begin[k], begin[k + 1] - n + 1), k))
    starts, sizes, places, rarest, owned = [], [], [], [], []
    for n, parts in by_size.items():
        at = np.concatenate([a for a, _ in parts])
        item = np.concatenate([np.full(len(a), k) for a, k in parts])
        rows = text[at[:, None] + np.arange(n)]
        _, head, same = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        mine = rank[rows[head]]
        place = mine.argmin(axis=1)
        base = sum(map(len, starts))
        starts.append(at[head]), sizes.append(np.full(len(head), n)), places.append(place)
        rarest.append(rows[head][np.arange(len(head)), place])
        owned.append(np.stack([same.ravel() + base, item]))
    if not starts:
        e = np.zeros(0, np.int64)
        return Windows(words, text, e, e, e, np.zeros(1, np.int64), np.zeros(1, np.int64), e)
    rare = np.concatenate(rarest)
    order = np.argsort(rare, kind="stable")
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(len(order))
    ids = np.array([0 if i is None else i for i, _ in items], np.int64)
    window, item = np.concatenate(owned, axis=1)
    known = np.array([i is not None for i, _ in items])[item]
    pairs = np.unique(np.stack([new[window[known]], ids[item[known]]]), axis=1)
    return Windows(
        words,
        text,
        np.concatenate(starts)[order],
        np.concatenate(sizes)[order].astype(np.int16),
        np.concatenate(places)[order].astype(np.int16),
        np.searchsorted(rare[order], np.arange(len(words) + 1)),
        np.searchsorted(pairs[0], np.arange(len(order) + 1)),
        pairs[1],
    )


@dataclass
class Hits:
    """Of a slice of texts: numbers of words, which words are hit (of all texts, one after the other), and each text's items."""

    n_words: np.ndarray
    covered: np.ndarray
    items: dict[int, set[int]]

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.n_words)])

    def n_hit(self) -> np.ndarray:
        done = np.concatenate([[0], np.cumsum(self.covered)])
        return done[self.starts[1:]] - done[self.starts[:-1]]

    def ranges(self) -> list[list[dict]]:
        """Hit words as ranges (end exclusive) for each text."""
        out: list[list[dict]] = [[] for _ in self.n_words]
        for k in np.flatnonzero(self.n_hit()).tolist():
            at = self.starts[k]
            mine = np.diff(np.concatenate([[0], self.covered[at : self.starts[k + 1]].astype(np.int8), [0]]))
            out[k] = [{"start": a, "stop": b} for a, b in zip(np.flatnonzero(mine == 1).tolist(), np.flatnonzero(mine == -1).tolist(), strict=True)]
        return out


def found_in(texts: list[bytes], w: Windows) -> Hits:
    """What a block's windows hit in texts."""
    split = [words_of(t) for t in texts]
    n_words = np.array([len(x) for x in split], np.int64)
    out = Hits(n_words, np.zeros(int(n_words.sum()), bool), {})
    if not len(w.start) or not len(out.covered):
        return out
    number = w.words.get
    ids = np.fromiter((number(x, -1) for ws in split for x in ws), np.int32, len(out.covered))
    many = np.diff(w.first)
    at = np.flatnonzero((ids >= 0) & (many[ids] > 0))
    edges = np.zeros(len(ids) + 1, np.int64)
    text_of = np.searchsorted(out.starts, at, side="right") - 1
    low, high = out.starts[text_of], out.starts[text_of + 1]
    meet = np.concatenate([[0], np.cumsum(many[ids[at]])])
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(meet, meet[a] + MEETINGS, side="right")) - 1)
        each = many[ids[at[a:b]]]
        one = np.repeat(np.arange(a, b), each)
        window = np.arange(len(one)) - np.repeat(np.cumsum(each) - each, each) + w.first[ids[at[one]]]
        start = at[one] - w.place[window]
        stop = start + w.size[window]
        good = np.flatnonzero((start >= low[one]) & (stop <= high[one]))
        for j in range(int(w.size.max())):
            mine = window[good]
            longer = w.size[mine] > j
            same = ~longer
            same[longer] = ids[start[good[longer]] + j] == w.text[w.start[mine[longer]] + j]
            good = good[same]
        np.add.at(edges, start[good], 1), np.add.at(edges, stop[good], -1)
        for k, v in np.unique(np.stack([text_of[one[good]], window[good]]), axis=1).T.tolist() if len(good) else ():
            out.items.setdefault(k, set()).update(w.owners[w.owner_first[v] : w.owner_first[v + 1]].tolist())
        a = b
    out.covered = np.cumsum(edges[:-1]) > 0
    return out


def blocks(benchmark: DataFrame, size: int, block_bytes: int) -> Iterator[Items]:
    """The benchmark's items, so many bytes at a time. The driver holds one part of them that is as large on average, or one item that is larger."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k) if n > 1 else items
        held, used = [], 0
        for row in part.collect():
            for piece in pieces(row.text.encode(), size, block_bytes):
                if held and used + len(piece) + 16 > block_bytes:
                    yield held
                    held, used = [], 0
                held.append((row.item_id, piece))
                used += len(piece) + 16
        if held:
            yield held


def pieces(text: bytes, size: int, most: int) -> Iterator[bytes]:
    """A long text in parts in which each window is whole."""
    if len(text) <= most:
        yield text
        return
    words = words_of(text)
    step = max(1, most // (2 * (max(map(len, words), default=1) + 1)) - size)
    for i in range(0, max(1, len(words) - size + 1), step):
        yield b" ".join(words[i : i + step + size - 1])


def word_counts(docs: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How often each wanted word occurs over all documents. Only wanted words are counted, so the result is bounded by the block."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches):
            words = Counter(w for t in raw(batch) for w in words_of(t))
            total.update({w: words[w] for w in words.keys() & shared.value})
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    found = arrow(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = {bytes(r.word): r.n for r in found.collect()}
    shared.destroy()
    return out


def ready(docs: DataFrame, items: Items, size: int):
    """The broadcast windows of a block, by the counts of its words in docs(text)."""
    windows = filed(items, word_counts(docs, {w for _, t in items for w in words_of(t)}), size)
    if windows.bytes() > TIMES * (sum(len(t) for _, t in items) + 1024):
        raise ValueError("a block's windows are larger than its text allows")
    return docs.sparkSession.sparkContext.broadcast(windows)


RANGES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
MARKS = "n_words long, ranges array<struct<start:int,stop:int>>, items array<long>"
SCHEMA = f"doc_id long, {MARKS}"


def marked(rows: DataFrame, shared, key: str, hit_only: bool = False) -> DataFrame:
    """rows(key, text) -> key and the columns of MARKS by one block's windows; with hit_only, the rows that are hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hits = found_in(raw(batch), shared.value)
            ids = pa.array([sorted(hits.items.get(k, ())) for k in range(batch.num_rows)], pa.list_(pa.int64()))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits.n_words), pa.array(hits.ranges(), RANGES), ids], names=[key, "n_words", "ranges", "items"])
            yield out.filter(pa.array(hits.n_hit() > 0)) if hit_only else out

    return arrow(rows.select(key, "text"), run, f"{key} long, {MARKS}")


def several(rows: DataFrame, first: list[Items], rest: Iterator[Items], size: int) -> DataFrame:
    """Marks of the hit rows of a written table rows(row, text) by several blocks: row, ranges (merged) and items."""
    passes = []
    for items in (*first, *rest):
        shared = ready(rows, items, size)
        passes.append(stored(marked(rows, shared, "row", True), "block"))
        shared.destroy()
    every = passes[0]
    for one in passes[1:]:
        every = every.unionByName(one)
    sets = every.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = [union([(r["start"], r["stop"]) for r in row]) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"start": a, "stop": b} for a, b in m] for m in merged], RANGES), batch.column(2)], names=["row", "ranges", "items"])

    return arrow(sets, run, "row long, ranges array<struct<start:int,stop:int>>, items array<long>")


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """docs, written, with a number for each row."""
    return stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def marks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of docs(doc_id, text): its number of words, the ranges of words inside occurring windows (merged,
    end exclusive) and the ids of the items whose windows occur, in ascending order."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = blocks(benchmark, size, block_bytes)
    one, two = next(found, []), next(found, None)
    if two is None:
        return marked(plain, ready(plain, one, size), "doc_id")
    rows = numbered(plain)
    hits = several(rows, [one, two], found, size)
    counted = arrow(rows.select("row", "doc_id", "text"), counts_of, "row long, doc_id long, n_words long")
    joined = counted.join(hits, "row", "left")
    none = F.array().cast
    return joined.select("doc_id", "n_words", F.coalesce("ranges", none("array<struct<start:int,stop:int>>")).alias("ranges"), F.coalesce("items", none("array<long>")).alias("items"))


def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n = pa.array([len(words_of(t)) for t in raw(batch)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["row", "doc_id", "n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """marks() with n_hit, n_items and the verdict: contaminated if at least one word in `share` is hit."""
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, x: acc + x["stop"] - x["start"])
    out = marks(docs, benchmark, size, block_bytes).withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    found = blocks(benchmark, size, block_bytes)
    one, two = next(found, []), next(found, None)
    if two is None:
        shared = ready(docs.select(F.col("text").cast("string").alias("text")), one, size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                n = (hits := found_in(raw(batch), shared.value)).n_hit()
                yield batch.filter(pa.array((n == 0) | (n * share < hits.n_words)))

        return arrow(docs, run, docs.schema)
    packed = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*quoted(docs.columns)).alias("of")), "numbered")
    hits = several(packed.select("row", F.col("of.text").cast("string").alias("text")), [one, two], found, size)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, x: acc + x["stop"] - x["start"])
    counted = arrow(packed.select("row", F.lit(None).cast("long").alias("doc_id"), F.col("of.text").cast("string").alias("text")), counts_of, "row long, doc_id long, n_words long")
    bad = counted.join(hits.select("row", n_hit.alias("n_hit")), "row").filter((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
    return packed.join(bad.select("row"), "row", "left_anti").select(*(F.col("of")[c].alias(c) for c in docs.columns))
