"""Repeated windows across a corpus: the frame that the suffix operators 8 and 9 share.

A window is a run of so many units (words or bytes). Its anchor is the gram with the smallest hash among the grams of
a few units in it, so equal windows have equal anchors at equal places, and neighbouring windows mostly share theirs.
The frame finds anchors whose gram occurs in another text (or at another place), sends the passages around these to one group for each
gram, where the operator's suffix structure tells which windows really repeat, and sends the repeated ranges back to the texts.

Texts are named by a hash, so exact copies are handled once. Anchors, passages and ranges travel packed: a row holds
the arrays of one slice of documents for one bucket of grams. What is settled within a slice, such as the many copies
of a hot passage, is settled there and only one of them goes on, so a hot gram adds a few entries a slice.
The grams' hashes only choose candidates: windows are compared by content.

A group whose passages still exceed HOLD_BYTES then (a line or the edge of a passage that very many otherwise different texts share) is taken apart: its
windows, named by 128 bits of a hash of their content, are settled chunk by chunk and dealt anew by these names, so that no task holds the
group, whatever its size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow, input_bytes, raw, slices, stored

BASE, GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PLACE_BITS = 24  # of a value in the search for the smallest hash; the rest is hash
SLICE = 1 << 20
PIECE = 2 << 20
SHARED_MOST = 100_000
BUCKET_BYTES = 2 << 20


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def running_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width` neighbours, from minima to the left and right within blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


@dataclass
class Runs:
    """Runs of neighbouring windows with one anchor: text number, first and last window, the gram's hash and place, and the bytes they cover."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray
    place: np.ndarray
    start: np.ndarray
    stop: np.ndarray

    def take(self, at: np.ndarray) -> Runs:
        return Runs(*(getattr(self, f)[at] for f in self.__dataclass_fields__))


class Units:
    """Windows of `size` units with anchors of `gram` units."""

    def __init__(self, size: int, gram: int):
        self.size, self.gram = size, gram

    def name(self, text: bytes) -> bytes:
        """What texts that count as equal have in common."""
        raise NotImplementedError

    def hashed(self, data: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each unit: hash, text number, first and last byte (exclusive)."""
        raise NotImplementedError

    def cut(self, content: bytes) -> list[bytes]:
        """The windows of a passage, one after the other, such that equal windows are equal bytes."""
        raise NotImplementedError

    def pieces(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Cuts a very long text into pieces (units before, bytes before, bytes) such that each window is whole in exactly one."""
        raise NotImplementedError

    def runs(self, texts: list[bytes]) -> Runs:
        short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
        parts = [self._runs([texts[i] for i in short], np.array(short, np.int64))] if short else []
        for i, text in enumerate(texts):
            if len(text) > PIECE:
                for units, at, piece in self.pieces(text):
                    r = self._runs([piece], np.array([i], np.int64))
                    r.first, r.last, r.start, r.stop, r.place = r.first + units, r.last + units, r.start + at, r.stop + at, r.place + units
                    parts.append(r)
        every = Runs(*(np.concatenate([getattr(p, f) for p in parts]) for f in Runs.__dataclass_fields__))
        # those of long texts come after the others'; each text's runs stand together
        return every.take(np.argsort(every.text, kind="stable"))

    def _runs(self, texts: list[bytes], numbers: np.ndarray) -> Runs:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        unit, owner, begin, end = self.hashed(data, starts)
        n = len(unit) - self.size + 1
        if n <= 0:
            e = np.zeros(0, np.int64)
            return Runs(e, e, e, e.view(np.uint64), e, e, e)
        gram = self.grams(unit)
        low = np.uint64((1 << PLACE_BITS) - 1)
        values = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        place = (running_min(values, self.size - self.gram + 1) & low).astype(np.int64)
        good = np.flatnonzero(owner[:n] == owner[self.size - 1 :])
        place = place[good]
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        a, b = np.concatenate([[0], cut])[: len(good)], np.concatenate([cut, [len(good)]])[: len(good)] - 1
        first, last, place = good[a], good[b], place[a]
        text = owner[first]
        zero = np.searchsorted(owner, np.arange(len(texts)))  # first unit of each text
        return Runs(numbers[text], first - zero[text], last - zero[text], gram[place], place - zero[text], begin[first] - starts[text], end[last + self.size - 1] - starts[text])

    def grams(self, unit: np.ndarray) -> np.ndarray:
        out = unit[: len(unit) - self.gram + 1].copy()
        for j in range(1, self.gram):
            out = out * GRAM + unit[j : len(unit) - self.gram + 1 + j]
        return mixed(out)


class Words(Units):
    def name(self, text: bytes) -> bytes:
        return b" ".join(text.split())

    def cut(self, content):
        words = content.split()
        return [b" ".join(words[i : i + self.size]) for i in range(len(words) - self.size + 1)]

    def hashed(self, data, text_starts):
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        edge = np.concatenate([[0], edge]) if not blank[0] else edge
        begin, end = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), BASE), dtype=np.uint64)])
        back = powers(len(data), np.uint64(pow(int(BASE), -1, 1 << 64)))
        unit = mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
        return unit, np.searchsorted(text_starts, begin, side="right") - 1, begin, end

    def pieces(self, text):
        word = re.compile(rb"[^\x20\x09-\x0D]+")
        at = units = 0
        while at < len(text):
            gap = re.compile(rb"[\x20\x09-\x0D]").search(text, at + PIECE)
            if not gap:
                yield units, at, text[at:]
                return
            stop, tail = gap.start(), gap.start()
            for k, m in enumerate(word.finditer(text, stop)):
                if k == self.size - 1:
                    break
                tail = m.end()
            yield units, at, text[at:tail]
            units += len(text[at:stop].split())
            at = stop


class Bytes(Units):
    def name(self, text: bytes) -> bytes:
        return text

    def cut(self, content):
        return [content[i : i + self.size] for i in range(len(content) - self.size + 1)]

    def hashed(self, data, text_starts):
        n = len(data)
        # the line ends that join texts belong to the text before, but no window may hold one: they get owners of their own
        owner = np.repeat(np.arange(len(text_starts)), np.diff(np.concatenate([text_starts, [n]])))
        at = np.arange(n)
        return data, owner, at, at + 1

    def grams(self, unit):
        m, n = self.gram, len(unit)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((unit.astype(np.uint64) + np.uint64(1)) * powers(n, BASE), dtype=np.uint64)])
        return mixed((sums[m:] - sums[:-m]) * powers(n - m + 1, np.uint64(pow(int(BASE), -1, 1 << 64))))

    def _runs(self, texts, numbers):
        r = super()._runs(texts, numbers)
        sizes = np.zeros(int(numbers.max()) + 1, np.int64)
        sizes[numbers] = [len(t) for t in texts]
        # the last window of a text would hold the line end after it
        keep = r.first <= sizes[r.text] - self.size
        r = r.take(np.flatnonzero(keep))
        r.last = np.minimum(r.last, sizes[r.text] - self.size)
        r.stop = r.last + self.size
        return r

    def pieces(self, text):
        for at in range(0, max(1, len(text) - self.size + 1), PIECE):
            yield at, at, text[at : at + PIECE + self.size - 1]


def text_ids(units: Units, texts: list[bytes], shared: frozenset[int] = frozenset()) -> np.ndarray:
    """64-bit names of texts: the start of their SHA-256, or its next 64 bits where several texts share the start."""
    both = np.frombuffer(b"".join(hashlib.sha256(units.name(t)).digest()[:16] for t in texts), ">i8").astype(np.int64).reshape(-1, 2)
    return np.where(np.isin(both[:, 0], list(shared)), both[:, 1], both[:, 0]) if shared else both[:, 0]


def with_ids(reps: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """reps(sha, ...) with tid, the same names from hex digests, and the starts that several texts share. Among 10^10 texts that is
    a handful; they come to the driver only after counting."""
    long = lambda at: F.conv(F.substring("sha", at, 16), 16, -10).cast("long")
    plain = reps.withColumn("tid", long(1))
    twice = stored(plain.groupBy("tid").count().filter("count > 1").select("tid"), "shared-ids")
    if twice.limit(SHARED_MOST + 1).count() > SHARED_MOST:
        raise ValueError("too many texts share 64-bit names")
    shared = frozenset(r.tid for r in twice.collect())
    return plain.withColumn("tid", F.when(F.col("tid").isin(list(shared)), long(17)).otherwise(F.col("tid"))) if shared else plain, shared


def bucketed(keys: np.ndarray, n: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Parts of columns by bucket of key."""
    bucket = (mixed(keys.view(np.uint64)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(bucket[part[0]]), [c[part] for c in columns]


def packed(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows sorted by their first column, grouped by it; rows are read as they come."""
    parts = (batch.slice(i, 256) for batch in batches for i in range(0, batch.num_rows, 256))
    rows = (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns)))  # noqa: B905
    for key, group in groupby(rows, key=lambda r: r[0]):
        yield key, group


def together(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket")


def entries(tid: np.ndarray, gram: np.ndarray, place: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """(tid, gram) by gram and text, one for each pair; with alone, two where a text has the gram at several places."""
    order = np.lexsort((place, tid, gram))
    tid, gram, place = tid[order], gram[order], place[order]
    new = np.ones(len(tid), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (tid[1:] != tid[:-1])
    if alone:
        # runs on both sides of a cut between pieces can have one anchor, which is one place
        fresh = new.copy()
        fresh[1:] |= place[1:] != place[:-1]
        tid, gram, new = tid[fresh], gram[fresh], new[fresh]
        # a second place counts as a second entry, one is enough
        new[1:] |= new[:-1]
    return tid[new], gram[new]


ANCHORS = pa.schema([("bucket", pa.int64()), ("settled", pa.bool_()), ("tids", pa.binary()), ("grams", pa.binary())])
LISTED = pa.schema([("tid", pa.int64()), ("grams", pa.binary())])


def candidates(docs: DataFrame, units: Units, alone: bool, shared: frozenset[int] = frozenset()) -> DataFrame:
    """(tid, grams): for each text the hashes of its anchors that other texts have too; with alone also those it has at two places itself."""
    n = buckets(docs)
    most = slice_bytes(n)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=most):
            texts = list(set(raw(batch)))
            tids = text_ids(units, texts, shared)
            # the same text under other white space is the same
            runs = units.runs(texts)
            tid, gram = tids[runs.text], runs.gram
            tid, gram = entries(tid, gram, runs.place, alone)
            first = np.concatenate([[True], gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, bool)
            rank = np.arange(len(gram)) - np.maximum.accumulate(np.where(first, np.arange(len(gram)), 0)) if len(gram) else first
            go, settled = rank < 2, rank >= 2
            rows = [(b, False, t.tobytes(), g.tobytes()) for b, (t, g) in bucketed(gram[go], n, [tid[go], gram[go]])]
            rows += [(b, True, t.tobytes(), g.tobytes()) for b, (t, g) in bucketed(tid[settled], n, [tid[settled], gram[settled]])]
            yield from packed(rows, ANCHORS)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_bucket(batches):
            rows, tids, grams = [], [], []
            for b, settled, t, g in group:
                if settled:
                    rows.append((b, True, t, g))
                    if len(rows) >= 64:
                        yield from packed(rows, ANCHORS)
                        rows = []
                else:
                    tids.append(np.frombuffer(t, np.int64)), grams.append(np.frombuffer(g, np.uint64))
            if tids:
                tid, gram = np.concatenate(tids), np.concatenate(grams)
                order = np.argsort(gram, kind="stable")
                tid, gram = tid[order], gram[order]
                cut = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                many = np.maximum.reduceat(tid, cut) != np.minimum.reduceat(tid, cut)
                if alone:
                    # equal entries are two places in one text or copies in several slices; passages tell which
                    many |= np.diff(np.concatenate([cut, [len(gram)]])) > 1
                hit = np.repeat(many, np.diff(np.concatenate([cut, [len(gram)]])))
                rows += [(b, True, t.tobytes(), g.tobytes()) for b, (t, g) in bucketed(tid[hit], n, [tid[hit], gram[hit]])]
            yield from packed(rows, ANCHORS)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_bucket(batches):
            both = [(np.frombuffer(t, np.int64), np.frombuffer(g, np.uint64)) for _, _, t, g in group]
            tid, gram = (np.concatenate(x) for x in zip(*both))  # noqa: B905
            order = np.lexsort((gram, tid))
            tid, gram = tid[order], gram[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(tid)) + 1, [len(tid)]])
            yield from packed([(int(tid[a]), np.unique(gram[a:b]).tobytes()) for a, b in zip(cut, cut[1:])], LISTED)  # noqa: B905

    kind = "bucket long, settled boolean, tids binary, grams binary"
    found = arrow(together(arrow(docs.select("text"), find, kind)), repeated, kind)
    return arrow(together(found), gathered, "tid long, grams binary")


def buckets(docs: DataFrame) -> int:
    return int(min(1 << 21, max(128, input_bytes(docs) // BUCKET_BYTES)))


def slice_bytes(n_buckets: int) -> int:
    """Larger slices for more buckets, so that a slice has enough for each; up to 8 MB."""
    return min(8 << 20, max(SLICE, 32 * n_buckets))


PASSAGES = pa.schema([("bucket", pa.int64()), ("done", pa.bool_()), ("tids", pa.binary()), ("ids", pa.binary()), ("first", pa.binary()), ("last", pa.binary()), ("place", pa.binary()), ("sizes", pa.binary()), ("content", pa.binary()), ("grams", pa.binary())])
PASSAGE_DDL = "bucket long, done boolean, tids binary, ids binary, first binary, last binary, place binary, sizes binary, content binary, grams binary"


@dataclass
class Passages:
    """Passages of one bucket: text, the text's smallest doc_id, windows, place of the anchor (in units from the first window), gram, content."""

    tid: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    gram: np.ndarray
    content: list[bytes]

    def row(self, bucket: int) -> tuple:
        sizes = np.array([len(c) for c in self.content], np.int32)
        return (bucket, False, self.tid.tobytes(), self.doc.tobytes(), self.first.astype(np.int32).tobytes(), self.last.astype(np.int32).tobytes(), self.place.astype(np.int32).tobytes(), sizes.tobytes(), b"".join(self.content), self.gram.tobytes())

    @classmethod
    def read(cls, rows: list[tuple]) -> Passages:
        cols = list(zip(*rows))  # noqa: B905
        ints = lambda k, t: np.concatenate([np.frombuffer(x, t) for x in cols[k]]).astype(np.uint64 if t is np.uint64 else np.int64)
        sizes = ints(7, np.int32)
        whole, ends = b"".join(cols[8]), np.cumsum(sizes)
        content = [whole[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]  # noqa: B905
        return cls(ints(2, np.int64), ints(3, np.int64), ints(4, np.int32), ints(5, np.int32), ints(6, np.int32), ints(9, np.uint64), content)

    def take(self, at: np.ndarray) -> Passages:
        return Passages(*(getattr(self, f)[at] for f in ("tid", "doc", "first", "last", "place", "gram")), [self.content[i] for i in at.tolist()])


def spans_row(n: int, tid: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[tuple]:
    """Ranges of texts, packed by bucket of the text; the other columns stay empty."""
    return [(b, True, t.tobytes(), b"", s.astype(np.int32).tobytes(), e.astype(np.int32).tobytes(), b"", b"", b"", b"") for b, (t, s, e) in bucketed(tid, n, [tid, start, stop])]


#: What an operator says of passages with equal content: (those that go on, ranges that are settled).
Settle = Callable[[Passages], tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]
#: What it finds in a group: ranges (tid, start, stop).
Solve = Callable[[Passages], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: Content bytes of a bucket after which equal passages are settled again, and beyond which what is left is taken apart.
HOLD_BYTES = 16 << 20


@dataclass
class Named:
    """Windows by the names of their contents: name, text, the text's smallest doc_id, place, and whether it is known to repeat."""

    name: np.ndarray  # (n, 2)
    tid: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, p: Passages, units: Units) -> Named:
        digest = xxhash.xxh3_128_digest
        names = np.frombuffer(b"".join(digest(w) for c in p.content for w in units.cut(c)), np.uint64).reshape(-1, 2)
        n = p.last - p.first + 1
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(p.first, n)
        return cls(names, np.repeat(p.tid, n), np.repeat(p.doc, n), at, np.zeros(len(at), bool))

    @classmethod
    def read(cls, rows: list[tuple]) -> Named:
        join = lambda k, t: np.concatenate([np.frombuffer(r[k], t) for r in rows])
        return cls(join(8, np.uint64).reshape(-1, 2), join(2, np.int64), join(3, np.int64), join(4, np.int32).astype(np.int64), join(5, np.int32) > 0)

    def rows(self, n: int) -> list[tuple]:
        parts = bucketed(self.name[:, 0], n, [self.name, self.tid, self.doc, self.at, self.known])
        return [(b, False, t.tobytes(), d.tobytes(), a.astype(np.int32).tobytes(), k.astype(np.int32).tobytes(), b"", b"", name.tobytes(), b"") for b, (name, t, d, a, k) in parts]

    def settled(self, alone: bool) -> tuple[Named, np.ndarray]:
        """What goes on, and which windows are found to repeat: with alone all of a name that has several places, of which one goes on; else
        those of larger documents than the smallest, whose windows go on."""
        if not len(self.at):
            return self, np.zeros(0, np.int64)
        same = np.unique(self.name, axis=0, return_inverse=True)[1].ravel()
        if not alone:
            least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, same, self.doc)
            gone = self.doc > least[same]
            return self.take(np.flatnonzero(~gone)), np.flatnonzero(gone)
        many = (np.bincount(same) > 1) | (np.bincount(same, self.known) > 0)
        out = self.take(np.unique(same, return_index=True)[1])
        out.known = many
        return out, np.flatnonzero(many[same] & ~self.known)

    def take(self, at: np.ndarray) -> Named:
        return Named(self.name[at], self.tid[at], self.doc[at], self.at[at], self.known[at])


def repeated_ranges(docs: DataFrame, reps: DataFrame, units: Units, settle: Settle, solve: Solve, alone: bool, shared: frozenset[int] = frozenset()) -> DataFrame:
    """(sha, starts, stops): for each text the merged ranges of units that repeated windows cover.

    docs(doc_id, text, sha) has all rows; reps(sha, tid, rep) names one row of each text."""
    n = buckets(docs)
    most = slice_bytes(n)
    listed = candidates(docs, units, alone, shared)
    hold = HOLD_BYTES
    wanted = listed.join(reps.select("sha", "tid", "rep"), "tid").select("tid", F.col("rep").alias("r"), F.col("sha").alias("s"), "grams")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("r")) & (F.col("sha") == F.col("s"))).select("text", "tid", "r", "grams")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=most):
            rows = raw(batch)
            tids = batch.column(1).to_numpy(zero_copy_only=False)
            docs_ = np.array([-1 if x is None else x for x in batch.column(2).to_pylist()], np.int64)
            runs = units.runs(rows)
            grams = [np.frombuffer(g, np.uint64) for g in batch.column(3).to_pylist()]
            # (text, gram) pairs that repeat, by binary search in each text's list
            keep = np.zeros(len(runs.gram), bool)
            edge = np.searchsorted(runs.text, np.arange(len(rows) + 1))
            for i, g in enumerate(grams):
                a, b = edge[i], edge[i + 1]
                at = np.minimum(np.searchsorted(g, runs.gram[a:b]), len(g) - 1)
                keep[a:b] = g[at] == runs.gram[a:b]
            runs = runs.take(np.flatnonzero(keep))
            content = [rows[t][a:b] for t, a, b in zip(runs.text.tolist(), runs.start.tolist(), runs.stop.tolist())]  # noqa: B905
            every = Passages(tids[runs.text], docs_[runs.text], runs.first, runs.last, runs.place - runs.first, runs.gram, content)
            go, known = settle(every)
            out = spans_row(n, *known)
            for b, (at,) in bucketed(every.gram[go], n, [go]):
                out.append(every.take(at).row(b))
            yield from packed(out, PASSAGES)

    def apart(every: Passages) -> Iterator[pa.RecordBatch]:
        """Windows of a part of a large group: those that repeat in the part are told, and what goes on."""
        named = Named.of(every, units)
        go, hit = named.settled(alone)
        yield from packed(spans_row(n, named.tid[hit], named.at[hit], named.at[hit] + units.size), PASSAGES)
        yield from packed(go.rows(n), PASSAGES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, group in by_bucket(batches):
            held, size, most_held, large = [], 0, hold, False
            for row in group:
                if row[1]:
                    yield from packed([row], PASSAGES)
                    continue
                held.append(row)
                size += len(row[8])
                if size > most_held:
                    every = Passages.read(held)
                    go, known = settle(every)
                    yield from packed(spans_row(n, *known), PASSAGES)
                    every = every.take(go)
                    size = sum(map(len, every.content))
                    # each time at least as much is new as is held, so the time is linear
                    large = large or size > hold
                    if large:
                        yield from apart(every)
                        held, size = [], 0
                    else:
                        held, most_held = [every.row(b)], size + hold
            if held:
                every = Passages.read(held)
                go, known = settle(every)
                yield from packed(spans_row(n, *known), PASSAGES)
                every = every.take(go)
                if large:
                    yield from apart(every)
                else:
                    yield from packed(spans_row(n, *solve(every)), PASSAGES)

    def by_name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_bucket(batches):
            held, size, most_held = [], 0, hold
            for row in group:
                held.append(row)
                size += len(row[8])
                if size > most_held:
                    named = Named.read(held)
                    go, hit = named.settled(alone)
                    yield from packed(spans_row(n, named.tid[hit], named.at[hit], named.at[hit] + units.size), PASSAGES)
                    held = [r for r in go.rows(1)]
                    size = 16 * len(go.at)
                    most_held = size + hold
            named = Named.read(held)
            hit = named.settled(alone)[1]
            yield from packed(spans_row(n, named.tid[hit], named.at[hit], named.at[hit] + units.size), PASSAGES)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tid", pa.int64()), ("starts", pa.binary()), ("stops", pa.binary())])
        for _, group in by_bucket(batches):
            rows = [(r[2], r[4], r[5]) for r in group]
            tid = np.concatenate([np.frombuffer(r[0], np.int64) for r in rows])
            start, stop = (np.concatenate([np.frombuffer(r[k], np.int32) for r in rows]).astype(np.int64) for k in (1, 2))
            order = np.lexsort((start, tid))
            tid, start, stop = tid[order], start[order], stop[order]
            # the furthest end so far within a text tells where a new range begins
            place = np.concatenate([[0], np.cumsum(tid[1:] != tid[:-1])])
            lift = place * (int(stop.max()) + 1)
            far = np.maximum.accumulate(stop + lift)
            new = np.concatenate([[True], start[1:] + lift[1:] > far[:-1]])
            at = np.flatnonzero(new)
            start, stop, tid = start[at], (far - lift)[np.concatenate([at[1:] - 1, [len(far) - 1]])], tid[at]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(tid)) + 1, [len(tid)]])
            yield from packed([(int(tid[a]), start[a:b].astype(np.int32).tobytes(), stop[a:b].astype(np.int32).tobytes()) for a, b in zip(cuts, cuts[1:])], schema)  # noqa: B905

    passages = together(arrow(texts, cut, PASSAGE_DDL))
    compared = stored(arrow(passages, compare, PASSAGE_DDL), "compared")
    spans, large = compared.filter("done"), compared.filter("not done")
    if not large.isEmpty():
        spans = spans.union(arrow(together(large), by_name, PASSAGE_DDL))
    return stored(arrow(together(spans), merged, "tid long, starts binary, stops binary"), "ranges")
