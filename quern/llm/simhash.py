"""SimHash near-duplicate groups with the pigeonring filter (operator 3).

Fingerprints of 64 bits stand on a ring of 8 segments. If two differ in at most 3 bits, some chain of consecutive
segments has, for every length l from its start, at most 3*l/8 differing bits in its first l segments. So the first
two segments of the chain are equal, and the next three differ in one bit at most, whence one half of these 24 bits
is equal too: that gives 16 keys of 28 bits a fingerprint. Pairs that share a key are held against the budgets of all
chain lengths in turn; the last of them is the full Hamming check.

Documents are first reduced to distinct fingerprints, so exact copies cost nothing further. Pairs are compared inside
the sorted runs of a key, and only the links of each run's own groups to their smallest member go out, so that a large
group of near copies yields rows in proportion to its members. A run beyond LIMIT members is written aside and
compared in blocks, each pair of blocks by a task of its own.

Defined cases: null texts and texts without words have fingerprint 0 and link like any other; fewer than three words
make one shingle; null doc_ids are never component ids unless a whole component has none; repeated rows share a component. A bit that exactly half of the
hashes have is not set. Texts are read whole, whatever their length; other columns of docs, whatever their names, pass through one_of_each() and are ignored
elsewhere; an empty table gives an empty result. Of rows with one doc_id and one fingerprint one_of_each() keeps that with the smallest text, then by its other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow, plus, quoted, raw, slices, stored
from quern.llm.components import components

SEGMENTS, BITS, DISTANCE, WORDS, SEED = 8, 8, 3, 3, 42
BUDGETS = [DISTANCE * n // SEGMENTS for n in range(1, SEGMENTS + 1)]
#: Members of a run that one task compares with each other.
LIMIT = 2048
#: Where a key has the start of its chain: before 29 bits in ring_keys(), before 60 in finer_keys().
RING, FINER = 29, 60
#: Pairs that forest() holds before it joins their groups.
HELD_PAIRS = 1 << 20


def hashes(text: bytes) -> list[int]:
    words = text.lower().split()
    if len(words) < WORDS:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(s), SEED) for s in zip(words, words[1:], words[2:])]  # noqa: B905


def fingerprint_array(texts: list[bytes]) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is set if more than half of the shingles' hashes have it."""
    found = [hashes(t) for t in texts]
    sizes = np.array([len(x) for x in found], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.array([h for x in found for h in x], np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        weights = (np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64))[None, :]
        step = 1 << 17  # rows of the bit matrix at a time, cut where a document ends
        at = 0
        while at < len(full):
            stop = max(at + 1, int(np.searchsorted(starts, starts[at] + step, side="right")) - 1) if at + 1 < len(full) else len(full)
            end = starts[stop] if stop < len(full) else len(flat)
            bits = np.unpackbits(flat[starts[at] : end].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, starts[at:stop] - starts[at], axis=0, dtype=np.int64)
            out[full[at:stop]] = ((2 * ones > sizes[full[at:stop], None]) * weights).sum(axis=1, dtype=np.uint64)
            at = stop
    return out.view(np.int64)


def with_fingerprints(docs: DataFrame, out: str = "fp") -> DataFrame:
    """docs, all columns, with the fingerprint of text as a signed long."""
    kept = docs.drop(out)
    schema = plus(kept.schema, out, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprint_array(raw(batch)))], names=[*batch.schema.names, out])

    return arrow(kept, run, schema)


def ring_keys(fp: Column) -> Column:
    """The 16 keys: chain start, half, and 28 bits."""
    out = []
    for i in range(SEGMENTS):
        turned = F.shiftleft(fp, BITS * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - BITS * i)) if i else fp
        equal = F.shiftrightunsigned(turned, 48)
        for half in range(2):
            rest = F.shiftrightunsigned(turned, 36 - 12 * half).bitwiseAND(F.lit(0xFFF))
            out.append(F.shiftleft(F.lit(2 * i + half).cast("long"), 28).bitwiseOR(F.shiftleft(equal, 12)).bitwiseOR(rest))
    return F.array(*out)


def finer_keys(key: Column, fp: Column) -> Column:
    """The 20 keys of a member of a large run: three of the six parts of the bits that `key` leaves open. Hashed, as equal keys only make candidates."""
    start, half = F.shiftright(key, RING), F.shiftright(key, RING - 1).bitwiseAND(F.lit(1))

    def turned_by(i: int) -> Column:
        return F.shiftleft(fp, BITS * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - BITS * i)) if i else fp

    turned = F.element_at(F.array(*(turned_by(i) for i in range(SEGMENTS))), (start + 1).cast("int"))
    other = F.when(half == 0, F.shiftrightunsigned(turned, 24)).otherwise(F.shiftrightunsigned(turned, 36)).bitwiseAND(F.lit(0xFFF))
    rest = F.shiftleft(other, 24).bitwiseOR(turned.bitwiseAND(F.lit(0xFFFFFF)))
    masks = [sum(0x3F << 6 * p for p in three) for three in combinations(range(6), 3)]
    named = [F.xxhash64(key, F.lit(k), rest.bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(masks)]
    return F.array(*(F.shiftleft(start, FINER).bitwiseOR(F.shiftrightunsigned(h, 64 - FINER)) for h in named))


def close(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pairs keep within the budgets of all prefixes of the chain from `start`; the last is the Hamming check."""
    x, turn = a ^ b, (BITS * start).astype(np.uint64)
    x = (x << turn) | (x >> ((np.uint64(64) - turn) % np.uint64(64)))
    alive = np.arange(len(x))
    for n, budget in enumerate(BUDGETS, 1):
        alive = alive[np.bitwise_count(x[alive] >> np.uint64(64 - BITS * n)) <= budget]
    return alive


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's group after the pairs (a, b) have joined the groups of `label`."""
    a, b = np.concatenate([a, np.arange(len(label))]), np.concatenate([b, label])
    while True:
        low = np.minimum(label[a], label[b])
        before = label
        label = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def forest(fps: np.ndarray, run: np.ndarray, start: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links each fingerprint to the smallest of its group within its run. fps of a run stand together; with `other`
    (0 or 1: the block of each), only pairs across blocks count."""
    n = len(fps)
    label = np.arange(n)
    lefts, rights, held = [], [], 0
    for gap in range(1, n):
        at = np.flatnonzero(run[:-gap] == run[gap:])
        if not len(at):
            break
        if other is not None:
            at = at[other[at] != other[at + gap]]
        good = at[close(fps[at], fps[at + gap], start[at])]
        lefts.append(good), rights.append(good + gap)
        held += len(good)
        if held > HELD_PAIRS:
            label = joined(label, np.concatenate(lefts), np.concatenate(rights))
            lefts, rights, held = [], [], 0
    if held:
        label = joined(label, np.concatenate(lefts), np.concatenate(rights))
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


PAIRS = "a long, b long, hot boolean"


def compare_runs(batches: Iterator[pa.RecordBatch], limit: int = LIMIT, start_at: int = RING) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by both -> links (a, b, false), and the rows of runs beyond `limit` as (key, fp, true)."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot_key = None

    def out(a, b, hot):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

    def finish(keys, fps):
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        sizes = np.diff(np.concatenate([[0], change, [len(keys)]]))
        size = np.repeat(sizes, sizes)
        large = size > limit
        if large.any():
            yield out(keys[large], fps[large], True)
        some = np.flatnonzero((size > 1) & ~large)
        if len(some):
            run = np.repeat(np.arange(len(sizes)), sizes)[some]
            a, b = forest(fps[some].view(np.uint64), run, keys[some] >> start_at)
            if len(a):
                yield out(a, b, False)

    for batch in batches:
        k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if hot_key is not None:  # the rest of a run already known to be large
            more = int(np.searchsorted(k, hot_key, side="right"))
            if more:
                yield out(k[:more], f[:more], True)
            k, f = k[more:], f[more:]
            if not len(k):
                continue
            hot_key = None
        keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
        if len(keys) < 20_000:
            continue
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        yield from finish(keys[:last], fps[:last])
        keys, fps = keys[last:], fps[last:]
        if len(keys) > limit:
            hot_key = keys[-1]
            yield out(keys, fps, True)
            keys, fps = keys[:0], fps[:0]
    if len(keys):
        yield from finish(keys, fps)


def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, one, two, block, fp) sorted by key and blocks; compares block one with two, or within itself."""
    held: list[np.ndarray] = []

    def finish(rows):
        fps, within = rows[4].view(np.uint64), rows[1][0] == rows[2][0]
        a, b = forest(fps, np.zeros(len(fps), np.int64), rows[0] >> FINER, None if within else rows[3])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.zeros(len(a), bool))], names=["a", "b", "hot"])

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
        rows = np.concatenate([*held, rows], axis=1) if held else rows
        edges = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
        bounds = [0, *edges.tolist()]
        for a, b in zip(bounds, bounds[1:]):  # noqa: B905
            yield finish(np.ascontiguousarray(rows[:, a:b]))
        held = [rows[:, bounds[-1] :]]
    if held and held[0].shape[1]:
        yield finish(np.ascontiguousarray(held[0]))


def hot_links(hot: DataFrame) -> DataFrame:
    """Links within runs of more than LIMIT members: each member goes to a block, each pair of blocks to one group."""
    n = hot.groupBy("key").agg(F.ceil(F.count("*") * 2 / LIMIT).cast("long").alias("n"))
    block = hot.join(n, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n")))
    pairs = block.withColumn("peer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pairs = pairs.select("key", F.least("block", "peer").alias("one"), F.greatest("block", "peer").alias("two"), "block", "fp")
    dealt = pairs.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "fp")
    return arrow(dealt, compare_blocks, PAIRS)


def compared(keyed: DataFrame, start_at: int, label: str) -> tuple[DataFrame, DataFrame]:
    """keyed(key, fp) -> links (a, b) within runs, and the rows (key, fp) of runs beyond LIMIT."""
    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
    found = stored(arrow(dealt, partial(compare_runs, limit=LIMIT, start_at=start_at), PAIRS), label)
    return found.filter("not hot").select("a", "b"), found.filter("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))


def links(fps: DataFrame) -> DataFrame:
    """fps(fp), distinct -> (a, b): links that join exactly the fingerprints at 3 or fewer differing bits into groups."""
    out, hot = compared(fps.select(F.explode(ring_keys(F.col("fp"))).alias("key"), "fp"), RING, "links")
    if hot.isEmpty():
        return out
    finer, hot = compared(hot.select(F.explode(finer_keys(F.col("key"), F.col("fp"))).alias("key"), "fp"), FINER, "finer-links")
    out = out.union(finer)
    return out if hot.isEmpty() else out.union(stored(hot_links(hot), "hot-links").select("a", "b"))


def groups(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fp) -> a row for each distinct fp: root (smallest linked fp), component_id (smallest doc_id)."""
    fps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = components(links(fps.select("fp")))
    rooted = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, root and component_id for each row of docs(doc_id, text)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = stored(with_fingerprints(plain).select("doc_id", "fp"), "prints")
    return prints.join(groups(prints), "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one stays for each group: the row with the smallest doc_id."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = stored(with_fingerprints(plain).select("doc_id", "fp"), "prints")
    best = prints.join(groups(prints), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("best"))
    keep = stored(best.select(F.col("best.doc_id").alias("__quern_id"), F.col("best.fp").alias("__quern_keep")), "keep")
    again = stored(prints.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__quern_again")), "again")
    mine, several = F.col("doc_id").cast("long").eqNullSafe(F.col("__quern_id")), F.col("doc_id").cast("long").eqNullSafe(F.col("__quern_again"))
    out = docs.join(keep, mine, "left_semi")
    if again.isEmpty():
        return out
    # where rows share a doc_id, their fingerprints tell which is meant
    marked = with_fingerprints(docs.join(again, several, "left_semi"), "__quern_fp")
    marked = marked.join(keep, mine & (F.col("__quern_fp") == F.col("__quern_keep")), "left_semi")
    row = F.struct(*quoted(docs.columns))
    same = marked.groupBy("doc_id", "__quern_fp").agg(F.min_by(row, F.struct(F.col("text").cast("string"), F.to_json(row))).alias("__quern_row"))
    return out.join(again, several, "left_anti").union(same.select("__quern_row.*"))
