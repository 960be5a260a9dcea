"""Quality rules by compression bands (operator 10).

A document passes if zstandard squeezes it neither too well (repetition) nor too badly (noise). The ratio of
compressed to plain bytes falls with length, so each limit holds for a range of lengths; the same is asked of chunks
that cover the whole text, of which only a bounded share of bytes may fall outside, so that a bad half cannot hide behind
a good one. Shorter texts have shorter chunks with limits of their own; the last chunk ends at the text's end and counts for the bytes
that those before it leave. Texts under 256 bytes are one chunk, the text: below 128 bytes the ratio tells noise from words no more.

Defined cases: a null text counts as empty; a text without words fails the base rules; a null doc_id, repeated rows
and extra columns, whatever their names, change nothing, as each row is judged alone. A ratio at a limit is within its band, and a share of bad
bytes at its limit is allowed. Texts are read whole, whatever their length; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow, raw, slices

SYMBOLS = b"#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """Limits of compressed/plain by length: (up to so many bytes, lowest, highest)."""

    whole: tuple[tuple[float, float, float], ...] = field(
        default=((200, 0.25, 1.10), (400, 0.33, 0.95), (800, 0.33, 0.85), (3200, 0.30, 0.75), (12800, 0.25, 0.66), (float("inf"), 0.22, 0.62))
    )
    #: By length, longest first: (from so many bytes, bytes of a chunk, lowest, highest).
    chunks: tuple[tuple[int, int, float, float], ...] = ((4096, 2048, 0.28, 0.75), (1024, 512, 0.30, 0.85), (512, 256, 0.33, 0.95), (256, 128, 0.50, 1.03))
    #: The largest share of bytes in chunks outside their band.
    chunk_share: float = 0.3
    level: int = 3
    min_words: int = 20
    max_repeat_percent: int = 30


def repeated_words(words: list[bytes], owner: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, the words inside 8-word windows that its text has twice or more. Windows are named exactly:
    words get numbers, then pairs, quadruples and octuples of neighbours do, so equal numbers mean equal words."""
    out = np.zeros(n_docs, np.int64)
    if len(words) < WINDOW:
        return out
    codes = pc.dictionary_encode(pa.array(words, pa.binary())).indices.to_numpy().astype(np.int64)
    # the owner takes part, so that windows of different documents differ
    codes = np.unique(codes + owner * (int(codes.max()) + 1), return_inverse=True)[1].astype(np.int64)
    span = 1
    while span < WINDOW:
        left, right = codes[:-span], codes[span:]
        codes = np.unique(left * (int(codes.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)
        span *= 2
    inside = owner[: len(codes)] == owner[WINDOW - 1 :]
    counts = np.bincount(codes[inside], minlength=int(codes.max()) + 1)
    hit = inside & (counts[codes] > 1)
    edge = np.zeros(len(owner) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[covered], minlength=n_docs).astype(np.int64)


def verdict(text: bytes, bands: Bands, squeeze: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """The whole text's ratio, the share of its bytes in chunks outside their band, and whether both are allowed."""
    if not text:
        return 1.0, 0.0, False
    n = len(text)
    ratio = len(squeeze.compress(text)) / n
    low, high = next((a, b) for most, a, b in bands.whole if n <= most)
    bad = 0
    rule = next((x[1:] for x in bands.chunks if n >= x[0]), None)
    if rule:
        step, least, most = rule
        for i in range(0, n, step):
            stop = min(i + step, n)
            if not least <= len(squeeze.compress(text[stop - step : stop])) / step <= most:
                bad += stop - i
    return ratio, bad / n, low <= ratio <= high and bad / n <= bands.chunk_share


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunks double, kept boolean"


def judge(batch: pa.RecordBatch, bands: Bands, squeeze: zstandard.ZstdCompressor) -> list:
    """The columns of SCHEMA but for doc_id, for a batch with a text column."""
    texts = raw(batch)
    split = [t.split() for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    words = [w for ws in split for w in ws]
    repeats = repeated_words(words, np.repeat(np.arange(len(texts)), n_words), len(texts))
    chars, symbols, dups, ratios, shares, kept = [], [], [], [], [], []
    for t, ws in zip(texts, split, strict=True):
        joined = b"".join(ws)
        chars.append(len(joined.decode("utf-8", "replace")))
        symbols.append(sum(map(joined.count, map(bytes, zip(SYMBOLS)))))  # noqa: B905
        lines = [x for x in t.split(b"\n") if x.strip()]
        dups.append(len(lines) - len(set(lines)))
        ratio, share, good = verdict(t, bands, squeeze)
        ratios.append(ratio), shares.append(share), kept.append(good)
    failed = (n_words < bands.min_words) | (100 * repeats > bands.max_repeat_percent * n_words)
    return [n_words, chars, symbols, dups, repeats, failed, ratios, shares, ~failed & np.array(kept, bool)]


def quality_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row for each row of docs(doc_id, text): base counts, the compression figures and the verdict."""

    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in judge(batch, bands, squeeze))], names=names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(plain, run, SCHEMA)


def accepted(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs, all columns, whose text the rules keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for batch in slices(batches):
            yield batch.filter(pa.array(judge(batch, bands, squeeze)[-1]))

    return arrow(docs, run, docs.schema)
