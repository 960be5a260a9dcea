"""Token counts (operator 6): the tokenizers or sentencepiece library inside Arrow functions that return lengths only.

Texts of a byte-level file are split where no token can cross: before a white space that follows something else,
since neither words nor special strings reach over such a place. The pieces' lengths add up to the length of the
whole, and equal pieces have equal lengths: a task gives the library each distinct piece once, in batches of about
equal bytes, so neither a long document nor a hot piece swells a batch. Other files see whole texts, in such batches.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows, null doc_ids and extra columns, whatever their names, change nothing. Texts are
read whole, whatever their length; a text of exactly the limit is not over it; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow, byte_lengths, slices, strings

#: Bytes of text in a batch for the library, and of the pieces whose lengths a worker remembers.
BATCH_BYTES = 1 << 20
CACHE_BYTES = 96 << 20
PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
EDGE = re.compile(r"(?<=\S)(?=[ \t\n\r])")
ODD_SPACE = re.compile(r"[^\S \t\n\r]")


def pieces(text: str) -> list[str]:
    """Cuts text before each blank, tab or line end that follows a character that no one takes for white space."""
    return EDGE.split(text) if ODD_SPACE.search(text) else PIECE.findall(text)


@lru_cache(2)
def counter(path: str):
    """A function from texts to token counts, and whether long texts may be cut for it."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    spec = json.loads(t.to_str())
    kind = spec.get("pre_tokenizer") or {}
    safe = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and not spec.get("normalizer") and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens") or ())
    encode = getattr(t, "encode_batch_fast", t.encode_batch)
    return (lambda texts: [len(x) for x in encode(texts, add_special_tokens=False)]), safe


def balanced(items: list[str]) -> Iterator[list[str]]:
    """Runs of items of about BATCH_BYTES in UTF-8."""
    start = size = 0
    for i, x in enumerate(items):
        size += len(x.encode()) + 1
        if size >= BATCH_BYTES:
            yield items[start : i + 1]
            start, size = i + 1, 0
    if start < len(items):
        yield items[start:]


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens exceeds the limit, for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, safe = counter(path)
        known: dict[str, int] = {}
        size = 0
        for batch in slices(batches):
            texts = strings(batch)
            split = [pieces(t) for t in texts] if safe else [[t] for t in texts]
            new = list({p for words in split for p in words if p not in known})
            for some in balanced(new):
                known.update(zip(some, count(some), strict=True))
            size += sum(len(p.encode()) for p in new) + 180 * len(new)
            n_tokens = np.array([sum(map(known.__getitem__, words)) for words in split], np.int64)
            n_bytes = byte_lengths(batch.column(1))
            if size > CACHE_BYTES or not safe:
                known, size = {}, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(plain, run, SCHEMA)
