"""The pipeline against a plain version on a small table with planted cases."""

import random

import corpus_pipeline
import public_tokenizers
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from quern.llm import quality
from tests.llm.test_map_side import plain_contamination, plain_fingerprint, plain_groups, plain_quality
from tests.llm.test_pii import plain_spans


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlucm", k=rng.randint(2, 9))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    import zstandard

    rng = random.Random(7)
    bench = [(k, prose(rng, 20)) for k in range(3)]
    base = [prose(rng, n) for n in (60, 120, 400, 900)]
    texts = [
        *base,
        base[2],  # a copy
        base[3].upper(),
        base[1] + " " + bench[0][1],
        base[0][:100] + " " + prose(rng, 80) + " me@x.org and +1 (456) 555-2186 " + prose(rng, 30),
        "again and again and " * 60,
        "too short",
        None,
        "",
        prose(rng, 500) + " " + bench[1][1][:40],
    ]
    docs = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    squeeze = zstandard.ZstdCompressor(level=3)
    kept = [(i, t) for i, t in enumerate(texts) if not plain_quality(t)[5] and quality.verdict((t or "").encode(), quality.Bands(), squeeze)[2]]
    groups = plain_groups([plain_fingerprint(t) for _, t in kept])
    kept = [x for k, x in enumerate(kept) if groups[k] == k]
    kept = [x for x, c in zip(kept, plain_contamination([t for _, t in kept], bench), strict=True) if not c[3]]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, text in kept:
        for kind, a, b in sorted(plain_spans(text), key=lambda s: -s[1]):
            text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
        want[i] = t.encode(text, add_special_tokens=False).ids
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == want and len(want) == 6
    assert all(r.n_tokens == len(r.ids) for r in got.values())


def test_clashing_columns_pass_through(spark):
    rng = random.Random(3)
    text = prose(rng, 80) + " me@x.org"
    names = ["doc_id", "text", "lang", "source", "n_chars", "_text", "_base", "_row", "_sha", "_id", "_terms", "fp", "_fp", "root", "key", "ids", "bad_id", "words", "sha", "a.b", "c`d"]
    docs = spark.createDataFrame([(1, text, "en", "s", len(text), *names[5:]), (1, text, "en", "s", len(text), *names[5:]), (None, None, None, None, None, *names[5:])], StructType([StructField(n, LongType() if n in ("doc_id", "n_chars") else StringType()) for n in names]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == names
        assert all(tuple(r)[5:] == tuple(names[5:]) for r in out.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == 3


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0.5 * rows < out.count() <= rows
        assert stage(spark, docs.limit(0), sf).count() == 0
