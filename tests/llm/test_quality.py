"""The chunk rule of operator 10 covers whole texts."""

import base64
import random

import pytest
import zstandard

from quern.llm import quality

SQUEEZE = zstandard.ZstdCompressor(level=3)


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("eeeetttaaoinshrdlucmfwypgbvk", k=rng.randint(2, 9))) for _ in range(400)]
    return " ".join(rng.choice(words[: rng.choice((40, 400))]) for _ in range(n))[:n].encode()


@pytest.mark.parametrize("n", [256, 300, 511, 512, 900, 1023, 1024, 1500, 4095, 4096, 6136, 20000])
def test_every_part_is_judged(n):
    rng = random.Random(n)
    kept = lambda t: quality.verdict(t, quality.Bands(), SQUEEZE)[2]
    noise, phrase = base64.b85encode(rng.randbytes(n))[:n], (b"buy it now. " * n)[:n]
    good = prose(n, n)
    assert kept(good)
    for bad in (noise, phrase):
        half = n // 2
        assert not kept(good[:half] + bad[half:]) and not kept(bad[:half] + good[half:])
        assert not kept(bad)


def test_the_tail_counts_for_its_bytes():
    rng = random.Random(1)
    head = prose(2, 4096)
    for bad in (base64.b85encode(rng.randbytes(2040))[:2040], (b"buy it now. " * 2040)[:2040]):
        ratio, share, kept = quality.verdict(head + bad, quality.Bands(), SQUEEZE)
        assert share == 2040 / 6136 and not kept
    # a short tail alone is no large share, even where its chunk is out
    assert quality.verdict(head + b"#" * 400, quality.Bands(), SQUEEZE)[1] <= 400 / 4496


def plain_verdict(text):
    """The bands by their definition, a chunk at a time."""
    size = lambda x: len(SQUEEZE.compress(x))
    n = len(text)
    if n == 0:
        return False
    for most, low, high in ((200, 0.25, 1.10), (400, 0.33, 0.95), (800, 0.33, 0.85), (3200, 0.30, 0.75), (12800, 0.25, 0.66), (10**12, 0.22, 0.62)):
        if n <= most:
            if not low <= size(text) / n <= high:
                return False
            break
    judged, bad = 0, 0
    for least, step, low, high in ((4096, 2048, 0.28, 0.75), (1024, 512, 0.30, 0.85), (512, 256, 0.33, 0.95), (256, 128, 0.50, 1.03)):
        if n >= least:
            at = 0
            while at < n:
                chunk = text[at : at + step] if at + step <= n else text[n - step :]
                new = min(step, n - at)
                judged += new
                bad += 0 if low <= size(chunk) / step <= high else new
                at += step
            assert judged == n
            break
    return bad / n <= 0.3


def test_verdicts_agree_with_a_plain_version(spark):
    rng = random.Random(9)
    parts = [lambda n: prose(rng.random(), n), lambda n: base64.b85encode(rng.randbytes(n))[:n], lambda n: (b"buy it now. " * n)[:n], lambda n: ("çé ßü " * n).encode()[: n - n % 8]]
    texts = [b"".join(rng.choice(parts)(rng.choice((20, 100, 260, 700, 2100))) for _ in range(rng.randint(1, 5))).decode("utf-8", "ignore") for _ in range(300)]
    texts += [None, "", "  ", "word " * 19, "\n", prose(1, 300_000).decode()]
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, kept boolean")
    rows = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        assert rows[i].kept == (not rows[i].base_failed and plain_verdict((t or "").encode()))
    assert 30 < sum(r.kept for r in rows.values()) < 270
    assert sorted(r.doc_id for r in quality.accepted(docs).collect()) == sorted(i for i, r in rows.items() if r.kept)
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_documents_of_good_quality_stay(spark):
    """The bands drop none of the documents labelled good: what is lost of these fails the base rules."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id")
    judged = quality.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id")
    assert judged.filter("not base_failed").count() > 200 and judged.filter("not base_failed and not kept").count() == 0
