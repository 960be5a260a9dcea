"""Operators 5, 6, 7, 10 and 3 against plain versions."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quern.llm import bpe, decontamination, quality, queries, simhash, token_counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None,
    "",
    " ",
    "\n\n  a  b\tc \n",
    "it's we'll I'd 'S",
    "a\x85  b\x1c c  d",
    "x<|endoftext|> <|endoftext|>y",
    "aaaa" * 3000,
    "日本語テキスト émoji 😀😀 ß" * 50,
    "=" * 5000 + " " * 3000 + "end",
    "  wide  　 spaces 12345 67,8.9",
]


def frame(spark, texts, schema="doc_id long, text string, n_words string, fp string"):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], schema)


def library():
    return Tokenizer.from_file(PATH)


def test_bpe_agrees_with_the_library(spark):
    docs = frame(spark, ODD).unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 doc_id", "text", "'x' n_words", "null fp"))
    rows = {r.doc_id: r for r in bpe.round_trip(docs, PATH).collect()}
    t = library()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert list(rows[r.doc_id].ids) == ids
        assert rows[r.doc_id].decoded == t.decode(ids, skip_special_tokens=False) == (r.text or "")


def test_bpe_on_random_words(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abehinorst eé'1.\n") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    v, t = bpe.Vocabulary(PATH), library()
    for word, ids in zip(words, v.encode(words), strict=True):
        assert ids.tolist() == t.encode(word, add_special_tokens=False).ids


def test_token_counts(spark):
    docs = frame(spark, [*ODD, "word " * 60000])
    t = library()
    for r in token_counts.token_counts(docs, PATH).collect():
        text = ([*ODD, "word " * 60000])[r.doc_id] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 1024)


def test_token_counts_of_a_piece_model(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in token_counts.token_counts(frame(spark, ODD), path).collect():
        assert r.n_tokens == len(model.encode(ODD[r.doc_id] or ""))


def plain_contamination(texts, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(13, len(b))
            for i in range(len(b) - n + 1 if b else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[i : i + n]:
                        hit |= set(range(j, j + n))
                        if item is not None:
                            ids.add(item)
        out.append((len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [1 << 24, 200, 40])
def test_contamination(spark, block):
    rng = random.Random(3)
    vocabulary = ["Aa", "bb", "c", "dé", "e1", "ff"]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate((1, 2, 5, 13, 14, 20, 30))] + [(None, "zz yy"), (8, None), (9, "..."), (3, "bb bb")]
    texts = [None, "", "zz, YY!", *(" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(20)), *(f"x {t} y " * 2 for _, t in items), "zz, YY!"]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_contamination(texts, items)
    got = decontamination.contamination(docs, bench, block_bytes=block).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == want[r.doc_id]
    kept = {r.doc_id for r in decontamination.clean(docs, bench, block_bytes=block).collect()}
    assert kept == {i for i, w in enumerate(want) if not w[3]}
    assert decontamination.contamination(docs, bench.limit(0)).filter("n_hit > 0 or contaminated").isEmpty()


@pytest.mark.parametrize("block", [1 << 24, 40])
def test_equal_and_null_ids_are_judged_by_row(spark, block):
    items = [(k, f"alpha{k} beta{k} gamma{k}") for k in range(5)]
    bad = " ".join(t for _, t in items[:3])
    rows = [(1, bad), (1, "clean words here"), (None, bad), (None, "clean words here"), (2, bad), (2, bad), (3, "clean"), (3, "clean")]
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, text string, row string, of string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = sorted((tuple(r) for r in decontamination.clean(docs, bench, block_bytes=block).collect()), key=str)
    assert kept == sorted(((i, t, "a", "b", "c") for i, t in rows if t != bad), key=str)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontamination.contamination(docs, bench, block_bytes=block).collect()), key=str)
    assert got == sorted(((i, n, hit, ids, c) for (i, _), (n, hit, ids, c) in zip(rows, ((n, h, tuple(ids), c) for n, h, ids, c in plain_contamination([t for _, t in rows], items)), strict=True)), key=str)


def test_a_long_item_is_cut_and_hot_words_are_met_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    long = " ".join(rng.choices(["a", "bb", "ccc", "dd", "e"], k=400))
    texts = [long[100:400], " ".join(rng.choices(["a", "bb", "ccc"], k=300)), "a " * 50]
    monkeypatch.setattr(decontamination, "MEETINGS", 7)
    for most in (60, 300, 1 << 20):
        windows = [decontamination.filed([(5, p)], {}, 13) for p in decontamination.pieces(long.encode(), 13, most)]
        hits = [decontamination.found_in([t.encode() for t in texts], w) for w in windows]
        n = [int(sum(h.covered[h.starts[k] : h.starts[k + 1]] for h in hits).astype(bool).sum()) for k in range(3)]
        assert n == [w[1] for w in plain_contamination(texts, [(5, long)])]



def plain_quality(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    n = len(words)
    grams = [tuple(words[i : i + 8]) for i in range(n - 7)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_quality_rules(spark):
    rng = random.Random(1)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(300))
    texts = [*ODD, prose, "a b c d e f g h " * 40, "x\ny\nx\n \n \nx", "one two three four five six seven eight nine " * 2 + prose, "\x85 a\x85b"]
    rows = {r.doc_id: r for r in quality.quality_rules(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(t), t
    assert rows[len(ODD)].kept and not rows[len(ODD) + 1].kept
    noise = " ".join(rng.randbytes(30).hex() + "".join(chr(rng.randint(33, 126)) for _ in range(90)) for _ in range(60))
    flat = " ".join(["again"] + [f"w{k % 7}" for k in range(2000)])
    assert not quality.quality_rules(frame(spark, [noise, flat])).filter("kept").count()
    assert [r.doc_id for r in quality.accepted(frame(spark, texts)).collect()] == [i for i in range(len(texts)) if rows[i].kept]


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    n, root = len(prints), list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_fingerprints(spark):
    texts = [*ODD, "one", "One two", "a b c", "A  b\nc", *(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect())]
    got = {r.doc_id: r.fp for r in simhash.with_fingerprints(frame(spark, texts).drop("fp")).collect()}
    for i, t in enumerate(texts):
        assert got[i] % 2**64 == plain_fingerprint(t)


@pytest.mark.parametrize("limit", [2048, 8])
def test_groups_of_fingerprints(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rng = random.Random(limit)
    prints = []
    for _ in range(30):
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 40])):
            center_or_near = center
            for b in rng.sample(range(64), rng.randint(0, 4)):
                center_or_near ^= 1 << b
            prints.append(center_or_near)
    prints += prints[:5]
    signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)]
    found = simhash.groups(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    by = {r.fp % 2**64: r.component_id for r in found}
    assert [by[p] for p in prints] == plain_groups(prints)


@pytest.mark.parametrize("limit", [64, 4])
def test_groups_of_a_dense_cloud(spark, monkeypatch, limit):
    """Prints that differ in a few loose bits share many keys; beyond the limit the finer keys and then the blocks must find the same groups."""
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rng = random.Random(limit)
    prints = set()
    for loose in (14, 17, 20):
        center, bits = rng.getrandbits(64), rng.sample(range(64), loose)
        for _ in range(200):
            prints.add(center ^ sum(1 << b for b in bits if rng.random() < 0.3))
    prints = sorted(prints)
    signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)]
    found = simhash.groups(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    by = {r.fp % 2**64: r.component_id for r in found}
    want = plain_groups(prints)
    assert [by[p] for p in prints] == want and 3 < len(set(want)) < len(prints)


def test_forest_in_parts(monkeypatch):
    import numpy as np

    rng = random.Random(4)
    fps = np.array(sorted({sum(1 << b for b in range(12) if rng.random() < 0.3) for _ in range(300)}), np.uint64)
    run, start = np.zeros(len(fps), np.int64), np.full(len(fps), 2)
    whole = [x.tolist() for x in simhash.forest(fps, run, start)]
    monkeypatch.setattr(simhash, "HELD_PAIRS", 50)
    assert [x.tolist() for x in simhash.forest(fps, run, start)] == whole and len(whole[0]) > 100


def test_runs_beyond_the_limit():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    near = sorted({(1 << 40) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)})
    rows = [(5, rng.getrandbits(60)) for _ in range(3)] + [(7, x) for x in near] + [(9, 1), (9, 3)]
    batches = lambda n: [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + n]]), pa.array([f for _, f in rows[i : i + n]])], names=["key", "fp"]) for i in range(0, len(rows), n)]
    for n in (10, 1000):
        out = [r for b in simhash.compare_runs(iter(batches(n)), limit=50) for r in b.to_pylist()]
        assert sorted(r["b"] for r in out if r["hot"]) == near and all(r["a"] == 7 for r in out if r["hot"])
        assert [(r["a"], r["b"]) for r in out if not r["hot"]] == [(3, 1)]
    all_at_once = [r for b in simhash.compare_runs(iter(batches(1000)), limit=5000) for r in b.to_pylist()]
    assert {r["a"] for r in all_at_once} == {*near[1:], 3} and not any(r["hot"] for r in all_at_once)
    assert len(simhash.close(np.array([0, 0], np.uint64), np.array([7, 15], np.uint64), np.zeros(2, np.int64))) == 1


def test_one_of_each(spark):
    a, b = "the quick brown fox jumps over the lazy dog " * 5, "something else entirely is written here for once " * 4
    docs = spark.createDataFrame([(5, a, "p"), (3, a, "q"), (7, b, "r"), (7, b, "r"), (None, b, "s"), (None, None, "t"), (9, "", "u")], "doc_id long, text string, root string")
    kept = sorted((r.doc_id, r.root) for r in simhash.one_of_each(docs).collect())
    assert kept == [(3, "q"), (7, "r"), (9, "u")]
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    # equal ids with equal fingerprints: the smallest text, then the other columns
    docs = spark.createDataFrame([(2, "x Y z", "1"), (2, "X y z", "3"), (2, "X y z", "2"), (2, a, "4"), (1, b, "5")], "doc_id int, text string, `a.b` string")
    assert sorted(map(tuple, simhash.one_of_each(docs).collect())) == [(1, b, "5"), (2, "X y z", "2"), (2, a, "4")]


def test_temporaries_go(spark):
    from pathlib import Path

    from quern.llm.common import stored, temporaries
    from quern.sources import scratch

    base = Path(scratch.folder(spark).removeprefix("file:")).parent
    before = set(base.glob("quern-*"))
    with temporaries(spark):
        with temporaries(spark):
            middle = stored(stored(spark.range(5), "one").filter("id > 1"), "two")
        out = stored(middle.filter("id > 2"), "three")
    assert [r.id for r in out.sort("id").collect()] == [3, 4]
    assert [p.name.rsplit("-", 1)[1] for p in set(base.glob("quern-*")) - before] == ["three"]
    with pytest.raises(ValueError), temporaries(spark):
        stored(spark.range(5), "four")
        raise ValueError
    assert not list(base.glob("*-four"))


def test_queries_digest(spark):
    got = {r.doc_id: r for r in queries.op5_bpe_prefix_trie(spark, SF).collect()}
    t = library()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = t.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
