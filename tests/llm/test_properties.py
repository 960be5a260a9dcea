"""Kernels on arbitrary input, without Spark."""

import numpy as np
import public_tokenizers
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import anchors, bpe, decontamination, html, quality, suffix_array, token_counts
from tests.llm.test_map_side import plain_contamination, plain_quality

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
texts = st.text(st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0'<|>abcdest  ")), max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4))
def test_bpe(found):
    v = bpe.vocabulary(PATH)
    for text, ids in zip(found, v.encode(found), strict=True):
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert bpe.decoder(PATH)(ids, np.array([0, len(ids)])) == [text]


@settings(max_examples=150, deadline=None)
@given(texts)
def test_pieces(text):
    cut = token_counts.pieces(text)
    assert "".join(cut) == text
    count, safe = token_counts.counter(PATH)
    assert safe and sum(count(cut)) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_cache_cuts_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 500)
    monkeypatch.setattr(bpe, "APART_MOST", 5)
    v = bpe.Vocabulary(PATH)
    for k in range(20):
        text = f"the frequent word {k} and rare{k * 7919} words"
        assert v.encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(v.cache) < 40


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"<>/!-&;=\"' \nabp1.", "<p>", "</p>", "<div>", "<li>", "<a href=x>", "</a>", "&amp;", "<script>"]), max_size=60).map("".join))
def test_html(page):
    out = html.extract(page)
    assert all(block == " ".join(block.split()) and block for block in out.split("\n\n")) or out == ""


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n#"), max_size=60), min_size=1, max_size=4))
def test_quality(found):
    import pyarrow as pa

    columns = quality.judge(pa.RecordBatch.from_pydict({"text": found}), quality.Bands(), zstandard.ZstdCompressor())
    for i, text in enumerate(found):
        assert tuple(c[i] for c in columns[:6]) == plain_quality(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Cé."), max_size=40), max_size=4), st.lists(st.text(st.sampled_from("ab Cé."), max_size=12), min_size=1, max_size=4))
def test_decontamination(items, found):
    items = list(enumerate(items))
    windows = decontamination.filed([(i, t.encode()) for i, t in items], {b"a": 5}, 13)
    got = decontamination.found_in([t.encode() for t in found], windows)
    for k, want in enumerate(plain_contamination(found, items)):
        n = sum(r["stop"] - r["start"] for r in got.ranges()[k])
        assert (int(got.n_words[k]), n, sorted(got.items.get(k, ()))) == want[:3] and n == got.n_hit()[k]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=20))
def test_deep_shallow(strings):
    order = suffix_array.deep_shallow(strings)
    assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(1, 12))
def test_running_min(values, width):
    got = anchors.running_min(np.array(values, np.uint64), width).tolist()
    assert got == [min(values[i : i + width]) for i in range(len(values) - width + 1)]
