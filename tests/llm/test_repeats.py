"""Operators 8 and 9 and their shared frame against plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quern.llm import anchors, queries, suffix_array, suffix_tree


def sha(x):
    return hashlib.sha256(x).hexdigest()


def plain_bytes(rows, size=200):
    seen = defaultdict(int)
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        for i in range(len(t) - size + 1):
            seen[t[i : i + size]] += 1
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def plain_words(rows, size=13):
    least = {}
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    for (d, _), w in zip(rows, split):
        for i in range(len(w) - size + 1):
            if d is not None:
                k = tuple(w[i : i + size])
                least[k] = min(least.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and least[tuple(w[i : i + size])] < d:
                gone |= set(range(i, i + size))
        out.append((d, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.choice([12, 13, 14, 40, 60, 120]))) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages) if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randint(1, 80)))
            w = p.split()
            if rng.random() < 0.4:
                a = rng.randint(0, len(w) - 1)
                w = w[a:] if rng.random() < 0.5 else w[: a + 1]
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = word()
            parts.append(rng.choice([" ", "  ", "\n", "\t "]).join(w))
        texts.append(rng.choice([" ", "\n\n"]).join(parts))
    texts += ["ab" * 300, "x" * 450, "ab" * 260 + "!", "", " \n ", "z " * 40, passages[3] + " " + passages[3]] + texts[:4]
    rows = list(enumerate(texts)) + [(500, None), (3, texts[3]), (3, texts[9]), (None, texts[5]), (None, texts[5]), (None, "only " * 90)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, tmp_path, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(anchors, "SLICE", 3000)
        monkeypatch.setattr(anchors, "PIECE", 700)
        monkeypatch.setattr(anchors, "HOLD_BYTES", 2000)
        monkeypatch.setattr(suffix_tree, "GROUP", 3)
        monkeypatch.setattr(suffix_array, "PAIRS", 2)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sha string, n_words int").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [tuple(r) for r in queries.op9_prefix_suffix_trees(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(plain_words(rows), key=key)
    got = [tuple(r) for r in queries.op8_deep_shallow(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(plain_bytes(rows), key=key)


def passages_of(units, texts):
    """All windows of the texts as passages, each text its own document."""
    runs = units.runs(texts)
    content = [texts[t][a:b] for t, a, b in zip(runs.text, runs.start, runs.stop)]
    return anchors.Passages(runs.text, runs.text, runs.first, runs.last, runs.place - runs.first, runs.gram, content)


def covered(found, texts):
    out = set()
    for tid, a, b in zip(*found):
        out |= {(int(tid), i) for i in range(a, b)}
    return out


def test_limits_change_nothing(monkeypatch):
    texts = list(dict.fromkeys((t or "").encode() for _, t in corpus(3)))
    for units, solver in ((anchors.Words(13, 4), suffix_tree), (anchors.Bytes(200, 48), suffix_array)):
        whole = passages_of(units, texts)
        every = covered(solver.solve(whole.take(solver.settle(whole)[0])), texts) | covered(solver.settle(whole)[1], texts)
        monkeypatch.setattr(anchors, "PIECE", 150 if solver is suffix_tree else 700)
        monkeypatch.setattr(suffix_tree, "GROUP", 3)
        monkeypatch.setattr(suffix_array, "PAIRS", 1)
        cut = passages_of(units, texts)
        assert covered(solver.solve(cut.take(solver.settle(cut)[0])), texts) | covered(solver.settle(cut)[1], texts) == every and every
        monkeypatch.undo()


def test_anchors_are_shared_by_equal_windows():
    rng = random.Random(9)
    common_part = bytes(rng.choices(b"abc ", k=230))
    texts = [bytes(rng.choices(b"abc ", k=rng.randint(0, 300))) + common_part + bytes(rng.choices(b"abc ", k=rng.randint(0, 300))) for _ in range(20)]
    r = anchors.Bytes(200, 48).runs(texts)
    for i, t in enumerate(texts):
        at = t.index(common_part)
        mine = {(int(g), int(p) - at) for k, g, p, f, last in zip(r.text, r.gram, r.place, r.first, r.last) if k == i and f <= at + 15 <= last}
        assert len(mine) == 1
        if i:
            assert mine == before  # noqa: F821
        before = mine  # noqa: F841


def test_texts_that_share_the_start_of_their_hash(spark):
    units = anchors.Bytes(200, 48)
    digests = [hashlib.sha256(t).hexdigest() for t in (b"a", b"b")]
    reps = spark.createDataFrame([(d,) for d in digests] + [(digests[0][:16] + digests[1][16:],)], "sha string")
    named, shared = anchors.with_ids(reps)
    assert len(shared) == 1 and len({r.tid for r in named.collect()}) == 3
    by = {r.sha: r.tid for r in named.collect()}
    assert anchors.text_ids(units, [b"a", b"b"], shared).tolist() == [by[digests[0]], by[digests[1]]]
    assert anchors.text_ids(units, [b"b"]).tolist() == [by[digests[1]]]
    assert anchors.text_ids(units, []).tolist() == []


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op8_deep_shallow(spark, str(tmp_path)).count() == queries.op9_prefix_suffix_trees(spark, str(tmp_path)).count() == 0


def test_deep_shallow_sorts():
    rng = random.Random(4)
    for n in (1, 2, 3, 30, 400):
        strings = [bytes(rng.choices(b"ab\x00", k=rng.randint(0, 30))) for _ in range(n)] + [b"aaaaaaaaaaaa" + bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(n)]
        order = suffix_array.deep_shallow(strings)
        assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)
    assert suffix_array.common(b"abc", b"abd") == 2 and suffix_array.common(b"", b"x") == 0 and suffix_array.common(b"ab", b"abc") == 2


def test_runs_stand_in_the_order_of_texts(monkeypatch):
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"abc ", k=k)) for k in (400, 2500, 300, 900, 500)]
    for units in (anchors.Bytes(200, 48), anchors.Words(13, 4)):
        whole = units.runs(texts)
        monkeypatch.setattr(anchors, "PIECE", 700)
        cut = units.runs(texts)
        monkeypatch.undo()
        assert (np.diff(cut.text) >= 0).all()
        edge = np.searchsorted(cut.text, np.arange(len(texts) + 1))
        for i in range(len(texts)):  # each text's part has all of its anchors, as cut() in repeated_ranges reads them
            assert set(cut.gram[edge[i] : edge[i + 1]].tolist()) == set(whole.gram[whole.text == i].tolist())


def test_an_anchor_across_a_cut_is_one_place(monkeypatch):
    rng = random.Random(6)
    noise = lambda k: bytes(rng.choices(b"abcdefgh ", k=k))
    passage = noise(260)
    text = noise(600) + passage + noise(500) + passage + noise(300)
    units = anchors.Bytes(200, 48)
    crossed = 0
    for piece in range(600, 640):  # the first copy lies across the cut
        monkeypatch.setattr(anchors, "PIECE", piece)
        r = units.runs([text])
        places = defaultdict(list)
        for g, p in zip(r.gram.tolist(), r.place.tolist()):
            places[g].append(p)
        crossed += any(len(p) == 3 and len(set(p)) == 2 for p in places.values())
        for alone in (True, False):
            tid, gram = anchors.entries(np.zeros(len(r.gram), np.int64), r.gram, r.place, alone)
            got = dict(zip(*(x.tolist() for x in np.unique(gram, return_counts=True))))
            assert got == {g: min(len(set(p)), 1 + alone) for g, p in places.items()}
    assert crossed


def test_prefixes_of_several_lengths(monkeypatch):
    """Frequent prefixes grow, rare ones do not; the parts hold all suffixes once, and none is above its size unless all its words are equal."""
    rng = random.Random(4)
    words = np.array([rng.choice([0, 0, 0, 0, 1, 2, rng.randrange(3, 40)]) for _ in range(3000)], np.int64)
    at = np.arange(len(words) - 13)
    monkeypatch.setattr(suffix_tree, "GROUP", 40)
    found = list(suffix_tree.parts(words, at, at, 0))
    assert len({depth for *_, depth in found}) > 4
    assert sorted(i for part, *_ in found for i in part.tolist()) == at.tolist()
    assert all(len(part) <= 40 or depth == suffix_tree.SIZE for part, _, depth in found)
    for part, _, depth in found:
        assert len({tuple(words[i : i + depth]) for i in part.tolist()}) == 1


def test_maximal_repeats():
    """Of two texts that share 20 words, the later one's first suffix has a node of depth 20 above it."""
    words = np.array([*range(100, 105), *range(20), 200, *range(20), 300], np.int64)
    at, stop = np.array([5, 26]), np.array([26, 47])
    assert suffix_tree.repeats(words, at, stop, np.array([1, 2])).tolist() == [0, 20]
    assert suffix_tree.repeats(words, at, stop, np.array([2, 2])).tolist() == [0, 0]


def test_one_line_in_very_many_texts(spark, tmp_path, monkeypatch):
    """A line that thousands of otherwise different texts have, and passages that reach into their own words: the group is taken apart."""
    monkeypatch.setattr(anchors, "HOLD_BYTES", 300_000)
    rng = random.Random(6)
    letters = "abcdefghijklmnop"
    own = lambda n: " ".join("".join(rng.choices(letters, k=6)) for _ in range(n))
    line, passage = "released under the terms of some license or other, which all of these texts have", own(40)
    texts = [f"{own(30)} {line} {own(30)}" + (f" {passage} {own(20)}" if k % 3 == 0 else "") for k in range(6000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    size = len(passage.encode())
    rows = {r.doc_id: r for r in queries.op8_deep_shallow(spark, str(tmp_path)).collect()}
    # chance neighbours: the blank before and after the passage, and at times some letters more
    assert all(0 <= rows[k].n_removed - (size + 2) < 14 if k % 3 == 0 else rows[k].n_removed == 0 for k in rows) and len(rows) == 6000
    rows = {r.doc_id: r for r in queries.op9_prefix_suffix_trees(spark, str(tmp_path)).collect()}
    # the line has 15 words; a neighbouring word may be the same by chance
    assert rows[0].n_removed == 0 and all(0 <= rows[k].n_removed - (55 if k % 3 == 0 else 15) < 3 for k in rows if k)
