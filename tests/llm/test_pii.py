"""Operator 2 against a plain version."""

import hashlib
import math
import random
import re
import time

from quern.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    good = {
        "email": lambda v: True,
        "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 16 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v)),
        "phone": lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good[k](m[0])]


ODD = [
    None,
    "",
    "a@b a@b.c a@b.c.d@e.f x@@y.z .@-.-",
    "é😀 me@x.org ü 1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.01 12.34.56",
    "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000000 4111  1111 1111 1111 1",
    "+1 (456) 555-2186 +49 30 123456 +1234567 ++12345678 +1-2 +123456789012345 +1234567890123456 +1 (2",
    "9" * 30000 + "." + "8" * 20000 + " " + "a" * 40000 + " " + "b.c." * 9000 + "@x " + "1 " * 9000 + "a@" + "d." * 9000 + "e",
    "1.1.1.1 " * 3000,
    "+1234567" * 3 + "x@y.z\nq@r.s\tme@there.example.com,you@here.example.com;4532015112830366",
]


def test_base_spans(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a@b.c", "y")], "doc_id long, text string, spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_pii_disclosure(spark, str(tmp_path)).collect()}
    for i, t in enumerate(ODD):
        spans = plain_spans(t)  # the plain patterns take their time on long runs
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t or "")[:80]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s[0] == k for s in spans) for k in PLAIN)
    assert got[None].n_email == 1


def test_sanitised_text(spark):
    docs = spark.createDataFrame([(1, "write to me@x.org or +1 (456) 555-2186.", "en"), (2, None, "en"), (3, "clean", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: (r.text, r.lang) for r in pii.sanitised(docs).collect()}
    assert rows == {1: ("write to <EMAIL> or <PHONE>.", "en"), 2: (None, "en"), 3: ("clean", None)}
    assert pii.sanitised(docs.limit(0)).count() == 0


def test_revealing_terms(spark):
    person = [f"number {k} of the Zanzibar office: boss@corp.example, open daily since {w}" for k, w in enumerate(("spring", "summer", "autumn", "winter"))]
    other = [f"the office is open daily, text {k} says so" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate([*person, *other, "zanzibar is far", "Zanzibar has spice"])) + [(1, person[1])], "doc_id long, text string")
    told = {r.term: r.disclosure for r in pii.disclosures(docs, pii.mentions(docs), pii.Policy(generalise=0.1)).collect()}
    n, e = 47, 5
    want = lambda both, t: math.log(n * both / (e * t)) / math.log(n / e)
    assert abs(told["zanzibar"] - want(5, 7)) < 1e-9 and abs(told["corp" if "corp" in told else "number"] - want(5, 5)) < 1e-9
    assert "spring" not in told  # seen in one place only
    assert "office" not in told
    spans = {(r.doc_id, s.kind, s.value) for r in pii.with_spans(docs, pii.Policy()).collect() for s in r[pii.TERMS]}
    assert (0, "generalise", "zanzibar") in spans and (0, "remove", "number") in spans and not any(d > 3 for d, *_ in spans)
    clean = pii.sanitised(docs).filter("doc_id = 0").first().text
    assert "Zanzibar" not in clean and "<TERM> office: <EMAIL>, open daily" in clean
    assert pii.sanitised(docs).filter("doc_id = 1").count() == 2


def test_entities_of_one_or_two_texts(spark):
    far = "and there is more to say of it all in the end " * 3
    once = f"Quetzal {far} once@x.example {far} meets Xylophone"
    twice = [f"the Yttrium {w} {far} twice@x.example" for w in ("plant", "works")]
    texts = [once, *twice, *(f"there is more to say of it all in the end, the plant works, {k}" for k in range(60)), once]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {(r.doc_id, s.value) for r in pii.with_spans(docs).collect() for s in r[pii.TERMS]}
    assert {(0, "quetzal"), (0, "xylophone"), (len(texts) - 1, "quetzal"), (1, "yttrium"), (2, "yttrium")} <= spans
    assert not {v for _, v in spans} & {"more", "there", "plant", "works"}
    told = {(r.entity, r.term): r.disclosure for r in pii.disclosures(docs, pii.mentions(docs), pii.Policy()).collect()}
    want = math.log(64 * 2 / (2 * 3)) / math.log(64 / 2)
    assert abs(told["email:once@x.example", "quetzal"] - want) < 1e-9 and abs(told["email:twice@x.example", "yttrium"] - want) < 1e-9


def test_ten_thousand_matches(spark):
    """Time in proportion to the matches: numbers, valid entities and revealing terms."""
    numbers = ", ".join(str(k) for k in range(100_000, 200_000))
    mails = " ".join(f"user{k}@corp{k % 7}.example" for k in range(20_000))
    secret = "zanzibar " * 10_000 + "me@x.org"
    docs = spark.createDataFrame([(1, numbers, "t", "b"), (2, mails, "t", "b"), (3, secret, "t", "b"), (4, "é" * 50_000 + " 1.2.3.4", "t", "b"), *((k, "plain words here", "t", "b") for k in range(5, 60))], "doc_id long, text string, _terms string, _base string")
    at = time.time()
    rows = {r.doc_id: r for r in pii.with_spans(docs).collect()}
    assert time.time() - at < 120
    assert [tuple(s)[:3] for s in rows[2][pii.BASE]] == plain_spans(mails)
    assert [tuple(s)[:3] for s in rows[4][pii.BASE]] == plain_spans(docs.filter("doc_id = 4").first().text)
    assert len(rows[3][pii.TERMS]) == 10_000 and [s.start for s in rows[3][pii.TERMS]] == list(range(0, 90_000, 9))
    assert all((r._terms, r._base) == ("t", "b") for r in rows.values())
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[1] == numbers and clean[2] == " ".join(["<EMAIL>"] * 20_000) and clean[3] == "<TERM> " * 10_000 + "<EMAIL>" and clean[4] == "<TERM> <IP>"


def test_overlapping_spans(spark):
    """Addresses inside a phone number, and letters that touch an address."""
    text = "call +1.2.3.4.5.6.7.8 now éabcd@x.org"
    assert [k for k, *_ in plain_spans(text)] == ["email", "ip", "ip", "phone"]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.sanitised(docs).first().text == "call <PHONE> now é<EMAIL>"


def test_tables_too_large_to_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"write to zebra{'xyz'[i % 3]}@x.org about xylophones and the cartographer{'xyz'[i % 3]}, note {i}") for i in range(40)], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, pii.with_spans(docs, pii.Policy(generalise=0.1)).select("doc_id", pii.written(pii.F.col(pii.TERMS))).collect()))
    small = rows()
    assert any(spans for _, spans in small)
    monkeypatch.setattr(pii, "BROADCAST_BYTES", 0)
    assert not pii.fits(docs) and rows() == small


def shuffled(spark):
    """Bytes that the session's stages have written for shuffles."""
    gateway = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_without_entities_are_not_shuffled(spark, monkeypatch):
    """Random words of three letters make no terms, so that only the joins could ship them."""
    monkeypatch.setattr(pii, "BROADCAST_BYTES", 0)
    rng = random.Random(5)
    plain = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(20_000)) for _ in range(40)]
    texts = [*plain, *(f"write to zebra@x.org about xylophones, {k}" for k in range(4)), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at, least = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = {r.doc_id: r for r in pii.with_spans(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert shuffled(spark) - at < 500_000 < sum(map(len, plain)) / 4
    assert len(rows) == len(texts) and rows[44].text is None and rows[44][pii.TEXT] == ""
    assert all(rows[k][pii.TEXT] == t and not rows[k][pii.BASE] and not rows[k][pii.TERMS] for k, t in enumerate(plain))
    assert all({"about", "xylophones"} <= {s.value for s in rows[k][pii.TERMS]} and [s.kind for s in rows[k][pii.BASE]] == ["email"] for k in range(40, 44))


def test_maybe_has_all_texts_with_spans(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices(("1", "23", ".", " ", "-", "+", "@", "a", "a.b", "(", "4111 1111 1111 1111", "\n"), k=rng.randint(1, 14))) for _ in range(20_000)]
    some = {t for t in texts if plain_spans(t)}
    kept = {r.text for r in spark.createDataFrame([(t,) for t in texts], "text string").filter(pii.F.col("text").rlike(pii.MAYBE)).collect()}
    assert len(some) > 1000 and some <= kept < set(texts)
