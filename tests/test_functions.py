"""Column functions, validation and caches."""

import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from quern.cache import Cache, QueryCache
from quern.functions import hashing, jsoncol, text, tokens, validation


def one(spark, value, f, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(f("x").alias("y")).first()[0]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (text.sql_cleared, "it's -- DROP /*x*/ Table; dropped exec EXECUTE", "it''s  drp x Table dropped exc exc"),
        (text.sql_cleared, None, ""),
        (text.tags_cleared, "a<b>c</b> <> d", "ac <> d"),
        (text.stripped_html, "<html><HEAD><title>x</title></head>a\n<p>b<br/>c<li>d &amp; e&nbsp;f &copy; &foo; <td>g<script>no</script>", "a \r\rb\rc\rd & e f (c)  \tg"),
        (text.stripped_html, "", ""),
        (text.slug, "  Çılgın Öğün -- Şu & bu!  ", "cilgin-ogun-su-bu"),
        (text.is_email, "a.b+c@x-y.org", True),
        (text.is_email, "a@b", False),
        (text.is_url, "example.com/a b", True),
        (text.is_url, "http://" + "a" * 200 + "!", False),
        (text.is_blank, " \t　", True),
        (hashing.rot13, "Hello, É!", "Uryyb, É!"),
        (hashing.md5_hex, "", ""),
        (hashing.digest, "", hashlib.sha256(b"").hexdigest()),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_truncated(spark):
    cut = lambda c: text.truncated(c, 5)
    assert one(spark, "abcdef", cut) == "ab..." and one(spark, "abcde", cut) == "abcde" and one(spark, None, cut) is None
    with pytest.raises(ValueError):
        text.truncated("x", 2)
    assert one(spark, "", lambda c: text.default_if_empty(c, "d")) == "d"
    assert one(spark, "a b&~*ç", lambda c: text.built_url(F.lit("http://h/p?z=1"), {"q k": c})) == "http://h/p?z=1&q%20k=a%20b%26~%2A%C3%A7"


@pytest.mark.parametrize("key", ["k", "x" * 100])
@pytest.mark.parametrize("kind", ["sha1", "sha256"])
def test_hmac(spark, key, kind):
    assert one(spark, "text é", lambda c: hashing.hmac_hex(c, key, kind)) == hmac.new(key.encode(), "text é".encode(), kind).hexdigest()
    assert one(spark, "", lambda c: hashing.hmac_hex(c, key, kind)) == ""
    with pytest.raises(ValueError):
        hashing.hmac_hex("x", "")


def test_encryption(spark):
    for mode in ("CBC", "GCM"):
        assert one(spark, "secret ü", lambda c, mode=mode: hashing.decrypted(hashing.encrypted(c, "key", mode), "key", mode)) == "secret ü"
    assert len(base64.b64decode(one(spark, "x", lambda c: hashing.encrypted(c, "key", "CBC")))) == 16
    assert [len(hashing.legal_key("k" * n)) for n in (0, 1, 16, 17, 24, 25, 40)] == [16, 16, 16, 24, 24, 32, 32]
    assert one(spark, "a", lambda c: hashing.digest_base64(c, "md5")) == base64.b64encode(hashlib.md5(b"a").digest()).decode()


def test_random(spark):
    row = spark.range(50).select(hashing.random_code(8).alias("c"), hashing.guid(False).alias("g"), hashing.random_bytes(40).alias("b"))
    rows = row.collect()
    assert all(len(r.c) == 8 and set(r.c) <= set(hashing.CODE_CHARACTERS) and len(r.g) == 32 and len(r.b) == 40 for r in rows) and len({r.c for r in rows}) > 45


def test_json(spark):
    obj = '{"a":1,"b":{"c":"x"},"d":null}'
    assert one(spark, obj, lambda c: jsoncol.get(c, "a", "int")) == 1 and one(spark, obj, lambda c: jsoncol.get(c, "zz")) is None
    assert one(spark, obj, lambda c: jsoncol.has_key(c, "b")) and not one(spark, None, lambda c: jsoncol.has_key(c, "b"))
    assert one(spark, obj, lambda c: jsoncol.put(c, "a", F.lit('q"'))) == '{"b":{"c":"x"},"d":null,"a":"q\\""}'
    assert one(spark, obj, lambda c: jsoncol.remove(c, "b")) == '{"a":1,"d":null}'
    assert one(spark, '["a","b","a"]', lambda c: jsoncol.drop_first(c, F.lit("a"))) == '["b","a"]'
    assert one(spark, '["a"]', lambda c: jsoncol.drop_first(c, F.lit("z"))) == '["a"]'
    assert one(spark, '["a"]', lambda c: jsoncol.append(c, F.lit("b"))) == '["a","b"]' and one(spark, None, lambda c: jsoncol.append(c, F.lit("b"))) == '["b"]'
    assert one(spark, "[5,6]", lambda c: jsoncol.item(c, 1, "int")) == 6 and one(spark, "[5]", lambda c: jsoncol.item(c, 3, "int")) is None
    assert one(spark, "", lambda c: jsoncol.deserialised(c, "array<int>")) is None and one(spark, "[1,2]", jsoncol.length) == 2


def test_tokens(spark):
    good = tokens.issue({"sub": "1", "n": 2}, "k", issuer="me", audience="you")
    check = lambda t, **kw: one(spark, t, lambda c: tokens.fault(c, kw.pop("secret", "k"), **kw))
    assert check(good, issuer="me", audience="you") is None and check(good, secret="other") == "signature"
    assert check(good, issuer="x") == "issuer" and check(good, audience="x") == "audience" and check("") == "empty" and check("a.b") == "format"
    assert check(tokens.issue({}, "k", 1, now=0)) == "expired" and check(tokens.issue({}, "k", now=4e9)) == "early"
    assert one(spark, good, lambda c: tokens.claim(c, "n")) == "2" and check(tokens.refreshed(good, "k")) is None
    with pytest.raises(ValueError):
        tokens.refreshed(good, "other")


@pytest.mark.parametrize(
    "rule, good, bad",
    [
        ("required", ["a"], [None, "", " \t"]),
        ("email", ["a@b.c", "", None], ["a@b", "a b@c.d"]),
        ("url", ["http://a", "HTTPS://a.b/c"], ["ftp://a", "a.b"]),
        ("numeric", ["1", "-1.5", "1,234.5"], ["a", "1.2.3"]),
        ("integer", ["12", " -3 "], ["1.5", "99999999999"]),
        ("boolean", ["TRUE", "no", "0"], ["2"]),
        ("date", ["2024-02-29", "2024-01-01 10:00:00"], ["2023-02-29", "x"]),
        ("min:3", ["3", "abc", "12.5"], ["2.9", "ab", "", None]),
        ("max:3", ["3", "abc", "", "-7"], ["3.1", "abcd"]),
        ("between:2,4", ["2", "abc", "4"], ["1", "abcde"]),
        ("length:2", ["ab"], ["a", ""]),
        ("alpha", ["abcŞ"], ["a1"]),
        ("alpha_num", ["a1"], ["a-1"]),
        ("alpha_dash", ["a-1_"], ["a 1"]),
        ("in:a,b", ["a"], ["c"]),
        ("not_in:a,b", ["c"], ["a"]),
        ("starts_with:a,b", ["bx"], ["cx"]),
        ("ends_with:a,b", ["xb"], ["xc"]),
        ("uuid", ["123e4567-e89b-12d3-a456-426614174000", "{123E4567-e89b-12d3-a456-426614174000}", "123e4567e89b12d3a456426614174000"], ["123"]),
        ("ip", ["1.2.3.4", "::1", "2001:db8::8a2e:370:7334", "::ffff:1.2.3.4"], ["1.2.3", "256.1.1.1", "1::2::3"]),
        ("json", ['{"a":1}', " [1] "], ["x", "{"]),
        ("phone", ["+90 (532) 123-4567"], ["12345"]),
        ("credit_card", ["4111-1111-1111-1111"], ["4111-1111-1111-1112"]),
        ("tc_kimlik", ["10000000146"], ["10000000145", "01234567890"]),
        ("iban", ["GB82 WEST 1234 5698 7654 32"], ["GB82 WEST 1234 5698 7654 33", "??"]),
        ("after:2024-01-01", ["2024-01-02", "unreadable"], ["2024-01-01"]),
        ("before:2024-01-01 10:30:00", ["2024-01-01 10:29:59"], ["2024-01-01 10:30:00"]),
        ("password", ["Abcdefg1"], ["abcdefg1", "Abc1", "ABCDEFG1", "Abcdefgh"]),
    ],
)
def test_rules(spark, rule, good, bad):
    (name, args), = validation.read_rules(rule)
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "x string, want boolean")
    wrong = df.filter(validation.passes("x", name, args) != F.col("want")).collect()
    assert not wrong


def test_between_looks_at_empty_values(spark):
    df = spark.createDataFrame([(None,), ("",), ("abc",)], "x string")
    assert [[r.ok for r in df.select(validation.passes("x", "between", [low, "4"]).alias("ok")).collect()] for low in ("2", "0")] == [[False, False, True], [True, True, True]]


def test_checks(spark):
    df = spark.createDataFrame([("Ann", "Abcdefg1", "Abcdefg1", 5), ("", "short", "other", -1)], "name string, pw string, pw_confirmation string, n int")
    rules = {"name": "required|max:10", "pw": ["password", "confirmed", "regex:^[A-Za-z0-9|:,]+$"], "n": "min:0"}
    c = validation.check(df, rules, {"name.required": "who?"})
    assert c.fails() and c.passing().count() == 1 and c.validated().columns == ["name", "pw", "n"]
    found = {(r.field, r.rule): r.message for r in c.all_errors().collect()}
    assert set(found) == {("name", "required"), ("pw", "password"), ("pw", "confirmed"), ("n", "min")} and found["name", "required"] == "who?"
    assert found["pw", "password"] == "pw needs at least 8 characters"
    assert c.failing().select(c.first_error("pw"), c.has_error("n")).first()[1]
    with pytest.raises(validation.ValidationError):
        c.or_fail()
    assert validation.check(df.limit(1), rules).or_fail().count() == 1
    with pytest.raises(ValueError):
        validation.errors({"x": "nonsense"})


def test_cache():
    now = [0.0]
    c = Cache(ttl=10, clock=lambda: now[0])
    c.set("a", 1, tags=["t"])
    c.set("b", 2, ttl=None)
    assert c.get("a") == 1 and c.add("c", 3) and not c.add("c", 4) and c.increment("n") == 1 and c.decrement("n", 3) == -2
    assert c.remember("a", lambda: 9) == 1 and c.remember_forever("z", lambda: 9) == 9 and c.pull("z") == 9 and not c.has("z")
    now[0] = 11
    assert not c.has("a") and c.get("a", "gone") == "gone" and c.get("b") == 2 and c.clean() == 2 and c.keys() == ["b"]
    c.set("p:1", 1, tags=["t"]), c.set("p:2", 1)
    assert c.forget_tag("t") == 1 and c.forget_prefix("p:") == 1 and len(c) == 1 and 0 < c.stats.ratio < 1
    c.enabled = False
    assert c.get("b") is None
    c.flush()


def test_query_cache(spark):
    q = QueryCache()
    a = spark.range(5).filter("id > 1")
    one = q.remember(a, tables={"T": "v1"})
    assert q.remember(spark.range(5).filter("id > 1"), tables={"T": "v1"}) is one and one.is_cached
    assert q.remember(spark.range(5).filter("id > 2"), tables={"T": "v1"}) is not one and q.remember(spark.range(5).filter("id > 1"), tables={"T": "v2"}) is not one
    assert q.forget_table("t") == 3 and not one.is_cached


def test_a_pattern_may_hold_bars(spark):
    assert validation.read_rules("required|regex:^(a|b)$") == [("required", []), ("regex", ["^(a|b)$"])]
    assert validation.read_rules("regex:a|b") == [("regex", ["a|b"])] and validation.read_rules(["regex:a|b", "max:3"])[1] == ("max", ["3"])
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    assert [r.ok for r in df.select(F.size(validation.errors({"v": "required|regex:^(a|b)$"})).alias("n")).selectExpr("n = 0 as ok").collect()] == [True, True, False]
