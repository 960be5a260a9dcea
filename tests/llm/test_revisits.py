"""Operator 1 against a plain version."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import queries, revisits

KINDS = "record_id long, uri string, date timestamp_ntz, kind string, headers array<struct<name:string,value:string>>, digest string, url string"


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://User:pw@EXAMPLE.com:80/A/b?z=1&a=2&utm_source=x&PHPSESSID=3#frag", "http://example.com/A/b?a=2&z=1"),
        ("https://Example.com:443", "https://example.com/"),
        ("https://example.com:80/", "https://example.com:80/"),
        ("http://h?q", "http://h/?q"),
        ("http://h/?sidebar=1", "http://h/?sidebar=1"),
        (" no scheme#x", "no scheme"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(revisits.canonical(F.col("u"))).first()[0] == want


def plain(records):
    out = []
    for i, uri, date, kind, headers, digest, _ in records:
        if kind != "revisit":
            continue
        own = {k.lower(): v for k, v in headers or []}
        before = [r for r in records if r[3] == "response" and uri is not None and r[1] == uri and date and r[2] and r[2] < date]
        if not before:
            out.append((i, None, "no_response", own, digest))
            continue
        last = max(before, key=lambda r: (r[2], r[0]))
        old = {k.lower(): v for k, v in last[4] or []}
        tag = lambda h: h["etag"].removeprefix("W/") if "etag" in h else None
        agree = None
        for a, b in ((tag(old), tag(own)), (old.get("last-modified"), own.get("last-modified")), (last[5], digest)):
            if a is not None and b is not None:
                agree = a == b
                break
        if agree:
            out.append((i, last[0], "resolved", old | {k: v for k, v in own.items() if k not in revisits.KEPT_HEADERS}, last[5]))
        else:
            out.append((i, last[0], "unchecked" if agree is None else "mismatch", own, digest))
    return out


@pytest.mark.parametrize("span", [60, 86_400])
def test_against_plain(spark, span):
    rng = random.Random(span)
    start = dt.datetime(2024, 1, 1)
    records = []
    for i in range(400):
        headers = [(k, rng.choice("123")) for k in ("ETag", "Last-Modified", "Content-Type", "Server", "X-A") if rng.random() < 0.6]
        if rng.random() < 0.3:
            headers = [(k, f"W/{v}" if k == "ETag" else v) for k, v in headers]
        # one URL has half of all records
        uri = rng.choice(["http://hot/", "http://hot/", "http://a/", "http://b/?x", None])
        date = None if rng.random() < 0.05 else start + dt.timedelta(seconds=rng.randrange(0, 1200, 20))
        records.append((i, uri, date, rng.choice(["response", "revisit", "revisit", "request"]), headers if rng.random() < 0.9 else None, rng.choice([None, "d1", "d2"]), "clash"))
    records += [r for r in records if r[3] == "revisit"][:5]
    df = spark.createDataFrame(records, KINDS)
    got = [(r.record_id, r.response_id, r.outcome, {h.name: h.value for h in r.headers}, r.digest) for r in revisits.resolved(df, span).collect()]
    assert sorted(map(str, got)) == sorted(str((i, b, o, dict(sorted(h.items())), d)) for i, b, o, h, d in plain(records))
    assert {o for _, _, o, _, _ in got} == {"resolved", "mismatch", "unchecked", "no_response"}
    assert revisits.resolved(df.limit(0), span).count() == 0


def test_query_chooses_among_histories(spark):
    got = queries.op1_revisit_asof(spark, "/root/testdata/sf0.01").selectExpr("*", "response_id div 4 = record_id div 4 as own").collect()
    assert len(got) == 500 and {r.outcome for r in got} == {"resolved", "mismatch", "unchecked", "no_response"}
    assert sum(r.own is False for r in got) > 50
