"""Resolution of not-modified revisits in web archives (operator 1).

A revisit record says that a page was unchanged. It is joined, as of its time, to the latest earlier full response with the
same canonical URL. Their validators must agree: entity tags if both have one (weakness marks aside), else the times of
last modification, else the payload digests. Then the stored headers are brought up to date with those of the revisit that
a not-modified answer may change.

The as-of join is one window over the records of a URL within a span of time. The last response of each span is carried
into the URL's next span as one more row, so a URL with very many captures is split over as many tasks as it has spans, and what
links them is one row for each span.

Defined cases: a record at the very time of the revisit is not earlier; of responses at one time the largest record_id is the latest; null URLs
and null times never match; a revisit without an earlier response, with validators that differ, or with none to compare, is
returned unresolved with the reason; records of other kinds are ignored; repeated rows are resolved one by one. Null headers
are none; header values are compared and carried whole, whatever their length; other columns of records are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers that a not-modified answer must not change, and query parameters that name visits, not pages.
KEPT_HEADERS = ["connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
VISIT_PARAMETERS = r"^(?:utm_[a-z]+|gclid|fbclid|phpsessid|jsessionid|sid)(?:=|\z)"
#: Seconds of a span.
SPAN_S = 3_600
HEADERS = "array<struct<name:string,value:string>>"


def canonical(url: Column) -> Column:
    """Lower-case scheme and host without user and default port, a path, sorted query parameters without visit names, no fragment."""
    u = F.regexp_replace(F.trim(url), r"#.*\z", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1), "^.*@", ""))
    port = F.when(scheme == "http", F.regexp_replace(host, r":(?:80)?\z", "")).when(scheme == "https", F.regexp_replace(host, r":(?:443)?\z", "")).otherwise(host)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    pairs = F.filter(F.split(F.regexp_extract(u, r"\?(.*)\z", 1), "&"), lambda x: (x != "") & ~F.lower(x).rlike(VISIT_PARAMETERS))
    query = F.array_join(F.array_sort(pairs), "&")
    whole = F.concat(scheme, F.lit("://"), port, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme == "", u).otherwise(whole)


def header(headers: Column, name: str) -> Column:
    """The first value of a header by its name in lower case."""
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def lowered(headers: Column) -> Column:
    """Headers with names in lower case, sorted by name; null as none."""
    plain = F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    return F.array_sort(F.coalesce(plain, F.array().cast(HEADERS)))


def merged(stored: Column, fresh: Column) -> Column:
    """Stored headers, of which those that the fresh ones name and may change are replaced."""
    news = F.filter(fresh, lambda h: ~h["name"].isin(KEPT_HEADERS))
    names = F.transform(news, lambda h: h["name"])
    return F.array_sort(F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"])), news))


def agreement(old: Column, new: Column, old_digest: Column, new_digest: Column) -> Column:
    """Whether the first validator that both have agrees; null if there is none."""
    tag = lambda h: F.regexp_replace(header(h, "etag"), "^W/", "")
    when = lambda h: header(h, "last-modified")
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    return F.when(both(tag(old), tag(new)), tag(old) == tag(new)).when(both(when(old), when(new)), when(old) == when(new)).when(both(old_digest, new_digest), old_digest == new_digest)


def resolved(records: DataFrame, span_s: int = SPAN_S) -> DataFrame:
    """records(record_id, uri, date, kind, headers, digest), kind response or revisit -> a row for each revisit: record_id, url,
    response_id, outcome (resolved, no_response, mismatch, unchecked), headers (merged where resolved, else its own), digest."""
    url = canonical(F.col("uri").cast("string"))
    at = F.col("date").cast("timestamp_ntz")
    plain = records.filter(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("long").alias("record_id"), url.alias("url"), at.alias("date"), F.col("kind"), lowered(F.col("headers")).alias("headers"), F.col("digest").cast("string").alias("digest")
    )
    spanned = plain.withColumn("span", F.floor(F.unix_timestamp("date") / span_s).cast("long"))
    is_response = F.col("kind") == "response"
    full = F.when(is_response & F.col("date").isNotNull(), F.struct("date", "record_id", "headers", "digest"))
    rows = spanned.withColumn("full", full).filter(F.col("url").isNotNull() & F.col("date").isNotNull())
    # the last response of each span, carried to the next span of the URL that has any record
    last = rows.groupBy("url", "span").agg(F.max("full").alias("full"))
    before = Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("url", "span", F.last("full", ignorenulls=True).over(before).alias("full")).filter("full is not null")
    # at one time revisits come before responses, so that only earlier ones are seen
    order = rows.select("url", "span", "date", is_response.cast("int").alias("turn"), "record_id", "kind", "headers", "digest", "full")
    carried = carried.select("url", "span", F.lit(None).cast("timestamp_ntz").alias("date"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("record_id"), F.lit("carried").alias("kind"), F.lit(None).cast(HEADERS).alias("headers"), F.lit(None).cast("string").alias("digest"), "full")
    sofar = Window.partitionBy("url", "span").orderBy(F.asc_nulls_first("date"), "turn", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = order.unionByName(carried).withColumn("found", F.last("full", ignorenulls=True).over(sofar)).filter("kind = 'revisit'")
    out = seen.select("record_id", "url", "headers", "digest", "found")
    never = spanned.filter("kind = 'revisit' and (url is null or date is null)").select("record_id", "url", "headers", "digest", F.lit(None).cast(out.schema["found"].dataType).alias("found"))
    every = out.unionByName(never)
    agree = agreement(F.col("found.headers"), F.col("headers"), F.col("found.digest"), F.col("digest"))
    outcome = F.when(F.col("found").isNull(), "no_response").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    judged = every.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return judged.select(
        "record_id",
        "url",
        F.col("found.record_id").alias("response_id"),
        "outcome",
        F.when(good, merged(F.col("found.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(good, F.col("found.digest")).otherwise(F.col("digest")).alias("digest"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl over pages(page_id, url, html), four for each page. The page itself is a full response and, some time later, a revisit
    whose URL is written another way; entity tags come from the html, every seventh revisit has a stale one, every eleventh none. With each page the front
    page of its host is captured and later revisited, so hosts have long histories: front pages change, four captures have one time, revisits fall between
    responses and on their very times, and every fourth has no entity tag but a time of modification."""
    n = F.col("page_id")
    base = F.lit(1_700_000_000) + F.floor(n / 4) * 244
    moment = lambda s: F.timestamp_seconds(s).cast("timestamp_ntz")
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    front = F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("/"))
    front_tag, changed = F.concat(F.lit('"f'), n % 5, F.lit('"')), F.concat(F.lit("day "), n % 2)

    def listed(**values: Column) -> Column:
        return F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("name"), v.alias("value")) for k, v in values.items()))

    def record(k: int, uri: Column, at: Column, kind: str, headers: Column, digest: Column) -> Column:
        return F.struct((n * 4 + k).alias("record_id"), uri.alias("uri"), moment(at).alias("date"), F.lit(kind).alias("kind"), headers.alias("headers"), digest.alias("digest"))

    first = listed(Content_Type=F.lit("text/html"), ETag=tag, Cache_Control=F.lit("max-age=60"), Server=F.concat(F.lit("s"), n % 9))
    stale = F.when(n % 7 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag))
    again = listed(Content_Type=F.lit("text/plain"), Cache_Control=F.concat(F.lit("max-age="), n % 100), Age=(n % 13).cast("string"))
    again = F.when(n % 11 == 0, again).otherwise(F.concat(again, listed(ETag=stale)))
    other = F.when(n % 3 == 0, F.concat(F.col("url"), F.lit("#top"))).otherwise(F.regexp_replace("url", "^http://", "HTTP://"))
    front_first = listed(Content_Type=F.lit("text/html"), ETag=front_tag, Last_Modified=changed, Server=F.concat(F.lit("s"), n % 9))
    front_again = listed(Cache_Control=F.concat(F.lit("max-age="), n % 100), Last_Modified=changed)
    front_again = F.when(n % 4 == 1, front_again).otherwise(F.concat(front_again, listed(ETag=F.concat(F.lit("W/"), front_tag))))
    none = F.lit(None).cast("string")
    records = F.array(
        record(0, F.col("url"), base, "response", first, F.sha2("html", 256)),
        record(1, other, base + (n % 5) * 40_000 + 7, "revisit", again, none),
        record(2, front, base + 10, "response", front_first, F.sha2(front_tag, 256)),
        record(3, F.concat(front, F.lit("?utm_source=x")), base + (n % 3) * 2440 + 10, "revisit", front_again, none),
    )
    return pages.select(F.explode(records).alias("r")).select("r.*")
