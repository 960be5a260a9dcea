"""Information-theoretic sanitisation of personal data (operator 2), in DataFrame and SQL functions only.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that fixed patterns find. A term (a run
of at least MIN_LETTERS letters, A-Z lowered) in a document of an entity reveals it as far as the corpus says so: with
N documents, n(e), n(t) that contain entity and term, and n(e,t) that contain both, the share of
the entity's information that the term discloses is log(N n(e,t) / (n(e) n(t))) / log(N / n(e)): 1 if the term
never occurs without the entity, 0 if they are independent. In documents that hold such a term and such an entity,
all the term's occurrences are generalised to a placeholder from one threshold on and removed from a higher one on.
Evidence is counted in different texts, so that copies are one piece of it, and asked for by what the entity has: the term
must be in half of the entity's texts or in Policy.texts of them. So entities of one or two texts are judged by these. As a
term may meet them by chance, n(t) counts one document more for pairs in fewer than Policy.texts texts.

Base spans come from the patterns alone. The patterns are written with possessive quantifiers and a look at the
character before, which changes no match but keeps long runs from being scanned again from each of their characters.
Places of matches are running sums, taken over blocks of BLOCK matches and then over the blocks' sums, so that a text with very many matches takes
time in proportion to them.

Defined cases: null text counts as empty and stays null in sanitised output; a null doc_id is a document like any other; repeated rows count
as documents each; entities in every document disclose nothing further; an empty table gives an empty result; a disclosure at a threshold
has reached it. Texts are read whole, whatever their length. Other columns of docs pass through, whatever their names: new columns and those used on the way
begin with `__quern_`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, quoted, stored

# The kinds in order, with the pattern of each.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
MIN_LETTERS = 4
SPAN = "struct<kind:string,start:int,stop:int,value:string>"
#: What each text with a valid base span has, and few others have.
MAYBE = r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]|\+[0-9][\x20().0-9-]+[0-9]|[0-9](?:\.[0-9]++\.[0-9]++\.[0-9]|(?:[\x20-]?[0-9]){15})"
#: Rows and bytes up to which a table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20

#: Elements that one step of a running sum adds to an array.
BLOCK = 256
#: Columns that with_spans() adds: the text (never null), base spans, and spans of revealing terms.
TEXT, BASE, TERMS = "__quern_text", "__quern_base", "__quern_terms"


@dataclass(frozen=True)
class Policy:
    """The different texts that are evidence enough for any pair, and the disclosure thresholds."""

    texts: int = 3
    generalise: float = 0.8
    remove: float = 0.95


def let(value: Column, use) -> Column:
    """use(value) with the value made once, however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_blocks(values: Column) -> Column:
    """An array in arrays of BLOCK elements."""

    def cut(v: Column) -> Column:
        n = F.ceil(F.size(v) / BLOCK).cast("int")
        return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), 1, n), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))

    return let(values, cut)


def before(values: Column, start: Column, add) -> Column:
    """For each element what `add` makes of start and the elements before it. Quadratic, for short arrays."""
    empty = F.array().cast("array<int>")
    return F.aggregate(values, F.struct(start.cast("int").alias("at"), empty.alias("out")), lambda acc, x: F.struct(add(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def running(values: Column, add) -> Column:
    """before(values, 0, add) for arrays of any length; add is associative and 0 changes nothing."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda acc, v: add(acc, v).cast("int"))
    return let(in_blocks(values), lambda parts: F.flatten(F.zip_with(parts, before(F.transform(parts, total), F.lit(0), add), lambda x, at: before(x, at, add))))


def located(text: Column, matches: Column, pattern: Column, kind: str) -> Column:
    """Spans of matches, found by regexp_extract_all, from the lengths of what stands between them. Code points, end exclusive."""
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.length(g) + F.length(m))
    ends = let(lengths, lambda n: F.zip_with(n, running(n, lambda a, b: a + b), lambda x, at: x + at))
    spans = F.zip_with(matches, ends, lambda m, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("stop"), m.alias("value")))
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def furthest(spans: Column, make) -> Column:
    """make(span, at) for each of spans sorted by start, at being the furthest end of those before it."""
    return F.zip_with(spans, running(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b)), make)


def replaced(text: Column, spans: Column, label) -> Column:
    """text with label(span) in the place of each span. Spans are sorted by start; one that begins inside an earlier one is passed over."""

    def pieces(some: Column) -> Column:
        # a block's stretch of text is cut out once, then its pieces from it
        first = F.get(some, F.lit(0))["at"]
        stretch = F.substring(text, first + 1, F.element_at(some, -1)["start"] - first)
        return let(stretch, lambda t: F.array_join(F.transform(some, lambda s: F.concat(F.substring(t, s["at"] - first + 1, s["start"] - s["at"]), label(s))), ""))

    def whole(v: Column) -> Column:
        placed = furthest(v, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
        head = F.array_join(F.transform(in_blocks(F.filter(placed, lambda s: s["start"] >= s["at"])), pieces), "")
        end = F.array_max(F.transform(v, lambda s: s["stop"]))
        return F.concat(head, F.substring(text, end + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(spans, whole)).otherwise(text)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$")),
    "card": lambda s: F.length(digits(s["value"])).between(16, 19) & luhn(digits(s["value"])),
    "phone": lambda s: F.length(digits(s["value"])).between(8, 15),
}


def with_base_spans(docs: DataFrame, text: Column) -> DataFrame:
    """docs with TEXT (never null) and BASE, the base spans by kind and start."""
    out = docs.withColumn(TEXT, text)
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all(TEXT, F.lit(pattern), F.lit(0))
        if kind == "email":
            found = F.when(F.contains(TEXT, F.lit("@")), found).otherwise(F.array().cast("array<string>"))
        out = out.withColumn(f"__quern_m_{kind}", found)
    for kind, pattern in PATTERNS.items():
        out = out.withColumn(f"__quern_s_{kind}", located(F.col(TEXT), F.col(f"__quern_m_{kind}"), F.lit(pattern), kind))
    base = F.concat(*(F.filter(f"__quern_s_{kind}", VALID[kind]) for kind in PATTERNS))
    return out.withColumn(BASE, base).drop(*(f"__quern_{x}_{kind}" for kind in PATTERNS for x in "ms"))


TERM = f"{LETTERS}{{{MIN_LETTERS},}}"


def terms_of(piece: Column) -> Column:
    return F.regexp_extract_all(piece, F.lit(TERM), F.lit(0))


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def mentions(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, its distinct entities and, if it has any, sha (of its text), its distinct terms, and masked: its text
    with A-Z lowered and each character that an entity covers as X, a letter that no term has."""
    base = with_base_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), text_of(docs))
    some = F.size(BASE) > 0
    by_start = F.array_sort(F.transform(BASE, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    base = base.withColumn("lower", F.when(some, ascii_lower(F.col(TEXT)))).withColumn("spans", merged(by_start))
    entities = F.array_distinct(F.transform(BASE, lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    terms = F.when(some, F.array_distinct(terms_of(F.col("lower")))).otherwise(F.array().cast("array<string>"))
    masked = F.when(some, replaced(F.col("lower"), F.col("spans"), lambda s: F.repeat(F.lit("X"), s["stop"] - s["start"])))
    return base.select("doc_id", F.when(some, F.sha2(TEXT, 256)).alias("sha"), entities.alias("entities"), terms.alias("terms"), masked.alias("masked"))


def different(seen: DataFrame) -> DataFrame:
    """The different texts with entities of mentions(): a number (at), sha, n (rows with this text), entities, terms and masked. Equal texts have equal ones."""
    rest = (F.first(c).alias(c) for c in ("entities", "terms", "masked"))
    found = seen.filter(F.size("entities") > 0).groupBy("sha").agg(F.count("*").alias("n"), *rest)
    return stored(found.withColumn("at", F.monotonically_increasing_id()), "texts")


def pairs_of(seen: DataFrame, terms: DataFrame) -> DataFrame:
    """The columns of seen but for its arrays, with each entity and each of the given terms that a row has."""
    rest = [c for c in seen.columns if c not in ("entities", "terms")]
    some = seen.select(*rest, "entities", F.explode("terms").alias("term")).join(within(terms), "term")
    return some.select(*rest, "term", F.explode("entities").alias("entity"))


def fits(small: DataFrame) -> bool:
    """Whether a written table is small enough to broadcast, in rows and in bytes; both are summed on the executors."""
    wide = {"string": F.octet_length, "bigint": lambda c: F.lit(8), "double": lambda c: F.lit(8)}
    size = sum((F.coalesce(wide.get(kind, lambda c: F.octet_length(F.to_json(c)))(F.col(name)), F.lit(0)) for name, kind in small.dtypes), F.lit(0))
    n, size = small.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def within(small: DataFrame) -> DataFrame:
    """A broadcast hint, if the written table fits."""
    return F.broadcast(small) if fits(small) else small


def disclosures(docs: DataFrame, seen: DataFrame, policy: Policy, texts: DataFrame | None = None) -> DataFrame:
    """(entity, term, disclosure) of the pairs whose disclosure reaches the lower threshold; seen is mentions(docs), texts is different(seen)."""
    n_docs = seen.count()
    texts = (different(seen) if texts is None else texts).select("n", "entities", "terms")
    entities = texts.select("n", F.explode("entities").alias("entity")).groupBy("entity")
    entities = stored(entities.agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts")), "entities")
    most = entities.agg(F.max("n_entity")).first()[0] or 0

    def share(n_term: str) -> Column:
        smooth = F.col(n_term) + F.when(F.col("both") < policy.texts, 1).otherwise(0)
        told = F.log(F.lit(n_docs) * F.col("n_both") / (F.col("n_entity") * smooth)) / F.log(F.lit(n_docs) / F.col("n_entity"))
        return F.when(F.col("n_entity") < n_docs, told).otherwise(0.0)

    # a term is in at least the documents where it meets any entity, so these bound its disclosure from above, and that for the
    # most frequent entity bounds all: words that meet many entities are out before pairs are made and the corpus is counted
    around = texts.select("n", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("n").alias("n_near"))
    bound = F.log(F.lit(n_docs) / F.col("n_near")) >= policy.generalise * math.log(n_docs / most) - 1e-9 if 0 < most < n_docs else F.lit(True)
    around = stored(around.filter(bound), "around")
    both = pairs_of(texts, around.select("term")).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("both"))
    known = both.join(within(entities), "entity").filter((F.col("both") >= policy.texts) | (2 * F.col("both") >= F.col("texts")))
    known = known.join(within(around), "term").filter(share("n_near") >= policy.generalise)
    known = stored(known, "pairs")
    if known.isEmpty():
        return known.select("entity", "term", F.lit(0.0).alias("disclosure"))
    wanted = stored(known.select("term").distinct(), "terms")
    words = docs.select(F.explode(F.array_distinct(terms_of(ascii_lower(text_of(docs))))).alias("term"))
    # where the wanted terms are few, only these are counted; else each word goes once a task to the join, however frequent it is
    few = fits(wanted)
    if few:
        words = words.join(F.broadcast(wanted), "term")
    words = words.groupBy("term").agg(F.count("*").alias("n_term"))
    words = words if few else words.join(wanted, "term")
    return known.join(words, "term").select("entity", "term", share("n_term").alias("disclosure")).filter(F.col("disclosure") >= policy.generalise)


def revealing(docs: DataFrame, policy: Policy) -> DataFrame | None:
    """(sha, terms) of the texts with revealing terms: spans of these outside base spans, of kind `generalise` or `remove`; None if there are none."""
    seen = stored(mentions(docs), "mentions")
    texts = different(seen)
    told = stored(disclosures(docs, seen, policy, texts), "told")
    if told.isEmpty():
        return None
    known = stored(told.select("term").distinct(), "told-terms")
    mine = pairs_of(texts.select("at", "entities", "terms"), known).join(within(told), ["entity", "term"])
    mine = stored(mine.groupBy("at", "term").agg(F.max("disclosure").alias("disclosure")), "mine")
    # what an entity covers already is the entity's
    runs = stored(texts.select("at", "masked", terms_of(F.col("masked")).alias("found")).select("at", located(F.col("masked"), F.col("found"), F.lit(TERM), "term").alias("runs")), "runs")
    words = runs.select("at", F.explode("runs").alias("run")).select("at", "run.start", "run.stop", F.col("run.value").alias("term"))
    hits = words.join(within(mine), ["at", "term"])
    kind = F.when(F.col("disclosure") >= policy.remove, "remove").otherwise("generalise")
    span = F.struct("start", "stop", kind.alias("kind"), F.col("term").alias("value"))
    spans = hits.groupBy("at").agg(F.array_sort(F.collect_set(span)).alias("terms"))
    ordered = F.transform("terms", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")))
    return stored(spans.join(texts.select("at", "sha"), "at").select("sha", ordered.alias("terms")), "revealing")


def merged(spans: Column) -> Column:
    """Spans sorted by start that overlap no more: each begins where those before it end."""
    cut = let(spans, lambda v: furthest(v, lambda s, at: F.struct(F.greatest(s["start"], at).alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.filter(cut, lambda s: s["start"] < s["stop"])


def with_spans(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """docs, all columns, with TEXT, BASE (base spans) and TERMS (spans of revealing terms, kind `generalise` or `remove`)."""
    found = revealing(docs, policy)
    none = F.array().cast(f"array<{SPAN}>")
    if found is None:
        return with_base_spans(docs, text_of(docs)).withColumn(TERMS, none)
    # texts without entities have no spans of either sort, so they need no join; those with them are joined by what they say
    maybe = text_of(docs).rlike(MAYBE)
    mine = within(found).select(F.col("sha").alias("__quern_other"), F.col("terms").alias("__quern_found"))
    keyed = docs.filter(maybe).withColumn("__quern_sha", F.sha2(text_of(docs), 256))
    joined = keyed.join(mine, F.col("__quern_sha") == F.col("__quern_other"), "left").drop("__quern_other", "__quern_sha")
    marked = with_base_spans(joined, text_of(joined)).withColumn(TERMS, F.coalesce("__quern_found", none)).drop("__quern_found")
    return marked.union(docs.filter(~maybe).withColumn(TEXT, text_of(docs)).withColumn(BASE, none).withColumn(TERMS, none))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def sanitised(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """docs, same columns, with text sanitised: entities and generalised terms become <KIND> placeholders, removed terms go."""
    marked = with_spans(docs, policy)
    spans = F.array_sort(F.transform(F.concat(BASE, TERMS), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    label = lambda s: F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", "<TERM>").otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    marked = marked.withColumn("__quern_spans", spans)
    text = F.when(F.size("__quern_spans") > 0, replaced(F.col(TEXT), F.col("__quern_spans"), label)).otherwise(F.col("text").cast("string"))
    return marked.select(*(text.alias(c) if c.lower() == "text" else q for c, q in zip(docs.columns, quoted(docs.columns), strict=True)))
