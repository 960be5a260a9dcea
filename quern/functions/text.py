"""Text functions as Column expressions. Unless said otherwise null and empty input give the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that sql_cleared() shortens, in this order, and what they become.
SQL_WORDS = [("drop", "drp"), ("alter", "atr"), ("delete", "dl"), ("truncate", "trnc"), ("exec", "exc"), ("execute", "exc")]
# What sql_cleared() deletes, in this order, after quotes are doubled.
SQL_MARKS = ["--", "/*", "*/", ";"]
# Entities that stripped_html() decodes, in this order.
ENTITIES = [("nbsp", " "), ("bull", " * "), ("lsaquo", "<"), ("rsaquo", ">"), ("trade", "(tm)"), ("frasl", "/"), ("lt", "<"), ("gt", ">"), ("copy", "(c)"), ("reg", "(r)"), ("amp", "&")]
# Turkish letters and their plain forms in slugs.
TURKISH = ("ığüşöç", "igusoc")
# The strict e-mail pattern, and the host part of the URL pattern whose path may be any path characters.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"(?i)^(https?://)?[\da-z.-]+\.[a-z.]{2,6}[/\w .-]*/?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def sql_cleared(c: Column | str) -> Column:
    """Doubles quotes, deletes comment marks and semicolons, shortens statement words. Bound parameters are the real defence."""
    out = F.replace(or_empty(c), F.lit("'"), F.lit("''"))
    for mark in SQL_MARKS:
        out = F.replace(out, F.lit(mark), F.lit(""))
    for word, short in SQL_WORDS:
        out = F.regexp_replace(out, rf"(?iU)\b{word}\b", short)
    return out


def tags_cleared(c: Column | str) -> Column:
    """Without anything between angle brackets."""
    return F.regexp_replace(or_empty(c), "<[^>]+>", "")


def stripped_html(c: Column | str) -> Column:
    """Plain text of HTML with line breaks (carriage returns) and tabs for its structure. A head, script or style goes from its first opening to its last closing tag."""
    out = F.regexp_replace(F.translate(or_empty(c), "\r\n\t", "  "), " +", " ")
    for tag in ("head", "script", "style"):
        out = F.regexp_replace(out, rf"(?i)< *{tag}[^>]*>.*< */ *{tag} *>", "")
    for pattern, becomes in ((r"td[^>]*", "\t"), (r"br *(?:/)? *", "\r"), (r"li *", "\r"), (r"div[^>]*", "\r\r"), (r"tr[^>]*", "\r\r"), (r"p[^>]*", "\r\r")):
        out = F.regexp_replace(out, rf"(?i)< *{pattern}>", becomes)
    out = F.regexp_replace(out, "<[^>]*>", "")
    for name, becomes in ENTITIES:
        out = F.regexp_replace(out, f"(?i)&{name};", becomes)
    out = F.regexp_replace(out, r"(?d)&.{2,6};", "")
    out = F.regexp_replace(F.regexp_replace(out, "\r +\r", "\r\r"), "\r{3,}", "\r\r")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def truncated(c: Column | str, most: int, suffix: str = "...") -> Column:
    """At most `most` characters, the last of which are the suffix if anything is cut. Null stays null."""
    if most < len(suffix):
        raise ValueError("the suffix is longer than the whole")
    text = col(c)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix))).otherwise(text)


def slug(c: Column | str) -> Column:
    """Lower case, plain letters and digits with single hyphens between them."""
    plain = F.regexp_replace(F.translate(F.lower(or_empty(c)), *TURKISH), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\s+", "-"), "-+", "-"), "^-|-$", "")


def is_email(c: Column | str) -> Column:
    return or_empty(c).rlike(EMAIL)


def is_url(c: Column | str) -> Column:
    """Host with a dot, optional scheme and path. Written without nested repeats, so it cannot backtrack without end."""
    return or_empty(c).rlike(URL)


def is_empty(c: Column | str) -> Column:
    return or_empty(c) == ""


def is_blank(c: Column | str) -> Column:
    return or_empty(c).rlike(r"(?U)^\s*$")


def default_if_empty(c: Column | str, default: str) -> Column:
    return F.when(is_empty(c), F.lit(default)).otherwise(col(c))


def built_url(base: Column | str, params: dict[str, Column | str]) -> Column:
    """base with the parameters percent-encoded; values that are strings name columns."""

    def encoded(x: Column) -> Column:
        return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))

    if not params:
        return col(base)
    query = F.concat_ws("&", *(F.concat(encoded(F.lit(k)), F.lit("="), encoded(or_empty(F.col(v).cast("string") if isinstance(v, str) else v))) for k, v in params.items()))
    return F.concat(col(base), F.when(F.contains(col(base), F.lit("?")), "&").otherwise("?"), query)
