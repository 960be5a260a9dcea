"""Row validation: each rule is a boolean Column, a check is an array of (field, rule, message), null-free and empty for good rows.

Rules are written as "required|min:3|in:a,b" or as a list of such texts. A pattern may hold any character: in one text `regex:` comes last
and takes the rest, in a list each text is one rule. Unless said otherwise null and empty values pass. Dates and numbers follow one explicit grammar: ISO dates,
decimal points, optional thousands commas. Unknown rules raise.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The loose e-mail pattern, Turkish letters that count as letters, the formats of GUIDs, and an IPv4 / IPv6 grammar.
LOOSE_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
LETTERS = "a-zA-ZğüşıöçĞÜŞİÖÇ"
GUID = r"(?i)^(?:[0-9a-f]{32}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|\{[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\}|\([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\)|\{0x[0-9a-f]{8},(?:0x[0-9a-f]{4},){2}\{(?:0x[0-9a-f]{2},){7}0x[0-9a-f]{2}\}\})$"
IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV6 = rf"(?:(?:[0-9a-f]{{1,4}}:){{7}}[0-9a-f]{{1,4}}|(?=(?:[0-9a-f]{{0,4}}:){{2,7}}[0-9a-f]{{0,4}}$)(?:[0-9a-f]{{1,4}}(?::[0-9a-f]{{1,4}})*)?::(?:[0-9a-f]{{1,4}}(?::[0-9a-f]{{1,4}})*)?|(?:[0-9a-f]{{1,4}}:){{6}}{IPV4}|::(?:ffff:)?{IPV4})"

# English templates: field and arguments are filled in.
MESSAGES = {
    "required": "{field} is required",
    "email": "{field} is no e-mail address",
    "url": "{field} is no http or https address",
    "numeric": "{field} is no number",
    "decimal": "{field} is no number",
    "integer": "{field} is no whole number",
    "boolean": "{field} is neither true nor false",
    "date": "{field} is no date",
    "min": "{field} is below {args}",
    "max": "{field} is above {args}",
    "between": "{field} is not within {args}",
    "length": "{field} does not have {args} characters",
}


def as_text(c: Column) -> Column:
    return c.cast("string")


def number(c: Column) -> Column:
    return F.regexp_replace(F.trim(as_text(c)), ",", "").try_cast("decimal(38,18)")


def size(c: Column) -> Column:
    """What min, max and between measure: the value of a number, else the length."""
    return F.coalesce(number(c), F.length(F.coalesce(as_text(c), F.lit(""))).cast("decimal(38,18)"))


def moment(c: Column) -> Column:
    return F.try_to_timestamp(as_text(c))


def luhn(c: Column) -> Column:
    plain = F.regexp_replace(as_text(c), r"[\s-]", "")
    return plain.rlike(r"^\d{13,19}$") & F.call_function("luhn_check", plain)


def national_id(c: Column) -> Column:
    """The Turkish identity number: eleven digits, the last two of which are check digits. The remainder keeps its sign, so a negative one never matches."""
    t = as_text(c)
    d = [F.substring(t, i + 1, 1).cast("int") for i in range(11)]
    odd, even = d[0] + d[2] + d[4] + d[6] + d[8], d[1] + d[3] + d[5] + d[7]
    good = (d[9] == (odd * 7 - even) % 10) & (d[10] == (odd + even + d[9]) % 10)
    return F.when(t.rlike(r"^[1-9]\d{10}$"), good).otherwise(False)


def iban(c: Column) -> Column:
    """15 to 34 characters; the first four moved to the end and letters read as 10 to 35, the rest of division by 97 is 1."""
    plain = F.regexp_replace(F.upper(as_text(c)), r"\s", "")
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        value = F.when(ch.between("0", "9"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    rest = F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), step)
    return F.when(plain.rlike("^[A-Z0-9]{15,34}$"), rest == 1).otherwise(False)


def web_address(c: Column) -> Column:
    return as_text(c).rlike(r"(?i)^https?://[^\s/?#]+")


def password_fault(c: Column) -> Column:
    """The first thing a password lacks, null if nothing."""
    t = as_text(c)
    return F.when(F.length(t) < 8, "at least 8 characters").when(~t.rlike(r"\p{Lu}"), "an upper-case letter").when(~t.rlike(r"\p{Ll}"), "a lower-case letter").when(~t.rlike(r"\d"), "a digit")


def compared(name: str, args: list[str]) -> Column:
    if len(args) != 1:
        raise ValueError(f"{name} takes one argument")
    return F.col(args[0])


def cast_date(args: list[str]) -> Column:
    return F.try_to_timestamp(F.lit(":".join(args)))


Rule = Callable[[Column, list[str], str], Column]
#: name -> (the rule, whether it looks at empty values too)
RULES: dict[str, tuple[Rule, bool]] = {
    "required": (lambda c, a, f: F.coalesce(~as_text(c).rlike(r"(?U)^\s*$"), F.lit(False)), True),
    "nullable": (lambda c, a, f: F.lit(True), True),
    "email": (lambda c, a, f: as_text(c).rlike(LOOSE_EMAIL), False),
    "url": (lambda c, a, f: web_address(c), False),
    "numeric": (lambda c, a, f: number(c).isNotNull(), False),
    "decimal": (lambda c, a, f: number(c).isNotNull(), False),
    "integer": (lambda c, a, f: F.trim(as_text(c)).rlike(r"^[+-]?\d+$") & F.trim(as_text(c)).try_cast("int").isNotNull(), False),
    "boolean": (lambda c, a, f: F.lower(as_text(c)).isin("true", "false", "1", "0", "yes", "no"), False),
    "date": (lambda c, a, f: moment(c).isNotNull(), False),
    "min": (lambda c, a, f: size(c) >= F.lit(a[0]).cast("decimal(38,18)"), True),
    "max": (lambda c, a, f: size(c) <= F.lit(a[0]).cast("decimal(38,18)"), True),
    "between": (lambda c, a, f: size(c).between(F.lit(a[0]).cast("decimal(38,18)"), F.lit(a[1]).cast("decimal(38,18)")), True),
    "length": (lambda c, a, f: F.length(F.coalesce(as_text(c), F.lit(""))) == int(a[0]), True),
    "alpha": (lambda c, a, f: as_text(c).rlike(f"^[{LETTERS}]+$"), False),
    "alpha_num": (lambda c, a, f: as_text(c).rlike(f"^[{LETTERS}0-9]+$"), False),
    "alpha_dash": (lambda c, a, f: as_text(c).rlike(f"^[{LETTERS}0-9_-]+$"), False),
    "regex": (lambda c, a, f: as_text(c).rlike(",".join(a)), False),
    "in": (lambda c, a, f: as_text(c).isin(a), False),
    "not_in": (lambda c, a, f: ~as_text(c).isin(a), False),
    "confirmed": (lambda c, a, f: as_text(c).eqNullSafe(as_text(F.col(a[0] if a else f"{f}_confirmation"))), True),
    "same": (lambda c, a, f: as_text(c).eqNullSafe(as_text(compared("same", a))), True),
    "different": (lambda c, a, f: ~as_text(c).eqNullSafe(as_text(compared("different", a))), True),
    "starts_with": (lambda c, a, f: any_of([F.startswith(as_text(c), F.lit(x)) for x in a]), False),
    "ends_with": (lambda c, a, f: any_of([F.endswith(as_text(c), F.lit(x)) for x in a]), False),
    "uuid": (lambda c, a, f: F.trim(as_text(c)).rlike(GUID), False),
    "ip": (lambda c, a, f: as_text(c).rlike(f"(?i)^(?:{IPV4}|{IPV6})$"), False),
    "json": (lambda c, a, f: as_text(c).rlike(r"(?sU)^\s*(?:\{.*\}|\[.*\])\s*$"), False),
    "phone": (lambda c, a, f: F.regexp_replace(as_text(c), r"[\s\-()+]", "").rlike(r"^\d{10,15}$"), False),
    "credit_card": (lambda c, a, f: luhn(c), False),
    "tc_kimlik": (lambda c, a, f: national_id(c), False),
    "iban": (lambda c, a, f: iban(c), False),
    "after": (lambda c, a, f: F.coalesce(moment(c) > cast_date(a), F.lit(True)), False),
    "before": (lambda c, a, f: F.coalesce(moment(c) < cast_date(a), F.lit(True)), False),
    "password": (lambda c, a, f: password_fault(c).isNull(), False),
    # rules of declared fields
    "max_length": (lambda c, a, f: F.length(as_text(c)) <= int(a[0]), False),
    "min_length": (lambda c, a, f: F.coalesce(F.length(as_text(c)) >= int(a[0]), F.lit(True)), True),
    "range": (lambda c, a, f: c.cast("double").between(float(a[0]), float(a[1])), False),
    "phone_characters": (lambda c, a, f: as_text(c).rlike(r"^[\d\s\-+()]{10,}$"), False),
    "positive": (lambda c, a, f: c.cast("decimal(38,9)") > 0, False),
    "non_negative": (lambda c, a, f: c.cast("decimal(38,9)") >= 0, False),
}


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def read_rules(rules: str | list[str]) -> list[tuple[str, list[str]]]:
    out = []
    if isinstance(rules, str):
        # a pattern may hold bars: it is the rest of the text
        head, sep, pattern = rules.partition("regex:") if re.search(r"(?:^|\|)\s*regex:", rules) else (rules, "", "")
        rules = [x for x in head.split("|") if x.strip() or not sep] + ([f"regex:{pattern}"] if sep else [])
    for part in rules:
        name, _, args = (part if part.startswith("regex:") else part.strip()).partition(":")
        if name not in RULES:
            raise ValueError(f"unknown rule {name!r}")
        out.append((name, args.split(",") if args else []))
    return out


def passes(field: str, name: str, args: list[str] | None = None, column: Column | None = None) -> Column:
    """Whether a field satisfies a rule; never null."""
    rule, looks_at_empty = RULES[name]
    c = F.col(field) if column is None else column
    good = F.coalesce(rule(c, args or [], field), F.lit(False))
    return good if looks_at_empty else (F.coalesce(as_text(c), F.lit("")) == "") | good


def errors(rules: dict[str, str | list[str]], messages: dict[str, str] | None = None) -> Column:
    """array<struct<field,rule,message>> of the broken rules, in the order given. Own messages are keyed `field.rule` or `rule`."""
    found = []
    for field, given in rules.items():
        for name, args in read_rules(given):
            own = messages or {}
            text = own.get(f"{field}.{name}") or own.get(name) or MESSAGES.get(name, "{field} breaks the rule {rule}")
            message = F.lit(text.format(field=field, rule=name, args=" and ".join(args)))
            if name == "password" and not (f"{field}.{name}" in own or name in own):
                message = F.concat(F.lit(f"{field} needs "), password_fault(F.col(field)))
            found.append(F.when(~passes(field, name, args), F.struct(F.lit(field).alias("field"), F.lit(name).alias("rule"), message.alias("message"))))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<field:string,rule:string,message:string>>")


class ValidationError(ValueError):
    """Raised by or_fail(); has the first errors."""

    def __init__(self, rows: list):
        self.rows = rows
        super().__init__(f"{len(rows)} or more rows break a rule, the first: {rows[0]}")


class Checked:
    """A frame with its errors column."""

    def __init__(self, df: DataFrame, rules: dict[str, str | list[str]], messages: dict[str, str] | None = None, column: str = "errors"):
        self.rules, self.column, self.df = rules, column, df.withColumn(column, errors(rules, messages))

    def passing(self) -> DataFrame:
        return self.df.filter(F.size(self.column) == 0).drop(self.column)

    def failing(self) -> DataFrame:
        return self.df.filter(F.size(self.column) > 0)

    def passes(self) -> bool:
        return self.failing().isEmpty()

    def fails(self) -> bool:
        return not self.passes()

    def all_errors(self) -> DataFrame:
        """A row for each broken rule."""
        kept = [c for c in self.df.columns if c != self.column]
        return self.df.select(*kept, F.explode(self.column).alias("_e")).select(*kept, "_e.field", "_e.rule", "_e.message")

    def has_error(self, field: str) -> Column:
        return F.exists(self.column, lambda e: e["field"] == field)

    def first_error(self, field: str | None = None) -> Column:
        found = F.col(self.column) if field is None else F.filter(self.column, lambda e: e["field"] == field)
        return F.get(found, F.lit(0))["message"]

    def validated(self) -> DataFrame:
        """The checked fields of good rows."""
        return self.passing().select(*self.rules)

    def or_fail(self, shown: int = 20) -> DataFrame:
        bad = self.failing().limit(shown).collect()
        if bad:
            raise ValidationError([r.asDict(True) for r in bad])
        return self.df.drop(self.column)


def check(df: DataFrame, rules: dict[str, str | list[str]], messages: dict[str, str] | None = None) -> Checked:
    return Checked(df, rules, messages)
