"""Conditions as written in query calls, turned into Columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.model import Scope, named

#: Operators that a condition may name.
OPERATORS = {
    "=": lambda a, b: a == b,
    "==": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "LIKE": lambda a, b: a.like(b),
    "NOT LIKE": lambda a, b: ~a.like(b),
    "ILIKE": lambda a, b: a.ilike(b),
    "RLIKE": lambda a, b: a.rlike(b),
    "<=>": lambda a, b: a.eqNullSafe(b),
}


def comparison(column: str | Column, operator: str, value: object) -> Column:
    """column operator value. IS and IS NOT take None; a comparison with None is null, as in SQL."""
    c = named(column) if isinstance(column, str) else column
    op = " ".join(operator.upper().split())
    if op in ("IS", "IS NOT"):
        if value is not None:
            raise ValueError(f"{op} is for None")
        return c.isNull() if op == "IS" else c.isNotNull()
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    if op in ("LIKE", "NOT LIKE", "ILIKE", "RLIKE"):
        return OPERATORS[op](c, value)
    return OPERATORS[op](c, value if isinstance(value, Column) else F.lit(value))


def scope(s: Scope) -> Column:
    return comparison(s.column, "IS" if s.value is None and s.operator == "=" else s.operator, s.value)


def on_date(column: str, day: dt.date | dt.datetime | str) -> Column:
    """The date part equals the day; Catalyst turns this into a range on the column that reaches the scan."""
    if isinstance(day, dt.datetime):
        day = day.date()
    return named(column).cast("date") == F.lit(day).cast("date")


@dataclass(frozen=True)
class Condition:
    column: Column
    either: bool = False  # joined to what stands before by OR


def joined(conditions: Sequence[Condition]) -> Column | None:
    """SQL precedence: OR parts the conditions into groups that AND holds together."""
    groups: list[list[Column]] = []
    for c in conditions:
        if c.either and groups:
            groups.append([c.column])
        elif groups:
            groups[-1].append(c.column)
        else:
            groups.append([c.column])
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, g) for g in groups]) if groups else None
