"""Raw SQL with bound parameters, named queries, and the ways to read a result."""

from __future__ import annotations

import asyncio
import re
from collections.abc import AsyncIterator, Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quern.operators.positions import numbered

if TYPE_CHECKING:
    from quern.context import Context

#: Strings, quoted names and comments, in which nothing is a parameter; then @name.
PARAMETER = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/)|@(\w+)""", re.S)
ROWS, PAGE = 1000, 100


def with_colons(sql: str) -> str:
    """@name parameters as :name."""
    return PARAMETER.sub(lambda m: m[1] or f":{m[2]}", sql)


def scalar(df: DataFrame, kind: type | None = None, default: object = None):
    """The first value, as `kind` if given; the default for no row and for null. str, int, float and Decimal default to their empty value."""
    row = df.first()
    value = row[0] if row else None
    if value is None:
        return default if default is not None or kind is None else kind()
    return kind(value) if kind else value


class RawSql:
    """SQL over the context's tables, which are seen under their names as of the call."""

    def __init__(self, context: Context):
        self.context = context

    def query(self, sql: str, **params) -> DataFrame:
        spark = self.context.spark
        text = with_colons(sql)
        words = {w.lower() for w in re.findall(r"\w+", text)}
        for name in self.context.tables():
            if name.rpartition(".")[2].lower() in words:
                self.context.table(name).createOrReplaceTempView(name.rpartition(".")[2])
        return spark.sql(text, args={k.lstrip("@:"): v for k, v in params.items()})

    def first(self, sql: str, **params) -> Row | None:
        return self.query(sql, **params).first()

    def scalar(self, sql: str, kind: type | None = None, default: object = None, **params):
        return scalar(self.query(sql, **params), kind, default)

    def execute(self, sql: str, **params) -> DataFrame:
        """Statements for the session's catalog: DDL, INSERT, CREATE TABLE AS. Rows of store tables change through repositories."""
        head = sql.lstrip().split(None, 1)[0].upper()
        if head in ("UPDATE", "DELETE", "MERGE", "TRUNCATE"):
            raise ValueError(f"{head} of store tables goes through a repository")
        return self.query(sql, **params)

    def transaction(self, *changes: Callable[[], object]) -> None:
        """Runs changes of store tables as one commit."""
        with self.context.transaction():
            for change in changes:
                change()


@dataclass
class NamedQueries:
    """Stored queries: SQL with parameters and their defaults under a name. What they return is their result."""

    raw: RawSql

    def __post_init__(self):
        self.known: dict[str, tuple[str, dict]] = {}

    def define(self, name: str, sql: str, **defaults) -> None:
        self.known[name] = sql, defaults

    def call(self, name: str, **params) -> DataFrame:
        if name not in self.known:
            raise KeyError(f"no query {name!r}")
        sql, defaults = self.known[name]
        return self.raw.query(sql, **{**defaults, **params})

    def output(self, name: str, **params) -> dict[str, object]:
        """The first row as named output values."""
        row = self.call(name, **params).first()
        return row.asDict(True) if row else {}


# --- reading a frame ----------------------------------------------------------------------------------------------
def paged(df: DataFrame, page: int, size: int, *order) -> DataFrame:
    """A page by number from 1; page and size below 1 mean 1 and 100."""
    page, size = max(1, page), size if size >= 1 else PAGE
    return (df.orderBy(*order) if order else df).offset((page - 1) * size).limit(size)


def limited(df: DataFrame, n: int = ROWS) -> DataFrame:
    return df.limit(n if n >= 1 else ROWS)


def dictionaries(df: DataFrame) -> Iterator[dict]:
    """Rows as dictionaries, a partition at a time."""
    return (r.asDict(True) for r in df.toLocalIterator(prefetchPartitions=True))


def each(df: DataFrame, callback: Callable[[Row], object]) -> int:
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        callback(row)
        n += 1
    return n


def batched(df: DataFrame, callback: Callable[[list[Row]], object], size: int = ROWS) -> int:
    """Lists of `size` rows, each a new list, the last one as long as it is; returns the number of rows. All rows go through the driver: batches() keeps them off it."""
    rows, n, size = df.toLocalIterator(prefetchPartitions=True), 0, size if size >= 1 else ROWS
    while part := list(islice(rows, size)):
        callback(part)
        n += len(part)
    return n


def batches(df: DataFrame, size: int = ROWS, name: str = "batch") -> DataFrame:
    """The rows with the number of their batch of `size` in df's own order, for work on batches that stays on the executors."""
    size = size if size >= 1 else ROWS
    return numbered(df, name="__quern_position").withColumn(name, F.floor(F.col("__quern_position") / size).cast("long")).drop("__quern_position")


def searched(df: DataFrame, column: str, value: int) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def filtered(df: DataFrame, column: str, part: str | None) -> DataFrame | None:
    """Rows whose column contains the part, by the column downwards; None for an empty part."""
    if not part:
        return None
    return df.filter(F.col(column).like(f"%{part}%")).orderBy(F.desc(column))


def first_row(df: DataFrame) -> Row | None:
    return df.first()


def last_row(df: DataFrame, *order: str) -> Row | None:
    """The last row by an order, which must be given: frames have none of their own."""
    if not order:
        raise ValueError("name the columns that order the rows")
    return df.orderBy(*(F.desc(c) for c in order)).first()


def found(df: DataFrame, column: str, value: object) -> DataFrame | None:
    """The rows with that value; None if there are none."""
    hit = df.filter(F.col(column) == F.lit(value))
    return None if hit.isEmpty() else hit


def total(df: DataFrame, where: str | None = None) -> int:
    return (df.filter(where) if where else df).count()


# --- asyncio ------------------------------------------------------------------------------------------------------
async def in_background(df: DataFrame, action: Callable[[DataFrame], object], tag: str | None = None):
    """Runs an action in a thread; cancelling the task cancels its Spark jobs."""
    import uuid

    sc, mark = df.sparkSession.sparkContext, tag or f"quern-{uuid.uuid4().hex}"

    def work():
        sc.addJobTag(mark)
        try:
            return action(df)
        finally:
            sc.removeJobTag(mark)

    try:
        return await asyncio.to_thread(work)
    except asyncio.CancelledError:
        sc.cancelJobsWithTag(mark)
        raise


async def stream_rows(df: DataFrame, size: int = ROWS) -> AsyncIterator[dict]:
    """Rows as dictionaries, fetched in a thread a batch at a time."""
    rows = df.toLocalIterator(prefetchPartitions=True)
    while part := await asyncio.to_thread(lambda: list(islice(rows, size))):
        for r in part:
            yield r.asDict(True)
