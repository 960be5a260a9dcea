"""The query builder: immutable, lazy, one DataFrame in the end. Nothing runs before a method that returns plain values."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import islice
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quern.model import Model, NotFound, active_scopes, named
from quern.operators import predicates as p
from quern.operators.positions import numbered

if TYPE_CHECKING:
    from quern.context import Context

#: Values in an IN list beyond which a join with a table of them is planned instead.
IN_LIST = 1000
DIRECTIONS = {"ASC": "asc", "DESC": "desc"}


@dataclass(frozen=True)
class Page:
    """A page of rows with its place among all."""

    items: DataFrame
    number: int
    size: int
    total: int

    @property
    def pages(self) -> int:
        return math.ceil(self.total / self.size)

    @property
    def has_previous(self) -> bool:
        return self.number > 1

    @property
    def has_next(self) -> bool:
        return self.number < self.pages

    @property
    def first_item(self) -> int:
        return (self.number - 1) * self.size + 1 if self.total else 0

    @property
    def last_item(self) -> int:
        return min(self.number * self.size, self.total)


@dataclass(frozen=True)
class Join:
    frame: DataFrame
    alias: str
    condition: Column
    how: str


def top_level(text: str) -> list[str]:
    """Parts of a list between commas outside brackets and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


@dataclass(frozen=True)
class Query:
    """Every method that adds a clause returns a new query. The base is a DataFrame or a model bound to a context."""

    base: DataFrame
    name: str = "t"
    model: type[Model] | None = None
    context: Context | None = None
    trash: str = "hide"
    selected: tuple[str | Column, ...] = ()
    unique: bool = False
    conditions: tuple[p.Condition, ...] = ()
    lists: tuple[tuple[str, tuple, bool, int], ...] = ()
    joins: tuple[Join, ...] = ()
    groups: tuple[str, ...] = ()
    havings: tuple[tuple[str, str, object], ...] = ()
    orders: tuple[Column, ...] = ()
    most: int | None = None
    skipped: int = 0
    eager: tuple[str, ...] = ()

    # --- projection -------------------------------------------------------------------------------------------
    def select(self, *items: str | Column) -> Query:
        """Adds columns, SQL expressions with aliases, or t.*; without any select all columns come."""
        return replace(self, selected=(*self.selected, *items))

    def distinct(self) -> Query:
        return replace(self, unique=True)

    # --- conditions -------------------------------------------------------------------------------------------
    def _add(self, column: Column, either: bool = False) -> Query:
        return replace(self, conditions=(*self.conditions, p.Condition(column, either)))

    def where(self, column: str | Column, *rest: object) -> Query:
        """where(column, value), where(column, operator, value) or where(condition)."""
        return self._add(self._condition(column, rest))

    def or_where(self, column: str | Column, *rest: object) -> Query:
        return self._add(self._condition(column, rest), True)

    @staticmethod
    def _condition(column: str | Column, rest: tuple) -> Column:
        if not rest and isinstance(column, Column):
            return column
        operator, value = rest if len(rest) == 2 else ("=", *rest)
        return p.comparison(column, operator, value)

    def where_in(self, column: str, values: Sequence) -> Query:
        """An empty list matches nothing. A long one becomes a join with a table of its values, under the same AND and OR."""
        return self._in_list(column, tuple(values), True)

    def or_where_in(self, column: str, values: Sequence) -> Query:
        return self._in_list(column, tuple(values), True, True)

    def where_not_in(self, column: str, values: Sequence) -> Query:
        """An empty list matches all; None in the list matches nothing, as in SQL."""
        return self._in_list(column, tuple(values), False)

    def _in_list(self, column: str, values: tuple, inside: bool, either: bool = False) -> Query:
        if len(values) > IN_LIST and None not in values:
            # the condition reads a flag that the join with the list sets
            flag = F.col(f"__quern_in{len(self.lists)}")
            hit = F.when(named(column).isNotNull(), flag.isNotNull() if inside else flag.isNull())
            return replace(self._add(hit, either), lists=(*self.lists, (column, values, inside, len(self.conditions))))
        if not values:
            return self._add(F.lit(not inside), either)
        test = named(column).isin(list(values))
        return self._add(test if inside else ~test, either)

    def where_between(self, column: str, low: object, high: object) -> Query:
        return self._add(named(column).between(F.lit(low), F.lit(high)))

    def where_null(self, column: str) -> Query:
        return self._add(named(column).isNull())

    def where_not_null(self, column: str) -> Query:
        return self._add(named(column).isNotNull())

    def where_like(self, column: str, part: str) -> Query:
        """Contains; % and _ in the part are wildcards."""
        return self._add(named(column).like(f"%{part}%"))

    def where_date(self, column: str, day: object) -> Query:
        return self._add(p.on_date(column, day))

    def where_raw(self, sql: str) -> Query:
        return self._add(F.expr(f"({sql})"))

    def with_trashed(self) -> Query:
        return replace(self, trash="show")

    def only_trashed(self) -> Query:
        return replace(self, trash="only")

    # --- joins, groups, order ---------------------------------------------------------------------------------
    def join(self, other: object, condition: str | Column | None = None, how: str = "inner", on: tuple[str, str] | None = None, alias: str | None = None) -> Query:
        """Joins a DataFrame, query, model or table name; condition is any SQL text or Column, on=(left, right) an equality."""
        frame, name = self._other(other)
        if (condition is None) == (on is None):
            raise ValueError("give either a condition or on=(left, right)")
        test = named(on[0]) == named(on[1]) if on else F.expr(condition) if isinstance(condition, str) else condition
        return replace(self, joins=(*self.joins, Join(frame, alias or name, test, how)))

    def left_join(self, other: object, condition: str | Column | None = None, **kw) -> Query:
        return self.join(other, condition, how="left", **kw)

    def right_join(self, other: object, condition: str | Column | None = None, **kw) -> Query:
        return self.join(other, condition, how="right", **kw)

    def _other(self, other: object) -> tuple[DataFrame, str]:
        if isinstance(other, Query):
            return other.df(), other.name
        if isinstance(other, DataFrame):
            return other, "j"
        if isinstance(other, str):
            if not self.context:
                raise ValueError("table names need a context")
            return self.context.table(other), other.rpartition(".")[2]
        if isinstance(other, type) and issubclass(other, Model):
            return self.context.frame(other), other.meta.table
        raise TypeError(f"cannot join {other!r}")

    def group_by(self, *columns: str) -> Query:
        return replace(self, groups=(*self.groups, *(x for c in columns for x in top_level(c))))

    def having(self, expression: str, operator: str, value: object) -> Query:
        """A condition on a group; several are ANDed. The value keeps its type."""
        return replace(self, havings=(*self.havings, (expression, operator, value)))

    def order_by(self, column: str | Column, direction: str = "ASC", nulls: str | None = None) -> Query:
        """nulls: first or last; Spark's default otherwise."""
        if direction.upper() not in DIRECTIONS:
            raise ValueError(f"direction {direction!r}")
        c = named(column) if isinstance(column, str) else column
        return replace(self, orders=(*self.orders, getattr(c, DIRECTIONS[direction.upper()] + (f"_nulls_{nulls}" if nulls else ""))()))

    def order_by_desc(self, column: str) -> Query:
        return self.order_by(column, "DESC")

    def latest(self, column: str | None = None) -> Query:
        return self.order_by_desc(column or self._created())

    def oldest(self, column: str | None = None) -> Query:
        return self.order_by(column or self._created())

    def _created(self) -> str:
        mark = self.model and self.model.meta.marked("created")
        if not mark:
            raise ValueError("name a column: the model marks none as its creation time")
        return mark.name

    def in_random_order(self, seed: int | None = None) -> Query:
        return replace(self, orders=(F.rand(seed) if seed is not None else F.rand(),))

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    take = limit

    def offset(self, n: int) -> Query:
        return replace(self, skipped=n)

    skip = offset

    def page(self, number: int, size: int = 10) -> Query:
        return replace(self, skipped=(max(1, number) - 1) * size, most=size)

    def with_(self, *paths: str) -> Query:
        """Loads relations along, as arrays of structs or structs; "a.b" loads b inside a."""
        return replace(self, eager=(*self.eager, *paths))

    # --- the plan ---------------------------------------------------------------------------------------------
    def _visible(self) -> DataFrame:
        """The base under its implicit conditions, which bind before any of the user's."""
        df = self.base
        if self.model:
            mark = self.model.meta.marked("deleted")
            if mark and self.trash == "hide":
                df = df.filter(F.col(mark.name).isNull())
            elif self.trash == "only":
                df = df.filter(F.col(mark.name).isNotNull() if mark else F.lit(False))
            for s in active_scopes(self.model):
                df = df.filter(p.scope(s))
        return df

    def _rows(self) -> DataFrame:
        """FROM, JOIN and WHERE."""
        df = self._visible().alias(self.name)
        for j in self.joins:
            df = df.join(j.frame.alias(j.alias), j.condition, j.how)
        if self.lists and not any(c.either for c in self.conditions):
            return self._narrowed(df)
        for k, (column, values, *_) in enumerate(self.lists):
            df = df.join(self._listed(df, column, values, k).withColumn(f"__quern_in{k}", F.lit(True)), named(column) == F.col(f"__quern_v{k}"), "left").drop(f"__quern_v{k}")
        test = p.joined(self.conditions)
        if test is not None:
            df = df.filter(test)
        return df.drop(*(f"__quern_in{k}" for k in range(len(self.lists))))

    def _narrowed(self, df: DataFrame) -> DataFrame:
        """Without any OR each list is a join of its own, and the other conditions reach the scan."""
        flags = {place for *_, place in self.lists}
        test = p.joined([c for i, c in enumerate(self.conditions) if i not in flags])
        df = df if test is None else df.filter(test)
        for k, (column, values, inside, _) in enumerate(self.lists):
            df = df.join(self._listed(df, column, values, k), named(column) == F.col(f"__quern_v{k}"), "left_semi" if inside else "left_anti")
            df = df if inside else df.filter(named(column).isNotNull())
        return df

    @staticmethod
    def _listed(df: DataFrame, column: str, values: tuple, k: int) -> DataFrame:
        # the values come from the caller's own list, so they fit the driver
        kind = df.select(named(column)).schema[0].dataType
        return df.sparkSession.createDataFrame([(v,) for v in set(values)], f"__quern_v{k} " + kind.simpleString())

    def _grouped(self, df: DataFrame) -> DataFrame:
        keys = [F.expr(g) for g in self.groups]
        chosen = [F.expr(s) if isinstance(s, str) else s for s in self.selected] or keys
        plain = {g.lower() for g in self.groups}
        aggregates, out = [], []
        for item, c in zip(self.selected or self.groups, chosen, strict=True):
            if isinstance(item, str) and item.lower() in plain:
                out.append(F.col(f"`{df.select(c).columns[0]}`"))
                continue
            name = self._alias(item, df)
            aggregates.append(c)
            out.append(F.col(f"`{name}`"))
        tests = []
        for k, (expression, operator, value) in enumerate(self.havings):
            aggregates.append(F.expr(expression).alias(f"_having{k}"))
            tests.append(p.comparison(F.col(f"_having{k}"), operator, value))
        found = df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
        for t in tests:
            found = found.filter(t)
        if self.orders:
            found = found.orderBy(*self.orders)
        return found.select(*out)

    @staticmethod
    def _alias(item: str | Column, df: DataFrame) -> str:
        if isinstance(item, str):
            m = re.search(r"(?is)\s+as\s+`?(\w+)`?\s*$", item)
            if m:
                return m[1]
            return item
        return re.search(r"AS `?(\w+)`?'?>?$", str(item))[1]

    def df(self) -> DataFrame:
        """The whole query as a DataFrame."""
        df = self._rows()
        if self.groups:
            df = self._grouped(df)
        else:
            # an order may use columns that are not selected
            if self.selected:
                shown = [F.expr(s) if isinstance(s, str) and s != "*" and not s.endswith(".*") else s for s in self.selected]
                df = df.orderBy(*self.orders).select(*shown) if self.orders and not self.unique else df.select(*shown)
            elif self.orders and not self.unique:
                df = df.orderBy(*self.orders)
        if self.unique:
            df = df.distinct()
            df = df.orderBy(*self.orders) if self.orders else df
        if self.skipped:
            df = df.offset(self.skipped)
        if self.most is not None:
            df = df.limit(self.most)
        if self.eager:
            from quern.operators.relations import load

            df = load(self.context, self.model, df, self.eager)
        return df

    get = df

    def plan(self) -> str:
        """Spark's plan for the query."""
        df = self.df()
        return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    def remember(self, ttl: float | None = 300) -> DataFrame:
        """The persisted result, shared by all queries with the same plan over the same snapshots; None keeps it until it is forgotten."""
        from quern.cache import results

        store = self.context._store if self.context else None
        return results.remember(self.df(), tables={k: t.version for k, t in store.current().items()} if store else None, ttl=ttl)

    # --- values -----------------------------------------------------------------------------------------------
    def agg(self, **named_aggregates: str | Column) -> DataFrame:
        """One row of aggregates over the query's rows: name="sum(x)"."""
        df = self._rows() if not (self.groups or self.unique or self.skipped or self.most is not None) else self.df()
        return df.agg(*((F.expr(a) if isinstance(a, str) else a).alias(k) for k, a in named_aggregates.items()))

    def _scalar(self, aggregate: str):
        return self.agg(v=aggregate).first()[0]

    def count(self, column: str = "*") -> int:
        return self._scalar(f"count({column})")

    def sum(self, column: str):
        """0 for no rows."""
        return self._scalar(f"coalesce(sum({column}), 0)")

    def avg(self, column: str):
        """0 for no rows."""
        return self._scalar(f"coalesce(avg({column}), 0)")

    def min(self, column: str):
        return self._scalar(f"min({column})")

    def max(self, column: str):
        return self._scalar(f"max({column})")

    def exists(self) -> bool:
        """Stops at the first row."""
        return not self.df().isEmpty()

    def doesnt_exist(self) -> bool:
        return self.df().isEmpty()

    def pluck(self, column: str) -> DataFrame:
        """One column; rows() makes it a list."""
        return replace(self, selected=(column,)).df()

    def value(self, column: str):
        """The first row's value with its type; None if there is no row."""
        row = replace(self, selected=(column,), most=1).df().first()
        return row[0] if row else None

    def rows(self) -> list[Row]:
        return self.df().collect()

    def models(self) -> list[Model]:
        return [self._model(r) for r in self.rows()]

    def _model(self, row: Row) -> Model:
        names = {f.name for f in self.model.meta.fields.values()}
        return self.model().fill({k: v for k, v in row.asDict(True).items() if k in names})

    def first(self) -> Row | Model | None:
        row = self.limit(1).df().first()
        return row if row is None or not self.model else self._model(row)

    def first_or_fail(self) -> Row | Model:
        found = self.first()
        if found is None:
            raise NotFound(self.model.meta.table if self.model else self.name)
        return found

    def find(self, key: object):
        """By key; hidden rows stay hidden unless with_trashed()."""
        return self.where(self.model.meta.key.name, key).first()

    def find_or_fail(self, key: object):
        found = self.find(key)
        if found is None:
            raise NotFound(self.model.meta.table, key)
        return found

    def find_many(self, *keys: object) -> Query:
        return self.where_in(self.model.meta.key.name, keys)

    def iterate(self) -> Iterator[Row]:
        """Rows one by one, a partition at a time on the driver."""
        return self.df().toLocalIterator(prefetchPartitions=True)

    # --- paging -----------------------------------------------------------------------------------------------
    def _ordered(self) -> Query:
        """Paging needs an order; without one the key gives it."""
        if self.orders or not (self.model and self.model.meta.key):
            return self
        return self.order_by(self.model.meta.key.name)

    def paginate(self, number: int = 1, size: int = 10) -> Page:
        number, size = max(1, number), size if size > 0 else 10
        whole = replace(self, most=None, skipped=0, eager=())
        total = replace(whole, orders=()).df().count()
        return Page(replace(self._ordered(), skipped=(number - 1) * size, most=size).df(), number, size, total)

    def chunk(self, size: int, callback: Callable[[list[Row]], object]) -> int:
        """Hands over all rows in lists of `size` from one sorted pass; a callback that returns False ends it. Returns the number of lists."""
        rows, n = self._ordered().iterate(), 0
        while part := list(islice(rows, size)):
            n += 1
            if callback(part) is False:
                break
        return n

    def chunk_by_id(self, size: int, callback: Callable[[list[Row]], object], column: str | None = None) -> int:
        """Hands over all rows in lists of `size` by key, from one sorted pass whose shuffle is done before the first list; a callback that returns
        False ends it. Each row goes to the driver once. Returns the number of lists."""
        df, key = self._by_id(column)
        rows, n = df.orderBy(key).toLocalIterator(prefetchPartitions=True), 0
        while part := list(islice(rows, size)):
            n += 1
            if callback(part) is False:
                break
        return n

    def _by_id(self, column: str | None) -> tuple[DataFrame, str]:
        key = column or self.model.meta.key.name
        return replace(self, orders=(), most=None, skipped=0).df(), key

    def chunks_by_id(self, size: int, column: str | None = None) -> DataFrame:
        """The chunks of chunk_by_id() as rows (chunk, n, first_id, last_id), counted on the executors: no row of theirs goes to the driver, and
        where_between() on the ids reads a chunk wherever it is worked on."""
        df, key = replace(self, eager=())._by_id(column)
        placed = numbered(df.select(F.col(key).alias("_id")), [F.col("_id")], "_position").withColumn("chunk", F.floor(F.col("_position") / size).cast("long"))
        return placed.groupBy("chunk").agg(F.count("*").alias("n"), F.min("_id").alias("first_id"), F.max("_id").alias("last_id"))

    def chunked(self, size: int, name: str = "chunk") -> DataFrame:
        """The rows with their chunk number in the query's order, for work that stays distributed."""
        q = self._ordered()
        df = numbered(replace(q, orders=()).df(), list(q.orders) or None, "_position")
        return df.withColumn(name, F.floor(F.col("_position") / size).cast("long")).drop("_position")
