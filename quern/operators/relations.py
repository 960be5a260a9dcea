"""Relations as joins of whole tables: has_many, has_one, belongs_to, belongs_to_many, and eager loading in one plan."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.model import Model

if TYPE_CHECKING:
    from quern.context import Context
    from quern.operators.query import Query


class Relation:
    """Declared as a class attribute; `related` is a model or a function that gives it."""

    is_relation = True
    many = True

    def __init__(self, related: object, foreign_key: str | None = None, key: str | None = None):
        self._related, self.foreign_key, self._key = related, foreign_key, key

    def __set_name__(self, owner: type[Model], name: str) -> None:
        self.owner, self.name = owner, name

    @property
    def related(self) -> type[Model]:
        return self._related if isinstance(self._related, type) else self._related()

    @property
    def parent_key(self) -> str:
        """Column of the owner that takes part."""
        return self._key or self.owner.meta.key.name

    @property
    def child_key(self) -> str:
        """Column of the related model that takes part."""
        return self.foreign_key or f"{self.owner.__name__}Id"

    def children(self, context: Context, nested: Iterable[str] = ()) -> DataFrame:
        """Visible related rows, with their own relations loaded."""
        return context.query(self.related).with_(*nested).df()

    def wanted(self, context: Context, parents: DataFrame, nested: Iterable[str] = ()) -> DataFrame:
        """The children of these parents, narrowed by a semi-join before their own relations are loaded and anything is gathered."""
        keys = parents.select(F.col(self.parent_key).alias("_parent")).distinct()
        query = context.query(self.related)
        mine = replace(query, base=query.base.join(keys, query.base[self.child_key] == F.col("_parent"), "left_semi"))
        return mine.with_(*nested).df()

    def attached(self, context: Context, parents: DataFrame, nested: Iterable[str] = ()) -> DataFrame:
        """parents with the relation in a column of its name. Parents without related rows keep an empty array or null."""
        child = self.wanted(context, parents, nested)
        kept = [c for c in child.columns]
        packed = child.groupBy(F.col(self.child_key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(*self._first(kept)))).alias(self.name))
        out = parents.join(packed, parents[self.parent_key] == F.col("_key"), "left").drop("_key")
        kind = packed.schema[self.name].dataType
        return out.withColumn(self.name, F.coalesce(self.name, F.array().cast(kind)))

    def _first(self, columns: list[str]) -> list[str]:
        """The related key leads, so that arrays are sorted by it."""
        key = self.related.meta.key
        return sorted(columns, key=lambda c: (not key or c != key.name)) if key else columns

    def joined(self, context: Context, parents: DataFrame, how: str = "left") -> DataFrame:
        """Flat: a row for each pair."""
        child = self.children(context)
        return parents.join(child, parents[self.parent_key] == child[self.child_key], how)

    def of(self, context: Context, parent: Model) -> Query:
        """The related rows of one parent, as a query."""
        return context.query(self.related).where(self.child_key, parent.values[self.parent_key])

    def counted(self, context: Context, parents: DataFrame, name: str | None = None) -> DataFrame:
        """parents with the number of related rows."""
        n = self.wanted(context, parents).groupBy(F.col(self.child_key).alias("_key")).agg(F.count("*").alias("_n"))
        out = parents.join(n, parents[self.parent_key] == F.col("_key"), "left")
        return out.withColumn(name or f"{self.name}_count", F.coalesce("_n", F.lit(0))).drop("_key", "_n")


class HasMany(Relation):
    def create(self, context: Context, parent: Model, **values) -> Model:
        return context.repository(self.related).create(**values, **{self.child_key: parent.values[self.parent_key]})

    def create_many(self, context: Context, parent: Model, rows: list[dict]) -> int:
        key = {self.child_key: parent.values[self.parent_key]}
        return context.repository(self.related).bulk_insert([{**r, **key} for r in rows])

    def delete_all(self, context: Context, parent: Model) -> int:
        return context.repository(self.related).delete_where(F.col(self.child_key) == F.lit(parent.values[self.parent_key]))


class HasOne(HasMany):
    """Of several related rows the one with the smallest key."""

    many = False

    def attached(self, context, parents, nested=()):
        child = self.wanted(context, parents, nested)
        columns = self._first(child.columns)
        one = child.groupBy(F.col(self.child_key).alias("_key")).agg(F.min_by(F.struct(*columns), F.col(columns[0])).alias(self.name))
        return parents.join(one, parents[self.parent_key] == F.col("_key"), "left").drop("_key")

    def of(self, context, parent):
        return super().of(context, parent).order_by(self.related.meta.key.name).limit(1)

    def associate(self, context: Context, parent: Model, child: Model) -> Model:
        """Makes child the parent's."""
        child.values[self.child_key] = parent.values[self.parent_key]
        return context.repository(self.related).save(child)

    def dissociate(self, context: Context, parent: Model) -> int:
        """Clears the link of the parent's related rows."""
        return context.repository(self.related).update_where(F.col(self.child_key) == F.lit(parent.values[self.parent_key]), {self.child_key: None})


class BelongsTo(Relation):
    many = False

    @property
    def parent_key(self):
        return self.foreign_key or f"{self.related.__name__}Id"

    @property
    def child_key(self):
        return self._key or self.related.meta.key.name

    def attached(self, context, parents, nested=()):
        owner = self.wanted(context, parents, nested)
        one = owner.select(F.col(self.child_key).alias("_key"), F.struct(*owner.columns).alias(self.name))
        return parents.join(one, parents[self.parent_key] == F.col("_key"), "left").drop("_key")

    def associate(self, context: Context, child: Model, owner: Model) -> Model:
        child.values[self.parent_key] = owner.values[self.child_key]
        return context.repository(type(child)).save(child)

    def dissociate(self, context: Context, child: Model) -> Model:
        child.values[self.parent_key] = None
        return context.repository(type(child)).save(child)


@dataclass(frozen=True)
class Pivot:
    table: str
    left: str
    right: str


class BelongsToMany(Relation):
    """Through a pivot table; its name, unless given, is both class names in lower case, sorted, joined by an underscore."""

    def __init__(self, related: object, pivot: str | DataFrame | None = None, left: str | None = None, right: str | None = None, key: str | None = None, related_key: str | None = None):
        super().__init__(related, None, key)
        self._pivot, self._left, self._right, self._related_key = pivot, left, right, related_key

    @property
    def pivot(self) -> Pivot:
        names = sorted((self.owner.__name__.lower(), self.related.__name__.lower()))
        return Pivot(self._pivot if isinstance(self._pivot, str) else "_".join(names), self._left or f"{self.owner.__name__}Id", self._right or f"{self.related.__name__}Id")

    @property
    def child_key(self):
        return self._related_key or self.related.meta.key.name

    def pairs(self, context: Context) -> DataFrame:
        return (context.table(self.pivot.table) if not isinstance(self._pivot, DataFrame) else self._pivot).select(F.col(self.pivot.left).alias("_left"), F.col(self.pivot.right).alias("_right"))

    def through(self, context: Context, parents: DataFrame, nested: Iterable[str] = ()) -> DataFrame:
        """The links of these parents with the rows they lead to."""
        keys = parents.select(F.col(self.parent_key).alias("_parent")).distinct()
        mine = self.pairs(context).join(keys, F.col("_left") == F.col("_parent"), "left_semi")
        query = context.query(self.related)
        led = replace(query, base=query.base.join(mine.select(F.col("_right").alias("_led")).distinct(), query.base[self.child_key] == F.col("_led"), "left_semi"))
        child = led.with_(*nested).df()
        return mine.join(child, F.col("_right") == child[self.child_key])

    def attached(self, context, parents, nested=()):
        both = self.through(context, parents, nested)
        columns = [c for c in both.columns if c not in ("_left", "_right")]
        packed = both.groupBy("_left").agg(F.array_sort(F.collect_list(F.struct(*self._first(columns)))).alias(self.name))
        out = parents.join(packed, parents[self.parent_key] == F.col("_left"), "left").drop("_left")
        return out.withColumn(self.name, F.coalesce(self.name, F.array().cast(packed.schema[self.name].dataType)))

    def joined(self, context, parents, how="inner"):
        both = self.through(context, parents)
        return parents.join(both, parents[self.parent_key] == F.col("_left"), how).drop("_left", "_right")

    def of(self, context, parent):
        mine = self.pairs(context).filter(F.col("_left") == F.lit(parent.values[self.parent_key])).select("_right").distinct()
        query = context.query(self.related)
        return replace(query, base=query.base.join(mine, query.base[self.child_key] == F.col("_right"), "left_semi"))

    def counted(self, context, parents, name=None):
        """Counts pivot rows, whatever the state of the related rows."""
        n = self.pairs(context).groupBy("_left").agg(F.count("*").alias("_n"))
        out = parents.join(n, parents[self.parent_key] == F.col("_left"), "left")
        return out.withColumn(name or f"{self.name}_count", F.coalesce("_n", F.lit(0))).drop("_left", "_n")

    # changes of the pivot table, each one commit
    def _is(self, parent: Model, keys: list | None = None):
        mine = F.col(self.pivot.left) == F.lit(parent.values[self.parent_key])
        return mine if keys is None else mine & F.col(self.pivot.right).isin(list(keys))

    def contains(self, context: Context, parent: Model, key: object) -> bool:
        return not context.table(self.pivot.table).filter(self._is(parent, [key])).isEmpty()

    def attach(self, context: Context, parent: Model, keys: object, **extra) -> int:
        """Adds links; those there already are not added again."""
        wanted = list(dict.fromkeys(keys if isinstance(keys, (list, tuple, set)) else [keys]))
        there = {r[0] for r in context.table(self.pivot.table).filter(self._is(parent, wanted)).select(self.pivot.right).collect()}
        rows = [{self.pivot.left: parent.values[self.parent_key], self.pivot.right: k, **extra} for k in wanted if k not in there]
        if rows:
            context.store.append_rows(self.pivot.table, rows)
        return len(rows)

    def detach(self, context: Context, parent: Model, keys: object = None) -> int:
        """Removes links; all of the parent's, if no keys are given."""
        listed = None if keys is None else list(keys) if isinstance(keys, (list, tuple, set)) else [keys]
        return context.store.delete(self.pivot.table, self._is(parent, listed))

    def sync(self, context: Context, parent: Model, keys: Iterable) -> None:
        """Makes the parent's links exactly these."""
        with context.transaction():
            self.detach(context, parent)
            self.attach(context, parent, list(keys))

    def toggle(self, context: Context, parent: Model, key: object) -> bool:
        """Links if it was not, unlinks if it was; returns whether it is linked now."""
        if self.contains(context, parent, key):
            self.detach(context, parent, [key])
            return False
        self.attach(context, parent, [key])
        return True


def load(context: Context, model: type[Model], df: DataFrame, paths: Iterable[str]) -> DataFrame:
    """df with the relations named by paths; one join for each, in one plan."""
    nested: dict[str, list[str]] = defaultdict(list)
    for path in paths:
        head, _, rest = path.partition(".")
        if head not in model.meta.relations:
            raise KeyError(f"{model.__name__} has no relation {head!r}")
        nested[head] += [rest] if rest else []
    for name, rest in nested.items():
        df = model.meta.relations[name].attached(context, df, rest)
    return df
