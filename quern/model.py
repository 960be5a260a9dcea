"""Declarative models: a class names a table, its fields become a StructType, and class attributes declare relations and scopes."""

from __future__ import annotations

import datetime as dt
import decimal
import enum
import re
import typing
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DataType, StringType, StructField, StructType, VarcharType

#: Python annotations and the Spark types they stand for.
KINDS: dict[type, str] = {
    bool: "boolean",
    int: "bigint",
    float: "double",
    str: "string",
    bytes: "binary",
    decimal.Decimal: "decimal(18,2)",
    dt.datetime: "timestamp_ntz",
    dt.date: "date",
    dt.timedelta: "interval day to second",
    uuid.UUID: "string",
}


#: Type names that are read without a session, so that models may be declared before there is one.
SIMPLE: dict[str, Callable[[], DataType]] = {
    "boolean": T.BooleanType,
    "tinyint": T.ByteType,
    "smallint": T.ShortType,
    "int": T.IntegerType,
    "bigint": T.LongType,
    "long": T.LongType,
    "float": T.FloatType,
    "double": T.DoubleType,
    "string": T.StringType,
    "binary": T.BinaryType,
    "date": T.DateType,
    "timestamp": T.TimestampType,
    "timestamp_ntz": T.TimestampNTZType,
    "interval day to second": T.DayTimeIntervalType,
    "variant": T.VariantType,
}


def type_of(ddl: str) -> DataType:
    """A Spark type by its DDL text. Other than simple types need a session."""
    text = ddl.strip().lower()
    if text in SIMPLE:
        return SIMPLE[text]()
    m = re.fullmatch(r"(decimal|varchar)\((\d+)(?:\s*,\s*(\d+))?\)", text)
    if m:
        return VarcharType(int(m[2])) if m[1] == "varchar" else T.DecimalType(int(m[2]), int(m[3] or 0))
    return DataType.fromDDL(ddl)


class NotFound(LookupError):
    """No row where one is required; carries the table and the key that was looked for."""

    def __init__(self, table: str, key: object = None):
        self.table, self.key = table, key
        super().__init__(f"no row in {table}" + ("" if key is None else f" with key {key!r}"))


class Field:
    """A column. `kind` is a Spark type or its DDL text; without it the annotation decides."""

    def __init__(self, kind: str | DataType | None = None, *, name: str | None = None, key: bool = False, auto: bool | None = None, nullable: bool = True, length: int | None = None, default: object = None, deleted: bool = False, created: bool = False, updated: bool = False, unique: bool = False, rules: str | list[str] | None = None):
        self.kind, self.name, self.key, self.auto = kind, name, key, key if auto is None else auto
        self.nullable, self.length, self.default = nullable and not key, length, default
        self.deleted, self.created, self.updated, self.unique, self.rules = deleted, created, updated, unique, rules
        self.attribute = name

    def __set_name__(self, owner: type, attribute: str) -> None:
        self.attribute = attribute
        self.name = self.name or attribute

    def resolve(self, annotation: object) -> None:
        if self.kind is None:
            args = [a for a in typing.get_args(annotation) if a is not type(None)]
            base = args[0] if args else annotation
            if isinstance(base, type) and issubclass(base, enum.Enum):
                base = str
            if base not in KINDS:
                raise TypeError(f"{self.attribute}: no column type for {annotation!r}; give one to Field")
            self.kind = KINDS[base]
        if isinstance(self.kind, str):
            self.kind = type_of(self.kind)
        if isinstance(self.kind, VarcharType):
            self.kind, self.length = StringType(), self.kind.length

    @property
    def struct(self) -> StructField:
        meta = {k: v for k, v in {"key": self.key or None, "auto": self.auto or None, "length": self.length, "unique": self.unique or None, "default": self.default if isinstance(self.default, (str, int, float, bool)) else None}.items() if v is not None}
        return StructField(self.name, self.kind, self.nullable, meta)

    def __get__(self, instance: Model | None, owner: type):
        if instance is None:
            return self
        return instance.values.get(self.name)

    def __set__(self, instance: Model, value: object) -> None:
        instance.values[self.name] = value


@dataclass(frozen=True)
class Scope:
    """A condition on every query of a model: column, operator, value."""

    column: str
    value: object
    operator: str = "="


@dataclass(frozen=True)
class ModelMeta:
    table: str
    database: str | None
    fields: dict[str, Field]
    key: Field | None
    scopes: tuple[Scope, ...] = ()
    relations: dict[str, object] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return StructType([f.struct for f in self.fields.values()])

    @property
    def qualified(self) -> str:
        return f"{self.database}.{self.table}" if self.database else self.table

    def marked(self, mark: str) -> Field | None:
        """The field that is marked deleted, created or updated."""
        return next((f for f in self.fields.values() if getattr(f, mark)), None)

    def column(self, name: str) -> Field:
        """A field by column or attribute name, whatever the case."""
        found = next((f for f in self.fields.values() if name.lower() in (f.name.lower(), f.attribute.lower())), None)
        if found is None:
            raise KeyError(f"{self.table} has no column {name!r}")
        return found

    @property
    def rules(self) -> dict[str, str | list[str]]:
        return {f.name: f.rules for f in self.fields.values() if f.rules}


class Model:
    """Base of models. Options come as class arguments: table, database, scopes.

    Without a table name it is the class name with an s. Without a key field it is the one called id or <class>id, numbered by the store."""

    meta: ModelMeta

    def __init_subclass__(cls, table: str | None = None, database: str | None = None, scopes: typing.Sequence[Scope] = (), **kw):
        super().__init_subclass__(**kw)
        hints = {}
        for c in reversed(cls.__mro__):
            hints |= c.__dict__.get("__annotations__", {}) if c not in (Model, object) else {}
        own = {k: v for c in reversed(cls.__mro__) if issubclass(c, Model) and c is not Model for k, v in vars(c).items()}
        if not isinstance(hints, dict) or any(isinstance(v, str) for v in hints.values()):
            hints = typing.get_type_hints(cls)
        fields: dict[str, Field] = {}
        for name, hint in hints.items():
            if not isinstance(own.get(name), Field) and name not in own and name != "meta" and typing.get_origin(hint) is not typing.ClassVar:
                f = Field()
                f.__set_name__(cls, name)
                setattr(cls, name, f)
                own[name] = f
        for name, f in own.items():
            if isinstance(f, Field):
                f.resolve(hints.get(name))
                fields[f.name] = f
        key = next((f for f in fields.values() if f.key), None)
        if key is None:
            key = next((f for f in fields.values() if f.name.lower() in ("id", f"{cls.__name__.lower()}id")), None)
            if key is not None:
                key.key = key.auto = True
                key.nullable = False
        relations = {k: v for k, v in own.items() if hasattr(v, "is_relation")}
        cls.meta = ModelMeta(table or f"{cls.__name__}s", database, fields, key, tuple(scopes), relations)

    def __init__(self, **values):
        self.values: dict[str, object] = {}
        for f in self.meta.fields.values():
            if f.default is not None:
                self.values[f.name] = f.default
        self.fill(values)

    def fill(self, values: dict[str, object]) -> Model:
        """Sets attributes by column or attribute name, whatever the case."""
        for k, v in values.items():
            self.values[self.meta.column(k).name] = v
        return self

    @property
    def key(self) -> object:
        return self.values.get(self.meta.key.name) if self.meta.key else None

    @property
    def is_new(self) -> bool:
        """Whether the key is missing; zero is a key like any other."""
        return self.key is None

    def to_dict(self) -> dict[str, object]:
        return {f.name: self.values.get(f.name) for f in self.meta.fields.values()}

    def to_json(self) -> str:
        import json

        return json.dumps(self.to_dict(), default=str, ensure_ascii=False)

    def only(self, *names: str) -> dict[str, object]:
        keep = {self.meta.column(n).name for n in names}
        return {k: v for k, v in self.to_dict().items() if k in keep}

    def without(self, *names: str) -> dict[str, object]:
        drop = {n.lower() for n in names}
        return {k: v for k, v in self.to_dict().items() if k.lower() not in drop}

    def replicate(self) -> Model:
        """A new row with the same values but for the key."""
        copy = type(self)()
        copy.values = {k: v for k, v in self.values.items() if not self.meta.key or k != self.meta.key.name}
        return copy

    @property
    def trashed(self) -> bool:
        mark = self.meta.marked("deleted")
        return bool(mark and self.values.get(mark.name) is not None)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.values.items())})"

    # hooks: those before an action may return False to stop it
    def on_saving(self): ...
    def on_saved(self): ...
    def on_creating(self): ...
    def on_created(self): ...
    def on_updating(self): ...
    def on_updated(self): ...
    def on_deleting(self): ...
    def on_deleted(self): ...
    def on_restoring(self): ...
    def on_restored(self): ...


_off: ContextVar[frozenset] = ContextVar("scopes_off", default=frozenset())


@contextmanager
def without_scopes(*models: type[Model]) -> Iterator[None]:
    """Inside, queries of these models (all, if none are named) are built without their scopes. Nests, and holds for this thread of work only."""
    token = _off.set(_off.get() | frozenset(models or {Model}))
    try:
        yield
    finally:
        _off.reset(token)


def active_scopes(model: type[Model]) -> tuple[Scope, ...]:
    return () if _off.get() & {model, Model} else model.meta.scopes


NAME = re.compile(r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*$")


def named(name: str) -> Column:
    """A column by plain or dotted name; anything else is refused."""
    if not NAME.match(name):
        raise ValueError(f"{name!r} is no column name; raw conditions go through where_raw")
    return F.col(name)
