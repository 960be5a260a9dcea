"""Code-first schemas: a table builder, changes of tables, and a migrator with a ledger."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import import_module
from pkgutil import iter_modules

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quern.context import Context
from quern.model import Model, type_of

LEDGER = "__migrations"


class Column:
    """A column of a table builder; its methods change it and return it."""

    def __init__(self, name: str, kind: str, **meta):
        self.name, self.kind, self.null, self.meta = name, kind, True, meta

    def nullable(self) -> Column:
        self.null = True
        return self

    def required(self) -> Column:
        self.null = False
        return self

    def default(self, value: object) -> Column:
        self.meta["default"] = value
        return self

    def unique(self) -> Column:
        self.meta["unique"] = True
        return self

    @property
    def field(self) -> StructField:
        return StructField(self.name, type_of(self.kind), self.null, {k: v for k, v in self.meta.items() if v is not None})


class TableBuilder:
    """Columns, indexes and references of a table."""

    def __init__(self):
        self.columns: list[Column] = []
        self.info: dict[str, list] = {"indexes": [], "foreign": []}

    def column(self, name: str, kind: str, **meta) -> Column:
        self.columns.append(Column(name, kind, **meta))
        return self.columns[-1]

    def id(self, name: str = "Id") -> Column:
        return self.column(name, "int", key=True, auto=True).required()

    def big_id(self, name: str = "Id") -> Column:
        return self.column(name, "bigint", key=True, auto=True).required()

    def uuid(self, name: str = "Id") -> Column:
        return self.column(name, "string", key=True, length=36).required()

    def string(self, name: str, length: int = 255) -> Column:
        return self.column(name, "string", length=length)

    def text(self, name: str) -> Column:
        return self.column(name, "string")

    def integer(self, name: str) -> Column:
        return self.column(name, "int")

    def big_integer(self, name: str) -> Column:
        return self.column(name, "bigint")

    def small_integer(self, name: str) -> Column:
        return self.column(name, "smallint")

    def tiny_integer(self, name: str) -> Column:
        return self.column(name, "tinyint")

    def decimal(self, name: str, precision: int = 10, scale: int = 2) -> Column:
        return self.column(name, f"decimal({precision},{scale})")

    def float(self, name: str) -> Column:
        return self.column(name, "double")

    def double(self, name: str) -> Column:
        return self.column(name, "double")

    def boolean(self, name: str) -> Column:
        return self.column(name, "boolean")

    def date(self, name: str) -> Column:
        return self.column(name, "date")

    def datetime(self, name: str) -> Column:
        return self.column(name, "timestamp_ntz")

    timestamp = datetime

    def time(self, name: str) -> Column:
        """Seconds of the day: Spark's TIME type is behind a flag."""
        return self.column(name, "int", unit="seconds of day")

    def binary(self, name: str) -> Column:
        return self.column(name, "binary")

    def json(self, name: str, variant: bool = False) -> Column:
        return self.column(name, "variant" if variant else "string")

    def timestamps(self) -> None:
        self.datetime("CreatedAt")
        self.datetime("UpdatedAt")

    def soft_deletes(self) -> Column:
        return self.datetime("DeletedAt")

    def foreign_id(self, name: str, table: str | None = None, column: str = "Id") -> Column:
        if table:
            self.foreign(name, table, column)
        return self.column(name, "int")

    def foreign(self, column: str, table: str, other: str = "Id", on_delete: str = "cascade") -> None:
        """A reference, kept as information and looked at by Schema.orphans()."""
        self.info["foreign"].append({"column": column, "table": table, "other": other, "on_delete": on_delete})

    def index(self, *columns: str, name: str | None = None, unique: bool = False) -> None:
        """Kept as information; a compaction sorts by the first index."""
        self.info["indexes"].append({"name": name or "_".join(("ix", *columns)).lower(), "columns": list(columns), "unique": unique})

    def unique(self, *columns: str, name: str | None = None) -> None:
        self.index(*columns, name=name, unique=True)

    @property
    def schema(self) -> StructType:
        return StructType([c.field for c in self.columns])


class Schema:
    """Changes of the store's tables, each a commit of its own or part of the open transaction."""

    def __init__(self, context: Context):
        self.context, self.store = context, context.store

    def create(self, name: str, build: Callable[[TableBuilder], object]) -> None:
        b = TableBuilder()
        build(b)
        for i in b.info["indexes"]:
            if i["unique"] and len(i["columns"]) == 1:
                next(c for c in b.columns if c.name == i["columns"][0]).unique()
        self.store.create(name, b.schema, b.info)

    def drop(self, name: str) -> None:
        self.store.drop(name)

    def drop_if_exists(self, name: str) -> None:
        self.store.drop(name, missing_ok=True)

    def rename(self, name: str, new: str) -> None:
        self.store.rename(name, new)

    def has(self, name: str) -> bool:
        return self.store.has(name)

    def has_column(self, name: str, column: str) -> bool:
        return column in self.store.table(name).struct.names

    def add_column(self, name: str, build: Callable[[TableBuilder], object]) -> None:
        """Rows that are there get the default, null without one."""
        b = TableBuilder()
        build(b)
        old, df = self.store.table(name).struct, self.store.read(name)
        for c in b.columns:
            df = df.withColumn(c.name, F.lit(c.meta.get("default")).cast(c.field.dataType))
        self.store.alter(name, StructType([*old.fields, *b.schema.fields]), df)

    def drop_column(self, name: str, *columns: str) -> None:
        old = self.store.table(name).struct
        missing = set(columns) - set(old.names)
        if missing:
            raise KeyError(f"{name} has no {sorted(missing)}")
        self.store.alter(name, StructType([f for f in old if f.name not in columns]), self.store.read(name).drop(*columns))

    def rename_column(self, name: str, column: str, new: str) -> None:
        old = self.store.table(name).struct
        if column not in old.names or new in old.names:
            raise KeyError(f"cannot rename {column} of {name} to {new}")
        fields = [StructField(new, f.dataType, f.nullable, f.metadata) if f.name == column else f for f in old]
        self.store.alter(name, StructType(fields), self.store.read(name).withColumnRenamed(column, new))

    def index(self, name: str, *columns: str, index: str | None = None, unique: bool = False) -> None:
        if unique:
            twice = self.store.read(name).groupBy(*columns).count().filter("count > 1").limit(1).collect()
            if twice:
                raise ValueError(f"{name}: {tuple(twice[0])[:-1]!r} comes more than once")
        made = {"name": index or "_".join(("ix", name, *columns)).lower(), "columns": list(columns), "unique": unique}
        self.store.annotate(name, lambda info: info.setdefault("indexes", []).append(made))

    def drop_index(self, name: str, index: str) -> None:
        self.store.annotate(name, lambda info: info.update(indexes=[i for i in info.get("indexes", []) if i["name"] != index]))

    def indexes(self, name: str) -> list[dict]:
        return self.store.table(name).info.get("indexes", [])

    def orphans(self, name: str) -> dict[str, int]:
        """For each reference, the rows whose value is not in the other table."""
        out = {}
        for f in self.store.table(name).info.get("foreign", []):
            mine = self.store.read(name).select(F.col(f["column"]).alias("v")).filter("v is not null")
            other = self.store.read(f["table"]).select(F.col(f["other"]).alias("v"))
            out[f["column"]] = mine.join(other, "v", "left_anti").count()
        return out

    def duplicates(self, name: str, *columns: str) -> DataFrame:
        return self.store.read(name).groupBy(*columns).count().filter("count > 1")

    def raw(self, sql: str, **params) -> DataFrame:
        """DDL of the session's catalog."""
        return self.context.raw.execute(sql, **params)


class Migration:
    """A step with a version; versions are applied in the order of their text."""

    version: str
    description: str = ""

    def up(self, schema: Schema) -> None:
        raise NotImplementedError

    def down(self, schema: Schema) -> None:
        raise NotImplementedError


def of_model(model: type[Model]) -> Migration:
    """Creates and drops the table of a model."""
    m = Migration()
    m.version, m.description = f"Auto_{model.meta.qualified}", f"table of {model.__name__}"
    m.up = lambda schema: schema.store.create(model.meta.qualified, model.meta.schema)
    m.down = lambda schema: schema.drop(model.meta.qualified)
    return m


@dataclass
class Result:
    applied: list[str] = field(default_factory=list)
    rolled_back: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    @property
    def success(self) -> bool:
        return not self.errors


class Migrator:
    """Applies migrations and takes them back. Each step and its line in the ledger are one commit; the first error ends a run."""

    def __init__(self, context: Context, migrations: tuple[Migration, ...] = ()):
        self.context, self.schema = context, Schema(context)
        self.known: dict[str, Migration] = {}
        self.add(*migrations)

    def add(self, *migrations: Migration | type[Migration]) -> Migrator:
        for m in migrations:
            m = m() if isinstance(m, type) else m
            self.known[m.version] = m
        return self

    def discover(self, package: str) -> Migrator:
        """Adds the migrations of a package's modules."""
        root = import_module(package)
        for info in iter_modules(root.__path__):
            for x in vars(import_module(f"{package}.{info.name}")).values():
                if isinstance(x, type) and issubclass(x, Migration) and x is not Migration:
                    self.add(x)
        return self

    def _ledger(self) -> list:
        if not self.schema.has(LEDGER):
            self.schema.create(LEDGER, lambda t: (t.string("version", 100).required(), t.string("description"), t.integer("batch"), t.datetime("applied_at")))
        return sorted(self.context.store.read(LEDGER).collect(), key=lambda r: (r.batch, r.version))

    def migrate(self) -> Result:
        done, out = {r.version: r.batch for r in self._ledger()}, Result()
        batch = max(done.values(), default=0) + 1
        for version in sorted(v for v in self.known if v not in done):
            m = self.known[version]
            try:
                with self.context.transaction():
                    m.up(self.schema)
                    self.context.store.append_rows(LEDGER, [{"version": version, "description": m.description, "batch": batch, "applied_at": dt.datetime.now(dt.UTC).replace(tzinfo=None)}])
            except Exception as e:
                out.errors.append(f"{version}: {e}")
                break
            out.applied.append(version)
        return out

    def _back(self, versions: list[str]) -> Result:
        out = Result()
        for version in versions:
            try:
                if version not in self.known:
                    raise KeyError("is in the ledger but not known here")
                with self.context.transaction():
                    self.known[version].down(self.schema)
                    self.context.store.delete(LEDGER, F.col("version") == version)
            except Exception as e:
                out.errors.append(f"{version}: {e}")
                break
            out.rolled_back.append(version)
        return out

    def rollback(self, steps: int | None = None) -> Result:
        """Takes back so many steps, or the last batch."""
        ledger = self._ledger()
        last = max((r.batch for r in ledger), default=0)
        chosen = [r.version for r in reversed(ledger)]
        return self._back(chosen[:steps] if steps is not None else [r.version for r in reversed(ledger) if r.batch == last])

    def reset(self) -> Result:
        return self._back([r.version for r in reversed(self._ledger())])

    def refresh(self) -> Result:
        back = self.reset()
        if not back.success:
            return back
        again = self.migrate()
        return Result(again.applied, back.rolled_back, again.errors)

    def status(self) -> DataFrame:
        """version, description, applied, batch of all known and recorded migrations."""
        done = {r.version: r for r in self._ledger()}
        rows = [(v, self.known[v].description if v in self.known else done[v].description, v in done, done[v].batch if v in done else None) for v in sorted({*self.known, *done})]
        return self.context.spark.createDataFrame(rows, "version string, description string, applied boolean, batch int")
