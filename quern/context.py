"""A session with its tables: the place where models, queries, changes and raw SQL meet."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quern.model import Model
from quern.operators.changes import Repository
from quern.operators.query import Query
from quern.operators.rawsql import NamedQueries, RawSql
from quern.sources.external import Connection, source
from quern.sources.store import Store


@dataclass
class Settings:
    """What a context needs to know: where mutable tables live, and databases by name."""

    root: str | None = None
    connections: dict[str, Connection] = field(default_factory=dict)


class Context:
    """Tables come from the store first, then from registered frames, then from the session's catalog."""

    def __init__(self, spark: SparkSession, settings: Settings | str | None = None, models: tuple[type[Model], ...] = ()):
        self.spark = spark
        self.settings = Settings(settings) if isinstance(settings, str) else settings or Settings()
        self._store = Store(spark, self.settings.root) if self.settings.root else None
        self.frames: dict[str, DataFrame] = {}
        self.models = list(models)
        self.raw = RawSql(self)
        self.named = NamedQueries(self.raw)

    @classmethod
    def of_files(cls, spark: SparkSession, folder: str, names: tuple[str, ...], root: str | None = None) -> Context:
        """A context over Parquet files folder/<name>.parquet."""
        out = cls(spark, Settings(root))
        for n in names:
            out.frames[n] = spark.read.parquet(f"{folder}/{n}.parquet")
        return out

    @property
    def store(self) -> Store:
        if self._store is None:
            raise RuntimeError("this context has no store: give Settings a root")
        return self._store

    def register(self, name: str, df: DataFrame) -> None:
        self.frames[name] = df

    def table(self, name: str) -> DataFrame:
        if self._store and self._store.has(name):
            return self._store.read(name)
        if name in self.frames:
            return self.frames[name]
        return self.spark.table(name)

    def tables(self) -> list[str]:
        return sorted({*self.frames, *(self._store.current() if self._store else ())})

    def frame(self, model: type[Model]) -> DataFrame:
        return self.table(model.meta.qualified)

    def query(self, of: type[Model] | str | DataFrame) -> Query:
        if isinstance(of, DataFrame):
            return Query(of, context=self)
        if isinstance(of, str):
            return Query(self.table(of), of.rpartition(".")[2], context=self)
        return Query(self.frame(of), of.meta.table, of, self)

    def repository(self, model: type[Model]) -> Repository:
        return Repository(self, model)

    def source(self, name: str, table: str, **options) -> DataFrame:
        """A table of a configured database."""
        if name not in self.settings.connections:
            raise KeyError(f"no connection {name!r} is configured")
        c = self.settings.connections[name]
        return source(self.spark, c.kind, table, connection=c, **options)

    @contextmanager
    def transaction(self) -> Iterator[None]:
        with self.store.transaction():
            yield

    def try_transaction(self, work) -> bool:
        """Runs work in a transaction; whether it was committed."""
        try:
            with self.transaction():
                work()
        except Exception:
            return False
        return True

    # --- tables of the models ---------------------------------------------------------------------------------
    def ensure_created(self) -> list[str]:
        """Creates the tables of models that have none; returns their names. One commit."""
        made = []
        with self.transaction():
            for m in self.models:
                if not self.store.has(m.meta.qualified):
                    self.store.create(m.meta.qualified, m.meta.schema)
                    made.append(m.meta.qualified)
        return made

    def ensure_deleted(self) -> None:
        with self.transaction():
            for m in self.models:
                self.store.drop(m.meta.qualified, missing_ok=True)

    def ensure_fresh(self) -> list[str]:
        with self.transaction():
            self.ensure_deleted()
            return self.ensure_created()

    def status(self) -> dict[str, object]:
        """What the session runs on."""
        sc = self.spark.sparkContext
        return {"master": sc.master, "application": sc.applicationId, "parallelism": sc.defaultParallelism, "version": sc.version}
