"""Mutable tables as snapshots: immutable Parquet folders named by a log of manifests.

A manifest tells, for all tables, which folders hold their rows. A commit writes the next manifest under a name that must not exist yet, so of two
writers one wins, and the other tries again on top unless both changed the same table. Many tables in one manifest make a
transaction atomic. Appends add a folder; updates and deletes write the folders anew that hold
the rows concerned, and leave the old ones to readers of earlier snapshots until vacuum(). All file access goes through Hadoop's file systems, so the root may be any shared store.
"""

from __future__ import annotations

import copy
import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.positions import numbered_table
from quern.sources import scratch


#: A claim to the next version without its manifest counts as abandoned after so many seconds.
STALE_S = 60


class Conflict(RuntimeError):
    """Another writer changed the same table meanwhile."""


class Violation(ValueError):
    """Rows break a constraint of their table."""


@dataclass
class Table:
    """What a manifest says of one table."""

    schema: dict
    paths: list[str] = field(default_factory=list)
    next_id: int = 1
    version: str = ""
    info: dict = field(default_factory=dict)

    @property
    def struct(self) -> StructType:
        return StructType.fromJson(self.schema)


@dataclass
class Staged:
    """Changes of an open transaction."""

    base: int
    tables: dict[str, Table | None]
    seen: dict[str, str]
    folders: list[str] = field(default_factory=list)


class Store:
    """Tables under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._open: ContextVar[Staged | None] = ContextVar(f"staged-{uuid.uuid4().hex}", default=None)
        self._last: dict[str, int] = {}
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_log"))

    # --- manifests --------------------------------------------------------------------------------------------
    def _log(self, n: int) -> str:
        return f"{self.root}/_log/{n:012d}.json"

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_log")))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def _read(self, n: int) -> dict[str, Table]:
        stream = self._fs.open(self._path(self._log(n)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {k: Table(**v) for k, v in json.loads(text).items()}

    def _write(self, n: int, tables: dict[str, Table]) -> bool:
        """Whether the manifest was created; False if another writer was first. It is complete under another name before it gets its own."""
        draft = self._path(f"{self.root}/_log/_{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({k: vars(v) for k, v in tables.items()}).encode()))
        stream.close()
        target = self._path(self._log(n))
        try:
            # a local rename would replace the target, so the name is taken by exclusive creation first
            claim = self._path(f"{self.root}/_log/{n:012d}.claim")
            self._fs.create(claim, False).close()
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            if not self._fs.exists(target):  # its writer is at work, or died
                age = time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000
                if age > STALE_S:
                    self._fs.delete(claim, False)
                time.sleep(0.1)
            return False
        return bool(self._fs.rename(draft, target))

    def current(self, version: int | None = None) -> dict[str, Table]:
        """The tables of a version, the newest by default, with the open transaction's changes."""
        found = self.versions()
        n = (found[-1] if found else 0) if version is None else version
        tables = self._read(n) if n else {}
        staged = self._open.get()
        if staged and version is None:
            for name, t in staged.tables.items():
                if t is None:
                    tables.pop(name, None)
                else:
                    tables[name] = t
        return tables

    def _commit(self, staged: Staged) -> None:
        for _ in range(2 * 10 * STALE_S):
            found = self.versions()
            n = found[-1] if found else 0
            tables = self._read(n) if n else {}
            for name, version in staged.seen.items():
                if (tables[name].version if name in tables else "") != version:
                    raise Conflict(f"{name} was changed by another writer")
            for name, t in staged.tables.items():
                if t is None:
                    tables.pop(name, None)
                else:
                    tables[name] = t
            if self._write(n + 1, tables):
                return
        raise Conflict("too many writers")

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """All changes inside become one commit, or none. A transaction inside another belongs to it."""
        if self._open.get():
            yield
            return
        found = self.versions()
        staged = Staged(found[-1] if found else 0, {}, {})
        token = self._open.set(staged)
        try:
            yield
            if staged.tables:
                self._commit(staged)
        except BaseException:
            for folder in staged.folders:
                self._fs.delete(self._path(folder), True)
            raise
        finally:
            self._open.reset(token)

    def _change(self, name: str, make: Callable[[Table | None], Table | None]) -> None:
        with self.transaction():
            staged = self._open.get()
            old = self.current().get(name)
            if name not in staged.seen:
                staged.seen[name] = old.version if old else ""
            new = make(copy.deepcopy(old))
            if new is not None:
                new.version = uuid.uuid4().hex
            staged.tables[name] = new

    def watch(self, name: str) -> None:
        """Makes the open transaction's changes conflict with those of others to this table from now on."""
        old = self.current().get(name)
        self._open.get().seen.setdefault(name, old.version if old else "")

    # --- tables -----------------------------------------------------------------------------------------------
    def has(self, name: str) -> bool:
        return name in self.current()

    def table(self, name: str) -> Table:
        found = self.current().get(name)
        if found is None:
            raise KeyError(f"no table {name!r}")
        return found

    def create(self, name: str, schema: StructType, info: dict | None = None, next_id: int = 1) -> None:
        def make(old):
            if old is not None:
                raise ValueError(f"{name} exists")
            return Table(json.loads(schema.json()), next_id=next_id, info=info or {})

        self._change(name, make)

    def drop(self, name: str, missing_ok: bool = False) -> None:
        if not self.has(name):
            if missing_ok:
                return
            raise KeyError(f"no table {name!r}")
        self._change(name, lambda old: None)

    def rename(self, name: str, new: str) -> None:
        with self.transaction():
            t = self.table(name)
            if self.has(new):
                raise ValueError(f"{new} exists")
            self._change(name, lambda old: None)
            self._change(new, lambda old: t)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        t = self.current(version).get(name)
        if t is None:
            raise KeyError(f"no table {name!r}")
        if not t.paths:
            return self.spark.createDataFrame([], t.struct)
        return self.spark.read.schema(t.struct).parquet(*t.paths)

    def _folder(self, name: str, df: DataFrame) -> str:
        folder = f"{self.root}/{name.replace('.', '/')}/v{uuid.uuid4().hex}"
        self._open.get().folders.append(folder)
        df.write.parquet(folder)
        return folder

    def _fitted(self, t: Table, df: DataFrame) -> DataFrame:
        """df with the table's columns and types; missing columns get their defaults."""
        have = {c.lower(): c for c in df.columns}
        unknown = set(have) - {f.name.lower() for f in t.struct}
        if unknown:
            raise ValueError(f"unknown columns {sorted(unknown)}")
        out = []
        for f in t.struct:
            c = F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(f.metadata.get("default"))
            out.append(c.cast(f.dataType).alias(f.name))
        return df.select(*out)

    def _check(self, name: str, t: Table, rows: DataFrame, others: DataFrame | None = None, allocated: str | None = None) -> None:
        """Null, length and uniqueness constraints on written rows; others are the table's other rows, which are known to be good.
        A key that was allocated here is unique by itself."""
        tests = []
        for f in t.struct:
            if not f.nullable:
                tests.append((f"{f.name} is null", F.col(f.name).isNull()))
            if f.metadata.get("length"):
                tests.append((f"{f.name} is longer than {f.metadata['length']}", F.length(f.name) > f.metadata["length"]))
        if tests:
            found = rows.agg(*(F.coalesce(F.max(c.cast("int")), F.lit(0)).alias(f"t{i}") for i, (_, c) in enumerate(tests))).first()
            broken = [text for (text, _), bad in zip(tests, found, strict=True) if bad]
            if broken:
                raise Violation(f"{name}: {', '.join(broken)}")
        for f in t.struct:
            if f.name != allocated and (f.metadata.get("key") or f.metadata.get("unique")):
                values = rows.select(f.name).filter(F.col(f.name).isNotNull())
                twice = values.groupBy(f.name).count().filter("count > 1").limit(1).collect()
                if not twice and others is not None:
                    twice = values.join(others.select(f.name), f.name, "left_semi").limit(1).collect()
                if twice:
                    raise Violation(f"{name}: {f.name} {twice[0][0]!r} comes more than once")

    def _rows(self, t: Table, paths: list[str]) -> DataFrame | None:
        return self.spark.read.schema(t.struct).parquet(*paths) if paths else None

    @staticmethod
    def _folder_of() -> Column:
        return F.regexp_extract("_metadata.file_path", "/(v[0-9a-f]{32})/", 1).alias("folder")

    def _touched(self, t: Table, found: DataFrame) -> tuple[int, list[str]]:
        """How many rows `found` has, which are rows of the table with `folder`, and the paths of their folders."""
        counts = {r.folder: r["count"] for r in found.groupBy("folder").count().collect()}
        return sum(counts.values()), [p for p in t.paths if p.rpartition("/")[2] in counts]

    def _rewrite(self, name: str, paths: list[str], change: Callable[[DataFrame], DataFrame], check: bool = True) -> None:
        """Writes the rows of some folders anew; the other folders stay as they are."""

        def make(t):
            folder = self._folder(name, self._fitted(t, change(self._rows(t, paths))))
            t.paths = [p for p in t.paths if p not in paths] + [folder]
            if check:
                self._check(name, t, self._rows(t, [folder]), self._rows(t, t.paths[:-1]))
            return t

        self._change(name, make)

    def replace(self, name: str, df: DataFrame, next_id: int | None = None, schema: StructType | None = None, check: bool = True) -> None:
        """A new snapshot from df, which may read the old one."""

        def make(t):
            if schema is not None:
                t.schema = json.loads(schema.json())
            folder = self._folder(name, self._fitted(t, df))
            t.paths = [folder]
            t.next_id = t.next_id if next_id is None else next_id
            if check:
                self._check(name, t, self._rows(t, [folder]))
            return t

        self._change(name, make)

    def append(self, name: str, df: DataFrame, number: str | None = None) -> int:
        """Adds rows; number names the key column that gets running numbers where it is null. Returns the number of rows."""
        n = 0

        def make(t):
            nonlocal n
            rows, used = self._numbered(df, number, t) if number else (df, None)
            folder = self._folder(name, self._fitted(t, rows))
            if used:
                scratch.drop(self.spark, used)
            written = self.spark.read.schema(t.struct).parquet(folder)
            n = written.count()
            t.paths = [*t.paths, folder]
            if number and n:
                t.next_id = max(t.next_id, written.agg(F.max(number)).first()[0] + 1)
            given = number and number in df.columns and not df.filter(F.col(number).isNotNull()).isEmpty()
            self._check(name, t, written, self._rows(t, t.paths[:-1]), None if given else number)
            return t

        self._change(name, make)
        if number and n:
            self._last[name] = self.table(name).next_id - 1
        return n

    def last_id(self, name: str) -> int | None:
        """The last key that this store object numbered in a table; None if it numbered none."""
        return self._last.get(name)

    def appended(self, name: str) -> DataFrame:
        """The rows of the last append or rewrite."""
        t = self.table(name)
        return self.spark.read.schema(t.struct).parquet(t.paths[-1]) if t.paths else self.read(name)

    @staticmethod
    def _numbered(df: DataFrame, key: str, t: Table) -> tuple[DataFrame, str | None]:
        """Running numbers from next_id on for rows without a key, without one task seeing them all; and the folder used on the way."""
        named = key in df.columns
        new = df.filter(F.col(key).isNull()) if named else df
        if named and new.isEmpty():
            return df, None
        fresh, used = numbered_table(new, None, "_position")
        fresh = fresh.withColumn(key, F.col("_position") + t.next_id).drop("_position")
        if not named:
            return fresh, used
        old = df.filter(F.col(key).isNotNull())
        return old.unionByName(fresh.withColumn(key, F.col(key).cast(df.schema[key].dataType))), used

    def append_rows(self, name: str, rows: list[dict], number: str | None = None) -> int:
        """Rows from the driver. Columns that no row names get their defaults."""
        t = self.table(name)
        names = [f for f in t.struct if any(f.name in r for r in rows)]
        df = self.spark.createDataFrame([tuple(r.get(f.name) for f in names) for r in rows], StructType([type(f)(f.name, f.dataType, True) for f in names]))
        return self.append(name, df.coalesce(1), number)

    def update(self, name: str, where: Column, values: dict[str, object]) -> int:
        """Sets columns where the condition holds; a value may be a Column over the row. Only folders with such rows are written anew.
        Returns how many rows changed."""
        t, df = self.table(name), self.read(name)
        for c in values:
            if c not in df.columns:
                raise ValueError(f"{name} has no column {c!r}")
        if not t.paths:
            return 0
        hit = F.coalesce(where, F.lit(False))
        n, paths = self._touched(t, df.filter(hit).select(self._folder_of()))
        kinds = {f.name: f.dataType for f in df.schema}
        new = {c: F.when(F.col("_hit"), (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()}
        if n:
            self._rewrite(name, paths, lambda rows: rows.withColumn("_hit", hit).withColumns(new).drop("_hit"))
        return n

    def delete(self, name: str, where: Column) -> int:
        """Drops rows where the condition holds, from the folders that have them."""
        t = self.table(name)
        if not t.paths:
            return 0
        hit = F.coalesce(where, F.lit(False))
        n, paths = self._touched(t, self.read(name).filter(hit).select(self._folder_of()))
        if n:
            self._rewrite(name, paths, lambda rows: rows.filter(~hit), check=False)
        return n

    def merge(self, name: str, rows: DataFrame, on: list[str], insert: bool = True, number: str | None = None, keep: tuple[str, ...] = ()) -> tuple[int, int]:
        """Updates rows that agree with `rows` on the given columns and, with insert, adds the others. Columns that `rows` lacks, and those
        in `keep`, keep their values in updated rows. Returns the numbers of updated and added rows. `rows` may name each key once."""
        t = self.table(name)
        # written first: what is checked, counted, merged and added are the same rows, whatever the caller's plan gives when run again
        rows, used = scratch.written(rows.select(*(F.col(c).cast(t.struct[c].dataType).alias(c) for c in rows.columns)))
        try:
            return self._merged(name, t, rows, on, insert, number, keep)
        finally:
            scratch.drop(self.spark, used)

    def _merged(self, name: str, t: Table, rows: DataFrame, on: list[str], insert: bool, number: str | None, keep: tuple[str, ...]) -> tuple[int, int]:
        twice = rows.groupBy(*on).count().filter("count > 1").limit(1).collect()
        if twice:
            raise Violation(f"{name}: the key {tuple(twice[0])[:-1]!r} comes more than once in the rows to merge")
        old = self.read(name)
        new = rows.select(*(F.col(c).alias(f"_n_{c}") for c in rows.columns)).withColumn("_new", F.lit(True))
        same = F.lit(True)
        for c in on:
            same = same & (F.col(c) == F.col(f"_n_{c}"))
        n_updated, paths = self._touched(t, old.select(*on, self._folder_of()).join(rows.select(*on), on, "left_semi")) if t.paths else (0, [])
        added = rows.join(old.select(*on), on, "left_anti")
        n_added = added.count() if insert else 0
        change = [F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in rows.columns and c not in on and c not in keep else F.col(c) for c in old.columns]
        with self.transaction():
            if n_updated:
                self._rewrite(name, paths, lambda mine: mine.join(new, same, "left").select(*change))
            if n_added:
                self.append(name, added, number)
        return n_updated, n_added

    def truncate(self, name: str) -> int:
        n = self.read(name).count()

        def make(t):
            t.paths = []
            return t

        self._change(name, make)
        return n

    def alter(self, name: str, schema: StructType, df: DataFrame) -> None:
        """A new schema with its rows."""
        self.replace(name, df, schema=schema, check=False)

    def annotate(self, name: str, change: Callable[[dict], None]) -> None:
        """Changes a table's free information, such as its indexes."""

        def make(t):
            change(t.info)
            return t

        self._change(name, make)

    # --- upkeep -----------------------------------------------------------------------------------------------
    def compact(self, name: str, by: list[str] | None = None) -> None:
        """Rewrites a table's folders as one, sorted within files by the given columns."""
        df = self.read(name)
        self.replace(name, df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df, check=False)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last `keep` versions names, and older manifests. Returns the number of folders deleted."""
        found = self.versions()
        live = {p for n in found[-keep:] for t in self._read(n).values() for p in t.paths}
        known = {p for n in found for t in self._read(n).values() for p in t.paths}
        for p in known - live:
            self._fs.delete(self._path(p), True)
        for n in found[:-keep]:
            self._fs.delete(self._path(self._log(n)), False)
            self._fs.delete(self._path(f"{self.root}/_log/{n:012d}.claim"), False)
        return len(known - live)


__all__ = ["Conflict", "Store", "Table", "Violation"]
