"""Caches on the driver: values and persisted frames with lifetimes, tags and counts; query results keyed by snapshot, plan and parameters."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

MISSING = object()


@dataclass
class Entry:
    value: object
    until: float | None
    tags: frozenset[str] = frozenset()

    def gone(self, now: float) -> bool:
        return self.until is not None and now >= self.until


@dataclass
class Stats:
    hits: int = 0
    misses: int = 0
    writes: int = 0

    @property
    def ratio(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


@dataclass
class Cache:
    """Keys with values. `ttl` is in seconds, None for ever; frames are persisted on entry and released when they leave. Expired keys are swept once a minute by whoever comes."""

    ttl: float | None = 3600
    clock: Callable[[], float] = time.monotonic
    sweep_every: float = 60
    enabled: bool = True
    stats: Stats = field(default_factory=Stats)

    def __post_init__(self):
        self._entries: dict[str, Entry] = {}
        self._lock = threading.RLock()
        self._swept = self.clock()

    # --- one key ----------------------------------------------------------------------------------------------
    def get(self, key: str, default: object = None):
        with self._lock:
            self._maybe_sweep()
            found = self._entries.get(key) if self.enabled else None
            if found is None or found.gone(self.clock()):
                self.stats.misses += 1
                if found is not None:
                    self._drop(key)
                return default
            self.stats.hits += 1
            return found.value

    def set(self, key: str, value: object, ttl: float | None = MISSING, tags: Iterable[str] = ()) -> None:
        if not self.enabled:
            return
        life = self.ttl if ttl is MISSING else ttl
        with self._lock:
            self._maybe_sweep()
            old = self._entries.get(key)
            if old is not None and old.value is not value:
                self._drop(key)
            if isinstance(value, DataFrame):
                value.persist()
            self._entries[key] = Entry(value, None if life is None else self.clock() + life, frozenset(tags))
            self.stats.writes += 1

    def has(self, key: str) -> bool:
        with self._lock:
            found = self._entries.get(key)
            return self.enabled and found is not None and not found.gone(self.clock())

    def forget(self, key: str) -> bool:
        with self._lock:
            return self._drop(key)

    def pull(self, key: str, default: object = None):
        """Gets and forgets. A frame stays persisted; its release is the caller's."""
        with self._lock:
            out = self.get(key, default)
            self._entries.pop(key, None)
            return out

    def add(self, key: str, value: object, ttl: float | None = MISSING) -> bool:
        """Sets a key that is not there; whether it did."""
        with self._lock:
            if self.has(key):
                return False
            self.set(key, value, ttl)
            return True

    def increment(self, key: str, by: int = 1) -> int:
        with self._lock:
            found = self._entries.get(key)
            if found is None or found.gone(self.clock()):
                self.set(key, by)
                return by
            found.value += by
            return found.value

    def decrement(self, key: str, by: int = 1) -> int:
        return self.increment(key, -by)

    def remember(self, key: str, make: Callable[[], object], ttl: float | None = MISSING, tags: Iterable[str] = ()):
        """The value, made if it is not there."""
        found = self.get(key, MISSING)
        if found is MISSING:
            found = make()
            self.set(key, found, ttl, tags)
        return found

    def remember_forever(self, key: str, make: Callable[[], object]):
        return self.remember(key, make, None)

    # --- many keys --------------------------------------------------------------------------------------------
    def flush(self) -> None:
        with self._lock:
            for k in list(self._entries):
                self._drop(k)

    def forget_tag(self, tag: str) -> int:
        return self._forget(lambda k, e: tag in e.tags)

    def forget_prefix(self, prefix: str) -> int:
        return self._forget(lambda k, e: k.startswith(prefix))

    def clean(self) -> int:
        """Forgets what has expired."""
        now = self.clock()
        return self._forget(lambda k, e: e.gone(now))

    def keys(self, prefix: str = "") -> list[str]:
        now = self.clock()
        with self._lock:
            return sorted(k for k, e in self._entries.items() if k.startswith(prefix) and not e.gone(now))

    def __len__(self) -> int:
        return len(self.keys())

    def _forget(self, which: Callable[[str, Entry], bool]) -> int:
        with self._lock:
            gone = [k for k, e in self._entries.items() if which(k, e)]
            for k in gone:
                self._drop(k)
            return len(gone)

    def _drop(self, key: str) -> bool:
        found = self._entries.pop(key, None)
        if found is not None and isinstance(found.value, DataFrame):
            found.value.unpersist()
        return found is not None

    def _maybe_sweep(self) -> None:
        now = self.clock()
        if now - self._swept >= self.sweep_every:
            self._swept = now
            self.clean()


def key_of(df: DataFrame, params: dict | None = None, versions: dict[str, str] | None = None) -> str:
    """Names a result by its plan, the files that its scans list with their sizes and times, the rows of its local tables, its parameters and the
    snapshots it reads: equal names mean equal results. Literals keep their case. A plan over other data that the text does not tell apart
    (an RDD, a persisted frame) is named by that object, so it is found again only for the same one."""
    plan = df._jdf.queryExecution().analyzed()
    whole = json.dumps([str(plan.canonicalized().toString()), leaves(df), params or {}, versions or {}], sort_keys=True, default=str)
    return hashlib.sha256(whole.encode()).hexdigest()


def leaves(df: DataFrame) -> list[str]:
    """What each leaf of the plan reads."""
    jvm, found = df.sparkSession._jvm, []
    hadoop = df.sparkSession._jsc.hadoopConfiguration()
    each = df._jdf.queryExecution().analyzed().collectLeaves().iterator()
    while each.hasNext():
        leaf = each.next()
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            listed = []
            for f in leaf.relation().location().inputFiles():
                path = jvm.org.apache.hadoop.fs.Path(f)
                status = path.getFileSystem(hadoop).getFileStatus(path)
                listed.append([f, status.getLen(), status.getModificationTime()])
            found.append(hashlib.sha256(json.dumps(listed).encode()).hexdigest())
        elif kind == "LocalRelation":
            found.append(hashlib.sha256(str(leaf.data().mkString("\n")).encode()).hexdigest())
        elif kind in ("Range", "OneRowRelation"):
            found.append(str(leaf.canonicalized().toString()))
        else:
            found.append(f"{kind}@{jvm.System.identityHashCode(leaf.rdd() if kind == 'LogicalRDD' else leaf)}")
    return found


class QueryCache:
    """Persisted results of queries. A write to a table gives it a new version, so results that read the old one are not found again."""

    def __init__(self, ttl: float | None = 300, cache: Cache | None = None):
        self.cache = cache or Cache(ttl)

    def remember(self, df: DataFrame, params: dict | None = None, tables: dict[str, str] | None = None, ttl: float | None = MISSING) -> DataFrame:
        """df, persisted, or the frame that was persisted for the same result before. tables: name -> version."""
        return self.cache.remember(key_of(df, params, tables), lambda: df, ttl, tags=[f"table:{t.lower()}" for t in tables or ()])

    def remember_forever(self, df: DataFrame, params: dict | None = None, tables: dict[str, str] | None = None) -> DataFrame:
        return self.remember(df, params, tables, None)

    def forget(self, df: DataFrame, params: dict | None = None, tables: dict[str, str] | None = None) -> bool:
        return self.cache.forget(key_of(df, params, tables))

    def forget_table(self, *names: str) -> int:
        return sum(self.cache.forget_tag(f"table:{n.lower()}") for n in names)

    def flush(self) -> None:
        self.cache.flush()


#: Shared caches of the process, and functions over them.
values = Cache()
results = QueryCache()
get, put, has, forget, remember, flush = values.get, values.set, values.has, values.forget, values.remember, values.flush
remember_query, forget_table = results.remember, results.forget_table
