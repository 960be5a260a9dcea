"""Changes of model tables: saving, bulk work, soft deletes, counters; hooks and observers around single-row work."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.validation import Checked, check
from quern.model import Model, NotFound
from quern.sources.store import Conflict

if TYPE_CHECKING:
    from quern.context import Context


class Observer:
    """Watches a model's single-row work. Methods before an action may return False to stop it."""

    def saving(self, model): ...
    def saved(self, model): ...
    def creating(self, model): ...
    def created(self, model): ...
    def updating(self, model): ...
    def updated(self, model): ...
    def deleting(self, model): ...
    def deleted(self, model): ...
    def restoring(self, model): ...
    def restored(self, model): ...


_observers: dict[type[Model], list[Observer]] = defaultdict(list)


def observe(model: type[Model], observer: Observer) -> None:
    _observers[model].append(observer)


def unobserve(model: type[Model], observer: Observer | None = None) -> None:
    """Ends one observer's watch, or that of all of a model."""
    _observers[model] = [] if observer is None else [o for o in _observers[model] if o is not observer]


def clear_observers() -> None:
    _observers.clear()


def fire(row: Model, event: str) -> bool:
    """Tells the row's own hook and then the observers; False as soon as one says so."""
    return getattr(row, f"on_{event}")() is not False and all(getattr(o, event)(row) is not False for o in _observers[type(row)])


def now() -> Column:
    return F.to_timestamp_ntz(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


class Repository:
    """Changes of one model's table. Bulk methods fire no events; all return the true numbers of rows."""

    def __init__(self, context: Context, model: type[Model]):
        self.context, self.model, self.meta, self.store, self.table = context, model, model.meta, context.store, model.meta.qualified

    # --- helpers ----------------------------------------------------------------------------------------------
    @property
    def key(self) -> str:
        if self.meta.key is None:
            raise ValueError(f"{self.table} has no key")
        return self.meta.key.name

    @property
    def _number(self) -> str | None:
        return self.meta.key.name if self.meta.key and self.meta.key.auto else None

    def _is(self, *keys: object) -> Column:
        return F.col(self.key).isin(list(keys))

    def _visible(self) -> Column:
        mark = self.meta.marked("deleted")
        return F.col(mark.name).isNull() if mark else F.lit(True)

    def _moment(self):
        return self.context.spark.range(1).select(now()).first()[0]

    def _stamped(self, df: DataFrame, *marks: str) -> DataFrame:
        for m in marks:
            f = self.meta.marked(m)
            if f and f.name not in df.columns:
                df = df.withColumn(f.name, now())
            elif f and m == "updated":
                df = df.withColumn(f.name, now())
        return df

    def _frame(self, rows: list[dict] | DataFrame) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows
        rows = [{self.meta.column(k).name: v for k, v in (r.to_dict() if isinstance(r, Model) else r).items()} for r in rows]
        names = [f for f in self.meta.schema if any(f.name in r for r in rows)]
        return self.context.spark.createDataFrame([tuple(r.get(f.name) for f in names) for r in rows], StructType([type(f)(f.name, f.dataType, True) for f in names]))

    # --- one row ----------------------------------------------------------------------------------------------
    def save(self, row: Model) -> Model | None:
        """Inserts a row without a key, updates one with a key (and inserts it if the key is unknown). None if a hook stopped it."""
        if not fire(row, "saving"):
            return None
        there = not row.is_new and not self.store.read(self.table).filter(self._is(row.key)).isEmpty()
        if not fire(row, "updating" if there else "creating"):
            return None
        moment = self._moment()
        for m in ("updated",) if there else ("created", "updated"):
            f = self.meta.marked(m)
            if f and (m == "updated" or row.values.get(f.name) is None):
                row.values[f.name] = moment
        if there:
            self.store.update(self.table, self._is(row.key), {k: v for k, v in row.to_dict().items() if k != self.key})
        else:
            with self.store.transaction():
                if row.is_new and self._number:
                    row.values[self.key] = self.store.table(self.table).next_id
                # null values are left out so that defaults apply
                self.store.append_rows(self.table, [{k: v for k, v in row.to_dict().items() if v is not None}], self._number)
        fire(row, "updated" if there else "created")
        fire(row, "saved")
        return row

    def create(self, **values) -> Model | None:
        return self.save(self.model(**values))

    def delete(self, row: Model) -> bool:
        if not fire(row, "deleting"):
            return False
        done = bool(self.destroy(row.key))
        if done:
            mark = self.meta.marked("deleted")
            if mark:
                row.values[mark.name] = self._moment()
            fire(row, "deleted")
        return done

    def restore(self, row: Model) -> bool:
        mark = self.meta.marked("deleted")
        if not mark or not fire(row, "restoring"):
            return False
        done = bool(self.store.update(self.table, self._is(row.key), {mark.name: None}))
        row.values[mark.name] = None
        fire(row, "restored")
        return done

    def force_delete(self, row: Model) -> bool:
        return bool(self.store.delete(self.table, self._is(row.key)))

    def fresh(self, row: Model) -> Model | None:
        """The row as it stands in the table, hidden or not."""
        return self.context.query(self.model).with_trashed().find(row.key)

    def refresh(self, row: Model) -> Model:
        found = self.fresh(row)
        if found is None:
            raise NotFound(self.table, row.key)
        row.values = found.values
        return row

    def in_table(self, row: Model) -> bool:
        return self.fresh(row) is not None

    def first_or_new(self, search: dict, values: dict | None = None) -> Model:
        return self._found(search) or self.model(**{**search, **(values or {})})

    def first_or_create(self, search: dict, values: dict | None = None) -> Model:
        """Looks and creates in one transaction: if another writer changed the table meanwhile, it looks again."""
        return self._alone(lambda: self._found(search) or self.create(**{**search, **(values or {})}))

    def update_or_create(self, search: dict, values: dict) -> Model:
        def work() -> Model:
            found = self._found(search)
            return self.save(found.fill(values)) if found else self.create(**{**search, **values})

        return self._alone(work)

    def _alone(self, work: Callable[[], Model], tries: int = 20) -> Model:
        for k in range(tries):
            try:
                with self.store.transaction():
                    self.store.watch(self.table)
                    return work()
            except Conflict:
                if k == tries - 1:
                    raise

    def _found(self, search: dict) -> Model | None:
        q = self.context.query(self.model)
        for k, v in search.items():
            q = q.where_null(k) if v is None else q.where(k, v)
        return q.order_by(self.key).first() if self.meta.key else q.first()

    # --- many rows --------------------------------------------------------------------------------------------
    def bulk_insert(self, rows: list[dict] | DataFrame) -> int:
        """One append, whatever the number of rows."""
        return self.store.append(self.table, self._stamped(self._frame(rows), "created", "updated"), self._number)

    def insert_returning(self, rows: list[dict] | DataFrame, *columns: str) -> DataFrame:
        """bulk_insert(), and the given columns (the key, if none) of the new rows."""
        with self.store.transaction():
            self.bulk_insert(rows)
            return self.store.appended(self.table).select(*(columns or (self.key,)))

    def check(self, rows: list[dict] | DataFrame) -> Checked:
        """The rows with the errors of the rules that the model's fields declare; saving does not ask for it."""
        return check(self._frame(rows), self.meta.rules)

    def bulk_update(self, rows: list[dict] | DataFrame) -> int:
        """Updates by key in one rewrite; rows with unknown keys are left out. Columns that are not given stay."""
        return self.store.merge(self.table, self._stamped(self._frame(self._alike(rows)), "updated"), [self.key], insert=False)[0]

    def bulk_upsert(self, rows: list[dict] | DataFrame, on: list[str] | None = None) -> tuple[int, int]:
        """Updates what is there and inserts the rest; the numbers of both."""
        created = self.meta.marked("created")
        df = self._stamped(self._frame(self._alike(rows)), "created", "updated")
        return self.store.merge(self.table, df, on or [self.key], number=self._number, keep=(created.name,) if created else ())

    @staticmethod
    def _alike(rows: list[dict] | DataFrame) -> list[dict] | DataFrame:
        """Rows to merge must name the same columns: one that is not named would otherwise become null."""
        if not isinstance(rows, DataFrame) and len({frozenset(r) for r in rows if isinstance(r, dict)}) > 1:
            raise ValueError("the rows name different columns")
        return rows

    def destroy(self, *keys: object) -> int:
        """Deletes by key, softly where the model has a mark; the number of rows that were visible before."""
        return self.delete_where(self._is(*keys))

    bulk_delete = destroy

    def bulk_force_delete(self, *keys: object) -> int:
        return self.store.delete(self.table, self._is(*keys))

    def delete_where(self, condition: Column, force: bool = False) -> int:
        """Soft where possible; rows go for good only with force."""
        mark = self.meta.marked("deleted")
        if force or not mark:
            return self.store.delete(self.table, condition)
        return self.store.update(self.table, condition & self._visible(), {mark.name: now()})

    def update_where(self, condition: Column, values: dict[str, object]) -> int:
        """Sets values on visible rows; the time of update is not touched."""
        return self.store.update(self.table, condition & self._visible(), values)

    def increment(self, column: str, by: object = 1, where: Column | None = None, key: object = None) -> int:
        """Adds to a column, on one key or where a condition holds."""
        test = self._is(key) if key is not None else where if where is not None else F.lit(True)
        return self.update_where(test, {column: F.col(column) + F.lit(by)})

    def decrement(self, column: str, by: object = 1, where: Column | None = None, key: object = None) -> int:
        return self.increment(column, -by, where, key)

    def restore_where(self, condition: Column) -> int:
        mark = self.meta.marked("deleted")
        return self.store.update(self.table, condition & F.col(mark.name).isNotNull(), {mark.name: None}) if mark else 0

    def truncate(self) -> int:
        return self.store.truncate(self.table)
