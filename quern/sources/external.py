"""Files and JDBC databases, by kind and options."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Connection:
    """Settings of a database; `url` overrides what the parts would give."""

    kind: str = "sqlserver"
    server: str | None = None
    database: str | None = None
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    port: int | None = None
    timeout: int = 30
    integrated: bool = False
    url: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        out = {"url": self.url or DATABASES[self.kind].url(self), "queryTimeout": str(self.timeout), **self.extra}
        if DATABASES[self.kind].driver:
            out["driver"] = DATABASES[self.kind].driver
        if self.user and not self.integrated:
            out |= {"user": self.user, "password": self.password or ""}
        return out


@dataclass(frozen=True)
class Database:
    """How a kind of database is reached."""

    url: Callable[[Connection], str]
    driver: str


def host(c: Connection, port: int) -> str:
    if not c.server or not c.database:
        raise ValueError(f"{c.kind} needs a server and a database")
    return f"{c.server}:{c.port or port}"


DATABASES = {
    "sqlserver": Database(lambda c: f"jdbc:sqlserver://{host(c, 1433)};databaseName={c.database}" + (";integratedSecurity=true" if c.integrated else ""), "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "mysql": Database(lambda c: f"jdbc:mysql://{host(c, 3306)}/{c.database}", "com.mysql.cj.jdbc.Driver"),
    "mariadb": Database(lambda c: f"jdbc:mysql://{host(c, 3306)}/{c.database}?permitMysqlScheme", "org.mariadb.jdbc.Driver"),
    "postgresql": Database(lambda c: f"jdbc:postgresql://{host(c, 5432)}/{c.database}", "org.postgresql.Driver"),
    "sqlite": Database(lambda c: f"jdbc:sqlite:{c.database}", "org.sqlite.JDBC"),
    "derby": Database(lambda c: f"jdbc:derby:{c.database};create=true", "org.apache.derby.jdbc.EmbeddedDriver"),
}
FILES = {"parquet", "csv", "json", "orc", "text"}


def source(spark: SparkSession, kind: str, table: str | None = None, *, connection: Connection | None = None, path: str | None = None, schema: object = None, key: str | None = None, partitions: int | None = None, **options) -> DataFrame:
    """Rows of a file set (kind parquet, csv, ...) or of a database table or query.

    A database is read in parallel if a numeric key is named: its range is asked for once and cut into `partitions`."""
    if kind in FILES:
        reader = spark.read.format(kind).options(**options)
        return (reader.schema(schema) if schema is not None else reader).load(path)
    if kind == "table":
        return spark.table(table)
    c = connection or Connection(kind, **{k: v for k, v in options.items() if k in Connection.__dataclass_fields__})
    reader = spark.read.format("jdbc").options(**c.options())
    if key and partitions and partitions > 1:
        # a reader of its own: options stay with the reader that they are given to
        asked = spark.read.format("jdbc").options(**c.options())
        low, high = asked.option("query", f"select min({key}) as lo, max({key}) as hi from {table}").load().first()
        if low is not None:
            reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(partitions))
    return reader.option("dbtable", table).load()


def sink(df: DataFrame, connection: Connection, table: str, mode: str = "append", batch: int = 10_000) -> None:
    """Bulk insert: each partition writes in batches over its own connection."""
    df.write.format("jdbc").options(**connection.options()).option("dbtable", table).option("batchsize", batch).mode(mode).save()


def last_key(df: DataFrame, key: str) -> int:
    """The largest key, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
