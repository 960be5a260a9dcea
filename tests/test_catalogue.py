"""Every catalogue query against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from quern.plans import catalogue, more  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in catalogue.ORACLES:
        assert rows
        return
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)


#: texts that read as numbers, at both borders of the rules' bounds, empty and null
ODD = [None, "", " ", "500", " 500 ", "1,000", "9999999999", "-123456789", "10.5", "1e3", "\n50", "7" * 18, "7" * 19, "7" * 1000, "7" * 1001, "é" * 9, "é" * 10, "é" * 1000, "é" * 1001, "🤦🏼\u200d♂️" * 2]


@pytest.mark.parametrize(
    "name, table, schema, rows",
    [
        ("valid_length", "documents", "doc_id long, text string", [(i, t) for i, t in enumerate(ODD)]),
        ("valid_errors", "customer", "c_custkey long, c_name string, c_mktsegment string, c_acctbal double", [(i, t, ["BUILDING", "x", None][i % 3], [-1.5, 0.0, None, 7.25][i % 4]) for i, t in enumerate(ODD)]),
    ],
)
def test_lengths_of_odd_texts(spark, tmp_path, name, table, schema, rows):
    for t in catalogue.TABLES:
        if t != table:
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLES[name])
    assert want.columns == df.columns and sorted(map(plain, df.collect())) == sorted(map(plain, want.fetchall()))


def test_entry(spark):
    assert 0 < __spark_entry__.entry(spark).count() <= 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
