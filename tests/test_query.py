"""The builder's decisions, one by one."""

import datetime as dt
import random

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.context import Context
from quern.model import Field, Model, NotFound, Scope, without_scopes
from quern.operators import rawsql
from quern.operators.positions import numbered
from quern.operators.query import Query, top_level
from quern.plans import catalogue

SF = "/root/testdata/sf0.001"


class Thing(Model, table="things", scopes=(Scope("kind", "x"), Scope("lost", None))):
    id = Field("int", key=True)
    kind = Field("string")
    lost = Field("string")
    n = Field("int")
    gone = Field("timestamp_ntz", deleted=True)


NOW = dt.datetime(2024, 1, 1)
ROWS = [(1, "x", None, 5, None), (2, "x", None, None, NOW), (3, "y", None, 7, None), (4, "x", "l", 9, None), (5, "x", None, 1, None), (0, "x", None, 2, None)]


@pytest.fixture
def c(spark):
    out = Context(spark)
    out.register("things", spark.createDataFrame(ROWS, "id int, kind string, lost string, n int, gone timestamp_ntz"))
    return out


def ids(q):
    return sorted(r[0] for r in q.select("id").rows())


def test_conventions():
    class Widget(Model):
        WidgetId: int
        name: str

    assert Widget.meta.table == "Widgets" and Widget.meta.key.name == "WidgetId" and Widget.meta.key.auto
    assert Thing.meta.marked("deleted").name == "gone" and Thing(id=0).is_new is False and Thing().is_new
    assert [f.name for f in Thing.meta.schema] == ["id", "kind", "lost", "n", "gone"]
    with pytest.raises(TypeError):

        class Bad(Model):
            id: int
            what: object


def test_scopes_and_trash(c):
    assert ids(c.query(Thing)) == [0, 1, 5]
    assert ids(c.query(Thing).with_trashed()) == [0, 1, 2, 5]
    assert ids(c.query(Thing).only_trashed()) == [2]
    with without_scopes(Thing):
        assert ids(c.query(Thing)) == [0, 1, 3, 4, 5]
        with without_scopes():
            pass
        assert ids(c.query(Thing)) == [0, 1, 3, 4, 5]
    assert ids(c.query(Thing)) == [0, 1, 5]


def test_or_never_leaks(c):
    assert ids(c.query(Thing).where("n", 5).or_where("id", ">", 0)) == [1, 5]


def test_immutable_and_typed(c):
    q = c.query(Thing)
    q.where("n", 5)
    assert q.count() == 3 and q.sum("n") == 8 and q.avg("n") == pytest.approx(8 / 3) and q.min("n") == 1 and q.max("n") == 5
    none = q.where("n", 100)
    assert (none.count(), none.sum("n"), none.avg("n"), none.min("n"), none.value("n")) == (0, 0, 0, None, None)
    assert q.select("n").count() == 3 and q.value("kind") == "x"
    assert q.exists() and none.doesnt_exist()


def test_none_and_lists(c):
    assert ids(c.query("things").where("gone", None)) == []
    assert ids(c.query("things").where_in("id", [])) == [] and len(ids(c.query("things").where_not_in("id", []))) == 6
    assert ids(c.query("things").where_not_in("n", [5, None])) == []
    big = [*range(3, 5000)]
    assert ids(c.query("things").where_in("id", big)) == [3, 4, 5] and ids(c.query("things").where_not_in("n", big)) == [0, 5]


def test_names_and_operators_are_checked(c):
    for bad in (lambda: c.query(Thing).where("id; drop", 1), lambda: c.query(Thing).where("id", "= 1 or", 1), lambda: c.query(Thing).order_by("id", "sideways"), lambda: c.query(Thing).where("id", "IS", 3)):
        with pytest.raises(ValueError):
            bad()


def test_find_and_fail(c):
    assert c.query(Thing).find(0).n == 2 and c.query(Thing).find(2) is None
    assert c.query(Thing).with_trashed().find(2).trashed
    with pytest.raises(NotFound) as e:
        c.query(Thing).find_or_fail(77)
    assert e.value.key == 77
    with pytest.raises(NotFound):
        c.query(Thing).where("n", 100).first_or_fail()


def test_pages(c):
    p = c.query(Thing).paginate(2, 2)
    assert (p.total, p.pages, p.has_previous, p.has_next, p.first_item, p.last_item) == (3, 2, True, False, 3, 3)
    assert [r.id for r in p.items.collect()] == [5]
    empty = c.query(Thing).where("n", 100).paginate(0, 0)
    assert (empty.pages, empty.first_item, empty.last_item, empty.has_next) == (0, 0, 0, False)


def test_chunks(c):
    seen = []
    assert c.query(Thing).chunk(2, lambda part: seen.append([r.id for r in part])) == 2 and seen == [[0, 1], [5]]
    seen.clear()
    assert c.query(Thing).chunk_by_id(1, lambda part: seen.append(part[0].id) or len(seen) < 2) == 2
    assert [r.chunk for r in c.query(Thing).chunked(2).orderBy("id").collect()] == [0, 0, 1]
    assert numbered(c.table("things").limit(0)).count() == 0


def rows_on_the_driver(spark, monkeypatch, run):
    """The most rows that one collect() or toLocalIterator() brings to the driver while run() makes its plan."""
    most, frame = [0], type(spark.range(0))

    def counted(name):
        made = getattr(frame, name)

        def taken(self, *rest, **named):
            out = list(made(self, *rest, **named))
            most[0] = max(most[0], len(out))
            return iter(out) if name == "toLocalIterator" else out

        return taken

    for name in ("collect", "toLocalIterator"):
        monkeypatch.setattr(frame, name, counted(name))
    run()
    monkeypatch.undo()
    return most[0]


def test_keyset_chunks_are_one_pass(spark, monkeypatch):
    """Jobs do not grow with the chunks, and equal keys or nulls on the border of two chunks lose no row."""
    keys = [None, None, None, *(k // 3 for k in range(57))]
    q = Query(spark.createDataFrame([(k,) for k in keys], "id int"), "t")
    seen = []
    spark.sparkContext.setJobGroup("chunks", "chunks")
    try:
        assert q.chunk_by_id(2, lambda part: seen.append([r.id for r in part]), "id") == 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [k for part in seen for k in part] == keys and len(spark.sparkContext.statusTracker().getJobIdsForGroup("chunks")) < 15
    want = [(i, len(p), min((k for k in p if k is not None), default=None), max((k for k in p if k is not None), default=None)) for i, p in enumerate(seen)]
    assert sorted(map(tuple, q.chunks_by_id(2, "id").collect())) == want
    assert q.limit(0).chunks_by_id(7, "id").agg(F.sum("n")).first()[0] == 60 and q.where("id", 99).chunks_by_id(7, "id").count() == 0
    assert rows_on_the_driver(spark, monkeypatch, lambda: spark.range(7).collect()) == 7
    assert rows_on_the_driver(spark, monkeypatch, lambda: catalogue.QUERIES["chunk_by_id_summary"](spark, SF)) < 100


def test_batches_stay_on_the_executors(spark, monkeypatch):
    df = spark.range(50).repartition(3).select(F.col("id").alias("batch"))
    sizes = [r["count"] for r in rawsql.batches(df, 8, "part").groupBy("part").count().orderBy("part").collect()]
    assert sizes == [8] * 6 + [2] and rawsql.batches(df, 0, "part").agg(F.max("part"), F.countDistinct("batch")).first() == (0, 50)
    assert [r.part for r in rawsql.batches(df.orderBy("batch"), 8, "part").orderBy("batch").collect()] == [k // 8 for k in range(50)]
    assert rawsql.batches(df.limit(0), 8).count() == 0
    assert rows_on_the_driver(spark, monkeypatch, lambda: catalogue.QUERIES["read_batches"](spark, SF)) < 100


def test_numbering_is_dense(spark):
    # many rows for each partition, so that range bounds come from a sample
    df = numbered(spark.range(200_000).repartition(3), [F.desc("id")])
    assert df.filter(F.col("id") + F.col("position") != 199_999).isEmpty() and df.count() == 200_000


def test_group_needs_aggregates(c):
    q = c.query("things").group_by("kind").select("kind", "count(*) as c", "max(n) as m").having("count(*)", ">", 1).order_by("m", "desc")
    assert [tuple(r) for r in q.rows()] == [("x", 5, 9)]
    assert sorted(r[0] for r in c.query("things").group_by("kind").rows()) == ["x", "y"]
    assert top_level("a, f(b, c), 'x,y'") == ["a", "f(b, c)", "'x,y'"]


def test_plans(spark):
    q = Query(spark.read.parquet(f"{SF}/orders.parquet"), "orders").select("o_orderkey", "o_totalprice").where("o_custkey", 5).order_by_desc("o_totalprice").limit(15).offset(10)
    plan = q.plan()
    assert "TakeOrderedAndProject" in plan and "EqualTo(o_custkey,5)" in plan and "o_comment" not in plan and "o_orderstatus" not in plan.split("ReadSchema")[1]
    day = Query(spark.read.parquet(f"{SF}/events.parquet"), "events").where_date("ts", "2024-01-05").plan()
    assert "GreaterThanOrEqual(ts" in day


def test_raw_and_readers(c):
    assert rawsql.with_colons("select '@a', @b -- @c\n, \"@d\", :e") == "select '@a', :b -- @c\n, \"@d\", :e"
    assert c.raw.scalar("select max(n) from things where id < @top", top=3) == 5
    assert c.raw.scalar("select n from things where id = 77", int) == 0 and c.raw.scalar("select n from things where id = 77") is None
    assert c.raw.first("select id from things where id = :k", k=3).id == 3
    with pytest.raises(ValueError):
        c.raw.execute("delete from things")
    df = c.table("things").orderBy("id")
    sizes = []
    assert rawsql.batched(df, lambda b: sizes.append(len(b)), 4) == 6 and sizes == [4, 2]
    assert [r.id for r in rawsql.paged(df, 0, 2, "id").collect()] == [0, 1] and rawsql.limited(df, 0).count() == 6
    assert next(rawsql.dictionaries(df))["id"] == 0 and rawsql.each(df, lambda r: None) == 6
    assert rawsql.filtered(df, "kind", "") is None and rawsql.last_row(df, "id").id == 5 and rawsql.first_row(df).id == 0
    assert rawsql.found(df, "id", 99) is None and rawsql.total(df, "n > 5") == 2
    c.named.define("one", "select id, n from things where id = @k", k=1)
    assert c.named.output("one") == {"id": 1, "n": 5} and c.named.output("one", k=99) == {}


def test_background(c):
    import asyncio

    async def both():
        n = await rawsql.in_background(c.table("things"), lambda df: df.count())
        return n, [r["id"] async for r in rawsql.stream_rows(c.table("things").orderBy("id"), 2)]

    assert asyncio.run(both()) == (6, [0, 1, 2, 3, 4, 5])


conditions = st.lists(st.tuples(st.booleans(), st.sampled_from(["a", "b"]), st.sampled_from(["=", "<>", "<", ">="]), st.one_of(st.none(), st.integers(0, 3))), min_size=1, max_size=5)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(conditions)
def test_random_conditions_agree_with_sql(spark, parts):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, 0, 1, 2, 3])) for i in range(60)]
    q = Query(spark.createDataFrame(rows, "id int, a int, b int"))
    sql = ""
    for either, column, op, value in parts:
        q = q.or_where(column, op, value) if either else q.where(column, op, value)
        sql += (" or " if either else " and ") * bool(sql) + f"{column} {op} {'null' if value is None else value}"
    con = duckdb.connect()
    con.execute("create table t (id int, a int, b int)")
    con.executemany("insert into t values (?, ?, ?)", rows)
    assert ids(q) == sorted(r[0] for r in con.sql(f"select id from t where {sql}").fetchall())


@pytest.mark.parametrize("either", [False, True])
@pytest.mark.parametrize("size", [1000, 1001])
def test_long_lists_obey_and_and_or(spark, size, either):
    """Lists on both sides of the limit give the same rows, with OR and without, in any place."""
    df = spark.range(5000).withColumn("n", F.when(F.col("id") % 11 > 0, F.col("id") % 100)).withColumn("_v0", F.lit(1))
    q, inside = Query(df), lambda r: r < size
    also = (lambda q: q.or_where("id", 4999)) if either else (lambda q: q.where("id", "<", 3000))
    plus = {4999} if either else set()
    most = 5000 if either else 3000
    assert ids(also(q.where_in("id", range(size)))) == sorted({r for r in range(5000) if inside(r) and r < most} | plus)
    assert ids(also(q.where_not_in("id", range(size)))) == sorted({r for r in range(5000) if not inside(r) and r < most} | plus)
    first = q.where("n", 5).or_where_in("id", range(size)).where_not_in("n", range(-size, 50)) if either else q.where("n", 5).where_in("id", range(size))
    n = lambda r: r % 100 if r % 11 else None
    want = [r for r in range(5000) if n(r) == 5 or (inside(r) and n(r) is not None and n(r) >= 50)] if either else [r for r in range(size) if n(r) == 5]
    assert ids(first) == want
