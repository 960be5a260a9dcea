"""The verification queries: each runs through the library and has the SQL it must agree with, where SQL can say it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.cache import QueryCache
from quern.context import Context
from quern.functions import hashing, jsoncol, text, tokens, validation
from quern.migrate import Migration, Migrator
from quern.model import Field, Model, Scope
from quern.operators import rawsql
from quern.operators.changes import Observer, clear_observers, observe
from quern.operators.query import Query
from quern.operators.relations import BelongsTo, BelongsToMany, HasMany, HasOne
from quern.sources import scratch
from quern.streaming.windows import run_available, tumbling

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Region(Model, table="region"):
    r_regionkey = Field("int", key=True, auto=False)
    r_name = Field("string")


class Nation(Model, table="nation"):
    n_nationkey = Field("int", key=True, auto=False)
    n_name = Field("string")
    n_regionkey = Field("int")
    region = BelongsTo(Region, "n_regionkey")


class Part(Model, table="part"):
    p_partkey = Field("bigint", key=True, auto=False)
    p_name = Field("string")
    p_brand = Field("string")
    p_type = Field("string")
    p_size = Field("int")
    p_retailprice = Field("double")


class Item(Model, table="lineitem"):
    l_orderkey = Field("bigint")
    l_partkey = Field("bigint")
    l_suppkey = Field("bigint")
    l_linenumber = Field("int")
    l_quantity = Field("double")


class Order(Model, table="orders"):
    o_orderkey = Field("bigint", key=True, auto=False)
    o_custkey = Field("bigint")
    o_orderstatus = Field("string")
    o_totalprice = Field("double")
    o_orderdate = Field("timestamp_ntz")
    o_orderpriority = Field("string")
    items = HasMany(Item, "l_orderkey")


class SoftOrder(Model, table="soft_orders"):
    """orders, of which each seventh is trashed."""

    o_orderkey = Field("bigint", key=True, auto=False)
    o_custkey = Field("bigint")
    o_orderstatus = Field("string")
    o_totalprice = Field("double")
    o_orderdate = Field("timestamp_ntz")
    o_orderpriority = Field("string")
    deleted_at = Field("timestamp_ntz", deleted=True)


class Customer(Model, table="customer"):
    c_custkey = Field("bigint", key=True, auto=False)
    c_name = Field("string")
    c_nationkey = Field("int")
    c_acctbal = Field("double")
    c_mktsegment = Field("string")
    orders = HasMany(Order, "o_custkey")
    first_order = HasOne(Order, "o_custkey")
    nation = BelongsTo(Nation, "c_nationkey")


Order.customer = BelongsTo(Customer, "o_custkey")
Order.customer.__set_name__(Order, "customer")
Order.meta.relations["customer"] = Order.customer


class Builder(Model, table="customer", scopes=(Scope("c_mktsegment", "BUILDING"), Scope("c_acctbal", 0, ">="))):
    c_custkey = Field("bigint", key=True, auto=False)
    c_acctbal = Field("double")
    c_mktsegment = Field("string")


class Supplier(Model, table="supplier"):
    s_suppkey = Field("bigint", key=True, auto=False)
    s_name = Field("string")
    s_nationkey = Field("int")
    s_acctbal = Field("double")


def context(spark: SparkSession, sf_dir: str, root: str | None = None) -> Context:
    c = Context.of_files(spark, sf_dir, TABLES, root)
    mark = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate"))
    c.register("soft_orders", c.frames["orders"].withColumn("deleted_at", mark))
    return c


def stored(spark: SparkSession, sf_dir: str, *models: type[Model]) -> Context:
    """A context whose store holds copies of the models' tables."""
    c = context(spark, sf_dir, scratch.folder(spark))
    with c.transaction():
        for m in models:
            c.store.create(m.meta.table, m.meta.schema)
            c.store.append(m.meta.table, c.frames[m.meta.table])
    return c


QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SD = "(select *, case when o_orderkey % 7 = 0 then o_orderdate end as deleted_at from orders)"


def query(sql: str | None = None):
    """Registers a function of a context as a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(context(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql.replace("SD", SD)
        return f

    return add


def changing(*models: type[Model], sql: str | None = None):
    """The same for a function that changes copies of tables in a store."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(stored(spark, sf_dir, *models))
        if sql:
            ORACLES[f.__name__] = sql.replace("SD", SD)
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by turnover: conditions, a join, groups, a having, order and limit."""
    c = context(spark, sf_dir)
    return (
        c.query("orders")
        .join("customer", on=("o_custkey", "c_custkey"))
        .where("o_totalprice", ">", 1000)
        .group_by("c_custkey", "c_name")
        .select("c_custkey", "c_name", "count(*) as n", "round(sum(o_totalprice), 2) as total")
        .having("count(*)", ">", 2)
        .order_by("total", "DESC")
        .order_by("c_custkey")
        .limit(20)
        .df()
    )


QUERIES["flagship"] = flagship
ORACLES["flagship"] = "select c_custkey, c_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey where o_totalprice > 1000 group by c_custkey, c_name having count(*) > 2 order by total desc, c_custkey limit 20"


# --- projection and conditions ------------------------------------------------------------------------------------
@query("select * from nation")
def scan_all(c):
    return c.query(Nation).df()


@query("select c_custkey, c_name from customer")
def select_cols(c):
    return c.query(Customer).select("c_custkey", "c_name").df()


@query("select o_orderkey, o_totalprice * 2 as double_price from orders where o_orderkey < 100")
def select_alias(c):
    return c.query(Order).select("o_orderkey").select("o_totalprice * 2 as double_price").where("o_orderkey", "<", 100).df()


@query("select distinct c_mktsegment from customer")
def distinct(c):
    return c.query(Customer).select("c_mktsegment").distinct().df()


@query("select o_orderkey from orders where o_orderstatus = 'F'")
def where_eq(c):
    return c.query(Order).select("o_orderkey").where("o_orderstatus", "F").df()


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 400000")
def where_op(c):
    return c.query(Order).select("o_orderkey", "o_totalprice").where("o_totalprice", ">", 400000).df()


@query("select o_orderkey from orders where o_orderstatus = 'P' or o_orderpriority = '1-URGENT'")
def or_where(c):
    return c.query(Order).select("o_orderkey").where("o_orderstatus", "P").or_where("o_orderpriority", "1-URGENT").df()


@query("select o_orderkey from SD t where deleted_at is null and (o_orderstatus = 'P' or o_custkey = 5)")
def or_where_scoped(c):
    return c.query(SoftOrder).select("o_orderkey").where("o_orderstatus", "P").or_where("o_custkey", 5).df()


@query("select o_orderkey from SD t where deleted_at is null and o_orderstatus = 'P' or o_custkey = 5")
def or_where_compat_leak(c):
    """What a flat condition list would give; written out, since implicit conditions never mix with OR here."""
    return c.query(SoftOrder).with_trashed().select("o_orderkey").where_null("deleted_at").where("o_orderstatus", "P").or_where("o_custkey", 5).df()


@query("select o_orderkey from orders where o_orderstatus = 'P' and o_custkey < 50 or o_orderstatus = 'F' and o_custkey > 1400")
def and_or_precedence(c):
    return c.query(Order).select("o_orderkey").where("o_orderstatus", "P").where("o_custkey", "<", 50).or_where("o_orderstatus", "F").where("o_custkey", ">", 1400).df()


@query("select c_custkey from customer where c_mktsegment in ('BUILDING','MACHINERY')")
def where_in(c):
    return c.query(Customer).select("c_custkey").where_in("c_mktsegment", ["BUILDING", "MACHINERY"]).df()


@query("select o_orderkey from orders where o_orderkey % 2 = 0 and o_orderkey < 6000")
def where_in_long(c):
    return c.query(Order).select("o_orderkey").where_in("o_orderkey", range(0, 6000, 2)).df()


@query("select o_orderkey from orders where not (o_orderkey % 2 = 0 and o_orderkey < 6000)")
def where_not_in_long(c):
    return c.query(Order).select("o_orderkey").where_not_in("o_orderkey", range(0, 6000, 2)).df()


@query("select c_custkey from customer where c_mktsegment not in ('BUILDING','MACHINERY')")
def where_not_in(c):
    return c.query(Customer).select("c_custkey").where_not_in("c_mktsegment", ["BUILDING", "MACHINERY"]).df()


@query("select count(*) as cnt from customer where false")
def where_in_empty(c):
    return c.query(Customer).where_in("c_custkey", []).agg(cnt="count(*)")


@query("select o_orderkey from orders where o_totalprice between 100000 and 200000")
def where_between(c):
    return c.query(Order).select("o_orderkey").where_between("o_totalprice", 100000, 200000).df()


@query("select o_orderkey from SD t where deleted_at is null")
def where_null(c):
    return c.query("soft_orders").select("o_orderkey").where_null("deleted_at").df()


@query("select o_orderkey from SD t where deleted_at is not null")
def where_not_null(c):
    return c.query("soft_orders").select("o_orderkey").where_not_null("deleted_at").df()


@query("select o_orderkey from SD t where deleted_at = null")
def where_equals_none(c):
    return c.query("soft_orders").select("o_orderkey").where("deleted_at", None).df()


@query("select p_partkey, p_name from part where p_name like '%widget%'")
def where_like(c):
    return c.query(Part).select("p_partkey", "p_name").where_like("p_name", "widget").df()


@query("select event_id from events where cast(ts as date) = date '2024-01-05'")
def where_date(c):
    return c.query("events").select("event_id").where_date("ts", dt.datetime(2024, 1, 5, 13, 30)).df()


@query("select l_orderkey, l_linenumber from lineitem where l_discount > l_tax and l_quantity < 10")
def where_raw(c):
    return c.query("lineitem").select("l_orderkey", "l_linenumber").where_raw("l_discount > l_tax and l_quantity < 10").df()


# --- joins --------------------------------------------------------------------------------------------------------
@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def join_inner(c):
    return c.query(Order).join("customer", "o_custkey = c_custkey").select("o_orderkey", "c_name").df()


@query("select n_nationkey, s_suppkey from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 5000")
def join_left(c):
    return c.query(Nation).left_join("supplier", "s_nationkey = n_nationkey and s_acctbal > 5000").select("n_nationkey", "s_suppkey").df()


@query("select s_suppkey, n_name from supplier right join nation on s_nationkey = n_nationkey")
def join_right(c):
    return c.query("supplier").right_join("nation", on=("s_nationkey", "n_nationkey")).select("s_suppkey", "n_name").df()


@query("select r_regionkey, n_nationkey from region join nation on n_regionkey < r_regionkey")
def join_theta(c):
    return c.query(Region).join(Nation, "n_regionkey < r_regionkey").select("r_regionkey", "n_nationkey").df()


@query("select o_orderkey, c_name as customer_name, n_name as nation_name from orders join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def join_chain(c):
    q = c.query(Order).join("customer", "orders.o_custkey = customer.c_custkey").left_join("nation", "customer.c_nationkey = nation.n_nationkey")
    return q.select("orders.o_orderkey", "customer.c_name as customer_name", "nation.n_name as nation_name").df()


# --- aggregates and groups ----------------------------------------------------------------------------------------
@query("select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_custkey")
def group_by(c):
    return c.query(Order).group_by("o_custkey").select("o_custkey", "count(*) as n", "round(sum(o_totalprice), 2) as total").df()


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by l_returnflag, l_linestatus")
def group_by_multi(c):
    return c.query("lineitem").group_by("l_returnflag, l_linestatus").select("l_returnflag", "l_linestatus", "count(*) as n", "round(sum(l_quantity), 2) as qty").df()


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15")
def having(c):
    return c.query(Order).group_by("o_custkey").select("o_custkey", "count(*) as n").having("count(*)", ">", 15).df()


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and sum(o_totalprice) > 3000000")
def having_two(c):
    return c.query(Order).group_by("o_custkey").select("o_custkey", "count(*) as n").having("count(*)", ">", 12).having("sum(o_totalprice)", ">", 3000000).df()


@query("select o_custkey, count(distinct o_orderstatus) as kinds from orders group by o_custkey")
def group_distinct(c):
    return c.query(Order).group_by("o_custkey").select("o_custkey", "count(distinct o_orderstatus) as kinds").df()


@query("select count(*) as cnt from orders")
def count_all(c):
    return c.query(Order).agg(cnt="count(*)")


@query("select count(deleted_at) as cnt from SD t")
def count_col(c):
    return c.query("soft_orders").agg(cnt="count(deleted_at)")


@query("select count(distinct o_custkey) as cnt from orders")
def count_distinct(c):
    return c.query(Order).agg(cnt="count(distinct o_custkey)")


@query("select round(sum(o_totalprice), 2) as total from orders")
def sum_col(c):
    return c.query(Order).agg(total="round(sum(o_totalprice), 2)")


@query("select coalesce(sum(o_totalprice), 0) as total from orders where o_orderkey < 0")
def sum_empty(c):
    return c.query(Order).where("o_orderkey", "<", 0).agg(total="coalesce(sum(o_totalprice), 0)")


@query("select round(avg(o_totalprice), 6) as mean from orders")
def avg_col(c):
    return c.query(Order).agg(mean="round(avg(o_totalprice), 6)")


@query("select min(o_totalprice) as lo from orders")
def min_col(c):
    return c.query(Order).agg(lo="min(o_totalprice)")


@query("select max(o_totalprice) as hi from orders")
def max_col(c):
    return c.query(Order).agg(hi="max(o_totalprice)")


@query("select count(*) > 0 as found from orders where o_custkey = 5")
def exists(c):
    return c.spark.createDataFrame([(c.query(Order).where("o_custkey", 5).exists(),)], "found boolean")


@query("select count(*) = 0 as missing from orders where o_custkey = -1")
def doesnt_exist(c):
    return c.spark.createDataFrame([(c.query(Order).where("o_custkey", -1).doesnt_exist(),)], "missing boolean")


@query("select c_name from customer")
def pluck(c):
    return c.query(Customer).pluck("c_name")


@query("select c_name from customer order by c_custkey limit 1")
def value(c):
    return c.spark.createDataFrame([(c.query(Customer).order_by("c_custkey").value("c_name"),)], "c_name string")


@query("select cast(to_json(struct_pack(n_nationkey := n_nationkey, n_name := n_name)) as varchar) as j from nation")
def row_json(c):
    return c.query(Nation).select("to_json(struct(n_nationkey, n_name)) as j").df()


# --- order, limits, pages -----------------------------------------------------------------------------------------
@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def order_limit(c):
    return c.query(Order).select("o_orderkey", "o_totalprice").order_by_desc("o_totalprice").order_by("o_orderkey").take(20).df()


@query("select o_orderkey from orders order by o_orderkey limit 10 offset 25")
def limit_offset(c):
    return c.query(Order).select("o_orderkey").order_by("o_orderkey").limit(10).offset(25).df()


@query("select o_orderkey from orders order by o_orderkey limit 10 offset 20")
def page(c):
    return c.query(Order).select("o_orderkey").order_by("o_orderkey").page(3, 10).df()


@query("select o_orderkey, deleted_at from SD t order by deleted_at desc nulls last, o_orderkey limit 10")
def order_nulls(c):
    return c.query("soft_orders").select("o_orderkey", "deleted_at").order_by("deleted_at", "desc", nulls="last").order_by("o_orderkey").limit(10).df()


@query("select count(*) as total_count, cast(ceil(count(*) / 10.0) as bigint) as total_pages, 3 as current_page, 21 as first_item, least(30, count(*)) as last_item from orders")
def paginate_meta(c):
    p = c.query(Order).paginate(3, 10)
    return c.spark.createDataFrame([(p.total, p.pages, p.number, p.first_item, p.last_item)], "total_count long, total_pages long, current_page int, first_item int, last_item long")


@query("select o_orderkey from orders order by o_orderkey limit 10 offset 20")
def paginate_items(c):
    return c.query(Order).select("o_orderkey").paginate(3, 10).items


@query("select event_id, ts from events order by ts desc, event_id desc limit 5")
def latest(c):
    return c.query("events").select("event_id", "ts").latest("ts").order_by_desc("event_id").limit(5).df()


@query("select event_id, ts from events order by ts, event_id limit 5")
def oldest(c):
    return c.query("events").select("event_id", "ts").oldest("ts").order_by("event_id").limit(5).df()


@query("select n_nationkey, true as moved from nation")
def random_order(c):
    """The same rows in another order."""
    q = c.query(Nation).select("n_nationkey")
    moved = [r[0] for r in q.in_random_order(7).rows()] != [r[0] for r in q.order_by("n_nationkey").rows()]
    return q.in_random_order(7).df().select("n_nationkey", F.lit(moved).alias("moved"))


@query("select cast(floor((row_number() over (order by o_orderkey) - 1) / 4000) as bigint) as chunk, o_orderkey from orders")
def chunk_sizes(c):
    return c.query(Order).select("o_orderkey").order_by("o_orderkey").chunked(4000).select("chunk", "o_orderkey")


@query("select chunk, count(*) as n, min(o_orderkey) as first_id, max(o_orderkey) as last_id from (select o_orderkey, cast(floor((row_number() over (order by o_orderkey) - 1) / 4000) as bigint) as chunk from orders) t group by chunk")
def chunk_by_id_summary(c):
    return c.query(Order).select("o_orderkey").chunks_by_id(4000)


# --- models, scopes, soft deletes ---------------------------------------------------------------------------------
@query("select * from customer where c_custkey = 42")
def find(c):
    return c.query(Customer).where("c_custkey", 42).limit(1).df()


@query("select * from customer where c_custkey in (1, 5, 42)")
def find_many(c):
    return c.query(Customer).find_many(1, 5, 42).df()


@query("select count(*) as cnt from SD t where deleted_at is null")
def soft_delete_default(c):
    return c.query(SoftOrder).agg(cnt="count(*)")


@query("select count(*) as cnt from SD t")
def with_trashed(c):
    return c.query(SoftOrder).with_trashed().agg(cnt="count(*)")


@query("select o_orderkey, deleted_at from SD t where deleted_at is not null")
def only_trashed(c):
    return c.query(SoftOrder).only_trashed().select("o_orderkey", "deleted_at").df()


@query("select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal >= 0")
def global_scope(c):
    return c.query(Builder).select("c_custkey").df()


# --- relations ----------------------------------------------------------------------------------------------------
@query("select c_custkey, count(o_orderkey) as n_orders, round(coalesce(sum(o_totalprice), 0), 2) as total from customer left join orders on o_custkey = c_custkey group by c_custkey")
def has_many(c):
    flat = Customer.orders.joined(c, c.query(Customer).df())
    return flat.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0)), 2).alias("total"))


@query("select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by c_custkey")
def has_many_count(c):
    return Customer.orders.counted(c, c.query(Customer).select("c_custkey").df(), "n")


@query("select c_custkey, min(o_orderkey) as first_order from customer left join orders on o_custkey = c_custkey group by c_custkey")
def has_one_first(c):
    return Customer.first_order.attached(c, c.query(Customer).df()).select("c_custkey", F.col("first_order.o_orderkey").alias("first_order"))


@query("select o_orderkey, c_custkey, c_name from orders left join customer on c_custkey = o_custkey")
def belongs_to(c):
    return c.query(Order).with_("customer").df().select("o_orderkey", "customer.c_custkey", "customer.c_name")


@query("select distinct o_orderkey, p_partkey, p_name from orders join (select distinct l_orderkey, l_partkey from lineitem) pv on pv.l_orderkey = o_orderkey join part on p_partkey = pv.l_partkey ")
def belongs_to_many(c):
    links = BelongsToMany(Part, c.table("lineitem").select("l_orderkey", "l_partkey").distinct(), "l_orderkey", "l_partkey")
    links.__set_name__(Order, "parts")
    return links.joined(c, c.query(Order).df()).select("o_orderkey", "p_partkey", "p_name")


@query("select exists(select 1 from lineitem where l_orderkey = 201 and l_partkey = 101) as attached")
def pivot_contains(c):
    links = BelongsToMany(Part, "lineitem", "l_orderkey", "l_partkey")
    links.__set_name__(Order, "parts")
    return c.spark.createDataFrame([(links.contains(c, Order(o_orderkey=201), 101),)], "attached boolean")


@query("select l_orderkey, count(*) as n from lineitem group by l_orderkey")
def pivot_count(c):
    links = BelongsToMany(Part, "lineitem", "l_orderkey", "l_partkey")
    links.__set_name__(Order, "parts")
    return links.counted(c, c.query(Order).df(), "n").filter("n > 0").select(F.col("o_orderkey").alias("l_orderkey"), "n")


@query("select o_orderkey, l_linenumber, l_partkey, l_quantity from orders left join lineitem on l_orderkey = o_orderkey")
def eager_has_many(c):
    return c.query(Order).with_("items").df().select("o_orderkey", F.explode_outer("items").alias("i")).select("o_orderkey", "i.l_linenumber", "i.l_partkey", "i.l_quantity")


@query("select c_custkey, count(distinct o_orderkey) as n_orders, count(l_linenumber) as n_items from customer left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by c_custkey")
def eager_nested(c):
    n_items = F.aggregate("orders", F.lit(0).cast("long"), lambda acc, o: acc + F.size(o["items"]))
    return c.query(Customer).with_("orders.items").df().select("c_custkey", F.size("orders").cast("long").alias("n_orders"), n_items.alias("n_items"))


# --- changes ------------------------------------------------------------------------------------------------------
@changing(Region, sql="select r_regionkey, r_name from region union all select 100, 'ATLANTIS' union all select 101, 'LEMURIA'")
def bulk_insert(c):
    c.repository(Region).bulk_insert([{"r_regionkey": 100, "r_name": "ATLANTIS"}, {"r_regionkey": 101, "r_name": "LEMURIA"}])
    return c.query(Region).df()


@changing(Supplier, sql="select s_suppkey, s_name, case when s_nationkey = 3 then s_acctbal + 10 else s_acctbal end as s_acctbal from supplier")
def bulk_update(c):
    rows = c.query(Supplier).where("s_nationkey", 3).select("s_suppkey", "s_acctbal + 10 as s_acctbal").df()
    c.repository(Supplier).bulk_update(rows)
    return c.query(Supplier).select("s_suppkey", "s_name", "s_acctbal").df()


@changing(Supplier, sql="select * from supplier where s_suppkey not in (1, 2, 3)")
def bulk_delete(c):
    c.repository(Supplier).bulk_delete(1, 2, 3)
    return c.query(Supplier).df()


@changing(Region, sql="select r_regionkey, case when r_regionkey = 0 then 'AFRICA-2' else r_name end as r_name from region union all select 9, 'OCEANIA'")
def bulk_upsert(c):
    c.repository(Region).bulk_upsert([{"r_regionkey": 0, "r_name": "AFRICA-2"}, {"r_regionkey": 9, "r_name": "OCEANIA"}])
    return c.query(Region).df()


@changing(Customer, sql="select c_custkey, case when c_custkey = 5 then c_acctbal + 10 else c_acctbal end as c_acctbal from customer")
def increment(c):
    c.repository(Customer).increment("c_acctbal", 10, key=5)
    return c.query(Customer).select("c_custkey", "c_acctbal").df()


@changing(Customer, sql="select c_custkey, case when c_mktsegment = 'BUILDING' then c_acctbal - 1 else c_acctbal end as c_acctbal from customer")
def decrement_where(c):
    c.repository(Customer).decrement("c_acctbal", 1, where=F.col("c_mktsegment") == "BUILDING")
    return c.query(Customer).select("c_custkey", "c_acctbal").df()


@changing(Order, sql="select o_orderkey, case when o_orderstatus = 'P' then 'X' else o_orderstatus end as o_orderstatus from orders")
def update_where(c):
    c.repository(Order).update_where(F.col("o_orderstatus") == "P", {"o_orderstatus": "X"})
    return c.query(Order).select("o_orderkey", "o_orderstatus").df()


@changing(Order, sql="select o_orderkey from orders where o_totalprice >= 100000")
def delete_where(c):
    c.repository(Order).delete_where(F.col("o_totalprice") < 100000)
    return c.query(Order).select("o_orderkey").df()


@changing(SoftOrder, sql="select o_orderkey, case when o_orderkey = 7 then null else deleted_at end as deleted_at from SD t")
def restore(c):
    row = c.query(SoftOrder).with_trashed().find(7)
    c.repository(SoftOrder).restore(row)
    return c.query(SoftOrder).with_trashed().select("o_orderkey", "deleted_at").df()


@changing(SoftOrder, sql="select o_orderkey from SD t where deleted_at is null and o_custkey <> 5")
def soft_delete_where(c):
    c.repository(SoftOrder).delete_where(F.col("o_custkey") == 5)
    return c.query(SoftOrder).select("o_orderkey").df()


@changing(Nation, sql="select n_nationkey, n_name from nation where n_nationkey < 5")
def truncate_and_refill(c):
    kept = c.frames["nation"].filter("n_nationkey < 5")
    with c.transaction():
        c.repository(Nation).truncate()
        c.repository(Nation).bulk_insert(kept)
    return c.query(Nation).select("n_nationkey", "n_name").df()


@changing(Region, Nation, sql="select (select count(*) from region) as regions, (select count(*) from nation) as nations")
def transaction_rollback(c):
    def work():
        c.repository(Region).truncate()
        c.repository(Nation).bulk_delete(1)
        raise RuntimeError("on purpose")

    assert not c.try_transaction(work)
    return c.spark.createDataFrame([(c.query(Region).count(), c.query(Nation).count())], "regions long, nations long")


@changing(Region, sql="select unnest(['saving', 'creating', 'created', 'saved', 'saving', 'updating', 'updated', 'saved', 'deleting', 'deleted']) as event, cast(unnest(range(10)) as bigint) as n")
def event_order(c):
    seen = []

    class Log(Observer):
        pass

    for event in ("saving", "saved", "creating", "created", "updating", "updated", "deleting", "deleted"):
        setattr(Log, event, lambda self, row, event=event: seen.append(event))
    observe(Region, Log())
    try:
        repo = c.repository(Region)
        row = repo.create(r_regionkey=77, r_name="NEW")
        row.r_name = "NEWER"
        repo.save(row)
        repo.delete(row)
    finally:
        clear_observers()
    return c.spark.createDataFrame([(e, i) for i, e in enumerate(seen)], "event string, n long")


# --- raw SQL, reading, cache --------------------------------------------------------------------------------------
@query("select o_orderkey, o_totalprice from orders where o_totalprice > 450000 and o_orderstatus = 'O'")
def raw_params(c):
    return c.raw.query("select o_orderkey, o_totalprice from orders where o_totalprice > @least and o_orderstatus = :state", least=450000, state="O")


@query("select cast(count(*) as bigint) as n from lineitem where l_returnflag = 'R'")
def raw_scalar(c):
    return c.spark.createDataFrame([(c.raw.scalar("select count(*) from lineitem where l_returnflag = @flag", int, flag="R"),)], "n long")


@query("select s_suppkey from supplier where s_acctbal > 9000")
def named_query(c):
    c.named.define("rich", "select s_suppkey from supplier where s_acctbal > @least", least=5000)
    return c.named.call("rich", least=9000)


@query("select p_partkey, p_name from part where p_name like '%anvil%' order by p_name desc")
def datatable_filter(c):
    return rawsql.filtered(c.table("part").select("p_partkey", "p_name"), "p_name", "anvil")


@query("select s_suppkey from supplier order by s_suppkey limit 7 offset 14")
def read_paged(c):
    return rawsql.paged(c.table("supplier").select("s_suppkey"), 3, 7, "s_suppkey")


@query("select batch, count(*) as n from (select cast(floor((row_number() over (order by o_orderkey) - 1) / 4000) as bigint) as batch from orders) t group by batch")
def read_batches(c):
    return rawsql.batches(c.table("orders").select("o_orderkey"), 4000).groupBy("batch").agg(F.count("*").alias("n"))


@query("select coalesce(max(o_orderkey), 0) as last_key from orders")
def last_key(c):
    from quern.sources.external import last_key as largest

    return c.spark.createDataFrame([(largest(c.table("orders"), "o_orderkey"),)], "last_key long")


@query("select r_regionkey, true as hit from region where r_regionkey < 2")
def cache_hit(c):
    cache = QueryCache()
    one, other = (c.query(Region).where("r_regionkey", "<", n).df() for n in (2, 3))
    first, second = cache.remember(one), cache.remember(other)
    again = cache.remember(c.query(Region).where("r_regionkey", "<", 2).df())
    return again.select("r_regionkey", F.lit(again is first and again is not second).alias("hit"))


# --- functions ----------------------------------------------------------------------------------------------------
@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_get(c):
    return c.table("events").select("event_id", jsoncol.get("props", "k", "long").alias("k"))


@query("select event_id, len(json_keys(props)) as n_keys from events")
def json_keys(c):
    return c.table("events").select("event_id", F.size(jsoncol.keys("props")).cast("long").alias("n_keys"))


@query("select n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' as j, '[' || n_nationkey || ',' || n_regionkey || ',7]' as l from nation")
def json_build(c):
    made = c.table("nation").select("n_nationkey", "n_regionkey", F.to_json(F.struct(F.col("n_name").alias("name"))).alias("j"), F.to_json(F.array("n_nationkey", "n_regionkey")).alias("l"))
    return made.select("n_nationkey", jsoncol.put("j", "region", F.col("n_regionkey")).alias("j"), jsoncol.append("l", F.lit(7), "int").alias("l"))


@query("select doc_id, (text is not null and trim(text) <> '') as ok from documents")
def valid_required(c):
    return c.table("documents").select("doc_id", validation.passes("text", "required").alias("ok"))


@query("select doc_id, (length(text) between 10 and 1000) as ok from documents")
def valid_length(c):
    """The rule would measure a text that reads as a number by its value, so it is given the length; null has none."""
    ok = validation.passes("text", "between", ["10", "1000"], F.length("text"))
    return c.table("documents").select("doc_id", F.when(F.col("text").isNotNull(), ok).alias("ok"))


@query("select page_id, regexp_matches(url, '^https?://[^/[:space:]]+') as ok from pages")
def valid_url(c):
    return c.table("pages").select("page_id", validation.passes("url", "url").alias("ok"))


@query("select c_custkey, list_filter([case when not length(c_name) <= 18 then 'c_name max' end, case when c_mktsegment not in ('BUILDING', 'MACHINERY') then 'c_mktsegment in' end, case when not c_acctbal >= 0 then 'c_acctbal min' end], lambda x: x is not null) as broken from customer")
def valid_errors(c):
    """Names are checked by their lengths: max would measure one that reads as a number by its value."""
    rules = {"c_name": "max:18", "c_mktsegment": "in:BUILDING,MACHINERY", "c_acctbal": "min:0"}
    found = validation.check(c.table("customer").withColumn("c_name", F.length("c_name")), rules).df
    return found.select("c_custkey", F.transform("errors", lambda e: F.concat_ws(" ", e["field"], e["rule"])).alias("broken"))


@query("select value as card, good from (values ('4111111111111111', true), ('4111 1111 1111 1111', true), ('4111111111111112', false), ('123', false)) t(value, good)")
def validate_credit_card(c):
    df = c.spark.createDataFrame([("4111111111111111",), ("4111 1111 1111 1111",), ("4111111111111112",), ("123",)], "card string")
    return df.select("card", validation.passes("card", "credit_card").alias("good"))


@query("select value as iban, good from (values ('GB82 WEST 1234 5698 7654 32', true), ('DE89370400440532013000', true), ('DE89370400440532013001', false), ('XX', false)) t(value, good)")
def validate_iban(c):
    df = c.spark.createDataFrame([("GB82 WEST 1234 5698 7654 32",), ("DE89370400440532013000",), ("DE89370400440532013001",), ("XX",)], "iban string")
    return df.select("iban", validation.passes("iban", "iban").alias("good"))


@query("select value as id, good from (values ('10000000146', true), ('10000000147', false), ('00000000146', false), ('1', false)) t(value, good)")
def validate_tc_kimlik(c):
    df = c.spark.createDataFrame([("10000000146",), ("10000000147",), ("00000000146",), ("1",)], "id string")
    return df.select("id", validation.passes("id", "tc_kimlik").alias("good"))


@query("select p_partkey, case when length(p_name) <= 8 then p_name else substring(p_name, 1, 5) || '...' end as short from part")
def text_truncate(c):
    return c.table("part").select("p_partkey", text.truncated("p_name", 8).alias("short"))


@query(r"select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '-') as slug from part")
def text_slug(c):
    return c.table("part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as plain from pages")
def text_clear_html(c):
    return c.table("pages").select("page_id", text.tags_cleared("html").alias("plain"))


def _stripped(html: str) -> str:
    """The steps of stripped_html() in DuckDB's SQL."""
    out = f"regexp_replace(translate(coalesce({html}, ''), chr(13) || chr(10) || chr(9), '  '), ' +', ' ', 'g')"
    for tag in ("head", "script", "style"):
        out = f"regexp_replace({out}, '< *{tag}[^>]*>.*< */ *{tag} *>', '', 'gi')"
    for pattern, becomes in (("td[^>]*", "chr(9)"), ("br *(?:/)? *", "chr(13)"), ("li *", "chr(13)"), ("div[^>]*", "chr(13) || chr(13)"), ("tr[^>]*", "chr(13) || chr(13)"), ("p[^>]*", "chr(13) || chr(13)")):
        out = f"regexp_replace({out}, '< *{pattern}>', {becomes}, 'gi')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for name, becomes in text.ENTITIES:
        out = f"regexp_replace({out}, '&{name};', '{becomes}', 'gi')"
    out = f"regexp_replace({out}, '&.{{2,6}};', '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, chr(13) || ' +' || chr(13), chr(13) || chr(13), 'g'), chr(13) || '{{3,}}', chr(13) || chr(13), 'g')"
    return rf"regexp_replace({out}, '^\s+|\s+$', '', 'g')"


@query(f"select page_id, {_stripped('html')} as plain from pages")
def strip_html(c):
    return c.table("pages").select("page_id", text.stripped_html("html").alias("plain"))


@query("select p_partkey, replace(replace(p_name, '''', ''''''), ';', '') as safe from part")
def text_sql_cleared(c):
    return c.table("part").select("p_partkey", text.sql_cleared("p_name").alias("safe"))


@query("select c_custkey, md5(c_name) as h from customer")
def hash_md5(c):
    return c.table("customer").select("c_custkey", hashing.md5_hex("c_name").alias("h"))


@query("select c_custkey, sha256(c_name) as h from customer")
def hash_sha256(c):
    return c.table("customer").select("c_custkey", hashing.sha256_hex("c_name").alias("h"))


PADS = ["".join(chr(b ^ pad) for b in b"secret".ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"select n_nationkey, sha256(cast('{PADS[1]}' as blob) || unhex(sha256(cast('{PADS[0]}' || n_name as blob)))) as h from nation".replace("\\", "\\x5C"))
def hmac_sha256(c):
    return c.table("nation").select("n_nationkey", hashing.hmac_hex("n_name", "secret").alias("h"))


@query("select n_nationkey, n_name as back from nation")
def aes_roundtrip(c):
    sealed = c.table("nation").select("n_nationkey", hashing.encrypted("n_name", "a key", "CBC").alias("x"))
    return sealed.select("n_nationkey", hashing.decrypted("x", "a key", "CBC").alias("back"))


@query("select n_nationkey, translate(n_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') as r from nation")
def rot13(c):
    return c.table("nation").select("n_nationkey", hashing.rot13("n_name").alias("r"))


@query("select 'ann' as user, 'admin' as role, true as good, 'signature' as fault")
def jwt_claims(c):
    token = tokens.issue({"sub": "ann", "role": "admin"}, "k")
    df = c.spark.createDataFrame([(token, token[:-2] + ("AA" if token[-2:] != "AA" else "BB"))], "t string, bad string")
    return df.select(tokens.claim("t", "sub").alias("user"), tokens.claim("t", "role").alias("role"), tokens.is_valid("t", "k").alias("good"), tokens.fault("bad", "k").alias("fault"))


# --- schema, streams ----------------------------------------------------------------------------------------------
class Posts(Migration):
    version, description = "001", "posts"

    def up(self, schema):
        schema.create("posts", lambda t: (t.id(), t.string("Title", 200).required(), t.decimal("Price", 18, 2), t.timestamps(), t.soft_deletes(), t.index("Title")))

    def down(self, schema):
        schema.drop("posts")


class Likes(Migration):
    version, description = "002", "likes of posts"

    def up(self, schema):
        schema.add_column("posts", lambda t: t.integer("Likes").default(0))

    def down(self, schema):
        schema.drop_column("posts", "Likes")


@changing(sql="select * from (values ('001', 'posts', true, 1), ('002', 'likes of posts', false, null)) t(version, description, applied, batch)")
def migrate_status(c):
    m = Migrator(c, (Posts(), Likes()))
    m.migrate()
    m.rollback(1)
    return m.status()


@query("select date_trunc('day', ts) as win_start, event_type, count(*) as n from events group by 1, 2")
def stream_tumbling(c):
    """The events as a stream of files, run over all that is there."""
    folder = c.frames["events"].inputFiles()[0].rpartition("/")[0]
    names = {f.rpartition("/")[2] for f in c.frames["events"].inputFiles()}
    pattern = "events.parquet" if names == {"events.parquet"} else "*.parquet"
    stream = c.spark.readStream.schema(c.frames["events"].schema).option("pathGlobFilter", pattern).parquet(folder)
    return run_available(tumbling(stream, "ts", ["event_type"]), scratch.folder(c.spark), scratch.folder(c.spark))


@query("select date_trunc('hour', ts) as win_start, user_id, count(*) as n from events group by 1, 2")
def batch_tumbling(c):
    return tumbling(c.table("events"), "ts", ["user_id"], "1 hour")


__all__ = ["ORACLES", "QUERIES", "Query", "flagship"]
