"""More verification queries: rules over whole tables, single rows, lists, caches, schema changes, readers and codes."""

from __future__ import annotations

import asyncio

from pyspark.sql import functions as F

from quern import cache as caches
from quern.cache import Cache, QueryCache
from quern.context import Context
from quern.functions import hashing, text, validation
from quern.migrate import Schema, of_model
from quern.model import Field, Model, without_scopes
from quern.operators import rawsql
from quern.operators.relations import BelongsToMany, HasMany
from quern.plans.catalogue import Builder, Customer, Nation, Order, Part, Region, Supplier, changing, query
from quern.sources import external, scratch


# --- validation rules over all orders -----------------------------------------------------------------------------
def quoted(v: object) -> str:
    return "null" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v).lower()


def rule(name: str, cases: list[tuple], args: tuple = (), title: str = "", other: str | None = None):
    """Registers a rule over all orders, whose texts go round the cases (value, whether it passes)."""
    n = len(cases)
    values, goods = (", ".join(quoted(c[k]) for c in cases) for k in (0, 1))
    sql = f"select o_orderkey, list_extract([{values}], cast(o_orderkey % {n} + 1 as int)) as value, list_extract([{goods}], cast(o_orderkey % {n} + 1 as int)) as ok from orders"

    def run(c: Context):
        place = (F.col("o_orderkey") % n + 1).cast("int")
        df = c.table("orders").withColumn("value", F.element_at(F.array(*(F.lit(v).cast("string") for v, _ in cases)), place))
        df = df.withColumn("value_confirmation", F.lit("secret")).withColumn("other", F.lit(other).cast("string"))
        return df.select("o_orderkey", "value", validation.passes("value", name, list(args)).alias("ok"))

    run.__name__ = f"rule_{title or name}"
    query(sql)(run)


rule("nullable", [(None, True), ("", True), ("x", True)])
rule("email", [("a@b.co", True), ("a.b+c@x.y.org", True), ("a@b", False), ("a b@c.de", False), ("", True), (None, True), ("@b.co", False)])
rule("numeric", [("12", True), ("-1.50", True), ("1,234.5", True), ("abc", False), ("1.2.3", False), ("", True), (None, True)])
rule("integer", [("12", True), ("-7", True), (" 5 ", True), ("1.5", False), ("99999999999", False), ("x", False), ("", True)])
rule("boolean", [("true", True), ("NO", True), ("1", True), ("2", False), ("maybe", False), (None, True)])
rule("date", [("2024-02-29", True), ("2023-02-29", False), ("2024-01-05 10:11:12", True), ("soon", False), ("", True)])
rule("length", [("abcde", True), ("abcd", False), ("", False), (None, False), ("äöüßé", True)], ("5",))
rule("alpha", [("abc", True), ("ÇĞışöü", True), ("a1", False), ("a b", False), ("", True)])
rule("alpha_num", [("abc1", True), ("ş9", True), ("a_1", False), ("a-1", False), (None, True)])
rule("alpha_dash", [("a_b-1", True), ("a.b", False), ("a b", False), ("", True)])
rule("regex", [("abc", True), ("xyz", True), ("b", False), ("", True)], ("^a|z$",))
rule("not_in", [("a", False), ("b", False), ("c", True), ("", True)], ("a", "b"))
rule("confirmed", [("secret", True), ("Secret", False), ("", False), (None, False)])
rule("same", [("twin", True), ("other", False), (None, False)], ("other",), other="twin")
rule("different", [("twin", False), ("other", True), (None, True)], ("other",), other="twin")
rule("starts_with", [("pre-x", True), ("sub-x", True), ("x-pre", False), ("", True)], ("pre", "sub"))
rule("ends_with", [("x.csv", True), ("x.tsv", True), ("csv.x", False), (None, True)], (".csv", ".tsv"))
rule("uuid", [("6f9619ff-8b86-d011-b42d-00c04fc964ff", True), ("{6F9619FF-8B86-D011-B42D-00C04FC964FF}", True), ("6f9619ff8b86d011b42d00c04fc964ff", True), ("6f9619ff", False), ("", True)])
rule("ip", [("1.2.3.4", True), ("256.1.1.1", False), ("::1", True), ("2001:db8::8a2e:370:7334", True), ("1.2.3", False), ("", True)])
rule("json", [('{"a": 1}', True), ("[1, 2]", True), ("x", False), ("", True)])
rule("phone", [("+90 (532) 123-45-67", True), ("12345", False), ("abcdefghij", False), (None, True)])
rule("after", [("2024-05-01", True), ("2024-04-30", False), ("2023-01-01", False), ("", True)], ("2024-04-30",))
rule("before", [("2024-05-01", False), ("2024-04-29", True), ("", True)], ("2024-04-30",))
rule("password", [("Abcdefg1", True), ("abcdefg1", False), ("ABCDEFG1", False), ("Abcdefgh", False), ("Ab1", False), ("", True)])
rule("credit_card", [("4111111111111111", True), ("4111-1111-1111-1111", True), ("4111111111111112", False), ("12", False)], title="card")
rule("iban", [("GB82 WEST 1234 5698 7654 32", True), ("DE89370400440532013000", True), ("DE89370400440532013001", False)], title="bank_account")
rule("tc_kimlik", [("10000000146", True), ("10000000147", False), ("00000000146", False)], title="identity")


# --- long lists, caches -------------------------------------------------------------------------------------------
@query("select o_orderkey from orders where o_orderkey % 2 = 0 and o_orderkey < 6000 or o_custkey = 7")
def where_in_long_or(c):
    return c.query(Order).select("o_orderkey").where_in("o_orderkey", range(0, 6000, 2)).or_where("o_custkey", 7).df()


@query("select o_orderkey from orders where not (o_orderkey % 2 = 0 and o_orderkey < 6000) and o_orderstatus = 'F' or o_orderkey = 4")
def where_not_in_long_or(c):
    return c.query(Order).select("o_orderkey").where_not_in("o_orderkey", range(0, 6000, 2)).where("o_orderstatus", "F").or_where("o_orderkey", 4).df()


@query("select o_orderkey from orders where o_orderstatus = 'P' or o_orderkey % 2 = 0 and o_orderkey < 6000 and o_custkey not in (select x * 3 from range(1200) t(x))")
def or_where_in_long(c):
    return c.query(Order).select("o_orderkey").where("o_orderstatus", "P").or_where_in("o_orderkey", range(0, 6000, 2)).where_not_in("o_custkey", range(0, 3600, 3)).df()


@query("select (select count(*) from customer) as one, (select count(*) from supplier) as two, 1500 as three, 1501 as four")
def cache_two_tables(c):
    """Plans that read the same way from other files, or other long lists, are other results."""
    cache = QueryCache()
    folders = []
    for name in ("customer", "supplier"):
        path = scratch.folder(c.spark)
        c.table(name).select(F.col(c.table(name).columns[0]).alias("k")).write.parquet(path)
        folders.append(path)
    counts = [cache.remember(c.spark.read.parquet(p)).count() for p in folders]
    numbers = Context(c.spark)
    numbers.register("numbers", c.spark.range(5000))
    lists = [cache.remember(numbers.query("numbers").where_in("id", range(n)).df()).count() for n in (1500, 1501)]
    cache.flush()
    return c.spark.createDataFrame([(*counts, *lists)], "one long, two long, three int, four int")


@query("select 'a' as k, true as first, true as again, false as gone, 5 as n, 1 as tagged")
def cache_values(c):
    cache = Cache(ttl=10)
    cache.set("a", 1, tags=["t"])
    cache.set("b", 2)
    first, again = cache.add("c", 3), cache.get("a") == 1
    cache.increment("n", 5)
    tagged = cache.forget_tag("t")
    return c.spark.createDataFrame([("a", first, again, cache.has("a"), cache.get("n"), tagged)], "k string, first boolean, again boolean, gone boolean, n int, tagged int")


@query("select 7 as made, 7 as kept, false as there")
def cache_functions(c):
    made = caches.remember("quern-check", lambda: 7)
    kept = caches.get("quern-check")
    caches.forget("quern-check")
    return c.spark.createDataFrame([(made, kept, caches.has("quern-check"))], "made int, kept int, there boolean")


# --- single rows --------------------------------------------------------------------------------------------------
class Note(Model, table="notes"):
    id = Field("bigint", key=True)
    title = Field("string", length=40)
    n = Field("int", default=1)
    made = Field("timestamp_ntz", created=True)
    seen = Field("timestamp_ntz", updated=True)
    gone = Field("timestamp_ntz", deleted=True)


def notes(c: Context, *titles: str) -> Context:
    c.store.create("notes", Note.meta.schema)
    c.repository(Note).bulk_insert([{"title": t} for t in titles])
    return c


@query("select c_custkey, c_name from customer order by c_custkey limit 1")
def first_row(c):
    row = c.query(Customer).order_by("c_custkey").first_or_fail()
    return c.spark.createDataFrame([(row.c_custkey, row.c_name)], "c_custkey long, c_name string")


@query("select n_nationkey, n_name, true as missing from nation where n_nationkey = 7")
def find_or_fail(c):
    row = c.query(Nation).find_or_fail(7)
    try:
        c.query(Nation).find_or_fail(-1)
        missing = False
    except LookupError:
        missing = True
    return c.spark.createDataFrame([(row.n_nationkey, row.n_name, missing)], "n_nationkey int, n_name string, missing boolean")


@query("select n_nationkey, n_name from nation where n_regionkey = 2")
def rows_found(c):
    return rawsql.found(c.table("nation"), "n_regionkey", 2).select("n_nationkey", "n_name")


@query("select count(*) as n, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as f from orders")
def rows_total(c):
    df = c.table("orders")
    return c.spark.createDataFrame([(rawsql.total(df), rawsql.total(df, "o_orderstatus = 'F'"))], "n long, f long")


@changing(sql="select * from (values (1, 'a', 1), (2, 'b', 5), (3, 'new', 9)) t(id, title, n)")
def create_or_update(c):
    """first_or_new, first_or_create, update_or_create, refresh, fill and replicate."""
    repo = notes(c, "a", "b").repository(Note)
    repo.first_or_new({"title": "never saved"})
    repo.first_or_create({"title": "a"}, {"n": 7})
    repo.update_or_create({"title": "b"}, {"n": 5})
    row = repo.update_or_create({"title": "c"}, {"n": 9})
    copy = row.replicate().fill({"title": "other"})
    repo.save(repo.refresh(row).fill({"TITLE": "new"}))
    return c.query(Note).select("cast(id as int) as id", "title", "n").df() if copy.is_new else c.query(Note).df()


@changing(Supplier, sql="select s_suppkey from supplier where s_suppkey not in (1, 2)")
def bulk_force_delete(c):
    repo = c.repository(Supplier)
    repo.bulk_force_delete(1)
    repo.force_delete(c.query(Supplier).find(2))
    return c.query(Supplier).select("s_suppkey").df()


@changing(sql="select * from (values (1, 'a', true, true, true), (2, 'b', false, true, true)) t(id, title, gone, stamped, later)")
def timestamps_and_trash(c):
    repo = notes(c, "a", "b").repository(Note)
    row = c.query(Note).find(1)
    repo.save(row)
    repo.delete(row)
    return c.query(Note).with_trashed().select("cast(id as int) as id", "title", "gone is not null as gone", "made is not null as stamped", "seen >= made as later").df()


@changing(sql="select * from (values (1, 'a'), (2, 'b'), (3, 'c')) t(id, title)")
def insert_returning(c):
    notes(c)
    return c.repository(Note).insert_returning([{"title": t} for t in "abc"], "id", "title").selectExpr("cast(id as int) as id", "title")


@changing(sql="select 3 as last, true as none")
def session_last_id(c):
    notes(c, "a", "b", "c")
    return c.spark.createDataFrame([(c.store.last_id("notes"), c.store.last_id("others") is None)], "last int, none boolean")


@query("select c_custkey from customer")
def scopes_off(c):
    with without_scopes(Builder):
        return c.query(Builder).select("c_custkey").df()


@query("select n_nationkey, '{\"n_nationkey\": ' || n_nationkey || ', \"n_name\": \"' || n_name || '\"}' as only, n_regionkey as rest from nation")
def row_parts(c):
    import json

    rows = c.query(Nation).models()
    return c.spark.createDataFrame([(r.n_nationkey, json.dumps(r.only("N_NATIONKEY", "n_name")), r.without("n_nationkey", "n_name")["n_regionkey"]) for r in rows], "n_nationkey int, only string, rest int")


# --- upserts of many rows -----------------------------------------------------------------------------------------
@changing(Order, sql="select o_orderkey, case when o_custkey % 3 = 0 then 'U' else o_orderstatus end as o_orderstatus from orders union all select o_orderkey + 10000000, 'N' from orders where o_custkey % 3 = 0")
def bulk_upsert_orders(c):
    mine = c.frames["orders"].filter("o_custkey % 3 = 0")
    rows = mine.withColumn("o_orderstatus", F.lit("U")).unionByName(mine.withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000).withColumn("o_orderstatus", F.lit("N")))
    c.repository(Order).bulk_upsert(rows)
    return c.query(Order).select("o_orderkey", "o_orderstatus").df()


@changing(Order, sql="select o_orderkey, case when o_orderkey % 10 = 0 then o_totalprice * 2 else o_totalprice end as o_totalprice from orders")
def bulk_update_orders(c):
    c.repository(Order).bulk_update(c.frames["orders"].filter("o_orderkey % 10 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice")))
    return c.query(Order).select("o_orderkey", "o_totalprice").df()


@changing(Order, sql="select o_orderkey from orders union all select o_orderkey + 10000000 from orders")
def bulk_insert_orders(c):
    c.repository(Order).bulk_insert(c.frames["orders"].withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))
    return c.query(Order).select("o_orderkey").df()


@changing(Region, Nation, sql="select (select count(*) - 1 from region) as regions, (select count(*) - 1 from nation) as nations")
def many_statements(c):
    c.raw.transaction(lambda: c.repository(Region).bulk_delete(0), lambda: c.repository(Nation).bulk_delete(0))
    return c.spark.createDataFrame([(c.query(Region).count(), c.query(Nation).count())], "regions long, nations long")


@changing(Region, sql="select r_regionkey from region where r_regionkey > 1")
def vacuumed(c):
    c.repository(Region).bulk_delete(0)
    c.repository(Region).bulk_delete(1)
    c.store.vacuum()
    return c.query(Region).select("r_regionkey").df()


# --- relations ----------------------------------------------------------------------------------------------------
@query("select o_orderkey, c_custkey from orders join customer on c_custkey = o_custkey where c_custkey = 5")
def relation_of_one(c):
    return Customer.orders.of(c, c.query(Customer).find(5)).select("o_orderkey", "o_custkey as c_custkey").df()


@query("select c_custkey, count(o_orderkey) as n, coalesce(min(o_orderkey), 0) as least from customer left join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING' group by c_custkey")
def eager_of_some(c):
    """Children are narrowed to these parents before they are gathered."""
    df = c.query(Customer).where("c_mktsegment", "BUILDING").with_("orders").df()
    return df.select("c_custkey", F.size("orders").cast("long").alias("n"), F.coalesce(F.array_min(F.transform("orders", lambda o: o["o_orderkey"])), F.lit(0)).alias("least"))


@query("select o_orderkey, count(p_partkey) as n from orders left join (select distinct l_orderkey, l_partkey from lineitem) on l_orderkey = o_orderkey left join part on p_partkey = l_partkey group by o_orderkey")
def eager_many_to_many(c):
    links = BelongsToMany(Part, c.table("lineitem").select("l_orderkey", "l_partkey").distinct(), "l_orderkey", "l_partkey")
    links.__set_name__(Order, "parts")
    return links.attached(c, c.query(Order).df()).select("o_orderkey", F.size("parts").cast("long").alias("n"))


@changing(Nation, Region, sql="select n_nationkey, n_regionkey from nation where n_regionkey <> 1 union all select 100, 2")
def relation_changes(c):
    link = HasMany(Nation, "n_regionkey")
    link.__set_name__(Region, "nations")
    link.create(c, Region(r_regionkey=2), n_nationkey=100, n_name="NEW")
    link.delete_all(c, Region(r_regionkey=1))
    return c.query(Nation).select("n_nationkey", "n_regionkey").df()


@query("select n_nationkey, r_name from nation join region on r_regionkey = n_regionkey and r_name like 'A%'")
def join_kinds(c):
    some = c.query(Nation).join(c.query(Region).where("r_name", "LIKE", "A%").df(), on=("n_regionkey", "r_regionkey"), how="left_semi").df()
    return c.query(some).join("region", on=("n_regionkey", "r_regionkey")).select("n_nationkey", "r_name").df()


@query("select n_nationkey from nation where n_regionkey not in (select r_regionkey from region where r_name like 'A%')")
def join_anti(c):
    return c.query(Nation).join(c.query(Region).where("r_name", "LIKE", "A%").df(), on=("n_regionkey", "r_regionkey"), how="left_anti").select("n_nationkey").df()


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def group_cube(c):
    return c.query(Order).df().cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("select l_returnflag, quantile_cont(l_quantity, 0.5) as middle from lineitem group by l_returnflag")
def group_percentile(c):
    return c.query("lineitem").group_by("l_returnflag").select("l_returnflag", "percentile(l_quantity, 0.5) as middle").df()


# --- raw SQL and readers ------------------------------------------------------------------------------------------
@query("select s_suppkey, s_name from supplier where s_acctbal > 1000 order by s_suppkey limit 1")
def raw_first(c):
    row = c.raw.first("select s_suppkey, s_name from supplier where s_acctbal > @least order by s_suppkey limit 1", least=1000)
    return c.spark.createDataFrame([tuple(row)], "s_suppkey long, s_name string")


@query("select count(*) as n, max(s_acctbal) as most from supplier")
def output_values(c):
    c.named.define("sizes", "select count(*) as n, max(s_acctbal) as most from supplier where s_acctbal > @least", least=-1e9)
    found = c.named.output("sizes")
    return c.spark.createDataFrame([(found["n"], found["most"])], "n long, most double")


@query("select r_regionkey, r_name from region where r_regionkey < 3")
def raw_execute(c):
    c.raw.execute("create or replace temporary view quern_some as select * from region where r_regionkey < 3")
    return c.raw.execute("select r_regionkey, r_name from quern_some")


@query("select true as scan, true as pushed")
def inspect_plan(c):
    plan = c.query(Order).where("o_totalprice", ">", 1000).select("o_orderkey").plan()
    return c.spark.createDataFrame([("Scan parquet" in plan, "GreaterThan(o_totalprice,1000.0)" in plan)], "scan boolean, pushed boolean")


@query("select count(*) as n, sum(s_suppkey)::bigint as total from supplier")
def row_callback(c):
    seen = []
    n = rawsql.each(c.table("supplier"), lambda r: seen.append(r.s_suppkey))
    return c.spark.createDataFrame([(n, sum(seen))], "n long, total long")


@query("select n_nationkey, n_name from nation")
def row_dictionaries(c):
    return c.spark.createDataFrame([(d["n_nationkey"], d["n_name"]) for d in rawsql.dictionaries(c.table("nation"))], "n_nationkey int, n_name string")


@query("select s_suppkey from supplier order by s_suppkey limit 5")
def read_limited(c):
    return rawsql.limited(c.table("supplier").select("s_suppkey").orderBy("s_suppkey"), 5)


@query("select count(*) as n from part")
def read_async(c):
    n = asyncio.run(rawsql.in_background(c.table("part"), lambda df: df.count()))
    return c.spark.createDataFrame([(n,)], "n long")


@query("select o_orderkey from orders where o_custkey = 11")
def int_search(c):
    return rawsql.searched(c.table("orders").select("o_orderkey", "o_custkey"), "o_custkey", 11).select("o_orderkey")


@query("select min(s_suppkey) as lo, max(s_suppkey) as hi from supplier")
def first_and_last(c):
    df = c.table("supplier")
    return c.spark.createDataFrame([(rawsql.first_row(df.orderBy("s_suppkey"))[0], rawsql.last_row(df, "s_suppkey")[0])], "lo long, hi long")


def through_files(kind: str, **options):
    def run(c):
        path = scratch.folder(c.spark)
        c.table("customer").write.format(kind).options(**options).save(path)
        return external.source(c.spark, kind, path=path, schema=c.table("customer").schema, **options)

    run.__name__ = f"files_{kind}"
    return run


for _kind, _options in (("csv", {"header": "true"}), ("json", {}), ("orc", {})):
    query("select * from customer")(through_files(_kind, **_options))


@query("select n_nationkey, n_name, n_regionkey from nation")
def database_roundtrip(c):
    """Through a database by its driver: a bulk sink, and a read in parallel by key."""
    import uuid

    there = external.Connection("derby", database=f"memory:quern{uuid.uuid4().hex}")
    external.sink(c.table("nation").selectExpr("n_nationkey as N_NATIONKEY", "n_name as N_NAME", "n_regionkey as N_REGIONKEY"), there, "NATION", mode="overwrite", batch=7)
    c.settings.connections["db"] = there
    found = c.source("db", "NATION", key="N_NATIONKEY", partitions=3)
    return found.selectExpr("cast(N_NATIONKEY as int) as n_nationkey", "N_NAME as n_name", "cast(N_REGIONKEY as int) as n_regionkey")


@query("select 'jdbc:sqlserver://h:1433;databaseName=d' as a, 'jdbc:mysql://h:3306/d' as b, 'jdbc:mysql://h:3306/d?permitMysqlScheme' as c, 'jdbc:postgresql://h:5432/d' as d, 'jdbc:sqlite:d' as e")
def database_addresses(c):
    urls = [external.Connection(k, "h", "d").options()["url"] for k in ("sqlserver", "mysql", "mariadb", "postgresql", "sqlite")]
    return c.spark.createDataFrame([tuple(urls)], "a string, b string, c string, d string, e string")


# --- functions ----------------------------------------------------------------------------------------------------
@query("select c_custkey, case when c_custkey % 3 = 2 then 'none' when c_custkey % 3 = 1 then ' ' else c_name end as shown, c_custkey % 3 = 2 as empty, c_custkey % 3 > 0 as blank from customer")
def text_empty(c):
    v = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, " ").otherwise("")
    return c.table("customer").select("c_custkey", text.default_if_empty(v, "none").alias("shown"), text.is_empty(v).alias("empty"), text.is_blank(v).alias("blank"))


@query("select page_id, page_id % 3 = 0 as mail, page_id % 3 <> 1 as url from pages")
def text_kinds(c):
    n = F.col("page_id") % 3
    return c.table("pages").select("page_id", text.is_email(F.when(n == 0, "a.b@host.org").when(n == 1, "a@b").otherwise("")).alias("mail"), text.is_url(F.when(n == 1, "no address").otherwise("http://host.org/a/b")).alias("url"))


@query("select p_partkey, 'http://h/?name=' || replace(p_name, ' ', '%20') || '&brand=' || replace(p_brand, '#', '%23') as url from part")
def built_url(c):
    return c.table("part").select("p_partkey", text.built_url(F.lit("http://h/"), {"name": "p_name", "brand": "p_brand"}).alias("url"))


@query("select n_nationkey, sha256(n_name) as h, md5(n_name) as m, to_base64(unhex(sha256(n_name))) as b from nation")
def digests(c):
    return c.table("nation").select("n_nationkey", hashing.digest("n_name").alias("h"), hashing.digest("n_name", "md5").alias("m"), hashing.digest_base64("n_name").alias("b"))


@query("select n_nationkey, 40 as size, true as same, true as differs from nation")
def hmac_sha1(c):
    """Against the standard library's keyed hash."""
    import hashlib
    import hmac

    known = {r[0]: hmac.new(b"secret", r[1].encode(), hashlib.sha1).hexdigest() for r in c.table("nation").select("n_nationkey", "n_name").collect()}
    want = c.spark.createDataFrame(list(known.items()), "n_nationkey int, want string")
    h, other = hashing.hmac_hex("n_name", "secret", "sha1"), hashing.hmac_hex("n_name", "secret2", "sha1")
    return c.table("nation").join(want, "n_nationkey").select("n_nationkey", F.length(h).alias("size"), (h == F.col("want")).alias("same"), (h != other).alias("differs"))


@query("select c_custkey, 8 as code, true as characters, 36 as guid, 32 as short, 16 as bytes from customer")
def random_codes(c):
    code = hashing.random_code(8, seed=3)
    made = c.table("customer").select("c_custkey", code.alias("x"), hashing.guid().alias("g"), hashing.guid(False).alias("s"), hashing.random_bytes(16).alias("b"))
    return made.select("c_custkey", F.length("x").alias("code"), F.col("x").rlike(f"^[{hashing.CODE_CHARACTERS}]+$").alias("characters"), F.length("g").alias("guid"), F.length("s").alias("short"), F.octet_length("b").alias("bytes"))


# --- schema changes -----------------------------------------------------------------------------------------------
@changing(sql="select ['notes'] as made, true as there, 1 as indexes, 0 as left_over")
def schema_changes(c):
    c.models = [Note]
    made = c.ensure_created()
    schema = Schema(c)
    schema.index("notes", "title", index="by_title")
    n = len(schema.indexes("notes"))
    there = schema.has("notes") and schema.has_column("notes", "title")
    c.ensure_deleted()
    return c.spark.createDataFrame([(made, there, n, len([t for t in c.store.current() if t == "notes"]))], "made array<string>, there boolean, indexes int, left_over int")


@changing(sql="select true as up, false as down")
def model_migration(c):
    schema, m = Schema(c), of_model(Note)
    m.up(schema)
    up = schema.has("notes")
    m.down(schema)
    return c.spark.createDataFrame([(up, schema.has("notes"))], "up boolean, down boolean")


__all__ = ["Note", "rule"]
