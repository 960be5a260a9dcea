"""Mutable tables: commits, conflicts, transactions, constraints, changes, relations, migrations."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from quern.context import Context, Settings
from quern.migrate import Migration, Migrator, Schema, of_model
from quern.model import Field, Model
from quern.operators.changes import Observer, clear_observers, observe, unobserve
from quern.operators.relations import BelongsTo, BelongsToMany, HasMany, HasOne
from quern.sources.external import Connection, last_key, sink, source
from quern.sources.store import Conflict, Store, Violation


class User(Model, table="users"):
    Id = Field("int", key=True)
    Name: str = Field(length=10)
    Age: int = Field(default=1)
    Mail: str = Field(unique=True)
    DeletedAt: dt.datetime = Field(deleted=True)
    CreatedAt: dt.datetime = Field(created=True)
    UpdatedAt: dt.datetime = Field(updated=True)


class Tag(Model, table="tags"):
    Id = Field("int", key=True)
    Word: str


class Post(Model, table="posts"):
    Id = Field("int", key=True)
    UserId = Field("int")
    Title: str
    user = BelongsTo(User)
    tags = BelongsToMany(Tag)


User.posts = HasMany(Post)
User.posts.__set_name__(User, "posts")
User.meta.relations["posts"] = User.posts
User.top = HasOne(Post)
User.top.__set_name__(User, "top")
User.meta.relations["top"] = User.top


@pytest.fixture
def c(spark, tmp_path):
    out = Context(spark, Settings(f"file://{tmp_path}/store"), (User, Post, Tag))
    assert out.ensure_created() == ["users", "posts", "tags"] and out.ensure_created() == []
    return out


def test_save_and_find(c):
    repo = c.repository(User)
    ann = repo.create(name="Ann", Mail="a@x")
    assert ann.Id == 1 and ann.CreatedAt == ann.UpdatedAt and c.query(User).find(1).Age == 1
    ann.Age = 7
    before = ann.UpdatedAt
    repo.save(ann)
    again = c.query(User).find(1)
    assert again.Age == 7 and again.CreatedAt == ann.CreatedAt and again.UpdatedAt >= before
    zero = repo.create(Id=0, Name="Zero")
    assert c.query(User).find(0).Name == "Zero" and repo.create(Name="Next").Id == 2 and zero.Id == 0
    assert repo.first_or_new({"Name": "Nobody"}, {"Age": 3}).is_new
    assert repo.first_or_create({"Name": "Ann"}).Id == 1 and repo.update_or_create({"Name": "Ann"}, {"Age": 9}).Age == 9
    assert repo.refresh(ann).Age == 9 and repo.in_table(ann) and not repo.in_table(User(Id=99))
    copy = ann.replicate()
    assert copy.is_new and copy.Name == "Ann" and set(ann.only("name")) == {"Name"} and "Name" not in ann.without("NAME")


def test_constraints(c):
    repo = c.repository(User)
    repo.create(Name="Ann", Mail="a@x")
    for bad in ({"Name": "x" * 11}, {"Name": "B", "Mail": "a@x"}):
        with pytest.raises(Violation):
            repo.create(**bad)
    with pytest.raises(Violation):
        repo.bulk_insert([{"Id": 1, "Name": "again"}])
    assert c.query(User).count() == 1
    with pytest.raises((ValueError, KeyError)):
        repo.bulk_insert([{"Nme": "typo"}])


def test_bulk_and_counts(c):
    repo = c.repository(User)
    assert repo.bulk_insert([{"Name": f"u{i}", "Age": i} for i in range(250)]) == 250
    assert sorted(r.Id for r in c.query(User).rows()) == list(range(1, 251))
    assert repo.bulk_update([{"Id": 1, "Age": 100}, {"Id": 999, "Age": 100}]) == 1
    assert c.query(User).find(1).Name == "u0" and c.query(User).find(1).Age == 100
    created = c.query(User).find(2).CreatedAt
    assert repo.bulk_upsert([{"Id": 2, "Name": "two"}, {"Id": 900, "Name": "new"}]) == (1, 1)
    assert c.query(User).find(2).CreatedAt == created and repo.create(Name="after").Id == 901
    with pytest.raises(ValueError):
        repo.bulk_update([{"Id": 1, "Age": 1}, {"Id": 2, "Name": "x"}])
    with pytest.raises(Violation):
        repo.bulk_update([{"Id": 1, "Age": 1}, {"Id": 1, "Age": 2}])
    assert repo.bulk_delete(3, 4, 12345) == 2 and repo.bulk_delete(3) == 0
    assert repo.update_where(F.col("Id").isin(3, 5), {"Age": 0}) == 1
    assert repo.increment("Age", 5, key=5) == 1 and c.query(User).find(5).Age == 5 and repo.decrement("Age", 2, where=F.col("Id") == 5) == 1
    assert repo.restore_where(F.col("Id") == 3) == 1 and repo.bulk_force_delete(3) == 1
    assert c.query(User).with_trashed().find(3) is None
    assert repo.delete_where(F.col("Id") > 10, force=True) > 200 and repo.truncate() == 9 and c.query(User).with_trashed().count() == 0


def test_only_touched_folders_are_rewritten(c):
    repo = c.repository(User)
    repo.bulk_insert([{"Name": "a"}, {"Name": "b"}])
    repo.bulk_insert([{"Name": "c"}, {"Name": "d"}])
    first, second = c.store.table("users").paths
    assert repo.increment("Age", 1, key=1) == 1
    assert second in c.store.table("users").paths and first not in c.store.table("users").paths
    assert repo.bulk_upsert([{"Id": 4, "Name": "D"}, {"Id": 9, "Name": "z"}]) == (1, 1)
    assert second not in c.store.table("users").paths and len(c.store.table("users").paths) == 3
    assert c.store.delete("users", F.col("Id") == 9) == 1 and c.store.delete("users", F.col("Id") == 99) == 0
    assert [(r.Id, r.Name, r.Age) for r in c.query(User).order_by("Id").rows()] == [(1, "a", 2), (2, "b", 1), (3, "c", 1), (4, "D", 1)]
    with pytest.raises(Violation):
        repo.update_where(F.col("Id") == 2, {"Name": "x" * 11})
    with pytest.raises(Violation):
        c.store.update("users", F.col("Id") == 2, {"Id": 3})


def test_returning_checks_and_memory(c):
    repo = c.repository(User)
    assert sorted(r.Id for r in repo.insert_returning([{"Name": "a"}, {"Name": "b"}]).collect()) == [1, 2]
    assert {(r.Id, r.Name) for r in repo.insert_returning([{"Name": "c"}], "Id", "Name").collect()} == {(3, "c")}

    class Strict(Model, table="users"):
        Id = Field("int", key=True)
        Name = Field("string", rules="required|max_length:3")

    assert c.repository(Strict).check([{"Name": "abcd"}, {"Name": "ok"}]).failing().count() == 1
    one = c.query(User).remember()
    assert c.query(User).remember() is one and one.count() == 3
    repo.create(Name="d")
    assert c.query(User).remember().count() == 4


def test_soft_delete_and_events(c):
    seen = []

    class Log(Observer):
        def deleting(self, row):
            seen.append("deleting")
            return row.Name != "keep"

        def restored(self, row):
            seen.append("restored")

    log = Log()
    observe(User, log)
    try:
        repo = c.repository(User)
        ann, keep = repo.create(Name="Ann"), repo.create(Name="keep")
        assert repo.delete(ann) and ann.trashed and not repo.delete(keep) and c.query(User).count() == 1
        assert repo.restore(ann) and not ann.trashed and c.query(User).count() == 2
        unobserve(User, log)
        assert repo.delete(keep) and repo.force_delete(ann) and seen == ["deleting", "deleting", "restored"]
    finally:
        clear_observers()


def test_transactions(c):
    users, posts = c.repository(User), c.repository(Post)
    with c.transaction():
        u = users.create(Name="Ann")
        with c.transaction():
            posts.create(UserId=u.Id, Title="t")
        assert c.query(Post).count() == 1
    n = len(c.store.versions())
    assert not c.try_transaction(lambda: (users.truncate(), posts.create(Title="x"), 1 / 0))
    assert len(c.store.versions()) == n and c.query(User).count() == c.query(Post).count() == 1
    c.raw.transaction(lambda: users.create(Name="B"), lambda: users.create(Name="C"))
    assert len(c.store.versions()) == n + 1


def test_conflicts_and_time_travel(c, spark):
    other = Store(spark, c.store.root)
    users = c.repository(User)
    users.create(Name="Ann")
    with pytest.raises(Conflict):
        with c.transaction():
            users.create(Name="B")
            done = threading.Thread(target=lambda: other.append_rows("users", [{"Id": 50, "Name": "other"}]))
            done.start()
            done.join()
    assert [r.Name for r in c.query(User).order_by("Id").rows()] == ["Ann", "other"]
    with c.transaction():  # another table is no conflict
        users.create(Name="C")
        t = threading.Thread(target=lambda: other.append_rows("tags", [{"Id": 1, "Word": "w"}]))
        t.start()
        t.join()
    assert c.query(User).count() == 3 and c.query(Tag).count() == 1
    first = c.store.versions()[1]
    assert c.store.read("users", first).count() == 1
    c.store.compact("users", ["Id"])
    assert len(c.store.table("users").paths) == 1 and c.store.vacuum() > 0 and c.query(User).count() == 3


def test_relations(c):
    users, posts, tags = c.repository(User), c.repository(Post), c.repository(Tag)
    c.store.create("post_tag", Schema(c).context.spark.createDataFrame([], "PostId int, TagId int, Note string").schema)
    ann, bob = users.create(Name="Ann"), users.create(Name="Bob")
    assert User.posts.create_many(c, ann, [{"Title": "b"}, {"Title": "a"}]) == 2
    p = User.posts.create(c, bob, Title="c")
    assert User.posts.of(c, ann).count() == 2 and User.top.of(c, ann).first().Title == "b" and Post.user.of(c, p).first().Name == "Bob"
    t = [tags.create(Word=w) for w in "xyz"]
    assert Post.tags.attach(c, p, [t[0].Id, t[1].Id], Note="n") == 2 and Post.tags.attach(c, p, t[0].Id) == 0
    assert Post.tags.contains(c, p, t[1].Id) and not Post.tags.toggle(c, p, t[1].Id) and Post.tags.toggle(c, p, t[2].Id)
    Post.tags.sync(c, p, [t[1].Id])
    assert [x.Word for x in Post.tags.of(c, p).rows()] == ["y"]
    loaded = {r.Name: r for r in c.query(User).with_("posts.tags", "top").df().collect()}
    assert [x.Title for x in loaded["Ann"].posts] == ["b", "a"] and loaded["Ann"].posts[0].tags == [] and loaded["Bob"].posts[0].tags[0].Word == "y"
    assert loaded["Ann"].top.Title == "b"
    assert {r.Name: r.posts_count for r in User.posts.counted(c, c.query(User).df()).collect()} == {"Ann": 2, "Bob": 1}
    Post.user.associate(c, p, ann)
    assert User.posts.of(c, ann).count() == 3 and Post.user.dissociate(c, p).UserId is None
    assert User.posts.delete_all(c, ann) == 2 and Post.tags.detach(c, p) == 1
    with pytest.raises(KeyError):
        c.query(User).with_("nothing").df()


class First(Migration):
    version = "001"

    def up(self, schema):
        schema.create("notes", lambda t: (t.id(), t.string("Text", 5).default("?"), t.foreign_id("UserId", "users"), t.uuid("Code"), t.boolean("On"), t.time("At"), t.json("Data"), t.unique("Code")))

    def down(self, schema):
        schema.drop("notes")


class Second(Migration):
    version = "002"

    def up(self, schema):
        schema.add_column("notes", lambda t: t.integer("Stars").default(3))
        schema.rename_column("notes", "Text", "Body")
        schema.index("notes", "Body")

    def down(self, schema):
        schema.drop_column("notes", "Stars")
        schema.rename_column("notes", "Body", "Text")
        schema.drop_index("notes", "ix_notes_body")


class Broken(Migration):
    version = "003"

    def up(self, schema):
        schema.drop_column("notes", "Stars")
        raise RuntimeError("no")


def test_migrations(c):
    m, schema = Migrator(c, (Second(), First(), Broken())), Schema(c)
    r = m.migrate()
    assert r.applied == ["001", "002"] and not r.success and schema.has_column("notes", "Stars")
    c.store.append_rows("notes", [{"Id": 1, "UserId": 9, "Code": "c"}])
    row = c.store.read("notes").first()
    assert (row.Body, row.Stars) == ("?", 3) and schema.orphans("notes") == {"UserId": 1} and schema.indexes("notes")[-1]["columns"] == ["Body"]
    assert m.rollback(1).rolled_back == ["002"] and schema.has_column("notes", "Text") and c.store.read("notes").first().Text == "?"
    assert m.refresh().applied == ["001", "002"]
    assert [(x.version, x.applied) for x in m.status().orderBy("version").collect()] == [("001", True), ("002", True), ("003", False)]
    assert m.rollback().rolled_back == ["002", "001"] and not schema.has("notes")
    m.migrate()
    del m.known["002"]
    assert not m.reset().success
    auto = Migrator(c, (of_model(type("Extra", (Model,), {"Id": Field("int", key=True)}, table="extra")),))
    assert auto.migrate().success is True and schema.has("extra")
    schema.rename("extra", "more")
    schema.drop_if_exists("extra")
    assert schema.has("more") and not schema.has("extra")
    c.ensure_fresh()
    c.ensure_deleted()
    assert not schema.has("users") and c.status()["version"]


def test_jdbc(spark, tmp_path):
    db = Connection("derby", database=f"{tmp_path}/db")
    nation = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    sink(nation, db, "nation", mode="overwrite")
    back = source(spark, "derby", "nation", connection=db)
    assert back.count() == 25 and back.filter("n_nationkey = 3").first()["n_name"] == nation.filter("n_nationkey = 3").first()["n_name"]
    assert last_key(back, "n_nationkey") == 24
    c = Context(spark, Settings(connections={"main": db}))
    assert c.source("main", "nation").count() == 25
    assert Connection("postgresql", "h", "d", "u", "p").options()["url"] == "jdbc:postgresql://h:5432/d"
    assert Connection("sqlserver", "h", "d", integrated=True).options()["url"].endswith("integratedSecurity=true")
    with pytest.raises(ValueError):
        Connection("mysql").options()
    csv = f"{tmp_path}/n.csv"
    nation.write.option("header", True).csv(csv)
    assert source(spark, "csv", path=csv, header=True, schema=nation.schema).count() == 25


def test_merge_takes_its_rows_once(spark, tmp_path):
    """Rows that differ each time they are made are merged as they were checked."""
    store = Store(spark, f"file://{tmp_path}/once")
    store.create("t", spark.createDataFrame([], "k bigint, v double").schema)
    store.append("t", spark.range(50).selectExpr("id as k", "-1d as v"))
    rows = spark.range(100).selectExpr("id as k", "rand() as v").filter("rand() < 0.5")
    updated, added = store.merge("t", rows, ["k"])
    got = store.read("t").collect()
    assert len(got) == 50 + added and sum(r.k < 50 and r.v >= 0 for r in got) == updated and len({r.k for r in got}) == len(got)
