"""Writing, transactions, accumulation, partitions and retention."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera import schema as s
from tessera.errors import Forbidden, NotFound, QueryError, Referenced
from tessera.functions import inc, max_, min_, set_on_insert
from tessera.operators import writer as w
from tessera.operators.writer import Writer, new_id

author = s.define_entity("author", {"name": s.text().not_null().unique(), "age": s.int4()})
tag = s.define_entity("tag", {"name": s.text()})
book = s.define_entity(
    "book",
    {
        "title": s.text().not_null(),
        "pages": s.int4().default(1),
        "author": s.reference(author),
        "tags": s.reference(s.array(tag)),
        "chapters": s.owned(s.array({"name": s.text(), "notes": s.owned(s.array({"t": s.text()}))})),
        "cover": s.owned({"color": s.text()}),
        "words": s.array(s.text()),
    },
)
view = s.define_entity("view", {"page": s.text().not_null(), "day": s.text().not_null(), "n": s.int8(), "low": s.float8(), "high": s.float8(), "by": s.text()}, unique=[["page", "day"]])
reading = s.define_entity("reading", {"ts": s.timestamptz().not_null(), "v": s.int4()}, partition_by=s.time_bucket("ts", "1d"), retention="30d")
hourly = s.define_entity("hourly", {"ts": s.timestamptz().not_null(), "site": s.text().not_null(), "n": s.int8()}, unique=[["ts", "site"]], partition_by=s.time_bucket("ts", "1d"), retention="30d")
instant = s.define_entity("instant", {"ts": s.timestamptz().unique(), "n": s.int8()})
NOW = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def engine(spark, tmp_path):
    clock = [NOW]
    made = Writer(spark, f"file://{tmp_path}/store", clock=lambda: clock[0]).define(author, tag, book, view, reading, hourly, instant)
    made.clock_at = clock
    return made


def test_ids():
    made = [new_id() for _ in range(2000)]
    assert made == sorted(made) and len(set(made)) == 2000 and all(x[14] == "7" and x[19] in "89ab" for x in made)


def test_create_and_read(engine):
    a = engine.create(author, {"name": "x", "age": 3})
    tags = engine.create_many(tag, [{"name": "p"}, {"name": "q"}])
    b = engine.create(book, {"title": "t", "author": a, "tagIds": [t["id"] for t in tags], "chapters": [{"name": "c1", "notes": [{"t": "n"}]}, {"name": "c2"}], "cover": {"color": "red"}})
    assert (b["pages"], b["words"], b["authorId"]) == (1, [], a["id"])
    assert [c["name"] for c in b["chapters"]] == ["c1", "c2"] and b["chapters"][0]["notes"][0]["t"] == "n"
    full = engine.find_one(book, {"title": "t"}, expand={"author": True, "tags": True})
    assert full["author"]["name"] == "x" and [t["name"] for t in full["tags"]] == ["p", "q"]
    patched = engine.update_one(book, {"title": "t"}, {"pages": 9, "words": ["k"]})
    assert patched["pages"] == 9 and len(patched["chapters"]) == 2 and patched["cover"]["color"] == "red"
    saved = engine.save(book, {"id": b["id"], "title": "t2", "chapters": [{"name": "z"}]})
    assert (saved["title"], saved["pages"], saved["cover"]) == ("t2", 9, None) and [c["name"] for c in saved["chapters"]] == ["z"]
    assert engine.find_one(book, {}, expand={"tags": True})["tags"] == []
    with pytest.raises(Referenced):
        engine.delete_many(author, {"name": "x"})
    assert engine.delete_many(book, {"title": "t2"}) == 1
    assert [engine.store.frame(t).count() for t in ("book", "book__chapters", "book__chapters__notes", "book__cover", "book__tags")] == [0] * 5
    assert engine.delete_one(author, {"name": "x"}) and engine.count(author) == 0


def test_errors(engine, monkeypatch):
    engine.create(author, {"name": "x"})
    for bad in (
        lambda: engine.create(author, {"name": "x"}),
        lambda: engine.create(author, {"age": 1}),
        lambda: engine.create(author, {"name": "y", "what": 1}),
        lambda: engine.create(book, {"title": "k", "authorId": "nobody"}),
        lambda: engine.create(book, {"title": "k", "chapters": {"name": "c"}}),
        lambda: engine.update_many(author, {}, {"age": 1}),
        lambda: engine.delete_many(author, None),
    ):
        with pytest.raises(QueryError):
            bad()
    with pytest.raises(NotFound):
        engine.update_one(author, {"name": "none"}, {"age": 1})
    monkeypatch.setattr(w, "BULK_CAP", 1)
    with pytest.raises(QueryError):
        engine.create_many(tag, [{"name": "a"}, {"name": "b"}])
    assert engine.count(author) == 1 and engine.count(book) == 0


def test_transaction(engine):
    with pytest.raises(RuntimeError), engine.transaction():
        engine.create(author, {"name": "a"})
        assert engine.count(author) == 1
        raise RuntimeError
    assert engine.count(author) == 0
    with engine.transaction():
        engine.create(author, {"name": "a"})
        engine.create(author, {"name": "b"})
    assert engine.count(author) == 2 and engine.update_many(author, {"name": {"in": ["a", "b"]}}, {"age": 5}) == 2
    assert engine.count(author, {"age": 5}) == 2
    assert engine.store.vacuum() > 0 and engine.count(author) == 2 and engine.delete_all(author) == 2


def test_delete_many_of_any_number(engine, spark, monkeypatch):
    monkeypatch.setattr(w, "BULK_CAP", 2)
    n = 9
    engine.load(tag, spark.range(n).selectExpr("id", "if(id = 7, 'stays', 'goes') AS name"))
    links = F.when(F.col("id") == 0, F.array(F.lit("7"), F.lit("8"))).otherwise(F.array(F.col("id").cast("string")))
    part = F.array(F.struct(F.lit("c").alias("name"), F.array(F.struct(F.lit("x").alias("t"))).alias("notes")))
    engine.load(book, spark.range(n).select("id", F.when(F.col("id") < 2, "stays").otherwise("goes").alias("title"), links.alias("tagsIds"), part.alias("chapters")))
    assert engine.delete_many(book, {"title": "goes"}) == n - 2
    rows = lambda table, column: sorted(r[0] for r in engine.store.frame(table).select(column).collect())
    assert rows("book", "id") == rows("book__chapters", "book_id") == ["0", "1"] and len(rows("book__chapters__notes", "id")) == 2
    assert rows("book__tags", "target_id") == ["1", "7", "8"]
    assert engine.delete_many(tag, {"name": "goes"}) == n - 1 and engine.delete_many(tag, {"name": "goes"}) == 0
    assert rows("tag", "id") == rows("book__tags", "target_id") == ["7"]
    assert not list(engine.store._files.listStatus(engine.store._path("drafts")))  # the ids are gone too


def test_check(engine):
    with pytest.raises(Forbidden):
        engine.create_many(author, [{"name": "a", "age": 1}, {"name": "b", "age": 9}], check={"age": {"lt": 5}})
    assert engine.count(author) == 0


def test_accumulate(engine):
    key = {"page": "a", "day": "1"}
    one = engine.accumulate(view, key, {"n": inc(), "high": max_(3.5), "low": min_(3.5), "by": set_on_insert("me")})
    two = engine.accumulate(view, key, {"n": inc(4), "high": max_(2.5), "low": min_(2.5), "by": set_on_insert("you"), "page": inc()})
    assert (two["id"], two["n"], two["high"], two["low"], two["by"]) == (one["id"], 5, 3.5, 2.5, "me")
    engine.accumulate_many(view, [({"page": "b", "day": "1"}, {"n": inc(2)}), ({"page": "b", "day": "1"}, {"n": inc(3)}), (key, {"n": inc(1)})])
    assert sorted((r.page, r.n) for r in engine.find(view).collect()) == [("a", 6), ("b", 5)]
    engine.accumulate(view, {"page": "c", "day": "1"}, {"high": max_(1.0)})
    assert engine.accumulate(view, {"page": "c", "day": "1"}, {"n": inc(1)})["n"] is None
    for bad in (lambda: engine.accumulate(view, {"page": "a"}, {"n": inc()}), lambda: engine.accumulate(view, key, {"n": {"op": "avg", "value": 1}}), lambda: engine.accumulate(view, key, {"what": inc()})):
        with pytest.raises(QueryError):
            bad()


def test_partitions(engine):
    with pytest.warns(UserWarning, match="beyond the retention"):
        engine.create_many(reading, [{"ts": "2024-02-20T01:00:00Z", "v": 1}, {"ts": "2024-01-20T01:00:00Z", "v": 2}, {"ts": "2024-02-29T05:00:00Z", "v": 3}])
    assert engine.count(reading) == 2
    for bad in ({"ts": "2023-01-01T00:00:00Z"}, {"ts": "never"}, {"v": 1}):
        with pytest.raises(QueryError):
            engine.create(reading, bad)
    found = engine.find(reading, {"ts": {"gte": "2024-02-25T00:00:00Z"}})
    assert [r.v for r in found.collect()] == [3]
    assert "_bucket" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    engine.clock_at[0] = dt.datetime(2024, 3, 25, tzinfo=dt.timezone.utc)
    engine.create(reading, {"ts": "2024-03-24T01:00:00Z", "v": 4})
    assert sorted(r.v for r in engine.find(reading).collect()) == [3, 4]


def test_accumulate_on_times(engine):
    one = engine.accumulate(instant, {"ts": "2024-02-01T10:00:00+02:00"}, {"n": inc(2)})
    two = engine.accumulate(instant, {"ts": "2024-02-01T08:00:00Z"}, {"n": inc(3)})
    assert (two["id"], two["n"]) == (one["id"], 5) and engine.count(instant) == 1
    assert len(set(engine.accumulate_many(instant, [({"ts": f"2024-02-01T0{h}:00:00Z"}, {"n": inc()}) for h in (9, 8, 9)]))) == 2


def test_accumulate_in_partitions(engine, spark):
    rows = [(dt.datetime(2024, 2, 20, 5), "a", 1), (dt.datetime(2024, 2, 20, 5), "a", 2), (dt.datetime(2024, 2, 21, 5), "b", 7)]
    for _ in range(2):
        engine.accumulate_rows(hourly, ["ts", "site"], {"n": "inc"}, spark.createDataFrame(rows, "ts timestamp, site string, n long"))
    assert sorted((r.site, r.n) for r in engine.find(hourly, {"ts": {"gte": "2024-02-20T00:00:00Z"}}).collect()) == [("a", 6), ("b", 14)]
    assert engine.accumulate(hourly, {"ts": "2024-02-21T05:00:00Z", "site": "b"}, {"n": inc(1)})["n"] == 15
    before = [p for p in engine.store.segments()["hourly"] if "1708387200" in p]
    assert before == [p for p in engine.store.segments()["hourly"] if p.startswith("_bucket=1708387200/")] and engine.count(hourly) == 2
    with pytest.raises(QueryError, match="retention"):
        engine.accumulate(hourly, {"ts": "2024-01-01T05:00:00Z", "site": "b"}, {"n": inc(1)})
    engine.clock_at[0] = dt.datetime(2024, 3, 22, tzinfo=dt.timezone.utc)
    engine.accumulate(hourly, {"ts": "2024-03-21T05:00:00Z", "site": "c"}, {"n": inc(1)})
    assert sorted(r.site for r in engine.find(hourly).collect()) == ["b", "c"]


def test_writes_touch_their_files_only(engine):
    for i in range(4):
        engine.create(author, {"name": f"n{i}", "age": i})
    before = set(engine.store.segments()["author"])
    engine.update_one(author, {"name": "n1"}, {"age": 9})
    after = set(engine.store.segments()["author"])
    assert len(before & after) == 3 and engine.delete_many(author, {"name": "n2"}) == 1
    assert len(before & set(engine.store.segments()["author"])) == 2
    assert sorted((r.name, r.age) for r in engine.find(author).collect()) == [("n0", 0), ("n1", 9), ("n3", 3)]
    assert engine.store.vacuum() >= 2 and engine.store.vacuum() == 0 and engine.count(author) == 3
    with pytest.raises(QueryError, match="already"):
        engine.create(author, {"name": "n3"})


def test_load(engine, spark):
    assert engine.load(author, spark.createDataFrame([("1", "x", 3), ("2", "y", None)], "id string, name string, age int")) == 2
    engine.load(tag, spark.createDataFrame([("t1", "p")], "id string, name string"))
    kinds = "id string, title string, authorId string, tagsIds array<string>, chapters array<struct<name string, notes array<struct<t string>>>>, cover struct<color string>"
    engine.load(book, spark.createDataFrame([("b1", "one", "1", ["t1", "t1"], [("c1", [("n1",), ("n2",)]), ("c2", [])], ("red",)), ("b2", "two", None, None, None, None)], kinds))
    found = {r["id"]: r.asDict(recursive=True) for r in engine.find(book, expand={"author": True, "tags": True}).collect()}
    one, two = found["b1"], found["b2"]
    assert (one["author"]["name"], [t["name"] for t in one["tags"]], one["cover"]["color"], one["pages"], one["words"]) == ("x", ["p"], "red", 1, [])
    assert {c["name"]: sorted(n["t"] for n in c["notes"]) for c in one["chapters"]} == {"c1": ["n1", "n2"], "c2": []}
    assert (two["author"], two["tags"], two["chapters"], two["cover"]) == (None, [], [], None)
    for bad, kinds in (
        ([("3", "x")], "id string, name string"),
        ([("1", "z")], "id string, name string"),
        ([("3", None)], "id string, name string"),
        ([("3", "z", 1)], "id string, name string, what int"),
    ):
        with pytest.raises(QueryError):
            engine.load(author, spark.createDataFrame(bad, kinds))
    for bad in ([("b3", "t", "nobody")], ):
        with pytest.raises(QueryError):
            engine.load(book, spark.createDataFrame(bad, "id string, title string, authorId string"))
    with pytest.raises(QueryError):
        engine.load(book, spark.createDataFrame([("t",)], "title string"))
    with pytest.raises(Forbidden):
        engine.load(author, spark.createDataFrame([("n", 9)], "name string, age int"), check={"age": {"lt": 5}})
    assert engine.count(author) == 2 and engine.count(book) == 2
    with pytest.warns(UserWarning, match="beyond the retention"):
        assert engine.load(reading, spark.createDataFrame([(dt.datetime(2024, 2, 20), 1), (dt.datetime(2023, 2, 20), 2)], "ts timestamp, v int")) == 1
    assert [r.v for r in engine.find(reading, {"ts": {"gte": "2024-02-19T00:00:00Z"}}).collect()] == [1]


def test_nested_reads_cut_to_the_page(engine):
    a = engine.create(author, {"name": "x"})
    for i in range(3):
        engine.create(book, {"title": f"t{i}", "authorId": a["id"], "chapters": [{"name": f"c{i}"}]})
    found = engine.find(book, order_by={"title": "asc"}, limit=1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("collect_list") :]
    assert "LeftSemi" in below and found.first()["chapters"][0]["name"] == "c0"
    assert [r.chapters[0]["name"] for r in engine.find(book, order_by={"title": "desc"}, limit=2).collect()] == ["c2", "c1"]
    loose = engine.find(book, {"title": {"ne": "t1"}}, order_by=False, select={"title": True})
    assert "Sort" not in loose._jdf.queryExecution().optimizedPlan().toString() and sorted(r.title for r in loose.collect()) == ["t0", "t2"]
    with pytest.raises(QueryError):
        engine.find(book, order_by=False, limit=1)
