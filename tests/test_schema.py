"""Entities, IR, differences, migration and streaming."""

import datetime as dt

import pytest

from tessera import schema as s
from tessera.errors import QueryError
from tessera.ir import diff, ensure_ids, from_ir, normalize, to_ir, validate
from tessera.migrate import Catalog, check, drift, topological
from tessera.operators.writer import Writer
from tessera.plans.scopes import define_scope, scope_rule
from tessera.sources.catalog import columns, statistics
from tessera.streaming import accumulate_stream, bucket_counts


def entity(shape, name="item", **more):
    return s.define_entity(name, shape, **more)


def test_definitions():
    for bad in (
        lambda: entity({"id": s.text()}),
        lambda: entity({"a b": s.text()}),
        lambda: entity({"a": 3}),
        lambda: entity({"a": s.reference("x"), "aId": s.text()}),
        lambda: entity({"a": s.text()}, unique=[["b"]]),
        lambda: entity({"a": s.timestamptz()}, partition_by=s.time_bucket("a", "1d")),
        lambda: entity({"a": s.text()}, retention="1d"),
        lambda: s.time_bucket("a", "1w"),
        lambda: s.array(s.text()).default(["x"]),
    ):
        with pytest.raises(QueryError):
            bad()
    base = entity({"name": s.text().unique(), "n": s.int4()}, "base")
    copy = entity({"lines": s.owned(s.array(s.mirror(base, {"n": s.text(), "q": s.int4()})))})
    shape = s.resolve(copy.shape)["lines"].shape
    assert list(shape) == ["name", "n", "q"] and not shape["name"].is_unique and shape["n"].kind == "text"
    holder = {}
    holder["me"] = entity({"x": s.owned(s.mirror(lambda: holder["me"]))}, "me")
    with pytest.raises(QueryError):
        s.resolve(holder["me"].shape)


def test_ir_round_trip():
    a = entity({"name": s.text().not_null().unique(), "up": s.reference(s.self_ref())}, "a")
    b = entity({"at": s.timestamptz().not_null(), "tags": s.array(s.text()), "a": s.reference(a).not_null(), "many": s.reference(s.array(a)), "part": s.owned({"k": s.int8().default(3).index()}), "m": s.owned(s.array(s.mirror(a)))}, "b", index=[["at", "a"]], partition_by=s.time_bucket("at", "1h"), retention="2d")
    irs = [ensure_ids(normalize(to_ir(x))) for x in (a, b)]
    for ir in irs:
        validate(ir)
    made = from_ir(irs)
    assert [normalize(to_ir(x)) for x in made.values()] == irs
    assert "a" not in from_ir([irs[1]])["b"].shape
    assert [e.name for e in topological([b, a])] == ["a", "b"]
    check([a, b])
    with pytest.raises(QueryError):
        check([b])
    for bad in ({}, {"name": "x", "irVersion": 9, "fields": {}}, {"name": "x", "irVersion": 1, "fields": {"a": {"kind": "column", "type": "nope"}}}, {"name": "x", "irVersion": 1, "fields": {"a": {"kind": "reference", "target": "y", "cardinality": "few"}}}, {"name": "x", "irVersion": 1, "fields": {"a": {"kind": "column", "type": "text", "id": "1"}, "b": {"kind": "column", "type": "text", "id": "1"}}}):
        with pytest.raises(QueryError):
            validate(bad)


def test_diff():
    old = ensure_ids(to_ir(entity({"a": s.text(), "b": s.int4(), "c": s.text().unique(), "d": s.owned({"x": s.text()}), "e": s.reference("q")}, unique=[["a", "b"]])))
    new = {**old, "fields": {k: dict(v) for k, v in old["fields"].items()}, "unique": [["a2", "b"]], "index": [["a2", "c"]]}
    new["fields"]["a2"] = new["fields"].pop("a") | {"notNull": True}
    new["fields"]["b"] |= {"type": "text", "index": True, "default": "z"}
    new["fields"]["c"] = {k: v for k, v in new["fields"]["c"].items() if k != "unique"}
    new["fields"]["d"] |= {"array": True}
    del new["fields"]["e"]
    new["fields"]["f"] = {"kind": "column", "type": "text", "notNull": True, "id": "f"}
    new["fields"]["g"] = {"kind": "column", "type": "text", "id": "g"}
    found = {(c.op, c.path): c.risk for c in diff(old, new).changes}
    assert found == {
        ("removeField", "e"): "confirm",
        ("renameField", "a2"): "auto",
        ("makeRequired", "a2"): "needsValue",
        ("retypeField", "b"): "blocked",
        ("addIndex", "b"): "auto",
        ("changeDefault", "b"): "auto",
        ("dropUnique", "c"): "auto",
        ("reshape", "d"): "blocked",
        ("addField", "f"): "needsValue",
        ("addField", "g"): "auto",
        ("addCompositeIndex", "a2,c"): "auto",
    }
    assert diff(None, new).is_new


def test_migration(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    catalog = Catalog(Writer(spark, folder))
    first = entity({"a": s.text(), "b": s.int4(), "list": s.owned(s.array({"x": s.text()}))})
    assert catalog.apply(first).done
    item = catalog.entities()["item"]
    catalog.writer.create_many(item, [{"a": "p", "b": 1, "list": [{"x": "q"}]}, {"a": "p"}])
    keys = {f: n.key for f, n in item.shape.items()}
    second = entity({"title": s.text().with_id(keys["a"]), "b": s.int4().not_null().with_id(keys["b"]), "parts": s.owned(s.array({"x": s.text().with_id(item.shape["list"].shape["x"].key)})).with_id(keys["list"]), "c": s.text().default("new")})
    stopped = catalog.apply(second)
    assert not stopped.done and {c.op: c.risk for c in stopped.plan.changes}["makeRequired"] == "needsValue"
    assert catalog.apply(second, fill={"b": 7}).done
    again = Catalog(Writer(spark, folder))
    rows = sorted((r.asDict(recursive=True) for r in again.writer.find("item").collect()), key=lambda r: r["b"])
    assert [(r["title"], r["b"], r["c"], [x["x"] for x in r["parts"]]) for r in rows] == [("p", 1, "new", ["q"]), ("p", 7, "new", [])]
    now = again.entities()["item"]
    unique = {f: n for f, n in now.shape.items()} | {"title": now.shape["title"].unique()}
    assert again.plan(entity(unique)).changes[0].risk == "blocked"
    assert again.plan(entity(unique | {"title": now.shape["title"], "b": now.shape["b"].unique()})).changes[0].risk == "auto"
    again.save_scope(define_scope("mine", [scope_rule(now, where={"title": {"param": "who"}})]))
    assert Catalog(Writer(spark, folder)).scope("mine").rules["item"].where == {"title": {"param": "who"}}
    (found,) = statistics(again.writer)
    assert (found.objects, found.tables, found.partitions, found.fields) == (2, 2, 0, 4) and found.bytes > 0
    assert {"id", "title", "b"} <= set(columns(again.writer, "item"))
    fewer = entity({"title": now.shape["title"]})
    assert not again.apply(fewer).done and again.apply(fewer, confirm=True).done
    assert again.writer.find("item").columns == ["id", "title", "createdAt", "updatedAt"]
    assert drift(again.writer, again.entities()["item"]) == []


def test_streaming(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), "a" if m % 2 else "b", m) for m in range(20)]
    spark.createDataFrame(rows, "ts timestamp, k string, v long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k string, v long").parquet(f"{tmp_path}/in")
    q = bucket_counts(stream, "ts", "5min", "1h", ["k"]).writeStream.format("memory").queryName("buckets").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("buckets").collect()) == [2, 2, 2, 2, 3, 3, 3, 3]
    total = s.define_entity("total", {"k": s.text().unique(), "n": s.int8(), "top": s.int8()})
    writer = Writer(spark, f"file://{tmp_path}/store").define(total)
    run = accumulate_stream(writer, total, ["k"], {"n": "inc", "top": "max"}, lambda b: b.selectExpr("k", "1L AS n", "v AS top"))
    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n, r.top) for r in writer.find(total).collect()) == [("a", 10, 19), ("b", 10, 18)]


def test_swapped_names(spark, tmp_path):
    catalog = Catalog(Writer(spark, f"file://{tmp_path}/store"))
    other = entity({"name": s.text()}, "other")
    inner = {"x": s.text(), "notes": s.owned(s.array({"t": s.text()}))}
    assert all(x.done for x in catalog.push([entity({"a": s.owned(s.array(inner)), "b": s.owned(s.array(inner)), "p": s.text(), "q": s.text(), "m": s.reference(s.array(other)), "n": s.reference(s.array(other))}), other]).values())
    made = catalog.entities()
    o = catalog.writer.create_many(made["other"], [{"name": "one"}, {"name": "two"}])
    catalog.writer.create(made["item"], {"a": [{"x": "from_a", "notes": [{"t": "na"}]}], "b": [{"x": "from_b", "notes": [{"t": "nb"}]}], "p": "from_p", "q": "from_q", "mIds": [o[0]["id"]], "nIds": [o[1]["id"]]})
    shape = made["item"].shape
    swap = {"a": "b", "b": "a", "p": "q", "q": "p", "m": "n", "n": "m"}
    assert catalog.apply(entity({swap[f]: n for f, n in shape.items()})).done
    for c in (catalog, Catalog(Writer(spark, f"file://{tmp_path}/store"))):
        row = c.writer.find("item", expand={"m": True, "n": True}).first().asDict(recursive=True)
        assert (row["p"], row["q"]) == ("from_q", "from_p")
        for f, want in (("a", "b"), ("b", "a")):
            assert [(x["x"], [y["t"] for y in x["notes"]]) for x in row[f]] == [(f"from_{want}", [f"n{want}"])]
        assert [x["name"] for x in row["m"]] == ["two"] and [x["name"] for x in row["n"]] == ["one"]
    before = catalog.irs
    with pytest.raises(RuntimeError), catalog.store.transaction():
        catalog.apply(entity({"z": s.text()}, "another"))
        raise RuntimeError
    assert set(Catalog(Writer(spark, f"file://{tmp_path}/store")).irs) == set(before) - {"another"}


def test_push(spark, tmp_path):
    catalog = Catalog(Writer(spark, f"file://{tmp_path}/store"))
    a = entity({"name": s.text(), "old": s.int4()}, "a")
    b = entity({"a": s.reference("a"), "x": s.text()}, "b")
    assert list(catalog.push([b, a])) == ["a", "b"] and catalog.pending() is None
    catalog.writer.create(catalog.entities()["a"], {"name": "n", "old": 3})
    again = [entity({"name": s.text().not_null(), "fresh": s.int4()}, "a"), entity({"a": s.reference("a")}, "b")]
    scope = define_scope("all", [scope_rule(again[0])])
    done, saved = catalog.push_all(again, [scope], renames={"a": {"old": "fresh"}})
    assert done["a"].done and not done["b"].done and saved == []
    held = Catalog(Writer(spark, f"file://{tmp_path}/store")).pending()
    assert [(e["name"], [c["op"] for c in e["changes"]]) for e in held["entries"]] == [("b", ["removeField"])]
    assert catalog.writer.find("a").first()["fresh"] == 3
    assert not catalog.push(again, confirm={"b": ["y"]})["b"].done
    done, saved = catalog.push_all(again, [scope], confirm={"b": ["x"]})
    assert all(x.done for x in done.values()) and saved == ["all"] and catalog.pending() is None and catalog.scope("all").name == "all"
