"""Null, ordering and edge semantics on small tables."""

import datetime as dt

import pytest

from tessera import schema as s
from tessera.engine import Engine
from tessera.errors import QueryError
from tessera.functions import avg, count, div, first, histogram, max_, percentile, sum_
from tessera.functions.filters import condition
from tessera.sources.binding import Binding

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def e(spark):
    def rows(data, kinds):
        df = spark.createDataFrame(data, kinds)
        return lambda: df

    owner = s.define_entity("owner", {"name": s.text(), "boss": s.reference(s.self_ref()), "tags": s.array(s.text()).nullable()})
    thing = s.define_entity("thing", {"n": s.int4(), "at": s.timestamp(), "owner": s.reference(owner), "bits": s.owned(s.array({"v": s.int4()})), "one": s.owned({"w": s.text()}), "friends": s.reference(s.array(owner)), "doc": s.jsonb()})
    owners = rows([(1, "a", None, ["x", None]), (2, "b", 1, []), (3, None, 2, None)], "id long, name string, boss_id long, tags array<string>")
    things = rows([(1, 5, T0, 1, '{"a":1}'), (2, None, None, 2, None), (3, 7, T0, None, '{"a":2}'), (4, 5, T0 + dt.timedelta(hours=1), 3, None)], "id long, n int, at timestamp_ntz, owner_id long, doc string")
    bits = rows([(1, 1, T0, 10), (2, 1, None, 20), (3, 2, T0, None), (4, 4, T0, 5), (5, 4, T0, 50)], "id long, thing_id long, created_at timestamp_ntz, v int")
    ones = rows([(1, 1, "q")], "id long, thing_id long, w string")
    links = rows([(1, 1), (1, 2), (1, 2), (2, 3)], "a long, b long")
    engine = Engine(spark).bind(owner, Binding(owners)).bind(thing, Binding(things, {"createdAt": "at"}, parts={"bits": Binding(bits, parent="thing_id"), "one": Binding(ones, parent="thing_id")}, links={"friends": (links, "a", "b")}))
    return engine, owner, thing


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ({"n": {"ne": 5}}, [3]),
        ({"not": {"n": 5}}, [3]),
        ({"n": None}, [2]),
        ({"n": {"in": []}}, []),
        ({"n": {"notIn": []}}, [1, 2, 3, 4]),
        ({"n": {"notIn": [5]}}, [3]),
        ({"owner": {"name": "a"}}, [1]),
        ({"not": {"owner": {"name": "a"}}}, [2, 3, 4]),
        ({"owner": {"name": {"ne": "a"}}}, [2]),
        ({"owner": {"not": {"name": "a"}}}, [2]),
        ({"owner": {}}, [1, 2, 4]),
        ({"ownerId": None}, [3]),
        ({"bits": {"some": {"v": {"gt": 15}}}}, [1, 4]),
        ({"bits": {"none": {"v": {"gt": 15}}}}, [2, 3]),
        ({"bits": {"every": {"v": {"gt": 7}}}}, [1, 2, 3]),
        ({"bits": {"every": {}}}, [1, 2, 3, 4]),
        ({"bits": {"some": {}}}, [1, 2, 4]),
        ({"not": {"bits": {"some": {"v": {"gt": 15}}}}}, [2, 3]),
        ({"or": [{"bits": {"none": {}}}, {"n": 7}]}, [3]),
        ({"one": {}}, [1]),
        ({"not": {"one": {}}}, [2, 3, 4]),
        ({"friends": {"some": {"name": "b"}}}, [1]),
        ({"friends": {"every": {"name": "b"}}}, [2, 3, 4]),
        ({"friends": {"none": {}}}, [3, 4]),
        ({"owner": {"boss": {"name": "a"}}}, [2]),
        ({"or": []}, [1, 2, 3, 4]),
        ({"or": [{}, {"n": 7}]}, [3]),
        ({"not": {}}, [1, 2, 3, 4]),
        ({"doc": {"a": 1}}, [1]),
        ({"doc": {"eq": {"a": 2}}}, [3]),
    ],
)
def test_where(e, where, want):
    engine, _, thing = e
    assert ids(engine.find(thing, where)) == want


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ({"tags": {"has": "x"}}, [1]),
        ({"not": {"tags": {"has": "x"}}}, [2]),
        ({"tags": {"hasSome": ["y", "z"]}}, []),
        ({"not": {"tags": {"hasSome": ["y"]}}}, [1, 2]),
        ({"tags": {"hasSome": []}}, []),
        ({"tags": {"hasEvery": []}}, [1, 2, 3]),
        ({"tags": {"hasEvery": ["x"]}}, [1]),
        ({"tags": {"isEmpty": True}}, [2]),
        ({"tags": {"isEmpty": False}}, [1]),
        ({"tags": None}, [3]),
        ({"tags": {"some": {"like": "x%"}}}, [1]),
        ({"tags": {"some": {}}}, [1]),
        ({"not": {"tags": {"some": {"eq": "q"}}}}, [1, 2]),
    ],
)
def test_lists(e, where, want):
    engine, owner, _ = e
    assert ids(engine.find(owner, where)) == want


@pytest.mark.parametrize("where", [{"n": {"gtt": 1}}, {"n": {}}, {"nope": 1}, {"bits": {"any": {}}}, {"owner": 3}, {"bits": {"v": 1}}, {"n": {"like": "x"}}])
def test_bad_where(e, where):
    engine, _, thing = e
    with pytest.raises(QueryError):
        engine.find(thing, where)


@pytest.mark.parametrize("where", [{"tags": ["x"]}, {"tags": "x"}, {"tags": {"isNull": True}}])
def test_bad_lists(e, where):
    engine, owner, _ = e
    with pytest.raises(QueryError):
        engine.find(owner, where)


def test_words(e):
    engine, owner, thing = e
    find = lambda kind, *how: ids(engine.find(kind, condition(*how)))
    n, at, name = thing.shape["n"], thing.shape["at"], owner.shape["name"]
    assert find(thing, "n", n, "notEquals", 5) == [3] and find(thing, "n", n, "isEmpty") == [2] and find(thing, "n", n, "gte", 6) == [3]
    assert find(thing, "at", at, "on", "2024-01-01T15:00:00") == [1, 3, 4] and find(thing, "at", at, "before", "2024-01-01") == [] and find(thing, "at", at, "after", "2023-12-31") == [1, 3, 4]
    assert find(owner, "name", name, "contains", "A") == [1] and find(owner, "name", name, "startsWith", "_") == []
    assert find(owner, "tags", owner.shape["tags"], "startsWith", "X") == [1]
    with pytest.raises(QueryError):
        condition("n", n, "contains", 5)


def test_null_order(e):
    engine, _, thing = e
    order = lambda how: [r["id"] for r in engine.find(thing, order_by=how).collect()]
    assert order({"n": "asc"}) == [1, 4, 3, 2]
    assert order({"n": "desc"}) == [2, 3, 1, 4]
    assert order({"id": "desc"}) == [4, 3, 2, 1]
    assert order({"owner": {"name": "asc"}}) == [1, 2, 3, 4]
    assert order({"owner": {"name": "desc"}}) == [3, 4, 2, 1]
    assert order({"owner": "desc"}) == [3, 4, 2, 1]


def test_latest(e):
    engine, _, thing = e
    assert ids(engine.find(thing, latest_per="n", order_by={"at": "desc"})) == [2, 3, 4]
    assert engine.count(thing, latest_per="n") == 2
    assert engine.count(thing, latest_per=["n", "at"]) == 4


def test_nesting(e):
    engine, owner, thing = e
    rows = {r["id"]: r.asDict(recursive=True) for r in engine.find(thing, expand={"owner": True, "friends": True}).collect()}
    assert [x["v"] for x in rows[1]["bits"]] == [10, 20] and rows[3]["bits"] == []
    assert rows[1]["one"]["w"] == "q" and rows[2]["one"] is None
    assert rows[3]["owner"] is None and rows[1]["owner"]["name"] == "a"
    assert [x["id"] for x in rows[1]["friends"]] == [1, 2] and rows[3]["friends"] == []
    picked = engine.find(thing, select={"bits": {"v": True}, "ownerId": True})
    assert set(picked.columns) == {"id", "ownerId", "bits"}
    chain = {r["id"]: r.asDict(recursive=True) for r in engine.find(owner, expand={"boss": {"boss": True}}).collect()}
    assert chain[3]["boss"]["boss"]["id"] == 1
    assert "owner" in engine.find(thing, expand="auto").columns
    with pytest.raises(QueryError):
        engine.find(thing, order_by={"bits": {"v": "asc"}})


def test_aggregates(e):
    engine, _, thing = e
    one = lambda **q: engine.aggregate(thing, **q).rows.collect()
    row = one(select={"n": count(), "s": sum_("n"), "h": histogram("n", [6]), "p": percentile("n", 0.5), "f": first("n"), "d": div("n", 0)})[0]
    assert (row.n, row.s, row.h, row.p, row.f, row.d) == (4.0, 17.0, [2, 1], 5.0, 5.0, None)
    assert one(where={"n": 99}, select={"n": count(), "s": sum_("n")})[0] == (0.0, None)
    assert one(where={"n": 99}, groupBy=["n"], select={"c": count()}) == []
    by = {r["owner.name"]: r.c for r in one(groupBy=["owner.name"], select={"c": count()})}
    assert by == {"a": 1.0, "b": 1.0, None: 2.0}
    assert one(select={"c": count({"owner.name": {"ne": "a"}})})[0].c == 1.0
    assert one(select={"c": count({"not": {"owner.name": "a"}})})[0].c == 1.0
    got = one(unnest="bits", select={"c": count(), "a": avg("bits.v"), "f": first("bits.v")})[0]
    assert got.c == 5.0 and got.f == 10.0
    assert sorted(map(tuple, one(groupBy=["one.w"], select={"m": max_("n")})), key=repr) == [("q", 5.0), (None, 7.0)]


@pytest.mark.parametrize(
    "query",
    [
        {"select": {}},
        {"select": {"x": sum_("bits.v")}},
        {"select": {"x": percentile("n", 1.0)}},
        {"select": {"x": histogram("n", [2, 1])}},
        {"select": {"a b": count()}},
        {"select": {"x": div("later", 1), "later": div("x", 1)}},
        {"select": {"x": count()}, "having": {"n": 1}},
        {"select": {"x": count()}, "orderBy": {"y": "asc"}},
        {"select": {"x": {"agg": "median", "field": "n"}}},
        {"select": {"x": count()}, "unnest": "one"},
        {"select": {"x": sum_("owner.name")}},
    ],
)
def test_bad_aggregates(e, query):
    engine, _, thing = e
    with pytest.raises(QueryError):
        engine.aggregate(thing, query)


def test_pages(e):
    engine, _, thing = e
    page = engine.paginate(thing, page=2, per_page=3)
    assert (page.docs_quantity, page.page_quantity, page.current_page, page.docs.count()) == (4, 2, 2, 1)
    assert engine.paginate(thing, {"n": 99}).page_quantity == 1
    assert engine.find_one(thing, {"n": 99}) is None
    with pytest.warns(UserWarning, match="rows match"):
        from tessera.operators import reader

        reader.FIND_CAP, cap = 2, reader.FIND_CAP
        try:
            assert engine.find_many(thing).count() == 2
        finally:
            reader.FIND_CAP = cap
