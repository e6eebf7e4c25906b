"""Scopes: verbs, rows, fields, reached entities, parameters and storage."""

import pytest

from tessera import schema as s
from tessera.errors import Forbidden, MissingParam, QueryError
from tessera.functions import count
from tessera.ir import ensure_ids, from_ir, to_ir
from tessera.operators.writer import Writer
from tessera.plans.scopes import ScopedClient, Scoped, define_scope, from_stored, scope_rule, to_stored

team = s.define_entity("team", {"name": s.text().not_null(), "secret": s.text()})
task = s.define_entity("task", {"title": s.text(), "owner": s.text(), "cost": s.int4(), "team": s.reference(team), "steps": s.owned(s.array({"text": s.text(), "hours": s.int4()}))})


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Writer(spark, f"file://{tmp_path_factory.mktemp('scopes')}/store").define(team, task)
    t = e.create(team, {"name": "red", "secret": "s"})
    e.create_many(task, [{"title": "a", "owner": "me", "cost": 1, "teamId": t["id"], "steps": [{"text": "x", "hours": 2}]}, {"title": "b", "owner": "you", "cost": 2}])
    return e


mine = {"owner": {"param": "user"}}


def test_rows_and_params(engine):
    scoped = Scoped(engine, define_scope("own", [scope_rule(task, ("read", "create", "update", "delete"), mine)]), {"user": "me"})
    assert [r.title for r in scoped.find(task).collect()] == ["a"] and scoped.count(task) == 1
    assert [r.title for r in scoped.find(task, {"or": [{"owner": "you"}, {"cost": {"gt": 0}}]}).collect()] == ["a"]
    assert scoped.aggregate(task, select={"n": count()}, facets={"o": {"groupBy": ["owner"], "select": {"n": count()}}}).facets["o"].collect() == [("me", 1.0)]
    with pytest.raises(Forbidden):
        scoped.create(task, {"title": "c", "owner": "you"})
    with pytest.raises(Forbidden):
        scoped.update_one(task, {"title": "a"}, {"owner": "you"})
    assert scoped.delete_many(task, {"title": "b"}) == 0 and engine.count(task) == 2
    with pytest.raises(Forbidden):
        scoped.find(team)
    with pytest.raises(MissingParam):
        Scoped(engine, scoped.scope).find(task)


def test_fields_and_reach(engine):
    scope = define_scope("some", [scope_rule(task, fields={"exclude": ["cost", "steps.hours"]}), scope_rule(team, fields={"include": ["name"]})])
    row = Scoped(engine, scope).find(task, {"title": "a"}, expand={"team": True}).first().asDict(recursive=True)
    assert "cost" not in row and set(row["steps"][0]) == {"id", "text", "createdAt", "updatedAt"} and set(row["team"]) == {"id", "name"}
    alone = Scoped(engine, define_scope("alone", [scope_rule(task, fields={"include": ["title"]})]))
    assert alone.find(task).columns == ["id", "title"]
    assert "team" not in Scoped(engine, define_scope("x", [scope_rule(task)])).find(task, expand="auto").columns
    for how in ({"expand": {"team": True}}, {"select": {"team": {"name": True}}}):
        with pytest.raises(Forbidden):
            alone.find(task, **how)
    with pytest.raises(Forbidden):
        Scoped(engine, scope, strict_fields=True).find(task, {"cost": 1})


def test_operators_of_rules(engine):
    for where, want in (({"cost": {"gte": 1, "lt": 2}}, ["a"]), ({"owner": {"notIn": ["me"]}}, ["b"]), ({"teamId": {"isNull": False}}, ["a"]), ({"team.name": "red"}, ["a"]), ({"title": {"like": "b%"}}, ["b"]), ({"not": {"owner": "me"}}, ["b"])):
        assert [r.title for r in Scoped(engine, define_scope("w", [scope_rule(task, where=where)])).find(task).collect()] == want


def test_ambient(engine):
    scope = define_scope("own", [scope_rule(task, where=mine)])
    client = ScopedClient(engine, [(lambda c: c == "boss", define_scope("all", [scope_rule(task)])), (lambda c: c == "clerk", scope)])
    with pytest.raises(Forbidden):
        client.count(task)
    with client.run_as(scope, {"user": "you"}):
        assert [r.title for r in client.find(task).collect()] == ["b"]
    with client.run_as_god():
        assert client.count(task) == 2
    with client.dispatch("boss"):
        assert client.count(task) == 2
    with pytest.raises(Forbidden):
        client.dispatch("guest")


def test_storage():
    made = from_ir([ensure_ids(to_ir(team)), ensure_ids(to_ir(task))])
    scope = define_scope("own", [scope_rule(made["task"], where={"and": [mine, {"team.name": {"in": ["red"]}}], "createdAt": {"isNull": False}, "teamId": {"ne": None}}, fields={"exclude": ["steps.hours"]})])
    stored = to_stored(scope, made)
    assert "owner" not in str(stored["rules"]["task"]["where"]) and "@createdAt" in stored["rules"]["task"]["where"]
    ir = to_ir(made["task"])
    ir["fields"] = {("boss" if k == "owner" else k): v for k, v in ir["fields"].items()}
    back = from_stored(stored, from_ir([to_ir(made["team"]), ir]))
    assert back.rules["task"].where["and"][0] == {"boss": {"param": "user"}} and back.rules["task"].where["teamId"] == {"ne": None}
    assert back.rules["task"].fields == {"exclude": ["steps.hours"]}
    with pytest.raises(QueryError):
        scope_rule(task, ("fly",))
