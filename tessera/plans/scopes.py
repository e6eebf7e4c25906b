"""Scopes: which verbs, rows and fields of an entity a caller may use.

A rule's row filter is joined to every condition, its fields are cut from results in the plan, and written rows must
fulfil it. Rules are stored by field id, so that they live through renames.
"""

from __future__ import annotations

import contextvars
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.engine import Engine
from tessera.errors import Forbidden, MissingParam, QueryError
from tessera.operators.aggregate import AggregateResult
from tessera.schema import MANAGED, Entity, Owned, Projection, Reference, resolve

VERBS = ("read", "create", "update", "delete")


@dataclass(frozen=True)
class Rule:
    """where: a condition, with {"param": name} for values of the request and dot paths for relationships.
    fields: {"include": [...]} or {"exclude": [...]} of dot paths; id always stays."""

    verbs: tuple[str, ...] = ("read",)
    where: Mapping[str, Any] | None = None
    fields: Mapping[str, Any] | None = None


@dataclass(frozen=True)
class Scope:
    name: str
    rules: Mapping[str, Rule] = field(default_factory=dict)


def scope_rule(entity: Entity, verbs: Any = ("read",), where: Any = None, fields: Any = None) -> tuple[str, Rule]:
    if unknown := set(verbs) - set(VERBS):
        raise QueryError(f"unknown verb {sorted(unknown)[0]}; there are {list(VERBS)}")
    if fields and (len(fields) != 1 or set(fields) - {"include", "exclude"}):
        raise QueryError("fields are either included or excluded")
    return entity.name, Rule(tuple(verbs), where, fields)


def define_scope(name: str, rules: Any) -> Scope:
    return Scope(name, dict(rules))


def filled(where: Any, params: Mapping[str, Any]) -> Any:
    """A condition with the request's parameters in place."""
    if isinstance(where, Mapping):
        if set(where) == {"param"}:
            if where["param"] not in params:
                raise MissingParam(f"the scope needs the parameter {where['param']}")
            return params[where["param"]]
        return {k: filled(v, params) for k, v in where.items()}
    return [filled(v, params) for v in where] if isinstance(where, list | tuple) else where


def spread(where: Any) -> Any:
    """A condition with its dot paths as nested objects; several on one relationship are joined by `and`."""
    if not isinstance(where, Mapping):
        return [spread(x) for x in where] if isinstance(where, list | tuple) and any(isinstance(x, Mapping) for x in where) else where
    out: list[dict] = []
    for key, value in where.items():
        value = spread(value)
        for name in reversed(key.split(".")):
            value = {name: value}
        out.append(value)
    keys = [k for x in out for k in x]
    return {k: v for x in out for k, v in x.items()} if len(keys) == len(set(keys)) else {"and": out}


def _renamed(where: Any, shape: Mapping[str, Any], other: Callable[[Any, str], Mapping[str, Any]], key: Callable[[Mapping, str], str]) -> Any:
    if not isinstance(where, Mapping) or set(where) == {"param"}:
        return where
    out = {}
    for name, value in where.items():
        if name in ("and", "or"):
            out[name] = [_renamed(x, shape, other, key) for x in value]
        elif name == "not":
            out[name] = _renamed(value, shape, other, key)
        else:
            to = key(shape, name)
            node = shape.get(name) or shape.get(to)
            if isinstance(node, Owned | Reference) and isinstance(value, Mapping):
                inner = other(node, name)
                value = {q: _renamed(v, inner, other, key) for q, v in value.items()} if node.many else _renamed(value, inner, other, key)
            out[to] = value
    return out


def _shape_of(entity: Entity, entities: Mapping[str, Entity]) -> Callable[[Any, str], Mapping[str, Any]]:
    return lambda node, _: node.shape if isinstance(node, Owned) else resolve(entities[node.name(entity.name)].shape)


def _id_of(shape: Mapping[str, Any], name: str) -> str:
    if name in MANAGED:
        return f"@{name}"
    base = name[:-2] if name not in shape and name.endswith("Id") else name
    if base not in shape:
        raise QueryError(f"there is no field {name}")
    key = getattr(shape[base], "key", None)
    if not key:
        raise QueryError(f"{name} has no field id; see ensure_ids")
    return key if base == name else f"{key}:id"


def _name_of(shape: Mapping[str, Any], key: str) -> str:
    if key.startswith("@"):
        return key[1:]
    base, _, tail = key.partition(":")
    for name, node in shape.items():
        if node.key == base:
            return f"{name}Id" if tail else name
    raise QueryError(f"the field {key} of a stored scope is gone")


def to_stored(scope: Scope, entities: Mapping[str, Entity]) -> dict[str, Any]:
    """A scope as JSON, by field ids; system fields have marks of their own."""
    rules = {}
    for name, rule in scope.rules.items():
        entity = entities[name]
        shape, other = resolve(entity.shape), _shape_of(entity, entities)
        fields = {k: [_path(p, shape, other, _id_of) for p in v] for k, v in (rule.fields or {}).items()} or None
        rules[name] = {"verbs": list(rule.verbs), "where": _renamed(spread(rule.where), shape, other, _id_of), "fields": fields}
    return {"name": scope.name, "rules": rules}


def from_stored(stored: Mapping[str, Any], entities: Mapping[str, Entity]) -> Scope:
    rules = {}
    for name, rule in stored["rules"].items():
        entity = entities[name]
        shape, other = resolve(entity.shape), _shape_of(entity, entities)
        lookup = lambda s, k: _name_of(s, k)

        def back(where: Any, s: Mapping[str, Any] = shape) -> Any:
            if not isinstance(where, Mapping) or set(where) == {"param"}:
                return where
            out = {}
            for k, v in where.items():
                if k in ("and", "or"):
                    out[k] = [back(x, s) for x in v]
                elif k == "not":
                    out[k] = back(v, s)
                else:
                    n = lookup(s, k)
                    node = s.get(n)
                    if isinstance(node, Owned | Reference) and isinstance(v, Mapping):
                        inner = other(node, n)
                        v = {q: back(x, inner) for q, x in v.items()} if node.many else back(v, inner)
                    out[n] = v
            return out

        fields = {k: [_path(p, shape, other, _name_of) for p in v] for k, v in (rule["fields"] or {}).items()} or None
        rules[name] = Rule(tuple(rule["verbs"]), back(rule["where"]), fields)
    return Scope(stored["name"], rules)


def _path(path: str, shape: Mapping[str, Any], other: Callable, key: Callable) -> str:
    out = []
    for step in path.split("."):
        to = key(shape, step)
        out.append(to)
        node = shape.get(step) or shape.get(to)
        shape = other(node, step) if isinstance(node, Owned | Reference) else {}
    return ".".join(out)


def _tree(paths: Any) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for p in paths:
        at = out
        *head, last = p.split(".")
        for step in head:
            at = at.setdefault(step, {})
            if at is True:
                break
        else:
            at[last] = True
    return out


def cut(df: DataFrame, fields: Mapping[str, Any] | None) -> DataFrame:
    """Rows without the fields that a rule hides, also inside nested objects and lists."""
    if not fields:
        return df
    include, tree = "include" in fields, _tree(next(iter(fields.values())))

    def stays(name: str, at: Mapping[str, Any]) -> Any:
        """True, False, or the tree of what is below."""
        if name == "id":
            return True
        if include:
            return at.get(name, False)
        found = at.get(name)
        return False if found is True else True if found is None else found

    def rebuilt(c: Any, kind: T.DataType, at: Mapping[str, Any]) -> Any:
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: rebuilt(x, kind.elementType, at))
        if not isinstance(kind, T.StructType):
            return c
        parts = [(rebuilt(c[f.name], f.dataType, s) if isinstance(s, dict) else c[f.name]).alias(f.name) for f in kind.fields if (s := stays(f.name, at)) is not False]
        return F.when(c.isNotNull(), F.struct(*parts))

    out = []
    for f in df.schema.fields:
        s = stays(f.name, tree)
        if s is not False:
            out.append((rebuilt(F.col(f.name), f.dataType, s) if isinstance(s, dict) else F.col(f.name)).alias(f.name))
    return df.select(*out)


class Scoped:
    """An engine's verbs under a scope; no scope is full access."""

    def __init__(self, engine: Engine, scope: Scope | None, params: Mapping[str, Any] | None = None, strict_fields: bool = False) -> None:
        self.engine, self.scope, self.params, self.strict = engine, scope, params or {}, strict_fields

    def _rule(self, entity: str, verb: str) -> Rule:
        if self.scope is None:
            return Rule(VERBS)
        rule = self.scope.rules.get(entity)
        if rule is None or verb not in rule.verbs:
            raise Forbidden(f"the scope {self.scope.name} can't {verb} {entity}")
        return rule

    def _before(self, rule: Rule) -> Any:
        return spread(filled(rule.where, self.params)) if rule.where else None

    def _reached(self, entity: str, shape: Mapping[str, Any], expand: Any, select: Any) -> tuple[Any, list[tuple[str, Mapping[str, Any]]]]:
        """What is expanded once "auto" leaves out what can't be read, and the projections of entities that are reached."""
        found: list[tuple[str, Mapping[str, Any]]] = []

        def walk(shape: Mapping[str, Any], expand: Any, select: Any, at: str, auto: bool) -> Any:
            out = {}
            for name, node in shape.items():
                chosen = isinstance(select, Mapping)
                sub = select.get(name) if chosen else None
                if chosen and not sub:
                    continue
                deeper = expand.get(name) if isinstance(expand, Mapping) and not chosen else None
                if isinstance(node, Owned):
                    inner = walk(node.shape, deeper, sub, f"{at}{name}.", auto and not chosen)
                    if inner:
                        out[name] = inner
                elif isinstance(node, Reference) and (sub or deeper or auto and not chosen):
                    target = node.name(entity)
                    rule = self.scope.rules.get(target)
                    if rule is None or "read" not in rule.verbs:
                        if sub or deeper:
                            raise Forbidden(f"the scope {self.scope.name} can't read {target}")
                        continue
                    if rule.fields:
                        found.append((f"{at}{name}", rule.fields))
                    inner = walk(self.engine.registry.table(target).shape, deeper, sub, f"{at}{name}.", False)
                    out[name] = inner or True
            return out

        expanded = walk(shape, expand, select, "", expand == "auto")
        return (expanded if expand == "auto" else expand), found

    def find(self, what: Any, where: Any = None, expand: Any = None, select: Any = None, **how: Any) -> DataFrame:
        if isinstance(what, Projection):
            what, select = what.entity, what.select if select is None else select
        name = what if isinstance(what, str) else what.name
        rule = self._rule(name, "read")
        if self.scope is None:
            return self.engine.find(what, where, expand=expand, select=select, **how)
        shape = self.engine.registry.table(name).shape
        self._strict(rule, where, how.get("order_by"))
        expand, reached = self._reached(name, shape, expand, select)
        rows = self.engine.find(what, where, expand=expand, select=select, before=self._before(rule), **how)
        for path, fields in reached:
            rows = _cut_below(rows, path.split("."), fields)
        return cut(rows, rule.fields)

    def _strict(self, rule: Rule, *parts: Any) -> None:
        """With strict_fields, hidden fields can't be filtered or ordered by either."""
        if not self.strict or not rule.fields:
            return
        include, tree = "include" in rule.fields, _tree(next(iter(rule.fields.values())))
        for part in parts:
            for key in part or {}:
                base = key.split(".")[0]
                if base in ("and", "or", "not"):
                    inner = part[key]
                    self._strict(rule, *(inner if isinstance(inner, list) else [inner]))
                elif base not in MANAGED and (base not in tree if include else tree.get(base) is True):
                    raise Forbidden(f"{base} is hidden")

    def count(self, what: Any, where: Any = None) -> int:
        return self.engine.count(what, where, before=self._before(self._rule(what if isinstance(what, str) else what.name, "read")))

    def aggregate(self, what: Any, query: Mapping[str, Any] | None = None, **parts: Any) -> AggregateResult:
        rule = self._rule(what if isinstance(what, str) else what.name, "read")
        self._strict(rule, (query or parts).get("where"))
        return self.engine.aggregate(what, query, self._before(rule), **parts)

    def create(self, entity: Entity, x: Mapping[str, Any]) -> dict:
        check = self._before(self._rule(entity.name, "create"))
        return self.engine.create(entity, x, check)

    def create_many(self, entity: Entity, inputs: Any) -> list[dict]:
        check = self._before(self._rule(entity.name, "create"))
        return self.engine.create_many(entity, inputs, check)

    def accumulate(self, entity: Entity, key: Any, ops: Any) -> dict:
        rule = self._rule(entity.name, "create")
        self._rule(entity.name, "update")
        return self.engine.accumulate(entity, key, ops, self._before(rule))

    def update_one(self, entity: Entity, where: Any, patch: Any, order_by: Any = None) -> dict:
        before = self._before(self._rule(entity.name, "update"))
        return self.engine.update_one(entity, where, patch, order_by, before, before)

    def update_many(self, entity: Entity, where: Any, patch: Any) -> int:
        before = self._before(self._rule(entity.name, "update"))
        return self.engine.update_many(entity, where, patch, before, before)

    def delete_one(self, entity: Entity, where: Any, order_by: Any = None) -> bool:
        before = self._before(self._rule(entity.name, "delete"))
        return self.engine.delete_one(entity, where, order_by, before)

    def delete_many(self, entity: Entity, where: Any) -> int:
        before = self._before(self._rule(entity.name, "delete"))
        return self.engine.delete_many(entity, where, before)


def _cut_below(df: DataFrame, path: list[str], fields: Mapping[str, Any]) -> DataFrame:
    """Cuts the fields of an entity that stands below a path of a result."""
    full = {k: [".".join([*path, p]) for p in v] for k, v in fields.items()}
    if "exclude" in full:
        return cut(df, full)

    def names(kind: T.DataType) -> list[str]:
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        return [f.name for f in kind.fields] if isinstance(kind, T.StructType) else []

    kind: T.DataType = df.schema
    for step in path:
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if step not in names(kind):
            return df
        kind = kind[step].dataType
    shown = {p.split(".")[0] for p in fields["include"]}
    return cut(df, {"exclude": [".".join([*path, n]) for n in names(kind) if n != "id" and n not in shown]})


_ambient: contextvars.ContextVar[Any] = contextvars.ContextVar("scope", default=None)
_GOD = object()


class ScopedClient:
    """Verbs under the scope that run_as() has set; outside of it nothing is allowed.

    dispatcher: (test, scope) pairs of which dispatch() takes the first whose test holds for the caller.
    """

    def __init__(self, engine: Engine, dispatcher: Any = ()) -> None:
        self.engine, self.rules = engine, list(dispatcher)

    @contextmanager
    def run_as(self, scope: Scope, params: Mapping[str, Any] | None = None) -> Iterator[None]:
        token = _ambient.set((scope, params or {}))
        try:
            yield
        finally:
            _ambient.reset(token)

    @contextmanager
    def run_as_god(self) -> Iterator[None]:
        token = _ambient.set(_GOD)
        try:
            yield
        finally:
            _ambient.reset(token)

    @property
    def god(self) -> Engine:
        return self.engine

    def dispatch(self, caller: Any, params: Mapping[str, Any] | None = None):
        for test, scope in self.rules:
            if test(caller):
                return self.run_as(scope, params)
        raise Forbidden("no scope is for this caller")

    def __getattr__(self, verb: str) -> Any:
        now = _ambient.get()
        if now is None:
            raise Forbidden("there is no scope here; see run_as")
        return getattr(Scoped(self.engine, None), verb) if now is _GOD else getattr(Scoped(self.engine, *now), verb)
