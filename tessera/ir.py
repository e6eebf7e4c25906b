"""Entities as JSON (IR), and the difference of two of them by field id.

A field's id lives through renames; a change has a risk: auto, confirm (data goes), needsValue (existing rows need one)
or blocked. What depends on data is given at its worst, and refined by migrate.probe().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, replace
from typing import Any

from tessera.errors import QueryError
from tessera.schema import MANAGED, MISSING, Column, Entity, Listed, Mirror, Owned, Reference, SelfMark, array, define_entity, owned, reference, time_bucket
from tessera.types import KINDS

VERSION = 1


def to_ir(entity: Entity) -> dict[str, Any]:
    out: dict[str, Any] = {"irVersion": VERSION, "name": entity.name, "fields": {f: _node(n, entity.name) for f, n in entity.shape.items()}}
    if entity.unique:
        out["unique"] = [list(g) for g in entity.unique]
    if entity.index:
        out["index"] = [list(g) for g in entity.index]
    if entity.partition_by:
        out["partitionBy"] = {"field": entity.partition_by.field, "interval": entity.partition_by.span}
    if entity.retention:
        out["retention"] = entity.retention
    return out


def _node(node: Any, own: str) -> dict[str, Any]:
    key = {"id": node.key} if node.key else {}
    if isinstance(node, Column):
        out = {"kind": "column", **key, "type": node.kind}
        for name, on in (("array", node.many), ("notNull", node.required), ("unique", node.is_unique), ("index", node.is_indexed)):
            if on:
                out[name] = True
        return out | ({} if node.standard is MISSING else {"default": node.standard})
    if isinstance(node, Reference):
        return {"kind": "reference", **key, "target": node.name(own), "cardinality": "many" if node.many else "one"} | ({"notNull": True} if node.required else {})
    out = {"kind": "owned", **key, "array": node.many}
    local = node.shape
    if isinstance(node.shape, Mirror):
        target = node.shape.entity
        out["mirror"] = target.name if isinstance(target, Entity) else target().name
        local = node.shape.extra
    if local or not isinstance(node.shape, Mirror):
        out["shape"] = {f: _node(n, own) for f, n in local.items()}
    return out | ({"table": node.table} if node.table else {})


def validate(ir: Mapping[str, Any]) -> None:
    """QueryError for what is no IR of an entity."""
    ids: set[str] = set()

    def walk(fields: Any, at: str) -> None:
        if not isinstance(fields, Mapping):
            raise QueryError(f"{at}: fields are an object")
        for name, node in fields.items():
            here, kind = f"{at}.{name}", node.get("kind") if isinstance(node, Mapping) else None
            if kind not in ("column", "reference", "owned"):
                raise QueryError(f"{here}: unknown kind {kind}")
            if name in MANAGED:
                raise QueryError(f"{here}: this field is there already")
            if kind == "column" and node.get("type") not in KINDS:
                raise QueryError(f"{here}: unknown type {node.get('type')}")
            if kind == "reference" and (node.get("cardinality") not in ("one", "many") or not isinstance(node.get("target"), str)):
                raise QueryError(f"{here}: a reference has a target and is of one or many")
            if kind == "owned":
                if not isinstance(node.get("array"), bool) or not ("shape" in node or "mirror" in node):
                    raise QueryError(f"{here}: an owned part says whether it is a list, and has a shape or a mirror")
                walk(node.get("shape", {}), here)
            if (key := node.get("id")) is not None:
                if key in ids:
                    raise QueryError(f"{here}: the id {key} is used twice")
                ids.add(key)

    if not isinstance(ir, Mapping) or not isinstance(ir.get("name"), str) or not ir["name"]:
        raise QueryError("an IR has a name")
    if ir.get("irVersion") != VERSION:
        raise QueryError(f"{ir['name']}: unknown irVersion {ir.get('irVersion')}")
    walk(ir.get("fields"), ir["name"])


def normalize(ir: Mapping[str, Any]) -> dict[str, Any]:
    """Without what says the default: false flags, empty groups and shapes of mirrors."""

    def clean(node: Mapping[str, Any]) -> dict[str, Any]:
        out = {k: v for k, v in node.items() if v is not None and not (v is False and k != "array" and k != "default") and not (k == "array" and v is False and node["kind"] == "column")}
        if "shape" in out:
            out["shape"] = {f: clean(n) for f, n in out["shape"].items()}
            if not out["shape"] and "mirror" in out:
                del out["shape"]
        return out

    out = {k: v for k, v in ir.items() if not (k in ("unique", "index") and not v) and v is not None}
    return out | {"fields": {f: clean(n) for f, n in ir["fields"].items()}}


def ensure_ids(ir: Mapping[str, Any], before: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """With an id for every field: its own, that of the field of its name before, or a new one."""

    def walk(fields: Mapping[str, Any], old: Mapping[str, Any]) -> dict[str, Any]:
        taken = {n.get("id") for n in fields.values()}
        out = {}
        for name, node in fields.items():
            was = old.get(name, {}) if old.get(name, {}).get("kind") == node["kind"] else {}
            key = node.get("id") or (was.get("id") if was.get("id") not in taken else None) or str(uuid.uuid4())
            out[name] = {**node, "id": key} | ({"shape": walk(node["shape"], was.get("shape", {}))} if "shape" in node else {})
        return out

    return {**ir, "fields": walk(ir["fields"], (before or {}).get("fields", {}))}


def from_ir(irs: Any) -> dict[str, Entity]:
    """The entities of some IRs. References to entities that aren't there are left out."""
    irs = {ir["name"]: ir for ir in irs}
    made: dict[str, Entity] = {}

    def shape(fields: Mapping[str, Any], own: str) -> dict[str, Any]:
        return {f: n for f, ir in fields.items() if (n := node(ir, own)) is not None}

    def node(ir: Mapping[str, Any], own: str) -> Any:
        key = ir.get("id")
        if ir["kind"] == "column":
            c = Column(ir["type"])
            c = array(c) if ir.get("array") else c
            c = replace(c, required=bool(ir.get("notNull", c.required)), is_unique=bool(ir.get("unique")), is_indexed=bool(ir.get("index")), key=key)
            return replace(c, standard=ir["default"]) if "default" in ir else c
        if ir["kind"] == "reference":
            target = ir["target"]
            if target not in irs:
                return None
            to: Any = SelfMark() if target == own else (lambda: made[target])
            r = reference(Listed(to) if ir["cardinality"] == "many" else to)
            return replace(r, required=bool(ir.get("notNull")), key=key)
        local = shape(ir.get("shape", {}), own)
        if mirrored := ir.get("mirror"):
            if mirrored not in irs:
                return None
            local = Mirror(lambda: made[mirrored], local)
        return replace(owned(Listed(local) if ir["array"] else local, ir.get("table")), key=key)

    for name, ir in irs.items():
        by, fields = ir.get("partitionBy"), shape(ir["fields"], name)
        there = lambda g: all(f in fields or f in MANAGED or f.endswith("Id") and f[:-2] in fields for f in g)
        unique, index = (tuple(g for g in ir.get(k, ()) if there(g)) for k in ("unique", "index"))
        made[name] = define_entity(name, fields, unique, index, time_bucket(by["field"], by["interval"]) if by else None, ir.get("retention"))
    return made


@dataclass(frozen=True)
class Change:
    op: str
    risk: str
    path: str
    title: str
    was: str | None = None
    columns: tuple[str, ...] | None = None
    fill_type: str | None = None
    detail: str = ""

    def json(self) -> dict[str, Any]:
        return {k: v for k, v in asdict(self).items() if v is not None}


@dataclass(frozen=True)
class Diff:
    entity: str
    is_new: bool
    changes: tuple[Change, ...]


def diff(before: Mapping[str, Any] | None, after: Mapping[str, Any]) -> Diff:
    """Changes from one IR to another; fields are matched by id, or by name if one has none."""
    if before is None:
        return Diff(after["name"], True, ())
    return Diff(after["name"], False, (*_fields(before["fields"], after["fields"], ""), *_groups(before, after)))


def _fields(old: Mapping[str, Any], new: Mapping[str, Any], at: str) -> Iterator[Change]:
    by_id = {n["id"]: f for f, n in old.items() if n.get("id")}
    matched = {}
    for name, node in new.items():
        was = by_id.get(node.get("id"))
        if was is None and name in old and not (old[name].get("id") and node.get("id")):
            was = name
        if was is not None:
            matched[name] = was
    for name in old:
        if name not in matched.values():
            what = "list" if old[name]["kind"] == "owned" else "field"
            yield Change("removeField", "confirm", at + name, f"Remove {at}{name}", detail=f"The {what}'s data goes.")
    for name, node in new.items():
        path = at + name
        if name not in matched:
            yield _added(path, node)
            continue
        was = old[matched[name]]
        if matched[name] != name:
            yield Change("renameField", "auto", path, f"Rename {matched[name]} to {name}", was=matched[name])
        yield from _changed(path, was, node)


def _added(path: str, node: Mapping[str, Any]) -> Change:
    needs = node.get("notNull") and not node.get("array") and "default" not in node and node.get("cardinality") != "many" and node["kind"] != "owned"
    fill = None if not needs else node["target"] if node["kind"] == "reference" else node["type"]
    return Change("addField", "needsValue" if needs else "auto", path, f"Add {path}", fill_type=fill)


def _changed(path: str, old: Mapping[str, Any], new: Mapping[str, Any]) -> Iterator[Change]:
    if old["kind"] != new["kind"]:
        yield Change("reshape", "blocked", path, f"Turn {path} from {old['kind']} to {new['kind']}")
        return
    if new["kind"] == "reference":
        if (old["target"], old["cardinality"]) != (new["target"], new["cardinality"]):
            yield Change("reshape", "blocked", path, f"Change what {path} refers to")
            return
        if new["cardinality"] == "one" and bool(old.get("notNull")) != bool(new.get("notNull")):
            yield _required(path, new, new["target"])
        return
    if new["kind"] == "owned":
        if old["array"] != new["array"] or old.get("mirror") != new.get("mirror"):
            yield Change("reshape", "blocked", path, f"Change the shape of {path}")
            return
        yield from _fields(old.get("shape", {}), new.get("shape", {}), f"{path}.")
        return
    if (old["type"], bool(old.get("array"))) != (new["type"], bool(new.get("array"))):
        yield Change("retypeField", "blocked", path, f"Change the type of {path}")
    if bool(old.get("notNull")) != bool(new.get("notNull")):
        yield _required(path, new, new["type"])
    if bool(old.get("unique")) != bool(new.get("unique")):
        yield Change("addUnique", "blocked", path, f"Make {path} unique") if new.get("unique") else Change("dropUnique", "auto", path, f"Let {path} repeat")
    if bool(old.get("index")) != bool(new.get("index")):
        yield Change("addIndex" if new.get("index") else "dropIndex", "auto", path, f"{'Add' if new.get('index') else 'Drop'} the index of {path}")
    if old.get("default", MISSING) != new.get("default", MISSING):
        yield Change("changeDefault", "auto", path, f"Change the default of {path}")


def _required(path: str, new: Mapping[str, Any], fill: str) -> Change:
    if new.get("notNull"):
        return Change("makeRequired", "needsValue", path, f"Require {path}", fill_type=fill)
    return Change("dropRequired", "auto", path, f"Make {path} optional")


def _groups(before: Mapping[str, Any], after: Mapping[str, Any]) -> Iterator[Change]:
    """Groups of fields that became unique or indexed together, or no longer are; by field, so that renames don't count."""

    def keyed(ir: Mapping[str, Any], name: str) -> dict[tuple, tuple[str, ...]]:
        return {tuple(sorted(ir["fields"].get(f, {}).get("id") or f for f in g)): tuple(g) for g in ir.get(name, [])}

    for name, risk in (("unique", "blocked"), ("index", "auto")):
        old, new = keyed(before, name), keyed(after, name)
        for k in old.keys() - new.keys():
            yield Change(f"dropComposite{name.title()}", "auto", ",".join(old[k]), f"Drop the {name} group {', '.join(old[k])}", columns=old[k])
        for k in new.keys() - old.keys():
            yield Change(f"addComposite{name.title()}", risk, ",".join(new[k]), f"Add the {name} group {', '.join(new[k])}", columns=new[k])
