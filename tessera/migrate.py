"""Schema changes on the store: catalog of entities, probes of the data, the gate, the rewrite, and pushes of projects."""

from __future__ import annotations

import json
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.ir import Change, Diff, diff, ensure_ids, from_ir, normalize, to_ir, validate
from tessera.naming import child_table, key_column, snake
from tessera.operators.writer import Writer, table_schemas
from tessera.plans.scopes import Scope, from_stored, to_stored
from tessera.schema import Entity, resolve


def topological(entities: Sequence[Entity]) -> list[Entity]:
    """Entities with those that they refer to, or mirror, in front where that is possible."""
    by, out, seen = {e.name: e for e in entities}, [], set()

    def visit(e: Entity) -> None:
        if e.name in seen:
            return
        seen.add(e.name)
        for node in to_ir(e)["fields"].values():
            for name in (node.get("target"), node.get("mirror")):
                if name in by:
                    visit(by[name])
        out.append(e)

    for e in entities:
        visit(e)
    return out


@dataclass(frozen=True)
class Applied:
    plan: Diff
    done: bool


class Catalog:
    """The entities of a store, kept as IR in its manifests, so that they change together with the tables."""

    def __init__(self, writer: Writer) -> None:
        self.writer, self.store = writer, writer.store
        self.irs: dict[str, dict[str, Any]] = self._read("entities")
        if self.irs:
            writer.define(*from_ir(self.irs.values()).values())

    def _read(self, name: str) -> dict[str, Any]:
        return json.loads(self.store.note(name) or "{}")

    def _save(self, name: str, value: Mapping[str, Any]) -> None:
        with self.store.transaction():
            self.store.put_note(name, json.dumps(value) if value else None)

    def entities(self) -> dict[str, Entity]:
        return from_ir(self.irs.values())

    # scopes --------------------------------------------------------------------------------------------------------

    def save_scope(self, scope: Scope) -> None:
        """Keeps a scope by field ids, beside the entities."""
        self._save("scopes", self._read("scopes") | {scope.name: to_stored(scope, self.entities())})

    def scope(self, name: str) -> Scope:
        """A kept scope, under the names that its fields have now."""
        if name not in (stored := self._read("scopes")):
            raise QueryError(f"there is no scope {name}")
        return from_stored(stored[name], self.entities())

    # plan ----------------------------------------------------------------------------------------------------------

    def plan(self, entity: Entity | Mapping[str, Any], fill: Mapping[str, Any] | None = None) -> Diff:
        """The changes that an entity would bring, with risks after a look at the data."""
        ir = normalize(to_ir(entity) if isinstance(entity, Entity) else entity)
        validate(ir)
        before = self.irs.get(ir["name"])
        ir = ensure_ids(ir, before)
        found = diff(before, ir)
        return found if found.is_new else replace(found, changes=tuple(self._probe(before, ir, found, c, fill or {}) for c in found.changes))

    def _column(self, before: Mapping[str, Any], after: Mapping[str, Any], name: str) -> str | None:
        """The column that a field has had before, by its id."""
        key = after["fields"].get(name, {}).get("id")
        for f, node in before["fields"].items():
            if node.get("id") == key and node["kind"] != "owned":
                return f"{snake(f)}_id" if node["kind"] == "reference" else snake(f)
        return None

    def _probe(self, before: Mapping[str, Any], after: Mapping[str, Any], plan: Diff, c: Change, fill: Mapping[str, Any]) -> Change:
        if "." in c.path and c.op != "addField":
            return replace(c, risk="blocked", detail="Fields inside a part can't be changed yet.")
        rows = self.store.frame(snake(after["name"]))
        auto = replace(c, risk="auto")
        if c.op in ("addUnique", "addCompositeUnique"):
            columns = []
            for f in c.columns or (c.path,):
                column, node = self._column(before, after, f), after["fields"].get(f, {})
                if column:
                    filled = any(x.op == "makeRequired" and x.path == f for x in plan.changes) and f in fill
                    columns.append(F.coalesce(F.col(column).cast("string"), F.lit(str(fill[f]))) if filled else F.col(column))
                elif fill.get(f, node.get("default")) is None:
                    return auto  # null in every row: nothing is equal
            if not columns:
                return c if rows.count() > 1 else auto
            full = reduce(lambda a, b: a & b, [x.isNotNull() for x in columns])
            named = [x.alias(f"c{i}") for i, x in enumerate(columns)]
            return c if rows.where(full).groupBy(*named).count().where("count > 1").first() else auto
        if c.op == "makeRequired":
            if not rows.where(F.col(self._column(before, after, c.path)).isNull()).first():
                return auto
            unique = after["fields"][c.path].get("unique")
            return replace(c, risk="blocked", detail="Each empty row needs a value of its own.") if unique else c
        if c.op == "addField" and c.risk == "needsValue":
            return c if rows.first() else auto
        return c

    # apply ---------------------------------------------------------------------------------------------------------

    def apply(self, entity: Entity | Mapping[str, Any], confirm: bool | Collection[str] = False, fill: Mapping[str, Any] | None = None, dry: bool = False) -> Applied:
        """Applies what the gate lets through: blocked changes never, losses if confirmed (all, or those of some paths),
        required fields if filled. Tables and definitions change in one commit, or not at all."""
        fill = fill or {}
        confirmed = lambda path: confirm if isinstance(confirm, bool) else path in confirm
        ir = normalize(to_ir(entity) if isinstance(entity, Entity) else entity)
        validate(ir)
        before = self.irs.get(ir["name"])
        ir = ensure_ids(ir, before)
        plan = self.plan(ir, fill)
        stop = [c for c in plan.changes if c.risk == "blocked" or c.risk == "confirm" and not confirmed(c.path) or c.risk == "needsValue" and c.path not in fill]
        if dry or stop:
            return Applied(plan, False)
        irs = self.irs | {ir["name"]: ir}
        made = from_ir(irs.values())
        try:
            with self.store.transaction():
                if before is not None:
                    self._rewrite(before, ir, made[ir["name"]], fill)
                self._save("entities", irs)
        except BaseException:
            self.writer.define(*self.entities().values())
            raise
        self.irs = irs
        self.writer.define(*made.values())
        return Applied(plan, True)

    def push(self, entities: Sequence[Entity], renames: Mapping[str, Mapping[str, str]] | None = None, confirm: bool | Mapping[str, Collection[str]] = False, fill: Mapping[str, Mapping[str, Any]] | None = None, source: str = "push") -> dict[str, Applied]:
        """Applies a project's entities, those that others refer to in front. By entity: renames (old to new field name),
        confirm (paths whose loss is agreed to) and fill (path to value). Each entity is applied or held back as a whole;
        what is held back is kept as pending, until a push leaves nothing."""
        out, held = {}, []
        for e in topological(entities):
            ir, old = to_ir(e), self.irs.get(e.name, {"fields": {}})["fields"]
            for was, now in (renames or {}).get(e.name, {}).items():
                if "id" in old.get(was, {}) and now in ir["fields"]:
                    ir["fields"][now] = ir["fields"][now] | {"id": old[was]["id"]}
            done = self.apply(ir, confirm if isinstance(confirm, bool) else confirm.get(e.name, ()), (fill or {}).get(e.name))
            out[e.name] = done
            if not done.done:
                held.append({"name": e.name, "ir": ir, "changes": [c.json() for c in done.plan.changes]})
        self._save("pending", {"source": source, "at": self.writer.clock().isoformat(), "entries": held} if held else {})
        return out

    def pending(self) -> dict[str, Any] | None:
        """What the last push held back: source, at, and entries of (name, ir, changes); None if nothing is."""
        return self._read("pending") or None

    def push_all(self, entities: Sequence[Entity], scopes: Sequence[Scope] = (), **how: Any) -> tuple[dict[str, Applied], list[str]]:
        """push(), and the scopes once no entity is held back, as they name fields by id; with the names of those saved."""
        out = self.push(entities, **how)
        saved = list(scopes) if all(x.done for x in out.values()) else []
        for scope in saved:
            self.save_scope(scope)
        return out, [x.name for x in saved]

    def _moved(self, before: Mapping[str, Any], after: Mapping[str, Any], tables: Collection[str]) -> dict[str, str]:
        """New to old names of the tables of renamed parts and links, and of what hangs on them."""
        name, out = snake(after["name"]), {}
        for f, node in after["fields"].items():
            was = next((g for g, n in before["fields"].items() if n.get("id") == node["id"]), None)
            if was and was != f and (node["kind"] == "owned" or node.get("cardinality") == "many"):
                old, new = child_table(name, was), child_table(name, f)
                out |= {new + t[len(old) :]: t for t in tables if t == old or t.startswith(f"{old}__")}
        return out

    def _rewrite(self, before: Mapping[str, Any], after: Mapping[str, Any], entity: Entity, fill: Mapping[str, Any]) -> None:
        name = snake(entity.name)
        new = table_schemas(name, resolve(entity.shape))
        old_names = set(table_schemas(name, resolve(from_ir([before, *(v for k, v in self.irs.items() if k != before["name"])])[entity.name].shape)))
        moved = self._moved(before, after, old_names)
        rows = self.store.frame(name)
        # all sources as they were, as names can change places
        frames = {target: self.store.frame(source) for target, source in moved.items()}
        with self.store.transaction():
            for target, frame in frames.items():
                owner = {key_column(target.rsplit("__", 1)[0]): key_column(moved[target].rsplit("__", 1)[0])}
                source = {c: c if c in frame.columns else owner.get(c) for c in new[target].names}
                self.store.declare(target, new[target])
                self.store.replace(target, frame.select(*[F.col(s).alias(c) if s else F.lit(None).alias(c) for c, s in source.items()]))
            out = []
            for field in new[name]:
                f = next((g for g in after["fields"] if field.name in (snake(g), f"{snake(g)}_id")), None)
                column = field.name if f is None else self._column(before, after, f)
                node = after["fields"].get(f, {})
                given = fill.get(f, node.get("default")) if f else None
                value = F.col(column).cast(field.dataType) if column and column in rows.columns else F.lit(None).cast(field.dataType)
                if f and (column is None or node.get("notNull")) and given is not None:
                    value = F.coalesce(value, (F.array() if given == [] else F.lit(given)).cast(field.dataType))
                out.append(value.alias(field.name))
            schema = new[name]
            if "_bucket" in rows.columns:
                out.append(F.col("_bucket"))
                schema = type(schema)([*schema.fields, rows.schema["_bucket"]])
            self.store.declare(name, schema)
            self.store.replace(name, rows.select(*out))
            for gone in old_names - set(new) - {name}:
                self.store.drop(gone)


def drift(writer: Writer, entity: Entity) -> list[str]:
    """What the stored rows of an entity's tables have otherwise than their schema says."""
    out = []
    for name, schema in table_schemas(snake(entity.name), resolve(entity.shape)).items():
        paths = writer.store.segments().get(name, [])
        if not paths:
            continue
        found = writer.spark.read.parquet(*[f"{writer.store.folder}/tables/{name}/{p}" for p in paths]).schema
        for f in schema:
            if f.name not in found.names:
                out.append(f"{name}.{f.name} is missing")
            elif found[f.name].dataType != f.dataType:
                out.append(f"{name}.{f.name} is {found[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        out += [f"{name}.{c} is unknown" for c in found.names if c not in schema.names and c != "_bucket"]
    return out


def check(entities: Sequence[Entity]) -> None:
    """QueryError if some entities don't fit together."""
    names = {e.name for e in entities}
    for e in entities:
        validate(to_ir(e))
        resolve(e.shape)
        for f, node in to_ir(e)["fields"].items():
            if node["kind"] == "reference" and node["target"] not in names:
                raise QueryError(f"{e.name}.{f} refers to {node['target']}, which isn't there")
