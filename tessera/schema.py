"""Entities: scalar columns, owned parts and references to other entities.

A shape maps field names to columns, `owned` parts (a table of their own, with the parent's life) and `reference`s. Every
entity and owned part has the fields id, createdAt and updatedAt besides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from tessera.errors import QueryError
from tessera.types import KINDS

MANAGED = ("id", "createdAt", "updatedAt")
MISSING = object()


@dataclass(frozen=True)
class Column:
    """A scalar field, nullable unless said otherwise; or a list of scalars, which is [] by default and never null."""

    kind: str
    many: bool = False
    required: bool = False
    standard: Any = MISSING
    is_unique: bool = False
    is_indexed: bool = False
    key: str | None = None

    def not_null(self) -> Column:
        return replace(self, required=True)

    def nullable(self) -> Column:
        return replace(self, required=False)

    def default(self, value: Any) -> Column:
        if self.many and value != []:
            raise QueryError("a list's default can only be empty")
        return replace(self, standard=value)

    def unique(self) -> Column:
        return replace(self, is_unique=True)

    def index(self) -> Column:
        return replace(self, is_indexed=True)

    def with_id(self, key: str) -> Column:
        return replace(self, key=key)

    @property
    def label(self) -> str:
        return KINDS[self.kind].label

    @property
    def numeric(self) -> bool:
        return not self.many and self.label in ("number", "bigint")


def _scalar(name: str) -> Callable[[], Column]:
    return lambda: Column(name)


int2, int4, int8, numeric, float4, float8 = map(_scalar, ("int2", "int4", "int8", "numeric", "float4", "float8"))
text, varchar, bpchar, uuid = map(_scalar, ("text", "varchar", "bpchar", "uuid"))
timestamptz, timestamp, date, time, interval = map(_scalar, ("timestamptz", "timestamp", "date", "time", "interval"))
boolean, json, jsonb, bytea = map(_scalar, ("bool", "json", "jsonb", "bytea"))


@dataclass(frozen=True)
class Listed:
    """What array() makes of anything but a scalar."""

    of: Any


def array(of: Any) -> Column | Listed:
    if isinstance(of, Column):
        return replace(of, many=True, required=True, standard=[])
    return Listed(of)


@dataclass(frozen=True)
class Mirror:
    """The shape of another entity at this time, with own fields that win over its."""

    entity: Any
    extra: Mapping[str, Any]


def mirror(entity: Any, extra: Mapping[str, Any] | None = None) -> Mirror:
    return Mirror(entity, extra or {})


@dataclass(frozen=True)
class Owned:
    shape: Any  # a mapping or a Mirror
    many: bool = False
    key: str | None = None
    table: str | None = None

    def with_id(self, key: str) -> Owned:
        return replace(self, key=key)


def owned(of: Any, table: str | None = None) -> Owned:
    """A part: owned({...}) is one or none, owned(array({...})) is a list; {...} may be a mirror()."""
    return Owned(of.of, True, None, table) if isinstance(of, Listed) else Owned(of, False, None, table)


@dataclass(frozen=True)
class SelfMark:
    pass


def self_ref() -> SelfMark:
    """In reference(): the entity being defined."""
    return SelfMark()


@dataclass(frozen=True)
class Reference:
    target: Any  # an Entity, its name, a function that gives it, or self_ref()
    many: bool = False
    required: bool = False
    key: str | None = None

    def not_null(self) -> Reference:
        return replace(self, required=True)

    def with_id(self, key: str) -> Reference:
        return replace(self, key=key)

    def name(self, own: str) -> str:
        target = self.target
        if isinstance(target, SelfMark):
            return own
        if isinstance(target, Entity | str):
            return target if isinstance(target, str) else target.name
        return target().name


def reference(to: Any) -> Reference:
    """A link: reference(E) holds one id, reference(array(E)) a set of them."""
    return Reference(to.of, True) if isinstance(to, Listed) else Reference(to)


_INTERVAL = re.compile(r"(\d+)(s|min|h|d)")
_SECONDS = {"s": 1, "min": 60, "h": 3600, "d": 86400}


def seconds(span: str) -> int:
    """Seconds of a span such as 30s, 5min, 1h or 7d."""
    found = _INTERVAL.fullmatch(span)
    if not found or not int(found[1]):
        raise QueryError(f"{span!r} is no span such as 30s, 5min, 1h or 7d")
    return int(found[1]) * _SECONDS[found[2]]


@dataclass(frozen=True)
class TimeBucket:
    field: str
    span: str


def time_bucket(name: str, span: str) -> TimeBucket:
    """Spans of time since the epoch (UTC), by a field."""
    seconds(span)
    return TimeBucket(name, span)


@dataclass(frozen=True)
class Entity:
    name: str
    shape: Mapping[str, Any]
    unique: tuple[tuple[str, ...], ...] = ()
    index: tuple[tuple[str, ...], ...] = ()
    partition_by: TimeBucket | None = None
    retention: str | None = None
    options: Mapping[str, Any] = field(default_factory=dict)


def resolve(shape: Any, seen: tuple[str, ...] = ()) -> dict[str, Any]:
    """A shape with the shapes of its mirrors filled in; a mirror of itself is an error. Mirrored columns aren't unique,
    and their ids are their own entity's, so they are left out."""
    if isinstance(shape, Mirror):
        entity = shape.entity if isinstance(shape.entity, Entity) else shape.entity()
        if entity.name in seen:
            raise QueryError(f"{entity.name} mirrors itself")
        copied = {k: replace(v, key=None, **({"is_unique": False} if isinstance(v, Column) else {})) for k, v in entity.shape.items()}
        shape, seen = {**copied, **shape.extra}, (*seen, entity.name)
    return {k: replace(v, shape=resolve(v.shape, seen)) if isinstance(v, Owned) else v for k, v in shape.items()}


def define_entity(name: str, shape: Mapping[str, Any], unique: Any = (), index: Any = (), partition_by: TimeBucket | None = None, retention: str | None = None) -> Entity:
    """An entity; names and options are checked here, references when they are used."""
    for f, node in shape.items():
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", f):
            raise QueryError(f"{name}.{f}: a field name is letters and digits")
        if f in MANAGED:
            raise QueryError(f"{name}.{f}: this field is there already")
        if not isinstance(node, Column | Owned | Reference):
            raise QueryError(f"{name}.{f}: not a column, an owned part or a reference")
        if isinstance(node, Reference) and not node.many and f"{f}Id" in shape:
            raise QueryError(f"{name}.{f}Id: the reference {f} makes this field")
    for group in (*unique, *index):
        for f in group:
            if f not in shape and f not in MANAGED and not (f.endswith("Id") and f[:-2] in shape):
                raise QueryError(f"{name}: {f} of a unique or index group is no field")
    if partition_by:
        at = shape.get(partition_by.field)
        if not (isinstance(at, Column) and at.kind == "timestamptz" and at.required):
            raise QueryError(f"{name}: it can only be partitioned by a timestamptz that isn't null")
    if retention:
        seconds(retention)
        if not partition_by:
            raise QueryError(f"{name}: retention needs partitions")
    return Entity(name, dict(shape), tuple(map(tuple, unique)), tuple(map(tuple, index)), partition_by, retention)


@dataclass(frozen=True)
class Projection:
    entity: Entity
    select: Mapping[str, Any]


def projection(entity: Entity, select: Mapping[str, Any]) -> Projection:
    """A named selection that find() and paginate() take in place of an entity."""
    return Projection(entity, select)
