"""Dot paths as joins: one join for each distinct prefix, shared by all expressions of a query."""

from __future__ import annotations

from functools import reduce
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.plans.predicates import field_kind, scalar
from tessera.schema import Column, Owned, Reference
from tessera.sources.binding import Registry, Table


class Paths:
    """Rows of a table with what its paths reach. Single references and parts are left joins; the one list that is
    unnested is an inner join, so that rows without elements go."""

    def __init__(self, registry: Registry, df: DataFrame, table: Table, unnest: str | None = None) -> None:
        self.registry, self.df, self.unnest = registry, df, unnest
        self.places: dict[str, tuple[Table, str]] = {"": (table, "")}
        if unnest is not None:
            self._place(unnest)
            head, _, tail = unnest.rpartition(".")
            node = self._place(head)[0].shape.get(tail)
            if not (isinstance(node, Owned) and node.many):
                raise QueryError(f"unnest: {unnest} is no owned list")

    def _place(self, path: str) -> tuple[Table, str]:
        """The table that a path of relationships leads to, and the prefix of its columns."""
        if path in self.places:
            return self.places[path]
        head, _, name = path.rpartition(".")
        table, prefix = self._place(head)
        node = table.shape.get(name)
        if not isinstance(node, Owned | Reference):
            raise QueryError(f"{table.name} has no relationship {name}")
        if node.many and path != self.unnest:
            raise QueryError(f"{path} is a list; unnest it")
        if isinstance(node, Reference) and node.many:
            raise QueryError(f"{path} is a list of references")
        other = table.parts[name] if isinstance(node, Owned) else self.registry.target(table, name)
        to = f"_j{len(self.places)}_"
        rows = other.rows()
        rows = rows.select(*[F.col(f"`{c}`").alias(f"{to}{c}") for c in rows.columns])
        own, key = (f"{prefix}id", f"{to}_parent") if isinstance(node, Owned) else (f"{prefix}{name}Id", f"{to}id")
        self.df = self.df.join(rows, self.df[own] == rows[key], "inner" if path == self.unnest else "left")
        self.places[path] = (other, to)
        return self.places[path]

    def leaf(self, path: str) -> tuple[Expr, Column, str]:
        """The column of a path, its type, and the prefix of its table. A reference at the end is its id."""
        head, _, name = path.rpartition(".")
        table, prefix = self._place(head)
        node = table.shape.get(name)
        if isinstance(node, Reference) and not node.many:
            name = f"{name}Id"
        kind = field_kind(table, name)
        if kind is None:
            raise QueryError(f"{table.name} has no field {name}" if node is None else f"{path} is no scalar")
        return F.col(f"{prefix}{name}"), kind, prefix

    def condition(self, where: Mapping[str, Any]) -> Expr | None:
        """A condition on paths, in the three-valued logic of columns: no quantifiers, no lists."""
        parts = []
        for key, given in where.items():
            if key in ("and", "or"):
                found = [c for x in given or [] if (c := self.condition(x)) is not None]
                if found:
                    parts.append(reduce((lambda a, b: a & b) if key == "and" else (lambda a, b: a | b), found))
            elif key == "not":
                if (c := self.condition(given or {})) is not None:
                    parts.append(~c)
            else:
                c, kind, _ = self.leaf(key)
                if kind.many:
                    raise QueryError(f"{key} is a list; an accumulator's condition takes scalars")
                parts.append(scalar(c, kind, given, key))
        return reduce(lambda a, b: a & b, parts) if parts else None
