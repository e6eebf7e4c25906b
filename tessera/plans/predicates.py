"""`where`: nested conditions as Spark columns and joins.

A condition on a relationship is true or false, never null. At the top of a conjunction it becomes a semi or anti join;
below `or` and `not` it becomes an EXISTS, which Catalyst plans as an existence join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.schema import MANAGED, Column, Owned, Reference, seconds
from tessera.sources.binding import Registry, Table
from tessera.types import KINDS, canonical_json

UNSET = object()  # a value that stands for a key that isn't there
_marks = count()

SCALAR = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}
LIST_OPS = ("has", "hasSome", "hasEvery", "isEmpty", "some")
QUANTIFIERS = ("some", "none", "every")
_MANAGED = {"id": Column("text"), "createdAt": Column("timestamptz"), "updatedAt": Column("timestamptz")}


def literal(value: Any, kind: Column) -> Expr:
    """A bound value; times given as text are read as such."""
    if kind.label == "unknown":
        return F.lit(canonical_json(value))
    if kind.label == "Date" and isinstance(value, str):
        return F.lit(value).cast(KINDS[kind.kind].spark)
    if kind.kind == "timestamptz" and isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.lit(value).cast("timestamp")
    return F.lit(value)


def scalar(c: Expr, kind: Column, given: Any, at: str) -> Expr:
    """A condition on a scalar: a value, null, or operators, all of which must hold."""
    raw = c
    if kind.label == "unknown":
        c = F.to_json(F.try_parse_json(c))  # whatever blanks and order of keys the text has
    json_value = kind.label == "unknown" and isinstance(given, Mapping) and not (given and set(given) <= {*SCALAR, "in", "notIn", "isNull"})
    if given is None:
        return raw.isNull()
    if not isinstance(given, Mapping) or json_value:
        return c == literal(given, kind)
    if not given:
        raise QueryError(f"{at}: {{}} has no operator")
    out = []
    for op, value in given.items():
        if value is UNSET:
            continue
        if op in ("eq", "ne") and value is None:
            out.append(raw.isNull() if op == "eq" else raw.isNotNull())
        elif op in SCALAR:
            out.append(SCALAR[op](c, literal(value, kind)))
        elif op in ("in", "notIn"):
            some = isinstance(value, list | tuple | set) and len(value) > 0
            inside = c.isin([literal(v, kind) for v in value]) if some else F.lit(False)
            out.append(inside if op == "in" else ~inside)
        elif op in ("like", "ilike"):
            if kind.label != "string":
                raise QueryError(f"{at}: {op} is for strings")
            out.append(c.like(value) if op == "like" else c.ilike(value))
        elif op == "isNull":
            out.append(raw.isNull() if value else raw.isNotNull())
        else:
            raise QueryError(f"{at}: unknown operator {op}; there are {[*SCALAR, 'in', 'notIn', 'like', 'ilike', 'isNull']}")
    return reduce(lambda a, b: a & b, out, F.lit(True)) if out else F.lit(True)


def listed(c: Expr, kind: Column, given: Any, at: str) -> Expr:
    """A condition on a list of scalars. Elements that are null equal nothing; of a null list all is unknown but isNull."""
    if given is None:
        return c.isNull()
    if isinstance(given, list | tuple) or not isinstance(given, Mapping):
        raise QueryError(f"{at}: a list is asked by {list(LIST_OPS)}, not by a value")
    one, out = Column(kind.kind), []
    known = lambda x: F.when(c.isNotNull(), F.coalesce(x, F.lit(False)))
    values = lambda v: F.array(*[literal(x, one) for x in v])
    for op, value in given.items():
        if value is UNSET:
            continue
        if op == "has":
            out.append(known(F.array_contains(c, literal(value, one))))
        elif op == "hasSome":
            out.append(known(F.arrays_overlap(c, values(value))) if value else F.lit(False))
        elif op == "hasEvery":
            out.append(F.when(c.isNotNull(), F.size(F.array_except(values(value), c)) == 0) if value else F.lit(True))
        elif op == "isEmpty":
            out.append((F.size(c) == 0) if value else (F.size(c) > 0))
        elif op == "some":
            out.append(known(F.exists(c, lambda e: scalar(e, one, value, f"{at}.some") if value else F.lit(True))))
        else:
            raise QueryError(f"{at}: unknown operator {op}; there are {list(LIST_OPS)}")
    return reduce(lambda a, b: a & b, out, F.lit(True))


def field_kind(table: Table, name: str) -> Column | None:
    """The scalar that a name stands for: a managed or scalar field, or the id of a reference."""
    if name in MANAGED:
        return _MANAGED[name]
    node = table.shape.get(name)
    if isinstance(node, Column):
        return node
    ref = table.shape.get(name[:-2]) if name.endswith("Id") else None
    return Column("text") if isinstance(ref, Reference) and not ref.many else None


class Where:
    """Applies conditions to rows of tables."""

    def __init__(self, registry: Registry) -> None:
        self.registry = registry

    def keep(self, df: DataFrame, table: Table, where: Mapping[str, Any] | None) -> DataFrame:
        """The rows of df for which the condition is true, with df's columns."""
        for part in self._conjuncts(where or {}):
            df = self._keep_one(df, table, *part)
        return df

    def _conjuncts(self, where: Mapping[str, Any]):
        if not isinstance(where, Mapping):
            raise QueryError(f"a condition is an object, not {where!r}")
        for key, given in where.items():
            if given is UNSET:
                continue
            if key == "and":
                for x in given or []:
                    yield from self._conjuncts(x)
            else:
                yield key, given

    def _keep_one(self, df: DataFrame, table: Table, key: str, given: Any) -> DataFrame:
        node = table.shape.get(key)
        if key not in ("or", "not") and isinstance(node, Owned | Reference) and given is not None:
            for wanted, keys, own in self._relation(table, key, node, given):
                df = df.join(keys, df[own] == keys["_key"], "left_semi" if wanted else "left_anti")
            return df
        columns = df.columns
        if table.partition and key == table.partition[0] and "_bucket" in columns:
            df = df.where(self._buckets(given, table))
        df, condition = self.condition(df, table, {key: given})
        return df if condition is None else df.where(condition).select(*columns)

    @staticmethod
    def _buckets(given: Any, table: Table) -> Expr:
        """What a condition on the time of a partitioned table says about its bucket, so that folders are pruned."""
        kind, span = table.shape[table.partition[0]], F.lit(seconds(table.partition[1]))
        start = lambda v: F.floor(F.unix_micros(literal(v, kind).cast("timestamp")) / F.lit(1_000_000) / span) * span
        given = given if isinstance(given, Mapping) else {"eq": given}
        out = F.lit(True)
        for op, value in given.items():
            if value is None or value is UNSET:
                continue
            if op in ("gt", "gte", "eq"):
                out &= F.col("_bucket") >= start(value)
            if op in ("lt", "lte", "eq"):
                out &= F.col("_bucket") <= start(value)
        return out

    def condition(self, df: DataFrame, table: Table, where: Mapping[str, Any]) -> tuple[DataFrame, Expr | None]:
        """df with marker columns, and the condition over them; None if there is none."""
        parts = []
        for key, given in where.items():
            if given is UNSET:
                continue
            node = table.shape.get(key)
            if key in ("and", "or"):
                found = []
                for x in given or []:
                    df, c = self.condition(df, table, x)
                    if c is not None:
                        found.append(c)
                if found:
                    parts.append(reduce((lambda a, b: a & b) if key == "and" else (lambda a, b: a | b), found))
            elif key == "not":
                df, c = self.condition(df, table, given or {})
                if c is not None:
                    parts.append(~c)
            elif kind := field_kind(table, key):
                parts.append((listed if kind.many else scalar)(F.col(key), kind, given, f"{table.name}.{key}"))
            elif isinstance(node, Owned | Reference):
                if given is None:
                    if isinstance(node, Reference) and not node.many:
                        parts.append(F.col(f"{key}Id").isNull())
                        continue
                    given = {"none": {}} if node.many else None
                    if given is None:
                        df, c = self._marked(df, True, *self._exists(table, key, node, {}))
                        parts.append(~c)
                        continue
                for wanted, keys, own in self._relation(table, key, node, given):
                    df, c = self._marked(df, wanted, keys, own)
                    parts.append(c)
            else:
                raise QueryError(f"{table.name} has no field {key}; there are {[*MANAGED, *table.shape]}")
        return df, reduce(lambda a, b: a & b, parts) if parts else None

    @staticmethod
    def _marked(df: DataFrame, wanted: bool, keys: DataFrame, own: str) -> tuple[DataFrame, Expr]:
        """Whether a row's field is among keys, as a condition inside others: never null, and planned as one join. The
        field gets a name that nothing below keys has, as names are looked for there first."""
        mark = f"_m{next(_marks)}"
        found = keys.where(F.col("_key") == F.col(mark).outer()).exists()
        return df.withColumn(mark, F.col(own)), found if wanted else ~found

    def _exists(self, table: Table, key: str, node: Owned | Reference, where: Mapping[str, Any], broken: bool = False) -> tuple[DataFrame, str]:
        """Keys of rows of table with a related row for which `where` holds (broken: is false), and whose field they are."""
        other = table.parts[key] if isinstance(node, Owned) else self.registry.target(table, key)
        rows = other.rows()
        if broken:
            rows, c = self.condition(rows, other, where)
            rows = rows.where(~c if c is not None else F.lit(False))
        else:
            rows = self.keep(rows, other, where)
        if isinstance(node, Owned):
            return rows.select(F.col("_parent").alias("_key")), "id"
        if not node.many:
            return rows.select(F.col("id").alias("_key")), f"{key}Id"
        rows, links = rows.select("id"), table.link_rows(key)
        return links.join(rows, links["target"] == rows["id"], "left_semi").select(F.col("owner").alias("_key")), "id"

    def _relation(self, table: Table, key: str, node: Owned | Reference, given: Any):
        """(wanted, keys, field) for each thing that must hold of a relationship."""
        if not isinstance(given, Mapping):
            raise QueryError(f"{table.name}.{key}: a relationship is asked by an object; its id is {key}Id")
        if not node.many:
            yield True, *self._exists(table, key, node, given)
            return
        for name, inner in given.items():
            if inner is UNSET:
                continue
            if name not in QUANTIFIERS:
                raise QueryError(f"{table.name}.{key}: unknown quantifier {name}; there are {list(QUANTIFIERS)}")
            yield name == "some", *self._exists(table, key, node, inner or {}, broken=name == "every")
