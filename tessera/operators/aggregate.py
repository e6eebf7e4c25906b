"""Aggregation: groups, accumulators, arithmetic, conditions on results, pages and facets."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.operators.reader import PER_PAGE, ordered
from tessera.plans.paths import Paths
from tessera.plans.predicates import Where, scalar
from tessera.schema import Column, TimeBucket, seconds
from tessera.sources.binding import Registry

_ALIAS = re.compile(r"[A-Za-z0-9_.]+")
_NUMBER = Column("float8")
ARITHMETIC = {
    "div": lambda a, b: a / F.nullif(b, F.lit(0.0)),
    "mul": lambda a, b: a * b,
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
}


@dataclass
class AggregateResult:
    rows: DataFrame
    facets: dict[str, DataFrame] = field(default_factory=dict)


def bucket(at: Expr, span: str) -> Expr:
    """The start of the span since the epoch that a time is in, without a zone."""
    size = seconds(span)
    second = F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(1_000_000))
    return F.timestamp_seconds(F.floor(second / F.lit(size)) * F.lit(size)).cast("timestamp_ntz")


def _checked(alias: str) -> str:
    if not _ALIAS.fullmatch(alias):
        raise QueryError(f"{alias!r}: a name has letters, digits, _ and . only")
    return alias


class Aggregator:
    def __init__(self, registry: Registry) -> None:
        self.registry, self.where = registry, Where(registry)

    def aggregate(self, what: Any, query: Mapping[str, Any], before: Any = None) -> AggregateResult:
        """Runs an aggregate: where, unnest, groupBy, select, having, orderBy, page, perPage, facets.

        Facets are aggregates of their own over the same filtered rows; they don't take the query's unnest.
        """
        table = self.registry.table(what)
        base = self.where.keep(self.where.keep(table.rows(), table, before), table, query.get("where"))
        facets = {}
        for name, facet in (query.get("facets") or {}).items():
            own = {k: v for k, v in facet.items() if k != "limit"} | ({"perPage": facet["limit"]} if facet.get("limit") else {})
            facets[name] = self._one(self.where.keep(base, table, facet.get("where")), table, own)
        return AggregateResult(self._one(base, table, query), facets)

    def _one(self, base: DataFrame, table: Any, query: Mapping[str, Any]) -> DataFrame:
        select = query.get("select") or {}
        if not select:
            raise QueryError("select is empty")
        paths = Paths(self.registry, base, table, query.get("unnest"))
        groups = query.get("groupBy") or []
        groups = dict(groups) if isinstance(groups, Mapping) else {g: g for g in ([groups] if isinstance(groups, str) else groups)}
        keys: dict[str, Expr] = {}
        for alias, of in groups.items():
            if isinstance(of, Mapping) and "timeBucket" in of:
                of = TimeBucket(of["timeBucket"], of["interval"])
            keys[_checked(alias)] = bucket(paths.leaf(of.field)[0], of.span) if isinstance(of, TimeBucket) else paths.leaf(of)[0]
        found: dict[str, tuple[Expr, bool]] = {}
        for alias, of in select.items():
            if alias in keys:
                raise QueryError(f"{alias} is both a group and a result")
            if "agg" in of:
                found[_checked(alias)] = self._accumulator(paths, of)
        plain = {a: F.col(f"_a{i}") for i, a in enumerate(found)}
        inner: list[Expr] = []
        results: dict[str, Expr] = dict(plain)
        later = {}
        for alias, of in select.items():
            if "agg" not in of:
                later[_checked(alias)] = results[alias] = self._expression(paths, of, results, inner)
        columns = [c.alias(f"_a{i}") for i, (c, _) in enumerate(found.values())] + [c.alias(f"_i{i}") for i, c in enumerate(inner)]
        names = [f"_g{i}" for i in range(len(keys))]
        grouped = paths.df.groupBy(*[c.alias(n) for n, c in zip(names, keys.values(), strict=True)]) if keys else paths.df
        rows = grouped.agg(*columns) if columns else grouped.agg(F.count(F.lit(1)).alias("_none"))
        for alias, given in (query.get("having") or {}).items():
            if alias not in results:
                raise QueryError(f"having: {alias} is no result; there are {sorted(results)}")
            rows = rows.where(scalar(results[alias], _NUMBER, given, f"having.{alias}"))
        out = {a: F.col(n) for a, n in zip(keys, names, strict=True)}
        for alias in select:
            out[alias] = later[alias].cast("double") if alias in later else plain[alias].cast("double") if found[alias][1] else plain[alias]
        rows = rows.select(*[c.alias(a) for a, c in out.items()])
        order = query.get("orderBy") or {}
        for alias in order:
            if alias not in out:
                raise QueryError(f"orderBy: {alias} is no result; there are {sorted(out)}")
        if order:
            rows = rows.orderBy(*[ordered(F.col(f"`{a}`"), how) for a, how in order.items()])
        if query.get("page") is not None or query.get("perPage") is not None:
            size = max(1, math.floor(query.get("perPage") or PER_PAGE))
            rows = rows.offset((max(1, math.floor(query.get("page") or 1)) - 1) * size).limit(size)
        return rows

    def _accumulator(self, paths: Paths, of: Mapping[str, Any]) -> tuple[Expr, bool]:
        """The aggregate, and whether it is cast to double in the result."""
        kind = of["agg"]
        condition = paths.condition(of["where"]) if of.get("where") else None
        only = lambda c: c if condition is None else F.when(condition, c)
        if kind == "count":
            return F.count(only(F.lit(1))), True
        if "field" not in of:
            raise QueryError(f"{kind} needs a field")
        c, column, prefix = paths.leaf(of["field"])
        if kind in ("sum", "avg", "percentile", "histogram") and not column.numeric:
            raise QueryError(f"{kind}: {of['field']} is no number")
        if kind in ("sum", "avg", "min", "max"):
            return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[kind](only(c)), column.numeric
        if kind == "distinct":
            return F.count_distinct(only(c)), True
        if kind == "first":
            created = F.col(f"{prefix}createdAt")
            there = created.isNotNull() if condition is None else created.isNotNull() & condition
            return F.min_by(c, F.when(there, F.struct(created, F.col(f"{prefix}id"), c))), column.numeric
        if kind == "percentile":
            if not 0 < of["p"] < 1:
                raise QueryError("percentile: p is between 0 and 1")
            return F.percentile(only(c), F.lit(float(of["p"]))), True
        if kind == "histogram":
            bounds = of["bounds"]
            if not bounds or any(not math.isfinite(b) for b in bounds) or any(a >= b for a, b in zip(bounds, bounds[1:], strict=False)):
                raise QueryError("histogram: bounds are finite and ascend")
            inside = [c < bounds[0], *((c >= a) & (c < b) for a, b in zip(bounds, bounds[1:], strict=False)), c >= bounds[-1]]
            return F.array(*[F.count(only(F.when(x, 1))) for x in inside]), False
        raise QueryError(f"unknown accumulator {kind}")

    def _expression(self, paths: Paths, of: Any, results: Mapping[str, Expr], inner: list[Expr]) -> Expr:
        """Arithmetic on results so far, numbers, accumulators and arithmetic."""
        if isinstance(of, bool) or of is None:
            raise QueryError(f"{of!r} is no operand")
        if isinstance(of, int | float):
            return F.lit(float(of))
        if isinstance(of, str):
            if of not in results:
                raise QueryError(f"{of} is no result before this one")
            return results[of].cast("double")
        if "agg" in of:
            inner.append(self._accumulator(paths, of)[0])
            return F.col(f"_i{len(inner) - 1}").cast("double")
        if of.get("op") not in ARITHMETIC:
            raise QueryError(f"unknown operation {of.get('op')}")
        return ARITHMETIC[of["op"]](*(self._expression(paths, of[side], results, inner) for side in ("left", "right")))
