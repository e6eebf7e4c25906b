"""The words of the query language: accumulators, arithmetic and write operations, as plain objects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from tessera.schema import time_bucket

__all__ = ["add", "avg", "count", "distinct", "div", "first", "histogram", "inc", "max_", "min_", "mul", "percentile", "set_on_insert", "sub", "sum_", "time_bucket"]


def _accumulator(name: str, field: str | None = None, where: Mapping[str, Any] | None = None, **more: Any) -> dict[str, Any]:
    out: dict[str, Any] = {"agg": name}
    if field is not None:
        out["field"] = field
    if where is not None:
        out["where"] = where
    return out | more


def count(where: Mapping[str, Any] | None = None) -> dict[str, Any]:
    return _accumulator("count", where=where)


def sum_(field: str, where: Mapping[str, Any] | None = None) -> dict[str, Any]:
    return _accumulator("sum", field, where)


def avg(field: str, where: Mapping[str, Any] | None = None) -> dict[str, Any]:
    return _accumulator("avg", field, where)


def distinct(field: str, where: Mapping[str, Any] | None = None) -> dict[str, Any]:
    return _accumulator("distinct", field, where)


def first(field: str, where: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The value of the row that was created first."""
    return _accumulator("first", field, where)


def percentile(field: str, p: float, where: Mapping[str, Any] | None = None) -> dict[str, Any]:
    return _accumulator("percentile", field, where, p=p)


def histogram(field: str, bounds: Sequence[float], where: Mapping[str, Any] | None = None) -> dict[str, Any]:
    return _accumulator("histogram", field, where, bounds=list(bounds))


def max_(value: Any, where: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Of a field in an aggregate; of a value in accumulate()."""
    return _accumulator("max", value, where) if isinstance(value, str) else {"op": "max", "value": value}


def min_(value: Any, where: Mapping[str, Any] | None = None) -> dict[str, Any]:
    return _accumulator("min", value, where) if isinstance(value, str) else {"op": "min", "value": value}


def inc(n: float = 1) -> dict[str, Any]:
    return {"op": "inc", "value": n}


def set_on_insert(value: Any) -> dict[str, Any]:
    return {"op": "setOnInsert", "value": value}


def div(left: Any, right: Any) -> dict[str, Any]:
    """Null if right is zero."""
    return {"op": "div", "left": left, "right": right}


def mul(left: Any, right: Any) -> dict[str, Any]:
    return {"op": "mul", "left": left, "right": right}


def add(left: Any, right: Any) -> dict[str, Any]:
    return {"op": "add", "left": left, "right": right}


def sub(left: Any, right: Any) -> dict[str, Any]:
    return {"op": "sub", "left": left, "right": right}
