"""Everyday words for conditions, as a filter bar has them, turned into `where`."""

from __future__ import annotations

import datetime as dt
from typing import Any

from tessera.errors import QueryError
from tessera.operators.partitions import instant
from tessera.schema import Column

# The words for each kind of column.
TEXT = ("contains", "equals", "startsWith", "isEmpty")
NUMBER = ("equals", "notEquals", "gt", "gte", "lt", "lte", "isEmpty")
BOOLEAN = ("isTrue", "isFalse")
TIME = ("on", "before", "after", "isEmpty")
OTHER = ("equals", "isEmpty")


def words_for(kind: Column) -> tuple[str, ...]:
    """The words that go with a column; those of a list ask for any element."""
    if kind.kind in ("text", "varchar", "bpchar"):
        out = TEXT
    elif kind.numeric or kind.many and kind.label in ("number", "bigint"):
        out = NUMBER
    elif kind.kind == "bool":
        out = BOOLEAN
    else:
        out = TIME if kind.label == "Date" else OTHER
    return tuple(w for w in out if w != "isEmpty") if kind.many else out


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def condition(field: str, kind: Column, word: str, value: Any = None) -> dict[str, Any]:
    """The `where` of a word: text is compared whatever its case, `on` is a day in UTC."""
    if word not in words_for(kind):
        raise QueryError(f"{field}: {word} doesn't go with {kind.kind}; there are {list(words_for(kind))}")
    if word in ("on", "before", "after"):
        day = instant(value).replace(hour=0, minute=0, second=0, microsecond=0)
        given = lambda t: t if kind.kind == "timestamptz" else t.replace(tzinfo=None) if kind.kind == "timestamp" else t.date()
        next_day = day + dt.timedelta(days=1)
        ops = {"on": {"gte": given(day), "lt": given(next_day)}, "before": {"lt": given(day)}, "after": {"gte": given(next_day)}}[word]
    else:
        ops = {
            "contains": {"ilike": f"%{_escaped(str(value))}%"},
            "startsWith": {"ilike": f"{_escaped(str(value))}%"},
            "equals": {"eq": value},
            "notEquals": {"ne": value},
            "isTrue": {"eq": True},
            "isFalse": {"eq": False},
            "isEmpty": {"isNull": True},
        }.get(word, {word: value})
    return {field: {"some": ops} if kind.many else ops}
