"""Time partitions: buckets of a timestamp, late rows and expiry."""

from __future__ import annotations

import datetime as dt
import warnings
from typing import Any

from pyspark.sql import Column as Expr
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.schema import Entity, seconds

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def instant(value: Any) -> dt.datetime:
    """A time as given on a write, in UTC."""
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            raise QueryError(f"{value!r} is no time") from None
    if not isinstance(value, dt.datetime):
        raise QueryError(f"{value!r} is no time")
    return value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)


def bucket_of(at: dt.datetime, span: str) -> int:
    """Start of the bucket of a time, in seconds since the epoch."""
    size = seconds(span)
    return (at - EPOCH) // dt.timedelta(seconds=1) // size * size


def start_of(at: Expr, span: str) -> Expr:
    """bucket_of() of a column of times."""
    return (F.floor(at.cast("long") / seconds(span)) * seconds(span)).cast("long")


def expired(start: int, span: str, retention: str, now: dt.datetime) -> bool:
    """Whether the whole bucket is older than the retention."""
    return start + seconds(span) <= (now - EPOCH).total_seconds() - seconds(retention)


def admitted(entity: Entity, inputs: list[dict], now: dt.datetime, single: bool) -> list[dict]:
    """The inputs without those whose bucket has expired; a single one is an error, of several there is a warning."""
    if not entity.partition_by:
        return inputs
    name, span, out = entity.partition_by.field, entity.partition_by.span, []
    for x in inputs:
        late = entity.retention and expired(bucket_of(instant(x.get(name)), span), span, entity.retention, now)
        if late and single:
            raise QueryError(f"{entity.name}.{name}: {x[name]} is beyond the retention of {entity.retention}")
        if not late:
            out.append(x)
    if len(out) < len(inputs):
        warnings.warn(f"{len(inputs) - len(out)} rows of {entity.name} are beyond the retention and left out", stacklevel=3)
    return out
