"""The nineteen column types and their Spark types."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Kind:
    name: str
    sql: str
    spark: T.DataType
    label: str  # number, bigint, string, Date, boolean, unknown or Uint8Array


# Names, SQL spellings and labels of the types.
KINDS = {
    k.name: k
    for k in (
        Kind("int2", "smallint", T.ShortType(), "number"),
        Kind("int4", "integer", T.IntegerType(), "number"),
        Kind("int8", "bigint", T.LongType(), "bigint"),
        Kind("numeric", "numeric", T.DecimalType(38, 18), "number"),
        Kind("float4", "real", T.FloatType(), "number"),
        Kind("float8", "double precision", T.DoubleType(), "number"),
        Kind("text", "text", T.StringType(), "string"),
        Kind("varchar", "varchar", T.StringType(), "string"),
        Kind("bpchar", "char", T.StringType(), "string"),
        Kind("timestamptz", "timestamp with time zone", T.TimestampType(), "Date"),
        Kind("timestamp", "timestamp", T.TimestampNTZType(), "Date"),
        Kind("date", "date", T.DateType(), "Date"),
        Kind("time", "time", T.StringType(), "string"),
        Kind("interval", "interval", T.StringType(), "string"),
        Kind("bool", "boolean", T.BooleanType(), "boolean"),
        Kind("uuid", "uuid", T.StringType(), "string"),
        Kind("json", "json", T.StringType(), "unknown"),
        Kind("jsonb", "jsonb", T.StringType(), "unknown"),
        Kind("bytea", "bytea", T.BinaryType(), "Uint8Array"),
    )
}


def canonical_json(value: object) -> str:
    """JSON text with sorted keys and no blanks, so that equal values are equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
