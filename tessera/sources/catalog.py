"""What there is: fields of bound tables, and counts and sizes of stored entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from tessera.engine import Engine
from tessera.operators.writer import Writer, table_schemas
from tessera.schema import resolve


def columns(engine: Engine, entity: str) -> dict[str, T.DataType]:
    """The columns of the physical table of an entity."""
    return {f.name: f.dataType for f in engine.registry.table(entity).binding.rows().schema}


@dataclass(frozen=True)
class Statistics:
    name: str
    objects: int
    fields: int
    bytes: int
    tables: int
    partitions: int


def statistics(writer: Writer) -> list[Statistics]:
    """For each stored entity, by name: objects, top-level fields, bytes and tables with its parts and links, partitions."""
    out, segments = [], writer.store.segments()
    for name, entity in sorted(writer.registry.entities.items()):
        table = writer.registry.tables[name].name
        names = list(table_schemas(table, resolve(entity.shape)))
        paths = [f"tables/{t}/{p}" for t in names for p in segments.get(t, [])]
        size = sum(writer.store._files.getContentSummary(writer.store._path(p)).getLength() for p in paths)
        buckets = {p.split("/")[0] for p in segments.get(table, []) if p.startswith("_bucket=")}
        out.append(Statistics(name, writer.store.frame(table).count(), len(entity.shape), size, len(names), len(buckets)))
    return out
