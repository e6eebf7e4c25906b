"""Binding entities to physical tables.

A Table gives an entity's rows under canonical names: id, createdAt, updatedAt, the scalar fields, `<ref>Id` for each
single reference, and `_parent` for an owned part. Everything above works on those names only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.naming import child_table, key_column, snake
from tessera.schema import Column, Entity, Owned, Reference, resolve
from tessera.types import KINDS

Rows = Callable[[], DataFrame]


_schemas: dict[tuple, Any] = {}


def files(spark: SparkSession, path: str, form: str = "parquet", schema: Any = None, **options: Any) -> Rows:
    """Rows of parquet, ORC, CSV or JSON files, or any format that Spark reads. A schema that Spark has to look up in the
    files is looked up once for a path and the time of its last change."""

    def rows() -> DataFrame:
        reader = spark.read.format(form).options(**options)
        if schema or set(path) & set("*?[{"):
            return (reader.schema(schema) if schema else reader).load(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
        key = (form, path, tuple(sorted(options.items())), status.getModificationTime(), status.getLen())
        if key not in _schemas:
            found = reader.load(path)
            _schemas[key] = found.schema
            return found
        return reader.schema(_schemas[key]).load(path)

    return rows


def catalog_table(spark: SparkSession, name: str) -> Rows:
    return lambda: spark.table(name)


@dataclass
class Binding:
    """rows: the physical table. columns: field (also id, createdAt, updatedAt, <ref>Id) to column name or Spark column,
    where it isn't the field's name in snake case; None: the table has no such column. parent: column of a part's owner.
    parts: bindings of owned fields. links: for a list of references, rows with the owner's and the target's id."""

    rows: Rows
    columns: Mapping[str, Any] = field(default_factory=dict)
    parent: str | None = None
    parts: Mapping[str, Binding] = field(default_factory=dict)
    links: Mapping[str, tuple[Rows, str, str]] = field(default_factory=dict)


@dataclass
class Table:
    name: str
    shape: dict[str, Any]
    binding: Binding
    entity: str  # of the root
    parts: dict[str, Table] = field(default_factory=dict)
    partition: tuple[str, str] | None = None  # field and span, if the rows have `_bucket`

    def rows(self) -> DataFrame:
        df, b = self.binding.rows(), self.binding
        wanted = {"id": None, "createdAt": "timestamptz", "updatedAt": "timestamptz"}
        for name, node in self.shape.items():
            if isinstance(node, Column):
                wanted[name] = node.kind
            elif isinstance(node, Reference) and not node.many:
                wanted[f"{name}Id"] = None
        out, there = [], {c.lower() for c in df.columns}
        if self.partition:
            out.append(F.col("_bucket"))
        if b.parent:
            out.append(F.col(b.parent).alias("_parent"))
        for name, kind in wanted.items():
            column = b.columns.get(name, snake(name))
            if isinstance(column, str) and column.lower() in there:
                node = self.shape.get(name)
                value = F.col(f"`{column}`")
                if isinstance(node, Column) and node.many and node.required:
                    value = F.coalesce(value, F.array().cast(df.schema[column].dataType))
                out.append(value.alias(name))
            elif column is None or isinstance(column, str):
                if isinstance(column, str) and name not in ("createdAt", "updatedAt", "id") or name == "id" and not b.parent and column is not None:
                    raise QueryError(f"{self.name}: the table has no column {column} for {name}")
                out.append(F.lit(None).cast(KINDS[kind].spark if kind else "string").alias(name))
            else:
                out.append(column.alias(name))
        return df.select(*out)

    def link_rows(self, name: str) -> DataFrame:
        """(owner, target) of a list of references, each pair once."""
        rows, owner, target = self.binding.links[name]
        return rows().select(F.col(owner).alias("owner"), F.col(target).alias("target")).where("owner is not null and target is not null").distinct()


class Registry:
    """Entities with their tables."""

    def __init__(self) -> None:
        self.entities: dict[str, Entity] = {}
        self.tables: dict[str, Table] = {}

    def bind(self, entity: Entity, binding: Binding) -> None:
        def make(name: str, shape: dict, b: Binding) -> Table:
            table = Table(name, shape, b, entity.name)
            for f, node in shape.items():
                if isinstance(node, Owned):
                    if f not in b.parts:
                        raise QueryError(f"{name}.{f} is bound to no table")
                    table.parts[f] = make(node.table or child_table(name, f), node.shape, b.parts[f])
                elif isinstance(node, Reference) and node.many and f not in b.links:
                    raise QueryError(f"{name}.{f} has no table of links")
            return table

        self.entities[entity.name] = entity
        self.tables[entity.name] = make(snake(entity.name), resolve(entity.shape), binding)

    def table(self, entity: Entity | str) -> Table:
        name = entity if isinstance(entity, str) else entity.name
        if name not in self.tables:
            raise QueryError(f"{name} is no entity here; there are {sorted(self.tables)}")
        return self.tables[name]

    def target(self, table: Table, name: str) -> Table:
        return self.table(table.shape[name].name(table.entity))


def standard_binding(name: str, shape: Mapping[str, Any], rows_of: Callable[[str], Rows]) -> Binding:
    """The binding of a table in the engine's own store, by its naming rules."""
    parts, links = {}, {}
    for f, node in shape.items():
        if isinstance(node, Owned):
            child = node.table or child_table(name, f)
            parts[f] = standard_binding(child, node.shape, rows_of)
            parts[f].parent = key_column(name)
        elif isinstance(node, Reference) and node.many:
            links[f] = (rows_of(child_table(name, f)), "owner_id", "target_id")
    return Binding(rows_of(name), parts=parts, links=links)
