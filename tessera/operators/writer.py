"""Writing objects: shredding into tables, updates, deletes and mergeable upserts, in transactions of the store."""

from __future__ import annotations

import datetime as dt
import os
import time
import warnings
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.engine import Engine
from tessera.errors import Forbidden, NotFound, QueryError, Referenced
from tessera.naming import child_table, key_column, snake
from tessera.operators.partitions import admitted, bucket_of, expired, instant, start_of
from tessera.schema import MISSING, Column, Entity, Owned, Reference, resolve, seconds
from tessera.sources.binding import standard_binding
from tessera.sources.store import Store
from tessera.types import KINDS, canonical_json

BULK_CAP = 100_000
_last = [0]


def new_id() -> str:
    """A UUID of version 7; those of one process ascend."""
    _last[0] = now = max(time.time_ns() // 1000, _last[0] + 1)
    number = (now // 1000) << 80 | 7 << 76 | (now % 1000 * 4) << 64 | 2 << 62 | int.from_bytes(os.urandom(8), "big") >> 2
    h = f"{number:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def table_schemas(name: str, shape: Mapping[str, Any], parent: str | None = None) -> dict[str, T.StructType]:
    """The physical tables of a shape: its own, those of its parts, and those of its links."""
    fields = [T.StructField("id", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]
    if parent:
        fields.append(T.StructField(key_column(parent), T.StringType()))
    out: dict[str, T.StructType] = {}
    for f, node in shape.items():
        if isinstance(node, Column):
            kind = KINDS[node.kind].spark
            fields.append(T.StructField(snake(f), T.ArrayType(kind) if node.many else kind))
        elif isinstance(node, Owned):
            out |= table_schemas(node.table or child_table(name, f), node.shape, name)
        elif node.many:
            out[child_table(name, f)] = T.StructType([T.StructField("owner_id", T.StringType()), T.StructField("target_id", T.StringType())])
        else:
            fields.append(T.StructField(f"{snake(f)}_id", T.StringType()))
    return {name: T.StructType(fields)} | out


class Writer(Engine):
    """An engine whose entities live in its own store. Inputs come from the caller; tables are changed set by set."""

    def __init__(self, spark, folder: str, clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc)) -> None:
        super().__init__(spark)
        self.store, self.clock = Store(spark, folder), clock

    def define(self, *entities: Entity) -> Writer:
        for entity in entities:
            shape, name = resolve(entity.shape), snake(entity.name)
            for table, schema in table_schemas(name, shape).items():
                if table == name and entity.partition_by:
                    schema = T.StructType([*schema.fields, T.StructField("_bucket", T.LongType())])
                self.store.declare(table, schema)
            self.bind(entity, standard_binding(name, shape, lambda t: lambda: self.store.frame(t)))
            if entity.partition_by:
                self.registry.tables[entity.name].partition = (entity.partition_by.field, entity.partition_by.span)
        return self

    def transaction(self):
        return self.store.transaction()

    # shredding -----------------------------------------------------------------------------------------------------

    def _value(self, node: Column, value: Any, at: str) -> Any:
        if value is None or node.label == "unknown":
            return None if value is None else canonical_json(value)
        if node.many:
            if not isinstance(value, list | tuple):
                raise QueryError(f"{at}: a list is needed")
            return [self._value(Column(node.kind), v, at) for v in value]
        if node.kind in ("timestamptz", "timestamp"):
            t = instant(value)
            return t if node.kind == "timestamptz" else t.replace(tzinfo=None)
        if node.kind == "date" and isinstance(value, str):
            return dt.date.fromisoformat(value)
        if node.kind == "numeric":
            return Decimal(str(value))
        return float(value) if node.kind in ("float4", "float8") and isinstance(value, int) else value

    def _shred(self, name: str, shape: Mapping[str, Any], entity: str, x: Mapping[str, Any], row: dict, rows: dict, insert: bool, at: str) -> None:
        """Puts an input's columns into row, and what hangs on it into rows (table to list)."""
        known = {"id", "createdAt", "updatedAt", *shape}
        known |= {f"{f}Id" if not n.many else f"{f[:-1] if f.endswith('s') else f}Ids" for f, n in shape.items() if isinstance(n, Reference)} | {f"{f}Ids" for f, n in shape.items() if isinstance(n, Reference) and n.many}
        if unknown := set(x) - known:
            raise QueryError(f"{at} has no field {sorted(unknown)[0]}")
        ident = lambda v: v.get("id") if isinstance(v, Mapping) else v
        for f, node in shape.items():
            if isinstance(node, Column):
                if f in x or insert:
                    given = x.get(f)
                    if f not in x and node.standard is not MISSING:
                        given = node.standard
                    if given is None and node.required:
                        raise QueryError(f"{at}.{f} is required")
                    row[snake(f)] = self._value(node, given, f"{at}.{f}")
            elif isinstance(node, Reference) and not node.many:
                if f"{f}Id" in x or f in x or insert:
                    target = x[f"{f}Id"] if f"{f}Id" in x else ident(x.get(f))
                    if target is None and node.required:
                        raise QueryError(f"{at}.{f} is required")
                    row[f"{snake(f)}_id"] = target
                    if target is not None:
                        rows["refs"].append((node.name(entity), target, f"{at}.{f}"))
            elif isinstance(node, Reference):
                key = next((k for k in (f"{f}Ids", f"{f[:-1] if f.endswith('s') else f}Ids") if k in x), None)
                given = x[key] if key else [ident(v) for v in x.get(f) or []]
                table = child_table(name, f)
                if key or f in x or insert:
                    rows["clear", table, "owner_id"].append(row["id"])
                    for target in dict.fromkeys(given or []):
                        rows["refs"].append((node.name(entity), target, f"{at}.{f}"))
                        rows["rows", table].append({"owner_id": row["id"], "target_id": target})
            elif f in x or insert:
                table, given = node.table or child_table(name, f), x.get(f)
                rows["clear", table, key_column(name)].append(row["id"])
                if node.many and given is not None and not isinstance(given, list | tuple):
                    raise QueryError(f"{at}.{f}: a list is needed")
                for y in (given or []) if node.many else ([given] if given is not None else []):
                    child = {"id": y.get("id") or new_id(), "created_at": row["_now"], "updated_at": row["_now"], key_column(name): row["id"], "_now": row["_now"]}
                    self._shred(table, node.shape, entity, y, child, rows, True, f"{at}.{f}")
                    rows["rows", table].append(child)

    def _frame(self, table: str, rows: Sequence[Mapping[str, Any]], columns: Sequence[str] | None = None) -> DataFrame:
        schema = self.store.schemas[table]
        schema = schema if columns is None else T.StructType([f for f in schema if f.name in columns])
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

    def _owners(self, table: str, keys: DataFrame, column: str) -> None:
        """Deletes the rows of a child or link table whose owner is among keys (k), and what hangs on them."""
        match = lambda rows: rows.join(keys, rows[column] == keys["k"], "left_semi")
        if not (files := self.store.touched(table, match)):
            return
        old = self.store.frame(table, files)
        if "id" in old.columns:
            gone = match(old).select(F.col("id").alias("k"))
            for child, schema in self.store.schemas.items():
                if child.startswith(f"{table}__") and "__" not in child[len(table) + 2 :]:
                    self._owners(child, gone, key_column(table) if key_column(table) in schema.names else "owner_id")
        self.store.rewrite(table, files, old.join(keys, old[column] == keys["k"], "left_anti"))

    def _keys(self, ids: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "k string")

    def _put(self, entity: Entity, inputs: Sequence[Mapping[str, Any]], check: Any, merge: bool) -> list[str]:
        """Inserts inputs; with merge, those whose id is there are updated in the columns they have."""
        if len(inputs) > BULK_CAP:
            raise QueryError(f"{len(inputs)} inputs; the most is {BULK_CAP}")
        table = self.registry.table(entity)
        name, now = table.name, self.clock()
        rows: dict = defaultdict(list)
        ids, made, changed = [], [], []
        there: set = set()
        given = [x["id"] for x in inputs if x.get("id") is not None]
        if merge and given:
            old = self.store.frame(name)
            there = {r[0] for r in old.join(F.broadcast(self._keys(given)), old["id"] == F.col("k"), "left_semi").select("id").collect()}
        for x in inputs:
            insert = x.get("id") not in there
            row = {"id": x.get("id") or new_id(), "updated_at": now, "_now": now}
            if insert:
                row["created_at"] = now
            self._shred(name, table.shape, entity.name, x, row, rows, insert or merge == "save", entity.name)
            if not insert and merge == "save":  # only what was given is changed among the columns of the row itself
                fields = {snake(f) for f in x} | {f"{snake(f)}_id" for f, n in table.shape.items() if isinstance(n, Reference) and f in x}
                row = {k: v for k, v in row.items() if k in fields | {"id", "updated_at", "_now"}}
            if entity.partition_by and insert:
                row["_bucket"] = bucket_of(row[snake(entity.partition_by.field)], entity.partition_by.span)
            ids.append(row["id"])
            (made if insert else changed).append(row)
        with self.transaction():
            if changed:
                if entity.partition_by:
                    raise QueryError(f"{entity.name} is partitioned and only grows")
                self._update_rows(name, changed)
            if made:
                known = self._buckets(name)
                self.store.append(name, self._frame(name, made))
                self._expire(entity, name, known)
            for key in [k for k in rows if k[0] == "clear"]:
                if changed and rows[key]:
                    self._owners(key[1], self._keys(rows[key]), key[2])
            for key in [k for k in rows if k[0] == "rows"]:
                self.store.append(key[1], self._frame(key[1], rows[key]))
            self._check_refs(rows["refs"])
            self._check_unique(entity, table.name, table.shape, self._keys(ids))
            self._check_scope(entity, ids, check)
        return ids

    def _buckets(self, name: str) -> set[str]:
        return {p.split("/")[0] for p in self.store.segments().get(name, [])}

    def _expire(self, entity: Entity, name: str, known: set[str]) -> None:
        """Drops expired buckets, once rows have opened one that wasn't known."""
        if entity.retention and self._buckets(name) - known:
            span, keep = entity.partition_by.span, entity.retention
            self.store.keep_segments(name, lambda start: not expired(start, span, keep, self.clock()))

    def _update_rows(self, name: str, changed: list[dict]) -> None:
        columns = sorted({c for r in changed for c in r if c != "_now"} - {"id"})
        schema = self.store.schemas[name]
        flags = [T.StructField(f"has_{c}", T.BooleanType()) for c in columns]
        new = self.spark.createDataFrame(
            [(r["id"], *(r.get(c) for c in columns), *(c in r for c in columns)) for r in {r["id"]: r for r in changed}.values()],
            T.StructType([T.StructField("k", T.StringType()), *(T.StructField(f"new_{c}", schema[c].dataType) for c in columns), *flags]),
        )
        files = self.store.touched(name, lambda rows: rows.join(F.broadcast(new.select("k")), rows["id"] == F.col("k"), "left_semi"))
        old = self.store.frame(name, files)
        both = old.join(F.broadcast(new), old["id"] == new["k"], "left")  # BULK_CAP rows at most
        value = lambda c: F.when(F.coalesce(F.col(f"has_{c}"), F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)) if c in columns else F.col(c)
        self.store.rewrite(name, files, both.select(*[value(c).alias(c) for c in schema.names]))

    # checks --------------------------------------------------------------------------------------------------------

    def _check_refs(self, refs: list[tuple[str, str, str]]) -> None:
        by = defaultdict(dict)
        for target, ident, at in refs:
            by[target][ident] = at
        for target, wanted in by.items():
            found = self._keys(list(wanted)).join(self.store.frame(self.registry.table(target).name).select("id"), F.col("k") == F.col("id"), "left_anti").first()
            if found:
                raise QueryError(f"{wanted[found[0]]}: there is no {target} {found[0]}")

    def _check_unique(self, entity: Entity, name: str, shape: Mapping[str, Any], keys: DataFrame) -> None:
        """No other row may have the id or unique fields of the rows whose ids are among keys (k)."""
        column = lambda f: f"{snake(f)}_id" if isinstance(shape.get(f), Reference) else snake(f)
        groups = [["id"], *([snake(f)] for f, n in shape.items() if isinstance(n, Column) and n.is_unique), *([column(f) for f in g] for g in entity.unique)]
        rows = self.store.frame(name)
        for g in groups:
            if "_bucket" in rows.columns and g == ["id"]:
                continue
            full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in g])
            own = rows.join(keys, rows["id"] == keys["k"], "left_semi").where(full).select(*[F.col(c).alias(f"o_{c}") for c in g]).distinct()
            alike = rows.join(own, reduce(lambda a, b: a & b, [rows[c] == own[f"o_{c}"] for c in g]), "left_semi")
            if twice := alike.groupBy(*g).count().where("count > 1").first():
                raise QueryError(f"{entity.name}: {g} = {[twice[c] for c in g]} is there already")

    def _check_scope(self, entity: Entity, ids: Sequence[str], check: Any) -> None:
        """All of some rows must fulfil a condition as they are now."""
        if check and ids:
            rows = self.registry.table(entity).rows()
            rows = rows.join(F.broadcast(self._keys(list(set(ids)))), rows["id"] == F.col("k"), "left_semi")
            if self.where.keep(rows, self.registry.table(entity), check).count() != len(set(ids)):
                raise Forbidden(f"{entity.name}: a row would leave the scope")

    # tables of inputs ----------------------------------------------------------------------------------------------

    def load(self, entity: Entity, rows: DataFrame, check: Any = None) -> int:
        """Inserts a table of objects in one transaction, none of which goes through the driver: fields by name, `<ref>Id`
        (`<ref>Ids` for lists of references), parts as structs or arrays of structs. Returns how many there were.

        Rows need an id if the entity has parts or lists of references; else one is made. Parts get ids that follow from
        their owner's and their place. Fields that aren't there are null or have their default; unknown columns are an
        error. All checks of create() hold; of a partitioned entity late rows are left out, with a warning.
        """
        table, now = self.registry.table(entity), F.lit(self.clock())
        nested = any(isinstance(n, Owned) or isinstance(n, Reference) and n.many for n in table.shape.values())
        if "id" not in rows.columns:
            if nested:
                raise QueryError(f"{entity.name}: the rows need an id")
            rows = rows.withColumn("id", F.expr("uuid()"))
        rows = rows.withColumn("id", F.col("id").cast("string"))
        out: dict[str, DataFrame] = {}
        self._tables(table.name, table.shape, rows, now, None, out)
        with self.transaction():
            known, news = self._buckets(table.name), {}
            if entity.partition_by:
                at, span = snake(entity.partition_by.field), entity.partition_by.span
                own = out[table.name].withColumn("_bucket", start_of(F.col(at), span))
                if own.where(F.col("_bucket").isNull()).first():
                    raise QueryError(f"{entity.name}.{entity.partition_by.field} is required")
                if entity.retention:
                    late = F.col("_bucket") + seconds(span) <= now.cast("long") - seconds(entity.retention)
                    if n := own.where(late).count():
                        warnings.warn(f"{n} rows of {entity.name} are beyond the retention and left out", stacklevel=2)
                        own = own.where(~late)
                out[table.name] = own
            for name, frame in out.items():
                before = set(self.store.segments().get(name, []))
                self.store.append(name, frame)
                news[name] = self.store.frame(name, [p for p in self.store.segments()[name] if p not in before])
            self._expire(entity, table.name, known)
            self._check_loaded(entity, table.name, table.shape, news)
            keys = news[table.name].select(F.col("id").alias("k"))
            self._check_unique(entity, table.name, table.shape, keys)
            if check:
                stored = table.rows()
                stored = stored.join(keys, stored["id"] == keys["k"], "left_semi")
                if self.where.keep(stored, table, check).count() != keys.count():
                    raise Forbidden(f"{entity.name}: a row would leave the scope")
            return keys.count()

    def _tables(self, name: str, shape: Mapping[str, Any], rows: DataFrame, now: Expr, parent: str | None, out: dict[str, DataFrame]) -> None:
        """The frames of a shape's tables, from a table of its objects."""
        known = {"id", key_column(parent) if parent else "id"}
        schema = {f.name: f for f in self.store.schemas[name]}
        made = {"id": F.col("id"), "created_at": now, "updated_at": now} | ({key_column(parent): F.col(key_column(parent))} if parent else {})
        for f, node in shape.items():
            field = f"{f}Id" if isinstance(node, Reference) and not node.many else f"{f}Ids" if isinstance(node, Reference) else f
            known.add(field)
            there = field in rows.columns
            if isinstance(node, Column) or isinstance(node, Reference) and not node.many:
                column = snake(f) if isinstance(node, Column) else f"{snake(f)}_id"
                standard = node.standard if isinstance(node, Column) and node.standard is not MISSING else None
                value = F.col(f"`{field}`") if there else F.array() if standard == [] else F.lit(standard)
                made[column] = value.cast(schema[column].dataType)
            elif isinstance(node, Reference):
                if there:
                    out[child_table(name, f)] = rows.select(F.col("id").alias("owner_id"), F.explode(F.array_distinct(F.col(field).cast("array<string>"))).alias("target_id"))
            elif there:
                child = node.table or child_table(name, f)
                own = rows.select(F.col("id").alias("_o"), F.posexplode(f) if node.many else F.struct(F.lit(0).alias("pos"), F.col(f).alias("col")).alias("_s"))
                own = own.select("_o", "pos", "col") if node.many else own.select("_o", "_s.pos", "_s.col").where("col is not null")
                ident = F.regexp_replace(F.md5(F.concat_ws("/", F.lit(child), "_o", "pos")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
                own = own.select(ident.alias("id"), F.col("_o").alias(key_column(name)), "col.*")
                self._tables(child, node.shape, own, now, name, out)
        if unknown := set(rows.columns) - known:
            raise QueryError(f"{name} has no field {sorted(unknown)[0]}")
        out[name] = rows.select(*[v.alias(c) for c, v in made.items()])

    def _check_loaded(self, entity: Entity, name: str, shape: Mapping[str, Any], news: Mapping[str, DataFrame]) -> None:
        """What create() asks of each input, of the new rows of all tables."""
        for f, node in shape.items():
            if isinstance(node, Owned):
                if (child := node.table or child_table(name, f)) in news:
                    self._check_loaded(entity, child, node.shape, news)
                continue
            many = isinstance(node, Reference) and node.many
            column = "target_id" if many else f"{snake(f)}_id" if isinstance(node, Reference) else snake(f)
            rows = news.get(child_table(name, f)) if many else news[name]
            if not many and node.required and rows.where(F.col(column).isNull()).first():
                raise QueryError(f"{name}.{f} is required")
            if isinstance(node, Reference) and rows is not None:
                target = self.store.frame(self.registry.table(node.name(entity.name)).name).select(F.col("id").alias("_t"))
                lost = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_r")).distinct().join(target, F.col("_r") == F.col("_t"), "left_anti").first()
                if lost:
                    raise QueryError(f"{name}.{f}: there is no {node.name(entity.name)} {lost[0]}")

    # verbs ---------------------------------------------------------------------------------------------------------

    def _read(self, entity: Entity, ids: Sequence[str]) -> list[dict]:
        rows = {r["id"]: r.asDict(recursive=True) for r in self.find(entity, order_by=False, only=self._keys(ids)).collect()}
        return [rows[i] for i in ids if i in rows]

    def create(self, entity: Entity, x: Mapping[str, Any], check: Any = None) -> dict:
        inputs = admitted(entity, [dict(x)], self.clock(), True)
        return self._read(entity, self._put(entity, inputs, check, False))[0]

    def create_many(self, entity: Entity, inputs: Sequence[Mapping[str, Any]], check: Any = None) -> list[dict]:
        """All or none of the inputs, in their order; of a partitioned entity late rows are left out."""
        inputs = admitted(entity, [dict(x) for x in inputs], self.clock(), False)
        return self._read(entity, self._put(entity, inputs, check, False)) if inputs else []

    def save(self, entity: Entity, x: Mapping[str, Any], check: Any = None) -> dict:
        """Inserts, or updates the row of the same id in the columns given; parts and links become just what is given."""
        return self._read(entity, self._put(entity, [dict(x)], check, "save"))[0]

    def _matching(self, entity: Entity, where: Any, before: Any, **how: Any) -> list[str]:
        if not where:
            raise QueryError("a condition is needed")
        ids = [r[0] for r in self.find(entity, where, select={"id": True}, before=before, limit=how.pop("limit", BULK_CAP + 1), **how).collect()]
        if len(ids) > BULK_CAP:
            raise QueryError(f"over {BULK_CAP} rows match")
        return ids

    def update_one(self, entity: Entity, where: Any, patch: Mapping[str, Any], order_by: Any = None, check: Any = None, before: Any = None) -> dict:
        with self.transaction():
            ids = self._matching(entity, where, before, order_by=order_by, limit=1)
            if not ids:
                raise NotFound(f"no {entity.name} matches")
            self._put(entity, [{**patch, "id": ids[0]}], check, "patch")
            return self._read(entity, ids)[0]

    def update_many(self, entity: Entity, where: Any, patch: Mapping[str, Any], check: Any = None, before: Any = None) -> int:
        """All matching rows, in one transaction."""
        with self.transaction():
            ids = self._matching(entity, where, before)
            if ids:
                self._put(entity, [{**patch, "id": i} for i in ids], check, "patch")
            return len(ids)

    def delete_one(self, entity: Entity, where: Any, order_by: Any = None, before: Any = None) -> bool:
        with self.transaction():
            ids = self._matching(entity, where, before, order_by=order_by, limit=1)
            self._delete(entity, ids)
            return bool(ids)

    def delete_many(self, entity: Entity, where: Any, before: Any = None) -> int:
        """All matching rows, however many, in one transaction; their ids don't go through the driver."""
        if not where:
            raise QueryError("a condition is needed")
        with self.transaction():
            found = self.find(entity, where, order_by=False, select={"id": True}, before=before)
            with self.store.kept(found.select(F.col("id").alias("k"))) as keys:
                if n := keys.count():
                    self._delete_keys(entity, keys)
                return n

    def delete_all(self, entity: Entity) -> int:
        with self.transaction():
            rows = self.store.frame(self.registry.table(entity).name)
            n = rows.count()
            self._delete_keys(entity, rows.select(F.col("id").alias("k")))
            return n

    def _delete(self, entity: Entity, ids: Sequence[str]) -> None:
        if ids:
            self._delete_keys(entity, self._keys(ids))

    def _delete_keys(self, entity: Entity, keys: DataFrame) -> None:
        """Deletes rows, their parts and links; rows that others refer to can't go."""
        table = self.registry.table(entity)

        def refer(other: str, shape: Mapping[str, Any], name: str) -> None:
            for f, node in shape.items():
                if isinstance(node, Owned):
                    refer(other, node.shape, node.table or child_table(name, f))
                elif isinstance(node, Reference) and node.name(other) == entity.name:
                    if node.many:
                        self._owners(child_table(name, f), keys, "target_id")
                        continue
                    rows = self.store.frame(name)
                    found = rows.join(keys, rows[f"{snake(f)}_id"] == keys["k"], "left_semi")
                    if name == table.name:
                        found = found.join(keys, found["id"] == keys["k"], "left_anti")
                    elif name.startswith(f"{table.name}__"):
                        found = found.limit(0)
                    if found.first():
                        raise Referenced(f"{name}.{f} refers to rows of {entity.name} that would go")

        for other, t in self.registry.tables.items():
            refer(other, t.shape, t.name)
        for child, schema in self.store.schemas.items():
            if child.startswith(f"{table.name}__") and "__" not in child[len(table.name) + 2 :]:
                self._owners(child, keys, key_column(table.name) if key_column(table.name) in schema.names else "owner_id")
        if files := self.store.touched(table.name, lambda rows: rows.join(keys, rows["id"] == keys["k"], "left_semi")):
            old = self.store.frame(table.name, files)
            self.store.rewrite(table.name, files, old.join(keys, old["id"] == keys["k"], "left_anti"))

    # accumulate ----------------------------------------------------------------------------------------------------

    def accumulate(self, entity: Entity, key: Mapping[str, Any], ops: Mapping[str, Any], check: Any = None) -> dict:
        return self._read(entity, self.accumulate_many(entity, [(key, ops)], check))[0]

    def accumulate_many(self, entity: Entity, deltas: Sequence[tuple[Mapping[str, Any], Mapping[str, Any]]], check: Any = None) -> list[str]:
        """Upserts by a declared unique key: inc adds (null stays null), max and min keep the larger and smaller,
        setOnInsert counts for a new row only. Operations on key fields are ignored. Returns the ids of the keys in order.

        The deltas of a key are folded first, then merged with the files that have such keys in one join. A partitioned
        entity is accumulated by keys with its time; beyond the retention a new row is an error.
        """
        table = self.registry.table(entity)
        plain = lambda k: k[:-2] if k.endswith("Id") and isinstance(table.shape.get(k[:-2]), Reference) else k
        column = lambda f: f"{snake(f)}_id" if isinstance(table.shape.get(f), Reference) else snake(f)
        declared = [{f} for f, n in table.shape.items() if isinstance(n, Column) and n.is_unique] + [set(g) for g in entity.unique]
        declared = [{plain(f) for f in g} for g in declared]
        keys = sorted({plain(k) for k in deltas[0][0]})
        if set(keys) not in declared:
            raise QueryError(f"{entity.name}: {keys} is not declared as unique")
        ops, rows = {}, []
        for key, change in deltas:
            key = {plain(k): v for k, v in key.items()}
            if sorted(key) != keys or any(v is None for v in key.values()):
                raise QueryError(f"{entity.name}: every key has the fields {keys}")
            row = {column(k): self._value(table.shape[k], v, k) if isinstance(table.shape[k], Column) else v for k, v in key.items()}
            for f, how in change.items():
                f = plain(f)
                if f in keys:
                    continue
                node = table.shape.get(f)
                if not isinstance(node, Column | Reference) or node.many:
                    raise QueryError(f"{entity.name}.{f} can't be accumulated")
                how = {"op": "setOnInsert", "value": how} if not isinstance(how, Mapping) or "op" not in how else how
                if how["op"] not in ("inc", "max", "min", "setOnInsert"):
                    raise QueryError(f"unknown operation {how['op']}")
                if ops.setdefault(f, how["op"]) != how["op"]:
                    raise QueryError(f"{entity.name}.{f}: one operation a field")
                row[column(f)] = self._value(node, how["value"], f) if isinstance(node, Column) else how["value"]
            rows.append(row)
        schema = self.store.schemas[table.name]
        cols, key_cols = {column(f): op for f, op in ops.items()}, [column(k) for k in keys]
        fresh, first = {}, {}
        for i, row in enumerate(rows):
            key = tuple(row[c] for c in key_cols)
            fresh.setdefault(key, new_id())
            first.setdefault(key, i)
        kinds = [T.StructField("_seq", T.IntegerType()), T.StructField("_new", T.StringType()), *(schema[c] for c in [*key_cols, *cols])]
        delta = self.spark.createDataFrame([(i, fresh[tuple(r[c] for c in key_cols)], *(r.get(c) for c in [*key_cols, *cols])) for i, r in enumerate(rows)], T.StructType(kinds))
        with self.transaction():
            there = self._merge(entity, key_cols, cols, delta)
            by = {r["_seq"]: r["id"] for r in there.collect()}  # a row for each key of the call
            ids = [by[i] for i in first.values()]
            self._check_scope(entity, ids, check)
        return ids

    def accumulate_rows(self, entity: Entity, key: Sequence[str], ops: Mapping[str, str], deltas: DataFrame) -> None:
        """As accumulate_many, of a table of deltas: the key's fields and a value for each field of ops (field to the
        name of its operation). Nothing goes through the driver; setOnInsert takes the smallest value of a batch."""
        column = lambda f: f"{snake(f)}_id" if isinstance(self.registry.table(entity).shape.get(f), Reference) else snake(f)
        declared = [{f} for f, n in entity.shape.items() if isinstance(n, Column) and n.is_unique] + [set(g) for g in entity.unique]
        if set(key) not in declared:
            raise QueryError(f"{entity.name}: {sorted(key)} is not declared as unique")
        rows = deltas.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])).select(
            F.lit(0).alias("_seq"), F.expr("uuid()").alias("_new"), *[F.col(f).alias(column(f)) for f in [*key, *ops]]
        )
        with self.transaction():
            self._merge(entity, [column(k) for k in key], {column(f): op for f, op in ops.items()}, rows)

    def _merge(self, entity: Entity, key_cols: list[str], cols: Mapping[str, str], delta: DataFrame) -> DataFrame:
        """Folds deltas (_seq, _new: the id if the key is new, keys, values) and merges them with the table; returns
        (_seq: the first of a key, id)."""
        table = self.registry.table(entity)
        name, now, schema = table.name, self.clock(), self.store.schemas[table.name]
        fold = {"inc": F.sum, "max": F.max, "min": F.min, "setOnInsert": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col("_seq"), F.col(c))))}
        delta = delta.groupBy(*[F.col(c).cast(schema[c].dataType).alias(f"k_{c}") for c in key_cols]).agg(F.min("_seq").alias("_seq"), F.min("_new").alias("_new"), *[fold[op](c).alias(f"d_{c}") for c, op in cols.items()])
        on, own = [(c, f"k_{c}") for c in key_cols], lambda c: F.col(c)
        if entity.partition_by:
            at = snake(entity.partition_by.field)
            if at not in key_cols:
                raise QueryError(f"{entity.name} is partitioned; the key needs {entity.partition_by.field}")
            delta, own = delta.withColumn("k__bucket", start_of(F.col(f"k_{at}"), entity.partition_by.span)), lambda c: F.coalesce(F.col(c), F.col("k__bucket")) if c == "_bucket" else F.col(c)
            on.append(("_bucket", "k__bucket"))  # prunes folders
        match = lambda rows: reduce(lambda a, b: a & b, [rows[c] == delta[k] for c, k in on])
        files = self.store.touched(name, lambda rows: rows.join(delta, match(rows), "left_semi"))
        old = self.store.frame(name, files)
        both = old.join(delta, match(old), "full")
        missing, touched = F.col("id").isNull(), F.col("_new").isNotNull()
        if entity.retention:
            late = F.col("k__bucket") + seconds(entity.partition_by.span) <= F.lit(now).cast("long") - seconds(entity.retention)
            if found := both.where(missing & late).first():
                raise QueryError(f"{entity.name}.{entity.partition_by.field}: {found[f'k_{at}']} is beyond the retention of {entity.retention}")
        merge = {"inc": lambda a, d: a + d, "max": F.greatest, "min": F.least, "setOnInsert": lambda a, d: a}
        defaults = {snake(f): n.standard for f, n in table.shape.items() if isinstance(n, Column) and n.standard is not MISSING}

        def value(c: str):
            if c == "id":
                return F.coalesce(F.col("id"), F.col("_new"))
            if c in ("created_at", "updated_at"):
                return F.when(missing | (touched & F.lit(c == "updated_at")), F.lit(now)).otherwise(F.col(c))
            if c in key_cols:
                return F.coalesce(F.col(c), F.col(f"k_{c}"))
            if c in cols:
                d = F.col(f"d_{c}")
                return F.when(missing, d).when(touched & d.isNotNull(), merge[cols[c]](F.col(c), d)).otherwise(F.col(c))
            if c in defaults:
                given = defaults[c]
                return F.when(missing, (F.array() if given == [] else F.lit(given)).cast(schema[c].dataType)).otherwise(F.col(c))
            return own(c)

        known = self._buckets(name)
        self.store.rewrite(name, files, both.select(*[value(c).cast(schema[c].dataType).alias(c) for c in schema.names]))
        self._expire(entity, name, known)
        rows = self.store.frame(name)
        return rows.join(delta, match(rows)).select("_seq", "id")
