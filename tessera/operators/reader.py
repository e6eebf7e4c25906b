"""Reading objects: filters, order, latest rows and nested results as one lazy DataFrame."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.plans.predicates import Where, field_kind
from tessera.schema import Column, Entity, Owned, Projection, Reference
from tessera.sources.binding import Registry, Table

FIND_CAP = 10_000
PER_PAGE = 20


@dataclass
class Page:
    docs: DataFrame
    docs_quantity: int
    page_quantity: int
    current_page: int


def ordered(c: Expr, direction: Any) -> Expr:
    """Nulls come last upwards and first downwards; anything but "desc" is upwards."""
    return c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last()


class Reader:
    def __init__(self, registry: Registry) -> None:
        self.registry, self.where = registry, Where(registry)

    # order ---------------------------------------------------------------------------------------------------------

    def _order(self, df: DataFrame, table: Table, order_by: Mapping[str, Any]) -> tuple[DataFrame, list[tuple[str, Any]]]:
        """df with a column for each key of the order, and their names with directions."""
        keys = []
        for i, (name, how) in enumerate(order_by.items()):
            if not isinstance(how, Mapping):
                kind = field_kind(table, name)
                node = table.shape.get(name)
                if kind is None and isinstance(node, Reference) and not node.many:
                    name, kind = f"{name}Id", Column("text")
                if kind is None or kind.many:
                    raise QueryError(f"{table.name}.{name} can't be ordered by")
                df = df.withColumn(f"_o{i}", F.col(name))
                keys.append((f"_o{i}", how))
                continue
            df, direction = self._nested_order(df, table, name, how, f"_o{i}")
            keys.append((f"_o{i}", direction))
        if "id" not in order_by and not keys:
            df = df.withColumn("_oc", F.col("createdAt"))
            keys.append(("_oc", "asc"))
        if "id" not in order_by:
            df = df.withColumn("_oid", F.col("id"))
            keys.append(("_oid", "asc"))
        return df, keys

    def _nested_order(self, df: DataFrame, table: Table, name: str, how: Any, to: str) -> tuple[DataFrame, Any]:
        node = table.shape.get(name)
        if not isinstance(node, Owned | Reference) or node.many:
            raise QueryError(f"{table.name}.{name}: an order goes through single references and parts only")
        if len(how) != 1:
            raise QueryError(f"{table.name}.{name}: an order has one branch")
        (inner, rest), = how.items()
        other = table.parts[name] if isinstance(node, Owned) else self.registry.target(table, name)
        rows, key = self._single(other.rows()) if isinstance(node, Owned) else other.rows(), "_parent" if isinstance(node, Owned) else "id"
        if isinstance(rest, Mapping):
            rows, direction = self._nested_order(rows, other, inner, rest, to)
        else:
            kind = field_kind(other, inner)
            if kind is None:
                raise QueryError(f"{other.name} has no field {inner}")
            rows, direction = rows.withColumn(to, F.col(inner)), rest
        rows = rows.select(F.col(key).alias(f"{to}k"), to)
        own = "id" if isinstance(node, Owned) else f"{name}Id"
        return df.join(rows, df[own] == rows[f"{to}k"], "left").drop(f"{to}k"), direction

    @staticmethod
    def _single(rows: DataFrame) -> DataFrame:
        """Of each owner's rows the first by createdAt and id."""
        first = Window.partitionBy("_parent").orderBy(F.col("createdAt").asc_nulls_last(), F.col("id").asc_nulls_last())
        return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")

    # shape ---------------------------------------------------------------------------------------------------------

    def _shaped(self, df: DataFrame, table: Table, expand: Any, select: Any, auto: bool = False, page: bool = False) -> tuple[DataFrame, list[str]]:
        """df with the nested columns joined on, and the columns of the result in order. page: df is a page, so that
        what is nested is first cut down to what it needs."""
        chosen = None if select is None or select is True else select
        if chosen is not None:
            for name in chosen:
                if field_kind(table, name) is None and name not in table.shape:
                    raise QueryError(f"{table.name} has no field {name} to select")
        expand = {} if expand is None or chosen is not None else expand
        for name in expand if isinstance(expand, Mapping) else ():
            if not isinstance(table.shape.get(name), Owned | Reference):
                raise QueryError(f"{table.name}.{name} can't be expanded")
        out = ["id"]
        for name, node in table.shape.items():
            asked = chosen is None or bool(chosen.get(name))
            if isinstance(node, Column):
                if asked:
                    out.append(name)
                continue
            sub = chosen.get(name) if chosen is not None else None
            if isinstance(node, Owned):
                if asked:
                    deeper = (expand.get(name) if isinstance(expand, Mapping) else None) if chosen is None else None
                    df = self._nest_part(df, table, name, node, deeper, sub, auto and chosen is None, page)
                    out.append(name)
                continue
            if not node.many and (chosen is None or chosen.get(f"{name}Id")):
                out.append(f"{name}Id")
            followed = bool(sub) if chosen is not None else auto or bool(isinstance(expand, Mapping) and expand.get(name))
            if followed:
                deeper = expand.get(name) if chosen is None and isinstance(expand, Mapping) else None
                df = self._nest_reference(df, table, name, node, None if deeper is True else deeper, sub, page)
                out.append(name)
        out += [c for c in ("createdAt", "updatedAt") if chosen is None or chosen.get(c)]
        return df, out

    @staticmethod
    def _of(rows: DataFrame, column: str, keys: DataFrame | None, key: str) -> DataFrame:
        """The rows whose column is among a key of a page; all if there is none."""
        if keys is None:
            return rows
        keys = keys.select(F.col(key).alias("_pk")).distinct()
        return rows.join(keys, rows[column] == keys["_pk"], "left_semi")

    def _objects(self, table: Table, expand: Any, select: Any, key: str, auto: bool = False, of: tuple[DataFrame | None, str] = (None, "")) -> DataFrame:
        """(_key, createdAt, id, object) of the rows of a table, or of those that a page needs."""
        rows = self._of(table.rows(), key, *of)
        rows, names = self._shaped(rows, table, expand, select, auto, of[0] is not None)
        return rows.select(F.col(key).alias("_key"), F.struct(F.col("createdAt").isNull().alias("n"), F.col("createdAt").alias("c"), F.col("id").alias("i"), F.struct(*names).alias("o")).alias("_x"))

    @staticmethod
    def _list(rows: DataFrame) -> DataFrame:
        sorted_ = F.sort_array(F.collect_list("_x"))
        # dealt out first: nothing is won by collecting lists ahead of the shuffle
        return rows.repartition(F.col("_key")).groupBy("_key").agg(F.transform(sorted_, lambda x: x["o"]).alias("_v"))

    def _attach(self, df: DataFrame, own: str, values: DataFrame, name: str, many: bool) -> DataFrame:
        values = values.select(F.col("_key").alias(f"_k_{name}"), F.col("_v").alias(name))
        kind = values.schema[name].dataType
        df = df.join(values, df[own] == values[f"_k_{name}"], "left").drop(f"_k_{name}")
        return df.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind))) if many else df

    def _nest_part(self, df: DataFrame, table: Table, name: str, node: Owned, expand: Any, select: Any, auto: bool, page: bool) -> DataFrame:
        rows = self._objects(table.parts[name], None if expand is True else expand, select, "_parent", auto, (df if page else None, "id"))
        values = self._list(rows) if node.many else rows.groupBy("_key").agg(F.min("_x").alias("m")).select("_key", F.col("m.o").alias("_v"))
        return self._attach(df, "id", values, name, node.many)

    def _nest_reference(self, df: DataFrame, table: Table, name: str, node: Reference, expand: Any, select: Any, page: bool) -> DataFrame:
        target = self.registry.target(table, name)
        if not node.many:
            cut = page and bool(target.parts or expand or select)  # a plain row is joined just as well without
            rows = self._objects(target, expand, select, "id", of=(df if cut else None, f"{name}Id"))
            return self._attach(df, f"{name}Id", rows.select("_key", F.col("_x.o").alias("_v")), name, False)
        links = self._of(table.link_rows(name), "owner", df if page else None, "id")
        rows = self._objects(target, expand, select, "id", of=(links if page else None, "target"))
        rows = links.join(rows, links["target"] == rows["_key"]).select(F.col("owner").alias("_key"), "_x")
        return self._attach(df, "id", self._list(rows), name, True)

    # reads ---------------------------------------------------------------------------------------------------------

    def _latest_names(self, table: Table, latest_per: Any) -> list[str]:
        out = []
        for name in [latest_per] if isinstance(latest_per, str) else latest_per:
            node = table.shape.get(name)
            name = f"{name}Id" if isinstance(node, Reference) and not node.many else name
            kind = field_kind(table, name)
            if kind is None or kind.many:
                raise QueryError(f"{table.name}.{name} can't be grouped by")
            out.append(name)
        if not out:
            raise QueryError("latestPer names no field")
        return out

    def find(self, what: Entity | Projection | str, where: Any = None, order_by: Mapping[str, Any] | bool | None = None, expand: Any = None, select: Any = None, latest_per: Any = None, limit: int | None = None, offset: int | None = None, before: Any = None, only: DataFrame | None = None) -> DataFrame:
        """Objects as rows. order_by=False: in any order, for callers that join or count and needn't pay for a sort; there
        are no pages then. before: a condition that holds ahead of all others, of a scope. only: a table of the ids (k)
        that are wanted."""
        unordered, order_by = order_by is False, order_by or {}
        if unordered and (limit is not None or offset):
            raise QueryError("a page needs an order")
        if isinstance(what, Projection):
            what, select = what.entity, what.select if select is None else select
        table = self.registry.table(what)
        rows = table.rows()
        rows = rows if only is None else rows.join(only, rows["id"] == only["k"], "left_semi")
        df = self.where.keep(self.where.keep(rows, table, before), table, where)
        df, keys = self._order(df, table, order_by)
        if latest_per:
            groups = self._latest_names(table, latest_per)
            first = Window.partitionBy(*groups).orderBy(*[ordered(F.col(c), how) for c, how in keys])
            df = df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
            df = df.withColumns({f"_g{i}": F.col(g) for i, g in enumerate(groups)})
            keys = [(f"_g{i}", order_by.get(g, "asc")) for i, g in enumerate(groups)] + keys
        order = [ordered(F.col(c), how) for c, how in keys]
        if limit is not None or offset:
            df = df.orderBy(*order)
            df = df.offset(offset) if offset else df
            df = df.limit(limit) if limit is not None else df
        df, names = self._shaped(df, table, None if expand == "auto" else expand, select, expand == "auto", limit is not None or only is not None)
        return (df if unordered else df.orderBy(*order)).select(*names)

    def count_rows(self, what: Entity | Projection | str, where: Any = None, latest_per: Any = None, before: Any = None) -> DataFrame:
        """One row: count. Under latest_per, of groups: a null single key is none, null parts of several keys are."""
        table = self.registry.table(what.entity if isinstance(what, Projection) else what)
        df = self.where.keep(self.where.keep(table.rows(), table, before), table, where)
        if not latest_per:
            return df.agg(F.count(F.lit(1)).alias("count"))
        names = self._latest_names(table, latest_per)
        return df.agg(F.count_distinct(F.col(names[0]) if len(names) == 1 else F.struct(*names)).alias("count"))

    def count(self, what: Any, where: Any = None, **how: Any) -> int:
        return self.count_rows(what, where, **how).first()[0]

    def find_one(self, what: Any, where: Any = None, **how: Any) -> dict | None:
        row = self.find(what, where, **(how | {"limit": 1})).first()
        return row.asDict(recursive=True) if row else None

    def find_many(self, what: Any, where: Any = None, limit: int | None = None, **how: Any) -> DataFrame:
        """Up to 10,000 objects if no limit is given, with a warning if there are more."""
        if limit is None:
            known = {k: v for k, v in how.items() if k in ("latest_per", "before")}
            if (n := self.count(what, where, **known)) > FIND_CAP:
                warnings.warn(f"{n} rows match and {FIND_CAP} are given; set a limit or paginate", stacklevel=2)
        return self.find(what, where, limit=FIND_CAP if limit is None else limit, **how)

    def paginate(self, what: Any, where: Any = None, page: int = 1, per_page: int = PER_PAGE, **how: Any) -> Page:
        """One page, from 1 on; there is one page at least."""
        page, per_page = max(1, int(page)), max(1, int(per_page))
        n = self.count(what, where, **{k: v for k, v in how.items() if k in ("latest_per", "before")})
        docs = self.find(what, where, limit=per_page, offset=(page - 1) * per_page, **how)
        return Page(docs, n, max(1, math.ceil(n / per_page)), page)
