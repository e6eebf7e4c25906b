"""The engine: entities bound to tables, with all reads in one place."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

from tessera.operators.aggregate import AggregateResult, Aggregator
from tessera.operators.reader import Reader
from tessera.schema import Entity
from tessera.sources.binding import Binding, Registry


class Engine(Reader):
    """find, find_one, find_many, paginate, count and aggregate over bound entities; every table stays lazy."""

    def __init__(self, spark: SparkSession) -> None:
        super().__init__(Registry())
        self.spark, self._aggregator = spark, Aggregator(self.registry)

    def bind(self, entity: Entity, binding: Binding) -> Engine:
        self.registry.bind(entity, binding)
        return self

    def aggregate(self, what: Entity | str, query: Mapping[str, Any] | None = None, before: Any = None, **parts: Any) -> AggregateResult:
        names = {"group_by": "groupBy", "order_by": "orderBy", "per_page": "perPage"}
        return self._aggregator.aggregate(what, {**(query or {}), **{names.get(k, k): v for k, v in parts.items()}}, before)
