"""Extensions for streams: late rows by watermark, time buckets, and accumulation of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.writer import Writer
from tessera.schema import Entity, seconds


def bucket_counts(stream: DataFrame, at: str, span: str, late: str, keys: list[str] | None = None) -> DataFrame:
    """Rows in each bucket of time and key. Rows that come later than `late` after the latest are left out."""
    size = f"{seconds(span)} seconds"
    window = F.window(F.col(at).cast("timestamp"), size)
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, f"{seconds(late)} seconds")
    return rows.groupBy(window.alias("w"), *(keys or [])).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bucket"), *(keys or []), "n")


def accumulate_stream(writer: Writer, entity: Entity, key: list[str], ops: Mapping[str, str], deltas: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: deltas() makes rows of key fields and values of a batch, which are folded and upserted.

    ops: field to the name of its operation. A batch that is run again counts again, unless all operations are max or min.
    """

    def run(batch: DataFrame, _: int) -> None:
        writer.accumulate_rows(entity, key, ops, deltas(batch))

    return run
