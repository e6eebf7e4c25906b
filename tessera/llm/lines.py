"""Line dedup over levelled, sorted runs of line hashes.

A run is a table of (key: 128-bit line hash, docs: rows of its batch that hold it), bucketed and sorted by key, so that
joins of runs and batches merge without a shuffle. Each batch is anti-joined with the runs there are: keys that none of
them has become a run of level 0, so that every key is in one run only; the other keys of the batch are repeats, a table
of the same form. When a level has `fanout` runs they are merged into one of the next level. The count of a key is that
of its run and of its repeats.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, ascii_lower, kept, packed, remove, shared_folder, small_side, text_key

#: Bytes of input whose line keys go to one bucket.
BUCKET_BYTES = 32 << 20


def line_keys(text: Column) -> Column:
    """The distinct hashes (32 hex digits) of the keys of a text's lines that have at least one character."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n")
    keys = F.array_distinct(F.transform(lines, lambda x: F.md5(F.btrim(x, F.lit(BLANKS)))))
    return F.array_remove(keys, hashlib.md5(b"").hexdigest())


class LineRuns:
    """The levelled runs of a corpus that comes in batches, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 3) -> None:
        """buckets: as many as a shuffle has partitions, if not given."""
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder, self.levels, self.repeats, self.staged = shared_folder(spark, "runs"), [[]], [], []

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        self.staged.append(name)
        # hashes don't get shorter, and each writer and reader of compressed files holds buffers outside the heap
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("compression", "none").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows as a table with the buckets of runs, so that its joins with them take no shuffle; until close()."""
        return self.spark.table(self._write(rows.coalesce(self.buckets)))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Adds a batch: (key, docs), a row for each key."""
        fresh = reduce(lambda rows, run: rows.join(run.select("key"), "key", "left_anti"), self.runs(), batch)
        run = self._write(fresh.select("key", "docs"))
        if self.runs():
            self.repeats.append(self._write(batch.join(self.spark.table(run).select("key"), "key", "left_anti").select("key", "docs")))
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            old, self.levels[level] = self.levels[level], []
            self.levels[level + 1].append(self._write(self._merged(old)))
            self._drop(old)
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        """The sums of tables by key, by full joins of their sorted buckets; a union would lose the buckets."""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            docs = F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            return a.join(b.select("key", F.col("docs").alias("more")), "key", "full").select("key", docs.alias("docs"))

        return reduce(merge, map(self.spark.table, names))

    def counts(self) -> DataFrame:
        """(key, docs) over all batches, a row for each key: what its one run has, and its repeats."""
        if not self.repeats:
            return reduce(DataFrame.union, self.runs())
        more = self._merged(self.repeats).withColumnRenamed("docs", "more")
        return reduce(DataFrame.union, [run.join(more, "key", "left").select("key", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs")) for run in self.runs()])

    def close(self) -> None:
        self._drop(self.staged)
        remove(self.spark, self.folder)
        self.levels, self.repeats, self.staged = [[]], [], []


def _buckets(docs: DataFrame) -> int:
    """One for BUCKET_BYTES of the tables that docs is read from, within the number of partitions that shuffles have."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(8, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES))


def frequent(docs: DataFrame, at_least: int = 10, batches: int = 4, text_col: str = "text") -> DataFrame:
    """(key): hex hashes of the line keys that at least so many rows of docs hold. A document is a row: one that repeats
    counts again, whatever its id. The rows come in `batches` parts, by a hash of the text."""
    keys = docs.select(F.pmod(F.xxhash64(text_col), F.lit(batches)).alias("batch"), F.explode(line_keys(F.col(text_col))).alias("key"))
    keys = keys.groupBy(F.unhex("key").alias("key")).agg(*[F.count(F.when(F.col("batch") == i, 1)).alias(f"docs_{i}") for i in range(batches)])
    runs = LineRuns(docs.sparkSession, _buckets(docs))
    try:
        keys = runs.dealt(keys)
        for i in range(batches):
            runs.add(keys.where(F.col(f"docs_{i}") > 0).select("key", F.col(f"docs_{i}").alias("docs")))
        return kept(runs.counts().where(F.col("docs") >= at_least).select(F.lower(F.hex("key")).alias("key")), "frequent")
    finally:
        runs.close()


def _without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    """The texts without the lines whose key is among the hashes given."""
    out = []
    for text, drop in zip(texts, drops, strict=True):
        if drop is None:
            out.append((None, 0))
            continue
        gone, lines = set(drop), (text or "").split("\n")
        stay = [x for x in lines if hashlib.md5(x.encode("utf-8", "surrogatepass").strip().lower()).hexdigest() not in gone]
        out.append(("\n".join(stay), len(lines) - len(stay)))
    return pd.DataFrame(out, columns=["text", "dropped"])


def drop_lines(docs: DataFrame, at_least: int = 10, text_col: str = "text", keep: list[str] | None = None, **how) -> DataFrame:
    """(row: the columns `keep` of docs, or all, as a struct, n_lines, n_dropped, kept: the text without the lines that drop).

    A line's key is the line with white space [\\x20\\x09-\\x0D] stripped at both ends and A-Z in lower case. Lines whose
    key has a character and is found in `at_least` rows are dropped from every row; repeated rows and ids count as rows. Null and empty texts are one empty
    line; such lines are never dropped. A text all of whose lines drop becomes empty.
    """
    hot = small_side(frequent(docs, at_least, text_col=text_col, **how))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = text_key(text)
    held = docs.select(key.alias("k"), F.explode(line_keys(F.col(text_col))).alias("key")).join(hot, "key")
    drops = small_side(kept(held.groupBy("k").agg(F.collect_set("key").alias("drop")), "drops"))
    rows = docs.select(packed(keep), text.alias("text"), key.alias("key")).join(drops, F.col("key") == F.col("k"), "left")
    without = F.pandas_udf(_without, "text string, dropped long")
    cut = without(F.when(F.col("drop").isNotNull(), F.col("text")), "drop")
    rows = rows.select("row", "text", "drop", cut.alias("cut"))
    n = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.col("cut.dropped")).cast("long")
    return rows.select(
        "row",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        n.alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.col("cut.text")).alias("kept"),
    )
