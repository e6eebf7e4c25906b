"""The corpus pipeline: stages that each write a table for the next one.

Every stage takes (spark, docs, sf_dir) and returns a table of documents' columns, but for the last, which adds `copy`
(or `copy_2`, `copy_3`, ..., the first name that is free).
Null and empty texts pass all stages but near_dedup, which takes them as copies of one another. Extra columns are kept.
"""

from __future__ import annotations

from itertools import chain, count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, lines, mixing, simhash, toxicity
from tessera.llm.common import held_out, kept, table
from tessera.ship import shipped


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5 stay. Learned from the labels of four fifths of the ids."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0)))
    scored = toxicity.score(docs, model)
    return scored.where("predicted = 0").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them hold; n_chars counts what stays."""
    cut = lines.drop_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))
    size = F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": text, "n_chars": size}
    return cut.select([new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents a twentieth of whose words, or more, lies in passages of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, with `copy` from 1."""
    mixed = mixing.mix(docs).where("copies > 0")
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in chain(["copy"], (f"copy_{i}" for i in count(2))) if n not in taken)
    return mixed.select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(name))


STAGES = [
    ("toxicity", shipped(drop_toxic)),
    ("line_dedup", shipped(drop_lines)),
    ("simhash", shipped(drop_near_duplicates)),
    ("decontaminate", shipped(drop_contaminated)),
    ("mix", shipped(mix)),
]
#: The classifier and the fingerprints are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
