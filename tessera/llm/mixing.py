"""Mixing sources to target weights by systematic sampling.

All documents of a source are expected in the mix equally often: its target divided by its size. These expected copies
are summed up along the source, one offset is added, and a document is emitted once for each whole number that the sum
crosses at it. The documents are summed in the order of their sizes, so that every part of the order, and with it the
number of words, is sampled evenly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import kept, packed, small_side, word_count

WEIGHTS = (5, 2, 1)
#: Share of all words in the mix, in percent, and the most copies of a source or document.
SHARE = 150
MOST = 2
#: Documents of a source, of one of eight steps to a doubling of size, that are ranked in one task, about.
RANKED = 4096
#: What the random offsets are drawn from.
SEED = 7


def offset_of(source: Column, seed: int) -> Column:
    """The random offset of a source, from 0 to below 1: drawn by a seed and its name, so that reruns agree."""
    name = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows, and for each of some sums that over all rows ahead in a total order. The rows are dealt out by ranges; only
    a row for each range comes together."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges, ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    starts = starts.select("_range", *[F.coalesce(F.sum(f"_{k}").over(ranges), F.lit(0)).alias(f"_{k}") for k in sums])
    both = dealt.join(F.broadcast(starts), "_range")
    return both.select(*rows.columns, *[(F.col(f"_{k}") + F.coalesce(F.sum(c).over(ahead), F.lit(0))).alias(k) for k, c in sums.items()])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of a table of sources (source, size).

    Sources by code point, null last, take the weights in turn. `share` percent of all words is dealt by weight; what a
    source gets beyond `most` times its size is dealt again to the others. In closed form: in the order of size by
    weight the first k sources are filled up, for the k from which on none is above. There may be any number of sources.
    """
    dealt = running(sizes.select("source", "size"), [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    dealt = dealt.select("source", "size", weight.alias("weight"))
    dealt = running(dealt, [F.col("size") / F.col("weight"), F.col("source").asc_nulls_last()], {"full": F.col("size"), "gone": F.col("weight")})
    total, whole = dealt.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    dealt = dealt.select("*", (F.lit(total * share / 100) - F.col("full") * most).alias("left"), (F.lit(whole) - F.col("gone")).alias("rest"))
    above = F.col("size") * most * F.col("rest") <= F.col("left") * F.col("weight")
    # of the sources that aren't filled up, the first has the most weight left
    left, rest = dealt.where(~above).agg(F.max_by("left", "rest"), F.max("rest")).first()
    target = F.when(above, F.col("size") * F.lit(float(most))).otherwise(F.lit(left).cast("double") * F.col("weight") / F.lit(rest))
    return dealt.select("source", F.col("size").alias("source_size"), target.alias("target"))


def mix(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, **how) -> DataFrame:
    """(row: the columns `keep` of docs, or all, as a struct, size, source_size, target, copies) of every row.

    A null or blank text has size 0; a source of size 0 has target 0 and gives nothing. The null source is one source.
    Each source has one random offset, drawn by the seed. Ties of size go by a hash of the id; repeated rows are emitted
    each for itself.
    """
    rows = docs.select(packed(keep), F.col(source_col).alias("source"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"))
    rows = rows if keep is None else kept(rows, "sizes")  # texts are read once; with whole rows, a second time
    bits = F.length(F.bin("size"))
    step = bits * 8 + F.expr("shiftright(size * 8, length(bin(size)) - 1)").cast("int") % 8
    rows = rows.withColumns({"step": step, "tie": F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))})
    steps = kept(rows.groupBy("source", "step").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "steps")
    totals = kept(targets(steps.groupBy("source").agg(F.sum("words").alias("size")), **how), "targets")
    # a step of a source is cut into parts by the hash that settles ties; equal ids are in one part
    cuts = steps.select("source", "step", F.ceil(F.col("n") / RANKED).alias("parts"))
    same = lambda a, b, *names: reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])
    rows = rows.alias("r").join(small_side(cuts).alias("c"), same("r", "c", "source", "step"))
    part = F.floor(F.conv(F.substring("tie", 1, 8), 16, 10).cast("double") * F.col("parts") / float(1 << 32)).cast("long")
    rows = rows.select("row", "r.source", "size", "tie", "r.step", part.alias("part"))
    boxes = kept(rows.groupBy("source", "step", "part").agg(F.count("*").alias("n")), "boxes")
    before = Window.partitionBy("source", "step").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    starts = boxes.select("source", "step", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    steps = steps.select("source", "step", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("from"))
    facts = steps.alias("s").join(small_side(totals).alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    facts = facts.select("s.source", "step", "from", "source_size", "target")
    facts = starts.alias("b").join(facts.alias("s"), same("b", "s", "source", "step"))
    facts = kept(facts.select("b.source", "b.step", "part", (F.col("at") + F.col("from")).alias("start"), "source_size", "target"), "starts")
    rows = rows.alias("r").join(small_side(facts).alias("f"), same("r", "f", "source", "step", "part"))
    rows = rows.select("row", "size", "tie", "r.source", "r.step", "r.part", "start", "source_size", "target")
    within = Window.partitionBy("source", "step", "part").orderBy("size", "tie")
    at = (F.col("start") + F.row_number().over(within) - 1).cast("double")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.select("row", "size", "source_size", "target", at.alias("at"), each.alias("each"), offset_of(F.col("source"), seed).alias("offset"))
    crossed = F.floor((F.col("at") + 1) * F.col("each") + F.col("offset")) - F.floor(F.col("at") * F.col("each") + F.col("offset"))
    return rows.select("row", "size", "source_size", "target", F.least(crossed, F.ceil("each")).cast("long").alias("copies"))
