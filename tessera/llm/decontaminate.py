"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is `window` consecutive words of a benchmark item (all words of a shorter item). Of each window of a text the
least hash of its k-word runs is kept as a fingerprint; two equal windows always have the same one, so joining the
fingerprints finds every text that shares a window. In the texts found so, each hit is placed and extended: the windows
that have the fingerprint are compared word by word, by a 128-bit hash, and the words that they cover are united.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, kept, let, small_side, text_key

#: Anything but words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, once A-Z are in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 7


def words(text: Column) -> Column:
    """The words of a text in lower case; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _shifted(of: Column, by: int) -> Column:
    return F.slice(of, by + 1, F.greatest(F.size(of) - by, F.lit(0)))


def _meet(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of the elements of two arrays side by side, as far as b goes."""
    return F.zip_with(F.slice(a, 1, F.size(b)), b, f)


def _least(of: Column, width: int) -> Column:
    """The least of each run of `width` elements, from runs of half the width."""

    def wider(m: Column, n: int) -> Column:
        by = min(n, width - n)
        return let(_meet(m, _shifted(m, by), lambda x, y: F.least(x, y)), lambda x: wider(x, n + by)) if by else m

    return let(of, lambda x: wider(x, 1))


def with_marks(of: Column, sizes: list[int], window: int, gram: int, body: Callable[[dict[int, Column]], Column]) -> Column:
    """body({size: the fingerprints of the windows of that size, by their place}) of an array of words.

    The hash of a run of words is made from that of the run without its last word. A window of `window` words has the
    least hash of its runs of `gram` words; a shorter one, of a short item, is a run of its own.
    """
    needed = {gram if n == window else n for n in sizes}

    def step(first: Column, run: Column, n: int, found: dict[int, Column]) -> Column:
        found = found | {n: run} if n in needed else found
        if n == max(needed):
            if window not in sizes:
                return body({n: found[n] for n in sizes})
            return let(_least(found[gram], window - gram + 1), lambda m: body({n: m if n == window else found[n] for n in sizes}))
        return let(_meet(run, _shifted(first, n), lambda a, b: F.xxhash64(a, b)), lambda x: step(first, x, n + 1, found))

    return let(F.transform(of, lambda x: F.xxhash64(x)), lambda x: step(x, x, 1, {}))


def _places(found: dict[int, Column]) -> Column:
    """(size, at, mark) of all windows."""
    each = lambda n: lambda x, i: F.struct(F.lit(n).alias("size"), (i + 1).alias("at"), x.alias("mark"))
    return F.flatten(F.array(*[F.transform(m, each(n)) for n, m in found.items()]))


def _distinct(found: dict[int, Column]) -> Column:
    """(size, mark) of all windows, each once."""
    each = lambda n: lambda x: F.struct(F.lit(n).alias("size"), x.alias("mark"))
    return F.flatten(F.array(*[F.transform(F.array_distinct(m), each(n)) for n, m in found.items()]))


def _whole(of: Column, at: Column, size: Column) -> Column:
    return F.md5(F.concat_ws(" ", F.slice(of, at, size)))


def _covered(spans: Column) -> Column:
    """Number of words in the union of spans (at, size)."""
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["at"] + x["size"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(acc["end"], x["at"]))).alias("n"),
    )
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"].cast("long")


def hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """For each text of docs in which a window occurs: key (text_key of the text), n_hit (words inside occurrences),
    item_ids (of the items with such windows, as strings, sorted).

    Items without words have no window. A null item id is never listed, but its windows count. Equal texts are one row.
    """
    item = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    item = kept(item.withColumn("size", F.least(F.size("w"), F.lit(window))), "items")
    sizes = sorted(r[0] for r in item.select("size").distinct().collect())  # `window` rows at most
    spark = docs.sparkSession
    if not sizes:
        return spark.createDataFrame([], "key binary, n_hit long, item_ids array<string>")
    known = item.select("item", "w", "size", F.explode(with_marks(F.col("w"), sizes, window, gram, _places)).alias("x")).where("x.size = size")
    known = kept(known.select("item", "x.size", "x.mark", _whole(F.col("w"), F.col("x.at"), F.col("x.size")).alias("whole")).distinct(), "windows")
    prints = small_side(kept(known.select("size", "mark").distinct(), "marks"))
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))

    found = texts.select("key", F.explode(with_marks(words(F.col("text")), sizes, window, gram, _distinct)).alias("x"))
    found = kept(found.select("key", "x.size", "x.mark").join(prints, ["size", "mark"]).select("key").distinct(), "found")

    # the places of the hits, and the windows there
    near = texts.join(small_side(found), "key")
    hit = near.select("key", F.explode(with_marks(words(F.col("text")), sizes, window, gram, _places)).alias("x"))
    hit = hit.select("key", "x.size", "x.at", "x.mark").join(prints, ["size", "mark"])
    hit = kept(hit.groupBy("key").agg(F.collect_set(F.struct("size", "at", "mark")).alias("x")), "places")
    near = texts.join(small_side(hit), "key").select("key", words(F.col("text")).alias("w"), "x").dropDuplicates(["key"])
    near = near.select("key", let(F.col("w"), lambda w: F.transform("x", lambda x: F.struct(x["size"].alias("size"), x["at"].alias("at"), x["mark"].alias("mark"), _whole(w, x["at"], x["size"]).alias("whole")))).alias("x"))
    near = near.select("key", F.explode("x").alias("x")).select("key", "x.*")
    whole = small_side(kept(known.select("size", "mark", "whole").distinct(), "wholes"))
    spans = kept(near.join(whole, ["size", "mark", "whole"]).select("key", "at", "size", "whole"), "spans")
    counted = spans.groupBy("key").agg(_covered(F.collect_list(F.struct("at", "size"))).alias("n_hit"))
    listed = spans.select("key", "size", "whole").distinct().join(known.where("item is not null").select("size", "whole", "item").distinct(), ["size", "whole"])
    listed = listed.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    none = F.array().cast("array<string>")
    return counted.join(listed, "key", "left").select("key", "n_hit", F.coalesce("item_ids", none).alias("item_ids"))


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """For every row of docs: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined; of the
    empty string if there are none), contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    A null or empty text has no words. Repeated rows stay, each with its result. Other columns are left out.
    """
    found = kept(hits(docs, items, text_col=text_col, **how), "hits")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.join(small_side(found), "key", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that aren't contaminated, all columns as they are; null texts stay."""
    packed = docs.select(F.struct("*").alias("row"), text_key(F.col(text_col)).alias("key"), F.size(words(F.col(text_col))).alias("n_words"))
    found = kept(hits(docs, items, text_col=text_col, **how).select(F.col("key").alias("k"), "n_hit"), "hits")
    bad = (F.col("key") == F.col("k")) & (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return packed.join(small_side(found), bad, "left_anti").select("row.*")
