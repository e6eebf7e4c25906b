"""Approximate nearest neighbours by a hash-prefix forest.

The vectors are dealt over blocks of bounded size. In each block every tree is a sorted array of bit strings, the sides of
random planes on which a vector lies. A query descends each tree by binary search to its longest prefix; then all trees
ascend together, a bit at a time, until they hold enough candidates, whose distances are computed exactly.

Blocks and chunks of queries are files in the shared folder, mapped where they are compared; a pair of them costs one
short row, so that no task holds more than one of each, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import give_back, kept, shared_folder
from tessera.llm.elias_fano import held, save

TREES = 256
BITS = 30
#: Vectors of a block and queries of a chunk, in the mean.
BLOCK = 16384
CHUNK = 256
#: Parts of the blocks that go to a task of their own, by all chunks, for each partition that shuffles have.
SPREAD = 4
#: A query ascends in a block of n vectors until it has RATE * n ** POWER candidates: 44 % of 2,000, 21 % of 16,384.
RATE = 6.3
POWER = 0.65


def takes_part(vector: Column) -> Column:
    """Whether a vector isn't null, empty or zero and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def planes(dim: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """The random planes (dim x trees * bits), the same for each block; as many as there are dimensions stand at right
    angles to each other, so that they tell more apart."""
    rng, n = np.random.default_rng(dim), trees * bits
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-n // dim))], axis=1)[:, :n].astype(np.float32)


def strings(vectors: np.ndarray, centre: np.ndarray, cut: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """The bit string of each vector in each tree (vector x tree), the sides of its planes `cut`."""
    vectors = vectors - centre
    vectors = (vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1e-300)).astype(np.float32)
    powers = (1 << np.arange(bits - 1, -1, -1)).astype(np.float64)
    out = np.zeros((len(vectors), trees), np.uint32)
    for at in range(0, len(vectors), 256):
        side = vectors[at : at + 256] @ cut > 0
        out[at : at + 256] = side.reshape(-1, trees, bits) @ powers
    return out


def _blocks(folder: str, trees: int, bits: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        """Saves one block: its vectors by id, the sorted strings of all trees and whose they are."""
        pdf = pdf.sort_values("id", kind="stable")
        vectors = np.stack(pdf["vector"].to_list()).astype(np.float64)
        centre = vectors.mean(axis=0)
        numbers = strings(vectors, centre, planes(vectors.shape[1], trees, bits), trees, bits)
        order = np.argsort(numbers, axis=0, kind="stable").astype(np.int32)
        own = {"ids": pdf["id"].to_numpy(np.int64), "times": pdf["times"].to_numpy(np.int64), "vectors": vectors, "centre": centre}
        block = pdf["block"].iloc[0]
        save(f"{folder}/{vectors.shape[1]}.{block}.block", own | {"sorted": np.take_along_axis(numbers, order, axis=0).T, "whose": order.T})
        give_back()
        return pd.DataFrame({"dim": [vectors.shape[1]], "block": [block]})

    return build


def _chunks(folder: str):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        """Saves one chunk of queries."""
        vectors = np.stack(pdf["vector"].to_list()).astype(np.float64)
        chunk = pdf["chunk"].iloc[0]
        save(f"{folder}/{vectors.shape[1]}.{chunk}.chunk", {c: pdf[c].to_numpy(np.int64) for c in ("id", "query", "times")} | {"vectors": vectors})
        return pd.DataFrame({"dim": [vectors.shape[1]], "chunk": [chunk]})

    return build


def candidates(flat: np.ndarray, whose: np.ndarray, numbers: np.ndarray, want: int, bits: int) -> Iterator[np.ndarray]:
    """For each query (numbers: query x tree) the places in the block of its candidates; flat, whose: tree x vector."""
    trees, n = flat.shape
    low, high = (np.empty((bits + 1, len(numbers), trees), np.int32) for _ in range(2))
    for t in range(trees):
        for level in range(bits + 1):  # the length of the common prefix
            shift = bits - level
            start = numbers[:, t].astype(np.int64) >> shift << shift
            low[level, :, t] = np.searchsorted(flat[t], start.astype(np.uint32))
            high[level, :, t] = np.searchsorted(flat[t], (start + (1 << shift) - 1).astype(np.uint32), side="right")
    base, flat_whose = np.arange(trees) * n, whose.reshape(-1)

    def held(q: int, level: int) -> np.ndarray:
        """Who shares `level` bits with a query, tree by tree."""
        length = (high[level, q] - low[level, q]).astype(np.int64)
        ends = np.cumsum(length)
        return flat_whose[np.arange(ends[-1]) + np.repeat(base + low[level, q] - (ends - length), length)]

    for q in range(len(numbers)):
        size = (high[:, q].astype(np.int64) - low[:, q]).sum(axis=1)
        level = int(np.flatnonzero(size >= min(want, size[0]))[-1])
        marked = np.zeros(n, bool)
        marked[held(q, min(level + 1, bits))] = True
        while level >= 0 and (missing := want - np.count_nonzero(marked)) > 0:
            new = held(q, level)
            new = new[~marked[new]]
            which, first = np.unique(new, return_index=True)
            marked[which[np.argsort(first)[:missing]]] = True  # the first trees' ones, on the level that suffices
            level -= 1
        yield np.flatnonzero(marked)


def _search(folder: str, k: int, trees: int, bits: int, rate: float, power: float):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.itertuples():
                own, asked = held(f"{folder}/{row.dim}.{row.block}.block"), held(f"{folder}/{row.dim}.{row.chunk}.chunk")
                ids, times, vectors, queries = own["ids"], own["times"], own["vectors"], asked["vectors"]
                numbers = strings(queries, own["centre"], planes(row.dim, trees, bits), trees, bits)
                want = min(len(ids), int(np.ceil(rate * len(ids) ** power)))
                out = []
                for i, found in enumerate(candidates(own["sorted"], own["whose"], numbers, want, bits)):
                    far = np.sqrt(((vectors[found] - queries[i]) ** 2).sum(axis=1))
                    # rows that repeat id and vector count each; the query's own row doesn't
                    left = times[found] - ((ids[found] == asked["id"][i]) & (vectors[found] == queries[i]).all(axis=1))
                    best = np.lexsort((ids[found], far))
                    best = np.repeat(best, np.minimum(left[best], k))[:k]
                    out.append(pd.DataFrame({"query_id": asked["id"][i], "query": asked["query"][i], "copies": asked["times"][i], "vec_id": ids[found][best], "score": far[best]}))
                yield pd.concat(out)
            give_back()

    return run


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, bits: int = BITS, block: int = BLOCK, chunk: int = CHUNK, rate: float = RATE, power: float = POWER) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which `queries` holds, the k nearest other rows that are found.

    score is the Euclidean distance in double precision; equal ones go by the smaller id. Rows with a null id, and those
    that don't take part (see takes_part), are neither found nor asked for. Only vectors of equal length are compared.
    Every row but the query's own can be found, also one that has its id or repeats it; a query that is there n times
    has n results. A query with fewer than k other rows gets all of them if its blocks have no more than `rate` *
    n ** `power` vectors; else it may miss some, as always.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & takes_part(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.size(vector_col).alias("dim"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = kept(rows.groupBy("id", "vector").agg(F.first("dim").alias("dim"), F.max("asks").alias("asks"), F.count("*").alias("times")), "vectors")
    cut = rows.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks"), F.ceil(F.sum(F.col("asks").cast("int")) / chunk).alias("chunks"))
    cut = kept(cut, "dims")  # a row for each length of vectors
    dealt = rows.join(F.broadcast(cut), "dim")
    folder, parts = shared_folder(vectors.sparkSession, "forest"), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = dealt.withColumn("block", F.pmod(F.xxhash64("id", "vector"), "blocks")).groupBy("dim", "block")
    index = kept(index.applyInPandas(_blocks(folder, trees, bits), "dim int, block long"), "blocks")
    asks = dealt.where("asks").withColumn("query", F.xxhash64("id", "vector")).withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "id"), "chunks"))
    asks = kept(asks.groupBy("dim", "chunk").applyInPandas(_chunks(folder), "dim int, chunk long"), "chunks")
    # the blocks of a task are asked for the same queries, so that the ranks below leave few rows of it
    spread = F.pmod("block", F.ceil(F.lit(SPREAD * parts) / F.col("chunks")))
    pairs = index.join(F.broadcast(cut), "dim").join(asks, "dim").select("dim", "block", "chunk", spread.alias("part"))
    pairs = pairs.repartition(parts, "dim", "chunk", "part").select("dim", "block", "chunk")
    found = pairs.mapInPandas(_search(folder, k, trees, bits, rate, power), "query_id long, query long, copies long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")
