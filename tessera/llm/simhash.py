"""Near duplicates by SimHash: tiled exact comparison of fingerprints; and by Jaccard similarity, with a prefix join.

Fingerprints are packed into tiles by their population counts. Two tiles are compared, by exclusive-or and bit counts in
numpy, only if their population counts lie within the radius; two fingerprints whose counts differ by more can't be
linked, so nothing is lost. For a small radius the counts of the four quarters are used (their differences add up to no
more than the distance), which skips far more pairs than the count of all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, product
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, give_back, kept, release, remove, shared_folder, small_side, text_key
from tessera.llm.components import components
from tessera.llm.elias_fano import held, save
from tessera.llm.lm import _pack, _unpack

SEED = 42
#: Fingerprints of a tile, in the mean; a tile of a hot cell is cut by a hash.
TILE = 32768
#: Up to this radius the tiles go by the population counts of quarters.
QUARTERS_TO = 4
#: Shingles between two sorts of a task, bytes of text to a part of the shared shingles, bits of a hash that are left out there.
FLUSH = 250_000
PART_BYTES = 16 << 20
SHORT = np.uint64(24)
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of `size` words, repeats included; fewer words: the whole sequence; none: empty."""
    words, digest = words_of(text), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    runs = zip(*(words[i:] for i in range(size)), strict=False)
    return np.fromiter((digest(b" ".join(run), SEED) for run in runs), np.uint64, len(words) - size + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes, as a signed number; 0 if there are none."""
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _LANES for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text, size: int = 3):
    """SimHash column (long) of a text column; null and blank texts have 0."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        found = pd.Series([fingerprint_of(shingle_hashes(t, size)) for t in texts], dtype="int64")
        give_back()
        return found

    return simhash(text)


def _offsets(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts within the radius, each pair of tiles from one side only."""
    found = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return [d for d in found if d >= (0,) * parts]


def _near(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs within the radius, for a few rows of a at a time."""
    rows = max(1, 1_000_000 // max(1, len(b)))
    for at in range(0, len(a), rows):
        close = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius
        if close.any():
            i, j = np.nonzero(close)
            i = i + at
            if same:
                i, j = i[i < j], j[i < j]
            yield i, j


def _merge(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """root (each node's smallest known one) after p and q are linked pairwise."""
    while True:
        x, y = root[p], root[q]
        apart = x != y
        if not apart.any():
            return root
        p, q, x, y = p[apart], q[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _stars(nodes: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    moved = root != np.arange(len(root))
    return pd.DataFrame({"u": nodes[moved], "v": nodes[root[moved]]}, dtype="int64")


def _linked(radius: int):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each pair of tiles, links that keep its components: every linked node with the smallest it reaches."""
        for pdf in pdfs:
            out = [pd.DataFrame({"u": [], "v": []}, dtype="int64")]
            for fp_a, id_a, fp_b, id_b, same in zip(pdf["fp_a"], pdf["id_a"], pdf["fp_b"], pdf["id_b"], pdf["same"], strict=True):
                nodes = np.unique(id_a if same else np.concatenate([id_a, id_b]))
                at_a, at_b, root = np.searchsorted(nodes, id_a), np.searchsorted(nodes, id_b), np.arange(len(nodes))
                for i, j in _near(fp_a.view(np.uint64), fp_b.view(np.uint64), same, radius):
                    root = _merge(root, at_a[i], at_b[j])
                if (root != np.arange(len(root))).any():
                    out.append(_stars(nodes, root))
            yield pd.concat(out)
            give_back()

    return run


@dataclass
class Tile:
    """Texts side by side: ids, and of all of them in turn shingles (sorted, distinct) and tokens (see prints)."""

    ids: np.ndarray
    sets: list[np.ndarray]
    tokens: list[np.ndarray]

    @staticmethod
    def of(pdf: pd.DataFrame) -> Tile:
        pdf = pdf.drop_duplicates("id")
        return Tile(pdf["id"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) for x in pdf["shingles"]], [np.frombuffer(x, np.uint64) for x in pdf["tokens"]])

    def save(self, path: str) -> None:
        flat = lambda parts: {"of": np.array([len(p) for p in parts], np.int64), "all": np.concatenate([np.zeros(0, np.uint64), *parts])}
        save(path, {"ids": self.ids} | {f"{n}.{k}": v for n, parts in (("sets", self.sets), ("tokens", self.tokens)) for k, v in flat(parts).items()})

    @staticmethod
    def load(path: str) -> Tile:
        own = held(path)
        parts = lambda n: np.split(own[f"{n}.all"], np.cumsum(own[f"{n}.of"])[:-1])
        return Tile(own["ids"], parts("sets"), parts("tokens"))


def _meeting(a: Tile, b: Tile) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each token of both tiles, who has it in a and in b."""
    flat, at = [np.concatenate(t.tokens) for t in (a, b)], [np.repeat(np.arange(len(t.ids)), [len(x) for x in t.tokens]) for t in (a, b)]
    order = [np.argsort(f, kind="stable") for f in flat]
    flat, at = [f[o] for f, o in zip(flat, order, strict=True)], [x[o] for x, o in zip(at, order, strict=True)]
    common = np.intersect1d(*flat)
    ends = [(np.searchsorted(f, common), np.searchsorted(f, common, side="right")) for f in flat]
    for i0, i1, j0, j1 in zip(*ends[0], *ends[1], strict=True):
        yield at[0][i0:i1], at[1][j0:j1]


def _alike(a: Tile, b: Tile, class_a: np.ndarray, class_b: np.ndarray, least: float) -> pd.DataFrame:
    """Links (u, v) that join the classes of all pairs (one of a, one of b) that have a token in common and whose
    shingle sets have a Jaccard similarity of `least` or more. Pairs that are linked already aren't looked at."""
    nodes = np.unique(np.concatenate([class_a, class_b]))
    at_a, at_b, root = np.searchsorted(nodes, class_a), np.searchsorted(nodes, class_b), np.arange(len(nodes))
    size_a, size_b = (np.array([len(s) for s in t.sets]) for t in (a, b))
    seen = set()  # pairs that were compared and are not alike
    for i, j in _meeting(a, b):
        if (root[at_a[i]] == root[at_a[i[0]]]).all() and (root[at_b[j]] == root[at_a[i[0]]]).all():
            continue
        i, j = np.repeat(i, len(j)), np.tile(j, len(i))
        small, large = np.minimum(size_a[i], size_b[j]), np.maximum(size_a[i], size_b[j])
        # sets of sizes this far apart can't be alike
        some = np.flatnonzero((root[at_a[i]] != root[at_b[j]]) & (small >= least * large - 1e-6) & ((i < j) | (a is not b)))
        for x, y in zip(i[some].tolist(), j[some].tolist(), strict=True):
            if root[at_a[x]] == root[at_b[y]] or (x, y) in seen:
                continue
            if jaccard(a.sets[x], b.sets[y]) >= least:
                root = _merge(root, at_a[x : x + 1], at_b[y : y + 1])
            else:
                seen.add((x, y))
    return _stars(nodes, root)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values; 1 if both are empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _pairs(tiles: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs of tile keys (each key as <k>_a and <k>_b) with both tiles' columns, named <c>_a and <c>_b, and `same`."""
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(n, *[f"{k}_{s}" for s in "ab" for k in keys])
    for s in "ab":
        pairs = pairs.join(tiles.select([F.col(c).alias(f"{c}_{s}") for c in tiles.columns]), [f"{k}_{s}" for k in keys])
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"{k}_a") == F.col(f"{k}_b")
    return pairs.withColumn("same", same)


def candidate_links(nodes: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links (u, v) that have the components of all pairs of nodes (id, fp) whose fingerprints differ in `radius` bits
    or fewer. Every pair is looked at, but for those that population counts rule out; in a dense group a node still
    gives one link for each pair of tiles, not one for each partner."""
    parts = 4 if radius <= QUARTERS_TO else 1
    width = 64 // parts
    base = width + 1
    count = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1 if parts > 1 else -1))) for i in range(parts)]
    cell = F.lit(0)
    for c in count:
        cell = cell * base + c
    nodes = nodes.select("id", "fp", cell.alias("cell"))
    cells = kept(nodes.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("chunks")), "cells", 83_521)
    tiles = nodes.join(F.broadcast(cells), "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks"))
    tiles = tiles.groupBy("cell", "chunk").agg(F.collect_list(F.struct("fp", "id")).alias("x"))
    tiles = kept(tiles.select("cell", "chunk", F.col("x.fp").alias("fp"), F.col("x.id").alias("id")), "tiles")
    moves = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)]) for d in _offsets(parts, radius)])
    pairs = tiles.select(F.col("cell").alias("cell_a"), F.col("chunk").alias("chunk_a"), F.explode(moves).alias("d"))
    other = F.lit(0)
    for i in range(parts):
        digit = F.floor(F.col("cell_a") / base ** (parts - 1 - i)).cast("int") % base + F.col(f"d.d{i}")
        pairs = pairs.where(digit.between(0, width))
        other = other * base + digit
    pairs = pairs.select("cell_a", "chunk_a", other.alias("cell_b")).join(F.broadcast(cells.withColumnRenamed("cell", "cell_b")), "cell_b")
    pairs = pairs.select("cell_a", "chunk_a", "cell_b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_b"))
    pairs = pairs.where("cell_a <> cell_b or chunk_a <= chunk_b")
    both = _pairs(tiles, pairs, ["cell", "chunk"]).select("fp_a", "id_a", "fp_b", "id_b", "same")
    return both.mapInPandas(_linked(radius), "u long, v long")


def _sets(texts: Iterator[pd.Series], size: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingles of each text, of about FLUSH shingles at a time."""
    sets, n = [], 0
    for text in chain.from_iterable(texts):
        sets.append(np.unique(shingle_hashes(text, size)))
        n += len(sets[-1])
        if n >= FLUSH:
            yield sets
            sets, n = [], 0
            give_back()
    if sets:
        yield sets
    give_back()


def _shared_shingles(texts: DataFrame, size: int) -> tuple[list[str], np.ndarray]:
    """Files with the leading bits of all shingles that two rows of texts or more have, in order, and the cuts between
    them. A shingle that only has its leading bits in common with another may be among them."""
    spark, parts = texts.sparkSession, 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
    folder = shared_folder(spark, "shingles")
    cuts = np.array([(-(-(i << 64) // parts)) >> int(SHORT) for i in range(1, parts)], np.uint64)

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for sets in _sets((pdf["text"] for pdf in pdfs), size):
            found, n = np.unique(np.concatenate(sets) >> SHORT, return_counts=True)
            ends = np.append(np.searchsorted(found, cuts), len(found))
            n = np.minimum(n, 2).astype(np.uint8)
            out = [(p, b - a, _pack(found[a:b], n[a:b])) for p, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)) if a < b]
            yield pd.DataFrame(out, columns=["part", "n", "data"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found, n = (np.concatenate(x) for x in zip(*[_unpack(d, k, np.uint64, np.uint8) for d, k in zip(pdf["data"], pdf["n"], strict=True)], strict=True))
        twice, found = found[n > 1], np.sort(found)
        part = int(pdf["part"].iloc[0])
        save(f"{folder}/{part}.shared", {"shingle": np.unique(np.concatenate([twice, found[1:][found[1:] == found[:-1]]]))})
        return pd.DataFrame({"part": [part]})

    rows = texts.mapInPandas(count, "part int, n int, data binary").groupBy("part").applyInPandas(merge, "part int").collect()
    for p in set(range(parts)) - {r.part for r in rows}:
        save(f"{folder}/{p}.shared", {"shingle": np.zeros(0, np.uint64)})
    return [f"{folder}/{p}.shared" for p in range(parts)], cuts


def _signed(texts: pd.Series, size: int, least: float, files: list[str], cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its sorted distinct shingles, and its tokens (see prints)."""
    for sets in _sets(iter([texts]), size):
        every = np.concatenate(sets)
        order = np.argsort(every)
        asked, shared = every[order] >> SHORT, np.zeros(len(every), bool)
        ends = np.append(np.searchsorted(asked, cuts), len(asked))
        for file, a, b in zip(files, np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            known = held(file)["shingle"] if a < b else ()
            if len(known):
                to = np.minimum(np.searchsorted(known, asked[a:b]), len(known) - 1)
                shared[order[a:b]] = known[to] == asked[a:b]
        end = 0
        for s in sets:
            own = s[shared[end : end + len(s)]]
            end += len(s)
            first = len(s) - ceil(least * len(s) - 1e-6) + 1
            yield s, own[: max(0, first - (len(s) - len(own)))]


def prints(docs: DataFrame, size: int, least: float, index: tuple[list[str], np.ndarray]) -> DataFrame:
    """(id, n, fp, tokens) of texts (id, text), one row for each id: the number of distinct shingles, their SimHash, and
    tokens: if the shingle sets of two texts have a Jaccard similarity of `least` or more, they have a token in common.

    Two such sets have least * n shingles in common at least, n the size of either. So, in whatever order all shingles
    are, the first n - least * n + 1 of each set meet. The order begins with shingles that one text alone has: they
    meet nothing and aren't given, so that a text with enough of them has no tokens.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = [(len(s), fingerprint_of(s), t.view(np.int64)) for s, t in _signed(pdf["text"], size, least, *index)]
            yield pd.concat([pdf[["id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n", "fp", "tokens"])], axis=1)

    return docs.mapInPandas(run, "id long, n long, fp long, tokens array<long>").dropDuplicates(["id"])


def token_links(tokens: DataFrame) -> DataFrame:
    """Links (u, v) that have the components of all rows (id, tokens) with a token in common: of each token, every row
    with the smallest."""
    rows = tokens.select("id", F.explode("tokens").alias("token"))
    low = rows.groupBy("token").agg(F.min("id").alias("v"), F.max("id").alias("most")).where("v < most").select("token", "v")
    return rows.join(small_side(kept(low, "lows")), "token").where("id <> v").select(F.col("id").alias("u"), "v").distinct()


def _by_tile(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one (root, tile) after another, of rows in their order."""
    rest = None
    for pdf in pdfs:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        root, tile = pdf["root"].to_numpy(), pdf["tile"].to_numpy()
        starts = np.flatnonzero(np.append(True, (root[1:] != root[:-1]) | (tile[1:] != tile[:-1]))[: len(pdf)])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield pdf.iloc[a:b]
        rest = pdf.iloc[starts[-1] :] if len(starts) else rest
    if rest is not None and len(rest):
        yield rest


def _within(folder: str, least: float):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links inside each tile; a tile that is not alone in its group is saved."""
        yield pd.DataFrame({"u": [], "v": []}, dtype="int64")
        for pdf in _by_tile(pdfs):
            tile = Tile.of(pdf)
            if pdf["many"].iloc[0]:
                tile.save(f"{folder}/{pdf['root'].iloc[0]}.{pdf['tile'].iloc[0]}")
            if len(links := _alike(tile, tile, tile.ids, tile.ids, least)):
                yield links

    return run


def _classed(folder: str, step: str):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Saves the classes of each tile's texts, in the order of the tile; (root, tile, low, high: of its classes)."""
        for pdf in pdfs:
            out = []
            for row in pdf.itertuples():
                order, own = np.argsort(row.ids), Tile.load(f"{folder}/{row.root}.{row.tile}")
                classes = row.classes[order][np.searchsorted(row.ids[order], own.ids)]
                save(f"{folder}/{row.root}.{row.tile}.{step}", {"classes": classes})
                out.append((row.root, row.tile, classes.min(), classes.max()))
            yield pd.DataFrame(out, columns=["root", "tile", "low", "high"])

    return run


def _across(folder: str, step: str, least: float):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links between the classes of two saved tiles."""
        yield pd.DataFrame({"u": [], "v": []}, dtype="int64")
        for pdf in pdfs:
            for row in pdf.itertuples():
                a, b = (f"{folder}/{row.root}.{t}" for t in (row.tile_a, row.tile_b))
                class_a, class_b = (held(f"{x}.{step}")["classes"] for x in (a, b))
                if len(links := _alike(Tile.load(a), Tile.load(b), class_a, class_b, least)):
                    yield links
            give_back()

    return run


def fingerprint_classes(docs: DataFrame, radius: int = 3, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: doc_id, fingerprint (long), component_id (the smallest id reachable over fingerprints that differ
    in `radius` bits or fewer, itself included).

    Null and blank texts have fingerprint 0 and are linked like any other. Repeated rows stay, each with the same
    result. A null id never is a component_id, unless no row of the component has another. Other columns are left out.
    """
    rows = kept(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), size).alias("fingerprint")), "prints")
    n = rows.count()
    distinct = kept(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("low")), "distinct", n)
    links = kept(candidate_links(distinct.select(F.col("fp").alias("id"), "fp"), radius), "links")
    roots = distinct.join(components(links), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = kept(roots.join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id"), "named", n)
    return rows.join(small_side(named), "fingerprint").select("doc_id", "fingerprint", "component_id")


def _dealt(some: DataFrame, group: int, most: int) -> DataFrame:
    """(id, root, tile, many: whether its group has other tiles) of texts (id, root: candidate group, near: group of near
    fingerprints in it, n: shingles). Near fingerprints share a tile; a tile has about `group` texts, of 1,024 shingles
    each, at most: larger groups of near fingerprints are cut by a hash, smaller ones put together."""
    cap = group * 1024
    whole = some.groupBy("root", "near").agg(F.count("*").alias("n"), F.sum("n").alias("m"))
    own = F.when((F.col("n") * 2 > group) | (F.col("m") * 2 > cap), F.ceil(F.greatest(F.col("n") / group, F.col("m") / cap)))
    whole = whole.select("root", "near", "n", "m", own.alias("own"))
    rest = [F.sum(F.when(F.col("own").isNull(), F.col(c))) for c in "nm"]
    rests = F.coalesce(F.ceil(F.greatest(rest[0] / group, rest[1] / cap)), F.lit(0))
    groups = whole.groupBy("root").agg(rests.alias("rests"), (F.coalesce(F.sum("own"), F.lit(0)) + rests > 1).alias("many"))
    known = whole.join(groups, "root").select("root", "near", "own", "rests", "many")
    cut = F.xxhash64(F.lit(1), "near", F.pmod(F.xxhash64(F.lit(2), "id"), "own"))
    tile = F.when(F.col("own").isNotNull(), cut).otherwise(F.pmod(F.xxhash64("near"), "rests"))
    return kept(some.drop("n").join(known, ["root", "near"]).select("id", "root", tile.alias("tile"), "many"), "dealt", most)


def near_classes(docs: DataFrame, shingle: int = 5, least: float = 0.8, text_col: str = "text", group: int = 256, radius: int = 3) -> DataFrame:
    """(node: xxhash64 of a text's text_key, class): equal for texts that near duplicates link, over any number of steps.

    Near duplicates: a Jaccard similarity of `least` or more over the sets of `shingle` words (a shorter text: one
    shingle). Texts without a near duplicate are left out. Blank texts are alike.

    Candidates are texts whose fingerprints (SimHash of the set) differ in `radius` bits or fewer, found by tiles, and
    texts that have a token in common (see prints), which every pair of that similarity has, however far its
    fingerprints are apart. In each group of candidates, texts with near fingerprints lie in the same tile of about
    `group` texts. Shingle sets are compared within tiles first, then between each tile and the first one of its
    group, then between all tiles that aren't of one class by then. Tiles are files, read where they are compared, so
    a pair of them costs one row. A group of copies of one text is done after the second step; what never becomes one
    class takes (texts / group) ** 2 / 2 tile pairs.
    """
    keyed = docs.select(F.xxhash64(text_key(F.col(text_col))).alias("id"), F.col(text_col).alias("text"))
    index = _shared_shingles(keyed, shingle)
    signs = kept(prints(keyed, shingle, least, index), "prints")
    n = signs.count()
    lows = kept(signs.groupBy("fp").agg(F.min("id").alias("low"), F.max("id").alias("most")), "lows", n)
    twins = signs.join(lows.where("low < most").select("fp", "low"), "fp")
    near = candidate_links(lows.select(F.col("low").alias("id"), "fp"), radius).union(twins.select("id", "low"))
    near = kept(components(near).select(F.col("node").alias("id"), F.col("root").alias("near")), "near", n)
    groups = components(token_links(signs).union(near.select("id", "near"))).withColumnsRenamed({"node": "id"})
    some = groups.join(near, "id", "left").join(signs.select("id", "n"), "id").select("id", "root", F.coalesce("near", "id").alias("near"), "n")
    dealt = _dealt(kept(some, "candidates", n), group, n)
    folder = shared_folder(docs.sparkSession, "tiles")

    def sets(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = set()  # a copy adds nothing to its tile
        for pdf in pdfs:
            pdf = pdf[~pdf["id"].isin(known)].drop_duplicates("id")
            known.update(pdf["id"].tolist())
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                out = [(s.tobytes(), t.tobytes()) for s, t in _signed(part["text"], shingle, least, *index)]
                yield part[["id", "root", "tile", "many"]].assign(shingles=[x for x, _ in out], tokens=[x for _, x in out])

    texts = keyed.join(small_side(dealt), "id").mapInPandas(sets, "id long, root long, tile long, many boolean, shingles binary, tokens binary")
    texts = texts.repartition("root", "tile").sortWithinPartitions("root", "tile")
    links = kept(texts.mapInPandas(_within(folder, least), "u long, v long"), "links")
    several, parts = dealt.where("many"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for step in ("first", "rest"):
        classes = components(links).withColumnsRenamed({"node": "id", "root": "class"})
        tiles = several.join(classes, "id", "left").groupBy("root", "tile").agg(F.collect_list(F.struct("id", F.coalesce("class", "id").alias("class"))).alias("x"))
        tiles = tiles.select("root", "tile", F.col("x.id").alias("ids"), F.col("x.class").alias("classes"))
        tiles = kept(tiles.mapInPandas(_classed(folder, step), "root long, tile long, low long, high long"), "classed", n // group)
        a, b = (tiles.select("root", *[F.col(c).alias(f"{c}_{s}") for c in ("tile", "low", "high")]) for s in "ab")
        start = tiles.groupBy("root").agg(F.min("tile").alias("start"))
        pairs = a.join(start, "root").join(b, "root").where("tile_a < tile_b and not (low_a = low_b and high_a = high_b and low_a = high_b)")
        pairs = pairs.where("tile_a = start" if step == "first" else "tile_a <> start").select("root", "tile_a", "tile_b")
        more = pairs.repartition(parts, "root", "tile_a", "tile_b").mapInPandas(_across(folder, step, least), "u long, v long")
        links = links.union(kept(more, "links"))
    named = kept(components(links).withColumnsRenamed({"root": "class"}), "classes", n)
    release(signs, lows, near, dealt)
    for own in (folder, index[0][0].rsplit("/", 1)[0]):
        remove(docs.sparkSession, own)
    return named


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, one of each class of exact and near duplicates (see near_classes): that of the smallest id.

    Equal texts are one class; so are all null or blank ones. Of repeated rows of the same id and text one stays, any
    of them if other columns differ. A null id counts as larger than all others. All columns stay as they are.
    """
    own, ident = text_key(F.col(text_col)), F.col(id_col)
    blank = F.length(F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(BLANKS))) == 0
    keys = docs.groupBy(ident.alias("id"), blank.alias("blank"), own.alias("own")).agg(F.count("*").alias("n"))
    keys = kept(keys, "keys")
    classes = near_classes(docs.where(~blank), text_col=text_col, **how)
    named = keys.groupBy("blank", "own").agg(F.min_by(F.struct("id", "n"), F.struct(F.col("id").isNull(), "id")).alias("x"))
    named = named.join(small_side(classes), F.xxhash64("own") == F.col("node"), "left")
    name = F.when(F.col("blank"), F.lit(0)).when(F.col("class").isNull(), F.xxhash64("own")).otherwise(F.col("class"))
    first = named.groupBy("blank", name.alias("name")).agg(F.min_by(F.struct("own", "x"), F.struct(F.col("x.id").isNull(), "x.id", "own")).alias("y"))
    first = kept(first.select(F.col("y.own").alias("k"), F.col("y.x.id").alias("i"), F.col("y.x.n").alias("n")), "first")
    packed = docs.select(F.struct("*").alias("row"), own.alias("key"), ident.alias("id"))
    it = (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i"))
    stays = packed.join(small_side(first.where("n = 1")), it, "left_semi").select("row")
    if not (again := first.where("n > 1")).isEmpty():  # nothing tells rows that repeat id and text apart, so these are dealt out
        stays = stays.union(packed.join(small_side(again), it, "left_semi").dropDuplicates(["id", "key"]).select("row"))
    return stays.select("row.*")
