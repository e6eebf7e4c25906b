"""Language-model scoring with a 3-gram trie in Elias-Fano levels.

Level 1 is the vocabulary in the order of the words' hashes, with counts and pointers to level 2. Level 2 has all
bigrams in order, as shards of about equal size; level 3 the trigrams, each word as its rank
among the successors of the word before it. Probabilities are interpolated absolute discounting, two bytes each on a
log scale. All levels lie in files of the shared folder that tasks map into memory.

Building takes three passes over the texts' words: the vocabulary, then n-gram counts in shards, then the levels. What is
exchanged is packed: sorted arrays, a few rows for each task and shard. Shards are cut at equal expected counts, also
within the successors of one frequent word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, shared_folder, store
from tessera.llm.elias_fano import EliasFano, held, load, save

#: Hash of the end of a text; no word has white space.
END = xxhash.xxh64_intdigest(b"\n")
NONE = (1 << 32) - 1
#: Words between two sorts of a task, bytes of text to a part of the vocabulary, n-grams to a shard.
FLUSH = 1_000_000
PART_BYTES = 32 << 20
SHARD = 3_000_000
#: A probability's code of 16 bits counts steps of 1/4096 below 1 in log10, rounded down so that sums stay below 1.
STEP = 4096.0
ZERO = (1 << 16) - 1


def hashes_of(text: str | None) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a text with A-Z in lower case, and of its end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    return np.array([*map(digest, words), END], np.uint64)


def _batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of whole texts, about FLUSH at a time, and the number of hashes of each text."""
    parts, n = [], 0
    for pdf in pdfs:
        for text in pdf["text"]:
            parts.append(hashes_of(text))
            n += len(parts[-1])
            if n >= FLUSH:
                yield np.concatenate(parts), np.array([len(p) for p in parts])
                parts, n = [], 0
    if parts:
        yield np.concatenate(parts), np.array([len(p) for p in parts])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length and unsigned numbers, the first ascending: differences by byte lanes, compressed."""
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in (first, *arrays[1:]))
    return zstandard.ZstdCompressor(1).compress(raw)


def _unpack(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


def _summed(n: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of n; the first key leads."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    new = np.zeros(len(n), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return (*(k[at] for k in keys), np.add.reduceat(n, at, dtype=np.int64) if len(at) else n)


def _narrow(n: np.ndarray) -> np.ndarray:
    """Counts in one, two or four bytes, if they fit."""
    return next((n.astype(k) for k in (np.uint8, np.uint16, np.uint32) if not len(n) or n.max() <= np.iinfo(k).max), n)


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once else 0.5


def _code(p: np.ndarray) -> np.ndarray:
    """Probabilities above 0, quantised; ZERO stands for 0."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.ceil(-np.log10(p) * STEP), 0, ZERO - 1), ZERO).astype(np.uint16)


_VALUE = np.append(10.0 ** (-np.arange(ZERO) / STEP), 0.0)


@dataclass
class Trie:
    """The files of a model and what is needed to find one's way in them; a few numbers to a file."""

    folder: str
    tokens: int = 0  # N, ends included
    words: int = 0  # V, with the end
    texts: int = 0
    discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)
    parts: list[str] = field(default_factory=list)  # vocabulary, by the hash's leading bits
    part_first: list[int] = field(default_factory=list)  # the first number of each part, and V
    part_tokens: list[int] = field(default_factory=list)  # the tokens of all parts before each, and N
    shards: list[str] = field(default_factory=list)
    shard_key: list[int] = field(default_factory=list)  # the least key of each shard
    shard_first: list[int] = field(default_factory=list)  # the first bigram of each shard, and their number

    def _file(self, name: str) -> dict[str, np.ndarray]:
        return held(f"{self.folder}/{name}")

    def _by_part(self, firsts: list[int], sorted_queries: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The part that each of some sorted numbers falls in, part by part."""
        cuts = np.searchsorted(sorted_queries, np.array(firsts[1:], sorted_queries.dtype))
        for i, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_queries)], strict=True)):
            if a < b:
                yield min(i, len(firsts) - 1), slice(a, b)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted, distinct hashes in the vocabulary; -1 for others."""
        out = np.full(len(hashes), -1)
        bounds = [-(-(i << 64) // len(self.parts)) for i in range(len(self.parts))]
        for p, s in self._by_part(bounds, hashes) if self.parts else ():
            known = self._file(self.parts[p])["hash"]
            at = np.minimum(np.searchsorted(known, hashes[s]), len(known) - 1)
            if len(known):
                out[s] = np.where(known[at] == hashes[s], at + self.part_first[p], -1)
        return out

    def level_1(self, ids: np.ndarray, what: str) -> np.ndarray:
        """`count` of sorted word numbers, or `first`: the pointer to the first of its bigrams. V is the begin."""
        out = np.zeros(len(ids), np.int64)
        for p, s in self._by_part(self.part_first[:-1], ids) if self.parts else ():
            own, at = self._file(self.parts[p]), ids[s] - self.part_first[p]
            if what == "count":
                out[s] = np.append(own["count"], self.texts)[at] if p == len(self.parts) - 1 else own["count"][at]
            else:
                out[s] = EliasFano(self._file(f"{self.parts[p]}.to"), "first").get(at)
        return out

    def _number_of(self, shard: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
        """Keys (word << 32 | word) as the ascending numbers that a shard's sequence holds."""
        return ((keys >> np.uint64(32)).astype(np.int64) - int(shard["origin"][0])) * (self.words + 1) + (keys & np.uint64(NONE)).astype(np.int64)

    def level_2(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted bigram keys: place (-1: none), codes of its probability and of the weight that it leaves to backing off."""
        place, p, w = np.full(len(keys), -1), np.full(len(keys), ZERO, np.uint16), np.zeros(len(keys), np.uint16)
        for i, s in self._by_part(self.shard_key, keys) if self.shards else ():
            own = self._file(self.shards[i])
            at = EliasFano(own, "key").find(self._number_of(own, keys[s]))
            inside = np.flatnonzero(at >= 0)
            at, to = at[inside], s.start + inside
            place[to], p[to], w[to] = at + self.shard_first[i], own["p2"][at], own["w3"][at]
        return place, p, w

    def level_3(self, context: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Codes of the probabilities of trigrams: places of their first two words, sorted, and the third's rank among the
        successors of the second."""
        out = np.full(len(context), ZERO, np.uint16)
        for i, s in self._by_part(self.shard_first[:-1], context) if self.shards else ():
            own = self._file(self.shards[i])
            at, child, level = context[s] - self.shard_first[i], EliasFano(own, "child"), EliasFano(own, "rank")
            start, end = child.pair(at)
            some = np.flatnonzero(start < end)
            start, end = start[some], end[some]
            # ranks go on from the last one of the context before
            base = np.where(start > 0, level.get(np.maximum(start - 1, 0)), 0)
            found = level.find(base + 1 + rank[s][some])
            hit = np.flatnonzero((found >= 0) & (found < end))
            out[s.start + some[hit]] = own["p3"][found[hit]]
        return out


def train(docs: DataFrame, text_col: str = "text") -> Trie:
    """A model of all rows of docs; null texts are empty. Every word, bigram and trigram counts."""
    spark = docs.sparkSession
    trie = Trie(shared_folder(spark, "trie"))
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size, trie.texts = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    if not trie.texts:
        return trie
    _vocabulary(texts, trie, 1 + size // PART_BYTES)
    rows = _counts(texts, trie)
    trie.shards, trie.shard_key = [f"{r.shard}.ngrams" for r in rows], [r.least for r in rows]
    trie.shard_first = [0, *np.cumsum([r.bigrams for r in rows]).tolist()]
    total = lambda name: sum(r[name] for r in rows)
    trie.discounts = (trie.discounts[0], _discount(total("once2"), total("twice2")), _discount(total("once3"), total("twice3")))
    _pointers(spark, trie)
    _levels(spark, trie)
    return trie


def _run(spark, keys: int, work: Callable[[int], tuple], schema: str) -> list:
    """work(0), work(1), ... each in a task of its own."""

    def each(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame([work(int(i)) for i in pdf["id"]], columns=[x.split()[0] for x in schema.split(", ")])

    return spark.range(0, keys, 1, keys).mapInPandas(each, schema).collect()  # a few numbers for each key


def _vocabulary(texts: DataFrame, trie: Trie, parts: int) -> None:
    cuts = np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64)

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for hashes, _ in _batches(pdfs):
            hashes, n = np.unique(hashes, return_counts=True)
            ends = np.append(np.searchsorted(hashes, cuts), len(hashes))
            out = [(p, b - a, _pack(hashes[a:b], n[a:b].astype(np.uint32))) for p, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)) if a < b]
            yield pd.DataFrame(out, columns=["part", "n", "data"])

    folder = trie.folder

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [_unpack(d, n, np.uint64, np.uint32) for d, n in zip(pdf["data"], pdf["n"], strict=True)]
        hashes, n = _summed(np.concatenate([x[1] for x in found]).astype(np.int64), np.concatenate([x[0] for x in found]))
        part = int(pdf["part"].iloc[0])
        save(f"{folder}/{part}.words", {"hash": hashes, "count": n})
        return pd.DataFrame([(part, len(n), n.sum(), (n == 1).sum(), (n == 2).sum())], columns=["part", "words", "tokens", "once", "twice"])

    packed = texts.mapInPandas(count, "part int, n int, data binary")
    rows = packed.groupBy("part").applyInPandas(merge, "part int, words long, tokens long, once long, twice long").collect()
    for p in set(range(parts)) - {r.part for r in rows}:
        save(f"{folder}/{p}.words", {"hash": np.zeros(0, np.uint64), "count": np.zeros(0, np.int64)})
    words = dict((r.part, r.words) for r in rows)
    trie.parts = [f"{p}.words" for p in range(parts)]
    trie.part_first = [0, *np.cumsum([words.get(p, 0) for p in range(parts)]).tolist()]
    tokens = dict((r.part, r.tokens) for r in rows)
    trie.part_tokens = [0, *np.cumsum([tokens.get(p, 0) for p in range(parts)]).tolist()]
    trie.words, trie.tokens = trie.part_first[-1], trie.part_tokens[-1]
    trie.discounts = (_discount(sum(r.once for r in rows), sum(r.twice for r in rows)), 0.5, 0.5)


def _sequence(trie: Trie, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of texts one after another, each begun by V; the places of the begins; counts of the words."""
    distinct, which = np.unique(hashes, return_inverse=True)
    ids = trie.number(distinct)
    counts = np.zeros(len(ids), np.int64)
    counts[ids >= 0] = trie.level_1(ids[ids >= 0], "count")
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    body = np.ones(len(hashes) + len(lengths), bool)
    body[begins] = False
    sequence = np.full(len(body), trie.words)
    sequence[body] = ids[which]
    n = np.zeros(len(body), np.int64)
    n[body] = counts[which]
    return sequence, begins, n


def _words_at(spark, trie: Trie, masses: list[float]) -> list[tuple[int, float]]:
    """Of places in the running sum of all words' counts: the word there, and how far in it that is. Each part of the
    vocabulary is looked at by a task of its own, if a place is in it."""
    part = [min(max(0, int(np.searchsorted(trie.part_tokens, m, side="right")) - 1), len(trie.parts) - 1) for m in masses]
    asked = sorted(set(part))

    def work(k: int) -> tuple:
        p = asked[k]
        own = load(f"{trie.folder}/{trie.parts[p]}")["count"]
        run, out = trie.part_tokens[p] + np.cumsum(own), []
        for m in (m for m, at in zip(masses, part, strict=True) if at == p):
            i = min(int(np.searchsorted(run, m, side="right")), len(run) - 1)
            out.append((trie.part_first[p] + i, min(1.0, max(0.0, float((m - (run[i] - own[i])) / own[i])))))
        return p, [int(w) for w, _ in out], [s for _, s in out]

    found = {r.id: iter(zip(r.words, r.shares, strict=True)) for r in _run(spark, len(asked), work, "id long, words array<long>, shares array<double>")} if asked else {}
    return [next(found[p]) for p in part]


def _cuts(spark, trie: Trie, shards: int) -> list[int]:
    """Keys that cut the bigrams into parts of about equal counts, if words followed each other independently."""
    first = _words_at(spark, trie, [trie.tokens * i / shards for i in range(1, shards)])
    second = _words_at(spark, trie, [trie.tokens * share for _, share in first])
    return [0, *sorted({(a << 32) | b for (a, _), (b, _) in zip(first, second, strict=True)} - {0})]


def _counts(texts: DataFrame, trie: Trie) -> list:
    """Writes counted bigrams and trigrams by shard; returns a row for each shard."""
    cuts = _cuts(texts.sparkSession, trie, 1 + trie.tokens // SHARD)
    inner = np.array(cuts[1:], np.uint64)

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for hashes, lengths in _batches(pdfs):
            seq, begins, _ = _sequence(trie, hashes, lengths)
            last = np.zeros(len(seq), bool)
            last[np.append(begins[1:], len(seq)) - 1] = True
            at = np.flatnonzero(~last)
            keys = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1].astype(np.uint64)
            third = np.where(last[at + 1], NONE, seq[np.minimum(at + 2, len(seq) - 1)]).astype(np.uint32)
            keys, third, n = _summed(np.ones(len(at), np.uint32), keys, third)
            ends = np.append(np.searchsorted(keys, inner), len(keys))
            out = [(s, b - a, _pack(keys[a:b], third[a:b], n[a:b].astype(np.uint32))) for s, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)) if a < b]
            yield pd.DataFrame(out, columns=["shard", "n", "data"])

    folder = trie.folder

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [_unpack(d, n, np.uint64, np.uint32, np.uint32) for d, n in zip(pdf["data"], pdf["n"], strict=True)]
        keys, third, n = (np.concatenate([x[i] for x in found]) for i in range(3))
        del found
        keys, third, n = _summed(n, keys, third)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        bigrams, n2 = keys[first], np.add.reduceat(n, first, dtype=np.int64)
        real = third != NONE
        stay = np.flatnonzero(real)
        shard = int(pdf["shard"].iloc[0])
        context = (np.searchsorted(first, stay, side="right") - 1).astype(np.uint32)
        save(f"{folder}/{shard}.counts", {"key": bigrams})
        save(f"{folder}/{shard}.own", {"n": _narrow(n2), "context": context, "third": third[stay], "n3": _narrow(n[stay])})
        row = (shard, cuts[shard], len(bigrams), (n2 == 1).sum(), (n2 == 2).sum(), (real & (n == 1)).sum(), (real & (n == 2)).sum())
        return pd.DataFrame([row], columns=["shard", "least", "bigrams", "once2", "twice2", "once3", "twice3"])

    packed = texts.mapInPandas(count, "shard int, n int, data binary")
    rows = packed.groupBy("shard").applyInPandas(merge, "shard int, least long, bigrams long, once2 long, twice2 long, once3 long, twice3 long").collect()
    return sorted(rows, key=lambda r: r.shard)


def _raw(trie: Trie, i: int) -> dict[str, np.ndarray]:
    return load(f"{trie.folder}/{trie.shards[i].replace('.ngrams', '.counts')}")


def _place(trie: Trie, keys: np.ndarray) -> np.ndarray:
    """How many bigrams are below each of some sorted keys, from the counted shards."""
    out = np.zeros(len(keys), np.int64)
    for i, s in trie._by_part(trie.shard_key, keys):
        out[s] = np.searchsorted(_raw(trie, i)["key"], keys[s]) + trie.shard_first[i]
    return out


def _pointers(spark, trie: Trie) -> None:
    """Level 1's pointers: for each word, and the begin, the first bigram that it leads."""

    def work(p: int) -> tuple:
        ids = np.arange(trie.part_first[p], trie.part_first[p + 1] + 1 + (p == len(trie.parts) - 1), dtype=np.uint64)
        save(f"{trie.folder}/{trie.parts[p]}.to", EliasFano.encode(_place(trie, ids << np.uint64(32)), "first"))
        return (p,)

    _run(spark, len(trie.parts), work, "id long")


def _levels(spark, trie: Trie) -> None:
    """Levels 2 and 3 of each shard."""
    _, d2, d3 = trie.discounts

    def work(i: int) -> tuple:
        own = f"{trie.folder}/{trie.shards[i].replace('.ngrams', '.own')}"
        files, path = store(own)
        if files.get_file_info(path).type == fs.FileType.NotFound:  # a task that runs again, after its levels were saved
            return (i,)
        raw = _raw(trie, i) | load(own)
        keys, n2, context, third, n3 = (raw[x] for x in ("key", "n", "context", "third", "n3"))
        lead = (keys >> np.uint64(32)).astype(np.int64)
        out = {"origin": lead[:1].copy()}
        out |= EliasFano.encode(trie._number_of(out, keys), "key")
        out["p2"] = _code((n2 - d2) / np.maximum(trie.level_1(lead, "count"), 1))
        share = (n3 - d3) / n2[context]
        out["p3"] = _code(share)
        out["w3"] = _code(1 - np.bincount(context, weights=share, minlength=len(keys)))
        children = np.bincount(context, minlength=len(keys))
        out |= EliasFano.encode(np.append(0, np.cumsum(children)), "child")
        second = (keys[context] & np.uint64(NONE)).astype(np.int64)
        pair = (second.astype(np.uint64) << np.uint64(32)) | third
        wanted, which = np.unique(pair, return_inverse=True)
        first = trie.level_1((wanted >> np.uint64(32)).astype(np.int64), "first")
        rank = (_place(trie, wanted) - first)[which]
        # ascending over contexts: each goes on from the last rank of the one before
        ends = np.flatnonzero(np.append(context[1:] != context[:-1], True)) if len(context) else np.zeros(0, np.int64)
        base = np.append(0, np.cumsum(rank[ends] + 1))
        group = np.cumsum(np.append(False, context[1:] != context[:-1])) if len(context) else context
        out |= EliasFano.encode(base[group] + rank + 1, "rank")
        save(f"{trie.folder}/{trie.shards[i]}", out)
        files.delete_file(path)  # no other shard reads it
        return (i,)

    _run(spark, len(trie.shards), work, "id long")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(trie.folder)
    hadoop = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in trie.shards:
        hadoop.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name.replace(".ngrams", ".counts")), False)


def _scores(trie: Trie, hashes: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of texts that come one after another."""
    seq, begins, counts = _sequence(trie, hashes, lengths)
    d1, d2, _ = trie.discounts
    n, v = trie.tokens, trie.words
    now = np.ones(len(seq), bool)
    now[begins] = False
    now = np.flatnonzero(now)
    c = counts[now]
    base = np.log10((c + 1) / (n + 1 * (v + 1)))
    spare = d1 * v / n / (v + 1) if n else 1.0
    p = np.where(c > 0, (c - d1) / max(n, 1), 0) + spare  # all unknown words are one more word
    before, word = seq[now - 1], seq[now]
    lead, which = np.unique(before, return_inverse=True)
    ok = lead >= 0
    first, nexts, times = (np.zeros(len(lead), np.int64) for _ in range(3))
    if trie.shards:
        first[ok], nexts[ok], times[ok] = trie.level_1(lead[ok], "first"), trie.level_1(lead[ok] + 1, "first") if ok.any() else 0, trie.level_1(lead[ok], "count")
    nexts -= first
    left = np.where(times > 0, d2 * nexts / np.maximum(times, 1), 1.0)[which]
    pairs = np.flatnonzero((before >= 0) & (word >= 0))
    keys, same = np.unique((before[pairs].astype(np.uint64) << np.uint64(32)) | word[pairs].astype(np.uint64), return_inverse=True)
    found, b2, w3 = trie.level_2(keys)
    place, p2, weight = np.full(len(now), -1), np.zeros(len(now)), np.ones(len(now))
    place[pairs], p2[pairs], weight[pairs] = found[same], _VALUE[b2][same], np.where(found >= 0, _VALUE[w3], 1.0)[same]
    p = np.where((before >= 0) & (times[which] > 0), p2 + left * p, p)
    # trigrams: the pair before (of the same text) and this one are known
    inner = np.append(False, now[1:] == now[:-1] + 1)
    context = np.where(inner, np.append(-1, place[:-1]), -1)
    back = np.where(context >= 0, np.append(1.0, weight[:-1]), 1.0)
    tri = np.flatnonzero((context >= 0) & (place >= 0))
    tri = tri[np.argsort(context[tri], kind="stable")]
    p3 = np.zeros(len(now))
    p3[tri] = _VALUE[trie.level_3(context[tri], place[tri] - first[which[tri]])]
    p = p3 + back * p
    starts = np.cumsum(lengths) - lengths
    total = lambda x: np.add.reduceat(x, starts)
    return {"n_tokens": lengths, "n_known": total((c > 0).astype(np.int64)), "base_score": total(base), "score": total(np.log10(p))}


def score(docs: DataFrame, trie: Trie, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row: the columns `keep` of docs, or all, as a struct, n_tokens, n_known, train_tokens, base_score, score) of
    every row.

    A null text is empty: its only token is the end. An unknown word counts as one further word of the vocabulary. With
    nothing learned, score is 0 for each token. Repeated rows stay, and equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trie)  # a few numbers for each file
    names = ["n_tokens", "n_known", "base_score", "score"]

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        own = [hashes_of(t) for t in texts]
        lengths = np.array([len(h) for h in own], np.int64)
        # about FLUSH words at a time, in parts of about equal size
        part = (np.cumsum(lengths) - lengths) * max(1, round(lengths.sum() / FLUSH)) // max(1, lengths.sum())
        starts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(own)]
        out = [pd.DataFrame(_scores(shared.value, np.concatenate(own[a:b]), lengths[a:b]))[names] for a, b in zip(starts, starts[1:], strict=False)]
        return pd.concat(out) if out else pd.DataFrame({x: [] for x in names})

    scored = docs.select(packed(keep), of(F.col(text_col)).alias("scored"))
    return scored.select("row", "scored.n_tokens", "scored.n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "scored.base_score", "scored.score")
