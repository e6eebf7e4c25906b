"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Which n-grams of 3 to 6 characters a text has (not how often) are its features, each with the log of the ratio of its
smoothed shares among labelled 1 and labelled 0 texts as its value; a logistic regression weighs them. n-grams are told
apart by 64-bit hashes; all that clearly go with a label are kept, and tasks count them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, kept, packed, small_side
from tessera.llm.lm import _pack, _summed, _unpack
from tessera.llm.ngrams import hashed

ORDERS = (3, 4, 5, 6)
#: Labelled texts of each label that are learned from, about.
PER_LABEL = 4000
#: Texts of the sample that an n-gram must be in, and the least evidence (G statistic) that it goes with the label.
LEAST_TEXTS = 4
LEAST_EVIDENCE = 15.0
STEPS = 400
RIDGE = 1e-4
#: Parts of the hashes that are counted side by side; texts of which a task's counts are packed together; and texts that
#: are scored together.
PARTS = 32
TEXTS = 256
BATCH = 128
#: Features of the sample that a step of learning looks at together.
CELLS = 1 << 18
_BITS = 22


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _BITS)).astype(np.int64)


def distinct(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's n-grams."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(h) for _, h in hashed([text], ORDERS))]))


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray  # ratio times learned weight
    bias: float

    def __post_init__(self) -> None:
        self.table = np.zeros(1 << _BITS, bool)
        self.table[slot(self.hashes)] = True

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of a text's number and the number of a feature that it has, in order."""
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for owner, h in hashed(texts, ORDERS) if len(self.hashes) else ():
            some = np.flatnonzero(self.table[slot(h)])
            owner, h = owner[some], h[some]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            same = self.hashes[at] == h
            pair = np.unique(owner[same] * len(self.hashes) + at[same])
            parts.append((pair // len(self.hashes), pair % len(self.hashes)))
        pair = np.unique(np.concatenate([o * max(1, len(self.hashes)) + f for o, f in parts]))
        return pair // max(1, len(self.hashes)), pair % max(1, len(self.hashes))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 of each text, by one sparse product."""
        z = np.full(len(texts), self.bias)
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            owner, feature = self.features(part)
            z[at : at + BATCH] += np.bincount(owner, weights=self.weights[feature], minlength=len(part))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """A model of the texts of docs by their labels, 0 or 1; other labels, and null ids and texts, are left out.

    About `per_label` ids of each label are learned from, chosen by a hash of the id before any text is read; the shares
    of the labels are those of all labelled ids. An id that is labelled twice counts with its higher label, and an id
    with several texts with the greatest. Tasks count the n-grams of the sample; to the driver come those that go with a
    label, and which of them each text of the sample has. With one label only, every score is near that label's side;
    with none it is 0.5.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in ids.groupBy("label").count().collect()}
    if not counts:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    chance = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("label") == 1, per_label / counts.get(1, 1)).otherwise(per_label / counts.get(0, 1))
    chosen = small_side(kept(ids.where(chance < rate), "chosen"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(chosen, "id")
    sample = kept(texts.groupBy("id", "label").agg(F.max("text").alias("text")).select("id", "text", "label").repartition(16, "id"), "sample")
    return fit(sample, np.array([counts.get(0, 0), counts.get(1, 0)], float))


def counted(sample: DataFrame, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a sample of (text, label), with n texts of label 0 and 1: the hashes of the n-grams in at least LEAST_TEXTS
    texts that have LEAST_EVIDENCE or more, in order, and in how many texts of label 1 and of label 0 each is."""
    cuts = np.array([-(-(i << 64) // PARTS) for i in range(1, PARTS)], np.uint64)

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for at in range(0, len(pdf), TEXTS):
                part = pdf.iloc[at : at + TEXTS]
                own = [distinct(t) for t in part["text"]]
                every = np.concatenate(own)
                # both counts in one number: texts of label 1 above, all texts below
                both = np.repeat((part["label"].to_numpy(np.int64) << 32) + 1, [len(h) for h in own])
                hashes, both = _summed(both, every)
                ends = np.append(np.searchsorted(hashes, cuts), len(hashes))
                out = [(p, b - a, _pack(hashes[a:b], (both[a:b] & 0xFFFF).astype(np.uint16), (both[a:b] >> 32).astype(np.uint16))) for p, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)) if a < b]
                yield pd.DataFrame(out, columns=["part", "n", "data"])
            give_back()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [_unpack(d, k, np.uint64, np.uint16, np.uint16) for d, k in zip(pdf["data"], pdf["n"], strict=True)]
        both = np.concatenate([(x[2].astype(np.int64) << 32) + x[1] for x in found])
        hashes, both = _summed(both, np.concatenate([x[0] for x in found]))
        ones, every = both >> 32, both & 0xFFFFFFFF
        good = (every >= LEAST_TEXTS) & (evidence(ones, every - ones, n) >= LEAST_EVIDENCE)
        return pd.DataFrame({"hash": hashes[good].view(np.int64), "ones": ones[good], "zeros": (every - ones)[good]})

    packed = sample.select("text", "label").mapInPandas(count, "part int, n int, data binary")
    found = packed.groupBy("part").applyInPandas(merge, "hash long, ones long, zeros long").toPandas()  # bounded by the sample
    hashes = found["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["ones"].to_numpy(float)[order], found["zeros"].to_numpy(float)[order]


def fit(sample: DataFrame, share: np.ndarray) -> Model:
    """A model of a sample of (text, label); share: the rows of label 0 and 1 that it stands for."""
    rows = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n = np.array([rows.get(0, 0), rows.get(1, 0)], float)
    hashes, ones, zeros = counted(sample, n)
    shared = sample.sparkSession.sparkContext.broadcast(Model(hashes, np.zeros(len(hashes)), 0.0))

    def features(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                owner, feature = shared.value.features(part["text"].tolist())
                own = np.split(feature.astype(np.int32), np.searchsorted(owner, np.arange(1, len(part))))
                yield part[["id", "label"]].assign(features=[x.tobytes() for x in own])

    kind = sample.schema["id"].dataType.simpleString()
    found = sample.mapInPandas(features, f"id {kind}, label int, features binary").toPandas().sort_values("id", kind="stable")
    shared.destroy()
    own = [np.frombuffer(x, np.int32) for x in found["features"]]
    y = found["label"].to_numpy(float)
    weight = (share / max(share.sum(), 1) / np.maximum(n, 1))[y.astype(int)] if len(y) else np.zeros(0)
    ratio = log_ratio(ones, zeros, n)
    w, bias = _logistic(own, ratio, y, weight)
    return Model(hashes, w * ratio, bias)


def log_ratio(ones: np.ndarray, zeros: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log of the smoothed share of the texts of label 1 that have an n-gram, by that of label 0."""
    return np.log((ones + 0.5) / (n[1] + 1)) - np.log((zeros + 0.5) / (n[0] + 1))


def evidence(ones: np.ndarray, zeros: np.ndarray, n: np.ndarray) -> np.ndarray:
    """G statistic of an n-gram and the label: twice the log-likelihood ratio against independence."""
    total, both, out = max(1.0, n.sum()), ones + zeros, np.zeros(len(ones))
    for seen, whole in ((ones, n[1]), (zeros, n[0])):
        for got, rows in ((seen, both), (whole - seen, total - both)):
            out += 2 * got * np.log(np.maximum(got, 1e-9) / np.maximum(rows * whole / total, 1e-9))
    return out


def _logistic(own: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on the features that each row has, by Adam over all rows, some rows at
    a time so that little is held besides the features."""
    lengths = np.array([len(x) for x in own], np.int64)
    starts = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // CELLS, prepend=-1))
    blocks = [(slice(a, b), lengths[a:b], np.concatenate(own[a:b])) for a, b in zip(starts, [*starts[1:], len(own)][: len(starts)], strict=True)]
    w, bias = np.zeros(len(ratio)), 0.0
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for step in range(1, STEPS + 1 if len(y) else 1):
        g, each = np.append(ridge * w, 0.0), w * ratio
        for rows, n, cols in blocks:
            run = np.append(0.0, np.cumsum(each[cols]))
            end = np.cumsum(n)
            z = run[end] - run[end - n] + bias
            off = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows])
            g[:-1] += np.bincount(cols, weights=np.repeat(off, n), minlength=len(ratio)) * ratio
            g[-1] += off.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row: the columns `keep` of docs, or all, as a struct, score: 0 to 1, higher: label 1 likelier, predicted: 1 if
    score >= 0.5) of every row.

    Whole texts are scored, a batch of rows at a time. Null and empty texts get the score of a text without features.
    Repeated rows stay, and equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 16 bytes a feature and a table of 4 MB

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        found = pd.Series(shared.value.scores(texts.tolist()), dtype="float64")
        give_back()
        return found

    scored = docs.select(packed(keep), of(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
