"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log probabilities are one matrix (hash slot x language) that is broadcast. A batch of texts is a sparse matrix (text x
slot) in numpy; its product with the log probabilities scores all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, packed, text_key
from tessera.llm.ngrams import hashed

ORDERS = (1, 2, 3)
#: Hash slots, and languages at most: the matrix has 4 bytes for each pair, 128 MB at most.
SLOTS = 1 << 16
LANGUAGES = 512
#: Texts of a language that are learned from, at most about: a larger language is sampled by a hash of the text.
PER_LANGUAGE = 4000
#: Cells of the matrix that are gathered at once.
CELLS = 1 << 21
UNKNOWN = "und"


def slots_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of texts, ascending, and the hash slot of an n-gram of each, some at a time."""
    shift = np.uint64(64 - (SLOTS.bit_length() - 1))
    for owner, h in hashed(texts, ORDERS):
        yield owner, (h >> shift).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # slot x language, float32
    prior: np.ndarray

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """Log prior plus log likelihood of each text in each language, CELLS cells at a time."""
        out = np.repeat(self.prior[None, :], len(texts), axis=0)
        step = max(1, CELLS // max(1, len(self.languages)))
        for owner, slots in slots_of(texts):
            for at in range(0, len(slots), step):
                own = owner[at : at + step]
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                out[own[starts]] += np.add.reduceat(self.matrix[slots[at : at + step]], starts, axis=0, dtype=np.float64)
        return out

    def predict_all(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred: the likeliest language (the first by name of equals), score: its posterior probability."""
        out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts))})
        some = [i for i, t in enumerate(texts) if self.languages and t is not None and any(map(str.isalpha, t))]
        if some:
            total = self.totals([texts[i] for i in some])
            best = total.argmax(axis=1)
            score = 1 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0)).sum(axis=1)
            out.loc[some, "lang_pred"], out.loc[some, "score"] = [self.languages[i] for i in best], score
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        row = self.predict_all([text]).iloc[0]
        return row["lang_pred"], float(row["score"])


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model of the languages of rows whose text and language aren't null.

    Of each language `per_language` texts are learned from, about, and no more: distinct ones, chosen by a hash of the
    text; the priors are those of all rows, repeated ones too. More than LANGUAGES languages are an error.
    """
    rows = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros(0))
    spark = rows.sparkSession
    rates = spark.createDataFrame([(x, min(1.0, per_language / counts[x])) for x in languages], "lang string, rate double")
    chance = F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(rates), "lang").where(chance < F.col("rate")).select("lang", "text")
    chosen = chosen.withColumn("key", text_key(F.col("text"))).dropDuplicates(["lang", "key"]).select("lang", "text")

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for pdf in pdfs:
            for lang, texts in pdf.groupby("lang")["text"]:
                n = seen.setdefault(lang, np.zeros(SLOTS, np.int64))
                for _, slots in slots_of(texts.tolist()):
                    n += np.bincount(slots, minlength=SLOTS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "slot": at, "n": n[at]})

    found = chosen.mapInPandas(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # a row for each cell at most
    matrix = np.full((SLOTS, len(languages)), 0.5)
    matrix[found["slot"].to_numpy(np.int64), found["lang"].map(languages.index).to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
    prior = np.array([counts[x] for x in languages], float)
    return Model(languages, np.log(matrix / matrix.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row: the columns `keep` of docs, or all, as a struct, lang_pred, score: 0 to 1; 0 for `und`) of every row.

    Whole texts are scored, a batch of rows at a time. Null texts and those without a letter are `und`, as is everything
    if nothing was learned. Repeated rows stay; equal texts have equal results; of equally likely languages the first by
    name is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes for each of SLOTS x LANGUAGES cells at most

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = shared.value.predict_all(texts.tolist())
        give_back()
        return found

    return docs.select(packed(keep), of(F.col(text_col)).alias("predicted")).select("row", "predicted.*")
