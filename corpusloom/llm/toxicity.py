"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded sample: of each class the :data:`SAMPLE` labelled
texts of least hash, equal texts once. An n-gram (:data:`ORDERS` code points of
the lower-case text, white space as one blank) counts once a text. The first
:data:`PILOT` texts of each class tell :data:`CANDIDATES` n-grams, which are
then counted over the whole sample. Of those in at least :data:`LEAST` sampled
texts, the :data:`FEATURES` whose log-count ratio

    r = log ((texts of class 1 with it + 1) / (texts of class 1 + 2)) - log (the same of class 0)

is the most standard errors away from 0 become features; a text's vector has r
where it holds the n-gram, and Spark's logistic regression with an L2 penalty
is fitted on it. Counting, selecting and fitting are Spark jobs; the model (at
most FEATURES numbers) goes to the tasks.

Scoring reads whole texts in one pass without a shuffle. N-grams are known by
64-bit hashes: a table of 2^20 marks passes over nearly all that are no
features, and the rest are looked up exactly. Scores use the text only.

Labels with a remainder (crc32 of the id, mod 5) of 0 are never learnt from; a
document with a null id is told by the id's text being one blank, and has no
label. Defined cases: null and empty texts are a blank alone and get the score
of a text without features; very long texts are read whole; a document labelled
more than once counts as toxic if any label is 1; labels that are null or not 0
or 1 are no labels; without labels of both classes every score is the share of
class 1 among the labels (one half if there are none); repeated rows stay, an
empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import read_table, stored

#: Texts of each class that training takes at most, and of those the ones whose n-grams are all counted.
SAMPLE, PILOT = 20_000, 1_000
CANDIDATES = 50_000
#: Features at most, and the sampled texts that must hold one.
FEATURES, LEAST = 20_000, 5
ORDERS = (3, 4, 5, 6, 8)
#: The L2 penalty of the regression, for the mean loss.
PENALTY = 0.0003
FOLDS = 5
_MARKS = 20
_K = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of each order, in order of place."""
    code = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (code == 32) | (code - np.uint32(9) < 5)
    code = np.where(blank, np.uint32(32), code)[np.concatenate(([True], ~(blank[1:] & blank[:-1])))].astype(np.uint64)
    h = np.full(len(code) + 1, 0x51_7C_C1_B7, np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(code) < n:
            return
        h = h[:-1] ^ code[n - 1 :]
        h *= _K
        if n in ORDERS:
            yield h.view(np.int64)


class Model:
    """Weights of n-grams, sorted by hash, and the intercept."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray, intercept: float):
        order = np.argsort(grams)
        self.grams, self.weights, self.intercept = grams[order], weights[order], intercept
        self.marks = np.zeros(1 << _MARKS, bool)
        self.marks[self._mark(self.grams)] = True

    @staticmethod
    def _mark(grams: np.ndarray) -> np.ndarray:
        return (grams.view(np.uint64) >> np.uint64(64 - _MARKS)).view(np.int64)

    def held(self, text: str | None) -> np.ndarray:
        """Indices of the features that the text holds."""
        found = [g[self.marks.take(self._mark(g))] for g in ngrams(text)]
        if not found or not len(self.grams):
            return np.zeros(0, np.int64)
        some = np.concatenate(found)
        at = np.minimum(np.searchsorted(self.grams, some), len(self.grams) - 1)
        has = np.zeros(len(self.grams), bool)
        has[at[self.grams[at] == some]] = True
        return np.flatnonzero(has)

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[self.held(text)].sum())
        return float(1 / (1 + np.exp(-z))) if z >= 0 else float(np.exp(z) / (1 + np.exp(z)))


def _fold(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(" ")).cast("binary")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, pilot: int = PILOT) -> DataFrame:
    """(text, y, pilot): at most ``most`` distinct texts of each class, those of least hash, of labels outside the held-out fold."""
    told = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y")).where(_fold("doc_id") != 0)
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select("doc_id", F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("h1"))
    # which texts is settled on hashes alone; one that has both labels counts as toxic
    kinds = stored(hashed.join(told, "doc_id").groupBy("h", "h1").agg(F.max("y").alias("y")), "toxic-hashes")
    first = lambda y, n: kinds.where(F.col("y") == y).orderBy("h", "h1").limit(n)
    early = first(0, pilot).union(first(1, pilot)).select("h", "h1", F.lit(True).alias("pilot"))
    chosen = first(0, most).union(first(1, most)).join(early, ["h", "h1"], "left").withColumn("pilot", F.coalesce("pilot", F.lit(False)))
    chosen = stored(chosen, "toxic-sample")
    rows = docs.select(text.alias("text")).select("text", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("h1"))
    # twice SAMPLE rows of three numbers at most
    return rows.join(F.broadcast(chosen), ["h", "h1"]).groupBy("h", "h1", "y", "pilot").agg(F.first("text").alias("text")).select("text", "y", "pilot")


def _ranked(texts: DataFrame, size: tuple, least: int, most: int, known: Model | None = None) -> Model:
    """The ``most`` n-grams (of ``known`` ones, if given) with the clearest log-count ratios, which are their weights. ``size``: texts of class 0 and 1."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for y, rows in batch.groupby("y")["text"]:
                own = [known.grams[known.held(t)] if known else np.unique(np.concatenate(list(ngrams(t)) or [np.zeros(0, np.int64)])) for t in rows]
                grams, n = np.unique(np.concatenate(own), return_counts=True)
                yield pd.DataFrame({"gram": grams, "y": y, "n": n})

    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    counts = texts.mapInPandas(counted, "gram long, y int, n long").groupBy("gram").agg(of(1).alias("p"), of(0).alias("q")).where(F.col("p") + F.col("q") >= least)
    p, q = F.col("p") + 1.0, F.col("q") + 1.0
    r = F.log(p / (size[1] + 2.0)) - F.log(q / (size[0] + 2.0))
    ranked = counts.select("gram", r.alias("r"), (F.abs(r) / F.sqrt(1 / p + 1 / q)).alias("away")).orderBy(F.desc("away"), "gram").limit(most)
    table = ranked.toPandas()  # at most ``most`` rows
    return Model(table["gram"].to_numpy(np.int64), table["r"].to_numpy(np.float64), 0.0)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model learnt from labelled documents outside the held-out fold."""
    texts = stored(sample(docs, labels), "toxic-texts")
    sizes = {(r["y"], r["pilot"]): r["count"] for r in texts.groupBy("y", "pilot").count().collect()}
    early = tuple(sizes.get((y, True), 0) for y in (0, 1))
    size = tuple(n + sizes.get((y, False), 0) for y, n in enumerate(early))
    if not all(size):
        share = size[1] / sum(size) if sum(size) else 0.5
        edge = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(edge / (1 - edge))))
    near = _ranked(texts.where("pilot").select("text", "y"), early, 2, CANDIDATES)
    plain = _ranked(texts.select("text", "y"), size, LEAST, FEATURES, near)

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "at": [plain.held(t) for t in batch["text"]]})

    width, ratios = max(1, len(plain.grams)), plain.weights
    vector = F.udf(lambda at: Vectors.sparse(width, at, ratios[at]), VectorUDT())  # on the sample only
    rows = stored(texts.select("text", "y").mapInPandas(indexed, "y int, at array<int>"), "toxic-rows").select(F.col("y").cast("double").alias("label"), vector("at").alias("features"))
    learner = LogisticRegression(maxIter=100, regParam=PENALTY, elasticNetParam=0.0, standardization=False, tol=1e-8)
    found = learner.fit(rows)
    return Model(plain.grams, found.coefficients.toArray()[: len(plain.grams)] * plain.weights, float(found.intercept))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": [model.score(t) for t in batch["text"]]})

    out = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(run, "id string, score double")
    out = out.withColumn("doc_id", F.col("id").cast(docs.schema["doc_id"].dataType))
    return out.select("doc_id", (_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fitted(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic")))
