"""Operator 7: a quality classifier by nearest-neighbour voting.

A text is described by the shapes of its words (letters, capitals, digits and marks, runs cut short), how many
words repeat the one before, and how many are distinct. Shares are weighed by inverse document frequency over all
documents and projected on the leading singular vectors of a sample of labelled rows (latent semantic
analysis). The sample's vectors, of a bounded number, are broadcast; every document's cosine with every one of
them is computed exactly, in blocks, and the labels of the NEIGHBOURS nearest vote, weighted by similarity.

The sample is the LABELLED / 2 rows of each label with the smallest hash of the id, among the training labels.
A bound on labelled rows is the one thing here that doesn't cover all data.

Defined cases: null and empty texts get the share of label 1 in the training labels, 0.5 if there is none; ids labelled
twice count as the mean label, rounded; repeated rows score alike; an empty table gives no rows; ids, languages and
sources are never looked at; labels without a text are left out.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import as_bytes, fresh, tidy, words

LABELLED, NEIGHBOURS, LATENT, FEATURES = 4096, 15, 48, 1024
#: Rows whose crc32(doc_id as text) mod FOLDS is 0 are never learnt from.
FOLDS, THRESHOLD = 5, 0.3
#: The last features: repeats of the word before, and eight levels of the share of distinct words.
_REPEAT, _LEVEL = FEATURES - 9, FEATURES - 8


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def shape(word: str) -> str:
    """Letters as a, A or digits as 0, other characters as they are; runs of one kind are cut to two."""
    out: list[str] = []
    for c in word:
        k = "0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            out.append(k)
    return "".join(out)


class Shapes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = zlib.crc32(shape(word.decode("utf-8", "replace")).encode()) % _REPEAT
        return value


def features(text: bytes | str | None, shapes: Shapes) -> np.ndarray:
    """Square roots of feature shares; all 0 for a text without words."""
    ws = words(text)
    x = np.zeros(FEATURES, np.float32)
    if ws:
        n = len(ws)
        x[:_REPEAT] = np.bincount(np.fromiter(map(shapes.__getitem__, ws), np.int64, n), minlength=_REPEAT)
        x[_REPEAT] = sum(map(operator.eq, ws[1:], ws))
        x /= n
        # how many words are distinct, against what a text of this length has at most
        x[_LEVEL + min(7, int(8 * len(set(ws)) / n))] = 0.25
        np.sqrt(x, out=x)
    return x


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, df = Shapes(), np.zeros(FEATURES + 1, np.int64)
        for b in batches:
            for v in b.column(0):
                x = features(v.as_py(), shapes)
                df[:-1] += x > 0
                df[-1] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["feature", "df"])

    out = np.zeros(FEATURES + 1, np.int64)
    for r in docs.select(as_bytes(text_col)).mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        out[r.feature] = r.df
    return out[:-1], int(out[-1])


class Votes:
    """The fitted classifier: weights (features), axes (features, latent), unit vectors and labels of the sample."""

    def __init__(self, weights: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, prior: float, k: int = NEIGHBOURS):
        self.weights, self.axes, self.vectors, self.labels, self.prior, self.k = weights, axes, vectors, labels, prior, k

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weights) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        some = np.flatnonzero(x.any(1))
        if not len(self.vectors) or not len(some):
            return out
        near = self.project(x[some]) @ self.vectors.T
        k = min(self.k, len(self.vectors))
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 1e-6).astype(np.float64) ** 8
        out[some] = (weight * self.labels[top]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def latent_axes(x: np.ndarray, latent: int) -> np.ndarray:
    """Leading right singular vectors, by the Gram matrix of the features."""
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    keep = np.argsort(-values)[: min(latent, len(values))]
    return vectors[:, keep].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Votes:
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).filter("_id is not null and _label is not null")
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.round(F.avg("_label")).cast("int").alias("_label"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    pick = lambda y: known.filter(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(labelled // 2)
    sample = pick(0).unionByName(pick(1))
    df, n = document_frequencies(docs, text_col)
    weights = np.log1p(n / (1.0 + df)).astype(np.float32)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in batches:
            xs = [features(v.as_py(), shapes).tobytes() for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(xs, pa.binary())], ["id", "label", "x"])

    # the sample has `labelled` rows at most
    found = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("_id"))
    texts = found.select(F.col("_id").cast("long"), "_label", "text")
    rows = texts.mapInArrow(run, "id long, label int, x binary").groupBy("id").agg(F.min(F.struct("x", "label")).alias("m")).orderBy("id").collect()
    x = np.array([np.frombuffer(r.m.x, np.float32) for r in rows]) if rows else np.zeros((0, FEATURES), np.float32)
    y = np.array([r.m.label for r in rows], np.float64)
    x, y = x[x.any(1)], y[x.any(1)]
    axes = latent_axes(x * weights, LATENT) if len(x) else np.zeros((FEATURES, 1), np.float32)
    votes = Votes(weights, axes, x[:0], y, prior)
    votes.vectors = votes.project(x) if len(x) else np.zeros((0, axes.shape[1]), np.float32)
    return votes


def score_column(votes: Votes, text: Column, block: int = 512) -> Column:
    """The score of a text column, as an Arrow-batched function."""

    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shapes = Shapes()
        for texts in batches:
            out = [votes.score(np.array([features(t, shapes) for t in texts.iloc[k : k + block]])) for k in range(0, len(texts), block)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0), dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, with quality_score and quality_predicted (with a leading _ for each column so named already)."""
    votes = fit(docs, labels, id_col, text_col, label_col)
    score, predicted = fresh(docs, "quality_score", "quality_predicted")
    scored = docs.withColumn(score, score_column(votes, F.coalesce(as_bytes(text_col), F.lit(b""))))
    return scored.withColumn(predicted, F.when(F.col(score) >= threshold, 1).otherwise(0))


def good_documents(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns."""
    scored = classify(docs, labels, **columns)
    return scored.filter(F.col(scored.columns[-1]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
