"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its hashed words, the shapes of its words (case, trailing signs, repetition of the
word before) and bands of its length and of its share of repeated word triples. Term weights
(logarithmic counts times inverse document frequency) are reduced to `rank` latent dimensions by the
leading eigenvectors of their Gram matrix. The vectors and labels of the fitting sample are broadcast:
`most_labelled` rows at most, taken by hash, which bounds the model's size whatever the corpus. Every
text is multiplied with all of them in blocks, and its `k` nearest, with all that tie with the last of
them, vote with weights that fall with their distance.

Scores use the text alone. Defined cases: a null or empty text has only its length band and is scored
like other texts; a null doc_id is never in the sample and not held out; repeated labels of a document
count once (their smallest), and of texts that share a labelled doc_id the smallest is learnt; labels without a document, and null labels, are left out; without any
label of either kind every score is the share of label 1, or 0.5 without labels; extra columns are
ignored or kept (`classified`); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import frugal, release, table, tidy

WORDS, SHAPES, BANDS = 1024, 512, 64
DIM = WORDS + SHAPES + BANDS


def _shapes(data: np.ndarray, h: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A code below SHAPES for each word: its case, its last two bytes if they're signs, whether it repeats the word before."""
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower = np.concatenate([[0], np.cumsum(((data >= 97) & (data <= 122)) | (data >= 128))])
    up, low = upper[b] - upper[a], lower[b] - lower[a]
    case = np.where(up == 0, 0, np.where((low == 0) & (up > 1), 2, 1)) + 3 * ((up + low) == 0)
    sign = lambda x: np.where((x < 48) | ((x > 57) & (x < 65)) | ((x > 90) & (x < 97)) | ((x > 122) & (x < 128)), x, 0).astype(np.uint64)
    last, before = sign(data[b - 1]), np.where(b - a > 1, sign(data[np.maximum(b - 2, 0)]), 0).astype(np.uint64)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[at[:-1][at[:-1] < at[1:]]] = False
    code = ((case.astype(np.uint64) * np.uint64(256) + last) * np.uint64(256) + before) * np.uint64(2) + same.astype(np.uint64)
    return (shingles.mix(code, 21) % np.uint64(SHAPES)).astype(np.int64)


def features(column: pa.Array) -> np.ndarray:
    """Raw term weights, one row of DIM numbers a text."""
    out = []
    for _, rows, data, off in shingles.text_slices(column):
        x = np.zeros((rows, DIM), np.float32)
        h, at, _, _ = shingles.words(data, off, shingles.PLAIN)
        row = np.repeat(np.arange(rows), np.diff(at))
        x[:, :WORDS] = np.log1p(np.bincount(row * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=rows * WORDS).reshape(rows, WORDS))
        h, at, a, b = shingles.words(data, off)
        n = np.diff(at)
        row = np.repeat(np.arange(rows), n)
        count = np.bincount(row * SHAPES + _shapes(data, h, at, a, b), minlength=rows * SHAPES).reshape(rows, SHAPES)
        x[:, WORDS : WORDS + SHAPES] = np.sqrt(count / np.maximum(n, 1)[:, None])
        s = shingles.shingle_hashes(h, 3)
        for i in range(rows):
            x[i, WORDS + SHAPES + min(int(n[i]).bit_length(), 20)] = 0.3
            m = int(n[i]) - 2
            if m > 0:
                part = np.sort(s[at[i] : at[i] + m])
                again = np.count_nonzero(part[1:] == part[:-1]) / m
                x[i, WORDS + SHAPES + 21 + int(np.ceil(again * 20))] = 0.6
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, DIM), np.float32)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int
    width: float
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = weighted(x, self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        """Share of label 1 among the k nearest, weighted by exp((cosine - best cosine) / width)."""
        out = np.full(len(x), self.prior)
        if not len(self.labels):
            return out
        for i in range(0, len(x), block):
            out[i : i + block] = self.vote(self.latent(x[i : i + block]) @ self.vectors.T)
        return out

    def vote(self, cosine: np.ndarray) -> np.ndarray:
        cosine = np.round(cosine.astype(np.float64), 5)  # below the noise of single precision, so that equal texts tie
        k = min(self.k, cosine.shape[1])
        last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
        row, near = np.nonzero(cosine >= last[:, None])
        w = np.exp((cosine[row, near] - cosine.max(axis=1)[row]) / self.width)
        return np.bincount(row, w * self.labels[near], len(cosine)) / np.bincount(row, w, len(cosine))


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Terms times idf; words and shapes each scaled to length 1, so that neither drowns the other."""
    x = x * idf
    for a, b, s in ((0, WORDS, 0.6), (WORDS, WORDS + SHAPES, 1.0)):
        x[:, a:b] *= s / np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-9)
    return x


def fitted(x: np.ndarray, labels: np.ndarray, rank: int = 64, k: int = 15, width: float = 0.05, block: int = 512) -> Model:
    """The model of some features, which are weighted in blocks of rows, as the driver holds them beside their Gram matrix."""
    n = len(x)
    if not n or len(np.unique(labels)) < 2:
        return Model(np.ones(DIM, np.float32), np.zeros((DIM, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), k, width, float(labels.mean()) if n else 0.5)
    idf = np.log((1 + n) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + np.float32(0.1)
    idf[WORDS:] = 1
    gram = np.zeros((DIM, DIM))
    for i in range(0, n, block):
        y = weighted(x[i : i + block].astype(np.float32), idf).astype(np.float64)
        gram += y.T @ y
    axes = np.linalg.eigh(gram)[1][:, ::-1][:, : min(rank, n)].astype(np.float32)
    m = Model(idf, axes, np.zeros((0, 1), np.float32), labels.astype(np.float64), k, width, float(labels.mean()))
    m.vectors = np.concatenate([m.latent(x[i : i + block].astype(np.float32)) for i in range(0, n, block)])
    return m


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 4096) -> Model:
    """Fits the model on at most most_labelled labelled texts of docs(doc_id, text), the first by the hash of their id."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("quality").alias("quality"))

    @frugal
    def task(batches):
        for b in _few(batches):
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["doc_id", "quality", "x"])

    rows = texts.mapInArrow(task, "doc_id long, quality double, x binary").toArrow().sort_by("doc_id")
    x = np.concatenate([np.zeros(0, np.float16), *(np.frombuffer(v.as_buffer(), np.float16) for v in rows.column("x"))]).reshape(-1, DIM)
    quality = rows.column("quality").to_numpy().copy()
    del rows
    release()
    tidy(docs.sparkSession, 0)
    model = fitted(x, quality)
    del x
    release()
    return model


def _few(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts, as their features take DIM numbers a row."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns named in keep, and each row's score from its whole text."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double")

    @frugal
    def task(batches):
        for b in _few(batches):
            score = known.value.score(features(b.column("text")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(score)], names=[*keep, "score"])

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(task, schema)


def classified(docs: DataFrame, labels: DataFrame, *keep: str, least: float = 0.7) -> DataFrame:
    return scored(docs, train(docs, labels), *keep).withColumn("predicted", (F.col("score") >= least).cast("int"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Score and class of every document by the neighbours of its whole text."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return classified(docs, labels, "doc_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
