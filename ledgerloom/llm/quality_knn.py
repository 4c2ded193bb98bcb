"""Quality by nearest-neighbour voting in a latent-semantic space (operator 7).

Terms are pairs of neighbouring bytes, by class (letters as they are, one class for digits,
one for non-ASCII letters), hashed to DIMS columns; weights are logarithmic counts times the
inverse document frequency over all documents. The space is that of the leading singular
vectors of a sample of labelled documents, of at most `sample` rows by hash of doc_id; one
more column holds the share of words that repeat the word before them. The sample's bound makes
the broadcast vectors bounded as well. Each document takes part whole; its cosine with every
labelled vector is computed in blocks, and its `neighbours` nearest vote, each with the eighth
power of its similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import _WHITE, buffer_of, pieces, words_of

DIMS = 2048
_CLASS = np.zeros(256, np.uint32)
_CLASS[33:127] = np.arange(1, 95)
_CLASS[48:58] = 95
_CLASS[128:] = 96
_CLASS[np.flatnonzero(_WHITE)] = 97
_CLASS[0x0A] = 98


def term_counts(texts: pa.Array) -> np.ndarray:
    """A row for each text, a column for each term."""
    buf, off = buffer_of(texts)
    n = len(off) - 1
    c = _CLASS[buf]
    code = ((c[:-1] * np.uint32(2654435761) + c[1:] * np.uint32(40503) * np.uint32(2246822519)) >> np.uint32(7)) % np.uint32(DIMS) if len(c) > 1 else c[:0]
    doc = np.repeat(np.arange(n), np.diff(off))
    same = doc[1:] == doc[:-1]
    return np.bincount(doc[1:][same] * DIMS + code[same], minlength=n * DIMS).reshape(n, DIMS)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1500) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def repeats(texts: pa.Array) -> np.ndarray:
    """The share of each text's words that equal the word before."""
    w = words_of(texts)
    doc = w.doc()
    same = doc[1:][(w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])]
    return np.bincount(same, minlength=len(texts)) / np.maximum(w.count(), 1)


def _weighted(counts: np.ndarray, idf: np.ndarray, share: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    x = np.append(x, 2 * share.astype(np.float32)[:, None], axis=1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def leading_space(x: np.ndarray, dims: int) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration."""
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((x.shape[1], dims + 16)).astype(np.float32))[0]
    for _ in range(6):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :dims].astype(np.float32)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4096, dims: int = 64, neighbours: int = 31) -> DataFrame:
    """docs (text; all columns are kept, score replaced) with score: the similarity-weighted
    share of label 1 among the nearest labelled documents, from 0 to 1.

    labels (doc_id, label): rows with a null in either are left out, several rows of one
    doc_id count by their mean. A text without terms (null, empty or one character) gets the
    mean label of the sample; without any labels all get 0.5. Only text goes into a score.
    Repeated documents are scored alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("score")
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for b in _small(batches):
            total += (term_counts(b.column("text")) > 0).sum(axis=0)
            n += b.num_rows
        yield pa.RecordBatch.from_pydict({"term": np.arange(DIMS + 1), "n": np.append(total, n)})

    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # DIMS + 1 rows
    df = np.zeros(DIMS + 1)
    for r in found:
        df[r.term] = r.n
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            x = _weighted(term_counts(b.column("text")), idf, repeats(b.column("text")))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "y": b.column("y"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    # at most `sample` rows
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = known.select("doc_id", "y", "text").mapInArrow(vectors, "doc_id long, y double, x binary")
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").collect()  # of several texts of one doc_id, one
    y = np.array([r.y for r in rows], np.float32)
    space = held = np.zeros((0, 0), np.float32)
    if len(rows):
        x = np.stack([np.frombuffer(r.x, np.float32) for r in rows])
        space = leading_space(x, min(dims, len(rows)))
        held = x @ space
        held /= np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-12)
    mean = float(y.mean()) if len(y) else 0.5
    sent = spark.sparkContext.broadcast((idf, space, held, y))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, space, held, y = sent.value
        for b in _small(batches):
            out = np.full(b.num_rows, mean)
            texts = b.column("text")
            counts = term_counts(texts)
            some = np.flatnonzero(counts.any(axis=1))
            if len(y) and len(some):
                z = _weighted(counts[some], idf, repeats(texts)[some]) @ space
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                k = min(neighbours, len(y))
                for at in range(0, len(some), 500):
                    near = z[at : at + 500] @ held.T
                    best = np.argpartition(near, len(y) - k, axis=1)[:, len(y) - k :]
                    weight = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** 8 + 1e-6
                    out[some[at : at + 500]] = (weight * y[best]).sum(axis=1) / weight.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.clip(out, 0, 1), pa.float64())], [*b.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(score, StructType([*rows.schema.fields, StructField("score", DoubleType())]))
