"""Quality by nearest-neighbour voting among latent-semantic vectors.

A text's terms are pairs of neighbouring byte classes (letters, capitals, digits, each common
punctuation mark, lead bytes of other letters) and a few pairs of bins of its shape: repeated lines,
repeated words, word length, length.  Counts are damped by logarithms and weighted by inverse document
frequency; a truncated singular value decomposition of the training sample (randomised range finder,
Halko, Martinsson, Tropp, 2011) gives the latent space.  The labelled vectors are broadcast; every
text is compared with all of them by exact blocked cosine products, and its NEIGHBOURS nearest vote
with their similarity.

Training: at most BOUND texts of each label, by the hash of their ids, so the broadcast holds at most
2 * BOUND * RANK numbers and the term weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bytescan as B
from quillon.llm.common import fold, labelled, read

FOLDS, HELD = 3, 1
#: Documented bound of the training sample: texts of each label.
BOUND = 1500
RANK = 48
NEIGHBOURS = 15
#: Exponent that sharpens the weight of similarity.
SHARP = 8

_MARKS = b"\n .,;:!?%&*#$|-_'\"()/@<>="
CLASSES = 64
CLASS = np.full(256, 63, np.int64)
CLASS[0x61:0x7B] = np.arange(26)
CLASS[0x41:0x5B] = 26
CLASS[0x30:0x3A] = 27
for _i, _c in enumerate(_MARKS):
    CLASS[_c] = 28 + _i
CLASS[0x80:0xC0] = 28 + len(_MARKS)
CLASS[0xC0:] = 29 + len(_MARKS)
SHAPES, BINS = 6, 16
TERMS = CLASSES * CLASSES + SHAPES * BINS


def _distinct_share(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return np.bincount(r[fresh], minlength=rows) / np.maximum(1, np.bincount(row, minlength=rows))


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Damped counts, a row for each text."""
    rows, n = len(offsets) - 1, len(data)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    kind = CLASS[data]
    inner = row[1:] == row[:-1] if n else np.zeros(0, bool)
    index = row[:-1][inner] * TERMS + (kind[:-1] * CLASSES + kind[1:])[inner] if n else np.zeros(0, np.int64)
    counts = np.bincount(index, minlength=rows * TERMS).reshape(rows, TERMS).astype(np.float32)
    np.log1p(counts, out=counts)
    size = np.maximum(1, np.diff(offsets))
    wrow, ws, we, wh = B.words(data, offsets, B.SOLID_BYTES)
    line = np.ones(256, bool)
    line[10] = False
    lrow, ls, le, lh = B.words(data, offsets, line)
    many = np.maximum(1, np.bincount(wrow, minlength=rows))
    letter = (kind <= 26) | (kind >= 28 + len(_MARKS))
    shape = (
        _distinct_share(lrow, lh, rows),
        _distinct_share(wrow, wh, rows),
        np.bincount(wrow, weights=we - ws, minlength=rows) / many / 20,
        np.bincount(row, weights=letter, minlength=rows) / size,
        np.bincount(row, weights=kind == 26, minlength=rows) / size,
        np.log2(1 + np.diff(offsets)) / 20,
    )
    for i, x in enumerate(shape):
        at = np.clip(x * BINS, 0, BINS - 1).astype(np.int64)
        counts[np.arange(rows), CLASSES * CLASSES + i * BINS + at] = 4.0
    return counts


class Voters:
    def __init__(self, counts: np.ndarray, y: np.ndarray, rank: int = RANK):
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        x = self.weighted(counts)
        generator = np.random.default_rng(1)
        q = generator.standard_normal((TERMS, min(rank + 16, max(1, len(x))))).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.basis = (q @ vt.T)[:, :rank].astype(np.float32)
        self.vectors = self.unit(x @ self.basis)
        self.y = y.astype(np.float32)
        # both labels weigh the same whatever their numbers
        self.weight = np.where(y == 1, 0.5 / max(1e-9, (y == 1).mean()), 0.5 / max(1e-9, (y == 0).mean())).astype(np.float32)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        return self.unit(counts * self.idf)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(1e-9, np.sqrt((x * x).sum(axis=1, keepdims=True)))

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        like = self.unit(self.weighted(counts) @ self.basis) @ self.vectors.T
        k = min(neighbours, like.shape[1])
        near = np.argpartition(-like, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(like, near, axis=1), 1e-6) ** SHARP * self.weight[near]
        return np.clip((vote * self.y[near]).sum(axis=1) / vote.sum(axis=1), 0, 1)


def fit(documents: DataFrame, labels: DataFrame, bound: int = BOUND) -> Voters | float:
    """The voters; the share of label 1 where the labels don't have both values."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in B.blocks(batch.column(0), 1 << 20, 64):
                counts = terms(data, offsets).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in counts], pa.binary()), batch.column(1).slice(a, b - a)], names=["counts", "y"])

    rows = labelled(documents, labels, "quality", FOLDS, HELD, bound).orderBy("doc_id").select("text", "y").mapInArrow(run, "counts binary, y int").collect()
    y = np.array([r.y for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return Voters(np.stack([np.frombuffer(r.counts, np.float16) for r in rows]).astype(np.float32), y)


def score(documents: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; null texts are empty and scored like any other."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, bound))

    def run(batches):
        model = shared.value
        for batch in batches:
            for a, b, data, offsets in B.blocks(batch.column(1), 1 << 20, 256):
                s = model.scores(terms(data, offsets)).astype(float) if isinstance(model, Voters) else np.full(b - a, model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s)], names=["doc_id", "score"])

    out = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the labelled neighbours' votes.

    A null text is empty, and empty texts are scored like others.  A row for each row, null ids (never held out, as crc32 of
    an empty text) and repeats included; repeated labels of an id count as the largest, its texts as the smallest.  Among neighbours
    of equal likeness at the border, those that the partition puts first vote, the same for the same input.  Without labels
    of both kinds the score is the share of label 1, or 0.5; an empty table gives no rows.  Further columns aren't read.
    """
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
