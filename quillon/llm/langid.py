"""Language identification with hyperdimensional profiles.

Each symbol (31 classes of lower-cased letters, and one for everything between words) has a random
vector of -1 and 1.  A trigram's vector binds them with their places: the first symbol's vector
rotated twice, times the second's rotated once, times the third's (Joshi, Halseth, Kanerva, 2016).
A text is bundled into the sum of its trigrams' vectors, a language into the sum of its training
texts'; a text has the language of the prototype with the largest cosine, after the mean of the
prototypes, which all languages share, is taken from both.

Bundling is linear, so prototypes come from trigram counts that Spark sums over all training texts
before anything is exchanged, and texts are bundled by a product of counts and vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bytescan as B
from quillon.llm.common import fold, read

FOLDS, HELD = 4, 2
DIMENSIONS = 512
SYMBOLS = 32
GRAMS = SYMBOLS**3
#: Turns cosines into shares.
TEMPERATURE = 0.05
_table: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """Code point -> 0 for no letter, else 1 to 31 by the lower-case letter: a to z, then the rest by hash."""
    if not _table:
        out = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = ord(c.lower()) if len(c.lower()) == 1 else i
                out[i] = low - 0x60 if 0x61 <= low <= 0x7A else 27 + low * 2654435761 % (1 << 32) * 5 // (1 << 32)
        _table.append(out)
    return _table[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, trigram) of all trigrams with a letter in the middle or at the end, and each row's letters."""
    rows = len(offsets) - 1
    starts = (data & 0xC0) != 0x80
    count = np.concatenate(([0], np.cumsum(starts)))[offsets]
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = symbols()[code].astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(count))
    letters = np.bincount(row[symbol > 0], minlength=rows)
    # runs of other characters are one, and stand at both ends of a text too
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0) | (row[1:] != row[:-1])
    symbol, row = symbol[keep], row[keep]
    one = np.zeros(len(symbol), np.int64)
    two = np.zeros(len(symbol), np.int64)
    one[1:] = np.where(row[1:] == row[:-1], symbol[:-1], 0)
    two[2:] = np.where(row[2:] == row[:-2], symbol[:-2], 0)
    gram = (two * SYMBOLS + one) * SYMBOLS + symbol
    real = (one > 0) | (symbol > 0)
    return row[real], gram[real], letters


def vectors(active: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vectors of trigrams, a row each."""
    letter = np.random.default_rng(2016).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
    first, second = np.roll(letter, 2, axis=1), np.roll(letter, 1, axis=1)
    return (first[active // SYMBOLS**2] * second[active // SYMBOLS % SYMBOLS] * letter[active % SYMBOLS]).astype(np.float32)


def _counted(batches):
    """(text, lang) -> (lang, gram, n), summed over a task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for a, b, data, offsets in B.blocks(batch.column(0), 1 << 20, 1 << 30):
            row, gram, _ = grams(data, offsets)
            names = sorted(set(langs[a:b]))
            of = np.array([names.index(x) for x in langs[a:b]])
            n = np.bincount(of[row] * GRAMS + gram, minlength=len(names) * GRAMS).reshape(len(names), GRAMS)
            for name, x in zip(names, n, strict=True):
                total[name] = total.get(name, 0) + x
    for name, x in total.items():
        at = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array([name] * max(1, len(at))), pa.array(at if len(at) else np.zeros(1, np.int64)), pa.array(x[at].astype(np.int64) if len(at) else np.zeros(1, np.int64))], names=["lang", "gram", "n"])


class Profiles:
    def __init__(self, langs: list[str], counts: np.ndarray, dimensions: int = DIMENSIONS):
        """counts: a row of trigram counts for each language."""
        self.langs = langs
        self.active = np.flatnonzero(counts.sum(axis=0))
        self.of = np.full(GRAMS, -1, np.int64)
        self.of[self.active] = np.arange(len(self.active))
        self.dimensions, self._vectors = dimensions, None
        share = counts[:, self.active] / np.maximum(1, counts.sum(axis=1, keepdims=True))
        prototypes = share.astype(np.float32) @ vectors(self.active, dimensions)
        self.mean = prototypes.mean(axis=0) if len(langs) > 1 else np.zeros(dimensions, np.float32)
        self.prototypes = self.unit(prototypes - self.mean)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(1e-9, np.sqrt((x * x).sum(axis=1, keepdims=True)))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        if self._vectors is None:
            self._vectors = vectors(self.active, self.dimensions)
        rows = len(offsets) - 1
        row, gram, letters = grams(data, offsets)
        if not self.langs:
            return ["und"] * rows, np.zeros(rows)
        at = self.of[gram]
        row, at = row[at >= 0], at[at >= 0]
        n = np.bincount(row * len(self.active) + at, minlength=rows * len(self.active)).reshape(rows, len(self.active)).astype(np.float32)
        n /= np.maximum(1, n.sum(axis=1, keepdims=True))
        like = self.unit(n @ self._vectors - self.mean) @ self.prototypes.T
        best = like.argmax(axis=1)
        power = np.exp((like - like.max(axis=1, keepdims=True)) / TEMPERATURE)
        top = (1 / power.sum(axis=1)).astype(float)
        known = letters > 0
        return [self.langs[i] if k else "und" for i, k in zip(best, known, strict=True)], np.where(known, top, 0.0)


def fit(documents: DataFrame) -> Profiles:
    """Profiles of every language among the training rows; all of them are counted."""
    train = documents.where("lang is not null").where(fold(F.col("doc_id"), FOLDS) != HELD).select(F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string"))
    # a row for each language and trigram: GRAMS rows a language at most
    found = train.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), GRAMS))
    counts[found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64), found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return Profiles(langs, counts)


def identify(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score for every row: ``und`` and 0 for null texts and those without a letter."""
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in B.blocks(batch.column(1), 1 << 20, 64):
                lang, s = shared.value.predict(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(s)], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document.

    ``und`` and 0 for a null text and one without a letter, and for all where nothing was learnt.  A row for each row; repeated rows count
    in the profiles as often as they stand there.  Equally near languages: the first by name.  An empty table gives no rows; further columns aren't read.
    """
    documents = read(spark, sf_dir, "documents")
    return identify(documents, fit(documents)).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
