"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, are compared pair by pair; a text's features are the
log-likelihood ratio of its different pairs over their number and over the root of it, and one logistic fit on
labelled texts that the models haven't counted turns them into a score.  Insults are inflected, so a word is read as its
first 4 bytes, its first 6 bytes and the whole word, as far as it has them: pairs are (opening of the
word before, opening), (opening, longer opening) and (longer opening, word).  A form that was never
seen is still known by its opening.  The models are interpolated:

    p_c(w | v) = (n_c(v, w) - D)+ / n_c(v) + D t_c(v) / n_c(v) * p_c(w)
    p_c(w)     = (n_c(w) - D)+ / n_c + D m_c / n_c * p(w)
    p(w)       = (k(w) - D)+ / k + D m / k / (m + 1)

n counts the texts with a pair (a line repeated in one text counts once), t the different units
after v, k(w) the different units before w (the Kneser-Ney continuation counts, which both classes share, so that an
expression that is rare in one of them falls back on the same counts in both), m the units with any.

Weights.  A ratio x counts for x * max(LEAST_WEIGHT, 1 - (s / z)^2), z being the log odds of its counts over their
standard error, s = UNIT_SIGMA or PAIR_SIGMA; a pair's x is what it adds to its unit's.  So chance adds little,
whatever the number of units, and ratios count in full as counts grow.  Copied texts repeat their rare units after the same words, so the
squared error of a unit grows by its texts per different word before it (by a 64-bit sketch, where that isn't full).

Counts: units are hashed to 2^19 slots, so the counts by unit have a fixed size; pairs of slots are counted over all labelled
texts outside the held-out fold, added up in each task, dealt by their second unit and added up again.  Only the logistic fit
has a bound, BOUND / CALIBRATE texts of each class by the hash of their ids, which aren't counted.  Pairs whose weighted ratio
is under NEGLIGIBLE are left to their unit's.  Should more than SHARD be left, they are broadcast shard by shard, and each adds its part
to the texts' sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import bytescan as B
from quillon.llm.common import fold, read, shuffle_partitions, written

FOLDS, HELD = 5, 0
#: Documented bound of the logistic fit: one in CALIBRATE of so many texts of each class.
BOUND = 2000
#: Ratios of pairs that are broadcast at once (16 bytes each).
SHARD = 1_000_000
#: Labelled ids that are broadcast at most (10 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Standard errors below which a ratio is taken as chance.
UNIT_SIGMA, PAIR_SIGMA = 3.5, 6.0
LEAST_WEIGHT, NEGLIGIBLE = 0.01, 0.05
DISCOUNT = 0.75
#: Bytes of a word's openings.
OPENINGS = (4, 6)
#: Units are hashed to 2**SLOT_BITS slots.
SLOT_BITS = 19
#: Bits of a unit's 64 from which its sketch of words before it counts as full.
FULL = 56
#: Pairs that a task holds before it passes their counts on.
HELD_PAIRS = 1 << 21
#: One in so many labelled texts, up to the bound, is kept from counting, for the logistic fit.
CALIBRATE = 4
#: Scores are for equally frequent classes, moved by this share of the labels' log odds.
PRIOR = 0.5
_SLOTS = 1 << SLOT_BITS
_SLOT = B.U64(SLOT_BITS)
_PAIR = B.U64((1 << 2 * SLOT_BITS) - 1)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(row, slots, present): of each word its openings and the word itself, and which of them it has."""
    row, start, end = B.spans(data, offsets, B.WORD_BYTES)
    hashes = [h ^ B.U64(i) for i, h in enumerate(B.hashes(data, start, end, [*(np.minimum(start + k, end) for k in OPENINGS), end]))]
    return row, [B.mix(h) >> B.U64(64 - SLOT_BITS) for h in hashes], [np.ones(len(row), bool), *(end - start > k for k in OPENINGS)]


def _after(row: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The slot of the word before each word; 0 for a text's first."""
    out = np.zeros(len(row), B.U64)
    out[1:] = np.where(row[1:] == row[:-1], slot[:-1], B.U64(0))
    return out


def pairs(row: np.ndarray, slots: list[np.ndarray], present: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, pair) of the different pairs of each text; a pair is its second unit, then its first."""
    rows, found = [row], [slots[0] << _SLOT | _after(row, slots[0])]
    for k in range(1, len(slots)):
        rows.append(row[present[k]])
        found.append(slots[k][present[k]] << _SLOT | slots[k - 1][present[k]])
    key = np.unique(np.concatenate(rows).astype(B.U64) << B.U64(2 * SLOT_BITS) | np.concatenate(found))
    return (key >> B.U64(2 * SLOT_BITS)).astype(np.int64), key & _PAIR


def _summed_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys, sorted, and the sums of each's values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[head], *(np.add.reduceat(v[order], head) if len(head) else v for v in values)


def _bounds(parts: int) -> np.ndarray:
    """The first slot of each part, and a closing bound."""
    return (np.arange(parts + 1) * _SLOTS + parts - 1) // parts


def _counted(parts: int):
    """(text, y) -> (part, kind, blob): pairs with their numbers of texts by class (kind 0), and units with their sketches (kind 1)."""
    starts = _bounds(parts).astype(B.U64)

    def dealt(kind, key, first, pack):
        at = np.searchsorted(key, first)
        full = np.flatnonzero(np.diff(at))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), kind, np.int32)), pa.array([pack(p, slice(at[p], at[p + 1])) for p in full], pa.binary())], names=["part", "kind", "blob"])

    def passed(held):
        key, n0, n1 = _summed_by(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def pack(p, s):
            steps = np.diff(key[s], prepend=starts[p] << _SLOT)  # small numbers, which compress well
            return np.array([s.stop - s.start], np.uint32).tobytes() + steps.astype(np.uint32).tobytes() + n0[s].astype(np.uint32).tobytes() + n1[s].astype(np.uint32).tobytes()

        return dealt(0, key, starts << _SLOT, pack)

    def run(batches):
        held, size, sketch = [], 0, np.zeros(_SLOTS, B.U64)
        for batch in batches:
            ys = batch.column(1).to_numpy()
            for a, b, data, offsets in B.blocks(batch.column(0)):
                row, slots, present = units(data, offsets)
                if not len(row):
                    continue
                bit = B.mix(_after(row, slots[-1]) + B.U64(77)) >> B.U64(58)
                seen = np.unique(np.concatenate([slots[k][present[k]] << B.U64(6) | bit[present[k]] for k in range(len(slots))]))
                np.bitwise_or.at(sketch, (seen >> B.U64(6)).astype(np.int64), B.U64(1) << (seen & B.U64(63)))
                r, key = pairs(row, slots, present)
                of = ys[a:b][r]
                held.append(_summed_by(key, (of == 0).astype(np.int64), (of == 1).astype(np.int64)))
                size += len(held[-1][0])
                if size >= HELD_PAIRS:
                    yield passed(held)
                    held, size = [], 0
        if held:
            yield passed(held)
        slot = np.flatnonzero(sketch)
        if len(slot):
            yield dealt(1, slot.astype(B.U64), starts, lambda p, s: slot[s].astype(np.uint32).tobytes() + sketch[slot[s]].tobytes())

    return run


def _merged(parts: int):
    """The blobs of a part -> (kind, id, n0, n1, t0, t1): pairs (0), sums by first unit (1) and by second unit (2), different words before a unit (3)."""
    starts = _bounds(parts).astype(B.U64)

    def rows(kind, key, *values):
        n = len(key)
        columns = [*values, *([np.zeros(n, np.int64)] * (4 - len(values)))]
        for i in range(0, n, 200_000):
            j = slice(i, i + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[j]), kind, np.int32)), pa.array(key[j].astype(np.int64)), *(pa.array(c[j].astype(np.int64)) for c in columns)], names=["kind", "id", "n0", "n1", "t0", "t1"])

    def run(batches):
        held, sketch = [], np.zeros(_SLOTS, B.U64)
        for batch in batches:
            for p, kind, blob in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), strict=True):
                raw = blob.as_buffer()
                if kind:
                    n = raw.size // 12
                    sketch[np.frombuffer(raw, np.uint32, n)] |= np.frombuffer(raw[4 * n :].to_pybytes(), B.U64, n)
                    continue
                n = int(np.frombuffer(raw, np.uint32, 1)[0])
                steps, n0, n1 = np.frombuffer(raw, np.uint32, 3 * n, 4).reshape(3, n)
                held.append(((starts[p] << _SLOT) + np.cumsum(steps.astype(B.U64)), n0.astype(np.int64), n1.astype(np.int64)))
        if held:
            key, n0, n1 = _summed_by(*(np.concatenate(x) for x in zip(*held, strict=True)))
            del held
            many = n0 + n1 > 1
            yield from rows(0, key[many], n0[many], n1[many])
            yield from rows(1, *_summed_by(key & B.U64(_SLOTS - 1), n0, n1, (n0 > 0).astype(np.int64), (n1 > 0).astype(np.int64)))
            yield from rows(2, *_summed_by(key >> _SLOT, n0, n1, np.ones(len(key), np.int64)))
        slot = np.flatnonzero(sketch)
        yield from rows(3, slot, np.bitwise_count(sketch[slot]).astype(np.int64))

    return run


def _weight(x: np.ndarray, n0: np.ndarray, n1: np.ndarray, more: np.ndarray, sigma: float) -> np.ndarray:
    error = more * (1 / (n0 + 0.5) + 1 / (n1 + 0.5))
    return np.maximum(LEAST_WEIGHT, 1 - sigma * sigma * error / np.maximum(x * x, 1e-12))


def _of_units(table: pa.Table) -> dict[str, np.ndarray]:
    """By slot: p_c (p0, p1), the weighted ratio (alone), texts (nv0, nv1) and different units (tv0, tv1) after it, and the growth of its error (more)."""
    kind, at = table.column("kind").to_numpy(), table.column("id").to_numpy()

    def dense(k, name):
        out = np.zeros(_SLOTS)
        out[at[kind == k]] = table.column(name).to_numpy()[kind == k]
        return out

    d, k, n = DISCOUNT, dense(2, "t0"), [dense(2, "n0"), dense(2, "n1")]
    bits = dense(3, "n0")
    before = np.maximum(1, -64 * np.log(np.maximum(1 - bits / 64, 1 / 64)))
    more = np.where(bits >= FULL, 1.0, np.maximum(1.0, (n[0] + n[1]) / before))
    total, m = max(1.0, k.sum()), (k > 0).sum()
    base = np.maximum(k - d, 0) / total + d * m / total / (m + 1) + 1e-12
    p = [np.maximum(x - d, 0) / max(1.0, x.sum()) + (d * (x > 0).sum() / x.sum() if x.any() else 1.0) * base for x in n]
    x = np.where(k > 0, np.log(p[1]) - np.log(p[0]), 0.0)
    alone = np.where(n[0] + n[1] > 1, x * _weight(x, n[0], n[1], more, UNIT_SIGMA), 0.0)
    return {"p0": p[0], "p1": p[1], "alone": alone, "more": more, **{f"{a}v{y}": dense(1, f"{a}{y}") for a in "nt" for y in (0, 1)}}


def _of_pairs(held, texts: tuple[int, int]):
    """(id, n0, n1) of pairs -> (key, value): what they add to their second unit's ratio, unless that is negligible."""

    def run(batches):
        u, d = held.value, DISCOUNT
        for batch in batches:
            key, *n = (batch.column(i).to_numpy() for i in range(3))
            w, v = key >> SLOT_BITS, key & (_SLOTS - 1)
            p = []
            for y in (0, 1):
                after = np.maximum(u[f"nv{y}"][v], 1)
                p.append(np.maximum(n[y] - d, 0) / after + np.where(u[f"nv{y}"][v] > 0, d * u[f"tv{y}"][v] / after, 1.0) * u[f"p{y}"][w])
            x = np.log(p[1]) - np.log(p[0]) - u["alone"][w]
            odds = np.log((n[1] + 0.5) / (n[0] + 0.5)) - np.log((texts[1] + 0.5) / (texts[0] + 0.5)) - u["alone"][w]
            value = np.where(np.sign(x) == np.sign(odds), np.sign(x) * np.minimum(np.abs(x), np.abs(odds)), 0.0) * _weight(odds, n[0], n[1], u["more"][w], PAIR_SIGMA)
            keep = np.abs(value) >= NEGLIGIBLE
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(value[keep])], names=["key", "value"])

    return run


class Model:
    """The units' ratios, the written ones of pairs by shard, and the logistic fit."""

    def __init__(self, alone: np.ndarray, table: DataFrame, shards: int, slopes: tuple[float, float] = (1.0, 0.0), intercept: float = 0.0, share: float = 0.0):
        self.alone, self.table, self.shards, self.slopes, self.intercept, self.share = alone, table, shards, slopes, intercept, share

    def shard(self, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(pairs, what they add), sorted, of one shard; and the units' ratios with the first."""
        rows = self.table.where(F.col("shard") == s).select("key", "value").toArrow()
        key, value = rows.column("key").to_numpy().view(B.U64), rows.column("value").to_numpy()
        order = np.argsort(key)
        return key[order], value[order], self.alone.astype(np.float32) if not s else None


def part_sums(data: np.ndarray, offsets: np.ndarray, held: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the ratios of a shard, different pairs) of each text."""
    rows, (keys, values, alone) = len(offsets) - 1, held
    row, key = pairs(*units(data, offsets))
    value = np.zeros(len(key)) if alone is None else alone[(key >> _SLOT).astype(np.int64)].astype(float)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        value += np.where(keys[at] == key, values[at], 0.0)
    return np.bincount(row, weights=value, minlength=rows), np.bincount(row, minlength=rows)


def summed(texts: DataFrame, model: Model, name: str) -> DataFrame:
    """texts (text first) with ``name``: the sum of the ratios and n, the number of different pairs."""
    spark = texts.sparkSession

    def adding(held, first):
        def run(batches):
            for batch in batches:
                sums, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
                for _, _, data, offsets in B.blocks(batch.column(0)):
                    x, n = part_sums(data, offsets, held.value)
                    sums.append(x)
                    counts.append(n)
                x, n = np.concatenate(sums), np.concatenate(counts)
                columns = batch.columns if first else batch.columns[:-1]
                x = x if first else x + batch.columns[-1].field("sum").to_numpy()
                yield pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays([pa.array(x), pa.array(n.astype(np.int64))], names=["sum", "n"])], names=names)

        return run

    names = [*texts.columns, name]
    added = T.StructType([T.StructField("sum", T.DoubleType()), T.StructField("n", T.LongType())])
    schema, out = T.StructType([*texts.schema.fields, T.StructField(name, added)]), texts
    for s in range(model.shards):
        out = out.mapInArrow(adding(spark.sparkContext.broadcast(model.shard(s)), s == 0), schema)
        B.give_back()
        out = out if s == model.shards - 1 else written(out, "toxic-sums")  # one shard in memory at a time
    return out


def _features(name: str) -> tuple:
    return F.col(f"{name}.sum") / F.col(f"{name}.n"), F.col(f"{name}.sum") / F.sqrt(f"{name}.n")


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and intercept by Newton's method, with a weak prior on the slopes; both classes weigh the same."""
    if len(np.unique(y)) < 2:
        return np.eye(1, x.shape[1])[0], 0.0
    scale = x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack((x / scale, np.ones(len(x))))
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    b, prior = np.zeros(z.shape[1]), np.array([1e-2] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(prior), z.T @ (weight * (p - y)) + prior * b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b[:-1] / scale, float(b[-1])


def training(documents: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(text, y, later): all labelled rows outside the held-out fold, one for each doc_id as in ``labelled``; later ones are for the logistic fit."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(fold(F.col("doc_id"), FOLDS) != HELD).groupBy("doc_id").agg(F.max("y").alias("y"))
    kept = None
    for y in (0, 1):
        few = marks.where((F.col("y") == y) & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(CALIBRATE)) == 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, bound // CALIBRATE)).select("doc_id", F.lit(True).alias("later"))
        kept = few if kept is None else kept.unionByName(few)
    marks = written(marks.join(F.broadcast(kept), "doc_id", "left").select("doc_id", "y", F.coalesce("later", F.lit(False)).alias("later")), "toxic-marks")
    few = marks.count() <= BROADCAST_IDS
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marks) if few else marks, "doc_id")
    # texts pass a shuffle only where an id has more than one row
    twice = written(documents.select("doc_id").join(F.broadcast(marks) if few else marks, "doc_id", "left_semi").groupBy("doc_id").count().where("count > 1").select("doc_id"), "toxic-twice")
    n = twice.count()
    if n:
        many = F.broadcast(twice) if n <= BROADCAST_IDS else twice
        one = texts.join(many, "doc_id", "left_semi").groupBy("doc_id", "y", "later").agg(F.min("text").alias("text"))
        texts = texts.join(many, "doc_id", "left_anti").unionByName(one)
    return texts.select("text", "y", "later")


def fit(documents: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    """Without labels of both classes all scores are the share of toxic labels.  Repeated ids count once; null ids not at all."""
    spark = documents.sparkSession
    train = training(documents, labels, bound)
    parts = max(64, shuffle_partitions(spark))  # a part's pairs fit 32 bits
    blobs = train.where("not later").select("text", "y").mapInArrow(_counted(parts), "part int, kind int, blob binary").repartition(parts, "part")
    counts = written(blobs.mapInArrow(_merged(parts), "kind int, id long, n0 long, n1 long, t0 long, t1 long"), "toxic-counts")
    # at most three rows a slot
    known = _of_units(counts.where("kind > 0").groupBy("kind", "id").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "t0", "t1"))).toArrow())
    marked = labels.where("toxic in (0, 1) and doc_id is not null").where(fold(F.col("doc_id"), FOLDS) != HELD)
    toxic, n = marked.agg(F.sum("toxic"), F.count("*")).first()
    held, alone = spark.sparkContext.broadcast(known), known["alone"]
    del known
    B.give_back()
    found = written(counts.where("kind = 0").select("id", "n0", "n1").mapInArrow(_of_pairs(held, (n - (toxic or 0), toxic or 0)), "key long, value double"), "toxic-ratios")
    shards = max(1, -(-found.count() // SHARD))
    model = Model(alone, found.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))), shards)
    share = (toxic or 0) / n if n else 0.0
    x = summed(train.where("later").select("text", "y"), model, "x").where("x.n > 0").select("y", *(f.alias(c) for f, c in zip(_features("x"), "ab", strict=True))).toArrow()
    slopes, intercept = logistic(np.column_stack((x["a"].to_numpy(), x["b"].to_numpy())), x["y"].to_numpy())
    odds = np.clip(share, 1e-3, 1 - 1e-3)
    model.slopes, model.share = tuple(map(float, slopes)), float(share)
    model.intercept = intercept + PRIOR * float(np.log(odds / (1 - odds)))
    return model


def with_toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """documents with ``toxicity``, from 0 to 1.  Texts without words get the share of toxic labels."""
    rest = [c for c in documents.columns if c not in ("toxicity", "text")]
    a, b = _features("toxicity")
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.slopes[0] * a + model.slopes[1] * b + model.intercept))
    score = F.when(F.col("toxicity.n") > 0, 1 / (1 + F.exp(-x))).otherwise(model.share)
    return summed(documents.select("text", *rest), model, "toxicity").withColumn("toxicity", score)


def score(documents: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; null texts are empty, empty tables give empty results."""
    model = fit(documents, labels, bound)
    texts = documents.select(F.col("doc_id").cast("long"), "text")
    return with_toxicity(texts, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the two language models.

    Texts without words (null, empty) get the share of toxic labels.  A row for each row, null ids (held out by crc32 of an empty
    text) and repeats included; repeated labels of an id count as the largest, its texts as the smallest.  Equal texts have
    equal scores.  Without labels of both classes all scores are that share; an empty table gives no rows.  Further columns aren't read.
    """
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
