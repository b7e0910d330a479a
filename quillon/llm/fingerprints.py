"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes (h = 2 h + gear[byte], so 32 bits look 32 bytes back) and a
chunk ends where its low bits vanish.  Chunk sizes are normalised as in FastCDC (Xia and others,
USENIX ATC 2016): until the expected size more bits must vanish, after it fewer; a chunk has LEAST
bytes at least and MOST at most.  An edit moves the borders near it only, so the chunk digests
elsewhere stay.  A fingerprint is the sorted set of chunk digests with the chunks' lengths; the
likeness of two is the length of the shared chunks by the length of the smaller set (containment).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bytescan as B
from quillon.llm.common import read, shuffle_partitions

LEAST, EXPECTED, MOST = 16, 48, 256
STRICT, LOOSE = np.uint32((1 << 7) - 1), np.uint32((1 << 4) - 1)
GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sums of shifted table values, doubled in reach five times."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        shifted = h[:-k] << np.uint32(k) if len(h) > k else h[:0]
        h = h.copy()
        h[k:] += shifted
    return h


def borders(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text (from its own start).  Hashes look back within the text alone."""
    h = gear(data)
    loose = np.flatnonzero((h >> np.uint32(24)) & LOOSE == 0) + 1
    strict = (((h >> np.uint32(24)) & STRICT) == 0)[loose - 1].tolist()
    ends = loose.tolist()
    out, k = [], 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        cuts, start = [], a
        while k < len(ends) and ends[k] <= a:
            k += 1
        while b - start > LEAST:
            low, middle, high = start + LEAST, start + EXPECTED, min(start + MOST, b)
            # no hash that reaches before the text's first byte counts
            while k < len(ends) and (ends[k] < low or ends[k] < a + 32):
                k += 1
            j = k
            while j < len(ends) and ends[j] < middle and not strict[j]:
                j += 1
            start = ends[j] if j < len(ends) and ends[j] <= high else high
            cuts.append(start - a)
            while k < len(ends) and ends[k] <= start:
                k += 1
        if start < b:
            cuts.append(b - a)
        out.append(cuts)
    return out


def fingerprint(text: bytes, cuts: list[int]) -> dict[str, int]:
    """Digest -> length of the different chunks."""
    found, at = {}, 0
    for c in cuts:
        found[hashlib.blake2b(text[at:c], digest_size=6).hexdigest()] = c - at
        at = c
    return found


def written_out(found: dict[str, int]) -> str:
    return " ".join(f"{d}:{n}" for d, n in sorted(found.items()))


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """1 for two empty sets, 0 if one is empty."""
    if not a or not b:
        return float(not a and not b)
    less = min(sum(a.values()), sum(b.values()))
    return min(1.0, sum(n for d, n in a.items() if d in b) / less)


def fingerprints_of(texts: list[str]) -> list[dict[str, int]]:
    out = []
    column = pa.array(texts, pa.large_string())
    for _, _, data, offsets in B.blocks(column):
        raw = data.tobytes()
        for i, cuts in enumerate(borders(data, offsets)):
            out.append(fingerprint(raw[offsets[i] : offsets[i + 1]], cuts))
    return out


def with_fingerprint(documents: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a map of digests to lengths, for every row; nulls are empty texts."""

    def run(batches):
        kind = pa.map_(pa.string(), pa.int32())
        for batch in batches:
            found = fingerprints_of([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(x.items()) for x in found], kind)], names=["doc_id", "chunks"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, chunks map<string,int>")


def _bucket(order: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``order``, looked up in two steps of about sqrt(n)."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*(F.lit(g[0]) for g in groups))
    at = F.size(F.filter(heads, lambda x: x <= order))
    inner = F.element_at(F.array(*(F.array(*(F.lit(x) for x in g)) for g in groups)), F.greatest(at, F.lit(1)))
    return F.when(at == 0, 0).otherwise((at - 1) * step + F.size(F.filter(inner, lambda x: x <= order)))


def neighbours(documents: DataFrame) -> DataFrame:
    """(bucket, doc_id, text, guest) for a sorted pass: each bucket ends with the next one's first row.

    Rows go in descending doc_id, nulls last (beside them the smallest long); equal ids by their text's hash.  Buckets are
    ranges of doc_id between approximate quantiles; a doc_id (or null) that holds several quantiles is split by ranges of
    that hash, so that no id is one task's.  The first row of each bucket is sent to the bucket before it too, as a
    guest (with it, rows of the same id and text), and the very first to the last bucket.
    """
    spark = documents.sparkSession
    order = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(2**63 - 1))
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), order.alias("place"), F.xxhash64(text).alias("hash"))
    parts = shuffle_partitions(spark)
    cuts = rows.agg(F.percentile_approx("place", [i / parts for i in range(1, parts)] or [0.5], 100 * parts).alias("b")).first().b or []
    bounds = sorted(set(cuts))
    # ranges of the hash that each bound's own rows take, and the number of the first
    ranges = [1] + [cuts.count(x) if cuts.count(x) > 1 else 0 for x in bounds]
    base = [sum(ranges[:i]) + i for i in range(len(ranges))]
    number = lambda values: F.array(*(F.lit(x).cast("long") for x in values))
    main, share = _bucket(F.col("place"), bounds), F.col("hash") / F.lit(2.0**64) + 0.5
    many = F.get(number(ranges), F.col("main"))
    own = F.get(number([0, *bounds]), F.col("main")) == F.col("place")
    split = F.when((F.col("main") > 0) & own & (many > 0), F.least(F.floor(share * many), many - 1)).otherwise(many)
    placed = rows.withColumn("main", main).withColumn("bucket", (F.get(number(base), F.col("main")) + split).cast("int")).drop("main")
    # the first place of each bucket that has rows: as many as partitions, twice at most
    first = sorted((r.bucket, r.low.place, r.low.hash) for r in placed.select("bucket", "place", "hash").groupBy("bucket").agg(F.min(F.struct("place", "hash")).alias("low")).collect())
    of = {b: (place, h, first[i - 1][0]) for i, (b, place, h) in enumerate(first)}
    low, low_hash, before = zip(*(of.get(b, (0, 0, 0)) for b in range(max(of, default=0) + 1)), strict=True)
    at = F.col("bucket")
    guests = F.when((F.get(number(low), at) == F.col("place")) & (F.get(number(low_hash), at) == F.col("hash")), F.get(number(before), at).cast("int"))
    to = F.filter(F.array(F.struct(at.alias("bucket"), F.lit(False).alias("guest")), F.struct(guests.alias("bucket"), F.lit(True).alias("guest"))), lambda x: x["bucket"].isNotNull())
    spread = placed.select(F.explode(to).alias("to"), "doc_id", "text", "place", "hash").select("to.bucket", "to.guest", "doc_id", "text", "place", "hash")
    return spread.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", "place", "hash", "text").select("bucket", "guest", "doc_id", "text")


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compared(batches):
    """Sorted rows -> each row with its successor."""
    held = None  # (bucket, doc_id, text, chunks)
    for batch in batches:
        buckets, guests, ids, texts = (c.to_pylist() for c in batch.columns)
        for at in range(0, len(ids), 256):
            own = texts[at : at + 256]
            chunks = fingerprints_of(own)
            pending = []
            closed = held[4] if held else False
            for i, (text, found) in enumerate(zip(own, chunks, strict=True), at):
                if held and held[0] == buckets[i] and not closed:
                    pending.append((held[1], held[2], held[3], text, found))
                # a guest closes its bucket; only the first one is the successor
                closed = guests[i] if held is None or held[0] != buckets[i] else closed or guests[i]
                held = (buckets[i], ids[i], text, found, closed)
            if not pending:
                continue
            changed = [edited(t, after) for _, t, _, after, _ in pending]
            new = fingerprints_of(changed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pending], pa.int64()),
                    pa.array([len(p[1]) for p in pending], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array([written_out(p[2]) for p in pending]),
                    pa.array([written_out(x) for x in new]),
                    pa.array([containment(p[2], x) for p, x in zip(pending, new, strict=True)]),
                    pa.array([containment(p[2], p[4]) for p in pending]),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and of its edited text.

    A null text is empty; two empty texts are alike (1), an empty and another one aren't (0).  Rows with one doc_id, or with
    none, go by their text's hash, nulls last, and each gets a row; a single row follows itself.  An empty table gives no rows;
    further columns aren't read.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(read(spark, sf_dir, "documents")).mapInArrow(_compared, schema)
