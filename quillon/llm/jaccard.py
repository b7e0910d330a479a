"""Exact set-similarity join on word shingles by universe partition and pigeonhole.

The universe of 5-word shingles is hashed into segments, m at each level of frequency, m fixed for a
band of set sizes (Arasu, Ganti, Kaushik, VLDB 2006; Deng, Li, Wen, Feng, VLDB 2016).  Two sets of
p <= q shingles with J >= t differ in at most D(p) = (1-t)/(1+t) * (p + p/t) shingles, and what they
differ in is the sum over the segments.  A segment that isn't empty gains 1: it matches, or at least one
shingle of it differs.  With its one-deletion neighbourhood, one of two or more shingles gains 2: it
matches while at most one differs.  Empty segments gain nothing and aren't indexed.

Each set indexes a subset of its segments: the first ones that gain D(p) + 1.  No pair is lost by that:
of two linked sets, take the one that indexes fewer segments.  They gain more than the sets differ
in, so one of them matches in the other set, which indexes it too.  Should all segments of both gain too
little (sets whose shingles fall on few segments), both also index their first p - ceil(t * p) + 1 shingles,
of which linked sets share one (Chaudhuri, Ganti, Kaushik, ICDE 2006).

Allocation: how many segments and whether they take their one-deletion neighbourhoods is chosen for each
band by a cost model: index entries, plus those of a single shingle once more, plus the entries of sets that
gain too little.  Frequent shingles have segments of their own that come after the others, by level, so that common
lines stay out of most subsets.  The shingles of all rows are counted for that, each as itself: sorted in each task, dealt by
their first bits and added up.  The counts only decide what is cheap; any partition of the universe is exact.

A set is indexed for its own band and, where partners can lie there, for the next larger one.

Buckets: equal sets fall together first (they are one node).  Buckets of at most SMALL nodes
are compared completely.  Larger ones give each node's pair with the bucket's smallest node; as
J's complement is a metric, a node that isn't linked with the smallest one, at distance d, can only
be linked with nodes whose distance from it is within 1 - t of d.  In a second round such nodes of
different components are compared by their sketches, in blocks of at most BLOCK nodes a side.  Where
sizes or sketches already tell that d is over 2 * (1 - t), it isn't computed, and the node is compared
with all others of the bucket that aren't linked with the smallest one.  Of the nodes that the sketches can't tell
from it, each has its CLOSEST ones verified; then components are joined, and while a node has more
such partners in other components, the round goes on with eight times as many.  Every pair is
verified on the whole sets.
"""

from __future__ import annotations

from functools import lru_cache
from math import erfc, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bytescan as B
from quillon.llm.common import read, shuffle_partitions, written

WORDS = 5
PERCENT = 75
SMALL = 4
#: Shingles in OFTEN rows are frequent, in larger tables those in OFTEN of each ROWS rows, or in OFTEN * MOST rows.  That limit must not go on
#: growing with the table: buckets of shingles just below it would too, and with them the pairs to look at.  FREQUENT of them are
#: broadcast at most (9 bytes each), the most frequent.
OFTEN, ROWS, MOST, FREQUENT = 3, 8192, 6, 1 << 21
#: Shingles that a task sorts before it passes their counts on, and the bits of a shingle by which these are dealt.
HELD_SHINGLES, GROUP_BITS = 1 << 21, 10
#: Levels of frequent shingles; each holds four times the frequency of the one before.
LEVELS = 3
#: The sizes of a band lie within this factor.
BAND = 2
#: Up to so many document ids are broadcast (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Nodes of a bucket's smallest node that are compared with as many others in one task.
BLOCK = 2048
CLOSEST = 3
#: Stands for a distance that is only known to be over 2 * (1 - t).
FAR = 2.0
_MASK = np.uint64((1 << 52) - 1)


def difference(p, percent: int = PERCENT):
    """The largest symmetric difference of a set of p elements and one not smaller that is linked with it."""
    return (100 - percent) * (p + p * 100 // percent) // (100 + percent)


def prefix(p, percent: int = PERCENT):
    """How many of its first shingles a set of p elements indexes where its segments gain too little."""
    return p - (percent * p + 99) // 100 + 1


@lru_cache(maxsize=None)
def bands(upto: int) -> list[tuple[int, int]]:
    """[low, high] of each band of sizes."""
    out, low = [], 1
    while low <= upto:
        out.append((low, BAND * low - 1))
        low *= BAND
    return out


def _cost(p: int, m: int, paired: bool, percent: int) -> float:
    """Of a set of p rare shingles with m segments; the sizes of segments are taken as Poisson."""
    need, mean = difference(p, percent) + 1, p / m
    p0 = exp(-mean)
    p1, p2 = mean * p0, mean * mean / 2 * p0
    if paired:
        gain, square = p1 + 2 * (1 - p0 - p1), p1 + 4 * (1 - p0 - p1)
    else:
        gain = square = 1 - p0
    spread = sqrt(max(m * (square - gain * gain), 1e-9))
    missing = 0.5 * erfc((m * gain - need + 0.5) / spread / sqrt(2))
    segments = min(m, need / gain)
    entries = segments * ((1 - p0 + mean - p1) if paired else (1 - p0))
    single = segments * (p1 + 2 * p2 if paired else p1)
    return entries + single + missing * 2 * prefix(p, percent)


@lru_cache(maxsize=None)
def allocation(low: int, high: int, percent: int = PERCENT) -> tuple[int, bool]:
    """(segments of a level, whether they take one-deletion neighbourhoods) that cost least for sets of these sizes."""
    counts = range(1, 2 * high + 1) if high < 64 else sorted({high * k // 100 for k in range(20, 120, 2)})
    return min(((m, paired) for m in counts for paired in (False, True)), key=lambda x: sum(_cost(p, *x, percent) for p in (low, (low + high) // 2, high)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, 52-bit hash) of the distinct shingles, sorted; texts with fewer words give one."""
    rows = len(offsets) - 1
    row, _, _, h = B.words(data, offsets, B.SOLID_BYTES)
    first = B.first_of(row, rows)
    count = np.diff(first)
    n = len(h)
    weights = B.mix(np.arange(1, size + 1, dtype=B.U64) * B.U64(0x9E3779B97F4A7C15)) | B.U64(1)
    parts, owners = [], []
    if n >= size:
        s = np.zeros(n - size + 1, B.U64)
        for k in range(size):
            s += h[k : n - size + 1 + k] * weights[k]
        whole = row[: n - size + 1] == row[size - 1 :]
        parts.append(B.mix(s[whole]))
        owners.append(row[: n - size + 1][whole])
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        s = count[short].astype(B.U64) * B.U64(0xD6E8FEB86659FD93)
        for k in range(size - 1):
            has = count[short] > k
            s[has] += h[first[short][has] + k] * weights[k]
        parts.append(B.mix(s))
        owners.append(short)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, B.U64)
    key = np.unique((np.concatenate(owners).astype(B.U64) << B.U64(52)) | (np.concatenate(parts) & _MASK))
    return (key >> B.U64(52)).astype(np.int64), key & _MASK


def node_keys(row: np.ndarray, sets: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, signed 64-bit key) of each row's whole set; equal sets have equal keys."""
    first = B.first_of(row, rows)
    total = np.zeros(len(sets) + 1, B.U64)
    np.cumsum(B.mix(sets + B.U64(1)), out=total[1:])
    n = np.diff(first)
    return n, B.mix(total[first[1:]] - total[first[:-1]] + n.astype(B.U64)).view(np.int64)


def signatures(row: np.ndarray, sets: np.ndarray, sizes: np.ndarray, often: tuple[np.ndarray, np.ndarray] | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit signature) of the indexed segments of all sets; ``often``: frequent shingles, sorted, and their levels from 1."""
    if not len(sets):
        return np.zeros(0, np.int64), np.zeros(0, B.U64)
    level = np.zeros(len(sets), np.int64)
    if often is not None and len(often[0]):
        at = np.minimum(np.searchsorted(often[0], sets), len(often[0]) - 1)
        level = np.where(often[0][at] == sets, often[1][at], 0).astype(np.int64)
    scheme = bands(int(sizes.max()) * 100 // percent + 1)
    lows = np.array([x[0] for x in scheme])
    own = np.searchsorted(lows, sizes, side="right") - 1
    needs = difference(sizes, percent) + 1
    rows_out, sig_out = [], []
    mixed = B.mix(sets * B.U64(3) + B.U64(7))
    for step in (0, 1):
        band = own + step
        reach = np.ones(len(sizes), bool) if not step else (band < len(scheme)) & (sizes * 100 // percent >= lows[np.minimum(band, len(scheme) - 1)])
        reach &= sizes > 0
        for b in np.unique(band[reach]):
            m, paired = allocation(*scheme[b], percent)
            mine = np.zeros(len(sizes), bool)
            mine[reach & (band == b)] = True
            at = np.flatnonzero(mine[row])
            width = m * (LEVELS + 1)
            place = row[at] * width + level[at] * m + ((sets[at] >> B.U64(8)) * B.U64(m) >> B.U64(44)).astype(np.int64)  # 44 bits, scaled to 0..m-1
            order = np.argsort(place, kind="stable")
            place, values = place[order], mixed[at[order]]
            head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))[: len(place)])
            count = np.diff(np.append(head, len(place)))
            owner = place[head] // width
            gain = np.minimum(count, 2) if paired else np.ones(len(head), np.int64)
            gained = np.concatenate(([0], np.cumsum(gain)))
            bounds = B.first_of(owner, len(sizes))
            before = gained[:-1] - gained[bounds[:-1]][owner]
            keep = before < needs[owner]
            salt = (place[head] % width).astype(B.U64) * B.U64(0x2545F4914F6CDD1D) + B.U64(int(b) * 1_000_003 + m)
            total = np.add.reduceat(values, head)
            sig_out.append(B.mix(total + salt)[keep])
            rows_out.append(owner[keep])
            if paired:  # the segment without each of its elements, while some are left
                group = np.repeat(np.arange(len(head)), count)
                rest = (keep & (count > 1))[group]
                sig_out.append(B.mix(total[group] - values + salt[group])[rest])
                rows_out.append(owner[group][rest])
            poor = mine & (gained[bounds[1:]] - gained[bounds[:-1]] < needs)
            if poor.any():
                at = np.flatnonzero(poor[row])
                at = at[np.argsort(row[at] * (LEVELS + 1) + level[at], kind="stable")]  # equal ones stay sorted by hash
                first = B.first_of(row[at], len(sizes))
                at = at[np.arange(len(at)) - first[row[at]] < prefix(sizes, percent)[row[at]]]
                sig_out.append(B.mix(mixed[at] + B.U64(int(b) * 1_000_003 + 1)))
                rows_out.append(row[at])
    return np.concatenate(rows_out), np.concatenate(sig_out)


def sketches(row: np.ndarray, sets: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Parities: bit b tells whether an odd number of the set's elements hash to b.

    There are at least two bits an element, a power of two and 64 at least.  The bits in which
    two sketches differ are at most the elements in which the sets differ, so a pair that differs
    in more bits than linked sets in elements needs no look at the sets.  Xor of a sketch's halves
    is the sketch of half the size.
    """
    first = B.first_of(row, len(sizes))
    out = []
    for i, n in enumerate(sizes.tolist()):
        bits = max(64, 1 << (2 * n - 1).bit_length()) if n else 64
        odd = np.bincount((sets[first[i] : first[i + 1]] & B.U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
        out.append(np.packbits(odd, bitorder="little").view(np.int64))
    return out


def _nodes(batches):
    """(doc_id, text, hash of the text) -> doc_id, size and key of its set, the hash, and the sketch."""
    for batch in batches:
        for a, b, data, offsets in B.blocks(batch.column(1)):
            row, sets = shingle_sets(data, offsets)
            n, key = node_keys(row, sets, b - a)
            own = sketches(row, sets, n)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
            sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(key), batch.column(2).slice(a, b - a), sketch], names=["doc_id", "n", "key", "hash", "sketch"])


def _counted(batches):
    """Texts -> counts of their shingles, in blobs by first bits: (count of repeated ones, these, their counts, lower 32 bits of single ones, steps between their upper bits)."""

    def blobs(held):
        sets, times = np.unique(np.concatenate(held), return_counts=True)
        bounds = np.arange((1 << GROUP_BITS) + 1, dtype=B.U64) << B.U64(52 - GROUP_BITS)
        single, many, times = sets[times == 1], sets[times > 1], times[times > 1].astype(np.uint32)
        first, first_many = np.searchsorted(single, bounds), np.searchsorted(many, bounds)
        low, high = single.astype(np.uint32), (single >> B.U64(32)).astype(np.int64) & ((1 << 20 - GROUP_BITS) - 1)
        parts, out = [], []
        for g in range(1 << GROUP_BITS):
            x, y = slice(first[g], first[g + 1]), slice(first_many[g], first_many[g + 1])
            if x.start < x.stop or y.start < y.stop:
                parts.append(g)
                out.append(np.array([y.stop - y.start], np.uint32).tobytes() + many[y].tobytes() + times[y].tobytes() + low[x].tobytes() + np.diff(high[x], prepend=0).astype(np.uint16).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(out, pa.binary())], names=["part", "blob"])

    held, size = [], 0
    for batch in batches:
        for _, _, data, offsets in B.blocks(batch.column(0), 2 << 20):
            held.append(shingle_sets(data, offsets)[1])
            size += len(held[-1])
            if size >= HELD_SHINGLES:
                yield blobs(held)
                held, size = [], 0
    if size:
        yield blobs(held)


def _added(least: int):
    """The blobs of a partition -> (shingle, number of rows) of those in ``least`` rows or more."""

    def run(batches):
        single, many, counts = [], [], []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                raw = blob.as_buffer()
                k = int(np.frombuffer(raw, np.uint32, 1)[0])
                many.append(np.frombuffer(raw[4 : 4 + 8 * k].to_pybytes(), B.U64))
                counts.append(np.frombuffer(raw, np.uint32, k, 4 + 8 * k))
                at, n = 4 + 12 * k, (raw.size - 4 - 12 * k) // 6
                high = np.cumsum(np.frombuffer(raw[at + 4 * n :].to_pybytes(), np.uint16), dtype=B.U64)
                single.append((B.U64(int(part)) << B.U64(52 - GROUP_BITS)) | (high << B.U64(32)) | np.frombuffer(raw, np.uint32, n, at).astype(B.U64))
        if not single:
            return
        sets, times = np.unique(np.concatenate(single), return_counts=True)
        del single
        kept = times >= min(least, 2)  # one that stands alone in each of its blobs
        more, which = np.unique(np.concatenate(many), return_inverse=True)
        total = np.bincount(which, np.concatenate(counts), len(more)).astype(np.int64)
        at = np.minimum(np.searchsorted(sets, more), max(0, len(sets) - 1))
        same = sets[at] == more if len(sets) else np.zeros(len(more), bool)
        total[same] += times[at[same]]
        kept[at[same]] = False
        found, total = np.concatenate((sets[kept], more)), np.concatenate((times[kept], total))
        found, total = found[total >= least], total[total >= least]
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total, pa.int64())], names=["s", "times"])

    return run


def _often(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, levels) of the frequent ones by the counts of all rows of texts(text), the FREQUENT most frequent at most."""
    first = OFTEN * max(1, min(MOST, texts.count() // ROWS))
    blobs = texts.select("text").mapInArrow(_counted, "part int, blob binary").repartition(shuffle_partitions(texts.sparkSession), "part")
    counts = blobs.mapInArrow(_added(first), "s long, times long")
    counts = written(counts.select("s", F.least(F.lit(LEVELS), 1 + F.floor(F.log2(F.col("times") / first) / 2)).cast("int").alias("level"), "times"), "jaccard-often")
    least, held = first, 0
    for r in counts.groupBy(F.least(F.col("times"), F.lit(1 << 16)).alias("times")).agg(F.count("*").alias("n")).orderBy(F.desc("times")).collect():
        held += r.n
        if held > FREQUENT:
            least = r.times + 1
            break
    found = counts.where(F.col("times") >= least).select("s", "level").toArrow()
    sets, level = found["s"].to_numpy().astype(B.U64), found["level"].to_numpy().astype(np.uint8)
    order = np.argsort(sets)
    return sets[order], level[order]


def _spread(parts: int, often):
    """documents(text) -> for each block of texts and each partition, one blob of index entries.

    A blob holds the block's node keys and, sorted by signature, (32 bits of signature, 16 bits of node).
    """

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in B.blocks(batch.column(0), 2 << 20):
                row, sets = shingle_sets(data, offsets)
                n, key = node_keys(row, sets, b - a)
                _, one = np.unique(key, return_index=True)  # equal sets of a block are indexed once
                single = np.zeros(b - a, bool)
                single[one] = True
                chosen = single[row]
                r, sig = signatures(row[chosen], sets[chosen], np.where(single, n, 0), often.value)
                if not len(r):
                    continue
                part = ((sig >> B.U64(32)) * B.U64(parts) >> B.U64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, r, low = part[order], r[order].astype(np.uint16), sig[order].astype(np.uint32)
                bounds = np.searchsorted(part, np.arange(parts + 1))
                full = np.flatnonzero(np.diff(bounds))
                blobs = []
                for p in full:
                    s = slice(bounds[p], bounds[p + 1])
                    nodes, local = np.unique(r[s], return_inverse=True)
                    blobs.append(np.array([len(nodes)], np.uint32).tobytes() + key[nodes].tobytes() + low[s].tobytes() + local.astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return run


def _pairs(batches):
    """The blobs of a partition -> pairs of node keys to verify; ``star`` marks pairs of large buckets."""
    sigs, nodes = [], []
    for batch in batches:
        part = batch.column(0).to_numpy()
        for p, blob in zip(part, batch.column(1), strict=True):
            raw = blob.as_buffer()
            count = int(np.frombuffer(raw, np.uint32, 1)[0])
            key = np.frombuffer(raw, np.int64, count, 4)
            n = (raw.size - 4 - 8 * count) // 6
            sigs.append(np.frombuffer(raw, np.uint32, n, 4 + 8 * count).astype(B.U64) | (B.U64(int(p)) << B.U64(32)))
            nodes.append(key[np.frombuffer(raw, np.uint16, n, 4 + 8 * count + 4 * n)])
    if not sigs:
        return
    sig, key = np.concatenate(sigs), np.concatenate(nodes)
    del sigs, nodes
    # signatures that stand alone go first: most do
    order = np.argsort(sig, kind="stable")
    sig, key = sig[order], key[order]
    del order
    same = sig[1:] == sig[:-1]
    twin = np.zeros(len(sig), bool)
    twin[1:] |= same
    twin[:-1] |= same
    sig, key = sig[twin], key[twin]
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[fresh], key[fresh]
    head = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(sig)))
    found: list[np.ndarray] = []
    for k in range(2, SMALL + 1):
        h = head[size == k]
        found += [np.stack((key[h + i], key[h + j], np.zeros(len(h), np.int64))) for i in range(k) for j in range(i + 1, k)]
    large = size > SMALL
    h, k = head[large], size[large]
    if len(h):
        member = np.repeat(h, k - 1) + np.concatenate([np.arange(1, x) for x in k])
        hub = key[np.repeat(h, k - 1)]
        found.append(np.stack((hub, key[member], np.ones(len(member), np.int64))))
    if not found:
        return
    pairs = np.concatenate(found, axis=1)
    order = np.lexsort((-pairs[2], pairs[1], pairs[0]))
    pairs = pairs[:, order]
    fresh = np.ones(pairs.shape[1], bool)
    fresh[1:] = (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])
    pairs = pairs[:, fresh]
    for i in range(0, pairs.shape[1], 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000].copy()) for x in pairs], names=["a", "b", "star"])


def _sets(batches):
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for a, b, data, offsets in B.blocks(batch.column(1), 2 << 20):
            row, sets = shingle_sets(data, offsets)
            first = B.first_of(row, b - a).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.ListArray.from_arrays(pa.array(first), pa.array(sets.astype(np.int64)))], names=["key", "shingles"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b, ...) with size_a, size_b and the size of their intersection, on whole sets."""
    one = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    both = one.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    return both.select(*pairs.columns, F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with ``fits``, whether sizes and sketches allow linking, or twice that distance for those of large buckets; others only of these."""
    own = lambda x: nodes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(own("b"), "b").join(own("a"), "a")
    small, large = F.when(F.size("sa") <= F.size("sb"), F.col("sa")).otherwise(F.col("sb")), F.when(F.size("sa") <= F.size("sb"), F.col("sb")).otherwise(F.col("sa"))
    both = both.select(*pairs.columns, "na", "nb", small.alias("sa"), large.alias("sb"))
    for _ in range(2):  # sizes within a factor of two, of powers of two
        half = F.zip_with(F.slice("sb", 1, (F.size("sb") / 2).cast("int")), F.slice("sb", (F.size("sb") / 2).cast("int") + 1, (F.size("sb") / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
        both = both.withColumn("sb", F.when(F.size("sb") > F.size("sa"), half).otherwise(F.col("sb")))
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    # J >= t means a difference of at most (1 - t) / (1 + t) of both sizes, and sizes within t
    least = F.when(F.col("star") == 1, 2 * PERCENT - 100).otherwise(PERCENT)
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * least) & (differ * (100 + least) <= (100 - least) * (F.col("na") + F.col("nb")))
    return both.select(*pairs.columns, fits.alias("fits")).where("fits or star = 1")


def _folded(sketch: np.ndarray) -> np.ndarray:
    """Sketches (a row each) of half the size."""
    half = sketch.shape[1] // 2
    return sketch[:, :half] ^ sketch[:, half:]


def _alike(closest: int):
    """Rows sorted by (hub, xb, zb): one block of far nodes (side 0) and one of all nodes (side 1) of a hub -> pairs that sizes, distances and sketches allow.

    The ``closest`` of each far node; ``more`` names the far node where it has others.
    """

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            keys = [table.column(x).to_numpy() for x in ("hub", "xb", "zb")]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            cut = [0, *cut.tolist()]
            found = [_alike_in(table.slice(i, j - i), closest) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            if found:
                yield from pa.concat_tables(found).combine_chunks().to_batches()
            held = table.slice(cut[-1])  # the last group may go on
        if held is not None and held.num_rows:
            yield from _alike_in(held, closest).to_batches()

    return run


def _near(d: np.ndarray, of: float) -> np.ndarray:
    """Whether nodes at distances d of a hub can be linked with one at distance ``of``."""
    reach = 1 - PERCENT / 100
    return np.where(np.maximum(d, of) >= FAR, np.minimum(d, of) > reach - 1e-9, np.abs(d - of) <= reach + 1e-9)


def _alike_in(table: pa.Table, closest: int) -> pa.Table:
    side, node, c, n = (table.column(x).to_numpy() for x in ("side", "node", "c", "n"))
    d, own = table.column("d").to_numpy(), table.column("sketch").to_pylist()
    width = np.array([len(x) for x in own])
    rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in np.unique(width):
        at = np.flatnonzero((width == w) & (side == 1))
        rows[int(w)] = (at, np.array([own[i] for i in at], np.int64).view(B.U64).reshape(len(at), int(w)))
    done = table.column("done")
    left, right, more = [], [], []
    for i in np.flatnonzero(side == 0):
        near, far = [], []
        x, w, known = np.array([own[i]], np.int64).view(B.U64), int(width[i]), done[int(i)].as_py()
        for v, x_of, fold in ((w, x, False), (w // 2, _folded(x) if w > 1 else x, False), (2 * w, x, True)):
            if v not in rows or (v == w // 2 and w == 1) or not len(rows[v][0]):
                continue
            at, z = rows[v]
            ok = (c[at] != c[i]) & _near(d[at], d[i]) & (100 * np.minimum(n[at], n[i]) >= PERCENT * np.maximum(n[at], n[i]))
            if known:
                ok &= ~np.isin(node[at], known)
            at, z = at[ok], z[ok]
            differ = np.bitwise_count((_folded(z) if fold else z) ^ x_of).sum(axis=1)
            fits = differ * (100 + PERCENT) <= (100 - PERCENT) * (n[at] + n[i])
            near.append(at[fits])
            far.append(differ[fits] / (n[at[fits]] + n[i]))
        at = np.concatenate(near) if near else np.zeros(0, np.int64)
        most = len(at) > closest
        if most:
            at = at[np.lexsort((node[at], np.concatenate(far)))[:closest]]
        left.append(np.full(len(at), node[i]))
        right.append(node[at])
        more.append(np.full(len(at), most, bool))
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
    rest = np.concatenate(more) if more else np.zeros(0, bool)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "more": pa.array(a, pa.int64(), mask=~rest)})


def _apart(star: DataFrame, sketched: DataFrame, reach: float, closest: int, left: DataFrame | None) -> DataFrame:
    """Pairs (a, b, more) of star(hub, node, d, c) to verify: of one hub, of different components c, one of them not linked with the hub.

    ``left``(node, done): the far nodes that had more partners than were verified before, and those that were.  The
    other far nodes are done, as components only grow.
    """
    far = F.col("d") > reach
    # a hub whose nodes are all in one component has nothing left to compare
    held = star.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    rows = star.join(held.select("hub", "blocks"), "hub").join(sketched.select(F.col("key").alias("node"), "n", "sketch"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    names, none = ["node", "d", "c", "n", "sketch", "done"], F.array().cast("array<long>").alias("done")
    x = rows.where(far).select("*", none) if left is None else rows.where(far).join(left, "node")
    x = x.select("hub", F.col("own").alias("xb"), other.alias("zb"), F.lit(0).alias("side"), *names)
    z = rows.select("hub", other.alias("xb"), F.col("own").alias("zb"), F.lit(1).alias("side"), *names[:-1], none)
    return x.unionByName(z).repartition(shuffle_partitions(star.sparkSession), "hub", "xb", "zb").sortWithinPartitions("hub", "xb", "zb").mapInArrow(_alike(closest), "a long, b long, more long").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of links(a, b): root is the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris, Lattanzi, Mirrokni, Rastogi,
    Vassilvitskii, SoCC 2014).  Each round is two shuffles of the links, aggregated before they
    are exchanged; lineage is cut in the shared folder.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), name)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now v < u for every edge
        base = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(base, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = written(small, name)
        if not after.select("a").intersect(after.select("b")).limit(1).count():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = after


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and whether another text is linked (``linked``), for every row.

    Null and empty texts, and texts without a word, have no shingles and are linked with
    nothing.  Rows with equal shingle sets are one node, so copies of any number are a single
    group-by with partial aggregation.  Rows with a null doc_id get component_id from the
    others of their component (null where there are none).  Repeated rows come out as often
    as they go in.  Other columns are ignored.
    """
    spark = documents.sparkSession
    parts = shuffle_partitions(spark)
    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(texts.withColumn("hash", F.xxhash64("text")).mapInArrow(_nodes, "doc_id long, n long, key long, hash long, sketch array<long>"), "jaccard-rows")
    often = spark.sparkContext.broadcast(_often(texts))
    blobs = texts.select("text").mapInArrow(_spread(parts, often), "part int, blob binary").repartition(parts, "part")
    raw = written(blobs.mapInArrow(_pairs, "a long, b long, star long").groupBy("a", "b").agg(F.max("star").alias("star")), "jaccard-raw")
    ends = raw.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # written, as each round reads them: the pairs are taken apart once
    sketched = written(rows.join(ends, "key", "left_semi").dropDuplicates(["key"]), "jaccard-sketches")
    possible = written(_possible(raw, sketched), "jaccard-pairs")
    pairs = possible.where("fits").drop("fits")
    rows = rows.select("doc_id", "n", "key", "hash")

    def checking(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs, verified; one text for each of their nodes is read."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        holders = written(rows.join(wanted, "key").groupBy("key").agg(F.min(F.struct("doc_id", "hash")).alias("x")).select("key", F.col("x.doc_id").alias("id"), F.col("x.hash").alias("h")), "jaccard-nodes")
        few = holders.count() <= BROADCAST_IDS
        held = texts.withColumn("hash", F.xxhash64("text")).join(F.broadcast(holders) if few else holders, (F.col("hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("key", "text")
        sets = written(held.mapInArrow(_sets, "key long, shingles array<long>").dropDuplicates(["key"]), "jaccard-sets")
        return written(_verified(pairs, sets), name)

    checked = checking(pairs, "jaccard-checked")
    linked = f"100 * common >= {PERCENT} * (na + nb - common)"
    distance = F.lit(1.0) - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    roots = components(checked.where(linked).select("a", "b"), "jaccard-links")
    reach = 1 - PERCENT / 100
    hubs = checked.where("star = 1").select(F.col("a").alias("hub"), F.col("b").alias("node"), distance.alias("d"))
    star = hubs.unionByName(possible.where("not fits").select(F.col("a").alias("hub"), F.col("b").alias("node"), F.lit(FAR).alias("d")))
    star = written(star.join(star.where(F.col("d") > reach).select("hub").distinct(), "hub", "left_semi"), "jaccard-far")
    known, closest, left = checked.select("a", "b"), CLOSEST, None
    while True:
        placed = written(star.join(roots, "node", "left").select("hub", "node", "d", F.coalesce("root", "node").alias("c")), "jaccard-placed")
        found = written(_apart(placed, sketched, reach, closest, left), "jaccard-apart")
        new = written(found.select("a", "b").distinct().join(known, ["a", "b"], "left_anti"), "jaccard-new")
        if not new.limit(1).count():
            again = checked.select("a", "b", F.lit(False).alias("linked")).limit(0)
        else:
            again = checking(new, "jaccard-second").select("a", "b", F.expr(linked).alias("linked"))
        known = known.unionByName(again.select("a", "b"))
        if again.where("linked").limit(1).count():
            roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(again.where("linked").select("a", "b")), "jaccard-links")
        partners = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnRenamed("a", "node")
        left = written(found.where("more is not null").select(F.col("more").alias("node")).distinct().join(partners, "node", "left").groupBy("node").agg(F.collect_set("b").alias("done")), "jaccard-left")
        if not left.limit(1).count():
            break
        closest *= 8
    # from the root node of each node to the smallest doc_id of the whole component
    nodes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    nodes = nodes.select("key", "low", F.coalesce("root", "key").alias("root"), F.col("root").isNotNull().alias("moved"))
    joined = roots.select("root").distinct()
    lows = nodes.join(joined, "root", "left_semi").groupBy("root").agg(F.min("low").alias("lowest"))
    final = nodes.join(lows, "root", "left").select("key", F.coalesce("lowest", "low").alias("component_id"), F.col("lowest").isNotNull().alias("linked"))
    out = rows.join(final, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("linked", F.lit(False)).alias("linked"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and the component of every document.

    A null, empty or blank text has an empty set, is linked with nothing and keeps its own doc_id as component.  A row for each
    row; repeated rows get the same component, rows of one id with different texts are linked by text; null ids
    join, but don't name a component that has another id.  An empty table gives no rows; further columns aren't read.
    """
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
