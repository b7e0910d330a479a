"""Removal of byte strings that occur more than once, by merging shard Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too.  Sorting all
suffixes of the corpus isn't needed for that:

1. Anchors.  In each string of ``length`` bytes, the leftmost smallest hash of a GRAM-byte gram is
   its anchor, so equal strings have equal anchors at the same place.  Neighbouring strings share
   anchors; a run of strings with one anchor is one entry.  Entries are exchanged by anchor hash,
   and those that stand alone (nearly all of a clean corpus) can't repeat.  Where an anchor stands in more than
   HOT places, the grams that are frequent around it are hot: anchors are chosen anew, and a hot gram is one only
   where a string has no other.  So the strings that reach out of a passage that very many texts share
   go by what is around it, to many tasks, and those inside it are equal in all of these texts.
2. Contexts.  What is left is exchanged once more with its bytes: a run and the length - 1 bytes that
   follow.  A context that occurs more than once is repeated as a whole; of those that do in one block, two go on
   and the others' spans are final.
3. Pieces.  A SYMBOL-byte string that no other context of the anchor has in the same place can't be
   in a repeat, so it ends the strings: what is left are pieces.  Equal pieces are one, repeated as a
   whole.  A passage that many texts share around different borders comes down to one piece here.
4. Merge.  The different pieces of an anchor, aligned at it, are read as strings of SYMBOL-byte
   symbols, one string for each phase.  The pieces of one input block are a shard.  Each shard's
   suffixes are sorted on their own; that gives its BWT.  The interleave of the shards' rows starts
   as shard after shard and is refined by one stable pass over the merged BWT for each symbol
   (Holt, McMillan, Bioinformatics 2014); the passes also carry the borders between rows that
   differ within the symbols seen so far, hence the common prefixes (Egidi, Manzini, 2017).  After
   length / SYMBOL passes, rows between two borders share ``length`` bytes: a repeated interval.

Equal texts are one text with a number of copies, whatever their number.  Results are on whole
UTF-8 texts; matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bytescan as B
from quillon.llm.common import read, shuffle_partitions, written

LENGTH = 400
GRAM = 256
SYMBOL = 40
#: Broadcast only up to so many rows and bytes; beyond, the join is a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
CHUNK = 1 << 20
#: Places of an anchor beyond which it is hot, at least; and so many anchors are hot at most (which bounds their broadcast).
HOT, HOT_ANCHORS = 2048, 20_000
#: Grams that are hot at most (8 bytes each).
HOT_GRAMS = 4_000_000
#: A gram is counted as frequent by a task that has met it so often around hot anchors.
OFTEN = 8
#: Bytes of text in which anchors and such grams are looked for at once (over 100 bytes of memory each), and grams that a task holds before it adds them up.
AROUND, HELD_GRAMS = 1 << 19, 1 << 20


def grams(data: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the gram at each byte."""
    n = len(data)
    c = B.prefix_hash(data)
    _, q = B.powers(n + 1)
    return B.mix((c[gram:] - c[: n - gram + 1]) * q[: n - gram + 1])


def within(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, hot: np.ndarray = np.zeros(0, B.U64)) -> tuple[np.ndarray, ...]:
    """(row, first, last, anchor, anchor hash) of the maximal runs of string starts with one anchor; ``hot`` grams come last.

    Rows are taken AROUND bytes at a time, since each byte takes over 100 bytes of memory.
    """
    found, a = [_runs(data[:0], offsets[:1], length, gram, hot)], 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + AROUND, side="right")) - 1)
        row, first, last, anchor, h = _runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, gram, hot)
        found.append((row + a, first + offsets[a], last + offsets[a], anchor + offsets[a], h))
        a = b
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    n, w = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, np.zeros(0, B.U64)
    h = grams(data, gram)
    bits = B.U64(int(n).bit_length())
    key = ((h >> B.U64(1) | within(h, hot).astype(B.U64) << B.U64(63)) >> bits << bits) | np.arange(len(h), dtype=B.U64)
    padded = np.full(-(-len(key) // w) * w, np.iinfo(B.U64).max, B.U64)
    padded[: len(key)] = key
    table = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - length + 1
    anchor = (np.minimum(back[:starts], ahead[w - 1 : w - 1 + starts]) & ((B.U64(1) << bits) - B.U64(1))).astype(np.int64)
    # string starts that end within their row
    sizes = np.diff(offsets)
    valid = np.zeros(starts, bool)
    for s, size in zip(offsets[:-1][sizes >= length], sizes[sizes >= length], strict=True):
        valid[s : s + size - length + 1] = True
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none, np.zeros(0, B.U64)
    a = anchor[at]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)))
    head = np.flatnonzero(new)
    first = at[head]
    last = at[np.append(head[1:], len(at)) - 1]
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, first, last, a[head], h[a[head]]


def _parted(h: np.ndarray, parts: int) -> np.ndarray:
    """Anchors have the smallest hashes of many, so they are mixed once more before they are dealt."""
    return ((B.mix(h + B.U64(1)) >> B.U64(32)) * B.U64(parts) >> B.U64(32)).astype(np.int64)


def _short(h: np.ndarray, parts: int) -> np.ndarray:
    """What blobs tell of an anchor: its partition and 32 bits of its hash."""
    return _parted(h, parts).astype(B.U64) << B.U64(32) | h & B.U64(0xFFFFFFFF)


def _anchors(parts: int, length: int, gram: int, hot):
    """(doc_id, key, text) -> a row (part -1) for each text, and blobs of its anchors for each partition."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_numpy()
            for a, b, data, offsets in B.blocks(batch.column(2), 3 << 19):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, -1, np.int32)), ids.slice(a, b - a), pa.array(keys[a:b]), pa.array(np.diff(offsets)), pa.nulls(b - a, pa.binary())], names=["part", "doc_id", "key", "n", "blob"])
                row, _, _, anchor, h = runs(data, offsets, length, gram, hot.value)
                if not len(row):
                    continue
                key = keys[a:b]
                part = _parted(h, parts)
                order = np.argsort(part, kind="stable")
                part, row, h, local = part[order], row[order], h[order], (anchor - offsets[row])[order]
                bounds = np.searchsorted(part, np.arange(parts + 1))
                full, blobs = np.flatnonzero(np.diff(bounds)), []
                for p in full:
                    s = slice(bounds[p], bounds[p + 1])
                    nodes, index = np.unique(row[s], return_inverse=True)
                    blobs.append(np.array([len(nodes)], np.uint32).tobytes() + key[nodes].tobytes() + h[s].astype(np.uint32).tobytes() + local[s].astype(np.uint32).tobytes() + index.astype(np.uint16).tobytes())
                k = len(full)
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "doc_id", "key", "n", "blob"])

    return run


def _twins(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blobs of a partition -> (anchor, key, position) of the anchors that occur at another place too, by anchor."""
    hs, keys, at = [np.zeros(0, B.U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for batch in batches:
        for p, blob in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
            raw = blob.as_buffer()
            count = int(np.frombuffer(raw, np.uint32, 1)[0])
            base = 4 + 8 * count
            n = (raw.size - base) // 10
            hs.append(np.frombuffer(raw, np.uint32, n, base).astype(B.U64) | (B.U64(int(p)) << B.U64(32)))
            at.append(np.frombuffer(raw, np.uint32, n, base + 4 * n))
            keys.append(np.frombuffer(raw, np.int64, count, 4)[np.frombuffer(raw, np.uint16, n, base + 8 * n)])
    h, key, pos = np.concatenate(hs), np.concatenate(keys), np.concatenate(at)
    order = np.argsort(h, kind="stable")
    h, key, pos = h[order], key[order], pos[order]
    same = h[1:] == h[:-1]
    twin = np.zeros(len(h), bool)
    twin[1:] |= same
    twin[:-1] |= same
    h, key, pos = h[twin], key[twin], pos[twin]
    if not len(h):
        return h, key, pos
    order = np.lexsort((pos, key, h))
    h, key, pos = h[order], key[order], pos[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])))
    h, key, pos = h[fresh], key[fresh], pos[fresh]
    same = h[1:] == h[:-1]
    twin = np.zeros(len(h), bool)
    twin[1:] |= same
    twin[:-1] |= same
    return h[twin], key[twin], pos[twin]


def _hot_anchors(most: int):
    """Blobs of a partition -> (anchor, times) of the anchors that stand in more than ``most`` places."""

    def run(batches):
        which, times = np.unique(_twins(batches)[0], return_counts=True)
        which, times = which[times > most], times[times > most]
        for i in range(0, len(which), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(which[i : i + 10_000].view(np.int64)), pa.array(times[i : i + 10_000].astype(np.int64))], names=["key", "times"])

    return run


def _repeated_anchors(batches):
    """Blobs of a partition -> (key, positions) of the anchors that occur at another place too."""
    _, key, pos = _twins(batches)
    order = np.argsort(key, kind="stable")
    key, pos = key[order], pos[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(key))
    for i in range(0, len(head), 10_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[head[i : i + 10_000]]), pa.array([pos[s:e].astype(np.uint32).tobytes() for s, e in zip(head[i : i + 10_000], tail[i : i + 10_000], strict=True)], pa.binary())], names=["key", "at"]
        )


def _frequent(parts: int, length: int, gram: int, anchors, least: int):
    """texts -> (gram, n): the grams that a task has met ``least`` times or more around the hot anchors."""

    def run(batches):
        known, many, new, size = np.zeros(0, B.U64), np.zeros(0, np.int64), [], 0

        def merged():
            found, times = np.unique(np.concatenate(new) if new else known[:0], return_counts=True)
            every, at = np.unique(np.concatenate([known, found]), return_inverse=True)
            return every, np.bincount(at, weights=np.concatenate([many, times]), minlength=len(every)).astype(np.int64)

        for batch in batches:
            for _, _, data, offsets in B.blocks(batch.column(0), AROUND):
                _, first, last, _, h = runs(data, offsets, length, gram)
                mine = within(_short(h, parts), anchors.value) if len(h) else np.zeros(0, bool)
                if not mine.any():
                    continue
                every = grams(data, gram)
                # copied: a slice would keep the grams of the whole block in memory
                new.append(np.concatenate([every[a : b + length - gram + 1] for a, b in zip(first[mine], last[mine], strict=True)]))
                size += len(new[-1])
                if size > HELD_GRAMS:
                    known, many = merged()
                    new, size = [], 0
        known, many = merged()
        keep = many >= least
        known, many = known[keep], many[keep]
        for i in range(0, len(known), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(known[i : i + 50_000].view(np.int64)), pa.array(many[i : i + 50_000])], names=["gram", "n"])

    return run


def _contexts(parts: int, length: int, gram: int, hot):
    """(key, text, flags) -> for each block and partition one blob with the contexts of flagged anchors; and final spans (no blob), dealt by their text."""

    def run(batches):
        for batch in batches:
            keys, flags = batch.column(0).to_numpy(), batch.column(2)
            for a, b, data, offsets in B.blocks(batch.column(1), 3 << 19):
                row, first, last, anchor, h = runs(data, offsets, length, gram, hot.value)
                wanted = [np.frombuffer(b"".join(x.as_py()), np.uint32).astype(np.int64) + o for x, o in zip(flags.slice(a, b - a), offsets[:-1], strict=True)]
                keep = np.isin(anchor, np.concatenate(wanted)) if wanted else np.zeros(0, bool)
                row, first, last, anchor, h = row[keep], first[keep], last[keep], anchor[keep], h[keep]
                if not len(row):
                    continue
                part = _parted(h, parts)
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                full, blobs, final = np.flatnonzero(np.diff(bounds)), [], []
                for p in full:
                    own = order[bounds[p] : bounds[p + 1]]
                    known: dict[tuple, int] = {}
                    which = np.array([known.setdefault((int(h[i]), int(anchor[i] - first[i]), data[first[i] : last[i] + length].tobytes()), len(known)) for i in own], np.uint32)
                    head = np.array([(x[0], x[1], len(x[2])) for x in known], B.U64)
                    # of a context that the block has more than twice, two entries tell that it is repeated
                    place = np.argsort(which, kind="stable")
                    nth = np.empty(len(own), np.int64)
                    nth[place] = np.arange(len(own)) - np.searchsorted(which[place], which[place])
                    final.append(own[nth > 1])
                    own, which = own[nth <= 1], which[nth <= 1]
                    blobs.append(
                        np.array([len(known), len(own)], np.uint32).tobytes() + head.tobytes() + keys[a:b][row[own]].astype(np.int64).tobytes() + (first[own] - offsets[row[own]]).astype(np.int64).tobytes() + which.tobytes() + b"".join(x[2] for x in known)
                    )
                k, done = len(full), np.concatenate(final)
                names = ["part", "blob", "key", "start", "end"]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary()), *([pa.nulls(k, pa.int64())] * 3)], names=names)
                if len(done):
                    base = offsets[row[done]]
                    spans = [keys[a:b][row[done]].astype(np.int64), first[done] - base, last[done] + length - base]
                    yield pa.RecordBatch.from_arrays([pa.array((spans[0] % parts).astype(np.int32)), pa.nulls(len(done), pa.binary()), *map(pa.array, spans)], names=names)

    return run


def live_pieces(texts: list[bytes], anchors: np.ndarray, group: np.ndarray, length: int, symbol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the parts in which every aligned symbol occurs in another context of the group too.

    Symbols are compared by 32 bits of a hash: one that looks shared by chance only makes a piece longer.
    """
    slices, at = [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size < CHUNK or to == at):
            size += len(texts[to])
            to += 1
        slices.append((at, to))
        at = to

    def cells(a: int, b: int):
        size = np.array([len(t) for t in texts[a:b]], np.int64)
        base = np.concatenate(([0], np.cumsum(size)))
        c = B.prefix_hash(np.frombuffer(b"".join(texts[a:b]), np.uint8))
        many = np.maximum(size - symbol + 1, 0)
        owner = np.repeat(np.arange(b - a), many)
        first = np.concatenate(([0], np.cumsum(many)))
        t = np.arange(len(owner)) - first[owner]
        h = B.range_hash(c, base[owner] + t, base[owner] + t + symbol)
        where = (t - anchors[a:b][owner]).astype(B.U64) * B.U64(0x9E3779B97F4A7C15) + group[a:b][owner].astype(B.U64)
        return (B.mix(h ^ B.mix(where)) >> B.U64(32)).astype(np.uint32), owner, first, t, size

    every = np.sort(np.concatenate([cells(a, b)[0] for a, b in slices]))
    out = []
    for a, b in slices:
        h, owner, first, t, size = cells(a, b)
        at = np.searchsorted(every, h)
        shared = np.zeros(len(h), bool)
        inner = at + 1 < len(every)
        shared[inner] = every[at[inner] + 1] == h[inner]
        dead = np.concatenate(([0], np.cumsum(~shared)))
        whole = t + length <= size[owner]
        live = np.zeros(len(h), bool)
        place = np.flatnonzero(whole)
        live[place] = dead[place + length - symbol + 1] == dead[place]
        edge = np.diff(np.concatenate(([0], (live & whole).astype(np.int8), [0])))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        # a context's last cells have no whole string after them, so runs never cross contexts
        out.append(np.stack((owner[start] + a, t[start], t[stop] + length)))
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 3


def merged_repeats(texts: list[bytes], anchors: np.ndarray, group: np.ndarray, shard: np.ndarray, length: int = LENGTH, symbol: int = SYMBOL) -> list[np.ndarray]:
    """For each piece: which of its string starts (those with ``length`` bytes after them) are repeated in another piece of its group.

    The shards' BWTs are merged as the module says; ``shard`` numbers each piece's shard, and
    ``anchors`` is where its anchor is, from its start.
    """
    size = np.array([len(t) for t in texts], np.int64)
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    base = np.concatenate(([0], np.cumsum(size)))
    c = B.prefix_hash(buffer)
    cells = np.maximum(size - symbol + 1, 0)
    owner = np.repeat(np.arange(len(texts)), cells)
    start = np.concatenate(([0], np.cumsum(cells)))
    t = np.arange(len(owner)) - start[owner]
    place = base[owner] + t
    _, letter = np.unique(B.range_hash(c, place, place + symbol) ^ B.mix((t - anchors[owner]).astype(B.U64) * B.U64(0x9E3779B97F4A7C15) + group[owner].astype(B.U64)), return_inverse=True)
    letter = letter.astype(np.int64) + 1  # 0 ends a string
    cell = np.arange(len(owner))
    follows = t + symbol < cells[owner]
    # each shard's suffixes, sorted on their own by doubling: ranks of one shard never meet another's
    own = shard[owner].astype(np.int64)
    _, rank = np.unique(own * (letter.max(initial=0) + 1) + letter, return_inverse=True)
    step = symbol
    while step < length + symbol + GRAM:
        has = t + step < cells[owner]
        second = np.zeros(len(cell), np.int64)
        second[has] = rank[cell[has] + step] + 1
        _, rank = np.unique(rank.astype(np.int64) * (len(cell) + 2) + second, return_inverse=True)
        step *= 2
    # strings, numbered in the order of their whole contents within the shard
    heads = np.flatnonzero(t < symbol)
    string = np.empty(len(heads), np.int64)
    string[np.argsort(rank[heads], kind="stable")] = np.arange(len(heads))
    number = np.zeros(len(cell), np.int64)
    back = (t % symbol) + start[owner]  # the head of the string that a cell is in
    of_head = np.zeros(len(cell), np.int64)
    of_head[heads] = string
    number = of_head[back]
    # rows: the closing suffix of each string, then the cells; the letter before each (0 before a head)
    tails = np.flatnonzero(~follows)
    row_shard = np.concatenate((own[tails], own))
    row_rank = np.concatenate((np.full(len(tails), -1), rank))
    row_string = np.concatenate((number[tails], number))
    row_cell = np.concatenate((np.full(len(tails), -1), cell))
    before = np.zeros(len(cell), np.int64)
    inner = t >= symbol
    before[inner] = letter[cell[inner] - symbol]
    row_before = np.concatenate((letter[tails], before))
    order = np.lexsort((row_string, row_rank, row_shard))
    bwt, row_cell, row_shard = row_before[order], row_cell[order], row_shard[order]
    # interleave refinement: z says from which shard each merged row comes
    z, border = row_shard.copy(), np.zeros(len(order), np.int64)
    rows = None
    for _ in range(length // symbol):
        rows = np.argsort(z, kind="stable")  # the k-th row of a shard stays its k-th row
        merged = np.empty(len(order), np.int64)
        merged[rows] = bwt
        by = np.argsort(merged, kind="stable")
        z, letters, old = z[by], merged[by], border[by]
        border = np.cumsum(np.concatenate(([0], (letters[1:] != letters[:-1]) | (old[1:] != old[:-1]))))
    rows = np.argsort(z, kind="stable")
    group = np.empty(len(order), np.int64)
    group[:] = border[rows]  # of the shards' rows, shard after shard
    out = np.zeros(len(cell), bool)
    real = row_cell >= 0
    whole = np.zeros(len(cell), bool)
    whole[:] = t + length <= size[owner]
    valid = real & whole[np.maximum(row_cell, 0)]
    many = np.bincount(group[valid], minlength=1) >= 2
    out[row_cell[valid]] = many[group[valid]]
    return [out[start[i] : start[i] + max(0, size[i] - length + 1)] for i in range(len(texts))]


def _intervals(length: int, symbol: int):
    """Blobs of contexts -> (key, start, end) of repeated bytes, joined where they meet; final spans stay as they are."""

    def run(batches):
        seen: dict[tuple, int] = {}
        shard, owner, first, which = [], [], [], []
        for batch in batches:
            yield batch.filter(batch.column(1).is_null()).select(["key", "start", "end"])
            for blob in batch.column(1).drop_null():
                raw, number = blob.as_buffer(), len(owner)
                k, n = (int(x) for x in np.frombuffer(raw, np.uint32, 2))
                head = np.frombuffer(raw, B.U64, 3 * k, 8).reshape(k, 3)
                at = 8 + 24 * k
                owner.append(np.frombuffer(raw, np.int64, n, at).copy())
                first.append(np.frombuffer(raw, np.int64, n, at + 8 * n).copy())
                local = np.frombuffer(raw, np.uint32, n, at + 16 * n)
                at += 20 * n
                mapped = np.empty(k, np.int64)
                for i, (h, a, size) in enumerate(head.tolist()):
                    x = (h, a, raw.slice(at, size).to_pybytes())
                    at += size
                    mapped[i] = j = seen.setdefault(x, len(seen))
                    if j == len(shard):
                        shard.append(number)
                which.append(mapped[local])
        if not seen:
            return
        owner, first, which = np.concatenate(owner), np.concatenate(first), np.concatenate(which)
        order = np.lexsort((which, first, owner))
        owner, first, which = owner[order], first[order], which[order]
        fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (first[1:] != first[:-1])))
        owner, first, which = owner[fresh], first[fresh], which[fresh]
        contexts = list(seen)
        times = np.bincount(which, minlength=len(contexts))
        found: list[list[tuple[int, int]]] = [[] for _ in contexts]
        for i in np.flatnonzero(times > 1):
            found[i].append((0, len(contexts[i][2])))
        by_anchor: dict[int, list[int]] = {}
        for i, x in enumerate(contexts):
            by_anchor.setdefault(x[0], []).append(i)
        groups = [g for g in by_anchor.values() if len(g) > 1 and any(times[i] == 1 for i in g)]
        at = 0
        while at < len(groups):
            members: list[int] = []
            number: list[int] = []
            size = 0
            while at < len(groups) and (size < CHUNK or not members):
                members += groups[at]
                number += [at] * len(groups[at])
                size += sum(len(contexts[i][2]) for i in groups[at])
                at += 1
            cut = live_pieces([contexts[i][2] for i in members], np.array([contexts[i][1] for i in members]), np.array(number), length, symbol)
            pieces: dict[tuple, list[tuple[int, int]]] = {}
            for m, s, e in zip(*(x.tolist() for x in cut), strict=True):
                i = members[m]
                pieces.setdefault((number[m], contexts[i][1] - s, contexts[i][2][s:e]), []).append((i, s))
            # a piece of several contexts is repeated; the others are merged with those of their anchor
            alone: dict[int, list[tuple]] = {}
            for x, places in pieces.items():
                if len(places) > 1:
                    for i, s in places:
                        found[i].append((s, s + len(x[2])))
                alone.setdefault(x[0], []).append(x)
            rest = [x for own in alone.values() if len(own) > 1 and any(len(pieces[x]) == 1 for x in own) for x in own]
            lone = 0
            while lone < len(rest):
                to, size = lone, 0
                while to < len(rest) and (size < CHUNK // 4 or rest[to][0] == rest[to - 1][0]):
                    size += len(rest[to][2])
                    to += 1
                part = rest[lone:to]
                lone = to
                hits = merged_repeats([x[2] for x in part], np.array([x[1] for x in part]), np.array([x[0] for x in part]), np.array([shard[pieces[x][0][0]] for x in part]), length, symbol)
                for x, hit in zip(part, hits, strict=True):
                    if len(pieces[x]) == 1 and hit.any():
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                        i, s = pieces[x][0]
                        found[i] += [(int(p) + s, int(q) + s - 1 + length) for p, q in zip(edge[::2], edge[1::2], strict=True)]
        keys, starts, ends = [], [], []
        for o, f, w in zip(owner.tolist(), first.tolist(), which.tolist(), strict=True):
            if found[w]:
                for s, e in sorted(found[w]):
                    if keys and keys[-1] == o and s + f <= ends[-1]:
                        ends[-1] = max(ends[-1], int(e) + f)
                    else:
                        keys.append(o)
                        starts.append(int(s) + f)
                        ends.append(int(e) + f)
        for i in range(0, len(keys), 50_000):
            j = i + 50_000
            yield pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.int64()), pa.array(starts[i:j], pa.int64()), pa.array(ends[i:j], pa.int64())], names=["key", "start", "end"])

    return run


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, symbol: int = SYMBOL) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): documents as (doc_id, key, text), and for each key with repeats its n, copies and spans.

    ``key`` is a hash of the text, so equal texts share one; ``spans`` is an array of
    (start, end) byte offsets, unsorted and possibly overlapping; null for texts with copies,
    which are repeated as a whole.  Nulls are empty texts; empty and short texts have no spans.
    """
    spark = documents.sparkSession
    parts = shuffle_partitions(spark)
    texts = documents.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def anchored(hot) -> DataFrame:
        return texts.mapInArrow(_anchors(parts, length, gram, hot), "part int, doc_id long, key long, n long, blob binary")

    def dealt(index: DataFrame) -> DataFrame:
        return index.where("part >= 0").select("part", "blob").repartition(parts, "part")

    hot = spark.sparkContext.broadcast(np.zeros(0, B.U64))
    # what is read once isn't written: each file of a table costs the executor's JVM child processes where Hadoop has no native library
    anchors = dealt(anchored(hot)).mapInArrow(_hot_anchors(HOT), "key long, times long").orderBy(F.desc("times"), "key").limit(HOT_ANCHORS).select("key").toPandas()["key"].to_numpy(np.int64)
    if len(anchors):
        around = spark.sparkContext.broadcast(np.sort(anchors.view(B.U64)))
        often = texts.select("text").mapInArrow(_frequent(parts, length, gram, around, OFTEN), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > HOT // 2)
        # any set of hot grams gives the same result, so the bound costs nothing but balance
        hot = spark.sparkContext.broadcast(np.sort(often.orderBy(F.desc("n"), "gram").limit(HOT_GRAMS).select("gram").toPandas()["gram"].to_numpy(np.int64).view(B.U64)))
    index = written(anchored(hot), "bwt-anchors")
    copies = index.where(f"part < 0 and n >= {length}").groupBy("key").agg(F.max("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
    flags = dealt(index).mapInArrow(_repeated_anchors, "key long, at binary").groupBy("key").agg(F.collect_list("at").alias("at"))
    flags = written(flags.join(copies.select("key", "doc_id"), "key"), "bwt-flags")
    holders = flags.select("key", "doc_id")
    few = holders.count() <= BROADCAST_ROWS
    held = texts.join(F.broadcast(holders) if few else holders, (texts["key"] == holders["key"]) & texts["doc_id"].eqNullSafe(holders["doc_id"]), "left_semi").select("key", "text")
    flagged = held.join(flags.select("key", "at"), "key").select("key", "text", "at")
    sent = flagged.mapInArrow(_contexts(parts, length, gram, hot), "part int, blob binary, key long, start long, end long").repartition(parts, "part")
    found = sent.mapInArrow(_intervals(length, symbol), "key long, start long, end long").groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = copies.join(found, "key", "left").where("copies > 1 or spans is not null")
    return texts, written(spans.select("key", "n", "copies", F.when(F.col("copies") == 1, F.col("spans")).alias("spans")), "bwt-spans")


def _removed(batches):
    for batch in batches:
        ids, texts, spans, all_of = batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        sizes, gone, count, digest = [], [], [], []
        data, offsets = B.flat(texts)
        for i in range(len(ids)):
            text = data[offsets[i] : offsets[i + 1]]
            n = len(text)
            if all_of[i]:
                pairs = [(0, n)]
            else:
                pairs = []
                for s, e in sorted((x["start"], x["end"]) for x in spans[i] or ()):
                    if pairs and s <= pairs[-1][1]:
                        pairs[-1] = (pairs[-1][0], max(e, pairs[-1][1]))
                    else:
                        pairs.append((s, e))
            kept, at = hashlib.sha256(), 0
            for s, e in pairs:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            sizes.append(n)
            gone.append(sum(e - s for s, e in pairs))
            count.append(len(pairs))
            digest.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what stays, for every row."""
    texts, spans = repeated_spans(documents, length)
    rows, size = spans.agg(F.count("*"), F.coalesce(F.sum(16 + 16 * F.size("spans")), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    marks = spans.select("key", "n", "spans", (F.col("copies") > 1).alias("whole"))
    out = texts.withColumn("n", F.octet_length("text").cast("long")).join(F.broadcast(marks) if small else marks, ["key", "n"], "left")
    return out.select("doc_id", "text", "spans", F.coalesce("whole", F.lit(False)).alias("whole")).mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeated strings of LENGTH bytes cover.

    Null and empty texts have none.  A row for each row; repeated rows are copies, so texts of LENGTH bytes and more go as a whole.  Nothing is
    kept of the places of a repeat, whichever came first.  An empty table gives no rows; further columns aren't read.
    """
    return remove_repeats(read(spark, sf_dir, "documents"))
