"""Packing tokenised documents into fixed windows by the online sum-of-squares rule.

Every document is tokenised, closed with an end id and cut: whole windows are sequences of
their own, and the rest is placed, as it arrives, so that the sum over all fill levels h of
N(h)**2 becomes smallest, N(h) being the number of open windows filled up to h (Csirik,
Johnson, Kenyon, Orlin, Shor, Weber, "On the sum-of-squares algorithm for bin packing",
J. ACM 2006).  Putting a piece of s ids on a window at level h changes the sum by
2 * (N(h+s) - N(h) + 1), and opening a window by 2 * N(s) + 1; a filled window adds nothing.
N is one array, so the best level is one vectorised minimum.

Each task packs what it reads and needs no exchange: the state is the level array, whatever
the input.  What is open at a task's end is emptied into the gaps of the others (pieces may be
cut), and the last window is cut at powers of two, which need no padding.  Equal scans give
equal sequences, so a task that runs again after a lost executor gives the same rows.

Null and empty texts are the end id alone.  Equal rows are packed once each.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import read

WINDOW = 2048
END_ID = 1
#: Added tokens of byte_bpe_50k.json; the rank file doesn't have them.
ADDED = {"<|endoftext|>": 50256}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoding: dict[str, object] = {}


def encoder(path: str | None = None):
    """Ids of the 50k byte-level BPE; an added token's string in a text is that token, as in tokenizers.

    The rank file holds the same vocabulary as ``byte_bpe_50k.json`` and gives the same ids
    (tests compare them) at about four times the speed.
    """
    import public_tokenizers as public

    path = path or public.path("byte_bpe_50k.tiktoken")
    if path not in _encoding:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoding[path] = tiktoken.Encoding("bytes50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    return partial(_encoding[path].encode, allowed_special="all")


class SumOfSquares:
    """Level array and open windows of one task.  ``done`` collects (sequence, pieces)."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.next = 0

    def new(self) -> list:
        """A window: [sequence number, fill, pieces]."""
        self.next += 1
        return [self.next - 1, 0, []]

    def place(self, piece: tuple) -> list | None:
        """Puts a piece (doc, start, length) where the sum of squares grows least; a window that is now full."""
        s, b, n = piece[2], self.window, self.count
        best, level = 2 * n[s] + 1 if s < b else 0, 0
        if s < b:
            gain = 2 * (n[s + 1 :] - n[1 : b - s + 1] + 1)
            gain[-1] = 1 - 2 * n[b - s]  # a full window counts no more
            gain[n[1 : b - s + 1] == 0] = np.iinfo(np.int64).max
            at = len(gain) - 1 - int(np.argmin(gain[::-1]))
            if gain[at] <= best:
                level = at + 1
        if level:
            w = self.open[level].pop()
            n[level] -= 1
        else:
            w = self.new()
        w[2].append(piece)
        w[1] += s
        if w[1] == b:
            return w
        n[w[1]] += 1
        self.open[w[1]].append(w)
        return None

    def close(self):
        """The windows that are open at the end, without padding: emptiest ones fill the gaps of the fullest."""
        left = sorted((w for ws in self.open.values() for w in ws), key=lambda w: (-w[1], w[0]))
        self.open.clear()
        low, high = 0, len(left) - 1
        while low < high:
            target, source = left[low], left[high]
            room = self.window - target[1]
            doc, start, length = source[2].pop()
            take = min(room, length)
            target[2].append((doc, start, take))
            target[1] += take
            source[1] -= length
            if take < length:
                source[2].append((doc, start + take, length - take))
                source[1] += length - take
            if target[1] == self.window:
                yield target
                low += 1
            if not source[1]:
                high -= 1
        if low == high and left[low][1]:
            yield from self.halve(left[low])

    def halve(self, w: list):
        """The last window as sequences of power-of-two lengths."""
        pieces = list(reversed(w[2]))
        rest = w[1]
        while rest:
            size = 1 << (rest.bit_length() - 1)
            out, rest = self.new(), rest - size
            while size:
                doc, start, length = pieces.pop()
                take = min(size, length)
                out[2].append((doc, start, take))
                out[1] += take
                size -= take
                if take < length:
                    pieces.append((doc, start + take, length - take))
            yield out


def pack(documents: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Pieces of sequences; see the module's text.  ``offset`` runs gapless from 0 in each sequence."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 40
        encode, packer = encoder(tokenizer), SumOfSquares(window)
        ids: dict[int, tuple] = {}  # of documents with pieces in open windows
        waiting: dict[int, int] = {}
        rows: list[tuple] = []
        serial = 0

        def emit(w):
            offset = 0
            for doc, start, length in w[2]:
                doc_id, base, total, tokens = ids[doc]
                rows.append((doc_id, start, length, zlib.crc32(tokens[start - base : start - base + length].tobytes()), total, part + w[0], offset))
                offset += length
                waiting[doc] -= length
                if not waiting[doc]:
                    del ids[doc], waiting[doc]

        def out():
            columns = list(zip(*rows, strict=True))
            kept = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return kept

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.array([*encode(text.as_py() or ""), end_id], np.uint32)
                total, whole = len(tokens), len(tokens) // window * window
                ids[serial], waiting[serial] = (doc_id, 0, total, tokens), total
                for start in range(0, whole, window):
                    w = packer.new()
                    w[2].append((serial, start, window))
                    emit(w)
                if whole < total:
                    ids[serial] = (doc_id, whole, total, tokens[whole:].copy())
                    if w := packer.place((serial, whole, total - whole)):
                        emit(w)
                serial += 1
                if len(rows) >= 20000:
                    yield out()
        for w in packer.close():
            emit(w)
        if rows:
            yield out()

    return documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of WINDOW ids.

    A null or empty text is the end id alone; a null doc_id stays null.  Repeated rows are packed once each.  Among equally
    good levels the fullest window takes a piece.  An empty table gives no rows; further columns aren't read.
    """
    return pack(read(spark, sf_dir, "documents"))
