"""Benchmark decontamination with one FM-index per training shard.

A shard is a block of texts.  Words (A-Z lower-cased) are numbered by the test set's vocabulary;
a word that no test item has ends a run, and a run shorter than the shortest window can't hold
one, so the index covers the remaining runs only.  That is exact, and usually a small part of
the text.

The index: the suffix array of the runs, its Burrows-Wheeler transform, a wavelet matrix over the
transform for ranks, and suffix positions sampled at every SAMPLE-th place of the shard.  All
distinct windows are searched backward together, a word at a time; the rows found are walked with
the LF-mapping to the next sampled position.  Spans that overlap are merged.

The test set is the query side.  It is sent to the executors in blocks of at most BLOCK_WORDS
words; with more than one, the texts pass through one search after another without a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import bytescan as B
from quillon.llm.common import read

WINDOW = 10
SAMPLE = 8
SHARD_BYTES = 3 << 20
#: Words of test items that are sent to the executors at once (8 bytes each, and as much for the windows).
BLOCK_WORDS = 2_000_000


class Wavelet:
    """Wavelet matrix: how often a symbol stands among the first i of a sequence."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            below = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones == 0, out=below[1:])
            zeros = int(below[-1])
            self.levels.append((bit, below, zeros))
            values = values[np.argsort(ones, kind="stable")]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for bit, below, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = below[start], below[i]
            start, i = np.where(one, zeros + start - a, a), np.where(one, zeros + i - b, b)
        return i - start


class FMIndex:
    """Of a sequence of symbols from 1 up in which 0 closes each run."""

    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        n = len(text)
        # closing zeros differ, in the order of their places, so all suffixes differ
        closing = text == 0
        first = np.where(closing, np.cumsum(closing) - 1, text + int(closing.sum()))
        _, rank = np.unique(first, return_inverse=True)
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank.astype(np.int64) * (n + 2) + after
            sa = np.argsort(key)
            ordered = key[sa]
            new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = np.empty(n, np.int64)
            rank[sa] = new
            if new[-1] == n - 1:
                break
            step *= 2
        self.n, self.sample = n, sample
        bwt = text[sa - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 2))))
        self.tree = Wavelet(bwt, top)
        self.bwt = bwt
        self.sampled = (sa % sample == 0) | closing[sa - 1]
        self.index = np.cumsum(self.sampled) - 1
        self.places = sa[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns (right-aligned in a matrix, last symbol in the last column)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for k in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= k) & (low < high))
            if not len(live):
                break
            c = patterns[live, -k]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, back = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left, at = np.arange(len(rows)), rows.copy()
        while len(left):
            done = self.sampled[at]
            out[left[done]] = self.places[self.index[at[done]]] + back[left[done]]
            left, at = left[~done], at[~done]
            back[left] += 1
            c = self.bwt[at]
            at = self.before[c] + self.tree.rank(c, at)
        return out


class Windows:
    """The distinct windows of a block of test items, over the items' own vocabulary."""

    def __init__(self, texts: list[str | None], ids: list[str], window: int):
        data, offsets = B.flat(pa.array(texts, pa.large_string()))
        row, _, _, h = B.words(data, offsets, B.WORD_BYTES)
        self.vocabulary, number = np.unique(h, return_inverse=True)
        number = number.astype(np.int64) + 1
        first = B.first_of(row, len(texts))
        found: dict[tuple, set[int]] = {}
        for i in range(len(texts)):
            own = number[first[i] : first[i + 1]].tolist()
            if own:
                for k in range(max(1, len(own) - window + 1)):
                    found.setdefault(tuple(own[k : k + window]), set()).add(i)
        self.ids = ids
        self.length = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for i, w in enumerate(found):
            self.patterns[i, window - len(w) :] = w
        self.items = [sorted(x) for x in found.values()]
        self.shortest = int(self.length.min()) if len(found) else 0


def _hits(windows: Windows, data: np.ndarray, offsets: np.ndarray):
    """(row, start, end of each word), and per row the merged word spans and item numbers."""
    row, start, end, h = B.words(data, offsets, B.WORD_BYTES)
    nothing = ({}, {})
    if not len(row) or not len(windows.patterns):
        return row, start, end, *nothing
    at = np.minimum(np.searchsorted(windows.vocabulary, h), len(windows.vocabulary) - 1)
    symbol = np.where(windows.vocabulary[at] == h, at + 1, 0)
    # runs of known words that are long enough
    known = symbol > 0
    new = np.concatenate(([True], (known[1:] != known[:-1]) | (row[1:] != row[:-1])))
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(row)))
    good = known[head] & (size >= windows.shortest)
    head, size = head[good], size[good]
    if not len(head):
        return row, start, end, *nothing
    total = int(size.sum()) + len(head)
    text, origin = np.zeros(total, np.int64), np.zeros(total, np.int64)
    base = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    inner = np.repeat(base - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    word = np.repeat(head - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    text[inner], origin[inner] = symbol[word], word
    index = FMIndex(text, len(windows.vocabulary))
    low, high = index.search(windows.patterns, windows.length)
    hit = np.flatnonzero(low < high)
    if not len(hit):
        return row, start, end, *nothing
    many = high[hit] - low[hit]
    rows = np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    which = np.repeat(hit, many)
    place = origin[index.locate(rows)]
    order = np.argsort(place, kind="stable")
    spans: dict[int, list[list[int]]] = {}
    items: dict[int, set[int]] = {}
    for p, w in zip(place[order].tolist(), which[order].tolist(), strict=True):
        r = int(row[p])
        own = spans.setdefault(r, [])
        stop = p + int(windows.length[w])
        if own and p <= own[-1][1]:
            own[-1][1] = max(own[-1][1], stop)
        else:
            own.append([p, stop])
        items.setdefault(r, set()).update(windows.items[w])
    return row, start, end, spans, items


def _scan(windows: Windows, names: list[str], schema: pa.Schema):
    """Adds to n_words, spans (word spans), cuts (byte spans) and items of each row."""

    def run(batches):
        for batch in batches:
            text = batch.column(names.index("text"))
            for a, b, data, offsets in B.blocks(text, SHARD_BYTES, 1 << 30):
                row, start, end, spans, items = _hits(windows, data, offsets)
                first = B.first_of(row, b - a)
                kept = batch.slice(a, b - a)
                new = {n: kept.column(names.index(n)) for n in NEW}
                new["n_words"] = pa.array(np.diff(first), pa.int64())
                if spans:
                    part = {n: new[n].to_pylist() for n in NEW[1:]}
                    for r, own in spans.items():
                        part["spans"][r] += [[s - int(first[r]), e - int(first[r])] for s, e in own]
                        part["cuts"][r] += [[int(start[s] - offsets[r]), int(end[e - 1] - offsets[r])] for s, e in own]
                        part["items"][r] += [windows.ids[i] for i in items[r]]
                    new |= {n: pa.array(x, schema.field(n).type) for n, x in part.items()}
                out = [new.get(n, kept.column(i)) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(out, schema=pa.schema([pa.field(n, c.type) for n, c in zip(names, out, strict=True)]))

    return run


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of documents, with n_words, spans (of words), cuts (of UTF-8 bytes) and items.

    Spans of one block of test items are merged; those of several blocks may overlap.  Null and
    empty texts have no words; items without words have no window; equal items all count, also
    those with a null id, which is an empty string in ``items``.  Columns with these names are
    replaced.
    """
    return _searched(documents.drop(*NEW), benchmark, window, None, None)


def without_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of documents; what the benchmark has too is cut out of the text."""
    kept = documents.drop(*NEW)
    return _searched(kept, benchmark, window, _cut, kept.schema)


NEW = ("n_words", "spans", "cuts", "items")


def _searched(texts: DataFrame, benchmark: DataFrame, window: int, finish, schema) -> DataFrame:
    """One pass over the texts for each block of test items; ``finish`` works on the last one's batches in the same worker."""
    kinds = {"n_words": "long", "spans": "array<array<int>>", "cuts": "array<array<int>>", "items": "array<string>"}
    out = texts.select(*texts.columns, *((F.lit(0) if n == "n_words" else F.array()).cast(k).alias(n) for n, k in kinds.items()))
    arrow = pa.schema([pa.field("spans", pa.list_(pa.list_(pa.int32()))), pa.field("cuts", pa.list_(pa.list_(pa.int32()))), pa.field("items", pa.list_(pa.string()))])
    names, between = out.columns, out.schema
    windows = list(blocks_of(benchmark, window))
    for w in windows[:-1]:
        out = out.mapInArrow(_scan(w, names, arrow), between)
    last = _scan(windows[-1], names, arrow)
    return out.mapInArrow((lambda batches: finish(last(batches))) if finish else last, schema or between)


def blocks_of(benchmark: DataFrame, window: int):
    """The test items, fetched a partition at a time, in blocks of bounded size (one at least)."""
    texts, ids, size, made = [], [], 0, False
    for x in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        texts.append(x.t)
        ids.append(x.i)
        size += len(x.t) // 3 + 1
        if size >= BLOCK_WORDS:
            yield Windows(texts, ids, window)
            texts, ids, size, made = [], [], 0, True
    if texts or not made:
        yield Windows(texts, ids, window)


def _digest(batches):
    for batch in batches:
        spans_of, items_of = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("spans", "items"))
        hit, items, digest = [], [], []
        for spans, found in zip(spans_of, items_of, strict=True):
            covered, last = 0, 0
            for s, e in sorted(spans):
                covered += max(0, e - max(s, last))
                last = max(last, e)
            hit.append(covered)
            found = sorted(set(found))
            items.append(len(found))
            digest.append(hashlib.sha256(",".join(found).encode()).hexdigest())
        own = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "n_words")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def _cut(batches):
    """Batches without the columns that the search added, and without the texts' byte spans."""
    for batch in batches:
        names = batch.schema.names
        text = batch.column(names.index("text"))
        found = {i: x for i, x in enumerate(batch.column(names.index("cuts")).to_pylist()) if x}
        if found:
            new = []
            for i, own in found.items():
                raw, kept, last = text[i].as_py().encode(), [], 0
                for s, e in sorted(own):
                    kept.append(raw[last:s] if s > last else b"")
                    last = max(last, e)
                new.append(b"".join([*kept, raw[last:]]).decode())
            mask = np.zeros(len(text), bool)
            mask[list(found)] = True
            text = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
        keep = [n for n in names if n not in NEW]
        yield pa.RecordBatch.from_arrays([text if n == "text" else batch.column(names.index(n)) for n in keep], names=keep)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document.

    Null and empty texts have no words and no hits; null and empty items have no windows; a null item_id counts as an empty string.  A row for
    each row; repeated rows and overlapping hits are each counted as the contract says, a word once.  An empty benchmark hits
    nothing, an empty table gives no rows; further columns aren't read.
    """
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([T.StructField(n, T.StringType() if n == "items_sha256" else T.LongType()) for n in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256")])
    out = _searched(texts, read(spark, sf_dir, "benchmark"), WINDOW, _digest, schema)
    return out.withColumn("contaminated", F.col("n_hit") > 0)
