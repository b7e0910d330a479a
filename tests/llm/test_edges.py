"""Every operator and stage on rows with nulls, empty, long and repeated texts, clashing columns, and on empty tables."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quillon.llm import bwt_dedup, bytescan, fingerprints, jaccard, langid, licenses, packing, quality, secrets, toxicity
from quillon.llm.decontaminate import find_contamination, without_contamination

LINE = "the quick brown fox jumps over the lazy dog while seven grey geese walk home slowly "
ROWS = [(1, LINE * 3), (2, LINE * 3), (2, LINE * 3), (3, None), (4, ""), (5, "x"), (None, LINE * 3 + "end"), (None, None), (7, "é" * 3000), (8, "ab cd " * 20000), (9, " \n\t"), (10, "password = hunter2hunter2 MIT License")]
IDS = Counter(i for i, _ in ROWS)
#: Names that the operators use themselves.
CLASHING = ["n_words", "licenses", "secrets", "toxicity", "spans", "cuts", "items", "_text", "_words", "_row", "_assign", "_hex", "_entropy", "_hits", "_secrets", "_toxicity", "_spans", "key", "n", "y", "count", "hash", "part", "score", "lang_pred"]
LABELS = [(1, 1, 0), (2, 0, 1), (5, None, None), (7, 1, 0), (8, 0, 1), (10, 1, 0), (None, 1, 1), (99, 0, 0)]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None, None, *(f"own {c}" for c in CLASHING)) for i, t in ROWS], schema).repartition(3)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, odd):
    """A folder of tables with the odd rows, and one of empty tables."""
    out = []
    for name, cut in (("odd", lambda d: d), ("empty", lambda d: d.limit(0))):
        root = str(tmp_path_factory.mktemp(name))
        cut(odd).write.parquet(f"{root}/documents.parquet")
        cut(spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).write.parquet(f"{root}/labels.parquet")
        cut(spark.createDataFrame([(1, "Seven grey geese walk home slowly"), (2, None), (3, ""), (None, "x y z")], "item_id long, text string")).write.parquet(f"{root}/benchmark.parquet")
        out.append(root)
    return out


OPERATORS = {
    "licences": lambda d, l, b: licenses.scan(d),
    "packing": lambda d, l, b: packing.pack(d),
    "quality": lambda d, l, b: quality.score(d, l),
    "near": lambda d, l, b: jaccard.near_duplicates(d),
    "prints": lambda d, l, b: fingerprints.with_fingerprint(d),
    "toxicity": lambda d, l, b: toxicity.score(d, l),
    "leaks": lambda d, l, b: find_contamination(d, b),
    "cut": lambda d, l, b: without_contamination(d, b),
    "secrets": lambda d, l, b: secrets.scan(d),
    "language": lambda d, l, b: langid.identify(d, langid.fit(d)),
    "repeats": lambda d, l, b: bwt_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, tables, name):
    for root, ids in zip(tables, (IDS, Counter()), strict=True):
        read = lambda t: spark.read.parquet(f"{root}/{t}.parquet")  # noqa: B023, E731
        rows = OPERATORS[name](read("documents"), read("labels"), read("benchmark")).collect()
        assert (Counter(r.doc_id for r in rows) if name != "packing" else Counter({i: ids[i] for i in {r.doc_id for r in rows}})) == ids
        if name in ("quality", "toxicity"):
            assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
            assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % {"quality": 3, "toxicity": 5}[name] == {"quality": 1, "toxicity": 0}[name]) for r in rows)


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, tables, stage):
    name, run = corpus_pipeline.STAGES[stage]
    for root in tables:
        docs = spark.read.parquet(f"{root}/documents.parquet")
        out = run(spark, docs, root)
        rows = out.collect()
        if stage == len(corpus_pipeline.STAGES) - 1:
            continue
        assert out.schema.fieldNames() == docs.columns
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
        if name in ("decontamination", "secrets"):
            assert len(rows) == docs.count()
    assert corpus_pipeline.run(spark, tables[1]).count() == 0
    if name == "jaccard":  # rows without an id and texts without words always stay; repeated rows of one text are one
        kept = Counter(r.doc_id for r in run(spark, spark.read.parquet(f"{tables[0]}/documents.parquet"), tables[0]).collect())
        assert kept == Counter({1: 1, 3: 1, 4: 1, 5: 1, None: 2, 7: 1, 8: 1, 9: 1, 10: 1})


def test_repeated_rows_keep_the_bound_of_training(spark):
    from quillon.llm.common import labelled

    docs = spark.createDataFrame([(1, "b"), (1, "a")] * 50 + [(2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in labelled(docs, marks, "toxic", 5, 9, 10).collect()) == [(1, "a", 1), (2, "", 0)]


def shingles(text):
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in text).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_equal_brute_force(spark):
    """Texts of 3 to 300 words, edited at 0 to 20 % of their words, and chains of edits: components by all pairs."""
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice((3, 8, 12, 20, 40, 90, 300)))]
        for _ in range(rng.randrange(1, 9)):
            texts.append(" ".join(words))
            for _ in range(rng.randrange(0, 1 + len(words) // 20)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and 100 * k >= 75 * (len(a) + len(sets[j]) - k):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("hot", [2048, 1])
def test_kept_bytes_equal_brute_force(spark, monkeypatch, hot):
    """SHA-256 of what stays, spans and sizes, for repeats inside a text, overlaps, copies and multi-byte letters; also where anchors are hot."""
    monkeypatch.setattr(bwt_dedup, "HOT", hot)
    monkeypatch.setattr(bwt_dedup, "OFTEN", 1 if hot == 1 else 8)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    p, q = word(700), word(420)
    texts = [word(90) + p + word(50), p[100:] + word(30) + q, q[:410] + word(5) + q, word(500), word(500), None, "", p[:399], "ab" * 450]
    texts += [texts[3], word(20) + p[:500] + q[5:] + word(9)]
    data = [(t or "").encode() for t in texts]
    count = Counter(d[k : k + 400] for d in data for k in range(len(d) - 399))
    got = {r.doc_id: r for r in bwt_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    for i, d in enumerate(data):
        gone = [False] * len(d)
        for k in range(len(d) - 399):
            if count[d[k : k + 400]] > 1:
                gone[k : k + 400] = [True] * 400
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        runs = sum(g and not h for g, h in zip(gone, [False, *gone], strict=False))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()), i


def linked_with(spark, texts):
    """(found, by brute force): the pairs of texts that are linked, where all components are pairs."""
    got = {}
    for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect():
        got.setdefault(r.component_id, []).append(r.doc_id)
    return {tuple(sorted(g)) for g in got.values() if len(g) > 1}


def test_appended_words_link_short_texts(spark):
    """Texts of 8 to 18 words and the same with one word more, beside many unrelated short texts."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts, expected = [], set()
    for n in range(8, 19):
        for _ in range(60):
            words = [word() for _ in range(n)]
            expected.add((len(texts), len(texts) + 1))
            texts += [" ".join(words), " ".join([*words, word()])]
            texts += [" ".join(word() for _ in range(n)) for _ in range(2)]
    assert linked_with(spark, texts) == expected


def test_far_nodes_of_a_large_bucket_are_compared(spark, monkeypatch):
    """Pairs whose only common signature is that of a bucket with many unrelated texts."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, expected = [], set()
    for _ in range(40):
        text = words(30)
        expected.add((len(texts), len(texts) + 1))
        texts += [" ".join(text), " ".join([*text, *words(2)])]
    one = lambda row, sets, sizes, *_: (np.arange(len(sizes)), np.full(len(sizes), 7, np.uint64))
    monkeypatch.setattr(jaccard, "signatures", one)
    assert linked_with(spark, texts) == expected


def toxic_tables(spark, n, rare, first=0):
    """n ordinary and n toxic texts of the same words; the toxic ones ``rare`` of first, first + 1, ... have a word of their own."""
    rng = random.Random(13)
    rows = [(i, " ".join(f"word{rng.randrange(50)}" for _ in range(12)) + (" zqxj" if first <= i - n < first + rare else " bad" if i >= n and i % 2 else "")) for i in range(2 * n)]
    labels = [(i, int(i >= n)) for i, _ in rows]
    asked = [(-1, "word1 word2 zqxj word3"), (-2, "word1 word2 vkpw word3")]
    return spark.createDataFrame(rows + asked, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def asked_scores(scores):
    return {r.doc_id: r.score for r in scores.where("doc_id < 0").collect()}


def test_rare_toxic_words_are_known(spark):
    """A word in 6 of 1200 toxic texts, fewer than 1/300 of what is counted, raises the score."""
    got = asked_scores(toxicity.score(*toxic_tables(spark, 1200, 6)))
    assert got[-1] > got[-2]


def test_texts_beyond_the_bound_are_counted(spark, monkeypatch):
    """The bound holds for the logistic fit alone; and shards give the same scores."""
    tables = toxic_tables(spark, 300, 30)
    got = asked_scores(toxicity.score(*tables, bound=8))
    assert got[-1] > got[-2]
    assert toxicity.training(*tables, bound=8).where("later").groupBy("y").count().where("count > 2").count() == 0
    assert toxicity.training(*tables, bound=8).where("not later").count() > 400
    monkeypatch.setattr(toxicity, "SHARD", 100)
    assert asked_scores(toxicity.score(*tables, bound=8)) == pytest.approx(got, abs=1e-9)


@pytest.mark.parametrize("forced", [None, (1, True), (3, True), (3, False), (12, True), (40, False)])
def test_linked_sets_share_a_signature(monkeypatch, forced):
    """Sets at the limit of linking, with frequent shingles and any allocation, also of too few segments."""
    if forced:
        monkeypatch.setattr(jaccard, "allocation", lambda *_: forced)
    rng = np.random.default_rng(21)
    often = np.unique(rng.integers(0, 1 << 52, 300).astype(np.uint64))
    levels = (often, (1 + np.arange(len(often)) % jaccard.LEVELS).astype(np.uint8))
    for p in [*range(1, 40), 63, 64, 127, 128, 300]:
        for _ in range(6):
            own = np.unique(np.concatenate([rng.integers(0, 1 << 52, p), rng.choice(often, min(p, int(rng.integers(0, 200))))]).astype(np.uint64))
            rng.shuffle(own)
            x, q = own[:p], p * 100 // 75
            drop = int(rng.integers(0, jaccard.difference(p) + 1))
            extra = rng.integers(0, 1 << 52, q - p).astype(np.uint64)[: max(0, jaccard.difference(p) - drop)]
            y = np.concatenate([x[drop:], extra])
            common, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            if not len(y) or 100 * common < 75 * union:
                continue
            sets, row = np.concatenate([np.sort(x), np.sort(y)]), np.repeat([0, 1], [len(x), len(y)])
            r, sig = jaccard.signatures(row, sets, np.array([len(x), len(y)]), levels)
            assert len(np.intersect1d(sig[r == 0], sig[r == 1])), (p, len(y), forced)


def test_words_of_a_block_take_little_memory():
    """Workers share an executor's memory with the JVM: words are hashed a stretch at a time, with the same hashes, also of longer words."""
    rng = np.random.default_rng(5)
    data = rng.choice(np.frombuffer(b"abcdefgXYZ ", np.uint8), 3 << 20)
    data[1 << 20 : (1 << 20) + 3 * bytescan.STRIDE] = ord("x")
    offsets = np.array([0, 1 << 21, 1 << 21, len(data)])
    row, start, end = bytescan.spans(data, offsets, bytescan.WORD_BYTES)
    want = bytescan.range_hash(bytescan.prefix_hash(bytescan.LOWER[data]), start, end)
    tracemalloc.start()
    got = bytescan.words(data, offsets, bytescan.WORD_BYTES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(x, y) for x, y in zip(got, (row, start, end, want), strict=True))
    assert peak < 16 * len(data), peak


def test_frequent_shingles_are_counted_in_all_rows(spark, monkeypatch):
    """Lines at the limits of the levels, in a table of which one text in two was sampled before; added up over several blobs."""
    rows, line = 2 * 8192 + 100, "all {} rows are counted"
    want = {5: 0, 6: 1, 23: 1, 24: 2, 95: 2, 96: 3, 500: 3}
    last = np.cumsum(list(want))
    texts = [f"a{i} b{i} c{i} d{i} e{i}" + (" " + line.format(list(want)[np.searchsorted(last, i, "right")]) if i < last[-1] else "") for i in range(rows)]
    random.Random(3).shuffle(texts)
    monkeypatch.setattr(jaccard, "HELD_SHINGLES", 1000, raising=False)
    shingles, levels = jaccard._often(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    data = np.frombuffer("".join(line.format(k) for k in want).encode(), np.uint8)
    row, sets = jaccard.shingle_sets(data, np.concatenate(([0], np.cumsum([len(line.format(k)) for k in want]))))
    assert dict(zip(shingles.tolist(), levels.tolist(), strict=True)) == {s: x for s, x in zip(sets.tolist(), [list(want.values())[r] for r in row], strict=True) if x}


def test_stage_counts_shingles_of_all_texts_it_gets(spark, monkeypatch):
    """The pipeline's stage for near copies: a line at the limit in its rows is frequent, one in a row less is not; no text is left out."""
    for name, value in (("ROWS", 8), ("MOST", 2), ("SAMPLE", 8), ("EVERY", 2)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    often, seen = jaccard._often, []
    monkeypatch.setattr(jaccard, "_often", lambda *a: seen.append(often(*a)) or seen[-1])
    lines = {"every one of these counts": range(0, 40, 7), "none of these five counts": range(1, 40, 8)}
    docs = [(i, f"a{i} b{i} c{i} d{i} e{i} " + " ".join(x for x, at in lines.items() if i in at)) for i in range(40)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert kept.count() == 40
    data = np.frombuffer(next(iter(lines)).encode(), np.uint8)
    assert [len(x) for x in lines.values()] == [6, 5]
    assert [s.tolist() for s, _ in seen] == [jaccard.shingle_sets(data, np.array([0, len(data)]))[1].tolist()]


def test_limit_of_frequent_shingles_stays_in_larger_tables(spark, monkeypatch):
    """A line in 18 rows is frequent in a table of any size, so buckets of rarer lines don't grow with the table; links are the same."""
    monkeypatch.setattr(jaccard, "ROWS", 4)
    lines = {"a line that eighteen have": 18, "a line that seventeen have": 17}
    texts = [f"a{i} b{i} c{i} d{i} e{i}" + "".join(f" {x}" for x, n in lines.items() if i < n) for i in range(1000)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[3], texts[900]])), "doc_id long, text string").repartition(3)
    line = np.frombuffer(next(iter(lines)).encode(), np.uint8)
    shingles, _ = jaccard._often(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert shingles.tolist() == jaccard.shingle_sets(line, np.array([0, len(line)]))[1].tolist()
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: {1000: 3, 1001: 900}.get(i, i) for i in range(1002)}


def test_rounds_do_not_take_the_pairs_apart_again(spark, monkeypatch):
    """Every round over large buckets reads the sketches as they were written, not all candidate pairs anew."""
    apart, plans = jaccard._apart, []
    monkeypatch.setattr(jaccard, "_apart", lambda star, sketched, *a: plans.append(sketched._jdf.queryExecution().toString()) or apart(star, sketched, *a))
    docs = [(i, " ".join(f"w{k}" for k in range(60)) + f" end{i}") for i in range(8)]
    found = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0} and len(found) == 8
    assert plans and not any("explode" in p.lower() for p in plans)


def test_frequent_grams_are_held_without_their_blocks():
    """What a task holds of the grams around hot anchors doesn't grow with the text that it looks through; every text's are counted."""
    rng = np.random.default_rng(6)
    word = lambda n: rng.choice(np.frombuffer(b"abcdefgh", np.uint8), n).tobytes()
    passage, length, gram = word(900), bwt_dedup.LENGTH, bwt_dedup.GRAM
    _, _, _, _, h = bwt_dedup.runs(np.frombuffer(passage, np.uint8), np.array([0, len(passage)]), length, gram)

    class Anchors:
        value = np.sort(bwt_dedup._short(np.unique(h), 7))

    def peak(n):
        batch = pa.RecordBatch.from_arrays([pa.array([word(300_000) + passage for _ in range(n)], pa.binary())], names=["text"])
        tracemalloc.start()
        got = pa.Table.from_batches(bwt_dedup._frequent(7, length, gram, Anchors, n)([batch]))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert set(got["gram"].to_numpy().view(np.uint64).tolist()) == set(bwt_dedup.grams(np.frombuffer(passage, np.uint8), gram).tolist())
        assert min(got["n"].to_pylist()) >= n
        return most

    least = peak(6)
    assert peak(60) < 1.5 * least


def test_repeats_write_no_table_that_is_read_once(spark, monkeypatch):
    """Also where anchors are hot, three tables are written, each once; spans that are final in their block take the contexts' way."""
    monkeypatch.setattr(bwt_dedup, "HOT", 1)
    monkeypatch.setattr(bwt_dedup, "OFTEN", 1)
    write, names = bwt_dedup.written, []
    monkeypatch.setattr(bwt_dedup, "written", lambda df, name: names.append(name) or write(df, name))
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    passage = word(600)
    docs = [(i, f"{word(300)}{chr(65 + i)}{passage}{chr(65 + i)}{word(300)}") for i in range(8)]
    found = bwt_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(1)).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in found} == {i: (600, 1) for i in range(8)}
    assert sorted(names) == ["bwt-anchors", "bwt-flags", "bwt-spans"]


def test_anchors_are_looked_for_a_stretch_at_a_time():
    """Memory doesn't grow with the block of texts; runs are those of each text alone."""
    rng = np.random.default_rng(9)

    def found(n):
        data, offsets = rng.choice(np.frombuffer(b"abcdefgh", np.uint8), 10_000 * n), np.arange(n + 1) * 10_000
        bytescan.powers(len(data) + 1)
        tracemalloc.start()
        got = bwt_dedup.runs(data, offsets, bwt_dedup.LENGTH, bwt_dedup.GRAM)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        alone = [bwt_dedup.runs(data[s : s + 10_000], offsets[:2], bwt_dedup.LENGTH, bwt_dedup.GRAM) for s in offsets[:-1]]
        assert [x.tolist() for x in got] == [np.concatenate([x[k] + (i if k == 0 else i * 10_000 if k < 4 else np.uint64(0)) for i, x in enumerate(alone)]).tolist() for k in range(5)]
        return most

    least = found(60)
    assert found(480) < 1.5 * least
