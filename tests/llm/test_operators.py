"""Edge cases: nulls, empty and long texts, repeated rows, empty tables, clashing columns; and exact results on small tables."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import bwt_dedup, fingerprints, jaccard, langid, licenses, packing, secrets
from quillon.llm.decontaminate import find_contamination, without_contamination
from quillon.llm.queries import ORACLES, QUERIES
from tests.compare import DATA, difference

SF = f"{DATA}/sf0.001"
LINE = "the quick brown fox jumps over the lazy dog while seven grey geese walk home slowly "
ROWS = [(1, LINE * 3), (2, LINE * 3), (2, LINE * 3), (3, None), (4, ""), (5, "x"), (None, LINE * 3 + "end"), (7, "é" * 3000), (8, "ab cd " * 20000), (9, " \n\t"), (10, "password = hunter2hunter2 MIT License")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "own", 1, 2) for i, t in ROWS], "doc_id long, text string, n_words string, n int, secrets int").repartition(3)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), ORACLES[name], SF) == (True, {}, {})


def test_near_duplicates(spark, odd):
    got = Counter((r.doc_id, r.component_id) for r in jaccard.near_duplicates(odd).collect())
    assert got == Counter({(1, 1): 1, (2, 1): 2, (3, 3): 1, (4, 4): 1, (5, 5): 1, (None, 1): 1, (7, 7): 1, (8, 8): 1, (9, 9): 1, (10, 10): 1})
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


def test_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    shared = [word(450), word(399), word(400), "a" * 900]
    rows = [(i, word(int(rng.integers(0, 300))) + shared[i % 4] + word(int(rng.integers(0, 300)))) for i in range(24)] + [(99, None), (100, word(50))]
    got = {r.doc_id: r.n_removed for r in bwt_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    count = Counter(t[k : k + 400] for _, t in rows if t for k in range(len(t) - 399))
    for i, t in rows:
        gone = {j for k in range(len(t or "") - 399) if count[t[k : k + 400]] > 1 for j in range(k, k + 400)}
        assert got[i] == len(gone), i


def test_packing_keeps_every_id(spark, odd):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = packing.pack(odd).collect()
    total = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in ROWS)
    assert sum(r.length for r in rows) == total and packing.encoder()(ROWS[0][1]) == t.encode(ROWS[0][1], add_special_tokens=False).ids
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert all(n <= 2048 and (n == 2048 or n & (n - 1) == 0) for n in fill.values())
    assert packing.pack(odd.limit(0)).count() == 0


def test_licences_and_secrets(spark, odd):
    got = {r.doc_id: [x.label for x in r.licenses] for r in licenses.scan(odd).collect()}
    assert got[10] == ["mit"] and got[3] == []
    found = {r.doc_id: [(x.kind, x.start, x.end) for x in r.secrets] for r in secrets.scan(odd).collect()}
    assert found[10] == [("assign", 0, 25)] and found[3] == []
    text = "a" * 5 + " token: abcdefgh1 token=short " + "0123456789abcdef" * 2 + " AKIA" + "Q" * 12 + " k9Xv2Lq8Zt4Rb7Wm1Yc5Hd3 plainwordplainwordplain"
    spans = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().secrets
    assert [(s.kind, text[s.start : s.end]) for s in spans] == [("assign", "token: abcdefgh1"), ("hex", "0123456789abcdef" * 2), ("access", "AKIA" + "Q" * 12), ("entropy", "k9Xv2Lq8Zt4Rb7Wm1Yc5Hd3")]


def test_contamination_is_cut(spark, odd):
    items = spark.createDataFrame([(1, "Seven grey geese walk home slowly"), (2, None), (3, "")], "item_id long, text string")
    hits = {r.doc_id: r.spans for r in find_contamination(odd, items).select("doc_id", "spans").collect()}
    assert hits[1] == [[10, 16], [26, 32], [42, 48]] and hits[8] == [] and hits[3] == []
    cut = {r.doc_id: r.text for r in without_contamination(odd, items).collect()}
    assert "geese" not in cut[1] and cut[8] == ROWS[8][1] and cut[3] is None


def test_fingerprints_follow_the_next_text(spark, odd):
    rows = fingerprints.neighbours(odd).mapInArrow(fingerprints._compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ROWS)
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1


def test_language_profiles(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat with that hat", "en"), ("le chat est sur la table avec une souris", "fr")] * 10)] + [(98, None, "en"), (99, "123 !?", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.fit(df)).collect()}
    assert all(got[i] == lang for i, _, lang in rows[:20]) and got[98] == got[99] == "und"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    clean = corpus_pipeline.replace_secrets(spark, kept, SF)
    assert not [r for r in clean.select("text").collect() if re.search(r"AKIA[A-Z0-9]{12,}", r.text or "")]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_packing_ids_equal_tokenizers_at_defaults(spark):
    import zlib

    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {x.content: i for i, x in t.get_added_tokens_decoder().items()} == packing.ADDED
    texts = ["end of part <|endoftext|> next part", "<|endoftext|><|endoftext|>x", "  <|endoftext|>\n\n y", "<|endoftext|", "é<|endoftext|>é ", "plain", ""]
    expected = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [packing.encoder()(x) for x in texts] == expected
    for i, x in enumerate(texts):
        row = packing.pack(spark.createDataFrame([(i, x)], "doc_id long, text string"), window=64).orderBy("start").collect()
        ids = np.array([*expected[i], packing.END_ID], np.uint32)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in row) and sum(r.length for r in row) == len(ids)
