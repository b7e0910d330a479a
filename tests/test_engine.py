import json

import pytest
from pyspark.sql import functions as F

from quillon.engine import Engine, NotAccessible
from quillon.functions import analysis, jsonpath
from quillon.operators import ontology, query, search
from quillon.operators.store import Store
from quillon.sources import registry

SCHEMA = json.dumps(
    [
        {"collectionName": "public", "properties": [
            {"name": "access", "fieldType": "tokenized_string", "analyzer": "AccessFieldAnalyzer", "parser": "AccessParser", "jsonPaths": ["$.accessTags[*].name"], "toLowerCase": "true"},
            {"name": "accession", "fieldType": "tokenized_string", "jsonPaths": ["$.accNo"]},
            {"name": "type", "fieldType": "untokenized_string", "parser": "TypeParser"},
            {"name": "title", "fieldType": "tokenized_string", "analyzer": "ExperimentTextAnalyzer", "jsonPaths": ["$.section.attributes[?(@.name == 'Title')].value"]},
            {"name": "content", "fieldType": "tokenized_string", "analyzer": "ExperimentTextAnalyzer", "parser": "ContentParser", "expanded": True},
            {"name": "rtime", "fieldType": "long", "parser": "ReleaseTimeParser"},
            {"name": "mtime", "fieldType": "long", "parser": "ModificationTimeParser"},
            {"name": "facet.collection", "fieldType": "facet", "jsonPaths": ["$.collections[*].accNo"], "toLowerCase": True, "defaultValue": "None"}]},
        {"collectionName": "Images", "properties": [{"name": "facet.organism", "title": "Organism", "fieldType": "facet"}]},
    ]
)


def record(acc, title, tags=("public",), **more):
    attributes = [{"name": "Title", "value": title}, {"name": "Organism", "value": "Mouse"}, {"name": "organism", "value": "Human"}]
    files = [{"filePath": "a/x.txt", "size": 3, "attributes": [{"name": "Colour", "value": "red"}, {"name": "Colour", "value": "blue"}]}, {"filePath": "b.tar.gz"}]
    return acc, json.dumps({"accNo": acc, "accessTags": [{"name": t} for t in tags], "released": False, "releaseTime": {"$date": {"$numberLong": "86400000"}}, "section": {"type": "Study", "attributes": attributes, "files": files}} | more)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, Store(spark, f"file://{tmp_path_factory.mktemp('store')}"), registry.parse(SCHEMA))
    rows = [record("S-A1", "Lung tissue atlas", collections=[{"accNo": "Images"}]), record("S-A2", "Liver atlas"), record("S-A3", "Hidden atlas", ("secret",))]
    e.index(spark.createDataFrame(rows, "acc_no string, raw string"))
    return e


def test_search_counts_visible_rows(engine):
    got = engine.search("atlas")
    assert got.page.total == 2 and {r.acc_no for r in got.page.rows.collect()} == {"S-A1", "S-A2"}
    assert engine.search("title:lung").page.total == 1
    assert engine.search("atlas", who=search.Principal(superuser=True)).page.total == 3


def test_facets_and_files(engine):
    found = {(r.dim, r.value): r.hits for r in engine.facets().collect()}
    assert found[("facet_organism", "Mouse")] == 1 and found[("facet_collection", "images")] == 1
    page = engine.search_files("S-A1", "*red*")
    assert [(r.file_position, r.file_name, r.attrs) for r in page.rows.collect()] == [(1, "x.txt", {"Colour": "red"})]


def test_lookup_update_delete(engine, spark):
    with pytest.raises(NotAccessible):
        engine.get_submission("S-A3")
    assert engine.get_submission("S-none") is None
    engine.index(spark.createDataFrame([record("S-A2", "Kidney map")], "acc_no string, raw string"))
    assert engine.search("kidney").page.total == 1 and engine.search("liver").page.total == 0
    engine.delete(["S-A2"])
    assert engine.get_submission("S-A2") is None
    assert {s["name"]: s["rows"] for s in engine.stats() if s["name"] != "terms"} == {"files": 4, "submissions": 2, "lengths": 1}


def test_scores_are_those_of_the_whole_index(engine):
    """Access and filters choose rows; they don't change a row's score."""
    every = {r.acc_no: r.score for r in engine.search("atlas", who=search.Principal(superuser=True)).page.rows.collect()}
    mine = {r.acc_no: r.score for r in engine.search("atlas").page.rows.collect()}
    assert mine and set(mine) < set(every) and mine == {k: every[k] for k in mine}


def test_known_words_get_no_suggestions(spark):
    words = spark.createDataFrame([("license", 3), ("licence", 2), ("lichen", 1)], "term string, df long")
    assert ontology.suggestions(words, "license").count() == 0
    assert [r.term for r in ontology.suggestions(words, "licens").collect()] == ["license", "licence", "lichen"]


def test_queries_and_columns_fold_alike(spark):
    fields = query.Fields({"content": "experiment"}, set(), ("content",))
    words = ["straße", "šef", "kuchyně", "łódź", "ærø", "café", "cafe\u0301", "ÞÓR", "Ǻngström", "việt"]
    df = spark.createDataFrame([(w,) for w in words], "content string")
    for w in words:
        got = {r.content for r in df.where(query.predicate(query.parse(w, fields), fields)).collect()}
        assert w in got, w


def test_content_is_tagged_with_the_ontology(spark, tmp_path):
    onto = {
        "nodes": spark.createDataFrame([("T1", "bird", False), ("T2", "owl", False), ("T3", "barn owl", False)], "id string, term string, organizational boolean"),
        "alt": spark.createDataFrame([("T2", "night bird")], "id string, synonym string"),
        "edges": spark.createDataFrame([("T2", "T1"), ("T3", "T2")], "child string, parent string"),
    }
    onto["part_of"] = onto["edges"].limit(0)
    e = Engine(spark, Store(spark, f"file://{tmp_path}/tagged"), registry.parse(SCHEMA), onto)
    e.index(spark.createDataFrame([record("S-B1", "A barn owl at dusk"), record("S-B2", "The night bird, an owl"), record("S-B3", "No animal")], "acc_no string, raw string"))
    rows = {r.acc_no: (r.efo_id, r.efo_term) for r in e.store.read("submissions").collect()}
    assert rows == {"S-B1": (["T3"], ["barn owl"]), "S-B2": (["T2"], ["owl"]), "S-B3": ([], [])}
    assert {(r.dim, r.value): r.hits for r in e.facets().where("dim = 'efo_id'").collect()} == {("efo_id", "T2"): 1, ("efo_id", "T3"): 1}
    assert e.keywords_with_counts("*") == ["barn owl|o||1", "bird|o|T1|2", "owl|o|T2|2"]
    assert [(r.id, r.hits) for r in e.tree_with_counts("T1").collect()] == [("T2", 2)]


def test_chains_end_in_a_cycle(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "a")], "child string, parent string")
    nodes = spark.createDataFrame([(x, x) for x in "abcd"], "id string, term string")
    got = {r.id: r.chain for r in ontology.ancestor_chains({"nodes": nodes, "edges": pairs}).collect()}
    assert all(len(set(c)) == len(c) and c[-1] == k for k, c in got.items()) and set(got["d"]) == set("abcd")


def test_vacuum_keeps_what_the_pointer_names(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/old")
    for n in (3, 4):
        store.commit({"t": spark.range(n)})
    assert store.vacuum() == 0 and store.vacuum(older=-5) == 1 and store.read("t").count() == 4


def test_jsonpath():
    doc = {"a": [{"k": "x", "v": 1}, {"k": "y", "v": [2, 3]}], "b": {"a": [{"k": "x"}]}}
    run = lambda p: jsonpath.values(doc, [jsonpath.compile_path(p)])
    assert run("$.a[?(@.k=='y')].v") == ["2", "3"]
    assert run("$..a[?(@.k =~ /X/i && @.v)].v") == ["1"]
    assert run("$..k") == ["x", "y"] and run("$.none") == []
    assert run('$.a[?(@.k=="x")].concat("true")')[0].endswith("true")
    with pytest.raises(jsonpath.PathError):
        jsonpath.compile_path("$.a[?(")


def test_registry_is_validated():
    for bad in ("", "[]", '[{"collectionName": "a", "properties": [{"name": "x", "fieldType": "no"}]}]', '[{"collectionName": "a", "properties": [{"name": "x", "fieldType": "long"}]}, {"collectionName": "b", "properties": [{"name": "x", "fieldType": "long"}]}]'):
        with pytest.raises(ValueError):
            registry.parse(bad)


def test_query_language():
    fields = query.Fields({"content": "experiment"}, {"n"})
    assert query.parse("a AND b OR c", fields) == query.Bool(should=(query.Bool(must=(query.Term("a"), query.Term("b"))), query.Term("c")))
    for bad in ("(a", "access:x", "(access:x)", "*a", "a AND"):
        with pytest.raises(query.QueryError):
            query.parse(bad, fields)
    rows = {"owl": ({"owl", "night bird"}, {"barn owl"})}
    tree, same, below, many = query.expand(query.parse("owl", fields), rows)
    assert same == {"night bird"} and below == {"barn owl"} and not many
    assert query.expand(query.parse("owl", fields), rows, limit=1)[3]


def test_analyzers(spark):
    df = spark.createDataFrame([("Crème Brûlée-7", "salt,pepper; (sea) water")], "a string, b string")
    r = df.select(analysis.tokens(F.col("a")), analysis.tokens(F.col("b"), "attribute", stops=["and", "the", "of"])).first()
    assert r[0] == ["creme", "brulee-7"] and r[1] == ["salt", "pepper", "sea", "water"]
    assert analysis.normalise("H₂O–β [pure  Water]") == "h2o β pure water"


def test_tagging_prefers_the_longest(spark):
    tag = ontology.tagger({"owl": "owl", "barn owl": "barn owl", "night bird": "owl"})
    df = spark.createDataFrame([("Barn  Owl and night bird, owls",), (None,)], "t string")
    assert [r[0] for r in df.select(tag("t")).collect()] == [["barn owl", "owl"], []]


def test_pages_are_limited(spark):
    df = spark.range(45)
    pages = [[r.id for r in search.page_of(df, [F.col("id")], p, 20).rows.collect()] for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [20, 20, 5, 0] and sum(pages, []) == list(range(45))
    for page, size in ((1, 1001), (51, 1000)):
        with pytest.raises(ValueError):
            search.page_of(df, [F.col("id")], page, size)


def test_closure_plan_stays_flat_and_off_the_driver(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(20)]
    got = ontology.closure(spark.createDataFrame(chain + [("x", "y"), ("y", "x")], "child string, parent string"))
    assert {tuple(r) for r in got.collect()} == {(f"c{j}", f"c{i}") for i in range(21) for j in range(i + 1, 21)} | {("x", "y"), ("y", "x")} and got.count() == 212
    plan = got._jdf.queryExecution()
    assert plan.analyzed().collectLeaves().size() <= 6 and "Broadcast" not in plan.executedPlan().toString()


def test_index_rows_of_shared_terms(spark):
    onto = {"nodes": spark.createDataFrame([("root", "Root"), ("a", "One"), ("b", "one"), ("c", None), ("off", "Off")], "id string, term string"), "alt": spark.createDataFrame([("b", "uno"), ("a", "eins")], "id string, synonym string"), "edges": spark.createDataFrame([("a", "root"), ("b", "root"), ("c", "a")], "child string, parent string")}
    once = [("a", "One", True), ("a", "eins", False), ("root", "Root", True)]
    assert sorted(map(tuple, ontology.index_rows(onto, "root").collect())) == once
    assert set(map(tuple, ontology.index_rows(onto, "root", every=True).collect())) == {*once, ("b", "one", True), ("b", "uno", False), ("c", None, True)}


def _takes_apart(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all")


def test_ranking_takes_texts_apart_once(spark):
    rows = spark.createDataFrame([(1, "Étude du foie", "fr"), (2, "liver liver map", "en"), (3, "a foie gras", "en"), (4, None, "en"), (5, "", None), (6, "foie", None)], "id long, text string, lang string")
    words = analysis.tokens(F.col("text"))
    whole = search.bm25(rows, "id", words, ["foie", "liver"])
    assert _takes_apart(whole) == 0 and _takes_apart(search.index_statistics(rows, words)) == 1
    n, avg = search.index_statistics(rows, words).first()
    assert (n, avg) == (5, 9 / 5)
    known = search.bm25(rows, "id", words, ["foie", "liver"], (n, avg, {"foie": 3, "liver": 1}))
    assert _takes_apart(known) == 1
    scores = {r.doc: r.score for r in whole.collect()}
    assert set(scores) == {1, 2, 3, 6} and {r.doc: r.score for r in known.collect()} == pytest.approx(scores)
    assert {r.doc: r.score for r in search.bm25(rows, "id", words, ["foie", "liver"], among=F.col("lang") == "en").collect()} == pytest.approx({k: scores[k] for k in (2, 3)})


def test_fold_of_columns_and_of_queries_agree(spark):
    letters = [chr(c) for c in [*range(0x20, 0x370), *range(0x1E00, 0x1F00), 0x65E5, 0x1F600]]
    rows = spark.createDataFrame(list(enumerate([*letters, "", "Straße, cœur: e\u0301t\u0301", "plain text"])), "id long, c string")
    assert [r.f for r in rows.select("id", analysis.fold(F.col("c")).alias("f")).orderBy("id").collect()] == [analysis.folded(r.c) for r in rows.orderBy("id").collect()]
    assert rows.limit(1).select(analysis.fold(F.lit(None).cast("string")).alias("f")).first().f is None
