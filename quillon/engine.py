"""The engine: a store of submissions and files, and the calls that a search service makes of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import analysis
from quillon.operators import facets, ingest, ontology, query, search
from quillon.operators.store import Store, deleted, upserted
from quillon.sources.registry import Property, Registry


class NotAccessible(PermissionError):
    """The row exists, but not for this caller."""


@dataclass
class Response:
    page: search.Page
    query: str
    sort: str
    order: str
    selected: dict = field(default_factory=dict)
    facets: DataFrame | None = None
    synonyms: set = field(default_factory=set)
    descendants: set = field(default_factory=set)
    too_many: bool = False
    suggestions: list[str] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, store: Store, registry: Registry, onto: dict[str, DataFrame] | None = None, children: dict[str, list[str]] | None = None, excluded=search.EXCLUDED_TYPES):
        self.spark, self.store, self.registry, self.onto, self.children, self.excluded = spark, store, registry, onto, children or {}, excluded
        every = registry.properties(list(registry.collections)).values()
        self.fields = query.Fields({p.name: p.analyzer if p.type == "tokenized_string" else "keyword" for p in every}, {p.name for p in every if p.type == "long"}, tuple(n for n in ("accession", "content", "title") if registry.find(n)))
        self.dims = {p.name.replace(".", "_"): p for p in every if p.type == "facet"}
        if onto:
            self.dims |= {n: Property(n, "facet") for n in ("efo_id", "efo_term")}

    # tables

    def index(self, records: DataFrame, views: DataFrame | None = None) -> dict:
        """Upserts (acc_no, raw) records with their files, in one commit."""
        rows = ingest.documents(ingest.value_maps(records, self.registry, views), self.registry)
        files = ingest.files(records)
        summary = ingest.file_summary(files).withColumnRenamed("owner", "acc_no")
        text = files.groupBy("owner").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", F.map_keys("attrs"), F.map_values("attrs")))), " ").alias("_t")).withColumnRenamed("owner", "acc_no")
        rows = rows.drop("files", "sections_with_files", "file_attribute_names").join(summary, "acc_no", "left").join(text, "acc_no", "left")
        if "content" in rows.columns:
            rows = rows.withColumn("content", F.concat_ws(" ", "content", "_t"))
        rows = rows.drop("_t").withColumn("files", F.coalesce("files", F.lit(0)))
        if tags := self._tags(rows):
            rows = rows.withColumns(tags)
        old, old_files = self.store.read("submissions"), self.store.read("files")
        self.store.commit({"submissions": rows if old is None else upserted(old, rows, ["acc_no"]), "files": files if old_files is None else deleted(old_files, rows.select(F.col("acc_no").alias("owner")), ["owner"]).unionByName(files)})
        return self._count_terms()

    def _tags(self, rows: DataFrame) -> dict:
        """The ontology's terms in the content, as two facets: ids, and the terms of these ids; each once, in the order of tagging.

        The ontology comes to the driver, as the tagger is sent to all tasks; terms without an id are skipped.
        """
        if not self.onto or "content" not in rows.columns:
            return {}
        own = {r.id: r.term for r in self.onto["nodes"].select("id", "term").collect() if r.id and r.term}
        terms = {r.synonym: f"{r.id}\t{own[r.id]}" for r in self.onto["alt"].collect() if r.id in own and r.synonym} | {t: f"{i}\t{t}" for i, t in own.items()}
        found = ontology.tagger(terms)(F.col("content"))
        part = lambda k: F.array_distinct(F.transform(found, lambda x: F.split_part(x, F.lit("\t"), F.lit(k))))
        return {"efo_id": part(1), "efo_term": part(2)}

    def _count_terms(self) -> dict:
        """Keeps the dictionary and the lengths of the whole index; a commit of its own, so they may lag by one."""
        rows = self.store.read("submissions")
        if "content" not in rows.columns:
            return self.store.state()
        words = analysis.tokens(F.col("content"))
        return self.store.commit({"terms": term_statistics(rows, words), "lengths": search.index_statistics(rows, words)})

    def _known(self, terms: list[str]) -> tuple[int, float, dict[str, int]] | None:
        """n, mean length and rows by term; of the terms alone, so few rows come to the driver."""
        counted, lengths = self.store.read("terms"), self.store.read("lengths")
        if counted is None or lengths is None:
            return None
        n, avg = lengths.first()
        return n, avg or 0.0, {r.term: r.df for r in counted.where(F.col("term").isin(terms)).select("term", "df").collect()}

    def delete(self, accessions: list[str]) -> dict:
        gone = self.spark.createDataFrame([(a, a) for a in accessions], "acc_no string, owner string")
        self.store.delete(gone, {"submissions": ["acc_no"], "files": ["owner"]})
        return self._count_terms()

    def stats(self) -> list[dict]:
        return self.store.statistics()

    # search

    def _visible(self, who: search.Principal, key: str | None = None) -> DataFrame:
        rows = self.store.read("submissions")
        if "access" in rows.columns:
            rows = rows.withColumn("_acl", F.split("access", " ")).where(search.visible(who, "_acl", "seckey" if "seckey" in rows.columns else None, key)).drop("_acl")
        return rows

    def matching(self, text: str | None = None, filters: dict | None = None, collection: str | None = None, who=None, key=None, drill: dict | None = None) -> tuple[DataFrame, tuple]:
        """The filtered frame that the page, the count and the facets share, and what the query became."""
        tree = query.parse(text, self.fields)
        expanded = (tree, set(), set(), False)
        if self.onto:
            asked = {t.lower() for t in query.terms_of(tree)}
            rows = ontology.expansion_rows(self.onto).where(F.arrays_overlap("keys", F.array(*(F.lit(t) for t in asked)))).limit(ontology.EXPANSION_ROWS).collect() if asked else []
            expanded = query.expand(tree, {k: (set(r.synonyms), set(r.descendants)) for r in rows for k in r.keys})
        rows = self._visible(who or search.Principal(), key).where(query.predicate(expanded[0], self.fields))
        for name, value in (filters or {}).items():
            if value and name != "query":
                rows = rows.where(query.predicate(query.parse(f'{name}:"{value}"' if " " in str(value) else f"{name}:{value}", self.fields), self.fields))
        if "type" in rows.columns:
            rows = rows.where(search.of_types(text, filters, "type", self.excluded))
        if "facet_collection" in rows.columns and collection:
            names = [collection.lower(), *(c.lower() for c in {k.lower(): v for k, v in self.children.items()}.get(collection.lower(), []))]
            rows = rows if collection.lower() == "public" else rows.where(F.arrays_overlap(F.transform("facet_collection", F.lower), F.array(*(F.lit(n) for n in names))))
        rows = rows.where(search.drilled({d.replace(".", "_"): v for d, v in (drill or {}).items()}, {d: p.lower for d, p in self.dims.items()}))
        return rows, expanded

    def search(self, text=None, page=None, size=None, sort=None, order=None, filters=None, collection=None, who=None, key=None, drill=None, facet_limit: int = 20) -> Response:
        who = who or search.Principal()
        rows, (tree, synonyms, below, many) = self.matching(text, filters, collection, who, key, drill)
        sort, order = search.defaults(text, sort, order)
        terms = [w for t in query.terms_of(tree) for w in query.analyzed(t, "experiment")]
        scored = bool(terms) and "content" in rows.columns
        if scored:
            rank = search.bm25(rows, "acc_no", analysis.tokens(F.col("content")), terms, self._known(terms)).withColumnRenamed("doc", "acc_no")
            rows = rows.join(rank, "acc_no", "left").fillna(0.0, ["score"])
        elif sort.lower() == "relevance":
            sort = "rtime" if "rtime" in rows.columns else "acc_no"
        name = search.ALIASES.get(sort.lower(), sort)
        if sort.lower() != "relevance" and name not in rows.columns:
            sort = "acc_no"
        found = search.page_of(rows, search.ordering(sort, order, scored, "acc_no"), page, size)
        if scored:
            found = found.map(lambda d: d.withColumn("content", search.snippet(F.col("content"), terms)))
        return Response(found, text or "", sort, order, drill or {}, self.facets(rows, who, facet_limit, drill), synonyms, below, many, self.suggest(text) if found.total <= 5 and (text or "").strip() else [])

    def facets(self, rows: DataFrame | None = None, who=None, limit: int = 10, drill: dict | None = None) -> DataFrame:
        who = who or search.Principal()
        rows = self._visible(who) if rows is None else rows
        shown = {d: F.col(d) for d, p in self.dims.items() if d in rows.columns and not (p.private and who.anonymous)}
        return facets.listed(facets.counts(facets.labels(rows, "acc_no", shown)), limit, {d.replace(".", "_"): v for d, v in (drill or {}).items()}, {d for d in shown if not self.dims[d].na_visible}, {d for d in shown if d.endswith("_year")})

    def facet_dimension(self, name: str, who=None) -> DataFrame | None:
        p = self.dims.get(name.replace(".", "_"))
        if not p or (p.private and (who or search.Principal()).anonymous):
            return None
        return facets.top(facets.counts(facets.labels(self._visible(who or search.Principal()), "acc_no", {p.name: F.col(name.replace(".", "_"))})))

    def search_files(self, accession: str, text: str | None = None, columns: dict | None = None, start: int = 0, size: int = 20, sort: str = "file_position", descending: bool = False) -> search.Page:
        rows = files_matching(self.store.read("files").where(F.col("owner") == accession), text, columns)
        key = F.col({"size": "file_size", "name": "file_name", "path": "file_path", "x": "file_position"}.get(sort, sort))
        ordered = rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "file_position")
        return search.Page(ordered if size < 0 else ordered.offset(start // max(1, size) * max(1, size)).limit(size), rows.count(), start // max(1, size) + 1, size)

    def get_submission(self, accession: str, key: str | None = None, kind: str | None = None, who=None):
        """The row; None where there is none; NotAccessible where it is hidden."""
        own = self._visible(who or search.Principal(), key).where(F.col("acc_no") == accession)
        if kind:
            own = own.where(F.lower("type") == kind.lower())
        row = own.first()
        if row is None and self.store.read("submissions").where(F.col("acc_no") == accession).limit(1).count():
            raise NotAccessible(accession)
        return row

    def dictionary(self, column: str = "content") -> DataFrame:
        """(term, df)."""
        if column == "content" and (kept := self.store.read("terms")) is not None:
            return kept.select("term", "df")
        return term_statistics(self.store.read("submissions"), analysis.tokens(F.col(column))).select("term", "df")

    def suggest(self, text: str | None, limit: int = 5) -> list[str]:
        word = (text or "").strip()
        if not word:
            return []
        if ontology.accession_shaped(word):
            names = self.store.read("submissions").groupBy(F.lower("acc_no").alias("term")).agg(F.count("*").alias("df"))
            if got := [r.term for r in ontology.suggestions(names, word, limit).collect()]:
                return got
        if self.onto:
            own = self.onto["nodes"].groupBy(F.lower("term").alias("term")).agg(F.count("*").alias("df"))
            if got := [r.term for r in ontology.suggestions(own, word, limit).collect()]:
                return got
        return [r.term for r in ontology.suggestions(self.dictionary(), word, limit).collect()]

    def autocomplete(self, text: str, limit: int = 20) -> list[str]:
        alt = self.onto["alt"].select(F.col("synonym").alias("term"))
        return [r.line for r in ontology.autocomplete(self.onto["nodes"], alt, text, limit).orderBy("kind", "line").collect()]

    def tree(self, node: str, limit: int = 0) -> DataFrame:
        return ontology.children(self.onto, node, None, limit)

    def hits(self, who=None) -> DataFrame:
        """(id, hits): the visible rows that are tagged with each node or one below it."""
        tagged = self._visible(who or search.Principal()).select(F.col("acc_no").alias("doc"), F.explode("efo_id").alias("id"))
        return ontology.counts_with_descendants(tagged, ontology.closure(self.onto["edges"], self.onto["nodes"]))

    def keywords_with_counts(self, text: str, limit: int = 20, who=None) -> list[str]:
        return [r.line for r in ontology.autocomplete_counts(self.onto, text, self.hits(who), limit).collect()]

    def tree_with_counts(self, node: str, limit: int = 0, who=None) -> DataFrame:
        return ontology.children(self.onto, node, self.hits(who), limit)


def files_matching(rows: DataFrame, text: str | None = None, columns: dict | None = None) -> DataFrame:
    """Files whose name or any attribute contains the text (a quoted text: the name has it as a phrase), and whose columns have the values."""
    t = (text or "").strip()
    if '"' in t.replace('\\"', ""):
        phrase = t.replace('"', "").lower()
        rows = rows.where(F.lower("file_name").contains(phrase))
    elif t.strip("*"):
        rows = rows.where(F.lower("file_name").contains(t.strip("*").lower()) | F.exists(F.map_values("attrs"), lambda v: F.lower(v).contains(t.strip("*").lower())))
    for name, value in (columns or {}).items():
        own = F.col(name) if name in rows.columns else F.element_at("attrs", name)
        rows = rows.where(own == value)
    return rows


def term_statistics(documents: DataFrame, tokens) -> DataFrame:
    """(term, df, cf): a row sends its tokens and, beside them, its different tokens; sums are merged before the one exchange by term."""
    one = lambda df, cf: lambda x: F.struct(x.alias("term"), F.lit(df).cast("long").alias("df"), F.lit(cf).cast("long").alias("cf"))
    each = documents.select(F.explode(F.array(tokens)).alias("t")).select(F.explode(F.concat(F.transform(F.array_distinct("t"), one(1, 0)), F.transform("t", one(0, 1)))).alias("x"))
    return each.groupBy("x.term").agg(F.sum("x.df").alias("df"), F.sum("x.cf").alias("cf"))
