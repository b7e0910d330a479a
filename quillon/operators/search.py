"""Filters, ranking, ordering and pages over one filtered frame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.store import written

PAGE_LIMIT, TOP_LIMIT, DEPTH_LIMIT, PAGE_SIZE = 1000, 10_000, 50_000, 20
EXCLUDED_TYPES = ("collection", "compound", "array", "file")
K1, B = 1.2, 0.75
ALIASES = {"releasedate": "rtime", "release_date": "rtime", "modificationdate": "mtime"}


@dataclass(frozen=True)
class Principal:
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    superuser: bool = False
    anonymous: bool = True


@dataclass
class Page:
    rows: DataFrame
    total: int
    page: int | None = None
    size: int | None = None
    exact: bool = True
    cursor: dict = field(default_factory=dict)

    def map(self, f) -> Page:
        return Page(f(self.rows), self.total, self.page, self.size, self.exact, self.cursor)


def visible(who: Principal, acl: str = "access", key_column: str | None = None, key: str | None = None) -> Column:
    """Row-level access on an array column of tags; a secret key opens its own row."""
    if who.superuser:
        return F.lit(True)
    tags = F.col(acl)
    allow = F.coalesce(F.arrays_overlap(tags, F.array(*(F.lit(a) for a in who.allow or ("public",)))), F.lit(False))
    if key and key_column:
        allow = allow | F.col(key_column).eqNullSafe(key)
    if who.deny:
        allow = allow & ~F.coalesce(F.arrays_overlap(tags, F.array(*(F.lit(d) for d in who.deny))), F.lit(False))
    return allow


def of_types(query: str | None, fields: dict | None, column: str = "type", excluded=EXCLUDED_TYPES) -> Column:
    """Hides the excluded types unless the query or a filter asks for types."""
    if not excluded or "type:" in (query or "") or "type" in (fields or {}):
        return F.lit(True)
    return F.coalesce(~F.lower(F.col(column)).isin(list(excluded)), F.lit(True))


def in_collection(name: str | None, children: dict[str, list[str]], column: str = "collection") -> Column:
    """The collection and its sub-collections, in any case."""
    if not name or name.lower() == "public":
        return F.lit(True)
    below = {k.lower(): v for k, v in children.items()}.get(name.lower(), [])
    return F.coalesce(F.lower(F.col(column)).isin([name.lower(), *(c.lower() for c in below)]), F.lit(False))


def drilled(selected: dict[str, list[str]], known: dict[str, bool]) -> Column:
    """OR among the values of a dimension, AND among dimensions; ``known`` dimension -> lower-cased.  Unknown dimensions are ignored."""
    out = F.lit(True)
    for dim, values in selected.items():
        if dim in known and values:
            want = [v.lower() if known[dim] else v for v in values]
            out = out & F.coalesce(F.arrays_overlap(F.col(f"`{dim}`"), F.array(*(F.lit(v) for v in want))), F.lit(False))
    return out


def index_statistics(documents: DataFrame, tokens: Column) -> DataFrame:
    """One row: n, the rows that have tokens, and avg, their mean number."""
    long = F.when(F.col("len") >= 0, F.col("len"))  # a where would go below and take the texts apart once more
    return documents.select(F.size(tokens).cast("double").alias("len")).agg(F.count(long).alias("n"), F.avg(long).alias("avg"))


def bm25(documents: DataFrame, doc: str, tokens: Column, terms: list[str], known: tuple[int, float, dict[str, int]] | None = None, among: Column | None = None) -> DataFrame:
    """(doc, score) of rows with any of the terms; of those that ``among`` holds for, if given.

    ``known``: rows, mean length and rows by term of the whole index, as a commit keeps them; then ``documents``
    may be any part of it.  Without it, the statistics are those of ``documents``, ``among`` or not: a row's length and
    term frequencies are written, small beside its text, and read for one row of sums that is broadcast, and for the scores.
    Either way the texts are read and taken apart once; the one-element explode keeps filters from repeating it.
    """
    terms = list(dict.fromkeys(terms))
    base = documents.select(F.col(doc).alias("doc"), (F.lit(True) if among is None else among).alias("among"), F.explode(F.array(tokens)).alias("t")).where("t is not null")
    tf = lambda i: F.size(F.filter("t", lambda x: x == terms[i])).cast("double").alias(f"tf{i}")
    base = base.select("doc", "among", F.size("t").cast("double").alias("len"), *(tf(i) for i in range(len(terms))))
    hit = F.col("among") & (F.greatest(*(F.col(f"tf{i}") for i in range(len(terms))), F.lit(0.0)) > 0)
    if known is None:
        base = written(base, "bm25")
        stats = base.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.sum(F.when(F.col(f"tf{i}") > 0, 1.0).otherwise(0.0)).alias(f"df{i}") for i in range(len(terms))))
        both = base.where(hit).join(F.broadcast(stats))  # one row
    else:
        n, avg, df = known
        both = base.where(hit).select("*", F.lit(float(n)).alias("n"), F.lit(float(avg or 1.0)).alias("avg"), *(F.lit(float(df.get(t, 0))).alias(f"df{i}") for i, t in enumerate(terms)))
    part = lambda i: F.when(F.col(f"tf{i}") > 0, F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg")))).otherwise(0.0)
    score = part(0)
    for i in range(1, len(terms)):
        score = score + part(i)
    return both.select("doc", score.alias("score"))


def ordering(sort: str | None, order: str | None, scored: bool, unique: str) -> list[Column]:
    """Sort keys: the field, time of change, score, and a unique last key.  Only ``descending`` (any case) reverses."""
    down = (order or "descending").lower() == "descending"
    name = (sort or "relevance").lower()
    keys = []
    if name != "relevance":
        c = F.col(f"`{ALIASES.get(name, name)}`")
        keys.append(c.desc_nulls_last() if down else c.asc_nulls_last())
        if name in ("release_date", "releasedate"):
            keys.append(F.col("mtime").desc_nulls_last())
    elif not scored:
        return [F.col(unique).asc()]
    if scored:
        keys.append(F.col("score").desc() if down or name != "relevance" else F.col("score").asc())
    return [*keys, F.col(unique).asc()]


def defaults(query: str | None, sort: str | None, order: str | None) -> tuple[str, str]:
    if not sort:
        sort = "relevance" if (query or "").strip() else "release_date"
    return sort, order or "descending"


def page_of(df: DataFrame, keys: list[Column], page: int | None = None, size: int | None = None) -> Page:
    """Offset pages: 1 and 20 where missing or not positive; sizes and depth are limited; a page past the end is empty."""
    page = page if page and page > 0 else 1
    size = size if size and size > 0 else PAGE_SIZE
    if size > PAGE_LIMIT:
        raise ValueError(f"a page has {PAGE_LIMIT} rows at most")
    if page * size > DEPTH_LIMIT:
        raise ValueError(f"pages reach {DEPTH_LIMIT} rows deep; go on with search_after")
    return Page(df.orderBy(*keys).offset((page - 1) * size).limit(size), df.count(), page, size)


def search_after(df: DataFrame, by: list[tuple[str, bool]], cursor: list, limit: int) -> DataFrame:
    """Keyset pages: rows after the cursor's values in (column, descending) order; the last column must be unique."""
    if not by or not 0 < limit <= PAGE_LIMIT:
        raise ValueError(f"search_after needs sort keys and 1 to {PAGE_LIMIT} rows")
    after, equal = F.lit(False), F.lit(True)
    for (name, down), value in zip(by, cursor, strict=True):
        c = F.col(name)
        # nulls come last in either order
        later = F.lit(False) if value is None else (c < value if down else c > value) | c.isNull()
        after = after | (equal & later)
        equal = equal & c.eqNullSafe(F.lit(value))
    keys = [F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_last() for n, d in by]
    rows = df.where(after) if cursor and any(v is not None for v in cursor) else df
    return rows.orderBy(*keys).limit(limit)


def top(df: DataFrame, keys: list[Column], limit: int) -> DataFrame:
    if limit <= 0:
        raise ValueError("a limit is positive")
    return df.orderBy(*keys).limit(min(limit, TOP_LIMIT))


def snippet(text: Column, terms: list[str], size: int = 300) -> Column:
    """About ``size`` characters around the first of the terms; the whole text where none occurs."""
    places = [F.locate(t.lower(), F.lower(text)) for t in terms]
    first = F.array_min(F.filter(F.array(*places), lambda p: p > 0))
    return F.coalesce(F.substring(text, F.greatest(F.lit(1), first - size // 2), F.lit(size)), text)
