"""Multi-valued facet counting, drill-down lists, and path facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALUE_LIMIT = 10_000
NA = "n/a"


def labels(documents: DataFrame, doc: str, dims: dict[str, Column]) -> DataFrame:
    """(doc, dim, value) of array columns; equal values of a row count once."""
    each = F.array(*(F.struct(F.lit(n).alias("dim"), F.array_distinct(c).alias("values")) for n, c in dims.items()))
    one = documents.select(F.col(doc).alias("doc"), F.explode(each).alias("f"))
    return one.select("doc", "f.dim", F.explode("f.values").alias("value")).where("value is not null")


def counts(found: DataFrame) -> DataFrame:
    """(dim, value, hits) of (doc, dim, value): a row's label counts once, so partial sums suffice."""
    return found.groupBy("dim", "value").agg(F.count("*").alias("hits"))


def top(counted: DataFrame, limit: int = VALUE_LIMIT) -> DataFrame:
    """The most frequent values of each dimension, ties by value."""
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.col("hits").desc(), F.col("value")))
    return counted.withColumn("place", place).where(F.col("place") <= min(limit, VALUE_LIMIT)).drop("place")


def listed(counted: DataFrame, limit: int, selected: dict[str, list[str]] | None = None, hide_na: set[str] = frozenset(), years: set[str] = frozenset(), na: str = NA) -> DataFrame:
    """What a result page shows: the top values and the selected ones (0 where they don't occur), by name.

    Dimensions in ``hide_na`` lose the missing label; those in ``years`` go backward, without it.
    """
    kept = top(counted, limit)
    wanted = [(d, v) for d, vs in (selected or {}).items() for v in vs]
    if wanted:
        want = counted.sparkSession.createDataFrame(wanted, "dim string, value string")
        kept = kept.unionByName(F.broadcast(want).join(counted, ["dim", "value"], "left").select("dim", "value", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))).distinct()
    bare = [*hide_na, *years]
    if bare:
        kept = kept.where(~(F.col("dim").isin(bare) & (F.lower("value") == na.lower())))
    backward = [F.when(F.col("dim").isin(list(years)), -F.col("value").try_cast("int"))] if years else []
    return kept.orderBy("dim", *backward, "value")


def nested(rows: DataFrame, titles: dict[str, str] | None = None) -> DataFrame:
    """(name, title, children array<struct<name,value,hits>>)."""
    title = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in (titles or {"": ""}).items() for x in p)), F.col("dim")), F.col("dim"))
    return rows.groupBy(F.col("dim").alias("name"), title.alias("title")).agg(F.array_sort(F.collect_list(F.struct(F.col("value").alias("name"), F.col("value"), F.col("hits")))).alias("children"))


def prefixes(path: Column, separator: str = "/") -> Column:
    """Every prefix of a path: a, a/b, a/b/c."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))


def path_counts(documents: DataFrame, doc: str, path: Column) -> DataFrame:
    """(path, hits): distinct rows below each path."""
    return documents.select(F.col(doc).alias("doc"), F.explode(prefixes(path)).alias("path")).groupBy("path").agg(F.count_distinct("doc").alias("hits"))


def path_terms(counted: DataFrame, prefix: str, limit: int = VALUE_LIMIT) -> DataFrame:
    """(term, hits, has_children): last segments that start with a prefix; equal terms on different paths are added up."""
    last = F.element_at(F.split("path", "/"), -1)
    parents = counted.where(F.instr("path", "/") > 0).select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().withColumn("inner", F.lit(True))
    found = counted.join(parents, "path", "left").where(F.startswith(F.lower(last), F.lit(prefix.lower())))
    return found.groupBy(last.alias("term")).agg(F.sum("hits").cast("long").alias("hits"), F.coalesce(F.bool_or("inner"), F.lit(False)).alias("has_children")).orderBy("term").limit(limit)


def path_children(counted: DataFrame, term: str) -> DataFrame:
    """(child, hits): segments right below every path that ends with the term; the largest count of each."""
    parts = F.split("path", "/")
    below = counted.select(parts.alias("p"), "hits").where(F.size("p") > 1).where(F.lower(F.get("p", F.size("p") - 2)) == term.lower())
    return below.groupBy(F.element_at("p", -1).alias("child")).agg(F.max("hits").alias("hits"))
