"""From raw nested records to typed rows: property parsers, files, enrichment.

Input: (acc_no, raw) with raw the JSON text.  Each row's JSON is read once, by one Arrow UDF for all
paths; everything after is built-in functions on its arrays.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import jsonpath


def joined(v: Column, p) -> Column:
    """Facets are joined by ``|``, longs added up, the rest joined by spaces."""
    if p.type == "long":
        return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.try_cast("long"), F.lit(0)))).cast("string")
    text = F.array_join(v, "|" if p.type == "facet" else " ")
    return F.lower(text) if p.lower else text


def simple(v: Column, p) -> Column:
    """Attributes by title: an optional pattern's group, and for longs the value, or the count of several."""
    if p.match:
        v = F.filter(F.transform(v, lambda x: F.regexp_extract(x, p.match, 1)), lambda x: x != "")
    if p.type == "long":
        return F.when(F.size(v) == 0, "").when(F.size(v) == 1, F.coalesce(F.get(v, 0).try_cast("long").cast("string"), F.lit(""))).otherwise(F.size(v).cast("string"))
    text = F.array_join(v, "|" if p.type == "facet" else " ")
    return F.lower(text) if p.lower else text


def access(v: Column, released: Column) -> Column:
    open_ = F.when(released & ~F.exists(v, lambda x: F.lower(x) == "public"), F.array(F.lit("public"))).otherwise(F.array().cast("array<string>"))
    return F.lower(F.array_join(F.concat(v, open_), " "))


def content(acc: Column, texts: Column, paths: Column, urls: Column) -> Column:
    short = F.when(acc.startswith("S-EPMC"), F.array(F.substring(acc, 4, 1000))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.array(acc), short, *(F.coalesce(c, F.array().cast("array<string>")) for c in (texts, paths, urls)))
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x != ""))), " ")


def kind(v: Column) -> Column:
    one = F.lower(F.get(v, 0))
    return F.when(F.size(v) == 1, F.when(one == "project", "collection").otherwise(one)).otherwise("")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"^.+\.([^.]+)$", 1)


def extensions(paths: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(paths, extension), lambda x: x != ""))), "|")


def millis(text: Column) -> Column:
    """Epoch milliseconds of an ISO time or a number as text; null for what is neither."""
    return F.coalesce(text.try_cast("long"), F.unix_millis(F.try_to_timestamp(text)))


def release_time(release: Column, modified: Column, released: Column) -> Column:
    return F.coalesce(F.when(release > 0, release), F.when(released & (modified > 0), modified))


def day(ms: Column, default: str | None = "n/a") -> Column:
    text = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")
    return F.coalesce(text, F.lit(default)) if default else text


def year(ms: Column, default: str | None = None) -> Column:
    text = F.date_format(F.timestamp_millis(ms), "yyyy")
    return F.coalesce(text, F.lit(default)) if default else text


def flag(text: Column) -> Column:
    """Boolean facets: true where there is something, else nothing."""
    return F.when(F.length(F.trim(text)) > 0, True)


def collections(text: Column) -> Column:
    """Lower case, split, trimmed, without blanks and public, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(text), r"\|"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "public")))


#: name -> (property, values, row) -> Column; ``row`` has acc_no, released and the times as columns.
PARSERS: dict[str, Callable] = {
    "JPathListParser": lambda p, v, r: joined(v, p),
    "SimpleAttributeParser": lambda p, v, r: simple(v, p),
    "NodeCountingParser": lambda p, v, r: F.size(v).cast("string"),
    "AccessParser": lambda p, v, r: access(v, r["released"]),
    "ContentParser": lambda p, v, r: content(r["acc_no"], r["texts"], r["paths"], r["urls"]),
    "TypeParser": lambda p, v, r: kind(r["types"]),
    "FileTypeParser": lambda p, v, r: extensions(r["paths"]),
    "CreationTimeParser": lambda p, v, r: F.coalesce(r["ctime"], F.lit(-1)).cast("string"),
    "ModificationTimeParser": lambda p, v, r: r["mtime"].cast("string"),
    "ModificationYearParser": lambda p, v, r: year(r["mtime"]),
    "ReleaseTimeParser": lambda p, v, r: r["rtime"].cast("string"),
    "ReleaseDateParser": lambda p, v, r: day(r["rtime"]),
    "ReleaseYearParser": lambda p, v, r: year(r["rtime"], "n/a"),
    "ViewCountParser": lambda p, v, r: F.coalesce(r["views"], F.lit(0)).cast("string"),
    "EUToxRiskDataTypeParser": lambda p, v, r: F.when(F.size(r["qmrf"]) > 0, "in silico").otherwise("in vitro"),
    "NullParser": lambda p, v, r: F.lit(None).cast("string"),
    "TitleParser": lambda p, v, r: joined(v, p),
}
_ROW = {
    "_acc": ["$.accNo", "$.accno"],
    "_released": ["$.released"],
    "_types": ["$.section.type"],
    "_texts": ["$.section..value"],
    "_paths": ["$..files..filePath", "$..files..path", "$..files..relPath"],
    "_urls": ["$..links..url"],
    "_qmrf": ["$..attributes[?(@.name=='QMRF-ID')]"],
    "_collections": ["$.collections[*].accNo"],
}


def _paths(p) -> list[str]:
    if p.paths or p.parser != "SimpleAttributeParser":
        return list(p.paths)
    title = p.title.replace("\\", "\\\\").replace("/", "\\/")
    return [f"$.section.attributes[?(@.name=~ /{title}/i)].value"]


def _time(raw: Column, name: str) -> Column:
    """A time field: text, number, or an object with $date (text, number, or $numberLong)."""
    at = lambda path: F.get_json_object(raw, path)
    date = at(f"$.{name}['$date']")
    return millis(F.coalesce(F.get_json_object(date, "$['$numberLong']"), date, at(f"$.{name}")))


def value_maps(records: DataFrame, registry, views: DataFrame | None = None) -> DataFrame:
    """(acc_no, vals map<property, string>): public properties, then those of the row's collections.

    Rows of type ``collection`` have the public ones alone.  ``views(accession, views)`` is joined
    on the accession.
    """
    every = registry.properties(list(registry.collections))
    wanted = {n: _paths(p) for n, p in every.items()} | _ROW
    row = records.select("acc_no", "raw").withColumn("v", jsonpath.extract(F.col("raw"), wanted))
    at = lambda n: F.coalesce(F.element_at(F.col("v"), n), F.array().cast("array<string>"))
    released = F.lower(F.get(at("_released"), 0)).eqNullSafe("true")
    row = row.withColumn("released", released).withColumn("acc_no", F.coalesce(F.get(at("_acc"), 0), F.col("acc_no"), F.lit("")))
    row = row.withColumn("ctime", _time(F.col("raw"), "creationTime")).withColumn("mtime", _time(F.col("raw"), "modificationTime")).withColumn("_rt", _time(F.col("raw"), "releaseTime"))
    row = row.withColumn("rtime", release_time(F.col("_rt"), F.col("mtime"), F.col("released")))
    if views is not None:
        row = row.join(views.select(F.col("accession").alias("acc_no"), "views"), "acc_no", "left")
    else:
        row = row.withColumn("views", F.lit(0).cast("long"))
    r = {n: F.col(n) for n in ("acc_no", "released", "ctime", "mtime", "rtime", "views")} | {n[1:]: at(n) for n in ("_types", "_texts", "_paths", "_urls", "_qmrf")}
    kinds = F.transform(at("_collections"), F.lower)
    pairs = []
    for collection, own in registry.collections.items():
        for p in own.values():
            value = PARSERS[p.parser](p, at(p.name), r)
            if p.facet_type == "boolean":
                value = F.when(flag(value), "true").otherwise("false")
            here = F.lit(True) if collection.lower() == "public" else F.array_contains(kinds, collection.lower()) & (kind(r["types"]) != "collection")
            pairs.append(F.when(here, F.struct(F.lit(p.name).alias("key"), value.alias("value"))))
    return row.select("acc_no", F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("vals"))


def documents(values: DataFrame, registry) -> DataFrame:
    """Typed columns for every property: arrays of labels for facets, longs, strings; missing facets get their default or n/a."""
    columns = []
    for p in registry.properties(list(registry.collections)).values():
        v = F.element_at("vals", p.name)
        if p.type == "long":
            v = v.try_cast("long")
        elif p.type == "facet":
            labels = F.filter(F.transform(F.split(v, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
            labels = F.transform(labels, F.lower) if p.lower else labels
            missing = F.lit(None).cast("array<string>") if p.facet_type == "boolean" or p.name in ("facet.file_type", "facet.link_type") else F.array(F.lit(p.default or "n/a"))
            v = F.when(v.isNotNull() & (F.size(labels) > 0), F.filter(labels, lambda x: (x != "false")) if p.facet_type == "boolean" else labels).otherwise(missing)
        columns.append(v.alias(p.name.replace(".", "_")))
    return values.select("acc_no", *columns)


FILE = T.ArrayType(T.StructType([T.StructField("section", T.StringType()), T.StructField("file", T.StringType())]))


@F.udf(FILE, useArrow=True)
def found_files(raw):
    """(section, file JSON) of all direct files, nested arrays and tables one level deep; docs that list files elsewhere are skipped."""
    try:
        root = json.loads(raw) if raw else None
    except ValueError:
        return []
    out = []

    def visit(node):
        if isinstance(node, dict):
            if node.get("files") and not str(node.get("_class", "")).endswith("DocFileList") and isinstance(node["files"], list):
                name = "" if str(node.get("type", "")).lower() == "study" else str(node.get("accNo") or "").replace("/", "").replace(" ", "")
                for f in node["files"]:
                    for x in f if isinstance(f, list) else f["files"] if isinstance(f, dict) and isinstance(f.get("files"), list) else [f]:
                        if isinstance(x, dict):
                            out.append((name, json.dumps(x)))
            for k, x in node.items():
                if k != "files":
                    visit(x)
        elif isinstance(node, list):
            for x in node:
                visit(x)

    visit(root)
    return out


def files(records: DataFrame) -> DataFrame:
    """One row a file: owner, position from 1, path, name, type, size, directory flag, section, attributes."""
    each = records.select(F.col("acc_no").alias("owner"), F.posexplode(found_files("raw")).alias("at", "f"))
    g = lambda k: F.get_json_object("f.file", f"$.{k}")
    path = F.coalesce(g("filePath"), g("path"), g("relPath"))
    attrs = F.from_json(g("attributes"), "array<struct<name:string,value:string>>")
    fixed = ["file_position", "file_size", "file_path", "file_name", "file_type", "isdirectory", "file_owner", "file_section"]
    kept = F.filter(attrs, lambda a: a["name"].isNotNull() & (F.coalesce(a["value"], F.lit("")) != "") & ~F.lower(a["name"]).isin(fixed) & ~(F.lower(F.col("owner")).contains("epmc") & (F.lower(a["name"]) == "type")))
    names = F.transform(kept, lambda a: a["name"])
    first = F.filter(kept, lambda a, i: F.array_position(names, a["name"]) == i + 1)
    return each.select(
        "owner",
        (F.col("at") + 1).cast("long").alias("file_position"),
        path.alias("file_path"),
        F.coalesce(g("fileName"), F.element_at(F.split(path, "/"), -1)).alias("file_name"),
        F.coalesce(g("type"), F.lit("file")).alias("file_type"),
        F.coalesce(g("size").try_cast("long"), F.lit(0)).alias("file_size"),
        (F.lower(F.coalesce(g("type"), F.lit("file"))) == "directory").alias("is_directory"),
        F.col("f.section").alias("file_section"),
        F.coalesce(F.map_from_entries(first), F.create_map().cast("map<string,string>")).alias("attrs"),
    )


def file_summary(rows: DataFrame) -> DataFrame:
    """owner, files, sections with files and column names; merged before they are exchanged."""
    names = rows.groupBy("owner").agg(F.count("*").alias("files"), F.collect_set(F.when(F.col("file_section") != "", F.col("file_section"))).alias("s"), F.array_distinct(F.flatten(F.collect_set(F.map_keys("attrs")))).alias("n"))
    return names.select("owner", "files", F.array_join(F.array_sort("s"), " ").alias("sections_with_files"), F.concat(F.when(F.size("s") > 0, "Name|Size|Section|").otherwise("Name|Size|"), F.array_join(F.transform(F.array_sort("n"), lambda x: F.concat(x, F.lit("|"))), "")).alias("file_attribute_names"))
