"""Licence scans by a positional index of rare words, in DataFrame functions alone.

The index holds, of every licence text (template), the RARE words with the highest inverse document
frequency over all templates, with their positions.  For each text the rare words it has are looked up;
a posting (template, p) found at word i votes for the template at offset i - p.  At each offset voted
for, the template's other rare words are intersected by relative position, and where at least half of
them stand in place, its mandatory key phrases are verified word by word.  All of it happens inside the
row: no shuffle, and the broadcast is the fixed template table in the plan.

The index and the work don't depend on the corpus; a text costs one pass over its words, plus a constant
for each rare word in it.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import ascii_lower, read

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 4
#: Label, words of the text, mandatory key phrases (words of the text).  The first four are the base.
TEMPLATES = [
    ("gpl", "gnu general public license", ["gnu general public license"]),
    ("apache", "apache license", ["apache license"]),
    ("cc-by", "cc by", ["cc by"]),
    ("mit", "mit license", ["mit license"]),
    ("gpl-grant", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "gnu affero general public license", ["gnu affero general public license"]),
    ("apache-grant", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["except in compliance with the license"]),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
    ("cc-by-nc", "cc by nc", ["cc by nc"]),
    ("cc-by-nd", "cc by nd", ["cc by nd"]),
    ("cc-by-sa", "cc by sa", ["cc by sa"]),
    ("cc0", "cc0 1 0 universal", ["cc0 1 0 universal"]),
    ("spdx", "spdx license identifier", ["spdx license identifier"]),
]
BASE = 4


def _place(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def index() -> list[dict]:
    """Of each template: label, rare [(position, word, idf)] and keys [(position, word)]."""
    texts = [t.split() for _, t, _ in TEMPLATES]
    frequency = Counter(w for t in texts for w in set(t))
    out = []
    for (label, _, keys), words in zip(TEMPLATES, texts, strict=True):
        idf = {w: math.log(1 + len(texts) / frequency[w]) for w in words}
        first = sorted({w: i for i, w in reversed(list(enumerate(words)))}.items(), key=lambda x: (-idf[x[0]], x[1]))[:RARE]
        key = sorted({(i, w) for k in keys for i, w in enumerate(k.split(), _place(words, k.split()))})
        out.append({"label": label, "rare": sorted((i, w, round(idf[w], 6)) for w, i in first), "keys": key})
    return out


def _list(values: list) -> Column:
    return F.array(*values)


def scan(documents: DataFrame) -> DataFrame:
    """documents with ``n_words`` and ``licenses``: structs (template, label, word, share).

    ``word`` is where the template begins (words from 0), ``share`` the idf-weighted part of its
    rare words that stand in place.  Null and empty texts have no words and no licences.
    Other columns pass; columns with these two names are replaced.
    """
    found = index()
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, x in enumerate(found):
        for i, w, _ in x["rare"]:
            postings.setdefault(w, []).append((t, i))
    by_word = F.create_map(*(x for w, p in postings.items() for x in (F.lit(w), _list([F.struct(F.lit(t).alias("t"), F.lit(i).alias("p")) for t, i in p]))))
    rare = _list([_list([F.struct(F.lit(i).alias("p"), F.lit(w).alias("w"), F.lit(s).alias("s")) for i, w, s in x["rare"]]) for x in found])
    keys = _list([_list([F.struct(F.lit(i).alias("p"), F.lit(w).alias("w")) for i, w in x["keys"]]) for x in found])
    labels = _list([F.lit(x["label"]) for x in found])
    total = _list([F.lit(float(sum(s for _, _, s in x["rare"]))) for x in found])
    rest = [c for c in documents.columns if c not in ("n_words", "licenses")]
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    # the other columns are one struct meanwhile, so that no name of theirs meets one of the steps
    step = documents.select(F.struct(*rest).alias("_row"), words.alias("_words"))
    hits = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(list(postings)), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    step = step.withColumn("_hits", hits)
    votes = F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.transform(F.element_at(by_word, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("o"))))))
    at = lambda v, r: F.get(F.col("_words"), v["o"] + r["p"]).eqNullSafe(r["w"])

    def placed(v: Column) -> Column:
        return F.filter(F.get(rare, v["t"]), lambda r: at(v, r))

    def agrees(v: Column) -> Column:
        return (F.size(placed(v)) * 2 >= F.size(F.get(rare, v["t"]))) & F.forall(F.get(keys, v["t"]), lambda k: at(v, k))

    share = lambda v: F.aggregate(placed(v), F.lit(0.0), lambda a, r: a + r["s"]) / F.get(total, v["t"])
    licences = F.transform(F.filter(votes, agrees), lambda v: F.struct(v["t"].alias("template"), F.get(labels, v["t"]).alias("label"), v["o"].alias("word"), share(v).alias("share")))
    out = step.select("_row", F.size("_words").cast("long").alias("n_words"), F.when(F.size("_hits") > 0, licences).otherwise(F.expr("cast(array() as array<struct<template:int,label:string,word:int,share:double>>)")).alias("licenses"))
    return out.select(*(F.col("_row")[c].alias(c) for c in rest), "n_words", "licenses")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence words of every document, as the contract's columns.

    A null or empty text has no words, no labels, null places and a score of 0.  A row for each row: repeated rows and null
    ids stay; a place counts once for each phrase that begins there.  An empty table gives no rows;
    further columns aren't read.
    """
    found = scan(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    found = found.withColumn("_base", F.filter("licenses", lambda x: x["template"] < BASE))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    places = F.transform("_base", lambda x: x["word"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        names("_base").alias("base_labels"),
        names("licenses").alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda x: F.least(F.lit(1.0), x["share"]))), F.lit(0.0)).alias("score"),
    )
