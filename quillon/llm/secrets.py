"""Secret scans in DataFrame functions alone: fixed patterns, and sliding-window entropy.

Places of pattern matches come from the lengths of what lies between them (split) and of the
matches themselves, added up.  Candidate strings for the entropy test are runs of key characters
with a letter and a digit; over each window of WINDOW characters the Shannon entropy is kept up by
incremental counts: a character that enters or leaves changes one count and, with it, the sum of
n log n that the entropy follows from.  A candidate is a secret if its largest window entropy reaches
the limit of its character class (hexadecimal, one case with digits, or mixed), unless the allow-list
knows it.

Everything happens inside the row, without a shuffle.  A text without matches costs one regex search
for each pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import read

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of at least so many is the same as a longest run, dropped where it is shorter.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
LEAST_VALUE = 8
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: A letter and a digit must be among the characters; the looks ahead don't cross the run.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character that a window must reach, by class (20 different characters have 4.32).
LIMITS = {"hex": 3.1, "single": 3.5, "mixed": 3.7}
#: What known placeholders and examples contain.
ALLOW = r"(?i)example|sample|placeholder|dummy|changeme|redacted|x{6}|0123456789|123456789|abcdefgh|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _matches(pattern: str, value: int = 0) -> Column:
    """array<struct<start,end,found>> of a pattern's matches in _text (code points from 0)."""
    text = F.col("_text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    sizes = F.zip_with(F.slice(between, 1, F.size(found)), F.arrays_zip(found.alias("m"), values.alias("v")), lambda b, x: F.struct(F.length(b).alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("found")))
    start = F.struct(F.lit(0).alias("at"), _none("array<struct<start:int,end:int,found:string>>").alias("out"))
    placed = F.aggregate(
        sizes,
        start,
        lambda a, x: F.struct((a["at"] + x["gap"] + x["size"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"), x["found"].alias("found")))).alias("out")),
        lambda a: a["out"],
    )
    return F.when(text.rlike(pattern), placed).otherwise(_none("array<struct<start:int,end:int,found:string>>"))


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy of any ``window`` neighbouring characters, by incremental counts."""
    flog = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)))
    chars = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    codes = F.filter(chars, lambda c: c >= 0)
    zero = F.array_repeat(F.lit(0), len(ALPHABET))
    start = F.struct(F.lit(0).alias("i"), zero.alias("n"), F.lit(0.0).alias("s"), F.lit(float("inf")).alias("low"))

    def count(a: Column, c: Column, by: int) -> Column:
        n = F.get(a["n"], c)
        return F.struct(a["i"].alias("i"), F.transform(a["n"], lambda x, j: x + F.when(j == c, by).otherwise(0)).alias("n"), (a["s"] + F.get(flog, n + by) - F.get(flog, n)).alias("s"), a["low"].alias("low"))

    def slide(a: Column, pair: Column) -> Column:
        entered = count(a, pair["new"], 1)
        return F.struct(
            (a["i"] + 1).alias("i"),
            F.when(pair["old"] >= 0, F.transform(entered["n"], lambda x, j: x - F.when(j == pair["old"], 1).otherwise(0))).otherwise(entered["n"]).alias("n"),
            F.when(pair["old"] >= 0, entered["s"] + F.get(flog, F.get(entered["n"], pair["old"]) - 1) - F.get(flog, F.get(entered["n"], pair["old"]))).otherwise(entered["s"]).alias("s"),
            a["low"].alias("low"),
        )

    def step(a: Column, pair: Column) -> Column:
        b = slide(a, pair)
        return F.struct(b["i"].alias("i"), b["n"].alias("n"), b["s"].alias("s"), F.when(b["i"] >= window, F.least(a["low"], b["s"])).otherwise(a["low"]).alias("low"))

    pairs = F.transform(codes, lambda c, i: F.struct(c.alias("new"), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1)).alias("old")))
    return F.aggregate(pairs, start, step, lambda a: F.lit(math.log2(window)) - a["low"] / window)


def scan(documents: DataFrame) -> DataFrame:
    """documents with ``secrets``: array<struct<kind,start,end,found>>, by start, then kind as listed.

    Places are code points, the end exclusive.  ``found`` is the value of an assignment, else the
    whole match.  Null and empty texts have none.  Spans of different kinds may overlap.  Other
    columns pass; a column named ``secrets`` is replaced.
    """
    rest = [c for c in documents.columns if c != "secrets"]
    # the other columns are one struct meanwhile, so that no name of theirs meets one of the steps
    step = documents.select(F.struct(*rest).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    step = step.withColumn("_assign", F.filter(_matches(ASSIGN, 1), lambda x: F.length(x["found"]) >= LEAST_VALUE)).withColumn("_access", _matches(ACCESS)).withColumn("_hex", _matches(HEX)).withColumn("_candidates", _matches(CANDIDATE))
    limit = lambda s: F.when(s.rlike("^[0-9a-f]+$"), LIMITS["hex"]).when(~s.rlike("[a-z]") | ~s.rlike("[A-Z]"), LIMITS["single"]).otherwise(LIMITS["mixed"])
    random = F.when(F.size("_candidates") > 0, F.filter("_candidates", lambda x: ~x["found"].rlike(ALLOW) & (window_entropy(x["found"]) >= limit(x["found"])))).otherwise(F.col("_candidates"))
    step = step.withColumn("_entropy", random)

    def numbered(i: int) -> Column:
        return F.transform(f"_{KINDS[i]}", lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("order"), x["end"].alias("end"), x["found"].alias("found")))

    all_of = F.concat(*(numbered(i) for i in range(len(KINDS))))
    kinds = F.array(*(F.lit(k) for k in KINDS))
    found = step.select("_row", F.transform(F.array_sort(all_of), lambda x: F.struct(F.get(kinds, x["order"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"))).alias("secrets"))
    return found.select(*(F.col("_row")[c].alias(c) for c in rest), "secrets")


def redacted(text: Column, secrets: Column, mark: str = "[secret]") -> Column:
    """The text with every run of overlapping spans replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        inside = x["start"] < a["at"]
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark))).alias("out"))

    done = F.aggregate(secrets, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(secrets) > 0, done).otherwise(text)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document.

    Null and empty texts have none.  A row for each row, repeated rows and null ids included.  Spans that start together go by kind as
    listed; those of different kinds may overlap.  An empty table gives no rows; further columns aren't read.
    """
    found = scan(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    many = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(many(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(written(F.filter("secrets", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
        written("secrets").alias("spans"),
    )
