"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.store import checkpoint_root, written  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int) -> DataFrame:
    """(text, y): a bounded sample of the training rows, the same for the same input.

    At most ``bound`` rows of each label value, those with the smallest hash of their id.
    A document labelled more than once counts with its largest label; null labels don't count.
    Of rows with the same doc_id, one text counts, the smallest, so that repeated rows keep the bound.
    """
    marks = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(fold(F.col("doc_id"), folds) != held)
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id")
    chosen = None
    for y in (0, 1):
        part = marks.where(F.col("y") == y).withColumn("k", order).orderBy("k", "doc_id").limit(bound).select("doc_id", "y")
        chosen = part if chosen is None else chosen.unionByName(part)
    # 2 * bound rows at most, so the broadcast has a fixed bound
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
