"""The corpus pipeline: toxic texts go, one text of each group of near copies stays, benchmark passages
are cut, secrets are replaced, and what is left is packed into windows.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last
return the columns of ``docs``, in their order; ``n_chars``, where there is one, follows the text.
Nulls are empty texts to every stage; a text that a stage doesn't change keeps its null.  Rows with a
null doc_id are never dropped as near copies.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import secrets
from quillon.llm.common import read, written
from quillon.llm.decontaminate import NEW, without_contamination
from quillon.llm.jaccard import near_duplicates
from quillon.llm.packing import pack
from quillon.llm.toxicity import fit, with_toxicity

#: Ids of dropped near copies that are broadcast at most (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _counted(docs: DataFrame, changed: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)))
    return changed.select(*docs.columns)


def _aside(docs: DataFrame, names) -> dict[str, str]:
    """Own columns with names that an operator adds -> names that nothing has, for the time of the stage."""
    taken = {c.lower() for c in docs.columns}
    out = {}
    for c in docs.columns:
        if c.lower() in names:
            new = f"_{c}"
            while new.lower() in taken:
                new = f"_{new}"
            taken.add(new.lower())
            out[c] = new
    return out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the toxicity models reject (a score of 0.5 or more) go."""
    model = fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    own = _aside(docs, ("toxicity",))
    kept = with_toxicity(docs.withColumnsRenamed(own), model).where("toxicity < 0.5").drop("toxicity")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each component of linked texts, the document with the smallest id stays; repeated rows of it are one."""
    found = written(near_duplicates(docs).where("doc_id is not null and n_shingles > 0"), "near-copies")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    few = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    twice = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    n = twice.count()
    if not n:
        return kept
    many = F.broadcast(twice) if n <= BROADCAST_IDS else twice
    once = kept.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.join(many, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: passages that the benchmark has too are cut out of the texts; the documents stay."""
    own = _aside(docs, NEW)
    found = without_contamination(docs.withColumnsRenamed(own), read(spark, sf_dir, "benchmark"))
    return _counted(docs, found.withColumnsRenamed({v: k for k, v in own.items()}))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every secret becomes a mark."""
    own = _aside(docs, ("secrets",))
    found = secrets.scan(docs.withColumnsRenamed(own))
    out = found.withColumn("text", secrets.redacted(F.col("text"), F.col("secrets"))).drop("secrets")
    return _counted(docs, out.withColumnsRenamed({v: k for k, v in own.items()}))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: what is left, tokenised and packed."""
    return pack(docs)


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_near_copies), ("decontamination", cut_benchmark), ("secrets", replace_secrets), ("packing", pack_windows)]
#: Trained models and tokenisation aren't SQL.  Tests compare the stages' results with plain versions, that of toxicity with operator 6's predictions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
