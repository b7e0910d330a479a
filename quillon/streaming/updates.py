"""Updates from a stream: the last change of each key in a batch is upserted or deletes its row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.store import Store, deleted, latest, upserted


def apply_batch(store: Store, table: str, key: list[str], order: list[str], gone: str, name: str | None = None):
    """For foreachBatch.  ``gone``: SQL condition of a change that deletes; ``name``: the stream's, the table's where it has one stream.

    Batches of this stream that were committed do nothing, nor do changes older than the row they meet.  Deleted
    keys and the order of their deletion are kept in the table ``<table>_gone``, so that an older change that comes late doesn't
    bring a row back; a later one does.
    """
    name = name or table

    def run(batch: DataFrame, number: int) -> None:
        last = store.state().get("batches", {}).get(name)
        if last is not None and number <= last:
            return
        changes = latest(batch, key, order)
        dead = F.coalesce(F.expr(gone), F.lit(False))
        old, tombs = store.read(table), store.read(f"{table}_gone")
        marks = [df.select(*key, *order) for df in (old, tombs) if df is not None]
        if marks:
            held = marks[0] if len(marks) == 1 else marks[0].unionByName(marks[1])
            newer = F.coalesce(F.struct(*(F.col(f"o.{c}") for c in order)) > F.struct(*(F.col(f"n.{c}") for c in order)), F.lit(False))
            stale = changes.alias("n").join(held.alias("o"), key).where(newer).select(*(F.col(k) for k in key)).distinct()
            changes = changes.join(stale, key, "left_anti")
        changes = changes.persist()
        live, ended = changes.where(~dead), changes.where(dead).select(*key, *order)
        rows = live if old is None else upserted(deleted(old, ended, key), live, key)
        kept = ended if tombs is None else deleted(tombs, changes, key).unionByName(ended)
        store.commit({table: rows, f"{table}_gone": kept}, (name, number))
        changes.unpersist()

    return run


def start(stream: DataFrame, store: Store, table: str, key: list[str], order: list[str], gone: str, checkpoint: str, every: str | None = "5 seconds", name: str | None = None) -> StreamingQuery:
    """A running query; with ``every`` None it takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(apply_batch(store, table, key, order, gone, name)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
