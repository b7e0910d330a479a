"""Versioned tables: each commit writes a new directory and then moves a pointer file; readers follow the pointer.

One writer, many readers.  The pointer is written through Hadoop's file system, so tables can be in
any store that Spark knows; a commit that fails leaves the last version in place.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is set, the warehouse, or on one machine a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "/tmp/checkpoints" if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows are written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def deleted(old: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return old.join(gone.select(*key).distinct(), key, "left_anti")


def latest(changes: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last change of each key.  ``order``: columns, the largest wins."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order)))
    return changes.withColumn("_place", place).where("_place = 1").drop("_place")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def state(self) -> dict:
        """{tables: {name: directory}, time, batches: {stream: last batch}}; empty before the first commit."""
        fs, p = self._fs(f"{self.root}/current.json")
        if not fs.exists(p):
            return {"tables": {}, "time": None, "batches": {}}
        return json.loads(self.spark.read.text(p.toString(), wholetext=True).first()[0])

    def read(self, name: str) -> DataFrame | None:
        at = self.state()["tables"].get(name)
        return self.spark.read.parquet(f"{self.root}/{at}") if at else None

    def commit(self, tables: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> dict:
        """All tables or none: the pointer moves when every directory is complete.  ``batch``: the stream's name and its batch's number."""
        state = self.state()
        for name, df in tables.items():
            at = f"{name}/v-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{at}")
            state["tables"][name] = at
        state |= {"time": time.time(), "batches": {**state.get("batches", {}), **dict([batch] if batch else [])}}
        fs, new = self._fs(f"{self.root}/next-{uuid.uuid4().hex}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, pointer = self._fs(f"{self.root}/current.json")
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri() if pointer.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, pointer, option)
        return state

    def upsert(self, name: str, new: DataFrame, key: list[str], batch: tuple[str, int] | None = None) -> dict:
        old = self.read(name)
        return self.commit({name: new if old is None else upserted(old, new, key)}, batch)

    def delete(self, gone: DataFrame, keys: dict[str, list[str]]) -> dict:
        """Deletes the keys from several tables at once."""
        return self.commit({n: deleted(df, gone, k) for n, k in keys.items() if (df := self.read(n)) is not None})

    def vacuum(self, older: float = 3600.0) -> int:
        """Removes the directories that no table points to and that are older than so many seconds; readers that began before need theirs.  How many went."""
        state, gone = self.state(), 0
        for name in sorted({at.split("/")[0] for at in state["tables"].values()}):
            fs, p = self._fs(f"{self.root}/{name}")
            for s in fs.listStatus(p):
                at = f"{name}/{s.getPath().getName()}"
                if at != state["tables"].get(name) and s.getModificationTime() < (time.time() - older) * 1000:
                    gone += bool(fs.delete(s.getPath(), True))
        return gone

    def statistics(self) -> list[dict]:
        """name, directory, bytes, rows and time of the last commit of each table."""
        state, out = self.state(), []
        for name, at in sorted(state["tables"].items()):
            fs, p = self._fs(f"{self.root}/{at}")
            out.append({"name": name, "path": f"{self.root}/{at}", "bytes": fs.getContentSummary(p).getLength(), "rows": self.read(name).count(), "time": state["time"]})
        return out
