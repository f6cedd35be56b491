"""Stored tables in the shared folder, and runs of named stages that go on where they stopped."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared folder and read again; cuts the lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Folder:
    """File operations by Hadoop's interface, so any store that Spark writes to will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.at = spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.at)

    def delete(self) -> None:
        self.fs.delete(self.at, True)

    def state(self) -> str:
        s = self.fs.getFileStatus(self.at)
        return f"{self.at}:{s.getLen()}:{s.getModificationTime()}"


class Stages:
    """Named stages, each stored under ``folder`` with an entry in its manifest.

    A stage is known by its name, its parameters, the stages it reads and the files that its
    sources read (path, size, time).  If the manifest has an entry for that, the stored
    table is read; otherwise the stage is computed, written and entered, so a run that broke
    off or whose parameters changed computes only what lacks.  A table without an entry is an
    unfinished one and is written anew.  Plans never reach behind a stored table.  How a source
    is made from its files isn't known: another projection needs another name or parameter.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or shared_path(spark, "run")).rstrip("/")
        self.keys: dict[int, str] = {}
        self.tables: list[DataFrame] = []
        self.computed: list[str] = []

    def _key_of(self, source: DataFrame) -> str:
        known = self.keys.get(id(source))
        return known or "|".join(sorted(_Folder(self.spark, f).state() for f in source.inputFiles()))

    def stage(self, name: str, make: Callable[..., DataFrame], *sources: DataFrame, **parameters) -> DataFrame:
        """``make(*sources, **parameters)``, stored; parameters are plain values."""
        said = json.dumps([name, parameters, [self._key_of(s) for s in sources]], sort_keys=True, default=str)
        key = hashlib.sha256(said.encode()).hexdigest()[:24]
        path, entry = f"{self.folder}/{name}-{key}", f"{self.folder}/manifest/{name}-{key}"
        if not _Folder(self.spark, f"{entry}/_SUCCESS").exists():
            began = time.time()
            made = make(*sources, **parameters)
            made.write.mode("overwrite").parquet(path)
            rows = self.spark.read.schema(made.schema).parquet(path).count()
            fields = (name, key, path, made.schema.json(), rows, round(time.time() - began, 3))
            self.spark.createDataFrame([fields], self.ENTRY).coalesce(1).write.mode("overwrite").json(entry)
            self.computed.append(name)
        schema = self.spark.read.schema(self.ENTRY).json(entry).first()["table_schema"]
        table = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(path)
        self.keys[id(table)] = key
        self.tables.append(table)  # kept, as keys go by identity
        return table

    ENTRY = "stage string, key string, path string, table_schema string, n_rows long, seconds double"

    def manifest(self) -> DataFrame:
        """A row per finished stage: stage, key, path, table_schema, n_rows, seconds."""
        return self.spark.read.schema(self.ENTRY).option("recursiveFileLookup", True).json(f"{self.folder}/manifest")

    def forget(self, name: str) -> None:
        """Deletes the entries and tables of a stage, so that it is computed anew."""
        for r in self.manifest().filter(f"stage = '{name}'").collect():  # a row per version of one stage
            _Folder(self.spark, f"{self.folder}/manifest/{name}-{r.key}").delete()
            _Folder(self.spark, r.path).delete()
