"""Tables between the steps of one operator, in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Only for sessions of one machine that set no folder, as in tests.
LOCAL_DEFAULT = "file:///tmp/tessera-checkpoints"
#: Has Spark delete a query's shuffle files at its end; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or that given to setCheckpointDir.

    Where neither is set, a session of one machine takes LOCAL_DEFAULT, and one on a cluster raises ValueError: its
    executors have no folder in common that this could guess.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = LOCAL_DEFAULT
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Writes DataFrames as Parquet below the shared folder, so that lineage ends there.

    A lost executor costs a re-read of these files, never a recomputation of earlier steps.
    """

    #: Lists that get the folders made while they are watched.
    watched: list[list[str]] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        for made in Scratch.watched:
            made.append(self.root)

    def table(self, df: DataFrame, hashes: tuple[str, ...] = (), done: tuple[DataFrame, ...] = ()) -> DataFrame:
        """The rows of df, read back from a written table; hashes: Parquet paths of columns for which a dictionary is of no use.

        done: tables of this object that nothing reads after this one is written; they are deleted.
        """
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            self._write(df, path, hashes)
        finally:
            self.spark.conf.set(CLEANUP, before)
        found = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(found)] = (found, path)
        self.drop(*done)
        return found

    def _write(self, df: DataFrame, path: str, hashes: tuple[str, ...]) -> None:
        df.write.option("compression", "zstd").options(**{f"parquet.enable.dictionary#{c}": "false" for c in hashes}).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in tables:
            kept = self._paths.pop(id(df), None)
            if kept:
                delete(self.spark, kept[1])


def release(spark: SparkSession) -> None:
    """Lets the driver forget plans that nobody holds any more: Spark deletes their shuffle files once they are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def made_here(found: list[str]) -> Iterator[None]:
    """Adds to a list the folders of operators that are called meanwhile."""
    Scratch.watched.append(found)
    try:
        yield
    finally:
        Scratch.watched = [x for x in Scratch.watched if x is not found]


def sweep(spark: SparkSession, docs: DataFrame, folders: list[str]) -> list[str]:
    """Deletes folders of operators whose results have been written; those that docs reads from stay and are returned."""
    release(spark)
    plain = [(f, f.split(":", 1)[-1].lstrip("/") + "/") for f in dict.fromkeys(folders)]
    read = [f.split(":", 1)[-1].lstrip("/") for f in docs.inputFiles()] if plain else []
    kept = {f for f, start in plain if any(x.startswith(start) for x in read)}
    for folder, _ in plain:
        if folder not in kept:
            delete(spark, folder)
    return [f for f, _ in plain if f in kept]
