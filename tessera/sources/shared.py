"""Tables between the steps of a plan, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for sessions of one machine that name no folder, as in tests.
LOCAL_DEFAULT = "file:///tmp/tessera-checkpoints"


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or that given to setCheckpointDir; on a cluster without one, ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = LOCAL_DEFAULT
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame, name: str = "step") -> DataFrame:
    """df's rows, read back from a written table: a step that several others read, or that a loop goes on from.

    Ends the lineage there, so that a lost executor costs a re-read and no step is computed twice.
    """
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
