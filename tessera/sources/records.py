"""Changes of stored tables as plans: upsert, cascade, replacement, embeddings, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new in the place of those with equal keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def cascaded(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows of a child table that stay when the parents in `deleted` go."""
    return child.join(deleted.select(key).distinct(), key, "left_anti").select(*child.columns)


def replaced(chunks: DataFrame, embeddings: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (doc_id, chunk_id) with those of made's documents replaced, and the embeddings (chunk_id) that still have one."""
    kept = upserted(chunks, made, "doc_id")
    return kept, embeddings.join(kept.select("chunk_id"), "chunk_id", "left_semi").select(*embeddings.columns)


def checked_vectors(batch: DataFrame, vector: str = "vector") -> DataFrame:
    """A batch of embeddings; the plan fails unless all vectors have one and the same positive dimension.

    Each row is held against the first row's dimension, found beforehand by an aggregate of one row.
    """
    sizes = batch.agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"))
    one = F.assert_true((F.col("low") == F.col("high")) & (F.col("low") > 0), "vectors of a batch have one positive dimension")
    return batch.join(F.broadcast(sizes.select("low", one.alias("checked")))).filter("checked is null").select(*batch.columns)


def newest_first(listed: DataFrame, at: str, key: str) -> DataFrame:
    """Records that have a time, newest first; equal times by key."""
    return listed.filter(F.col(at).isNotNull()).orderBy(F.desc(at), key)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, quoted line feeds, and perhaps a byte-order mark, as strings."""
    found = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return found.toDF(*(c.lstrip("﻿") for c in found.columns))


#: Families that go past validation; others are taken in, but not read further.
READ_ON = ("pdf", "html")


def reading_state(files: DataFrame) -> DataFrame:
    """files (family, errors) with state: rejected, unsupported or accepted."""
    state = F.when(F.size("errors") > 0, "rejected").when(~F.col("family").isin(*READ_ON), "unsupported").otherwise("accepted")
    return files.withColumn("state", state)
