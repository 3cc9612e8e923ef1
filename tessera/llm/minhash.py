"""Near-duplicate documents: multi-index Hamming join over b-bit MinHash signatures, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import Given
from .links import distance, near_components
from .scratch import Scratch
from .wordhash import U64, gives_back, mix, shingle_sets, slices

#: Symbols of a signature, bits of a symbol in a chunk's key, chunks, and symbols that a link may differ in.
#: At similarity 0.8 a symbol differs with probability 0.2; more than 25 of 64 differ once in ten thousand pairs.
SYMBOLS, CHUNKS, MOST = 64, 13, 25
_RANDOM = np.random.Generator(np.random.PCG64(71))
_A = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) | U64(1)
_B = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_CHUNKS = np.array_split(np.arange(SYMBOLS), CHUNKS)


def signature(items: np.ndarray) -> np.ndarray:
    """Sixteen bits of each of SYMBOLS minima over a set of hashes, in blocks of bounded size."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, U64)
    for i in range(0, len(items), 8192):
        np.minimum(least, (items[i : i + 8192, None] * _A + _B).min(axis=0), out=least)
    return (mix(least) & U64(0xFFFF)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of each signature: for every chunk, and every symbol of it left out, a hash of the others.

    CHUNKS chunks that each allow one error: two signatures with at most 2 * CHUNKS - 1 differing symbols
    have, by the pigeonhole principle, a chunk with at most one, and so a common key.
    """
    wide = signatures.astype(U64) + U64(1)
    keys = []
    for c, chunk in enumerate(_CHUNKS):
        for out in chunk:
            key = np.full(len(wide), c * SYMBOLS + out + 1, U64)
            for symbol in chunk:
                if symbol != out:
                    key = mix(key ^ wide[:, symbol])
            keys.append(key)
    return np.stack(keys, axis=1)


def packed(signatures: np.ndarray) -> np.ndarray:
    """The low four bits of every symbol, sixteen to a long."""
    low = (signatures & 15).astype(U64).reshape(len(signatures), -1, 16)
    return (low << (np.arange(16, dtype=np.uint64) * U64(4))).sum(axis=2, dtype=np.uint64)


@gives_back
def _features(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in slices(batch["text"]):
            part = batch.slice(i, j - i)
            found = [s for s, _ in shingle_sets(part["text"], width)]
            sizes = [len(s) for s in found]
            signatures = np.stack([signature(s) for s in found])
            nodes = mix(np.array([int(s.sum(dtype=np.uint64)) for s in found], U64) ^ mix(np.array(sizes, U64))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["uid"], pa.array(sizes, pa.int64()), pa.array(nodes), pa.array(signatures.tobytes()[k : k + 2 * SYMBOLS] for k in range(0, signatures.nbytes, 2 * SYMBOLS))],
                names=["doc_id", "uid", "n", "node", "signature"],
            )


@gives_back
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            signatures = np.frombuffer(b"".join(part["signature"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = chunk_keys(signatures)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part["node"].to_numpy(), keys.shape[1]))], names=["key", "node"])


@gives_back
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signatures = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        q = packed(signatures).view(np.int64) if len(signatures) else np.zeros((0, SYMBOLS // 16), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * q.shape[1]), pa.array(q.ravel()))
        yield pa.RecordBatch.from_arrays([batch["node"], lists], names=["node", "q"])


@gives_back
def _sets(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in slices(batch["text"]):
            part = batch.slice(i, j - i)
            found = [s for s, _ in shingle_sets(part["text"], width)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            items = np.concatenate([*found, np.zeros(0, U64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([part["node"], pa.ListArray.from_arrays(pa.array(ends), pa.array(items))], names=["node", "items"])


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose sets of `width`-word shingles are linked by a similarity of `percent` or more.

    docs has doc_id and text; other columns are ignored.  Words are runs of bytes other than white space, A-Z
    count as a-z.  Returns for each row doc_id, n_shingles, component_id (the smallest doc_id reachable) and
    kept (doc_id = component_id), with row (a hash of doc_id and text) and group (null without shingles).  A null, empty or blank text has no shingles and no links; a text of fewer than
    `width` words is one shingle.  Rows with equal doc_id each get a row; a row with a null doc_id takes part,
    its component_id is null only if no reachable row has a doc_id, and it is never kept.  No rows, no result rows.
    """
    scratch = Scratch(spark, "near-duplicates")
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("uid"))
    rows = scratch.table(given.mapInArrow(partial(_features, width), "doc_id long, uid long, n long, node long, signature binary"))
    first = rows.filter("n > 0").groupBy("node").agg(F.min("uid").alias("uid"))
    nodes = scratch.table(rows.filter("n > 0").join(first, ["node", "uid"]).dropDuplicates(["node"]))
    keys = nodes.select("node", "signature").mapInArrow(_keys, "key long, node long")
    quads = scratch.table(nodes.select("node", "signature").mapInArrow(_packed, "node long, q array<long>"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        chosen = nodes.select("node", "uid").join(wanted, "node")
        whole = given.select("uid", "text").join(chosen, "uid").select("node", "text")
        return whole.mapInArrow(partial(_sets, width), "node long, items array<long>").dropDuplicates(["node"])

    comps = near_components(quads, keys, sets_of, percent=percent, apart_by=partial(distance, longs=SYMBOLS // 16), most=MOST, scratch=scratch)
    # Texts without shingles stay alone: their own row is their component.
    placed = rows.filter("n > 0").join(comps, "node", "left").select("doc_id", "uid", "n", F.coalesce("comp", "node").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = placed.join(least, "comp").select("doc_id", "n", "component_id", "uid", "comp")
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "uid", F.lit(None).cast("long").alias("comp"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept, F.col("uid").alias("row"), F.col("comp").alias("group"))


def one_of_each(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest doc_id; texts without words all stay.

    Other columns pass, whatever their names.  Rows alike in doc_id and text are one document; one of them stays.
    """
    given = Given(docs)
    found = near_duplicates(spark, given.df.select(given["doc_id"].alias("doc_id"), given["text"].alias("text")), width, percent)
    last = F.lit((1 << 63) - 1)
    first = found.filter("group is not null").groupBy("group").agg(F.min(F.struct(F.coalesce("doc_id", last), "row")).alias("first")).select("first.row", F.lit(True).alias("grouped"))
    alone = found.filter("group is null").select("row", F.lit(False).alias("grouped")).distinct()
    stays = given.df.withColumn("row", F.xxhash64(given["doc_id"].cast("long"), given["text"].cast("string"))).join(first.unionByName(alone), "row")
    number = F.row_number().over(Window.partitionBy("row").orderBy("grouped"))
    return given.back(stays.withColumn("k", number).filter("not grouped or k = 1"))
