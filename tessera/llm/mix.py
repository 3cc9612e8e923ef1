"""Mixing sources to target weights: exact block quotas, split among output shards by hypergeometric draws."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import Given
from .scratch import Scratch
from .wordhash import gives_back, slices, utf8, words

#: Words of a block, but a source has as many as LEAST blocks if it has the words; blocks of an output shard.
BLOCK, LEAST, SHARD = 1024, 1024, 4096
#: Rows of a part of a source's order, on average, and parts of a group of parts.
PART, GROUP = 1000, 4096
SEED = 20240607
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Words for each source: `share` of all words by weight, none above `most` times its size, the excess reshared."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if sizes[i] > 0]
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def _share(rng: np.random.Generator, good: int, bad: int, count: int) -> int:
    """A hypergeometric draw; its normal limit, kept within its range, where numbers are beyond the generator's (10 ** 9)."""
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, count)) if good and count else 0
    whole = good + bad
    mean, spread = count * good / whole, (count * (good / whole) * (bad / whole) * (whole - count) / (whole - 1)) ** 0.5
    return min(max(round(rng.normal(mean, spread)), count - bad, 0), good, count)


def draw(rng: np.random.Generator, colours: list[int], count: int) -> list[int]:
    """A multivariate hypergeometric sample of `count`, as a chain of univariate ones."""
    out, left = [], sum(colours)
    for n in colours:
        left -= n
        out.append(_share(rng, n, left, count))
        count -= out[-1]
    return out


def tree(blocks: list[int], quotas: list[int], shards: int, shard: int, seed: int) -> list[tuple[int, int, int]]:
    """A leaf of the splitting tree: for each source first block, number of blocks and quota of a shard.

    A node has a range of every source's blocks and a quota of them, to be drawn at most `epochs` times each.  Its left
    half gets its part of the node's whole quota, by a multivariate hypergeometric draw over the sources, and of each
    source's range the part that its quota is of the node's, so that the blocks of two shards are disjoint.  Each node
    has a generator of its own, so every shard finds the same tree without seeing the others.
    """
    epochs = [max(1, -(-q // b)) if b else 1 for b, q in zip(blocks, quotas, strict=True)]
    low, high, here = 0, shards, [(0, b, q) for b, q in zip(blocks, quotas, strict=True)]
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        drawn = draw(rng, [q for _, _, q in here], sum(q for _, _, q in here) * (middle - low) // (high - low))
        split = []
        for (first, count, quota), left, e in zip(here, drawn, epochs, strict=True):
            if -(-left // e) - (-(quota - left) // e) > count:  # full to the last place: halves of whole blocks only
                left -= left % e
            least, most = -(-left // e), count + (-(quota - left) // e)
            own = min(max(count * left // quota if quota else 0, least), most)
            split.append((first, own, left) if shard < middle else (first + own, count - own, quota - left))
        here = split
        low, high = (low, middle) if shard < middle else (middle, high)
    return here


def leaf(ranges: list[tuple[int, int, int]], shard: int, seed: int) -> np.ndarray:
    """Rows (source, block, epoch) that a shard draws from its ranges of blocks, in the shard's own order.

    Each source's blocks of the leaf are permuted and drawn without repeats, all once before any twice.
    """
    rows = [np.zeros((0, 3), np.int64)]
    for s, (first, count, quota) in enumerate(ranges):
        epoch = 0
        while quota > 0:
            order = np.random.Generator(np.random.PCG64([seed, shard, s, epoch])).permutation(count)[:quota]
            rows.append(np.stack([np.full(len(order), s), first + order, np.full(len(order), epoch)], axis=1))
            quota, epoch = quota - len(order), epoch + 1
    found = np.concatenate(rows)
    return found[np.random.Generator(np.random.PCG64([seed, shard])).permutation(len(found))]


def _draws(blocks: list[int], quotas: list[int], shards: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch["id"].to_pylist():
            found = leaf(tree(blocks, quotas, shards, shard, seed), shard, seed)
            columns = [pa.array(found[:, k]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(found), shard, np.int64)), pa.array(np.arange(len(found)))], names=["s", "block", "epoch", "shard", "place"])


class Mix:
    """A mix of docs: `documents` with sizes and places on their source's axis of words, `pieces`, `sources`.

    docs has doc_id, text and source (may be null: a source of its own); other columns may have any name.  A source's
    words lie on an axis, documents in an order by hash; the axis is cut into blocks of about `block` words, and each
    source gives a whole number of blocks.  A tree of hypergeometric draws deals blocks and quotas among shards of about
    SHARD blocks, and each shard draws its quotas from its own blocks, every block once before any twice.  Null and
    empty texts have no words and no pieces.  Rows alike in doc_id, text and source are told apart by number.  Equal
    tables give equal mixes.  Sources are known to the driver, a row each.
    """

    def __init__(
        self, spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 0, seed: int = SEED, block: int = BLOCK
    ) -> None:
        scratch = Scratch(spark, "mix")
        self.given = given = Given(docs)
        sized = given.df.select(given["doc_id"].cast("long").alias("doc_id"), given["source"].cast("string").alias("source"), F.coalesce(F.regexp_count(given["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"), self.uid().alias("uid"))
        sized = scratch.table(sized.withColumn("copy", F.row_number().over(Window.partitionBy("uid").orderBy("size"))))
        totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in totals]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
        blocks = [max(-(-n // block), min(n, LEAST)) for n in sizes]
        quotas = [min(int(most * b), round(t * b / n)) if n else 0 for t, b, n in zip(goal, blocks, sizes, strict=True)]
        schema = "s long, source string, source_size long, target double, blocks long, parts long"
        self.sources = spark.createDataFrame([(i, r["source"], r["size"], goal[i], blocks[i], -(-r["n"] // PART)) for i, r in enumerate(totals)], schema)
        placed = sized.join(self.sources, sized["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"])
        placed = placed.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(seed)), "parts"))
        # Words ahead of a part: of the groups of parts before its own, and of the parts of its group before it.
        parts = scratch.table(placed.groupBy("s", F.expr(f"part div {GROUP}").alias("band"), "part").agg(F.sum("size").alias("words")))
        groups = parts.groupBy("s", "band").agg(F.sum("words").alias("words"))
        sums = lambda keys, by: F.coalesce(F.sum("words").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        groups = groups.select("s", "band", sums(["s"], "band").alias("before"))
        parts = parts.select("s", "band", "part", sums(["s", "band"], "part").alias("ahead")).join(groups, ["s", "band"]).select("s", "part", (F.col("ahead") + F.col("before")).alias("ahead"))
        within = Window.partitionBy("s", "part").orderBy("uid", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = placed.join(parts, ["s", "part"]).withColumn("start", F.col("ahead") + F.sum("size").over(within) - F.col("size"))
        self.documents = scratch.table(placed.select("doc_id", "source", "uid", "copy", "s", "size", "source_size", "target", "blocks", "start"), done=(sized,))
        shards = shards or max(1, sum(quotas) // SHARD)
        drawn = spark.range(shards).mapInArrow(partial(_draws, blocks, quotas, shards, seed), "s long, block long, epoch long, shard long, place long")
        # Block b holds words [b * size div blocks, (b + 1) * size div blocks); word w lies in ((w + 1) * blocks - 1) div size.
        spread = self.documents.filter("size > 0").withColumn("block", F.explode(F.expr("sequence(((start + 1) * blocks - 1) div source_size, ((start + size) * blocks - 1) div source_size)")))
        low, high = F.expr("(block * source_size) div blocks"), F.expr("((block + 1) * source_size) div blocks")
        spread = spread.select("uid", "copy", "s", "start", "block", F.greatest(low - F.col("start"), F.lit(0)).alias("first"), F.least(high - F.col("start"), F.col("size")).alias("stop"))
        self.pieces = spread.filter("stop > first").join(drawn, ["s", "block"])

    def uid(self) -> F.Column:
        return F.xxhash64(*(self.given[c] for c in ("doc_id", "source", "text")))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of each document."""
        sums = self.pieces.groupBy("uid", "copy").agg(F.sum(F.col("stop") - F.col("first")).alias("taken"))
        found = self.documents.join(sums, ["uid", "copy"], "left")
        return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))

    def texts(self) -> DataFrame:
        """The mix itself: docs' columns, with text cut to the words taken, in order of shard and place in the shard.

        Rows are sorted within their task; a shard's rows are all in one task.  Runs of a document in neighbouring
        blocks of one shard and epoch make one row, at the place of the first one drawn.  A text taken whole is
        unchanged; n_chars, if docs has it, is the new length in characters.
        """
        return self.given.back(self._cut())

    def sharded(self) -> DataFrame:
        """The rows of texts() with the number of their shard and their place in it, to be written by shard."""
        return self.given.back(self._cut(), added={"shard": F.col("shard"), "place": F.col("place")})

    def _cut(self) -> DataFrame:
        order = Window.partitionBy("uid", "copy", "shard", "epoch").orderBy("block")
        runs = self.pieces.withColumn("run", F.col("block") - F.row_number().over(order))
        runs = runs.groupBy("uid", "copy", "shard", "epoch", "run").agg(F.min("first").alias("first"), F.max("stop").alias("stop"), F.min("place").alias("place"))
        runs = runs.select(F.col("uid").alias("uid_"), F.col("copy").alias("copy_"), "first", "stop", "shard", "place")
        given = self.given
        whole = given.df.withColumn("uid", self.uid())
        whole = whole.withColumn("copy", F.row_number().over(Window.partitionBy("uid").orderBy(F.length(given["text"]))))
        # Joined by uid alone, as the texts lie by uid already for their numbers: a join by both would deal them out again.
        cut = whole.join(runs, (F.col("uid") == F.col("uid_")) & (F.col("copy") - F.col("copy_") == 0)).select(*given.own, "first", "stop", "shard", "place")
        # Words first, then the shuffle by shard: what is dealt out is cut already.
        cut = cut.mapInArrow(partial(_words, given.name("text")), ", ".join(f"{c} {t}" for c, t in cut.dtypes))
        if "n_chars" in given.names:
            cut = cut.withColumn(given.name("n_chars"), F.length(given["text"]).cast(given.type("n_chars")))
        return cut.repartition("shard").sortWithinPartitions("shard", "place")


@gives_back
def _words(text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in slices(batch[text]):
            part = batch.slice(i, j - i)
            raw, bounds = utf8(part[text])
            starts, ends, first = words(raw, bounds)
            texts = []
            for k, (a, b) in enumerate(zip(part["first"].to_pylist(), part["stop"].to_pylist(), strict=True)):
                n = int(first[k + 1] - first[k])
                low = int(bounds[k]) if a == 0 else int(starts[first[k] + a])
                high = int(bounds[k + 1]) if b >= n else int(ends[first[k] + b - 1])
                texts.append(raw[low:high].tobytes().decode())
            at = part.schema.get_field_index(text)
            columns = [part.column(c) for c in range(part.num_columns)]
            columns[at] = pa.array(texts, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)
