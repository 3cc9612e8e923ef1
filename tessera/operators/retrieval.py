"""Dense and lexical search, fusion, reranking and traces, for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import lexical_terms

#: Bytes of the query vectors that are sent to every task at once; more queries are taken in as many passes as they need.
BLOCK_BYTES = 32 * 1024 * 1024
#: Rows of (query_id, term) up to which query terms are broadcast; beyond, they meet the texts' words in a shuffle.
MOST_TERMS = 500_000
NO_RANK = 1_000_000_000
# Fixed value: the instruction that older English embedding models expect before a query.
INSTRUCTION = "Represent this sentence for searching relevant passages: "


def top(df: DataFrame, k: int, by: str, *order: Column) -> DataFrame:
    """The first k rows of each group, with rank; cut within each task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 10, same: bool = False) -> DataFrame:
    """Exact cosine top k: query_id, item_id, score, rank; ties by item_id.

    queries (query_id, vector) and vectors (item_id, vector), each with `kind` if `same` limits hits to the query's kind.
    Queries are taken in blocks of BLOCK_BYTES by a hash of their id, each block in a pass over the rows; rows are compared
    in blocks by a matrix product and each keeps its k best.  Zero vectors give no hits.
    """
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), *(["kind"] if same else []))
    total = asked.agg(F.sum(F.size("vector") * 8)).first()[0] or 0
    passes = max(1, -(-total // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("query_id", F.lit("block")), F.lit(passes))
    hits = None
    for b in range(passes):
        found = _pass(asked.filter(block == b).collect(), vectors, k, same)
        hits = found if hits is None else hits.unionByName(found)
    return top(hits, k, "query_id", F.desc(F.round("score", 9)), F.col("item_id"))


def _pass(rows: list, vectors: DataFrame, k: int, same: bool) -> DataFrame:
    """query_id, item_id and score of hits of a block of queries, k or more from each block of rows."""
    rows = [r for r in rows if r["vector"] and np.linalg.norm(r["vector"]) > 0]
    matrix = np.array([r["vector"] for r in rows], float)
    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True) if len(rows) else np.zeros((0, 1))
    ids, kinds = np.array([r["query_id"] for r in rows]), np.array([r["kind"] for r in rows]) if same else None

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows if len(ids) else 0, 4096):
                part = batch.slice(i, 4096)
                part = part.filter(pc.is_valid(part["vector"]))
                v = np.array(part["vector"].to_pylist(), float).reshape(part.num_rows, -1)
                norms = np.linalg.norm(v, axis=1)
                known = norms > 0
                if not known.any():
                    continue
                items, v, norms = part["item_id"].to_numpy()[known], v[known], norms[known]
                own = np.array(part["kind"].to_pylist())[known] if same else None
                for q in range(0, len(ids), 1024):
                    scores = matrix[q : q + 1024] @ (v / norms[:, None]).T
                    if same:
                        scores[kinds[q : q + 1024, None] != own[None, :]] = -np.inf
                    keep = min(k, scores.shape[1])
                    least = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1 : keep]
                    at, hit = np.nonzero((scores >= least - 1e-9) & np.isfinite(scores))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q + at]), pa.array(items[hit]), pa.array(scores[at, hit])], names=["query_id", "item_id", "score"])

    columns = [F.col("item_id").cast("long"), "vector"] + (["kind"] if same else [])
    return vectors.select(*columns).mapInArrow(blocks, "query_id long, item_id long, score double")


def coverage(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: chunks, embedded, missing, dimension (if there is one only) and complete."""
    dims = embeddings.select(F.col("item_id").alias("id"), F.size("vector").alias("dimension"))
    joined = chunks.select(F.col("item_id").alias("id")).join(dims, "id", "left")
    counts = joined.agg(F.count("*").alias("chunks"), F.count("dimension").alias("embedded"), F.count_distinct("dimension").alias("kinds"), F.max("dimension").alias("largest"))
    return counts.select("chunks", "embedded", (F.col("chunks") - F.col("embedded")).alias("missing"), F.when(F.col("kinds") == 1, F.col("largest")).cast("long").alias("dimension"), ((F.col("chunks") > 0) & (F.col("chunks") == F.col("embedded"))).alias("complete"))


def pending(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks without a vector."""
    return chunks.join(embeddings.select("item_id"), "item_id", "left_anti")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term and n_terms of queries (query_id, text)."""
    planned = queries.select("query_id", lexical_terms(F.col("text")).alias("terms"))
    return planned.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """item_id, term and tf of texts (item_id, text), only for the terms given (term), without repeats.

    The terms go to every task if they are few enough, so that only words that a query asks for are shuffled.
    """
    words = texts.select("item_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("term")).withColumn("term", F.lower("term"))
    return words.join(F.broadcast(terms) if terms.count() <= MOST_TERMS else terms, "term").groupBy("item_id", "term").agg(F.count("*").alias("tf"))


def lexical_search(queries: DataFrame, texts: DataFrame, k: int = 20) -> DataFrame:
    """OR search: query_id, item_id, matched, coverage, score and rank; by matched terms, then occurrences, then item_id."""
    terms = query_terms(queries)
    hits = postings(texts, terms.select("term").distinct()).join(terms, "term")
    scored = hits.groupBy("query_id", "item_id").agg(F.count("*").alias("matched"), F.sum(F.least("tf", F.lit(256))).alias("uses"), F.max("n_terms").alias("n_terms"))
    ranked = top(scored, k, "query_id", F.desc("matched"), F.desc("uses"), F.col("item_id"))
    return ranked.select("query_id", "item_id", "matched", (F.col("matched") / F.col("n_terms")).alias("coverage"), (F.col("uses") * F.lit(0.1)).alias("score"), "rank")


def fuse(dense: DataFrame, lexical: DataFrame, k: int = 10, constant: int = 60, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal rank fusion: query_id, item_id, dense_rank, lexical_rank, fusion and rank."""
    if constant < 1 or min(weights) < 0 or not sum(weights):
        raise ValueError("the constant is at least 1, weights are not negative and not all 0")
    both = dense.select("query_id", "item_id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("lexical_rank")).unionByName(lexical.select("query_id", "item_id", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("lexical_rank")))
    merged = both.groupBy("query_id", "item_id").agg(F.min("dense_rank").alias("dense_rank"), F.min("lexical_rank").alias("lexical_rank"))
    part = [F.coalesce(F.lit(w) / (F.lit(constant) + F.col(c)), F.lit(0.0)) for w, c in zip(weights, ("dense_rank", "lexical_rank"), strict=True)]
    scored = merged.withColumn("fusion", part[0] + part[1])
    best = F.least(F.coalesce("dense_rank", F.lit(NO_RANK)), F.coalesce("lexical_rank", F.lit(NO_RANK)))
    return top(scored, k, "query_id", F.desc(F.round("fusion", 12)), best, F.col("item_id"))


def rerank(candidates: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """Candidates (query_id, item_id, hybrid_rank) ordered by scores (query_id, item_id, rerank_score), hybrid rank, item_id."""
    joined = candidates.join(scores, ["query_id", "item_id"])
    return top(joined, k, "query_id", F.desc("rerank_score"), F.coalesce("hybrid_rank", F.lit(NO_RANK)), F.col("item_id"))


def overlap_scores(pairs: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """A stand-in for a cross-encoder: share of the query's terms that the text has."""
    terms = query_terms(queries)
    wanted = pairs.select("item_id").distinct()
    found = postings(texts.join(wanted, "item_id", "left_semi"), terms.select("term").distinct()).join(terms, "term").groupBy("query_id", "item_id").agg(F.count("*").alias("hits"), F.max("n_terms").alias("n"))
    return pairs.select("query_id", "item_id").distinct().join(found, ["query_id", "item_id"], "left").select("query_id", "item_id", F.coalesce(F.round(F.col("hits") / F.col("n"), 9), F.lit(0.0)).alias("rerank_score"))


def trace(stages: dict[str, DataFrame], seeds: int) -> DataFrame:
    """Ranks of all stages (query_id, item_id, rank) side by side, and whether the last stage selects the row as a seed."""
    rows = None
    for name, df in stages.items():
        part = df.select("query_id", "item_id", F.lit(name).alias("stage"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    columns = [F.min(F.when(F.col("stage") == n, F.col("rank"))).alias(f"{n}_rank") for n in stages]
    last = [*stages][-1]
    return rows.groupBy("query_id", "item_id").agg(*columns).withColumn("seed", F.coalesce(F.col(f"{last}_rank") <= seeds, F.lit(False)))


def scoped(chunks: DataFrame, embeddings: DataFrame, documents: list | None = None, kinds: list | None = None, model: str | None = None, dimension: int | None = None) -> DataFrame:
    """Vectors to be searched: chunks (item_id, doc_id, kind) joined with embeddings (item_id, vector, model).

    A scope that is None or empty is not applied; the others are plain filters, pushed down to the tables.
    """
    if documents:
        chunks = chunks.filter(F.col("doc_id").isin(*documents))
    if kinds:
        chunks = chunks.filter(F.col("kind").isin(*kinds))
    if model:
        embeddings = embeddings.filter(F.col("model") == model)
    if dimension:
        embeddings = embeddings.filter(F.size("vector") == dimension)
    return chunks.join(embeddings, "item_id")


def gate(coverage_: DataFrame) -> DataFrame:
    """coverage's row; the plan fails where vectors are missing, so that no dense search runs on a part of the chunks."""
    return coverage_.withColumn("checked", F.assert_true(F.col("complete"), "not all chunks have a vector")).filter("checked is null").drop("checked")


def snapshot(trace_: DataFrame, chunks: DataFrame) -> DataFrame:
    """A trace's rows with their chunk's columns and final_rank, the last stage's rank, nulls last, then the fused one's."""
    joined = trace_.join(chunks, "item_id", "left")
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("reranked_rank"), F.asc_nulls_last("fused_rank"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), "item_id")
    return joined.withColumn("final_rank", F.row_number().over(order))


def prefixed(query: Column, model: Column) -> Column:
    """The query as a model wants it: English models of the older family take an instruction before it."""
    legacy = F.lower(model).rlike("bge-(small|base|large)-en")
    return F.concat(F.when(legacy, INSTRUCTION).otherwise(""), F.trim(query))
