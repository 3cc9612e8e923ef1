"""The registered queries over the given tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import QUERY_STOPWORDS, TOKEN, lexical_terms, squeeze, token_estimate
from tessera.operators import chunking, evaluation, evidence, graph, retrieval
from tessera.plans.registry import QUERIES, SQL, query
from tessera.sources.ingest import manifest_differences, table
from tessera.sources.shared import kept

_STOP = ", ".join(f"'{w}'" for w in QUERY_STOPWORDS)
_SQUEEZE = "trim(regexp_replace(replace({0}, chr(173), ''), '[\\t\\n\\f\\r ]+', ' ', 'g'))"
_WORDS = "regexp_extract_all({0}, '[A-Za-z0-9]+')"
_PLAN = f"""raw AS (
  SELECT item_id AS query_id, lower(w) AS term, i FROM (SELECT item_id, unnest({_WORDS.format("text")}) AS w, generate_subscripts({_WORDS.format("text")}, 1) AS i FROM benchmark)
), firsts AS (SELECT query_id, term, min(i) AS i FROM raw GROUP BY ALL
), content AS (SELECT * FROM firsts WHERE term NOT IN ({_STOP}) AND NOT regexp_matches(term, '^[a-z]$')
), chosen AS (SELECT * FROM content UNION ALL SELECT * FROM firsts WHERE query_id NOT IN (SELECT query_id FROM content)
), terms AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS r FROM chosen) WHERE r <= 24)"""
_POSTINGS = f"""postings AS (
  SELECT item_id, term, count(*) AS tf FROM (SELECT doc_id AS item_id, lower(unnest({_WORDS.format("text")})) AS term FROM documents) WHERE term IN (SELECT term FROM terms) GROUP BY ALL)"""
_LEXICAL = f"""{_PLAN}, {_POSTINGS}, sizes AS (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY ALL
), hits AS (SELECT query_id, item_id, count(*) AS matched, sum(least(tf, 256)) AS uses FROM terms JOIN postings USING (term) GROUP BY ALL
), lexical AS (SELECT query_id, item_id, matched, matched / n_terms AS coverage, uses * 0.1::DOUBLE AS score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, uses DESC, item_id) AS INTEGER) AS rank FROM hits JOIN sizes USING (query_id)) WHERE rank <= 20)"""
_COSINE = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"


def _dense_sql(queries: str, k: int, extra: str = "") -> str:
    return f"""dense AS (SELECT query_id, item_id, score, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS item_id, {_COSINE} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COSINE}, 9) DESC, v.vec_id) AS INTEGER) AS rank
  FROM (SELECT * FROM embeddings WHERE {queries}) q JOIN embeddings v ON true {extra}) WHERE rank <= {k})"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("label").alias("kind"))


def _searchers(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return _vectors(spark, d).filter("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{TOKEN}')) AS INTEGER) AS n_tokens FROM documents")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("n_tokens"))


@query(f"SELECT doc_id, md5({_SQUEEZE.format('text')}) AS digest, length({_SQUEEZE.format('text')}) AS n FROM documents")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", squeeze(F.col("text")).alias("t"))
    return docs.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query(f"WITH {_PLAN} SELECT query_id, string_agg(term, ' | ' ORDER BY r) AS plan, count(*) AS n_terms FROM terms GROUP BY ALL")
def lexical_plan(spark: SparkSession, d: str) -> DataFrame:
    planned = _questions(spark, d).select("query_id", lexical_terms(F.col("text")).alias("t"))
    return planned.select("query_id", F.array_join("t", " | ").alias("plan"), F.size("t").cast("long").alias("n_terms"))


@query(f"WITH {_dense_sql('vec_id % 20 = 0', 10)} SELECT query_id, item_id, round(score, 6) AS score, rank FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_search(_searchers(spark, d), _vectors(spark, d), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_dense_sql('vec_id % 20 = 0', 10, 'WHERE q.label = v.label')} SELECT query_id, item_id, round(score, 6) AS score, rank FROM dense")
def dense_topk_by_type(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_search(_searchers(spark, d), _vectors(spark, d), 10, same=True).withColumn("score", F.round("score", 6))


@query("""SELECT count(*) AS chunks, count(e.vec_id) AS embedded, count(*) - count(e.vec_id) AS missing,
  CASE WHEN count(DISTINCT len(e.embedding)) = 1 THEN max(len(e.embedding)) END AS dimension, count(*) > 0 AND count(*) = count(e.vec_id) AS complete
  FROM documents c LEFT JOIN embeddings e ON c.doc_id = e.vec_id""")
def embedding_coverage(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.coverage(_texts(spark, d), _vectors(spark, d))


@query("SELECT doc_id AS item_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.pending(_texts(spark, d).select("item_id"), _vectors(spark, d))


@query(f"WITH {_LEXICAL} SELECT query_id, item_id, matched, round(coverage, 6) AS coverage, round(score, 6) AS score, rank FROM lexical")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.lexical_search(_questions(spark, d), _texts(spark, d))
    return found.withColumns({"coverage": F.round("coverage", 6), "score": F.round("score", 6)})


_HYBRID = f"""{_LEXICAL}, {_dense_sql("vec_id IN (SELECT item_id FROM benchmark)", 20)}, merged AS (
  SELECT query_id, item_id, d.rank AS dense_rank, l.rank AS lexical_rank, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0) AS fusion
  FROM dense d FULL JOIN lexical l USING (query_id, item_id)
), fused AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(fusion, 12) DESC, least(coalesce(dense_rank, 1000000000), coalesce(lexical_rank, 1000000000)), item_id) AS INTEGER) AS rank FROM merged) WHERE rank <= 10)"""


def _stages(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Lists of each question; the vector with the question's number stands in for the question's own."""
    questions = _questions(spark, d)
    asked = _vectors(spark, d).join(questions.select(F.col("query_id").alias("item_id")), "item_id", "left_semi").withColumnRenamed("item_id", "query_id")
    dense = kept(retrieval.dense_search(asked, _vectors(spark, d), 20), "dense")
    lexical = kept(retrieval.lexical_search(questions, _texts(spark, d)), "lexical")
    return {"dense": dense, "lexical": lexical, "fused": retrieval.fuse(dense, lexical)}


@query(f"WITH {_HYBRID} SELECT query_id, item_id, dense_rank, lexical_rank, round(fusion, 9) AS fusion, rank FROM fused")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d)["fused"].withColumn("fusion", F.round("fusion", 9))


_RERANK = f"""{_HYBRID}, pool AS (SELECT m.query_id, m.item_id, f.rank AS hybrid_rank FROM merged m LEFT JOIN fused f USING (query_id, item_id)
), scored AS (SELECT query_id, item_id, any_value(hybrid_rank) AS hybrid_rank, coalesce(round(count(term) / any_value(n_terms), 9), 0) AS rerank_score
  FROM pool LEFT JOIN (SELECT t.query_id, p.item_id, t.term FROM terms t JOIN postings p USING (term)) USING (query_id, item_id) LEFT JOIN sizes USING (query_id) GROUP BY ALL
), reranked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, coalesce(hybrid_rank, 1000000000), item_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 10)"""


def _reranked(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    stages = _stages(spark, d)
    union = stages["dense"].select("query_id", "item_id").unionByName(stages["lexical"].select("query_id", "item_id")).distinct()
    pool = union.join(stages["fused"].select("query_id", "item_id", F.col("rank").alias("hybrid_rank")), ["query_id", "item_id"], "left")
    scores = retrieval.overlap_scores(pool, _questions(spark, d), _texts(spark, d))
    return stages | {"reranked": retrieval.rerank(pool, scores)}


@query(f"WITH {_RERANK} SELECT query_id, item_id, hybrid_rank, round(rerank_score, 6) AS rerank_score, rank FROM reranked")
def rerank_union(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d)["reranked"].select("query_id", "item_id", "hybrid_rank", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query(f"""WITH {_RERANK}, stages AS (SELECT query_id, item_id, 'dense' AS s, rank FROM dense UNION ALL SELECT query_id, item_id, 'lexical', rank FROM lexical
  UNION ALL SELECT query_id, item_id, 'fused', rank FROM fused UNION ALL SELECT query_id, item_id, 'reranked', rank FROM reranked)
  SELECT query_id, item_id, min(rank) FILTER (s = 'dense') AS dense_rank, min(rank) FILTER (s = 'lexical') AS lexical_rank, min(rank) FILTER (s = 'fused') AS fused_rank, min(rank) FILTER (s = 'reranked') AS reranked_rank,
  coalesce(min(rank) FILTER (s = 'reranked') <= 5, false) AS seed FROM stages GROUP BY ALL""")
def retrieval_trace(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.trace(_reranked(spark, d), 5)


_UNITS = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents
), units AS (SELECT doc_id, CAST(place AS INTEGER) AS place, {_SQUEEZE.format("raw")} AS text, CAST(len(regexp_extract_all({_SQUEEZE.format("raw")}, '{TOKEN}')) AS INTEGER) AS tokens FROM lines
), repeated AS (SELECT text, count(DISTINCT doc_id) AS docs, count(*) AS uses FROM units WHERE length(text) BETWEEN 1 AND 220 GROUP BY text HAVING count(DISTINCT doc_id) >= 3)"""


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Written once: decisions read them for each unit and for the texts that repeat."""
    return kept(chunking.units(table(spark, d, "documents").select("doc_id", "text")), "units")


@query(f"WITH {_UNITS} SELECT text, docs, CAST(uses AS BIGINT) AS uses FROM repeated")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return chunking.repeated(_units(spark, d))


_DECIDED = f"""{_UNITS}, decided AS (SELECT *, CASE WHEN text = '' THEN 'empty_text' WHEN row_number() OVER (PARTITION BY doc_id, text ORDER BY place) > 1 THEN 'duplicate'
  WHEN regexp_matches(text, '^[0-9]+$') THEN 'page_number' WHEN text IN (SELECT text FROM repeated) THEN 'repeated_margin' WHEN NOT regexp_matches(text, '[A-Za-z]') THEN 'no_letters' ELSE 'retrieval_text' END AS reason FROM units)"""


@query(f"WITH {_DECIDED} SELECT reason, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM decided GROUP BY reason")
def cleaning_reasons(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d)
    return chunking.decisions(units, chunking.repeated(units)).groupBy("reason").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


_PACKED = f"""{_DECIDED}, kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i FROM decided WHERE reason = 'retrieval_text'
), packed AS (SELECT doc_id, i, place, text, tokens, 0 AS chunk_index, tokens AS used FROM kept WHERE i = 1
  UNION ALL SELECT k.doc_id, k.i, k.place, k.text, k.tokens, CASE WHEN p.used + k.tokens > 450 THEN p.chunk_index + 1 ELSE p.chunk_index END, CASE WHEN p.used + k.tokens > 450 THEN k.tokens ELSE p.used + k.tokens END
  FROM packed p JOIN kept k ON k.doc_id = p.doc_id AND k.i = p.i + 1
), joined AS (SELECT doc_id, chunk_index, string_agg(text, chr(10) ORDER BY place) AS text, string_agg('u' || place, chr(10) ORDER BY place) AS sources, CAST(sum(tokens) AS BIGINT) AS tokens, min(place) AS first_place, max(place) AS last_place, count(*) AS units FROM packed GROUP BY ALL
), chunks AS (SELECT *, doc_id || '-c' || lpad(chunk_index::VARCHAR, greatest(4, length(chunk_index::VARCHAR))::INTEGER, '0') || '-' || left(sha256('paragraph' || chr(10) || sources || chr(10) || text), 10) AS chunk_id FROM joined)"""


def _packed(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d)
    kept = chunking.decisions(units, chunking.repeated(units)).filter("decision = 'include'").select("doc_id", "place", "text", "tokens")
    return chunking.packed(kept)


@query(f"WITH RECURSIVE {_PACKED} SELECT doc_id, place, tokens, CAST(chunk_index AS INTEGER) AS chunk_index FROM packed")
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("doc_id", "place", "tokens", "chunk_index")


@query(f"WITH RECURSIVE {_PACKED} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, chunk_id, tokens, first_place, last_place, units FROM chunks")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(_packed(spark, d)).select("doc_id", "chunk_index", "chunk_id", "tokens", "first_place", "last_place", "units")


@query(f"""WITH RECURSIVE {_PACKED} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens, min(tokens) AS min_tokens, max(tokens) AS max_tokens,
  round_even(avg(tokens), 2) AS avg_tokens, count(*) FILTER (tokens > 700) AS over_limit FROM chunks""")
def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    return chunking.summary(chunking.chunks(_packed(spark, d)))


_SEEDS = "seeds AS (SELECT l.query_id, l.item_id AS doc_id, 0 AS chunk_index, l.rank FROM lexical l WHERE l.rank <= 5)"
_CONTEXT = f"""{_LEXICAL}, {_PACKED}, {_SEEDS}, near AS (SELECT s.query_id, c.doc_id, c.chunk_index, min(s.rank) AS source_rank, bool_or(s.chunk_index = c.chunk_index) AS is_seed
  FROM seeds s JOIN chunks c ON c.doc_id = s.doc_id AND c.chunk_index BETWEEN s.chunk_index - 1 AND s.chunk_index + 2 GROUP BY ALL
), context AS (SELECT query_id, doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, source_rank, is_seed, CAST(row_number() OVER (PARTITION BY query_id ORDER BY source_rank, doc_id, chunk_index) AS INTEGER) AS context_order
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_seed DESC, source_rank, chunk_index, doc_id) AS i FROM near) WHERE i <= 30)"""


def _context(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first chunk of each of the five best documents, with its neighbours; and all chunks."""
    found = retrieval.lexical_search(_questions(spark, d), _texts(spark, d)).filter("rank <= 5")
    chunks = kept(chunking.chunks(_packed(spark, d)), "chunks")
    seeds = found.select("query_id", F.col("item_id").alias("doc_id"), F.lit(0).alias("chunk_index"), "rank")
    return evidence.expand(seeds, chunks), chunks


@query(f"WITH RECURSIVE {_CONTEXT} SELECT * FROM context")
def context_expand(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d)[0]


@query(f"""WITH RECURSIVE {_CONTEXT} SELECT query_id, 'E' || row_number() OVER (PARTITION BY query_id ORDER BY context_order) AS evidence_id, chunk_id, doc_id, first_place, last_place, CAST(length(text) AS INTEGER) AS n_chars
  FROM context JOIN chunks USING (doc_id, chunk_index) WHERE trim(text) <> ''""")
def evidence_package(spark: SparkSession, d: str) -> DataFrame:
    return evidence.package(*_context(spark, d))


_CLAIMS = f"""claims AS (SELECT conv_id AS response_id, turn AS claim_no, i AS position, lower(w) AS evidence_id FROM (
  SELECT conv_id, turn, unnest({_WORDS.format("text")}) AS w, generate_subscripts({_WORDS.format("text")}, 1) - 1 AS i FROM conversations WHERE role = 'assistant'))"""


@query(f"""WITH {_CLAIMS}, firsts AS (SELECT response_id, evidence_id, min(struct_pack(claim_no := claim_no, position := CAST(position AS INTEGER))) AS f, count(*) AS uses FROM claims GROUP BY ALL)
  SELECT response_id, evidence_id, uses, CAST(row_number() OVER (PARTITION BY response_id ORDER BY f.claim_no, f.position, evidence_id) AS INTEGER) AS marker, 'CIT-' || evidence_id AS citation_id FROM firsts""")
def citation_markers(spark: SparkSession, d: str) -> DataFrame:
    """Words of assistant turns stand in for the evidence that claims name."""
    said = table(spark, d, "conversations").filter("role = 'assistant'")
    words = said.select(F.col("conv_id").alias("response_id"), F.col("turn").alias("claim_no"), F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("position", "evidence_id"))
    return evidence.markers(words.withColumn("evidence_id", F.lower("evidence_id")))


_GOLD = "gold AS (SELECT l.query_id, l.item_id, l.item_id % 3 AS evidence_group FROM lexical l WHERE coverage >= 0.5)"
_SCORES = f"""{_LEXICAL}, {_GOLD}, items AS (SELECT g.query_id, g.item_id, l.rank FROM gold g LEFT JOIN fused l USING (query_id, item_id)),
grouped AS (SELECT g.query_id, g.evidence_group, min(l.rank) AS rank FROM gold g LEFT JOIN fused l USING (query_id, item_id) GROUP BY ALL),
scores AS (SELECT query_id, {", ".join(f"CASE WHEN count(*) FILTER (rank <= {k}) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_{k}, count(*) FILTER (rank <= {k}) / count(*) AS recall_{k}" for k in evaluation.CUTS)}, coalesce(1.0::DOUBLE / min(rank), 0) AS rr FROM items GROUP BY query_id),
complete AS (SELECT query_id, {", ".join(f"CASE WHEN bool_and(coalesce(rank <= {k}, false)) THEN 1.0::DOUBLE ELSE 0.0 END AS complete_{k}" for k in evaluation.CUTS)} FROM grouped GROUP BY query_id)"""
_SCORES = _SCORES.replace(_LEXICAL, _HYBRID)
_COLUMNS = [f"{m}_{k}" for k in evaluation.CUTS for m in ("hit", "recall", "complete")] + ["rr"]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """The fused list against the documents that have at least half of a question's terms, in three evidence groups."""
    stages = _stages(spark, d)
    gold = stages["lexical"].filter("coverage >= 0.5").select("query_id", "item_id", (F.col("item_id") % 3).alias("evidence_group"))
    return evaluation.score_ranking(stages["fused"], gold)


@query(f"WITH {_SCORES} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in _COLUMNS)} FROM scores JOIN complete USING (query_id)")
def score_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("query_id", *(F.round(c, 6).alias(c) for c in _COLUMNS))


@query(f"""WITH {_SCORES}, m AS (SELECT *, query_id % 4 AS category FROM scores JOIN complete USING (query_id))
  SELECT category, count(*) AS n, {", ".join(f"round(avg({c}), 6) AS {c}" for c in _COLUMNS)} FROM m GROUP BY GROUPING SETS ((category), ())""")
def score_by_group(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.averages(_scores(spark, d).withColumn("category", F.col("query_id") % 4), "category")


@query("""WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 1 AND quality <> 0) AS fp, count(*) FILTER (toxic <> 1 AND quality = 0) AS fn FROM labels)
  SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1 FROM c""")
def abstention_prf(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.precision_recall(table(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 0)


@query("SELECT CAST(sum(quality) AS BIGINT) AS covered, CAST(sum(toxic) AS BIGINT) AS partial, CAST(sum(quality + toxic + 1) AS BIGINT) AS total, round((sum(quality) + 0.5::DOUBLE * sum(toxic)) / sum(quality + toxic + 1), 6) AS completeness FROM labels")
def semantic_micro(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.micro_average(table(spark, d, "labels").withColumn("total", F.col("quality") + F.col("toxic") + 1), "quality", "toxic", "total")


@query("""WITH n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
  p AS (SELECT a.id, CASE WHEN c.id IS NOT NULL THEN c.title || ' > ' || b.title || ' > ' || a.title WHEN b.id IS NOT NULL THEN b.title || ' > ' || a.title ELSE a.title END AS path, CAST(1 + (b.id IS NOT NULL)::INT + (c.id IS NOT NULL)::INT AS INTEGER) AS depth
  FROM n a LEFT JOIN n b ON a.parent_id = b.id LEFT JOIN n c ON b.parent_id = c.id) SELECT * FROM p""")
def section_paths(spark: SparkSession, d: str) -> DataFrame:
    level = lambda t, mark, key, parent, pmark, title: table(spark, d, t).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), (F.concat(F.lit(pmark), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")).alias("parent_id"), F.col(title).alias("title"))
    nodes = level("region", "r", "r_regionkey", None, "", "r_name").unionByName(level("nation", "n", "n_nationkey", "n_regionkey", "r", "n_name")).unionByName(level("customer", "c", "c_custkey", "c_nationkey", "n", "c_name"))
    return graph.paths(nodes).select("id", F.array_join("path", " > ").alias("path"), "depth")


@query("""SELECT 'duplicate_order' AS code, 'error' AS severity, CAST(o_orderkey AS VARCHAR) AS subject FROM orders GROUP BY o_orderkey HAVING count(*) > 1
  UNION ALL SELECT 'order_customer_missing', 'error', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'line_order_missing', 'error', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'label_document_missing', 'error', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'document_label_missing', 'error', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    return evaluation.findings(
        evaluation.duplicated("duplicate_order", t("orders"), "o_orderkey"),
        evaluation.dangling("order_customer_missing", t("orders"), "o_custkey", t("customer"), "c_custkey", "o_orderkey"),
        evaluation.dangling("line_order_missing", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "l_orderkey"),
        evaluation.dangling("label_document_missing", t("labels"), "doc_id", t("documents"), "doc_id", "doc_id"),
        evaluation.dangling("document_label_missing", t("documents"), "doc_id", t("labels"), "doc_id", "doc_id"),
    )


@query(f"""WITH {_UNITS}, marks AS (SELECT DISTINCT doc_id, place FROM units WHERE text IN (SELECT text FROM repeated)), runs AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM marks)
  SELECT doc_id, min(place) AS first, max(place) AS last, count(*) AS n FROM runs GROUP BY doc_id, run""")
def navigation_zones(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d)
    marks = units.join(chunking.repeated(units).select("text"), "text", "left_semi")
    return graph.islands(marks, "doc_id", "place")


@query(f"""WITH {_PLAN}, shared AS (SELECT a.query_id AS id, b.query_id AS other, count(*) AS k FROM terms a JOIN terms b USING (term) WHERE a.query_id <> b.query_id GROUP BY ALL), n AS (SELECT query_id, count(*) AS n FROM terms GROUP BY ALL)
  SELECT id, other, jaccard FROM (SELECT id, other, round(k / (x.n + y.n - k), 6) AS jaccard, row_number() OVER (PARTITION BY id ORDER BY round(k / (x.n + y.n - k), 6) DESC, other) AS i FROM shared JOIN n x ON x.query_id = id JOIN n y ON y.query_id = other) WHERE i = 1""")
def overlap_audit(spark: SparkSession, d: str) -> DataFrame:
    planned = _questions(spark, d).select(F.col("query_id").alias("id"), lexical_terms(F.col("text")).alias("terms"))
    return evaluation.overlaps(planned, planned)


@query("WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS sha FROM documents), e AS (SELECT CAST(item_id AS VARCHAR) AS name, sha256(text) AS sha FROM benchmark) SELECT e.name, CASE WHEN f.sha IS NULL THEN 'missing' ELSE 'changed' END AS state FROM e LEFT JOIN f USING (name) WHERE f.sha IS NULL OR f.sha <> e.sha")
def manifest_guard(spark: SparkSession, d: str) -> DataFrame:
    hashed = lambda t, key: table(spark, d, t).select(F.col(key).cast("string").alias("name"), F.sha2("text", 256).alias("sha256"))
    return manifest_differences(hashed("documents", "doc_id"), hashed("benchmark", "item_id"))


@query(f"""WITH {_HYBRID}, v AS (SELECT k AS variant, query_id, count(*) AS union_size, coalesce(max(1.0::DOUBLE / dense_rank), 0) AS rr FROM merged, (VALUES (5), (10), (20)) t(k) WHERE dense_rank <= k OR lexical_rank <= k GROUP BY ALL)
  SELECT variant, count(*) AS n, round(avg(union_size), 6) AS union_size, round(avg(rr), 6) AS mrr FROM v GROUP BY variant""")
def experiment_variants(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the candidates' union at three depths."""
    stages = _stages(spark, d)
    side = lambda name: stages[name].select("query_id", "item_id", F.col("rank").alias(f"{name}_rank"))
    both = side("dense").join(side("lexical"), ["query_id", "item_id"], "full").withColumn("variant", F.explode(F.array(*map(F.lit, (5, 10, 20)))))
    deep = both.filter((F.col("dense_rank") <= F.col("variant")) | (F.col("lexical_rank") <= F.col("variant")))
    runs = deep.groupBy("variant", "query_id").agg(F.count("*").alias("union_size"), F.coalesce(F.max(1 / F.col("dense_rank")), F.lit(0.0)).alias("reciprocal_rank"))
    return evaluation.variants(runs)


_FLAGS = "list_filter([CASE WHEN hit_10 = 0 THEN 'missed' END, CASE WHEN hit_10 > 0 AND hit_1 = 0 THEN 'late' END, CASE WHEN complete_10 = 0 THEN 'incomplete' END, CASE WHEN rr < 0.5 THEN 'low_rank' END], lambda x: x IS NOT NULL)"


@query(f"WITH {_SCORES} SELECT query_id, array_to_string({_FLAGS}, ' ') AS flags FROM scores JOIN complete USING (query_id) WHERE list_contains({_FLAGS}, 'incomplete')")
def failure_flags(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.failure_flags(_scores(spark, d), "incomplete").withColumn("flags", F.array_join("flags", " "))


@query(f"WITH {_SCORES.replace('FROM gold g LEFT JOIN fused l', 'FROM gold g LEFT JOIN (SELECT query_id, item_id, CAST((rank + 1) // 2 AS INTEGER) AS rank FROM fused) l')} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in _COLUMNS)} FROM scores JOIN complete USING (query_id)")
def context_scores(spark: SparkSession, d: str) -> DataFrame:
    """Two hits to each seed: an item counts from its seed's rank on."""
    stages = _stages(spark, d)
    gold = stages["lexical"].filter("coverage >= 0.5").select("query_id", "item_id", (F.col("item_id") % 3).alias("evidence_group"))
    context = stages["fused"].select("query_id", "item_id", F.expr("(rank + 1) div 2").cast("int").alias("source_rank"))
    return evaluation.score_context(context, gold).select("query_id", *(F.round(c, 6).alias(c) for c in _COLUMNS))


@query(f"""WITH {_RERANK}, stages AS (SELECT query_id, item_id, 'dense' AS s, rank FROM dense UNION ALL SELECT query_id, item_id, 'lexical', rank FROM lexical UNION ALL SELECT query_id, item_id, 'fused', rank FROM fused UNION ALL SELECT query_id, item_id, 'reranked', rank FROM reranked),
  t AS (SELECT query_id, item_id, min(rank) FILTER (s = 'dense') AS d, min(rank) FILTER (s = 'lexical') AS l, min(rank) FILTER (s = 'fused') AS f, min(rank) FILTER (s = 'reranked') AS r FROM stages GROUP BY ALL)
  SELECT query_id, item_id, lang, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r NULLS LAST, f NULLS LAST, d NULLS LAST, l NULLS LAST, item_id) AS INTEGER) AS final_rank FROM t LEFT JOIN documents ON doc_id = item_id""")
def candidate_snapshot(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "lang")
    return retrieval.snapshot(retrieval.trace(_reranked(spark, d), 5), chunks).select("query_id", "item_id", "lang", "final_rank")


@query("SELECT count(*) AS chunks, CAST(count(*) AS BIGINT) AS embedded FROM embeddings")
def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    """Of the rows that have a vector, all have one: the gate lets them pass."""
    vectors = _vectors(spark, d)
    return retrieval.gate(retrieval.coverage(vectors.select("item_id"), vectors)).select("chunks", "embedded")


from tessera.plans import element_queries, structure_queries  # noqa: E402, F401  its queries are registered with these
