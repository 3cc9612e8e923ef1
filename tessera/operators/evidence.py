"""Structural context of hits, evidence packages and citation markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import announces


def expand(seeds: DataFrame, chunks: DataFrame, back: int = 1, forward: int = 2, most: int = 30) -> DataFrame:
    """Seeds (query_id, doc_id, chunk_index, rank) and their neighbours in the document, at most `most` rows a query.

    Neighbour places are listed and joined by equality, so no range join is planned.  A chunk that several seeds reach
    has the best source_rank; seeds come first.  Gives query_id, doc_id, chunk_index, source_rank, is_seed, context_order.
    """
    around = F.explode(F.sequence(F.col("chunk_index") - back, F.col("chunk_index") + forward))
    near = seeds.select("query_id", "doc_id", F.col("chunk_index").alias("seed"), "rank", around.alias("chunk_index")).join(chunks.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"])
    grouped = near.groupBy("query_id", "doc_id", "chunk_index").agg(F.min("rank").alias("source_rank"), F.max(F.col("seed") == F.col("chunk_index")).alias("is_seed"))
    capped = grouped.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("is_seed"), "source_rank", "chunk_index", "doc_id"))).filter(F.col("i") <= most)
    order = Window.partitionBy("query_id").orderBy("source_rank", "doc_id", "chunk_index")
    return capped.select("query_id", "doc_id", "chunk_index", "source_rank", "is_seed", F.row_number().over(order).alias("context_order"))


def structural(seeds: DataFrame, chunks: DataFrame, forward: int = 2, gap: int = 1, most: int = 30) -> DataFrame:
    """Seeds and the neighbours that the structure ties to them: a preceding intro, a following table or list item, introduced parts.

    seeds: query_id, doc_id, chunk_index, rank, each place once a query; chunks: doc_id, chunk_index, kind, text, pages and
    section_path.  Neighbours need the same section_path and pages at most `gap` apart (no pages: no gap).  Neighbours
    that the first `most` rows of a query leave no room for are dropped in the order of seeds and rules.  Never
    recursive.  A seed without its chunk stays alone.  Gives query_id, doc_id, chunk_index, source_rank,
    ranked_seed_rank (null but for seeds), reasons and context_order.
    """
    own = chunks.select("doc_id", F.col("chunk_index").alias("seed"), *(F.col(c).alias(f"s_{c}") for c in ("kind", "text", "pages", "section_path")))
    asked = seeds.select("query_id", "doc_id", F.col("chunk_index").alias("seed"), "rank").join(own, ["doc_id", "seed"])
    steps = F.array(F.lit(-1), *(F.lit(i) for i in range(1, forward + 1)))
    around = asked.withColumn("step", F.explode(steps)).withColumn("chunk_index", F.col("seed") + F.col("step"))
    near = around.join(chunks.select("doc_id", "chunk_index", "kind", "text", "pages", "section_path"), ["doc_id", "chunk_index"], "left")
    apart = F.array_min(F.flatten(F.transform("s_pages", lambda a: F.transform("pages", lambda b: F.abs(a - b)))))
    fits = F.coalesce(F.col("kind").isNotNull() & F.col("section_path").eqNullSafe(F.col("s_section_path")) & (F.coalesce(apart, F.lit(0)) <= gap), F.lit(False))
    parts = ("list_item", "table", "mixed", "subclause")
    near = near.withColumn("fits", fits).withColumn("goes_on", F.col("fits") & F.col("kind").isin(*parts) & (F.col("step") > 0))
    stop = F.min(F.when((F.col("step") > 0) & ~F.col("goes_on"), F.col("step"))).over(Window.partitionBy("query_id", "doc_id", "seed"))
    near = near.withColumn("stop", F.coalesce(stop, F.lit(forward + 1))).filter("fits")
    after = F.col("step") == 1
    ends = F.lower(F.trim("s_text")).rlike(r"\b(and|or)\s*$")
    follows = F.when(F.col("s_kind").isin(*parts) & (F.col("step") == -1) & announces(F.col("text")), F.struct(F.lit(1).alias("rule"), F.lit("preceding_intro").alias("reason")))
    follows = follows.when(after & (F.col("kind") == "table") & (F.col("s_kind") != "table"), F.struct(F.lit(2).alias("rule"), F.lit("following_table").alias("reason")))
    follows = follows.when(after & (F.col("kind") == "list_item") & ends, F.struct(F.lit(2).alias("rule"), F.lit("continuation_list_item").alias("reason")))
    introduced = announces(F.col("s_text")) & (F.col("step") > 0) & (F.col("step") <= forward) & (F.col("step") < F.col("stop"))
    follows = follows.when(introduced, F.struct(F.lit(3).alias("rule"), F.lit("introduced_child").alias("reason")))
    near = near.withColumn("f", follows).filter("f is not null").select("query_id", "doc_id", "chunk_index", "rank", "step", "f.rule", "f.reason")

    ranked = seeds.select("query_id", "doc_id", "chunk_index", F.col("rank").alias("seed_rank"))
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("n_seeds"))
    met = near.join(ranked, ["query_id", "doc_id", "chunk_index"], "left").join(counts, "query_id")
    order = ["rank", "rule", "step"]
    nth = F.row_number().over(Window.partitionBy("query_id", "doc_id", "chunk_index").orderBy(*order))
    met = met.withColumn("new", F.when(F.col("seed_rank").isNull() & (nth == 1), 1).otherwise(0))
    upto = F.sum("new").over(Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("upto", upto)
    before = F.min(F.col("upto") - F.col("new")).over(Window.partitionBy("query_id", "rank"))
    met = met.withColumn("before", before).filter((F.col("upto") + F.col("n_seeds") <= most) & (F.col("before") + F.col("n_seeds") < most))
    entry = F.struct("rank", "rule", "step", "reason")
    rows = met.select("query_id", "doc_id", "chunk_index", "rank", F.lit(None).cast("int").alias("seed_rank"), entry.alias("entry"))
    first = F.struct(F.lit(0).alias("rank"), F.lit(0).alias("rule"), F.lit(0).alias("step"), F.lit("ranked_seed").alias("reason"))
    rows = rows.unionByName(ranked.select("query_id", "doc_id", "chunk_index", F.col("seed_rank").alias("rank"), "seed_rank", first.alias("entry")))
    grouped = rows.groupBy("query_id", "doc_id", "chunk_index").agg(F.min("rank").alias("source_rank"), F.max("seed_rank").alias("ranked_seed_rank"), F.array_sort(F.collect_list("entry")).alias("e"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("source_rank", "chunk_index", F.col("ranked_seed_rank").isNull(), "doc_id"))
    return grouped.select("query_id", "doc_id", "chunk_index", "source_rank", "ranked_seed_rank", F.array_distinct(F.transform("e", lambda x: x["reason"])).alias("reasons"), number.alias("context_order"))


def package(context: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence of each query: E1, E2, ... over context rows whose chunk has a text."""
    joined = context.join(chunks.select("doc_id", "chunk_index", "chunk_id", "text", "first_place", "last_place"), ["doc_id", "chunk_index"]).filter(F.trim("text") != "")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("context_order"))
    return joined.select("query_id", F.concat(F.lit("E"), number.cast("string")).alias("evidence_id"), "chunk_id", "doc_id", "first_place", "last_place", F.length("text").alias("n_chars"))


def markers(claims: DataFrame) -> DataFrame:
    """Citation markers of evidence by first use: claims (response_id, claim_no, evidence_id, position)."""
    first = claims.groupBy("response_id", "evidence_id").agg(F.min(F.struct("claim_no", "position")).alias("first"), F.count("*").alias("uses"))
    order = Window.partitionBy("response_id").orderBy("first.claim_no", "first.position", "evidence_id")
    number = F.row_number().over(order)
    return first.select("response_id", "evidence_id", "uses", number.alias("marker"), F.concat(F.lit("CIT-"), F.col("evidence_id").cast("string")).alias("citation_id"))
