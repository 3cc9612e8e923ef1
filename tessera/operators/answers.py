"""Prompts, decisions of a model and their checks, provenance and locators of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST_PROMPT = 40_000
DECISION = "status string, claims array<struct<text: string, evidence_ids: array<string>>>"


def prompts(questions: DataFrame, evidence: DataFrame, most: int = LONGEST_PROMPT) -> DataFrame:
    """query_id, n_evidence, prompt, and state: ready, insufficient_evidence (no model is asked) or too_long (nothing is cut).

    questions: query_id, text; evidence: query_id, n (from 1), title, text, in blocks by n.
    """
    block = F.concat(F.lit("[E"), F.col("n").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("text"))
    blocks = evidence.withColumn("block", block).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("blocks"))
    joined = questions.join(blocks, "query_id", "left")
    prompt = F.concat(F.lit("Question:\n"), F.col("text"), F.lit("\n\nEvidence:\n"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"))
    state = F.when(F.col("blocks").isNull(), "insufficient_evidence").when(F.length(prompt) > most, "too_long").otherwise("ready")
    return joined.select("query_id", F.coalesce(F.size("blocks"), F.lit(0)).alias("n_evidence"), F.when(state == "ready", prompt).alias("prompt"), state.alias("state"))


def recovered(answer: Column) -> Column:
    """The JSON object of a noisy answer: from its first to its last brace; null without one."""
    return F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))


def decisions(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """status, n_claims and errors of answers (query_id, answer) against the evidence (query_id, evidence_id) they may name.

    Answered goes with claims, and claims with answered; every claim has a text and names known evidence.
    """
    parsed = answers.select("query_id", F.from_json(recovered(F.col("answer")), DECISION).alias("d"))
    known = evidence.groupBy("query_id").agg(F.collect_set("evidence_id").alias("known"))
    joined = parsed.join(known, "query_id", "left")
    claims = F.coalesce(F.col("d.claims"), F.array().cast("array<struct<text:string,evidence_ids:array<string>>>"))
    named = F.array_distinct(F.flatten(F.transform(claims, lambda c: F.coalesce(c["evidence_ids"], F.array().cast("array<string>")))))
    unknown = F.size(F.array_except(named, F.coalesce("known", F.array().cast("array<string>"))))
    valid = F.col("d.status").isNotNull()
    errors = F.array_compact(
        F.array(
            F.when(~valid, "no_decision"),
            F.when(valid & ~F.coalesce(F.col("d.status"), F.lit("")).isin("answered", "insufficient_evidence"), "unknown_status"),
            F.when((F.col("d.status") == "answered") & (F.size(claims) == 0), "answered_without_claims"),
            F.when((F.col("d.status") != "answered") & (F.size(claims) > 0), "claims_without_answer"),
            F.when(F.exists(claims, lambda c: F.coalesce(F.trim(c["text"]), F.lit("")) == ""), "claim_without_text"),
            F.when(F.exists(claims, lambda c: F.coalesce(F.size(c["evidence_ids"]), F.lit(0)) == 0), "claim_without_evidence"),
            F.when(unknown > 0, "unknown_evidence"),
        )
    )
    return joined.select("query_id", F.col("d.status").alias("status"), F.size(claims).alias("n_claims"), F.size(named).alias("n_named"), errors.alias("errors"))


def provenance(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Violations of evidence (query_id, evidence_id, chunk_id, doc_id, pages) against chunks: query_id, evidence_id, code."""
    repeated = evidence.groupBy("query_id", "evidence_id").count().filter("count > 1").select("query_id", "evidence_id", F.lit("repeated_id").alias("code"))
    met = evidence.join(chunks.select("chunk_id", F.col("doc_id").alias("c_doc"), F.col("pages").alias("c_pages")), "chunk_id", "left")
    code = F.when(F.col("c_doc").isNull(), "chunk_missing").when(F.col("c_doc") != F.col("doc_id"), "other_document").when(~F.col("pages").eqNullSafe(F.col("c_pages")), "other_pages")
    return met.select("query_id", "evidence_id", code.alias("code")).filter("code is not null").unionByName(repeated)


def locators(elements: DataFrame) -> DataFrame:
    """The most precise place that names each element: appendix, clause, definition, section, or its page.

    elements: doc_id, place, page, and appendix, clause, definition, section (labels or null).
    """
    found = F.coalesce(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("label"))) for c in ("appendix", "clause", "definition", "section")), F.struct(F.lit("page").alias("kind"), F.col("page").cast("string").alias("label")))
    return elements.select("doc_id", "place", "page", found.alias("l")).groupBy("doc_id", "l.kind", "l.label").agg(F.count("*").alias("elements"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def met_locators(gold: DataFrame, actual: DataFrame) -> DataFrame:
    """Source groups (query_id, evidence_group) and whether a locator meets one of their gold locators.

    gold and actual: query_id, kind, label and pages; gold has evidence_group.  Labels are compared without case, and the
    gold pages have to be among the actual ones.
    """
    keyed = lambda df: df.withColumn("l", F.lower("label"))
    met = keyed(gold).join(keyed(actual).select("query_id", "kind", "l", F.col("pages").alias("had")), ["query_id", "kind", "l"], "left")
    hit = F.coalesce(F.size(F.array_except("pages", "had")) == 0, F.lit(False))
    return met.groupBy("query_id", "evidence_group").agg(F.max(hit).alias("met"))


def group_coverage(met: DataFrame, questions: DataFrame) -> DataFrame:
    """Share of a question's source groups that are met; null for one without groups."""
    shares = met.groupBy("query_id").agg(F.avg(F.col("met").cast("double")).alias("coverage"), F.count("*").alias("n_groups"))
    return questions.select("query_id").join(shares, "query_id", "left").select("query_id", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.round("coverage", 6).alias("coverage"))
