"""Integrity of sections and clauses: findings by code, and what they mean for review.

sections: doc_id, section_id, parent_id, source (an element's place), page, level, title, ordinal (its place in order);
clauses: doc_id, clause_id, parent_id, section_id, source, page, number, ordinal; elements: doc_id, place, kind, page, text.
Within a record, a rule that would only follow from an earlier one isn't tried: rules are in order, the first that holds is given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import kept

#: Findings that don't block, but ask for a look; further warnings do neither.
REVIEW = ("section_level_conflict", "clause_sibling_gap", "subclause_without_parent")
WARNINGS = (*REVIEW, "clause_sibling_order")


def _given(df: DataFrame, subject: str, code: Column) -> DataFrame:
    found = df.select("doc_id", F.col(subject).cast("string").alias("subject"), code.alias("code")).filter("code is not null")
    return found


def _first(*rules: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for condition, code in reversed(rules):
        out = F.when(condition, code).otherwise(out)
    return out


def _repeated(df: DataFrame, key: str, code: str) -> DataFrame:
    return df.groupBy("doc_id", key).count().filter("count > 1").select("doc_id", F.col(key).cast("string").alias("subject"), F.lit(code).alias("code"))


def _with_parent(df: DataFrame, key: str, *columns: str) -> DataFrame:
    parents = df.dropDuplicates(["doc_id", key]).select("doc_id", F.col(key).alias("parent_id"), F.lit(True).alias("p_known"), *(F.col(c).alias(f"p_{c}") for c in columns))
    return df.join(parents, ["doc_id", "parent_id"], "left")


def _with_source(df: DataFrame, elements: DataFrame) -> DataFrame:
    return df.join(elements.select("doc_id", F.col("place").alias("source"), F.col("kind").alias("e_kind"), F.col("page").alias("e_page")), ["doc_id", "source"], "left")


def section_findings(sections: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, subject and code of what is wrong with sections."""
    source = _with_source(sections, elements)
    own = _first((F.col("e_kind").isNull(), "section_source_missing"), (F.col("e_kind") != "section_header", "section_source_type"), (F.col("e_page") != F.col("page"), "section_page_mismatch"))
    parent = _with_parent(sections, "section_id", "ordinal", "level")
    above = _first(
        (F.col("parent_id").isNull(), None),
        (F.col("parent_id") == F.col("section_id"), "section_self_parent"),
        (F.col("p_known").isNull(), "section_parent_missing"),
        (F.col("p_ordinal") >= F.col("ordinal"), "section_parent_not_before_child"),
        (F.col("p_level") >= F.col("level"), "section_level_conflict"),
    )
    return _repeated(sections, "section_id", "duplicate_section_id").unionByName(_given(source, "section_id", own)).unionByName(_given(parent, "section_id", above))


def clause_findings(clauses: DataFrame, sections: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, subject and code of what is wrong with clauses; siblings are compared in order of their place."""
    source = _with_source(clauses, elements)
    own = _first((F.col("e_kind").isNull(), "clause_source_missing"), (~F.col("e_kind").isin("clause", "subclause"), "clause_source_type"), (F.col("e_page") != F.col("page"), "clause_page_mismatch"))
    known = clauses.join(sections.select("doc_id", "section_id", F.lit(True).alias("s_known")).distinct(), ["doc_id", "section_id"], "left")
    place = F.when(F.col("section_id").isNotNull() & F.col("s_known").isNull(), "clause_section_missing")
    parent = _with_parent(clauses, "clause_id", "ordinal", "section_id")
    above = _first(
        (F.col("parent_id").isNull() & (F.col("kind") == "subclause"), "subclause_without_parent"),
        (F.col("parent_id").isNull(), None),
        (F.col("parent_id") == F.col("clause_id"), "clause_self_parent"),
        (F.col("p_known").isNull(), "clause_parent_missing"),
        (F.col("p_ordinal") >= F.col("ordinal"), "clause_parent_not_before_child"),
        (~F.col("p_section_id").eqNullSafe(F.col("section_id")), "clause_parent_section_conflict"),
    )
    family = ["doc_id", "section_id", "parent_id", "kind"]
    before = F.lag("number").over(Window.partitionBy(*family).orderBy("ordinal"))
    siblings = clauses.filter("number is not null and (kind = 'clause' or parent_id is not null)").withColumn("before", before)
    order = _first((F.col("number") == F.col("before"), None), (F.col("number") < F.col("before"), "clause_sibling_order"), (F.col("number") > F.col("before") + 1, "clause_sibling_gap"))
    doubled = clauses.filter("number is not null").groupBy(*family, "number").agg(F.count("*").alias("n"), F.min("clause_id").alias("subject")).filter("n > 1")
    parts = [
        _repeated(clauses, "clause_id", "duplicate_clause_id"),
        _given(source, "clause_id", own),
        _given(known, "clause_id", place),
        _given(parent, "clause_id", above),
        _given(siblings, "clause_id", order),
        doubled.select("doc_id", F.col("subject").cast("string").alias("subject"), F.when(F.col("kind") == "subclause", "duplicate_subclause_marker").otherwise("duplicate_clause_number").alias("code")),
    ]
    return reduce(DataFrame.unionByName, parts)


def relation_findings(relations: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, subject and code of relations (doc_id, relation_id, kind, source, target) between elements.

    `continues` points forward, to an element of the same kind, at most one page on.
    """
    side = lambda c: elements.select("doc_id", F.col("place").alias(c), F.col("kind").alias(f"{c}_kind"), F.col("page").alias(f"{c}_page"))
    met = relations.join(side("source"), ["doc_id", "source"], "left").join(side("target"), ["doc_id", "target"], "left")
    goes_on = F.col("kind") == "continues"
    code = _first(
        (F.col("source_kind").isNull() | F.col("target_kind").isNull(), "relationship_dangling"),
        (F.col("source") == F.col("target"), "relationship_self"),
        (goes_on & (F.col("target") < F.col("source")), "continues_not_forward"),
        (goes_on & (F.col("source_kind") != F.col("target_kind")), "continues_type_mismatch"),
        (goes_on & (F.col("target_page") - F.col("source_page") > 1), "continues_page_gap"),
    )
    edges = relations.groupBy("doc_id", "kind", "source", "target").agg(F.count("*").alias("n"), F.min("relation_id").alias("subject")).filter("n > 1")
    doubled = edges.select("doc_id", F.col("subject").cast("string").alias("subject"), F.lit("relationship_duplicate_edge").alias("code"))
    return _repeated(relations, "relation_id", "duplicate_relation_id").unionByName(_given(met, "relation_id", code)).unionByName(doubled)


def on_cycles(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """Keys whose way up never ends, of nodes with one parent each.

    Roots, and what hangs from them, are taken away by pointer doubling: after k rounds every node knows its ancestor
    2 ** k steps up, so the rounds grow with the logarithm of the depth.
    """
    known = nodes.select(F.col(key).alias("id")).distinct()
    up = nodes.dropDuplicates([key]).select(F.col(key).alias("id"), F.col(parent).alias("up")).join(known.select(F.col("id").alias("up"), F.lit(True).alias("known")), "up", "left")
    up = up.select("id", F.when(F.col("known"), F.col("up")).alias("up"))
    rounds = max(1, known.count()).bit_length()
    for _ in range(rounds):
        # An ancestor that has no row left is below a root: so are all that reach it.
        up = kept(up.filter("up is not null"), "ancestors")
        up = up.join(up.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up"))
    return up.select(F.col("id").alias(key))


def review_state(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, errors, warnings, status (pass, fail) and semantic_status (clear, review_required, blocked)."""
    warns, review = F.col("code").isin(*WARNINGS), F.col("code").isin(*REVIEW)
    counts = findings.groupBy("doc_id").agg(F.count_if(~warns).alias("errors"), F.count_if(warns).alias("warnings"), F.count_if(review).alias("reviews"))
    joined = documents.select("doc_id").distinct().join(counts, "doc_id", "left").na.fill(0, ["errors", "warnings", "reviews"])
    status = F.when(F.col("errors") > 0, "fail").otherwise("pass")
    semantic = F.when(F.col("errors") > 0, "blocked").when(F.col("reviews") > 0, "review_required").otherwise("clear")
    return joined.select("doc_id", "errors", "warnings", status.alias("status"), semantic.alias("semantic_status"))
