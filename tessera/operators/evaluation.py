"""Metrics of rankings and answers, and audits of data sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def score_ranking(ranked: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """query_id, hit, recall and complete at each cut, and rr, of ranked (query_id, item_id, rank) against gold.

    gold has query_id, item_id and evidence_group; a query is complete at k if each of its groups has a hit.
    Items ranked twice count at their first rank; queries without gold have no row.
    """
    first = ranked.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    joined = gold.join(first, ["query_id", "item_id"], "left")
    items = joined.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    by_item = items.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("best"), *(F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in cuts))
    groups = joined.groupBy("query_id", "evidence_group").agg(F.min("rank").alias("rank"))
    by_group = groups.groupBy("query_id").agg(*(F.bool_and(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"g{k}") for k in cuts))
    out = by_item.join(by_group, "query_id")
    metrics = [x for k in cuts for x in (F.when(F.col(f"n{k}") > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"), (F.col(f"n{k}") / F.col("n")).alias(f"recall_{k}"), F.when(F.col(f"g{k}"), 1.0).otherwise(0.0).alias(f"complete_{k}"))]
    return out.select("query_id", *metrics, F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0)).alias("rr"))


def averages(scores: DataFrame, field: str | None = None) -> DataFrame:
    """Macro averages over all rows (field value null) and, in the same pass, for each value of a field."""
    metrics = [c for c, t in scores.dtypes if t == "double"]
    sums = [F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in metrics)]
    if field is None:
        return scores.agg(*sums)
    known = scores.filter(F.col(field).isNotNull())
    return known.groupingSets([[F.col(field)], []], F.col(field)).agg(*sums)


def precision_recall(df: DataFrame, predicted: F.Column, actual: F.Column) -> DataFrame:
    """tp, fp, fn, precision, recall and f1, null where a denominator is 0."""
    counts = df.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    ratio = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    p, r = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    return counts.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.nullif(p + r, F.lit(0.0)), 6).alias("f1"))


def micro_average(df: DataFrame, covered: str, partial: str, total: str) -> DataFrame:
    """(covered + partial / 2) / total over all rows."""
    sums = df.agg(F.sum(covered).alias("covered"), F.sum(partial).alias("partial"), F.sum(total).alias("total"))
    return sums.select("covered", "partial", "total", F.round((F.col("covered") + 0.5 * F.col("partial")) / F.nullif("total", F.lit(0)), 6).alias("completeness"))


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each left question (id, terms) the right one with the highest Jaccard similarity above 0: id, other, jaccard.

    Questions meet by shared terms, not by all pairs.
    """
    a = left.select("id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    b = right.select(F.col("id").alias("other"), F.size("terms").alias("m"), F.explode("terms").alias("term"))
    shared = a.join(b, "term").groupBy("id", "other").agg(F.count("*").alias("k"), F.max("n").alias("n"), F.max("m").alias("m"))
    scored = shared.filter("id <> other").select("id", "other", F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6).alias("jaccard"))
    order = Window.partitionBy("id").orderBy(F.desc("jaccard"), "other")
    return scored.withColumn("i", F.row_number().over(order)).filter("i = 1").drop("i")


def near_questions(left: DataFrame, right: DataFrame, least: float = 0.7) -> DataFrame:
    """For each left question (id, terms) the nearest right one of another id at `least` or more: id, other, jaccard.

    Ties go to the smallest id.  Questions without terms or with null ones have no row.  Each distinct set of terms is
    compared once, and only with sets that share one of its rarest terms: those before the share that two such sets must
    have in common.  So neither a term that all questions have nor a question that is asked over and over makes all pairs.
    """
    as_set = F.array_sort(F.array_distinct("terms"))
    a, b = (side.select("id", as_set.alias("terms")).filter(F.size("terms") > 0) for side in (left, right))
    nth = F.row_number().over(Window.partitionBy("terms").orderBy("id"))
    two = b.distinct().withColumn("nth", nth).filter("nth <= 2").groupBy("terms").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    sets = a.select("terms").distinct()
    used = sets.unionByName(two.select("terms")).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def rarest(of: DataFrame) -> DataFrame:
        dealt = of.select("terms", F.explode("terms").alias("term")).join(used, "term")
        place = F.row_number().over(Window.partitionBy("terms").orderBy("df", "term"))
        return dealt.withColumn("place", place).filter(F.col("place") <= F.size("terms") - F.ceil(least * F.size("terms") - 1e-9) + 1).select("term", "terms")

    x, y = rarest(sets).withColumnRenamed("terms", "s"), rarest(two).withColumnRenamed("terms", "t")
    fits = (F.size("s") >= least * F.size("t") - 1e-9) & (F.size("t") >= least * F.size("s") - 1e-9)
    met = x.join(y, "term").filter(fits).select("s", "t").distinct()
    common = F.size(F.array_intersect("s", "t"))
    share = common / (F.size("s") + F.size("t") - common)
    near = met.withColumn("j", share).filter(F.col("j") >= least - 1e-9).join(two.withColumnRenamed("terms", "t"), "t")
    others = near.select(F.col("s").alias("terms"), F.round("j", 6).alias("jaccard"), F.explode("ids").alias("other"))
    order = F.row_number().over(Window.partitionBy("terms").orderBy(F.desc("jaccard"), "other"))
    best = others.withColumn("nth", order).filter("nth <= 2")
    chosen = a.distinct().join(best, "terms").filter("id <> other").groupBy("id").agg(F.min_by(F.struct("other", "jaccard"), "nth").alias("n"))
    return chosen.select("id", "n.other", "n.jaccard")


def findings(*checks: DataFrame) -> DataFrame:
    """Findings (code, severity, subject) of several checks, one table."""
    return reduce(DataFrame.unionByName, checks)


def dangling(code: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str, subject: str) -> DataFrame:
    """Rows whose reference has no target."""
    missing = child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
    return missing.select(F.lit(code).alias("code"), F.lit("error").alias("severity"), F.col(subject).cast("string").alias("subject"))


def duplicated(code: str, df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once."""
    many = df.groupBy(key).count().filter("count > 1")
    return many.select(F.lit(code).alias("code"), F.lit("error").alias("severity"), F.col(key).cast("string").alias("subject"))


def score_context(context: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """score_ranking of an assembled context (query_id, item_id, source_rank): an item is there at k from its source rank on."""
    return score_ranking(context.select("query_id", "item_id", F.col("source_rank").alias("rank")), gold, cuts)


def answer_errors(responses: DataFrame) -> DataFrame:
    """Broken contracts of responses: response_id and errors.

    responses: response_id, status, n_claims, n_citations, markers (array of long), named and cited (arrays of evidence
    ids).  An abstention has neither claims nor citations, and nothing else of it is looked at; markers run from 1 without
    a gap; what claims name is what is cited.
    """
    quiet = F.col("status") == "insufficient_evidence"
    empty = F.array_compact(F.array(F.when(F.col("n_claims") > 0, "abstention_with_claims"), F.when(F.col("n_citations") > 0, "abstention_with_citations")))
    run = F.sequence(F.lit(1).cast("long"), F.greatest(F.size("markers"), F.lit(1)).cast("long"))
    full = F.array_compact(
        F.array(
            F.when(~F.col("status").isin("answered", "insufficient_evidence") | F.col("status").isNull(), "unknown_status"),
            F.when(F.col("n_claims") == 0, "answer_without_claims"),
            F.when(F.col("n_citations") != F.size("markers"), "citation_count"),
            F.when((F.size("markers") > 0) & (F.array_sort("markers") != run), "marker_run"),
            F.when(F.size(F.array_except("named", "cited")) > 0, "claim_not_cited"),
            F.when(F.size(F.array_except("cited", "named")) > 0, "citation_without_claim"),
            F.when(F.size("cited") != F.size(F.array_distinct("cited")), "repeated_citation"),
        )
    )
    return responses.select("response_id", F.when(quiet, empty).otherwise(full).alias("errors"))


def semantic_scores(labels: DataFrame) -> DataFrame:
    """Completeness and relevance of each question from labels (query_id, kind, label).

    Points are covered (1), partial (a half) or missing; relevance is labelled 0, 1 or 2.  Null without labels of a kind.
    """
    point, rated = F.col("kind") == "point", F.col("kind") == "relevance"
    worth = F.when(F.col("label") == "covered", 1.0).when(F.col("label") == "partial", 0.5).otherwise(0.0)
    sums = labels.groupBy("query_id").agg(F.count_if(point).alias("points"), F.avg(F.when(point, worth)).alias("c"), (F.avg(F.when(rated, F.col("label").try_cast("double"))) / 2).alias("r"))
    return sums.select("query_id", "points", F.round("c", 6).alias("completeness"), F.round("r", 6).alias("relevance"))


def label_errors(labels: DataFrame, questions: DataFrame) -> DataFrame:
    """Faults of labels (query_id, kind, label): of no known question, outside the kind's domain, or given twice."""
    known = labels.join(questions.select("query_id", F.lit(True).alias("known")).distinct(), "query_id", "left")
    domain = F.when(F.col("kind") == "point", F.col("label").isin("covered", "partial", "missing")).when(F.col("kind") == "relevance", F.col("label").isin("0", "1", "2")).otherwise(False)
    code = F.when(F.col("known").isNull(), "unknown_question").when(~F.coalesce(domain, F.lit(False)), "label_outside_domain")
    doubled = labels.groupBy("query_id", "kind").count().filter("kind = 'relevance' and count > 1").select("query_id", "kind", F.lit("label_given_twice").alias("code"))
    return known.select("query_id", "kind", code.alias("code")).filter("code is not null").unionByName(doubled)


def golden(specs: DataFrame, elements: DataFrame) -> DataFrame:
    """Whether expectations hold: specs (spec_id, doc_id, kind, match, wanted, exact_case, expected count) against elements.

    Elements of the document and kind are counted whose text matches; an expectation without any element counts 0.
    """
    from tessera.functions.markers import text_match

    met = specs.join(elements.select("doc_id", "kind", "place", "text"), ["doc_id", "kind"], "left")
    hit = F.coalesce(text_match(F.col("text"), F.col("match"), F.col("wanted"), F.col("exact_case")), F.lit(False))
    counts = met.groupBy("spec_id", "expected").agg(F.count_if(hit).alias("found"))
    return counts.select("spec_id", "expected", "found", (F.col("expected") == F.col("found")).alias("passed"))


def failure_flags(scores: DataFrame, wanted: str | None = None) -> DataFrame:
    """query_id and flags of scores (hit_1, hit_10, complete_10, rr); with `wanted`, only rows that have that flag."""
    flags = F.array_compact(F.array(F.when(F.col("hit_10") == 0, "missed"), F.when((F.col("hit_10") > 0) & (F.col("hit_1") == 0), "late"), F.when(F.col("complete_10") == 0, "incomplete"), F.when(F.col("rr") < 0.5, "low_rank")))
    found = scores.select("query_id", flags.alias("flags"))
    return found.filter(F.array_contains("flags", wanted)) if wanted else found


def variants(runs: DataFrame) -> DataFrame:
    """Averages of an experiment's runs (variant, query_id, union_size, reciprocal_rank) for each variant."""
    return runs.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("union_size"), 6).alias("union_size"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


def split_allowed(split: str, frozen: bool, confirmation: str | None, token: str) -> bool:
    """Whether a split may be scored: the held-out one needs a frozen configuration and the exact confirmation."""
    if split not in ("dev", "heldout"):
        raise ValueError(f"no such split: {split}")
    return split == "dev" or (frozen and confirmation == token)
