"""Elements of documents: geometry, margins, neighbours, cleaning decisions, sections and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of a page's height above and below which a text stands in the margin; sides on which a repeat counts.
MARGIN, LEAST_PAGES, LONGEST = 0.12, 3, 220
BOX = ("x0", "y0", "x1", "y1")


def area(box: dict[str, Column]) -> Column:
    """Area of a box; 0 if it is turned inside out."""
    return F.greatest(box["x1"] - box["x0"], F.lit(0.0)) * F.greatest(box["y1"] - box["y0"], F.lit(0.0))


def shared(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """The box that two boxes have in common."""
    return {"x0": F.greatest(a["x0"], b["x0"]), "y0": F.greatest(a["y0"], b["y0"]), "x1": F.least(a["x1"], b["x1"]), "y1": F.least(a["y1"], b["y1"])}


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Common area by the smaller of two boxes' areas; 0 if one of them is empty."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, area(shared(a, b)) / smaller).otherwise(0.0)


def side_overlap(a: dict[str, Column], b: dict[str, Column], axis: str) -> Column:
    """Common length of two boxes along x or y by the smaller one's length; 0 if one has none."""
    low, high = f"{axis}0", f"{axis}1"
    smaller = F.least(a[high] - a[low], b[high] - b[low])
    return F.when(smaller > 0, F.greatest(F.least(a[high], b[high]) - F.greatest(a[low], b[low]), F.lit(0.0)) / smaller).otherwise(0.0)


def box(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in BOX}


def page_overlaps(elements: DataFrame, reach: int = 1) -> DataFrame:
    """Each element against the next `reach` of its page: doc_id, place, other, overlap, across and down."""
    order = Window.partitionBy("doc_id", "page").orderBy("place")
    found = None
    for k in range(1, reach + 1):
        after = elements.select("doc_id", "place", *BOX, F.lead("place", k).over(order).alias("other"), *(F.lead(c, k).over(order).alias(f"n_{c}") for c in BOX)).filter("other is not null")
        row = after.select("doc_id", "place", "other", overlap(box(), box("n_")).alias("overlap"), side_overlap(box(), box("n_"), "x").alias("across"), side_overlap(box(), box("n_"), "y").alias("down"))
        found = row if found is None else found.unionByName(row)
    return found


def margin_repeats(elements: DataFrame, height: float) -> DataFrame:
    """Texts that stand in the top or bottom margin of LEAST_PAGES or more pages of a document: doc_id, text, pages."""
    inside = (F.length("text") > 0) & (F.length("text") <= LONGEST) & ((F.col("y1") <= MARGIN * height) | (F.col("y0") >= (1 - MARGIN) * height))
    return elements.filter(inside).groupBy("doc_id", "text").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)


def neighbours(elements: DataFrame, skipped: Column) -> DataFrame:
    """doc_id, place, before and after: the nearest places of the document that aren't skipped."""
    kept = F.when(~skipped, F.col("place"))
    window = Window.partitionBy("doc_id").orderBy("place")
    before = F.last(kept, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(kept, ignorenulls=True).over(window.rowsBetween(1, Window.unboundedFollowing))
    return elements.select("doc_id", "place", before.alias("before"), after.alias("after"))


def sections(elements: DataFrame) -> DataFrame:
    """elements with section, the place of the last section header up to each, null before the first."""
    upto = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumn("section", F.last(F.when(F.col("kind") == "section_header", F.col("place")), ignorenulls=True).over(upto))


#: The order in which the rules of cleaning are tried; those that leave an element as context only.
CONTEXT_ONLY = ("figure_shell", "section_header")


def cleaning(elements: DataFrame, repeats: DataFrame, navigation: DataFrame, footnotes: bool = False, metadata: bool = False) -> DataFrame:
    """decision (include, context, exclude) and reason of each element; the first rule that holds decides.

    elements: doc_id, place, page, kind, text, section and figure_text; repeats of margin_repeats; navigation: doc_id and
    page or section of what only lists the document's parts.  Texts meet only those of their own document.
    """
    first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("place"))
    known = elements.withColumn("nth", first)
    known = known.join(repeats.select("doc_id", "text", F.lit(True).alias("repeats")), ["doc_id", "text"], "left")
    known = known.join(navigation.select("doc_id", "section", F.lit(True).alias("lists")).distinct(), ["doc_id", "section"], "left")
    kind = F.col("kind")
    rules = [
        (F.length("text") == 0, "empty_text"),
        ((F.col("nth") > 1) & (kind != "figure"), "duplicate"),
        (kind == "page_header", "page_header"),
        (kind == "page_footer", "page_footer"),
        (F.col("text").rlike(r"^(page )?[0-9]+( of [0-9]+)?$"), "page_number"),
        (F.col("repeats").isNotNull(), "repeated_margin"),
        (F.col("lists").isNotNull(), "navigation"),
        ((kind == "figure") & F.col("shell"), "figure_shell"),
        ((kind == "footnote") & F.lit(not footnotes), "footnote"),
        ((kind == "metadata") & F.lit(not metadata), "metadata"),
        ((kind == "figure") & (F.length("text") < 3), "textless_figure"),
        (kind == "section_header", "section_header"),
    ]
    reason = F.lit("retrieval_text")
    for condition, name in reversed(rules):
        reason = F.when(condition, name).otherwise(reason)
    decided = known.select("doc_id", "place", reason.alias("reason"))
    return decided.withColumn("decision", F.when(F.col("reason").isin(*CONTEXT_ONLY), "context").when(F.col("reason") == "retrieval_text", "include").otherwise("exclude"))


def clause_units(elements: DataFrame) -> DataFrame:
    """Units of clauses with the elements that follow them, up to the next structural boundary or section.

    elements: doc_id, place, kind, section.  Gives doc_id, unit (the first place), kind, members, elements.
    """
    window = Window.partitionBy("doc_id").orderBy("place")
    boundary = F.col("kind").isin("clause", "definition", "table", "figure", "section_header") | ~F.col("section").eqNullSafe(F.lag("section").over(window))
    follows = F.col("kind").isin("paragraph", "list_item", "subclause", "caption", "footnote")
    run = F.sum(F.when(boundary | ~follows | F.lag("place").over(window).isNull(), 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0))
    numbered = elements.withColumn("run", run)
    grouped = numbered.groupBy("doc_id", "run").agg(F.min_by("kind", "place").alias("kind"), F.min("place").alias("unit"), F.max("place").alias("last"), F.count("*").alias("members"))
    return grouped.select("doc_id", "unit", "kind", "last", "members")


def first_owners(members: DataFrame) -> DataFrame:
    """The first chunk (by chunk_index) that has an element: members (doc_id, chunk_index, place) to doc_id, place, chunk_index."""
    return members.groupBy("doc_id", "place").agg(F.min("chunk_index").alias("chunk_index"), F.count("*").alias("owners"))


def page_medians(elements: DataFrame) -> DataFrame:
    """Exact median of the positive font sizes of each page."""
    return elements.filter("font > 0").groupBy("doc_id", "page").agg(F.median("font").alias("font"))


def weighted_medians(elements: DataFrame, by: list[str]) -> DataFrame:
    """The font size at which half of a group's characters are reached."""
    sizes = elements.filter("font > 0").groupBy(*by, "font").agg(F.sum(F.greatest(F.length("text"), F.lit(1))).alias("weight"))
    running = F.sum("weight").over(Window.partitionBy(*by).orderBy("font").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("weight").over(Window.partitionBy(*by))
    return sizes.withColumn("running", running).withColumn("whole", whole).filter("2 * running >= whole").groupBy(*by).agg(F.min("font").alias("font"))


def captions_before(elements: DataFrame, kind: str) -> DataFrame:
    """Elements of a kind whose very predecessor on the same page is a caption: doc_id, place, caption."""
    window = Window.partitionBy("doc_id").orderBy("place")
    marked = elements.select("doc_id", "place", "kind", "page", F.lag("kind").over(window).alias("k"), F.lag("place").over(window).alias("caption"), F.lag("page").over(window).alias("p"))
    return marked.filter((F.col("kind") == kind) & (F.col("k") == "caption") & (F.col("p") == F.col("page")) & (F.col("caption") == F.col("place") - 1)).select("doc_id", "place", "caption")


def context_text(path: Column, definition: Column, clause: Column) -> Column:
    """Lines that say where a chunk stands; parts that are null or empty are left out."""
    lines = [F.when(F.size(path) > 0, F.concat(F.lit("Section: "), F.array_join(path, " > "))), *(F.when(F.length(c) > 0, F.concat(F.lit(f"{n}: "), c)) for n, c in (("Definition", definition), ("Clause", clause)))]
    return F.concat_ws("\n", *lines)


def budgets(chunks: DataFrame, most: int, least: int = 40) -> DataFrame:
    """Content budget and whether the context is kept, of chunks (tokens, context_tokens): index before empty ones are skipped.

    chunk_index counts all chunks of a document, also those without tokens, which are left out: numbers may have gaps.
    """
    numbered = chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1)
    budget = F.greatest(F.lit(least), F.lit(most) - F.col("context_tokens"))
    fits = F.col("tokens") + F.col("context_tokens") <= most
    return numbered.filter("tokens > 0").select("doc_id", "place", "chunk_index", budget.alias("budget"), fits.alias("with_context"), (F.col("tokens") > most).alias("over"))
