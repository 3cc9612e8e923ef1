"""Structure of documents from their elements: roles, headings, outline, appendices, clauses, logical tables, confidence.

elements: doc_id, place (order in the document, unique there), page, kind, text, x0, y0, x1, y1 and font; what a function
reads beyond these is named in its docstring.  Every step is a window or an aggregate over a document or page, so a plan
shuffles elements by document; none pairs all elements of a page.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns, words, kinds and bounds that decide the results.
APPENDIX = r"(?i)^\s*APPENDIX\s+([A-Z0-9IVXLC]+)\s*$"
MAJOR = r"(?i)^\s*(?:PART|CHAPTER|BOOK|DIVISION)\s+[A-Z0-9IVXLC]+(?:\s*[:.-]|\s+)"
NUMBERED = r"(?i)^\s*(?:(?:section|chapter)\s+)?(\d+(?:\.\d+){0,5})(?:[.)])?(?=\s|[A-Za-z])\s*"
DECIMAL = r"^\s*(\d+(?:\.\d+){1,5})(?=[\sA-Za-z])"
CLAUSE_START = r"(?i)^\s*(?:\d+(?:\s*[A-Z])?\.\d+(?:\.\d+){0,4}(?:[A-Z](?=\s))?(?=\s|[A-Za-z])|\d+[.)](?=\s|[A-Za-z]))"
FOOTNOTE_MARK = r"^\s*(?:[¹²³⁴⁵⁶⁷⁸⁹⁰]+|\d+[.)]?|[*†‡])\s*"
MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE = rf"(?i)\b(?:\d{{1,2}}\s+{MONTH}\s+\d{{4}}|{MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}|version\s+\d+(?:\.\d+)*)\b"
META_WORD = r"(?i)\b(?:issued|revised|updated|effective|published|version|last\s+updated|as\s+of)\b"
DECORATIONS = ("page_header", "page_footer", "footnote", "caption", "document_metadata")
HEADINGS = ("section_header", "title", "subtitle")
APPENDIX_TITLES = ("section_header", "group_header", "subtitle", "title", "paragraph")
UNPLACED = ("page_header", "page_footer", "title", "subtitle", "document_metadata", "unknown")
DEEPEST_LEVEL, LOOKED_AHEAD, SAME_TITLE = 6, 5, 0.94
TABLE_BOTTOM, TABLE_TOP, TABLE_SIDES, LEAST_SIDE = 0.72, 0.30, 0.055, 18.0


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _by_doc() -> Window:
    return Window.partitionBy("doc_id").orderBy("place")


def structural_text(text: Column) -> Column:
    """Blanks after the number that a text begins with: `3.1Unless` gets one; `11.6 A A report` is number 11.6A."""
    own_suffix = F.regexp_replace(text, r"^(\s*\d+(?:\.\d+){1,5})\s+([A-Z])\s+(?=\2\s+)", "$1$2 ")
    article = F.regexp_replace(own_suffix, r"^(\s*\d+(?:\.\d+){1,5})A(?=\s+[a-z])", "$1 A")
    spaced = F.regexp_replace(article, r"^(\s*\d+(?:\.\d+){0,5}[.)]?)(?=[A-Za-z])", "$1 ")
    return F.when(article.rlike(r"^\s*\d+(?:\.\d+){1,5}[A-Z]\s+"), article).otherwise(spaced)


def outline_number(text: Column) -> Column:
    """Decimal number of a heading's text, null without one."""
    return F.nullif(F.regexp_extract(text, NUMBERED, 1), F.lit(""))


def title_key(text: Column) -> Column:
    """Lower-case words and periods of a heading, by which titles are compared."""
    words = F.regexp_replace(F.lower(text), r"(?U)[^\w\s.]", " ")
    return F.btrim(F.regexp_replace(words, r"\s+", " "), F.lit(" ."))


def question(text: Column) -> Column:
    """Whether a text ends like a question, or is a numbered one that holds a question mark."""
    return F.trim(text).rlike(r"\?$") | F.trim(text).rlike(r"(?i)^(?:q(?:uestion)?\s*)?\d+\s*[.)][^?]*\?")


def document_roles(elements: DataFrame, width: float, height: float) -> DataFrame:
    """doc_id, place and role of elements: document_metadata, title and subtitle on page 1; section_header for all other titles.

    A title is the first element that the layout calls so, else the first centred heading without a number; a subtitle
    follows within an eighth of the page.  What has no role here is not returned.
    """
    on_first = elements.filter("page = 1").withColumn("text", _text()).withColumn("n", F.length(F.regexp_replace(F.trim("text"), r"\s+", " ")))
    sized = Window.partitionBy("doc_id", F.col("font") > 0)
    middle = F.when((F.col("font") > 0) & (F.row_number().over(sized.orderBy("font", "place")) == F.floor(F.count("*").over(sized) / 2) + 1), F.col("font"))
    on_first = on_first.withColumn("middle", middle).withColumn("median", F.coalesce(F.max("middle").over(Window.partitionBy("doc_id")), F.lit(0.0)))
    large = (F.col("kind") == "paragraph") & (F.col("font") >= F.greatest(F.lit(16.0), 1.45 * F.col("median")))
    heads = on_first.filter((F.col("kind").isin("title", "section_header") | large) & (F.trim("text") != "") & (F.col("y0") <= 0.32 * height))
    meta = (F.col("n") <= 240) & F.col("text").rlike(META_WORD) & (F.col("text").rlike("[:;]") | F.col("text").rlike(DATE))
    plain = (F.abs((F.col("x0") + F.col("x1")) / 2 - width / 2) <= 0.16 * width) & outline_number(F.col("text")).isNull() & ~question(F.col("text"))
    marked = heads.withColumn("meta", meta).withColumn("plain", plain)
    high = F.when(F.col("kind") == "paragraph", 0.45 * height).otherwise(0.24 * height)
    rank = F.when(F.col("meta"), None).when(F.col("kind") == "title", 0).when(F.col("plain") & (F.col("n") <= 240) & (F.col("y0") <= high), 1)
    whole = Window.partitionBy("doc_id")
    chosen = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "place", "y1"))).over(whole)
    titled = marked.withColumn("rank", rank).withColumn("t", chosen)
    below = (F.col("y0") >= F.col("t.y1") - 3) & (F.col("y0") - F.col("t.y1") <= 0.12 * height)
    follows = F.col("kind").isin("title", "section_header") & ~F.col("meta") & F.col("plain") & (F.col("place") > F.col("t.place")) & below & (F.col("n") <= 180)
    sub = F.min(F.when(follows, F.col("place"))).over(whole)
    role = F.when(F.col("meta"), "document_metadata").when(F.col("place") == F.col("t.place"), "title").when(F.col("place") == F.col("sub"), "subtitle")
    found = titled.withColumn("sub", sub).select("doc_id", "place", role.alias("role")).filter("role is not null")
    joined = elements.select("doc_id", "place", "kind").join(found, ["doc_id", "place"], "left")
    return joined.select("doc_id", "place", F.coalesce("role", F.when(F.col("kind") == "title", "section_header")).alias("role")).filter("role is not null")


def repeated_titles(elements: DataFrame, titles: DataFrame, height: float) -> DataFrame:
    """Headings near the top of pages 2 to 6 that repeat their document's title: doc_id, place.  titles: doc_id, title."""
    heads = elements.filter((F.col("kind") == "section_header") & F.col("page").between(2, 6) & (F.col("y0") <= 0.22 * height))
    heads = heads.filter(outline_number(F.col("text")).isNull() & ~F.col("text").rlike(APPENDIX))
    met = heads.select("doc_id", "place", title_key(F.col("text")).alias("a")).join(titles.select("doc_id", title_key(F.col("title")).alias("b")), "doc_id")
    words = lambda c: F.array_distinct(F.split(c, " "))
    near = F.size(F.array_intersect(words("a"), words("b"))) / F.size(F.array_union(words("a"), words("b"))) >= SAME_TITLE
    return met.filter((F.col("a") != "") & (F.col("b") != "") & ((F.col("a") == F.col("b")) | near)).select("doc_id", "place")


def footer_headings(elements: DataFrame) -> DataFrame:
    """Footers that are numbered headings, as one of the next body texts has a number below theirs: doc_id, place, number, text.

    At most LOOKED_AHEAD body texts up to the next page are looked at, and none beyond the next heading.
    """
    body = ~F.col("kind").isin(*DECORATIONS) & (F.trim("text") != "")
    known = elements.withColumn("text", structural_text(_text()))
    counted = known.withColumn("seen", F.count_if(body).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0)))
    fact = F.struct(F.col("seen").alias("at"), "page", F.regexp_extract("text", DECIMAL, 1).alias("number"), F.col("kind").isin(*HEADINGS).alias("heading"))
    ahead = F.collect_list(F.when(body, fact)).over(Window.partitionBy("doc_id").orderBy("seen").rangeBetween(1, LOOKED_AHEAD))
    number = outline_number(F.col("text"))
    rest = F.size(F.split(F.trim(F.regexp_replace("text", NUMBERED, "")), r"\s+"))
    footers = counted.withColumn("ahead", ahead).withColumn("number", number).filter((F.col("kind") == "page_footer") & F.col("number").contains(".") & rest.between(2, 18))
    near = F.filter("ahead", lambda x: x["page"] <= F.col("page") + 1)
    child = F.array_min(F.transform(F.filter(near, lambda x: x["number"].startswith(F.concat("number", F.lit(".")))), lambda x: x["at"]))
    heading = F.array_min(F.transform(F.filter(near, lambda x: x["heading"]), lambda x: x["at"]))
    return footers.filter(child.isNotNull() & (heading.isNull() | (child <= heading))).select("doc_id", "place", "number", "text")


def footnotes(elements: DataFrame, width: float, height: float) -> DataFrame:
    """doc_id and place of footers and lowest paragraphs that are footnotes by width, mark and size."""
    sized = F.when(~F.col("kind").isin("page_header", "page_footer") & (F.col("font") > 0), F.col("font"))
    known = elements.withColumn("median", F.median(sized).over(Window.partitionBy("doc_id", "page"))).withColumn("text", F.trim(F.regexp_replace(_text(), r"\s+", " ")))
    wide, mark = F.col("x1") - F.col("x0") >= 0.55 * width, F.col("text").rlike(FOOTNOTE_MARK)
    small = F.coalesce((F.col("font") <= 10.2) | (F.col("font") <= F.col("median") - 0.8), F.lit(False))
    footer = (F.col("kind") == "page_footer") & (mark | small)
    low = (F.col("kind") == "paragraph") & (F.col("y0") >= 0.84 * height) & mark & small
    return known.filter((F.length("text") >= 24) & ~F.col("text").rlike("^[0-9]+$") & wide & (footer | low)).select("doc_id", "place")


def without_contents(elements: DataFrame, contents: DataFrame) -> DataFrame:
    """elements whose headings on pages of contents (doc_id, page) are of kind unknown."""
    listed = elements.join(contents.select("doc_id", "page", F.lit(True).alias("listed")).distinct(), ["doc_id", "page"], "left")
    kind = F.when(F.col("listed") & F.col("kind").isin(*HEADINGS), "unknown").otherwise(F.col("kind"))
    return listed.withColumn("kind", kind).drop("listed")


def heading_levels(elements: DataFrame, rooted: bool = False) -> DataFrame:
    """doc_id, place, level and level_source (numbering, pdf_toc, font_rank, unknown) of section headers.

    elements also has toc_level, the level of the heading in the file's own contents, or null.  Headings with neither
    number nor entry rank by size of font among themselves.  rooted: a title stands above all.
    """
    top = int(rooted)
    heads = elements.filter("kind = 'section_header'").withColumn("text", _text())
    number = outline_number(F.col("text"))
    by = F.when(F.col("text").rlike(APPENDIX) | F.col("text").rlike(MAJOR), "major").when(F.col("toc_level").isNotNull(), "pdf_toc").when(number.isNotNull(), "numbering").when(F.col("font") > 0, "font_rank").otherwise("unknown")
    ranked = heads.withColumn("by", by).withColumn("rank", F.dense_rank().over(Window.partitionBy("doc_id", "by").orderBy(F.desc(F.round("font", 1)))))
    level = F.when(F.col("by") == "pdf_toc", F.col("toc_level") + top).when(F.col("by") == "numbering", F.size(F.split(number, r"\.")) + top).when(F.col("by") == "font_rank", F.col("rank") + top)
    level = F.when(F.col("by") == "major", 1).when(F.col("by") != "unknown", F.least(level, F.lit(DEEPEST_LEVEL)))
    return ranked.select("doc_id", "place", level.cast("int").alias("level"), F.when(F.col("by") == "major", "numbering").otherwise(F.col("by")).alias("level_source"))


class _Outline:
    """Parents of one document's headings, as they come: numbers hang from their longest known prefix, others by level."""

    def __init__(self) -> None:
        self.major: tuple[int, int] | None = None
        self.appendix = False
        self.numbers: dict[str, tuple[int, int | None]] = {}
        self.latest: str | None = None
        self.open: list[tuple[int, int | None]] = []

    def _under(self, at: int, level: int | None, above: tuple[int, int | None] | None) -> tuple[int | None, int | None]:
        if above is None:
            return None, level
        return above[0], level if above[1] is None else min(above[1] + 1, DEEPEST_LEVEL)

    def put(self, at: int, kind: str, number: str | None, level: int | None) -> tuple[int | None, int | None]:
        """Place of the heading's parent (None for a root) and the heading's level in the tree."""
        if kind in ("appendix", "major"):
            self.major = (at, level or 1)
            self.appendix, self.numbers, self.latest, self.open = kind == "appendix", {}, None, [self.major]
            return None, self.major[1]
        if number is not None:
            prefixes = (number.rsplit(".", cut)[0] for cut in range(1, number.count(".") + 1))
            above = next((self.numbers[p] for p in prefixes if p in self.numbers), self.major)
            parent, level = self._under(at, level, above)
            self.numbers[number], self.latest = (at, level), number
            while self.open and self.open[-1][0] != parent:
                self.open.pop()
            if above is not None and not self.open:
                self.open.append(above)
            self.open.append((at, level))
            return parent, level
        if self.appendix:
            owner = self.numbers[self.latest] if self.latest and self.latest.endswith(".0") else self.major
            return self._under(at, level, owner)
        if level is None:
            self.open = []
            return None, None
        while self.open and (self.open[-1][1] is None or self.open[-1][1] >= level):
            self.open.pop()
        parent = self.open[-1][0] if self.open else None
        self.open.append((at, level))
        return parent, level


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headings come by document and place; a document may span batches, and only its outline is kept between them."""
    doc, outline = object(), _Outline()
    for batch in batches:
        parents, levels = [], []
        for d, *heading in zip(*(batch[c].to_pylist() for c in ("doc_id", "place", "type", "number", "level")), strict=True):
            if d != doc:
                doc, outline = d, _Outline()
            parent, level = outline.put(*heading)
            parents.append(parent)
            levels.append(level)
        columns = [batch["doc_id"], batch["place"], pa.array(parents, pa.int32()), pa.array(levels, pa.int32()), batch["type"]]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "parent", "level", "type"])


def outline(elements: DataFrame, levels: DataFrame) -> DataFrame:
    """Sections of headings: doc_id, place, parent (place of the heading above, null for a root), level, type.

    levels as heading_levels gives them; type is appendix, major, question or section.  Numbers hang from the longest
    prefix of theirs that the same part or appendix has; an appendix holds its unnumbered headings directly.
    """
    heads = elements.filter("kind = 'section_header'").withColumn("text", _text()).join(levels.select("doc_id", "place", "level"), ["doc_id", "place"], "left")
    kind = F.when(F.col("text").rlike(APPENDIX), "appendix").when(F.col("text").rlike(MAJOR), "major").when(question(F.col("text")), "question").otherwise("section")
    number = outline_number(structural_text(F.col("text")))
    rows = heads.select("doc_id", F.col("place").cast("int").alias("place"), kind.alias("type"), number.alias("number"), F.col("level").cast("int").alias("level"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, place int, parent int, level int, type string"
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "place").mapInArrow(_outlines, schema)


def section_contents(elements: DataFrame) -> DataFrame:
    """Each heading with the elements up to the next: doc_id, section (its place; null before the first), elements, first, last."""
    section = F.last(F.when(F.col("kind") == "section_header", F.col("place")), ignorenulls=True).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0))
    placed = elements.withColumn("section", section).filter(~F.col("kind").isin(*UNPLACED, "section_header"))
    return placed.groupBy("doc_id", "section").agg(F.count("*").alias("elements"), F.min("place").alias("first"), F.max("place").alias("last"))


def appendices(elements: DataFrame) -> DataFrame:
    """doc_id, label (place), name, title (place or null), start_page, end_page and elements of each appendix.

    An appendix goes up to the next label; its title is the first heading or paragraph after the label, on the same page,
    that is neither a label nor numbered.
    """
    is_label = (F.col("kind") == "section_header") & _text().rlike(APPENDIX)
    marked = elements.withColumn("own", F.when(is_label, F.struct("place", "page", F.upper(F.regexp_extract("text", APPENDIX, 1)).alias("name"))))
    known = marked.withColumn("label", F.last("own", ignorenulls=True).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0)))
    known = known.withColumn("pages", F.max("page").over(Window.partitionBy("doc_id"))).filter("label is not null")
    title = ~is_label & (F.col("page") == F.col("label.page")) & F.col("kind").isin(*APPENDIX_TITLES) & ~_text().rlike(CLAUSE_START) & ~_text().rlike(APPENDIX)
    parts = known.groupBy("doc_id", "label").agg(F.min(F.when(title, F.col("place"))).alias("title"), F.max("pages").alias("pages"), F.count("*").alias("elements"))
    follows = F.lead("label.page").over(Window.partitionBy("doc_id").orderBy("label.place"))
    end = F.greatest(F.col("label.page"), F.coalesce(follows - 1, F.col("pages")))
    return parts.select("doc_id", F.col("label.place").alias("label"), F.col("label.name").alias("name"), "title", F.col("label.page").alias("start_page"), end.alias("end_page"), "elements")


def logical_tables(elements: DataFrame, width: float, height: float) -> DataFrame:
    """Fragments of tables with the table they belong to: doc_id, place, table (place of its first fragment), nth, rows_kept.

    elements also has section, appendix, cols, rows and header (its first row as one text), null for what is no table.  A
    fragment goes on from one that ends low on the page before, if it stands highest and first on its page and has the same
    columns, sides, section and appendix; a repeated header counts once.  Only the highest table of a page goes on from
    another, and only one fragment goes on to it, so chains are runs of pages and need no recursion.
    """
    substantial = ~F.col("kind").isin("page_header", "page_footer", "document_metadata") & (F.trim(_text()) != "")
    on_page = Window.partitionBy("doc_id", "page")
    tables = elements.withColumn("highest", F.min(F.when(substantial, F.col("y0"))).over(on_page)).filter("kind = 'table' and cols is not null")
    tables = tables.withColumn("top", F.min(F.struct("y0", "place")).over(on_page)["place"] == F.col("place"))
    traits = ["cols", "x0", "x1", "section", "appendix"]
    after = tables.filter(F.col("top") & (F.col("y0") <= TABLE_TOP * height) & (F.coalesce("highest", "y0") >= F.col("y0")))
    after = after.select("doc_id", (F.col("page") - 1).alias("page"), F.col("place").alias("next"), *(F.col(c).alias(f"n_{c}") for c in traits))
    side = max(LEAST_SIDE, TABLE_SIDES * width)
    alike = (F.col("cols") == F.col("n_cols")) & (F.abs(F.col("x0") - F.col("n_x0")) <= side) & (F.abs(F.col("x1") - F.col("n_x1")) <= side)
    alike &= F.col("appendix").eqNullSafe(F.col("n_appendix")) & F.coalesce(F.col("section") == F.col("n_section"), F.lit(True))
    links = tables.filter(F.col("y1") >= TABLE_BOTTOM * height).join(after, ["doc_id", "page"]).filter(alike).select("doc_id", "next", F.col("place").alias("before"), "top")
    reached = links.select("doc_id", F.col("next").alias("before"), F.lit(True).alias("reached")).distinct()
    ordered = links.join(reached, ["doc_id", "before"], "left").withColumn("own", ~F.coalesce(F.col("reached"), F.lit(False)))
    chosen = ordered.groupBy("doc_id", F.col("next").alias("place")).agg(F.min(F.struct("own", "before", "top")).alias("b"))
    linked = tables.join(chosen, ["doc_id", "place"], "left")
    start = F.when(F.col("b").isNull(), F.col("place")).when(~F.col("b.top"), F.col("b.before"))
    tops = F.last(start, ignorenulls=True).over(Window.partitionBy("doc_id", "top").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    chained = linked.withColumn("table", F.when(F.col("top"), tops).otherwise(F.col("place")))
    chain = Window.partitionBy("doc_id", "table").orderBy("page", "place")
    again = (F.row_number().over(chain) > 1) & F.col("header").eqNullSafe(F.first("header").over(chain))
    return chained.select("doc_id", "place", "page", "table", F.row_number().over(chain).alias("nth"), (F.col("rows") - again.cast("int")).alias("rows_kept"), "cols")


def table_records(fragments: DataFrame) -> DataFrame:
    """One row a logical table from logical_tables: doc_id, table, fragments, start_page, end_page, n_rows, n_cols."""
    return fragments.groupBy("doc_id", "table").agg(F.count("*").alias("fragments"), F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.sum("rows_kept").alias("n_rows"), F.max("cols").alias("n_cols"))


def table_continuations(fragments: DataFrame) -> DataFrame:
    """`continues` edges between the fragments of a logical table: doc_id, source, target."""
    after = F.lead("place").over(Window.partitionBy("doc_id", "table").orderBy("nth"))
    return fragments.select("doc_id", F.col("place").alias("source"), after.alias("target")).filter("target is not null")


def edited_relations(relations: DataFrame, added: DataFrame, removed: DataFrame, elements: DataFrame) -> DataFrame:
    """Edges (doc_id, kind, source, target) after edits by hand, which may only touch `continues`.

    Added edges have to point forward between elements that exist; a removal of an edge that isn't there changes nothing,
    and one that is both added and removed is gone.
    """
    edge = ["doc_id", "kind", "source", "target"]
    known = lambda c: elements.select("doc_id", F.col("place").alias(c)).distinct()
    fit = added.select(*edge).filter("kind = 'continues' and target > source").join(known("source"), ["doc_id", "source"], "left_semi").join(known("target"), ["doc_id", "target"], "left_semi")
    gone = removed.select(*edge).filter("kind = 'continues'")
    return relations.select(*edge).unionByName(fit.select(*edge)).distinct().join(gone, edge, "left_anti").select(*edge)


def calibrated(elements: DataFrame, relations: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, place and confidence of elements, lowered where the structure leaves them without an owner.

    elements also has confidence and listed (whether a list item was told by its sequence); relations: doc_id, kind, source,
    target; sections: doc_id, place, parent, type, as outline gives them.  List items that nothing introduces or owns keep
    0.62 at most; group headers without an introduction or an appendix's label, and empty sections without parts, 0.60.
    """
    label = elements.filter(_text().rlike(APPENDIX)).select("doc_id", F.col("place").alias("target"), F.lit(True).alias("labels"))
    edges = relations.filter("kind in ('introduces', 'parent_of', 'belongs_to')").join(label, ["doc_id", "target"], "left")
    owned = F.array(F.struct(F.col("target").alias("place"), F.concat("kind", F.lit("_in")).alias("role")), F.struct(F.col("source").alias("place"), F.when((F.col("kind") != "belongs_to") | F.col("labels"), F.concat("kind", F.lit("_out"))).alias("role")))
    roles = edges.select("doc_id", F.inline(owned)).groupBy("doc_id", "place").agg(F.collect_set("role").alias("roles"))
    parents = sections.filter("parent is not null").select("doc_id", F.col("parent").alias("place"), F.lit(True).alias("has_parts")).distinct()
    contents = section_contents(elements).filter("section is not null").select("doc_id", F.col("section").alias("place"), F.lit(True).alias("filled"))
    empty = sections.filter("type = 'section'").select("doc_id", "place").join(parents, ["doc_id", "place"], "left_anti").join(contents, ["doc_id", "place"], "left_anti").withColumn("empty", F.lit(True))
    known = elements.join(roles, ["doc_id", "place"], "left").join(empty, ["doc_id", "place"], "left")
    has = lambda *names: F.coalesce(F.arrays_overlap("roles", F.array(*map(F.lit, names))), F.lit(False))
    ceiling = (
        F.when((F.col("kind") == "list_item") & F.col("listed") & ~has("introduces_in", "parent_of_in"), 0.62)
        .when((F.col("kind") == "group_header") & ~has("introduces_in", "introduces_out", "belongs_to_out"), 0.60)
        .when(F.col("empty"), 0.60)
    )
    return known.select("doc_id", "place", F.least("confidence", ceiling).alias("confidence"))


def nested_subclauses(elements: DataFrame) -> DataFrame:
    """doc_id, place, family and parent (place, or null) of subclauses, which also have mark (`a`, `iv`) and section.

    All stand under the last clause of their section; Roman marks go under the last letter of that clause if they are longer
    than one sign, `i`, or set 6 units further in.  A single i, v, x, l, c, d or m is Roman beside a longer Roman mark; else a
    letter beside its neighbour in the alphabet; else Roman where it is set 10 units further in than a plain letter before it.
    """
    from tessera.functions.markers import roman_value

    upto = Window.partitionBy("doc_id", "section").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    known = elements.withColumn("top", F.last(F.when(F.col("kind") == "clause", F.col("place")), ignorenulls=True).over(upto)).filter("kind = 'subclause'")
    group = Window.partitionBy("doc_id", "section", "top").orderBy("place")
    signs = known.withColumn("m", F.lower("mark")).withColumn("letter", F.when(F.col("m").rlike("^[a-z]$"), F.ascii("m"))).withColumn("long", (F.length("m") > 1) & roman_value(F.col("m")).isNotNull())
    told = signs.withColumns({f"{side}_{c}": shift(c).over(group) for side, shift in (("b", F.lag), ("a", F.lead)) for c in ("m", "letter", "long", "x0")})
    yes = lambda c: F.coalesce(c, F.lit(False))
    plain = ~F.col("b_m").rlike("^[ivxlcdm]$") & F.col("b_letter").isNotNull()
    family = (
        F.when(yes(F.col("long")), "roman")
        .when(F.col("letter").isNull(), None)
        .when(~F.col("m").rlike("[ivxlcdm]"), "alpha")
        .when(yes(F.col("b_long")) | yes(F.col("a_long")), "roman")
        .when(yes(F.col("b_letter") + 1 == F.col("letter")) | yes(F.col("a_letter") - 1 == F.col("letter")), "alpha")
        .when(yes(plain & (F.col("x0") - F.col("b_x0") >= 10)), "roman")
        .otherwise("alpha")
    )
    alpha = F.last(F.when(F.col("family") == "alpha", F.struct("place", "x0")), ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, -1))
    nested = (F.col("family") == "roman") & (yes(F.col("long")) | (F.col("m") == "i") | (F.col("x0") - F.col("alpha.x0") >= 6))
    parent = F.when(F.col("top").isNotNull() & yes(nested & F.col("alpha").isNotNull()), F.col("alpha.place")).otherwise(F.col("top"))
    return told.withColumn("family", family).withColumn("alpha", alpha).select("doc_id", "place", "family", parent.alias("parent"))


def document_titles(documents: DataFrame, roles: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, title and title_source of documents (doc_id, metadata_title, filename): the title element, the file's own, its name.

    Further columns of documents pass, between doc_id and title.
    """
    found = roles.filter("role = 'title'").join(elements.select("doc_id", "place", "text"), ["doc_id", "place"]).select("doc_id", F.nullif(F.trim("text"), F.lit("")).alias("t"))
    joined = documents.join(found, "doc_id", "left")
    own = F.nullif(F.trim("metadata_title"), F.lit(""))
    stem = F.regexp_replace(F.regexp_replace("filename", "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    source = F.when(F.col("t").isNotNull(), "element").when(own.isNotNull(), "metadata").otherwise("filename")
    passed = [c for c in documents.columns if c not in ("doc_id", "metadata_title", "filename")]
    return joined.select("doc_id", *passed, F.coalesce("t", own, stem).alias("title"), source.alias("title_source"))
