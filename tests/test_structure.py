import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, structure

ELEMENT = "doc_id long, place int, page int, kind string, text string, x0 double, y0 double, x1 double, y1 double, font double"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def headings(spark, *texts, levels=None):
    made = [(1, i, 1, "section_header", t, 50.0, 10.0 * i, 300.0, 10.0 * i + 8, (levels or {}).get(i, 12.0)) for i, t in enumerate(texts)]
    return spark.createDataFrame(made, ELEMENT).withColumn("toc_level", F.lit(None).cast("int"))


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("3.1Unless", "3.1 Unless"), ("3.DEFINITIONS", "3. DEFINITIONS"), ("11.6 A  A reporting", "11.6A A reporting"), ("11.8A reporting", "11.8 A reporting"), ("11.6A A reporting", "11.6A A reporting"), ("11.6 A company", "11.6 A company"), ("plain", "plain"), ("", "")],
)
def test_structural_text(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(structure.structural_text(F.col("t"))).collect()[0][0] == wanted


def test_outline_hangs_numbers_from_their_longest_known_prefix(spark):
    found = headings(spark, "PART I: General", "7 Rules", "7.3 Scope", "7.3.1 Reach", "7.4 Ends", "APPENDIX A", "7 Forms", "Notes", "4.0 Tables", "Marks", "PART II: More", "7.3 Again")
    got = {r.place: (r.parent, r.level, r.type) for r in structure.outline(found, structure.heading_levels(found)).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: None, 1: 0, 2: 1, 3: 2, 4: 1, 5: None, 6: 5, 7: 5, 8: 5, 9: 8, 10: None, 11: 10}
    assert [got[i][1] for i in (0, 1, 2, 3)] == [1, 2, 3, 4]
    assert (got[0][2], got[5][2]) == ("major", "appendix")


def test_outline_of_unnumbered_headings_goes_by_level(spark):
    found = headings(spark, "Big", "Small", "Tiny", "Small too", "Big too", levels={0: 20.0, 1: 14.0, 2: 10.0, 3: 14.0, 4: 20.0})
    assert rows(structure.outline(found, structure.heading_levels(found)), "place", "parent", "level") == [(0, None, 1), (1, 0, 2), (2, 1, 3), (3, 0, 2), (4, None, 1)]


def test_outline_of_many_documents_over_batches(spark):
    deep = 1500
    made = [(d, i, 1, "section_header", f"{i} A" if i % 3 == 0 else f"{i - i % 3}.{i % 3} B", 0.0, 0.0, 9.0, 9.0, 12.0) for d in (1, 2) for i in range(deep)]
    found = spark.createDataFrame(made, ELEMENT).withColumn("toc_level", F.lit(None).cast("int"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = rows(structure.outline(found, structure.heading_levels(found)), "doc_id", "place", "parent")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(d, i, None if i % 3 == 0 else i - i % 3) for d in (1, 2) for i in range(deep)]


def test_roles_of_the_first_page(spark):
    made = [
        (1, 0, 1, "section_header", "Version 2.1, issued 3 May 2020", 100.0, 10.0, 500.0, 30.0, 12.0),
        (1, 1, 1, "section_header", "1 Introduction", 100.0, 40.0, 500.0, 60.0, 14.0),
        (1, 2, 1, "section_header", "The Rules of Trade", 100.0, 70.0, 500.0, 90.0, 20.0),
        (1, 3, 1, "section_header", "A guide for members", 150.0, 100.0, 450.0, 120.0, 14.0),
        (1, 4, 1, "section_header", "Left aligned", 0.0, 130.0, 100.0, 150.0, 14.0),
        (1, 5, 2, "title", "Again", 100.0, 70.0, 500.0, 90.0, 20.0),
        (2, 0, 1, "paragraph", "Large words", 100.0, 10.0, 500.0, 40.0, 30.0),
        (2, 1, 1, "paragraph", "small words", 100.0, 60.0, 500.0, 90.0, 10.0),
        (2, 2, 1, "paragraph", None, 100.0, 100.0, 500.0, 130.0, 10.0),
        (3, 0, 1, "section_header", "Is this a question?", 100.0, 10.0, 500.0, 40.0, 30.0),
    ]
    found = spark.createDataFrame(made, ELEMENT)
    assert rows(structure.document_roles(found, 600.0, 800.0), "doc_id", "place", "role") == [(1, 0, "document_metadata"), (1, 2, "title"), (1, 3, "subtitle"), (1, 5, "section_header"), (2, 0, "title")]


def test_footers_with_a_child_behind_them_are_headings(spark):
    def doc(n, *kinds_and_texts):
        return [(n, i, page, kind, text, 0.0, 0.0, 9.0, 9.0, 9.0) for i, (kind, text, page) in enumerate(kinds_and_texts)]

    footer = ("page_footer", "3.1The common rules", 1)
    made = doc(1, footer, ("page_header", "x", 2), ("paragraph", "some", 2), ("clause", "3.1.2 These", 2))
    made += doc(2, footer, ("section_header", "New", 2), ("clause", "3.1.2 These", 2))
    made += doc(3, footer, ("clause", "3.1.2 These", 3))
    made += doc(4, footer, *[("paragraph", "p", 1)] * 5, ("clause", "3.1.2 These", 1))
    made += doc(5, footer, ("clause", "3.10.2 These", 1))
    assert rows(structure.footer_headings(spark.createDataFrame(made, ELEMENT)), "doc_id", "place", "number", "text") == [(1, 0, "3.1", "3.1 The common rules")]


def test_subclauses_nest_by_mark(spark):
    marks = [("clause", None, 0), ("subclause", "a", 0), ("subclause", "i", 0), ("subclause", "ii", 0), ("subclause", "b", 0), ("subclause", "h", 0), ("subclause", "i", 0), ("subclause", "j", 0), ("subclause", "v", 12)]
    made = spark.createDataFrame([(1, i, kind, mark, float(x), 1) for i, (kind, mark, x) in enumerate(marks)], "doc_id long, place int, kind string, mark string, x0 double, section int")
    got = {r.place: (r.family, r.parent) for r in structure.nested_subclauses(made).collect()}
    assert got == {1: ("alpha", 0), 2: ("roman", 1), 3: ("roman", 1), 4: ("alpha", 0), 5: ("alpha", 0), 6: ("alpha", 0), 7: ("alpha", 0), 8: ("roman", 7)}


def test_tables_go_on_over_three_pages(spark):
    schema = f"{ELEMENT}, section string, appendix string, cols int, rows int, header string"
    table = lambda d, place, page, y0, y1, cols=2, header="h": (d, place, page, "table", "t", 50.0, y0, 550.0, y1, 9.0, None, None, cols, 4, header)
    text = (2, 1, 2, "paragraph", "between", 50.0, 5.0, 550.0, 9.0, 9.0, None, None, None, None, None)
    made = [table(1, 0, 1, 100.0, 200.0), table(1, 1, 1, 500.0, 790.0), table(1, 2, 2, 10.0, 790.0), table(1, 3, 3, 10.0, 300.0, header="other"), table(2, 0, 1, 500.0, 790.0), text, table(2, 2, 2, 10.0, 300.0), table(3, 0, 1, 500.0, 790.0), table(3, 1, 2, 10.0, 300.0, cols=3)]
    got = structure.logical_tables(spark.createDataFrame(made, schema), 600.0, 800.0)
    assert rows(got, "doc_id", "place", "table", "nth", "rows_kept") == [(1, 0, 0, 1, 4), (1, 1, 1, 1, 4), (1, 2, 1, 2, 3), (1, 3, 1, 3, 4), (2, 0, 0, 1, 4), (2, 2, 2, 1, 4), (3, 0, 0, 1, 4), (3, 1, 1, 1, 4)]
    assert rows(structure.table_continuations(got), "doc_id", "source", "target") == [(1, 1, 2), (1, 2, 3)]


def test_structure_of_nothing(spark):
    none = spark.createDataFrame([], f"{ELEMENT}, toc_level int, confidence double, listed boolean, section string, appendix string, cols int, rows int, header string")
    levels = structure.heading_levels(none)
    for df in (structure.document_roles(none, 600.0, 800.0), levels, structure.outline(none, levels), structure.appendices(none), structure.logical_tables(none, 600.0, 800.0), structure.footnotes(none, 600.0, 800.0), structure.footer_headings(none)):
        assert df.collect() == []


@pytest.mark.parametrize("least", [0.3, 0.5, 0.7, 1.0])
def test_near_questions_equal_all_pairs(spark, least):
    random.seed(7)
    asked = [(i, ["the", *random.sample("abcdefgh", random.randint(0, 5))]) for i in range(60)] + [(100 + i, ["the", "a", "b"]) for i in range(30)] + [(200, []), (201, None), (202, ["z", "z"])]
    left, right = asked[:70], asked[20:]
    make = lambda part: spark.createDataFrame(part, "id long, terms array<string>")
    got = rows(evaluation.near_questions(make(left), make(right), least), "id", "other", "jaccard")
    wanted = []
    for i, a in left:
        near = [(-round(len(set(a) & set(b)) / len(set(a) | set(b)), 6), j) for j, b in right if a and b and i != j and len(set(a) & set(b)) >= least * len(set(a) | set(b)) - 1e-9]
        if near:
            wanted.append((i, min(near)[1], -min(near)[0]))
    assert got == sorted(wanted)
