import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import chunking, evaluation, evidence, graph, retrieval
from tessera.sources import ingest


def one(df):
    return df.collect()[0].asDict()


def test_lexical_terms_fall_back_to_raw_tokens(spark):
    df = spark.createDataFrame([("What is the XYZ rule of 7 a b?",), ("the of the",), ("",), (None,)], "q string")
    got = [r[0] for r in df.select(text.lexical_terms(F.col("q"))).collect()]
    assert got == [["xyz", "rule", "7"], ["the", "of"], [], None]


def test_page_display(spark):
    df = spark.createDataFrame([([3],), ([5, 3, 4],), ([7, 3],), ([],)], "p array<int>")
    assert [r[0] for r in df.select(text.page_display(F.col("p"))).collect()] == ["PDF p. 3", "PDF pp. 3–5", "PDF pp. 3, 7", None]


def test_jaccard_of_empty_sets_is_one(spark):
    df = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5]


def test_validation_of_files(spark):
    rows = [("a.pdf", 5, b"%PDF-"), ("b.pdf", 3, b"abc"), ("c.exe", 1, b"x"), ("d.txt", 0, b""), ("e.html", 6, b" <html")]
    df = spark.createDataFrame(rows, "name string, length long, content binary")
    got = {r["name"]: r["errors"] for r in ingest.validated(df).collect()}
    assert got == {"a.pdf": [], "b.pdf": ["content differs from extension"], "c.exe": ["unsupported extension", "content differs from extension"], "d.txt": ["empty file"], "e.html": []}


def test_pdf_kind(spark):
    df = spark.createDataFrame([("a", 80), ("a", 90), ("b", 0), ("c", 60), ("c", 1)], "document_id string, n_chars int")
    assert {r["document_id"]: r["kind"] for r in ingest.pdf_kind(df).collect()} == {"a": "digital", "b": "scanned", "c": "mixed"}


def test_replacing_documents_keeps_others(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    ingest.replace_documents(spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, v int"), path)
    ingest.replace_documents(spark.createDataFrame([("b", 3)], "document_id string, v int"), path)
    assert sorted((r["document_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_dense_search_skips_zero_and_null_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0])], "item_id long, vector array<double>")
    q = v.withColumnRenamed("item_id", "query_id")
    got = [(r["query_id"], r["item_id"], r["rank"]) for r in retrieval.dense_search(q, v, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (5, 5, 1), (5, 1, 2)]


def test_fusion_ties_go_to_the_best_single_rank(spark):
    ranks = "query_id long, item_id long, rank int"
    dense, lexical = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], ranks), spark.createDataFrame([(1, 20, 1), (1, 30, 2)], ranks)
    got = [(r["item_id"], r["rank"]) for r in retrieval.fuse(dense, lexical).orderBy("rank").collect()]
    assert got == [(20, 1), (10, 2), (30, 3)]
    with pytest.raises(ValueError):
        retrieval.fuse(dense, lexical, constant=0)


def test_packing_keeps_an_overlong_unit_alone(spark):
    df = spark.createDataFrame([(1, 0, "a", 300), (1, 1, "b", 200), (1, 2, "c", 900), (1, 3, "d", 10)], "doc_id long, place int, text string, tokens int")
    assert [r["chunk_index"] for r in chunking.packed(df).orderBy("place").collect()] == [0, 1, 2, 3]


def test_context_merges_seeds(spark):
    chunks = spark.createDataFrame([("d", i) for i in range(6)], "doc_id string, chunk_index int")
    seeds = spark.createDataFrame([(1, "d", 2, 1), (1, "d", 3, 2)], "query_id long, doc_id string, chunk_index int, rank int")
    got = [(r["chunk_index"], r["source_rank"], r["is_seed"]) for r in evidence.expand(seeds, chunks).orderBy("context_order").collect()]
    assert got == [(1, 1, False), (2, 1, True), (3, 1, True), (4, 1, False), (5, 2, False)]


def test_markers_follow_first_use(spark):
    df = spark.createDataFrame([(1, 1, "E2", 0), (1, 1, "E1", 1), (1, 2, "E2", 0)], "response_id long, claim_no int, evidence_id string, position int")
    assert [(r["evidence_id"], r["marker"], r["uses"]) for r in evidence.markers(df).orderBy("marker").collect()] == [("E2", 1, 2), ("E1", 2, 1)]


def test_known_metric_values(spark):
    df = spark.createDataFrame([(41, 5, 52)], "c int, p int, t int")
    assert one(evaluation.micro_average(df, "c", "p", "t"))["completeness"] == 0.836538
    answers = spark.createDataFrame([(True, True)] * 3 + [(True, False)], "p boolean, a boolean")
    got = one(evaluation.precision_recall(answers, F.col("p"), F.col("a")))
    assert (got["precision"], got["recall"], got["f1"]) == (0.75, 1.0, 0.857143)
    none = one(evaluation.precision_recall(answers.filter("not p"), F.col("p"), F.col("a")))
    assert none["precision"] is None and none["f1"] is None


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 5, 3), (2, 9, 1)], "query_id long, item_id long, rank int")
    gold = spark.createDataFrame([(1, 6, 1), (1, 7, 2), (2, 1, 1)], "query_id long, item_id long, evidence_group int")
    got = {r["query_id"]: r for r in evaluation.score_ranking(ranked, gold).collect()}
    assert (got[1]["hit_1"], got[1]["hit_3"], got[1]["recall_3"], got[1]["complete_3"], got[1]["rr"]) == (0.0, 1.0, 0.5, 0.0, 0.5)
    assert got[2]["rr"] == 0.0


def test_paths_leave_out_cycles(spark):
    df = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("x", "y", "X"), ("y", "x", "Y")], "id string, parent_id string, title string")
    assert {r["id"]: r["path"] for r in graph.paths(df).collect()} == {"a": ["A"], "b": ["A", "B"]}


def test_islands_and_carried_values(spark):
    df = spark.createDataFrame([("d", 1), ("d", 2), ("d", 4)], "g string, p int")
    assert sorted((r["first"], r["last"], r["n"]) for r in graph.islands(df, "g", "p").collect()) == [(1, 2, 2), (4, 4, 1)]
    rows = spark.createDataFrame([("d", 1, None), ("d", 2, "h"), ("d", 3, None)], "g string, p int, v string")
    assert [r["s"] for r in graph.carried(rows, "g", "p", "v", "s").orderBy("p").collect()] == [None, "h", "h"]


def test_manifest(spark):
    have = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, sha256 string")
    want = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "name string, sha256 string")
    assert sorted((r["name"], r["state"]) for r in ingest.manifest_differences(have, want).collect()) == [("b", "changed"), ("c", "missing")]


def test_stream_takes_each_file_once(spark, tmp_path):
    from tessera.streaming import ingest as start

    df = spark.createDataFrame([("a", 1)], "document_id string, v int")
    source, target, checkpoint = (f"file://{tmp_path}/{x}" for x in "stc")
    for k in (1, 2):
        df.withColumn("v", F.lit(k)).write.mode("append").parquet(source)
        start(spark, source, df.schema, target, checkpoint, lambda b: b).awaitTermination()
    assert [r["v"] for r in spark.read.parquet(target).collect()] == [2]


CHUNK = "doc_id string, chunk_index int, kind string, text string, pages array<int>, section_path array<string>"
SEED = "query_id long, doc_id string, chunk_index int, rank int"


def context(spark, chunks, seeds, **limits):
    made = spark.createDataFrame([("d", *c) for c in chunks], CHUNK)
    got = evidence.structural(spark.createDataFrame([(1, "d", i, r) for r, i in enumerate(seeds, 1)], SEED), made, **limits)
    return [(r["chunk_index"], r["source_rank"], r["ranked_seed_rank"], r["reasons"]) for r in got.orderBy("context_order").collect()]


def test_structural_context_rules(spark):
    s = ["A"]
    got = context(spark, [(90, "clause", "x; and", [34], s), (91, "list_item", "y", [35], s)], [90])
    assert got == [(90, 1, 1, ["ranked_seed"]), (91, 1, None, ["continuation_list_item"])]
    got = context(spark, [(180, "clause", "x:", [1], s), (181, "mixed", "y", [1], s), (182, "mixed", "z", [1], s), (183, "clause", "w", [1], s)], [180])
    assert [r[0] for r in got] == [180, 181, 182]
    got = context(spark, [(242, "clause", "the following authorities.", [89], s), (243, "table", "t", [90], s)], [242])
    assert got[1] == (243, 1, None, ["following_table"])
    assert len(context(spark, [(1, "clause", "Items:", [1], s), (2, "list_item", "y", [1], ["B"])], [1])) == 1
    chain = [(1, "clause", "x:", [], s), (2, "list_item", "y:", [], s), (3, "list_item", "z", [], s)]
    assert [r[0] for r in context(spark, chain, [1], forward=1)] == [1, 2]
    assert [r[0] for r in context(spark, [(1, "clause", "x:", [1], s), (3, "list_item", "z", [1], s)], [1])] == [1]


def test_structural_context_is_capped_in_order(spark):
    chunks = [(i, "list_item", f"{i}:", None, None) for i in range(8)]
    got = context(spark, chunks, [2, 5], most=4)
    assert [(r[0], r[1]) for r in got] == [(1, 1), (2, 1), (3, 1), (5, 2)]
    assert got[0][3] == ["preceding_intro"] and got[2][3] == ["introduced_child"]


def test_pieces_of_a_text():
    assert chunking.pieces(None, 5) is None and chunking.pieces(" ", 5) == []
    assert chunking.pieces("a b, c " + "long-word-of-seven-tokens x", 3) == ["a b,", "c", "long-word-of-seven-tokens", "x"]
    words = "w " * 100_000
    assert sum(len(p.split()) for p in chunking.pieces(words, 700)) == 100_000


def test_pieces_overlap_by_words():
    text = "One two three. Four five six!\n\nSeven eight nine ten."
    got = chunking.overlapping(text, 8, 3)
    assert got == ["One two three. Four five six!", "five six!\n\nSeven eight nine ten."]
    assert chunking.overlapping(text, 5, 3) == ["One two three.", "Four five six!", "Seven eight nine ten."]
    assert chunking.overlapping("", 5, 2) == []


def test_table_rows_are_never_cut():
    assert chunking.table_rows(["h | k", "a | b", "c | d", "e | f"], 7) == [("", "h | k\na | b"), ("h | k", "c | d"), ("h | k", "e | f")]


def test_splitting_of_overlong_chunks(spark):
    rows = [("a", "w " * 500, 500, None), ("b", "short", 1, "x"), ("c", None, None, None), ("t", "h\n" + "r r r\n" * 100, 301, "table")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, tokens int, kind string")
    got = chunking.split_overlong(df, 150).orderBy("chunk_id", "split_part").collect()
    assert [(r["chunk_id"], r["tokens"], r["split_part"], r["split_total"]) for r in got] == [("a", 150, 1, 4), ("a", 150, 2, 4), ("a", 150, 3, 4), ("a", 50, 4, 4), ("b", 1, None, None), ("c", None, None, None), ("t", 148, 1, 3), ("t", 147, 2, 3), ("t", 6, 3, 3)]
    assert [r["split_context"] for r in got if r["chunk_id"] == "t"] == ["", "h", "h"]
    assert chunking.split_overlong(df.filter("chunk_id = 'x'"), 150).count() == 0


def test_ids_of_many_chunks(spark):
    df = spark.createDataFrame([("d", 7), ("d", 12_345)], "doc string, i int")
    got = [r[0] for r in df.select(text.content_id(F.col("doc"), F.col("i"), F.lit("k"), F.array(F.lit("u")), F.lit("t"))).collect()]
    assert [x[:-10] for x in got] == ["d-c0007-", "d-c12345-"]


def test_paths_of_any_depth(spark):
    df = spark.createDataFrame([(k, k - 1 if k else None, str(k)) for k in range(40)], "id long, parent_id long, title string")
    assert {r["id"]: r["depth"] for r in graph.paths(df).collect()} == {k: k + 1 for k in range(40)}


def test_cycles_are_found(spark):
    from tessera.operators import integrity

    rows = [(k, k - 1 if k else None) for k in range(30)] + [(100, 102), (101, 100), (102, 101), (103, 102), (104, 999), (200, 200)]
    got = integrity.on_cycles(spark.createDataFrame(rows, "id long, up long"), "id", "up").collect()
    assert sorted(r["id"] for r in got) == [100, 101, 102, 103, 200]


def test_more_queries_than_a_block(spark, monkeypatch):
    rows = [(k, [float(k % 7 + 1), float(k % 5 + 1), 1.0]) for k in range(60)]
    v = spark.createDataFrame(rows, "item_id long, vector array<double>")
    q = v.withColumnRenamed("item_id", "query_id")
    whole = sorted(map(tuple, retrieval.dense_search(q, v, 3).select("query_id", "item_id", "rank").collect()))
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 10 * 24)
    assert sorted(map(tuple, retrieval.dense_search(q, v, 3).select("query_id", "item_id", "rank").collect())) == whole
    assert len(whole) == 180


def test_a_cluster_needs_a_shared_folder():
    from tessera.sources import shared

    class Session:
        sparkContext = type("Context", (), {"master": "yarn", "getCheckpointDir": staticmethod(lambda: None)})  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="checkpoint"):
        shared.folder(Session)


def test_large_files_are_not_read(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("abc")
    (tmp_path / "b.txt").write_text("abcdef")
    monkeypatch.setattr(ingest, "MOST_BYTES", 4)
    got = {r["name"]: (r["errors"], r["sha256"] is None) for r in ingest.files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": ([], False), "b.txt": (["too large"], True)}


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    from tessera.sources import records

    (tmp_path / "q.csv").write_bytes("\ufeffid,text\n1,\"a\nb\"\n".encode())
    assert [r.asDict() for r in records.csv_table(spark, f"file://{tmp_path}/q.csv").collect()] == [{"id": "1", "text": "a\nb"}]


def test_vectors_of_unequal_dimension_are_refused(spark):
    from tessera.sources import records

    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vector array<double>")
    with pytest.raises(Exception, match="dimension"):
        records.checked_vectors(df).collect()
    assert records.checked_vectors(df.filter("id = 1")).count() == 1


def test_files_that_are_not_read_on(spark):
    from tessera.sources import records

    df = spark.createDataFrame([("pdf", []), ("word", []), ("pdf", ["empty file"])], "family string, errors array<string>")
    assert [r["state"] for r in records.reading_state(df).collect()] == ["accepted", "unsupported", "rejected"]


def test_incomplete_coverage_stops_the_plan(spark):
    chunks = spark.createDataFrame([(1,), (2,)], "item_id long")
    vectors = spark.createDataFrame([(1, [1.0])], "item_id long, vector array<double>")
    with pytest.raises(Exception, match="not all chunks"):
        retrieval.gate(retrieval.coverage(chunks, vectors)).collect()


def test_held_out_split_needs_confirmation():
    assert evaluation.split_allowed("dev", False, None, "t") and evaluation.split_allowed("heldout", True, "t", "t")
    assert not evaluation.split_allowed("heldout", False, "t", "t") and not evaluation.split_allowed("heldout", True, "T", "t")
    with pytest.raises(ValueError):
        evaluation.split_allowed("test", True, "t", "t")
