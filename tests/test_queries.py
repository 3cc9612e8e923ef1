from pathlib import Path

import pytest
from tests.compare import duck, spark_rows

from tessera.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == duck(FOLDER, SQL[name])


def test_titles_of_odd_documents_equal_sql(spark, tmp_path):
    texts = ["Rules updated for all of 3", "Updated rules: 3 May 2020", "As of now nothing 12345", "éissued forms here 3", "Reissued forms are here", "Plain title of nine", "", None, " ", "x\n" * 8 + "Versions of the rules"]
    made = [(3 * i + k, t if t is None else t + "z" * pad, src) for i, (t, pad, src) in enumerate((t, pad, src) for t in texts for pad in range(3) for src in ("src 1 ", None, " ")) for k in range(2)]
    spark.createDataFrame(made, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "made"))
    for t in Path(FOLDER).glob("*.parquet"):
        (tmp_path / t.name).symlink_to(t if t.name != "documents.parquet" else next((tmp_path / "made").glob("*.parquet")))
    got = spark_rows(QUERIES["document_titles"](spark, str(tmp_path)))
    assert got == duck(str(tmp_path), SQL["document_titles"])
    assert len(got[1]) == len(made) and {"element", "metadata", "filename"} == {r["title_source"] for r in QUERIES["document_titles"](spark, str(tmp_path)).collect()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
