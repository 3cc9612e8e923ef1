"""Files and tables: reading, validation, and replacement by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import kept

#: Extensions that are taken, and their families.
FAMILIES = {"pdf": "pdf", "docx": "word", "txt": "text", "html": "html", "htm": "html"}
MOST_BYTES = 50 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sniff(content: Column) -> Column:
    """Family of a file by its first bytes; null if it is none of those taken."""
    head = F.substring(content, 1, 512)
    shown = F.lower(F.ltrim(F.decode(head, "ISO-8859-1")))
    return (
        F.when(F.substring(content, 1, 5) == F.lit(b"%PDF-"), "pdf")
        .when(F.substring(content, 1, 4) == F.lit(b"PK\x03\x04"), F.when(F.position(F.lit(b"word/"), content) > 0, "word"))
        .when(F.position(F.lit(b"\x00"), content) > 0, F.lit(None))
        .when(shown.startswith("<!doctype html") | shown.startswith("<html"), "html")
        .otherwise("text")
    )


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with hash, family and a list of errors; none is dropped.

    The length is a filter that the reader sees, so that files beyond MOST_BYTES are listed, but not read or hashed.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    large = found.filter(F.col("length") > MOST_BYTES).select("name", "length", F.lit(None).cast("binary").alias("content"))
    return validated(found.filter(F.col("length") <= MOST_BYTES).select("name", "length", "content").unionByName(large))


def validated(found: DataFrame) -> DataFrame:
    """name, length, sha256, family and errors of files (name, length, content)."""
    extension = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    family = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])[extension]
    errors = F.array_compact(
        F.array(
            F.when(family.isNull(), "unsupported extension"),
            F.when(F.col("length") == 0, "empty file"),
            F.when(F.col("length") > MOST_BYTES, "too large"),
            F.when((F.col("length") > 0) & F.col("content").isNotNull() & ~sniff(F.col("content")).eqNullSafe(family), "content differs from extension"),
        )
    )
    return found.select("name", "length", F.sha2("content", 256).alias("sha256"), family.alias("family"), errors.alias("errors"))


def pdf_kind(pages: DataFrame, least: int = 50) -> DataFrame:
    """digital, scanned, mixed or unknown for each document, from pages (document_id, n_chars)."""
    counts = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(F.col("n_chars") >= least).alias("with_text"))
    kind = F.when(F.col("pages") == 0, "unknown").when(F.col("with_text") == F.col("pages"), "digital").when(F.col("with_text") == 0, "scanned").otherwise("mixed")
    return counts.select("document_id", "pages", "with_text", kind.alias("kind"))


def replace_documents(df: DataFrame, path: str, buckets: int = 256) -> None:
    """Writes df in the place of the rows of its documents (document_id); other documents at the path stay as they are.

    Documents lie in `buckets` folders by a hash of their id, whatever their number.  Only buckets that df touches are
    written again: their other documents are read first, joined with df in a written table, and put back with it.
    """
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")
    new = kept(df.withColumn("bucket", bucket), "replacing")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many rows as buckets at most
    whole = new
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(touched))
        whole = kept(old.join(new.select("document_id").distinct(), "document_id", "left_anti").select(*new.columns).unionByName(new), "replaced")
    whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder or file at a path of any store that Spark reads."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def manifest_differences(files_: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected files (name, sha256) that are missing or differ."""
    joined = expected.alias("e").join(files_.alias("f"), "name", "left")
    state = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("f.sha256") != F.col("e.sha256"), "changed")
    return joined.select("name", state.alias("state")).filter("state is not null")
