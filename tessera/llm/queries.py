"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_read(spark, sf_dir, "pages"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pack import pack

    return pack(_read(spark, sf_dir, "documents"), with_ids=False)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    found = judge(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mix import Mix

    return Mix(spark, _read(spark, sf_dir, "documents")).taken()


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import SHORTEST, dedup_lines

    return dedup_lines(spark, _read(spark, sf_dir, "documents"), SHORTEST).select("doc_id", "n_lines", "n_kept", "text")


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matroska import stored_media

    return stored_media(_read(spark, sf_dir, "documents")).drop("media")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fold, identify

    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(3) == 1, F.lit(True)).alias("held_out")  # a row without an id teaches nothing
    found = identify(spark, docs, fold(3) != 1, ["doc_id"])
    return found.select("doc_id", held_out, "lang_pred", "score", "cosine")


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fold
    from .lattice import score

    return score(spark, _read(spark, sf_dir, "documents"), fold(7) != 2)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(spark, _read(spark, sf_dir, "documents"), width=2, percent=80).drop("row", "group")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    return format_chats(spark, _read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [value for name, value in globals().items() if name.startswith("op") and callable(value)]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .chat import ORACLE

    return {"op10_chat": ORACLE}
