"""Cleaning decisions and chunks of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import content_id, squeeze, token_estimate

TARGET, MOST = 450, 700


def units(docs: DataFrame) -> DataFrame:
    """Lines of documents (doc_id, text) as units: doc_id, place, text, squeezed, and tokens."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "text"))
    return lines.select("doc_id", "place", squeeze(F.col("text")).alias("text")).withColumn("tokens", token_estimate(F.col("text")))


def repeated(units_: DataFrame, least: int = 3, longest: int = 220) -> DataFrame:
    """Texts of at most `longest` characters that stand in `least` or more documents: text, docs, uses."""
    short = units_.filter((F.length("text") > 0) & (F.length("text") <= longest))
    once = short.groupBy("text", "doc_id").agg(F.count("*").alias("n"))  # first per document, so that no text gathers all rows
    return once.groupBy("text").agg(F.count("*").alias("docs"), F.sum("n").alias("uses")).filter(F.col("docs") >= least)


def decisions(units_: DataFrame, repeats: DataFrame) -> DataFrame:
    """decision (include, exclude) and reason of each unit; the first rule that holds decides.

    Only units that no earlier rule has decided meet the repeated texts.
    """
    seen = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("place"))
    early = F.when(F.length("text") == 0, "empty_text").when(seen > 1, "duplicate").when(F.col("text").rlike(r"^[0-9]+$"), "page_number")
    marked = units_.withColumn("early", early)
    open_ = marked.filter("early is null").join(repeats.select("text", F.lit(True).alias("repeats")), "text", "left")
    late = F.when(F.col("repeats"), "repeated_margin").when(~F.col("text").rlike(r"[A-Za-z]"), "no_letters").otherwise("retrieval_text")
    columns = ["doc_id", "place", "text", "tokens"]
    decided = marked.filter("early is not null").select(*columns, F.col("early").alias("reason")).unionByName(open_.select(*columns, late.alias("reason")))
    return decided.withColumn("decision", F.when(F.col("reason") == "retrieval_text", "include").otherwise("exclude"))


def _fold(target: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk numbers of units (doc_id, place, tokens) that come by document and place; a document may span batches."""
    doc, chunk, used = object(), 0, 0
    for batch in batches:
        out = []
        for d, tokens in zip(batch["doc_id"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
            if d != doc:
                doc, chunk, used = d, 0, tokens
            elif used + tokens > target:
                chunk, used = chunk + 1, tokens
            else:
                used += tokens
            out.append(chunk)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "chunk_index"])


def packed(units_: DataFrame, target: int = TARGET) -> DataFrame:
    """Each unit's chunk_index: adjacent units up to `target` tokens, and one unit at least, make a chunk.

    Units are brought together and sorted by document; one pass goes over them, so that no document has to fit a row and
    the work is in proportion to the units.
    """
    ordered = units_.select("doc_id", "place", "text", "tokens").repartition("doc_id").sortWithinPartitions("doc_id", "place")
    schema = ", ".join(f"`{c}` {t}" for c, t in ordered.dtypes)
    return ordered.mapInArrow(partial(_fold, target), f"{schema}, chunk_index int")


def chunks(packed_: DataFrame) -> DataFrame:
    """chunk_id, text, tokens and the span of places of each chunk."""
    made = packed_.groupBy("doc_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("u"), F.sum("tokens").alias("tokens"), F.min("place").alias("first_place"), F.max("place").alias("last_place"), F.count("*").alias("units"))
    text = F.array_join(F.transform("u", lambda x: x["text"]), "\n")
    sources = F.transform("u", lambda x: F.concat(F.lit("u"), x["place"].cast("string")))
    made = made.withColumn("text", text).withColumn("chunk_id", content_id(F.col("doc_id"), F.col("chunk_index"), F.lit("paragraph"), sources, F.col("text")))
    return made.drop("u")


def summary(chunks_: DataFrame) -> DataFrame:
    """One row: counts and sizes of chunks."""
    return chunks_.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.sum("tokens").alias("tokens"), F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens"), F.bround(F.avg("tokens"), 2).alias("avg_tokens"), F.count_if(F.col("tokens") > MOST).alias("over_limit"))


_TOKEN = re.compile(r"\w+|[^\w\s]")


def _tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def _words(words: list[str], most: int) -> list[str]:
    """Words in pieces of up to `most` tokens; a word beyond that is a piece of its own."""
    out: list[list[str]] = []
    used = 0
    for word in words:
        n = _tokens(word)
        if not out or used + n > most:
            out.append([])
            used = 0
        out[-1].append(word)
        used += n
    return [" ".join(x) for x in out]


def pieces(text: str | None, most: int) -> list[str] | None:
    """The words of a text in pieces of up to `most` tokens; a null text has none (null), an empty one an empty list."""
    return None if text is None else _words(text.split(), most)


def overlapping(text: str, most: int, overlap: int) -> list[str]:
    """A text in pieces of up to `most` tokens, cut at paragraphs, else sentences, else words.

    A piece after the first begins with the last words of the one before, up to `overlap` tokens, unless that would take
    it over `most`.
    """
    small: list[str] = []
    for paragraph in (p.strip() for p in re.split(r"\n\s*\n", text)):
        parts = [paragraph] if _tokens(paragraph) <= most else re.split(r"(?<=[.!?;:])\s+", paragraph)
        for part in filter(None, parts):
            small += [part] if _tokens(part) <= most else _words(part.split(), most)
    out: list[str] = []
    held: list[str] = []
    used = 0
    for part in small:
        n = _tokens(part)
        if held and used + n > most:
            out.append("\n\n".join(held))
            tail: list[str] = []
            left = overlap
            for word in reversed(out[-1].split()):
                left -= _tokens(word)
                if left < 0:
                    break
                tail.append(word)
            before = " ".join(reversed(tail))
            held, used = ([before], _tokens(before)) if before and _tokens(before) + n <= most else ([], 0)
        held.append(part)
        used += n
    return [*out, "\n\n".join(held)] if held else out


def table_rows(rows: list[str], most: int) -> list[tuple[str, str]]:
    """(context, content) of parts of a table: rows are never cut, the first one is the context of all parts but the first."""
    out: list[tuple[str, list[str]]] = []
    used = 0
    for row in rows:
        n = _tokens(row)
        if not out or used + n > most:
            out.append(("" if not out else rows[0], []))
            used = 0 if len(out) == 1 else _tokens(rows[0])
        out[-1][1].append(row)
        used += n
    return [(context, "\n".join(x)) for context, x in out]


def split_overlong(chunks_: DataFrame, most: int = MOST, overlap: int = 0) -> DataFrame:
    """Chunks (text, tokens and others) with those over `most` tokens in pieces: split_part from 1, split_total; else both null.

    With `overlap`, pieces are cut at paragraphs, sentences or words and repeat words of the one before; without, at
    words alone.  Chunks of the kind `table`, if there is such a column, are cut between lines, with the first line as
    context (a further column).  In Arrow batches, in time in proportion to the texts.
    """
    names = chunks_.columns
    tables = "kind" in names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tokens = batch["text"].to_pylist(), batch["tokens"].to_pylist()
            kinds = batch["kind"].to_pylist() if tables else [None] * len(texts)
            at, made = [], []
            for i, (text, n, kind) in enumerate(zip(texts, tokens, kinds, strict=True)):
                if text is None or n is None or n <= most:
                    at.append(i)
                    made.append((text, n, None, None, ""))
                    continue
                parts = table_rows(text.split("\n"), most) if kind == "table" else [("", p) for p in (overlapping(text, most, overlap) if overlap else pieces(text, most))]
                at += [i] * len(parts)
                made += [(p, _tokens(p), k, len(parts), context) for k, (context, p) in enumerate(parts, 1)]
            for i in range(0, len(at), 1000):
                taken = batch.take(pa.array(at[i : i + 1000], pa.int64()))
                columns = dict(zip(("text", "tokens", "split_part", "split_total", "split_context"), zip(*made[i : i + 1000], strict=True), strict=True))
                arrays = [pa.array(columns[c], batch.schema.field(c).type) if c in columns else taken[c] for c in batch.schema.names]
                arrays += [pa.array(columns["split_part"], pa.int32()), pa.array(columns["split_total"], pa.int32()), pa.array(columns["split_context"], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "split_part", "split_total", "split_context"])

    schema = ", ".join(f"`{c}` {t}" for c, t in chunks_.dtypes)
    return chunks_.mapInArrow(cut, f"{schema}, split_part int, split_total int, split_context string")
