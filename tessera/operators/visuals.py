"""Figures and tables of chunks: what can be shown, its label, and the references that tie it to a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.elements import area, box

#: Relations that tie a figure to a chunk, in order, with their confidence.
RELATIONS = {"contains": 1.0, "explanation": 0.99, "caption": 0.97, "intro": 0.95, "source": 0.88}


def displayable(figures: DataFrame) -> DataFrame:
    """Figures with an area that have a section, a caption or an intro."""
    return figures.filter((area(box()) > 0) & (F.col("section").isNotNull() | F.col("caption").isNotNull() | F.col("intro").isNotNull()))


def label(caption: Column, intro: Column, default: Column, longest: int = 220) -> Column:
    """The caption, else an intro of at most `longest` characters, else the default."""
    return F.coalesce(F.when(F.length(caption) > 0, caption), F.when((F.length(intro) > 0) & (F.length(intro) <= longest), intro), default)


def direct_refs(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """One reference for each chunk and figure that share an element, by the strongest relation.

    chunks: doc_id, chunk_index, place (an element each); links: doc_id, figure, place, relation.
    """
    confidence = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])[F.col("relation")]
    met = chunks.select("doc_id", "chunk_index", "place").distinct().join(links, ["doc_id", "place"])
    return met.groupBy("doc_id", "chunk_index", "figure").agg(F.max(confidence).alias("confidence"))


def nearby_refs(figures: DataFrame, chunks: DataFrame, most: int = 2, gap: int = 1) -> DataFrame:
    """References of a figure's section to the up to `most` chunks last before it, at most `gap` pages away.

    figures: doc_id, figure (its place), section, page; chunks: doc_id, chunk_index, section, last (place), page.
    Chunks of other sections are never met, as the section is part of the join.
    """
    met = figures.select("doc_id", "figure", "section", F.col("page").alias("p")).join(chunks.select("doc_id", "chunk_index", "section", "last", "page"), ["doc_id", "section"])
    met = met.filter((F.col("last") < F.col("figure")) & (F.col("p") - F.col("page") <= gap))
    i = F.row_number().over(Window.partitionBy("doc_id", "figure").orderBy(F.desc("last"), F.desc("chunk_index"))) - 1
    near = met.withColumn("i", i).filter(F.col("i") < most)
    return near.select("doc_id", "chunk_index", "figure", F.greatest(F.lit(0.72), F.round(F.lit(0.84) - F.lit(0.06) * F.col("i"), 2)).alias("confidence"))


def merged(*refs: DataFrame) -> DataFrame:
    """References with the same chunk and figure as one, of the highest confidence, with their place in the chunk's list."""
    found = refs[0]
    for other in refs[1:]:
        found = found.unionByName(other)
    best = found.groupBy("doc_id", "chunk_index", "figure").agg(F.max("confidence").alias("confidence"))
    order = Window.partitionBy("doc_id", "chunk_index").orderBy(F.desc("confidence"), "figure")
    return best.withColumn("n", F.row_number().over(order))


def crops(fragments: DataFrame, by: list[str]) -> DataFrame:
    """The box around all fragments of a group."""
    return fragments.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("fragments"))
