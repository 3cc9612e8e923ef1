"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that a lexical plan drops.
QUERY_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by",
    "can", "could", "did", "do", "does", "for", "from", "had", "has", "have",
    "how", "i", "if", "in", "into", "is", "it", "its", "may", "must", "not", "of", "on", "or",
    "shall", "should", "that", "the", "their", "them", "then", "there", "these", "they",
    "this", "those", "to", "was", "we", "were", "what", "when", "where", "which",
    "who", "why", "will", "with", "would", "you", "your",
]
#: Words in the sense of Unicode, or single other signs.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def token_estimate(text: Column) -> Column:
    """Number of words and signs."""
    return F.regexp_count(text, F.lit(TOKEN))


def squeeze(text: Column) -> Column:
    """Soft hyphens out, white space to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "­", ""), r"[\t\n\f\r ]+", " "))


def lexical_terms(query: Column, most: int = 24) -> Column:
    """Distinct content terms of a query in order; if it has none, its distinct raw terms."""
    raw = F.transform(F.regexp_extract_all(query, F.lit("([A-Za-z0-9]+)"), F.lit(1)), F.lower)
    stop = F.array(*map(F.lit, QUERY_STOPWORDS))
    content = F.array_distinct(F.filter(raw, lambda t: ~F.array_contains(stop, t) & ~t.rlike("^[a-z]$")))
    return F.slice(F.when(F.size(content) > 0, content).otherwise(F.array_distinct(raw)), 1, most)


def preview(text: Column, length: int = 120) -> Column:
    """The text, or its beginning and an ellipsis."""
    flat = squeeze(text)
    return F.when(F.length(flat) > length, F.concat(F.rtrim(F.substring(flat, 1, length - 1)), F.lit("…"))).otherwise(flat)


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two sets; 1 if both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def content_id(prefix: Column, index: Column, kind: Column, sources: Column, text: Column) -> Column:
    """An id of a chunk from its document, place and content."""
    digest = F.sha2(F.concat_ws("\n", kind, F.concat_ws("\n", sources), text), 256)
    return F.concat(prefix.cast("string"), F.lit("-c"), F.lpad(index.cast("string"), F.greatest(F.length(index.cast("string")), F.lit(4)), F.lit("0")), F.lit("-"), F.substring(digest, 1, 10))


def page_display(pages: Column) -> Column:
    """PDF p. 3, PDF pp. 3-5, or PDF pp. 3, 7."""
    own = F.array_sort(F.array_distinct(pages))
    first, last = F.element_at(own, 1).cast("string"), F.element_at(own, -1).cast("string")
    run = F.element_at(own, -1) - F.element_at(own, 1) + 1 == F.size(own)
    return F.when(F.size(own) == 0, F.lit(None)).when(F.size(own) == 1, F.concat(F.lit("PDF p. "), first)).when(run, F.concat(F.lit("PDF pp. "), first, F.lit("–"), last)).otherwise(F.concat(F.lit("PDF pp. "), F.array_join(own.cast("array<string>"), ", ")))


# Phrases, and shapes of a lower-cased text, that announce what follows.
ANNOUNCING = ["following authorities", "following information", "following categories"]
SHAPES = [r":$", r"(?s)\bentails?\b.*\b(two|three|four|five|\d+)\b.*:", r"(?s)\b(includes?|comprises?|consists of|sets out)\b.*:"]


def announces(text: Column) -> Column:
    """Whether a chunk's text introduces its neighbours; false if it is null."""
    flat = F.lower(F.trim(text))
    found = [flat.contains(p) for p in ANNOUNCING] + [flat.rlike(s) for s in SHAPES]
    return F.coalesce(F.array_contains(F.array(*found), True), F.lit(False))
