"""Numbers and marks of headings and clauses, table texts, and canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Roman digits.
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman_value(text: Column) -> Column:
    """Value of a Roman number; null for what isn't one: a digit before a larger one is taken off."""
    digits = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    values = F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z])"), F.lit(1)), lambda c: digits[c])
    pairs = F.zip_with(values, F.concat(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.array(F.lit(0))), lambda a, b: F.when(a < b, -a).otherwise(a))
    valid = F.lower(text).rlike(r"^m*(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (F.length(text) > 0)
    return F.when(valid, F.aggregate(pairs, F.lit(0), lambda total, x: total + x))


def marker(text: Column) -> Column:
    """family and value of a mark at a text's beginning: (3), (iv), (b), 2.1; value null where there is none.

    A single letter that is a Roman digit counts as a letter; i, v and x alone count as Roman.
    """
    inner = F.regexp_extract(text, r"^\s*\(([0-9]{1,6}|[A-Za-z]{1,8})\)", 1)
    outline = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)+)\b", 1)
    low = F.lower(inner)
    family = (
        F.when(outline != "", "outline")
        .when(inner.rlike("^[0-9]+$"), "numeric")
        .when(low.isin("i", "v", "x") | (roman_value(low).isNotNull() & (F.length(low) > 1)), "roman")
        .when(low.rlike("^[a-z]$"), "alpha")
    )
    value = F.when(family == "numeric", inner.try_cast("int")).when(family == "roman", roman_value(low)).when(family == "alpha", F.ascii(low) - 96)
    return F.struct(family.alias("family"), value.alias("value"), F.when(family == "outline", outline).alias("outline"))


def outline_parts(number: Column) -> Column:
    """Parts of 2.10.3 as numbers."""
    return F.transform(F.split(number, r"\."), lambda x: x.cast("int"))


def outline_below(number: Column, parent: Column) -> Column:
    """Whether an outline number lies below another: 2.1.3 below 2.1, but neither 2.10 nor 2.1 itself."""
    own, above = outline_parts(number), outline_parts(parent)
    return (F.size(own) > F.size(above)) & (F.slice(own, 1, F.size(above)) == above)


def clause_number(text: Column) -> Column:
    """Number of a text that begins like `12.` , `12 ` before a capital, or `Article 12`; null without one."""
    found = F.regexp_extract(text, r"^\s*(?:(?:[Aa]rticle|[Ss]ection|[Cc]lause)\s+)?([0-9]{1,4})(?:\.(?:\s|$)|\s+[A-Z]|$)", 1)
    return F.when(found != "", found.cast("int"))


def sentences(text: Column) -> Column:
    """Sentences: parts between blanks that follow a closing mark."""
    return F.split(text, r"(?<=[.!?;:])[ \t\n\r\f]+")


def table_lines(rows: Column) -> Column:
    """Rows of cells as `a | b`, pipes in cells escaped, rows without a text left out."""
    shown = F.filter(rows, lambda r: F.exists(r, lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    return F.array_join(F.transform(shown, lambda r: F.array_join(F.transform(r, lambda c: F.replace(F.coalesce(F.trim(c), F.lit("")), F.lit("|"), F.lit("\\|"))), " | ")), "\n")


def table_markdown(rows: Column) -> Column:
    """A Markdown table: the first row, a rule, and the others."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(rows[0])))
    rest = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), rule), rest), "\n"))


def record_hash(**columns: Column) -> Column:
    """SHA-256 of a record as JSON with sorted keys and without blanks; null values are written."""
    made = F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})
    return F.sha2(made, 256)


def percent(value: Column) -> Column:
    """12.3 %, or n/a for null."""
    return F.coalesce(F.format_string("%.1f%%", 100 * value), F.lit("n/a"))


def four(value: Column) -> Column:
    return F.coalesce(F.format_string("%.4f", value), F.lit("n/a"))


def text_match(text: Column, kind: Column, wanted: Column, exact_case: Column) -> Column:
    """Whether a text is, begins with, contains or matches (a regular expression) what is wanted."""
    a = F.when(exact_case, text).otherwise(F.lower(text))
    b = F.when(exact_case | (kind == "regex"), wanted).otherwise(F.lower(wanted))
    return F.when(kind == "exact", a == b).when(kind == "starts", F.startswith(a, b)).when(kind == "contains", F.contains(a, b)).when(kind == "regex", F.regexp(text, F.when(exact_case, wanted).otherwise(F.concat(F.lit("(?i)"), wanted))))
