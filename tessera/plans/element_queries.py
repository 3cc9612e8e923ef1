"""Registered queries over elements of documents, answers and records, each beside its SQL.

Lines of the documents stand in for laid-out elements: eight to a page, their kind, box and font made from place and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import markers
from tessera.functions.text import jaccard, page_display, preview, squeeze, token_estimate
from tessera.operators import answers, elements, evaluation, evidence, integrity, retrieval, visuals
from tessera.plans.registry import query
from tessera.sources import records
from tessera.sources.ingest import table

KINDS = ["paragraph", "section_header", "clause", "subclause", "table", "figure", "caption", "footnote", "list_item", "definition", "paragraph", "paragraph"]
PAGE = 800.0
_SQUEEZE = "trim(regexp_replace(replace(raw, chr(173), ''), '[\\t\\n\\f\\r ]+', ' ', 'g'))"
_EL = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents
), flat AS (SELECT doc_id, CAST(place AS INTEGER) AS place, {_SQUEEZE} AS text FROM lines
), el AS (SELECT *, CAST(place // 8 + 1 AS INTEGER) AS page, CASE WHEN place % 8 = 0 THEN 'page_header' WHEN place % 8 = 7 THEN 'page_footer' ELSE {KINDS}[length(text) % 12 + 1] END AS kind,
  CAST(40 + length(text) % 3 * 20 AS DOUBLE) AS x0, CAST(place % 8 * 100 + 10 AS DOUBLE) AS y0, CAST(560 - length(text) % 5 * 100 AS DOUBLE) AS x1, CAST(place % 8 * 100 + 90 + length(text) % 4 * 10 AS DOUBLE) AS y1, CAST(8 + length(text) % 7 AS DOUBLE) AS font FROM flat
), els AS (SELECT *, last_value(CASE WHEN kind = 'section_header' THEN place END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place) AS section FROM el)"""


def _elements(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    flat = lines.select("doc_id", "place", squeeze(F.col("raw")).alias("text"))
    n, at = F.length("text"), F.col("place") % 8
    kinds = F.array(*map(F.lit, KINDS))
    kind = F.when(at == 0, "page_header").when(at == 7, "page_footer").otherwise(F.get(kinds, n % 12))
    double = lambda c: c.cast("double")
    made = flat.select("*", (F.floor(F.col("place") / 8) + 1).cast("int").alias("page"), kind.alias("kind"), double(40 + n % 3 * 20).alias("x0"), double(at * 100 + 10).alias("y0"), double(560 - n % 5 * 100).alias("x1"), double(at * 100 + 90 + n % 4 * 10).alias("y1"), double(8 + n % 7).alias("font"))
    return elements.sections(made)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_SMALLER = "least(greatest(x1 - x0, 0) * greatest(y1 - y0, 0), greatest(n1 - n0, 0) * greatest(m1 - m0, 0))"


@query(f"""WITH {_EL}, l AS (SELECT doc_id, place, x0, y0, x1, y1, lead(place) OVER w AS other, lead(x0) OVER w AS n0, lead(x1) OVER w AS n1, lead(y0) OVER w AS m0, lead(y1) OVER w AS m1 FROM els WINDOW w AS (PARTITION BY doc_id, page ORDER BY place))
  SELECT doc_id, place, other, round(CASE WHEN {_SMALLER} > 0 THEN greatest(least(x1, n1) - greatest(x0, n0), 0) * greatest(least(y1, m1) - greatest(y0, m0), 0) / {_SMALLER} ELSE 0 END, 6) AS overlap,
  round(CASE WHEN least(x1 - x0, n1 - n0) > 0 THEN greatest(least(x1, n1) - greatest(x0, n0), 0) / least(x1 - x0, n1 - n0) ELSE 0 END, 6) AS across, round(CASE WHEN least(y1 - y0, m1 - m0) > 0 THEN greatest(least(y1, m1) - greatest(y0, m0), 0) / least(y1 - y0, m1 - m0) ELSE 0 END, 6) AS down FROM l WHERE other IS NOT NULL""")
def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(elements.page_overlaps(_elements(spark, d)), "overlap", "across", "down")


_REPEATS = "repeats AS (SELECT doc_id, text, count(DISTINCT page) AS pages FROM els WHERE length(text) BETWEEN 1 AND 220 AND (y1 <= 96 OR y0 >= 704) GROUP BY ALL HAVING count(DISTINCT page) >= 3)"


@query(f"WITH {_EL}, {_REPEATS} SELECT * FROM repeats")
def margin_repeats(spark: SparkSession, d: str) -> DataFrame:
    return elements.margin_repeats(_elements(spark, d), PAGE)


@query(f"""WITH {_EL} SELECT doc_id, place, last_value(CASE WHEN kind NOT IN ('page_header', 'page_footer') THEN place END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(CASE WHEN kind NOT IN ('page_header', 'page_footer') THEN place END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM els""")
def element_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return elements.neighbours(_elements(spark, d), F.col("kind").isin("page_header", "page_footer"))


_DECIDED = f"""{_REPEATS}, decided AS (SELECT doc_id, place, kind, CASE WHEN text = '' THEN 'empty_text' WHEN kind <> 'figure' AND row_number() OVER (PARTITION BY doc_id, text ORDER BY place) > 1 THEN 'duplicate'
  WHEN kind = 'page_header' THEN 'page_header' WHEN kind = 'page_footer' THEN 'page_footer' WHEN regexp_matches(text, '^(page )?[0-9]+( of [0-9]+)?$') THEN 'page_number' WHEN (doc_id, text) IN (SELECT (doc_id, text) FROM repeats) THEN 'repeated_margin'
  WHEN section IN (SELECT place FROM els h WHERE h.doc_id = els.doc_id AND h.kind = 'section_header' AND regexp_matches(h.text, '^[A-D]')) THEN 'navigation' WHEN kind = 'figure' AND length(text) % 2 = 1 THEN 'figure_shell'
  WHEN kind = 'footnote' THEN 'footnote' WHEN kind = 'metadata' THEN 'metadata' WHEN kind = 'figure' AND length(text) < 3 THEN 'textless_figure' WHEN kind = 'section_header' THEN 'section_header' ELSE 'retrieval_text' END AS reason FROM els)"""


@query(f"WITH {_EL}, {_DECIDED} SELECT doc_id, place, reason, CASE WHEN reason IN ('figure_shell', 'section_header') THEN 'context' WHEN reason = 'retrieval_text' THEN 'include' ELSE 'exclude' END AS decision FROM decided")
def cleaning_decisions(spark: SparkSession, d: str) -> DataFrame:
    found = _elements(spark, d)
    lists = found.filter((F.col("kind") == "section_header") & F.col("text").rlike("^[A-D]")).select("doc_id", F.col("place").alias("section"))
    return elements.cleaning(found.withColumn("shell", F.length("text") % 2 == 1), elements.margin_repeats(found, PAGE), lists)


@query(f"""WITH {_EL}, marks AS (SELECT *, CASE WHEN kind NOT IN ('paragraph', 'list_item', 'subclause', 'caption', 'footnote') OR lag(place) OVER w IS NULL OR section IS DISTINCT FROM lag(section) OVER w THEN 1 ELSE 0 END AS b FROM els WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), runs AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM marks) SELECT doc_id, min(place) AS unit, arg_min(kind, place) AS kind, max(place) AS last, count(*) AS members FROM runs GROUP BY doc_id, run""")
def clause_units(spark: SparkSession, d: str) -> DataFrame:
    return elements.clause_units(_elements(spark, d))


@query(f"WITH {_EL}, m AS (SELECT doc_id, place, place // 5 AS c FROM els UNION ALL SELECT doc_id, place, (place + 1) // 5 FROM els) SELECT doc_id, place, CAST(min(c) AS INTEGER) AS chunk_index, count(*) AS owners FROM m GROUP BY doc_id, place")
def first_owners(spark: SparkSession, d: str) -> DataFrame:
    chunk = lambda k: F.floor((F.col("place") + k) / 5).cast("int")
    return elements.first_owners(_elements(spark, d).select("doc_id", "place", F.explode(F.array(chunk(0), chunk(1))).alias("chunk_index")))


@query(f"WITH {_EL} SELECT doc_id, page, median(font) AS font FROM els WHERE font > 0 GROUP BY ALL")
def page_fonts(spark: SparkSession, d: str) -> DataFrame:
    return elements.page_medians(_elements(spark, d))


@query(f"""WITH {_EL}, s AS (SELECT doc_id, font, sum(greatest(length(text), 1)) AS w FROM els GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY font) AS running, sum(w) OVER (PARTITION BY doc_id) AS whole FROM s)
  SELECT doc_id, min(font) AS font FROM r WHERE 2 * running >= whole GROUP BY doc_id""")
def dominant_fonts(spark: SparkSession, d: str) -> DataFrame:
    return elements.weighted_medians(_elements(spark, d), ["doc_id"])


@query(f"WITH {_EL} SELECT t.doc_id, t.place, c.place AS caption FROM els t JOIN els c ON c.doc_id = t.doc_id AND c.place = t.place - 1 AND c.page = t.page AND c.kind = 'caption' WHERE t.kind = 'table'")
def table_captions(spark: SparkSession, d: str) -> DataFrame:
    return elements.captions_before(_elements(spark, d), "table")


@query(f"""WITH {_EL}, h AS (SELECT doc_id, place, text FROM els WHERE kind = 'section_header'), c AS (SELECT e.doc_id, e.place, h.text AS title, CASE WHEN e.kind = 'definition' THEN left(e.text, 20) END AS def, CASE WHEN e.kind = 'clause' THEN left(e.text, 12) END AS cl FROM els e LEFT JOIN h ON h.doc_id = e.doc_id AND h.place = e.section)
  SELECT doc_id, place, concat_ws(chr(10), 'Section: ' || title, CASE WHEN length(def) > 0 THEN 'Definition: ' || def END, CASE WHEN length(cl) > 0 THEN 'Clause: ' || cl END) AS context FROM c""")
def context_texts(spark: SparkSession, d: str) -> DataFrame:
    found = _elements(spark, d)
    titles = found.filter("kind = 'section_header'").select("doc_id", F.col("place").alias("section"), F.array("text").alias("path"))
    joined = found.join(titles, ["doc_id", "section"], "left")
    text = elements.context_text(F.coalesce("path", F.array().cast("array<string>")), F.when(F.col("kind") == "definition", F.substring("text", 1, 20)), F.when(F.col("kind") == "clause", F.substring("text", 1, 12)))
    return joined.select("doc_id", "place", text.alias("context"))


_TOKENS = r"CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS INTEGER)"


@query(f"""WITH {_EL}, c AS (SELECT doc_id, place, {_TOKENS} AS tokens, length(text) % 90 AS ctx, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS i FROM els)
  SELECT doc_id, place, CAST(i AS INTEGER) AS chunk_index, CAST(greatest(40, 100 - ctx) AS INTEGER) AS budget, tokens + ctx <= 100 AS with_context, tokens > 100 AS over FROM c WHERE tokens > 0""")
def chunk_budgets(spark: SparkSession, d: str) -> DataFrame:
    made = _elements(spark, d).select("doc_id", "place", token_estimate(F.col("text")).alias("tokens"), (F.length("text") % 90).alias("context_tokens"))
    return elements.budgets(made, 100)


@query(f"WITH {_EL} SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS documents FROM els GROUP BY kind")
def structure_summary(spark: SparkSession, d: str) -> DataFrame:
    once = _elements(spark, d).groupBy("kind", "doc_id").agg(F.count("*").alias("k"))
    return once.groupBy("kind").agg(F.sum("k").alias("n"), F.count("*").alias("documents"))


@query(f"WITH {_EL} SELECT doc_id, max(page) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS blocks, count(*) FILTER (kind = 'table') AS tables FROM els GROUP BY doc_id")
def extraction_summary(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d).groupBy("doc_id").agg(F.max("page").alias("pages"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("blocks"), F.count_if(F.col("kind") == "table").alias("tables"))


_COUNTED = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in _COUNTED]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


_REFS = """ch AS (SELECT doc_id, place // 5 AS chunk_index, min(section) AS section, max(place) AS last, max(page) AS page FROM els GROUP BY ALL
), links AS (SELECT doc_id, place AS figure, place AS at, 1.0 AS c FROM els WHERE kind = 'figure' UNION ALL SELECT doc_id, place, place + 1, 0.97 FROM els WHERE kind = 'figure' UNION ALL SELECT doc_id, place, place - 1, 0.95 FROM els WHERE kind = 'figure'
), direct AS (SELECT e.doc_id, e.place // 5 AS chunk_index, l.figure, max(l.c) AS confidence FROM els e JOIN links l ON l.doc_id = e.doc_id AND l.at = e.place GROUP BY ALL
), near AS (SELECT doc_id, chunk_index, figure, greatest(0.72, 0.84 - 0.06 * i) AS confidence FROM (SELECT f.doc_id, f.place AS figure, c.chunk_index, row_number() OVER (PARTITION BY f.doc_id, f.place ORDER BY c.last DESC, c.chunk_index DESC) - 1 AS i
  FROM els f JOIN ch c ON c.doc_id = f.doc_id AND c.section = f.section AND c.last < f.place AND f.page - c.page <= 1 WHERE f.kind = 'figure') WHERE i < 2)"""


@query(f"""WITH {_EL}, {_REFS} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, figure, round(CAST(confidence AS DOUBLE), 2) AS confidence, CAST(row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY confidence DESC, figure) AS INTEGER) AS n
  FROM (SELECT doc_id, chunk_index, figure, max(confidence) AS confidence FROM (SELECT * FROM direct UNION ALL SELECT * FROM near) GROUP BY ALL)""")
def visual_refs(spark: SparkSession, d: str) -> DataFrame:
    found = _elements(spark, d).withColumn("chunk_index", F.floor(F.col("place") / 5).cast("int"))
    figures = found.filter("kind = 'figure'")
    steps = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(r).alias("relation")) for k, r in ((0, "contains"), (1, "caption"), (-1, "intro"))))
    links = figures.select("doc_id", F.col("place").alias("figure"), F.explode(steps).alias("s")).select("doc_id", "figure", (F.col("figure") + F.col("s.step")).alias("place"), "s.relation")
    chunks = found.groupBy("doc_id", "chunk_index").agg(F.min("section").alias("section"), F.max("place").alias("last"), F.max("page").alias("page"))
    near = visuals.nearby_refs(figures.select("doc_id", F.col("place").alias("figure"), "section", "page"), chunks)
    return visuals.merged(visuals.direct_refs(found, links), near).withColumn("confidence", F.round("confidence", 2))


_FIGURES = """f AS (SELECT *, lead(text) OVER w AS nt, lead(kind) OVER w AS nk, lag(text) OVER w AS pt, lag(kind) OVER w AS pk FROM els WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), figs AS (SELECT doc_id, place, section, x0, x1, y0, y1, CASE WHEN nk = 'caption' THEN nt END AS caption, CASE WHEN pk = 'paragraph' THEN pt END AS intro FROM f WHERE kind = 'figure')"""


@query(f"""WITH {_EL}, {_FIGURES} SELECT doc_id, place, CASE WHEN length(caption) > 0 THEN caption WHEN length(intro) BETWEEN 1 AND 220 THEN intro ELSE 'Figure ' || place END AS label FROM figs
  WHERE greatest(x1 - x0, 0) * greatest(y1 - y0, 0) > 0 AND (section IS NOT NULL OR caption IS NOT NULL OR intro IS NOT NULL)""")
def figure_labels(spark: SparkSession, d: str) -> DataFrame:
    w = elements.Window.partitionBy("doc_id").orderBy("place")
    beside = lambda f, kind: F.when(f("kind").over(w) == kind, f("text").over(w))
    figures = _elements(spark, d).withColumns({"caption": beside(F.lead, "caption"), "intro": beside(F.lag, "paragraph")}).filter("kind = 'figure'")
    shown = visuals.displayable(figures)
    return shown.select("doc_id", "place", visuals.label(F.col("caption"), F.col("intro"), F.concat(F.lit("Figure "), F.col("place").cast("string"))).alias("label"))


@query(f"WITH {_EL} SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS fragments FROM els WHERE kind = 'table' GROUP BY ALL")
def table_crops(spark: SparkSession, d: str) -> DataFrame:
    return visuals.crops(_elements(spark, d).filter("kind = 'table'"), ["doc_id", "page"])


_GIVEN = "given AS (SELECT item_id AS query_id, CAST(unnest(range(1, item_id % 4 + 1)) AS INTEGER) AS n, text FROM benchmark)"


@query(f"""WITH {_GIVEN}, b AS (SELECT query_id, count(*) AS k, string_agg('[E' || n || '] Part ' || n || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS blocks FROM given GROUP BY ALL
  ), p AS (SELECT item_id AS query_id, CAST(coalesce(k, 0) AS INTEGER) AS n_evidence, 'Question:' || chr(10) || text || chr(10) || chr(10) || 'Evidence:' || chr(10) || blocks AS prompt FROM benchmark LEFT JOIN b ON b.query_id = item_id)
  SELECT query_id, n_evidence, CASE WHEN length(prompt) <= 700 THEN prompt END AS prompt, CASE WHEN prompt IS NULL THEN 'insufficient_evidence' WHEN length(prompt) > 700 THEN 'too_long' ELSE 'ready' END AS state FROM p""")
def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    some = questions.filter("query_id % 4 > 0").withColumn("n", F.explode(F.sequence(F.lit(1), (F.col("query_id") % 4).cast("int"))))
    return answers.prompts(questions, some.withColumn("title", F.concat(F.lit("Part "), F.col("n").cast("string"))), 700)


_SAID = """CASE item_id % 8 WHEN 0 THEN 'no object at all' WHEN 1 THEN 'So: {"status":"answered","claims":[{"text":"a","evidence_ids":["E1","E2","E1"]}]} Done.' WHEN 2 THEN '{"status":"answered","claims":[]}'
  WHEN 3 THEN '{"status":"insufficient_evidence","claims":[]}' WHEN 4 THEN '{"status":"insufficient_evidence","claims":[{"text":" ","evidence_ids":["E9"]}]}' WHEN 5 THEN '{"status":"maybe","claims":[{"text":"b","evidence_ids":[]}]}'
  WHEN 6 THEN '{"status":"answered","claims":[{"text":"c","evidence_ids":["E3"]},{"text":"","evidence_ids":["E4"]}]}' ELSE '{"claims":[]}' END"""
_JUDGED = """CASE item_id % 8 WHEN 0 THEN {'s': NULL, 'c': 0, 'n': 0, 'e': ['no_decision']} WHEN 1 THEN {'s': 'answered', 'c': 1, 'n': 2, 'e': []} WHEN 2 THEN {'s': 'answered', 'c': 0, 'n': 0, 'e': ['answered_without_claims']}
  WHEN 3 THEN {'s': 'insufficient_evidence', 'c': 0, 'n': 0, 'e': []} WHEN 4 THEN {'s': 'insufficient_evidence', 'c': 1, 'n': 1, 'e': ['claims_without_answer', 'claim_without_text', 'unknown_evidence']}
  WHEN 5 THEN {'s': 'maybe', 'c': 1, 'n': 0, 'e': ['unknown_status', 'claims_without_answer', 'claim_without_evidence']} WHEN 6 THEN {'s': 'answered', 'c': 2, 'n': 2, 'e': ['claim_without_text', 'unknown_evidence']} ELSE {'s': NULL, 'c': 0, 'n': 0, 'e': ['no_decision']} END"""


@query(f"WITH j AS (SELECT item_id AS query_id, {_JUDGED} AS v FROM benchmark) SELECT query_id, v.s AS status, CAST(v.c AS INTEGER) AS n_claims, CAST(v.n AS INTEGER) AS n_named, array_to_string(v.e, ' ') AS errors FROM j")
def answer_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The SQL lists what is to be found in each of the eight kinds of answer."""
    asked = table(spark, d, "benchmark")
    said = asked.select(F.col("item_id").alias("query_id"), F.expr(_SAID).alias("answer"))
    known = asked.select(F.col("item_id").alias("query_id"), F.explode(F.array(*map(F.lit, ("E1", "E2", "E3")))).alias("evidence_id"))
    return answers.decisions(said, known).withColumn("errors", F.array_join("errors", " "))


@query(f"""WITH {_EL}, ev AS (SELECT doc_id AS query_id, 'E' || place // 8 AS evidence_id, doc_id || '-' || place AS chunk_id, doc_id, [page] AS pages FROM els WHERE place % 4 = 0
  ), ck AS (SELECT doc_id || '-' || place AS chunk_id, doc_id + CASE WHEN place % 20 = 0 THEN 1 ELSE 0 END AS doc_id, [page + CASE WHEN place % 16 = 0 THEN 1 ELSE 0 END] AS pages FROM els WHERE place % 12 <> 8
  ) SELECT query_id, evidence_id, code FROM (SELECT e.query_id, e.evidence_id, CASE WHEN c.doc_id IS NULL THEN 'chunk_missing' WHEN c.doc_id <> e.doc_id THEN 'other_document' WHEN c.pages <> e.pages THEN 'other_pages' END AS code FROM ev e LEFT JOIN ck c USING (chunk_id)) WHERE code IS NOT NULL
  UNION ALL SELECT query_id, evidence_id, 'repeated_id' FROM ev GROUP BY ALL HAVING count(*) > 1""")
def evidence_provenance(spark: SparkSession, d: str) -> DataFrame:
    found = _elements(spark, d).withColumn("chunk_id", F.concat_ws("-", "doc_id", "place"))
    evidence = found.filter("place % 4 = 0").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("E"), F.expr("place div 8").cast("string")).alias("evidence_id"), "chunk_id", "doc_id", F.array("page").alias("pages"))
    chunks = found.filter("place % 12 <> 8").select("chunk_id", F.expr("doc_id + if(place % 20 = 0, 1, 0)").alias("doc_id"), F.array(F.expr("page + if(place % 16 = 0, 1, 0)")).alias("pages"))
    return answers.provenance(evidence, chunks)


@query(f"""WITH {_EL}, m AS (SELECT doc_id, page, CASE WHEN place % 31 = 5 THEN ['appendix', 'A' || page] WHEN kind = 'clause' THEN ['clause', CAST(place AS VARCHAR)] WHEN kind = 'definition' THEN ['definition', left(text, 9)] WHEN section IS NOT NULL THEN ['section', CAST(section AS VARCHAR)] ELSE ['page', CAST(page AS VARCHAR)] END AS l FROM els)
  SELECT doc_id, l[1] AS kind, l[2] AS label, count(*) AS elements, min(page) AS first_page, max(page) AS last_page FROM m GROUP BY doc_id, l""")
def source_locators(spark: SparkSession, d: str) -> DataFrame:
    marks = {"appendix": F.when(F.col("place") % 31 == 5, F.concat(F.lit("A"), F.col("page").cast("string"))), "clause": F.when(F.col("kind") == "clause", F.col("place")), "definition": F.when(F.col("kind") == "definition", F.substring("text", 1, 9))}
    return answers.locators(_elements(spark, d).withColumns(marks))


@query("""WITH gold AS (SELECT l_orderkey AS q, l_returnflag AS kind, lower(l_linestatus) AS label, l_linenumber AS p, l_linenumber % 2 AS g FROM lineitem WHERE l_linenumber < 5), act AS (SELECT l_orderkey AS q, l_returnflag AS kind, lower(l_linestatus) AS label, l_linenumber AS p FROM lineitem WHERE l_linenumber % 3 < 2),
  met AS (SELECT q, g, bool_or(EXISTS (SELECT 1 FROM act a WHERE a.q = gold.q AND a.kind = gold.kind AND a.label = gold.label AND a.p = gold.p)) AS met FROM gold GROUP BY q, g)
  SELECT o_orderkey AS query_id, count(g) AS n_groups, round(avg(met::INT), 6) AS coverage FROM orders LEFT JOIN met ON q = o_orderkey GROUP BY o_orderkey""")
def locator_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Order lines stand in for locators, gold ones in lower case."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("label"), F.array("l_linenumber").alias("pages"), (F.col("l_linenumber") % 2).alias("evidence_group"), "l_linenumber")
    met = answers.met_locators(lines.filter("l_linenumber < 5").withColumn("label", F.lower("label")), lines.filter("l_linenumber % 3 < 2"))
    return answers.group_coverage(met, table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id")).distinct())


_ROMAN = [("m", 1000), ("cm", 900), ("d", 500), ("cd", 400), ("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1)]


def _roman(number: Column) -> Column:
    """Roman digits of 1 to 3999, as test input."""
    out, left = F.lit(""), number
    for digits, worth in _ROMAN:
        out, left = F.concat(out, F.repeat(F.lit(digits), (left / worth).cast("int"))), left % worth
    return out


@query("SELECT c_custkey AS id, CAST(c_custkey % 3999 + 1 AS INTEGER) AS value FROM customer UNION ALL SELECT -c_custkey, NULL FROM customer")
def roman_values(spark: SparkSession, d: str) -> DataFrame:
    """Numbers written as Roman ones are read again; with a digit too many they are none."""
    numbers = table(spark, d, "customer").select("c_custkey", _roman(F.col("c_custkey") % 3999 + 1).alias("text"))
    right = numbers.select(F.col("c_custkey").alias("id"), markers.roman_value(F.col("text")).alias("value"))
    return right.unionByName(numbers.select((-F.col("c_custkey")).alias("id"), markers.roman_value(F.concat(F.lit("iix"), "text")).alias("value")))


@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'numeric' WHEN 1 THEN CASE WHEN c_custkey % 26 IN (8, 21, 23) THEN 'roman' ELSE 'alpha' END WHEN 2 THEN 'outline' WHEN 3 THEN 'roman' END AS family,
  CAST(CASE c_custkey % 5 WHEN 0 THEN c_custkey WHEN 1 THEN CASE c_custkey % 26 WHEN 8 THEN 1 WHEN 21 THEN 5 WHEN 23 THEN 10 ELSE c_custkey % 26 + 1 END WHEN 3 THEN 14 END AS INTEGER) AS value,
  CASE WHEN c_custkey % 5 = 2 THEN (c_custkey % 9) || '.' || (c_custkey % 7) END AS outline, CASE WHEN c_custkey % 5 = 0 AND c_custkey < 1000000 THEN NULL WHEN c_custkey % 5 = 4 THEN CAST(c_custkey % 10000 AS INTEGER) END AS clause, CASE WHEN c_custkey % 5 = 2 THEN c_custkey % 9 = 3 END AS below FROM customer""")
def clause_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks of five kinds made from customer numbers, parsed again."""
    key = F.col("c_custkey")
    n = lambda k: (key % k).cast("string")
    text = F.when(key % 5 == 0, F.concat(F.lit(" ("), key.cast("string"), F.lit(") text"))).when(key % 5 == 1, F.concat(F.lit("("), F.char(97 + key % 26), F.lit(") text")))
    text = text.when(key % 5 == 2, F.concat(n(9), F.lit("."), n(7), F.lit(" text"))).when(key % 5 == 3, F.lit("(XIV) text")).otherwise(F.concat(F.lit("Article "), n(10000), F.lit(" Scope")))
    made = table(spark, d, "customer").select("c_custkey", text.alias("text")).withColumn("m", markers.marker(F.col("text")))
    below = F.when(F.col("m.outline").isNotNull(), markers.outline_below(F.col("m.outline"), F.lit("3")))
    return made.select(F.col("c_custkey").alias("id"), "m.family", F.col("m.value").cast("int").alias("value"), "m.outline", markers.clause_number(F.col("text")).alias("clause"), below.alias("below"))


@query("SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?;:])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL)")
def sentence_splits(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "documents").filter("text is not null").select("doc_id", markers.sentences(F.col("text")).alias("s"))
    return parts.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("""WITH r AS (SELECT n_regionkey, list([n_name || '|', CAST(n_nationkey AS VARCHAR)] ORDER BY n_nationkey) || [['', ' ']] AS rows FROM nation GROUP BY n_regionkey),
  c AS (SELECT n_regionkey, string_agg(n_name || '\\| | ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS lines, string_agg('| ' || n_name || '\\| | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation GROUP BY n_regionkey)
  SELECT n_regionkey AS id, lines, regexp_replace(md, chr(10), chr(10) || '| --- | --- |' || chr(10)) || CASE WHEN position(chr(10) IN md) = 0 THEN chr(10) || '| --- | --- |' ELSE '' END || chr(10) || '|  |   |' AS markdown FROM c""")
def table_texts(spark: SparkSession, d: str) -> DataFrame:
    cells = F.struct("n_nationkey", F.array(F.concat("n_name", F.lit("|")), F.col("n_nationkey").cast("string")).alias("cells"))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(cells)).alias("r"))
    given = F.concat(F.transform("r", lambda x: x["cells"]), F.array(F.array(F.lit(""), F.lit(" "))))
    return rows.select(F.col("n_regionkey").alias("id"), markers.table_lines(given).alias("lines"), markers.table_markdown(given).alias("markdown"))


@query("SELECT doc_id, sha256(CAST(to_json({'doc_id': doc_id, 'lang': lang, 'source': source}) AS VARCHAR)) AS digest FROM documents")
def record_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", markers.record_hash(source=F.col("source"), lang=F.col("lang"), doc_id=F.col("doc_id")).alias("digest"))


@query("SELECT lang, count(*) AS n, coalesce(format('{:.1f}%', 100 * avg(quality)), 'n/a') AS quality, coalesce(format('{:.4f}', avg(toxic)), 'n/a') AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def formatted_shares(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), markers.percent(F.avg("quality")).alias("quality"), markers.four(F.avg("toxic")).alias("toxic"))


@query(f"WITH {_EL} SELECT doc_id, place, CASE WHEN length(text) > 40 THEN rtrim(left(text, 39)) || '…' ELSE text END AS shown FROM els")
def text_previews(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d).select("doc_id", "place", preview(F.col("text"), 40).alias("shown"))


_SETS = "s AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark)"


@query(f"WITH {_SETS} SELECT a.item_id AS id, b.item_id AS other, round(CASE WHEN len(list_distinct(a.t || b.t)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) END, 6) AS jaccard FROM s a JOIN s b ON b.item_id = a.item_id + 1")
def pair_jaccard(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("t"))
    other = sets.select(F.col("item_id").alias("other"), F.col("t").alias("u"), (F.col("item_id") - 1).alias("item_id"))
    return sets.join(other, "item_id").select(F.col("item_id").alias("id"), "other", F.round(jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


@query(f"""WITH {_EL}, p AS (SELECT doc_id, list(DISTINCT page ORDER BY page) AS g FROM els WHERE kind IN ('table', 'clause') GROUP BY doc_id)
  SELECT doc_id, CASE WHEN len(g) = 1 THEN 'PDF p. ' || g[1] WHEN g[-1] - g[1] + 1 = len(g) THEN 'PDF pp. ' || g[1] || '–' || g[-1] ELSE 'PDF pp. ' || array_to_string(g, ', ') END AS shown FROM p""")
def page_displays(spark: SparkSession, d: str) -> DataFrame:
    pages = _elements(spark, d).filter("kind in ('table', 'clause')").groupBy("doc_id").agg(F.collect_set("page").alias("g"))
    return pages.select("doc_id", page_display(F.col("g")).alias("shown"))


_SPECS = [(0, "starts", "the", False), (1, "contains", "Of", True), (2, "exact", "and", False), (3, "regex", "[0-9]{2}", True), (4, "regex", "^the .*on", False)]
_TESTS = {0: "starts_with(lower(e.text), 'the')", 1: "contains(e.text, 'Of')", 2: "lower(e.text) = 'and'", 3: "regexp_matches(e.text, '[0-9]{2}')", 4: "regexp_matches(e.text, '(?i)^the .*on')"}


@query(f"""WITH {_EL}, specs AS (SELECT doc_id * 10 + k AS spec_id, doc_id, k, doc_id % 3 AS expected FROM documents, range(5) r(k) WHERE doc_id % 2 = 0), c AS (SELECT spec_id, expected, count(*) FILTER (CASE k {" ".join(f"WHEN {k} THEN {t}" for k, t in _TESTS.items())} END) AS found
  FROM specs s LEFT JOIN els e ON e.doc_id = s.doc_id AND e.kind = 'paragraph' GROUP BY ALL) SELECT spec_id, expected, found, expected = found AS passed FROM c""")
def golden_matches(spark: SparkSession, d: str) -> DataFrame:
    rules = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(m).alias("match"), F.lit(w).alias("wanted"), F.lit(c).alias("exact_case")) for k, m, w, c in _SPECS))
    specs = table(spark, d, "documents").filter("doc_id % 2 = 0").select("doc_id", F.explode(rules).alias("r"), (F.col("doc_id") % 3).alias("expected"))
    specs = specs.select((F.col("doc_id") * 10 + F.col("r.k")).alias("spec_id"), "doc_id", F.lit("paragraph").alias("kind"), "r.match", "r.wanted", "r.exact_case", "expected")
    return evaluation.golden(specs, _elements(spark, d))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT item_id, md5(text) FROM benchmark")
def upserted_documents(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return records.upserted(table(spark, d, "documents").select("doc_id", "text"), new, "doc_id").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    deleted = table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("vec_id"))
    return records.cascaded(table(spark, d, "embeddings").select("vec_id", "label"), deleted, "vec_id")


@query("WITH kept AS (SELECT doc_id, 'o' || doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT item_id, 'n' || item_id FROM benchmark) SELECT 'o' || vec_id AS chunk_id FROM embeddings WHERE 'o' || vec_id IN (SELECT chunk_id FROM kept)")
def replaced_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings that are left when the benchmark's texts replace documents of the same number."""
    named = lambda t, key, mark: table(spark, d, t).select(F.col(key).alias("doc_id"), F.concat(F.lit(mark), F.col(key).cast("string")).alias("chunk_id"))
    return records.replaced(named("documents", "doc_id", "o"), named("embeddings", "vec_id", "o").select("chunk_id"), named("benchmark", "item_id", "n"))[1]


@query("SELECT event_id, ts FROM events WHERE ts IS NOT NULL")
def newest_events(spark: SparkSession, d: str) -> DataFrame:
    return records.newest_first(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id")


@query("SELECT vec_id, len(embedding) AS n FROM embeddings")
def checked_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return records.checked_vectors(table(spark, d, "embeddings"), "embedding").select("vec_id", F.size("embedding").cast("long").alias("n"))


_COSINE = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"


@query(f"""WITH v AS (SELECT e.* FROM embeddings e JOIN documents ON doc_id = vec_id WHERE label IN (1, 2, 3) AND lang IN ('en', 'de')) SELECT query_id, item_id, round(s, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS item_id, {_COSINE} AS s, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COSINE}, 9) DESC, v.vec_id) AS INTEGER) AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, v) WHERE rank <= 5""")
def dense_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Search within a scope: documents by language stand for the document, labels for the type."""
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("doc_id")).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("kind")), "item_id")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.lit("m").alias("model"))
    within = retrieval.scoped(chunks, vectors, documents=["en", "de"], kinds=[1, 2, 3], model="m")
    asked = vectors.filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vector")
    return _rounded(retrieval.dense_search(asked, within.select("item_id", "vector"), 5), "score")


@query("SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'Represent this sentence for searching relevant passages: ' ELSE '' END || trim(text) AS asked FROM benchmark")
def query_prefixes(spark: SparkSession, d: str) -> DataFrame:
    model = F.when(F.col("item_id") % 2 == 0, "BAAI/bge-small-en-v1.5").otherwise("BAAI/bge-m3")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), retrieval.prefixed(F.col("text"), model).alias("asked"))


@query("""SELECT doc_id AS query_id, points, round(c / points, 6) AS completeness, round(r / 2, 6) AS relevance FROM (SELECT doc_id, 3 AS points, quality + 0.5::DOUBLE * toxic + CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN 0.5 ELSE 0 END::DOUBLE AS c, CASE WHEN doc_id % 5 < 3 THEN doc_id % 5 END AS r FROM labels)""")
def semantic_questions(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.semantic_scores(_labels(spark, d).filter("label <> '4' and label <> '3'"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of points and relevance, made from those of documents."""
    third = F.element_at(F.array(*map(F.lit, ("covered", "partial", "missing"))), (F.col("doc_id") % 3 + 1).cast("int"))
    pairs = [("point", F.when(F.col("quality") == 1, "covered").otherwise("missing")), ("point", F.when(F.col("toxic") == 1, "partial").otherwise("missing")), ("point", third), ("relevance", (F.col("doc_id") % 5).cast("string"))]
    made = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("label")) for k, v in pairs))
    return table(spark, d, "labels").select(F.col("doc_id").alias("query_id"), F.explode(made).alias("l")).select("query_id", "l.kind", "l.label")


@query("""SELECT doc_id AS query_id, 'relevance' AS kind, CASE WHEN doc_id % 7 = 0 THEN 'unknown_question' ELSE 'label_outside_domain' END AS code FROM labels WHERE doc_id % 7 = 0 OR doc_id % 5 >= 3
  UNION ALL SELECT doc_id, 'point', 'unknown_question' FROM labels, range(3) WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'relevance', 'label_given_twice' FROM labels WHERE doc_id % 11 = 0
  UNION ALL SELECT doc_id, 'relevance', CASE WHEN doc_id % 7 = 0 THEN 'unknown_question' ELSE 'label_outside_domain' END FROM labels WHERE doc_id % 11 = 0 AND (doc_id % 7 = 0 OR doc_id % 5 >= 3)""")
def label_faults(spark: SparkSession, d: str) -> DataFrame:
    labels = _labels(spark, d)
    twice = labels.filter("kind = 'relevance' and query_id % 11 = 0")
    known = table(spark, d, "labels").filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("query_id"))
    return evaluation.label_errors(labels.unionByName(twice), known)


_RESPONSES = """r AS (SELECT l_orderkey AS id, CASE l_orderkey % 4 WHEN 0 THEN 'insufficient_evidence' WHEN 3 THEN 'unsure' ELSE 'answered' END AS status, CAST(l_orderkey % 3 AS INTEGER) AS n_claims, CAST(max(l_linenumber) AS INTEGER) AS n_cit,
  list(l_linenumber ORDER BY l_linenumber) AS markers, list(DISTINCT l_linestatus ORDER BY l_linestatus) AS named, list(CASE WHEN l_linenumber = 2 THEN 'X' ELSE l_linestatus END ORDER BY l_linenumber) AS cited FROM lineitem GROUP BY l_orderkey)"""


@query(f"""WITH {_RESPONSES}, e AS (SELECT id, CASE WHEN status = 'insufficient_evidence' THEN [CASE WHEN n_claims > 0 THEN 'abstention_with_claims' END, CASE WHEN n_cit > 0 THEN 'abstention_with_citations' END] ELSE
  [CASE WHEN status <> 'answered' THEN 'unknown_status' END, CASE WHEN n_claims = 0 THEN 'answer_without_claims' END, CASE WHEN n_cit <> len(markers) THEN 'citation_count' END, CASE WHEN list_sort(markers) <> range(1, len(markers) + 1) THEN 'marker_run' END,
  CASE WHEN len(list_filter(named, lambda x: NOT list_contains(cited, x))) > 0 THEN 'claim_not_cited' END, CASE WHEN len(list_filter(cited, lambda x: NOT list_contains(named, x))) > 0 THEN 'citation_without_claim' END, CASE WHEN len(cited) <> len(list_distinct(cited)) THEN 'repeated_citation' END] END AS e FROM r)
  SELECT id AS response_id, array_to_string(list_filter(e, lambda x: x IS NOT NULL), ' ') AS errors FROM e""")
def answer_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand in for responses, their lines for citations."""
    key = F.col("l_orderkey")
    given = table(spark, d, "lineitem").withColumn("cited", F.when(F.col("l_linenumber") == 2, "X").otherwise(F.col("l_linestatus")))
    grouped = given.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n_citations"), F.collect_list(F.col("l_linenumber").cast("long")).alias("markers"), F.collect_set("l_linestatus").alias("named"), F.collect_list("cited").alias("cited"))
    status = F.when(key % 4 == 0, "insufficient_evidence").when(key % 4 == 3, "unsure").otherwise("answered")
    found = evaluation.answer_errors(grouped.select(key.alias("response_id"), status.alias("status"), (key % 3).alias("n_claims"), "n_citations", "markers", "named", "cited"))
    return found.select("response_id", F.array_join("errors", " ").alias("errors"))


_SECTIONS = """sec AS (SELECT doc_id, place AS section_id, CASE WHEN place % 5 = 0 THEN NULL WHEN place % 7 = 1 THEN place WHEN place % 11 = 2 THEN place + 1000 ELSE lag(place) OVER w END AS parent_id, CASE WHEN place % 9 = 4 THEN place + 1 ELSE place END AS source, page + CASE WHEN place % 6 = 3 THEN 1 ELSE 0 END AS page,
  place % 4 AS level, place AS ordinal FROM els WHERE kind = 'section_header' WINDOW w AS (PARTITION BY doc_id ORDER BY place))"""
_FOUND_SECTIONS = """sf AS (SELECT s.doc_id, s.section_id AS subject, CASE WHEN e.kind IS NULL THEN 'section_source_missing' WHEN e.kind <> 'section_header' THEN 'section_source_type' WHEN e.page <> s.page THEN 'section_page_mismatch' END AS code FROM sec s LEFT JOIN els e ON e.doc_id = s.doc_id AND e.place = s.source
  UNION ALL SELECT s.doc_id, s.section_id, CASE WHEN s.parent_id IS NULL THEN NULL WHEN s.parent_id = s.section_id THEN 'section_self_parent' WHEN p.section_id IS NULL THEN 'section_parent_missing' WHEN p.ordinal >= s.ordinal THEN 'section_parent_not_before_child' WHEN p.level >= s.level THEN 'section_level_conflict' END FROM sec s LEFT JOIN sec p ON p.doc_id = s.doc_id AND p.section_id = s.parent_id)"""


def _sections(spark: SparkSession, d: str) -> DataFrame:
    place = F.col("place")
    before = F.lag("place").over(elements.Window.partitionBy("doc_id").orderBy("place"))
    parent = F.when(place % 5 == 0, None).when(place % 7 == 1, place).when(place % 11 == 2, place + 1000).otherwise(before)
    heads = _elements(spark, d).filter("kind = 'section_header'")
    return heads.select("doc_id", place.alias("section_id"), parent.alias("parent_id"), F.when(place % 9 == 4, place + 1).otherwise(place).alias("source"), F.expr("page + if(place % 6 = 3, 1, 0)").alias("page"), (place % 4).alias("level"), place.alias("ordinal"))


@query(f"WITH {_EL}, {_SECTIONS}, {_FOUND_SECTIONS} SELECT doc_id, CAST(subject AS VARCHAR) AS subject, code FROM sf WHERE code IS NOT NULL")
def section_findings(spark: SparkSession, d: str) -> DataFrame:
    return integrity.section_findings(_sections(spark, d), _elements(spark, d))


_CLAUSES = """cl AS (SELECT doc_id, place AS clause_id, kind, CASE WHEN kind = 'subclause' AND place % 5 <> 0 THEN last_value(CASE WHEN kind = 'clause' THEN place END IGNORE NULLS) OVER w END AS parent_id, CASE WHEN place % 10 = 3 THEN 5000 ELSE section END AS section_id, place AS source, page, length(text) % 4 AS number, place AS ordinal
  FROM els WHERE kind IN ('clause', 'subclause') WINDOW w AS (PARTITION BY doc_id ORDER BY place))"""
_FOUND_CLAUSES = """cf AS (SELECT c.doc_id, c.clause_id AS subject, 'clause_section_missing' AS code FROM cl c WHERE section_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sec s WHERE s.doc_id = c.doc_id AND s.section_id = c.section_id)
  UNION ALL SELECT c.doc_id, c.clause_id, CASE WHEN c.parent_id IS NULL AND c.kind = 'subclause' THEN 'subclause_without_parent' WHEN c.parent_id IS NULL THEN NULL WHEN p.clause_id IS NULL THEN 'clause_parent_missing' WHEN p.section_id IS DISTINCT FROM c.section_id THEN 'clause_parent_section_conflict' END FROM cl c LEFT JOIN cl p ON p.doc_id = c.doc_id AND p.clause_id = c.parent_id
  UNION ALL SELECT doc_id, clause_id, CASE WHEN number < b THEN 'clause_sibling_order' WHEN number > b + 1 THEN 'clause_sibling_gap' END FROM (SELECT *, lag(number) OVER (PARTITION BY doc_id, section_id, parent_id, kind ORDER BY ordinal) AS b FROM cl WHERE kind = 'clause' OR parent_id IS NOT NULL)
  UNION ALL SELECT doc_id, min(clause_id), CASE WHEN kind = 'subclause' THEN 'duplicate_subclause_marker' ELSE 'duplicate_clause_number' END FROM cl GROUP BY doc_id, section_id, parent_id, kind, number HAVING count(*) > 1)"""


def _clauses(spark: SparkSession, d: str) -> DataFrame:
    place = F.col("place")
    found = _elements(spark, d).filter("kind in ('clause', 'subclause')")
    last = F.last(F.when(F.col("kind") == "clause", place), ignorenulls=True).over(elements.Window.partitionBy("doc_id").orderBy("place"))
    parent = F.when((F.col("kind") == "subclause") & (place % 5 != 0), last)
    return found.select("doc_id", place.alias("clause_id"), "kind", parent.alias("parent_id"), F.when(place % 10 == 3, 5000).otherwise(F.col("section")).alias("section_id"), place.alias("source"), "page", (F.length("text") % 4).alias("number"), place.alias("ordinal"))


@query(f"WITH {_EL}, {_SECTIONS}, {_CLAUSES}, {_FOUND_CLAUSES} SELECT doc_id, CAST(subject AS VARCHAR) AS subject, code FROM cf WHERE code IS NOT NULL")
def clause_findings(spark: SparkSession, d: str) -> DataFrame:
    return integrity.clause_findings(_clauses(spark, d), _sections(spark, d), _elements(spark, d))


_RELATIONS = """rel AS (SELECT doc_id, place // 2 AS relation_id, CASE WHEN place % 3 = 0 THEN 'belongs' ELSE 'continues' END AS kind, place AS source, CASE place % 7 WHEN 0 THEN place WHEN 1 THEN place - 1 WHEN 2 THEN place + 17 WHEN 3 THEN place + 100000 ELSE place + 1 END AS target FROM els WHERE kind IN ('paragraph', 'table'))"""


@query(f"""WITH {_EL}, {_RELATIONS} SELECT doc_id, CAST(relation_id AS VARCHAR) AS subject, 'duplicate_relation_id' AS code FROM rel GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT * FROM (SELECT r.doc_id, CAST(r.relation_id AS VARCHAR), CASE WHEN t.place IS NULL THEN 'relationship_dangling' WHEN r.source = r.target THEN 'relationship_self' WHEN r.kind = 'continues' AND r.target < r.source THEN 'continues_not_forward'
  WHEN r.kind = 'continues' AND s.kind <> t.kind THEN 'continues_type_mismatch' WHEN r.kind = 'continues' AND t.page - s.page > 1 THEN 'continues_page_gap' END AS code FROM rel r JOIN els s ON s.doc_id = r.doc_id AND s.place = r.source LEFT JOIN els t ON t.doc_id = r.doc_id AND t.place = r.target) WHERE code IS NOT NULL""")
def relation_findings(spark: SparkSession, d: str) -> DataFrame:
    place = F.col("place")
    target = F.when(place % 7 == 0, place).when(place % 7 == 1, place - 1).when(place % 7 == 2, place + 17).when(place % 7 == 3, place + 100000).otherwise(place + 1)
    found = _elements(spark, d)
    relations = found.filter("kind in ('paragraph', 'table')").select("doc_id", F.expr("place div 2").alias("relation_id"), F.when(place % 3 == 0, "belongs").otherwise("continues").alias("kind"), place.alias("source"), target.alias("target"))
    return integrity.relation_findings(relations, found)


_WARN = "('section_level_conflict', 'clause_sibling_gap', 'subclause_without_parent', 'clause_sibling_order')"


@query(f"""WITH {_EL}, {_SECTIONS}, {_FOUND_SECTIONS}, {_CLAUSES}, {_FOUND_CLAUSES}, f AS (SELECT doc_id, code FROM sf WHERE code IS NOT NULL UNION ALL SELECT doc_id, code FROM cf WHERE code IS NOT NULL),
  k AS (SELECT d.doc_id, count(*) FILTER (code NOT IN {_WARN}) AS errors, count(*) FILTER (code IN {_WARN}) AS warnings, count(*) FILTER (code IN {_WARN} AND code <> 'clause_sibling_order') AS reviews FROM documents d LEFT JOIN f USING (doc_id) GROUP BY ALL)
  SELECT doc_id, errors, warnings, CASE WHEN errors > 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN errors > 0 THEN 'blocked' WHEN reviews > 0 THEN 'review_required' ELSE 'clear' END AS semantic_status FROM k""")
def review_states(spark: SparkSession, d: str) -> DataFrame:
    found = _elements(spark, d)
    sections, clauses = _sections(spark, d), _clauses(spark, d)
    return integrity.review_state(table(spark, d, "documents"), evaluation.findings(integrity.section_findings(sections, found), integrity.clause_findings(clauses, sections, found)))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 IN (1, 2, 3)")
def parent_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Customers point to one another: three of ten in a ring, the fourth and fifth to none, the others in a chain."""
    key = F.col("c_custkey")
    parent = F.when(key % 10 == 1, key + 2).when(key % 10 == 2, key - 1).when(key % 10 == 3, key - 1).when(key % 10 > 4, key - 1)
    return integrity.on_cycles(table(spark, d, "customer").select(key.alias("id"), parent.alias("parent")), "id", "parent")


_SAYS = "(regexp_matches(lower(trim({0})), ':$') OR regexp_matches({0}, '(?i)following (authorities|information|categories)') OR regexp_matches(lower({0}), '(?s)\\bentails?\\b.*\\b(two|three|four|five|[0-9]+)\\b.*:') OR regexp_matches(lower({0}), '(?s)\\b(includes?|comprises?|consists of|sets out)\\b.*:'))"
_STRUCTURAL = f"""c AS (SELECT doc_id, place AS i, CASE kind WHEN 'definition' THEN 'mixed' ELSE kind END AS kind, text || CASE length(text) % 3 WHEN 0 THEN ':' WHEN 1 THEN ' and' ELSE '' END AS text, page, section FROM els
), seeds AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank FROM c WHERE i % 6 = 2
), around AS (SELECT a.doc_id, a.i AS seed, s.rank, t.step, n.i, n.kind, n.text, a.kind AS s_kind, a.text AS s_text, coalesce(n.kind IS NOT NULL AND n.section IS NOT DISTINCT FROM a.section AND abs(n.page - a.page) <= 1, false) AS fits
  FROM seeds s JOIN c a ON a.doc_id = s.doc_id AND a.i = s.i CROSS JOIN (VALUES (-1), (1), (2)) t(step) LEFT JOIN c n ON n.doc_id = a.doc_id AND n.i = a.i + t.step
), stops AS (SELECT *, coalesce(min(CASE WHEN step > 0 AND NOT (fits AND kind IN ('list_item', 'table', 'mixed', 'subclause')) THEN step END) OVER (PARTITION BY doc_id, seed), 3) AS stop FROM around
), ruled AS (SELECT *, CASE WHEN s_kind IN ('list_item', 'table', 'mixed', 'subclause') AND step = -1 AND {_SAYS.format("text")} THEN 1 WHEN step = 1 AND kind = 'table' AND s_kind <> 'table' THEN 2
  WHEN step = 1 AND kind = 'list_item' AND regexp_matches(lower(trim(s_text)), '\\b(and|or)\\s*$') THEN 4 WHEN {_SAYS.format("s_text")} AND step > 0 AND step < stop THEN 3 END AS r FROM stops WHERE fits
), met AS (SELECT m.doc_id, m.i, m.rank, CASE r WHEN 4 THEN 2 ELSE r END AS rule, m.step, ['preceding_intro', 'following_table', 'introduced_child', 'continuation_list_item'][r] AS reason, z.rank AS seed_rank FROM ruled m LEFT JOIN seeds z ON z.doc_id = m.doc_id AND z.i = m.i WHERE r IS NOT NULL
), news AS (SELECT *, CASE WHEN seed_rank IS NULL AND row_number() OVER (PARTITION BY doc_id, i ORDER BY rank, rule, step) = 1 THEN 1 ELSE 0 END AS new FROM met
), runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY rank, rule, step ROWS UNBOUNDED PRECEDING) AS upto, (SELECT count(*) FROM seeds s WHERE s.doc_id = news.doc_id) AS n FROM news
), kept AS (SELECT * FROM (SELECT *, min(upto - new) OVER (PARTITION BY doc_id, rank) AS before FROM runs) WHERE upto + n <= 9 AND before + n < 9
), rows AS (SELECT doc_id, i, rank, NULL AS seed_rank, rule, step, reason FROM kept UNION ALL SELECT doc_id, i, rank, rank, 0, 0, 'ranked_seed' FROM seeds
), grouped AS (SELECT doc_id, i, min(rank) AS source_rank, max(seed_rank) AS seed_rank, string_agg(reason, ' ' ORDER BY CASE WHEN reason = 'ranked_seed' THEN 0 ELSE rank END, rule, step) AS reasons FROM rows GROUP BY doc_id, i)"""


@query(f"""WITH {_EL}, {_STRUCTURAL} SELECT doc_id AS query_id, i AS chunk_index, CAST(source_rank AS INTEGER) AS source_rank, CAST(seed_rank AS INTEGER) AS ranked_seed_rank, split_part(reasons, ' ', 1) AS first_reason,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY source_rank, i, seed_rank IS NULL) AS INTEGER) AS context_order FROM grouped""")
def structural_context(spark: SparkSession, d: str) -> DataFrame:
    """Every sixth element of a document is a hit on a chunk; nine chunks of context at most."""
    found = _elements(spark, d)
    n = F.length("text") % 3
    text = F.concat("text", F.when(n == 0, ":").when(n == 1, " and").otherwise(""))
    kind = F.when(F.col("kind") == "definition", "mixed").otherwise(F.col("kind"))
    chunks = found.select("doc_id", F.col("place").alias("chunk_index"), kind.alias("kind"), text.alias("text"), F.array("page").alias("pages"), F.array(F.col("section").cast("string")).alias("section_path"))
    rank = F.row_number().over(elements.Window.partitionBy("doc_id").orderBy("chunk_index"))
    seeds = chunks.filter("chunk_index % 6 = 2").select(F.col("doc_id").alias("query_id"), "doc_id", "chunk_index", rank.alias("rank"))
    got = evidence.structural(seeds, chunks, most=9)
    return got.select("query_id", "chunk_index", "source_rank", "ranked_seed_rank", F.get("reasons", F.lit(0)).alias("first_reason"), "context_order")
