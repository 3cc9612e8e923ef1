"""Operators of the llm subpackage against brute force, round trips and held-out labels, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.compare import duck, spark_rows

from tessera.llm import html_text, langid, lattice, line_dedup, matroska, minhash, mix, pack, quality, queries, scratch, wordhash
from tessera.llm.chat import format_chats
from tessera.llm.links import near_components

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, ties, repeated rows, a long text.
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one", "en", None, 3), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3), (None, "two words here", None, "b", 1), (7, "x" * 40_000, "en", "b", 1), (8, "word " * 30_000, "de", "b", 1), (9, "1234 !!", "en", "c", 7)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def components(items, similar):
    """Smallest key that each key reaches over pairs that share an item and are similar."""
    parent, seen = {k: k for k in items}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in sorted(items):
        near = Counter(o for i in items[k] for o in seen.get(i, ()))
        for i in items[k]:
            seen.setdefault(i, []).append(k)
        for o, n in near.items():
            if similar(n, len(items[k]) + len(items[o]) - n):
                a, b = root(k), root(o)
                parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in items}


# Near-duplicates.


def test_near_duplicates_equal_brute_force(spark, documents):
    sets = {d: set(zip(w, w[1:], strict=False)) if len(w := words(t.encode().lower().decode())) > 1 else set(map(tuple, [w] if w else [])) for d, t in documents}
    expected = components(sets, lambda n, union: 100 * n >= 80 * union)
    got = queries.op9_minhash_dedup(spark, FOLDER).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {d: (len(sets[d]), c, c == d) for d, c in expected.items()}


def test_near_duplicate_group_around_the_threshold(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.06 else f"x{rng.random()}" for w in base)) for i in range(150)]
    sets = {d: set(zip(w, w[1:], strict=False)) for d, t in rows for w in [t.split()]}
    expected = components(sets, lambda n, union: 100 * n >= 80 * union)
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark, odd, 2).collect())
    assert got == [(-1, 2, None, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 9, True)]
    assert minhash.near_duplicates(spark, empty, 2).count() == 0
    assert sorted(r["doc_id"] or 0 for r in minhash.one_of_each(spark, odd, 2).collect()) == [0, 1, 2, 3, 4, 7, 8, 9]


def test_pigeonhole_of_chunk_keys():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash.SYMBOLS, minhash.MOST, replace=False)
        row[at] ^= np.uint16(1)
    assert all(set(x) & set(y) for x, y in zip(minhash.chunk_keys(a).tolist(), minhash.chunk_keys(b).tolist(), strict=True))


# Lines.


def test_line_dedup_equals_brute_force(spark, documents):
    anchor = re.compile(line_dedup._ANCHOR.replace("++", "+").replace("}+)", "})"))
    lines = [(d, i, x.lower()) for d, t in documents for i, x in enumerate(t.split("\n")) if len(x) >= line_dedup.SHORTEST]
    keys = {x: k for k, x in enumerate(dict.fromkeys(x for _, _, x in lines))}
    groups = components({k: set(anchor.findall(x)) for x, k in keys.items()}, lambda n, union: 100 * n >= 80 * union)
    seen, gone = set(), set()
    for d, i, x in lines:
        if groups[keys[x]] in seen:
            gone.add((d, i))
        seen.add(groups[keys[x]])
    expected = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in documents}
    assert gone
    assert {r["doc_id"]: r["text"] for r in queries.op5_line_dedup(spark, FOLDER).collect()} == expected


def test_line_dedup_of_odd_rows(spark, odd, empty):
    long = "a line that is long enough to count as one"
    near = "this passage of many quite ordinary words is repeated almost as it stands in more than one of the documents here"
    rows = [(1, f"{long}\nshort\n{near}", 0), (2, f"short\n{near.replace('quite ', '')}\n{long.upper()}", 0), (3, None, 0), (4, "", 0), (5, f"{long}\n{long}", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lid long")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_kept"]) for r in line_dedup.dedup_lines(spark, df).collect()}
    assert got[1] == (f"{long}\nshort\n{near}", 3, 3)
    assert got[2][0].startswith("short") and long.upper() not in got[2][0]
    assert got[3] == (None, 0, 0) and got[4] == ("", 1, 1) and got[5] == ("", 2, 0)
    assert line_dedup.dedup_lines(spark, odd).count() == len(ODD)
    assert line_dedup.dedup_lines(spark, empty).count() == 0


def without_repeats(rows, shortest=1):
    """Texts of (doc_id, text) by brute force: shingles of twelve characters at every place, cut here."""
    lines = [(d, i, x.lower()) for d, t in rows for i, x in enumerate(t.split("\n")) if len(x) >= shortest and x.strip()]
    keys = {x: k for k, x in enumerate(dict.fromkeys(x for _, _, x in lines))}
    groups = components({k: {x[i : i + 12] for i in range(len(x) - 11)} for x, k in keys.items()}, lambda n, union: 100 * n >= 80 * union)
    seen, gone = set(), set()
    for d, i, x in lines:
        if groups[keys[x]] in seen:
            gone.add((d, i))
        seen.add(groups[keys[x]])
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_line_dedup_shingles_at_every_character(spark, documents):
    rows = [*documents, (10_001, "Licensed under the Apache License, Version 2.0."), (10_002, "Licensed under the Apache License, Version 2.1.\nNothing of this line stands in any other place.")]
    expected = without_repeats(rows, line_dedup.SHORTEST)
    assert expected[10_002] == "Nothing of this line stands in any other place."
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark, df, line_dedup.SHORTEST).collect()} == expected


def test_short_lines_are_deduplicated(spark):
    import corpus_pipeline

    rows = [(1, "And ornd.\n\nAmen"), (2, "and ornd.\n\n  \nAmen\nBut this"), (3, "Amen\nOx")]
    expected = {1: "And ornd.\n\nAmen", 2: "\n  \nBut this", 3: "Ox"}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert expected == without_repeats(rows)
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.distinct_lines(spark, df, FOLDER).collect()} == expected


def test_bands_hold_the_nearest_distinct_hashes(spark):
    lines = ["a" * 300, "ab" * 200, "-" * 60 + "twelve or more different characters" + "-" * 90, "abcdefghijkl", "short", "", "no shingle of this line is in it twice"]
    df = spark.createDataFrame(list(enumerate(lines)), "lid int, line string").select("lid", line_dedup.shingle_hashes(F.col("line")).alias("items"))
    items = {r["lid"]: set(r["items"]) for r in df.collect()}
    assert {k: len(x) for k, x in items.items()} == {k: len({x[i : i + 12] for i in range(len(x) - 11)}) for k, x in enumerate(lines)}
    runs = []
    for k, x in items.items():
        for i, p in enumerate(line_dedup.POINTS):
            runs.append((k, 2 * i, sorted(x, key=lambda h: (h - p) % (1 << 64))[:3]))
            runs.append((k, 2 * i + 1, sorted(x, key=lambda h: (p - h) % (1 << 64))[:3]))
    wanted = spark.createDataFrame(runs, "lid int, band int, run array<long>").select("lid", "band", F.xxhash64("band", "run").alias("key"))
    expected = {(r["lid"], r["band"]): r["key"] for r in wanted.collect()}
    assert {(r["lid"], i): key for r in line_dedup.with_bands(df).collect() for i, key in enumerate(r["keys"])} == expected


def test_code_of_bands_is_small_enough_to_be_compiled(spark):
    lines = spark.createDataFrame([(1, "no shingle of this line is in it twice")], "lid int, line string")
    plan = line_dedup.with_bands(lines.select("lid", line_dedup.shingle_hashes(F.col("line")).alias("items")))._jdf.queryExecution().executedPlan()
    parts = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    assert sizes and max(sizes) < 8000  # the JVM interprets longer methods


def keyed_components(spark, keys, sets, monkeypatch):
    """Components of sets that share a key, and how many nodes came to be compared beyond their group's smallest."""
    stored = []
    table = scratch.Scratch.table
    monkeypatch.setattr(scratch.Scratch, "table", lambda self, df, *a, **b: stored.append(made := table(self, df, *a, **b)) or ("outers" in df.columns and "items" in df.columns and counts.append(made.count())) or made)
    counts = []
    nodes = spark.createDataFrame([(n, sorted(k)) for n, k in keys.items()], "node long, q array<long>")
    items = spark.createDataFrame([(n, sorted(x)) for n, x in sets.items()], "node long, items array<long>")
    apart = lambda x, y: F.when(F.arrays_overlap(x, y), 0).otherwise(1)
    found = near_components(nodes, nodes.select(F.explode("q").alias("key"), "node"), lambda wanted: items.join(wanted, "node"), percent=80, apart_by=apart, most=0, scratch=scratch.Scratch(spark, "keyed"))
    return {r["node"]: r["comp"] for r in found.collect()}, sum(counts)


def test_pairs_with_a_smallest_node_are_compared_once(spark, monkeypatch):
    keys = {1: {10}, 2: {10}, 3: {11, 12}, 4: {11}, 5: {12}}
    assert keyed_components(spark, keys, {n: {n, n + 100} for n in keys}, monkeypatch) == ({}, 0)


def test_links_by_shared_keys_equal_brute_force(spark, monkeypatch):
    chance = random.Random(5)
    bases = [set(range(100 * k, 100 * k + 20)) for k in range(12)]
    sets = {n: set(chance.sample(sorted(bases[n % 12]), chance.choice([17, 18, 19, 20]))) for n in range(150)}
    keys = {n: {chance.randrange(60), 100 + chance.randrange(25)} for n in sets}
    parent = {n: n for n in sets}
    for a in sets:
        for b in sets:
            if a < b and keys[a] & keys[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((parent[a], parent[b]))
                parent = {n: low if p == high else p for n, p in parent.items()}
    expected = {n: p for n, p in parent.items() if list(parent.values()).count(p) > 1}
    assert len(expected) > 20
    assert keyed_components(spark, keys, sets, monkeypatch)[0] == expected


def test_line_dedup_stores_lines_and_not_their_shingles(spark, documents, monkeypatch):
    stored = []
    table = scratch.Scratch.table
    monkeypatch.setattr(scratch.Scratch, "table", lambda self, df, *a, **b: stored.append(df.dtypes) or table(self, df, *a, **b))
    line_dedup.dedup_lines(spark, spark.createDataFrame(documents[:40], "doc_id long, text string"), line_dedup.SHORTEST)
    kinds = {t for types in stored for name, t in types if name == "items"}
    assert kinds == {"string"}


def test_tables_between_steps_leave_no_shuffle_files(spark):
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = lambda: set(re.findall(r"shuffle_\d+_", store.getAllFiles().mkString("\n")))
    before = left()
    held = [scratch.Scratch(spark, "files").table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()) for _ in range(3)]
    assert not left() - before
    assert [df.count() for df in held] == [7, 7, 7]


# Chats.


def test_chats_equal_sql(spark):
    assert spark_rows(queries.op10_chat(spark, FOLDER)) == duck(FOLDER, queries.oracle_sql()["op10_chat"])


def test_chats_collapse_snapshots(spark):
    a = [(0, "user", "hi"), (1, "assistant", "hello <|im_end|>"), (2, "user", None)]
    rows = [(1, *t) for t in a[:1]] + [(2, *t) for t in a[:2]] + [(3, *t) for t in a] + [(4, *t) for t in a] + [(5, 0, "user", "ho")] + [(5, 0, "user", "ho")] + [(None, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in format_chats(spark, df).collect()}
    assert set(got) == {3, 5} and got[5][0] == 1 and got[3][0] == 3
    assert got[3][1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello <| im_end |><|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert format_chats(spark, df.filter("conv_id > 9")).count() == 0


def test_long_conversations_come_in_parts(spark):
    df = spark.range(2500).selectExpr("1L as conv_id", "id as turn", "'user' as role", "cast(id as string) as text")
    assert sorted((r["part"], r["n_parts"], r["n_turns"], r["text"].count("<|im_start|>")) for r in format_chats(spark, df).collect()) == [(0, 3, 2500, 1024), (1, 3, 2500, 1024), (2, 3, 2500, 452)]


# Pages.


def test_main_text_of_a_page():
    body = "This is the paragraph that is to be kept, and it has a lot of the usual words in it, as it should."
    page = f"""<html><head><title>No</title><script>x="<p>no</p>"</script></head><body class="has-sidebar"><header><a href=/>Home</a></header><nav><ul><li>No</ul></nav>
    <div class="cookie-notice">We use cookies</div><main><article><h1>A &amp; B</h1><p>{body}<br>more&nbsp;text <b>b</b>old<p>Short.</p><div class="ad">Buy</div><aside>Side</aside>
    <form><input>No</form><!-- no --><ul><li><a href=x>linked words only</a></li></ul></article><section id="comments"><article><p>{body}</p></article></section></main><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page) == f"A & B\n\n{body} more text bold\n\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""


def test_blocks_without_an_article_follow_their_neighbours():
    good = "It was the best of times, and it was the worst of times, as all of us have been told in the book."
    page = f"<div><a href=1>Home</a></div><div><a href=2>News</a> <a href=3>More</a></div><p>{good}</p><p>Yes.</p><p>{good}</p><div><a href=4>Next page</a></div><div>Imprint</div>"
    assert html_text.main_text(page) == f"{good}\n\nYes.\n\n{good}"


GOOD = "It was the best of times, and it was the worst of times, as all of us have been told in the book."
ITALIAN = "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita e perduta."
CHINESE = "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。" * 3


@pytest.mark.parametrize(
    ("before", "after", "body"),
    [
        ('<div class="no-ads">', "</div>", GOOD),
        ('<article class="post category-social-media">', "</article>", GOOD),
        ('<article class="post comments-open">', "</article>", GOOD),
        ('<main><div class="content has-overlay">', "</div></main>", GOOD),
        ('<form id="aspnetForm"><main>', "</main></form>", GOOD),
        ('<div class="promo-page related">', "</div>", GOOD),
        ("<div>", "</div>", ITALIAN),
        ("<div>", "</div>", CHINESE),
        ("<div><button>Menu<object>", "</div>", GOOD),
    ],
)
def test_names_and_languages_do_not_cost_the_article(before, after, body):
    page = f"<body><nav><a href=1>Home</a></nav>{before}<p>{body}</p><p>{body} 2</p><p>{body} 3</p><p>{body} 4</p><p>{body} 5</p>{after}<footer>Imprint</footer></body>"
    expected = "\n\n".join([body, *(f"{body} {k}" for k in range(2, 6))])
    assert html_text.main_text(page).removeprefix("Menu\n\n") == expected


def test_what_looks_like_text_beside_an_article_stays_out():
    notice = "<div class='cookie-banner'><p>" + f"{GOOD} " * 9 + "</p></div>"
    said = "<div id='comments'><p>" + f"{GOOD} " * 9 + "</p></div>"
    assert html_text.main_text(f"{notice}<div class='story'><p>{GOOD}</p></div>{said}") == GOOD
    assert html_text.main_text(f"{notice}{said}<a href=1>Home</a>") == ""


def test_short_blocks_follow_the_nearest_decided_block():
    links = "<ul><li><a href=1>First of the other stories</a></li><li><a href=2>Second of the other stories</a></li></ul>"
    page = f"<article><h1>Title</h1><p>{GOOD}</p><p>Yes.</p><p>So.</p><p>More from us</p>{links}<p>{GOOD}</p></article>"
    assert html_text.main_text(page) == f"Title\n\n{GOOD}\n\nYes.\n\nSo.\n\n{GOOD}"


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", None, 0), (2, "u", "", 0), (3, None, f"<p>{GOOD}</p>", 0), (3, None, f"<p>{GOOD}</p>", 0), (None, "u", "<p>" + f"{GOOD} " * 20_000 + "</p>", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = sorted((r["page_id"] or 0, r["url"], r["n_chars"]) for r in html_text.extract(df).collect())
    assert got == sorted([(0, "u", (len(GOOD) + 1) * 20_000 - 1), (1, "u", 0), (2, "u", 0), (3, None, len(GOOD)), (3, None, len(GOOD))], key=lambda r: r[0])
    assert html_text.extract(df.filter("page_id > 9")).count() == 0


def test_pages_keep_their_articles(spark):
    got = queries.op1_html(spark, FOLDER).collect()
    assert len(got) == spark.read.parquet(f"{FOLDER}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in got)


# Packing.


def test_window_cuts_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, width = int(rng.integers(1, 40)), 8
        ends = rng.random(n) < 0.4
        documents = np.unique(np.append(rng.integers(1, n + 1, 3), n))
        cuts = pack.window_cuts(ends, documents, width)

        def price(at):
            return 0.0 if at in documents else pack.SENTENCE_CUT if ends[at - 1] else pack.BROKEN_CUT

        marks = np.union1d(np.flatnonzero(ends) + 1, documents)
        gaps = np.diff(np.concatenate([[0], marks]))
        free = {p for m, g in zip(marks.tolist(), gaps.tolist(), strict=True) if g > width for p in range(m - g + 1, m)} | set(marks.tolist())
        pad = lambda k: 0 if k & (k - 1) == 0 else width - k
        best = [0.0] + [np.inf] * n
        for j in range(1, n + 1):
            if j in free:
                best[j] = price(j) + min(best[i] + pad(j - i) for i in range(max(0, j - width), j))
        paid = sum(pad(b - a) + price(b) for a, b in zip([0, *cuts[:-1]], cuts, strict=True))
        assert cuts[-1] == n and paid == pytest.approx(best[n])


def check_packing(rows, texts, width=1024):
    encode = pack.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    ids = {d: np.append(encode.ids(t or ""), 0).astype("<u4") for d, t in texts}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for d, own in pieces.items():
        assert [s for s, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)]])[:-1].tolist() and sum(n for _, n in own) == len(ids[d])
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)]])[:-1].tolist() and sum(n for _, n in own) <= width
    assert set(pieces) == {d for d, _ in texts}


def test_packing_covers_all_tokens(spark, documents, empty):
    rows = queries.op2_pack(spark, FOLDER).collect()
    check_packing(rows, documents)
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert sum(1024 - n for n in used.values() if n & (n - 1)) < 0.03 * sum(used.values())
    assert pack.pack(empty).count() == 0


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> x"), (4, "日本 naïve x" * 40), (5, "y" * 9000), (6, "a b. " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    check_packing(pack.pack(df).collect(), rows)
    assert all(len(r["ids"]) == r["length"] for r in pack.pack(df).collect())


def test_both_tokenizers_agree(documents):
    from tokenizers import Tokenizer

    encode = pack.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    slow = Tokenizer.from_file(encode.json_path)
    texts = [t for _, t in documents] + ["a<|endoftext|>b", "naïve café", "x\xa0y　z", "tab\tand\r\nline", "  trailing  "]
    assert all(encode.ids(t).tolist() == slow.encode(t, add_special_tokens=False).ids for t in texts)


# Quality.


def test_statistics_equal_brute_force(documents):
    texts = [t for _, t in documents] + ["", "a b c a b c", "x\n\nx\n \ny\nx", "äö # $%"]
    got = quality.statistics(pa.array([*texts, None]))
    assert not got[-1].any()
    for t, s in zip(texts, got.tolist(), strict=False):
        w = words(t)
        runs = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        assert s[:5] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)]


def test_trees_are_monotone_and_hold_out(spark):
    rng = np.random.default_rng(5)
    x = rng.random((3000, len(quality.FEATURES)))
    y = (x[:, 2] + 0.3 * np.sin(9 * x[:, 0]) + 0.1 * rng.standard_normal(3000) < 0.5).astype(int)
    trees = quality.Trees(quality.MONOTONE).fit(x[:2000], y[:2000].astype(float))
    assert ((trees.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    for k in np.flatnonzero(quality.MONOTONE).tolist():
        grid = np.repeat(x[:50], 20, axis=0)
        grid[:, k] = np.tile(np.linspace(0, 1, 20), 50)
        assert (np.diff(trees.probability(grid).reshape(50, 20), axis=1) <= 1e-12).all()


def test_quality_keeps_good_documents(spark, odd, empty):
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, "/root/testdata/sf0.01").collect()}
    good = [r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").collect()]
    assert np.mean([got[d]["kept"] or got[d]["base_failed"] for d in good]) > 0.98
    labels = spark.createDataFrame([(None, 1), (4, None), (8, 0)], "doc_id long, quality int")
    found = [r for r in quality.judge(spark, odd, labels).collect()]
    assert len(found) == len(ODD) and not any(r["kept"] for r in found)
    assert quality.judge(spark, empty, labels).count() == 0


# Mixing.


def test_targets_are_filled_up():
    assert mix.targets([100, 100, 100], [3, 1, 2], 1.5, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mix.targets([0, 10], [3, 1], 1.5, 2) == pytest.approx([0, 15])
    assert mix.targets([], [], 1.5, 2) == []


@pytest.mark.parametrize(("blocks", "quotas"), [([400, 3, 0, 77], [500, 3, 0, 20]), ([10, 11], [20, 22]), ([1, 5], [2, 0])])
def test_splitting_tree_is_exact(blocks, quotas):
    shards = [mix.tree(blocks, quotas, 7, k, 1) for k in range(7)]
    assert [sum(x[s][2] for x in shards) for s in range(len(blocks))] == quotas
    for s, n in enumerate(blocks):  # disjoint ranges that cover all blocks, each with room for its quota
        assert [x[s][0] for x in shards] == np.cumsum([0, *(x[s][1] for x in shards)])[:-1].tolist() and sum(x[s][1] for x in shards) == n
        assert all(x[s][2] <= x[s][1] * -(-quotas[s] // n) for x in shards if n)
        for k, x in enumerate(shards):
            drawn = mix.leaf(x, k, 1)
            uses = Counter(drawn[drawn[:, 0] == s][:, 1].tolist())
            assert sum(uses.values()) == x[s][2] and not uses or max(uses.values()) - min(uses.values()) <= 1
    assert mix.draw(np.random.default_rng(1), [5, 0, 3], 8) == [5, 0, 3]
    assert sum(mix.draw(np.random.default_rng(1), [10**12, 10**10], 10**11)) == 10**11


def test_mix_takes_what_the_shards_draw(spark, documents):
    """Words of each document, by a walk along every source's axis; the shards decide which they are."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = {}
    for shards in (1, 5):
        mixed = mix.Mix(spark, docs, shards=shards)
        quotas = [min(2 * r["blocks"], round(r["target"] * r["blocks"] / r["source_size"])) for r in mixed.sources.orderBy("s").collect()]
        blocks = [r["blocks"] for r in mixed.sources.orderBy("s").collect()]
        uses = Counter((s, b) for k in range(shards) for s, b, _ in mix.leaf(mix.tree(blocks, quotas, shards, k, mix.SEED), k, mix.SEED).tolist())
        rows = mixed.documents.orderBy("s", "start").collect()
        want, at = {}, Counter()
        for r in rows:
            assert r["start"] == at[r["s"]] or not r["size"]
            at[r["s"]] += r["size"]
            want[r["doc_id"]] = sum(uses[r["s"], ((w + 1) * r["blocks"] - 1) // r["source_size"]] for w in range(r["start"], r["start"] + r["size"]))
        found[shards] = {r["doc_id"]: r["taken"] for r in mixed.taken().collect()}
        assert found[shards] == want
        rows = mixed.sharded().collect()
        assert len({r["shard"] for r in rows}) == shards
        for k in range(shards):
            places = [r["place"] for r in rows if r["shard"] == k]
            assert places == sorted(places)
        assert sum(len(words(r["text"])) for r in rows) == sum(want.values())
    assert found[1] != found[5]


def test_mix_meets_targets(spark, documents):
    got = queries.op4_mix(spark, FOLDER).collect()
    again = queries.op4_mix(spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert {r["doc_id"]: r["size"] for r in got} == {d: len(words(t)) for d, t in documents}
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    sums = {}
    for r in got:
        s = sums.setdefault((r["target"], r["source_size"]), [0, 0])
        s[0] += r["taken"]
        s[1] += r["size"]
    assert all(abs(taken - target) <= 2 + target / 100 and size % source == 0 for (target, source), (taken, size) in sums.items())


def test_mixed_texts_are_runs_of_words(spark, odd, empty):
    mixed = mix.Mix(spark, odd)
    assert mixed.taken().count() == len(ODD)
    taken = sum(r["taken"] for r in mixed.taken().collect())
    texts = mixed.texts()
    assert texts.columns == odd.columns and sum(len(words(r["text"])) for r in texts.collect()) == taken
    assert mix.Mix(spark, empty).taken().count() == mix.Mix(spark, empty).texts().count() == 0


# Matroska.


@pytest.mark.parametrize("lacing", ["none", "xiph", "fixed", "ebml"])
@pytest.mark.parametrize("size", [192, 192 * 8, 192 * 1000 + 64])
def test_matroska_round_trip(lacing, size):
    payload = random.Random(size).randbytes(size)
    media = matroska.write_pcm(payload, lacing)
    found = matroska.parse(media)
    assert b"".join(media[o : o + n] for _, _, o, n, _, _ in found.packets) == payload
    assert [t for _, t, *_ in found.packets] == [24.0 * k for k in range(len(found.packets))]
    assert {c[2] for c in found.cues} == {p[5] for p in found.packets} and found.tracks[1]["codec"] == "A_PCM/INT/LIT"
    matroska.parse(media[: len(media) // 2])
    with pytest.raises(ValueError):
        matroska.parse(payload)


def test_unequal_laces_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 5, b"c" * 255, b"d" * 700]
    for lacing in ("xiph", "ebml"):
        data = matroska.lace(frames, lacing)
        assert [data[o : o + n] for o, n in matroska.unlace(data, 0, len(data), matroska.LACING[lacing])] == frames
    media = bytearray(matroska.write_pcm(b"z" * 192 * 1200))
    at = media.index(matroska.SEGMENT.to_bytes(4, "big")) + 4
    width = 9 - media[at].bit_length()
    media[at : at + width] = ((1 << 7 * width + 1) - 1).to_bytes(width, "big")
    assert len(matroska.parse(bytes(media)).packets) == 1200


def test_damaged_files_leave_their_neighbours_alone(spark):
    rng = random.Random(9)
    files = []
    for k in range(600):
        media = bytearray(matroska.write_pcm(rng.randbytes(192 * 20), ["xiph", "ebml", "fixed", "none"][k % 4]))
        for _ in range(rng.randint(1, 6)):
            media[rng.randrange(4, len(media))] = rng.randrange(256)
        files.append((k, bytes(media[: rng.randrange(1, len(media))] if k % 5 == 0 else media)))
    whole = matroska.write_pcm(b"q" * 192)
    df = spark.createDataFrame([*files, (1000, whole), (1001, b"no media"), (1002, None)], "doc_id long, media binary").withColumn("key", F.lit(1))
    rows = matroska.packet_table(df).collect()
    assert [(r["size"], r["error"]) for r in rows if r["doc_id"] == 1000] == [(192, None)]
    assert [(r["size"], r["error"]) for r in rows if r["doc_id"] == 1001] == [(None, "not an EBML file")] and not any(r["doc_id"] == 1002 for r in rows)
    assert any(r["error"] for r in rows if r["doc_id"] < 1000)


def test_stored_media(spark, odd, empty):
    got = [r.asDict() for r in matroska.stored_media(odd).collect()]
    for r, row in zip(sorted(got, key=lambda r: (r["doc_id"] or 0, r["n_bytes"])), sorted(ODD, key=lambda r: (r[0] or 0, len(r[1] or ""))), strict=True):
        raw = (row[1] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    packets = matroska.packet_table(matroska.stored_media(odd))
    assert packets.count() == sum(r["payload_bytes"] // 192 for r in got) and packets.filter("not cued").count() == 0
    assert matroska.stored_media(empty).count() == 0


# Languages.


def test_languages_of_held_out_documents(spark, odd, empty):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in queries.op7_langid(spark, "/root/testdata/sf0.01").collect()]
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark, odd, langid.fold(3) != 1, ["doc_id"]).collect()}
    assert [found[k] for k in (1, 2, 3, 9)] == ["und"] * 4 and found[4] != "und"
    assert langid.identify(spark, empty, langid.fold(3) != 1, ["doc_id"]).count() == 0


def test_profiles_and_floors_come_from_all_rows(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh" if i % 2 else "hijklmn", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 4))) for i in range(4400)]
    docs = spark.createDataFrame([(i, x, "ab"[i % 2 == 0]) for i, x in enumerate(texts)], "doc_id long, text string, lang string").repartition(7)
    vectors = np.concatenate([langid.bundles(texts[i : i + 100])[0] for i in range(0, len(texts), 100)])
    unit = np.array([x / np.linalg.norm(x) for x in (vectors[1::2].sum(axis=0), vectors[::2].sum(axis=0))])
    got = {r["doc_id"]: r["cosine"] for r in langid.identify(spark, docs, F.lit(True)).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx((vectors @ unit.T).max(axis=1).tolist(), abs=1e-5)
    least = langid.floors(docs, unit.astype(np.float32))
    for k in (2, 6):
        heads = np.concatenate([langid.bundles([x[: 1 << k] for x in texts[i : i + 100]])[0] for i in range(0, len(texts), 100)])
        assert least[k] == pytest.approx(langid.LOOSE * np.quantile((heads @ unit.T).max(axis=1), 0.5, method="inverted_cdf"), abs=1e-4)


# Lattice.


def test_lattice_sums_all_segmentations():
    made = lattice.Lattice("piece_bpe_32k.model")
    pieces, log, byte = lattice.vocabulary("piece_bpe_32k.model")

    def total(text):
        f = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            f[j] = f[j - 1] * np.exp(log[[byte[b] for b in text[j - 1].encode()]].sum())
            f[j] += sum(f[i] * np.exp(log[pieces[text[i:j]]]) for i in range(max(0, j - lattice.LONGEST), j) if text[i:j] in pieces)
        return np.log(f[-1])

    words_ = [b"the", b"there", b"zq\xc3\xa9x", "日本".encode(), b"and", b"abcdefghij" * 30]
    for points, places in lattice.by_length(words_):
        wanted = [total("▁" + words_[k].decode()) if len(words_[k]) < 300 else None for k in places.tolist()]
        if None not in wanted:
            assert made.forward(points, log) == pytest.approx(wanted)
        uses = made.expected(points, log, np.ones(len(points)))
        lengths = sum(uses[n] * len(p) for p, n in pieces.items()) + sum(uses[b] for b in byte)
        assert lengths >= points.size * 0.999


def test_lattice_takes_long_words_in_windows(monkeypatch):
    made = lattice.Lattice("piece_bpe_32k.model")
    word = "".join(random.Random(4).choice("abcdeéthin日") for _ in range(700))
    points = next(iter(lattice.by_length([word.encode()])))[0]
    whole = made.forward(points, made.weights)
    monkeypatch.setattr(lattice, "WINDOW", 64)
    assert made.forward(points, made.weights) == pytest.approx(whole)


def test_lattice_scores(spark, documents, odd, empty):
    trains = {d for d, _ in documents if zlib.crc32(str(d).encode()) % 7 != 2}
    counts = Counter(t for d, x in documents if d in trains for t in lattice.tokens(x))
    n, v = sum(counts.values()), len(counts)
    # Weights and scores by plain sums over segmentations, piece by piece.
    pieces, prior, byte = lattice.vocabulary("piece_bpe_32k.model")
    made, log = lattice.Lattice("piece_bpe_32k.model"), prior
    trained = [t for t in counts if t != lattice.END]
    for _ in range(lattice.STEPS):
        expected = lattice.PRIOR * np.exp(prior)
        for points, places in lattice.by_length(trained):
            expected += made.expected(points, log, np.array([float(counts[trained[k]]) for k in places.tolist()]))
        log = np.log(expected / expected.sum())
    stop = (counts[lattice.END] + 1) / (n + 2)

    def log_probability(word):
        text = "▁" + word.decode("utf-8", "replace")
        f = [0.0] + [-np.inf] * len(text)
        for j in range(1, len(text) + 1):
            ways = [f[j - 1] + log[[byte[b] for b in text[j - 1].encode()]].sum()]
            ways += [f[i] + log[pieces[text[i:j]]] for i in range(max(0, j - lattice.LONGEST), j) if text[i:j] in pieces]
            f[j] = np.logaddexp.reduce(ways)
        return f[-1] + np.log1p(-stop)

    scores = {}
    for d, x in documents[:12]:
        scores[d] = sum(np.log(stop) if t == lattice.END else log_probability(t) for t in lattice.tokens(x)) / np.log(10)
    got = {r["doc_id"]: r for r in queries.op8_lattice(spark, FOLDER).collect()}
    for d, x in documents:
        said = lattice.tokens(x)
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d not in trains, len(said), sum(counts[t] > 0 for t in said), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in said)) and r["score"] < 0
        assert d not in scores or r["score"] == pytest.approx(scores[d], rel=1e-6)
    found = lattice.score(spark, odd, langid.fold(7) != 2).collect()
    assert len(found) == len(ODD) and all(np.isfinite(r["score"]) for r in found)
    assert lattice.score(spark, empty, langid.fold(7) != 2).count() == 0


# Columns of any name, and models against plain loops.


CLASHING = "key node comp row lid place line gone parts edges first stop shard copy uid run epoch block size score lang_pred cosine n_lines n_kept group k grouped c s in_0 out_0 said word trains chunk left".split()


@pytest.fixture(scope="module")
def clashing(spark, odd):
    return odd.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).withColumn("with.dot and blank", F.lit(1))


def kept_whole(df, given):
    assert df.columns[: len(given.columns)] == given.columns
    rows = df.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    return rows


def test_columns_that_pass_may_have_any_name(spark, clashing):
    import corpus_pipeline

    found = line_dedup.dedup_lines(spark, clashing, 1)
    assert found.columns[-2:] == ["n_lines_", "n_kept_"] and len(kept_whole(found, clashing)) == len(ODD)
    found = langid.identify(spark, clashing, langid.fold(3) != 1)
    assert found.columns[-3:] == ["lang_pred_", "score_", "cosine_"] and len(kept_whole(found, clashing)) == len(ODD)
    assert len(kept_whole(minhash.one_of_each(spark, clashing, 2), clashing)) == 8
    mixed = mix.Mix(spark, clashing)
    assert kept_whole(mixed.texts(), clashing) and mixed.sharded().columns[-2:] == ["shard_", "place_"]
    docs = clashing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == clashing.columns and kept_whole(docs, clashing)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() > 0


def test_other_operators_ignore_further_columns(spark, clashing):
    plain = clashing.select("doc_id", "text")
    for f in (lambda d: pack.pack(d.coalesce(1), with_ids=False), matroska.stored_media, lambda d: lattice.score(spark, d, F.lit(True)), lambda d: minhash.near_duplicates(spark, d, 2)):
        assert sorted(map(repr, f(clashing).collect())) == sorted(map(repr, f(plain).collect()))
    labels = spark.createDataFrame([(4, 1, "x"), (8, 0, "x")], "doc_id long, quality int, n_words string")
    assert quality.judge(spark, clashing, labels).count() == len(ODD)
    turns = spark.createDataFrame([(1, 0, "user", "hi", 5, 6)], "conv_id long, turn long, role string, text string, pos long, block long")
    assert format_chats(spark, turns).count() == 1
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", 3)], "page_id long, url string, html string, n_chars long")
    assert html_text.extract(pages).count() == 1


def test_vectors_of_trigrams_are_kept_as_bytes():
    langid.bundles(["A text of some trigrams."])
    assert len(langid._table) and langid._table.nbytes == langid.DIMS * len(langid._table)


def test_functions_of_batches_give_memory_back(monkeypatch):
    released = []
    pool = type("Pool", (), {"release_unused": lambda self: released.append(True)})()
    monkeypatch.setattr(wordhash.pa, "default_memory_pool", lambda: pool)
    batch = pa.RecordBatch.from_pydict({"text": ["one text", None], "lang": ["en", "en"]})
    assert len(list(langid._profiles(iter([batch])))) == 1 and released == [True]
    assert all(hasattr(f, "__wrapped__") for f in (langid._beginnings, langid._predict, minhash._features, minhash._keys, minhash._packed, minhash._sets, mix._words, pack._pack))


def test_stages_hand_small_batches_to_python(spark, odd):
    import corpus_pipeline

    before = spark.conf.get(corpus_pipeline.BATCH_KEY)
    try:
        for given, held in (("10000", "1000"), ("0", "1000"), ("64", "64")):
            spark.conf.set(corpus_pipeline.BATCH_KEY, given)
            corpus_pipeline.packed_sequences(spark, odd, FOLDER)
            assert spark.conf.get(corpus_pipeline.BATCH_KEY) == held
    finally:
        spark.conf.set(corpus_pipeline.BATCH_KEY, before)


def test_bundles_equal_naive_binding():
    texts = ["Straße 7, été!", "日本語の文", "aaa", None, "12 !?", "ж ы"]
    vectors, has = langid.bundles(texts)
    for text, vector, ok in zip(texts, vectors, has.tolist(), strict=True):
        total = np.zeros(langid.DIMS)
        own = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()]
        for before, here, after in zip([0, *own], own, [*own[1:], 0], strict=False):
            if here:
                a, b, c = (langid.letter_vectors(np.array([x]))[0] for x in (before, here, after))
                total += np.roll(a, 2) * np.roll(b, 1) * c
        assert ok == bool(total.any())
        assert vector == pytest.approx(total / max(np.linalg.norm(total), 1e-12), abs=1e-5)


def test_node_arrays_equal_a_walk_down_the_trees():
    rng = np.random.default_rng(6)
    x = rng.random((700, len(quality.FEATURES)))
    trees = quality.Trees(quality.MONOTONE, rounds=12).fit(x, (x[:, 2] + x[:, 5] > 1).astype(float))
    want = []
    for row in x.tolist():
        total = trees.base
        for at in trees.roots:
            while trees.nodes[at][0] >= 0:
                feature, cut, left, right, _ = trees.nodes[at]
                at = left if row[feature] <= cut else right
            total += trees.nodes[at][4]
        want.append(1 / (1 + np.exp(-total)))
    assert trees.probability(x) == pytest.approx(want)


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(Session)


# The pipeline.


def test_near_duplicates_of_the_pipeline_equal_brute_force(spark, documents):
    """Five-word shingles, as the stage takes them: every link of similarity 0.8 or more, and no other, decides."""
    import corpus_pipeline

    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for d, t in documents for w in [words(t.encode().lower().decode())]}
    groups = components(sets, lambda n, union: 100 * n >= 80 * union)
    got = corpus_pipeline.distinct_documents(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(d for d, c in groups.items() if c == d)


def test_pipeline(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER).cache()
        assert after.columns == docs.columns, name
        assert after.count() > 0
        before = after
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    one = corpus_pipeline.known_language(spark, docs.unionByName(odd.filter("doc_id in (1, 2, 9)")), FOLDER)
    assert one.count() == docs.count()


def test_texts_of_no_language_leave_the_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    dump = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(40))
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. " * 10
    planted = spark.createDataFrame([(-1, dump, "en", "a", 1), (-2, polish, "en", "a", 1)], DOCS)
    got = corpus_pipeline.known_language(spark, docs.unionByName(planted), FOLDER)
    assert got.filter("doc_id < 0").count() == 0 and got.count() == docs.count()
