"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import Given
from .wordhash import U64, gives_back, mix, slices

#: Components of a vector; parts of one that sums of unit vectors are counted in; steps of a cosine that medians are told by.
DIMS, UNIT, FINE = 1024, 1 << 30, 10_000
#: Languages beyond which a model is refused, as these are no languages: profiles (4 kB each) are sent to every task.
MOST_LANGUAGES = 20_000
#: Trigrams whose vectors are floats at one time (a long text has many); those kept for frequent use are bytes.
AT_ONCE = 3000
SHARPNESS = 25.0
#: Powers of two of the beginnings that bounds are taken from; the share of their median cosine that a text needs.
EXPONENTS, LOOSE = range(2, 11), 0.25


@lru_cache(maxsize=1)
def _letter() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(p).isalpha() for p in range(0x110000)])


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A random vector of +1 and -1 for each code point, made from it alone; 0 stands for whatever is no letter."""
    words = mix(mix(points.astype(U64) + U64(19))[:, None] + np.arange(1, DIMS // 64 + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C55))
    return np.unpackbits(words.view(np.uint8).reshape(len(points), DIMS // 8), axis=1).astype(np.float32) * 2 - 1


_bound: dict[tuple[int, int, int], int] = {}
_table = np.zeros((0, DIMS), np.int8)


def _vectors(grams: np.ndarray) -> np.ndarray:
    """Vectors of trigrams, (m, 3) code points: letter vectors, rotated by their place, multiplied.  Keeps those of frequent use."""
    global _table
    keys = list(map(tuple, grams.tolist()))
    missing = [g for g in keys if g not in _bound]
    if missing:
        if len(_bound) + len(missing) > 24_000:
            _bound.clear()
            _table = np.zeros((0, DIMS), np.int8)
            missing = keys
        points, at = np.unique(np.array(missing), return_inverse=True)
        base, at = letter_vectors(points).astype(np.int8), at.reshape(-1, 3)
        made = np.roll(base, 2, axis=1)[at[:, 0]] * np.roll(base, 1, axis=1)[at[:, 1]] * base[at[:, 2]]
        _bound.update((x, len(_table) + k) for k, x in enumerate(missing))
        _table = np.concatenate([_table, made])
    return _table[[_bound[g] for g in keys]].astype(np.float32)


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts (up to 128), sums of their trigrams' vectors, and which texts have a letter."""
    lowered = [t.lower() if t else "" for t in texts]
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.array([len(t) + 1 for t in lowered], np.int64))
    # Numbers of the letters that occur here: three of them and the text's fit a long.
    letters = np.where(_letter()[points], points, 0)
    seen = np.zeros(0x110000, dtype=bool)
    seen[letters] = True
    seen[0] = True
    used = np.flatnonzero(seen)
    bits = U64(int(len(used)).bit_length())
    number = np.zeros(0x110000, np.uint64)
    number[used] = np.arange(len(used))
    symbols = number[letters]
    before, after = np.concatenate([[U64(0)], symbols[:-1]]), np.concatenate([symbols[1:], [U64(0)]])
    inside = symbols > 0
    grams = (before[inside] << bits | symbols[inside]) << bits | after[inside]
    pairs, counts = np.unique(owner[inside].astype(U64) << U64(3) * bits | grams, return_counts=True)
    out = np.zeros((len(texts), DIMS), np.float32)
    if len(pairs):
        low = (U64(1) << U64(3) * bits) - U64(1)
        grams, column = np.unique(pairs & low, return_inverse=True)
        row, one = (pairs >> U64(3) * bits).astype(np.int64), (U64(1) << bits) - U64(1)
        triples = np.stack([used[(grams >> U64(k) * bits & one).astype(np.int64)] for k in (2, 1, 0)], axis=1)
        for i in range(0, len(grams), AT_ONCE):
            here = (column >= i) & (column < i + AT_ONCE)
            weights = np.zeros((len(texts), min(AT_ONCE, len(grams) - i)), np.float32)
            weights[row[here], column[here] - i] = counts[here]
            out += weights @ _vectors(triples[i : i + AT_ONCE])
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norms, 1e-12), np.bincount(owner[inside], minlength=len(texts)) > 0


def _groups(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with up to 128 texts and about a million characters."""
    for i, j in slices(batch[text]):
        for k in range(i, j, 128):
            yield batch.slice(k, min(128, j - k))


@gives_back
def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's unit vectors by language, as whole numbers of 1 / UNIT, so that their order is of no effect."""
    sums: dict[str, np.ndarray] = {}

    def made() -> pa.RecordBatch:
        whole = [np.rint(x * UNIT).astype(np.int64).tolist() for x in sums.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(whole, pa.list_(pa.int64()))], names=["lang", "profile"])

    for batch in batches:
        for part in _groups(batch):
            vectors, has = bundles(part["text"].to_pylist())
            for lang, vector, ok in zip(part["lang"].to_pylist(), vectors, has, strict=True):
                if ok:
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
            if len(sums) > 1000:
                yield made()
                sums.clear()
    yield made()


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit profiles from all of labelled (text, lang)."""
    if len(labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    parts = labelled.select("text", "lang").mapInArrow(_profiles, "lang string, profile array<long>")
    sums = parts.select("lang", F.posexplode("profile").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x")))["x"].alias("profile")).collect()
    profiles = {r["lang"]: np.array(r["profile"], np.float64) for r in found}
    langs = sorted(profiles)
    unit = np.array([profiles[x] / np.linalg.norm(profiles[x]) for x in langs]).reshape(len(langs), DIMS)
    return langs, np.round(unit, 6).astype(np.float32)


@gives_back
def _beginnings(profiles: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many beginnings of 2 ** k characters have each cosine to their best profile, in steps of 1 / FINE."""
    for batch in batches:
        for part in _groups(batch):
            texts = part["text"].to_pylist()
            for k in EXPONENTS:
                vectors, has = bundles([t[: 1 << k] for t in texts])
                steps, n = np.unique(np.rint((vectors @ profiles.T).max(axis=1)[has] * FINE).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(n), pa.int32()), pa.array(steps), pa.array(n)], names=["k", "step", "n"])


def floors(labelled: DataFrame, profiles: np.ndarray) -> dict[int, float]:
    """For each k of EXPONENTS a share of the median cosine that beginnings of 2 ** k characters of all labelled texts have."""
    if not len(profiles):
        return {}
    found = labelled.select("text").mapInArrow(partial(_beginnings, profiles), "k int, step int, n long").groupBy("k", "step").agg(F.sum("n").alias("n"))
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(found.collect()):
        counts.setdefault(r["k"], []).append((r["step"], r["n"]))
    least = {}
    for k, steps in counts.items():
        below = np.cumsum([n for _, n in steps])
        least[k] = LOOSE * steps[int(np.searchsorted(below, (below[-1] + 1) // 2))][0] / FINE
    return least


def _least(least: dict[int, float], text: str | None) -> float:
    """The bound for a text, by its letters (at most those of its beginning, so that it is rather too low)."""
    letters = sum(map(str.isalpha, (text or "")[:4096]))
    return least.get(min(letters.bit_length() - 1, EXPONENTS[-1]), -2.0)


@gives_back
def _predict(langs: list[str], profiles: np.ndarray, least: dict[int, float], text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _groups(batch, text):
            texts = part[text].to_pylist()
            vectors, has = bundles(texts)
            cosines = vectors @ profiles.T if langs else np.full((len(has), 1), -1.0)
            best = cosines.argmax(axis=1)
            top = cosines[np.arange(len(best)), best]
            score = 1 / np.exp(SHARPNESS * (cosines - top[:, None])).sum(axis=1)
            known = has & bool(langs)
            if least:
                known &= top >= np.array([_least(least, t) for t in texts])
            pred = [langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            columns = [pa.array(pred), pa.array(np.where(known, score, 0.0), pa.float64()), pa.array(np.where(known, top, 0.0), pa.float64())]
            kept = [part.column(k) for k in range(part.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*part.schema.names, "lang_pred", "score", "cosine"])


def identify(spark: SparkSession, docs: DataFrame, trains: Column, keep: list[str] | None = None, bounded: bool = False) -> DataFrame:
    """The columns `keep` of docs (all without it), then lang_pred, score (0 to 1, of the prediction) and cosine (to its profile).

    docs has doc_id, text and lang.  Profiles are learned from rows with `trains` true and a lang; a null counts as
    false, and from all of these.  A null text, one without a letter, and any text if nothing was learned, are `und` with score 0.  Whole
    texts are used.  If bounded, a text under the floor for its number of letters is `und` as well.  Kept columns may
    have any name; an added one whose name is among theirs gets an underscore behind it.  Repeated rows give repeated
    results; no rows, no result rows.
    """
    labelled = docs.filter(F.coalesce(trains, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    langs, profiles = train(labelled)
    least = floors(labelled, profiles) if bounded else {}
    given = Given(docs.select(*(F.col(f"`{c}`") for c in docs.columns if keep is None or c in keep)))
    text = given.name("text") if "text" in given.names else "text"
    read = given.df if "text" in given.names else Given(docs.select(*(F.col(f"`{c}`") for c in given.names), "text")).df.withColumnRenamed(f"in_{len(given.names)}", "text")
    schema = ", ".join(f"{c} {t}" for c, t in read.dtypes) + ", lang_pred string, score double, cosine double"
    found = read.mapInArrow(partial(_predict, langs, profiles, least, text), schema)
    return given.back(found, added={c: F.col(c) for c in ("lang_pred", "score", "cosine")})


def fold(modulus: int) -> Column:
    """Remainder of the CRC-32 of the id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
