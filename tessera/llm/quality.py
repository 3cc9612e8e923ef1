"""Quality rules: document statistics, and gradient-boosted trees over them, flattened into node arrays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .wordhash import U64, mix, slices, utf8, word_hashes, words

#: Labelled rows that the trees are fitted to, on average.
SAMPLE = 8000
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digit", "n_punct"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "punctuation", "line_words"]
#: -1: quality never rises with the feature, whatever the others are.
MONOTONE = np.array([0, 0, -1, -1, -1, 0, 0, 0, 0, 0])


def _marks(characters: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(characters)] = 1
    return table


_SYMBOL, _UPPER, _DIGIT, _PUNCT = _marks(b"#*$%&|<>"), _marks(bytes(range(65, 91))), _marks(bytes(range(48, 58))), _marks(b"!?.,;:")
_POINT = np.array([(b & 0xC0) != 0x80 and b not in b"\t\n\x0b\x0c\r " for b in range(256)], np.int64)
_BLANK = " \t\n\x0b\x0c\r"


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; a null or empty one has zeros."""
    raw, bounds = utf8(texts)
    starts, ends, first = words(raw, bounds)
    n = len(bounds) - 1
    counts = np.diff(first)
    out = np.zeros((n, len(STATISTICS)), np.int64)
    out[:, 0] = counts
    for column, table in ((1, _POINT), (2, _SYMBOL), (7, _UPPER), (8, _DIGIT), (9, _PUNCT)):
        total = np.concatenate([[0], np.cumsum(table[raw])])
        out[:, column] = total[bounds[1:]] - total[bounds[:-1]]
    hashes = word_hashes(raw, starts, ends, fold=False)
    owner = np.repeat(np.arange(n), counts)
    salt = mix(np.arange(1, n + 1).astype(U64))
    if len(hashes):
        own = np.unique(hashes ^ salt[owner], return_index=True)[1]
        out[:, 6] = np.bincount(owner[own], minlength=n)
    if len(hashes) > 2:
        whole = owner[2:] == owner[:-2]
        at = np.flatnonzero(whole)
        runs = mix(mix(mix(hashes[at] ^ salt[owner[at]]) + hashes[at + 1]) + hashes[at + 2])
        _, inverse, times = np.unique(runs, return_inverse=True, return_counts=True)
        again = at[times[inverse] > 1]
        marked = np.zeros(len(hashes), dtype=bool)
        for k in range(3):
            marked[again + k] = True
        out[:, 4] = np.bincount(owner[marked], minlength=n)
    for k, text in enumerate(texts):
        value = text.as_py()
        if value and "\n" in value:
            lines = [x for x in value.split("\n") if x.strip(_BLANK)]
            out[k, 5] = len(lines)
            out[k, 3] = len(lines) - len(Counter(lines))
        else:
            out[k, 5] = counts[k] > 0
    return out


def features(s: np.ndarray) -> np.ndarray:
    """FEATURES from rows of STATISTICS."""
    w, chars, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1), np.maximum(s[:, 5], 1)
    return np.stack([np.log1p(s[:, 0]), s[:, 1] / w, s[:, 2] / w, s[:, 3] / lines, s[:, 4] / w, s[:, 6] / w, s[:, 7] / chars, s[:, 8] / chars, s[:, 9] / w, s[:, 0] / lines], axis=1)


class Trees:
    """Boosted regression trees on the logistic loss, as node arrays: feature (-1: leaf), cut, left, right, value."""

    def __init__(self, monotone: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 8.0) -> None:
        self.monotone, self.rounds, self.depth, self.rate, self.bins, self.least = monotone, rounds, depth, rate, bins, least
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self.roots: list[int] = []
        self.base = 0.0
        self.threshold = 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            self.roots.append(self._grow(binned, cuts, g, h, np.arange(len(y)), self.depth, -np.inf, np.inf, raw))
        return self

    def _grow(self, b: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, low: float, high: float, raw: np.ndarray) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(gs / (hs + 1), low, high))
        best = (1e-3, -1, 0, 0.0, 0.0)
        if depth:
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(b[rows, k], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b[rows, k], h[rows], len(c) + 1))[:-1]
                vl, vr = np.clip(gl / (hl + 1), low, high), np.clip((gs - gl) / (hs - hl + 1), low, high)
                gain = gl * vl - (hl + 1) * vl**2 / 2 + (gs - gl) * vr - (hs - hl + 1) * vr**2 / 2 - (gs * value - (hs + 1) * value**2 / 2)
                bad = (hl < self.least / 4) | (hs - hl < self.least / 4) | (self.monotone[k] * (vr - vl) < 0)
                gain[bad] = -np.inf
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), k, i, float(vl[i]), float(vr[i]))
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, at, at, self.rate * value))
        if best[1] < 0:
            raw[rows] += self.rate * value
            return at
        _, k, i, vl, vr = best
        middle = (vl + vr) / 2
        left_bounds = right_bounds = (low, high)
        if self.monotone[k]:
            left_bounds, right_bounds = ((low, middle), (middle, high)) if self.monotone[k] > 0 else ((middle, high), (low, middle))
        goes = b[rows, k] <= i
        left = self._grow(b, cuts, g, h, rows[goes], depth - 1, *left_bounds, raw)
        right = self._grow(b, cuts, g, h, rows[~goes], depth - 1, *right_bounds, raw)
        self.nodes[at] = (k, float(cuts[k][i]), left, right, 0.0)
        return at

    def flat(self) -> tuple[np.ndarray, ...]:
        kinds = (np.int32, np.float64, np.int32, np.int32, np.float64)
        return tuple(np.array(c, t) for c, t in zip(zip(*self.nodes, strict=True), kinds, strict=True)) if self.nodes else tuple(np.zeros(0, t) for t in kinds)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of quality, for rows of features: all trees of all rows go down a level at a time."""
        feature, cut, left, right, value = self.flat()
        out = np.full(len(x), self.base)
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            at = np.tile(np.array(self.roots, np.int32), (len(part), 1))
            for _ in range(self.depth if self.roots else 0):
                f = feature[at]
                goes = np.take_along_axis(part, np.maximum(f, 0).reshape(len(part), -1), axis=1) <= cut[at]
                at = np.where(f < 0, at, np.where(goes, left[at], right[at]))
            if self.roots:
                out[i : i + 4096] += value[at].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, keep: float = 0.995) -> Trees:
    """Trees on three quarters of the rows; the threshold, at most 0.5, keeps the share `keep` of the rest's good rows."""
    trees = Trees(MONOTONE)
    if not len(y) or y.min() == y.max():
        trees.threshold = 0.0  # nothing to tell apart: the base rules decide alone
        return trees
    test = np.arange(len(y)) % 4 == 3
    trees.fit(x[~test], y[~test].astype(float))
    good = np.sort(trees.probability(x[test & (y == 1)]))
    trees.threshold = min(0.5, float(good[int((1 - keep) * len(good))])) if len(good) else 0.5
    return trees


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in slices(batch["text"]):
            part = batch.slice(i, j - i)
            found = statistics(part["text"])
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(found[:, k]) for k in range(found.shape[1]))], names=["doc_id", *STATISTICS])


def _score(trees: Trees, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = np.stack([batch[c].to_numpy() for c in STATISTICS], axis=1).reshape(-1, len(STATISTICS))
        failed = (s[:, 0] < 50) | (100 * s[:, 4] > 50 * s[:, 0])
        p = trees.probability(features(s))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(batch[c] for c in STATISTICS), pa.array(failed), pa.array(~failed & (p >= trees.threshold)), pa.array(p)], names=["doc_id", *STATISTICS, "base_failed", "kept", "quality"])


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """STATISTICS, base_failed, kept and quality (a probability) of each document.

    docs has doc_id and text, labels doc_id and quality (0 or 1); other columns are ignored.  Base rule: fewer than 50
    words, or more than half of the words in three-word runs that occur again, fails.  The trees are fitted to about
    `sample` labelled documents, chosen by a hash of doc_id; rows with a null doc_id or label train nothing.  A null or
    empty text has zeros and fails.  Without labels of both kinds the base rule decides alone.  Repeated rows give
    repeated results; no rows, no result rows.
    """
    scratch = Scratch(spark, "quality")
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    columns = "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS)
    measured = scratch.table(given.mapInArrow(_measure, columns))
    marked = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    n = marked.count()
    chosen = marked.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.lit(min(1.0, sample / max(n, 1)) * (1 << 30)))
    rows = measured.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", *STATISTICS).toPandas()
    trees = fit(features(rows[STATISTICS].to_numpy().reshape(-1, len(STATISTICS))), rows["quality"].to_numpy())
    return measured.mapInArrow(partial(_score, trees), columns + ", base_failed boolean, kept boolean, quality double")
