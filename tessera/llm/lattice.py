"""Language-model scores from a subword lattice: the sum over all segmentations, by a forward recursion in log space."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, release
from .wordhash import U64, mix

#: Longest piece that is looked up, in code points; text bytes of a chunk of documents that share a table of words.
LONGEST, CHUNK = 16, 12_000_000
#: Weight of the vocabulary's own scores, in pieces, beside the expected counts; steps of re-estimation.
PRIOR, STEPS = 100_000.0, 3
#: Code points of a long word that are taken at once: state that a recursion keeps is that of its last LONGEST places.
WINDOW = 1 << 16
END = b"\n"  # the end token; no word holds a line feed


@lru_cache(maxsize=2)
def vocabulary(model: str) -> tuple[dict[str, int], np.ndarray, list[int]]:
    """Pieces of a sentencepiece model with their numbers, log weights from its scores, and the 256 byte pieces.

    The file's scores are ranks of merges (0, -1, -2, ...): a piece weighs as the inverse of its rank, as in Zipf's law.
    """
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    pieces: dict[str, int] = {}
    scores, byte = [], [0] * 256
    for k in range(sp.get_piece_size()):
        text = sp.id_to_piece(k)
        if m := re.fullmatch(r"<0x([0-9A-F]{2})>", text):
            byte[int(m[1], 16)] = len(scores)
            scores.append(-40_000.0)
        elif not sp.is_control(k) and not sp.is_unknown(k) and len(text) <= LONGEST:
            pieces[text] = len(scores)
            scores.append(sp.get_score(k))
    weights = -np.log(20.0 - np.array(scores))
    return pieces, weights - np.logaddexp.reduce(weights), byte


class Lattice:
    """All segmentations of words into pieces of a vocabulary; a word begins with the space mark.

    A code point is also spelled by its bytes' pieces.  Words are taken in batches of equal length, all places at once.
    """

    _MULT = U64(0x9E3779B97F4A7C55)

    def __init__(self, model: str) -> None:
        self.pieces, self.weights, byte = vocabulary(model)
        self.byte = np.array(byte)
        by_length: dict[int, list[str]] = {}
        for p in self.pieces:
            by_length.setdefault(len(p), []).append(p)
        self.keys, self.numbers = [], []
        for n in range(1, LONGEST + 1):
            own = by_length.get(n, [])
            points = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(-1, n)
            keys = self._hashes(points)[n - 1][:, 0] if own else np.zeros(0, U64)
            order = np.argsort(keys)
            self.keys.append(keys[order])
            self.numbers.append(np.array([self.pieces[p] for p in own], np.int32)[order])
        # A table of sixteen bits of the hash says of most spans that they are no piece.
        self.may = [np.bincount((k >> U64(48)).astype(np.int64), minlength=1 << 16) > 0 for k in self.keys]

    def _hashes(self, points: np.ndarray) -> Iterator[np.ndarray]:
        """For 1, 2, ..., LONGEST the hashes of all spans of that length, (m, n - length + 1)."""
        found = []
        h = np.full(points.shape, 7, U64)
        wide = points.astype(U64)
        for k in range(min(LONGEST, points.shape[1])):
            h = (h[:, : points.shape[1] - k] ^ wide[:, k:]) * self._MULT
            h ^= h >> U64(29)
            found.append(mix(h))
        return found

    def arcs(self, points: np.ndarray) -> np.ndarray:
        """Numbers of the pieces that begin at each place of words (m, n), by length, (LONGEST, m, n); -1: none."""
        m, n = points.shape
        found = np.full((LONGEST, m, n), -1, np.int32)
        for k, h in enumerate(self._hashes(points)):
            at = np.flatnonzero(self.may[k][(h >> U64(48)).astype(np.int64)])
            if len(at):
                key = h.ravel()[at]
                place = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
                hit = self.keys[k][place] == key
                rows, columns = np.divmod(at[hit], h.shape[1])
                found[k, rows, columns] = self.numbers[k][place[hit]]
        return found

    def spelled(self, points: np.ndarray, log: np.ndarray) -> np.ndarray:
        """Log weight of spelling each code point by bytes."""
        seen = np.zeros(int(points.max()) + 1, dtype=bool)
        seen[points] = True
        cost = np.zeros(len(seen))
        for p in np.flatnonzero(seen).tolist():
            cost[p] = log[self.byte[list(chr(p).encode("utf-8", "surrogatepass"))]].sum()
        return cost[points]

    @staticmethod
    def _weigh(arcs: np.ndarray, single: np.ndarray, log: np.ndarray) -> np.ndarray:
        """Log weights of arcs by where they end, (n, m, LONGEST): that of the arc of length k + 1 at k."""
        longest, m, n = arcs.shape
        ends = np.full((n, m, longest), -np.inf)
        known = np.append(log, -np.inf)
        for k in range(min(longest, n)):
            weight = known[arcs[k, :, : n - k]]
            ends[k:, :, k] = (np.logaddexp(weight, single) if k == 0 else weight).T
        return ends

    @staticmethod
    def _run(ends: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The recursion over places: log sums (m, LONGEST + n), of which start, (m, LONGEST), are the first ones."""
        n, m, longest = ends.shape
        f = np.full((m, longest + n), -np.inf)
        f[:, :longest] = start
        for j in range(n):
            total = f[:, j : j + longest][:, ::-1] + ends[j]
            top = total.max(axis=1)
            f[:, longest + j] = top + np.log(np.exp(total - top[:, None]).sum(axis=1))
        return f

    def forward(self, points: np.ndarray, log: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all segmentations of each word, (m,); a long word is taken window by window."""
        m, n = points.shape
        state = np.full((m, LONGEST), -np.inf)
        state[:, -1] = 0.0
        for i in range(0, n, WINDOW):
            back = min(i, LONGEST - 1)  # arcs may begin in the window before
            part = points[:, i - back : i + WINDOW]
            ends = self._weigh(self.arcs(part), self.spelled(part, log), log)[back:]
            state = self._run(ends, state)[:, -LONGEST:]
        return state[:, -1]

    def expected(self, points: np.ndarray, log: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in words that occur `counts` times."""
        arcs, single = self.arcs(points), self.spelled(points, log)
        m, n = points.shape
        ends = self._weigh(arcs, single, log)
        start = np.full((m, LONGEST), -np.inf)
        start[:, -1] = 0.0
        f = self._run(ends, start)[:, LONGEST - 1 :]
        # Backwards the same recursion runs over arcs by where they begin, from the end.
        begins = np.full_like(ends, -np.inf)
        for k in range(min(LONGEST, n)):
            begins[k:, :, k] = ends[k:, :, k][::-1]
        b = self._run(begins, start)[:, LONGEST - 1 :][:, ::-1] - f[:, n:]
        out = np.zeros(len(log))
        for k in range(min(LONGEST, n)):
            rows, columns = np.nonzero(arcs[k, :, : n - k] >= 0)
            number = arcs[k, rows, columns]
            out += np.bincount(number, counts[rows] * np.exp(f[rows, columns] + log[number] + b[rows, columns + k + 1]), len(log))
        use = counts[:, None] * np.exp(f[:, :-1] + single + b[:, 1:])
        by_point = np.bincount(points.ravel(), use.ravel())
        for p in np.flatnonzero(by_point).tolist():
            for x in chr(p).encode("utf-8", "surrogatepass"):
                out[self.byte[x]] += by_point[p]
        return out


lattice = lru_cache(maxsize=2)(Lattice)


def by_length(tokens: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length, as rows of code points behind the space mark, and their places in the list."""
    texts = ["▁" + t.decode("utf-8", "replace") for t in tokens]
    groups: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        groups.setdefault(len(t), []).append(k)
    for n, places in groups.items():
        step = max(1, 50_000 // n)
        for i in range(0, len(places), step):
            some = places[i : i + step]
            yield np.frombuffer("".join(texts[k] for k in some).encode("utf-32-le"), np.uint32).reshape(-1, n), np.array(some)


def merged(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    """Batches put together to about `rows` rows, so that words of equal length make large groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, then the end."""
    return [*(text or "").encode().lower().split(), END]


def planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte: all lowest bytes, then the next ones, so that the high ones, mostly 0, compress to little."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_CODED = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("trains", pa.bool_()), ("said", pa.binary()), ("number", pa.int64()), ("word", pa.binary()), ("c", pa.int64())])


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as numbers of their chunk's words, and each chunk's words with their uses in training documents.

    A task makes chunks of its own rows as they come, so that no text is shuffled.
    """
    chunk = TaskContext.get().partitionId() << 32
    place: dict[bytes, int] = {}
    docs: list[tuple[int | None, bool, np.ndarray]] = []
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        trained = [ids for _, trains, ids in docs if trains]
        counts = np.bincount(np.concatenate(trained) if trained else np.zeros(0, np.int32), minlength=len(place))
        for i in range(0, len(docs), 500):
            some = docs[i : i + 500]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.int64()), pa.array([d for d, _, _ in some], pa.int64()), pa.array([t for _, t, _ in some]), pa.array([planes(x) for _, _, x in some], pa.binary()), none, pa.nulls(len(some), pa.binary()), none], schema=_CODED)
        words = list(place)
        for i in range(0, len(words), 50_000):
            some = words[i : i + 50_000]
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.array(np.arange(i, i + n)), pa.array(some, pa.binary()), pa.array(counts[i : i + n].astype(np.int64))], schema=_CODED)

    for batch in batches:
        for doc_id, text, trains in zip(batch["doc_id"].to_pylist(), batch["text"], batch["trains"].to_pylist(), strict=True):
            said = tokens(text.as_py())
            docs.append((doc_id, trains, np.array([place.setdefault(w, len(place)) for w in said], np.int32)))
            size += sum(map(len, said)) + len(said)
            if size >= CHUNK:
                yield from rows()
                chunk, place, docs, size = chunk + 1, {}, [], 0
    if docs:
        yield from rows()


def _expect(model: str, log: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expected uses of pieces in words; a word beyond WINDOW code points is taken in parts of that length."""
    made = lattice(model)
    total = np.zeros(len(log))
    for batch in merged(batches):
        c = batch["c"].to_numpy().astype(float)
        for points, places in by_length(batch["word"].to_pylist()):
            for i in range(0, points.shape[1], WINDOW):
                total += made.expected(points[:, i : i + WINDOW], log, c[places])
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])


def _weigh(model: str, log: np.ndarray, stop: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """log10 of each word's probability: that of all its segmentations, and that the text goes on."""
    made = lattice(model)
    for batch in merged(batches):
        words = batch["word"].to_pylist()
        out = np.zeros(len(words))
        for points, places in by_length(words):
            out[places] = made.forward(points, log) + np.log1p(-stop)
        out[[k for k, w in enumerate(words) if w == END]] = np.log(stop)
        yield from pa.table([batch["word"], batch["c"], pa.array(out / np.log(10))], names=["word", "c", "lp"]).to_batches(max_chunksize=20_000)


def _score(n: int, v: int, docs: pa.Table, table: pa.Table) -> pa.Table:
    """A chunk's documents against the chunk's words; base and model scores are sums over tokens."""
    order = np.argsort(table["number"].to_numpy())
    c, lp = table["c"].to_numpy()[order], table["lp"].to_numpy()[order]
    base = np.log10((c + 1) / (n + v + 1))
    sums: list[tuple[int, int, float, float]] = []
    for said in docs["said"]:
        at = from_planes(said.as_py())
        sums.append((len(at), int((c[at] > 0).sum()), float(base[at].sum()), float(lp[at].sum())))
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    columns = [pa.array(x, k) for x, k in zip(zip(*sums, strict=True), kinds, strict=True)] if sums else [pa.array([], k) for k in kinds]
    return pa.table([docs["doc_id"], docs["held_out"], *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score(spark: SparkSession, docs: DataFrame, trains: Column, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Base and lattice scores of each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs has doc_id and text; other columns are ignored.  The text's probability is the product over its words of the
    summed probability of all segmentations into pieces (pieces don't cross words), times the end's.  The vocabulary's
    own scores are the prior of the pieces' weights, which STEPS expectation steps over all training words estimate.
    Rows with `trains` false or null, as where doc_id is null, are held out.  A null or empty text is the end alone; a
    word may have any length, in time in proportion to it.  Texts aren't shuffled: each task codes its documents by the
    words of a chunk of about CHUNK bytes, and a chunk's distinct words are joined with the corpus table once.
    Repeated rows give repeated results; no rows, no result rows.
    """
    scratch = Scratch(spark, "lattice")
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(trains, F.lit(False)).alias("trains"))
    coded = scratch.table(given.mapInArrow(_code, "chunk long, doc_id long, trains boolean, said binary, number long, word binary, c long"))
    local = coded.filter("word is not null").select("chunk", "number", "word", "c")
    words = scratch.table(local.groupBy("word").agg(F.sum("c").alias("c")))
    release(spark)
    known = words.filter("c > 0")
    n, v, ends = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0))).first()
    spelled = known.filter(F.col("word") != F.lit(END))
    # Words end by chance: after each word the text goes on or ends, in the shares of the training texts.
    stop = (ends + 1) / (n + 2)
    prior = vocabulary(model)[1]
    log = prior
    for _ in range(STEPS if n > ends else 0):
        uses = spelled.mapInArrow(partial(_expect, model, log), "piece long, uses double")
        expected = PRIOR * np.exp(prior)
        for r in uses.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # as many rows as the vocabulary at most
            expected[r["piece"]] += r["uses"]
        log = np.round(np.log(expected / expected.sum()), 9)
    weighed = words.mapInArrow(partial(_weigh, model, log, float(stop)), "word binary, c long, lp double")
    table = local.drop("c").join(weighed, "word").select(F.col("chunk").alias("of"), "number", "c", "lp")
    marked = coded.filter("said is not null").select("chunk", "doc_id", "said", (~F.col("trains")).alias("held_out"))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(int(n), int(v), left, right)

    out = marked.groupBy("chunk").cogroup(table.groupBy("of")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
