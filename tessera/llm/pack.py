"""Order-preserving packing of documents into token sequences of a fixed width by dynamic programming."""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import gives_back

#: Cost, in padding tokens, of a cut inside a document after a sentence, and of one within a sentence.
SENTENCE_CUT, BROKEN_CUT = 4.0, 200.0
#: Tokens that are planned together; a plan ends at the end of a document.
PLAN = 1 << 18
#: Texts of these characters only are split alike by both tokenizer libraries; others go to the slower one.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÿ]*")


class Encoder:
    """Token ids of texts without special tokens added, as tokenizers gives them for a byte-level BPE file.

    Where it is known to give the same ids, the same vocabulary is applied by tiktoken, which is faster.
    """

    def __init__(self, json_name: str, ranks_name: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        self.json_path = public_tokenizers.path(json_name)
        with open(public_tokenizers.path(ranks_name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None
        self.specials = re.compile("|".join(map(re.escape, self._specials())) or r"(?!)")
        self.ends = np.zeros(max(ranks.values()) + 1024, dtype=bool)
        for piece, k in ranks.items():
            self.ends[k] = piece.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b"\n") or piece.endswith(b"\n")

    def _specials(self) -> list[str]:
        import json

        with open(self.json_path, encoding="utf-8") as f:
            return [t["content"] for t in json.load(f).get("added_tokens", [])]

    def ids(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and not self.specials.search(text):
            return np.asarray(self.fast.encode_to_numpy(text), dtype=np.uint32)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


encoder = lru_cache(maxsize=2)(Encoder)


def window_cuts(ends: np.ndarray, documents: np.ndarray, width: int) -> list[int]:
    """Positions of the cuts that minimise padding plus penalties, the last one at the end.

    ends: for each token whether a sentence ends after it; documents: positions just after each document, the last
    one the number of tokens.  A window has `width` tokens at most and is padded to `width`, but one whose length is
    a power of two is not padded.  cost(j) = penalty(j) + min over i of cost(i) + width - (j - i): the minimum of
    cost(i) + i over a sliding window, kept in a monotone queue; the powers of two are looked up one by one.
    """
    total = int(documents[-1])
    allowed = np.flatnonzero(ends[:total]) + 1
    marks = np.union1d(allowed, documents)
    gaps = np.diff(np.concatenate([[0], marks]))
    broken = [np.arange(marks[k] - gaps[k] + 1, marks[k]) for k in np.flatnonzero(gaps > width)]
    penalty = np.full(total + 1, np.inf)
    for positions, cost in ([np.concatenate([*broken, [0]]), BROKEN_CUT], [allowed, SENTENCE_CUT], [documents, 0.0]):
        penalty[positions.astype(np.int64)] = cost
    places = np.flatnonzero(penalty < np.inf)
    places = places[places > 0].tolist()
    penalty = penalty.tolist()
    best, back = [np.inf] * (total + 1), [0] * (total + 1)
    best[0] = 0.0
    powers = [1 << k for k in range(width.bit_length()) if 1 << k <= width]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in places:
        while queue[0][1] < j - width:
            queue.popleft()
        value, i = queue[0]
        value += width - j
        for p in powers:
            if p <= j and best[j - p] < value:
                value, i = best[j - p], j - p
        value += penalty[j]
        best[j], back[j] = value, i
        key = value + j
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts = [total]
    while back[cuts[-1]] > 0:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


@gives_back
def _pack(width: int, names: tuple[str, str], separator: int, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sequence = TaskContext.get().partitionId() << 33
    encode = encoder(*names)
    held: list[tuple[int | None, np.ndarray]] = []
    size = 0

    def planned() -> pa.RecordBatch:
        nonlocal sequence
        ids = np.concatenate([x for _, x in held])
        stops = np.cumsum([len(x) for _, x in held])
        cuts = window_cuts(encode.ends[ids], stops, width)
        rows: list[tuple] = []
        begin, k = 0, 0
        for cut in cuts:
            at = begin
            while at < cut:
                doc_start = int(stops[k]) - len(held[k][1])
                end = min(cut, int(stops[k]))
                rows.append((held[k][0], at - doc_start, end - at, zlib.crc32(ids[at:end].astype("<u4").tobytes()), len(held[k][1]), sequence, at - begin))
                k += end == stops[k]
                at = end
            sequence += 1
            begin = cut
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in columns]
        if with_ids:  # the pieces are the ids in order
            arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *columns[2]]).astype(np.int32)), pa.array(ids.astype(np.int32))))
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            ids = np.append(encode.ids(text.as_py() or ""), np.uint32(separator))
            held.append((doc_id, ids))
            size += len(ids)
            if size >= PLAN:
                yield planned()
                held, size = [], 0
    if held:
        yield planned()


def pack(
    docs: DataFrame,
    width: int = 1024,
    tokenizer: tuple[str, str] = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"),
    separator: int = 0,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of documents placed in sequences of at most `width` tokens.

    docs has doc_id and text; other columns are ignored.  A document's tokens are its ids and one separator; a null
    or empty text has the separator alone.  Each task packs its own part of the table in the order in which it is
    read, so nothing is shuffled and no sequence mixes parts; ids of sequences are unique, and equal again in a
    repeated task.  A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    ids themselves.  Repeated rows are packed as often as they occur; doc_id may be null.  No rows, no result rows.
    A text longer than PLAN tokens is planned in one go, in memory in proportion to its length.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(partial(_pack, width, tokenizer, separator, with_ids), schema + ", ids array<int>" * with_ids)
