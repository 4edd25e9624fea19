"""Best-two-fit packing of documents into token sequences.

Documents over the sequence length are cut into whole sequences, with a shorter first piece; what is left
is bin packing of lengths from 1 to ``size``.  As only lengths matter, the packing is decided on their
histogram, which has at most ``size`` rows however large the corpus is: a bin is filled greedily with the
longest pieces that fit, then its smallest piece is replaced by the two unpacked pieces that fill the gap
it leaves most tightly, if they fill it better.  The same bin is repeated as long as its lengths last.  Each
pattern takes runs of ranks within its lengths, so a piece finds its sequence and place from its length
and rank alone: no group of pieces is ever gathered.

Ranks are dealt without a window over all pieces: each task numbers its pieces of a length, and the
numbers of the tasks before are summed over (length, task) counts.

Edge cases: a null or empty text is one piece with the end id only; repeated rows are packed each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged, texts_of
from .tokens import Encoder, default_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("nth", pa.int64())])
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PLACED = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return ([(0, head)] if head else []) + [(s, size) for s in range(head, n, size)]


def _pieces(tokenizer: str, end: int, size: int, cache: int):
    stop = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = Encoder.at(tokenizer, cache), Counter(), TaskContext.get().partitionId()
        for whole in batches:
            for rows in slices(whole, 2048):
                out = []
                for d, x in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1)), strict=True):
                    data = memoryview(x.tobytes() + stop)
                    for k, (s, n) in enumerate(cut(len(data) // 4, size)):
                        out.append((d, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)]), task, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for t, x in zip(_PIECES, zip(*out, strict=True), strict=True)], schema=_PIECES)

    return run


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many bins, [(length, how many in each bin), longest first]) that use up all lengths."""
    left = np.zeros(size + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    places = np.arange(size + 1)
    out = []
    while left.any():
        own: Counter = Counter()
        gap, free = size, left.copy()
        while True:
            fits = np.flatnonzero(free[: gap + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            own[n] += 1
            free[n] -= 1
            gap -= n
        if gap:
            least = min(own)
            room = gap + least
            below = np.maximum.accumulate(np.where(free > 0, places, 0))  # the longest left of at most so much
            best, pair = least, None
            for a in np.flatnonzero(free[:room]).tolist():
                if 2 * a > room and pair and a > best:
                    break
                b = int(below[room - a])
                if b == a and free[a] < 2:
                    b = int(below[a - 1]) if a else 0
                if b and a + b > best:
                    best, pair = a + b, (a, b)
            if pair:
                own[least] -= 1
                own.update(pair)
                own = +own
        many = min(int(left[n]) // c for n, c in own.items())
        for n, c in own.items():
            left[n] -= many * c
        out.append((many, sorted(own.items(), reverse=True)))
    return out


def _placing(patterns: list[tuple[int, list[tuple[int, int]]]]):
    """For each length the first rank of each of its runs, with first sequence, pieces in a bin and offset there."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for many, bin_ in patterns:
        offset = 0
        for n, c in bin_:
            runs.setdefault(n, []).append((used[n], sequence, c, offset))
            used[n] += many * c
            offset += n * c
        sequence += many
    tables = {n: np.array(x, dtype=np.int64).T for n, x in runs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            length, rank = (rows.column(i).to_numpy() for i in (3, 5))
            ids, offsets = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[own[0]])
                first, seq, c, off = tables[n]
                k = np.searchsorted(first, rank[own], side="right") - 1
                r = rank[own] - first[k]
                ids[own], offsets[own] = seq[k] + r // c[k], off[k] + r % c[k] * n
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array(ids), pa.array(offsets)], schema=_PLACED)

    return run


def packed(docs: DataFrame, tokenizer: str | None = None, end: int = 2, size: int = 1024, cache: int = Encoder.LIMIT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  ``cache`` bounds the chunks that a worker keeps."""
    pieces, _ = staged(texts_of(docs).mapInArrow(_pieces(tokenizer or default_path(), end, size, cache), PIECES), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = dict(pieces.groupBy("length").count().collect())  # at most ``size`` rows
    ranked = pieces.join(bases, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placing(best_two_fit(histogram, size)), PLACED)
