"""Token output as one wavelet matrix per shard.

A shard file holds the ids of its documents, in ascending doc_id order, as a wavelet matrix: one bit plane
for each bit of the largest id, from the highest down, where each plane stably parts zeros from ones.
With rank counts over 512-bit blocks the planes answer token access, counting of an id in any range and
the place of its k-th occurrence without decoding the sequence; ``decode`` restores all of it.

File: magic, length of a JSON header, header, then zstd frames of the document ids (differences), the
document lengths and each plane.  Executors write a temporary name and rename it, so a lost or repeated
attempt leaves the same file.

Edge cases: a null or empty text is just the end id; documents without doc_id come first and keep none;
an empty table makes no file and an empty result; repeated doc_ids keep one entry each (in any order);
extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, slices, texts_of
from .tokens import Encoder, default_path

MAGIC = b"TMWM0001"
BLOCK = 512
#: Most ranges of doc_id, which are tasks; a range writes as many files as its ids need.
RANGES = 50_000


class WaveletMatrix:
    """Bit planes with rank and select support."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self._ranks: dict[int, np.ndarray] = {}

    @classmethod
    def built(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes, zeros = [], []
        row = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        for level in range(depth - 1, -1, -1):
            bits = (row & row.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bits))
            low = row[~bits]
            zeros.append(len(low))
            row = np.concatenate((low, row[bits]))
        return cls(len(ids), planes, zeros)

    def bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n).view(bool)

    def _block_ranks(self, level: int) -> np.ndarray:
        if level not in self._ranks:
            data = np.zeros(-(-len(self.planes[level]) // (BLOCK // 8)) * (BLOCK // 8), dtype=np.uint8)
            data[: len(self.planes[level])] = self.planes[level]
            self._ranks[level] = np.concatenate(([0], np.cumsum(np.bitwise_count(data).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64))))
        return self._ranks[level]

    def rank1(self, level: int, i: int) -> int:
        """How many ones stand before place i of a plane."""
        block, rest = divmod(i, BLOCK)
        start = block * BLOCK // 8
        part = self.planes[level][start : start + rest // 8]
        ones = int(self._block_ranks(level)[block]) + int(np.bitwise_count(part).sum(dtype=np.int64))
        if rest % 8:
            ones += (int(self.planes[level][start + rest // 8]) >> (8 - rest % 8)).bit_count()
        return ones

    def _find(self, level: int, k: int, one: bool) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        ranks = self._block_ranks(level)
        marks = ranks if one else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(marks, k, side="right")) - 1
        start = block * BLOCK // 8
        bits = np.unpackbits(self.planes[level][start : start + BLOCK // 8]).view(bool)
        return block * BLOCK + int(np.flatnonzero(bits if one else ~bits)[k - int(marks[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = (int(self.planes[level][i >> 3]) >> (7 - (i & 7))) & 1
            ones = self.rank1(level, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        if value >> len(self.planes):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            lo, hi = (zeros + a, zeros + b) if value >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs in [lo, hi)."""
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        lo, hi = self._range(value, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = bool(value >> (len(self.zeros) - 1 - level) & 1)
            i = self._find(level, i - self.zeros[level] if one else i, one)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        row = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bits, zeros = self.bits(level), self.zeros[level]
            up = np.empty_like(row)
            up[~bits] = row[:zeros]
            up[bits] = row[zeros:] | row.dtype.type(1 << (len(self.planes) - 1 - level))
            row = up
        return row.astype("<u4")


def to_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, unnamed: int = 0) -> bytes:
    """A shard file; its first ``unnamed`` documents have no doc_id."""
    matrix = WaveletMatrix.built(ids)
    pack = zstandard.ZstdCompressor(level=1).compress
    frames = [pack(np.diff(doc_ids, prepend=0).astype("<i8").tobytes()), pack(lengths.astype("<i8").tobytes()), *(pack(p.tobytes()) for p in matrix.planes)]
    header = json.dumps({"n": matrix.n, "docs": len(doc_ids), "unnamed": unnamed, "zeros": matrix.zeros, "frames": [len(x) for x in frames]}).encode()
    return b"".join((MAGIC, struct.pack("<I", len(header)), header, *frames))


def unnamed_of(data: bytes) -> int:
    """How many documents at the front of a shard file have no doc_id."""
    return json.loads(data[12 : 12 + struct.unpack("<I", data[8:12])[0]])["unnamed"]


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids (0 where there is none), document lengths and the matrix of a shard file."""
    if data[:8] != MAGIC:
        raise ValueError("not a shard file")
    (size,) = struct.unpack("<I", data[8:12])
    head, at, frames = json.loads(data[12 : 12 + size]), 12 + size, []
    unpack = zstandard.ZstdDecompressor().decompress
    for n in head["frames"]:
        frames.append(unpack(data[at : at + n]))
        at += n
    planes = [np.frombuffer(x, dtype=np.uint8) for x in frames[2:]]
    return np.cumsum(np.frombuffer(frames[0], dtype="<i8")), np.frombuffer(frames[1], dtype="<i8"), WaveletMatrix(head["n"], planes, head["zeros"])


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


_WRITTEN = pa.schema([("part", pa.int64()), ("cut", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def _writer(folder: str, tokenizer: str, end: int, shard_tokens: int):
    stop = np.array([end], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        encoder = Encoder.at(tokenizer)
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        size = cut = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            data = to_bytes(np.array([d or 0 for d in docs], dtype=np.int64), np.array([len(x) + 1 for x in parts[::2]], dtype=np.int64), ids, sum(d is None for d in docs))
            name = f"{base}/shard-{part:08d}-{cut:06d}.wm"
            with store.open_output_stream(f"{name}.{attempt}") as f:
                f.write(data)
            store.move(f"{name}.{attempt}", name)
            return pa.RecordBatch.from_pylist([{"part": part, "cut": cut, "path": name, "n_docs": len(docs), "n_tokens": len(ids)}], schema=_WRITTEN)

        for whole in batches:
            for rows in slices(whole, 2048):
                for d, x in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1)), strict=True):
                    docs.append(d)
                    parts += (x, stop)
                    size += len(x) + 1
                    if size >= shard_tokens:
                        yield flush()
                        docs, parts, size, cut = [], [], 0, cut + 1
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = 0, shard_bytes: int = 16 << 20, shard_tokens: int = 8 << 20) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the written table of shards (part, cut, path, n_docs, n_tokens).

    Documents are dealt by ranges of doc_id, one range for each ``shard_bytes`` of text up to ``RANGES`` of them; a
    range with more than ``shard_tokens`` ids is cut into further files at document borders.
    """
    read = texts_of(docs)
    total = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = read.repartitionByRange(min(RANGES, max(1, -(-total // shard_bytes))), "doc_id").sortWithinPartitions("doc_id")
    written = dealt.mapInArrow(_writer(f"{folder}/shards", tokenizer or default_path(), end, shard_tokens), "part long, cut long, path string, n_docs long, n_tokens long")
    written.write.parquet(f"{folder}/table")
    return docs.sparkSession.read.schema(written.schema).parquet(f"{folder}/table")


def _reader(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for rows in batches:
            for path, before in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                with store.open_input_stream(path) as f:
                    raw = f.read()
                docs, lengths, matrix = from_bytes(raw)
                data = memoryview(matrix.decode().tobytes())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=np.arange(len(docs)) < unnamed_of(raw)), pa.array(starts + before), pa.array(lengths), pa.array(crc, type=pa.int64())], schema=schema)

    return run


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the files.

    What stands before a shard is summed over the ranges, of which there are at most ``RANGES``, and within its range.
    """
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("first"))
    placed = shards.withColumn("own", before(Window.partitionBy("part").orderBy("cut"))).join(ranges, "part").select("path", (F.col("first") + F.col("own")).alias("before"))
    n = min(RANGES, max(1, shards.count()))
    return placed.repartition(n, "path").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame) -> DataFrame:
    """Write all documents into a new folder and read them back."""
    folder = new_path(docs.sparkSession, "wavelet")
    return read_shards(write_shards(docs, folder), folder)
