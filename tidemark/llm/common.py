"""What the operators share: reading tables, staged results, Arrow batches, word splitting and substring hashes.

Staged tables stay as long as a lazy result may read them: until the ``scratch`` block that they were made in
ends, or else until the driver's Python does.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space and \x09-\x0D, just what ``bytes.split()`` splits at.
SPACE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (local tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What ``new_path`` has given out and nobody has removed yet, by block: path -> its file system and name.
_scratch: list[dict[str, tuple]] = [{}]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _scratch[-1][path] = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by way of the cluster's file system."""
    for block in _scratch:
        block.pop(path, None)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clear(block: dict[str, tuple]) -> None:
    for files, target in block.values():
        with contextlib.suppress(Exception):  # the session may have ended
            files.delete(target, True)
    block.clear()


@contextlib.contextmanager
def scratch():
    """Removes at its end what was staged within and not removed: for results that have been written by then."""
    _scratch.append({})
    try:
        yield
    finally:
        _clear(_scratch.pop())


atexit.register(lambda: [_clear(x) for x in _scratch])


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a DataFrame to the shared folder and read it again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def positional(df: DataFrame) -> DataFrame:
    """The columns by place, c0, c1, ...: names that differ in case alone or hold dots are no problem then."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def column(df: DataFrame, name: str) -> str:
    """The name in ``positional`` of the column of just this name, or else of its first spelling in another case."""
    names = df.columns
    at = names.index(name) if name in names else [x.lower() for x in names].index(name.lower())
    return f"c{at}"


def picked(df: DataFrame, **types: str) -> DataFrame:
    """Some columns by their exact names, cast to the given types; other columns do not matter, whatever their names."""
    return positional(df).select(*(F.col(column(df, k)).cast(t).alias(k) for k, t in types.items()))


def texts_of(docs: DataFrame) -> DataFrame:
    return picked(docs, doc_id="long", text="string")


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]):
    """The one large object that a worker keeps between tasks; what another operator kept goes."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    if _held:
        _held.clear()
        trim()


def trim() -> None:
    """Give freed memory back to the system: workers stay between stages, and an executor's limit counts them all."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and, but for single rows, ``size`` bytes of strings."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        n = max(1, min(rows, int(np.searchsorted(ends, before + size, side="right")) - at))
        yield batch.slice(at, n)
        at += n


def by_batch(f: Callable[[dict[str, list]], dict[str, list | np.ndarray | pa.Array]], schema: pa.Schema, rows: int = 256, after: Callable[[], None] | None = None):
    """A function for ``mapInArrow`` that hands on columns as Python lists, in parts as ``slices`` makes them; ``after`` ends a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for part in slices(whole, rows):
                got = f({k: part.column(i).to_pylist() for i, k in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=t.type) for t, x in ((t, got[t.name]) for t in schema)], schema=schema)
        if after:
            after()

    return run


class Rolling:
    """Two independent 64-bit hashes of any word range of a text, from prefix sums over its bytes.

    The words are joined by one space; the hash of words [i, j) is a polynomial in an odd base modulo
    2**64 over the bytes from the start of word i to the end of word j - 1, mixed at the end.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
    _powers = np.ones(1, dtype=np.uint64)
    _inverse = np.ones(1, dtype=np.uint64)
    TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                inverse = np.uint64(pow(int(cls.BASE), -1, 1 << 64))
                cls._powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, cls.BASE, dtype=np.uint64))), dtype=np.uint64)
                cls._inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, inverse, dtype=np.uint64))), dtype=np.uint64)

    def __init__(self, words: list[bytes]):
        self.bytes = b" ".join(words)
        data = np.frombuffer(self.bytes, dtype=np.uint8)
        n = len(data)
        self._grow(n + 1)
        gaps = np.flatnonzero(data == 32)
        self.starts = np.concatenate(([0], gaps + 1)) if words else np.zeros(0, dtype=np.int64)
        self.ends = np.concatenate((gaps, [n])) if words else np.zeros(0, dtype=np.int64)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.TABLE[data] * self._powers[:n], out=self.sums[1:])

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the word ranges [first, last], both inclusive."""
        s, e = self.starts[first], self.ends[last]
        with np.errstate(over="ignore"):
            h = (self.sums[e] - self.sums[s]) * self._inverse[s]
            return mix(h ^ (e - s).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all ranges of k words."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        first = np.arange(n)
        return self.spans(first, first + k - 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))
