"""Shards of nearly equal bytes by histogram sort: exact splitters are searched first, then rows move once.

Rows are numbered and written once, with their key and size; so each has a place of its own in the order (key, number), and rows of
one key can be parted too.  A round counts the exact bytes below a set of probes over all partitions: each row finds its
probe by binary search in a literal, and sums by probe are few.  Each splitter that is not within the tolerance of
its share then gets new probes between its nearest two, ``FAN`` of them, until it meets the tolerance or no row lies between.
After that one exchange brings the rows to their pieces (``parts`` of a shard, so that a shard of any size is sorted
by many tasks), where they are numbered; what lies before a piece is known from the counts.

DataFrame operations only.  The driver holds probes and sums, about ``PROBES`` a round, whatever the size of the data.

Edge cases: rows without key come first, ordered by number; equal keys and equal rows are parted where the bytes ask for it; null texts have no
bytes of their own; a row larger than a share leaves shards beside it empty; empty tables give empty results; other
columns are handed on, and may be named like those that are added (``shard``, ``slot``, ``size``), as all are taken by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, positional, staged

#: What a row weighs beside its text.
OVERHEAD = 16
#: Splitters that are searched at most; new probes for each splitter and round, and for all.
MOST, FAN, PROBES = 16_000, 12, 50_000
#: Bytes of a piece, which one task sorts, unless ``MOST`` makes them larger.
PIECE_BYTES = 64 << 20
_LOW = -(1 << 63)


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def _place(key: int, number: int) -> int:
    """A place in the order (key, number) as one integer."""
    return key * (1 << 63) + number


def _literal(places: list[int]) -> Column:
    """Ascending places as one literal, read from text: the parser would take long over many."""
    rows = ",".join('{"key":%d,"number":%d}' % divmod(p, 1 << 63) for p in places)
    return F.from_json(F.lit(f"[{rows}]"), "array<struct<key:bigint,number:bigint>>")


def below(places: list[int]) -> Column:
    """How many of some ascending places are at most the row's (key, number): binary search in a literal."""
    if not places:
        return F.lit(0)
    probes, own = _literal(places), F.struct(F.col("key"), F.col("number"))
    steps = [1 << i for i in range(len(places).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= len(places)) & (F.get(probes, at + step - 1) <= own), at + step).otherwise(at))


def _counted(rows: DataFrame, places: list[int]) -> dict[int, tuple[int, int]]:
    """Bytes and rows between neighbouring places, by how many places are at or below."""
    return {r[0]: (r[1] or 0, r[2]) for r in rows.groupBy(below(places).alias("at")).agg(F.sum("size"), F.count("*")).collect()}  # one row for each probe


def splitters(rows: DataFrame, pieces: int, tolerance: float = 0.0) -> list[int]:
    """The ascending places at which pieces but the first begin; ``rows`` has key, number, size.

    A place is taken when the bytes below it are off by at most ``tolerance`` of a piece's mean, or when no other is nearer (the lower of
    two that are as near); so with 0 the splitters depend on the rows alone.
    """
    total, n, low, high = rows.agg(F.sum("size"), F.count("*"), F.min(F.struct("key", "number")), F.max(F.struct("key", "number"))).first()
    if not total or pieces < 2:
        return []
    known = {_place(*low): (0, 0), _place(*high) + 1: (total, n)}  # bytes and rows below
    off = lambda place, i: abs(known[place][0] * pieces - total * i)
    found: dict[int, int] = {}
    while True:
        places, open_, at = sorted(known), [], 0
        for i in range(1, pieces):
            if i in found:
                continue
            while at + 2 < len(places) and known[places[at + 1]][0] * pieces <= total * i:
                at += 1
            a, b = places[at], places[at + 1]
            near = min(a, b, key=lambda p: (off(p, i), p))  # noqa: B023
            if off(near, i) <= tolerance * total or known[b][1] - known[a][1] <= 1:
                found[i] = near
            else:
                open_.append((a, b))
        fan = max(2, min(FAN, PROBES // max(1, len(open_))))
        new = sorted({a + (b - a) * k // (fan + 1) for a, b in open_ for k in range(1, fan + 1)}.difference(known))
        if not new:
            return [found[i] for i in range(1, pieces)]
        got, sums = _counted(rows, new), (0, 0)
        for k, p in enumerate(new):
            sums = tuple(x + y for x, y in zip(sums, got.get(k, (0, 0)), strict=True))
            known[p] = sums


def sharded(docs: DataFrame, shards: int = 40, key: str = "doc_id", size: Column | None = None, keep: list[str] | None = None, tolerance: float = 0.0, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The rows with ``size``, ``shard`` (0 to shards - 1, in order of the key) and ``slot`` (place in the shard, from 0).

    ``keep`` names the columns that are moved (all of them); ``size`` is a row's bytes, else those of its text.
    """
    keep = docs.columns if keep is None else keep
    weight = size if size is not None else text_size(F.col(column(docs, "text")))
    # Named by place, so no name of the caller's can clash.
    own = positional((docs if size is not None else positional(docs)).withColumn("weight of a row", weight))
    moved = [F.col(column(docs, c)).alias(f"m{i}") for i, c in enumerate(keep)]
    numbered = own.select(*moved, F.coalesce(F.col(column(docs, key)).cast("long"), F.lit(_LOW)).alias("key"), F.monotonically_increasing_id().alias("number"), F.col(f"c{len(docs.columns)}").alias("size"))
    rows, _ = staged(numbered, "numbered")
    sizes = rows.select("key", "number", "size")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    parts = max(1, min(MOST // shards, -(-total // (shards * piece_bytes))))
    borders = splitters(sizes, shards * parts, tolerance)
    counts, first, before = _counted(sizes, borders), [], 0
    for piece in range(shards * parts):
        before = 0 if piece % parts == 0 else before
        first.append(before)
        before += counts.get(piece, (0, 0))[1]
    placed = rows.withColumn("piece", below(borders))
    start = F.element_at(F.expr(f"array({', '.join(f'{x}L' for x in first)})"), F.col("piece") + 1)
    slot = start + F.row_number().over(Window.partitionBy("piece").orderBy("key", "number")) - 1
    return placed.select(*(F.col(f"m{i}") for i in range(len(keep))), F.col("size"), F.floor(F.col("piece") / parts).cast("int").alias("shard"), slot.cast("long").alias("slot")).toDF(*keep, "size", "shard", "slot")


def write_shards(docs: DataFrame, folder: str, shards: int = 40, key: str = "doc_id") -> None:
    """Write whole rows as Parquet, a folder for each shard, each row with its ``slot``."""
    sharded(docs, shards, key).write.partitionBy("shard").option("compression", "zstd").parquet(folder)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = F.col(column(docs, "text")).cast("string")
    # Only what the result needs is moved.
    rows = positional(docs).select(F.col(column(docs, "doc_id")).cast("long").alias("doc_id"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), text_size(text).alias("bytes"))
    out = sharded(rows, size=F.col("bytes"), keep=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
