"""Shards by histogram sort against a plain sort and running sums."""

import random
import zlib

import pytest

from tidemark.llm import sharding

RND = random.Random(3)
ROWS = [(i, "x" * RND.randint(0, 400)) for i in range(0, 900, 3)] + [(77, "hot") for _ in range(200)] + [(None, "n" * 50) for _ in range(90)] + [(-5, None), (1 << 62, "é" * 3000), (-(1 << 63), "least"), ((1 << 63) - 1, "")]


def brute(sizes, shards):
    """The shard and slot of rows in order: each border goes to the place whose bytes below are nearest to its share."""
    below = [0]
    for x in sizes:
        below.append(below[-1] + x)
    borders = [min(range(len(below)), key=lambda p: (abs(below[p] * shards - below[-1] * i), p)) for i in range(1, shards)]
    out, first = [], {}
    for p in range(len(sizes)):
        shard = sum(b <= p for b in borders)
        first.setdefault(shard, p)
        out.append((shard, p - first[shard]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 1, "s") for d, t in ROWS], "doc_id long, text string, a int, b string").repartition(5).toDF("doc_id", "text", "shard", "TEXT")


@pytest.mark.parametrize("piece_bytes", [1 << 20, 700])
def test_every_border_is_the_nearest_even_within_a_hot_key(docs, piece_bytes):
    got = sharding.sharded(docs, 7, piece_bytes=piece_bytes).toDF("doc_id", "text", "a", "b", "size", "shard", "slot").collect()
    assert len(got) == len(ROWS)
    got.sort(key=lambda r: (r.shard, r.slot))
    keys = [-(1 << 63) if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys) and all(r.size == 16 + len((r.text or "").encode()) for r in got)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(ROWS, key=str)
    assert [(r.shard, r.slot) for r in got] == brute([r.size for r in got], 7)


def test_tolerance_ends_the_search_early(spark):
    rows = spark.range(20_000).selectExpr("id * 7 AS key", "id AS number", "10L AS size")
    for tolerance in (0.0, 0.01):
        places = sharding.splitters(rows, 4, tolerance)
        below = [sum(k * 7 << 63 | k < p for k in range(20_000)) for p in places]
        assert all(abs(b - 5000 * i) <= 5000 * tolerance for i, b in enumerate(below, 1))


def test_digest_and_files(docs, tmp_path):
    got = {(r.doc_id, r.size): r for r in sharding.digest(docs).collect()}
    r = got[1 << 62, 16 + 6000]
    assert (r.text_crc32, r.law, r.grown_shard) == (zlib.crc32("é".encode() * 3000), "bytes", None)
    assert got[-5, 16].text_crc32 == 0 and sum(1 for _ in got) == len({(d, 16 + len((t or "").encode())) for d, t in ROWS})
    plain = docs.toDF("doc_id", "text", "a", "b")
    sharding.write_shards(plain, str(tmp_path / "out"), 5)
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS) and back.select("shard").distinct().count() == 5 and "text" in back.columns


def test_empty_and_tiny_tables(docs):
    assert sharding.digest(docs.limit(0)).collect() == []
    assert {(r.shard, r.slot) for r in sharding.digest(docs.where("doc_id = -5")).collect()} <= {(s, 0) for s in range(40)}
