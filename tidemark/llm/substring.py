"""Substring dedup over a log-structured index of window fingerprints.

Every window of ``WINDOW`` words is anchored at its least 16-word hash (leftmost on ties), so equal windows
have equal anchors.  Consecutive windows with one anchor form a context; a document gives one row
(h, ctx, doc_id, body, spot) per context: the anchor's hash, a cryptographic digest of the context's words, a hash of
the text, and its first window with how many windows it has (at most 35, so both are one number).  That is about one
row for each 18 words.

The index is a folder of sorted immutable runs, one for each ingested batch, each with the smallest document
of every (h, ctx).  A batch is merge-joined with the runs by h:

* same h and ctx in a smaller document: all windows of the context are repeats;
* same h, other ctx: the windows may be shared in part.  Only the smallest document of each ctx has to be
  looked at, as the others are repeats already.  Their windows are read from the texts and verified one by
  one with 128-bit digests of their words.

Then the batch's own run is added, and runs of a level are compacted into one of the next once there are
``fanout`` of them.  Batches come in ascending doc_id, so a run only holds smaller documents.  Groups of
copies are aggregated before they are shuffled, and no pairs of documents are made.

Edge cases: null, empty and short texts (under 50 words) have no windows and keep all words; repeated
windows within one document alone are kept; rows of one doc_id with several texts are told apart by a 64-bit hash of
the text, are cut each by its own windows, and never cut each other; rows without doc_id are kept whole; empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, by_batch, new_path, remove, staged, texts_of

WINDOW = 50
ANCHOR = 16
#: A context's first window and its number of windows in one: at * SPOT + n.
SPOT = 64
ROW = "h long, ctx long, doc_id long, body long, spot long"
_ROW = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("doc_id", pa.int64()), ("body", pa.int64()), ("spot", pa.int64())])


def contexts(text: str | None) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray] | None:
    """(h, ctx, first window, windows) of a text's contexts."""
    words = (text or "").encode().split()
    if len(words) < WINDOW:
        return None
    r = Rolling(words)
    grams = r.grams(ANCHOR)
    n = len(words) - WINDOW + 1
    width = WINDOW - ANCHOR + 1
    anchor = np.concatenate([sliding_window_view(grams[a : a + 65536 + width - 1], width).argmin(axis=1) + np.arange(a, min(a + 65536, n)) for a in range(0, n, 65536)])
    first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
    last = np.concatenate((first[1:], [n])) - 1
    data = r.bytes
    digests = b"".join(hashlib.blake2b(data[s:e], digest_size=8).digest() for s, e in zip(r.starts[first].tolist(), r.ends[last + WINDOW - 1].tolist(), strict=True))
    return grams[anchor[first]].view(np.int64), np.frombuffer(digests, dtype="<i8"), first, last - first + 1


def _fingerprints(rows: dict[str, list]) -> dict:
    parts = [(d, b, x) for d, b, x in ((d, b, contexts(t)) for d, b, t in zip(rows["doc_id"], rows["body"], rows["text"], strict=True)) if x]
    if not parts:
        return {k: [] for k in _ROW.names}
    sizes = [len(x[0]) for _, _, x in parts]
    ids, bodies = (np.repeat(np.array([p[i] for p in parts], dtype=np.int64), sizes) for i in (0, 1))
    h, ctx, at, n = (np.concatenate([x[i] for _, _, x in parts]) for i in range(4))
    return {"h": h, "ctx": ctx, "doc_id": ids, "body": bodies, "spot": at * SPOT + n}


def _bodies(docs: DataFrame) -> DataFrame:
    """doc_id, body, text: ``body`` is the text's hash, which tells rows of one doc_id apart."""
    return texts_of(docs).select("doc_id", F.xxhash64("text").alias("body"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per context of each document."""
    return _bodies(docs).where("doc_id IS NOT NULL").mapInArrow(by_batch(_fingerprints, _ROW), ROW)


def _least(rows: DataFrame) -> DataFrame:
    """The smallest document of each (h, ctx), and how many rows there were."""
    got = rows.groupBy("h", "ctx").agg(F.min(F.struct("doc_id", "body", "spot")).alias("r"), F.sum("many").alias("many"))
    return got.select("h", "ctx", "r.doc_id", "r.body", "r.spot", "many")


class FingerprintIndex:
    """A folder of runs named by level; it can be opened again and grows batch by batch."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 4):
        self.spark, self.folder, self.fanout = spark, folder, fanout

    def runs(self) -> list[tuple[int, str]]:
        """(level, path) of the complete runs."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []
        done = [x for x in names if x.startswith("run-") and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{x}/_SUCCESS"))]
        return [(int(x.split("-")[1]), f"{self.folder}/{x}") for x in done]

    def read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(ROW + ", many long").parquet(*paths)

    def _write(self, rows: DataFrame, level: int) -> None:
        rows.repartitionByRange("h", "ctx").sortWithinPartitions("h", "ctx").write.option("compression", "zstd").parquet(f"{self.folder}/run-{level:03d}-{uuid.uuid4().hex}")

    def ingest(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Join a batch's fingerprints with the runs, then add its run.

        Returns (spans, open): the word spans [start, stop) that repeat a smaller document, and the contexts
        (doc_id, body, spot) whose windows have still to be verified against each other.
        """
        own, own_path = staged(_least(batch.withColumn("many", F.lit(1).cast("long"))), "classes")
        old = self.runs()
        known = own
        if old:
            hits = self.read([p for _, p in old]).hint("merge").join(own.select("h").distinct(), "h", "left_semi")
            known = _least(own.unionByName(hits))
        known, known_path = staged(known, "known")
        several = known.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h", F.lit(True).alias("several"))
        marked = known.join(several, "h", "left").where("many > 1 OR several").select("h", "ctx", F.col("doc_id").alias("least"), F.col("body").alias("least_body"), F.col("spot").alias("least_spot"), F.coalesce("several", F.lit(False)).alias("several"))
        marked, marked_path = staged(marked, "marked")
        met = batch.join(marked.select("h", "ctx", "least", "several"), ["h", "ctx"]).where("least < doc_id OR several").select("doc_id", "body", "spot", (F.col("least") < F.col("doc_id")).alias("repeat"))
        met, met_path = staged(met, "met")
        at, n = F.expr(f"spot div {SPOT}"), F.col("spot") % SPOT
        spans = met.where("repeat").select("doc_id", "body", at.alias("start"), (at + n + (WINDOW - 1)).alias("stop"))
        opened = met.where("NOT repeat").select("doc_id", "body", "spot").unionByName(marked.where("several").select(F.col("least").alias("doc_id"), F.col("least_body").alias("body"), F.col("least_spot").alias("spot")))
        self._write(own, 0)
        for path in (own_path, known_path):
            remove(self.spark, path)
        self.compact()
        return spans, opened

    def compact(self) -> None:
        """Merge the runs of each level that has ``fanout`` of them."""
        level = 0
        while any(x >= level for x, _ in self.runs()):
            paths = [p for x, p in self.runs() if x == level]
            if len(paths) >= self.fanout:
                self._write(_least(self.read(paths)), level + 1)
                for p in paths:
                    remove(self.spark, p)
            level += 1


_SEEN = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("body", pa.int64()), ("at", pa.int64())])


def _windows(rows: dict[str, list]) -> dict:
    digests, ids, bodies, places = [], [], [], []
    for d, body, text, spots in zip(rows["doc_id"], rows["body"], rows["text"], rows["spots"], strict=True):
        r = Rolling((text or "").encode().split())
        at = np.unique(np.concatenate([np.arange(x // SPOT, x // SPOT + x % SPOT) for x in spots]))
        data = r.bytes
        digests += [hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in zip(r.starts[at].tolist(), r.ends[at + WINDOW - 1].tolist(), strict=True)]
        places.append(at)
        ids.append(np.full(len(at), d, dtype=np.int64))
        bodies.append(np.full(len(at), body, dtype=np.int64))
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return {"w1": both[:, 0], "w2": both[:, 1], "doc_id": np.concatenate(ids), "body": np.concatenate(bodies), "at": np.concatenate(places)}


def verified(opened: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans of the windows of open contexts that a smaller document has too, by digests of their words."""
    spots = opened.groupBy("doc_id", "body").agg(F.collect_set("spot").alias("spots"))
    seen, _ = staged(_bodies(docs).join(spots, ["doc_id", "body"]).mapInArrow(by_batch(_windows, _SEEN, 128), "w1 long, w2 long, doc_id long, body long, at long"), "windows")
    shared = seen.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("w1", "w2", "least")
    return seen.join(shared, ["w1", "w2"]).where("least < doc_id").select("doc_id", "body", F.col("at").alias("start"), (F.col("at") + WINDOW).alias("stop"))


_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _cut(digest: bool):
    def run(rows: dict[str, list]) -> dict:
        out: tuple[list, ...] = ([], [], [])
        for text, spots in zip(rows["text"], rows["spots"], strict=True):
            words = (text or "").encode().split()
            n = len(words)
            if spots:
                edge = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edge, [x["start"] for x in spots], 1)
                np.add.at(edge, [x["stop"] for x in spots], -1)
                words = list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))
            kept = b" ".join(words)
            out[0].append(n)
            out[1].append(n - len(words))
            out[2].append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
        return {"doc_id": rows["doc_id"], "n_words": out[0], "n_removed": out[1], "kept_text": out[2]}

    return run


def deduplicated(docs: DataFrame, batches: int = 3, digest: bool = False, fanout: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (its words joined by one space; with ``digest`` its SHA-256).

    The documents are ingested in ``batches`` of ascending doc_id; after the second the runs are compacted.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "substring")
    rows, rows_path = staged(fingerprints(docs), "fingerprints")
    cuts = sorted(set(rows.stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.02)))
    index = FingerprintIndex(spark, f"{folder}/index", fanout)
    spans = opened = None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows
        if lo is not None:
            part = part.where(F.col("doc_id") > int(lo))
        if hi is not None:
            part = part.where(F.col("doc_id") <= int(hi))
        s, o = index.ingest(part)
        spans, opened = (s, o) if spans is None else (spans.unionByName(s), opened.unionByName(o))
    remove(spark, rows_path)
    remove(spark, folder)
    every = spans.unionByName(verified(opened, docs))
    spots = every.groupBy("doc_id", "body").agg(F.collect_set(F.struct("start", "stop")).alias("spots"))
    return _bodies(docs).join(spots, ["doc_id", "body"], "left").select("doc_id", "text", "spots").mapInArrow(by_batch(_cut(digest), _CUT), "doc_id long, n_words long, n_removed long, kept_text string")
