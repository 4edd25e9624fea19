"""Benchmark decontamination over a distributed positional inverted index.

Test items are cut into windows of ten words (shorter items are one window).  The index holds postings
(term, doc_id, positions) of the training tokens that the search starts from: of each window the two
rarest terms, by counts over all documents.  Their lists are shifted by the terms' offsets and
intersected on (document, start); what is left is compared word for word with the document's text.

Windows are taken in blocks of bounded size, so what is sent to every executor does not grow with the
benchmark.  Candidates are sent to all executors only when their counted number is small; beyond that they
are joined with the documents by a shuffle.

Edge cases: null, empty and wordless texts have no words and no hits; items without words have no windows;
an item may occur in many documents and a document hold many items, each occurrence counts; rows of one doc_id, or of
none, with different texts are told apart by a 64-bit hash of the text, equal rows share one result and each has its own row; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, new_path, picked, release, remove, slices, staged, texts_of

WINDOW = 10
#: Most windows in a block, and most candidates that are sent to all executors.
BLOCK = 200_000
SMALL = 300_000
#: Of ten words of a window, how many a proximity match needs.
NEAR = 8
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and characters beyond ASCII."""
    return (text or "").encode().translate(_WORDS).split()


def windows_of(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The distinct windows of an item, as words joined by spaces."""
    words = words_of(text)
    return list(dict.fromkeys(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))) if words else []


_WINDOWS = pa.schema([("item_id", pa.string()), ("win", pa.binary())])


def _windows(size: int):
    def run(rows: dict[str, list]) -> dict:
        got = [(i, w) for i, t in zip(rows["item_id"], rows["text"], strict=True) for w in windows_of(t, size)]
        return {"item_id": [i for i, _ in got], "win": [w for _, w in got]}

    return run


_COUNTS = pa.schema([("term", pa.binary()), ("n", pa.int64())])


def _counts(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        release()
        for whole in batches:
            for rows in slices(whole, 256):
                for text in rows.column(0).to_pylist():
                    seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.binary()), pa.array(list(seen.values()), type=pa.int64())], schema=_COUNTS)

    return run


#: What tells documents apart in the index; a missing doc_id is 0 there, and part of the hash.
KEY = ["doc_id", "body"]
_POSTINGS = pa.schema([("term", pa.int32()), ("doc_id", pa.int64()), ("body", pa.int64()), ("places", pa.list_(pa.int32()))])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, body, nameless and text."""
    read = texts_of(docs)
    return read.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("body"), F.col("doc_id").isNull().alias("nameless"), "text")


def _postings(terms: dict[bytes, int]):
    """Positions of each term in each document; term -1 has the document's number of words, and 1 where it has no doc_id."""

    def run(rows: dict[str, list]) -> dict:
        out: tuple[list, ...] = ([], [], [], [])
        for d, body, nameless, text in zip(rows["doc_id"], rows["body"], rows["nameless"], rows["text"], strict=True):
            words = words_of(text)
            own: dict[int, list[int]] = {-1: [len(words), int(nameless)]}
            for i, w in enumerate(words):
                if w in terms:
                    own.setdefault(terms[w], []).append(i)
            out[0].extend(own)
            out[1].extend([d] * len(own))
            out[2].extend([body] * len(own))
            out[3].extend(own.values())
        return dict(zip(_POSTINGS.names, out, strict=True))

    return run


_FOUND = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("win", pa.int32()), ("start", pa.int32())])


def _is_at(words: list[bytes], start: int, window: bytes) -> bool:
    return start >= 0 and b" ".join(words[start : start + window.count(b" ") + 1]) == window


def _verified(windows: list[bytes]):
    def run(rows: dict[str, list]) -> dict:
        out: list[tuple] = []
        for d, body, text, spots in zip(rows["doc_id"], rows["body"], rows["text"], rows["spots"], strict=True):
            words = words_of(text)
            out += [(d, body, x["win"], x["start"]) for x in spots if _is_at(words, x["start"], windows[x["win"]])]
        return {k: [x[i] for x in out] for i, k in enumerate(_FOUND.names)}

    return run


_NEAR = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("win", pa.int32()), ("start", pa.int32()), ("apart", pa.int32()), ("n_match", pa.int32())])


def _matched(windows: list[bytes]):
    """Spots with how many words of the window, each as often as it has them, lie where the spot says; exact ones go."""

    def run(rows: dict[str, list]) -> dict:
        out: list[tuple] = []
        for d, body, text, spots in zip(rows["doc_id"], rows["body"], rows["text"], rows["spots"], strict=True):
            words = words_of(text)
            for x in spots:
                start, apart = x["start"], x["apart"]
                if apart == 0 and _is_at(words, start, windows[x["win"]]):
                    continue
                own = windows[x["win"]].split()
                there = Counter(words[max(0, start + min(apart, 0)) : max(0, start + max(apart, 0) + len(own))])
                out.append((d, body, x["win"], start, apart, (Counter(own) & there).total()))
        return {k: [x[i] for x in out] for i, k in enumerate(_NEAR.names)}

    return run


class PositionalIndex:
    """Postings of the rarest terms of one block of windows, written to ``folder``."""

    def __init__(self, docs: DataFrame, windows: list[bytes], folder: str):
        self.spark, self.folder = docs.sparkSession, folder
        self.docs = _keyed(docs)
        self.windows = windows
        vocabulary = frozenset(t for w in windows for t in w.split())
        counted = self.docs.select("text").mapInArrow(_counts(vocabulary), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
        often = {bytes(t): n for t, n in counted.collect()}  # at most the block's terms
        starts: list[list[tuple[int, bytes]]] = []
        for w in windows:
            rarest = sorted({t: i for i, t in reversed(list(enumerate(w.split())))}.items(), key=lambda x: (often.get(x[0], 0), x[1]))
            starts.append([(i, t) for t, i in rarest[:2]])
        self.terms = {t: k for k, t in enumerate(sorted({t for s in starts for _, t in s}))}
        # A window with a term that no document has cannot occur.
        self.anchors = [(self.terms[t], k, i, role) for k, s in enumerate(starts) if all(often.get(t) for t in windows[k].split()) for role, (i, t) in enumerate(s if len(s) > 1 else s * 2)]
        self.schema = "term int, doc_id long, body long, places array<int>"
        self.docs.mapInArrow(by_batch(_postings(self.terms), _POSTINGS), self.schema).sortWithinPartitions("term", *KEY).write.option("compression", "zstd").parquet(folder)
        self.postings = self.spark.read.schema(self.schema).parquet(folder)

    def lengths(self) -> DataFrame:
        """doc_id, body, nameless and n_words of every row."""
        return self.postings.where("term = -1").select(*KEY, (F.col("places")[1] == 1).alias("nameless"), F.col("places")[0].cast("long").alias("n_words"))

    def shifted(self, role: int) -> DataFrame:
        """(doc_id, body, win, start): where windows would start by their rarest (0) or second rarest (1) term."""
        own = self.spark.createDataFrame([x[:3] for x in self.anchors if x[3] == role], "term int, win int, offset int")
        lists = self.postings.where("term >= 0").join(F.broadcast(own), "term")  # at most BLOCK rows
        return lists.select(*KEY, "win", F.explode("places").alias("place"), "offset").select(*KEY, "win", (F.col("place") - F.col("offset")).alias("start"))

    def phrases(self) -> DataFrame:
        """(doc_id, body, win, start) of exact occurrences."""
        both = self.shifted(0).join(self.shifted(1), [*KEY, "win", "start"]).distinct()
        spots, path = staged(both, "candidates")
        few = spots.count() <= SMALL
        by_doc = spots.groupBy(*KEY).agg(F.collect_list(F.struct("win", "start")).alias("spots"))
        texts = self.docs.join(F.broadcast(by_doc) if few else by_doc, KEY).select(*KEY, "text", "spots")
        return texts.mapInArrow(by_batch(_verified(self.windows), _FOUND, 128), "doc_id long, body long, win int, start int")

    def near(self, slop: int) -> DataFrame:
        """(doc_id, body, win, start, apart, n_match) of inexact occurrences: the two rarest terms at most ``slop`` words off their
        distance, and how many words of the window are there.

        Starts are dealt into cells of ``slop`` + 1 words, and neighbouring cells are met: no product of lists.
        """
        cell = F.floor(F.col("start") / (slop + 1))
        one = self.shifted(0).withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
        two = self.shifted(1).withColumn("cell", cell).withColumnRenamed("start", "other")
        met = one.join(two, [*KEY, "win", "cell"]).withColumn("apart", F.col("other") - F.col("start"))
        spots = met.where(F.abs("apart") <= slop).groupBy(*KEY).agg(F.collect_set(F.struct("win", "start", "apart")).alias("spots"))
        return self.docs.join(spots, KEY).select(*KEY, "text", "spots").mapInArrow(by_batch(_matched(self.windows), _NEAR, 128), "doc_id long, body long, win int, start int, apart int, n_match int").distinct()


def contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document.

    With ``slop`` also n_near: items with a window that is there inexactly, ``NEAR`` of its ten words or more about its
    two rarest terms, which are at most ``slop`` words off their distance.
    """
    spark = docs.sparkSession
    read = picked(items, item_id="string", text="string")
    pairs, pairs_path = staged(read.mapInArrow(by_batch(_windows(size), _WINDOWS), "item_id string, win binary"), "windows")
    distinct = pairs.select("win").distinct()
    blocks = max(1, -(-distinct.count() // BLOCK))
    lengths, hits, held, close = None, None, None, None
    for k in range(blocks):
        windows = sorted(bytes(x[0]) for x in distinct.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == k).collect())
        folder = new_path(spark, "postings")
        index = PositionalIndex(docs, windows, folder)
        lengths = lengths or index.lengths()
        found, _ = staged(index.phrases(), "found")
        names = spark.createDataFrame([(i, w, w.count(b" ") + 1) for i, w in enumerate(windows)], "win int, words binary, size int")
        named = found.join(F.broadcast(names), "win")  # at most BLOCK rows
        hit = named.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("place"))
        own = named.select(*KEY, "words").distinct()
        hits, held = (hit, own) if hits is None else (hits.unionByName(hit), held.unionByName(own))
        if slop is not None:
            by_size = index.near(slop).join(F.broadcast(names), "win").where(10 * F.col("n_match") >= NEAR * F.col("size"))  # at most BLOCK rows
            some, _ = staged(by_size.select(*KEY, "words").distinct(), "near")
            close = some if close is None else close.unionByName(some)
    n_hit = hits.distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    by_item = held.join(pairs.withColumnRenamed("win", "words"), "words").select(*KEY, "item_id").distinct()
    named = by_item.groupBy(*KEY).agg(F.array_sort(F.collect_list("item_id")).alias("ids")).select(*KEY, F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    found = n_hit.join(named, KEY)
    if close is not None:
        n_near = close.join(pairs.withColumnRenamed("win", "words"), "words").groupBy(*KEY).agg(F.countDistinct("item_id").alias("n_near"))
        found = found.join(n_near, KEY, "full_outer")
    out = lengths.join(found, KEY, "left")
    none = F.sha2(F.lit(""), 256)
    more = [] if close is None else [F.coalesce("n_near", F.lit(0)).alias("n_near")]
    return out.select(F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *more)
