"""Near-duplicates by circulant MinHash: banding, then exact Jaccard verification.

Two permutations make all coordinates of a signature.  The first, a hash of the shingle, gives its place s
in a universe of ``UNIVERSE`` places (so it is a permutation only up to collisions, which can but bring sets closer);
the second is one random permutation p of the universe, and coordinate
k is the least p[s + k] over a document's shingles, that is p shifted circularly by k.  The values a
shingle needs lie side by side in p, so a signature is a minimum over slices.

``BANDS`` bands of ``ROWS`` coordinates bring a pair at the threshold of 0.85 together with probability
1 - (1 - 0.85**8)**64, over 1 - 2e-9, and one at 0.8 with over 1 - 8e-6.  Documents with one set are a class, whose smallest document
stands for it.  Links are wanted for the components they make:

1. in each bucket the document that shares most buckets is compared with all others (a star, no pairs);
2. components of the confirmed links; buckets within one component are done;
3. in the others, documents of different components are compared.  Such a bucket is dealt in blocks of ``BLOCK``
   documents: a task meets two blocks, never the whole bucket.

A pair is dropped before its texts are read only if it cannot reach the threshold by the sizes and parity
bitmaps of its sets: bit h of a set's bitmap is the parity of how many shingles hash to h, so the bits in which
two bitmaps differ are at most the shingles that only one of the sets has.  Every other pair counts the full
sets' intersection.  No bucket is capped.

Edge cases: null, empty and blank texts have an empty set and are their own component; texts of fewer than
five words have their whole sequence as the only shingle; copies and repeated rows fall in one class; of rows with
one doc_id and different texts that are the first of their classes, one (of the least text hash) is searched for
links, and all share its component; a row without doc_id has null as ``kept`` and, without a copy that has one, as component; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, by_batch, mix, remove, staged, texts_of
from .components import components

SHINGLE = 5
BANDS, ROWS = 64, 8
UNIVERSE = 1 << 21
#: Documents of an open bucket that one task holds beside as many others.
BLOCK = 256
#: Most documents of links whose numbers are sent to all executors, to thin out the texts before they are shuffled.
SMALL = 1_000_000
#: Words of 64 bits of a parity bitmap.
PARITY = 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_tables: list[np.ndarray] = []


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(Rolling(words).grams(min(SHINGLE, len(words))))


def _slices() -> np.ndarray:
    if not _tables:
        p = np.random.Generator(np.random.PCG64(5)).permutation(UNIVERSE).astype(np.uint32)
        _tables.append(sliding_window_view(np.concatenate((p, p[: BANDS * ROWS])), BANDS * ROWS))
    return _tables[0]


def signature(own: np.ndarray) -> np.ndarray:
    """All coordinates of a set."""
    place = (mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(UNIVERSE)).astype(np.int64)
    slices, out = _slices(), np.full(BANDS * ROWS, UNIVERSE, dtype=np.uint32)
    for at in range(0, len(place), 64):  # such a part stays in the cache
        np.minimum(out, slices[place[at : at + 64]].min(axis=0), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, its number included."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return key.view(np.int64)


def parity(own: np.ndarray) -> list[int]:
    """The set's parity bitmap, as signed words."""
    counts = np.bincount((mix(own + np.uint64(0x632BE59BD9B4E019)) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY)
    return np.packbits(counts & 1).view("<i8").tolist()


_BITS = [f"p{i}" for i in range(PARITY)]
_SIGNED = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64())), *((p, pa.int64()) for p in _BITS)])


def _signed(rows: dict[str, list]) -> dict:
    out: dict[str, list] = {k: [] for k in _SIGNED.names}
    for d, body, text in zip(rows["doc_id"], rows["body"], rows["text"], strict=True):
        own = shingles(text)
        s1, s2 = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), dtype="<i8").tolist()
        for k, v in zip(_SIGNED.names, (d, body, len(own), s1, s2, bands(signature(own)) if len(own) else [], *parity(own)), strict=True):
            out[k].append(v)
    return out


_LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(percent: int):
    def run(rows: dict[str, list]) -> dict:
        known: dict[str, np.ndarray] = {}
        out = []
        for a, x, b, y in zip(rows["a"], rows["text_a"], rows["b"], rows["text_b"], strict=True):
            if x not in known:
                if len(known) > 64:
                    known.clear()
                known[x] = shingles(x)
            one, two = known[x], shingles(y)
            both = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * both >= percent * (len(one) + len(two) - both):
                out.append((a, b))
        return {"a": [a for a, _ in out], "b": [b for _, b in out]}

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, body_a, body_b) those whose full sets reach the threshold.

    Only the texts of their documents are shuffled.  The smaller side, the stars' centres, is joined last.
    """
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    if ends.limit(SMALL + 1).count() <= SMALL:
        texts = texts.join(F.broadcast(ends), "doc_id", "left_semi")
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("body").alias(f"body_{x}"), F.col("text").alias(f"text_{x}"))
    one = pairs.join(side("b"), ["b", "body_b"])
    both = one.join(side("a"), ["a", "body_a"]).select("a", "text_a", "b", "text_b")
    return both.mapInArrow(by_batch(_linked(percent), _LINKED, 64), "a long, b long").distinct()


def may_reach(na, nb, percent: int, a: str = "", b: str = "") -> Column:
    """Whether sets of such sizes and parity bitmaps (columns named p0, ... with these endings) can reach the threshold."""
    apart = sum((F.bit_count(F.col(f"{p}{a}").bitwiseXOR(F.col(f"{p}{b}"))) for p in _BITS), F.lit(0))
    most = F.floor((na + nb - apart) / 2)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * most >= percent * (na + nb - most))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept: one row per document.

    ``class_id`` is the smallest document with the same set; links join classes.
    """
    spark = docs.sparkSession
    texts = texts_of(docs).select("doc_id", F.xxhash64("text").alias("body"), "text")
    signed, _ = staged(texts.mapInArrow(by_batch(_signed, _SIGNED, 128), "doc_id long, body long, n long, s1 long, s2 long, keys array<long>, " + ", ".join(f"{p} long" for p in _BITS)), "signed")
    classes, _ = staged(signed.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id")), "classes")
    # The first document of each class stands for it.
    first = signed.where("n > 0").join(classes.select("s1", "s2", F.col("class_id").alias("doc_id")), ["s1", "s2", "doc_id"], "left_semi")
    least = first.groupBy("doc_id").agg(F.min("body").alias("body"))
    several = least.count() < first.count()  # repeated rows, or rows of one doc_id with different texts
    reps = first.join(least, ["doc_id", "body"], "left_semi").dropDuplicates(["doc_id"]) if several else first
    reps, reps_path = staged(reps.select("doc_id", "body", "n", "keys", *_BITS), "reps")
    # Buckets of at least two classes; a document's score is how many others it meets in all of them.
    own = reps.select("doc_id", "n", F.explode("keys").alias("key"))
    sizes = own.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    met, met_path = staged(own.join(sizes, "key").select("key", "doc_id", "n", "k"), "buckets")
    score = met.groupBy("doc_id").agg(F.sum("k").alias("score"))
    met2, met2_path = staged(met.join(score, "doc_id").select("key", "doc_id", "n", "k", "score"), "buckets")
    remove(spark, met_path)
    centre = met2.groupBy("key").agg(F.max(F.struct(F.col("score"), (-F.col("doc_id")).alias("neg"), F.col("n").alias("na"))).alias("c")).select("key", (-F.col("c.neg")).alias("a"), "c.na")
    fits = (100 * F.least("na", "nb")) >= (percent * F.greatest("na", "nb"))
    star = met2.select("key", F.col("doc_id").alias("b"), F.col("n").alias("nb")).join(centre, "key").where(F.col("a") != F.col("b")).where(fits).select("a", "b").distinct()
    star, star_path = staged(star, "stars")
    # Both sides are plain tables, so that a centre with many pairs can be dealt to several tasks.
    ends = lambda x: reps.select(F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("body", "n", *_BITS)))
    fit = star.join(ends("b"), "b").join(ends("a"), "a").where(may_reach(F.col("n_a"), F.col("n_b"), percent, "_a", "_b"))
    pairs, pairs_path = staged(fit.select("a", "b", "body_a", "body_b"), "pairs")
    links, _ = staged(confirmed(pairs, texts, percent), "links")
    part, _ = staged(components(links), "parts")
    # Buckets that still hold several components.
    placed = met2.select("key", "doc_id", "k").join(part, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", "k", F.coalesce("component", "doc_id").alias("part"))
    placed, placed_path = staged(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    open_, open_path = staged(placed.join(mixed, "key").withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "open")
    ranked, ranked_path = staged(open_.join(reps.drop("keys"), "doc_id"), "open")
    side = lambda s, i, j: ranked.select("key", i, j, *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "body", "n", "part", *_BITS)))
    a = side("a", F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"))
    b = side("b", F.explode(F.expr("sequence(0, block)")).alias("i"), F.col("block").alias("j"))
    apart = (F.col("part_a") != F.col("part_b")) & ((F.col("i") < F.col("j")) | (F.col("doc_id_a") < F.col("doc_id_b")))
    cross = a.join(b, ["key", "i", "j"]).where(apart & may_reach(F.col("n_a"), F.col("n_b"), percent, "_a", "_b"))
    ordered = F.array_sort(F.array(*(F.struct(F.col(f"doc_id_{x}").alias("d"), F.col(f"body_{x}").alias("body")) for x in "ab")))
    cross = cross.select(ordered.alias("x")).select(F.expr("x[0].d").alias("a"), F.expr("x[1].d").alias("b"), F.expr("x[0].body").alias("body_a"), F.expr("x[1].body").alias("body_b")).distinct()
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more, more_path = staged(cross.join(known, ["a", "b"], "left_anti"), "pairs")
    found, _ = staged(confirmed(more, texts, percent), "links")
    whole = components(links.unionByName(found)) if not found.isEmpty() else part
    members = signed.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").join(classes, ["s1", "s2"], "left")
    out = members.withColumn("class_id", F.coalesce("class_id", "doc_id")).join(whole, F.col("class_id") == F.col("node"), "left")
    out = out.select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    for path in (reps_path, met2_path, star_path, pairs_path, placed_path, open_path, ranked_path, more_path):
        remove(spark, path)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
