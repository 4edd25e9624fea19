"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word is the sum of what it and its characters say: a trained vector of the word and the mean of the
trained vectors of its character 3- to 5-grams (both hashed, both starting from smoothed log odds).  Two
gated recurrent units read a window from either end, attention pools their states, and a document's logit is
that of its highest window.  All windows of ``SPAN`` words at steps of ``STEP`` are scored, over the whole text.
A word of over ``LONGEST`` bytes, as texts without white space are, is read as its runs of letters, ideographs and
other characters, and a run that is still longer as overlapping pieces of ``PIECE`` bytes; each takes a word's place.

Training takes at most ``MOST`` labelled documents of each class (those of the least hash of doc_id) and of those, by
another hash, what fits into ``MOST_BYTES``, none of them held out, and is the same at every size; labels, lang, source
and doc_id are no inputs of a score.

Edge cases: a null, empty or blank text has one window of padding; texts of any length are read whole;
repeated rows score alike; without labels of both classes all scores are the smoothed rate of toxic labels;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, column, mix, picked, positional, release, remove, slices, staged, texts_of, trim

SPAN, STEP = 32, 16
HIDDEN, HALF = 8, 4
WORDS, GRAMS = 1 << 15, 1 << 15
#: Most training documents with label 1, and with label 0, and most bytes of their texts, which the driver reads.
MOST = (1000, 3000)
MOST_BYTES = 16 << 20
THRESHOLD = 0.7
_EDGE = b".,;:!?\"'*#$%&()[]<>|"
#: Bytes of a word that is read in one, and of the pieces of a longer run, which overlap by half.
LONGEST, PIECE = 64, 16
_RUNS = re.compile("[^\\W_\u2e80-\U0010ffff]+|[\u2e80-\U0010ffff]+|(?:_|[^\\w\u2e80-\U0010ffff])+")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text between white space, long ones in parts that have all of their bytes."""
    words = (text or "").encode().split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out: list[bytes] = []
    for w in words:
        if len(w) <= LONGEST or len(core := w.strip(_EDGE)) <= LONGEST:
            out.append(w)
        else:
            for run in map(str.encode, _RUNS.findall(core.decode())):
                out += [run] if len(run) <= LONGEST else [run[i : i + PIECE] for i in range(0, len(run) - PIECE // 2, PIECE // 2)]
    return out


class Parts:
    """The buckets of words, and those of all their character grams side by side."""

    def __init__(self, words: list[bytes]):
        cores = [b"^" + w.strip(_EDGE).lower() + b"$" for w in words]
        cores = [c if len(c) >= 3 else c + b"$" for c in cores]
        self.words = np.fromiter((zlib.crc32(c) % WORDS for c in cores), dtype=np.int64, count=len(cores))
        chunks = [self._grams(cores[i : i + 20_000], i) for i in range(0, len(cores), 20_000)]
        self.owner, self.grams = (np.concatenate([c[k] for c in chunks]) if chunks else np.zeros(0, dtype=np.int32) for k in (0, 1))
        self.counts = np.bincount(self.owner, minlength=len(cores))
        self.ends = np.cumsum(self.counts)

    @staticmethod
    def _grams(cores: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray]:
        """(words counted from ``first``, gram buckets), in order of words."""
        sizes = np.fromiter(map(len, cores), dtype=np.int64, count=len(cores))
        data = np.frombuffer(b"".join(cores) + b"\0" * 4, dtype=np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(first, first + len(cores), dtype=np.int32), sizes)
        rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(owner))  # characters from here to the word's end
        code, grams, owners = data[: len(owner)].copy(), [], []
        for k in range(1, 5):
            code |= data[k : k + len(owner)] << np.uint64(8 * k)
            if k >= 2:
                own = rest > k
                grams.append((mix(code[own] + np.uint64(k << 56)) % np.uint64(GRAMS)).astype(np.int32))
                owners.append(owner[own])
        at = np.concatenate(owners)
        order = np.argsort(at, kind="stable")
        return at[order], np.concatenate(grams)[order]

    def some(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word buckets, owners counted from 0, gram buckets) of some of the words."""
        counts = self.counts[k]
        first = np.repeat(self.ends[k] - counts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) if len(k) else np.zeros(0, dtype=np.int64)
        return self.words[k], np.repeat(np.arange(len(k)), counts), self.grams[first + np.arange(len(first))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows(n: int) -> list[int]:
    """The starts of a text's windows."""
    return list(range(0, max(1, n - SPAN + STEP), STEP))


class Network:
    """``p``: word and gram vectors, and for each direction input, state and bias weights; attention; output."""

    #: Words that a worker's cache holds.
    most = 200_000

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.index: dict[bytes, int] = {}
        self.rows = np.zeros((2, 0, 3 * HIDDEN), dtype=np.float32)

    def __reduce__(self):
        return Network, (self.p,)

    def vectors(self, words: np.ndarray, owner: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Inputs of words: the word's vector, and the mean of its grams' vectors."""
        counts = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        table = self.p["grams"]
        means = np.stack([np.bincount(owner, table[grams, d], len(words)) / counts for d in range(HALF)], axis=1)
        return np.concatenate((self.p["words"][words], means), axis=1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Input shares of the gates, both directions, after a first row, the padding, that leaves states as they are."""
        rows = np.stack([x @ self.p[f"in{d}"] + self.p[f"bias{d}"] for d in (0, 1)])
        pad = np.zeros((2, 1, 3 * HIDDEN))
        pad[:, :, HIDDEN : 2 * HIDDEN] = 40
        return np.concatenate((pad, rows), axis=1).astype(np.float32)

    def forward(self, rows: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows; ``at`` has row numbers, 0 being the padding."""
        n = len(at)
        states = np.zeros((n, SPAN, 2 * HIDDEN), dtype=np.float32)
        tape = []
        for d in (0, 1):
            u = self.p[f"state{d}"].astype(np.float32)
            own, h = rows[d], np.zeros((n, HIDDEN), dtype=np.float32)
            for t in range(SPAN) if d == 0 else range(SPAN - 1, -1, -1):
                x, s = own.take(at[:, t], axis=0), h @ u
                gates = _sigmoid(x[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
                r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if keep:
                    tape.append((d, t, h, r, z, c, s[:, 2 * HIDDEN :]))
                h = new
                states[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h
        seen = np.tanh(states @ self.p["look"].astype(np.float32))
        score = np.where(at == 0, -60, seen @ self.p["ask"].astype(np.float32))
        share = np.exp(score - score.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        pooled = (share[:, None, :] @ states)[:, 0]
        logit = pooled @ self.p["out"] + self.p["base"][0]
        return (logit, states, seen, share, pooled, tape) if keep else logit

    def gradients(self, x: np.ndarray, rows: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Gradients of the weighted log loss: of the weights and of the word inputs x."""
        logit, states, seen, share, pooled, tape = self.forward(rows, at, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("words", "grams")}
        dl = ((_sigmoid(logit) - y) * weight / weight.sum())[:, None]
        g["out"], g["base"] = pooled.T @ dl[:, 0], dl.sum(axis=0)
        dpooled = dl * self.p["out"][None]
        dstates = share[:, :, None] * dpooled[:, None]
        dshare = (states * dpooled[:, None]).sum(axis=2)
        dscore = share * (dshare - (share * dshare).sum(axis=1, keepdims=True))
        g["ask"] = np.tensordot(dscore, seen, axes=([0, 1], [0, 1]))
        dseen = dscore[:, :, None] * self.p["ask"] * (1 - seen * seen)
        g["look"] = np.tensordot(states, dseen, axes=([0, 1], [0, 1]))
        dstates = dstates + dseen @ self.p["look"].T
        drows = np.zeros(rows.shape)
        dh = np.zeros((len(at), HIDDEN))
        for i, (d, t, h, r, z, c, s) in enumerate(reversed(tape)):
            if i == SPAN:
                dh = np.zeros_like(dh)
            dh = dh + dstates[:, t, d * HIDDEN : (d + 1) * HIDDEN]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * s * r * (1 - r)
            da = np.concatenate((dr, dz, dc * r), axis=1)
            g[f"state{d}"] += h.T @ da
            np.add.at(drows[d], at[:, t], np.concatenate((dr, dz, dc), axis=1))
            dh = dh * z + da @ self.p[f"state{d}"].T
        drows = drows[:, 1:]
        dx = np.zeros(x.shape)
        for d in (0, 1):
            g[f"in{d}"] = x.T @ drows[d]
            g[f"bias{d}"] = drows[d].sum(axis=0)
            dx += drows[d] @ self.p[f"in{d}"].T
        return g, dx

    def _at(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of words, by a bounded cache."""
        if len(self.index) > self.most or not self.rows.size:
            self.index, self.rows = {}, self.projected(np.zeros((0, 2 * HALF)))
        fresh = list(set(filterfalse(self.index.__contains__, words)))
        if fresh:
            first = len(self.index) + 1
            new = self.projected(self.vectors(*Parts(fresh).some(np.arange(len(fresh)))))[:, 1:]
            if first + len(fresh) > self.rows.shape[1]:
                more = max(len(fresh), self.rows.shape[1])
                self.rows = np.concatenate((self.rows, np.zeros((2, more, 3 * HIDDEN), dtype=np.float32)), axis=1)
            self.rows[:, first : first + len(fresh)] = new
            self.index.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))

    def forget(self) -> None:
        """End a task: drop the cache of words."""
        self.index, self.rows = {}, self.rows[:, :0].copy()
        trim()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of each text's highest window."""
        split = [words_of(t) for t in texts]
        ids = self._at([w for s in split for w in s])
        starts = [windows(len(s)) for s in split]
        at = np.zeros((sum(map(len, starts)), SPAN), dtype=np.int64)
        k = place = 0
        for s, own in zip(split, starts, strict=True):
            padded = np.zeros(own[-1] + SPAN, dtype=np.int64)
            padded[: len(s)] = ids[place : place + len(s)]
            at[k : k + len(own)] = np.lib.stride_tricks.sliding_window_view(padded, SPAN)[::STEP]
            k, place = k + len(own), place + len(s)
        logits = np.concatenate([self.forward(self.rows, at[i : i + 4096]) for i in range(0, len(at), 4096)])
        best = np.maximum.reduceat(logits, np.concatenate(([0], np.cumsum([len(x) for x in starts])[:-1])))
        return _sigmoid(best.astype(np.float64))


def _odds(split: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log odds of buckets, by documents that have them."""
    seen = np.zeros((2, size))
    for own, label in zip(split, y.astype(int).tolist(), strict=True):
        seen[label, np.unique(own)] += 1
    rate = (seen + 0.5) / (np.array([[(y == 0).sum()], [(y == 1).sum()]]) + 1)
    odds = np.log(rate[1] / rate[0])
    return np.where(seen.sum(axis=0) >= 3, np.clip(odds, -3, 5), 0)


def train(texts: list[str | None], labels: list[int], steps: int = 160, size: int = 64, rate: float = 0.02, seed: int = 3) -> Network:
    """Adam over documents; each gives its highest window (in the first round that of the greatest log odds)."""
    r, y = np.random.default_rng(seed), np.array(labels, dtype=np.float64)
    n = len(y)
    p = {"words": r.normal(0, 0.05, (WORDS, HALF)), "grams": r.normal(0, 0.05, (GRAMS, HALF)), "look": r.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "ask": r.normal(0, 0.3, HIDDEN), "out": r.normal(0, 0.5, 2 * HIDDEN), "base": np.array([np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))])}
    for d in (0, 1):
        p |= {f"in{d}": r.normal(0, 0.5, (2 * HALF, 3 * HIDDEN)), f"state{d}": r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"bias{d}": np.zeros(3 * HIDDEN)}
    net = Network(p)
    if not 0 < y.sum() < n:
        p["out"][:] = 0
        return net
    split = [words_of(t) for t in texts]
    index: dict[bytes, int] = {}
    for s in split:
        for w in s:
            index.setdefault(w, len(index))
    known = Parts(list(index) or [b""])
    ids = [np.array([index[w] for w in s], dtype=np.int64) for s in split]
    p["words"][:, 0] = _odds([known.words[x] for x in ids], y, WORDS)
    p["grams"][:, 0] = _odds([known.some(np.unique(x))[2] for x in ids], y, GRAMS)
    plain = np.concatenate(([0], p["words"][known.words, 0]))
    at = []
    for x in ids:
        padded = np.zeros(windows(len(x))[-1] + SPAN, dtype=np.int64)
        padded[: len(x)] = x + 1
        at.append(np.lib.stride_tricks.sliding_window_view(padded, SPAN)[::STEP])
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    weight = np.where(y == 1, np.sqrt((n - y.sum()) / y.sum()), 1.0)
    groups = max(1, n // size)
    for epoch in range(max(5, -(-steps // groups))):
        for some in np.array_split(r.permutation(n), groups):
            own = np.concatenate([at[i] for i in some])
            ends = np.cumsum([len(at[i]) for i in some])
            used, back = np.unique(np.concatenate(([0], own.ravel())), return_inverse=True)  # 0, the padding, comes first
            back = back[1:].reshape(own.shape)
            words, owner, grams = known.some(used[1:] - 1)
            x = net.vectors(words, owner, grams)
            rows = net.projected(x)
            if epoch:
                value = np.concatenate([net.forward(rows, back[i : i + 4096]) for i in range(0, len(back), 4096)])
            else:
                value = plain[own].max(axis=1)
            pick = np.array([a + int(value[a:b].argmax()) for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)])
            g, dx = net.gradients(x, rows, back[pick], y[some], weight[some])
            step += 1
            for k, d in g.items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            np.add.at(p["words"], words, -dx[:, :HALF])
            share = -dx[:, HALF:] / np.maximum(np.bincount(owner, minlength=len(words)), 1)[:, None]
            for d in range(HALF):
                p["grams"][:, d] += np.bincount(grams, share[owner, d], GRAMS)
    return Network({k: v.astype(np.float32) for k, v in p.items()})


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fitted(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = MOST, most_bytes: int = MOST_BYTES) -> Network:
    """Train on at most ``most`` labelled documents of each class that are not held out; one that no longer fits into ``most_bytes`` is left out."""
    own = picked(labels, doc_id="long", toxic="int").where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out("doc_id")).distinct()
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = own.where("toxic = 1").orderBy(*order).limit(most[0]).unionByName(own.where("toxic = 0").orderBy(*order).limit(most[1]))
    ids, path = staged(some, "training")
    texts = texts_of(docs).join(F.broadcast(ids), "doc_id")  # bounded by ``most``
    used, room = [], most_bytes
    for d, size in sorted(texts.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).collect(), key=lambda x: zlib.crc32(str(x[0]).encode())):
        if size <= room:
            room -= size
            used.append(d)
    kept = docs.sparkSession.createDataFrame([(d,) for d in used], "doc_id long")
    rows = sorted((r.doc_id, r.text or "", r.toxic) for r in texts.join(F.broadcast(kept), "doc_id", "left_semi").collect())  # bounded by ``most``
    remove(docs.sparkSession, path)
    return train([t for _, t, _ in rows], [y for _, _, y in rows]) if rows else train([""], [0])


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scored(docs: DataFrame, model: Network) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    def run(rows: dict[str, list]) -> dict:
        return {"doc_id": rows["doc_id"], "score": model.scores(rows["text"])}

    out = texts_of(docs).mapInArrow(by_batch(run, _SCORED, after=model.forget), "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Network) -> DataFrame:
    """The documents whose score is under the threshold, all columns as they are."""
    own, place = positional(docs), int(column(docs, "text")[1:])
    model.most = 100_000  # a stage among others, whose executors have less room

    def run(batches):
        release()
        for whole in batches:
            for rows in slices(whole, 256, 2 << 20):
                yield rows.filter(pa.array(model.scores(rows.column(place).to_pylist()) < THRESHOLD))
        model.forget()

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)
