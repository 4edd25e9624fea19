"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field tags each word with O or a kind.  Its features are shapes, digit counts, marks and a few cue
words of the word and its two neighbours; it is trained in numpy by exact gradients (forward and backward
sums) on a small labelled table that ``labelled`` makes from fixed patterns and a fixed seed.  Decoding is
Viterbi in numpy batches.  A word whose O score leads each other tag's by more than that tag can
gain by transitions is O on every best path, so texts are cut at such words and only the rest is searched: the result
is that of the whole text.

Spans of the patterns always stay; spans of the field are added where they touch none of those.

Edge cases: a null or empty text has no spans; texts of any length are read whole, in time that grows with their
length alone; repeated rows each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, column, positional, release, slices, texts_of, trim

KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = ("O", *KINDS)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# An e-mail's first run is read from its start, or from where the e-mail before it ended: one that starts within would fail or succeed as the whole does.
EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL_HERE.pattern)
# No match ends within a run of digits, so every match starts at the start of one.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while m := (EMAIL_HERE.match(text, at) if out else None) or EMAIL.search(text, at):
        out.append(m.span())
        at = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans, by kind and start."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return out


# The features of a word.

CUES = ("at", "dot", "tel", "phone", "call", "fax", "mail", "email", "password", "passwd", "token", "key", "secret", "apikey", "ip", "card", "com", "org", "net")
_SHAPE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", b"A" * 26 + b"a" * 26 + b"0" * 10)


def features(word: bytes) -> tuple[str, ...]:
    """Names of what holds for a word; words that share all of it are one to the field."""
    core = word.strip(b".,;:!?\"'")
    flat = core.translate(_SHAPE)
    shape = re.sub(rb"(.)\1+", rb"\1+", flat)
    digits, length = flat.count(b"0"), len(core)
    out = ["any", f"digits{min(digits, 8)}"]
    if digits == 0 and flat.isalpha():
        out.append("letters")
    elif len(shape) <= 12:
        out.append(f"shape {shape.decode('latin-1')}")
    if digits and b"a" in flat:
        out.append("mixed")
        if length >= 16:
            out.append("longmixed")
        if b"A" in flat and length >= 16:
            out.append("longmixedcase")
    for mark in b"@()[]_-/=$*":
        if mark in core and mark not in core[:0]:
            out.append(f"has{mark}")
    low = core.lower().strip(b"()[]{}=").decode("latin-1")
    if low in CUES:
        out.append(f"cue {low}")
    return tuple(out)


# The small labelled table.


def labelled(n: int = 700, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Sentences with a tag per word: plain, noisy and numeric words, and personal data written around the patterns."""
    r = random.Random(seed)
    parts = "an re sti ou ing the er on zu ver ch lich eau qu tion ción mente ll ado é ñ ü".split()
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    rand = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k - 2)) + "a7"

    def plain() -> str:
        w, kind = word(), r.random()
        if kind < 0.5:
            return w
        if kind < 0.6:
            return w + r.choice([",", ".", ":", "!", "?"])
        if kind < 0.7:
            return w.capitalize()
        if kind < 0.75:
            return w.upper() + r.choice(["", "!!", ",!!"])
        if kind < 0.8:
            return w + r.choice(["***", "$$$", "&&&", "###", "%%%"])
        if kind < 0.93:
            return r.choice([num(r.randint(1, 6)), f"{num(1)}.{num(2)}", f"{num(1)},{num(3)}", f"20{num(2)}-0{num(1)}-1{num(1)}", f"{num(2)}:{num(2)}", f"({num(2)})", f"[{num(1)}]", f"v{num(1)}.{num(1)}.{num(1)}", f"{num(3)}-{num(3)}", f"{w}{num(2)}", f"https://{w}.example.org/{num(3)}", f"{w}-{w}", f"{w}_{w}", f"{w}/{w}", "|", num(r.randint(12, 19))])
        return r.choice(["at", "dot", "call", "key", "card", "token", "(c)", "(see", "and/or", "A/B", "mail", "=", "--"])

    def private() -> list[tuple[str, str]]:
        kind = r.choice(["phone", "phone", "mail", "mail", "secret", "secret"])
        if kind == "phone":
            spoken = r.choice([[f"({num(3)})", f"{num(3)}-{num(4)}"], [f"{num(3)}-{num(3)}-{num(4)}"], [f"({num(3)}){num(3)}-{num(4)}"]])
            spoken = r.choice([[], [f"+{num(r.randint(1, 2))}"]]) + spoken
            return [(x, "O") for x in r.choice([[], ["tel"], ["phone:"], ["call"]])] + [(x, "phone") for x in spoken] + [(x, "O") for x in r.choice([[], [num(r.randint(12, 19))]])]
        if kind == "mail":
            spoken = r.choice([[f"{name()}", "(at)", f"{name()}", "(dot)", "com"], [f"{name()}[at]{name()}.com"], [f"{name()}(at){name()}.org"], [f"{name()}.{num(2)}@{name()}"], [f"{name()}", "[at]", f"{name()}.net"]])
            return [(x, "email") for x in spoken]
        made = r.choice([f"AKIA{rand(16)}", f"sk-{rand(24)}", f"ghp_{rand(30)}", f"key-{rand(28)}", f"sk_live_{rand(24)}", f"eyJ{rand(30)}", rand(40).lower(), f'"{rand(40).lower()}"'])
        return [(x, "O") for x in r.choice([[], ["token"], ["key:"], ["secret"], ["apikey", "="], ["token", "="]])] + [(made, "secret")]

    out = []
    for i in range(n):
        row = [(plain(), "O") for _ in range(r.randint(2, 9))]
        if i % 20 == 0:  # one word again and again
            row = [(r.choice([plain(), "at", "dot", "token", "call"]), "O")] * r.randint(4, 10)
        elif i % 2:
            row += private() + [(plain(), "O") for _ in range(r.randint(0, 5))]
        out.append(([w for w, _ in row], [t for _, t in row]))
    return out


class Field:
    """Weights of the field: [place, feature, tag] for the word, the one before and the one after, and transitions."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps
        # What a tag gains at most by its two transitions in place of O: an O that leads by more is on every best path.
        self.sure = (steps - steps[:, :1]).max(axis=0)[1:] + (steps - steps[:1]).max(axis=1)[1:]
        self.keys: dict[tuple[str, ...], int] = {}
        self.words: dict[bytes, int] = {}
        self.table = np.zeros((3, 64, len(TAGS)), dtype=np.float32)
        self._key(())  # what stands beyond the ends

    def __reduce__(self):
        return Field, (self.names, self.weights, self.steps)

    def _key(self, found: tuple[str, ...]) -> int:
        k = self.keys.get(found)
        if k is None:
            k = self.keys[found] = len(self.keys)
            if k >= self.table.shape[1]:
                self.table = np.concatenate((self.table, np.zeros_like(self.table)), axis=1)
            own = [self.names[x] for x in found if x in self.names]
            self.table[:, k] = self.weights[:, own].sum(axis=1)
        return k

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The words' feature keys, by a bounded cache."""
        known = self.words
        if len(known) > 300_000:
            known = self.words = {k: v for k, v in known.items() if len(k) <= 7}
            if len(known) > 150_000:
                known = self.words = {}
        fresh = set(words).difference(known)
        known.update((w, self._key(features(w))) for w in fresh)
        out = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        for w in fresh:
            if len(w) > 64:
                del known[w]
        return out

    def forget(self) -> None:
        """End a task: drop the cache of words."""
        self.words = {}
        trim()

    def scores(self, ids: np.ndarray) -> np.ndarray:
        out = self.table[0, ids]
        out[1:] += self.table[1, ids[:-1]]
        out[:-1] += self.table[2, ids[1:]]
        return out

    def tags(self, texts: list[list[bytes]]) -> list[np.ndarray | None]:
        """The best tags of each text's words; None where all are O."""
        out: list[np.ndarray | None] = []
        runs: list[tuple[int, int, np.ndarray]] = []
        for i, words in enumerate(texts):
            out.append(None)
            if not words:
                continue
            e = self.scores(self.ids(words))
            open_ = (e[:, :1] - e[:, 1:] <= self.sure).any(axis=1)
            if open_.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([False], open_, [False]))))
                runs += [(i, a, e[a:b]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        runs.sort(key=lambda x: len(x[2]))
        for at in range(0, len(runs), 512):
            part = runs[at : at + 512]
            for (i, a, e), best in zip(part, self._viterbi([x[2] for x in part]), strict=True):
                if best.any():
                    if out[i] is None:
                        out[i] = np.zeros(len(texts[i]), dtype=np.int8)
                    out[i][a : a + len(e)] = best
        return out

    def _viterbi(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best paths of runs that O stands before and after."""
        n, sizes = len(runs), np.array([len(x) for x in runs])
        e = np.zeros((n, sizes.max(), len(TAGS)), dtype=np.float32)
        for x, r in zip(e, runs, strict=True):
            x[: len(r)] = r
        back = np.zeros(e.shape, dtype=np.int8)
        best = e[:, 0] + self.steps[0]
        for t in range(1, e.shape[1]):
            step = best[:, :, None] + self.steps
            back[:, t] = step.argmax(axis=1)
            now = step.max(axis=1) + e[:, t]
            best = np.where((t < sizes)[:, None], now, best)
        path = np.zeros(e.shape[:2], dtype=np.int8)
        tag = (best + self.steps[:, 0]).argmax(axis=1)
        rows = np.arange(n)
        for t in range(e.shape[1] - 1, -1, -1):
            live = t < sizes
            path[live, t] = tag[live]
            tag = np.where(live & (t > 0), back[rows, t, tag], tag)
        return [p[:k] for p, k in zip(path, sizes.tolist(), strict=True)]


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 120, rate: float = 0.15, shrink: float = 2e-4) -> Field:
    """Maximum likelihood with Adam; the table is small, so every round takes it whole."""
    found = [[features(w.encode()) for w in words] for words, _ in rows]
    names = {x: i for i, x in enumerate(sorted({x for s in found for w in s for x in w}))}
    keys: dict[tuple[str, ...], int] = {(): 0}  # the first stands for what is beyond the ends
    n, longest, k = len(rows), max(len(w) for w, _ in rows), len(TAGS)
    x = np.zeros((n, longest + 2), dtype=np.int64)
    y, live = np.zeros((n, longest), dtype=np.int64), np.zeros((n, longest), dtype=bool)
    for i, (s, (_, tags)) in enumerate(zip(found, rows, strict=True)):
        for t, (w, tag) in enumerate(zip(s, tags, strict=True)):
            x[i, t + 1] = keys.setdefault(w, len(keys))
            y[i, t], live[i, t] = TAGS.index(tag), True
    has = np.zeros((len(keys), len(names)))
    for w, i in keys.items():
        has[i, [names[f] for f in w]] = 1
    gold = np.eye(k)[y] * live[:, :, None]
    places = (x[:, 1:-1], x[:, :-2], x[:, 2:])
    p = {"w": np.zeros((3, len(names), k)), "s": np.zeros((k, k))}
    first, second = ({a: np.zeros_like(b) for a, b in p.items()} for _ in range(2))
    last = live.sum(axis=1) - 1
    ends = np.zeros((n, longest), dtype=bool)
    ends[np.arange(n), last] = True

    def by_key(at: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(at.ravel(), d[:, :, j].ravel(), len(keys)) for j in range(k)], axis=1)

    for step in range(1, rounds + 1):
        e = sum((has @ w)[a] for a, w in zip(places, p["w"], strict=True))
        s = p["s"]
        fore, aft = np.zeros_like(e), np.zeros_like(e)
        fore[:, 0] = e[:, 0] + s[0]
        for t in range(1, longest):
            fore[:, t] = np.where(live[:, t, None], _sum(fore[:, t - 1, :, None] + s, 1) + e[:, t], fore[:, t - 1])
        for t in range(longest - 1, -1, -1):
            aft[:, t] = s[:, 0] if t == longest - 1 else np.where(ends[:, t, None], s[:, 0], _sum(s + (e[:, t + 1] + aft[:, t + 1])[:, None, :], 2))
        total = _sum(fore[np.arange(n), last] + s[:, 0], 1)
        node = np.exp(np.minimum(fore + aft - total[:, None, None], 0)) * live[:, :, None]
        g = {"w": np.stack([has.T @ by_key(a, node - gold) for a in places]), "s": np.zeros((k, k))}
        pair = live[:, 1:]
        both = np.exp(np.minimum(fore[:, :-1, :, None] + s + (e[:, 1:] + aft[:, 1:])[:, :, None, :] - total[:, None, None, None], 0)) * pair[:, :, None, None]
        g["s"] += both.sum(axis=(0, 1)) - np.tensordot(gold[:, :-1] * pair[:, :, None], gold[:, 1:] * pair[:, :, None], axes=([0, 1], [0, 1]))
        g["s"][0] += (node[:, 0] - gold[:, 0]).sum(axis=0)
        g["s"][:, 0] += (node[np.arange(n), last] - gold[np.arange(n), last]).sum(axis=0)
        for a in p:
            d = g[a] / n + (shrink if a == "w" else 50 * shrink) * p[a]
            first[a] = 0.9 * first[a] + 0.1 * d
            second[a] = 0.99 * second[a] + 0.01 * d * d
            p[a] -= rate * (first[a] / (1 - 0.9**step)) / (np.sqrt(second[a] / (1 - 0.99**step)) + 1e-8)
    return Field(names, p["w"].astype(np.float32), p["s"].astype(np.float32))


@lru_cache(maxsize=1)
def field() -> Field:
    """The field of the built-in table."""
    return train(labelled())


def field_spans(text: str, tags: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of one kind as spans without outer punctuation, cut at the words that touch a base span, which they leave out."""
    out: list[list] = []
    near = sorted((s, e) for _, s, e in base)
    starts, stops = [s for s, _ in near], list(accumulate((e for _, e in near), max))
    before = 0
    for m, tag in zip(WORD.finditer(text), tags.tolist(), strict=True):
        if tag:
            word = m.group()
            a = m.start() + len(word) - len(word.lstrip("\"'<"))
            b = m.end() - (len(word) - len(word.rstrip(".,;:!?\"'>")))
            k = bisect_left(starts, b)
            if a < b and not (k and stops[k - 1] > a):
                if tag == before:
                    out[-1][2] = b
                else:
                    out.append([TAGS[tag], a, b])
                before = tag
                continue
        before = 0
    return [tuple(x) for x in out]


def spans_of(texts: list[str | None], model: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    out = []
    for text, tags in zip(texts, model.tags([(x or "").encode().split() for x in texts]), strict=True):
        base = base_spans(text) if text else []
        every = base if tags is None else sorted(base + field_spans(text, tags, base), key=lambda x: (KINDS.index(x[0]), x[1]))
        out.append((base, every))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or each chain of overlapping ones, replaced by its first kind."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_secret", pa.int64()), ("n_spans", pa.int64())])


def found(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts and digest of the base spans, all spans in words, and how many of them are secrets and how many there are."""
    model = field()

    def run(rows: dict[str, list]) -> dict[str, list]:
        got = spans_of(rows["text"], model)
        return {"doc_id": rows["doc_id"], "base_sha256": [hashlib.sha256(written(b).encode()).hexdigest() for b, _ in got], "spans": [written(x) for _, x in got]} | {f"n_{k}": [sum(x[0] == k for x in b) for b, _ in got] for k in KINDS[:4]} | {"n_secret": [sum(x[0] == "secret" for x in every) for _, every in got], "n_spans": [len(every) for _, every in got]}

    return texts_of(docs).mapInArrow(by_batch(run, _FOUND, after=model.forget), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with all spans of ``text`` masked; other columns are as they were.  Null stays null."""
    model = field()
    own, place = positional(docs), int(column(docs, text)[1:])

    def run(batches):
        release()
        for whole in batches:
            for rows in slices(whole, 256):
                texts = rows.column(place).to_pylist()
                new = [t and masked(t, s) for t, (_, s) in zip(texts, spans_of(texts, model), strict=True)]
                yield rows.set_column(place, rows.schema.field(place), pa.array(new, type=rows.schema.field(place).type))
        model.forget()

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)
