"""Token ids by the ``tokenizers`` library, with a bounded cache of chunks in each worker.

A byte-level BPE tokenizer with the usual word pattern never merges over the border before a white-space
character that follows another character, so a text may be cut there and each piece encoded alone.
``Encoder`` cuts the texts of a batch at such borders, numbers the distinct chunks, has the library encode
those it does not know yet, and lays the ids out by chunk number.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

#: White space in ASCII as either regular expression engine sees it, and beyond: the first bytes, and the characters.
_SPACE = b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
_NO_SPACE = bytes(c for c in range(256) if c not in _SPACE)
_DOUBLE = (b"  ", b" \n", b"\n ", b"\n\n")
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
WIDE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
BORDER = re.compile(r"(?<=\S)(?=\s)")
#: The word pattern's settings under which the cuts are exact; others are encoded whole.
_PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Letters of ASCII and Latin-1 alone: one word to the pattern.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def _visible() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_VISIBLE = _visible()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """``encode`` gives each text's ids."""

    #: Most chunks that the cache holds; beyond, only its short chunks stay, which are the frequent ones.
    LIMIT = 700_000

    def __init__(self, path: str, limit: int = LIMIT):
        self.limit = limit
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.newline = self._ids("\n")
        self.cuts = spec.get("normalizer") is None and all(pre.get(k) == v for k, v in _PLAIN.items()) and len(self.newline) == 1
        self.words = isinstance(self.model.model, models.BPE) and self.model.model.dropout is None
        self.marks = {ord(x): self._ids(x).tobytes() for x in ",."}
        self.known: dict[bytes, bytes] = {b"": b""}

    @staticmethod
    def at(path: str, limit: int = LIMIT) -> Encoder:
        """The worker's own encoder of this file."""
        return held(("encoder", path, limit), lambda: Encoder(path, limit))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encoded(self, chunks: list[bytes], lead: str) -> dict[bytes, bytes]:
        """The ids of chunks after ``lead``: words of letters go to the model at once, others by many with a newline after each, whose id is in no chunk."""
        out: dict[bytes, bytes] = {}
        if self.words:
            tokenize, front = self.model.model.tokenize, "".join(_VISIBLE[b] for b in lead.encode())
            plain = [c for c in chunks if _LETTERS(c)]
            chunks = [c for c in chunks if not _LETTERS(c)]
            found = [tokenize(front + (c.decode() if c.isascii() else c.decode("latin-1").translate(_VISIBLE))) for c in plain]
            data, at = np.array([x.id for own in found for x in own], dtype="<u4").tobytes(), 0
            for c, own in zip(plain, found, strict=True):
                out[c] = data[at : (at := at + 4 * len(own))]
        stop = int(self.newline[0])
        groups = [chunks[i : i + 500] for i in range(0, len(chunks), 500)]
        texts = ["".join(f"{lead}{c.decode()}\n" for c in g) for g in groups]
        for at in range(0, len(texts), 32):
            for g, e in zip(groups[at : at + 32], self.model.encode_batch_fast(texts[at : at + 32], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                ends = np.flatnonzero(ids == stop).tolist()
                data, start = ids.tobytes(), 0
                for c, end in zip(g, ends, strict=True):
                    out[c] = data[4 * start : 4 * end]
                    start = end + 1
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Encode chunks that are not known: after a newline, or after a blank."""
        lines = [c for c in new if c[:1] == b"\n"]
        first = self._encoded(list({c[1:] for c in lines}), "")
        mark = self.newline.tobytes()
        self.known.update((c, mark + first[c[1:]]) for c in lines)
        rest = [c for c in new if c[:1] != b"\n"]
        # A comma or full stop after a letter is a piece of its own.
        ended = [c for c in rest if c[-1] in b",." and len(c) > 1 and c[-2:-1].isalpha()]
        bare = {c[:-1] for c in ended}
        self.known.update(self._encoded(list((bare | set(rest).difference(ended)).difference(self.known)), " "))
        self.known.update((c, self.known[c[:-1]] + self.marks[c[-1]]) for c in ended)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; views of one array for most."""
        out = [np.zeros(0, dtype="<u4")] * len(texts)
        plain = []
        for i, text in enumerate(texts.to_pylist()):
            if text:
                if not self.cuts:
                    out[i] = self._ids(text)
                elif self._single(text, text.encode()):
                    plain.append(i)
                else:
                    out[i] = np.concatenate([self._ids(x) for x in self._pieces(text)])
        if not plain:
            return out
        if len(self.known) > self.limit:
            self.known = self._bounded(self.known)
        # Each text gets a newline in front, and goes on after its id.
        lines = pc.replace_substring(pc.binary_join_element_wise("", texts.take(pa.array(plain)).cast(pa.string()), "\n"), "\n", " \n")
        chunks = pc.split_pattern(lines, " ")
        numbered = chunks.flatten().dictionary_encode()
        keys = numbered.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        parts = list(map(self.known.get, keys))
        new = [i for i, x in enumerate(parts) if x is None]
        self._learn([keys[i] for i in new])
        for i in new:
            parts[i] = self.known[keys[i]]
        flat = np.frombuffer(b"".join(parts), dtype="<u4")
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        at = numbered.indices.to_numpy()
        own = sizes[at]
        ends = np.cumsum(own)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - own), own) + np.arange(ends[-1])]
        stops = ends[chunks.offsets.to_numpy()[1:] - chunks.offsets[0].as_py() - 1].tolist()
        for i, a, b in zip(plain, [0, *stops], stops):
            out[i] = ids[a + 1 : b]
        return out

    def _bounded(self, cache: dict[bytes, bytes]) -> dict[bytes, bytes]:
        size = 8
        while len(cache) > self.limit // 2 and size:
            cache, size = {k: v for k, v in cache.items() if len(k) <= size}, size - 2
        return cache

    @staticmethod
    def _single(text: str, data: bytes) -> bool:
        """Whether all white space is single blanks and newlines between words."""
        blanks = data.translate(None, _NO_SPACE)
        if blanks.count(b" ") + blanks.count(b"\n") < len(blanks) or data[0] in b" \n" or data[-1] in b" \n" or any(x in data for x in _DOUBLE):
            return False
        return len(data) == len(text) or not any(x in data for x in _WIDE) or not WIDE.search(text)

    @staticmethod
    def _pieces(text: str, size: int = 20_000) -> list[str]:
        """A text with other white space, in pieces of about ``size`` characters cut at borders."""
        if len(text) <= size:
            return [text]
        pieces, start = [], 0
        while len(text) - start > size and (m := BORDER.search(text, start + size)):
            pieces.append(text[start : m.start()])
            start = m.start()
        return [*pieces, text[start:]]
