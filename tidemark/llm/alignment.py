"""Cross-tokenizer alignment: the ids of two tokenizers over one text, tied by the bytes that they cover.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (sentence pieces with byte fallback) the text, to which it adds the
space itself.  Byte offsets at which tokens of both end cut the two sequences into groups, and within a group every A token
is linked with each B token whose bytes it shares.

Group dictionary: a task interns the distinct groups of its texts, block by block, and writes for each document only group numbers and
frequencies.  Distinct groups of all blocks are expanded into links once; the documents that hold an id pair are counted by block, where
a document is whole, and summed; each group gets its sums over its links, and these are joined back by group key, block by
block.  What is shuffled is the dictionaries, never a row for each token.

Both tokenizers never merge over the border before a blank or newline that follows another character, which is checked of their
vocabularies, so texts are cut there and a distinct chunk is encoded once for each task and cache.

Edge cases: null and empty texts, and texts whose joined A or B bytes are not the text (such as those with U+2581), have no tokens: zeros and
an empty string in place of a hash; documents without doc_id and repeated ones have a row each; an empty table gives an empty
result; extra columns are ignored.  A text is whole in one task, as are the at most ``BLOCK_BYTES`` (or one text) of a block.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, release, slices, staged, texts_of, trim
from .tokens import _VISIBLE, Encoder, default_path

#: Bytes of text whose groups share one dictionary.
BLOCK_BYTES = 16 << 20
#: Chunks, and groups, beyond which a worker's cache starts anew with the next block.
LIMIT = 400_000
#: An id pair as one number: a << PAIR | b.
PAIR = 24
_CUT = re.compile(r"(?<=\S)(?= )")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Tokens:
    """Both tokenizers: ids of chunks, and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encoder = Encoder(path_a)
        bytes_of = {c: b for b, c in _VISIBLE.items()}
        model = self.encoder.model
        self.bytes_a = [bytes(bytes_of.get(c, 63) for c in model.id_to_token(i) or "") for i in range(model.get_vocab_size(with_added_tokens=True))]
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.len_a, self.len_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (self.bytes_a, self.bytes_b))
        blank = names.index("▁") if "▁" in names else -1
        # Cuts are exact where no piece reaches over them, and a newline stands alone after the added blank.
        apart = not any(re.search("[^▁]▁", p) for p in names)
        self.blanks = self.encoder.cuts and apart
        self.cuts = self.blanks and not any("\n" in p for p in names) and self.pieces.encode("\nx")[:1] == [blank]

    def of_chunks(self, chunks: list[bytes]) -> tuple[list[np.ndarray], list[list[int]]]:
        """The ids of chunks, which stand after a blank or begin with a newline."""
        self.encoder._learn(chunks)
        a = [np.frombuffer(self.encoder.known[c], dtype="<u4") for c in chunks]
        self.encoder.known = {b"": b""}
        b = self.pieces.encode([c.decode() for c in chunks], num_threads=1)
        return a, [x[1:] if c[:1] == b"\n" else x for c, x in zip(chunks, b, strict=True)]

    def of_pieces(self, text: str) -> tuple[list[bytes], list[np.ndarray], list[list[int]]]:
        """A blank and a text, in parts of at least 20,000 characters where they may be cut, and the ids of each."""
        whole, parts, start = " " + text, [], 0
        while self.blanks and len(whole) - start > 20_000 and (m := _CUT.search(whole, start + 20_000)):
            parts.append(whole[start : m.start()])
            start = m.start()
        parts.append(whole[start:])
        return [p.encode() for p in parts], [self.encoder._ids(p) for p in parts], self.pieces.encode([p[1:] for p in parts], num_threads=1)


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where both end, and the places in A and B of every linked pair: the parts between neighbouring ends of either."""
    either = np.union1d(ends_a, ends_b)
    return np.intersect1d(ends_a, ends_b, assume_unique=True), np.searchsorted(ends_a, either), np.searchsorted(ends_b, either)


class Dictionary:
    """A worker's interned chunks, groups and id pairs, by number."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.chunks: dict[bytes, int] = {}
        self.texts: list[str | None] = []  # of a chunk: its groups as text; None if its bytes are not the tokens' bytes
        self.n_a, self.n_b, self.first, self.groups_of = array("q"), array("q"), array("q", [0]), array("i")
        self.groups: dict[int | str, int] = {}  # by ``_codes``, or by their text
        self.names: list[str] = []
        self.pairs_first, self.pairs_of = array("q", [0]), array("i")
        self.pairs: dict[int, int] = {}

    def full(self, limit: int) -> bool:
        return len(self.texts) > limit or len(self.names) > limit or len(self.groups_of) > 8 * limit

    def learn(self, own: list[bytes], a: list[np.ndarray], b: list[list[int]]) -> list[int]:
        """Numbers of new chunks, given their bytes and ids."""
        t = self.tokens
        fine = [b"".join(map(t.bytes_b.__getitem__, y)) == c and b"".join(map(t.bytes_a.__getitem__, x.tolist())) == c for c, x, y in zip(own, a, b, strict=True)]
        numbers = list(range(len(self.texts), len(self.texts) + len(own)))
        good = [i for i, f in enumerate(fine) if f]
        ids_a = np.concatenate([a[i] for i in good]).astype(np.int64) if good else np.zeros(0, dtype=np.int64)
        ids_b = np.fromiter((x for i in good for x in b[i]), dtype=np.int64)
        ends_a, ends_b = np.cumsum(t.len_a[ids_a]), np.cumsum(t.len_b[ids_b])
        both, link_a, link_b = links_of(ends_a, ends_b)
        stop_a, stop_b = (np.searchsorted(e, both) + 1 for e in (ends_a, ends_b))
        stop_link = stop_a + stop_b - np.arange(1, len(both) + 1)  # a group of n and m tokens has n + m - 1 links
        pairs = (ids_a[link_a] << PAIR | ids_b[link_b]).tolist()
        last_group = np.searchsorted(both, np.cumsum([len(own[i]) for i in good])) + 1 if good else np.zeros(0, dtype=np.int64)
        codes = self._codes(ids_a, ids_b, stop_a, stop_b)
        numbers_of = list(map(self.groups.get, codes))
        for i in [i for i, x in enumerate(numbers_of) if x is None]:
            at_a, at_b, at_link = (int(x[i - 1]) if i else 0 for x in (stop_a, stop_b, stop_link))
            name = f"{','.join(map(str, ids_a[at_a : stop_a[i]].tolist()))}|{','.join(map(str, ids_b[at_b : stop_b[i]].tolist()))}"
            key = name if codes[i] < 0 else codes[i]
            number = self.groups.get(key)
            if number is None:
                number = self.groups[key] = len(self.names)
                self.names.append(name)
                self.pairs_of.extend({self.pairs.setdefault(c, len(self.pairs)) for c in pairs[at_link : stop_link[i]]})
                self.pairs_first.append(len(self.pairs_of))
            numbers_of[i] = number
        ends, start = iter(last_group.tolist()), 0
        for i, f in enumerate(fine):
            self.n_a.append(len(a[i]) if f else 0)
            self.n_b.append(len(b[i]) if f else 0)
            if f:
                end = next(ends)
                self.groups_of.extend(numbers_of[start:end])
                self.texts.append(";".join([self.names[x] for x in numbers_of[start:end]]))
                start = end
            else:
                self.texts.append(None)
            self.first.append(len(self.groups_of))
        return numbers

    @staticmethod
    def _codes(ids_a: np.ndarray, ids_b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> list[int]:
        """Groups of at most three tokens as one number each (-1 for others): 20 bits for an id, and which side has two."""
        n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        codes = np.full(len(stop_a), -1, dtype=np.int64)
        if len(codes) and max(ids_a.max(), ids_b.max()) < 1 << 20:
            for shape, (a, b) in enumerate(((1, 1), (1, 2), (2, 1))):
                at = np.flatnonzero((n_a == a) & (n_b == b))
                ids = [ids_a[stop_a[at] - k] for k in range(a, 0, -1)] + [ids_b[stop_b[at] - k] for k in range(b, 0, -1)]
                code = np.full(len(at), shape, dtype=np.int64)
                for x in ids:
                    code = code << 20 | x
                codes[at] = code
        return codes.tolist()

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
        """Chunk numbers of all texts in turn, the text that each belongs to, and each text's groups as text."""
        joined: list[str | None] = [None] * len(texts)
        plain, seq, owner = [], [], []
        for i, text in enumerate(texts.to_pylist()):
            if not text:
                continue
            if self.tokens.cuts and Encoder._single(text, text.encode()):
                plain.append(i)
                continue
            numbers = self.learn(*self.tokens.of_pieces(text))
            parts = [self.texts[n] for n in numbers]
            if None not in parts:
                joined[i] = ";".join(parts)
            seq.append(np.array(numbers, dtype=np.int64))
            owner.append(np.full(len(numbers), i, dtype=np.int64))
        if plain:
            chunks = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)).cast(pa.string()), "\n", " \n"), " ")
            numbered = chunks.flatten().dictionary_encode()
            keys = numbered.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
            numbers = list(map(self.chunks.get, keys))
            new = [i for i, x in enumerate(numbers) if x is None]
            for k in range(0, len(new), 20_000):
                own = [keys[i] for i in new[k : k + 20_000]]
                for i, n in zip(new[k : k + 20_000], self.learn([c if c[:1] == b"\n" else b" " + c for c in own], *self.tokens.of_chunks(own)), strict=True):
                    numbers[i] = self.chunks[keys[i]] = n
            at = numbered.indices.to_numpy()
            offsets = chunks.offsets.to_numpy()
            offsets = offsets - offsets[0]
            seq.append(np.array(numbers, dtype=np.int64)[at])
            owner.append(np.repeat(np.array(plain, dtype=np.int64), np.diff(offsets)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array([self.texts[n] for n in numbers], type=pa.string()).take(numbered.indices))
            for i, whole in zip(plain, pc.binary_join(lists, ";").to_pylist(), strict=True):  # null if one part is
                joined[i] = whole
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate(seq) if seq else none, np.concatenate(owner) if owner else none, joined


def _spread(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a flat array of all entries of some lists, and for each entry the place of its list in ``which``."""
    sizes = first[which + 1] - first[which]
    ends = np.cumsum(sizes)
    return np.repeat(first[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0), np.repeat(np.arange(len(which)), sizes)


_ROWS = pa.schema([("block", pa.int64()), ("payload", pa.binary()), ("number", pa.int32()), ("key", pa.string()), ("pair", pa.int64()), ("n", pa.int64())])
_SPARK_ROWS = "block long, payload binary, number int, key string, pair long, n long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("number", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])


def _rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in _ROWS], schema=_ROWS)


def _documents(known: Dictionary, rows: pa.RecordBatch, digest: bool, counts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Documents with their groups (numbers as differences) and frequencies; the groups in use; documents by id pair, added up."""
    n = rows.num_rows
    seq, owner, joined = known.of_texts(rows.column(1))
    kept = np.array([x is not None for x in joined], dtype=bool)
    seq, owner = seq[kept[owner]], owner[kept[owner]]
    sums = lambda values: np.bincount(owner, weights=values, minlength=n).astype(np.int64)
    first, groups = np.frombuffer(known.first, dtype=np.int64), np.frombuffer(known.groups_of, dtype=np.int32)
    n_a, n_b, n_groups = sums(np.frombuffer(known.n_a, dtype=np.int64)[seq]), sums(np.frombuffer(known.n_b, dtype=np.int64)[seq]), sums(np.diff(first)[seq])
    places, at = _spread(first, seq)
    width = max(1, len(known.names))
    own, times = np.unique(owner[at] * width + groups[places], return_counts=True)
    doc, number = own // width, own % width
    places, at = _spread(np.frombuffer(known.pairs_first, dtype=np.int64), number)
    wide = max(1, len(known.pairs))
    held_by = np.unique(doc[at] * wide + np.frombuffer(known.pairs_of, dtype=np.int32)[places]) % wide
    if len(counts) < wide:
        counts = np.concatenate((counts, np.zeros(wide - len(counts), dtype=np.int64)))
    counts[:wide] += np.bincount(held_by, minlength=wide)
    starts = np.searchsorted(doc, np.arange(n + 1))
    step = np.diff(number, prepend=0)
    step[starts[:-1][starts[:-1] < len(number)]] = number[starts[:-1][starts[:-1] < len(number)]]
    lists = lambda x: pa.ListArray.from_arrays(pa.array(starts, type=pa.int32()), pa.array(x, type=pa.int32()))
    text = [(hashlib.sha256(x.encode()).hexdigest() if digest else x) if x is not None else "" for x in joined]
    docs = pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(text, type=pa.string()), lists(step), lists(times)], schema=_DOCS)
    return docs, number, counts


def _packed(docs: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(docs)
    return sink.getvalue().to_pybytes()


def _blocks(path_a: str, path_b: str, digest: bool, block_bytes: int, limit: int):
    """For ``mapInArrow``: documents by block, and each block's dictionary and its documents by id pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        tokens = held(("alignment", path_a, path_b), lambda: Tokens(path_a, path_b))
        block, known = TaskContext.get().partitionId() << 32, Dictionary(tokens)
        used, counts, size = [], np.zeros(0, dtype=np.int64), 0

        def ended() -> Iterator[pa.RecordBatch]:
            mine = np.unique(np.concatenate(used)) if used else np.zeros(0, dtype=np.int64)
            names = known.names
            for i in range(0, len(mine), 50_000):
                part = mine[i : i + 50_000]
                yield _rows(len(part), block=pa.array(np.full(len(part), block)), number=pa.array(part, type=pa.int32()), key=pa.array([names[x] for x in part.tolist()], type=pa.string()))
            pairs, codes = np.flatnonzero(counts), np.fromiter(known.pairs, dtype=np.int64, count=len(known.pairs))
            for i in range(0, len(pairs), 50_000):
                part = pairs[i : i + 50_000]
                yield _rows(len(part), pair=pa.array(codes[part]), n=pa.array(counts[part]))

        for whole in batches:
            for rows in slices(whole, 2048):
                docs, number, counts = _documents(known, rows, digest, counts)
                yield _rows(1, block=pa.array([block]), payload=pa.array([_packed(docs)], type=pa.binary()))
                used.append(np.unique(number))
                size += pc.sum(pc.fill_null(pc.binary_length(rows.column(1)), 0)).as_py()
                if size >= block_bytes:
                    yield from ended()
                    block, used, counts, size = block + 1, [], np.zeros(0, dtype=np.int64), 0
                    if known.full(limit):
                        known = Dictionary(tokens)
        yield from ended()
        trim()

    return run


def _expander(path_a: str, path_b: str):
    """For ``mapInArrow``: every link of a group, as (key, pair)."""
    schema = pa.schema([("key", pa.string()), ("pair", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        tokens = held(("alignment", path_a, path_b), lambda: Tokens(path_a, path_b))
        for batch in batches:
            keys = batch.column(0).to_pylist()
            sides = [k.split("|") for k in keys]
            (ids_a, n_a), (ids_b, n_b) = ((np.array(",".join(s[i] for s in sides).split(","), dtype=np.int64), np.array([s[i].count(",") + 1 for s in sides])) for i in (0, 1))
            _, link_a, link_b = links_of(np.cumsum(tokens.len_a[ids_a]), np.cumsum(tokens.len_b[ids_b]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), n_a + n_b - 1))), pa.array(ids_a[link_a] << PAIR | ids_b[link_b])], schema=schema)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())])
_SPARK_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _finished(payloads: pa.Table, numbers: pa.Table) -> pa.Table:
    """The documents of one block, with the sums over their groups' links."""
    place = np.zeros(1, dtype=np.int64)
    number = numbers["number"].to_numpy()
    if len(number):
        place = np.zeros(int(number.max()) + 1, dtype=np.int64)
        place[number] = np.arange(len(number))
    best, total = numbers["best"].to_numpy(), numbers["total"].to_numpy()
    out = []
    for payload in payloads["payload"]:
        docs = pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks().to_batches()[0]
        starts = docs["number"].offsets.to_numpy()
        step, times = docs["number"].values.to_numpy().astype(np.int64), docs["times"].values.to_numpy()
        before = np.cumsum(step) - step
        which = np.cumsum(step) - np.repeat(before[np.minimum(starts[:-1], len(step) - 1)] if len(step) else np.zeros(len(starts) - 1, dtype=np.int64), np.diff(starts))
        sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(times * x[place[which]])))[starts]) if len(which) else np.zeros(docs.num_rows, dtype=np.int64)  # noqa: B023, E731
        links = pc.subtract(pc.add(docs["n_a"], docs["n_b"]), docs["n_groups"])
        out.append(pa.RecordBatch.from_arrays([docs["doc_id"], docs["n_a"], docs["n_b"], docs["n_groups"], links, pa.array(sums(best)), pa.array(sums(total)), docs["groups"]], schema=_OUT))
    return pa.Table.from_batches(out, schema=_OUT)


class Alignment:
    """The two encodings of a table of documents: ``documents``, ``pairs`` and ``groups``.

    ``digest`` keeps the SHA-256 of a document's groups in place of their text.
    """

    def __init__(self, docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = False, block_bytes: int = BLOCK_BYTES, limit: int = LIMIT):
        self.paths = path_a or default_path(), path_b or default_pieces()
        self.rows = staged(texts_of(docs).mapInArrow(_blocks(*self.paths, digest, block_bytes, limit), _SPARK_ROWS), "alignment")[0]

    def pairs(self) -> DataFrame:
        """(pair, n, best): the documents that hold an id pair linked, and whether its A id has no pair with more; ``pair`` is a << PAIR | b."""
        counts = self.rows.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", PAIR))
        most = counts.groupBy("a").agg(F.max("n").alias("most"))
        return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))

    def groups(self) -> DataFrame:
        """(key, best, total) of each distinct group: its links that are best, and the sum of their counts."""
        keys = self.rows.where("key IS NOT NULL").select("key").distinct()
        links = keys.mapInArrow(_expander(*self.paths), "key string, pair long")
        return links.join(self.pairs(), "pair").groupBy("key").agg(F.sum(F.col("best").cast("long")).alias("best"), F.sum("n").alias("total"))

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each document."""
        own = self.rows.where("key IS NOT NULL").select("block", "number", "key").join(self.groups(), "key").select("block", "number", "best", "total")
        whole = self.rows.where("payload IS NOT NULL").select(F.col("block").alias("of"), "payload")
        return whole.groupBy("of").cogroup(own.groupBy("block")).applyInArrow(_finished, _SPARK_OUT)
