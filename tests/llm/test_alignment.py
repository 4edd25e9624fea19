"""Cross-tokenizer alignment against a slow second opinion that encodes every text whole."""

import collections
import hashlib
import random

import pytest

from tidemark.llm import alignment

RND = random.Random(5)
ALPHABET = "ab cd\n\n  éü,.'s12▁\t日本😀\xa0{}\r"
ROWS = [
    (-1, None), (-2, ""), (None, "a b"), (7, "a  b\n\n c\t d▁e"), (8, "x▁"), (9, "\nab 　日本語 é\x00 \r\n<s></s><|endoftext|> "), (10, " "),
    (11, "😀" * 300 + " " + "ab" * 9000 + " z " * 9000), (7, "same id"), (7, "same id"), (12, "a\x1c b\x85c\xa0d"), (13, "…—“quoted”, it's 12345,000.50!!! ###  ++"),
    *((100 + i, "".join(RND.choice(ALPHABET) for _ in range(RND.randint(1, 60)))) for i in range(200)),
    *((400 + i, " ".join(RND.choice(["the", "thesis", "Unübertrefflich,", "don't", "a\nb", "x."]) for _ in range(RND.randint(1, 40)))) for i in range(200)),
]


def _spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(alignment.default_path())
    model.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    docs = []
    for doc_id, text in rows:
        docs.append((doc_id, None))
        if not text:
            continue
        a, b = model.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        bytes_a = [bytes(byte_of[c] for c in model.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if {b"".join(bytes_a), b"".join(bytes_b)} != {(" " + text).encode()}:
            continue
        spans_a, spans_b = _spans(bytes_a), _spans(bytes_b)
        links, low = [], 0
        for i, (start, end) in enumerate(spans_a):
            while spans_b[low][1] <= start:
                low += 1
            k = low
            while k < len(b) and spans_b[k][0] < end:
                links.append((a[i], b[k]))
                k += 1
        groups, i, k = [], 0, 0
        for end in sorted({e for _, e in spans_a} & {e for _, e in spans_b}):
            own_a, own_b = [], []
            while i < len(a) and spans_a[i][1] <= end:
                own_a.append(str(a[i]))
                i += 1
            while k < len(b) and spans_b[k][1] <= end:
                own_b.append(str(b[k]))
                k += 1
            groups.append(",".join(own_a) + "|" + ",".join(own_b))
        docs[-1] = (doc_id, (len(a), len(b), groups, links))
    counts = collections.Counter()
    for _, found in docs:
        counts.update(set(found[3]) if found else ())
    most = collections.defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, found in docs:
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = found
            out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), ";".join(groups)))
    return out, counts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)


def test_documents_and_pairs_as_when_texts_are_encoded_whole(docs):
    found = alignment.Alignment(docs.selectExpr("*", "1", "2", "3").toDF("doc_id", "text", "TEXT", "key", "pair.x"), block_bytes=2000, limit=300)
    want, counts = brute(ROWS)
    assert sorted(map(tuple, found.documents().collect()), key=str) == sorted(want, key=str)
    got = {(r.pair >> alignment.PAIR, r.pair & (1 << alignment.PAIR) - 1): (r.n, r.best) for r in found.pairs().collect()}
    assert {k: n for k, (n, _) in got.items()} == counts
    most = collections.defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    assert all(best == (n == most[a]) for (a, _), (n, best) in got.items())


def test_digest_and_empty_table(spark, docs):
    some = docs.where("doc_id IS NULL OR doc_id = 13 OR doc_id = -1")
    got = {r.doc_id: r.groups for r in alignment.Alignment(some, digest=True).documents().collect()}
    plain = {r[0]: r[7] for r in brute(ROWS)[0]}
    assert got == {d: hashlib.sha256(plain[d].encode()).hexdigest() if plain[d] else "" for d in (None, 13, -1)}
    assert alignment.Alignment(docs.limit(0)).documents().count() == 0
