"""Hard rows for every operator: repeated ids with other texts, no ids, clashing names, very long texts; and slow second opinions."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from tidemark.llm import common, decontam, minhash, packing, pii, quality, substring, toxicity, url_filter, wavelet
from tidemark.llm.tokens import Encoder, default_path

PASSAGE = " ".join(f"p{i}" for i in range(90))
TWICE = [(1, PASSAGE + " one"), (2, "short"), (2, "x y " + PASSAGE + " z"), (2, "other words here " * 200), (2, "x y " + PASSAGE + " z"), (None, PASSAGE), (3, None)]


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns whose names differ from the operators' own in case alone, or hold dots."""
    df = spark.createDataFrame([(d, t, "A", "B", 7, "k") for d, t in TWICE], "doc_id long, text string, a string, b string, n int, k string").repartition(3)
    return df.toDF("doc_id", "text", "TEXT", "Doc_ID", "key.n", "score")


def test_substring_tells_rows_of_one_id_apart(clashing):
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.deduplicated(clashing).collect())
    assert got == [(0, 90, 0), (1, 91, 0), (2, 1, 0), (2, 93, 90), (2, 93, 90), (2, 600, 0), (3, 0, 0)]


def test_other_operators_take_repeated_and_missing_ids(spark, clashing, tmp_path):
    n = len(TWICE)
    rows = minhash.near_duplicates(clashing).collect()
    assert len(rows) == n and {r.component_id for r in rows if r.doc_id == 1} == {1}
    items = spark.createDataFrame([("i", " ".join(f"p{i}" for i in range(12)))], "item_id string, text string")
    got = decontam.contaminated(clashing, items, slop=2).collect()
    words = {t: len((t or "").split()) for _, t in TWICE}
    held_by = {t for _, t in TWICE if PASSAGE in (t or "")}
    want = sorted((str(d), words[t], 12 if t in held_by else 0, int(t in held_by), t in held_by) for d, t in TWICE)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == want
    model = toxicity.train(["a", "b"], [0, 0])
    assert toxicity.scored(clashing, model).count() == n and toxicity.accepted(clashing, model).columns == clashing.columns
    assert pii.found(clashing).count() == n and pii.redacted(clashing).columns == clashing.columns
    assert quality.ledger(clashing).count() == n
    ids = Encoder.at(default_path()).model
    want = sorted(zlib.crc32(np.array([*ids.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()) for _, t in TWICE)
    read = wavelet.digest(clashing).collect()
    assert sorted(r.ids_crc32 for r in read) == want and sum(r.doc_id is None for r in read) == 1
    assert packing.packed(clashing).agg({"length": "sum"}).first()[0] == sum(r.n_tokens for r in read)
    pages = spark.createDataFrame([(1, "http://a.com/en/1", "x")], "page_id long, u string, w string").toDF("page_id", "url", "URL")
    assert url_filter.judged(pages).first().verdict == "block"


def test_pipeline_stages_take_clashing_names(spark, clashing, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([("i", "no such words in any of these")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_contaminated, corpus_pipeline.mask_personal_data):
        out = stage(spark, clashing, str(tmp_path))
        ids = {r[0] for r in out.collect()}  # rows of one id share one decision about near copies
        assert out.columns == clashing.columns and (ids == {1, 3, None} if stage is corpus_pipeline.drop_near_copies else ids == {1, 2, 3, None})
    empty = clashing.limit(0)
    assert all(stage(spark, empty, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_what_is_staged_in_a_block_goes_with_it(spark):
    with common.scratch():
        _, path = common.staged(spark.range(3), "gone")
    _, kept = common.staged(spark.range(3), "kept")
    there = lambda p: (q := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(q)
    assert not there(path) and there(kept)
    common.remove(spark, kept)


# Personal data, from the words of the rules.


def slow_base(text):
    """Leftmost, non-overlapping matches by trying every start, without any lookbehind or atomic group."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in kinds.items():
        at, own = 0, re.compile(pattern)
        while at < len(text):
            m = own.match(text, at)
            if not m:
                at += 1
                continue
            digits = [int(c) for c in m.group() if "0" <= c <= "9"]
            fine = True
            if kind == "ip":
                fine = all(int(x) <= 255 for x in m.group().split("."))
            elif kind == "card":
                doubled = [d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(reversed(digits))]
                fine = 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
            elif kind == "phone":
                fine = 8 <= len(digits) <= 15
            if fine:
                out.append((kind, *m.span()))
            at = max(m.end(), at + 1)
    return out


def test_base_spans_are_those_of_the_rules():
    r = random.Random(4)
    pieces = ["a@b.co", "@", ".", "..", "x_y", "-", "+", "%", "1.2.3.4", "10.0.0.256", "0.0.0.0255", "4111 1111 1111 1111", "4111-1111-1111-1111", "5", "12", "+4", "+49 (30) 12 34-56", "(", ")", " ", "\n", "é", "١", "_c@d.org", "@b@c.d", "+1.2.3.4"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 9)))
        assert pii.base_spans(text) == slow_base(text), text


@pytest.mark.parametrize("text", ["7" * 1_000_000, "a" * 1_000_000 + "@", "@" + "a." * 500_000, "1." * 500_000, "a@" * 400_000, "+1" * 400_000, "1 " * 500_000, "a@b" + "c" * 900_000])
def test_long_runs_take_no_longer_than_they_are(text):
    model = pii.field()
    began = time.process_time()
    pii.spans_of([text], model)
    assert time.process_time() - began < 8


# Toxicity, by a network of scalars.


def slow_score(net, text):
    p, h_ = net.p, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def vector(word):
        core = b"^" + word.strip(toxicity._EDGE).lower() + b"$"
        core = core if len(core) >= 3 else core + b"$"
        grams = []
        for k in (2, 3, 4):
            for i in range(len(core) - k):
                code = int.from_bytes(core[i : i + k + 1], "little") + (k << 56)
                grams.append(int(common.mix(np.array([code], dtype=np.uint64))[0]) % toxicity.GRAMS)
        mean = [sum(float(p["grams"][g, d]) for g in grams) / max(1, len(grams)) for d in range(toxicity.HALF)]
        return [*map(float, p["words"][zlib.crc32(core) % toxicity.WORDS]), *mean]

    words = [vector(w) for w in toxicity.words_of(text)]
    best = None
    for start in toxicity.windows(len(words)):
        own = words[start : start + toxicity.SPAN]
        states = [[0.0] * (2 * h_) for _ in own]
        for d in (0, 1):
            h = [0.0] * h_
            for t in range(len(own)) if d == 0 else range(len(own) - 1, -1, -1):
                x = [sum(own[t][i] * float(p[f"in{d}"][i, j]) for i in range(len(own[t]))) + float(p[f"bias{d}"][j]) for j in range(3 * h_)]
                s = [sum(h[i] * float(p[f"state{d}"][i, j]) for i in range(h_)) for j in range(3 * h_)]
                r, z = [sig(x[j] + s[j]) for j in range(h_)], [sig(x[h_ + j] + s[h_ + j]) for j in range(h_)]
                c = [math.tanh(x[2 * h_ + j] + r[j] * s[2 * h_ + j]) for j in range(h_)]
                h = [c[j] + z[j] * (h[j] - c[j]) for j in range(h_)]
                states[t][d * h_ : (d + 1) * h_] = h
        ask = [sum(math.tanh(sum(st[i] * float(p["look"][i, j]) for i in range(2 * h_))) * float(p["ask"][j]) for j in range(h_)) for st in states]
        share = [math.exp(a - max(ask)) for a in ask]
        pooled = [sum(w * st[j] for w, st in zip(share, states, strict=True)) / sum(share) for j in range(2 * h_)] if own else [0.0] * (2 * h_)
        logit = sum(a * float(b) for a, b in zip(pooled, p["out"], strict=True)) + float(p["base"][0])
        best = logit if best is None else max(best, logit)
    return sig(best)


def test_scores_are_those_of_a_slow_network():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 5, 31, 32, 33, 48, 49, 90)] + ["", "x" * 150, "bad " * 40]
    net = toxicity.train([" ".join([word() for _ in range(20)] + ["vile"] * (i % 2)) for i in range(60)], [i % 2 for i in range(60)], steps=20)
    assert np.allclose(net.scores(texts), [slow_score(net, t) for t in texts], atol=2e-4)


def test_training_texts_are_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + 5000 * (i == 2))) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    seen = []
    old = toxicity.train
    try:
        toxicity.train = lambda texts, labels: seen.extend(texts) or old(texts, labels, steps=1)
        toxicity.fitted(docs, labels, most_bytes=100)
    finally:
        toxicity.train = old
    assert seen and max(map(len, seen)) < 10


def test_tokens_of_hard_texts():
    import pyarrow as pa

    encoder = Encoder(default_path())
    texts = ["a", "'s x", "x 's", " a b", "a ", "a  b", "a\nb", "a\n\nb", "\n", "é, É. x.,", "it's don't, I'll.", "日本語 テスト", "a　b", "x,y z. .", "<|endoftext|> a", "1,2 3.4 a1,", "ß×÷ ×a,", None, "", "ab " * 5000 + "end.", "x" * 100_000]
    for _ in range(2):  # unknown chunks, then known ones
        for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
            assert ids.tolist() == (encoder.model.encode(text, add_special_tokens=False).ids if text else []), text
    encoder.LIMIT = 3
    assert encoder.encode(pa.array(["some new words"]))[0].tolist() == encoder.model.encode("some new words", add_special_tokens=False).ids


def test_open_buckets_in_blocks_lose_no_link(spark, monkeypatch):
    """Many documents with a common core meet in the same buckets; blocks of three give what brute force gives."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    r = random.Random(5)
    core = [f"c{i}" for i in range(60)]
    texts = [" ".join(core + [f"t{i // 2}.{k}" for k in range(30)] + ([f"u{i}"] if i % 2 else [])) for i in range(40)]
    r.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(group)) and len(set(group)) == 20


def test_proximity_items_are_counted(spark):
    words = [f"q{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x", *words[:4], "changed", *words[5:], "y"])), (3, "q4 q3 q5 q6 q7 q8 q9 q2 q10 q11 nothing")], "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near) for r in decontam.contaminated(docs, spark.createDataFrame([("i", " ".join(words))], "item_id string, text string"), slop=2).collect()}
    assert got[1][0] == 1 and got[2][0] == 0 and got[2][1] == 1 and got[3] == (0, 0)


def test_packing_needs_few_sequences():
    r = random.Random(3)
    for spread in ((1, 1024), (300, 700), (1, 200)):
        lengths = [r.randint(*spread) for _ in range(3000)]
        counts = {n: lengths.count(n) for n in set(lengths)}
        made = packing.best_two_fit(counts, 1024)
        used = {}
        for many, bin_ in made:
            assert sum(n * c for n, c in bin_) <= 1024
            for n, c in bin_:
                used[n] = used.get(n, 0) + many * c
        assert used == counts and sum(m for m, _ in made) <= 1.03 * max(-(-sum(lengths) // 1024), sum(n > 512 for n in lengths)) + 2


def test_digest_of_spans_names_them(spark):
    text = "write a.b@example.org or 10.0.0.1"
    row = pii.found(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.base_sha256 == hashlib.sha256(b"email:6:21,ip:25:33").hexdigest() and row.n_spans >= 2
