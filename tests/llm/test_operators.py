"""Every operator over a small table with the hard cases, against brute force or an exact round trip."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import decontam, minhash, packing, pii, quality, substring, toolcalls, toxicity, url_filter, wavelet
from tidemark.llm.tokens import Encoder, default_path

SCHEMA = "doc_id long, text string, n string, score string, n_words string"


def _rows():
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["é", "ü,", "don't", "A", "a"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    copied, passage = prose(180), prose(70)
    texts = [None, "", " \n\t ", "one", "one two three", "one two three", copied, copied, copied.upper(), copied + " tail", copied.replace("w1 ", "x1 ")]
    texts += [f"{prose(40)} {passage} {prose(30)}" for _ in range(6)] + [prose(n) for n in (49, 50, 51, 300)]
    texts += ["x " * 3000, "b" * 9000, "mail a.b@mail.example.com or +1 (555) 555-1234, 10.0.0.255 300.1.1.1 4111 1111 1111 1111 1\n\nend", "a\n\n  b \u00a0 c\td\r\n" * 30, "line one\nline one\nline two\n" * 5]
    return [(i * 3 % 41, t, "x", "y", "z") for i, t in enumerate(texts)]


ROWS = _rows()
TEXT = {d: t or "" for d, t, *_ in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_substring(docs, empty):
    first = {}
    for d in sorted(TEXT):
        w = split(TEXT[d])
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    got = {r.doc_id: r for r in substring.deduplicated(docs, batches=3, digest=True).collect()}
    removed = 0
    for d, text in TEXT.items():
        w, gone = split(text), set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_text) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        removed += len(gone)
    assert removed > 300
    assert substring.deduplicated(empty).count() == 0


def test_substring_index_grows_and_compacts(spark, docs, tmp_path):
    rows = substring.fingerprints(docs).cache()
    index = substring.FingerprintIndex(spark, f"file://{tmp_path}/index", fanout=2)
    for lo in (0, 15, 30):
        index.ingest(rows.where(f"doc_id >= {lo} AND doc_id < {lo + 15}"))
    runs = substring.FingerprintIndex(spark, f"file://{tmp_path}/index").runs()
    assert sorted(level for level, _ in runs) == [0, 1]
    assert index.read([p for _, p in runs]).select("h", "ctx").distinct().count() == rows.select("h", "ctx").distinct().count()


def test_minhash(docs, empty):
    sets = {}
    for d, text in TEXT.items():
        w = split(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(s), group[d], group[d] == d) for d, s in sets.items()}
    assert len(set(group.values())) < len(group)
    assert minhash.near_duplicates(empty).count() == 0


def test_parity_never_overstates_difference():
    r = np.random.default_rng(1)
    for n in (1, 20, 500, 5000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], r.integers(0, 2**63, n // 3, dtype=np.uint64))))
        apart = sum((x ^ y).bit_count() if x ^ y >= 0 else (2**64 + (x ^ y)).bit_count() for x, y in zip(minhash.parity(a), minhash.parity(b), strict=True))
        assert apart <= len(np.setxor1d(a, b))


def test_decontamination(spark, docs, empty):
    passage = split(TEXT[sorted(TEXT)[-1]])
    words = [decontam.words_of(t) for t in TEXT.values() if len(decontam.words_of(t)) > 60]
    items = [(1, b" ".join(words[0][5:18]).decode()), (2, "one"), (3, None), (4, ""), (5, "no such words anywhere in this small table at all"), (10, b" ".join(words[1][20:30]).decode().upper())]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(docs, table).collect()}
    for d, text in TEXT.items():
        w, hit, held = decontam.words_of(text), set(), set()
        for i, item in items:
            for win in decontam.windows_of(item):
                p = win.split()
                for k in range(len(w) - len(p) + 1):
                    if w[k : k + len(p)] == p:
                        hit.update(range(k, k + len(p)))
                        held.add(str(i))
        assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].contaminated) == (len(w), len(hit), len(held), bool(hit)), d
        assert got[d].items_sha256 == hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
    assert decontam.contaminated(empty, table).count() == 0 and passage is not None


def test_proximity(spark, tmp_path):
    text = "alpha one two beta three four alpha x one two beta"
    index = decontam.PositionalIndex(spark.createDataFrame([(1, text)], "doc_id long, text string"), [b"alpha one two beta"], f"file://{tmp_path}/postings")
    assert [(r.doc_id, r.start) for r in index.phrases().collect()] == [(1, 0)]
    assert (1, 6, 1) in {(r.doc_id, r.start, r.apart) for r in index.near(2).collect()}


def test_tokens_wavelet_and_packing(docs, empty):
    model = Encoder.at(default_path()).model
    ids = {d: model.encode(t, add_special_tokens=False).ids for d, t in TEXT.items()}
    got, before = {r.doc_id: r for r in wavelet.digest(docs).collect()}, 0
    for d in sorted(ids):
        own = np.array([*ids[d], 0], dtype="<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (before, len(own), zlib.crc32(own.tobytes()))
        before += len(own)
    assert wavelet.digest(empty).count() == 0
    bins, starts = {}, {}
    for r in packing.packed(docs).collect():
        own = np.array([*ids[r.doc_id], 2], dtype="<u4")[r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        starts.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for spots in bins.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))] and sum(n for _, n in spots) <= 1024
    for d, pieces in starts.items():
        assert [(s, n) for _, s, n in sorted(pieces)] == packing.cut(len(ids[d]) + 1, 1024)
    assert packing.packed(empty).count() == 0


def test_wavelet_matrix_answers_like_an_array():
    ids = np.random.default_rng(2).integers(0, 700, 5000).astype(np.uint32)
    _, _, m = wavelet.from_bytes(wavelet.to_bytes(np.array([4, 9]), np.array([2000, 3000]), ids))
    assert (m.decode() == ids).all() and [m.access(i) for i in range(0, 5000, 311)] == ids[::311].tolist()
    for v in (0, 5, 699, 700, 5000):
        where = np.flatnonzero(ids == v)
        assert m.count(v) == len(where) and m.occurrences(v) == where.tolist() and m.count(v, 100, 900) == ((where >= 100) & (where < 900)).sum()
    with pytest.raises(IndexError):
        m.access(5000)


def test_best_two_fit_swaps_the_smallest():
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [(1, [(6, 1), (2, 2)]), (1, [(3, 1)])]


def test_quality(spark, docs, empty):
    got = {r.doc_id: r for r in quality.ledger(docs).collect()}
    for d, text in TEXT.items():
        w = split(text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(w) < 400 else None
        lines = [x for x in text.split("\n") if split(x)]
        assert (got[d].n_words, got[d].word_chars, got[d].n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert twice is None or got[d].n_repeat_words == len(twice)
        assert got[d].fail_bits & 3 == (len(w) < 50) + 2 * (100 * got[d].n_repeat_words > 50 * len(w))
    rows = {r.rule: r for r in quality.ablations(quality.ledger(docs), "web", 2).collect()}
    only = sum(r.fail_bits == 1 for r in got.values())
    assert rows["min_words"].failed_alone == only and rows["min_words"].kept_without == rows["min_words"].kept + only
    assert quality.ledger(empty).count() == 0


def test_url_filter(spark):
    urls = ["https://a.example.com/en/7/x", "http://EXAMPLE.com/en/8?q", "ftp://x.net/de/", "x://example.net/de/80#f", "http://b.org/es", "http://b.org/es/1", "http://spam-farm.org/a", None, "nothing", "http://ads-track.x.com", "http://ok.io/?u=http://spam-farm.org"] + [f"http://h{i}.io/" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(6, urls[6], "h")], "page_id long, url string, host string")
    for shards in (1, 3):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, shards=shards).collect()}
        assert got[0] == ("a.example.com", "/en/7/x", "example.com/en/7", "allow") and got[1] == ("example.com", "/en/8", "com/en/", "block")
        assert got[2] == ("x.net", "/de/", "net/de/", "block") and got[3] == ("example.net", "/de/80", "example.net/de/8", "block")
        assert got[4] == ("b.org", "/es", None, "allow") and got[5][2:] == ("org/es/", "block") and got[6][3] == got[9][3] == "block"
        assert got[7] == got[8] == ("", "", None, "allow") and all(got[i][3] == "allow" for i in range(10, len(urls)))
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_url_filter_gives_the_words_of_the_contract(spark):
    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://a.net/de/1", "http://example.net/de/8", "http://a.org/es/1", "http://example.net/de/7", "http://spam-farm.net/de/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert [got[i] for i in range(5)] == list(words.items()) and got[5] == got[6] == ("net/de/", "allow")


def test_pii(docs, empty):
    text = next(t for t in TEXT.values() if "mail a.b" in t)
    spans = pii.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [("email", "a.b@mail.example.com"), ("ip", "10.0.0.255"), ("card", "1 4111 1111 1111 1111 1"), ("phone", "+1 (555) 555-1234")]
    assert pii.base_spans("4111 1111-1111 1111 x") == [("card", 0, 19)] and pii.luhn("4111111111111111")
    got = {r.doc_id: r for r in pii.found(docs).collect()}
    for d, t in TEXT.items():
        base = pii.base_spans(t)
        assert got[d].base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest() and got[d].n_phone == sum(k == "phone" for k, _, _ in base)
        assert set(pii.written(base).split(",")) - {""} <= set(got[d].spans.split(","))
    assert pii.found(empty).count() == 0
    masked = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert any("[EMAIL]" in (t or "") for t in masked.values()) and [d for d, t, *_ in ROWS if t is None] == [d for d, t in masked.items() if t is None]


def test_field_learns_and_cuts_do_not_change_the_best_path():
    model, rows = pii.field(), pii.labelled(120, 5)
    tags = model.tags([[w.encode() for w in words] for words, _ in rows])
    right = total = 0
    for (words, gold), got in zip(rows, tags, strict=True):
        got = np.zeros(len(words), dtype=int) if got is None else got
        scores = model.scores(model.ids([w.encode() for w in words]))
        assert (model._viterbi([scores])[0] == got).all()
        right += sum(pii.TAGS[x] == g for x, g in zip(got, gold, strict=True))
        total += len(gold)
    assert right / total > 0.98


def test_toxicity(spark, docs, empty):
    r = random.Random(3)
    prose = lambda n: [r.choice(["la", "the", "of", "enti", "stou", "wer"]) + r.choice("abcdef") for _ in range(n)]
    texts, labels = [], []
    for i in range(240):
        words = prose(r.randint(5, 120))
        if i % 3 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grubnak", "grubzot", "vilespit"]))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = toxicity.train(texts[:160], labels[:160])
    scores = model.scores(texts[160:])
    assert ((scores >= 0.7) == np.array(labels[160:], dtype=bool)).mean() > 0.95
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= x.score <= 1 and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in rows)
    assert toxicity.accepted(docs, model).columns == docs.columns
    nothing = toxicity.fitted(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(empty, nothing).count() == 0 and 0 <= nothing.scores([None, ""])[0] <= 1


def test_gradients_are_right():
    net = toxicity.train(["a b c d", "e f g h"], [1, 0], steps=1)
    net = toxicity.Network({k: v.astype(np.float64) for k, v in net.p.items()})
    x = np.random.default_rng(0).normal(size=(6, 2 * toxicity.HALF))
    at = np.zeros((3, toxicity.SPAN), dtype=np.int64)
    at[:, :4] = [[1, 2, 3, 4], [5, 6, 1, 0], [2, 2, 2, 2]]
    y, w = np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        p = toxicity._sigmoid(net.forward(net.projected(x), at).astype(np.float64))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g, dx = net.gradients(x, net.projected(x), at, y, w)
    for name in ("in0", "state1", "look", "ask", "out", "bias0"):
        v, k = net.p[name].reshape(-1), 3 % net.p[name].size
        old, h = v[k], 3e-2
        v[k] = old + h
        up = loss()
        v[k] = old - h
        down = loss()
        v[k] = old
        assert abs((up - down) / (2 * h) - g[name].reshape(-1)[k]) < 2e-3, name
    assert dx.shape == x.shape


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "answer", '{"words":1,"text":"x"}', None), (1, "b", 2, "answer", '{"text":"y","words":"2"}', "a"), (1, "c", 4, "answer", '{"text":1.5,"more":[1]}', "b"), (2, "d", 0, "fly", "{}", "zz"),
        (2, "e", 0, "setup", "nope", "f"), (2, "f", 0, "setup", None, "e"), (3, None, 0, "setup", '{"text":"t","words":3}', None), (3, "g", 0, "setup", '{"text":"t","words":3}', None), (3, "g", 1, "setup", '{"text":"t","words":3}', None),
    ], "conv_id long, call_id string, turn long, name string, arguments string, after string")
    results = spark.createDataFrame([("a", 1, "r1"), ("a", 3, "r2"), ("x", 1, "lost"), (None, 1, "none")], "call_id string, turn long, content string")
    rows = toolcalls.linked(calls, results).collect()
    got = {r.call_id: r for r in rows}
    assert len(rows) == 9 and (got["a"].position, got["a"].linked, got["a"].result_turn, got["a"].errors) == (0, True, 1, "")
    assert got["a"].canonical == '{"arguments":{"text":"x","words":1},"id":"a","name":"answer","position":0,"result":"r1"}'
    assert (got["b"].position, got["b"].errors) == (1, "type:words") and (got["c"].position, got["c"].errors) == (2, "missing:words,type:text,unknown:more")
    assert got["d"].errors == "unknown_after,unknown_tool" and got["e"].position is None and got["e"].errors == "cycle,not_json" and got["f"].errors == "cycle,not_json"
    assert got[None].errors == "no_id" and got["g"].errors == "duplicate_id"
    assert toolcalls.orphans(calls, results).count() == 2
    assert toolcalls.linked(*toolcalls.from_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark, docs, tmp_path):
    import corpus_pipeline

    own = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t, *_ in ROWS] + [(None, "nobody knows my number", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    own.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r.doc_id for r in minhash.near_duplicates(own).where("kept").collect()}
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept | {None}


def test_pipeline_drops_near_copies_from_a_similarity_of_80(spark):
    import corpus_pipeline

    r = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for n in (4, 6, 8, 9, 10, 11, 12, 13, 16, 20, 30):  # a tail of n words beside 100 leaves a Jaccard of about 100 / (100 + 2n)
        body = [r.choice(words) for _ in range(100)]
        texts += [" ".join(body + [r.choice(words) for _ in range(n)]) for _ in range(2)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(len(sets)))
    between = 0
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                share, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                between += 80 * union <= 100 * share < 85 * union
                if 100 * share >= 80 * union:
                    group[a] = group[b] = min(group[a], group[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert between and kept == set(group) and len(kept) < len(texts)


def test_toxicity_reads_long_unspaced_texts_whole():
    r = random.Random(3)
    prose = lambda n: [r.choice(["la", "the", "of", "enti", "stou", "wer"]) + r.choice("abcdef") for _ in range(n)]
    texts = [" ".join(prose(60) + ["grubnak", "grubzot", "grubnak"] * (i % 3 == 0) + prose(20)) for i in range(160)]
    model = toxicity.train(texts, [int(i % 3 == 0) for i in range(160)])
    for sep in ("_", ",", "/", "\u00a0", "\u3001"):
        clean, bad = sep.join(prose(120)), sep.join(prose(60) + ["grubnak"] + prose(60))
        assert len(bad.encode().split()) == 1 and (model.scores([clean, bad]) >= 0.7).tolist() == [False, True], sep
    han = "\u4eca\u5929\u5929\u6c14\u5f88\u597d" * 60
    assert (model.scores([han, han[:101] + "grubnak" + han[101:]]) >= 0.7).tolist() == [False, True]
    for text in ("b" * 9000, han, "x_" * 50 + "\u00e9\u00a0" * 40, "ab" * 32 + "c"):
        assert set(b"".join(toxicity.words_of(text))) == set(text.encode()) and all(w in text.encode() for w in toxicity.words_of(text))
    assert "".join(map(bytes.decode, toxicity.words_of("_".join(map(str, range(100)))))) == "_".join(map(str, range(100)))
    assert toxicity.words_of("a b " + "c" * 64) == [b"a", b"b", b"c" * 64]


def test_url_filter_takes_as_many_shards_as_its_hosts_ask_for(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BITS", 1 << 11)
    for bad, good in ((600, 300), (20, 30_000)):  # the first level is too large for one shard, or the second
        urls = [f"http://spam-farm.h{i}.io/" for i in range(bad)] + [f"http://h{i}.io/" for i in range(good)]
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        assert url_filter.shards_of(bad, good) > 1
        got = {r.page_id: r.verdict for r in url_filter.judged(pages).collect()}
        assert got == {i: "block" if i < bad else "allow" for i in range(bad + good)}
    assert url_filter.shards_of(0, 0) == 1


def test_field_runs_are_cut_at_base_spans():
    text = "write jane (at) doe (dot) com, a@b.com jim (at) roe (dot) org, +1 (555) 555-1234 or so"
    base = pii.base_spans(text)
    assert [k for k, _, _ in base] == ["email", "phone"]
    words = text.split()
    tag = next(i for i, k in enumerate(pii.TAGS) if i)
    tags = np.array([0] + [tag] * (len(words) - 3) + [0, 0])
    spans = [text[a:b] for _, a, b in pii.field_spans(text, tags, base)]
    assert spans == ["jane (at) doe (dot) com", "jim (at) roe (dot) org"]
    whole = pii.masked(text, base + pii.field_spans(text, tags, base))
    assert "jane" not in whole and "roe" not in whole and whole.startswith("write [") and whole.endswith("or so")


def test_proximity_keeps_substituted_words_and_counts_the_others(spark, tmp_path):
    text = "alpha one two beta three four alpha x one two beta five alpha one six beta alpha six seven beta"
    index = decontam.PositionalIndex(spark.createDataFrame([(1, text)], "doc_id long, text string"), [b"alpha one two beta"], f"file://{tmp_path}/postings")
    index.terms, index.anchors = {b"alpha": 0, b"beta": 1}, [(0, 0, 0, 0), (1, 0, 3, 1)]  # as if these were the rarest
    body = index.docs.first().body
    index.postings = spark.createDataFrame([(0, 1, body, [0, 6, 12, 16]), (1, 1, body, [3, 10, 15, 19])], index.schema)
    got = {(r.start, r.apart): r.n_match for r in index.near(2).collect()}
    assert got == {(6, 1): 4, (12, 0): 3, (16, 0): 2}


def test_tool_calls_behind_several_calls_stand_behind_all(spark):
    r = random.Random(8)
    rows = [(1, "b", "a"), (1, "b", "c"), (1, "c", "a"), (1, "a", None), (1, "d", "b"), (1, "e", "d"), (1, "e", "b"), (2, "x", "y"), (2, "y", "x"), (2, "x", "a"), (2, "z", "x"), (2, "z", "gone"), (3, "q", "q")]
    rows += [(4 + i % 3, f"n{r.randrange(40)}", r.choice([None, *(f"n{k}" for k in range(60))])) for i in range(70)] + [(9, f"c{i}", f"c{i - 1}" if i else None) for i in range(30)]
    behind, ids = {}, {c for _, c, _ in rows}
    for _, c, a in rows:
        behind.setdefault(c, set()).update({a} & ids)

    def place(c, on=()):
        if c in on:
            return None
        before = [place(a, (*on, c)) for a in behind[c]]
        return None if None in before else max((x + 1 for x in before), default=0)

    calls = spark.createDataFrame([(v, c, i, "setup", "{}", a) for i, (v, c, a) in enumerate(rows)], "conv_id long, call_id string, turn long, name string, arguments string, after string")
    assert {x.call_id: x.position for x in toolcalls.positions(calls).collect()} == {c: place(c) for c in ids}
    got = toolcalls.linked(calls, spark.createDataFrame([], "call_id string, turn long, content string")).collect()
    copies = {c: sum(x == c for _, x, _ in rows) for c in ids}
    want = sorted(((c, place(c) if copies[c] == 1 else 0 if a not in ids else place(a) if place(a) is None else place(a) + 1) for _, c, a in rows), key=str)
    assert sorted(((x.call_id, x.position) for x in got), key=str) == want
    assert place("b") == 2 and {x.position for x in got if x.call_id == "b"} == {1, 2} and place("e") == 4 and place("z") is None
