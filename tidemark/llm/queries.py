"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes("base", 1)).alias("base_failed"), quality.passes("web", 3).alias("kept"), "fail_bits")


ORACLES["op8_rule_ledger"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM pos),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(lines.n, 0)::BIGINT AS n_lines,
 coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(list_max(list_transform(ws, lambda x: strlen(x))), 0)::BIGINT AS longest_word
 FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
 + 8 * (10 * n_symbols > n_words)::BIGINT + 16 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 32 * (longest_word > 1000)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 47) = 0 AS kept, fail_bits FROM b
"""


@_query
def op9_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    return url_filter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op9_bloom_cascade"] = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, CASE
 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
 WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
 WHEN regexp_matches(host, '(^|\.)(spam-farm|ads-track|casino-win)\.') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


@_query
def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.packed(table(spark, sf_dir, "documents"))


@_query
def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import wavelet

    return wavelet.digest(table(spark, sf_dir, "documents"))


@_query
def op10_crf_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.found(table(spark, sf_dir, "documents"))


@_query
def op1_fingerprint_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.deduplicated(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept_text", "kept_sha256")


ORACLES["op1_fingerprint_runs"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM p),
hit AS (SELECT doc_id, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS at FROM hit, (SELECT unnest(range(50)) AS k)),
all_words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS at FROM d),
kept AS (SELECT a.doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY a.at) AS t FROM all_words a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.at = g.at GROUP BY a.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@_query
def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLES["op4_circulant_minhash"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, coalesce(c.m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id
"""


@_query
def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op5_positional_index"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bp AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') AS t, least(len(ws), 10) AS n FROM bp),
dp AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS t FROM dp, (SELECT DISTINCT n FROM w) WHERE i + n - 1 <= len(ws)),
m AS (SELECT doc_id, i, g.n, item_id FROM g JOIN w ON g.t = w.t AND g.n = w.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@_query
def op2_attentive_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


@_query
def op7_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toolcalls

    return toolcalls.linked(*toolcalls.from_conversations(table(spark, sf_dir, "conversations")))


ORACLES["op7_tool_links"] = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, CASE role WHEN 'user' THEN 'answer' ELSE 'setup' END AS name, coalesce(text, '') AS text,
 CASE WHEN role = 'user' AND turn >= 2 THEN conv_id || ':' || (turn - 2) END AS after FROM conversations WHERE role IN ('user', 'system')),
r AS (SELECT conv_id || ':' || (turn - 1) AS call_id, min(turn) AS result_turn, min_by(coalesce(text, ''), turn) AS content FROM conversations WHERE role = 'assistant' GROUP BY 1),
p AS (SELECT c.call_id, 0 AS position FROM c WHERE after IS NULL OR after NOT IN (SELECT call_id FROM c) UNION ALL SELECT c.call_id, p.position + 1 FROM p JOIN c ON c.after = p.call_id)
SELECT c.conv_id, c.call_id, p.position::BIGINT AS position, name, r.result_turn, r.call_id IS NOT NULL AS linked,
 CASE WHEN after IS NOT NULL AND after NOT IN (SELECT call_id FROM c) THEN 'unknown_after' ELSE '' END AS errors,
 '{"arguments":{' || CASE WHEN after IS NULL THEN '' ELSE '"after":' || to_json(after) || ',' END || '"text":' || to_json(text) || ',"words":' || len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) || '},"id":' || to_json(c.call_id)
 || ',"name":' || to_json(name) || ',"position":' || p.position || CASE WHEN r.call_id IS NULL THEN '' ELSE ',"result":' || to_json(r.content) END || '}' AS canonical
FROM c JOIN p USING (call_id) LEFT JOIN r USING (call_id)
"""


@_query
def op11_group_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import alignment

    return alignment.Alignment(table(spark, sf_dir, "documents"), digest=True).documents().withColumnRenamed("groups", "groups_sha256")


@_query
def op12_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.digest(table(spark, sf_dir, "documents"))


ORACLES["op12_histogram_sort"] = r"""
WITH bits AS (SELECT unnest(range(256)) AS b),
t AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc FROM bits),
d AS (SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size,
 list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t),
p AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS place, sum(size) OVER (ORDER BY doc_id) - size AS below, sum(size) OVER () AS total FROM c),
ends AS (SELECT place, below, total FROM p UNION ALL SELECT max(place) + 1, any_value(total), any_value(total) FROM p),
s AS (SELECT i, arg_min(place, abs(40 * below - total * i) * (SELECT count(*) + 2 FROM p) + place) AS place FROM ends, (SELECT unnest(range(1, 40)) AS i) GROUP BY i),
n AS (SELECT list(place ORDER BY place) AS places FROM s),
o AS (SELECT p.*, len(list_filter(places, lambda x: x <= p.place))::INT AS shard FROM p, n)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM o
"""


@_query
def op13_lattice_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair

    return repair.digest(table(spark, sf_dir, "conversations"))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
