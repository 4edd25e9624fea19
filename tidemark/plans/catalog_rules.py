"""More of the catalogue: derived edges, seeds, recordings, roll-ups and names that the first part leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.operators import diff, evidence, graph, impact, rollup, validate
from tidemark.plans import proxies as X
from tidemark.plans.catalog import _ARTIFACT_SQL, _DECISION_SQL, _PATH_SQL, _RING_SQL, ORACLES, QUERIES, _artifacts, _customer_targets, _decisions, _part_changes, _query, _ring
from tidemark.plans.proxies import PART_SQL, RECORDINGS_SQL, Tables, node, versions_sql

__all__ = ["ORACLES", "QUERIES"]


def _edges(df: DataFrame, source, target, kind, detail) -> DataFrame:
    return df.select(source.alias("source"), target.alias("target"), kind.alias("kind"), detail.alias("detail"))


def _page_path():
    return F.regexp_extract("url", "://([^?#]*)", 1)


# Derived edges.

_MARKS_SQL = "e AS (SELECT DISTINCT 'o:' || l_orderkey AS source, 'p:' || l_partkey AS target, 'references' AS kind, CASE l_returnflag WHEN 'R' THEN 'mutated_by' WHEN 'A' THEN 'registers' ELSE '' END AS detail FROM lineitem)"


def _marked(t: Tables) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "R", "mutated_by").when(F.col("l_returnflag") == "A", "registers").otherwise("")
    return _edges(t.lineitem, node("o", "l_orderkey"), node("p", "l_partkey"), F.lit("references"), flag).distinct()


@_query(f"WITH {_MARKS_SQL} SELECT source, target, detail FROM e WHERE detail = '' OR target NOT IN (SELECT 'p:' || p_partkey FROM part WHERE p_size > 40)")
def q61_without_isolated_writers(t: Tables) -> DataFrame:
    return graph.without_isolated_writers(_marked(t), t.part.where("p_size > 40").select(node("p", "p_partkey").alias("node"))).select("source", "target", "detail")


@_query("SELECT 'n:' || s_nationkey AS source, 's:' || s_suppkey AS target FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING sum(c_acctbal) > 250000)")
def q62_member_fan_out(t: Tables) -> DataFrame:
    escaped = t.customer.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("b")).where("b > 250000").select(node("n", "c_nationkey").alias("id"))
    return graph.fan_out(escaped, t.supplier.select(node("n", "s_nationkey").alias("container"), node("s", "s_suppkey").alias("member"))).select("source", "target")


@_query("SELECT DISTINCT 'c:' || o_custkey AS source, 'c:' || o_custkey || '.<imports>' AS target FROM orders UNION ALL SELECT 'c:' || o_custkey || '.<imports>', 'o:' || o_orderkey FROM orders")
def q63_import_hubs(t: Tables) -> DataFrame:
    return graph.import_hubs(_edges(t.orders, node("c", "o_custkey"), node("o", "o_orderkey"), F.lit("imports"), F.lit(""))).select("source", "target")


@_query("""SELECT 'o:' || o_orderkey AS source, 'r:' || n_regionkey || '.__init__' AS target FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'o:' || o_orderkey, 'n:' || c_nationkey || '.__new__' FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 12""")
def q64_constructor_hooks(t: Tables) -> DataFrame:
    bases = X.containers(t).where("source NOT LIKE 's:%'").select(F.col("source").alias("cls"), F.col("target").alias("base"))
    hook = lambda df, at, name: df.select(F.lit(name).alias("name"), at.alias("container"), F.concat(at, F.lit(f".{name}")).alias("id"))
    symbols = hook(t.region, node("r", "r_regionkey"), "__init__").unionByName(hook(t.nation.where("n_nationkey < 12"), node("n", "n_nationkey"), "__new__")).unionByName(hook(t.nation, node("n", "n_nationkey"), "run"))
    return graph.constructor_hooks(_edges(t.orders, node("o", "o_orderkey"), node("c", "o_custkey"), F.lit("references"), F.lit("")), symbols, bases).select("source", "target")


@_query("""WITH w AS (SELECT 'target:run:c:' || c_custkey AS node, 'c:' || c_custkey AS target, 'entry' AS kind, c_custkey % 97 <> 5 AS there FROM customer
UNION ALL SELECT 'target:run:c:' || o_custkey, 'o:' || o_orderkey, 'lifecycle', o_orderkey % 89 <> 7 FROM orders)
SELECT node, target, CASE WHEN there THEN kind WHEN kind = 'entry' THEN 'entry_symbol_unresolved' ELSE 'lifecycle_dependency_unresolved' END AS rule FROM w""")
def q65_target_edges(t: Tables) -> DataFrame:
    deps = t.orders.groupBy("o_custkey").agg(F.collect_set(node("o", "o_orderkey")).alias("lifecycle_dependencies"))
    targets = t.customer.join(deps, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.lit("run").alias("runner"), node("c", "c_custkey").alias("runner_id"), node("c", "c_custkey").alias("entry_symbol"), "lifecycle_dependencies")
    symbols = t.customer.where("c_custkey % 97 <> 5").select(node("c", "c_custkey").alias("id")).union(t.orders.where("o_orderkey % 89 <> 7").select(node("o", "o_orderkey")))
    edges, missing = graph.target_edges(targets, symbols)
    return edges.select(F.col("source").alias("node"), "target", F.col("kind").alias("rule")).union(missing.select("node", F.col("detail").alias("target"), "rule"))


@_query("""WITH e AS (SELECT l_orderkey AS o, l_partkey || '/' || l_suppkey AS x, min(l_returnflag) = 'R' AS writes FROM lineitem GROUP BY ALL), u AS (SELECT x FROM e GROUP BY x HAVING count(*) = 1)
SELECT 'o:' || o AS source, 'x:' || x AS target, CASE WHEN writes THEN 'writes' ELSE '' END AS detail FROM e WHERE NOT (writes AND x IN (FROM u))""")
def q66_without_lazy_writes(t: Tables) -> DataFrame:
    item = F.concat(F.lit("x:"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string"))
    rows = t.lineitem.groupBy(node("o", "l_orderkey").alias("o"), item.alias("x")).agg(F.min("l_returnflag").alias("f"))
    edges = _edges(rows, F.col("o"), F.col("x"), F.lit("references"), F.when(F.col("f") == "R", "writes").otherwise(""))
    return graph.without_lazy_writes(edges, rows.select(F.col("x").alias("node")).distinct()).select("source", "target", "detail")


@_query("SELECT 'o:' || o_orderkey AS source, 'log:callbacks' AS target FROM orders UNION ALL SELECT 'log:callbacks', 's:' || s_suppkey FROM supplier")
def q67_callback_hub(t: Tables) -> DataFrame:
    return graph.callback_hubs(t.orders.select(node("o", "o_orderkey").alias("node")), t.supplier.select(node("s", "s_suppkey").alias("node"))).select("source", "target")


_CLASS_SQL = "CASE event_type WHEN 'view' THEN 'unbounded' WHEN 'click' THEN 'bounded' WHEN 'signup' THEN 'import' WHEN 'purchase' THEN 'script' ELSE 'excluded' END"


@_query(f"WITH c AS (SELECT user_id || '/' || hour(ts) AS symbol, list_position(['excluded', 'script', 'import', 'installed', 'written', 'bounded', 'unbounded'], {_CLASS_SQL}) AS k FROM events) SELECT symbol, ['excluded', 'script', 'import', 'installed', 'written', 'bounded', 'unbounded'][min(k)] AS class FROM c GROUP BY symbol")
def q68_dynamic_class(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "unbounded").when(F.col("event_type") == "click", "bounded").when(F.col("event_type") == "signup", "import").when(F.col("event_type") == "purchase", "script").otherwise("excluded")
    return graph.dynamic_class(t.events.select(F.concat_ws("/", F.col("user_id").cast("string"), F.hour("ts").cast("string")).alias("symbol"), kind.alias("class")))


@_query(f"WITH RECURSIVE {_RING_SQL}, c AS (SELECT 's:' || s_suppkey AS origin, 's:' || s_suppkey AS node FROM supplier UNION SELECT c.origin, e.target FROM c JOIN edge e ON c.node = e.source) SELECT origin, node FROM c")
def q69_import_reach(t: Tables) -> DataFrame:
    ring = _ring(t)
    imports = _edges(ring.where("source LIKE 's:%' OR target LIKE 'r:%'"), F.col("source"), F.col("target"), F.lit("imports"), F.lit(""))
    writers = ring.where("source LIKE 'n:%' AND target LIKE 'n:%'").select(F.col("source").alias("module"), F.col("target").alias("writer_module"))
    return graph.import_reach(imports, writers, t.supplier.select(node("s", "s_suppkey").alias("node")))


@_query("SELECT 'p:' || l_partkey AS source, 's:' || l_suppkey AS target, l_linestatus AS kind, l_returnflag AS detail FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_linestatus, l_returnflag) = 1")
def q70_edge_tie_break(t: Tables) -> DataFrame:
    return graph.tied(_edges(t.lineitem, node("p", "l_partkey"), node("s", "l_suppkey"), F.col("l_linestatus"), F.col("l_returnflag")))


@_query("""WITH h AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS p FROM orders WHERE o_orderkey % 5 <> 1), b AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS p FROM orders WHERE o_orderkey % 7 <> 2 AND o_custkey IN (SELECT c FROM h))
SELECT 'c:' || c AS runner_id, string_agg(p, ',' ORDER BY p) AS deps FROM (FROM h UNION FROM b) GROUP BY c""")
def q71_carried_lifecycle(t: Tables) -> DataFrame:
    rows = graph.carried_lifecycle(_customer_targets(t, F.col("o_orderkey") % 5 != 1), _customer_targets(t, F.col("o_orderkey") % 7 != 2))
    return rows.select("runner_id", F.array_join("lifecycle_dependencies", ",").alias("deps"))


@_query("SELECT 'o:' || o_orderkey AS symbol, 'c:' || o_custkey AS reader FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0")
def q72_docstring_readers(t: Tables) -> DataFrame:
    flags = t.customer.select(node("c", "c_custkey").alias("node"), (F.col("c_acctbal") < 0).alias("reads_docs"))
    return graph.docstring_readers(_edges(t.orders, node("c", "o_custkey"), node("o", "o_orderkey"), F.lit("references"), F.lit("")), flags)


# Files and modules.


@_query("""SELECT path, CASE WHEN path LIKE 'src/%' THEN 'lib.' || replace(path[5:-4], '/', '.') ELSE replace(path[:-4], '/', '.') END AS module
FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'src/' ELSE '' END || lang || '/' || source || '/m' || doc_id || '.py' AS path FROM documents)""")
def q73_module_names(t: Tables) -> DataFrame:
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "src/").otherwise(""), "lang", F.lit("/"), "source", F.lit("/m"), F.col("doc_id").cast("string"), F.lit(".py"))
    return graph.module_names(t.documents.select(path.alias("path")), ["", "src=lib"]).select("path", "module")


@_query(f"SELECT page_id, CASE WHEN regexp_matches(path, '\\.example\\.net/|/de/') THEN 'out' ELSE 'in' END AS side FROM (SELECT page_id, {_PATH_SQL} AS path FROM pages)")
def q74_exclude(t: Tables) -> DataFrame:
    kept, out = graph.exclude(t.pages.select("page_id", _page_path().alias("path")), ["*.example.net/*", "*/de/*"])
    return kept.select("page_id", F.lit("in").alias("side")).union(out.select("page_id", F.lit("out").alias("side")))


@_query("SELECT 'several files are module ' || lang || '.' || source AS message, min(lang || '/' || doc_id) AS path FROM documents GROUP BY lang, source HAVING count(*) > 1")
def q75_module_collisions(t: Tables) -> DataFrame:
    return graph.duplicates(t.documents.select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.concat_ws(".", "lang", "source").alias("module"))).select("message", "path")


@_query("""WITH x AS (SELECT 'x' || l_suppkey AS path, l_returnflag AS level, l_partkey::VARCHAR AS name, l_linenumber AS n, l_quantity AS q FROM lineitem),
b AS (SELECT path, level, name, sum(q)::BIGINT AS d FROM x WHERE n <> 3 GROUP BY ALL), h AS (SELECT path, level, name, sum(q)::BIGINT AS d FROM x WHERE n <> 4 GROUP BY ALL)
SELECT path, level, name FROM b FULL JOIN h USING (path, level, name) WHERE b.d IS DISTINCT FROM h.d""")
def q76_native_changes(t: Tables) -> DataFrame:
    own = [F.concat(F.lit("x"), F.col("l_suppkey").cast("string")).alias("path"), F.col("l_returnflag").alias("scope"), F.col("l_partkey").cast("string").alias("name")]
    side = lambda n: t.lineitem.where(F.col("l_linenumber") != n).groupBy(*own).agg(F.sum("l_quantity").cast("long").cast("string").alias("digest"))
    return diff.native_changes(side(3), side(4))


# Seeds, relaxations and fallbacks.


@_query(f"WITH {PART_SQL} SELECT DISTINCT 'm:' || p_brand || '.' || p_size AS node, 3 AS mode FROM j JOIN part ON p_partkey = j.id WHERE (body OR def) AND (p_size % 4 = 0 OR p_size % 3 = 0)")
def q77_import_time_seeds(t: Tables) -> DataFrame:
    size = F.col("p_size")
    symbols = t.part.select(node("p", "p_partkey").alias("id"), F.concat(F.lit("m:"), "p_brand", F.lit("."), size.cast("string")).alias("module"), (size % 4 == 0).alias("decorated"), F.when(size % 3 == 0, "variable").otherwise("function").alias("kind"))
    return impact.import_time_seeds(_part_changes(t), symbols).select("node", "mode")


@_query(f"WITH {versions_sql('documents', 'doc_id', 'text', 'lang')} SELECT DISTINCT 'r:' || doc_id % 40 AS node, 3 AS mode FROM j JOIN documents ON doc_id = j.id WHERE NOT added AND NOT deleted AND body")
def q78_docstring_seeds(t: Tables) -> DataFrame:
    rows = diff.changed_keys(*X.versions(t.documents, "doc_id", "text", "lang"), "id", ["body_hash", "definition_hash"])
    changes = rows.select(node("d", "id").alias("id"), F.when(F.array_contains("columns", "body_hash"), F.array(F.lit("docstring_changed"))).otherwise(F.array("status")).alias("changes"))
    readers = t.documents.select(node("d", "doc_id").alias("symbol"), F.concat(F.lit("r:"), (F.col("doc_id") % 40).cast("string")).alias("reader"))
    return impact.docstring_seeds(changes, readers).select("node", "mode")


@_query(f"""WITH RECURSIVE {_RING_SQL}, c AS (SELECT source AS origin, source AS node FROM edge WHERE source LIKE 'n:%' UNION SELECT c.origin, e.target FROM c JOIN edge e ON c.node = e.source), hot AS (SELECT DISTINCT origin FROM c WHERE node IN ('r:1', 'r:3'))
SELECT 'c:' || c_custkey AS node, 3 AS mode FROM customer WHERE c_mktsegment = 'BUILDING' OR (c_mktsegment <> 'MACHINERY' AND 'n:' || c_nationkey IN (FROM hot))""")
def q79_dynamic_seeds(t: Tables) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "unbounded").when(F.col("c_mktsegment") == "MACHINERY", "excluded").otherwise("bounded")
    dynamic = t.customer.select(node("c", "c_custkey").alias("symbol"), node("n", "c_nationkey").alias("module"), kind.alias("class"))
    reach = diff.import_closures(_ring(t).withColumn("kind", F.lit("imports")), t.nation.select(node("n", "n_nationkey").alias("id")))
    return impact.dynamic_seeds(dynamic, reach, t.region.where("r_regionkey IN (1, 3)").select(node("r", "r_regionkey").alias("module"))).select("node", "mode")


@_query("SELECT 'target:run:' || doc_id AS node, 3 AS mode, lang || '.' || source AS via FROM documents WHERE lang || '.' || source IN (SELECT lang || '.' || source FROM documents GROUP BY lang, source HAVING sum(n_chars) % 2 = 0)")
def q80_entry_relaxed(t: Tables) -> DataFrame:
    d, entry = t.documents, F.concat(F.lit("t"), F.col("doc_id").cast("string"))
    hit = d.groupBy("lang", "source").agg(F.sum("n_chars").alias("n")).where("n % 2 = 0").select(F.concat_ws(".", "lang", "source").alias("node"))
    symbols = d.select(entry.alias("id"), F.concat_ws(".", "lang", "source").alias("module"))
    return impact.entry_relaxed(hit, d.select(F.lit("run").alias("runner"), F.col("doc_id").cast("string").alias("runner_id"), entry.alias("entry_symbol")), symbols)


@_query(f"""WITH RECURSIVE {_RING_SQL}, c AS (SELECT 's:' || s_suppkey AS origin, 's:' || s_suppkey AS node FROM supplier UNION SELECT c.origin, e.target FROM c JOIN edge e ON c.node = e.source)
SELECT 'run' || s_suppkey % 20 AS runner, min(node) AS detail FROM c JOIN supplier ON origin = 's:' || s_suppkey WHERE node IN (SELECT 'n:' || n_nationkey FROM nation WHERE n_regionkey < 2) GROUP BY 1""")
def q81_runner_dependencies(t: Tables) -> DataFrame:
    runners = t.supplier.select(F.concat(F.lit("run"), (F.col("s_suppkey") % 20).cast("string")).alias("runner"), node("s", "s_suppkey").alias("module"))
    reach = diff.import_closures(_ring(t).withColumn("kind", F.lit("imports")), t.supplier.select(node("s", "s_suppkey").alias("id")))
    return impact.runner_dependencies(runners, reach, t.nation.where("n_regionkey < 2").select(node("n", "n_nationkey").alias("module"))).select("runner", "detail")


@_query("""WITH l AS (SELECT p AS label, page_id FROM (SELECT page_id, url, unnest(['net', 'mobile', 'digit']) AS p FROM pages) WHERE (p = 'net' AND url LIKE '%.example.net/%') OR (p = 'mobile' AND url LIKE '%https://m.%' AND page_id % 2 = 0) OR (p = 'digit' AND regexp_matches(url, '/[0-3].$')))
SELECT label, page_id FROM l""")
def q82_always_run(t: Tables) -> DataFrame:
    k = F.col("page_id")
    targets = t.pages.select(F.when(k % 2 == 0, "even").otherwise("odd").alias("runner"), F.concat_ws("|", k.cast("string"), "url").alias("runner_id"))
    reasons, _ = impact.always_run(targets, [("net", "*.example.net/*", None), ("mobile", "*https://m.*", "even"), ("digit", "*/[0-3]?", None)])
    return reasons.select(F.col("detail").alias("label"), F.regexp_extract("node", r"^target:\w+:(\d+)", 1).cast("long").alias("page_id"))


@_query("""WITH n AS (SELECT DISTINCT 'm' || o_orderstatus || '.' || split_part(o_orderpriority, '-', 1) AS node FROM orders WHERE o_totalprice > 200000), u AS (SELECT DISTINCT 'c:' || o_custkey AS symbol, split_part(o_orderpriority, '-', 1) AS name FROM orders)
SELECT symbol, name, string_agg(node, ',' ORDER BY node) AS matched FROM u JOIN n ON split_part(node, '.', 2) = name GROUP BY symbol, name""")
def q83_unresolved_matches(t: Tables) -> DataFrame:
    word = F.split_part(F.col("o_orderpriority"), F.lit("-"), F.lit(1))
    unresolved = t.orders.select(node("c", "o_custkey").alias("symbol"), F.lit("attribute").alias("kind"), word.alias("name")).distinct()
    hit = t.orders.where("o_totalprice > 200000").select(F.concat(F.lit("m"), "o_orderstatus", F.lit("."), word).alias("node")).distinct()
    return impact.unresolved_matches(unresolved, hit).select("symbol", "name", F.array_join("matched", ",").alias("matched"))


@_query(f"""WITH RECURSIVE {_RING_SQL}, c AS (SELECT source AS origin, source AS node FROM edge WHERE source LIKE 'n:%' UNION SELECT c.origin, e.target FROM c JOIN edge e ON c.node = e.source)
SELECT DISTINCT 'o:' || o_orderkey AS node FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND ('n:' || o_orderkey % 25, 'n:' || c_nationkey) NOT IN (SELECT (origin, node) FROM c) AND o_orderkey % 25 <> c_nationkey""")
def q103_bound_on_package(t: Tables) -> DataFrame:
    """Orders, placed in nations by number, read customers of nations that are newly run."""
    symbols = t.orders.select(node("o", "o_orderkey").alias("id"), F.concat(F.lit("n:"), (F.col("o_orderkey") % 25).cast("string")).alias("module")).union(t.customer.select(node("c", "c_custkey"), node("n", "c_nationkey")))
    edges = _edges(t.orders, node("o", "o_orderkey"), node("c", "o_custkey"), F.lit("references"), F.lit(""))
    reach = diff.import_closures(_ring(t).withColumn("kind", F.lit("imports")), t.nation.select(node("n", "n_nationkey").alias("id")))
    return impact.bound_on_package(edges, symbols, t.nation.where("n_regionkey = 1").select(node("n", "n_nationkey").alias("node")), reach).select("node")


# Recorded execution.


@_query(f"""WITH p AS (SELECT DISTINCT {_PATH_SQL} AS path FROM pages), known AS (SELECT DISTINCT upper(string_split(path, '/')[1]) AS k FROM p UNION SELECT DISTINCT upper(array_to_string(string_split(path, '/')[1:2], '/')) FROM p WHERE len(string_split(path, '/')) > 1 AND length(path) % 3 = 0),
b AS (SELECT path, max(length(k)) AS n, arg_max(k, length(k)) AS spelled FROM p JOIN known ON lower(k) = lower(path) OR starts_with(lower(path), lower(k) || '/') GROUP BY path) SELECT p.path, coalesce(spelled || path[n + 1:], p.path) AS canonical FROM p LEFT JOIN b USING (path)""")
def q84_canonical_paths(t: Tables) -> DataFrame:
    paths = t.pages.select(_page_path().alias("path")).distinct()
    two = paths.where((F.size(F.split("path", "/")) > 1) & (F.length("path") % 3 == 0)).select(F.upper(F.substring_index("path", "/", 2)).alias("path"))
    known = paths.select(F.upper(F.substring_index("path", "/", 1)).alias("path")).union(two).distinct()
    return evidence.canonical_paths(paths, known).select("path", "canonical")


@_query("WITH v AS (SELECT source || '/' || lang AS value, count(*) AS n FROM documents GROUP BY 1) SELECT value, n, (SELECT count(*) FROM v) AS ids, (row_number() OVER ()) <= 0 AS beyond FROM v")
def q85_dictionary(t: Tables) -> DataFrame:
    """Decoded through the dictionary: every value with its rows, how many ids there are, and whether an id is beyond them."""
    words, rows = evidence.encoded(t.documents.select(F.concat_ws("/", "source", "lang").alias("item")), "item")
    ids = words.agg(F.countDistinct("id").alias("ids"), F.max("id").alias("top"))
    return rows.groupBy("item_id").agg(F.count("*").alias("n")).join(words, F.col("item_id") == F.col("id")).crossJoin(ids).select("value", "n", "ids", (F.col("id") >= F.col("ids")).alias("beyond"))


@_query("SELECT DISTINCT event_type AS phase, json_extract_string(props, '$.k') AS item, hour(ts)::VARCHAR AS module FROM events")
def q86_process_wide(t: Tables) -> DataFrame:
    return evidence.process_wide(t.events.select(F.col("event_type").alias("phase"), F.get_json_object("props", "$.k").alias("item"), F.hour("ts").cast("string").alias("module")))


@_query("""WITH w AS (SELECT l_orderkey AS o, l_suppkey AS s FROM lineitem GROUP BY ALL HAVING min(l_returnflag) <> 'R')
SELECT DISTINCT 's:' || s AS symbol, 'o:' || o AS reader FROM w JOIN supplier ON s_suppkey = s WHERE s_acctbal > 0 UNION SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier WHERE s_acctbal > 0""")
def q87_readers(t: Tables) -> DataFrame:
    symbols = t.supplier.where("s_acctbal > 0").select(node("s", "s_suppkey").alias("symbol"))
    return evidence.readers(symbols, X.references(t), t.supplier.select(node("s", "s_suppkey").alias("symbol"), node("n", "s_nationkey").alias("reader")))


@_query(f"WITH {PART_SQL} SELECT DISTINCT 'p:' || j.id AS id, substr(l_shipdate::DATE::VARCHAR, 1, 4) AS phase FROM j JOIN lineitem ON l_partkey = j.id WHERE body OR def")
def q88_escalated(t: Tables) -> DataFrame:
    phases = t.lineitem.select(node("p", "l_partkey").alias("item"), F.date_format("l_shipdate", "yyyy").alias("phase"), F.lit("m").alias("module"))
    return evidence.escalated(_part_changes(t), phases).select("id", "phase")


@_query("""WITH up AS (SELECT 's:' || s_suppkey AS origin, unnest(['s:' || s_suppkey, 'n:' || n_nationkey, 'r:' || n_regionkey]) AS node FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT 'n:' || n_nationkey, unnest(['n:' || n_nationkey, 'r:' || n_regionkey]) FROM nation UNION SELECT 'r:' || r_regionkey, 'r:' || r_regionkey FROM region)
SELECT origin, node FROM up UNION SELECT node, origin FROM up""")
def q89_class_hierarchy(t: Tables) -> DataFrame:
    own = X.containers(t).where("source NOT LIKE 'c:%'")
    classes = own.select(F.col("source").alias("id")).union(t.region.select(node("r", "r_regionkey")))
    return evidence.hierarchy(own.select(F.col("source").alias("cls"), F.col("target").alias("base")), classes)


@_query("SELECT page_id, starts_with(url, 'https://m.') AS inside FROM pages")
def q91_owned_environment(t: Tables) -> DataFrame:
    at = F.concat(F.lit("/work/"), F.regexp_replace("url", "^https://m\\.", "repo/"))
    return t.pages.select("page_id", evidence.owned_environment(at, "/work/repo").alias("inside"))


@_query(f"WITH {RECORDINGS_SQL} SELECT DISTINCT test_id, 'executed_changed' AS rule, item AS detail FROM rec")
def q92_two_sided(t: Tables) -> DataFrame:
    r = X.recordings(t).select("store_id", "test_id", F.lit("executed_changed").alias("rule"), F.col("item").alias("detail"))
    side = lambda s: r.where(F.col("store_id") == s).drop("store_id")
    return evidence.two_sided(side("even"), side("odd"))


# Validation and roll-ups.


@_query(f"WITH {RECORDINGS_SQL}, s AS (SELECT DISTINCT test_id, split_part(item, ':', 2) AS x FROM rec) SELECT test_id, string_agg(x, ',' ORDER BY x) AS symbols FROM s GROUP BY test_id")
def q93_merged_coverage(t: Tables) -> DataFrame:
    r = X.recordings(t).withColumn("x", F.substring_index("item", ":", -1))
    side = lambda s: r.where(F.col("store_id") == s).groupBy("test_id").agg(F.collect_set("x").alias("symbols"))
    return validate.merged_coverage(side("even"), side("odd")).select("test_id", F.array_join("symbols", ",").alias("symbols"))


@_query("SELECT k AS target, 'first' AS only FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2) UNION ALL SELECT k, 'second' FROM (SELECT l_partkey AS k FROM lineitem WHERE l_linenumber = 2 EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def q94_collection_difference(t: Tables) -> DataFrame:
    side = lambda keep: t.lineitem.where(keep).select(F.col("l_partkey").alias("target"))
    return validate.collection_difference(side("l_returnflag = 'R'"), side("l_linenumber = 2"), "target")


@_query("""WITH s AS (SELECT c_custkey AS k, c_mktsegment AS cause FROM customer), x AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 150000)
SELECT cause, count(*) AS selected, count(x.k) AS executed, round(count(x.k) / count(*)::DOUBLE, 6) AS precision FROM s LEFT JOIN x USING (k) GROUP BY cause""")
def q95_cause_precision(t: Tables) -> DataFrame:
    causes = t.customer.select(node("c", "c_custkey").alias("node"), F.col("c_mktsegment").alias("cause"))
    return validate.cause_precision(causes, t.orders.where("o_totalprice > 150000").select(node("c", "o_custkey").alias("node")))


@_query(f"WITH {_ARTIFACT_SQL} SELECT min(created_at) AS first, max(created_at) AS last, count(DISTINCT run) AS runs FROM art")
def q96_window(t: Tables) -> DataFrame:
    return rollup.window(_artifacts(t))


@_query(f"""WITH {_ARTIFACT_SQL}, m AS (SELECT count(*) AS n FROM events WHERE event_type = 'error' AND (event_id % 8 = 0 OR event_id % 3 = 0))
SELECT count(*) FILTER (action = 'run') AS runs, count(*) FILTER (action = 'record') AS records, (SELECT n FROM m) AS confirmed, (SELECT n FROM m) = 0 AS ok FROM art""")
def q97_verdict(t: Tables) -> DataFrame:
    e = t.events.where("event_type = 'error'").select(F.col("event_id").alias("run"), F.col("user_id").cast("string").alias("target"), F.when(F.col("event_id") % 8 == 0, "collection").otherwise("test").alias("kind"))
    return rollup.verdict(rollup.cells(_artifacts(t), ["cell"]), rollup.confirmed(e, e.where("run % 3 = 0").select("run", "target")))


@_query(f"WITH {_DECISION_SQL} SELECT count(*) AS targets, count(*) FILTER (selected) AS selected, count(*) FILTER (NOT selected) AS unselected, count(*) FILTER (rules LIKE '%always_run%') AS always_run FROM decision")
def q98_report_counts(t: Tables) -> DataFrame:
    from tidemark.plans.report import decision_counts

    return decision_counts(_decisions(t))


# Names.


@_query(f"""SELECT page_id, regexp_matches(path, '^[^/]*\\.example\\.[^/]*/(.*/)?[0-9][^/]*$') AS numbered, regexp_matches(path, '^[^/]*/[^/]*/[^/]*$') AS three FROM (SELECT page_id, {_PATH_SQL} AS path FROM pages)""")
def q99_glob(t: Tables) -> DataFrame:
    p = _page_path()
    numbered = F.lit(False)
    for d in "0123456789":
        numbered |= p.rlike(N.glob_regex(f"*.example.*/**/{d}*"))
    return t.pages.select("page_id", numbered.alias("numbered"), p.rlike(N.glob_regex("*/*/*")).alias("three"))


@_query("""SELECT doc_id, list_aggregate(list_filter(range(128), lambda i: ((strpos('0123456789abcdef', h[2 * (i // 8) + 1]) - 1) * 16 + strpos('0123456789abcdef', h[2 * (i // 8) + 2]) - 1) // (2 ** (i % 8))::INT % 2 = 1), 'string_agg', ',') AS places FROM (SELECT doc_id, md5(lang || doc_id) AS h FROM documents)""")
def q100_bitmap(t: Tables) -> DataFrame:
    places = N.set_bits(F.unhex(F.md5(F.concat("lang", F.col("doc_id").cast("string")))))
    return t.documents.select("doc_id", F.array_join(places.cast("array<string>"), ",").alias("places"))


@_query("""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g'), '\\|', '\\\\|', 'g') AS cell, CASE WHEN length(text) = 0 THEN '-' ELSE round(100 * turn / length(text)::DOUBLE)::INT || ' %' END AS part FROM conversations WHERE text IS NOT NULL""")
def q101_cells_and_shares(t: Tables) -> DataFrame:
    return t.conversations.where("text IS NOT NULL").select("conv_id", "turn", N.code_span("text").alias("cell"), N.share("turn", F.length("text")).alias("part"))


@_query("SELECT n_nationkey, n_nationkey % 3 = 0 AS dunder, n_nationkey % 3 = 1 AS conftest FROM nation")
def q102_special_names(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.concat(F.lit("pkg."), F.when(k % 3 == 0, F.concat(F.lit("__"), "n_name", F.lit("__"))).when(k % 3 == 1, "conftest").otherwise(F.concat("n_name", F.lit("__"))))
    return t.nation.select("n_nationkey", N.is_dunder(name).alias("dunder"), N.is_conftest(name).alias("conftest"))
