"""The last part of the catalogue: state behind arguments, labelled paths, lookup orders, process trees and commit graphs, sets of literals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.extract import flows
from tidemark.operators import classes, evidence, literals, paths, ranges
from tidemark.plans import proxies as X
from tidemark.plans.catalog import _query
from tidemark.plans.catalog_rules import ORACLES, QUERIES
from tidemark.plans.proxies import Tables, node

__all__ = ["ORACLES", "QUERIES"]


@_query("""WITH f AS (SELECT DISTINCT 'c:' || o_custkey AS variable, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT DISTINCT variable, 's:' || l_suppkey AS writer FROM f JOIN lineitem ON l_partkey = p WHERE l_returnflag = 'R' AND l_linenumber = 1""")
def q104_state_writers(t: Tables) -> DataFrame:
    """Customers are state that orders hand to parts; suppliers write parts in place."""
    handed = X.references(t, suppliers=False).select("source", "target")
    writes = t.lineitem.where("l_returnflag = 'R' AND l_linenumber = 1").select(node("p", "l_partkey").alias("node"), node("s", "l_suppkey").alias("owner")).distinct()
    return flows.state_writers(handed, writes, t.customer.select(node("c", "c_custkey").alias("node")))


@_query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber = 6 THEN 'f::a,f::b,f::c' WHEN l_linenumber = 5 THEN 'f::b' WHEN l_linenumber = 4 THEN 'f::c'
 ELSE 'f::' || ['a', 'b', 'c'][least(l_linenumber + l_orderkey % 2, 3)] END AS given FROM lineitem""")
def q105_argument_positions(t: Tables) -> DataFrame:
    """The parameters that a call's arguments reach: places, a known and an unknown keyword, starred ones, a receiver of a plain function."""
    n = F.col("l_linenumber")
    part = F.when(n == 7, "@").when(n == 6, "*").when(n == 5, "k:b").when(n == 4, "k:z").otherwise((n - 1).cast("string"))
    offset = F.when(n == 7, 0).otherwise(F.col("l_orderkey") % 2).cast("int")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", part.alias("part"), offset.alias("off"))
    given = flows.given_to(F.lit("f"), F.array(*map(F.lit, "abc")), F.col("part"), F.col("off"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(given, ",").alias("given"))


_STORED_SQL = """calls AS (SELECT DISTINCT 'o:' || l_orderkey AS source, 'p:' || l_partkey AS target FROM lineitem WHERE l_linenumber <= 2 UNION SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0),
writes AS (SELECT DISTINCT 'o:' || l_orderkey AS source, 's:' || l_suppkey AS target FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 = 0),
reads AS (SELECT DISTINCT 'c:' || o_custkey AS source, 'o:' || o_orderkey AS target FROM orders WHERE o_orderkey % 2 = 1 UNION SELECT 'o:' || l_orderkey, 's:' || l_suppkey FROM lineitem WHERE l_linenumber = 2 AND l_suppkey % 5 = 0),
r AS (SELECT 'p:' || p_partkey AS node, 'changed' AS state FROM part WHERE p_partkey % 40 = 3
 UNION SELECT CASE WHEN k = 'w' THEN e.target ELSE e.source END, CASE WHEN k = 'w' THEN 'held' ELSE 'changed' END FROM r JOIN (SELECT *, 'c' AS k FROM calls UNION ALL SELECT *, 'w' FROM writes UNION ALL SELECT *, 'r' FROM reads) e
 ON (k = 'c' AND state = 'changed' AND e.target = r.node) OR (k = 'w' AND state = 'changed' AND e.source = r.node) OR (k = 'r' AND state = 'held' AND e.target = r.node))"""


def _stored(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders call parts, write and read suppliers; customers call even orders and read odd ones, which tells them nothing."""
    pair = lambda df, a, x, b, y: df.select(node(a, x).alias("source"), node(b, y).alias("target"))
    first = t.part.where("p_partkey % 40 = 3").select(node("p", "p_partkey").alias("symbol"))
    calls = pair(t.lineitem.where("l_linenumber <= 2"), "o", "l_orderkey", "p", "l_partkey").unionByName(pair(t.orders.where("o_orderkey % 2 = 0"), "c", "o_custkey", "o", "o_orderkey")).distinct()
    writes = pair(t.lineitem.where("l_linenumber = 1 AND l_orderkey % 3 = 0"), "o", "l_orderkey", "s", "l_suppkey").distinct()
    reads = pair(t.orders.where("o_orderkey % 2 = 1"), "c", "o_custkey", "o", "o_orderkey").unionByName(pair(t.lineitem.where("l_linenumber = 2 AND l_suppkey % 5 = 0"), "o", "l_orderkey", "s", "l_suppkey")).distinct()
    return first, calls, writes, reads


@_query(f"WITH RECURSIVE {_STORED_SQL} SELECT node, state FROM r")
def q90_stored_results(t: Tables) -> DataFrame:
    return paths.stored_results(*_stored(t))


@_query(f"WITH RECURSIVE {_STORED_SQL} SELECT DISTINCT w.source AS writer, w.target AS variable, d.source AS reader FROM r JOIN writes w ON w.source = r.node AND state = 'changed' JOIN reads d ON d.target = w.target")
def q106_written_state(t: Tables) -> DataFrame:
    return paths.written_state(*_stored(t))


@_query("""WITH d AS (SELECT 'c:' || c_custkey AS cls, c_custkey, 'n:' || c_nationkey AS nation, c_nationkey, 'r:' || n_regionkey AS region, n_regionkey, 'm:' || c_mktsegment AS segment, length(c_mktsegment) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey),
n AS (SELECT unnest(['a', 'b', 'd']) AS name)
SELECT * FROM (SELECT cls, name, CASE name WHEN 'a' THEN CASE WHEN c_custkey % 2 = 0 THEN cls WHEN c_nationkey % 2 = 0 THEN nation ELSE region END
 WHEN 'b' THEN CASE WHEN c_nationkey % 3 = 0 THEN nation WHEN n_regionkey % 2 = 1 THEN region WHEN k % 2 = 0 THEN segment ELSE 'x:base' END
 ELSE CASE WHEN k % 2 = 1 THEN segment ELSE 'x:base' END END || '.' || name AS id FROM d, n)""")
def q107_found_first(t: Tables) -> DataFrame:
    """Customers inherit from nation and market segment, nations from regions, regions and segments from one base: a diamond."""
    nations = t.nation.select(node("n", "n_nationkey").alias("cls"), node("r", "n_regionkey").alias("base"), F.lit(0).alias("place"))
    own = t.customer.select(node("c", "c_custkey").alias("cls"), F.explode(F.array(F.struct(node("n", "c_nationkey").alias("base"), F.lit(0).alias("place")), F.struct(node("m", "c_mktsegment").alias("base"), F.lit(1).alias("place")))).alias("b")).select("cls", "b.base", "b.place")
    tops = t.region.select(node("r", "r_regionkey").alias("cls")).unionByName(t.customer.select(node("m", "c_mktsegment").alias("cls")).distinct()).select("cls", F.lit("x:base").alias("base"), F.lit(0).alias("place"))
    bases = own.unionByName(nations).unionByName(tops)
    ids = bases.select("cls").unionByName(bases.select(F.col("base").alias("cls"))).distinct()
    row = lambda df, cls, name: df.select(cls.alias("container"), F.lit(name).alias("name"))
    k = F.length("c_mktsegment") % 2
    members = row(t.customer.where("c_custkey % 2 = 0"), node("c", "c_custkey"), "a").unionByName(row(t.nation.where("n_nationkey % 2 = 0"), node("n", "n_nationkey"), "a")).unionByName(row(t.region, node("r", "r_regionkey"), "a"))
    members = members.unionByName(row(t.nation.where("n_nationkey % 3 = 0"), node("n", "n_nationkey"), "b")).unionByName(row(t.region.where("r_regionkey % 2 = 1"), node("r", "r_regionkey"), "b"))
    members = members.unionByName(row(t.customer.where(k == 0), node("m", "c_mktsegment"), "b").distinct()).unionByName(row(t.customer.where(k == 1), node("m", "c_mktsegment"), "d").distinct())
    members = members.unionByName(row(t.region.limit(1), F.lit("x:base"), "b")).unionByName(row(t.region.limit(1), F.lit("x:base"), "d"))
    found = classes.found_first(classes.linearised(bases, ids), members.withColumn("id", F.concat_ws(".", "container", "name")))
    return found.where("cls LIKE 'c:%'").select("cls", "name", "id")


@_query("""WITH RECURSIVE r AS (SELECT p_partkey AS commit, p_partkey AS store, 0 AS d FROM part WHERE p_partkey % 23 = 4
 UNION SELECT c.p_partkey, r.store, r.d + 1 FROM r JOIN part c ON (r.commit = c.p_partkey - 1 OR (c.p_partkey % 7 = 0 AND r.commit = c.p_partkey - 5)) WHERE r.d < 30),
b AS (SELECT commit, min(d) AS distance FROM r GROUP BY commit)
SELECT p_partkey AS commit, 's' || arg_max(r.store, (r.store % 11) * 1000000 + r.store) AS store_id, any_value(b.distance)::BIGINT AS distance FROM part LEFT JOIN b ON b.commit = p_partkey LEFT JOIN r ON r.commit = b.commit AND r.d = b.distance GROUP BY p_partkey""")
def q108_nearest_ancestor(t: Tables) -> DataFrame:
    """Parts are commits in a line, each seventh merges what stood five before it; some have stores."""
    k = F.col("p_partkey")
    parents = t.part.select(k.alias("commit"), F.explode(F.when(k % 7 == 0, F.array(k - 1, k - 5)).otherwise(F.array(k - 1))).alias("parent")).where("parent > 0")
    marks = t.part.where("p_partkey % 23 = 4").select(k.alias("commit"), F.concat(F.lit("s"), F.lpad(k.cast("string"), 12, "0")).alias("store_id"), (k % 11).alias("created"))
    got = ranges.nearest_ancestor(parents, marks, t.part.select(k.alias("commit")))
    return got.select("commit", F.regexp_replace("store_id", "^s0*", "s").alias("store_id"), "distance")


@_query("""WITH e AS (SELECT event_id, user_id, event_type, hour(ts) BETWEEN 6 AND 17 AS inside, strftime(ts, '%Y-%m-%d') AS day, json_extract_string(props, '$.k') AS k FROM events),
w AS (SELECT event_id, event_type, user_id || '/' || day AS test, inside, k, user_id FROM e),
p AS (SELECT event_id, CASE WHEN inside THEN test END AS test, k FROM w WHERE event_type = 'purchase'),
c AS (SELECT x.event_id, p.test, x.k FROM w x JOIN p ON p.event_id = x.event_id - 1 WHERE x.event_type = 'error')
SELECT DISTINCT test AS test_id, k AS item FROM (SELECT test, k FROM p UNION ALL SELECT test, k FROM c UNION ALL SELECT test, k FROM w WHERE inside AND event_type NOT IN ('purchase', 'error')) WHERE test IS NOT NULL""")
def q109_process_windows(t: Tables) -> DataFrame:
    """Users are processes with a window a day, from 6 to 18; a purchase is a child, and an error right behind one is its child, which
    runs for what the purchase does whenever it runs; other events run in the user's process."""
    at = F.unix_timestamp("ts").cast("long")
    e = t.events.select("event_id", "event_type", F.col("user_id").cast("string").alias("u"), at.alias("at"), F.get_json_object("props", "$.k").alias("item"), F.to_date("ts").alias("day"))
    windows = e.select("u", "day").distinct().select(F.col("u").alias("pid"), F.concat_ws("/", "u", F.col("day").cast("string")).alias("test_id"), (F.unix_timestamp(F.col("day").cast("timestamp")) + 6 * 3600).alias("start"), (F.unix_timestamp(F.col("day").cast("timestamp")) + 18 * 3600 - 1).alias("stop"))
    own = F.concat(F.lit("p"), F.col("event_id").cast("string"))
    before = e.where("event_type = 'purchase'").select((F.col("event_id") + 1).alias("event_id"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("above"))
    errors = e.where("event_type = 'error'").join(before, "event_id", "left")
    processes = e.select(F.col("u").alias("pid")).distinct().select("pid", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("started"))
    processes = processes.unionByName(e.where("event_type = 'purchase'").select(own.alias("pid"), F.col("u").alias("parent"), F.col("at").alias("started"))).unionByName(errors.select(own.alias("pid"), F.col("above").alias("parent"), F.col("at").alias("started")))
    pid = F.when(F.col("event_type").isin("purchase", "error"), own).otherwise(F.col("u"))
    return ranges.window_items(e.select(pid.alias("pid"), "at", "item"), processes, windows)


@_query("""WITH first AS (SELECT 'o:' || o_orderkey AS node, CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE left(o_orderpriority, 1) END AS v FROM orders WHERE o_orderkey % 50 <> 8),
e AS (SELECT DISTINCT 'o:' || l_orderkey AS source, 'p:' || l_partkey AS target, CASE WHEN l_linenumber = 1 THEN l_returnflag || l_linestatus || '_' ELSE '' END AS before, '' AS after FROM lineitem
 UNION SELECT 'p:' || l_partkey, 's:' || l_suppkey, '', CASE WHEN l_returnflag = 'R' THEN '_r' ELSE '' END FROM lineitem WHERE l_linenumber = 2 AND l_quantity < 20),
p AS (SELECT DISTINCT target AS node, before || v || after AS v FROM first JOIN e ON source = node), s AS (SELECT DISTINCT target AS node, before || v || after AS v FROM p JOIN e ON source = node),
every AS (SELECT * FROM first UNION SELECT * FROM p UNION SELECT * FROM s)
SELECT node, CASE WHEN bool_or(v IS NULL) OR count(*) > 12 THEN '*' ELSE string_agg(v, ',' ORDER BY v) END AS texts FROM every GROUP BY node""")
def q110_literal_sets(t: Tables) -> DataFrame:
    """Priorities are texts that orders hand to parts and parts to suppliers, some with flags in front or a flag behind; some orders hold any."""
    k = F.col("o_orderkey") % 50
    first = t.orders.where(k != 8).select(node("o", "o_orderkey").alias("node"), F.substring("o_orderpriority", 1, 1).alias("value"), (k == 7).alias("any"))
    n = F.col("l_linenumber")
    down = t.lineitem.select(node("o", "l_orderkey").alias("source"), node("p", "l_partkey").alias("target"), F.when(n == 1, F.concat("l_returnflag", "l_linestatus", F.lit("_"))).alias("before"), F.lit("").alias("after"))
    on = t.lineitem.where("l_linenumber = 2 AND l_quantity < 20").select(node("p", "l_partkey").alias("source"), node("s", "l_suppkey").alias("target"), F.lit("").alias("before"), F.when(F.col("l_returnflag") == "R", "_r").otherwise("").alias("after"))
    sets = literals.literal_sets(down.unionByName(on), first, most=12)
    return sets.groupBy("node").agg(F.when(F.bool_or("any"), "*").otherwise(F.array_join(F.array_sort(F.collect_set("value")), ",")).alias("texts"))


@_query("""WITH s AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS test_id, list_sort(list(DISTINCT event_type)) AS items FROM events GROUP BY 1)
SELECT test_id, min(test_id) OVER (PARTITION BY items) AS first, len(items) AS n FROM s""")
def q111_interned_sets(t: Tables) -> DataFrame:
    """The kinds of events of each user and day: days of equal sets share one."""
    rows = t.events.select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("test_id"), "event_type")
    members, sets = evidence.interned(rows, "test_id", "event_type")
    first = members.groupBy("set_id").agg(F.min("test_id").alias("first"))
    return members.join(first, "set_id").join(sets.groupBy("set_id").agg(F.count("*").alias("n")), "set_id").select("test_id", "first", "n")
