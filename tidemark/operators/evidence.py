"""Recorded execution: folding, stores, observers and decisions.

Relations: ``records(store_id, test_id, flags)``, ``exec(store_id, test_id, symbol)``,
``touched(store_id, test_id, path)``, ``listed(store_id, test_id, dir)``, ``phases(store_id, phase, item, module)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import ancestors, folded_test, prefixes
from tidemark.operators import fixpoint
from tidemark.schema import FAILED, SUBPROCESS, TEXT, UNSTABLE
from tidemark.tables import dropped, written

CELL = 64
#: Places in a cell of as-of joins.
ASOF = 512


def innermost(points: DataFrame, spans: DataFrame, key: str = "path") -> DataFrame:
    """The narrowest span (key, symbol, start, end) around each point (key, line, ...), and null where none is.

    A range join by cells: spans are dealt to the cells of ``CELL`` lines they cover, a point to its own.
    """
    cells = spans.select(key, "symbol", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor(F.col("end") / CELL))).alias("cell"))
    ids = points.select(key, "line").distinct().withColumn("cell", F.floor(F.col("line") / CELL))
    best = ids.join(cells, [key, "cell"]).where("line BETWEEN start AND end").groupBy(key, "line").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("w"), F.col("start").alias("s"), F.col("symbol").alias("symbol"))).alias("b"))
    return points.join(best.select(key, "line", F.col("b.symbol").alias("symbol")), [key, "line"], "left")


def canonical_paths(paths: DataFrame, known: DataFrame) -> DataFrame:
    """Paths with the spelling of the longest known prefix that is equal but for case."""
    names = known.select(F.lower("path").alias("low"), F.col("path").alias("spelled")).groupBy("low").agg(F.min("spelled").alias("spelled"))
    parts = paths.select("path", F.explode(prefixes("path", "/")).alias("prefix")).withColumn("low", F.lower("prefix")).join(names, "low")
    best = parts.groupBy("path").agg(F.max_by("spelled", F.length("prefix")).alias("spelled"))
    out = paths.join(best, "path", "left")
    return out.withColumn("canonical", F.when(F.col("spelled").isNull(), F.col("path")).otherwise(F.concat("spelled", F.substring(F.col("path"), F.length("spelled") + 1, F.length("path"))))).drop("spelled")


def folded(windows: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exec-like rows without parameter cases, records with merged flags).

    ``windows``: store_id, test_id, kind, item; ``flags``: store_id, test_id, flags.
    """
    rows = windows.select("store_id", folded_test("test_id").alias("test_id"), "kind", "item").distinct()
    records = flags.select("store_id", folded_test("test_id").alias("test_id"), "flags").groupBy("store_id", "test_id").agg(F.bit_or("flags").alias("flags"))
    return rows, records


def complete(cases: DataFrame) -> DataFrame:
    """Tests (store_id, test_id) whose collected cases are just those that ran, by number and hash sum over processes."""
    sums = [F.sum(c).alias(c) for c in ("n_collected", "h_collected", "n_ran", "h_ran")]
    return cases.groupBy("store_id", folded_test("test_id").alias("test_id")).agg(*sums).where("n_collected = n_ran AND h_collected = h_ran").select("store_id", "test_id")


def unstable(first: DataFrame, second: DataFrame) -> DataFrame:
    """Tests of both recordings whose sets of items differ: rows of one only, anti-joined both ways."""
    key = ["test_id", "item"]
    a, b = first.select(*key).distinct(), second.select(*key).distinct()
    common = a.select("test_id").distinct().join(b.select("test_id").distinct(), "test_id", "left_semi")
    differ = a.join(b, key, "left_anti").unionByName(b.join(a, key, "left_anti")).select("test_id").distinct()
    return common.join(differ, "test_id", "left_semi")


#: Ranges that values are numbered in; what stands before one is summed over as many rows.
NUMBERED = 1024


def numbered_by(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Distinct rows with a number from 0 on: in place within a hash range, and after all ranges before it."""
    dealt = rows.withColumn("range", F.pmod(F.xxhash64(*key), F.lit(NUMBERED)))
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    first = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(*key)))
    return placed.join(F.broadcast(first), "range").select(*rows.columns, (F.col("first") + F.col("place") - 1).alias(name))  # at most NUMBERED rows


def encoded(items: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary of id and value, rows with the id in place of the value): ids count from 0, and no two values share one."""
    ids = numbered_by(items.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct(), ["value"], "id")
    return ids, items.join(ids.select(F.col("value").alias(column), F.col("id").alias(f"{column}_id")), column, "left").drop(column)


def interned(rows: DataFrame, key: str, item: str) -> tuple[DataFrame, DataFrame]:
    """Members (key, set_id) and sets (set_id, item): keys of equal sets of items share one set, which is kept once.

    A set is known by its size and two 64-bit hashes of its items, summed without order, so no set is ever gathered.  Rows without a key or
    an item are left out, repeated ones count once.
    """
    own = rows.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(key, item).distinct()
    mixed = lambda n: F.hex(F.bit_xor(F.xxhash64(F.lit(n), item)))
    members = own.groupBy(key).agg(F.concat_ws(".", F.count("*").cast("string"), mixed(1), mixed(2)).alias("set_id"))
    first = members.groupBy("set_id").agg(F.min(key).alias(key))
    return members, own.join(first, key).select("set_id", item)


def advanced(old_rows: DataFrame, old_records: DataFrame, new_rows: DataFrame, new_records: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A store brought forward: rerun tests are replaced, others carried, dead ones dropped.

    A rerun test keeps its old ``unstable`` flag: one quiet run is no proof.
    """
    rerun = new_records.select("test_id")
    rows = old_rows.join(rerun, "test_id", "left_anti").unionByName(new_rows.select(*old_rows.columns)).join(live, "test_id", "left_semi")
    old = old_records.select("test_id", F.col("flags").alias("old"))
    again = new_records.join(old, "test_id", "left").select("test_id", F.col("flags").bitwiseOR(F.coalesce("old", F.lit(0)).bitwiseAND(F.lit(UNSTABLE))).alias("flags"))
    records = old_records.select("test_id", "flags").join(rerun, "test_id", "left_anti").unionByName(again).join(live, "test_id", "left_semi")
    return rows, records


def process_wide(phases: DataFrame) -> DataFrame:
    return phases.select("phase", "item", "module").distinct()


def environment_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, before, after of settings (key, value) that differ."""
    both = a.select("key", F.col("value").alias("before")).join(b.select("key", F.col("value").alias("after")), "key", "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def nearest_store(commits: DataFrame, stores: DataFrame) -> DataFrame:
    """For each commit (commit, place) the store (store_id, place, created) nearest at or before it; the newest, then greatest id.

    An as-of join by cells of ``ASOF`` places: windows run within cells, and what stands before a cell is
    carried from one row per cell.
    """
    s = stores.select("store_id", F.col("place").alias("at"), "created")
    pairs = commits.withColumn("kind", F.lit(1)).select("commit", "place", "kind", F.lit(None).cast("string").alias("store_id"), F.lit(None).cast("double").alias("created"))
    marks = s.groupBy("at").agg(F.max(F.struct("created", F.col("store_id"))).alias("m")).select(F.lit(None).cast("string").alias("commit"), F.col("at").alias("place"), F.lit(0).alias("kind"), F.col("m.store_id").alias("store_id"), F.col("m.created").alias("created"))
    rows = pairs.unionByName(marks).withColumn("cell", F.floor(F.col("place") / ASOF))
    inside = Window.partitionBy("cell").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.groupBy("cell").agg(F.max_by("store_id", F.when(F.col("kind") == 0, F.col("place"))).alias("last"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("cell", F.last("last", ignorenulls=True).over(before).alias("carried"))
    found = rows.withColumn("nearest", F.last("store_id", ignorenulls=True).over(inside)).where("kind = 1").join(carried, "cell")
    return found.select("commit", F.coalesce("nearest", "carried").alias("store_id"))


#: Rows of a side that a task joins at one place at most, about.
PLACE_ROWS = 2_000


def touched_ancestors(touched: DataFrame, changed: DataFrame) -> DataFrame:
    """(test_id, path): tests that opened a changed path or listed a directory above it.

    Of places that a test touched above one another only the outermost counts, so no pair is made twice and the pairs, which
    grow with the product of both sides at a place, are neither shuffled nor gathered.  Places with many rows are dealt into cells.
    """
    own = written(touched.select("test_id", F.col("path").alias("at")).distinct(), "touched")
    above = own.select(F.col("test_id").alias("t"), F.col("at").alias("u"))
    inner = own.withColumn("up", F.explode(ancestors("at"))).join(above, F.col("test_id").eqNullSafe(F.col("t")) & (F.col("up") == F.col("u")), "left_semi").select(F.col("test_id").alias("t"), F.col("at").alias("u")).distinct()
    tops = written(own.join(inner, F.col("test_id").eqNullSafe(F.col("t")) & (F.col("at") == F.col("u")), "left_anti"), "tops")
    up = written(changed.select("path").distinct().select("path", F.explode(F.array_append(ancestors("path"), F.col("path"))).alias("at")), "up")
    dropped(own)
    count = tops.select("at", F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(up.select("at", F.lit(0).alias("n"), F.lit(1).alias("m")))
    cells = lambda c: F.greatest(F.ceil(F.sum(c) / PLACE_ROWS).cast("int"), F.lit(1))
    large = F.broadcast(count.groupBy("at").agg(cells("n").alias("ns"), cells("m").alias("ms")).where("ns > 1 OR ms > 1"))  # at most two rows for each PLACE_ROWS

    def dealt(side: DataFrame, key: str, mine: str, other: str) -> DataFrame:
        rows = side.join(large, "at", "left").withColumn(mine, F.pmod(F.xxhash64(key), F.coalesce(F.col(mine), F.lit(1))).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))

    return dealt(tops, "test_id", "ns", "ms").join(dealt(up, "path", "ms", "ns"), ["at", "ns", "ms"]).select("test_id", "path")


def readers(symbols: DataFrame, edges: DataFrame, matches: DataFrame) -> DataFrame:
    """(symbol, reader): one hop of references and name matches to a symbol, sites that only write it left out."""
    use = edges.where("kind = 'references' AND coalesce(detail, '') NOT IN ('writes', 'rebinds', 'mutated_by')").select(F.col("target").alias("symbol"), F.col("source").alias("reader"))
    return use.unionByName(matches.select("symbol", "reader")).join(symbols.select("symbol"), "symbol", "left_semi").distinct()


def guarded(exec_: DataFrame, guards: DataFrame) -> DataFrame:
    """(test_id, reader): tests that ran a reader and at least one of its guards (reader, guard)."""
    ran = exec_.select("test_id", F.col("symbol").alias("reader")).join(guards.select("reader").distinct(), "reader", "left_semi").distinct()
    held = exec_.select("test_id", F.col("symbol").alias("guard")).join(guards, "guard").select("test_id", "reader").distinct()
    return ran.join(held, ["test_id", "reader"], "left_semi")


def observers(changes: DataFrame, read: DataFrame) -> DataFrame:
    """(symbol, rule) of the symbols whose execution notices a change: the changed ones, and readers of changed definitions."""
    own = changes.where("carries_impact AND NOT array_contains(changes, 'deleted')").select(F.col("id").alias("symbol"), F.lit("executed_changed").alias("rule"))
    hard = changes.where("structural OR kind IN ('variable', 'class')").select(F.col("id").alias("symbol"))
    return own.unionByName(read.join(hard, "symbol", "left_semi").select(F.col("reader").alias("symbol"), F.lit("executed_reader").alias("rule"))).distinct()


def hierarchy(bases: DataFrame, classes: DataFrame) -> DataFrame:
    """(origin, node): each class with all above and below it."""
    down = bases.select(F.col("base").alias("source"), F.col("cls").alias("target"))
    up = bases.select(F.col("cls").alias("source"), F.col("base").alias("target"))
    ids = classes.select(F.col("id").alias("node"))
    return fixpoint.closure(up, ids).unionByName(fixpoint.closure(down, ids)).distinct()


def escalated(changes: DataFrame, phases: DataFrame) -> DataFrame:
    """Changes (id) that ran in an import, collection or hook phase, with the phase: these need a static plan."""
    return changes.where("carries_impact").select("id").join(phases.select(F.col("item").alias("id"), "phase", "module"), "id").distinct()


def decided(targets: DataFrame, records: DataFrame, exec_: DataFrame, observing: DataFrame, touched: DataFrame, changed_targets: DataFrame, more: DataFrame) -> DataFrame:
    """(test_id, rule, detail): all reasons of each target (test_id), by one pass over each relation.

    ``observing``: symbol, rule; ``touched``: test_id, path; ``changed_targets``: test_id; ``more``: test_id, rule, detail.
    """
    known = targets.select("test_id").distinct()
    rec = known.join(records.select("test_id", "flags"), "test_id", "left")
    bit = lambda b: F.col("flags").bitwiseAND(F.lit(b)) != 0
    notes = F.array_compact(F.array(
        F.when(F.col("flags").isNull() | bit(FAILED), F.lit("no_evidence")), F.when(bit(UNSTABLE), F.lit("unstable")), F.when(bit(SUBPROCESS), F.lit("subprocess")), F.when(bit(TEXT), F.lit("text_code"))
    ))
    flagged = rec.select("test_id", F.explode(notes).alias("rule"), F.lit("").alias("detail"))
    hits = exec_.select("test_id", "symbol").join(observing, "symbol").join(known, "test_id", "left_semi").groupBy("test_id", "rule").agg(F.min("symbol").alias("detail"))
    files = touched.join(known, "test_id", "left_semi").groupBy("test_id").agg(F.min("path").alias("detail")).select("test_id", F.lit("touched_file").alias("rule"), "detail")
    own = changed_targets.join(known, "test_id", "left_semi").select("test_id", F.lit("changed_target").alias("rule"), F.lit("").alias("detail"))
    return flagged.unionByName(hits).unionByName(files).unionByName(own).unionByName(more.join(known, "test_id", "left_semi").select("test_id", "rule", "detail")).distinct()


def two_sided(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reasons from the recording to either version, each once."""
    return first.unionByName(second).dropDuplicates(["test_id", "rule", "detail"])


def settled(collected: DataFrame, targets: DataFrame) -> DataFrame:
    """(test_id, side): tests only collected, and targets never collected."""
    a, b = collected.select("test_id").distinct(), targets.select("test_id").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("collected")).unionByName(b.exceptAll(a).withColumn("side", F.lit("discovered")))


def owned_environment(executable: Column, root: str) -> Column:
    """Whether an interpreter lies under the checkout, which then shadows what was recorded."""
    return executable.startswith(root.rstrip("/") + "/")
