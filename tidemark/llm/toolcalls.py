"""Tool-call linking: calls and results joined by identifier, ordered, validated and written as canonical JSON.

DataFrame operations only.  Calls are hash-joined with their results and with the call they come after.  The
order is topological: a call's position is the most calls that stand one behind the other before it, found by pointer
doubling (each round doubles the reach of every call's pointer, so chains of n take log n rounds) and, where repeated identifiers
stand behind several calls, by levels; a pointer that never ends stands on a cycle.  Arguments are parsed to variants and checked against a schema: known
tool, JSON object, required fields, field types, no other fields.  A variant keeps its fields in order of
name, so writing it gives canonical JSON.  Nothing is gathered by conversation.

Edge cases: calls without identifier are kept, unlinked, with error ``no_id``; a repeated identifier gives
``duplicate_id`` on each of its calls, each of which is placed by the call that it names itself, and what is behind them by the last; of several results the earliest turn counts; results without
call are not returned by ``linked`` but by ``orphans``; a call after an unknown one is a first call with
``unknown_after``; null or broken arguments give ``not_json``; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import picked, remove, staged

#: tool -> field -> (type, required).
SCHEMAS: Mapping[str, Mapping[str, tuple[str, bool]]] = {
    "answer": {"after": ("string", False), "text": ("string", True), "words": ("integer", True)},
    "setup": {"text": ("string", True), "words": ("integer", True)},
}
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",)}


def argument_errors(name: Column, parsed: Column, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] = SCHEMAS) -> Column:
    """Sorted problems of a call's parsed arguments (a variant); empty for a valid call."""
    kind = F.schema_of_variant(parsed)
    known = F.lit(False)
    own: list[Column] = []
    for tool, fields in schemas.items():
        is_tool = name == tool
        known = known | is_tool
        for field, (type_, required) in fields.items():
            value = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
            if required:
                own.append(F.when(is_tool & (value.isNull() | (value == "VOID")), F.lit(f"missing:{field}")))
            fits = value.isin(*_TYPES[type_]) | (value.startswith("DECIMAL") if type_ == "number" else F.lit(False))
            own.append(F.when(is_tool & (value != "VOID") & ~fits, F.lit(f"type:{field}")))
        keys = F.json_object_keys(F.to_json(parsed))
        extra = F.array_except(keys, F.array(*map(F.lit, fields)))
        own.append(F.when(is_tool & (F.size(extra) > 0), F.concat(F.lit("unknown:"), F.array_join(F.array_sort(extra), "+"))))
    checked = F.array_sort(F.array_compact(F.array(F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown_tool")), *own)))
    return F.when(parsed.isNull() | ~kind.startswith("OBJECT"), F.array(F.lit("not_json"))).otherwise(checked)


def _joined(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """A left join in which rows without key are set aside: they may be many, and would meet in one task."""
    there = rows.where(F.col(key).isNotNull()).join(other, key, "left")
    return there.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def positions(calls: DataFrame) -> DataFrame:
    """(call_id, position) of each identifier: the most calls that stand one behind the other before it; null on a cycle or behind one.

    An identifier whose rows name one known call at most is pointed at it, and pointers are doubled until they end: chains of n take
    log n rounds.  Those whose rows name several, which repeated identifiers alone do, end the chains behind them; they are then
    placed level by level, each once all that it stands behind are.
    """
    spark = calls.sparkSession
    ids = calls.where("call_id IS NOT NULL").select("call_id").distinct()
    known = ids.select(F.col("call_id").alias("after"), F.lit(True).alias("there"))
    edges, edges_path = staged(calls.where("call_id IS NOT NULL AND after IS NOT NULL").select("call_id", "after").distinct().join(known, "after", "left_semi"), "edges")
    heads = edges.groupBy("call_id").agg(F.count("*").alias("n"), F.min("after").alias("after"))
    start = ids.join(heads, "call_id", "left").select("call_id", F.when(F.col("n") == 1, F.col("after")).alias("to"), F.when(F.coalesce("n", F.lit(0)) != 1, F.col("call_id")).alias("end"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("position"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("several"))
    now, path = staged(start, "positions")
    live, reach, total = now.where("to IS NOT NULL").count(), 1, now.count()
    several = now.where("several").count()
    while live and reach <= total:
        far = now.select(F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("end").alias("far"), F.col("position").alias("more"))
        new, new_path = staged(_joined(now, far, "to").select("call_id", F.col("next").alias("to"), F.coalesce("end", "far").alias("end"), (F.col("position") + F.coalesce("more", F.lit(0))).alias("position"), "several"), "positions")
        remove(spark, path)
        now, path = new, new_path
        live, reach = now.where("to IS NOT NULL").count(), reach * 2
    if not several:
        return now.select("call_id", F.when(F.col("end").isNotNull(), F.col("position")).alias("position"))
    many = now.where("several").select("call_id")
    ends = now.select(F.col("call_id").alias("after"), "end", (F.col("position") + 1).alias("step"))
    steps, _ = staged(edges.join(many, "call_id", "left_semi").join(ends, "after").join(many.select(F.col("call_id").alias("end"), F.lit(True).alias("waits")), "end", "left").groupBy("call_id", "end", "waits").agg(F.max("step").alias("step")), "steps")
    placed = None
    while True:
        level = steps if placed is None else _joined(steps, placed.select(F.col("call_id").alias("end"), F.col("position").alias("before")), "end")
        before = F.when(F.col("waits"), F.lit(None).cast("long") if placed is None else F.col("before")).otherwise(F.when(F.col("end").isNotNull(), 0))
        ready = level.withColumn("base", before).groupBy("call_id").agg(F.count_if(F.col("base").isNull()).alias("open"), F.max(F.col("base") + F.col("step")).alias("position")).where("open = 0").select("call_id", "position")
        if placed is not None:
            ready = ready.join(placed, "call_id", "left_anti")
        new, _ = staged(ready, "level")
        if new.isEmpty():
            break
        placed = new if placed is None else placed.unionByName(new)
    behind = now.join(many.select(F.col("call_id").alias("end"), F.lit(True).alias("waits")), "end", "left")
    if placed is None:
        return behind.select("call_id", F.when(F.col("end").isNotNull() & F.col("waits").isNull(), F.col("position")).alias("position"))
    base = placed.select(F.col("call_id").alias("end"), F.col("position").alias("before"))
    return _joined(behind, base, "end").select("call_id", F.when(F.col("waits"), F.col("before") + F.col("position")).when(F.col("end").isNotNull(), F.col("position")).alias("position"))


def linked(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """One row per call: conv_id, call_id, position, name, result_turn, linked, errors, canonical.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (an identifier or null).
    ``results``: call_id, turn, content.
    """
    one = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("turn", "content")).alias("r")).select("call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), F.lit(True).alias("has"))
    order = positions(calls)
    again = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.count("*").alias("copies"))
    there = order.select(F.col("call_id").alias("after"), F.lit(True).alias("after_there"), (F.col("position") + 1).alias("behind"))
    rows = calls.select("conv_id", "call_id", "turn", "name", "arguments", "after")
    rows = _joined(_joined(rows, order.join(again, "call_id").hint("shuffle_hash").join(one, "call_id", "left"), "call_id"), there, "after")
    # A row stands behind the call that it names itself; a lone one where its identifier does.
    own = F.when(F.col("copies") > 1, F.when(F.col("after_there"), F.col("behind")).otherwise(0)).otherwise(F.col("position")).cast("long")
    rows = rows.withColumn("position", F.when(F.col("call_id").isNotNull(), own))
    parsed = rows.withColumn("parsed", F.try_parse_json("arguments"))
    notes = F.array_compact(F.array(F.when(F.col("call_id").isNull(), F.lit("no_id")), F.when(F.col("copies") > 1, F.lit("duplicate_id")), F.when(F.col("after").isNotNull() & F.col("after_there").isNull(), F.lit("unknown_after")), F.when(F.col("call_id").isNotNull() & F.col("position").isNull(), F.lit("cycle"))))
    out = parsed.withColumn("errors", F.array_join(F.array_sort(F.concat(argument_errors(F.col("name"), F.col("parsed"), schemas), notes)), ","))
    # Members in order of name.
    canonical = F.to_json(F.struct(F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"), F.col("position").alias("position"), F.col("content").alias("result")))
    return out.select("conv_id", "call_id", "position", "name", "result_turn", F.coalesce("has", F.lit(False)).alias("linked"), "errors", canonical.alias("canonical"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that no call asks for."""
    return results.join(calls.select("call_id").where("call_id IS NOT NULL"), "call_id", "left_anti")


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's or system's turn asks, the assistant's next turn answers.

    A call's identifier is conv_id:turn; a user's call comes after that of two turns before.
    """
    read = picked(turns, conv_id="long", turn="long", role="string", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    asked = read.where("role IN ('user', 'system')")
    after = F.when((F.col("role") == "user") & (F.col("turn") >= 2), name(F.col("turn") - 2))
    words = F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(0)))
    calls = asked.select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.when(F.col("role") == "user", "answer").otherwise("setup").alias("name"), F.to_json(F.struct(after.alias("after"), "text", words.alias("words"))).alias("arguments"), after.alias("after"))
    results = read.where("role = 'assistant'").select(name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
