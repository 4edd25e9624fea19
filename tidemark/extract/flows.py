"""State that is written behind parameters, aliases and results: a graph of values, and what reaches a place that is written.

``flows`` (source, target) say that the target may be, or hold, what the source names.  Nodes are variables, ``f::x`` for a local or parameter x of
f, ``f::return`` for what it gives, and ``method:name::part`` for calls of a method on an unknown value, which meet all methods of that
name in one node, so edges grow with the sum and not the product of call sites and methods.  A variable that reaches a node which
some symbol writes in place is written by that symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fixpoint import closure
from tidemark.tables import written


def state_writers(flows: DataFrame, writes: DataFrame, states: DataFrame) -> DataFrame:
    """(variable, writer): the states (node) that reach a place which ``writes`` (node, owner) says is written in place.

    Only what leads to a written place is searched from the states.
    """
    back = closure(flows.select(F.col("target").alias("source"), F.col("source").alias("target")), writes.select("node").distinct())
    own = states.select("node").distinct()
    met = back.join(own, "node", "left_semi").select(F.col("origin").alias("place"), F.col("node").alias("variable"))
    return met.join(writes.select(F.col("node").alias("place"), F.col("owner").alias("writer")), "place").select("variable", "writer").distinct()


def given_to(callee: Column, params: Column, part: Column, offset: Column) -> Column:
    """The parameter nodes of a callee that a part of a call reaches; ``offset`` is 1 where the receiver is given first.

    More arguments than parameters reach the last one, as do unknown keywords; starred ones reach all.
    """
    size = F.size(params)
    at = F.when(part == "@", F.lit(1)).otherwise(F.least(F.try_to_number(part, F.lit("999999")).cast("int") + offset + 1, size))
    one = F.when(part.startswith("k:"), F.coalesce(F.try_element_at(F.filter(params, lambda p: p == F.substring(part, 3, 1000)), F.lit(1)), F.try_element_at(params, F.lit(-1)))).otherwise(F.try_element_at(params, at))
    names = F.when(size == 0, F.array().cast("array<string>")).when(part == "*", params).when((part == "@") & (offset == 0), F.array().cast("array<string>")).otherwise(F.array(one))
    return F.transform(names, lambda p: F.concat(callee, F.lit("::"), p))


def resolved_places(places: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(place columns, node) of places (owner, how, chain, part); ``resolved`` has owner, chain, found, rest.

    What is no state and no known function has no node.
    """
    key = ["owner", "how", "chain", "part"]
    done = places.where("how = 'node'").select(*key, F.col("chain").alias("node"))
    hub = lambda name, part: F.concat(F.lit("method:"), name, F.lit("::"), part)
    # A method's receiver is its argument 0 there, so the others move by one.
    moved = F.when(F.col("part") == "@", "0").when(F.col("part").rlike("^[0-9]+$"), (F.try_to_number("part", F.lit("999999")) + 1).cast("int").cast("string")).otherwise(F.col("part"))
    method = places.where("how = 'method' AND part <> ''").select(*key, hub(F.col("chain"), moved).alias("node"))
    own = symbols.select(F.col("id").alias("found"), "kind", "params", F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: d == "staticmethod").alias("static"))
    asked = places.where("how IN ('name', 'absolute', 'self')").join(resolved, ["owner", "chain"]).join(own, "found")
    last = F.substring_index("chain", ".", -1)
    value = asked.where("part = '' AND kind = 'variable'").select(*key, F.col("found").alias("node"))
    call = asked.where("part <> ''")
    exact = call.where("rest = '' AND kind IN ('function', 'method')")
    offset = F.when((F.col("how") == "self") & ~F.col("static"), 1).otherwise(0)
    nodes = F.when(F.col("part") == "return", F.array(F.concat("found", F.lit("::return")))).otherwise(given_to(F.col("found"), F.coalesce("params", F.array().cast("array<string>")), F.col("part"), offset))
    direct = exact.select(*key, F.explode(nodes).alias("node"))
    made = call.where("rest = '' AND kind = 'class' AND part NOT IN ('return', '@')").select(*key, F.concat("found", F.lit(".__init__")).alias("found"))
    made = made.join(own.select("found", "params"), "found").select(*key, F.explode(given_to(F.col("found"), F.col("params"), F.col("part"), F.lit(1))).alias("node"))
    unknown = call.where("rest <> '' AND kind IN ('variable', 'class')").select(*key, hub(last, moved).alias("node"))
    return done.unionByName(method).unionByName(value).unionByName(direct).unionByName(made).unionByName(unknown).distinct()


def method_flows(places: DataFrame, symbols: DataFrame, overrides: DataFrame) -> DataFrame:
    """Flows (source, target) between methods and the hubs of their names, and between methods and those that override them."""
    c = F.col
    methods = symbols.where("kind = 'method'").select("name", c("id").alias("method"), F.coalesce("params", F.array().cast("array<string>")).alias("params"), F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: d == "staticmethod").alias("static"))
    hubs = places.where("node LIKE 'method:%'").select("node").distinct().withColumn("name", F.regexp_extract("node", "^method:(.*)::", 1)).withColumn("part", F.substring_index("node", "::", -1)).join(methods, "name")
    part = F.when((c("part") == "0") & c("static"), F.lit("@")).otherwise(c("part"))
    into = hubs.where("part <> 'return'").select(c("node").alias("source"), F.explode(given_to(c("method"), c("params"), part, F.when(c("static"), -1).otherwise(0))).alias("target"))
    out = hubs.where("part = 'return'").select(F.concat("method", F.lit("::return")).alias("source"), c("node").alias("target"))
    both = overrides.select(c("source").alias("upper"), c("target").alias("lower")).join(methods.select(c("method").alias("upper"), c("params").alias("above")), "upper").join(methods.select(c("method").alias("lower"), c("params").alias("below")), "lower")
    down = both.select("upper", "lower", F.explode(F.arrays_zip("above", "below")).alias("p")).where("p.above IS NOT NULL AND p.below IS NOT NULL").select(F.concat("upper", F.lit("::"), "p.above").alias("source"), F.concat("lower", F.lit("::"), "p.below").alias("target"))
    up = both.select(F.concat("lower", F.lit("::return")).alias("source"), F.concat("upper", F.lit("::return")).alias("target"))
    return into.unionByName(out).unionByName(down).unionByName(up)


def value_graph(rows: DataFrame, resolved: DataFrame, symbols: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``flows`` (source, target) and ``writes`` (node, owner) of the facts of rows ``flow`` and ``wrote``."""
    c = F.col
    flow = rows.where("row = 'flow'").select(c("id").alias("owner"), c("kind").alias("how"), c("target").alias("chain"), "part", "to_how", c("detail").alias("to_chain"), "to_part")
    wrote = rows.where("row = 'wrote'").select(c("id").alias("owner"), c("kind").alias("how"), c("target").alias("chain"), "part")
    ends = flow.select("owner", "how", "chain", "part").unionByName(flow.select("owner", c("to_how").alias("how"), c("to_chain").alias("chain"), c("to_part").alias("part"))).unionByName(wrote).distinct()
    places = written(resolved_places(ends, resolved, symbols), "places")
    key = ["owner", "how", "chain", "part"]
    to = places.select("owner", c("how").alias("to_how"), c("chain").alias("to_chain"), c("part").alias("to_part"), c("node").alias("target"))
    flows = flow.join(places.withColumnRenamed("node", "source"), key).join(to, ["owner", "to_how", "to_chain", "to_part"]).select("source", "target")
    flows = flows.unionByName(method_flows(places, symbols, overrides)).where("source <> target").distinct()
    return flows, wrote.join(places, key).select("node", "owner").distinct()
