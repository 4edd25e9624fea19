"""Lookups by computed names, bounded by the texts that can reach them.

A parameter takes the texts of all calls, so it is bounded only where all calls are known: a function that is decorated, used without being
called, called by runners or by the language itself, or a method of a class with a base outside, may be given any.  What a bounded lookup
may find is used that way too, so the functions of its names are opened and the sets are made again, until no name is new.
What an unbounded lookup calls needs no opening: it stays a dynamic reference, which selects whoever runs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.extract.flows import method_flows, resolved_places
from tidemark.operators.fixpoint import NotConverged, reachable
from tidemark.operators.literals import literal_sets
from tidemark.tables import counted, written

#: Beginnings of names that runners call.
RUN_BY_NAME = r"^(test|pytest_|time_|timeraw_|mem_|peakmem_|track_|setup|teardown|setUp|tearDown|asyncSetUp|asyncTearDown|__)"
ROUNDS = 100


def text_places(rows: DataFrame) -> DataFrame:
    """(module, source, chain, how) of what ``text`` and ``taken`` rows want resolved."""
    c = F.col
    text = rows.where("row = 'text'")
    own = rows.where("row IN ('text', 'taken')").select("module", c("id").alias("source"), c("target").alias("chain"), c("kind").alias("how"))
    return own.unionByName(text.select("module", c("id").alias("source"), c("detail").alias("chain"), c("to_how").alias("how"))).where("how IN ('name', 'absolute', 'self')")


def _nodes(ends: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(owner, how, chain, part, node) of the places that are known."""
    key = ["owner", "how", "chain"]
    bare = ends.withColumn("plain", F.regexp_replace("part", r"\[\]$", ""))
    values = bare.where("plain = ''")
    local = values.where("how = 'node'").withColumn("node", F.col("chain"))
    variables = symbols.where("kind = 'variable'").select(F.col("id").alias("node"))
    known = values.where("how <> 'node'").join(resolved.where("rest = ''").select("owner", "chain", F.col("found").alias("node")), ["owner", "chain"]).join(variables, "node", "left_semi")
    calls = bare.where("plain <> ''")
    asked = resolved_places(calls.select(*key, F.col("plain").alias("part")).distinct(), resolved, symbols).where("NOT (node LIKE 'method:%' AND part = 'return')")
    given = calls.join(asked.withColumnRenamed("part", "plain"), [*key, "plain"])
    out = [x.select(*key, "part", F.when(F.col("part").endswith("[]"), F.concat("node", F.lit("[]"))).otherwise(F.col("node")).alias("node")) for x in (local, known, given)]
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


def text_graph(rows: DataFrame, resolved: DataFrame, symbols: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (source, target, before, after) and first rows (node, value, any) of the ``text`` rows."""
    c = F.col
    text = rows.where("row = 'text'").select(c("id").alias("owner"), c("kind").alias("how"), c("target").alias("chain"), "part", c("params")[0].alias("before"), c("params")[1].alias("after"), "to_how", c("detail").alias("to_chain"), "to_part")
    ends = text.where("how NOT IN ('lit', 'any')").select("owner", "how", "chain", "part").unionByName(text.where("to_how <> 'titled'").select("owner", c("to_how").alias("how"), c("to_chain").alias("chain"), c("to_part").alias("part"))).distinct()
    nodes = written(_nodes(ends, resolved, symbols), "text-places")
    to = nodes.select("owner", c("how").alias("to_how"), c("chain").alias("to_chain"), c("part").alias("to_part"), c("node").alias("target"))
    variables = symbols.where("kind = 'variable'").select("name", c("id").alias("target"))
    results = symbols.where("kind IN ('function', 'method')").select("name", F.concat("id", F.lit("::return")).alias("target"))
    by_name = _titled(text, variables.unionByName(results))
    met = text.join(to, ["owner", "to_how", "to_chain", "to_part"]).join(nodes.withColumnRenamed("node", "source"), ["owner", "how", "chain", "part"], "left")
    edges = met.where("source IS NOT NULL AND how NOT IN ('lit', 'any')").select("source", "target", "before", "after")
    first = met.where("source IS NULL OR how IN ('lit', 'any')").select(c("target").alias("node"), F.when(c("how") == "lit", c("chain")).otherwise("").alias("value"), (c("how") != "lit").alias("any")).unionByName(by_name)
    hubs = nodes.select(F.regexp_replace("node", r"\[\]$", "").alias("node")).distinct()
    plain = method_flows(hubs, symbols, overrides)
    inner = plain.select(F.concat("source", F.lit("[]")).alias("source"), F.concat("target", F.lit("[]")).alias("target"))
    moves = plain.unionByName(inner).unionByName(inner.select(c("target").alias("source"), c("source").alias("target")))
    return edges.unionByName(moves.select("source", "target", F.lit("").alias("before"), F.lit("").alias("after"))).distinct(), first.distinct()


def _titled(text: DataFrame, variables: DataFrame) -> DataFrame:
    """Variables, and results of functions, that an attribute which is set may stand for; ``*`` is any name."""
    names = text.where("to_how = 'titled'").select(F.col("to_chain").alias("name")).distinct()
    every = variables.join(names.where("name = '*'").select(F.lit(True).alias("all")).limit(1), F.lit(True), "left_semi")
    hit = variables.join(names, "name", "left_semi").unionByName(every).select(F.col("target").alias("node"))
    return hit.unionByName(hit.select(F.concat("node", F.lit("[]")).alias("node"))).select("node", F.lit("").alias("value"), F.lit(True).alias("any"))


def opened(rows: DataFrame, resolved: DataFrame, symbols: DataFrame, bases: DataFrame) -> DataFrame:
    """Functions and methods (id) that may be called with anything."""
    c = F.col
    code = symbols.where("kind IN ('function', 'method')")
    called_by_name = code.where(c("decorated") | c("name").rlike(RUN_BY_NAME))
    taken = rows.where("row = 'taken'")
    by_title = code.join(taken.where("kind = 'titled'").select(c("target").alias("name")).distinct(), "name", "left_semi")
    by_chain = taken.where("kind <> 'titled'").select(c("id").alias("owner"), c("target").alias("chain")).join(resolved.where("rest = ''"), ["owner", "chain"]).select(c("found").alias("id"))
    known = bases.groupBy(c("cls").alias("id")).agg(F.countDistinct("place").alias("known"))
    listed = F.size(F.filter(F.coalesce("bases", F.array().cast("array<string>")), lambda b: b != "object"))
    outside = symbols.where("kind = 'class'").join(known, "id", "left").where(listed > F.coalesce("known", F.lit(0))).select(c("id").alias("node"))
    below = reachable(bases.select(c("base").alias("source"), c("cls").alias("target")), outside).select(c("node").alias("container"))
    methods = code.where("kind = 'method'").join(below, "container", "left_semi")
    return called_by_name.select("id").unionByName(by_title.select("id")).unionByName(code.select("id").join(by_chain, "id", "left_semi")).unionByName(methods.select("id")).distinct()


def _given_anything(functions: DataFrame, symbols: DataFrame) -> DataFrame:
    """First rows: any for the parameters of some functions, and for what decorated ones return."""
    own = symbols.join(functions, "id", "left_semi")
    names = F.array_union(F.coalesce("params", F.array().cast("array<string>")), F.when(F.col("decorated"), F.array(F.lit("return"))).otherwise(F.array().cast("array<string>")))
    place = own.select("id", F.explode(names).alias("p")).select(F.concat_ws("::", "id", "p").alias("node"))
    return place.unionByName(place.select(F.concat("node", F.lit("[]")).alias("node"))).select("node", F.lit("").alias("value"), F.lit(True).alias("any"))


def bounded_lookups(rows: DataFrame, resolved: DataFrame, symbols: DataFrame, overrides: DataFrame, bases: DataFrame) -> DataFrame:
    """(symbol, name, value): the texts of all lookups by one function in a symbol, where all of them are bounded."""
    c = F.col
    edges, first = (written(x, "texts") for x in text_graph(rows, resolved, symbols, overrides))
    free = written(opened(rows, resolved, symbols, bases), "opened")
    sites = rows.where("row = 'dyn'").select(c("id").alias("symbol"), c("kind").alias("name"), c("target").alias("node")).distinct()
    code = symbols.where("kind IN ('function', 'method')").select("id", c("name").alias("value"))
    for _ in range(ROUNDS):
        sets = literal_sets(edges, first.unionByName(_given_anything(free, symbols)))
        found = written(sites.join(sets, "node", "left"), "lookups")
        more, n = counted(code.join(found.where("name = 'getattr' AND NOT any").select("value").distinct(), "value", "left_semi").select("id").join(free, "id", "left_anti"), "opened")
        if not n:
            break
        free = written(free.unionByName(more), "opened")
    else:
        raise NotConverged(f"names of lookups were new in {ROUNDS} rounds")
    # A relative name needs its package, which is not followed.
    loose = found.where("any IS NULL OR any OR (name <> 'getattr' AND value LIKE '.%')").select("symbol", "name").distinct()
    return written(found.join(loose, ["symbol", "name"], "left_anti").select("symbol", "name", "value").distinct(), "bounded")
