"""The index of a snapshot: facts resolved by joins."""

from __future__ import annotations

import builtins
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.extract.bounds import bounded_lookups, text_places
from tidemark.extract.flows import state_writers, value_graph
from tidemark.extract.pyfacts import facts
from tidemark.functions.names import prefixes
from tidemark.operators.classes import found_first, linearised, overridden
from tidemark.operators.fixpoint import NotConverged
from tidemark.tables import counted, together, written


#: Most steps of a chain of re-exports.
ROUNDS = 1_000


@dataclass
class Index:
    """The relations of one snapshot.

    ``state`` are edges between variables and the code that writes them behind arguments, aliases and results: they follow from
    what others do, so they are no part of a symbol's own dependencies.
    ``bases`` (cls, base, place) are direct bases that are symbols; ``flags`` (node, reads_docs); ``escaped`` (id) are modules that
    are handed on as values.
    """

    symbols: DataFrame
    edges: DataFrame
    unresolved: DataFrame
    external: DataFrame
    errors: DataFrame
    bindings: DataFrame
    bases: DataFrame
    flags: DataFrame
    escaped: DataFrame
    state: DataFrame

    def all_edges(self) -> DataFrame:
        return self.edges.unionByName(self.state)

    def failed_modules(self) -> DataFrame:
        return self.errors.select("module").distinct()


def _longest(rows: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    """Rows with ``found``, the longest prefix of ``full`` that is a symbol, and ``rest`` behind it."""
    exploded = rows.withColumn("prefix", F.explode(prefixes("full"))).join(ids.select(F.col("id").alias("prefix")), "prefix")
    best = exploded.groupBy(*key).agg(F.max_by("prefix", F.length("prefix")).alias("found"))
    return rows.join(best, key, "left").withColumn("rest", F.when(F.col("found").isNotNull(), F.substring(F.col("full"), F.length("found") + 2, F.length("full"))))


def build(files: DataFrame) -> Index:
    """Facts once per file, then names by joins: bindings, star imports, re-exports, longest prefixes."""
    seen, c = Observation(), F.col
    rows = written(facts(files).observe(seen, F.count_if(c("row") == "dyn").alias("lookups")), "facts")
    lookups = seen.get["lookups"]
    symbols = rows.where("row = 'symbol'").dropDuplicates(["id"])
    ids = symbols.select("id").distinct()
    bindings = rows.where("row = 'binding'").select("module", "name", "target").distinct()
    errors = rows.where("row = 'error'").select("snapshot", "path", "module", c("detail").alias("message"))
    uses = rows.where("row = 'use'").select("module", c("id").alias("source"), c("target").alias("chain"), c("kind").alias("how"), c("detail").alias("mark")).distinct()
    # The places that values go to are resolved along with the uses, and told by their mark.
    places = rows.where("row IN ('flow', 'wrote')").select("module", c("id").alias("source"), c("target").alias("chain"), c("kind").alias("how")).unionByName(rows.where("row = 'flow'").select("module", c("id").alias("source"), c("detail").alias("chain"), c("to_how").alias("how")))
    if lookups:
        places = places.unionByName(text_places(rows))
    places = places.where("how IN ('name', 'absolute', 'self')").select("module", "source", "chain", F.when(c("how") == "name", "name").otherwise("absolute").alias("how"), F.concat(F.lit("flow:"), "chain").alias("mark"))
    uses = uses.unionByName(places.distinct())
    head = F.substring_index("chain", ".", 1)
    named = uses.where("how = 'name'").withColumn("name", head).join(bindings.where("name <> '*'").select("module", "name", "target"), ["module", "name"], "left")
    stars = bindings.where("name = '*'").select("module", c("target").alias("star"))
    open_ = named.where("target IS NULL")
    by_star = open_.join(stars, "module").join(bindings.where("name <> '*'").select(c("module").alias("star"), "name", c("target").alias("star_target")), ["star", "name"])
    bare = open_.join(by_star.select("module", "source", "chain").distinct(), ["module", "source", "chain"], "left_anti").where(~c("name").isin(*dir(builtins)) & ~c("mark").startswith("flow:"))
    tail = F.substring(c("chain"), F.length("name") + 1, F.length("chain"))
    chains = (
        named.where("target IS NOT NULL").select("source", F.concat("target", tail).alias("full"), "mark")
        .unionByName(by_star.select("source", F.concat("star_target", tail).alias("full"), "mark"))
        .unionByName(uses.where("how <> 'name'").select("source", c("chain").alias("full"), "mark")).distinct()
    )
    modules = symbols.where("kind = 'module'").select(c("id").alias("found"), F.lit(True).alias("is_module"))
    done, (bases, overrides, inherited) = together(lambda: _followed(chains, bindings, ids, modules), lambda: _classes(symbols, bindings, ids))
    resolved = done.where("mark LIKE 'flow:%' AND found IS NOT NULL").select(c("source").alias("owner"), F.substring(c("mark"), 6, F.length("mark")).alias("chain"), "found", "rest").distinct()
    done = done.where("mark NOT LIKE 'flow:%'")
    bounded = bounded_lookups(rows, written(resolved, "resolved"), symbols, overrides, bases) if lookups else None
    hit = done.where("found IS NOT NULL")
    plain = hit.where(c("found") != c("source"))
    refs = plain.select("source", c("found").alias("target"), F.lit("references").alias("kind"), F.when(c("mark") == "mutates", "writes").otherwise(c("mark")).alias("detail"))
    # Who reads a variable depends on whoever writes it or changes it in place.
    variables = symbols.where("kind = 'variable'").select(c("id").alias("found"))
    wrote = plain.where("mark IN ('mutates', 'writes')").join(variables, "found", "left_semi").select(c("found").alias("source"), c("source").alias("target"), F.lit("references").alias("kind"), F.lit("mutated_by").alias("detail"))
    left = hit.where("rest <> ''").select(c("source").alias("symbol"), F.when(c("is_module"), "module_attribute").otherwise("attribute").alias("kind"), F.explode(F.split("rest", r"\.")).alias("name"), F.lit("").alias("detail"))
    imports = rows.where("row = 'import'").select(c("id").alias("source"), c("target").alias("full"), c("detail").alias("mark")).distinct()
    if bounded is not None:
        imports = imports.unionByName(bounded.where("name <> 'getattr'").select(c("symbol").alias("source"), c("value").alias("full"), F.lit("").alias("mark"))).distinct()
    parents = imports.select("source", "mark", F.explode(prefixes("full")).alias("target"))
    module_ids = symbols.where("kind = 'module'").select(c("id").alias("target"))
    import_edges = parents.join(module_ids, "target", "left_semi").select("source", "target", F.lit("imports").alias("kind"), F.lit("").alias("detail"))
    name_edges = imports.where("mark = 'name'").select("source", c("full").alias("target"), F.lit("imports_name").alias("kind"), F.lit("").alias("detail")).join(ids.select(c("id").alias("target")), "target", "left_semi").join(module_ids, "target", "left_anti")
    inside = symbols.where("container IS NOT NULL").select(c("id").alias("source"), c("container").alias("target"), F.lit("defined_in").alias("kind"), F.lit("").alias("detail"))
    # A member runs in its module: what the module imports and does at its top is behind it.
    edges = refs.unionByName(wrote).unionByName(import_edges).unionByName(name_edges).unionByName(inside).where("source <> target").distinct()
    own = rows.where("row = 'unresolved'").select(c("id").alias("symbol"), "kind", "name", F.coalesce("detail", F.lit("")).alias("detail"))
    if bounded is not None:
        looked_up = bounded.where("name = 'getattr'").select("symbol", F.lit("attribute").alias("kind"), c("value").alias("name"), F.lit("").alias("detail"))
        own = own.join(bounded.select("symbol", F.lit("dynamic").alias("kind"), "name").distinct(), ["symbol", "kind", "name"], "left_anti").unionByName(looked_up)
    selfless = done.where("found IS NULL")
    in_scope = F.substring_index("full", ".", 1)
    roots = symbols.select(F.substring_index("id", ".", 1).alias("root")).distinct()
    lost = selfless.withColumn("root", in_scope)
    unknown = lost.join(roots, "root", "left_semi").select(c("source").alias("symbol"), F.lit("attribute").alias("kind"), F.substring_index("full", ".", -1).alias("name"), F.lit("").alias("detail"))
    unresolved = own.unionByName(left).unionByName(bare.select(c("source").alias("symbol"), F.lit("name").alias("kind"), "name", F.lit("").alias("detail"))).unionByName(unknown).distinct()
    external = lost.join(roots, "root", "left_anti").select(c("source").alias("symbol"), c("root").alias("module")).unionByName(imports.withColumn("root", in_scope).join(roots, "root", "left_anti").select(c("source").alias("symbol"), c("root").alias("module"))).distinct()
    flows, in_place = (written(x, "values") for x in value_graph(rows, resolved, symbols, overrides))
    behind = state_writers(flows, in_place, variables.withColumnRenamed("found", "node"))
    behind = behind.select(c("variable").alias("source"), c("writer").alias("target"), F.lit("mutated_by").alias("detail")).unionByName(behind.select(c("writer").alias("source"), c("variable").alias("target"), F.lit("writes").alias("detail")))
    state = behind.where("source <> target").select("source", "target", F.lit("references").alias("kind"), "detail")
    flags = rows.where("row = 'flag'").select(c("id").alias("node"), F.lit(True).alias("reads_docs")).distinct()
    escaped = hit.where("is_module AND rest = '' AND mark = ''").select(c("found").alias("id")).distinct()
    edges, unresolved, state = together(lambda: written(edges.unionByName(inherited).distinct(), "edges"), lambda: written(unresolved, "unresolved"), lambda: written(state, "state"))
    return Index(symbols, edges, unresolved, external, errors, bindings, bases, flags, escaped, state)


def _followed(chains: DataFrame, bindings: DataFrame, ids: DataFrame, modules: DataFrame) -> DataFrame:
    """Chains (source, full, mark) with found, rest and is_module: the longest symbol in front, through re-exports."""
    c, columns = F.col, ["source", "full", "mark"]
    done, seen = None, None
    again = _ends(bindings, ids)
    for _ in range(ROUNDS):
        found = written(_longest(chains, ids, columns).join(modules, "found", "left").withColumn("next", F.substring_index("rest", ".", 1)).join(again, ["found", "next"], "left"), "chains")
        seen = found.select(*columns) if seen is None else seen.unionByName(found.select(*columns))
        onward = F.concat("there", F.substring(c("rest"), F.length("next") + 1, F.length("rest")))
        moved = found.where("is_module AND rest <> '' AND there IS NOT NULL AND there <> concat(found, '.', next)").withColumn("onward", onward)
        # What leads back to where it was is a cycle of re-exports: it stays as it is, on the module.
        moved = moved.join(seen.select("source", c("full").alias("onward"), "mark").distinct(), ["source", "onward", "mark"], "left_anti")
        stay = found.join(moved.select(*columns).distinct(), columns, "left_anti").select(*columns, "found", "rest", "is_module")
        done = stay if done is None else done.unionByName(stay)
        chains, n = counted(moved.select("source", c("onward").alias("full"), "mark").distinct(), "chains")
        if not n:
            break
    else:
        raise NotConverged(f"re-exports did not end in {ROUNDS} rounds")
    return done


def _classes(symbols: DataFrame, bindings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    bases = written(class_bases(symbols, bindings, ids), "bases")
    return bases, *_inherited(symbols, bases)


def _ends(bindings: DataFrame, ids: DataFrame) -> DataFrame:
    """(found, next, there): what each name of a module leads to through re-exports, by pointer doubling: chains of n take log n rounds.

    A name that is bound twice leads both ways; one on a circle keeps its own target.
    """
    c = F.col
    own = bindings.where("name <> '*'").select(F.concat_ws(".", "module", "name").alias("key"), "module", "name", "target")
    plain = own.where("key <> target")
    # Only names that are re-exported once are followed; a target that is a symbol ends a chain.
    single = plain.groupBy("key").agg(F.count("*").alias("n"), F.min("target").alias("to")).where("n = 1").select("key", "to").join(ids.select(c("id").alias("key")), "key", "left_anti")
    now = written(single, "pointers")
    for _ in range(now.count().bit_length()):  # by then all chains have ended, and only circles still move
        far = now.select(c("key").alias("to"), c("to").alias("far"))
        if now.join(far, "to", "left_semi").isEmpty():
            break
        now = written(now.join(far, "to", "left").select("key", F.coalesce("far", "to").alias("to")), "pointers")
    ends = now.join(now.select(c("key").alias("to")), "to", "left_anti")
    got = own.join(ends.select("key", c("to").alias("end")), "key", "left")
    return got.select(c("module").alias("found"), c("name").alias("next"), F.coalesce("end", "target").alias("there"))


def class_bases(symbols: DataFrame, bindings: DataFrame, ids: DataFrame) -> DataFrame:
    """(cls, base, place) of bases that are symbols, in their order."""
    named = symbols.where("kind = 'class'").select("module", F.col("id").alias("cls"), F.posexplode("bases").alias("place", "chain")).withColumn("name", F.substring_index("chain", ".", 1))
    full = named.join(bindings, ["module", "name"]).select("cls", F.concat("target", F.substring(F.col("chain"), F.length("name") + 1, F.length("chain"))).alias("base"), "place")
    return full.join(ids.select(F.col("id").alias("base")), "base", "left_semi").distinct()


def _inherited(symbols: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overrides (source, target), and edges: a class depends on its bases and on what it finds first of the members it inherits, a member on
    the overrides next below it."""
    mro = written(linearised(bases, symbols.where("kind = 'class'").select(F.col("id").alias("cls"))), "mro")
    member = symbols.where("kind IN ('method', 'class', 'function')").select("container", "name", "id")
    overrides = written(overridden(mro, member).select(F.col("upper").alias("source"), F.col("lower").alias("target")).where("source <> target"), "overrides")
    inherits = found_first(mro, member).where("depth > 0").select(F.col("cls").alias("source"), F.col("id").alias("target"))
    return overrides, overrides.unionByName(inherits).where("source <> target").distinct().select("source", "target", F.lit("references").alias("kind"), F.lit("").alias("detail"))
