"""Edges of the impact graph: unions of versions, derived edges, hubs, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import ancestors, fnmatch_regex, prefixes, short_name, under
from tidemark.operators.fixpoint import closure, reachable
from tidemark.tables import written

ITEM = ("source", "target", "kind", "detail")

#: Edge class -> the mode at the source for modes 1 to 4 at the target.
TRANSFER = {
    "defined_in": (0, 0, 0, 4), "registers": (1, 1, 1, 1), "rebinds": (0, 0, 0, 4), "writes": (0, 0, 3, 3),
    "imports": (3, 3, 3, 3), "import_of_deleted": (4, 4, 4, 4), "imports_name": (0, 0, 0, 0), "mutated_by": (2, 2, 2, 2), "plain": (3, 3, 3, 3),
}
#: Of these a module keeps nothing of mode 1.
MODULE_STOPS = ("imports", "import_of_deleted", "mutated_by", "plain")


def mark(kind: Column, detail: Column) -> Column:
    """The mark of an edge: its detail, on references only."""
    return F.when(kind == "references", F.coalesce(detail, F.lit(""))).otherwise("")


def edge_class(kind: Column, marked: Column, deleted: Column) -> Column:
    special = marked.isin("registers", "rebinds", "writes", "mutated_by")
    imports = kind.isin("imports", "imports_name")
    return (
        F.when(kind == "defined_in", "defined_in").when(special, marked)
        .when(imports & deleted, "import_of_deleted").when(imports, kind).otherwise("plain")
    )


def with_transfer(edges: DataFrame, modules: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Edges with ``xfer``; ``modules`` and ``deleted`` have a column node, none where there are none."""
    def marked(rows: DataFrame, nodes: DataFrame | None, at: str, name: str) -> DataFrame:
        if nodes is None:
            return rows.withColumn(name, F.lit(None).cast("boolean"))
        return rows.join(nodes.select(F.col("node").alias(at), F.lit(True).alias(name)), at, "left")

    rows = marked(marked(edges, modules, "source", "from_module"), deleted, "target", "to_deleted")
    cls = edge_class(F.col("kind"), mark(F.col("kind"), F.col("detail")), F.col("to_deleted").isNotNull())
    vector = lambda v: F.array(*(F.lit(x) for x in v))
    xfer = vector((0, 0, 0, 0))
    for name, v in TRANSFER.items():
        own = F.when(F.col("from_module").isNotNull(), vector((0, *v[1:]))).otherwise(vector(v)) if name in MODULE_STOPS else vector(v)
        xfer = F.when(F.col("cls") == name, own).otherwise(xfer)
    return rows.withColumn("cls", cls).withColumn("xfer", xfer).drop("cls", "from_module", "to_deleted")


def union_versions(base: DataFrame, head: DataFrame) -> DataFrame:
    """Each distinct item of either version with the sorted list of versions that have it."""
    tagged = base.withColumn("revision", F.lit("base")).unionByName(head.withColumn("revision", F.lit("head")))
    return tagged.groupBy(*base.columns).agg(F.array_sort(F.collect_set("revision")).alias("revisions"))


def without_isolated_writers(edges: DataFrame, isolated: DataFrame) -> DataFrame:
    """Drop ``mutated_by`` and ``registers`` edges into isolated test code."""
    own = isolated.select(F.col("node").alias("target"), F.lit(True).alias("alone"))
    return edges.join(own, "target", "left").where("alone IS NULL OR NOT (kind = 'references' AND detail IN ('mutated_by', 'registers'))").drop("alone")


def members(symbols: DataFrame) -> DataFrame:
    """(container, member): every symbol under each of its dotted prefixes that is a symbol."""
    ids = symbols.select("id").distinct()
    return ids.select(F.col("id").alias("member"), F.explode(prefixes("id", proper=True)).alias("container")).join(ids.select(F.col("id").alias("container")), "container", "left_semi").select("container", "member")


def fan_out(escaped: DataFrame, member_pairs: DataFrame, detail: str = "escaped") -> DataFrame:
    """Edges from each escaped container to all of its members."""
    pairs = member_pairs.join(escaped.select(F.col("id").alias("container")), "container", "left_semi")
    return pairs.select(F.col("container").alias("source"), F.col("member").alias("target"), F.lit("references").alias("kind"), F.lit(detail).alias("detail"))


def import_hubs(edges: DataFrame) -> DataFrame:
    """One node ``<module>.<imports>`` behind each importing module, so its imports are kept once."""
    own = edges.where("kind = 'imports'")
    hub = F.concat(F.col("source"), F.lit(".<imports>"))
    into = own.select("source", hub.alias("target"), F.lit("imports").alias("kind"), F.lit("").alias("detail")).distinct()
    return into.unionByName(own.select(hub.alias("source"), "target", "kind", "detail"))


def declared(declarations: DataFrame, member_pairs: DataFrame, most: int = 5_000) -> tuple[DataFrame, DataFrame]:
    """Edges of declared dependencies, container to members on both sides, and errors of those too large.

    The number of pairs is known from two counts before any pair is made.
    """
    def side(name: str) -> DataFrame:
        plain = declarations.select("why", "source", "target", F.col(name).alias(f"{name}_member"))
        inner = declarations.join(member_pairs, F.col(name) == F.col("container")).select("why", "source", "target", F.col("member").alias(f"{name}_member"))
        return plain.unionByName(inner).distinct()

    key = ["why", "source", "target"]
    a, b = side("source"), side("target")
    sizes = a.groupBy(*key).count().withColumnRenamed("count", "na").join(b.groupBy(*key).count().withColumnRenamed("count", "nb"), key).withColumn("pairs", F.col("na") * F.col("nb"))
    fine = sizes.where(F.col("pairs") <= most).select(*key)
    edges = a.join(fine, key, "left_semi").join(b, key).select(F.col("source_member").alias("source"), F.col("target_member").alias("target"), F.lit("declared").alias("kind"), F.col("why").alias("detail")).distinct()
    errors = sizes.where(F.col("pairs") > most).select(F.concat(F.lit("declared dependency expands to "), F.col("pairs").cast("string"), F.lit(" pairs")).alias("message"), *key)
    return edges, errors


def name_hubs(unresolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Name matches through hub nodes: ``name:n`` for bare names, ``name:.n`` for attributes; linear in both sides.

    The uses are written once, as both halves read them.
    """
    uses = unresolved.where("kind IN ('name', 'attribute')").select(F.col("symbol").alias("source"), F.concat(F.when(F.col("kind") == "attribute", "name:.").otherwise("name:"), "name").alias("hub"))
    uses = written(uses.repartition("source").distinct(), "uses")  # most are distinct as they are, so they are not grouped before the shuffle
    names = symbols.select(F.col("id").alias("target"), short_name("id").alias("short"), "kind")
    reach = names.select("target", F.concat(F.lit("name:."), "short").alias("hub")).unionByName(names.where("kind IN ('function', 'class', 'variable', 'module')").select("target", F.concat(F.lit("name:"), "short").alias("hub")))
    out = uses.select("source", F.col("hub").alias("target")).unionByName(reach.join(uses.select("hub").distinct(), "hub", "left_semi").select(F.col("hub").alias("source"), "target").distinct())
    return out.select("source", "target", F.lit("unresolved_name_match").alias("kind"), F.lit("").alias("detail"))


def constructor_hooks(edges: DataFrame, symbols: DataFrame, bases: DataFrame) -> DataFrame:
    """Edges from users of a class to the special methods it has or inherits, which run without being named."""
    hooks = symbols.where("name RLIKE '^__.+__$' AND container IS NOT NULL").select("container", F.col("id").alias("target"))
    classes = bases.select(F.col("cls").alias("node")).unionByName(hooks.select(F.col("container").alias("node"))).distinct()
    up = closure(bases.select(F.col("cls").alias("source"), F.col("base").alias("target")), classes)
    users = edges.where("kind = 'references' AND coalesce(detail, '') NOT IN ('mutated_by', 'registers')").select("source", F.col("target").alias("origin"))
    return users.join(up, "origin").join(hooks, F.col("node") == F.col("container")).where("source <> target").select("source", "target", F.lit("references").alias("kind"), F.lit("constructor").alias("detail")).distinct()


def target_node(runner: str = "runner", runner_id: str = "runner_id") -> Column:
    return F.concat(F.lit("target:"), F.col(runner), F.lit(":"), F.col(runner_id))


def target_edges(targets: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entry and lifecycle edges of targets, and fallbacks (node, rule, detail) for what is no symbol."""
    wanted = targets.select(target_node().alias("source"), F.col("entry_symbol").alias("target"), F.lit("entry").alias("kind")).unionByName(
        targets.select(target_node().alias("source"), F.explode("lifecycle_dependencies").alias("target"), F.lit("lifecycle").alias("kind"))
    )
    found = wanted.join(symbols.select(F.col("id").alias("target")).distinct().withColumn("there", F.lit(True)), "target", "left").distinct()  # within the join's shuffle
    edges = found.where("there").select("source", "target", "kind", F.lit("").alias("detail"))
    rule = F.when(F.col("kind") == "entry", "entry_symbol_unresolved").otherwise("lifecycle_dependency_unresolved")
    return edges, found.where("there IS NULL").select(F.col("source").alias("node"), rule.alias("rule"), F.col("target").alias("detail"))


def shared_lifecycle(targets: DataFrame) -> DataFrame:
    """(runner, dependency) that every target of a runner has: relational division by counts."""
    total = targets.groupBy("runner").agg(F.countDistinct("runner_id").alias("n"))
    held = targets.select("runner", "runner_id", F.explode("lifecycle_dependencies").alias("dependency")).groupBy("runner", "dependency").agg(F.countDistinct("runner_id").alias("k"))
    return held.join(total, "runner").where("k = n").select("runner", "dependency")


def factored(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets without the dependencies all of their runner share, and edges by a hub ``runner:<r>:shared``."""
    shared = shared_lifecycle(targets)
    lists = shared.groupBy("runner").agg(F.collect_set("dependency").alias("all_have"))
    own = targets.join(lists, "runner", "left").withColumn("lifecycle_dependencies", F.array_except("lifecycle_dependencies", F.coalesce("all_have", F.array().cast("array<string>")))).drop("all_have")
    hub = F.concat(F.lit("runner:"), F.col("runner"), F.lit(":shared"))
    to = targets.join(lists.select("runner"), "runner", "left_semi").select(target_node().alias("source"), hub.alias("target"))
    edges = to.unionByName(shared.select(hub.alias("source"), F.col("dependency").alias("target"))).select("source", "target", F.lit("lifecycle").alias("kind"), F.lit("").alias("detail"))
    return own, edges


def calls_of(edges: DataFrame) -> DataFrame:
    """(source, target) of the edges that a call can take: references that are no writer marks, name matches, declared ones."""
    return edges.where("(kind = 'references' AND coalesce(detail, '') NOT IN ('mutated_by', 'registers', 'writes', 'rebinds')) OR kind IN ('unresolved_name_match', 'declared')").select("source", "target")


def caller_effects(calls: DataFrame, mutated: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges by nodes ``calls:Y``, "Y may now be called differently".

    A variable that Y writes in place (``mutated``: variable, writer) depends on ``calls:Y``; that on each caller of
    Y and on ``calls:`` of the caller, as the caller hands on what it was given.  Only what leads to a writer gets such a node;
    a module is not entered, as naming one runs none of its code.
    """
    node = lambda c: F.concat(F.lit("calls:"), F.col(c))
    own = calls.join(modules.select(F.col("node").alias("target")), "target", "left_anti")
    up = reachable(own.select(F.col("target").alias("source"), F.col("source").alias("target")), mutated.select(F.col("writer").alias("node")))
    made = own.join(up.select(F.col("node").alias("target")), "target", "left_semi")
    by = made.select(node("target").alias("source"), F.col("source").alias("target"))
    through = made.join(modules.select(F.col("node").alias("source")), "source", "left_anti").select(node("target").alias("source"), node("source").alias("target"))
    called = by.unionByName(through).select("source", "target", F.lit("references").alias("kind"), F.lit("caller").alias("detail"))
    return called.unionByName(mutated.select(F.col("variable").alias("source"), node("writer").alias("target"), F.lit("references").alias("kind"), F.lit("mutated_by").alias("detail"))).distinct()


def without_lazy_writes(edges: DataFrame, lazy: DataFrame) -> DataFrame:
    """Drop writes of lazily built constants that only their writer refers to."""
    wrote = edges.where("kind = 'references' AND detail = 'writes'").join(lazy.select(F.col("node").alias("target")), "target", "left_semi")
    users = edges.where("kind = 'references'").join(lazy.select(F.col("node").alias("target")), "target", "left_semi").groupBy("target").agg(F.countDistinct("source").alias("users"))
    dead = wrote.join(users.where("users = 1"), "target").select("source", "target", F.lit(True).alias("dead")).distinct()
    return edges.join(dead, ["source", "target"], "left").where("dead IS NULL OR NOT (kind = 'references' AND detail = 'writes')").drop("dead")


def callback_hubs(sites: DataFrame, states: DataFrame) -> DataFrame:
    """Every logging call may run every handler's writes: both sides meet in one node, not in pairs."""
    hub = F.lit("log:callbacks")
    out = sites.select(F.col("node").alias("source"), hub.alias("target")).unionByName(states.select(hub.alias("source"), F.col("node").alias("target")))
    return out.distinct().select("source", "target", F.lit("references").alias("kind"), F.lit("log_callback").alias("detail"))


#: Which reading of a dynamic reference counts when several hold.
DYNAMIC_ORDER = ("excluded", "script", "import", "installed", "written", "bounded", "unbounded")


def dynamic_class(candidates: DataFrame) -> DataFrame:
    """(symbol, class): the first class in ``DYNAMIC_ORDER`` of each dynamic reference (symbol, class)."""
    rank = F.array_position(F.array(*map(F.lit, DYNAMIC_ORDER)), F.col("class"))
    return candidates.groupBy("symbol").agg(F.min_by("class", rank).alias("class"))


def import_reach(edges: DataFrame, writers: DataFrame, modules: DataFrame) -> DataFrame:
    """(origin, node): modules that importing each module can run, through writers of modules as well."""
    along = edges.where("kind = 'imports'").select("source", "target").unionByName(writers.select(F.col("module").alias("source"), F.col("writer_module").alias("target")))
    return closure(along, modules.select("node"))


def tied(edges: DataFrame) -> DataFrame:
    """One edge per (source, target): the least (kind, detail), so that later picks do not depend on order."""
    return edges.groupBy("source", "target").agg(F.min(F.struct("kind", "detail")).alias("e")).select("source", "target", "e.kind", "e.detail")


def merged_targets(manifest: DataFrame, discovered: DataFrame) -> DataFrame:
    """Targets of both; where a (runner, id) is in both, the manifest's counts."""
    key = ["runner", "runner_id"]
    return manifest.unionByName(discovered.join(manifest.select(*key), key, "left_anti"))


def carried_lifecycle(head: DataFrame, base: DataFrame) -> DataFrame:
    """Head targets with the dependencies their base version had as well."""
    key = ["runner", "runner_id"]
    old = base.select(*key, F.col("lifecycle_dependencies").alias("old"))
    both = F.array_sort(F.array_union("lifecycle_dependencies", F.coalesce("old", F.array().cast("array<string>"))))
    return head.join(old, key, "left").withColumn("lifecycle_dependencies", both).drop("old")


def docstring_readers(edges: DataFrame, flags: DataFrame) -> DataFrame:
    """(symbol, reader): who refers to a symbol and reads docstrings; ``flags`` has node, reads_docs."""
    return edges.where("kind = 'references'").join(flags.where("reads_docs").select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("symbol"), F.col("source").alias("reader")).distinct()


def pattern_pairs(rows: DataFrame, column: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """Rows with each (name, shell pattern) that matches: one pass, patterns being a short list."""
    names = F.array_compact(F.array(*(F.when(F.col(column).rlike(fnmatch_regex(p)), F.lit(n)) for n, p in patterns)))
    return rows.withColumn("pattern", F.explode(names))


def module_names(files: DataFrame, roots: list[str]) -> DataFrame:
    """Files with their module by the longest source root; roots may be ``dir`` or ``dir=prefix``."""
    best = F.lit(None).cast("string")
    for root in sorted(roots, key=lambda r: len(r.partition("=")[0])):
        where, _, prefix = root.partition("=")
        where = "" if where in ("", ".") else where.rstrip("/") + "/"
        inner = F.regexp_replace(F.substring(F.col("path"), len(where) + 1, 1 << 20), r"\.py$", "")
        name = F.regexp_replace(F.concat(F.lit(f"{prefix}." if prefix else ""), F.translate(inner, "/", ".")), r"(^|\.)__init__$", "")
        fits = F.col("path").startswith(where) & F.col("path").endswith(".py") & name.rlike(r"^[^\W\d]\w*(\.[^\W\d]\w*)*$")
        best = F.when(fits, name).otherwise(best)
    return files.withColumn("module", best)


def role(roots: list[str]) -> Column:
    """What a named file is to an index: ``source``, ``other`` (it may be read), or ``outside`` of all roots."""
    return F.when(F.col("module").isNotNull(), "source").when(under("path", roots), "other").otherwise("outside")


def empty_roots(base: DataFrame, head: DataFrame, roots: list[str]) -> DataFrame:
    """(path, message) of source roots that hold no module in either version: most likely a wrong path."""
    paths = base.where("role = 'source'").select("path").unionByName(head.where("role = 'source'").select("path"))
    folders = [r for r in roots if r.partition("=")[0].strip("/") not in ("", ".")]
    table = base.sparkSession.createDataFrame([(r, r.partition("=")[0].strip("/")) for r in folders], "root string, folder string")
    there = paths.select(F.explode(ancestors("path")).alias("folder")).distinct()
    return table.join(there, "folder", "left_anti").select(F.col("folder").alias("path"), F.concat(F.lit("source root "), "root", F.lit(" holds no Python file in either version")).alias("message"))


def exclude(files: DataFrame, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files that are indexed, and those that exclusion patterns move to the unread ones."""
    if not patterns:
        return files, files.limit(0)
    hit = F.col("path").rlike("|".join(f"(?:{fnmatch_regex(p)})" for p in patterns))
    return files.where(~hit), files.where(hit)


def duplicates(files: DataFrame) -> DataFrame:
    """Errors for modules that several files give."""
    return files.where("module IS NOT NULL").groupBy("module").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1").select("path", F.concat(F.lit("several files are module "), "module").alias("message"))


def suffix_matches(rows: DataFrame, column: str, wanted: DataFrame, suffix: str) -> DataFrame:
    """Pairs whose path ends with a wanted suffix at a part border: an equi-join on exploded suffixes."""
    parts = F.split(F.col(column), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    return rows.withColumn("tail", F.explode(tails)).join(wanted.withColumnRenamed(suffix, "tail"), "tail")


