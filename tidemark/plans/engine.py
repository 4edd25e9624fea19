"""Whole plans: two snapshots in, decisions with reasons out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.extract.index import Index, build
from tidemark.functions.names import BESIDE_PROJECT, PROJECT_FILES, build_input, runner_file
from tidemark.operators import diff, fixpoint, graph, impact
from tidemark.schema import STRUCTURAL
from tidemark.tables import together, written


@dataclass
class Plan:
    """``decisions`` per target, ``reasons`` (node, rule, detail, path, changed_symbol), ``changes``, ``fallbacks``, ``unresolved``."""

    decisions: DataFrame
    reasons: DataFrame
    changes: DataFrame
    fallbacks: DataFrame
    unresolved: DataFrame
    impacted: DataFrame

    def selected(self) -> list[str]:
        return sorted(r.runner_id for r in self.decisions.where("selected").select("runner_id").collect())


def literal_files(spark: SparkSession, snapshot: str, content: dict[str, str | bytes], roots: Sequence[str] = ("",)) -> DataFrame:
    """A snapshot from a small mapping of paths to contents."""
    rows = [(snapshot, p, bytearray(c.encode() if isinstance(c, str) else c)) for p, c in content.items()]
    files = spark.createDataFrame(rows, "snapshot string, path string, content binary")
    named = graph.module_names(files, list(roots))
    return named.select("snapshot", "path", "module", graph.role(list(roots)).alias("role"), "content", F.sha1("content").alias("blob_id"), F.lit("100644").alias("mode"))


def dependency_changes(base: Index, head: Index) -> DataFrame:
    """The change ladder over two indexes.

    A first pass takes every newly imported module to matter; the second asks whether its imports reach a module
    that really changed.
    """
    empty = lambda i: i.errors.select("module").distinct()
    before, after = together(*(lambda i=i: written(diff.signatures(i.edges, i.unresolved, i.external), "signatures") for i in (base, head)))
    ladder = lambda **more: diff.classify(base.symbols, head.symbols, before, after, empty(base), empty(head), **more)
    first = written(ladder(), "changes")
    soft = F.array(*map(F.lit, ("dependencies_added", "imports_added", "docstring_changed")))
    touched = first.where(F.size(F.array_except("changes", soft)) > 0).select("module").distinct()
    modules = head.symbols.where("kind = 'module'").select("id")
    imports = lambda i: i.edges.where("kind = 'imports'").select("source", "target")
    fresh = imports(head).join(modules.select(F.col("id").alias("source")), "source", "left_semi").join(imports(base), ["source", "target"], "left_anti").select(F.col("target").alias("id")).distinct()
    if fresh.isEmpty():
        return first
    return written(ladder(touched_modules=touched, closures=diff.import_closures(head.edges, fresh)), "changes")


def isolated_code(targets: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Code (node) of test modules that only runs within one test: what it leaves behind no other test is taken to see.

    Members are functions and methods of the modules that hold entries; what a lifecycle lists runs for others too, and code
    without any caller is isolated only as an entry.
    """
    entries = targets.select(F.col("entry_symbol").alias("id")).distinct()
    homes = symbols.join(entries, "id", "left_semi").select("module").distinct()
    code = symbols.where("kind IN ('function', 'method')").join(homes, "module", "left_semi").select(F.col("id").alias("node"))
    plain = edges.where("kind = 'references' AND detail NOT IN ('mutated_by', 'registers')").select("source", "target")
    called = code.join(plain.select(F.col("target").alias("node")).distinct(), "node", "left_semi").unionByName(code.join(entries.select(F.col("id").alias("node")), "node", "left_semi")).distinct()
    listed = targets.select(F.explode("lifecycle_dependencies").alias("node")).distinct()
    return fixpoint.isolated(called, plain, listed)


#: Packages that a runner's own process runs.
RUNNER_PACKAGES = {"pytest": ("pytest", "_pytest", "pluggy", "iniconfig"), "doctest": ("doctest",), "asv": ("asv_runner",)}


def _runner_modules(targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """(runner, module) of runners' own packages within the roots."""
    own = [(r, m) for r, ms in RUNNER_PACKAGES.items() for m in ms]
    table = targets.sparkSession.createDataFrame(own, "runner string, root string")
    modules = symbols.where("kind = 'module'").select(F.col("id").alias("module"), F.substring_index("id", ".", 1).alias("root"))
    return table.join(modules, "root").join(targets.select("runner").distinct(), "runner", "left_semi").select("runner", "module")


def make(base_files: DataFrame, head_files: DataFrame, targets: DataFrame, base_targets: DataFrame | None = None, declarations: DataFrame | None = None, patterns: Sequence[tuple[str, str, str | None]] = (), evidence_only: DataFrame | None = None, base: Index | None = None, head: Index | None = None, roots: Sequence[str] = ()) -> Plan:
    """Plan a change.

    ``targets`` are those of the head; ``base_targets`` give new targets and changed lifecycles;
    ``declarations`` have source, target, why; ``patterns`` are always run; ``evidence_only`` (node) restricts
    the seeds to those that recorded execution escalates.  ``roots`` are the source roots that the snapshots were read by: one
    without any module is an error, and files outside of all count only where builds and runners read them.  ``base`` and ``head`` are the files' indexes where there are any.
    """
    spark = targets.sparkSession
    base, head = together(lambda: base or build(base_files), lambda: head or build(head_files))
    changes = dependency_changes(base, head)
    columns = ("id", "kind", "module", "name", "container", "decorated")
    symbols = written(base.symbols.select(*columns).unionByName(head.symbols.select(*columns)).dropDuplicates(["id"]), "symbols")
    modules = symbols.where("kind = 'module'").select(F.col("id").alias("node"))
    pairs = graph.members(symbols)
    targets = written(targets, "targets")
    planned = targets if base_targets is None else written(graph.carried_lifecycle(targets, base_targets), "targets")

    # The graph: both versions' edges, what they imply, and the targets'.
    union = written(graph.union_versions(base.all_edges(), head.all_edges()).select(*graph.ITEM), "union")
    edges = written(graph.without_isolated_writers(union, isolated_code(planned, symbols, union)), "edges")
    unresolved = written(base.unresolved.unionByName(head.unresolved).distinct(), "unresolved")
    slim, shared = graph.factored(planned)
    shared = written(shared, "shared")
    entries, missing = graph.target_edges(slim, symbols)
    escaped = base.escaped.unionByName(head.escaped).distinct()
    hooks = graph.constructor_hooks(edges, symbols, base.bases.unionByName(head.bases).distinct())
    parts = [edges, graph.name_hubs(unresolved, symbols), hooks, graph.fan_out(escaped, pairs)]
    problems = spark.createDataFrame([], "message string")
    if declarations is not None:
        more, errors = graph.declared(declarations, pairs)
        parts.append(more)
        problems = errors.select("message")
    code = written(_all(parts).distinct(), "code")
    mutated = edges.where("kind = 'references' AND detail = 'mutated_by'").select(F.col("source").alias("variable"), F.col("target").alias("writer"))
    calls = written(graph.calls_of(code).distinct(), "calls")
    every = _all([code, graph.caller_effects(calls, mutated, modules), entries, shared])
    deleted = changes.where("array_contains(changes, 'deleted')").select(F.col("id").alias("node"))
    graph_edges = written(graph.with_transfer(every.distinct(), modules, deleted), "graph")

    # The seeds: what changed, and what that makes run differently at import.
    dynamic = unresolved.where("kind = 'dynamic'").select("symbol", F.when(F.col("detail") == "", "unbounded").otherwise("bounded").alias("class")).join(symbols.select(F.col("id").alias("symbol"), "module"), "symbol")
    changed_modules = written(changes.where("carries_impact").select("module").distinct(), "changed")
    runners = _runner_modules(targets, symbols)
    asked = dynamic.select(F.col("module").alias("node")).unionByName(runners.select(F.col("module").alias("node"))).distinct()
    module_of = symbols.select("id", "module")
    writers = mutated.join(module_of.select(F.col("id").alias("variable"), "module"), "variable").join(module_of.select(F.col("id").alias("writer"), F.col("module").alias("writer_module")), "writer").select("module", "writer_module").where("module <> writer_module").distinct()
    reach = graph.import_reach(union, writers, asked)
    at_import = impact.import_time_seeds(changes, symbols)
    seeds = impact.seeds_of(changes)
    if evidence_only is not None:
        seeds = seeds.join(evidence_only, "node", "left_semi")
    state = edges.where("kind = 'references' AND detail = 'mutated_by'").select("source", "target")
    at_top = changes.where("carries_impact").select("id").join(symbols.where("decorated OR kind IN ('module', 'variable', 'class')"), "id", "left_semi").select(F.col("id").alias("node"))
    seeds = seeds.unionByName(at_import).unionByName(impact.import_call_effects(at_top, calls, state, modules))
    dynamic_from = None
    if evidence_only is None:
        importers = changes.where("kind = 'module' AND NOT array_contains(changes, 'added') AND NOT array_contains(changes, 'deleted')").select(F.col("id").alias("node"))
        if not importers.isEmpty():
            newly = written(impact.newly_run(base.edges, head.edges, importers).select("node").distinct(), "newly")
            if not newly.isEmpty():
                effects = impact.import_call_effects(newly, calls, state, modules).join(newly, "node", "left_anti")
                around = impact.bound_on_package(union, symbols, newly, graph.import_reach(union, writers, modules))
                seeds = seeds.unionByName(effects).unionByName(around)
        if not changed_modules.isEmpty():
            dynamic_from = impact.dynamic_seeds(graph.dynamic_class(dynamic.select("symbol", "class")).join(dynamic.select("symbol", "module").distinct(), "symbol"), reach, changed_modules)
            seeds = seeds.unionByName(dynamic_from)
    readers = graph.docstring_readers(union, base.flags.unionByName(head.flags).distinct())
    seeds = seeds.unionByName(impact.docstring_seeds(changes, readers))

    # What they reach, and why.
    impacted = written(impact.propagate(graph_edges, impact.ranked_seeds(seeds)), "impacted")
    hit = impacted.where("node LIKE 'target:%'").select("node")
    relaxed = impact.entry_relaxed(impacted, targets, symbols).join(hit, "node", "left_anti")
    found = written(impacted.unionByName(relaxed.select("node", "mode", F.lit(0).alias("hops"), "via")), "found")
    chains = impact.explained(found, found.where("node LIKE 'target:%'").select("node"), graph_edges)
    if dynamic_from is not None:
        mark = dynamic_from.select(F.col("node").alias("changed_symbol"), F.lit(True).alias("is_dynamic")).join(changes.select(F.col("id").alias("changed_symbol")), "changed_symbol", "left_anti")
        chains = chains.join(mark, "changed_symbol", "left").withColumn("rule", F.when(F.col("is_dynamic"), "dynamic_reference").otherwise(F.col("rule"))).drop("is_dynamic")
    none = F.array().cast("array<string>")
    plain = lambda df: df.select("node", "rule", "detail", none.alias("path"), F.lit(None).cast("string").alias("changed_symbol"))
    reasons = chains.select("node", "rule", F.lit("").alias("detail"), "path", "changed_symbol")

    # Fallbacks for all targets, and what the targets themselves give.
    key = ["path"]
    projects = base_files.unionByName(head_files).where(F.substring_index("path", "/", -1).isin(*PROJECT_FILES)).select(F.regexp_replace("path", "(^|/)[^/]*$", "").alias("folder")).distinct()
    folder = F.regexp_replace("path", "(^|/)[^/]*$", "")
    # A module named as a build script is one at the top or beside a project's own file.
    beside = F.substring_index("path", "/", -1).isin(*BESIDE_PROJECT)
    scripts = lambda f: f.where("role = 'source'").where(build_input("path") & ~beside).unionByName(f.where("role = 'source'").where(beside).withColumn("folder", folder).join(projects.unionByName(projects.sparkSession.createDataFrame([("",)], "folder string")).distinct(), "folder", "left_semi").select(*f.columns))
    other = lambda f: f.where("role = 'other'").unionByName(f.where("role = 'outside'").where(runner_file("path"))).unionByName(scripts(f)).select(*key, "blob_id", "mode")
    global_ = diff.changed_files(other(base_files), other(head_files)).select(F.lit("unanalysed_file_changed").alias("rule"), F.col("path").alias("detail"))
    broken = base.errors.select("path", "message").unionByName(head.errors.select("path", "message")).unionByName(graph.duplicates(base_files)).unionByName(graph.duplicates(head_files)).unionByName(graph.empty_roots(base_files, head_files, list(roots)))
    global_ = global_.unionByName(broken.select(F.lit("analysis_error").alias("rule"), F.concat_ws(": ", "path", "message").alias("detail"))).unionByName(problems.select(F.lit("analysis_error").alias("rule"), F.col("message").alias("detail")))
    global_ = written(global_.distinct(), "fallbacks")
    by_runner = impact.runner_dependencies(runners, reach, changed_modules)
    reasons = reasons.unionByName(plain(missing)).unionByName(plain(impact.for_all(global_, targets))).unionByName(plain(impact.for_all(by_runner, targets)))
    always, _ = impact.always_run(targets, list(patterns))
    reasons = reasons.unionByName(plain(always))
    if base_targets is not None:
        new = diff.new_targets(base_targets, targets).select(graph.target_node().alias("node"), F.lit("new_target").alias("rule"), F.lit("").alias("detail"))
        moved = diff.lifecycle_diff(base_targets, targets).select(graph.target_node().alias("node"), F.lit("lifecycle_changed").alias("rule"), F.concat_ws(",", "added", "removed").alias("detail"))
        reasons = reasons.unionByName(plain(new)).unionByName(plain(moved))
    docs = changes.where("array_contains(changes, 'docstring_changed')").select(F.col("id").alias("entry_symbol"))
    told = targets.join(docs, "entry_symbol", "left_semi").where("runner = 'doctest'").select(graph.target_node().alias("node"), F.lit("entry_docstring_changed").alias("rule"), F.lit("").alias("detail"))
    reasons = written(reasons.unionByName(plain(told)).distinct(), "reasons")
    affected = graph_edges.unionByName(_shared_edges(shared, graph_edges))
    decided = impact.decisions(targets, reasons.select("node", "rule"), affected, found.where(F.col("mode") <= STRUCTURAL))
    return Plan(decided, reasons, changes, global_, impact.unresolved_matches(unresolved, found), found)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select(*graph.ITEM)
    for p in parts[1:]:
        out = out.unionByName(p.select(*graph.ITEM))
    return out


def _shared_edges(shared: DataFrame, like: DataFrame) -> DataFrame:
    """The lifecycle edges behind the shared hubs, for reports of affected dependencies."""
    hub = shared.where("source LIKE 'target:%'").select(F.col("source").alias("t"), F.col("target").alias("hub"))
    deps = shared.where("source LIKE 'runner:%'").select(F.col("source").alias("hub"), "target", "kind", "detail")
    return hub.join(deps, "hub").select(F.col("t").alias("source"), "target", "kind", "detail", F.array(*(F.lit(0),) * 4).alias("xfer")).select(*like.columns)
