"""Seeds, propagation, fallbacks, decisions and their explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import fnmatch_regex
from tidemark.operators import fixpoint
from tidemark.operators.graph import target_node
from tidemark.schema import BEHAVIOR, CONTENT, RULES, STRUCTURAL
from tidemark.tables import bucketed, counted, together


def seeds_of(changes: DataFrame) -> DataFrame:
    """(node, mode, rank): what changed, structural or in behaviour."""
    mode = F.when(F.col("structural"), STRUCTURAL).otherwise(BEHAVIOR)
    return changes.where("carries_impact").select(F.col("id").alias("node"), mode.alias("mode"), F.lit(0).alias("rank"))


def import_time_seeds(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Modules of changes that run at import: module code, variables, classes and decorated definitions."""
    runs = symbols.select("id", "module", F.coalesce("decorated", F.lit(False)).alias("decorated"), F.col("kind").alias("k"))
    own = changes.where("carries_impact").select("id").join(runs, "id").where("decorated OR k IN ('module', 'variable', 'class')")
    return own.select(F.col("module").alias("node"), F.lit(BEHAVIOR).alias("mode"), F.lit(1).alias("rank")).distinct()


def import_call_effects(roots: DataFrame, calls: DataFrame, mutated: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """Variables (node, mode content) written by what import-time code that runs differently (``roots``: node) calls: forward, then one join.

    A module that is called into is not entered further: naming it runs none of its code.
    """
    own = roots.select("node").distinct()
    if modules is not None:
        inner = modules.select(F.col("node").alias("source")).join(own.select(F.col("node").alias("source")), "source", "left_anti")
        calls = calls.join(inner, "source", "left_anti")
    reached = fixpoint.reachable(calls, own)
    hit = mutated.select(F.col("source").alias("variable"), F.col("target").alias("node")).join(reached, "node", "left_semi")
    return hit.select(F.col("variable").alias("node"), F.lit(CONTENT).alias("mode"), F.lit(2).alias("rank")).distinct()


def newly_run(base_edges: DataFrame, head_edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(origin, node, change): modules that importing an origin runs in one version only."""
    own = lambda e, bit: e.where("kind = 'imports'").select("source", "target", F.lit(bit).alias("mask"))
    return newly_run_by(own(base_edges, 1).unionByName(own(head_edges, 2)), modules)


def newly_run_by(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """``newly_run`` of edges whose ``mask`` has bit 0 in the base and bit 1 in the head: one search for both."""
    got = fixpoint.variants(imports, modules, 3, ("origin", "node")).where("mask <> 3")
    return got.select("origin", "node", F.when(F.col("mask") == 2, "run").otherwise("not_run").alias("change"))


def bound_on_package(edges: DataFrame, symbols: DataFrame, newly: DataFrame, reach: DataFrame) -> DataFrame:
    """Readers (node) of newly run modules (node) or their members whose own module's imports never reach these."""
    module_of = symbols.select("id", "module")
    into = edges.where("kind = 'references'").select("source", F.col("target").alias("id")).join(module_of, "id").join(newly.select(F.col("node").alias("module")), "module", "left_semi")
    placed = into.select("source", F.col("module").alias("node")).join(module_of.select(F.col("id").alias("source"), F.col("module").alias("origin")), "source")
    lost = placed.join(reach.select("origin", "node"), ["origin", "node"], "left_anti").where("origin <> node")
    return lost.select(F.col("source").alias("node"), F.lit(BEHAVIOR).alias("mode"), F.lit(3).alias("rank")).distinct()


def docstring_seeds(changes: DataFrame, readers: DataFrame) -> DataFrame:
    doc = changes.where("array_contains(changes, 'docstring_changed')").select(F.col("id").alias("symbol"))
    return readers.join(doc, "symbol", "left_semi").select(F.col("reader").alias("node"), F.lit(BEHAVIOR).alias("mode"), F.lit(3).alias("rank")).distinct()


def dynamic_seeds(dynamic: DataFrame, reach: DataFrame, changed_modules: DataFrame) -> DataFrame:
    """Dynamic references that are unbounded, or whose module's import reach meets a changed module."""
    hot = reach.join(changed_modules.select(F.col("module").alias("node")), "node", "left_semi").select(F.col("origin").alias("module")).distinct().withColumn("hot", F.lit(True))
    rows = dynamic.join(hot, "module", "left").where("class = 'unbounded' OR (class <> 'excluded' AND hot)")
    return rows.select(F.col("symbol").alias("node"), F.lit(BEHAVIOR).alias("mode"), F.lit(4).alias("rank")).distinct()


def ranked_seeds(seeds: DataFrame) -> DataFrame:
    """One mode per node: that of the least rank, but for call effects (rank 2), which may raise it."""
    return seeds.groupBy("node").agg(F.min_by("mode", "rank").alias("first"), F.max(F.when(F.col("rank") == 2, F.col("mode"))).alias("effect")).select("node", F.greatest("first", F.coalesce("effect", F.lit(0))).alias("mode"))


def kind_tie(kind: Column) -> Column:
    """Where a kind stands beside the two that give rules of their own; the least kind of a pair of nodes counts."""
    return F.when(kind.isNull() | (kind < "declared"), 0).when(kind == "declared", 1).when(kind < "unresolved_name_match", 2).when(kind == "unresolved_name_match", 3).otherwise(4)


def propagate(edges: DataFrame, seeds: DataFrame, limit: int = 10_000, tie: bool = False) -> DataFrame:
    """``fixpoint.impact``; with ``tie``, rows also have the least ``kind_tie`` of the edges to their ``via``, for ``explained``."""
    return fixpoint.impact(edges.withColumn("tie", kind_tie(F.col("kind"))) if tie else edges, seeds.select("node", "mode"), limit, tie)


def entry_relaxed(impacted: DataFrame, targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """(node, mode, via) of targets whose entry's module is hit: the runner imports it to reach them.  After the search."""
    own = targets.select(target_node().alias("node"), F.col("entry_symbol").alias("id")).join(symbols.select("id", F.col("module").alias("via")), "id")
    return own.join(impacted.select(F.col("node").alias("via")), "via", "left_semi").select("node", F.lit(BEHAVIOR).alias("mode"), "via").distinct()


def explained(impacted: DataFrame, wanted: DataFrame, edges: DataFrame | None = None, limit: int = 10_000) -> DataFrame:
    """(node, path, changed_symbol, rule): one shortest chain from each wanted node to a seed.

    Follows ``via``, a step a round, which carries on the open chains alone.  A name match on the way gives
    ``unresolved_name_match``, else a declared edge gives ``declared_dependency``, else ``dependency``.
    Where ``impacted`` has no ``tie`` (see ``propagate``), it is looked up in ``edges``.
    """
    if edges is not None:
        pairs = impacted.select(F.col("node").alias("source"), F.col("via").alias("target"))
        ties = edges.select("source", "target", kind_tie(F.col("kind")).alias("tie")).join(pairs, ["source", "target"], "left_semi").groupBy("source", "target").agg(F.min("tie").alias("tie"))
        impacted = pairs.join(ties, ["source", "target"], "left").select(F.col("source").alias("node"), F.col("target").alias("via"), "tie")
    weight = F.when(F.col("tie") == 3, 2).when(F.col("tie") == 1, 1).otherwise(0)
    steps, _ = bucketed(impacted.select(F.col("node").alias("at"), F.col("via").alias("to"), weight.alias("more")), "steps", "at")
    first = wanted.select("node").distinct().join(steps.select(F.col("at").alias("node")), "node", "left_semi")
    walk, n = counted(first.select("node", F.col("node").alias("at"), F.array("node").alias("path"), F.lit(0).alias("weight")), "walk")
    parts = [walk]
    for _ in range(limit + 1):
        if not n:
            break
        on = F.when(F.col("to").isNotNull(), F.array_append("path", F.col("to"))).otherwise(F.col("path"))
        walk, n = counted(parts[-1].where("at IS NOT NULL").join(steps, "at").select("node", F.col("to").alias("at"), on.alias("path"), F.greatest("weight", "more").alias("weight")), "walk")
        parts.append(walk)
    else:
        raise fixpoint.NotConverged("explanations")
    ended = [p.where("at IS NULL") for p in parts]
    walk = ended[0]
    for part in ended[1:]:
        walk = walk.unionByName(part)
    rule = F.when(F.col("weight") == 2, "unresolved_name_match").when(F.col("weight") == 1, "declared_dependency").otherwise("dependency")
    hub = lambda x: ~x.rlike("^(name:|runner:|calls:|log:)|<imports>$")
    return walk.select("node", F.filter("path", hub).alias("path"), F.element_at("path", -1).alias("changed_symbol"), rule.alias("rule"))


def for_all(reasons: DataFrame, targets: DataFrame) -> DataFrame:
    """Global fallbacks (rule, detail) for every target, or every target of their ``runner`` if they have one.

    The fallbacks are few, runners fewer; each target gets its runner's array of them, so targets are read once.
    """
    runners = [] if "runner" in reasons.columns else [r.runner for r in targets.select("runner").distinct().collect()]  # names of test runners, a handful
    every = reasons if "runner" in reasons.columns else reasons.select("rule", "detail").distinct().withColumn("runner", F.explode(F.array(*map(F.lit, runners)).cast("array<string>")))
    lists = every.groupBy("runner").agg(F.array_sort(F.collect_set(F.struct("rule", "detail"))).alias("all"))
    return targets.join(lists, "runner").select(target_node().alias("node"), F.explode("all").alias("x")).select("node", "x.rule", "x.detail")


def runner_dependencies(runner_modules: DataFrame, reach: DataFrame, changed_modules: DataFrame) -> DataFrame:
    """(runner, rule, detail): runners whose own modules reach a changed module."""
    hit = runner_modules.join(reach, F.col("module") == F.col("origin")).join(changed_modules.select(F.col("module").alias("node")), "node", "left_semi")
    return hit.groupBy("runner").agg(F.min("node").alias("detail")).select("runner", F.lit("runner_dependency").alias("rule"), "detail")


def always_run(targets: DataFrame, patterns: list[tuple[str, str, str | None]]) -> tuple[DataFrame, DataFrame]:
    """Reasons for targets that match (label, pattern, runner or None), and (label, matches) of every pattern."""
    if not patterns:
        none = targets.select(target_node().alias("node"), F.lit("always_run").alias("rule"), F.lit("").alias("detail")).limit(0)
        return none, none.groupBy(F.col("detail").alias("label")).agg(F.count("*").alias("matches"))
    fits = lambda pattern, runner: F.col("runner_id").rlike(fnmatch_regex(pattern)) & (F.lit(True) if runner is None else F.col("runner") == runner)
    rows = targets.withColumn("pattern", F.explode(F.array_compact(F.array(*(F.when(fits(p, r), F.lit(label)) for label, p, r in patterns)))))
    reasons = rows.select(target_node().alias("node"), F.lit("always_run").alias("rule"), F.col("pattern").alias("detail"))
    labels = targets.sparkSession.createDataFrame([(x[0],) for x in patterns], "label string")
    counts = labels.join(reasons.groupBy(F.col("detail").alias("label")).agg(F.count("*").alias("matches")), "label", "left").select("label", F.coalesce("matches", F.lit(0)).alias("matches"))
    return reasons, counts


def conservative(rule: Column) -> Column:
    return rule.isin(*(r for r, (c, _) in RULES.items() if c))


def decisions(targets: DataFrame, reasons: DataFrame, edges: DataFrame | None = None, impacted: DataFrame | None = None) -> DataFrame:
    """runner, runner_id, selected, rules, conservative, affected_dependencies, unselected_reason.

    ``reasons``: node, rule.  Affected dependencies are the entry and lifecycle symbols that are impacted.
    """
    by = reasons.groupBy("node").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    rows = targets.select("runner", "runner_id", target_node().alias("node")).join(by, "node", "left")
    none = F.array().cast("array<string>")
    if edges is not None and impacted is not None:
        hit = edges.where("kind IN ('entry', 'lifecycle')").join(impacted.select(F.col("node").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_set("target")).alias("affected_dependencies"))
        rows = rows.join(hit, "node", "left")
    else:
        rows = rows.withColumn("affected_dependencies", none)
    selected = F.col("rules").isNotNull()
    hard = F.forall(F.coalesce("rules", none), lambda r: conservative(r)) & selected
    return rows.select("runner", "runner_id", selected.alias("selected"), F.coalesce("rules", none).alias("rules"), hard.alias("conservative"), F.coalesce("affected_dependencies", none).alias("affected_dependencies"), F.when(~selected, "no change reaches it").alias("unselected_reason"))


def unresolved_matches(unresolved: DataFrame, impacted_symbols: DataFrame) -> DataFrame:
    """Unresolved references with the impacted symbols of that short name, as a sorted list."""
    hit = impacted_symbols.select(F.substring_index("node", ".", -1).alias("name"), "node")
    return unresolved.join(hit, "name").groupBy("symbol", "kind", "name").agg(F.array_sort(F.collect_set("node")).alias("matched"))


def causes(full: DataFrame, no_dynamic: DataFrame, no_names: DataFrame, neither: DataFrame) -> DataFrame:
    """(node, cause) of selected nodes by four selections: with all edges, without dynamic ones, without name matches, without both."""
    flag = lambda df, name: df.select("node").distinct().withColumn(name, F.lit(True))
    rows = full.select("node").distinct().join(flag(no_dynamic, "d"), "node", "left").join(flag(no_names, "n"), "node", "left").join(flag(neither, "b"), "node", "left")
    cause = F.when(F.col("b"), "precise").when(F.col("d").isNull() & F.col("n").isNull(), "either").when(F.col("d").isNull(), "dynamic").when(F.col("n").isNull(), "names").otherwise("both")
    return rows.select("node", cause.alias("cause"))


#: Bits of an edge: in the whole graph, without dynamic edges, without name matches, without both.
CAUSES = 15


def edge_mask(dynamic: Column, name: Column) -> Column:
    """The bits of ``CAUSES`` of an edge."""
    return F.lit(1) + F.when(dynamic, 0).otherwise(2) + F.when(name, 0).otherwise(4) + F.when(dynamic | name, 0).otherwise(8)


def causes_by(reached: DataFrame) -> DataFrame:
    """``causes`` of rows (node, mask) by the bits of ``CAUSES``."""
    has = lambda bit: F.col("mask").bitwiseAND(F.lit(bit)) != 0
    cause = F.when(has(8), "precise").when(~has(2) & ~has(4), "either").when(~has(2), "dynamic").when(~has(4), "names").otherwise("both")
    return reached.where(has(1)).select("node", cause.alias("cause"))
