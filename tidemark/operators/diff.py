"""What differs between two versions: symbols, files, dependencies, targets."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fixpoint import closure


def changed_keys(base: DataFrame, head: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, status: added, deleted, or changed with the columns that differ (null-safe)."""
    b, h = base.select(key, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(1).alias("in_b")), head.select(key, *(F.col(c).alias(f"h_{c}") for c in columns), F.lit(1).alias("in_h"))
    both = b.join(h, key, "full_outer")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"h_{c}")), F.lit(c)) for c in columns)))
    status = F.when(F.col("in_b").isNull(), "added").when(F.col("in_h").isNull(), "deleted").when(F.size(differs) > 0, "changed")
    return both.select(key, status.alias("status"), F.when(status == "changed", differs).otherwise(F.array().cast("array<string>")).alias("columns")).where("status IS NOT NULL")


def is_subsequence(a: Column, b: Column) -> Column:
    """Whether array a is b with elements left out: one pass over b that counts how much of a it met."""
    return F.aggregate(b, F.lit(0), lambda k, x: F.when((k < F.size(a)) & F.get(a, k).eqNullSafe(x), k + 1).otherwise(k)) == F.size(a)


def order_differs(a: Column, b: Column) -> Column:
    """Whether common elements stand in another order, in arrays without repeats: each array keeps its own order of them."""
    return F.array_intersect(a, b) != F.array_intersect(b, a)


def _reordered(a: list, b: list) -> bool:
    """Whether common elements, as often as both have them, stand in another order.

    The longest common subsequence as a longest ascending one: over the places in b of each element of a, from the last down, so
    lists without repeats take n log n steps.
    """
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    places: dict = {}
    for i, x in enumerate(b):
        places.setdefault(x, []).append(i)
    common = sum(min(n, len(places.get(x, ()))) for x, n in Counter(a).items())
    ends: list[int] = []
    for x in a:
        for i in reversed(places.get(x, ())):
            at = bisect_left(ends, i)
            ends[at : at + 1] = [i]
    return len(ends) < common


def _reordered_columns(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and _reordered(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def reordered(a: Column, b: Column) -> Column:
    return F.pandas_udf(_reordered_columns, "boolean")(a, b)


def signatures(edges: DataFrame, unresolved: DataFrame, external: DataFrame) -> DataFrame:
    """id, deps: the sorted set of what each symbol depends on, membership aside.

    Entries are structs (cls, kind, target, detail) with cls edge, unresolved or external.
    """
    entry = lambda cls, kind, target, detail: F.struct(F.lit(cls).alias("cls"), kind.alias("kind"), target.alias("target"), detail.alias("detail"))
    c, none = F.col, F.lit("")
    every = (
        edges.where("kind <> 'defined_in'").select(c("source").alias("id"), entry("edge", c("kind"), c("target"), F.coalesce("detail", none)).alias("dep"))
        .unionByName(unresolved.select(c("symbol").alias("id"), entry("unresolved", c("kind"), c("name"), F.coalesce("detail", none)).alias("dep")))
        .unionByName(external.select(c("symbol").alias("id"), entry("external", none, c("module"), none).alias("dep")))
    )
    return every.groupBy("id").agg(F.array_sort(F.collect_set("dep")).alias("deps"))


def lost_and_gained(before: Column, after: Column) -> tuple[Column, Column]:
    return F.array_except(before, after), F.array_except(after, before)


def import_closures(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(origin, node): the modules that importing each module runs."""
    runtime = edges.where("kind = 'imports'").select("source", "target")
    return closure(runtime, modules.select(F.col("id").alias("node")))


def classify(base: DataFrame, head: DataFrame, base_deps: DataFrame, head_deps: DataFrame, failed_base: DataFrame, failed_head: DataFrame, touched_modules: DataFrame | None = None, closures: DataFrame | None = None) -> DataFrame:
    """id, kind, module, changes, carries_impact, structural: the change ladder over two symbol tables.

    ``*_deps`` come from ``signatures``; ``failed_*`` have a column module.  Newly imported modules matter when
    their closure in the head (``closures``) meets ``touched_modules``; without these tables they always do.
    """
    own = ["kind", "module", "body_hash", "definition_hash", "docstring_hash", "annotation_hash", "imports", "import_layout", "statement_layout", "defers_annotations"]
    side = lambda df, deps, s: df.join(deps, "id", "left").select("id", *(F.col(c).alias(f"{s}_{c}") for c in own), F.coalesce("deps", F.from_json(F.lit("[]"), "array<struct<cls:string,kind:string,target:string,detail:string>>")).alias(f"{s}_deps"), F.lit(1).alias(f"in_{s}"))
    both = side(base, base_deps, "b").join(side(head, head_deps, "h"), "id", "full_outer").withColumn("kind", F.coalesce("h_kind", "b_kind")).withColumn("module", F.coalesce("h_module", "b_module"))
    bad = lambda df, name: df.select("module").distinct().withColumn(name, F.lit(True))
    rows = both.join(bad(failed_base, "bad_b"), "module", "left").join(bad(failed_head, "bad_h"), "module", "left")
    rows = rows.where("(in_b = 1 AND in_h = 1) OR (in_h = 1 AND bad_b IS NULL) OR (in_b = 1 AND bad_h IS NULL)")
    c, none = F.col, F.array().cast("array<string>")
    same = lambda x: c(f"b_{x}").eqNullSafe(c(f"h_{x}"))
    arr = lambda x: F.coalesce(c(x), none)
    met = c("in_b").isNotNull() & c("in_h").isNotNull()
    body = met & ~same("body_hash")
    doc = met & ~body & ~same("docstring_hash")
    future = lambda s: F.exists(arr(f"{s}_imports"), lambda x: x.startswith("__future__"))
    only_imports = (c("kind") == "module") & (F.size(F.array_except(arr("b_imports"), arr("h_imports"))) == 0) & is_subsequence(arr("b_import_layout"), arr("h_import_layout")) & (future("b") == future("h"))
    kinds_differ = met & ~same("kind")
    definition_differs = met & ~kinds_differ & ~same("definition_hash")
    imports_added = definition_differs & only_imports
    definition = kinds_differ | (definition_differs & ~only_imports)
    moved = met & ~definition & c("kind").isin("module", "class") & ~same("statement_layout") & order_differs(arr("b_statement_layout"), arr("h_statement_layout"))
    definition = definition | moved
    annotated = met & ~same("annotation_hash") & ~definition
    deferred = F.coalesce(c("b_defers_annotations"), F.lit(False)) & F.coalesce(c("h_defers_annotations"), F.lit(False))
    definition = definition | (annotated & ~deferred)
    # A change of code hides changes of what is unresolved or external.
    plain = lambda s: F.when(body | definition, F.filter(c(f"{s}_deps"), lambda x: x["cls"] == "edge")).otherwise(c(f"{s}_deps"))
    before, after = plain("b"), plain("h")
    lost, gained = lost_and_gained(before, after)
    resolved_now = F.exists(lost, lambda x: x["cls"] == "unresolved")
    really_lost = F.exists(lost, lambda x: x["cls"] != "unresolved")
    new_modules = F.transform(F.filter(gained, lambda x: x["kind"] == "imports"), lambda x: x["target"])
    rows = rows.withColumn("new_modules", F.when(met & (c("kind") == "module"), new_modules).otherwise(none))
    if touched_modules is not None and closures is not None:
        hot = closures.join(touched_modules.select(F.col("module").alias("node")), "node", "left_semi").select(F.col("origin").alias("new_module")).distinct()
        matter = rows.select("id", F.explode("new_modules").alias("new_module")).join(hot, "new_module", "left_semi").select("id").distinct().withColumn("matter", F.lit(True))
        rows = rows.join(matter, "id", "left")
    else:
        rows = rows.withColumn("matter", F.size("new_modules") > 0)
    matters = F.coalesce(c("matter"), F.lit(False)) | F.exists(gained, lambda x: (x["cls"] == "edge") & ~x["kind"].isin("imports", "imports_name"))
    differs = met & ((F.size(lost) > 0) | (F.size(gained) > 0))
    dep_changed = differs & really_lost
    dep_added = differs & ~really_lost & ((c("kind") != "module") | resolved_now | matters)
    more_imports = differs & ~really_lost & ~dep_added
    late = met & ~differs & (c("kind") == "module") & imports_added & F.coalesce(c("matter"), F.lit(False))
    flags = [
        ("added", c("in_b").isNull()), ("deleted", c("in_h").isNull()), ("body_changed", body), ("docstring_changed", doc), ("definition_changed", definition),
        ("annotations_changed", annotated & deferred), ("dependencies_changed", dep_changed), ("dependencies_added", dep_added | late), ("imports_added", imports_added | more_imports),
    ]
    changes = F.array_compact(F.array(*(F.when(F.coalesce(f, F.lit(False)), F.lit(k)) for k, f in flags)))
    out = rows.select("id", "kind", "module", changes.alias("changes")).where("size(changes) > 0")
    return out.select("*", carries_impact("changes").alias("carries_impact"), structural("changes", "kind").alias("structural"))


def carries_impact(changes: str) -> Column:
    return F.size(F.array_except(F.col(changes), F.array(F.lit("imports_added"), F.lit("docstring_changed")))) > 0


def structural(changes: str, kind: str) -> Column:
    hard = F.arrays_overlap(F.col(changes), F.array(*map(F.lit, ("added", "deleted", "definition_changed", "dependencies_changed"))))
    return hard | ((F.col(kind) == "class") & F.array_contains(F.col(changes), "body_changed"))


def changed_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, status of files whose blob or mode differs."""
    return changed_keys(base, head, "path", ["blob_id", "mode"]).select("path", "status")


def lifecycle_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """runner, runner_id, added, removed: sorted dependencies of targets on both sides that differ."""
    key = ["runner", "runner_id"]
    both = base.select(*key, F.col("lifecycle_dependencies").alias("b")).join(head.select(*key, F.col("lifecycle_dependencies").alias("h")), key)
    out = both.select(*key, F.array_sort(F.array_except("h", "b")).alias("added"), F.array_sort(F.array_except("b", "h")).alias("removed"))
    return out.where((F.size("added") > 0) | (F.size("removed") > 0))


def new_targets(base: DataFrame, head: DataFrame) -> DataFrame:
    return head.join(base.select("runner", "runner_id"), ["runner", "runner_id"], "left_anti")


def native_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, level, name for extension modules: function bodies, then names outside functions, else the file.

    Inputs: path, scope ('function', 'name' or 'file'), name, digest.
    """
    key = ["path", "scope", "name"]
    both = base.select(*key, F.col("digest").alias("b")).join(head.select(*key, F.col("digest").alias("h")), key, "full_outer")
    return both.where(~F.col("b").eqNullSafe(F.col("h"))).select("path", F.col("scope").alias("level"), "name")
