"""Plans and checks as documents and text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evidence import numbered_by
from tidemark.operators.graph import target_node
from tidemark.plans.engine import Plan

SCHEMA_VERSION = 5


def with_fallback_index(reasons: DataFrame, fallbacks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered fallbacks, reasons that name them by number): global reasons are written once."""
    pairs = fallbacks.select("rule", "detail").distinct()
    numbered = numbered_by(pairs, ["rule", "detail"], "fallback")
    return numbered, reasons.join(numbered, ["rule", "detail"], "left").withColumn("detail", F.when(F.col("fallback").isNull(), F.col("detail")))


def target_documents(plan: Plan) -> DataFrame:
    """One JSON text per target, keys in a fixed order; sinks write them side by side."""
    _, reasons = with_fallback_index(plan.reasons, plan.fallbacks)
    by = reasons.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rule", "changed_symbol", "path", "detail", "fallback"))).alias("reasons"))
    rows = plan.decisions.withColumn("node", target_node()).join(by, "node", "left")
    return rows.select("runner", "runner_id", F.to_json(F.struct("runner", "runner_id", "selected", "rules", "conservative", "affected_dependencies", "unselected_reason", "reasons")).alias("document"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.count("*").alias("targets"), F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("unselected"), F.count_if(F.array_contains("rules", "always_run")).alias("always_run"))


def counts(plan: Plan) -> DataFrame:
    return decision_counts(plan.decisions)


def to_dict(plan: Plan) -> dict:
    """The whole plan as one document, for a plan of a size that a person reads."""
    n = counts(plan).first().asDict()
    docs = [json.loads(r.document) for r in target_documents(plan).orderBy("runner", "runner_id").collect()]
    changes = [r.asDict() for r in plan.changes.select("id", "kind", "changes").orderBy("id").collect()]
    return {"schema_version": SCHEMA_VERSION, "analysis": {"counts": n}, "changed_symbols": changes, "selected_targets": [d for d in docs if d["selected"]], "unselected_targets": [d for d in docs if not d["selected"]]}


def to_text(plan: Plan, shown: int = 20) -> str:
    """Counts, rules and the first selected targets with a chain each."""
    n = counts(plan).first()
    lines = [f"{n.selected} of {n.targets} targets selected"]
    lines += [f"  {r.rule}: {r['count']}" for r in plan.decisions.where("selected").select(F.explode("rules").alias("rule")).groupBy("rule").count().orderBy(F.desc("count"), "rule").collect()]
    for r in plan.reasons.where("size(path) > 0").orderBy("node").limit(shown).collect():
        lines.append(" -> ".join(r.path))
    return "\n".join(lines)


def manifest_document(targets: DataFrame) -> DataFrame:
    """Targets as JSON lines of a manifest."""
    return targets.select(F.to_json(F.struct("runner", "runner_id", "entry_symbol", "lifecycle_dependencies")).alias("value"))


def write_selected(plan: Plan, folder: str) -> None:
    """The identifiers to run, one a line."""
    plan.decisions.where("selected").select(F.col("runner_id").alias("value")).write.mode("overwrite").text(folder)


def check_markdown(totals: DataFrame, rows: DataFrame, shown: int = 50) -> str:
    """A check's totals and the first misses as a table."""
    t = totals.first()
    lines = [f"**{'OK' if t.ok else 'MISSED'}** {t.misses} missed, {t.caught} caught, {t.already} already failing, {t.collection} not loaded", "", "| run | target |", "| --- | --- |"]
    lines += [f"| {r.run} | `{r.target}` |" for r in rows.where("verdict = 'miss'").orderBy("run", "target").limit(shown).collect()]
    return "\n".join(lines)
