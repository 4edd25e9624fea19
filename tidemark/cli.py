"""Commands: ``python -m tidemark plan|discover|check|report|evidence``.

Exit codes: 0 fine, 1 a check failed, 2 wrong use.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        return commands.add_parser(name, help=text)

    plan = command("plan", "select the targets that a change can reach")
    plan.add_argument("--repo", default=".")
    plan.add_argument("--base", required=True)
    plan.add_argument("--head", default="WORKTREE")
    plan.add_argument("--targets", help="a manifest; without it pytest targets are discovered")
    plan.add_argument("--discover", choices=("pytest",), help="discover targets besides those of the manifest, which count first")
    plan.add_argument("--declarations", help="a TOML file of edges, always-run patterns and exclusions")
    plan.add_argument("--source-root", action="append", default=[])
    plan.add_argument("--format", choices=("text", "json"), default="text")
    discover = command("discover", "list targets")
    discover.add_argument("--repo", default=".")
    discover.add_argument("--rev", default="WORKTREE")
    discover.add_argument("--runner", choices=("pytest", "asv"), default="pytest")
    discover.add_argument("--source-root", action="append", default=[])
    check = command("check", "hold a plan against test results")
    check.add_argument("--plan", required=True)
    check.add_argument("--full", required=True, help="JUnit results of the whole suite")
    check.add_argument("--baseline", help="JUnit results before the change")
    report = command("report", "roll artifacts up by cell")
    report.add_argument("--dir", required=True)
    evidence = command("evidence", "list stores of recordings")
    evidence.add_argument("--dir", required=True)
    return p


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidemark").getOrCreate()


def _plan(o: argparse.Namespace) -> int:
    from tidemark.discovery.pytest_rules import discover
    from tidemark.extract.index import build
    from tidemark.operators import graph
    from tidemark.plans import engine, report
    from tidemark.sources import documents, snapshots

    spark, roots = _spark(), o.source_root or [""]
    edges, always, out = [], [], []
    if o.declarations:
        with open(o.declarations, encoding="utf-8") as f:
            edges, always, out, problems = documents.parse_declarations(f.read())
        if problems:
            print("\n".join(problems), file=sys.stderr)
            return 2
    base, head = (snapshots.read_git(spark, o.repo, r, s, roots, out).cache() for r, s in ((o.base, "base"), (o.head, "head")))
    old, new = build(base), build(head)
    targets = before = None
    if o.targets:
        with open(o.targets, encoding="utf-8") as f:
            targets = documents.read_manifest(spark, f.read())
    if o.discover or not o.targets:
        found, before = discover(new), discover(old)
        if targets is not None:
            before = graph.merged_targets(targets, before)
        targets = found if targets is None else graph.merged_targets(targets, found)
    declared = spark.createDataFrame(edges, "source string, target string, why string") if edges else None
    plan = engine.make(base, head, targets, before, declared, always, base=old, head=new, roots=roots)
    print(json.dumps(report.to_dict(plan), indent=2, sort_keys=True) if o.format == "json" else report.to_text(plan))
    return 0


def _discover(o: argparse.Namespace) -> int:
    from tidemark.discovery.pytest_rules import discover, discover_benchmarks
    from tidemark.extract.index import build
    from tidemark.plans import report
    from tidemark.sources import snapshots

    index = build(snapshots.read_git(_spark(), o.repo, o.rev, "head", o.source_root or [""]))
    rows = (discover if o.runner == "pytest" else discover_benchmarks)(index)
    for r in report.manifest_document(rows).orderBy("value").toLocalIterator():
        print(r.value)
    return 0


def _check(o: argparse.Namespace) -> int:
    from tidemark.operators import validate
    from tidemark.plans import report
    from tidemark.sources import documents

    spark = _spark()
    plan = documents.read_plan(spark, o.plan).select("runner_id", "selected")
    failed = lambda path: validate.broken(validate.matched(documents.read_junit(spark, path, "full"), plan))
    now = failed(o.full)
    rows = validate.checked(now, failed(o.baseline) if o.baseline else now.limit(0), plan.withColumnRenamed("runner_id", "target"))
    totals = validate.check_totals(rows)
    print(report.check_markdown(totals, rows))
    return 0 if totals.first().ok else 1


def _report(o: argparse.Namespace) -> int:
    from tidemark.operators import rollup
    from tidemark.sources import documents

    schema = "action string, cell string, event string, created_at string, selected int, total int, always_run int, misses int, incomplete boolean"
    rows = documents.read_artifacts(_spark(), o.dir, schema)
    sound, broken = rollup.sound(rollup.trusted(rows), ["action", "cell"])
    for r in rollup.cells(sound, ["cell"]).orderBy("cell").collect():
        print(json.dumps(r.asDict()))
    print(json.dumps({"malformed": broken.count()}))
    return 0


def _evidence(o: argparse.Namespace) -> int:
    from tidemark.sources import stores

    for r in stores.list_stores(_spark(), o.dir).orderBy("store_id").toLocalIterator():
        print(r.store_id, r["count"])
    return 0


def main(args: Sequence[str] | None = None) -> int:
    o = parser().parse_args(args)
    return {"plan": _plan, "discover": _discover, "check": _check, "report": _report, "evidence": _evidence}[o.command](o)
