"""Measuring plans against what really failed or ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import folded_test

#: Outcomes in their order of folding.
OUTCOMES = ("PASSED", "SKIPPED", "XFAIL", "XPASS", "FAILED", "ERROR")


def junit_key(classname: Column, name: Column) -> Column:
    """A case's key: class path and name without its parameters."""
    return F.concat_ws("::", F.translate(classname, ".", "/"), folded_test(name))


def target_key(runner_id: str = "runner_id", rootdir: str = "") -> Column:
    """A target's key in the same form: path without ending, classes and name, under a root that reports leave out."""
    own = F.regexp_replace(F.col(runner_id), f"^{rootdir.rstrip('/')}/", "") if rootdir else F.col(runner_id)
    path, rest = F.regexp_replace(F.split_part(own, F.lit("::"), F.lit(1)), r"\.py$", ""), F.slice(F.split(own, "::"), 2, F.greatest(F.size(F.split(own, "::")) - 1, F.lit(0)))
    classes, name = F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))), F.element_at(rest, -1)
    return F.concat_ws("::", F.concat_ws("/", path, F.array_join(classes, "/")), folded_test(name))


def matched(cases: DataFrame, targets: DataFrame, rootdir: str = "") -> DataFrame:
    """Cases with the target they stand for, null where none does."""
    t = targets.select(target_key("runner_id", rootdir).alias("key"), "runner_id")
    k = F.regexp_replace(junit_key(F.col("classname"), F.col("name")), "/+::", "::")
    return cases.withColumn("key", k).join(t.withColumn("key", F.regexp_replace("key", "/+::", "::")), "key", "left")


def broken(cases: DataFrame) -> DataFrame:
    """(run, target, cases) of failing targets; a file that fails to load stands for itself (collection)."""
    bad = cases.where("outcome IN ('failed', 'error')")
    kind = F.when((F.coalesce("classname", F.lit("")) == "") & (F.col("outcome") == "error"), "collection").otherwise("test")
    return bad.withColumn("kind", kind).groupBy("run", F.coalesce("runner_id", "name").alias("target"), "kind").agg(F.array_sort(F.collect_set("name")).alias("cases"))


def already_failing(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Broken targets with whether all of their broken cases were broken before."""
    b = baseline.select("target", F.col("cases").alias("before"))
    return now.join(b, "target", "left").withColumn("already", F.coalesce(F.size(F.array_except("cases", "before")) == 0, F.lit(False))).drop("before")


def checked(now: DataFrame, baseline: DataFrame, plan: DataFrame) -> DataFrame:
    """(run, target, kind, cases, already, selected, verdict); ``plan``: target, selected.

    A verdict is ``caught``, ``already``, ``collection`` or ``miss``.
    """
    rows = already_failing(now, baseline).join(plan.select("target", "selected"), "target", "left")
    verdict = F.when(F.col("kind") == "collection", "collection").when(F.col("already"), "already").when(F.coalesce("selected", F.lit(False)), "caught").otherwise("miss")
    return rows.withColumn("verdict", verdict)


def check_totals(rows: DataFrame) -> DataFrame:
    """One row: failures by verdict and whether the plan holds."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return rows.agg(F.count("*").alias("failures"), count("miss").alias("misses"), count("already").alias("already"), count("caught").alias("caught"), count("collection").alias("collection"), (count("miss") == 0).alias("ok"))


def outcome_fold(rows: DataFrame, test: str = "test", outcome: str = "outcome") -> DataFrame:
    """Each test's outcomes, distinct, in their fixed order, joined by ``+``."""
    order = F.array(*map(F.lit, OUTCOMES))
    return rows.groupBy(test).agg(F.collect_set(outcome).alias("seen")).select(test, F.array_join(F.filter(order, lambda x: F.array_contains("seen", x)), "+").alias("outcomes"))


def transitions(base: DataFrame, head: DataFrame, key: str = "test") -> DataFrame:
    """key, before, after, changed over tests of either side."""
    both = base.select(key, F.col("outcomes").alias("before")).join(head.select(key, F.col("outcomes").alias("after")), key, "full_outer")
    return both.withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


def line_owners(spans: DataFrame, changed: DataFrame, structural: DataFrame) -> DataFrame:
    """(path, line, symbol) of the lines of changed symbols, a container's without its members' unless it is structural.

    ``spans``: path, symbol, container, start, end; ``changed``, ``structural``: symbol.
    """
    lines = spans.join(changed, "symbol", "left_semi").select("path", "symbol", F.explode(F.sequence("start", "end")).alias("line"))
    inner = spans.where("container IS NOT NULL").select("path", F.col("container").alias("symbol"), F.explode(F.sequence("start", "end")).alias("line")).distinct()
    hard = inner.join(structural, "symbol", "left_anti")
    return lines.join(hard, ["path", "symbol", "line"], "left_anti")


def attributed(coverage: DataFrame, owners: DataFrame) -> DataFrame:
    """(test_id, symbols): changed symbols each test executed, by lines."""
    return coverage.join(owners, ["path", "line"]).groupBy("test_id").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def merged_coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    both = a.select("test_id", F.col("symbols").alias("x")).join(b.select("test_id", F.col("symbols").alias("y")), "test_id", "full_outer")
    return both.select("test_id", F.array_sort(F.array_union(F.coalesce("x", none), F.coalesce("y", none))).alias("symbols"))


def quality(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """affected, selected, caught, missed, recall, precision, savings of rows (affected, selected)."""
    a, s = F.col("affected"), F.col("selected")
    sums = [F.count("*").alias("n"), F.count_if(a).alias("affected"), F.count_if(s).alias("selected"), F.count_if(a & s).alias("caught"), F.count_if(a & ~s).alias("missed")]
    out = rows.groupBy(*(by or [])).agg(*sums)
    ratio = lambda x, y: F.round(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")), 6)
    return out.withColumns({"recall": ratio("caught", "affected"), "precision": ratio("caught", "selected"), "savings": F.round(1 - F.try_divide(F.col("selected").cast("double"), F.col("n").cast("double")), 6)})


def corpus(entries: DataFrame) -> DataFrame:
    """Pooled recall and precision, mean savings, over entries of ``quality``."""
    total = lambda x: F.sum(x).cast("double")
    return entries.agg(F.count("*").alias("entries"), F.round(F.try_divide(total("caught"), total("affected")), 6).alias("recall"), F.round(F.try_divide(total("caught"), total("selected")), 6).alias("precision"), F.round(F.avg("savings"), 6).alias("mean_savings"), (F.sum("missed") == 0).alias("ok"))


def collection_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    left, right = a.select(column).distinct(), b.select(column).distinct()
    return left.exceptAll(right).withColumn("only", F.lit("first")).unionByName(right.exceptAll(left).withColumn("only", F.lit("second")))


def cause_precision(causes: DataFrame, executed: DataFrame) -> DataFrame:
    """cause, selected, executed, precision; ``executed``: node."""
    rows = causes.join(executed.select("node").distinct().withColumn("hit", F.lit(True)), "node", "left")
    return rows.groupBy("cause").agg(F.count("*").alias("selected"), F.count_if("hit").alias("executed")).withColumn("precision", F.round(F.try_divide(F.col("executed").cast("double"), F.col("selected").cast("double")), 6))
