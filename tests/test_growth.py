"""Steps that grow with the input: what is read, shuffled and joined once, on small tables with odd rows."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence, fixpoint, graph, impact, literals

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def plans(monkeypatch):
    """(name, plan) of the tables that loops count."""
    seen, counted = [], fixpoint.counted

    def looking(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return counted(df, name)

    monkeypatch.setattr(fixpoint, "counted", looking)
    return seen


def test_a_round_of_literals_counts_known_and_new_rows_together(spark, plans):
    edges = spark.createDataFrame([("a", "b", None, "x"), ("b", "c", "y", None), ("b", "c", "y", None), ("c", "b", "", "z"), ("d", "b", None, None), (None, "b", "", "")], "source string, target string, before string, after string")
    first = spark.createDataFrame([("a", "1", False), ("d", None, True), ("e", "2", None), ("e", "2", False)], "node string, value string, any boolean")
    got = {tuple(r) for r in literals.literal_sets(edges, first, most=3).collect()}
    assert got == {("a", "1", False), ("b", "", True), ("c", "", True), ("d", "", True), ("e", "2", False)}
    rounds = [p for n, p in plans if n == "literals"][1:]
    assert rounds and all(p.count("Join") == 1 for p in rounds)


def test_a_last_round_of_many_rows_ends_before_it_meets_the_state(spark, plans, monkeypatch):
    monkeypatch.setattr(fixpoint, "MANY", 0)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("x", "c")], "source string, target string")
    got = {tuple(r) for r in fixpoint.closure(edges, spark.createDataFrame([("a",), ("c",)], "node string")).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("c", "c")} and len([n for n, _ in plans if n == "closure"]) == 3


def test_isolated_reads_its_references_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def through(batches):
        runs.add(1)
        yield from batches

    refs = spark.createDataFrame([("m", "n"), ("out", "o"), ("o", "p"), ("q", "q"), (None, "r"), ("named", "s"), ("m", None)], "source string, target string").coalesce(1).mapInArrow(through, "source string, target string")
    members = spark.createDataFrame([(x,) for x in ["m", "n", "o", "p", "q", "r", "named", "s"]], "node string")
    got = {r.node for r in fixpoint.isolated(members, refs, spark.createDataFrame([("named",), ("else",)], "node string")).collect()}
    assert got == {"m", "n", "q"} and runs.value == 1


def test_touched_ancestors_in_cells_make_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(evidence, "PLACE_ROWS", 2)
    touched = [("t1", "a"), ("t1", "a/b"), ("t1", "a/b/f1"), ("t2", "a/b"), (None, "a"), (None, "a/b"), ("t3", None), ("t4", "a/b/f2"), ("t4", "a/b/f2"), ("t5", "a/")] + [(f"u{i}", "a") for i in range(7)]
    changed = [f"a/b/f{i}" for i in range(7)] + ["a", "c/d", "", None, "a/b/f1"]
    frame = evidence.touched_ancestors(spark.createDataFrame(touched, "test_id string, path string"), spark.createDataFrame([(c,) for c in changed], "path string"))
    above = lambda p: {"/".join(p.split("/")[:k + 1]) for k in range(len(p.split("/")))}
    want = {(t, c) for t, p in touched for c in changed if c is not None and p in above(c)}
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Aggregate" not in frame.where(F.lit(True))._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]


@pytest.fixture
def reads(spark, monkeypatch):
    """How often each table is read by the catalogue's queries."""
    from tidemark.plans import catalog

    seen = {}

    class Reading(catalog.Tables):
        def __getattr__(self, name):
            frame, runs = super().__getattr__(name), seen.setdefault(name, spark.sparkContext.accumulator(0))

            def through(batches):
                runs.add(1)
                yield from batches

            return frame.coalesce(1).mapInArrow(through, frame.schema)

    monkeypatch.setattr(catalog, "Tables", Reading)
    return seen


def against_sql(spark, name):
    import duckdb

    from tidemark.plans.catalog_paths import ORACLES, QUERIES

    db = duckdb.connect()
    for table in ("part", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {table} AS FROM read_parquet('{DATA}/{table}.parquet')")
    got, want = QUERIES[name](spark, DATA), db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_explanations_read_the_edges_once(spark, reads):
    against_sql(spark, "q25_shortest_explanation")
    assert reads["lineitem"].value == 1 and reads["orders"].value == 1


@pytest.mark.parametrize("hub", [50_000, 1])
def test_an_explanation_takes_the_least_kind_of_all_edges_of_a_pair(spark, monkeypatch, hub):
    monkeypatch.setattr(fixpoint, "HUB", hub)  # of 1: nodes with two edges are salted
    rows = [
        ("b", "a", "unresolved_name_match", [3, 3, 3, 3]), ("c", "a", "unresolved_name_match", [3, 3, 3, 3]), ("c", "a", "references", [0, 0, 0, 0]), ("d", "a", "declared", [0, 0, 0, 0]), ("d", "a", "references", [3, 3, 3, 3]), ("d", "a", "references", [3, 3, 3, 3]),
        ("e", "a", "declared", [3, 3, 3, 3]), ("e", "a", "a_kind", [0, 0, 0, 0]), ("f", "a", None, [0, 0, 0, 0]), ("f", "a", "unresolved_name_match", [3, 3, 3, 3]), ("g", "a", "z_kind", [0, 0, 3, 3]), ("h", "d", "unresolved_name_match", [3, 3, 3, 3]), ("i", "d", "references", [1, 1, 1, 1]), ("a", "i", "references", [4, 4, 4, 4]), ("j", "a", "references", [0, 0, 0, 3]),
    ]
    edges = spark.createDataFrame(rows, "source string, target string, kind string, xfer array<int>")
    seeds = spark.createDataFrame([("a", 3)], "node string, mode int")
    plain, found = impact.propagate(edges, seeds), impact.propagate(edges, seeds, tie=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, found.drop("tie").collect()))
    edges = edges.where("source <> 'a'")  # its mode is raised on a circle, which has no end
    seeds = spark.createDataFrame([("a", 4)], "node string, mode int")
    found = impact.propagate(edges, seeds, tie=True)
    want = {"a": (["a"], "dependency"), "b": (["b", "a"], "unresolved_name_match"), "c": (["c", "a"], "dependency"), "d": (["d", "a"], "declared_dependency"), "e": (["e", "a"], "dependency"), "f": (["f", "a"], "dependency"), "g": (["g", "a"], "dependency"), "h": (["h", "d", "a"], "unresolved_name_match"), "i": (["i", "d", "a"], "declared_dependency"), "j": (["j", "a"], "dependency")}
    for got in (impact.explained(found, found), impact.explained(found.drop("tie"), found, edges)):
        assert {r.node: (r.path, r.rule) for r in got.collect()} == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_decisions_read_the_edges_once(spark, reads):
    against_sql(spark, "q30_decisions")
    assert reads["lineitem"].value == 1


def test_target_edges_are_distinct_by_one_shuffle_of_the_targets(spark):
    targets = [("r", "1", "e", ["s", "s", None, "gone"]), ("r", "1", "e", ["s"]), ("r", "2", None, None), ("q", None, "e", []), ("r", "3", "s", ["s"])]
    frame = spark.createDataFrame(targets, "runner string, runner_id string, entry_symbol string, lifecycle_dependencies array<string>")
    found, missing = graph.target_edges(frame, spark.createDataFrame([("e",), ("s",), ("s",), (None,)], "id string"))
    want = [("target:r:1", "e", "entry", ""), ("target:r:1", "s", "lifecycle", ""), ("target:r:3", "s", "entry", ""), ("target:r:3", "s", "lifecycle", ""), (None, "e", "entry", "")]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    lost = [("target:r:1", "lifecycle_dependency_unresolved", None), ("target:r:1", "lifecycle_dependency_unresolved", "gone"), ("target:r:2", "entry_symbol_unresolved", None)]
    assert sorted(map(str, map(tuple, missing.collect()))) == sorted(map(str, lost))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
