"""Searches over several variants of a graph at once: right, and one search for all."""

import pytest

from tidemark.operators import fixpoint, impact


@pytest.fixture
def searches(monkeypatch):
    """The names of the loops that run."""
    seen, loop = [], fixpoint._loop

    def counting(first, edges, step, merge, limit, name, *more):
        seen.append(name)
        return loop(first, edges, step, merge, limit, name, *more)

    monkeypatch.setattr(fixpoint, "_loop", counting)
    return seen


def _reach(edges, seeds):
    got = set(seeds)
    while more := {b for a, b in edges if a in got} - got:
        got |= more
    return got


BASE = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), ("d", "e")]
HEAD = [("a", "b"), ("b", "f"), ("f", "b"), ("d", "e"), ("e", "d")]


def test_newly_run_searches_both_versions_at_once(spark, searches):
    frame = lambda edges: spark.createDataFrame([(*e, "imports") for e in [*edges, (None, "x"), ("a", None)]], "source string, target string, kind string")
    modules = spark.createDataFrame([(m,) for m in ["a", "d", "f", "f", "z", None]], "node string")
    got = {tuple(r) for r in impact.newly_run(frame(BASE), frame(HEAD), modules).collect()}
    want = set()
    for m in "adfz":
        b, h = _reach(BASE, m), _reach(HEAD, m)
        want |= {(m, x, "run") for x in h - b} | {(m, x, "not_run") for x in b - h}
    assert got == want and {c for _, _, c in got} == {"run", "not_run"} and len(searches) == 1


def test_causes_of_all_four_selections_by_one_search(spark, searches):
    edges = [("s", "p1", 0, 0), ("s", "n1", 0, 1), ("s", "d1", 1, 0), ("n1", "p1", 0, 0), ("d1", "x", 0, 1), ("s", "x", 0, 1), ("s", "y", 0, 1), ("s", "y", 1, 0), ("y", "y", 0, 0), ("d1", "w", 0, 1)]
    rows = spark.createDataFrame(edges, "source string, target string, d int, n int")
    seeds = spark.createDataFrame([("s",)], "node string")
    whole = rows.select("source", "target", impact.edge_mask(rows.d == 1, rows.n == 1).alias("mask"))
    got = dict(impact.causes_by(fixpoint.variants(whole, seeds, impact.CAUSES)).collect())
    assert len(searches) == 1
    run = lambda keep: fixpoint.reachable(rows.where(keep), seeds)
    assert got == dict(impact.causes(run("true"), run("d = 0"), run("n = 0"), run("d = 0 AND n = 0")).collect())
    assert got == {"s": "precise", "p1": "precise", "n1": "names", "d1": "dynamic", "x": "names", "y": "both", "w": "either"}


@pytest.mark.parametrize("name", ["q27_newly_run", "q32_counterfactual_cause"])
def test_queries_search_once(spark, searches, name):
    from __spark_entry__ import queries

    assert queries()[name](spark, "/root/testdata/sf0.001").count() and len(searches) == 1
