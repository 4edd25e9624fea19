"""Labelled paths, process trees and commit graphs against plain Python."""

import random

import pytest

from tidemark.operators import paths, ranges


def test_stored_results_go_in_turn(spark):
    table = lambda rows: spark.createDataFrame(rows, "source string, target string")
    calls = table([("a", "f"), ("b", "a"), ("c", "V"), ("h", "g")])
    writes = table([("a", "V"), ("g", "W"), ("x", "Y")])
    reads = table([("g", "V"), ("r", "f"), ("k", "W"), ("k", "Y")])
    first = spark.createDataFrame([("f",)], "symbol string")
    got = {tuple(r) for r in paths.stored_results(first, calls, writes, reads).collect()}
    # r only reads the function and c only calls what a variable holds: neither notices; a mixed closure would have both.
    assert got == {("f", "changed"), ("a", "changed"), ("b", "changed"), ("V", "held"), ("g", "changed"), ("h", "changed"), ("W", "held"), ("k", "changed")}
    assert {tuple(r) for r in paths.written_state(first, calls, writes, reads).collect()} == {("a", "V", "g"), ("g", "W", "k")}


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_ancestor_on_merges(spark, seed):
    r = random.Random(seed)
    n = 90
    parents = {i: set() for i in range(n)}
    for i in range(1, n):
        parents[i] = {i - 1} if r.random() < 0.6 else set(r.sample(range(max(0, i - 12), i), min(i, r.choice([1, 2, 3]))))
    parents[50] = set()  # a second root
    stores = [(r.randrange(n), f"s{k}", r.choice([1, 2])) for k in range(7)]

    def nearest(c):
        seen, level, far = {c}, [c], 0
        while level:
            here = [(created, s) for at, s, created in stores if at in level]
            if here:
                return max(here)[1], far
            level = sorted({p for x in level for p in parents[x]} - seen)
            seen.update(level)
            far += 1
        return None, None

    rows = spark.createDataFrame([(f"c{a}", f"c{b}") for a, bs in parents.items() for b in bs] + [("c3", None)], "commit string, parent string")
    marks = spark.createDataFrame([(f"c{a}", s, t) for a, s, t in stores], "commit string, store_id string, created int")
    got = {x.commit: (x.store_id, x.distance) for x in ranges.nearest_ancestor(rows, marks, spark.createDataFrame([(f"c{i}",) for i in range(n)], "commit string")).collect()}
    assert got == {f"c{i}": nearest(i) for i in range(n)}
    assert ranges.nearest_ancestor(rows, marks.limit(0), spark.createDataFrame([("c5",)], "commit string")).first()[1] is None


def test_children_are_charged_to_the_window_that_started_them(spark):
    windows = spark.createDataFrame([("main", "t1", 10, 20), ("main", "t2", 30, 40), ("other", "t9", 0, 100), ("mid", "own", 35, 36)], "pid string, test_id string, start long, stop long")
    tree = [("main", None, 0), ("child", "main", 15), ("grandchild", "child", 33), ("deep", "grandchild", 90), ("between", "main", 25), ("below", "between", 31), ("mid", "main", 31), ("inner", "mid", 35), ("late", "mid", 50), ("orphan", "gone", 12), ("a", "b", 1), ("b", "a", 1)]
    processes = spark.createDataFrame(tree, "pid string, parent string, started long")
    got = {r.pid: r.test_id for r in ranges.charged(processes, windows, 7).collect()}
    # A child outlives its window and starts others, which belong to the same test; where none was open nothing is charged.
    assert got == {"main": None, "child": "t1", "grandchild": "t1", "deep": "t1", "between": None, "below": None, "mid": "t2", "inner": "own", "late": "t2", "orphan": None, "a": None, "b": None}
    items = spark.createDataFrame([("main", 12, "x"), ("main", 22, "idle"), ("child", 39, "y"), ("deep", 500, "z"), ("mid", 35, "w"), ("mid", 60, "v"), ("orphan", 5, "lost"), ("stray", 5, "lost")], "pid string, at long, item string")
    assert {tuple(r) for r in ranges.window_items(items, processes, windows, 7).collect()} == {("t1", "x"), ("t1", "y"), ("t1", "z"), ("own", "w"), ("t2", "v")}


def test_as_of_across_cells(spark):
    r = random.Random(3)
    marks = [(k, r.randrange(200), f"m{i}") for i, k in enumerate("abcab" * 8)]
    points = [(k, r.randrange(-20, 220), i) for i, k in enumerate("abcd" * 25)]
    got = {x.i: x.v for x in ranges.as_of(spark.createDataFrame(points, "key string, at long, i long"), spark.createDataFrame(marks, "key string, at long, v string"), "v", 9).collect()}
    last = lambda k, at: max(((m, v) for q, m, v in marks if q == k and m <= at), default=(0, None))[1]
    assert got == {i: last(k, at) for k, at, i in points}
