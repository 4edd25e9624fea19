"""Linearised classes against Python's own order."""

import random

from tidemark.extract.index import build
from tidemark.operators import classes
from tidemark.plans.engine import literal_files


def test_order_and_first_definitions_are_pythons_own(spark):
    r, made, bases, members = random.Random(4), {}, {}, {}
    while len(made) < 60:
        name = f"C{len(made)}"
        own = r.sample(list(made), min(len(made), r.choice([0, 1, 1, 2, 3])))
        have = {n: name for n in r.sample("mnopq", r.randint(0, 3))}
        try:
            made[name] = type(name, tuple(made[b] for b in own), dict(have))
        except TypeError:  # no order suits these bases
            continue
        bases[name], members[name] = own, have
    table = spark.createDataFrame([(c, b, i) for c, bs in bases.items() for i, b in enumerate(bs)] + [("C1", "elsewhere", 9)], "cls string, base string, place int")
    mro = classes.linearised(table, spark.createDataFrame([(c,) for c in made], "cls string"))
    got = {x.cls: x.mro for x in mro.collect()}
    assert got == {c: [k.__name__ for k in t.__mro__[:-1]] for c, t in made.items()}
    own = spark.createDataFrame([(c, n, f"{c}.{n}") for c, have in members.items() for n in have], "container string, name string, id string")
    first = {(x.cls, x.name): (x.id, x.depth) for x in classes.found_first(mro, own).collect()}
    assert first == {(c, n): (f"{getattr(t, n)}.{n}", got[c].index(getattr(t, n))) for c, t in made.items() for n in "mnopq" if hasattr(t, n)}
    above = {x.lower: x.upper for x in classes.overridden(mro, own).collect()}
    assert above == {f"{c}.{n}": f"{k}.{n}" for c, have in members.items() for n in have for k in [next((k for k in got[c][1:] if n in members[k]), None)] if k}


def test_circles_and_unsuited_bases_have_an_order(spark):
    table = spark.createDataFrame([("A", "B", 0), ("B", "A", 0), ("C", "A", 0), ("D", "X", 0), ("D", "Y", 1), ("E", "Y", 0), ("E", "X", 1), ("F", "D", 0), ("F", "E", 1)], "cls string, base string, place int")
    mro = {x.cls: x.mro for x in classes.linearised(table, spark.createDataFrame([(c,) for c in "ABCDEFXY"], "cls string")).collect()}
    assert mro["A"] == ["A", "B"] and mro["C"] == ["C", "A"] and mro["D"] == ["D", "X", "Y"] and set(mro["F"]) == set("FDEXY") and mro["F"][0] == "F"
    assert classes.linearised(table.limit(0), spark.createDataFrame([], "cls string")).count() == 0


def test_a_class_depends_on_what_it_finds_first(spark):
    text = "class A:\n    def m(self):\n        pass\n    def n(self):\n        pass\n\nclass B(A):\n    def m(self):\n        pass\n\nclass C(A):\n    def m(self):\n        pass\n    def n(self):\n        pass\n\nclass D(B, C):\n    pass\n"
    index = build(literal_files(spark, "head", {"k.py": text}))
    edges = {(r.source, r.target) for r in index.edges.where("kind = 'references'").collect()}
    assert {t for s, t in edges if s == "k.D"} == {"k.B", "k.C", "k.B.m", "k.C.n"}
    assert {t for s, t in edges if s == "k.A.m"} == {"k.B.m", "k.C.m"}
