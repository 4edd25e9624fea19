"""Sets of literals: the fixpoint against brute force, and lookups that extraction bounds."""

import random

import pytest

from tidemark.extract.index import build
from tidemark.operators.literals import literal_sets
from tidemark.plans.engine import literal_files, make
from tidemark.schema import TARGETS


def by_hand(edges, first, most):
    """Sets grow text by text; a place that holds too many, or any, holds None."""
    state = {}
    todo = [(n, None if a else v) for n, v, a in first if n is not None and (a or v is not None)]
    while todo:
        n, v = todo.pop()
        have = state.setdefault(n, set())
        if have is None or v in have:
            continue
        if v is None or len(have) == most:
            state[n], v = None, None
        else:
            have.add(v)
        todo += [(t, None if v is None else (b or "") + v + (a or "")) for s, t, b, a in edges if s == n and t is not None]
    return state


@pytest.mark.parametrize("seed", range(3))
def test_sets_against_brute_force(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    edges = [(r.choice(names), r.choice(names), r.choice(["", "", "", "x_"]), r.choice(["", "", "_y"])) for _ in range(16)] + [("n0", None, "", ""), (None, "n1", "", ""), ("n0", "n2", None, None)]
    first = [(r.choice(names), r.choice("abcdef"), False) for _ in range(12)] + [("n13", "", True), (None, "a", False), ("n3", None, False), ("n0", "", False)]
    got = {}
    for x in literal_sets(spark.createDataFrame(edges, "source string, target string, before string, after string"), spark.createDataFrame(first, "node string, value string, any boolean"), most=5).collect():
        if x.any:
            assert x.node not in got
            got[x.node] = None
        else:
            got.setdefault(x.node, set()).add(x.value)
    assert got == by_hand(edges, first, 5)


def test_no_texts_at_all(spark):
    edges = spark.createDataFrame([], "source string, target string, before string, after string")
    assert literal_sets(edges, spark.createDataFrame([], "node string, value string, any boolean")).count() == 0


#: (module text, the names that ``find`` looks up there; None: it may look up any).
WAYS = {
    "argument": ("def find(o, n):\n    return getattr(o, n)\n\ndef go(o):\n    find(o, 'a')\n    find(o, n='b')\n", {"a", "b"}),
    "default": ("def find(o, n='d'):\n    return getattr(o, n)\n\ndef go(o):\n    find(o)\n    find(o, 'a')\n", {"a", "d"}),
    "through": ("def find(o, n):\n    return getattr(o, f'get_{n}')\n\ndef mid(o, k):\n    return find(o, k + '_v')\n\ndef go(o):\n    mid(o, 'a')\n", {"get_a_v"}),
    "loop": ("NAMES = ('a', 'b')\n\ndef find(o):\n    for n in NAMES:\n        getattr(o, n)\n", {"a", "b"}),
    "appended": ("NAMES = ['a']\n\ndef more():\n    NAMES.append('c')\n\ndef find(o):\n    return [getattr(o, n) for n in NAMES]\n", {"a", "c"}),
    "alias appended": ("NAMES = ['a']\n\ndef more():\n    m = NAMES\n    m.append('c')\n\ndef find(o):\n    return [getattr(o, n) for n in NAMES]\n", {"a", "c"}),
    "argument appended": ("NAMES = ['a']\n\ndef put(m, x):\n    m.append(x)\n\ndef more():\n    put(NAMES, 'c')\n\ndef find(o):\n    return [getattr(o, n) for n in NAMES]\n", {"a", "c"}),
    "table": ("T = {'k': 'a', 'l': 'b'}\n\ndef find(o, k):\n    return getattr(o, T[k])\n", {"a", "b", "k", "l"}),
    "pairs": ("T = {'k': 'a', 'l': 'b'}\n\ndef find(o):\n    for k, v in T.items():\n        getattr(o, v)\n", {"a", "b", "k", "l"}),
    "numbered": ("NAMES = ['a']\n\ndef find(o):\n    for i, n in enumerate(NAMES):\n        getattr(o, n)\n", {"a"}),
    "number in text": ("def find(o, n):\n    return getattr(o, f'v{n}')\n\ndef go(o):\n    find(o, 1)\n    find(o, 'x')\n", {"v1", "vx"}),
    "either": ("def find(o, x):\n    n = 'a' if x else 'b'\n    return getattr(o, n)\n", {"a", "b"}),
    "result": ("def name(x):\n    if x:\n        return 'a'\n    return 'b'\n\ndef find(o, x):\n    return getattr(o, name(x))\n", {"a", "b"}),
    "method": ("class C:\n    def find(self, o, n):\n        return getattr(o, n)\n    def go(self, o):\n        self.find(o, 'a')\n\ndef out(c, o):\n    c.find(o, 'b')\n", {"a", "b"}),
    "override": ("class Up:\n    def pick(self, n):\n        pass\n    def go(self):\n        self.pick('a')\n\nclass Low(Up):\n    def pick(self, n):\n        return find(self, n)\n\ndef find(o, n):\n    return getattr(o, n)\n", {"a"}),
    "two lookups": ("def find(o, x):\n    n = 'a'\n    getattr(o, n)\n    getattr(o, x)\n\ndef go(o):\n    find(o, 'b')\n", {"a", "b"}),
    "unknown argument": ("import os\n\ndef find(o, n):\n    return getattr(o, n)\n\ndef go(o):\n    find(o, 'a')\n    find(o, os.environ['N'])\n", None),
    "one of two unknown": ("def find(o, x):\n    n = 'a'\n    getattr(o, n)\n    getattr(o, x.y)\n", None),
    "handed on": ("def find(o, n):\n    return getattr(o, n)\n\ndef go(o):\n    find(o, 'a')\n    return map(find, o)\n", None),
    "looked up": ("def find(o, n):\n    return getattr(o, n)\n\ndef go(o):\n    find(o, 'a')\n    return getattr(o, 'find')\n", None),
    "looked up by a bounded name": ("def find(o, n):\n    return getattr(o, n)\n\ndef ask(o, k):\n    return getattr(o, k)\n\ndef go(o):\n    find(o, 'a')\n    ask(o, 'find')\n", None),
    "decorated": ("import functools\n\n@functools.cache\ndef find(o, n):\n    return getattr(o, n)\n\ndef go(o):\n    find(o, 'a')\n", None),
    "base outside": ("import ast\n\nclass Up(ast.NodeVisitor):\n    pass\n\nclass C(Up):\n    def find(self, o, n):\n        return getattr(o, n)\n    def go(self, o):\n        self.find(o, 'a')\n", None),
    "never called": ("def find(o, n):\n    return getattr(o, n)\n", None),
    "growing": ("def find(o, n):\n    find(o, n + '_x')\n    return getattr(o, n)\n\ndef go(o):\n    find(o, 'a')\n", None),
    "container handed out": ("import lib\n\ndef find(o):\n    names = ['a']\n    lib.fill(names)\n    return [getattr(o, n) for n in names]\n", None),
    "attribute set elsewhere": ("NAME = 'a'\n\ndef sets(m):\n    m.NAME = 'b'\n\ndef find(o):\n    return getattr(o, NAME)\n", None),
    "patched": ("NAME = 'a'\n\ndef test_it(monkeypatch):\n    monkeypatch.setattr('lib.NAME', 'b')\n\ndef find(o):\n    return getattr(o, NAME)\n", None),
    "patched result": ("import lib\n\ndef which():\n    return 'a'\n\ndef test_it(mocker):\n    mocker.patch.object(lib, 'which', lambda: 'b')\n\ndef find(o):\n    return getattr(o, which())\n", None),
    "patched items": ("T = {'k': 'a'}\n\ndef test_it(monkeypatch):\n    monkeypatch.setitem(T, 'k', 'b')\n\ndef find(o):\n    return getattr(o, T['k'])\n", None),
    "function replaced": ("import lib\n\ndef chosen():\n    return 'a'\n\ndef sets(m):\n    lib.chosen = m\n\ndef find(o):\n    return getattr(o, chosen())\n", None),
    "global": ("NAME = 'a'\n\ndef sets():\n    global NAME\n    NAME = 'b'\n\ndef find(o):\n    return getattr(o, NAME)\n", {"a", "b"}),
    "unpacked": ("def find(o):\n    n, m = 'a', 'b'\n    return getattr(o, n)\n", None),
    "inner function": ("def find(o):\n    def inner(n):\n        return getattr(o, n)\n    return inner('a')\n", None),
    "starred": ("def find(o, n):\n    return getattr(o, n)\n\ndef go(xs):\n    find(*xs)\n    find(xs, 'a')\n", None),
}


@pytest.fixture(scope="module")
def looked_up(spark):
    """Each way has names of its own, so that one index answers all."""
    files = {"app/__init__.py": ""}
    for i, (text, _) in enumerate(WAYS.values()):
        for word in ("find", "NAMES", "NAME", "ask", "pick", "which", "chosen"):
            text = text.replace(word, f"{word}{i}_") if word != "NAME" else text.replace("NAME ", f"NAME{i}_ ").replace("NAME)", f"NAME{i}_)").replace("NAME'", f"NAME{i}_'").replace("NAME\n", f"NAME{i}_\n")
        files[f"app/w{i}.py"] = text
    rows = build(literal_files(spark, "head", files)).unresolved.collect()
    return [(r.symbol, r.kind, r.name) for r in rows]


@pytest.mark.parametrize("way", WAYS)
def test_names_of_lookups(looked_up, way):
    i = list(WAYS).index(way)
    own = [(k, n) for s, k, n in looked_up if s.startswith(f"app.w{i}.") and s.endswith(f"find{i}_")]
    assert (None if ("dynamic", "getattr") in own else {n for k, n in own if k == "attribute"} - {"append", "items"}) == WAYS[way][1]


FILES = {
    "lib/__init__.py": "", "lib/load.py": "from importlib import import_module\n\ndef load(n):\n    return import_module('lib.back_' + n)\n\ndef fast():\n    return load('fast')\n",
    "lib/back_fast.py": "SPEED = 1\n", "lib/back_slow.py": "SPEED = 2\n", "lib/pick.py": "def pick(o, n):\n    return getattr(o, 'on_' + n)()\n",
    "lib/hooks.py": "class Hooks:\n    def on_start(self):\n        return 1\n    def on_stop(self):\n        return 2\n",
    "tests/test_it.py": "from lib.load import fast\nfrom lib.pick import pick\nfrom lib.hooks import Hooks\n\ndef test_fast():\n    assert fast()\n\ndef test_pick():\n    assert pick(Hooks(), 'start')\n\ndef test_plain():\n    assert True\n",
}


@pytest.mark.parametrize(("path", "old", "new", "want"), [
    ("lib/back_fast.py", "1", "3", {"test_fast"}),
    ("lib/back_slow.py", "2", "3", set()),
    ("lib/hooks.py", "return 1", "return 3", {"test_pick"}),
    ("lib/hooks.py", "return 2", "return 3", set()),
])
def test_a_plan_selects_what_bounded_lookups_find(spark, path, old, new, want):
    head = FILES | {path: FILES[path].replace(old, new)}
    targets = spark.createDataFrame([("pytest", n, f"tests.test_it.{n}", []) for n in ("test_fast", "test_pick", "test_plain")], TARGETS)
    assert set(make(literal_files(spark, "base", FILES), literal_files(spark, "head", head), targets).selected()) == want
