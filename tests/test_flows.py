"""State behind arguments, aliases and results: who is taken to write it, and what a plan selects."""

import pytest

from tidemark.extract import flows
from tidemark.extract.index import build
from tidemark.plans.engine import literal_files, make
from tidemark.schema import TARGETS

#: State, and ways to write it: (module text, what writes which variable).
STATE = "TABLE = []\nOTHER = {}\nREG = {}\nLAZY = {}\nCOPY = {}\nITEMS = []\n\ndef get():\n    return LAZY\n"
WAYS = {
    "helper": ("def set_mode(d, v='slow'):\n    _store(d, v)\n\ndef _store(m, v):\n    m['k'] = v\n\ndef go():\n    set_mode(state.REG)\n", {("REG", "_store")}),
    "local": ("def fill(d):\n    m = d\n    m.update(k=1)\n\ndef go():\n    fill(state.REG)\n", {("REG", "fill")}),
    "keyword": ("def fill(v=1, *, d):\n    d['k'] = v\n\ndef go():\n    fill(d=state.REG)\n", {("REG", "fill")}),
    "starred": ("def fill(a, b):\n    b.append(1)\n\ndef go():\n    fill(*[state.TABLE])\n    fill(*state.ITEMS)\n", {("ITEMS", "fill"), ("TABLE", "fill")}),
    "setter": ("def fill(d):\n    setattr(d, 'k', 1)\n\ndef go():\n    fill(state.REG)\n", {("REG", "fill")}),
    "receiver": ("class Filler:\n    def stow(self, d):\n        d['k'] = 1\n\ndef go(f):\n    f()[0].stow(state.REG)\n", {("REG", "Filler.stow")}),
    "constructor": ("class Box:\n    def __init__(self, d):\n        d['k'] = 1\n\ndef go():\n    return Box(state.REG)\n", {("REG", "Box.__init__")}),
    "static": ("class Box:\n    @staticmethod\n    def put(d):\n        d['k'] = 1\n    def run(self):\n        self.put(state.REG)\n", {("REG", "Box.put")}),
    "override": ("class Up:\n    def put(self, d):\n        pass\n    def run(self):\n        self.put(state.REG)\n\nclass Low(Up):\n    def put(self, d):\n        d['k'] = 1\n", {("REG", "Low.put")}),
    "result": ("def go():\n    state.get()['k'] = 1\n", {("LAZY", "go")}),
    "handed back": ("def same(p):\n    return p\n\ndef go():\n    r = same(state.REG)\n    r['items'].append(1)\n", {("REG", "go")}),
    "elements": ("def go():\n    for _, o in enumerate(state.ITEMS):\n        o.n = 1\n\ndef every():\n    return [o.append(1) for o in state.TABLE]\n", {("ITEMS", "go"), ("TABLE", "every")}),
    "either": ("def go(x):\n    c = state.REG if x else state.OTHER\n    c['k'] = 1\n", {("REG", "go"), ("OTHER", "go")}),
    "bound mutator": ("def go():\n    add = state.TABLE.append\n    add(1)\n", {("TABLE", "go")}),
    "tuple": ("def go(k):\n    for c in (state.OTHER,):\n        c[k] = 'x'\n", {("OTHER", "go")}),
    "global by name": ("OWN = {}\n\ndef go(k):\n    globals()['OWN'][k] = 1\n", {("OWN", "go")}),
    "copies": ("def go():\n    c = dict(state.COPY)\n    c['k'] = 2\n    d = state.COPY.copy()\n    d['x'] = 1\n    e = {**state.COPY}\n    e['y'] = 1\n    f = [*state.ITEMS]\n    f.append(1)\n", set()),
    "read only": ("def size(d):\n    return len(d)\n\ndef go():\n    return size(state.REG)\n", set()),
    "fresh": ("def wrap(p):\n    return {'p': 1}\n\ndef go():\n    wrap(state.REG)['k'] = 1\n", set()),
    "circle": ("def a(d):\n    b(d)\n\ndef b(d):\n    a(d)\n    d.clear()\n\ndef go():\n    a(state.OTHER)\n", {("OTHER", "b")}),
}


@pytest.fixture(scope="module")
def written_by(spark):
    """Each way is a module of its own with its own state, so that one index answers all."""
    files = {"app/__init__.py": ""}
    for i, (text, _) in enumerate(WAYS.values()):
        files |= {f"app/s{i}.py": STATE, f"app/w{i}.py": f"from app import s{i} as state\n\n{text}"}
    edges = build(literal_files(spark, "head", files)).state.where("detail = 'mutated_by'").select("source", "target").collect()
    return {(r.source, r.target) for r in edges}


@pytest.mark.parametrize("way", WAYS)
def test_who_writes_state(written_by, way):
    i = list(WAYS).index(way)
    got = {(a.rpartition(".")[2], b.removeprefix(f"app.w{i}.")) for a, b in written_by if a.startswith((f"app.s{i}.", f"app.w{i}."))}
    assert got == WAYS[way][1]


FILES = {
    "lib/__init__.py": "", "lib/state.py": "TABLE = []\nOTHER = {}\nQUIET = []\n", "lib/fill.py": "def fill(t):\n    t.append(1)\n", "lib/boot.py": "from lib import fill, state\n\ndef start():\n    fill.fill(state.TABLE)\n",
    "lib/alias.py": "from lib import state\n\ndef put():\n    o = state.OTHER\n    o['k'] = 1\n",
    "lib/registry.py": "class Registry:\n    def __init__(self):\n        self.items = []\n    def register(self, x):\n        self._add(x)\n    def _add(self, x):\n        self.items.append(x)\n\nregistry = Registry()\n\ndef get():\n    return registry.items\n",
    "lib/plug.py": "from lib.registry import registry\n\ndef plug():\n    registry.register('slow')\n",
    "tests/test_it.py": "from lib import state\nfrom lib.registry import get\n\ndef test_table():\n    assert state.TABLE\n\ndef test_other():\n    assert state.OTHER\n\ndef test_quiet():\n    assert state.QUIET == []\n\ndef test_registry():\n    assert get()\n",
}
NAMES = ("test_table", "test_other", "test_quiet", "test_registry")


@pytest.mark.parametrize(("edits", "want"), [
    ([("lib/fill.py", "append(1)", "append(2)"), ("lib/alias.py", "= 1", "= 2")], {"test_table", "test_other"}),
    ([("lib/boot.py", "fill.fill(state.TABLE)", "pass"), ("lib/plug.py", "slow", "fast")], {"test_table", "test_registry"}),
])
def test_readers_of_state_behind_arguments_and_aliases_are_selected(spark, edits, want):
    head = dict(FILES)
    for path, old, new in edits:
        head[path] = head[path].replace(old, new)
    targets = spark.createDataFrame([("pytest", n, f"tests.test_it.{n}", []) for n in NAMES], TARGETS)
    assert set(make(literal_files(spark, "base", FILES), literal_files(spark, "head", head), targets).selected()) == want


def test_positions_of_arguments(spark):
    parts = ["0", "1", "7", "@", "*", "k:b", "k:z"]
    rows = spark.createDataFrame([(p, o) for p in parts for o in (0, 1)], "part string, off int").selectExpr("*", "'f' AS callee", "array('a', 'b', 'c') AS params")
    from pyspark.sql import functions as F

    got = {(r.part, r.off): [x[3:] for x in r.to] for r in rows.select("part", "off", flows.given_to(F.col("callee"), F.col("params"), F.col("part"), F.col("off")).alias("to")).collect()}
    assert got == {
        ("0", 0): ["a"], ("0", 1): ["b"], ("1", 0): ["b"], ("1", 1): ["c"], ("7", 0): ["c"], ("7", 1): ["c"], ("@", 0): [], ("@", 1): ["a"],
        ("*", 0): ["a", "b", "c"], ("*", 1): ["a", "b", "c"], ("k:b", 0): ["b"], ("k:b", 1): ["b"], ("k:z", 0): ["c"], ("k:z", 1): ["c"],
    }
