"""Plans over tiny literal snapshots, with exact selections.

One package of small areas that do not refer to each other, so that one plan answers several questions at once.
"""

import subprocess

import pytest
from pyspark.sql import functions as F

from tidemark.discovery.pytest_rules import discover
from tidemark.extract.index import build
from tidemark.plans.engine import literal_files, make
from tidemark.schema import TARGETS
from tidemark.sources.snapshots import read_git

BASE = {
    # Plain calls, constants, methods that are matched by name.
    "depot/__init__.py": "",
    "depot/rates.py": "FLOOR = 12\n\ndef gross(net, tax):\n    return net * tax\n\ndef rounded(x):\n    return round(x)\n\ndef bill(items):\n    return [gross(i, 2) for i in items]\n\nclass Crate:\n    width = 4\n    def volume(self):\n        return self.width ** 3\n",
    "depot/desk.py": "from depot import rates as r\nfrom depot.rates import gross as g\n\ndef invoice(items):\n    return r.bill(items)\n\ndef quick(x):\n    return g(x, 3)\n\ndef lowest():\n    return r.FLOOR\n\ndef guess(thing):\n    return thing.volume()\n",
    # State that is written in place.
    "depot/shelf.py": "STOCK = {}\nNOTES = []\nNOTES.append('open')\nSEEN = set()\n",
    "depot/load.py": "from depot import shelf\n\ndef restock(n):\n    shelf.STOCK['pear'] = n\n\ndef refill():\n    restock(40)\n\ndef jot():\n    shelf.NOTES.append('n')\n",
    "depot/look.py": "from depot import shelf\n\ndef pears():\n    return shelf.STOCK.get('pear')\n\ndef notes():\n    return len(shelf.NOTES)\n\ndef seen():\n    return shelf.SEEN\n",
    # Code that runs at import.
    "depot/modes.py": "ACTIVE = {}\n\ndef choose(name):\n    ACTIVE['mode'] = name\n    return name\n\ndef active():\n    return ACTIVE['mode']\n",
    "depot/boot.py": "from depot.modes import choose\n\nMODE = choose('slow')\n",
    "depot/hooks.py": "HOOKS = []\n\ndef hooks():\n    return list(HOOKS)\n",
    "depot/extra.py": "from depot import hooks\n\ndef enrol(x):\n    hooks.HOOKS.append(x)\n\nenrol('extra')\n",
    "depot/host.py": "WHO = 'host'\n",
    # Special methods, docstrings.
    "depot/shapes.py": "class Tile:\n    def __init__(self, side):\n        self.side = side\n\nclass Slab(Tile):\n    pass\n\ndef area(n):\n    return Slab(n).side ** 2\n",
    "depot/guide.py": "def topic():\n    '''How to pack.'''\n\ndef show():\n    return topic.__doc__\n",
    "tests/test_desk.py": "from depot import desk, rates\n\ndef test_gross():\n    assert rates.gross(5, 2)\n\ndef test_rounded():\n    assert rates.rounded(2.4) == 2\n\ndef test_invoice():\n    assert desk.invoice([3])\n\ndef test_quick():\n    assert desk.quick(7)\n\ndef test_lowest():\n    assert desk.lowest()\n\ndef test_guess():\n    desk.guess(rates.Crate())\n\ndef test_nothing():\n    assert True\n",
    "tests/test_state.py": "from depot import look\n\ndef test_pears():\n    look.pears()\n\ndef test_notes():\n    look.notes()\n\ndef test_seen():\n    look.seen()\n",
    "tests/test_boot.py": "from depot.hooks import hooks\nfrom depot.modes import active\n\ndef test_active():\n    active()\n\ndef test_hooks():\n    hooks()\n",
    "tests/test_shapes.py": "from depot.guide import show\nfrom depot.shapes import area\n\ndef test_area():\n    area(2)\n\ndef test_guide():\n    show()\n",
    "tests/test_writes.py": "from depot import shelf\n\ndef test_marks():\n    shelf.SEEN.add(1)\n",
    "tests/test_limit.py": "BOUND = 3\n\ndef test_bound():\n    assert 1\n",
    "assets/logo.txt": "x",
}
TESTS = {n: (f, n) for f, c in BASE.items() if f.startswith("tests/") for n in (x.partition("(")[0] for x in c.split("def ")[1:])}


def name(n):
    return f"{TESTS[n][0]}::{n}"


def targets(spark, leave=()):
    rows = [("pytest", name(n), f"{f[:-3].replace('/', '.')}.{n}", []) for n, (f, _) in TESTS.items() if n not in leave]
    return spark.createDataFrame(rows, TARGETS)


def planned(spark, edits, own=None, **more):
    head = dict(BASE)
    for path, *change in edits:
        if change[0] is None:
            head.pop(path)
        elif len(change) == 1:
            head[path] = change[0]
        else:
            assert change[0] in head[path], change
            head[path] = head[path].replace(*change)
    return make(literal_files(spark, "base", BASE), literal_files(spark, "head", head), own or targets(spark), **more)


def names(plan):
    return {x.rpartition("::")[2] for x in plan.selected()}


def test_bodies_names_layout_and_state(spark):
    plan = planned(spark, [
        ("depot/rates.py", "return net * tax", "return tax * net"), ("depot/rates.py", "FLOOR = 12", "# as agreed\n\nFLOOR = 12"), ("depot/rates.py", "def rounded(x):\n", "def rounded(x):\n    '''To whole units.'''\n"),
        ("depot/rates.py", "self.width ** 3", "self.width * self.width * self.width"), ("depot/load.py", "restock(40)", "restock(41)"), ("depot/load.py", "append('n')", "append('m')"), ("tests/test_writes.py", "SEEN.add(1)", "SEEN.add(2)"), ("depot/guide.py", "How to pack.", "How to stow."),
    ])
    # One writer changed, and the caller of another hands it another number; what a test itself writes no other test sees.
    assert names(plan) == {"test_gross", "test_invoice", "test_quick", "test_guess", "test_pears", "test_notes", "test_marks", "test_guide"}
    rows = {r.node.rpartition("::")[2]: r for r in plan.reasons.collect()}
    assert (rows["test_invoice"].rule, rows["test_invoice"].changed_symbol) == ("dependency", "depot.rates.gross")
    assert rows["test_invoice"].path == ["target:pytest:tests/test_desk.py::test_invoice", "tests.test_desk.test_invoice", "depot.desk.invoice", "depot.rates.bill", "depot.rates.gross"]
    assert rows["test_guess"].rule == "unresolved_name_match" and rows["test_pears"].changed_symbol == "depot.load.refill"


def test_import_time_state_and_special_methods(spark):
    plan = planned(spark, [
        ("depot/boot.py", "'slow'", "'fast'"), ("depot/host.py", "from depot import extra\n\nWHO = 'host'\n"), ("depot/shelf.py", "NOTES.append('open')", "NOTES.append('shut')"),
        ("depot/shapes.py", "self.side = side", "self.side = abs(side)"), ("tests/test_limit.py", "BOUND = 3", "BOUND = 4"),
    ])
    # A module-level write is part of its variable, and runs for all who import the module.
    assert names(plan) == {"test_active", "test_hooks", "test_pears", "test_notes", "test_seen", "test_marks", "test_area", "test_bound"}
    assert {"depot.shelf", "depot.shelf.NOTES"} <= {r.id for r in plan.changes.collect()}


def test_broken_and_unread_files_select_all(spark):
    plan = planned(spark, [("depot/desk.py", "def (:\n"), ("assets/logo.txt", "y")])
    assert names(plan) == set(TESTS)
    assert {r.rule for r in plan.fallbacks.collect()} == {"analysis_error", "unanalysed_file_changed"}


def test_declared_always_new_lifecycle_and_runner(spark):
    wanted = spark.createDataFrame([("tests.test_desk.test_nothing", "depot.rates.rounded", "by table")], "source string, target string, why string")
    old = spark.createDataFrame([("pytest", name(n), "x", ["depot.host.WHO"] if n == "test_quick" else []) for n in TESTS if n != "test_area"], TARGETS)
    plan = planned(spark, [("depot/rates.py", "round(x)", "int(x)")], declarations=wanted, patterns=[("smoke", "*::test_guess", None)], base_targets=old)
    rules = {r.runner_id.rpartition("::")[2]: r.rules for r in plan.decisions.where("selected").collect()}
    assert rules == {"test_rounded": ["dependency"], "test_nothing": ["declared_dependency"], "test_guess": ["always_run"], "test_area": ["new_target"], "test_quick": ["lifecycle_changed"]}
    # What only the base version's target depended on still counts, and so does what the runner itself runs.
    files = {**BASE, "pluggy/__init__.py": "from pluggy import core\n", "pluggy/core.py": "STEP = 1\n"}
    own = spark.createDataFrame([("pytest", name("test_quick"), "tests.test_desk.test_quick", []), ("other", "o", "tests.test_desk.test_nothing", [])], TARGETS)
    before = spark.createDataFrame([("pytest", name("test_quick"), "tests.test_desk.test_quick", []), ("other", "o", "tests.test_desk.test_nothing", ["depot.host.WHO"])], TARGETS)
    head = {**files, "pluggy/core.py": "STEP = 2\n", "depot/host.py": "WHO = 'guest'\n"}
    again = make(literal_files(spark, "base", files), literal_files(spark, "head", head), own, before)
    rules = {r.runner_id.rpartition("::")[2]: set(r.rules) for r in again.decisions.where("selected").collect()}
    assert rules == {"test_quick": {"runner_dependency"}, "o": {"dependency", "lifecycle_changed"}}


def test_discovery_finds_tests_and_nearest_fixtures(spark):
    files = {
        "tests/conftest.py": "import pytest\n\n@pytest.fixture\ndef yard():\n    return 1\n\n@pytest.fixture\ndef fleet(yard):\n    return yard\n",
        "tests/north/conftest.py": "import pytest\n\n@pytest.fixture\ndef yard():\n    return 2\n",
        "tests/north/test_gate.py": "class TestGate:\n    def test_opens(self, yard, unknown):\n        pass\n\nclass TestBuilt:\n    def __init__(self):\n        pass\n    def test_never(self):\n        pass\n",
        "tests/test_road.py": "def test_runs(fleet):\n    pass\n\ndef helper():\n    pass\n",
        "tests/auto/test_auto.py": "import pytest\n\n@pytest.fixture(autouse=True)\ndef always():\n    pass\n\n@pytest.fixture(name='crew')\ndef make_crew():\n    pass\n\n@pytest.mark.usefixtures('crew')\ndef test_used():\n    pass\n",
        "tests/auto/test_cases.py": "import unittest\n\nclass Common:\n    def test_shared(self):\n        pass\n\nclass Depot(Common, unittest.TestCase):\n    def setUp(self):\n        pass\n    def test_own(self):\n        pass\n",
        "build/test_skipped.py": "def test_skipped():\n    pass\n",
    }
    got = {r.runner_id: r.lifecycle_dependencies for r in discover(build(literal_files(spark, "head", files))).collect()}
    assert got == {
        "tests/north/test_gate.py::TestGate::test_opens": ["fixture:unknown", "tests.conftest", "tests.north.conftest", "tests.north.conftest.yard", "tests.north.test_gate"],
        "tests/test_road.py::test_runs": ["tests.conftest", "tests.conftest.fleet", "tests.conftest.yard", "tests.test_road"],
        "tests/auto/test_auto.py::test_used": ["tests.auto.test_auto", "tests.auto.test_auto.always", "tests.auto.test_auto.make_crew", "tests.conftest"],
        "tests/auto/test_cases.py::Depot::test_own": ["tests.auto.test_cases", "tests.auto.test_cases.Depot.setUp", "tests.conftest"],
        "tests/auto/test_cases.py::Depot::test_shared": ["tests.auto.test_cases", "tests.auto.test_cases.Depot.setUp", "tests.conftest"],
    }


def test_working_tree_has_the_modes_of_its_commit(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "run.sh").write_text("echo\n")
    (tmp_path / "run.sh").chmod(0o755)
    (tmp_path / "a.py").write_text("X = 1\n")
    (tmp_path / "b.py").symlink_to("a.py")
    git("add", "-A")
    git("commit", "-qm", "first")
    rows = lambda r: sorted((x.path, x.mode, x.blob_id, x.content) for x in read_git(spark, str(tmp_path), r).collect())
    assert rows("HEAD") == rows("WORKTREE") == rows("INDEX")
    assert {(p, m) for p, m, _, _ in rows("WORKTREE")} == {("a.py", "100644"), ("b.py", "120000"), ("run.sh", "100755")}


def test_reexports_long_and_in_a_circle(spark):
    files = {f"c/m{i}.py": f"from c.m{i + 1} import thing\n" for i in range(60)} | {"c/m60.py": "def thing():\n    pass\n", "c/x.py": "from c.y import ring\n", "c/y.py": "from c.x import ring\n", "c/use.py": "from c.m0 import thing\nfrom c.x import ring\n\ndef go():\n    return thing()\n\ndef spin():\n    return ring()\n"}
    index = build(literal_files(spark, "head", files))
    edges = {(r.source, r.target) for r in index.edges.where("kind = 'references'").collect()}
    assert ("c.use.go", "c.m60.thing") in edges and any(a == "c.use.spin" for a, _ in edges)


@pytest.mark.parametrize("hub", [50_000, 3])
def test_loops_give_the_same_with_and_without_hubs(spark, monkeypatch, hub):
    from tidemark.operators import fixpoint

    monkeypatch.setattr(fixpoint, "HUB", hub)
    pairs = [(f"n{i}", f"n{(i * 7 + 3) % 23}") for i in range(20)] + [("n1", f"k{i}") for i in range(9)] + [(f"k{i}", "n2") for i in range(9)]
    edges = spark.createDataFrame([(a, b, [0, 2, 3, 4] if a < "n" else [1, 2, 3, 3]) for a, b in pairs], "source string, target string, xfer array<int>")
    seeds = spark.createDataFrame([("n2", 4), ("k3", 3), ("n2", 3)], "node string, mode int")
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def reach(start):
        hops, frontier = {start: 0}, [start]
        while frontier:
            frontier = [b for a in frontier for b in sorted(after.get(a, ())) if hops.setdefault(b, hops[a] + 1) == hops[a] + 1]
        return hops

    got = {(r.origin, r.node) for r in fixpoint.closure(edges, seeds.select("node")).collect()}
    assert got == {(o, x) for o in ("n2", "k3") for x in reach(o)}
    assert {r.node: r.hops for r in fixpoint.reachable(edges, spark.createDataFrame([("n1",)], "node string")).collect()} == reach("n1")
    mode, via, front, k = {"n2": 4, "k3": 3}, {"n2": (0, None), "k3": (0, None)}, {"n2", "k3"}, 0
    table = {(a, b): x for (a, b), x in zip(pairs, ([0, 2, 3, 4] if a < "n" else [1, 2, 3, 3] for a, _ in pairs), strict=True)}
    while front:
        k, best = k + 1, {}
        for (a, b), x in table.items():
            if b in front and (m := x[mode[b] - 1]) > mode.get(a, 0):
                best[a] = min(best.get(a, (0, "~")), (-m, b))
        for a, (m, b) in best.items():
            mode[a], via[a] = -m, (k, b)
        front = set(best)
    found = {r.node: (r.mode, (r.hops, r.via)) for r in fixpoint.impact(edges, seeds).collect()}
    assert found == {x: (mode[x], via[x]) for x in mode}


def test_loops_leave_out_edges_and_seeds_without_nodes(spark):
    from tidemark.operators import fixpoint

    edges = spark.createDataFrame([("a", "b"), ("a", None), (None, "b"), ("x", "y"), (None, None)], "source string, target string")
    seeds = spark.createDataFrame([("a",), (None,)], "node string")
    assert {tuple(r) for r in fixpoint.closure(edges, seeds).collect()} == {("a", "a"), ("a", "b")}
    assert {tuple(r) for r in fixpoint.reachable(edges, seeds).collect()} == {("a", 0), ("b", 1)}
    xfer = edges.selectExpr("source", "target", "array(1, 2, 3, 4) AS xfer")
    assert {tuple(r) for r in fixpoint.impact(xfer, spark.createDataFrame([("b", 3), (None, 4)], "node string, mode int")).collect()} == {("b", 3, 0, None), ("a", 3, 1, "b")}
    nothing = fixpoint.impact(xfer.limit(0), spark.createDataFrame([], "node string, mode int"))
    assert nothing.collect() == [] and fixpoint.closure(edges, seeds.limit(0)).collect() == []


def test_no_task_holds_the_edges_of_a_hub(spark, monkeypatch):
    from tidemark.operators import fixpoint

    monkeypatch.setattr(fixpoint, "HUB", 1000)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        edges = spark.range(100_000).selectExpr("'hub' AS node", "concat('n', id) AS next").union(spark.range(1000).selectExpr("concat('m', id)", "'x'"))
        along = fixpoint._Along(edges, "along")
        assert along.keys == ["node", "salt"]
        sizes = [r.n for r in along.edges.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 8 and max(sizes) <= 3 * sorted(sizes)[4]
        assert along.met(spark.createDataFrame([("hub",)], "node string")).count() == 100_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_roots_leave_files_out_but_for_what_runners_read(spark):
    files = {"src/m.py": "def f():\n    return 1\n", "tests/test_m.py": "from m import f\n\ndef test_f():\n    f()\n", "docs/notes.md": "a", "data/rates.csv": "1", "conftest.py": "", "build.py": "", "src/table.json": "{}"}
    roots = ["src", "tests=tests", "nowhere"]
    own = spark.createDataFrame([("pytest", "t", "tests.test_m.test_f", [])], TARGETS)
    snapshot = lambda name, **edits: literal_files(spark, name, {**files, **{k.replace("__", "/").replace("_DOT_", "."): v for k, v in edits.items()}}, roots)
    base = snapshot("base")
    index = build(base)
    plan = lambda head, keep=roots[:2]: make(base, head, own, base=index, head=index, roots=keep)
    quiet = plan(snapshot("head", docs__notes_DOT_md="b", data__rates_DOT_csv="2"))
    assert quiet.selected() == [] and quiet.fallbacks.count() == 0
    loud = plan(snapshot("head", conftest_DOT_py="x = 1", src__table_DOT_json="[]", build_DOT_py="y = 1"), roots)
    assert {(r.rule, r.detail) for r in loud.fallbacks.collect()} == {
        ("unanalysed_file_changed", "conftest.py"), ("unanalysed_file_changed", "src/table.json"), ("unanalysed_file_changed", "build.py"), ("analysis_error", "nowhere: source root nowhere holds no Python file in either version"),
    }
