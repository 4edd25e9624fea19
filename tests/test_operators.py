"""Operators, sources and functions on small literals, the loops against plain dictionaries."""

import json
import random
import re
import sqlite3
import struct
import subprocess
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.operators import diff, evidence, fixpoint, graph, impact, paths, rollup, validate
from tidemark.sources import documents, snapshots, stores

TABLE = {k: v for k, v in graph.TRANSFER.items()}


def brute_impact(edges, seeds):
    mode = dict(seeds)
    todo = list(seeds)
    while todo:
        node = todo.pop()
        for s, t, x in edges:
            if t == node and x[mode[node] - 1] > mode.get(s, 0):
                mode[s] = x[mode[node] - 1]
                todo.append(s)
    return mode


def test_impact_and_closure_equal_dictionaries_on_cyclic_graphs(spark):
    r = random.Random(5)
    nodes = [f"n{i}" for i in range(30)]
    edges = [(r.choice(nodes), r.choice(nodes), r.choice(list(TABLE.values()))) for _ in range(60)] + [("n0", "n0", (3, 3, 3, 3)), ("n1", "n2", (3, 3, 3, 3)), ("n2", "n3", (3, 3, 3, 3)), ("n3", "n1", (3, 3, 3, 3))] + [(f"s{i}", "n1", (0, 0, 3, 3)) for i in range(200)]
    seeds = {"n1": 4, "n7": 2, "alone": 1}
    frame = spark.createDataFrame([(a, b, list(x)) for a, b, x in edges], "source string, target string, xfer array<int>")
    got = {x.node: (x.mode, x.hops, x.via) for x in fixpoint.impact(frame, spark.createDataFrame(list(seeds.items()), "node string, mode int")).collect()}
    assert {k: m for k, (m, _, _) in got.items()} == brute_impact(edges, seeds)
    assert all((via is None) == (hops == 0) for _, hops, via in got.values())
    reach = {(x.origin, x.node) for x in fixpoint.closure(frame, spark.createDataFrame([("n1",), ("s3",)], "node string")).collect()}

    def walk(start):
        seen, todo = {start}, [start]
        while todo:
            n = todo.pop()
            for a, b, _ in edges:
                if a == n and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    assert reach == {(o, n) for o in ("n1", "s3") for n in walk(o)}
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(12)], "source string, target string")
    assert {x.node: x.hops for x in fixpoint.reachable(chain, spark.createDataFrame([("c0",)], "node string")).collect()} == {f"c{i}": i for i in range(13)}
    with pytest.raises(fixpoint.NotConverged):
        fixpoint.reachable(spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(6)], "source string, target string"), spark.createDataFrame([("c0",)], "node string"), limit=2)


def test_change_ladder(spark):
    cols = "id string, kind string, module string, body_hash string, definition_hash string, docstring_hash string, annotation_hash string, imports array<string>, import_layout array<string>, statement_layout array<string>, defers_annotations boolean"
    row = lambda i, kind="function", body="b", d="d", doc="", ann="", imp=(), lay=(), defer=True: (i, kind, "m", body, d, doc, ann, list(imp), list(imp), list(lay), defer)
    base = spark.createDataFrame([row("gone"), row("body"), row("doc"), row("def"), row("ann"), row("noted", defer=False), row("m", "module", imp=["a"], d="1"), row("order", "class", lay=["x", "y", "z"]), row("same"), row("dep")], cols)
    head = spark.createDataFrame([row("new"), row("body", body="c", doc="q"), row("doc", doc="q"), row("def", d="e"), row("ann", ann="i"), row("noted", ann="i", defer=False), row("m", "module", imp=["a", "b"], d="2"), row("order", "class", lay=["y", "x", "z"]), row("same"), row("dep")], cols)
    deps = lambda *t: spark.createDataFrame([("dep", [("edge", "references", x, "") for x in t])], "id string, deps array<struct<cls:string,kind:string,target:string,detail:string>>")
    none = spark.createDataFrame([], "module string")
    got = {r.id: (r.changes, r.carries_impact, r.structural) for r in diff.classify(base, head, deps("x", "y"), deps("x"), none, none).collect()}
    assert got == {
        "gone": (["deleted"], True, True), "new": (["added"], True, True), "body": (["body_changed"], True, False), "doc": (["docstring_changed"], False, False), "def": (["definition_changed"], True, True),
        "ann": (["annotations_changed"], True, False), "noted": (["definition_changed"], True, True), "m": (["imports_added"], False, False), "order": (["definition_changed"], True, True), "dep": (["dependencies_changed"], True, True),
    }
    assert diff._reordered(["a", "b", "c"], ["a", "c", "b"]) and not diff._reordered(["a", "b"], ["a", "x", "b"])


def test_reordered_lists_as_by_the_plain_table():
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1] < sum(min(a.count(x), b.count(x)) for x in set(a))

    r = random.Random(2)
    for _ in range(2000):
        a, b = ([r.choice("abcde") for _ in range(r.randint(0, 8))] for _ in range(2))
        assert diff._reordered(a, b) == table(a, b)
    began, many = time.perf_counter(), [f"s{i}" for i in range(100_000)]
    assert not diff._reordered(many, many[::2]) and diff._reordered(many, [many[-1], *many[:-1]]) and diff._reordered(many, many[::-1])
    assert time.perf_counter() - began < 3


def test_graph_pieces(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a/__init__.py", "src/a/b.py", "lib/x/c.py", "src/a/no-name.py", "doc.txt")], "path string")
    assert {r.path: r.module for r in graph.module_names(files, ["src", "lib=top", ""]).collect()} == {"src/a/__init__.py": "a", "src/a/b.py": "a.b", "lib/x/c.py": "top.x.c", "src/a/no-name.py": None, "doc.txt": None}
    targets = spark.createDataFrame([("r", "1", "e", ["s", "a"]), ("r", "2", "e", ["s"]), ("q", "1", "gone", ["t"])], "runner string, runner_id string, entry_symbol string, lifecycle_dependencies array<string>")
    slim, edges = graph.factored(targets)
    assert {(r.runner, r.runner_id): r.lifecycle_dependencies for r in slim.collect()} == {("r", "1"): ["a"], ("r", "2"): [], ("q", "1"): []}
    assert ("runner:r:shared", "s") in {(r.source, r.target) for r in edges.collect()}
    found, missing = graph.target_edges(targets, spark.createDataFrame([("e",), ("s",), ("a",), ("t",)], "id string"))
    assert found.count() == 6 and [(r.node, r.rule, r.detail) for r in missing.collect()] == [("target:q:1", "entry_symbol_unresolved", "gone")]
    none = impact.for_all(spark.createDataFrame([], "rule string, detail string"), targets)
    assert none.count() == 0 and impact.for_all(spark.createDataFrame([("r", "runner_dependency", "m")], "runner string, rule string, detail string"), targets).count() == 2


def test_names(spark):
    row = spark.range(1).select(N.prefixes(F.lit("a.b.c")).alias("p"), N.ancestors(F.lit("x/y/z.py")).alias("a"), N.parent(F.lit("a.b.c")).alias("up"), N.parent(F.lit("a")).alias("top"), N.set_bits(F.lit(bytearray(b"\x05\x80"))).alias("bits"), N.folded_test(F.lit("t::x[a[1]]")).alias("f"), N.share(F.lit(1), F.lit(0)).alias("s"), N.code_span(F.lit("a|b\n c")).alias("c"), N.is_dunder(F.lit("m.__init__")).alias("d")).first()
    assert (row.p, row.a, row.up, row.top, row.bits, row.f, row.s, row.c, row.d) == (["a", "a.b", "a.b.c"], ["x", "x/y"], "a.b", "", [0, 2, 15], "t::x", "-", "a\\|b c", True)
    assert re.match(N.fnmatch_regex("a*[!b]?.py"), "a/xc1.py") and not re.match(N.fnmatch_regex("*.py"), "x.pyc")
    assert re.match(N.glob_regex("src/**/t_*.py"), "src/a/b/t_1.py") and re.match(N.glob_regex("src/**/t_*.py"), "src/t_1.py") and not re.match(N.glob_regex("src/*.py"), "src/a/b.py")
    assert N.relative_module("a.b.c", False, 2, "d") == "a.d" and N.relative_module("a.b", True, 1, None) == "a.b" and N.relative_module("a", False, 2, "x") is None
    assert N.commented_json('{"a": "//x", /* y */ "b": 1} // z') == {"a": "//x", "b": 1}


def test_evidence(spark):
    spans = spark.createDataFrame([("f", "mod", 1, 300), ("f", "cls", 10, 200), ("f", "fn", 60, 70)], "path string, symbol string, start int, end int")
    points = spark.createDataFrame([("f", 65), ("f", 100), ("f", 250), ("g", 1)], "path string, line int")
    assert {(r.path, r.line): r.symbol for r in evidence.innermost(points, spans).collect()} == {("f", 65): "fn", ("f", 100): "cls", ("f", 250): "mod", ("g", 1): None}
    known = spark.createDataFrame([("Src/A",), ("Src",)], "path string")
    assert evidence.canonical_paths(spark.createDataFrame([("src/a/b.py",), ("x",)], "path string"), known).select("canonical").orderBy("canonical").collect() == [("Src/A/b.py",), ("x",)]
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    found = evidence.decided(
        frame([("a",), ("b",), ("c",), ("d",)], "test_id string"), frame([("a", 0), ("b", 9), ("c", 6)], "test_id string, flags int"), frame([("a", "s1"), ("a", "s0"), ("x", "s1")], "test_id string, symbol string"),
        frame([("s0", "executed_changed"), ("s1", "executed_changed")], "symbol string, rule string"), frame([("c", "p")], "test_id string, path string"), frame([("d",)], "test_id string"), frame([("d", "new_target", "")], "test_id string, rule string, detail string"),
    )
    assert {(r.test_id, r.rule, r.detail) for r in found.collect()} == {("a", "executed_changed", "s0"), ("b", "no_evidence", ""), ("b", "subprocess", ""), ("c", "unstable", ""), ("c", "text_code", ""), ("c", "touched_file", "p"), ("d", "no_evidence", ""), ("d", "changed_target", ""), ("d", "new_target", "")}
    stored = paths.stored_results(frame([("f",)], "symbol string"), frame([("g", "f"), ("h", "g")], "source string, target string"), frame([("h", "v")], "source string, target string"), frame([("r", "v")], "source string, target string"))
    assert {tuple(r) for r in stored.collect()} == {("f", "changed"), ("g", "changed"), ("h", "changed"), ("v", "held"), ("r", "changed")}


def test_validation_and_rollups(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "affected boolean, selected boolean")
    q = validate.quality(rows).first()
    assert (q.caught, q.missed, q.recall, q.precision, q.savings) == (1, 1, 0.5, 0.5, 0.5)
    assert validate.corpus(validate.quality(rows)).first().ok is False
    spans = spark.createDataFrame([("f", "cls", None, 1, 9), ("f", "fn", "cls", 3, 5)], "path string, symbol string, container string, start int, end int")
    one = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    assert {r.line for r in validate.line_owners(spans, one("cls"), one("none")).collect()} == {1, 2, 6, 7, 8, 9}
    misses = spark.createDataFrame([(1, "a", "test"), (1, "b", "test"), (2, "c", "collection")], "run int, target string, kind string")
    assert {r.target for r in rollup.confirmed(misses, spark.createDataFrame([(1, "a")], "run int, target string")).collect()} == {"a", "c"}


def test_sources(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (repo / "a.py").write_text("x = 1\n")
    (repo / "data.txt").write_text("d")
    git("add", ".")
    git("commit", "-qm", "one")
    (repo / "a.py").write_text("x = 2\n")
    (repo / "b.py").write_text("y = 1\n")
    head, tree = snapshots.read_git(spark, str(repo)), snapshots.read_git(spark, str(repo), "WORKTREE", "tree", patterns=["b*"])
    assert {(r.path, r.status) for r in diff.changed_files(head, tree).collect()} == {("a.py", "changed"), ("b.py", "added")}
    assert {r.path: r.role for r in tree.collect()} == {"a.py": "source", "b.py": "other", "data.txt": "other"} and snapshots.read_git(spark, str(repo), "INDEX").count() == 2
    assert {r.path for r in snapshots.read_folder(spark, f"file://{repo}", "f").collect()} == {"a.py", "b.py", "data.txt"}
    assert snapshots.file_id(str(repo), "HEAD", "nope") is None and len(snapshots.commits_in_range(str(repo), "HEAD")) == 1
    with pytest.raises(documents.ManifestError):
        documents.parse_manifest('{"targets": [], "other": 1}')
    assert documents.parse_manifest('[{"runner": "r", "runner_id": "i", "entry_symbol": "e", "lifecycle_dependencies": ["b", "a", "b"]}]')[1] == [("r", "i", "e", ["a", "b"])]
    edges, always, out, problems = documents.parse_declarations('[[edges]]\nfrom = "a"\nto = "b"\nwhy = "w"\n[[always_run]]\ntargets = "*x"\nwhy = "smoke"\n[index]\nexclude = ["v/*"]\n[bad]\n')
    assert (edges, always, out, problems) == ([("a", "b", "w")], [("smoke", "*x", None)], ["v/*"], ["unknown key: bad"])
    (tmp_path / "r.xml").write_text('<testsuites><testsuite><testcase classname="t.a" name="x" time="0.5"/><testcase classname="t.a" name="y"><failure>f</failure></testcase><testcase classname="" name="t.b"><error>e</error></testcase></testsuite></testsuites>')
    assert {(r.name, r.outcome) for r in documents.read_junit(spark, str(tmp_path / "r.xml"), "run").collect()} == {("x", "passed"), ("y", "failed"), ("t.b", "error")}
    with sqlite3.connect(tmp_path / "cov.db") as db:
        db.executescript("CREATE TABLE context(id, context); CREATE TABLE file(id, path); CREATE TABLE line_bits(file_id, context_id, numbits); INSERT INTO context VALUES (1, 't1'), (2, ''); INSERT INTO file VALUES (1, 'a.py');")
        db.execute("INSERT INTO line_bits VALUES (1, 1, ?), (1, 2, ?)", (b"\x06", b"\xff"))
    assert {(r.test_id, r.line) for r in documents.read_coverage(spark, [str(tmp_path / "cov.db")]).collect()} == {("t1", 1), ("t1", 2)}
    pack = lambda n, w: struct.pack("<II", len(n), len(z := zlib.compress(json.dumps(w).encode()))) + n.encode() + z
    (tmp_path / "tests-1.bin").write_bytes(pack("t::a", {"codes": [1, 2], "flags": 8}) + pack("t::b", {"paths": ["p"]}) + b"\x01")
    assert {(r.test_id, r.kind, r.item, r.flags) for r in documents.read_windows(spark, str(tmp_path / "tests-1.bin")).collect()} == {("t::a", "codes", "1", 8), ("t::a", "codes", "2", 8), ("t::b", "paths", "p", 0)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/plan.json", "{}")
        z.writestr("x/big.bin", "0")
    assert [r.text for r in documents.read_archives(spark, str(tmp_path / "a.zip"), ["plan.json"]).collect()] == ["{}"]
    store = {"records": spark.createDataFrame([("t", 1)], "test_id string, flags int")}
    stores.write_store(store, str(tmp_path / "store"), "s1")
    assert [(r.store_id, r["count"]) for r in stores.list_stores(spark, str(tmp_path / "store")).collect()] == [("s1", 1)]


def test_streaming_store(spark, tmp_path):
    from tidemark.streaming import advance

    rows = lambda *r: spark.createDataFrame(list(r), "test_id string, item string, flags int").withColumn("recorded_at", F.to_timestamp(F.lit("2024-01-01")))
    for batch in ([("a", "x", 2), ("a", "y", 0), ("b", "z", 0)], [("a", "w", 1)]):
        rows(*batch).write.mode("append").parquet(str(tmp_path / "in"))
        advance.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r.test_id: (r["items"], r.flags) for r in advance.current(spark, str(tmp_path / "out")).collect()} == {"a": (["w"], 3), "b": (["z"], 0)}
