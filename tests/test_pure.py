"""What needs no engine: configuration, extension sources, facts of one file, commands."""

from tidemark.cli import parser
from tidemark.discovery import config
from tidemark.extract import native
from tidemark.extract.pyfacts import file_facts


def test_configuration():
    files = {"setup.cfg": "[tool:pytest]\npython_files = a_*.py\n", "pyproject.toml": '[tool.pytest.ini_options]\ntestpaths = ["t"]\npython_classes = "Check Test"\n', "tox.ini": "[other]\n"}
    options, notes = config.pytest_options(files, {"python_functions": "check"})
    assert options == {"python_files": ["test_*.py", "*_test.py"], "python_functions": ["check"], "python_classes": ["Check", "Test"], "testpaths": ["t"]} and not notes
    assert config.pytest_options({"pytest.ini": ""})[0]["testpaths"] == [] and config.pytest_options({"pyproject.toml": "["})[1]
    assert config.command_options("python -m pytest -o testpaths='a b' -k x tests/unit -q") == ({"testpaths": "a b"}, ["tests/unit"])
    assert config.benchmark_directory('{\n // where\n "benchmark_dir": "perf"}') == "perf"


def test_extension_sources():
    text = "import x\ncdef int LIMIT = 3\n\ncdef class Box:\n    cdef int n\n    def run(self):\n        return 1\n\ncpdef int add(int a):\n    # note\n    return a\n"
    own = {(s, n): d for s, n, d, _ in native.parts(text)}
    assert set(own) == {("name", "LIMIT"), ("function", "Box.run"), ("function", "add"), ("file", "")}
    changed = {(s, n): d for s, n, d, _ in native.parts(text.replace("return a", "return a + 1").replace("# note", "# other"))}
    assert {k for k in own if own[k] != changed[k]} == {("function", "add")}


def test_facts():
    rows = file_facts("s", "m.py", "m", b"from . import a\nimport b.c as d\nX = 1\n\nclass C(d.B):\n    '''doc'''\n    def f(self, p):\n        global G\n        G = 1\n        self.g()\n        q = d.h(p.z)\n        return [X for X in q]\n")
    uses = {(r["id"], r["target"], r["detail"]) for r in rows if r["row"] == "use"}
    assert {("m.C", "d.B", ""), ("m.C.f", "m.C.g", ""), ("m.C.f", "G", "writes"), ("m.C.f", "d.h", "")} <= uses
    assert {("m.C.f", "z")} <= {(r["id"], r["name"]) for r in rows if r["row"] == "unresolved"}
    assert ("d", "b.c") in {(r["name"], r["target"]) for r in rows if r["row"] == "binding"}
    again = file_facts("s", "m.py", "m", b"X = 1  # note\n\n\n")
    assert [r["body_hash"] for r in again if r.get("id") == "m.X"] == [r["body_hash"] for r in rows if r.get("id") == "m.X" and r["row"] == "symbol"]
    assert file_facts("s", "m.py", "m", b"def (")[0]["row"] == "error" and file_facts("s", "m.py", "m", b"# coding: latin-1\nx = '\xe9'\n")[0]["row"] != "error"


def test_commands():
    o = parser().parse_args(["plan", "--base", "HEAD", "--source-root", "src"])
    assert (o.command, o.head, o.source_root) == ("plan", "WORKTREE", ["src"])
