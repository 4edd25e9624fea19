"""Test targets of a snapshot by naming rules, with fixtures by nearest definition.

Classes count by name or, whatever their name, by ``unittest.TestCase`` among their bases; both also collect the tests they
inherit.  Fixtures are asked for by parameters, by ``usefixtures`` on a test or its class, or by ``autouse`` in their scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.extract.index import Index
from tidemark.functions.names import fnmatch_regex, parent, prefixes
from tidemark.operators.fixpoint import closure

DEFAULTS = {"python_files": ["test_*.py", "*_test.py"], "python_functions": ["test"], "python_classes": ["Test"], "testpaths": []}
#: Directories that are not entered unless a test path lies in them.
SKIPPED_DIRS = ("*.egg", ".*", "_darcs", "build", "CVS", "dist", "node_modules", "venv", "{arch}")
_FIXTURE = ("fixture", "pytest.fixture", "pytest.yield_fixture", "yield_fixture")
_CASES = ("unittest.TestCase", "TestCase", "unittest.IsolatedAsyncioTestCase", "IsolatedAsyncioTestCase")


def _starts(column: Column, heads: list[str]) -> Column:
    out = F.lit(False)
    for h in heads:
        out |= column.rlike(fnmatch_regex(h)) if any(x in h for x in "*?[") else column.startswith(h)
    return out


def _argument(key: str) -> Column:
    """The value of a fixture decorator's keyword, as written."""
    heads = [f"{n}({key}=" for n in _FIXTURE]
    found = F.filter("decorators", lambda x: F.substring_index(x, "=", 1).isin(*(h[:-1] for h in heads)))
    return F.get(F.transform(found, lambda x: F.regexp_extract(x, r"=(.*)\)$", 1)), F.lit(0))


def fixtures(index: Index) -> DataFrame:
    """(name, id, scope, shared, autouse, params): fixtures and where they are seen: in their class or module, or below a conftest."""
    own = index.symbols.where(F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda x: x.isin(*_FIXTURE)))
    where = F.when(F.substring_index("module", ".", -1) == "conftest", parent("module")).otherwise(F.col("module"))
    cls = F.when(F.col("kind") == "method", F.col("container"))
    return own.select(F.coalesce(_argument("name"), "name").alias("name"), "id", F.coalesce(cls, where).alias("scope"), F.col("module").endswith("conftest").alias("shared"), F.coalesce(_argument("autouse") == "True", F.lit(False)).alias("autouse"), "params")


def requests(index: Index, users: DataFrame) -> DataFrame:
    """(user, fixture) of the nearest definition of every requested name; ``users``: id, place, params.

    A definition is nearer the longer its scope is a prefix of the user's place: an as-of join on depth.
    """
    seen = fixtures(index).select("name", F.col("id").alias("fixture"), "scope")
    asked = users.select(F.col("id").alias("user"), "place", F.explode("params").alias("name")).where("name NOT IN ('self', 'cls', 'request')")
    scopes = asked.withColumn("scope", F.explode(F.concat(F.array(F.lit("")), prefixes("place"))))
    near = scopes.join(seen, ["name", "scope"]).where("fixture <> user").groupBy("user", "name").agg(F.max_by("fixture", F.length("scope")).alias("fixture"))
    return asked.select("user", "name").distinct().join(near, ["user", "name"], "left").select("user", F.coalesce("fixture", F.concat(F.lit("fixture:"), "name")).alias("fixture"))


def discover(index: Index, options: dict | None = None, builtin_fixtures: tuple[str, ...] = ("tmp_path", "monkeypatch", "capsys", "caplog", "tmpdir", "capfd", "recwarn", "tmp_path_factory")) -> DataFrame:
    """runner, runner_id, entry_symbol, lifecycle_dependencies of pytest's targets."""
    o = DEFAULTS | (options or {})
    s = index.symbols
    name = F.substring_index("path", "/", -1)
    match = F.lit(False)
    for p in o["python_files"]:
        match |= name.rlike(fnmatch_regex(p))
    under = F.lit(not o["testpaths"])
    for p in o["testpaths"]:
        under |= F.col("path").startswith(p.rstrip("/") + "/")
    inside = s.where(match & under)
    skip = "|".join(f"(?:{fnmatch_regex(p)})" for p in SKIPPED_DIRS)
    if not o["testpaths"]:
        inside = inside.where(~F.exists(F.split(parent("path", "/"), "/"), lambda d: d.rlike(skip)))
    functions = inside.where("kind = 'function'").where(_starts(F.col("name"), o["python_functions"]))
    every = s.where("kind = 'class'").select(F.col("id").alias("cls"), "bases")
    cased = every.where(F.exists(F.coalesce("bases", F.array().cast("array<string>")), lambda x: x.isin(*_CASES))).select("cls")
    up = closure(index.bases.select(F.col("cls").alias("source"), F.col("base").alias("target")), every.select(F.col("cls").alias("node")))
    cased = up.join(cased.select(F.col("cls").alias("node")), "node", "left_semi").select(F.col("origin").alias("container"), F.lit(True).alias("cased")).distinct()
    classes = inside.where("kind = 'class'").select(F.col("id").alias("container"), F.col("name").alias("cls"), F.col("path").alias("at"), F.col("module").alias("home"), F.coalesce("decorators", F.array().cast("array<string>")).alias("worn")).join(cased, "container", "left")
    has_init = s.where("name = '__init__' AND kind = 'method'").select("container")
    named = classes.where("cased IS NULL").where(_starts(F.col("cls"), o["python_classes"])).join(has_init, "container", "left_anti")
    classes = named.unionByName(classes.where("cased"))
    # A class's tests are its own and those it inherits, the nearest definition of each name.
    above = up.select(F.col("origin").alias("container"), F.col("node").alias("owner"))
    method = s.where("kind = 'method'").select("id", F.col("container").alias("owner"), "name", "params", F.coalesce("decorators", F.array().cast("array<string>")).alias("decorators"))
    depth = up.groupBy(F.col("node").alias("owner")).agg(F.count("*").alias("below"))
    held = classes.join(above, "container").join(method, "owner").where(F.when(F.col("cased"), F.col("name").startswith("test")).otherwise(_starts(F.col("name"), o["python_functions"]))).join(depth, "owner")
    nearest = held.groupBy("container", "name").agg(F.min_by("id", F.struct(F.col("owner") != F.col("container"), "below", "owner")).alias("id"))
    methods = held.join(nearest, ["container", "name", "id"], "left_semi")
    tests = functions.select("id", "path", "module", "container", "params", F.coalesce("decorators", F.array().cast("array<string>")).alias("decorators"), F.concat("path", F.lit("::"), "name").alias("runner_id")).unionByName(
        methods.select("id", F.col("at").alias("path"), F.col("home").alias("module"), "container", F.when(F.col("cased"), F.array().cast("array<string>")).otherwise(F.col("params")).alias("params"), F.concat("decorators", "worn").alias("decorators"), F.concat_ws("::", "at", "cls", "name").alias("runner_id")))
    wanted = F.transform(F.filter("decorators", lambda x: x.rlike(r"(^|\.)usefixtures\(")), lambda x: F.regexp_extract(x, r"\((.*)\)$", 1))
    known = fixtures(index)
    users = tests.select(F.col("runner_id").alias("id"), F.col("container").alias("place"), F.concat(F.coalesce("params", F.array().cast("array<string>")), wanted).alias("params")).unionByName(known.select("id", F.col("scope").alias("place"), "params"))
    asked = requests(index, users).where(~F.col("fixture").isin(*(f"fixture:{x}" for x in builtin_fixtures)))
    places = tests.select(F.col("runner_id").alias("user"), F.explode(F.concat(F.array(F.lit("")), prefixes("container"))).alias("scope"))
    asked = asked.unionByName(places.join(known.where("autouse").select("scope", F.col("id").alias("fixture")), "scope").select("user", "fixture"))
    graph = asked.select(F.col("user").alias("source"), F.col("fixture").alias("target"))
    reach = closure(graph, tests.select(F.col("runner_id").alias("node"))).where("origin <> node").select(F.col("origin").alias("runner_id"), F.col("node").alias("dep"))
    modules = s.where("kind = 'module'").select(F.col("id").alias("dep"))
    chain = tests.select("runner_id", F.explode(F.transform(F.concat(F.array(F.lit("")), prefixes(parent("module"))), lambda x: F.when(x == "", "conftest").otherwise(F.concat(x, F.lit(".conftest"))))).alias("dep")).join(modules, "dep", "left_semi").select("runner_id", "dep")
    hooks = s.where("name IN ('setup_method', 'setup_class', 'setup_module', 'setup_function', 'teardown_method', 'teardown_class', 'teardown_module', 'setUp', 'tearDown', 'setUpClass', 'tearDownClass', 'setUpModule', 'tearDownModule', 'asyncSetUp', 'asyncTearDown')").select(F.col("container").alias("at"), F.col("id").alias("dep"))
    homes = tests.select("runner_id", F.col("module").alias("at")).unionByName(tests.select("runner_id", "container").join(above, "container").select("runner_id", F.col("owner").alias("at")))
    setup = homes.join(hooks, "at").select("runner_id", "dep")
    own = tests.select("runner_id", F.col("module").alias("dep"))
    deps = reach.unionByName(chain).unionByName(setup).unionByName(own).groupBy("runner_id").agg(F.array_sort(F.collect_set("dep")).alias("lifecycle_dependencies"))
    return tests.join(deps, "runner_id", "left").select(F.lit("pytest").alias("runner"), "runner_id", F.col("id").alias("entry_symbol"), F.coalesce("lifecycle_dependencies", F.array().cast("array<string>")).alias("lifecycle_dependencies"))


def discover_benchmarks(index: Index, directory: str = "benchmarks") -> DataFrame:
    """Benchmarks by method prefixes in a directory, with their class's setup as lifecycle dependency."""
    s = index.symbols.where(F.col("path").startswith(directory.rstrip("/") + "/"))
    marks = F.col("name").rlike("^(time|timeraw|mem|peakmem|track)_")
    own = s.where("kind IN ('function', 'method')").where(marks)
    setup = s.where("name IN ('setup', 'setup_cache', 'teardown')").groupBy("container").agg(F.array_sort(F.collect_set("id")).alias("lifecycle_dependencies"))
    return own.join(setup, "container", "left").select(F.lit("asv").alias("runner"), F.regexp_replace("id", r"^[^.]+\.", "").alias("runner_id"), F.col("id").alias("entry_symbol"), F.coalesce("lifecycle_dependencies", F.array().cast("array<string>")).alias("lifecycle_dependencies"))
