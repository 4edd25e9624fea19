"""Scalar functions on dotted names, paths, patterns and bitmaps, as column expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digest16(x: Column | str) -> Column:
    """The first 16 hex digits of SHA-1."""
    return F.substring(F.sha1(_c(x).cast("binary")), 1, 16)


def prefixes(x: Column | str, separator: str = ".", proper: bool = False) -> Column:
    """All prefixes of a name by its parts, shortest first; ``proper`` leaves out the name itself."""
    parts = F.split(_c(x), re.escape(separator))
    n = F.size(parts) - (1 if proper else 0)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), separator))).otherwise(F.array().cast("array<string>"))


def parent(x: Column | str, separator: str = ".") -> Column:
    """The name without its last part; empty for a single part."""
    parts = F.split(_c(x), re.escape(separator))
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), separator)


def short_name(x: Column | str, separator: str = ".") -> Column:
    return F.substring_index(_c(x), separator, -1)


def ancestors(path: Column | str) -> Column:
    """The directories above a path, outermost first."""
    return prefixes(path, "/", proper=True)


def fnmatch_regex(pattern: str) -> str:
    """A regular expression for a case-sensitive shell pattern whose ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] == '!' else body}]")
            i = end
        else:
            out.append(re.sub(r"([^A-Za-z0-9_/])", r"\\\1", c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def glob_regex(pattern: str) -> str:
    """A regular expression for a path pattern: ``*`` stays within a part, ``**`` spans parts."""
    parts = []
    for k, part in enumerate(pattern.split("/")):
        if part == "**":
            parts.append("(?:[^/]+/)*" if k < pattern.count("/") else ".*")
        else:
            own = re.sub(r"([^A-Za-z0-9_*?])", r"\\\1", part).replace("*", "[^/]*").replace("?", "[^/]")
            parts.append(own + ("/" if k < pattern.count("/") else ""))
    return f"^{''.join(parts)}$"


def is_dunder(x: Column | str) -> Column:
    return short_name(x).rlike(r"^__.+__$")


def is_conftest(module: Column | str) -> Column:
    return short_name(module) == "conftest"


#: Names, endings and folders of files that builds, installers, runners and continuous integration read, in lower case.
BUILD_NAMES = (
    "pyproject.toml", "setup.cfg", "tox.ini", "pytest.toml", ".pytest.toml", "pytest.ini", ".pytest.ini", "uv.toml", "hatch.toml", "poetry.toml", "pdm.toml", ".pdm.toml", "manifest.in",
    "meson.build", "meson.options", "meson_options.txt", "cmakelists.txt", "makefile", "gnumakefile", "pipfile", "pixi.toml", ".python-version", ".coveragerc", "cargo.toml", "build.rs",
    "mypy.ini", ".mypy.ini", "pyrightconfig.json", "ruff.toml", ".ruff.toml", ".flake8", ".pylintrc", "pylintrc", ".env", ".gitlab-ci.yml", "azure-pipelines.yml", ".travis.yml", "appveyor.yml",
    "setup.py", "hatch_build.py", "pdm_build.py", "noxfile.py", "toxfile.py", "sitecustomize.py", "usercustomize.py", "build.py",
)
BUILD_ENDINGS = (
    ".pyx", ".pxd", ".pxi", ".c", ".h", ".cc", ".cpp", ".cxx", ".hh", ".hpp", ".f", ".f77", ".for", ".f90", ".f95", ".pyf", ".rs", ".cu", ".i", ".swg", ".m", ".mm", ".src", ".in", ".tpl",
    ".so", ".pyd", ".dylib", ".dll", ".lock", ".pth",
)
BUILD_FOLDERS = (".github/workflows/", ".github/actions/", ".circleci/", "ci/", ".ci/")
DEPENDENCY_WORDS = r"requirement|constraint|^environment|conda-lock|(^|[-_.])(deps|dependencies)([-_.]|$)"
DEPENDENCY_ENDINGS = (".txt", ".in", ".pip", ".yml", ".yaml")
METADATA_FOLDERS = (".dist-info", ".egg-info", ".egg", ".egg-link")
#: runners' own configuration, read at the top of a repository, and that of benchmarks, read anywhere.
RUNNER_FILES = ("pytest.toml", ".pytest.toml", "pytest.ini", ".pytest.ini", "pyproject.toml", "tox.ini", "setup.cfg", "asv.conf.json", "asv.conf.jsonc")
BENCHMARK_FILES = ("asv.conf.json", "asv.conf.jsonc")
#: Of build names, a module of its own name unless it lies at the top or beside a project's file.
BESIDE_PROJECT, PROJECT_FILES = ("build.py",), ("pyproject.toml", "setup.cfg")


def _ends(name: Column, endings: tuple[str, ...]) -> Column:
    return name.rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + r")$")


def build_input(path: Column | str) -> Column:
    """Whether a file decides what is built, installed or collected, or how tests run; compared without case."""
    lower = F.lower(_c(path))
    parts, name = F.split(lower, "/"), F.substring_index(lower, "/", -1)
    declares = _ends(name, DEPENDENCY_ENDINGS) & F.exists(parts, lambda p: p.rlike(DEPENDENCY_WORDS))
    inside = lower.rlike("^(" + "|".join(f.replace(".", r"\.") for f in BUILD_FOLDERS) + ")") | F.exists(parts, lambda p: _ends(p, METADATA_FOLDERS))
    return name.isin(*BUILD_NAMES) | _ends(name, BUILD_ENDINGS) | name.rlike(r"^\.env\.|^pylock\..*\.toml$") | declares | inside


def runner_file(path: Column | str) -> Column:
    """Whether a file outside the source roots still decides how the tests run."""
    name = F.substring_index(_c(path), "/", -1)
    return _c(path).isin(*RUNNER_FILES) | name.isin("conftest.py", *BENCHMARK_FILES) | build_input(path)


def under(path: Column | str, roots: list[str]) -> Column:
    """Whether a path lies under one of some source roots, ``dir`` or ``dir=prefix``."""
    folders = [f.strip("/") for f in (r.partition("=")[0] for r in roots)]
    return F.lit(True) if any(f in ("", ".") for f in folders) else F.coalesce(*(F.when(_c(path).startswith(f"{f}/"), True) for f in folders), F.lit(False))


def set_bits(bitmap: Column | str) -> Column:
    """The places of the ones of a binary bitmap: bit b of byte k stands for 8 k + b."""
    hexed = F.hex(_c(bitmap))
    n = F.length(_c(bitmap)) * 8
    byte = lambda i: F.conv(F.substring(hexed, F.floor(i / 8).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.call_function("getbit", byte(i), F.pmod(i, F.lit(8))) == 1)


def code_span(x: Column | str) -> Column:
    """A table cell: line breaks become blanks, bars are escaped."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"\s*\n\s*", " "), r"\|", r"\\|")


def share(part: Column | str, whole: Column | str) -> Column:
    """A percentage in words, or a dash for nothing of nothing."""
    return F.coalesce(F.concat(F.round(100 * F.try_divide(_c(part).cast("double"), _c(whole).cast("double"))).cast("int").cast("string"), F.lit(" %")), F.lit("-"))


def folded_test(x: Column | str) -> Column:
    """A test identifier without its parameter case."""
    return F.regexp_replace(_c(x), r"(?s)\[.*\]$", "")


def relative_module(module: str, is_package: bool, level: int, name: str | None) -> str | None:
    """The absolute module that a relative import names; null when it leads above the top."""
    if level == 0:
        return name
    parts = module.split(".")
    up = level - (1 if is_package else 0)
    if up > len(parts) or (up == len(parts) and not name):
        return None
    base = parts[: len(parts) - up]
    return ".".join([*base, *([name] if name else [])]) or None


def imports_anything(detail: Column | str) -> Column:
    """Whether a dynamic import may name any module: its bound is empty or begins with an unknown."""
    return (F.coalesce(_c(detail), F.lit("")) == "") | _c(detail).startswith("*")


def strip_json_comments(text: str) -> str:
    """JSON without ``//`` and ``/* */`` comments; strings stay as they are."""
    return re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', lambda m: m.group() if m.group()[0] == '"' else " ", text, flags=re.S)


def commented_json(text: str):
    return json.loads(strip_json_comments(text))
