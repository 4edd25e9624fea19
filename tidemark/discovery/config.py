"""Runner settings from configuration files and command lines."""

from __future__ import annotations

import configparser
import shlex
import tomllib

from tidemark.discovery.pytest_rules import DEFAULTS
from tidemark.functions.names import commented_json

#: Files in the order in which the first that has settings counts.
ORDER = ("pytest.ini", ".pytest.ini", "pyproject.toml", "tox.ini", "setup.cfg")


def _listed(value) -> list[str]:
    return list(value) if isinstance(value, list) else shlex.split(value)


def pytest_options(files: dict[str, str], overrides: dict[str, str] | None = None) -> tuple[dict, list[str]]:
    """(options, notes) of a repository's root files; ``overrides`` come from the command line."""
    notes: list[str] = []
    own: dict = {}
    for name in ORDER:
        if name not in files:
            continue
        try:
            if name == "pyproject.toml":
                section = tomllib.loads(files[name]).get("tool", {}).get("pytest", {}).get("ini_options")
            else:
                parser = configparser.ConfigParser(interpolation=None)
                parser.read_string(files[name])
                title = "tool:pytest" if name == "setup.cfg" else "pytest"
                section = dict(parser[title]) if parser.has_section(title) else {} if name.endswith("pytest.ini") else None
        except (tomllib.TOMLDecodeError, configparser.Error) as e:
            notes.append(f"{name}: {e}")
            continue
        if section is not None:
            own = section
            break
    merged = own | (overrides or {})
    options = {k: _listed(merged[k]) if k in merged else v for k, v in DEFAULTS.items()}
    if merged.get("addopts") and "-p" in _listed(merged["addopts"]):
        notes.append("plugins named in addopts are not read")
    return options, notes


def command_options(command: str) -> tuple[dict[str, str], list[str]]:
    """(overrides, paths) of a pytest command line: ``-o name=value`` and what is no option."""
    words, overrides, paths = shlex.split(command), {}, []
    while words:
        w = words.pop(0)
        if w in ("-o", "--override-ini") and words:
            k, _, v = words.pop(0).partition("=")
            overrides[k] = v
        elif w in ("-k", "-m", "-p", "-c", "-n") and words:
            words.pop(0)
        elif not w.startswith("-") and w not in ("python", "pytest", "-m"):
            paths.append(w)
    return overrides, paths


def benchmark_directory(text: str) -> str:
    """The benchmark folder that a commented JSON configuration names."""
    return commented_json(text).get("benchmark_dir", "benchmarks")
