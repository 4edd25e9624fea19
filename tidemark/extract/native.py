"""A tolerant reader of extension sources: functions, names outside them, and the rest of a file."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

PARTS = "path string, scope string, name string, digest string, lineno int"
_DEF = re.compile(r"^(?P<indent>[ \t]*)(?:async\s+)?(?P<kind>cpdef|cdef|def|class)\b(?P<rest>[^\n]*)")
_NAME = re.compile(r"(?:cdef\s+)?(?:[\w\[\], *.]+\s+)?[*&]*(?P<name>[A-Za-z_]\w*)\s*(?:=|$)")


def _digest(lines: list[str]) -> str:
    """A hash of what is no comment, blank or layout."""
    plain = [" ".join(re.sub(r"(?<!['\"\w])#.*$", "", x).split()) for x in lines]
    return hashlib.sha1("\n".join(x for x in plain if x).encode()).hexdigest()[:16]


def parts(text: str) -> list[tuple[str, str, str, int]]:
    """(scope, name, digest, line): ``function`` bodies, ``name`` statements at the top, else ``file`` lines."""
    lines, out, scope, i, rest = text.split("\n"), [], [], 0, []
    while i < len(lines):
        m = _DEF.match(lines[i])
        indent = len(lines[i]) - len(lines[i].lstrip())
        if lines[i].strip():
            scope = [s for s in scope if s[0] < indent]
        name = re.search(r"([A-Za-z_]\w*)\s*(?=\(|:|$)", m["rest"]) if m else None
        is_class = bool(m) and (m["kind"] == "class" or bool(re.match(r"\s*class\b", m["rest"])))
        if m and name and (is_class or m["kind"] == "def" or "(" in m["rest"]):
            full = ".".join([*(s[1] for s in scope), name[1]])
            if is_class:
                scope.append((indent, name[1]))
                rest.append(lines[i])
                i += 1
                continue
            j = i + 1
            while j < len(lines) and (not lines[j].strip() or len(lines[j]) - len(lines[j].lstrip()) > indent or lines[j].lstrip().startswith(")")):
                j += 1
            out.append(("function", full, _digest(lines[i:j]), i + 1))
            i = j
            continue
        top = _NAME.match(lines[i]) if indent == 0 and lines[i].strip() and not re.match(r"(?:from|import|cimport|if|else|for|while|with|try|except|@|#)", lines[i]) else None
        if top:
            out.append(("name", top["name"], _digest([lines[i]]), i + 1))
        else:
            rest.append(lines[i])
        i += 1
    return [*out, ("file", "", _digest(rest), 1)]


def read(files: DataFrame) -> DataFrame:
    """The parts of extension sources (path, content), for ``diff.native_changes``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(p, s, n, d, k) for p, c in zip(part["path"], part["content"], strict=True) for s, n, d, k in parts(bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["path", "scope", "name", "digest", "lineno"])

    return files.where("path RLIKE '[.](pyx|pxd|pxi)$' AND content IS NOT NULL").select("path", "content").mapInPandas(run, PARTS)
