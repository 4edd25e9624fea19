"""Documents that runs leave: manifests, declarations, reports, results, coverage, recordings."""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import tomllib
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import set_bits
from tidemark.schema import CASES, TARGETS


class ManifestError(ValueError):
    """A manifest is not as it should be."""


_TARGET_KEYS = {"runner", "runner_id", "entry_symbol", "lifecycle_dependencies"}


def parse_manifest(text: str) -> tuple[list[str], list[tuple]]:
    """(source roots, target rows) of a manifest; a bare list of targets will do."""
    data = json.loads(text)
    if isinstance(data, list):
        data = {"targets": data}
    if not isinstance(data, dict) or set(data) - {"source_roots", "targets", "discovery"}:
        raise ManifestError(f"unknown keys: {sorted(set(data) - {'source_roots', 'targets', 'discovery'}) if isinstance(data, dict) else type(data)}")
    rows, seen = [], set()
    for t in data.get("targets", []):
        if not isinstance(t, dict) or set(t) - _TARGET_KEYS or not all(isinstance(t.get(k), str) and t[k] for k in ("runner", "runner_id", "entry_symbol")):
            raise ManifestError(f"bad target: {t}")
        key = (t["runner"], t["runner_id"])
        if key in seen:
            raise ManifestError(f"target twice: {key}")
        seen.add(key)
        rows.append((*key, t["entry_symbol"], sorted(set(t.get("lifecycle_dependencies", [])))))
    return list(data.get("source_roots", [])), rows


def read_manifest(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_manifest(text)[1], TARGETS)


def parse_declarations(text: str) -> tuple[list[tuple], list[tuple], list[str], list[str]]:
    """(edges (source, target, why), always_run (label, pattern, runner), exclusions, problems) of a TOML text."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return [], [], [], [str(e)]
    problems = [f"unknown key: {k}" for k in sorted(set(data) - {"edges", "always_run", "index"})]
    edges, always = [], []
    for e in data.get("edges", []):
        if set(e) == {"from", "to", "why"} and all(isinstance(v, str) and v for v in e.values()):
            edges.append((e["from"], e["to"], e["why"]))
        else:
            problems.append(f"bad edge: {e}")
    for a in data.get("always_run", []):
        if {"targets", "why"} <= set(a) <= {"targets", "why", "runner"}:
            always.append((a["why"], a["targets"], a.get("runner")))
        else:
            problems.append(f"bad always_run: {a}")
    index = data.get("index", {})
    problems += [f"unknown key: index.{k}" for k in sorted(set(index) - {"exclude"})]
    return edges, always, list(index.get("exclude", [])), problems


def read_junit(spark: SparkSession, path: str, run: str) -> DataFrame:
    """CASES rows of JUnit files; an error counts before a failure, that before a skip."""
    schema = "_classname string, _name string, _time double, error array<string>, failure array<string>, skipped array<string>"
    rows = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("failure").isNotNull(), "failed").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return rows.select(F.lit(run).alias("run"), F.coalesce("_classname", F.lit("")).alias("classname"), F.col("_name").alias("name"), outcome.alias("outcome"), F.coalesce("_time", F.lit(0.0)).alias("time"))


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """runner, runner_id, selected of a plan document."""
    target = "array<struct<runner:string,runner_id:string,entry_symbol:string,rules:array<string>>>"
    rows = spark.read.schema(f"schema_version int, selected_targets {target}, unselected_targets {target}").option("multiLine", "true").option("mode", "FAILFAST").json(path)
    own = lambda c, flag: rows.select(F.explode(c).alias("t")).select("t.runner", "t.runner_id", F.lit(flag).alias("selected"), F.coalesce("t.rules", F.array().cast("array<string>")).alias("rules"))
    return own("selected_targets", True).unionByName(own("unselected_targets", False))


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """test, case, outcome of lines ``nodeid TAB OUTCOME``."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) == 2)
    return rows.select(F.regexp_replace(parts[0], r"(?s)\[.*\]$", "").alias("test"), parts[0].alias("case"), F.trim(parts[1]).alias("outcome"))


def read_artifacts(spark: SparkSession, folder: str, schema: str, name: str = "context.json") -> DataFrame:
    """JSON artifacts ``<run>/<artifact>/<name>`` with their run and artifact; malformed ones have ``broken``."""
    rows = spark.read.schema(f"{schema}, broken string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(folder)
    parts = F.split("_metadata.file_path", "/")
    return rows.select("*", F.element_at(parts, -3).alias("run"), F.element_at(parts, -2).alias("artifact"))


def read_archives(spark: SparkSession, path: str, members: list[str]) -> DataFrame:
    """(archive, member, text) of the wanted members of zip files, unpacked on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, c in zip(part["path"], part["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                        rows += [(p, n, z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.rpartition("/")[2] in members]
                except zipfile.BadZipFile:
                    rows.append((p, "", None))
            yield pd.DataFrame(rows, columns=["archive", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, text string")


def _coverage_rows(content: bytes) -> Iterator[list[tuple]]:
    """(test_id, path, bits, line) of one database, in parts; it is opened in memory, without a local file."""
    own = bytearray(content)
    own[18:20] = b"\x01\x01"  # no log beside it
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(bytes(own))
        tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        asked = []
        if "line_bits" in tables:
            asked.append("SELECT c.context, f.path, l.numbits, NULL FROM line_bits l JOIN context c ON c.id = l.context_id JOIN file f ON f.id = l.file_id WHERE c.context <> ''")
        if "arc" in tables:
            asked.append("SELECT c.context, f.path, NULL, a.tono FROM arc a JOIN context c ON c.id = a.context_id JOIN file f ON f.id = a.file_id WHERE a.tono > 0 AND c.context <> ''")
        for query in asked:
            rows = db.execute(query)
            while part := rows.fetchmany(10_000):
                yield part
    finally:
        db.close()


def read_coverage(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(test_id, path, line) of coverage databases, bitmaps and arcs alike; each file is decoded by the task that reads it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                for rows in _coverage_rows(bytes(content)) if len(content) else ():
                    out = pd.DataFrame(rows, columns=["test_id", "path", "bits", "line"])
                    yield out.astype({"line": "Int32"})

    rows = spark.read.format("binaryFile").load(paths).select("content").mapInPandas(run, "test_id string, path string, bits binary, line int")
    line = F.explode(F.when(F.col("bits").isNull(), F.array("line")).otherwise(set_bits("bits")))
    return rows.select("test_id", "path", line.alias("line")).distinct()


def parse_tests(data: bytes) -> Iterator[tuple[str, dict]]:
    """(test, window) of a recorder's file: lengths, name and packed JSON, again and again; a torn end is dropped."""
    at = 0
    while at + 8 <= len(data):
        n, m = struct.unpack_from("<II", data, at)
        if at + 8 + n + m > len(data):
            return
        yield data[at + 8 : at + 8 + n].decode(), json.loads(zlib.decompress(data[at + 8 + n : at + 8 + n + m]))
        at += 8 + n + m


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """(file, test_id, kind, item, flags) of recorder files, decoded on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, c in zip(part["path"], part["content"], strict=True):
                for test, w in parse_tests(bytes(c)):
                    flags = int(w.get("flags", 0))
                    rows += [(p, test, kind, str(x), flags) for kind in ("codes", "paths", "dirs", "fixtures", "causes") for x in w.get(kind, [])] or [(p, test, "", "", flags)]
            yield pd.DataFrame(rows, columns=["file", "test_id", "kind", "item", "flags"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, test_id string, kind string, item string, flags int")


def cases(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CASES)
