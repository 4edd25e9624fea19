"""Stores of recorded execution as partitioned tables: a store changes in all its relations at once, and equal sets are kept once.

A write puts each relation under a version of its own, which no reader looks at until the store's file in ``stores`` names it; that file is
replaced by one rename.  A writer that fails leaves the old version in place, and readers that began before go on reading it.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.evidence import interned
from tidemark.tables import written

TABLES = {"records": "test_id string, flags int", "exec": "test_id string, symbol string", "touched": "test_id string, path string", "listed": "test_id string, dir string", "phases": "phase string, item string, module string"}
#: Relations that are a set of items for each test, and what their items are called.
SETS = {"exec": "symbol", "touched": "path", "listed": "dir"}
_PART = "store_id string, version string"


def _path(spark: SparkSession, name: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _publish(spark: SparkSession, folder: str, entry: dict) -> None:
    """Name a store's version in its file, by a rename that replaces."""
    jvm, name = spark.sparkContext._jvm, quote(entry["store_id"], safe="")
    files, hidden = _path(spark, f"{folder}/stores/.{name}.{entry['version']}")
    out = files.create(hidden)
    out.write(json.dumps(entry).encode())
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    target = files.makeQualified(_path(spark, f"{folder}/stores/{name}.json")[1])
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(hidden), target, how)


def write_store(relations: dict[str, DataFrame], folder: str, store_id: str) -> None:
    """Replace a store by these relations, whole or not at all.  Rows of sets without a test or item are left out."""
    if not relations:
        raise ValueError("a store has at least one relation")
    version, parts = uuid.uuid4().hex, []
    for name, rows in relations.items():
        rows = rows.select(*(c.split()[0] for c in TABLES[name].split(", ")))
        if name in SETS:
            rows, sets = interned(rows, "test_id", SETS[name])
            parts.append((f"{name}_sets", sets))
        parts.append((name, rows))
    for name, rows in parts:
        rows.write.parquet(f"{folder}/{name}/store_id={quote(store_id, safe='')}/version={version}")
    _publish(parts[0][1].sparkSession, folder, {"store_id": store_id, "version": version, "relations": sorted(relations)})


def _current(spark: SparkSession, folder: str, store_id: str | None = None) -> DataFrame:
    """(store_id, version) that hold now; read once, so that all relations are of one state."""
    rows = spark.read.schema(_PART).json(f"{folder}/stores")
    return written((rows if store_id is None else rows.where(F.col("store_id") == store_id)).select("store_id", "version"), "stores")


def _relation(spark: SparkSession, folder: str, name: str, schema: str, now: DataFrame, only: list) -> DataFrame:
    files, path = _path(spark, f"{folder}/{name}")
    if not files.exists(path):
        return spark.createDataFrame([], f"{schema}, {_PART}")
    rows = spark.read.schema(f"{schema}, {_PART}").parquet(f"{folder}/{name}")
    if only:  # one store: its version is a constant, which prunes folders
        rows = rows.where((F.col("store_id") == only[0].store_id) & (F.col("version") == only[0].version))
    return rows.join(now, ["store_id", "version"])


def read_store(spark: SparkSession, folder: str, store_id: str | None = None) -> dict[str, DataFrame]:
    """All relations of one store, or of all, each with ``store_id``."""
    now = _current(spark, folder, store_id)
    only = now.collect() if store_id is not None else []  # at most one row
    out = {}
    for name, schema in TABLES.items():
        if name not in SETS:
            out[name] = _relation(spark, folder, name, schema, now, only).drop("version")
            continue
        item = SETS[name]
        who = _relation(spark, folder, name, "test_id string, set_id string", now, only)
        sets = _relation(spark, folder, f"{name}_sets", f"set_id string, {item} string", now, only)
        out[name] = who.join(sets, ["store_id", "version", "set_id"]).select("test_id", item, "store_id")
    return out


def list_stores(spark: SparkSession, folder: str) -> DataFrame:
    now = _current(spark, folder)
    return _relation(spark, folder, "records", TABLES["records"], now, []).groupBy("store_id").count()


def vacuum(spark: SparkSession, folder: str, older_than: int = 86_400) -> list[str]:
    """Remove versions that no store names and that are older than so many seconds: younger ones may still be written, or read."""
    named = {r.version for r in spark.read.schema(_PART).json(f"{folder}/stores").select("version").toLocalIterator()}
    gone, before = [], spark.sparkContext._jvm.System.currentTimeMillis() - 1000 * older_than
    files, pattern = _path(spark, f"{folder}/*/store_id=*/version=*")
    for found in files.globStatus(pattern) or []:
        if found.getPath().getName().partition("=")[2] not in named and found.getModificationTime() <= before:
            files.delete(found.getPath(), True)
            gone.append(found.getPath().toString())
    return gone
