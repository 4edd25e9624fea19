"""Written intermediate tables in the folder that driver and executors share.

They go when ``dropped`` is called, and else with the driver's Python.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset, in local runs, a folder is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths that are still there, with their file system and its name for them.
_there: dict[str, tuple] = {}


def _path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _there[path] = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table: lineage ends, and lost executors cost no recomputation."""
    path = _path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``written``, and how many rows that were: counted on their way."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def together(*jobs: Callable[[], T]) -> list[T]:
    """The results of functions that run Spark jobs which do not wait for each other: submitted at once, they share the cluster."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(SparkSession.active())(job)) for job in jobs]]


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def bucketed(df: DataFrame, name: str, *by: str, fold: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, int]:
    """``counted``, in as many buckets by some columns as shuffles have partitions: joins on these do not shuffle it again.

    ``fold`` is a grouping by these columns and others, done within the buckets, so it takes no shuffle of its own.  Spark knows buckets of catalogue tables alone, so the table has a name for as long as it is there.
    """
    spark = df.sparkSession
    path, n = _path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"tidemark_{path.rpartition('-')[2]}"
    seen = Observation()
    dealt = df.repartition(n, *by)
    (fold(dealt) if fold else dealt).observe(seen, F.count(F.lit(1)).alias("n")).write.bucketBy(n, *by).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._tidemark_path, out._tidemark_table = path, table
    return out, seen.get["n"]


def _delete(path: str) -> None:
    if found := _there.pop(path, None):
        with contextlib.suppress(Exception):  # the session may have ended
            found[0].delete(found[1], True)


def dropped(df: DataFrame) -> None:
    """Remove the table behind what ``written`` gave; nothing may read it from now on."""
    if table := getattr(df, "_tidemark_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    _delete(getattr(df, "_tidemark_path", ""))


atexit.register(lambda: [_delete(x) for x in list(_there)])
