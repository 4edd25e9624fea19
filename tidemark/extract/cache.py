"""Facts kept by content: a file that was read once, in any version, is not parsed again."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.extract.pyfacts import FACTS, facts

FORMAT = 2


def _key() -> F.Column:
    """Path, module and content decide a file's facts, with the interpreter whose grammar reads it."""
    return F.sha2(F.concat_ws("\0", F.lit(f"{FORMAT}.{sys.version_info[0]}.{sys.version_info[1]}"), "path", "module", F.sha2("content", 256)), 256)


def cached_facts(files: DataFrame, folder: str) -> DataFrame:
    """``facts(files)``, reading kept files from ``folder`` and adding the others to it."""
    spark = files.sparkSession
    keyed = files.where("module IS NOT NULL AND content IS NOT NULL").withColumn("key", _key())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.schema(f"{FACTS}, key string").parquet(folder) if there else spark.createDataFrame([], f"{FACTS}, key string")
    wanted = keyed.select("key", F.col("snapshot").alias("now"), "path", "module")
    missing = keyed.join(known.select("key").distinct(), "key", "left_anti").dropDuplicates(["key"])
    fresh = facts(missing.drop("key")).join(missing.select("key", "path", "module"), ["path", "module"])
    fresh.select(*known.columns).write.mode("append").parquet(folder)
    kept = spark.read.schema(f"{FACTS}, key string").parquet(folder)
    return kept.drop("snapshot", "path", "module").join(wanted, "key").withColumnRenamed("now", "snapshot").select(*(c.split()[0] for c in FACTS.split(", ")))


def prune(files: DataFrame, folder: str, into: str) -> None:
    """Write a cache that holds only the facts of these files."""
    keys = files.where("module IS NOT NULL AND content IS NOT NULL").select(_key().alias("key")).distinct()
    files.sparkSession.read.schema(f"{FACTS}, key string").parquet(folder).join(keys, "key", "left_semi").write.mode("overwrite").parquet(into)
