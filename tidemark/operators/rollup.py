"""Roll-ups over the artifacts of many runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Events whose recordings are trusted.
TRUSTED = ("push", "schedule", "workflow_dispatch")


def trusted(artifacts: DataFrame) -> DataFrame:
    """Recordings from trusted events only; other artifacts all."""
    return artifacts.where((F.col("action") != "record") | F.col("event").isin(*TRUSTED))


def sound(artifacts: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Artifacts with all required fields, and the malformed ones: each counts whole or not at all."""
    fine = F.lit(True)
    for c in required:
        fine &= F.col(c).isNotNull()
    return artifacts.where(fine), artifacts.where(~fine)


def cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each cell and its selected share (always-run tests left out), median and greatest.

    Rows: action, selected, total, always_run, misses, incomplete.
    """
    part = F.try_divide((F.col("selected") - F.col("always_run")).cast("double"), (F.col("total") - F.col("always_run")).cast("double"))
    run = F.col("action") == "run"
    return rows.withColumn("share", F.when(run, part)).groupBy(*by).agg(
        F.count_if(run).alias("runs"), F.count_if(F.col("action") == "record").alias("records"), F.count_if(run & F.col("incomplete")).alias("incomplete"),
        F.coalesce(F.sum("misses"), F.lit(0)).alias("misses"), F.round(F.median("share"), 6).alias("median_share"), F.round(F.max("share"), 6).alias("max_share"),
    )


def histogram(rows: DataFrame, by: list[str], note: str) -> DataFrame:
    return rows.groupBy(*by, note).agg(F.count("*").alias("n"))


def histogram_map(rows: DataFrame, by: list[str], note: str) -> DataFrame:
    """Per cell a map from note to count; notes are a fixed small vocabulary."""
    return histogram(rows, by, note).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(note, "n")))).alias("notes"))


def confirmed(misses: DataFrame, rerun: DataFrame) -> DataFrame:
    """Misses that stand: those of no test, and those that miss in the rerun too.

    ``misses``: run, target, kind; ``rerun``: run, target.
    """
    tests = misses.where("kind = 'test'").join(rerun, ["run", "target"], "left_semi")
    return misses.where("kind <> 'test'").unionByName(tests)


def window(artifacts: DataFrame) -> DataFrame:
    return artifacts.agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.countDistinct("run").alias("runs"))


def verdict(cell_rows: DataFrame, confirmed_misses: DataFrame) -> DataFrame:
    """One row; the counted misses are one row too, whatever the input."""
    n = confirmed_misses.agg(F.count("*").alias("confirmed"))
    return cell_rows.agg(F.sum("runs").alias("runs"), F.sum("records").alias("records")).join(F.broadcast(n)).withColumn("ok", F.col("confirmed") == 0)
