"""As-of joins within a key, windows of process trees, and nearest marks on a graph of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import counted


def as_of(points: DataFrame, marks: DataFrame, value: str, width: float) -> DataFrame:
    """Points (key, at, ...) with ``value`` of the last mark (key, at, value) of their key at or before them; null where there is none.

    Keys are cut into cells of ``width``: windows run within a cell, and what stands before a cell is carried from one row a cell, so
    a key with most of the rows is dealt to many tasks.  Of marks at one place the greatest value counts.
    """
    one = marks.groupBy("key", "at").agg(F.max(value).alias(value))
    own = [c for c in points.columns if c not in ("key", "at")]
    rows = points.select("key", "at", F.struct(*own).alias("own"), F.lit(None).cast(one.schema[value].dataType).alias(value)).unionByName(one.withColumn("own", F.lit(None)), allowMissingColumns=True)
    rows = rows.withColumn("cell", F.floor(F.col("at") / width))
    inside = Window.partitionBy("key", "cell").orderBy("at", F.col("own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = rows.groupBy("key", "cell").agg(F.max_by(value, F.when(F.col("own").isNull(), F.col("at"))).alias("last"))
    carried = last.select("key", "cell", F.last("last", ignorenulls=True).over(Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    found = rows.withColumn("near", F.last(value, ignorenulls=True).over(inside)).where("own IS NOT NULL").join(carried, ["key", "cell"])
    return found.select("key", "at", "own.*", F.coalesce("near", "carried").alias(value))


def enclosing(points: DataFrame, windows: DataFrame, width: float = 3600.0) -> DataFrame:
    """Points (key, at, ...) with ``test_id`` of the window (key, test_id, start, stop) that holds them; a key's windows do not overlap."""
    marks = windows.select("key", F.col("start").alias("at"), F.struct("start", "stop", "test_id").alias("window"))
    got = as_of(points, marks, "window", width)
    return got.withColumn("test_id", F.when(F.col("at") <= F.col("window.stop"), F.col("window.test_id"))).drop("window")


def charged(processes: DataFrame, windows: DataFrame, width: float = 3600.0) -> DataFrame:
    """(pid, test_id): the test that each process (pid, parent, started) runs for.

    A child runs for the window of its parent that holds its start, however long it lives; where no window of the parent
    does, for whatever the parent itself runs for.  Pointers to parents are doubled: trees of depth n take log n rounds.
    ``windows`` are (pid, test_id, start, stop); a process without parent that counts runs for none.
    """
    named = windows.withColumnRenamed("pid", "key")
    born = processes.where("parent IS NOT NULL AND started IS NOT NULL").select(F.col("parent").alias("key"), F.col("started").alias("at"), "pid")
    hit = enclosing(born, named, width).select("pid", "test_id")
    state = processes.select("pid", "parent").join(hit, "pid", "left").select("pid", F.when(F.col("test_id").isNull() & (F.col("parent") != F.col("pid")), F.col("parent")).alias("to"), "test_id")
    now, n = counted(state, "processes")
    for _ in range(max(1, n.bit_length())):
        far = now.select(F.col("pid").alias("to"), F.col("to").alias("next"), F.col("test_id").alias("theirs"))
        there = now.where("to IS NOT NULL").join(far, "to", "left").select("pid", F.when(F.col("theirs").isNull(), F.col("next")).alias("to"), F.col("theirs").alias("test_id"))
        moved, k = counted(there, "processes")
        if not k:
            break
        now, _ = counted(now.where("to IS NULL").unionByName(moved), "processes")
    return now.select("pid", "test_id")


def window_items(items: DataFrame, processes: DataFrame, windows: DataFrame, width: float = 3600.0) -> DataFrame:
    """(test_id, item): what ran for each test: items (pid, at, item) by the window of their own process, else by what the process runs for."""
    own = enclosing(items.withColumnRenamed("pid", "key"), windows.withColumnRenamed("pid", "key"), width).withColumnRenamed("key", "pid")
    tests = charged(processes, windows, width).withColumnRenamed("test_id", "whole")
    return own.join(tests, "pid", "left").select(F.coalesce("test_id", "whole").alias("test_id"), "item").where("test_id IS NOT NULL").distinct()


def nearest_ancestor(parents: DataFrame, marks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(commit, store_id, distance): for each wanted commit the store of the nearest of its ancestors, itself included; of equally near ones
    the newest, then the greatest id.

    ``parents`` (commit, parent) may have merges; ``marks`` are (commit, store_id, created).  Paths are doubled: after k rounds a commit knows
    its best within 2^k steps and which ancestors are just 2^k steps off; one that has found a store goes no further.
    """
    steps = parents.select("commit", "parent").where("commit IS NOT NULL AND parent IS NOT NULL").distinct()
    here = marks.groupBy(F.col("commit")).agg(F.max(F.struct("created", "store_id")).alias("m")).select("commit", F.struct(F.lit(0).cast("long").alias("far"), (-F.col("m.created").cast("double")).alias("age"), F.col("m.store_id").alias("store_id")).alias("best"))
    best, _ = counted(here, "best")
    # Jumps start at commits without a store of their own.
    jumps, n = counted(steps.join(best, "commit", "left_anti"), "jumps")
    reach = 1
    rank = lambda b: F.struct(b["far"].alias("far"), b["age"].alias("age"))
    while n:
        met = jumps.join(best.select(F.col("commit").alias("parent"), "best"), "parent").select("commit", F.struct((F.col("best.far") + reach).alias("far"), F.col("best.age").alias("age"), F.col("best.store_id").alias("store_id")).alias("best"))
        least = met.groupBy("commit").agg(F.min(rank(F.col("best"))).alias("least"))
        found = met.join(least, "commit").where(rank(F.col("best")) == F.col("least")).groupBy("commit").agg(F.max("best.store_id").alias("s"), F.first("least").alias("l"))
        new = found.select("commit", F.struct("l.far", "l.age", F.col("s").alias("store_id")).alias("best"))
        best, _ = counted(best.unionByName(new), "best")
        open_ = jumps.join(best.select("commit"), "commit", "left_anti")
        onward = open_.select("commit", F.col("parent").alias("via")).join(jumps.select(F.col("commit").alias("via"), "parent"), "via").select("commit", "parent").distinct()
        jumps, n = counted(onward, "jumps")
        reach *= 2
    return wanted.select("commit").distinct().join(best, "commit", "left").select("commit", F.col("best.store_id").alias("store_id"), F.col("best.far").alias("distance"))
