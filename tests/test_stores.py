"""Stores: whole or not at all, equal sets once, readers beside writers."""

import glob

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.sources.stores import list_stores, read_store, vacuum, write_store


def relations(spark, flag, executed):
    return {
        "records": spark.createDataFrame([("t", flag), ("u", flag)], "test_id string, flags int"),
        "exec": spark.createDataFrame(executed, "test_id string, symbol string"),
    }


def held(store):
    return {r.flags for r in store["records"].collect()}, sorted((r.test_id, r.symbol) for r in store["exec"].collect())


OLD = [("t", "a"), ("t", "b"), ("u", "b"), ("u", "a"), ("u", "a"), ("v", "a"), (None, "a"), ("v", None)]
KEPT = [("t", "a"), ("t", "b"), ("u", "a"), ("u", "b"), ("v", "a")]


def test_a_failing_writer_leaves_the_old_store_whole(spark, tmp_path):
    folder = str(tmp_path / "stores of runs")
    write_store(relations(spark, 1, OLD), folder, "main/1")
    write_store(relations(spark, 7, [("x", "y")]), folder, "other")
    before = read_store(spark, folder, "main/1")
    broken = relations(spark, 2, [("t", "new")]) | {"phases": spark.range(1).select(F.raise_error(F.lit("stopped")).cast("string").alias("phase"), F.lit("i").alias("item"), F.lit("m").alias("module"))}
    with pytest.raises(PySparkException):
        write_store(broken, folder, "main/1")
    assert held(before) == held(read_store(spark, folder, "main/1")) == ({1}, KEPT)
    write_store(relations(spark, 3, [("t", "new")]), folder, "main/1")
    assert held(read_store(spark, folder, "main/1")) == ({3}, [("t", "new")])
    assert held(before) == ({1}, KEPT)  # who began before reads on
    assert held(read_store(spark, folder)) == ({3, 7}, [("t", "new"), ("x", "y")])
    assert sorted((r.store_id, r["count"]) for r in list_stores(spark, folder).collect()) == [("main/1", 2), ("other", 2)]
    assert vacuum(spark, folder) == [] and len(vacuum(spark, folder, 0)) > 3
    assert held(read_store(spark, folder)) == ({3, 7}, [("t", "new"), ("x", "y")])


def test_equal_sets_are_kept_once(spark, tmp_path):
    folder = str(tmp_path / "store")
    write_store({"exec": relations(spark, 1, OLD)["exec"]}, folder, "s")
    assert spark.read.parquet(*glob.glob(f"{folder}/exec_sets/*/*")).count() == 3  # {a, b} and {a}
    assert read_store(spark, folder, "s")["records"].count() == 0
    assert read_store(spark, folder, "none")["exec"].count() == 0
    with pytest.raises(ValueError, match="at least one"):
        write_store({}, folder, "s")
