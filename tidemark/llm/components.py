"""Connected components of an edge table, by labels that only ever shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node of an edge.

    Alternates large and small stars: each node's larger neighbours, then its smaller ones, are tied to the
    least node of its neighbourhood.  Edges never grow in number, chains shorten geometrically, and
    every round ends in a written table; it stops when the edges stay as they are.

    The minima are joined by ``again``, which the planner does not take for the column that they were grouped by: so both
    sides of the join are shuffled for it alone, and a node with many edges is dealt to several tasks.
    """
    again = lambda c: F.col(c).bitwiseXOR(F.lit(0).cast("long")).alias("again")
    spark = edges.sparkSession
    now, path = staged(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "edges")
    before = None
    while True:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(again("u"), "m")
        large = both.where("v > u").join(least, F.col("u") == F.col("again")).select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).select(again("hi"), "m")
        tied = large.join(least, F.col("hi") == F.col("again"))
        small = tied.select(F.col("m").alias("lo"), F.col("hi")).unionByName(tied.where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).distinct()
        new, new_path = staged(small, "edges")
        remove(spark, path)
        now, path = new, new_path
        state = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before:
            return now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        before = state
