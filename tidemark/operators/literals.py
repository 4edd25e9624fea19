"""Sets of text literals that may come to a place: a least fixpoint over sets, widened to "any" where they grow too large.

An edge hands the texts of its source to its target, with ``before`` and ``after`` put around each, so a circle may make ever longer
texts: a place of more than ``most`` texts holds any, and so does what it hands on to.  As edges are one to one, a place whose
source has too many texts has too many as well, so the result does not depend on the order of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.fixpoint import _Along, _loop

#: Texts of a place beyond which it holds any.
MOST = 32
_ROW = ["node", "value", "any"]


def _widened(rows: DataFrame, most: int) -> DataFrame:
    """Of rows with ``had`` (known before), the new ones, with one row of ``any`` for places that now hold it or more than ``most`` texts.

    Known and new rows are counted together, so both are shuffled and sorted once.
    """
    place = Window.partitionBy("node")
    each = rows.groupBy(*_ROW).agg(F.bool_or("had").alias("had"))
    seen = each.select("*", F.count("*").over(place).alias("n"), F.bool_or("any").over(place).alias("open"), F.bool_or(F.col("any") & F.col("had")).over(place).alias("was"))
    full = (F.col("n") > most) | F.col("open")
    return seen.where("NOT had AND NOT was").select("node", F.when(full, "").otherwise(F.col("value")).alias("value"), full.alias("any")).distinct()


def literal_sets(edges: DataFrame, first: DataFrame, most: int = MOST, limit: int = 10_000) -> DataFrame:
    """(node, value, any): the texts of each place, or one row with ``any`` and an empty value.

    ``edges`` have source, target, before, after (null: nothing), ``first`` node, value, any.  Rows without a node, and texts that are null, are left out.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    along_edges = edges.where("source IS NOT NULL AND target IS NOT NULL").select(F.col("source").alias("node"), F.col("target").alias("next"), none("before").alias("before"), none("after").alias("after"))
    start = first.where("node IS NOT NULL AND (any OR value IS NOT NULL)").select("node", F.when(F.col("any"), "").otherwise(F.col("value")).alias("value"), F.coalesce("any", F.lit(False)).alias("any")).distinct()

    def step(along: _Along, frontier: DataFrame, state: DataFrame) -> DataFrame:
        text = F.when(F.col("any"), "").otherwise(F.concat("before", "value", "after"))
        sent = along.met(frontier).select(F.col("next").alias("node"), text.alias("value"), "any", F.lit(False).alias("had"))
        return _widened(sent.unionByName(state.select(*_ROW, F.lit(True).alias("had"))), most)

    whole = _loop(_widened(start.withColumn("had", F.lit(False)), most), along_edges, step, lambda s: s.select(*_ROW), limit, "literals")
    return whole.where("any").unionByName(whole.where("NOT any").join(whole.where("any").select("node"), "node", "left_anti").select(*_ROW))
