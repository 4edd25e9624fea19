"""Reachability along paths whose labels an automaton accepts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fixpoint import reachable

#: What follows what: (state, label) -> the states after it.
Moves = Mapping[tuple[str, str], tuple[str, ...]]


def along(edges: DataFrame, seeds: DataFrame, moves: Moves, limit: int = 10_000) -> DataFrame:
    """(node, state, hops): what the seeds (node, state) reach by edges (source, target, label) that the automaton allows, with the fewest steps.

    Plain reachability over the product of graph and automaton: each edge is written once for each move of its label, which
    are a constant number.
    """
    table = edges.sparkSession.createDataFrame([(s, label, t) for (s, label), after in moves.items() for t in after], "state string, label string, after string")
    at = lambda state, node: F.concat(state, F.lit("|"), node)
    product = edges.join(F.broadcast(table), "label").select(at(F.col("state"), F.col("source")).alias("source"), at(F.col("after"), F.col("target")).alias("target"))  # one row a move
    got = reachable(product, seeds.select(at(F.col("state"), F.col("node")).alias("node")), limit)
    return got.select(F.expr("substring(node, instr(node, '|') + 1)").alias("node"), F.substring_index("node", "|", 1).alias("state"), "hops")


#: A changed symbol changes what its callers give back and what it or they store; a variable that holds it changes who reads it.
STORED: Moves = {("changed", "called_by"): ("changed",), ("changed", "writes"): ("held",), ("held", "read_by"): ("changed",)}


def stored_results(first: DataFrame, calls: DataFrame, writes: DataFrame, reads: DataFrame, limit: int = 10_000) -> DataFrame:
    """(node, state) of what notices a change of ``first`` (symbol) through calls and stored values, in turn: symbols that are ``changed``
    and variables that have ``held``.

    ``calls``, ``writes`` and ``reads`` are (source, target).  A reader of a function, or a caller of a variable, notices nothing by that.
    """
    back = lambda df, label: df.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(label).alias("label"))
    edges = back(calls, "called_by").unionByName(back(reads, "read_by")).unionByName(writes.select("source", "target", F.lit("writes").alias("label")))
    return along(edges, first.select(F.col("symbol").alias("node"), F.lit("changed").alias("state")), STORED, limit).select("node", "state")


def written_state(first: DataFrame, calls: DataFrame, writes: DataFrame, reads: DataFrame, limit: int = 10_000) -> DataFrame:
    """(writer, variable, reader): state written by what notices a change of ``first``, with who reads it: one row a reader."""
    noticed = stored_results(first, calls, writes, reads, limit)
    writers = writes.join(noticed.where("state = 'changed'").select(F.col("node").alias("source")), "source", "left_semi").select(F.col("source").alias("writer"), F.col("target").alias("variable"))
    return writers.join(reads.select(F.col("target").alias("variable"), F.col("source").alias("reader")), "variable").select("writer", "variable", "reader").distinct()
