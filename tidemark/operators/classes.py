"""The order in which a class looks names up, and what it finds first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.tables import counted, written


def merged(orders: list[list[str]], bases: list[str]) -> list[str]:
    """The C3 merge of the bases' own orders and the list of bases.

    Where no order suits them all, the first class that is left goes first: code with such bases does not run, but is read.
    """
    left, out = [list(x) for x in (*orders, bases) if x], []
    while left:
        behind = {c for x in left for c in x[1:]}
        head = next((x[0] for x in left if x[0] not in behind), left[0][0])
        out.append(head)
        left = [y for x in left if (y := [c for c in x if c != head])]
    return out


def _linearised(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in groups:
        rows = [(c, [c, *merged([list(m) for m in ms], list(bs))]) for c, bs, ms in zip(g["cls"], g["bases"], g["orders"], strict=True)]
        yield pd.DataFrame(rows, columns=["cls", "mro"])


def linearised(bases: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, mro): the method resolution order of every class (cls), itself first; ``bases`` has cls, base and place.

    Level by level: a class follows once all its bases have their order, so there are as many rounds as the longest line of
    descent.  Classes on a circle, and those that stem from them, never do: their order is themselves and their bases.
    """
    known = classes.select("cls").distinct()
    direct = bases.select("cls", "base", "place").join(known, "cls", "left_semi").join(known.select(F.col("cls").alias("base")), "base", "left_semi")
    direct = written(direct.groupBy("cls", "base").agg(F.min("place").alias("place")), "bases")
    level, n = counted(known.join(direct.select("cls").distinct(), "cls", "left_anti").select("cls", F.array("cls").alias("mro")), "level")
    done = [level]
    while n:
        every = done[0]
        for x in done[1:]:
            every = every.unionByName(x)
        open_ = direct.join(every.select("cls"), "cls", "left_anti").join(every.select(F.col("cls").alias("base"), "mro"), "base", "left")
        ready = open_.groupBy("cls").agg(F.count_if(F.col("mro").isNull()).alias("waits"), F.array_sort(F.collect_list(F.struct("place", "base", "mro"))).alias("own")).where("waits = 0")
        level, n = counted(ready.select("cls", F.col("own.base").alias("bases"), F.col("own.mro").alias("orders")).mapInPandas(_linearised, "cls string, mro array<string>"), "level")
        if n:
            done.append(level)
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    circle = direct.join(every.select("cls"), "cls", "left_anti").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("place", "base"))).alias("own"))
    return every.unionByName(circle.select("cls", F.array_distinct(F.concat(F.array("cls"), F.col("own.base"))).alias("mro")))


def found_first(mro: DataFrame, members: DataFrame) -> DataFrame:
    """(cls, name, id, depth): the first definition of each name that a class has or inherits; ``members`` has container, name, id."""
    line = mro.select("cls", F.posexplode("mro").alias("depth", "container"))
    return line.join(members.select("container", "name", "id"), "container").groupBy("cls", "name").agg(F.min(F.struct("depth", "id")).alias("first")).select("cls", "name", F.col("first.id").alias("id"), F.col("first.depth").alias("depth"))


def overridden(mro: DataFrame, members: DataFrame) -> DataFrame:
    """(lower, upper): each member with the next definition of its name behind it, in its own class's order: one row a member."""
    line = mro.select("cls", F.posexplode("mro").alias("depth", "container")).where("depth > 0")
    behind = line.join(members.select("container", "name", F.col("id").alias("upper")), "container")
    own = members.select(F.col("container").alias("cls"), "name", F.col("id").alias("lower"))
    return own.join(behind, ["cls", "name"]).groupBy("lower").agg(F.min_by("upper", "depth").alias("upper"))
