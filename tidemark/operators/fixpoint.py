"""Closures and least fixpoints.  The only place where queries iterate.

Edges are written once, dealt into buckets by the node that a round meets them at, so no round shuffles them.  A round joins
its frontier with them and writes only what it improved; how much that is, the write itself counts.  The state is the union of a few
tables, which are merged at powers of two, so that a row is rewritten a logarithmic number of times.  Edges of a node that
has more than ``HUB`` of them are dealt by a salt, and a frontier row that meets such a node goes to each of its
salts: no task holds a hub's edges alone.  There is one path for inputs of every size.

The graph is cyclic, so termination comes from "no row improved", never from a depth.  ``limit`` raises, it does not
truncate.  An edge without one of its ends, and a seed without node, lead nowhere and are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.tables import bucketed, counted, distinct, dropped, written

#: Edges of a node beyond which they are salted.
HUB = 50_000
#: Rows of a frontier from which its nodes are first looked up among those that have edges: the last round, which finds nothing, is the dearest.
MANY = 1_000_000


class NotConverged(RuntimeError):
    """A loop ran more rounds than its limit."""


def _loop(first: DataFrame, edges: DataFrame, step: Callable[[_Along, DataFrame, DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], limit: int, name: str, fold: Callable[[DataFrame], DataFrame] | None = distinct) -> DataFrame:
    frontier, n = counted(first, name)
    if not n:
        return frontier
    along = _Along(edges, f"{name}-edges", fold)
    levels: list[tuple[int, DataFrame]] = [(1, frontier)]  # tables with how many rounds each holds, largest first
    whole = lambda: merge(_union([t for _, t in levels]))
    for _ in range(limit + 1):
        if not n or along.none or (n > MANY and along.ended(frontier)):
            along.done()
            return whole()
        frontier, n = counted(step(along, frontier, _union([t for _, t in levels])), name)
        if not n:
            dropped(frontier)
            continue
        levels.append((1, frontier))
        while len(levels) > 4 and levels[-2][0] <= levels[-1][0]:
            (k, a), (m, b) = levels.pop(), levels.pop()
            levels.append((k + m, written(merge(_union([a, b])), name)))
            for t in (a, b):
                if t is not frontier:
                    dropped(t)
    raise NotConverged(f"{name} did not converge in {limit} rounds")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


class _Along:
    """Edges in buckets by ``node``, with hubs salted."""

    def __init__(self, edges: DataFrame, name: str, fold: Callable[[DataFrame], DataFrame] | None = distinct):
        self.edges, n = bucketed(edges.withColumn("salt", F.lit(0)), name, "node", fold=fold)
        self.none, self.keys, self.hubs, self.heads = not n, ["node"], None, None
        if n <= HUB:  # then no node has more
            return
        self.heads = written(self.edges.groupBy("node").agg(F.count("*").alias("n")), "heads")
        self.hubs, k = counted(self.heads.where(F.col("n") > HUB).select("node", F.ceil(F.col("n") / HUB).cast("int").alias("salts")), "hubs")  # at most one row for each HUB edges
        if k:
            self.keys, plain = ["node", "salt"], self.edges
            dealt = plain.join(F.broadcast(self.hubs), "node", "left").withColumn("salt", F.coalesce(F.floor(F.rand(7) * F.col("salts")).cast("int"), F.lit(0)))
            self.edges, _ = bucketed(dealt.select(*plain.columns), name, *self.keys)
            dropped(plain)

    def met(self, frontier: DataFrame, once: bool = False) -> DataFrame:
        """The frontier's rows with the edges at their node.  If it has a node ``once`` at most, its part of a bucket is hashed, so edges are not sorted."""
        salted = len(self.keys) == 2
        if salted:
            frontier = frontier.join(F.broadcast(self.hubs), "node", "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)"))).drop("salts")
        if once:
            frontier = frontier.hint("shuffle_hash")
        return frontier.join(self.edges, self.keys).drop("salt") if salted else frontier.join(self.edges.drop("salt"), self.keys)

    def ended(self, frontier: DataFrame) -> bool:
        """Whether no node of the frontier has edges."""
        if self.heads is None:
            self.heads = written(self.edges.select("node").distinct(), "heads")
        return frontier.select("node").distinct().join(self.heads, "node", "left_semi").isEmpty()

    def done(self) -> None:
        dropped(self.edges)
        if self.heads is not None:
            dropped(self.heads)
        if self.hubs is not None:
            dropped(self.hubs)


def _pairs(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select(F.col("source").alias("node"), F.col("target").alias("next"), *more).where("node IS NOT NULL AND next IS NOT NULL")


def _unseen(new: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """The keys of ``new`` that are not in ``state``, each once: counted together, so nothing is sorted."""
    both = new.select(*key, F.lit(False).alias("had")).unionByName(state.select(*key, F.lit(True).alias("had")))
    return both.groupBy(*key).agg(F.bool_or("had").alias("had")).where("NOT had").select(*key)


def closure(edges: DataFrame, seeds: DataFrame, limit: int = 10_000) -> DataFrame:
    """Pairs (origin, node): all nodes that each seed reaches along (source, target), itself included.

    ``seeds`` has one column, node.
    """
    def step(along: _Along, frontier: DataFrame, state: DataFrame) -> DataFrame:
        return _unseen(along.met(frontier).select("origin", F.col("next").alias("node")), state, ["origin", "node"])

    first = seeds.select("node").where("node IS NOT NULL").distinct()
    return _loop(first.select(F.col("node").alias("origin"), "node"), _pairs(edges), step, lambda s: s, limit, "closure")


def reachable(edges: DataFrame, seeds: DataFrame, limit: int = 10_000) -> DataFrame:
    """(node, hops): the nodes reached from any seed along (source, target), with the fewest steps."""
    def step(along: _Along, frontier: DataFrame, state: DataFrame) -> DataFrame:
        sent = along.met(frontier).select(F.col("next").alias("node"), (F.col("hops") + 1).alias("hops"), F.lit(False).alias("had"))
        both = sent.unionByName(state.select("node", "hops", F.lit(True).alias("had")))
        return both.groupBy("node").agg(F.min("hops").alias("hops"), F.bool_or("had").alias("had")).where("NOT had").select("node", "hops")

    first = seeds.select("node").where("node IS NOT NULL").distinct()
    return _loop(first.select("node", F.lit(0).alias("hops")), _pairs(edges), step, lambda s: s, limit, "reachable")


def variants(edges: DataFrame, seeds: DataFrame, mask: int, key: tuple[str, ...] = ("node",), limit: int = 10_000) -> DataFrame:
    """(key, mask): nodes reached along (source, target) in several variants of a graph at once, one search for all.

    Bit i of an edge's ``mask`` says that variant i has the edge, bit i of a row's that variant i reaches it; ``mask`` is that of the
    seeds (node).  With ``key`` (origin, node) each seed is searched for by itself, as in ``closure``.  A row has at least one bit.
    """
    keys = list(key)
    to = [F.col("next").alias("node") if k == "node" else F.col(k) for k in keys]

    def step(along: _Along, frontier: DataFrame, state: DataFrame) -> DataFrame:
        sent = along.met(frontier).select(*to, F.col("mask").bitwiseAND(F.col("allowed")).alias("mask"), F.lit(0).alias("had")).where("mask <> 0")
        both = sent.unionByName(state.select(*keys, F.lit(0).alias("mask"), F.col("mask").alias("had")))
        got = both.groupBy(*keys).agg(F.bit_or("mask").alias("mask"), F.bit_or("had").alias("had"))
        return got.select(*keys, F.expr("mask & ~had").alias("mask")).where("mask <> 0")

    own = seeds.select("node").where("node IS NOT NULL").distinct().select(*(F.col("node").alias(k) for k in keys), F.lit(mask).alias("mask"))
    along_edges = _pairs(edges.withColumnRenamed("mask", "allowed"), "allowed").where("allowed <> 0")
    fold = lambda e: e.groupBy("node", "next", "salt").agg(F.bit_or("allowed").alias("allowed"))
    return _loop(own, along_edges, step, lambda s: s, limit, "variants", fold).groupBy(*keys).agg(F.bit_or("mask").alias("mask"))


def impact(edges: DataFrame, seeds: DataFrame, limit: int = 10_000, tie: bool = False) -> DataFrame:
    """(node, mode, hops, via): the greatest mode of each node, from targets back to sources.

    ``edges`` have source, target and xfer, the four modes that modes 1 to 4 of the target become at the
    source (0 stops); ``seeds`` have node and mode.  As every xfer is monotone the least fixpoint is unique.
    ``hops`` and ``via`` (the next node towards the change) are those of the round that first gave the mode.
    With ``tie``, edges have an int of that name, and rows the least of all edges to their ``via``.
    """
    also = ["tie"] if tie else []
    packed = sum((F.col("xfer")[i] * (1 << 3 * i) for i in range(1, 4)), F.col("xfer")[0])
    back = edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", F.col("target").alias("node"), packed.cast("int").alias("xfer"), *also)
    first = seeds.where("node IS NOT NULL").groupBy("node").agg(F.max("mode").cast("int").alias("mode"))

    def merge(state: DataFrame) -> DataFrame:
        best = F.max(F.struct(F.col("mode"), (-F.col("hops")).alias("near"), F.col("via"), *also))
        return state.groupBy("node").agg(best.alias("b")).select("node", F.col("b.mode").alias("mode"), (-F.col("b.near")).alias("hops"), F.col("b.via").alias("via"), *(f"b.{c}" for c in also))

    def step(along: _Along, frontier: DataFrame, state: DataFrame) -> DataFrame:
        got = F.expr("shiftright(xfer, 3 * (mode - 1)) & 7")
        sent = along.met(frontier.select("node", "mode", "hops"), once=True).select(F.col("source").alias("to"), got.alias("mode"), (F.col("hops") + 1).alias("hops"), F.col("node").alias("via"), *also)
        if tie:  # of all edges of the pair, also those that give a lesser mode
            sent = sent.groupBy("to", "via", "hops").agg(F.max("mode").alias("mode"), F.min("tie").alias("tie"))
        best = sent.where("mode > 0").groupBy(F.col("to").alias("node")).agg(F.min(F.struct((-F.col("mode")).alias("mode"), F.col("hops"), F.col("via"), *also)).alias("b"))
        new = best.select("node", (-F.col("b.mode")).alias("mode"), F.col("b.hops").alias("hops"), F.col("b.via").alias("via"), *(f"b.{c}" for c in also))
        old = state.groupBy("node").agg(F.max("mode").alias("had"))
        return new.join(old, "node", "left").where("had IS NULL OR mode > had").select("node", "mode", "hops", "via", *also)

    none = [F.lit(None).cast("int").alias(c) for c in also]
    return _loop(first.select("node", "mode", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via"), *none), back, step, merge, limit, "impact", None)


def isolated(members: DataFrame, references: DataFrame, outside: DataFrame, limit: int = 10_000) -> DataFrame:
    """The members (node) all of whose referrers are isolated members: the greatest such set.

    A member is open when some referrer is no member or is named in ``outside``; what an open member refers
    to is open too.  So the complement is a plain closure from the open ones.
    """
    own = members.select("node").distinct().withColumn("own", F.lit(True))
    named = outside.select("node").distinct().withColumn("named", F.lit(True))
    side = lambda name: own.join(named, "node", "full").select(F.col("node").alias(name), F.coalesce("own", F.lit(False)).alias(f"{name}_own"), F.coalesce("named", F.lit(False)).alias(f"{name}_named"))
    inner = references.select("source", "target").join(side("target").where("target_own").select("target"), "target", "left_semi").join(side("source"), "source", "left")
    inner = written(inner.select("source", "target", (F.coalesce("source_own", F.lit(False)) & ~F.coalesce("source_named", F.lit(False))).alias("closed"), F.coalesce("source_own", F.lit(False)).alias("along")), "inner")
    listed = outside.select(F.col("node").alias("target")).join(own.select(F.col("node").alias("target")), "target", "left_semi")
    first = inner.where("NOT closed").select("target").unionByName(listed)
    open_ = reachable(inner.where("along"), first.select(F.col("target").alias("node")), limit)
    dropped(inner)
    return members.join(open_.select("node"), "node", "left_anti")
