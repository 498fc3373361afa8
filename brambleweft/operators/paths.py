"""Paths with their edges, and reachability in graphs made of chains.

``trails`` enumerates paths that use no edge twice. It walks from the sources
and from the targets at once and joins the halves in the middle, so a path of k
edges costs walks of k / 2.

``reach_chains`` is for histories: nodes lie on chains (an author's commits, a
branch) in order, and further edges lead from chain to chain. What is reachable
on a chain is all from its first reachable place on, so a search holds one
place per chain, and each further edge is followed once, when its start is
first covered. Rows of all rounds together are at most the further edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def _walks(ends: DataFrame, edges: DataFrame, steps: int) -> list[DataFrame]:
    """(nodes, used, at) after 0 to ``steps`` edges from ``ends`` (node_id); edges are (from, to, edge)."""
    out = [ends.select(F.array("node_id").alias("nodes"), F.array().cast("array<string>").alias("used"), F.col("node_id").alias("at"))]
    for _ in range(steps):
        met = out[-1].join(edges, F.col("at") == F.col("from")).where(~F.array_contains("used", F.col("edge")))
        walked = met.select(F.array_append("nodes", F.col("to")).alias("nodes"), F.array_append("used", F.col("edge")).alias("used"), F.col("to").alias("at"))
        out.append(checkpoint(walked))
    return out


def trails(sources: DataFrame, edges: DataFrame, targets: DataFrame, least: int, most: int) -> DataFrame:
    """(length, nodes, edges) of every path of ``least`` to ``most`` edges that uses none twice.

    Sources and targets are (node_id), edges (src, dst, type, nth), which may be
    parallel. A node may come again, an edge may not; a path of no edges is a
    source that is a target.
    """
    if not 0 <= least <= most:
        raise ValueError("0 <= least <= most")
    named = checkpoint(edges.select("src", "dst", F.concat_ws("|", "src", "dst", "type", F.col("nth").cast("string")).alias("edge")))
    ahead = _walks(sources.select("node_id").distinct(), named.select(F.col("src").alias("from"), F.col("dst").alias("to"), "edge"), (most + 1) // 2)
    back = _walks(targets.select("node_id").distinct(), named.select(F.col("dst").alias("from"), F.col("src").alias("to"), "edge"), most // 2)
    parts = []
    for n in range(least, most + 1):
        a, b = ahead[(n + 1) // 2], back[n // 2].select(F.reverse("nodes").alias("rest"), F.reverse("used").alias("more"), F.col("at").alias("met"))
        joined = a.join(b, (F.col("at") == F.col("met")) & ~F.arrays_overlap("used", "more"))
        nodes = F.concat("nodes", F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0))))
        parts.append(joined.select(F.lit(n).alias("length"), nodes.alias("nodes"), F.concat("used", "more").alias("edges")))
    return reduce(DataFrame.unionByName, parts)


def reach_chains(nodes: DataFrame, merges: DataFrame, seeds: DataFrame, forward: bool = True) -> DataFrame:
    """(node_id) of the nodes that seeds (node_id) reach, or that reach them; the seeds are among them.

    Nodes are (node_id, chain, place): a place is any value that orders the
    chain, and each node leads to the next of its chain. ``merges`` (src, dst)
    are the edges beside that. Nodes without a chain lie on none and are reached
    by merges only.
    """
    best = F.min if forward else F.max
    before = (lambda a, b: a < b) if forward else (lambda a, b: a > b)
    chain = F.when(F.col("chain").isNull(), F.concat(F.lit("node:"), F.col("node_id"))).otherwise(F.concat(F.lit("chain:"), F.col("chain").cast("string")))
    placed = nodes.select("node_id", chain.alias("chain"), "place")
    a, b = ("src", "dst") if forward else ("dst", "src")
    end = lambda c, k: placed.select(F.col("node_id").alias(c), F.col("chain").alias(f"chain{k}"), F.col("place").alias(f"place{k}"))
    jumps = checkpoint(merges.select("src", "dst").join(end(a, 1), a).join(end(b, 2), b).select("chain1", "place1", "chain2", "place2"))
    found = checkpoint(placed.join(seeds.select("node_id").distinct(), "node_id", "left_semi").groupBy("chain").agg(best("place").alias("place")))
    new = found.withColumn("upto", F.lit(None).cast(found.schema["place"].dataType))
    while not new.isEmpty():
        # Only edges that the last round has newly covered: from the new place up to the old one.
        started = _newly(new, jumps, before)
        offered = started.groupBy(F.col("chain2").alias("chain")).agg(best("place2").alias("offer"))
        met = offered.join(found, "chain", "left").where(F.col("place").isNull() | before(F.col("offer"), F.col("place")))
        new = checkpoint(met.select("chain", F.col("offer").alias("place"), F.col("place").alias("upto")))
        found = checkpoint(found.unionByName(new.select("chain", "place")).groupBy("chain").agg(best("place").alias("place")))
    limits = found.withColumnRenamed("place", "limit")
    return placed.join(limits, "chain").where(~before(F.col("place"), F.col("limit"))).select("node_id")


def _newly(new: DataFrame, jumps: DataFrame, before) -> DataFrame:
    """Edges that start on a newly covered stretch (chain, place, upto)."""
    at: Column = F.col("place1")
    met = jumps.join(new.select(F.col("chain").alias("chain1"), "place", "upto"), "chain1")
    return met.where(~before(at, F.col("place")) & (F.col("upto").isNull() | before(at, F.col("upto"))))
