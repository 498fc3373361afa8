"""Pattern algebra: what a graph query language compiles to.

Directed and undirected expansion, optional and existential patterns are equi
joins, left joins, left semi and left anti joins; a bounded variable-length
path is a breadth-first search whose frontier stays a DataFrame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def turned(edges: DataFrame) -> DataFrame:
    """The same edges from the other end."""
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from both ends; a loop once."""
    return edges.unionByName(turned(edges.where("src <> dst")))


def expand(rows: DataFrame, on: str, edges: DataFrame, to: str, direction: str = "out", optional: bool = False) -> DataFrame:
    """Bind ``to`` to the neighbours of the nodes bound to ``on``."""
    pairs = {"out": edges, "in": turned(edges), "any": both_ways(edges)}[direction]
    keep = [c for c in pairs.columns if c not in ("src", "dst")]
    return rows.join(pairs.select(F.col("src").alias(on), F.col("dst").alias(to), *keep), on, "left" if optional else "inner")


def attach(rows: DataFrame, on: str, nodes: DataFrame, *properties: str, prefix: str = "", how: str = "inner") -> DataFrame:
    """Add properties of the nodes bound to ``on``."""
    return rows.join(nodes.select(F.col("node_id").alias(on), *[F.col(p).alias(f"{prefix}{p}") for p in properties]), on, how)


def where_exists(rows: DataFrame, on: str, found: DataFrame, key: str) -> DataFrame:
    return rows.join(found.select(F.col(key).alias(on)), on, "left_semi")


def where_missing(rows: DataFrame, on: str, found: DataFrame, key: str) -> DataFrame:
    return rows.join(found.select(F.col(key).alias(on)), on, "left_anti")


def counted(rows: DataFrame, on: str, found: DataFrame, key: str, name: str) -> DataFrame:
    """Add the number of ``found`` rows per node; 0 where there are none."""
    n = found.groupBy(F.col(key).alias(on)).agg(F.count(F.lit(1)).alias(name))
    return rows.join(n, on, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def reach(seeds: DataFrame, edges: DataFrame, depth: int, direction: str = "out", keep: DataFrame | None = None) -> DataFrame:
    """(node_id, depth) of the nodes found from ``seeds`` (node_id) within ``depth`` hops.

    The depth is that of the first discovery; cycles are cut and the seeds are
    not reported. ``keep`` (node_id) restricts which nodes may be found.
    """
    return reach_ways(seeds, edges, depth, (direction,), keep).select("node_id", "depth")


#: Nodes that are named in a filter; more of them are joined.
FEW = 1000


def few_ids(nodes: DataFrame) -> list | None:
    """The ids of ``nodes`` (node_id) if there are FEW at most."""
    ids = [r["node_id"] for r in nodes.select("node_id").distinct().limit(FEW + 1).collect()]
    return ids if len(ids) <= FEW else None


def at_nodes(edges: DataFrame, end: str, nodes: DataFrame) -> DataFrame:
    """Edges whose ``end`` is one of ``nodes`` (node_id).

    The ids of few nodes become a filter that reaches what the edges are made from.
    """
    ids = few_ids(nodes)
    return where_exists(edges, end, nodes, "node_id") if ids is None else edges.where(F.col(end).isin(ids))


def reach_ways(seeds: DataFrame, edges: DataFrame, depth: int, directions: tuple[str, ...], keep: DataFrame | None = None) -> DataFrame:
    """(direction, node_id, depth): ``reach`` in several directions, all in one search.

    While a frontier is small its ids are a filter on the edges, which reaches
    their tables. Once it is not, the distinct steps are written to the shared
    folder, as all later hops read them. Each hop's frontier is written too, so
    that the plan does not grow.
    """
    ends = {"out": [("src", "dst")], "in": [("dst", "src")], "any": [("src", "dst"), ("dst", "src")]}
    ways = [(d, a, b) for d in directions for a, b in ends[d]]
    kept = lambda rows: rows if keep is None else where_exists(rows, "node_id", keep, "node_id")
    steps = None
    found = seeds.select("node_id").distinct().select(F.explode(F.array(*map(F.lit, directions))).alias("direction"), "node_id", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        frontier = found.where(F.col("depth") == d - 1)
        ids = {k: few_ids(frontier.where(F.col("direction") == k)) for k in directions} if steps is None else {}
        if steps is None and all(x is not None for x in ids.values()):
            parts = [edges.where(F.col(a).isin(ids[k])).select(F.lit(k).alias("direction"), F.col(b).alias("node_id")) for k, a, b in ways]
            met = reduce(DataFrame.unionByName, parts)
        else:
            if steps is None:
                step = lambda k, a, b: F.struct(F.lit(k).alias("direction"), F.col(a).alias("at"), F.col(b).alias("node_id"))
                steps = checkpoint(kept(edges.select(F.explode(F.array(*[step(*w) for w in ways])).alias("x")).select("x.*").distinct()))
            met = frontier.select("direction", F.col("node_id").alias("at")).join(steps, ["direction", "at"]).select("direction", "node_id")
        new = kept(met.distinct()).join(found, ["direction", "node_id"], "left_anti")
        new = checkpoint(new.withColumn("depth", F.lit(d)))
        if d < depth and new.isEmpty():
            break
        found = found.unionByName(new)
    return found.where("depth > 0")


def reach_all(seeds: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """(node_id) of all nodes found from ``seeds`` (node_id), however many hops away; the seeds are not reported.

    Jumps double: after round k, ``found`` has all within 2**k - 1 hops and
    ``jumps`` the pairs 2**k hops apart, so a chain of n nodes takes about
    log2(n) rounds. It ends when a round finds nothing new. ``jumps`` has at
    most one row per node where each node has one successor, as in a chain;
    elsewhere one per pair that is that far apart. Both are written each round.
    """
    jumps = checkpoint({"out": edges, "in": turned(edges), "any": both_ways(edges)}[direction].select("src", "dst").distinct())
    first = found = checkpoint(seeds.select("node_id").distinct())
    while True:
        new = found.join(jumps, found["node_id"] == jumps["src"]).select(F.col("dst").alias("node_id")).distinct().join(found, "node_id", "left_anti")
        new = checkpoint(new)
        if new.isEmpty():
            return found.join(first, "node_id", "left_anti")
        found = checkpoint(found.unionByName(new))
        onward = jumps.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
        jumps = checkpoint(jumps.join(onward, "dst").select("src", F.col("end").alias("dst")).distinct())


def ordered(*columns: str | Column) -> list[Column]:
    """Ascending order keys with nulls last; a leading ``-`` means descending, nulls first."""
    out = []
    for c in columns:
        if isinstance(c, str):
            c = F.col(c[1:]).desc_nulls_first() if c.startswith("-") else F.col(c).asc_nulls_last()
        out.append(c)
    return out
