"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _downward(pairs: DataFrame) -> DataFrame:
    """Distinct (u, v) with u > v, without loops."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _parents(edges: DataFrame) -> DataFrame:
    """The least smaller neighbour of every node that has one."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _both(pairs: DataFrame, *sides: tuple[str, str]) -> DataFrame:
    """(u, v) rows of several pairs of columns; one pass, where a union would read its input twice."""
    return pairs.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in sides])).alias("x")).select("x.u", "x.v")


def _is_done(edges: DataFrame) -> bool:
    """True if every node has one parent and no parent has another."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("child")), F.struct(F.col("v").alias("x"), F.lit(0).alias("child")))).alias("e")).select("e.*")
    roles = ends.groupBy("x").agg(F.sum("child").alias("parents"), F.min("child").alias("least"))
    return roles.where("parents > 1 or (parents > 0 and least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) that has another: the smallest node it reaches.

    Edges point from the larger to the smaller end. A round moves every edge
    from its end to that node's parent (large star), then all smaller
    neighbours of a node to the least of them (small star). Rows of a node that
    has many are aggregated before they are shuffled, or joined with one row,
    so that adaptive execution can split them. Each round is written to the
    checkpoint folder, so a lost executor costs one round at most; the number
    of rounds grows with the logarithm of the longest path.
    """
    edges = checkpoint(_downward(links))
    while not _is_done(edges):
        up = _parents(edges).select(F.col("u").alias("at"), "m")
        large = edges.join(up, edges["v"] == up["at"], "left").select("u", F.least("v", "m").alias("v"))
        small = large.join(_parents(large), "u").select("u", "v", "m")
        edges = checkpoint(_downward(_both(small, ("u", "m"), ("v", "m"))))
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
