"""Features, scenarios and steps as a graph, and which steps nothing implements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import pattern as P

#: From the outermost to the innermost kind of node.
CHAIN = ("package", "feature", "scenario", "step", "function")


def package_of(package: Column, path: Column) -> Column:
    """The package, else the folder after ``crates/`` in the path, else null."""
    return F.coalesce(package, F.nullif(F.regexp_extract(path, "(?:^|/)crates/([^/]+)", 1), F.lit("")))


def bdd_graph(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: kind, node_id; edges: src, dst, type) of rows with the columns of CHAIN.

    Each row names what a step lies in and what implements it; a null leaves its
    node and edges out. One pass over the rows per result.
    """
    node = [F.struct(F.lit(c.title()).alias("kind"), F.col(c).alias("node_id")) for c in CHAIN]
    edge = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(f"{a}_{b}".upper()).alias("type")) for a, b in zip(CHAIN, CHAIN[1:], strict=False)]
    spread = lambda parts: steps.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    return spread(node).where("node_id is not null").distinct(), spread(edge).where("src is not null and dst is not null").distinct()


def unimplemented_steps(steps: DataFrame, implemented: DataFrame) -> DataFrame:
    """(scenario, missing): steps (step_id, scenario) without an implementation, most first."""
    bare = P.where_missing(steps, "step_id", implemented, "step_id")
    return bare.groupBy("scenario").agg(F.count(F.lit(1)).alias("missing")).orderBy(F.desc("missing"), "scenario")
