"""Versions of nodes: runs of equal content over ordered commits, and what differs between two of them.

What is seen of a node at commits is first brought to one row per node and
commit. A version begins where the content is not that of the row before, and
ends where the next one begins; a null content means that the node is gone, so
its version ends and none begins. Rows before and after are found in blocks of
commits, so a node that every commit touches is not one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .scans import BLOCK


def _before(rows: DataFrame, value: Column, sign: int = 1) -> DataFrame:
    """Add ``before``: the value of the node's row before (after, with sign -1), null for its first. Rows have the block of their commit."""
    turn = lambda c: F.col(c).asc() if sign > 0 else F.col(c).desc()
    cut = rows.withColumn("_v", F.struct(value.alias("x")))
    last = cut.groupBy("node_id", "block").agg(F.max_by("_v", sign * F.col("commit")).alias("_last"))
    earlier = Window.partitionBy("node_id").orderBy(turn("block")).rowsBetween(Window.unboundedPreceding, -1)
    entry = last.select("node_id", "block", F.last("_last", ignorenulls=True).over(earlier).alias("_entry"))
    inside = Window.partitionBy("node_id", "block").orderBy(turn("commit"))
    return cut.join(entry, ["node_id", "block"]).select(*rows.columns, F.coalesce(F.lag("_v").over(inside), "_entry").alias("before"))


def ranges(seen: DataFrame) -> DataFrame:
    """(node_id, content, first, until) from (node_id, commit, content, turn): valid from ``first`` on, before ``until`` or still.

    Commits are whole numbers in order; of several rows of a node at one commit
    the last by ``turn`` counts. All rows are dealt once, by node and block of
    commits, to tasks of bounded size; only summaries of blocks move again.
    """
    dealt = spread(seen.withColumn("block", F.floor(F.col("commit") / BLOCK)), seen.count(), "node_id", "block")
    each = dealt.groupBy("node_id", "block", "commit").agg(F.max_by(F.struct("content"), "turn").alias("x")).select("node_id", "block", "commit", "x.content")
    starts = _before(each, F.col("content")).where(~F.col("content").eqNullSafe(F.col("before.x"))).drop("before")
    ended = _before(starts, F.col("commit"), -1)
    return ended.where("content is not null").select("node_id", "content", F.col("commit").alias("first"), F.col("before.x").alias("until"))


def diff(found: DataFrame, base: int, head: int) -> DataFrame:
    """(node_id, change, before, after) of the nodes that differ between two commits: added, edited or removed."""
    valid = lambda c: (F.col("first") <= c) & (F.col("until").isNull() | (F.col("until") > c))
    at = lambda c: F.max(F.when(valid(c), F.col("content")))
    states = found.where(valid(base) | valid(head)).groupBy("node_id").agg(at(base).alias("before"), at(head).alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("edited")
    return states.select("node_id", change.alias("change"), "before", "after")
