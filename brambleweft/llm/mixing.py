"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Within a source every document expects ``target / source_size`` copies. The
documents are laid out by size, their expected copies are summed up along that
order, one random offset per source is added, and a document is emitted once
per integer boundary that its stretch crosses. Laying them out by size keeps
the words taken near the target, since neighbours stand in for each other.

The running sum is made in two levels: (source, size class, salt) groups are
ranked inside, and a small table of group counts gives every group its start,
so a source with a third of all rows is spread over many tasks.

Defined results: null and blank texts have size 0 and are drawn like others
(they add no words); a null source is a source of its own, sorted last; a null
id sorts first, and such rows are told apart by a hash of their columns; equal
rows are interchangeable; an empty table gives an empty result. The input's
columns travel in one struct and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A salt is this many hexadecimal digits of the id's MD5.
SALT_DIGITS = 2
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets of (no_source, source, source_size): weighted shares of the whole, capped.

    A target stops at ``most`` times its source's size; what is above is shared
    anew by weight. That fixed point is ``min(weight * level, cap)`` for one
    level, found over the sources in order of cap / weight. One row per source.
    """
    by_name = Window.orderBy("no_source", "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.select("*", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).alias("weight"), (F.col("source_size") * most).alias("cap"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "no_source", "source")
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.select("*", level.alias("level"), F.row_number().over(order).alias("turn"))
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("turn", "level"))).over(whole)
    return levels.withColumn("first", first).select(
        "no_source",
        "source",
        "source_size",
        F.when(F.col("turn") >= F.col("first.turn"), F.col("weight") * F.col("first.level")).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def systematic_copies(rows: DataFrame, id_col: str, source_col: str, size: "F.Column", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = SEED) -> DataFrame:
    """(row, size, source_size, target, copies): ``row`` holds the input's columns."""
    digits = F.bin(F.col("size"))
    laid = rows.select(
        F.struct("*").alias("row"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.col(id_col).alias("id"),
        size.alias("size"),
        # Maps cannot be hashed.
        F.xxhash64(*[F.col(c) for c, kind in rows.dtypes if "map<" not in kind]).alias("h"),
    ).select(
        "*",
        F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 4)).alias("class"),
        F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.col("h").cast("string"))), 1, SALT_DIGITS).alias("salt"),
    )
    key = ["no_source", "source", "class", "salt"]
    groups = laid.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"))
    targets = source_targets(groups.groupBy("no_source", "source").agg(F.sum("words").alias("source_size")), weights, most)
    before = Window.partitionBy("no_source", "source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(*key, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")).join(targets, ["no_source", "source"])
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("source"))), 1, 3), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4096.0)
    starts = starts.select("*", offset.alias("offset"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("expected"))
    inside = Window.partitionBy(*key).orderBy("size", "id", "h")
    ranked = laid.withColumn("rank", F.row_number().over(inside)).join(starts, key)
    upto = F.floor(F.col("offset") + (F.col("start") + F.col("rank")) * F.col("expected"))
    earlier = F.floor(F.col("offset") + (F.col("start") + F.col("rank") - 1) * F.col("expected"))
    return ranked.select("row", "size", "source_size", "target", (upto - earlier).cast("long").alias("copies"))


def mix(rows: DataFrame, id_col: str, source_col: str, size: "F.Column", **options) -> DataFrame:
    """The mixed rows themselves: each as often as it is drawn, with the input's columns."""
    drawn = systematic_copies(rows, id_col, source_col, size, **options).where("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
