"""Scans over numbered lines: running counts, last values seen, finite automata.

What a line inherits from all lines before it is found in two steps. Lines are
cut into blocks of ``BLOCK``, and each block is summed up by something that can
be composed: a count, a last value, or an automaton's table (for every state it
may begin in, the one it ends in). Block summaries of a file, a thousandth of
its lines, are composed in order, which gives each block what it begins with;
then every block is gone through on its own. So no task holds a file, and one
huge file is many tasks.

Frames have (path, line) and what is scanned; a line is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _blocks(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_block", F.floor(F.col("line") / BLOCK))


def _inside() -> Window:
    return Window.partitionBy("path", "_block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)


def _earlier() -> Window:
    return Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def counted(lines: DataFrame, **marks: Column) -> DataFrame:
    """Add, for each name, how many lines of the file up to this one have the mark."""
    cut = _blocks(lines.withColumns({f"_{n}": F.coalesce(m, F.lit(False)).cast("long") for n, m in marks.items()}))
    sums = cut.groupBy("path", "_block").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in marks])
    before = sums.select("path", "_block", *[F.coalesce(F.sum(f"_{n}").over(_earlier()), F.lit(0)).alias(f"_{n}0") for n in marks])
    met = cut.join(before, ["path", "_block"])
    return met.select(*lines.columns, *[(F.sum(f"_{n}").over(_inside()) + F.col(f"_{n}0")).alias(n) for n in marks])


def last_seen(lines: DataFrame, **values: Column) -> DataFrame:
    """Add, for each name, the last value that is not null up to this line."""
    cut = _blocks(lines.withColumns({f"_{n}": v for n, v in values.items()}))
    sums = cut.groupBy("path", "_block").agg(*[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("line"))).alias(f"_{n}") for n in values])
    before = sums.select("path", "_block", *[F.last(f"_{n}", ignorenulls=True).over(_earlier()).alias(f"_{n}0") for n in values])
    met = cut.join(before, ["path", "_block"])
    return met.select(*lines.columns, *[F.coalesce(F.last(f"_{n}", ignorenulls=True).over(_inside()), f"_{n}0").alias(n) for n in values])


def automaton(lines: DataFrame, symbol: Column, step: Callable[[Column, Column], Column], states: list[int], start: int = 0) -> DataFrame:
    """(path, line, before, after): the states around every line that has a symbol.

    ``step`` gives the state after a state and a symbol; lines without a symbol
    leave a state alone. A block's table is its symbols folded over all states.
    """
    cut = _blocks(lines.select("path", "line", symbol.alias("symbol")).where("symbol is not null"))
    blocks = cut.groupBy("path", "_block").agg(F.array_sort(F.collect_list(F.struct("line", "symbol"))).alias("read"))
    every = F.array(*map(F.lit, states))
    table = F.aggregate("read", every, lambda now, x: F.transform(now, lambda s: step(s, x["symbol"])))
    tables = blocks.select("path", F.struct("_block", table.alias("to")).alias("x")).groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("tables"))
    begin = F.struct(F.lit(start).alias("state"), F.array().cast("array<struct<_block:long,state:int>>").alias("done"))
    entry = lambda acc, x: F.struct(F.element_at(x["to"], F.array_position(every, acc["state"]).cast("int")).alias("state"), F.array_append(acc["done"], F.struct(x["_block"].alias("_block"), acc["state"].alias("state"))).alias("done"))
    starts = tables.select("path", F.explode(F.aggregate("tables", begin, entry, lambda acc: acc["done"])).alias("x")).select("path", "x._block", F.col("x.state").alias("entry"))
    walk = lambda now, x: F.array_append(now, step(F.element_at(now, -1), x["symbol"]))
    walked = blocks.join(starts, ["path", "_block"]).select("path", "read", F.aggregate("read", F.array("entry"), walk).alias("states"))
    each = walked.select("path", F.posexplode("read").alias("at", "x"), "states")
    return each.select("path", F.col("x.line").alias("line"), F.get("states", F.col("at")).alias("before"), F.get("states", F.col("at") + 1).alias("after"))
