"""File changes as micro-batches: filter paths, drop unchanged contents, hand on the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.linkers import changed_files
from ..session import checkpoint as saved

#: What a watcher passes over, and what it accepts.
IGNORED = r"(^|/)(\.git|target|node_modules|\.cargo)(/|$)|(^|/)[.#]|~$|\.sw[a-z]$"
ACCEPTED = r"\.(rs|py|ts|tsx|js|jsx|go|md|feature|toml|json|yaml|yml|proto|graphql|gql|graphqls)$"
#: Batches after which all hashes are written together.
WHOLE = 32
SCHEMA = "path string, content string, event_time timestamp"


def relevant(events: DataFrame) -> DataFrame:
    return events.where(~F.col("path").rlike(IGNORED) & F.col("path").rlike(ACCEPTED))


def inside(events: DataFrame, root: str) -> DataFrame:
    """Paths relative to a root; others are dropped."""
    prefix = root.rstrip("/") + "/"
    return events.where(F.startswith("path", F.lit(prefix))).withColumn("path", F.substr("path", F.lit(len(prefix) + 1)))


def newest(batch: DataFrame) -> DataFrame:
    """The last event of every path."""
    order = Window.partitionBy("path").orderBy(F.desc("event_time"), F.desc("content"))
    return batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def watch(spark: SparkSession, folder: str, state: str, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str | None = None):
    """Start a query over files of events dropped in ``folder``.

    ``handle`` gets (path, content, hash) of changed files per micro-batch. The
    hashes live in ``state`` (appended per batch, under the batch's number, so
    a repeated batch replaces its own; every ``WHOLE`` batches they are written
    together, so a batch reads at most that many folders). Without ``every`` it
    runs once over what is there.
    """

    def step(batch: DataFrame, number: int) -> None:
        found = newest(relevant(batch)).withColumn("hash", F.xxhash64("content"))
        seen = _hashes(spark, state, number)
        # Written once: the handler and the state read the same rows.
        fresh = saved(changed_files(found, seen).select("path", "content", "hash"))
        handle(fresh, number)
        kept = fresh.select("path", "hash")
        if number and number % WHOLE == 0:
            kept.unionByName(seen.join(kept.select("path"), "path", "left_anti")).write.mode("overwrite").parquet(f"{state}/whole={number}")
        kept.write.mode("overwrite").parquet(f"{state}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).parquet(folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def _hashes(spark: SparkSession, state: str, before: int) -> DataFrame:
    """The last stored hash per path of earlier batches."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(state).getFileSystem(spark._jsc.hadoopConfiguration())
    have = lambda kind, n: fs.exists(path(f"{state}/{kind}={n}/_SUCCESS"))
    whole = next((n for n in range((before - 1) // WHOLE * WHOLE, 0, -WHOLE) if have("whole", n)), -1)
    parts = [(f"{state}/whole={whole}", whole)] if whole >= 0 else []
    parts += [(f"{state}/batch={n}", n) for n in range(whole + 1, before) if have("batch", n)]
    rows = spark.createDataFrame([], "path string, hash long, batch long")
    for folder, n in parts:
        rows = rows.unionByName(spark.read.schema("path string, hash long").parquet(folder).withColumn("batch", F.lit(n).cast("long")))
    return rows.groupBy("path").agg(F.max_by("hash", "batch").alias("hash"))
