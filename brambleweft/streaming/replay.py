"""File events as a stream with keyed state: what changed, whatever is replayed, and how much was seen.

The state of a path (time, tie and content of its newest event) lives in Spark's
state store, under the stream's checkpoint, so a restarted stream goes on where
the last committed batch ended: an event is neither lost nor handed on twice. An
event is handed on if it is newer than the state and its content is another.

Before the shuffle every task keeps only the newest event of each path it holds,
so a path that a third of all events are about is no load on one task. After it,
what a path costs is its calls to the state store, one to read and one to write;
events come as rows, as a frame for each path would cost more than they do.

Counts come from metrics observed on the running write and arrive with its
progress; they cost no job of their own.

Defined results: events without a path, outside the root or of ignored kinds are
counted as ignored; a null time is the earliest and a null content the empty
one; of events with one time the larger tie wins, then the larger content.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .live import ACCEPTED, IGNORED

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "path string, at long, tie long, content string"
ORDER = ["at", "tie", "content"]
#: A task hands its newest events on when it holds those of more than half as many paths.
HELD = 1 << 16


class Newest(StatefulProcessor):
    """Hands on a path's newest event when its content is not that of the one before."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "at long, tie long, content string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = max(((x.at, x.tie, x.content) for x in rows), default=None)
        last = self.last.get()  # None at first
        if best is not None and (last is None or best > last):
            self.last.update(best)
            if last is None or best[2] != last[2]:
                yield Row(path=key[0], at=best[0], tie=best[1], content=best[2])

    def close(self) -> None:
        pass


def _newest(part: pd.DataFrame) -> pd.DataFrame:
    return part.sort_values(ORDER).drop_duplicates("path", keep="last")


def _newest_of_each(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for part in parts:
        held.append(_newest(part))
        if sum(map(len, held)) > HELD:
            held = [_newest(pd.concat(held))]
            if len(held[0]) > HELD // 2:
                yield held.pop()
    if held:
        yield _newest(pd.concat(held))


def changes(events: DataFrame, root: str = "") -> DataFrame:
    """Events (path, at, tie, content), streamed or not counted twice: the changes among those under ``root`` that a watcher accepts."""
    inside = F.col("path").startswith(root)
    short = F.substr("path", F.lit(len(root) + 1))
    good = F.coalesce(inside & ~short.rlike(IGNORED) & short.rlike(ACCEPTED), F.lit(False))
    least = F.lit(-(1 << 63)).cast("long")
    filled = events.select(short.alias("path"), good.alias("good"), F.coalesce("at", least).alias("at"), F.coalesce("tie", least).alias("tie"), F.coalesce("content", F.lit("")).alias("content"))
    seen = filled.observe("seen", F.count(F.when(F.col("good"), 1)).alias("accepted"), F.count(F.when(~F.col("good"), 1)).alias("ignored"))
    reduced = seen.where("good").select("path", "at", "tie", "content").mapInPandas(_newest_of_each, EVENT)
    handed = reduced.groupBy("path").transformWithState(Newest(), outputStructType=EVENT, outputMode="Append", timeMode="None")
    return handed.observe("handed", F.count(F.lit(1)).alias("changed"))


def run(spark: SparkSession, folder: str, root: str = "") -> list[dict]:
    """Read what is new in ``folder/in`` and append changes to ``folder/out``; gives the counts of each batch.

    The stream's offsets, state and commits are in ``folder/checkpoint``; a run
    that was stopped leaves its batch to the next one, which does it again.
    """
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        stream = changes(spark.readStream.schema(EVENT).parquet(f"{folder}/in"), root).writeStream.format("parquet")
        query = stream.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return [counts(p) for p in query.recentProgress if p.numInputRows]
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def counts(progress) -> dict:
    """The counts of one batch, from its progress."""
    seen, handed = progress.observedMetrics["seen"], progress.observedMetrics["handed"]
    return {"batch": progress.batchId, "accepted": seen["accepted"], "ignored": seen["ignored"], "changed": handed["changed"]}


def replay(spark: SparkSession, folder: str, parts: Iterable[DataFrame], root: str = "") -> list[dict]:
    """Each of ``parts`` arrives and is read by a stream of its own, which starts from the last one's checkpoint."""
    out: list[dict] = []
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        out += run(spark, folder, root)
    return out
