"""Effects of watched nodes, exactly once: notes, edges and new baselines of each batch.

A batch compares the bodies that it brings with the baselines that earlier
batches left. What it finds it writes to folders of its own number, replacing
what an earlier attempt at that batch left there; and it never reads its own
number. So a batch that comes again, also after a stop between two of its
writes, ends with the same three tables.

Defined results: a null body or baseline triggers nothing; of several bodies of
a node in one batch the largest counts; nodes that are not watched are passed
over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint
from .linkers import watch_triggers

NOTES = "note string, body string, before string, after string, batch long"
EDGES = "src string, dst string, batch long"
BASELINES = "node_id string, watch_baseline_body string, batch long"


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def effects(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes, edges, baselines) of all batches so far."""
    return _table(spark, folder, "notes", NOTES), _table(spark, folder, "edges", EDGES), _table(spark, folder, "baselines", BASELINES)


def with_baselines(watched: DataFrame, baselines: DataFrame) -> DataFrame:
    """Watched nodes with the newest baseline that a batch left them, or their own."""
    newest = baselines.groupBy("node_id").agg(F.max_by("watch_baseline_body", "batch").alias("_new"))
    return watched.join(newest, "node_id", "left").withColumn("watch_baseline_body", F.coalesce("_new", "watch_baseline_body")).drop("_new")


def apply_batch(spark: SparkSession, folder: str, batch: int, watched: DataFrame, bodies: DataFrame) -> None:
    """Write the effects of ``bodies`` (node_id, body) on ``watched`` (node_id, watch_baseline_body)."""
    earlier = effects(spark, folder)[2].where(F.col("batch") < batch)
    now = bodies.groupBy("node_id").agg(F.max("body").alias("body"))
    hit = watch_triggers(with_baselines(watched.select("node_id", "watch_baseline_body"), earlier).join(now, "node_id"))
    note = F.concat_ws("-", F.lit("watch"), F.lit(str(batch)), F.col("node_id"))
    # Read once: the three tables have to tell of the same nodes.
    found = checkpoint(hit.select(note.alias("note"), "node_id", F.col("watch_baseline_body").alias("before"), F.col("body").alias("after")))
    body = F.concat(F.lit("watched node changed: "), F.col("node_id"))
    tables = {
        "notes": found.select("note", body.alias("body"), "before", "after"),
        "edges": found.select(F.col("note").alias("src"), F.col("node_id").alias("dst")),
        "baselines": found.select("node_id", F.col("after").alias("watch_baseline_body")),
    }
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
