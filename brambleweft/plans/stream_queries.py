"""Registered queries over streams: file events replayed in batches, and effects of watched nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import watching
from ..session import checkpoint, delete_folder, new_folder
from ..streaming import replay
from .projection import project, read
from .queries import query

#: Events arrive in so many batches, out of order; each is one about a user's file.
PARTS = 3
ROOT = "/ws/"
REPLAY = f"""e AS (SELECT event_id % {PARTS} AS part, 'src/u' || user_id || '.rs' AS path, epoch_us(ts) AS tm, event_id AS tie, event_type AS content, event_type NOT IN ('view', 'click') AS ok FROM events),
n AS (SELECT part, path, max((tm, tie, content)) AS x FROM e WHERE ok GROUP BY part, path),
b AS (SELECT *, max(x) OVER (PARTITION BY path ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS y FROM n),
c AS (SELECT part, path, x[3] AS content, y IS NULL OR (x > y AND x[3] <> y[3]) AS changed FROM b)"""


def _replayed(spark, d):
    """(folder, counts) after every part of the events has been read by a stream of its own."""
    events = read(spark, d, "events")
    # What is looked at is outside the workspace, what is clicked is built.
    place = F.when(F.col("event_type") == "view", "/other/src/u").when(F.col("event_type") == "click", "/ws/target/u").otherwise("/ws/src/u")
    path = F.concat(place, F.col("user_id").cast("string"), F.lit(".rs"))
    rows = events.select(path.alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("tie"), F.col("event_type").alias("content"), (F.col("event_id") % PARTS).alias("part"))
    folder = new_folder(spark, "replay")
    return folder, replay.replay(spark, folder, (rows.where(F.col("part") == k).drop("part") for k in range(PARTS)), ROOT)


@query("replay_changes", f"WITH {REPLAY} SELECT path, arg_max(content, part) AS content, count(*) AS changes FROM c WHERE changed GROUP BY path", ctes="")
def replay_changes(spark, d):
    folder, _ = _replayed(spark, d)
    order = F.struct("at", "tie", "content")
    last = spark.read.parquet(f"{folder}/out").groupBy("path").agg(F.max_by("content", order).alias("content"), F.count(F.lit(1)).alias("changes"))
    last = checkpoint(last)
    delete_folder(spark, folder)
    return last


@query("replay_counters", f"""WITH {REPLAY} SELECT part AS batch, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS ignored,
 (SELECT count(*) FROM c WHERE changed AND c.part = e.part) AS changed FROM e GROUP BY part""", ctes="")
def replay_counters(spark, d):
    folder, counted = _replayed(spark, d)
    delete_folder(spark, folder)
    return spark.createDataFrame([(c["batch"], c["accepted"], c["ignored"], c["changed"]) for c in counted], "batch long, accepted long, ignored long, changed long")


def _effects(spark, d):
    """Notes, edges and baselines after three batches of new bodies, of which the second comes twice."""
    fn = project(spark, d).nodes("Function")
    watched = fn.where("is_test").select("node_id", F.lit("v0").alias("watch_baseline_body"))
    folder = new_folder(spark, "effects")
    for batch in (0, 1, 1, 2):
        body = F.concat(F.lit("v"), (F.col("line_start") % (batch + 2)).cast("string"))
        watching.apply_batch(spark, folder, batch, watched, fn.select("node_id", body.alias("body")))
    return folder, watched


EFFECTS = """w AS (SELECT id AS node_id, line_start FROM fn WHERE is_test),
v AS (SELECT node_id, k AS batch, 'v' || (line_start % (k + 2)) AS body FROM w, (SELECT unnest([0, 1, 2]) AS k)),
p AS (SELECT *, coalesce(lag(body) OVER (PARTITION BY node_id ORDER BY batch), 'v0') AS before FROM v)"""


@query("watch_effects", f"+ {EFFECTS} SELECT 'watch-' || batch || '-' || node_id AS note, node_id, before, body AS after FROM p WHERE before <> body")
def watch_effects(spark, d):
    folder, _ = _effects(spark, d)
    notes, edges, _ = watching.effects(spark, folder)
    found = checkpoint(notes.join(edges.select(F.col("src").alias("note"), F.col("dst").alias("node_id")), "note").select("note", "node_id", "before", "after"))
    delete_folder(spark, folder)
    return found


@query("watch_rebaselined", f"+ {EFFECTS} SELECT node_id, arg_max(body, batch) AS watch_baseline_body FROM v GROUP BY node_id")
def watch_rebaselined(spark, d):
    folder, watched = _effects(spark, d)
    found = checkpoint(watching.with_baselines(watched, watching.effects(spark, folder)[2]).select("node_id", "watch_baseline_body"))
    delete_folder(spark, folder)
    return found
