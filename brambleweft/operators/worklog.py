"""Worklog roll-ups over items, an append-only status timeline and comments.

Frames: items (item, title, area, kind, created_at, current_status,
current_status_at), statuses (item, status, at), comments (item, comment_id, at).

One rule for ties everywhere: statuses of one time follow each other by their
text, so the last of them is the current one, and a comment of that time comes
after all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses in the order of a roadmap, and kinds of items.
STATUSES = ("in_progress", "pending", "blocked", "done", "abandoned")
KINDS = ("bug", "feature", "task", "refactor", "perf", "docs")


def latest_status(statuses: DataFrame) -> DataFrame:
    """(item, status, status_at): the last by time; ties by status."""
    last = F.max(F.struct("at", "status"))
    return statuses.groupBy("item").agg(last.alias("last")).select("item", F.col("last.status").alias("status"), F.col("last.at").alias("status_at"))


def rollup(statuses: DataFrame, comments: DataFrame) -> DataFrame:
    """Current status, number of comments, and the last activity of every item."""
    said = comments.groupBy("item").agg(F.count(F.lit(1)).alias("comments"), F.max("at").alias("commented_at"))
    rows = latest_status(statuses).join(said, "item", "left")
    return rows.select("item", "status", "status_at", F.coalesce("comments", F.lit(0).cast("long")).alias("comments"), F.greatest("status_at", "commented_at").alias("last_activity"))


def _spans(statuses: DataFrame, comments: DataFrame) -> DataFrame:
    """Statuses and comments (item, at, status or null, comment_id or null) with the number of the status they are at or under; 0 before the first."""
    kind = comments.schema["comment_id"].dataType
    said = comments.select("item", "at", F.lit(None).cast("string").alias("status"), "comment_id")
    events = statuses.select("item", "at", "status", F.lit(None).cast(kind).alias("comment_id")).unionByName(said)
    order = Window.partitionBy("item").orderBy("at", F.col("status").isNull(), "status").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("span", F.count("status").over(order))


def timeline(statuses: DataFrame, comments: DataFrame) -> DataFrame:
    """Each status with the number of comments until the next one."""
    status = F.col("status").isNotNull()
    found = _spans(statuses, comments).groupBy("item", "span").agg(F.max("status").alias("status"), F.min(F.when(status, F.col("at"))).alias("at"), F.count(F.when(~status, 1)).alias("comments"))
    return found.where("status is not null")


def roadmap(current: DataFrame, area: str = "area") -> DataFrame:
    """Items by area, then in the fixed order of statuses, newest first."""
    order = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(STATUSES) for x in (s, i)]), F.col("status"))
    return current.withColumn("turn", F.coalesce(order, F.lit(len(STATUSES)))).withColumn(area, F.coalesce(area, F.lit("_(no area)_"))).orderBy(area, "turn", F.desc("status_at"), "item")


def item_id(title: Column, created_at: Column) -> Column:
    """``wl-`` with the title as an ASCII slug of at most 60 characters and 14 letters or digits of the time."""
    slug = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(F.lit("wl-"), F.rtrim(F.left(slug, F.lit(60)), F.lit("-")), F.lit("-"), F.left(F.regexp_replace(created_at.cast("string"), "[^A-Za-z0-9]", ""), F.lit(14)))


def create(items: DataFrame, statuses: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, statuses, refused) after adding ``new`` rows (item?, title, area, kind, status, at).

    A row without an id gets ``item_id``. Rows with a status or kind that does
    not exist, with an id that is there already, or that repeat the id of an
    earlier new row are refused, each with its reason.
    """
    named = new.withColumn("item", F.coalesce("item", item_id(F.col("title"), F.col("at"))))
    turn = F.row_number().over(Window.partitionBy("item").orderBy("at", "title"))
    known = items.select("item", F.lit(True).alias("there"))
    reason = F.when(~F.col("status").isin(*STATUSES) | F.col("status").isNull(), "status").when(~F.col("kind").isin(*KINDS) | F.col("kind").isNull(), "kind").when(F.col("there") | (F.col("turn") > 1), "id")
    judged = named.withColumn("turn", turn).join(known, "item", "left").withColumn("reason", reason)
    good = judged.where("reason is null")
    rows = good.select("item", "title", "area", "kind", F.col("at").alias("created_at"), F.col("status").alias("current_status"), F.col("at").alias("current_status_at"))
    return items.unionByName(rows, allowMissingColumns=True), statuses.unionByName(good.select("item", "status", "at"), allowMissingColumns=True), judged.where("reason is not null").select("item", "title", "reason")


def set_status(items: DataFrame, statuses: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, statuses) after appending ``changes`` (item, status, at) of existing items.

    The timeline keeps every change; an item shows the last one by time and, of one time, by status.
    """
    valid = changes.where(F.col("status").isin(*STATUSES)).join(items.select("item"), "item", "left_semi").select("item", "status", "at")
    last = valid.groupBy("item").agg(F.max(F.struct("at", "status")).alias("_last"))
    newer = F.col("_last").isNotNull() & (F.col("current_status_at").isNull() | (F.col("_last") >= F.struct(F.col("current_status_at").alias("at"), F.col("current_status").alias("status"))))
    pick = lambda field, old: F.when(newer, F.col(f"_last.{field}")).otherwise(F.col(old)).alias(old)
    plain = [c for c in items.columns if c not in ("current_status", "current_status_at")]
    shown = items.join(last, "item", "left").select(*plain, pick("status", "current_status"), pick("at", "current_status_at"))
    return shown, statuses.unionByName(valid, allowMissingColumns=True)


def comment(statuses: DataFrame, said: DataFrame) -> DataFrame:
    """Comments (item, comment_id, at) with the status that was the item's last; without any, none."""
    last = latest_status(statuses).select("item", "status", "status_at")
    return said.join(last, "item").select("item", "comment_id", "at", "status", "status_at")


def listed(items: DataFrame, statuses: DataFrame, comments: DataFrame, area: str | None = None, status: str | None = None, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Items that fit all filters, the last changed first, with their comments and last activity."""
    for column, value in (("area", area), ("kind", kind)):
        if value is not None:
            items = items.where(F.col(column) == value)
    rows = items.join(rollup(statuses, comments), "item")
    if status is not None:
        rows = rows.where(F.col("status") == status)
    return rows.orderBy(F.desc("status_at"), "item").limit(max(1, limit))


def report(items: DataFrame, statuses: DataFrame, comments: DataFrame) -> DataFrame:
    """Items, newest first, with their statuses and under each its comments, oldest first, as nested lists."""
    status = F.col("status").isNotNull()
    said = F.array_sort(F.collect_list(F.when(~status, F.struct("at", "comment_id"))))
    entries = _spans(statuses, comments).groupBy("item", "span").agg(F.max("status").alias("status"), F.min(F.when(status, F.col("at"))).alias("at"), said.alias("comments")).where("status is not null")
    listed = F.array_sort(F.collect_list(F.struct("span", "at", "status", "comments")))
    nested = entries.groupBy("item").agg(F.transform(listed, lambda e: F.struct(e["at"].alias("at"), e["status"].alias("status"), e["comments"].alias("comments"))).alias("timeline"))
    return items.join(nested, "item", "left").orderBy(F.desc("created_at"), "item")
