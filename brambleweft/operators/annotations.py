"""Notes, concepts, watches, views and imported review comments over snapshots of tables."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import backtick_tokens, safe_name
from ..plans import cypher
from ..plans.graph import Graph
from .mutate import merge_rows, set_where

_numbers = itertools.count()


def write_note(targets: DataFrame, markdown: str, now: str, title: str | None = None, author: str = "unknown", tags: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(note, NOTES edges) for every target (node_id); no target is an error. Ids never repeat."""
    if targets.isEmpty():
        raise ValueError("the match binds no node")
    spark, key = targets.sparkSession, f"note-{now}-{next(_numbers)}"
    note = spark.createDataFrame([(key, title, author, tags, now, markdown)], "node_id string, title string, author string, tags string, created_at string, markdown string")
    return note, targets.select(F.lit(key).alias("src"), F.col("node_id").alias("dst")).distinct()


def targets(g: Graph, match: str, **params) -> DataFrame:
    """(node_id) that a MATCH of the user binds to ``t``; a match that does not bind it is an error."""
    if not re.match(r"\s*MATCH\b", match, re.I):
        raise ValueError("a match starts with MATCH")
    rows = cypher.run(g, f"{match} RETURN DISTINCT t", **params)
    if dict(rows.dtypes).get("t") != "string":
        raise ValueError("t is not a node")
    return rows.select(F.col("t").alias("node_id")).where("node_id is not null")


def define_concept(concepts: DataFrame, edges: DataFrame, name: str, members: DataFrame, now: str, description: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Upsert a concept (its first created_at stays) and its DESCRIBES edges."""
    if not safe_name(name):
        raise ValueError(f"bad name {name!r}")
    row = concepts.sparkSession.createDataFrame([(name, description, now, now)], "name string, description string, created_at string, updated_at string")
    kept = merge_rows(concepts, row, ["name"])
    kept = set_where(kept, F.col("name") == name, {"updated_at": F.lit(now), "description": F.coalesce(F.lit(description), "description")})
    return kept, merge_rows(edges, members.select(F.lit(name).alias("src"), F.col("node_id").alias("dst")), ["src", "dst"])


def list_concepts(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("members"))
    return concepts.join(n, "name", "left").select("name", "description", "created_at", F.coalesce("members", F.lit(0).cast("long")).alias("members")).orderBy("name")


def list_notes(notes: DataFrame, edges: DataFrame, targets: DataFrame | None = None, limit: int = 50) -> DataFrame:
    if targets is not None:
        on = edges.join(targets.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node_id"))
        notes = notes.join(on, "node_id", "left_semi")
    return notes.orderBy(F.desc("created_at"), "node_id").limit(limit)


def run_view(spark: SparkSession, text: str, params: dict, **frames: DataFrame) -> DataFrame:
    """A stored query with typed parameters (``:name``) over named frames."""
    return spark.sql(text, args=params, **frames)


def import_comments(comments: DataFrame, functions: DataFrame) -> DataFrame:
    """(comment, node_id): comments (comment, body) by the identifiers they name in code spans."""
    named = comments.select("comment", F.explode(backtick_tokens(F.col("body"))).alias("token")).distinct()
    hits = [named.join(functions.select(F.col(c).alias("token"), "node_id"), "token") for c in ("name", "qualified_name")]
    return hits[0].unionByName(hits[1]).select("comment", "node_id").distinct()


def save_view(views: DataFrame, name: str, text: str, now: str, description: str | None = None) -> DataFrame:
    """Upsert a view (name, text, description, created_at, updated_at, last_run_at) by name; its created_at stays."""
    if not safe_name(name):
        raise ValueError(f"bad name {name!r}")
    row = views.sparkSession.createDataFrame([(name, text, description, now, now, None)], "name string, text string, description string, created_at string, updated_at string, last_run_at string")
    kept = merge_rows(views, row, ["name"])
    return set_where(kept, F.col("name") == name, {"text": F.lit(text), "description": F.coalesce(F.lit(description), "description"), "updated_at": F.lit(now)})


def list_views(views: DataFrame) -> DataFrame:
    return views.select("name", "description", "created_at", "last_run_at").orderBy("name")


def notes_from_comments(comments: DataFrame, functions: DataFrame, now: str, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(notes, NOTES edges): one note for every comment that names a function.

    Of the functions that one name hits, the first ``most`` by id are noted, as
    a common name tells little.
    """
    named = comments.select("comment", F.explode(backtick_tokens(F.col("body"))).alias("token")).distinct()
    hits = [named.join(functions.select(F.col(c).alias("token"), "node_id"), "token").withColumn("by", F.lit(c)) for c in ("name", "qualified_name")]
    met = hits[0].unionByName(hits[1])
    first = Window.partitionBy("comment", "token", "by").orderBy("node_id")
    kept = met.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= most).select("comment", "node_id").distinct()
    key = F.concat(F.lit(f"note-{now}-"), F.col("comment").cast("string"))
    notes = comments.join(kept.select("comment").distinct(), "comment", "left_semi").select(key.alias("node_id"), F.lit(now).alias("created_at"), F.col("body").alias("markdown"))
    return notes, kept.select(key.alias("src"), F.col("node_id").alias("dst"))
