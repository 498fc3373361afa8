"""Derived edges: joins that link what extraction has found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .patterns import first_matches

#: How a test function is marked in its source.
TEST_MARKS = ("#[test]", "#[tokio::test]")


def is_test(body: Column) -> Column:
    return F.contains(body, F.lit(TEST_MARKS[0])) | F.contains(body, F.lit(TEST_MARKS[1]))


def tests_from_calls(calls: DataFrame, tests: DataFrame) -> DataFrame:
    """Distinct (src, dst) from a test to what is no test."""
    named = tests.select("node_id").distinct()
    return calls.join(named.select(F.col("node_id").alias("src")), "src", "left_semi").join(named.select(F.col("node_id").alias("dst")), "dst", "left_anti").select("src", "dst").distinct()


#: Patterns that are tried in one expression; more of them are joined.
FEW_PATTERNS = 200


def first_regex_match(steps: DataFrame, patterns: DataFrame, kind: str = "kind", text: str = "text") -> DataFrame:
    """Each step with the first pattern (by ``ord``) of its kind that is found in its text.

    Kinds are few, so a join by kind would send all steps of one to one task.
    Patterns are what a project defines: up to ``FEW_PATTERNS`` are read and
    tried in order where the steps are. Of more, a step meets only those that
    have a literal in common with it, see ``patterns``.
    """
    ahead = patterns.select(F.col(kind).alias("k"), "ord", "pattern", "function").orderBy("ord").limit(FEW_PATTERNS + 1).collect()
    if len(ahead) <= FEW_PATTERNS:
        found = F.lit(None).cast("string")
        for p in reversed(ahead):
            found = F.when((F.col(kind) == p["k"]) & F.col(text).rlike(p["pattern"]), F.lit(p["function"])).otherwise(found)
        return steps.select("step_id", found.alias("function")).where("function is not null")
    return first_matches(steps.select("step_id", F.col(kind).alias("kind"), F.col(text).alias("text")), patterns.withColumnRenamed(kind, "kind"))


def resolve_mentions(spans: DataFrame, symbols: DataFrame) -> DataFrame:
    """Spans (token) to symbols: exact qualified name, else the first with that short name."""
    exact = symbols.select(F.col("qualified_name").alias("token"), F.col("qualified_name").alias("exact")).distinct()
    short = symbols.groupBy(F.col("name").alias("token")).agg(F.min("qualified_name").alias("short"))
    found = spans.join(exact, "token", "left").join(short, "token", "left")
    return found.withColumn("target", F.coalesce("exact", "short")).where("target is not null").drop("exact", "short")


def first_and_last_seen(rows: DataFrame, earlier: DataFrame, head: str, key: str) -> DataFrame:
    """Keep the first commit of rows seen before; all are last seen at ``head``."""
    kept = earlier.select(key, F.col("first_seen_commit").alias("_first"))
    return rows.join(kept, key, "left").select(*[rows[c] for c in rows.columns if c not in ("first_seen_commit", "last_seen_commit")], F.coalesce("_first", F.lit(head)).alias("first_seen_commit"), F.lit(head).alias("last_seen_commit"))


def watch_triggers(watched: DataFrame) -> DataFrame:
    """Watched rows whose body differs from the baseline; nulls never trigger."""
    return watched.where("watch_baseline_body is not null and body is not null and body <> watch_baseline_body")


def changed_files(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, hash) whose hash is new or differs from the stored one; unknown hashes stay."""
    old = stored.select("path", F.col("hash").alias("_old"))
    return found.join(old, "path", "left").where(F.col("_old").isNull() | F.col("hash").isNull() | (F.col("hash") != F.col("_old"))).drop("_old")


def replay_calls(before: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (qualified_name, callee) of unchanged bodies, and names to extract again.

    ``before``: qualified_name, body_hash, callees; ``now``: qualified_name, body_hash.
    """
    same = now.join(before, ["qualified_name", "body_hash"])
    calls = same.select("qualified_name", F.explode(F.array_distinct("callees")).alias("callee"))
    return calls, now.join(same.select("qualified_name"), "qualified_name", "left_anti")


def commit_references(commits: DataFrame, refs: Column, items: DataFrame) -> DataFrame:
    """(hash, item) of trailers that name existing items."""
    named = commits.select("hash", F.explode(refs).alias("item"))
    return named.join(items.select("item"), "item", "left_semi").distinct()


def exposes(endpoints: DataFrame, packages: DataFrame) -> DataFrame:
    """(package, path, route, method): endpoints (path, route, method) of the package (name, path) whose folder holds their file."""
    from .reports import longest_prefix

    homes = longest_prefix(endpoints.select("path").distinct(), "path", packages.select(F.col("path").alias("home")), "home")
    named = homes.join(packages.select(F.col("name").alias("package"), F.col("path").alias("home")), "home")
    return endpoints.join(named, "path").select("package", "path", "route", "method").distinct()


def parents(commits: DataFrame, author: str, order: list[str], key: str) -> DataFrame:
    """Successive commits of an author, as (src, dst)."""
    w = Window.partitionBy(author).orderBy(*order)
    return commits.select(F.col(key).alias("src"), F.lead(key).over(w).alias("dst")).where("dst is not null")
