"""Incremental runs: what to read again, what to wipe, and what stays, all as joins.

Derived rows carry the path that they come from; a run names changed and
deleted paths as a frame (path) and rewrites what hangs on them. Durable rows
(notes, commits, concepts, the worklog) address their targets by label and
natural key, so they outlive a wipe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import pattern as P

#: Natural key of the labels that notes are put on.
NATURAL_KEYS = {"Function": "qualified_name", "Symbol": "qualified_name", "File": "path", "Package": "name"}
#: Hash of the pseudo commit that stands for uncommitted files.
OVERLAY = "WORKING-TREE"


def mode(live_paths: DataFrame | None, stored_head: str | None, head: str | None) -> str:
    """``live`` with explicit paths, ``noop`` at the stored head, ``incremental`` from it, else ``full``."""
    if live_paths is not None:
        return "live"
    if stored_head is None or head is None:
        return "full"
    return "noop" if stored_head == head else "incremental"


def wipe_outgoing(edges: DataFrame, callers: DataFrame) -> DataFrame:
    """Edges without those that start at ``callers`` (node_id), which are extracted anew."""
    return P.where_missing(edges, "src", callers, "node_id")


def wipe_paths(nodes: DataFrame, edges: DataFrame, changed: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without what changed or deleted files defined.

    Nodes (node_id, labels, path): the File of a changed path stays, as its record
    is merged later; the File of a deleted path goes. Edges at a wiped node go too.
    """
    file = F.array_contains("labels", "File")
    gone = P.where_exists(nodes, "path", changed.unionByName(deleted), "path").where(~file)
    gone = gone.select("node_id").unionByName(P.where_exists(nodes.where(file), "path", deleted, "path").select("node_id"))
    left = edges
    for end in ("src", "dst"):
        left = P.where_missing(left, end, gone, "node_id")
    return P.where_missing(nodes, "node_id", gone, "node_id"), left


def wipe_documents(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """Sections (qualified_name ``path#slug``) and documents (``path``) that are not of ``documents`` (path)."""
    path = F.regexp_replace("qualified_name", "#[^#]*$", "")
    return P.where_missing(sections.withColumn("_path", path), "_path", documents, "path").drop("_path")


def note_addresses(notes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(note, label, key) of NOTES edges (src, dst), by the natural key of what they are on."""
    key, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, column in NATURAL_KEYS.items():
        if column in nodes.columns:
            key = F.when(F.array_contains("labels", name), F.col(column)).otherwise(key)
            label = F.when(F.array_contains("labels", name), F.lit(name)).otherwise(label)
    addressed = nodes.select(F.col("node_id").alias("dst"), label.alias("label"), key.alias("key")).where("key is not null")
    kept = P.where_exists(edges, "src", notes, "node_id")
    return kept.join(addressed, "dst").select(F.col("src").alias("note"), "label", "key").distinct()


def reattach_notes(addresses: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, orphans): NOTES edges to the nodes that have an address now, and notes without one."""
    parts = [nodes.where(F.array_contains("labels", name)).select(F.lit(name).alias("label"), F.col(column).alias("key"), F.col("node_id").alias("dst")) for name, column in NATURAL_KEYS.items() if column in nodes.columns]
    there = parts[0]
    for more in parts[1:]:
        there = there.unionByName(more)
    edges = addresses.join(there, ["label", "key"]).select(F.col("note").alias("src"), "dst").distinct()
    # Whether a note has an edge takes no edges: nodes of one address may be many.
    held = addresses.join(there.select("label", "key", F.lit(True).alias("there")).distinct(), ["label", "key"], "left")
    return edges, held.groupBy("note").agg(F.max("there").alias("there")).where("there is null").select("note")


def overlay(commits: DataFrame, parents: DataFrame, snapshots: DataFrame, head: str, dirty: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits, PARENT_OF, SNAPSHOT_OF) for a working tree with the ``dirty`` files (path).

    With any, a pseudo commit follows the head and is what the snapshot shows;
    without, no pseudo commit is left and the snapshot shows the head. Only one
    commit is the snapshot of a workspace, whatever was there before.
    """
    files = dirty.agg(F.array_join(F.array_sort(F.collect_set("path")), "\n").alias("files")).where("files <> ''")
    pseudo = files.select(F.lit(OVERLAY).alias("hash"), F.lit("uncommitted changes").alias("message"), at.alias("timestamp"), "files")
    commits = commits.where(F.col("hash") != OVERLAY).unionByName(pseudo, allowMissingColumns=True)
    parents = parents.where((F.col("src") != OVERLAY) & (F.col("dst") != OVERLAY)).unionByName(files.select(F.lit(head).alias("src"), F.lit(OVERLAY).alias("dst")))
    shown = files.agg(F.when(F.count(F.lit(1)) > 0, OVERLAY).otherwise(head).alias("src"))
    return commits, parents, snapshots.select("dst").distinct().crossJoin(shown).select("src", "dst")


def promote_steps(functions: DataFrame, steps: DataFrame) -> DataFrame:
    """Functions of test files that a step attribute (path, name, step_kind, step_regex) names, as steps.

    A function gets the first attribute by kind and pattern; others stay as they are.
    """
    tests = steps.where(F.contains("path", F.lit("/tests/")))
    first = tests.groupBy("path", "name").agg(F.min(F.struct("step_kind", "step_regex")).alias("_step"))
    joined = functions.join(first, ["path", "name"], "left")
    step = F.col("_step").isNotNull()
    old = lambda c: F.col(c) if c in functions.columns else F.lit(None).cast("string")
    plain = [c for c in functions.columns if c not in ("kind", "step_kind", "step_regex")]
    return joined.select(*plain, F.when(step, "Step").otherwise(old("kind")).alias("kind"), F.when(step, F.col("_step.step_kind")).otherwise(old("step_kind")).alias("step_kind"), F.when(step, F.col("_step.step_regex")).otherwise(old("step_regex")).alias("step_regex"))


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links (doc_path, href) to indexed files (path): (doc_path, href, path).

    Anchors, web and mail addresses are no file links; fragment and query are
    cut; the rest is taken from the document's folder, with ``.`` and ``..``
    resolved, and has to be a known path. What leads above the root is none.
    """
    local = links.where(~F.col("href").rlike("(?i)^(#|https?:|mailto:)"))
    folder = F.regexp_replace("doc_path", "[^/]*$", "")
    target = F.regexp_replace("href", "[#?].*$", "")
    joined = F.split(F.when(target.startswith("/"), F.ltrim(target, F.lit("/"))).otherwise(F.concat(folder, target)), "/")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    # A path that leaves the root is marked by a part that no path has.
    walk = lambda done, part: F.when(part.isin("", "."), done).when((part == "..") & (F.size(done) > 0), up(done)).when(part == "..", F.array(F.lit("\0"))).otherwise(F.concat(done, F.array(part)))
    path = F.array_join(F.aggregate(joined, F.array().cast("array<string>"), walk), "/")
    return P.where_exists(local.withColumn("path", path).where(target != ""), "path", files, "path").select("doc_path", "href", "path")


def file_records(files: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(File rows, CONTAINS edges) of files (path, text) and packages (name, path).

    A file is its path, name, extension, number of lines and content hash; the
    package with the longest path that holds it contains it.
    """
    from .reports import longest_prefix

    name = F.element_at(F.split("path", "/"), -1)
    dot = F.regexp_extract(name, r"\.([^.]*)$", 1)
    lines = F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n")))
    rows = files.select("path", name.alias("name"), dot.alias("extension"), lines.cast("int").alias("lines"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("content_hash"))
    homes = longest_prefix(files.select("path").distinct(), "path", packages.select(F.col("path").alias("home")), "home")
    edges = homes.join(packages.select("name", F.col("path").alias("home")), "home").select(F.col("name").alias("src"), F.col("path").alias("dst"))
    return rows, edges


def watch(nodes: DataFrame, targets: DataFrame, body: str, commit: str, at: str) -> DataFrame:
    """Label ``targets`` (node_id) as watched, with what they hold now as the baseline; none is an error."""
    if P.where_exists(nodes, "node_id", targets, "node_id").isEmpty():
        raise ValueError("the match binds no node")
    hit = nodes.join(targets.select("node_id", F.lit(True).alias("_hit")).distinct(), "node_id", "left")
    set_to = {"watch_baseline_body": F.col(body), "watch_set_at_commit": F.lit(commit), "watch_set_at": F.lit(at)}
    old = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    plain = [c for c in nodes.columns if c not in {*set_to, "labels"}]
    labels = F.when(F.col("_hit"), F.array_union("labels", F.array(F.lit("Watch")))).otherwise(F.col("labels"))
    return hit.select(*plain, labels.alias("labels"), *[F.when(F.col("_hit"), v).otherwise(old(c)).alias(c) for c, v in set_to.items()])


def unwatch(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Take label and baseline off ``targets`` (node_id)."""
    hit = nodes.join(targets.select("node_id", F.lit(True).alias("_hit")).distinct(), "node_id", "left")
    cleared = {c: F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)) for c in ("watch_baseline_body", "watch_set_at_commit", "watch_set_at") if c in nodes.columns}
    return hit.withColumns({"labels": F.when(F.col("_hit"), F.array_remove("labels", "Watch")).otherwise(F.col("labels"))} | cleared).drop("_hit")


def index_status(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of every table of a snapshot, in one pass each."""
    parts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, t in sorted(tables.items())]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
