"""Registered queries over what changes a graph: mutations, the worklog, incremental runs, notes and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import annotations, incremental, linkers, mutate, worklog
from .projection import project, read
from .queries import LOG, _log, query


@query("create_rows", "SELECT id AS node_id, name FROM fn UNION ALL SELECT 'file::' || s_suppkey, s_name FROM supplier")
def create_rows(spark, d):
    g = project(spark, d)
    return mutate.create_rows(g.nodes("Function").select("node_id", "name"), g.nodes("File").select("node_id", "name"))


@query("add_and_remove_label", "SELECT id AS node_id, CASE WHEN line_start > 25 THEN 'Function,Large' WHEN is_test THEN 'Function' ELSE 'Function' END AS labels FROM fn")
def add_and_remove_label(spark, d):
    fn = project(spark, d).nodes("Function")
    changed = mutate.remove_label(mutate.add_label(fn, F.col("line_start") > 25, "Large"), F.lit(True), "Test")
    return changed.select("node_id", F.array_join("labels", ",").alias("labels"))


@query("remove_properties", "SELECT id AS node_id, name, CASE WHEN is_test THEN NULL ELSE kind END AS kind, CASE WHEN is_test THEN NULL ELSE line_start END AS line_start FROM fn")
def remove_properties(spark, d):
    return mutate.remove_properties(project(spark, d).nodes("Function"), F.col("is_test"), "kind", "line_start", "absent").select("node_id", "name", "kind", "line_start")


@query("delete_edges", "SELECT src, dst FROM calls EXCEPT SELECT src, dst FROM tests")
def delete_edges(spark, d):
    g = project(spark, d)
    return mutate.delete_edges(g.edges("CALLS").select("src", "dst"), g.edges("TESTS").select("src", "dst"))


NEW = """n AS (SELECT 'User ' || user_id AS title, event_type AS type, value, ts AS tm FROM events),
m AS (SELECT *, 'wl-user-' || substr(title, 6) || '-' || left(regexp_replace(tm::VARCHAR, '[^A-Za-z0-9]', '', 'g'), 14) AS item,
  CASE type WHEN 'signup' THEN 'feature' WHEN 'error' THEN 'bug' WHEN 'view' THEN 'docs' WHEN 'purchase' THEN 'task' ELSE 'chore' END AS kind,
  CASE WHEN value > 50 THEN 'later' WHEN value > 20 THEN 'pending' ELSE 'done' END AS status FROM n),
j AS (SELECT *, CASE WHEN status = 'later' THEN 'status' WHEN kind = 'chore' THEN 'kind' WHEN row_number() OVER (PARTITION BY item ORDER BY tm, title) > 1 THEN 'id' END AS reason FROM m)"""


def _new_items(spark, d):
    events = read(spark, d, "events")
    kind = F.col("event_type")
    return events.select(
        F.lit(None).cast("string").alias("item"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("title"),
        F.col("props").alias("area"),
        F.when(kind == "signup", "feature").when(kind == "error", "bug").when(kind == "view", "docs").when(kind == "purchase", "task").otherwise("chore").alias("kind"),
        F.when(F.col("value") > 50, "later").when(F.col("value") > 20, "pending").otherwise("done").alias("status"),
        F.col("ts").alias("at"),
    )


def _empty_log(spark):
    items = spark.createDataFrame([], "item string, title string, area string, kind string, created_at timestamp, current_status string, current_status_at timestamp")
    return items, spark.createDataFrame([], "item string, status string, at timestamp")


@query("worklog_create", f"+ {NEW} SELECT item, title, kind, tm AS created_at, status AS current_status FROM j WHERE reason IS NULL")
def worklog_create(spark, d):
    items, _, _ = worklog.create(*_empty_log(spark), _new_items(spark, d))
    return items.select("item", "title", "kind", "created_at", "current_status")


@query("worklog_refused", f"+ {NEW} SELECT item, title, reason FROM j WHERE reason IS NOT NULL")
def worklog_refused(spark, d):
    return worklog.create(*_empty_log(spark), _new_items(spark, d))[2]


def _items(spark, d):
    """One item per user, with the kind of its first event's area."""
    events = read(spark, d, "events")
    return events.groupBy(F.col("user_id").alias("item")).agg(
        F.min("ts").alias("created_at"),
        F.concat(F.lit("Item "), F.first("user_id").cast("string")).alias("title"),
        F.when(F.max("value") > 100, "large").otherwise("small").alias("area"),
        F.when(F.count(F.lit(1)) > 60, "bug").otherwise("task").alias("kind"),
        F.lit("pending").alias("current_status"),
        F.min("ts").alias("current_status_at"),
    )


ITEMS = "it AS (SELECT user_id AS item, min(ts) AS created_at, CASE WHEN max(value) > 100 THEN 'large' ELSE 'small' END AS area, CASE WHEN count(*) > 60 THEN 'bug' ELSE 'task' END AS kind FROM events GROUP BY user_id)"


@query("worklog_set_status", f"{LOG}, {ITEMS}, l AS (SELECT item, arg_max(status, (tm, status)) AS status, max(tm) AS tm FROM st GROUP BY item) SELECT it.item, coalesce(l.status, 'pending') AS current_status, coalesce(l.tm, created_at) AS current_status_at FROM it LEFT JOIN l ON l.item = it.item")
def worklog_set_status(spark, d):
    statuses, _ = _log(spark, d)
    shown, _ = worklog.set_status(_items(spark, d), statuses.limit(0), statuses)
    return shown.select("item", "current_status", "current_status_at")


@query("worklog_comment", f"{LOG}, l AS (SELECT item, arg_max(status, (tm, status)) AS status, max(tm) AS tm FROM st GROUP BY item) SELECT co.item, comment_id, status, l.tm AS status_at FROM co JOIN l ON l.item = co.item")
def worklog_comment(spark, d):
    statuses, comments = _log(spark, d)
    return worklog.comment(statuses, comments).select("item", "comment_id", "status", "status_at")


@query("worklog_list", f"""{LOG}, {ITEMS}, l AS (SELECT item, arg_max(status, (tm, status)) AS status, max(tm) AS status_at FROM st GROUP BY item),
c AS (SELECT item, count(*) AS comments, max(tm) AS said FROM co GROUP BY item)
SELECT it.item, area, kind, status, status_at, coalesce(comments, 0) AS comments, greatest(status_at, said) AS last_activity FROM it JOIN l ON l.item = it.item LEFT JOIN c ON c.item = it.item
WHERE area = 'large' AND status = 'done' ORDER BY status_at DESC, it.item LIMIT 100""")
def worklog_list(spark, d):
    return worklog.listed(_items(spark, d), *_log(spark, d), area="large", status="done").select("item", "area", "kind", "status", "status_at", "comments", "last_activity")


@query("worklog_report", f"""{LOG}, {ITEMS}, s AS (SELECT item, status, tm, row_number() OVER (PARTITION BY item ORDER BY tm, status) AS n FROM st),
u AS (SELECT co.*, (SELECT max(n) FROM s WHERE s.item = co.item AND s.tm <= co.tm) AS n FROM co),
c AS (SELECT item, n, string_agg(comment_id, ',' ORDER BY tm, comment_id) AS said FROM u GROUP BY item, n),
t AS (SELECT item, string_agg(status || '@' || epoch_us(tm) || ':' || coalesce(said, ''), ';' ORDER BY n) AS timeline FROM s LEFT JOIN c USING (item, n) GROUP BY item)
SELECT it.item, created_at, timeline FROM it LEFT JOIN t ON t.item = it.item""")
def worklog_report(spark, d):
    rows = worklog.report(_items(spark, d), *_log(spark, d))
    said = lambda e: F.array_join(F.transform(e["comments"], lambda c: c["comment_id"].cast("string")), ",")
    entry = lambda e: F.concat(e["status"], F.lit("@"), F.unix_micros(e["at"].cast("timestamp")).cast("string"), F.lit(":"), said(e))
    return rows.select("item", "created_at", F.array_join(F.transform("timeline", entry), ";").alias("timeline"))


@query("fnv_hashes", """WITH b AS (SELECT p_partkey, p_name, list_transform(range(strlen(p_name)), lambda i: ('0x' || substr(hex(encode(p_name)), 2 * i + 1, 2))::BIGINT::HUGEINT) AS b FROM part),
h AS (SELECT p_partkey, list_reduce(list_prepend(14695981039346656037::HUGEINT, b), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM b)
SELECT p_partkey, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT AS hash FROM h""", ctes="")
def fnv_hashes(spark, d):
    return read(spark, d, "part").select("p_partkey", scalars.fnv1a_64(F.col("p_name")).alias("hash"))


@query("wipe_outgoing", "SELECT src, dst FROM calls WHERE src NOT IN (SELECT id FROM fn WHERE kind = 'Brand#11')")
def wipe_outgoing(spark, d):
    g = project(spark, d)
    return incremental.wipe_outgoing(g.edges("CALLS"), g.nodes("Function").where("kind = 'Brand#11'")).select("src", "dst")


#: Suppliers in debt are the deleted files of the next queries, rich ones the changed files.
WIPE = """kept AS (SELECT f.src AS id FROM defined_in f JOIN supplier ON f.dst = 'file::' || s_suppkey WHERE s_acctbal BETWEEN 0 AND 9000),
keptfile AS (SELECT 'file::' || s_suppkey AS id FROM supplier WHERE s_acctbal >= 0)"""


def _wiped(spark, d):
    g = project(spark, d)
    supplier = read(spark, d, "supplier").select(F.col("s_name").alias("path"), "s_acctbal")
    files = g.nodes("File").select("node_id", "labels", "path")
    placed = g.edges("DEFINED_IN").join(files.select(F.col("node_id").alias("dst"), "path"), "dst").select(F.col("src").alias("node_id"), F.array(F.lit("Function")).alias("labels"), "path")
    return incremental.wipe_paths(files.unionByName(placed), g.edges("DEFINED_IN"), supplier.where("s_acctbal > 9000").select("path"), supplier.where("s_acctbal < 0").select("path"))


@query("wipe_paths_nodes", f"+ {WIPE} SELECT id AS node_id FROM kept UNION ALL SELECT id FROM keptfile")
def wipe_paths_nodes(spark, d):
    return _wiped(spark, d)[0].select("node_id")


@query("wipe_paths_edges", f"+ {WIPE} SELECT src, dst FROM defined_in WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM keptfile)")
def wipe_paths_edges(spark, d):
    return _wiped(spark, d)[1].select("src", "dst")


@query("wipe_documents", "SELECT source || '#' || doc_id AS qualified_name FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY source HAVING count(*) > (SELECT count(*) / count(DISTINCT source) FROM documents))", ctes="")
def wipe_documents(spark, d):
    docs = read(spark, d, "documents")
    sections = docs.select(F.concat_ws("#", "source", F.col("doc_id").cast("string")).alias("qualified_name"))
    mean = docs.agg((F.count(F.lit(1)) / F.countDistinct("source")).alias("mean"))
    large = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(mean)).where("n > mean").select(F.col("source").alias("path"))
    return incremental.wipe_documents(sections, large)


def _noted(spark, d):
    """Notes on files and functions of the graph, by natural key; every function of a brand is gone by now."""
    g = project(spark, d)
    nodes = g.nodes("File").select("node_id", "labels", "path", F.lit(None).cast("string").alias("qualified_name"), "name").unionByName(g.nodes("Function").select("node_id", F.lit(None).cast("string").alias("path"), "qualified_name", "name", F.array(F.lit("Function")).alias("labels")))
    line = read(spark, d, "lineitem")
    note = F.concat(F.lit("note::"), F.col("l_orderkey").cast("string")).alias("src")
    edges = line.select(note, F.concat(F.lit("file::"), F.col("l_suppkey").cast("string")).alias("dst")).unionByName(line.select(note, F.concat(F.lit("part::"), F.col("l_partkey").cast("string")).alias("dst")))
    notes = edges.select(F.col("src").alias("node_id")).distinct()
    there = nodes.join(g.nodes("Function").where("kind = 'Brand#11'").select("node_id"), "node_id", "left_anti")
    there = there.where("path is null or path <> 'Supplier#000000001'")
    return incremental.reattach_notes(incremental.note_addresses(notes, edges, nodes), there)


NOTED = """p AS (SELECT l_orderkey AS k, 'file::' || l_suppkey AS dst, l_suppkey = 1 AS gone FROM lineitem UNION SELECT l_orderkey, 'part::' || l_partkey, p_brand = 'Brand#11' FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("notes_reattached", f"+ {NOTED} SELECT 'note::' || k AS src, dst FROM p WHERE NOT gone")
def notes_reattached(spark, d):
    return _noted(spark, d)[0]


@query("notes_orphaned", f"+ {NOTED} SELECT 'note::' || k AS note FROM p GROUP BY k HAVING bool_and(gone)")
def notes_orphaned(spark, d):
    return _noted(spark, d)[1]


@query("overlay_parents", "SELECT src, dst FROM parent_of UNION ALL SELECT 'commit::10', 'WORKING-TREE'")
def overlay_parents(spark, d):
    g = project(spark, d)
    dirty = read(spark, d, "supplier").select(F.col("s_name").alias("path"))
    shown = spark.createDataFrame([("commit::10", "workspace"), ("commit::9", "workspace")], "src string, dst string")
    commits = g.nodes("GitCommit").select("hash", "message", "timestamp")
    return incremental.overlay(commits, g.edges("PARENT_OF").select("src", "dst"), shown, "commit::10", dirty, F.current_timestamp())[1]


@query("overlay_commits", "SELECT o_orderkey::VARCHAR AS hash, o_orderpriority AS message FROM orders UNION ALL SELECT 'WORKING-TREE', 'uncommitted changes'", ctes="")
def overlay_commits(spark, d):
    g = project(spark, d)
    dirty = read(spark, d, "supplier").select(F.col("s_name").alias("path"))
    shown = spark.createDataFrame([("commit::10", "workspace")], "src string, dst string")
    commits = g.nodes("GitCommit").select("hash", "message", "timestamp")
    return incremental.overlay(commits, g.edges("PARENT_OF").select("src", "dst"), shown, "commit::10", dirty, F.current_timestamp())[0].select("hash", "message")


@query("step_promotion", "SELECT id AS node_id, CASE WHEN is_test THEN 'Step' ELSE kind END AS kind, CASE WHEN is_test THEN 'Given' END AS step_kind FROM fn")
def step_promotion(spark, d):
    fn = project(spark, d).nodes("Function").select("node_id", F.col("qualified_name").alias("name"), "kind", "is_test", F.when(F.col("is_test"), "a/tests/x.rs").otherwise("a/src/x.rs").alias("path"))
    marks = fn.select("path", "name", F.explode(F.array(F.lit("Given"), F.lit("When"))).alias("step_kind")).withColumn("step_regex", F.lit("^x$"))
    return incremental.promote_steps(fn.drop("is_test"), marks).select("node_id", "kind", "step_kind")


@query("link_resolution", """SELECT doc_path, href, path FROM (SELECT 'docs/' || page_id || '.md' AS doc_path, unnest(['../' || page_id || '.rs', './a/../' || page_id || '.md#x', '../../' || page_id || '.rs', 'https://x/' || page_id, '#top']) AS href,
 unnest([page_id || '.rs', 'docs/' || page_id || '.md', NULL, NULL, NULL]) AS path FROM pages) WHERE path IS NOT NULL""", ctes="")
def link_resolution(spark, d):
    pages = read(spark, d, "pages").select(F.col("page_id").cast("string").alias("p"))
    text = lambda *x: F.concat(*[F.lit(a) if a != "p" else F.col("p") for a in x])
    doc = text("docs/", "p", ".md")
    links = pages.select(doc.alias("doc_path"), F.explode(F.array(text("../", "p", ".rs"), text("./a/../", "p", ".md#x"), text("../../", "p", ".rs"), text("https://x/", "p"), F.lit("#top"))).alias("href"))
    return incremental.resolve_links(links, pages.select(F.explode(F.array(text("p", ".rs"), doc)).alias("path")))


def _files(spark, d):
    docs = read(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    packages = read(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("path")).distinct()
    return incremental.file_records(docs, packages.select(F.concat(F.lit("pkg-"), F.col("path")).alias("name"), "path"))


FILES = "f AS (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.md' AS path, coalesce(source, 'none') AS source, doc_id, coalesce(text, '') AS text FROM documents)"


@query("file_records", f"WITH {FILES} SELECT path, doc_id || '.md' AS name, 'md' AS extension, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END::INT AS lines FROM f", ctes="")
def file_records(spark, d):
    return _files(spark, d)[0].select("path", "name", "extension", "lines")


@query("package_files", f"WITH {FILES} SELECT 'pkg-' || source AS src, path AS dst FROM f", ctes="")
def package_files(spark, d):
    return _files(spark, d)[1]


@query("watch_and_unwatch", "SELECT id AS node_id, CASE WHEN kind = 'Brand#11' AND NOT is_test THEN name END AS watch_baseline_body, kind = 'Brand#11' AND NOT is_test AS watched FROM fn")
def watch_and_unwatch(spark, d):
    fn = project(spark, d).nodes("Function")
    watched = incremental.watch(fn, fn.where("kind = 'Brand#11'"), "name", "commit::10", "2024")
    left = incremental.unwatch(watched, fn.where("is_test"))
    return left.select("node_id", "watch_baseline_body", F.array_contains("labels", "Watch").alias("watched"))


@query("view_registry", "SELECT * FROM (VALUES ('first', 'd2', '2000', NULL::VARCHAR), ('other', 'd3', '2002', NULL::VARCHAR)) AS v(name, description, created_at, last_run_at)", ctes="")
def view_registry(spark, d):
    views = spark.createDataFrame([], "name string, text string, description string, created_at string, updated_at string, last_run_at string")
    views = annotations.save_view(views, "first", "SELECT 1", "2000", "d1")
    views = annotations.save_view(views, "first", "SELECT 2", "2001", "d2")
    return annotations.list_views(annotations.save_view(views, "other", "SELECT 3", "2002", "d3"))


@query("notes_from_comments", """+ named AS (SELECT src AS c, dst AS token FROM calls), hit AS (SELECT c, id FROM named JOIN fn ON token = id)
SELECT DISTINCT 'note-2000-' || c AS src, id AS dst FROM hit""")
def notes_from_comments(spark, d):
    g = project(spark, d)
    body = F.concat(F.lit("see "), F.array_join(F.transform(F.array_sort(F.collect_set("dst")), lambda x: F.concat(F.lit("`"), x, F.lit("()`"))), " and "))
    said = g.edges("CALLS").groupBy(F.col("src").alias("comment")).agg(body.alias("body"))
    return annotations.notes_from_comments(said, g.nodes("Function"), "2000")[1]


@query("index_status", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("customer", "documents", "orders", "part", "supplier")), ctes="")
def index_status(spark, d):
    return incremental.index_status({t: read(spark, d, t) for t in ("customer", "documents", "orders", "part", "supplier")})


@query("text_scalars", """SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 39) || '…' ELSE text END AS short,
 '''' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '''', '\\'''), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '''' AS quoted FROM documents""", ctes="")
def text_scalars(spark, d):
    return read(spark, d, "documents").select("doc_id", scalars.truncated(F.col("text"), 40).alias("short"), scalars.escaped(F.col("text")).alias("quoted"))


@query("note_targets", "SELECT id AS node_id FROM fn WHERE is_test AND line_start > 25")
def note_targets(spark, d):
    return annotations.targets(project(spark, d), "MATCH (t:Test) WHERE t.line_start > $least", least=25)


@query("exposed_endpoints", "SELECT DISTINCT n_name AS package, 'r' || n_regionkey || '/' || n_nationkey || '/api.json' AS path, '/' || s_suppkey AS route, 'get' AS method FROM supplier JOIN nation ON s_nationkey = n_nationkey", ctes="")
def exposed_endpoints(spark, d):
    nation = read(spark, d, "nation")
    folder = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_nationkey").cast("string"))
    routes = read(spark, d, "supplier").join(nation.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    routes = routes.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("s_nationkey").cast("string"), F.lit("/api.json")).alias("path"), F.concat(F.lit("/"), F.col("s_suppkey").cast("string")).alias("route"), F.lit("get").alias("method"))
    return linkers.exposes(routes, nation.select(F.col("n_name").alias("name"), folder.alias("path")))


@query("first_labels", "SELECT label, count(*) AS n FROM (SELECT 'Function' AS label FROM part UNION ALL SELECT 'File' FROM supplier UNION ALL SELECT 'Package' FROM nation UNION ALL SELECT 'Workspace' FROM region UNION ALL SELECT 'GitCommit' FROM orders UNION ALL SELECT 'Author' FROM customer UNION ALL SELECT 'DocSection' FROM documents UNION ALL SELECT 'Note' FROM labels) GROUP BY label", ctes="")
def first_labels(spark, d):
    return project(spark, d).nodes().groupBy(scalars.first_label(F.col("labels")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
