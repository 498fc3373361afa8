"""Registered queries over single operators: what other queries leave out of an operator's result, and small extractors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import annotations, incremental, linkers, mutate, reports, worklog
from ..sources import code, documents
from .projection import project, read
from .queries import LOG, _log, query, seed
from .upkeep_queries import ITEMS, _items


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("dead_code_listed", """SELECT id AS qualified_name, s_name AS path, line_start FROM fn LEFT JOIN defined_in ON src = id LEFT JOIN supplier ON dst = 'file::' || s_suppkey
WHERE NOT is_test AND kind = 'Brand#12' AND NOT contains(lower(name), 'red') AND id NOT IN (SELECT dst FROM calls) ORDER BY s_name NULLS FIRST, line_start, id LIMIT 20""")
def dead_code_listed(spark, d):
    return reports.dead_code_listed(project(spark, d), 20, kind="Brand#12", name_skip="RED").select("qualified_name", "path", "line_start")


@query("diff_report", """SELECT o_orderkey::VARCHAR AS hash, o_orderdate AS timestamp, c_name AS author FROM orders LEFT JOIN customer ON c_custkey = o_custkey
WHERE o_orderdate > (SELECT o_orderdate FROM orders WHERE o_orderkey = 10) AND o_orderdate <= (SELECT max(o_orderdate) FROM orders)""", ctes="")
def diff_report(spark, d):
    g = project(spark, d)
    newest = g.nodes("GitCommit").agg(F.max(F.struct("timestamp", "node_id")).alias("x")).select(F.col("x.node_id").alias("src"), F.lit("workspace").alias("dst"))
    return reports.diff_report(g, "10", newest)


@query("concept_dossier", """+ m AS (SELECT id AS node_id FROM fn WHERE kind = 'Brand#11' UNION ALL SELECT 'doc::' || doc_id FROM documents WHERE lang = 'fr'),
s AS (SELECT node_id FROM m WHERE node_id IN (SELECT id FROM fn) UNION SELECT dst FROM mentions WHERE src IN (SELECT node_id FROM m) AND dst IN (SELECT id FROM fn)),
n AS (SELECT src, dst FROM notes WHERE dst IN (SELECT node_id FROM s UNION SELECT node_id FROM m) ORDER BY src DESC, dst LIMIT 25)
SELECT 'member' AS part, node_id, NULL AS "on" FROM m UNION ALL SELECT 'function', node_id, NULL FROM s UNION ALL SELECT 'test', src, dst FROM tests WHERE dst IN (SELECT node_id FROM s) UNION ALL SELECT 'note', src, dst FROM n""")
def concept_dossier(spark, d):
    g = project(spark, d)
    members = g.nodes("Function").where("kind = 'Brand#11'").select("node_id").unionByName(g.nodes("DocSection").where("kind = 'fr'").select("node_id"))
    return reports.concept_dossier(g, members)


@query("node_properties", """+ p AS (SELECT id AS node_id, CASE WHEN is_test THEN 'Function,Test' ELSE 'Function' END AS labels, unnest(['qualified_name', 'name', 'kind', 'line_start', 'is_test', 'key']) AS property,
 unnest([id, name, kind, line_start::VARCHAR, is_test::VARCHAR, p_partkey::VARCHAR]) AS value FROM fn WHERE id IN (SELECT id FROM seed UNION SELECT dst FROM calls WHERE src IN (SELECT id FROM seed)))
SELECT * FROM p WHERE value IS NOT NULL""")
def node_properties(spark, d):
    g = project(spark, d)
    start = seed(g)
    near = reports.P.at_nodes(g.edges("CALLS"), "src", start).select(F.col("dst").alias("node_id"))
    return reports.node_properties(g, "Function", start.unionByName(near))


@query("detach_delete_nodes", "SELECT id AS node_id FROM fn WHERE NOT is_test")
def detach_delete_nodes(spark, d):
    g = project(spark, d)
    return mutate.detach_delete(g.nodes("Function"), g.edges("CALLS"), g.nodes("Function", "Test"))[0].select("node_id")


@query("call_snapshot_again", "SELECT id AS qualified_name FROM fn WHERE line_start % 2 = 1 OR id NOT IN (SELECT src FROM calls)")
def call_snapshot_again(spark, d):
    g = project(spark, d)
    fn = g.nodes("Function").select("qualified_name", "line_start")
    before = g.edges("CALLS").groupBy(F.col("src").alias("qualified_name")).agg(F.collect_list("dst").alias("callees")).join(fn, "qualified_name").withColumnRenamed("line_start", "body_hash")
    now = fn.select("qualified_name", (F.col("line_start") + F.col("line_start") % 2).alias("body_hash"))
    return linkers.replay_calls(before, now)[1].select("qualified_name")


@query("overlay_snapshots", "SELECT 'WORKING-TREE' AS src, 'workspace::' || r_regionkey AS dst FROM region", ctes="")
def overlay_snapshots(spark, d):
    g = project(spark, d)
    shown = g.nodes("Workspace").select(F.explode(F.array(F.lit("commit::10"), F.lit("commit::9"))).alias("src"), F.col("node_id").alias("dst"))
    dirty = read(spark, d, "supplier").select(F.col("s_name").alias("path"))
    commits = g.nodes("GitCommit").select("hash", "message", "timestamp")
    return incremental.overlay(commits, g.edges("PARENT_OF").select("src", "dst"), shown, "commit::10", dirty, F.current_timestamp())[2]


@query("worklog_statuses", f"{LOG} SELECT item, status, tm AS \"at\" FROM st")
def worklog_statuses(spark, d):
    statuses, _ = _log(spark, d)
    return worklog.set_status(_items(spark, d), statuses.limit(0), statuses)[1].select("item", "status", "at")


@query("roadmap_areas", f"{LOG}, {ITEMS}, l AS (SELECT item, arg_max(status, (tm, status)) AS status, max(tm) AS status_at FROM st GROUP BY item) SELECT l.item, area, status, status_at, CASE status WHEN 'in_progress' THEN 0 WHEN 'pending' THEN 1 WHEN 'blocked' THEN 2 ELSE 3 END AS turn FROM l JOIN it ON it.item = l.item")
def roadmap_areas(spark, d):
    current = worklog.latest_status(_log(spark, d)[0]).join(_items(spark, d).select("item", "area"), "item")
    return worklog.roadmap(current).select("item", "area", "status", "status_at", "turn")


ALL = ("customer", "documents", "embeddings", "events", "benchmark", "conversations", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query("index_status_all", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ALL), ctes="")
def index_status_all(spark, d):
    return incremental.index_status({t: read(spark, d, t) for t in ALL})


@query("notes_of_comments", "+ c AS (SELECT src, list_sort(list(dst)) AS l FROM calls GROUP BY src) SELECT 'note-2000-' || src AS node_id, '2000' AS created_at, 'see `' || array_to_string(l, '()` and `') || '()`' AS markdown FROM c")
def notes_of_comments(spark, d):
    g = project(spark, d)
    body = F.concat(F.lit("see "), F.array_join(F.transform(F.array_sort(F.collect_set("dst")), lambda x: F.concat(F.lit("`"), x, F.lit("()`"))), " and "))
    said = g.edges("CALLS").groupBy(F.col("src").alias("comment")).agg(body.alias("body"))
    return annotations.notes_from_comments(said, g.nodes("Function"), "2000")[0]


@query("note_written", "SELECT id AS dst, 'T' AS title, 'me' AS author, 'a,b' AS tags, 'body' AS markdown FROM fn WHERE is_test")
def note_written(spark, d):
    note, edges = annotations.write_note(project(spark, d).nodes("Function", "Test").select("node_id"), "body", "2000", "T", "me", "a,b")
    return edges.join(note, edges["src"] == note["node_id"]).select("dst", "title", "author", "tags", "markdown")


@query("concept_defined", "SELECT 'Core' AS name, 'second' AS description, '2000' AS created_at, '2001' AS updated_at, count(*) AS members FROM fn WHERE is_test OR kind = 'Brand#11'")
def concept_defined(spark, d):
    fn = project(spark, d).nodes("Function")
    none = spark.createDataFrame([], "name string, description string, created_at string, updated_at string"), spark.createDataFrame([], "src string, dst string")
    first = annotations.define_concept(*none, "Core", fn.where("is_test"), "2000", "first")
    concepts, edges = annotations.define_concept(*first, "Core", fn.where("kind = 'Brand#11'"), "2001", "second")
    return concepts.join(edges.groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("members")), "name")


def _sources(spark, d):
    """One schema of each kind per nation."""
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("i"))
    i = F.col("i")
    gql = _text("type T", i, " {\n x: Int\n}\nenum E", i, " { A }\n  type No {}\nunion U = A\ninput I", i, " {}")
    proto = _text("service S", i, " {\n  rpc Get", i, "(A) returns (B);\n}\nmessage M", i, " {\n enum K { X = 0; }\n}")
    rust = _text('#[given(regex = r"^n', i, ' (\\d+)$")]\nasync fn g', i, '() {}\n#[when("b")]\n#[allow(x)]\npub fn w', i, "() {}\nmod m {\n    #[then(\"no\")]\n    fn t() {}\n}\n")
    said = _text('[{"author": "a', i, '", "body": "b", "url": null}, {"body": "d', i, '"}]')
    return n.select(_text("n/", i).alias("path"), gql.alias("gql"), proto.alias("proto"), rust.alias("rust"), said.alias("said"))


def _of(spark, d, name):
    return _sources(spark, d).select("path", F.col(name).alias("text"))


@query("graphql_types", "SELECT 'n/' || n_nationkey AS path, unnest(['type', 'enum', 'union', 'input']) AS kind, unnest(['T' || n_nationkey, 'E' || n_nationkey, 'U', 'I' || n_nationkey]) AS name FROM nation", ctes="")
def graphql_types(spark, d):
    return documents.graphql_types(_of(spark, d, "gql"))


@query("proto_items", "SELECT 'n/' || n_nationkey AS path, unnest(['service', 'rpc', 'message', 'enum']) AS kind, unnest(['S' || n_nationkey, 'Get' || n_nationkey, 'M' || n_nationkey, 'K']) AS name FROM nation", ctes="")
def proto_items(spark, d):
    return documents.proto_items(_of(spark, d, "proto"))


@query("step_attributes", r"SELECT 'n/' || n_nationkey AS path, unnest(['Given', 'When']) AS kind, unnest(['^n' || n_nationkey || ' (\d+)$', 'b']) AS pattern, unnest(['g' || n_nationkey, 'w' || n_nationkey]) AS function FROM nation", ctes="")
def step_attributes(spark, d):
    return documents.step_patterns(_of(spark, d, "rust"))


@query("review_comments", "SELECT 'n/' || n_nationkey AS path, unnest([0, 1]) AS comment, unnest(['a' || n_nationkey, NULL]) AS author, unnest(['b', 'd' || n_nationkey]) AS body, NULL::VARCHAR AS url FROM nation", ctes="")
def review_comments(spark, d):
    return documents.review_comments(_of(spark, d, "said"))


@query("markdown_cells", """SELECT doc_id, coalesce(regexp_replace(replace(text, '|', '\\|'), '[\\r\\n\\t]', ' ', 'g'), '—') AS cell,
 CASE WHEN length(source) > 4 THEN '…' || right(source, 3) ELSE source END AS short FROM documents""", ctes="")
def markdown_cells(spark, d):
    return read(spark, d, "documents").select("doc_id", scalars.markdown_cell(F.col("text")).alias("cell"), scalars.shortened(F.col("source"), 4).alias("short"))


@query("recovered_json", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"a": ' || props || '}' END AS json FROM events""", ctes="")
def recovered_json(spark, d):
    turn, props = F.col("event_id") % 3, F.col("props")
    reply = F.when(turn == 0, _text("Sure:\n```json\n", props, "\n```\n{not this}")).when(turn == 1, _text("It is {\"a\": ", props, "} then")).otherwise("no json")
    return read(spark, d, "events").select("event_id", scalars.recovered_json(reply).alias("json"))


@query("walked_files", """WITH p AS (SELECT 'n' || page_id || unnest(['/src/a.rs', '/target/a.rs', '/.git/b.py', '/node_modules/c.js', '/d.py']) AS path FROM pages) SELECT path FROM p WHERE NOT regexp_matches(path, '/(target|\\.git|node_modules)/')""", ctes="")
def walked_files(spark, d):
    pages = read(spark, d, "pages").select(F.explode(F.array(*map(F.lit, ("/src/a.rs", "/target/a.rs", "/.git/b.py", "/node_modules/c.js", "/d.py")))).alias("end"), F.col("page_id").cast("string").alias("i"))
    return code.source_files(pages.select(_text("n", F.col("i"), F.col("end")).alias("path"), F.lit("x").alias("text"))).select("path")
