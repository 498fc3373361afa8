"""The registered queries over the projected graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import annotations, bdd, linkers, mutate, reports, worklog
from ..session import spread
from . import pattern as P
from .projection import project, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

GRAPH = """
fn AS (SELECT 'part::' || p_partkey AS id, p_name AS name, p_brand AS kind, p_size AS line_start, p_type = 'PROMO' AS is_test, p_partkey FROM part),
calls AS (SELECT DISTINCT 'part::' || a.l_partkey AS src, 'part::' || b.l_partkey AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 35 AND b.l_quantity >= 35 AND a.l_partkey <> b.l_partkey),
tests AS (SELECT src, dst FROM calls JOIN fn a ON a.id = src JOIN fn b ON b.id = dst WHERE a.is_test AND NOT b.is_test),
defined_in AS (SELECT 'part::' || l_partkey AS src, 'file::' || min(l_suppkey) AS dst FROM lineitem GROUP BY l_partkey),
contains_ AS (SELECT 'package::' || s_nationkey AS src, 'file::' || s_suppkey AS dst FROM supplier),
holds AS (SELECT 'workspace::' || n_regionkey AS src, 'package::' || n_nationkey AS dst FROM nation),
supplied AS (SELECT 'file::' || l_suppkey AS src, 'part::' || l_partkey AS dst FROM lineitem),
authored AS (SELECT 'author::' || o_custkey AS src, 'commit::' || o_orderkey AS dst FROM orders),
parent_of AS (SELECT * FROM (SELECT 'commit::' || o_orderkey AS src, 'commit::' || lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL),
notes AS (SELECT 'note::' || doc_id AS src, 'doc::' || doc_id AS dst FROM labels),
mentions AS (SELECT 'doc::' || doc_id AS src, 'part::' || (item_id + 1) AS dst FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
seed AS (SELECT src AS id FROM calls GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)
"""
ALL_EDGES = "(" + " UNION ALL ".join(f"SELECT src, dst, '{t}' AS type FROM {t.lower() if t != 'CONTAINS' else 'contains_'}" for t in ("CALLS", "TESTS", "DEFINED_IN", "SUPPLIED", "CONTAINS", "HOLDS", "AUTHORED", "PARENT_OF", "NOTES", "MENTIONS")) + ")"


def query(name: str, sql: str | None = None, ctes: str = GRAPH):
    """Register a query and its SQL (which may use the graph's common table expressions)."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH RECURSIVE {ctes.strip()}{',' if sql.lstrip().startswith('+') else ''}\n{sql.strip().removeprefix('+')}" if ctes else sql
        return f

    return add


def seed(g) -> DataFrame:
    """The function with the most callees; the smaller id wins a tie."""
    return g.edges("CALLS").groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.col("src").alias("node_id"))


@query("schema_labels", """SELECT * FROM (SELECT 'Function' AS label, count(*) AS n FROM part UNION ALL SELECT 'Test', count(*) FROM fn WHERE is_test UNION ALL SELECT 'File', count(*) FROM supplier
 UNION ALL SELECT 'Package', count(*) FROM nation UNION ALL SELECT 'Workspace', count(*) FROM region UNION ALL SELECT 'GitCommit', count(*) FROM orders
 UNION ALL SELECT 'Author', count(*) FROM customer UNION ALL SELECT 'DocSection', count(*) FROM documents UNION ALL SELECT 'Note', count(*) FROM labels)""")
def schema_labels(spark: SparkSession, d: str) -> DataFrame:
    return reports.schema_labels(project(spark, d))


@query("schema_edge_types", f"SELECT type, count(*) AS n FROM {ALL_EDGES} GROUP BY type")
def schema_edge_types(spark, d):
    return reports.schema_edge_types(project(spark, d))


@query("node_lookup", "SELECT id AS qualified_name, name, kind, line_start FROM fn WHERE id = 'part::12'")
def node_lookup(spark, d):
    return project(spark, d).nodes("Function").where("qualified_name = 'part::12'").select("qualified_name", "name", "kind", "line_start")


@query("label_intersection", "SELECT id AS node_id FROM fn WHERE is_test AND kind = 'Brand#11'")
def label_intersection(spark, d):
    return project(spark, d).nodes("Function", "Test").where("kind = 'Brand#11'").select("node_id")


@query("expand_out", "SELECT src, dst, name FROM calls JOIN fn ON dst = id WHERE kind = 'Brand#11'")
def expand_out(spark, d):
    g = project(spark, d)
    named = g.nodes("Function").where("kind = 'Brand#11'").select(F.col("node_id").alias("dst"), "name")
    return g.edges("CALLS").drop("type").join(named, "dst").select("src", "dst", "name")


@query("expand_in", "SELECT c.src AS caller, t.src AS test, c.dst AS callee FROM calls c JOIN tests t ON c.dst = t.dst WHERE c.src <> t.src")
def expand_in(spark, d):
    g = project(spark, d)
    rows = P.expand(g.edges("CALLS").select(F.col("src").alias("caller"), F.col("dst").alias("callee")), "callee", g.edges("TESTS").drop("type"), "test", "in")
    return rows.where("caller <> test").select("caller", "test", "callee")


@query("expand_any", "SELECT a AS node_id, count(*) AS n, count(DISTINCT b) AS neighbours FROM (SELECT src AS a, dst AS b FROM calls UNION ALL SELECT dst, src FROM calls WHERE src <> dst) GROUP BY a")
def expand_any(spark, d):
    both = P.both_ways(project(spark, d).edges("CALLS"))
    return both.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("neighbours"))


@query("chain_documented_packages", "SELECT DISTINCT c.src AS package, m.src AS doc FROM contains_ c JOIN defined_in f ON f.dst = c.dst JOIN mentions m ON m.dst = f.src")
def chain_documented_packages(spark, d):
    g = project(spark, d)
    rows = P.expand(g.edges("CONTAINS").select(F.col("src").alias("package"), F.col("dst").alias("file")), "file", g.edges("DEFINED_IN").drop("type"), "function", "in")
    return P.expand(rows, "function", g.edges("MENTIONS").drop("type"), "doc", "in").select("package", "doc").distinct()


@query("conjunctive_pattern", "SELECT a.src AS a, a.dst AS b, b.dst AS c FROM calls a JOIN calls b ON a.dst = b.src JOIN calls c ON c.src = a.src AND c.dst = b.dst WHERE a.src <> b.src")
def conjunctive_pattern(spark, d):
    calls = project(spark, d).edges("CALLS").drop("type")
    ab, bc, ac = (calls.select(F.col("src").alias(x), F.col("dst").alias(y)) for x, y in ("ab", "bc", "ac"))
    return ab.join(bc, "b").join(ac, ["a", "c"]).where("a <> b").select("a", "b", "c")


@query("optional_match", "SELECT f.id AS node_id, t.src AS test FROM fn f LEFT JOIN tests t ON t.dst = f.id WHERE f.kind = 'Brand#12'")
def optional_match(spark, d):
    g = project(spark, d)
    return P.expand(g.nodes("Function").where("kind = 'Brand#12'").select("node_id"), "node_id", g.edges("TESTS").drop("type"), "test", "in", optional=True)


@query("anti_pattern", "SELECT id AS node_id FROM fn WHERE NOT EXISTS (SELECT 1 FROM calls WHERE dst = id)")
def anti_pattern(spark, d):
    g = project(spark, d)
    return P.where_missing(g.nodes("Function").select("node_id"), "node_id", g.edges("CALLS"), "dst")


@query("semi_pattern", "SELECT id AS node_id FROM fn WHERE EXISTS (SELECT 1 FROM tests WHERE dst = id)")
def semi_pattern(spark, d):
    g = project(spark, d)
    return P.where_exists(g.nodes("Function").select("node_id"), "node_id", g.edges("TESTS"), "dst")


@query("count_subquery", "SELECT id AS node_id, (SELECT count(*) FROM calls WHERE src = id) AS callees FROM fn")
def count_subquery(spark, d):
    g = project(spark, d)
    return P.counted(g.nodes("Function").select("node_id"), "node_id", g.edges("CALLS"), "src", "callees")


@query("filter_string_predicates", "SELECT id AS node_id, name FROM fn WHERE (starts_with(kind, 'Brand#1') OR contains(name, 'red')) AND NOT is_test AND kind <> 'Brand#13'")
def filter_string_predicates(spark, d):
    rows = project(spark, d).nodes("Function")
    return rows.where((F.col("kind").startswith("Brand#1") | F.col("name").contains("red")) & ~F.col("is_test") & (F.col("kind") != "Brand#13")).select("node_id", "name")


@query("in_frontier", "SELECT src, dst FROM calls WHERE src IN (SELECT dst FROM calls WHERE src IN (SELECT id FROM seed))")
def in_frontier(spark, d):
    g = project(spark, d)
    calls = g.edges("CALLS").drop("type")
    first = calls.join(seed(g).select(F.col("node_id").alias("src")), "src", "left_semi")
    return P.where_exists(calls, "src", first, "dst")


@query("group_count_implicit", "SELECT kind, is_test, count(name) AS n FROM fn GROUP BY kind, is_test")
def group_count_implicit(spark, d):
    return project(spark, d).nodes("Function").groupBy("kind", "is_test").agg(F.count("name").alias("n"))


@query("agg_surface", "SELECT kind, count(*) AS n, sum(line_start)::BIGINT AS total, avg(line_start) AS mean, min(line_start) AS low, max(line_start) AS high, count(DISTINCT name) AS names FROM fn GROUP BY kind")
def agg_surface(spark, d):
    x = F.col("line_start")
    return project(spark, d).nodes("Function").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.countDistinct("name").alias("names"))


@query("order_skip_limit", "SELECT id AS node_id, line_start FROM fn ORDER BY line_start DESC, id LIMIT 20 OFFSET 10")
def order_skip_limit(spark, d):
    return project(spark, d).nodes("Function").select("node_id", "line_start").orderBy(*P.ordered("-line_start", "node_id")).offset(10).limit(20)


@query("with_having", "SELECT dst AS node_id, count(*) AS n FROM calls GROUP BY dst HAVING count(*) > 2")
def with_having(spark, d):
    return project(spark, d).edges("CALLS").groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 2")


@query("unwind", "SELECT id AS node_id, unnest(range(1, least(line_start, 5) + 1)) AS x FROM fn")
def unwind(spark, d):
    return project(spark, d).nodes("Function").select("node_id", F.explode(F.expr("sequence(1L, least(line_start, 5))")).alias("x"))


@query("merge_edges", "SELECT src, dst FROM tests UNION SELECT src, dst FROM calls")
def merge_edges(spark, d):
    g = project(spark, d)
    return mutate.merge_rows(g.edges("TESTS").select("src", "dst"), g.edges("CALLS").select("src", "dst"), ["src", "dst"])


@query("set_props", "SELECT id AS node_id, CASE WHEN is_test THEN 'checked' ELSE kind END AS kind FROM fn")
def set_props(spark, d):
    return mutate.set_where(project(spark, d).nodes("Function"), F.col("is_test"), {"kind": F.lit("checked")}).select("node_id", "kind")


@query("detach_delete", "SELECT src, dst FROM calls WHERE src NOT IN (SELECT id FROM fn WHERE is_test) AND dst NOT IN (SELECT id FROM fn WHERE is_test)")
def detach_delete(spark, d):
    g = project(spark, d)
    return mutate.detach_delete(g.nodes("Function"), g.edges("CALLS"), g.nodes("Function", "Test"))[1].select("src", "dst")


@query("degree", f"SELECT a AS node_id, count(*) AS degree FROM (SELECT src AS a FROM {ALL_EDGES} UNION ALL SELECT dst FROM {ALL_EDGES} WHERE src <> dst) GROUP BY a")
def degree(spark, d):
    return reports.degrees(project(spark, d))


@query("node_dossier", f"""+ deg AS (SELECT a, count(*) AS degree FROM (SELECT src AS a FROM {ALL_EDGES} UNION ALL SELECT dst FROM {ALL_EDGES} WHERE src <> dst) GROUP BY a),
near AS (SELECT DISTINCT 'out' AS direction, type, dst AS n FROM {ALL_EDGES} JOIN seed ON src = id UNION SELECT DISTINCT 'in', type, src FROM {ALL_EDGES} JOIN seed ON dst = id),
r AS (SELECT direction, type, n AS node_id, degree, row_number() OVER (PARTITION BY direction, type ORDER BY degree DESC, n)::INT AS rank, count(*) OVER (PARTITION BY direction, type) AS total FROM near JOIN deg ON a = n)
SELECT * FROM r WHERE rank <= 25""")
def node_dossier(spark, d):
    g = project(spark, d)
    return reports.node_dossier(g, seed(g)).select("direction", "type", "node_id", "degree", "rank", "total")


WALK = """+ o(id, d) AS (SELECT id, 0 FROM seed UNION SELECT dst, d + 1 FROM o JOIN calls ON src = o.id WHERE d < 3),
i(id, d) AS (SELECT id, 0 FROM seed UNION SELECT src, d + 1 FROM i JOIN calls ON dst = i.id WHERE d < 3),
imp AS (SELECT 'out' AS direction, id AS node_id, min(d)::INT AS depth FROM o WHERE id NOT IN (SELECT id FROM seed) GROUP BY id UNION ALL
        SELECT 'in', id, min(d)::INT FROM i WHERE id NOT IN (SELECT id FROM seed) GROUP BY id)"""


@query("impact", f"{WALK} SELECT * FROM imp")
def impact(spark, d):
    g = project(spark, d)
    return reports.impact(g, seed(g))


@query("impact_summary", f"""{WALK}, s AS (SELECT (SELECT count(*) FROM imp WHERE direction = 'out') AS callees, (SELECT count(*) FROM imp WHERE direction = 'in') AS callers,
 (SELECT count(*) FROM mentions WHERE dst IN (SELECT id FROM seed)) AS mentions, (SELECT count(*) FROM tests WHERE dst IN (SELECT id FROM seed)) AS tests) SELECT *, callees + callers + mentions + tests AS radius FROM s""")
def impact_summary(spark, d):
    g = project(spark, d)
    return reports.impact_summary(g, seed(g))


EXPLORE = """+ e AS (SELECT * FROM calls UNION ALL SELECT * FROM mentions), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e WHERE src <> dst),
w(id, d) AS (SELECT id, 0 FROM seed UNION SELECT b.dst, d + 1 FROM w JOIN b ON b.src = w.id WHERE d < 2),
x AS (SELECT id, min(d)::INT AS depth FROM w WHERE id NOT IN (SELECT id FROM seed) AND (starts_with(id, 'doc') OR id IN (SELECT id FROM fn)) GROUP BY id),
r AS (SELECT x.id AS node_id, depth, (SELECT count(*) FROM b WHERE b.src = x.id) AS degree, (id IN (SELECT dst FROM notes))::INT AS has_notes, (id IN (SELECT dst FROM mentions))::INT AS has_mentions FROM x),
q AS (SELECT *, degree + 4 * has_notes + 2 * has_mentions - 5 * depth AS score FROM r)"""


@query("explore_ranked", f"{EXPLORE} SELECT * FROM q")
def explore_ranked(spark, d):
    g = project(spark, d)
    return reports.explore(g, seed(g), ("CALLS", "MENTIONS"))


@query("explore_budget", f"{EXPLORE}, l AS (SELECT *, strlen(node_id || ' ' || score) AS bytes FROM q), k AS (SELECT *, coalesce(sum(bytes + 1) OVER (ORDER BY score DESC, depth, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM l) SELECT node_id, score, bytes FROM k WHERE held + bytes + 160 < 500")
def explore_budget(spark, d):
    rows = explore_ranked(spark, d)
    line = F.concat_ws(" ", "node_id", F.col("score").cast("string"))
    return reports.budget_fill(rows, line, [F.desc("score"), F.col("depth"), F.col("node_id")], budget=500).select("node_id", "score", "bytes")


@query("orphan_functions", "SELECT id AS node_id, id AS qualified_name FROM fn WHERE NOT is_test AND id NOT IN (SELECT dst FROM calls)")
def orphan_functions(spark, d):
    return reports.orphan_functions(project(spark, d))


@query("untested_by_fanin", "SELECT id AS node_id, id AS qualified_name, (SELECT count(*) FROM calls WHERE dst = id) AS fan_in FROM fn WHERE NOT is_test AND id NOT IN (SELECT dst FROM tests)")
def untested_by_fanin(spark, d):
    return reports.untested_by_fanin(project(spark, d))


@query("unnoted_sections", "SELECT 'doc::' || doc_id AS node_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unnoted_sections(spark, d):
    return reports.without_edge(project(spark, d), "DocSection", "NOTES")


@query("undocumented_packages", "SELECT DISTINCT n_name AS name FROM nation WHERE 'package::' || n_nationkey NOT IN (SELECT c.src FROM contains_ c JOIN defined_in f ON f.dst = c.dst JOIN mentions m ON m.dst = f.src)")
def undocumented_packages(spark, d):
    return reports.undocumented_packages(project(spark, d))


DEAD = "SELECT id AS node_id, id AS qualified_name, s_name AS path, line_start FROM fn LEFT JOIN defined_in ON src = id LEFT JOIN supplier ON dst = 'file::' || s_suppkey WHERE id NOT IN ({called}) AND NOT is_test"


@query("dead_code", DEAD.format(called="SELECT dst FROM calls"))
def dead_code(spark, d):
    return reports.dead_code(project(spark, d))


@query("dead_code_ignoring_tests", DEAD.format(called="SELECT dst FROM calls JOIN fn ON src = id WHERE NOT is_test"))
def dead_code_ignoring_tests(spark, d):
    return reports.dead_code(project(spark, d), ignore_test_callers=True)


@query("find_symbol", """+ q AS (SELECT id AS qualified_name, name, CASE WHEN lower(name) = 'part::1' OR lower(id) = 'part::1' THEN 0 WHEN starts_with(lower(name), 'part::1') THEN 1 WHEN starts_with(lower(id), 'part::1') THEN 2
 WHEN contains(lower(name), 'part::1') THEN 3 ELSE 4 END AS rank, kind FROM fn WHERE contains(lower(name), 'part::1') OR contains(lower(id), 'part::1') ORDER BY rank, strlen(name), id LIMIT 25)
SELECT q.*, s_name AS path FROM q LEFT JOIN defined_in ON src = qualified_name LEFT JOIN supplier ON dst = 'file::' || s_suppkey""")
def find_symbol(spark, d):
    return reports.find_symbol(project(spark, d), " PART::1 ")


@query("history", "SELECT o_orderkey::VARCHAR AS hash, o_orderdate AS timestamp, o_orderpriority AS message, c_name AS author FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 50")
def history(spark, d):
    return reports.history(project(spark, d))


@query("diff_commits", "SELECT o_orderkey::VARCHAR AS hash, o_orderdate AS timestamp FROM orders WHERE o_orderdate > (SELECT o_orderdate FROM orders WHERE o_orderkey = 10) AND o_orderdate <= (SELECT o_orderdate FROM orders WHERE o_orderkey = 20)")
def diff_commits(spark, d):
    return reports.diff_since(project(spark, d), "10", "20")


@query("commit_lookup", "SELECT o_orderkey::VARCHAR AS hash FROM orders WHERE o_orderkey IN (12, 13)", ctes="")
def commit_lookup(spark, d):
    commits = project(spark, d).nodes("GitCommit").withColumn("short_hash", F.concat(F.lit("s"), "hash"))
    found = [reports.resolve_commit(commits, key) for key in ("12", "s13", "none")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("hash")


@query("diff_dag", """+ a(id) AS (SELECT 'commit::10' UNION SELECT dst FROM a JOIN parent_of ON src = id)
SELECT o_orderkey::VARCHAR AS hash, o_orderdate AS timestamp FROM orders WHERE 'commit::' || o_orderkey IN (SELECT id FROM a WHERE id <> 'commit::10')""")
def diff_dag(spark, d):
    g = project(spark, d)
    # The head is the last commit of the author's chain.
    authored = g.edges("AUTHORED")
    own = P.where_exists(authored, "src", authored.where("dst = 'commit::10'"), "src")
    tips = P.where_missing(own.select(F.col("dst").alias("node_id")), "node_id", g.edges("PARENT_OF"), "src")
    head = P.where_exists(g.nodes("GitCommit"), "node_id", tips, "node_id").first()
    return reports.diff_since(g, "10", head["hash"] if head else "10", "dag")


@query("concept_functions", "SELECT id AS node_id FROM fn WHERE kind = 'Brand#11' UNION SELECT dst FROM mentions m JOIN documents ON src = 'doc::' || doc_id WHERE lang = 'en' AND dst IN (SELECT id FROM fn)")
def concept_functions(spark, d):
    g = project(spark, d)
    members = g.nodes("Function").where("kind = 'Brand#11'").select("node_id").unionByName(g.nodes("DocSection").where("kind = 'en'").select("node_id"))
    return reports.concept_functions(g, members)


@query("concept_tests", "SELECT DISTINCT src AS node_id FROM tests WHERE dst IN (SELECT id FROM fn WHERE kind = 'Brand#11')")
def concept_tests(spark, d):
    g = project(spark, d)
    return reports.concept_tests(g, g.nodes("Function").where("kind = 'Brand#11'").select("node_id"))


@query("view_params", "SELECT id AS node_id, line_start FROM fn WHERE kind = 'Brand#21' AND line_start > 20")
def view_params(spark, d):
    text = "SELECT node_id, line_start FROM {functions} WHERE kind = :kind AND line_start > :least"
    return spark.sql(text, args={"kind": "Brand#21", "least": 20}, functions=project(spark, d).nodes("Function"))


LOG = """+ st AS (SELECT user_id AS item, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'in_progress' WHEN 'error' THEN 'blocked' ELSE 'done' END AS status, ts AS tm FROM events WHERE event_type <> 'click'),
co AS (SELECT user_id AS item, event_id AS comment_id, ts AS tm FROM events WHERE event_type = 'click')"""


def _log(spark, d) -> tuple[DataFrame, DataFrame]:
    events = read(spark, d, "events")
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "view", "in_progress").when(kind == "error", "blocked").otherwise("done")
    rows = events.select(F.col("user_id").alias("item"), status.alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("comment_id"), "event_type")
    return rows.where("event_type <> 'click'").select("item", "status", "at"), rows.where("event_type = 'click'").select("item", "comment_id", "at")


@query("worklog_rollup", f"{LOG}, l AS (SELECT item, arg_max(status, (tm, status)) AS status, max(tm) AS status_at FROM st GROUP BY item) SELECT l.*, coalesce(n, 0) AS comments, greatest(status_at, m) AS last_activity FROM l LEFT JOIN (SELECT item, count(*) AS n, max(tm) AS m FROM co GROUP BY item) USING (item)")
def worklog_rollup(spark, d):
    return worklog.rollup(*_log(spark, d))


@query("worklog_latest_status", f"{LOG} SELECT item, arg_max(status, (tm, status)) AS status, max(tm) AS status_at FROM st GROUP BY item")
def worklog_latest_status(spark, d):
    return worklog.latest_status(_log(spark, d)[0])


@query("worklog_timeline", f"{LOG}, s AS (SELECT item, status, tm, lead(tm) OVER (PARTITION BY item ORDER BY tm) AS upto FROM st) SELECT item, status, tm AS \"at\", (SELECT count(*) FROM co WHERE co.item = s.item AND co.tm >= s.tm AND (s.upto IS NULL OR co.tm < s.upto)) AS comments FROM s")
def worklog_timeline(spark, d):
    return worklog.timeline(*_log(spark, d)).select("item", "status", "at", "comments")


@query("roadmap_order", f"{LOG}, l AS (SELECT item, arg_max(status, (tm, status)) AS status FROM st GROUP BY item) SELECT item, status, CASE status WHEN 'in_progress' THEN 0 WHEN 'pending' THEN 1 WHEN 'blocked' THEN 2 ELSE 3 END AS turn FROM l")
def roadmap_order(spark, d):
    return worklog.roadmap(worklog.latest_status(_log(spark, d)[0]).withColumn("area", F.lit(None).cast("string"))).select("item", "status", "turn")


EXPORT = """+ b AS (SELECT src, dst FROM calls UNION ALL SELECT dst, src FROM calls WHERE src <> dst),
n AS (SELECT * FROM (SELECT id AS node_id, 0 AS depth FROM seed UNION ALL SELECT DISTINCT dst, 1 FROM b WHERE src IN (SELECT id FROM seed)) AS q ORDER BY depth, node_id LIMIT 60),
s AS (SELECT *, 'n' || (row_number() OVER (ORDER BY node_id) - 1) AS slug FROM n)"""


@query("graph_export_nodes", f"{EXPORT} SELECT node_id, depth, slug FROM s")
def graph_export_nodes(spark, d):
    g = project(spark, d)
    return reports.graph_export(g, seed(g))[0]


@query("graph_export_edges", f"{EXPORT} SELECT DISTINCT a.slug AS src_slug, z.slug AS dst_slug, 'CALLS' AS type FROM calls JOIN s a ON a.node_id = src JOIN s z ON z.node_id = dst")
def graph_export_edges(spark, d):
    g = project(spark, d)
    return reports.graph_export(g, seed(g))[1]


@query("top_functions_per_package", """+ deg AS (SELECT a, count(*) AS degree FROM (SELECT src AS a FROM calls UNION ALL SELECT dst FROM calls WHERE src <> dst) GROUP BY a),
r AS (SELECT c.src AS package, f.src AS node_id, degree, row_number() OVER (PARTITION BY c.src ORDER BY degree DESC, f.src)::INT AS rank FROM defined_in f JOIN contains_ c ON c.dst = f.dst JOIN deg ON a = f.src) SELECT * FROM r WHERE rank <= 15""")
def top_functions_per_package(spark, d):
    return reports.top_per_package(project(spark, d))


@query("cross_package_calls", """+ home AS (SELECT f.src AS fn, c.src AS package FROM defined_in f JOIN contains_ c ON c.dst = f.dst)
SELECT x.package AS a, y.package AS b, count(*) AS calls FROM calls JOIN home x ON x.fn = src JOIN home y ON y.fn = dst WHERE x.package <> y.package GROUP BY ALL""")
def cross_package_calls(spark, d):
    return reports.cross_package_calls(project(spark, d))


@query("tests_from_calls", "SELECT src, dst FROM tests")
def tests_from_calls(spark, d):
    g = project(spark, d)
    return linkers.tests_from_calls(g.edges("CALLS"), g.nodes("Function", "Test"))


@query("regex_first_match", """SELECT conv_id || '#' || turn AS step_id, CASE WHEN regexp_matches(text, '^[A-Z]') THEN 'starts' WHEN regexp_matches(text, '[.]') THEN 'stops' ELSE 'any' END AS function FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL""", ctes="")
def regex_first_match(spark, d):
    steps = read(spark, d, "conversations").select(F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("step_id"), F.col("role").alias("kind"), "text")
    rules = [(k, o, p, f) for k in ("user", "assistant") for o, p, f in ((0, "^[A-Z]", "starts"), (1, "[.]", "stops"), (2, "", "any"))]
    patterns = spark.createDataFrame(rules, "kind string, ord int, pattern string, function string")
    return linkers.first_regex_match(steps, patterns)


@query("mention_resolution", "+ short AS (SELECT name, min(id) AS id FROM fn GROUP BY name), tok AS (SELECT 'part::' || l_partkey AS token, l_orderkey AS k FROM lineitem UNION ALL SELECT p_name, p_partkey FROM part) SELECT token, k, coalesce(f.id, s.id) AS target FROM tok LEFT JOIN fn f ON f.id = token LEFT JOIN short s ON s.name = token WHERE coalesce(f.id, s.id) IS NOT NULL")
def mention_resolution(spark, d):
    return mention_resolution_all(spark, d)


@query("mention_resolution_all", "+ short AS (SELECT name, min(id) AS id FROM fn GROUP BY name), tok AS (SELECT 'part::' || l_partkey AS token, l_orderkey AS k FROM lineitem UNION ALL SELECT p_name, p_partkey FROM part) SELECT token, k, coalesce(f.id, s.id) AS target FROM tok LEFT JOIN fn f ON f.id = token LEFT JOIN short s ON s.name = token WHERE coalesce(f.id, s.id) IS NOT NULL")
def mention_resolution_all(spark, d):
    tokens = read(spark, d, "lineitem").select(F.concat(F.lit("part::"), F.col("l_partkey").cast("string")).alias("token"), F.col("l_orderkey").alias("k"))
    tokens = tokens.unionByName(read(spark, d, "part").select(F.col("p_name").alias("token"), F.col("p_partkey").alias("k")))
    return linkers.resolve_mentions(tokens, project(spark, d).nodes("Function"))


@query("link_extraction", "SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) WHERE NOT regexp_matches(href, '^(#|https?:|mailto:)')", ctes="")
def link_extraction(spark, d):
    from ..sources.documents import local_links

    return local_links(read(spark, d, "pages").select("page_id", F.col("html").alias("text")))


@query("content_hash_skip", "SELECT d.doc_id AS path, md5(text) AS hash FROM documents d LEFT JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0) o USING (doc_id) WHERE h IS DISTINCT FROM md5(text)", ctes="")
def content_hash_skip(spark, d):
    docs = read(spark, d, "documents")
    stored = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return linkers.changed_files(docs.select(F.col("doc_id").alias("path"), F.md5("text").alias("hash")), stored)


@query("call_snapshot_replay", "SELECT src AS qualified_name, dst AS callee FROM calls JOIN fn ON src = id WHERE line_start % 2 = 0")
def call_snapshot_replay(spark, d):
    g = project(spark, d)
    fn = g.nodes("Function").select("qualified_name", "line_start")
    before = g.edges("CALLS").groupBy(F.col("src").alias("qualified_name")).agg(F.collect_list("dst").alias("callees")).join(fn, "qualified_name").withColumnRenamed("line_start", "body_hash")
    now = fn.select("qualified_name", (F.col("line_start") + F.col("line_start") % 2).alias("body_hash"))
    return linkers.replay_calls(before, now)[0]


@query("watch_triggers", "SELECT id AS node_id FROM fn WHERE kind <> CASE WHEN line_start > 25 THEN 'Brand#11' ELSE kind END")
def watch_triggers(spark, d):
    fn = project(spark, d).nodes("Function")
    watched = fn.select("node_id", F.col("kind").alias("body"), F.when(F.col("line_start") > 25, "Brand#11").otherwise(F.col("kind")).alias("watch_baseline_body"))
    return linkers.watch_triggers(watched).select("node_id")


@query("count_distinct", "SELECT kind, count(DISTINCT name) AS names, count(DISTINCT line_start) AS sizes FROM fn GROUP BY kind")
def count_distinct(spark, d):
    return project(spark, d).nodes("Function").groupBy("kind").agg(F.countDistinct("name").alias("names"), F.countDistinct("line_start").alias("sizes"))


@query("merge_nodes", "SELECT id AS node_id FROM fn WHERE is_test UNION SELECT src FROM calls")
def merge_nodes(spark, d):
    g = project(spark, d)
    return mutate.merge_rows(g.nodes("Function", "Test").select("node_id"), g.edges("CALLS").select(F.col("src").alias("node_id")), ["node_id"])


@query("keyed_cross_product", "SELECT f.id AS node_id, n_name AS package FROM fn f, nation WHERE f.id = 'part::12' AND n_nationkey < 3")
def keyed_cross_product(spark, d):
    g = project(spark, d)
    one = g.nodes("Function").where("qualified_name = 'part::12'").select("node_id")
    return one.crossJoin(g.nodes("Package").where("node_id in ('package::0', 'package::1', 'package::2')").select(F.col("name").alias("package")))


@query("callers_of", "SELECT DISTINCT src AS node_id FROM calls WHERE dst IN (SELECT id FROM seed)")
def callers_of(spark, d):
    g = project(spark, d)
    return P.expand(seed(g), "node_id", g.edges("CALLS").drop("type"), "caller", "in").select(F.col("caller").alias("node_id")).distinct()


@query("dead_code_counts", "SELECT kind, count(*) AS functions, count(*) FILTER (id NOT IN (SELECT dst FROM calls)) AS dead FROM fn WHERE NOT is_test GROUP BY kind")
def dead_code_counts(spark, d):
    return reports.dead_code_counts(project(spark, d))


FIRST = """+ born AS (SELECT 'part::' || l_partkey AS node_id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"""


def _born(spark, d) -> DataFrame:
    """(node_id, hash): the earliest order that a part is in."""
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    line = read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    n = line.count()
    rows = spread(line, n, "l_orderkey").join(orders, "l_orderkey")
    first = spread(rows, n, "l_partkey").groupBy("l_partkey").agg(F.min("at").alias("at"))
    return first.select(F.concat(F.lit("part::"), F.col("l_partkey").cast("string")).alias("node_id"), F.col("at.o_orderkey").cast("string").alias("hash"))


@query("diff_added", f"{FIRST} SELECT node_id, k::VARCHAR AS hash FROM born WHERE k IN (SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT o_orderdate FROM orders WHERE o_orderkey = 8) AND o_orderdate <= (SELECT o_orderdate FROM orders WHERE o_orderkey = 20))")
def diff_added(spark, d):
    return reports.added_since(project(spark, d), _born(spark, d), "8", "20")


@query("first_and_last_seen", f"{FIRST} SELECT id AS node_id, coalesce(k::VARCHAR, 'head') AS first_seen_commit, 'head' AS last_seen_commit FROM fn LEFT JOIN born ON node_id = id")
def first_and_last_seen(spark, d):
    return linkers.first_and_last_seen(project(spark, d).nodes("Function").select("node_id"), _born(spark, d).withColumnRenamed("hash", "first_seen_commit"), "head", "node_id")


@query("concept_list", "SELECT n_name AS name, n_name || ' files' AS description, '2000' AS created_at, count(s_suppkey) AS members FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name")
def concept_list(spark, d):
    nation = read(spark, d, "nation")
    concepts = nation.select(F.col("n_name").alias("name"), F.concat("n_name", F.lit(" files")).alias("description"), F.lit("2000").alias("created_at"))
    rich = read(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("dst"))
    return annotations.list_concepts(concepts, rich.join(nation, "n_nationkey").select(F.col("n_name").alias("src"), "dst"))


@query("notes_for_targets", "SELECT 'note::' || doc_id AS node_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY 1 DESC LIMIT 50")
def notes_for_targets(spark, d):
    g = project(spark, d)
    notes = g.nodes("Note").select("node_id", "quality", F.col("node_id").alias("created_at"))
    return annotations.list_notes(notes, g.edges("NOTES"), g.nodes("DocSection").where("kind = 'en'")).select("node_id", "quality")


@query("list_watches", "SELECT 'commit::' || o_orderkey AS node_id, o_orderdate AS set_at, substr(o_orderpriority, 1, 8) AS \"commit\" FROM orders ORDER BY o_orderdate DESC, 1 LIMIT 200")
def list_watches(spark, d):
    commits = project(spark, d).nodes("GitCommit")
    return reports.list_watches(commits.select("node_id", F.col("timestamp").alias("set_at"), F.col("message").alias("commit")))


@query("internal_packages", "SELECT n_name AS name, 'region/' || n_regionkey AS path FROM nation WHERE n_regionkey <> 0 AND n_name <> ''")
def internal_packages(spark, d):
    return reports.internal_packages(_packages(spark, d))


def _packages(spark, d) -> DataFrame:
    """Nations as packages; those of region 0 count as external."""
    return read(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("path"), (F.col("n_regionkey") == 0).alias("is_external"), "n_nationkey")


@query("manifest_dependencies", """SELECT DISTINCT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_regionkey = b.n_regionkey THEN 'Normal' ELSE 'Dev' END AS kind FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_regionkey <> 0""")
def manifest_dependencies(spark, d):
    t = lambda name: read(spark, d, name)
    packages = _packages(spark, d)
    # The bag of lines shrinks to pairs of nations in the partial aggregation before its shuffle.
    pairs = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    pairs = pairs.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey").select("s_nationkey", "c_nationkey").distinct()
    side = lambda key, name: packages.select(F.col("n_nationkey").alias(key), F.col("name").alias(name), F.col("path").alias(f"{name}_path"))
    depends = pairs.join(side("s_nationkey", "a"), "s_nationkey").join(side("c_nationkey", "b"), "c_nationkey").withColumn("kind", F.when(F.col("a_path") == F.col("b_path"), "Normal").otherwise("Dev"))
    return reports.dependencies(depends, reports.internal_packages(packages))


TALK = """t AS (SELECT role AS package, 'feature::' || conv_id AS feature, 'scenario::' || conv_id || '#' || role AS scenario, 'step::' || conv_id || '#' || turn AS step,
 CASE WHEN regexp_matches(text, '^[A-Z]') THEN 'starts' END AS function FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL)"""


def _talk(spark, d) -> DataFrame:
    """Conversations as features: a scenario per role, a step per turn."""
    text = lambda c: F.col(c).cast("string")
    rows = read(spark, d, "conversations").where("role is not null and text is not null")
    return rows.select(
        bdd.package_of(F.lit(None).cast("string"), F.concat(F.lit("crates/"), "role", F.lit("/x.feature"))).alias("package"),
        F.concat(F.lit("feature::"), text("conv_id")).alias("feature"),
        F.concat(F.lit("scenario::"), text("conv_id"), F.lit("#"), "role").alias("scenario"),
        F.concat(F.lit("step::"), text("conv_id"), F.lit("#"), text("turn")).alias("step"),
        F.when(F.col("text").rlike("^[A-Z]"), "starts").alias("function"),
    )


@query("bdd_graph_nodes", f"WITH {TALK} SELECT DISTINCT * FROM (SELECT 'Package' AS kind, package AS node_id FROM t UNION ALL SELECT 'Feature', feature FROM t UNION ALL SELECT 'Scenario', scenario FROM t UNION ALL SELECT 'Step', step FROM t UNION ALL SELECT 'Function', function FROM t) WHERE node_id IS NOT NULL", ctes="")
def bdd_graph_nodes(spark, d):
    return bdd.bdd_graph(_talk(spark, d))[0]


@query("bdd_graph_edges", f"WITH {TALK} SELECT DISTINCT * FROM (SELECT package AS src, feature AS dst, 'PACKAGE_FEATURE' AS type FROM t UNION ALL SELECT feature, scenario, 'FEATURE_SCENARIO' FROM t UNION ALL SELECT scenario, step, 'SCENARIO_STEP' FROM t UNION ALL SELECT step, function, 'STEP_FUNCTION' FROM t) WHERE src IS NOT NULL AND dst IS NOT NULL", ctes="")
def bdd_graph_edges(spark, d):
    return bdd.bdd_graph(_talk(spark, d))[1]


@query("unimplemented_steps", f"WITH {TALK} SELECT scenario, count(*) AS missing FROM t WHERE step NOT IN (SELECT step FROM t WHERE function IS NOT NULL AND step IS NOT NULL) GROUP BY scenario", ctes="")
def unimplemented_steps(spark, d):
    steps = _talk(spark, d).withColumnRenamed("step", "step_id")
    return bdd.unimplemented_steps(steps, steps.where("function is not null"))


@query("longest_prefix", """WITH p AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL), x AS (SELECT DISTINCT regexp_extract(url, '^[^/]*//[^/]*(/[^/]+)?', 0) AS pre FROM p)
 SELECT url, arg_max(pre, length(pre)) AS pre FROM p LEFT JOIN x ON pre <> '' AND (url = pre OR starts_with(url, pre || '/')) GROUP BY url""", ctes="")
def longest_prefix(spark, d):
    urls = read(spark, d, "pages").where("url is not null").select("url").distinct()
    return reports.longest_prefix(urls, "url", urls.select(F.regexp_extract("url", "^[^/]*//[^/]*(/[^/]+)?", 0).alias("pre")).where("pre <> ''"), "pre")


@query("scalar_functions", """SELECT p_partkey AS k, trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', '-', 'g'), '-') AS slug, 'pkg::' || replace(p_name, ' ', '::') AS module,
 strftime(make_timestamp(946684800123456 + p_partkey), '%Y-%m-%dT%H:%M:%S.%fZ') AS iso FROM part""", ctes="")
def scalar_functions(spark, d):
    path = F.concat(F.lit("crates/pkg/src/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.lit(".rs"))
    micros = F.lit(946684800123456) + F.col("p_partkey")
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), scalars.slug(F.col("p_name")).alias("slug"), scalars.module_prefix(F.lit("pkg"), path).alias("module"), scalars.iso_micros(micros).alias("iso"))


@query("first_lines", "SELECT doc_id, CASE WHEN trim(split_part(coalesce(text, ''), chr(10), 1)) = '' THEN '—' ELSE replace(trim(split_part(text, chr(10), 1)), '|', '\\|') END AS signature FROM documents", ctes="")
def first_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", scalars.first_line(F.col("text")).alias("signature"))
