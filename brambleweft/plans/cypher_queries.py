"""Registered queries that go through the openCypher subset, and their SQL."""

from __future__ import annotations

from . import cypher
from .projection import project
from .queries import query


def cypher_query(name: str, text: str, sql: str, **params) -> None:
    query(name, sql)(lambda spark, d: cypher.run(project(spark, d), text, **params))


cypher_query(
    "cypher_all_nodes",
    "MATCH (n) WHERE n.line_start > 45 RETURN n.qualified_name AS qn, n.line_start AS line",
    "SELECT id AS qn, line_start AS line FROM fn WHERE line_start > 45",
)
cypher_query(
    "cypher_secondary_label",
    "MATCH (n:Test) RETURN n.qualified_name AS qn, n.name AS name, n.line_start AS line",
    "SELECT id AS qn, name, line_start AS line FROM fn WHERE is_test",
)
cypher_query(
    "cypher_properties",
    "MATCH (p:Package) RETURN p.name AS name, properties(p) AS props",
    """SELECT n_name AS name, '{"name":"' || n_name || '"}' AS props FROM nation""",
)
cypher_query(
    "cypher_parallel_edges",
    "MATCH (p:Package {name: 'NATION_3'})-[:CONTAINS]->(f:File)-[:SUPPLIED]->(x:Function)<-[:SUPPLIED]-(g:File) RETURN f.name AS file, count(*) AS n",
    """SELECT s_name AS file, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND (a.l_orderkey <> b.l_orderkey OR a.l_linenumber <> b.l_linenumber)
 JOIN supplier ON s_suppkey = a.l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_3' GROUP BY s_name""",
)
cypher_query(
    "cypher_variable_length",
    "MATCH (f:Function {qualified_name: 'part::12'})-[:CALLS*1..3]->(g:Function) RETURN g.qualified_name AS qn",
    "+ w(id, d) AS (SELECT dst, 1 FROM calls WHERE src = 'part::12' UNION SELECT dst, d + 1 FROM w JOIN calls ON src = id WHERE d < 3) SELECT DISTINCT id AS qn FROM w",
)
cypher_query(
    "cypher_two_matches",
    "MATCH (f:Function)-[:DEFINED_IN]->(x:File) MATCH (p:Package)-[:CONTAINS]->(x) RETURN p.name AS package, count(f) AS functions",
    "SELECT n_name AS package, count(*) AS functions FROM defined_in f JOIN contains_ c ON c.dst = f.dst JOIN nation ON c.src = 'package::' || n_nationkey GROUP BY n_name",
)
cypher_query(
    "cypher_optional_is_null",
    "MATCH (f:Function {kind: 'Brand#12'}) OPTIONAL MATCH (t:Test)-[:TESTS]->(f) WITH f, t WHERE t IS NULL RETURN f.qualified_name AS qn",
    "SELECT id AS qn FROM fn WHERE kind = 'Brand#12' AND id NOT IN (SELECT dst FROM tests)",
)
cypher_query(
    "cypher_distinct_aggregate",
    "MATCH (f:Function)-[:CALLS]->(g:Function) RETURN DISTINCT f.kind AS kind, count(g) AS calls, count(DISTINCT g) AS callees",
    "SELECT kind, count(*) AS calls, count(DISTINCT dst) AS callees FROM calls JOIN fn ON src = id GROUP BY kind",
)
cypher_query(
    "cypher_collect",
    "MATCH (p:Package)-[:CONTAINS]->(f:File) RETURN p.name AS package, size(collect(f.name)) AS files, min(f.name) AS first, max(f.name) AS last",
    "SELECT n_name AS package, count(*)::INT AS files, min(s_name) AS first, max(s_name) AS last FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name",
)
cypher_query(
    "cypher_predicates",
    "MATCH (f:Function) WHERE (f.kind STARTS WITH 'Brand#1' OR f.name CONTAINS 'red') AND NOT f:Test AND f.line_start IN [1, 2, 3, 5, 8, 13] RETURN f.qualified_name AS qn",
    "SELECT id AS qn FROM fn WHERE (starts_with(kind, 'Brand#1') OR contains(name, 'red')) AND NOT is_test AND line_start IN (1, 2, 3, 5, 8, 13)",
)
cypher_query(
    "cypher_labels_and_types",
    "MATCH (n:Test)-[r]->(m) RETURN type(r) AS type, size(labels(n)) AS labels, count(*) AS n",
    "SELECT type, 2::INT AS labels, count(*) AS n FROM (SELECT src, 'CALLS' AS type FROM calls UNION ALL SELECT src, 'TESTS' FROM tests UNION ALL SELECT src, 'DEFINED_IN' FROM defined_in) JOIN fn ON src = id WHERE is_test GROUP BY type",
)
cypher_query(
    "cypher_exists",
    "MATCH (f:Function) WHERE EXISTS { MATCH (:Test)-[:TESTS]->(f) } AND NOT (f)-[:CALLS]->(:Test) RETURN f.qualified_name AS qn",
    "SELECT id AS qn FROM fn WHERE id IN (SELECT dst FROM tests) AND id NOT IN (SELECT src FROM calls JOIN fn AS t ON dst = t.id WHERE t.is_test)",
)
cypher_query(
    "cypher_having_order_limit",
    "MATCH (f:Function)-[:CALLS]->(g:Function) WITH g, count(*) AS n WHERE n > 1 RETURN g.qualified_name AS qn, n ORDER BY n DESC, qn SKIP 5 LIMIT 20",
    "SELECT dst AS qn, count(*) AS n FROM calls GROUP BY dst HAVING count(*) > 1 ORDER BY n DESC, qn LIMIT 20 OFFSET 5",
)
cypher_query(
    "cypher_triangles",
    "MATCH (a:Function)-[:CALLS]->(b:Function)-[:CALLS]->(c:Function), (a)-[:CALLS]->(c) RETURN a.qualified_name AS a, b.qualified_name AS b, c.qualified_name AS c",
    "SELECT x.src AS a, x.dst AS b, y.dst AS c FROM calls x JOIN calls y ON x.dst = y.src JOIN calls z ON z.src = x.src AND z.dst = y.dst",
)
cypher_query(
    "cypher_undirected",
    "MATCH (a:Function {qualified_name: 'part::12'})-[:CALLS]-(b:Function) RETURN b.qualified_name AS qn",
    "SELECT dst AS qn FROM calls WHERE src = 'part::12' UNION ALL SELECT src FROM calls WHERE dst = 'part::12'",
)
cypher_query(
    "cypher_parameters",
    "MATCH (f:Function) WHERE f.kind = $kind AND f.line_start >= $least RETURN toLower(f.name) AS name, count(*) AS n, sum(f.line_start) AS total",
    "SELECT lower(name) AS name, count(*) AS n, sum(line_start)::BIGINT AS total FROM fn WHERE kind = 'Brand#21' AND line_start >= 20 GROUP BY ALL",
    kind="Brand#21",
    least=20,
)
