import pytest

from brambleweft.plans import cypher
from brambleweft.plans.graph import Graph


@pytest.fixture(scope="module")
def g(spark):
    fn = [("a", ["Function"], "m::a", "a", 3), ("b", ["Function"], "m::b", "b", 1), ("c", ["Function"], "m::c", "c", None), ("t", ["Function", "Test"], "m::t", "t", 2)]
    nodes = spark.createDataFrame(fn, "node_id string, labels array<string>, qualified_name string, name string, line_start int")
    files = spark.createDataFrame([("f", ["File"], "x.rs")], "node_id string, labels array<string>, path string")
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "b"), ("t", "a"), ("c", "c")], "src string, dst string")
    home = spark.createDataFrame([("a", "f"), ("b", "f")], "src string, dst string")
    return Graph({"Function": nodes, "File": files}, {"CALLS": calls, "DEFINED_IN": home})


def q(g, text, **params):
    return [tuple(r) for r in cypher.run(g, text, **params).collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("MATCH (n:Function {name: 'a'}) RETURN n.qualified_name AS q", [("m::a",)]),
        ("MATCH (n:Function:Test) RETURN n.name AS n", [("t",)]),
        ("MATCH (a:Function)-[:CALLS]->(b:Function) RETURN DISTINCT a.name AS x, b.name AS y ORDER BY x, y", [("a", "b"), ("b", "c"), ("c", "c"), ("t", "a")]),
        ("MATCH (a:Function {name: 'b'})<-[:CALLS]-(c:Function) RETURN count(*) AS n", [(2,)]),
        ("MATCH (a:Function)-[r]-(b) WHERE a.name = 'c' RETURN type(r) AS t, count(b) AS n", [("CALLS", 2)]),
        ("MATCH (f:Function) OPTIONAL MATCH (f)-[:DEFINED_IN]->(x:File) RETURN f.name AS n, x.path AS p ORDER BY n", [("a", "x.rs"), ("b", "x.rs"), ("c", None), ("t", None)]),
        ("MATCH (f:Function) WHERE NOT (f)<-[:CALLS]-(:Function) RETURN f.name AS n", [("t",)]),
        ("MATCH (f:Function) WHERE EXISTS { MATCH (f)-[:DEFINED_IN]->(:File) } AND f.name <> 'a' RETURN f.name AS n", [("b",)]),
        ("MATCH (f:Function) WHERE f.name IN ['a', 'c'] OR f:Test RETURN f.name AS n ORDER BY n DESC SKIP 1 LIMIT 1", [("c",)]),
        ("MATCH (f:Function) RETURN f.name AS n ORDER BY f.line_start", [("b",), ("t",), ("a",), ("c",)]),
        ("MATCH (f:Function) RETURN f.name AS n ORDER BY f.line_start DESC LIMIT 2", [("c",), ("a",)]),
        ("MATCH (a:Function)-[:CALLS]->(b:Function) WITH a, count(b) AS k WHERE k > 1 RETURN a.name AS n, k", [("a", 2)]),
        ("UNWIND [1, 2] AS x RETURN x + 1 AS y", [(2,), (3,)]),
        ("MATCH (a:Function {name: 't'})-[:CALLS*1..3]->(b:Function) RETURN b.name AS n ORDER BY n", [("a",), ("b",), ("c",)]),
        ("MATCH (a:Function), (b:File) WHERE a.name = $n RETURN a.name AS x, b.path AS y", [("a", "x.rs")]),
        ("MATCH (a:Function)-[:CALLS]->(b:Function)-[:CALLS]->(c:Function) WHERE b.name = 'c' RETURN a.name AS n", [("b",)]),
        ("MATCH (f:Function) WHERE f.line_start IS NULL RETURN labels(f) AS l, coalesce(f.line_start, 0) AS x, substring(f.qualified_name, 1) AS s", [(["Function"], 0, "::c")]),
        ("MATCH (f:Function) WHERE f.qualified_name STARTS WITH 'm' AND f.name CONTAINS 'a' RETURN sum(f.line_start) AS s, collect(f.name) AS c", [(3, ["a"])]),
    ],
)
def test_statements(g, text, want):
    assert q(g, text, n="a") == want


def test_errors_explain_and_many(g):
    for bad in ("MATCH (n) RETURN nope(n)", "MATCH (n:Function) RETURN $x", "FOO", ""):
        with pytest.raises(cypher.CypherError):
            cypher.run(g, bad)
    assert cypher.run(g, "EXPLAIN MATCH (n:Function) RETURN n.name AS n").count() > 1
    assert len(cypher.run_many(g, "MATCH (n:File) RETURN n.path AS p; MATCH (n) RETURN count(*) AS n;")) == 2


def test_edges_with_an_id_are_one_edge_whatever_their_ends(spark, g):
    """A line of an order is one edge, also where its row is there twice with another supplier."""
    rows = [("f", "a", "1"), ("h", "a", "1"), ("h", "a", "2"), ("h", "b", "1"), ("f", "c", None), ("h", "c", None)]
    supplied = spark.createDataFrame(rows, "src string, dst string, edge_id string")
    files = spark.createDataFrame([(x, ["File"], x) for x in "fh"], "node_id string, labels array<string>, path string")
    named = Graph({"Function": g.node_frames["Function"], "File": files}, {"SUPPLIED": supplied})
    got = q(named, "MATCH (x:File)-[:SUPPLIED]->(y:Function)<-[:SUPPLIED]-(z:File) RETURN x.path AS x, y.name AS y, z.path AS z")
    assert sorted(got) == [("f", "a", "h"), ("f", "c", "h"), ("h", "a", "f"), ("h", "a", "h"), ("h", "a", "h"), ("h", "c", "f")]
