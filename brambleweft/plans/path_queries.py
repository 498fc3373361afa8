"""Registered queries over paths and histories: trails, reachability with merges, versions of nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paths, versions
from .projection import project, read
from .queries import query


@query("trails_between_brands", """+ e AS (SELECT src, dst, 'CALLS' AS type FROM calls UNION ALL SELECT src, dst, 'TESTS' FROM tests),
a AS (SELECT id FROM fn WHERE kind = 'Brand#11'), b AS (SELECT id FROM fn WHERE kind = 'Brand#12'),
p1 AS (SELECT e.src AS n0, e.dst AS n1, e.type AS t1 FROM e JOIN a ON a.id = e.src),
p2 AS (SELECT p1.*, e.dst AS n2, e.type AS t2 FROM p1 JOIN e ON e.src = n1 WHERE NOT (n0 = n1 AND n1 = e.dst AND t1 = e.type)),
p3 AS (SELECT p2.*, e.dst AS n3, e.type AS t3 FROM p2 JOIN e ON e.src = n2 WHERE NOT (n0 = n2 AND n1 = e.dst AND t1 = e.type) AND NOT (n1 = n2 AND n2 = e.dst AND t2 = e.type)),
r AS (SELECT 1 AS length, [n0, n1] AS n, n1 AS z FROM p1 UNION ALL SELECT 2, [n0, n1, n2], n2 FROM p2 UNION ALL SELECT 3, [n0, n1, n2, n3], n3 FROM p3)
SELECT length, array_to_string(n, '>') AS nodes, count(*) AS trails FROM r JOIN b ON b.id = z GROUP BY ALL""")
def trails_between_brands(spark, d):
    g = project(spark, d)
    of = lambda kind: g.nodes("Function").where(F.col("kind") == kind).select("node_id")
    found = paths.trails(of("Brand#11"), g.told_apart("CALLS", "TESTS"), of("Brand#12"), 1, 3)
    return found.groupBy("length", F.array_join("nodes", ">").alias("nodes")).agg(F.count(F.lit(1)).alias("trails"))


#: An order is merged into the order seven numbers on, if that is later; chains are the orders of a customer.
MERGES = """o AS (SELECT o_orderkey AS k, o_custkey AS c, (o_orderdate, o_orderkey) AS p, o_orderdate AS tm FROM orders),
m AS (SELECT a.k AS src, b.k AS dst FROM o a JOIN o b ON b.k = a.k + 7 WHERE b.tm > a.tm),
s AS (SELECT k AS src, lead(k) OVER (PARTITION BY c ORDER BY p) AS dst FROM o),
e AS (SELECT * FROM s WHERE dst IS NOT NULL UNION ALL SELECT * FROM m),
own AS (SELECT * FROM o WHERE c = (SELECT c FROM o GROUP BY c ORDER BY count(*) DESC, c LIMIT 1))"""


def _history(spark, d):
    """(nodes, merges) of the orders, and the first and the last order of the customer with most of them."""
    orders = read(spark, d, "orders")
    nodes = orders.select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("chain"), F.struct("o_orderdate", "o_orderkey").alias("place"))
    ends = orders.select((F.col("o_orderkey") - 7).alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderdate").alias("later"))
    merges = orders.select(F.col("o_orderkey").alias("src"), "o_orderdate").join(ends, "src").where("later > o_orderdate").select("src", "dst")
    most = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(1)
    own = orders.join(most, "o_custkey", "left_semi")
    first, last = (own.agg(f(F.struct("o_orderdate", "o_orderkey")).alias("x")).select(F.col("x.o_orderkey").alias("node_id")) for f in (F.min, F.max))
    return nodes, merges, first, last


@query("reach_with_merges", f"WITH RECURSIVE {MERGES}, r(k) AS (SELECT arg_min(k, p) FROM own UNION SELECT dst FROM r JOIN e ON src = r.k) SELECT k AS node_id FROM r", ctes="")
def reach_with_merges(spark, d):
    nodes, merges, first, _ = _history(spark, d)
    return paths.reach_chains(nodes, merges, first)


@query("diff_with_merges", f"""WITH RECURSIVE {MERGES}, r(k) AS (SELECT arg_min(k, p) FROM own UNION SELECT dst FROM r JOIN e ON src = r.k),
b(k) AS (SELECT arg_max(k, p) FROM own UNION SELECT src FROM b JOIN e ON dst = b.k) SELECT k AS node_id FROM r WHERE k <> (SELECT arg_min(k, p) FROM own) INTERSECT SELECT k FROM b""", ctes="")
def diff_with_merges(spark, d):
    nodes, merges, first, last = _history(spark, d)
    after = paths.reach_chains(nodes, merges, first).join(first, "node_id", "left_anti")
    return after.join(paths.reach_chains(nodes, merges, last, forward=False), "node_id", "left_semi")


#: What a part's supplier was from day to day; a returned line takes the part out.
SEEN = """x AS (SELECT l_partkey AS node_id, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day, arg_max(CASE WHEN l_returnflag <> 'R' THEN 's' || l_suppkey ELSE '-' END, (l_orderkey, l_linenumber)) AS content FROM lineitem GROUP BY ALL),
y AS (SELECT *, lag(content) OVER (PARTITION BY node_id ORDER BY day) AS before FROM x),
z AS (SELECT * FROM y WHERE content IS DISTINCT FROM coalesce(before, '-')),
v AS (SELECT node_id, content, day AS first, lead(day) OVER (PARTITION BY node_id ORDER BY day) AS until FROM z), w AS (SELECT * FROM v WHERE content <> '-')"""


def _versions(spark, d):
    line = read(spark, d, "lineitem")
    content = F.when(F.col("l_returnflag") != "R", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    seen = line.select(F.col("l_partkey").alias("node_id"), F.datediff(F.col("l_shipdate"), F.lit("1970-01-01")).cast("long").alias("commit"), content.alias("content"), F.struct("l_orderkey", "l_linenumber").alias("turn"))
    return versions.ranges(seen)


@query("version_ranges", f"WITH {SEEN} SELECT node_id, content, first, until FROM w", ctes="")
def version_ranges(spark, d):
    return _versions(spark, d)


@query("version_diff", f"""WITH {SEEN}, a AS (SELECT node_id, content FROM w WHERE first <= 10000 AND (until IS NULL OR until > 10000)), b AS (SELECT node_id, content FROM w WHERE first <= 10400 AND (until IS NULL OR until > 10400))
SELECT coalesce(a.node_id, b.node_id) AS node_id, CASE WHEN a.content IS NULL THEN 'added' WHEN b.content IS NULL THEN 'removed' ELSE 'edited' END AS change, a.content AS before, b.content AS after
FROM a FULL JOIN b ON a.node_id = b.node_id WHERE a.content IS DISTINCT FROM b.content""", ctes="")
def version_diff(spark, d):
    return versions.diff(_versions(spark, d), 10000, 10400)
