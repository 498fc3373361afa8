"""Read operators over a Graph: impact, dossiers, coverage, dead code, search, history, export.

Every operator returns a DataFrame; ties are broken by ids, so results do not
depend on partitioning. Missing seeds give empty results; wrong arguments raise
ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import pattern as P
from ..plans.graph import Graph
from ..session import checkpoint


def clamp(value: int, low: int, high: int | None = None) -> int:
    return max(low, value if high is None else min(value, high))


def schema_labels(g: Graph) -> DataFrame:
    """Labels and how many nodes carry each (all nodes, no sampling)."""
    return g.nodes().select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def schema_edge_types(g: Graph) -> DataFrame:
    return g.edges().groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def degrees(g: Graph, *types: str) -> DataFrame:
    """(node_id, degree): incident edges, seen from both ends, loops once."""
    return P.both_ways(g.edges(*types)).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))


def edges_into(g: Graph, seeds: DataFrame, kind: str) -> DataFrame:
    """Edges of a type that end at ``seeds`` (node_id)."""
    return P.at_nodes(g.edges(kind), "dst", seeds)


def impact(g: Graph, seeds: DataFrame, depth: int = 3, types: tuple[str, ...] = ("CALLS",), label: str = "Function") -> DataFrame:
    """(direction, node_id, depth): transitive callees (out) and callers (in) of the same label."""
    return P.reach_ways(checkpoint(seeds), g.edges(*types), clamp(depth, 1, 6), ("out", "in"), g.nodes(label))


def impact_summary(g: Graph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Blast radius: sizes of callees, callers, mentions and test edges, and their sum."""
    seeds = checkpoint(seeds)
    near = impact(g, seeds, depth).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))
    into = lambda kind: edges_into(g, seeds, kind).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind.lower()).alias("direction"), "n")
    parts = near.unionByName(into("MENTIONS")).unionByName(into("TESTS"))
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("direction") == k, F.col("n"))), F.lit(0)).cast("long")
    return parts.agg(pick("out").alias("callees"), pick("in").alias("callers"), pick("mentions").alias("mentions"), pick("tests").alias("tests")).withColumn("radius", F.expr("callees + callers + mentions + tests"))


def _degrees_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree) of ``nodes`` (node_id) that have an edge: edges at both ends, a loop once."""
    out = P.at_nodes(edges, "src", nodes).select(F.col("src").alias("node_id"))
    into = P.at_nodes(edges.where("src <> dst"), "dst", nodes).select(F.col("dst").alias("node_id"))
    return out.unionByName(into).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def node_dossier(g: Graph, seeds: DataFrame, limit: int = 25) -> DataFrame:
    """Neighbours per direction and type, by total degree then id, cut to ``limit`` a group.

    Edges of each type are looked for at the seeds, then at the neighbours that
    were found; nothing but the neighbours is written.
    """
    limit = clamp(limit, 1)
    edges, seeds = g.edges(), checkpoint(seeds)
    step = lambda d, at, to: P.at_nodes(edges, at, seeds).select(F.lit(d).alias("direction"), "type", F.col(to).alias("node_id"))
    near = checkpoint(step("out", "src", "dst").unionByName(step("in", "dst", "src")).distinct())
    ranked = near.join(_degrees_of(near, edges), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    group = Window.partitionBy("direction", "type")
    return ranked.select("*", F.row_number().over(group.orderBy(F.desc("degree"), "node_id")).alias("rank"), F.count(F.lit(1)).over(group).alias("total")).where(F.col("rank") <= limit)


def explore(g: Graph, seeds: DataFrame, types: tuple[str, ...], depth: int = 2) -> DataFrame:
    """Heterogeneous search: (node_id, depth, degree, has_notes, has_mentions, score).

    Nodes need a qualified name; score = degree + 4 has_notes + 2 has_mentions - 5 depth.
    """
    depth = clamp(depth, 1, 4)
    named = g.nodes().where("qualified_name <> ''").select("node_id")
    edges = g.edges(*types)
    found = checkpoint(P.reach(checkpoint(seeds), edges, depth, "any", named))
    scored = found.join(_degrees_of(found, edges), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))

    def flag(rows: DataFrame, kind: str) -> DataFrame:
        into = P.at_nodes(g.edges(kind), "dst", found).select(F.col("dst").alias("node_id"), F.lit(1).alias(kind)).distinct()
        return rows.join(into, "node_id", "left").withColumn(kind, F.coalesce(kind, F.lit(0)))

    scored = flag(flag(scored, "NOTES"), "MENTIONS")
    return scored.select("node_id", "depth", "degree", F.col("NOTES").alias("has_notes"), F.col("MENTIONS").alias("has_mentions"), F.expr("degree + 4 * NOTES + 2 * MENTIONS - 5 * depth").alias("score"))


def budget_fill(rows: DataFrame, line: Column, order: list[Column], budget: int = 8000, header: int = 0, reserve: int = 160) -> DataFrame:
    """The longest prefix in ``order`` whose lines stay within a byte budget.

    The running length only grows, so the filter stops where a loop would. Every
    line takes a byte at least, so no more rows than the budget has bytes are
    sorted and summed up in one task, however many there are.
    """
    sized = rows.orderBy(*order).limit(max(budget, 500)).withColumn("bytes", F.octet_length(line).cast("long"))
    before = F.coalesce(F.sum(F.col("bytes") + 1).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("before", before).where(F.lit(header) + F.col("before") + F.col("bytes") + reserve < max(budget, 500)).drop("before")


def orphan_functions(g: Graph) -> DataFrame:
    """Functions that no function calls, tests excluded."""
    return P.where_missing(g.nodes("Function").where("not is_test"), "node_id", g.edges("CALLS"), "dst").select("node_id", "qualified_name")


def untested_by_fanin(g: Graph) -> DataFrame:
    """Functions without a test, with the number of calls into each."""
    bare = P.where_missing(g.nodes("Function").where("not is_test"), "node_id", g.edges("TESTS"), "dst")
    return P.counted(bare.select("node_id", "qualified_name"), "node_id", g.edges("CALLS"), "dst", "fan_in")


def without_edge(g: Graph, label: str, kind: str) -> DataFrame:
    """Nodes of a label that no edge of a type points to (files without a note, and the like)."""
    return P.where_missing(g.nodes(label), "node_id", g.edges(kind), "dst").select("node_id")


def undocumented_packages(g: Graph) -> DataFrame:
    """Packages no function of which is mentioned."""
    files = g.edges("CONTAINS").select(F.col("src").alias("package"), F.col("dst").alias("file"))
    defined = g.edges("DEFINED_IN").select(F.col("src").alias("function"), F.col("dst").alias("file"))
    mentioned = g.edges("MENTIONS").select(F.col("dst").alias("function")).distinct()
    seen = files.join(defined, "file").join(mentioned, "function", "left_semi").select("package")
    return P.where_missing(g.nodes("Package"), "node_id", seen, "package").select("name").distinct()


def dead_code(g: Graph, exclude_tests: bool = True, ignore_test_callers: bool = False, kind: str = "", name_skip: str = "") -> DataFrame:
    """Functions that nothing calls, with their file; filters as named."""
    fn = g.nodes("Function")
    calls = g.edges("CALLS")
    if ignore_test_callers:
        calls = P.where_exists(calls, "src", fn.where("not is_test"), "node_id")
    rows = P.where_missing(fn, "node_id", calls, "dst")
    if exclude_tests:
        rows = rows.where("not is_test")
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if name_skip:
        rows = rows.where(~F.contains(F.lower("name"), F.lit(name_skip.lower())))
    placed = P.expand(rows, "node_id", g.edges("DEFINED_IN").drop("type"), "file_id", optional=True)
    return P.attach(placed, "file_id", g.nodes("File"), "path", how="left").select("node_id", "qualified_name", "path", "line_start")


def find_symbol(g: Graph, query: str, limit: int = 25, kind: str | None = None, labels: tuple[str, ...] = ("Function", "Symbol")) -> DataFrame:
    """Fuzzy search by rank: exact, name prefix, qualified prefix, name infix, qualified infix.

    Of the labels, those that the graph has; hits come with their kind and the
    path of their file (one, the smallest, where several define them).
    """
    needle = query.strip().lower()
    if not needle:
        raise ValueError("query is empty")
    name, qn, n = F.lower("name"), F.lower("qualified_name"), F.lit(needle)
    rank = F.when((name == n) | (qn == n), 0).when(F.startswith(name, n), 1).when(F.startswith(qn, n), 2).when(F.contains(name, n), 3).when(F.contains(qn, n), 4)
    found = [g.nodes(x).select("node_id", "qualified_name", "name", "kind") for x in labels if x in g.node_frames]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    hits = rows.withColumn("rank", rank).where("rank is not null")
    if kind is not None:
        hits = hits.where(F.col("kind") == kind)
    first = hits.orderBy("rank", F.octet_length("name"), "qualified_name").limit(clamp(limit, 1))
    homes = P.where_exists(g.edges("DEFINED_IN").select(F.col("src").alias("node_id"), F.col("dst").alias("file")), "node_id", first, "node_id")
    paths = P.attach(homes, "file", g.nodes("File"), "path").groupBy("node_id").agg(F.min("path").alias("path"))
    return first.join(paths, "node_id", "left").select("qualified_name", "name", "rank", "kind", "path")


def history(g: Graph, limit: int = 50) -> DataFrame:
    """Newest commits with their authors."""
    commits = P.expand(g.nodes("GitCommit").select("node_id", "hash", "timestamp", "message"), "node_id", P.turned(g.edges("AUTHORED").drop("type")), "author_id", optional=True)
    named = P.attach(commits, "author_id", g.nodes("Author"), "name", how="left")
    return named.orderBy(F.desc("timestamp"), "hash").limit(clamp(limit, 1)).select("hash", "timestamp", "message", F.col("name").alias("author"))


def resolve_commit(commits: DataFrame, key: str) -> DataFrame:
    """The commit with this hash, else one with this short hash, the newest; none where neither is there."""
    rank = F.when(F.col("hash") == key, 0).when(F.col("short_hash") == key, 1)
    return commits.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", F.desc("timestamp"), "hash").limit(1).drop("_rank")


def diff_since(g: Graph, base: str, head: str, mode: str = "timestamp") -> DataFrame:
    """Commits after ``base`` up to ``head``: by time, or (mode 'dag') along PARENT_OF."""
    commits = g.nodes("GitCommit").select("node_id", "hash", "timestamp")
    start, end = commits.where(F.col("hash") == base), commits.where(F.col("hash") == head)
    if mode == "timestamp":
        # Aggregates without a key: one row, whatever the table holds.
        ends = start.agg(F.min("timestamp").alias("t0")).crossJoin(end.agg(F.max("timestamp").alias("t1")))
        return commits.join(F.broadcast(ends), (F.col("timestamp") > F.col("t0")) & (F.col("timestamp") <= F.col("t1"))).select("hash", "timestamp")
    if mode != "dag":
        raise ValueError(f"unknown mode {mode}")
    after = P.reach_all(start, g.edges("PARENT_OF"))
    # What leads from there to the head has only such commits on its way.
    within = P.where_exists(P.where_exists(g.edges("PARENT_OF"), "src", after, "node_id"), "dst", after, "node_id")
    last = P.where_exists(end.select("node_id"), "node_id", after, "node_id")
    upto = P.reach_all(last, within, "in").unionByName(last)
    return P.where_exists(commits, "node_id", upto, "node_id").select("hash", "timestamp")


def concept_functions(g: Graph, members: DataFrame) -> DataFrame:
    """Functions in scope of a concept: its function members and what its sections mention."""
    direct = P.where_exists(g.nodes("Function"), "node_id", members, "node_id").select("node_id")
    told = P.expand(members.select("node_id"), "node_id", g.edges("MENTIONS").drop("type"), "to").select(F.col("to").alias("node_id"))
    return direct.unionByName(told.join(g.nodes("Function").select("node_id"), "node_id", "left_semi")).distinct()


def concept_tests(g: Graph, members: DataFrame) -> DataFrame:
    scope = concept_functions(g, members)
    return P.where_exists(g.edges("TESTS"), "dst", scope, "node_id").select(F.col("src").alias("node_id")).distinct()


def graph_export(g: Graph, seeds: DataFrame, types: tuple[str, ...] = ("CALLS",), depth: int = 1, max_nodes: int = 60) -> tuple[DataFrame, DataFrame]:
    """(nodes with slugs, edges between them): at most ``max_nodes`` by depth, then id."""
    depth, most = clamp(depth, 1, 3), clamp(max_nodes, 5, 200)
    found = seeds.select("node_id", F.lit(0).alias("depth")).unionByName(P.reach(seeds, g.edges(*types), depth, "any"))
    shown = found.orderBy("depth", "node_id").limit(most)
    nodes = shown.withColumn("slug", F.concat(F.lit("n"), (F.row_number().over(Window.orderBy("node_id")) - 1).cast("string")))
    ends = lambda c: nodes.select(F.col("node_id").alias(c), F.col("slug").alias(f"{c}_slug"))
    edges = g.edges(*types).join(F.broadcast(ends("src")), "src").join(F.broadcast(ends("dst")), "dst")  # at most 200 rows
    return nodes, edges.select("src_slug", "dst_slug", "type").distinct()


def top_per_package(g: Graph, limit: int = 15) -> DataFrame:
    """The functions of highest call degree of each package (by file prefix of its package)."""
    degree = degrees(g, "CALLS")
    placed = g.edges("DEFINED_IN").select(F.col("src").alias("node_id"), F.col("dst").alias("file")).join(g.edges("CONTAINS").select(F.col("src").alias("package"), F.col("dst").alias("file")), "file")
    rows = placed.join(degree, "node_id").select("package", "node_id", "degree")
    rank = F.row_number().over(Window.partitionBy("package").orderBy(F.desc("degree"), "node_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def cross_package_calls(g: Graph) -> DataFrame:
    """Numbers of distinct calls between different packages."""
    home = g.edges("DEFINED_IN").select(F.col("src").alias("fn"), F.col("dst").alias("file")).join(g.edges("CONTAINS").select(F.col("src").alias("package"), F.col("dst").alias("file")), "file").select("fn", "package")
    calls = g.edges("CALLS").select("src", "dst").distinct()
    both = calls.join(home.select(F.col("fn").alias("src"), F.col("package").alias("a")), "src").join(home.select(F.col("fn").alias("dst"), F.col("package").alias("b")), "dst")
    return both.where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("calls"))


def longest_prefix(rows: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Add the longest of ``prefixes`` that each path starts with, by equality joins.

    A path is exploded into its own directory prefixes, so no pair of rows is
    compared that does not match.
    """
    cut = rows.withColumn("_parts", F.split(path, "/"))
    each = cut.withColumn("_n", F.explode(F.sequence(F.size("_parts"), F.lit(1), F.lit(-1)))).withColumn(prefix, F.array_join(F.expr("slice(_parts, 1, _n)"), "/"))
    best = each.join(prefixes.select(prefix).distinct(), prefix).groupBy(path).agg(F.max_by(prefix, "_n").alias(prefix))
    return rows.join(best, path, "left")


def added_since(g: Graph, first_seen: DataFrame, base: str, head: str) -> DataFrame:
    """(node_id, hash): nodes first seen (node_id, hash) in a commit after ``base`` up to ``head``."""
    return P.where_exists(first_seen, "hash", diff_since(g, base, head), "hash")


def dead_code_counts(g: Graph, by: str = "kind") -> DataFrame:
    """(by, functions, dead): how many functions of each kind there are and nothing calls."""
    fn = g.nodes("Function").where("not is_test")
    called = g.edges("CALLS").select(F.col("dst").alias("node_id"), F.lit(1).alias("called")).distinct()
    rows = fn.select("node_id", by).join(called, "node_id", "left")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("functions"), F.count_if(F.col("called").isNull()).alias("dead"))


def internal_packages(packages: DataFrame) -> DataFrame:
    """(name, path) of packages that are not external and have both."""
    return packages.where("not is_external and name <> '' and path <> ''").select("name", "path")


def dependencies(depends: DataFrame, internal: DataFrame) -> DataFrame:
    """Distinct (a, b, kind) whose depending side is an internal package."""
    return P.where_exists(depends, "a", internal, "name").select("a", "b", "kind").distinct()


def list_watches(watched: DataFrame, limit: int = 200) -> DataFrame:
    """Newest watches, with the first eight characters of their commit."""
    newest = watched.orderBy(F.desc("set_at"), "node_id").limit(clamp(limit, 1))
    return newest.select("node_id", "set_at", F.substring("commit", 1, 8).alias("commit"))


def dead_code_listed(g: Graph, limit: int = 100, **filters) -> DataFrame:
    """The first functions that nothing calls, by file (none first), line and name; 1 to 1000 of them."""
    order = [F.asc_nulls_first("path"), "line_start", "qualified_name"]
    return dead_code(g, **filters).orderBy(*order).limit(clamp(limit, 1, 1000))


def diff_report(g: Graph, base: str, snapshots: DataFrame) -> DataFrame:
    """(hash, timestamp, author) of the commits after ``base`` up to the one that ``snapshots`` (src, dst) shows; without one, none."""
    commits = g.nodes("GitCommit").select("node_id", "hash", "timestamp", "message")
    shown = P.where_exists(commits, "node_id", snapshots, "src").agg(F.max("timestamp").alias("t1"))
    start = commits.where(F.col("hash") == base).agg(F.min("timestamp").alias("t0"))
    # Aggregates without a key: one row, whatever the table holds.
    ranged = commits.join(F.broadcast(start.crossJoin(shown)), (F.col("timestamp") > F.col("t0")) & (F.col("timestamp") <= F.col("t1")))
    by = P.expand(ranged, "node_id", P.turned(g.edges("AUTHORED").drop("type")), "author_id", optional=True)
    return P.attach(by, "author_id", g.nodes("Author"), "name", how="left").select("hash", "timestamp", F.col("name").alias("author"))


def concept_dossier(g: Graph, members: DataFrame, notes: int = 25) -> DataFrame:
    """(part, node_id, on) of a concept's members, functions in scope, their tests and the newest notes on them.

    ``on`` is the function that a test covers or a note is on. A note's age is its id here.
    """
    scope = checkpoint(concept_functions(g, members))
    row = lambda part, rows, a, b: rows.select(F.lit(part).alias("part"), a.alias("node_id"), b.alias("on"))
    none = F.lit(None).cast("string")
    parts = row("member", P.where_exists(g.nodes().select("node_id"), "node_id", members, "node_id"), F.col("node_id"), none)
    parts = parts.unionByName(row("function", scope, F.col("node_id"), none))
    tests = P.where_exists(g.edges("TESTS"), "dst", scope, "node_id")
    noted = P.where_exists(g.edges("NOTES"), "dst", scope.unionByName(members.select("node_id")), "node_id").orderBy(F.desc("src"), "dst").limit(clamp(notes, 1))
    return parts.unionByName(row("test", tests, F.col("src"), F.col("dst"))).unionByName(row("note", noted, F.col("src"), F.col("dst")))


def node_properties(g: Graph, label: str, nodes: DataFrame) -> DataFrame:
    """(node_id, labels, property, value) of nodes (node_id): every property that is not null, as text."""
    rows = P.at_nodes(g.nodes(label), "node_id", nodes)
    names = [c for c in rows.columns if c not in ("node_id", "labels")]
    pairs = F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).cast("string").alias("value")) for c in names])
    each = rows.select("node_id", F.array_join(F.array_sort("labels"), ",").alias("labels"), F.explode(pairs).alias("x"))
    return each.select("node_id", "labels", "x.property", "x.value").where("value is not null")
