"""Mutations, the worklog, incremental runs, renderers and extractors on small tables with odd rows."""

import json

import pytest
from brambleweft.functions import scalars
from brambleweft.operators import annotations, architecture, incremental, linkers, mutate, render, reports, worklog
from brambleweft.plans import cypher, pattern
from brambleweft.plans.graph import Graph
from brambleweft.sources import code, documents, manifests
from brambleweft.streaming import live
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def graph(spark):
    fn = spark.createDataFrame([("a", ["Function"], "a", 1), ("b", ["Function"], "b", 2), ("t", ["Function", "Test"], "t", 3)], "node_id string, labels array<string>, name string, line_start int")
    file = spark.createDataFrame([("f", ["File"], "f", "p/f")], "node_id string, labels array<string>, name string, path string")
    calls = spark.createDataFrame([("a", "b"), ("a", "b"), ("t", "b")], "src string, dst string")
    return Graph({"Function": fn, "File": file}, {"CALLS": calls, "DEFINED_IN": spark.createDataFrame([("a", "f")], "src string, dst string")})


def test_properties_of_secondary_labels_and_of_all_nodes(graph):
    assert rows(cypher.run(graph, "MATCH (n:Test) RETURN n.line_start AS x")) == [(3,)]
    assert rows(cypher.run(graph, "MATCH (n) WHERE n.line_start > 1 RETURN n.name AS x")) == [("b",), ("t",)]
    assert rows(cypher.run(graph, "MATCH (n:File) RETURN properties(n) AS x")) == [('{"name":"f","path":"p/f"}',)]
    assert rows(cypher.run(graph, "MATCH (n:Test) RETURN properties(n) AS x")) == [('{"line_start":3,"name":"t"}',)]


def test_parallel_edges_are_different_edges(graph):
    both = cypher.run(graph, "MATCH (x)-[:CALLS]->(y)<-[:CALLS]-(z) RETURN x.name AS x, z.name AS z")
    assert rows(both) == [("a", "a"), ("a", "a"), ("a", "t"), ("a", "t"), ("t", "a"), ("t", "a")]
    named = Graph(graph.node_frames, {"CALLS": graph.edge_frames["CALLS"].withColumn("edge_id", F.lit("one"))})
    assert rows(named.told_apart("CALLS").select("nth").distinct()) == [("one",)]


def test_paths_start_where_something_is_bound(graph):
    assert rows(cypher.run(graph, "MATCH (x {name: 'a'})-[*1..2]->(y) RETURN y.name AS y")) == [("b",), ("f",)]
    assert rows(cypher.run(graph, "MATCH (x {name: 'b'})<-[:CALLS*1..3]-(y) RETURN y.name AS y")) == [("a",), ("t",)]
    with pytest.raises(cypher.CypherError, match="count"):
        cypher.run(graph, "MATCH (n) RETURN count{ (n)-[:CALLS]->() } AS c")


def test_searches_in_both_directions_are_two_searches(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("z", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node_id string")
    both = pattern.reach_ways(seeds, edges, 3, ("out", "in"))
    for d in ("out", "in"):
        assert rows(both.where(F.col("direction") == d).select("node_id", "depth")) == rows(pattern.reach(seeds, edges, 3, d))
    assert rows(pattern.reach(seeds, edges, 3)) == [("b", 1), ("c", 2), ("d", 3)]
    assert rows(pattern.reach(seeds.limit(0), edges, 3)) == rows(pattern.reach(seeds, edges.limit(0), 3)) == []


def test_budget_takes_the_same_prefix_of_any_number_of_rows(spark):
    many = spark.range(3000).select("id", F.lit("ab").alias("line"))
    got = reports.budget_fill(many, F.col("line"), [F.col("id")], budget=500, reserve=0)
    total, want = 0, 0
    while total + 2 < 500:
        total, want = total + 3, want + 1
    assert [r["id"] for r in got.orderBy("id").collect()] == list(range(want))


def test_mutations(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("c", "d", 3)], "src string, dst string, edge_id int")
    assert rows(mutate.delete_edges(edges, edges.where("edge_id = 1")).select("edge_id")) == [(2,), (3,)]
    assert rows(mutate.delete_edges(edges.drop("edge_id"), edges.where("edge_id = 1").drop("edge_id"))) == [("c", "d")]
    table = spark.createDataFrame([("x", 1, "p"), ("y", None, None)], "node_id string, n int, s string")
    assert rows(mutate.remove_properties(table, F.col("node_id") == "x", "n", "none")) == [("x", None, "p"), ("y", None, None)]
    assert len(rows(mutate.create_rows(table, table))) == 4


def test_store_never_lacks_its_pointer(spark, tmp_path):
    store = mutate.Store(spark, f"file://{tmp_path}/s")
    for v in (1, 2, 3):
        store.write("t", spark.createDataFrame([(v,)], "v int"))
        assert [tuple(r) for r in store.read("t").collect()] == [(v,)]
    assert [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("_CURRENT")] == ["_CURRENT"]
    store.begin()
    store.write("t", spark.range(1).select(F.raise_error(F.lit("no")).alias("v")))
    with pytest.raises(Exception, match="no"):
        store.commit()
    assert [tuple(r) for r in mutate.Store(spark, f"file://{tmp_path}/s").read("t").collect()] == [(3,)]


def test_worklog(spark):
    items = spark.createDataFrame([("wl-1", "one", "a", "bug", "2000", "pending", "2000")], "item string, title string, area string, kind string, created_at string, current_status string, current_status_at string")
    statuses = spark.createDataFrame([("wl-1", "pending", "2000")], "item string, status string, at string")
    new = spark.createDataFrame(
        [(None, "Fix: the Thing!", "a", "bug", "pending", "2001-02-03T04:05:06"), ("wl-1", "again", "a", "bug", "done", "2001"), ("x", "x", None, "other", "done", "2001"), ("y", "y", None, "docs", "soon", "2001"), ("z", "z", None, "docs", None, "2001")],
        "item string, title string, area string, kind string, status string, at string",
    )
    more, said, refused = worklog.create(items, statuses, new)
    assert {r["item"] for r in more.collect()} == {"wl-1", "wl-fix-the-thing-20010203T04050"}
    assert rows(refused.select("item", "reason")) == [("wl-1", "id"), ("x", "kind"), ("y", "status"), ("z", "status")]
    changes = spark.createDataFrame([("wl-1", "done", "2002"), ("wl-1", "blocked", "2001"), ("none", "done", "2002"), ("wl-1", "bad", "2003")], "item string, status string, at string")
    shown, said = worklog.set_status(more, said, changes)
    assert rows(shown.where("item = 'wl-1'").select("current_status", "current_status_at")) == [("done", "2002")]
    assert said.where("item = 'wl-1'").count() == 3
    comments = spark.createDataFrame([("wl-1", 1, "2001.5"), ("wl-1", 2, "2005"), ("none", 3, "2005")], "item string, comment_id int, at string")
    assert rows(worklog.comment(said, comments).select("comment_id", "status")) == [(1, "done"), (2, "done")]
    assert rows(worklog.listed(shown, said, comments, area="a", kind="bug", status="done").select("item", "comments", "last_activity")) == [("wl-1", 2, "2005")]
    page = worklog.report(shown, said, comments)
    timeline = {r["item"]: r["timeline"] for r in page.collect()}["wl-1"]
    assert [(e["status"], [c["comment_id"] for c in e["comments"]]) for e in timeline] == [("pending", []), ("blocked", [1]), ("done", [2])]
    assert "## one" in render.worklog(page) and "cut to 1 rows" in render.worklog(page, 1)


def test_incremental(spark):
    assert [incremental.mode(None, None, "h"), incremental.mode(None, "h", "h"), incremental.mode(None, "g", "h"), incremental.mode(spark.range(1), "h", "h")] == ["full", "noop", "incremental", "live"]
    nodes = spark.createDataFrame([("F1", ["File"], "p1"), ("F2", ["File"], "p2"), ("f1", ["Function"], "p1"), ("f2", ["Function"], "p2"), ("n", ["Note"], None)], "node_id string, labels array<string>, path string")
    edges = spark.createDataFrame([("f1", "F1"), ("f2", "F2"), ("n", "F1"), ("n", "F2")], "src string, dst string")
    path = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    left, kept = incremental.wipe_paths(nodes, edges, path("p1"), path("p2"))
    assert rows(left.select("node_id")) == [("F1",), ("n",)] and rows(kept.select("src", "dst")) == [("n", "F1")]
    empty = path("x").limit(0)
    assert incremental.wipe_paths(nodes, edges, empty, empty)[0].count() == 5
    commits = spark.createDataFrame([("h", "m", "1"), ("WORKING-TREE", "old", "0")], "hash string, message string, timestamp string")
    parents = spark.createDataFrame([("g", "h"), ("g", "WORKING-TREE")], "src string, dst string")
    shows = spark.createDataFrame([("g", "w"), ("h", "w")], "src string, dst string")
    dirty = incremental.overlay(commits, parents, shows, "h", path("b", "a", "a"), F.lit("2"))
    assert rows(dirty[0].select("hash", "files")) == [("WORKING-TREE", "a\nb"), ("h", None)]
    assert rows(dirty[1]) == [("g", "h"), ("h", "WORKING-TREE")] and rows(dirty[2]) == [("WORKING-TREE", "w")]
    clean = incremental.overlay(commits, parents, shows, "h", empty, F.lit("2"))
    assert [rows(x) for x in (clean[0].select("hash"), clean[1], clean[2])] == [[("h",)], [("g", "h")], [("h", "w")]]


def test_links_and_files(spark):
    links = spark.createDataFrame([("d/x/a.md", h) for h in ("../b.rs#l", "./c.rs?q", "/top.rs", "../../../up.rs", "#a", "MAILTO:x", "gone.rs", "", None)], "doc_path string, href string")
    known = spark.createDataFrame([(p,) for p in ("d/b.rs", "d/x/c.rs", "top.rs", "up.rs", "d/x/")], "path string")
    assert rows(incremental.resolve_links(links, known).select("href", "path")) == [("../b.rs#l", "d/b.rs"), ("./c.rs?q", "d/x/c.rs"), ("/top.rs", "top.rs")]
    files = spark.createDataFrame([("a/b/x.rs", "1\n2\n"), ("a/y", ""), ("z.py", None)], "path string, text string")
    found, held = incremental.file_records(files, spark.createDataFrame([("p", "a"), ("q", "a/b")], "name string, path string"))
    assert rows(found.select("path", "extension", "lines")) == [("a/b/x.rs", "rs", 2), ("a/y", "", 0), ("z.py", "py", 0)]
    assert rows(held) == [("p", "a/y"), ("q", "a/b/x.rs")]


def test_watches_and_views(spark):
    nodes = spark.createDataFrame([("a", ["Function"], "x"), ("b", ["Function"], None)], "node_id string, labels array<string>, body string")
    watched = incremental.watch(nodes, nodes.select("node_id"), "body", "c", "2000")
    assert linkers.watch_triggers(watched.withColumn("body", F.concat("body", F.lit("!")))).count() == 1
    assert rows(incremental.unwatch(watched, nodes.where("node_id = 'a'")).select("node_id", F.array_contains("labels", "Watch"))) == [("a", False), ("b", True)]
    with pytest.raises(ValueError):
        incremental.watch(nodes, nodes.select("node_id").limit(0), "body", "c", "2000")
    views = spark.createDataFrame([], "name string, text string, description string, created_at string, updated_at string, last_run_at string")
    with pytest.raises(ValueError):
        annotations.save_view(views, "a b", "SELECT 1", "2000")
    said = spark.createDataFrame([("c1", "`f()`"), ("c2", "none"), ("c3", None)], "comment string, body string")
    fn = spark.createDataFrame([(f"i{k:02}", "f", f"m{k}::f") for k in range(30)], "node_id string, name string, qualified_name string")
    notes, edges = annotations.notes_from_comments(said, fn, "2000")
    assert rows(notes.select("node_id")) == [("note-2000-c1",)] and edges.count() == 10


def test_patterns_of_many_kinds(spark, monkeypatch):
    steps = spark.createDataFrame([(i, "Given" if i % 2 else "Then", f"text {i}") for i in range(40)], "step_id int, kind string, text string")
    patterns = spark.createDataFrame([("Given", 2, "text 1", "late"), ("Given", 1, "text 1$", "first"), ("Then", 3, "text [24]$", "then")], "kind string, ord int, pattern string, function string")
    want = [(1, "first"), (2, "then"), (4, "then")] + [(i, "late") for i in (11, 13, 15, 17, 19)]
    assert rows(linkers.first_regex_match(steps, patterns)) == sorted(want, key=repr)
    monkeypatch.setattr(linkers, "FEW_PATTERNS", 1)
    assert rows(linkers.first_regex_match(steps, patterns)) == sorted(want, key=repr)


def test_renderers_say_what_they_cut(spark):
    table = spark.range(5).select(F.col("id").cast("string").alias("node_id"), F.concat(F.lit("n"), "id").alias("slug"), F.lit("K").alias("kind"))
    links = spark.createDataFrame([("n0", "n1", "T"), ("n1", "n2", "T")], "src_slug string, dst_slug string, type string")
    assert render.markdown(table, 3).endswith("_cut to 3 rows_") and render.markdown(table, 5).endswith("_5 rows_")
    assert render.tsv(table, 3).endswith("# cut to 3 rows") and "cut" not in render.tsv(table)
    assert "%% cut to 2 rows" in render.mermaid(table, links, 2) and "// cut to 1 rows" in render.dot(table, links, 1)
    plain = links.select(F.col("src_slug").alias("src"), F.col("dst_slug").alias("dst"), "type")
    assert "nodes cut to 2 rows" in render.html(table, plain, limit=2) and "cut" not in render.html(table, plain)


def test_one_bad_file_stops_nothing(spark):
    texts = {"a/package.json": "[1]", "b/package.json": '{"name": "b", "dependencies": 3}', "c/package.json": '{"name": 7, "version": 1, "dependencies": {"x": 1}}', "Cargo.toml": "package = 3", "d/Cargo.toml": "[package]\nname = 3", "pyproject.toml": "project = 1", "e/pyproject.toml": "[project]\ndependencies = [3]", "ok/package.json": '{"name": "ok"}'}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    assert {r["package"] for r in manifests.manifests(files).collect()} >= {"ok"}
    assert manifests.workspace_members(files).collect() == []
    deep = "x = " + "(" * 3000 + ")" * 3000
    sources = spark.createDataFrame([("deep.py", deep), ("zero.py", "a\0b"), ("ok.py", "def f(): pass"), ("x.egg-info/no.py", "def no(): pass"), (".tox/no.py", "def no(): pass")], "path string, text string")
    assert {r["name"] for r in code.functions(sources).collect()} == {"f"}


def test_symbols_and_headings(spark):
    rust = "pub struct A {\n}\n  pub(crate) enum B { X }\ntrait C {}\ntype D = u8;\npub const E: u8 = 1;\nstatic mut F: u8 = 1;\nfn g() {}\n"
    files = spark.createDataFrame([("m.rs", rust), ("n.ts", "export default class K {}\nexport interface L {}\n")], "path string, text string")
    assert rows(code.symbols(files).select("name", "kind", "line")) == [("A", "Struct", 1), ("B", "Enum", 3), ("C", "Trait", 4), ("D", "TypeAlias", 5), ("E", "Const", 6), ("F", "Static", 7), ("K", "Struct", 1), ("L", "Trait", 2)]
    text = "Top\n===\n\nwords\n\nSub title\n---\n```\nNo\n---\n```\n# Mark #\n"
    heads = documents.markdown_sections(spark.createDataFrame([("a.md", text)], "path string, text string"))
    assert sorted(map(tuple, heads.select("line", "level", "heading").collect())) == [(1, 1, "Top"), (6, 2, "Sub title"), (12, 1, "Mark")]
    nested = spark.createDataFrame([("a.gql", "type A {\n  type: Int\n  enum Inner\n}\n  scalar No\n")], "path string, text string")
    assert [r["name"] for r in documents.graphql_types(nested).collect()] == ["A"]


def test_text_functions(spark):
    pick = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    texts = ["", "a", "foobar", "ü" * 50, None, "x" * 1000]

    def slow(x):
        h = scalars.FNV_BASIS
        for b in x.encode():
            h = (h ^ b) * scalars.FNV_PRIME & (1 << 64) - 1
        return h - (1 << 64) if h >> 63 else h

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", scalars.fnv1a_64(F.col("t")).alias("h")).collect()
    assert {r["i"]: r["h"] for r in got} == {i: None if t is None else slow(t) for i, t in enumerate(texts)}
    assert pick(scalars.escaped(F.lit("it's\n\\ \x01"))) == "'it\\'s\\n\\\\ \\u0001'"
    assert pick(scalars.rust_functions(F.lit("fn a() {}\npub fn b() {}\npub(crate) fn c() {}\n  fn no() {}"))) == ["a", "b", "c"]
    assert [pick(scalars.truncated(F.lit(x), 3)) for x in ("abc", "abcd")] == ["abc", "ab…"]
    replies = ('so:\n```JSON\n{"a": 1}\n```\n{', 'x {"a": {"b": 1}} y', "none")
    assert [pick(scalars.recovered_json(F.lit(x))) for x in replies] == ['{"a": 1}', '{"a": {"b": 1}}', None]
    assert json.loads(pick(scalars.recovered_json(F.lit(replies[1])))) == {"a": {"b": 1}}


def test_hashes_of_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "WHOLE", 2)
    seen = []
    run = lambda: live.watch(spark, f"{tmp_path}/in", f"{tmp_path}/state", f"{tmp_path}/cp", lambda b, n: seen.append(sorted(r["path"] for r in b.collect()))).awaitTermination(60)
    for n in range(5):
        events = [("a.rs", "same", f"2000-01-0{n + 1}"), (f"b{n % 2}.rs", str(n), f"2000-01-0{n + 1}")]
        spark.createDataFrame(events, "path string, content string, t string").select("path", "content", F.to_timestamp("t").alias("event_time")).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    assert seen == [["a.rs", "b0.rs"], ["b1.rs"], ["b0.rs"], ["b1.rs"], ["b0.rs"]]
    assert {p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("whole")} == {"whole=2", "whole=4"}


def test_address_of_notes(spark):
    nodes = spark.createDataFrame([("1", ["File"], "p", None), ("2", ["Function"], None, "q"), ("3", ["Other"], "p2", "q2")], "node_id string, labels array<string>, path string, qualified_name string")
    edges = spark.createDataFrame([("n", "1"), ("n", "2"), ("n", "3"), ("m", "2"), ("gone", "1")], "src string, dst string")
    notes = spark.createDataFrame([("n",), ("m",)], "node_id string")
    kept = incremental.note_addresses(notes, edges, nodes)
    assert rows(kept) == [("m", "Function", "q"), ("n", "File", "p"), ("n", "Function", "q")]
    again = spark.createDataFrame([("9", ["File"], "p", None)], "node_id string, labels array<string>, path string, qualified_name string")
    attached, orphans = incremental.reattach_notes(kept, again)
    assert rows(attached) == [("n", "9")] and rows(orphans) == [("m",)]


def test_targets_of_a_match(graph):
    assert rows(annotations.targets(graph, "MATCH (t:Function) WHERE t.line_start > $n", n=1)) == [("b",), ("t",)]
    for bad in ("MATCH (x:Function)", "RETURN 1 AS t", "MATCH (a)-[t:CALLS]->(b)"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            annotations.targets(graph, bad).collect()


def test_commits_by_hash_or_short_hash(spark):
    commits = spark.createDataFrame([("aa1", "aa", "1"), ("aa2", "aa", "2"), ("aa", "zz", "0")], "hash string, short_hash string, timestamp string")
    assert [rows(reports.resolve_commit(commits, k).select("hash")) for k in ("aa1", "aa", "zz", "none")] == [[("aa1",)], [("aa",)], [("aa",)], []]


def test_architecture_is_all_or_nothing(spark):
    names = "node_id string, labels array<string>"
    fn = spark.createDataFrame([("a", ["Function"]), ("b", ["Function"])], names)
    ends = lambda *x: spark.createDataFrame(list(x), "src string, dst string")
    g = Graph({"Function": fn}, {"CALLS": ends(("a", "b")), "DEFINED_IN": ends(("a", "f"), ("b", "h")), "CONTAINS": ends(("p", "f"), ("q", "h"))})
    packages = spark.createDataFrame([("p", "x/p", False), ("q", "x/q", False), ("ext", "", True)], "name string, path string, is_external boolean")
    told = []

    def planner(text):
        told.append(json.loads(text))
        return 'Plan:\n{"modules": [{"name": "core", "packages": ["p", "gone"], "layer_hint": 1}, {"name": "edge", "packages": ["q"]}], "uses": [{"from": "edge", "to": "core"}]}\nDone'

    modules, contains, uses = architecture.overlay(g, packages, planner)
    assert rows(modules.select("name", "layer_hint")) == [("core", 1), ("edge", 0)]
    assert rows(contains) == [("core", "p"), ("edge", "q")] and rows(uses) == [("edge", "core", "")]
    assert [p["name"] for p in told[0]["packages"]] == ["p", "q"] and told[0]["calls"] == [{"a": "p", "b": "q", "calls": 1}]
    for reply in ("no plan", "[1]", '{"modules": [{"name": ""}]}', '{"modules": [{"name": "a"}, {"name": "a"}]}', '{"modules": [{"name": "a"}], "uses": [{"from": "a", "to": "b"}]}'):
        with pytest.raises(ValueError):
            architecture.overlay(g, packages, lambda _, reply=reply: reply)


def test_orphans_are_found_without_the_edges_of_an_address(spark):
    """Half of the notes are on an address that 3000 nodes have: the orphans take none of the 3 000 000 edges."""
    notes = spark.range(2000).select(F.concat(F.lit("note"), "id").alias("note"), F.lit("File").alias("label"), F.when(F.col("id") % 2 == 0, "many").otherwise("gone").alias("key"))
    nodes = spark.range(3000).select(F.concat(F.lit("f"), "id").alias("node_id"), F.array(F.lit("File")).alias("labels"), F.lit("many").alias("path"))
    orphans = incremental.reattach_notes(notes, nodes)[1]
    assert sorted(r["note"] for r in orphans.collect()) == sorted(f"note{i}" for i in range(1, 2000, 2))
    assert "node_id" not in orphans._jdf.queryExecution().optimizedPlan().toString()
