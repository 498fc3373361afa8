import json

import pytest
from pyspark.sql import functions as F

from brambleweft.functions import scalars
from brambleweft.operators import annotations, bdd, mutate, render, reports
from brambleweft.plans import projection
from brambleweft.sources import api_documents, code, documents, manifests
from brambleweft.streaming import live


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/").replace("_", "."), v) for k, v in texts.items()], "path string, text string")


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()["x"]
    assert pick(scalars.fnv1a_64(F.lit(""))) & (1 << 64) - 1 == scalars.FNV_BASIS
    assert pick(scalars.slug(F.lit("Hello, World_2!"))) == "hello-world_2"
    assert pick(scalars.backtick_tokens(F.lit("see `foo()` and ```\n`no`\n``` `a::b` `x y`"))) == ["foo", "a::b"]
    assert pick(scalars.worklog_refs(F.lit("subject\n refs: wl-1, wl-2\nRefs: wl-1"))) == ["wl-1", "wl-2"]
    assert pick(scalars.module_prefix(F.lit("pkg"), F.lit("crates/pkg/src/a/mod.rs"))) == "pkg::a"
    assert pick(scalars.iso_micros(F.lit(946684800123456))) == "2000-01-01T00:00:00.123456Z"
    assert scalars.format_bytes(2048) == "2.0 KiB" and scalars.safe_ident("a_1") and not scalars.safe_name("a b")


def test_markdown_and_gherkin(spark):
    text = "before `x`\n# Top\ncode `a::b`\n```\n# not a heading `no`\n```\n## Top\n`c`\n"
    f = files(spark, a_md=text)
    assert [(r["line"], r["level"], r["slug"]) for r in documents.markdown_sections(f).orderBy("line").collect()] == [(2, 1, "top"), (7, 2, "top-1")]
    assert [(r["token"], r["heading_line"]) for r in documents.markdown_spans(f).orderBy("line").collect()] == [("a::b", 2), ("c", 7)]
    feature = '@tag\nFeature: F\n Scenario: S\n  Given a\n  And b\n  """\n  When no\n  """\n  | x |\n  Then c\n  * d\n Scenario: T\n  But e\n'
    steps = [(r["scenario"], r["step_order"], r["kind"], r["text"]) for r in documents.gherkin_steps(files(spark, a_feature=feature)).orderBy("line").collect()]
    assert steps == [("S", 1, "Given", "a"), ("S", 2, "Given", "b"), ("S", 3, "Then", "c"), ("S", 4, "Then", "d"), ("T", 1, "Given", "e")]


def test_schemas_and_manifests(spark):
    spec = json.dumps({"paths": {"/a": {"get": {"operationId": "getA"}, "x-y": {}}}})
    assert [tuple(r)[1:4] for r in api_documents.openapi_endpoints(files(spark, a_json=spec)).collect()] == [("/a", "GET", "getA")]
    assert [r["name"] for r in documents.graphql_types(files(spark, a_gql="type A {\n x: Int\n}\nenum B { C }")).collect()] == ["A", "B"]
    assert [r["kind"] for r in documents.proto_items(files(spark, a_proto="service S {\n rpc Get(A) returns (B);\n}\nmessage A {}")).collect()] == ["service", "rpc", "message"]
    rows = manifests.manifests(files(spark, x__Cargo_toml='[package]\nname = "p"\nversion = "1"\n[dependencies]\nserde = "1"\n[dev-dependencies]\nq = "1"', go_mod="module m\ngo 1.2\nrequire (\n a/b v1 // c\n)\nrequire x v2", package_json="{broken"))
    assert {(r["package"], r["dependency"], r["kind"]) for r in rows.collect()} == {("p", None, None), ("p", "serde", "Normal"), ("p", "q", "Dev"), ("m", None, None), ("m", "a/b", "Normal"), ("m", "x", "Normal")}


def test_code(spark):
    f = files(spark, g_py="def hello():\n    pass\n\ndef shout():\n    return hello()\n", m_rs="fn add(a: i32) -> i32 {\n  a\n}\n#[test]\npub fn double() {\n  add(1);\n}\n", target__x_py="def no(): pass")
    found = code.functions(f)
    assert {r["name"]: r["line_start"] for r in found.collect()} == {"hello": 1, "shout": 4, "add": 1, "double": 4}
    assert {(r["src"], r["dst"]) for r in code.calls(found).collect()} == {("g.py::shout", "g.py::hello"), ("m.rs::double", "m.rs::add")}


def test_store_and_annotations(spark, tmp_path):
    store = mutate.Store(spark, f"file://{tmp_path}/store")
    a = spark.createDataFrame([("x", 1)], "node_id string, v int")
    store.write("t", a)
    store.begin()
    store.write("t", a.limit(0))
    store.rollback()
    assert store.read("t").count() == 1
    store.begin()
    store.write("t", mutate.merge_rows(store.read("t"), spark.createDataFrame([("x", 2), ("y", 2), ("y", 2)], "node_id string, v int"), ["node_id"]))
    store.commit()
    assert sorted(map(tuple, store.read("t").collect())) == [("x", 1), ("y", 2)]
    note, edges = annotations.write_note(a, "text", "2000")
    assert note.count() == edges.count() == 1
    with pytest.raises(ValueError):
        annotations.write_note(a.limit(0), "text", "2000")
    empty = spark.createDataFrame([], "name string, description string, created_at string, updated_at string"), spark.createDataFrame([], "src string, dst string")
    one = annotations.define_concept(*empty, "c", a, "2000")
    two = annotations.define_concept(*one, "c", a, "2001", "d")
    assert [tuple(r) for r in annotations.list_concepts(*two).collect()] == [("c", "d", "2000", 1)]
    fn = spark.createDataFrame([("i", "foo", "m::foo")], "node_id string, name string, qualified_name string")
    said = spark.createDataFrame([(1, "`foo()` and `m::foo`"), (2, "none")], "comment int, body string")
    assert annotations.import_comments(said, fn).collect() == [(1, "i")]


def test_longest_prefix_and_rendering(spark):
    rows = spark.createDataFrame([("a/b/c.rs",), ("z.rs",)], "path string")
    got = reports.longest_prefix(rows, "path", spark.createDataFrame([("a",), ("a/b",)], "pkg string"), "pkg")
    assert {r["path"]: r["pkg"] for r in got.collect()} == {"a/b/c.rs": "a/b", "z.rs": None}
    table = spark.createDataFrame([("a|b", None)], "x string, y string")
    assert render.markdown(table).splitlines()[2] == "| a\\|b | — |" and render.tsv(table) == 'x\ty\n"a|b"\tnull'


def test_live(spark, tmp_path):
    seen = []
    run = lambda: live.watch(spark, f"{tmp_path}/in", f"{tmp_path}/state", f"{tmp_path}/cp", lambda b, n: seen.append(sorted(r["path"] for r in b.collect()))).awaitTermination(60)
    drop = lambda *rows: spark.createDataFrame(list(rows), "path string, content string, t string").select("path", "content", F.to_timestamp("t").alias("event_time")).write.mode("append").parquet(f"{tmp_path}/in")
    drop(("a.rs", "1", "2000-01-01"), ("b.go", "1", "2000-01-01"), (".git/x.rs", "1", "2000-01-01"))
    run()
    drop(("a.rs", "1", "2000-01-02"), ("b.go", "2", "2000-01-02"))
    run()
    assert seen == [["a.rs", "b.go"], ["b.go"]]


def test_entry_module_lists_queries_with_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_escaped_pipes(spark):
    row = spark.createDataFrame([(" a|b \nc", "x|y\nz")], "body string, cell string")
    assert tuple(row.select(scalars.first_line(F.col("body")), scalars.markdown_cell(F.col("cell"))).first()) == ("a\\|b", "x\\|y z")


def test_more_extractors(spark):
    spec = json.dumps({
        "paths": {"/a": {"get": {"responses": {"200": {"schema": {"$ref": "#/components/schemas/A"}}}}, "x-y": {}}},
        "components": {"schemas": {"A": {"properties": {"n": {"type": "integer"}, "b": {"$ref": "#/components/schemas/B"}, "c": {}}}, "B": {}}},
    })
    f = files(spark, a_json=spec)
    assert [tuple(r)[1:] for r in api_documents.openapi_schemas(f).orderBy("schema", "position").collect()] == [("A", 0, "b", "B"), ("A", 1, "c", "any"), ("A", 2, "n", "integer"), ("B", None, None, None)]
    assert [tuple(r)[1:] for r in api_documents.openapi_references(f).collect()] == [("/a", "GET", "A")]
    rust = '#[given(regex = r"^a (\\d+)$")]\nasync fn one() {}\n#[when("b")]\n#[allow(x)]\npub fn two() {}\nmod m {\n    #[then("no")]\n    fn three() {}\n}\n'
    assert [tuple(r)[1:] for r in documents.step_patterns(files(spark, s_rs=rust)).collect()] == [("Given", "^a (\\d+)$", "one"), ("When", "b", "two")]
    said = documents.review_comments(files(spark, c_json='[{"author": "x", "body": "b", "url": null}, {"body": "d"}]'))
    assert [tuple(r)[1:4] for r in said.orderBy("comment").collect()] == [(0, "x", "b"), (1, None, "d")]
    status = spark.createDataFrame([(" M a b.rs",), ("?? c.rs",), ("",)], "record string")
    assert sorted(r["path"] for r in documents.dirty_files(status).collect()) == ["a b.rs", "c.rs"]


def test_workspaces(spark):
    rows = [
        ("Cargo.toml", '[workspace]\nmembers = ["crates/a", "crates/none"]'),
        ("crates/a/Cargo.toml", '[package]\nname = "a"'),
        ("web/package.json", '{"workspaces": ["packages/*", "app"]}'),
        ("web/packages/x/package.json", "{}"),
        ("web/packages/x/deep/package.json", "{}"),
        ("web/app/package.json", '{"workspaces": {"packages": []}}'),
        ("bad/package.json", "[1"),
        ("list/package.json", "[]"),
    ]
    got = manifests.workspace_members(spark.createDataFrame(rows, "path string, text string"))
    assert {tuple(r) for r in got.collect()} == {("Cargo.toml", "crates/a/Cargo.toml"), ("web/package.json", "web/packages/x/package.json"), ("web/package.json", "web/app/package.json")}
    assert manifests.project_kind({"go.mod", "setup.py"}) == "Python" and manifests.project_kind(set()) == "Rust"


def test_bdd_and_pages(spark):
    steps = spark.createDataFrame([("p", "f", "s", "1", None), ("p", "f", "s", "2", "fn"), (None, "g", "t", "3", None)], "package string, feature string, scenario string, step string, function string")
    nodes, edges = bdd.bdd_graph(steps)
    assert nodes.count() == 9 and {(r["src"], r["dst"]) for r in edges.collect()} == {("p", "f"), ("f", "s"), ("s", "1"), ("s", "2"), ("2", "fn"), ("g", "t"), ("t", "3")}
    named = steps.withColumnRenamed("step", "step_id")
    assert [tuple(r) for r in bdd.unimplemented_steps(named, named.where("function is not null")).collect()] == [("s", 1), ("t", 1)]
    page = render.html(nodes.limit(0).union(spark.createDataFrame([("X", "</script>")], "a string, b string")), edges)
    assert page.count("</script>") == 1 and "<td>f</td>" in page
    note = spark.createDataFrame([("n1", None, "me", "1", "old"), ("n2", "T", "me", "2", "new")], "node_id string, title string, author string, created_at string, markdown string")
    assert render.notes(note).startswith("### T\n\n_me, 2_\n\nnew\n\n### n1") and render.notes(note.limit(0)) == "_no notes_"
    items = spark.createDataFrame([("A", "pending", "i"), ("A", "pending", "j"), ("B", "done", "k")], "area string, status string, item string").coalesce(1)
    assert render.roadmap(items) == "# Roadmap\n\n## A\n\n### pending\n\n- i\n- j\n\n## B\n\n### done\n\n- k\n"
    assert render.envelope("x", True)["isError"]


def test_mentions_find_every_passage(spark):
    words = [f"w{i}" for i in range(30)]
    passages = {0: " ".join(words[2:14]), 1: "w5", 2: " ".join(words[0:10]), 3: " ".join(words[3:12]) + " other", 4: "4 w5 w6 w7 w8 w9 w10 w11 w12 w1"}
    texts = {1: " ".join(words), 2: "x" + " ".join(words[0:10]) + "y", 3: "", 4: None, 5: " ".join(words[0:15]) + "\n" + " ".join(words[0:15])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(passages.items()), "item_id long, passage string")
    want = {(d, i) for d, t in texts.items() for i, p in passages.items() if t is not None and p in t}
    got = [tuple(r) for r in projection.mentions(docs, items).collect()]
    assert set(got) == want and len(got) == len(want) and (1, 4) in want


def test_every_mention_is_resolved(spark):
    from brambleweft.plans import queries

    sf = "/root/testdata/sf0.001"
    part, line = spark.read.parquet(f"{sf}/part.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet")
    got = queries.QUERIES["mention_resolution_all"](spark, sf)
    known = line.join(part, line["l_partkey"] == part["p_partkey"], "left_semi")
    assert got.where("token like 'part::%'").count() == known.count() > 5000
    assert got.where("token not like 'part::%'").count() == part.count()
    assert got.where("token like 'part::%' and token <> target").count() == 0


def test_diff_along_a_long_chain(spark, tmp_path):
    import os

    from brambleweft.plans import queries

    sf = "/root/testdata/sf0.001"
    for name in os.listdir(sf):
        if name != "orders.parquet":
            os.symlink(f"{sf}/{name}", tmp_path / name)
    hot = F.when(F.col("o_orderkey") % 3 == 1, 1).otherwise(F.col("o_custkey")).cast("long").alias("o_custkey")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.select(*[hot if c == "o_custkey" else F.col(c) for c in orders.columns]).write.parquet(str(tmp_path / "orders.parquet"))
    chain = sorted((r["o_orderdate"], r["o_orderkey"]) for r in spark.read.parquet(str(tmp_path / "orders.parquet")).where("o_custkey = 1").collect())
    keys = [str(k) for _, k in chain]
    later = keys[keys.index("10") + 1 :]
    assert len(later) > 64
    assert sorted(r["hash"] for r in queries.QUERIES["diff_dag"](spark, str(tmp_path)).collect()) == sorted(later)
    g = projection.project(spark, str(tmp_path))
    assert sorted(r["hash"] for r in reports.diff_since(g, "10", later[-3], "dag").collect()) == sorted(later[:-2])
    assert reports.diff_since(g, later[0], "10", "dag").collect() == []


def test_reach_without_bound(spark):
    from brambleweft.plans import pattern

    steps = [(i, i + 1) for i in range(100)] + [(10, 50), (50, 10), (200, 201), (7, 7)]
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in steps], "src string, dst string")
    reached = lambda at, way: {int(r["node_id"]) for r in pattern.reach_all(spark.createDataFrame([(at,)], "node_id string"), edges, way).collect()}
    assert reached("20", "out") == set(range(10, 101)) - {20} and reached("3", "in") == {0, 1, 2} and reached("100", "out") == set()
