"""Regex joins, links by name and the log source against slow versions."""

import io
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brambleweft.operators import linkers, names, patterns
from brambleweft.sources import log_records


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        ("^a step$", ["a step"]), ("ab+cd*e", ["ab", "c", "e"]), (r"x\.y\d+z", ["x.y", "z"]), ("a(b|c)d", ["a", "d"]), ("a|b", []), ("(?i)abc", []), ("[abc]]d", ["]d"]), ("[]x]y", ["y"]),
        (r"\p{L}word\x41k", ["word", "k"]), ("ab{2,3}c", ["a", "c"]), ("a.b?c", ["a", "c"]), ("(?:abc)def", ["def"]), (r"\Qa\E", []), ("", []), (r"a\\b", ["a\\b"]), ("[^a[bc]]d", ["d"]),
    ],
)
def test_literals_that_every_match_has(pattern, literals):
    assert patterns.required_literals(pattern) == literals


@pytest.mark.parametrize(
    ("pattern", "head"),
    [
        ("^a step$", "a step"), ("a step", None), (r"^x\.y\d+z", "x.y"), ("^abc?d", None), ("^abcd?", "abc"), ("^a?abc", None), ("^(a|b)cde", None), ("^*abc", None), ("^abc|def", None),
        ("(?m)^abc", None), (r"^\d+abc", None), ("^.abc", None), ("^abcd*", "abc"), ("^[a]bcd", None), (r"^\(at\) (x|y)", "(at) "), ("^^abc", None), ("^", None), (r"^a\\bc", "a\\bc"),
    ],
)
def test_beginnings_that_every_match_has(pattern, head):
    found = patterns.beginning(pattern)
    assert (found and found[0]) == head


def test_literals_are_in_every_match():
    r = random.Random(3)
    parts = ["a", "b", "ab", "c?", "d*", "e+", "(f|g)", "[hi]", ".", r"\d", r"\.", "x{1,2}", "^", "$", r"\bz"]
    hits = 0
    for _ in range(4000):
        p = "".join(r.choice(parts) for _ in range(r.randint(1, 5)))
        text = "".join(r.choice("abcdefghi.x12z ") for _ in range(12))
        if m := re.search(p, text):
            hits += 1
            assert all(x in m[0] for x in patterns.required_literals(p)), (p, m[0])
            assert text.startswith((patterns.beginning(p) or [""])[0]), (p, text)
    assert hits > 500


def made(r, n_steps, n_patterns):
    word = lambda: r.choice(["alpha", "beta", "gamma", "delta", "42", "x", "the user", "logs in"])
    steps = [(f"s{i}", r.choice(["Given", "When"]), " ".join(word() for _ in range(r.randint(0, 5))) or r.choice(["", None])) for i in range(n_steps)]
    rules = []
    for o in range(n_patterns):
        p = r.choice(["^{} {}", "{}.*{}$", "({}|{})", "{} {}?", r"\b{}\b \d+", "", "{}[", None, "(?i){}", "^{} {}", "^{}.*{}"])
        rules.append((r.choice(["Given", "When"]), o, p and p.replace("{}", word(), 1).replace("{}", word()), f"f{o}"))
    return steps, rules


@pytest.mark.parametrize("rare", [1, 20, 1000])
def test_first_matches_against_every_pair(spark, monkeypatch, rare):
    monkeypatch.setattr(patterns, "RARE", rare)
    r = random.Random(5)
    steps, rules = made(r, 150, 260)

    def good(p):
        try:
            return p is not None and re.compile(p)
        except re.error:
            return None

    want = {}
    for s, kind, text in steps:
        for k, _, p, f in rules:
            if text is not None and k == kind and good(p) and re.search(p, text):
                want[s] = f
                break
    frames = spark.createDataFrame(steps, "step_id string, kind string, text string"), spark.createDataFrame(rules, "kind string, ord int, pattern string, function string")
    assert len(rules) > linkers.FEW_PATTERNS
    assert {x["step_id"]: x["function"] for x in linkers.first_regex_match(*frames).collect()} == want


def test_pairs_without_a_literal_in_common_are_not_compared(spark):
    steps = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("step_id"), F.lit("Given").alias("kind"), F.concat(F.lit("user number "), F.format_string("%05d", "id"), F.lit(" logs in")).alias("text"))
    rules = spark.range(2000).select(F.lit("Given").alias("kind"), F.col("id").alias("ord"), F.concat(F.lit("^user number "), F.format_string("%05d", "id"), F.lit(" logs (in|out)$")).alias("pattern"), F.concat(F.lit("f"), "id").alias("function"))
    pairs = patterns.candidates(steps, rules)
    # Of four million pairs; a run of three figures is shared by few.
    assert 2000 <= pairs.count() < 100_000
    # A whole beginning is shared by none.
    assert pairs.count() == 2000
    assert linkers.first_regex_match(steps, rules).where("substr(step_id, 2) = substr(function, 2)").count() == 2000


@pytest.mark.parametrize("heavy", [1, 10])
def test_links_by_name_against_every_pair(spark, monkeypatch, heavy):
    monkeypatch.setattr(names, "HEAVY", heavy)
    r = random.Random(heavy)
    name = lambda: "hot" if r.random() < 0.4 else r.choice(["a", "b", "c", "d", None])
    package = lambda: r.choice(["p", "q", "r", None])
    sites = [(f"s{i % 110}", package(), name()) for i in range(120)]
    definitions = [(f"d{i % 35}", package(), name()) for i in range(40)]
    want = Counter()
    for s, p, n in sites:
        same = {(d, n) for d, dp, dn in definitions if dn == n and dp == p and n and p}
        for d, _ in same or {(d, n) for d, _, dn in definitions if dn == n and n}:
            want[(s, n, d, bool(same))] += 1
    got = names.link(spark.createDataFrame(sites, "src string, package string, name string"), spark.createDataFrame(definitions, "node_id string, package string, name string"))
    assert Counter(map(tuple, got.collect())) == want
    summed = names.count_links(spark.createDataFrame(sites, "src string, package string, name string"), spark.createDataFrame(definitions, "node_id string, package string, name string"))
    each = [(s, n, len(ds), min(ds), bool(same)) for s, p, n in sites if n for same in [{d for d, dp, dn in definitions if dn == n and dp == p and p}] if (ds := same or {d for d, _, dn in definitions if dn == n})]
    assert Counter(map(tuple, summed.collect())) == Counter(each)
    assert "hot" in names.heavy_names(spark.createDataFrame(sites, "src string, package string, name string").where("name is not null"))


def test_links_are_counted_without_making_the_pairs(spark):
    """400 000 000 pairs of one name: the counts come from the definitions' counts."""
    sites = spark.range(20000).select(F.col("id").cast("string").alias("src"), F.lit("p").alias("package"), F.lit("hot").alias("name"))
    definitions = sites.select(F.col("src").alias("node_id"), "package", "name")
    counted = names.count_links(sites, definitions)
    assert {tuple(r) for r in counted.select("links", "least", "local").distinct().collect()} == {(20000, "0", True)} and counted.count() == 20000
    rows = [m.value() for m in _metrics(counted)]
    assert max(rows) < 1_000_000


def _metrics(frame):
    """Numbers of rows that the steps of a frame's last run put out."""
    frame.collect()
    todo, found = [frame._jdf.queryExecution().executedPlan()], []
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(plan.plan())
        if plan.metrics().contains("numOutputRows"):
            found.append(plan.metrics().apply("numOutputRows"))
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def test_ranges_of_a_log_hold_each_record_once(tmp_path):
    r = random.Random(1)
    for _ in range(60):
        rows = [bytes(r.choice(b"abc\x1f") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 12))]
        data = b"\x1e".join(rows) + (b"\x1e" if rows and r.random() < 0.5 else b"")
        want = data.split(b"\x1e")
        want = want[:-1] if want[-1] == b"" else want
        size = r.randint(1, 9)
        log_records.CHUNK, kept = r.randint(1, 5), log_records.CHUNK
        try:
            got = [x for a in range(0, len(data), size) for x in log_records.records(io.BytesIO(data), a, min(a + size, len(data)))]
        finally:
            log_records.CHUNK = kept
        assert got == want, (data, size)


def test_filters_reach_the_log_source(spark, tmp_path):
    rows = [(f"h{i}", f"h{i}", "", "me" if i % 2 else "you", None, f"2000-01-{i:02d}", f"subject {i}\n\nRefs: wl-{i}") for i in range(1, 29)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in log_records.COLUMNS)).repartition(3)
    log_records.write_log(frame, f"file://{tmp_path}/log")
    log = log_records.read_log(spark, f"{tmp_path}/log", size=100)
    back = sorted(map(tuple, log.collect()))
    assert back == sorted(tuple(x or "" for x in row) for row in rows) and log.rdd.getNumPartitions() > 10
    later = log.where((F.col("timestamp") >= "2000-01-10") & (F.col("author") == "me") & F.col("message").contains("2"))
    assert sorted(r["hash"] for r in later.collect()) == sorted(f"h{i}" for i in range(10, 29) if i % 2 and "2" in f"subject {i}\n\nRefs: wl-{i}")
    broken = spark.createDataFrame([("too few\x1ffields",), ("",)], "value string")
    broken.write.option("lineSep", "\x1e").text(f"file://{tmp_path}/broken")
    assert log_records.read_log(spark, f"{tmp_path}/broken").collect() == []


def test_the_reader_takes_comparisons_and_leaves_the_rest():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    reader = log_records.LogReader({"path": "/x"})
    given = [EqualTo(("hash",), "a"), GreaterThan(("timestamp",), "2000"), EqualTo(("message",), "m"), StringContains(("hash",), "b")]
    assert list(reader.pushFilters(given)) == given[2:]
    assert [(t[0], t[2]) for t in reader.tests] == [(0, "a"), (5, "2000")]
