"""Extractors against slow parsers that go line by line."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from brambleweft.operators import scans
from brambleweft.sources import api_documents, documents


@pytest.fixture(autouse=True, params=[2, 4096])
def blocks(request, monkeypatch):
    """Files are cut into many blocks, or are one."""
    monkeypatch.setattr(scans, "BLOCK", request.param)


def files(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "path long, text string").select(F.col("path").cast("string").alias("path"), "text")


def numbered(text):
    text = (text or "").replace("\r", "")
    return [] if text is None else list(enumerate(re.sub("\n$", "", text).split("\n"), 1))


def slow_markdown(text):
    """(sections, spans) of one page."""
    fence, heads, spans, head, kept = None, [], [], None, []
    for n, line in numbered(text):
        m = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", line)
        info = m[2].strip() if m else ""
        inside, own = fence, False
        if fence is None:
            if m and not (m[1][0] == "`" and "`" in info):
                fence, own = (m[1][0], len(m[1]), info), True
        elif m and m[1][0] == fence[0] and len(m[1]) >= fence[1] and not info:
            fence, own = None, True
        kept.append((n, line, inside is not None or own, inside is not None and not own and inside[2] == "rust"))
    for k, (n, line, fenced, rust) in enumerate(kept):
        level, heading = None, None
        mark = re.match(r" {0,3}(#{1,6})(?:\s|$)", line)
        if not fenced and mark:
            level, heading = len(mark[1]), re.sub(r"^ {0,3}#+\s*|(^|\s+)#+\s*$", "", line).strip(" ")
        elif not fenced and re.match(r" {0,3}[^\s#>*+-]", line) and k + 1 < len(kept) and not kept[k + 1][2]:
            below = kept[k + 1][1]
            level = 1 if re.fullmatch(r" {0,3}=+\s*", below) else 2 if re.fullmatch(r" {0,3}-+\s*", below) else None
            heading = line.strip(" ")
        if level:
            heads.append((n, level, heading))
            head = n
        if head:
            found = [s.strip(" ") for s in re.findall("`([^`]+)`", line)] if not fenced else re.findall(r"^\s*(?:pub(?:\(crate\))? )?fn (\w+)", line) if rust else []
            spans += [(n, head, s) for s in found if s]
    return heads, spans


def test_markdown_line_by_line(spark):
    r = random.Random(6)
    parts = ["# A", "## B ##", "```", "~~~", "````", "~~~~", "```rust", "~~~ rust", "``` a`b", "    ```", "  ```", "text `x` and `y z`", "===", "---", "fn f() {}", "pub fn g", "  pub(crate) fn h(", "", "- a", "#no", "`q`", "####### no", "# "]
    texts = ["\n".join(r.choice(parts) for _ in range(r.randint(0, 25))) + r.choice(["", "\n"]) for _ in range(250)] + [None, "", "\n", "# x\r\ny\r\n---\r\n", "`" * 40 + "\n# in\n" + "`" * 50 + "\n# out"]
    f = files(spark, texts)
    heads, spans = {}, {}
    for x in documents.markdown_sections(f).collect():
        heads.setdefault(x["path"], []).append((x["line"], x["level"], x["heading"]))
    for x in documents.markdown_spans(f).collect():
        spans.setdefault(x["path"], []).append((x["line"], x["heading_line"], x["token"]))
    for i, text in enumerate(texts):
        want = slow_markdown(text)
        assert (sorted(heads.get(str(i), [])), sorted(spans.get(str(i), []))) == (want[0], sorted(want[1])), text


def slow_gherkin(text):
    """(titles, steps) of one file."""
    titles, steps, tags, feature, scenario, kind, order, inside = [], [], [], None, None, None, 0, False
    for n, line in numbered(text):
        line = line.strip()
        if line in ('"""', "```"):
            inside = not inside
            continue
        if inside or not line or line[0] in "#|":
            continue
        if line[0] == "@":
            tags += [w[1:] for w in line.split() if w[0] == "@"]
        elif m := re.match("(Feature|Rule):(.*)", line):
            feature, scenario = m[2].strip(), None
            titles.append((n, "Feature", feature, feature, ",".join(tags)))
            tags = []
        elif m := re.match("(Scenario|Scenario Outline|Example|Background):(.*)", line):
            scenario, kind, order = m[2].strip(), None, 0
            titles.append((n, "Scenario", feature, scenario, ",".join(tags)))
            tags = []
        elif (m := re.match(r"(Given|When|Then|And|But|\*)\s+(.*)", line)) and scenario is not None:
            kind = m[1] if m[1] in ("Given", "When", "Then") else kind
            order += 1
            steps.append((n, feature, scenario, order, kind or "Given", m[2]))
    return titles, steps


@pytest.mark.parametrize("short", [0, 12, 512])
def test_gherkin_line_by_line(spark, monkeypatch, short):
    monkeypatch.setattr(documents, "SHORT", short)
    r = random.Random(7)
    parts = ["Feature: F", "Rule: R", "Scenario: S", " Scenario Outline: O", "Background:", "Example: E", "@a @b", "@c", "@d not", " Given x", "When y", "\tThen z", "And more", "But less", "* star", "Givenchy", '"""', "```", '"""json', "| a |", "# c", "", "free text", "Given"]
    texts = ["\n".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(250)] + [None, ""]
    f = files(spark, texts)
    titles, steps = {}, {}
    for x in documents.gherkin_titles(f).collect():
        titles.setdefault(x["path"], []).append((x["line"], x["kind"], x["feature"], x["name"], x["tags"]))
    for x in documents.gherkin_steps(f).collect():
        steps.setdefault(x["path"], []).append((x["line"], x["feature"], x["scenario"], x["step_order"], x["kind"], x["text"]))
    for i, text in enumerate(texts):
        assert (sorted(titles.get(str(i), [])), sorted(steps.get(str(i), []))) == slow_gherkin(text), text


def test_short_features_are_not_shuffled(spark, tmp_path):
    files(spark, ["Feature: F\nScenario: S\nGiven x"]).write.parquet(f"{tmp_path}/f")
    f = spark.read.parquet(f"{tmp_path}/f")
    for read in (documents.gherkin_titles, documents.gherkin_steps):
        short = documents._walked(f, read is documents.gherkin_titles)
        assert "Exchange" not in short._jdf.queryExecution().executedPlan().toString() and short.count() > 0


def test_automaton_of_any_kind(spark):
    """A counter modulo three with a reset, over lines of which some have no symbol."""
    r = random.Random(8)
    rows = [(str(f), i, r.choice([None, 0, 1, 2])) for f in range(4) for i in range(1, 30)]
    frame = spark.createDataFrame(rows, "path string, line long, s int")
    step = lambda state, s: F.when(s == 0, 0).otherwise((state + s) % 3).cast("int")
    got = {(x["path"], x["line"]): (x["before"], x["after"]) for x in scans.automaton(frame, F.col("s"), step, [0, 1, 2], 1).collect()}
    for f in range(4):
        state = 1
        for path, line, s in rows:
            if path == str(f) and s is not None:
                before, state = state, 0 if s == 0 else (state + s) % 3
                assert got.pop((path, line)) == (before, state)
    assert not got


def test_openapi_documents(spark):
    ref = lambda name: {"$ref": f"#/definitions/{name}"}
    good = {"paths": {"/a": {"parameters": [{"a": 1}], "get": {"operationId": "g", "tags": ["x", 2, "y"], "body": [ref("A"), {"z": ref("B")}]}, "Put": {"summary": 5}, "x-y": 3}, "/b": [], "/c": {"post": None}}, "definitions": {"A": {"properties": {"b": ref("B"), "n": {"type": "integer"}, "o": {"$ref": 5}}}, "B": {"items": ref("A")}, "C": {"type": 7}}}
    texts = [json.dumps(good), "not json", None, "[]", json.dumps({"paths": [1]}), json.dumps({"paths": {"/a": 1}})]
    f = files(spark, texts)
    rows = lambda frame: sorted((tuple(x)[1:] for x in frame.where("path = '0'").collect()), key=str)
    assert rows(api_documents.openapi_endpoints(f)) == [("/a", "GET", "g", "", "x, y"), ("/a", "PUT", "", "", ""), ("/c", "POST", "", "", "")]
    assert api_documents.openapi_endpoints(f).where("path <> '0'").collect() == []
    assert rows(api_documents.openapi_schemas(f)) == [("A", 0, "b", "B"), ("A", 1, "n", "integer"), ("A", 2, "o", "any"), ("B", None, None, None), ("C", None, None, None)]
    assert rows(api_documents.openapi_types(f)) == [("A", "object"), ("B", "object"), ("C", "object")]
    assert rows(api_documents.openapi_references(f)) == [("/a", "GET", "A"), ("/a", "GET", "B")]
    assert rows(api_documents.openapi_closure(f)) == [("/a", "GET", "A", 1), ("/a", "GET", "B", 1)]
