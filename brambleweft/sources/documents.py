"""Extractors over text columns: Markdown, Gherkin, API schemas, links, git logs.

Line-oriented formats explode into numbered lines. What a line inherits from
those before it (is it in a fence, under which heading, in which scenario) is a
scan in blocks of lines, see ``operators.scans``, so a file of any length is
spread over tasks. Gherkin files of few lines are walked in their own row, so
that nothing of them is shuffled.

Defined results: a null text has no lines; carriage returns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import slug
from ..operators import scans


def lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, text): numbered lines from 1, without carriage returns or a last empty one."""
    each = files.select(F.col(path).alias("path"), F.posexplode(F.split(_clean(text), "\n")).alias("line", "text"))
    return each.select("path", (F.col("line") + 1).alias("line"), "text")


def local_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, href) of links that are neither anchors nor absolute."""
    hrefs = pages.select(key, F.explode(F.regexp_extract_all("text", F.lit('href="([^"]+)"'), 1)).alias("href"))
    return hrefs.where(~F.col("href").rlike("^(#|https?:|mailto:)"))


#: A fence of more marks counts as one of so many.
LONGEST_FENCE = 32
#: Added to the state of a fence whose first word names a language that is read.
READ = 1000


def _fence(language: str) -> Column:
    """What a line is to fences: marks' kind (100 or 200) plus their number, READ more for a language, negative if it can close one too; else null."""
    found = F.regexp_extract("text", "^ {0,3}(`{3,}|~{3,})", 1)
    info = F.trim(F.regexp_replace("text", "^ {0,3}(`{3,}|~{3,})", ""))
    number = F.when(found.startswith("`"), 100).otherwise(200) + F.least(F.length(found), F.lit(LONGEST_FENCE))
    opens = (found != "") & ~(found.startswith("`") & F.contains(info, F.lit("`")))
    return F.when(opens & (info == ""), -number).when(opens, number + F.when(info == language, READ).otherwise(0)).cast("int")


def _next_fence(state: Column, mark: Column) -> Column:
    """Outside, a mark opens a fence; inside, a mark of the same kind, at least as long and without a language, closes it."""
    inner = state % READ
    closes = (mark < 0) & (F.floor(-mark / 100) == F.floor(inner / 100)) & (-mark >= inner)
    return F.when(state == 0, F.abs(mark)).when(closes, F.lit(0)).otherwise(state).cast("int")


def fenced(rows: DataFrame, language: str = "rust") -> DataFrame:
    """Add ``fence`` to lines: 0 outside, 1 for a fence's own lines and what is in it, 2 for what is in one of the language."""
    kinds = [k + n for k in (100, 200) for n in range(3, LONGEST_FENCE + 1)]
    marks = scans.automaton(rows, _fence(language), _next_fence, [0, *kinds, *(READ + k for k in kinds)])
    seen = rows.join(marks.select("path", "line", "before", "after"), ["path", "line"], "left")
    state = scans.last_seen(seen, state=F.col("after"))
    within = F.coalesce("state", F.lit(0))
    own = F.col("after").isNotNull() & ((F.col("before") == 0) | (F.col("after") == 0))
    level = F.when(own, 1).when(within > READ, 2).when(within > 0, 1).otherwise(0)
    return state.select(*rows.columns, level.alias("fence"))


def _headings(files: DataFrame) -> DataFrame:
    """(path, line, text, fence, level): lines, with the level of those that are headings: marks before, or a rule below."""
    rows = fenced(lines(files))
    rule = F.when(F.col("text").rlike("^ {0,3}=+\\s*$"), 1).when(F.col("text").rlike("^ {0,3}-+\\s*$"), 2)
    below = rows.where("fence = 0").select("path", (F.col("line") - 1).alias("line"), rule.alias("ruled")).where("ruled is not null")
    met = rows.join(below, ["path", "line"], "left")
    plain = (F.col("fence") == 0) & F.col("text").rlike("^ {0,3}[^\\s#>*+-]")
    marked = (F.col("fence") == 0) & F.col("text").rlike("^ {0,3}#{1,6}(\\s|$)")
    level = F.when(marked, F.length(F.regexp_extract("text", "^ {0,3}(#+)", 1))).when(plain, F.col("ruled"))
    return met.select("path", "line", "text", "fence", level.alias("level"), marked.alias("marked"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """(path, line, level, heading, slug): headings outside fences, with marks before or a rule below; repeated slugs get a number."""
    text = F.when(F.col("marked"), F.trim(F.regexp_replace("text", "^ {0,3}#+\\s*|(^|\\s+)#+\\s*$", ""))).otherwise(F.trim("text"))
    named = _headings(files).where("level is not null").select("path", "line", "level", text.alias("heading")).withColumn("base", slug(F.col("heading")))
    turn = F.row_number().over(Window.partitionBy("path", "base").orderBy("line")) - 1
    return named.withColumn("turn", turn).select("path", "line", "level", "heading", F.when(F.col("turn") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("turn").cast("string"))).alias("slug"))


#: A function's head in a fenced example, and its name.
EXAMPLE = r"^\s*(?:pub(?:\(crate\))? )?fn ([\p{L}\p{N}_]+)"


def markdown_spans(files: DataFrame) -> DataFrame:
    """(path, line, heading_line, token): inline code outside fences, and functions of Rust examples, under a heading."""
    placed = scans.last_seen(_headings(files), heading_line=F.when(F.col("level").isNotNull(), F.col("line"))).where("heading_line is not null")
    spans = F.filter(F.transform(F.regexp_extract_all("text", F.lit("`([^`]+)`"), 1), lambda x: F.trim(x)), lambda x: x != "")
    tokens = F.when(F.col("fence") == 0, spans).when(F.col("fence") == 2, F.regexp_extract_all("text", F.lit(EXAMPLE), 1))
    return placed.select("path", "line", "heading_line", F.explode(tokens).alias("token"))


#: The words that begin lines of a feature.
FEATURES, SCENARIOS, STEPS = "Feature|Rule", "Scenario|Scenario Outline|Example|Background", "Given|When|Then|And|But|\\*"


#: Files of up to so many lines are read where their text is; longer ones are cut into blocks of lines.
SHORT = 512


def _clean(text: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.col(text), "\r", ""), "\n$", "")


def _by_length(files: DataFrame, short: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``short`` reads from files of up to SHORT lines and ``long`` from the others."""
    size = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return short(files.where(size <= SHORT)).unionByName(long(files.where(size > SHORT)))


BLANK = " \t\n\v\f\r"
_TITLE, _STEP = re.compile(f"({FEATURES}|{SCENARIOS}):"), re.compile(f"({STEPS})[{BLANK}]+")
#: Blanks before a last separator of lines are taken for blanks at the end, as in the scans' expressions.
_LAST = re.compile(f"[{BLANK}]+(?=[\x85\u2028\u2029]\\Z)")


def _walk(path: str, text: str) -> Iterator[tuple]:
    """(path, line, title, feature, name, tags, n, kind, text) of the titles and steps of one file; the title of a step is None."""
    feature = under = name = None
    inside, tags, n, kind = False, [], 0, "Given"
    for at, line in enumerate(text.split("\n"), 1):
        line = _LAST.sub("", line.strip(BLANK))
        if line in ('"""', "```"):
            inside = not inside
        elif inside or not line or line[0] in "#|":
            continue
        elif line[0] == "@":
            tags += [w[1:] for w in re.split(f"[{BLANK}]+", line) if w[:1] == "@"]
        elif m := _TITLE.match(line):
            name, n, kind = line[m.end() :].strip(" "), 0, "Given"
            under = "f" if m[1] in FEATURES.split("|") else "s"
            feature = name if under == "f" else feature
            yield path, at, under, feature, name, ",".join(tags), 0, kind, line
            tags = []
        elif m := _STEP.match(line):
            n += 1
            kind = m[1] if m[1] in ("Given", "When", "Then") else kind
            if under == "s":
                yield path, at, None, feature, name, None, n, kind, line[m.end() :].strip(" ")


WALKED = "path string, line int, title string, feature string, name string, tags string, n int, kind string, text string"


def _walked(files: DataFrame, titles: bool) -> DataFrame:
    """The titles, or else the steps, of files that are walked each in its own row."""

    def walk(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in WALKED.split(", ")]
        for part in parts:
            found = [x for path, text in zip(part["path"], part["text"], strict=True) for x in _walk(path, text) if (x[2] is not None) == titles]
            yield pd.DataFrame(found, columns=names)

    return files.where("text is not null").select("path", _clean("text").alias("text")).mapInPandas(walk, WALKED)


def _gherkin(files: DataFrame) -> DataFrame:
    """(path, line, text, title, name, word): lines outside docstrings that are no comments or tables; ``title`` is f or s for the lines that begin a feature or a scenario."""
    rows = lines(files).withColumn("text", F.regexp_replace("text", "^\\s+|\\s+$", ""))
    toggle = F.col("text").isin('"""', "```")
    read = scans.counted(rows, fences=toggle).where((F.col("fences") % 2 == 0) & ~toggle & (F.col("text") != "") & ~F.col("text").rlike("^[#|]"))
    title = F.when(F.col("text").rlike(f"^({FEATURES}):"), "f").when(F.col("text").rlike(f"^({SCENARIOS}):"), "s")
    name = F.when(title.isNotNull(), F.trim(F.regexp_replace("text", "^[^:]*:", "")))
    return read.select("path", "line", "text", title.alias("title"), name.alias("name"), F.regexp_extract("text", f"^({STEPS})\\s", 1).alias("word"))


def gherkin_titles(files: DataFrame) -> DataFrame:
    """(path, line, kind, feature, name, tags): features (and rules) and scenarios; tags are those of the lines before, in order, joined by commas."""
    kind = F.when(F.col("title") == "f", "Feature").otherwise("Scenario")
    return _by_length(files, lambda some: _walked(some, True).select("path", "line", kind.alias("kind"), "feature", "name", "tags"), _long_titles)


def gherkin_steps(files: DataFrame) -> DataFrame:
    """(path, feature, scenario, step_order, kind, text, line): And/But/* take the kind before, Given first.

    A scenario ends where a feature or rule begins: steps after that have none
    and are left out. Steps count from 1.
    """
    step = lambda some: _walked(some, False).select("path", "feature", F.col("name").alias("scenario"), F.col("n").alias("step_order"), "kind", "text", "line")
    return _by_length(files, step, _long_steps)


def _long_titles(files: DataFrame) -> DataFrame:
    """``gherkin_titles`` by scans over blocks of lines."""
    rows = _gherkin(files)
    tagged = F.col("text").startswith("@")
    # A tag waits for the next title: it has one title less before it.
    numbered = scans.counted(rows, titles=F.col("title").isNotNull())
    words = F.filter(F.split("text", "\\s+"), lambda w: w.startswith("@"))
    tags = numbered.where(tagged).select("path", (F.col("titles") + 1).alias("titles"), F.posexplode(F.transform(words, lambda w: F.substr(w, F.lit(2)))).alias("at", "tag"), "line")
    listed = tags.groupBy("path", "titles").agg(F.array_sort(F.collect_list(F.struct("line", "at", "tag"))).alias("x")).select("path", "titles", F.array_join(F.col("x.tag"), ",").alias("tags"))
    titles = scans.last_seen(numbered.where("title is not null"), feature=F.when(F.col("title") == "f", F.col("name")))
    kind = F.when(F.col("title") == "f", "Feature").otherwise("Scenario")
    return titles.join(listed, ["path", "titles"], "left").select("path", "line", kind.alias("kind"), "feature", "name", F.coalesce("tags", F.lit("")).alias("tags"))


def _long_steps(files: DataFrame) -> DataFrame:
    """``gherkin_steps`` by scans over blocks of lines."""
    step = F.col("word") != ""
    counted = scans.counted(_gherkin(files), n=step)
    title = F.when(F.col("title").isNotNull(), F.struct("title", "name", "line", "n"))
    word = F.when(step & F.col("word").isin("Given", "When", "Then"), F.struct("line", "word"))
    seen = scans.last_seen(counted, under=title, feature=F.when(F.col("title") == "f", F.col("name")), said=word)
    rows = seen.where(step & (F.col("under.title") == "s"))
    kind = F.when(F.col("said.line") > F.col("under.line"), F.col("said.word")).otherwise("Given")
    return rows.select("path", "feature", F.col("under.name").alias("scenario"), (F.col("n") - F.col("under.n")).cast("int").alias("step_order"), kind.alias("kind"), F.trim(F.regexp_replace("text", f"^({STEPS})\\s+", "")).alias("text"), "line")


def graphql_types(files: DataFrame) -> DataFrame:
    """(path, kind, name) of top-level definitions."""
    return _declared(files, "type|input|enum|interface|union|scalar", "")


def proto_items(files: DataFrame) -> DataFrame:
    """(path, kind, name) of services, calls, messages and enums, nested ones too."""
    return _declared(files, "service|rpc|message|enum", "\\s*")


def _declared(files: DataFrame, words: str, before: str) -> DataFrame:
    found = f"^{before}({words})\\s+([A-Za-z_][A-Za-z0-9_]*)"
    rows = lines(files).select("path", F.regexp_extract("text", found, 1).alias("kind"), F.regexp_extract("text", found, 2).alias("name"))
    return rows.where("kind <> ''")


def git_log(rows: DataFrame) -> DataFrame:
    """Records of ``%H%x1f%h%x1f%P%x1f%an%x1f%ae%x1f%aI%x1f%B`` (column ``record``)."""
    part = F.split("record", "\x1f")
    names = ("hash", "short_hash", "parents", "author", "email", "timestamp", "message")
    return rows.where(F.size(part) >= len(names)).select(*[part[i].alias(n) for i, n in enumerate(names)]).withColumn("parents", F.filter(F.split("parents", " "), lambda x: x != ""))


def step_patterns(files: DataFrame) -> DataFrame:
    """(path, kind, pattern, function) of step attributes on top-level functions of Rust sources."""
    mark = r'(?m)^#\[(given|when|then)\(\s*(?:\w+\s*=\s*)?r?#*"((?:[^"\\]|\\.)*)"#*\s*\)\]\s*(?:#\[[^\]\n]*\]\s*)*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?fn\s+(\w+)'
    each = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(mark), 0)).alias("found"))
    part = [F.regexp_extract("found", mark, i) for i in (1, 2, 3)]
    return each.select("path", F.initcap(part[0]).alias("kind"), part[1].alias("pattern"), part[2].alias("function"))


def review_comments(files: DataFrame) -> DataFrame:
    """(path, comment, author, body, url) of JSON arrays of comments; ``comment`` counts from 0."""
    parsed = files.select("path", F.from_json("text", "array<struct<author: string, body: string, url: string>>").alias("all"))
    return parsed.select("path", F.posexplode("all").alias("comment", "c")).select("path", "comment", "c.author", "c.body", "c.url")


def dirty_files(status: DataFrame) -> DataFrame:
    """(path) of the lines (column ``record``) of a short git status."""
    return status.select(F.trim(F.regexp_replace("record", r"^\s*\S+\s", "")).alias("path")).where("path <> ''")
