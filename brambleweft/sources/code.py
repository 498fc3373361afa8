"""Functions and calls of source files: Python by its syntax tree, other languages by patterns."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directories that hold no sources of their own, by their whole name or its end, and extensions.
SKIPPED = (
    "node_modules", ".git", "dist", "build", "target", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "egg-info", ".eggs", "vendor",
)
EXTENSIONS = ("rs", "py", "ts", "tsx", "js", "go")
HEADS = {
    "rs": r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?fn\s+(\w+)",
    "go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)",
    "ts": r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)",
}
COLUMNS = ["path", "name", "line_start", "line_end", "body", "callees"]
SCHEMA = "path string, name string, line_start int, line_end int, body string, callees array<string>"


def source_files(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    ends = "(" + "|".join(re.escape(x) for x in SKIPPED) + ")$"
    skipped = F.exists(folders, lambda x: x.rlike(ends))
    return files.where(F.element_at(F.split(F.element_at(parts, -1), r"\."), -1).isin(*EXTENSIONS) & ~skipped)


def _python(text: str) -> Iterator[tuple]:
    lines = text.splitlines()
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            called = {x.func.id if isinstance(x.func, ast.Name) else x.func.attr for x in ast.walk(node) if isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute))}
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            yield node.name, start, node.end_lineno, "\n".join(lines[start - 1 : node.end_lineno]), sorted(called)


def _pattern(text: str, head: str) -> Iterator[tuple]:
    lines = text.splitlines()
    starts = [(i, m[1]) for i, line in enumerate(lines) if (m := re.match(head, line))]
    for i, name in starts:
        depth, end, opened = 0, i, False
        for end in range(i, len(lines)):  # noqa: B007
            depth += lines[end].count("{") - lines[end].count("}")
            opened |= "{" in lines[end]
            if opened and depth <= 0:
                break
        first = i
        while first and re.match(r"\s*(#!?\[|@)", lines[first - 1]):
            first -= 1
        body = "\n".join(lines[first : end + 1])
        called = set(re.findall(r"\b(\w+)\s*\(", "\n".join(lines[i : end + 1]))) - {name, "if", "for", "while", "match", "switch", "return", "fn", "func", "function"}
        yield name, first + 1, end + 1, body, sorted(called)


def functions(files: DataFrame) -> DataFrame:
    """One row per function of (path, text) files; unreadable files give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                kind = path.rsplit(".", 1)[-1]
                try:
                    rows += [(path, *r) for r in (_python(text) if kind == "py" else _pattern(text, HEADS.get(kind, HEADS["ts"])))]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=COLUMNS)

    return source_files(files).select("path", "text").where("text is not null").mapInPandas(run, SCHEMA)


#: How declarations of other things than functions start, and what kind of symbol each word makes.
DECLARED = r"(?m)^[ \t]*(?:pub(?:\([a-z]+\))?[ \t]+|export[ \t]+(?:default[ \t]+)?|abstract[ \t]+)*(struct|enum|trait|interface|class|type|const|static)[ \t]+(?:mut[ \t]+)?([A-Za-z_]\w*)"
SYMBOL_KINDS = {"struct": "Struct", "class": "Struct", "enum": "Enum", "trait": "Trait", "interface": "Trait", "type": "TypeAlias", "const": "Const", "static": "Static"}


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind, line) of types, constants and statics of (path, text) files, all by patterns in the JVM."""
    each = source_files(files).select("path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    kinds = F.create_map(*[F.lit(x) for kv in SYMBOL_KINDS.items() for x in kv])
    word = F.regexp_extract("text", DECLARED, 1)
    return each.where(word != "").select("path", F.regexp_extract("text", DECLARED, 2).alias("name"), F.element_at(kinds, word).alias("kind"), (F.col("line") + 1).alias("line"))


def calls(found: DataFrame) -> DataFrame:
    """(src, dst): by the callee's bare name, so namesakes all get an edge."""
    each = found.select(F.concat_ws("::", "path", "name").alias("src"), F.explode("callees").alias("name"))
    return each.join(found.select("name", F.concat_ws("::", "path", "name").alias("dst")), "name").where("src <> dst").select("src", "dst").distinct()
