"""Package manifests to (path, package, version, dependency, kind) rows; a row without dependency names the package."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["path", "package", "version", "dependency", "kind"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)


def _cargo(text: str) -> Iterator[tuple]:
    doc = tomllib.loads(text)
    pkg = doc.get("package", {})
    name, version = pkg.get("name", ""), pkg.get("version")
    yield name, version if isinstance(version, str) else None, None, None
    for key, kind in (("dependencies", "Normal"), ("dev-dependencies", "Dev"), ("build-dependencies", "Build")):
        for dep in doc.get(key, {}):
            yield name, None, dep, kind


def _npm(text: str) -> Iterator[tuple]:
    doc = json.loads(text)
    name = doc.get("name", "")
    yield name, doc.get("version"), None, None
    for key, kind in (("dependencies", "Normal"), ("devDependencies", "Dev"), ("peerDependencies", "Normal")):
        for dep in doc.get(key, {}):
            yield name, None, dep, kind


def _go(text: str) -> Iterator[tuple]:
    plain = re.sub(r"//.*", "", text)
    name = (re.search(r"^module\s+(\S+)", plain, re.M) or ["", ""])[1]
    yield name, (re.search(r"^go\s+(\S+)", plain, re.M) or [None, None])[1], None, None
    required = re.findall(r"^require\s+([^\s(]+)\s", plain, re.M)
    for block in re.findall(r"^require\s*\(([^)]*)\)", plain, re.M):
        required += re.findall(r"^\s*(\S+)\s+\S+", block, re.M)
    for dep in required:
        yield name, None, dep, "Normal"


def _python(text: str) -> Iterator[tuple]:
    doc = tomllib.loads(text)
    project, poetry = doc.get("project", {}), doc.get("tool", {}).get("poetry", {})
    name = project.get("name") or poetry.get("name", "")
    yield name, project.get("version") or poetry.get("version"), None, None
    for dep in project.get("dependencies", []):
        yield name, None, re.match(r"[\w-]*", dep)[0], "Normal"
    for dep in poetry.get("dependencies", {}):
        if dep != "python":
            yield name, None, dep, "Normal"
    for dep in poetry.get("group", {}).get("dev", {}).get("dependencies", {}):
        yield name, None, dep, "Dev"


def _requirements(text: str) -> Iterator[tuple]:
    for line in text.splitlines():
        if line.strip() and line.strip()[0] not in "#-":
            yield "", None, re.match(r"[\w-]*", line.strip())[0], "Normal"


#: What a manifest of another shape than expected ends in: one bad file is no reason to stop a job.
UNREADABLE = (ValueError, TypeError, AttributeError, RecursionError)
READERS = {"Cargo.toml": _cargo, "package.json": _npm, "go.mod": _go, "pyproject.toml": _python, "requirements.txt": _requirements}


def manifests(files: DataFrame) -> DataFrame:
    """Rows of all manifests among (path, text) files; broken ones, and ones of another shape, give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                reader = READERS.get(path.rsplit("/", 1)[-1])
                try:
                    found = [(path, *r) for r in reader(text)] if reader else []
                    rows += [tuple(x if x is None else str(x) for x in r) for r in found]
                except UNREADABLE:
                    continue
            yield pd.DataFrame(rows, columns=COLUMNS)

    return files.select("path", "text").where("path is not null and text is not null").mapInPandas(run, SCHEMA)


#: The manifests that tell a project's kind, the first found wins.
KINDS = (("Rust", ("Cargo.toml",)), ("Node", ("package.json",)), ("Python", ("pyproject.toml", "requirements.txt", "setup.py")), ("Go", ("go.mod",)))


def project_kind(names: set[str]) -> str:
    """The kind of a project by the names of the files in its root; Rust where none tells."""
    return next((kind for kind, files in KINDS if names & set(files)), KINDS[0][0])


def _declared(path: str, text: str) -> list[str]:
    """Members that a workspace's manifest names."""
    if path.endswith("Cargo.toml"):
        return tomllib.loads(text).get("workspace", {}).get("members", [])
    found = json.loads(text).get("workspaces", [])
    return found.get("packages", []) if isinstance(found, dict) else found


def workspace_members(files: DataFrame) -> DataFrame:
    """(root, member): manifests (paths) that another manifest of the same name declares as members.

    A member is a folder relative to the root, or, for ``package.json``, every
    folder one level below a name that ends in ``/*``. Members that aren't
    there, and broken manifests, give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                folder, name = path.rpartition("/")[::2]
                try:
                    declared = [x for x in _declared(path, text) if isinstance(x, str)]
                except UNREADABLE:
                    continue
                for member in declared:
                    below = name == "package.json" and member.endswith("/*")
                    where = (f"{folder}/" if folder else "") + member.removesuffix("/*" if below else "/").removeprefix("./")
                    rows.append((path, name, where, below))
            yield pd.DataFrame(rows, columns=["root", "name", "folder", "below"])

    known = files.select("path", "text").where("path is not null and text is not null")
    known = known.where(F.element_at(F.split("path", "/"), -1).isin("Cargo.toml", "package.json"))
    declared = known.mapInPandas(run, "root string, name string, folder string, below boolean")
    own = known.select(F.col("path").alias("member"), F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_replace("path", "/?[^/]*$", "").alias("inside"))
    places = own.select("member", "name", F.explode(F.array(F.struct(F.col("inside").alias("folder"), F.lit(False).alias("below")), F.struct(F.regexp_replace("inside", "/?[^/]*$", "").alias("folder"), F.lit(True).alias("below")))).alias("p")).select("member", "name", "p.*")
    return declared.join(places, ["name", "folder", "below"]).where("root <> member").select("root", "member").distinct()
