"""A layer of modules over packages, planned by a callable that the user gives.

Gathering, checking and applying are separate, so nothing is written unless a
whole plan is sound. No model or network is part of it: the planner gets a
text and returns one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from . import reports


def context(g: Graph, packages: DataFrame, limit: int = 15) -> str:
    """What a planner is told, as JSON: packages (name, path), their best connected functions, and calls between packages.

    As many rows as there are packages and pairs of packages that call each
    other, and ``limit`` functions a package: a summary, not the graph.
    """
    inside = reports.internal_packages(packages).orderBy("name").collect()
    top = reports.top_per_package(g, limit).orderBy("package", "rank").collect()
    calls = reports.cross_package_calls(g).orderBy("a", "b").collect()
    return json.dumps({"packages": [r.asDict() for r in inside], "functions": [r.asDict() for r in top], "calls": [r.asDict() for r in calls]}, sort_keys=True)


def parse(reply: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(modules, members, uses) of a planner's reply; ValueError where it is no sound plan.

    Modules are (name, semantic_kind, description, layer_hint), members (module,
    package), uses (from, to, semantic_kind) between modules of the plan.
    """
    start, end = reply.find("{"), reply.rfind("}")
    plan = json.loads(reply[start : end + 1]) if 0 <= start < end else None
    if not isinstance(plan, dict) or not isinstance(plan.get("modules"), list):
        raise ValueError("the reply holds no modules")
    modules, members = [], []
    for m in plan["modules"]:
        if not isinstance(m, dict) or not isinstance(m.get("name"), str) or not m["name"]:
            raise ValueError("a module has no name")
        modules.append((m["name"], str(m.get("semantic_kind", "")), str(m.get("description", "")), int(m.get("layer_hint", 0))))
        members += [(m["name"], str(p)) for p in m.get("packages", [])]
    names = {m[0] for m in modules}
    if len(names) < len(modules):
        raise ValueError("a module is there twice")
    uses = [(str(e["from"]), str(e["to"]), str(e.get("semantic_kind", ""))) for e in plan.get("uses", [])]
    if any(a not in names or b not in names for a, b, _ in uses):
        raise ValueError("an edge names no module")
    return modules, members, uses


def overlay(g: Graph, packages: DataFrame, planner: Callable[[str], str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ArchModule rows, CONTAINS edges to known packages, USES edges); whatever fails, there is no overlay at all."""
    modules, members, uses = parse(planner(context(g, packages)))
    spark = packages.sparkSession
    known = packages.select(F.col("name").alias("dst"))
    contains = spark.createDataFrame(members, "src string, dst string").join(known, "dst", "left_semi").select("src", "dst").distinct()
    return spark.createDataFrame(modules, "name string, semantic_kind string, description string, layer_hint int"), contains, spark.createDataFrame(uses, "src string, dst string, semantic_kind string").distinct()
