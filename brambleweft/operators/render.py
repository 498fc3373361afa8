"""Thin text renderers over results.

They collect, so a result is cut to ``limit`` rows first, and what was cut is
said in the text: the last line gives the number of rows shown and that there
are more. For whole results, write the frame.
"""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame


def _cell(x) -> str:
    return "—" if x is None else str(x).replace("|", "\\|").translate({13: " ", 10: " ", 9: " "})


def _shown(rows: DataFrame, limit: int) -> tuple[list, str]:
    """At most ``limit`` rows, and what to say if there are more."""
    got = rows.limit(limit + 1).collect()
    return got[:limit], f"cut to {limit} rows" if len(got) > limit else ""


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    got, cut = _shown(rows, limit)
    if not got:
        return "_no rows_"
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(map(_cell, r)) + " |" for r in got]
    return "\n".join([*lines, "", f"_{cut or f'{len(got)} rows'}_"])


def tsv(rows: DataFrame, limit: int = 1000) -> str:
    show = lambda x: "null" if x is None else json.dumps(x, ensure_ascii=False) if isinstance(x, str) else str(x)
    got, cut = _shown(rows, limit)
    return "\n".join(["\t".join(rows.columns), *("\t".join(map(show, r)) for r in got), *([f"# {cut}"] if cut else [])])


def mermaid(nodes: DataFrame, edges: DataFrame, limit: int = 1000) -> str:
    (shown, cut), (links, cut_links) = _shown(nodes.orderBy("slug"), limit), _shown(edges.orderBy("src_slug", "dst_slug"), limit)
    lines = [f'  {r["slug"]}["{_cell(r["node_id"])}"]' for r in shown]
    lines += [f"  {r['src_slug']} -->|{r['type']}| {r['dst_slug']}" for r in links]
    return "\n".join(["flowchart LR", *lines, *(f"  %% {c}" for c in (cut, cut_links) if c)])


def dot(nodes: DataFrame, edges: DataFrame, limit: int = 1000) -> str:
    (shown, cut), (links, cut_links) = _shown(nodes.orderBy("slug"), limit), _shown(edges.orderBy("src_slug", "dst_slug"), limit)
    lines = [f"  {r['slug']} [label={json.dumps(r['node_id'])}];" for r in shown]
    lines += [f"  {r['src_slug']} -> {r['dst_slug']} [label={json.dumps(r['type'])}];" for r in links]
    return "\n".join(["digraph g {", *lines, *(f"  // {c}" for c in (cut, cut_links) if c), "}"])


def notes(rows: DataFrame, limit: int = 50) -> str:
    """Notes (node_id, title, author, created_at, markdown) as sections, newest first."""
    parts = []
    for r in rows.orderBy("created_at", "node_id", ascending=[False, True]).limit(limit).collect():
        parts.append(f"### {_cell(r['title'] or r['node_id'])}\n\n_{_cell(r['author'])}, {_cell(r['created_at'])}_\n\n{r['markdown'] or ''}".rstrip())
    return "\n\n".join(parts) or "_no notes_"


def roadmap(rows: DataFrame, limit: int = 1000) -> str:
    """Items (area, status, item) in the order of ``worklog.roadmap`` as nested headings and bullets."""
    lines, area, status = ["# Roadmap"], None, None
    got, cut = _shown(rows, limit)
    for r in got:
        if r["area"] != area:
            lines, area, status = [*lines, "", f"## {r['area']}"], r["area"], None
        if r["status"] != status:
            lines, status = [*lines, "", f"### {r['status']}", ""], r["status"]
        lines.append(f"- {r['item']}")
    return "\n".join([*lines, *(["", f"_{cut}_"] if cut else [])]) + "\n"


def worklog(rows: DataFrame, limit: int = 1000) -> str:
    """Items of ``worklog.report`` with their statuses, and under each its comments."""
    got, cut = _shown(rows, limit)
    lines = ["# Worklog"]
    for r in got:
        lines += ["", f"## {_cell(r['title'])}", "", f"`{r['item']}` {_cell(r['area'])}, {_cell(r['kind'])}", ""]
        for entry in r["timeline"] or []:
            lines += [f"- {entry['at']} {entry['status']}", *(f"  - {c['at']} {c['comment_id']}" for c in entry["comments"])]
    return "\n".join([*lines, *(["", f"_{cut}_"] if cut else [])]) + "\n"


def html(nodes: DataFrame, edges: DataFrame, title: str = "graph", limit: int = 5000) -> str:
    """One page with the nodes (node_id, kind) and edges (src, dst, type) as embedded JSON and a table.

    Text goes in escaped, so no value can close the script element.
    """
    (shown, cut), (links, cut_links) = _shown(nodes.orderBy("node_id"), limit), _shown(edges.orderBy("src", "dst", "type"), limit)
    data = {
        "nodes": [{"id": r["node_id"], "kind": r["kind"]} for r in shown],
        "edges": [{"source": r["src"], "target": r["dst"], "type": r["type"]} for r in links],
    }
    said = "".join(f"<p>{what} {c}</p>" for what, c in (("nodes", cut), ("edges", cut_links)) if c)
    embedded = json.dumps(data, ensure_ascii=False).replace("<", "\\u003c")
    rows = "".join(f"<tr><td>{escape(e['source'])}</td><td>{escape(e['type'])}</td><td>{escape(e['target'])}</td></tr>" for e in data["edges"])
    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><script type="application/json" id="graph">{embedded}</script><table>{rows}</table>{said}'


def envelope(text: str, failed: bool = False) -> dict:
    """A tool's reply as a JSON-RPC result."""
    return {"content": [{"type": "text", "text": text}], "isError": failed}
