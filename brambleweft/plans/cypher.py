"""An openCypher subset compiled to DataFrames.

``run(graph, text, **params)`` parses by recursive descent and builds one
logical plan: MATCH (directed, undirected, chained, comma patterns, bounded
variable length), OPTIONAL MATCH, WHERE (three-valued logic, label and pattern
predicates, EXISTS), WITH, UNWIND, RETURN with DISTINCT, aggregates and
implicit grouping, ORDER BY (nulls last ascending, first descending), SKIP and
LIMIT. Parameters are typed values, never text. A node variable binds its id;
of its properties only those that the query names are read.

Within one MATCH no edge is bound twice; parallel edges are different ones. A
path of several hops binds the pairs of its ends, each once, and is searched
from what is bound at its start. Pattern predicates must be conjuncts of WHERE.
Statements that write are not part of it: ``operators.mutate`` has them as
functions over frames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pattern as P
from .graph import Graph

TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\$?[A-Za-z_]\w*|`[^`]+`)|(<>|<=|>=|->|<-|\.\.|[-+*/%=<>(){}\[\],.:;|]))")
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list}
SCALARS = {"tolower": F.lower, "toupper": F.upper, "size": F.size, "trim": F.trim, "abs": F.abs, "tostring": lambda c: c.cast("string"), "coalesce": F.coalesce}


class CypherError(ValueError):
    """The text is outside the subset, or names something unbound."""


@dataclass
class Node:
    name: str
    labels: list[str]
    props: list[tuple[str, object]]


@dataclass
class Edge:
    name: str | None
    types: list[str]
    direction: str
    hops: tuple[int, int] | None


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise CypherError(f"unexpected text at {text[at : at + 20]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


class Query:
    """Parser and compiler of one statement."""

    def __init__(self, graph: Graph, text: str, params: dict) -> None:
        self.graph, self.params, self.toks, self.at = graph, params, tokens(text), 0
        self.used: dict[str, set[str]] = {}
        for a, dot, b in zip(self.toks, self.toks[1:], self.toks[2:], strict=False):
            if dot == "." and re.match(r"[A-Za-z_`]", a):
                self.used.setdefault(a, set()).add(b)
            if a.lower() == "properties" and dot == "(":
                self.used.setdefault(b, set()).add("*")
        self.fresh, self.rows, self.kinds = 0, None, {}

    # --- tokens
    def peek(self, *words: str) -> bool:
        return [t.upper() for t in self.toks[self.at : self.at + len(words)]] == list(words)

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise CypherError(f"expected {word}, found {' '.join(self.toks[self.at : self.at + 3]) or 'the end'}")

    def word(self) -> str:
        if self.at >= len(self.toks) or not re.match(r"[A-Za-z_`]", self.toks[self.at]):
            raise CypherError("expected a name")
        self.at += 1
        return self.toks[self.at - 1].strip("`")

    def new(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}"

    # --- patterns
    def node(self) -> Node:
        self.need("(")
        name = self.word() if re.match(r"[A-Za-z_`]", self.toks[self.at]) else self.new()
        labels, props = [], []
        while self.take(":"):
            labels.append(self.word())
        if self.take("{"):
            while not self.take("}"):
                key = self.word()
                self.need(":")
                props.append((key, self.expression()))
                self.used.setdefault(name, set()).add(key)
                self.take(",")
        self.need(")")
        return Node(name, labels, props)

    def edge(self) -> Edge:
        back = self.take("<-")
        if not back:
            self.need("-")
        name, types, hops = None, [], None
        if self.take("["):
            if re.match(r"[A-Za-z_`]", self.toks[self.at]):
                name = self.word()
            if self.take(":"):
                types.append(self.word())
                while self.take("|"):
                    self.take(":")
                    types.append(self.word())
            if self.take("*"):
                low = high = 1
                if self.toks[self.at].isdigit():
                    low = high = int(self.toks[self.at])
                    self.at += 1
                if self.take(".."):
                    if not self.toks[self.at].isdigit():
                        raise CypherError("a path needs an upper bound")
                    high = int(self.toks[self.at])
                    self.at += 1
                hops = (low, high)
            self.need("]")
        forth = self.take("->")
        if not forth:
            self.need("-")
        return Edge(name, types, "in" if back and not forth else "out" if forth and not back else "any", hops)

    def path(self) -> list:
        parts: list = [self.node()]
        while self.peek("-") or self.peek("<-"):
            parts += [self.edge(), self.node()]
        return parts

    def bind_node(self, rows: DataFrame | None, n: Node, bound: set[str]) -> DataFrame:
        props = sorted(self.used.get(n.name, ()))
        if n.name in bound:
            if n.labels or n.props:
                rows = rows.join(self.scan(n, []).select(F.col(n.name)), n.name, "left_semi")
            return rows
        frame = self.scan(n, props)
        bound.add(n.name)
        self.kinds[n.name] = "node"
        if rows is None:
            return frame
        return rows.join(frame, n.name) if n.name in rows.columns else rows.crossJoin(frame)

    def scan(self, n: Node, props: list[str]) -> DataFrame:
        frame = self.graph.nodes(*n.labels) if n.labels else self.graph.nodes()
        get = lambda p: F.col(p) if p in frame.columns else F.lit(None)
        if "*" in props:
            props = sorted({*props, *frame.columns} - {"*", "node_id"})
        for p, value in n.props:
            frame = frame.where(get(p) == value)
        return frame.select(F.col("node_id").alias(n.name), F.col("labels").alias(f"{n.name}__labels"), *[get(p).alias(f"{n.name}__{p}") for p in props if p != "labels"])

    def pairs(self, e: Edge, starts: DataFrame, apart: bool) -> DataFrame:
        """(from, to, edge, type) of one step; ``starts`` (from) bounds a path of several hops."""
        edges = self.graph.told_apart(*e.types) if apart else self.graph.edges(*e.types)
        named = edges.select("src", "dst", "type", F.struct(*edges.columns).alias("edge"))  # the same from both ends
        one = {"out": named, "in": P.turned(named), "any": P.both_ways(named)}[e.direction].select(F.col("src").alias("from"), F.col("dst").alias("to"), "edge", "type")
        if not e.hops:
            return one
        one = one.select("from", "to").distinct()
        step = starts.select("from", F.col("from").alias("to")).distinct()
        found = [step] if e.hops[0] == 0 else []
        for d in range(1, e.hops[1] + 1):
            step = step.select("from", F.col("to").alias("_at")).join(one.select(F.col("from").alias("_at"), "to"), "_at").select("from", "to").distinct()
            if d >= e.hops[0]:
                found.append(step)
        return reduce(DataFrame.unionByName, found).distinct().select("*", F.lit(None).cast("string").alias("edge"), F.lit(None).cast("string").alias("type"))

    def match(self, rows: DataFrame | None, paths: list[list], bound: set[str]) -> DataFrame:
        seen: list[tuple[str, Edge]] = []
        single = [e for parts in paths for e in parts[1::2] if not e.hops]
        alike = lambda e, o: not e.types or not o.types or set(e.types) & set(o.types)
        apart_of = {id(e): any(o is not e and alike(e, o) for o in single) for e in single}
        for parts in paths:
            # Start from a node that is bound already, if there is one.
            if parts[0].name not in bound and parts[-1].name in bound:
                flip = {"out": "in", "in": "out", "any": "any"}
                for x in parts[1::2]:
                    x.direction = flip[x.direction]
                parts = parts[::-1]
            rows = self.bind_node(rows, parts[0], bound)
            here = parts[0].name
            for e, n in zip(parts[1::2], parts[2::2], strict=True):
                r = e.name or self.new()
                p = self.pairs(e, rows.select(F.col(here).alias("from")), apart_of.get(id(e), False))
                p = p.select(F.col("from").alias(here), F.col("to").alias("_to"), F.col("edge").alias(f"{r}__edge"), F.col("type").alias(f"{r}__type"))
                self.kinds[r] = "edge"
                rows = rows.join(p, here)
                if n.name in bound:
                    rows = rows.where(F.col("_to") == F.col(n.name)).drop("_to")
                    rows = self.bind_node(rows, n, bound)
                else:
                    rows = self.bind_node(rows.withColumnRenamed("_to", n.name), n, bound)
                for other, o in seen:
                    if not (e.hops or o.hops) and alike(e, o):
                        rows = rows.where(~self.graph.is_same(F.col(f"{r}__edge"), F.col(f"{other}__edge")))
                seen.append((r, e))
                here = n.name
        return rows

    # --- expressions
    def expression(self) -> Column:
        left = self.conjunction()
        while self.take("OR"):
            left = left | self.conjunction()
        return left

    def conjunction(self) -> Column:
        left = self.negation()
        while self.take("AND"):
            left = left & self.negation()
        return left

    def negation(self) -> Column:
        return ~self.negation() if self.take("NOT") else self.comparison()

    def comparison(self) -> Column:
        left = self.sum()
        for op, f in (("=", Column.__eq__), ("<>", Column.__ne__), ("<=", Column.__le__), (">=", Column.__ge__), ("<", Column.__lt__), (">", Column.__gt__)):
            if self.take(op):
                return f(left, self.sum())
        if self.take("IS", "NOT", "NULL"):
            return left.isNotNull()
        if self.take("IS", "NULL"):
            return left.isNull()
        if self.take("IN"):
            return F.array_contains(self.sum(), left)
        if self.take("STARTS", "WITH"):
            return F.startswith(left, self.sum())
        if self.take("ENDS", "WITH"):
            return F.endswith(left, self.sum())
        if self.take("CONTAINS"):
            return F.contains(left, self.sum())
        return left

    def sum(self) -> Column:
        left = self.product()
        while self.peek("+") or self.peek("-"):
            left = left + self.product() if self.take("+") else left - self.product() if self.take("-") else left
        return left

    def product(self) -> Column:
        left = self.atom()
        while self.peek("*") or self.peek("/") or self.peek("%"):
            op = self.toks[self.at]
            self.at += 1
            right = self.atom()
            left = {"*": left * right, "/": left / right, "%": left % right}[op]
        return left

    def atom(self) -> Column:
        t = self.toks[self.at] if self.at < len(self.toks) else ""
        if t == "(":
            self.at += 1
            inner = self.expression()
            self.need(")")
            return inner
        if t == "-":
            self.at += 1
            return -self.atom()
        if t == "[":
            self.at += 1
            items = []
            while not self.take("]"):
                items.append(self.expression())
                self.take(",")
            return F.array(*items)
        if re.fullmatch(r"\d+", t):
            self.at += 1
            return F.lit(int(t))
        if re.match(r"\d", t):
            self.at += 1
            return F.lit(float(t))
        if t[:1] in "'\"" and t:
            self.at += 1
            return F.lit(re.sub(r"\\(.)", r"\1", t[1:-1]))
        if t.startswith("$"):
            self.at += 1
            if t[1:] not in self.params:
                raise CypherError(f"parameter {t} is not given")
            return F.lit(self.params[t[1:]])
        if t.upper() in ("TRUE", "FALSE", "NULL"):
            self.at += 1
            return F.lit({"TRUE": True, "FALSE": False, "NULL": None}[t.upper()])
        name = self.word()
        if name.lower() == "count" and self.peek("{"):
            raise CypherError("count{} is not part of the subset: use OPTIONAL MATCH and count(), or pattern.counted")
        if self.take("("):
            return self.call(name.lower())
        if self.take("."):
            return F.col(f"{name}__{self.word()}")
        if self.peek(":") and self.kinds.get(name) == "node":
            self.at += 1
            return F.array_contains(f"{name}__labels", self.word())
        return F.col(f"{name}__edge") if self.kinds.get(name) == "edge" else F.col(name)

    def call(self, name: str) -> Column:
        if name in AGGREGATES:
            self.aggregated = True
            if self.take("*", ")"):
                return F.count(F.lit(1))
            distinct = self.take("DISTINCT")
            arg = self.expression()
            self.need(")")
            if distinct and name in ("count", "collect"):
                return F.countDistinct(arg) if name == "count" else F.collect_set(arg)
            return AGGREGATES[name](arg)
        if name in ("labels", "type", "id", "properties"):
            v = self.word()
            self.need(")")
            if name == "properties":
                return F.to_json(F.struct(*[F.col(c).alias(c.split("__", 1)[1]) for c in self.rows.columns if c.startswith(f"{v}__") and not c.endswith("__labels")]))
            return F.col({"labels": f"{v}__labels", "type": f"{v}__type", "id": v}[name])
        args = []
        while not self.take(")"):
            args.append(self.expression())
            self.take(",")
        if name == "substring":
            return F.substring(args[0], args[1] + 1, args[2]) if len(args) > 2 else F.substr(args[0], args[1] + 1)
        if name not in SCALARS:
            raise CypherError(f"unknown function {name}")
        return SCALARS[name](*args)

    # --- clauses
    def where(self, bound: set[str]) -> None:
        while True:
            start = self.at
            missing = self.take("NOT")
            if self.take("EXISTS", "{"):
                self.take("MATCH")
                self.pattern_predicate(bound, missing)
                self.need("}")
            elif self.peek("(") and self.is_pattern():
                self.pattern_predicate(bound, missing)
            else:
                self.at = start
                test = self.negation()
                while self.take("OR"):
                    test = test | self.conjunction()
                self.rows = self.rows.where(test)
            if not self.take("AND"):
                return

    def is_pattern(self) -> bool:
        depth = 0
        for i in range(self.at, len(self.toks)):
            depth += {"(": 1, ")": -1}.get(self.toks[i], 0)
            if not depth:
                after = self.toks[i + 1 : i + 3]
                return after[:1] == ["<-"] or after in (["-", "["], ["-", "-"]) or after[:1] == ["->"] or after == ["-", "("]
        return False

    def pattern_predicate(self, bound: set[str], missing: bool) -> None:
        parts = self.path()
        shared = sorted({p.name for p in parts[::2]} & bound)
        if not shared:
            raise CypherError("a pattern predicate needs a bound variable")
        used, self.used = self.used, {n.name: {k for k, _ in n.props} for n in parts[::2]}
        found = self.match(None, [parts], set()).select(*shared)
        self.used = used
        self.rows = self.rows.join(found, shared, "left_anti" if missing else "left_semi")

    def items(self) -> list[tuple[str, Column, bool]]:
        out = []
        while True:
            start, self.aggregated = self.at, False
            value = self.expression()
            text = "".join(self.toks[start : self.at])
            out.append((self.word() if self.take("AS") else text.replace("`", ""), value, self.aggregated))
            if not self.take(","):
                return out

    def project(self, last: bool) -> None:
        distinct = self.take("DISTINCT")
        start = self.at
        items = self.items()
        carried: dict[str, list[str]] = {}
        if not last:  # a variable goes on with what is known of it
            for name, _, _ in items:
                if name in self.kinds:
                    carried[name] = [c for c in self.rows.columns if c.startswith(f"{name}__")]
        del start
        more = [F.col(c) for cols in carried.values() for c in cols]
        plain = [v.alias(n) for n, v, agg in items if not agg and not (n in self.kinds and self.kinds[n] == "edge" and not last)]
        if any(agg for _, _, agg in items):
            self.rows = self.rows.groupBy(*plain, *more).agg(*[v.alias(n) for n, v, agg in items if agg])
            self.rows = self.rows.select(*[F.col(f"`{n}`") for n, _, _ in items if n in self.rows.columns], *[F.col(c) for cols in carried.values() for c in cols])
            held = None
        else:
            held, self.rows = self.rows, self.rows.select(*plain, *more)
        if distinct:
            self.rows, held = self.rows.distinct(), None
        if self.take("ORDER", "BY"):
            keys = []
            names = {n for n, _, _ in items}
            while True:
                mark = self.at
                key = self.expression()
                text = "".join(self.toks[mark : self.at])
                key = F.col(f"`{text}`") if text in names else key
                down = self.take("DESC") or self.take("DESCENDING")
                if not down:
                    self.take("ASC")
                keys.append((key.desc_nulls_first() if down else key.asc_nulls_last(), text in names))
                if not self.take(","):
                    break
            if held is not None and not all(named for _, named in keys):
                self.rows = held.select("*", *[c for c, (n, _, _) in zip(plain, items, strict=False) if n not in held.columns]).orderBy(*[k for k, _ in keys]).select(*[F.col(f"`{n}`") for n, _, _ in items], *more)
            else:
                self.rows = self.rows.orderBy(*[k for k, _ in keys])
        if self.take("SKIP"):
            self.rows = self.rows.offset(int(self.toks[self.at]))
            self.at += 1
        if self.take("LIMIT"):
            self.rows = self.rows.limit(int(self.toks[self.at]))
            self.at += 1
        if not last:
            self.kinds = {n: k for n, k in self.kinds.items() if n in carried}

    def compile(self) -> DataFrame:
        bound: set[str] = set()
        while self.at < len(self.toks):
            optional = self.take("OPTIONAL", "MATCH")
            if optional or self.take("MATCH"):
                paths = [self.path()]
                while self.take(","):
                    paths.append(self.path())
                if optional:
                    outer, keep = self.rows, sorted({p.name for parts in paths for p in parts[::2]} & bound)
                    if not keep:
                        raise CypherError("OPTIONAL MATCH needs a bound variable")
                    inner = set(keep)
                    base = outer.select(*[c for c in outer.columns if c in keep or c.split("__")[0] in keep]).distinct()
                    self.rows = self.match(base, paths, inner)
                    if self.take("WHERE"):
                        self.where(inner)
                    added = [c for c in self.rows.columns if c not in outer.columns]
                    self.rows = outer.join(self.rows.select(*keep, *added), keep, "left")
                    bound |= inner
                else:
                    self.rows = self.match(self.rows, paths, bound)
                    if self.take("WHERE"):
                        self.where(bound)
            elif self.take("UNWIND"):
                value = self.expression()
                self.need("AS")
                name = self.word()
                if self.rows is None:
                    self.rows = self.graph.nodes().sparkSession.range(1).select()
                self.rows = self.rows.select("*", F.explode(value).alias(name))
            elif self.take("WITH"):
                self.project(last=False)
                bound = set(self.kinds)
                if self.take("WHERE"):
                    self.where(bound)
            elif self.take("RETURN"):
                self.project(last=True)
            else:
                raise CypherError(f"unexpected {self.toks[self.at]!r}")
        if self.rows is None:
            raise CypherError("the query is empty")
        return self.rows


def run(graph: Graph, text: str, **params) -> DataFrame:
    """The rows of one statement; ``EXPLAIN`` gives its plan as one column ``plan``."""
    text = text.strip().rstrip(";")
    if text[:8].upper() == "EXPLAIN ":
        rows = Query(graph, text[8:], params).compile()
        plan = rows._jdf.queryExecution().explainString(rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return rows.sparkSession.createDataFrame([(line,) for line in plan.splitlines()], "plan string")
    return Query(graph, text, params).compile()


def run_many(graph: Graph, text: str, **params) -> list[DataFrame]:
    """Each statement of a text separated by semicolons."""
    parts = re.findall(r"""(?:[^;'"]|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")+""", text)
    return [run(graph, p, **params) for p in parts if p.strip()]
