"""Trails, reachability and versions against slow versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brambleweft import session
from brambleweft.functions import scalars
from brambleweft.operators import paths, versions, worklog


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("seed", range(3))
def test_trails_against_all_walks(spark, seed):
    r = random.Random(seed)
    edges = [(r.choice("abcd"), r.choice("abcd"), r.choice("XY")) for _ in range(9)]
    count = Counter()
    named = []
    for e in edges:
        count[e] += 1
        named.append((*e, str(count[e])))
    starts, ends, want = ["a", "b", "a"], ["c", "a"], Counter()

    def walk(nodes, used):
        if len(used) <= 4 and nodes[-1] in ends:
            want[(len(used), "".join(nodes), tuple("|".join(e) for e in used))] += 1
        if len(used) < 4:
            for e in named:
                if e[0] == nodes[-1] and e not in used:
                    walk([*nodes, e[1]], [*used, e])

    for s in set(starts):
        walk([s], [])
    node = lambda x: frame(spark, [(i,) for i in x], "node_id string")
    got = paths.trails(node(starts), frame(spark, named, "src string, dst string, type string, nth string"), node(ends), 0, 4).collect()
    assert Counter((x["length"], "".join(x["nodes"]), tuple(x["edges"])) for x in got) == want


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_reach_against_a_walk_over_all_edges(spark, seed, forward, monkeypatch):
    r = random.Random(seed)
    nodes = [(i, r.choice([0, 1, 2, 3, None]), r.random()) for i in range(60)]
    order = {i: p for i, _, p in nodes}
    merges = [(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(40)) if order[a] < order[b]]
    steps = [tuple(m) for m in merges]
    for c in range(4):
        chain = sorted((p, i) for i, k, p in nodes if k == c)
        steps += [(a[1], b[1]) for a, b in zip(chain, chain[1:], strict=False)]
    if not forward:
        steps = [(b, a) for a, b in steps]
    seeds = [r.randrange(60) for _ in range(2)]
    seen, todo = set(seeds), list(seeds)
    while todo:
        x = todo.pop()
        for a, b in steps:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    followed, newly = [], paths._newly

    def counted(*args):
        rows = newly(*args)
        followed.append(rows.count())
        return rows

    monkeypatch.setattr(paths, "_newly", counted)
    got = paths.reach_chains(frame(spark, nodes, "node_id long, chain long, place double"), frame(spark, merges, "src long, dst long"), frame(spark, [(s,) for s in seeds], "node_id long"), forward)
    assert {x["node_id"] for x in got.collect()} == seen and got.count() == len(seen)
    assert sum(followed) <= len(merges), "every further edge is followed once at most"


def test_a_long_chain_takes_one_round(spark, monkeypatch):
    rounds, newly = [], paths._newly
    monkeypatch.setattr(paths, "_newly", lambda *a: rounds.append(1) or newly(*a))
    nodes = spark.range(5000).select(F.col("id").alias("node_id"), F.lit(1).alias("chain"), F.col("id").alias("place"))
    got = paths.reach_chains(nodes, frame(spark, [(7, 9)], "src long, dst long"), frame(spark, [(10,)], "node_id long"))
    assert got.count() == 4990 and len(rounds) == 1


@pytest.mark.parametrize("block", [3, 4096])
def test_versions_against_a_walk(spark, monkeypatch, block):
    monkeypatch.setattr(versions, "BLOCK", block)
    r = random.Random(block)
    rows = [(r.choice("ab"), r.randrange(-5, 30), r.choice(["x", "y", None]), k) for k in range(80)] + [("c", 1, None, 1), ("d", 2, "x", 1)]
    want, states = [], {}
    for node in "abcd":
        at = {}
        for n, c, content, _ in rows:
            if n == node:
                at[c] = content
        now, first = None, None
        for c in sorted(at):
            if at[c] != now:
                if now is not None:
                    want.append((node, now, first, c))
                now, first = at[c], c
            states[node, c] = now
        if now is not None:
            want.append((node, now, first, None))
    found = versions.ranges(frame(spark, rows, "node_id string, commit long, content string, turn long"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    state = lambda n, c: next((x[1] for x in want if x[0] == n and x[2] <= c and (x[3] is None or x[3] > c)), None)
    for base, head in ((-9, 40), (3, 12), (12, 12)):
        kind = lambda a, b: "added" if a is None else "removed" if b is None else "edited"
        diff = [(n, kind(state(n, base), state(n, head)), state(n, base), state(n, head)) for n in "abcd" if state(n, base) != state(n, head)]
        assert sorted(map(tuple, versions.diff(found, base, head).collect())) == sorted(diff)


def test_hash_of_known_vectors_and_odd_texts(spark):
    def slow(text):
        h = scalars.FNV_BASIS
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h - (1 << 64) if h >> 63 else h

    texts = ["", "a", "foobar", "ü\U0001f600", "\x00\x7f", "x" * 3000, None]
    got = frame(spark, [(t,) for t in texts], "t string").coalesce(1).select("t", scalars.fnv1a_64(F.col("t")).alias("h")).collect()
    assert [r["h"] for r in got] == [None if t is None else slow(t) for t in texts]
    assert slow("a") & (1 << 64) - 1 == 0xAF63DC4C8601EC8C and slow("foobar") & (1 << 64) - 1 == 0x85944171F73967E8


def test_statuses_of_one_time(spark):
    statuses = frame(spark, [("i", "pending", 1), ("i", "done", 1), ("i", "blocked", 2)], "item string, status string, at int")
    comments = frame(spark, [("i", 1, 0), ("i", 2, 1), ("i", 3, 1), ("i", 4, 2)], "item string, comment_id long, at int")
    items = frame(spark, [("i", 0, "done", 1)], "item string, created_at int, current_status string, current_status_at int")
    (row,) = worklog.report(items, statuses, comments).collect()
    assert [(e["status"], [c["comment_id"] for c in e["comments"]]) for e in row["timeline"]] == [("done", []), ("pending", [2, 3]), ("blocked", [4])]
    lines = worklog.timeline(statuses, comments).orderBy("at", "status").collect()
    assert [(x["status"], x["comments"]) for x in lines] == [("done", 0), ("pending", 2), ("blocked", 1)]
    # The timeline's last status of a time is the current one.
    same = statuses.where("at = 1")
    assert worklog.latest_status(same).first()["status"] == "pending"
    shown, _ = worklog.set_status(items, same.limit(0), same)
    assert shown.first()["current_status"] == "pending"
    earlier, _ = worklog.set_status(items, same.limit(0), frame(spark, [("i", "blocked", 1)], "item string, status string, at int"))
    assert earlier.first()["current_status"] == "done"


def test_larger_histories_are_more_tasks(spark, monkeypatch):
    """Tasks get bounded numbers of rows, and a node that all commits touch is spread too."""
    monkeypatch.setattr(session, "ROWS_A_TASK", 500)
    seen = spark.range(40000).select(F.lit("n").alias("node_id"), F.col("id").alias("commit"), F.lit("c").alias("content"), F.lit(0).alias("turn"))
    dealt = session.spread(seen.withColumn("block", F.floor(F.col("commit") / versions.BLOCK)), seen.count(), "node_id", "block")
    assert dealt.rdd.getNumPartitions() == 80
    assert max(dealt.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 40000
    assert [tuple(r) for r in versions.ranges(seen).collect()] == [("n", "c", 0, None)]
