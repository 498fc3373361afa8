"""Streams with state: replays, restarts, counts, and effects that come once."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from brambleweft.operators import watching
from brambleweft.streaming import replay


def events(spark, rows):
    return spark.createDataFrame(rows, replay.EVENT)


def slow(parts, root):
    """The same, one event list at a time."""
    last, out, counted = {}, [], []
    for part in parts:
        best, ignored = {}, 0
        for path, *x in part:
            if path is None or not path.startswith(root) or not path.endswith(".rs") or "target/" in path:
                ignored += 1
                continue
            x = (x[0] if x[0] is not None else -(1 << 63), x[1], x[2] or "")
            path = path[len(root) :]
            best[path] = max(best.get(path, x), x)
        changed = 0
        for path, x in best.items():
            if path not in last or (x > last[path] and x[2] != last[path][2]):
                out.append((path, *x))
                changed += 1
            last[path] = max(last.get(path, x), x)
        counted.append((len(part) - ignored, ignored, changed))
    return sorted(out), counted


def made(seed, n=120):
    r = random.Random(seed)
    path = lambda: r.choice(["/w/a.rs", "/w/b.rs", "/w/src/c.rs", "/w/target/d.rs", "/x/a.rs", "/w/e.png", None])
    return [[(path(), r.choice([None, *range(20)]), r.randrange(5), r.choice(["x", "y", "", None])) for _ in range(n)] for _ in range(3)]


def test_a_replay_gives_what_one_pass_gives(spark, tmp_path):
    parts = made(1)
    want, counted = slow(parts, "/w/")
    got = replay.replay(spark, f"{tmp_path}/r", [events(spark, p) for p in parts], "/w/")
    assert [(c["accepted"], c["ignored"], c["changed"]) for c in got] == counted
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/r/out").collect()) == want
    # Nothing new: no batch, and no change is handed on again.
    assert replay.run(spark, f"{tmp_path}/r", "/w/") == []
    # All events once more: only what ended with another content than the newest could change, and nothing is newer.
    again = replay.replay(spark, f"{tmp_path}/r", [events(spark, p) for p in parts], "/w/")
    assert [c["changed"] for c in again] == [0, 0, 0]


def breaking():
    """Made here, so that it is sent to workers as a whole."""

    class Breaks(replay.Newest):
        def handleInputRows(self, key, rows, timerValues):
            for out in replay.Newest.handleInputRows(self, key, rows, timerValues):
                if key[0] == "b.rs":
                    raise RuntimeError("stopped in the middle")
                yield out

    return Breaks


def test_a_batch_that_was_stopped_is_done_again_and_counts_once(spark, tmp_path, monkeypatch):
    parts, broken = [[("/w/a.rs", 1, 0, "x")], [("/w/a.rs", 2, 0, "y"), ("/w/b.rs", 1, 0, "x")], [("/w/a.rs", 3, 0, "y"), ("/w/b.rs", 2, 0, "z")]], breaking()
    folder, out = f"{tmp_path}/s", []
    out += replay.replay(spark, folder, [events(spark, parts[0])], "/w/")
    with monkeypatch.context() as m:
        m.setattr(replay, "Newest", broken)
        with pytest.raises(Exception, match="stopped in the middle"):
            replay.replay(spark, folder, [events(spark, parts[1])], "/w/")
    out += replay.run(spark, folder, "/w/")
    out += replay.replay(spark, folder, [events(spark, parts[2])], "/w/")
    want, counted = slow(parts, "/w/")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()) == want
    assert [(c["accepted"], c["ignored"], c["changed"]) for c in out] == counted


def test_a_hot_path_reaches_the_state_once_a_batch_of_rows(spark):
    import pandas as pd

    part = pd.DataFrame({"path": ["a"] * 1000 + ["b"], "at": [*range(1000), 5], "tie": [0] * 1001, "content": ["x"] * 1001})
    (small,) = replay._newest_of_each([part])
    assert sorted(map(tuple, small.values.tolist())) == [("a", 999, 0, "x"), ("b", 5, 0, "x")]


def test_a_path_in_many_batches_of_rows_reaches_the_state_once(monkeypatch):
    import pandas as pd

    parts = [pd.DataFrame({"path": ["a", f"p{k}"], "at": [k % 7, k], "tie": [k, 0], "content": ["x", "y"]}) for k in range(40)]
    (small,) = replay._newest_of_each(parts)
    want = sorted([("a", 6, 34, "x")] + [(f"p{k}", k, 0, "y") for k in range(40)])
    assert sorted(map(tuple, small.values.tolist())) == want
    # What is held is bounded, and nothing is lost.
    monkeypatch.setattr(replay, "HELD", 10)
    some = list(replay._newest_of_each(parts))
    assert len(some) > 4 and max(map(len, some)) <= 12
    assert sorted(map(tuple, replay._newest(pd.concat(some)).values.tolist())) == want
    assert list(replay._newest_of_each([])) == []


def test_a_path_reads_its_state_once_and_needs_no_frame():
    class State:
        value, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    newest, row = replay.Newest(), lambda at, content: Row(path="a", at=at, tie=0, content=content)
    newest.last = state = State()
    given = [[row(2, "x"), row(1, "y")], [row(3, "x")], [row(1, "z")], [row(4, "w")], []]
    out = [[tuple(x) for x in newest.handleInputRows(("a",), iter(rows), None)] for rows in given]
    assert out == [[("a", 2, 0, "x")], [], [], [("a", 4, 0, "w")], []]
    assert state.calls == ["get", "update", "get", "update", "get", "get", "update", "get"] and state.value == (4, 0, "w")


def test_effects_of_a_repeated_batch_come_once(spark, tmp_path):
    watched = spark.createDataFrame([("a", "0"), ("b", "0"), ("c", None), ("d", "0")], "node_id string, watch_baseline_body string")
    bodies = [[("a", "1"), ("b", "0"), ("c", "1"), ("x", "1"), ("a", "0")], [("a", "1"), ("b", "2"), ("d", None)], [("a", "0"), ("b", "2")]]
    frames = [spark.createDataFrame(b, "node_id string, body string") for b in bodies]
    shown = lambda folder: [sorted(map(tuple, t.collect()), key=str) for t in watching.effects(spark, folder)]
    assert shown(f"{tmp_path}/none") == [[], [], []]
    for k, b in enumerate(frames):
        watching.apply_batch(spark, f"{tmp_path}/once", k, watched, b)
    for k in (0, 0, 1, 0, 1, 2, 1, 2):  # what comes again starts from what came before it
        watching.apply_batch(spark, f"{tmp_path}/often", k, watched, frames[k])
    once = shown(f"{tmp_path}/once")
    assert once == shown(f"{tmp_path}/often")
    assert [(n, before, after) for n, _, before, after, _ in once[0]] == [("watch-0-a", "0", "1"), ("watch-1-b", "0", "2"), ("watch-2-a", "1", "0")]
    newest = watching.with_baselines(watched, watching.effects(spark, f"{tmp_path}/once")[2])
    assert sorted(map(tuple, newest.select("node_id", "watch_baseline_body").collect())) == [("a", "0"), ("b", "2"), ("c", None), ("d", "0")]
    assert watching.effects(spark, f"{tmp_path}/once")[1].where(F.col("src") == "watch-1-b").first()["dst"] == "b"
