"""The join's parts: memory of the tree walk, long texts in pieces, and clusters in blocks."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from brambleweft.llm import components, shingle_join
from test_operators import brute_classes

U = np.uint64


def near_copies(groups, each, seed=0):
    """Groups of bitmaps that differ in few bits from one bitmap a group; the same items in each."""
    rng = np.random.default_rng(seed)
    maps, who = [], []
    for _ in range(groups):
        base, found = rng.integers(0, 2**63, dtype=U), set()
        while len(found) < each:
            found.add(int(base ^ U(1) << U(rng.integers(64)) ^ U(1) << U(rng.integers(64))))
        maps.append(np.sort(np.array(list(found), U)))
        who.append(rng.permutation(each))
    return np.concatenate(maps), np.arange(groups) * each, np.concatenate(who)


def test_tree_walk_needs_no_memory_for_pairs():
    maps, starts, who = near_copies(10, 2000)
    tracemalloc.start()
    links = shingle_join.near_bitmaps(maps, starts, np.full(len(maps), 5), who)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Ten groups have 19 990 000 pairs; a forest over 2 000 items has 1 999 links.
    assert len(links) == 1999 and peak < 64 << 20


@pytest.mark.parametrize("most, seed", [(2, 2), (3, 5), (1, 7)])
def test_tree_walk_joins_what_brute_force_joins(most, seed):
    maps, starts, who = near_copies(2, 25, seed=seed)
    links = shingle_join.near_bitmaps(maps, starts, np.full(len(maps), most), who)
    want, got = shingle_join.Union(25), shingle_join.Union(25)
    for g in range(2):
        for i in range(25 * g, 25 * g + 25):
            for j in range(25 * g, i):
                if bin(int(maps[i]) ^ int(maps[j])).count("1") <= most:
                    want.join(who[[i]], who[[j]])
    got.join(links[:, 0], links[:, 1])
    assert np.array_equal(want.label, got.label) and (most == 1) == (len(set(want.label)) == 25)


@pytest.mark.parametrize("piece", [1, 2, 7, 64])
def test_words_are_the_same_in_pieces(monkeypatch, piece):
    rng = random.Random(piece)
    texts = [b"", b" ", b"A", "".join(rng.choice("aAbZ \n\tzé") for _ in range(300)).encode(), b"x" * 150, b" a  b "]
    whole = shingle_join.shingle_sets(texts, 3)
    keys = [np.concatenate(x) for x in zip(*shingle_join.key_rows(shingle_join.Scheme(80, 100), *whole), strict=True)]
    monkeypatch.setattr(shingle_join, "PIECE", piece)
    for a, b in zip(whole, shingle_join.shingle_sets(texts, 3), strict=True):
        assert np.array_equal(a, b)
    # Key rows do not depend on windows and parts either.
    again = [np.concatenate(x) for x in zip(*shingle_join.key_rows(shingle_join.Scheme(80, 100), *whole), strict=True)]
    rows = lambda k: Counter(zip(*(x.tolist() for x in k), strict=True))
    assert rows(keys) == rows(again) and len(keys[0])


def test_shingles_of_cases_and_blanks():
    a, b = (shingle_join.shingle_sets([t], 2) for t in (b"The CAT\x0bsat", b"  the cat  SAT\n"))
    assert np.array_equal(a[0], b[0]) and a[1].tolist() == [2]
    assert not np.array_equal(a[0], shingle_join.shingle_sets([b"the cat sit"], 2)[0])


@pytest.mark.parametrize("n", [2, 3, 9, 80])
def test_every_cluster_goes_through_its_tree(monkeypatch, n):
    rng = np.random.default_rng(n)
    base = np.sort(rng.integers(0, 2**63, 100, dtype=U))
    sets = [np.unique(np.append(base[: 100 - i % 7], rng.integers(0, 2**63, 3, dtype=U))) for i in range(n)] + [np.sort(rng.integers(0, 2**63, 90, dtype=U))]
    called = []
    walk = shingle_join._wide_maps
    monkeypatch.setattr(shingle_join, "_wide_maps", lambda *a: called.append(len(a[0])) or walk(*a))
    links = shingle_join.linked_sets(sets, 80, 100)
    assert called == [n + 1] and len(links) == n - 1 and not any(n in pair for pair in links)
    # Components that are known already need no link.
    assert shingle_join.linked_sets(sets, 80, 100, [0] * n + [1]) == []


def test_large_clusters_in_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "SETS", 4)
    monkeypatch.setattr(shingle_join, "LEADERS", 2)
    rng, rows = random.Random(3), []
    base = [f"v{i}" for i in range(60)]
    for i in range(40):  # a chain: neighbours are linked, ends are not, so leaders do not join it
        rows.append((i, " ".join(base[i // 2 :] + [f"c{k}" for k in range(i // 2)])))
    for i in range(30):  # near copies of one text
        w = [f"n{k}" for k in range(80)]
        w[rng.randrange(80)] = f"z{i}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, f"alone {i} " * 9) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shingle_join.classes(docs, 2, 80, 100).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_classes(rows, 2, 80, 100)


def test_components_of_stars_and_trees(spark):
    rng = random.Random(1)
    links = [(1000, i) for i in range(50)] + [(2000 + i, 3000) for i in range(50)] + [(rng.randrange(4000, 4400), rng.randrange(4000, 4400)) for _ in range(300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for u, v in links for x in (u, v) if u != v}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []
