"""Every operator on null, empty, long, tied and repeated rows, against brute force where SQL has no say."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brambleweft.llm import bpe, components, langid, line_dedup, mixing, quality_cnn, quality_rules, sharding, shingle_join, topk, url_filter
from brambleweft.llm.common import word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, size long, shard int"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [
    (1, None, "en", "a", 0, "x", 1, 1, 1),
    (2, "", None, None, 0, "x", 1, 1, 1),
    (3, " \t\n", "en", "a", 3, None, 1, 1, 1),
    (4, "The cat sat.\nThe cat sat.\n\nOn the mat", "en", "b", 9, "x", 1, 1, 1),
    (4, "The cat sat.\nThe cat sat.\n\nOn the mat", "en", "b", 9, "x", 1, 1, 1),
    (5, "der die das und üß \U0001f600", "de", None, 9, "x", 1, 1, 1),
    (None, "no id here", "en", "b", 9, "x", 1, 1, 1),
    (6, LONG, None, "a", 9, "x", 1, 1, 1),
    (7, "12 34", "", "a", 9, "x", 1, 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_language_id(odd, none, spark):
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(odd).collect()]
    assert len(got) == len(ODD) and all(0 <= s <= 1 for _, _, s in got)
    assert {p for i, p, _ in got if i in (1, 2, 3, 7)} == {"und"}
    assert langid.identify(none).collect() == []
    # Nothing to learn from: every text is undetermined.
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_profiles_are_bundles_of_bound_letters():
    a = langid.profiles(["ab"])[0]
    pairs, last = langid._vectors()
    slow = pairs[0 << 6 | 1] * last[2] + pairs[1 << 6 | 2].astype(float) * last[0]
    assert np.allclose(a, slow / np.linalg.norm(slow), atol=1e-6)


@pytest.mark.parametrize("name, field", [("langid", "lang"), ("cnn", "quality")])
def test_held_out_accuracy(spark, name, field):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = langid.identify(docs) if name == "langid" else quality_cnn.classify(docs, labels)
    truth = {r["doc_id"]: r[field] for r in (docs if name == "langid" else labels).collect()}
    rows = [r for r in got.collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = [truth[r["doc_id"]] == r["lang_pred" if name == "langid" else "predicted"] for r in rows]
    assert sum(right) >= 0.9 * len(right)


def test_mixing(odd, none):
    rows = odd.select("doc_id", "source", "text", word_count(F.col("text")).alias("size"))
    got = mixing.systematic_copies(rows, "doc_id", "source", F.col("size")).collect()
    assert sorted(r["size"] for r in got) == sorted(len(words(t[1])) for t in ODD)
    total = sum(r["size"] for r in got)
    targets = {r["row"]["source"]: (r["target"], r["source_size"]) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-9 for t, s in targets.values()) and all(0 <= r["copies"] <= 3 for r in got)
    again = mixing.systematic_copies(rows, "doc_id", "source", F.col("size")).collect()
    key = lambda r: (str(r["row"]["doc_id"]), str(r["row"]["text"]), r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mix(odd, "doc_id", "source", word_count(F.col("text")))
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(none, "doc_id", "source", word_count(F.col("text"))).collect() == []


def test_quality_classifier(odd, none, spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_cnn.classify(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality_cnn.classify(none, labels).collect() == []
    assert {r["score"] for r in quality_cnn.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_cnn.keep_good(odd, labels.limit(0)).columns == odd.columns


def test_network_sees_every_window_and_learns():
    rng = random.Random(1)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(5, 200))).encode() for _ in range(60)]
    bad = [t[:-6] + b"###!!!" for t in good]
    w = quality_cnn.train(good + bad, [1] * 60 + [0] * 60, epochs=30)
    assert quality_cnn.score_texts(w, good).mean() > 0.8 > 0.2 > quality_cnn.score_texts(w, bad).mean()
    one = np.array([quality_cnn.score_texts(w, [t])[0] for t in good])
    assert np.allclose(one, quality_cnn.score_texts(w, good), atol=1e-4)


def test_line_dedup(odd, none, spark):
    rows = [(i, f"common line\n own {i}\n\ncommon line ", f"s{i % 12}") for i in range(24)]
    rows += [(100 + i, "rare line\nx", f"s{i % 9}") for i in range(30)] + [(200 + i, "only this", f"s{i}") for i in range(10)]
    got = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=10).collect()}
    assert got[0]["text"] == "common line\n own 0\n" and got[1]["text"] == " own 1\n"
    assert got[100]["text"] == "rare line\nx" and got[200]["text"] == "only this" and got[201]["text"] == "" and got[201]["n_removed"] == 1
    same = line_dedup.dedup_lines(odd)
    assert sorted((str(r["row"]["doc_id"]), str(r["text"])) for r in same.collect()) == sorted((str(t[0]), str(t[1])) for t in ODD)
    assert line_dedup.dedup_lines(none).collect() == []


def brute_classes(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("size, num", [(4, 85), (5, 80)])
def test_ngram_join_against_brute_force(spark, odd, none, size, num):
    rng = random.Random(size)
    rows = [(r[0], r[1]) for r in ODD]
    for n in (4, 9, 12, 30, 80, 200):
        for _ in range(6):
            base = [f"v{rng.randrange(10**6)}" for _ in range(n)]
            for edits in (0, 1, 1, 2, 4):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(n)] = f"z{rng.randrange(10**6)}"
                rows.append((1000 + len(rows), " ".join(w[: n - rng.randrange(2)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shingle_join.classes(docs, size, num, 100).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_classes(rows, size, num, 100)
    left = shingle_join.one_of_each(docs, size, num, 100).collect()
    groups = {r["component_id"] for r in got if r["n_shingles"] and r["component_id"] is not None}
    assert {r["doc_id"] for r in left if words(r["text"]) and r["doc_id"] is not None} == groups
    assert shingle_join.classes(none, size, num, 100).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_quality_rules(odd, none):
    got = quality_rules.judge(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        texts = [t[1] for t in ODD if t[0] == r["doc_id"]]
        w = words(texts[0])
        seen = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        kept_lines = [x for x in (texts[0] or "").split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(hit), len(kept_lines) - len(set(kept_lines)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in texts[0] or "")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and (not r["kept"] or not r["base_failed"])
    assert quality_rules.judge(none).collect() == []


def test_url_filter(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    urls = ["http://A.Example.NET/en/1?x", "http://b.net/", "http://b.net", "http://notnet/", "https://example.com/de/a#b", "http://x.org/fr/", "mailto:x", None, "", "http://free-casino.example.com/en/1"]
    urls += [f"http://site{i}.example.com/en/{i}" for i in range(30)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(rows.withColumn("host", F.lit("clash")), rules).collect()}
    assert [got[i]["rule"] for i in range(9)] == ["example.net/en/", "net/", None, None, "example.com/de/", "org/fr/", None, None, None]
    assert (got[0]["host"], got[0]["path"]) == ("a.example.net", "/en/1") and (got[6]["host"], got[7]["path"]) == ("", "")
    assert got[7]["verdict"] == "allow" and got[9]["verdict"] == "block" and got[20]["verdict"] == "allow"
    assert url_filter.judge(rows.limit(0), rules).collect() == []


def test_url_filter_counts_words_beyond_the_vocabulary(spark):
    word = lambda i: "w" + "".join(chr(97 + i // 26**k % 26) for k in range(4))
    n = 7_500
    urls = ["http://example.com/" + "/".join(word(8 * i + k) for k in range(8)) for i in range(n)] * 8 + [f"http://casino{i}.example.com/win" for i in range(2400)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), {"x.org/": "block"})
    assert 8 * n > url_filter.VOCABULARY
    counts = got.groupBy("verdict", F.expr("path = '/win'").alias("win")).count().collect()
    assert {(r["verdict"], r["win"]): r["count"] for r in counts} == {("allow", False): 8 * n, ("block", True): 2400}


def test_url_filter_is_the_same_with_few_words_in_memory(spark):
    rng = random.Random(4)
    stock = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6))) for _ in range(60)]
    urls = [None, "", "mailto:x", "http://casino.example.com/win"] * 3
    for i in range(600):
        path = "/".join(rng.choices(stock, k=rng.randrange(4)) + ["pills"] * (i % 9 == 0))
        urls.append(f"http://{rng.choice(stock)}{rng.choice(stock)}.{'ads' if i % 10 == 0 else rng.choice(stock)}-{rng.choice(stock)}.example.com/{path}")
    rows = spark.createDataFrame([(i // 2, u) for i, u in enumerate(urls + urls[:50])], "page_id long, url string")
    one, few = (sorted(map(tuple, url_filter.judge(rows, {"x.com/": "block"}, **more).collect()), key=str) for more in ({}, {"vocabulary": 5}))
    key = lambda r: str(r[:3])
    assert len(one) == len(few) == len(urls) + 50 and len({r[4] for r in one}) == 2
    for a, b in zip(sorted(one, key=key), sorted(few, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    words, rare = url_filter.learn_words(rows.select(*[c.alias(k) for k, c in zip(("host", "path"), url_filter.parts(F.col("url")), strict=True)]), 5)
    assert rare.count() > 20 and url_filter.rare_names(rows.select(url_filter.parts(F.col("url"))[0].alias("host")), words, rare).count() > 100


def test_segmentation():
    assert url_filter.Words({"cheap": 5, "pills": 5, "the": 50}).split("cheappills") == ["cheap", "pills"]


def test_bpe(odd, none):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for t in ODD:
        ids = e.encode_ordinary(t[1] or "")
        want[(t[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t[1] or "").encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(odd).collect()) == want
    encoded = bpe.encode(odd)
    assert Counter(r["text"] for r in bpe.decode(encoded).collect()) == Counter(t[1] or "" for t in ODD)
    spans = {r["doc_id"]: r for r in encoded.collect()}
    assert spans[5]["ends"][-1] == len(ODD[5][1]) and bpe.digests(none).collect() == []
    with open(bpe.default_paths()[0], encoding="utf-8") as m, open(bpe.default_paths()[1], "rb") as r:
        codec = bpe.Codec(m.read(), r.read(), bpe.default_pattern())
    assert "".join(codec.pieces(codec.ids("a\U0001f600b"))) == "a\U0001f600b" and "�" not in "".join(codec.pieces(codec.ids("\U0001f600")))


def test_sharding(odd, none):
    got = sharding.number_slots(sharding.assign_shards(odd)).collect()
    assert len(got) == len(ODD)
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got)
    assert {r["key"]: r["size"] for r in got}[5] == len(ODD[5][1].encode()) + 8
    assert all(r["text_crc32"] == zlib.crc32(ODD[5][1].encode()) for r in got if r["key"] == 5)
    assert sharding.number_slots(sharding.assign_shards(none)).collect() == []


def test_shards_follow_weights(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r["shard"] for r in sharding.assign_shards(keys, weights=[1.0, 3.0]).collect())
    assert 0.7 < n[1] / 4000 < 0.8


def test_exact_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (700, 6)))]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(5000, None), (5050, [float("nan")] * 6), (5100, [None] * 6), (5150, []), (5200, [1.0]), (None, [1.0] * 6), (50, rows[50][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table, F.col("id") % 50 == 0).collect()]
    x = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            x.setdefault(i, []).append(np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 6 - len(v)))))
    want = []
    for q in [i for i in x if i % 50 == 0]:
        scored = sorted((-int(x[q][0] @ v), i) for i, vs in x.items() if i != q for v in vs)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(table.limit(0), F.col("id") % 50 == 0).collect() == []


def test_pruned_search_is_exact():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(0, 0.3, (4000, 3)))
    q, top = x[:5], float((x * x).sum(1).max())
    pivots = topk.fit_pivots(topk._lift(x, top))
    away, q_away = topk._distances(topk._lift(x, top), pivots), topk._distances(np.hstack([q, np.zeros((5, 1))]), pivots)
    scores, _, _ = topk.search_part(np.arange(5), q, np.full(5, -np.inf), np.arange(4000), x, away[:, 0], q_away[:, 0], top, 5)
    full = q @ x.T
    full[np.arange(5), np.arange(5)] = -np.inf
    assert np.array_equal(scores, -np.sort(-full, axis=1)[:, :5])


def test_search_of_clustered_vectors_prunes():
    """Cell by cell as the query does it: most scores are never computed, and none of the best is missed."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (12, 8))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.floor(256 * (centres[rng.integers(0, 12, 4000)] + rng.normal(0, 0.02, (4000, 8))))
    ids, own, top = np.arange(4000), np.arange(0, 4000, 50), float((x * x).sum(1).max())
    q, pivots = x[own], topk.fit_pivots(topk._lift(x[:2000], top))
    away, q_away = topk._distances(topk._lift(x, top), pivots), topk._distances(np.hstack([q, np.zeros((80, 1))]), pivots)
    sampled = q @ x[:2000].T
    sampled[own[:, None] == ids[None, :2000]] = -np.inf
    first, cell = np.partition(sampled, -5, axis=1)[:, -5], away.argmin(1)
    parts = [topk.search_part(own, q, first, ids[cell == c], x[cell == c], away[cell == c, c], q_away[:, c], top, 5) for c in np.unique(cell)]
    full = q @ x.T
    full[np.arange(80), own] = -np.inf
    assert np.array_equal(-np.sort(-np.hstack([p[0] for p in parts]), axis=1)[:, :5], -np.sort(-full, axis=1)[:, :5])
    assert sum(p[2] for p in parts) < full.size / 4
