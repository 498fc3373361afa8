"""Operators that SQL cannot express, against slow versions written another way."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from brambleweft.llm import bpe, langid, queries, quality_cnn, url_filter

SMALL, MIDDLE, LARGE = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_language_predictions_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    base = np.random.default_rng(langid.SEED).choice(np.array([-1, 1], np.int8), (langid.CLASSES, langid.DIMENSIONS)).astype(float)

    def letter(x):
        low = ord(x.lower()[0])
        return 0 if not x.isalpha() else low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 12) % 37

    def profile(text):
        c = [0, *map(letter, text or ""), 0]
        grams = Counter((c[i - 1], c[i], c[i + 1]) for i in range(1, len(c) - 1) if c[i])
        total = sum((math.log1p(n) * np.roll(base[a], 2) * np.roll(base[b], 1) * base[d] for (a, b, d), n in grams.items()), np.zeros(langid.DIMENSIONS))
        return total / (np.linalg.norm(total) or 1)

    vectors = {r["doc_id"]: profile(r["text"]) for r in docs}
    sums = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for r in docs:
        if not is_held_out(r["doc_id"]) and r["lang"] is not None and r["text"] is not None:
            sums[r["lang"]] += vectors[r["doc_id"]]
    names = sorted(sums)
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, SMALL).collect()}
    assert set(got) == set(vectors)
    for i, v in vectors.items():
        cosines = [float(v @ sums[x] / np.linalg.norm(sums[x])) for x in names]
        best = max(range(len(names)), key=lambda k: cosines[k])
        assert got[i]["held_out"] == is_held_out(i)
        if not v.any():
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
        else:
            assert got[i]["score"] == pytest.approx(max(0, cosines[best]), abs=1e-4)
            assert cosines[names.index(got[i]["lang_pred"])] == pytest.approx(cosines[best], abs=1e-4)


def slow_score(w, text):
    """One window at a time; pooled over chunks of the text and padding."""
    chunks = -(-(len(text) + quality_cnn.WIDTH) // quality_cnn.CHUNK)
    padded = text + bytes(chunks * quality_cnn.CHUNK + quality_cnn.WIDTH - len(text))
    peaks = []
    for c in range(chunks):
        answers = []
        for at in range(c * quality_cnn.CHUNK, (c + 1) * quality_cnn.CHUNK, quality_cnn.STRIDE):
            seen = np.concatenate([w["bytes"][b] for b in padded[at : at + quality_cnn.WIDTH]])
            answers.append(seen @ w["filters"] + w["bias"])
        peaks.append(np.max(answers, axis=0))
    pooled = np.tanh(np.concatenate([np.max(peaks, axis=0), np.min(peaks, axis=0)]))
    hidden = np.tanh(pooled @ w["hidden"] + w["hidden_bias"])
    return 1 / (1 + math.exp(-float(hidden @ w["out"][:, 0] + w["out_bias"][0])))


def test_network_against_one_window_at_a_time():
    rng = np.random.default_rng(3)
    w = quality_cnn.new_weights(rng)
    w["bias"] += 0.1
    texts = [b"", b"a", "ü\U0001f600".encode(), bytes(rng.integers(32, 127, 255, dtype=np.uint8)), bytes(rng.integers(32, 127, 256, dtype=np.uint8)), bytes(rng.integers(0, 256, 1500, dtype=np.uint8))]
    assert np.allclose(quality_cnn.score_texts(w, texts), [slow_score(w, t) for t in texts], atol=1e-4)


def test_gradients_are_slopes():
    rng = np.random.default_rng(4)
    w = {k: v.astype(np.float64) for k, v in quality_cnn.new_weights(rng).items()}
    texts, y = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (40, 300, 700)], np.array([1.0, 0, 1])

    def loss():
        p = np.array([slow_score(w, t) for t in texts])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = quality_cnn._gradients(w, texts, y)
    for name in ("out", "out_bias", "hidden", "hidden_bias", "bias", "filters", "bytes"):
        flat = w[name].reshape(-1)
        most = np.argsort(-np.abs(found[name].reshape(-1)))[:3]
        for i in most:
            kept, step = flat[i], 1e-5
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            slope = (up - loss()) / (2 * step)
            flat[i] = kept
            assert found[name].reshape(-1)[i] == pytest.approx(slope, rel=1e-2, abs=1e-6), name


def test_quality_scores_of_a_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_cnn.learn(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    got = {r["doc_id"]: r for r in queries.op3_quality_classifier(spark, SMALL).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and max(len(r["text"] or "") for r in rows) > 10_000
    for r in rows:
        want = slow_score(model, (r["text"] or "").encode())
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-3) and got[r["doc_id"]]["held_out"] == is_held_out(r["doc_id"])


def test_long_texts_teach_too(spark):
    """A class that has long texts only is learned, not left out."""
    good, bad = "the river runs by the old mill ", "#### $$$ %%%% &&&& "
    rows = [(i, good * (2 + i % 40)) for i in range(300)] + [(1000 + i, bad * 1800) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows], "doc_id long, quality int")
    assert all(len(t) > quality_cnn.LONGEST for i, t in rows if i >= 1000)
    got = quality_cnn.classify(docs, labels).collect()
    assert all(r["predicted"] == (r["doc_id"] < 1000) for r in got)


def test_repeated_ids_teach_alike(spark):
    rows = [(i, f"good words here {i}") for i in range(30)] + [(100 + i, f"## bad ## {i}") for i in range(30)] + [(i, "another text of the id") for i in range(30)]
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)], "doc_id long, quality int")
    one, two = (quality_cnn.learn(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (rows, rows[::-1]))
    assert all(np.array_equal(one[k], two[k]) for k in one)


def test_ids_of_a_whole_table(spark):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_byte_bpe(spark, MIDDLE).collect()}
    spans = {r["doc_id"]: r for r in bpe.encode(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(spans) == len(rows)
    for r in rows:
        text = r["text"] or ""
        ids, own = e.encode_ordinary(text), spans[r["doc_id"]]
        assert own["ids"] == ids and got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        # Every span is the shortest that holds the token's bytes, so spans cover the text.
        at = 0
        for i, a, b in zip(ids, own["starts"], own["ends"], strict=True):
            size = len(e.decode_single_token_bytes(i))
            assert len(text[:a].encode()) <= at and at + size <= len(text[:b].encode()) and (b - a == 1 or len(text[: a + 1].encode()) > at)
            at += size
        assert at == len(text.encode())


def test_split_characters_are_counted(spark):
    rows = [(1, "a\U0001f600b"), (2, "plain"), (3, None), (4, "\U0001f600\U0001f601 é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_split"] for r in bpe.digests(docs).collect()}
    for r in bpe.encode(docs).collect():
        inside = sum(b < a for a, b in zip(r["ends"], r["starts"][1:], strict=False))
        assert got[r["doc_id"]] == inside
    assert got[1] > 0 and got[2] == got[3] == 0


def test_the_query_takes_ids_and_offsets_from_one_place(spark, monkeypatch):
    """Without the codec's own encoding and decoding there is no result."""
    for name in ("encode", "decode", "raw"):
        with monkeypatch.context() as m:
            m.setattr(bpe.Codec, name, lambda *_: 1 / 0)
            codec = object.__new__(bpe.Codec)
            with pytest.raises(ZeroDivisionError):
                getattr(codec, name)("x")
    with open(bpe.default_paths()[0], encoding="utf-8") as f, open(bpe.default_paths()[1], "rb") as r:
        codec = bpe.Codec(f.read(), r.read(), bpe.default_pattern())
    codec.matches = lambda text: re.findall("[a-z]+", text)
    with pytest.raises(ValueError, match="do not cover"):
        codec.encode(["leaves out blanks"])
    assert codec.decode(codec.tokenizer.encode("é").ids) == "é".encode()


# --- url filter


def slow_split(name, counts, total):
    """The likeliest words: all ways to cut, by recursion; ties go to the way the last word of which is longest."""

    def cost(word):
        n = counts.get(word)
        return -math.log(n / total) if n else math.log(total) - math.log(10) + len(word) * math.log(10)

    @cache
    def best(end):
        if not end:
            return 0.0, ()
        ways = []
        for start in range(max(0, end - url_filter.LONGEST), end):
            before, words = best(start)
            ways.append((before + cost(name[start:end]), start, words))
        c, start, words = min(ways, key=lambda w: (round(w[0], 9), w[1]))
        return c, (*words, name[start:end])

    return list(best(len(name))[1])


def slow_judge(urls, rules, seeds=url_filter.SEEDS):
    parts = []
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        parts.append((re.sub("[A-Z]", lambda m: m[0].lower(), host), path))
    counts, shared, n_shared, names = Counter(), defaultdict(set), Counter(), set()
    for host, path in parts:
        for label in re.sub(":.*", "", host).split("."):
            if "-" in label:
                counts.update(w for w in re.split(r"[^a-zà-ÿ]+", label) if w)
            else:
                shared[label].add(host)
                n_shared[label] += 1
            names.update(re.findall(r"[^\W\d_]+", label))
        counts.update(w for w in re.split(r"[^a-zà-ÿ]+", path.lower()) if w)
    for label, hosts in shared.items():
        if label and len(hosts) >= url_filter.COMMON:
            counts[label] += n_shared[label]
    runs = Counter(r for n in names for r in {n[i:j] for i in range(len(n)) for j in range(i + 2, min(len(n), i + url_filter.LONGEST_RUN) + 1)})
    counts.update({r: n for r, n in runs.items() if n >= url_filter.COMMON})
    for _ in range(2):
        counts = Counter({w: n for w, n in counts.items() if len(w) <= url_filter.LONGEST})
        total = sum(counts.values()) + 1
        split = {n: slow_split(n, counts, total) for n in names}
        if _ == 0:
            counts = Counter(w for words in split.values() for w in words)
    found = [[w for label in host.split(":")[0].split(".") for run in re.findall(r"[^\W\d_]+|\d+", label) for w in (["<digits>"] if run[0].isdigit() else split[run])] for host, _ in parts]
    words = {host: [w for w in t if w != "<digits>"] for (host, _), t in zip(parts, found, strict=True)}
    words = {h: w for h, w in words.items() if w}
    spread = Counter(w for ws in words.values() for w in set(ws))
    share = {h: 100 * sum(len(w) for w in ws if spread[w] <= url_filter.FEW) // sum(map(len, ws)) for h, ws in words.items()}
    ordered = sorted(share.values())
    q1, q3 = (ordered[-(-q * len(ordered) // 4) - 1] for q in (1, 3))
    tokens = []
    for (host, path), t in zip(parts, found, strict=True):
        shape = [f"<rare:{share[host] // 10}>", f"<words:{len(words[host])}>"] if host in words else []
        tokens.append(t + ["/<digits>" if r[0].isdigit() else "/" + r for r in re.findall(r"[^\W\d_]+|\d+", path.lower())] + shape)
    block = [900 if set(t) & set(seeds) else 300 if set(t) & {f"/{w}" for w in seeds} else 100 if share.get(h, 0) > q3 + 1.5 * (q3 - q1) else 10 for t, (h, _) in zip(tokens, parts, strict=True)]
    for _ in range(url_filter.ROUNDS + 1):
        b, a = Counter(), Counter()
        for t, r in zip(tokens, block, strict=True):
            for w in t:
                b[w] += r / 1000
                a[w] += 1 - r / 1000
        kinds = len(set(b)) + 1
        odds = {w: math.log((b[w] + 1) / (sum(b.values()) + kinds)) - math.log((a[w] + 1) / (sum(a.values()) + kinds)) for w in b}
        r = sum(block) / 1000
        prior = math.log((r + 1) / (len(urls) - r + 1))
        score = [prior + sum(odds[w] for w in t) for t in tokens]
        block = [math.floor(1000 / (1 + math.exp(-s)) + 0.5) for s in score]
    out = []
    for (host, path), t, s in zip(parts, tokens, score, strict=True):
        fits = [k for k in rules if (host == k.split("/", 1)[0] or host.endswith("." + k.split("/", 1)[0])) and path.startswith("/" + k.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        out.append((host, path, rule, rules[rule] if rule else "block" if s > 0 and t else "allow", s))
    return out


@pytest.mark.parametrize("seeds", [url_filter.SEEDS, ()])
def test_url_verdicts_of_a_whole_table(spark, seeds):
    """With the word list and without it."""
    pages = spark.read.parquet(f"{LARGE}/pages.parquet").select("page_id", "url")
    rows = pages.collect()
    want = dict(zip([r["page_id"] for r in rows], slow_judge([r["url"] for r in rows], queries.URL_RULES, seeds), strict=True))
    found = queries.op7_url_filter(spark, LARGE) if seeds else url_filter.judge(pages, queries.URL_RULES, seeds=seeds)
    got = {r["page_id"]: r for r in found.collect()}
    assert set(got) == set(want)
    for i, (host, path, rule, verdict, score) in want.items():
        assert tuple(got[i])[1:5] == (host, path, rule, verdict)
        assert got[i]["log_odds"] == pytest.approx(score, abs=1e-3)
    assert len({v[3] for v in want.values() if v[2] is None}) == 2


def test_words_of_few_hosts_speak_against_a_url_without_any_list(spark):
    """Names made of the table's common words are left alone."""
    stock = ("river", "stone", "green", "field", "north", "light", "water", "house")
    urls = [f"http://{stock[i % 8]}{stock[(i // 8) % 8]}.example.org/{i}" for i in range(640)] + [f"http://qz{'abcdefgh'[i % 8] * 3}xk.example.org/{i}" for i in range(24)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(rows, {"x.org/": "block"}, seeds=()).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == set(range(640, 664))


@pytest.mark.parametrize("name", ["cheappills", "thecheapcat", "catcat", "unknownword", "pillsx", "a"])
def test_viterbi_against_all_ways_to_cut(name):
    counts = {"cheap": 5, "pills": 5, "the": 50, "cat": 9, "x": 1, "he": 2}
    words = url_filter.Words(counts)

    def cost(way):
        return sum(words.cost.get(w, words._unknown(len(w))) for w in way)

    ways = [[]]
    for at in range(2 ** (len(name) - 1)):
        cuts = [0, *(i + 1 for i in range(len(name) - 1) if at >> i & 1), len(name)]
        ways.append([name[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    assert cost(words.split(name)) == pytest.approx(min(map(cost, ways[1:])))


def test_verdicts_that_the_word_list_does_not_give(spark):
    urls = []
    for i in range(60):  # words of the list, always beside others
        urls += [f"http://casino-jackpot.example.com/spin/{i}", f"http://luckyjackpot.example.net/spin/{i}?poker"]
    for i in range(600):
        urls += [f"http://library-{'abcdefgh'[i % 8]}.example.org/books/{i}", f"http://archive.example.org/books/history/{i}"]
    urls += [f"http://jackpot-spin{i}.example.com/spin/{i}" for i in range(20)]  # none of the list
    urls += [f"http://library-desk.example.org/books/history/loan/{i}" for i in range(5)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(rows, {"x.org/": "block"}).collect()
    listed = lambda u: set(re.findall("[a-z]+", u)) & set(url_filter.SEEDS)
    blocked = [r for r in got if r["verdict"] == "block"]
    assert [r for r in blocked if not listed(urls[r["page_id"]])], "a url without a word of the list is blocked"
    assert all(r["verdict"] == "block" for r in got if "jackpot-spin" in r["host"])
    assert all(r["verdict"] == "allow" for r in got if "library" in r["host"] or "archive" in r["host"])
