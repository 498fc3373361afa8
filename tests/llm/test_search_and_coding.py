"""Lexical search, SentencePiece and fill-in-middle on odd rows and against slow versions; long texts in bounded memory."""

import hashlib
import math
import random
import re
import subprocess
import sys
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brambleweft.llm import bpe, fill_middle, langid, lexical, piece_bpe, queries

SMALL, MIDDLE = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01"))
SCHEMA = "doc_id long, text string, row string, block long, term string, at int, n long, score long, units string"
ODD = [
    (1, None, "x", 1, "x", 1, 1, 1, "x"),
    (2, "", None, 1, None, 1, 1, 1, "x"),
    (3, " \t\n", "x", 1, "x", 1, 1, 1, "x"),
    (4, "The cat sat.\nThe cat sat.\n\nOn the MAT", "x", 1, "x", 1, 1, 1, "x"),
    (4, "The cat sat.\nThe cat sat.\n\nOn the MAT", "x", 1, "x", 1, 1, 1, "x"),
    (5, "der die das und üß \U0001f600 ▁▁ x", "x", 1, "x", 1, 1, 1, "x"),
    (None, "no id here, cat", "x", 1, "x", 1, 1, 1, "x"),
    (6, "cat " * 30_000 + "\n" * 5000, "x", 1, "x", 1, 1, 1, "x"),
    (7, "holds a <S> mark\ncat", "x", 1, "x", 1, 1, 1, "x"),
    (8, "sat on a mat with a cat\n", "x", 1, "x", 1, 1, 1, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- lexical search


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def slow_ranks(docs, items, k):
    """Every row against every item; docs are (id, text) and items (id, text)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in wanted.items():
        scores = []
        for i, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def ranked(docs, items, k):
    return sorted((tuple(r) for r in lexical.rank(docs, items, k).collect()), key=str)


def test_search_on_odd_rows(spark, odd, none):
    asked = [(1, "Cat, MAT?"), (2, None), (3, ""), (4, "neverseen"), (5, "cat"), (5, "üß sat"), (None, "die cat")]
    items = spark.createDataFrame([(i, t, "x") for i, t in asked], "item_id long, text string, doc_id string")
    for k in (1, 2, 50):
        assert ranked(odd, items, k) == slow_ranks([(r[0], r[1]) for r in ODD], asked, k)
    assert ranked(none, items, 3) == [] == ranked(odd, items.where("false"), 3)


def test_search_in_small_blocks_and_buckets(spark, monkeypatch):
    """What one block or bucket decides is the same in many, ties included."""
    r = random.Random(5)
    docs = [(i % 290, " ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 40)))) for i in range(300)]
    asked = [(i, " ".join(r.choice("abcdefghz") * r.randint(1, 2) for _ in range(r.randint(1, 6)))) for i in range(40)]
    items = spark.createDataFrame(asked, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(lexical, "RUN", 7)
    folder = f"{lexical.shared_folder(spark)}/small-blocks-{uuid.uuid4().hex}"
    corpus = lexical.build_index(frame, folder, postings=50)
    assert spark.read.parquet(folder).select("block").distinct().count() > 20
    got = lexical.search(spark, folder, corpus, items, 7, pairs=16)
    assert sorted((tuple(x) for x in got.collect()), key=str) == slow_ranks(docs, asked, 7)


def test_bytes_bound_impacts_from_above():
    import numpy as np

    tf, n = np.array([1, 2, 50, 4_000_000]), np.array([1, 900, 50, 5_000_000])
    exact = lexical.impacts(tf, n, 1000, 300_000)
    byte = -(-exact // lexical.UNIT)
    assert (byte * lexical.UNIT >= exact).all() and ((byte - 1) * lexical.UNIT < exact).all() and byte.max() < 256


def test_only_documents_near_the_best_are_scored_again(spark):
    """The first level leaves few candidates."""
    docs = spark.createDataFrame([(i, "common " * (1 + i % 7) + ("rare " * (i % 5) if i % 97 == 0 else "") + f"w{i}") for i in range(3000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "common rare")], "item_id long, text string")
    folder = f"{lexical.shared_folder(spark)}/candidates-{uuid.uuid4().hex}"
    corpus = lexical.build_index(docs, folder, postings=2000)
    kept = []
    whole, lexical.checkpoint = lexical.checkpoint, lambda df: kept.append(whole(df)) or kept[-1]
    try:
        found = lexical.search(spark, folder, corpus, items, 5).collect()
    finally:
        lexical.checkpoint = whole
    assert len(found) == 5
    bounded = kept[-1]
    assert bounded.select(F.sum(F.size("at"))).first()[0] < 3000 / 2


# --- SentencePiece


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_bpe.default_path())


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pieces_of_a_whole_table(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_sentencepiece(spark, MIDDLE).collect()}
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "")
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_pieces_on_odd_rows(odd, none, library):
    want = Counter((i, len(ids := library.encode(t or "")), digest(",".join(map(str, ids))), digest(library.decode(ids))) for i, t, *_ in ODD)
    assert Counter(tuple(r) for r in piece_bpe.digests(odd).collect()) == want
    encoded = piece_bpe.encode(odd)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == Counter((i, tuple(library.encode(t or ""))) for i, t, *_ in ODD)
    assert Counter((r["doc_id"], r["text"]) for r in piece_bpe.decode(encoded).collect()) == Counter((i, library.decode(library.encode(t or ""))) for i, t, *_ in ODD)
    assert piece_bpe.digests(none).collect() == piece_bpe.encode(none).collect() == []


@pytest.mark.parametrize("run", [1, 3, 17, 1 << 16])
def test_agenda_against_the_library(monkeypatch, library, run):
    monkeypatch.setattr(piece_bpe, "RUN", run)
    with open(piece_bpe.default_path(), "rb") as f:
        codec = piece_bpe.PieceCodec(f.read())
    r = random.Random(run)
    parts = ["a", "b", "the ", " ", "  ", "\n", "▁", "é", "é", "日", "本", "\t", "<", "s", ">", "0x", "\U0001f600", "\x00", "ing", "tion", "    ", "　", "\r", "--", "==", "aaaa"]
    for _ in range(800):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 50)))
        ids = library.encode(text)
        (s,) = piece_bpe._summed(codec, [text.encode()], True)
        assert [i for a in s.ids for i in a.tolist()] == ids == codec.encode(text)
        assert (s.listed.hexdigest(), s.text.hexdigest()) == (digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_a_wrong_agenda_is_noticed(library):
    with open(piece_bpe.default_path(), "rb") as f:
        codec = piece_bpe.PieceCodec(f.read())
    codec.agenda = list
    with pytest.raises(ValueError, match="the library encodes otherwise"):
        codec.encode("the water")


def test_words_side_by_side_are_merged_like_each_alone(monkeypatch, library):
    with open(piece_bpe.default_path(), "rb") as f:
        codec = piece_bpe.PieceCodec(f.read())
    r = random.Random(5)
    parts = ["▁", "the", "a", "é", "日", "ü", "\U0001f600", "\x00", "ing", "==", "aaaa", "0", "Q", "\ue000"]
    words = ["".join(r.choice(parts) for _ in range(r.randint(1, 14)))[:size] for size in (1, 2, 3, 8, 9, 12, 13, 16, 17, 31, 32) for _ in range(60)] + ["", "a" * 40]
    alone = [codec._heaped(w) for w in words]
    monkeypatch.setattr(piece_bpe, "TOGETHER", 50)
    assert codec.agenda(words) == alone and codec.agenda([]) == []
    # Words of up to 32 characters have no agenda of their own.
    monkeypatch.setattr(codec, "_heaped", None)
    assert codec.agenda(words[:-1]) == alone[:-1]


def test_long_stretches_without_blanks(library):
    with open(piece_bpe.default_path(), "rb") as f:
        codec = piece_bpe.PieceCodec(f.read())
    r = random.Random(2)
    for text in ("a" * 5000, " " * 3000 + "x", "".join(r.choice("abcdefgh0123日") for _ in range(20_000)), "=" * 999):
        assert codec.encode(text) == library.encode(text)


# --- fill in the middle


@pytest.mark.parametrize("grammar", [fill_middle.LINES, fill_middle.WORDS, fill_middle.SENTENCES, r"\d+|\D+", r"\S+\s*|\s+", r"[^;]*[;]|[^;]+"])
def test_units_are_the_matches_of_the_grammar(spark, grammar):
    r = random.Random(9)
    texts = ["", "\n", "\n\n", "a", "a\n", "\na", " a  b ", "x.\n!? y", "12a3", ";;a;"] + ["".join(r.choice("ab \n.!;1é\U0001f600") for _ in range(r.randint(1, 30))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fill_middle.units(F.col("text"), grammar).alias("units")).collect()
    for x in rows:
        assert x["units"] == re.findall(grammar, x["text"], re.ASCII), (grammar, x["text"])


def test_other_grammars_and_marks_are_refused(spark, odd):
    for grammar in ("a|b", r"[^\n]*x|[^\n]+", r"\w+"):
        with pytest.raises(ValueError):
            fill_middle.boundary(grammar)
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "S", "<M>"), ("<P<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.transform(odd, marks=marks)


def test_fill_middle_on_odd_rows(odd, none):
    done = fill_middle.transform(odd).withColumn("again", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(done) == len(ODD)
    for r in done:
        text = r["row"]["text"] or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        h = hashlib.sha256(f"7:{'' if r['row']['doc_id'] is None else r['row']['doc_id']}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
        pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
        plain = not text or any(m in text for m in fill_middle.MARKS)
        form = "plain" if plain else "spm" if h4 % 100 < 50 else "psm"
        out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        assert (r["n"], r["form"], r["output"], r["again"]) == (len(lines), form, out, text)
        assert (r["prefix"], r["middle"], r["suffix"]) == ((None,) * 3 if plain else (pre, mid, suf))
    assert fill_middle.transform(none).collect() == []


def test_rates_of_fill_middle(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    forms = Counter(r["form"] for r in fill_middle.transform(docs, rate=50, spm=20).select("form").collect())
    assert 900 < forms["plain"] < 1100 and 140 < forms["spm"] < 260
    other = fill_middle.transform(docs, seed=8).select("output").collect()
    assert other != fill_middle.transform(docs).select("output").collect()


# --- texts of 26 MB

MEASURED = """
import resource, sys
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
words = " ".join(f"w{i % 99991} Haus, the river's {i % 7}" for i in range(40_000))
text = (words + "\\n") * (26_000_000 // len(words))
raw = text.encode()
WORK
"""

WORK = {
    "op1": "from brambleweft.llm import langid\nlangid.profiles(['a']); before = peak(); langid.profiles([text])",
    "op8": "from brambleweft.llm import bpe\nc = bpe.Codec(open(bpe.default_paths()[0]).read(), open(bpe.default_paths()[1], 'rb').read(), bpe.default_pattern())\n"
    "bpe._summed(c, [b'a'], {'ids', 'ids_sha256'}); before = peak(); bpe._summed(c, [raw], {'ids', 'ids_sha256'})",
    "op11": "from brambleweft.llm import lexical\nlexical._counts(b'a'); before = peak(); lexical._counts(raw)",
    "op12": "from brambleweft.llm import piece_bpe\nc = piece_bpe.PieceCodec(open(piece_bpe.default_path(), 'rb').read())\npiece_bpe._summed(c, [b'a'], True); before = peak(); piece_bpe._summed(c, [raw], True)",
}


@pytest.mark.parametrize("name", WORK)
def test_one_text_of_26_mb_takes_less_than_400_mb(name):
    code = MEASURED.replace("WORK", WORK[name]) + "\nprint((peak() - before) / 1024)"
    used = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert used < 400


def test_pieces_of_a_text_count_like_the_whole(monkeypatch):
    r = random.Random(3)
    for _ in range(50):
        text = "".join(r.choice("abcé1 \n\U0001f600") for _ in range(r.randint(1, 60)))
        whole = langid.profiles([text])
        with monkeypatch.context() as m:
            m.setattr(langid, "PIECE", r.randint(1, 9))
            assert (langid.profiles(["x", text, "y"])[1] == whole[0]).all()


def test_runs_of_a_text_encode_like_the_whole(monkeypatch):
    with open(bpe.default_paths()[0], encoding="utf-8") as f, open(bpe.default_paths()[1], "rb") as ranks:
        codec = bpe.Codec(f.read(), ranks.read(), bpe.default_pattern())
    r = random.Random(4)
    columns = {"ids", "starts", "ends", "ids_sha256"}
    texts = ["".join(r.choice(["a", " the", "é", "\U0001f600", "  ", "\n", "12", "'s", "日本"]) for _ in range(r.randint(0, 60))).encode() for _ in range(60)]
    whole = bpe._summed(codec, texts, columns)
    monkeypatch.setattr(bpe, "SLICE", 10)
    monkeypatch.setattr(bpe, "RUN", 3)
    for a, b, text in zip(whole, bpe._summed(codec, texts, columns), texts, strict=True):
        assert (a.n, a.chars, a.splits, a.listed.hexdigest(), a.decoded.hexdigest()) == (b.n, b.chars, b.splits, b.listed.hexdigest(), b.decoded.hexdigest())
        assert b.decoded.hexdigest() == hashlib.sha256(text).hexdigest()
        for name in bpe.LISTS:
            assert [x for p in a.lists[name] for x in p.tolist()] == [x for p in b.lists[name] for x in p.tolist()]
