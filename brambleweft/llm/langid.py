"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. A 3-gram is the product
of its letters' vectors, each rolled by its place in the gram (binding); a
document is the sum of its 3-grams' vectors, each weighed by log(1 + count)
(bundling); a language is the sum of its training documents, each brought to
length 1. A document gets the language whose prototype has the largest cosine.

Prototypes are learned from a bounded sample: about ``SAMPLE`` documents of
each language, chosen by hash, so the result does not depend on order or
partitions. Counting 3-grams once per document turns binding and bundling into
one matrix product per block of documents; workers hold a block at a time, and
of a long text a piece, since counts of pieces add up.

Defined results: ``und`` and score 0 for null texts, texts without a letter,
and where nothing could be learned; a tie goes to the language that sorts
first; the score is the cosine, cut off at 0; long texts are read whole;
repeated rows are judged alike; an empty table gives an empty result. Only the
named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Length of the vectors, and the seed of the letters.
DIMENSIONS = 1024
SEED = 20240229
#: Training documents per language, about.
SAMPLE = 3000
#: Letter classes: 0 is the edge of a word, 1 to 26 are a to z, the rest share 37.
CLASSES = 64
BLOCK_TEXTS, BLOCK_CHARS = 256, 1 << 20
#: Longer texts are counted by pieces.
PIECE = 1 << 19
#: Counters (texts x distinct 3-grams) that are held at once.
MOST_COUNTS = 1 << 22

_made: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """The class of every code point."""
    if "letters" not in _made:
        classes = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = ord(x.lower()[0])
                classes[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 12) % 37
        _made["letters"] = classes
    return _made["letters"]


def _vectors() -> tuple[np.ndarray, np.ndarray]:
    """Vectors of pairs (first letter rolled by two, second by one) and of last letters."""
    if "pairs" not in _made:
        base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CLASSES, DIMENSIONS))
        _made["pairs"] = (np.roll(base, 2, 1)[:, None, :] * np.roll(base, 1, 1)[None, :, :]).reshape(-1, DIMENSIONS)
        _made["last"] = base
    return _made["pairs"], _made["last"]


def _grams(classes: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """The numbers of the 3-grams around the letters at ``middle``."""
    c = classes.astype(np.int32)
    return c[middle - 1] << 12 | c[middle] << 6 | c[middle + 1]


def _counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 3-grams that the texts use, and how often each text does."""
    table, n = _letters(), len(texts)
    parts = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(p) + 2 for p in parts])
    classes = np.zeros(lengths.sum(), np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    for p, s in zip(parts, starts, strict=True):
        classes[s + 1 : s + 1 + len(p)] = table[p]
    owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
    middle = np.flatnonzero(classes)
    grams = _grams(classes, middle)
    used = np.flatnonzero(np.bincount(grams, minlength=CLASSES**3))
    if n > 1 and n * len(used) > MOST_COUNTS:
        return used, np.zeros((0, 0), np.int64)
    place = np.zeros(CLASSES**3, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    return used, np.bincount(owner[middle].astype(np.int64) * len(used) + place[grams], minlength=n * len(used)).reshape(n, len(used))


def _counts_by_pieces(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``_counts`` of one text: counts of pieces add up, each read with the letter before and after it."""
    total = np.zeros(CLASSES**3, np.int64)
    for start in range(0, len(text), PIECE):
        piece = text[max(0, start - 1) : start + PIECE + 1]
        classes = _letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        before, after = [] if start else [0], [] if start + PIECE < len(text) else [0]
        classes = np.concatenate([np.array(before, np.uint8), classes, np.array(after, np.uint8)])
        total += np.bincount(_grams(classes, 1 + np.flatnonzero(classes[1:-1])), minlength=CLASSES**3)
    used = np.flatnonzero(total)
    return used, total[used][None, :]


def profiles(texts: list[str | None]) -> np.ndarray:
    """One hypervector of length 1 per text; zeros if it has no letter."""
    n = len(texts)
    long = next((i for i, t in enumerate(texts) if len(t or "") > PIECE), None)
    if long is not None and n > 1:
        parts = [texts[:long], texts[long : long + 1], texts[long + 1 :]]
        return np.concatenate([profiles(p) for p in parts if p])
    used, counts = _counts(texts) if long is None else _counts_by_pieces(texts[0])
    if not len(counts):
        return np.concatenate([profiles(texts[: n // 2]), profiles(texts[n // 2 :])])
    weights = np.log1p(counts.astype(np.float32))
    pairs, last = _vectors()
    out = np.zeros((n, DIMENSIONS), np.float32)
    for i in range(0, len(used), 2048):
        g = used[i : i + 2048]
        out += weights[:, i : i + 2048] @ (pairs[g >> 6] * last[g & 63]).astype(np.float32)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def _blocks(texts: list[str | None]) -> Iterator[slice]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= BLOCK_CHARS or i + 1 - start == BLOCK_TEXTS or i + 1 == len(texts):
            yield slice(start, i + 1)
            start, held = i + 1, 0


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from about ``sample`` documents of each."""
    usable = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 20)).alias("draw")).where("lang is not null and text is not null")
    share = {r["lang"]: min(1 << 20, (sample << 20) // r["n"] + 1) for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    # One entry per language.
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    chosen = usable.where(F.col("draw") < limit).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for s in _blocks(texts):
                for x, v in zip(langs[s], profiles(texts[s]), strict=True):
                    sums[x] = sums.get(x, 0) + v.astype(np.float64)
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = chosen.mapInArrow(bundle, "lang string, v array<double>")
    # Rounded so that the order in which parts arrive does not matter.
    cells = parts.select("lang", F.posexplode("v").alias("at", "v")).groupBy("lang", "at").agg(F.sum(F.round("v", 6).cast("decimal(18,6)")).cast("double").alias("v"))
    rows = {r["lang"]: dict(zip(r["at"], r["v"], strict=True)) for r in cells.groupBy("lang").agg(F.collect_list("at").alias("at"), F.collect_list("v").alias("v")).collect()}
    names = sorted(rows)
    return names, np.array([[rows[x][i] for i in range(DIMENSIONS)] for x in names], np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    names, prototypes = model
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = (prototypes / np.where(norms > 0, norms, 1)).astype(np.float32)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, scores = batch.column("text").to_pylist(), [], []
            for s in _blocks(texts):
                vectors = profiles(texts[s])
                known = vectors.any(axis=1)
                if not names:
                    known[:] = False
                cosines = vectors @ unit.T if names else np.zeros((len(vectors), 1))
                best = cosines.argmax(axis=1)
                langs += [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
                scores += np.where(known, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0).astype(float).tolist()
            yield pa.record_batch([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from the rows that are not held out."""
    model = learn(docs.where(~held_out(F.col(id_col))), key=id_col)
    return predict(docs, model, id_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
