"""Ranked lexical search with a two-level quantised index.

The index holds every term of every document, in blocks of documents. For each
block and term it has the documents that hold the term (``at``), an impact of
one byte for each (``bound``), rounded upward, and the counts that exact scores
need (``tf``). A search reads the levels one after the other:

1. Blocks are met with blocks of items. From bytes alone, a document's score for
   an item has an upper bound, and one less a unit per term is below it. A block
   keeps, for each item, the documents whose upper bound reaches its own k-th
   best lower bound.
2. An item's k-th best lower bound over all blocks is taken, and documents whose
   upper bound does not reach it go. The others are scored again in whole
   numbers from the second level, and the k best are the answer. No document
   with a score among the k best can be lost: its score lies between its bounds.

An impact is the part of a score that depends on term and document: it is below
``10**6`` and a byte stands for ``UNIT`` of it. It needs the corpus' totals, so
these are counted first (JVM only), then texts are read once more to make the
index, which is written to the shared folder. Both levels are columns of one
table, so each pass reads only its own. Lists of terms that no item has are left
out where they are read, against a broadcast of the items' terms if these are no
more than ``BROADCAST``, else by a join.

A block holds about ``POSTINGS`` postings and a bucket of items about
``PAIRS`` (item, term) pairs, so a task's memory does not depend on the size of
either table; a block meets every bucket, which is the work asked for. Joins by
term are dealt by block as well, since a term may be in all blocks.

Defined results: null texts, texts without a term, items without an id and items
without a term of the corpus have no rows; rows of one item are one item; rows with one document
id are documents of their own; a null document id comes last among equal
scores; texts are read whole in runs; empty tables give an empty result. Only
the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, shared_folder

#: A term is a run of digits, letters and all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OTHER = TERM[2:-2]
_TERM_AND_OTHERS = rf"[{_OTHER}]*+[^{_OTHER}]++[{_OTHER}]*+"
#: The same over UTF-8: bytes of no term become blanks.
_IN_TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: How much of an impact one byte stands for.
UNIT = 4096
POSTINGS, PAIRS, RUN, SALTS = 1 << 19, 1 << 14, 1 << 20, 16
#: (item, term) pairs that are broadcast, some 10 MB.
BROADCAST = 1 << 17


def term_count(text: Column) -> Column:
    """Number of terms; every term and what is around it shrink to one character, so nothing is held per term."""
    return F.coalesce(F.length(F.regexp_replace(F.concat(text, F.lit(" x")), _TERM_AND_OTHERS, "w")).cast("long") - 1, F.lit(0).cast("long"))


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms they have."""
    n = docs.select(term_count(F.col(text_col)).alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return n["docs"], n["terms"]


def _counts(text: bytes) -> Counter:
    """Terms of a text, counted in runs that end outside a term."""
    found: Counter = Counter()
    shown = text.translate(_IN_TERMS).lower()
    start = 0
    while start < len(shown):
        end = len(shown) if start + RUN >= len(shown) else shown.find(b" ", start + RUN)
        end = len(shown) if end < 0 else end
        found.update(shown[start:end].split())
        start = end
    return found


def impacts(tf, n, n_docs: int, n_terms: int):
    """The part of a score that depends on term and document, over whole numbers, arrays or columns."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + 50 * n * n_docs // n_terms))


class _Block:
    """Documents whose postings are put in order together."""

    def __init__(self) -> None:
        self.ids, self.lengths = [], []
        self.terms: dict[bytes, int] = {}
        self.owner, self.term, self.tf = [], [], []

    def add(self, doc_id, counts: Counter) -> None:
        place = self.terms
        self.owner.append(len(counts))
        self.term.append(np.fromiter((place.setdefault(t, len(place)) for t in counts), np.int32, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.ids.append(doc_id)
        self.lengths.append(int(self.tf[-1].sum()))

    def rows(self, block: int, kind: pa.DataType, n_docs: int, n_terms: int) -> pa.RecordBatch:
        """One row per term and, with no term, one for the documents."""
        n = np.array(self.lengths, np.int64)
        at = np.repeat(np.arange(len(n), dtype=np.int32), self.owner)
        term, tf = np.concatenate(self.term), np.concatenate(self.tf)
        order = np.argsort(term, kind="stable")
        at, tf = at[order], tf[order]
        ends = np.append(0, np.cumsum(np.bincount(term, minlength=len(self.terms)))).astype(np.int32)
        byte = -(-impacts(tf.astype(np.int64), n[at], n_docs, n_terms) // UNIT)
        k = len(self.terms)
        lists = lambda ends, flat: pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1]), pa.int32()), pa.array(flat))
        alone = np.append(np.zeros(k + 1, np.int32), len(n))
        return pa.record_batch(
            [
                pa.array(np.full(k + 1, block), pa.int64()),
                pa.concat_arrays([pa.array(list(self.terms), pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())]),
                lists(ends, at),
                pa.BinaryArray.from_buffers(pa.binary(), k + 1, [None, pa.py_buffer(np.append(ends, ends[-1]).astype(np.int32)), pa.py_buffer(byte.astype(np.uint8))]),
                lists(ends, tf),
                pa.ListArray.from_arrays(pa.array(alone, pa.int32()), pa.array(self.ids, kind)),
                pa.ListArray.from_arrays(pa.array(alone, pa.int32()), pa.array(n)),
            ],
            names=["block", "term", "at", "bound", "tf", "ids", "n"],
        )


def build_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", postings: int = POSTINGS) -> tuple[int, int]:
    """Write the index of all rows to ``folder``; gives the corpus' totals."""
    n_docs, n_terms = totals(docs, text_col)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, held = TaskContext.get().partitionId() << 32, _Block(), 0
        for batch in batches:
            ids = batch.column("id")
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                if counts := _counts(text.as_py()):
                    block.add(ids[i].as_py(), counts)
                    held += len(counts)
                if held >= postings:
                    yield block.rows(number, ids.type, n_docs, n_terms)
                    number, block, held = number + 1, _Block(), 0
        if held:
            yield block.rows(number, ids.type, n_docs, n_terms)

    made = slim.mapInArrow(run, f"block long, term string, at array<int>, bound binary, tf array<int>, ids array<{kind}>, n array<long>")
    made.write.parquet(folder)
    return n_docs, n_terms


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of every item."""
    low = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.explode(F.regexp_extract_all(low, F.lit(f"({TERM})"))).alias("term")).distinct()


def _bounds(rows: pa.Table, k: int) -> pa.Table:
    """One block's documents with the bounds of their scores, for one bucket of items; see the module's step 1."""
    weights = rows.column("items").to_pylist()
    lists = [(a.values.to_numpy(), np.frombuffer(b.as_py(), np.uint8)) for a, b in zip(rows.column("at"), rows.column("bound"), strict=True)]
    by_item: dict = {}
    for place, pairs in enumerate(weights):
        for x in pairs:
            by_item.setdefault(x["item_id"], []).append((place, x["w"]))
    size = 1 + max((int(a[-1]) for a, _ in lists), default=-1)
    out = {"item_id": [], "at": [], "upper": [], "lower": []}
    for item, pairs in by_item.items():
        upper, slack = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for place, w in pairs:
            at, byte = lists[place]
            upper[at] += w * byte.astype(np.int64)
            slack[at] += w
        found = np.flatnonzero(upper)
        high, low = upper[found] * UNIT, (upper[found] - slack[found]) * UNIT
        if len(found) > k:
            keep = high >= np.partition(low, len(low) - k)[len(low) - k]
            found, high, low = found[keep], high[keep], low[keep]
        if len(found):
            for name, value in zip(out, (item, found.astype(np.int32), high, low), strict=True):
                out[name].append(value)
    kinds = (rows.schema.field("items").type.value_type.field("item_id").type, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    columns = [pa.array(out[name], kind) for name, kind in zip(out, kinds, strict=True)]
    n = len(columns[0])
    return pa.table([pa.array([rows.column("block")[0].as_py()] * n, pa.int64()), *columns], names=["block", *out])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of the ``found`` documents that hold a term, with its count: both lists are in order."""
    for batch in batches:
        numbers, places, counts = [], [], []
        for k, (found, at, tf) in enumerate(zip(batch.column("found"), batch.column("at"), batch.column("tf"), strict=True)):
            found, at = found.values.to_numpy(), at.values.to_numpy()
            spot = np.minimum(np.searchsorted(at, found), len(at) - 1)
            held = at[spot] == found
            numbers.append(np.full(held.sum(), k))
            places.append(found[held])
            counts.append(tf.values.to_numpy()[spot[held]])
        if numbers:
            row = pa.array(np.concatenate(numbers))
            yield pa.record_batch([*(batch.column(c).take(row) for c in ("block", "item_id", "w")), pa.array(np.concatenate(places)), pa.array(np.concatenate(counts).astype(np.int64))], names=["block", "item_id", "w", "at", "tf"])


def search(spark: SparkSession, folder: str, corpus: tuple[int, int], items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of every item, from an index in ``folder``."""
    n_docs, n_terms = corpus
    index = spark.read.parquet(folder)
    wanted = checkpoint(item_terms(items, id_col, text_col))
    n_pairs = wanted.count()
    few = F.broadcast if n_pairs <= BROADCAST else lambda frame: frame
    lists = index.where("term is not null").join(few(wanted.select("term").distinct()), "term", "left_semi")
    kind = wanted.schema["item_id"].dataType.simpleString()
    df = lists.groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1)))
    weighted = checkpoint(wanted.join(df.select("term", weight.alias("w")), "term").where("w > 0"))

    # 1: bounds, per block of documents and bucket of items.
    buckets = max(1, -(-n_pairs // pairs))
    dealt = weighted.groupBy("term", F.pmod(F.xxhash64("item_id"), F.lit(buckets)).alias("bucket")).agg(F.collect_list(F.struct("item_id", "w")).alias("items"))
    level = lists.select("block", "term", "at", "bound")
    if few is F.broadcast:
        met = level.join(few(dealt), "term")
    else:
        salt = F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")
        met = level.withColumn("salt", salt).join(dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["term", "salt"])
    met = met.select("block", "bucket", "at", "bound", "items")
    bounded = met.groupBy("block", "bucket").applyInArrow(lambda rows: _bounds(rows, k), f"block long, item_id {kind}, at array<int>, upper array<long>, lower array<long>")
    bounded = checkpoint(bounded)

    # 2: what reaches the k-th best lower bound, scored in whole numbers.
    best = Window.partitionBy("item_id").orderBy(F.desc("low"))
    lowest = bounded.select("item_id", F.explode("lower").alias("low")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)
    lowest = lowest.groupBy("item_id").agg(F.when(F.count(F.lit(1)) == k, F.min("low")).otherwise(0).alias("least"))
    reaching = F.filter(F.arrays_zip("at", "upper"), lambda x: x["upper"] >= F.col("least"))
    left = bounded.join(lowest, "item_id").select("block", "item_id", reaching.alias("x")).where(F.size("x") > 0).select("block", "item_id", F.col("x.at").alias("found"))
    parts = left.join(few(weighted), "item_id").join(lists.select("block", "term", "at", "tf"), ["block", "term"])
    hits = parts.select("block", "item_id", "w", "found", "at", "tf").mapInArrow(_held, f"block long, item_id {kind}, w long, at int, tf long")
    documents = index.where("term is null").select("block", F.posexplode(F.arrays_zip("ids", "n")).alias("at", "x")).select("block", "at", F.col("x.ids").alias("doc_id"), "x.n")
    part = F.expr(f"w * ((1000000000 * tf) div (1000 * tf + 20 * (50 + (50 * n * {n_docs}L) div {max(1, n_terms)}L)))")
    scored = hits.join(documents, ["block", "at"]).select("block", "at", "item_id", "doc_id", part.alias("part"))
    scores = scored.groupBy("block", "at", "item_id", "doc_id").agg(F.sum("part").alias("score")).where("score > 0")
    top = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of ``docs`` for every item of (item_id, text).

    The index is written to the shared folder and deleted when the answers, which are few, are written there.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    found = checkpoint(search(spark, folder, build_index(docs, folder, id_col, text_col), items, k))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found
