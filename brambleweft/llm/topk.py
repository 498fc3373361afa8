"""Exact top-k by inner product with a pivot-distance index.

With M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0), the
largest inner products are the smallest distances: |q' - x'|^2 =
|q|^2 + M^2 - 2 q.x. Every vector is keyed by its nearest pivot (its cell) and
the distance to it. By the triangle inequality a vector at distance d of a
pivot is no nearer to q' than |d - |q' - pivot||, so an annulus (a run of
vectors sorted by distance) can be passed over once that bound is no better
than a query's k-th score so far. A task holds a part of one cell and a block
of queries, expands the annuli outwards from where the queries lie, and stops
by these bounds. Scores of a bounded sample give every query its first bound.
Sums of whole numbers are exact in doubles, and bounds carry a margin for
rounding, so the results are exact.

Pivots are fitted on at most ``SAMPLE`` vectors; all vectors are indexed. Cells
are split into parts of about ``PART`` vectors and queries into blocks of about
``QUERIES``, so a task's memory is bounded whatever a cell or a common vector
holds. Blocks hold queries of the same nearest pivot, or of a few pivots with
few queries, and a part is sent only to the blocks of which some query's bound
reaches its cell. What is left is the stated
work: a query set that grows with the table against all rows.

Defined results: vectors that are null or hold null or non-finite components,
and rows with a null id, take no part; shorter vectors are padded with zeros;
ties go to the smaller id; a row with the query's id is the query's own;
repeated queries count once, and different vectors under one query's id share
one list, the best scores of them all; an empty table gives an empty result;
scores are exact up to 2^53, rounded beyond, and cut off at a 64-bit integer.
Only the id and vector columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, SAMPLE = 16, 2048
PART, QUERIES, ANNULUS = 1 << 15, 1 << 10, 1 << 10


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): usable vectors with components floor(scale * x)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    named = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    usable = named.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.forall("v", finite))
    return usable.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    start = 0
    for i, n in enumerate(lengths):
        out[i, :n] = flat[start : start + n]
        start += n
    return out


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))


def fit_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first centres of the sample, moved to their cells' means a few times."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    pivots = sample[chosen]
    for _ in range(5):
        cell = _distances(sample, pivots).argmin(1)
        pivots = np.array([sample[cell == i].mean(0) if (cell == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first of each row by falling score, then rising id; -inf marks none."""
    if scores.shape[1] > 4 * k:
        # Keep all that reach the k-th score, ties included.
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        wide = int((scores >= kth[:, None]).sum(1).max())
        if wide < scores.shape[1]:
            at = np.argpartition(-scores, wide - 1, axis=1)[:, :wide]
            scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search_part(q_ids: np.ndarray, q: np.ndarray, first: np.ndarray, ids: np.ndarray, x: np.ndarray, away: np.ndarray, q_away: np.ndarray, top: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Top k of every query in one part of a cell; also how many scores were computed.

    ``away`` and ``q_away`` are distances to the cell's pivot, ``first`` what a
    score must reach.
    """
    order = np.argsort(away, kind="stable")
    ids, x, away = ids[order], x[order], away[order]
    scores, found = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    square = (q * q).sum(1)
    starts = np.arange(0, len(x), ANNULUS)
    low, high = away[starts], away[np.minimum(starts + ANNULUS, len(x)) - 1]
    middle = np.median(q_away)
    done = 0
    for a in np.argsort(np.maximum(np.maximum(middle - high, low - middle), 0), kind="stable"):
        gap = np.maximum(np.maximum(q_away - high[a], low[a] - q_away), 0)
        bound = (square + top - gap * gap) / 2 + 1e-6 * (square + top + 1)
        live = np.flatnonzero(bound >= np.maximum(scores[:, -1], first))
        if not len(live):
            continue
        s = slice(starts[a], starts[a] + ANNULUS)
        new = q[live] @ x[s].T
        done += new.size
        new[q_ids[live][:, None] == ids[s][None]] = -np.inf
        both = np.hstack([scores[live], new])
        named = np.hstack([found[live], np.broadcast_to(ids[s], new.shape)])
        scores[live], found[live] = _best(both, named, k)
    return scores, found, done


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest scores of every query.

    ``is_query`` is a condition over the column ``id``.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vec_col, scale)
    schema = "query_id long, rank int, vec_id long, score long"
    stats = vectors.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"), F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("queries")).first()
    if not stats["n"] or not stats["queries"]:
        return spark.createDataFrame([], schema)
    dim, top = max(stats["dim"], 1), float(stats["top"])
    sampled = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample, sample_ids = _matrix(sampled.column("v"), dim), np.asarray(sampled.column("id"), dtype=np.int64)
    pivots = fit_pivots(_lift(sample, top))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            away = _distances(_lift(_matrix(b.column("v"), dim), top), pivots)
            cell = away.argmin(1)
            yield pa.record_batch([b.column("id"), b.column("v"), pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])], names=["id", "v", "cell", "away"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, own = _matrix(b.column("v"), dim), np.asarray(b.column("id"), dtype=np.int64)
            away = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
            scores = q @ sample.T
            scores[own[:, None] == sample_ids[None]] = -np.inf
            first = np.partition(scores, -k, axis=1)[:, -k] if len(sample) >= k else np.full(len(q), -np.inf)
            yield pa.record_batch([b.column("id"), b.column("v"), pa.array(first), pa.array(list(away), pa.list_(pa.float64()))], names=["id", "v", "first", "away"])

    index = vectors.mapInArrow(keyed, "id long, v array<double>, cell int, away double")
    # One row per pivot.
    cells = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()
    parts = F.element_at(F.create_map(*[F.lit(x) for c in cells for x in (c["cell"], -(-c["n"] // PART))]), F.col("cell"))
    # By place in the scanned files too, which a task that is run again sees alike: repeated rows are dealt out.
    placed = index.select("*", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), parts).cast("int").alias("part"))
    asking = vectors.where(is_query).dropDuplicates().mapInArrow(asked, "id long, v array<double>, first double, away array<double>")
    pivot = F.array_position("away", F.array_min("away")).cast("int")
    queries = asking.withColumn("pivot", pivot)
    # One row per pivot. A pivot of many queries has blocks of its own, others share one.
    first_block, shared, made = {}, QUERIES, 0
    for r in queries.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).orderBy("pivot").collect():
        if r["n"] >= QUERIES:
            first_block[r["pivot"]] = (made, -(-r["n"] // QUERIES))
            made += first_block[r["pivot"]][1]
        else:
            if shared + r["n"] > QUERIES:
                open_block, shared, made = made, 0, made + 1
            first_block[r["pivot"]] = (open_block, 1)
            shared += r["n"]
    of_pivot = F.element_at(F.create_map(*[x for p, (b, k) in first_block.items() for x in (F.lit(p), F.struct(F.lit(b).alias("block"), F.lit(k).alias("n")))]), F.col("pivot"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    spots = []
    for c in cells:
        gap = F.greatest(F.col("away")[c["cell"]] - c["high"], F.lit(c["low"]) - F.col("away")[c["cell"]], F.lit(0.0))
        reach = (F.col("square") + top - gap * gap) / 2 + 1e-6 * (F.col("square") + top + 1) >= F.col("first")
        spots.append(F.when(reach, F.struct(F.lit(c["cell"]).alias("cell"), F.col("away")[c["cell"]].alias("q_away"))))
    block = (of_pivot["block"] + F.pmod(F.xxhash64("id", "v"), of_pivot["n"])).cast("long").alias("block")
    met = queries.withColumn("square", square).select("id", "v", "first", block, F.explode(F.array_compact(F.array(*spots))).alias("spot")).select("id", "v", "first", "block", "spot.*")
    sent = met.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    reached = sent.select(*[F.col(c).alias(c) for c in ("cell", "part", "block")]).distinct()
    dealt = placed.join(reached, ["cell", "part"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        own = np.asarray(right.column("id"), dtype=np.int64)
        scores, found, _ = search_part(own, _matrix(right.column("v"), dim), np.asarray(right.column("first")), np.asarray(left.column("id"), dtype=np.int64), _matrix(left.column("v"), dim), np.asarray(left.column("away")), np.asarray(right.column("q_away")), top, k)
        at, rank = np.nonzero(np.isfinite(scores))
        cut = np.clip(scores[at, rank], -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        return pa.table([pa.array(own[at]), pa.array(found[at, rank]), pa.array(cut)], names=names)

    key = ["cell", "part", "block"]
    near = dealt.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
