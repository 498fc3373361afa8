"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector; learned filters of ``WIDTH`` bytes slide over
the whole text in steps of ``STRIDE``. Texts are cut into chunks of ``CHUNK``
bytes, and the windows of a chunk reach into the next one, so chunks overlap
and no window is lost. A filter's answers are max-pooled within each chunk;
over the chunks its strongest and its weakest peak go on (a passage in which a
usual pattern is missing shows in the weakest). One hidden layer combines the
peaks into one probability.

The network is trained by Adam on a bounded, balanced sample: at most
``SAMPLE`` labelled texts per class, chosen by hash. A sampled text of more
than ``LONGEST`` bytes gives one window of it, at a place chosen by hash, so
long texts teach like others and the driver's memory is bounded; scoring reads
whole texts. Gradients flow only through the windows that won a pooling, so a
step costs little more than scoring.

Defined results: a null text is scored as the empty text, which is one chunk
of padding; where labels of one class only (or none) are there, every score is
that class's share (0.5 without labels); repeated rows are scored alike; of
several texts of one id the one with the smallest hash teaches, and an id with
both labels teaches both; an empty table gives an empty result. Only the named columns are
read, so extra columns cannot clash; ``keep_good`` returns the input's columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_slices

WIDTH, STRIDE, CHUNK = 12, 2, 256
EMBEDDING, FILTERS, HIDDEN = 8, 24, 16
SAMPLE, LONGEST = 2000, 1 << 15
EPOCHS, STEP, BATCH = 16, 4e-3, 48
KEEP_FROM = 0.3
SEED = 7
BLOCK = 1 << 19


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    n = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    return {
        "bytes": n(256, EMBEDDING, scale=0.5),
        "filters": n(WIDTH * EMBEDDING, FILTERS, scale=(WIDTH * EMBEDDING) ** -0.5),
        "bias": zero(FILTERS),
        "hidden": n(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5),
        "hidden_bias": zero(HIDDEN),
        "out": n(HIDDEN, 1, scale=HIDDEN**-0.5),
        "out_bias": zero(1),
    }


def _lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts, each with the first bytes of the text's next one; first chunks.

    At least a window of zeros follows each text, and nothing of another text.
    """
    chunks = np.array([-(-(len(t) + WIDTH) // CHUNK) for t in texts])
    firsts = np.cumsum(chunks) - chunks
    flat = np.zeros(chunks.sum() * CHUNK, np.uint8)
    for t, c in zip(texts, firsts, strict=True):
        flat[c * CHUNK : c * CHUNK + len(t)] = np.frombuffer(t, np.uint8)
    laid = np.zeros((chunks.sum(), CHUNK + WIDTH), np.uint8)
    laid[:, :CHUNK] = flat.reshape(-1, CHUNK)
    laid[:-1, CHUNK:] = laid[1:, :WIDTH]
    laid[firsts + chunks - 1, CHUNK:] = 0
    return laid, firsts


def _answers(w: dict[str, np.ndarray], laid: np.ndarray) -> np.ndarray:
    """(chunks, windows of a chunk, filters) of the filters' answers, without bias."""
    count, per = len(laid), CHUNK // STRIDE
    part = np.take(w["bytes"], laid, axis=0)
    row, step, one = part.strides
    windows = np.lib.stride_tricks.as_strided(part, (count, per, WIDTH * EMBEDDING), (row, STRIDE * step, one), writeable=False)
    return (np.ascontiguousarray(windows).reshape(count * per, -1) @ w["filters"]).reshape(count, per, FILTERS)


def _peaks(answers: np.ndarray) -> np.ndarray:
    """Max over the windows of every chunk, by halves (much faster than along one axis)."""
    while answers.shape[1] > 1:
        half = answers.shape[1] // 2
        answers = np.maximum(answers[:, :half], answers[:, half:])
    return answers[:, 0]


def _head(w: dict[str, np.ndarray], peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    active = np.tanh(peaks)
    hidden = np.tanh(active @ w["hidden"] + w["hidden_bias"])
    return active, hidden, 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_bias"], -30, 30)[:, 0]))


def score_texts(w: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    laid, firsts = _lay_out(texts)
    # A few hundred chunks at a time bound the memory of the windows.
    peaks = np.concatenate([_peaks(_answers(w, laid[i : i + 256])) for i in range(0, len(laid), 256)]) + w["bias"]
    return _head(w, np.hstack([np.maximum.reduceat(peaks, firsts), np.minimum.reduceat(peaks, firsts)]))[2]


def _gradients(w: dict[str, np.ndarray], texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    laid, firsts = _lay_out(texts)
    n, cols = len(texts), np.arange(FILTERS)
    answers = _answers(w, laid)
    peaks = _peaks(answers)
    ends = np.append(firsts[1:], len(laid))
    high = np.array([peaks[a:b].argmax(axis=0) + a for a, b in zip(firsts, ends, strict=True)])
    low = np.array([peaks[a:b].argmin(axis=0) + a for a, b in zip(firsts, ends, strict=True)])
    pooled = np.hstack([peaks[high, cols] + w["bias"], peaks[low, cols] + w["bias"]])
    active, hidden, p = _head(w, pooled)
    d_out = ((p - labels) / n).astype(np.float32)[:, None]
    d_hidden = d_out @ w["out"].T * (1 - hidden**2)
    d_peaks = d_hidden @ w["hidden"].T * (1 - active**2)
    won = np.hstack([high, low])
    at = answers[won, :, np.tile(cols, 2)].argmax(axis=2) * STRIDE
    window = laid[won[:, :, None], at[:, :, None] + np.arange(WIDTH)]  # texts, 2 x filters, width
    seen = w["bytes"][window].reshape(n, 2, FILTERS, WIDTH * EMBEDDING)
    by_filter = d_peaks.reshape(n, 2, FILTERS)
    g = {"out": hidden.T @ d_out, "out_bias": d_out.sum(0), "hidden": active.T @ d_hidden, "hidden_bias": d_hidden.sum(0), "bias": by_filter.sum((0, 1))}
    g["filters"] = np.einsum("nkf,nkfw->wf", by_filter, seen, optimize=True)
    back = by_filter[..., None] * w["filters"].T[None, None]
    g["bytes"] = np.zeros_like(w["bytes"])
    np.add.at(g["bytes"], window.reshape(-1), back.reshape(-1, EMBEDDING))
    return g


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights after ``epochs`` passes; the same inputs give the same weights."""
    y, rng = np.array(labels, np.float32), np.random.default_rng(SEED)
    w = new_weights(rng)
    m, v, t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    steps = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            t += 1
            rate = STEP * 0.5 * (1 + np.cos(np.pi * t / (steps + 1)))
            for k, g in _gradients(w, [texts[j] for j in some], y[some]).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict[str, np.ndarray] | float:
    """Weights, or a constant score where there are not two classes."""
    draw = F.xxhash64(F.col("id"))
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    chosen = None
    for label in (0, 1):
        # At most ``sample`` ids per class: safe to broadcast.
        part = ids.where(F.col("label") == label).groupBy("id").agg(F.min("label").alias("label")).orderBy(draw, "id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    text, whole = F.col(text_col), F.octet_length(text_col) <= LONGEST
    wide = LONGEST // 4  # characters of a window
    window = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.length("text") / wide))
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), text.alias("text"), whole.alias("whole")).join(F.broadcast(chosen), "id")
    rows = rows.select("id", "label", F.xxhash64("text").alias("h"), F.when(F.col("whole"), F.col("text")).otherwise(F.substring("text", (window * wide + 1).cast("int"), F.lit(wide))).alias("text"))
    # At most two texts' windows per sampled id and task: repeated ids shrink before the shuffle.
    got = rows.groupBy("id", "label").agg(F.min(F.struct("h", "text")).alias("one")).select("id", "label", "one.text").orderBy("id", "label").collect()
    y = [r["label"] for r in got]
    if not 0 < sum(y) < len(y):
        return sum(y) / len(y) if y else 0.5
    return train([r["text"].encode("utf-8", "replace") for r in got], y)


def score(text: Column, model: dict[str, np.ndarray] | float) -> Column:
    """The score of every text, as a column. Only texts go to the workers, and a bounded part of a batch is laid out at once."""

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [np.full(len(t), model) if isinstance(model, float) else score_texts(model, t) for _, t in text_slices(column, BLOCK)]
            yield pa.array(np.concatenate(parts).astype(np.float64) if parts else [], pa.float64())

    return scores(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from rows that are not held out."""
    model = learn(docs, labels.where(~held_out(F.col(id_col))), id_col, text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col), model).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with the input's columns."""
    model = learn(docs, labels.where(~held_out(F.col(id_col))), id_col, text_col)
    name = "score"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, score(F.col(text_col), model)).where(F.col(name) >= KEEP_FROM).drop(name)
