"""A byte-level convolutional network that scores the quality of whole texts.

Filters of `WIDTH` bytes run over overlapping chunks that together cover the whole text; each filter
is max-pooled within a chunk; the largest, mean and smallest pooled value over the chunks (a text
that repeats itself has chunks that are all alike) go into one logistic unit. A filter over one-hot
bytes is a sum of table look-ups, so both directions are plain numpy. Learned on the driver from a
bounded, hash-ordered sample of labelled texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsieve.llm.common import crc_mod, id_type, map_batches, small_batches, texts_of

WIDTH, FILTERS = 4, 16
CHUNK, STRIDE = 256, 192
#: Bound of the learning sample: texts of each label, bytes of a text that may be among them, and
#: chunks of a text that an epoch looks at, drawn anew each time. Scores look at all chunks.
PER_LABEL, LONGEST, CHUNKS = 1500, 40_000, 12
#: Epochs, or as many as it takes for that number of steps where few texts are labelled.
EPOCHS, STEPS, RATE = 10, 300, 0.02
FOLDS = 5
THRESHOLD = 0.3
_BLOCK = 512  # chunks convolved at once


def chunks_of(data: bytes) -> np.ndarray:
    """Overlapping chunks of a text's bytes, the last one filled up with zeros; at least one."""
    n = max(1, -(-max(0, len(data) - CHUNK) // STRIDE) + 1)
    padded = np.zeros((n - 1) * STRIDE + CHUNK, dtype=np.uint8)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


def convolve(filters: np.ndarray, chunks: np.ndarray, places: bool = False):
    """Filter values max-pooled over each chunk, and where each was found."""
    pooled = np.empty((len(chunks), FILTERS), dtype=np.float32)
    where = np.empty((len(chunks), FILTERS), dtype=np.int64) if places else None
    span = CHUNK - WIDTH + 1
    for at in range(0, len(chunks), _BLOCK):
        part = chunks[at : at + _BLOCK]
        values = filters[0][part[:, :span]]
        for j in range(1, WIDTH):
            values += filters[j][part[:, j : j + span]]
        if places:
            where[at : at + _BLOCK] = values.argmax(axis=1)
        pooled[at : at + _BLOCK] = values.max(axis=1)
    return (pooled, where) if places else pooled


def combined(pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Largest, mean and smallest pooled value of each text, whose chunks begin at `starts`."""
    counts = np.diff(np.append(starts, len(pooled)))[:, None]
    top, low = np.maximum.reduceat(pooled, starts), np.minimum.reduceat(pooled, starts)
    return np.hstack([top, np.add.reduceat(pooled, starts) / counts, low]).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    def __init__(self, filters: np.ndarray, weights: np.ndarray, bias: float):
        self.filters, self.weights, self.bias = filters, weights, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1, from all chunks of each text, a bounded number of chunks at a time."""
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            chunks = chunks_of(text.encode("utf-8", "surrogatepass"))
            pooled = convolve(self.filters, chunks)
            out[i] = _sigmoid(float((combined(pooled, np.array([0]))[0] * self.weights).sum()) + self.bias)
        return out


def learn(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Adam on the logistic loss; the gradient of a max goes to where the max was found."""
    rng = np.random.default_rng(seed)
    filters = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32), 0.0
    if not texts or len(set(labels)) < 2:  # nothing to tell apart: the share of label 1
        p = (sum(labels) + 1) / (len(labels) + 2)
        return Model(filters, np.zeros_like(weights), float(np.log(p / (1 - p))))
    all_chunks = [chunks_of(x.encode("utf-8", "surrogatepass")) for x in texts]
    y = np.array(labels, dtype=np.float32)
    state = [np.zeros_like(filters), np.zeros_like(filters), np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0]
    step, batches = 0, max(1, len(texts) // 64)
    epochs = max(EPOCHS, -(-STEPS // batches))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(len(texts)), batches):
            step += 1
            drawn = [c if len(c) <= CHUNKS else c[rng.choice(len(c), CHUNKS, replace=False)] for c in (all_chunks[i] for i in batch)]
            counts = np.array([len(c) for c in drawn])
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            rows = np.concatenate(drawn)
            pooled, where = convolve(filters, rows, places=True)
            x = combined(pooled, starts)
            error = (_sigmoid(x @ weights + bias) - y[batch]) / len(batch)
            dw, db = x.T @ error + 1e-4 * weights, float(error.sum())
            back = error[:, None] * weights[None, :]
            doc = np.repeat(np.arange(len(batch)), counts)
            top, mean, low = (x[:, k * FILTERS : (k + 1) * FILTERS] for k in range(3))
            grad = back[doc, FILTERS : 2 * FILTERS] / counts[doc, None]
            grad += back[doc, :FILTERS] * (pooled == top[doc]) + back[doc, 2 * FILTERS :] * (pooled == low[doc])
            df = np.zeros_like(filters)
            at = np.arange(len(rows))[:, None]
            for j in range(WIDTH):
                np.add.at(df[j], (rows[at, where + j], np.arange(FILTERS)[None, :]), grad)
            for k, (value, g) in enumerate(((filters, df), (weights, dw))):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            state[4] += 0.1 * (db - state[4])
            state[5] += 0.01 * (db * db - state[5])
            bias -= rate * (state[4] / (1 - 0.9**step)) / (np.sqrt(state[5] / (1 - 0.99**step)) + 1e-6)
    return Model(filters, weights, bias)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_label: int, longest: int) -> tuple[list[str], list[int]]:
    """At most `per_label` texts of each label outside the held-out fold, the first by a hash of the id.

    Ids with contradicting or NULL labels are left out. The ids are cut before the texts are read,
    so at most 2 * per_label rows are broadcast and collected.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_y"), F.max("quality").alias("_y2"))
        .where(F.col("_y") == F.col("_y2"))
        .select(F.col("doc_id").alias("_id"), "_y")
    )
    # ids of texts too long to learn from are no candidates
    known = known.join(docs.where(F.octet_length(text_col) <= longest).select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id"))
    chosen = known.withColumn("_rank", rank).where(F.col("_rank") <= per_label).select("_id", "_y")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.octet_length("_text") <= longest)
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_y").alias("_y")).collect()
    rows.sort(key=lambda r: str(r["_id"]))
    return [r["_text"] for r in rows], [int(r["_y"]) for r in rows]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL, longest: int = LONGEST) -> Model:
    return learn(*sample(docs, labels, id_col, text_col, per_label, longest))


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, FOLDS) == 0


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id (or, with `keep`, all columns) and score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs if keep else docs.select(id_col, text_col)
    names = source.columns if keep else [id_col]
    fields = source.schema.fields if keep else [T.StructField(id_col, id_type(docs, id_col))]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])

    def make():
        net = shared.value
        return lambda batch: [*(batch.column(x) for x in names), net.scores(texts_of(batch, text_col))]

    return map_batches(source, make, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row: doc_id, held_out, score (probability of label 1), predicted (score >= 0.3).

    NULL and empty texts are scored as one chunk of zeros. Without labels of both kinds every text
    gets the smoothed share of label 1. Ids may be NULL or repeat; other columns are not read; an
    empty table gives an empty one. Learns when called.
    """
    out = scored(docs, train(docs, labels, id_col, text_col, **how), id_col, text_col)
    doc_id = F.col(id_col)
    return out.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
