"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text's tokens are runs of word characters and runs of marks. Its features are hashed unigrams and bigrams of the
lower-cased tokens, and one- to three-grams of the tokens' shapes (case, marks, equal to the token before), each
counted and divided by the number of tokens. The score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.llm import kernels as K
from urbanloom.llm.training import held_out, sample
from urbanloom.session import ship

#: Features are hashed to 2^BITS weights; the model is that many floats (1 MB), which bounds what is broadcast.
BITS = 18
#: Labelled documents that training reads at most (and at most training.TRAINING_BYTES of text), and how often it goes
#: through them.
TRAINING_ROWS, EPOCHS = 6000, 4

_KIND = np.zeros(256, np.uint8)
_KIND[:] = 2
_KIND[128:] = _KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[np.flatnonzero(K.SPACE)] = 0
_UPPER = K.table(bytes(range(65, 91)))
_LOW = K.table(bytes(range(97, 123)))
_DIGIT = K.table(bytes(range(48, 58)))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all tokens (five for each, by row), first feature of each row (n+1 values), tokens of each row."""
    n = len(data)
    kind = _KIND[data]
    edge = np.ones(n, bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offs[:-1][offs[:-1] < n]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    word = kind[starts] > 0 if n else np.zeros(0, bool)
    starts, ends = starts[word], ends[word]
    first = np.searchsorted(starts, offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64), np.zeros(len(offs) - 1, np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    text = K.span_hash(K.LOWER[data], starts, ends)

    def some(chars: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(chars[data], dtype=np.int64)])
        return total[ends] - total[starts]

    size = ends - starts
    upper, low, digit = some(_UPPER), some(_LOW), some(_DIGIT)
    shape = np.where(kind[starts] == 2, 10 + np.minimum(size, 4), np.where(upper == 0, 0, np.where((low == 0) & (size > 1), 2, 1)) + 4 * (digit > 0)).astype(np.uint64)
    same = np.zeros(len(starts), bool)
    same[1:] = (text[1:] == text[:-1]) & (row[1:] == row[:-1])
    shape += np.uint64(64) * same.astype(np.uint64)

    def back(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(x), np.uint64)
        out[k:] = np.where(row[k:] == row[:-k], x[:-k] + np.uint64(1), 0) if len(x) > k else out[k:]
        return out

    s1, s2 = back(shape, 1), back(shape, 2)
    grams = [text, K.mix(text + back(text, 1) * np.uint64(0x9FB21C651E98DF25)), shape, shape * np.uint64(1000) + s1, (shape * np.uint64(1000) + s1) * np.uint64(1000) + s2]
    out = np.stack([K.mix(g, 11 + i) >> np.uint64(64 - BITS) for i, g in enumerate(grams)], axis=1).astype(np.int64)
    return out.ravel(), first * 5, np.diff(first)


def train(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-6) -> np.ndarray:
    """Weights (the last one is the bias) by FTRL-proximal, one row at a time in the order given."""
    rows = []
    for a, data, offs in K.chunks(texts):
        f, first, n = features(data, offs)
        for i in range(len(n)):
            index, count = np.unique(f[first[i] : first[i + 1]], return_counts=True)
            rows.append((np.append(index, 1 << BITS), np.append(count / max(n[i], 1), 1.0), float(labels[a + i])))
    z, total = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta * 0.01 + np.sqrt(total[at])) / alpha + l2))

    for _ in range(epochs):
        for index, x, y in rows:
            w = weights(index)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(total[index] + g * g) - np.sqrt(total[index])) / alpha
            z[index] += g - sigma * w
            total[index] += g * g
    return weights(np.arange((1 << BITS) + 1)).astype(np.float32)


def score(data: np.ndarray, offs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    f, first, n = features(data, offs)
    sums = np.concatenate([[0.0], np.cumsum(weights[f], dtype=np.float64)])
    logit = weights[-1] + (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def fit(df: DataFrame, labels: DataFrame, keep, label: str = "quality", rows: int = TRAINING_ROWS) -> np.ndarray:
    """Weights from at most ``rows`` labelled documents, trained in one task; the driver gets the weights alone."""
    ship(df.sparkSession)

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        w = train(t.column("_text").combine_chunks(), t.column("_label").to_numpy())
        yield pa.record_batch([pa.array([w.tobytes()], pa.binary())], names=["w"])

    drawn = sample(df, labels, label, keep, rows)
    ordered = drawn.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.xxhash64("_text"))
    got = ordered.mapInArrow(run, "w binary").collect()
    return np.frombuffer(got[0]["w"], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def classify(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``carry`` and ``score`` (0 to 1) for each row; null and empty texts get the bias's score.

    An empty table gives an empty one and a model without training rows scores 0.5 throughout. Repeated rows and null
    ids are kept; other columns are not read.
    """
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(weights)
    names = [id_col, *(c for c in carry if c != id_col)]

    def run(batches):
        for batch in batches:
            got = np.zeros(batch.num_rows)
            for a, data, offs in K.chunks(batch.column(len(names))):
                got[a : a + len(offs) - 1] = score(data, offs, sent.value)
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(got)], names=[*names, "score"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.select(*names, F.col(text_col).cast("string").alias("_text_")).mapInArrow(run, f"{schema}, score double")


def quality(df: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.7, carry: tuple[str, ...] = ()) -> DataFrame:
    """Fits on labelled rows that are not held out and scores every row: held_out, score, predicted."""
    weights = fit(df, labels, ~held_out("doc_id", modulus, remainder))
    return classify(df, weights, carry=carry).select("doc_id", *carry, held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
