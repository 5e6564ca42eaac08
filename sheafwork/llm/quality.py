"""A quality classifier: random-indexing word vectors pooled per document, a two-layer network in numpy, calibrated by temperature.

Every word has a sparse random index vector, given by a hash of it; its context vector is the sum of the index vectors of the words around it, over the
texts it was learnt from.  Words are taken in two ways, as they stand and by their shape (letters to one sign for each case, digits to another, runs of a sign once), each
with vectors of its own.  Context vectors are held in a fixed number of hash buckets, so the model's size is a parameter, whatever the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

_U = np.uint64
#: Dimensions of word vectors, hash buckets (per way of taking words), non-zero entries of an index vector, words around.
DIM, BUCKETS, NONZERO, AROUND = 48, 1 << 15, 4, 2
#: Labelled rows that the model is learnt from, at most.
MAX_TRAIN = 12_000
#: Parts in which context vectors are summed.
PARTS = 16
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def units(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of texts, (2, words): as they stand (lower-cased) and by shape; and how many words each text has."""
    _, _, h, counts = tb.words(flat, off)
    if not len(h):
        return np.zeros((2, 0), np.int64), counts
    shape = _SHAPE[flat]
    space = tb._IS_SPACE[flat]
    edge = np.zeros(len(flat), bool)
    edge[off[:-1][off[:-1] < len(flat)]] = True
    keep = np.ones(len(flat), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | space[1:] | edge[1:]
    at = np.concatenate([[0], np.cumsum(keep)])
    _, _, s, _ = tb.words(shape[keep], at[off], lower=False)
    return np.stack([h >> _U(49), s >> _U(49)]).astype(np.int64), counts


def index_vectors(dim: int = DIM, buckets: int = BUCKETS, seed: int = 11) -> np.ndarray:
    """Sparse random vectors of all buckets, of both ways of taking words: (2, buckets, dim)."""
    rng = np.random.default_rng(seed)
    out = np.zeros((2, buckets, dim), np.float32)
    for w in range(2):
        for _ in range(NONZERO):
            out[w, np.arange(buckets), rng.integers(0, dim, buckets)] += rng.choice([-1, 1], buckets)
    return out


def _contexts(batches):
    index = index_vectors()
    total = np.zeros_like(index)
    for pdf in batches:
        flat, off = tb.flatten(pdf["text"])
        for a, b in tb.slices(off, 1 << 19):
            o = off[a : b + 1]
            words, counts = units(flat[o[0] : o[-1]], o - o[0])
            doc = np.repeat(np.arange(b - a), counts)
            for step in range(1, AROUND + 1):
                near = doc[step:] == doc[:-step]
                for w in range(2):
                    x, y = words[w][step:][near], words[w][:-step][near]
                    np.add.at(total[w], x, index[w][y])
                    np.add.at(total[w], y, index[w][x])
    flat = total.reshape(PARTS, -1)
    del index
    yield pd.DataFrame({"part": np.arange(PARTS), "sums": [p.tobytes() for p in flat]})


def _sum_parts(pdf):
    """One part of the word vectors: a word's own index vector counts too, for words that stand for themselves; then every word has the same length."""
    part = int(pdf["part"].iloc[0])
    total = sum(np.frombuffer(b, np.float32) for b in pdf["sums"]).reshape(-1, DIM)
    own = index_vectors().reshape(PARTS, -1, DIM)[part] / np.sqrt(NONZERO)
    vectors = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9) + own
    return pd.DataFrame({"part": [part], "vectors": [vectors.astype(np.float32).tobytes()]})


def pooled(flat: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of each text's words, both ways side by side; zeros for texts without words."""
    words, counts = units(flat, off)
    out = np.zeros((len(counts), 2 * vectors.shape[2]), np.float32)
    on = np.flatnonzero(counts)
    if len(on):
        first = (np.cumsum(counts) - counts)[on]
        out[on] = np.hstack([np.add.reduceat(vectors[w][words[w]], first, axis=0) for w in range(2)]) / counts[on, None]
    return out


@dataclass
class Model:
    vectors: np.ndarray  # (2, buckets, hidden): the first layer is linear, so it is applied to the word vectors
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float
    #: the score of a text without words
    empty: float = 0.0

    def scores(self, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
        half = self.vectors.shape[2]
        pool = pooled(flat, off, self.vectors)
        logit = np.tanh(pool[:, :half] + pool[:, half:] + self.bias) @ self.out + self.out_bias
        score = 1 / (1 + np.exp(-np.clip(logit / self.temperature, -40, 40)))
        blank = np.diff(off) == 0
        return np.where(blank, self.empty, score)


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 5):
    """Two layers by Adam on mini-batches, classes weighted alike; a fifth of the rows calibrates the temperature.  Returns W, b, v, c, temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, fit = order[: len(x) // 5], order[len(x) // 5 :]
    w, b = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden)
    v, c = rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)
    params, m, s, t = [w, b, v, c], [0.0] * 4, [0.0] * 4, 0
    share = np.clip(y[fit].mean(), 0.02, 0.98) if len(fit) else 0.5
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(rounds):
        rng.shuffle(fit)
        for i in range(0, len(fit), 256):
            k = fit[i : i + 256]
            h = np.tanh(x[k] @ w + b)
            d = (1 / (1 + np.exp(-np.clip(h @ v + c, -40, 40))) - y[k]) * weight[k] / len(k)
            dh = np.outer(d, v) * (1 - h**2)
            t += 1
            for j, g in enumerate((x[k].T @ dh + decay * w, dh.sum(axis=0), h.T @ d + decay * v, np.array([d.sum()]))):
                m[j], s[j] = 0.9 * m[j] + 0.1 * g, 0.999 * s[j] + 0.001 * g * g
                params[j] -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.999**t)) + 1e-8)
    # Probabilities for the labels' real shares: the class weights' shift of the log odds is taken back, then the temperature fitted.
    c = c + np.log(share / (1 - share))
    logit = np.tanh(x[held] @ w + b) @ v + c if len(held) else np.zeros(0)
    grid = np.geomspace(0.25, 8, 60)
    loss = [np.mean(np.logaddexp(0, -(2 * y[held] - 1) * logit / g)) if len(held) else g for g in grid]
    return w, b, v, float(c[0]), float(grid[int(np.argmin(loss))])


def _learn(pdf):
    """The network of all rows that are learnt from, in one row; no layers where labels are too few or of one class."""
    pdf = pdf.sort_values("id", ignore_index=True)
    y = pdf["y"].to_numpy(float)
    out = {"share": float(y.mean()), "temperature": 1.0, "out_bias": 0.0, "first": b"", "bias": b"", "out": b""}
    if len(y) >= 10 and y.min() != y.max():
        x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(y), -1).astype(float)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        w, b, v, c, temperature = train_network((x - mean) / scale, y)
        w = w / scale[:, None]
        out |= {"temperature": temperature, "out_bias": c, "first": w.tobytes(), "bias": (b - mean @ w).tobytes(), "out": v.tobytes()}
    return pd.DataFrame([out])


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """A model of ``labels`` (id, 0/1) over the texts of ``docs``, from at most ``max_train`` labelled rows, chosen by a hash of their ids.

    ``learn`` says which ids may be learnt from.  Rows without a label don't count, nor do ids that have both labels.  Labels of one class only, or none, give a model that scores all texts alike.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.lit(True) if learn is None else learn))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("double")).alias("y"), F.max(F.col(label_col).cast("double")).alias("most")).where("y = most").drop("most")
    chosen = usable.orderBy(F.xxhash64("id", F.lit(23)), "id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = common.stage(texts.repartition(8, "id"), "labelled")
    sums = texts.select("text").mapInPandas(_contexts, "part int, sums binary").groupBy("part").applyInPandas(_sum_parts, "part int, vectors binary")
    # PARTS rows, together the size of the word vectors: all that the driver holds of them
    parts = {r.part: r.vectors for r in sums.collect()}
    vectors = np.frombuffer(b"".join(parts.pop(p) for p in sorted(parts)) or bytes(8 * BUCKETS * DIM), np.float32).reshape(2, BUCKETS, DIM)
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches):
        for pdf in batches:
            flat, off = tb.flatten(pdf["text"])
            x = np.concatenate([pooled(flat[off[a] : off[b]], off[a : b + 1] - off[a], shared.value) for a, b in tb.slices(off, 1 << 18)] or [np.zeros((0, 2 * DIM), np.float32)])
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "x": [r.tobytes() for r in x.astype(np.float32)]})

    # the rows are ``max_train`` at most, so one task learns from all of them, and the driver gets one row
    learnt = texts.mapInPandas(features, "id long, y double, x binary").groupBy().applyInPandas(_learn, "share double, temperature double, out_bias double, first binary, bias binary, out binary")
    got = learnt.first()
    shared.destroy()
    if got is None or not got.first:
        share = got.share if got else 0.5
        return Model(np.zeros((2, BUCKETS, 1), np.float32), np.zeros(1), np.zeros(1), float(np.log((share + 1e-6) / (1 - share + 1e-6))), 1.0, share)
    b, v = np.frombuffer(got.bias), np.frombuffer(got.out)
    w = np.frombuffer(got.first).reshape(2 * DIM, len(b)).astype(np.float32)
    return Model(np.stack([vectors[i] @ w[i * DIM : (i + 1) * DIM] for i in range(2)]), b, v, got.out_bias, got.temperature)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 if score >= threshold).

    Whole texts are scored; null, empty and blank ones have no words: empty ones get the score 0.  Repeated rows get equal scores.  An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            flat, off = tb.flat_column(batch.column(1))
            got = [shared.value.scores(flat[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in tb.slices(off, 1 << 18)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.astype(float)), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows whose text scores at least ``threshold``, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            flat, off = tb.flat_column(batch.column(at))
            got = [shared.value.scores(flat[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in tb.slices(off, 1 << 18)]
            yield batch.filter(pa.array(np.concatenate(got) >= threshold if got else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
