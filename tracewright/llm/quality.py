"""Quality classifier: support vectors on naive Bayes features (Wang and Manning 2012), by dual coordinate descent.

Features are indicators of n-grams of two streams of the whole text: its bytes (n = 1, 2, 3; the last hashed), and its
words' recurrences (n = 1 to 4), where a word's symbol is the octave of the distance to its last occurrence, or none.
Word n-grams by name say little about words that training never saw; by recurrence they tell repeated words from prose.
Chosen by cross-validation on the training rows (sf0.1: share of label-0 rows kept at equal shares of label-1 rows):
bytes 0.196, bytes and hashed words with word pairs 0.183, bytes and recurrences 0.007. Each indicator is scaled by its
smoothed log-count ratio between the classes; on those, a linear hinge-loss model is fitted in the dual, one coordinate
at a time (Hsieh et al. 2008). Margins of rows that a fold has not seen give the logistic calibration, and class counts
over all labelled rows give its prior, so a balanced sample doesn't shift the scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from tracewright.llm.common import byte_ngrams, hashed_sample, parts, spared_driver, sparing

#: Symbols of a recurrence: no earlier occurrence, then octaves of the distance; words of an n-gram of them.
OCTAVES, ORDER = 8, 4
#: Buckets: 256 single bytes, 65,536 pairs, 65,536 hashed triples, n-grams of recurrences.
GRAMS = 256 + 2 * 65536
WIDTH = GRAMS + sum(OCTAVES**n for n in range(1, ORDER + 1))
CHUNK = 1 << 18


def recurrences(words: list[bytes]) -> np.ndarray:
    """Of each word 0 if it is new, else 1 plus the octave of the distance to its last occurrence, OCTAVES - 1 at most."""
    h = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    order = np.argsort(h, kind="stable")
    gap = np.diff(order)
    again = np.flatnonzero(h[order][1:] == h[order][:-1])
    out = np.zeros(len(words), dtype=np.int64)
    out[order[again + 1]] = np.minimum(np.floor(np.log2(gap[again])).astype(np.int64) + 1, OCTAVES - 1)
    return out


def indicators(data: bytes | None) -> np.ndarray:
    """Sorted numbers of the n-grams that occur anywhere in the text."""
    flags = np.zeros(WIDTH, dtype=bool)
    data = data or b""
    for at in range(0, len(data), CHUNK):
        b = np.frombuffer(data[at : at + CHUNK + 2], dtype=np.uint8)
        flags[b] = True
        if len(b) > 1:
            flags[256 + (b[:-1].astype(np.int64) << 8 | b[1:])] = True
            flags[256 + 65536 + byte_ngrams(b, 3, 16)] = True
    symbol, at = recurrences(data.split()), GRAMS
    gram = np.zeros(len(symbol) + 1, dtype=np.int64)
    for n in range(1, min(ORDER, len(symbol)) + 1):
        gram = gram[:-1] * OCTAVES + symbol[n - 1 :]
        flags[at + gram] = True
        at += OCTAVES**n
    return np.flatnonzero(flags)


@dataclass
class Model:
    """Log-count ratios times weights per n-gram, bias, and slope and offset of the logistic curve."""

    weight: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, idx: np.ndarray) -> float:
        return float(self.weight[idx].sum() / np.sqrt(max(1, len(idx))) + self.bias)

    def score(self, data: bytes | None) -> float:
        z = self.slope * self.margin(indicators(data)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, width: int, epochs: int = 30, seed: int = 1, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimize |w|^2/2 + sum cost * hinge; rows are (indices, values), y is -1 or 1."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(width), 0.0, np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1 for _, v in rows])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            idx, v = rows[i]
            g = y[i] * (w[idx] @ v + bias) - 1
            pg = min(g, 0) if alpha[i] <= 0 else max(g, 0) if alpha[i] >= cost[i] else g
            worst = max(worst, abs(pg))
            if pg:
                new = min(max(alpha[i] - g / norms[i], 0), cost[i])
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[idx] += step * v
                bias += step
        if worst < tolerance:
            break
    return w, bias


def _fit(docs: list[np.ndarray], y: np.ndarray, c: float, smooth: float) -> Model:
    pos, neg = np.full(WIDTH, smooth), np.full(WIDTH, smooth)
    for idx, k in zip(docs, y, strict=True):
        (pos if k > 0 else neg)[idx] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    rows = [(idx, ratio[idx] / np.sqrt(max(1, len(idx)))) for idx in docs]
    n = {k: max(1, int((y == k).sum())) for k in (-1, 1)}
    cost = np.array([c * len(y) / (2 * n[k]) for k in y])
    w, bias = dual_coordinate_descent(rows, y, cost, WIDTH)
    return Model(w * ratio, bias)


def _logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets (Platt 1999)."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        d, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        grad = np.array([d @ m, d.sum()]) + np.array([1e-3 * a, 0])
        hess = np.array([[h @ (m * m) + 1e-3, h @ m], [h @ m, h.sum()]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def train(texts: list[bytes | None], labels: list[int], prior: float | None = None, c: float = 1.0, smooth: float = 1.0, folds: int = 4) -> Model:
    """Fit on labelled texts (1 good, 0 bad); the options are those of train_indicators."""
    return train_indicators([indicators(t) for t in texts], labels, prior, c, smooth, folds)


def train_indicators(docs: list[np.ndarray], labels: list[int], prior: float | None = None, c: float = 1.0, smooth: float = 1.0, folds: int = 4) -> Model:
    """Fit on the labelled texts' indicators; prior: the share of label 1 among all rows, if the texts are a sample.

    With one class only, the score is that class's smoothed share for every text; without rows it is 0.5.
    """
    y = np.where(np.array(labels, dtype=int) > 0, 1, -1)
    if not len(y) or len(set(y.tolist())) < 2:
        p = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(WIDTH), 0.0, 1.0, float(np.log(p / (1 - p))))
    fold = np.zeros(len(y), dtype=int)
    for k in (-1, 1):
        fold[y == k] = np.arange((y == k).sum()) % folds
    margins = np.zeros(len(y))
    for f in range(folds):
        rest = fold != f
        if len(set(y[rest].tolist())) < 2:
            continue
        part = _fit([d for d, r in zip(docs, rest, strict=True) if r], y[rest], c, smooth)
        for i in np.flatnonzero(~rest):
            margins[i] = part.margin(docs[i])
    share = float((y > 0).mean())
    prior = share if prior is None else min(max(prior, 1e-6), 1 - 1e-6)
    weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    model = _fit(docs, y, c, smooth)
    model.slope, model.offset = _logistic(margins, y, weight)
    return model


@spared_driver
def fit(docs: DataFrame, labels: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4000, **options) -> Model:
    """Train on at most max_rows labelled rows (evenly by class, lowest seeded hash first) that meet the condition on the id.

    Sampled ids go out in a broadcast of max_rows rows at most; only those rows' indicators come back, at most WIDTH
    numbers each. Labels but 0 and 1, null ids, and labels of no document are left out. Of an id with several labels the
    least counts, and of one with several texts the first in byte order, so a repeated id can't make a fit unrepeatable.
    Ids are of any type that both tables can be compared in.
    """
    kind = docs.schema[id_col].dataType
    marked = labels.select(F.col(id_col).cast(kind).alias(id_col), F.col(label_col).cast("int").alias("y")).where(where & F.col("y").isin(0, 1) & F.col(id_col).isNotNull())
    marked = marked.groupBy(id_col).agg(F.min("y").alias("y"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    got = hashed_sample(marked, id_col, "y", max_rows, ["y"])
    if not got:
        return train([], [])
    ids = docs.sparkSession.createDataFrame([(r[id_col], r["y"]) for r in got], StructType([StructField("id", kind), StructField("y", IntegerType())]))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = [indicators(t).astype(np.int32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["id", "y", "at"])

    schema = StructType([*ids.schema.fields, StructField("at", BinaryType())])
    rows = sorted(found.select("id", "y", "t").mapInArrow(sparing(run), schema).collect(), key=lambda r: r["id"])
    total = sum(counts.values())
    return train_indicators([np.frombuffer(r["at"], dtype=np.int32) for r in rows], [r["y"] for r in rows], counts.get(1, 0) / total, **options)


def classify(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with quality_score (0 to 1) and quality_pred (1 if the score reaches the threshold), from the text alone.

    A null or empty text has no n-gram and gets the score of the bias; repeated rows stay; columns of docs with these
    two names are replaced; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("quality_score", "quality_pred")
    at, names = base.columns.index(text_col), [*base.columns, "quality_score", "quality_pred"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in parts(batches):
            s = [m.score(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=names)

    return base.mapInArrow(sparing(run), StructType([*base.schema.fields, *StructType.fromDDL("quality_score double, quality_pred int").fields]))
