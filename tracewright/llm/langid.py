"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is the mean embedding of its hashed subwords (runs of 2 to 4 bytes of lower-cased UTF-8 that don't cross a word's
end; white space, digits and ASCII punctuation end words). A softmax layer on that mean is trained together with the
embeddings; subwords that no training row has are left out of the mean. A held-back share of the training rows fixes a
temperature, which makes the probabilities calibrated, and the confidence and the share of known subwords below which a
prediction is rejected: each would fall short on a reject_rate of correct rows, by the tail that the held-back ones show.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.llm.common import byte_ngrams, hashed_sample, parts, spared_driver, sparing

LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"
SIZES = (2, 3, 4)
_ENDS = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
#: Bits of a subword's hash by which known subwords are told from others; its upper bits are the embedding's bucket.
FINE = 20
#: Bytes of a text whose subwords are hashed at once.
CHUNK = 1 << 18


def subwords(text: str, bits: int = FINE) -> Iterator[np.ndarray]:
    """Hashes of the text's subwords, a piece at a time, over the whole text."""
    data = b" " + text.lower().encode("utf-8", "replace").translate(_ENDS) + b" "
    for at in range(0, len(data), CHUNK):
        b = np.frombuffer(data[at : at + CHUNK + max(SIZES) - 1], dtype=np.uint8)
        space = b == 32
        for n in SIZES:
            m = min(CHUNK, len(b) - n + 1)
            if m <= 0:
                continue
            inner = np.ones(m, dtype=bool)
            for j in range(1, n - 1):
                inner &= ~space[j : j + m]
            inner &= ~(space[:m] & space[n - 1 : n - 1 + m])
            yield byte_ngrams(b[: m + n - 1], n, bits)[inner]


@dataclass
class Model:
    """Classes, embedding-times-softmax table (bucket by class), bias, known subwords, temperature, and what is accepted."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    bits: int
    known: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0
    accept_known: float = 0.0

    def logits(self, parts: Iterable[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, float]:
        """Of the classes, and the share of subwords that are known. parts: hashes, and how often each occurs (None: once)."""
        total, n, every = np.zeros(len(self.langs)), 0, 0
        for idx, times in parts:
            every += len(idx) if times is None else int(times.sum())
            known = self.known[idx]
            counts = np.bincount(idx[known] >> (FINE - self.bits), None if times is None else times[known])
            total += counts @ self.table[: len(counts)]
            n += int(counts.sum())
        return total / max(1, n) + self.bias, n / max(1, every)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated confidence, and whether it is accepted; no letter: undetermined, rejected."""
        if not self.langs or not text or not LETTER.search(text):
            return UNDETERMINED, 0.0, False
        z, known = self.logits((idx, None) for idx in subwords(text))
        p = _softmax(z / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best]), bool(p[best] >= self.accept and known >= self.accept_known)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct subword hashes of a text and how often each occurs; none if it has no letter."""
    if not text or not LETTER.search(text):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.unique(np.concatenate(list(subwords(text))), return_counts=True)


def pack(fine: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Counts in 32 bits each: the hash, and up to 4,095 occurrences; more take several."""
    parts = []
    while len(fine):
        parts.append((fine << 12 | np.minimum(times, 4095)).astype(np.uint32))
        more = times > 4095
        fine, times = fine[more], times[more] - 4095
    return np.concatenate([*parts, np.empty(0, dtype=np.uint32)])


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(packed, dtype=np.uint32).astype(np.int64)
    return x >> 12, x & 4095


def lower_tail(values: np.ndarray, rate: float, share: float = 0.1) -> float:
    """The value that a row falls below with a probability of rate: the lowest share of the values, taken for exponential below their greatest."""
    ordered = np.sort(values)
    n = max(1, int(share * len(ordered)))
    top = ordered[min(n, len(ordered) - 1)]
    return float(top - (top - ordered[:n]).mean() * np.log(n / len(ordered) / rate))


def train(texts: list[str], langs: list[str], **options) -> Model:
    """Fit on labelled texts; the options are those of train_counted."""
    return train_counted([counted(t) for t in texts], langs, **options)


def train_counted(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], dim: int = 16, bits: int = 14, epochs: int = 6, rate: float = 1.0, seed: int = 1, calibration: float = 0.2, reject_rate: float = 1e-4) -> Model:
    """Fit on the subword counts of labelled texts. Rows without subwords teach nothing; no rows give a model that says undetermined."""
    kept = [(r, k) for r, k in zip(rows, langs, strict=True) if len(r[0])]
    names = sorted({k for _, k in kept})
    docs = []
    for (fine, times), k in kept:
        idx, at = np.unique(fine >> (FINE - bits), return_inverse=True)
        docs.append((idx, np.bincount(at, times) / times.sum(), names.index(k)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    held = order[: int(len(docs) * calibration)]
    fit = order[len(held) :]
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim))
    w, bias = np.zeros((dim, len(names))), np.zeros(len(names))
    known = np.zeros(1 << FINE, dtype=bool)
    for i in fit:
        known[kept[i][0][0]] = True
    steps, done = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            idx, share, k = docs[i]
            lr = rate * (1 - done / steps)
            done += 1
            h = share @ emb[idx]
            g = _softmax(h @ w + bias)
            g[k] -= 1
            back = w @ g
            w -= lr * np.outer(h, g)
            bias -= 0.1 * lr * g
            emb[idx] -= lr * 10 * share[:, None] * back
    model = Model(names, emb @ w, bias, bits, known)
    if len(held):
        said = [model.logits([kept[i][0]]) for i in held]
        z, share = np.array([x for x, _ in said]), np.array([x for _, x in said])
        y = np.array([docs[i][2] for i in held])
        at = np.arange(len(y))
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(_softmax(z / t)[at, y] + 1e-12).mean()))
        p = _softmax(z / model.temperature)
        right = p.argmax(axis=1) == y
        if right.any():
            sure = np.clip(p.max(axis=1)[right], 1e-12, 1 - 1e-12)
            model.accept = float(1 / (1 + np.exp(-lower_tail(np.log(sure / (1 - sure)), reject_rate))))
            model.accept_known = lower_tail(share[right], reject_rate)
    return model


@spared_driver
def fit(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 3000, **options) -> Model:
    """Train on at most max_rows rows of docs that meet the condition and have a text and a language, evenly by language.

    Executors count the sampled texts' subwords; the driver gets at most 2**FINE counts a row, however long a text is.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(where & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            got = [pack(*counted(t)).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got, pa.binary())], names=["__h", "id", "lang", "counts"])

    got = hashed_sample(rows, "id", "lang", max_rows, ["lang", "text"], sparing(run), "counts binary")
    return train_counted([unpack(r["counts"]) for r in got], [r["lang"] for r in got], **options)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_accepted, from the text alone.

    Null, empty and letterless texts are undetermined with score 0 and rejected; repeated rows stay; columns of docs
    with these three names are replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    added = "lang_pred string, lang_score double, lang_accepted boolean"
    base = docs.drop("lang_pred", "lang_score", "lang_accepted")
    at, names = base.columns.index(text_col), [*base.columns, "lang_pred", "lang_score", "lang_accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in parts(batches):
            said = [m.predict(t) for t in batch.column(at).to_pylist()]
            a, b, c = zip(*said, strict=True) if said else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.bool_())], names=names)

    return base.mapInArrow(sparing(run), StructType([*base.schema.fields, *StructType.fromDDL(added).fields]))
