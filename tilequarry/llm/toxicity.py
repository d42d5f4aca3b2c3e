"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_key, need

#: Size of the hashed feature space, and bound of the labelled rows that weights are learned from.
BUCKETS = 1 << 20
MAX_FIT_ROWS = 20_000
#: Upper-case ASCII letters become lower case, other ASCII signs but the apostrophe become spaces; bytes above 127 stay.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 or b == 39 else 32 for b in range(256))
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _bucket(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """Buckets of the text's words, word pairs, and pairs of words with one or two others between; repeats included."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int32)
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    parts = [_bucket(h + np.uint64(1 << 40))]
    for gap, odd in zip((1, 2, 3), _ODD, strict=True):
        if len(h) > gap:
            parts.append(_bucket(h[:-gap] * np.uint64(odd) + h[gap:] * np.uint64(2 * odd + 1) + np.uint64(gap << 50)))
    return np.concatenate(parts)


class Ftrl:
    """Per-coordinate learning rates, and L1 by soft thresholding of the accumulated gradients."""

    def __init__(self, buckets: int = BUCKETS, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)  # the last coordinate is the intercept

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step on a row whose distinct active coordinates are at."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates with weights other than 0, and these; the intercept is coordinate -1."""
        at = np.arange(len(self.z))
        w = self.weights(at)
        keep = np.flatnonzero(w)
        return np.where(keep == len(w) - 1, -1, keep), w[keep]


def best_shift(margins: np.ndarray, labels: np.ndarray) -> float:
    """What to add to the margins so that the sign splits the labels with the highest F1; 0 if one label is missing."""
    if labels.all() or not labels.any():
        return 0.0
    order = np.argsort(-margins, kind="stable")
    m, hits = margins[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(m) + 1) + labels.sum())
    f1[:-1][m[1:] == m[:-1]] = -1.0  # a cut lies between different margins
    k = int(np.argmax(f1))
    below = m[k + 1] if k + 1 < len(m) else m[k] - 1.0
    return -float((m[k] + below) / 2)


def train(rows: list[np.ndarray], labels: list[int], epochs: int = 4, **options: float) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights (see Ftrl.sparse). Every fifth row is set aside to place the intercept, as L1 draws the scores of
    the rarer label to the other side."""
    model = Ftrl(**options)
    aside = range(0, len(rows), 5)
    for _ in range(epochs):
        for i, (at, label) in enumerate(zip(rows, labels, strict=True)):
            if i % 5:
                model.learn(at, label)
    where, w = model.sparse()
    if len(rows) >= 50:
        dense = model.weights(np.arange(len(model.z)))
        margins = np.array([dense[rows[i]].sum() for i in aside]) + dense[-1]
        shift = best_shift(margins, np.array([labels[i] for i in aside], bool))
        where, w = np.append(where, -1), np.append(w, shift)
    return where, w


class Weights:
    """Sparse weights as a dense lookup; made once in each Python worker from what is broadcast."""

    def __init__(self, at: np.ndarray, w: np.ndarray):
        self.dense = np.zeros(BUCKETS, np.float32)
        self.bias = float(w[at < 0].sum())
        self.dense[at[at >= 0]] = w[at >= 0]

    def score(self, text: str | None) -> float:
        at = features(text)
        w = self.dense[at]
        hit = np.flatnonzero(w)
        if len(hit):
            _, first = np.unique(at[hit], return_index=True)
            total = self.bias + float(w[hit[first]].astype(np.float64).sum())
        else:
            total = self.bias
        return float(1.0 / (1.0 + np.exp(-min(max(total, -35.0), 35.0))))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights (coordinates, values) learned from labelled documents outside the held-out fold.

    About max_rows labelled rows at most are used, chosen by a hash of the id; features are worked out where the
    documents are, and one task, whose input that bound limits, runs the passes in the order of the hash. Rows with a
    null id or label are left out; a document with several labels counts as 1 if one says so. Without any labelled row
    the weights are empty, and every score is one half.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", label_col)
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("_label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("_label").isNotNull() & (fold_key("doc_id") != 0)).groupBy("doc_id").agg(F.max("_label").alias("_label"))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < F.lit(int((1 << 20) * max_rows / total)))
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about max_rows ids at most

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [np.unique(features(t)).astype(np.int32).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["_label"], "at": rows})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[np.ndarray] = []
        marks: list[int] = []
        order: list[tuple] = []
        for pdf in batches:
            for i, label, at in zip(pdf["doc_id"], pdf["label"], pdf["at"], strict=True):
                order.append((crc32(str(i).encode() + b"#"), str(i)))
                rows.append(np.frombuffer(at, np.int32))
                marks.append(int(label > 0))
        if rows:
            at = sorted(range(len(rows)), key=order.__getitem__)
            where, w = train([rows[i] for i in at], [marks[i] for i in at])
            yield pd.DataFrame({"at": where.astype(np.int64), "w": w})

    encoded = some.mapInPandas(encode, f"doc_id {dict(some.dtypes)['doc_id']}, label int, at binary")
    found = encoded.repartition(1).mapInPandas(learn, "at long, w double").toPandas()
    return found["at"].to_numpy(np.int64), found["w"].to_numpy(float)


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5) of every whole text.

    Only the text enters the score; null and empty texts get the intercept's. Repeated rows get equal scores; columns of
    the same names are replaced; an empty table gives an empty table. The weights, a few per learned word, are broadcast.
    """
    need(docs, text_col)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Weights(*sent.value)
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype=float)

    return docs.select(*keep, scores(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Result of the toxicity query: every document's score, with its fold."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (fold_key("doc_id") == 0).alias("held_out"), "score", "predicted")
