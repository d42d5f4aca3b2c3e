"""Soft-membership mixing: domain posteriors of a classifier, and document rates that meet target token totals."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, need

#: Bound of the labelled rows that the classifier is learned from.
MAX_FIT_ROWS = 10_000
#: Most domains that labels may name; the classifier holds one vector of weights for each.
MAX_DOMAINS = 1000
#: Share of the tokens that each value of labels.quality is to have.
TARGETS = {"1": 0.9, "0": 0.1}
CLASSES = 20
#: Share of all tokens by which a domain may miss its target; a fit that ends further away gives a warning.
CLOSE = 1e-4


def _byte_classes() -> np.ndarray:
    """Classes of bytes: each mark that junk is made of by itself, the rest by kind."""
    kinds = np.full(256, 19, np.uint8)
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[128:] = 0, 1, 2, 3
    kinds[32], kinds[10], kinds[9], kinds[13] = 4, 5, 6, 6
    for i, c in enumerate(b"!#$%&*|<>.,"):
        kinds[c] = 7 + i
    return kinds


_KINDS = _byte_classes()
WIDTH = CLASSES * CLASSES + 4


def text_features(text: str | None) -> tuple[np.ndarray, int]:
    """Square roots of the shares of byte-class pairs, with length and repetition; and the number of words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    out = np.zeros(WIDTH, np.float32)
    if len(data) > 1:
        k = _KINDS[np.frombuffer(data, np.uint8)].astype(np.int64)
        pairs = np.bincount(k[:-1] * CLASSES + k[1:], minlength=CLASSES * CLASSES)
        out[: CLASSES * CLASSES] = np.sqrt(pairs / (len(data) - 1))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = max(1, len(words))
    out[-4:] = (math.log1p(len(words)) / 10, len(set(words)) / math.sqrt(n) / 20, len(set(words)) / n, len(set(lines)) / max(1, len(lines)))
    return out, len(words)


class Softmax:
    """Multinomial logistic regression on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        z = np.clip(z, -8, 8) @ self.weights[:-1] + self.weights[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def pack(self) -> list[float]:
        return np.concatenate([self.mean, self.scale, self.weights.ravel()]).astype(float).tolist()

    @staticmethod
    def unpack(values: list[float], domains: int) -> Softmax:
        v = np.asarray(values, np.float64)
        return Softmax(v[:WIDTH], v[WIDTH : 2 * WIDTH], v[2 * WIDTH :].reshape(WIDTH + 1, domains))


def train(x: np.ndarray, y: np.ndarray, domains: int, steps: int = 300, decay: float = 1e-3) -> Softmax:
    """Accelerated full-batch gradient descent."""
    x = x.astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.column_stack([z, np.ones(len(z))])
    goal = np.eye(domains)[y]
    w = old = np.zeros((z.shape[1], domains))
    top = np.linalg.norm(z, 2) ** 2 / len(z)
    for t in range(steps):
        v = w + (t / (t + 3)) * (w - old)
        p = z @ v
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = z.T @ (p - goal) / len(z) + decay * v
        old, w = w, v - g / (0.5 * top + decay)
    return Softmax(mean, scale, w)


def fit_domains(docs: DataFrame, labels: DataFrame, domain_col: str = "quality", max_rows: int = MAX_FIT_ROWS) -> tuple[list[str], list[float] | None]:
    """Domains (sorted names of the labelled values) and the packed classifier; None where fewer than two are labelled.

    About max_rows labelled rows at most are used, chosen by a hash of the id; one task, whose input that bound limits,
    fits the weights. Rows with a null id or label are left out; of several labels of a document the least counts. More
    than MAX_DOMAINS values raise a ValueError before any fitting.
    """
    need(labels, "doc_id", domain_col)
    known = labels.select("doc_id", F.col(domain_col).cast("string").alias("_domain")).dropna().groupBy("doc_id").agg(F.min("_domain").alias("_domain"))
    sizes = known.groupBy("_domain").count().orderBy("_domain").limit(MAX_DOMAINS + 1).collect()
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"{domain_col} has more than {MAX_DOMAINS} values; a domain needs one of few")
    domains, total = [r["_domain"] for r in sizes], sum(r["count"] for r in sizes)
    if len(domains) < 2:
        return domains, None
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.lit(int((1 << 20) * max_rows / total)))
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about max_rows ids at most
    number = {d: i for i, d in enumerate(domains)}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": [crc32(str(i).encode()) for i in pdf["doc_id"]], "domain": [number[d] for d in pdf["_domain"]], "x": [text_features(t)[0].tobytes() for t in pdf["text"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        rows = pd.concat(held).sort_values(["key", "x"]) if held else []
        if len(rows):
            x = np.stack([np.frombuffer(b, np.float32) for b in rows["x"]])
            yield pd.DataFrame({"w": [train(x, rows["domain"].to_numpy(np.int64), len(domains)).pack()]})

    found = some.mapInPandas(encode, "key long, domain int, x binary").repartition(1).mapInPandas(learn, "w array<double>").collect()
    return domains, list(found[0]["w"]) if found else None


def memberships(docs: DataFrame, domains: list[str], model: list[float] | None, keep: list[str]) -> DataFrame:
    """(keep..., n_tokens, posteriors): whole texts; without a classifier all domains are equally likely."""
    k = max(1, len(domains))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_tokens long, posteriors array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = Softmax.unpack(sent.value, k) if sent.value is not None else None
        for texts in batches:
            rows = [text_features(t) for t in texts]
            x = np.stack([r[0] for r in rows]) if rows else np.zeros((0, WIDTH), np.float32)
            p = found.posteriors(x) if found else np.full((len(rows), k), 1 / k)
            yield pd.DataFrame({"n_tokens": [r[1] for r in rows], "posteriors": list(p)})

    return docs.select(*keep, predict(F.col("text")).alias("_m")).select(*keep, "_m.n_tokens", "_m.posteriors")


def rate_sql(steps: list[list[float]]) -> str:
    """A document's rate after the given projected-gradient steps, from its posteriors; it grows by one term a step."""
    out = "1D"
    for step in steps:
        move = " + ".join(f"posteriors[{i}] * ({v!r}D)" for i, v in enumerate(step))
        out = f"greatest(0D, {out} - ({move}))"
    return out


def fit_rates(members: DataFrame, targets: list[float], most: int = 25, close: float = CLOSE) -> tuple[list[list[float]], float]:
    """Steps of projected-gradient least squares on the rates, and the residual's size over all tokens.

    Minimises the squared distance of the expected domain totals, sum of rate * tokens * posterior, from the targets
    over rates of at least 0, from rates of 1. The gradient of a document's rate, taken for each of its tokens, is the
    residual seen through its posteriors; a preconditioner of the size domains x domains scales it. An iteration is one
    aggregation over all documents that brings one number a domain to the driver. A step that does not bring the totals
    closer is halved.
    """
    k = len(targets)
    first = members.agg(F.sum(F.col("n_tokens").cast("double")).alias("n"), *(F.sum(F.expr(f"n_tokens * posteriors[{i}] * posteriors[{j}]")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
    n = float(first["n"] or 0)
    if not n or not k:
        return [], 0.0
    gram = np.array([[float(first[f"m{min(i, j)}_{max(i, j)}"] or 0) for j in range(k)] for i in range(k)]) / n
    scale = np.linalg.inv(gram + 1e-6 * np.eye(k))
    goal = np.array(targets) * n

    def residual(steps: list[list[float]]) -> np.ndarray:
        r = rate_sql(steps)
        row = members.select("n_tokens", "posteriors", F.expr(r).alias("_r")).agg(*(F.sum(F.expr(f"_r * n_tokens * posteriors[{i}]")).alias(f"t{i}") for i in range(k))).first()
        return (np.array([float(row[f"t{i}"] or 0) for i in range(k)]) - goal) / n

    steps: list[list[float]] = []
    now, pace = residual(steps), 1.0
    for _ in range(most):
        if np.abs(now).max() <= close:
            break
        tried = [*steps, (pace * (scale @ now)).tolist()]
        then = residual(tried)
        if np.linalg.norm(then) < np.linalg.norm(now):
            steps, now = tried, then
        else:
            pace /= 2
    return steps, float(np.abs(now).max())


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain_col: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """(keep..., n_tokens, posteriors, rate, copies): how often each document is to be used.

    targets: share of all tokens that each domain is to have (a domain not named: 0; shares are scaled to sum 1). rate is
    the fitted expected number of uses; copies rounds it, up with the probability of its fraction, by a hash of the id,
    so it is reproducible and equal for repeated rows. Null and empty texts have 0 tokens and keep the rate that their
    posteriors give. With fewer than two labelled domains every rate is 1. An empty table gives an empty table.
    """
    need(docs, "doc_id", "text")
    domains, model = fit_domains(docs, labels, domain_col)
    keep = keep or ["doc_id"]
    members = materialise(memberships(docs, domains, model, keep), "members")
    wanted = [float((targets or TARGETS).get(d, 0.0)) for d in domains]
    steps: list[list[float]] = []
    if model is not None and sum(wanted) > 0:
        steps, off = fit_rates(members, [w / sum(wanted) for w in wanted])
        if off > CLOSE:
            warnings.warn(f"the targets were not met: a domain's share of the tokens is off by {off:.2g}", stacklevel=2)
    luck = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rated = members.withColumn("rate", F.expr(rate_sql(steps)))
    return rated.withColumn("copies", (F.floor("rate") + F.when(luck < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain_col: str = "quality") -> DataFrame:
    """docs with each row as often as its copies say; columns and their order stay, whatever their names."""
    held = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_given"))
    mixed = mix(held, labels, targets, domain_col, keep=["doc_id", "_given"]).where(F.col("copies") > 0)
    return mixed.select("_given", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_given.*")
