"""Quality verdicts by a learned decision list over whole-text counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_key, need

#: Fixed values of the base counts.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Bound of the labelled rows that the list is learned from.
MAX_FIT_ROWS = 20_000

COUNTS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_lines": "long", "n_upper": "long", "n_digits": "long", "n_exclaims": "long", "n_distinct": "long",
}
_SYMBOL, _UPPER, _DIGIT, _POINT = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_POINT[:] = True
_POINT[0x80:0xC0] = False  # continuation bytes: the rest are one for each code point
_POINT[[0x20, *range(0x09, 0x0E)]] = False


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of so many words that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # Windows get dense ids by doubling: a pair of equal halves is an equal window, so no hash can mistake them.
    size, ranks = 1, ids
    while size < window:
        m = len(ranks) - size
        _, ranks = np.unique(ranks[:m] * (int(ranks.max()) + 1) + ranks[size : size + m], return_inverse=True)
        size *= 2
    again = np.bincount(ranks)[ranks] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[window : window + n] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def count_text(text: str | None) -> tuple[int, ...]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    tally = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words), int(tally[_POINT].sum()), int(tally[_SYMBOL].sum()), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), int(tally[_UPPER].sum()), int(tally[_DIGIT].sum()), int(tally[33]), len(set(words)),
    )


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the COUNTS columns of every whole text; a null text has no words."""
    need(docs, text_col)
    keep = [c for c in docs.columns if c not in COUNTS and c != "_counts"]

    @F.pandas_udf(", ".join(f"{n} {t}" for n, t in COUNTS.items()))
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([count_text(t) for t in texts], columns=list(COUNTS), dtype="int64")

    with_counts = docs.select(*keep, counts(F.col(text_col)).alias("_counts"))
    return with_counts.select(*keep, *(F.col(f"_counts.{n}").alias(n) for n in COUNTS))


#: Features of the list, as Spark columns and, for learning, over pandas columns of the same names.
FEATURES: dict[str, tuple[str, str | None]] = {
    "n_words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "exclaims_per_word": ("n_exclaims", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
}


def feature_column(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a).cast("double") if b is None else F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))


def feature_matrix(counts: pd.DataFrame) -> np.ndarray:
    columns = []
    for a, b in FEATURES.values():
        x = counts[a].to_numpy(float)
        if b is not None:
            y = counts[b].to_numpy(float)
            x = np.divide(x, y, out=np.zeros_like(x), where=y > 0)
        columns.append(x)
    return np.column_stack(columns) if columns else np.zeros((len(counts), 0))


Condition = tuple[str, str, float]


def _covers(x: np.ndarray, rule: list[Condition]) -> np.ndarray:
    names = list(FEATURES)
    hit = np.ones(len(x), bool)
    for name, op, cut in rule:
        v = x[:, names.index(name)]
        hit &= v >= cut if op == ">=" else v <= cut
    return hit


def _best_condition(x: np.ndarray, y: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of the largest information gain (FOIL) on rows x with targets y."""
    p0, n0 = int(y.sum()), int((~y).sum())
    base = math.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for j, name in enumerate(FEATURES):
        order = np.argsort(x[:, j], kind="stable")
        v, t = x[order, j], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1])  # between different values only
        if not len(cut):
            continue
        low_p = np.cumsum(t)[cut]
        low_n = (cut + 1) - low_p
        middle = (v[cut] + v[cut + 1]) / 2
        for op, p, n in (("<=", low_p, low_n), (">=", p0 - low_p, n0 - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), (name, op, float(middle[k]))
    return best, found


def learn_list(counts: pd.DataFrame, reject: np.ndarray, precision: float = 0.9, least: int = 5, max_rules: int = 32) -> list[list[Condition]]:
    """Sequential covering: rules for rejection, each a conjunction of thresholds, in the order in which they apply.

    Two thirds of the rows grow a rule by the FOIL gain; the rest prunes its last conditions while (p - n) / (p + n)
    does not fall. A rule stays if it covers at least `least` bad rows with the given precision over all rows left.
    """
    x, y = feature_matrix(counts), np.asarray(reject, bool)
    rules: list[list[Condition]] = []
    left = np.ones(len(y), bool)
    grow = np.arange(len(y)) % 3 != 2
    while len(rules) < max_rules and y[left & grow].sum() >= least:
        rule: list[Condition] = []
        at = left & grow
        while y[at].any() and (~y[at]).any() and len(rule) < 6:
            _, condition = _best_condition(x[at], y[at])
            if condition is None:
                break
            rule.append(condition)
            at &= _covers(x, [condition])

        def worth(some: list[Condition], held=left & ~grow) -> float:
            hit = _covers(x, some) & held
            p, n = int(y[hit].sum()), int((~y[hit]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = _covers(x, rule) & left if rule else np.zeros(len(y), bool)
        p = int(y[hit].sum())
        if not rule or p < least or p < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rejected(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional expression: the first rule that holds rejects, else the default accepts."""
    out: Column | None = None
    for rule in rules:
        holds = F.lit(True)
        for name, op, cut in rule:
            f = feature_column(name)
            holds = holds & (f >= cut if op == ">=" else f <= cut)
        out = F.when(holds, F.lit(True)) if out is None else out.when(holds, F.lit(True))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def fit_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> list[list[Condition]]:
    """Learn the list from labelled documents (quality 0: reject); folds with remainder 0 are held out.

    At most about max_rows labelled rows, chosen by a checksum of the id, are counted and brought to the driver; their
    ten counts are all that comes. Rows with a null id or label are left out; a document with several labels counts as
    bad if one says so.
    """
    clean = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold_key("doc_id") != 0))
    clean = clean.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = clean.count()
    if total > max_rows:
        clean = clean.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * max_rows / total)))
    some = docs.select("doc_id", "text").join(F.broadcast(clean), "doc_id")  # about max_rows ids at most
    rows = text_counts(some).drop("text").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    rows = rows[~((rows["n_words"] < 20) | (100 * rows["n_repeat_words"] > 30 * rows["n_words"]))].reset_index(drop=True)
    return learn_list(rows, (rows["quality"] == 0).to_numpy())


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """docs with the counts, base_failed and kept (not base_failed, and the list does not reject).

    Null and empty texts have no words and fail; repeated rows stay; columns of the same names are replaced; an empty
    table gives an empty table.
    """
    counted = text_counts(docs.drop("base_failed", "kept"))
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected(rules))
