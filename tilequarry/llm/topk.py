"""Exact top-k inner-product search by a three-phase uniform threshold.

A score is the sum of m local scores, one for each block of dimensions. Phase one gathers, for each query and block, the
head of the block's score list, and works out the total scores of these few; the k-th best of all is a safe cutoff.
If a total reaches the cutoff, one of its m local scores reaches cutoff / m. So phase two sends the cutoff to every list
and collects the entries at or above cutoff / m, and phase three resolves the remaining local scores of the collected
entries, leaving out those that cannot reach the cutoff any more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need

#: Vectors of one block of queries and of one block of candidates: a task holds one of each, and their scores.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
LISTS = 4


#: Stands for a cutoff that is not known.
NONE = -(1 << 63)


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as double; vectors null or with null, NaN or infinite components are left out."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    good = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = vectors.select(F.col(id_col).alias("vec_id"), x.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)
    return whole.select("vec_id", F.transform("v", lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column.to_numpy()]) if len(column) else np.zeros((0, 0), np.int64)


def _blocks(width: int, lists: int) -> list[slice]:
    edges = np.linspace(0, width, min(lists, max(width, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _local(q: np.ndarray, c: np.ndarray, part: slice) -> np.ndarray:
    """Exact integer inner products of one block of dimensions."""
    a, b = q[:, part], c[:, part]
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * max(1, q.shape[1]) < 2.0**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)  # exact: every sum is below 2**53
    return a @ b.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k ids of highest score, each at its best row; ties go to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        if len(np.unique(ids[some])) >= k:
            at = some
    order = at[np.lexsort((ids[at], -scores[at]))]
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)][:k]


def _rows(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    if not found:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
    return pd.DataFrame({"query_id": np.concatenate([np.full(len(i), q, np.int64) for q, i, _ in found]), "vec_id": np.concatenate([i for _, i, _ in found]), "score": np.concatenate([s for _, _, s in found])})


def _gather(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, lists: int) -> pd.DataFrame:
    """Phase one for one pair of blocks: the heads of the local lists, with their total scores."""
    if not len(queries) or not len(candidates):
        return _rows([])
    q, c, ids = _matrix(queries["v"]), _matrix(candidates["v"]), candidates["vec_id"].to_numpy(np.int64)
    parts = _blocks(q.shape[1], lists)
    local = [_local(q, c, p) for p in parts]
    found = []
    for i, query in enumerate(queries["query_id"].to_numpy(np.int64)):
        other = ids != query
        heads = set()
        for scores in local:
            at = np.flatnonzero(other)
            heads.update(at[_best(ids[at], scores[i, at], k)].tolist())
        at = np.fromiter(sorted(heads), np.int64, len(heads))
        total = sum(scores[i, at] for scores in local)
        top = _best(ids[at], total, k)
        found.append((int(query), ids[at][top], total[top]))
    return _rows(found)


def _collect(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, lists: int) -> pd.DataFrame:
    """Phases two and three for one pair of blocks; queries carry their cutoff (NONE: none is known)."""
    if not len(queries) or not len(candidates):
        return _rows([])
    q, c, ids = _matrix(queries["v"]), _matrix(candidates["v"]), candidates["vec_id"].to_numpy(np.int64)
    parts = _blocks(q.shape[1], lists)
    local = [_local(q, c, p) for p in parts]
    found = []
    for i, (query, cutoff) in enumerate(zip(queries["query_id"].to_numpy(np.int64), queries["cutoff"].tolist(), strict=True)):
        keep = ids != query
        if cutoff != NONE:
            share = cutoff // len(parts)  # rounded down, which collects no fewer
            # Phase two: collected entries; a local score that was not collected is below the share.
            sent = [scores[i] >= share for scores in local]
            bound = sum(np.where(s, scores[i], share) for s, scores in zip(sent, local, strict=True))
            keep &= np.logical_or.reduce(sent) & (bound >= cutoff)
        at = np.flatnonzero(keep)
        # Phase three: the remaining local scores of these, exactly.
        total = sum(scores[i, at] for scores in local)
        if cutoff != NONE:
            at, total = at[total >= cutoff], total[total >= cutoff]
        top = _best(ids[at], total, k)
        found.append((int(query), ids[at][top], total[top]))
    return _rows(found)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with the vectors of other ids.

    vectors and queries: (vec_id long, v array<long>). Ties go to the smaller vec_id; a query with fewer than k
    candidates gets all. Only vectors of the same length are compared. Every row takes part: where a vec_id occurs in
    several rows, its score is the highest of theirs. Empty tables give an empty result.

    Queries and candidates are dealt into blocks of bounded size by a hash of the id; each pair of blocks is one group.
    A pair sends on at most k entries for a query, so a vector that a third of all rows share does no harm.
    """
    need(vectors, "vec_id", "v")
    need(queries, "vec_id", "v")
    vectors, queries = (x.select(*(F.col(c).alias(c) for c in ("vec_id", "v"))).distinct() for x in (vectors, queries))
    n_queries, n_vectors = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-vectors.count() // CANDIDATE_BLOCK))
    asked = queries.select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("_width"), F.pmod(F.xxhash64("vec_id"), F.lit(n_queries)).alias("_q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_vectors - 1).cast("long"))).alias("_c"))
    given = vectors.select("vec_id", "v", F.size("v").alias("_width"), F.pmod(F.xxhash64("vec_id"), F.lit(n_vectors)).alias("_c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))).alias("_q"))
    keys = ["_width", "_q", "_c"]
    schema = "query_id long, vec_id long, score long"

    def gather(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _gather(a, b, k, lists)

    def collect(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _collect(a, b, k, lists)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    heads = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInPandas(gather, schema)
    ranked = heads.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    cutoffs = ranked.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("cutoff"))
    # Not null, which would make the column a double and round high cutoffs.
    asked = asked.join(cutoffs, "query_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(NONE)))
    entries = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInPandas(collect, schema)
    best = entries.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Result of the search query: rows whose vec_id is divisible by `every` against every other row."""
    vectors = quantise(embeddings, "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
