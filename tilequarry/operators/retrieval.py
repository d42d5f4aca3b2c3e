"""Exact inner-product retrieval: exhaustive, in two stages, from a known position, and over rotations of the query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, vectors
from .numbering import BROADCAST_ROWS, broadcast_if_small

#: Vectors of a block in the blocked search, and queries of a block.
BLOCK = 4096


def _ranked(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def unit(df: DataFrame, vector: str = "v") -> DataFrame:
    return df.withColumn(vector, vectors.normalize(vector))


def top_by_blocks(queries: DataFrame, items: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """(keys..., item, score): the k best items of each query, by matrix products of bounded blocks.

    Each block of items meets each block of queries in one group, which sends on k items a query.
    """
    a, b = (max(1, -(-df.select(c).count() // BLOCK)) for df, c in ((queries, keys[0]), (items, item)))
    q = queries.select(*keys, F.col("v").alias("q"), F.pmod(F.xxhash64(*keys), F.lit(a)).alias("_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b - 1).cast("long"))).alias("_b"))
    t = items.select(item, "v", F.pmod(F.xxhash64(item), F.lit(b)).alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a - 1).cast("long"))).alias("_a"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[keys].iloc[:0].assign(**{item: right[item].iloc[:0], "score": np.zeros(0)})
        if len(left) and len(right):
            s = np.stack(left["q"].to_numpy()).astype(np.float64) @ np.stack(right["v"].to_numpy()).astype(np.float64).T
            ids = right[item].to_numpy()
            at = np.argsort(ids, kind="stable")
            pick = at[np.argsort(-s[:, at], axis=1, kind="stable")[:, :k]]
            n = pick.shape[1]
            out = left[keys].iloc[np.repeat(np.arange(len(left)), n)].reset_index(drop=True)
            out[item] = ids[pick].reshape(-1)
            out["score"] = np.take_along_axis(s, pick, axis=1).reshape(-1)
        return out

    types = dict(queries.dtypes) | dict(items.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, item)) + ", score double"
    return q.groupBy("_a", "_b").cogroup(t.groupBy("_a", "_b")).applyInPandas(score, schema)


def scored(queries: DataFrame, items: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """(keys..., item, score) that hold the k best items of each query and perhaps more.

    Few items, such as pages, are broadcast if a bounded count shows that they are few; else both sides are dealt into
    blocks.
    """
    if items.select(item).limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return top_by_blocks(queries, items, keys, item, k)
    pairs = queries.select(*keys, F.col("v").alias("_q")).join(F.broadcast(items.select(item, "v")))
    return pairs.select(*keys, item, vectors.dot("_q", "v").alias("score"))


def flat_search(queries: DataFrame, tiles: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, tile_id, score, page_id): the k best of all tiles. Vectors are unit vectors."""
    best = _ranked(top_by_blocks(queries, tiles, ["query_id"], "tile_id", k), ["query_id"], [F.desc("score"), F.col("tile_id")], k)
    return best.join(tiles.select("tile_id", "page_id"), "tile_id").select("query_id", "rank", "tile_id", "score", "page_id")


def coarse_candidates(queries: DataFrame, coarse: DataFrame, top_pages: int = 5, keys: list[str] | None = None) -> DataFrame:
    """(keys..., prank, page_id, page_score): the best pages of each query; fewer pages than asked for give all."""
    keys = keys or ["query_id"]
    best = _ranked(scored(queries, coarse, keys, "page_id", top_pages), keys, [F.desc("score"), F.col("page_id")], top_pages, "prank")
    return best.select(*keys, "prank", "page_id", F.col("score").alias("page_score"))


def add_local_pages(candidates: DataFrame, local: DataFrame) -> DataFrame:
    """candidates with each query's local page (query_id, page_id) appended last where it is not among them."""
    missing = local.join(candidates.select("query_id", "page_id"), ["query_id", "page_id"], "left_anti")
    last = candidates.groupBy("query_id").agg(F.max("prank").alias("m"))
    added = missing.join(last, "query_id", "left").select("query_id", (F.coalesce("m", F.lit(0)) + 1).cast("int").alias("prank"), "page_id", F.lit(None).cast("double").alias("page_score"))
    return candidates.unionByName(added)


def page_scores(queries: DataFrame, tiles: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., prank, tile_id, page_id, score) of all tiles in each query's candidate pages.

    Tiles are joined on page_id, so a table partitioned by it is read only where candidates are.
    """
    asked = candidates.join(queries.select(*keys, F.col("v").alias("_q")), keys)
    pairs = tiles.select("page_id", "tile_id", "v").join(broadcast_if_small(asked, BROADCAST_ROWS), "page_id")
    return pairs.select(*keys, "prank", "tile_id", "page_id", vectors.dot("_q", "v").alias("score"))


def search_pages(queries: DataFrame, tiles: DataFrame, candidates: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """(keys..., rank, tile_id, score, page_id): the k best tiles in each query's candidate pages.

    Ties go to the better page, then to the smaller tile id.
    """
    keys = keys or ["query_id"]
    scores = page_scores(queries, tiles, candidates, keys)
    return _ranked(scores, keys, [F.desc("score"), F.col("prank"), F.col("tile_id")], k).select(*keys, "rank", "tile_id", "score", "page_id", "prank")


def search_depths(queries: DataFrame, tiles: DataFrame, coarse: DataFrame, depths: list[int], top_k: int = 10) -> DataFrame:
    """(query_id, top_pages, rank, tile_id, score, page_id): what search() finds with each of several numbers of pages.

    Tiles are scored once, for the largest number.
    """
    q = unit(queries)
    scores = page_scores(q, tiles, coarse_candidates(q, coarse, max(depths)), ["query_id"])
    each = scores.withColumn("top_pages", F.explode(F.filter(F.array(*(F.lit(n) for n in sorted(set(depths)))), lambda n: n >= F.col("prank"))))
    best = _ranked(each, ["query_id", "top_pages"], [F.desc("score"), F.col("prank"), F.col("tile_id")], top_k)
    return best.select("query_id", "top_pages", "rank", "tile_id", "score", "page_id")


def search(queries: DataFrame, tiles: DataFrame, coarse: DataFrame, top_pages: int = 5, top_k: int = 10, local: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, tile_id, score, page_id): two-stage search, best pages first, then tiles inside them.

    queries: (query_id, v); tiles: (tile_id, page_id, v); coarse: (page_id, v). Query vectors are scaled to length one.
    local: (query_id, page_id) of pages to be searched as well. Parts of the result for a query without any page: none.
    """
    q = unit(queries)
    candidates = coarse_candidates(q, coarse, top_pages)
    if local is not None:
        candidates = add_local_pages(candidates, local)
    return search_pages(q, tiles, candidates, top_k).drop("prank")


def search_multirotation(queries: DataFrame, tiles: DataFrame, coarse: DataFrame, top_pages: int = 5, top_k: int = 10) -> DataFrame:
    """(query_id, rank, tile_id, score, page_id, rot): best score of each tile over the rotations (query_id, rot, v).

    Each rotation picks its own pages. Of equal scores the first rotation counts, and of tiles with equal scores the one
    that came first.
    """
    keys = ["query_id", "rot"]
    q = unit(queries)
    each = search_pages(q, tiles, coarse_candidates(q, coarse, top_pages, keys), top_k, keys)
    entry = F.struct("rot", F.col("rank").alias("r"), "page_id")
    best = each.groupBy("query_id", "tile_id").agg(F.max("score").alias("score"), F.min(F.struct("rot", F.col("rank").alias("r"))).alias("first"), F.max_by(entry, F.struct("score", -F.col("rot"))).alias("won"))
    ranked = _ranked(best, ["query_id"], [F.desc("score"), F.col("first.rot"), F.col("first.r")], top_k)
    return ranked.select("query_id", "rank", "tile_id", "score", F.col("won.page_id").alias("page_id"), F.col("won.rot").alias("rot"))


def rotations(queries: DataFrame, angles: Iterator[int] | list[int], step: int) -> DataFrame:
    """(query_id, rot, v): cyclic shifts of the vector by step components for each quarter turn.

    Angles are multiples of 90; a stand-in for turning the image where no image model is at hand.
    """
    turns = []
    for a in angles:
        if a % 90:
            raise ValueError("angles must be multiples of 90")
        turns.append((a // 90) % 4)
    shifted = [F.struct(F.lit(i).alias("rot"), (F.col("v") if not t else F.concat(F.slice("v", t * step + 1, F.size("v") - t * step), F.slice("v", 1, t * step))).alias("v")) for i, t in enumerate(turns)]
    return queries.select("query_id", F.explode(F.array(*shifted)).alias("r")).select("query_id", "r.rot", "r.v")


def pages_of_points(points: DataFrame, pages: DataFrame, left: float, top: float, size: float) -> DataFrame:
    """points (point_id, x, y) with page_id of an existing page whose closed box holds the point, else null.

    The cells that can hold a point follow from its coordinates: its own, and a neighbour where it lies on an edge. They
    are looked up by key; of several pages the one with the smallest page_int_id counts.
    """
    col, row = (F.col("x") - left) / size, (F.lit(float(top)) - F.col("y")) / size

    def options(c: Column) -> Column:
        base = F.floor(c).cast("int")
        return F.array(base - 1, base, base + 1)

    cells = points.select("*", F.explode(options(row)).alias("page_row")).select("*", F.explode(options(col)).alias("page_col"))
    found = cells.join(broadcast_if_small(pages.select("page_row", "page_col", "page_id", "page_int_id", "minx", "miny", "maxx", "maxy")), ["page_row", "page_col"])
    inside = found.where("minx <= x and maxx >= x and miny <= y and maxy >= y")
    best = inside.groupBy("point_id").agg(F.min_by("page_id", "page_int_id").alias("page_id"))
    return points.join(best, "point_id", "left")


def neighbour_pages(pages: DataFrame) -> DataFrame:
    """(page_id, neighbour_id): existing pages among the eight around each page."""
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    moved = pages.select("page_id", "page_row", "page_col", F.explode(step).alias("dr")).select("*", F.explode(step).alias("dc")).where("dr <> 0 or dc <> 0")
    named = moved.select("page_id", geo.page_id(F.col("page_row") + F.col("dr"), F.col("page_col") + F.col("dc")).alias("neighbour_id"))
    return named.join(pages.select(F.col("page_id").alias("neighbour_id")), "neighbour_id", "left_semi").select("page_id", "neighbour_id")
