"""Descriptors pooled from patch tokens: class token, mean of patches, and rings around the centre."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

STRATEGIES = ("cls", "mean_patch", "radial")


def check_strategy(name: str) -> str:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; there are {STRATEGIES}")
    return name


def infer_grid(n_tokens: int, height: int, width: int, patch: int) -> tuple[int, int]:
    """Rows and columns of patches: those of the image size if their product fits, else a square, else an error."""
    h, w = height // patch, width // patch
    if h * w == n_tokens:
        return h, w
    side = math.isqrt(n_tokens)
    if side * side == n_tokens:
        return side, side
    raise ValueError(f"{n_tokens} tokens make no grid")


def radial_bin(index: str | Column, grid_h: int, grid_w: int, bins: int) -> Column:
    """Ring of a patch, by its distance from the grid's centre relative to the farthest patch."""
    i = F.col(index) if isinstance(index, str) else index
    cy, cx = (grid_h - 1) / 2, (grid_w - 1) / 2
    far = max(math.sqrt(cy * cy + cx * cx), 1e-6)
    row, col = F.floor(i / F.lit(grid_w)), i % F.lit(grid_w)
    r = F.sqrt((row - cy) * (row - cy) + (col - cx) * (col - cx))
    return F.least(F.lit(bins - 1), F.floor(r / F.lit(far) * bins)).cast("int")


def patches(tokens: DataFrame, registers: int) -> DataFrame:
    """(image_id, patch, v): tokens after the class token and the registers, numbered from 0."""
    return tokens.where(F.col("token_idx") >= 1 + registers).select("image_id", (F.col("token_idx") - 1 - registers).alias("patch"), "v")


def cls_descriptor(tokens: DataFrame) -> DataFrame:
    return tokens.where("token_idx = 0").select("image_id", vectors.normalize("v").alias("v"))


def _joined(parts: DataFrame) -> DataFrame:
    """(image_id, v) of (image_id, i, m): components in order, scaled to length one."""
    whole = parts.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("v"))
    return whole.select("image_id", vectors.normalize("v").alias("v"))


def mean_patch(tokens: DataFrame, registers: int) -> DataFrame:
    """Mean of the unit patch vectors, scaled to length one."""
    unit = patches(tokens, registers).select("image_id", F.posexplode(vectors.normalize("v")).alias("i", "x"))
    return _joined(unit.groupBy("image_id", "i").agg(F.avg("x").alias("m")))


def radial_pool(tokens: DataFrame, registers: int, grid_h: int, grid_w: int, bins: int, dim: int) -> DataFrame:
    """Mean unit patch vector of each ring (zeros for a ring without patches), rings in a row, scaled to length one.

    Patches beyond the grid are left out; an image with fewer patches than the grid has is an error where it is read.
    """
    p = patches(tokens, registers).where(F.col("patch") < grid_h * grid_w)
    p = p.withColumn("bin", radial_bin("patch", grid_h, grid_w, bins))
    each = p.select("image_id", "bin", F.posexplode(vectors.normalize("v")).alias("i", "x"))
    means = each.groupBy("image_id", "bin", "i").agg(F.avg("x").alias("m")).select("image_id", (F.col("bin") * dim + F.col("i")).alias("i"), "m")
    few = F.raise_error(F.lit(f"an image has fewer than {grid_h * grid_w} patches")).cast("array<int>")
    places = F.when(F.col("n") >= grid_h * grid_w, F.sequence(F.lit(0), F.lit(bins * dim - 1))).otherwise(few)
    slots = p.groupBy("image_id").agg(F.count("*").alias("n")).select("image_id", F.explode(places).alias("i"))
    filled = slots.join(means, ["image_id", "i"], "left").select("image_id", "i", F.coalesce("m", F.lit(0.0)).alias("m"))
    return _joined(filled)


def descriptor(tokens: DataFrame, strategy: str, registers: int = 4, grid: tuple[int, int] = (4, 4), bins: int = 8, dim: int = 64) -> DataFrame:
    check_strategy(strategy)
    if strategy == "cls":
        return cls_descriptor(tokens)
    if strategy == "mean_patch":
        return mean_patch(tokens, registers)
    return radial_pool(tokens, registers, grid[0], grid[1], bins, dim)


def rot90(patch: str | Column, side: int, turns: int) -> Column:
    """Number of the patch after turning a square grid by quarter turns."""
    p = F.col(patch) if isinstance(patch, str) else patch
    for _ in range(turns % 4):
        row, col = F.floor(p / F.lit(side)), p % F.lit(side)
        p = (F.lit(side - 1) - col) * side + row
    return p.cast("long")
