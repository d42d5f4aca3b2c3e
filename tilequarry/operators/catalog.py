"""Tile catalogue: point grid to pixel windows, ground boxes and geographic pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import Raster
from .numbering import number_rows

# Accepted names of coordinate columns, in order of preference.
X_NAMES = ("center_x", "x", "X", "Easting", "east", "POINT_X")
Y_NAMES = ("center_y", "y", "Y", "Northing", "north", "POINT_Y")


def find_column(df: DataFrame, names: tuple[str, ...]) -> str:
    """The first of names that a column has, in any case; an error lists the columns there are."""
    have = {c.lower(): c for c in reversed(df.columns)}
    for n in names:
        if n.lower() in have:
            return have[n.lower()]
    raise ValueError(f"none of the columns {list(names)} is among {df.columns}")


def window_columns(x: Column, y: Column, raster: Raster, tile_px: int) -> dict[str, Column]:
    """Offsets of the window of tile_px pixels around the pixel that holds the point."""
    col = F.floor((x - F.lit(float(raster.left))) / F.lit(float(raster.gsd))).cast("int")
    row = F.floor((F.lit(float(raster.top)) - y) / F.lit(float(raster.gsd))).cast("int")
    half = F.lit(tile_px // 2)
    return {"window_col_off": col - half, "window_row_off": row - half}


def build_catalog(points: DataFrame, raster: Raster, tile_px: int, stride_px: int, page_size_m: float, order: list[str], config_name: str = "default", check_empty: bool = True) -> DataFrame:
    """One row for each point whose window lies inside the raster, with dense tile ids in the given order of points.

    The box is that of the pixel-snapped window; the page is that of the point. source_point_id is the input's tile_id
    column if there is one, else the point's number before any is left out. A point with a null coordinate is left out.
    """
    if tile_px % 2:
        raise ValueError("tile_px must be even")
    x, y = F.col(find_column(points, X_NAMES)), F.col(find_column(points, Y_NAMES))
    has_id = "tile_id" in points.columns
    base = points.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), *([F.col("tile_id").cast("long").alias("source_point_id")] if has_id else []), x.cast("double").alias("center_x"), y.cast("double").alias("center_y"))
    keys = [f"_o{i}" for i in range(len(order))]
    if not has_id:
        base = number_rows(base, keys, "source_point_id")
    placed = base.withColumns(window_columns(F.col("center_x"), F.col("center_y"), raster, tile_px))
    c, r = F.col("window_col_off"), F.col("window_row_off")
    inside = placed.where((c >= 0) & (r >= 0) & (c + tile_px <= raster.width) & (r + tile_px <= raster.height))
    numbered = number_rows(inside, keys, "tile_id")
    if check_empty and numbered.limit(1).count() == 0:
        raise ValueError("no point has a window inside the raster")
    g = F.lit(float(raster.gsd))
    minx, maxy = F.lit(float(raster.left)) + c * g, F.lit(float(raster.top)) - r * g
    row, col = geo.page_row("center_y", raster.top, page_size_m), geo.page_col("center_x", raster.left, page_size_m)
    px = F.lit(tile_px)
    return numbered.withColumns({"page_row": row, "page_col": col}).select(
        "tile_id", "source_point_id", F.lit(config_name).alias("config_name"), px.alias("tile_px"), F.lit(stride_px).alias("stride_px"), g.alias("gsd_m"),
        (px * g).alias("tile_m"), (F.lit(stride_px) * g).alias("stride_m"), "center_x", "center_y", "window_col_off", "window_row_off", px.alias("window_width"), px.alias("window_height"),
        minx.alias("minx"), (maxy - px * g).alias("miny"), (minx + px * g).alias("maxx"), maxy.alias("maxy"),
        geo.page_id("page_row", "page_col").alias("page_id"), "page_row", "page_col",
        F.lit(float(raster.left)).alias("raster_left"), F.lit(float(raster.top)).alias("raster_top"), F.lit(float(page_size_m)).alias("page_size_m"),
    )
