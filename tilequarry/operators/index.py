"""Two-level index: tiles with unit vectors, pages with boxes and counts, and one mean vector for each page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, vectors

REQUIRED = ("raster_left", "raster_top", "page_size_m")


@dataclass(frozen=True)
class Index:
    tiles: DataFrame
    pages: DataFrame
    coarse: DataFrame


def check_catalog(catalog: DataFrame) -> dict:
    """The catalogue's constants; an error if a column is missing or a constant is not one."""
    missing = [c for c in REQUIRED if c not in catalog.columns]
    if missing:
        raise ValueError(f"the catalogue lacks {missing}")
    row = catalog.agg(*(F.min(c).alias(f"a_{c}") for c in REQUIRED), *(F.max(c).alias(f"b_{c}") for c in REQUIRED)).first()
    if any(row[f"a_{c}"] != row[f"b_{c}"] for c in REQUIRED):
        raise ValueError(f"the columns {list(REQUIRED)} must each have one value")
    return {c: row[f"a_{c}"] for c in REQUIRED}


def unmatched_embeddings(catalog: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Embeddings without a catalogue row."""
    return embeddings.join(catalog.select("tile_id"), "tile_id", "left_anti")


def join_embeddings(catalog: DataFrame, embeddings: DataFrame, strict: bool = True) -> DataFrame:
    """Catalogue rows with their vectors; with strict an error if an embedding has no row, or an id has two."""
    if strict:
        if unmatched_embeddings(catalog, embeddings).limit(1).count():
            raise ValueError("some embeddings have no catalogue row")
        for df in (catalog, embeddings):
            if df.groupBy("tile_id").count().where("count > 1").limit(1).count():
                raise ValueError("tile ids repeat")
    return catalog.join(embeddings, "tile_id")


def page_numbers(pages: DataFrame) -> DataFrame:
    """pages with page_int_id: dense from 0 in the order of page_id. There is one row a page, so one task numbers them."""
    return pages.withColumn("page_int_id", (F.row_number().over(Window.orderBy("page_id")) - 1).cast("int"))


def page_table(tiles: DataFrame, left: float, top: float, size: float) -> DataFrame:
    """(page_int_id, page_id, page_row, page_col, box, tile_count): the box is the cell, not the union of tiles."""
    counted = tiles.groupBy("page_id", "page_row", "page_col").agg(F.count("*").alias("tile_count"))
    boxed = counted.withColumns(geo.page_box("page_row", "page_col", left, top, size))
    return page_numbers(boxed).select("page_int_id", "page_id", "page_row", "page_col", "minx", "miny", "maxx", "maxy", "tile_count")


def coarse_vectors(tiles: DataFrame, vector: str = "v") -> DataFrame:
    """(page_id, v): mean of each page's vectors, component by component, scaled to length one.

    Means come from partial sums for each page and component, so a page of any number of tiles moves little data.
    """
    each = tiles.select("page_id", F.posexplode(vector).alias("i", "x")).groupBy("page_id", "i").agg(F.avg("x").alias("m"))
    whole = each.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("v"))
    return whole.select("page_id", vectors.normalize("v").alias("v"))


def build_index(catalog: DataFrame, embeddings: DataFrame, strict: bool = True) -> Index:
    """Tiles (catalogue columns, page_int_id, unit vector v), pages and coarse vectors."""
    k = check_catalog(catalog)
    joined = join_embeddings(catalog, embeddings, strict).withColumn("v", vectors.normalize("embedding")).drop("embedding")
    pages = page_table(joined, k["raster_left"], k["raster_top"], k["page_size_m"])
    tiles = joined.join(pages.select("page_id", "page_int_id"), "page_id")
    return Index(tiles, pages, coarse_vectors(joined))
