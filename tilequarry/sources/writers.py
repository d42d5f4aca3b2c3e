"""Writers: tables as Parquet, reports as CSV, JSON and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.index import Index


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").option("header", True).csv(path)


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    embeddings.select("tile_id", "embedding").write.mode("overwrite").parquet(path)


def write_index(index: Index, path: str) -> None:
    """tiles partitioned by page (a search reads the pages it needs), pages and coarse vectors."""
    index.tiles.repartition("page_id").sortWithinPartitions("page_id", "tile_id").write.mode("overwrite").partitionBy("page_id").parquet(f"{path}/tiles")
    index.pages.write.mode("overwrite").parquet(f"{path}/pages")
    index.coarse.write.mode("overwrite").parquet(f"{path}/coarse")


def read_index(spark: SparkSession, path: str) -> Index:
    """An index that write_index() wrote; an error if it has no pages, or if a page id is none."""
    tiles, pages, coarse = (spark.read.parquet(f"{path}/{t}") for t in ("tiles", "pages", "coarse"))
    first = pages.orderBy("page_int_id").limit(1).collect()
    if not first:
        raise ValueError("the index has no pages")
    if not pages.where(~F.col("page_id").rlike(r"^p\d{4}_\d{4}$")).isEmpty():
        raise ValueError("page ids have the form pRRRR_CCCC")
    return Index(tiles.withColumn("page_id", F.col("page_id").cast("string")), pages, coarse)


def page_tiles(index: Index, page_id: str) -> DataFrame:
    """Tiles of one page; an error for an unknown page."""
    if index.pages.where(F.col("page_id") == page_id).isEmpty():
        raise KeyError(page_id)
    return index.tiles.where(F.col("page_id") == page_id)


def write_json(spark: SparkSession, settings: dict, path: str) -> None:
    """A manifest as one JSON text."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A report of bounded size as one CSV file."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_candidates(ranked: DataFrame, path: str) -> None:
    """All ranked candidates, from which recall at any k can be worked out again."""
    ranked.write.mode("overwrite").parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(column).coalesce(1).write.mode("overwrite").text(path)


def telemetry_rows(parsed: DataFrame) -> DataFrame:
    """The fixed columns of a telemetry file; what is missing is null."""
    return parsed.select(*(F.col(c) if c in parsed.columns else F.lit(None).cast("string" if c == "raw" else "double").alias(c) for c in schemas.TELEMETRY_COLUMNS))


def write_unavailable(spark: SparkSession, path: str) -> None:
    """The empty file of a host without telemetry."""
    spark.createDataFrame([], ", ".join(f"{c} string" for c in schemas.TELEMETRY_COLUMNS)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
