"""Readers with explicit schemas."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.crs import wgs84_to_krovak
from .exif import gps_position

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """A point grid with any of the accepted column names; numbers are read as text and cast where they are used."""
    return spark.read.option("header", True).csv(path)


def read_catalog(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A tile catalogue; limit keeps the rows of the smallest tile ids."""
    df = spark.read.schema(schemas.CATALOG).option("header", True).csv(path)
    return df.orderBy("tile_id").limit(limit) if limit else df


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QUERIES).option("header", True).csv(path)


def read_npy(spark: SparkSession, vectors: str, ids: str) -> DataFrame:
    """(tile_id, embedding) of a matrix file and an id file aligned with it; an error if their lengths differ.

    A matrix file is one stream without an index of its own, so one task reads a pair of files; a folder of part files
    is read a file a task, paired by sorted name.
    """
    a = spark.read.format("binaryFile").load(vectors).select(F.col("path").alias("p"), F.col("content").alias("v"))
    b = spark.read.format("binaryFile").load(ids).select(F.col("path").alias("p"), F.col("content").alias("i"))
    a, b = ([r["p"] for r in x.select("p").orderBy("p").collect()] for x in (a, b))
    if len(a) != len(b):
        raise ValueError("there are not as many id files as matrix files")
    pairs = spark.createDataFrame(list(zip(a, b, strict=True)), "vp string, ip string")
    left = spark.read.format("binaryFile").load(a).select(F.col("path").alias("vp"), F.col("content").alias("v"))
    right = spark.read.format("binaryFile").load(b).select(F.col("path").alias("ip"), F.col("content").alias("i"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for v, i in zip(pdf["v"], pdf["i"], strict=True):
                m, k = np.load(io.BytesIO(v)).astype(np.float32), np.load(io.BytesIO(i)).astype(np.int64)
                if len(m) != len(k):
                    raise ValueError("ids and vectors differ in length")
                for at in range(0, len(m), 4096):
                    yield pd.DataFrame({"tile_id": k[at : at + 4096], "embedding": list(m[at : at + 4096])})

    return left.join(pairs, "vp").join(right, "ip").select("v", "i").mapInPandas(rows, schemas.EMBEDDINGS)


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of image files in a folder, sorted; the suffix counts in any case."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$")).orderBy("path")


def read_image_positions(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, lat, lon, alt_m) of the images in a folder that carry a position."""
    files = spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(p.rsplit("/", 1)[-1], gps_position(bytes(c))) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame([(n, *g) for n, g in found if g], columns=["filename", "lat", "lon", "alt_m"])

    return files.select("path", "content").mapInPandas(rows, "filename string, lat double, lon double, alt_m double")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_flight(spark: SparkSession, gt_csv: str | None, images: str | None = None) -> DataFrame:
    """(filename, gt_x, gt_y): ground truth of a flight in metres; without the file the positions in the images."""
    if gt_csv and exists(spark, gt_csv):
        rows = spark.read.schema(schemas.FLIGHT).option("header", True).csv(gt_csv).select("filename", "lat", "lon")
    elif images:
        rows = read_image_positions(spark, images).select("filename", "lat", "lon")
    else:
        raise ValueError("no ground truth: neither a file nor images")
    return wgs84_to_krovak(rows, x="gt_x", y="gt_y").select("filename", "gt_x", "gt_y")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def embed(images: DataFrame, embedder, schema: str = schemas.EMBEDDINGS) -> DataFrame:
    """Descriptors by a plugged-in model: embedder maps an iterator of Arrow batches to one of batches of the schema.

    Models, image codecs and raster files are not part of the engine; this is the place where they come in.
    """
    return images.mapInArrow(embedder, schema)
