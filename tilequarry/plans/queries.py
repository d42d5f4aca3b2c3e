"""Registered queries of the retrieval engine over the driver's tables.

The tables stand in for a map: vectors are tiles on a grid of 25 columns, every tenth vector is a query, a shift of the
vector by 16 components is a quarter turn, 21 vectors in a row are the tokens of an image, and events are cache accesses
and latency samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import crs, geo, vectors
from ..functions.telemetry import parse
from ..operators import ablation, cache, catalog, evaluate, index, pooling, retrieval, synthetic
from ..sources.readers import table

STEP, PAGE = 76.8, 600.0
RASTER = geo.Raster(left=0.0, top=0.0, gsd=0.15, width=12800, height=10240)
TOP_PAGES, TOP_K, TOLERANCE = 3, 10, 30.0
CAPACITY = 3
BOX = (-385000.05, -1196000.10, -379999.95, -1191999.90)


def _points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    col, row = F.expr("cast(vec_id % 25 as int)"), F.expr("cast(vec_id div 25 as int)")
    return e.select(F.col("vec_id").alias("tile_id"), (F.lit(STEP) + F.lit(STEP) * col).alias("center_x"), (-(F.lit(STEP) + F.lit(STEP) * row)).alias("center_y"), F.col("embedding").alias("v"))


def _tiles(spark: SparkSession, d: str, page: float = PAGE) -> DataFrame:
    p = _points(spark, d).withColumns({"page_row": geo.page_row("center_y", 0.0, page), "page_col": geo.page_col("center_x", 0.0, page)})
    return p.select("tile_id", "center_x", "center_y", "page_row", "page_col", geo.page_id("page_row", "page_col").alias("page_id"), vectors.normalize("v").alias("v"))


def _queries(tiles: DataFrame) -> DataFrame:
    return tiles.where("tile_id % 10 = 0").select(F.col("tile_id").alias("query_id"), "v")


def _truth(tiles: DataFrame) -> DataFrame:
    return tiles.where("tile_id % 10 = 0").select(F.col("tile_id").alias("query_id"), (F.col("center_x") + F.expr("20D * ((tile_id div 10) % 3)")).alias("gt_x"), F.col("center_y").alias("gt_y"))


def _components(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("v").alias("i", "x")).select(*keys, "i", (F.round("x", 6) + F.lit(0.0)).alias("x"))


def _r(c: str, digits: int = 6):
    return (F.round(c, digits) + F.lit(0.0)).alias(c)


def _search(spark: SparkSession, d: str, top_pages: int = TOP_PAGES, top_k: int = TOP_K) -> DataFrame:
    t = _tiles(spark, d)
    return retrieval.search(_queries(t), t, index.coarse_vectors(t), top_pages, top_k)


def _shown(ranked: DataFrame, *more: str) -> DataFrame:
    return ranked.select("query_id", "rank", "tile_id", _r("score"), "page_id", *more)


def hierarchical_search(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_search(spark, d))


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _components(_tiles(spark, d), "tile_id")


def pairwise_inner_product(spark: SparkSession, d: str) -> DataFrame:
    t = _tiles(spark, d).select("tile_id", "v")
    a, b = t.where("tile_id % 100 = 0").select(F.col("tile_id").alias("a_id"), F.col("v").alias("a")), t.select(F.col("tile_id").alias("b_id"), F.col("v").alias("b"))
    return b.join(retrieval.broadcast_if_small(a)).select("a_id", "b_id", vectors.dot("a", "b").alias("score")).select("a_id", "b_id", _r("score"))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    points = _points(spark, d).select("tile_id", "center_x", "center_y")
    return catalog.build_catalog(points, RASTER, 1024, 512, PAGE, ["tile_id"], "grid", check_empty=False)


def tile_catalog(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d)
    return c.select("tile_id", "source_point_id", "window_col_off", "window_row_off", *(_r(x, 3) for x in ("center_x", "center_y", "minx", "miny", "maxx", "maxy", "tile_m", "stride_m")), "page_id", "page_row", "page_col")


def _page_assign(size: float) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _tiles(spark, d, size).groupBy("page_id").agg(F.count("*").alias("tiles"), F.min("tile_id").alias("first_tile"))

    return run


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return index.page_table(_tiles(spark, d), 0.0, 0.0, PAGE)


def page_bbox(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_int_id", "page_id", "page_row", "page_col", *(_r(c, 3) for c in ("minx", "miny", "maxx", "maxy")), "tile_count")


def page_id_parse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", geo.page_id(F.expr("cast(vec_id - 3 as int)"), F.expr("cast(vec_id * 37 as int)")).alias("page_id"))
    row, col = geo.parse_page_id("page_id")
    return e.select("vec_id", "page_id", row.alias("page_row"), col.alias("page_col"))


def catalog_embedding_join(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d).select(F.col("source_point_id").alias("tile_id"), "page_id", "center_x")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("tile_id"), "embedding")
    return index.join_embeddings(c, e, strict=False).select("tile_id", "page_id", _r("center_x", 3), F.size("embedding").alias("dim"))


def embedding_coverage_anti(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark, d).select(F.col("source_point_id").alias("tile_id"))
    return index.unmatched_embeddings(c, table(spark, d, "embeddings").select(F.col("vec_id").alias("tile_id")))


def page_int_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).join(_pages(spark, d).select("page_id", "page_int_id"), "page_id").select("tile_id", "page_id", "page_int_id")


def coarse_descriptors(spark: SparkSession, d: str) -> DataFrame:
    return _components(index.coarse_vectors(_tiles(spark, d)), "page_id")


def coarse_top_pages(spark: SparkSession, d: str) -> DataFrame:
    t = _tiles(spark, d)
    return retrieval.coarse_candidates(_queries(t), index.coarse_vectors(t), TOP_PAGES).select("query_id", "prank", "page_id", _r("page_score"))


def page_top_k(spark: SparkSession, d: str) -> DataFrame:
    t = _tiles(spark, d)
    q = _queries(t)
    c = retrieval.coarse_candidates(q, index.coarse_vectors(t), TOP_PAGES)
    pairs = t.select("page_id", "tile_id", "v").join(retrieval.broadcast_if_small(c.join(q.withColumnRenamed("v", "_q"), "query_id")), "page_id")
    s = pairs.select("query_id", "page_id", "tile_id", vectors.dot("_q", "v").alias("score"))
    w = Window.partitionBy("query_id", "page_id").orderBy(F.desc("score"), "tile_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "page_id", "rank", "tile_id", _r("score"))


def flat_top_k(spark: SparkSession, d: str) -> DataFrame:
    t = _tiles(spark, d)
    return _shown(retrieval.flat_search(_queries(t), t, TOP_K))


def search_with_local_page(spark: SparkSession, d: str) -> DataFrame:
    t = _tiles(spark, d)
    at = _truth(t).select(F.col("query_id").alias("point_id"), F.col("gt_x").alias("x"), F.col("gt_y").alias("y"))
    local = retrieval.pages_of_points(at, index.page_table(t, 0.0, 0.0, PAGE), 0.0, 0.0, PAGE).where("page_id is not null").select(F.col("point_id").alias("query_id"), "page_id")
    return _shown(retrieval.search(_queries(t), t, index.coarse_vectors(t), TOP_PAGES, TOP_K, local))


def multirotation_search(spark: SparkSession, d: str) -> DataFrame:
    t = _tiles(spark, d)
    q = retrieval.rotations(_queries(t), [0, 90, 180, 270], 16)
    return _shown(retrieval.search_multirotation(q, t, index.coarse_vectors(t), TOP_PAGES, TOP_K), "rot")


def point_in_page(spark: SparkSession, d: str) -> DataFrame:
    pts = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.expr("cast((vec_id * 150) % 2400 as double)").alias("x"), F.expr("-cast((vec_id * 70) % 1800 as double)").alias("y"))
    return retrieval.pages_of_points(pts, _pages(spark, d), 0.0, 0.0, PAGE).select("point_id", "page_id")


def page_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.neighbour_pages(_pages(spark, d))


def _located(spark: SparkSession, d: str, top_pages: int = TOP_PAGES) -> tuple[DataFrame, DataFrame]:
    t = _tiles(spark, d)
    return _truth(t), evaluate.located(_search(spark, d, top_pages), t)


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.evaluate_retrieval(*_located(spark, d), tolerance_m=TOLERANCE)
    return r.select("n", *(F.round(F.col("recall_at_k")[k], 6).alias(f"recall_at_{k}") for k in evaluate.K_VALUES))


def error_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluate_retrieval(*_located(spark, d), tolerance_m=TOLERANCE).select("n", *(_r(c, 3) for c in ("median_error_m", "mean_error_m", "p90_error_m")))


def per_query_top1(spark: SparkSession, d: str) -> DataFrame:
    t = _tiles(spark, d)
    return evaluate.per_query(_truth(t), _search(spark, d)).select("query_id", _r("gt_x", 3), _r("gt_y", 3), "top1_tile_id", F.when(F.isnan("top1_score"), F.lit(-2.0)).otherwise(F.round("top1_score", 6)).alias("top1_score"), "top1_page_id")


def partition_vs_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    t, depths = _tiles(spark, d), [1, 3, 5, 1000]
    found = evaluate.located(retrieval.search_depths(_queries(t), t, index.coarse_vectors(t), depths, TOP_K), t, ("top_pages",))
    truth = _truth(t).withColumn("top_pages", F.explode(F.array(*(F.lit(n) for n in depths))))
    r = evaluate.evaluate_retrieval(truth, found, tolerance_m=TOLERANCE, by=("top_pages",))
    return r.select("top_pages", "n", *(F.round(F.col("recall_at_k")[k], 6).alias(f"recall_at_{k}") for k in evaluate.K_VALUES))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.expr("event_id div 10").alias("query_index"), F.col("event_type").alias("stage"), F.col("value").alias("ms"))


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latency_summary(_samples(spark, d)).select("stage", "n", *(_r(c, 4) for c in ("mean_ms", "median_ms", "p90_ms", "p99_ms")))


STAGES = ["click", "view", "purchase"]


def stage_pivot_total(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.stage_columns(_samples(spark, d), STAGES)


GRID, BINS, REGISTERS, DIM = (4, 4), 3, 4, 64


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 21").alias("image_id"), F.expr("cast(vec_id % 21 as int)").alias("token_idx"), F.col("embedding").alias("v"))
    full = e.groupBy("image_id").agg(F.count("*").alias("c")).where("c = 21").select("image_id")
    return e.join(full, "image_id")


def radial_bins(spark: SparkSession, d: str) -> DataFrame:
    p = spark.range(1024).select(F.col("id").alias("patch"), pooling.radial_bin("id", 32, 32, 8).alias("bin"))
    return p.groupBy("bin").agg(F.count("*").alias("n"), F.min("patch").alias("first_patch"))


def radial_pool(spark: SparkSession, d: str) -> DataFrame:
    return _components(pooling.descriptor(_tokens(spark, d), "radial", REGISTERS, GRID, BINS, DIM), "image_id")


def mean_patch_pool(spark: SparkSession, d: str) -> DataFrame:
    return _components(pooling.descriptor(_tokens(spark, d), "mean_patch", REGISTERS), "image_id")


def cls_descriptor(spark: SparkSession, d: str) -> DataFrame:
    return _components(pooling.descriptor(_tokens(spark, d), "cls"), "image_id")


def _trace(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").cast("string").alias("session"), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.format_string("p0000_%04d", F.expr("cast(floor(value) % 6 as int)")).alias("page_id"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return cache.simulate(_trace(spark, d), CAPACITY)


def reuse_distance(spark: SparkSession, d: str) -> DataFrame:
    return cache.reuse_distances(_trace(spark, d))


def lru_hits(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).where("event_type <> 'eviction'")
    return log.select("session", "query_index", "page_id", (F.col("event_type") == "cache_hit").alias("hit"))


def cache_events(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("session", "event_seq", "event_type", "query_index", "page_id", "resident_pages_after", "resident_bytes_after")


def cache_evictions(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).where("event_type = 'eviction'").select("session", "query_index", "page_id")


def cache_peaks(spark: SparkSession, d: str) -> DataFrame:
    return cache.peaks(_log(spark, d)).groupBy("session").agg(F.max("peak_pages").alias("peak_pages"), F.max("peak_bytes").alias("peak_bytes"))


def prefetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    near = spark.range(6).select(F.format_string("p0000_%04d", F.col("id").cast("int")).alias("page_id"), F.format_string("p0000_%04d", ((F.col("id") + 1) % 6).cast("int")).alias("neighbour_id"))
    return cache.prefetch_outcomes(cache.simulate(cache.neighbour_prefetches(_trace(spark, d), near), CAPACITY))


def _degrees(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.expr("48.9D + (c_custkey % 300) * 0.001D").alias("lat"), F.expr("19.4D + (c_custkey * 7 % 400) * 0.001D").alias("lon"))


def wgs84_to_krovak(spark: SparkSession, d: str) -> DataFrame:
    return crs.wgs84_to_krovak(_degrees(spark, d)).select("c_custkey", _r("x", 3), _r("y", 3))


def krovak_to_wgs84(spark: SparkSession, d: str) -> DataFrame:
    pts = table(spark, d, "customer").select("c_custkey", F.expr("-385000D + (c_custkey % 500) * 10D").alias("x"), F.expr("-1196000D + (c_custkey * 3 % 400) * 10D").alias("y"))
    return crs.krovak_to_wgs84(pts).select("c_custkey", _r("lat", 8), _r("lon", 8))


def dms_to_degrees(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.expr("cast(c_custkey % 90 as double)").alias("dd"), F.expr("cast(c_custkey % 60 as double)").alias("mm"), F.expr("(c_custkey % 600) / 10D").alias("ss"), F.expr("case c_custkey % 4 when 0 then 'N' when 1 then 'S' when 2 then 'E' else 'W' end").alias("ref"), F.expr("cast(c_custkey % 2 as int)").alias("alt_ref"))
    return c.select("c_custkey", F.round(geo.dms_to_degrees("dd", "mm", "ss", "ref"), 8).alias("degrees"), geo.altitude("dd", "alt_ref").alias("alt_m"))


def synthetic_params(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.synthetic_queries(spark, BOX)


def ground_window(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("tile_id", *(c.alias(n) for n, c in geo.ground_window("center_x", "center_y", 245.76, RASTER).items()))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id", "cast(event_id % 4000 as int) as a", "cast(event_id % 100 as int) as b", "cast(event_id % 37 as int) as t")
    line = F.format_string("RAM %d/7620MB CPU [%d%%@1510,off,%d%%@1510] GR3D_FREQ %d%% GPU@%d.5C CPU@%d.25C tj@%d.0C VDD_IN %dmW/%dmW", "a", "b", "t", "b", "t", F.col("t") + 1, F.col("t") + 2, F.col("a") + 1000, F.col("a") + 900)
    return e.select("event_id", F.when(F.col("event_id") % 11 == 0, F.lit("boot")).otherwise(line).alias("raw"))


def telemetry_parse(spark: SparkSession, d: str) -> DataFrame:
    return parse(_lines(spark, d)).select("event_id", "ram_used_mb", "ram_total_mb", "gpu_util_pct", "cpu_util_pct_mean", "gpu_temp_c", "soc_temp_c", "power_total_mw")


def ablation_summary(spark: SparkSession, d: str) -> DataFrame:
    t = _tiles(spark, d)
    truth = _truth(t)
    coarse = index.coarse_vectors(t)
    single = evaluate.located(retrieval.search(_queries(t), t, coarse, TOP_PAGES, TOP_K), t).withColumn("strategy", F.lit("cls"))
    turned = evaluate.located(retrieval.search_multirotation(retrieval.rotations(_queries(t), [0, 90, 180, 270], 16), t, coarse, TOP_PAGES, TOP_K), t).withColumn("strategy", F.lit("multirot"))
    cols = ["strategy", "query_id", "rank", "center_x", "center_y"]
    out = ablation.ablation_table(truth, single.select(*cols).unionByName(turned.select(*cols)), TOLERANCE)
    return out.select("strategy", "base_db", "n", _r("median_error_m", 3), _r("mean_error_m", 3), *(_r(f"recall_at_{k}") for k in evaluate.K_VALUES))


def _streamed(spark: SparkSession, source: DataFrame, build, name: str) -> DataFrame:
    """Run a streaming plan over a table's rows once and return what it appended, from files both can reach."""
    import uuid

    from ..operators.numbering import checkpointed, shared_folder

    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    checkpointed(source).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{base}/in")
    query = build(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(build(source.limit(0) if name == "telemetry" else stream).schema).parquet(f"{base}/out")


def streaming_lru(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.cache import stream_cache

    log = _streamed(spark, _trace(spark, d), lambda s: stream_cache(s, CAPACITY), "lru")
    return log.select("session", "event_seq", "event_type", "query_index", "page_id", "resident_pages_after", "resident_bytes_after")


def streaming_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, _lines(spark, d), lambda s: parse(s).select("event_id", "ram_used_mb", "ram_total_mb", "gpu_util_pct", "cpu_util_pct_mean", "gpu_temp_c", "soc_temp_c", "power_total_mw"), "telemetry")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        hierarchical_search, l2_normalize, pairwise_inner_product, tile_catalog, page_bbox, page_id_parse, catalog_embedding_join, embedding_coverage_anti, page_int_lookup,
        coarse_descriptors, coarse_top_pages, page_top_k, flat_top_k, search_with_local_page, multirotation_search, point_in_page, page_neighbours, recall_at_k, error_percentiles,
        per_query_top1, partition_vs_exhaustive, latency_summary, stage_pivot_total, radial_bins, radial_pool, mean_patch_pool, cls_descriptor, reuse_distance, lru_hits, cache_events,
        cache_evictions, cache_peaks, prefetch_outcomes, wgs84_to_krovak, krovak_to_wgs84, dms_to_degrees, synthetic_params, ground_window, telemetry_parse, ablation_summary,
        streaming_lru, streaming_telemetry,
    )
} | {f"page_assign_{int(s)}": _page_assign(s) for s in (2048.0, 1000.0, 600.0)}
