"""Edge cases and golden values of the engine's operators."""

import math
import random
import struct
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilequarry.functions import crs, geo, telemetry, vectors
from tilequarry.operators import ablation, cache, catalog, evaluate, index, pooling, retrieval, synthetic
from tilequarry.sources import exif, readers, writers

# X, y, rotation, scale and brightness of the first two published queries.
GOLDEN = (
    (-381858.62278441386, -1195710.0562790472, -13.498240897852845, 0.9723210738148822, 1.0709413642492036),
    (-381687.16468790587, -1192588.075120349, -24.78367004223503, 0.992192181968527, 0.858939165831421),
)
BOX = (-385000.05, -1196000.10, -379999.95, -1191999.90)


def test_normalize_zero_and_unit(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, v array<float>")
    got = {r["id"]: r["n"] for r in df.select("id", vectors.normalize("v").alias("n")).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]


def test_synthetic_stream_is_reproducible(spark):
    rows = synthetic.synthetic_queries(spark, BOX).orderBy("query_index").collect()
    assert len(rows) == 200
    # The first two queries of the published query set.
    first, second = rows[0], rows[1]
    assert (first["gt_x"], first["gt_y"]) == pytest.approx((GOLDEN[0][0], GOLDEN[0][1]), abs=1e-6)
    assert (second["rotation_deg"], second["scale"], second["brightness"]) == pytest.approx(GOLDEN[1][2:], abs=1e-9)


def test_synthetic_guards():
    with pytest.raises(ValueError):
        synthetic.SyntheticConfig(oversample=1.4).check()
    with pytest.raises(ValueError):
        geo.shrink_box((0, 0, 100, 100), 50)
    with pytest.raises(ValueError):
        geo.shrink_box((0, 0, 100), 1)


@pytest.mark.parametrize("size, pages", [(2048.0, 6), (1000.0, 20), (600.0, 63)])
def test_page_counts_of_the_published_grid(spark, size, pages):
    raster = geo.Raster(BOX[0], BOX[3], 0.15, 33334, 26668)
    points = spark.range(63 * 51).select(F.col("id").alias("tile_id"), (F.lit(BOX[0] + 76.9) + (F.col("id") % 63) * 76.8).alias("Easting"), (F.lit(BOX[3] - 76.9) - F.floor(F.col("id") / 63) * 76.8).alias("NORTHING"))
    c = catalog.build_catalog(points, raster, 1024, 512, size, ["tile_id"])
    assert c.count() == 3213 and c.select("page_id").distinct().count() == pages
    assert c.agg(F.max("tile_id"), F.countDistinct("tile_id")).first()[:] == (3212, 3213)


def test_catalog_edges_and_guards(spark):
    raster = geo.Raster(0.0, 0.0, 1.0, 8, 8)
    pts = spark.createDataFrame([(1, 2.0, -2.0), (2, 6.0, -6.0), (3, 6.5, -6.5), (4, 1.5, -2.0), (5, 7.0, -6.0), (6, None, -2.0)], "k long, x double, y double")
    got = catalog.build_catalog(pts, raster, 4, 2, 4.0, ["k"]).orderBy("tile_id").collect()
    assert [(r["tile_id"], r["source_point_id"], r["page_id"]) for r in got] == [(0, 0, "p0000_0000"), (1, 1, "p0001_0001"), (2, 2, "p0001_0001")]
    with pytest.raises(ValueError):
        catalog.build_catalog(pts, raster, 3, 2, 4.0, ["k"])
    with pytest.raises(ValueError):
        catalog.build_catalog(pts.where("k = 5"), raster, 4, 2, 4.0, ["k"])
    with pytest.raises(ValueError, match="k"):
        catalog.find_column(pts.select("k"), catalog.X_NAMES)


def test_index_guards(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, 600.0), (2, 0.0, 0.0, 600.0)], "tile_id long, raster_left double, raster_top double, page_size_m double")
    e = spark.createDataFrame([(1, [1.0]), (3, [1.0])], "tile_id long, embedding array<float>")
    with pytest.raises(ValueError):
        index.join_embeddings(c, e)
    assert index.join_embeddings(c, e.where("tile_id = 1")).count() == 1
    with pytest.raises(ValueError):
        index.check_catalog(c.drop("raster_left"))
    with pytest.raises(ValueError):
        index.check_catalog(c.withColumn("raster_top", F.col("tile_id").cast("double")))


def _world(spark, n=60, pages=5, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    rows = [(i, f"p0000_{i % pages:04d}", (m[i] / np.linalg.norm(m[i])).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "tile_id long, page_id string, v array<double>")


def test_all_pages_equal_exhaustive_search(spark):
    t = _world(spark)
    q = t.where("tile_id % 7 = 0").select(F.col("tile_id").alias("query_id"), "v")
    two = retrieval.search(q, t, index.coarse_vectors(t), 99, 5).orderBy("query_id", "rank").collect()
    flat = retrieval.flat_search(q, t, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["tile_id"]) for r in two] == [(r["query_id"], r["rank"], r["tile_id"]) for r in flat]


def test_blocked_search_equals_joined_search(spark, monkeypatch):
    t = _world(spark)
    q = t.where("tile_id % 7 = 0").select(F.col("tile_id").alias("query_id"), "v")
    want = retrieval.flat_search(q, t, 4).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    got = retrieval.flat_search(q, t, 4).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["tile_id"], round(r["score"], 9)) for r in got] == [(r["query_id"], r["tile_id"], round(r["score"], 9)) for r in want]


def test_multirotation_is_the_best_over_rotations(spark):
    t = _world(spark)
    q = t.where("tile_id % 9 = 0").select(F.col("tile_id").alias("query_id"), "v")
    r = retrieval.rotations(q, [0, 90, 180, 270], 2)
    got = {(x["query_id"], x["tile_id"]): x["score"] for x in retrieval.search_multirotation(r, t, index.coarse_vectors(t), 99, 60).collect()}
    vec = {x["tile_id"]: np.array(x["v"]) for x in t.collect()}
    for (a, b), s in got.items():
        assert s == pytest.approx(max(np.dot(np.roll(vec[a], -2 * k), vec[b]) for k in range(4)))
    with pytest.raises(ValueError):
        retrieval.rotations(q, [45], 2)


def test_small_page_and_local_page(spark):
    t = _world(spark, n=6, pages=3)
    q = t.where("tile_id = 0").select(F.col("tile_id").alias("query_id"), "v")
    c = retrieval.coarse_candidates(q, index.coarse_vectors(t), 1)
    local = spark.createDataFrame([(0, p) for p in ("p0000_0000", "p0000_0001", "p0000_0002")], "query_id long, page_id string")
    added = retrieval.add_local_pages(c, local)
    assert added.count() == 3 and added.where("prank = 1").count() == 1
    assert retrieval.search_pages(q, t, c, 10).count() == 2


def test_point_on_page_edges(spark):
    pages = index.page_numbers(spark.createDataFrame([("p0000_0000", 0, 0, 0.0, -10.0, 10.0, 0.0), ("p0000_0001", 0, 1, 10.0, -10.0, 20.0, 0.0)], "page_id string, page_row int, page_col int, minx double, miny double, maxx double, maxy double"))
    pts = spark.createDataFrame([(1, 10.0, -10.0), (2, 20.0, 0.0), (3, 20.5, -1.0), (4, 12.0, -1.0)], "point_id long, x double, y double")
    got = {r["point_id"]: r["page_id"] for r in retrieval.pages_of_points(pts, pages, 0.0, 0.0, 10.0).collect()}
    assert got == {1: "p0000_0000", 2: "p0000_0001", 3: None, 4: "p0000_0001"}


def test_evaluation_conventions(spark):
    truth = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)], "query_id long, gt_x double, gt_y double")
    cand = spark.createDataFrame([(1, 1, 30.0, 0.0), (2, 1, 100.0, 0.0), (2, 2, 0.0, 30.1), (2, 3, 3.0, 4.0)], "query_id long, rank int, center_x double, center_y double")
    r = evaluate.evaluate_retrieval(truth, cand).first()
    assert r["n"] == 3 and r["recall_at_k"] == pytest.approx({1: 1 / 3, 5: 2 / 3, 10: 2 / 3})
    assert (r["median_error_m"], r["mean_error_m"], r["p90_error_m"]) == pytest.approx((65.0, 65.0, 93.0))
    none = evaluate.evaluate_retrieval(truth.limit(0), cand).first()
    assert none["n"] == 0 and none["recall_at_k"] == {} and math.isnan(none["p90_error_m"])
    top = evaluate.per_query(truth.where("query_id = 3"), spark.createDataFrame([], "query_id long, rank int, tile_id long, score double, page_id string")).first()
    assert top["top1_tile_id"] == -1 and math.isnan(top["top1_score"]) and top["top1_page_id"] == ""


def _lru(pages, capacity):
    held, out = OrderedDict(), []
    for p in pages:
        hit = p in held
        held[p] = None
        held.move_to_end(p)
        gone = []
        while len(held) > capacity:
            g, _ = held.popitem(last=False)
            if g != p:
                gone.append(g)
        out.append((hit, gone, len(held)))
    return out


@pytest.mark.parametrize("capacity", [0, 1, 3, 50])
def test_lru_log_equals_direct_simulation(spark, capacity):
    rng = random.Random(capacity)
    traces = {s: [f"p{rng.randint(0, 6)}" for _ in range(40)] for s in ("a", "b")}
    df = spark.createDataFrame([(s, i, p) for s, t in traces.items() for i, p in enumerate(t)] + [("a", 99, None)], "session string, seq long, page_id string")
    log = cache.simulate(df, capacity).orderBy("session", "event_seq").collect()
    want = []
    for s in sorted(traces):
        for i, (hit, gone, n) in enumerate(_lru(traces[s], capacity)):
            want.append((s, "cache_hit" if hit else "demand_load", i, traces[s][i], n))
            want += [(s, "eviction", i, g, n) for g in gone]
    assert [(r["session"], r["event_type"], r["query_index"], r["page_id"], r["resident_pages_after"]) for r in log] == want


def test_prefetch_outcomes_by_hand(spark):
    rows = [("s", 0, "A", "demand"), ("s", 1, "B", "prefetch"), ("s", 2, "B", "demand"), ("s", 3, "C", "prefetch"), ("s", 4, "D", "prefetch"), ("s", 5, "E", "prefetch"), ("s", 6, "E", "demand")]
    df = spark.createDataFrame(rows, "session string, seq long, page_id string, action string")
    got = {r["page_id"]: r for r in cache.prefetch_outcomes(cache.simulate(df, 2)).collect()}
    assert got["B"]["used_by_future_query"] is True and got["B"]["use_query_index"] == 1
    assert got["C"]["evicted_before_use"] is True and got["C"]["used_by_future_query"] is False
    assert got["D"]["evicted_before_use"] is None and got["E"]["used_by_future_query"] is True


def test_event_log_states_sizes_and_outcomes(spark):
    rows = [("s", 0, "A", "demand", 10.0, 5, "q0", 2.5), ("s", 1, "B", "prefetch", 4.0, 6, None, 1.5), ("s", 2, "B", "demand", 4.0, 7, "q1", 9.0), ("s", 3, "C", "demand", None, 8, "q2", 3.0)]
    df = spark.createDataFrame(rows, "session string, seq long, page_id string, action string, page_bytes double, timestamp_ns long, query_key string, load_ms double")
    log = cache.event_log(df, 2, page_bytes=1.0).orderBy("event_seq")
    assert len(log.columns) == 17 and "source_page_id" in log.columns
    got = [(r["event_type"], r["target_page_id"], r["page_bytes"], r["load_ms"], r["resident_pages_after"], r["resident_bytes_after"], r["timestamp_ns"], r["query_key"]) for r in log.collect()]
    assert got == [
        ("demand_load", "A", 10.0, 2.5, 1, 10.0, 5, "q0"),
        ("prefetch_start", "B", 4.0, 0.0, 1, 10.0, 6, None),
        ("prefetch_complete", "B", 4.0, 1.5, 2, 14.0, 6, None),
        ("cache_hit", "B", 4.0, 0.0, 2, 14.0, 7, "q1"),
        ("demand_load", "C", 1.0, 3.0, 2, 5.0, 8, "q2"),
        ("eviction", "A", 10.0, 0.0, 2, 5.0, 8, "q2"),
    ]
    used = log.where("used_by_future_query is not null").collect()
    assert [(r["event_type"], r["used_by_future_query"], r["prefetch_query_index"], r["use_query_index"]) for r in used] == [("prefetch_complete", True, 0, 1)]
    assert cache.event_log(df.limit(0), 2).count() == 0


def test_radial_bins(spark):
    rows = spark.range(1024).select(pooling.radial_bin("id", 32, 32, 8).alias("b"), "id").groupBy("b").count().orderBy("b").collect()
    assert [r["count"] for r in rows] == [24, 64, 120, 168, 216, 248, 136, 48]
    turned = spark.range(1024).select(pooling.radial_bin("id", 32, 32, 8).alias("a"), pooling.radial_bin(pooling.rot90("id", 32, 1), 32, 32, 8).alias("b"))
    assert turned.where("a <> b").count() == 0
    assert pooling.infer_grid(12, 48, 64, 16) == (3, 4) and pooling.infer_grid(16, 1, 1, 16) == (4, 4)
    with pytest.raises(ValueError):
        pooling.infer_grid(12, 1, 1, 16)
    with pytest.raises(ValueError):
        pooling.check_strategy("none")


def test_radial_pool_fills_empty_rings(spark):
    tokens = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 2.0])], "image_id long, token_idx int, v array<double>")
    got = pooling.radial_pool(tokens, 0, 1, 1, 3, 2).first()["v"]
    assert got == pytest.approx([0.0, 1.0, 0.0, 0.0, 0.0, 0.0])


def test_projection_golden_value(spark):
    # The published worked example of the projection.
    phi, lam = math.radians(50 + 12 / 60 + 32.442 / 3600), math.radians(16 + 50 / 60 + 59.179 / 3600)
    df = spark.createDataFrame([(phi, lam)], "p double, l double")
    for name, expr in crs.project_steps("p", "l", "x", "y"):
        df = df.withColumn(name, F.expr(expr))
    assert df.select("x", "y").first()[:] == pytest.approx((-568991.00, -1050538.63), abs=0.02)


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(49.065, 19.59), (49.2, 19.4), (None, 19.5)], "lat double, lon double")
    out = crs.krovak_to_wgs84(crs.wgs84_to_krovak(df).withColumnsRenamed({"lat": "a", "lon": "b"})).collect()
    for r in out[:2]:
        assert (r["lat"], r["lon"]) == pytest.approx((r["a"], r["b"]), abs=1e-7)
        assert BOX[0] - 30000 < r["x"] < 0 and r["y"] < 0
    assert out[2]["x"] is None


def test_telemetry_line(spark):
    line = "RAM 3021/7620MB CPU [12%@1510,off,30%@1510] GR3D_FREQ 45% GPU@51.5C CPU@50.1C tj@52.0C VDD_IN 6210mW/6100mW"
    r = telemetry.parse(spark.createDataFrame([(line,), ("",)], "raw string")).orderBy(F.desc("raw")).collect()
    assert (r[0]["ram_used_mb"], r[0]["ram_total_mb"], r[0]["cpu_util_pct_mean"], r[0]["gpu_util_pct"], r[0]["gpu_temp_c"], r[0]["soc_temp_c"], r[0]["power_total_mw"]) == (3021, 7620, 21.0, 45, 51.5, 52.0, 6210.0)
    assert r[0]["rails"] == {"vdd_in": 6210.0} and r[0]["temps"]["gpu"] == 51.5
    assert r[1]["ram_used_mb"] is None and r[1]["soc_temp_c"] is None


def test_page_id_and_dms(spark):
    df = spark.createDataFrame([("p0001_0023", 10.0, 30.0, 36.0, "s"), ("p12345_0001", 10.0, 30.0, 36.0, "N"), ("p-001_0002", 0.0, 0.0, 0.0, "E")], "p string, d double, m double, s double, r string")
    row, col = geo.parse_page_id("p")
    got = df.select(row, col, geo.dms_to_degrees("d", "m", "s", "r")).collect()
    assert [tuple(x) for x in got] == [(1, 23, pytest.approx(-10.51)), (None, None, pytest.approx(10.51)), (None, None, 0.0)]


def _jpeg(lat_ref=b"S"):
    def entry(tag, kind, count, value):
        return struct.pack("<HHI", tag, kind, count) + value

    gps_at, data_at = 8 + 2 + 12 + 4, 8 + 2 + 12 + 4 + 2 + 12 * 6 + 4
    lat = struct.pack("<6I", 49, 1, 3, 1, 54, 1)
    lon = struct.pack("<6I", 19, 1, 30, 1, 0, 1)
    gps = struct.pack("<H", 6) + entry(1, 2, 2, lat_ref + b"\0\0\0") + entry(2, 5, 3, struct.pack("<I", data_at)) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, struct.pack("<I", data_at + 24)) + entry(5, 1, 1, b"\1\0\0\0") + entry(6, 5, 1, struct.pack("<I", data_at + 48)) + b"\0\0\0\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + entry(0x8825, 4, 1, struct.pack("<I", gps_at)) + b"\0\0\0\0" + gps + lat + lon + struct.pack("<2I", 25, 2)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_image_positions(spark, tmp_path):
    assert exif.gps_position(_jpeg()) == (pytest.approx(-49.065), 19.5, -12.5)
    assert exif.gps_position(b"no image") is None
    (tmp_path / "a.JPG").write_bytes(_jpeg(b"N"))
    (tmp_path / "b.png").write_bytes(b"none")
    (tmp_path / "c.txt").write_bytes(_jpeg())
    got = readers.read_flight(spark, str(tmp_path / "missing.csv"), str(tmp_path)).collect()
    assert [r["filename"] for r in got] == ["a.JPG"] and got[0]["gt_x"] < 0
    assert readers.list_images(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError):
        readers.read_flight(spark, None)


def test_flight_file_and_npy(spark, tmp_path):
    (tmp_path / "gt.csv").write_text("filename,lat,lon,alt_m,yaw_deg,timestamp_video_s\na.png,49.065,19.59,700,,0\n")
    assert readers.read_flight(spark, str(tmp_path / "gt.csv")).count() == 1
    np.save(tmp_path / "v.npy", np.eye(3))
    np.save(tmp_path / "i.npy", np.arange(3))
    assert readers.read_npy(spark, str(tmp_path / "v.npy"), str(tmp_path / "i.npy")).count() == 3


def test_index_round_trip(spark, tmp_path):
    t = _world(spark, n=12, pages=3).withColumnsRenamed({"v": "embedding"})
    c = t.select("tile_id", "page_id", F.lit(0).alias("page_row"), F.substring("page_id", 7, 4).cast("int").alias("page_col"), F.lit(0.0).alias("raster_left"), F.lit(0.0).alias("raster_top"), F.lit(600.0).alias("page_size_m"))
    writers.write_index(index.build_index(c, t.select("tile_id", "embedding")), str(tmp_path / "ix"))
    got = writers.read_index(spark, str(tmp_path / "ix"))
    assert got.tiles.count() == 12 and got.pages.count() == 3 and got.coarse.count() == 3
    assert writers.page_tiles(got, "p0000_0001").count() == 4
    with pytest.raises(KeyError):
        writers.page_tiles(got, "p0009_0009")


def test_reports(spark, tmp_path):
    table = spark.createDataFrame([("cls", 3, 1.5, float("nan"))], "strategy string, n long, a double, b double")
    assert ablation.markdown(table, {"a": 2, "b": 3}).first()["line"] == "| cls | 1.50 | - |"
    assert ablation.base_strategies(["multirot", "radial", "cls"]) == ["cls", "radial"]
    with pytest.raises(ValueError):
        ablation.check_strategies(["x"])
    assert ablation.settings_hash(a=1) != ablation.settings_hash(a=2)
    truth = spark.createDataFrame([(1, 0.0, 0.0)], "query_id long, gt_x double, gt_y double")
    cand = spark.createDataFrame([(1, 1, 3.0, 4.0)], "query_id long, rank int, center_x double, center_y double")
    text = evaluate.summary(evaluate.evaluate_retrieval(truth, cand), "cls", 30.0, top_pages=3)
    assert text.select(ablation.recall_of("value", 1)).first()[0] == 1.0
    writers.write_lines(text, "value", str(tmp_path / "s"))
    assert readers.read_summary(spark, str(tmp_path / "s")).first()["strategy"] == "cls"
    writers.write_unavailable(spark, str(tmp_path / "u"))


def test_streaming_cache_keeps_state_between_batches(spark, tmp_path):
    from tilequarry.streaming.cache import stream_cache

    schema = "session string, seq long, page_id string"
    pages = ["a", "b", "a", "c", "b", "a", "d", "a"]
    source = tmp_path / "in"
    for k in (0, 4):
        spark.createDataFrame([("s", k + i, p) for i, p in enumerate(pages[k : k + 4])], schema).coalesce(1).write.mode("append").parquet(str(source))
        query = stream_cache(spark.readStream.schema(schema).parquet(str(source)), 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = [(r["event_type"], r["page_id"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("event_seq").collect()]
    want = []
    for (hit, gone, _), p in zip(_lru(pages, 2), pages, strict=True):
        want += [("cache_hit" if hit else "demand_load", p), *(("eviction", g) for g in gone)]
    assert got == want


def test_streaming_prefetch_equals_the_batch(spark, tmp_path):
    from tilequarry.streaming.cache import stream_cache

    schema = "session string, seq long, page_id string"
    rng = random.Random(5)
    trace = spark.createDataFrame([(s, i, f"p{rng.randint(0, 5)}") for s in ("a", "b") for i in range(20)], schema)
    near = spark.createDataFrame([(f"p{i}", f"p{(i + d) % 6}") for i in range(6) for d in (1, 2)], "page_id string, neighbour_id string")
    trace.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = cache.neighbour_prefetches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), near)
    stream_cache(stream, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    order = ["session", "event_seq"]
    want = cache.simulate(cache.neighbour_prefetches(trace, near), 3).orderBy(*order).collect()
    assert want and spark.read.parquet(str(tmp_path / "out")).orderBy(*order).collect() == want


def test_commands(spark, tmp_path):
    from tilequarry.__main__ import main

    at = lambda name: str(tmp_path / name)
    rows = [(i, j, [float(i == k) + 0.1 * j for k in range(3)]) for i in range(3) for j in range(2)]
    spark.createDataFrame(rows, "image_id long, token_idx int, v array<double>").write.parquet(at("tokens"))
    main(["descriptors", "--tokens", at("tokens"), "--out", at("d")])
    made = {r["tile_id"]: r["embedding"] for r in spark.read.parquet(at("d/embeddings")).collect()}
    assert {k: max(range(3), key=v.__getitem__) for k, v in made.items()} == {0: 0, 1: 1, 2: 2}

    spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "query_id long, gt_x double, gt_y double").write.parquet(at("truth"))
    spark.createDataFrame([("cls", 1, 1, 3.0, 4.0), ("cls", 2, 1, 300.0, 400.0)], "strategy string, query_id long, rank int, center_x double, center_y double").write.parquet(at("candidates"))
    main(["ablation", "--truth", at("truth"), "--candidates", at("candidates"), "--out", at("a")])
    row = spark.read.option("header", True).csv(at("a/table")).first()
    assert (row["strategy"], row["n"], float(row["median_error_m"]), float(row["recall_at_1"])) == ("cls", "2", 252.5, 0.5)
    assert [r["value"] for r in spark.read.text(at("a/markdown")).collect()] == ["| cls | 252.500 | 252.500 | 0.5000 | 0.5000 | 0.5000 |"]

    spark.createDataFrame([("RAM 5/9MB GR3D_FREQ 45%",)], "value string").write.text(at("lines"))
    main(["telemetry", "--lines", at("lines"), "--out", at("t"), "--checkpoint", at("c"), "--max-seconds", "2"])
    got = spark.read.option("header", True).csv(at("t")).collect()
    assert [(r["ram_used_mb"], r["gpu_util_pct"]) for r in got] == [("5", "45")]


def test_flight_command(spark, tmp_path):
    from tilequarry.__main__ import main

    at = lambda name: str(tmp_path / name)
    truth = [("a.png", 49.065, 19.590), ("b.png", 49.066, 19.592)]
    (tmp_path / "gt.csv").write_text("filename,lat,lon,alt_m,yaw_deg,timestamp_video_s\n" + "".join(f"{n},{lat},{lon},700,,0\n" for n, lat, lon in truth))
    centres = {r["filename"]: (r["gt_x"], r["gt_y"]) for r in readers.read_flight(spark, at("gt.csv")).collect()}
    points = spark.createDataFrame([(i, *centres[n]) for i, (n, _, _) in enumerate(truth)], "tile_id long, center_x double, center_y double")
    left, top = min(x for x, _ in centres.values()) - 500, max(y for _, y in centres.values()) + 500
    made = catalog.build_catalog(points, geo.Raster(left, top, 0.15, 20000, 20000), 1024, 512, 600.0, ["tile_id"], "x")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "tile_id long, embedding array<float>")
    writers.write_index(index.build_index(made, vectors), at("index"))
    spark.createDataFrame([("a.png", [1.0, 0.1]), ("b.png", [0.1, 1.0])], "filename string, v array<double>").write.parquet(at("frames"))
    main(["flight", "--index", at("index"), "--frames", at("frames"), "--gt-csv", at("gt.csv"), "--out", at("out")])
    rows = spark.read.option("header", True).csv(at("out/per_query")).orderBy("filename").collect()
    assert [(r["filename"], r["top1_tile_id"]) for r in rows] == [("a.png", "0"), ("b.png", "1")]
    summary = readers.read_summary(spark, at("out/summary")).first()
    assert summary["n"] == 2 and summary["median_error_m"] < 1e-6


def test_synthetic_window_covers_every_angle():
    synthetic.SyntheticConfig(rotation_deg=(-90.0, 90.0), oversample=1.5, scale=(1.0, 1.0)).check()
    for bad in ({"rotation_deg": (-90.0, 90.0), "oversample": 1.2}, {"rotation_deg": (100.0, 140.0), "oversample": 1.45}, {"scale": (1.05, 0.8), "oversample": 1.6}):
        with pytest.raises(ValueError):
            synthetic.SyntheticConfig(**bad).check()


def test_telemetry_takes_any_run_of_spaces(spark):
    line = "RAM  3021/7620MB CPU   [12%@1510] GR3D_FREQ  45% VDD_IN   6210mW/6100mW"
    r = telemetry.parse(spark.createDataFrame([(line,)], "raw string")).first()
    assert (r["ram_used_mb"], r["gpu_util_pct"], r["cpu_util_pct_mean"], r["power_total_mw"], r["rails"]) == (3021, 45, 12.0, 6210.0, {"vdd_in": 6210.0})


def test_reuse_distance(spark):
    trace = spark.createDataFrame([("s", i, p) for i, p in enumerate("abcab")] + [("t", 0, "a"), ("t", 1, "a"), ("t", 2, None)], "session string, seq long, page_id string")
    got = {(r["session"], r["seq"]): r["distance"] for r in cache.reuse_distances(trace).collect()}
    assert got == {("s", 0): -1, ("s", 1): -1, ("s", 2): -1, ("s", 3): 2, ("s", 4): 2, ("t", 0): -1, ("t", 1): 0}


def test_too_few_patches_are_an_error(spark):
    tokens = spark.createDataFrame([(1, i, [1.0, 0.0]) for i in range(9)], "image_id long, token_idx int, v array<double>")
    with pytest.raises(Exception, match="fewer than 16 patches"):
        pooling.descriptor(tokens, "radial", 4, (4, 4), 2, 2).collect()


def test_queries_without_candidates_or_embeddings(spark):
    truth = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "query_id long, gt_x double, gt_y double")
    found = spark.createDataFrame([(1, 1, 7, 0.5, "p")], "query_id long, rank int, tile_id long, score double, page_id string")
    got = {r["query_id"]: (r["top1_tile_id"], r["top1_page_id"]) for r in evaluate.per_query(truth, found).collect()}
    assert got == {1: (7, "p"), 2: (-1, "")}
