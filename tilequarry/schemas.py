"""Explicit schemas of the tables that the engine reads and writes."""

POINT_GRID = "center_x double, center_y double, tile_id long"
CATALOG = (
    "tile_id long, source_point_id long, config_name string, tile_px int, stride_px int, gsd_m double, tile_m double, stride_m double, center_x double, center_y double, "
    "window_col_off int, window_row_off int, window_width int, window_height int, minx double, miny double, maxx double, maxy double, page_id string, page_row int, page_col int, "
    "raster_left double, raster_top double, page_size_m double"
)
EMBEDDINGS = "tile_id long, embedding array<float>"
QUERIES = "frame_path string, gt_x double, gt_y double, rotation_deg double, scale double, brightness double"
FLIGHT = "filename string, lat double, lon double, alt_m double, yaw_deg double, timestamp_video_s double"
TELEMETRY_COLUMNS = ("ts", "ts_epoch", "ram_used_mb", "ram_total_mb", "gpu_util_pct", "cpu_util_pct_mean", "gpu_temp_c", "soc_temp_c", "power_total_mw", "raw")
