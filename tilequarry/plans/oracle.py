"""SQL of the registered queries for a second engine to run over the same tables."""

from __future__ import annotations

from ..functions import crs


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda z: z / greatest(sqrt(list_inner_product({v}, {v})), 1e-12))"


def _tiles(size: float = 600.0) -> str:
    return f"""
grid AS (SELECT vec_id AS tile_id, embedding::DOUBLE[] AS e, 76.8::DOUBLE + 76.8::DOUBLE * (vec_id % 25) AS cx, -(76.8::DOUBLE + 76.8::DOUBLE * (vec_id // 25)) AS cy FROM embeddings),
tiles AS (SELECT tile_id, cx, cy, {_unit('e')} AS v, floor(-cy / {size}::DOUBLE)::INTEGER AS page_row, floor(cx / {size}::DOUBLE)::INTEGER AS page_col,
  printf('p%04d_%04d', floor(-cy / {size}::DOUBLE)::INTEGER, floor(cx / {size}::DOUBLE)::INTEGER) AS page_id FROM grid),
queries AS (SELECT tile_id AS query_id, v FROM tiles WHERE tile_id % 10 = 0),
truth AS (SELECT tile_id AS query_id, cx + 20 * ((tile_id // 10) % 3) AS gt_x, cy AS gt_y FROM tiles WHERE tile_id % 10 = 0)"""


COARSE = f"""
parts AS (SELECT page_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM tiles),
means AS (SELECT page_id, i, avg(x) AS m FROM parts GROUP BY ALL),
whole AS (SELECT page_id, list(m ORDER BY i) AS w FROM means GROUP BY page_id),
coarse AS (SELECT page_id, {_unit('w')} AS v FROM whole)"""

PAGES = """
counted AS (SELECT page_id, page_row, page_col, count(*) AS tile_count FROM tiles GROUP BY ALL),
pages AS (SELECT (row_number() OVER (ORDER BY page_id) - 1)::INTEGER AS page_int_id, page_id, page_row, page_col, page_col * 600.0::DOUBLE AS minx, -page_row * 600.0::DOUBLE - 600 AS miny,
  page_col * 600.0::DOUBLE + 600 AS maxx, -page_row * 600.0::DOUBLE AS maxy, tile_count FROM counted)"""


def _cand(pages: int = 3, q: str = "queries", keys: str = "query_id", name: str = "cand") -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT {keys}, page_id, q.v AS q, list_inner_product(q.v, c.v) AS page_score,
  (row_number() OVER (PARTITION BY {keys} ORDER BY list_inner_product(q.v, c.v) DESC, page_id))::INTEGER AS prank FROM {q} q, coarse c) WHERE prank <= {pages})"""


def _hits(k: int = 10, keys: str = "query_id", cand: str = "cand", name: str = "hits") -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT {keys}, tile_id, page_id, prank, score, (row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, prank, tile_id))::INTEGER AS rank
  FROM (SELECT {keys}, t.tile_id, t.page_id, c.prank, list_inner_product(c.q, t.v) AS score FROM {cand} c JOIN tiles t USING (page_id))) WHERE rank <= {k})"""


ROTS = """
rots AS (SELECT query_id, r AS rot, list_concat(v[r * 16 + 1:64], v[1:r * 16]) AS v FROM queries, (SELECT unnest([0, 1, 2, 3])::INTEGER AS r))"""

MULTI = """
best AS (SELECT query_id, tile_id, max(score) AS score, min((rot, rank)) AS first_seen, arg_max((page_id, rot), (score, -rot)) AS won FROM rhits GROUP BY ALL),
merged AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen))::INTEGER AS rank, tile_id, score, won[1] AS page_id, won[2] AS rot FROM best)"""


def _errors(hits: str = "hits", name: str = "errors") -> str:
    return f"""
{name} AS (SELECT q.query_id, min(CASE WHEN sqrt((t.cx - q.gt_x) * (t.cx - q.gt_x) + (t.cy - q.gt_y) * (t.cy - q.gt_y)) <= 30 THEN h.rank END) AS first_hit,
  min(CASE WHEN h.rank = 1 THEN sqrt((t.cx - q.gt_x) * (t.cx - q.gt_x) + (t.cy - q.gt_y) * (t.cy - q.gt_y)) END) AS error_m
  FROM truth q LEFT JOIN {hits} h USING (query_id) LEFT JOIN tiles t ON t.tile_id = h.tile_id GROUP BY q.query_id)"""


def _recalls(n: str = "count(*)") -> str:
    return ", ".join(f"round(sum(CASE WHEN first_hit <= {k} THEN 1 ELSE 0 END)::DOUBLE / {n}, 6) AS recall_at_{k}" for k in (1, 5, 10))


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _list(rel: str, keys: str) -> str:
    return f"SELECT {keys}, (i - 1)::INTEGER AS i, round(x, 6) + 0.0::DOUBLE AS x FROM (SELECT {keys}, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {rel})"


BASE = _tiles()
SEARCH = (BASE, COARSE, _cand(), _hits())
SHOW = "SELECT query_id, rank, tile_id, round(score, 6) + 0.0::DOUBLE AS score, page_id"

WINDOWS = """
pixel AS (SELECT tile_id AS source_point_id, cx, cy, page_id, page_row, page_col, floor(cx / 0.15::DOUBLE)::INTEGER - 512 AS wc, floor(-cy / 0.15::DOUBLE)::INTEGER - 512 AS wr FROM tiles),
inside AS (SELECT *, row_number() OVER (ORDER BY source_point_id) - 1 AS tile_id FROM pixel WHERE wc >= 0 AND wr >= 0 AND wc + 1024 <= 12800 AND wr + 1024 <= 10240)"""

TOKENS = f"""
raw AS (SELECT vec_id // 21 AS image_id, (vec_id % 21)::INTEGER AS token_idx, embedding::DOUBLE[] AS e FROM embeddings),
tokens AS (SELECT image_id, token_idx, {_unit('e')} AS u FROM raw WHERE image_id IN (SELECT image_id FROM raw GROUP BY image_id HAVING count(*) = 21)),
patches AS (SELECT image_id, token_idx - 5 AS patch, u FROM tokens WHERE token_idx >= 5)"""

TRACE = """
trace AS (SELECT user_id::VARCHAR AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, printf('p0000_%04d', (floor(value)::BIGINT % 6)::INTEGER) AS page_id FROM events),
linked AS (SELECT *, lag(seq) OVER (PARTITION BY session, page_id ORDER BY seq) AS before_seq, lead(seq) OVER (PARTITION BY session, page_id ORDER BY seq) AS after_seq FROM trace),
access AS (SELECT a.session, a.seq, a.page_id, a.before_seq IS NOT NULL AND
  (SELECT count(DISTINCT b.page_id) FROM trace b WHERE b.session = a.session AND b.seq > a.before_seq AND b.seq < a.seq) < 3 AS hit,
  (SELECT count(DISTINCT b.page_id) FROM trace b WHERE b.session = a.session AND b.seq <= a.seq) AS so_far FROM linked a),
firsts AS (SELECT a.session, a.seq, a.page_id, a.after_seq, b.page_id AS other, min(b.seq) AS seen_seq FROM linked a JOIN trace b ON b.session = a.session AND b.seq > a.seq AND b.page_id <> a.page_id GROUP BY ALL),
third AS (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY seen_seq) AS nth FROM firsts),
evicted AS (SELECT session, seen_seq AS seq, page_id FROM third WHERE nth = 3 AND (after_seq IS NULL OR after_seq > seen_seq)),
logged AS (SELECT session, seq, 0 AS step, CASE WHEN hit THEN 'cache_hit' ELSE 'demand_load' END AS event_type, page_id FROM access
  UNION ALL SELECT session, seq, 1, 'eviction', page_id FROM evicted),
log AS (SELECT l.session, row_number() OVER (PARTITION BY l.session ORDER BY l.seq, l.step) AS event_seq, l.event_type, l.seq AS query_index, l.page_id,
  least(3, a.so_far)::INTEGER AS resident_pages_after, least(3, a.so_far)::DOUBLE AS resident_bytes_after FROM logged l JOIN access a USING (session, seq))"""

SAMPLES = "SELECT event_id // 10 AS query_index, event_type AS stage, value AS ms FROM events"

LINES = """
lines AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'boot' ELSE printf('RAM %d/7620MB CPU [%d%%@1510,off,%d%%@1510] GR3D_FREQ %d%% GPU@%d.5C CPU@%d.25C tj@%d.0C VDD_IN %dmW/%dmW',
  event_id % 4000, event_id % 100, event_id % 37, event_id % 100, event_id % 37, event_id % 37 + 1, event_id % 37 + 2, event_id % 4000 + 1000, event_id % 4000 + 900) END AS raw FROM events)"""

TELEMETRY = (
    _with(LINES)
    + r"""SELECT event_id, nullif(regexp_extract(raw, 'RAM (\d+)/(\d+)MB', 1), '')::INTEGER AS ram_used_mb, nullif(regexp_extract(raw, 'RAM (\d+)/(\d+)MB', 2), '')::INTEGER AS ram_total_mb,
  nullif(regexp_extract(raw, 'GR3D_FREQ (\d+)%', 1), '')::INTEGER AS gpu_util_pct,
  list_avg(regexp_extract_all(regexp_extract(raw, 'CPU \[([^\]]*)\]', 1), '(\d+)%@', 1)::DOUBLE[]) AS cpu_util_pct_mean,
  nullif(regexp_extract(raw, 'GPU@(-?[0-9.]+)C', 1), '')::DOUBLE AS gpu_temp_c,
  list_max(list_concat(regexp_extract_all(raw, '(?:CPU)@(-?[0-9.]+)C', 1), regexp_extract_all(raw, '(?:tj)@(-?[0-9.]+)C', 1))::DOUBLE[]) AS soc_temp_c,
  nullif(regexp_extract(raw, 'VDD_IN (\d+)mW', 1), '')::DOUBLE AS power_total_mw FROM lines"""
)


def _assign(size: float) -> str:
    return _with(_tiles(size)) + "SELECT page_id, count(*) AS tiles, min(tile_id) AS first_tile FROM tiles GROUP BY page_id"


def _by_pages(n: int, i: int) -> str:
    return ",".join((_cand(n, name=f"cand{i}"), _hits(cand=f"cand{i}", name=f"hits{i}"), _errors(f"hits{i}", f"errors{i}")))


def _means(rel: str) -> str:
    return f"averaged AS (SELECT image_id, i, avg(x) AS m FROM (SELECT image_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM {rel}) GROUP BY ALL), listed AS (SELECT image_id, list(m ORDER BY i) AS w FROM averaged GROUP BY image_id), pooled AS (SELECT image_id, {_unit('w')} AS v FROM listed)"


def _ring(index: str, side: int, bins: int) -> str:
    c = (side - 1) / 2
    far = (2 * c * c) ** 0.5
    return f"least({bins - 1}, floor(sqrt(({index} // {side} - {c}::DOUBLE) * ({index} // {side} - {c}::DOUBLE) + ({index} % {side} - {c}::DOUBLE) * ({index} % {side} - {c}::DOUBLE)) / {far!r}::DOUBLE * {bins}))::INTEGER"


RINGS = f"""
ringed AS (SELECT image_id, {_ring('patch', 4, 3)} AS bin, u FROM patches),
ring_means AS (SELECT image_id, bin, i, avg(x) AS m FROM (SELECT image_id, bin, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM ringed) GROUP BY ALL),
slots AS (SELECT image_id, bin, i FROM (SELECT DISTINCT image_id FROM patches), (SELECT unnest(range(3))::INTEGER AS bin), (SELECT unnest(range(1, 65)) AS i)),
joined AS (SELECT image_id, list(coalesce(m, 0) ORDER BY bin, i) AS w FROM slots LEFT JOIN ring_means USING (image_id, bin, i) GROUP BY image_id),
pooled AS (SELECT image_id, {_unit('w')} AS v FROM joined)"""

DEGREES = "SELECT c_custkey, 48.9::DOUBLE + (c_custkey % 300) * 0.001::DOUBLE AS lat, 19.4::DOUBLE + (c_custkey * 7 % 400) * 0.001::DOUBLE AS lon FROM customer"
METRES = "SELECT c_custkey, -385000::DOUBLE + (c_custkey % 500) * 10::DOUBLE AS x, -1196000::DOUBLE + (c_custkey * 3 % 400) * 10::DOUBLE AS y FROM customer"

ORACLE_SQL: dict[str, str] = {
    "hierarchical_search": _with(*SEARCH) + SHOW + " FROM hits",
    "l2_normalize": _with(BASE) + _list("tiles", "tile_id"),
    "pairwise_inner_product": _with(BASE) + "SELECT a.tile_id AS a_id, b.tile_id AS b_id, round(list_inner_product(a.v, b.v), 6) + 0.0::DOUBLE AS score FROM tiles a, tiles b WHERE a.tile_id % 100 = 0",
    "tile_catalog": _with(BASE, WINDOWS)
    + "SELECT tile_id, source_point_id, wc AS window_col_off, wr AS window_row_off, round(cx, 3) + 0.0::DOUBLE AS center_x, round(cy, 3) + 0.0::DOUBLE AS center_y, round(wc * 0.15::DOUBLE, 3) + 0.0::DOUBLE AS minx, round(-wr * 0.15::DOUBLE - 1024 * 0.15::DOUBLE, 3) + 0.0::DOUBLE AS miny, round(wc * 0.15::DOUBLE + 1024 * 0.15::DOUBLE, 3) + 0.0::DOUBLE AS maxx, round(-wr * 0.15::DOUBLE, 3) + 0.0::DOUBLE AS maxy, round(153.6::DOUBLE, 3) AS tile_m, round(76.8::DOUBLE, 3) AS stride_m, page_id, page_row, page_col FROM inside",
    "page_bbox": _with(BASE, PAGES) + "SELECT page_int_id, page_id, page_row, page_col, " + ", ".join(f"round({c}, 3) + 0.0::DOUBLE AS {c}" for c in ("minx", "miny", "maxx", "maxy")) + ", tile_count FROM pages",
    "page_id_parse": "SELECT vec_id, page_id, nullif(regexp_extract(page_id, '^p(\\d{4})_(\\d{4})$', 1), '')::INTEGER AS page_row, nullif(regexp_extract(page_id, '^p(\\d{4})_(\\d{4})$', 2), '')::INTEGER AS page_col FROM (SELECT vec_id, printf('p%04d_%04d', vec_id - 3, vec_id * 37) AS page_id FROM embeddings)",
    "catalog_embedding_join": _with(BASE, WINDOWS) + "SELECT source_point_id AS tile_id, page_id, round(cx, 3) + 0.0::DOUBLE AS center_x, 64::INTEGER AS dim FROM inside",
    "embedding_coverage_anti": _with(BASE, WINDOWS) + "SELECT vec_id AS tile_id FROM embeddings WHERE vec_id NOT IN (SELECT source_point_id FROM inside)",
    "page_int_lookup": _with(BASE, PAGES) + "SELECT tile_id, page_id, page_int_id FROM tiles JOIN pages USING (page_id)",
    "coarse_descriptors": _with(BASE, COARSE) + _list("coarse", "page_id"),
    "coarse_top_pages": _with(BASE, COARSE, _cand()) + "SELECT query_id, prank, page_id, round(page_score, 6) + 0.0::DOUBLE AS page_score FROM cand",
    "page_top_k": _with(BASE, COARSE, _cand())
    + "SELECT query_id, page_id, rank, tile_id, round(score, 6) + 0.0::DOUBLE AS score FROM (SELECT query_id, page_id, tile_id, score, (row_number() OVER (PARTITION BY query_id, page_id ORDER BY score DESC, tile_id))::INTEGER AS rank FROM (SELECT query_id, page_id, t.tile_id, list_inner_product(c.q, t.v) AS score FROM cand c JOIN tiles t USING (page_id))) WHERE rank <= 5",
    "flat_top_k": _with(BASE)
    + "SELECT query_id, rank, tile_id, round(score, 6) + 0.0::DOUBLE AS score, page_id FROM (SELECT query_id, tile_id, page_id, list_inner_product(q.v, t.v) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(q.v, t.v) DESC, tile_id))::INTEGER AS rank FROM queries q, tiles t) WHERE rank <= 10",
    "search_with_local_page": _with(
        BASE,
        COARSE,
        PAGES,
        _cand(name="first_cand"),
        """local AS (SELECT query_id, arg_min(page_id, page_int_id) AS page_id FROM truth JOIN pages ON minx <= gt_x AND maxx >= gt_x AND miny <= gt_y AND maxy >= gt_y GROUP BY query_id),
cand AS (SELECT query_id, page_id, q, page_score, prank FROM first_cand UNION ALL SELECT l.query_id, l.page_id, q.v, NULL, (4)::INTEGER FROM local l JOIN queries q USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM first_cand f WHERE f.query_id = l.query_id AND f.page_id = l.page_id))""",
        _hits(),
    )
    + SHOW
    + " FROM hits",
    "multirotation_search": _with(BASE, COARSE, ROTS, _cand(3, "rots", "query_id, rot", "rcand"), _hits(10, "query_id, rot", "rcand", "rhits"), MULTI) + SHOW + ", rot FROM merged WHERE rank <= 10",
    "point_in_page": _with(BASE, PAGES, "pts AS (SELECT vec_id AS point_id, ((vec_id * 150) % 2400)::DOUBLE AS x, -((vec_id * 70) % 1800)::DOUBLE AS y FROM embeddings)") + "SELECT point_id, arg_min(page_id, page_int_id) AS page_id FROM pts LEFT JOIN pages ON minx <= x AND maxx >= x AND miny <= y AND maxy >= y GROUP BY point_id",
    "page_neighbours": _with(BASE, PAGES) + "SELECT a.page_id, b.page_id AS neighbour_id FROM pages a JOIN pages b ON abs(a.page_row - b.page_row) <= 1 AND abs(a.page_col - b.page_col) <= 1 AND a.page_id <> b.page_id",
    "recall_at_k": _with(*SEARCH, _errors()) + f"SELECT count(*) AS n, {_recalls()} FROM errors",
    "error_percentiles": _with(*SEARCH, _errors()) + "SELECT count(*) AS n, round(median(error_m), 3) + 0.0::DOUBLE AS median_error_m, round(avg(error_m), 3) + 0.0::DOUBLE AS mean_error_m, round(quantile_cont(error_m, 0.9), 3) + 0.0::DOUBLE AS p90_error_m FROM errors",
    "per_query_top1": _with(*SEARCH) + "SELECT q.query_id, round(gt_x, 3) + 0.0::DOUBLE AS gt_x, round(gt_y, 3) + 0.0::DOUBLE AS gt_y, coalesce(h.tile_id, -1) AS top1_tile_id, coalesce(round(h.score, 6), -2.0::DOUBLE) AS top1_score, coalesce(h.page_id, '') AS top1_page_id FROM truth q LEFT JOIN (SELECT * FROM hits WHERE rank = 1) h USING (query_id)",
    "partition_vs_exhaustive": _with(BASE, COARSE, *(_by_pages(n, i) for i, n in enumerate((1, 3, 5, 1000)))) + " UNION ALL ".join(f"SELECT {n}::INTEGER AS top_pages, count(*) AS n, {_recalls()} FROM errors{i}" for i, n in enumerate((1, 3, 5, 1000))),
    "latency_summary": f"SELECT stage, count(*) AS n, round(avg(ms), 4) + 0.0::DOUBLE AS mean_ms, round(median(ms), 4) + 0.0::DOUBLE AS median_ms, round(quantile_cont(ms, 0.9), 4) + 0.0::DOUBLE AS p90_ms, round(quantile_cont(ms, 0.99), 4) + 0.0::DOUBLE AS p99_ms FROM ({SAMPLES}) GROUP BY stage",
    "stage_pivot_total": f"SELECT *, round(coalesce(click_ms, 0) + coalesce(view_ms, 0) + coalesce(purchase_ms, 0), 4) AS total_ms FROM (SELECT query_index, " + ", ".join(f"round(sum(CASE WHEN stage = '{s}' THEN ms END), 4) AS {s}_ms" for s in ("click", "view", "purchase")) + f" FROM ({SAMPLES}) GROUP BY query_index)",
    "radial_bins": f"SELECT bin, count(*) AS n, min(patch) AS first_patch FROM (SELECT patch, {_ring('patch', 32, 8)} AS bin FROM (SELECT unnest(range(1024)) AS patch)) GROUP BY bin",
    "radial_pool": _with(TOKENS, RINGS) + _list("pooled", "image_id"),
    "mean_patch_pool": _with(TOKENS, _means("patches")) + _list("pooled", "image_id"),
    "cls_descriptor": _with(TOKENS, "pooled AS (SELECT image_id, u AS v FROM tokens WHERE token_idx = 0)") + _list("pooled", "image_id"),
    "reuse_distance": _with(TRACE)
    + "SELECT a.session, a.seq, a.page_id, CASE WHEN a.before_seq IS NULL THEN -1 ELSE (SELECT count(DISTINCT b.page_id) FROM trace b WHERE b.session = a.session AND b.seq > a.before_seq AND b.seq < a.seq) END::BIGINT AS distance FROM linked a",
    "lru_hits": _with(TRACE) + "SELECT session, seq AS query_index, page_id, hit FROM access",
    "cache_events": _with(TRACE) + "SELECT * FROM log",
    "cache_evictions": _with(TRACE) + "SELECT session, seq AS query_index, page_id FROM evicted",
    "cache_peaks": _with(TRACE) + "SELECT session, max(resident_pages_after) AS peak_pages, max(resident_bytes_after) AS peak_bytes FROM log GROUP BY session",
    "streaming_lru": _with(TRACE) + "SELECT * FROM log",
    "wgs84_to_krovak": crs.steps_sql(DEGREES, crs.krovak_steps("lat", "lon", "x", "y"), "c_custkey, round(x, 3) + 0.0::DOUBLE AS x, round(y, 3) + 0.0::DOUBLE AS y"),
    "krovak_to_wgs84": crs.steps_sql(METRES, crs.wgs84_steps("x", "y", "lat", "lon"), "c_custkey, round(lat, 8) + 0.0::DOUBLE AS lat, round(lon, 8) + 0.0::DOUBLE AS lon"),
    "dms_to_degrees": "SELECT c_custkey, round(CASE WHEN c_custkey % 4 IN (1, 3) THEN -1 ELSE 1 END * ((c_custkey % 90) + (c_custkey % 60) / 60::DOUBLE + (c_custkey % 600) / 10::DOUBLE / 3600::DOUBLE), 8) AS degrees, CASE WHEN c_custkey % 2 = 1 THEN -(c_custkey % 90)::DOUBLE ELSE (c_custkey % 90)::DOUBLE END AS alt_m FROM customer",
    "ground_window": _with(BASE, "edges AS (SELECT tile_id, round_even((cx - 122.88::DOUBLE) / 0.15::DOUBLE, 0)::INTEGER AS c0, round_even((-cy - 122.88::DOUBLE) / 0.15::DOUBLE, 0)::INTEGER AS r0, round_even((cx + 122.88::DOUBLE) / 0.15::DOUBLE, 0)::INTEGER AS c1, round_even((-cy + 122.88::DOUBLE) / 0.15::DOUBLE, 0)::INTEGER AS r1 FROM tiles)") + "SELECT tile_id, c0 AS col_off, r0 AS row_off, greatest(1, c1 - c0)::INTEGER AS win_width, greatest(1, r1 - r0)::INTEGER AS win_height FROM edges",
    "telemetry_parse": TELEMETRY,
    "streaming_telemetry": TELEMETRY,
    "ablation_summary": _with(*SEARCH, ROTS, _cand(3, "rots", "query_id, rot", "rcand"), _hits(10, "query_id, rot", "rcand", "rhits"), MULTI, "mhits AS (SELECT * FROM merged WHERE rank <= 10)", _errors(), _errors("mhits", "merrors"))
    + " UNION ALL ".join(f"SELECT '{s}' AS strategy, 'cls' AS base_db, count(*) AS n, round(median(error_m), 3) + 0.0::DOUBLE AS median_error_m, round(avg(error_m), 3) + 0.0::DOUBLE AS mean_error_m, {_recalls()} FROM {e}" for s, e in (("cls", "errors"), ("multirot", "merrors"))),
} | {f"page_assign_{int(s)}": _assign(s) for s in (2048.0, 1000.0, 600.0)}
