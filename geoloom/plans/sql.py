"""SQL of the registered queries, written on its own terms: crossings of edges instead of scanlines, ranges instead of cells."""

DIM = "dim AS (SELECT (256 * greatest(1, ceil(sqrt(count(*) / 1500.0::DOUBLE))))::BIGINT AS n FROM customer)"
N = "(SELECT n FROM dim)"
GFC = f"""{DIM}, gfc AS (SELECT g.prow, g.pcol, coalesce(v.value, 0)::INTEGER AS value FROM
  (SELECT (i // n)::INTEGER AS prow, (i % n)::INTEGER AS pcol FROM (SELECT n, unnest(range(n * n)) AS i FROM dim)) g LEFT JOIN
  (SELECT (l_orderkey % n)::INTEGER AS prow, (l_partkey % n)::INTEGER AS pcol, max(CASE WHEN l_quantity < 25 THEN 0 ELSE year(l_shipdate) - 1990 END) AS value FROM lineitem, dim GROUP BY 1, 2) v
  ON g.prow = v.prow AND g.pcol = v.pcol)"""


def _edges(base_x: str, base_y: str, w: str, h: str, corners: list[tuple[float, float]]) -> str:
    at = [f"{base_x} + {w} * {a}::DOUBLE, {base_y} + {h} * {b}::DOUBLE" for a, b in corners]
    names = ("xa", "ya", "xb", "yb")
    return ", ".join("{" + ", ".join(f"'{n}': {v}" for n, v in zip(names, [x.strip() for x in f"{p}, {q}".split(",")], strict=True)) + "}" for p, q in zip(at, at[1:] + at[:1], strict=True))


_PLACED = "placed AS (SELECT c_custkey AS k, (c_custkey * 37) % (n - 20) - 3.7::DOUBLE AS x, (c_custkey * 91) % (n - 14) - 2.3::DOUBLE AS y, (6 + c_custkey % 17)::DOUBLE AS w, (5 + c_custkey % 13)::DOUBLE AS h FROM customer, dim)"
SEGMENTS = f"""{_PLACED}, segments AS (SELECT zone_id, e.xa, e.ya, e.xb, e.yb FROM (
  SELECT k AS zone_id, unnest([{_edges('x', 'y', 'w', 'h', [(0, 0), (1, 0.31), (0.83, 1), (0.27, 0.77)])}]) AS e FROM placed UNION ALL
  SELECT k, unnest([{_edges('x', 'y', 'w', 'h', [(0.41, 0.37), (0.63, 0.43), (0.47, 0.61)])}]) FROM placed WHERE k % 3 = 0 UNION ALL
  SELECT k, unnest([{_edges('(x + w)', 'y', '1.0', '1.0', [(1.13, 0.2), (3.37, 1.43), (1.61, 2.9)])}]) FROM placed WHERE k % 4 = 1))"""
ZONES = f"""{SEGMENTS}, zones AS (SELECT zone_id, zone_id AS ord, min(least(xa, xb)) AS xmin, min(least(ya, yb)) AS ymin, max(greatest(xa, xb)) AS xmax, max(greatest(ya, yb)) AS ymax,
  CASE zone_id % 5 WHEN 1 THEN 5 WHEN 2 THEN 100 WHEN 3 THEN 106 WHEN 4 THEN 50 END AS ys, CASE zone_id % 5 WHEN 1 THEN 8 WHEN 2 THEN 100 WHEN 3 THEN 110 WHEN 4 THEN 150 END AS ye FROM segments GROUP BY 1)"""
WINDOWS = f"""windows AS (SELECT zone_id, least(floor(greatest(xmin, 0)), n - 1)::INTEGER AS col_off, least(floor(greatest(ymin, 0)), n - 1)::INTEGER AS row_off,
  least(greatest(ceil(least(xmax, n) - greatest(xmin, 0)), 1), n - least(floor(greatest(xmin, 0)), n - 1))::INTEGER AS win_cols, least(greatest(ceil(least(ymax, n) - greatest(ymin, 0)), 1), n - least(floor(greatest(ymin, 0)), n - 1))::INTEGER AS win_rows FROM zones, dim)"""
#: Pixels whose centres have an odd number of edges to their left; n pixels a side.
ZONED = f"""{GFC}, {ZONES}, spots AS (SELECT zone_id, prow, unnest(range(greatest(floor(xmin), 0)::BIGINT, least(ceil(xmax), n)::BIGINT)) AS pcol FROM (SELECT zone_id, xmin, xmax, n, unnest(range(greatest(floor(ymin), 0)::BIGINT, least(ceil(ymax), n)::BIGINT)) AS prow FROM zones, dim)),
  inside AS (SELECT p.zone_id, p.prow, p.pcol FROM spots p JOIN segments s ON s.zone_id = p.zone_id AND (s.ya <= p.prow + 0.5) <> (s.yb <= p.prow + 0.5) AND s.xa + (p.prow + 0.5 - s.ya) * (s.xb - s.xa) / (s.yb - s.ya) < p.pcol + 0.5 GROUP BY ALL HAVING count(*) % 2 = 1),
  zoned AS (SELECT z.*, g.prow, g.pcol, g.value FROM inside i JOIN zones z USING (zone_id) JOIN gfc g ON g.prow = i.prow AND g.pcol = i.pcol)"""
#: Of these, what a window that is cut at its rounded size holds.
CUT = f"{ZONED}, {WINDOWS}, cut AS (SELECT z.* FROM zoned z JOIN windows w USING (zone_id) WHERE pcol < col_off + win_cols AND prow < row_off + win_rows)"


def _modes(base: str, rows: str) -> str:
    return f"{base}, modes AS (SELECT zone_id, value AS mode FROM (SELECT zone_id, value, row_number() OVER (PARTITION BY zone_id ORDER BY count(*) DESC, value) AS k FROM {rows} WHERE value <> 0 GROUP BY 1, 2) WHERE k = 1)"


MODES = _modes(ZONED, "zoned")
V2 = f"""{_modes(CUT, 'cut')}, v2 AS (SELECT zone_id, ord, prow, pcol, CASE WHEN zone_id % 5 IN (2, 3) AND value > 0 THEN value + 100 ELSE value END::INTEGER AS value FROM cut LEFT JOIN modes USING (zone_id)
  WHERE CASE zone_id % 5 WHEN 0 THEN mode IS NOT NULL AND value IN (mode, 0) WHEN 1 THEN value BETWEEN 5 AND 8 OR value = 0 WHEN 2 THEN value BETWEEN 0 AND 24 WHEN 3 THEN value BETWEEN 6 AND 10 OR value = 0 ELSE false END)"""
V1 = "CASE WHEN ys IS NULL THEN CASE WHEN value = mode THEN value ELSE 0 END WHEN value BETWEEN ys AND ye THEN value ELSE 0 END"
TOP = f"{V2}, top AS (SELECT prow, pcol, arg_max(value, ord) AS value FROM v2 GROUP BY 1, 2)"
TILES = f"tiles AS (SELECT n_name AS location, (n_nationkey % 5) * (n / 5.0::DOUBLE) AS xmin, (n_nationkey // 5) * (n / 5.0::DOUBLE) AS ymin, (n_nationkey % 5) * (n / 5.0::DOUBLE) + n / 5.0::DOUBLE AS xmax, (n_nationkey // 5) * (n / 5.0::DOUBLE) + n / 5.0::DOUBLE AS ymax FROM nation, dim)"
IN_TILE = "pcol + 0.5 >= t.xmin AND pcol + 0.5 < t.xmax AND prow + 0.5 >= t.ymin AND prow + 0.5 < t.ymax"
BOXES_MEET = "z.xmax >= t.xmin AND z.xmin <= t.xmax AND z.ymax >= t.ymin AND z.ymin <= t.ymax"
LINEAR = "ls AS (SELECT (floor(sqrt(max(o_orderkey))) + 1)::BIGINT AS n FROM orders)"
LINES = f"{LINEAR}, lin AS (SELECT (o_orderkey % n)::INTEGER AS prow, ((o_orderkey // n) % n)::INTEGER AS pcol, floor(o_totalprice / 5000)::INTEGER AS value FROM orders, ls)"
DEM = "dem AS (SELECT vec_id::INTEGER AS prow, (k - 1)::INTEGER AS pcol, round(embedding[k]::DOUBLE * 1000, 3) AS value FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS k FROM embeddings))"
PLACES = """places AS (SELECT c_custkey AS id, (c_custkey * 53) % 360 - 180.0::DOUBLE AS lon, (c_custkey * 29) % 160 - 80.0::DOUBLE AS lat FROM customer)"""
KEY = "printf('%02d%s_%03d%s', abs({a}), CASE WHEN {a} >= 0 THEN 'N' ELSE 'S' END, abs({o}), CASE WHEN {o} >= 0 THEN 'E' ELSE 'W' END)"
THERE = f"there AS (SELECT DISTINCT {KEY.format(a='(ceil(lat / 10) * 10)::INTEGER', o='(floor(lon / 10) * 10)::INTEGER')} AS tile FROM places)"
#: A listing's lines hold folder/name; names come in several folders.
PATHS = "paths AS (SELECT page_id, 'S' || page_id % 9 || '/' || string_split(url, '/')[-1] || page_id % 50 || '_CHM.tif' AS path FROM pages)"
STEPS = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(a, b)"


def _slope(dem: str, name: str) -> str:
    """Horn's slope with linear extrapolation, from a grid padded by joins."""
    joins = " ".join(f"LEFT JOIN {dem} n{k} ON n{k}.prow = p.prow + ({k // 3 - 1}) AND n{k}.pcol = p.pcol + ({k % 3 - 1})" for k in range(9))
    raw = ", ".join(f"n{k}.value AS r{k}" for k in range(9))
    rows = ", ".join([*(f"coalesce(r{k}, 2 * r{k + 3} - r{k + 6}, r{k + 3}) AS u{k}" for k in range(3)), *(f"r{k} AS u{k}" for k in range(3, 6)), *(f"coalesce(r{k}, 2 * r{k - 3} - r{k - 6}, r{k - 3}) AS u{k}" for k in range(6, 9))])
    full = ", ".join(
        x for a in (0, 3, 6) for x in (f"coalesce(u{a}, 2 * u{a + 1} - u{a + 2}, u{a + 1}) AS w{a}", f"u{a + 1} AS w{a + 1}", f"coalesce(u{a + 2}, 2 * u{a + 1} - u{a}, u{a + 1}) AS w{a + 2}")
    )
    return f"""{name}_raw AS (SELECT p.prow, p.pcol, {raw} FROM {dem} p {joins}), {name}_rows AS (SELECT prow, pcol, {rows} FROM {name}_raw), {name}_full AS (SELECT prow, pcol, {full} FROM {name}_rows),
{name} AS (SELECT prow, pcol, degrees(atan(sqrt(power((w0 + 2 * w3 + w6) - (w2 + 2 * w5 + w8), 2) + power((w6 + 2 * w7 + w8) - (w0 + 2 * w1 + w2), 2)) / 8)) AS value FROM {name}_full)"""


def _interior(least: int) -> str:
    """The background that a flood from the raster's edge doesn't reach, by pieces of at least so many cells."""
    return f"""WITH RECURSIVE {LINES}, free AS (SELECT g.prow, g.pcol FROM (SELECT (i // n)::INTEGER AS prow, (i % n)::INTEGER AS pcol FROM (SELECT n, unnest(range(n * n)) AS i FROM ls)) g ANTI JOIN (SELECT * FROM lin WHERE value > 30) l USING (prow, pcol)),
    outside AS (SELECT prow, pcol FROM free, ls WHERE prow IN (0, n - 1) OR pcol IN (0, n - 1) UNION SELECT f.prow, f.pcol FROM (SELECT o.prow + d.a AS prow, o.pcol + d.b AS pcol FROM outside o, {STEPS}) s JOIN free f USING (prow, pcol)),
    inner_ AS (SELECT * FROM free ANTI JOIN outside USING (prow, pcol)),
    reach AS (SELECT prow, pcol, prow AS r, pcol AS c FROM inner_ UNION SELECT s.prow, s.pcol, b.prow, b.pcol FROM (SELECT x.prow, x.pcol, x.r + d.a AS r, x.c + d.b AS c FROM reach x, {STEPS}) s JOIN inner_ b ON b.prow = s.r AND b.pcol = s.c)
    SELECT prow, pcol FROM reach GROUP BY 1, 2 HAVING count(*) >= {least}"""


#: Part of a segment within a tile's closed box: it is cut by the four sides (Liang and Barsky, 1984).
_CLIP = " AND ".join(f"NOT ({d} = 0 AND {q} < 0)" for d, q in (("dx", "xa - t.xmin"), ("dx", "t.xmax - xa"), ("dy", "ya - t.ymin"), ("dy", "t.ymax - ya")))
_IN = ", ".join(f"CASE WHEN {d} {s} 0 THEN {q} / {d} ELSE {e} END" for d, s, q, e in (("dx", ">", "(t.xmin - xa)", 0), ("dx", "<", "(t.xmax - xa)", 0), ("dy", ">", "(t.ymin - ya)", 0), ("dy", "<", "(t.ymax - ya)", 0)))
_OUT = ", ".join(f"CASE WHEN {d} {s} 0 THEN {q} / {d} ELSE {e} END" for d, s, q, e in (("dx", ">", "(t.xmax - xa)", 1), ("dx", "<", "(t.xmin - xa)", 1), ("dy", ">", "(t.ymax - ya)", 1), ("dy", "<", "(t.ymin - ya)", 1)))
SEGMENT_IN_TILE = f"{_CLIP} AND greatest(0, {_IN}) <= least(1, {_OUT})"

ORACLES = {
    "listing_paths": f"WITH {PATHS} SELECT path FROM paths",
    "dtm_rewrite": f"WITH {PATHS} SELECT path, regexp_replace(path, '_CHM.*$', '') || '_DTM.tif' AS dtm, regexp_extract(path, '([^/]*)_CHM', 1) AS survey, regexp_replace(string_split(path, '/')[-1], '\\.[^./]*$', '') AS stem FROM paths",
    "copy_manifest": f"WITH {PATHS} SELECT '/in/' || arg_max(path, page_id) AS src, '/out/' || string_split(path, '/')[-1] AS dst FROM paths GROUP BY string_split(path, '/')[-1]",
    "tile_keys": f"""WITH {PLACES}, b AS (SELECT id, (ceil(lat / 10) * 10)::INTEGER AS a, (floor(lon / 10) * 10)::INTEGER AS o FROM places)
        SELECT id, {KEY.format(a="a", o="o")} AS tile, CASE WHEN a >= 0 THEN 'N' ELSE 'S' END || CASE WHEN o >= 0 THEN 'E' ELSE 'W' END AS quadrant FROM b""",
    "tiles_for_extent": f"""WITH {PLACES}, {THERE}, a AS (SELECT i * 10 AS a FROM range(-9, 12) t(i)), o AS (SELECT i * 10 AS o FROM range(-18, 21) t(i)),
        k AS (SELECT id, {KEY.format(a="a.a", o="o.o")} AS tile FROM places p, a, o WHERE a.a BETWEEN ceil(lat / 10) * 10 AND ceil((lat + 15) / 10) * 10 AND o.o BETWEEN floor(lon / 10) * 10 AND floor((lon + 15) / 10) * 10)
        SELECT id, tile FROM k SEMI JOIN there USING (tile)""",
    "tiles_missing": f"""WITH {PLACES}, {THERE}, a AS (SELECT i * 10 AS a FROM range(-9, 12) t(i)), o AS (SELECT i * 10 AS o FROM range(-18, 21) t(i)),
        k AS (SELECT DISTINCT {KEY.format(a="a.a", o="o.o")} AS tile FROM places p, a, o WHERE a.a BETWEEN ceil(lat / 10) * 10 AND ceil((lat + 15) / 10) * 10 AND o.o BETWEEN floor(lon / 10) * 10 AND floor((lon + 15) / 10) * 10)
        SELECT tile FROM k ANTI JOIN there USING (tile)""",
    "hemisphere_tiles": f"""WITH {PLACES}, {THERE} SELECT tile FROM there WHERE tile[3:3] = 'S' AND tile[-1:] = 'W' AND tile[:2]::INTEGER <= 80 AND tile[5:7]::INTEGER <= 180""",
    "classify_change": """WITH o AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey * 13) % 160 END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey * 7) % 160 END AS b FROM orders)
        SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'null_both' WHEN a IS NULL OR b IS NULL THEN 'skip' WHEN a = 100 AND b = 100 THEN 'extract_all' WHEN a < 100 AND b < 100 THEN 'natural' WHEN a > 100 AND b > 100 THEN 'manmade' ELSE 'skip' END AS mode, count(*) AS n FROM o GROUP BY 1""",
    "block_grid_halo": """WITH b AS (SELECT i::INTEGER AS block_id, ((i % 3) * 2048)::INTEGER AS bcol, ((i // 3) * 2048)::INTEGER AS brow FROM range(6) t(i)),
        s AS (SELECT *, least(2048, 5000 - bcol) AS width, least(2048, 3000 - brow) AS height, greatest(bcol - 1024, 0) AS hcol, greatest(brow - 1024, 0) AS hrow FROM b)
        SELECT *, least(bcol + width + 1024, 5000) - hcol AS hwidth, least(brow + height + 1024, 3000) - hrow AS hheight, bcol - hcol AS inner_col, brow - hrow AS inner_row FROM s""",
    "block_origins": "SELECT i::INTEGER AS block_id, 10 + ((i % 3) * 2048) * 0.25::DOUBLE AS x, 50 - ((i // 3) * 2048) * 0.5::DOUBLE AS y FROM range(6) t(i)",
    "halo_copies": f"""WITH {LINES}, b AS (SELECT i // (n // 48 + 1) AS r, i % (n // 48 + 1) AS c, n FROM (SELECT n, unnest(range((n // 48 + 1) * (n // 48 + 1))) AS i FROM ls))
        SELECT (r * ((n + 47) // 48) + c)::BIGINT AS block_id, count(*) AS cells, count_if(prow // 48 = r AND pcol // 48 = c)::BIGINT AS own FROM b JOIN lin ON prow BETWEEN r * 48 - 24 AND r * 48 + 71 AND pcol BETWEEN c * 48 - 24 AND c * 48 + 71 WHERE r * 48 < n AND c * 48 < n GROUP BY 1""",
    "raster_extents": "SELECT n_name AS raster, n_nationkey * 10.0::DOUBLE AS xmin, n_nationkey * 10.0::DOUBLE + 0.5::DOUBLE * (n_nationkey + 20) AS xmax, n_nationkey * -5.0::DOUBLE - 0.25::DOUBLE * (n_nationkey + 8) AS ymin, n_nationkey * -5.0::DOUBLE AS ymax FROM nation",
    "output_names": "SELECT n_nationkey AS id, n_name || '_slope' AS slope, n_name || '_smoothed' AS smoothed, n_name || '_change' AS change, 'zone' || n_nationkey || '_' || n_name || '_training' AS training, n_nationkey || '_polygons' AS polygons, n_name || '_zone_cropped' || CASE WHEN n_nationkey % 2 = 0 THEN '_merged' ELSE '' END AS cropped FROM nation",
    "order_stamps": "SELECT DISTINCT lower(strftime(o_orderdate, '%b%d_%Y')) AS stamp FROM orders",
    "layer_extent": f"WITH {DIM}, {ZONES} SELECT min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax FROM zones",
    "zones_in_box": f"WITH {DIM}, {ZONES} SELECT zone_id FROM zones WHERE NOT (xmax < 20.5 OR xmin > 90.25 OR ymax < 10.0 OR ymin > 70.75)",
    "read_windows": f"WITH {DIM}, {ZONES}, {WINDOWS} SELECT * FROM windows",
    "window_pixels": f"WITH {GFC} SELECT prow, pcol, value FROM gfc WHERE prow >= 17 AND prow < 57 AND pcol >= 101 AND pcol < 131",
    "threshold_mask": f"WITH {LINES} SELECT prow, pcol, (value > 15)::INTEGER AS mask FROM lin",
    "zonal_pixels": f"WITH {ZONED} SELECT zone_id, prow, pcol, value FROM zoned",
    "zonal_window_pixels": f"WITH {CUT} SELECT zone_id, prow, pcol, value FROM cut",
    "zonal_mode": f"WITH {MODES} SELECT zone_id, mode FROM modes",
    "extract_v2_pixels": f"WITH {V2} SELECT zone_id, prow, pcol, value FROM v2",
    "extract_v2_status": f"WITH {V2} SELECT 'success' AS status, (SELECT count(*) FROM zones) AS polygon_count, count(DISTINCT zone_id) AS contributing, count(DISTINCT {{'r': prow, 'c': pcol}}) AS pixel_count FROM v2",
    "status_of_inputs": f"""WITH {V2}, p AS (SELECT zone_id % 7 AS input, count(*) AS polygon_count FROM zones GROUP BY 1), e AS (SELECT zone_id % 7 AS input, count(DISTINCT zone_id) AS contributing, count(DISTINCT {{'r': prow, 'c': pcol}}) AS pixel_count FROM v2 GROUP BY 1)
        SELECT input, CASE WHEN pixel_count IS NULL THEN 'no_change' ELSE 'success' END AS status, polygon_count, coalesce(contributing, 0) AS contributing, coalesce(pixel_count, 0) AS pixel_count FROM p LEFT JOIN e USING (input)""",
    "extract_v1_natural": f"WITH {MODES} SELECT zone_id, prow, pcol, ({V1})::INTEGER AS value FROM zoned LEFT JOIN modes USING (zone_id)",
    "extract_v1_manmade": f"WITH {ZONED} SELECT zone_id, prow, pcol, (CASE WHEN ys IS NULL OR value BETWEEN ys AND ye THEN value ELSE 0 END)::INTEGER AS value FROM zoned",
    "overlay_last_wins": f"WITH {TOP} SELECT prow, pcol, value FROM top",
    "block_scatter": f"WITH {TOP} SELECT prow, pcol, value FROM top",
    "block_scatter_counts": f"WITH {TOP} SELECT DISTINCT (prow // 100)::INTEGER AS block_row, (pcol // 100)::INTEGER AS block_col, least(100, n - prow // 100 * 100)::INTEGER AS height, least(100, n - pcol // 100 * 100)::INTEGER AS width FROM top, dim",
    "quadrant_counts": f"WITH {PLACES} SELECT CASE WHEN ceil(lat / 10) >= 0 THEN 'N' ELSE 'S' END || CASE WHEN floor(lon / 10) >= 0 THEN 'E' ELSE 'W' END AS quadrant, count(*) AS n FROM places GROUP BY 1",
    "quadrant_mosaics": f"WITH {PLACES} SELECT CASE WHEN ceil(lat / 10) >= 0 THEN 'N' ELSE 'S' END || CASE WHEN floor(lon / 10) >= 0 THEN 'E' ELSE 'W' END AS quadrant, (id % 7)::INTEGER AS prow, (id % 5)::INTEGER AS pcol, arg_max(id % 256, id)::INTEGER AS value FROM places WHERE id % 256 <> 255 GROUP BY 1, 2, 3",
    "bbox_join": f"WITH {DIM}, {ZONES}, {TILES} SELECT zone_id, location FROM zones z JOIN tiles t ON {BOXES_MEET}",
    "tile_semi_join": f"WITH {DIM}, {ZONES}, {TILES} SELECT zone_id FROM zones z WHERE EXISTS (SELECT 1 FROM tiles t WHERE {BOXES_MEET})",
    "zone_tiles": f"WITH {DIM}, {ZONES}, {TILES} SELECT DISTINCT zone_id, location FROM (SELECT *, xb - xa AS dx, yb - ya AS dy FROM segments) s JOIN tiles t ON {SEGMENT_IN_TILE}",
    "tile_list": f"WITH {DIM}, {ZONES}, {TILES} SELECT DISTINCT location FROM (SELECT *, xb - xa AS dx, yb - ya AS dy FROM segments) s JOIN tiles t ON {SEGMENT_IN_TILE}",
    "tile_nonblank": f"WITH {TOP}, {TILES} SELECT location FROM top JOIN tiles t ON {IN_TILE} GROUP BY 1 HAVING bool_or(value NOT IN (0, 255))",
    "raster_tiles": f"WITH {TOP}, {TILES}, x AS (SELECT location, prow, pcol, value FROM top JOIN tiles t ON {IN_TILE}) SELECT * FROM x SEMI JOIN (SELECT location FROM x GROUP BY 1 HAVING bool_or(value NOT IN (0, 255))) USING (location)",
    "crop_tiles": f"WITH {GFC}, {TILES} SELECT location, count(*) AS cells, sum(CASE WHEN prow < n // 3 AND value > 8 THEN value + 100 ELSE value END)::BIGINT AS total FROM gfc JOIN tiles t ON {IN_TILE} JOIN dim ON true WHERE location <> 'NATION_7' GROUP BY 1",
    "training_tiles": f"""WITH {MODES}, {TILES}, v1 AS (SELECT zone_id, prow, pcol, {V1} AS value FROM zoned LEFT JOIN modes USING (zone_id))
        SELECT zone_id, location, count(*) AS cells, sum(value)::BIGINT AS total FROM v1 JOIN tiles t ON {IN_TILE} GROUP BY 1, 2 HAVING bool_or(value NOT IN (0, 255))""",
    "slope_deg": f"WITH {DEM}, {_slope('dem', 's')} SELECT prow, pcol, round(value, 6) AS slope FROM s",
    "dilate3x3": f"WITH {DEM} SELECT a.prow, a.pcol, max(b.value) AS value FROM dem a JOIN dem b ON b.prow BETWEEN a.prow - 1 AND a.prow + 1 AND b.pcol BETWEEN a.pcol - 1 AND a.pcol + 1 GROUP BY 1, 2",
    "sum3x3": f"WITH {GFC}, w AS (SELECT prow, pcol, sum(value) OVER (PARTITION BY prow ORDER BY pcol RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM gfc) SELECT prow, pcol, (sum(v) OVER (PARTITION BY pcol ORDER BY prow RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))::BIGINT AS value FROM w",
    "endpoint_count": f"WITH {LINES}, o AS (SELECT * FROM lin WHERE value > 40) SELECT a.prow, a.pcol FROM o a JOIN (SELECT i - 1 AS r, j - 1 AS c FROM range(3) x(i), range(3) y(j)) d ON true JOIN o b ON b.prow = a.prow + d.r AND b.pcol = a.pcol + d.c GROUP BY 1, 2 HAVING count(*) = 2",
    "slope_dilated_mosaic": f"""WITH {DEM}, two AS (SELECT prow, pcol, value * 2 AS value FROM dem WHERE prow % 400 BETWEEN 100 AND 199), {_slope('dem', 's')}, {_slope('two', 'u')},
        m AS (SELECT a.prow, a.pcol, max(b.value) AS value, 1 AS ord FROM s a JOIN s b ON b.prow BETWEEN a.prow - 1 AND a.prow + 1 AND b.pcol BETWEEN a.pcol - 1 AND a.pcol + 1 GROUP BY 1, 2 UNION ALL
              SELECT a.prow, a.pcol, max(b.value), 2 FROM u a JOIN u b ON b.prow BETWEEN a.prow - 1 AND a.prow + 1 AND b.pcol BETWEEN a.pcol - 1 AND a.pcol + 1 GROUP BY 1, 2)
        SELECT prow, pcol, round(arg_max(value, ord), 6) AS value FROM m GROUP BY 1, 2""",
    "mosaic_last_wins": f"WITH {GFC} SELECT prow, pcol, (CASE WHEN prow < n // 3 AND value > 8 THEN value + 100 ELSE value END)::INTEGER AS value FROM gfc, dim",
    "components4": f"""WITH RECURSIVE {LINES}, o AS (SELECT prow, pcol FROM lin WHERE value > 60),
        reach AS (SELECT prow, pcol, prow AS r, pcol AS c FROM o UNION SELECT s.prow, s.pcol, b.prow, b.pcol FROM (SELECT x.prow, x.pcol, x.r + d.a AS r, x.c + d.b AS c FROM reach x, {STEPS}) s JOIN o b ON b.prow = s.r AND b.pcol = s.c)
        SELECT prow, pcol, min(r * n + c)::BIGINT AS component FROM reach, ls GROUP BY 1, 2""",
    "enclosed_interior": _interior(1),
    "area_filter": _interior(3),
    "buffer_rasterize": f"""WITH {DIM}, {ZONES}, p AS (SELECT zone_id AS line_id, xmin AS x1, ymin AS y1, xmax + 0.21::DOUBLE AS x2, ymax + 0.17::DOUBLE AS y2, xmax + 6.43::DOUBLE AS x3, ymin + 0.39::DOUBLE AS y3 FROM zones),
        q AS (SELECT *, unnest(range(floor(y1 - 5)::BIGINT, ceil(y2 + 5)::BIGINT)) AS r FROM p), g AS (SELECT *, r + 0.5::DOUBLE AS y, c + 0.5::DOUBLE AS x FROM (SELECT *, unnest(range(floor(x1 - 5)::BIGINT, ceil(x3 + 5)::BIGINT)) AS c FROM q)),
        d AS (SELECT *, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)) AS t1, abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) / sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS d1,
              ((x - x2) * (x3 - x2) + (y - y2) * (y3 - y2)) / (power(x3 - x2, 2) + power(y3 - y2, 2)) AS t2, abs((x - x2) * (y3 - y2) - (y - y2) * (x3 - x2)) / sqrt(power(x3 - x2, 2) + power(y3 - y2, 2)) AS d2 FROM g)
        SELECT line_id, r::INTEGER AS prow, c::INTEGER AS pcol FROM d WHERE (t1 BETWEEN 0 AND 1 AND d1 <= 2.5) OR (t2 BETWEEN 0 AND 1 AND d2 <= 2.5) OR sqrt(power(x - x2, 2) + power(y - y2, 2)) <= 2.5""",
    "footprint_mercator": f"""WITH {ZONED}, b AS (SELECT zone_id, -60 + min(pcol) * 0.01::DOUBLE AS x0, -60 + (max(pcol) + 1) * 0.01::DOUBLE AS x1, 5 - (max(prow) + 1) * 0.01::DOUBLE AS y0, 5 - min(prow) * 0.01::DOUBLE AS y1 FROM zoned GROUP BY 1)
        SELECT zone_id, round(radians(x0) * 6378137, 4) AS xmin, round(radians(x1) * 6378137, 4) AS xmax, round(ln(tan(pi() / 4 + radians(y0) / 2)) * 6378137, 4) AS ymin, round(ln(tan(pi() / 4 + radians(y1) / 2)) * 6378137, 4) AS ymax FROM b""",
    "footprint_rings": f"""WITH {ZONED}, c AS (SELECT zone_id, prow, pcol, prow // 100 AS br, pcol // 100 AS bc FROM zoned), e AS (SELECT zone_id, br, bc, count(*) AS cells FROM c GROUP BY 1, 2, 3),
        s AS (SELECT a.zone_id, a.br, a.bc, count(*) AS shared FROM c a JOIN {STEPS} ON true JOIN c b ON b.zone_id = a.zone_id AND b.prow = a.prow + d.a AND b.pcol = a.pcol + d.b AND b.br = a.br AND b.bc = a.bc GROUP BY 1, 2, 3)
        SELECT zone_id, sum(cells)::DOUBLE AS area, sum(4 * cells - coalesce(shared, 0))::DOUBLE AS perimeter FROM e LEFT JOIN s USING (zone_id, br, bc) GROUP BY 1""",
    "reprojected": f"WITH {PLACES} SELECT id, round(CASE WHEN id % 2 = 0 THEN lon + 1 ELSE radians(lon + 1) * 6378137 END, 4) AS x, round(CASE WHEN id % 2 = 0 THEN lat + 1 ELSE ln(tan(pi() / 4 + radians(lat + 1) / 2)) * 6378137 END, 4) AS y FROM places",
    "merged_footprints": f"WITH {DIM}, {ZONES} SELECT zone_id, xmin, xmax, CASE WHEN zone_id % 2 = 0 THEN 'a' ELSE 'b_x' END AS filename FROM zones",
    "merged_vectors": f"WITH {DIM}, {SEGMENTS}, z AS (SELECT zone_id, count(*) AS corners, 1 + (zone_id % 3 = 0)::INTEGER + (zone_id % 4 = 1)::INTEGER AS parts FROM segments GROUP BY 1) SELECT parts, count(*) AS features, sum(corners + parts)::BIGINT AS points FROM z GROUP BY 1",
    "warped": f"WITH {GFC}, t AS (SELECT i, m FROM (SELECT n // 4 AS m, unnest(range((n // 4) * (n // 4))) AS i FROM dim)) SELECT (i % m)::INTEGER AS tx, (i // m)::INTEGER AS ty, value FROM t JOIN gfc ON pcol = floor((degrees(((i % m) + 0.5::DOUBLE) * 41200 / 6378137)) * 10) AND prow = floor(-(degrees(2 * atan(exp((-((i // m) + 0.5::DOUBLE) * 41200) / 6378137)) - pi() / 2)) * 10)",
}
ORACLES["buffer_tiles"] = f"WITH {DIM}, {TILES}, b AS (SELECT DISTINCT prow, pcol FROM ({ORACLES['buffer_rasterize']})) SELECT location, count(*) AS cells FROM b JOIN tiles t ON {IN_TILE} GROUP BY 1"
