"""Queries on map tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tiles as O
from .registry import query

DIST = "sqrt(power(({a} - {c}) * 111412.84e0 * cos(radians(({b} + {d}) / 2)), 2) + power(({b} - {d}) * 111132.954e0, 2))"


def _dist(a, b, c, d):
    return DIST.format(a=a, b=b, c=c, d=d)


NEAR = f"""near AS (SELECT p.point_id, p.lon, p.lat, t.*, {_dist('p.lon', 'p.lat', 'least(greatest(p.lon, t.west), t.east)', 'least(greatest(p.lat, t.south), t.north)')} AS distance FROM points p, tiles t),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY point_id ORDER BY distance, path) AS INT) AS rank FROM near WHERE distance <= 5e3)"""


@query("a09_tile_catalog", "SELECT tile_id, split_part(path, '/', 1) AS region, CASE WHEN crs IS NULL THEN 'missing_crs' END AS reason FROM tiles")
def a09(t):
    return O.tile_catalog(t("tiles").drop("region")).select("tile_id", "region", "reason")


@query("c08_tiles_near", f"WITH {NEAR} SELECT point_id, tile_id, rank, round(distance, 4) AS distance FROM top WHERE rank <= 9")
def c08(t):
    return O.tiles_near(t("points"), t("tiles"), 5000, 9).select("point_id", "tile_id", "rank", F.round("distance", 4).alias("distance"))


@query("f01_top_k_tiles", f"WITH {NEAR} SELECT point_id, path FROM top WHERE rank <= 2")
def f01(t):
    return O.tiles_near(t("points"), t("tiles"), 5000, 2).select("point_id", "path")


@query("c09_nearest_submap", f"""WITH d AS (SELECT point_id, region, {_dist('p.lon', 'p.lat', 'least(greatest(p.lon, t.west), t.east)', 'least(greatest(p.lat, t.south), t.north)')} AS a, {_dist('p.lon', 'p.lat', '((t.west + t.east) / 2)', '((t.south + t.north) / 2)')} AS b FROM points p, tiles t),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY a, b, region) AS n FROM d) SELECT point_id, region, round(a, 4) AS distance FROM r WHERE n = 1""")
def c09(t):
    return O.nearest_submap(t("points"), t("tiles")).withColumn("distance", F.round("distance", 4))


def _photos(t):
    return t("points").select(F.col("point_id").alias("photo_id"), "lon", "lat", (100.0 + F.col("point_id") % 400).alias("alt"), (F.col("point_id") % 360).cast("double").alias("yaw"), (-80.0 + F.col("point_id") % 90).alias("pitch"), F.lit(0.0).alias("roll"))


SPOTS = """ph AS (SELECT point_id AS photo_id, lon, lat, 100e0 + point_id % 400 AS alt, radians(CAST(point_id % 360 AS DOUBLE)) AS y, radians(-80e0 + point_id % 90) AS p FROM points),
vw AS (SELECT *, sin(y) * cos(p) * (-alt / sin(p)) AS e, cos(y) * cos(p) * (-alt / sin(p)) AS n FROM ph),
spot AS (SELECT photo_id, 'gps' AS kind, lon, lat FROM ph UNION ALL SELECT photo_id, 'view', lon + degrees(e / (6378137e0 * cos(radians(lat)))), lat + degrees(n / 6378137e0) FROM vw WHERE sin(p) < -1e-6 AND sqrt(e * e + n * n) <= 1800),
hit AS (SELECT DISTINCT photo_id, kind, region FROM spot s JOIN tiles t ON s.lon BETWEEN t.west AND t.east AND s.lat BETWEEN t.south AND t.north),
reg AS (SELECT photo_id, count(DISTINCT region) AS n, max(CASE WHEN kind = 'gps' THEN 1 ELSE 0 END) AS g, max(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) AS v, string_agg(DISTINCT region, ',' ORDER BY region) AS regions FROM hit GROUP BY photo_id)"""


@query("c10_select_regions", f"""WITH {SPOTS} SELECT p.photo_id, CASE WHEN r.n IS NULL THEN (SELECT string_agg(DISTINCT region, ',' ORDER BY region) FROM tiles) ELSE r.regions END AS regions, CASE WHEN r.n IS NULL THEN 'unresolved_keep_all' WHEN r.n > 1 THEN 'multiple_candidates' WHEN g = 1 AND v = 1 THEN 'gps_and_view_candidate' WHEN g = 1 THEN 'gps_bounds_candidate' ELSE 'estimated_view_candidate' END AS status
FROM ph p LEFT JOIN reg r ON p.photo_id = r.photo_id""")
def c10(t):
    return O.select_regions(_photos(t), t("tiles"))


@query("g02_region_candidates", f"WITH {SPOTS} SELECT DISTINCT photo_id, region FROM hit")
def g02(t):
    rows = O.select_regions(_photos(t), t("tiles")).filter("status <> 'unresolved_keep_all'")
    return rows.select("photo_id", F.explode(F.split("regions", ",")).alias("region"))


def _half(lat, r):
    up = f"({r} / 111132.954e0 * 1.000001e0)"
    return up, f"({r} / (111412.84e0 * cos(radians(abs({lat}) + {up} / 2))) * 1.000001e0)"


AY, AX = _half("alat", "2.5e3")
BY, BX = _half("lat", "5e3")


@query("c11_roi_window", f"""WITH {NEAR}, anc AS (SELECT *, least(greatest(lon, west), east) AS alon, least(greatest(lat, south), north) AS alat FROM top WHERE rank <= 9),
box AS (SELECT *, greatest(alon - {AX}, lon - {BX}) AS w, greatest(alat - {AY}, lat - {BY}) AS s, least(alon + {AX}, lon + {BX}) AS e, least(alat + {AY}, lat + {BY}) AS n FROM anc),
px AS (SELECT *, greatest(floor((w - west) / ((east - west) / 256)), 0) AS x0, least(ceil((e - west) / ((east - west) / 256)), 256) AS x1, greatest(floor((north - n) / ((north - south) / 256)), 0) AS y0, least(ceil((north - s) / ((north - south) / 256)), 256) AS y1 FROM box)
SELECT point_id, tile_id, CAST(x0 AS BIGINT) AS col, CAST(y0 AS BIGINT) AS "row", CAST(x1 - x0 AS BIGINT) AS cols, CAST(y1 - y0 AS BIGINT) AS "rows" FROM px WHERE w < e AND s < n AND x1 > x0 AND y1 > y0""")
def c11(t):
    near = O.tiles_near(t("points"), t("tiles"), 5000, 9).join(t("tiles").select("tile_id", "width", "height").hint("merge"), "tile_id")
    rows = O.roi_window(near, 5000, 5000).filter("col IS NOT NULL")
    return rows.select("point_id", "tile_id", *[F.col(c).cast("long").alias(c) for c in ("col", "row", "cols", "rows")])


@query("d19_region_bounds", "SELECT region, count(*) AS tiles, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM tiles GROUP BY region")
def d19(t):
    return O.region_bounds(t("tiles"))


@query("d20_mosaic", "SELECT tx, ty, arg_max(value, tile_seq) FILTER (WHERE valid) AS value, bool_or(valid) AS covered FROM tile_cells GROUP BY tx, ty")
def d20(t):
    return O.mosaic(t("tile_cells"))


@query("d21_percentile_stretch", """WITH b AS (SELECT region, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM tile_cells GROUP BY region)
SELECT c.tile_id, c.tx, c.ty, CAST(CASE WHEN hi > lo THEN floor(least(greatest((value - lo) * 255 / (hi - lo), 0e0), 255e0) + 1e-9) ELSE 0 END AS INT) AS level FROM tile_cells c JOIN b ON c.region = b.region""")
def d21(t):
    return O.percentile_stretch(t("tile_cells")).select("tile_id", "tx", "ty", "level")


@query("d22_catalog_fingerprint", """WITH l AS (SELECT region, substr(md5(path), 1, 3) AS part, path || '|' || CAST(size_bytes AS VARCHAR) || '|' || CAST(mtime AS VARCHAR) || '|' || CAST(CAST(floor(west * 1000 + 0.5e0) AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(floor(north * 1000 + 0.5e0) AS BIGINT) AS VARCHAR) AS line FROM tiles),
p AS (SELECT region, part, sha256(string_agg(line, ';' ORDER BY line)) AS digest FROM l GROUP BY region, part)
SELECT region, sha256(string_agg(part || ':' || digest, ';' ORDER BY part)) AS fingerprint FROM p GROUP BY region""")
def d22(t):
    return O.catalog_fingerprint(t("tiles"))
