"""Domain-shaped views over the base tables: detections, frames, poses, tiles, image pairs, raster cells.

Each view is one SQL text that Spark and DuckDB both run, so a query and its SQL twin start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {}

VIEWS["detections"] = """
SELECT video_id, CAST(floor(seq / 3e0) AS INT) AS frame_idx, CAST(seq % 3 AS INT) AS det_idx, event_id, ts, value,
  cls_id, cls_name, 0.3e0 + ((event_id * 37) % 70) / 1e2 AS conf,
  CAST(100 + cls_id * 200 + k % 20 AS INT) AS x, CAST(80 + cls_id * 90 + (k * 3) % 15 AS INT) AS y,
  CAST(20 + floor(value / 1e1) AS INT) AS w, CAST(16 + floor(value / 12e0) AS INT) AS h
FROM (SELECT CAST(user_id % 15 + 15 * floor(user_id / 150e0) AS INT) AS video_id, event_id, ts, value, event_type AS cls_name,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
        CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS cls_id,
        row_number() OVER (PARTITION BY user_id % 15 + 15 * floor(user_id / 150e0) ORDER BY ts, event_id) - 1 AS seq FROM events) t
"""

VIEWS["frames"] = """
SELECT video_id, frame_idx, min(ts) AS ts, 30e0 AS fps, 1280 AS width, 720 AS height,
  round(avg(value), 4) AS sharpness, count(*) AS n_det
FROM detections GROUP BY video_id, frame_idx
"""

VIEWS["captures"] = """
SELECT CAST(user_id % 3 + 3 * floor(user_id / 150e0) AS INT) AS camera_id, event_id AS camera_frame_id, ts, value AS detector_ms FROM events
"""

VIEWS["arrivals"] = """
SELECT camera_id, camera_frame_id, ts, detector_ms, CAST(floor((day(ts) - 1) / 8e0) AS INT) + (CASE WHEN camera_frame_id % 20 = 19 THEN 1 ELSE 0 END) AS slice FROM captures
UNION ALL SELECT camera_id, camera_frame_id, ts, detector_ms, CAST(floor((day(ts) - 1) / 8e0) AS INT) + 1 AS slice FROM captures WHERE camera_frame_id % 20 = 7
"""

VIEWS["alignments"] = """
SELECT CAST(o_custkey % 15 AS INT) AS video_id, CAST(row_number() OVER (PARTITION BY o_custkey % 15 ORDER BY o_orderkey) - 1 AS INT) AS frame_idx,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE (o_orderkey % 97) / 15e0 END AS dx,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE (o_orderkey % 31) / 1e1 END AS dy,
  1e0 + (o_orderkey % 19 - 9) / 1e3 AS scale, (o_orderkey % 41 - 20) / 9e1 AS rotation_deg,
  5e1 + o_totalprice / 1e4 AS sharpness, (o_orderkey % 23) / 2e2 AS residual_ratio, o_orderstatus <> 'P' AS align_ok FROM orders
"""

VIEWS["poses"] = """
SELECT video_id, frame_idx, 121e0 + video_id / 1e2 + frame_idx / 1e5 AS lon, 24e0 + frame_idx / 1e5 AS lat,
  100e0 + (frame_idx * 7) % 50 AS alt, CAST((frame_idx * 3) % 360 AS DOUBLE) AS yaw,
  -75e0 + (frame_idx * 5) % 60 AS pitch, -3e0 + frame_idx % 7 AS roll,
  frame_idx % 40 <> 0 AS pose_ok, frame_idx % 150 = 75 AS map_corrected FROM frames
"""

VIEWS["tiles"] = """
SELECT p_partkey AS tile_id, p_brand AS region, concat(p_brand, '/tile_', CAST(p_partkey AS STRING), '.tif') AS path,
  CASE WHEN p_partkey % 50 = 49 THEN NULL ELSE 'EPSG:4326' END AS crs,
  120e0 + ((p_partkey * 7919) % 2000) / 1e3 AS west, 22e0 + ((p_partkey * 104729) % 3000) / 1e3 AS south,
  120e0 + ((p_partkey * 7919) % 2000) / 1e3 + 1e-2 + p_size / 1e3 AS east,
  22e0 + ((p_partkey * 104729) % 3000) / 1e3 + 1e-2 + p_size / 1e3 AS north,
  256 AS width, 256 AS height, p_partkey AS mtime, CAST(floor(p_retailprice) AS BIGINT) AS size_bytes FROM part
"""

VIEWS["points"] = """
SELECT c_custkey AS point_id, 120e0 + ((c_custkey * 6151) % 2000) / 1e3 AS lon,
  22e0 + ((c_custkey * 3571) % 3000) / 1e3 AS lat FROM customer
"""

VIEWS["tile_cells"] = """
SELECT t.tile_id, t.region, CAST(floor(t.west * 1e2 + 5e-1) AS BIGINT) + g.g % 4 AS tx, CAST(floor(t.south * 1e2 + 5e-1) AS BIGINT) + CAST(floor(g.g / 4e0) AS BIGINT) AS ty,
  t.tile_id AS tile_seq, CAST((t.tile_id * 31 + g.g * 17) % 1021 AS DOUBLE) AS value, (t.tile_id + g.g) % 13 <> 0 AS valid
FROM tiles t CROSS JOIN (SELECT DISTINCT CAST(p_size AS INT) - 1 AS g FROM part WHERE p_size BETWEEN 1 AND 16) g
"""

VIEWS["media"] = """
SELECT concat('/data/', CASE WHEN p_partkey % 31 = 0 THEN 'other' ELSE concat('card', CAST(CAST(floor(p_partkey / 2e0) AS BIGINT) % 3 AS STRING)) END, '/DJI_', CAST(CAST(floor(p_partkey / 6e0) AS BIGINT) AS STRING),
  CASE WHEN p_partkey % 2 = 0 THEN '_V' ELSE '_P' END,
  CASE WHEN p_partkey % 2 = 0 THEN (CASE p_size % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mov' WHEN 2 THEN '.avi' ELSE '.mkv' END)
       ELSE (CASE p_size % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.PNG' ELSE '.gif' END) END) AS path FROM part
"""

VIEWS["photo_text"] = """
SELECT p_partkey AS photo_id, concat('<rdf ',
  CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'AbsoluteAltitude="0.0" ' ELSE concat('AbsoluteAltitude="', CAST(p_size AS STRING), '.5" ') END,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('RelativeAltitude="', CAST(p_partkey % 120 AS STRING), '.25" ') END,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('GimbalYawDegree="', CAST(p_partkey % 360 AS STRING), '" ') END,
  'FlightYawDegree="', CAST((p_partkey * 3) % 360 AS STRING), '" ',
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat('GimbalPitchDegree="-', CAST(p_partkey % 90 AS STRING), '.1" ') END, '/>') AS text,
  24 AS lat_d, CAST(p_partkey % 60 AS INT) AS lat_m, (p_partkey % 600) / 1e1 AS lat_s, CASE WHEN p_partkey % 10 = 0 THEN 'S' ELSE 'N' END AS lat_ref FROM part
"""

VIEWS["images"] = """
SELECT o_orderkey AS image_id, concat('src', CAST(o_custkey % 5 AS STRING)) AS source,
  concat('train/set', CAST(o_custkey % 7 AS STRING), '/img_', CAST(o_orderkey AS STRING), '.jpg') AS rel_path,
  CAST(o_orderkey - (CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 0 END) AS STRING) AS content FROM orders
"""

VIEWS["boxes"] = """
SELECT i.image_id, CAST(row_number() OVER (PARTITION BY i.image_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS INT) AS box_id,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class_id,
  (l_partkey % 100) / 1e2 AS cx, (l_suppkey % 100) / 1e2 AS cy, l_quantity / 1e2 AS bw, l_discount + 1e-2 AS bh
FROM images i JOIN lineitem l ON CAST(i.content AS BIGINT) = l.l_orderkey
"""

VIEWS["yolo_lines"] = """
SELECT image_id, box_id AS line_no, CASE
  WHEN (image_id + box_id) % 97 = 0 THEN concat('7 ', '0.5 0.5 0.1 0.1')
  WHEN (image_id + box_id) % 89 = 0 THEN concat(CAST(class_id AS STRING), ' 0.5 0.5 0.0 0.1')
  WHEN (image_id + box_id) % 83 = 0 THEN concat(CAST(class_id AS STRING), ' 0.5 abc 0.2 0.1')
  WHEN (image_id + box_id) % 79 = 0 THEN concat(CAST(class_id AS STRING), ' 0.5 0.5 0.2')
  WHEN (image_id + box_id) % 11 = 0 THEN concat(CAST(class_id AS STRING), ' 0.1 0.1 0.9 0.1 0.5 0.8')
  ELSE concat(CAST(class_id AS STRING), ' ', CAST(CAST(floor(cx * 1e2) AS INT) AS STRING), 'e-2 0.5 0.25 0.125') END AS line FROM boxes
"""

VIEWS["documents_labelled"] = """
SELECT d.doc_id AS image_id, d.source, d.text AS content, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

VIEWS["correspondences"] = """
SELECT pair_id, CAST(corr_id AS INT) AS corr_id, ax, ay,
  CASE WHEN ln >= 6 THEN ay ELSE 1.02e0 * (ax * cos(radians(2e0)) - ay * sin(radians(2e0))) + 5e0 + (q - 25e0) / 5e1 END AS bx,
  CASE WHEN ln >= 6 THEN ax ELSE 1.02e0 * (ax * sin(radians(2e0)) + ay * cos(radians(2e0))) - 3e0 + (25e0 - q) / 5e1 END AS by_,
  q / 5e1 AS score
FROM (SELECT l_suppkey AS pair_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS corr_id,
        CAST(l_partkey % 640 AS DOUBLE) AS ax, CAST(l_orderkey % 480 AS DOUBLE) AS ay, l_quantity AS q, l_linenumber AS ln FROM lineitem) t
"""

VIEWS["flow_vectors"] = """
SELECT CAST(l_suppkey % 15 AS INT) AS video_id, l_orderkey AS candidate_id, CAST(l_partkey % 60 AS DOUBLE) - 30e0 AS rx, CAST(l_suppkey % 50 AS DOUBLE) - 25e0 AS ry,
  l_discount * 5e1 - 2e0 AS dx, l_tax * 5e1 - 1e0 AS dy, l_quantity / 25e0 AS fb_error FROM lineitem
"""

VIEWS["match_log"] = """
SELECT event_id AS match_id, CASE event_type WHEN 'click' THEN 'map_match' WHEN 'error' THEN 'photo_video_match' WHEN 'view' THEN 'map_match_rectified' ELSE 'map_correction' END AS stage,
  CASE WHEN event_id % 2 = 0 THEN 'edm' ELSE 'superpoint_lightglue' END AS backend,
  CASE WHEN value < 1e1 THEN 'insufficient_matches' WHEN value < 3e1 THEN 'insufficient_inliers' WHEN value < 4e1 THEN 'pose_rejected' ELSE 'accepted' END AS reason,
  value AS elapsed_ms, CAST(floor(value * 3e0) AS INT) AS matches, CAST(floor(value) AS INT) AS inliers FROM events
"""

VIEWS["cells"] = """
SELECT CAST(floor(l_orderkey / 15e3) AS INT) AS video_id, CAST(l_orderkey % 24 AS INT) AS frame_idx, CAST(l_partkey % 32 AS INT) AS cx, CAST(l_suppkey % 24 AS INT) AS cy,
  round(avg(l_quantity) * 5.1e0, 4) AS lum, min(l_linestatus) = 'F' OR count(*) > 1 AS valid
FROM lineitem GROUP BY floor(l_orderkey / 15e3), l_orderkey % 24, l_partkey % 32, l_suppkey % 24
"""


def uses(sql: str) -> list[str]:
    """Names of base tables and views that a SQL text reads."""
    found = set(re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", sql))
    return [n for n in (*BASE, *VIEWS) if n in found]


class Tables:
    """Base tables and views of one folder, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                for used in uses(VIEWS[name]):
                    self(used).createOrReplaceTempView(used)
                self._made[name] = self.spark.sql(VIEWS[name])
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]


def twin(sql: str) -> str:
    """A SQL text for DuckDB with the views it reads put before it."""
    order: list[str] = []

    def add(text: str) -> None:
        for name in uses(text):
            if name in VIEWS and name not in order:
                add(VIEWS[name])
                order.append(name)

    add(sql)
    views = [f"{name} AS ({VIEWS[name].strip().replace('AS STRING', 'AS VARCHAR')})" for name in order]
    sql = sql.strip()
    if not views:
        return sql
    if re.match(r"WITH\s+RECURSIVE\b", sql):
        return f"WITH RECURSIVE {', '.join(views)}, {sql[sql.index('RECURSIVE') + 9 :].strip()}"
    return f"WITH {', '.join(views)}" + (f", {sql[4:].strip()}" if sql.startswith("WITH ") else f" {sql}")
