"""Queries on plug-ins and SQL functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import plugins as O
from .boxes import TWD
from .registry import query


@query("j01_score_frames", "SELECT video_id, frame_idx, sharpness > 250 AS sharp FROM frames")
def j01(t):
    score = lambda b: pd.DataFrame({"video_id": b["video_id"], "frame_idx": b["frame_idx"], "sharp": b["sharpness"] > 250})
    return O.score_frames(t("frames").select("video_id", "frame_idx", "sharpness"), score, "video_id int, frame_idx int, sharp boolean")


@query("j02_match_pairs", "SELECT pair_id, count(*) AS matches FROM correspondences WHERE score >= 0.5e0 GROUP BY pair_id")
def j02(t):
    match = lambda p: pd.DataFrame({"pair_id": [p["pair_id"].iloc[0]], "matches": [int((p["score"] >= 0.5).sum())]})
    return O.match_pairs(t("correspondences").select("pair_id", "score"), match, "pair_id long, matches long")


@query("j03_register_functions", "SELECT point_id, round(sqrt(power((lon - 121e0) * 111412.84e0 * cos(radians((lat + 24e0) / 2)), 2) + power((lat - 24e0) * 111132.954e0, 2)), 3) AS metres, printf('S%02d', point_id) AS label FROM points")
def j03(t):
    O.register_functions(t.spark, ["geo_distance", "event_label"])
    return t("points").select("point_id", F.expr("round(geo_distance(lon, lat, 121D, 24D), 3)").alias("metres"), F.expr("event_label(point_id)").alias("label"))


@query("j03_geodesic_functions", "WITH " + TWD.format(src="points", lon="lon", lat="lat") + """ SELECT point_id, round(easting, 4) AS easting, round(northing, 4) AS northing, round(lon, 6) AS lon, round(lat, 6) AS lat, round(radians(lon - 121e0) * 6378137e0 * cos(radians(24e0)), 4) AS east, round(radians(lat - 24e0) * 6378137e0, 4) AS north,
 round(CAST((point_id * 7) % 360 AS DOUBLE), 4) AS heading, lat - 55566.477e0 / 111132.954e0 * 1.000001e0 < 23 AS low FROM g3""")
def j03_geodesic(t):
    """Functions within functions, all in SQL."""
    O.register_functions(t.spark, ["wgs84_to_twd97", "twd97_to_wgs84", "to_en", "camera_rotation", "camera_heading", "gps_envelope"])
    t("points").createOrReplaceTempView("points")
    return t.spark.sql("""
        SELECT point_id, round(p.easting, 4) AS easting, round(p.northing, 4) AS northing, round(q.lon, 6) AS lon, round(q.lat, 6) AS lat, round(n.e, 4) AS east, round(n.n, 4) AS north,
          pmod(round(camera_heading(camera_rotation(CAST(point_id * 7 % 360 AS DOUBLE), -30D, 0D)), 4), 360D) AS heading, gps_envelope(lon, lat, 55566.477D).south < 23 AS low
        FROM (SELECT *, twd97_to_wgs84(p.easting, p.northing) AS q FROM (SELECT *, wgs84_to_twd97(lon, lat) AS p, to_en(lon, lat, 121D, 24D) AS n FROM points))""")
