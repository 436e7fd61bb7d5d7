"""Queries on confirmed events and their positions (A10-A13, B17, C5-C7, E13, and the flagship)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes as X
from ..functions import geo as G
from ..operators import events as O
from ..operators import frames as FR
from .boxes import RAY, TWD, half_up
from .registry import query

R = lambda c, k=6: F.round(c, k)
EV = "ev AS (SELECT video_id, event_id, frame_idx, frame_idx + CAST(event_id % 400 AS INT) AS confirm_frame, x + w / 2e0 AS px, y + h / 2e0 AS py, conf FROM detections WHERE conf >= 0.8e0)"


def _events(t):
    d = t("detections").filter("conf >= 0.8")
    return d.select("video_id", "event_id", "frame_idx", (F.col("frame_idx") + F.col("event_id") % 400).cast("int").alias("confirm_frame"), (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"), "conf")


#: Image to ground by the ray of the pixel through rotation and camera matrix: an independent form of the homography's inverse.
LOC = EV + """, po AS (SELECT *, radians(yaw) AS y, radians(pitch) AS p, radians(roll) AS r, radians(lon - 121e0) * 6378137e0 * cos(radians(24e0)) AS ce, radians(lat - 24e0) * 6378137e0 AS cn, 24e0 / sqrt(36e0*36e0 + 24e0*24e0) * sqrt(1280e0*1280e0 + 720e0*720e0) AS f FROM poses WHERE pose_ok),
ry AS (SELECT e.*, o.alt, o.ce, o.cn, o.video_id IS NOT NULL AS has, (px - 640) / f AS u, (py - 360) / f AS v, y, p, r FROM ev e LEFT JOIN po o ON e.video_id = o.video_id AND e.frame_idx = o.frame_idx),
di AS (SELECT *, (cos(y)*cos(r) + sin(y)*sin(p)*sin(r))*u + (sin(y)*sin(p)*cos(r) - cos(y)*sin(r))*v + sin(y)*cos(p) AS de, (-sin(y)*cos(r) + cos(y)*sin(p)*sin(r))*u + (cos(y)*sin(p)*cos(r) + sin(y)*sin(r))*v + cos(y)*cos(p) AS dn,
 -cos(p)*sin(r)*u - cos(p)*cos(r)*v + sin(p) AS du FROM ry),
lo AS (SELECT *, ce - alt * de / du AS gx, cn - alt * dn / du AS gy FROM di),
st AS (SELECT *, CASE WHEN NOT has OR confirm_frame - frame_idx > 900 THEN 'unavailable' WHEN du >= 0 THEN 'ray_above_ground_horizon' WHEN gx < -2e3 OR gx > 2e4 OR gy < -2e3 OR gy > 1e4 OR sqrt(power(gx - ce, 2) + power(gy - cn, 2)) > 1800 THEN 'outside_map_or_ground_range' ELSE 'ground_plane_estimate' END AS status FROM lo),
located AS (SELECT *, CASE WHEN status = 'ground_plane_estimate' THEN 121e0 + degrees(gx / (6378137e0 * cos(radians(24e0)))) END AS lon, CASE WHEN status = 'ground_plane_estimate' THEN 24e0 + degrees(gy / 6378137e0) END AS lat FROM st)"""


def _located(t):
    poses = O.with_map_pose(t("poses"), 24.0, 1280, 720, 121.0, 24.0)
    return O.localize_events(_events(t), poses, 30.0, (-2e3, -2e3, 2e4, 1e4), 121.0, 24.0)


@query("c05_localize_events", f"WITH {LOC} SELECT video_id, event_id, status, round(lon, 6) AS lon, round(lat, 6) AS lat FROM located")
def c05(t):
    return _located(t).select("video_id", "event_id", "status", R("lon").alias("lon"), R("lat").alias("lat"))


LOGGED = "WITH " + LOC + ", " + TWD.format(src="located", lon="lon", lat="lat") + """, lg AS (SELECT *, CASE WHEN lon IS NULL THEN 'unavailable' WHEN event_id % 2 = 0 THEN 'map_registered_ground_estimate' ELSE 'gps_seeded_ground_estimate' END AS coordinate_status, (confirm_frame - frame_idx) / 30e0 AS delay FROM g3)"""


def _logged(t):
    return O.logged_events(_located(t).withColumn("map_registered", F.col("event_id") % 2 == 0), 30.0)


@query("c06_build_logged_event", LOGGED + " SELECT video_id, event_id, coordinate_status, round(easting, 2) AS easting, round(northing, 2) AS northing, round(delay, 6) AS delay FROM lg")
def c06(t):
    return _logged(t).select("video_id", "event_id", "coordinate_status", R("easting", 2).alias("easting"), R("northing", 2).alias("northing"), R("confirmation_delay_sec").alias("delay"))


@query("c06_static_pose_event", LOGGED + " SELECT video_id, event_id, 'static_pose_estimate' AS coordinate_status, round(easting, 2) AS easting FROM lg")
def c06_static(t):
    rows = O.logged_events(_located(t).withColumn("map_registered", F.lit(False)), 30.0, static=True)
    return rows.select("video_id", "event_id", "coordinate_status", R("easting", 2).alias("easting"))


@query("b17_static_position", f"WITH {RAY}, " + TWD.format(src="m", lon="lon", lat="lat") + """, k AS (SELECT *, frame_idx % 9 = 0 AS none, frame_idx % 9 = 1 AS part, abs(rz * 4.5e0) > 0.5 AS clear FROM g3)
SELECT video_id, frame_idx, CASE WHEN clear AND NOT none AND NOT part THEN """ + half_up("(easting - alt / rz * rx)") + """ END AS easting, CASE WHEN clear AND NOT none AND NOT part THEN """ + half_up("(northing - alt / rz * ry)") + """ END AS northing, CASE WHEN clear AND NOT none AND NOT part THEN rz >= 0 END AS above_horizon, CASE WHEN part THEN 'partial_pose' END AS problem, none AS no_pose FROM k""")
def b17(t):
    """All rays; the places of those near the horizon are left out, since they hang on the last digits."""
    gone = lambda c, k: F.when(~F.pmod("frame_idx", F.lit(9)).isin(*k), F.col(c))
    px, py, w, h = F.col("frame_idx") % 1280, F.col("frame_idx") % 720, F.lit(1280), F.lit(720)
    rows = t("poses").withColumn("clear", F.abs(G.pixel_ray_depth("yaw", "pitch", "roll", px, py, w, h) * 4.5) > 0.5)
    rows = rows.withColumns({"lon": gone("lon", (0,)), "lat": gone("lat", (0, 1)), "alt": gone("alt", (0,))})
    rows = O.static_position(rows, px, py, w, h, "lon", "lat", "alt", "yaw", "pitch", "roll", "p")
    clear = lambda c: F.when(F.col("clear"), c)
    return rows.select("video_id", "frame_idx", clear(R("p.easting", 2)).alias("easting"), clear(R("p.northing", 2)).alias("northing"), clear(F.col("p.above_horizon")).alias("above_horizon"), "p.problem", F.col("p").isNull().alias("no_pose"))


ACT = "ev AS (SELECT video_id, event_id, frame_idx AS confirm_frame FROM detections WHERE conf >= 0.95e0), act AS (SELECT f.video_id, f.frame_idx, e.event_id, e.confirm_frame FROM frames f JOIN ev e ON f.video_id = e.video_id AND f.frame_idx - e.confirm_frame BETWEEN 0 AND 45)"


def _active(t):
    events = t("detections").filter("conf >= 0.95").select("video_id", "event_id", F.col("frame_idx").alias("confirm_frame"))
    return O.active_events(t("frames"), events, 45)


@query("c07_active_events", f"WITH {ACT} SELECT video_id, frame_idx, event_id FROM act")
def c07(t):
    return _active(t).select("video_id", "frame_idx", "event_id")


@query("e13_latest_events", f"WITH {ACT} SELECT a.video_id, a.frame_idx, a.event_id, (SELECT greatest(count(*) - 3, 0) FROM act b WHERE b.video_id = a.video_id AND b.frame_idx = a.frame_idx) AS remaining FROM act a WHERE (SELECT count(*) FROM act b WHERE b.video_id = a.video_id AND b.frame_idx = a.frame_idx AND (b.confirm_frame, b.event_id) > (a.confirm_frame, a.event_id)) < 3")
def e13(t):
    return FR.latest_events(_active(t), 3).select("video_id", "frame_idx", "event_id", "remaining")


#: Events as a live camera logs them: a box, times and evidence beside the position.
LIVE = LOGGED + """, lv AS (SELECT l.event_id, strftime(d.ts, '%Y-%m-%dT%H:%M:%S') AS logged_at_utc, l.confirm_frame AS processed_frame_idx, l.event_id * 3 AS camera_frame_id, l.event_id * 33333333 AS camera_timestamp_ns, (l.event_id % 977) / 8e0 AS processing_latency_ms,
d.x AS bbox_x, d.y AS bbox_y, d.w AS bbox_w, d.h AS bbox_h, CAST(d.w * d.h AS DOUBLE) AS area, 1 + (l.event_id % 64) / 8e0 AS growth_ratio, CASE WHEN l.event_id % 3 > 0 THEN (l.event_id % 8) / 8e0 END AS radial_outward_ratio, l.easting AS twd97_easting, l.northing AS twd97_northing, l.lon AS wgs84_lon, l.lat AS wgs84_lat,
printf('shots/event_%04d_frame_%08d_camera_%010d', l.event_id, l.confirm_frame, l.event_id * 3) AS stem FROM lg l JOIN detections d ON d.event_id = l.event_id)"""


def _live(t):
    k = F.col("event_id")
    d = t("detections").filter("conf >= 0.8").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("logged_at_utc"), *[F.col(c).alias(f"bbox_{c}") for c in "xywh"], (F.col("w") * F.col("h")).cast("double").alias("area"))
    rows = _logged(t).join(d, "event_id").withColumns({
        "processed_frame_idx": F.col("confirm_frame"), "camera_frame_id": k * 3, "camera_timestamp_ns": k * 33333333, "processing_latency_ms": k % 977 / 8.0, "growth_ratio": 1 + k % 64 / 8.0,
        "radial_outward_ratio": F.when(k % 3 > 0, k % 8 / 8.0), "twd97_easting": F.col("easting"), "twd97_northing": F.col("northing"), "wgs84_lon": F.col("lon"), "wgs84_lat": F.col("lat"),
    })
    return O.snapshot_paths(rows, "shots", 1280, 720)


def _text(c, digits=3):
    return f"CASE WHEN {c} IS NULL THEN '' ELSE printf('%.{digits}f', {c}) END AS {c}"


#: Coordinates are compared to fewer places than they are written with: the last ones depend on the order of operations.
CUT = {"twd97_easting": 5, "twd97_northing": 5, "wgs84_lon": 8, "wgs84_lat": 8}


@query("a11_detection_rows", LIVE + f""" SELECT CAST(event_id AS VARCHAR) AS event_id, logged_at_utc, CAST(processed_frame_idx AS VARCHAR) AS processed_frame_idx, CAST(camera_frame_id AS VARCHAR) AS camera_frame_id, CAST(camera_timestamp_ns AS VARCHAR) AS camera_timestamp_ns, printf('%.3f', processing_latency_ms) AS processing_latency_ms,
CAST(bbox_x AS VARCHAR) AS bbox_x, CAST(bbox_y AS VARCHAR) AS bbox_y, CAST(bbox_w AS VARCHAR) AS bbox_w, CAST(bbox_h AS VARCHAR) AS bbox_h, printf('%.3f', area) AS area, printf('%.3f', growth_ratio) AS growth_ratio, {_text('radial_outward_ratio')},
{', '.join(f"substr(CASE WHEN {c} IS NULL THEN '' ELSE printf('%.7f', {c}) END, 1, {n}) AS {c}" for c, n in CUT.items())}, stem || '_full.jpg' AS full_frame_path, stem || '_crop.jpg' AS crop_path FROM lv""")
def a11(t):
    rows = O.csv_rows(_live(t))
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in CUT.items()})


@query("a11_video_rows", LIVE + f""" SELECT 'v' || CAST(event_id % 15 AS VARCHAR) AS video_name, CAST(event_id AS VARCHAR) AS event_id, CAST(processed_frame_idx AS VARCHAR) AS frame_idx, printf('%.3f', processed_frame_idx / 8e0) AS timestamp_sec, printf('%.3f', area) AS area, printf('%.3f', growth_ratio) AS growth_ratio,
CASE WHEN radial_outward_ratio IS NULL THEN '' ELSE printf('%.3f', radial_outward_ratio) END AS radial_ratio, stem || '_full.jpg' AS full_frame_path, stem || '_crop.jpg' AS crop_path FROM lv""")
def a11_video(t):
    rows = _live(t).withColumns({"video_name": F.concat(F.lit("v"), (F.col("event_id") % 15).cast("string")), "frame_idx": F.col("processed_frame_idx"), "timestamp_sec": F.col("processed_frame_idx") / 8.0, "radial_ratio": F.col("radial_outward_ratio")})
    return O.csv_rows(rows, O.VIDEO_COLUMNS)


#: Lines with coordinates to a tenth of a metre and five places of a degree, so that the last digits of two engines can't differ.
LINES = LOGGED + """, ln AS (SELECT *, (event_id % 1000) / 4e0 AS t, (event_id % 8) / 8e0 AS confidence, delay AS wait, floor(easting * 10) / 10 AS e1, floor(northing * 10) / 10 AS n1, floor(lat * 1e5) / 1e5 AS la, floor(lon * 1e5) / 1e5 AS lo FROM lg)"""


def _lines(t):
    cut = lambda c, k: F.floor(F.col(c) * k) / k
    return _logged(t).withColumns({"timestamp_sec": F.col("event_id") % 1000 / 4.0, "confidence": F.col("event_id") % 8 / 8.0, "easting": cut("easting", 10), "northing": cut("northing", 10), "lat": cut("lat", 100000), "lon": cut("lon", 100000)})


@query("a12_coordinate_lines", LINES + """ SELECT event_id, CASE WHEN lon IS NULL THEN printf('ID %d: t=%.2fs, confidence=%.3f, coordinate=unavailable, impact_px=(%.1f, %.1f)', event_id, t, confidence, px, py)
ELSE printf('ID %d: t=%.2fs, confidence=%.3f, coordinate_status=%s, confirmation_delay=%.3fs, impact_px=(%.1f, %.1f), TWD97(E=%.2f, N=%.2f), WGS84(lat=%.6f, lon=%.6f)', event_id, t, confidence, coordinate_status, wait, px, py, e1, n1, la, lo) END AS line FROM ln""")
def a12(t):
    return _lines(t).select("event_id", O.coordinate_line().alias("line"))


@query("a12_live_lines", LINES + """ SELECT event_id, CASE WHEN lon IS NULL THEN printf('ID %d: t=%.2fs, coordinate=unavailable', event_id, t) ELSE printf('ID %d: t=%.2fs, TWD97(E=%.2f, N=%.2f), WGS84(lat=%.6f, lon=%.6f)', event_id, t, e1, n1, la, lo) END AS line FROM ln""")
def a12_live(t):
    return _lines(t).select("event_id", O.live_coordinate_line().alias("line"))


JSON = ("logged_at_utc", "processed_frame_idx", "camera_frame_id", "camera_timestamp_ns", "full_frame_path", "crop_path", "position_is_approximate")


@query("a10_event_json", LIVE + """ SELECT event_id, logged_at_utc, CAST(processed_frame_idx AS VARCHAR) AS processed_frame_idx, CAST(camera_frame_id AS VARCHAR) AS camera_frame_id, CAST(camera_timestamp_ns AS VARCHAR) AS camera_timestamp_ns, stem || '_full.jpg' AS full_frame_path, stem || '_crop.jpg' AS crop_path,
CASE WHEN wgs84_lon IS NULL THEN 'false' ELSE 'true' END AS position_is_approximate, '[' || bbox_x || ',' || bbox_y || ',' || bbox_w || ',' || bbox_h || ']' AS bbox_xywh, round(processing_latency_ms, 3) AS latency, area, growth_ratio, radial_outward_ratio, round(wgs84_lon, 5) AS lon, round(wgs84_lat, 5) AS lat, round(twd97_easting, 1) AS easting, round(twd97_northing, 1) AS northing FROM lv""")
def a10(t):
    at = lambda k: F.get_json_object("json", f"$.{k}")
    num = lambda k, d=None: at(k).cast("double") if d is None else F.round(at(k).cast("double"), d)
    return O.json_rows(_live(t)).select(
        "event_id", *[at(k).alias(k) for k in JSON], at("bbox_xywh").alias("bbox_xywh"), num("processing_latency_ms").alias("latency"), num("area").alias("area"), num("growth_ratio").alias("growth_ratio"), num("radial_outward_ratio").alias("radial_outward_ratio"),
        num("position.wgs84_lon", 5).alias("lon"), num("position.wgs84_lat", 5).alias("lat"), num("position.twd97_easting", 1).alias("easting"), num("position.twd97_northing", 1).alias("northing"),
    )


FLAG = """WITH signs AS (SELECT DISTINCT video_id, cls_id, cls_name, frame_idx FROM detections WHERE conf >= 0.6e0 AND cls_name IN ('click', 'view', 'error')),
gap AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER s <= 3 THEN 0 ELSE 1 END AS new FROM signs WINDOW s AS (PARTITION BY video_id, cls_id ORDER BY frame_idx)),
ses AS (SELECT *, sum(new) OVER (PARTITION BY video_id, cls_id ORDER BY frame_idx) AS session FROM gap),
hit AS (SELECT *, row_number() OVER (PARTITION BY video_id, cls_id, session ORDER BY frame_idx) AS hits FROM ses)
SELECT h.video_id, h.cls_name, count(*) AS events, min(h.frame_idx) AS first_frame, max(h.frame_idx) AS last_frame, round(avg(p.alt), 4) AS mean_alt FROM hit h LEFT JOIN poses p ON h.video_id = p.video_id AND h.frame_idx = p.frame_idx AND p.pose_ok
WHERE hits = 2 GROUP BY h.video_id, h.cls_name"""


@query("flagship_confirmed_events", FLAG)
def flagship(t):
    """Filtered detections, consecutive hits, the confirming frame of each run, its pose, and a summary for each video and class."""
    d = t("detections").filter((F.col("conf") >= 0.6) & X.in_classes("cls_name", ["click", "view", "error"]))
    hits = FR.confirmation_hits(d.select("video_id", "cls_id", "cls_name", "frame_idx").distinct(), ["video_id", "cls_id"])
    poses = t("poses").filter("pose_ok").select("video_id", "frame_idx", "alt")
    rows = hits.filter("hits = 2").join(poses, ["video_id", "frame_idx"], "left")
    return rows.groupBy("video_id", "cls_name").agg(F.count("*").alias("events"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), R(F.avg("alt"), 4).alias("mean_alt"))
