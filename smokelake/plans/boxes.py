"""Queries on the scalar functions of boxes and ground coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as X
from ..functions import geo as G
from .registry import query

R = lambda c, k=6: F.round(c, k)


@query("b01_filter_classes", "SELECT event_id, cls_name FROM detections WHERE lower(trim(cls_name)) IN ('click', 'view')")
def b01(t):
    return t("detections").filter(X.in_classes("cls_name", [" Click", "VIEW "])).select("event_id", "cls_name")


@query("b02_missing_classes", "SELECT DISTINCT p_brand AS cls_name FROM part WHERE p_size < 3 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)")
def b02(t):
    wanted = t("part").filter("p_size < 3").select(F.col("p_brand").alias("cls_name"))
    have = t("part").filter("p_size > 48").select(F.col("p_brand").alias("cls_name"))
    return wanted.join(have, "cls_name", "left_anti").distinct()


@query("b03_argmax_class", """SELECT event_id, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INT) AS cls, round(greatest(a, b, c), 6) AS best FROM
(SELECT event_id, conf AS a, (event_id % 10) / 10e0 AS b, value / 5e2 AS c FROM detections) x WHERE greatest(a, b, c) >= 0.5e0""")
def b03(t):
    scores = t("detections").select("event_id", F.array(F.col("conf"), (F.col("event_id") % 10) / 10, F.col("value") / 500).alias("s"))
    return scores.select("event_id", X.argmax("s").alias("cls"), R(F.array_max("s")).alias("best")).filter(F.col("best") >= 0.5)


@query("b04_xyxy_to_xywh", """SELECT event_id, CAST(round_even(x1, 0) AS INT) AS x, CAST(round_even(y1, 0) AS INT) AS y, CAST(greatest(round_even(x2 - x1, 0), 1) AS INT) AS w, CAST(greatest(round_even(y2 - y1, 0), 1) AS INT) AS h
FROM (SELECT event_id, x / 2e0 AS x1, y / 4e0 AS y1, x / 2e0 + w / 8e0 AS x2, y / 4e0 + h / 2e0 AS y2 FROM detections) d""")
def b04(t):
    box = X.xyxy_to_xywh(F.col("x") / 2, F.col("y") / 4, F.col("x") / 2 + F.col("w") / 8, F.col("y") / 4 + F.col("h") / 2)
    return t("detections").select("event_id", box.alias("b")).select("event_id", "b.x", "b.y", "b.w", "b.h")


@query("b05_unletterbox", """SELECT event_id, round(least(greatest((x - w / 2e0) / 0.4e0, 0e0), 1280e0), 6) AS x1, round(least(greatest((y - h / 2e0 - 112e0) / 0.4e0, 0e0), 720e0), 6) AS y1,
round(least(greatest((x + w / 2e0) / 0.4e0, 0e0), 1280e0), 6) AS x2, round(least(greatest((y + h / 2e0 - 112e0) / 0.4e0, 0e0), 720e0), 6) AS y2 FROM detections""")
def b05(t):
    c = [F.col(k).cast("double") for k in "xywh"]
    rows = t("detections").select("event_id", X.unletterbox(*c, F.lit(512), F.lit(1280), F.lit(720)).alias("b"))
    return rows.select("event_id", *[R(f"b.{k}").alias(k) for k in ("x1", "y1", "x2", "y2")])


PAIRS = """pairs AS (SELECT a.event_id AS a_id, b.event_id AS b_id, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh
FROM detections a JOIN detections b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.det_idx < b.det_idx)"""


def _pairs(t):
    keep = ["video_id", "frame_idx", "det_idx", "event_id", *"xywh"]
    a = t("detections").select(*[F.col(c).alias(c if c in ("video_id", "frame_idx") else "a" + c) for c in keep])
    b = t("detections").select(*[F.col(c).alias(c if c in ("video_id", "frame_idx") else "b" + c) for c in keep])
    return a.join(b, ["video_id", "frame_idx"]).filter("adet_idx < bdet_idx").withColumnsRenamed({"aevent_id": "a_id", "bevent_id": "b_id"})


@query("b06_bbox_iou", f"""WITH {PAIRS}, o AS (SELECT *, CAST(greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, by_ + bh) - greatest(ay, by_), 0) AS DOUBLE) AS i FROM pairs)
SELECT a_id, b_id, round(CASE WHEN aw * ah + bw * bh - i > 0 THEN i / (aw * ah + bw * bh - i) ELSE 0e0 END, 6) AS iou FROM o""")
def b06(t):
    return _pairs(t).select("a_id", "b_id", R(X.iou("a", "b")).alias("iou"))


@query("b07_bbox_overlaps", f"""WITH {PAIRS} SELECT a_id, b_id, ax < bx + bw AND bx < ax + aw AND ay < by_ + bh AND by_ < ay + ah AS overlap,
ax - 8 < bx + bw AND bx < ax + aw + 8 AND ay - 8 < by_ + bh AND by_ < ay + ah + 8 AS near FROM pairs""")
def b07(t):
    rows = _pairs(t)
    rows = rows.withColumns({f"e{k}": v for k, v in X.expand("a", F.lit(7.5)).items()})
    return rows.select("a_id", "b_id", X.overlaps("a", "b").alias("overlap"), X.overlaps("e", "b").alias("near"))


@query("b08_clip_margin", "SELECT event_id, round(least(greatest(greatest(w, h) * 0.65e0, 18e0), 60e0), 6) AS margin FROM detections")
def b08(t):
    return t("detections").select("event_id", R(X.clip_margin("w", "h")).alias("margin"))


@query("b09_adaptive_distance", f"""WITH {PAIRS} SELECT a_id, b_id, round(greatest(140e0, 0.6e0 * greatest(sqrt(CAST(aw * aw + ah * ah AS DOUBLE)), sqrt(CAST(bw * bw + bh * bh AS DOUBLE)))), 6) AS reach,
round(sqrt(power(ax + aw / 2e0 - bx - bw / 2e0, 2) + power(ay + ah / 2e0 - by_ - bh / 2e0, 2)), 6) AS distance FROM pairs""")
def b09(t):
    return _pairs(t).select("a_id", "b_id", R(X.adaptive_distance("a", "b")).alias("reach"), R(X.centre_distance("a", "b")).alias("distance"))


SEG = """CASE WHEN power({bx}-({ax}),2)+power({by}-({ay}),2) > 0 THEN sqrt(power(px-(({ax})+least(greatest(((px-({ax}))*({bx}-({ax}))+(py-({ay}))*({by}-({ay})))/(power({bx}-({ax}),2)+power({by}-({ay}),2)),0e0),1e0)*({bx}-({ax}))),2)
+power(py-(({ay})+least(greatest(((px-({ax}))*({bx}-({ax}))+(py-({ay}))*({by}-({ay})))/(power({bx}-({ax}),2)+power({by}-({ay}),2)),0e0),1e0)*({by}-({ay}))),2)) ELSE sqrt(power(px-({ax}),2)+power(py-({ay}),2)) END"""


def _seg(ax, ay, bx, by):
    return SEG.replace("{ax}", ax).replace("{ay}", ay).replace("{bx}", bx).replace("{by}", by)


@query("b10_trajectory_distance", f"""WITH q AS (SELECT event_id, CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py, w * 3e0 AS x1, h * 2e0 AS y1, w * 3e0 + conf * 100 AS x2, h * 2e0 + 40 AS y2, w * 3e0 + 250 AS x3, h + 90e0 AS y3 FROM detections)
SELECT event_id, round(least({_seg('x1', 'y1', 'x2', 'y2')}, {_seg('x2', 'y2', 'x3', 'y3')}, {_seg('x3', 'y3', 'x3+2*(x3-x2)', 'y3+2*(y3-y2)')}), 5) AS distance FROM q""")
def b10(t):
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    w, h = F.col("w"), F.col("h")
    path = F.array(p(w * 3, h * 2), p(w * 3 + F.col("conf") * 100, h * 2 + 40), p(w * 3 + 250, h + 90))
    rows = t("detections").select("event_id", path.alias("path"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    return rows.select("event_id", R(X.trajectory_distance("path", "px", "py"), 5).alias("distance"))


@query("b11_transform_bbox", """WITH m AS (SELECT a.video_id, a.frame_idx, a.scale * cos(radians(a.rotation_deg)) AS c, a.scale * sin(radians(a.rotation_deg)) AS s, coalesce(a.dx, 0e0) AS dx, coalesce(a.dy, 0e0) AS dy FROM alignments a),
p AS (SELECT d.event_id, m.c * d.x - m.s * d.y + m.dx AS x1, m.s * d.x + m.c * d.y + m.dy AS y1, m.c * (d.x + d.w) - m.s * d.y + m.dx AS x2, m.s * (d.x + d.w) + m.c * d.y + m.dy AS y2,
 m.c * d.x - m.s * (d.y + d.h) + m.dx AS x3, m.s * d.x + m.c * (d.y + d.h) + m.dy AS y3, m.c * (d.x + d.w) - m.s * (d.y + d.h) + m.dx AS x4, m.s * (d.x + d.w) + m.c * (d.y + d.h) + m.dy AS y4
 FROM detections d JOIN m ON d.video_id = m.video_id AND d.frame_idx = m.frame_idx),
h AS (SELECT event_id, x1, y1, CAST(least(greatest(floor(least(x1, x2, x3, x4)), 0), 1279) AS INT) AS bx, CAST(least(greatest(floor(least(y1, y2, y3, y4)), 0), 719) AS INT) AS by_,
 least(ceil(greatest(x1, x2, x3, x4)), 1280) AS ex, least(ceil(greatest(y1, y2, y3, y4)), 720) AS ey FROM p)
SELECT event_id, round(x1, 5) AS px, round(y1, 5) AS py, bx AS x, by_ AS y, CAST(greatest(ex, bx + 1) AS INT) - bx AS w, CAST(greatest(ey, by_ + 1) AS INT) - by_ AS h FROM h""")
def b11(t):
    a = t("alignments").select("video_id", "frame_idx", F.array(
        F.col("scale") * F.cos(F.radians("rotation_deg")), -F.col("scale") * F.sin(F.radians("rotation_deg")), F.coalesce("dx", F.lit(0.0)),
        F.col("scale") * F.sin(F.radians("rotation_deg")), F.col("scale") * F.cos(F.radians("rotation_deg")), F.coalesce("dy", F.lit(0.0))).alias("m"))
    rows = t("detections").join(a, ["video_id", "frame_idx"])
    rows = rows.select("event_id", X.transform_point("m", "x", "y").alias("p"), X.transform_box("m", "x", "y", "w", "h", F.lit(1280), F.lit(720)).alias("b"))
    return rows.select("event_id", R("p.x", 5).alias("px"), R("p.y", 5).alias("py"), "b.x", "b.y", "b.w", "b.h")


@query("b12_scale_raster", "SELECT event_id, round(x * 1920e0 / 896e0, 6) AS x, round(y * 1080e0 / 504e0, 6) AS y FROM detections")
def b12(t):
    rows = t("detections").select("event_id", X.scale_raster("x", "y", F.lit(896.0), F.lit(504.0), F.lit(1920.0), F.lit(1080.0)).alias("p"))
    return rows.select("event_id", R("p.x").alias("x"), R("p.y").alias("y"))


@query("b13_event_status", "SELECT event_id, CASE cls_name WHEN 'click' THEN 'new-impact-boom' WHEN 'view' THEN 'new-impact-smoke' ELSE concat('detected-', cls_name) END AS status, printf('S%02d', event_id % 150) AS label FROM detections")
def b13(t):
    return t("detections").select("event_id", X.event_status(F.expr("CASE cls_name WHEN 'click' THEN 'Boom' WHEN 'view' THEN ' smoke' ELSE cls_name END")).alias("status"), X.event_label(F.col("event_id") % 150).alias("label"))


#: Easting and northing, longitudes brought to -180 up to 180 first; terms in the order of G.wgs84_to_twd97, since far from the meridian the last digit of a sum shows.
TWD = """g AS (SELECT *, 1 - power(6356752.3142451e0 / 6378137e0, 2) AS e FROM {src}),
g1 AS (SELECT *, e / (1 - e) AS e2, radians({lat}) AS phi FROM g),
g2 AS (SELECT *, tan(phi) * tan(phi) AS tt, e2 * cos(phi) * cos(phi) AS cc, (radians({lon} - 360 * floor(({lon} + 180) / 360)) - radians(121e0)) * cos(phi) AS aa, 6378137e0 / sqrt(1 - e * sin(phi) * sin(phi)) AS nu,
 6378137e0 * ((1 - e/4 - 3*power(e, 2)/64 - 5*power(e, 3)/256) * phi - (3*e/8 + 3*power(e, 2)/32 + 45*power(e, 3)/1024) * sin(2*phi) + (15*power(e, 2)/256 + 45*power(e, 3)/1024) * sin(4*phi) - (35*power(e, 3)/3072) * sin(6*phi)) AS arc FROM g1),
g3 AS (SELECT *, 250000e0 + 0.9999e0 * nu * ((((5 - 18*tt + tt*tt + 72*cc - 58*e2) / 120 * aa * aa + (1 - tt + cc) / 6) * aa * aa + 1) * aa) AS easting,
 0.9999e0 * (arc + nu * tan(phi) * ((((61 - 58*tt + tt*tt + 600*cc - 330*e2) / 720 * aa * aa + (5 - tt + 9*cc + 4*cc*cc) / 24) * aa * aa + 0.5e0) * aa * aa)) AS northing FROM g2)"""


@query("b14_wgs84_to_twd97", "WITH " + TWD.format(src="points", lon="lon", lat="lat") + " SELECT point_id, round(easting, 4) AS easting, round(northing, 4) AS northing FROM g3")
def b14(t):
    return t("points").select("point_id", G.wgs84_to_twd97("lon", "lat").alias("p")).select("point_id", R("p.easting", 4).alias("easting"), R("p.northing", 4).alias("northing"))


@query("b15_twd97_to_wgs84", "SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM points")
def b15(t):
    """There and back again gives the point, so the twin is the table itself."""
    there = t("points").select("point_id", G.wgs84_to_twd97("lon", "lat").alias("p"))
    back = there.select("point_id", G.twd97_to_wgs84("p.easting", "p.northing").alias("q"))
    return back.select("point_id", R("q.lon").alias("lon"), R("q.lat").alias("lat"))


def half_up(x: str, digits: int = 2) -> str:
    """SQL of Spark's round: half up on the shortest decimal text of the double. Other engines multiply first, which moves ties of large numbers."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 9)), {digits}) AS DOUBLE)"


RAY = """v AS (SELECT *, radians(yaw) AS yy, radians(pitch) AS pp, radians(roll) AS rr, (frame_idx % 1280) * 2840e0 / 1280 - 1420 AS u, 1420 - (frame_idx % 720) * 2840e0 / 720 AS w FROM poses),
d AS (SELECT *, tan(CASE WHEN u = 0 AND w = 0 THEN 1e-6 ELSE sqrt(u*u + w*w) END / (4.5e0 / 0.00274e0)) / CASE WHEN u = 0 AND w = 0 THEN 1e-6 ELSE sqrt(u*u + w*w) END AS k FROM v),
m AS (SELECT *, (cos(yy)*cos(rr) + sin(yy)*sin(pp)*sin(rr))*u*k + sin(yy)*cos(pp)*w*k + (sin(yy)*sin(pp)*cos(rr) - cos(yy)*sin(rr)) AS rx,
 (-sin(yy)*cos(rr) + cos(yy)*sin(pp)*sin(rr))*u*k + cos(yy)*cos(pp)*w*k + (cos(yy)*sin(pp)*cos(rr) + sin(yy)*sin(rr)) AS ry,
 -cos(pp)*sin(rr)*u*k + sin(pp)*w*k - cos(pp)*cos(rr) AS rz FROM d)"""


@query("b16_pixel_to_ground", "WITH " + RAY + ", " + TWD.format(src="m", lon="lon", lat="lat") + " SELECT video_id, frame_idx, CASE WHEN abs(rz * 4.5e0) > 0.1 THEN " + half_up("(easting - alt / rz * rx)") + " END AS easting, CASE WHEN abs(rz * 4.5e0) > 0.1 THEN " + half_up("(northing - alt / rz * ry)") + " END AS northing, CASE WHEN abs(rz * 4.5e0) <= 0.1 THEN 'near_horizon' WHEN rz > 0 THEN 'above_horizon' ELSE 'ground' END AS status FROM g3")
def b16(t):
    """All rays, each with what becomes of it. Of those that nearly follow the horizon a last digit of the depth moves the place by kilometres, so their places are left out."""
    p = G.pixel_to_ground("lon", "lat", "alt", "yaw", "pitch", "roll", F.col("frame_idx") % 1280, F.col("frame_idx") % 720, F.lit(1280), F.lit(720))
    z = G.pixel_ray_depth("yaw", "pitch", "roll", F.col("frame_idx") % 1280, F.col("frame_idx") % 720, F.lit(1280), F.lit(720)) * 4.5
    rows = t("poses").select("video_id", "frame_idx", p.alias("p"), (F.abs(z) > 0.1).alias("clear"))
    status = F.when(~F.col("clear"), "near_horizon").when(F.col("p.above_horizon"), "above_horizon").otherwise("ground")
    return rows.select("video_id", "frame_idx", *[F.when(F.col("clear"), R(f"p.{c}", 2)).alias(c) for c in ("easting", "northing")], status.alias("status"))


ROT = """SELECT *, cos(y)*cos(r) + sin(y)*sin(p)*sin(r) AS m0, cos(y)*sin(p)*sin(r) - sin(y)*cos(r) AS m1, -cos(p)*sin(r) AS m2, sin(y)*sin(p)*cos(r) - cos(y)*sin(r) AS m3, cos(y)*sin(p)*cos(r) + sin(y)*sin(r) AS m4, -cos(p)*cos(r) AS m5,
sin(y)*cos(p) AS m6, cos(y)*cos(p) AS m7, sin(p) AS m8 FROM (SELECT *, radians(yaw) AS y, radians(pitch) AS p, radians(roll) AS r FROM poses) x"""
NINE = ", ".join(f"round(m{k}, 6) + 0e0 AS m{k}" for k in range(9))


@query("b18_camera_rotation", f"SELECT video_id, frame_idx, {NINE} FROM ({ROT}) z")
def b18(t):
    rows = t("poses").select("video_id", "frame_idx", G.camera_rotation("yaw", "pitch", "roll").alias("m"))
    return rows.select("video_id", "frame_idx", *[(R(F.get("m", F.lit(k))) + 0.0).alias(f"m{k}") for k in range(9)])


@query("b19_camera_matrix", "SELECT tile_id, round((24e0 + tile_id % 50) / sqrt(36e0*36e0 + 24e0*24e0) * sqrt(4000e0*4000e0 + 3000e0*3000e0) * 1280e0 / 4000e0, 6) AS f, 640e0 AS cx, 360e0 AS cy FROM tiles")
def b19(t):
    """A video of another aspect than the photo: the principal point is the video's own centre."""
    k = G.camera_matrix(24.0 + F.col("tile_id") % 50, F.lit(4000), F.lit(3000), F.lit(1280), F.lit(720))
    return t("tiles").select("tile_id", k.alias("k")).select("tile_id", R(F.get("k", F.lit(0))).alias("f"), F.get("k", F.lit(2)).alias("cx"), F.get("k", F.lit(5)).alias("cy"))


@query("b20_plane_homography", f"""WITH z AS (SELECT *, 24e0 / sqrt(36e0*36e0 + 24e0*24e0) * sqrt(1280e0*1280e0 + 720e0*720e0) AS f, -(m0*10 + m1*20 + m2*alt) AS t0, -(m3*10 + m4*20 + m5*alt) AS t1, -(m6*10 + m7*20 + m8*alt) AS t2 FROM ({ROT}) q)
SELECT video_id, frame_idx, round(f*m0 + 640*m6, 4) + 0e0 AS h0, round(f*m1 + 640*m7, 4) + 0e0 AS h1, round(f*t0 + 640*t2, 3) + 0e0 AS h2, round(f*m3 + 360*m6, 4) + 0e0 AS h3, round(f*m4 + 360*m7, 4) + 0e0 AS h4, round(f*t1 + 360*t2, 3) + 0e0 AS h5,
round(m6, 6) + 0e0 AS h6, round(m7, 6) + 0e0 AS h7, round(t2, 4) + 0e0 AS h8 FROM z""")
def b20(t):
    h = G.plane_homography(G.camera_matrix(F.lit(24.0), F.lit(1280), F.lit(720)), G.camera_rotation("yaw", "pitch", "roll"), F.lit(10.0), F.lit(20.0), "alt")
    digits = (4, 4, 3, 4, 4, 3, 6, 6, 4)
    return t("poses").select("video_id", "frame_idx", h.alias("h")).select("video_id", "frame_idx", *[(R(F.get("h", F.lit(k)), d) + 0.0).alias(f"h{k}") for k, d in enumerate(digits)])


@query("b21_camera_heading", "SELECT video_id, frame_idx, round(((yaw % 360) + 360) % 360, 4) AS heading FROM poses")
def b21(t):
    rows = t("poses").select("video_id", "frame_idx", G.camera_heading(G.camera_rotation("yaw", "pitch", "roll")).alias("d"))
    return rows.select("video_id", "frame_idx", F.pmod(R("d", 4), F.lit(360.0)).alias("heading"))


@query("b22_to_en", "SELECT point_id, round(radians(lon - 121e0) * 6378137e0 * cos(radians(24e0)), 4) AS e, round(radians(lat - 24e0) * 6378137e0, 4) AS n, round(lon, 6) AS lon, round(lat, 6) AS lat FROM points")
def b22(t):
    rows = t("points").select("point_id", G.to_en("lon", "lat", F.lit(121.0), F.lit(24.0)).alias("p"))
    rows = rows.select("point_id", "p.e", "p.n", G.to_gps("p.e", "p.n", F.lit(121.0), F.lit(24.0)).alias("g"))
    return rows.select("point_id", R("e", 4).alias("e"), R("n", 4).alias("n"), R("g.lon").alias("lon"), R("g.lat").alias("lat"))


@query("b23_match_pixel_to_geo", """SELECT tile_id, CASE WHEN ok THEN round(west + (x + 0.5e0) * (east - west) / 256e0, 6) END AS lon, CASE WHEN ok THEN round(north - (y + 0.5e0) * (north - south) / 256e0, 6) END AS lat
FROM (SELECT *, x < 256 AND y < 256 AND NOT (x >= 100 AND y % 3 = 0) AS ok FROM (SELECT *, 2e0 * (tile_id % 200) + 1 AS x, 2e0 * (tile_id % 150) + 2 AS y FROM tiles) z) k""")
def b23(t):
    """The mask leaves out every third row from column 100 on."""
    h = F.array(*[F.lit(float(v)) for v in (2, 0, 1, 0, 2, 2, 0, 0, 1)])
    mask = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda x: ~((x >= 100) & (y % 3 == 0))))
    mask = t.spark.range(1).select(mask).scalar()  # made once, not for each row
    p = G.match_pixel_to_geo(h, F.col("tile_id") % 200, F.col("tile_id") % 150, F.lit(640), F.lit(480), F.lit(256), F.lit(256), "west", "north", (F.col("east") - F.col("west")) / 256, (F.col("north") - F.col("south")) / 256, mask)
    return t("tiles").select("tile_id", p.alias("p")).select("tile_id", R("p.lon").alias("lon"), R("p.lat").alias("lat"))


@query("b24_gps_envelope", """WITH a AS (SELECT point_id, lon + CASE WHEN point_id % 11 = 0 THEN 59.5e0 ELSE 0e0 END AS lo, lat * CASE WHEN point_id % 7 = 0 THEN 3.6e0 WHEN point_id % 7 = 1 THEN 3.45e0 ELSE 1e0 END AS la, CASE WHEN point_id % 13 = 0 THEN CAST('inf' AS DOUBLE) ELSE (point_id % 5) * 3e4 END AS r FROM points),
b AS (SELECT *, r / 111132.954e0 * 1.000001e0 AS dlat FROM a),
c AS (SELECT *, CASE WHEN isinf(r) OR abs(la) + dlat / 2 >= 89.9e0 THEN 361e0 ELSE least(r / (111412.84e0 * cos(radians(abs(la) + dlat / 2))) * 1.000001e0, 361e0) END AS dlon FROM b),
d AS (SELECT *, CASE WHEN abs(lo) > 180 OR abs(la) >= 85 THEN 'position' WHEN isinf(r) OR r <= 0 THEN 'radius' WHEN la - dlat <= -85 OR la + dlat >= 85 THEN 'polar' WHEN lo - dlon < -180 OR lo + dlon > 180 THEN 'antimeridian' END AS reason FROM c)
SELECT point_id, CASE WHEN reason IS NULL THEN round(lo - dlon, 6) END AS west, CASE WHEN reason IS NULL THEN round(la - dlat, 6) END AS south, CASE WHEN reason IS NULL THEN round(lo + dlon, 6) END AS east, CASE WHEN reason IS NULL THEN round(la + dlat, 6) END AS north, reason FROM d""")
def b24(t):
    k = F.col("point_id")
    la = F.col("lat") * F.when(k % 7 == 0, 3.6).when(k % 7 == 1, 3.45).otherwise(1.0)
    lo = F.col("lon") + F.when(k % 11 == 0, 59.5).otherwise(0.0)
    rows = t("points").select("point_id", G.gps_envelope(lo, la, F.when(k % 13 == 0, float("inf")).otherwise((k % 5) * 3e4)).alias("b"))
    return rows.select("point_id", *[R(f"b.{k}").alias(k) for k in ("west", "south", "east", "north")], "b.reason")


@query("b25_geo_distance", "SELECT point_id, round(sqrt(power((lon - 121e0) * 111412.84e0 * cos(radians((lat + 24e0) / 2)), 2) + power((lat - 24e0) * 111132.954e0, 2)), 4) AS metres FROM points")
def b25(t):
    return t("points").select("point_id", R(G.geo_distance("lon", "lat", F.lit(121.0), F.lit(24.0)), 4).alias("metres"))


@query("b27_format_duration", """SELECT event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS duration
FROM (SELECT event_id, CAST(round_even(value * 20, 0) AS BIGINT) AS s FROM detections) x""")
def b27(t):
    return t("detections").select("event_id", X.format_duration(F.col("value") * 20).alias("duration"))


@query("b28_stride_from_interval", "SELECT video_id, frame_idx, CAST(CASE WHEN frame_idx % 5 > 0 THEN greatest(round_even((frame_idx % 5) / 20e0 * fps, 0), 1) ELSE 2 END AS INT) AS stride FROM frames")
def b28(t):
    return t("frames").select("video_id", "frame_idx", X.stride_from_interval((F.col("frame_idx") % 5) / 20, "fps", F.lit(2)).alias("stride"))


@query("a08_dms_to_decimal", "SELECT photo_id, round(CASE WHEN lat_ref IN ('S', 'W') THEN -1 ELSE 1 END * (lat_d + lat_m / 60e0 + lat_s / 3600e0), 6) AS degrees FROM photo_text")
def a08(t):
    return t("photo_text").select("photo_id", R(G.dms_to_decimal("lat_d", "lat_m", "lat_s", "lat_ref")).alias("degrees"))
