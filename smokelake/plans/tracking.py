"""Queries on association, suppression and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import motion as M
from ..operators import tracking as O
from .registry import query

R = lambda c, k=6: F.round(c, k)
PAIRS = """p AS (SELECT t.video_id, d.frame_idx, t.det_idx AS track_id, d.det_idx AS det_id, t.x AS tx, t.y AS ty, t.w AS tw, t.h AS th, d.x, d.y, d.w, d.h FROM detections t JOIN detections d ON t.video_id = d.video_id AND d.frame_idx = t.frame_idx + 1),
i AS (SELECT *, CAST(greatest(least(tx + tw, x + w) - greatest(tx, x), 0) * greatest(least(ty + th, y + h) - greatest(ty, y), 0) AS DOUBLE) AS n, sqrt(power(tx + tw / 2e0 - x - w / 2e0, 2) + power(ty + th / 2e0 - y - h / 2e0, 2)) AS dist, greatest(140e0, 0.6e0 * greatest(sqrt(CAST(tw*tw + th*th AS DOUBLE)), sqrt(CAST(w*w + h*h AS DOUBLE)))) AS reach FROM p),
s AS (SELECT *, n / (tw * th + w * h - n) AS iou, 1 - n / (tw * th + w * h - n) + dist / reach AS score FROM i)"""


def _pairs(t):
    d = t("detections")
    tracks = d.select("video_id", (F.col("frame_idx") + 1).alias("frame_idx"), F.col("det_idx").alias("track_id"), *[F.col(k).alias(f"t_{k}") for k in "xywh"])
    dets = d.select("video_id", "frame_idx", F.col("det_idx").alias("det_id"), *[F.col(k).alias(f"d_{k}") for k in "xywh"])
    return O.association_pairs(tracks, dets, ["video_id", "frame_idx"])


@query("c12_association_pairs", f"WITH {PAIRS} SELECT video_id, frame_idx, track_id, det_id, round(score, 6) AS score FROM s WHERE iou >= 0.1e0 OR dist <= reach")
def c12(t):
    return _pairs(t).select("video_id", "frame_idx", "track_id", "det_id", R("score").alias("score"))


MOTION = """p AS (SELECT t.video_id, d.frame_idx, t.det_idx AS track_id, d.det_idx AS det_id, t.x AS tx, t.y AS ty, t.w AS tw, t.h AS th, d.x, d.y, d.w, d.h, t.x + t.w / 2e0 AS ax, t.y + t.h / 2e0 AS ay, d.x + d.w / 2e0 AS px, d.y + d.h / 2e0 AS py, t.det_idx % 2 = 0 AS small FROM detections t JOIN detections d ON t.video_id = d.video_id AND d.frame_idx = t.frame_idx + 1),
q AS (SELECT *, ax - 60e0 AS bx, ay - 30e0 AS by_, ax + 120e0 AS ex, ay + 60e0 AS ey, sqrt(power(ax - px, 2) + power(ay - py, 2)) AS dist, tx < x + w AND x < tx + tw AND ty < y + h AND y < ty + th AS hit FROM p),
u AS (SELECT *, least(greatest(((px - bx) * (ex - bx) + (py - by_) * (ey - by_)) / (power(ex - bx, 2) + power(ey - by_, 2)), 0e0), 1e0) AS r FROM q), z AS (SELECT *, sqrt(power(px - bx - r * (ex - bx), 2) + power(py - by_ - r * (ey - by_), 2)) AS path FROM u)"""


@query("c12_motion_pairs", f"WITH {MOTION}, s AS (SELECT *, CASE WHEN hit THEN dist / 4 WHEN small AND tw * th < 35 AND dist > 12 THEN NULL WHEN dist <= 200 THEN dist WHEN path <= 270 THEN 200 + path END AS score FROM z) SELECT video_id, frame_idx, track_id, det_id, round(score, 6) AS score FROM s WHERE score IS NOT NULL")
def c12_motion(t):
    """Every track came straight from (-60, -30), so its path carried on is one straight line to (+120, +60)."""
    d = t("detections")
    centre = F.struct((F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"))
    before = F.struct((centre["x"] - 60).alias("x"), (centre["y"] - 30).alias("y"))
    tracks = d.select("video_id", (F.col("frame_idx") + 1).alias("frame_idx"), F.col("det_idx").alias("track_id"), *[F.col(k).alias(f"t_{k}") for k in "xywh"], F.array(before, centre).alias("t_history"), (F.col("w") * F.col("h")).alias("t_area"), (F.col("det_idx") % 2 == 0).alias("t_small"))
    dets = d.select("video_id", "frame_idx", F.col("det_idx").alias("det_id"), *[F.col(k).alias(f"d_{k}") for k in "xywh"])
    return O.motion_pairs(tracks, dets, ["video_id", "frame_idx"]).select("video_id", "frame_idx", "track_id", "det_id", R("score").alias("score"))


@query("c13_greedy_assign", f"""WITH RECURSIVE {PAIRS}, c AS (SELECT video_id, frame_idx, track_id, det_id, score FROM s WHERE iou >= 0.1e0 OR dist <= reach),
r AS (SELECT DISTINCT video_id, frame_idx, CAST([] AS INT[]) AS tracks, CAST([] AS INT[]) AS dets, CAST(NULL AS INT) AS track_id, CAST(NULL AS INT) AS det_id FROM c
 UNION ALL SELECT video_id, frame_idx, list_append(tracks, b.t), list_append(dets, b.d), b.t, b.d FROM (SELECT r.video_id, r.frame_idx, r.tracks, r.dets, arg_min({{'t': c.track_id, 'd': c.det_id}}, (c.score, c.track_id, c.det_id)) AS b
  FROM r JOIN c ON c.video_id = r.video_id AND c.frame_idx = r.frame_idx WHERE NOT list_contains(r.tracks, c.track_id) AND NOT list_contains(r.dets, c.det_id) GROUP BY r.video_id, r.frame_idx, r.tracks, r.dets) x)
SELECT video_id, frame_idx, track_id, det_id FROM r WHERE track_id IS NOT NULL""")
def c13(t):
    """The twin takes the best pair that is left, again and again."""
    return O.greedy_assign(_pairs(t), ["video_id", "frame_idx"])


NMS = """q AS (SELECT a.video_id, a.frame_idx, a.cls_id, a.det_idx AS a, b.det_idx AS b, a.conf AS ca, b.conf AS cb, CAST(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS DOUBLE) AS n, a.w * a.h + b.w * b.h AS u
FROM detections a JOIN detections b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.cls_id = b.cls_id AND (a.conf > b.conf OR (a.conf = b.conf AND a.det_idx < b.det_idx))), o AS (SELECT * FROM q WHERE n / (u - n) >= 0.4e0)"""


@query("c14_nms_pairs", f"WITH {NMS} SELECT video_id, frame_idx, a AS adet, b AS bdet, round(n / (u - n), 6) AS iou FROM o")
def c14_pairs(t):
    return O.nms_pairs(t("detections"), 0.4).select("video_id", "frame_idx", "adet", "bdet", R("iou").alias("iou"))


@query("c14_nms", f"""WITH {NMS}, one AS (SELECT * FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.video_id = x.video_id AND y.frame_idx = x.frame_idx AND y.cls_id = x.cls_id AND y.b = x.a)),
two AS (SELECT * FROM o x WHERE EXISTS (SELECT 1 FROM o y WHERE y.video_id = x.video_id AND y.frame_idx = x.frame_idx AND y.cls_id = x.cls_id AND y.b = x.a) AND NOT EXISTS (SELECT 1 FROM one y WHERE y.video_id = x.video_id AND y.frame_idx = x.frame_idx AND y.cls_id = x.cls_id AND y.b = x.a))
SELECT d.event_id FROM detections d WHERE NOT EXISTS (SELECT 1 FROM one y WHERE y.video_id = d.video_id AND y.frame_idx = d.frame_idx AND y.cls_id = d.cls_id AND y.b = d.det_idx) AND NOT EXISTS (SELECT 1 FROM two y WHERE y.video_id = d.video_id AND y.frame_idx = d.frame_idx AND y.cls_id = d.cls_id AND y.b = d.det_idx)""")
def c14(t):
    """A frame has three detections at most here, so chains are two links long and the twin can follow them."""
    return O.nms(t("detections"), 0.4).select("event_id")


@query("c15_suppress_duplicates", """WITH c AS (SELECT video_id, event_id AS cand_id, frame_idx, x, y, w, h FROM detections WHERE det_idx = 0), m AS (SELECT video_id, event_id, frame_idx AS cf, x, y, w, h, CAST(round_even(least(greatest(greatest(w, h) * 0.65e0, 18e0), 60e0), 0) AS INT) AS g FROM detections WHERE conf >= 0.97e0),
j AS (SELECT c.video_id, c.cand_id, m.event_id, round(sqrt(power(c.x + c.w / 2e0 - m.x - m.w / 2e0, 2) + power(c.y + c.h / 2e0 - m.y - m.h / 2e0, 2)), 6) AS d, m.x - g < c.x + c.w AND c.x < m.x + m.w + g AND m.y - g < c.y + c.h AND c.y < m.y + m.h + g AS o,
 c.x + c.w / 2e0 AS px, c.y + c.h / 2e0 AS py, m.x + m.w / 2e0 - 60 AS bx, m.y + m.h / 2e0 - 30 AS by_ FROM c JOIN m ON c.video_id = m.video_id AND c.frame_idx > m.cf AND c.frame_idx - m.cf <= 90),
k AS (SELECT *, least(greatest(((px - bx) * 180 + (py - by_) * 90) / (180e0 * 180 + 90 * 90), 0e0), 1e0) AS r FROM j), z AS (SELECT *, sqrt(power(px - bx - r * 180, 2) + power(py - by_ - r * 90, 2)) AS path FROM k)
SELECT c.cand_id, (SELECT z.event_id FROM z WHERE z.cand_id = c.cand_id AND (o OR d <= 110 OR path <= 270) ORDER BY d, z.event_id LIMIT 1) AS source_id FROM c""")
def c15(t):
    d = t("detections")
    cands = d.filter("det_idx = 0").select("video_id", F.col("event_id").alias("cand_id"), "frame_idx", *"xywh")
    memories = d.filter("conf >= 0.97").select("video_id", "event_id", F.col("frame_idx").alias("confirm_frame"), *"xywh")
    centre = F.struct((F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"))
    memories = memories.withColumn("history", F.array(F.struct((centre["x"] - 60).alias("x"), (centre["y"] - 30).alias("y")), centre))
    return O.suppress_duplicates(cands, memories, 90).select("cand_id", "source_id")


@query("i02_track_detections")
def i02(t):
    return O.track_detections(O.tracker_input(t("frames"), t("detections").filter("conf >= 0.5")))


def _candidates(t):
    """Detections as motion candidates whose boxes grow with the frame within runs of eight; every frame has a row."""
    step = 1 + F.col("frame_idx") % 8 / 4.0
    w, h = (F.col("w") * step).cast("int"), (F.col("h") * step).cast("int")
    d = t("detections").select(
        "video_id", "frame_idx", F.col("det_idx").alias("cand_id"), "x", "y", w.alias("w"), h.alias("h"), (F.col("x") + w / 2).alias("cx"), (F.col("y") + h / 2).alias("cy"), (w * h).cast("double").alias("area"),
        (0.5 + F.col("conf") / 2).alias("polarity"), F.col("conf").alias("coherence"), F.lit(0.7).alias("fill"), (1 + 3 * F.col("conf")).alias("snr"), F.lit(30.0).alias("mean_abs_delta"), F.lit(5.0).alias("noise"), (1 - F.col("conf")).alias("prior_overlap"),
        (F.col("det_idx") % 2 == 0).alias("small"), F.lit(False).alias("edge"), F.when(F.col("det_idx") % 3 > 0, F.col("conf")).alias("outward"), F.lit(9).alias("vectors"),
    )
    frames = t("frames").select("video_id", "frame_idx", (F.col("sharpness") > 20).alias("measured"))
    return frames.join(d, ["video_id", "frame_idx"], "left").select(*[c.split()[0] for c in M.CANDIDATE.split(", ")])


@query("i03_track_candidates")
def i03(t):
    return M.track_candidates(_candidates(t))


@query("i03_ended_events")
def i03_ended(t):
    return M.ended_events(_candidates(t))


@query("i04_event_memory")
def i04(t):
    return M.event_memories(_candidates(t))


@query("i05_throttle", """WITH RECURSIVE r AS (SELECT video_id, min(frame_idx) AS frame_idx FROM frames GROUP BY video_id
UNION ALL SELECT r.video_id, min(f.frame_idx) FROM r JOIN frames f ON f.video_id = r.video_id AND f.frame_idx >= r.frame_idx + 30 GROUP BY r.video_id, r.frame_idx) SELECT video_id, frame_idx FROM r""")
def i05(t):
    return O.throttle(t("frames").select("video_id", "frame_idx"), "video_id", "frame_idx", 30)


#: At 30 frames a second: a link a second apart at most, a map check after five, no fix older than 15.
@query("i06_pose_status", """WITH RECURSIVE r AS (SELECT DISTINCT video_id, -1 AS frame_idx, 'LOST' AS status, -1000 AS link, -1000 AS looked, CAST(NULL AS INT) AS fix FROM poses
UNION ALL SELECT video_id, f, CASE WHEN ok AND NOT coalesce(f - fix2 > 450, false) THEN 'VO_TRACKING' ELSE 'LOST' END, link1, looked1, fix2 FROM (SELECT *, CASE WHEN due AND map_corrected THEN f ELSE fix1 END AS fix2, CASE WHEN due THEN f ELSE looked END AS looked1 FROM (SELECT *, ok AND f - looked >= 150 AS due, CASE WHEN tried THEN f ELSE link END AS link1,
 CASE WHEN tried THEN f ELSE fix END AS fix1 FROM (SELECT p.video_id, p.frame_idx AS f, p.map_corrected, r.link, r.looked, r.fix, r.status = 'LOST' AND p.frame_idx - r.link >= 30 AS tried, CASE WHEN r.status = 'LOST' THEN p.frame_idx - r.link >= 30 ELSE p.pose_ok END AS ok FROM r JOIN poses p ON p.video_id = r.video_id AND p.frame_idx = r.frame_idx + 1) a) b) c)
SELECT video_id, frame_idx, status FROM r WHERE frame_idx >= 0""")
def i06(t):
    rows = t("poses").select("video_id", "frame_idx", "pose_ok", "map_corrected")
    return O.pose_status(rows.select("video_id", "frame_idx", F.lit(True).alias("link_ok"), F.col("pose_ok").alias("klt_ok"), F.col("map_corrected").alias("correction_ok")), 30.0)


@query("i10_camera_timeout", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER c < INTERVAL 600 SECONDS THEN 0 ELSE 1 END AS new FROM captures WINDOW c AS (PARTITION BY camera_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY camera_id ORDER BY ts) AS session FROM g)
SELECT camera_id, CAST(epoch_us(min(ts)) AS BIGINT) AS started_us, count(*) AS frames FROM s GROUP BY camera_id, session""")
def i10(t):
    return O.outages(t("captures"), 600).select("camera_id", F.unix_micros("started").alias("started_us"), "frames")


@query("i01_latest_frame", "SELECT camera_id, slot, max(camera_frame_id) AS camera_frame_id, count(*) - 1 AS replaced FROM (SELECT *, CAST(floor(floor(epoch(ts)) / 600) AS BIGINT) AS slot FROM captures) x GROUP BY camera_id, slot")
def i01(t):
    return O.latest_frames(t("captures"), 600).select("camera_id", "slot", "camera_frame_id", "replaced")


@query("i11_dedupe_frames", "SELECT DISTINCT camera_id, camera_frame_id % 2000 AS frame_id FROM captures")
def i11(t):
    return t("captures").select("camera_id", (F.col("camera_frame_id") % 2000).alias("frame_id")).dropDuplicates(["camera_id", "frame_id"])
