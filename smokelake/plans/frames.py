"""Queries on frames, tracks, the camera guard and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as O
from .registry import query

R = lambda c, k=6: F.round(c, k)
TRACK, ORDER = ["video_id", "cls_id"], ["frame_idx", "det_idx"]
#: Detections of a class in a video as observations of one track.
OBS = "observations AS (SELECT *, CAST(w * h AS DOUBLE) AS area FROM detections)"
W = "PARTITION BY video_id, cls_id ORDER BY frame_idx, det_idx"


def _obs(t):
    return t("detections").withColumn("area", (F.col("w") * F.col("h")).cast("double"))


@query("a01_frame_range", "SELECT video_id, frame_idx, sharpness FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS n FROM frames WHERE frame_idx >= 5) x WHERE n <= 100")
def a01(t):
    return O.frame_range(t("frames"), 5, 100).select("video_id", "frame_idx", "sharpness")


@query("a02_sample_interval", "SELECT video_id, min(frame_idx) AS frame_idx FROM frames GROUP BY video_id, floor((frame_idx / fps + 1e-9) / 0.5e0)")
def a02(t):
    return O.sample_interval(t("frames"), 0.5).select("video_id", "frame_idx")


@query("a03_stride_frames", "SELECT f.video_id, f.frame_idx FROM frames f JOIN (SELECT video_id, min(frame_idx) AS m FROM frames GROUP BY video_id) g ON f.video_id = g.video_id WHERE (f.frame_idx - m) % 3 = 0")
def a03(t):
    return O.stride_frames(t("frames"), 3).select("video_id", "frame_idx")


@query("a15_run_summary", """SELECT f.video_id, count(*) AS processed_frames, max(coalesce(e.n, 0)) AS events, 2 * max(coalesce(e.n, 0)) AS snapshots
FROM frames f LEFT JOIN (SELECT video_id, count(*) AS n FROM detections WHERE conf >= 0.9e0 GROUP BY video_id) e ON f.video_id = e.video_id GROUP BY f.video_id""")
def a15(t):
    return O.run_summary(t("frames"), t("detections").filter("conf >= 0.9"))


@query("e01_short_growth", f"""WITH {OBS} SELECT event_id, round(CASE WHEN n = 1 THEN 1e0 ELSE area / greatest(coalesce(a3, a0), 1e0) END, 6) AS short_growth, round(coalesce(area / greatest(a1, 1e0), 1e0), 6) AS instant_growth
FROM (SELECT event_id, area, row_number() OVER t AS n, lag(area, 3) OVER t AS a3, first_value(area) OVER t AS a0, lag(area, 1) OVER t AS a1 FROM observations WINDOW t AS ({W})) x""")
def e01(t):
    rows = O.short_growth(_obs(t), TRACK, ORDER)
    return rows.select("event_id", R("short_growth").alias("short_growth"), R("instant_growth").alias("instant_growth"))


@query("e02_running_evidence", f"""WITH {OBS}, g AS (SELECT *, value AS delta, 5e0 AS noise, conf AS growth FROM observations)
SELECT event_id, round(sum(area * greatest(delta - noise, 0e0)) OVER t, 3) AS signal, max(growth) OVER t AS peak_growth, count(*) OVER t AS observations
FROM g WINDOW t AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def e02(t):
    rows = _obs(t).withColumns({"delta": F.col("value"), "noise": F.lit(5.0), "growth": F.col("conf")})
    return O.running_evidence(rows, TRACK, ORDER).select("event_id", R("signal", 3).alias("signal"), "peak_growth", "observations")


@query("e03_expansion_check", f"""WITH p AS (SELECT *, lag(x) OVER t AS px, lag(y) OVER t AS py, lag(w) OVER t AS pw, lag(h) OVER t AS ph FROM detections WINDOW t AS ({W})),
g AS (SELECT event_id, greatest(w, 1) / CAST(greatest(pw, 1) AS DOUBLE) AS gw, greatest(h, 1) / CAST(greatest(ph, 1) AS DOUBLE) AS gh,
  sqrt(power(x + w / 2e0 - px - pw / 2e0, 2) + power(y + h / 2e0 - py - ph / 2e0, 2)) / greatest(0.5e0 * (sqrt(power(greatest(w, 1), 2) + power(greatest(h, 1), 2)) + sqrt(power(greatest(pw, 1), 2) + power(greatest(ph, 1), 2))), 1e0) AS shift, pw FROM p)
SELECT event_id, CASE WHEN pw IS NULL THEN NULL ELSE round(gw, 6) END AS growth_w, CASE WHEN pw IS NULL THEN NULL ELSE round(gh, 6) END AS growth_h, CASE WHEN pw IS NULL THEN NULL ELSE round(least(gw, gh) / greatest(gw, gh, 1e-6), 6) END AS balance,
  CASE WHEN pw IS NULL THEN NULL ELSE round(shift, 6) END AS shift, pw IS NOT NULL AND least(gw, gh) >= 1.08e0 AND least(gw, gh) / greatest(gw, gh, 1e-6) >= 0.55e0 AND shift <= 0.65e0 AS expanding FROM g""")
def e03(t):
    rows = O.expansion_check(t("detections"), TRACK, ORDER)
    known = F.col("shift").isNotNull()
    return rows.select("event_id", *[F.when(known, R(c)).alias(c) for c in ("growth_w", "growth_h", "balance", "shift")], "expanding")


@query("e04_non_growth_streak", f"""WITH {OBS}, s AS (SELECT event_id, video_id, cls_id, frame_idx, det_idx, coalesce(area / greatest(lag(area) OVER t, 1e0), 1e0) < 1.08e0 AS bad,
  row_number() OVER t AS n FROM observations WINDOW t AS ({W}))
SELECT event_id, CASE WHEN bad THEN n - coalesce(max(CASE WHEN NOT bad THEN n END) OVER (PARTITION BY video_id, cls_id ORDER BY n), 0) ELSE 0 END AS streak FROM s""")
def e04(t):
    rows = O.short_growth(_obs(t), TRACK, ORDER)
    return O.streak(rows, TRACK, ORDER, F.col("instant_growth") < 1.08).select("event_id", "streak")


SIGNS = "signs AS (SELECT DISTINCT video_id, cls_id, frame_idx FROM detections WHERE conf >= 0.75e0)"


@query("e05_confirmation_hits", f"""WITH {SIGNS}, g AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER s > 3 OR lag(frame_idx) OVER s IS NULL THEN frame_idx END AS start FROM signs WINDOW s AS (PARTITION BY video_id, cls_id ORDER BY frame_idx)),
h AS (SELECT *, max(start) OVER (PARTITION BY video_id, cls_id ORDER BY frame_idx) AS first FROM g)
SELECT video_id, cls_id, frame_idx, row_number() OVER (PARTITION BY video_id, cls_id, first ORDER BY frame_idx) AS hits FROM h""")
def e05(t):
    signs = t("detections").filter("conf >= 0.75").select("video_id", "cls_id", "frame_idx").distinct()
    return O.confirmation_hits(signs, TRACK).drop("session")


GUARDED = """s AS (SELECT *, sharpness / greatest(lag(sharpness, 2) OVER (PARTITION BY video_id ORDER BY frame_idx), 1e-6) AS focus FROM alignments),
r AS (SELECT video_id, frame_idx, CASE WHEN sqrt(dx * dx + dy * dy) > 6e0 THEN 'camera_translation' WHEN abs(rotation_deg) > 0.2e0 THEN 'camera_rotation'
  WHEN abs(scale - 1) > 0.008e0 THEN 'camera_zoom' WHEN focus < 0.65e0 OR focus > 1.55e0 THEN 'focus_change' WHEN residual_ratio > 0.1e0 THEN 'global_residual' END AS reason,
  row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS n FROM s WHERE align_ok)"""


@query("e06_camera_guard", f"""WITH {GUARDED} SELECT a.video_id, a.frame_idx, a.reason, EXISTS (SELECT 1 FROM r b WHERE b.video_id = a.video_id AND b.n BETWEEN a.n - 4 AND a.n AND b.reason IS NOT NULL) AS blocked FROM r a""")
def e06(t):
    return O.camera_guard(t("alignments")).select("video_id", "frame_idx", "reason", "blocked")


@query("d15_guard_summary", f"WITH {GUARDED} SELECT video_id, reason, count(*) AS frames FROM r WHERE reason IS NOT NULL GROUP BY video_id, reason")
def d15(t):
    return O.guard_summary(O.camera_guard(t("alignments")))


@query("e07_focus_ratio", "SELECT video_id, frame_idx, round(sharpness / greatest(lag(sharpness, 2) OVER (PARTITION BY video_id ORDER BY frame_idx), 1e-6), 6) * CASE WHEN row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) > 2 THEN 1 END AS focus_ratio FROM frames")
def e07(t):
    return O.focus_ratio(t("frames"), 2).select("video_id", "frame_idx", F.when(F.row_number().over(O.Window.partitionBy("video_id").orderBy("frame_idx")) > 2, R("focus_ratio")).alias("focus_ratio"))


@query("d16_heartbeat", """WITH c AS (SELECT *, epoch_us(ts) / 1e6 AS s, CAST(floor((row_number() OVER (PARTITION BY camera_id ORDER BY ts, camera_frame_id) - 1) / 30e0) AS BIGINT) AS block FROM captures),
b AS (SELECT camera_id, block, count(*) AS n, min(s) AS t0, max(s) AS t1, avg(detector_ms) AS ms, min(camera_frame_id) AS i0, max(camera_frame_id) AS i1 FROM c GROUP BY camera_id, block HAVING count(*) = 30)
SELECT camera_id, block, (block + 1) * 30 AS processed, round((block + 1) * 30 / greatest(t1 - min(t0) OVER (PARTITION BY camera_id), 1e-6), 6) AS overall_fps,
round(n / greatest(t1 - t0, 1e-6), 6) AS interval_fps, round(ms, 6) AS mean_ms, greatest(i1 - i0 + 1 - n, 0) AS skipped FROM b""")
def d16(t):
    rows = O.heartbeat(t("captures"), 30)
    return rows.select("camera_id", "block", "processed", R("overall_fps").alias("overall_fps"), R("interval_fps").alias("interval_fps"), R("mean_ms").alias("mean_ms"), "skipped")


@query("e11_map_fix_age", """SELECT p.video_id, p.frame_idx, p.frame_idx - max(q.frame_idx) AS age_frames, round((p.frame_idx - max(q.frame_idx)) / 30e0, 6) AS age_sec,
coalesce(p.frame_idx - max(q.frame_idx) <= 450, false) AS tracking_valid FROM poses p LEFT JOIN poses q ON p.video_id = q.video_id AND q.map_corrected AND q.frame_idx <= p.frame_idx GROUP BY p.video_id, p.frame_idx""")
def e11(t):
    return O.map_fix_age(t("poses"), 30.0).select("video_id", "frame_idx", "age_frames", R("age_sec").alias("age_sec"), "tracking_valid")


@query("e12_trajectory", """WITH f AS (SELECT *, first_value(lon) OVER v AS lon0, first_value(lat) OVER v AS lat0 FROM poses WHERE pose_ok WINDOW v AS (PARTITION BY video_id ORDER BY frame_idx)),
p AS (SELECT video_id, frame_idx, radians(lon - lon0) * 6378137e0 * cos(radians(lat0)) AS e, radians(lat - lat0) * 6378137e0 AS n FROM f),
s AS (SELECT *, coalesce(sqrt(power(e - lag(e) OVER v, 2) + power(n - lag(n) OVER v, 2)), 0e0) AS step FROM p WINDOW v AS (PARTITION BY video_id ORDER BY frame_idx))
SELECT video_id, frame_idx, round(e, 4) AS east, round(n, 4) AS north, round(step, 4) AS step_m, round(sum(step) OVER (PARTITION BY video_id ORDER BY frame_idx), 4) AS path_m FROM s""")
def e12(t):
    return O.trajectory(t("poses")).select("video_id", "frame_idx", *[R(c, 4).alias(c) for c in ("east", "north", "step_m", "path_m")])


@query("e14_fb_consistency", "SELECT video_id, candidate_id, count(*) AS vectors, CAST(sum(CASE WHEN fb_error < 1e0 THEN 1 ELSE 0 END) AS BIGINT) AS tracked, round(avg(CASE WHEN fb_error < 1e0 THEN 1e0 ELSE 0e0 END), 6) AS share FROM flow_vectors GROUP BY video_id, candidate_id")
def e14(t):
    return O.fb_consistency(t("flow_vectors"), ["video_id", "candidate_id"]).withColumn("share", R("share"))


@query("f03_evict_oldest", "SELECT video_id, event_id, last_update FROM (SELECT video_id, event_id, frame_idx AS last_update, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx DESC, frame_idx DESC, event_id DESC) AS n FROM detections WHERE conf >= 0.9e0) x WHERE n <= 12")
def f03(t):
    memories = t("detections").filter("conf >= 0.9").select("video_id", "event_id", F.col("frame_idx").alias("last_update"), F.col("frame_idx").alias("confirm_frame"))
    return O.evict_oldest(memories).select("video_id", "event_id", "last_update")
