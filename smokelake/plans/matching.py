"""Queries on image matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.geo import det3
from ..operators import matching as O
from .registry import query

R = lambda c, k=6: F.round(c, k)


@query("c16_match_descriptors", """WITH q AS (SELECT vec_id % 10 AS pair, vec_id, embedding FROM embeddings WHERE vec_id % 2 = 0), r AS (SELECT (vec_id // 2) % 10 AS pair, vec_id, embedding FROM embeddings WHERE vec_id % 2 = 1),
d AS (SELECT q.pair, q.vec_id AS query_id, r.vec_id AS train_id, sqrt(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))) AS d FROM q JOIN r ON q.pair = r.pair),
n AS (SELECT *, row_number() OVER w AS n, lead(d) OVER w AS d2 FROM d WINDOW w AS (PARTITION BY pair, query_id ORDER BY d, train_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY pair, train_id ORDER BY d, query_id) AS m FROM n WHERE n = 1 AND d < 0.97e0 * d2)
SELECT pair, query_id, train_id, round(d, 5) AS distance FROM m WHERE m = 1""")
def c16(t):
    e = t("embeddings")
    q = e.filter("vec_id % 2 = 0").select((F.col("vec_id") % 10).alias("pair"), "vec_id", "embedding")
    r = e.filter("vec_id % 2 = 1").select((F.floor(F.col("vec_id") / 2) % 10).alias("pair"), "vec_id", "embedding")
    return O.match_descriptors(q, r, 0.97).withColumn("distance", R("distance", 5))


@query("b26_refine_dense_match", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
a AS (SELECT vec_id, 320 + 600 * e[1] AS p1, 240 + 500 * e[2] AS p2, 320 + 600 * e[3] AS p3, 240 + 500 * e[4] AS p4, e[5] AS o1, e[6] AS o2, e[7] AS o3, e[8] AS o4, abs(e[9]) AS f, abs(e[10]) AS g, abs(e[11]) * 4 AS c FROM v),
m AS (SELECT vec_id, f, g, c, CASE WHEN f >= g THEN p1 ELSE p1 + 8 * o3 END AS ax, CASE WHEN f >= g THEN p2 ELSE p2 + 8 * o4 END AS ay, CASE WHEN f >= g THEN p3 + 8 * o1 ELSE p3 END AS bx, CASE WHEN f >= g THEN p4 + 8 * o2 ELSE p4 END AS by_ FROM a)
SELECT vec_id, round((ax + 0.5e0) * 1280 / 640 - 0.5e0, 4) AS ax, round((ay + 0.5e0) * 720 / 480 - 0.5e0, 4) AS ay, round((bx + 0.5e0) * 1600 / 640 - 0.5e0, 4) AS bx, round((by_ + 0.5e0) * 1600 / 480 - 0.5e0, 4) AS by_, round(c, 6) AS confidence
FROM m WHERE c > 0.2e0 AND greatest(f, g) > 1e-6 AND ax >= 16 AND ay >= 16 AND ax < 624 AND ay < 464 AND bx >= 16 AND by_ >= 16 AND bx < 624 AND by_ < 464""")
def b26(t):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    raw = F.array(320 + 600 * e(0), 240 + 500 * e(1), 320 + 600 * e(2), 240 + 500 * e(3), e(4), e(5), e(6), e(7), F.abs(e(8)), F.abs(e(9)), F.abs(e(10)) * 4)
    rows = t("embeddings").select("vec_id", raw.alias("raw")).select("vec_id", O.refine_dense("raw", 8, (640, 480), (1280, 720), (1600, 1600)).alias("m")).filter("m IS NOT NULL")
    return rows.select("vec_id", R("m.ax", 4).alias("ax"), R("m.ay", 4).alias("ay"), R("m.bx", 4).alias("bx"), R("m.by", 4).alias("by_"), R("m.confidence").alias("confidence"))


@query("d07_radial_flow", """WITH v AS (SELECT video_id, candidate_id, (dx * rx + dy * ry) / (sqrt(dx*dx + dy*dy) * sqrt(rx*rx + ry*ry)) AS c FROM flow_vectors WHERE sqrt(dx*dx + dy*dy) >= 0.7e0 AND sqrt(rx*rx + ry*ry) > 1e-6)
SELECT video_id, candidate_id % 50 AS bin, count(*) AS valid_vectors, CASE WHEN count(*) >= 8 THEN round(avg(CASE WHEN c > 0.35e0 THEN 1e0 ELSE 0e0 END), 6) END AS outward_ratio, CASE WHEN count(*) >= 8 THEN round(avg(c), 6) END AS mean_cosine FROM v GROUP BY video_id, candidate_id % 50""")
def d07(t):
    rows = O.radial_flow(t("flow_vectors").withColumn("bin", F.col("candidate_id") % 50), ["video_id", "bin"])
    return rows.withColumns({"outward_ratio": R("outward_ratio"), "mean_cosine": R("mean_cosine")})


FIT = """SELECT pair_id, count(*) AS n, (sum(ax*bx + ay*by_) - count(*) * (avg(ax)*avg(bx) + avg(ay)*avg(by_))) / (sum(ax*ax + ay*ay) - count(*) * (power(avg(ax), 2) + power(avg(ay), 2))) AS a,
(sum(ax*by_ - ay*bx) - count(*) * (avg(ax)*avg(by_) - avg(ay)*avg(bx))) / (sum(ax*ax + ay*ay) - count(*) * (power(avg(ax), 2) + power(avg(ay), 2))) AS b, avg(ax) AS mx, avg(ay) AS my, avg(bx) AS ux, avg(by_) AS uy FROM {src} GROUP BY pair_id"""
GOOD = "good AS (SELECT * FROM correspondences WHERE bx <> ay)"
MODEL = f"{GOOD}, f AS ({FIT.format(src='good')}), model AS (SELECT *, ux - a*mx + b*my AS dx, uy - b*mx - a*my AS dy FROM f)"


@query("d12_fit_similarity", f"WITH {MODEL} SELECT pair_id, n, round(sqrt(a*a + b*b), 6) AS scale, round(degrees(atan2(b, a)), 6) AS rotation_deg, round(dx, 3) AS dx, round(dy, 3) AS dy FROM model")
def d12(t):
    rows = O.fit_similarity(t("correspondences").filter("bx <> ay"))
    return rows.select("pair_id", "n", R("scale").alias("scale"), R("rotation_deg").alias("rotation_deg"), R("dx", 3).alias("dx"), R("dy", 3).alias("dy"))


QUALITY = f"""{MODEL}, e AS (SELECT c.pair_id, sqrt(power(a*ax - b*ay + dx - bx, 2) + power(b*ax + a*ay + dy - by_, 2)) AS e FROM correspondences c JOIN model m ON c.pair_id = m.pair_id),
q AS (SELECT pair_id, count(*) AS matches, CAST(sum(CASE WHEN e <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS inliers, sqrt(avg(CASE WHEN e <= 3 THEN e*e END)) AS rmse FROM e GROUP BY pair_id)"""


def _quality(t):
    return O.match_quality(t("correspondences"), O.fit_similarity(t("correspondences").filter("bx <> ay")), 3.0)


@query("d08_match_quality", f"WITH {QUALITY} SELECT pair_id, matches, inliers, round(rmse, 5) AS rmse, round(inliers / CAST(matches AS DOUBLE), 6) AS inlier_ratio FROM q")
def d08(t):
    return _quality(t).select("pair_id", "matches", "inliers", R("rmse", 5).alias("rmse"), R("inlier_ratio").alias("inlier_ratio"))


@query("d12_similarity_gates", f"""WITH {QUALITY}, g AS (SELECT q.*, sqrt(m.a*m.a + m.b*m.b) * (1 + (q.pair_id % 5) / 20e0) AS scale, degrees(atan2(m.b, m.a)) + q.pair_id % 13 AS rot, inliers / CAST(greatest(matches, 1) AS DOUBLE) AS ratio FROM q JOIN model m ON q.pair_id = m.pair_id)
SELECT pair_id, CASE WHEN inliers < 15 THEN 'inliers' WHEN ratio < 0.35e0 THEN 'ratio' WHEN abs(rot) > 12 THEN 'rotation' END AS motion, CASE WHEN inliers < 15 THEN 'inliers' WHEN ratio < 0.4e0 THEN 'ratio' WHEN scale < 0.85e0 OR scale > 1.15e0 THEN 'scale' WHEN abs(rot) > 10 THEN 'rotation' END AS learned FROM g""")
def d12_gates(t):
    """Scale and rotation are pulled apart by the pair's number, so that every gate has something to refuse."""
    k = F.col("pair_id")
    fits = _quality(t).join(O.fit_similarity(t("correspondences").filter("bx <> ay")).select("pair_id", "scale", "rotation_deg"), "pair_id")
    fits = fits.withColumns({"scale": F.col("scale") * (1 + k % 5 / 20.0), "rotation_deg": F.col("rotation_deg") + k % 13})
    both = O.similarity_gate(O.similarity_gate(fits).withColumnRenamed("reason", "motion"), O.LEARNED_GATES)
    return both.select("pair_id", "motion", F.col("reason").alias("learned"))


#: Hulls by a march along them: from the leftmost point the next one is that of the least (or greatest) slope, the farthest on ties.
HULL = """m{n} AS (SELECT pair_id, ax, min(ay) AS lo, max(ay) AS hi FROM {src} GROUP BY pair_id, ax), e{n} AS (SELECT pair_id, min(ax) AS x0, max(ax) AS x1 FROM m{n} GROUP BY pair_id),
low{n} AS (SELECT m.pair_id, m.ax AS x, m.lo AS y, 0e0 AS part FROM m{n} m JOIN e{n} e ON m.pair_id = e.pair_id AND m.ax = e.x0
 UNION ALL SELECT l.pair_id, arg_min(m.ax, ((m.lo - l.y) / (m.ax - l.x), -m.ax)), arg_min(m.lo, ((m.lo - l.y) / (m.ax - l.x), -m.ax)), arg_min((m.ax - l.x) * (m.lo + l.y) / 2, ((m.lo - l.y) / (m.ax - l.x), -m.ax)) FROM low{n} l JOIN m{n} m ON m.pair_id = l.pair_id AND m.ax > l.x GROUP BY l.pair_id, l.x, l.y),
top{n} AS (SELECT m.pair_id, m.ax AS x, m.hi AS y, 0e0 AS part FROM m{n} m JOIN e{n} e ON m.pair_id = e.pair_id AND m.ax = e.x0
 UNION ALL SELECT l.pair_id, arg_max(m.ax, ((m.hi - l.y) / (m.ax - l.x), m.ax)), arg_max(m.hi, ((m.hi - l.y) / (m.ax - l.x), m.ax)), arg_max((m.ax - l.x) * (m.hi + l.y) / 2, ((m.hi - l.y) / (m.ax - l.x), m.ax)) FROM top{n} l JOIN m{n} m ON m.pair_id = l.pair_id AND m.ax > l.x GROUP BY l.pair_id, l.x, l.y),
hull{n} AS (SELECT t.pair_id, (t.part - l.part) / (640e0 * 480e0) AS coverage FROM (SELECT pair_id, sum(part) AS part FROM top{n} GROUP BY pair_id) t JOIN (SELECT pair_id, sum(part) AS part FROM low{n} GROUP BY pair_id) l ON t.pair_id = l.pair_id)"""

#: Homographies of every kind: none, flattened, scaled far up or down, tilted, with corners before and behind, and similarities.
KINDS = """CASE pair_id % 17 WHEN 0 THEN NULL ELSE [a * z, -b * z, dx, b * z * f, a * z * f, dy, p, q, 1e0] END AS h FROM (SELECT *, CASE WHEN pair_id % 17 = 1 THEN 1e-8 ELSE 1e0 END AS f, CASE WHEN pair_id % 17 = 2 THEN 6e0 WHEN pair_id % 17 = 3 THEN 5e-3 ELSE 1e0 END AS z,
CASE WHEN pair_id % 17 = 4 THEN -4e-3 WHEN pair_id % 17 = 5 THEN 1e-6 WHEN pair_id % 17 = 6 THEN -1 / 639e0 ELSE 0e0 END AS p, CASE WHEN pair_id % 17 = 7 THEN -3e-3 WHEN pair_id % 17 = 5 THEN -1e-6 ELSE 0e0 END AS q FROM model) x"""


def _homographies(t):
    k = F.col("pair_id") % 17
    pick = lambda other, **cases: reduce(lambda w, c: w.when(k == int(c[0][1:]), F.lit(c[1])), cases.items(), F).otherwise(F.lit(other))
    f, z, p, q = pick(1.0, k1=1e-8), pick(1.0, k2=6.0, k3=5e-3), pick(0.0, k4=-4e-3, k5=1e-6, k6=-1 / 639.0), pick(0.0, k7=-3e-3, k5=-1e-6)
    a, b = F.col("a"), F.col("b")
    h = F.array(a * z, -b * z, F.col("dx"), b * z * f, a * z * f, F.col("dy"), p, q, F.lit(1.0))
    return O.fit_similarity(t("correspondences").filter("bx <> ay")).select("pair_id", F.when(k != 0, h).alias("h"))


VERIFY = f"""{MODEL}, hs AS (SELECT pair_id, {KINDS}),
er AS (SELECT c.*, sqrt(power((h[1] * ax + h[2] * ay + h[3]) / w - bx, 2) + power((h[4] * ax + h[5] * ay + h[6]) / w - by_, 2)) AS e FROM (SELECT c.*, h, CASE WHEN abs(h[7] * ax + h[8] * ay + h[9]) > 1e-10 THEN h[7] * ax + h[8] * ay + h[9] END AS w FROM correspondences c JOIN hs ON c.pair_id = hs.pair_id) c),
ins AS (SELECT * FROM er WHERE e <= 3), q AS (SELECT pair_id, count(*) AS matches, CAST(sum(CASE WHEN e <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS inliers, sqrt(avg(CASE WHEN e <= 3 THEN e * e END)) AS rmse FROM er GROUP BY pair_id),
{HULL.format(n='i', src='ins')},
co AS (SELECT pair_id, k, h[7] * x + h[8] * y + h[9] AS d, CAST(CAST((h[1] * x + h[2] * y + h[3]) / (h[7] * x + h[8] * y + h[9]) AS FLOAT) AS DOUBLE) AS u, CAST(CAST((h[4] * x + h[5] * y + h[6]) / (h[7] * x + h[8] * y + h[9]) AS FLOAT) AS DOUBLE) AS v
 FROM hs, (VALUES (0, 0e0, 0e0), (1, 639e0, 0e0), (2, 639e0, 479e0), (3, 0e0, 479e0)) c(k, x, y) WHERE h IS NOT NULL),
tu AS (SELECT a.pair_id, (b.u - a.u) * (c.v - b.v) - (b.v - a.v) * (c.u - b.u) AS turn, a.u * b.v - b.u * a.v AS part, a.d FROM co a JOIN co b ON a.pair_id = b.pair_id AND b.k = (a.k + 1) % 4 JOIN co c ON a.pair_id = c.pair_id AND c.k = (a.k + 2) % 4),
fp AS (SELECT pair_id, min(abs(d)) > 1e-8 AND (min(d) > 0 OR max(d) < 0) AS in_front, min(turn) > 0 OR max(turn) < 0 AS convex, abs(sum(part)) / 2 AS area FROM tu GROUP BY pair_id)"""


@query("d10_footprint", f"WITH RECURSIVE {VERIFY} SELECT pair_id, in_front, CASE WHEN in_front THEN convex END AS convex, CASE WHEN in_front THEN round(area, 1) END AS area FROM fp")
def d10_footprint(t):
    """Of corners that are not all in front there is no ring to speak of."""
    rows = _homographies(t).filter("h IS NOT NULL").select("pair_id", O.footprint("h", 640, 480).alias("f"))
    return rows.select("pair_id", "f.in_front", F.when(F.col("f.in_front"), F.col("f.convex")).alias("convex"), F.when(F.col("f.in_front"), R("f.area", 1)).alias("area"))


@query("d10_verify_match", f"""WITH RECURSIVE {VERIFY}, g AS (SELECT q.*, inliers / CAST(matches AS DOUBLE) AS ratio, coalesce(i.coverage, 0e0) AS coverage, coalesce(in_front AND convex AND area > 16 AND area <= 4 * 400000, false) AS sound, h IS NULL AS none,
 h[1] * (h[5] * h[9] - h[6] * h[8]) - h[2] * (h[4] * h[9] - h[6] * h[7]) + h[3] * (h[4] * h[8] - h[5] * h[7]) AS det FROM q JOIN hs ON hs.pair_id = q.pair_id LEFT JOIN hulli i ON i.pair_id = q.pair_id LEFT JOIN fp ON fp.pair_id = q.pair_id),
r AS (SELECT *, CASE WHEN matches < 16 THEN 'insufficient_matches' WHEN none THEN 'homography_failed' WHEN inliers < 16 OR ratio < 0.35e0 OR abs(det) < 1e-12 THEN 'insufficient_inliers' WHEN NOT sound OR coverage < 0.02e0 OR coalesce(rmse > 2.5e0, true) THEN 'geometry_rejected' ELSE 'accepted' END AS reason FROM g),
c AS (SELECT *, CASE WHEN reason IN ('accepted', 'geometry_rejected') THEN coalesce(ratio * least(1e0, inliers / 32e0) / (1 + rmse), 0e0) ELSE 0e0 END AS confidence FROM r)
SELECT pair_id, reason, round(coverage, 5) AS coverage, round(confidence, 5) AS confidence, round(inliers * confidence, 3) AS score FROM c""")
def d10(t):
    """With the production gates: inliers and error under the homography, the hull of the inliers, and the footprint of the frame."""
    models, corr = _homographies(t), t("correspondences")
    shape = models.select("pair_id", O.footprint_valid("h", 640, 480, 400000.0).alias("valid_geometry"), det3("h").alias("det"))
    covered = O.hull_coverage(O.inliers_of(corr, models, 3.0), 640, 480)
    rows = O.match_quality(corr, models, 3.0).join(shape, "pair_id").join(covered, "pair_id", "left")
    rows = O.verify_match(rows.withColumn("coverage", F.coalesce("coverage", F.lit(0.0))))
    return rows.select("pair_id", "reason", R("coverage", 5).alias("coverage"), R("confidence", 5).alias("confidence"), R("score", 3).alias("score"))


@query("d09_hull_coverage", f"WITH RECURSIVE {HULL.format(n='a', src='correspondences')} SELECT pair_id, round(coverage, 6) AS coverage FROM hulla")
def d09(t):
    return O.hull_coverage(t("correspondences"), 640, 480).withColumn("coverage", R("coverage"))


@query("d11_best_match", """SELECT stage, match_id, inliers AS score FROM (SELECT *, row_number() OVER (PARTITION BY stage, match_id % 100 ORDER BY inliers DESC, match_id) AS n FROM match_log WHERE reason = 'accepted' AND matches % 7 > 0 AND match_id % 5 > 0) x WHERE n = 1""")
def d11(t):
    rows = t("match_log").withColumns({"accepted": F.col("reason") == "accepted", "centre_covered": F.col("matches") % 7 > 0, "centre_near": F.col("match_id") % 5 > 0, "score": F.col("inliers"), "place": F.col("match_id")})
    return O.best_match(rows.withColumn("group", F.concat_ws(":", "stage", (F.col("match_id") % 100).cast("string"))), "group").select("stage", "match_id", "score")


HYP = f"""n AS (SELECT pair_id, count(*) AS n FROM correspondences GROUP BY pair_id), h AS (SELECT pair_id, n, unnest(range(0, 12)) AS h FROM n), ij AS (SELECT *, 1 + (7 * h) % n AS i, 1 + (11 * h + n // 2) % n AS j FROM h),
two AS (SELECT ij.pair_id, ij.h, p.ax AS ax, p.ay AS ay, p.bx AS bx, p.by_ AS by_, q.ax - p.ax AS ex, q.ay - p.ay AS ey, q.bx - p.bx AS fx, q.by_ - p.by_ AS fy FROM ij JOIN correspondences p ON ij.pair_id = p.pair_id AND ij.i = p.corr_id JOIN correspondences q ON ij.pair_id = q.pair_id AND ij.j = q.corr_id WHERE i <> j),
ab AS (SELECT *, (ex*fx + ey*fy) / (ex*ex + ey*ey) AS a, (ex*fy - ey*fx) / (ex*ex + ey*ey) AS b FROM two WHERE ex*ex + ey*ey > 1e-9), mo AS (SELECT pair_id, h, a, b, bx - a*ax + b*ay AS dx, by_ - b*ax - a*ay AS dy FROM ab),
sc AS (SELECT m.pair_id, m.h, any_value(a) AS a, any_value(b) AS b, any_value(dx) AS dx, any_value(dy) AS dy, sum(CASE WHEN sqrt(power(a*c.ax - b*c.ay + dx - c.bx, 2) + power(b*c.ax + a*c.ay + dy - c.by_, 2)) <= 2e0 THEN 1 ELSE 0 END) AS k FROM mo m JOIN correspondences c ON m.pair_id = c.pair_id GROUP BY m.pair_id, m.h),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY k DESC, h) AS r FROM sc) x WHERE r = 1),
inl AS (SELECT c.* FROM correspondences c JOIN be ON c.pair_id = be.pair_id WHERE sqrt(power(a*ax - b*ay + dx - bx, 2) + power(b*ax + a*ay + dy - by_, 2)) <= 2e0), f AS ({FIT.format(src='inl')})"""


@query("d13_ransac_similarity", f"WITH {HYP} SELECT f.pair_id, CAST(be.k AS BIGINT) AS inliers, round(sqrt(f.a*f.a + f.b*f.b), 5) AS scale, round(degrees(atan2(f.b, f.a)), 4) AS rotation_deg FROM f JOIN be ON f.pair_id = be.pair_id")
def d13(t):
    rows = O.ransac_similarity(t("correspondences"), 12, 2.0)
    return rows.select("pair_id", "inliers", R("scale", 5).alias("scale"), R("rotation_deg", 4).alias("rotation_deg"))


@query("d14_pose_gate", """SELECT match_id, CASE WHEN h <= 10 OR h >= 300 THEN 'height' WHEN e > 2.5e0 THEN 'error' WHEN s < 60 THEN 'span' WHEN d > 80 THEN 'shift' WHEN inliers < 12 THEN 'inliers' WHEN r < 0.45e0 THEN 'ratio' END AS reason
FROM (SELECT match_id, elapsed_ms AS h, (match_id % 31) / 10e0 AS e, CAST(40 + match_id % 100 AS DOUBLE) AS s, CAST(match_id % 90 AS DOUBLE) AS d, inliers, (match_id % 17) / 16e0 AS r FROM match_log) x""")
def d14(t):
    m = F.col("match_id")
    rows = t("match_log").select("match_id", F.col("elapsed_ms").alias("height"), (m % 31 / 10).alias("error"), (40 + m % 100).cast("double").alias("span"), (m % 90).cast("double").alias("shift"), "inliers", (m % 17 / 16).alias("ratio"))
    return O.pose_gate(rows, 100.0, 80.0).select("match_id", "reason")


@query("d17_stage_rollup", "SELECT stage, reason, count(*) AS attempts, round(sum(elapsed_ms), 3) AS elapsed_ms FROM match_log GROUP BY ROLLUP (stage, reason)")
def d17(t):
    return O.stage_rollup(t("match_log")).withColumn("elapsed_ms", R("elapsed_ms", 3))


@query("d18_backend_benchmark", """SELECT backend, round(avg(matches), 5) AS matches, round(sum(inliers) / CAST(sum(matches) AS DOUBLE), 6) AS inlier_ratio, round(sqrt(sum(inliers * rmse * rmse) / sum(CASE WHEN rmse IS NOT NULL THEN inliers END)), 5) AS rmse, round(quantile_cont(confidence, 0.5), 5) AS median_confidence,
round(quantile_cont(elapsed_ms, 0.5), 5) AS median_ms, round(avg(elapsed_ms), 5) AS mean_ms FROM (SELECT *, CASE WHEN match_id % 9 > 0 THEN (match_id % 31) / 10e0 END AS rmse, (match_id % 97) / 97e0 AS confidence FROM match_log) x GROUP BY backend""")
def d18(t):
    m = F.col("match_id")
    rows = O.backend_benchmark(t("match_log").withColumns({"rmse": F.when(m % 9 > 0, m % 31 / 10.0), "confidence": m % 97 / 97.0}))
    return rows.select("backend", R("matches", 5).alias("matches"), R("inlier_ratio").alias("inlier_ratio"), R("rmse", 5).alias("rmse"), R("median_confidence", 5).alias("median_confidence"), R("median_ms", 5).alias("median_ms"), R("mean_ms", 5).alias("mean_ms"))
