"""Queries on raster cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as O
from ..operators.shared import materialize
from .registry import query

R = lambda c, k=5: F.round(c, k)
DIFF = "df AS (SELECT a.video_id, a.frame_idx, a.cx, a.cy, a.lum, a.lum - b.lum AS delta, abs(a.lum - b.lum) AS ad, abs(a.lum - b.lum) > 60 AS changed FROM cells a JOIN cells b ON a.video_id = b.video_id AND a.cx = b.cx AND a.cy = b.cy AND a.frame_idx = b.frame_idx + 2 WHERE a.valid AND b.valid)"


def _diff(t):
    return O.frame_difference(t("cells"), 2, 60.0)


@query("c17_frame_difference", f"WITH {DIFF} SELECT video_id, frame_idx, cx, cy, round(delta, 5) AS delta, changed FROM df")
def c17(t):
    return _diff(t).select(*O.CELL, R("delta").alias("delta"), "changed")


@query("d04_motion_ratio", f"WITH {DIFF} SELECT video_id, frame_idx, count(*) AS valid_cells, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) AS BIGINT) AS changed_cells, avg(CASE WHEN changed THEN 1e0 ELSE 0e0 END) > 0.2e0 AS rejected FROM df GROUP BY video_id, frame_idx")
def d04(t):
    return O.motion_ratio(_diff(t)).drop("ratio")


HIST = DIFF + """, my AS (SELECT a.video_id, a.frame_idx, a.cx, a.cy, bool_or(b.changed) AS moved FROM df a JOIN df b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.cx = b.cx AND abs(a.cy - b.cy) <= 1 GROUP BY ALL),
mv AS (SELECT a.video_id, a.frame_idx, a.cx, a.cy, bool_or(b.moved) AS moved FROM my a JOIN my b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.cy = b.cy AND abs(a.cx - b.cx) <= 1 GROUP BY ALL),
ls AS (SELECT *, (SELECT max(b.frame_idx) FROM mv b WHERE b.video_id = a.video_id AND b.cx = a.cx AND b.cy = a.cy AND b.moved AND b.frame_idx <= a.frame_idx) AS last, (SELECT max(b.frame_idx) FROM mv b WHERE b.video_id = a.video_id AND b.cx = a.cx AND b.cy = a.cy AND b.moved AND b.frame_idx < a.frame_idx) AS prev FROM mv a)"""


@query("e08_motion_history", f"WITH {HIST} SELECT video_id, frame_idx, cx, cy, round(coalesce(exp(-(frame_idx - last) / 4e0), 0e0), 5) AS history, last IS NOT NULL AND frame_idx - last <= 6 AS active, prev IS NOT NULL AND frame_idx - prev <= 6 AS prior_active FROM ls")
def e08(t):
    return O.motion_history(_diff(t), 2.0, reach=1).select(*O.CELL, R("history").alias("history"), "active", "prior_active")


@query("e09_focal_stats", f"""WITH {DIFF}, s AS (SELECT a.video_id, a.frame_idx, a.cx, a.cy, any_value(a.ad) AS ad, avg(b.ad) AS m, sqrt(greatest(avg(b.ad * b.ad) - power(avg(b.ad), 2), 0e0)) AS d FROM df a JOIN df b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND abs(a.cx - b.cx) <= 3 AND abs(a.cy - b.cy) <= 3 GROUP BY a.video_id, a.frame_idx, a.cx, a.cy)
SELECT video_id, frame_idx, cx, cy, round(m + 1e-7, 3) AS local_mean, round(d, 3) AS local_std FROM s""")
def e09(t):
    return O.adaptive_threshold(_diff(t), 3).select(*O.CELL, R(F.col("local_mean") + 1e-7, 3).alias("local_mean"), R("local_std", 3).alias("local_std"))


@query("e10_focal_minmax", """WITH y1 AS (SELECT a.video_id, a.frame_idx, a.cx, a.cy, min(b.lum) AS v FROM cells a JOIN cells b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.cx = b.cx AND abs(a.cy - b.cy) <= 1 GROUP BY ALL),
x1 AS (SELECT a.video_id, a.frame_idx, a.cx, a.cy, min(b.v) AS v FROM y1 a JOIN y1 b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.cy = b.cy AND abs(a.cx - b.cx) <= 1 GROUP BY ALL),
y2 AS (SELECT a.video_id, a.frame_idx, a.cx, a.cy, max(b.v) AS v FROM x1 a JOIN x1 b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.cx = b.cx AND abs(a.cy - b.cy) <= 1 GROUP BY ALL)
SELECT a.video_id, a.frame_idx, a.cx, a.cy, max(b.v) AS opened FROM y2 a JOIN y2 b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.cy = b.cy AND abs(a.cx - b.cx) <= 1 GROUP BY ALL""")
def e10(t):
    return O.opening(t("cells"), "lum", 1).select(*O.CELL, F.col("lum").alias("opened"))


#: 8-connected blobs of changed cells: the least cell number that a cell reaches.
LABELS = DIFF + """, ch AS (SELECT video_id, frame_idx, cx, cy, delta, cy * 100000 + cx AS id FROM df WHERE changed),
ed AS (SELECT a.video_id, a.frame_idx, a.id AS u, b.id AS v FROM ch a JOIN ch b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1),
re AS (SELECT video_id, frame_idx, u, v FROM ed UNION SELECT r.video_id, r.frame_idx, r.u, e.v FROM re r JOIN ed e ON r.video_id = e.video_id AND r.frame_idx = e.frame_idx AND r.v = e.u),
lab AS (SELECT c.*, l.blob FROM ch c JOIN (SELECT video_id, frame_idx, u, min(v) AS blob FROM re GROUP BY ALL) l ON l.video_id = c.video_id AND l.frame_idx = c.frame_idx AND l.u = c.id)"""
BLOB = LABELS + """, bl AS (SELECT video_id, frame_idx, blob, count(*) AS area, min(cx) AS x, min(cy) AS y, max(cx) - min(cx) + 1 AS w, max(cy) - min(cy) + 1 AS h, avg(cx) AS mx, avg(cy) AS my,
 greatest(sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END), sum(CASE WHEN delta > 0 THEN 0 ELSE 1 END)) / CAST(count(*) AS DOUBLE) AS polarity, abs(sum(delta)) / greatest(sum(abs(delta)), 1e-9) AS coherence, avg(abs(delta)) AS mad FROM lab GROUP BY video_id, frame_idx, blob)"""


def _blobs(t):
    return O.blobs(O.label_blobs(_diff(t)))


def _noisy(t):
    """Blobs with their local noise; both read the differences, which are made once."""
    diff = materialize(_diff(t))
    return O.local_noise(O.blobs(O.label_blobs(diff)), diff)


@query("d01_candidate_evidence", f"WITH RECURSIVE {BLOB} SELECT video_id, frame_idx, blob, area, round(polarity + 1e-7, 5) AS polarity, round(coherence + 1e-7, 5) AS coherence, round(mad + 1e-7, 5) AS mean_abs_delta, round(area / CAST(w * h AS DOUBLE) + 1e-7, 5) AS fill FROM bl")
def d01(t):
    return _blobs(t).select("video_id", "frame_idx", "blob", "area", *[R(F.col(c) + 1e-7).alias(c) for c in ("polarity", "coherence", "mean_abs_delta", "fill")])


NOISE = BLOB + """, nz AS (SELECT b.video_id, b.frame_idx, b.blob, greatest(quantile_cont(d.ad, 0.75), 1e0) AS noise FROM bl b JOIN df d ON b.video_id = d.video_id AND b.frame_idx = d.frame_idx AND d.cx >= b.x - greatest(w, h, 8) AND d.cx < b.x + b.w + greatest(w, h, 8) AND d.cy >= b.y - greatest(w, h, 8) AND d.cy < b.y + b.h + greatest(w, h, 8) GROUP BY b.video_id, b.frame_idx, b.blob),
cn AS (SELECT b.*, n.noise, mad / noise AS snr FROM bl b JOIN nz n ON b.video_id = n.video_id AND b.frame_idx = n.frame_idx AND b.blob = n.blob)"""


@query("d02_local_noise", f"WITH RECURSIVE {NOISE} SELECT video_id, frame_idx, blob, round(noise, 6) AS noise, round(snr, 5) AS snr FROM cn")
def d02(t):
    return _noisy(t).select("video_id", "frame_idx", "blob", R("noise", 6).alias("noise"), R("snr").alias("snr"))


@query("d03_small_candidate_gate", f"WITH RECURSIVE {NOISE} SELECT video_id, frame_idx, blob, snr >= 2.2e0 AND polarity >= 0.62e0 AND coherence >= 0.18e0 AND area / CAST(w * h AS DOUBLE) >= 0.18e0 AS passes, polarity >= 0.62e0 AS polar, coherence >= 0.18e0 AS coherent FROM cn")
def d03(t):
    rows = _noisy(t)
    return rows.select("video_id", "frame_idx", "blob", O.small_gate().alias("passes"), (F.col("polarity") >= 0.62).alias("polar"), (F.col("coherence") >= 0.18).alias("coherent"))


@query("e08_prior_overlap", f"WITH RECURSIVE {HIST}, {LABELS[len(DIFF) + 2:]} SELECT l.video_id, l.frame_idx, l.blob, round(avg(CASE WHEN prev IS NOT NULL AND l.frame_idx - prev <= 6 THEN 1e0 ELSE 0e0 END), 6) AS prior_overlap FROM lab l JOIN ls s ON s.video_id = l.video_id AND s.frame_idx = l.frame_idx AND s.cx = l.cx AND s.cy = l.cy GROUP BY ALL")
def e08_overlap(t):
    diff = materialize(_diff(t))
    rows = O.prior_overlap(O.label_blobs(diff), O.motion_history(diff, 2.0, reach=1))
    return rows.withColumn("prior_overlap", R("prior_overlap", 6))


@query("d06_field_filter", f"""WITH RECURSIVE {NOISE}, wt AS (SELECT *, area * greatest(mad - noise, 1e0) AS wgt, count(*) OVER f AS k, max(mx) OVER f - min(mx) OVER f AS sx, max(my) OVER f - min(my) OVER f AS sy, sum(area * greatest(mad - noise, 1e0)) OVER f AS tot FROM cn WINDOW f AS (PARTITION BY video_id, frame_idx)),
cl AS (SELECT a.video_id, a.frame_idx, a.blob, a.mx, a.my, any_value(a.tot) AS tot, round(sum(b.wgt), 6) AS cw FROM wt a JOIN wt b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND sqrt(power(a.mx - b.mx, 2) + power(a.my - b.my, 2)) <= 8 WHERE a.k >= 8 AND (a.sx / 32 >= 0.3e0 OR a.sy / 24 >= 0.3e0) GROUP BY a.video_id, a.frame_idx, a.blob, a.mx, a.my),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY cw DESC, blob) AS r FROM cl) x WHERE r = 1 AND cw / greatest(tot, 1e-6) >= 0.45e0)
SELECT video_id, frame_idx, blob FROM wt WHERE NOT (k >= 8 AND (sx / 32 >= 0.3e0 OR sy / 24 >= 0.3e0)) UNION ALL SELECT w.video_id, w.frame_idx, w.blob FROM wt w JOIN be ON w.video_id = be.video_id AND w.frame_idx = be.frame_idx WHERE sqrt(power(w.mx - be.mx, 2) + power(w.my - be.my, 2)) <= 12""")
def d06(t):
    rows = _noisy(t)
    return O.field_filter(rows, 32, 24, radius_share=8 / 24).select("video_id", "frame_idx", "blob")


@query("d05_label_blobs", f"WITH RECURSIVE {BLOB} SELECT video_id, frame_idx, CAST(blob AS BIGINT) AS blob, area, x, y, w, h, round(mx, 5) AS mx, round(my, 5) AS my FROM bl WHERE x > 0 AND y > 0 AND x + w < 32 AND y + h < 24 AND area <= 200")
def d05(t):
    rows = O.blobs(O.label_blobs(_diff(t)), 1, 200, border=0, size=(32, 24))
    return rows.select("video_id", "frame_idx", "blob", "area", "x", "y", "w", "h", R("mx").alias("mx"), R("my").alias("my"))
