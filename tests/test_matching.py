"""Footprints of homographies, match gates and hulls."""

import math

from pyspark.sql import functions as F

from smokelake.operators import matching

FRAME = (640, 480)


def _outline(h, width, height):
    """(in front, convex, area) of the frame's corners, the plain way."""
    if h is None:
        return None
    corners = [(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)]
    depths = [h[6] * x + h[7] * y + h[8] for x, y in corners]
    front = all(d > 1e-8 for d in depths) or all(d < -1e-8 for d in depths)
    if any(d == 0 for d in depths):
        return front, False, None
    ring = [((h[0] * x + h[1] * y + h[2]) / d, (h[3] * x + h[4] * y + h[5]) / d) for (x, y), d in zip(corners, depths, strict=True)]
    turns = []
    for k in range(4):
        (ax, ay), (bx, by), (cx, cy) = ring[k], ring[(k + 1) % 4], ring[(k + 2) % 4]
        turns.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
    area = abs(sum(ring[k][0] * ring[(k + 1) % 4][1] - ring[(k + 1) % 4][0] * ring[k][1] for k in range(4))) / 2
    return front, all(t > 0 for t in turns) or all(t < 0 for t in turns), area


CASES = {
    "same": [1.0, 0, 0, 0, 1, 0, 0, 0, 1], "turned": [0.5, -0.8, 3, 0.8, 0.5, -9, 0, 0, 1], "mirrored": [-1.0, 0, 0, 0, 1, 0, 0, 0, 1], "behind": [-1.0, 0, 0, 0, -1, 0, 0, 0, -1],
    "tilted": [1.0, 0, 0, 0, 1, 0, 1e-3, -5e-4, 1], "bow_tie": [1.0, 0, 0, 0, 1, 0, -4e-3, 0, 1], "mixed": [1.0, 0, 0, 0, 1, 0, 0, -3e-3, 1], "horizon": [1.0, 0, 0, 0, 1, 0, -1 / 639, 0, 1],
    "line": [1.0, 1, 0, 1, 1, 0, 0, 0, 1], "tiny": [5e-3, 0, 0, 0, 5e-3, 0, 0, 0, 1], "huge": [6.0, 0, 0, 0, 6, 0, 0, 0, 1], "zero": [0.0] * 9, "none": None,
}


def test_footprints(spark):
    df = spark.createDataFrame([(k, v and [float(x) for x in v]) for k, v in CASES.items()], "name string, h array<double>")
    got = {r.name: r for r in df.select("name", matching.footprint("h", *FRAME).alias("f"), matching.footprint_valid("h", *FRAME, 400_000.0).alias("ok")).collect()}
    for name, h in CASES.items():
        want, f = _outline(h, *FRAME), got[name].f
        if want is None:
            assert f is None
            continue
        assert (f.in_front, f.convex) == want[:2], name
        assert want[2] is None or math.isclose(f.area, want[2], rel_tol=1e-5, abs_tol=1e-3), name
    assert {k for k, r in got.items() if r.ok} == {"same", "turned", "mirrored", "behind", "tilted"}
    assert not got["bow_tie"].f.convex and not got["bow_tie"].f.in_front and got["huge"].f.convex and got["tiny"].f.area < 16


def test_every_gate_of_a_match(spark):
    """One row for each gate, in their order; a gate before it decides where several refuse."""
    rows = [
        ("few", 15, 15, 1.0, 0.5, 0.5, True, 1.0), ("none", 40, 0, 0.0, None, 0.5, False, None), ("inliers", 40, 15, 0.375, 0.5, 0.5, True, 1.0), ("ratio", 100, 34, 0.34, 0.5, 0.5, True, 1.0),
        ("flat", 40, 30, 0.75, 0.5, 0.5, True, 1e-13), ("shape", 40, 30, 0.75, 0.5, 0.5, False, 1.0), ("coverage", 40, 30, 0.75, 0.5, 0.019, True, 1.0), ("error", 40, 30, 0.75, 2.51, 0.5, True, 1.0),
        ("unknown", 40, 30, 0.75, None, 0.5, True, 1.0), ("good", 40, 20, 0.5, 1.0, 0.02, True, 1.0), ("both", 15, 3, 0.2, 9.0, 0.0, False, None),
    ]
    df = spark.createDataFrame(rows, "name string, matches int, inliers int, inlier_ratio double, rmse double, coverage double, valid_geometry boolean, det double")
    got = {r.name: r for r in matching.verify_match(df).collect()}
    refused = {"few": "insufficient_matches", "none": "homography_failed", "inliers": "insufficient_inliers", "ratio": "insufficient_inliers", "flat": "insufficient_inliers", "both": "insufficient_matches"}
    assert {k: r.reason for k, r in got.items()} == refused | dict.fromkeys(("shape", "coverage", "error", "unknown"), "geometry_rejected") | {"good": "accepted"}
    assert math.isclose(got["good"].confidence, 0.5 * 20 / 32 / 2) and math.isclose(got["good"].score, 20 * got["good"].confidence) and got["few"].score == got["unknown"].confidence == 0


def test_quality_under_a_homography(spark):
    h = [1.0, 0.0, 5.0, 0.0, 1.0, -3.0, 1e-3, 0.0, 1.0]
    points = [(x, y) for x in (0.0, 100.0, 200.0) for y in (0.0, 50.0)]
    rows = [(1, x, y, (x + 5) / (1 + x / 1000) + (20 if k == 0 else 0), (y - 3) / (1 + x / 1000)) for k, (x, y) in enumerate(points)]
    corr = spark.createDataFrame(rows + [(2, 0.0, 0.0, 0.0, 0.0)], "pair_id int, ax double, ay double, bx double, by_ double")
    models = spark.createDataFrame([(1, h), (2, None)], "pair_id int, h array<double>")
    got = {r.pair_id: r for r in matching.match_quality(corr, models, 3.0).collect()}
    assert (got[1].matches, got[1].inliers, got[2].inliers, got[2].rmse) == (6, 5, 0, None) and got[1].rmse < 1e-9
    assert matching.inliers_of(corr, models, 3.0).filter(F.col("bx") > 20).count() == 4


def _matches(q, t, ratio):
    """All pairs, the plain way."""
    first = {}
    for i, a in q:
        near = sorted((math.dist(a, b), j) for j, b in t)
        if len(near) > 1 and near[0][0] < ratio * near[1][0]:
            first.setdefault(near[0][1], []).append((near[0][0], i))
    return {(min(v)[1], j) for j, v in first.items()}


def test_descriptors_in_blocks(spark):
    """Any block size gives the same matches; ties go to the smaller id; a hot train vector keeps its nearest query."""
    import random

    draw = random.Random(7)
    vector = lambda: [float(draw.randint(0, 6)) for _ in range(4)]
    q, t = {}, {}
    for pair in (1, 2, 3):
        t[pair] = [(j, vector()) for j in range(60)]
        q[pair] = [(i, [x + draw.choice([0.0, 0.01, 0.2]) for x in draw.choice(t[pair])[1]]) for i in range(100, 150)]
    q[2] += [(200 + i, [x + 0.001 * i for x in t[2][0][1]]) for i in range(30)]
    t[3] += [(j + 1000, v) for j, v in t[3][:10]]  # equal vectors: no match is clear
    q[4], t[4] = [(1, [1.0] * 4)], [(2, [1.0] * 4)]  # a lone train vector has no second
    rows = lambda side: spark.createDataFrame([(p, i, v) for p, own in side.items() for i, v in own] + [(1, 999, None), (None, 998, [0.0] * 4), (9, 997, [0.0] * 4)], "pair int, vec_id long, embedding array<float>")
    single = lambda side: {p: [(i, [float(__import__("numpy").float32(x)) for x in v]) for i, v in own] for p, own in side.items()}
    fq, ft = single(q), single(t)
    want = {(p, i, j) for p in fq for i, j in _matches(fq[p], ft[p], 0.8)}
    for block in (512, 16, 5):
        got = matching.match_descriptors(rows(q), rows(t), 0.8, block=block).collect()
        assert {(r.pair, r.query_id, r.train_id) for r in got} == want and len(got) == len(want), block
    assert len(want) > 20
