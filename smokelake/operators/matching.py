"""Image matching tables: descriptor matches, dense matches, similarity fits, match quality, pose gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes as X

#: Gates of a map match and of a pose (fixed values).
MIN_INLIERS, MIN_RATIO, MAX_ERROR, MIN_COVERAGE = 16, 0.35, 2.5, 0.02


def _two_nearest(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q the place of the nearest row of t (the first on ties), its distance and that of the second (infinite if there is none). Differences are taken as they are, a few rows at a time."""
    place, one, two = np.empty(len(q), np.int64), np.empty(len(q)), np.full(len(q), np.inf)
    step = max(2_000_000 // max(t.size, 1), 1)
    for k in range(0, len(q), step):
        d = np.sqrt(((q[k : k + step, None] - t[None]) ** 2).sum(2))
        rows = np.arange(len(d))
        near = d.argmin(1)
        place[k : k + step], one[k : k + step] = near, d[rows, near]
        if len(t) > 1:
            d[rows, near] = np.inf
            two[k : k + step] = d.min(1)
    return place, one, two


def match_descriptors(query: DataFrame, train: DataFrame, ratio: float = 0.7, pair: str = "pair", key: str = "vec_id", vector: str = "embedding", block: int = 512) -> DataFrame:
    """Mutual-best ratio matches within each image pair: the nearest train vector of a query vector (the smallest id on ties), if it is nearer than ratio times the second; of several queries with one train vector the nearest stays. Null vectors take no part; a lone train vector matches nothing.

    Vectors of a side lie in blocks, dealt by a hash of their id; each two blocks of a pair meet in numpy and leave the nearest two of every
    query there. So a shuffle carries blocks and two distances for each query and train block, never all pairs, and a hot pair spreads over its blocks.
    """
    kinds = dict(query.dtypes), dict(train.dtypes)

    def blocks(side: DataFrame, name: str) -> DataFrame:
        rows = side.filter(F.col(vector).isNotNull() & F.col(pair).isNotNull()).select(F.col(pair).alias("pair"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        sizes = rows.groupBy("pair").agg(F.ceil(F.count("*") / block).alias("n"))
        rows = rows.join(sizes, "pair").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")))
        return rows.groupBy("pair", "block").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias(name)).select("pair", name, F.col("block").alias(f"{name}_block"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                q, t = (one.column(c).flatten() for c in (1, 2))
                qv, tv = (np.array(x.field(1).to_pylist()) for x in (q, t))
                place, first, second = _two_nearest(qv, tv)
                ids = t.field(0).take(pa.array(place))
                yield pa.RecordBatch.from_arrays([pa.array([one.column(0)[0].as_py()] * len(place), type=one.column(0).type), q.field(0), ids, pa.array(first), pa.array(second)], names=["pair", "query_id", "train_id", "distance", "second"])

    met = blocks(query, "q").join(blocks(train, "t"), "pair").repartition("pair", "q_block", "t_block").select("pair", "q", "t")
    found = met.mapInArrow(nearest, f"pair {kinds[0][pair]}, query_id {kinds[0][key]}, train_id {kinds[1][key]}, distance double, second double")
    # the second of all blocks is the least of the blocks' seconds and of the firsts but one
    best = found.groupBy("pair", "query_id").agg(F.min(F.struct("distance", "train_id")).alias("b"), F.min("second").alias("s"), F.slice(F.array_sort(F.collect_list("distance")), 2, 1).alias("firsts"))
    second = F.least("s", F.coalesce(F.get("firsts", F.lit(0)), F.lit(float("inf"))))
    best = best.filter((F.col("b.distance") < ratio * second) & (second < F.lit(float("inf")))).select("pair", "b.train_id", F.col("b.distance").alias("distance"), "query_id")
    back = best.groupBy("pair", "train_id").agg(F.min(F.struct("distance", "query_id")).alias("b"))
    return back.select(F.col("pair").alias(pair), "b.query_id", "train_id", "b.distance")


def refine_dense(raw: str, grid: int, from_wh: tuple[int, int], to_a: tuple[int, int], to_b: tuple[int, int]) -> Column:
    """One refined dense match from 11 numbers (two points, two offsets, two fine scores, confidence), or null where a gate fails.

    The side with the higher fine score moves its partner by grid times the offset. Gates: confidence over 0.2, fine score
    over 1e-6, finite, both points 16 pixels inside. Points are then scaled at pixel centres to the images' sizes.
    """
    r = F.col(raw)
    at = lambda k: F.get(r, F.lit(k))
    forward = at(8) >= at(9)
    ax, ay = F.when(forward, at(0)).otherwise(at(0) + grid * at(6)), F.when(forward, at(1)).otherwise(at(1) + grid * at(7))
    bx, by = F.when(forward, at(2) + grid * at(4)).otherwise(at(2)), F.when(forward, at(3) + grid * at(5)).otherwise(at(3))
    w, h = from_wh
    finite = F.forall(r, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    inside = lambda x, y: (x >= 16) & (y >= 16) & (x < w - 16) & (y < h - 16)
    ok = (F.size(r) == 11) & finite & (at(10) > 0.2) & (F.greatest(at(8), at(9)) > 1e-6) & inside(ax, ay) & inside(bx, by)
    scale = lambda v, to, size: (v + 0.5) * to / size - 0.5
    point = F.struct(scale(ax, to_a[0], w).alias("ax"), scale(ay, to_a[1], h).alias("ay"), scale(bx, to_b[0], w).alias("bx"), scale(by, to_b[1], h).alias("by"), at(10).alias("confidence"))
    return F.when(ok, point)


def fit_similarity(corr: DataFrame, key: str = "pair_id") -> DataFrame:
    """Least-squares similarity of each pair from sums: a = s cos, b = s sin, dx, dy; with scale, rotation and the number of points. Columns ax, ay, bx, by_."""
    sums = corr.groupBy(key).agg(
        F.count("*").alias("n"), F.avg("ax").alias("mx"), F.avg("ay").alias("my"), F.avg("bx").alias("ux"), F.avg("by_").alias("uy"),
        F.sum(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay")).alias("aa"),
        F.sum(F.col("ax") * F.col("bx") + F.col("ay") * F.col("by_")).alias("ab"),
        F.sum(F.col("ax") * F.col("by_") - F.col("ay") * F.col("bx")).alias("ac"),
    )
    n = F.col("n")
    spread = F.col("aa") - n * (F.col("mx") ** 2 + F.col("my") ** 2)
    a = (F.col("ab") - n * (F.col("mx") * F.col("ux") + F.col("my") * F.col("uy"))) / spread
    b = (F.col("ac") - n * (F.col("mx") * F.col("uy") - F.col("my") * F.col("ux"))) / spread
    rows = sums.withColumns({"a": F.when(spread > 1e-9, a), "b": F.when(spread > 1e-9, b)})
    return rows.select(
        key, "n", "a", "b", (F.col("ux") - F.col("a") * F.col("mx") + F.col("b") * F.col("my")).alias("dx"), (F.col("uy") - F.col("b") * F.col("mx") - F.col("a") * F.col("my")).alias("dy"),
        F.hypot("a", "b").alias("scale"), F.degrees(F.atan2("b", "a")).alias("rotation_deg"),
    )


#: Gates of a similarity between two frames: by tracked corners, and of the learned detector (fixed values).
MOTION_GATES = {"inliers": 15, "ratio": 0.35, "rotation": 12.0, "scale": None}
LEARNED_GATES = {"inliers": 15, "ratio": 0.40, "rotation": 10.0, "scale": (0.85, 1.15)}


def similarity_gate(fits: DataFrame, gates: dict = MOTION_GATES) -> DataFrame:
    """reason why a similarity is refused (null: accepted), by columns matches, inliers, scale and rotation_deg; a null scale was not fitted."""
    ratio = F.col("inliers") / F.greatest("matches", F.lit(1))
    reason = F.when(F.col("scale").isNull(), "not_fitted").when(F.col("inliers") < gates["inliers"], "inliers").when(ratio < gates["ratio"], "ratio")
    if gates["scale"]:
        reason = reason.when(~F.col("scale").between(*gates["scale"]), "scale")
    return fits.withColumn("reason", reason.when(F.abs("rotation_deg") > gates["rotation"], "rotation"))


def residual() -> Column:
    """Distance of a correspondence from the similarity a, b, dx, dy in its row."""
    ex = F.col("a") * F.col("ax") - F.col("b") * F.col("ay") + F.col("dx") - F.col("bx")
    ey = F.col("b") * F.col("ax") + F.col("a") * F.col("ay") + F.col("dy") - F.col("by_")
    return F.hypot(ex, ey)


def ransac_similarity(corr: DataFrame, hypotheses: int, threshold: float, key: str = "pair_id") -> DataFrame:
    """Robust similarity: hypotheses from point pairs picked by fixed arithmetic on their numbers, the one with the most inliers (the first on ties) kept and fitted anew on its inliers. Columns corr_id from 1, ax, ay, bx, by_.

    A hypothesis picks points 1 + 7h mod n and 1 + (11h + n/2) mod n; the pair's points are joined to its hypotheses once.
    """
    n = corr.groupBy(key).agg(F.count("*").alias("n"))
    h = n.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(hypotheses - 1))))
    h = h.withColumns({"i": (1 + F.pmod(7 * F.col("h"), F.col("n"))).cast("int"), "j": (1 + F.pmod(11 * F.col("h") + F.floor(F.col("n") / 2), F.col("n"))).cast("int")}).filter("i <> j")
    side = lambda k: corr.select(key, F.col("corr_id").alias(k), *[F.col(c).alias(c + k) for c in ("ax", "ay", "bx", "by_")])
    two = h.join(side("i"), [key, "i"]).join(side("j"), [key, "j"])
    ex, ey, fx, fy = F.col("axj") - F.col("axi"), F.col("ayj") - F.col("ayi"), F.col("bxj") - F.col("bxi"), F.col("by_j") - F.col("by_i")
    length = ex * ex + ey * ey
    two = two.filter(length > 1e-9).withColumns({"a": (ex * fx + ey * fy) / length, "b": (ex * fy - ey * fx) / length})
    models = two.select(key, "h", "a", "b", (F.col("bxi") - F.col("a") * F.col("axi") + F.col("b") * F.col("ayi")).alias("dx"), (F.col("by_i") - F.col("b") * F.col("axi") - F.col("a") * F.col("ayi")).alias("dy"))
    scored = corr.join(models, key).groupBy(key, "h").agg(F.sum((residual() <= threshold).cast("long")).alias("inliers"), *[F.first(c).alias(c) for c in ("a", "b", "dx", "dy")])
    best = scored.groupBy(key).agg(F.max(F.struct("inliers", (-F.col("h")).alias("h"), "a", "b", "dx", "dy")).alias("m")).select(key, "m.*")
    inliers = corr.join(best.select(key, "a", "b", "dx", "dy"), key).filter(residual() <= threshold).drop("a", "b", "dx", "dy")
    return fit_similarity(inliers, key).join(best.select(key, "inliers"), key)


def homography_residual(h: str = "h") -> Column:
    """Distance of a correspondence from where the homography (nine numbers by rows) in its row takes it; null where its depth is nearly 0."""
    p = X.transform_point(F.col(h), F.col("ax"), F.col("ay"))
    return F.hypot(p["x"] - F.col("bx"), p["y"] - F.col("by_"))


def match_quality(corr: DataFrame, models: DataFrame, threshold: float, key: str = "pair_id") -> DataFrame:
    """Matches, inliers, their ratio and root-mean-square error under each pair's model: a homography in column h, or else the similarity a, b, dx, dy. A pair without one has no inliers."""
    names, error = (["h"], homography_residual()) if "h" in models.columns else (["a", "b", "dx", "dy"], residual())
    rows = corr.join(models.select(key, *names), key).withColumn("_e", error)
    inlier = F.coalesce(F.col("_e") <= threshold, F.lit(False))
    out = rows.groupBy(key).agg(F.count("*").alias("matches"), F.sum(inlier.cast("long")).alias("inliers"), F.sqrt(F.avg(F.when(inlier, F.col("_e") * F.col("_e")))).alias("rmse"))
    return out.withColumn("inlier_ratio", F.col("inliers") / F.col("matches"))


def inliers_of(corr: DataFrame, models: DataFrame, threshold: float, key: str = "pair_id") -> DataFrame:
    """The correspondences that lie within the threshold of their pair's homography (column h)."""
    return corr.join(models.select(key, F.col("h").alias("_h")), key).filter(homography_residual("_h") <= threshold).drop("_h")


@F.pandas_udf(T.DoubleType())
def hull_area(x: pd.Series, y: pd.Series) -> float:
    """Area of the convex hull of the points of a group; 0 below three distinct points."""
    points = np.unique(np.column_stack([x.to_numpy(dtype=float), y.to_numpy(dtype=float)]), axis=0)
    points = points[np.isfinite(points).all(axis=1)]
    if len(points) < 3:
        return 0.0

    def chain(ps) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(chain(points) + chain(points[::-1]))
    return float(abs(np.dot(ring[:, 0], np.roll(ring[:, 1], -1)) - np.dot(ring[:, 1], np.roll(ring[:, 0], -1))) / 2)


def hull_coverage(corr: DataFrame, width: int, height: int, key: str = "pair_id") -> DataFrame:
    """Area of the convex hull of each pair's points over the frame's."""
    return corr.groupBy(key).agg(hull_area("ax", "ay").alias("area")).select(key, (F.col("area") / (width * height)).alias("coverage"))


def verify_match(quality: DataFrame, min_inliers: int = MIN_INLIERS, min_ratio: float = MIN_RATIO, max_error: float = MAX_ERROR, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """reason, accepted, confidence and score from matches, det (the homography's determinant, null where none was found), inliers, inlier_ratio, rmse, coverage and valid_geometry; gates in this order. A null error, coverage or geometry is rejected."""
    sound = F.col("valid_geometry") & (F.col("coverage") >= min_coverage) & (F.col("rmse") <= max_error)
    reason = (
        F.when(F.col("matches") < min_inliers, "insufficient_matches").when(F.col("det").isNull() | F.isnan("det"), "homography_failed")
        .when((F.col("inliers") < min_inliers) | (F.col("inlier_ratio") < min_ratio) | (F.abs("det") < 1e-12), "insufficient_inliers")
        .when(~F.coalesce(sound, F.lit(False)), "geometry_rejected").otherwise("accepted")
    )
    confidence = F.col("inlier_ratio") * F.least(F.lit(1.0), F.col("inliers") / (2 * min_inliers)) / (1 + F.col("rmse"))
    rows = quality.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "accepted")
    reached = F.col("reason").isin("accepted", "geometry_rejected")
    return rows.withColumn("confidence", F.when(reached, F.coalesce(confidence, F.lit(0.0))).otherwise(0.0)).withColumn("score", F.col("inliers") * F.col("confidence"))


def footprint(h: str, width: int, height: int) -> Column:
    """What a homography (nine numbers by rows) makes of the frame's corners: a struct of in_front (all depths of one sign, none nearly 0), convex (all turns of the ring of one sign) and area (by the shoelace rule); null without a homography.

    The corners are the centres of the outermost pixels. Of a bow-tie, turns differ in sign; of corners on one line, they are 0.
    """
    at = lambda k: F.get(F.col(h), F.lit(k))
    corners = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1))])
    places = F.array(*[F.lit(k) for k in range(4)])

    def corner(c: Column) -> Column:
        depth = at(6) * c["x"] + at(7) * c["y"] + at(8)
        # outlines are compared in single precision
        flat = lambda k: ((at(k) * c["x"] + at(k + 1) * c["y"] + at(k + 2)) / F.nullif(depth, F.lit(0.0))).cast("float").cast("double")
        return F.struct(depth.alias("d"), flat(0).alias("u"), flat(3).alias("v"))

    def outline(ring: Column) -> Column:
        nth = lambda k, n: F.get(ring, (k + n) % 4)
        turn = lambda k: (nth(k, 1)["u"] - nth(k, 0)["u"]) * (nth(k, 2)["v"] - nth(k, 1)["v"]) - (nth(k, 1)["v"] - nth(k, 0)["v"]) * (nth(k, 2)["u"] - nth(k, 1)["u"])
        inf = F.lit(float("inf"))
        finite = F.forall(ring, lambda p: p["u"].isNotNull() & ~F.isnan(p["u"]) & ~F.isnan(p["v"]) & (F.abs(p["u"]) < inf) & (F.abs(p["v"]) < inf))
        front = F.forall(ring, lambda p: p["d"] > 1e-8) | F.forall(ring, lambda p: p["d"] < -1e-8)
        convex = finite & (F.forall(places, lambda k: turn(k) > 0) | F.forall(places, lambda k: turn(k) < 0))
        area = F.abs(F.aggregate(places, F.lit(0.0), lambda s, k: s + nth(k, 0)["u"] * nth(k, 1)["v"] - nth(k, 1)["u"] * nth(k, 0)["v"])) / 2
        ok = lambda c: F.coalesce(c, F.lit(False))
        return F.struct(ok(front).alias("in_front"), ok(convex).alias("convex"), F.when(ok(finite), area).alias("area"))

    # one element, so that the ring has a name
    return F.when(F.size(h) == 9, F.get(F.transform(F.array(F.transform(corners, corner)), outline), F.lit(0)))


def footprint_valid(h: str, width: int, height: int, mask_area: float) -> Column:
    """Whether a homography's footprint is in front, convex, over 16 pixels and at most four times the map window."""
    sound = F.transform(F.array(footprint(h, width, height)), lambda f: f["in_front"] & f["convex"] & (f["area"] > 16) & (f["area"] <= 4 * mask_area))
    return F.coalesce(F.get(sound, F.lit(0)), F.lit(False))


def best_match(candidates: DataFrame, key: str) -> DataFrame:
    """Of the accepted candidates whose centre is covered and near, the highest score, the first on ties (column place)."""
    ok = candidates.filter(F.col("accepted") & F.col("centre_covered") & F.col("centre_near"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "place")
    return ok.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def pose_gate(poses: DataFrame, reference_height: float, most_shift: float) -> DataFrame:
    """reason why a pose is refused (null: accepted), by columns height, error, span, shift, inliers, ratio."""
    finite = F.lit(True)
    for c in ("height", "error", "span", "shift", "ratio"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    reason = (
        F.when(~finite, "not_finite").when((F.col("height") <= 10) | (F.col("height") >= 3 * reference_height), "height").when(F.col("error") > 2.5, "error")
        .when(F.col("span") < 60, "span").when(F.col("shift") > most_shift, "shift").when(F.col("inliers") < 12, "inliers").when(F.col("ratio") < 0.45, "ratio")
    )
    return poses.withColumn("reason", reason)


def stage_rollup(log: DataFrame) -> DataFrame:
    """Attempts and time by stage and reason, with totals (null) by rollup."""
    return log.rollup("stage", "reason").agg(F.count("*").alias("attempts"), F.sum("elapsed_ms").alias("elapsed_ms"))


def backend_benchmark(log: DataFrame) -> DataFrame:
    """Matches, inlier ratio, reprojection error of the inliers, median confidence of the matches, and median and mean time of each backend."""
    return log.groupBy("backend").agg(F.sqrt(F.sum(F.col("inliers") * F.col("rmse") * F.col("rmse")) / F.sum(F.when(F.col("rmse").isNotNull(), F.col("inliers")))).alias("rmse"), F.percentile("confidence", F.lit(0.5)).alias("median_confidence"), F.avg("matches").alias("matches"), (F.sum("inliers") / F.sum("matches")).alias("inlier_ratio"), F.percentile("elapsed_ms", F.lit(0.5)).alias("median_ms"), F.avg("elapsed_ms").alias("mean_ms"))


def radial_flow(vectors: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """Share of the vectors (of length 0.7 or more) that point outward, and their mean cosine; null below the least number. Columns rx, ry (from the centre), dx, dy."""
    length, r = F.hypot("dx", "dy"), F.hypot("rx", "ry")
    cosine = (F.col("dx") * F.col("rx") + F.col("dy") * F.col("ry")) / (length * r)
    rows = vectors.filter((length >= 0.7) & (r > 1e-6)).withColumn("_cos", cosine)
    out = rows.groupBy(*keys).agg(F.count("*").alias("valid_vectors"), F.avg((F.col("_cos") > 0.35).cast("double")).alias("_out"), F.avg("_cos").alias("_mean"))
    enough = F.col("valid_vectors") >= least
    return out.select(*keys, "valid_vectors", F.when(enough, F.col("_out")).alias("outward_ratio"), F.when(enough, F.col("_mean")).alias("mean_cosine"))
