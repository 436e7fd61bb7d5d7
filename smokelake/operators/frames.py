"""Selecting frames, running evidence over frames and tracks, camera guard, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as X


def frame_range(frames: DataFrame, start: int, most: int = 0) -> DataFrame:
    """Frames from start on, at most so many for each video (0 or less: all)."""
    rows = frames.filter(F.col("frame_idx") >= start)
    if most <= 0:
        return rows
    order = Window.partitionBy("video_id").orderBy("frame_idx")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def sample_interval(frames: DataFrame, interval: float) -> DataFrame:
    """The first frame of each interval of seconds; 0 keeps every frame."""
    if interval <= 0:
        return frames
    bucket = F.floor((F.col("frame_idx") / F.col("fps") + 1e-9) / interval)
    order = Window.partitionBy("video_id").orderBy("frame_idx")
    rows = frames.withColumn("_b", bucket).withColumn("_p", F.lag("_b").over(order))
    return rows.filter(F.col("_p").isNull() | (F.col("_p") != F.col("_b"))).drop("_b", "_p")


def stride_frames(frames: DataFrame, stride: int) -> DataFrame:
    """Every stride-th frame from the first of each video."""
    first = F.min("frame_idx").over(Window.partitionBy("video_id"))
    return frames.withColumn("_f", first).filter(F.pmod(F.col("frame_idx") - F.col("_f"), F.lit(max(stride, 1))) == 0).drop("_f")


def run_summary(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Processed frames, events and snapshots (two for each event) of every video."""
    seen = frames.groupBy("video_id").agg(F.count("*").alias("processed_frames"))
    made = events.groupBy("video_id").agg(F.count("*").alias("events"))
    rows = seen.join(made, "video_id", "left").withColumn("events", F.coalesce("events", F.lit(0)).cast("long"))
    return rows.withColumn("snapshots", 2 * F.col("events"))


def short_growth(observations: DataFrame, track: list[str], order: list[str], area: str = "area") -> DataFrame:
    """Growth against the area three observations back (or the oldest held), and against the one before; 1 when alone."""
    w = Window.partitionBy(*track).orderBy(*order)
    held = F.greatest(F.coalesce(F.lag(area, 3).over(w), F.first(area).over(w)), F.lit(1.0))
    return observations.withColumns({
        "short_growth": F.when(F.row_number().over(w) == 1, F.lit(1.0)).otherwise(F.col(area) / held),
        "instant_growth": F.coalesce(F.col(area) / F.greatest(F.lag(area).over(w), F.lit(1.0)), F.lit(1.0)),
    })


def running_evidence(observations: DataFrame, track: list[str], order: list[str]) -> DataFrame:
    """Running signal (area times delta above noise), highest growth and number of observations; columns area, delta, noise, growth."""
    w = Window.partitionBy(*track).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    signal = F.col("area") * F.greatest(F.col("delta") - F.col("noise"), F.lit(0.0))
    return observations.withColumns({"signal": F.sum(signal).over(w), "peak_growth": F.max("growth").over(w), "observations": F.count("*").over(w)})


def expansion_check(observations: DataFrame, track: list[str], order: list[str], least: float = 1.08, most_shift: float = 0.65, least_balance: float = 0.55) -> DataFrame:
    """Growth of width and height against the observation before, their balance, and the centre's shift over the mean of both diagonals; passes where both sides grow alike and the centre stays. Sides count at least 1."""
    w = Window.partitionBy(*track).orderBy(*order)
    before = {k: F.lag(k).over(w) for k in "xywh"}
    rows = observations.withColumns({f"_{k}": v for k, v in before.items()})
    side = lambda c: F.greatest(c, F.lit(1))
    gw, gh = side("w") / side("_w"), side("h") / side("_h")
    diagonals = (F.hypot(side("w"), side("h")) + F.hypot(side("_w"), side("_h"))) / 2
    shift = F.when(F.col("_w").isNotNull(), X.centre_distance("", "_") / F.greatest(diagonals, F.lit(1.0)))
    rows = rows.withColumns({"growth_w": gw, "growth_h": gh, "balance": F.least(gw, gh) / F.greatest(gw, gh, F.lit(1e-6)), "shift": shift})
    passed = (F.col("growth_w") >= least) & (F.col("growth_h") >= least) & (F.col("balance") >= least_balance) & (F.col("shift") <= most_shift)
    return rows.withColumn("expanding", F.coalesce(passed, F.lit(False))).drop("_x", "_y", "_w", "_h")


def streak(rows: DataFrame, track: list[str], order: list[str], bad: Column, name: str = "streak") -> DataFrame:
    """Length of the run of rows where bad holds that ends at each row."""
    w = Window.partitionBy(*track).orderBy(*order)
    island = F.sum(F.when(bad, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_bad": bad, "_island": island})
    run = Window.partitionBy(*track, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(F.col("_bad"), 1).otherwise(0)).over(run).cast("long")).drop("_bad", "_island")


def confirmation_hits(signatures: DataFrame, track: list[str], window: int = 3, frame: str = "frame_idx") -> DataFrame:
    """Hits so far of each signature; they start at 1 again where the gap of frames exceeds the window."""
    w = Window.partitionBy(*track).orderBy(frame)
    apart = F.coalesce(F.col(frame) - F.lag(frame).over(w) > window, F.lit(True)).cast("int")
    rows = signatures.withColumn("_new", apart)
    rows = rows.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return rows.withColumn("hits", F.row_number().over(Window.partitionBy(*track, "session").orderBy(frame)).cast("long")).drop("_new")


def focus_ratio(frames: DataFrame, stride: int) -> DataFrame:
    """Sharpness against that of the frame stride places before."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    return frames.withColumn("focus_ratio", F.col("sharpness") / F.greatest(F.lag("sharpness", stride).over(w), F.lit(1e-6)))


#: Limits of the camera guard: pixels, degrees, scale change, sharpness ratio, residual share (fixed values).
GUARD = {"translation": 6.0, "rotation": 0.20, "scale": 0.008, "focus_low": 0.65, "focus_high": 1.55, "residual": 0.10, "cooldown": 4}


def camera_guard(alignments: DataFrame, stride: int = 2, limits: dict = GUARD) -> DataFrame:
    """reason (first of translation, rotation, zoom, focus, residual; null if none) and blocked of every aligned frame. A frame with a reason blocks itself and the next aligned frames of the cooldown. Missing measures pass."""
    rows = focus_ratio(alignments, stride).filter("align_ok")
    g = limits
    reason = (
        F.when(F.hypot("dx", "dy") > g["translation"], "camera_translation")
        .when(F.abs("rotation_deg") > g["rotation"], "camera_rotation")
        .when(F.abs(F.col("scale") - 1) > g["scale"], "camera_zoom")
        .when((F.col("focus_ratio") < g["focus_low"]) | (F.col("focus_ratio") > g["focus_high"]), "focus_change")
        .when(F.col("residual_ratio") > g["residual"], "global_residual")
    )
    near = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(-g["cooldown"], 0)
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("blocked", F.max(F.col("reason").isNotNull()).over(near))


def guard_summary(guarded: DataFrame) -> DataFrame:
    """Frames paused by reason."""
    return guarded.filter(F.col("reason").isNotNull()).groupBy("video_id", "reason").agg(F.count("*").alias("frames"))


def heartbeat(captures: DataFrame, every: int) -> DataFrame:
    """For each full block of so many frames of a camera: overall and block rate, mean detector time, skipped frame ids, frames so far."""
    w = Window.partitionBy("camera_id").orderBy("ts", "camera_frame_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = captures.withColumns({"_t": seconds, "_n": F.row_number().over(w)})
    rows = rows.withColumn("block", F.floor((F.col("_n") - 1) / every).cast("long"))
    out = rows.groupBy("camera_id", "block").agg(
        F.count("*").alias("frames"), F.min("_t").alias("t0"), F.max("_t").alias("t1"), F.avg("detector_ms").alias("mean_ms"),
        F.min("camera_frame_id").alias("first_id"), F.max("camera_frame_id").alias("last_id"),
    ).filter(F.col("frames") == every)
    so_far = Window.partitionBy("camera_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    start = F.min("t0").over(so_far)
    done = F.sum("frames").over(so_far)
    return out.select(
        "camera_id", "block", done.alias("processed"),
        (done / F.greatest(F.col("t1") - start, F.lit(1e-6))).alias("overall_fps"),
        (F.col("frames") / F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-6))).alias("interval_fps"), "mean_ms",
        F.greatest(F.col("last_id") - F.col("first_id") + 1 - F.col("frames"), F.lit(0)).alias("skipped"),
    )


def map_fix_age(poses: DataFrame, fps: float, most_seconds: float = 15.0) -> DataFrame:
    """Frames and seconds since the last map fix (null before the first), and whether tracking is still valid."""
    w = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("map_corrected"), F.col("frame_idx")), ignorenulls=True).over(w)
    rows = poses.withColumn("age_frames", (F.col("frame_idx") - last).cast("long"))
    return rows.withColumns({"age_sec": F.col("age_frames") / fps, "tracking_valid": F.coalesce(F.col("age_frames") <= int(most_seconds * fps), F.lit(False))})


def trajectory(poses: DataFrame) -> DataFrame:
    """Step and path length in metres from valid pose to valid pose of each video, on the local plane of its first one."""
    from ..functions.geo import to_en

    w = Window.partitionBy("video_id").orderBy("frame_idx")
    rows = poses.filter("pose_ok").withColumns({"_lon": F.first("lon").over(w), "_lat": F.first("lat").over(w)})
    rows = rows.withColumn("p", to_en("lon", "lat", "_lon", "_lat"))
    rows = rows.withColumns({"_e": F.lag("p.e").over(w), "_n": F.lag("p.n").over(w)})
    rows = rows.withColumn("step_m", F.coalesce(F.hypot(F.col("p.e") - F.col("_e"), F.col("p.n") - F.col("_n")), F.lit(0.0)))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("video_id", "frame_idx", F.col("p.e").alias("east"), F.col("p.n").alias("north"), "step_m", F.sum("step_m").over(so_far).alias("path_m"))


def latest_events(active: DataFrame, k: int) -> DataFrame:
    """The newest k active events of each frame, and how many more there are."""
    frame = Window.partitionBy("video_id", "frame_idx")
    newest = frame.orderBy(F.desc("confirm_frame"), F.desc("event_id"))
    rows = active.withColumns({"rank": F.row_number().over(newest), "remaining": F.greatest(F.count("*").over(frame) - k, F.lit(0)).cast("long")})
    return rows.filter(F.col("rank") <= k)


def evict_oldest(memories: DataFrame, keep: int = 12) -> DataFrame:
    """The newest memories of each video by last update, then confirmation."""
    w = Window.partitionBy("video_id").orderBy(F.desc("last_update"), F.desc("confirm_frame"), F.desc("event_id"))
    return memories.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def fb_consistency(vectors: DataFrame, keys: list[str], most: float = 1.0) -> DataFrame:
    """Tracked vectors (forward-backward error below the limit) and their share."""
    ok = F.coalesce(F.col("fb_error") < most, F.lit(False))
    return vectors.groupBy(*keys).agg(F.count("*").alias("vectors"), F.sum(ok.cast("long")).alias("tracked"), F.avg(ok.cast("double")).alias("share"))
