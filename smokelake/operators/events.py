"""Confirmed events: localisation by pose, logged events, what is visible when, and rows for the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G


def with_map_pose(poses: DataFrame, focal35: float, width: int, height: int, lon0: float, lat0: float) -> DataFrame:
    """Adds the camera's local place (e, n) and inv, the image-to-ground homography, on the plane with the given origin."""
    p = G.to_en("lon", "lat", F.lit(lon0), F.lit(lat0))
    rows = poses.withColumn("_p", p).withColumns({"e": F.col("_p.e"), "n": F.col("_p.n")})
    rows = rows.withColumns({"_k": G.camera_matrix(F.lit(focal35), F.lit(width), F.lit(height)), "_r": G.camera_rotation("yaw", "pitch", "roll")})
    rows = rows.withColumn("_h", G.plane_homography("_k", "_r", "e", "n", "alt"))
    return rows.withColumn("inv", G.invert3("_h")).drop("_p", "_k", "_r", "_h")


def localize_events(events: DataFrame, poses: DataFrame, fps: float, bounds: tuple[float, float, float, float], lon0: float, lat0: float, reach: float = 1800.0) -> DataFrame:
    """Position of each event by the pose at its onset frame, if that is still held when it is confirmed (max(30 s, 300 frames)).

    events: video_id, event_id, frame_idx, confirm_frame, px, py; poses: video_id, frame_idx, e, n, inv. Adds status, lon, lat.
    """
    held = F.greatest(F.lit(int(30 * fps)), F.lit(300))
    known = poses.filter("pose_ok").select("video_id", "frame_idx", "e", "n", "inv")
    rows = events.join(known, ["video_id", "frame_idx"], "left")
    m = lambda k: F.get("inv", F.lit(k))
    w = m(6) * F.col("px") + m(7) * F.col("py") + m(8)
    rows = rows.withColumns({"_w": w, "_x": (m(0) * F.col("px") + m(1) * F.col("py") + m(2)) / w, "_y": (m(3) * F.col("px") + m(4) * F.col("py") + m(5)) / w})
    west, south, east, north = bounds
    outside = ~((F.col("_x") >= west) & (F.col("_x") <= east) & (F.col("_y") >= south) & (F.col("_y") <= north)) | (F.hypot(F.col("_x") - F.col("e"), F.col("_y") - F.col("n")) > reach)
    status = (
        F.when(F.col("inv").isNull() | (F.col("confirm_frame") - F.col("frame_idx") > held), "unavailable")
        .when(F.col("_w") <= 0, "ray_above_ground_horizon").when(outside, "outside_map_or_ground_range").otherwise("ground_plane_estimate")
    )
    p = G.to_gps("_x", "_y", F.lit(lon0), F.lit(lat0))
    ok = F.col("status") == "ground_plane_estimate"
    return rows.withColumn("status", status).withColumns({"lon": F.when(ok, p["lon"]), "lat": F.when(ok, p["lat"])}).drop("_w", "_x", "_y", "e", "n", "inv")


def static_position(rows: DataFrame, px, py, width, height, lon: str, lat: str, alt: str, yaw: str, pitch: str, roll: str, name: str = "position") -> DataFrame:
    """Adds a struct: lon, lat, easting, northing and above_horizon of a pixel by a static pose; null where the pose is (lon, lat and alt null), problem where it is partial."""
    given = sum(F.col(c).isNotNull().cast("int") for c in (lon, lat, alt))
    rows = rows.withColumn("_g", G.pixel_to_ground(lon, lat, alt, yaw, pitch, roll, px, py, width, height)).withColumns({"_x": F.col("_g.easting"), "_y": F.col("_g.northing")})
    rows = rows.withColumn("_b", G.twd97_to_wgs84("_x", "_y"))
    full = given == 3
    out = {"lon": "_b.lon", "lat": "_b.lat", "easting": "_x", "northing": "_y", "above_horizon": "_g.above_horizon"}
    position = F.struct(*[F.when(full, F.col(v)).alias(k) for k, v in out.items()], F.when(~full, F.lit("partial_pose")).alias("problem"))
    return rows.withColumn(name, F.when(given > 0, position)).drop("_g", "_x", "_y", "_b")


def logged_events(located: DataFrame, fps: float, static: bool = False) -> DataFrame:
    """Easting, northing, coordinate status and confirmation delay of located events (lon, lat null where unknown).

    map_registered tells whether the pose had a visual fix; with static, positions come from one fixed pose, whatever they are.
    """
    known = F.col("lon").isNotNull()
    p = G.wgs84_to_twd97("lon", "lat")
    status = F.lit("static_pose_estimate") if static else F.when(~known, "unavailable").when(F.col("map_registered"), "map_registered_ground_estimate").otherwise("gps_seeded_ground_estimate")
    return located.withColumns({
        "easting": F.when(known, p["easting"]), "northing": F.when(known, p["northing"]), "coordinate_status": status,
        "confirmation_delay_sec": (F.col("confirm_frame") - F.col("frame_idx")) / fps,
    })


def active_events(frames: DataFrame, events: DataFrame, hold_frames: int) -> DataFrame:
    """Events visible at each frame: confirmed at most hold_frames before. An event is sent to the bins of frames that it can reach, so the join is an equi-join."""
    size = max(hold_frames, 1)
    f = frames.select("video_id", "frame_idx").withColumn("_bin", F.floor(F.col("frame_idx") / size))
    e = events.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("confirm_frame") / size), F.floor((F.col("confirm_frame") + hold_frames) / size))))
    rows = f.join(e.withColumnRenamed("frame_idx", "onset_frame") if "frame_idx" in e.columns else e, ["video_id", "_bin"])
    return rows.filter((F.col("frame_idx") >= F.col("confirm_frame")) & (F.col("frame_idx") - F.col("confirm_frame") <= hold_frames)).drop("_bin")


#: Columns of the detections table, in order, and of the one of recorded videos (fixed values).
CSV_COLUMNS = (
    "event_id", "logged_at_utc", "processed_frame_idx", "camera_frame_id", "camera_timestamp_ns", "processing_latency_ms", "bbox_x", "bbox_y", "bbox_w", "bbox_h",
    "area", "growth_ratio", "radial_outward_ratio", "twd97_easting", "twd97_northing", "wgs84_lon", "wgs84_lat", "full_frame_path", "crop_path",
)
VIDEO_COLUMNS = ("video_name", "event_id", "frame_idx", "timestamp_sec", "area", "growth_ratio", "radial_ratio", "full_frame_path", "crop_path")
#: Pixels around an event's box in its cut-out (fixed value).
CROP_PAD = 32


def snapshot_paths(events: DataFrame, folder: str, width: int, height: int) -> DataFrame:
    """Adds the file names of an event's full picture and cut-out (null where the padded box lies outside the picture), and the cut-out's corners x0, y0, x1, y1."""
    stem = F.format_string(f"{folder}/event_%04d_frame_%08d_camera_%010d", "event_id", "processed_frame_idx", "camera_frame_id")
    corner = lambda a, d, most: (F.greatest(F.col(a) - CROP_PAD, F.lit(0)), F.least(F.col(a) + F.col(d) + CROP_PAD, F.lit(most)))
    (x0, x1), (y0, y1) = corner("bbox_x", "bbox_w", width), corner("bbox_y", "bbox_h", height)
    rows = events.withColumns({"x0": x0, "y0": y0, "x1": x1, "y1": y1, "full_frame_path": F.concat(stem, F.lit("_full.jpg"))})
    return rows.withColumn("crop_path", F.when((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.concat(stem, F.lit("_crop.jpg"))))


def csv_rows(events: DataFrame, columns: tuple[str, ...] = CSV_COLUMNS) -> DataFrame:
    """The named columns as text: numbers with a fraction to three places, longitude and latitude to seven; empty for null and for what is not a number."""
    kinds = dict(events.dtypes)

    def text(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return F.coalesce(F.when(F.col(c).isNotNull() & ~F.isnan(c), F.format_string("%.7f" if c in ("wgs84_lon", "wgs84_lat") else "%.3f", F.col(c))), F.lit(""))
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return events.select(*[text(c).alias(c) for c in columns])


def _known() -> Column:
    return F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")


def coordinate_line() -> Column:
    """One line of text for an event of a recorded video, with coordinates or without."""
    head = F.format_string("ID %d: t=%.2fs, confidence=%.3f, ", F.col("event_id"), F.col("timestamp_sec"), F.col("confidence"))
    found = F.format_string(
        "coordinate_status=%s, confirmation_delay=%.3fs, impact_px=(%.1f, %.1f), TWD97(E=%.2f, N=%.2f), WGS84(lat=%.6f, lon=%.6f)",
        "coordinate_status", "confirmation_delay_sec", "px", "py", "easting", "northing", "lat", "lon",
    )
    lost = F.concat(F.lit("coordinate=unavailable, impact_px=("), F.col("px").cast("string"), F.lit(", "), F.col("py").cast("string"), F.lit(")"))
    return F.concat(head, F.when(_known(), found).otherwise(lost))


def live_coordinate_line() -> Column:
    """The same for an event of a live camera."""
    head = F.format_string("ID %d: t=%.2fs, ", F.col("event_id"), F.col("timestamp_sec"))
    found = F.format_string("TWD97(E=%.2f, N=%.2f), WGS84(lat=%.6f, lon=%.6f)", "easting", "northing", "lat", "lon")
    return F.concat(head, F.when(_known(), found).otherwise("coordinate=unavailable"))


def json_rows(events: DataFrame) -> DataFrame:
    """One JSON object for each event: its frame, box, evidence and files, and a nested position (null when unavailable). NaN becomes null."""
    kinds = dict(events.dtypes)
    num = lambda c: F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
    names = ("twd97_easting", "twd97_northing", "wgs84_lon", "wgs84_lat")
    position = F.when(num("wgs84_lon").isNotNull() & num("wgs84_lat").isNotNull(), F.struct(*[num(c).alias(c) for c in names]))
    body = F.struct(
        "event_id", "logged_at_utc", "processed_frame_idx", "camera_frame_id", "camera_timestamp_ns", F.round("processing_latency_ms", 3).alias("processing_latency_ms"),
        F.array("bbox_x", "bbox_y", "bbox_w", "bbox_h").alias("bbox_xywh"), num("area").alias("area"), num("growth_ratio").alias("growth_ratio"), num("radial_outward_ratio").alias("radial_outward_ratio"),
        "full_frame_path", "crop_path", position.isNotNull().alias("position_is_approximate"), position.alias("position"),
    )
    return events.select("event_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def localization_log(rows: DataFrame) -> DataFrame:
    """One JSON object for each row, nulls kept, NaN and infinite numbers as null."""
    kinds = dict(rows.dtypes)
    plain = [F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in rows.columns]
    return rows.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("json"))
