"""Queries on the live path: each runs as a stream over files, slice by slice, and returns its sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators.shared import shared_folder
from ..streaming import live as L
from ..streaming import pipelines as P
from .boxes import TWD, half_up
from .events import CUT, LIVE, _live, _text
from .registry import query

#: Microseconds of a second.
US = 1_000_000


class Feed:
    """Rows handed to a file stream slice by slice (column slice, from 0): each slice is one micro-batch, and one run of the stream from its log."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.session, self.folder = L.stateful_session(self.spark, 4), f"{shared_folder(self.spark)}/live-{uuid.uuid4().hex}"
        rows.write.partitionBy("slice").parquet(f"{self.folder}/ready")
        self.schema, self.slices = rows.drop("slice").schema, [r.slice for r in rows.select("slice").distinct().orderBy("slice").collect()]
        self.drops: list[tuple[int, int, int]] = []

    def run(self, slice_no: int, make: Callable[[DataFrame], DataFrame], sink: Callable | None = None) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files, ready = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration()), path(f"{self.folder}/ready/slice={slice_no}")
        if files.exists(ready):
            files.mkdirs(path(f"{self.folder}/in"))
            files.rename(ready, path(f"{self.folder}/in/{slice_no}"))
        writer = make(self.session.readStream.schema(self.schema).parquet(f"{self.folder}/in/*")).writeStream
        writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", f"{self.folder}/out")
        q = writer.option("checkpointLocation", f"{self.folder}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        self.drops += [(slice_no, n, dropped) for _, n, dropped in L.late_drops(q)]

    def all(self, make: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
        for k in self.slices:
            self.run(k, make)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/out")


def _arrivals(t):
    return t("arrivals").withColumn("ts", F.col("ts").cast("timestamp"))


@query("i01_latest_frame_stream", """WITH b AS (SELECT a.*, (SELECT max(p.camera_frame_id) FROM arrivals p WHERE p.camera_id = a.camera_id AND p.slice < a.slice) AS last FROM (SELECT DISTINCT camera_id, slice FROM arrivals) a),
n AS (SELECT a.camera_id, a.slice, max(a.camera_frame_id) FILTER (b.last IS NULL OR a.camera_frame_id > b.last) AS camera_frame_id, count(*) FILTER (b.last IS NULL OR a.camera_frame_id > b.last) AS fresh, count(*) AS n FROM arrivals a JOIN b ON a.camera_id = b.camera_id AND a.slice = b.slice GROUP BY a.camera_id, a.slice),
s AS (SELECT *, CAST(sum(greatest(fresh - 1, 0)) OVER c AS BIGINT) AS overwritten, CAST(sum(n - fresh) OVER c AS BIGINT) AS stale FROM n WINDOW c AS (PARTITION BY camera_id ORDER BY slice))
SELECT camera_id, camera_frame_id, fresh - 1 AS replaced, overwritten, stale FROM s WHERE fresh > 0""")
def i01(t):
    """Frames of which some are replayed, and some come a slice late."""
    rows = Feed(t("arrivals").select("camera_id", "camera_frame_id", "slice")).all(L.latest_frame, "camera_id int, camera_frame_id long, replaced long, overwritten long, stale long")
    return rows.select("camera_id", "camera_frame_id", "replaced", "overwritten", "stale")


QUIET = "captures WHERE NOT (camera_id = 2 AND day(ts) > 20)"


@query("i10_camera_outages_stream", f"""WITH c AS (SELECT camera_id, epoch_us(ts) AS us FROM {QUIET}), g AS (SELECT camera_id, us, lead(us) OVER (PARTITION BY camera_id ORDER BY us) AS later, max(us) OVER () AS newest FROM c)
SELECT camera_id, CAST(us AS BIGINT) AS last_us, CAST(us + 3600000000 AS BIGINT) AS outage_us FROM g WHERE later - us >= 3600000000 OR (later IS NULL AND ceil((us + 3600000000) / 1000) <= floor(newest / 1000) - 3600000)""")
def i10(t):
    """One camera of three dies on the 20th; a frame is awaited for an hour."""
    rows = t("captures").filter("NOT (camera_id = 2 AND day(ts) > 20)").select("camera_id", F.col("ts").cast("timestamp").alias("ts"), F.floor((F.day("ts") - 1) / 8).cast("int").alias("slice"))
    out = Feed(rows).all(lambda s: L.camera_outages(s, 3600.0, "1 hour"), "camera_id int, last_frame_at timestamp, outage_at timestamp, silent boolean")
    return out.select("camera_id", F.unix_micros("last_frame_at").alias("last_us"), F.unix_micros("outage_at").alias("outage_us"))


#: The watermark of a slice (microseconds, cut to milliseconds) is the newest time of all slices before, less an hour.
MARKED = """w AS (SELECT s.slice, (SELECT max(floor(epoch_us(ts) / 1000)) * 1000 - 3600000000 FROM arrivals b WHERE b.slice < s.slice) AS mark FROM (SELECT DISTINCT slice FROM arrivals) s),
a AS (SELECT r.*, epoch_us(r.ts) AS us, w.mark IS NOT NULL AND epoch_us(r.ts) <= w.mark AS late FROM arrivals r JOIN w ON r.slice = w.slice)"""
BEATS = "camera_id int, started timestamp, frames long, mean_ms double, skipped long"


def _beats(t, **how):
    feed = Feed(_arrivals(t))
    return feed, feed.all(lambda s: P.heartbeat(s, delay="1 hour", once=True, **how), BEATS)


def _closed(size: int, starts: str) -> str:
    return f"""WITH {MARKED}, k AS (SELECT DISTINCT camera_id, camera_frame_id, us, detector_ms FROM a WHERE NOT late), s AS (SELECT *, {starts} AS slot FROM k)
SELECT camera_id, CAST(slot AS BIGINT) AS started_us, count(*) AS frames, round(avg(detector_ms) + 1e-7, 5) AS mean_ms, greatest(max(camera_frame_id) - min(camera_frame_id) + 1 - count(*), 0) AS skipped FROM s
WHERE slot + {size} <= (SELECT max(floor(epoch_us(ts) / 1000)) * 1000 - 3600000000 FROM arrivals) GROUP BY camera_id, slot"""


@query("i09_heartbeat_stream", _closed(7200 * US, f"floor(us / {7200 * US}) * {7200 * US}"))
def i09(t):
    """Windows of two hours that are closed; replayed frames count once, late ones not at all."""
    return _beats(t, window="2 hours")[1].select("camera_id", F.unix_micros("started").alias("started_us"), "frames", F.round(F.col("mean_ms") + 1e-7, 5).alias("mean_ms"), "skipped")


@query("i09_sliding_heartbeat_stream", _closed(21600 * US, f"unnest([floor(us / {7200 * US}) * {7200 * US}, floor(us / {7200 * US}) * {7200 * US} - {7200 * US}, floor(us / {7200 * US}) * {7200 * US} - {14400 * US}])"))
def i09_sliding(t):
    """Windows of six hours, every two hours."""
    return _beats(t, window="6 hours", slide="2 hours")[1].select("camera_id", F.unix_micros("started").alias("started_us"), "frames", F.round(F.col("mean_ms") + 1e-7, 5).alias("mean_ms"), "skipped")


@query("i09_late_drops", f"WITH {MARKED} SELECT CAST(slice AS BIGINT) AS slice, count(*) AS frames, count(*) FILTER (late) AS late FROM a GROUP BY slice")
def i09_late(t):
    """How many frames each slice brought, and how many of them were behind the watermark."""
    feed, _ = _beats(t, window="2 hours")
    return t.spark.createDataFrame(feed.drops, "slice long, frames long, late long")


STATIC = """pose AS (SELECT video_id, 121e0 + video_id / 1e2 AS lon, CASE WHEN video_id % 5 = 3 THEN NULL ELSE 24e0 + video_id / 1e3 END AS lat, 100e0 + video_id AS alt FROM (SELECT DISTINCT video_id FROM detections) v WHERE video_id % 5 <> 4)"""


@query("i07_localize_stream", f"WITH {STATIC}, ev AS (SELECT d.video_id, d.event_id, d.frame_idx % 60 / 30e0 AS delay, (d.x + d.w / 2e0) * 2840e0 / 1280 - 1420 AS u, 1420 - (d.y + d.h / 2e0) * 2840e0 / 720 AS v, p.lon, p.lat, coalesce(p.lat, 24e0) AS lat0, p.alt, p.video_id IS NOT NULL AND p.lat IS NULL AS part FROM detections d LEFT JOIN pose p ON d.video_id = p.video_id WHERE conf >= 0.8), "
       + "ds AS (SELECT *, tan(sqrt(u*u + v*v) / (4.5e0 / 0.00274e0)) / sqrt(u*u + v*v) AS k FROM ev), " + TWD.format(src="ds", lon="lon", lat="lat0")
       + " SELECT video_id, event_id, CASE WHEN lat IS NOT NULL THEN " + half_up("(easting + alt * u * k)") + " END AS easting, CASE WHEN lat IS NOT NULL THEN " + half_up("(northing + alt * v * k)") + " END AS northing, CASE WHEN lat IS NULL THEN 'unavailable' ELSE 'static_pose_estimate' END AS coordinate_status, CASE WHEN part THEN 'partial_pose' END AS problem, round(delay, 6) AS delay FROM g3")
def i07(t):
    """Events of cameras that look straight down, each with a pose of its own in a table; a fifth have none, a fifth a pose without a latitude."""
    v = F.col("video_id")
    poses = t("detections").select("video_id").distinct().filter(v % 5 != 4).select(
        "video_id", (121.0 + v / 100).alias("lon"), F.when(v % 5 != 3, 24.0 + v / 1000).alias("lat"), (100.0 + v).alias("alt"), *[F.lit(0.0).alias(c) for c in ("yaw", "pitch", "roll")],
    )
    events = t("detections").filter("conf >= 0.8").select("video_id", "event_id", "frame_idx", (F.col("frame_idx") + F.col("frame_idx") % 60).alias("confirm_frame"), *"xywh", F.floor((F.day("ts") - 1) / 8).cast("int").alias("slice"))
    feed = Feed(events)
    poses.write.parquet(f"{feed.folder}/poses")

    def make(stream):
        found = L.localize_by_camera(stream, feed.session.read.parquet(f"{feed.folder}/poses"), 1280, 720, 30.0)
        return found.select("video_id", "event_id", "easting", "northing", "coordinate_status", "problem", F.col("confirmation_delay_sec").alias("delay"))

    out = feed.all(make, "video_id int, event_id long, easting double, northing double, coordinate_status string, problem string, delay double")
    return out.withColumns({"easting": F.round("easting", 2), "northing": F.round("northing", 2), "delay": F.round("delay", 6)})


@query("i08_evidence_sink", LIVE + f""" SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(processed_frame_idx AS VARCHAR) AS processed_frame_idx, CAST(bbox_x AS VARCHAR) AS bbox_x, printf('%.3f', growth_ratio) AS growth_ratio, {_text('radial_outward_ratio')},
{', '.join(f"substr(CASE WHEN {c} IS NULL THEN '' ELSE printf('%.7f', {c}) END, 1, {n}) AS {c}" for c, n in CUT.items())}, stem || '_full.jpg' AS full_frame_path, CASE WHEN wgs84_lon IS NULL THEN 'false' ELSE 'true' END AS position_is_approximate, wgs84_lon IS NOT NULL AS has_line FROM lv""")
def i08(t):
    """Logged events through the sink, whose second batch fails behind its first files and is written again when the stream restarts; CSV, JSON and text of committed batches."""
    logged = _live(t).select(*E.CSV_COLUMNS, (F.col("event_id") % 1000 / 4.0).alias("timestamp_sec"), F.floor((F.substring("logged_at_utc", 9, 2).cast("int") - 1) / 8).cast("int").alias("slice"))
    feed = Feed(logged)
    sink = L.EvidenceSink(f"{feed.folder}/evidence")

    def fails(batch, batch_id):
        E.csv_rows(batch).limit(1).write.mode("overwrite").option("header", True).csv(f"{sink.folder}/detections_csv/batch_id={batch_id}")
        raise OSError("the disk is full")

    for k in feed.slices:
        if k == feed.slices[-1]:
            try:
                feed.run(k, lambda s: s, fails)
            except Exception as e:  # noqa: BLE001
                if "the disk is full" not in str(e):
                    raise
        feed.run(k, lambda s: s, sink)
    at = lambda k: F.get_json_object("value", f"$.{k}")
    told = sink.read(t.spark, "events_jsonl").select(at("event_id").alias("event_id"), at("position_is_approximate").alias("position_is_approximate"))
    lines = sink.read(t.spark, "coordinates").select(F.regexp_extract("value", r"^ID (\d+):", 1).alias("event_id"), F.contains("value", F.lit("TWD97")).alias("has_line"))
    rows = sink.read(t.spark, "detections_csv").join(told, "event_id").join(lines, "event_id")
    rows = rows.withColumns({c: F.substring(c, 1, n) for c, n in CUT.items()})
    return rows.select("event_id", "processed_frame_idx", "bbox_x", "growth_ratio", "radial_outward_ratio", *CUT, "full_frame_path", "position_is_approximate", "has_line")


@query("i11_dedupe_frames_stream", f"WITH {MARKED} SELECT DISTINCT camera_id, camera_frame_id FROM a WHERE NOT late")
def i11(t):
    """Replayed frames go, and so do those behind the watermark."""
    rows = Feed(_arrivals(t)).all(lambda s: P.dedupe_frames(s, "1 hour").select("camera_id", "camera_frame_id"), "camera_id int, camera_frame_id long")
    return rows
