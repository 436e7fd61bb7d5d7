"""Queries on streaming operators as batches of the same functions (A13, I7, I8, I9), and one stream over a table; the live path as streams is in live.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import tracking as T
from ..operators.shared import shared_folder
from ..streaming import pipelines as P
from .boxes import TWD
from .events import EV
from .registry import query


def drained(stream: DataFrame, schema) -> DataFrame:
    """Run a stream to the end of its input and read its sink, which lies in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


@query("i09_stream_heartbeat", """SELECT camera_id, CAST(floor(epoch(ts) / 600) AS BIGINT) AS slot, count(*) AS frames, round(avg(detector_ms), 5) AS mean_ms, greatest(max(camera_frame_id) - min(camera_frame_id) + 1 - count(*), 0) AS skipped
FROM captures GROUP BY camera_id, CAST(floor(epoch(ts) / 600) AS BIGINT)""")
def i09(t):
    rows = P.heartbeat(t("captures").withColumn("ts", F.col("ts").cast("timestamp")), "10 minutes")
    return rows.select("camera_id", F.floor(F.unix_timestamp("started") / 600).alias("slot"), "frames", F.round("mean_ms", 5).alias("mean_ms"), "skipped")


@query("i07_stream_localize", f"WITH {EV}, st AS (SELECT *, px * 2840e0 / 1280 - 1420 AS u, 1420 - py * 2840e0 / 720 AS v, 121.05e0 AS lon, 24.01e0 AS lat FROM ev), ds AS (SELECT *, tan(sqrt(u*u + v*v) / (4.5e0 / 0.00274e0)) / sqrt(u*u + v*v) AS k FROM st), " + TWD.format(src="ds", lon="lon", lat="lat")
       + " SELECT video_id, event_id, round(easting + 120e0 * u * k, 2) AS easting, round(northing + 120e0 * v * k, 2) AS northing FROM g3")
def i07(t):
    """A camera that looks straight down: the ray is the pixel's offset times the tangent of its angle."""
    d = t("detections").filter("conf >= 0.8")
    rows = P.localize(d, {"lon": 121.05, "lat": 24.01, "alt": 120.0, "yaw": 0.0, "pitch": 0.0, "roll": 0.0}, 1280, 720)
    return rows.select("video_id", "event_id", F.round("position.easting", 2).alias("easting"), F.round("position.northing", 2).alias("northing"))


@query("i11_stream_dedupe", "SELECT DISTINCT event_type, user_id FROM events")
def i11(t):
    """Pairs of a file stream, each once."""
    source = t("events")
    stream = source.sparkSession.readStream.schema(source.schema).parquet(f"{t.sf_dir}/event[s].parquet")  # a stream wants a pattern or a folder
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id").dropDuplicates(["event_type", "user_id"])
    return drained(rows.select("event_type", "user_id"), "event_type string, user_id long")


@query("a13_localization_log", "SELECT match_id, CASE WHEN match_id % 3 = 0 THEN NULL ELSE round(elapsed_ms, 3) END AS error FROM match_log")
def a13(t):
    """NaN is written as null."""
    rows = t("match_log").select("match_id", F.when(F.col("match_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.round("elapsed_ms", 3)).alias("error"))
    return E.localization_log(rows).select(F.get_json_object("json", "$.match_id").cast("long").alias("match_id"), F.get_json_object("json", "$.error").cast("double").alias("error"))


@query("i08_located_tracks", None)
def tracks(t):
    """Events by the tracker with the position of a static pose: the live path as a batch."""
    found = T.track_detections(T.tracker_input(t("frames"), t("detections").filter("conf >= 0.7")))
    rows = P.localize(found, {"lon": 121.05, "lat": 24.01, "alt": 120.0, "yaw": 0.0, "pitch": 0.0, "roll": 0.0}, 1280, 720)
    return rows.select("video_id", "event_id", "frame_idx", "confirm_frame", F.round("position.lon", 6).alias("lon"), F.round("position.lat", 6).alias("lat"))
