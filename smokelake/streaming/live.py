"""The live path as streams: the newest frame of a camera, outages told while they last, heartbeats with a count of late frames, positions by a table of poses, and a sink whose readers see whole batches alone."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import events as E
from .pipelines import ROCKSDB


def stateful_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application with the state store that keyed state and timers need; the given one stays as it is.

    partitions: into how many parts state is dealt by key, each with an open store and a Python worker in every batch; for good, once a
    stream has begun. Without it, the given session's shuffle partitions.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return session


class LatestFrameProcessor(StatefulProcessor):
    """Hands on a camera's newest frame of a micro-batch, if it is newer than the last one handed on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "last long, overwritten long, stale long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, overwritten, stale = self.seen.get() if self.seen.exists() else (None, 0, 0)
        newest, fresh = None, 0
        for pdf in rows:  # in parts; one frame is held
            new = pdf if last is None else pdf[pdf["camera_frame_id"] > last]
            fresh, stale = fresh + len(new), stale + len(pdf) - len(new)
            if len(new):
                best = new.loc[[new["camera_frame_id"].idxmax()]]
                if newest is None or best["camera_frame_id"].iloc[0] > newest["camera_frame_id"].iloc[0]:
                    newest = best
        if newest is not None:
            last, overwritten = int(newest["camera_frame_id"].iloc[0]), overwritten + fresh - 1
            yield newest.assign(replaced=fresh - 1, overwritten=overwritten, stale=stale)
        self.seen.update((last, overwritten, stale))

    def close(self) -> None:
        pass


def latest_frame(captures: DataFrame) -> DataFrame:
    """Of each micro-batch the newest frame of each camera (camera_id, camera_frame_id and other columns), with replaced (older new frames of the batch that it stands for), and the camera's sums so far: overwritten (of those) and stale (frames not newer than one handed on before: replays and what came out of order).

    Ids must not be null. A frame that is repeated within one batch counts as overwritten; dedupe_frames before it removes such.
    """
    schema = T.StructType([*captures.schema, *[T.StructField(c, T.LongType()) for c in ("replaced", "overwritten", "stale")]])
    return captures.groupBy("camera_id").transformWithStateInPandas(LatestFrameProcessor(), schema, "Append", "None")


class OutageProcessor(StatefulProcessor):
    """Tells that a camera has sent nothing for a while: by a timer while it is silent, or by the next frame where both come in one batch."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last long, told boolean")

    def _rows(self, key: Any, lasts: list[int], silent: bool) -> pd.DataFrame:
        at = pd.to_datetime(pd.Series(lasts, dtype="int64"), unit="us")
        return pd.DataFrame({"camera_id": key[0], "last_frame_at": at, "outage_at": at + pd.Timedelta(self.gap, unit="us"), "silent": silent})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, told = self.state.get() if self.state.exists() else (None, False)
        times = pd.concat([pdf["ts"] for pdf in rows], ignore_index=True).dropna().astype("datetime64[us]").astype("int64").sort_values().tolist()
        found = []
        for at in times:
            if last is not None and at <= last:
                continue  # a frame behind the newest one tells nothing new
            if last is not None and at - last >= self.gap and not told:
                found.append(last)
            last, told = at, False
        if last is not None and not told:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(-(-(last + self.gap) // 1000))
        if last is not None:
            self.state.update((last, told))
        if found:
            yield self._rows(key, found, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, told = self.state.get()
        if not told:
            self.state.update((last, True))
            yield self._rows(key, [last], True)

    def close(self) -> None:
        pass


def camera_outages(captures: DataFrame, gap_seconds: float = 2.0, delay: str = "10 seconds") -> DataFrame:
    """One row for each time that a camera sent no frame for gap_seconds: camera_id, last_frame_at, outage_at and silent (told while no frame had come yet).

    captures: camera_id int, ts. The clock is event time, so a dead camera is told of once others' frames move the watermark
    past its timer, and told of once. Frames behind the watermark are dropped; null times play no part.
    """
    schema = "camera_id int, last_frame_at timestamp, outage_at timestamp, silent boolean"
    rows = captures.select(F.col("camera_id").cast("int").alias("camera_id"), "ts").withWatermark("ts", delay)
    return rows.groupBy("camera_id").transformWithStateInPandas(OutageProcessor(round(gap_seconds * 1e6)), schema, "Append", "EventTime")


def late_drops(query: StreamingQuery) -> list[tuple[int, int, int]]:
    """(batch id, rows read, rows dropped behind the watermark) of a query's recent batches that read rows.

    Rows are counted where the first stateful operator reads them; dropping repeated frames first (heartbeat with once) makes
    that one row by row, since a windowed aggregate alone would count groups of late rows.
    """
    out = []
    for p in query.recentProgress:
        p = json.loads(p.json) if hasattr(p, "json") else p
        if p["numInputRows"]:
            out.append((p["batchId"], p["numInputRows"], sum(s.get("numRowsDroppedByWatermark", 0) for s in p["stateOperators"])))
    return out


def localize_by_camera(events: DataFrame, poses: DataFrame, width: int, height: int, fps: float, key: str = "video_id") -> DataFrame:
    """Streamed events joined to a table with one static pose for each camera (key, lon, lat, alt, yaw, pitch, roll): easting, northing, lon, lat, coordinate_status, confirmation_delay_sec and problem.

    events: key, x, y, w, h in a picture of the given size, frame_idx, confirm_frame. Without a pose (no row, or no lon, lat and alt)
    the position is null and its status unavailable; a pose that lacks one of them is told as problem.
    """
    names = ("lon", "lat", "alt", "yaw", "pitch", "roll")
    rows = events.join(poses.select(key, *[F.col(c).alias(f"_{c}") for c in names]), key, "left")
    rows = E.static_position(rows, F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.lit(width), F.lit(height), *[f"_{c}" for c in names])
    rows = rows.withColumns({"lon": F.col("position.lon"), "lat": F.col("position.lat"), "problem": F.col("position.problem"), "_e": F.col("position.easting"), "_n": F.col("position.northing")})
    rows = E.logged_events(rows, fps, static=True)
    known = F.col("lon").isNotNull()
    rows = rows.withColumns({"coordinate_status": F.when(known, F.col("coordinate_status")).otherwise("unavailable"), "easting": F.col("_e"), "northing": F.col("_n")})
    return rows.drop("position", "_e", "_n", *[f"_{c}" for c in names])


class EvidenceSink:
    """A foreachBatch function that writes logged events (the columns of CSV_COLUMNS, and timestamp_sec) as JSON lines, CSV and coordinate text, a folder for each kind and batch, and then a commit for the batch.

    A batch that fails half-way is written anew when the stream restarts; one that has its commit is left alone, since the stream gives
    the same rows to the same batch id. Readers list commits, so they see a batch in all three kinds or in none. One folder belongs to one
    checkpoint.
    """

    KINDS = ("events_jsonl", "detections_csv", "coordinates")

    def __init__(self, folder: str):
        self.folder = folder

    def _files(self, spark: SparkSession, path: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()), where

    def committed_batches(self, spark: SparkSession) -> list[int]:
        files, where = self._files(spark, f"{self.folder}/_commits")
        names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _commit(self, spark: SparkSession, batch_id: int) -> None:
        files, draft = self._files(spark, f"{self.folder}/_commits/.{batch_id}.draft")
        files.create(draft, True).close()
        files.rename(draft, self._files(spark, f"{self.folder}/_commits/{batch_id}")[1])  # one step, so it is there or not

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in self.committed_batches(spark):
            return
        batch = batch.persist()  # three writers read it
        try:
            place = {"lon": "wgs84_lon", "lat": "wgs84_lat", "easting": "twd97_easting", "northing": "twd97_northing"}
            at = lambda kind: f"{self.folder}/{kind}/batch_id={batch_id}"
            E.json_rows(batch).select("json").write.mode("overwrite").text(at("events_jsonl"))
            E.csv_rows(batch).write.mode("overwrite").option("header", True).csv(at("detections_csv"))
            batch.withColumns({k: F.col(v) for k, v in place.items()}).select(E.live_coordinate_line().alias("line")).write.mode("overwrite").text(at("coordinates"))
            self._commit(spark, batch_id)
        finally:
            batch.unpersist()

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        """What committed batches hold of a kind: lines of text (value), or the columns of the CSV as text, empty where there is nothing."""
        paths = [f"{self.folder}/{kind}/batch_id={k}" for k in self.committed_batches(spark)]
        columns = E.CSV_COLUMNS if kind == "detections_csv" else ("value",)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        if not paths:
            return spark.createDataFrame([], schema)
        if kind != "detections_csv":
            return spark.read.text(paths)
        return spark.read.schema(schema).option("header", True).csv(paths).na.fill("")
