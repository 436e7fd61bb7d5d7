"""Streaming forms: keyed state between micro-batches, event-time windows, and sinks that are safe to repeat."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import events as E
from ..operators import motion as M
from ..operators import tracking as T

#: The state store that spills to disk; stateful operators need it.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FrameProcessor(StatefulProcessor):
    """A state machine of one video, frame by frame. Frames that are not after the last one taken are late: they change nothing and are counted.

    With hold_last, the newest frame waits until a later one comes, so its detections may come in several micro-batches; without, a
    micro-batch must hold whole frames.
    """

    def __init__(self, settings: Any, hold_last: bool):
        self.settings, self.hold_last = settings, hold_last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("frames", "state string, held string, late long")

    def start(self, saved: dict | None) -> Any:
        raise NotImplementedError

    def take(self, state: Any, pdf: pd.DataFrame) -> list[dict]:
        """The events of the frames in pdf."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        saved, held, late = self.state.get() if self.state.exists() else (None, None, 0)
        state = self.start(json.loads(saved) if saved else None)
        pdf = pd.concat(list(rows), ignore_index=True)
        behind = pdf["frame_idx"] <= state.last_frame
        late, pdf = late + int(behind.sum()), pdf[~behind]
        if held:
            pdf = pd.concat([pd.DataFrame(json.loads(held)), pdf], ignore_index=True)
        held = None
        if self.hold_last and len(pdf):
            last = pdf["frame_idx"] == pdf["frame_idx"].max()
            held, pdf = pdf[last].to_json(orient="records"), pdf[~last]
        events = [e | {"video_id": int(key[0])} for e in self.take(state, pdf)] if len(pdf) else []
        self.state.update((json.dumps(state.__dict__), held, late))
        yield pd.DataFrame(events, columns=self.columns)

    def close(self) -> None:
        pass


class TrackProcessor(FrameProcessor):
    """The tracker of one video."""

    columns = T.EVENT_COLUMNS

    def start(self, saved: dict | None) -> T.TrackState:
        return T.TrackState(**saved) if saved else T.TrackState()

    def take(self, state: T.TrackState, pdf: pd.DataFrame) -> list[dict]:
        return [e for frame, dets in T.by_frame(pdf) for e in state.step(frame, dets, self.settings)]


class MotionProcessor(FrameProcessor):
    """The motion tracker of one video."""

    columns = [c.split()[0] for c in M.EVENT.split(", ")]

    def start(self, saved: dict | None) -> M.MotionState:
        return M.MotionState(**saved) if saved else M.MotionState()

    def take(self, state: M.MotionState, pdf: pd.DataFrame) -> list[dict]:
        rows = pdf.sort_values(["frame_idx", "cand_id"], ignore_index=True)
        return [e for frame in M.candidates_by_frame(rows) for e in state.step(*frame, self.settings)[0]]


class ThrottleProcessor(StatefulProcessor):
    """Lets a row of a key through if it is at least gap after the last one let through."""

    def __init__(self, clock: str, gap: float):
        self.clock, self.gap = clock, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.clock)
        last, keep = (self.last.get()[0] if self.last.exists() else None), []
        for v in pdf[self.clock]:
            ok = last is None or v - last >= self.gap
            last = float(v) if ok else last
            keep.append(ok)
        self.last.update((last,))
        yield pdf[keep]

    def close(self) -> None:
        pass


class PoseProcessor(StatefulProcessor):
    """Pose status of one video."""

    def __init__(self, fps: float, reference_valid: bool, gps_seed: bool):
        self.fps, self.how = fps, (reference_valid, gps_seed)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pose", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("frame_idx")
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        pdf = pdf[pdf["frame_idx"] > state.get("last", -1)]  # late frames change nothing
        status = [T.pose_step(state, int(r.frame_idx), bool(r.link_ok), bool(r.klt_ok), bool(r.correction_ok), self.fps, *self.how) for r in pdf.itertuples()]
        if len(pdf):
            state["last"] = int(pdf["frame_idx"].iloc[-1])
        self.state.update((json.dumps(state),))
        yield pd.DataFrame({"video_id": pdf["video_id"], "frame_idx": pdf["frame_idx"], "status": status})

    def close(self) -> None:
        pass


def track_detections(rows: DataFrame, settings: T.TrackSettings = T.TrackSettings(), hold_last: bool = False) -> DataFrame:
    """Streaming twin of the batch tracker; rows as from tracker_input. hold_last: see FrameProcessor."""
    return rows.groupBy("video_id").transformWithStateInPandas(TrackProcessor(settings, hold_last), T.EVENT_SCHEMA, "Append", "None")


def track_candidates(rows: DataFrame, settings: M.MotionSettings = M.MotionSettings(), hold_last: bool = False) -> DataFrame:
    """Streaming twin of the batch motion tracker. hold_last: see FrameProcessor."""
    return rows.groupBy("video_id").transformWithStateInPandas(MotionProcessor(settings, hold_last), M.EVENT, "Append", "None")


def throttle(rows: DataFrame, key: str, clock: str, gap: float) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(ThrottleProcessor(clock, gap), rows.schema, "Append", "None")


def pose_status(rows: DataFrame, fps: float, reference_valid: bool = True, gps_seed: bool = False) -> DataFrame:
    return rows.groupBy("video_id").transformWithStateInPandas(PoseProcessor(fps, reference_valid, gps_seed), "video_id int, frame_idx int, status string", "Append", "None")


def dedupe_frames(captures: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Each (camera, frame id) once, as long as the watermark remembers it."""
    return captures.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["camera_id", "camera_frame_id"])


def heartbeat(captures: DataFrame, window: str = "10 seconds", slide: str | None = None, delay: str = "10 seconds", once: bool = False) -> DataFrame:
    """Frames, mean detector time and skipped ids in tumbling or sliding windows of event time. With once, a frame that is repeated counts once, and frames behind the watermark are dropped (and counted, see live.late_drops) one by one before they meet a window."""
    rows = captures.withWatermark("ts", delay)
    if once:
        rows = rows.dropDuplicatesWithinWatermark(["camera_id", "camera_frame_id"])
    out = rows.groupBy("camera_id", F.window("ts", window, slide) if slide else F.window("ts", window)).agg(
        F.count("*").alias("frames"), F.avg("detector_ms").alias("mean_ms"), F.min("camera_frame_id").alias("_a"), F.max("camera_frame_id").alias("_b")
    )
    return out.select("camera_id", F.col("window.start").alias("started"), "frames", "mean_ms", F.greatest(F.col("_b") - F.col("_a") + 1 - F.col("frames"), F.lit(0)).alias("skipped"))


def camera_timeout(captures: DataFrame, gap_seconds: int = 2, delay: str = "10 seconds") -> DataFrame:
    """One row for each session of frames of a camera; it closes when no frame came for the gap."""
    rows = captures.withWatermark("ts", delay).groupBy("camera_id", F.session_window("ts", f"{gap_seconds} seconds").alias("s")).agg(F.count("*").alias("frames"))
    return rows.select("camera_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "frames")


def localize(events: DataFrame, pose: dict, width: int, height: int) -> DataFrame:
    """Position of streamed events by one static pose (lon, lat, alt, yaw, pitch, roll): stateless."""
    rows = events.withColumns({f"_{k}": F.lit(float(v)) for k, v in pose.items()})
    rows = E.static_position(rows, F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.lit(width), F.lit(height), "_lon", "_lat", "_alt", "_yaw", "_pitch", "_roll")
    return rows.drop(*[f"_{k}" for k in pose])


def latest_frames(batch: DataFrame) -> DataFrame:
    """Of one micro-batch the newest frame of each camera, and how many it replaced; for foreachBatch."""
    return batch.groupBy("camera_id").agg(F.max_by(F.struct(*batch.columns), "camera_frame_id").alias("f"), (F.count("*") - 1).alias("replaced")).select("f.*", "replaced")
