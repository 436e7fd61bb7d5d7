"""Association, suppression and the per-video state machines of detections, throttling and pose status.

The state machines are plain step functions over one frame at a time. A batch form runs them over a video's frames in
order, along sorted partitions that carry the state from batch to batch; the streaming forms in smokelake.streaming keep the same
state between micro-batches.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as X


@dataclass(frozen=True)
class TrackSettings:
    """Limits of the learned-detector tracker (fixed values)."""

    fps: float = 30.0
    hits: int = 2
    min_iou: float = 0.10
    distance: float = 140.0
    share: float = 0.6
    missed_sec: float = 2.0
    memory_sec: float = 600.0


def association_pairs(tracks: DataFrame, dets: DataFrame, keys: list[str], s: TrackSettings = TrackSettings()) -> DataFrame:
    """Tracks and detections of one frame that may belong together (overlap or distance), with a score, lower is better. Boxes t_x.. and d_x..; the keys are the equi-join."""
    rows = tracks.join(dets, keys)
    reach = X.adaptive_distance("t_", "d_", s.distance, s.share)
    rows = rows.withColumns({"iou": X.iou("t_", "d_"), "distance": X.centre_distance("t_", "d_"), "_reach": reach})
    ok = (F.col("iou") >= s.min_iou) | (F.col("distance") <= F.col("_reach"))
    return rows.filter(ok).withColumn("score", 1 - F.col("iou") + F.col("distance") / F.greatest("_reach", F.lit(1.0))).drop("_reach")


#: Limits of the motion tracker's association, in pixels (fixed values).
MOTION_REACH = {"distance": 200.0, "small": 12.0, "least_area": 35.0, "trajectory": 270.0}


def motion_pairs(tracks: DataFrame, candidates: DataFrame, keys: list[str], limits: dict = MOTION_REACH) -> DataFrame:
    """Tracks and candidates of one frame that may belong together by the motion tracker's rules, with a score, lower is better.

    Overlapping boxes score a quarter of the distance of their centres. Else a small track (t_small, t_area below the least
    area) reaches only a few pixels; others the distance, or the way along their path: t_history, an array of structs x, y.
    Boxes t_x.. and d_x..; the keys are the equi-join.
    """
    rows = tracks.join(candidates, keys)
    cx, cy = F.col("d_x") + F.col("d_w") / 2, F.col("d_y") + F.col("d_h") / 2
    rows = rows.withColumns({"distance": X.centre_distance("t_", "d_"), "_path": X.trajectory_distance("t_history", cx, cy)})
    held = F.col("t_small") & (F.col("t_area") < limits["least_area"]) & (F.col("distance") > limits["small"])
    score = (
        F.when(X.overlaps("t_", "d_"), F.col("distance") / 4).when(held, None).when(F.col("distance") <= limits["distance"], F.col("distance"))
        .when(F.col("_path") <= limits["trajectory"], limits["distance"] + F.col("_path"))
    )
    return rows.withColumn("score", score).filter("score IS NOT NULL").drop("_path")


def greedy(pairs: Iterable[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """One-to-one pairs by ascending score; ties keep their order."""
    used_a, used_b, out = set(), set(), []
    for _, a, b in sorted(pairs, key=lambda p: p[0]):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b))
    return out


def greedy_assign(pairs: DataFrame, keys: list[str], track: str = "track_id", det: str = "det_id") -> DataFrame:
    """One-to-one assignment within each frame: ascending score, then track, then detection.

    Pairs are dealt by frame and sorted within tasks; a task takes them one after the other and holds what the frame at hand has used.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    names = [*keys, track, det]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame, tracks, dets = None, set(), set()
        for pdf in batches:
            keep = []
            for *at, a, b in zip(*[pdf[c].tolist() for c in names], strict=True):
                if at != frame:
                    frame, tracks, dets = at, set(), set()
                free = a not in tracks and b not in dets
                if free:
                    tracks.add(a)
                    dets.add(b)
                keep.append(free)
            yield pdf.loc[keep, names]

    rows = pairs.select(*names, "score").repartition(*keys).sortWithinPartitions(*keys, "score", track, det)
    return rows.mapInPandas(assign, ", ".join(f"{c} {kinds[c]}" for c in names))


def nms_pairs(dets: DataFrame, least: float) -> DataFrame:
    """Detections of one frame and class that overlap by the given IoU or more: the stronger (a) and the weaker (b, ties to the larger number)."""
    side = lambda p: dets.select("video_id", "frame_idx", "cls_id", F.col("det_idx").alias(f"{p}det"), F.col("conf").alias(f"{p}conf"), *[F.col(k).alias(f"{p}{k}") for k in "xywh"])
    rows = side("a").join(side("b"), ["video_id", "frame_idx", "cls_id"])
    stronger = (F.col("aconf") > F.col("bconf")) | ((F.col("aconf") == F.col("bconf")) & (F.col("adet") < F.col("bdet")))
    return rows.filter(stronger & (F.col("adet") != F.col("bdet"))).withColumn("iou", X.iou("a", "b")).filter(F.col("iou") >= least)


def nms(dets: DataFrame, least: float) -> DataFrame:
    """Greedy suppression within a frame and class by confidence, ties to the smaller number. One shuffle: the detections of a frame and class meet in one array and are taken in order."""
    one = F.struct((-F.col("conf")).alias("order"), "det_idx", F.struct(*dets.columns).alias("d"))
    grouped = dets.groupBy("video_id", "frame_idx", "cls_id").agg(F.array_sort(F.collect_list(one)).alias("all"))

    def overlap(a: Column, b: Column) -> Column:
        side = lambda k, n: F.greatest(F.least(a[k] + a[n], b[k] + b[n]) - F.greatest(a[k], b[k]), F.lit(0))
        both = side("x", "w") * side("y", "h")
        return F.coalesce(both / F.nullif(a["w"] * a["h"] + b["w"] * b["h"] - both, F.lit(0)), F.lit(0.0))

    none = F.filter("all", lambda x: F.lit(False))
    kept = F.aggregate("all", none, lambda done, x: F.when(F.exists(done, lambda y: overlap(y["d"], x["d"]) >= least), done).otherwise(F.concat(done, F.array(x))))
    return grouped.select(F.explode(kept).alias("k")).select("k.d.*")


def suppress_duplicates(candidates: DataFrame, memories: DataFrame, window: int, reach: float = 110.0, path_reach: float = 270.0) -> DataFrame:
    """Candidates with the earlier event that they repeat (null: none): confirmed at most window frames before, and the box padded by its margin overlaps, the centres are within reach, or the candidate lies near the event's path. The nearest centre counts, then the first event.

    memories may have a column history, the path as an array of structs x, y. An event is sent to the bins of frames that it
    can reach, so the join is an equi-join.
    """
    size = max(window, 1)
    path = F.col("history") if "history" in memories.columns else F.lit(None).cast("array<struct<x:double,y:double>>")
    m = memories.select("video_id", F.col("event_id").alias("source_id"), F.col("confirm_frame").alias("_cf"), path.alias("_path"), *[F.col(k).alias(f"m{k}") for k in "xywh"])
    m = m.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_cf") / size), F.floor((F.col("_cf") + window) / size))))
    c = candidates.withColumns({f"c{k}": F.col(k) for k in "xywh"}).withColumn("_bin", F.floor(F.col("frame_idx") / size))
    rows = c.join(m, ["video_id", "_bin"]).filter((F.col("frame_idx") > F.col("_cf")) & (F.col("frame_idx") - F.col("_cf") <= window))
    rows = rows.withColumns({f"e{k}": v for k, v in X.expand("m", X.clip_margin("mw", "mh")).items()})
    along = F.coalesce(X.trajectory_distance("_path", F.col("cx") + F.col("cw") / 2, F.col("cy") + F.col("ch") / 2) <= path_reach, F.lit(False))
    rows = rows.withColumn("_d", X.centre_distance("c", "m")).filter(X.overlaps("e", "c") | (F.col("_d") <= reach) | along)
    hit = rows.groupBy("video_id", "cand_id").agg(F.min(F.struct(F.round("_d", 6).alias("d"), "source_id"))["source_id"].alias("source_id"))
    return candidates.join(hit, ["video_id", "cand_id"], "left")


Box = tuple[float, float, float, float]


def _centre(b: Box) -> tuple[float, float]:
    return b[0] + b[2] / 2, b[1] + b[3] / 2


def _iou(a: Box, b: Box) -> float:
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union > 0 else 0.0


def _near(a: Box, b: Box, s: TrackSettings) -> tuple[float, float, float]:
    """IoU, distance and reach of two boxes."""
    return _iou(a, b), math.dist(_centre(a), _centre(b)), max(s.distance, s.share * max(math.hypot(*a[2:]), math.hypot(*b[2:])))


@dataclass
class TrackState:
    """What a video's tracker remembers: tracks, memories [event_id, box, expires], the next numbers and the last frame."""

    tracks: list[dict] = field(default_factory=list)
    memories: list[list] = field(default_factory=list)
    next_track: int = 1
    next_event: int = 1
    last_frame: int = -1

    def known(self, box: Box, s: TrackSettings) -> int | None:
        """The event that a box repeats: of active tracks in order, then of memories."""
        for event, other in [*((t["event"], t["box"]) for t in self.tracks if t["event"] is not None), *((m[0], m[1]) for m in self.memories)]:
            iou, distance, reach = _near(tuple(other), box, s)
            if iou >= s.min_iou or distance <= reach:
                return event
        return None

    def confirm(self, t: dict, frame: int, s: TrackSettings) -> dict:
        t["event"], self.next_event = self.next_event, self.next_event + 1
        x, y, w, h = t["first_box"]
        return {
            "event_id": t["event"], "frame_idx": t["first"], "confirm_frame": frame, "cls_name": t["cls"], "x": x, "y": y, "w": w, "h": h,
            "area": float(w * h), "growth": t["box"][2] * t["box"][3] / max(w * h, 1.0), "confidence": t["peak"], "timestamp_sec": t["first"] / s.fps,
        }

    def step(self, frame: int, dets: list[dict], s: TrackSettings, inferred: bool = True) -> list[dict]:
        """Take one frame (detections with box, conf, cls) and return the events that it confirms. A frame that wasn't inferred only ages."""
        events: list[dict] = []
        self.last_frame = frame
        if inferred:
            self.memories = [m for m in self.memories if frame <= m[2]]
            pairs = []
            for a, t in enumerate(self.tracks):
                for b, d in enumerate(dets):
                    iou, distance, reach = _near(tuple(t["box"]), d["box"], s)
                    if iou >= s.min_iou or distance <= reach:
                        pairs.append(((1 - iou) + distance / max(reach, 1.0), a, b))
            matched = greedy(pairs)
            for a, b in matched:
                t, d = self.tracks[a], dets[b]
                t |= {"box": list(d["box"]), "peak": max(t["peak"], d["conf"]), "seen": t["seen"] + 1, "missed": 0}
                if t["event"] is None and not t["old"] and t["seen"] >= s.hits:
                    events.append(self.confirm(t, frame, s))
            hit = {a for a, _ in matched}
            for a, t in enumerate(self.tracks):
                if a not in hit:
                    t["missed"] += 1
            for b in sorted(set(range(len(dets))) - {b for _, b in matched}):
                d = dets[b]
                event = self.known(d["box"], s)
                t = {"id": self.next_track, "first": frame, "first_box": list(d["box"]), "box": list(d["box"]), "peak": d["conf"], "cls": d["cls"], "seen": 1, "missed": 0, "event": event, "old": event is not None}
                self.tracks.append(t)
                self.next_track += 1
                if event is None and s.hits <= 1:
                    events.append(self.confirm(t, frame, s))
        most = max(round(s.missed_sec * s.fps), 1)
        for t in self.tracks:
            if t["missed"] > most and t["event"] is not None:
                self.memories.append([t["event"], t["box"], frame + round(s.memory_sec * s.fps)])
        self.tracks = [t for t in self.tracks if t["missed"] <= most]
        return events


EVENT_SCHEMA = "video_id int, event_id int, frame_idx int, confirm_frame int, cls_name string, x int, y int, w int, h int, area double, growth double, confidence double, timestamp_sec double"
EVENT_COLUMNS = [c.strip().split()[0] for c in EVENT_SCHEMA.split(",")]


def tracker_input(frames: DataFrame, dets: DataFrame) -> DataFrame:
    """One row for each frame and detection; frames without detections have a row too (det_idx null), since they age tracks."""
    return frames.select("video_id", "frame_idx").join(dets.select("video_id", "frame_idx", "det_idx", "cls_name", "conf", "x", "y", "w", "h"), ["video_id", "frame_idx"], "left")


def by_frame(pdf: pd.DataFrame) -> Iterable[tuple[int, list[dict]]]:
    """Frames in order with their detections in order; a frame without detections is a row whose det_idx is null."""
    pdf = pdf.sort_values(["frame_idx", "det_idx"])
    frames, there = pdf["frame_idx"].to_numpy(), pdf["det_idx"].notna().to_numpy()
    boxes = pdf[["x", "y", "w", "h"]].fillna(0).to_numpy(np.int64).tolist()
    conf, names = pdf["conf"].fillna(0.0).astype(float).tolist(), pdf["cls_name"].tolist()
    edges = [0, *(np.flatnonzero(frames[1:] != frames[:-1]) + 1).tolist(), len(frames)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            yield int(frames[a]), [{"box": tuple(boxes[k]), "conf": conf[k], "cls": names[k]} for k in range(a, b) if there[k]]


def in_order(rows: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], Any], each: Callable[[Any, Any, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """each(key, state, rows) over every key's rows in order, part by part; start() makes a key's state, which is carried from part to part.

    Rows are dealt by key and sorted within tasks, so a task holds one Arrow batch and one state, however long a key goes on.
    Rows that are alike in the first column of order (a frame) come in one part.
    """
    clock = order[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, held = None, None, None
        for pdf in itertools.chain(batches, [None]):
            if pdf is not None:
                pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                last = (pdf[key] == pdf[key].iloc[-1]) & (pdf[clock] == pdf[clock].iloc[-1])  # may go on in the next batch
                held, pdf = pdf[last], pdf[~last]
            else:
                pdf = held
            if pdf is None:
                continue
            for k, part in pdf.groupby(key, sort=False):
                if state is None or k != at:
                    at, state = k, start()
                yield each(k, state, part)

    return rows.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def track_detections(rows: DataFrame, settings: TrackSettings = TrackSettings()) -> DataFrame:
    """Confirmed events of every video from tracker_input rows; event ids count from 1 in each video."""

    def each(video: int, state: TrackState, part: pd.DataFrame) -> pd.DataFrame:
        events = [e | {"video_id": int(video)} for frame, dets in by_frame(part) for e in state.step(frame, dets, settings)]
        return pd.DataFrame(events, columns=EVENT_COLUMNS)

    return in_order(rows, "video_id", ["frame_idx", "det_idx"], EVENT_SCHEMA, TrackState, each)


def throttle(rows: DataFrame, key: str, clock: str, gap: float) -> DataFrame:
    """Rows at least gap after the last row that was let through, for each key. Rows without a key or a time are left out."""

    def each(_: Any, last: list, part: pd.DataFrame) -> pd.DataFrame:
        keep = []
        for v in part[clock]:
            ok = not last or v - last[0] >= gap
            if ok:
                last[:] = [v]
            keep.append(ok)
        return part[keep]

    return in_order(rows.filter(F.col(clock).isNotNull()), key, [clock], rows.schema, list, each)


def pose_step(state: dict, frame: int, link_ok: bool, klt_ok: bool, correction_ok: bool, fps: float, reference_valid: bool = True, gps_seed: bool = False) -> str:
    """Next pose status of a video. state holds status, and the frames of the last link attempt, map check and map fix.

    Without a valid reference image and a seed by GPS, the status stays INITIALIZING. On the first frame and when LOST, a link is
    tried once a second at most; else tracking goes on while it succeeds. After either success a map check is due five
    seconds after the last one, also right behind a link. With a valid reference, a fix older than 15 seconds ends tracking.
    """
    if not (reference_valid or gps_seed):
        return state.setdefault("status", "INITIALIZING")
    valid = False
    if state.get("status", "LOST") in ("LOST", "INITIALIZING"):
        if frame - state.get("link", -1000) >= max(int(fps), 1):
            state["link"] = frame
            valid = link_ok
            if valid:
                state["fix"] = frame
    else:
        valid = klt_ok
    if valid and frame - state.get("check", -1000) >= int(5 * fps):
        state["check"] = frame
        if correction_ok:
            state["fix"] = frame
    if valid and reference_valid and "fix" in state and frame - state["fix"] > int(15 * fps):
        valid = False
    state["status"] = ("VO_TRACKING" if reference_valid else "VO_GPS_ESTIMATE") if valid else "LOST"
    return state["status"]


def pose_status(rows: DataFrame, fps: float, reference_valid: bool = True, gps_seed: bool = False) -> DataFrame:
    """Status of every frame; columns video_id, frame_idx, link_ok, klt_ok, correction_ok."""

    def each(_: Any, state: dict, part: pd.DataFrame) -> pd.DataFrame:
        frames = zip(part["frame_idx"].tolist(), part["link_ok"].tolist(), part["klt_ok"].tolist(), part["correction_ok"].tolist(), strict=True)
        status = [pose_step(state, int(f), bool(a), bool(b), bool(c), fps, reference_valid, gps_seed) for f, a, b, c in frames]
        return pd.DataFrame({"video_id": part["video_id"], "frame_idx": part["frame_idx"], "status": status})

    return in_order(rows, "video_id", ["frame_idx"], "video_id int, frame_idx int, status string", dict, each)


def outages(captures: DataFrame, gap_seconds: int = 2) -> DataFrame:
    """Sessions of each camera without a gap of so many seconds: every session's end is an outage."""
    rows = captures.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("camera_id", F.session_window("ts", f"{gap_seconds} seconds").alias("s")).agg(F.count("*").alias("frames")).select("camera_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "frames")


def latest_frames(captures: DataFrame, trigger_seconds: int) -> DataFrame:
    """The newest frame of each camera and trigger interval, and how many it replaced."""
    slot = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / trigger_seconds).cast("long")
    newest = Window.partitionBy("camera_id", "slot").orderBy(F.desc("camera_frame_id"))
    rows = captures.withColumn("slot", slot).withColumns({"_n": F.row_number().over(newest), "replaced": F.count("*").over(Window.partitionBy("camera_id", "slot")) - 1})
    return rows.filter("_n = 1").drop("_n")
