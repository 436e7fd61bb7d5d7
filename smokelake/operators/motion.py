"""The motion tracker of a video: candidates of each frame become tracks, evidence confirms them as events, and memories of events keep repeats away.

MotionState takes one frame at a time and is plain data, so a batch carries it along sorted rows and a stream keeps it between
micro-batches. What needs pixels stays out: a memory is not aligned with the scene again after long camera moves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from .tracking import greedy


@dataclass(frozen=True)
class MotionSettings:
    """Limits of the motion tracker (fixed values). Pairs are for normal and for small candidates."""

    fps: float = 30.0
    reach: float = 200.0
    small_reach: float = 12.0
    path_reach: float = 270.0
    confirm_area: float = 35.0
    small_area: float = 4.0
    growth: tuple[float, float] = (1.3, 1.35)
    override_growth: float = 4.5
    still_growth: float = 1.08
    patience: int = 4
    side_growth: float = 1.08
    balance: float = 0.55
    shift: tuple[float, float] = (0.65, 1.0)
    polarity: tuple[float, float] = (0.60, 0.62)
    coherence: tuple[float, float] = (0.24, 0.18)
    fill: tuple[float, float] = (0.16, 0.18)
    snr: float = 2.2
    outward: float = 0.60
    vectors: int = 8
    overlap: float = 0.55
    retention: tuple[float, float] = (0.75, 0.40)
    short_growth: float = 1.20
    window: int = 3
    hits: tuple[int, int] = (2, 3)
    small_signal: float = 700.0
    edge_fill: float = 0.40
    max_missed: int = 6
    max_tentative: int = 8
    max_event_sec: float = 3.0
    snapshot_sec: float = 10.0
    snapshots: int = 64
    track_points: int = 16
    memory_sec: float = 600.0
    memories: int = 12
    memory_points: int = 256
    memory_reach: float = 110.0
    margin: tuple[float, float, float] = (0.65, 18.0, 60.0)
    follow: tuple[float, float, float] = (22.0, 90.0, 140.0)
    frontier_sec: float = 0.75
    branches: int = 5
    retrigger: tuple[float, float] = (70.0, 4.5)
    small_retrigger: tuple[float, float, float] = (35.0, 8.0, 4.0)

    def frames(self, seconds: float) -> int:
        return max(round(seconds * self.fps), 1)


CANDIDATE = "video_id int, frame_idx int, measured boolean, cand_id int, x int, y int, w int, h int, cx double, cy double, area double, polarity double, coherence double, fill double, snr double, mean_abs_delta double, noise double, prior_overlap double, small boolean, edge boolean, outward double, vectors int"
EVENT = "video_id int, event_id int, frame_idx int, x int, y int, w int, h int, area double, growth double, radial double, timestamp_sec double"
ENDED = "video_id int, frame_idx int, event_id int, reason string"


def _overlap(a: list, b: list, pad: int = 0) -> bool:
    return a[0] - pad < b[0] + b[2] and b[0] < a[0] + a[2] + pad and a[1] - pad < b[1] + b[3] and b[1] < a[1] + a[3] + pad


def _to_segment(p, a, b) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dy * dy
    r = 0.0 if length <= 0 else min(max(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / length, 0.0), 1.0)
    return math.dist(p, (a[0] + r * dx, a[1] + r * dy))


def path_distance(path: list, p) -> float:
    """Least distance of a point to a path and to its last step carried on twice."""
    if len(path) == 1:
        return math.dist(path[0], p)
    (ax, ay), (bx, by) = path[-2], path[-1]
    ends = [*path, [bx + 2 * (bx - ax), by + 2 * (by - ay)]]
    return min(_to_segment(p, a, b) for a, b in zip(ends[:-1], ends[1:], strict=True))


@dataclass
class MotionState:
    """tracks in order of creation; memories by event in order of confirmation; snapshots of ended events, the oldest first."""

    tracks: list[dict] = field(default_factory=list)
    memories: list[dict] = field(default_factory=list)
    snapshots: list[dict] = field(default_factory=list)
    next_event: int = 1
    last_frame: int = -1

    def step(self, frame: int, measured: bool, candidates: list[dict], s: MotionSettings) -> tuple[list[dict], list[dict]]:
        """Take one frame; returns the events that it confirms and those that end with it. A frame without a measurement only ages."""
        self.last_frame = frame
        born: list[dict] = []
        life = s.frames(s.memory_sec)
        self.memories = [m for m in self.memories if frame - m["confirm"] <= life and frame - m["update"] <= life]
        if measured:
            self._follow(frame, candidates, s)
            pairs = [(score, a, b) for a, t in enumerate(self.tracks) for b, c in enumerate(candidates) if (score := self._score(t, c, s)) is not None]
            matched = greedy(pairs)
            for a, b in matched:
                event = self._observe(self.tracks[a], candidates[b], frame, s)
                born += [event] if event else []
            taken = {a for a, _ in matched}
            for a, t in enumerate(self.tracks):
                t["missed"] += a not in taken
            for b in sorted({*range(len(candidates))} - {b for _, b in matched}):
                c = candidates[b]
                self.tracks.append({
                    "first": frame, "seen": frame, "box": c["box"], "path": [c["at"]], "areas": [c["area"]], "overlap": c["prior_overlap"], "small": c["small"], "signal": self._signal(c), "peak": 1.0,
                    "still": 0, "missed": 0, "hits": 0, "signed": None, "event": None, "confirm": None, "repeats": None,
                })
        return born, self._end(frame, s)

    @staticmethod
    def _signal(c: dict) -> float:
        return c["area"] * max(c["mean_abs_delta"] - c["noise"], 0.0)

    @staticmethod
    def _score(t: dict, c: dict, s: MotionSettings) -> float | None:
        far = math.dist(t["path"][-1], c["at"])
        if _overlap(t["box"], c["box"]):
            return far / 4
        if t["small"] and t["areas"][-1] < s.confirm_area and far > s.small_reach:
            return None
        if far <= s.reach:
            return far
        along = path_distance(t["path"], c["at"])
        return s.reach + along if along <= s.path_reach else None

    def _follow(self, frame: int, candidates: list[dict], s: MotionSettings) -> None:
        """Memories take candidates near their latest observations, the newest memory first, a few each; the candidates stay free for tracks."""
        base, speed, most = s.follow
        used: set[int] = set()
        for m in sorted(self.memories, key=lambda m: -m["update"]):
            front = [(f, p) for f, p, _ in m["seen"] if f >= m["update"] - s.frames(s.frontier_sec)] or [m["seen"][-1][:2]]
            options = []
            for k, c in enumerate(candidates):
                near = [d for f, p in front if (d := math.dist(p, c["at"])) <= min(base + speed * max(frame - f, 1) / s.fps, most)]
                if k not in used and near:
                    options.append((min(near) - 0.3 * min(math.sqrt(max(c["area"], 0.0)), 25.0), k))
            for _, k in sorted(options)[: s.branches]:
                used.add(k)
                self._remember(m, candidates[k], frame, s)

    @staticmethod
    def _remember(m: dict, c: dict, frame: int, s: MotionSettings) -> None:
        m["update"] = frame
        m["seen"] = [*m["seen"], [frame, c["at"], c["box"]]][-s.memory_points :]

    def _observe(self, t: dict, c: dict, frame: int, s: MotionSettings) -> dict | None:
        """Add a candidate to its track; the event if that confirms it."""
        before, box, was = t["areas"][-1], t["box"], t["path"][-1]
        t["areas"] = [*t["areas"], c["area"]][-s.track_points :]
        short = c["area"] / max(t["areas"][max(len(t["areas"]) - 4, 0)], 1.0)
        growth = max(c["area"] / max(before, 1.0), short)
        t |= {"box": c["box"], "path": [*t["path"], c["at"]][-s.track_points :], "seen": frame, "missed": 0, "small": t["small"] or c["small"], "signal": t["signal"] + self._signal(c), "peak": max(t["peak"], growth), "still": t["still"] + 1 if growth < s.still_growth else 0}
        if t["event"] is not None or t["repeats"] is not None:
            return None
        if self._signed(t, c, frame, s, before, short, growth, box, was):
            t["hits"] = t["hits"] + 1 if t["signed"] is not None and frame - t["signed"] <= s.window else 1
            t["signed"] = frame
        elif t["signed"] is not None and frame - t["signed"] > s.window:
            t["hits"], t["signed"] = 0, None
        shaped = not (t["small"] and c["edge"]) or c["fill"] >= s.edge_fill
        normal = shaped and c["area"] >= s.confirm_area
        small = shaped and t["small"] and t["signal"] >= s.small_signal and t["peak"] >= s.growth[1]
        if not (normal or small) or t["hits"] < s.hits[0 if normal else 1]:
            return None
        source = self._repeats(t, c, frame, s)
        if source is not None:
            t["repeats"], t["hits"] = source, 0
            for m in self.memories:
                if m["event"] == source:
                    self._remember(m, c, frame, s)
            return None
        t["event"], t["confirm"], self.next_event = self.next_event, frame, self.next_event + 1
        if len(self.memories) >= s.memories:
            self.memories.remove(min(self.memories, key=lambda m: (m["update"], m["confirm"])))
        self.memories.append({"event": t["event"], "confirm": frame, "update": frame, "seen": []})
        self._remember(self.memories[-1], c, frame, s)
        x, y, w, h = c["box"]
        return {"event_id": t["event"], "frame_idx": frame, "x": x, "y": y, "w": w, "h": h, "area": c["area"], "growth": growth, "radial": c["outward"], "timestamp_sec": frame / s.fps}

    @staticmethod
    def _signed(t: dict, c: dict, frame: int, s: MotionSettings, before: float, short: float, growth: float, box: list, was: list) -> bool:
        """Whether the observation looks like a plume: one that begins or goes on, by the rules for normal or for small ones."""
        (w0, h0), (w1, h1) = ([max(v, 1) for v in b[2:]] for b in (box, c["box"]))
        sides = (w1 / w0, h1 / h0)
        shift = math.dist(was, c["at"]) / max((math.hypot(w0, h0) + math.hypot(w1, h1)) / 2, 1.0)
        expands = min(sides) >= s.side_growth and min(sides) / max(*sides, 1e-6) >= s.balance and shift <= s.shift[0]
        outward = c["outward"] is not None and c["vectors"] >= s.vectors and c["outward"] >= s.outward
        recent = t["hits"] > 0 and t["signed"] is not None and frame - t["signed"] <= s.window
        fresh = t["overlap"] <= s.overlap
        looks = [c["polarity"] >= s.polarity[k] and c["coherence"] >= s.coherence[k] and c["fill"] >= s.fill[k] for k in (0, 1)]
        if looks[0]:
            moves = expands or outward or (growth >= s.override_growth and shift <= s.shift[0])
            if fresh and moves and c["area"] >= s.confirm_area and growth >= s.growth[0]:
                return True
            if recent and c["area"] >= s.retention[0] * before and short >= s.short_growth and shift <= s.shift[0]:
                return True
        if not (t["small"] and looks[1] and c["snr"] >= s.snr and shift <= s.shift[1]):
            return False
        return (fresh and c["area"] >= s.small_area and growth >= s.growth[1]) or (recent and c["area"] >= s.retention[1] * before)

    def _repeats(self, t: dict, c: dict, frame: int, s: MotionSettings) -> int | None:
        """The earlier event that a track repeats: of the memories, then, unless the evidence is strong enough for a new one, of live and ended events."""
        ratio, least, most = s.margin
        since, life = frame - s.frames(s.memory_sec), s.frames(s.memory_sec)
        for m in self.memories:
            seen = [o for o in m["seen"] if o[0] >= since]
            if frame - m["confirm"] > life or frame - m["update"] > life or not seen:
                continue
            padded = any(_overlap(b, c["box"], round(min(max(max(b[2:]) * ratio, least), most))) for _, _, b in seen)
            if padded or min(math.dist(p, c["at"]) for _, p, _ in seen) <= s.memory_reach:
                return m["event"]
        if c["area"] >= s.retrigger[0] and t["peak"] >= s.retrigger[1]:
            return None
        area, growth, times = s.small_retrigger
        if t["small"] and c["area"] >= area and t["peak"] >= growth and t["signal"] >= times * s.small_signal and t["overlap"] <= s.overlap:
            return None
        for o in [*(o for o in self.tracks if o["event"] is not None), *self.snapshots]:
            if frame - o["seen"] <= s.frames(s.snapshot_sec) and (_overlap(o["box"], c["box"]) or math.dist(o["path"][-1], c["at"]) <= s.reach or path_distance(o["path"], c["at"]) <= s.path_reach):
                return o["event"]
        return None

    def _end(self, frame: int, s: MotionSettings) -> list[dict]:
        """Drop what is over, by the first reason that holds; returns the events among it."""
        left, ended = [], []
        for t in self.tracks:
            reason = None
            if t["confirm"] is not None and frame - t["confirm"] >= s.frames(s.max_event_sec):
                reason = "timeout"
            elif t["confirm"] is not None and t["still"] >= s.patience:
                reason = "growth_stalled"
            elif t["missed"] > s.max_missed:
                reason = "missed"
            elif t["confirm"] is None and frame - t["first"] >= s.max_tentative:
                reason = "tentative_timeout"
            if reason is None:
                left.append(t)
            elif t["event"] is not None:
                self.snapshots = [*self.snapshots, {k: t[k] for k in ("event", "seen", "box", "path")}][-s.snapshots :]
                ended.append({"frame_idx": frame, "event_id": t["event"], "reason": reason})
        self.tracks = left
        return ended


def candidates_by_frame(pdf: pd.DataFrame) -> Iterator[tuple[int, bool, list[dict]]]:
    """Frames in order, whether each was measured, and its candidates in order; a frame without candidates is a row with cand_id null."""
    at = {c: pdf[c].to_numpy() for c in pdf.columns}
    start = 0
    for k in range(1, len(pdf) + 1):
        if k < len(pdf) and at["frame_idx"][k] == at["frame_idx"][start]:
            continue
        found = []
        for r in range(start, k):
            if pd.isna(at["cand_id"][r]):
                continue
            c = {n: float(at[n][r]) for n in ("area", "polarity", "coherence", "fill", "snr", "mean_abs_delta", "noise", "prior_overlap")}
            outward = at["outward"][r]
            c |= {"box": [int(at[n][r]) for n in "xywh"], "at": [float(at["cx"][r]), float(at["cy"][r])], "small": bool(at["small"][r]), "edge": bool(at["edge"][r])}
            found.append(c | {"outward": None if pd.isna(outward) else float(outward), "vectors": 0 if pd.isna(at["vectors"][r]) else int(at["vectors"][r])})
        yield int(at["frame_idx"][start]), bool(at["measured"][start]), found
        start = k


def _in_order(rows: DataFrame, schema: str, each) -> DataFrame:
    """Rows of every video in order, in sorted partitions: each(video, state, frame, measured, candidates) gives output rows; a task holds one batch and one state."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, state, held = None, MotionState(), None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf["video_id"] == pdf["video_id"].iloc[-1]) & (pdf["frame_idx"] == pdf["frame_idx"].iloc[-1])  # may go on in the next batch
            held, out = pdf[last], []
            for v, part in pdf[~last].groupby("video_id", sort=False):
                if v != video:
                    video, state = v, MotionState()
                out += [r for frame in candidates_by_frame(part) for r in each(int(v), state, *frame)]
            yield pd.DataFrame(out, columns=names)
        if held is not None and len(held):
            v = held["video_id"].iloc[0]
            state = state if v == video else MotionState()
            yield pd.DataFrame([r for frame in candidates_by_frame(held) for r in each(int(v), state, *frame)], columns=names)

    return rows.repartition("video_id").sortWithinPartitions("video_id", "frame_idx", "cand_id").mapInPandas(run, schema)


def track_candidates(rows: DataFrame, settings: MotionSettings = MotionSettings()) -> DataFrame:
    """Confirmed events of every video from rows of CANDIDATE; event ids count from 1 in each video."""
    return _in_order(rows, EVENT, lambda v, state, *frame: [e | {"video_id": v} for e in state.step(*frame, settings)[0]])


def ended_events(rows: DataFrame, settings: MotionSettings = MotionSettings()) -> DataFrame:
    """When and why each event's track ended: timeout, growth_stalled or missed."""
    return _in_order(rows, ENDED, lambda v, state, *frame: [e | {"video_id": v} for e in state.step(*frame, settings)[1]])


MEMORY = "video_id int, frame_idx int, event_id int, confirm_frame int, last_update int, observations int"


def event_memories(rows: DataFrame, settings: MotionSettings = MotionSettings()) -> DataFrame:
    """The memories of events after each frame that updated one of them."""

    def each(v: int, state: MotionState, frame: int, measured: bool, candidates: list[dict]) -> list[dict]:
        state.step(frame, measured, candidates, settings)
        return [{"video_id": v, "frame_idx": frame, "event_id": m["event"], "confirm_frame": m["confirm"], "last_update": frame, "observations": len(m["seen"])} for m in state.memories if m["update"] == frame]

    return _in_order(rows, MEMORY, each)
