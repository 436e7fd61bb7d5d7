"""Column functions on boxes, points and tracks in pixels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def in_classes(name, targets: Iterable[str]) -> Column:
    """Trimmed lower-case name is one of the targets; no target lets all pass."""
    wanted = sorted({t.strip().lower() for t in targets if t.strip()})
    return F.lower(F.trim(_c(name))).isin(wanted) if wanted else F.lit(True)


def argmax(scores) -> Column:
    """Place of the largest score, the first on ties; null for empty arrays."""
    a = _c(scores)
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)) - 1).cast("int")


def xyxy_to_xywh(x1, y1, x2, y2) -> Column:
    """Corners to a box of whole pixels, sides at least 1 (half to even), with centre and area."""
    x, y = F.bround(_c(x1)).cast("int"), F.bround(_c(y1)).cast("int")
    w = F.greatest(F.bround(_c(x2) - _c(x1)).cast("int"), F.lit(1))
    h = F.greatest(F.bround(_c(y2) - _c(y1)).cast("int"), F.lit(1))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), (x + w / 2).alias("cx"), (y + h / 2).alias("cy"), (w * h).alias("area"))


def unletterbox(cx, cy, w, h, size, frame_w, frame_h) -> Column:
    """A box (centre, sides) of a padded square of the given size, as corners in the frame, clamped to it."""
    size, fw, fh = _c(size).cast("double"), _c(frame_w).cast("double"), _c(frame_h).cast("double")
    scale = F.least(size / fw, size / fh)
    pad_x, pad_y = (size - fw * scale) / 2, (size - fh * scale) / 2
    side = lambda v, pad, most: F.least(F.greatest((v - pad) / scale, F.lit(0.0)), most)
    cx, cy, w, h = map(_c, (cx, cy, w, h))
    return F.struct(side(cx - w / 2, pad_x, fw).alias("x1"), side(cy - h / 2, pad_y, fh).alias("y1"), side(cx + w / 2, pad_x, fw).alias("x2"), side(cy + h / 2, pad_y, fh).alias("y2"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of boxes held in columns with the prefixes a and b (x, y, w, h); 0 without a union."""
    ax, ay, aw, ah = (F.col(f"{a}{k}") for k in "xywh")
    bx, by, bw, bh = (F.col(f"{b}{k}") for k in "xywh")
    w = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0))
    h = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0))
    both = w * h
    union = aw * ah + bw * bh - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def overlaps(a: str, b: str) -> Column:
    """The boxes share area (edges that touch don't count)."""
    ax, ay, aw, ah = (F.col(f"{a}{k}") for k in "xywh")
    bx, by, bw, bh = (F.col(f"{b}{k}") for k in "xywh")
    return (ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)


def expand(prefix: str, margin) -> dict[str, Column]:
    """x, y, w, h of the box padded by the rounded margin on each side."""
    m = F.bround(_c(margin)).cast("int")
    x, y, w, h = (F.col(f"{prefix}{k}") for k in "xywh")
    return {"x": x - m, "y": y - m, "w": w + 2 * m, "h": h + 2 * m}


def clip_margin(w, h) -> Column:
    """0.65 of the longer side, between 18 and 60."""
    return F.least(F.greatest(F.greatest(_c(w), _c(h)) * 0.65, F.lit(18.0)), F.lit(60.0))


def adaptive_distance(a: str, b: str, least: float = 140.0, share: float = 0.6) -> Column:
    """How far centres of the boxes a and b may lie apart: least, or a share of the longer diagonal."""
    diagonal = lambda p: F.hypot(F.col(f"{p}w").cast("double"), F.col(f"{p}h").cast("double"))
    return F.greatest(F.lit(least), share * F.greatest(diagonal(a), diagonal(b)))


def centre_distance(a: str, b: str) -> Column:
    dx = (F.col(f"{a}x") + F.col(f"{a}w") / 2) - (F.col(f"{b}x") + F.col(f"{b}w") / 2)
    dy = (F.col(f"{a}y") + F.col(f"{a}h") / 2) - (F.col(f"{b}y") + F.col(f"{b}h") / 2)
    return F.hypot(dx, dy)


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point to a segment; a segment without length is a point."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / length, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def trajectory_distance(history, px, py) -> Column:
    """Least distance of a point to a polyline (array of structs x, y) and to its last segment carried on twice; null without points."""
    h, px, py = _c(history), _c(px), _c(py)
    n = F.size(h)
    steps = F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), lambda a, b: segment_distance(px, py, a["x"], a["y"], b["x"], b["y"]))
    last, prior = F.element_at(h, -1), F.get(h, n - 2)
    ahead = segment_distance(px, py, last["x"], last["y"], last["x"] + 2 * (last["x"] - prior["x"]), last["y"] + 2 * (last["y"] - prior["y"]))
    first = F.get(h, F.lit(0))
    return F.when(n == 1, F.hypot(px - first["x"], py - first["y"])).when(n > 1, F.least(F.array_min(steps), ahead))


def projected(m, x, y) -> tuple[Column, Column, Column]:
    """x, y and depth of a point under a 2x3 or 3x3 row-major matrix (array of 6 or 9 doubles); x and y are null where the depth is nearly 0."""
    m, x, y = _c(m), _c(x), _c(y)
    at = lambda k: F.get(m, F.lit(k))
    depth = F.when(F.size(m) == 9, at(6) * x + at(7) * y + at(8)).otherwise(F.lit(1.0))
    over = F.when(F.abs(depth) > 1e-10, depth)
    return (at(0) * x + at(1) * y + at(2)) / over, (at(3) * x + at(4) * y + at(5)) / over, depth


def transform_point(m, x, y) -> Column:
    """A point under a matrix as a struct x, y; null where the depth is nearly 0."""
    px, py, depth = projected(m, x, y)
    return F.when(F.abs(depth) > 1e-10, F.struct(px.alias("x"), py.alias("y")))


def transform_box(m, x, y, w, h, frame_w, frame_h) -> Column:
    """Whole-pixel hull of the box's four corners under the matrix, clipped to the frame; sides at least 1."""
    x, y, w, h, fw, fh = map(_c, (x, y, w, h, frame_w, frame_h))
    corners = [transform_point(m, a, b) for a, b in ((x, y), (x + w, y), (x, y + h), (x + w, y + h))]
    xs, ys = [c["x"] for c in corners], [c["y"] for c in corners]
    x1 = F.least(F.greatest(F.floor(F.least(*xs)), F.lit(0)), fw - 1).cast("int")
    y1 = F.least(F.greatest(F.floor(F.least(*ys)), F.lit(0)), fh - 1).cast("int")
    x2 = F.greatest(F.least(F.ceil(F.greatest(*xs)), fw), x1 + 1).cast("int")
    y2 = F.greatest(F.least(F.ceil(F.greatest(*ys)), fh), y1 + 1).cast("int")
    return F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))


def scale_raster(x, y, from_w, from_h, to_w, to_h) -> Column:
    """A point of one raster in another of the same view."""
    return F.struct((_c(x) * _c(to_w) / _c(from_w)).alias("x"), (_c(y) * _c(to_h) / _c(from_h)).alias("y"))


def event_status(name) -> Column:
    """Status text of an event's class (fixed values)."""
    n = F.lower(F.trim(_c(name)))
    return F.when(n.isin("boom", "smoke"), F.concat(F.lit("new-impact-"), n)).otherwise(F.concat(F.lit("detected-"), n))


def event_label(event_id) -> Column:
    return F.format_string("S%02d", _c(event_id))


def format_duration(seconds) -> Column:
    """HH:MM:SS, or MM:SS below an hour; seconds half to even, never negative."""
    s = F.greatest(F.bround(_c(seconds)).cast("long"), F.lit(0).cast("long"))
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long"), F.pmod(s, F.lit(60)).cast("long")
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def stride_from_interval(interval, fps, stride) -> Column:
    """Frames between samples: interval * fps, half to even, at least 1; without an interval, the stride."""
    return F.when(_c(interval) > 0, F.greatest(F.bround(_c(interval) * _c(fps)).cast("int"), F.lit(1))).otherwise(_c(stride).cast("int"))
