"""Pluggable detectors and matchers, and the scalar functions as SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import boxes as X
from ..functions import geo as G

#: Detectors by name; register() adds to it.
DETECTORS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def register(name: str, scorer: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
    DETECTORS[name.strip().lower()] = scorer


def score_frames(frames: DataFrame, scorer: str | Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of a detector (by name or as a function of a pandas batch) over batches of frames."""
    f = DETECTORS[scorer.strip().lower()] if isinstance(scorer, str) else scorer

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield f(batch)

    return frames.mapInPandas(run, schema)


def match_pairs(rows: DataFrame, matcher: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "pair_id") -> DataFrame:
    """Rows of a matcher for each image pair; a pair is one group."""
    return rows.groupBy(key).applyInPandas(matcher, schema)


def _d(names: str) -> dict[str, str]:
    return dict.fromkeys(names.split(), "DOUBLE")


_NINE = "ARRAY<DOUBLE>"
#: SQL functions by name: arguments with their types, and the column form whose expression is the body.
SQL_FUNCTIONS: dict[str, tuple[dict[str, str], Callable[..., Column]]] = {
    "bbox_iou": (_d("ax ay aw ah bx by bw bh"), lambda *_: X.iou("a", "b")),
    "bbox_overlaps": (_d("ax ay aw ah bx by bw bh"), lambda *_: X.overlaps("a", "b")),
    "event_status": ({"name": "STRING"}, X.event_status),
    "event_label": ({"id": "BIGINT"}, X.event_label),
    "format_duration": (_d("seconds"), X.format_duration),
    "stride_from_interval": (_d("interval_sec fps") | {"stride": "INT"}, X.stride_from_interval),
    "transform_point": ({"m": _NINE} | _d("x y"), X.transform_point),
    "dms_to_decimal": (_d("d m s") | {"ref": "STRING"}, G.dms_to_decimal),
    "wgs84_to_twd97": (_d("lon lat"), G.wgs84_to_twd97),
    "twd97_to_wgs84": (_d("easting northing"), G.twd97_to_wgs84),
    "pixel_to_ground": (_d("lon lat alt yaw pitch roll px py width height"), G.pixel_to_ground),
    "camera_rotation": (_d("yaw pitch roll"), G.camera_rotation),
    "camera_matrix": (_d("focal35 width height raster_width raster_height"), G.camera_matrix),
    "plane_homography": ({"k": _NINE, "r": _NINE} | _d("x y z"), G.plane_homography),
    "det3": ({"m": _NINE}, G.det3),
    "invert3": ({"m": _NINE}, G.invert3),
    "camera_heading": ({"r": _NINE}, G.camera_heading),
    "to_en": (_d("lon lat lon0 lat0"), G.to_en),
    "to_gps": (_d("e n lon0 lat0"), G.to_gps),
    "match_pixel_to_geo": ({"h": _NINE} | _d("u v frame_w frame_h roi_w roi_h west north step_x step_y"), G.match_pixel_to_geo),
    "gps_envelope": (_d("lon lat radius"), G.gps_envelope),
    "geo_distance": (_d("lon1 lat1 lon2 lat2"), G.geo_distance),
}


def register_functions(spark: SparkSession, names: Iterable[str] | None = None) -> list[str]:
    """Create the SQL functions (those named, or all) in the session; returns their names.

    The body is the SQL text of the column form over a table of the arguments, so both give the same values.
    """
    wanted = list(SQL_FUNCTIONS if names is None else names)
    for name in wanted:
        arguments, form = SQL_FUNCTIONS[name]
        table = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {kind}) AS {c}" for c, kind in arguments.items()) + " FROM VALUES (1)")
        made = table.select(form(*arguments).alias("v"))
        body = made._jdf.queryExecution().analyzed().expressions().apply(0).child().sql()
        given = ", ".join(f"{c} {kind}" for c, kind in arguments.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {made.schema['v'].dataType.simpleString()} RETURN {body}")
    return wanted
