"""Small tables with known answers, and batch forms against streams."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from smokelake.functions import boxes as X
from smokelake.functions import geo as G
from smokelake.operators import dataset, events, frames, matching, tiles, tracking
from smokelake.streaming import live as L
from smokelake.streaming import pipelines as P


def test_iou_edges(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 0, 0, 10, 10), (0, 0, 10, 10, 10, 0, 5, 5), (0, 0, 0, 0, 0, 0, 0, 0)], "ax int, ay int, aw int, ah int, bx int, by int, bw int, bh int")
    assert [round(r[0], 6) for r in df.select(X.iou("a", "b")).collect()] == [1.0, 0.0, 0.0]
    assert [r[0] for r in df.select(X.overlaps("a", "b")).collect()] == [True, False, False]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5, 1.5, 0.6, 2.0)], "a double, b double, c double, d double")
    b = df.select(X.xyxy_to_xywh("a", "b", "c", "d").alias("b")).first().b
    assert (b.x, b.y, b.w, b.h) == (0, 2, 1, 1)


def test_round_trip_of_coordinates(spark):
    df = spark.createDataFrame([(121.5, 25.03), (120.2, 22.6), (121.0, 24.0)], "lon double, lat double").withColumn("p", G.wgs84_to_twd97("lon", "lat"))
    back = df.withColumn("q", G.twd97_to_wgs84("p.easting", "p.northing")).collect()
    assert all(abs(r.q.lon - r.lon) < 1e-6 and abs(r.q.lat - r.lat) < 1e-6 for r in back)
    assert abs(back[2].p.easting - 250000) < 1e-6


def test_hits_start_again_after_a_gap(spark):
    df = spark.createDataFrame([(0, 0, f) for f in (1, 2, 5, 9, 12)], "video_id int, cls_id int, frame_idx int")
    got = {r.frame_idx: r.hits for r in frames.confirmation_hits(df, ["video_id", "cls_id"]).collect()}
    assert got == {1: 1, 2: 2, 5: 3, 9: 1, 12: 2}  # a gap of exactly 3 goes on


def test_active_until_the_hold_ends(spark):
    f = spark.createDataFrame([(0, i) for i in range(20)], "video_id int, frame_idx int")
    e = spark.createDataFrame([(0, 1, 5)], "video_id int, event_id int, confirm_frame int")
    assert sorted(r.frame_idx for r in events.active_events(f, e, 4).collect()) == [5, 6, 7, 8, 9]


def test_pair_media_takes_any_other_video(spark):
    names = ["a_V.mkv", "a_V.ts", "a_P.JPG", "b_V.webm", "b_V.avi", "b_P.png", "c_V.mp4.part", "c_P.jpg", "d_V.mp4", "d_P.tiff", "e_V.mov", "e_V.MP4", "e_P.jpeg"]
    got = {r.stem: (r.video, r.image) for r in dataset.pair_media(spark.createDataFrame([(f"x/{n}",) for n in names], "path string")).collect()}
    want = {"a": ("a_V.mkv", "a_P.JPG"), "b": ("b_V.avi", "b_P.png"), "c": ("c_V.mp4.part", "c_P.jpg"), "e": ("e_V.MP4", "e_P.jpeg")}
    assert got == {k: (f"x/{v}", f"x/{p}") for k, (v, p) in want.items()}


def test_parse_labels_reasons(spark):
    lines = [(1, 1, "0 0.5 0.5 0.1 0.1"), (1, 2, "9 0.5 0.5 0.1 0.1"), (1, 3, "0 nan 0.5 0.1 0.1"), (1, 4, "0 0.5 0.5 0 0.1"), (1, 5, "0 2 0.5 0.1 0.1"), (1, 6, "0 1"), (1, 7, "  "), (1, 8, "0 0.1 0.1 0.9 0.1 0.5 0.8")]
    got = {r.line_no: r.reason for r in dataset.parse_labels(spark.createDataFrame(lines, "image_id int, line_no int, line string"), 3).collect()}
    assert got == {1: None, 2: "unknown_class", 3: "not_a_number", 4: "empty_box", 5: "out_of_range", 6: "token_count", 8: None}


def test_split_keeps_equal_content_together(spark, tmp_path):
    images = spark.createDataFrame([(i, f"s{i % 3}", f"train/{i:03d}.jpg", str(i // 2)) for i in range(40)], "image_id long, source string, rel_path string, content string")
    boxes = spark.createDataFrame([(i, 0, 0.5, 0.5, 0.1, 0.1) for i in range(40)], "image_id long, class_id int, cx double, cy double, bw double, bh double")
    out = dataset.build_dataset(images.filter("source = 's0'"), images.filter("source <> 's0'"), boxes, str(tmp_path / "v1"), "s")
    assert out.count() == 40 and out.select("file").distinct().count() == 40
    assert dataset.split_leakage(out).count() == 0
    assert dataset.validate_output(out, images, "image_id").count() == 0
    with pytest.raises(Exception, match="already exists"):
        dataset.build_dataset(images.filter("source = 's0'"), images.filter("source <> 's0'"), boxes, str(tmp_path / "v1"), "s")


def test_nms_chain(spark):
    rows = [(0, 0, 0, 0, 0.9, 0, 0, 10, 10), (0, 0, 1, 0, 0.8, 2, 0, 10, 10), (0, 0, 2, 0, 0.7, 4, 0, 10, 10)]
    df = spark.createDataFrame(rows, "video_id int, frame_idx int, det_idx int, cls_id int, conf double, x int, y int, w int, h int")
    assert sorted(r.det_idx for r in tracking.nms(df, 0.5).collect()) == [0, 2]  # 1 falls to 0, so it can't drop 2


def test_greedy_is_one_to_one():
    assert tracking.greedy([(0.2, 0, 0), (0.1, 0, 1), (0.3, 1, 1), (0.4, 1, 0)]) == [(0, 1), (1, 0)]


def test_hull(spark):
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10), (5, 5))] + [(2, 1.0, 1.0)], "pair_id int, ax double, ay double")
    assert {r.pair_id: r.coverage for r in matching.hull_coverage(df, 10, 20).collect()} == {1: 0.5, 2: 0.0}


def test_tile_lookup_has_no_nested_loop_for_cells(spark):
    t = spark.createDataFrame([(1, "a", "a/1", 120.0, 23.0, 120.1, 23.1), (2, "b", "b/2", 125.0, 23.0, 125.1, 23.1)], "tile_id int, region string, path string, west double, south double, east double, north double")
    p = spark.createDataFrame([(1, 120.05, 23.05), (2, 130.0, 23.0)], "point_id int, lon double, lat double")
    assert [(r.point_id, r.tile_id) for r in tiles.tiles_near(p, t, 1000, 3).collect()] == [(1, 1)]


def _metres(lon1, lat1, lon2, lat2):
    return math.hypot((lon1 - lon2) * 111412.84 * math.cos(math.radians((lat1 + lat2) / 2)), (lat1 - lat2) * 111132.954)


def test_nearest_submap_against_all_tiles(spark):
    """Near and far points, the poles, the antimeridian, tiles of many cells, points without a place and tiles without lawful bounds."""
    t = [("a", 120.0, 23.0, 120.1, 23.1), ("b", 120.3, 23.0, 120.4, 23.1), ("c", 125.0, 23.0, 125.1, 23.1), ("d", 179.9, 0.0, 180.0, 0.1), ("n", 120.0, 23.1 + 4995 / 111132.954, 120.1, 23.4), ("w", -60.0, -20.0, -50.0, -10.0)]
    p = [(1, 120.05, 23.05), (2, 120.19, 23.02), (3, 121.0, 86.0), (4, -179.99, 0.05), (5, None, 23.0), (6, 10.0, -40.0), (7, 120.05, 23.1001), (8, 123.0, 23.0), (9, 179.95, 0.05), (10, 0.0, 90.0), (11, float("nan"), 1.0), (12, -55.0, -5.0), (13, 500.0, 1.0), (14, -179.9, -89.95)]
    odd = [("z", None, 23.0, None, 23.1), ("y", 11.0, -40.0, 10.0, -39.0)]
    tf = spark.createDataFrame(t + odd, "region string, west double, south double, east double, north double")
    pf = spark.createDataFrame(p, "point_id int, lon double, lat double")
    want = {}
    for i, lon, lat in p:
        want[i] = None
        if lon is not None and abs(lon) <= 180:
            want[i] = min((_metres(lon, lat, min(max(lon, w), e), min(max(lat, s), n)), _metres(lon, lat, (w + e) / 2, (s + n) / 2), r) for r, w, s, e, n in t)[2]
    got = {r.point_id: r.region for r in tiles.nearest_submap(pf, tf).collect()}
    assert got == want
    assert {r.region for r in tiles.nearest_submap(pf, tf.limit(0)).collect()} == {None}
    plan = tiles.tiles_near(pf, tf.withColumns({"tile_id": F.lit(1), "path": F.col("region")}), 5000, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_tiles_just_inside_the_radius(spark):
    """In all four directions, at several latitudes; what lies just outside is left."""
    rows, points = [], []
    for k, lat in enumerate((0.0, 23.5, -60.0, 80.0)):
        points.append((k, 100.0, lat))
        for d, (de, dn) in enumerate(((1, 0), (-1, 0), (0, 1), (0, -1))):
            for inside, metres in ((1, 4993.0), (0, 5007.0)):
                up = metres / 111132.954
                across = metres / (111412.84 * math.cos(math.radians(lat)))
                x, y = 100.0 + de * across, lat + dn * up
                w, e = (x, x + 0.01) if de > 0 else (x - 0.01, x) if de < 0 else (x - 0.001, x + 0.001)
                s, n = (y, y + 0.01) if dn > 0 else (y - 0.01, y) if dn < 0 else (lat - 1e-9, lat + 1e-9)
                rows.append((100 * k + 10 * d + inside, "r", f"t{k}{d}{inside}", w, s, e, n))
    t = spark.createDataFrame(rows, "tile_id int, region string, path string, west double, south double, east double, north double")
    p = spark.createDataFrame(points, "point_id int, lon double, lat double")
    got = {(r.point_id, r.tile_id) for r in tiles.tiles_near(p, t, 5000, 99).collect()}
    assert got == {(i // 100, i) for i, *_ in rows if i % 10}


def _detections():
    rows = []
    for video in (0, 1):
        for frame in range(0, 200):
            if frame % 7 < 3 or frame in (50, 51):
                rows.append((video, frame, 0, "smoke", 0.6 + (frame % 3) / 10, 100 + frame // 10, 100, 30 + frame % 5, 30))
            if 80 < frame < 90:
                rows.append((video, frame, 1, "boom", 0.9, 900, 500, 40, 40))
            if not (frame % 7 < 3) and not 80 < frame < 90:
                rows.append((video, frame, None, None, None, None, None, None, None))
    return rows


SCHEMA = "video_id int, frame_idx int, det_idx int, cls_name string, conf double, x int, y int, w int, h int"


def _stream(spark, path, df, cuts):
    """A file source with one file for each range of frames."""
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        df.filter((F.col("frame_idx") >= lo) & (F.col("frame_idx") < hi)).coalesce(1).write.parquet(f"{path}/src/part={k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/src/*")


def _drain(df, path, name):
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return df.sparkSession.read.parquet(f"{path}/out")


def test_tracker_batch_equals_stream(spark, tmp_path):
    df = spark.createDataFrame(_detections(), SCHEMA)
    batch = sorted(map(tuple, tracking.track_detections(df).collect()))
    assert batch and {b[0] for b in batch} == {0, 1}
    assert [b[1] for b in batch if b[0] == 0] == list(range(1, 1 + sum(b[0] == 0 for b in batch)))  # dense ids
    stream = _stream(spark, str(tmp_path), df, [0, 60, 85, 200])
    assert sorted(map(tuple, _drain(P.track_detections(stream), str(tmp_path), "t").collect())) == batch


def test_frames_split_over_batches(spark, tmp_path):
    """With hold_last, a frame whose detections come in two micro-batches is taken whole, once a later one is there."""
    df = spark.createDataFrame(_detections(), SCHEMA)
    batch = sorted(map(tuple, tracking.track_detections(df.filter("frame_idx < 199")).collect()))
    parts = df.withColumn("part", F.when(F.col("frame_idx") < 84, 0).when((F.col("frame_idx") == 84) & (F.col("det_idx") == 0), 0).when(F.col("frame_idx") < 120, 1).otherwise(2))
    for k in range(3):
        parts.filter(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{tmp_path}/src/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src/*")
    got = _drain(P.track_detections(stream, hold_last=True), str(tmp_path), "h").collect()
    assert sorted(map(tuple, got)) == batch
    assert df.filter("frame_idx = 84").count() > parts.filter("frame_idx = 84 AND part = 0").count() > 0


def test_throttle_batch_equals_stream(spark, tmp_path):
    df = spark.createDataFrame([(v, f) for v in (0, 1) for f in range(0, 120, 7)], "video_id int, frame_idx int")
    batch = sorted(map(tuple, tracking.throttle(df, "video_id", "frame_idx", 30).collect()))
    stream = _stream(spark, str(tmp_path), df, [0, 40, 120])
    assert sorted(map(tuple, _drain(P.throttle(stream, "video_id", "frame_idx", 30), str(tmp_path), "x").collect())) == batch
    assert [f for v, f in batch if v == 0] == [0, 35, 70, 105]


def test_pose_status_batch_equals_stream(spark, tmp_path):
    df = spark.createDataFrame([(0, f, f > 40, f % 50 != 0, f % 160 == 0) for f in range(0, 600)], "video_id int, frame_idx int, link_ok boolean, klt_ok boolean, correction_ok boolean")
    batch = sorted(map(tuple, tracking.pose_status(df, 10.0).collect()))
    assert batch[0][2] == "LOST" and {b[2] for b in batch} == {"VO_TRACKING", "LOST"}
    stream = _stream(spark, str(tmp_path), df, [0, 100, 333, 600])
    assert sorted(map(tuple, _drain(P.pose_status(stream, 10.0), str(tmp_path), "p").collect())) == batch


def test_pose_steps():
    """At 10 frames a second: links once a second, a map check behind a link, fixes that grow old, and what a reference changes."""
    state: dict = {}
    step = lambda f, link=True, klt=True, fix=False, **how: tracking.pose_step(state, f, link, klt, fix, 10.0, **how)
    assert step(0, reference_valid=False) == "INITIALIZING" and "link" not in state
    assert step(1, link=False) == "LOST" and step(5) == "LOST" and state["link"] == 1  # too soon
    assert step(11) == "VO_TRACKING" and state["check"] == state["fix"] == 11
    assert step(60, fix=True) == "VO_TRACKING" and state["fix"] == 11  # no check before 5 s
    assert step(61, fix=True) == "VO_TRACKING" and state["fix"] == 61
    assert step(211) == "VO_TRACKING" and step(212) == "LOST"  # 15 s behind the fix, and more
    assert step(220) == "VO_TRACKING" and step(221, klt=False) == "LOST"
    state = {}
    assert [tracking.pose_step(state, f, True, True, False, 10.0, False, True) for f in (0, 1, 400)] == ["VO_GPS_ESTIMATE"] * 3


def test_event_time_streams(spark, tmp_path):
    rows = [(0, i, (pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=s)).to_pydatetime(), 5.0) for i, s in enumerate([0, 1, 2, 10, 11, 40, 41, 90])]
    df = spark.createDataFrame(rows + rows[:2], "camera_id int, camera_frame_id long, ts timestamp, detector_ms double").withColumn("frame_idx", F.col("camera_frame_id"))
    stream = _stream(spark, str(tmp_path), df, [0, 4, 8]).drop("frame_idx")
    once = _drain(P.dedupe_frames(stream), str(tmp_path), "d")
    assert sorted(r.camera_frame_id for r in once.collect()) == list(range(8))
    sessions = _drain(P.camera_timeout(stream, 5), str(tmp_path / "s"), "s").collect()
    assert sorted(r.frames for r in sessions if r.started.second in (10,)) == [2]


def test_evidence_sink_repeats_safely(spark, tmp_path):
    kinds = {"event_id": "int", "logged_at_utc": "string", "processed_frame_idx": "int", "camera_frame_id": "long", "camera_timestamp_ns": "long", "full_frame_path": "string", "crop_path": "string"}
    schema = ", ".join(f"{c} {kinds.get(c, 'int' if c.startswith('bbox') else 'double')}" for c in (*events.CSV_COLUMNS, "timestamp_sec"))
    head = ("2024-01-01T00:00:00", 7, 70, 700, 12.5, 10, 20, 30, 40, 1200.0, 1.5)
    rows = [(1, *head, None, None, None, float("nan"), None, "a_full.jpg", None, 2.5), (2, *head, 0.75, 250000.0, 2655000.0, 121.0, 24.0, "b_full.jpg", "b_crop.jpg", 3.0)]
    df = spark.createDataFrame(rows, schema)
    sink = L.EvidenceSink(str(tmp_path))
    sink(df, 0)
    sink(df, 0)
    lines = [r.value for r in spark.read.text(str(tmp_path / "events_jsonl")).collect()]
    assert len(lines) == 2 and any('"position":null' in x for x in lines)
    table = {r.event_id: r for r in spark.read.option("header", True).csv(str(tmp_path / "detections_csv")).collect()}
    assert len(table) == 2 and table["2"].wgs84_lon == "121.0000000" and table["2"].twd97_easting == "250000.000" and table["1"].wgs84_lon is None and table["1"].processing_latency_ms == "12.500"
    assert tuple(table["1"].asDict())[:19] == events.CSV_COLUMNS
    text = sorted(r.value for r in spark.read.text(str(tmp_path / "coordinates")).collect())
    assert text == ["ID 1: t=2.50s, coordinate=unavailable", "ID 2: t=3.00s, TWD97(E=250000.00, N=2655000.00), WGS84(lat=24.000000, lon=121.000000)"]


def test_functions_in_sql_equal_their_column_forms(spark):
    """Every registered function against its column form, over rows with signs, nulls and far values."""
    from smokelake.operators import plugins

    plugins.register_functions(spark)
    numbers = [0.5, 1.0, -1.0, 121.03, 24.7, -33.5, 300.0, 0.004, 250123.4, 2655000.0, 59.99, 1280.0]
    nine = [[1.0, 0.0, 5.0, 0.1, 1.0, -3.0, 1e-3, 0.0, 1.0], [float(k * k % 7) for k in range(9)]]
    for name, (arguments, form) in plugins.SQL_FUNCTIONS.items():
        rows = []
        for k in range(24):
            row = []
            for j, kind in enumerate(arguments.values()):
                value = {"DOUBLE": numbers[(k * 5 + j * 3) % 12], "ARRAY<DOUBLE>": nine[(k + j) % 2], "STRING": ["S", "w", "E", " Smoke ", "fire", ""][k % 6], "INT": k % 4, "BIGINT": k * 37}[kind]
                row.append(None if (k, j) in ((7, 0), (9, len(arguments) - 1)) else value)
            rows.append(tuple(row))
        if name == "match_pixel_to_geo":
            rows.append((nine[0], 10.0, 10.0, 640.0, 480.0, 256.0, 256.0, 120.0, 25.0, 0.001, 0.001))
        df = spark.createDataFrame(rows, ", ".join(f"{c} {kind}" for c, kind in arguments.items()))
        got = df.select(F.expr(f"{name}({', '.join(arguments)})").alias("sql"), form(*arguments).alias("col")).collect()
        assert [str(r.sql) for r in got] == [str(r.col) for r in got], name
        assert any(r.sql is not None for r in got), name


def test_state_is_carried_over_batches(spark):
    """However small the Arrow batches, keys and frames split over them give the same rows."""
    df = spark.createDataFrame(_detections(), SCHEMA)
    whole = sorted(map(tuple, tracking.track_detections(df).collect()))
    gaps = sorted(map(tuple, tracking.throttle(df.select("video_id", "frame_idx").distinct(), "video_id", "frame_idx", 30).collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert sorted(map(tuple, tracking.track_detections(df).collect())) == whole
            assert sorted(map(tuple, tracking.throttle(df.select("video_id", "frame_idx").distinct(), "video_id", "frame_idx", 30).collect())) == gaps
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert tracking.track_detections(df.limit(0)).count() == 0
