"""Streams of the live path against their batch answers: replays, disorder, a dead camera, late frames, and a sink that fails half-way."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from smokelake.operators import events
from smokelake.streaming import live as L
from smokelake.streaming import pipelines as P

START = pd.Timestamp("2026-01-01")


def _at(seconds):
    return (START + pd.Timedelta(seconds=seconds)).to_pydatetime()


class _Feed:
    """Batches of rows for a file stream, one micro-batch and one run each."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0
        self.session = L.stateful_session(spark, 2)

    def run(self, rows, make, sink=None, again=False):
        if not again:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/{self.n}")
            self.n += 1
        w = make(self.session.readStream.schema(self.schema).parquet(f"{self.folder}/in/*")).writeStream
        w = w.foreachBatch(sink) if sink else w.format("parquet").option("path", f"{self.folder}/out")
        q = w.option("checkpointLocation", f"{self.folder}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    def out(self, schema):
        return self.spark.read.schema(schema).parquet(f"{self.folder}/out").collect()


def test_newest_frame_rejects_what_came_before(spark, tmp_path):
    """Replayed and reordered frames are never handed on again; the counts go on over a restart."""
    feed = _Feed(spark, tmp_path, "camera_id int, camera_frame_id long, note string")
    for rows in ([(1, 5, "a"), (1, 3, "b"), (2, 1, "c")], [(1, 4, "late"), (1, 5, "again")], [(1, 9, "d"), (1, 7, "e"), (1, 2, "late"), (2, 1, "again"), (2, 2, "f")]):
        feed.run(rows, L.latest_frame)
    got = sorted(tuple(r) for r in feed.out("camera_id int, camera_frame_id long, note string, replaced long, overwritten long, stale long"))
    assert got == [(1, 5, "a", 1, 1, 0), (1, 9, "d", 1, 2, 3), (2, 1, "c", 0, 0, 0), (2, 2, "f", 0, 0, 1)]


def test_a_dead_camera_is_told_of_while_it_is_silent(spark, tmp_path):
    """Camera 1 stops, camera 2 goes on: the outage comes by timer, once, and before camera 1 is heard of again. A gap within one batch is found too."""
    schema = "camera_id int, last_frame_at timestamp, outage_at timestamp, silent boolean"
    feed = _Feed(spark, tmp_path, "camera_id int, ts timestamp")
    make = lambda s: L.camera_outages(s, 2.0, "1 second")
    feed.run([(1, _at(k)) for k in range(4)] + [(2, _at(k)) for k in range(4)] + [(3, None)], make)
    feed.run([(2, _at(4 + k)) for k in range(10)], make)
    told = lambda: sorted((r.camera_id, (r.last_frame_at - START.to_pydatetime()).seconds, (r.outage_at - START.to_pydatetime()).seconds, r.silent) for r in feed.out(schema))
    assert told() == [(1, 3, 5, True)]
    feed.run([(2, _at(14 + k)) for k in range(6)], make)
    assert told() == [(1, 3, 5, True)]  # told of once
    feed.run([(1, _at(20)), (1, _at(21)), (1, _at(30)), (2, _at(20)), (2, _at(21))], make)
    assert told() == [(1, 3, 5, True), (1, 21, 23, False), (2, 21, 23, True)]
    feed.run([(1, _at(60)), (2, _at(60))], make)
    feed.run([(1, _at(61)), (2, _at(61))], make)
    assert sorted({r[:3] for r in told()}) == [(1, 3, 5), (1, 21, 23), (1, 30, 32), (2, 21, 23)] and len(told()) == 4


@pytest.mark.parametrize("slide", [None, "5 seconds"])
def test_late_frames_are_counted(spark, tmp_path, slide):
    """Frames behind the watermark enter no window, tumbling or sliding, and are counted one by one."""
    feed = _Feed(spark, tmp_path, "camera_id int, camera_frame_id long, ts timestamp, detector_ms double")
    make = lambda s: P.heartbeat(s, "10 seconds", slide, "5 seconds", once=True)
    row = lambda i, s: (1, i, _at(s), 4.0)
    drops = []
    for rows in ([row(0, 1), row(1, 3), row(2, 31)], [row(3, 4), row(4, 5), row(5, 25.5), row(6, 26.5), row(6, 26.5)], [row(7, 100), row(2, 31)]):
        drops += [(n, late) for _, n, late in L.late_drops(feed.run(rows, make))]
    assert drops == [(3, 0), (5, 3), (2, 0)]  # the watermark stands at 26 s, so frames 3, 4 and 5 are late
    got = {(r.started - START.to_pydatetime()).total_seconds(): r.frames for r in feed.out("camera_id int, started timestamp, frames long, mean_ms double, skipped long")}
    assert got == ({0: 2, 20: 1, 30: 1} if slide is None else {-5: 2, 0: 2, 20: 1, 25: 2, 30: 1})


def test_poses_by_camera(spark, tmp_path):
    """A stream joined to a table: a full pose, one without a height, no pose, and the answer of the batch operator."""
    kinds = "video_id int, event_id long, frame_idx int, confirm_frame int, x int, y int, w int, h int"
    poses = spark.createDataFrame([(1, 121.05, 24.01, 120.0, 30.0, -60.0, 1.0), (2, 121.05, 24.01, None, 0.0, 0.0, 0.0)], "video_id int, lon double, lat double, alt double, yaw double, pitch double, roll double")
    poses.write.parquet(str(tmp_path / "poses"))
    feed = _Feed(spark, tmp_path, kinds)
    rows = [(v, v * 10, 5, 35, 600, 340, 80, 40) for v in (1, 2, 3)]
    names = ["video_id", "event_id", "lon", "lat", "easting", "northing", "coordinate_status", "confirmation_delay_sec", "problem"]
    where = lambda df, session: L.localize_by_camera(df, session.read.parquet(str(tmp_path / "poses")), 1280, 720, 30.0).select(*names)
    feed.run(rows[:2], lambda s: where(s, feed.session))
    feed.run(rows[2:], lambda s: where(s, feed.session))
    got = sorted(map(tuple, feed.out("video_id int, event_id long, lon double, lat double, easting double, northing double, coordinate_status string, confirmation_delay_sec double, problem string")))
    assert got == sorted(map(tuple, where(spark.createDataFrame(rows, kinds), spark).collect()))
    assert [(r[6], r[8], r[7]) for r in got] == [("static_pose_estimate", None, 1.0), ("unavailable", "partial_pose", 1.0), ("unavailable", None, 1.0)]
    one = spark.createDataFrame([rows[0]], kinds).join(poses, "video_id")
    want = events.static_position(one, F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.lit(1280), F.lit(720), "lon", "lat", "alt", "yaw", "pitch", "roll").first().position
    assert got[0][2:6] == (want.lon, want.lat, want.easting, want.northing)


EVENT = "event_id int, logged_at_utc string, processed_frame_idx int, camera_frame_id long, camera_timestamp_ns long, processing_latency_ms double, bbox_x int, bbox_y int, bbox_w int, bbox_h int, area double, growth_ratio double, radial_outward_ratio double, twd97_easting double, twd97_northing double, wgs84_lon double, wgs84_lat double, full_frame_path string, crop_path string, timestamp_sec double"


def _event(k):
    return (k, "2024-01-01T00:00:00", 7, 70, 700, 12.5, 10, 20, 30, 40, 1200.0, 1.5, None, None, None, None, None, f"{k}_full.jpg", None, 2.5)


def test_readers_see_whole_batches(spark, tmp_path):
    """A batch that fails behind its first files is not read; the restarted stream writes it anew, and no batch twice."""
    feed, sink = _Feed(spark, tmp_path, EVENT), L.EvidenceSink(str(tmp_path / "evidence"))
    ids = lambda: sorted(int(r.event_id) for r in sink.read(spark, "detections_csv").collect())
    assert ids() == [] and sink.read(spark, "coordinates").count() == 0
    feed.run([_event(1), _event(2)], lambda s: s, sink)
    assert ids() == [1, 2] and sink.committed_batches(spark) == [0]

    class Fails(L.EvidenceSink):
        def _commit(self, spark, batch_id):
            raise OSError("no space left")

    with pytest.raises(Exception, match="no space left"):
        feed.run([_event(3), _event(4)], lambda s: s, Fails(sink.folder))
    assert len(spark.read.text(f"{sink.folder}/events_jsonl").collect()) == 4  # all files of the batch lie there
    assert ids() == [1, 2]
    feed.run(None, lambda s: s, sink, again=True)
    assert ids() == [1, 2, 3, 4] and sink.committed_batches(spark) == [0, 1]
    assert [sink.read(spark, k).count() for k in sink.KINDS] == [4, 4, 4]
    before = sorted(p.name for p in (tmp_path / "evidence" / "events_jsonl" / "batch_id=1").glob("part-*"))
    sink(spark.createDataFrame([_event(3), _event(4)], EVENT), 1)  # a replay of a committed batch changes nothing
    assert sorted(p.name for p in (tmp_path / "evidence" / "events_jsonl" / "batch_id=1").glob("part-*")) == before and ids() == [1, 2, 3, 4]
