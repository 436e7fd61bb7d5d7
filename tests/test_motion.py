"""The motion tracker on traces made by hand; batch, stream and plain loop against each other."""

import pandas as pd
import pytest

from smokelake.operators import motion as M
from smokelake.streaming import pipelines as P

from .test_operators import _drain, _stream

S = M.MotionSettings()
NAMES = [c.split()[0] for c in M.CANDIDATE.split(", ")]


def _candidate(x, y, side, **more):
    c = {"box": [x, y, side, side], "at": [x + side / 2, y + side / 2], "area": float(side * side), "polarity": 0.9, "coherence": 0.9, "fill": 0.7, "snr": 5.0, "mean_abs_delta": 30.0, "noise": 5.0, "prior_overlap": 0.0, "small": False, "edge": False, "outward": None, "vectors": 0}
    return c | more


def _run(frames, settings=S):
    state, born, ended = M.MotionState(), [], []
    for frame, candidates in frames:
        a, b = state.step(frame, candidates is not None, candidates or [], settings)
        born += [(e["event_id"], e["frame_idx"]) for e in a]
        ended += [(e["event_id"], e["frame_idx"], e["reason"]) for e in b]
    return state, born, ended


def _plume(at, start, n, side=20, grow=5, **more):
    return {start + k: [_candidate(at - grow * k // 2, at - grow * k // 2, side + grow * k, **more)] for k in range(n)}


def test_growth_confirms_after_two_hits():
    state, born, _ = _run(sorted(_plume(300, 1, 4).items()))
    assert born == [(1, 3)]  # frames 2 and 3 grow by 1.56 and 1.44
    assert [(m["event"], m["confirm"], m["update"], len(m["seen"])) for m in state.memories] == [(1, 3, 4, 2)]


@pytest.mark.parametrize("more", [{"polarity": 0.5}, {"coherence": 0.1}, {"fill": 0.1}, {"prior_overlap": 0.6}])
def test_evidence_below_a_limit_confirms_nothing(more):
    assert _run(sorted(_plume(300, 1, 6, **more).items()))[1] == []


def test_still_boxes_are_dropped_as_tentative():
    state, born, ended = _run([(f, [_candidate(100, 100, 30)]) for f in range(1, 10)])
    assert born == [] and ended == [] and len(state.tracks) == 0  # eight frames old at frame 9


def test_ends_by_missing_standing_still_and_age():
    grown = _plume(300, 1, 4)
    gone = {f: [] for f in range(5, 14)}
    assert _run(sorted((grown | gone).items()))[2] == [(1, 11, "missed")]
    still = {f: [grown[4][0]] for f in range(5, 14)}
    # growth is the larger of the last step and three observations: it stands still from frame 7 on
    assert _run(sorted((grown | still).items()))[2] == [(1, 10, "growth_stalled")]
    slow = {f: [_candidate(290, 290, round(35 * 1.03 ** (f - 4)))] for f in range(5, 100)}
    assert _run(sorted((grown | slow).items()))[2][0] == (1, 93, "timeout")


def test_unmeasured_frames_do_not_count_as_missed():
    frames = _plume(300, 1, 4) | {f: None for f in range(5, 30)} | {30: []}
    state, _, ended = _run(sorted(frames.items()))
    assert ended == [] and state.tracks[0]["missed"] == 1


def test_a_repeat_is_kept_away_and_a_far_plume_is_not():
    frames = _plume(300, 1, 4) | {f: [] for f in range(5, 40)} | _plume(330, 40, 6)
    state, born, _ = _run(sorted(frames.items()))
    assert born == [(1, 3)] and state.tracks[-1]["repeats"] == 1 and state.memories[0]["update"] == 45
    far = _plume(300, 1, 4) | {f: [] for f in range(5, 400)} | _plume(2000, 400, 4)
    assert _run(sorted(far.items()))[1] == [(1, 3), (2, 402)]


def test_memories_are_bounded_and_forget():
    frames = {}
    for k in range(15):
        frames |= _plume(1000 * k + 300, 20 * k + 1, 4) | {f: [] for f in range(20 * k + 5, 20 * k + 21)}
    state, born, _ = _run(sorted(frames.items()))
    assert len(born) == 15 and [m["event"] for m in state.memories] == list(range(4, 16))
    state.step(20 * 15 + 30 * 601, True, [], S)
    assert state.memories == []


def test_small_plumes_need_three_hits_and_a_signal():
    small = {f: [_candidate(200, 200, side, small=True)] for f, side in enumerate((3, 4, 5, 5, 5), 1)}
    assert _run(sorted(small.items()))[1] == [(1, 4)]
    faint = {f: [c[0] | {"mean_abs_delta": 6.0}] for f, c in small.items()}
    assert _run(sorted(faint.items()))[1] == []


def test_path_distance():
    assert M.path_distance([[0, 0]], [3, 4]) == 5
    assert M.path_distance([[0, 0], [10, 0]], [30, 2]) == 2 and M.path_distance([[0, 0], [10, 0]], [33, 4]) == 5


def test_batch_equals_stream_and_loop(spark, tmp_path):
    rows = []
    for video in (0, 1):
        frames = {f: [] for f in range(0, 120)} | _plume(300 + 50 * video, 5, 6) | _plume(1500, 40, 5) | _plume(310, 60, 6)
        for f, found in sorted(frames.items()):
            measured = f % 11 != 10
            for k, c in enumerate(found or [None]):
                values = [None] * 19 if c is None else [k, *c["box"], *c["at"], c["area"], c["polarity"], c["coherence"], c["fill"], c["snr"], c["mean_abs_delta"], c["noise"], c["prior_overlap"], c["small"], c["edge"], c["outward"], c["vectors"]]
                rows.append((video, f, measured, *values))
    df = spark.createDataFrame(rows, M.CANDIDATE)
    want = []
    for video in (0, 1):
        state = M.MotionState()
        part = pd.DataFrame([r for r in rows if r[0] == video], columns=NAMES)
        want += [(video, e["event_id"], e["frame_idx"]) for frame in M.candidates_by_frame(part) for e in state.step(*frame, S)[0]]
    key = lambda rows: sorted((r.video_id, r.event_id, r.frame_idx) for r in rows)
    assert len(want) == 4
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # state goes on from batch to batch
    try:
        assert key(M.track_candidates(df).collect()) == sorted(want)
        assert M.ended_events(df).count() == 4 and M.event_memories(df).count() > 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    stream = _stream(spark, str(tmp_path), df, [0, 42, 62, 120])
    assert key(_drain(P.track_candidates(stream), str(tmp_path), "m").collect()) == sorted(want)
