import pytest

from pitchlake.operators import broadcast


def test_audio_peaks_and_emotion(spark):
    rows = [(1, i * 0.1, 1.0 + 0.01 * (i % 3) + (5.0 if 50 <= i < 60 else 0.0) + (1.0 if i == 55 else 0.0)) for i in range(200)]
    envelope = spark.createDataFrame(rows, "match_id long, t double, rms double").cache()
    peaks = broadcast.audio_peaks(envelope).collect()
    assert len(peaks) == 1 and peaks[0]["peak_t"] == pytest.approx(5.5) and 0 < peaks[0]["strength"] <= 1
    events = spark.createDataFrame([(1, "a", 5.0), (1, "b", 19.0)], "match_id long, event_id string, t double")
    ends = {r["event_id"]: r["end_s"] for r in broadcast.emotion_end(events, envelope).collect()}
    assert ends["a"] == pytest.approx(7.0)


def test_story_starts_where_the_ball_turned(spark):
    ball = spark.createDataFrame([(1, i * 0.1, -2.0 if i < 80 else 3.0) for i in range(120)], "match_id long, grid_t double, vx double")
    segments = spark.createDataFrame([(1, 0.0, 12.0, "in_play")], "match_id long, start_s double, end_s double, state string")
    events = spark.createDataFrame([(1, "a", 11.0, 1)], "match_id long, event_id string, t double, sign int")
    assert broadcast.story_start(events, ball, segments).first()["start_s"] == pytest.approx(7.0)


def test_refined_intervals_and_stops(spark):
    spans = spark.createDataFrame([(1, 10.0, 20.0), (1, 23.0, 30.0)], "match_id long, start_s double, end_s double")
    events = spark.createDataFrame([(1, 15.0, 8.0, 22.5)], "match_id long, t double, t_start double, t_end double")
    assert [(r["start_s"], r["end_s"]) for r in broadcast.refined(spans, events).collect()] == [(8.0, 30.0)]
    segments = spark.createDataFrame([(1, 0.0, 5.0, "in_play"), (1, 5.0, 8.0, "restart_left"), (1, 8.0, 9.0, "in_play"), (1, 9.0, 12.0, "ball_lost")], "match_id long, start_s double, end_s double, state string")
    assert [(r["start_s"], r["end_s"]) for r in broadcast.stopped_windows(segments).collect()] == [(3.0, 14.0)]
