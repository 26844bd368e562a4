"""The camera planner: its acceptance figures on synthetic matches, and each phase by itself."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import camera_plan, match
from pitchlake.operators.camera_plan import Style
from tests.synthetic import BALL, synthetic_matches

S = Style()


def test_acceptance_figures(spark):
    """Pan p95 below 0.9 crop widths a second, zoom p95 below 0.15, no snap, the ball in the frame in 97 % of play."""
    rows = synthetic_matches(spark, 3, 30.0).cache()
    found = match.analyse(rows.where(F.col("track_id") != BALL), rows.where(F.col("track_id") == BALL), only=["segments"])
    px = lambda df: df.withColumns({"x": (F.col("x") + 60) * 16.0, "y": (F.col("y") + 40) * 13.5})
    field = rows.select("match_id").distinct().withColumns({"x_min": F.lit(120.0), "x_max": F.lit(1800.0), "y_min": F.lit(81.0), "y_max": F.lit(999.0)})
    spans = rows.select("match_id").distinct().withColumns({"start_s": F.lit(0.0), "end_s": F.lit(30.0)})
    plan = camera_plan.plan_camera(spans, px(rows.where(F.col("track_id") == BALL)), found["segments"], px(rows.where(F.col("track_id") != BALL)), field).cache()
    assert plan.count() == 3 * 750
    for q in camera_plan.plan_quality(plan).collect():
        assert q["pan_p95"] < 0.9 and q["zoom_rate_p95"] < 0.15 and q["snaps"] == 0 and q["ball_in_frame"] > 0.97, q
        assert 1.0 <= q["zoom_min"] < q["zoom_max"] <= S.most_zoom
    inside = (F.col("cx") - 960 / F.col("zoom") >= -1e-6) & (F.col("cx") + 960 / F.col("zoom") <= 1920 + 1e-6) & (F.col("cy") - 540 / F.col("zoom") >= -1e-6) & (F.col("cy") + 540 / F.col("zoom") <= 1080 + 1e-6)
    assert plan.where(~inside).count() == 0
    assert {"ball", "hold"} < {r["focus"] for r in plan.select("focus").distinct().collect()}


def test_moves_are_eased_and_cuts_are_made_when_the_ball_was_lost():
    aim = np.array([100 + 100j] * 50 + [1500 + 600j] * 50)
    mode = np.array(["a"] * 50 + ["b"] * 50)
    out, cut = camera_plan.eased(aim, mode, np.zeros(100), S)
    assert not cut.any() and out[49] == aim[49] and out[69] == aim[69] and 0 < abs(out[50] - aim[49]) < 20
    assert np.all(np.diff(out.real) >= 0)
    out, cut = camera_plan.eased(aim, mode, np.full(100, 9.0), S)
    assert np.flatnonzero(cut).tolist() == [50] and (out == aim).all()


def test_a_lower_envelope_is_smooth_and_below():
    rng = np.random.default_rng(0)
    values = np.where(rng.random(600) < 0.02, 1.0, 2.0)
    curve = camera_plan.below(values, 0.005, 15)
    assert (curve <= values + 1e-9).all() and np.abs(np.diff(curve)).max() <= 0.005 + 1e-9
    assert camera_plan.below(values, 0.005, 0).max() <= 2 and (camera_plan.below(values, 0.005, 0) >= curve - 1e-9).all()


def fold(**columns):
    n = len(columns["aim_x"])
    base = {"aim_y": 540.0, "focus": "ball", "lost_s": 0.0, "confidence": 0.9, "want": 1.6, "ball_x": np.nan, "ball_y": np.nan, "also_x": np.nan, "also_y": np.nan}
    return camera_plan.folded(pd.DataFrame({k: np.broadcast_to(v, n) for k, v in (base | columns).items()}), S)


def test_the_zoom_gives_way_until_all_is_seen():
    goal = fold(aim_x=np.full(200, 900.0), ball_x=np.full(200, 400.0), ball_y=np.full(200, 540.0), also_x=np.full(200, 1700.0), also_y=np.full(200, 540.0), focus="ball_and_goal")
    late = goal.iloc[30:170]
    half = 960 / late["zoom"]
    assert (late["cx"] - half <= 400).all() and (late["cx"] + half >= 1700).all()
    assert fold(aim_x=np.full(200, 900.0))["zoom"].iloc[100] == pytest.approx(1.6)


def test_a_path_stays_within_its_limits():
    aim = np.where(np.arange(400) < 200, 700.0, 1250.0) + np.random.default_rng(1).normal(0, 30, 400)
    found = fold(aim_x=aim)
    crop = 1920 / found["zoom"].max()
    assert np.abs(np.diff(found["cx"])).max() * 25 <= S.pan_speed * crop + 1e-6
    assert np.abs(np.diff(found["cx"], 2)).max() * 625 <= S.pan_acceleration * crop * 1.05
    assert abs(found["cx"].iloc[-60] - 1250) < 25


def test_restarts_look_at_the_goal_and_set_pieces_at_both(spark):
    ball = spark.createDataFrame([(1, i / 10, 250.0, 450.0) for i in range(20)], "match_id long, t double, x double, y double")
    segments = spark.createDataFrame([(1, 0.0, "in_play", None), (1, 4.0, "restart_left", "left"), (1, 6.0, "corner_kick_setup", None), (1, 8.0, "ball_lost", None)], "match_id long, start_s double, state string, side string")
    players = spark.createDataFrame([(1, k, i / 2, 1200.0 + 10 * k, 500.0) for k in range(4) for i in range(24)], "match_id long, track_id int, t double, x double, y double")
    field = spark.createDataFrame([(1, 100.0, 1800.0, 100.0, 1000.0)], "match_id long, x_min double, x_max double, y_min double, y_max double")
    spans = spark.createDataFrame([(1, 0.0, 12.0)], "match_id long, start_s double, end_s double")
    rows = {r["frame"]: r for r in camera_plan.setpoints(spans, ball, segments, players, field).collect()}
    assert rows[10]["focus"] == "ball_and_goal" and rows[10]["also_x"] == 100.0
    assert rows[70]["focus"] == "hold" and (rows[70]["aim_x"], rows[70]["want"]) == (250.0, pytest.approx(1.6))
    assert rows[90]["focus"] == "players" and rows[90]["aim_x"] == pytest.approx(1215.0)
    assert rows[120]["focus"] == "goal" and rows[120]["aim_x"] == pytest.approx(100 + 0.06 * 1700) and rows[120]["want"] == pytest.approx(1.4)
    assert rows[160]["focus"] == "set_piece" and rows[160]["aim_x"] == pytest.approx(0.45 * 250 + 0.55 * 100)
    assert rows[280]["focus"] == "players" and rows[280]["want"] == pytest.approx(1.28)
