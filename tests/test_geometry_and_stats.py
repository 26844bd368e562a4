import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.functions import exprs
from pitchlake.operators import geometry, stats


def test_homography_maps_the_corners_both_ways(spark):
    corners = [(100, 100), (900, 120), (1000, 600), (20, 580)]
    h = geometry.calibrate_from_corners(corners)
    for (x, y), want in zip(corners, [(-52.5, -34), (52.5, -34), (52.5, 34), (-52.5, 34)]):
        px, py = exprs.project(h, F.lit(float(x)), F.lit(float(y)))
        assert tuple(spark.range(1).select(px, py).first()) == pytest.approx(want, abs=1e-6)
    back = np.linalg.inv(np.array(h))
    p = back @ [0, 0, 1]
    assert 100 < p[0] / p[2] < 900
    with pytest.raises(ValueError):
        geometry.calibrate_from_corners([(0, 0), (1, 1), (1, 0), (0, 1)])
    assert geometry.is_convex(geometry.trapezoid(0, 0, 10, 5))


def test_bounds_ignore_outliers(spark):
    rng = np.random.default_rng(7)
    feet = spark.createDataFrame([(1, float(x), float(y)) for x, y in rng.uniform([100, 50], [900, 450], (2000, 2))], "match_id long, x double, y double")
    ball = spark.createDataFrame([(1, float(x), float(y)) for x, y in rng.uniform([80, 40], [920, 460], (1000, 2))] + [(1, 5000.0, 5000.0)], "match_id long, x double, y double")
    b = geometry.pitch_bounds(feet, ball).first()
    assert 75 < b["x_min"] < 106 and 894 < b["x_max"] < 925 and b["y_max"] < 470
    boxes = geometry.goal_boxes(feet, geometry.field_bounds(feet)).collect()
    assert {r["side"] for r in boxes} == {"left", "right"} and all(200 < (r["y1"] + r["y2"]) / 2 < 300 for r in boxes)


def test_waveform_and_runtime(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.1, -0.5, 0.2, 0.0])], "k string, i int, v double")
    assert [r["peak"] for r in stats.waveform_peaks(rows, ["k"], "i", "v", 2).orderBy("bin").collect()] == [1.0, 0.4]
    run = spark.range(1).select(stats.runtime_seconds(*[F.lit(float(v)) for v in (5400, 30, 450, 225, 350, 1)]).alias("r")).first()["r"]
    assert (run["proxy"], run["detect_track"], run["analysis"]) == pytest.approx((360, 963, 108))


def test_votes_and_cards(spark):
    samples = spark.createDataFrame([(1, 1, [0.0, 0.0]), (1, 1, [9.0, 9.0]), (1, 2, [50.0, 0.0])], "match_id long, track_id int, feature array<double>")
    centres = spark.createDataFrame([(1, [0.0, 0.0], [10.0, 10.0], 20.0)], "match_id long, c0 array<double>, c1 array<double>, limit double")
    assert {r["track_id"]: r["team"] for r in stats.nearest_centre(samples, centres, 2).collect()} == {1: 0, 2: 2}
    events = spark.createDataFrame([(1, 7, "goal", 20, "b"), (1, 7, "shot", 10, "a"), (1, 7, "goal", 30, "c")], "match_id long, player_id long, event_type string, ms long, event_id string")
    card = stats.player_cards(events, spark.createDataFrame([(1, 7), (1, 8)], "match_id long, player_id long")).orderBy("player_id").collect()
    assert card[0]["counts"] == {"goal": 2, "shot": 1} and [h["event_id"] for h in card[0]["highlights"]] == ["a", "b", "c"] and card[1]["counts"] is None


def test_auto_pick_equals_a_plain_loop(spark):
    import random

    from pitchlake.operators import control

    rnd = random.Random(3)
    rows = [(m, i, float(i), rnd.choice([None, rnd.random()]), float(rnd.randint(2, 30))) for m in range(6) for i in range(rnd.randint(1, 25))]
    got = control.auto_picked(spark.createDataFrame(rows, "match_id int, event_id int, t double, excitement double, length double"), 60.0).collect()
    for m in range(6):
        chosen, total = [], 0.0
        for _, i, t, e, length in sorted((r for r in rows if r[0] == m), key=lambda r: (-(r[3] or 0.0), r[2])):
            if total + length > 60 and chosen:
                continue
            chosen.append((t, i))
            total += length
            if total >= 57:
                break
        assert sorted((r["place"], r["event_id"]) for r in got if r["match_id"] == m) == [(n, i) for n, (_, i) in enumerate(sorted(chosen))]
