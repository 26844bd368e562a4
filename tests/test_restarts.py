"""Set pieces, cards, fouls, the ball for touches and automatic calibration, against loops and known scenes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.functions import exprs
from pitchlake.operators import broadcast, geometry, match, restarts


def path(spark, rows):
    return spark.createDataFrame([(1, float(t), float(x), float(y)) for t, x, y in rows], "match_id long, t double, x double, y double")


def rested_then_kicked(x, y, hold=2.0, to=None):
    """The ball drifts in, lies at a place and is kicked across the pitch."""
    to = to or (x - 38.0 if x > 0 else x + 38.0, 0.0)
    rows = [(i / 10, x - 11 * (1 - i / 20), y + 5 * (1 - i / 20)) for i in range(20)]
    rows += [(2 + i / 10, x + (i % 3) * 0.1, y + (i % 2) * 0.1) for i in range(int(hold * 10))]
    return rows + [(2 + hold + i / 10, x + (to[0] - x) * i / 12, y + (to[1] - y) * i / 12) for i in range(12)]


@pytest.mark.parametrize("x, y, kind, side", [
    (51.7, 33.3, "corner_kick", "right"), (-51.0, -30.0, "corner_kick", "left"), (0.0, 0.0, "kickoff", None), (-41.0, 1.0, "penalty_kick", "left"),
    (48.0, -12.0, "goal_kick", "right"), (-26.0, 10.0, "free_kick", "left"), (5.0, 25.0, "free_kick", None),
])
def test_the_place_names_the_set_piece(spark, x, y, kind, side):
    (found,) = restarts.set_pieces(path(spark, rested_then_kicked(x, y))).collect()
    assert (found["kind"], found["side"]) == (kind, side)
    assert 1.5 < found["t_start"] < 2.3 and abs(found["t"] - 4.0) < 0.3 and found["speed"] > 15.75


def test_what_is_no_set_piece(spark):
    assert restarts.set_pieces(path(spark, [(i / 10, -40 + 0.6 * i, 0.0) for i in range(100)])).count() == 0  # it never rests
    slow = rested_then_kicked(10.0, 10.0, to=(13.0, 10.0))
    assert restarts.set_pieces(path(spark, slow)).count() == 0  # it isn't kicked
    assert restarts.set_pieces(path(spark, rested_then_kicked(10.0, 10.0, hold=0.8))).count() == 0  # not long enough
    drift = [(i / 10, 0.2 * i, 0.0) for i in range(30)] + [(3 + i / 10, 6.0, 0.0) for i in range(20)] + [(5 + i / 10, 6 + 3.0 * i, 0.0) for i in range(12)]
    (found,) = restarts.set_pieces(path(spark, drift)).collect()
    assert found["x"] == pytest.approx(5.6, abs=0.9) and found["t"] == pytest.approx(5.0, abs=0.3)  # anchored where it lies


def test_growing_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.choice([0.1, 0.1, 0.1, 1.5], 3000))
    x, y = (np.repeat(rng.normal(0, 5, 300), 10) + rng.normal(0, 0.3, 3000) for _ in range(2))
    taken = lambda i, j: (i + j) % 3 != 0
    want, i = [], 0
    while i < len(t) - 1:
        j = i + 1
        while j < len(t) and t[j] - t[j - 1] <= 1.25 and np.hypot(x[j] - x[i], y[j] - y[i]) <= 1.2:
            j += 1
        if t[j - 1] - t[i] >= 0.5 and taken(i, j):
            want.append((i, j))
            i = j
        else:
            i += 1
    assert list(restarts.anchored(t, x, y, 1.2, 0.5, 1.25, taken)) == want and len(want) > 50


def test_cards_merge_with_the_card_kept(spark):
    rng = np.random.default_rng(8)
    rows = [(m, round(float(t), 2), str(rng.choice(["yellow", "yellow", "red"])), round(float(rng.uniform(0.3, 1)), 3), k) for m in range(4) for k, t in enumerate(np.cumsum(rng.uniform(1, 25, 60)))]
    got = broadcast.merge_cards(spark.createDataFrame(rows, "match_id long, t double, kind string, confidence double, n int"), 20.0, 0.5).collect()
    want, lagged = [], 0
    for m in range(4):
        kept, last = [], None
        for r in sorted(r for r in rows if r[0] == m):
            lagged += last is None or last[2] != r[2] or r[1] - last[1] > 20
            last = r
            if kept and kept[-1][2] == r[2] and r[1] - kept[-1][1] <= 20:
                if r[3] > kept[-1][3]:
                    kept[-1] = r
            else:
                kept.append(r)
        want += [r for r in kept if r[3] >= 0.5]
        lagged -= len(kept)
    assert sorted(map(tuple, got)) == sorted(want)
    assert lagged != 0  # comparing with the row before would give another number of cards


def test_a_foul_needs_noise_a_stop_and_a_crowd(spark):
    peaks = spark.createDataFrame([(1, 10.0, 0.8), (1, 40.0, 0.8), (1, 70.0, 0.5), (1, 90.0, 1.0)], "match_id long, peak_t double, strength double")
    events = spark.createDataFrame([(1, "shot", 41.0), (1, "free_kick", 25.0)], "match_id long, type string, t double")
    ball = spark.createDataFrame([(1, g, 0.0, 0.0, 0.2 if 100 <= g <= 150 or g > 650 else 6.0) for g in range(1000)], "match_id long, g long, x double, y double, speed double")
    segments = spark.createDataFrame([(1, 0.0, "in_play")], "match_id long, start_s double, state string")
    rows = [(1, g, k, 3.0 if (k < 4 and 105 <= g <= 130) or k < 1 or (k < 3 and g > 905) else 30.0, 0.0) for g in range(1000) for k in range(6)]
    kin = spark.createDataFrame(rows, "match_id long, g long, track_id int, x double, y double")
    got = broadcast.foul_candidates(peaks, events, ball, segments, kin).orderBy("t").collect()
    assert [(r["t"], r["before"], r["after"]) for r in got] == [(10.0, 1, 4), (90.0, 1, 3)]  # at 70 s nobody comes
    assert [r["confidence"] for r in got] == pytest.approx([0.48, 0.4])


def test_touches_take_the_raw_ball_where_most_of_it_agrees(spark):
    rng = np.random.default_rng(2)
    filtered = [(m, i / 10, 0.5 * i, 0.0) for m in (1, 2, 3) for i in range(100)]
    raw = [(1, i / 10 + 0.03, 0.5 * i + rng.normal(0, 0.3), 0.1) for i in range(100)] + [(1, 5.03, 90.0, 0.0), (1, 5.03, 25.0, 0.0)]
    raw += [(2, i / 10, 0.5 * i + (0 if i < 40 else 9), 0.1) for i in range(100)] + [(3, 0.1, 0.5, 0.0)]
    frame = lambda rows: spark.createDataFrame([(m, float(t), float(x), float(y)) for m, t, x, y in rows], "match_id long, t double, x double, y double")
    got = match.touch_ball(frame(filtered), frame(raw)).collect()
    of = {m: sorted((r["t"], r["x"], r["y"]) for r in got if r["match_id"] == m) for m in (1, 2, 3)}
    assert of[2] == sorted(r[1:] for r in filtered if r[0] == 2) and of[3] == sorted(r[1:] for r in filtered if r[0] == 3)
    t, x = np.arange(100) / 10, 0.5 * np.arange(100)
    want = {}
    for _, rt, rx, ry in raw[:102]:
        if np.abs(t - rt).min() <= 0.1 + 1e-9 and np.hypot(rx - np.interp(rt, t, x), ry) <= 2.5:
            want.setdefault(round(rt, 6), []).append((rx, ry))
    assert len(of[1]) == len(want) and all((x, y) == pytest.approx(min(want[round(t, 6)])) for t, x, y in of[1])


def test_matches_calibrate_themselves(spark):
    rng = np.random.default_rng(6)
    feet, ball = [], []
    for m, (x0, x1, y0, y1) in ((1, (200, 1700, 250, 950)), (2, (100, 1800, 300, 900))):
        feet += [(m, float(x), float(y)) for x, y in rng.uniform([x0 + 100, y0], [x1 - 100, y1], (4000, 2))]
        moving = [(m, i / 5, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([x0, y0 + 20], [x1, y1 - 20], (2000, 2)))]
        ball += moving + [(m, 500 + i / 10, float(x1 + 60), 600.0) for i in range(40)]  # in the net
        ball += [(m, 600 + i / 10, (x0 + x1) / 2, 560.0) for i in range(20 if m == 1 else 0)]  # on the centre spot
    feet.append((3, 5.0, 5.0))
    found = geometry.calibrate_auto(spark.createDataFrame(feet, "match_id long, x double, y double"), spark.createDataFrame(ball, "match_id long, t double, x double, y double"), 1920.0, 1080.0).cache()
    assert {r["match_id"]: r["source"] for r in found.collect()} == {1: "bounds+centre_spot", 2: "bounds", 3: "frame_default"}
    points = spark.createDataFrame([(1, 950.0, 560.0), (1, 200.0, 560.0), (1, 1700.0, 560.0), (2, 100.0, 900.0), (2, 1800.0, 900.0), (2, 950.0, 300.0)], "match_id long, x double, y double")
    px, py = exprs.project(F.col("homography"), F.col("x"), F.col("y"))
    got = [(round(r["px"], 1), round(r["py"], 1)) for r in points.join(found, "match_id").withColumns({"px": px, "py": py}).orderBy("match_id", "y", "x").collect()]
    at = np.array(got)
    assert np.allclose(at[:3], [(-52.5, 0), (0, 0), (52.5, 0)], atol=1.5) and np.allclose(at[3:], [(0, -34), (-52.5, 34), (52.5, 34)], atol=1.5)
    one = spark.createDataFrame([(9, 100.0, 1700.0, 200.0, 900.0, None)], "match_id long, x_min double, x_max double, y_min double, y_max double, centre_y double")
    h = np.array(geometry.trapezoid_homography(one).first()["homography"])
    plain = np.array(geometry.calibrate_from_corners(geometry.trapezoid(100, 200, 1700, 900)))
    assert np.allclose(h / h[2, 2], plain)
