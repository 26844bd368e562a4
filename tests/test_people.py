"""Focus, camera paths, flights, kits and linked events against plain loops and known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import camera, control, focus, match, stats
from pitchlake.operators import timeseries as ts


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_gaussian_equals_a_loop_with_repeated_ends(spark):
    rng = random.Random(3)
    values = [(m, i, rng.uniform(-9, 9), rng.uniform(0.1, 1)) for m, n in ((1, 1), (2, 3), (3, 40)) for i in range(n)]
    rows = frame(spark, values, "match_id int, frame int, v double, w double")
    got = {(r.match_id, r.frame): (r.plain, r.sure) for r in camera.gaussian(camera.gaussian(rows, ["match_id"], "frame", "v", 2.0, "plain"), ["match_id"], "frame", "v", 2.0, "sure", "w").collect()}
    for m in (1, 2, 3):
        own = [(v, w) for k, _, v, w in values if k == m]
        for i in range(len(own)):
            kernel = [(math.exp(-0.5 * (k / 2) ** 2), own[min(max(i + k, 0), len(own) - 1)]) for k in range(-6, 7)]
            plain = sum(g * v for g, (v, _) in kernel) / sum(g for g, _ in kernel)
            sure = sum(g * v * w for g, (v, w) in kernel) / sum(g * w for g, (_, w) in kernel)
            assert got[m, i] == pytest.approx((plain, sure))
    assert camera.gaussian(rows, ["match_id"], "frame", "v", 0.0, "same").where("same <> v").count() == 0


def test_envelope_never_exceeds_its_bound(spark):
    rng = random.Random(5)
    rows = frame(spark, [(1, i, rng.uniform(0, 30)) for i in range(200)], "match_id int, frame int, v double")
    found = camera.lower_envelope(rows, ["match_id"], "frame", "v", 0.5, 6, "e").orderBy("frame").collect()
    assert all(r.e <= r.v + 1e-9 for r in found)
    assert max(abs(a.e - b.e) for a, b in zip(found, found[1:])) <= 0.5 + 1e-9


def test_limited_motion_keeps_its_limits_and_arrives(spark):
    path = [(7, i, 0.0 if i < 150 else 100.0, 0.0 if i < 150 else 60.0, 50.0, 80.0) for i in range(300)] + [(8, 0, 1.0, 2.0, 5.0, 5.0), (8, 1, 9.0, 9.0, 5.0, 5.0)]
    rows = frame(spark, path, "match_id int, frame int, x double, y double, fastest double, strongest double")
    found = camera.limited_motion(rows, 25.0).orderBy("match_id", "frame").collect()
    z = np.array([complex(r.cx, r.cy) for r in found if r.match_id == 7])
    v = np.diff(z) * 25
    assert abs(v).max() <= 50 + 1e-6 and abs(np.diff(v)).max() * 25 <= 80 + 1e-6
    assert abs(z[-1] - (100 + 60j)) < 0.5 and abs(z[0]) < 0.5
    assert [(r.cx, r.cy) for r in found if r.match_id == 8] == [(1.0, 2.0), (9.0, 9.0)]  # too short to limit


def test_flights_equal_a_loop(spark):
    rng = random.Random(11)
    rows, t = [], 0.0
    for _ in range(400):
        t += rng.choice([0.1, 0.1, 0.1, 0.5])
        rows.append((1, round(t, 3), rng.choice([3.0, 14.0, 16.0, 30.0]), rng.choice([0.0, 2.0, 12.0])))
    found = match.flights(frame(spark, rows, "match_id int, t double, vx double, vy double"), 12.0)
    speed, want, i = [math.hypot(a, b) for _, _, a, b in rows], [], 0
    while i < len(rows):
        if speed[i] < 12:
            i += 1
            continue
        j = i + 1
        while j < len(rows) and speed[j] >= 12 and rows[j][1] - rows[j - 1][1] <= 0.3:
            turn = math.degrees(abs(math.remainder(math.atan2(rows[j][3], rows[j][2]) - math.atan2(rows[i][3], rows[i][2]), 2 * math.pi)))
            if turn > 30 or j - i >= 2 and speed[j] > 1.35 * min(speed[max(i, j - 3):j]):
                break
            j += 1
        want.append((rows[i][1], rows[j - 1][1], j - i))
        i = j
    assert sorted((r.t_start, r.t_end, r.n) for r in found.collect()) == want


def test_kits_find_two_colours_and_a_referee(spark):
    rng = random.Random(2)
    rows = []
    for m in (1, 2):
        for k in range(22):
            base = (40.0, 10.0, -20.0) if k % 2 else (70.0, -30.0, 30.0)
            rows.append((m, k, [b + rng.gauss(0, 2) for b in base], rng.uniform(1, 5)))
        rows.append((m, 90, [0.0, 90.0, 90.0], 9.0))
    rows.append((3, 1, [1.0, 1.0, 1.0], 1.0))
    found = {(r.match_id, r.track_id): r.team for r in stats.kits(frame(spark, rows, "match_id int, track_id int, feature array<double>, weight double")).collect()}
    assert all(found[m, k] == (0 if k % 2 else 1) for m in (1, 2) for k in range(22))
    assert found[1, 90] == found[2, 90] == 2 and found[3, 1] == 2


def test_sample_times_see_every_track_where_possible(spark):
    rows = [(1, 1, i / 5) for i in range(500)] + [(1, 2, 40.05 + i / 5) for i in range(7)] + [(1, 3, 71.1), (2, 5, 4.0)]
    samples = frame(spark, rows, "match_id int, track_id int, t double")
    found = focus.sample_times(samples, 0.1, 100, 20, 0.11).collect()
    times = sorted(r.t for r in found if r.match_id == 1)
    assert sum(not r.extra for r in found if r.match_id == 1) == 10
    assert sum(min(abs(t - x[2]) for x in rows if x[:2] == (1, 2)) <= 0.11 for t in times) >= 2
    assert any(abs(t - 71.1) < 1e-9 for t in times)
    assert [r.t for r in found if r.match_id == 2] == [4.0]
    assert focus.sample_times(samples, 0.1, 100, 0, 0.11).where("extra").count() == 0


def test_linked_events_use_each_side_once(spark):
    rng = random.Random(8)
    found = [(m, f"e{m}.{i}", rng.choice(["goal", "shot", "save"]), round(rng.uniform(0, 40), 3)) for m in (1, 2) for i in range(40)]
    stored = [(m, f"s{m}.{i:02}", rng.choice([None, None, f"e{m}.{i}", f"e{m}.3", "gone"]), rng.choice(["goal", "shot", "save"]), round(rng.uniform(0, 40), 3)) for m in (1, 2) for i in range(40)]
    rows = control.linked_events(frame(spark, found, "match_id int, event_id string, type string, t double"), frame(spark, stored, "match_id int, stored_id string, names string, stored_type string, stored_t double"))
    want = {}
    for m, stored_id, names, *_ in sorted(stored, key=lambda s: s[1]):
        if any(e[0] == m and e[1] == names for e in found) and (m, names) not in want:
            want[m, names] = (stored_id, "id")
    for m, stored_id, _, kind, at in sorted(stored, key=lambda s: s[1]):
        if stored_id in {s for s, _ in want.values()}:
            continue
        near = sorted((abs(t - at), e) for k, e, type_, t in found if k == m and (m, e) not in want and (type_ == kind or kind == "shot") and abs(t - at) <= 1.25)
        if near:
            want[m, near[0][1]] = (stored_id, "time")
    assert {(r.match_id, r.event_id): (r.stored_id, r.by) for r in rows.collect()} == want


def test_focus_falls_back_in_order(spark):
    boxes = frame(spark, [(m, k, float(t), 10.0 * k, 0.0, 10.0 * k + 8, 20.0) for m in (1, 2, 3, 4, 5) for k in (1, 2, 3) for t in range(2 + k)], "match_id int, track_id int, t double, x1 double, y1 double, x2 double, y2 double")
    nobody = (None,) * 5
    requests = frame(spark, [(1, 2, *nobody), (2, 55, *nobody), (3, 99, 1.0, 19.0, 1.0, 29.0, 18.0), (4, None, 1.0, 900.0, 900.0, 905.0, 905.0), (5, None, *nobody)],
                     "match_id int, focus_track_id int, roi_t double, roi_x1 double, roi_y1 double, roi_x2 double, roi_y2 double")
    parts = frame(spark, [(2, 3, 55)], "match_id int, track_id int, source_track_id int")
    got = {r.match_id: (r.method, r.track_id) for r in focus.select_focus(requests, boxes, parts).collect()}
    assert got == {1: ("track_id", 2), 2: ("track_id_stitched", 3), 3: ("roi", 2), 4: ("fallback_longest", 3), 5: ("none", None)}


def test_new_ids_differ(spark):
    ids = [r.i for r in spark.range(20).select(control.new_id("job").alias("i")).collect()]
    assert len(set(ids)) == 20 and all(i.startswith("job_") and len(i) == 36 for i in ids)


def test_empty_inputs_give_no_rows(spark):
    none = frame(spark, [], "match_id int, track_id int, team int, t double, x double, vx double, vy double, g long, y double, opponent_m double, in_play boolean, frame int, fastest double, strongest double, speed double, turn double")
    assert focus.sample_times(none, 1.0, 5, 5, 0.1).count() == 0 and match.flights(none, 5.0).count() == 0
    assert match.dribbles(none, 1).count() == 0 and match.held_turnovers(none, 3, 2).count() == 0 and match.review_candidates(none, 2.0, 2.0).count() == 0
    assert focus.keepers_by_zone(none).count() == 0 and camera.limited_motion(none, 25.0).count() == 0
    assert focus.match_summary(none, none).count() == 0 and none.where(F.col("t") > 0).count() == 0


def test_flight_shots_find_a_goal_a_save_and_a_wide_shot(spark):
    ball = []

    def fly(t, x, y, vx, vy, seconds):
        ball.extend((1, round(t + i / 10, 2), x + vx * i / 10, y + vy * i / 10, vx, vy) for i in range(round(seconds * 10)))

    fly(100.0, 35.0, 0.0, 20.0, 0.5, 1.2)  # over the right line between the posts
    fly(200.0, 32.0, 4.0, 20.0, -2.0, 0.9)  # at the keeper, who throws it back
    fly(200.9, 49.0, 2.2, -5.0, 0.0, 1.0)
    fly(300.0, -30.0, 0.0, -20.0, -9.0, 1.6)  # past the left post
    fly(400.0, 0.0, 0.0, 20.0, 20.0, 1.0)  # nowhere near
    ball = frame(spark, ball, "match_id int, t double, x double, y double, vx double, vy double")
    kin = frame(spark, [(1, g, 10 if team == 0 else 20 + k, team, g / 10, x, y) for g in range(800, 3300) for k, (team, x, y) in enumerate([(0, 32.0, 4.0), (1, 50.0, 2.0), (1, -10.0, 30.0)])],
                "match_id int, g long, track_id int, team int, grid_t double, x double, y double")
    signs = frame(spark, [(1, 0, 1), (1, 1, -1)], "match_id int, team int, sign int")
    goals = frame(spark, [(1, "right", 101.0, 0.9)], "match_id int, side string, t double, confidence double")
    found = match.flight_shots(match.flights(ball.select("match_id", "t", "vx", "vy"), 10.0), ball, kin, signs, goals).orderBy("t", "type").collect()
    assert [(r.type, r.t, r.side, r.team, r.outcome) for r in found] == [
        ("shot", 100.0, "right", 0, "goal"), ("shot", 200.0, "right", 0, "saved"), ("save", 200.8, "right", 1, "saved"), ("chance", 300.0, "left", 1, "wide")]
    assert found[1].track_id == 10 and found[2].keeper_id == 21 and found[3].track_id is None


def test_best_of_two_goals_stays(spark):
    rows = frame(spark, [(1, "left", 0.0, 0.7), (1, "left", 10.0, 0.9), (1, "left", 34.0, 0.8), (1, "left", 36.0, 0.6), (1, "right", 12.0, 0.6), (1, "left", 90.0, 0.6)], "match_id int, side string, t double, confidence double")
    kept = ts.best_apart(rows, ["match_id", "side"], "t", "confidence", 25.0).collect()
    assert sorted((r.side, r.t) for r in kept) == [("left", 10.0), ("left", 36.0), ("left", 90.0), ("right", 12.0)]


def test_similar_histograms_equal_all_pairs_over_many_blocks(spark):
    rng = random.Random(4)
    data = [(i, [rng.random() for _ in range(6)]) for i in range(150)] + [(150, [0.0] * 6), (151, [1.0] * 3), (152, None), (153, [0.5] * 3)]
    rows = frame(spark, data, "id long, h array<double>")
    found = stats.most_similar(rows, rows.where("id % 10 = 1"), "id", "h", 4, block=32)
    want = set()
    for q, a in data:
        if q % 10 == 1:
            near = sorted((-round(sum(math.sqrt(x * y) for x, y in zip(a, b)) / math.sqrt(sum(a) * sum(b)), 6), m) for m, b in data if m != q and b and len(b) == len(a) and sum(b) > 0)
            want |= {(q, m, -s, i + 1) for i, (s, m) in enumerate(near[:4])}
    assert {(r.q, r.m, r.sim, r.rank) for r in found.collect()} == want
