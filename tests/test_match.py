import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import match
from tests.synthetic import BALL, synthetic_matches
from pitchlake.sources.working import kept


@pytest.fixture(scope="module")
def analysis(spark):
    rows = synthetic_matches(spark, 2, 30.0).cache()
    return rows, match.analyse(rows.where(F.col("track_id") != BALL), rows.where(F.col("track_id") == BALL), keep=kept)


def test_both_goals_of_each_match_and_no_other(analysis):
    goals = analysis[1]["goals"].collect()
    assert sorted((g["match_id"], g["side"]) for g in goals) == [(0, "left"), (0, "right"), (1, "left"), (1, "right")]
    assert all(abs(g["t"] - (12.5 if g["side"] == "right" else 24.5)) < 6 for g in goals)


def test_distance_within_ten_percent(analysis):
    rows, found = analysis
    got = {(r["match_id"], r["track_id"]): r["distance_m"] for r in found["player_stats"].collect()}
    for (m, k), track in rows.where(F.col("track_id") != BALL).toPandas().groupby(["match_id", "track_id"]):
        true = np.hypot(*np.diff(track.sort_values("t")[["x", "y"]].to_numpy(), axis=0).T).sum()
        assert got[m, k] == pytest.approx(true, rel=0.1)


def test_speed_and_gap(spark):
    """3 m/s, 8 m/s, five seconds missing with a jump of 40 m, 3 m/s: 84 m, one sprint, 23 s."""
    t = np.concatenate([np.arange(0, 13, 0.04), np.arange(18, 28, 0.04)])
    x = np.where(t < 10, 3 * t, np.where(t < 13, 30 + 8 * (t - 10), 94 + 3 * (t - 18))) - 50
    rows = spark.createDataFrame([(1, 1, 0, float(a), float(b), 0.0) for a, b in zip(t, x)], "match_id long, track_id int, team int, t double, x double, y double")
    kin = match.kinematics(rows)
    row = match.player_stats(kin, spark.createDataFrame([(1, 0, 1)], "match_id long, team int, sign int")).first()
    assert row["distance_m"] == pytest.approx(84, abs=2) and row["sprints"] == 1 and row["seconds"] == pytest.approx(23, abs=0.5)


def test_ball_filter_drops_a_teleport_and_reacquires(spark):
    path = [(1, i * 0.1, 10.0 + i, 0.0) for i in range(20)] + [(1, 1.05, 90.0, 30.0)] + [(1, 4.0 + i * 0.1, 60.0 + i, 5.0) for i in range(10)]
    out = match.filter_ball(spark.createDataFrame(path, "match_id long, t double, x double, y double"), 105.0, base_gate=6.0).toPandas()
    assert not ((out["x"] > 85) & (out["t"] < 2)).any() and (out["t"] > 4).sum() >= 9 and len(out) >= 28


def test_states_hold_a_restart_until_the_ball_is_back(spark):
    rows = [(1, i, i * 0.2, 0.0 if i < 20 or i > 40 else 60.0, 0.0, True) for i in range(60)]
    segments = match.game_states(spark.createDataFrame(rows, "match_id long, g long, grid_t double, x double, y double, visible boolean"))
    assert [(r["state"], r["side"]) for r in segments.orderBy("start_s").collect()] == [("in_play", None), ("restart_right", "right"), ("in_play", None)]
    assert segments.where("state = 'restart_right'").first()["end_s"] == pytest.approx(8.8, abs=0.3)


def test_reel_takes_must_haves_and_fits_the_rest(spark):
    events = spark.createDataFrame([(1, "a", "goal", 10.0, 5.0, 15.0, 0.1, 0.5), (1, "b", "shot", 50.0, 45.0, 55.0, 0.9, 0.5), (1, "c", "shot", 90.0, 80.0, 99.0, 0.8, 0.5)], "match_id long, event_id string, type string, t double, t_start double, t_end double, excitement double, confidence double")
    clips = match.plan_reel(events, 22.0).orderBy("clip").collect()
    assert [c["event_ids"] for c in clips] == [["a"], ["b"]]


def test_heatmap_sums_to_one_and_momentum_is_bounded(analysis):
    found = analysis[1]
    maps = match.heatmap(found["kin"]).limit(3).collect()
    assert all(np.isclose(np.sum(r["heatmap"]), 1) and np.shape(r["heatmap"]) == (14, 21) for r in maps)
    assert all(-1 <= r["momentum"] <= 1 for r in found["momentum"].collect())


def test_events_have_windows_and_ids(analysis):
    rows = analysis[1]["events"].collect()
    assert rows and all(r["t_start"] <= r["t"] <= r["t_end"] and 0 <= r["excitement"] <= 1 and r["event_id"].startswith("ev_") for r in rows)


def test_teams_change_sides_at_half_time(spark):
    rows = [(1, k, k % 2, i, i * 10.0, (-20.0 if (k % 2 == 0) == (i < 10) else 20.0) + k, 0.0) for k in range(4) for i in range(20)]
    kin = spark.createDataFrame(rows, "match_id long, track_id int, team int, g long, grid_t double, x double, y double")
    halves = spark.createDataFrame([(1, 100.0)], "match_id long, half_s double")
    signs = {(r["team"], r["from_s"] == 100.0): r["sign"] for r in match.attack_signs(kin, halves).collect()}
    assert signs == {(0, False): 1, (0, True): -1, (1, False): -1, (1, True): 1}
    assert {(r["team"], r["sign"]) for r in match.attack_signs(kin).collect()} == {(0, 1), (1, -1)}
    goals = spark.createDataFrame([(1, 30.0, 1), (1, 150.0, 1)], "match_id long, goal_t double, sign int")
    found = match.inferred_shots(spark.createDataFrame([(1, 28.0, 0, 0), (1, 100.0, 1, 1)], "match_id long, t double, track_id int, team int"), goals, match.attack_signs(kin, halves)).orderBy("t").collect()
    assert [(r["t"], r["team"], r["track_id"]) for r in found] == [(28.0, 0, 0), (150.0, 1, None)]


def test_half_time_is_the_longest_stop_in_the_middle(spark):
    stops = [(1, 0.0, 500.0, "restart_left"), (1, 2500.0, 2800.0, "ball_lost"), (1, 3000.0, 3190.0, "ball_lost"), (2, 10.0, 20.0, "ball_lost"), (1, 2000.0, 2900.0, "in_play")]
    segments = spark.createDataFrame(stops, "match_id long, start_s double, end_s double, state string")
    found = match.half_times(segments, spark.createDataFrame([(1, 5400.0), (2, 100.0)], "match_id long, duration_s double"))
    assert {(r["match_id"], r["half_s"]) for r in found.collect()} == {(1, 2650.0), (2, 50.0)}


def test_savitzky_golay_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    runs = {n: rng.normal(size=n) for n in (1, 3, 4, 5, 6, 7, 8, 9, 10, 23)}
    rows = [(1, n, i, float(v)) for n, values in runs.items() for i, v in enumerate(values)]
    got = match.smooth_runs(spark.createDataFrame(rows, "k int, run int, g long, x double"), ["k"], "run", "g", ["x"]).toPandas()
    for n, values in runs.items():
        size = min(9, n - (n + 1) % 2)
        want = values.copy()
        if size > 3:
            for i in range(n):
                a = max(0, min(i - size // 2, n - size))
                want[i] = np.polyval(np.polyfit(np.arange(a, a + size), values[a:a + size], 2), i)
        assert np.allclose(got[got["run"] == n].sort_values("g")["x"], want)


def test_a_full_match_fits_its_budget(spark):
    """90 minutes of 25 players at 10 Hz: a random walk, all statistics of players."""
    import time

    walk = spark.range(25).selectExpr("1L AS match_id", "cast(id AS int) AS track_id", "cast(id % 2 AS int) AS team", "explode(sequence(0, 53999)) AS i")
    rows = walk.selectExpr("match_id", "track_id", "team", "i / 10D AS t", "30 * sin(i / 300D + track_id) AS x", "20 * cos(i / 200D + track_id) AS y")
    start = time.time()
    kin = match.kinematics(rows)
    assert match.player_stats(kin, match.attack_signs(kin)).count() == 25
    assert time.time() - start < 30
