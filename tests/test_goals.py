"""Goal signals and their fusion, against loops and known scenes."""

import numpy as np
import pytest

from pitchlake.operators import goals, match
from pitchlake.operators.goals import Rules

R = Rules()


def ball(spark, rows):
    return spark.createDataFrame([(int(m), float(t), float(x), float(y)) for m, t, x, y in rows], "match_id long, t double, x double, y double").cache()


def random_ball(seed):
    """A ball that hangs around the goals, with gaps."""
    rng = np.random.default_rng(seed)
    rows, t, x, y = [], 0.0, 40.0, 0.0
    for _ in range(900):
        t += float(rng.choice([0.1, 0.1, 0.1, 0.4, 0.6, 1.6, 2.5], p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.03, 0.02]))
        if rng.random() < 0.03:
            x, y = float(rng.choice([-49, 49, 53.5, -53.5, 0])), float(rng.uniform(-5, 5))
        x, y = x + float(rng.normal(0, 1.2)) + (2.8 if rng.random() < 0.1 else 0), y + float(rng.normal(0, 0.3))
        rows.append((1, round(t, 3), x, y))
    return rows


def band(y):
    return None if abs(y) > R.loose else abs(y) <= R.mouth


def loop_signals(rows):
    t, x, y = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    out = []
    for side, sign in (("left", -1), ("right", 1)):
        a = x * sign
        for i in range(1, len(t)):
            dt = t[i] - t[i - 1]
            if a[i - 1] <= R.line < a[i] and dt <= 0.5 and (a[i] - a[i - 1]) / dt >= R.entry_speed:
                k = (R.line - a[i - 1]) / (a[i] - a[i - 1])
                b = band(y[i - 1] + k * (y[i] - y[i - 1]))
                if b is not None:
                    back = a[(t >= t[i]) & (t <= t[i] + R.rebound_s)].min() < R.line - 2.1
                    out.append((side, "line_crossing", bool(b and not back), t[i - 1] + k * dt, t[i - 1] + k * dt))
        inside = np.flatnonzero((a >= R.line) & (a <= R.line + R.box_depth) & (np.abs(y) <= R.loose))
        runs = []
        for i in inside:
            if runs and t[i] - t[runs[-1][-1]] <= 1.5 and not (a[runs[-1][-1] + 1:i] < R.line).any():
                runs[-1].append(i)
            else:
                runs.append([i])
        for run in runs:
            i = run[0]
            near = np.flatnonzero((t >= t[i] - 0.5) & (t <= t[i] + 0.5))
            pace = (a[near[-1]] - a[near[0]]) / (t[near[-1]] - t[near[0]]) if len(near) > 1 else 0
            if not (pace > R.entry_speed or (i and t[i] - t[i - 1] <= 1.0 and a[i - 1] < R.line)):
                continue
            steps = [np.hypot(x[j] - x[j - 1], y[j] - y[j - 1]) / (t[j] - t[j - 1]) for j in run[1:] if t[j] - t[j - 1] <= 0.5]
            held = t[run[-1]] - t[i] >= 0.3 and len(run) >= 3 and len(steps) > 0 and np.median(steps) <= 21
            out.append((side, "in_goal_box", bool(held and (np.abs(y[run]) <= R.mouth).mean() >= 0.5), t[i], t[run[-1]]))
        for i in range(1, len(t)):
            gap = t[i + 1] - t[i] if i + 1 < len(t) else None
            if gap is not None and gap <= R.gap_s:
                continue
            j = np.flatnonzero(t >= t[i] - 0.75)[0]
            if j == i:
                continue
            va, vy = (a[i] - a[j]) / (t[i] - t[j]), (y[i] - y[j]) / (t[i] - t[j])
            if np.hypot(va, vy) < 26.25 or va <= 0 or not 0 <= (R.line - a[i]) / va <= 0.8:
                continue
            left = (R.line - a[i]) / va
            b = band(y[i] + vy * left)
            if b is not None:
                at = t[i] + min(left, gap or 0.0)
                out.append((side, "vanished_into_mouth", bool(b and gap is not None and gap >= 2.0), at, at))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_signals_and_chains_equal_a_loop(spark, seed):
    rows = random_ball(seed) + [(1, 3000.0 + i / 10, 40 + 3 * i, 0.0) for i in range(4)] + [(1, 3004.0, 0, 0), (1, 4000.0, 40, 0), (1, 4000.1, 43.5, 0)]
    signals = goals.ball_signals(ball(spark, rows)).cache()
    key = lambda s: (s[0], s[1], s[2], round(s[3], 6), round(s[4], 6))
    want = sorted(key(s) for s in loop_signals(rows))
    assert sorted(key(tuple(r)[1:]) for r in signals.collect()) == want
    assert {s[1] for s in want} == {"line_crossing", "in_goal_box", "vanished_into_mouth"} and len(want) > 10

    chains = []
    for side in ("left", "right"):
        reach = None
        for s in sorted((s for s in want if s[0] == side), key=lambda s: (s[3], s[4], s[1])):
            if reach is not None and s[3] - reach <= 4.0:
                chains[-1].append(s)
                reach = max(reach, s[4])
            else:
                chains.append([s])
                reach = s[4]
    expected = []
    for c in chains:
        best = {k: max(s[2] for s in c if s[1] == k) for k in {s[1] for s in c}}
        strong = sum(best.values())
        base = 0.55 + 0.25 * (strong - 1) + 0.17 * (len(best) - strong) if strong else 0.40 + 0.17 * (len(best) - 1)
        t = min([s[3] for s in c if s[2]] or [s[3] for s in c])
        net = [s[3] for s in c if s[1] == "in_goal_box" and s[2]]
        if net:
            t = max([s[3] for s in c if s[1] == "line_crossing" and 0 <= min(net) - s[3] <= 1.5] or [min(net)])
        expected.append((c[0][0], round(t, 5), round(max(s[4] for s in c), 5), round(base, 5), strong > 0, len(best)))
    got = [(r["side"], round(r["t"], 5), round(r["t_last"], 5), round(r["base"], 5), r["strong"], r["kinds"]) for r in goals.clustered(signals).collect()]
    assert sorted(got) == sorted(expected)


def players(kicked_at, lined, end=60, converge=None):
    """Ten players at 10 Hz: all over the pitch, in their halves around ``kicked_at`` if ``lined``, together after ``converge``."""
    rows = []
    for g in range(int(end * 10)):
        t = g / 10
        for k in range(10):
            team = k // 5
            x, y = (-1) ** (k + team) * (6.0 + 4 * (k % 5)), -20.0 + 8 * (k % 5)
            if lined and abs(t - kicked_at) <= 2:
                x = (-1 if team == 0 else 1) * (8.0 + 3 * (k % 5))
            if converge is not None and team == 0 and converge + 2 <= t <= converge + 9:
                x, y = 40.0 + k, float(k)
            rows.append((1, g, t, k, team, float(x), float(y)))
    return rows


def scene(spark, lined, back=None, crowd=False, converge=False):
    """A shot that vanishes into the right goal at 10 s; the ball is on the centre spot from 30 s."""
    path = [(1, i / 10, 20 + 30 * (i / 10 - 9.0) if i >= 90 else 20.0, 0.5) for i in range(0, 101)]
    path += [(1, back + i / 10, 0.0, 5.0) for i in range(3)] if back else []
    path += [(1, 30 + i / 10, 0.0, 0.0) for i in range(20)]
    kin = spark.createDataFrame(players(30.0, lined, converge=10.0 if converge else None), "match_id long, g long, grid_t double, track_id int, team int, x double, y double")
    signs = spark.createDataFrame([(1, 0, 1), (1, 1, -1)], "match_id long, team int, sign int")
    peaks = spark.createDataFrame([(1, 11.0, 0.8)] if crowd else [], "match_id long, peak_t double, strength double")
    return goals.goal_events(ball(spark, path), kin, signs, peaks).collect()


def test_a_vanished_ball_is_a_goal_only_with_company(spark):
    (lone,) = scene(spark, lined=False)
    assert (lone["side"], lone["verdict"], lone["kickoff"]) == ("right", "shot", "rejected") and lone["confidence"] == pytest.approx(0.55)
    (goal,) = scene(spark, lined=True)
    assert (goal["verdict"], goal["kickoff"]) == ("goal", "players") and goal["confidence"] == pytest.approx(0.75) and 9.9 < goal["t"] < 10.8
    (heard,) = scene(spark, lined=False, crowd=True)
    assert heard["verdict"] == "goal" and heard["confidence"] == pytest.approx(0.72) and heard["peak"] == 0.8
    (merry,) = scene(spark, lined=True, crowd=True, converge=True)
    assert merry["spread_ratio"] < 0.75 and merry["confidence"] == pytest.approx(0.98)


def test_a_ball_back_in_play_is_no_goal(spark):
    (found,) = scene(spark, lined=True, back=12.2, crowd=True)
    assert found["verdict"] == "shot" and found["confidence"] <= 0.35 + 1e-9


def test_open_play_before_the_centre_spot_is_no_kickoff(spark):
    path = [(1, i / 10, 0.0, 0.0) for i in range(300, 320)]
    run = [(1, 15 + i / 10, -40 + 2.0 * i, 25.0) for i in range(20)]  # 20 m/s for two seconds, far from the right goal
    candidate = spark.createDataFrame([(1, "right", 10.0, 10.0)], "match_id long, side string, t double, t_last double")
    assert [r["kickoff_t"] for r in goals.kickoffs(ball(spark, path), candidate).collect()] == [30.0]
    assert goals.kickoffs(ball(spark, run + path), candidate).count() == 0
    moving = [(1, 30 + i / 10, 3.0 * (i % 2), 0.0) for i in range(20)]  # there, but not at rest; it appeared after a gap
    assert [r["kickoff_t"] for r in goals.kickoffs(ball(spark, moving), candidate).collect()] == [30.0]
    never = [(1, 29 + i / 10, 20.0 - 3 * i, 0.0) for i in range(14)]
    assert goals.kickoffs(ball(spark, never), candidate).count() == 0


def test_no_ball_no_goals(spark):
    kin = spark.createDataFrame([], "match_id long, g long, grid_t double, track_id int, team int, x double, y double")
    signs = spark.createDataFrame([], "match_id long, team int, sign int")
    assert goals.goal_events(ball(spark, []), kin, signs).count() == 0
    # without players the centre spot alone is company enough, but not confidence
    path = [(1, i / 10, 20 + 30 * (i / 10 - 9.0) if i >= 90 else 20.0, 0.5) for i in range(0, 101)] + [(1, 30 + i / 10, 0.0, 0.0) for i in range(20)]
    (found,) = goals.goal_events(ball(spark, path), kin, signs).collect()
    assert (found["kickoff"], found["verdict"]) == ("ball_only", "shot")
