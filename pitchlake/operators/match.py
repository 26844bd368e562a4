"""Match analytics: ball, states, kinematics, touches, passes, possession, shots, goals, events, statistics, reels.

Everything is keyed by ``match_id`` and runs as joins, windows and aggregates; only steps that are strictly
sequential (the ball filter, the state machine, reel selection) are small functions over one match's rows.
Positions are metres from the centre spot unless a name ends in ``_px``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.functions import exprs
from pitchlake.operators import broadcast, restarts
from pitchlake.operators import goals as goals_of
from pitchlake.operators import timeseries as ts

HZ = 10.0
MATCH = ["match_id"]


# --- ball ----------------------------------------------------------------------------------------------------


def filter_ball(raw: DataFrame, frame_width: float, speed: float = 2.2, base_gate: float = 80.0, widest: float = 0.35, alpha: float = 0.5, beta: float = 0.3, silence: float = 0.9, confirm: float = 0.7) -> DataFrame:
    """(match_id, t, x, y, raw_count): a constant-velocity filter over raw ball detections (match_id, t, x, y).

    A detection farther from the prediction than the gate is kept aside; two that agree with each other start the
    track, or start it anew after ``silence`` seconds.
    """
    limit = speed * frame_width

    def agree(aside: list) -> list:
        recent = [p for p in aside if aside[-1][0] - p[0] <= confirm] if aside else []
        fits = all(math.hypot(b[1] - a[1], b[2] - a[2]) <= limit * max(1e-3, b[0] - a[0]) for a, b in zip(recent, recent[1:]))
        return recent if len(recent) >= 2 and fits else []

    def run(match: pd.DataFrame) -> pd.DataFrame:
        match = match.dropna(subset=["t", "x", "y"]).sort_values("t", kind="stable")
        out, aside, last = {}, [], None
        times = match["t"].round(4).to_numpy(float)
        starts = np.flatnonzero(np.diff(times, prepend=np.nan) != 0)
        raw_t, xs, ys = (match[c].to_numpy(float).tolist() for c in ("t", "x", "y"))
        far, hypot = widest * frame_width, math.hypot
        for t, i, end in zip(times[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(xs)]):
            if last is not None:
                # plain floats: this runs once a sample
                dt = t - last
                dt = dt if dt > 1e-3 else 1e-3
                ahead = dt if dt < 0.5 else 0.5
                px, py = x + vx * ahead, y + vy * ahead
                rx, ry = xs[i] - px, ys[i] - py
                away = hypot(rx, ry)
                for k in range(i + 1, end):
                    d = hypot(xs[k] - px, ys[k] - py)
                    if d < away:
                        away, rx, ry = d, xs[k] - px, ys[k] - py
                gate = base_gate + limit * dt
                if away <= (gate if gate < far else far):
                    vx, vy = vx + beta * rx / dt, vy + beta * ry / dt
                    fast = hypot(vx, vy)
                    if fast > limit:
                        slow = limit / fast
                        vx, vy = vx * slow, vy * slow
                    last, x, y = t, px + alpha * rx, py + alpha * ry
                    out[t] = (x, y)
                    if aside:
                        aside = []
                    continue
            aside = [p for p in aside if t - p[0] <= max(confirm, 1.0)] + list(zip(raw_t[i:end], xs[i:end], ys[i:end]))
            start = agree(aside) if last is None or t - last > silence else []
            if start:
                out |= {p[0]: p[1:3] for p in start}
                a, b = start[-2], start[-1]
                dt = max(1e-3, b[0] - a[0])
                last, x, y, vx, vy = b[0], b[1], b[2], (b[1] - a[1]) / dt, (b[2] - a[2]) / dt
                aside = []
        at = np.fromiter(out, float, len(out))
        order, places = np.argsort(at), np.array(list(out.values()), float).reshape(-1, 2)
        rows = {"t": at[order], "x": places[order, 0], "y": places[order, 1], "raw_count": len(match)}
        return pd.DataFrame(rows).assign(match_id=match["match_id"].iloc[0] if len(out) else None)[["match_id", "t", "x", "y", "raw_count"]]

    schema = f"match_id {dict(raw.dtypes)['match_id']}, t double, x double, y double, raw_count long"
    return raw.select("match_id", "t", "x", "y").groupBy("match_id").applyInPandas(run, schema)


def ball_on_grid(ball: DataFrame, longest: float = 1.25, near: float = 0.14, hz: float = HZ, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(match_id, g, grid_t, x, y, visible, vx, vy, speed): null where the ball isn't visible; centred differences.

    ``keep`` is applied to the places, from which each use derives the velocities that it needs.
    """
    grid = keep(ts.resample_grid(ball, MATCH, "t", ["x", "y"], 1 / hz, longest, near).withColumnRenamed("observed", "visible"))
    return velocities(grid, "x", "y", "speed", hz)


def velocities(grid: DataFrame, x: str, y: str, speed: str, hz: float = HZ) -> DataFrame:
    """Rows of the grid with vx, vy and the speed: null unless both neighbours on the grid have a place."""
    w = Window.partitionBy("match_id").orderBy("g")
    step = lambda c: F.when(F.lead("g").over(w) - F.lag("g").over(w) == 2, (F.lead(c).over(w) - F.lag(c).over(w)) * hz / 2)
    return grid.withColumn("vx", step(x)).withColumn("vy", step(y)).withColumn(speed, F.hypot("vx", "vy"))


def game_states(
    grid: DataFrame, half_length: float = 52.5, half_width: float = 34.0, margin: float = 2.0, grace: float = 0.7, confirm: float = 0.6, longest: float = 50.0, near_goal: float = 12.0,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """(match_id, start_s, end_s, state, side): in_play, ball_lost and restart_* segments from the ball on its grid.

    A restart holds until the ball has been back for ``confirm`` seconds, or for ``longest`` at most. ``keep`` is applied to
    the first and last steps of the states.
    """
    out_x, out_y = half_length + margin, half_width + margin

    def run(match: pd.DataFrame) -> pd.DataFrame:
        match = match.sort_values("g")
        state, since, back, gone, last_x, names = "in_play", 0.0, None, None, None, []
        for t, x, y, visible in zip(*(match[c].tolist() for c in ("grid_t", "x", "y", "visible"))):
            target = None
            if visible:
                gone, last_x = None, x
                target = "restart_left" if x < -out_x else "restart_right" if x > out_x else "restart_touchline" if abs(y) > out_y else "in_play"
            else:
                gone = t if gone is None else gone
                if t - gone >= grace and not state.startswith("restart"):
                    target = "restart_left" if last_x is not None and last_x < near_goal - half_length else "restart_right" if last_x is not None and last_x > half_length - near_goal else "ball_lost"
            back = (t if back is None else back) if target == "in_play" else None
            if state.startswith("restart"):
                if target is not None and target.startswith("restart") and target != state:
                    state, since = target, t
                elif target == "in_play" and (t - back >= confirm or t - since >= longest):
                    state = "in_play"
                elif target is None and t - since >= longest:
                    state = "ball_lost"
            elif target is not None:
                state, since = target, t if target != state else since
            names.append(state)
        # the first and the last step of each state say it all
        named = np.array(names, object)
        new = np.append(True, named[1:] != named[:-1])
        return pd.DataFrame({"match_id": match["match_id"], "g": match["g"], "grid_t": match["grid_t"], "state": names})[new | np.append(new[1:], True)]

    kind = dict(grid.dtypes)["match_id"]
    stepped = keep(grid.select("match_id", "g", "grid_t", "x", "y", "visible").groupBy("match_id").applyInPandas(run, f"match_id {kind}, g long, grid_t double, state string"))
    runs = ts.islands_by_value(stepped, MATCH, ["g"], F.col("state")).groupBy("match_id", "island", "state").agg(F.min("grid_t").alias("start_s"), F.max("grid_t").alias("last"))
    following = F.lead("start_s").over(Window.partitionBy("match_id").orderBy("start_s"))
    side = F.when(F.col("state").isin("restart_left", "restart_right"), F.substring_index("state", "_", -1))
    return runs.withColumn("end_s", F.coalesce(following, "last")).where("end_s > start_s").select("match_id", "start_s", "end_s", "state", side.alias("side"))


def state_seconds(segments: DataFrame) -> DataFrame:
    return segments.groupBy("match_id", "state").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"))


def overlay(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Segments cut at the windows (match_id, w_start, w_end, w_state); inside one its state holds, except over goal states."""
    cuts = segments.select("match_id", F.explode(F.array("start_s", "end_s")).alias("at")).unionByName(windows.select("match_id", F.explode(F.array("w_start", "w_end")).alias("at"))).distinct()
    pieces = cuts.withColumn("to", F.lead("at").over(Window.partitionBy("match_id").orderBy("at"))).where("to > at").withColumn("mid", (F.col("at") + F.col("to")) / 2)
    inside = ts.range_join(pieces, segments, MATCH, "mid", "start_s", "end_s", 60.0)
    both = ts.range_join(inside, windows, MATCH, "mid", "w_start", "w_end", 60.0, how="left")
    named = both.groupBy("match_id", "at", "to").agg(F.first("state").alias("state"), F.min("w_state").alias("over"))
    named = named.withColumn("state", F.when(F.col("state").startswith("goal"), F.col("state")).otherwise(F.coalesce("over", "state")))
    runs = ts.islands_by_value(named, MATCH, ["at"], F.col("state"))
    return runs.groupBy("match_id", "island", "state").agg(F.min("at").alias("start_s"), F.max("to").alias("end_s")).drop("island")


# --- players -------------------------------------------------------------------------------------------------


def savgol_weights(window: int, order: int = 2) -> np.ndarray:
    """Row i smooths the i-th of ``window`` samples by a least-squares polynomial; the middle row serves inner samples."""
    a = np.vander(np.arange(window) - window // 2, order + 1, increasing=True)
    return a @ np.linalg.pinv(a)


def smooth_runs(df: DataFrame, keys: list[str], run: str, order: str, values: list[str], window: int = 9) -> DataFrame:
    """Savitzky-Golay over each run of samples; shorter runs take the largest odd window that fits, or stay.

    A smoothed sample is a fixed weighted sum of its neighbours, by the middle row of weights inside and by the first
    and last rows near a run's ends. One key's runs meet in a task as arrays, summed neighbour by neighbour: windows would
    carry all neighbours of a row along with it.
    """
    weights = np.zeros((window + 1, window, window))
    for n in range(5, window + 1, 2):
        weights[n, :n, :n] = savgol_weights(n)

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([run, order], kind="stable")
        names = rows[run].to_numpy()
        first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        lengths = np.diff(np.append(first, len(rows)))
        base, n = np.repeat(first, lengths), np.repeat(lengths, lengths)
        i = np.arange(len(rows)) - base
        size = np.minimum(window, n - (n + 1) % 2)
        start = np.maximum(0, np.minimum(i - size // 2, n - size))
        out = {}
        for c in values:
            v = rows[c].to_numpy(float)
            total = np.zeros(len(v))
            for k in range(window):
                inside = np.flatnonzero((size >= 5) & (k < size))
                total[inside] += v[(base + start)[inside] + k] * weights[size[inside], (i - start)[inside], k]
            out[c] = np.where(size >= 5, total, v)
        return rows.assign(**out)

    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in values else f for f in df.schema.fields])
    return df.groupBy(*keys).applyInPandas(smooth, schema)


def kinematics(samples: DataFrame, fastest: float = 12.0, longest_gap: float = 1.0, hz: float = HZ, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(match_id, track_id, team, g, grid_t, x, y, step, speed) of samples (match_id, track_id, team, t, x, y).

    A jump of more than twice the top speed and 2 m starts a new run, over which nothing is interpolated or smoothed.
    ``keep`` is applied to the smoothed places, from which each use derives the steps and speeds that it needs.
    """
    keys = ["match_id", "track_id", "team"]
    w = Window.partitionBy(*keys).orderBy("t")
    moved = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    jump = F.coalesce((moved > 2 * fastest * (F.col("t") - F.lag("t").over(w))) & (moved > 2.0), F.lit(False))
    cut = samples.withColumn("run", F.sum(jump.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grid = ts.resample_grid(cut, [*keys, "run"], "t", ["x", "y"], 1 / hz, longest_gap, 0.5 / hz).where("observed")
    grid = ts.islands_by_gap(grid, [*keys, "run"], "g", 1, "piece").withColumn("run", F.concat_ws(".", "run", "piece")).drop("piece", "observed")
    smooth = keep(smooth_runs(grid, keys, "run", "g", ["x", "y"]))
    r = Window.partitionBy(*keys, "run").orderBy("g")
    step = F.least(F.coalesce(F.hypot(F.col("x") - F.lag("x").over(r), F.col("y") - F.lag("y").over(r)), F.lit(0.0)), F.lit(fastest / hz))
    out = smooth.withColumn("step", step)
    speed = F.when(F.row_number().over(r) == 1, F.coalesce(F.lead("step").over(r), F.lit(0.0))).otherwise(F.col("step")) * hz
    return out.withColumn("speed", speed)


def half_times(segments: DataFrame, durations: DataFrame, shortest: float = 180.0) -> DataFrame:
    """(match_id, half_s): the middle of the longest stop of three minutes or more in the match's middle part, else half its duration.

    ``durations`` is (match_id, duration_s); the middle part is from 30 to 70 per cent.
    """
    stop, middle = F.col("end_s") - F.col("start_s"), (F.col("end_s") + F.col("start_s")) / 2
    stops = segments.where("state <> 'in_play'").join(durations, "match_id").where((stop >= shortest) & middle.between(0.3 * F.col("duration_s"), 0.7 * F.col("duration_s")))
    best = stops.groupBy("match_id").agg(F.max_by(middle, F.struct(stop, -middle)).alias("half_s"))
    return durations.join(best, "match_id", "left").select("match_id", F.coalesce("half_s", F.col("duration_s") / 2).alias("half_s"))


def player_stats(kin: DataFrame, signs: DataFrame, sprint: float = 7.0, sprint_s: float = 1.0, intense: float = 5.5, hz: float = HZ) -> DataFrame:
    """Per player: seconds, distance, p99 speed, sprints, high-intensity metres and thirds; ``signs`` has each team's attacking sign."""
    keys = ["match_id", "track_id", "team"]
    fast = ts.islands_by_value(kin, keys, ["g"], F.col("speed") > sprint).where(F.col("speed") > sprint)
    sprints = fast.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= np.ceil(sprint_s * hz)).groupBy(*keys).agg(F.count(F.lit(1)).alias("sprints"))
    third = exprs.third(F.col("x"), F.coalesce("sign", F.lit(1)))
    share = lambda n, name: F.round(100.0 * F.count_if(third == n) / F.count(F.lit(1)), 1).alias(name)
    base = with_sign(kin, signs, "grid_t", "left").groupBy(*keys).agg(
        (F.count(F.lit(1)) / hz).alias("seconds"), F.sum("step").alias("distance_m"), F.percentile("speed", F.lit(0.99)).alias("top_speed"),
        F.sum(F.when(F.col("speed") > intense, F.col("step")).otherwise(0.0)).alias("intense_m"), share(0, "own_pct"), share(1, "middle_pct"), share(2, "attack_pct"))
    return base.join(sprints, keys, "left").fillna(0, ["sprints"])


def heatmap(kin: DataFrame, columns: int = 21, rows: int = 14) -> DataFrame:
    """(match_id, track_id, heatmap): a dense rows x columns matrix that sums to one."""
    x, y = exprs.clip_to_pitch(F.col("x"), F.col("y"))
    cell = F.least(F.lit(rows - 1), F.floor((y + 34.0) / 68.0 * rows)) * columns + F.least(F.lit(columns - 1), F.floor((x + 52.5) / 105.0 * columns))
    counts = kin.groupBy("match_id", "track_id", cell.cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("match_id", "track_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"), F.sum("n").alias("total"))
    at = lambda i, j: F.coalesce(F.try_element_at("m", (i * columns + j).cast("int")), F.lit(0)) / F.col("total")
    return whole.select("match_id", "track_id", F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: at(i, j))).alias("heatmap"))


def attack_signs(kin: DataFrame, halves: DataFrame | None = None) -> DataFrame:
    """(match_id, team, sign, from_s, to_s): +1 while the team plays to the right, which is the one whose median is further left.

    With ``halves`` (match_id, half_s) each half is judged by its own samples; a half without samples of both teams
    has the other half's sides changed round.
    """
    forever = float("inf")
    rows = kin.where(F.col("team").isin(0, 1))
    rows = rows.withColumn("half_s", F.lit(forever)) if halves is None else rows.join(halves, "match_id")
    medians = rows.groupBy("match_id", "half_s").agg(*[
        F.median(F.when((F.col("team") == team) & ((F.col("grid_t") < F.col("half_s")) == (half == 0)), F.col("x"))).alias(f"m{team}{half}") for team in (0, 1) for half in (0, 1)])
    left = lambda half: F.when(F.col(f"m0{half}").isNotNull() & F.col(f"m1{half}").isNotNull(), F.when(F.col(f"m0{half}") <= F.col(f"m1{half}"), 1).otherwise(-1))
    signs = medians.withColumn("first", F.coalesce(left(0), -left(1), F.lit(1))).withColumn("second", F.coalesce(left(1), -left(0), F.lit(-1)))
    part = lambda team, sign, a, b: F.struct(F.lit(team).alias("team"), sign.cast("int").alias("sign"), a.alias("from_s"), b.alias("to_s"))
    parts = [part(team, F.col(c) * (1 if team == 0 else -1), *((F.lit(-forever), F.col("half_s")) if c == "first" else (F.col("half_s"), F.lit(forever)))) for team in (0, 1) for c in ("first", "second")]
    return signs.select("match_id", F.explode(F.array(*parts)).alias("s")).select("match_id", "s.*").where("from_s < to_s")


def with_sign(rows: DataFrame, signs: DataFrame, t: str, how: str = "inner", by: str = "team") -> DataFrame:
    """Rows with the attacking sign of their team at time ``t`` (or, ``by="sign"``, the team that has their sign then)."""
    if "from_s" not in signs.columns:
        signs = signs.withColumns({"from_s": F.lit(-float("inf")), "to_s": F.lit(float("inf"))})
    during = signs.withColumnsRenamed({"match_id": "_match", by: f"_{by}"})
    test = (F.col("match_id") == F.col("_match")) & (F.col(by) == F.col(f"_{by}")) & (F.col(t) >= F.col("from_s")) & (F.col(t) < F.col("to_s"))
    return rows.join(during, test, how).drop("_match", f"_{by}", "from_s", "to_s")


# --- touches, passes, possession --------------------------------------------------------------------------------


def nearest_players(ball: DataFrame, kin: DataFrame, hz: float = HZ, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Each visible ball sample of the grid with its nearest player and each team's distance; an equi-join on the grid.

    ``keep`` is applied to them before the ball's velocities, which are those of the grid: null beside a step without a place.
    """
    pairs = ball.where("visible").select("match_id", "g", "grid_t", F.col("x").alias("bx"), F.col("y").alias("by")).join(kin.where("team <> 2").select("match_id", "g", "track_id", "team", "x", "y"), ["match_id", "g"], "left")
    d = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    near = pairs.withColumn("d", d).groupBy("match_id", "g", "grid_t", "bx", "by").agg(
        F.min(F.when(F.col("d").isNotNull(), F.struct("d", "track_id", "team"))).alias("near"), F.min(F.when(F.col("team") == 0, F.col("d"))).alias("d0"), F.min(F.when(F.col("team") == 1, F.col("d"))).alias("d1"))
    return velocities(keep(near), "bx", "by", "ball_speed", hz)


def both_balls(filtered: DataFrame, raw: DataFrame) -> DataFrame:
    """(match_id, t, x, y, _raw): the filtered and the raw ball in one table."""
    return filtered.select("match_id", "t", "x", "y", F.lit(False).alias("_raw")).unionByName(raw.select("match_id", "t", "x", "y", F.lit(True).alias("_raw")))


def touch_ball(filtered: DataFrame, raw: DataFrame, near_s: float = 0.1, gate: float = 2.5, share: float = 0.5) -> DataFrame:
    """(match_id, t, x, y): the raw ball where it agrees with the filtered one, in matches where enough of it does, else the filtered.

    A filter lags where a kick turns the ball, which is where touches are. A raw sample agrees when a filtered one is within
    ``near_s`` and the filtered path is within ``gate`` metres at its time. A match takes them if they are ``share`` of its
    filtered samples at least and both have three; of several at a time the first stays.
    """
    return agreeing(both_balls(filtered, raw), near_s, gate, share)


def agreeing(rows: DataFrame, near_s: float = 0.1, gate: float = 2.5, share: float = 0.5) -> DataFrame:
    """``touch_ball`` of ``both_balls``."""
    whole = Window.partitionBy("match_id").orderBy("t", "_raw")
    path = F.when(~F.col("_raw"), F.struct("t", "x", "y"))
    rows = rows.withColumn("_before", F.last(path, ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_after", F.last(path, ignorenulls=True).over(Window.partitionBy("match_id").orderBy(F.desc("t"), F.desc("_raw")).rowsBetween(Window.unboundedPreceding, 0)))
    a, b = F.col("_before"), F.col("_after")
    part = F.when(a.isNull() | b.isNull() | (b["t"] <= a["t"]), F.when(a.isNull(), 1.0).otherwise(0.0)).otherwise((F.col("t") - a["t"]) / (b["t"] - a["t"]))
    at = lambda c: F.coalesce(a[c], b[c]) + part * F.coalesce(b[c] - a[c], F.lit(0.0))
    closest = F.least(F.col("t") - a["t"], b["t"] - F.col("t"))
    fits = F.coalesce((closest <= near_s) & (F.hypot(F.col("x") - at("x"), F.col("y") - at("y")) <= gate), F.lit(False))
    rows = rows.withColumn("_fits", F.col("_raw") & fits)
    count = lambda c: F.count_if(c).over(Window.partitionBy("match_id"))
    rows = rows.where("match_id IS NOT NULL").select("match_id", "t", "x", "y", "_raw", "_fits", count(~F.col("_raw")).alias("n"), count(F.col("_raw")).alias("n_raw"), count(F.col("_fits")).alias("n_fit"))
    take = (F.col("n") >= 3) & (F.col("n_raw") >= 3) & (F.col("n_fit") >= share * F.col("n"))
    chosen = rows.where(F.when(take, F.col("_fits")).otherwise(~F.col("_raw")))
    first = Window.partitionBy("match_id", F.rint(F.col("t") * 1e6)).orderBy("x", "y")
    return chosen.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("match_id", "t", "x", "y")


def touches(
    near: DataFrame, radius: float = 1.0, kick_radius: float = 2.0, angle: float = 35.0, gain: float = 4.0, slowest: float = 2.0, refractory: float = 0.5, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """(match_id, t, track_id, team, x, y, kind): dwells near one player, and kicks (turns or gains of speed), debounced per player.

    ``keep`` is applied to what is debounced, which is joined to what stays of it.
    """
    rows = near.where("near IS NOT NULL").withColumn("who", F.col("near.track_id")).withColumn("d", F.col("near.d"))
    w = Window.partitionBy("match_id").orderBy("g")
    close = F.when(F.col("d") <= radius, F.col("who"))
    runs = ts.islands_by_value(rows, MATCH, ["g"], close, "dwell").where(close.isNotNull())
    dwell = runs.groupBy("match_id", "dwell").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("grid_t", "who", "near.team", "bx", "by")).alias("s")).where("n >= 2").select("match_id", "s.*", F.lit("dwell").alias("kind"))
    vx0, vy0, vx1, vy1 = (F.lag("vx").over(w), F.lag("vy").over(w), F.lead("vx").over(w), F.lead("vy").over(w))
    s0, s1 = F.hypot(vx0, vy0), F.hypot(vx1, vy1)
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (vx0 * vx1 + vy0 * vy1) / F.greatest(s0 * s1, F.lit(1e-9))))))
    rows = rows.withColumn("turn", F.when((s0 >= slowest) & (s1 >= slowest) & (turn >= angle), turn / 180).otherwise(0.0)).withColumn("more", F.when(s1 - s0 >= gain, (s1 - s0) / 20).otherwise(0.0))
    rows = rows.withColumn("score", F.col("turn") + F.col("more"))
    peak = F.max("score").over(w.rowsBetween(-2, 2))
    kick = rows.withColumn("peak", peak).where((F.col("score") > 0) & (F.col("score") == F.col("peak")) & (F.col("d") <= kick_radius)).select("match_id", "grid_t", "who", "near.team", "bx", "by", F.lit("kick").alias("kind"))
    found = dwell.unionByName(kick).where(exprs.in_bounds(F.col("bx"), F.col("by"), 1.0))
    first = keep(found.groupBy("match_id", "who", "grid_t").agg(F.min(F.struct("kind", "team", "bx", "by")).alias("s")))
    kept = ts.debounce(first, ["match_id", "who"], "grid_t", refractory)
    return first.join(kept, ["match_id", "who", "grid_t"]).select("match_id", F.col("grid_t").alias("t"), F.col("who").alias("track_id"), "s.team", F.col("s.bx").alias("x"), F.col("s.by").alias("y"), "s.kind")


def passes(touched: DataFrame, segments: DataFrame, longest: float = 4.0, shortest: float = 3.0) -> DataFrame:
    """Consecutive touches of two players with no interruption between them; complete when of one team."""
    w = Window.partitionBy("match_id").orderBy("t", "track_id")
    pairs = touched.withColumns({f"to_{c}": F.lead(c).over(w) for c in ("t", "track_id", "team", "x", "y")}).where(
        (F.col("to_track_id") != F.col("track_id")) & (F.col("to_t") > F.col("t")) & (F.col("to_t") - F.col("t") <= longest) & (F.hypot(F.col("to_x") - F.col("x"), F.col("to_y") - F.col("y")) > shortest))
    stops = segments.where(exprs.is_interrupt(F.col("state"))).select("match_id", "start_s", "end_s")
    spread = pairs.withColumn("cell", F.explode(F.sequence(F.floor(F.col("t") / 10).cast("long"), F.floor(F.col("to_t") / 10).cast("long"))))
    marks = stops.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_s") / 10).cast("long"), F.floor(F.col("end_s") / 10).cast("long"))))
    broken = spread.join(marks, ["match_id", "cell"]).where("start_s <= to_t AND end_s > t").select("match_id", "t", "track_id").distinct()
    return pairs.join(broken, ["match_id", "t", "track_id"], "left_anti").withColumn("complete", F.col("team") == F.col("to_team"))


def possession(
    near: DataFrame, touched: DataFrame, segments: DataFrame, every: int = 5, timeout: float = 10.0, contested: float = 1.5, keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(match_id, t, code): the team of the last touch, -1 unknown, -2 contested, -3 out of play; two samples a second."""
    samples = near.where(F.col("g") % every == 0).select("match_id", F.col("grid_t").alias("t"), ((F.col("d0") <= contested) & (F.col("d1") <= contested)).alias("both"))
    rows = ts.asof_each(samples, _last_before(touched.select("match_id", "t", "team"), "t", segments), MATCH, "t", keep)
    stale = F.col("touch.team").isNull() | (F.col("t") - F.col("touch.t") > timeout) | (F.coalesce(F.col("stop.stopped"), F.lit(-1e9)) > F.col("touch.t"))
    code = F.when(F.coalesce(F.col("seg.state"), F.lit("in_play")) != "in_play", -3).when(stale, -1).when(F.col("both"), -2).otherwise(F.col("touch.team"))
    return rows.select("match_id", "t", code.cast("int").alias("code"))


def _last_before(touched: DataFrame, t: str, segments: DataFrame) -> dict[str, tuple[DataFrame, str, bool]]:
    """What ``ts.asof_each`` looks up: the last touch, the state, which before the first segment is the first's, and the last stop of play."""
    stops = segments.where(exprs.is_interrupt(F.col("state"))).select("match_id", F.col("end_s").alias("stopped"))
    return {"touch": (touched, t, False), "seg": (segments.select("match_id", "start_s", "state"), "start_s", True), "stop": (stops, "stopped", False)}


def team_stats(owned: DataFrame, passed: DataFrame) -> DataFrame:
    """Possession share of known samples (null when there are none), passes and their accuracy."""
    known = F.count_if(F.col("code") >= 0)
    share = lambda n: F.round(100.0 * F.count_if(F.col("code") == n) / F.nullif(known, F.lit(0)), 1)
    poss = owned.groupBy("match_id").agg(share(0).alias("a"), share(1).alias("b")).select("match_id", F.explode(F.array(F.struct(F.lit(0).alias("team"), F.col("a").alias("possession_pct")), F.struct(F.lit(1).alias("team"), F.col("b").alias("possession_pct")))).alias("s")).select("match_id", "s.*")
    made = passed.groupBy("match_id", "team").agg(F.count(F.lit(1)).alias("passes"), F.round(100.0 * F.count_if("complete") / F.count(F.lit(1)), 1).alias("pass_accuracy"))
    return poss.join(made, ["match_id", "team"], "left").fillna(0, ["passes"])


def progression(ball: DataFrame, owned: DataFrame, signs: DataFrame, hz: float = HZ, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(match_id, t, team, metres): how far each grid step of the ball went towards the goal of the team in possession's opponent."""
    moving = ball.where("vx IS NOT NULL").select("match_id", F.col("grid_t").alias("t"), "vx")
    held = ts.asof_backward(moving, owned.select("match_id", F.col("t").alias("own_t"), "code"), MATCH, "t", "own_t", "own", keep=keep)
    rows = held.select("match_id", "t", "vx", F.col("own.code").alias("team")).where("team >= 0")
    return with_sign(rows, signs, "t").select("match_id", "t", "team", (F.greatest(F.lit(0.0), F.col("vx") * F.col("sign")) / hz).alias("metres"))


def momentum(
    owned: DataFrame, shots: DataFrame, progress: DataFrame | None = None, bin_s: float = 60.0, alpha: float = 0.4, shot_metres: float = 15.0, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """(match_id, bin, possession_pct, momentum) for every minute: the balance as an average scaled to its largest swing.

    The balance is of shots and, with ``progress`` (match_id, t, team, metres), of metres, ``shot_metres`` of them a shot.
    ``keep`` is applied to the sums of each minute, which are used twice.
    """
    side = F.when(F.col("team") == 0, 1.0).otherwise(-1.0)
    moves = shots.select("match_id", "t", side.alias("balance"))
    if progress is not None:
        moves = moves.unionByName(progress.select("match_id", "t", (side * F.col("metres") / shot_metres).alias("balance")))
    rows = owned.select("match_id", F.floor(F.col("t") / bin_s).alias("bin"), "code", F.lit(0.0).alias("balance")).unionByName(
        moves.select("match_id", F.floor(F.col("t") / bin_s).alias("bin"), F.lit(-1).alias("code"), "balance"))
    minutes = keep(rows.groupBy("match_id", "bin").agg(F.count_if(F.col("code") == 0).alias("home"), F.count_if(F.col("code") >= 0).alias("known"), F.sum("balance").alias("balance")))
    bins = ts.dense_bins(minutes, MATCH, "bin", F.max("bin") + 1, {c: F.sum(c) for c in ("home", "known", "balance")})
    whole = bins.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("bin", "home", "known", "balance"))).alias("s"))
    acc = ts.ema(F.transform("s", lambda x: x["balance"].cast("double")), alpha)
    whole = whole.withColumn("acc", acc).withColumn("top", F.array_max(F.transform("acc", F.abs)))
    z = whole.select("match_id", "top", F.explode(F.arrays_zip("s", "acc")).alias("z"))
    return z.select("match_id", F.col("z.s.bin").alias("bin"), F.round(100.0 * F.col("z.s.home") / F.nullif(F.col("z.s.known"), F.lit(0)), 1).alias("possession_pct"), F.when(F.col("top") > 1e-9, F.col("z.acc") / F.col("top")).otherwise(0.0).alias("momentum"))


# --- goals, shots, set pieces -------------------------------------------------------------------------------------


def judge_goals(candidates: DataFrame, least: float = 0.7, rejected: float = 0.59, refuted: float = 0.35, most: float = 0.98) -> DataFrame:
    """Candidates with ``confidence``, ``corroborated`` and ``verdict`` (goal, shot or chance).

    Columns: base, strong and reached_mouth booleans, kickoff ("players", "ball_only" or null), have_tracks,
    peak (strength of a crowd peak or null), spread_ratio (of the scoring team, below 0.75 is a celebration),
    independent (other signals that agree) and reappeared (the ball was back in play far from the goal).
    """
    celebrated = F.coalesce(F.col("spread_ratio") < 0.75, F.lit(False))
    players, ball_only = F.coalesce(F.col("kickoff") == "players", F.lit(False)), F.coalesce(F.col("kickoff") == "ball_only", F.lit(False))
    heard = F.col("peak").isNotNull()
    bonus = F.when(players, 0.20).when(ball_only, 0.05).otherwise(0.0) + F.when(heard, 0.17).otherwise(0.0) + F.when(celebrated, 0.08).otherwise(0.0)
    signals = F.col("independent") + heard.cast("int") + celebrated.cast("int")
    backed = F.when(F.col("strong"), (signals >= 2) | players | (ball_only & ~F.col("have_tracks")) | heard).otherwise(players & (signals >= 3)) & ~F.col("reappeared")
    score = F.least(F.lit(most), F.when(F.col("reappeared"), F.least(F.col("base") + bonus, F.lit(refuted))).otherwise(F.col("base") + bonus))
    goal = F.col("corroborated") & (F.col("confidence") >= least - 1e-9)
    rows = candidates.withColumn("corroborated", backed).withColumn("confidence", score)
    rows = rows.withColumn("verdict", F.when(goal, "goal").when(F.col("strong") | F.col("reached_mouth"), "shot").otherwise("chance"))
    return rows.withColumn("confidence", F.when(F.col("verdict") == "goal", F.col("confidence")).otherwise(F.least("confidence", F.lit(rejected))))


def shots(
    touched: DataFrame, ball: DataFrame, signs: DataFrame, goals: DataFrame, slowest: float = 10.0, launch_s: float = 0.6, window_s: float = 3.0, half_length: float = 52.5, mouth: float = 3.66,
    inferred_s: float = 8.0, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """(match_id, t, team, track_id, speed, on_target, goal): the ball leaves a touch fast towards the goal and gets near it.

    A goal belongs to the first touch of its attackers in the ``window_s`` before it, however slow; a goal that none
    claims gives a shot of their last touch within ``inferred_s``, or of the team. ``keep`` is applied to the ball's way
    after each touch, which three steps use.
    """
    launched = with_sign(touched, signs, "t").withColumn("until", F.col("t") + window_s).withColumnsRenamed({"x": "tx", "y": "ty"})
    flight = ts.range_join(ball.where("visible").select("match_id", "grid_t", "x", "y", "vx", "speed"), launched, MATCH, "grid_t", "t", "until", window_s, closed=True, nulls=False)
    along = F.col("vx") * F.col("sign")
    depth = F.col("x") * F.col("sign")
    flown = keep(flight.groupBy("match_id", "t", "team", "track_id", "sign").agg(
        F.max(F.when((F.col("grid_t") <= F.col("t") + launch_s) & (along > 0), F.col("speed"))).alias("speed"), F.max(depth).alias("depth"),
        F.min(F.when(depth >= half_length - 5.5, F.abs(F.col("y")))).alias("off_axis")))
    goal = goals.select("match_id", F.col("t").alias("goal_t"), F.when(F.col("side") == "right", 1).otherwise(-1).alias("sign"))
    linked = flown.join(goal, ["match_id", "sign"]).where(F.col("goal_t").between(F.col("t"), F.col("t") + window_s))
    claimed = linked.groupBy("match_id", "goal_t", "sign").agg(F.min(F.struct("t", "track_id")).alias("s"))
    scored = claimed.select("match_id", "s.t", "s.track_id", "sign", F.lit(True).alias("goal")).distinct()
    out = flown.join(scored, ["match_id", "t", "track_id", "sign"], "left").withColumn("goal", F.coalesce("goal", F.lit(False)))
    near = F.coalesce((F.col("speed") >= slowest) & (F.col("depth") >= half_length - 5.5) & (F.col("off_axis") <= 9.16), F.lit(False))
    on_target = F.col("goal") | F.coalesce(F.col("off_axis") <= mouth + 1.5, F.lit(False))
    found = out.where(near | F.col("goal")).select("match_id", "t", "team", "track_id", "speed", on_target.alias("on_target"), "goal")
    return found.unionByName(inferred_shots(touched, goal.join(claimed.select("match_id", "goal_t", "sign"), ["match_id", "goal_t", "sign"], "left_anti"), signs, inferred_s))


def flight_shots(
    flown: DataFrame, ball: DataFrame, kin: DataFrame, signs: DataFrame, goals: DataFrame, fast: float = 10.0, half_length: float = 52.5, mouth: float = 3.66, hz: float = HZ,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """(match_id, type, t, t_end, side, team, track_id, keeper_id, outcome, speed): shots, chances and saves from the ball's flights.

    A flight of two samples or more counts when it starts in front of the goal it heads for, its line meets the goal
    line near the goal, and it passes the line, ends near the goal or is lost there. It is a shot when the line meets
    the goal or a goal follows, else a chance. An unscored shot that is turned or stopped in front of the goal, beside
    someone who stays near that line, is a save too. ``flown`` are ``flights`` of ``ball`` (match_id, t, x, y, vx, vy).
    ``keep`` is applied to the flights before each join that uses them twice: the plan holds them twelve times otherwise.
    """
    length, height = 2 * half_length, 2 * mouth
    w = Window.partitionBy("match_id").orderBy("t")
    speed, five = F.coalesce(F.hypot("vx", "vy"), F.lit(0.0)), w.rowsBetween(1, 5)
    samples = ball.withColumn("v", speed).withColumns({
        "prev_t": F.lag("t").over(w), "next_t": F.lead("t").over(w), "vx_lo": F.min("vx").over(five), "vx_hi": F.max("vx").over(five), "v_lo": F.min("v").over(five)}).withColumnRenamed("t", "at")
    f = Window.partitionBy("match_id").orderBy("t_start")
    spans = flown.withColumn("next_start", F.coalesce(F.lead("t_start").over(f), F.lit(float("inf")))).where("n >= 2")
    spans = spans.withColumn("until", F.greatest(F.col("t_end") + 1e-6, F.least(F.col("t_end") + 1.5, "next_start")))
    own = ts.range_join(samples, spans, MATCH, "at", "t_start", "until", 2.0, nulls=False)
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("match_id", "t_start").orderBy("at")))
    flying = F.col("at") <= F.col("t_end")
    last = lambda c: F.max_by(c, F.when(flying, F.col("at"))).alias(f"end_{c}")
    rows = own.groupBy("match_id", "t_start", "t_end", "peak").agg(
        F.avg(F.when((F.col("place") <= 4) & flying, F.col("vx"))).alias("mvx"), F.avg(F.when((F.col("place") <= 4) & flying, F.col("vy"))).alias("mvy"),
        F.min_by("x", "at").alias("x0"), F.min_by("y", "at").alias("y0"), F.min_by("prev_t", "at").alias("prev_t"), F.max("x").alias("x_hi"), F.min("x").alias("x_lo"),
        *[last(c) for c in ("x", "y", "next_t", "vx_lo", "vx_hi", "v_lo")]).where(F.abs("mvx") >= 1e-6)
    sign = F.when(F.col("mvx") > 0, 1).otherwise(-1)
    rows = rows.withColumns({"sign": sign, "side": F.when(sign > 0, "right").otherwise("left"), "origin": half_length - sign * F.col("x0"), "end_m": half_length - sign * F.col("end_x")})
    rows = rows.withColumn("y_line", F.col("y0") + F.col("mvy") / F.col("mvx") * (F.col("sign") * half_length - F.col("x0")))
    beyond = F.when(F.col("sign") > 0, F.col("x_hi") > half_length).otherwise(F.col("x_lo") < -half_length)
    lost = F.coalesce(F.col("end_next_t") - F.col("t_end") > 1.25, F.lit(True)) & (F.col("end_m") <= length / 4)
    rows = rows.withColumns({"beyond": beyond, "on_target": F.abs("y_line") <= mouth + 0.06 * height}).where(
        F.col("origin").between(0, 0.65 * length) & (F.abs("y_line") <= 2.5 * height) & (F.col("beyond") | lost | ((F.col("end_m") <= 0.12 * length) & (F.abs("end_y") <= 1.5 * height))))
    rows = rows.withColumn("t", F.when(F.col("t_start") - F.col("prev_t") <= 0.3, F.col("prev_t")).otherwise(F.col("t_start")))
    rows = keep(rows)
    scored = rows.join(goals.select("match_id", "side", F.col("t").alias("goal_t")), ["match_id", "side"]).where("goal_t BETWEEN t - 0.5 AND t_end + 1.5").select("match_id", "t_start", F.lit(True).alias("goal")).distinct()
    rows = keep(with_sign(rows.join(scored, ["match_id", "t_start"], "left").fillna(False, ["goal"]), signs, "t", "left", "sign"))

    def beside(at: str, x: str, y: str, name: str, test: Column) -> DataFrame:
        """(match_id, t_start, name): the nearest player within four metres of a place at a time, by the grid."""
        asked = rows.select("match_id", "t_start", F.col("team").alias("attackers"), F.round(F.col(at) * hz).cast("long").alias("g"), F.col(x).alias("px"), F.col(y).alias("py"))
        away = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
        near = asked.join(kin.select("match_id", "g", "track_id", "team", "x", "y"), ["match_id", "g"]).where(test & (away <= 4.0))
        return near.groupBy("match_id", "t_start").agg(F.min(F.struct(away.alias("d"), "track_id", "team"))["track_id"].alias(name))

    ours, theirs = F.col("attackers").isNull() | (F.col("team") == F.col("attackers")), F.col("attackers").isNull() | (F.col("team") != F.col("attackers"))
    rows = keep(rows.join(beside("t", "x0", "y0", "track_id", ours), ["match_id", "t_start"], "left"))
    back = F.when(F.col("sign") > 0, F.col("end_vx_lo") < 0).otherwise(F.col("end_vx_hi") > 0)
    stopped = F.coalesce(back, F.lit(False)) | F.coalesce(F.col("end_v_lo") < fast / 3, F.lit(True))
    saved = ~F.col("goal") & F.col("on_target") & ~F.col("beyond") & (F.col("end_m") <= 0.12 * length) & stopped
    asked = rows.where(saved).select("match_id", "t_start", "t_end", "sign").join(beside("t_end", "end_x", "end_y", "keeper_id", theirs), ["match_id", "t_start"])
    around = asked.withColumns({"since": F.col("t_end") - 120, "till": F.col("t_end") + 120}).withColumnRenamed("keeper_id", "track_id")
    stays = ts.range_join(kin.select("match_id", "track_id", "grid_t", "x"), around, ["match_id", "track_id"], "grid_t", "since", "till", 240.0, closed=True, nulls=False)
    keepers = stays.groupBy("match_id", "t_start", F.col("track_id").alias("keeper_id")).agg(
        F.avg((F.abs(half_length - F.col("sign") * F.col("x")) <= 0.15 * length).cast("double")).alias("share")).where("share >= 0.6").drop("share")
    rows = keep(rows.join(keepers, ["match_id", "t_start"], "left"))
    outcome = F.when(F.col("goal"), "goal").when(F.col("keeper_id").isNotNull(), "saved").when(F.col("beyond") & ~F.col("on_target"), "wide").when(F.col("on_target"), "on_target").otherwise("wide")
    rows = rows.withColumn("outcome", outcome).withColumn("type", F.when(F.col("on_target") | F.col("goal"), "shot").otherwise("chance"))
    columns = ["match_id", "type", "t", "t_end", "side", "team", "track_id", "keeper_id", "outcome", F.col("peak").alias("speed")]
    saves = rows.where("keeper_id IS NOT NULL").withColumns({"type": F.lit("save"), "t": F.col("t_end"), "team": 1 - F.col("team")})
    return rows.select(*columns).unionByName(saves.select(*columns))


def inferred_shots(touched: DataFrame, goals: DataFrame, signs: DataFrame, within: float = 8.0) -> DataFrame:
    """Shots of goals (match_id, goal_t, sign) that no touch claims: of the scorers' last touch within ``within`` seconds, or of the team."""
    of_team = with_sign(goals, signs, "goal_t", by="sign")
    last = ts.asof_backward(of_team, touched.select("match_id", "team", F.col("t").alias("touch_t"), "track_id"), ["match_id", "team"], "goal_t", "touch_t", "touch")
    fresh = F.col("goal_t") - F.col("touch.touch_t") <= within
    return last.select(
        "match_id", F.when(fresh, F.col("touch.touch_t")).otherwise(F.col("goal_t")).alias("t"), "team", F.when(fresh, F.col("touch.track_id")).alias("track_id"),
        F.lit(0.0).alias("speed"), F.lit(True).alias("on_target"), F.lit(True).alias("goal"))


# --- events -------------------------------------------------------------------------------------------------------


def sprint_events(kin: DataFrame, focus: Column | None = None, fast: float = 7.0, focus_fast: float = 6.0, shortest: float = 1.5, hz: float = HZ) -> DataFrame:
    limit = F.when(focus, focus_fast).otherwise(fast) if focus is not None else F.lit(fast)
    keys = ["match_id", "track_id", "team"]
    runs = ts.islands_by_value(kin, keys, ["g"], F.col("speed") > limit).where(F.col("speed") > limit)
    return runs.groupBy(*keys, "island").agg(F.min("grid_t").alias("t_start"), F.max("grid_t").alias("t_end"), F.max_by("grid_t", "speed").alias("t"), F.max("speed").alias("peak"), F.sum("step").alias("metres")).where(
        F.col("t_end") - F.col("t_start") + 1 / hz >= shortest).select("match_id", F.lit("sprint").alias("type"), "t", "t_start", "t_end", "team", "track_id", F.least(F.lit(0.9), 0.5 + (F.col("peak") - fast) / 10).alias("confidence"))


def turnover_events(owned: DataFrame) -> DataFrame:
    w = Window.partitionBy("match_id").orderBy("t")
    team = F.when(F.col("code") >= 0, F.col("code"))
    rows = owned.withColumn("team", team).withColumn("was", F.last(team, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.lead(team).over(w))
    return rows.where((F.col("team") != F.col("was")) & F.coalesce(F.col("next") == F.col("team"), F.lit(True))).select("match_id", F.lit("turnover").alias("type"), "t", F.col("t").alias("t_start"), F.col("t").alias("t_end"), "team", F.lit(None).cast("int").alias("track_id"), F.lit(0.5).alias("confidence"))


def held_turnovers(owners: DataFrame, memory: int, hold: int) -> DataFrame:
    """(match_id, g, team, track_id, lost_by): play went to the other team, which nobody took back within ``hold`` steps.

    ``owners`` is (match_id, g, track_id, team, in_play) for each grid step, team null when nobody has the ball. The
    team before must have had it within ``memory`` steps.
    """
    w = Window.partitionBy("match_id").orderBy("g")
    had = F.when(F.col("team").isNotNull(), F.struct("g", "track_id", "team"))
    rows = owners.withColumn("was", F.last(had, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    ahead = w.rangeBetween(0, hold - 1)
    alone = (F.min("team").over(ahead) == F.col("team")) & (F.max("team").over(ahead) == F.col("team"))
    taken = (F.col("was.team") != F.col("team")) & (F.col("g") - F.col("was.g") <= memory) & F.col("in_play")
    return rows.withColumn("_held", taken & alone).where("_held").select("match_id", "g", "team", "track_id", F.col("was.team").alias("lost_by"), F.col("was.track_id").alias("lost_by_track"))


def dribbles(owners: DataFrame, longest_gap: int, metres: float = 15.0, pressure: float = 3.0) -> DataFrame:
    """(match_id, track_id, team, g_start, g_end, metres, closest, g): spells of one player far enough and under pressure.

    ``owners`` is (match_id, g, track_id, team, x, y, opponent_m), track_id null when nobody has the ball: gaps of up to
    ``longest_gap`` steps belong to a spell, another player ends it. ``opponent_m`` is the nearest opponent's distance.
    """
    w = Window.partitionBy("match_id").orderBy("g")
    rows = owners.where("track_id IS NOT NULL")
    new = (F.col("track_id") != F.lag("track_id").over(w)) | (F.col("g") - F.lag("g").over(w) > longest_gap + 1)
    rows = rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("spell", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy("match_id", "spell").orderBy("g")
    rows = rows.withColumn("_step", F.hypot(F.col("x") - F.lag("x").over(s), F.col("y") - F.lag("y").over(s)))
    spells = rows.groupBy("match_id", "spell", "track_id", "team").agg(
        F.min("g").alias("g_start"), F.max("g").alias("g_end"), F.sum("_step").alias("metres"), F.min("opponent_m").alias("closest"), F.min(F.struct("opponent_m", "g"))["g"].alias("g"))
    return spells.where((F.col("g_end") > F.col("g_start")) & (F.col("metres") >= metres) & (F.col("closest") <= pressure)).drop("spell")


def flights(ball: DataFrame, fast: float, turn: float = 30.0, kick: float = 1.35, longest_gap: float = 0.3) -> DataFrame:
    """(match_id, t_start, t_end, n, peak): runs of a fast ball that keep their direction and aren't kicked again.

    A flight ends when the ball is slower than ``fast``, when its heading differs by more than ``turn`` degrees from the
    flight's first, when two samples are further apart than ``longest_gap``, or when it becomes ``kick`` times faster
    than the slowest of the last three samples. ``ball`` is (match_id, t, vx, vy). Only fast samples of one match meet
    in a task, since the first heading has to be carried along.
    """

    def run(match: pd.DataFrame) -> pd.DataFrame:
        match = match.sort_values("t")
        t, v = match["t"].to_numpy(float), match["vx"].to_numpy(float) + 1j * match["vy"].to_numpy(float)
        speed, first, cuts = np.abs(v), 0, [0]
        for i in range(1, len(t)):
            turned = abs(np.degrees(np.angle(v[i] / v[first]))) > turn
            kicked = i - first >= 2 and speed[i] > kick * speed[max(first, i - 3):i].min()
            if turned or kicked or t[i] - t[i - 1] > longest_gap or match["slow_before"].iloc[i]:
                cuts.append(first := i)
        ends = np.append(cuts[1:], len(t))
        return pd.DataFrame({"match_id": match["match_id"].iloc[0], "t_start": t[cuts], "t_end": t[ends - 1], "n": ends - cuts, "peak": np.maximum.reduceat(speed, cuts)})

    w = Window.partitionBy("match_id").orderBy("t")
    speed = F.coalesce(F.hypot("vx", "vy"), F.lit(0.0))
    rows = ball.withColumn("slow_before", F.coalesce(F.lag(speed).over(w) < fast, F.lit(True))).where(speed >= fast)
    kind = dict(ball.dtypes)["match_id"]
    return rows.select("match_id", "t", "vx", "vy", "slow_before").groupBy("match_id").applyInPandas(run, f"match_id {kind}, t_start double, t_end double, n int, peak double")


def review_candidates(samples: DataFrame, pre: float, post: float, most: int = 3, joined: float = 1.0) -> DataFrame:
    """(match_id, t_start, t_end): the few strongest moments of a match without events, apart, padded and joined.

    Strength is three quarters speed, scaled to the match's range, and one quarter the change of direction over pi. Each
    of ``most`` rounds takes the best moment (ties: the later) that is apart from those before by an aggregation, so no
    match is gathered into one row. ``samples``: (match_id, t, speed, turn).
    """
    span = samples.groupBy("match_id").agg(F.min("speed").alias("lo"), F.max("speed").alias("hi"))
    score = 0.75 * ((F.col("speed") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)) + 0.25 * F.coalesce(F.col("turn"), F.lit(0.0)) / (math.pi + 1e-9)
    rows = samples.join(span, "match_id").select("match_id", "t", F.struct(score.alias("score"), "t").alias("moment"))
    apart = max(8.0, pre + post)
    folded = rows.groupBy("match_id").agg(F.max("moment").alias("best")).where("best.score > 0").select("match_id", F.array("best.t").alias("kept"))
    for _ in range(most - 1):
        free = F.forall("kept", lambda k: F.abs(k - F.col("t")) >= apart)
        folded = rows.join(folded, "match_id").groupBy("match_id").agg(F.first("kept").alias("kept"), F.max(F.when(free, F.col("moment"))).alias("best")).select(
            "match_id", F.when(F.col("best").isNull(), F.col("kept")).otherwise(F.array_append("kept", F.col("best.t"))).alias("kept"))
    spans = folded.select("match_id", F.explode("kept").alias("t")).select("match_id", F.greatest(F.lit(0.0), F.col("t") - pre).alias("t_start"), (F.col("t") + post).alias("t_end"))
    return ts.merge_intervals(spans, MATCH, "t_start", "t_end", joined).select("match_id", "t_start", "t_end")


def area_entries(
    near: DataFrame, signs: DataFrame, owners: DataFrame, existing: DataFrame, quiet: float = 8.0, depth: float = 16.5, half_width: float = 20.16, slowest: float = 2.0, reach: float = 4.0,
    half_length: float = 52.5, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Chances: the attackers bring the ball into a penalty area, in play, with a top speed of ``slowest`` within two steps.

    ``owners`` (match_id, g, team, in_play) says who has the ball; ``existing`` (match_id, t, sign) are attempts on a goal,
    which stand for entries from 6 s before to 2 s after them. After each chance kept that area is ``quiet``; entries that
    fail a test make none. The nearest player is named if of the attackers and within ``reach``. ``keep`` is applied to
    the entries before each step that uses them twice.
    """
    inside = (F.abs(F.col("bx")) >= half_length - depth) & (F.abs(F.col("by")) <= half_width) & (F.abs(F.col("bx")) <= half_length)
    w = Window.partitionBy("match_id").orderBy("g")
    sign = F.when(F.col("bx") > 0, 1).otherwise(-1)
    rows = near.withColumns({"sign": sign, "inside": inside, "top": F.max("ball_speed").over(w.rangeBetween(-2, 2))})
    stayed = F.lag("inside").over(w) & (F.lag("sign").over(w) == F.col("sign")) & (F.col("g") - F.lag("g").over(w) == 1)
    rows = rows.withColumn("was", F.coalesce(stayed, F.lit(False))).where(F.col("inside") & ~F.col("was") & (F.col("g") > 0) & (F.col("top") >= slowest))
    edges = with_sign(rows.select("match_id", "g", "grid_t", "sign", "near"), signs, "grid_t", by="sign")
    controlled = keep(edges.join(owners.where("in_play").select("match_id", "g", "team"), ["match_id", "g", "team"]))
    around = existing.select("match_id", "sign", F.col("t").alias("made_t"))
    free = keep(controlled.join(ts.range_join(around, controlled.select("match_id", "sign", "g", (F.col("grid_t") - 2.0).alias("lo"), (F.col("grid_t") + 6.0).alias("hi")), ["match_id", "sign"], "made_t", "lo", "hi", 8.0, closed=True, nulls=False)
                           .select("match_id", "sign", "g").distinct(), ["match_id", "sign", "g"], "left_anti"))
    kept = ts.debounce(free, ["match_id", "sign"], "grid_t", quiet)
    carrier = F.when((F.col("near.team") == F.col("team")) & (F.col("near.d") <= reach), F.col("near.track_id"))
    at = (F.col("grid_t").alias("t"), F.col("grid_t").alias("t_start"), F.col("grid_t").alias("t_end"))
    return kept.join(free, ["match_id", "sign", "grid_t"]).select("match_id", F.lit("chance").alias("type"), *at, "team", carrier.cast("int").alias("track_id"), F.lit(0.5).alias("confidence"))


def merge_events(events: DataFrame, gap: float = 3.0) -> DataFrame:
    """Same-type events of one team that follow each other: the most confident represents them, with the widest window."""
    rows = ts.islands_by_gap(events.withColumn("_team", F.coalesce("team", F.lit(-1))), ["match_id", "type", "_team"], "t", gap)
    best = F.max_by(F.struct("t", "team", "track_id", "confidence"), F.struct("confidence", -F.col("t"))).alias("b")
    return rows.groupBy("match_id", "type", "_team", "island").agg(best, F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.count(F.lit(1)).alias("merged")).select("match_id", "type", "b.*", "t_start", "t_end", "merged")


def score_events(events: DataFrame, peaks: DataFrame | None = None, window: float = 4.0, bonus: float = 0.15, pre: float = 4.0, longest_post: float = 10.0, where: DataFrame | None = None, focus: int | None = None) -> DataFrame:
    """Numbered events with excitement and clip window; ``peaks`` (match_id, peak_t, strength) adds the strongest peak nearby.

    ``where`` (match_id, t, type, x) adds up to 0.1 the nearer the event is to a goal line, in metres from the centre
    spot; ``focus`` adds 0.15 to the events of a player.
    """
    scored = events.withColumn("excitement", exprs.base_excitement(F.col("type"), F.lit(False), F.lit(None).cast("string")))
    if peaks is not None:
        near = ts.range_join(peaks, events.select("match_id", "type", "t", (F.col("t") - window).alias("lo"), (F.col("t") + window).alias("hi")), MATCH, "peak_t", "lo", "hi", 2 * window, closed=True)
        best = near.groupBy("match_id", "type", "t").agg(F.max("strength").alias("strength"))
        scored = scored.join(best, ["match_id", "type", "t"], "left").withColumn("excitement", F.col("excitement") + bonus * F.coalesce("strength", F.lit(0.0))).drop("strength")
    if where is not None:
        placed = where.groupBy("match_id", "t", "type").agg(F.max(F.abs("x")).alias("_x"))
        closeness = F.greatest(F.lit(0.0), 1.0 - F.abs(52.5 - F.col("_x")) / (0.35 * 105.0))
        scored = scored.join(placed, ["match_id", "t", "type"], "left").withColumn("excitement", F.col("excitement") + 0.10 * F.coalesce(closeness, F.lit(0.0))).drop("_x")
    if focus is not None:
        scored = scored.withColumn("excitement", F.col("excitement") + F.when(F.col("track_id") == focus, 0.15).otherwise(0.0))
    number = F.row_number().over(Window.partitionBy("match_id").orderBy("t", "type", "team"))
    return scored.withColumn("excitement", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "excitement"))).withColumn("t_start", F.greatest(F.lit(0.0), F.least("t_start", F.col("t") - pre))).withColumn(
        "t_end", F.least(F.greatest("t_end", F.col("t") + 1.0), F.col("t") + longest_post)).withColumn("event_id", F.format_string("ev_%04d", number))


def plan_reel(events: DataFrame, target_s: float, must: tuple[str, ...] = ("goal",), joined: float = 1.0) -> DataFrame:
    """(match_id, clip, start_s, end_s, event_ids): events by excitement while the union of their windows fits the target; must-have types first.

    Selection looks at what is chosen already, so it runs over one match's ranked events, which are few.
    """

    def union(spans: list) -> list:
        out: list = []
        for a, b, ids in sorted(spans):
            if out and a <= out[-1][1] + joined:
                out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + ids)
            else:
                out.append((a, b, ids))
        return out

    def run(match: pd.DataFrame) -> pd.DataFrame:
        match = match.assign(first=~match["type"].isin(must)).sort_values(["first", "excitement", "confidence", "t"], ascending=[True, False, False, True])
        chosen: list = []
        for a, b, e, optional in zip(match["t_start"], match["t_end"], match["event_id"], match["first"]):
            with_it = [*chosen, (a, b, [e])]
            if not optional or sum(y - x for x, y, _ in union(with_it)) <= target_s:
                chosen = with_it
        return pd.DataFrame([(match["match_id"].iloc[0], i, a, b, ids) for i, (a, b, ids) in enumerate(union(chosen))], columns=["match_id", "clip", "start_s", "end_s", "event_ids"])

    return events.groupBy("match_id").applyInPandas(run, f"match_id {dict(events.dtypes)['match_id']}, clip int, start_s double, end_s double, event_ids array<string>")


def grid_owners(near: DataFrame, touched: DataFrame, segments: DataFrame, kin: DataFrame, timeout: float = 10.0, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(match_id, g, track_id, team, in_play, x, y, opponent_m): who has the ball at each grid step, null when nobody does.

    The player of the last touch, while it is fresh and no stop of play came between.
    """
    steps = near.select("match_id", "g", F.col("grid_t").alias("t"))
    rows = ts.asof_each(steps, _last_before(touched.select("match_id", F.col("t").alias("touch_t"), "track_id", "team"), "touch_t", segments), MATCH, "t", keep)
    fresh = (F.col("t") - F.col("touch.touch_t") <= timeout) & (F.coalesce(F.col("stop.stopped"), F.lit(-1e9)) <= F.col("touch.touch_t"))
    in_play = F.coalesce(F.col("seg.state"), F.lit("in_play")) == "in_play"
    owned = rows.select("match_id", "g", F.when(fresh, F.col("touch.track_id")).alias("track_id"), F.when(fresh, F.col("touch.team")).alias("team"), in_play.alias("in_play"))
    placed = owned.join(near.select("match_id", "g", "d0", "d1"), ["match_id", "g"], "left").join(kin.select("match_id", "g", "track_id", "x", "y"), ["match_id", "g", "track_id"], "left")
    return placed.select("match_id", "g", "track_id", "team", "in_play", "x", "y", F.when(F.col("team") == 0, F.col("d1")).when(F.col("team") == 1, F.col("d0")).alias("opponent_m"))


def analyse(
    samples: DataFrame, ball_raw: DataFrame, frame_width: float = 105.0, halves: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None,
    only: Sequence[str] | None = None, envelope: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The chain over samples (match_id, track_id, team, t, x, y) and raw ball detections (match_id, t, x, y), in metres.

    ``keep`` is applied to what several results share and to what as-of joins put in one: DataFrame.cache, or a function
    that writes and reads back. If it deals what it writes by match, and ``samples`` and ``ball_raw`` are dealt so, no sample
    is shuffled.
    ``halves`` (match_id, half_s) says when the teams change sides; without it they don't. ``envelope`` (match_id, t, rms)
    is the crowd's loudness. ``only`` names the results that are wanted; nothing else is built.
    """
    from pitchlake.operators import documents  # which builds on this module

    once, dealt, keep = functools.cache, keep, keep or (lambda df: df)
    kin = once(lambda: kinematics(samples, keep=keep))
    # one table of both balls where touches are asked for, else the filtered one
    untouched = {"kin", "ball", "segments", "signs", "goals", "goal_candidates", "set_pieces", "flight_shots", "player_stats"}
    both = once(lambda: keep(both_balls(filter_ball(ball_raw, frame_width, base_gate=6.0), ball_raw)))
    filtered = once(lambda: keep(filter_ball(ball_raw, frame_width, base_gate=6.0).drop("raw_count")) if only and untouched.issuperset(only) else both().where("NOT _raw").drop("_raw"))
    ball = once(lambda: ball_on_grid(filtered(), keep=keep))
    on_grid = lambda rows: rows.where("visible").select("match_id", F.col("grid_t").alias("t"), "x", "y")
    seen = once(lambda: on_grid(ball()))
    signs = once(lambda: keep(attack_signs(kin(), halves)))
    peaks = once(lambda: None if envelope is None else keep(broadcast.audio_peaks(envelope)))
    judged = once(lambda: keep(goals_of.goal_events(seen(), kin(), signs(), peaks(), keep=keep)))
    goals = once(lambda: judged().where("verdict = 'goal'").select("match_id", "t", "side", "confidence"))
    pieces = once(lambda: keep(restarts.set_pieces(on_grid(ball_on_grid(filtered())), frame_width=frame_width)))
    # read once each, so the grid is made anew and not written for them
    base_segments = once(lambda: keep(game_states(ball_on_grid(filtered()), keep=keep)))
    near = once(lambda: nearest_players(ball_on_grid(agreeing(both())), kin(), keep=keep))
    touched = once(lambda: keep(touches(near(), keep=keep)))

    def segments() -> DataFrame:
        """States with the set-up of corners and free kicks carved in."""
        setups = pieces().where("kind IN ('corner_kick', 'free_kick')").select("match_id", F.col("t_start").alias("w_start"), F.col("t").alias("w_end"), F.concat("kind", F.lit("_setup")).alias("w_state"))
        whole = overlay(base_segments().select("match_id", "start_s", "end_s", "state"), setups)
        return whole.withColumn("side", F.when(F.col("state").isin("restart_left", "restart_right"), F.substring_index("state", "_", -1)))

    passed = once(lambda: passes(touched(), base_segments()))
    made = once(lambda: keep(passed()))
    owned = once(lambda: keep(possession(near(), touched(), base_segments(), keep=dealt)))
    owners = once(lambda: keep(grid_owners(near(), touched(), base_segments(), kin(), keep=dealt)))
    shot = once(lambda: keep(shots(touched(), ball(), signs(), goals(), keep=keep)))
    flown = once(lambda: keep(flight_shots(keep(flights(with_velocity().select("match_id", "t", "vx", "vy"), 10.0)), with_velocity(), kin(), signs(), goals(), keep=keep)))
    with_velocity = once(lambda: ball().where("visible").select("match_id", F.col("grid_t").alias("t"), "x", "y", "vx", "vy"))
    dribbled = once(lambda: dribbles(owners(), round(0.5 * HZ)))
    turned = once(lambda: held_turnovers(owners().select("match_id", "g", "track_id", "team", "in_play"), round(3 * HZ), round(0.2 * HZ)))

    def attempts() -> DataFrame:
        """(match_id, t, sign): goals and their rejected candidates, shots, chances and saves, by the goal that they are at."""
        sign = F.when(F.col("side") == "right", 1).otherwise(-1).alias("sign")
        made = judged().select("match_id", "t", sign).unionByName(flown().select("match_id", "t", sign))
        return made.unionByName(with_sign(shot(), signs(), "t").select("match_id", "t", "sign"))

    def listed() -> DataFrame:
        nobody, at = F.lit(None).cast("int").alias("track_id"), (F.col("t").alias("t_start"), F.col("t").alias("t_end"))
        sign = F.when(F.col("side") == "right", 1).otherwise(-1)
        of_side = lambda rows: with_sign(rows.withColumn("sign", sign), signs(), "t", "left", by="sign")
        parts = [
            of_side(judged()).select("match_id", F.col("verdict").alias("type"), "t", *at, "team", nobody, "confidence"),
            shot().where("NOT goal").select("match_id", F.lit("shot").alias("type"), "t", *at, "team", "track_id", F.lit(0.6).alias("confidence")),
            flown().where("type = 'save'").select("match_id", "type", "t", *at, "team", F.col("keeper_id").cast("int").alias("track_id"), F.lit(0.5).alias("confidence")),
            of_side(pieces()).select("match_id", F.col("kind").alias("type"), "t", "t_start", F.col("t").alias("t_end"), "team", nobody, F.lit(0.6).alias("confidence")),
            sprint_events(kin()), area_entries(near(), signs(), owners(), attempts(), keep=keep),
            turned().select("match_id", F.lit("turnover").alias("type"), (F.col("g") / HZ).alias("t"), (F.col("g") / HZ).alias("t_start"), (F.col("g") / HZ).alias("t_end"), "team", "track_id", F.lit(0.5).alias("confidence")),
            dribbled().select("match_id", F.lit("dribble").alias("type"), (F.col("g") / HZ).alias("t"), (F.col("g_start") / HZ).alias("t_start"), (F.col("g_end") / HZ).alias("t_end"), "team", "track_id", F.lit(0.5).alias("confidence")),
        ]
        found = functools.reduce(DataFrame.unionByName, parts)
        if peaks() is None:
            return found
        fouls = broadcast.foul_candidates(peaks(), found, ball(), base_segments(), kin())
        return found.unionByName(fouls.select("match_id", F.lit("foul_candidate").alias("type"), "t", *at, F.lit(None).cast("int").alias("team"), nobody, "confidence"))

    results = {
        "flight_shots": flown, "kin": kin, "ball": ball, "segments": segments, "signs": signs, "touches": touched, "passes": passed, "possession": owned, "goals": goals, "goal_candidates": judged, "shots": shot,
        "set_pieces": pieces, "dribbles": dribbled, "turnovers": turned, "events": lambda: score_events(merge_events(keep(listed())), peaks()), "player_stats": lambda: player_stats(kin(), signs()),
        "team_document": lambda: documents.team_document(kin(), ball(), owned(), segments(), signs(), touched(), made(), shot(), goals(), pieces(), keep=dealt),
        "document_quality": lambda: documents.document_quality(kin(), ball(), owned(), touched()),
        "team_stats": lambda: team_stats(owned(), made()), "momentum": lambda: momentum(owned(), shot(), progression(ball(), owned(), signs(), keep=dealt), keep=keep),
    }
    return {name: results[name]() for name in only or results}
