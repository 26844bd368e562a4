"""One camera decision a frame: where to aim and how close, eased, cut, zoomed and held inside limits.

Four phases. ``setpoints`` finds what each frame should show, with joins on the frame grid: the ball and its lead, the players
engaged around it, the goal in reach, the place of a restart. ``planned`` folds a match's frames in order: moves between aims
are eased or, when the ball was lost and play is far away, cut; the zoom follows its wish down at once and up after a while;
the path is smoothed and held within speed and acceleration; the zoom then gives way under a smooth envelope until all that
must be seen is inside the crop. Positions are pixels of the frame.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators import timeseries as ts
from pitchlake.operators.camera import within_limits

MATCH = ["match_id"]


@dataclass(frozen=True)
class Style:
    """How a camera behaves; shares are of the frame's width unless said. Parameters of our own."""

    width: int = 1920
    height: int = 1080
    fps: float = 25.0
    base_zoom: float = 1.6
    least_zoom: float = 1.0
    most_zoom: float = 2.2
    lead_s: float = 0.35
    blend: float = 0.25  # of the engaged players
    action: float = 0.14
    lost_zoom: float = 0.8  # of the base zoom
    restart_zoom: float = 1.4
    fast_ball: float = 0.35  # a second
    fast_ball_zoom: float = 0.2
    threat: float = 0.30  # of the field's length
    threat_blend: float = 0.45
    infield: float = 0.06  # of the field's length
    margin: float = 0.08  # of the crop, around what must be seen
    hold_s: float = 1.5
    ease_s: float = 0.8
    jump: float = 0.08
    cut_jump: float = 0.45
    cut_lost_s: float = 3.0
    zoom_band: float = 0.08
    zoom_hold_s: float = 1.0
    zoom_rate: float = 0.12  # a second
    zoom_smooth_s: float = 0.6
    pan_smooth_s: float = 0.3
    pan_speed: float = 0.8  # crop widths a second
    pan_acceleration: float = 1.6  # and a second
    passes: int = 4


def frames_of(spans: DataFrame, ball: DataFrame, style: Style = Style()) -> DataFrame:
    """(match_id, frame, t, ball_x, ball_y) of the spans (match_id, start_s, end_s), with the ball (match_id, t, x, y) where it is seen.

    The ball's own grid gives the frames and its first and last point those before and after it, so that spans and ball
    meet by match alone: dealt by match over the same number of partitions, neither is shuffled.
    """
    n = F.greatest(F.lit(1), F.ceil((F.col("end_s") - F.col("start_s")) * style.fps - 1e-9))
    shifted = ball.join(spans.select("match_id", "start_s").hint("merge"), "match_id").select("match_id", (F.col("t") - F.col("start_s")).alias("t"), "x", "y")
    grid, w = ts.resample_grid(shifted, MATCH, "t", ["x", "y"], 1 / style.fps, 1.0, 0.1), Window.partitionBy("match_id").orderBy("g")
    grid = grid.select("match_id", "g", "x", "y", F.lag("g").over(w).isNull().alias("first"), F.lead("g").over(w).isNull().alias("last"))
    rows = spans.select("match_id", "start_s", (n - 1).alias("end")).join(grid.hint("merge"), "match_id", "left")
    low, high = F.when(F.col("first"), F.least(F.lit(0), "g")).otherwise(F.col("g")), F.when(F.col("last"), F.greatest("g", "end")).otherwise(F.col("g"))
    rows = rows.withColumn("frame", F.explode(F.sequence(F.coalesce(low, F.lit(0)), F.coalesce(high, "end")))).where("frame BETWEEN 0 AND end")
    seen = [F.when(F.col("frame") == F.col("g"), F.col(c)).alias(f"ball_{c}") for c in ("x", "y")]
    return rows.select("match_id", "frame", (F.col("start_s") + F.col("frame") / style.fps).alias("t"), *seen)


def _fit(style: Style, low_x: Column, high_x: Column, low_y: Column, high_y: Column, most: Column) -> Column:
    """The closest zoom that shows a box with its margin."""
    across = F.lit(style.width / 2.0) / ((high_x - low_x) / 2 + style.margin * style.width)
    along = F.lit(style.height / 2.0) / ((high_y - low_y) / 2 + style.margin * style.height)
    return F.greatest(F.lit(style.least_zoom), F.least(most, across, along))


def setpoints(spans: DataFrame, ball: DataFrame, segments: DataFrame, players: DataFrame, field: DataFrame, style: Style = Style()) -> DataFrame:
    """(match_id, frame, t, state, focus, aim_x, aim_y, want, confidence, lost_s, ball_x, ball_y, also_x, also_y): phase one.

    ``ball`` is (match_id, t, x, y), ``segments`` (match_id, start_s, state, side), ``players`` (match_id, track_id, t, x, y),
    ``field`` (match_id, x_min, x_max, y_min, y_max). ``also`` is a second place that must be seen, a goal or an exit.

    Rows are shuffled while they are narrow: by half seconds to meet the players, then by match. No join may broadcast samples,
    since those that are exploded from a few rows look small to the planner; ``field`` is one row a match.
    """
    s, half = style, 0.5  # players count by half seconds
    rows = frames_of(spans, ball, s).withColumn("bin", F.floor(F.col("t") / half))

    # one place for each player and half second, and where the ball is then
    places = players.groupBy("match_id", "track_id", F.floor(F.col("t") / half).alias("bin")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    at = rows.groupBy("match_id", "bin").agg(F.avg("ball_x").alias("bx"), F.avg("ball_y").alias("by"))
    near = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) <= s.action * s.width
    crowd = places.join(at.hint("merge"), ["match_id", "bin"]).groupBy("match_id", "bin").agg(
        F.avg("x").alias("all_x"), F.avg("y").alias("all_y"), F.count_if(near).alias("n"), *[f(F.when(near, F.col(c))).alias(f"{name}_{c}") for c in ("x", "y") for f, name in ((F.avg, "mean"), (F.min, "low"), (F.max, "high"))])
    # all players count where the ball isn't seen, those around it where two are
    counts = lambda c: F.col("ball_x").isNull() if c.startswith("all_") else F.col("n") >= 2
    rows = rows.join(crowd.hint("merge"), ["match_id", "bin"], "left").select(
        "match_id", "frame", "t", "ball_x", "ball_y", "n", *[F.when(counts(c), F.col(c)).alias(c) for c in crowd.columns if c not in ("match_id", "bin", "n")])

    rows = ts.asof_backward(rows, segments.select("match_id", "start_s", F.col("state").alias("s"), F.col("side").alias("side")), MATCH, "t", "start_s", "seg", fall_back_to_first=True)
    w, step = Window.partitionBy("match_id").orderBy("frame"), 4
    speed = lambda c: F.coalesce((F.lead(c, step).over(w) - F.lag(c, step).over(w)) * s.fps / (2 * step), F.lit(0.0))
    seen = F.when(F.col("ball_x").isNotNull(), F.struct("t", F.col("ball_x").alias("x"), F.col("ball_y").alias("y")))
    rows = rows.withColumns({"vx": speed("ball_x"), "vy": speed("ball_y"), "last": F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumns({"state": F.coalesce("seg.s", F.lit("in_play")), "side": F.col("seg.side"), "lost_s": F.coalesce(F.col("t") - F.col("last.t"), F.lit(1e9))}).drop("seg").join(F.broadcast(field), "match_id")

    base, length = F.lit(min(max(s.base_zoom, s.least_zoom), s.most_zoom)), F.col("x_max") - F.col("x_min")
    goal_y = (F.col("y_min") + F.col("y_max")) / 2
    close_left = F.col("ball_x") - F.col("x_min") < F.col("x_max") - F.col("ball_x")
    of_left = F.when(F.col("side").isNotNull(), F.col("side") == "left").otherwise(F.coalesce(close_left, F.lit(True)))
    rows = rows.withColumns({"goal_x": F.when(of_left, F.col("x_min")).otherwise(F.col("x_max")), "goal_y": goal_y, "inward": F.when(of_left, 1).otherwise(-1)})
    visible, state = F.col("ball_x").isNotNull(), F.col("state")
    anchor = lambda c: F.coalesce(F.col(f"ball_{c}"), F.col(f"last.{c}"), F.col(f"goal_{c}"))
    engaged = F.coalesce(F.col("n") >= 2, F.lit(False))
    lead = lambda c: F.col(f"ball_{c}") + F.col(f"v{c}") * s.lead_s
    play = lambda c: F.when(engaged, lead(c) * (1 - s.blend) + F.col(f"mean_{c}") * s.blend).otherwise(lead(c))
    away = F.hypot(F.col("ball_x") - F.col("goal_x"), F.col("ball_y") - F.col("goal_y"))
    threat = visible & (away <= s.threat * length) & ((F.col("vx") * F.col("inward") < -10.0) | (away <= 0.55 * s.threat * length))
    pull = F.when(threat, s.threat_blend * (1 - away / (s.threat * length))).otherwise(0.0)
    paced = base * (1 - s.fast_ball_zoom * F.least(F.lit(1.0), F.hypot("vx", "vy") / (s.fast_ball * s.width)))
    box = lambda c, f, other: f(F.col(f"ball_{c}"), other)
    with_players = _fit(s, box("x", F.least, F.col("low_x")), box("x", F.greatest, F.col("high_x")), box("y", F.least, F.col("low_y")), box("y", F.greatest, F.col("high_y")), base)
    with_goal = lambda x, y: _fit(s, F.least(x, F.col("goal_x")), F.greatest(x, F.col("goal_x")), F.least(y, F.col("goal_y")), F.greatest(y, F.col("goal_y")), base)
    beside_goal = F.col("goal_x") + F.col("inward") * s.infield * length

    cases = [  # (when, focus, aim x, aim y, zoom, confidence)
        (state.startswith("goal_"), "goal", beside_goal, F.col("goal_y"), base, 0.9),
        (state.endswith("_setup"), "set_piece", 0.45 * anchor("x") + 0.55 * F.col("goal_x"), 0.45 * anchor("y") + 0.55 * F.col("goal_y"), with_goal(anchor("x"), anchor("y")), 0.85),
        (state == "restart_touchline", "exit_point", anchor("x"), anchor("y"), F.least(base, F.lit(s.restart_zoom)), 0.6),
        (state.startswith("restart_"), "goal", beside_goal, F.col("goal_y"), F.least(base, F.lit(s.restart_zoom)), 0.75),
        (threat, "ball_and_goal", play("x") * (1 - pull) + F.col("goal_x") * pull, play("y") * (1 - pull) + F.col("goal_y") * pull, with_goal(F.col("ball_x"), F.col("ball_y")), 0.9),
        (visible, "ball", play("x"), play("y"), F.when(engaged, F.least(paced, with_players)).otherwise(paced), 0.9),
        (F.col("lost_s") <= s.hold_s, "hold", F.col("last.x"), F.col("last.y"), base, 0.5),
        (F.col("all_x").isNotNull(), "players", F.col("all_x"), F.col("all_y"), base * s.lost_zoom, 0.35),
    ]

    def pick(place: int, other: Column) -> Column:
        out = None
        for case in cases:
            value = case[place] if isinstance(case[place], Column) else F.lit(case[place])
            out = F.when(case[0], value) if out is None else out.when(case[0], value)
        return out.otherwise(other)

    focus = pick(1, F.lit("frame"))
    both = focus.isin("goal", "set_piece", "ball_and_goal")
    also = lambda c: F.when(both, F.col(f"goal_{c}")).when(focus == "exit_point", anchor(c))
    want = F.greatest(F.lit(s.least_zoom), F.least(F.lit(s.most_zoom), pick(4, base * s.lost_zoom)))
    return rows.select(
        "match_id", "frame", "t", "state", focus.alias("focus"), pick(2, F.lit(s.width / 2.0)).alias("aim_x"), pick(3, F.lit(s.height / 2.0)).alias("aim_y"), want.alias("want"),
        pick(5, F.lit(0.1)).alias("confidence"), "lost_s", "ball_x", "ball_y", also("x").alias("also_x"), also("y").alias("also_y"))


# --- the fold over one match's frames ---------------------------------------------------------------------------


def eased(aim: np.ndarray, mode: np.ndarray, lost_s: np.ndarray, style: Style) -> tuple[np.ndarray, np.ndarray]:
    """Aims (complex) with eased moves where the mode changes or the aim jumps, and the frames that are cuts.

    A move starts where the camera is and arrives at the moving aim after ``ease_s``, gently at both ends.
    """
    out, cut = aim.copy(), np.zeros(len(aim), bool)
    n, start, origin = max(1, round(style.ease_s * style.fps)), -1, 0j
    moved = (mode[1:] != mode[:-1]) | (np.abs(np.diff(aim)) > style.jump * style.width)
    for i in range(1, len(aim)):
        if moved[i - 1]:
            if abs(aim[i] - out[i - 1]) > style.cut_jump * style.width and lost_s[i - 1] > style.cut_lost_s:
                cut[i], start = True, -1
                continue
            start, origin = i, out[i - 1]
        if start >= 0:
            u = (i - start + 1) / n
            if u >= 1:
                start = -1
            else:
                out[i] = origin + (aim[i] - origin) * u * u * (3 - 2 * u)
    return out, cut


def bell_mean(values: np.ndarray, sigma: float, weights: np.ndarray | None = None) -> np.ndarray:
    """A Gaussian mean without delay, ends repeated; each frame by its weight."""
    if sigma < 0.1 or len(values) < 2:
        return values
    r = int(3 * sigma + 0.5)
    bell = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    spread = lambda v: np.convolve(np.pad(v, r, mode="edge"), bell, "valid")
    weights = np.ones(len(values)) if weights is None else weights
    return spread(values * weights) / np.maximum(spread(weights), 1e-12)


def below(values: np.ndarray, step: float, radius: int) -> np.ndarray:
    """A smooth curve nowhere above ``values`` that changes by ``step`` a frame at most: slope-limited, then a mean of minima."""
    ramp = step * np.arange(len(values))
    curve = np.minimum(np.minimum.accumulate(values - ramp) + ramp, np.minimum.accumulate((values + ramp)[::-1])[::-1] - ramp)
    if radius < 1:
        return curve
    least = np.lib.stride_tricks.sliding_window_view(np.pad(curve, radius, mode="edge"), 2 * radius + 1).min(1)
    return np.convolve(np.pad(least, radius, mode="edge"), np.full(2 * radius + 1, 1 / (2 * radius + 1)), "valid")


def zoom_wish(want: np.ndarray, style: Style) -> np.ndarray:
    """Down at once, up when the wish stayed higher by a band for a while, then rate-limited and smooth."""
    out, now, since, hold = np.empty(len(want)), want[0], 0, round(style.zoom_hold_s * style.fps)
    for i, z in enumerate(want):
        since = since + 1 if z > now * (1 + style.zoom_band) else 0
        if z < now or since >= hold:
            now, since = z, 0
        out[i] = now
    return bell_mean(below(out, style.zoom_rate / style.fps, 0), style.zoom_smooth_s * style.fps)


def clamped(centre: np.ndarray, zoom: np.ndarray, size: float) -> np.ndarray:
    half = size / (2 * zoom)
    return np.clip(centre, half, size - half)


def folded(match: pd.DataFrame, style: Style) -> pd.DataFrame:
    """cx, cy, zoom and cut of a match's frames in order: phases two to four."""
    s = style
    aim, cut = eased(match["aim_x"].to_numpy(float) + 1j * match["aim_y"].to_numpy(float), match["focus"].to_numpy(), match["lost_s"].to_numpy(float), s)
    parts = np.split(np.arange(len(match)), np.flatnonzero(cut))
    weights = np.maximum(match["confidence"].to_numpy(float), 0.05)
    keeps = [match[[f"{p}_x", f"{p}_y"]].to_numpy(float) for p in ("ball", "also")]
    # a second place binds once the camera has had the time to get there
    settled = np.ones(len(match), bool)
    turned = np.flatnonzero(match["focus"].to_numpy()[1:] != match["focus"].to_numpy()[:-1]) + 1
    for i in turned:
        settled[i:i + round(s.ease_s * s.fps)] = False
    keeps[1][~settled] = np.nan
    size, half = (float(s.width), float(s.height)), 0.5 - s.margin

    def pan(zoom: np.ndarray) -> list[np.ndarray]:
        out = []
        for values, extent in ((aim.real, size[0]), (aim.imag, size[1])):
            target, path = clamped(values, zoom, extent), np.empty(len(zoom))
            for part in parts:
                crop = s.width / zoom[part].max()  # the closest view of the part has the tightest limits
                path[part] = within_limits(bell_mean(target[part], s.pan_smooth_s * s.fps, weights[part]), s.pan_speed * crop / 2 ** 0.5, s.pan_acceleration * crop / 2 ** 0.5, 1 / s.fps)
            out.append(clamped(path, zoom, extent))
        return out

    def room(centre: list[np.ndarray], zoom: np.ndarray) -> np.ndarray:
        """The zoom at which all that must be seen is just inside the margin; at the frame's edge, inside the frame."""
        allowed = np.full(len(zoom), s.most_zoom)
        for keep in keeps:
            for k in (0, 1):
                edge = s.margin * size[k] / zoom
                off = np.abs(np.clip(keep[:, k], edge, size[k] - edge) - centre[k])
                with np.errstate(divide="ignore", invalid="ignore"):
                    allowed = np.fmin(allowed, np.where(off > 1e-6, half * size[k] / off, np.inf))
        return np.maximum(allowed, s.least_zoom)

    zoom = np.clip(zoom_wish(match["want"].to_numpy(float), s), s.least_zoom, s.most_zoom)
    centre = pan(zoom)
    for _ in range(s.passes):
        allowed = room(centre, zoom)
        if (allowed >= zoom - 1e-6).all():
            break
        zoom = np.clip(below(np.minimum(zoom, allowed), s.zoom_rate / s.fps, max(1, round(s.zoom_smooth_s * s.fps))), s.least_zoom, s.most_zoom)
        centre = pan(zoom)
    return pd.DataFrame({"cx": centre[0], "cy": centre[1], "zoom": zoom, "cut": cut})


def planned(wishes: DataFrame, style: Style = Style()) -> DataFrame:
    """(match_id, frame, t, state, focus, confidence, ball_x, ball_y, cx, cy, zoom, cut) from ``setpoints``; one match is one task."""
    kept = ["match_id", "frame", "t", "state", "focus", "confidence", "ball_x", "ball_y"]

    def run(match: pd.DataFrame) -> pd.DataFrame:
        match = match.sort_values("frame").reset_index(drop=True)
        return pd.concat([match[kept], folded(match, style)], axis=1)

    kinds = dict(wishes.dtypes)
    return wishes.groupBy("match_id").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", cx double, cy double, zoom double, cut boolean")


def plan_camera(spans: DataFrame, ball: DataFrame, segments: DataFrame, players: DataFrame, field: DataFrame, style: Style = Style()) -> DataFrame:
    return planned(setpoints(spans, ball, segments, players, field, style), style)


def plan_quality(plan: DataFrame, style: Style = Style()) -> DataFrame:
    """How a plan is to watch, one row a match: speeds in crop widths, zoom rates, snaps, reversals and how often the ball in play is in the crop.

    Steps into a cut don't count. A snap is a step of a quarter of the crop.
    """
    w = Window.partitionBy("match_id").orderBy("frame")
    crop = F.lit(float(style.width)) / F.col("zoom")
    step = lambda c: F.lead(c).over(w) - F.col(c)
    smooth = ~F.lead("cut").over(w)
    rows = plan.withColumns({"px": F.when(smooth, step("cx")), "py": F.when(smooth, step("cy")), "pz": F.when(smooth, step("zoom")), "crop": crop})
    bend = F.hypot(F.lead("px").over(w) - F.col("px"), F.lead("py").over(w) - F.col("py")) * style.fps ** 2 / F.col("crop")
    inside = (F.abs(F.col("ball_x") - F.col("cx")) <= F.col("crop") / 2) & (F.abs(F.col("ball_y") - F.col("cy")) <= F.lit(style.height / 2.0) / F.col("zoom"))
    rows = rows.withColumns({"pan": F.hypot("px", "py") * style.fps / F.col("crop"), "bend": bend, "rate": F.abs("pz") * style.fps, "inside": F.when((F.col("state") == "in_play") & F.col("ball_x").isNotNull(), inside.cast("int"))})
    turning = rows.where(F.col("rate") >= 0.01).withColumn("turned", F.signum("pz") != F.lag(F.signum("pz")).over(w)).groupBy("match_id").agg(F.count_if("turned").alias("turns"))
    p95 = lambda c: F.coalesce(F.percentile(c, F.lit(0.95)), F.lit(0.0))
    found = rows.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("frames"), p95("pan").alias("pan_p95"), F.max("pan").alias("pan_max"), p95("bend").alias("acceleration_p95"), p95("rate").alias("zoom_rate_p95"), F.max("rate").alias("zoom_rate_max"),
        F.count_if(F.col("pan") / style.fps > 0.25).alias("snaps"), F.coalesce(F.avg("inside"), F.lit(1.0)).alias("ball_in_frame"), F.count_if("cut").alias("cuts"), F.min("zoom").alias("zoom_min"), F.max("zoom").alias("zoom_max"), F.avg("zoom").alias("zoom_mean"))
    return found.join(turning, "match_id", "left").withColumn("reversals_per_minute", F.coalesce("turns", F.lit(0)) * 60 * style.fps / F.col("frames")).drop("turns")
