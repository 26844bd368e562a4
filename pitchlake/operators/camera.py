"""Camera plans from the ball: smooth, limited focus points, zoom with hysteresis, crop boxes and their quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators import timeseries as ts


def zero_phase(values: Column, alpha: float) -> Column:
    """Exponential smoothing forwards and backwards, each from the first value it meets: no delay."""
    def once(v: Column) -> Column:
        step = lambda acc, x: F.array_append(acc, F.when(F.size(acc) == 0, x).otherwise(alpha * x + (1 - alpha) * F.try_element_at(acc, F.lit(-1))))
        return F.aggregate(v, F.array().cast("array<double>"), step)
    return F.reverse(once(F.reverse(once(values))))


def both_ways(values: np.ndarray, alpha: float) -> np.ndarray:
    """``zero_phase`` of a long series."""
    return ts.smoothed(ts.smoothed(values, alpha)[::-1], alpha)[::-1]


def zoom_setpoints(required: DataFrame, fraction: float = 0.12, hold: int = 25) -> DataFrame:
    """(match_id, frame, zoom): follows the required zoom down at once, and up only after it stayed higher by a fraction for ``hold`` frames."""

    def run(match: pd.DataFrame) -> pd.DataFrame:
        match, out, now, since = match.sort_values("frame"), [], None, 0
        for need in match["required"]:
            since = since + 1 if now is not None and need > now * (1 + fraction) else 0
            if now is None or need < now or since >= hold:
                now, since = need, 0
            out.append(now)
        return match[["match_id", "frame"]].assign(zoom=out)

    kind = dict(required.dtypes)
    return required.select("match_id", "frame", "required").groupBy("match_id").applyInPandas(run, f"match_id {kind['match_id']}, frame {kind['frame']}, zoom double")


def plan(ball: DataFrame, width: float, height: float, view: float = 0.4, alpha: float = 0.15, fastest: float = 30.0) -> DataFrame:
    """(match_id, frame, cx, cy): the last seen ball, smoothed both ways, limited in speed and kept inside the frame. ``ball`` is (match_id, frame, x, y)."""
    w = Window.partitionBy("match_id").orderBy("frame")
    held = ball.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.first(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)) for c in ("x", "y")})
    path = lambda c: lambda rows: ts.followed(both_ways(rows[c].to_numpy(float), alpha), fastest)
    rows = ts.fold_rows(held.select("match_id", "frame", "x", "y"), ["match_id"], "frame", {"cx": path("x"), "cy": path("y")})
    inside = lambda c, size: F.greatest(F.lit(size * view / 2), F.least(F.lit(size * (1 - view / 2)), c))
    return rows.select("match_id", "frame", inside(F.col("cx"), width).alias("cx"), inside(F.col("cy"), height).alias("cy"))


def crop_boxes(plan_rows: DataFrame, width: float, height: float, aspect: float = 16 / 9, hold_px: float = 2.0) -> DataFrame:
    """(match_id, frame, x, y, w, h): even numbers; the width only changes when it has moved by ``hold_px``. Rows have cx, cy and zoom."""

    def held(rows: pd.DataFrame) -> list:
        out: list = []
        for want in rows["want"]:
            out.append(want if not out or abs(want - out[-1]) >= hold_px else out[-1])
        return out

    wide = F.least(F.lit(width), F.lit(height * aspect)) / F.greatest("zoom", F.lit(1.0))
    rows = ts.fold_rows(plan_rows.select("match_id", "frame", "cx", "cy", wide.alias("want")), ["match_id"], "frame", {"wide": held})
    even = lambda c: (F.floor(c / 2) * 2).cast("int")
    w, h = even(F.col("wide")), even(F.col("wide") / aspect)
    at = lambda centre, size, top: even(F.greatest(F.lit(0.0), F.least(top - size, centre - size / 2)))
    return rows.select("match_id", "frame", at(F.col("cx"), w, F.lit(width)).alias("x"), at(F.col("cy"), h, F.lit(height)).alias("y"), w.alias("w"), h.alias("h"))


def sliced(plan_rows: DataFrame, start_s: float, end_s: float, fps: float) -> DataFrame:
    """The frames of a plan from start to end, numbered from 0 again."""
    if end_s <= start_s:
        raise ValueError("the end must come after the start")
    first, last = max(0, round(start_s * fps)), round(end_s * fps)
    return plan_rows.where((F.col("frame") >= first) & (F.col("frame") < last)).withColumn("frame", F.col("frame") - first)


def reversals(rows: DataFrame, fps: float, slowest: float) -> DataFrame:
    """(match_id, reversals): how often the pan turns round while both speeds are above ``slowest`` a second."""
    w = Window.partitionBy("match_id").orderBy("frame")
    v = rows.withColumn("v", (F.col("cx") - F.lag("cx").over(w)) * fps).where(F.abs("v") > slowest)
    turned = F.signum("v") != F.lag(F.signum("v")).over(w)
    return v.withColumn("turned", turned).groupBy("match_id").agg(F.count_if("turned").alias("reversals"))


def quality(rows: DataFrame, fps: float, crop_width: float) -> DataFrame:
    """Per match: p95 and top pan speed in crop widths a second, and snaps above two widths."""
    w = Window.partitionBy("match_id").orderBy("frame")
    pan = F.hypot(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)) * fps / crop_width
    return rows.withColumn("pan", pan).groupBy("match_id").agg(F.percentile("pan", F.lit(0.95)).alias("pan_p95"), F.max("pan").alias("pan_max"), F.count_if(F.col("pan") > 2).alias("snaps"), F.count(F.lit(1)).alias("frames"))


def weighted_rows(df: DataFrame, keys: list[str], order: str, value: str, weights: list[float], name: str) -> DataFrame:
    """``value`` averaged over the rows around each by an odd number of symmetric weights; ends are repeated beyond a key's rows."""
    total, r = sum(weights), len(weights) // 2
    norm = [w / total for w in weights]
    beyond = [sum(norm[:i]) for i in range(r + 1)]  # the weight that falls off one end when i rows are missing there
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_left", F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int") - 1 - F.col("_i"))
    rows = rows.withColumns({"_near": F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(-r, r)), "_first": F.first(value).over(whole), "_last": F.last(value).over(whole)})
    array = lambda v: F.expr("array(" + ", ".join(f"{x!r}D" for x in v) + ")")
    short, late = F.greatest(F.lit(0), r - F.col("_i")), F.greatest(F.lit(0), r - F.col("_left"))
    inner = F.aggregate(F.zip_with("_near", F.slice(array(norm), short + 1, F.size("_near")), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    out = inner + F.col("_first") * F.element_at(array(beyond), short + 1) + F.col("_last") * F.element_at(array(beyond), late + 1)
    return rows.withColumn(name, out).drop("_i", "_left", "_near", "_first", "_last")


def gaussian(df: DataFrame, keys: list[str], order: str, value: str, sigma: float, name: str, weight: str | None = None) -> DataFrame:
    """A Gaussian average over three sigmas of rows without delay; with ``weight`` each row counts by its confidence."""
    if sigma <= 0.05:
        return df.withColumn(name, F.col(value))
    r = int(3 * sigma + 0.5)
    bell = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2).tolist()
    if weight is None:
        return weighted_rows(df, keys, order, value, bell, name)
    rows = weighted_rows(df.withColumn("_vw", F.col(value) * F.col(weight)), keys, order, "_vw", bell, "_up")
    rows = weighted_rows(rows, keys, order, weight, bell, "_down")
    return rows.withColumn(name, F.col("_up") / F.greatest("_down", F.lit(1e-9))).drop("_vw", "_up", "_down")


def lower_envelope(df: DataFrame, keys: list[str], order: str, value: str, step: float, radius: int, name: str) -> DataFrame:
    """A smooth curve that never exceeds ``value`` and changes by at most ``step`` a row: slope limit, running minimum, Hann mean."""
    rows = ts.lipschitz_below(df, keys, order, value, step, name)
    if radius <= 0:
        return rows
    rows = rows.withColumn("_least", F.min(name).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)))
    return weighted_rows(rows.drop(name), keys, order, "_least", np.hanning(2 * radius + 3)[1:-1].tolist(), name).drop("_least")


def within_limits(path: np.ndarray, fastest: float, strongest: float, dt: float) -> np.ndarray:
    """One coordinate of a path as the nearest that changes by ``fastest`` a second at most, eased so that its speed changes by ``strongest``.

    The greatest curve of that slope below the path and the least one above it are two running extremes each; their mean is
    as close to the path as such a curve can be. Its mean over the time in which the full speed can be turned round holds
    the acceleration, and the speed still. Neither has a delay.
    """
    reach = fastest * dt * np.arange(len(path))

    def lower(v: np.ndarray) -> np.ndarray:
        ahead = np.minimum.accumulate(v - reach) + reach
        behind = (np.minimum.accumulate((v + reach)[::-1]))[::-1] - reach
        return np.minimum(ahead, behind)

    middle = (lower(path) - lower(-path)) / 2
    r = int(np.ceil(fastest / (strongest * dt) - 0.5)) if strongest > 0 else 0
    r = max(r, 0)
    total = np.concatenate(([0.0], np.cumsum(np.pad(middle, r, mode="edge"))))
    return (total[2 * r + 1:] - total[:-2 * r - 1]) / (2 * r + 1)


def limited_motion(rows: DataFrame, fps: float) -> DataFrame:
    """(match_id, frame, cx, cy): paths within limits of speed and acceleration, without delay.

    ``rows`` is (match_id, frame, x, y, fastest, strongest), limits in units a second and a second squared; a match is held
    to its smallest ones. Each coordinate has its share, so that the limits hold in every direction. Plans of fewer than
    three frames stay. One match is one task.
    """

    def run(match: pd.DataFrame) -> pd.DataFrame:
        match = match.sort_values("frame")
        limits = (match["fastest"].min() / 2 ** 0.5, match["strongest"].min() / 2 ** 0.5)
        moved = [match[c].to_numpy(float) if len(match) < 3 else within_limits(match[c].to_numpy(float), *limits, 1 / fps) for c in ("x", "y")]
        return match[["match_id", "frame"]].assign(cx=moved[0], cy=moved[1])

    kind = dict(rows.dtypes)
    return rows.select("match_id", "frame", "x", "y", "fastest", "strongest").groupBy("match_id").applyInPandas(
        run, f"match_id {kind['match_id']}, frame {kind['frame']}, cx double, cy double")


def plan_summary(plan_rows: DataFrame) -> DataFrame:
    """(match_id, frames, zoom_min, zoom_max, mean_confidence, focus_frames): ``focus_frames`` counts the frames of each focus."""
    by_focus = plan_rows.groupBy("match_id", "focus").agg(
        F.count(F.lit(1)).alias("n"), F.min("zoom").alias("lo"), F.max("zoom").alias("hi"), F.sum("confidence").alias("sum"), F.count("confidence").alias("known"))
    mean = F.round(F.coalesce(F.sum("sum") / F.nullif(F.sum("known"), F.lit(0)), F.lit(0.0)), 3)
    return by_focus.groupBy("match_id").agg(
        F.sum("n").alias("frames"), F.round(F.min("lo"), 3).alias("zoom_min"), F.round(F.max("hi"), 3).alias("zoom_max"), mean.alias("mean_confidence"),
        F.map_from_entries(F.collect_list(F.struct(F.coalesce("focus", F.lit("none")).alias("focus"), "n"))).alias("focus_frames"))
