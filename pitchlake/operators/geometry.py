"""Field geometry and calibration: robust bounds from where feet and ball go, goal boxes, homographies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.functions.exprs import PITCH_LENGTH_M, PITCH_WIDTH_M
from pitchlake.operators import restarts
from pitchlake.operators import timeseries as ts


def solve_homography(source, target) -> list[list[float]]:
    """The 3x3 projective map of four points onto four others, scaled so that its last entry is 1."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3).tolist()


def is_convex(corners) -> bool:
    """Whether four corners turn the same way all round."""
    p = np.asarray(corners, float)
    edge = np.roll(p, -1, axis=0) - p
    following = np.roll(edge, -1, axis=0)
    turn = edge[:, 0] * following[:, 1] - edge[:, 1] * following[:, 0]
    return bool((turn > 1e-9).all() or (turn < -1e-9).all())


def calibrate_from_corners(corners, frame: tuple[int, int] | None = None, length: float = PITCH_LENGTH_M, width: float = PITCH_WIDTH_M) -> list[list[float]]:
    """Homography from image corners (far left, far right, near right, near left) to metres; corners up to 1 are shares of the frame."""
    p = np.asarray(corners, float)
    if p.shape != (4, 2) or not is_convex(p):
        raise ValueError("calibration needs four corners of a convex shape")
    if frame and np.abs(p).max() <= 1.0:
        p = p * np.asarray(frame, float)
    l, w = length / 2, width / 2
    return solve_homography(p, [(-l, -w), (l, -w), (l, w), (-l, w)])


def trapezoid(x_min: float, y_min: float, x_max: float, y_max: float, far_ratio: float = 0.85) -> list[tuple[float, float]]:
    """Corners of a pitch seen from the near touchline, whose far line looks shorter."""
    inset = (x_max - x_min) * (1 - far_ratio) / 2
    return [(x_min + inset, y_min), (x_max - inset, y_min), (x_max, y_max), (x_min, y_max)]


def field_bounds(feet: DataFrame, least: int = 50) -> DataFrame:
    """(match_id, x_min, x_max, y_min, y_max, n): exact percentiles of foot points, for matches with enough of them."""
    p = lambda c, q: F.percentile(c, F.lit(q))
    return feet.groupBy("match_id").agg(p("x", 0.005).alias("x_min"), p("x", 0.995).alias("x_max"), p("y", 0.015).alias("y_min"), p("y", 0.985).alias("y_max"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def kth_extremes(values: DataFrame, value: str, share: float, least: int) -> DataFrame:
    """(match_id, low, high): the k-th smallest and largest value, k = max(least, round(share * n)): one outlier moves nothing."""
    sizes = values.groupBy("match_id").agg(F.greatest(F.lit(least), F.rint(F.count(F.lit(1)) * share).cast("int")).alias("k"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(value)).alias("v"))
    k = F.least("k", "n").cast("int")
    return sizes.select("match_id", F.element_at("v", k).alias("low"), F.element_at("v", -k).alias("high"))


def pitch_bounds(feet: DataFrame, ball: DataFrame, share: float = 0.002, least: int = 5) -> DataFrame:
    """The union of the players' percentile bounds and the ball's k-th extremes, with the median of standing balls' centre spot left to the caller."""
    bx, by = kth_extremes(ball, "x", share, least), kth_extremes(ball, "y", share, least)
    both = field_bounds(feet).join(bx.withColumnsRenamed({"low": "bx0", "high": "bx1"}), "match_id", "left").join(by.withColumnsRenamed({"low": "by0", "high": "by1"}), "match_id", "left")
    return both.select("match_id", F.least("x_min", "bx0").alias("x_min"), F.greatest("x_max", "bx1").alias("x_max"), F.least("y_min", "by0").alias("y_min"), F.greatest("y_max", "by1").alias("y_max"))


def auto_bounds(feet: DataFrame, ball: DataFrame, frame_width: float, share: float = 0.002, least: int = 2, enough: int = 50, rest_share: float = 0.012, spot_share: float = 0.06) -> DataFrame:
    """(match_id, x_min, x_max, y_min, y_max, centre_y): where feet and the ball in play go; image units.

    Feet bound by their outer half per cent; the ball by its k-th extremes, without the time it lies beyond the players'
    ends, in a net or for a goal kick. Both need ``enough`` samples. ``centre_y`` is the median height of the rests near the
    middle, null when there are none or it isn't well inside.
    """
    p = lambda c, q: F.percentile(c, F.lit(q))
    players = feet.groupBy("match_id").agg(p("x", 0.005).alias("fx0"), p("x", 0.995).alias("fx1"), p("y", 0.005).alias("fy0"), p("y", 0.995).alias("fy1"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough).drop("n")
    rests = restarts.rest_spells(ball, rest_share * frame_width)
    nets = rests.join(players, "match_id").where("x NOT BETWEEN fx0 AND fx1").select("match_id", "t_start", "t_end")
    lying = ts.range_join(ball.select("match_id", "t"), nets, ["match_id"], "t", "t_start", "t_end", 10.0, closed=True).distinct()
    moving = ball.join(lying, ["match_id", "t"], "left_anti")
    reach = kth_extremes(moving, "x", share, least).withColumnsRenamed({"low": "bx0", "high": "bx1"}).join(kth_extremes(moving, "y", share, least).withColumnsRenamed({"low": "by0", "high": "by1"}), "match_id")
    reach = reach.join(moving.groupBy("match_id").count().where(F.col("count") >= enough).select("match_id"), "match_id", "left_semi")
    both = players.join(reach, "match_id", "full")
    out = both.select("match_id", F.least("fx0", "bx0").alias("x_min"), F.greatest("fx1", "bx1").alias("x_max"), F.least("fy0", "by0").alias("y_min"), F.greatest("fy1", "by1").alias("y_max"))
    spots = rests.join(out, "match_id").where(F.abs(F.col("x") - (F.col("x_min") + F.col("x_max")) / 2) <= spot_share * (F.col("x_max") - F.col("x_min"))).groupBy("match_id").agg(F.median("y").alias("centre_y"))
    tall = F.col("y_max") - F.col("y_min")
    inside = F.col("centre_y").between(F.col("y_min") + 0.25 * tall, F.col("y_max") - 0.25 * tall)
    return out.join(spots, "match_id", "left").withColumn("centre_y", F.when(inside, F.col("centre_y")))


def trapezoid_homography(bounds: DataFrame, far_ratio: float = 0.85, length: float = PITCH_LENGTH_M, width: float = PITCH_WIDTH_M) -> DataFrame:
    """(match_id, homography): the map to metres of a pitch seen from its near touchline, as a 3 x 3 array column.

    The far touchline is ``far_ratio`` of the near one, both centred. With s from 0 (far) to 1 (near), a line's width is
    d = far_ratio + (1 - far_ratio) s of the near one, so x / d is straight across and s / d straight along: the map in
    closed form, a row's homography from its columns. Without ``centre_y`` the bounds are the corners; with it the x bounds
    are the goal lines at that height, and the touchlines lie so that the diagonals cross there and all bounds are inside.
    """
    r = far_ratio
    cy, wide = F.col("centre_y"), F.col("x_max") - F.col("x_min")
    far_half = F.greatest(cy - F.col("y_min"), (F.col("y_max") - cy) * r)
    top = F.when(cy.isNull(), F.col("y_min")).otherwise(cy - far_half)
    tall = F.when(cy.isNull(), F.col("y_max") - F.col("y_min")).otherwise(far_half * (1 + r) / r)
    near = F.when(cy.isNull(), wide).otherwise(wide / (r + (1 - r) * r / (1 + r)))
    rows = bounds.where((wide >= 4) & (F.col("y_max") - F.col("y_min") >= 4)).select("match_id", ((F.col("x_min") + F.col("x_max")) / 2).alias("cx"), top.alias("top"), tall.alias("tall"), near.alias("near"))
    zero = F.lit(0.0)
    h = F.array(
        F.array(length / F.col("near"), zero, -length * F.col("cx") / F.col("near")),
        F.array(zero, width * (1 + r) / (2 * F.col("tall")), -width * ((1 + r) * F.col("top") / (2 * F.col("tall")) + r / 2)),
        F.array(zero, (1 - r) / F.col("tall"), r - (1 - r) * F.col("top") / F.col("tall")),
    )
    return rows.select("match_id", h.alias("homography"))


def calibrate_auto(feet: DataFrame, ball: DataFrame, frame_width: float, frame_height: float, far_ratio: float = 0.85) -> DataFrame:
    """(match_id, homography, centre_y, source) of every match of ``feet`` or ``ball``; those with too few samples take the frame's usual margins.

    ``exprs.project`` reads the column, so a join by match calibrates all matches in one job.
    """
    found = auto_bounds(feet, ball, frame_width)
    matches = feet.select("match_id").unionByName(ball.select("match_id")).distinct()
    usual = {"x_min": 0.02 * frame_width, "x_max": 0.98 * frame_width, "y_min": 0.10 * frame_height, "y_max": 0.90 * frame_height}
    inside = {"x_min": F.greatest(F.lit(0.0), "x_min"), "x_max": F.least(F.lit(frame_width), "x_max"), "y_min": F.greatest(F.lit(0.0), "y_min"), "y_max": F.least(F.lit(frame_height), "y_max")}
    source = F.when(F.col("x_min").isNull(), "frame_default").when(F.col("centre_y").isNull(), "bounds").otherwise("bounds+centre_spot")
    rows = matches.join(found, "match_id", "left").withColumn("source", source)
    rows = rows.withColumns({c: F.coalesce(F.when(F.col("x_min").isNotNull(), v), F.lit(usual[c])) for c, v in inside.items()})
    return trapezoid_homography(rows, far_ratio).join(rows.select("match_id", "centre_y", "source"), "match_id")


def goal_boxes(feet: DataFrame, bounds: DataFrame, near: float = 0.08, share: float = 0.11, least: int = 20) -> DataFrame:
    """(match_id, side, x1, y1, x2, y2): a box at each goal line, at the median height of the players close to it or else in the middle."""
    width, height = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    side = F.when(F.col("x") <= F.col("x_min") + near * width, "left").when(F.col("x") >= F.col("x_max") - near * width, "right")
    close = feet.join(bounds, "match_id").withColumn("side", side).where("side IS NOT NULL").groupBy("match_id", "side").agg(F.median("y").alias("mid"), F.count(F.lit(1)).alias("n_near"))
    sides = bounds.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right")))).join(close, ["match_id", "side"], "left")
    mid = F.when(F.col("n_near") >= least, F.col("mid")).otherwise((F.col("y_min") + F.col("y_max")) / 2)
    line = F.when(F.col("side") == "left", F.col("x_min")).otherwise(F.col("x_max"))
    return sides.select("match_id", "side", (line - 0.01 * width).alias("x1"), (mid - share * height / 2).alias("y1"), (line + 0.01 * width).alias("x2"), (mid + share * height / 2).alias("y2"))
