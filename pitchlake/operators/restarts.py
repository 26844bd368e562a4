"""Dead balls: where the ball rests, and set pieces as a rest that ends with a kick.

A rest is anchored at a sample and grows while the ball stays within a radius of it; a set piece is a rest that is long
enough and is followed by a kick. An anchor that leads to neither is moved on by one sample, so a ball that first drifts and
then lies still is found where it lies. The search is over one match's seen ball, growing in doubling steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of the pitch's length or width (places) and of the frame's width (radius, kick). Fixed values.
RADIUS, KICK, CORNER, SPOT_NEAR, SPOT_FAR, SPOT_WIDE, BOX_DEEP, BOX_WIDE, CIRCLE, THREAT = 0.012, 0.15, 0.06, 0.06, 0.18, 0.12, 0.12, 0.25, 0.16, 0.38


def anchored(t: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float, shortest: float, longest_gap: float, taken: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """(first, end) of stretches around their first sample that last ``shortest`` and are ``taken``; none overlap."""
    apart = np.concatenate(([False], np.diff(t) > longest_gap))
    n, i = len(t), 0
    # anchors that the ball leaves within a few samples and too soon, which most are: all at once
    soon, held = np.zeros(max(0, n - 1), bool), np.arange(n - 1)
    for k in range(1, 17):
        held = held[held + k < n]
        left = (np.hypot(x[held + k] - x[held], y[held + k] - y[held]) > radius) | apart[held + k]
        soon[held[left]] = t[held[left] + k - 1] - t[held[left]] < shortest
        held = held[~left]
    anchors = np.flatnonzero(~soon)
    while i < n - 1:
        later = np.searchsorted(anchors, i)
        if later == len(anchors):
            return
        i = int(anchors[later])
        j, step = i + 1, 16
        while j < n:
            k = min(n, j + step)
            left = (np.hypot(x[j:k] - x[i], y[j:k] - y[i]) > radius) | apart[j:k]
            if left.any():
                j += int(left.argmax())
                break
            j, step = k, step * 2
        if t[j - 1] - t[i] >= shortest and taken(i, j):
            yield i, j
            i = j
        else:
            i += 1


def _per_match(ball: DataFrame, rows: Callable[[pd.DataFrame], list[tuple]], names: list[str]) -> DataFrame:
    def run(match: pd.DataFrame) -> pd.DataFrame:
        match = match.sort_values("t", kind="stable")
        return pd.DataFrame(rows(match), columns=names).assign(match_id=match["match_id"].iloc[0])[["match_id", *names]]

    kind = dict(ball.dtypes)["match_id"]
    return ball.select("match_id", "t", "x", "y").dropna().groupBy("match_id").applyInPandas(run, f"match_id {kind}, " + ", ".join(f"{c} double" for c in names))


def rest_spells(ball: DataFrame, radius: float, shortest: float = 0.5, longest_gap: float = 1.25) -> DataFrame:
    """(match_id, t_start, t_end, x, y): where the ball of (match_id, t, x, y) rests, at its mean place."""

    def rows(match: pd.DataFrame) -> list[tuple]:
        t, x, y = (match[c].to_numpy(float) for c in ("t", "x", "y"))
        return [(t[i], t[j - 1], x[i:j].mean(), y[i:j].mean()) for i, j in anchored(t, x, y, radius, shortest, longest_gap, lambda i, j: True)]

    return _per_match(ball, rows, ["t_start", "t_end", "x", "y"])


def set_pieces(ball: DataFrame, shortest: float = 1.2, frame_width: float = 105.0, longest_gap: float = 1.25, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """(match_id, t_start, t, x, y, speed, kind, side): rests of ``shortest`` seconds that end with a kick at ``t``.

    The speed is the larger of those around 0.3 and 0.7 seconds after the rest, since a kicked ball is still getting
    faster. The place names the kind; ``side`` is the goal that it threatens, null at the centre and far from both goals.
    """

    def rows(match: pd.DataFrame) -> list[tuple]:
        t, x, y = (match[c].to_numpy(float) for c in ("t", "x", "y"))

        def speed(at: float) -> float:
            a, b = np.searchsorted(t, at - 0.5, "left"), np.searchsorted(t, at + 0.5, "right") - 1
            return float(np.hypot(x[b] - x[a], y[b] - y[a]) / (t[b] - t[a])) if b > a and t[b] - t[a] > 1e-6 else 0.0

        after = lambda j: max(speed(t[j - 1] + 0.3), speed(t[j - 1] + 0.7))
        kicked = lambda i, j: j < len(t) and after(j) >= KICK * frame_width
        return [(t[i], t[j - 1], x[i], y[i], after(j)) for i, j in anchored(t, x, y, RADIUS * frame_width, shortest, longest_gap, kicked)]

    found = _per_match(ball, rows, ["t_start", "t", "x", "y", "speed"])
    ax, ay, depth = F.abs("x"), F.abs("y"), length / 2 - F.abs("x")
    kind = (
        F.when(F.hypot(depth, width / 2 - ay) <= CORNER * length, "corner_kick")
        .when(depth.between(SPOT_NEAR * length, SPOT_FAR * length) & (ay <= SPOT_WIDE * width), "penalty_kick")
        .when((depth > 0) & (depth <= BOX_DEEP * length) & (ay <= BOX_WIDE * width), "goal_kick")
        .when(F.hypot("x", "y") <= CIRCLE * length, "kickoff").otherwise("free_kick")
    )
    near = F.when(F.col("x") < 0, "left").otherwise("right")
    side = F.when(F.col("kind") == "kickoff", None).when((F.col("kind") == "free_kick") & (length / 2 - ax > THREAT * length), None).otherwise(near)
    return found.withColumn("kind", kind).withColumn("side", side)
