"""Seeded synthetic matches with known truth, one task per match."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HZ, BALL = 25, 99
ROWS = "match_id long, track_id int, team int, t double, x double, y double"


def _match(match_id: int, seconds: float, players: int) -> pd.DataFrame:
    """Players circle their posts; the ball goes from player to player in straight passes and twice into a goal."""
    rng = np.random.default_rng(match_id)
    t = np.arange(0, seconds, 1 / HZ)
    homes = rng.uniform([-40, -25], [40, 25], (2 * players, 2))
    homes[:players, 0] -= 8
    homes[players:, 0] += 8
    phase, radius = rng.uniform(0, 2 * np.pi, 2 * players), rng.uniform(2, 5, 2 * players)
    where = homes[:, None] + radius[:, None, None] * np.stack([np.cos(0.6 * t + phase[:, None]), np.sin(0.6 * t + phase[:, None])], axis=2)
    ball, now, holder = np.zeros((len(t), 2)), 0, int(rng.integers(2 * players))
    goals = [(int(seconds * 0.4 * HZ), 1), (int(seconds * 0.8 * HZ), -1)]
    while now < len(t):
        hold = min(len(t), now + HZ // 2)
        ball[now:hold] = where[holder, now:hold]
        if hold >= len(t):
            break
        if goals and hold >= goals[0][0]:
            _, side = goals.pop(0)
            start, end = ball[hold - 1], np.array([side * 54.0, 0.0])
            n = min(len(t) - hold, max(2, int(np.hypot(*(end - start)) / 25 * HZ)))
            ball[hold:hold + n] = start + (end - start) * (np.arange(1, n + 1) / n)[:, None]
            rest = min(len(t), hold + n + 2 * HZ)
            ball[hold + n:rest] = end
            ball[rest:rest + 4 * HZ] = np.nan  # hidden until the kick-off
            now, holder = min(len(t), rest + 4 * HZ), int(rng.integers(2 * players))
            continue
        to = int(rng.integers(2 * players))
        n = max(2, int(np.hypot(*(where[to, hold] - ball[hold - 1])) / 15 * HZ))
        end = where[to, min(len(t) - 1, hold + n)]
        n = min(n, len(t) - hold)
        ball[hold:hold + n] = ball[hold - 1] + (end - ball[hold - 1]) * (np.arange(1, n + 1) / max(n, 2))[:, None]
        now, holder = hold + n, to
    rows = [pd.DataFrame({"track_id": i, "team": i // players, "t": t, "x": where[i, :, 0], "y": where[i, :, 1]}) for i in range(2 * players)]
    rows.append(pd.DataFrame({"track_id": BALL, "team": -1, "t": t, "x": ball[:, 0], "y": ball[:, 1]}).dropna())
    return pd.concat(rows).assign(match_id=match_id)[["match_id", "track_id", "team", "t", "x", "y"]]


def synthetic_matches(spark: SparkSession, n: int, seconds: float = 40.0, players: int = 5) -> DataFrame:
    """(match_id, track_id, team, t, x, y); track 99 is the ball. The same ids give the same rows on any cluster."""
    return spark.range(n).groupBy("id").applyInPandas(lambda m: _match(int(m["id"].iloc[0]), seconds, players), ROWS)


def noisy(samples: DataFrame, metres: float, dropout: float) -> DataFrame:
    """Detections of true rows: jitter and misses drawn per (match, track, time), not per partition."""
    u = lambda k: (F.pmod(F.xxhash64("match_id", "track_id", "t", F.lit(k)), F.lit(1_000_003)) + 0.5) / 1_000_003
    gauss = lambda k: F.sqrt(-2 * F.log(u(k))) * F.cos(2 * np.pi * u(k + 1))
    return samples.where(u(9) >= dropout).withColumn("x", F.col("x") + metres * gauss(1)).withColumn("y", F.col("y") + metres * gauss(3))
