"""What a match's chain adds up to: a team's document, the quality of its figures, and the place of every event.

Every source of a document gives rows of its own measures, which are put in one table and summed by match and team: one
shuffle behind a partial aggregate, however many sources there are.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import exprs
from pitchlake.operators import timeseries as ts
from pitchlake.operators.match import HZ, MATCH, with_sign

TEAM = ["match_id", "team"]


def _both_teams(rows: DataFrame) -> DataFrame:
    return rows.withColumn("team", F.explode(F.array(F.lit(0), F.lit(1))))


def _by_side(rows: DataFrame, signs: DataFrame) -> DataFrame:
    """Rows (match_id, t, side) with the team that attacks that goal at that time; rows without a side go."""
    sign = F.when(F.col("side") == "right", 1).when(F.col("side") == "left", -1)
    return with_sign(rows.withColumn("sign", sign).where("sign IS NOT NULL"), signs, "t", by="sign")


def team_document(
    kin: DataFrame, ball: DataFrame, owned: DataFrame, segments: DataFrame, signs: DataFrame, touched: DataFrame, passed: DataFrame, shots: DataFrame,
    goals: DataFrame, pieces: DataFrame, colours: DataFrame | None = None, every: int = 5, hz: float = HZ, keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row for each match and team (0 and 1) of ``signs``, with everything that its statistics page shows.

    Shares of possession are of the samples with a known team, null when there are none. Territory is where the visible
    ball is while in play, in thirds of the team's own direction. The pace of play is of the ball's visible steps in the
    team's possession, whose samples are ``every`` steps apart. Corners are those at the goal that the team attacks then.
    ``colours`` (match_id, track_id, color_hex) gives a team the colour of most of its tracks, the smaller of equals.
    Teams without rows of a kind get 0. ``kin`` (match_id, track_id, team, step), ``ball`` (match_id, g, grid_t, x, vx,
    speed, visible), ``owned`` (match_id, t, code), ``goals`` and ``pieces`` (match_id, t, side, the latter with kind).
    ``keep`` is applied to the segments, to the ball's steps with them and to the sums over those, so that no plan holds all
    sources in full.
    """
    dealt, keep = keep, keep or (lambda df: df)
    signs = signs.select(*TEAM, "sign", *[c for c in ("from_s", "to_s") if c in signs.columns])
    one, num = F.lit(1.0), lambda c: c.cast("double")
    slots = owned.groupBy("match_id", F.rint(F.col("t") * hz / every).cast("long").alias("slot")).agg(F.max("code").alias("code"))
    seen = ball.where("visible AND x IS NOT NULL").select("match_id", "g", "grid_t", "x", "vx", "speed")
    during = ts.asof_backward(seen.select("match_id", "g", "grid_t"), keep(segments.select("match_id", "start_s", "state")), MATCH, "grid_t", "start_s", "seg", fall_back_to_first=True, keep=dealt)
    seen = seen.join(during.drop("grid_t"), ["match_id", "g"]).withColumn("slot", F.floor(F.col("g") / every)).join(slots, ["match_id", "slot"], "left")
    seen = with_sign(_both_teams(seen), signs, "grid_t")
    playing, held = F.coalesce(F.col("seg.state"), F.lit("in_play")) == "in_play", F.col("code") == F.col("team")
    third = exprs.third(F.col("x"), F.col("sign"))
    tracks = kin.where("team IN (0, 1)").groupBy(*TEAM, "track_id").agg(F.sum("step").alias("metres"), F.count(F.lit(1)).alias("n"))
    ahead = F.col("vx") * F.col("sign")
    steps = seen.select(
        *TEAM, *[num(playing & (third == i)).alias(f"third{i}") for i in range(3)], num(held & F.col("speed").isNotNull()).alias("held"), F.when(held, F.col("speed")).alias("held_speed"),
        num(held & F.col("vx").isNotNull()).alias("moved"), F.when(held, ahead).alias("ahead"))
    parts = [
        signs.select(*TEAM, F.col("sign").alias("_sign"), (F.col("from_s") if "from_s" in signs.columns else F.lit(0.0)).alias("_from")),
        tracks.select(*TEAM, one.alias("players"), num(F.col("metres")).alias("metres"), num(F.col("n")).alias("steps")),
        _both_teams(owned).select(*TEAM, num(F.col("code") >= 0).alias("known"), num(F.col("code") == F.col("team")).alias("own")),
        keep(steps.groupBy(*TEAM).agg(*[F.sum(c).alias(c) for c in steps.columns if c not in TEAM])),
        touched.select(*TEAM, one.alias("touches")),
        passed.select(*TEAM, one.alias("passes"), num(F.col("complete")).alias("complete")),
        shots.select(*TEAM, one.alias("shots"), num(F.col("on_target")).alias("on_target")),
        _by_side(goals.select("match_id", "t", "side"), signs).select(*TEAM, one.alias("goals")),
        _by_side(pieces.where("kind = 'corner_kick'").select("match_id", "t", "side"), signs).select(*TEAM, one.alias("corners")),
    ]
    table = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    measures = [c for c in table.columns if c not in (*TEAM, "_sign", "_from")]
    rows = table.groupBy(*TEAM).agg(F.min_by("_sign", "_from").alias("first"), F.max_by("_sign", "_from").alias("last"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in measures]).where("first IS NOT NULL")
    if colours is not None:
        worn = kin.where("team IN (0, 1)").select(*TEAM, "track_id").distinct().join(colours.where("color_hex IS NOT NULL"), ["match_id", "track_id"])
        rows = rows.join(worn.groupBy(*TEAM).agg(F.mode("color_hex", True).alias("color_hex")), TEAM, "left")
    else:
        rows = rows.withColumn("color_hex", F.lit(None).cast("string"))
    col = F.col
    ratio = lambda a, b, digits, scale=1.0: F.round(F.coalesce(F.try_divide(scale * a, b), F.lit(0.0)), digits)
    ball_rows = col("third0") + col("third1") + col("third2")
    defends = lambda c: F.when(col(c) > 0, "left").otherwise("right")
    count = lambda c: col(c).cast("long").alias(c)
    return rows.select(
        *TEAM, "color_hex", defends("first").alias("defends_first_half"), defends("last").alias("defends_second_half"),
        F.round(F.try_divide(100.0 * col("own"), col("known")), 1).alias("possession_pct"), count("passes"), col("complete").cast("long").alias("passes_completed"),
        ratio(col("complete"), col("passes"), 1, 100.0).alias("pass_accuracy_pct"), count("shots"), col("on_target").cast("long").alias("shots_on_target"), count("goals"), count("corners"), count("touches"),
        *[ratio(col(f"third{i}"), ball_rows, 1, 100.0).alias(f"{name}_pct") for i, name in enumerate(("own", "middle", "attack"))],
        ratio(col("metres") * hz, col("steps"), 2).alias("avg_speed_mps"), F.round("metres", 1).alias("distance_m"), col("players").cast("long").alias("players_tracked"),
        ratio(col("held_speed"), col("held"), 2).alias("ball_speed_mean_mps"), ratio(col("ahead"), col("moved"), 2).alias("progression_mps"),
        ratio(col("passes") * 60.0 * hz / every, col("own"), 2).alias("passes_per_minute"))


def catalogue_values(documents: DataFrame) -> DataFrame:
    """(match_id, side, key, value): documents under the catalogue's keys, team 0 at home. Saves come from the events."""
    keys = {"goals": "goals", "possession": "possession_pct", "total_shots": "shots", "shots_on_target": "shots_on_target", "total_passes": "passes", "pass_accuracy": "pass_accuracy_pct", "corners": "corners"}
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("double").alias("value")) for k, c in keys.items()])
    return documents.select("match_id", F.when(F.col("team") == 0, "home").otherwise("away").alias("side"), F.explode(pairs).alias("p")).select("match_id", "side", "p.*")


def document_quality(kin: DataFrame, ball: DataFrame, owned: DataFrame, touched: DataFrame, every: int = 5, hz: float = HZ) -> DataFrame:
    """One row a match: how far its figures can be trusted; shares in per cent, 0 where there is nothing to share."""
    flag = lambda c: c.cast("double")
    parts = [
        kin.select("match_id", F.lit(1.0).alias("samples"), flag(F.col("team").isin(0, 1)).alias("labelled")),
        ball.select("match_id", F.lit(1.0).alias("steps"), flag(F.col("visible")).alias("seen")),
        owned.select("match_id", flag(F.col("code") != -3).alias("playing"), *[flag(c).alias(n) for n, c in (("known", F.col("code") >= 0), ("unknown", F.col("code") == -1), ("contested", F.col("code") == -2))]),
        touched.select("match_id", F.lit(1.0).alias("touches")),
    ]
    table = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sums = table.groupBy("match_id").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in table.columns if c != "match_id"])
    share = lambda a, b, name: F.round(F.coalesce(F.try_divide(100.0 * F.col(a), F.col(b)), F.lit(0.0)), 1).alias(name)
    return sums.select(
        "match_id", share("labelled", "samples", "team_label_coverage_pct"), share("seen", "steps", "ball_coverage_pct"), F.round(F.col("playing") * every / hz, 1).alias("in_play_s"),
        *[share(c, "playing", f"possession_{c}_pct") for c in ("known", "unknown", "contested")], F.col("touches").cast("long").alias("touches_detected"))


def between(before: Column, after: Column, t: Column, longest: float, near: float) -> Column:
    """A struct (x, y) on the path from one sample (t, x, y) to the next; null in a gap and off the ends unless a sample is near."""
    part = F.when(after["t"] > before["t"], (t - before["t"]) / (after["t"] - before["t"])).otherwise(0.0)
    apart = F.least(t - before["t"], after["t"] - t)
    place = lambda c: before[c] + part * (after[c] - before[c])
    at = lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))
    return F.when(before.isNull(), F.when(after["t"] - t <= near, at(after))).when(after.isNull(), F.when(t - before["t"] <= near, at(before))).when(
        (after["t"] - before["t"] <= longest) | (apart <= near), F.struct(place("x").alias("x"), place("y").alias("y")))


def event_places(events: DataFrame, ball: DataFrame, homography: DataFrame | None = None, longest: float = 1.25, near: float = 0.14) -> DataFrame:
    """``events`` with ball_x, ball_y (one decimal) and pitch_x, pitch_y (two): what is noted, else the ball then, else the event's own place.

    ``events`` has match_id, t, noted_x, noted_y, own_x, own_y (null where unknown); ``ball`` is (match_id, t, x, y) and may
    repeat a time, of which the least place counts; ``homography`` is (match_id, homography), a 3x3 matrix column. One
    union and two windows a match put each event between its neighbours. Null where no place is known or none on the pitch.
    """
    path = ball.groupBy("match_id", "t").agg(F.min(F.struct("x", "y")).alias("p")).select("match_id", "t", F.struct("t", "p.x", "p.y").alias("_ball"))
    rows = events.select("match_id", "t", F.struct(*events.columns).alias("_event")).unionByName(path, allowMissingColumns=True)
    is_ball = F.col("_ball").isNotNull()
    ahead = Window.partitionBy("match_id").orderBy("t", is_ball).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("match_id").orderBy(F.desc("t"), is_ball.desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_before": F.last("_ball", ignorenulls=True).over(ahead), "_after": F.last("_ball", ignorenulls=True).over(behind)}).where("_event IS NOT NULL")
    rows = rows.withColumn("_at", between(F.col("_before"), F.col("_after"), F.col("t"), longest, near)).select("_event.*", "_at")
    noted, own = F.col("noted_x").isNotNull() & F.col("noted_y").isNotNull(), F.col("own_x").isNotNull() & F.col("own_y").isNotNull()
    rows = rows.withColumns({f"_{c}": F.when(noted, F.col(f"noted_{c}")).when(F.col("_at").isNotNull(), F.col("_at")[c]).when(own, F.col(f"own_{c}")) for c in ("x", "y")})
    if homography is None:
        pitch = (F.lit(None).cast("double"), F.lit(None).cast("double"))
    else:
        rows = rows.join(homography.select("match_id", "homography"), "match_id", "left")
        pitch = exprs.project(F.col("homography"), F.col("_x"), F.col("_y"))
    return rows.select(*events.columns, F.round("_x", 1).alias("ball_x"), F.round("_y", 1).alias("ball_y"), F.round(pitch[0], 2).alias("pitch_x"), F.round(pitch[1], 2).alias("pitch_y"))
