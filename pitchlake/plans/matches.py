"""Match analytics over the driver's events: sequential operators that SQL doesn't express, so rows only.

A match is the month of 22 users, and its events in order are moments of play two seconds apart: the ball goes to the event's
user, who passes it on. So matches grow in number with the users and each stays bounded. Every event gives its user's samples
around the moment and the ball's path to the next one. By the event's type the ball is lost for a while (error), lies still
and is kicked (signup), goes into a goal (purchases above 60) or just goes on.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.operators import camera_plan, match, tracking
from pitchlake.plans.registry import query
from pitchlake.plans.tables import tracks
from pitchlake.sources.working import kept

CROWD, PACE = 22, 2.0
#: Events that one task spreads into samples, first few and then, from ``TASKS`` tasks on, more: tasks grow in number with the events.
EVENTS_A_TASK, MOST_A_TASK, TASKS = 5_000, 20_000, 48


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, track_id, team, t, x, y, event_id, state): one row for each player and time, the least event of them."""
    rows = tracks(spark, sf_dir).select(
        F.floor(F.col("track") / CROWD).alias("match_id"), (F.col("track") % CROWD).cast("int").alias("track_id"), (F.col("track") % 2).cast("int").alias("team"),
        (F.col("us") / 3600e6 - 473_352).alias("t"), (F.col("x") - 50.0).alias("x"), (F.col("y") * 0.7 - 35.0).alias("y"), "event_id", "state")
    same = rows.groupBy("match_id", "track_id", "t").agg(F.min_by(F.struct("team", "x", "y", "event_id", "state"), "event_id").alias("r"))
    return same.select("match_id", "track_id", "t", "r.*")


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, track_id, team, at, hx, hy, state, value, to_x, to_y): each event as a moment of play, with the next one's place."""
    w = Window.partitionBy("match_id").orderBy("t", "event_id")
    rows = tracks(spark, sf_dir).select(F.floor(F.col("track") / CROWD).alias("match_id"), (F.col("track") % CROWD).cast("int").alias("track_id"), "us", "x", "y", "event_id", "state").withColumnsRenamed({"us": "t", "x": "value", "y": "k"})
    team = F.col("track_id") % 2
    rows = rows.withColumn("team", team).withColumn("at", F.row_number().over(w) * PACE)
    # homes all over the pitch, a team's a little on its own side, moved by the event's own number
    rows = rows.withColumn("hx", F.lit(-42.0) + F.col("track_id") * 5 % CROWD * 4 - F.when(team == 0, 5).otherwise(-5) + F.col("k") % 7 - 3.0)
    rows = rows.withColumn("hy", F.lit(-29.0) + F.col("track_id") * 7 % CROWD * 2.7 + F.col("k") % 5 - 2.0)
    return rows.withColumns({"to_x": F.lead("hx").over(w), "to_y": F.lead("hy").over(w)}).drop("t", "k")


def _players(rows: DataFrame, rate: int = 5) -> DataFrame:
    """Each user for a second before and after its moments, walking through the place; ``rate`` samples a second."""
    steps = rows.select("match_id", "track_id", "team", "at", "hx", "hy", F.explode(F.sequence(F.lit(-rate), F.lit(rate))).alias("i")).withColumn("i", F.col("i") / rate)
    t = F.round(F.col("at") + F.col("i"), 1)
    walked = steps.select("match_id", "track_id", "team", t.alias("t"), (F.col("hx") + F.col("i") * 1.5).alias("x"), (F.col("hy") + F.col("i") * 0.5).alias("y"), "at")
    once = walked.groupBy("match_id", "track_id", "t").agg(F.min_by(F.struct("team", "x", "y"), "at").alias("r"))
    return once.select("match_id", "track_id", "r.team", "t", "r.x", "r.y")


def _ball(rows: DataFrame) -> DataFrame:
    """The ball ten times a second from each moment's place to the next."""
    goal = (F.col("state") == "purchase") & (F.col("value") > 60)
    side = F.when(F.col("hx") < 0, -1.0).otherwise(1.0)
    steps = rows.where("to_x IS NOT NULL").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19))))
    lie = F.when(F.col("state") == "signup", 14).otherwise(2)
    share = F.greatest(F.lit(0.0), (F.col("i") - lie) / (20.0 - lie))
    shot = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("i") - 2) / 8.0))

    def place(home: str, to: str, net: Column) -> Column:
        return F.when(goal, F.col(home) + (net - F.col(home)) * shot).otherwise(F.col(home) + (F.col(to) - F.col(home)) * share)

    hidden = (F.col("state") == "error") & F.col("i").between(3, 18)
    return steps.where(~hidden).select("match_id", F.round(F.col("at") + F.col("i") / 10, 1).alias("t"), place("hx", "to_x", side * 54.0).alias("x"), place("hy", "to_y", F.col("value") % 4 - 2.0).alias("y"))


def _tasks(rows: DataFrame) -> int:
    n = rows.count()
    return max(n // MOST_A_TASK, min(n // EVENTS_A_TASK, TASKS)) + 1


def _part(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = kept(moments(spark, sf_dir))
        n = _tasks(rows)
        # dealt before they are spread into samples, a twentieth of the rows to shuffle; what is kept stays dealt
        players, ball = (spread(rows.repartition(n, "match_id")) for spread in (_players, _ball))
        halves = players.groupBy("match_id").agg((F.max("t") / 2).alias("half_s"))
        return match.analyse(players, ball, halves=halves, keep=functools.partial(kept, by="match_id", tasks=n), only=[name])[name]

    run.__name__ = f"match_{name}"
    return query()(run)


for _name in ("segments", "goals", "goal_candidates", "touches", "passes", "shots", "flight_shots", "set_pieces", "dribbles", "turnovers", "events", "player_stats", "team_stats", "momentum", "team_document", "document_quality"):
    _part(_name)


@query()
def match_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera plan of every match at five frames a second; its phases and figures are held in the tests."""
    rows = kept(moments(spark, sf_dir))
    n = _tasks(rows)
    players, ball = (spread(rows.repartition(n, "match_id")) for spread in (_players, _ball))
    px = lambda df: df.withColumns({"x": (F.col("x") + 60) * 16.0, "y": (F.col("y") + 40) * 13.5})
    # only the segments, which are few, are written; players and ball are dealt by match over the same tasks
    states = kept(match.analyse(players, ball, only=["segments"])["segments"])
    spans = players.groupBy("match_id").agg(F.lit(0.0).alias("start_s"), F.max("t").alias("end_s"))
    field = spans.select("match_id", *[F.lit(v).alias(c) for c, v in (("x_min", 120.0), ("x_max", 1800.0), ("y_min", 81.0), ("y_max", 999.0))])
    return camera_plan.plan_camera(spans, px(ball), states, px(players), field, camera_plan.Style(fps=5.0))


@query()
def match_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around every match's players, one frame a second, tracked; ``det`` is the player, whose boxes a track should follow."""
    rows = kept(moments(spark, sf_dir))
    players = _players(rows.repartition(_tasks(rows), "match_id"), 1)
    x, y = (F.col("x") + 60) * 16.0, (F.col("y") + 40) * 13.5
    boxes = players.select("match_id", F.rint("t").cast("int").alias("frame"), F.col("track_id").alias("det"), (x - 60).alias("x1"), (y - 40).alias("y1"), (x + 60).alias("x2"), (y + 40).alias("y2"), F.lit(0.9).alias("conf"))
    return tracking.track(boxes)


def _bound_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir).groupBy("match_id", "t").agg(F.min_by(F.struct("x", "y"), "event_id").alias("p")).select("match_id", "t", "p.*")


@query()
def ball_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.filter_ball(_bound_ball(spark, sf_dir), 105.0, base_gate=20.0)


@query()
def fsm_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.game_states(match.ball_on_grid(_bound_ball(spark, sf_dir), 2.0, 0.5, 1.0))


@query()
def reel_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bound(spark, sf_dir).select(
        "match_id", F.col("event_id").cast("string").alias("event_id"), F.col("state").alias("type"), F.col("t") * 3600, ((F.col("x") + 50) / 500).alias("excitement"),
        ((F.col("y") + 35) / 70).alias("confidence")).toDF("match_id", "event_id", "type", "t", "excitement", "confidence")
    return match.plan_reel(rows.withColumn("t_start", F.col("t") - 60).withColumn("t_end", F.col("t") + 120), 3600.0, ("error",))
