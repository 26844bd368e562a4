"""Goals from several signals: what the ball does at a goal, and what play, players and the crowd do afterwards.

``ball_signals`` finds line crossings, balls at rest behind the line and balls that vanish on their way into the mouth,
with windows over one match's ball. Signals of one goal chain into a candidate while they follow the furthest end so far
within a few seconds. ``corroborated`` joins candidates by time with kick-offs, players, crowd peaks and later sightings;
``match.judge_goals`` weighs them. Positions are metres from the centre spot, ``ball`` is (match_id, t, x, y) of seen samples.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators import timeseries as ts

MATCH, SIDE = ["match_id"], ["match_id", "side"]


@dataclass(frozen=True)
class Rules:
    """Lengths in metres, times in seconds; shares are of the pitch's length, speeds of frame widths a second. Fixed values."""

    length: float = 105.0
    frame_width: float = 105.0
    mouth: float = 3.66  # half of it
    margin_share: float = 0.06  # of the mouth, beyond each post
    box_depth: float = 3.0
    step_s: float = 0.5  # longer steps aren't a path
    entry_speed: float = 1.0
    rebound_s: float = 1.5
    rebound_share: float = 0.02
    box_gap_s: float = 1.5
    entered_s: float = 1.0
    dwell_s: float = 0.3
    dwell_samples: int = 3
    dwell_speed: float = 0.2
    gap_s: float = 1.25
    lookback_s: float = 0.7
    shot_speed: float = 0.25
    ahead_s: float = 0.8
    gone_s: float = 2.0
    chain_s: float = 4.0
    leading_s: float = 1.5
    reappear_s: float = 3.0
    far_share: float = 0.30
    kickoff_search_s: float = 60.0
    spot_share: float = 0.06
    rest_share: float = 0.012
    rest_s: float = 0.5
    absent_s: float = 1.0
    open_speed: float = 0.15
    open_s: float = 1.5
    halves_majority: float = 0.75
    halfway_share: float = 0.03
    least_players: int = 3
    peak_s: float = 4.0
    strong_base: float = 0.55
    weak_base: float = 0.40
    more_strong: float = 0.25
    more_weak: float = 0.17

    @property
    def line(self) -> float:
        return self.length / 2

    @property
    def loose(self) -> float:
        return self.mouth * (1 + 2 * self.margin_share)


def by_side(rows: DataFrame) -> DataFrame:
    """Rows for each goal, with ``along``: the distance from the centre spot towards it."""
    sides = F.array(F.struct(F.lit("left").alias("side"), F.lit(-1).alias("sign")), F.struct(F.lit("right").alias("side"), F.lit(1).alias("sign")))
    return rows.withColumn("_s", F.explode(sides)).select(*rows.columns, "_s.side", "_s.sign").withColumn("along", F.col("x") * F.col("sign"))


def band(y: Column, rules: Rules) -> Column:
    """True between the posts, false in the margin beside them, else null."""
    return F.when(F.abs(y) <= rules.mouth, True).when(F.abs(y) <= rules.loose, False)


def around(keys: list[str], before_s: float, after_s: float):
    """The rows of a key from ``before_s`` seconds before each to ``after_s`` after it; range frames want integers, so in microseconds."""
    return Window.partitionBy(*keys).orderBy(F.rint(F.col("t") * 1e6).cast("long")).rangeBetween(-round(before_s * 1e6), round(after_s * 1e6))


def _signal(kind: str, strong: Column, t: Column, t_end: Column) -> list[Column]:
    return ["match_id", "side", F.lit(kind).alias("kind"), strong.alias("strong"), t.alias("t"), t_end.alias("t_end")]


def crossings(ball: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The seen ball goes over a goal line into the goal; strong between the posts unless it comes back onto the field."""
    w = Window.partitionBy(*SIDE).orderBy("t")
    after = around(SIDE, 0, rules.rebound_s)
    rows = by_side(ball).withColumns({f"was_{c}": F.lag(c).over(w) for c in ("t", "along", "y")}).withColumn("back", F.min("along").over(after))
    dt = F.col("t") - F.col("was_t")
    share = (rules.line - F.col("was_along")) / (F.col("along") - F.col("was_along"))
    at, y = F.col("was_t") + share * dt, F.col("was_y") + share * (F.col("y") - F.col("was_y"))
    over = (F.col("was_along") <= rules.line) & (F.col("along") > rules.line) & (dt <= rules.step_s)
    fast = (F.col("along") - F.col("was_along")) / F.greatest(dt, F.lit(1e-3)) >= rules.entry_speed
    rows = rows.where(over & fast).withColumns({"at": at, "between": band(y, rules)}).where("between IS NOT NULL")
    return rows.select(*_signal("line_crossing", F.col("between") & (F.col("back") >= rules.line - rules.rebound_share * rules.length), F.col("at"), F.col("at")))


def in_box(ball: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Runs of samples behind the line that came from the field; strong when the net stops the ball between the posts."""
    w = Window.partitionBy(*SIDE).orderBy("t")
    near = around(SIDE, rules.step_s, rules.step_s)
    span = F.last("t").over(near) - F.first("t").over(near)
    rows = by_side(ball).withColumns({
        "was_t": F.lag("t").over(w), "was_along": F.lag("along").over(w), "pace": F.when(span > 1e-6, (F.last("along").over(near) - F.first("along").over(near)) / span).otherwise(0.0),
        "step": F.when(F.col("t") - F.lag("t").over(w) <= rules.step_s, F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) / F.greatest(F.col("t") - F.lag("t").over(w), F.lit(1e-3))),
        "on_field": F.sum((F.col("along") < rules.line).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    inside = rows.where(F.col("along").between(rules.line, rules.line + rules.box_depth) & (F.abs("y") <= rules.loose))
    new = (F.col("t") - F.lag("t").over(w) > rules.box_gap_s) | (F.col("on_field") != F.lag("on_field").over(w))
    inside = inside.withColumn("new", F.coalesce(new, F.lit(True))).withColumn("run", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    entered = (F.col("pace") > rules.entry_speed) | F.coalesce((F.col("t") - F.col("was_t") <= rules.entered_s) & (F.col("was_along") < rules.line), F.lit(False))
    runs = inside.groupBy(*SIDE, "run").agg(
        F.min("t").alias("t"), F.max("t").alias("t_end"), F.count(F.lit(1)).alias("n"), F.avg((F.abs("y") <= rules.mouth).cast("int")).alias("share"),
        F.median(F.when(~F.col("new"), F.col("step"))).alias("speed"), F.min_by(entered, "t").alias("entered")).where("entered")
    held = (F.col("t_end") - F.col("t") >= rules.dwell_s) & (F.col("n") >= rules.dwell_samples) & F.coalesce(F.col("speed") <= rules.dwell_speed * rules.frame_width, F.lit(False))
    return runs.select(*_signal("in_goal_box", held & (F.col("share") >= 0.5), F.col("t"), F.col("t_end")))


def vanished(ball: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The ball is lost while it flies at a mouth; strong when it stays away, weak after a short gap or at the recording's end."""
    w = Window.partitionBy(*SIDE).orderBy("t")
    back = around(SIDE, rules.lookback_s + 0.05, 0)
    span = F.col("t") - F.first("t").over(back)
    speed = lambda c: F.when(span > 1e-6, (F.col(c) - F.first(c).over(back)) / span).otherwise(0.0)
    rows = by_side(ball).withColumns({"next_t": F.lead("t").over(w), "was_t": F.lag("t").over(w), "va": speed("along"), "vy": speed("y")})
    rows = rows.where("was_t IS NOT NULL").withColumn("gap", F.col("next_t") - F.col("t")).where(F.col("gap").isNull() | (F.col("gap") > rules.gap_s))
    left = (rules.line - F.col("along")) / F.col("va")
    rows = rows.where((F.hypot("va", "vy") >= rules.shot_speed * rules.frame_width) & (F.col("va") > 1e-6)).withColumn("left", left).where(F.col("left").between(0, rules.ahead_s))
    rows = rows.withColumn("between", band(F.col("y") + F.col("vy") * F.col("left"), rules)).where("between IS NOT NULL")
    at = F.col("t") + F.least("left", F.coalesce("gap", F.lit(0.0)))
    return rows.select(*_signal("vanished_into_mouth", F.col("between") & F.coalesce(F.col("gap") >= rules.gone_s, F.lit(False)), at, at))


def ball_signals(ball: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(match_id, side, kind, strong, t, t_end)."""
    return crossings(ball, rules).unionByName(in_box(ball, rules)).unionByName(vanished(ball, rules))


def clustered(signals: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(match_id, side, t, t_last, base, strong, kinds, reached_mouth): signals chained on the furthest end so far.

    The time is that of the first strong signal, else of the first; with a ball held by the net it is the last crossing
    that led there.
    """
    w = Window.partitionBy(*SIDE).orderBy("t", "t_end", "kind")
    reach = F.max("t_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    chained = signals.withColumn("_new", F.when(F.col("t") - reach <= rules.chain_s, 0).otherwise(1)).withColumn("chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of = lambda kind, strong=True: (F.col("kind") == kind) & (F.col("strong") if strong else F.lit(True))
    kinds = ("line_crossing", "in_goal_box", "vanished_into_mouth")
    rows = chained.groupBy(*SIDE, "chain").agg(
        F.min("t").alias("first"), F.min(F.when(F.col("strong"), F.col("t"))).alias("first_strong"), F.max("t_end").alias("t_last"), F.min(F.when(of("in_goal_box"), F.col("t"))).alias("net"),
        F.collect_list(F.when(of("line_crossing", False), F.col("t"))).alias("crossed"), *[F.max(of(k).cast("int")).alias(f"strong_{k}") for k in kinds], *[F.max(of(k, False).cast("int")).alias(f"has_{k}") for k in kinds])
    led = F.array_max(F.filter("crossed", lambda t: (F.col("net") - t).between(0, rules.leading_s)))
    n_strong, n = sum(F.col(f"strong_{k}") for k in kinds), sum(F.col(f"has_{k}") for k in kinds)
    strong = n_strong > 0
    base = F.when(strong, rules.strong_base + rules.more_strong * (n_strong - 1) + rules.more_weak * (n - n_strong)).otherwise(rules.weak_base + rules.more_weak * (n - 1))
    return rows.select(
        *SIDE, F.when(F.col("net").isNotNull(), F.coalesce(led, "net")).otherwise(F.coalesce("first_strong", "first")).alias("t"), "t_last", F.round(base, 6).alias("base"), strong.alias("strong"),
        n.cast("int").alias("kinds"), ((F.col("has_line_crossing") + F.col("has_in_goal_box")) > 0).alias("reached_mouth"))


def kickoffs(ball: DataFrame, candidates: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(match_id, side, t, kickoff_t): the ball appears or rests on the centre spot before open play goes on elsewhere."""
    w = Window.partitionBy("match_id").orderBy("t")
    away = F.hypot("x", "y")
    spot = away <= rules.spot_share * rules.length
    before = F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(float("inf")))
    coming = F.collect_list(F.struct("t", "x", "y")).over(around(MATCH, 0, rules.rest_s + rules.step_s))
    # the samples up to the first that is rest_s later: near the first one, in small steps
    steps = F.aggregate(
        F.col("coming"), F.struct(F.col("t").alias("last"), F.lit(True).alias("fine"), F.lit(False).alias("done")),
        lambda a, s: F.when(a["done"] | ~a["fine"], a).otherwise(F.struct(
            s["t"].alias("last"), ((s["t"] - a["last"] <= rules.step_s) & (F.hypot(s["x"] - F.col("x"), s["y"] - F.col("y")) <= rules.rest_share * rules.frame_width)).alias("fine"),
            (s["t"] - F.col("t") >= rules.rest_s).alias("done"))), lambda a: a["fine"] & a["done"])
    marks = ball.withColumns({"before": before, "spot": spot}).withColumn("coming", F.when(F.col("spot") & (F.col("before") < rules.absent_s), coming)).where("spot")
    marks = marks.where((F.col("before") >= rules.absent_s) | steps).select("match_id", F.col("t").alias("mark"))
    spans = candidates.select(*SIDE, "t", (F.col("t_last") + 0.5).alias("from_t"), (F.col("t_last") + 0.5 + rules.kickoff_search_s).alias("to_t"))
    first = ts.range_join(marks, spans, MATCH, "mark", "from_t", "to_t", rules.kickoff_search_s, closed=True, nulls=False).groupBy(*SIDE, F.col("t"), "from_t").agg(F.min("mark").alias("kickoff_t"))
    step = F.when(F.col("t") - F.lag("t").over(w) <= rules.step_s, F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) / F.greatest(F.col("t") - F.lag("t").over(w), F.lit(1e-3)))
    moving = by_side(ball.withColumn("open", F.coalesce(step >= rules.open_speed * rules.frame_width, F.lit(False)) & ~spot))
    moving = moving.withColumn("open", F.col("open") & (F.abs(F.col("along") - rules.line) > rules.far_share * rules.length))
    runs = ts.islands_by_value(moving, SIDE, ["t"], F.col("open")).where("open").groupBy(*SIDE, "island").agg(F.min("t").alias("open_from"), F.max("t").alias("open_to")).where(F.col("open_to") - F.col("open_from") >= rules.open_s)
    resumed = first.join(runs, SIDE).where((F.greatest("open_from", "from_t") + rules.open_s <= F.col("open_to")) & (F.greatest("open_from", "from_t") + rules.open_s < F.col("kickoff_t")))
    return first.join(resumed.select(*SIDE, "t").distinct(), [*SIDE, "t"], "left_anti").select(*SIDE, "t", "kickoff_t")


def _players_at(kin: DataFrame, asked: DataFrame, at: str, within: Column | float, by: list[str] | None = None, bucket: float = 2.0) -> DataFrame:
    """Each player's sample nearest to ``at``, within seconds of it: ``asked`` (one row for each ``by``, side and t) with track_id, team, x, y."""
    spans = asked.withColumns({"_lo": F.col(at) - within, "_hi": F.col(at) + within}).withColumnRenamed("t", "cand_t")
    rows = ts.range_join(kin.select("match_id", "grid_t", "track_id", "team", "x", "y").where("team IN (0, 1)"), spans, MATCH, "grid_t", "_lo", "_hi", bucket, closed=True, nulls=False)
    asking = [*SIDE, *(by or [])]
    near = rows.groupBy(*asking, "cand_t", "track_id").agg(
        F.min_by(F.struct("team", "x", "y", *[c for c in asked.columns if c not in (*asking, "t")]), F.struct(F.abs(F.col("grid_t") - F.col(at)), "grid_t")).alias("r"))
    return near.select(*asking, F.col("cand_t").alias("t"), "track_id", "r.*")


def lined_up(kin: DataFrame, kicked: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(match_id, side, t, kickoff): "players" with both teams in their own halves, "rejected" if not, "ball_only" with too few in sight."""
    rows = _players_at(kin, kicked, "kickoff_t", 1.0)
    slack = rules.halfway_share * rules.length
    part = lambda team, left: F.avg(F.when(F.col("team") == team, ((F.col("x") <= slack) if left else (F.col("x") >= -slack)).cast("int")))
    seen = rows.groupBy(*SIDE, "t").agg(*[F.count_if(F.col("team") == k).alias(f"n{k}") for k in (0, 1)], *[part(k, left).alias(f"{'l' if left else 'r'}{k}") for k in (0, 1) for left in (True, False)])
    half = lambda k: F.when((F.col(f"l{k}") >= rules.halves_majority) & (F.col(f"l{k}") >= F.col(f"r{k}")), "left").when(F.col(f"r{k}") >= rules.halves_majority, "right")
    apart = F.coalesce(half(0) != half(1), F.lit(False))
    enough = (F.col("n0") >= rules.least_players) & (F.col("n1") >= rules.least_players)
    judged = seen.select(*SIDE, "t", F.when(~enough, "ball_only").when(apart, "players").otherwise("rejected").alias("kickoff"))
    return kicked.join(judged, [*SIDE, "t"], "left").select(*SIDE, "t", F.coalesce("kickoff", F.lit("ball_only")).alias("kickoff"))


def celebrations(kin: DataFrame, candidates: DataFrame, signs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(match_id, side, t, spread_ratio): how far apart the scoring team is five seconds later, against just before."""
    from pitchlake.operators.match import with_sign

    sign = F.when(F.col("side") == "right", 1).otherwise(-1)
    scorers = with_sign(candidates.select(*SIDE, "t", sign.alias("sign")), signs, "t", by="sign").select(*SIDE, "t", F.col("team").alias("scorers"))

    # both times in one join with the players: from a second before, and from two to eight seconds after
    times = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.col("t") + shift).alias("at"), F.lit(within).alias("within")) for name, shift, within in (("before", -1.0, 1.0), ("after", 5.0, 3.0))]))
    asked = scorers.withColumn("_when", times).select(*SIDE, "t", "scorers", "_when.*")
    rows = _players_at(kin, asked, "at", F.col("within"), ["name"], 6.0).where("team = scorers")
    middle = Window.partitionBy(*SIDE, "t", "name")
    rows = rows.withColumn("d", F.hypot(F.col("x") - F.avg("x").over(middle), F.col("y") - F.avg("y").over(middle)))
    spread = rows.groupBy(*SIDE, "t", "name").agg(F.avg("d").alias("d"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= rules.least_players)
    both = spread.groupBy(*SIDE, "t").agg(*[F.max(F.when(F.col("name") == name, F.col("d"))).alias(name) for name in ("before", "after")]).where("after IS NOT NULL")
    return both.where("before > 1e-6").select(*SIDE, "t", (F.col("after") / F.col("before")).alias("spread_ratio"))


def corroborated(ball: DataFrame, candidates: DataFrame, kin: DataFrame, signs: DataFrame, peaks: DataFrame | None = None, rules: Rules = Rules(), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``candidates`` with what ``match.judge_goals`` weighs: kickoff, have_tracks, peak, spread_ratio, independent, reappeared."""
    keys = [*SIDE, "t"]
    spans = candidates.select(*SIDE, "t", (F.col("t") + rules.reappear_s).alias("until"))
    seen = ts.range_join(ball.select("match_id", F.col("t").alias("at"), "x"), spans, MATCH, "at", "t", "until", rules.reappear_s, closed=True, nulls=False)
    sign = F.when(F.col("side") == "right", 1).otherwise(-1)
    back = seen.where((F.col("at") > F.col("t")) & (F.abs(F.col("x") * sign - rules.line) > rules.far_share * rules.length)).select(*keys).distinct().withColumn("reappeared", F.lit(True))
    kicked = keep(kickoffs(ball, candidates, rules))
    tracked = kin.where("team IN (0, 1)").groupBy("match_id").agg(F.lit(True).alias("have_tracks"))
    rows = candidates.join(back, keys, "left").join(lined_up(kin, kicked, rules), keys, "left").join(celebrations(kin, candidates, signs, rules), keys, "left").join(tracked, "match_id", "left")
    if peaks is None:
        rows = rows.withColumn("peak", F.lit(None).cast("double"))
    else:
        spans = candidates.select(*SIDE, "t", (F.col("t") - rules.peak_s).alias("lo"), (F.col("t") + rules.peak_s).alias("hi"))
        loud = ts.range_join(peaks, spans, MATCH, "peak_t", "lo", "hi", 2 * rules.peak_s, closed=True).groupBy(*keys).agg(F.max("strength").alias("peak"))
        rows = rows.join(loud, keys, "left")
    independent = F.col("kinds") + F.coalesce(F.col("kickoff") == "players", F.lit(False)).cast("int")
    return rows.withColumn("independent", independent).fillna(False, ["reappeared", "have_tracks"])


def goal_events(ball: DataFrame, kin: DataFrame, signs: DataFrame, peaks: DataFrame | None = None, rules: Rules = Rules(), apart_s: float = 25.0, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(match_id, side, t, confidence, verdict, kinds, kickoff, spread_ratio, peak): goals ``apart_s`` apart, the more confident staying, and rejected candidates.

    ``keep`` is applied to the candidates, before and after they are judged: each is used many times, and a plan that holds
    their windows dozens of times is more than a driver's memory.
    """
    from pitchlake.operators.match import judge_goals

    found = keep(clustered(ball_signals(ball, rules), rules))
    judged = keep(judge_goals(corroborated(ball, found, kin, signs, peaks, rules, keep)))
    rows = judged.select(*SIDE, "t", "confidence", "verdict", "kinds", "kickoff", "spread_ratio", "peak")
    kept = ts.best_apart(rows.where("verdict = 'goal'"), SIDE, "t", "confidence", apart_s)
    return kept.unionByName(rows.where("verdict <> 'goal'"))
