"""Goals, fouls, cards, touches and calibration over the driver's events, each with its SQL; see ``analytics`` for the binding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.functions import exprs
from pitchlake.operators import broadcast, geometry, goals, match
from pitchlake.plans.analytics import BOUND_SQL, SEGMENTS_SQL, bound, segments
from pitchlake.plans.registry import query


@query(f"""
WITH {BOUND_SQL}, ball AS (SELECT match_id, t / 10 AS t, x * 1.2 AS x, y / 8 AS y FROM bound), s AS (SELECT 'left' AS side, -1 AS sign UNION ALL SELECT 'right', 1),
 a AS (SELECT match_id, side, t, x * sign AS along, y, CAST(round_even(t * 1e6, 0) AS BIGINT) AS us FROM ball, s),
 w AS (SELECT *, lag(t) OVER o AS t0, lag(along) OVER o AS a0, lag(y) OVER o AS y0, min(along) OVER (PARTITION BY match_id, side ORDER BY us RANGE BETWEEN CURRENT ROW AND 1500000 FOLLOWING) AS back FROM a WINDOW o AS (PARTITION BY match_id, side ORDER BY t)),
 c AS (SELECT *, t0 + (52.5 - a0) / (along - a0) * (t - t0) AS crossed, y0 + (52.5 - a0) / (along - a0) * (y - y0) AS yc FROM w WHERE a0 <= 52.5 AND along > 52.5 AND t - t0 <= 0.5 AND (along - a0) / greatest(t - t0, 1e-3) >= 1.0)
SELECT match_id, side, round(crossed, 5) AS t, abs(yc) <= 3.66 AND back >= 52.5 - 2.1 AS strong FROM c WHERE abs(yc) <= 3.66 * 1.12
""")
def line_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ball goes over a goal line; tenths of hours stand for seconds."""
    ball = bound(spark, sf_dir).select("match_id", (F.col("t") / 10).alias("t"), (F.col("x") * 1.2).alias("x"), (F.col("y") / 8).alias("y"))
    return goals.crossings(ball).select("match_id", "side", F.round("t", 5).alias("t"), "strong")


KINDS = {"click": "line_crossing", "view": "in_goal_box", "purchase": "vanished_into_mouth"}


@query(f"""
WITH {BOUND_SQL}, s AS (SELECT match_id, CASE team WHEN 0 THEN 'left' ELSE 'right' END AS side, CASE state WHEN 'click' THEN 'line_crossing' WHEN 'view' THEN 'in_goal_box' ELSE 'vanished_into_mouth' END AS kind,
  x > -30 AS strong, t, t + (y + 35) / 70 AS t_end FROM bound WHERE state IN ('click', 'view', 'purchase')),
 f AS (SELECT *, CASE WHEN t - max(t_end) OVER (PARTITION BY match_id, side ORDER BY t, t_end, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 4.0 THEN 0 ELSE 1 END AS fresh FROM s),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY match_id, side ORDER BY t, t_end, kind ROWS UNBOUNDED PRECEDING) AS chain FROM f),
 k AS (SELECT *, min(t) FILTER (kind = 'in_goal_box' AND strong) OVER (PARTITION BY match_id, side, chain) AS net FROM n),
 g AS (SELECT match_id, side, chain, min(t) AS t0, min(t) FILTER (strong) AS ts, max(t_end) AS t_last, max(net) AS net, max(t) FILTER (kind = 'line_crossing' AND net - t BETWEEN 0 AND 1.5) AS led,
  count(DISTINCT kind) AS kinds, count(DISTINCT kind) FILTER (strong) AS ns, bool_or(kind <> 'vanished_into_mouth') AS reached_mouth FROM k GROUP BY 1, 2, 3)
SELECT match_id, side, round(CASE WHEN net IS NOT NULL THEN coalesce(led, net) ELSE coalesce(ts, t0) END, 5) AS t, round(t_last, 5) AS t_last, CAST(kinds AS INT) AS kinds, ns > 0 AS strong, reached_mouth,
 round(CAST(CASE WHEN ns > 0 THEN 0.55 + 0.25 * (ns - 1) + 0.17 * (kinds - ns) ELSE 0.40 + 0.17 * (kinds - 1) END AS DOUBLE), 4) AS base FROM g
""")
def goal_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals chained on the furthest end so far, with what each chain is worth before anything else agrees."""
    kind = F.create_map(*[F.lit(v) for pair in KINDS.items() for v in pair])[F.col("state")]
    rows = bound(spark, sf_dir).where(F.col("state").isin(*KINDS)).select(
        "match_id", F.when(F.col("team") == 0, "left").otherwise("right").alias("side"), kind.alias("kind"), (F.col("x") > -30).alias("strong"), "t", (F.col("t") + (F.col("y") + 35) / 70).alias("t_end"))
    found = goals.clustered(rows)
    return found.select("match_id", "side", F.round("t", 5).alias("t"), F.round("t_last", 5).alias("t_last"), "kinds", "strong", "reached_mouth", F.round("base", 4).alias("base"))


@query(f"""
WITH {BOUND_SQL}, f AS (SELECT match_id, t, x, y, false AS raw FROM bound WHERE track_id < 3), u AS (SELECT * FROM f UNION ALL SELECT match_id, t, x, y, true FROM bound WHERE track_id >= 3),
 n AS (SELECT *, last_value(CASE WHEN NOT raw THEN {{'t': t, 'x': x, 'y': y}} END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY t, raw ROWS UNBOUNDED PRECEDING) AS a,
  first_value(CASE WHEN NOT raw THEN {{'t': t, 'x': x, 'y': y}} END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY t, raw ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM u),
 p AS (SELECT *, CASE WHEN a IS NULL THEN b.x WHEN b IS NULL OR b.t <= a.t THEN a.x ELSE a.x + (t - a.t) / (b.t - a.t) * (b.x - a.x) END AS px,
  CASE WHEN a IS NULL THEN b.y WHEN b IS NULL OR b.t <= a.t THEN a.y ELSE a.y + (t - a.t) / (b.t - a.t) * (b.y - a.y) END AS py, least(coalesce(t - a.t, 1e9), coalesce(b.t - t, 1e9)) AS away FROM n),
 ok AS (SELECT *, raw AND away <= 2.0 AND sqrt(power(x - px, 2) + power(y - py, 2)) <= 32.0 AS fits FROM p),
 g AS (SELECT match_id, count(*) FILTER (NOT raw) >= 3 AND count(*) FILTER (raw) >= 3 AND count(*) FILTER (fits) >= 0.27 * count(*) FILTER (NOT raw) AS take FROM ok GROUP BY 1)
SELECT match_id, count(*) AS samples, round(sum(x), 3) AS sum_x, round(CAST(sum(y) AS DOUBLE), 3) AS sum_y, round(min(t), 5) AS first_t, bool_or(take) AS took_raw FROM ok JOIN g USING (match_id) WHERE CASE WHEN take THEN fits ELSE NOT raw END GROUP BY 1
""")
def touch_ball_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three users of a match are its filtered ball, four the raw one; hours stand for seconds and the gates are wide."""
    rows = bound(spark, sf_dir)
    raw, filtered = rows.where("track_id >= 3"), rows.where("track_id < 3")
    found = match.touch_ball(filtered, raw, 2.0, 32.0, 0.27)
    took = found.join(raw.select("match_id", "t", F.lit(True).alias("raw")), ["match_id", "t"], "left")
    return took.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.sum("x"), 3).alias("sum_x"), F.round(F.sum("y"), 3).alias("sum_y"), F.round(F.min("t"), 5).alias("first_t"), F.coalesce(F.bool_or("raw"), F.lit(False)).alias("took_raw"))


@query(f"""
WITH {BOUND_SQL}, {SEGMENTS_SQL}, peaks AS (SELECT match_id, t AS peak_t, (x + 50) / 500 AS strength FROM bound WHERE state = 'purchase'),
 ev AS (SELECT match_id, t, CASE WHEN track_id < 2 THEN 'shot' WHEN track_id < 5 THEN 'free_kick' ELSE 'sprint' END AS type FROM bound WHERE state = 'signup'),
 ball AS (SELECT match_id, CAST(floor(t) AS BIGINT) AS g, min(x) AS x, min(y) AS y, max(x) / 30 + 1.0 AS speed FROM bound GROUP BY 1, 2), kin AS (SELECT match_id, CAST(floor(t) AS BIGINT) AS g, x, y FROM bound),
 free AS (SELECT * FROM peaks p WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.match_id = p.match_id AND e.type = 'shot' AND e.t BETWEEN p.peak_t - 4 AND p.peak_t + 4)),
 after AS (SELECT match_id, peak_t, unnest(range(CAST(round_even(peak_t + 1, 0) AS BIGINT), CAST(round_even(peak_t + 4, 0) AS BIGINT) + 1)) AS g FROM free),
 st AS (SELECT a.*, b.speed, coalesce((SELECT max_by(s.state, s.start_s) FROM segments s WHERE s.match_id = a.match_id AND s.start_s <= a.g), (SELECT min_by(s.state, s.start_s) FROM segments s WHERE s.match_id = a.match_id), 'in_play') AS state
   FROM after a LEFT JOIN ball b ON a.match_id = b.match_id AND a.g = b.g),
 calm AS (SELECT match_id, peak_t FROM st GROUP BY 1, 2 HAVING avg(CASE WHEN state <> 'in_play' THEN 1.0 ELSE 0.0 END) >= 0.5 OR count(*) FILTER (speed < 1.0) >= 1.5),
 placed AS (SELECT f.*, b.x AS bx, b.y AS by_ FROM free f JOIN calm USING (match_id, peak_t) JOIN ball b ON b.match_id = f.match_id AND b.g = round_even(f.peak_t, 0)),
 c AS (SELECT a.match_id, a.peak_t, a.strength, count(*) FILTER (k.g = round_even(a.peak_t - 1, 0) AND sqrt(power(k.x - bx, 2) + power(k.y - by_, 2)) <= 40) AS before, count(*) FILTER (k.g = round_even(a.peak_t + 2, 0) AND sqrt(power(k.x - bx, 2) + power(k.y - by_, 2)) <= 40) AS after
   FROM placed a LEFT JOIN kin k ON k.match_id = a.match_id AND k.g IN (round_even(a.peak_t - 1, 0), round_even(a.peak_t + 2, 0)) GROUP BY ALL)
SELECT match_id, round(peak_t, 5) AS t, before, after, round(least(0.55::DOUBLE, 0.3 + 0.1 * strength + CASE WHEN EXISTS (SELECT 1 FROM ev e WHERE e.match_id = c.match_id AND e.type = 'free_kick' AND e.t BETWEEN c.peak_t AND c.peak_t + 30) THEN 0.1 ELSE 0 END), 5) AS confidence
FROM c WHERE after >= before + 1
""")
def foul_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are loud moments, sign-ups other events; a grid step is an hour."""
    rows = bound(spark, sf_dir).withColumn("g", F.floor("t").cast("long"))
    peaks = rows.where("state = 'purchase'").select("match_id", F.col("t").alias("peak_t"), ((F.col("x") + 50) / 500).alias("strength"))
    kind = F.when(F.col("track_id") < 2, "shot").when(F.col("track_id") < 5, "free_kick").otherwise("sprint")
    events = rows.where("state = 'signup'").select("match_id", "t", kind.alias("type"))
    ball = rows.groupBy("match_id", "g").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") / 30 + 1.0).alias("speed"))
    found = broadcast.foul_candidates(peaks, events, ball, segments(spark, sf_dir), rows.select("match_id", "g", "x", "y"), radius=40.0, more=1, hz=1.0)
    return found.select("match_id", F.round("t", 5).alias("t"), "before", "after", F.round("confidence", 5).alias("confidence"))


@query(f"""
WITH RECURSIVE {BOUND_SQL}, cards AS (SELECT match_id, t, CASE WHEN state = 'error' THEN 'yellow' ELSE 'red' END AS kind, round((y + 35) / 70, 4) AS confidence, event_id FROM bound WHERE state IN ('error', 'click')),
 n AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY t, kind, confidence) AS i FROM cards),
 r AS (SELECT match_id, i, 1 AS grp, t, kind, confidence, event_id FROM n WHERE i = 1 UNION ALL
  SELECT n.match_id, n.i, CASE WHEN n.kind = r.kind AND n.t - r.t <= 6.0 THEN r.grp ELSE r.grp + 1 END, CASE WHEN n.kind = r.kind AND n.t - r.t <= 6.0 AND n.confidence <= r.confidence THEN r.t ELSE n.t END, n.kind,
   CASE WHEN n.kind = r.kind AND n.t - r.t <= 6.0 AND n.confidence <= r.confidence THEN r.confidence ELSE n.confidence END, CASE WHEN n.kind = r.kind AND n.t - r.t <= 6.0 AND n.confidence <= r.confidence THEN r.event_id ELSE n.event_id END
  FROM r JOIN n ON n.match_id = r.match_id AND n.i = r.i + 1)
SELECT match_id, event_id, kind, confidence FROM (SELECT match_id, grp, max_by(event_id, i) AS event_id, max_by(kind, i) AS kind, max_by(confidence, i) AS confidence FROM r GROUP BY 1, 2) WHERE confidence >= 0.3
""")
def card_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are yellow cards, clicks red ones; one within six hours of the card kept is the same."""
    rows = bound(spark, sf_dir).where("state IN ('error', 'click')").select(
        "match_id", "t", F.when(F.col("state") == "error", "yellow").otherwise("red").alias("kind"), F.round((F.col("y") + 35) / 70, 4).alias("confidence"), "event_id")
    return broadcast.merge_cards(rows, 6.0, 0.3).select("match_id", "event_id", "kind", "confidence")


@query(f"""
WITH {BOUND_SQL}, b AS (SELECT match_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, CASE WHEN match_id % 2 = 0 THEN (min(y) + max(y)) * 0.55 + 3 END AS c FROM bound GROUP BY 1),
 g AS (SELECT *, greatest(c - y0, (y1 - c) * 0.85) AS far FROM b),
 q AS (SELECT match_id, (x0 + x1) / 2 AS cx, coalesce(c - far, y0) AS top, coalesce(far * 1.85 / 0.85, y1 - y0) AS tall, CASE WHEN c IS NULL THEN x1 - x0 ELSE (x1 - x0) / (0.85 + 0.15 * 0.85 / 1.85) END AS near FROM g WHERE x1 - x0 >= 4 AND y1 - y0 >= 4),
 s AS (SELECT match_id, event_id, x - cx AS dx, near, (y - top) / tall AS s, 0.85 + 0.15 * (y - top) / tall AS d FROM bound JOIN q USING (match_id))
SELECT match_id, event_id, round(105.0 * dx / (near * d), 5) AS px, round(68.0 * (s * 1.85 / 2 - 0.85 / 2) / d, 5) AS py FROM s
""")
def calibrated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match has its own homography, in a column."""
    rows = bound(spark, sf_dir)
    bounds = rows.groupBy("match_id").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    centre = F.when(F.col("match_id") % 2 == 0, (F.col("y_min") + F.col("y_max")) * 0.55 + 3)
    both = rows.join(geometry.trapezoid_homography(bounds.withColumn("centre_y", centre)), "match_id")
    px, py = exprs.project(F.col("homography"), F.col("x"), F.col("y"))
    return both.select("match_id", "event_id", F.round(px, 5).alias("px"), F.round(py, 5).alias("py"))
