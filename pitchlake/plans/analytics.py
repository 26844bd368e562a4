"""The match operators themselves over the driver's events, each with its SQL.

Inputs are bound without the ball's and players' grids: a match is seven users' month, hours stand for seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.operators import broadcast, camera, match, stats
from pitchlake.plans.registry import query
from pitchlake.plans.tables import TRACKS_SQL, table, tracks

#: (match_id, t, track_id, team, x, y, state, event_id), in hours and metres; the same in both languages.
BOUND_SQL = f"""{TRACKS_SQL}, bound AS (SELECT CAST(track // 7 AS BIGINT) AS match_id, us / 3600e6 - 473352 AS t, CAST(track % 7 AS INT) AS track_id, CAST(track % 2 AS INT) AS team,
    x - 50.0 AS x, y * 0.7 - 35.0 AS y, state, event_id FROM tracks)"""
SIGNS = (("m.team = 0", 1), ("m.team = 1", -1))


def bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select(
        F.floor(F.col("track") / 7).alias("match_id"), (F.col("us") / 3600e6 - 473_352).alias("t"), (F.col("track") % 7).cast("int").alias("track_id"),
        (F.col("track") % 2).cast("int").alias("team"), (F.col("x") - 50.0).alias("x"), (F.col("y") * 0.7 - 35.0).alias("y"), "state", "event_id")


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir).where("state <> 'error'").select("match_id", "t", "track_id", "team", "x", "y")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half an hour of restart after each error of user 0 of a match."""
    return bound(spark, sf_dir).where("state = 'error' AND track_id = 0").select("match_id", F.col("t").alias("start_s"), (F.col("t") + 0.5).alias("end_s"), F.lit("restart_left").alias("state"), F.lit("left").alias("side"))


SEGMENTS_SQL = "segments AS (SELECT match_id, t AS start_s, t + 0.5 AS end_s, 'restart_left' AS state FROM bound WHERE state = 'error' AND track_id = 0)"
TOUCHED_SQL = "touched AS (SELECT match_id, t, track_id, team, x, y FROM bound WHERE state <> 'error')"


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("state") == "error", -3).when(F.col("x") < -40, -1).otherwise(F.col("team"))
    return bound(spark, sf_dir).select("match_id", "t", code.cast("int").alias("code"), "event_id")


OWNED_SQL = "owned AS (SELECT match_id, t, CAST(CASE WHEN state = 'error' THEN -3 WHEN x < -40 THEN -1 ELSE team END AS INT) AS code, event_id FROM bound)"


def kin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as if they were on a grid; ``g`` numbers a player's samples."""
    w = F.row_number().over(match.Window.partitionBy("match_id", "track_id").orderBy("t", "event_id"))
    rows = bound(spark, sf_dir).withColumn("g", w.cast("long"))
    return rows.select("match_id", "track_id", "team", "g", F.col("t").alias("grid_t"), "x", "y", F.abs(F.col("x") / 10).alias("step"), F.abs(F.col("x") / 5).alias("speed"))


KIN_SQL = """kin AS (SELECT match_id, track_id, team, row_number() OVER (PARTITION BY match_id, track_id ORDER BY t, event_id) AS g, t AS grid_t, x, y, abs(x / 10) AS step, abs(x / 5) AS speed FROM bound)"""


@query(f"""
WITH {BOUND_SQL}, {KIN_SQL}, h AS (SELECT match_id, max(grid_t) / 2 AS half_s FROM kin GROUP BY 1),
 m AS (SELECT match_id, half_s, median(x) FILTER (team = 0 AND grid_t < half_s) AS a0, median(x) FILTER (team = 1 AND grid_t < half_s) AS b0,
   median(x) FILTER (team = 0 AND grid_t >= half_s) AS a1, median(x) FILTER (team = 1 AND grid_t >= half_s) AS b1 FROM kin JOIN h USING (match_id) GROUP BY ALL),
 l AS (SELECT *, CASE WHEN a0 IS NOT NULL AND b0 IS NOT NULL THEN CASE WHEN a0 <= b0 THEN 1 ELSE -1 END END AS l0, CASE WHEN a1 IS NOT NULL AND b1 IS NOT NULL THEN CASE WHEN a1 <= b1 THEN 1 ELSE -1 END END AS l1 FROM m),
 s AS (SELECT match_id, half_s, coalesce(l0, -l1, 1) AS f, coalesce(l1, -l0, -1) AS g FROM l)
SELECT match_id, team, CASE WHEN first THEN f ELSE g END * CASE team WHEN 0 THEN 1 ELSE -1 END AS sign, first, round(half_s, 6) AS half_s
FROM s, (VALUES (0), (1)) AS x(team), (VALUES (true), (false)) AS y(first)
""")
def sides_by_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attacking signs that change at half-time."""
    k = kin(spark, sf_dir)
    signs = match.attack_signs(k, k.groupBy("match_id").agg((F.max("grid_t") / 2).alias("half_s")))
    first = F.col("from_s") == -float("inf")
    return signs.select("match_id", "team", "sign", first.alias("first"), F.round(F.when(first, F.col("to_s")).otherwise(F.col("from_s")), 6).alias("half_s"))


@query(f"""
WITH {BOUND_SQL}, {SEGMENTS_SQL}, d AS (SELECT match_id, max(t) AS duration_s FROM bound GROUP BY 1),
 b AS (SELECT s.match_id, arg_max((s.end_s + s.start_s) / 2, (s.end_s - s.start_s, -(s.end_s + s.start_s) / 2)) AS half_s FROM segments s JOIN d USING (match_id)
   WHERE s.end_s - s.start_s >= 0.4 AND (s.end_s + s.start_s) / 2 BETWEEN 0.3 * duration_s AND 0.7 * duration_s GROUP BY 1)
SELECT d.match_id, round(coalesce(b.half_s, d.duration_s / 2), 4) AS half_s FROM d LEFT JOIN b USING (match_id)
""")
def half_time_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    durations = bound(spark, sf_dir).groupBy("match_id").agg(F.max("t").alias("duration_s"))
    # stops of one length differ by rounding only: their lengths are rounded before the longest is taken
    return match.half_times(segments(spark, sf_dir), durations, 0.4).select("match_id", F.round("half_s", 4).alias("half_s"))


@query(f"""
WITH {BOUND_SQL}, {KIN_SQL}, b AS (SELECT match_id, track_id, team, count(*) / 10.0 AS seconds, sum(step) AS distance_m, quantile_cont(speed, 0.99) AS top_speed, sum(CASE WHEN speed > 5.5 THEN step ELSE 0 END) AS intense_m,
   100.0 * count(*) FILTER (x * CASE team WHEN 0 THEN 1 ELSE -1 END < -17.5) / count(*) AS own_pct,
   100.0 * count(*) FILTER (x * CASE team WHEN 0 THEN 1 ELSE -1 END > 17.5) / count(*) AS attack_pct FROM kin GROUP BY ALL),
 f AS (SELECT *, g - row_number() OVER (PARTITION BY match_id, track_id, team ORDER BY g) AS run FROM kin WHERE speed > 7),
 r AS (SELECT match_id, track_id, team, run, count(*) AS n FROM f GROUP BY ALL HAVING count(*) >= 2), s AS (SELECT match_id, track_id, team, count(*) AS sprints FROM r GROUP BY ALL)
SELECT b.match_id, b.track_id, b.team, seconds, round(distance_m, 3) AS distance_m, round(top_speed, 4) AS top_speed, round(intense_m, 3) AS intense_m, round(own_pct, 1) AS own_pct, round(attack_pct, 1) AS attack_pct,
 coalesce(sprints, 0) AS sprints FROM b LEFT JOIN s USING (match_id, track_id, team)
""")
def player_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kin(spark, sf_dir)
    signs = k.groupBy("match_id").agg(F.count(F.lit(1))).select("match_id", F.explode(F.array(F.struct(F.lit(0).alias("team"), F.lit(1).alias("sign")), F.struct(F.lit(1).alias("team"), F.lit(-1).alias("sign")))).alias("s")).select("match_id", "s.*")
    out = match.player_stats(k, signs, sprint_s=0.2)
    return out.select("match_id", "track_id", "team", "seconds", F.round("distance_m", 3).alias("distance_m"), F.round("top_speed", 4).alias("top_speed"), F.round("intense_m", 3).alias("intense_m"), "own_pct", "attack_pct", "sprints")


@query(f"""
WITH {BOUND_SQL}, {KIN_SQL}, c AS (SELECT match_id, track_id, least(13, CAST(floor((greatest(-34.0, least(34.0, y)) + 34.0) / 68.0 * 14) AS INT)) * 21 + least(20, CAST(floor((greatest(-52.5, least(52.5, x)) + 52.5) / 105.0 * 21) AS INT)) AS cell FROM kin),
 n AS (SELECT match_id, track_id, cell, count(*) AS n FROM c GROUP BY ALL) SELECT match_id, track_id, cell, round(n / sum(n) OVER (PARTITION BY match_id, track_id), 6) AS share FROM n
""")
def heatmap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each player's heat map that hold anything."""
    rows = match.heatmap(kin(spark, sf_dir)).select("match_id", "track_id", F.posexplode(F.flatten("heatmap")).alias("cell", "share"))
    return rows.where("share > 0").select("match_id", "track_id", "cell", F.round("share", 6).alias("share"))


@query(f"""
WITH {BOUND_SQL}, {TOUCHED_SQL}, {SEGMENTS_SQL}, n AS (SELECT *, lead(t) OVER w AS to_t, lead(track_id) OVER w AS to_track_id, lead(team) OVER w AS to_team, lead(x) OVER w AS to_x, lead(y) OVER w AS to_y FROM touched WINDOW w AS (PARTITION BY match_id ORDER BY t, track_id)),
 p AS (SELECT * FROM n WHERE to_track_id <> track_id AND to_t > t AND to_t - t <= 4 AND sqrt((to_x - x) * (to_x - x) + (to_y - y) * (to_y - y)) > 3)
SELECT match_id, round(t, 6) AS t, track_id, to_track_id, team = to_team AS complete FROM p WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.match_id = p.match_id AND s.start_s <= p.to_t AND s.end_s > p.t)
""")
def pass_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.passes(touched(spark, sf_dir), segments(spark, sf_dir))
    return found.select("match_id", F.round("t", 6).alias("t"), "track_id", "to_track_id", "complete")


@query(f"""
WITH {BOUND_SQL}, {TOUCHED_SQL}, {SEGMENTS_SQL}, s AS (SELECT match_id, event_id, t, abs(x) / 10 AS d0, abs(y) / 10 AS d1 FROM bound WHERE track_id = 3),
 a AS (SELECT s.*, t.t AS touch_t, t.team AS touch_team FROM s ASOF LEFT JOIN touched t ON s.match_id = t.match_id AND s.t >= t.t),
 b AS (SELECT a.*, g.start_s FROM a ASOF LEFT JOIN segments g ON a.match_id = g.match_id AND a.t >= g.start_s),
 f AS (SELECT match_id, min(start_s) AS first_s FROM segments GROUP BY 1),
 c AS (SELECT b.*, e.end_s AS stopped FROM b ASOF LEFT JOIN segments e ON b.match_id = e.match_id AND b.t >= e.end_s)
SELECT c.match_id, round(c.t, 6) AS t, CASE WHEN coalesce(start_s, first_s) IS NOT NULL THEN -3 WHEN touch_team IS NULL OR c.t - touch_t > 10 OR coalesce(stopped, -1e9) > touch_t THEN -1 WHEN d0 <= 1.5 AND d1 <= 1.5 THEN -2 ELSE touch_team END AS code
FROM c LEFT JOIN f ON f.match_id = c.match_id
""")
def possession_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = bound(spark, sf_dir).where("track_id = 3").select("match_id", F.lit(0).alias("g"), F.col("t").alias("grid_t"), (F.abs("x") / 10).alias("d0"), (F.abs("y") / 10).alias("d1"))
    return match.possession(near, touched(spark, sf_dir), segments(spark, sf_dir)).select("match_id", F.round("t", 6).alias("t"), "code")


@query(f"""
WITH {BOUND_SQL}, {OWNED_SQL}, p AS (SELECT match_id, round(100.0 * count(*) FILTER (code = 0) / nullif(count(*) FILTER (code >= 0), 0), 1) AS a, round(100.0 * count(*) FILTER (code = 1) / nullif(count(*) FILTER (code >= 0), 0), 1) AS b FROM owned GROUP BY 1),
 s AS (SELECT match_id, 0 AS team, a AS possession_pct FROM p UNION ALL SELECT match_id, 1, b FROM p),
 m AS (SELECT match_id, team, count(*) AS passes, round(100.0 * count(*) FILTER (x > 0) / count(*), 1) AS pass_accuracy FROM bound WHERE state = 'click' GROUP BY ALL)
SELECT s.match_id, s.team, possession_pct, coalesce(passes, 0) AS passes, pass_accuracy FROM s LEFT JOIN m USING (match_id, team)
""")
def team_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = bound(spark, sf_dir).where("state = 'click'").select("match_id", "team", (F.col("x") > 0).alias("complete"))
    return match.team_stats(owned(spark, sf_dir), passed)


@query(f"""
WITH {BOUND_SQL}, {OWNED_SQL}, n AS (SELECT match_id, t, CASE WHEN code >= 0 THEN code END AS team, event_id FROM owned),
 w AS (SELECT *, last_value(team IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was, lead(team) OVER (PARTITION BY match_id ORDER BY t) AS nxt FROM n)
SELECT match_id, round(t, 6) AS t, team FROM w WHERE team <> was AND coalesce(nxt = team, true)
""")
def turnover_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.turnover_events(owned(spark, sf_dir).drop("event_id")).select("match_id", F.round("t", 6).alias("t"), "team")


@query(f"""
WITH {BOUND_SQL}, e AS (SELECT match_id, state AS type, team, track_id, t, t - 0.1 AS t_start, t + 0.2 AS t_end, (x + 50) / 100 AS confidence FROM bound),
 n AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 3 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY match_id, type, team ORDER BY t)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY match_id, type, team ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT match_id, type, team, round(arg_max(t, (confidence, -t)), 6) AS t, arg_max(track_id, (confidence, -t)) AS track_id, round(min(t_start), 6) AS t_start, round(max(t_end), 6) AS t_end, count(*) AS merged FROM i GROUP BY match_id, type, team, island
""")
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bound(spark, sf_dir).select("match_id", F.col("state").alias("type"), "team", "track_id", "t", (F.col("t") - 0.1).alias("t_start"), (F.col("t") + 0.2).alias("t_end"), ((F.col("x") + 50) / 100).alias("confidence"))
    return match.merge_events(e).select("match_id", "type", "team", F.round("t", 6).alias("t"), "track_id", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), "merged")


@query(f"""
WITH {BOUND_SQL}, {OWNED_SQL}, k AS (SELECT match_id, team, t FROM bound WHERE state = 'purchase'), z AS (SELECT match_id, CAST(floor(t / 60) AS BIGINT) AS bin, code, 0.0 AS balance FROM owned UNION ALL SELECT match_id, CAST(floor(t / 60) AS BIGINT), -1, CASE team WHEN 0 THEN 1.0 ELSE -1.0 END FROM k),
 c AS (SELECT match_id, bin, count(*) FILTER (code = 0) AS home, count(*) FILTER (code >= 0) AS known, sum(balance) AS balance FROM z GROUP BY ALL), n AS (SELECT match_id, max(bin) AS m FROM z GROUP BY 1),
 f AS (SELECT match_id, unnest(generate_series(0, m)) AS bin FROM n), d AS (SELECT f.match_id, f.bin, coalesce(home, 0) AS home, coalesce(known, 0) AS known, coalesce(balance, 0) AS balance FROM f LEFT JOIN c USING (match_id, bin)),
 e AS (SELECT a.match_id, a.bin, sum(0.4 * pow(0.6, a.bin - b.bin) * b.balance) AS acc FROM d a JOIN d b ON a.match_id = b.match_id AND b.bin <= a.bin GROUP BY ALL),
 t AS (SELECT *, max(abs(acc)) OVER (PARTITION BY match_id) AS top FROM e)
SELECT d.match_id, d.bin, round(100.0 * home / nullif(known, 0), 1) AS possession_pct, round(CASE WHEN top > 1e-9 THEN acc / top ELSE 0 END, 6) AS momentum FROM d JOIN t USING (match_id, bin)
""")
def momentum_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = bound(spark, sf_dir).where("state = 'purchase'").select("match_id", "team", "t")
    return match.momentum(owned(spark, sf_dir), shots).select("match_id", "bin", "possession_pct", F.round("momentum", 6).alias("momentum"))


@query(f"""
WITH {BOUND_SQL}, {KIN_SQL}, f AS (SELECT *, g - row_number() OVER (PARTITION BY match_id, track_id, team ORDER BY g) AS run FROM kin WHERE speed > 7)
SELECT match_id, track_id, round(min(grid_t), 6) AS t_start, round(max(grid_t), 6) AS t_end, round(least(0.9, 0.5 + (max(speed) - 7) / 10), 6) AS confidence FROM f GROUP BY match_id, track_id, team, run HAVING max(grid_t) - min(grid_t) + 0.1 >= 1.5
""")
def sprint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.sprint_events(kin(spark, sf_dir)).select("match_id", "track_id", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), F.round("confidence", 6).alias("confidence"))


@query(f"""
WITH {BOUND_SQL}, k AS (SELECT match_id, t AS touch_t, team, track_id FROM bound WHERE state = 'click'), g AS (SELECT match_id, t AS goal_t, CASE WHEN x < 0 THEN -1 ELSE 1 END AS sign FROM bound WHERE state = 'error'),
 o AS (SELECT match_id, goal_t, CASE sign WHEN 1 THEN 0 ELSE 1 END AS team FROM g), a AS (SELECT o.*, k.touch_t, k.track_id FROM o ASOF LEFT JOIN k ON o.match_id = k.match_id AND o.team = k.team AND o.goal_t >= k.touch_t)
SELECT match_id, team, round(CASE WHEN goal_t - touch_t <= 8 THEN touch_t ELSE goal_t END, 6) AS t, CASE WHEN goal_t - touch_t <= 8 THEN track_id END AS track_id FROM a
""")
def inferred_goal_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shots of goals that no touch claims."""
    b = bound(spark, sf_dir)
    goals = b.where("state = 'error'").select("match_id", F.col("t").alias("goal_t"), F.when(F.col("x") < 0, -1).otherwise(1).alias("sign"))
    signs = b.select("match_id").distinct().select("match_id", F.explode(F.array(F.struct(F.lit(0).alias("team"), F.lit(1).alias("sign")), F.struct(F.lit(1).alias("team"), F.lit(-1).alias("sign")))).alias("s")).select("match_id", "s.*")
    found = match.inferred_shots(b.where("state = 'click'").select("match_id", "t", "track_id", "team"), goals, signs)
    return found.select("match_id", "team", F.round("t", 6).alias("t"), "track_id")


@query(f"""
WITH {BOUND_SQL}, c AS (SELECT event_id, 0.3 + abs(x) / 100 AS base, state <> 'view' AS strong, y > 0 AS reached, CASE track_id WHEN 0 THEN 'players' WHEN 1 THEN 'ball_only' END AS kickoff, team = 0 AS tracks,
   CASE WHEN x > 10 THEN x / 50 END AS peak, CASE WHEN track_id > 3 THEN track_id / 7.0 END AS ratio, track_id % 3 AS independent, y < -30 AS back FROM bound),
 s AS (SELECT *, coalesce(kickoff = 'players', false) AS p, coalesce(kickoff = 'ball_only', false) AS b, peak IS NOT NULL AS h, coalesce(ratio < 0.75, false) AS c FROM c),
 v AS (SELECT *, independent + CAST(h AS INT) + CAST(c AS INT) AS n, base + CASE WHEN p THEN 0.2 WHEN b THEN 0.05 ELSE 0 END + CASE WHEN h THEN 0.17 ELSE 0 END + CASE WHEN c THEN 0.08 ELSE 0 END AS raw FROM s),
 j AS (SELECT *, NOT back AND CASE WHEN strong THEN n >= 2 OR p OR (b AND NOT tracks) OR h ELSE p AND n >= 3 END AS corroborated, least(0.98, CASE WHEN back THEN least(raw, 0.35) ELSE raw END) AS conf FROM v)
SELECT event_id, corroborated, CASE WHEN corroborated AND conf >= 0.7 - 1e-9 THEN 'goal' WHEN strong OR reached THEN 'shot' ELSE 'chance' END AS verdict,
 round(CASE WHEN corroborated AND conf >= 0.7 - 1e-9 THEN conf ELSE least(conf, 0.59) END, 6) AS confidence FROM j
""")
def goal_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goal, shot or chance, by the table of corroborating signals."""
    x = F.col("x")
    c = bound(spark, sf_dir).select(
        "event_id", (0.3 + F.abs(x) / 100).alias("base"), (F.col("state") != "view").alias("strong"), (F.col("y") > 0).alias("reached_mouth"),
        F.when(F.col("track_id") == 0, "players").when(F.col("track_id") == 1, "ball_only").alias("kickoff"), (F.col("team") == 0).alias("have_tracks"), F.when(x > 10, x / 50).alias("peak"),
        F.when(F.col("track_id") > 3, F.col("track_id") / 7.0).alias("spread_ratio"), (F.col("track_id") % 3).alias("independent"), (F.col("y") < -30).alias("reappeared"))
    return match.judge_goals(c).select("event_id", "corroborated", "verdict", F.round("confidence", 6).alias("confidence"))


@query(f"""
WITH {BOUND_SQL}, e AS (SELECT match_id, t, event_id, x, track_id FROM bound WHERE state = 'purchase'), p AS (SELECT match_id, t AS peak_t, (y + 35) / 70 AS strength FROM bound WHERE state = 'error'),
 s AS (SELECT e.match_id, e.t, max(p.strength) AS strength FROM e JOIN p ON p.match_id = e.match_id AND abs(p.peak_t - e.t) <= 4 GROUP BY ALL)
SELECT e.match_id, round(e.t, 6) AS t, round(greatest(0, least(1, 0.2 + 0.15 * coalesce(strength, 0) + 0.1 * greatest(0, 1 - abs(52.5 - abs(x)) / 36.75) + CASE WHEN track_id = 2 THEN 0.15 ELSE 0 END)), 6) AS excitement FROM e LEFT JOIN s ON s.match_id = e.match_id AND s.t = e.t
""")
def excitement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base excitement with the bonuses of noise, nearness to a goal line and the player in focus."""
    e = bound(spark, sf_dir).where("state = 'purchase'").select("match_id", F.lit("other").alias("type"), "t", "team", "track_id", F.lit(0.5).alias("confidence"), F.col("t").alias("t_start"), F.col("t").alias("t_end"), "x")
    peaks = bound(spark, sf_dir).where("state = 'error'").select("match_id", F.col("t").alias("peak_t"), ((F.col("y") + 35) / 70).alias("strength"))
    scored = match.score_events(e.drop("x"), peaks, where=e.select("match_id", "t", "type", "x"), focus=2)
    return scored.select("match_id", F.round("t", 6).alias("t"), F.round("excitement", 6).alias("excitement"))


@query(f"""
WITH {BOUND_SQL}, {SEGMENTS_SQL}, s AS (SELECT match_id, greatest(0, start_s - 2) AS a, end_s + 2 AS b FROM segments),
 n AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY match_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS fresh FROM s),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY match_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT match_id, round(min(a), 6) AS start_s, round(max(b), 6) AS end_s, count(*) AS n_merged FROM i GROUP BY match_id, island HAVING max(b) - min(a) >= 1
""")
def stopped_play(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = broadcast.stopped_windows(segments(spark, sf_dir))
    return rows.select("match_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "n_merged")


@query(f"""
WITH {BOUND_SQL}, {SEGMENTS_SQL} SELECT match_id, state, round(sum(end_s - start_s), 6) AS seconds FROM segments GROUP BY ALL
""")
def seconds_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.state_seconds(segments(spark, sf_dir)).select("match_id", "state", F.round("seconds", 6).alias("seconds"))


@query(f"""
WITH {BOUND_SQL}, r AS (SELECT match_id, event_id, state, x, t, row_number() OVER (PARTITION BY match_id ORDER BY x DESC, t, event_id) AS rank FROM bound) SELECT match_id, event_id, rank FROM r WHERE rank <= 3
""")
def strongest_of_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bound(spark, sf_dir).withColumn("confidence", F.col("x"))
    return stats.strongest_events(e).select("match_id", "event_id", "rank")


@query(f"""
WITH {BOUND_SQL}, p AS (SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY t, event_id) - 1 AS frame, x AS cx FROM bound),
 v AS (SELECT match_id, frame, (cx - lag(cx) OVER (PARTITION BY match_id ORDER BY frame)) * 25 AS v FROM p), f AS (SELECT * FROM v WHERE abs(v) > 100),
 s AS (SELECT match_id, sign(v) <> lag(sign(v)) OVER (PARTITION BY match_id ORDER BY frame) AS turned FROM f) SELECT match_id, count(*) FILTER (turned) AS reversals FROM s GROUP BY 1
""")
def pan_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(match.Window.partitionBy("match_id").orderBy("t", "event_id")) - 1
    return camera.reversals(bound(spark, sf_dir).select("match_id", number.alias("frame"), F.col("x").alias("cx")), 25.0, 100.0)


@query(f"""
WITH {BOUND_SQL}, p AS (SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY t, event_id) - 1 AS frame, x AS cx FROM bound) SELECT match_id, frame - 50 AS frame, cx FROM p WHERE frame >= 50 AND frame < 150
""")
def plan_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(match.Window.partitionBy("match_id").orderBy("t", "event_id")) - 1
    return camera.sliced(bound(spark, sf_dir).select("match_id", number.alias("frame"), F.col("x").alias("cx")), 2.0, 6.0, 25.0)


@query("""
WITH t AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, max(turn) OVER (PARTITION BY conv_id) + 1 AS size FROM t),
 b AS (SELECT conv_id, least(3, CAST(floor(turn / greatest(1, ceil(size / 4.0))) AS INT)) AS bin, max(abs(n)) AS peak FROM w GROUP BY ALL), s AS (SELECT *, max(peak) OVER (PARTITION BY conv_id) AS top FROM b)
SELECT conv_id, bin, round(CASE WHEN top > 0 THEN peak / top ELSE 0 END, 6) AS peak FROM s
""")
def waveform_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return stats.waveform_peaks(t, ["conv_id"], "turn", "n", 4).select("conv_id", "bin", F.round("peak", 6).alias("peak"))
