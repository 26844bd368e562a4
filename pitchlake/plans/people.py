"""Queries about tracks, camera paths and single records over the driver's tables; see ``analytics`` for the binding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.operators import camera, control, focus, match, stats
from pitchlake.plans.analytics import BOUND_SQL, bound
from pitchlake.plans.registry import query
from pitchlake.plans.tables import table

#: Boxes of 10 by 15 at every place, and one wanted box a match.
BOXES_SQL = f"{BOUND_SQL}, boxes AS (SELECT match_id, track_id, t, x AS x1, y AS y1, x + 10 AS x2, y + 15 AS y2 FROM bound)"
IOU_SQL = """greatest(least(x2, rx2) - greatest(x1, rx1), 0) * greatest(least(y2, ry2) - greatest(y1, ry1), 0) AS inter,
 CASE WHEN (x1 + x2) / 2 BETWEEN rx1 AND rx2 AND (y1 + y2) / 2 BETWEEN ry1 AND ry2 THEN 1 ELSE 0 END AS inside,
 sqrt(power((x1 + x2) / 2 - (rx1 + rx2) / 2, 2) + power((y1 + y2) / 2 - (ry1 + ry2) / 2, 2)) AS away"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return bound(spark, sf_dir).select("match_id", "track_id", "t", x.alias("x1"), y.alias("y1"), (x + 10).alias("x2"), (y + 15).alias("y2"))


def _wanted(boxes: DataFrame, t: float) -> DataFrame:
    side = F.lit(-45.0) + F.col("match_id") % 3 * 20
    return boxes.select("match_id").distinct().select("match_id", F.lit(t).alias("roi_t"), side.alias("roi_x1"), F.lit(-20.0).alias("roi_y1"), (side + 20).alias("roi_x2"), F.lit(20.0).alias("roi_y2"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a ball sample and a player within three bins of four hours, in whole centimetres, whose sums are exact."""
    rows = bound(spark, sf_dir).withColumns({c: F.round(F.col(c) * 100) for c in ("x", "y")})
    ball = rows.where("state = 'purchase'").select("match_id", "event_id", F.col("t").alias("ball_t"), F.col("x").alias("bx"), F.col("y").alias("by"))
    players = rows.where("state <> 'purchase'").select("match_id", F.col("event_id").alias("sample_id"), "t", "x", "y")
    return focus.neighbours(ball, players, ["match_id"], "ball_t", "t", 4.0)


NEAR_SQL = f"""{BOUND_SQL}, cm AS (SELECT match_id, event_id, t, state, round(x * 100) AS x, CAST(round(y * 100) AS DOUBLE) AS y FROM bound),
 pairs AS (SELECT b.match_id, b.event_id, p.event_id AS sample_id, p.x, p.y, sqrt(power(p.x - b.x, 2) + power(p.y - b.y, 2)) AS d
 FROM cm b JOIN cm p ON b.match_id = p.match_id AND abs(floor(b.t / 4) - floor(p.t / 4)) <= 1 WHERE b.state = 'purchase' AND p.state <> 'purchase')"""


def _away() -> Column:
    return F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))


@query(f"""
WITH {NEAR_SQL}, n AS (SELECT match_id, event_id, count(*) FILTER (d <= 2000) AS n_near, avg(x) AS ax, avg(y) AS ay, avg(x) FILTER (d <= 2000) AS nx, avg(y) FILTER (d <= 2000) AS ny FROM pairs GROUP BY 1, 2)
SELECT match_id, event_id, n_near, CASE WHEN n_near >= 2 THEN nx ELSE ax END AS cx, CASE WHEN n_near >= 2 THEN ny ELSE ay END AS cy FROM n
""")
def centroid_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the players around each ball sample are."""
    return focus.centroids(_near(spark, sf_dir), ["match_id", "event_id"], "x", "y", _away(), 2000.0)


@query(f"""
WITH {NEAR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY match_id, event_id ORDER BY d, sample_id) AS place FROM pairs WHERE d <= 2500),
 k AS (SELECT *, count(*) OVER (PARTITION BY match_id, event_id) AS n FROM r WHERE place <= 3)
SELECT match_id, event_id, sample_id, place, round(d, 4) AS distance FROM k WHERE n >= 2
""")
def engaged_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three players nearest to each ball sample."""
    rows = focus.engaged(_near(spark, sf_dir), ["match_id", "event_id"], _away(), "sample_id", 2500.0, 3)
    return rows.select("match_id", "event_id", "sample_id", "place", F.round("distance", 4).alias("distance"))


@query(f"""
WITH {BOXES_SQL}, c AS (SELECT *, abs(t - 300) AS dt, -45 + match_id % 3 * 20 AS rx1, -20 AS ry1, -25 + match_id % 3 * 20 AS rx2, 20 AS ry2 FROM boxes WHERE abs(t - 300) <= 24),
 f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY match_id, track_id ORDER BY dt, t) = 1), m AS (SELECT *, {IOU_SQL} FROM f),
 i AS (SELECT *, inter / (150 + 800 - inter) AS iou FROM m)
SELECT match_id, track_id FROM i WHERE iou > 0 OR inside = 1 OR away <= 1.5 * sqrt(2000) QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY iou DESC, inside DESC, away, track_id) = 1
""")
def track_under_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track under a wanted box near hour 300."""
    boxes = _boxes(spark, sf_dir)
    return focus.track_at_box(boxes, _wanted(boxes, 300.0), 24.0)


@query(f"""
WITH {BOXES_SQL}, c AS (SELECT *, -45 + match_id % 3 * 20 AS rx1, -20 AS ry1, -25 + match_id % 3 * 20 AS rx2, 20 AS ry2 FROM boxes WHERE t <= 200), m AS (SELECT *, {IOU_SQL} FROM c),
 g AS (SELECT match_id, track_id, max(inter / (950 - inter)) AS best, avg(inter / (950 - inter)) AS mean, avg(inside) AS share, avg(away) AS away, count(*) AS n FROM m GROUP BY 1, 2)
SELECT match_id, track_id FROM g QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY best DESC, mean DESC, share DESC, away, n DESC, track_id) = 1
""")
def early_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track that lies best under a wanted box over the first 200 hours."""
    boxes = _boxes(spark, sf_dir)
    return focus.early_target(boxes, _wanted(boxes, 0.0), 200.0)


@query(f"""
WITH {BOXES_SQL}, q AS (SELECT DISTINCT match_id, CASE WHEN match_id % 4 = 0 THEN 3 WHEN match_id % 4 = 1 THEN 104 END AS want, match_id % 4 = 2 AS boxed FROM boxes),
 s AS (SELECT match_id, track_id, max(t) - min(t) AS len FROM boxes GROUP BY 1, 2), l AS (SELECT match_id, arg_max(track_id, (len, -track_id)) AS longest FROM s GROUP BY 1),
 c AS (SELECT *, abs(t - 300) AS dt, -45 + match_id % 3 * 20 AS rx1, -20 AS ry1, -25 + match_id % 3 * 20 AS rx2, 20 AS ry2 FROM boxes WHERE abs(t - 300) <= 24 AND match_id % 4 = 2),
 f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY match_id, track_id ORDER BY dt, t) = 1), m AS (SELECT *, {IOU_SQL} FROM f),
 i AS (SELECT *, inter / (950 - inter) AS iou FROM m WHERE inter > 0 OR inside = 1 OR away <= 1.5 * sqrt(2000)),
 u AS (SELECT match_id, track_id AS roi FROM i QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY dt <= 2 DESC, iou DESC, inside DESC, away, track_id) = 1),
 r AS (SELECT q.*, e.track_id AS exact, CASE WHEN EXISTS (SELECT 1 FROM s p WHERE p.match_id = q.match_id AND p.track_id = q.want - 100) THEN q.want - 100 END AS part, roi, longest
  FROM q LEFT JOIN s e ON e.match_id = q.match_id AND e.track_id = q.want LEFT JOIN u ON u.match_id = q.match_id LEFT JOIN l ON l.match_id = q.match_id)
SELECT match_id, CASE WHEN exact IS NOT NULL THEN 'track_id' WHEN part IS NOT NULL THEN 'track_id_stitched' WHEN boxed AND roi IS NOT NULL THEN 'roi' WHEN boxed THEN 'fallback_longest' ELSE 'none' END AS method,
 coalesce(exact, part, CASE WHEN boxed THEN coalesce(roi, longest) END) AS track_id FROM r
""")
def focus_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each match's player of interest: by id, by a fragment's id, by a box, or none. Fragments are numbered from 100."""
    boxes = _boxes(spark, sf_dir)
    of = F.col("match_id") % 4
    wanted = _wanted(boxes, 300.0)
    requests = wanted.select("match_id", F.when(of == 0, 3).when(of == 1, 104).alias("focus_track_id"), *[F.when(of == 2, F.col(c)).alias(c) for c in wanted.columns if c != "match_id"])
    parts = boxes.select("match_id", "track_id").distinct().withColumn("source_track_id", F.col("track_id") + 100)
    return focus.select_focus(requests, boxes, parts, 2.0, 24.0)


@query(f"""
WITH {BOUND_SQL}, s AS (SELECT match_id, track_id, min(t) AS a, max(t) AS b, count(*) AS n FROM bound WHERE state <> 'error' GROUP BY 1, 2),
 m AS (SELECT match_id, count(*) AS tracks, CAST(sum(n) AS BIGINT) AS samples, round(max(b) - min(a), 3) AS duration_s, arg_max(track_id, (b - a, -track_id)) AS longest_track_id FROM s GROUP BY 1)
SELECT m.*, coalesce(n, 0) AS ball_detections FROM m LEFT JOIN (SELECT match_id, count(*) AS n FROM bound WHERE state = 'error' GROUP BY 1) USING (match_id)
""")
def tracking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir)
    return focus.match_summary(rows.where("state <> 'error'"), rows.where("state = 'error'"))


@query(f"""
WITH {BOUND_SQL}, s AS (SELECT match_id, track_id, event_id, avg(CASE WHEN x < -35 THEN 1.0 ELSE 0 END) OVER (PARTITION BY match_id, track_id ORDER BY us RANGE BETWEEN 36000000000 PRECEDING AND 36000000000 FOLLOWING) AS share
 FROM (SELECT b.*, epoch_us(e.ts) AS us FROM bound b JOIN events e USING (event_id)))
SELECT match_id, track_id, event_id, round(share, 5) AS keeper_share, share >= 0.6 AS keeper_like FROM s
""")
def keeper_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a player stays near the goal line in the ten hours around each sample."""
    times = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = focus.keeper_like(bound(spark, sf_dir).join(times, "event_id"), F.col("x") < -35, 36_000_000_000)
    return rows.select("match_id", "track_id", "event_id", F.round("keeper_share", 5).alias("keeper_share"), "keeper_like")


@query(f"""
WITH {BOUND_SQL}, k AS (SELECT match_id, track_id, track_id % 3 AS team, x FROM bound),
 e AS (SELECT match_id, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi, median(x) FILTER (team = 0) AS m0, median(x) FILTER (team = 1) AS m1 FROM k GROUP BY 1),
 z AS (SELECT *, greatest(1, hi - lo) AS span FROM e), g AS (SELECT match_id, track_id, m0, m1, count(*) AS n, avg(CASE WHEN x <= lo + 0.15 * span THEN 1.0 ELSE 0 END) AS l, avg(CASE WHEN x >= hi - 0.15 * span THEN 1.0 ELSE 0 END) AS r
  FROM k JOIN z USING (match_id) WHERE team = 2 AND abs(m0 - m1) >= 0.01 * span GROUP BY ALL)
SELECT match_id, track_id, CASE WHEN l >= 0.5 THEN CASE WHEN m0 < m1 THEN 0 ELSE 1 END ELSE CASE WHEN m0 < m1 THEN 1 ELSE 0 END END AS team FROM g WHERE n >= 10 AND (l >= 0.5 OR r >= 0.5)
""")
def zone_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of no team that live at one end, by the team that defends it."""
    rows = bound(spark, sf_dir).select("match_id", "track_id", (F.col("track_id") % 3).alias("team"), "x")
    return focus.keepers_by_zone(rows, 0.15, 0.5, 10, 0.01)


@query(f"""
WITH {BOUND_SQL}, b AS (SELECT match_id, t FROM bound WHERE state = 'error'), g AS (SELECT match_id, 100 + unnest(range(0, 80)) * 5.0 AS gt FROM (SELECT DISTINCT match_id FROM bound)),
 n AS (SELECT g.match_id, gt, p.t AS p FROM g ASOF LEFT JOIN b p ON g.match_id = p.match_id AND g.gt >= p.t), a AS (SELECT n.*, f.t AS f FROM n ASOF LEFT JOIN b f ON n.match_id = f.match_id AND n.gt <= f.t)
SELECT match_id, round(avg(CASE WHEN f - p <= 8 OR gt - p <= 1 OR f - gt <= 1 THEN 1.0 ELSE 0 END), 5) AS coverage FROM a GROUP BY 1
""")
def ball_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the steps of 400 hours at which the ball is seen."""
    rows = bound(spark, sf_dir)
    windows = rows.select("match_id").distinct().withColumns({"start": F.lit(100.0), "end": F.lit(500.0)})
    found = focus.coverage(rows.where("state = 'error'").select("match_id", "t"), windows, ["match_id"], 5.0, 8.0, 1.0)
    return found.withColumn("coverage", F.round("coverage", 5))


@query()
def sample_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at which to look at a match; held against a plain loop in the tests."""
    return focus.sample_times(bound(spark, sf_dir), 0.05, 40, 12, 2.0, 3)


# --- camera paths -----------------------------------------------------------------------------------------------

FRAMES_SQL = f"{BOUND_SQL}, frames AS (SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY t, event_id) - 1 AS frame, x, y, team, state, 1 + (event_id % 9) / 10.0 AS c FROM bound)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(match.Window.partitionBy("match_id").orderBy("t", "event_id")).cast("long") - 1
    return bound(spark, sf_dir).select("match_id", number.alias("frame"), "x", "y", "team", "state", (1 + F.col("event_id") % 9 / 10.0).alias("c"))


def _weighted_sql(source: str, columns: str, kernel: str, radius: int, kept: str) -> str:
    return f"""n AS (SELECT match_id, max(frame) AS last FROM {source} GROUP BY 1), k AS (SELECT unnest(range(-{radius}, {radius + 1})) AS k), w AS (SELECT k, {kernel} AS w FROM k),
 around AS (SELECT a.match_id, a.frame, {kept} w.w, b.* EXCLUDE (match_id, frame) FROM {source} a JOIN n USING (match_id) CROSS JOIN w JOIN {source} b ON b.match_id = a.match_id AND b.frame = greatest(0, least(last, a.frame + w.k)))
SELECT match_id, frame, {columns} FROM around GROUP BY match_id, frame"""


@query(f"WITH {FRAMES_SQL}, " + _weighted_sql("frames", "round(sum(w * x * c) / sum(w * c), 4) AS smooth, round(sum(w * y) / sum(w), 4) AS plain", "exp(-0.5 * power(k / 2.5, 2))", 8, ""))
def gaussian_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera path smoothed by a Gaussian of 2.5 frames, once by confidence."""
    rows = camera.gaussian(_frames(spark, sf_dir), ["match_id"], "frame", "x", 2.5, "smooth", "c")
    rows = camera.gaussian(rows, ["match_id"], "frame", "y", 2.5, "plain")
    return rows.select("match_id", "frame", F.round("smooth", 4).alias("smooth"), F.round("plain", 4).alias("plain"))


@query(f"""WITH {FRAMES_SQL}, z AS (SELECT match_id, frame, least(min(x - 1.5 * frame) OVER u + 1.5 * frame, min(x + 1.5 * frame) OVER d - 1.5 * frame) AS v FROM frames
  WINDOW u AS (PARTITION BY match_id ORDER BY frame), d AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 e AS (SELECT match_id, frame, min(v) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS v FROM z), """
       + _weighted_sql("e", "round(sum(w * v) / sum(w), 4) AS envelope", "0.5 - 0.5 * cos(2 * pi() * (k + 5) / 10)", 4, ""))
def smooth_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smooth curve below a limit on the zoom."""
    rows = camera.lower_envelope(_frames(spark, sf_dir), ["match_id"], "frame", "x", 1.5, 4, "envelope")
    return rows.select("match_id", "frame", F.round("envelope", 4).alias("envelope"))


@query()
def camera_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path within limits of speed and acceleration; its limits are held in the tests."""
    rows = _frames(spark, sf_dir).withColumns({"fastest": F.lit(60.0), "strongest": F.lit(120.0)})
    return camera.limited_motion(rows, 25.0)


@query(f"""
WITH {FRAMES_SQL} SELECT match_id, count(*) AS frames, round(min(c), 3) AS zoom_min, round(max(c), 3) AS zoom_max, round(avg(team), 3) AS mean_confidence, count(*) FILTER (state = 'view') AS view_frames FROM frames GROUP BY 1
""")
def camera_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir).select("match_id", F.col("state").alias("focus"), F.col("c").alias("zoom"), F.col("team").cast("double").alias("confidence"))
    found = camera.plan_summary(rows)
    return found.withColumn("view_frames", F.coalesce(F.try_element_at("focus_frames", F.lit("view")), F.lit(0)).cast("long")).drop("focus_frames")


# --- play -------------------------------------------------------------------------------------------------------

OWNERS_SQL = f"""{BOUND_SQL}, owners AS (SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY t, event_id) - 1 AS g, CASE WHEN state <> 'error' THEN track_id // 3 END AS track_id,
 CASE WHEN state <> 'error' THEN track_id // 3 % 2 END AS team, x, y, CAST(abs(y) AS DOUBLE) AS opponent_m, x < 20 AS in_play FROM bound)"""


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The player (two users stand for one, so that spells are longer) with the ball at each step, nobody at errors."""
    has, player = F.col("state") != "error", F.floor(F.col("track_id") / 3).cast("int")
    number = F.row_number().over(match.Window.partitionBy("match_id").orderBy("t", "event_id")).cast("long") - 1
    return bound(spark, sf_dir).select("match_id", number.alias("g"), F.when(has, player).alias("track_id"), F.when(has, player % 2).alias("team"), "x", "y", F.round(F.abs("y"), 3).alias("opponent_m"), (F.col("x") < 20).alias("in_play"))


@query(f"""
WITH {OWNERS_SQL}, o AS (SELECT *, last_value(CASE WHEN team IS NOT NULL THEN {{'g': g, 'track': track_id, 'team': team}} END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was,
  min(team) OVER h AS lo, max(team) OVER h AS hi FROM owners WINDOW h AS (PARTITION BY match_id ORDER BY g ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
SELECT match_id, g, team, track_id, was.team AS lost_by, was.track AS lost_by_track FROM o WHERE team IS NOT NULL AND was.team <> team AND g - was.g <= 3 AND in_play AND lo = team AND hi = team
""")
def held_turnovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.held_turnovers(_owners(spark, sf_dir), 3, 2)


@query(f"""
WITH {OWNERS_SQL}, o AS (SELECT *, CASE WHEN track_id = lag(track_id) OVER v AND g - lag(g) OVER v <= 2 THEN 0 ELSE 1 END AS fresh FROM owners WHERE track_id IS NOT NULL WINDOW v AS (PARTITION BY match_id ORDER BY g)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY match_id ORDER BY g) AS spell FROM o), d AS (SELECT *, sqrt(power(x - lag(x) OVER q, 2) + power(y - lag(y) OVER q, 2)) AS step FROM s WINDOW q AS (PARTITION BY match_id, spell ORDER BY g)),
 a AS (SELECT match_id, spell, track_id, team, min(g) AS g_start, max(g) AS g_end, sum(step) AS metres, min(opponent_m) AS closest, arg_min(g, (opponent_m, g)) AS g FROM d GROUP BY 1, 2, 3, 4)
SELECT match_id, track_id, team, g_start, g_end, round(metres, 4) AS metres, round(closest, 4) AS closest, g FROM a WHERE g_end > g_start AND metres >= 15 AND closest <= 3
""")
def dribble_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = match.dribbles(_owners(spark, sf_dir), 1)
    return rows.withColumns({c: F.round(c, 4) for c in ("metres", "closest")})


@query()
def ball_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a fast ball in one direction; held against a plain loop in the tests."""
    rows = bound(spark, sf_dir).select("match_id", "t", F.col("x").alias("vx"), F.col("y").alias("vy"))
    return match.flights(rows, 20.0, 60.0, 1.6, 12.0)


@query(f"""
WITH {BOUND_SQL}, r AS (SELECT match_id, t, 0.75 * (x - min(x) OVER m) / (max(x) OVER m - min(x) OVER m + 1e-9) + 0.25 * ((y + 35) / 70 * pi()) / (pi() + 1e-9) AS score FROM bound WINDOW m AS (PARTITION BY match_id)),
 a AS (SELECT match_id, arg_max(t, (score, t)) AS t1 FROM r GROUP BY 1), b AS (SELECT match_id, t1, arg_max(t, (score, t)) AS t2 FROM r JOIN a USING (match_id) WHERE abs(t - t1) >= 60 GROUP BY 1, 2),
 c AS (SELECT match_id, arg_max(t, (score, t)) AS t3 FROM r JOIN b USING (match_id) WHERE abs(t - t1) >= 60 AND abs(t - t2) >= 60 GROUP BY 1),
 u AS (SELECT match_id, t1 AS t FROM a UNION ALL SELECT match_id, t2 FROM b UNION ALL SELECT match_id, t3 FROM c)
SELECT match_id, round(greatest(0, t - 20), 5) AS t_start, round(t + 40, 5) AS t_end FROM u
""")
def review_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest moments, 60 hours apart; so padded spans meet but never by less than the joining gap at random times."""
    rows = bound(spark, sf_dir).select("match_id", "t", F.col("x").alias("speed"), ((F.col("y") + 35) / 70 * F.pi()).alias("turn"))
    found = match.review_candidates(rows, 20.0, 40.0, 3, -1e-6)
    return found.withColumns({c: F.round(c, 5) for c in ("t_start", "t_end")})


@query()
def kit_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players of a match by two kits; held against known kits in the tests."""
    e = bound(spark, sf_dir).groupBy("match_id", "track_id").agg(F.array(F.avg("x"), F.avg("y")).alias("feature"), F.count(F.lit(1)).cast("double").alias("weight"))
    return stats.kits(e, 2.0)


@query(f"""
WITH {BOUND_SQL}, c AS (SELECT match_id, state, count(*) AS n FROM bound GROUP BY 1, 2),
 t AS (SELECT match_id, sum(n) AS n, list(state || ' ' || n ORDER BY n DESC, state) [1:3] AS types FROM c GROUP BY 1), s AS (SELECT match_id, list(state || ' ' || event_id ORDER BY x DESC, event_id) [1:3] AS top FROM bound GROUP BY 1)
SELECT match_id, CAST(n AS BIGINT) || ' events: ' || array_to_string(types, ', ') || '; strongest: ' || array_to_string(top, ', ') AS digest FROM t JOIN s USING (match_id)
""")
def match_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.match_digests(bound(spark, sf_dir).select("match_id", "event_id", F.col("state").alias("type"), F.col("x").alias("strength")))


# --- single records ---------------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT event_id, CAST(epoch_us(ts) % 600000000 AS DOUBLE) / 1e6 AS s, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10 AS len, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 602.0 END AS d FROM events),
 l AS (SELECT event_id, s, d, CASE WHEN len < 4 THEN CASE WHEN d > 0 THEN least(d, s + 4) ELSE s + 4 END ELSE s + len END AS e FROM c)
SELECT event_id, round(CASE WHEN e - s < 4 THEN greatest(0, e - 4) ELSE s END, 3) AS t_start, round(e, 3) AS t_end FROM l
""")
def least_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) % 600_000_000).cast("double") / 1e6
    length = F.get_json_object("props", "$.k").cast("double") / 10
    since, to = control.least_clip(start, start + length, F.lit(4.0), F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(602.0))
    return e.select("event_id", since.alias("t_start"), to.alias("t_end"))


@query("""
SELECT event_id, coalesce(TRY_CAST(event_type AS DOUBLE), TRY_CAST(CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE 'x' END AS DOUBLE), CASE WHEN event_id % 3 = 0 THEN value END, 0) AS trim_offset FROM events
""")
def trim_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k")).otherwise("x")
    third = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", control.first_number(F.col("event_type"), even, third).alias("trim_offset"))


@query("""
WITH p AS (SELECT user_id, list(value ORDER BY ts) FILTER (event_type = 'purchase' AND value > 150) AS s, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n, coalesce(len(s) > 0, false) AS has_speed_series FROM p
""")
def slim_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    fast = F.when((F.col("event_type") == "purchase") & (F.col("value") > 150), F.col("value"))
    players = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(fast).alias("speed_series"), F.count(F.lit(1)).alias("n"))
    return control.without_series(players)


@query("""
WITH c AS (SELECT p_partkey AS batch_id, p_partkey % 25 AS tenant_id, CASE p_size % 2 WHEN 0 THEN 'O' ELSE 'F' END AS status FROM part WHERE p_size <= 10)
SELECT batch_id, (SELECT count(*) FROM orders o JOIN customer k ON k.c_custkey = o.o_custkey WHERE k.c_nationkey = c.tenant_id AND o.o_orderstatus = c.status
 AND (c.batch_id % 3 <> 0 OR o.o_orderpriority IN ('1-URGENT', '2-HIGH')) AND (c.batch_id % 2 <> 0 OR o.o_orderdate >= DATE '1995-01-01')) AS item_count FROM c
""")
def feedback_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each batch of feedback: customers' nations are tenants, small parts ask for batches."""
    at = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").cast("long").alias("tenant_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("match_id"), F.col("o_orderpriority").alias("kind"), at.alias("at"))
    key = F.col("p_partkey")
    asked = table(spark, sf_dir, "part").where("p_size <= 10").select(
        key.alias("batch_id"), (key % 25).cast("long").alias("tenant_id"), F.when(F.col("p_size") % 2 == 0, "O").otherwise("F").alias("status"), F.lit(None).cast("array<bigint>").alias("match_ids"),
        F.when(key % 3 == 0, F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("kinds"), F.when(key % 2 == 0, F.lit("1995-01-01").cast("timestamp")).alias("from_at"), F.lit(None).cast("timestamp").alias("to_at"))
    return control.feedback_batches(rows, asked).select("batch_id", "item_count")


@query("""
SELECT p_brand, count(*) AS n_players, arg_min(p_partkey, (p_size, p_partkey)) AS first_player FROM part GROUP BY 1
""")
def roster_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = control.roster_templates(table(spark, sf_dir, "part"), ["p_brand"], "p_size", ["p_partkey", "p_type"])
    return rows.select("p_brand", F.size("players").cast("long").alias("n_players"), F.element_at("players", 1)["p_partkey"].alias("first_player"))


@query("""
WITH j AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'running' ELSE 'done' END AS status, min(ts) AS started, (user_id % 10) / 10.0 AS own FROM events GROUP BY 1),
 l AS (SELECT user_id, arg_max(event_type, ts) AS stage, arg_max(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100, ts) AS logged FROM events WHERE event_type <> 'view' GROUP BY 1),
 r AS (SELECT j.*, l.user_id IS NOT NULL AS has, stage, CASE WHEN status = 'running' THEN greatest(own, coalesce(logged, 0)) ELSE own END AS p, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(started)) / 1e6 AS s FROM j LEFT JOIN l USING (user_id))
SELECT user_id AS job_id, CASE WHEN has THEN 'job_log' ELSE 'job' END AS source, coalesce(stage, 'queued') AS stage, round(p, 4) AS progress, round(s, 1) AS elapsed_s, round(CASE WHEN status = 'running' AND p > 0.02 AND p < 1 THEN s * (1 - p) / p END, 1) AS eta_s FROM r
""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each user's job is and when it ends."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    key = F.col("user_id")
    jobs = e.groupBy(key.alias("job_id")).agg(F.min("at").alias("started")).select(
        "job_id", F.when(F.col("job_id") % 3 == 0, "running").otherwise("done").alias("status"), F.lit("queued").alias("stage"), (F.col("job_id") % 10 / 10.0).alias("progress"), "started", F.lit(None).cast("timestamp").alias("finished"))
    logs = e.where("event_type <> 'view'").select(key.alias("job_id"), "at", F.col("event_type").alias("stage"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("progress"))
    return control.job_progress(jobs, logs, F.lit("2024-02-01 00:00:00").cast("timestamp"), ["running"])


@query("""
SELECT e.event_id, c.c_name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_mktsegment <> 'BUILDING'
""")
def public_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("player_id"), F.lit(0).alias("match_id"), "c_name")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("player_id"), F.lit(0).alias("match_id"))
    return control.with_players(rows, players).select("event_id", "c_name")


@query()
def linked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events (errors and purchases) joined to analysed ones (views and clicks); held against a plain loop in the tests."""
    rows = bound(spark, sf_dir)
    found = rows.where("state IN ('view', 'click')").select("match_id", "event_id", F.col("state").alias("type"), "t")
    stored = rows.where("state NOT IN ('view', 'click')").select(
        "match_id", F.col("event_id").alias("stored_id"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") + 1).alias("names"), F.when(F.col("event_id") % 2 == 0, "view").otherwise("shot").alias("stored_type"), F.col("t").alias("stored_t"))
    return control.linked_events(found, stored)
