"""Team documents, their quality and the places of events over the driver's events; see ``analytics`` for the binding.

An hour is a second and a grid step, five steps are a sample of possession. Users are players, the first of an hour the ball.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.operators import documents
from pitchlake.plans.analytics import BOUND_SQL, bound
from pitchlake.plans.registry import query

SOURCES_SQL = f"""{BOUND_SQL}, kin AS (SELECT match_id, track_id, track_id % 3 AS team, event_id % 97 / 16 AS step, '#' || (track_id % 4) AS color_hex FROM bound),
 ball AS (SELECT match_id, CAST(floor(t) AS BIGINT) AS g, min(x) AS x, CASE WHEN count(*) > 1 THEN (max(x) - 10) * 0.73721 END AS vx, max(x) / 30 + 2 AS speed, CAST(floor(t) AS BIGINT) % 4 <> 0 AS visible FROM bound GROUP BY ALL),
 owned AS (SELECT match_id, CAST(floor(t / 5) AS BIGINT) AS slot, max(track_id % 5) - 3 AS code FROM bound WHERE state = 'click' GROUP BY ALL),
 touched AS (SELECT match_id, team FROM bound WHERE state = 'click')"""


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = bound(spark, sf_dir)
    hour = F.floor("t")
    ball = rows.groupBy("match_id", hour.alias("g")).agg(F.min("x").alias("x"), F.when(F.count(F.lit(1)) > 1, (F.max("x") - 10) * 0.73721).alias("vx"), (F.max("x") / 30 + 2).alias("speed"))
    return {
        "kin": rows.select("match_id", "track_id", (F.col("track_id") % 3).alias("team"), (F.col("event_id") % 97 / 16).alias("step")),
        "ball": ball.withColumns({"grid_t": F.col("g").cast("double"), "visible": F.col("g") % 4 != 0}),
        "owned": rows.where("state = 'click'").groupBy("match_id", (F.floor(F.col("t") / 5) * 5.0).alias("t")).agg((F.max(F.col("track_id") % 5) - 3).alias("code")),
        "touched": rows.where("state = 'click'").select("match_id", "team"),
    }


@query(f"""
WITH {SOURCES_SQL}, teams AS (SELECT DISTINCT match_id, u.team, 1 - 2 * u.team AS sign FROM bound, (SELECT 0 AS team UNION ALL SELECT 1) u),
 segments AS (SELECT match_id, t AS start_s, CASE WHEN state = 'error' THEN 'restart_left' ELSE 'in_play' END AS state FROM bound WHERE state IN ('error', 'signup') QUALIFY row_number() OVER (PARTITION BY match_id, t ORDER BY event_id) = 1),
 firsts AS (SELECT match_id, arg_min(state, start_s) AS state FROM segments GROUP BY 1),
 seen AS (SELECT b.match_id, k.team, b.x * CASE WHEN b.g < 300 THEN k.sign ELSE -k.sign END AS along, b.vx * CASE WHEN b.g < 300 THEN k.sign ELSE -k.sign END AS ahead, b.speed, o.code = k.team AS held, coalesce(s.state, f.state, 'in_play') = 'in_play' AS playing
   FROM (SELECT * FROM ball WHERE visible) b ASOF LEFT JOIN segments s ON b.match_id = s.match_id AND b.g >= s.start_s LEFT JOIN firsts f ON f.match_id = b.match_id
   LEFT JOIN owned o ON o.match_id = b.match_id AND o.slot = CAST(floor(b.g / 5) AS BIGINT) JOIN teams k ON k.match_id = b.match_id),
 z AS (SELECT match_id, team, count(*) FILTER (playing AND along < -17.5) AS z0, count(*) FILTER (playing AND along BETWEEN -17.5 AND 17.5) AS z1, count(*) FILTER (playing AND along > 17.5) AS z2, avg(speed) FILTER (held) AS v, avg(ahead) FILTER (held) AS p FROM seen GROUP BY ALL),
 o AS (SELECT match_id, count(*) FILTER (code >= 0) AS known, count(*) FILTER (code = 0) AS own0, count(*) FILTER (code = 1) AS own1 FROM owned GROUP BY 1),
 k AS (SELECT match_id, team, sum(step) AS metres, count(*) AS n, count(DISTINCT track_id) AS players FROM kin GROUP BY ALL),
 c AS (SELECT match_id, team, color_hex FROM (SELECT match_id, team, color_hex, count(DISTINCT track_id) AS n FROM kin GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY match_id, team ORDER BY n DESC, color_hex) = 1),
 e AS (SELECT *, CASE WHEN (CASE WHEN x > 0 THEN 1 ELSE -1 END) = (CASE WHEN t < 300 THEN 1 ELSE -1 END) THEN 0 ELSE 1 END AS attackers FROM bound),
 counts AS (SELECT match_id, u.team, count(*) FILTER (state = 'click' AND e.team = u.team) AS touches, count(*) FILTER (state = 'view' AND e.team = u.team) AS passes, count(*) FILTER (state = 'view' AND e.team = u.team AND y > 0) AS complete,
   count(*) FILTER (state = 'purchase' AND e.team = u.team) AS shots, count(*) FILTER (state = 'purchase' AND e.team = u.team AND y > 10) AS on_target,
   count(*) FILTER (state = 'purchase' AND y > 20 AND attackers = u.team) AS goals, count(*) FILTER (state = 'signup' AND track_id < 4 AND attackers = u.team) AS corners FROM e, (SELECT 0 AS team UNION ALL SELECT 1) u GROUP BY ALL)
SELECT m.match_id, m.team, c.color_hex, CASE WHEN m.sign > 0 THEN 'left' ELSE 'right' END AS defends_first_half, CASE WHEN m.sign > 0 THEN 'right' ELSE 'left' END AS defends_second_half,
 round(100.0 * CASE WHEN m.team = 0 THEN own0 ELSE own1 END / nullif(known, 0), 1) AS possession_pct, passes, complete AS passes_completed, round(coalesce(100.0 * complete / nullif(passes, 0), 0), 1) AS pass_accuracy_pct,
 shots, on_target AS shots_on_target, goals, corners, touches, round(coalesce(100.0 * z0 / nullif(z0 + z1 + z2, 0), 0), 1) AS own_pct, round(coalesce(100.0 * z1 / nullif(z0 + z1 + z2, 0), 0), 1) AS middle_pct, round(coalesce(100.0 * z2 / nullif(z0 + z1 + z2, 0), 0), 1) AS attack_pct,
 round(coalesce(metres / k.n, 0), 2) AS avg_speed_mps, round(coalesce(metres, 0), 1) AS distance_m, coalesce(players, 0) AS players_tracked, round(coalesce(v, 0), 2) AS ball_speed_mean_mps, round(coalesce(p, 0), 2) AS progression_mps,
 round(coalesce(passes * 12.0 / nullif(CASE WHEN m.team = 0 THEN own0 ELSE own1 END, 0), 0), 2) AS passes_per_minute
FROM teams m LEFT JOIN z USING (match_id, team) LEFT JOIN o USING (match_id) LEFT JOIN k USING (match_id, team) LEFT JOIN c USING (match_id, team) LEFT JOIN counts USING (match_id, team)
""")
def team_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both teams' documents; they change ends at hour 300. Views are passes, purchases shots, sign-ups corners."""
    rows, got = bound(spark, sf_dir), _sources(spark, sf_dir)
    forever = float("inf")
    side = F.when(F.col("x") > 0, "right").otherwise("left").alias("side")
    halves = F.explode(F.array(*[F.struct(F.lit(team).alias("team"), F.lit(sign).alias("sign"), F.lit(a).alias("from_s"), F.lit(b).alias("to_s")) for team, sign, a, b in (
        (0, 1, -forever, 300.0), (0, -1, 300.0, forever), (1, -1, -forever, 300.0), (1, 1, 300.0, forever))]))
    signs = rows.select("match_id").distinct().select("match_id", halves.alias("s")).select("match_id", "s.*")
    states = rows.where("state IN ('error', 'signup')").groupBy("match_id", F.col("t").alias("start_s")).agg(F.min_by("state", "event_id").alias("s")).select(
        "match_id", "start_s", F.when(F.col("s") == "error", "restart_left").otherwise("in_play").alias("state"))
    colours = rows.select("match_id", "track_id", F.concat(F.lit("#"), (F.col("track_id") % 4).cast("string")).alias("color_hex")).distinct()
    bought = rows.where("state = 'purchase'")
    return documents.team_document(
        got["kin"], got["ball"], got["owned"], states, signs, got["touched"], rows.where("state = 'view'").select("match_id", "team", (F.col("y") > 0).alias("complete")),
        bought.select("match_id", "team", (F.col("y") > 10).alias("on_target")), bought.where("y > 20").select("match_id", "t", side),
        rows.where("state = 'signup'").select("match_id", "t", side, F.when(F.col("track_id") < 4, "corner_kick").otherwise("free_kick").alias("kind")), colours, every=5, hz=1.0)


@query(f"""
WITH {SOURCES_SQL}, k AS (SELECT match_id, round(100.0 * count(*) FILTER (team < 2) / count(*), 1) AS labels FROM kin GROUP BY 1), b AS (SELECT match_id, round(100.0 * count(*) FILTER (visible) / count(*), 1) AS seen FROM ball GROUP BY 1),
 o AS (SELECT match_id, count(*) FILTER (code <> -3) AS n, count(*) FILTER (code >= 0) AS known, count(*) FILTER (code = -1) AS unknown, count(*) FILTER (code = -2) AS contested FROM owned GROUP BY 1), c AS (SELECT match_id, count(*) AS touches FROM touched GROUP BY 1)
SELECT match_id, labels AS team_label_coverage_pct, seen AS ball_coverage_pct, coalesce(n, 0) * 5.0 AS in_play_s, round(coalesce(100.0 * known / nullif(n, 0), 0), 1) AS possession_known_pct, round(coalesce(100.0 * unknown / nullif(n, 0), 0), 1) AS possession_unknown_pct,
 round(coalesce(100.0 * contested / nullif(n, 0), 0), 1) AS possession_contested_pct, coalesce(touches, 0) AS touches_detected FROM k JOIN b USING (match_id) LEFT JOIN o USING (match_id) LEFT JOIN c USING (match_id)
""")
def sheet_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each match's figures can be trusted."""
    got = _sources(spark, sf_dir)
    return documents.document_quality(got["kin"], got["ball"], got["owned"], got["touched"], every=5, hz=1.0)


@query(f"""
WITH {BOUND_SQL}, places AS (SELECT match_id, t, event_id, track_id, state, x * 1.0371 AS x, CAST(y AS DOUBLE) * 1.0371 AS y FROM bound), ball AS (SELECT match_id, t, min(x) AS x, arg_min(y, (x, y)) AS y FROM places WHERE track_id < 3 GROUP BY ALL),
 ev AS (SELECT match_id, t, event_id, CASE WHEN state = 'error' THEN x END AS nx, CASE WHEN state = 'error' THEN y END AS ny, CASE WHEN state <> 'view' THEN y END AS ox, CASE WHEN state <> 'view' THEN x END AS oy FROM places WHERE track_id >= 3),
 p AS (SELECT ev.*, b.t AS t0, b.x AS x0, b.y AS y0 FROM ev ASOF LEFT JOIN ball b ON ev.match_id = b.match_id AND ev.t > b.t),
 q AS (SELECT p.*, b.t AS t1, b.x AS x1, b.y AS y1 FROM p ASOF LEFT JOIN ball b ON p.match_id = b.match_id AND p.t <= b.t),
 w AS (SELECT *, CASE WHEN t0 IS NULL THEN t1 - t <= 3 WHEN t1 IS NULL THEN t - t0 <= 3 ELSE t1 - t0 <= 30 OR least(t - t0, t1 - t) <= 3 END AS ok, CASE WHEN t0 IS NULL THEN 1.0 WHEN t1 IS NULL THEN 0.0 ELSE (t - t0) / (t1 - t0) END AS part FROM q),
 r AS (SELECT *, coalesce(nx, CASE WHEN ok THEN coalesce(x0, x1) + part * coalesce(x1 - x0, 0) END, ox) AS px, coalesce(ny, CASE WHEN ok THEN coalesce(y0, y1) + part * coalesce(y1 - y0, 0) END, oy) AS py FROM w)
SELECT match_id, event_id, round(px, 1) + 0.0 AS ball_x, round(py, 1) + 0.0 AS ball_y, round(CASE WHEN match_id % 2 = 0 THEN (1.5 * px + 2) / (1 + 0.001 * py) END, 2) + 0.0 AS pitch_x, round(CASE WHEN match_id % 2 = 0 THEN (0.5 * py - 1) / (1 + 0.001 * py) END, 2) + 0.0 AS pitch_y FROM r
""")
def event_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users from 3 on have events, the others' samples are the ball; errors have a place noted, every second match is calibrated."""
    rows = bound(spark, sf_dir).withColumns({c: F.col(c) * 1.0371 for c in ("x", "y")})  # no ties of rounding
    noted, own = F.col("state") == "error", F.col("state") != "view"
    events = rows.where("track_id >= 3").select(
        "match_id", "t", "event_id", F.when(noted, F.col("x")).alias("noted_x"), F.when(noted, F.col("y")).alias("noted_y"), F.when(own, F.col("y")).alias("own_x"), F.when(own, F.col("x")).alias("own_y"))
    matrix = F.array(*[F.array(*[F.lit(v) for v in row]) for row in ((1.5, 0.0, 2.0), (0.0, 0.5, -1.0), (0.0, 0.001, 1.0))])
    calibrated = rows.where("match_id % 2 = 0").select("match_id").distinct().withColumn("homography", matrix)
    placed = documents.event_places(events, rows.where("track_id < 3").select("match_id", "t", "x", "y"), calibrated, 30.0, 3.0)
    return placed.select("match_id", "event_id", *[(F.col(c) + 0.0).alias(c) for c in ("ball_x", "ball_y", "pitch_x", "pitch_y")])
