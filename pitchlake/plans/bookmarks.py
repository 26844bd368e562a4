"""Bookmarks, stored events, summaries, source types and track views over the driver's tables, each with its SQL.

A match is seven users' month and hours stand for seconds, as in ``analytics``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.functions import exprs
from pitchlake.operators import bookmarks, stats
from pitchlake.plans.analytics import BOUND_SQL, bound
from pitchlake.plans.registry import query
from pitchlake.plans.tables import table

TARGETS = ("save", "corner_kick", "sprint")

#: Candidate intervals, their signals and what was detected, from the types of events.
CANDIDATES_SQL = f"""{BOUND_SQL}, i AS (SELECT match_id, event_id AS n, t AS s, t + 2.0 AS e FROM bound WHERE state = 'view'),
 f AS (SELECT match_id, event_id AS row, t, CASE track_id WHEN 0 THEN 'goal' WHEN 1 THEN 'card' WHEN 2 THEN 'piece' END AS source,
   CASE track_id WHEN 1 THEN CASE WHEN y > 0 THEN 'red_card' END WHEN 2 THEN CASE WHEN y > 0 THEN 'corner_kick' ELSE 'throw_in' END END AS kind,
   CASE WHEN x > 0 THEN 'right' ELSE 'left' END AS side, (y + 35.0) / 70.0 AS confidence FROM bound WHERE state = 'purchase' AND track_id < 3),
 ov AS (SELECT i.match_id, n, sum(CASE WHEN state = 'click' THEN greatest(0, least(e, t + 1.5) - greatest(s, t)) END) AS fast,
   sum(CASE WHEN state = 'error' THEN greatest(0, least(e, t + 1.0) - greatest(s, t)) END) AS loud
   FROM i JOIN bound b ON b.match_id = i.match_id AND b.t <= i.e AND b.t >= i.s - 1.5 AND state IN ('click', 'error') GROUP BY ALL),
 ev AS (SELECT i.match_id, n, source, arg_min({{'t': t, 'kind': kind, 'side': side, 'confidence': confidence}}, row) AS hit FROM i JOIN f ON f.match_id = i.match_id AND t BETWEEN s AND e GROUP BY ALL)"""


@query(f"""
WITH {CANDIDATES_SQL},
 a AS (SELECT i.*, coalesce(fast, 0) AS fast, coalesce(loud, 0) AS loud, g.hit AS g, c.hit AS c, p.hit AS p FROM i LEFT JOIN ov USING (match_id, n) LEFT JOIN ev g ON g.match_id = i.match_id AND g.n = i.n AND g.source = 'goal'
   LEFT JOIN ev c ON c.match_id = i.match_id AND c.n = i.n AND c.source = 'card' LEFT JOIN ev p ON p.match_id = i.match_id AND p.n = i.n AND p.source = 'piece'),
 b AS (SELECT *, CASE WHEN fast > 0 AND loud > 0 THEN 'save' WHEN fast > 0 THEN 'corner_kick' WHEN loud > 0 THEN 'corner_kick' ELSE 'save' END AS guess,
   least(0.99, round(0.45 + CASE WHEN fast > 0 THEN 0.22 ELSE 0 END + CASE WHEN loud > 0 THEN 0.18 ELSE 0 END + 0.08, 3)) AS base,
   CASE WHEN g IS NOT NULL THEN 'goal' WHEN c IS NOT NULL THEN coalesce(c.kind, 'yellow_card') WHEN p.kind = 'corner_kick' THEN 'corner_kick' END AS found FROM a),
 m AS (SELECT match_id, n, row_number() OVER (PARTITION BY match_id ORDER BY n) AS index, coalesce(found, guess) AS event_type,
   CASE WHEN g IS NOT NULL THEN least(0.99, greatest(base, g.confidence) + CASE WHEN loud > 0 THEN 0.05 ELSE 0 END) WHEN c IS NOT NULL THEN least(0.99, greatest(base, c.confidence)) WHEN found IS NOT NULL THEN least(0.99, greatest(base, 0.8)) ELSE base END AS confidence,
   CASE WHEN g IS NOT NULL THEN g.t WHEN c IS NOT NULL THEN c.t WHEN found IS NOT NULL THEN p.t ELSE (s + e) / 2 END AS at_s,
   coalesce(found || '_detected', guess || '_candidate') AS label, CASE WHEN fast > 0 THEN 'motion,' ELSE '' END || CASE WHEN loud > 0 THEN 'audio,' ELSE '' END
   || CASE WHEN c IS NOT NULL AND g IS NULL THEN 'vision,' WHEN found IS NOT NULL THEN 'ball_tracking,' WHEN fast <= 0 AND loud <= 0 THEN 'motion,' ELSE '' END AS sources, round(fast, 3) AS fast_s, round(loud, 3) AS loud_s FROM b),
 st AS (SELECT m.match_id, n, arg_min(y.x, event_id) AS score FROM m JOIN bound y ON y.match_id = m.match_id AND state = 'error' AND track_id = 0 AND y.t <= m.at_s AND m.at_s < y.t + 9.0 GROUP BY ALL)
SELECT match_id, index, event_type, round(confidence, 6) AS confidence, round(at_s, 3) AS occurred_at_s, label, rtrim(sources, ',') AS sources, fast_s, loud_s, CASE WHEN score > 0 THEN 'stopped' WHEN score <= 0 THEN 'walking' END AS game_state, printf('bm_%04d', index) AS bookmark_id
FROM m LEFT JOIN st USING (match_id, n)
""")
def candidate_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate interval with what was detected in it."""
    e = bound(spark, sf_dir)
    span = lambda rows, length: rows.select("match_id", F.col("event_id").alias("n"), F.col("t").alias("start_s"), (F.col("t") + length).alias("end_s"))
    signals = span(e.where("state = 'click'"), 1.5).withColumn("kind", F.lit("fast")).unionByName(span(e.where("state = 'error'"), 1.0).withColumn("kind", F.lit("loud")))
    track, up = F.col("track_id"), F.col("y") > 0
    evidence = e.where("state = 'purchase' AND track_id < 3").select(
        "match_id", F.when(track == 0, "goal").when(track == 1, "card").otherwise("piece").alias("source"), F.col("event_id").alias("row"), "t",
        F.when((track == 1) & up, "red_card").when((track == 2) & up, "corner_kick").when(track == 2, "throw_in").alias("kind"),
        F.when(F.col("x") > 0, "right").otherwise("left").alias("side"), ((F.col("y") + 35) / 70).alias("confidence"), F.lit("bound").alias("reason"))
    errors = e.where("state = 'error' AND track_id = 0")
    states = span(errors, 9.0).withColumnRenamed("n", "row").join(errors.select(F.col("event_id").alias("row"), F.when(F.col("x") > 0, "stopped").otherwise("walking").alias("state")), "row")
    marks = bookmarks.candidate_bookmarks(span(e.where("state = 'view'"), 2.0), signals, evidence, states, TARGETS, bucket=8.0)
    return marks.select("match_id", "index", "event_type", F.round("confidence", 6).alias("confidence"), "occurred_at_s", "label", F.array_join("sources", ",").alias("sources"), "fast_s", "loud_s", "game_state", "bookmark_id")


#: Analysed events: types, optional windows, teams and tracks, from the types of events.
ANALYSED_SQL = f"""{BOUND_SQL}, a AS (SELECT match_id, event_id, CASE state WHEN 'purchase' THEN 'goal' WHEN 'error' THEN 'yellow_card' WHEN 'signup' THEN 'corner_kick' WHEN 'click' THEN 'sprint' ELSE ' Shot ' END AS type,
 t, CASE WHEN event_id % 3 = 0 THEN t - 1.5 END AS t_start, CASE WHEN event_id % 3 = 0 THEN t + 2.5 END AS t_end, (y + 35.0) / 60 AS confidence, x, y, team, track_id, CASE WHEN event_id % 4 = 0 THEN (track_id + 1) % 7 END AS second FROM bound)"""


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, every3 = F.col("state"), F.col("event_id") % 3 == 0
    kind = F.when(state == "purchase", "goal").when(state == "error", "yellow_card").when(state == "signup", "corner_kick").when(state == "click", "sprint").otherwise(" Shot ")
    return bound(spark, sf_dir).select(
        "match_id", "event_id", kind.alias("type"), "t", F.when(every3, F.col("t") - 1.5).alias("t_start"), F.when(every3, F.col("t") + 2.5).alias("t_end"), ((F.col("y") + 35.0) / 60).alias("confidence"),
        "x", "y", "team", "track_id", F.when(F.col("event_id") % 4 == 0, (F.col("track_id") + 1) % 7).alias("second_track_id"))


def _clips(events: DataFrame) -> DataFrame:
    """A clip for every eight hours of a match, with its goals and cards."""
    slot = F.floor(F.col("t") / 8)
    return events.where("type IN ('goal', 'yellow_card')").groupBy("match_id", slot.alias("slot")).agg(F.collect_list("event_id").alias("event_ids")).select(
        "match_id", F.col("slot").cast("int").alias("clip_index"), (F.col("slot") * 8.0).alias("t_start"), (F.col("slot") * 8.0 + 8).alias("t_end"), "event_ids")


@query(f"""
WITH {ANALYSED_SQL}, k AS (SELECT *, CASE WHEN x > 0 THEN 'right' END AS side, CASE WHEN event_id % 2 = 0 THEN CAST(floor(t / 8) AS INT) END AS clip FROM a WHERE type IN ('goal', 'yellow_card'))
SELECT match_id, event_id, row_number() OVER (PARTITION BY match_id ORDER BY t, event_id) AS index, trim(type) || '_detected' AS label, round(confidence, 3) AS confidence, round(floor(t / 8) * 8 + 12.5, 3) AS start_s, round(t + 12.5, 3) AS occurred_at_s,
 round(floor(t / 8) * 8 + 20.5, 3) AS end_s, 8.0 AS duration_s, 'ball_tracking' AS sources, CAST(floor(t / 8) AS INT) AS clip_index, CASE WHEN type = 'goal' THEN side END AS goal_side, CASE WHEN type <> 'goal' THEN 'bound' END AS card_reason FROM k WHERE event_id % 2 = 0
""")
def clip_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks of the events that a reel chose, with their clips' windows."""
    e = _analysed(spark, sf_dir)
    rows = e.select(
        "match_id", "event_id", "type", "t", "t_start", "t_end", "confidence", F.lit(0.5).alias("excitement"), F.when(F.col("x") > 0, "right").alias("side"), F.lit("bound").alias("reason"),
        "team", "track_id", F.array().cast("array<string>").alias("sources"), F.lit("in_play").alias("game_state"))
    chosen = e.where("type IN ('goal', 'yellow_card') AND event_id % 2 = 0")
    marks = bookmarks.event_bookmarks(rows, chosen, _clips(chosen), 12.5)
    return marks.select(
        "match_id", "event_id", "index", "label", "confidence", "start_s", "occurred_at_s", "end_s", "duration_s", F.array_join("sources", ",").alias("sources"), "clip_index",
        F.try_element_at("signals", F.lit("goal_side")).alias("goal_side"), F.try_element_at("signals", F.lit("card_reason")).alias("card_reason"))


@query(f"""
WITH {ANALYSED_SQL}, w AS (SELECT *, event_id % 5 = 0 AS marked FROM a WHERE match_id % 3 <> 2),
 r AS (SELECT match_id, event_id, lower(trim(type)) AS event_type, least(1.0, greatest(0.0, confidence)) AS confidence, CASE WHEN marked THEN t - 2 ELSE coalesce(t_start, t - 4) + 1.5 END AS s, t + 1.5 AS o,
  CASE WHEN marked THEN t + 1 ELSE coalesce(t_end, t + 6) + 1.5 END AS e, CASE team WHEN 0 THEN 'home' ELSE 'away' END AS team_id, CASE WHEN track_id < 6 THEN CAST(track_id + 10 AS VARCHAR) END AS jersey_number,
  'primary:' || track_id || ':' || CASE WHEN track_id < 6 THEN CAST(track_id + 10 AS VARCHAR) ELSE '' END || CASE WHEN second IS NOT NULL THEN ' secondary:' || second || ':' || CASE WHEN second < 6 THEN CAST(second + 10 AS VARCHAR) ELSE '' END ELSE '' END AS people,
  round(abs(x) / 1271, 4) AS x_norm, marked AS selected FROM w
  UNION ALL SELECT match_id, event_id, lower(trim(type)), least(1.0, greatest(0.0, confidence)), t - 2, t, t + 1, CASE team WHEN 0 THEN 'home' ELSE 'away' END, NULL, '', NULL, true FROM a WHERE match_id % 3 = 2 AND event_id % 5 = 0),
 n AS (SELECT *, greatest(0, CAST(round_even(s * 1000, 0) AS BIGINT)) AS start_ms FROM r), z AS (SELECT *, greatest(start_ms, CAST(round_even(e * 1000, 0) AS BIGINT)) AS end_ms FROM n)
SELECT match_id, event_id, event_type, round(confidence, 6) AS confidence, start_ms, least(greatest(start_ms, CAST(round_even(o * 1000, 0) AS BIGINT)), end_ms) AS occurred_ms, end_ms, team_id, jersey_number, people, x_norm, selected FROM z
""")
def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run stores: analysed events with bookmarks and shirts; every third match has bookmarks alone."""
    e = _analysed(spark, sf_dir)
    marks = e.where("event_id % 5 = 0").select(
        "match_id", F.concat(F.lit("bm_"), F.col("event_id").cast("string")).alias("bookmark_id"), "event_id", F.col("type").alias("event_type"), (F.col("t") - 2).alias("start_s"), F.col("t").alias("occurred_at_s"),
        (F.col("t") + 1).alias("end_s"), "confidence", "team")
    number = F.when(F.col("track_id") < 6, (F.col("track_id") + 10).cast("string")).otherwise("")
    every = e.select("match_id").distinct().select("match_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("track_id"))
    tracks = every.select("match_id", "track_id", number.alias("jersey_number"), F.lit(1271.0).alias("frame_width"), F.lit(720.0).alias("frame_height"))
    rows = bookmarks.stored_events(e.where("match_id % 3 <> 2").withColumns({"ball_x": F.abs("x"), "ball_y": F.lit(1.0)}), marks, tracks, 1.5)
    people = F.array_join(F.transform("participants", lambda p: F.concat(p["role"], F.lit(":"), p["track_id"].cast("string"), F.lit(":"), F.coalesce(p["jersey_number"], F.lit("")))), " ")
    return rows.select(
        "match_id", "event_id", "event_type", F.round("confidence", 6).alias("confidence"), "start_ms", "occurred_ms", "end_ms", "team_id", "jersey_number", people.alias("people"), F.col("location.x_norm").alias("x_norm"), "selected")


@query(f"""
WITH {BOUND_SQL}, k AS (SELECT match_id, CASE WHEN track_id < 6 THEN team ELSE -1 END AS team, CASE state WHEN 'purchase' THEN 'goal' WHEN 'error' THEN 'chance' WHEN 'signup' THEN 'red_card' WHEN 'click' THEN 'shot' ELSE 'turnover' END AS type, x > 0 AS hit FROM bound),
 m AS (SELECT match_id, unnest([0, 1]) AS team FROM (SELECT DISTINCT match_id FROM k))
SELECT m.match_id, m.team, count(*) FILTER (type = 'goal') AS goals, count(*) FILTER (type = 'shot' OR (type = 'chance' AND hit)) AS shots, count(*) FILTER (type = 'shot' AND hit) AS shots_on_target, count(*) FILTER (type = 'save') AS saves,
 count(*) FILTER (type = 'chance') AS chances, count(*) FILTER (type = 'corner_kick') AS corners, count(*) FILTER (type = 'free_kick') AS free_kicks, count(*) FILTER (type = 'red_card') AS cards, count(*) FILTER (type = 'sprint') AS sprints,
 count(*) FILTER (type = 'dribble') AS dribbles, count(*) FILTER (type = 'turnover') AS turnovers_won FROM m LEFT JOIN k ON k.match_id = m.match_id AND k.team = m.team GROUP BY 1, 2
""")
def team_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("state")
    kind = F.when(state == "purchase", "goal").when(state == "error", "chance").when(state == "signup", "red_card").when(state == "click", "shot").otherwise("turnover")
    rows = bound(spark, sf_dir).select("match_id", F.when(F.col("track_id") < 6, F.col("team")).otherwise(-1).alias("team"), kind.alias("type"), (F.col("x") > 0).alias("on_target"), (F.col("x") > 0).alias("attempt"))
    return bookmarks.event_summary(rows)


@query(f"""
WITH {BOUND_SQL}, d AS (SELECT DISTINCT match_id, track_id, t FROM bound WHERE state = 'view')
SELECT match_id, track_id, count(*) FILTER (EXISTS (SELECT 1 FROM bound s WHERE s.match_id = d.match_id AND s.track_id = d.track_id AND s.state = 'click' AND abs(s.t - d.t) <= 2.0)) AS n_seen FROM d GROUP BY 1, 2
""")
def frames_seeing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a player's views have a click of theirs within two hours."""
    e = bound(spark, sf_dir)
    times = e.where("state = 'view'").select("match_id", "track_id", F.col("t").alias("at")).distinct()
    return bookmarks.frames_seeing(e.where("state = 'click'"), times, ["match_id", "track_id"], "t", 2.0)


@query(f"""
WITH {BOUND_SQL}, d AS (SELECT match_id, track_id, max(t) - min(t) AS size FROM bound GROUP BY 1, 2), c AS (SELECT match_id, arg_max(track_id, (CASE WHEN match_id % 2 = 0 AND track_id = 3 THEN 1 ELSE 0 END, size, -track_id)) AS track_id FROM d GROUP BY 1),
 n AS (SELECT b.match_id, track_id, event_id, row_number() OVER (PARTITION BY b.match_id, track_id ORDER BY t, event_id) - 1 AS i FROM bound b JOIN c USING (match_id, track_id))
SELECT match_id, track_id, event_id FROM n WHERE i % 4 = 0
""")
def shown_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shown track of each match, at a quarter of its rate: of every second match that in focus, else the longest."""
    e = bound(spark, sf_dir)
    wanted = e.select("match_id").distinct().select("match_id", F.lit(None).cast("int").alias("asked_id"), F.when(F.col("match_id") % 2 == 0, 3).otherwise(99).alias("focus_id"))
    shown = bookmarks.every_kth(bookmarks.shown_tracks(e, wanted), ["match_id", "track_id"], ["t", "event_id"], 4)
    return shown.select("match_id", "track_id", "event_id")


@query(f"""
WITH {BOUND_SQL}, k AS (SELECT match_id, event_id, state AS type, (y + 35) / 70 AS c, CAST(floor(t * 1000) AS BIGINT) AS ms FROM bound), n AS (SELECT match_id, type, count(*) AS n FROM k GROUP BY ALL),
 t AS (SELECT match_id, CAST(sum(n) AS BIGINT) AS n, list(type || ': ' || n ORDER BY n DESC, type) [1:3] AS kinds FROM n GROUP BY 1),
 p AS (SELECT match_id, list(type || ' at ' || CAST(CAST(round_even(ms / 1000.0, 0) AS BIGINT) // 60 AS VARCHAR) || ':' || printf('%02d', CAST(round_even(ms / 1000.0, 0) AS BIGINT) % 60) || printf(' (%.2f)', c) ORDER BY c DESC, ms DESC, event_id) [1:3] AS top FROM k GROUP BY 1)
SELECT match_id, 'Match ' || match_id || ' has ' || n || ' detected events. Most common: ' || array_to_string(kinds, ', ') || '. Surest moments: ' || array_to_string(top, ', ') || '.' AS answer FROM t JOIN p USING (match_id)
""")
def match_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bound(spark, sf_dir)
    return bookmarks.match_answers(e.select("match_id", "event_id", F.col("state").alias("type"), ((F.col("y") + 35) / 70).alias("confidence"), F.floor(F.col("t") * 1000).alias("occurred_ms")))


HOSTS = ("youtu.be", "app.veo.co", "hudl.com", "www.xbotgo.com", "example.org")


@query("""
WITH j AS (SELECT o_orderkey, [NULL, 'raw_upload', 'other_link', 'unheard_of', 'youtu.be', 'app.veo.co', 'hudl.com', 'www.xbotgo.com', 'example.org'][CAST(o_orderkey % 9 AS INT) + 1] AS given FROM orders),
 s AS (SELECT o_orderkey, CASE given WHEN 'youtu.be' THEN 'youtube' WHEN 'app.veo.co' THEN 'veo' WHEN 'hudl.com' THEN 'hudl' WHEN 'www.xbotgo.com' THEN 'xbotgo' WHEN 'example.org' THEN 'other_link' WHEN 'other_link' THEN 'other_link' ELSE 'raw_upload' END AS source FROM j)
SELECT source, count(*) AS n, CASE source WHEN 'raw_upload' THEN 'file' ELSE 'link' END AS kind, CASE source WHEN 'raw_upload' THEN 15 WHEN 'veo' THEN 12 ELSE 10 END AS n_supported, CASE source WHEN 'raw_upload' THEN 'possession' WHEN 'veo' THEN 'possession' END AS possession FROM s GROUP BY 1
""")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each job's match came from, and what that source can supply; links name their provider, unknown keys are uploads."""
    given = F.get(F.array(F.lit(None), F.lit("raw_upload"), F.lit("other_link"), F.lit("unheard_of"), *[F.lit(f"https://{h}/watch?v=1") for h in HOSTS]), (F.col("o_orderkey") % 9).cast("int"))
    jobs = table(spark, sf_dir, "orders").select(F.coalesce(exprs.source_of_url(given), given).alias("key"))
    n = jobs.groupBy(stats.source_key(F.col("key")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    rows = n.join(stats.source_types(spark).withColumnRenamed("key", "source"), "source", "left")
    return rows.select("source", "n", "kind", F.size("supported").alias("n_supported"), F.when(F.array_contains("supported", "possession"), "possession").alias("possession"))
