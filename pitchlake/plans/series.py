"""Time-series queries on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.functions import exprs
from pitchlake.operators import stats
from pitchlake.operators import timeseries as ts
from pitchlake.plans.registry import query
from pitchlake.plans.tables import TRACKS_SQL, table, tracks

HOUR = 3_600_000_000


@query(f"""
WITH {TRACKS_SQL}, e AS (SELECT * FROM tracks WHERE state = 'error')
SELECT v.event_id, v.track, e.event_id AS last_error FROM (SELECT * FROM tracks WHERE state = 'purchase') v ASOF LEFT JOIN e ON v.track = e.track AND v.us >= e.us
""")
def asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last error of the same track at or before each purchase."""
    t = tracks(spark, sf_dir)
    left = t.where("state = 'purchase'").select("event_id", "track", "us")
    right = t.where("state = 'error'").select("track", "us", F.col("event_id").alias("last_error"))
    return ts.asof_backward(left, right, ["track"], "us", "us").select("event_id", "track", F.col("asof.last_error").alias("last_error"))


@query(f"""
WITH {TRACKS_SQL}, p AS (SELECT * FROM tracks WHERE state = 'purchase'), e AS (SELECT * FROM tracks WHERE state = 'error'),
 x AS (SELECT p.event_id, p.track, e.event_id AS nearest, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(e.us - p.us), e.us) AS n FROM p JOIN e ON p.track = e.track AND abs(e.us - p.us) <= 6 * {HOUR})
SELECT p.event_id, p.track, x.nearest FROM p LEFT JOIN x ON p.event_id = x.event_id AND x.n = 1
""")
def nearest_in_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    left = t.where("state = 'purchase'").select("event_id", "track", "us")
    right = t.where("state = 'error'").select("track", "us", F.col("event_id").alias("nearest"))
    return ts.asof_nearest(left, right, ["track"], "us", "us", 6 * HOUR).select("event_id", "track", F.col("asof.nearest").alias("nearest"))


@query(f"""
WITH {TRACKS_SQL}, s AS (SELECT track, us / 3600e6 AS t, x, y FROM tracks),
 n AS (SELECT track, t, x, y, lead(t) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM s WINDOW w AS (PARTITION BY track ORDER BY t)),
 g AS (SELECT *, unnest(generate_series(CAST(ceil(t - 1e-9) AS BIGINT), coalesce(CAST(ceil(t2 - 1e-9) AS BIGINT) - 1, CAST(floor(t + 1e-9) AS BIGINT)))) AS g FROM n)
SELECT track, g, CASE WHEN coalesce(t2 - t <= 6.0, false) OR least(abs(g - t), coalesce(abs(t2 - g), 1e300)) <= 0.5 THEN true ELSE false END AS observed,
 round(CASE WHEN coalesce(t2 - t <= 6.0, false) OR least(abs(g - t), coalesce(abs(t2 - g), 1e300)) <= 0.5 THEN x + coalesce((x2 - x) * CASE WHEN t2 > t THEN (g - t) / (t2 - t) ELSE 0 END, 0) END, 4) AS x,
 round(CASE WHEN coalesce(t2 - t <= 6.0, false) OR least(abs(g - t), coalesce(abs(t2 - g), 1e300)) <= 0.5 THEN y + coalesce((y2 - y) * CASE WHEN t2 > t THEN (g - t) / (t2 - t) ELSE 0 END, 0) END, 4) AS y FROM g
""")
def grid_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly positions by interpolation, null inside gaps of more than six hours."""
    t = tracks(spark, sf_dir).select("track", (F.col("us") / 3600e6).alias("t"), "x", "y")
    return ts.resample_grid(t, ["track"], "t", ["x", "y"], 1.0, 6.0, 0.5).select("track", "g", "observed", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""
WITH {TRACKS_SQL}, n AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 4 * {HOUR} THEN 0 ELSE 1 END AS fresh FROM tracks WINDOW w AS (PARTITION BY track ORDER BY us, event_id)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT track, CAST(island AS BIGINT) AS island, min(us) AS first_us, max(us) AS last_us, count(*) AS n, arg_max(event_id, (x, -us)) AS best FROM i GROUP BY ALL
""")
def islands_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of samples at most four hours apart, with the strongest sample as representative."""
    rows = ts.islands_by_gap(tracks(spark, sf_dir), ["track"], "us", 4 * HOUR, tie=["event_id"])
    return rows.groupBy("track", "island").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"), F.max_by("event_id", F.struct("x", -F.col("us"))).alias("best"))


@query(f"""
WITH {TRACKS_SQL}, s AS (SELECT track, us AS a, us + CAST(floor(x * 60e6) AS BIGINT) AS b FROM tracks),
 r AS (SELECT *, max(b) OVER (PARTITION BY track ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
 i AS (SELECT *, sum(CASE WHEN a - reach <= 600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT track, min(a) AS a, max(b) AS b, count(*) AS n_merged FROM i GROUP BY track, island
""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).select("track", F.col("us").alias("a"), (F.col("us") + F.floor(F.col("x") * 60e6)).alias("b"))
    return ts.merge_intervals(rows, ["track"], "a", "b", 600_000_000)


@query(f"""
WITH {TRACKS_SQL}, s AS (SELECT track, us AS a, us + 2 * {HOUR} AS b, event_id AS segment FROM tracks WHERE state = 'error')
SELECT t.event_id, s.segment FROM tracks t JOIN s ON t.track = s.track AND t.us >= s.a AND t.us < s.b
""")
def range_join_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples inside the two hours after an error of their track."""
    t = tracks(spark, sf_dir)
    segments = t.where("state = 'error'").select("track", F.col("us").alias("a"), (F.col("us") + 2 * HOUR).alias("b"), F.col("event_id").alias("segment"))
    return ts.range_join(t.select("event_id", "track", "us"), segments, ["track"], "us", "a", "b", 2 * HOUR).select("event_id", "segment")


@query(f"""
WITH {TRACKS_SQL}, s AS (SELECT track, us AS a, us + 3 * {HOUR} AS b FROM tracks WHERE state = 'error'), v AS (SELECT event_id, track, us - {HOUR} AS a, us + 2 * {HOUR} AS b FROM tracks WHERE state = 'purchase')
SELECT v.event_id, CAST(sum(greatest(0, least(v.b, s.b) - greatest(v.a, s.a))) AS BIGINT) AS overlap FROM v JOIN s ON v.track = s.track AND v.a < s.b AND s.a < v.b GROUP BY v.event_id
""")
def overlap_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each purchase's window overlaps error windows; both sides are spread over buckets and each pair counted once."""
    t = tracks(spark, sf_dir)
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / (3 * HOUR)), F.floor(F.col(b) / (3 * HOUR))))
    s = t.where("state = 'error'").select("track", F.col("us").alias("sa"), (F.col("us") + 3 * HOUR).alias("sb")).withColumn("bucket", spread("sa", "sb"))
    v = t.where("state = 'purchase'").select("event_id", "track", (F.col("us") - HOUR).alias("va"), (F.col("us") + 2 * HOUR).alias("vb")).withColumn("bucket", spread("va", "vb"))
    both = v.join(s, ["track", "bucket"]).where("va < sb AND sa < vb").where(F.floor(F.greatest("va", "sa") / (3 * HOUR)) == F.col("bucket"))
    return both.groupBy("event_id").agg(F.sum(exprs.interval_overlap(F.col("va"), F.col("vb"), F.col("sa"), F.col("sb"))).cast("long").alias("overlap"))


@query(f"""
WITH {TRACKS_SQL} SELECT state, round(quantile_cont(x, 0.005), 6) AS lo, round(quantile_cont(x, 0.995), 6) AS hi, round(quantile_cont(y, 0.5), 6) AS mid, round(quantile_cont(x, 0.95), 6) AS p95 FROM tracks GROUP BY state
""")
def percentile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda c, q: F.round(F.percentile(c, F.lit(q)), 6)
    return tracks(spark, sf_dir).groupBy("state").agg(p("x", 0.005).alias("lo"), p("x", 0.995).alias("hi"), p("y", 0.5).alias("mid"), p("x", 0.95).alias("p95"))


@query(f"""
WITH {TRACKS_SQL}, m AS (SELECT track, median(x) AS med, mad(x) AS mad FROM tracks GROUP BY track),
 n AS (SELECT event_id, track, x, lag(x) OVER w AS was, lead(x) OVER w AS next FROM tracks WINDOW w AS (PARTITION BY track ORDER BY us))
SELECT event_id, n.track, x, round(med + 2.0 * (1.4826 * mad + 1e-12), 6) AS threshold FROM n JOIN m ON n.track = m.track WHERE coalesce(x > was, true) AND coalesce(x >= next, true) AND x >= med + 2.0 * (1.4826 * mad + 1e-12)
""")
def mad_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local maxima above the track's median by two scaled median deviations."""
    return ts.local_maxima(tracks(spark, sf_dir).select("event_id", "track", "us", "x"), ["track"], "us", "x", 2.0).select("event_id", "track", "x", F.round("threshold", 6).alias("threshold"))


@query(f"""
WITH {TRACKS_SQL}, p AS (SELECT track, (x - 60) * 0.8 AS px, CASE track % 2 WHEN 0 THEN 1 ELSE -1 END AS d FROM tracks)
SELECT track, round(100.0 * count(*) FILTER (px * d < -17.5) / count(*), 1) AS own, round(100.0 * count(*) FILTER (px * d >= -17.5 AND px * d <= 17.5) / count(*), 1) AS middle,
 round(100.0 * count(*) FILTER (px * d > 17.5) / count(*), 1) AS attacking FROM p GROUP BY track
""")
def thirds_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).withColumn("third", exprs.third((F.col("x") - 60) * 0.8, F.expr("CASE track % 2 WHEN 0 THEN 1 ELSE -1 END")))
    share = lambda n: F.round(100.0 * F.count_if(F.col("third") == n) / F.count(F.lit(1)), 1)
    return rows.groupBy("track").agg(share(0).alias("own"), share(1).alias("middle"), share(2).alias("attacking"))


@query(f"""
WITH {TRACKS_SQL}, b AS (SELECT state, CAST(least(13, floor(y / 100.0 * 14)) AS BIGINT) AS by_, CAST(least(20, floor(least(x, 200.0) / 200.0 * 21)) AS BIGINT) AS bx FROM tracks),
 c AS (SELECT state, by_, bx, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT state, sum(n) AS total FROM c GROUP BY state)
SELECT k.state, gy AS bin_y, gx AS bin_x, round(coalesce(c.n, 0) / k.total, 6) AS share FROM k CROSS JOIN generate_series(0, 13) AS a(gy) CROSS JOIN generate_series(0, 20) AS d(gx)
LEFT JOIN c ON c.state = k.state AND c.by_ = gy AND c.bx = gx
""")
def heatmap2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense 14 x 21 share of samples per state; the upper edge belongs to the last bin."""
    bins = F.least(F.lit(13), F.floor(F.col("y") / 100.0 * 14)).cast("long"), F.least(F.lit(20), F.floor(F.least("x", F.lit(200.0)) / 200.0 * 21)).cast("long")
    rows = tracks(spark, sf_dir).select("state", bins[0].alias("bin_y"), bins[1].alias("bin_x")).groupBy("state", "bin_y", "bin_x").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("state").agg(F.sum("n").alias("total"))
    frame = total.withColumn("bin_y", F.explode(F.sequence(F.lit(0), F.lit(13)).cast("array<bigint>"))).withColumn("bin_x", F.explode(F.sequence(F.lit(0), F.lit(20)).cast("array<bigint>")))
    return frame.join(rows, ["state", "bin_y", "bin_x"], "left").select("state", "bin_y", "bin_x", F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("share"))


@query(f"""
WITH {TRACKS_SQL}, z AS (SELECT min(us) AS t0 FROM tracks), b AS (SELECT state, (us - t0) // (24 * {HOUR}) AS bin, x FROM tracks, z), k AS (SELECT state, max(bin) + 1 AS n FROM b GROUP BY state),
 c AS (SELECT state, bin, count(*) AS n, round(sum(x), 4) AS total FROM b GROUP BY ALL)
SELECT k.state, g AS bin, coalesce(c.n, 0) AS n, coalesce(c.total, 0) AS total FROM k, LATERAL (SELECT unnest(generate_series(0, k.n - 1)) AS g) LEFT JOIN c ON c.state = k.state AND c.bin = g
""")
def timeline_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    start = t.agg(F.min("us").alias("t0"))
    rows = t.join(start).withColumn("bin", F.floor((F.col("us") - F.col("t0")) / (24 * HOUR)))
    return ts.dense_bins(rows, ["state"], "bin", F.max("bin") + 1, {"n": F.count(F.lit(1)), "total": F.round(F.sum("x"), 4)})


@query(f"""
WITH {TRACKS_SQL}, s AS (SELECT track, us, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) / ((us - lag(us) OVER w) / 3600e6) AS v FROM tracks WINDOW w AS (PARTITION BY track ORDER BY us, event_id))
SELECT track, us // (24 * {HOUR}) AS day, round(avg(coalesce(v, 0)), 4) AS speed FROM s GROUP BY ALL
""")
def speed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean speed a day; a track's first sample counts as standing."""
    w = Window.partitionBy("track").orderBy("us", "event_id")
    lagged = lambda c: F.col(c) - F.lag(c).over(w)
    v = F.sqrt(lagged("x") * lagged("x") + lagged("y") * lagged("y")) / F.nullif(lagged("us") / 3600e6, F.lit(0.0))
    return tracks(spark, sf_dir).withColumn("v", v).groupBy("track", F.floor(F.col("us") / (24 * HOUR)).alias("day")).agg(F.round(F.avg(F.coalesce("v", F.lit(0.0))), 4).alias("speed"))


@query(f"""
WITH {TRACKS_SQL}, v AS (SELECT event_id, first_value(us) OVER w AS t1, last_value(us) OVER w AS t2, first_value(x) OVER w AS x1, last_value(x) OVER w AS x2 FROM tracks
 WINDOW w AS (PARTITION BY track ORDER BY us RANGE BETWEEN 4 * {HOUR} PRECEDING AND 4 * {HOUR} FOLLOWING))
SELECT event_id, round(CASE WHEN t2 > t1 THEN (x2 - x1) / ((t2 - t1) / 1e6) ELSE 0 END, 8) AS v_x FROM v
""")
def velocity_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.velocity(tracks(spark, sf_dir), ["track"], "us", ["x"], 4 * HOUR).select("event_id", F.round("v_x", 8).alias("v_x"))


@query(f"""
WITH {TRACKS_SQL}, n AS (SELECT track, us AS gap_start, lead(us) OVER (PARTITION BY track ORDER BY us) AS gap_end FROM tracks) SELECT * FROM n WHERE gap_end - gap_start > 30 * {HOUR}
""")
def visibility_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.gaps(tracks(spark, sf_dir), ["track"], "us", 30 * HOUR)


@query(f"""
WITH {TRACKS_SQL}, touch AS (SELECT track // 7 AS match, track, us, CASE track % 2 WHEN 0 THEN 'home' ELSE 'away' END AS team FROM tracks WHERE state IN ('click', 'purchase')),
 g AS (SELECT m.match, unnest(generate_series(lo, hi, {HOUR})) AS at FROM (SELECT match, min(us) // {HOUR} * {HOUR} AS lo, max(us) AS hi FROM touch GROUP BY match) m),
 s AS (SELECT g.match, g.at, t.team, g.at - t.us AS age FROM g ASOF LEFT JOIN touch t ON g.match = t.match AND g.at >= t.us),
 c AS (SELECT match, CASE WHEN team IS NULL THEN 'unknown' WHEN age > 2 * {HOUR} THEN 'stale' ELSE team END AS who FROM s)
SELECT match, round(100.0 * count(*) FILTER (who = 'home') / nullif(count(*) FILTER (who IN ('home', 'away')), 0), 1) AS home_pct, count(*) FILTER (who = 'stale') AS stale, count(*) AS samples FROM c GROUP BY match
""")
def possession_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of known hourly samples in which the last touch was a home one; samples two hours after it are unknown."""
    touch = tracks(spark, sf_dir).where("state IN ('click', 'purchase')").select(F.floor(F.col("track") / 7).alias("match"), "us", F.expr("CASE track % 2 WHEN 0 THEN 'home' ELSE 'away' END").alias("team"))
    grid = touch.groupBy("match").agg((F.floor(F.min("us") / HOUR) * HOUR).alias("lo"), F.max("us").alias("hi")).select("match", F.explode(F.sequence("lo", "hi", F.lit(HOUR))).alias("at"))
    at = ts.asof_backward(grid, touch, ["match"], "at", "us")
    who = F.when(F.col("asof.team").isNull(), "unknown").when(F.col("at") - F.col("asof.us") > 2 * HOUR, "stale").otherwise(F.col("asof.team"))
    known = F.count_if(F.col("who").isin("home", "away"))
    return at.withColumn("who", who).groupBy("match").agg(F.round(100.0 * F.count_if(F.col("who") == "home") / F.nullif(known, F.lit(0)), 1).alias("home_pct"), F.count_if(F.col("who") == "stale").alias("stale"), F.count(F.lit(1)).alias("samples"))


@query(f"""
WITH {TRACKS_SQL}, r AS (SELECT track // 7 AS match, track, us, event_id, x, state, sum(CASE WHEN state = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY track // 7 ORDER BY us, event_id) AS breaks FROM tracks),
 p AS (SELECT match, track, event_id, us, x, breaks, lead(track) OVER w AS to_track, lead(us) OVER w AS to_us, lead(x) OVER w AS to_x, lead(breaks) OVER w AS to_breaks FROM r WHERE state IN ('click', 'purchase')
  WINDOW w AS (PARTITION BY match ORDER BY us, event_id))
SELECT match, event_id, track, to_track, track % 2 = to_track % 2 AS complete FROM p WHERE to_track <> track AND to_us > us AND to_us - us <= 4 * {HOUR} AND abs(to_x - x) > 3.0 AND to_breaks = breaks
""")
def passes_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two neighbouring touches of different players, close in time, apart in space, with no interruption between them."""
    w = Window.partitionBy("match").orderBy("us", "event_id")
    rows = tracks(spark, sf_dir).withColumn("match", F.floor(F.col("track") / 7)).withColumn("breaks", F.sum((F.col("state") == "error").cast("int")).over(w)).where("state IN ('click', 'purchase')")
    rows = rows.withColumns({f"to_{c}": F.lead(c).over(w) for c in ("track", "us", "x", "breaks")})
    ok = (F.col("to_track") != F.col("track")) & (F.col("to_us") > F.col("us")) & (F.col("to_us") - F.col("us") <= 4 * HOUR) & (F.abs(F.col("to_x") - F.col("x")) > 3.0) & (F.col("to_breaks") == F.col("breaks"))
    return rows.where(ok).select("match", "event_id", "track", "to_track", (F.col("track") % 2 == F.col("to_track") % 2).alias("complete"))


@query(f"""
WITH {TRACKS_SQL}, r AS (SELECT track // 7 AS match, us, event_id, CASE WHEN state IN ('click', 'purchase') THEN track % 2 END AS team FROM tracks),
 n AS (SELECT *, last_value(team IGNORE NULLS) OVER (PARTITION BY match ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was, lead(team, 1) OVER w AS next1, lead(team, 2) OVER w AS next2 FROM r WINDOW w AS (PARTITION BY match ORDER BY us, event_id))
SELECT match, event_id, team FROM n WHERE team IS NOT NULL AND was <> team AND coalesce(next1 = team, true) AND coalesce(next2 = team, true)
""")
def turnovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The possessing team changes and holds for the next two samples."""
    w = Window.partitionBy("match").orderBy("us", "event_id")
    rows = tracks(spark, sf_dir).withColumn("match", F.floor(F.col("track") / 7)).withColumn("team", F.when(F.col("state").isin("click", "purchase"), F.col("track") % 2))
    rows = rows.withColumn("was", F.last("team", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("n1", F.lead("team", 1).over(w)).withColumn("n2", F.lead("team", 2).over(w))
    holds = F.coalesce(F.col("n1") == F.col("team"), F.lit(True)) & F.coalesce(F.col("n2") == F.col("team"), F.lit(True))
    return rows.where(F.col("team").isNotNull() & (F.col("was") != F.col("team")) & holds).select("match", "event_id", "team")


@query(f"""
WITH {TRACKS_SQL} SELECT event_id, track // 7 AS match, CAST(sum(CASE WHEN state = 'purchase' AND track % 2 = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS home, CAST(sum(CASE WHEN state = 'purchase' AND track % 2 = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS away
FROM tracks WINDOW w AS (PARTITION BY track // 7 ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)
""")
def running_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("match").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    score = lambda team: F.sum(((F.col("state") == "purchase") & (F.col("track") % 2 == team)).cast("int")).over(w)
    return tracks(spark, sf_dir).withColumn("match", F.floor(F.col("track") / 7)).select("event_id", "match", score(0).alias("home"), score(1).alias("away"))


@query(f"""
WITH {TRACKS_SQL}, n AS (SELECT *, lag(state) OVER w AS was, lag(event_id) OVER w AS before FROM tracks WINDOW w AS (PARTITION BY track ORDER BY us, event_id)) SELECT event_id, track, state FROM n WHERE before IS NULL OR state IS DISTINCT FROM was
""")
def zoom_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the rows that differ from the row before."""
    return ts.change_capture(tracks(spark, sf_dir).withColumn("at", F.struct("us", "event_id")), ["track"], "at", ["state"]).select("event_id", "track", "state")


@query(f"""
WITH {TRACKS_SQL}, n AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 8 * {HOUR} THEN 0 ELSE 1 END AS fresh FROM tracks WINDOW w AS (PARTITION BY track, state ORDER BY us, event_id)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY track, state ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT track, state, arg_max(event_id, (x, -us)) AS best, min(us) AS start_us, max(us) AS end_us, count(*) AS merged, array_to_string(list_sort(list_distinct(list(y))), ',') AS sources FROM i GROUP BY track, state, island
""")
def merge_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-type events that follow each other merge: strongest representative, widest window, all sources."""
    rows = ts.islands_by_gap(tracks(spark, sf_dir), ["track", "state"], "us", 8 * HOUR, tie=["event_id"])
    return rows.groupBy("track", "state", "island").agg(
        F.max_by("event_id", F.struct("x", -F.col("us"))).alias("best"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("merged"),
        F.array_join(F.array_sort(F.collect_set("y")).cast("array<string>"), ",").alias("sources")).drop("island")


@query(f"""
WITH RECURSIVE {TRACKS_SQL}, b AS (SELECT track // 7 AS match, us // (24 * {HOUR}) AS day, CAST(sum(CASE state WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS DOUBLE) AS r FROM tracks GROUP BY ALL),
 n AS (SELECT *, row_number() OVER (PARTITION BY match ORDER BY day) AS i FROM b),
 e AS (SELECT match, i, day, 0.4 * r AS acc FROM n WHERE i = 1 UNION ALL SELECT n.match, n.i, n.day, 0.4 * n.r + 0.6 * e.acc FROM e JOIN n ON n.match = e.match AND n.i = e.i + 1)
SELECT match, day, round(acc / max(abs(acc)) OVER (PARTITION BY match), 6) AS momentum FROM e
""")
def ema_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily balance, smoothed by an exponential average and scaled to its largest swing."""
    r = F.sum(F.expr("CASE state WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END")).cast("double")
    days = tracks(spark, sf_dir).groupBy(F.floor(F.col("track") / 7).alias("match"), F.floor(F.col("us") / (24 * HOUR)).alias("day")).agg(r.alias("r"))
    rows = days.groupBy("match").agg(F.sort_array(F.collect_list(F.struct("day", "r"))).alias("s")).withColumn("acc", ts.ema(F.col("s.r"), 0.4))
    top = F.array_max(F.transform("acc", F.abs))
    return rows.withColumn("top", top).select("match", "top", F.explode(F.arrays_zip(F.col("s.day").alias("day"), F.col("acc").alias("acc"))).alias("z")).select("match", F.col("z.day").alias("day"), F.round(F.col("z.acc") / F.col("top"), 6).alias("momentum"))


@query(f"""
WITH RECURSIVE {TRACKS_SQL}, s AS (SELECT track, CAST(us AS DOUBLE) AS us FROM tracks WHERE state = 'click'),
 k AS (SELECT track, min(us) AS us FROM s GROUP BY track UNION ALL SELECT k.track, (SELECT min(s.us) FROM s WHERE s.track = k.track AND s.us >= k.us + 24.0 * {HOUR}) FROM k WHERE k.us IS NOT NULL)
SELECT track, us FROM k WHERE us IS NOT NULL
""")
def greedy_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks at least a day after the last one kept: a fold, since lag() would compare with dropped rows."""
    return ts.debounce(tracks(spark, sf_dir).where("state = 'click'"), ["track"], "us", 24 * HOUR)


@query("""
WITH q AS (SELECT vec_id AS q, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
 h AS (SELECT q, list_transform(a, lambda x: abs(x)) AS a FROM q), v AS (SELECT vec_id AS m, list_transform(embedding, lambda x: abs(x)) AS b FROM embeddings),
 s AS (SELECT q, m, round(list_sum(list_transform(list_zip(a, b), lambda z: sqrt(CAST(z[1] AS DOUBLE) * z[2]))) / sqrt(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE))) * list_sum(list_transform(b, lambda x: CAST(x AS DOUBLE)))), 6) AS sim FROM h CROSS JOIN v WHERE q <> m),
 r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, m) AS rank FROM s) SELECT q, m, sim, rank FROM r WHERE rank <= 5
""")
def bhattacharyya_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar appearance histograms of a stated set of queries, against all rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x)).alias("h"))
    return stats.most_similar(e, e.where("vec_id % 100 = 0"), "vec_id", "h", 5)


@query(f"""
WITH {TRACKS_SQL}, n AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY us, event_id) - 1 AS i, x FROM tracks), b AS (SELECT track, i // 4 AS block, avg(x * x) AS ms FROM n GROUP BY ALL)
SELECT track, block, round(sqrt((ms + coalesce(lag(ms) OVER (PARTITION BY track ORDER BY block), ms)) / 2), 6) AS rms FROM b
""")
def envelope_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("track").orderBy("us", "event_id")) - 1)
    return ts.block_mean_squares(rows, ["track"], "i", "x", 4).withColumn("rms", F.round("rms", 6))


@query(f"""
WITH {TRACKS_SQL}, n AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY us, event_id) AS i, x FROM tracks)
SELECT track, i, round(least(min(x - 2.0 * i) OVER (PARTITION BY track ORDER BY i ROWS UNBOUNDED PRECEDING) + 2.0 * i, min(x + 2.0 * i) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2.0 * i), 6) AS envelope FROM n
""")
def slope_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks(spark, sf_dir).select("track", F.row_number().over(Window.partitionBy("track").orderBy("us", "event_id")).alias("i"), "x")
    return ts.lipschitz_below(rows, ["track"], "i", "x", 2.0).select("track", "i", F.round("envelope", 6).alias("envelope"))


@query(f"""
WITH {TRACKS_SQL}, f AS (SELECT *, x > 60 AS fast FROM tracks), n AS (SELECT *, CASE WHEN fast IS DISTINCT FROM lag(fast) OVER w THEN 1 ELSE 0 END AS fresh FROM f WINDOW w AS (PARTITION BY track ORDER BY us, event_id)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT track, min(us) AS start_us, max(us) AS end_us, count(*) AS n, max(x) AS peak FROM i WHERE fast GROUP BY track, island HAVING count(*) >= 2
""")
def sprint_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least two fast samples."""
    rows = ts.islands_by_value(tracks(spark, sf_dir), ["track"], ["us", "event_id"], F.col("x") > 60).where("x > 60")
    return rows.groupBy("track", "island").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"), F.max("x").alias("peak")).where("n >= 2").drop("island")


@query("""
WITH n AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations)
SELECT conv_id, count(*) AS turns, count(*) FILTER (was IS NOT NULL AND was <> role) AS exchanges, count(*) FILTER (was = role) AS repeats FROM n GROUP BY conv_id
""")
def touch_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("was", F.lag("role").over(w))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("was") != F.col("role")).alias("exchanges"), F.count_if(F.col("was") == F.col("role")).alias("repeats"))


@query(f"""
WITH {TRACKS_SQL} SELECT event_id, track, round((0.9 * x - 0.1 * y + 3) / (0.0005 * x + 0.001 * y + 1), 6) AS px, round((0.2 * x + 0.8 * y - 2) / (0.0005 * x + 0.001 * y + 1), 6) AS py,
 abs((0.9 * x - 0.1 * y + 3) / (0.0005 * x + 0.001 * y + 1)) <= 52.5 + 1 AND abs((0.2 * x + 0.8 * y - 2) / (0.0005 * x + 0.001 * y + 1)) <= 34 + 1 AS inside FROM tracks
""")
def homography_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = [[0.9, -0.1, 3.0], [0.2, 0.8, -2.0], [0.0005, 0.001, 1.0]]
    px, py = exprs.project(h, F.col("x"), F.col("y"))
    return tracks(spark, sf_dir).select("event_id", "track", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"), exprs.in_bounds(px, py, 1.0).alias("inside"))
