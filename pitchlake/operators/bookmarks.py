"""From candidate intervals and analysed events to bookmarks, stored rows, summaries and texts, for all matches at once.

Intervals meet points and other intervals by time buckets and keys; what an interval gathers (overlaps, the first
goal, card and set piece in it) is one aggregation over its contributions, so that a run with many signals needs no
join for each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import exprs
from pitchlake.operators import timeseries as ts

#: Types that a run may ask for, and those that count as set pieces. Fixed values.
ASKABLE = ("goal", "shot", "corner_kick", "penalty_kick", "free_kick", "goal_kick", "kickoff", "foul", "save")
SET_PIECES = ("corner_kick", "free_kick", "penalty_kick", "goal_kick", "kickoff")
CARDS = ("yellow_card", "red_card")
#: (fast, loud): types in order of preference, the first of them that is asked for counts, and the type when none is. Fixed values.
PREFERRED = {
    (True, True): (("goal", "shot", "penalty_kick", "save"), "goal"),
    (True, False): (("shot", "goal", "penalty_kick", "corner_kick", "free_kick", "save"), "shot"),
    (False, True): (("foul", "kickoff", "goal", "corner_kick"), "foul"),
}
#: Confidence of an interval, and what each sign adds. Fixed values.
BASE, FAST, LOUD, ASKED, LOUD_GOAL, SET_PIECE, MOST = 0.45, 0.22, 0.18, 0.08, 0.05, 0.8, 0.99


def guessed_type(targets: Sequence[str], fast: bool, loud: bool) -> str:
    """What an interval with these signals is taken for, when nothing was detected in it."""
    asked = [t for t in targets if t in ASKABLE]
    if len(set(asked)) == 1:
        return asked[0]
    order, otherwise = PREFERRED.get((fast, loud), (asked, "shot"))
    return next((t for t in order if t in asked), otherwise)


def overlaps(intervals: DataFrame, others: DataFrame, bucket: float) -> DataFrame:
    """(match_id, n, kind, seconds): how long each interval overlaps each of ``others`` (match_id, kind, start_s, end_s) that it meets."""
    def spread(df: DataFrame, start: str, end: str) -> DataFrame:
        first = F.floor(F.col(start) / bucket).cast("long")
        return df.withColumn("first", first).withColumn("bucket", F.explode(F.sequence("first", F.greatest("first", F.floor(F.col(end) / bucket).cast("long")))))

    a = spread(intervals.select("match_id", "n", "start_s", "end_s"), "start_s", "end_s")
    b = spread(others.select("match_id", "kind", F.col("start_s").alias("from_s"), F.col("end_s").alias("to_s")), "from_s", "to_s").withColumnRenamed("first", "other_first")
    met = a.join(b, ["match_id", "bucket"]).where(F.col("bucket") == F.greatest("first", "other_first"))  # once a pair
    return met.select("match_id", "n", "kind", exprs.interval_overlap(F.col("start_s"), F.col("end_s"), F.col("from_s"), F.col("to_s")).alias("seconds"))


def candidate_bookmarks(
    intervals: DataFrame, signals: DataFrame, evidence: DataFrame, states: DataFrame, targets: Sequence[str] = (), bucket: float = 30.0,
) -> DataFrame:
    """One bookmark for each interval, typed by what lies in it: a goal, else a card, else a set piece, else by its signals.

    ``intervals``: (match_id, n, start_s, end_s), numbered in order of n; ``signals``: (match_id, kind fast or loud, start_s, end_s);
    ``evidence``: (match_id, source goal, card or piece, row, t, kind, side, confidence, reason), of which the smallest
    row of a source within the closed interval counts (a first set piece of another kind hides later ones);
    ``states``: (match_id, row, start_s, end_s, state), half open. Null times are in no interval.
    """
    within = intervals.select("match_id", "n", F.col("start_s").alias("from_s"), F.col("end_s").alias("to_s"))
    held = ts.range_join(evidence, within, ["match_id"], "t", "from_s", "to_s", bucket, closed=True)
    row = F.struct("row", "t", "kind", "side", "confidence", "reason")
    first = lambda source: F.min(F.when(F.col("source") == source, F.col("found"))).alias(source)
    length = lambda kind: F.coalesce(F.sum(F.when(F.col("signal") == kind, F.col("seconds"))), F.lit(0.0)).alias(f"{kind}_s")
    parts = intervals.select("match_id", "n", "start_s", "end_s").unionByName(held.select("match_id", "n", "source", row.alias("found")), True)
    parts = parts.unionByName(overlaps(intervals, signals, bucket).withColumnRenamed("kind", "signal"), True)
    rows = parts.groupBy("match_id", "n").agg(F.max("start_s").alias("start_s"), F.max("end_s").alias("end_s"), length("fast"), length("loud"), *map(first, ("goal", "card", "piece")))

    fast, loud = F.col("fast_s") > 0, F.col("loud_s") > 0
    guess = F.when(fast & loud, guessed_type(targets, True, True)).when(fast, guessed_type(targets, True, False)).when(loud, guessed_type(targets, False, True)).otherwise(guessed_type(targets, False, False))
    rows = rows.withColumn("guess", guess)
    asked = F.when(F.col("guess").isin(*targets), ASKED).otherwise(0.0) if targets else F.lit(0.0)
    base = F.least(F.lit(MOST), F.round(BASE + F.when(fast, FAST).otherwise(0.0) + F.when(loud, LOUD).otherwise(0.0) + asked, 3))
    rows = rows.withColumn("base", base)
    raised = lambda by: F.least(F.lit(MOST), F.greatest("base", F.coalesce(by, F.lit(0.0))))
    goal, card, piece = F.col("goal"), F.col("card"), F.col("piece")
    pick = lambda kind, row, sure, by, side: F.struct(kind.alias("type"), row["t"].alias("t"), sure.alias("confidence"), F.lit(by).alias("by"), side.alias("side"), row["reason"].alias("reason"))
    chosen = F.when(goal.isNotNull(), pick(F.lit("goal"), goal, raised(goal["confidence"]), "ball_tracking", goal["side"]))
    chosen = chosen.when(card.isNotNull(), pick(F.coalesce(card["kind"], F.lit("yellow_card")), card, raised(card["confidence"]), "vision", F.lit(None).cast("string")))
    chosen = chosen.when(piece["kind"].isin(*SET_PIECES), pick(piece["kind"], piece, raised(F.lit(SET_PIECE)), "ball_tracking", piece["side"]))
    rows = rows.withColumn("chosen", chosen)
    found = F.col("chosen").isNotNull()
    louder = F.when(goal.isNotNull() & loud, LOUD_GOAL).otherwise(0.0)
    sources = F.array_compact(F.array(F.when(fast, "motion"), F.when(loud, "audio"), F.when(~fast & ~loud & ~found, "motion"), F.col("chosen.by")))
    order = Window.partitionBy("match_id").orderBy("n")
    marks = rows.select(
        "match_id", "n", F.row_number().over(order).alias("index"), F.coalesce("chosen.type", "guess").alias("event_type"),
        F.when(found, F.concat("chosen.type", F.lit("_detected"))).otherwise(F.concat("guess", F.lit("_candidate"))).alias("label"),
        F.when(found, F.least(F.lit(MOST), F.col("chosen.confidence") + louder)).otherwise(F.col("base")).alias("confidence"),
        "start_s", F.coalesce("chosen.t", (F.col("start_s") + F.col("end_s")) / 2).alias("occurred_at_s"), "end_s",
        F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s")).alias("duration_s"), sources.alias("sources"),
        F.col("chosen.side").alias("side"), F.col("chosen.reason").alias("reason"), F.round("fast_s", 3).alias("fast_s"), F.round("loud_s", 3).alias("loud_s"),
    )
    spans = states.select("match_id", "row", F.col("start_s").alias("state_from"), F.col("end_s").alias("state_to"), "state")
    at = ts.range_join(marks.select("match_id", "n", "occurred_at_s"), spans, ["match_id"], "occurred_at_s", "state_from", "state_to", bucket)
    at = at.groupBy("match_id", "n").agg(F.min_by("state", "row").alias("game_state"))
    rounded = {c: F.round(c, 3) for c in ("start_s", "occurred_at_s", "end_s", "duration_s")}
    return marks.join(at, ["match_id", "n"], "left").withColumns({**rounded, "bookmark_id": mark_id(F.col("index"))}).drop("n")


def mark_id(index: Column) -> Column:
    return F.format_string("bm_%04d", index)


def event_bookmarks(events: DataFrame, selected: DataFrame | None = None, clips: DataFrame | None = None, trim_s: float = 0.0, before: float = 4.0, after: float = 6.0) -> DataFrame:
    """One bookmark for each event, numbered by time, in the time of the untrimmed file.

    ``events``: (match_id, event_id, type, t, t_start, t_end, confidence, excitement, side, reason, team, track_id, sources,
    game_state). With ``selected`` (match_id, event_id) only those, and an event takes the window of its clip in ``clips``
    (match_id, clip_index, t_start, t_end, event_ids; the last clip of several); else all but turnovers and sprints.
    """
    if selected is None:
        rows = events.where(~F.col("type").isin("turnover", "sprint"))
    else:
        rows = events.join(selected.select("match_id", "event_id").distinct(), ["match_id", "event_id"], "left_semi")
    if selected is not None and clips is not None:
        of = clips.select("match_id", F.explode(F.array_distinct("event_ids")).alias("event_id"), F.struct("clip_index", "t_start", "t_end").alias("clip"))
        rows = rows.join(of.groupBy("match_id", "event_id").agg(F.max("clip").alias("clip")), ["match_id", "event_id"], "left")
    else:
        rows = rows.withColumn("clip", F.lit(None).cast("struct<clip_index:int,t_start:double,t_end:double>"))
    start, end = F.coalesce("clip.t_start", "t_start", F.col("t") - before), F.coalesce("clip.t_end", "t_end", F.col("t") + after)
    kind = F.when(F.col("type") == "goal", "goal").when(F.col("type").isin(*CARDS), "card").when(F.col("type").isin(*SET_PIECES), "set_piece")
    named = F.map_filter(F.create_map(
        F.lit("side"), F.col("side"), F.lit("reason"), F.col("reason"), F.coalesce(F.concat(kind, F.lit("_side")), F.lit("no_side")), F.when(kind != "card", F.col("side")),
        F.coalesce(F.concat(kind, F.lit("_reason")), F.lit("no_reason")), F.when(kind.isNotNull(), F.col("reason"))), lambda _, v: v.isNotNull())
    index = F.row_number().over(Window.partitionBy("match_id").orderBy("t", "event_id"))
    shifted = lambda c: F.round(c + trim_s, 3)
    return rows.select(
        "match_id", mark_id(index).alias("bookmark_id"), index.alias("index"), "event_id", F.col("type").alias("event_type"), F.concat("type", F.lit("_detected")).alias("label"),
        F.round("confidence", 3).alias("confidence"), shifted(start).alias("start_s"), shifted(F.col("t")).alias("occurred_at_s"), shifted(end).alias("end_s"),
        F.round(F.greatest(F.lit(0.0), end - start), 3).alias("duration_s"), F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array(F.lit("ball_tracking"))).alias("sources"),
        "game_state", named.alias("signals"), "team", "track_id", F.round("excitement", 3).alias("excitement"), F.col("clip.clip_index").alias("clip_index"),
    )


def window_ms(start_s: Column, occurred_s: Column, end_s: Column) -> Column:
    """(start_ms, occurred_ms, end_ms): not negative, in this order."""
    ms = lambda c: F.rint(c * 1000).cast("long")
    start = F.greatest(F.lit(0).cast("long"), ms(start_s))
    end = F.greatest(start, ms(end_s))
    return F.struct(start.alias("start_ms"), F.least(F.greatest(start, ms(occurred_s)), end).alias("occurred_ms"), end.alias("end_ms"))


def stored_events(events: DataFrame, marks: DataFrame, tracks: DataFrame, trim_s: float = 0.0, before: float = 4.0, after: float = 6.0) -> DataFrame:
    """The rows that a finished run stores: one an analysed event, or one a bookmark for matches without any.

    ``events``: (match_id, event_id, type, t, t_start, t_end, confidence, team, track_id, second_track_id, ball_x, ball_y);
    ``marks``: (match_id, bookmark_id, event_id, event_type, start_s, occurred_at_s, end_s, confidence, team), one an event at most;
    ``tracks``: (match_id, track_id, jersey_number, frame_width, frame_height). An event with a bookmark takes its window. Write
    with ``sinks.replace_partitions`` by match: delete-then-insert.
    """
    mark = marks.select("match_id", F.col("event_id"), F.struct("bookmark_id", "start_s", "end_s").alias("mark")).where(F.col("event_id").isNotNull())
    shirt = lambda by, name: tracks.select("match_id", F.col("track_id").alias(by), F.struct(F.nullif(F.col("jersey_number").cast("string"), F.lit("")).alias("number")).alias(name))
    frame = tracks.groupBy("match_id").agg(F.max("frame_width").alias("width"), F.max("frame_height").alias("height"))
    rows = events.join(mark, ["match_id", "event_id"], "left").join(shirt("track_id", "first"), ["match_id", "track_id"], "left")
    rows = rows.join(shirt("second_track_id", "second"), ["match_id", "second_track_id"], "left").join(frame, "match_id", "left")
    side = exprs.team_side(F.col("team"))
    person = lambda by, who, role, team: F.when(F.col(by).isNotNull(), F.struct(team.alias("team_id"), F.col(f"{who}.number").alias("jersey_number"), F.lit(role).alias("role"), F.col(by).cast("long").alias("track_id")))
    framed = (F.col("width") > 0) & (F.col("height") > 0) & F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull()
    place = F.when(framed, F.struct(F.round(F.col("ball_x") / F.col("width"), 4).alias("x_norm"), F.round(F.col("ball_y") / F.col("height"), 4).alias("y_norm")))
    window = window_ms(F.coalesce("mark.start_s", F.coalesce("t_start", F.col("t") - before) + trim_s), F.col("t") + trim_s, F.coalesce("mark.end_s", F.coalesce("t_end", F.col("t") + after) + trim_s))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0))))
    analysed = rows.select(
        "match_id", "event_id", exprs.normalize_event_type(F.col("type")).alias("event_type"), sure.alias("confidence"), window.alias("w"), side.alias("team_id"), F.col("first.number").alias("jersey_number"),
        F.array_compact(F.array(person("track_id", "first", "primary", side), person("second_track_id", "second", "secondary", F.lit(None).cast("string")))).alias("participants"),
        place.alias("location"), F.col("mark.bookmark_id").alias("bookmark_id"), F.col("mark").isNotNull().alias("selected"),
    )
    since = F.coalesce("start_s", F.lit(0.0))
    until = F.coalesce("end_s", since)
    plain = marks.join(events.select("match_id").distinct(), "match_id", "left_anti").select(
        "match_id", "event_id", exprs.normalize_event_type(F.col("event_type")).alias("event_type"), sure.alias("confidence"), window_ms(since, F.coalesce("occurred_at_s", (since + until) / 2), until).alias("w"),
        side.alias("team_id"), "bookmark_id", F.lit(True).alias("selected"))
    every = analysed.unionByName(plain, True).withColumn("participants", F.coalesce("participants", F.array().cast(analysed.schema["participants"].dataType)))
    return every.select("*", "w.*").drop("w").withColumn("status", F.lit("auto_detected"))


def event_summary(events: DataFrame) -> DataFrame:
    """(match_id, team 0 or 1, eleven counts) from (match_id, type, team, on_target, attempt); both teams of every match, 0 where there is nothing.

    A chance that was an attempt counts as a shot too.
    """
    kind = F.col("type")
    counts = {
        "goals": kind == "goal", "shots": (kind == "shot") | ((kind == "chance") & F.col("attempt")), "shots_on_target": (kind == "shot") & F.col("on_target"), "saves": kind == "save", "chances": kind == "chance",
        "corners": kind == "corner_kick", "free_kicks": kind == "free_kick", "cards": kind.isin(*CARDS), "sprints": kind == "sprint", "dribbles": kind == "dribble", "turnovers_won": kind == "turnover",
    }
    # a row for each team beside the events: one aggregation, both teams there
    both = events.select("match_id").distinct().select("match_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("team"))
    rows = events.where(F.col("team").isin(0, 1)).select("match_id", F.col("team").cast("int").alias("team"), "type", "on_target", "attempt").unionByName(both, True)
    return rows.groupBy("match_id", "team").agg(*[F.count_if(test).alias(name) for name, test in counts.items()])


def frames_seeing(samples: DataFrame, times: DataFrame, keys: Sequence[str], t: str, tol: float) -> DataFrame:
    """(keys, n_seen): how many of each track's ``times`` (keys, at) have a sample within ``tol``; 0 for tracks without any."""
    near = samples.select(*keys, F.col(t).alias("seen_at"), (F.col(t) - 2 * tol).alias("from_t"), (F.col(t) + 2 * tol).alias("to_t"))
    asked = times.select(*keys, "at").distinct()
    hit = ts.range_join(asked, near, keys, "at", "from_t", "to_t", 8 * tol, closed=True).where(F.abs(F.col("at") - F.col("seen_at")) <= tol).select(*keys, "at").distinct()
    seen = times.join(hit.withColumn("hit", F.lit(1)), [*keys, "at"], "left")
    return seen.groupBy(*keys).agg(F.count("hit").alias("n_seen"))


def every_kth(samples: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first, (k+1)th, (2k+1)th ... sample of each track: positions at a lower rate."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return samples.withColumn("_n", n).where((F.col("_n") - 1) % max(1, k) == 0).drop("_n")


def shown_tracks(samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """The samples of one track a match: the asked one, else the one in focus, else that seen for the longest time (ties: the lower id).

    ``wanted``: (match_id, asked_id, focus_id), either may be null or name a track that isn't there.
    """
    sizes = samples.groupBy("match_id", "track_id").agg((F.max("t") - F.min("t")).alias("size")).join(wanted.select("match_id", F.coalesce("asked_id", "focus_id").alias("first_id")), "match_id", "left")
    rank = F.struct(F.coalesce(F.col("track_id") == F.col("first_id"), F.lit(False)).alias("first"), F.col("size"), (-F.col("track_id")).alias("low"))
    one = sizes.groupBy("match_id").agg(F.max_by("track_id", rank).alias("track_id"))
    return samples.join(one, ["match_id", "track_id"], "left_semi")


def match_answers(events: DataFrame, question: str = "", most: int = 3) -> DataFrame:
    """(match_id, answer): what is known of a match as a text, without a language model.

    ``events``: (match_id, event_id, type, confidence, occurred_ms). Commonest types (ties by name) and the moments of highest
    confidence (ties: the later, then the lower id).
    """
    counts = events.groupBy("match_id", "type").agg(F.count(F.lit(1)).alias("n"))
    common = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("back"), "type"))), 1, most)
    kinds = counts.groupBy("match_id").agg(F.sum("n").alias("n"), F.array_join(F.transform(common, lambda c: F.concat(c["type"], F.lit(": "), (-c["back"]).cast("string"))), ", ").alias("kinds"))
    w = Window.partitionBy("match_id").orderBy(F.desc("confidence"), F.desc("occurred_ms"), "event_id")
    text = F.concat("type", F.lit(" at "), exprs.format_clock(F.col("occurred_ms") / 1000), F.lit(" ("), F.format_string("%.2f", F.col("confidence").cast("double")), F.lit(")"))
    top = events.select("match_id", F.row_number().over(w).alias("place"), text.alias("text")).where(F.col("place") <= most)
    top = top.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("top"))
    parts = ["Match ", F.col("match_id").cast("string"), " has ", F.col("n").cast("string"), " detected events. Most common: ", F.col("kinds"), ". Surest moments: ", F.array_join(F.col("top.text"), ", "), "."]
    asked = [f" Asked: '{question}'."] if question else []
    return kinds.join(top, "match_id").select("match_id", F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in (*parts, *asked)]).alias("answer"))
