"""Clip windows from the story around an event: where the attack began, when the noise settled, refined and merged intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.operators import timeseries as ts

MATCH = ["match_id"]


def audio_peaks(envelope: DataFrame, k: float = 3.0, apart: float = 1.5) -> DataFrame:
    """(match_id, peak_t, strength): loud local maxima of (match_id, t, rms), the louder first and ``apart`` seconds from each other.

    A peak goes when a louder one lies within ``apart``; strength is its height above the threshold, scaled to the 99.5th percentile.
    """
    peaks = ts.local_maxima(envelope, MATCH, "t", "rms", k)
    other = peaks.select("match_id", F.col("t").alias("ot"), F.col("rms").alias("orms"))
    cell = lambda t: F.floor(F.col(t) / apart).cast("long")
    near = peaks.withColumn("cell", F.explode(F.array(cell("t") - 1, cell("t"), cell("t") + 1))).join(other.withColumn("cell", cell("ot")), ["match_id", "cell"])
    beaten = near.where((F.col("ot") != F.col("t")) & (F.abs(F.col("ot") - F.col("t")) < apart) & ((F.col("orms") > F.col("rms")) | ((F.col("orms") == F.col("rms")) & (F.col("ot") < F.col("t"))))).select("match_id", "t").distinct()
    top = envelope.groupBy("match_id").agg(F.percentile("rms", F.lit(0.995)).alias("top"))
    kept = peaks.join(beaten, ["match_id", "t"], "left_anti").join(top, "match_id")
    strength = (F.col("rms") - F.col("threshold")) / F.greatest(F.col("top") - F.col("threshold"), F.lit(1e-9))
    return kept.select("match_id", F.col("t").alias("peak_t"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), strength)).alias("strength"))


def story_start(events: DataFrame, ball: DataFrame, segments: DataFrame, longest: float = 15.0, lead: float = 1.0) -> DataFrame:
    """(match_id, event_id, start_s): the last time before an event at which the ball turned towards the goal or play began again.

    events: (match_id, event_id, t, sign); ball: (match_id, grid_t, vx); without either the clip begins ``longest`` before.
    """
    w = Window.partitionBy("match_id").orderBy("grid_t")
    turns = ball.withColumn("was", F.lag(F.signum("vx")).over(w)).where((F.signum("vx") != F.col("was")) & (F.col("vx") != 0)).select("match_id", F.col("grid_t").alias("at"), F.signum("vx").alias("way"))
    begins = segments.where("state = 'in_play'").select("match_id", F.col("start_s").alias("at"), F.lit(0.0).alias("way"))
    spans = events.select("match_id", "event_id", "t", "sign", (F.col("t") - longest).alias("lo"), F.col("t").alias("hi"))
    found = ts.range_join(turns.unionByName(begins), spans, MATCH, "at", "lo", "hi", longest).where((F.col("way") == 0) | (F.col("way") == F.col("sign")))
    last = found.groupBy("match_id", "event_id").agg(F.max("at").alias("at"))
    return events.join(last, ["match_id", "event_id"], "left").select("match_id", "event_id", F.greatest(F.lit(0.0), F.coalesce(F.col("at") - lead, F.col("t") - longest)).alias("start_s"))


def emotion_end(events: DataFrame, envelope: DataFrame, longest: float = 8.0, share: float = 0.25, hold: float = 1.0) -> DataFrame:
    """(match_id, event_id, end_s): when the sound has stayed below baseline plus a share of the peak for ``hold`` seconds, else ``longest`` after."""
    base = envelope.groupBy("match_id").agg(F.median("rms").alias("base"))
    spans = events.select("match_id", "event_id", F.col("t").alias("lo"), (F.col("t") + longest).alias("hi"))
    after = ts.range_join(envelope.select("match_id", F.col("t").alias("at"), "rms"), spans, MATCH, "at", "lo", "hi", longest, closed=True).join(base, "match_id")
    top = Window.partitionBy("match_id", "event_id")
    quiet = F.col("rms") <= F.col("base") + share * (F.max("rms").over(top) - F.col("base"))
    rows = ts.islands_by_value(after.withColumn("quiet", quiet), ["match_id", "event_id"], ["at"], F.col("quiet")).where("quiet")
    runs = rows.groupBy("match_id", "event_id", "island").agg(F.min("at").alias("a"), F.max("at").alias("b")).where(F.col("b") - F.col("a") >= hold)
    first = runs.groupBy("match_id", "event_id").agg(F.min("a").alias("a"))
    return events.join(first, ["match_id", "event_id"], "left").select("match_id", "event_id", F.coalesce(F.col("a") + hold, F.col("t") + longest).alias("end_s"))


def refined(intervals: DataFrame, events: DataFrame, gap: float = 0.75) -> DataFrame:
    """Intervals (match_id, start_s, end_s) widened to the window of the first event inside, then merged."""
    inside = ts.range_join(events.select("match_id", "t", "t_start", "t_end"), intervals, MATCH, "t", "start_s", "end_s", 30.0, closed=True)
    first = inside.groupBy("match_id", "start_s", "end_s").agg(F.min(F.struct("t", "t_start", "t_end")).alias("e"))
    wide = intervals.join(first, ["match_id", "start_s", "end_s"], "left").select("match_id", F.least("start_s", "e.t_start").alias("start_s"), F.greatest("end_s", "e.t_end").alias("end_s"))
    return ts.merge_intervals(wide, MATCH, "start_s", "end_s", gap)


def stopped_windows(segments: DataFrame, pad: float = 2.0, shortest: float = 1.0) -> DataFrame:
    """Padded, merged windows in which play is stopped, where cards are looked for."""
    stops = segments.where("state <> 'in_play'").select("match_id", F.greatest(F.lit(0.0), F.col("start_s") - pad).alias("start_s"), (F.col("end_s") + pad).alias("end_s"))
    return ts.merge_intervals(stops, MATCH, "start_s", "end_s").where(F.col("end_s") - F.col("start_s") >= shortest)


def merge_cards(cards: DataFrame, window: float = 20.0, least: float = 0.5) -> DataFrame:
    """``cards`` (match_id, t, kind, confidence and others), where one within ``window`` seconds of the card kept last, of its kind, is the same card.

    The more confident one is kept, and what follows is compared with it and not with the row before: a card that replaces
    another moves the window on, one that goes does not. A match's few cards are folded in order. Those below ``least`` go.
    """
    row = F.struct(F.col("t").alias("_t"), F.col("kind").alias("_kind"), F.col("confidence").alias("_confidence"), F.struct(*cards.columns).alias("_row"))
    kind = cards.select(F.array(row).alias("a")).schema["a"].dataType

    def take(kept: Column, r: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        same = F.coalesce((last["_kind"] == r["_kind"]) & (r["_t"] - last["_t"] <= window), F.lit(False))
        swapped = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(r))
        return F.when(~same, F.array_append(kept, r)).when(r["_confidence"] > last["_confidence"], swapped).otherwise(kept)

    folded = cards.groupBy("match_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    kept = folded.select(F.explode(F.aggregate("_rows", F.array().cast(kind), take)).alias("_kept")).select("_kept._row.*")
    return kept.where(F.col("confidence") >= least)


def foul_candidates(peaks: DataFrame, events: DataFrame, ball: DataFrame, segments: DataFrame, kin: DataFrame, within: float = 4.0, radius: float = 10.0, more: int = 2, hz: float = 10.0) -> DataFrame:
    """(match_id, t, before, after, confidence): the crowd is loud, play stops, and players come together where the ball was.

    ``peaks`` (match_id, peak_t, strength) beside a goal, shot, save or card of ``events`` (match_id, type, t) don't count.
    Play stops when from one to ``within`` seconds later half of the ball's grid isn't in play, or the ball is slower than a
    metre a second for a second and a half. ``more`` players than a second before are within ``radius`` two seconds later. A
    free kick or penalty within half a minute adds to the confidence. Joins by time or by grid step, keyed by match.
    """
    step = lambda t: F.rint(t * hz).cast("long")
    spans = peaks.select("match_id", "peak_t", "strength", (F.col("peak_t") - 4.0).alias("lo"), (F.col("peak_t") + 4.0).alias("hi"))
    known = events.where(F.col("type").isin("goal", "shot", "save", "yellow_card", "red_card")).select("match_id", "t")
    told = ts.range_join(known, spans, MATCH, "t", "lo", "hi", 8.0, closed=True).select("match_id", "peak_t").distinct()
    free = peaks.join(told, ["match_id", "peak_t"], "left_anti")

    # the ball's grid between one second and ``within`` after each peak
    after = free.select("match_id", "peak_t", F.explode(F.sequence(step(F.col("peak_t") + 1.0), step(F.col("peak_t") + within))).alias("g"))
    stopped = ts.asof_backward(after.withColumn("t", F.col("g") / hz), segments.select("match_id", "start_s", "state"), MATCH, "t", "start_s", "seg", fall_back_to_first=True)
    rows = stopped.join(ball.select("match_id", "g", "speed"), ["match_id", "g"], "left")
    out = F.avg((F.coalesce(F.col("seg.state"), F.lit("in_play")) != "in_play").cast("int"))
    calm = rows.groupBy("match_id", "peak_t").agg(out.alias("out"), (F.count_if(F.col("speed") < 1.0) / hz).alias("slow")).where("out >= 0.5 OR slow >= 1.5")

    place = ball.where("x IS NOT NULL").select("match_id", "g", F.col("x").alias("bx"), F.col("y").alias("by"))
    at = free.join(calm, ["match_id", "peak_t"]).withColumn("g", step(F.col("peak_t"))).join(place, ["match_id", "g"]).drop("g")
    asked = at.withColumn("w", F.explode(F.array(F.struct(F.lit("before").alias("when"), step(F.col("peak_t") - 1.0).alias("g")), F.struct(F.lit("after").alias("when"), step(F.col("peak_t") + 2.0).alias("g")))))
    asked = asked.select("match_id", "peak_t", "strength", "bx", "by", "w.*")
    near = asked.join(kin.select("match_id", "g", "x", "y"), ["match_id", "g"], "left").groupBy("match_id", "peak_t", "strength").agg(
        *[F.count_if((F.col("when") == k) & (F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) <= radius)).alias(k) for k in ("before", "after")])
    found = near.where(F.col("after") >= F.col("before") + more).withColumn("until", F.col("peak_t") + 30.0)
    kicks = events.where(F.col("type").isin("free_kick", "penalty_kick")).select("match_id", F.col("t").alias("kick_t"))
    followed = ts.range_join(kicks, found.select("match_id", "peak_t", "until"), MATCH, "kick_t", "peak_t", "until", 30.0, closed=True).select("match_id", "peak_t").distinct().withColumn("followed", F.lit(0.1))
    confidence = F.least(F.lit(0.55), 0.3 + 0.1 * F.col("strength") + F.coalesce("followed", F.lit(0.0)))
    return found.join(followed, ["match_id", "peak_t"], "left").select("match_id", F.col("peak_t").alias("t"), "before", "after", confidence.alias("confidence"))
