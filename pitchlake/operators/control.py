"""Queries of the catalog's tables: filters, pages, counts, routing, library and upserts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import exprs


def filtered(df: DataFrame, equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None, assigned: tuple[str, bool] | None = None, one_of: dict | None = None) -> DataFrame:
    """Rows that meet every predicate whose value isn't None; all of them can be pushed into the scan."""
    for column, value in (equal or {}).items():
        df = df if value is None else df.where(F.col(column) == value)
    for column, values in (one_of or {}).items():
        df = df if values is None else df.where(F.col(column).isin(*values))
    for column, value in (at_least or {}).items():
        df = df if value is None else df.where(F.col(column) >= value)
    for column, value in (at_most or {}).items():
        df = df if value is None else df.where(F.col(column) <= value)
    if assigned is not None:
        df = df.where(F.col(assigned[0]).isNotNull() if assigned[1] else F.col(assigned[0]).isNull())
    return df


def page(df: DataFrame, newest: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """One page, newest first, with an id as tie-breaker; a row more than ``limit`` tells that there is a next page."""
    return df.orderBy(F.desc(newest), tie).offset(offset).limit(limit + 1)


def page_with_cursor(df: DataFrame, newest: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """The page's rows with ``has_more``; numbering happens on at most limit + 1 rows."""
    rows = page(df, newest, tie, limit, offset)
    w = Window.orderBy(F.desc(newest), tie)
    return rows.withColumn("_n", F.row_number().over(w)).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > limit).where(F.col("_n") <= limit).drop("_n")


def for_tenant(df: DataFrame, tenant_id) -> DataFrame:
    return df.where(F.col("tenant_id").eqNullSafe(F.lit(tenant_id)))


def share_usable(revoked: Column, expires_at: Column, now: Column) -> Column:
    return ~revoked & (expires_at.isNull() | (expires_at >= now))


def latest_per(df: DataFrame, key: str, newest: str, tie: str) -> DataFrame:
    """The newest row of each key. ``max_by`` on a total order aggregates before the shuffle, where row_number() would sort all rows."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(newest, tie)).alias("_row")).select(key, "_row.*")


def library(matches: DataFrame, jobs: DataFrame, newest: str = "created_at") -> DataFrame:
    """Each match with its number of jobs and its latest one; matches without jobs stay."""
    counts = jobs.groupBy("match_id").agg(F.count(F.lit(1)).alias("job_count"), F.max_by(F.struct("job_id", "status", newest), F.struct(newest, "job_id")).alias("latest"))
    return matches.join(counts, "match_id", "left").withColumn("job_count", F.coalesce("job_count", F.lit(0)))


def jobs_with_matches(jobs: DataFrame, matches: DataFrame, statuses: Sequence[str] | None, limit: int, newest: str = "created_at") -> DataFrame:
    """Newest jobs joined to their matches, and how many of the page are active."""
    rows = filtered(jobs.join(matches, "match_id"), one_of={"status": statuses}).orderBy(F.desc(newest), "job_id").limit(limit)
    return rows.withColumn("active_count", F.sum(F.col("status").isin("queued", "running").cast("int")).over(Window.partitionBy(F.lit(0))))


def unlinked(runs: DataFrame, jobs: DataFrame, on: str) -> DataFrame:
    return runs.join(jobs, on, "left_anti")


def table_counts(tables: dict[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """(by, table, n) for each table."""
    out = None
    for name, df in tables.items():
        n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.lit(name).alias("table"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def bucket_counts(events: DataFrame, keys: Sequence[str], kind: str, bucket: str) -> DataFrame:
    """Home, away, unattributed and total per type; see ``counted_ids`` for the events behind a count."""
    side = lambda b: F.count_if(F.col(bucket) == b).alias(b)
    return events.groupBy(*keys, kind).agg(side("home"), side("away"), side("unattributed"), F.count(F.lit(1)).alias("total"))


def counted_ids(events: DataFrame, keys: Sequence[str], kind: str, id_col: str) -> DataFrame:
    """(keys, kind, event_ids): the ids that ``bucket_counts`` counted, sorted; one row a key and type, so keys should be matches."""
    return events.groupBy(*keys, kind).agg(F.sort_array(F.collect_list(id_col)).alias("event_ids"))


def attempt_counts(events: DataFrame, keys: Sequence[str], at_ms: str, bucket: str, tie: str, window_ms: int = 4000) -> DataFrame:
    """Distinct attempts: a row starts a new one unless the row before is of the same side and at most ``window_ms`` earlier (chained)."""
    w = Window.partitionBy(*keys).orderBy(at_ms, tie)
    same = (F.lag(bucket).over(w) == F.col(bucket)) & (F.col(at_ms) - F.lag(at_ms).over(w) <= window_ms)
    rows = events.withColumn("_new", ~F.coalesce(same, F.lit(False)))
    side = lambda b: F.count_if(F.col("_new") & (F.col(bucket) == b)).alias(b)
    return rows.groupBy(*keys).agg(side("home"), side("away"), side("unattributed"), F.count_if(F.col("_new")).alias("total"), F.count(F.lit(1)).alias("n_events"))


def route_events(events: DataFrame, roster: DataFrame, keys: Sequence[str] = ("match_id",)) -> DataFrame:
    """Events with the roster entry of their shirt: by side and number, else by the number alone if only one entry has it.

    The second step also applies to events whose side is set but unmatched. Of duplicate entries the last wins.
    """
    entries = roster.withColumn("_jersey", exprs.normalize_jersey(F.col("jersey_number")))
    exact = entries.groupBy(*keys, F.col("team_side").alias("_side"), "_jersey").agg(F.max_by(F.struct("entry_id", "team_side"), F.col("entry_order")).alias("_exact"))
    lone = entries.groupBy(*keys, "_jersey").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("entry_id", "team_side")).alias("_lone")).where("_n = 1").drop("_n")
    rows = events.withColumn("_jersey", exprs.normalize_jersey(F.col("jersey_number"))).withColumn("_side", F.coalesce("team_id", F.lit("")))
    rows = rows.join(exact, [*keys, "_side", "_jersey"], "left").join(lone, [*keys, "_jersey"], "left")
    entry = F.coalesce("_exact", "_lone")
    status = F.when(F.col("_jersey") == "", "no_number").when(F.col("player_id").isNotNull(), "already_routed").when(entry.isNotNull(), "routed").otherwise("unmatched")
    rows = rows.withColumn("routing", status)
    new = F.when(F.col("routing") == "routed", entry["entry_id"]).otherwise(F.col("player_id"))
    side = F.when(F.col("routing") == "routed", entry["team_side"]).otherwise(F.col("team_id"))
    return rows.withColumn("player_id", new).withColumn("team_id", side).drop("_jersey", "_side", "_exact", "_lone")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], replace: bool = True) -> DataFrame:
    """MERGE of two tables: changed rows replace old ones, or are skipped where a key exists."""
    if replace:
        return base.join(changes, list(keys), "left_anti").unionByName(changes)
    return base.unionByName(changes.join(base, list(keys), "left_anti"))


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Partial update: the patch's non-null columns win."""
    columns = [c for c in patch.columns if c != key]
    renamed = patch.select(key, *[F.col(c).alias(f"_patch_{c}") for c in columns])
    return base.join(renamed, key, "left").select(*[F.coalesce(f"_patch_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def valid_window(start: Column, occurred: Column, end: Column) -> Column:
    return (start <= occurred) & (occurred <= end)


def stage_seconds(logs: DataFrame, keys: Sequence[str], stage: str, at: str, tie: str) -> DataFrame:
    """Seconds of each stage: the time from each log row to the next, negative ones left out."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    spent = (F.lead(at).over(w) - F.col(at))
    return logs.withColumn("_spent", spent).where("_spent >= 0").groupBy(*keys, stage).agg(F.sum("_spent").alias("spent"))


def searched(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def remaining_history(history: DataFrame, jobs: DataFrame, key: str, order: str, keep: int = 200) -> DataFrame:
    """The last ``keep`` history rows of each match whose job still exists."""
    alive = history.join(jobs.select("job_id"), "job_id", "left_semi")
    return alive.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= keep).drop("_n")


def page_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first page of every key: ``place`` from 1, and whether more rows follow.

    Spark cuts each task's rows to the page before the shuffle where only the place is asked for.
    """
    w = Window.partitionBy(*keys)
    return df.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("has_more", F.count(F.lit(1)).over(w) > limit).where(F.col("place") <= limit)


def members_with_users(members: DataFrame, users: DataFrame, status: str | None = None) -> DataFrame:
    """Memberships joined to their accounts; members without one are left out; ``updated`` is the later change."""
    return filtered(members, equal={"status": status}).join(users, "user_id").withColumn("updated", F.greatest("updated_at", "user_updated_at"))


def diagnostics(logs: DataFrame, at: str, tie: str, latest: int) -> DataFrame:
    """(job_id, n_logs, n_errors, last_log, last_error) of each job's ``latest`` logs (job_id, level, at, tie)."""
    rows = logs.withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc(at), F.desc(tie)))).where(F.col("_n") <= latest)
    failed = F.col("level") == "error"
    return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_logs"), F.count_if(failed).alias("n_errors"), F.max_by(tie, F.struct(at, tie)).alias("last_log"), F.max(F.when(failed, F.col(tie))).alias("last_error"))


def shown_metrics(known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, value): shots, else shot events; kilometres; kilometres an hour."""
    metric = lambda name, c: F.struct(F.lit(name).alias("metric"), c.cast("double").alias("value"))
    shown = F.array(metric("shots", F.coalesce("shots", F.col("shot_events").cast("double"))), metric("distance", F.col("distance_m") / 1000), metric("avg_speed", F.col("avg_speed_mps") * 3.6))
    return known.select(*keys, F.explode(shown).alias("m")).select(*keys, "m.*")


def shots_on_pitch(events: DataFrame, kind: str, kinds: Sequence[str], half_length: float = 52.5, half_width: float = 34.0) -> DataFrame:
    """Events of some kinds at their places in metres, drawn inside the pitch."""
    x, y = exprs.clip_to_pitch(F.col("x"), F.col("y"))
    return events.where(F.col(kind).isin(*kinds)).withColumns({"x": x, "y": y})


def sorted_players(players: DataFrame, column: str, tie: str, team: str = "team") -> DataFrame:
    """Each team's players by a column, the largest first and missing ones last, with the scale of all bars."""
    scale = players.agg(F.greatest(F.lit(1.0), F.max(F.coalesce(column, F.lit(0.0)))).alias("scale"))
    place = F.row_number().over(Window.partitionBy(team).orderBy(F.coalesce(column, F.lit(-1e9)).desc(), tie))
    return players.withColumn("place", place).join(scale)


def offered(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The distinct values of some columns of few values, sorted, for each key."""
    return df.groupBy(*keys).agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns])


#: Measure: (least value that is ok, least that is a warning). Fixed values.
LEVELS = {"calibration": (0.75, 0.45), "teams": (85, 60), "ball": (70, 45)}


def quality_levels(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, flag, level): ok, warn or danger; a missing calibration is a danger, other missing measures have no flag."""
    level = lambda c: F.when(F.col(c) >= LEVELS[c][0], "ok").when(F.col(c) >= LEVELS[c][1], "warn").otherwise("danger")
    flags = F.array(*[F.struct(F.lit(c).alias("flag"), F.when(F.col(c).isNotNull() | F.lit(c == "calibration"), level(c)).alias("level")) for c in LEVELS])
    return runs.select(*keys, F.explode(flags).alias("f")).select(*keys, "f.*").where("level IS NOT NULL")


def auto_picked(events: DataFrame, target_s: float) -> DataFrame:
    """(match_id, event_id, place): by excitement while the lengths fit, up to 95 % of the target; the first always.

    events: (match_id, event_id, t, excitement, length). A fold over one match's ranked events: each choice depends on
    the total so far.
    """
    ranked = events.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct((-F.coalesce("excitement", F.lit(0.0))).alias("rank"), "t", "event_id", F.col("length").cast("double").alias("length")))).alias("s"))
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast(ranked.schema["s"].dataType).alias("chosen"))

    def choose(acc: Column, e: Column) -> Column:
        full = acc["total"] >= 0.95 * target_s
        over = (acc["total"] + e["length"] > target_s) & (F.size(acc["chosen"]) > 0)
        return F.when(full | over, acc).otherwise(F.struct((acc["total"] + e["length"]).alias("total"), F.array_append(acc["chosen"], e).alias("chosen")))

    picked = ranked.select("match_id", F.aggregate("s", start, choose)["chosen"].alias("chosen"))
    in_order = F.array_sort(F.transform("chosen", lambda e: F.struct(e["t"].alias("t"), e["event_id"].alias("event_id"))))
    return picked.select("match_id", F.posexplode(in_order).alias("place", "e")).select("match_id", "e.event_id", "place")


# --- single rows and batches ------------------------------------------------------------------------------------


def new_id(prefix: str) -> Column:
    """A fresh identifier; not repeatable, so kept out of results that are compared."""
    return F.concat(F.lit(prefix + "_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))


def first_number(*texts: Column) -> Column:
    """The first of several texts that is a number, else 0: the offset of a trimmed video from its documents."""
    return F.coalesce(*[t.try_cast("double") for t in texts], F.lit(0.0))


def without_series(players: DataFrame, series: str = "speed_series") -> DataFrame:
    """Players without their long series, only whether they have one."""
    return players.withColumn(f"has_{series}", F.coalesce(F.size(series) > 0, F.lit(False))).drop(series)


def least_clip(start: Column, end: Column, shortest: Column, duration: Column) -> tuple[Column, Column]:
    """A clip lengthened to ``shortest`` seconds: to the right while the video lasts (0: unknown), the rest to the left."""
    longer = F.when(duration > 0, F.least(duration, start + shortest)).otherwise(start + shortest)
    to = F.when(end - start < shortest, longer).otherwise(end)
    since = F.when(to - start < shortest, F.greatest(F.lit(0.0), to - shortest)).otherwise(start)
    return F.round(since, 3), F.round(to, 3)


def feedback_batches(feedback: DataFrame, criteria: DataFrame) -> DataFrame:
    """``criteria`` with item_count, the feedback rows of its tenant and status within its lists and dates; null criteria don't restrict.

    ``criteria``: (batch_id, tenant_id, status, match_ids, kinds, from_at, to_at), joined by tenant and status.
    ``feedback``: (tenant_id, status, match_id, kind, at). Batches that ask for the same are counted once: pairs grow with the
    different criteria, not with the batches.
    """
    listed = lambda c, values: F.col(values).isNull() | (F.size(values) == 0) | F.array_contains(F.col(values), F.col(c))
    test = listed("match_id", "match_ids") & listed("kind", "kinds") & (F.col("from_at").isNull() | (F.col("at") >= F.col("from_at"))) & (F.col("to_at").isNull() | (F.col("at") <= F.col("to_at")))
    same = ["tenant_id", "status", "match_ids", "kinds", "from_at", "to_at"]
    keyed = criteria.withColumn("_asked", F.struct(*same))
    different = keyed.select("_asked").distinct().select("_asked", "_asked.*")
    found = feedback.join(different, ["tenant_id", "status"]).where(test).groupBy("_asked").agg(F.count(F.lit(1)).alias("item_count"))
    return keyed.join(found, "_asked", "left").drop("_asked").fillna(0, ["item_count"])


def roster_templates(roster: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """One row for each match's roster: its players in order as an array, to be used again."""
    return roster.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), *columns))), lambda p: F.struct(*[p[c].alias(c) for c in columns])).alias("players"))


def job_progress(jobs: DataFrame, logs: DataFrame, now: Column, active: Sequence[str]) -> DataFrame:
    """``jobs`` (job_id, status, stage, progress, started, finished) with the latest log's stage and progress, elapsed_s and eta_s.

    An active job's progress is the greater of its own and the latest log's (job_id, at, stage, progress). What is left
    takes as long as the same share took so far; there is no estimate below 2 % or at the end.
    """
    last = logs.groupBy("job_id").agg(F.max_by(F.struct("stage", "progress"), F.struct("at", "stage")).alias("log"))
    busy = F.col("status").isin(*active)
    rows = jobs.join(last, "job_id", "left")
    progress = F.when(busy, F.greatest(F.coalesce("progress", F.lit(0.0)), F.coalesce("log.progress", F.lit(0.0)))).otherwise(F.coalesce("progress", F.lit(0.0)))
    seconds = (F.unix_micros(F.coalesce("finished", now)) - F.unix_micros("started")) / 1e6
    rows = rows.withColumn("shown", progress).withColumn("elapsed_s", seconds)
    eta = F.when(busy & (F.col("shown") > 0.02) & (F.col("shown") < 1), F.col("elapsed_s") * (1 - F.col("shown")) / F.col("shown"))
    source = F.when(F.col("log").isNotNull(), "job_log").otherwise("job")
    return rows.select("job_id", source.alias("source"), F.coalesce("log.stage", "stage").alias("stage"), F.round("shown", 4).alias("progress"), F.round("elapsed_s", 1).alias("elapsed_s"), F.round(eta, 1).alias("eta_s"))


def with_players(events: DataFrame, players: DataFrame) -> DataFrame:
    """Public events: each with its player's name and number, where the player is known."""
    return events.join(players, ["match_id", "player_id"], "left")


def linked_events(found: DataFrame, stored: DataFrame, within: float = 1.25, any_type: str = "shot") -> DataFrame:
    """(match_id, event_id, stored_id, by): stored events joined to analysed ones, each side used once.

    First by the id that a stored event names (the first stored event to name it has it); then, in order of stored id,
    the nearest free event of its type within ``within`` seconds (of any type for ``any_type``). Only a match's pairs
    within that time meet in one task. ``found``: (match_id, event_id, type, t); ``stored``: (match_id, stored_id,
    names, stored_type, stored_t).
    """
    named = stored.join(found.select("match_id", F.col("event_id").alias("names")), ["match_id", "names"])
    named = named.groupBy("match_id", F.col("names").alias("event_id")).agg(F.min("stored_id").alias("stored_id"))
    free = found.join(named, ["match_id", "event_id"], "left_anti")
    rest = stored.join(named.select("match_id", "stored_id"), ["match_id", "stored_id"], "left_anti")
    at = F.floor(F.col("stored_t") / within).cast("long")
    pairs = rest.withColumn("_bin", F.explode(F.array(at - 1, at, at + 1))).join(free.withColumn("_bin", F.floor(F.col("t") / within).cast("long")), ["match_id", "_bin"])
    away = F.abs(F.col("t") - F.col("stored_t"))
    pairs = pairs.where((away <= within) & ((F.col("type") == F.col("stored_type")) | (F.col("stored_type") == any_type))).select("match_id", "stored_id", "event_id", away.alias("away"))

    def run(match: pd.DataFrame) -> pd.DataFrame:
        used: dict = {}
        for stored_id, near in match.sort_values(["stored_id", "away", "event_id"]).groupby("stored_id", sort=True):
            left = [e for e in near["event_id"] if e not in used]
            if left:
                used[left[0]] = stored_id
        return pd.DataFrame({"match_id": match["match_id"].iloc[0], "event_id": list(used), "stored_id": list(used.values())})

    kinds = dict(pairs.dtypes)
    near = pairs.groupBy("match_id").applyInPandas(run, f"match_id {kinds['match_id']}, event_id {kinds['event_id']}, stored_id {kinds['stored_id']}")
    return named.withColumn("by", F.lit("id")).unionByName(near.withColumn("by", F.lit("time")))
