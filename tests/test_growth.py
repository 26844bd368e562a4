"""What must not grow with the tables: plans, broadcasts, pairs, time a sample; and places that don't hang on the order of sums."""

import time

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchlake.operators import camera_plan, control, match, restarts, stats, tracking
from pitchlake.operators import timeseries as ts
from pitchlake.operators.tracker import Tracker
from pitchlake.plans import matches, registry
from pitchlake.sources import working
from pitchlake.sources.working import kept

SF = "/root/testdata/sf0.001"
LARGEST_PLAN = 80


def test_planner_knows_the_size_of_a_kept_table(spark):
    df = kept(spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(299_999))).alias("i")))
    assert df.count() == 300_000
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 300_000


def test_goal_candidates_are_kept_before_they_are_judged(spark):
    seen = []
    ball = spark.createDataFrame([(1, i / 10, 50.0 + i / 2, 0.0) for i in range(12)], "match_id long, t double, x double, y double")
    kin = spark.createDataFrame([], "match_id long, track_id int, team int, grid_t double, x double, y double")
    signs = spark.createDataFrame([(1, 0, 1), (1, 1, -1)], "match_id long, team int, sign int")
    from pitchlake.operators import goals

    rows = goals.goal_events(ball, kin, signs, keep=lambda df: seen.append(df.columns) or kept(df))
    assert len(seen) == 3 and "base" in seen[0] and "kickoff_t" in seen[1] and "verdict" in seen[2]
    assert rows.count() >= 1 and "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()


class _OfMatch:
    """Takes the function that an operator runs for each match."""

    dtypes = [("match_id", "bigint")]

    def select(self, *_):
        return self

    def groupBy(self, *_):  # noqa: N802
        return self

    def applyInPandas(self, function, _):  # noqa: N802
        return function


def test_ball_filter_and_anchors_take_microseconds_a_sample():
    n, rng = 300_000, np.random.default_rng(0)
    df = pd.DataFrame({"match_id": 1, "t": np.arange(n) / 10, "x": 40 * np.sin(np.arange(n) / 30) + rng.normal(0, 0.1, n), "y": 20 * np.cos(np.arange(n) / 50)})
    began = time.process_time()
    out = match.filter_ball(_OfMatch(), 105.0, base_gate=6.0)(df)
    list(restarts.anchored(df["t"].to_numpy(), df["x"].to_numpy(), df["y"].to_numpy(), 0.05, 1.2, 1.25, lambda i, j: True))
    assert len(out) > 0.99 * n and (np.diff(out["t"]) > 0).all() and (out["raw_count"] == n).all()
    assert time.process_time() - began < 4


def test_tracker_takes_a_fraction_of_a_millisecond_a_frame():
    rng = np.random.default_rng(0)
    home, who = rng.uniform(0, 1800, (22, 2)), rng.integers(0, 22, 6000)
    at = home[who] + rng.normal(0, 5, (6000, 2))
    df = pd.DataFrame({"frame": np.arange(6000), "det": who, "x1": at[:, 0] - 60, "y1": at[:, 1] - 40, "x2": at[:, 0] + 60, "y2": at[:, 1] + 40, "conf": 0.9})
    began = time.process_time()
    out = tracking.track_frames(Tracker(), df)
    assert len(out) > 2000 and time.process_time() - began < 9


def test_batches_that_ask_for_the_same_are_counted_once(spark):
    feedback = spark.range(3000).select(F.lit(1).cast("long").alias("tenant_id"), F.lit("O").alias("status"), "id", F.lit("k").alias("kind"), F.lit("2020-01-01").cast("timestamp").alias("at")).withColumnRenamed("id", "match_id")
    criteria = spark.range(2000).select(
        F.col("id").alias("batch_id"), F.lit(1).cast("long").alias("tenant_id"), F.lit("O").alias("status"), F.when(F.col("id") % 2 == 0, F.array(F.lit(5).cast("long"), F.lit(6).cast("long"))).alias("match_ids"), F.lit(None).cast("array<string>").alias("kinds"),
        F.lit(None).cast("timestamp").alias("from_at"), F.lit(None).cast("timestamp").alias("to_at"))
    began = time.time()
    got = {tuple(r) for r in control.feedback_batches(feedback, criteria).select(F.col("batch_id") % 2, "item_count").distinct().collect()}
    assert got == {(0, 2), (1, 3000)}
    plan = control.feedback_batches(feedback, criteria)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_asked" in plan and time.time() - began < 60


def test_clock_of_long_matches_as_in_sql(spark, tmp_path):
    spark.sql("SELECT CAST(id * 9000 AS BIGINT) AS event_id FROM range(12)").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[0]: r for r in con.execute(registry.ORACLES["cursor_and_clock"]).fetchall()}
    got = {r["event_id"]: (r["event_id"], r["cursor"], r["back"], r["clock"]) for r in registry.QUERIES["cursor_and_clock"](spark, str(tmp_path)).collect()}
    assert got == want and any(len(r[3]) > 5 for r in want.values())


def test_players_places_do_not_hang_on_partial_sums(spark, tmp_path):
    values = [0.1, 0.2, 0.3, 1e16, 1.0, -1e16]
    rows = [(u * 6 + i, u, "purchase", v) for u in range(0, 40, 2) for i, v in enumerate(values)] + [(900, 1, "view", 3.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM (SELECT * FROM '{tmp_path}/events.parquet/*.parquet' ORDER BY event_id)")
    key = lambda r: (r[0], r[1], r[2], r[3], r[4])
    want = sorted(map(key, con.execute(registry.ORACLES["player_table"]).fetchall()))
    got = sorted((r["user_id"], r["team"], r["distance"], r["place"], r["scale"]) for r in registry.QUERIES["player_table"](spark, str(tmp_path)).collect())
    assert got == want


def test_similarity_holds_one_pair_of_blocks(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.random(8).tolist()) for i in range(500)], "id long, h array<double>")
    one = stats.most_similar(rows, rows.where("id % 50 = 0"), "id", "h", 3)
    many = stats.most_similar(rows, rows.where("id % 50 = 0"), "id", "h", 3, block=64)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert "FlatMapCoGroupsInPandas" in many._jdf.queryExecution().optimizedPlan().toString()


def test_states_leave_their_task_as_first_and_last_steps():
    n = 1000
    df = pd.DataFrame({"match_id": 1, "g": np.arange(n), "grid_t": np.arange(n) / 10, "x": 0.0, "y": np.where(np.arange(n) // 200 % 2 == 1, 50.0, 0.0), "visible": True})
    seen = []

    class Grid(_OfMatch):
        def applyInPandas(self, function, _):  # noqa: N802
            seen.append(function(df))
            raise StopIteration

    try:
        match.game_states(Grid())
    except StopIteration:
        pass
    assert seen[0]["state"].nunique() == 2 and len(seen[0]) <= 10 and seen[0]["g"].iloc[[0, -1]].tolist() == [0, n - 1]


def test_camera_shuffles_narrow_rows_and_broadcasts_no_samples(spark):
    by_match = lambda sql: spark.sql(sql).repartition(3, "match_id")
    one = by_match("SELECT id AS match_id FROM range(3)")
    spans = one.selectExpr("match_id", "0D AS start_s", "9.5D AS end_s")
    field = one.selectExpr("match_id", "120D AS x_min", "1800D AS x_max", "81D AS y_min", "999D AS y_max")
    segments = by_match("SELECT id AS match_id, 0D AS start_s, 'in_play' AS state, CAST(NULL AS STRING) AS side FROM range(3)")
    # no ball in match 0, one that comes late and goes early in match 1, one that is there before and after the span in match 2
    ball = by_match("SELECT 1 + id % 2 AS match_id, IF(id % 2 = 0, 2 + (id DIV 2) / 10, (id DIV 2) / 5 - 3) AS t, 500D + id AS x, 400D AS y FROM range(100)").selectExpr("match_id", "CAST(t AS DOUBLE) AS t", "x", "y")
    players = by_match("SELECT id % 3 AS match_id, id % 7 AS track_id, CAST(id AS DOUBLE) / 30 AS t, 600D + id AS x, 300D AS y FROM range(300)")
    wishes = camera_plan.setpoints(spans, ball, segments, players, field, camera_plan.Style(fps=5.0))
    plan = wishes._jdf.queryExecution().executedPlan().toString()
    planned = camera_plan.planned(wishes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "hashpartitioning(frame" not in plan and planned.count("Exchange") == plan.count("Exchange")
    frames = {(r["match_id"], r["frame"]): r for r in wishes.collect()}
    assert set(frames) == {(m, f) for m in range(3) for f in range(48)} and wishes.count() == 3 * 48
    seen = {m: [f for f in range(48) if frames[m, f]["ball_x"] is not None] for m in range(3)}
    assert seen == {0: [], 1: list(range(10, 35)), 2: list(range(0, 35))}


def test_asof_rows_stay_dealt_by_their_keys(spark):
    left, right = spark.sql("SELECT id % 5 AS k, id AS t FROM range(50)"), spark.sql("SELECT id % 5 AS k, id * 3 AS at FROM range(10)")
    found = ts.asof_backward(left, right, ["k"], "t", "at")
    grouped = found.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert grouped.count("Exchange") == found._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert {(r["k"], r["t"]): r["asof"] and r["asof"]["at"] for r in found.collect()}[3, 13] == 9


def test_plans_of_match_results_stay_small(spark):
    """A plan that holds what it shares many times over is re-planned after each of its stages, in the driver's memory."""
    seen = {}

    def keep(df):
        seen[",".join(df.columns)] = df._jdf.queryExecution().optimizedPlan().toString().count("\n")
        return spark.createDataFrame([], df.schema)

    samples = spark.createDataFrame([], "match_id long, track_id int, team int, t double, x double, y double")
    match.analyse(samples, samples.select("match_id", "t", "x", "y"), halves=spark.createDataFrame([], "match_id long, half_s double"), keep=keep)
    assert len(seen) >= 15 and max(seen.values()) < LARGEST_PLAN, seen


def test_plans_of_results_hold_few_sources(spark):
    """What is returned is planned by its writer after each of its stages, as what is kept is."""
    empty = lambda df: spark.createDataFrame([], df.schema)
    samples = spark.createDataFrame([], "match_id long, track_id int, team int, t double, x double, y double")
    names = ["dribbles", "momentum", "passes", "team_document", "team_stats"]
    results = match.analyse(samples, samples.select("match_id", "t", "x", "y"), halves=spark.createDataFrame([], "match_id long, half_s double"), keep=empty, only=names)
    nodes = {name: results[name]._jdf.queryExecution().optimizedPlan().toString().count("\n") for name in names}
    assert nodes["team_document"] < 50 and max(v for name, v in nodes.items() if name != "team_document") < 30, nodes


def test_what_is_kept_by_a_key_stays_dealt(spark):
    rows = spark.sql("SELECT id DIV 50 AS match_id, id % 50 AS g, id * 0.5D AS x FROM range(1000)").repartition(5, "match_id")
    one, two = kept(rows, "match_id", 5), kept(rows.withColumnRenamed("x", "y"), "match_id", 5)
    was = F.lag("x").over(Window.partitionBy("match_id").orderBy("g"))
    both = one.withColumn("was", was).join(two, ["match_id", "g"], "left").groupBy("match_id", "g").agg(F.max("was").alias("was"), F.max("y").alias("y"))
    with working.setting(spark, working.WRITING | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert {(r["match_id"], r["g"], r["was"], r["y"]) for r in kept(both, "match_id", 5).collect()} == {(i // 50, i % 50, (i - 1) / 2 if i % 50 else None, i / 2) for i in range(1000)}
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true" and not [t for t in spark.catalog.listTables() if t.name.startswith("kept_")]


def test_steps_of_a_match_shuffle_no_samples(spark, monkeypatch):
    """Only moments, before they are spread into samples, and what few touches, goal signals, goals and entries need are dealt anew."""
    shuffled = {}

    def counted(df, *args, **kwargs):
        with working.setting(spark, getattr(working, "WRITING", {}) | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
            plan = df._jdf.queryExecution().executedPlan().toString()
        shuffled[",".join(df.columns)] = plan.count("ENSURE_REQUIREMENTS") + plan.count("REPARTITION_BY_COL")
        return kept(df, *args, **kwargs)

    monkeypatch.setattr(matches, "kept", counted)
    monkeypatch.setattr(matches, "_tasks", lambda rows: 5)
    registry.QUERIES["match_events"](spark, SF)
    shuffled.pop(next(iter(shuffled)))  # moments
    assert len(shuffled) >= 20 and sum(shuffled.values()) <= 4, shuffled
    places = [c for c in shuffled if "track_id" in c and "run" in c or "visible" in c or "near" in c and "d0" in c]
    assert len(places) == 3 and not any("step" in c or "vx" in c for c in places)
