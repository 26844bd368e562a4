"""Bookmarks, stored events and listings, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from pitchlake.operators import bookmarks as bm
from pitchlake.operators import stats
from pitchlake.sources import readers

EVIDENCE = "match_id int, source string, row int, t double, kind string, side string, confidence double, reason string"
SPAN = "match_id int, n int, start_s double, end_s double"


def plain_bookmark(start, end, fast, loud, evidence, states, targets):
    overlap = lambda spans: sum(max(0.0, min(end, b) - max(start, a)) for a, b in spans)
    has_fast, has_loud = overlap(fast) > 0, overlap(loud) > 0
    kind = bm.guessed_type(targets, has_fast, has_loud)
    confidence = min(0.99, round(0.45 + 0.22 * has_fast + 0.18 * has_loud + 0.08 * (kind in targets), 3))
    label, at = f"{kind}_candidate", (start + end) / 2
    sources = ["motion"] * has_fast + ["audio"] * has_loud
    first = {s: next((e for e in evidence if e["source"] == s and start <= e["t"] <= end), None) for s in ("goal", "card", "piece")}
    hit = None
    if first["goal"]:
        hit, kind, by = first["goal"], "goal", "ball_tracking"
        confidence = min(0.99, max(confidence, hit["confidence"]) + 0.05 * has_loud)
    elif first["card"]:
        hit, by = first["card"], "vision"
        kind = hit["kind"] or "yellow_card"
        confidence = min(0.99, max(confidence, hit["confidence"]))
    elif first["piece"] and first["piece"]["kind"] in bm.SET_PIECES:
        hit, by = first["piece"], "ball_tracking"
        kind, confidence = hit["kind"], min(0.99, max(confidence, 0.8))
    if hit:
        label, at, sources = f"{kind}_detected", hit["t"], [*sources, by]
    state = next((s["state"] for s in states if s["start"] <= at < s["end"]), None)
    return kind, label, round(confidence, 6), round(at, 3), tuple(sources or ["motion"]), state


@pytest.mark.parametrize("targets", [(), ("save", "foul", "sprint"), ("kickoff",)])
def test_candidate_bookmarks_equal_a_plain_loop(spark, targets):
    rng = random.Random(len(targets))
    at = lambda: rng.randrange(0, 6000) / 10
    intervals, signals, evidence, states, want = [], [], [], [], {}
    for match in range(4):
        mine = [(s, s + rng.choice([0.0, 5.0, 20.0, 95.0])) for s in (at() for _ in range(60))]
        spans = {k: [(s, s + rng.choice([0.0, 3.0, 40.0])) for s in (at() for _ in range(25))] for k in ("fast", "loud")}
        found = [dict(source=rng.choice(["goal", "card", "piece"]), t=at(), kind=rng.choice([None, "red_card", "corner_kick", "throw_in"]), side="left", confidence=rng.choice([0.3, 0.7, 0.98]), reason="x") for _ in range(30)]
        places = [dict(start=s, end=s + 30, state=rng.choice("ab")) for s in (at() for _ in range(20))]
        intervals += [(match, i, a, b) for i, (a, b) in enumerate(mine)]
        signals += [(match, k, a, b) for k, v in spans.items() for a, b in v]
        evidence += [(match, e["source"], i, e["t"], e["kind"], e["side"], e["confidence"], e["reason"]) for i, e in enumerate(found)]
        states += [(match, i, s["start"], s["end"], s["state"]) for i, s in enumerate(places)]
        for i, (a, b) in enumerate(mine):
            want[match, i + 1] = plain_bookmark(a, b, spans["fast"], spans["loud"], found, places, targets)
    got = bm.candidate_bookmarks(
        spark.createDataFrame(intervals, SPAN), spark.createDataFrame(signals, "match_id int, kind string, start_s double, end_s double"),
        spark.createDataFrame(evidence, EVIDENCE), spark.createDataFrame(states, "match_id int, row int, start_s double, end_s double, state string"), targets, bucket=15.0).collect()
    assert {(r["match_id"], r["index"]): (r["event_type"], r["label"], round(r["confidence"], 6), r["occurred_at_s"], tuple(r["sources"]), r["game_state"]) for r in got} == want
    assert {r["event_type"] for r in got} >= {"goal", "red_card", "corner_kick"} and all(r["bookmark_id"] == f"bm_{r['index']:04d}" for r in got)


def test_candidate_bookmarks_without_signals(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    signals, states = none("match_id int, kind string, start_s double, end_s double"), none("match_id int, row int, start_s double, end_s double, state string")
    evidence = spark.createDataFrame([(1, "goal", 0, None, None, None, None, None)], EVIDENCE)
    (row,) = bm.candidate_bookmarks(spark.createDataFrame([(1, 7, 2.0, 4.0)], SPAN), signals, evidence, states).collect()
    assert (row["index"], row["event_type"], row["confidence"], row["occurred_at_s"], row["sources"], row["game_state"]) == (1, "shot", 0.45, 3.0, ["motion"], None)
    assert bm.candidate_bookmarks(none(SPAN), signals, evidence, states).collect() == []


EVENT = "match_id int, event_id string, type string, t double, t_start double, t_end double, confidence double, excitement double, side string, reason string, team int, track_id int, sources array<string>, game_state string"


def test_event_bookmarks(spark):
    rows = [(1, "a", "shot", 20.0, None, None, 0.51239, 0.6, "left", None, 0, 3, ["ball"], None), (1, "b", "goal", 10.0, 8.0, 12.0, 0.9, 1.0, "right", "in", 1, 4, None, "play"),
            (1, "c", "sprint", 5.0, None, None, 0.9, 0.2, None, None, 1, 4, [], None), (1, "d", "yellow_card", 30.0, None, 31.0, 0.7, 0.6, "left", "arm", 1, 4, [], None)]
    events = spark.createDataFrame(rows, EVENT)
    got = {r["event_id"]: r for r in bm.event_bookmarks(events, trim_s=100.0).collect()}
    assert {k: (r["index"], r["start_s"], r["occurred_at_s"], r["end_s"], r["duration_s"]) for k, r in got.items()} == {
        "b": (1, 108.0, 110.0, 112.0, 4.0), "a": (2, 116.0, 120.0, 126.0, 10.0), "d": (3, 126.0, 130.0, 131.0, 5.0)}
    assert got["a"]["signals"] == {"side": "left"} and got["a"]["confidence"] == 0.512
    assert got["b"]["signals"] == {"side": "right", "reason": "in", "goal_side": "right", "goal_reason": "in"} and got["b"]["sources"] == ["ball_tracking"]
    assert got["d"]["signals"] == {"side": "left", "reason": "arm", "card_reason": "arm"} and got["a"]["clip_index"] is None
    clips = spark.createDataFrame([(1, 0, 1.0, 6.0, ["c", "d"]), (1, 1, 25.0, 40.0, ["d"])], "match_id int, clip_index int, t_start double, t_end double, event_ids array<string>")
    chosen = bm.event_bookmarks(events, events.where("event_id IN ('c', 'd', 'a')"), clips).orderBy("index").collect()
    assert [(r["event_id"], r["start_s"], r["end_s"], r["clip_index"]) for r in chosen] == [("c", 1.0, 6.0, 0), ("a", 16.0, 26.0, None), ("d", 25.0, 40.0, 1)]


def test_stored_windows_never_turn_around(spark):
    rows = spark.createDataFrame([(-3.0, -1.0, 2.0), (5.0, 9.0, 7.0), (4.0, 1.0, 2.0), (1.0005, 1.0015, 1.0025)], "s double, o double, e double").select(bm.window_ms(F.col("s"), F.col("o"), F.col("e")).alias("w")).select("w.*").collect()
    assert [(r["start_ms"], r["occurred_ms"], r["end_ms"]) for r in rows] == [(0, 0, 2000), (5000, 7000, 7000), (4000, 4000, 4000), (1000, 1002, 1002)]


def test_shown_track_and_rate(spark):
    rows = [(m, k, float(t)) for m in (1, 2, 3) for k, n in ((5, 4), (6, 9), (7, 9)) for t in range(n)]
    samples = spark.createDataFrame(rows, "match_id int, track_id int, t double")
    wanted = spark.createDataFrame([(1, None, 5), (2, 77, 5)], "match_id int, asked_id int, focus_id int")
    got = bm.every_kth(bm.shown_tracks(samples, wanted), ["match_id", "track_id"], ["t"], 3).collect()
    assert sorted(map(tuple, got)) == [(1, 5, 0.0), (1, 5, 3.0), (2, 6, 0.0), (2, 6, 3.0), (2, 6, 6.0), (3, 6, 0.0), (3, 6, 3.0), (3, 6, 6.0)]


def test_frames_seeing(spark):
    rng = random.Random(3)
    samples = [(k, rng.randrange(1000) / 50) for k in (1, 2) for _ in range(40)]
    times = [(k, rng.randrange(1000) / 50) for k in (1, 2, 3) for _ in range(60)]
    got = bm.frames_seeing(spark.createDataFrame(samples, "k int, t double"), spark.createDataFrame(sorted(set(times)), "k int, at double"), ["k"], "t", 0.07).collect()
    want = {k: sum(any(abs(t - s) <= 0.07 for j, s in samples if j == k) for i, t in set(times) if i == k) for k in (1, 2, 3)}
    assert {r["k"]: r["n_seen"] for r in got} == want and want[3] == 0


def test_source_types(spark):
    rows = {r["key"]: r for r in stats.source_types(spark).collect()}
    assert len(rows) == 10 and rows["raw_upload"]["premium"] and len(rows["raw_upload"]["supported"]) == 15
    assert "possession" in rows["veo"]["supported"] and "possession" in rows["hudl"]["unsupported"] and len(rows["other_link"]["supported"]) == 10
    keys = spark.createDataFrame([("veo",), (None,), ("?",), ("other_link",)], "k string").select(stats.source_key(F.col("k"))).collect()
    assert [r[0] for r in keys] == ["veo", "raw_upload", "raw_upload", "other_link"]


def test_runs_and_thumbnails(spark, tmp_path):
    import os

    for i, (run, name) in enumerate([("r1", "progress.json"), ("r2", "analysis_events.json"), ("r3", "notes.txt"), ("r1/thumbs", "0003.jpg"), ("r1/thumbs", "x.jpg"), ("r1/thumbs", "0001.jpg"), ("r1/thumbs", "a.png")]):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / name).write_text("{}")
        os.utime(tmp_path / run / name, (1000 + i, 1000 + i))
    files = readers.listed_files(spark, str(tmp_path))
    assert [r["folder"].rsplit("/", 1)[1] for r in readers.newest_runs(files).collect()] == ["r2", "r1"]
    assert readers.newest_runs(files, 1).count() == 1
    assert [(r["name"], r["t"]) for r in readers.thumbnails(files).orderBy("name").collect()] == [("0001.jpg", 0.0), ("0003.jpg", 20.0), ("x.jpg", 20.0)]
    assert readers.newest_runs(readers.listed_files(spark, str(tmp_path / "nowhere"))).collect() == []


def test_nullable_fields(spark):
    rows = spark.createDataFrame([("1", "x", "0.5"), (None, "7", None)], "id string, team string, confidence string")
    got = readers.nullable(rows, {"id": "int", "team": "int", "confidence": "double", "side": "string"}, {"confidence": 0.0, "id": -1}).collect()
    assert [tuple(r) for r in got] == [(1, None, 0.5, None), (-1, 7, 0.0, None)]


def test_answers_name_the_commonest_and_the_surest(spark):
    rows = [(1, i, k, c, ms) for i, (k, c, ms) in enumerate([("shot", 0.5, 61000), ("goal", 0.9, 3_600_500), ("shot", 0.9, 1500), ("save", 0.2, 0)])]
    (r,) = bm.match_answers(spark.createDataFrame(rows, "match_id int, event_id int, type string, confidence double, occurred_ms long"), "who?").collect()
    assert r["answer"] == "Match 1 has 4 detected events. Most common: shot: 2, goal: 1, save: 1. Surest moments: goal at 1:00:00 (0.90), shot at 0:02 (0.90), shot at 1:01 (0.50). Asked: 'who?'."
