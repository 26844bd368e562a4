import pytest
from pyspark.sql import functions as F

from pitchlake.operators import documents, focus, match
from pitchlake.sources.working import kept
from tests.synthetic import BALL, synthetic_matches

SIGNS = "match_id long, team int, sign int"


def entries(spark, paths, owners, existing=()):
    """``paths``: match, steps in the area, ball speed; 20 s at 10 Hz, the nearest player is 7, of team 0."""
    near = [(m, g, g / 10, 45.0 if g in inside else 10.0, 3.0, speed, (1.0, 7, 0)) for m, inside, speed in paths for g in range(200)]
    rows = spark.createDataFrame(near, "match_id long, g long, grid_t double, bx double, by double, ball_speed double, near struct<d: double, track_id: int, team: int>")
    who = spark.createDataFrame([(m, g, team, play) for m, spells in owners.items() for a, b, team, play in spells for g in range(a, b)], "match_id long, g long, team int, in_play boolean")
    signs = spark.createDataFrame([(m, team, 1 - 2 * team) for m in owners for team in (0, 1)], SIGNS)
    made = spark.createDataFrame(list(existing), "match_id long, t double, sign int")
    return sorted((r["match_id"], r["t"], r["team"], r["track_id"]) for r in match.area_entries(rows, signs, who, made).collect())


def test_entries_need_control_speed_and_play(spark):
    twice = {*range(10, 20), *range(30, 40), *range(120, 130)}
    whole = [(0, 200, 0, True)]
    paths = [(1, twice, 5.0), (2, twice, 5.0), (3, twice, 1.9), (4, twice, 5.0), (5, twice, 5.0), (6, twice, 5.0), (7, {*range(20)}, 5.0)]
    owners = {1: whole, 2: [(0, 200, 1, True)], 3: whole, 4: [(0, 200, 0, False)], 5: [(25, 200, 0, True)], 6: whole, 7: whole}
    got = entries(spark, paths, owners, [(6, 5.0, 1), (1, 5.0, -1)])
    # 5: an entry without control makes no quiet time; 6: an attempt on that goal stands for the first two; 7: there from the start
    assert got == [(1, 1.0, 0, 7), (1, 12.0, 0, 7), (5, 3.0, 0, 7), (5, 12.0, 0, 7), (6, 12.0, 0, 7)]


def test_a_document_agrees_with_the_chain(spark):
    rows = synthetic_matches(spark, 2, 30.0).cache()
    found = match.analyse(rows.where(F.col("track_id") != BALL), rows.where(F.col("track_id") == BALL), keep=kept, only=["team_document", "document_quality", "team_stats", "player_stats", "shots", "touches", "goals"])
    sheet = {(r["match_id"], r["team"]): r for r in found["team_document"].collect()}
    assert sorted(sheet) == [(m, team) for m in (0, 1) for team in (0, 1)]
    for r in found["team_stats"].collect():
        of = sheet[r["match_id"], r["team"]]
        assert (of["possession_pct"], of["passes"]) == (r["possession_pct"], r["passes"]) and (not of["passes"] or of["pass_accuracy_pct"] == r["pass_accuracy"])
    metres, players = {}, {}
    for r in found["player_stats"].collect():
        key = r["match_id"], r["team"]
        metres[key], players[key] = metres.get(key, 0) + r["distance_m"], players.get(key, 0) + 1
    shots, touches = ([(r["match_id"], r["team"]) for r in found[name].collect()] for name in ("shots", "touches"))
    for key, of in sheet.items():
        assert of["distance_m"] == pytest.approx(metres[key], abs=0.06) and of["players_tracked"] == players[key] == 5
        assert of["shots"] == shots.count(key) and of["touches"] == touches.count(key)
        assert of["own_pct"] + of["middle_pct"] + of["attack_pct"] == pytest.approx(100, abs=0.2)
    assert sum(of["goals"] for of in sheet.values()) == found["goals"].count() == 4
    assert all(sheet[m, 0]["own_pct"] == sheet[m, 1]["attack_pct"] and {sheet[m, k]["defends_first_half"] for k in (0, 1)} == {"left", "right"} for m in (0, 1))
    for q in found["document_quality"].collect():
        assert q["team_label_coverage_pct"] == 100.0 and 50 < q["ball_coverage_pct"] < 100
        assert q["possession_known_pct"] + q["possession_unknown_pct"] + q["possession_contested_pct"] == pytest.approx(100, abs=0.2)
    values = {(r["match_id"], r["side"], r["key"]): r["value"] for r in documents.catalogue_values(found["team_document"]).collect()}
    assert len(values) == 28 and all(values[m, "home", "total_shots"] == sheet[m, 0]["shots"] for m in (0, 1))


def test_documents_of_nothing(spark):
    none = spark.createDataFrame([], "match_id long, track_id int, team int, t double, side string, kind string, g long, grid_t double, x double, vx double, speed double, visible boolean, step double, code int, start_s double, state string, complete boolean, on_target boolean, sign int")
    assert documents.team_document(none, none, none, none, none, none, none, none, none, none).count() == 0
    lone = documents.team_document(none, none, none, none, spark.createDataFrame([(1, 0, 1), (1, 1, -1)], SIGNS), none, none, none, none, none).collect()
    assert {(r["team"], r["possession_pct"], r["shots"], r["own_pct"], r["passes_per_minute"]) for r in lone} == {(0, None, 0, 0.0, 0.0), (1, None, 0, 0.0, 0.0)}
    assert documents.document_quality(none, none, none, none).count() == 0


def test_places_of_events(spark):
    ball = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (1, 2.0, 10.0, 20.0), (1, 2.0, 90.0, 90.0), (1, 9.0, 30.0, 0.0)], "match_id long, t double, x double, y double")
    schema = "match_id long, t double, noted_x double, noted_y double, own_x double, own_y double"
    events = spark.createDataFrame(
        [(1, 1.5, None, None, 5.0, 5.0), (1, 1.6, 7.0, 8.0, 5.0, 5.0), (1, 2.0, None, None, None, None), (1, 5.0, None, None, 4.0, 4.0), (1, 6.0, None, None, None, None),
         (1, 2.1, None, None, None, None), (1, 0.9, None, None, None, None), (1, 9.2, None, 1.0, None, None), (2, 1.0, None, None, 1.0, 2.0)], schema)
    got = {(r["match_id"], r["t"]): (r["ball_x"], r["ball_y"], r["pitch_x"]) for r in documents.event_places(events, ball).collect()}
    assert got == {(1, 1.5): (5.0, 10.0, None), (1, 1.6): (7.0, 8.0, None), (1, 2.0): (10.0, 20.0, None), (1, 5.0): (4.0, 4.0, None), (1, 6.0): (None, None, None),
                   (1, 2.1): (10.3, 19.7, None), (1, 0.9): (0.0, 0.0, None), (1, 9.2): (None, None, None), (2, 1.0): (1.0, 2.0, None)}
    matrix = spark.sql("SELECT 1L AS match_id, array(array(2D, 0D, 1D), array(0D, 1D, 0D), array(0D, 0D, 1D)) AS homography")
    pitch = {(r["match_id"], r["t"]): (r["pitch_x"], r["pitch_y"]) for r in documents.event_places(events, ball, matrix).collect()}
    assert pitch[1, 1.5] == (11.0, 10.0) and pitch[1, 6.0] == (None, None) == pitch[2, 1.0]
    assert documents.event_places(events.where("false"), ball).count() == 0 and documents.event_places(events, ball.where("false")).count() == 9


def test_a_box_is_tried_again_within_three_seconds(spark):
    """Match 1: track 1 is there only 2 s later. Match 2: track 2 fits at once, though 1 fits better later. Match 3: 5 s are too far."""
    at = lambda m, k, t, x: (m, k, t, x, 0.0, x + 10.0, 20.0)
    boxes = spark.createDataFrame(
        [at(1, 1, 12.0, 0.0), at(1, 2, 0.0, 500.0), at(1, 2, 50.0, 500.0), at(2, 1, 12.0, 0.0), at(2, 2, 10.2, 6.0), at(3, 1, 15.0, 0.0), at(3, 2, 0.0, 500.0), at(3, 2, 50.0, 500.0)],
        "match_id int, track_id int, t double, x1 double, y1 double, x2 double, y2 double")
    asked = spark.createDataFrame([(m, None, 10.0, 0.0, 0.0, 10.0, 20.0) for m in (1, 2, 3)], "match_id int, focus_track_id int, roi_t double, roi_x1 double, roi_y1 double, roi_x2 double, roi_y2 double")
    parts = spark.createDataFrame([], "match_id int, track_id int, source_track_id int")
    got = {r["match_id"]: (r["method"], r["track_id"]) for r in focus.select_focus(asked, boxes, parts).collect()}
    assert got == {1: ("roi", 1), 2: ("roi", 2), 3: ("fallback_longest", 2)}
