import pytest
from pyspark.sql import functions as F

from pitchlake.functions import exprs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("07", "7"), (" 7 ", "7"), ("000", "000"), ("", ""), (None, "")])
def test_jersey(spark, text, want):
    assert value(spark, exprs.normalize_jersey(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("team,want", [("home", "home"), (" Team_Away ", "away"), ("reds", "home"), ("x", "unattributed"), (None, "unattributed"), ("", "unattributed")])
def test_team_bucket(spark, team, want):
    assert value(spark, exprs.team_bucket(F.lit(team).cast("string"), F.lit("Reds"), F.lit("Blues"))) == want


@pytest.mark.parametrize("text,want", [("90", 90.0), ("1:30", 90.0), ("1:00:05", 3605.0), ("x", None)])
def test_parse_clock(spark, text, want):
    assert value(spark, exprs.parse_clock(F.lit(text))) == want


@pytest.mark.parametrize("seconds,want", [(0.5, "0:00"), (1.5, "0:02"), (75, "1:15"), (3605, "1:00:05"), (-3, "0:00")])
def test_format_clock_rounds_half_to_even(spark, seconds, want):
    assert value(spark, exprs.format_clock(F.lit(float(seconds)))) == want


def test_cursor_round_trip_and_broken_cursors(spark):
    assert value(spark, exprs.decode_cursor(exprs.encode_cursor(F.lit(1234)))) == 1234
    assert value(spark, exprs.decode_cursor(F.lit("!!"))) == 0
    assert value(spark, exprs.decode_cursor(F.lit(None).cast("string"))) == 0


@pytest.mark.parametrize("url,want", [("https://www.youtube.com/x", "youtube"), ("https://a.example.org/x", "other_link"), ("no link", None)])
def test_source_of_url(spark, url, want):
    assert value(spark, exprs.source_of_url(F.lit(url))) == want


def test_geometry(spark):
    x, y = exprs.project([[1, 0, 2], [0, 1, 3], [0, 0, 1]], F.lit(1.0), F.lit(1.0))
    assert value(spark, F.struct(x, y)) == (3.0, 4.0)
    behind, _ = exprs.project([[1, 0, 0], [0, 1, 0], [0, 0, -1]], F.lit(1.0), F.lit(1.0))
    assert value(spark, behind) is None
    assert value(spark, exprs.in_bounds(F.lit(float("nan")), F.lit(0.0))) is False
    box = lambda *v: [F.lit(float(c)) for c in v]
    assert value(spark, exprs.box_iou(box(0, 0, 2, 2), box(1, 0, 3, 2))) == pytest.approx(1 / 3)
    assert value(spark, exprs.channels_hex(F.lit(255.0), F.lit(16.4), F.lit(-3.0))) == "#ff1000"
    assert value(spark, exprs.hex_channels(F.lit("#ff1000"))) == [255, 16, 0]
    same = F.array(F.lit(1.0), F.lit(3.0))
    assert value(spark, exprs.histogram_similarity(same, same)) == pytest.approx(1.0)


def test_clip_window_is_never_empty(spark):
    w = value(spark, exprs.clip_window_ms(F.lit(0), F.lit(0), F.lit(0), 0.0, 0.0))
    assert w["end_ms"] > w["start_ms"] >= 0
