import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import camera, tracking

DETECTIONS = "match_id long, frame int, det int, x1 double, y1 double, x2 double, y2 double, conf double"


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 3)):
        cost = rng.uniform(0, 1, (n, m))
        pairs = tracking.assign(cost, 2.0)
        small, big = min(n, m), max(n, m)
        best = min(sum((cost if n <= m else cost.T)[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert len(pairs) == small and sum(cost[i, j] for i, j in pairs) == pytest.approx(best)
    assert tracking.assign(np.array([[0.9]]), 0.5) == []


def two_walkers(frames=40):
    rows = []
    for f in range(frames):
        for d, (x, y) in enumerate(((10 + 2 * f, 50), (100 - 2 * f, 52))):
            if f not in (15, 16) or d:
                rows.append((1, f, d, float(x), float(y), x + 20.0, y + 50.0, 0.9))
    return rows


def test_tracker_keeps_two_identities_through_a_gap(spark):
    rows = spark.createDataFrame(two_walkers(), DETECTIONS)
    found = tracking.track(rows).toPandas()
    assert len(found) == 78 and found.groupby("det")["track_id"].nunique().max() <= 2


def test_suppression_keeps_the_most_confident(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 0, 1, 1.0, 0.0, 11.0, 10.0, 0.9), (1, 0, 2, 50.0, 0.0, 60.0, 10.0, 0.2)], DETECTIONS)
    assert sorted(r["det"] for r in tracking.suppress(rows).collect()) == [1, 2]
    assert [r["det"] for r in tracking.strongest(rows, 1).collect()] == [1]


def test_stitching_joins_a_broken_track(spark):
    rows = [(1, 1, t * 0.1, 10 + t * 0.3, 5.0, 2.0) for t in range(20)] + [(1, 2, 2.5 + t * 0.1, 17.5 + t * 0.3, 5.0, 2.0) for t in range(20)] + [(1, 3, 2.5, 90.0, 60.0, 2.0), (1, 3, 2.6, 90.0, 60.0, 2.0)]
    parts = tracking.fragments(spark.createDataFrame(rows, "match_id long, track_id int, t double, x double, y double, height double"))
    assert {r["track_id"]: r["chain_id"] for r in tracking.stitch(parts).collect()} == {1: 1, 2: 1, 3: 3}


def test_identity_measures_count_switches(spark):
    schema = "match_id long, t double, track_id int, x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([(1, i * 0.1, 7, 0.0, 0.0, 10.0, 10.0) for i in range(10)], schema)
    own = spark.createDataFrame([(1, i * 0.1, 1 if i < 6 else 2, 0.0, 0.0, 10.0, 10.0) for i in range(9)], schema)
    row = tracking.identity_measures(own, truth).first()
    assert row["switches"] == 1 and row["coverage"] == pytest.approx(0.9) and row["dominant_share"] == pytest.approx(6 / 9)


def test_camera_stays_inside_and_slow(spark):
    ball = spark.createDataFrame([(1, i, 100.0 if i < 25 else 1800.0, 500.0) for i in range(50)] + [(1, 50, None, None)], "match_id long, frame int, x double, y double")
    rows = camera.plan(ball, 1920.0, 1080.0)
    assert rows.count() == 51 and rows.agg(F.min("cx")).first()[0] >= 1920 * 0.2
    boxes = camera.crop_boxes(rows.withColumn("zoom", F.lit(2.0)), 1920.0, 1080.0).collect()
    assert all(b["x"] >= 0 and b["x"] + b["w"] <= 1920 and b["w"] % 2 == 0 for b in boxes)
    q = camera.quality(rows, 25.0, 960.0).first()
    assert q["snaps"] == 0 and q["pan_max"] <= 30 * 25 / 960 + 1e-6


def test_zoom_waits_before_it_rises(spark):
    need = [1.0] * 3 + [2.0] * 30 + [1.5]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(need)], "match_id long, frame int, required double")
    got = [r["zoom"] for r in camera.zoom_setpoints(rows, hold=10).orderBy("frame").collect()]
    assert got[5] == 1.0 and got[20] == 2.0 and got[-1] == 1.5
