"""The tracker: its filter against the full matrix form, identities, crossing players, the stream, samples of looks, chains from a seed."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import tracking
from pitchlake.operators.tracker import Filter, Settings, Tracker, measured
from pitchlake.streaming import live

DETECTIONS = "match_id long, frame int, det int, x1 double, y1 double, x2 double, y2 double, conf double"


def test_filter_equals_the_full_matrix_form():
    rng = np.random.default_rng(4)
    boxes = rng.uniform([0, 0, 20, 40], [800, 500, 30, 60], (6, 4))
    boxes[:, 2:] += boxes[:, :2]
    ours, z = Filter(measured(boxes)), measured(boxes)
    move, look = np.eye(8) + np.eye(8, k=4), np.eye(4, 8)
    noise = lambda h, a, b, c: np.array([a * h, a * h, b, a * h]), lambda h, a, b: np.array([a * h, a * h, b, a * h])
    dev = noise[1]
    state = [(np.r_[v, np.zeros(4)], np.diag(np.r_[dev(v[3], 0.1, 0.01), dev(v[3], 10 / 160, 1e-5)] ** 2)) for v in z]
    for step in range(200):
        ours.predict()
        state = [(move @ m, move @ p @ move.T + np.diag(np.r_[dev(m[3], 0.05, 0.01), dev(m[3], 1 / 160, 1e-5)] ** 2)) for m, p in state]
        rows = np.flatnonzero(rng.random(6) < 0.7)
        seen = ours.at[rows] + rng.normal(0, [3, 3, 0.02, 2], (len(rows), 4))
        r = [np.diag(dev(state[k][0][3], 0.05, 0.1) ** 2) for k in rows]
        total = [look @ state[k][1] @ look.T + x for k, x in zip(rows, r)]
        gate = [[(s - look @ state[k][0]) @ np.linalg.inv(t) @ (s - look @ state[k][0]) for s in seen] for k, t in zip(rows, total)]
        assert np.allclose(ours.surprise(rows, seen), np.array(gate).reshape(len(rows), len(rows)))
        for k, s, t in zip(rows, seen, total):
            m, p = state[k]
            gain = p @ look.T @ np.linalg.inv(t)
            state[k] = (m + gain @ (s - look @ m), p - gain @ t @ gain.T)
        ours.update(rows, seen)
        assert np.allclose(np.column_stack([ours.at, ours.speed]), [m for m, _ in state])
        assert np.allclose(ours.var, [np.diag(p)[:4] for _, p in state]) and np.allclose(ours.speed_var, [np.diag(p)[4:] for _, p in state])
        assert np.allclose(ours.cross, [np.diag(p[:4, 4:]) for _, p in state])


def players(frames=250, n=11, seed=1):
    """(frame, player, box): players on smooth paths that cross, 36 pixels high or so."""
    rng = np.random.default_rng(seed)
    t = np.arange(frames) / 25
    places = np.array([(180 + 270 * (k % 4), 140 + 190 * (k // 4)) for k in range(n)])  # neighbours' paths meet
    base, size, phase, rate = places + rng.uniform(-40, 40, (n, 2)), rng.uniform(20, 90, (n, 2)), rng.uniform(0, 6.3, (n, 2)), rng.uniform(0.3, 1.1, (n, 2))
    at = base[:, None] + size[:, None] * np.sin(rate[:, None] * t[None, :, None] + phase[:, None])
    half = np.array([9.0, 22.0])
    return {k: np.hstack([at[k] - half, at[k] + half]) for k in range(n)}


def noisy_detections(truth, seed=2, dropout=0.08, jitter=1.2):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(len(truth[0])):
        for k, path in truth.items():
            if rng.random() >= dropout:
                rows.append((1, f, len(rows), *(path[f] + rng.normal(0, jitter, 4)).tolist(), float(np.clip(rng.normal(0.7, 0.15), 0.12, 1))))
        if rng.random() < 0.1:
            x, y = rng.uniform(0, 1200), rng.uniform(0, 700)
            rows.append((1, f, len(rows), x, y, x + 18.0, y + 44.0, 0.45))
    return rows


def test_identities_are_recovered(spark):
    truth = players()
    rows = spark.createDataFrame(noisy_detections(truth), DETECTIONS)
    found = tracking.track(rows)
    boxes = found.join(rows, ["match_id", "frame", "det"]).withColumn("t", F.col("frame") / 25)
    true = spark.createDataFrame([(1, f / 25, k, *map(float, p[f])) for k, p in truth.items() for f in range(len(p))], "match_id long, t double, track_id int, x1 double, y1 double, x2 double, y2 double")
    measures = tracking.identity_measures(boxes, true).collect()
    assert len(measures) == 11 and np.mean([m["dominant_share"] >= 0.8 for m in measures]) >= 0.9 and max(m["switches"] for m in measures) <= 1
    assert found.groupBy("track_id").count().where("count > 10").count() <= 13


def crossing(with_looks):
    """Two players walk towards each other, stand in one place for a while and turn back."""
    red, blue = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    rows = []
    for f in range(80):
        x = 3.0 * min(f, 79 - f)
        for d, (at, y, look) in enumerate(((x, 50.0, red), (237 - x, 50.0, blue))):
            rows.append((f, d, at, y, at + 20, y + 50, look))
    tracker, out = Tracker(Settings()), {}
    for f, frame in pd.DataFrame(rows, columns=["frame", "det", "x1", "y1", "x2", "y2", "look"]).groupby("frame"):
        for now, det, track in tracker.step(f, frame["det"].tolist(), frame[["x1", "y1", "x2", "y2"]].to_numpy(float), np.full(2, 0.9), list(frame["look"]) if with_looks else None):
            out[now, det] = track
    return out


def test_looks_keep_players_apart_where_motion_cannot():
    seen, blind = crossing(True), crossing(False)
    assert len({seen[f, 0] for f in range(80)}) == 1 and len({seen[f, 1] for f in range(80)}) == 1
    assert blind[0, 0] != blind[79, 0]  # they meet, turn back, and motion alone goes straight on


def test_frames_without_rows_have_passed():
    tracker = Tracker(Settings(lost=5))
    box = lambda x: np.array([[x, 0.0, x + 20, 50.0]])
    first = [tracker.step(f, [0], box(2.0 * f), np.array([0.9]))[0][2] for f in range(5)]
    assert tracker.step(8, [0], box(15.0), np.array([0.9]))[0][2] == first[0]
    assert tracker.step(20, [0], box(40.0), np.array([0.9])) == [] and len(tracker.ids) == 1
    assert tracker.step(21, [], np.zeros((0, 4)), np.zeros(0)) == [] and not len(tracker.ids)  # not confirmed


def test_the_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = noisy_detections(players(60, 5), 3)
    want = {tuple(r) for r in tracking.track(spark.createDataFrame(rows, DETECTIONS)).collect()}
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == part], DETECTIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        # the query stops after each part and starts anew from its checkpoint
        live.write_once(live.live_tracks(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert set(got) == want and len(got) == len(want) > 200


def test_samples_of_looks_equal_a_loop(spark):
    rng = np.random.default_rng(0)
    rows = []
    for f in range(120):
        for k in range(3):
            x = 40.0 * k + float(rng.choice([0, 0, 0, 25]))
            rows.append((1, f, k, x, 0.0, x + 20, 50.0, None if rng.random() < 0.1 else [float(f), float(k)]))
    df = spark.createDataFrame(rows, "match_id long, frame int, track_id int, x1 double, y1 double, x2 double, y2 double, look array<double>")
    got = {r["track_id"]: r for r in tracking.appearance_samples(df, 7, 4).collect()}
    for k in range(3):
        kept, last = [], None
        for f in range(120):
            same = [r for r in rows if r[1] == f and r[7] is not None]
            own = next((r for r in same if r[2] == k), None)
            if own is None or (last is not None and f - last < 7):
                continue
            meet = lambda a, b: max(0, min(a[5], b[5]) - max(a[3], b[3])) * 50
            if any(r[2] != k and meet(own, r) / (2000 - meet(own, r)) > 0.05 for r in same):
                continue
            kept.append(own[7])
            last = f
        assert got[k]["n"] == len(kept) > 8 and got[k]["head"] == kept[:4] and got[k]["tail"] == kept[-4:]
        assert got[k]["total"] == pytest.approx([sum(v[0] for v in kept), sum(v[1] for v in kept)])


def test_a_chain_grows_from_its_seed(spark):
    rows = []
    for lane in range(25):
        for i in range(200):
            t0 = i * 2.0
            rows.append((1, lane * 200 + i, t0, t0 + 1.5, (t0 * 3, lane * 40.0), ((t0 + 1.5) * 3, lane * 40.0), 2.0, 3.0, 0.0))
    schema = "match_id long, track_id int, t_start double, t_end double, head struct<x: double, y: double>, tail struct<x: double, y: double>, height double, vx double, vy double"
    parts = spark.createDataFrame(rows, schema).cache()
    parts.count()
    began = time.time()
    chain = [r["track_id"] for r in tracking.stitch_target(parts, spark.createDataFrame([(1, 3 * 200 + 20)], "match_id long, track_id int")).orderBy("place").collect()]
    assert chain == list(range(620, 800)) and time.time() - began < 5
    alone = tracking.stitch_target(parts, spark.createDataFrame([(1, 799)], "match_id long, track_id int")).collect()
    assert [r["track_id"] for r in alone] == [799]
