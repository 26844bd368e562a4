"""Detections to tracks: boxes, suppression, assignment, a Kalman tracker, stitching, identity measures.

Detections are rows (match_id, frame, det, x1, y1, x2, y2, conf). Tracking is sequential by nature and runs
as one small class (``tracker``) over each match's frames; everything around it is relational.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import exprs
from pitchlake.operators import timeseries as ts
from pitchlake.operators.tracker import Settings, Tracker, assign, iou  # noqa: F401  assign: for users of this module

BOX = ("x1", "y1", "x2", "y2")


def suppress(detections: DataFrame, most: float = 0.5) -> DataFrame:
    """Greedy suppression in each frame: a box goes when a more confident one that stays overlaps it too much."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["conf", "det"], ascending=[False, True])
        boxes, keep = frame[list(BOX)].to_numpy(float), []
        overlap = iou(boxes, boxes)
        for i in range(len(frame)):
            if not keep or overlap[i, keep].max() < most:
                keep.append(i)
        return frame.iloc[keep]

    return detections.groupBy("match_id", "frame").applyInPandas(run, detections.schema)


def strongest(detections: DataFrame, most: int) -> DataFrame:
    """At most ``most`` detections of a frame, by confidence."""
    w = Window.partitionBy("match_id", "frame").orderBy(F.desc("conf"), "det")
    return detections.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def track_frames(tracker: Tracker, rows: pd.DataFrame) -> list[tuple]:
    """(frame, det, track) of whole frames in order, by ``tracker``."""
    rows, out = rows.sort_values(["frame", "det"]), []
    frames, dets = rows["frame"].to_numpy(), rows["det"].tolist()
    boxes, scores, looks = rows[list(BOX)].to_numpy(float), rows["conf"].to_numpy(float), list(rows["look"]) if "look" in rows else None
    starts = np.flatnonzero(np.diff(frames, prepend=frames[:1] - 1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(dets)]):
        out += tracker.step(int(frames[a]), dets[a:b], boxes[a:b], scores[a:b], looks[a:b] if looks else None)
    return out


def track(detections: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(match_id, frame, det, track_id): the tracker over each match's frames; ``look`` (histogram array) is used where it is a column."""
    settings = settings or Settings()

    def run(match: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(track_frames(Tracker(settings), match), columns=["frame", "det", "track_id"])
        return found.assign(match_id=match["match_id"].iloc[0])[["match_id", "frame", "det", "track_id"]]

    kind = dict(detections.dtypes)
    looks = ["look"] if "look" in kind else []
    return detections.select("match_id", "frame", "det", *BOX, "conf", *looks).groupBy("match_id").applyInPandas(run, f"match_id {kind['match_id']}, frame {kind['frame']}, det {kind['det']}, track_id int")


def appearance_samples(tracked: DataFrame, every: int = 25, keep: int = 8, apart: float = 0.05) -> DataFrame:
    """(match_id, track_id, n, total, head, tail): histograms of each track, one in ``every`` frames, where its box stands alone.

    ``tracked`` is (match_id, frame, track_id, x1, y1, x2, y2, look). A box that overlaps another of its frame by more than
    ``apart`` waits for the next frame. ``head`` and ``tail`` are the first and last ``keep`` samples in order: bounded,
    however long the track; ``total`` is the sum of all samples.
    """
    frame = Window.partitionBy("match_id", "frame")
    others = F.collect_list(F.struct("track_id", *BOX)).over(frame)
    crowded = F.exists(others, lambda o: (o["track_id"] != F.col("track_id")) & (exprs.box_iou([F.col(c) for c in BOX], [o[c] for c in BOX]) > apart))
    alone = tracked.where(F.col("look").isNotNull()).withColumn("_crowded", crowded).where("NOT _crowded").drop("_crowded")
    keys = ["match_id", "track_id"]
    due = ts.debounce(alone, keys, "frame", every)
    rows = alone.join(due.withColumn("frame", F.col("frame").cast(dict(alone.dtypes)["frame"])), [*keys, "frame"])
    order = Window.partitionBy(*keys)
    rows = rows.withColumn("_first", F.row_number().over(order.orderBy("frame"))).withColumn("_last", F.row_number().over(order.orderBy(F.desc("frame"))))
    pick = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c) <= keep, F.struct("frame", "look")))), lambda r: r["look"])
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pick("_first").alias("head"), pick("_last").alias("tail"))
    bins = rows.select(*keys, F.posexplode("look").alias("bin", "v")).groupBy(*keys, "bin").agg(F.sum("v").alias("v"))
    total = bins.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "v"))), lambda r: r["v"]).alias("total"))
    return ends.join(total, keys).select(*keys, "n", "total", "head", "tail")


def stitch_target(parts: DataFrame, seeds: DataFrame, longest: float = 3.0, **gates: float) -> DataFrame:
    """(match_id, place, track_id): the chain that grows forward from one seed track of each match, cheapest successor first.

    ``seeds`` is (match_id, track_id). Successors are ``link_candidates``, found by a range join of ends and heads; a link
    starts after its tail's own start, so a chain never turns back, and growth stops at the first tail that has none. A
    match's candidates meet in one task, sorted once, so a step is one look-up.
    """

    def run(match: pd.DataFrame) -> pd.DataFrame:
        links = match.dropna(subset=["cost"]).sort_values(["cost", "t_start", "later"])
        best = {}
        for row in links.itertuples(index=False):
            best.setdefault(int(row.earlier), []).append(int(row.later))
        chain, used = [], set()
        for at in match.loc[match["cost"].isna(), "earlier"].astype(int):
            while at is not None:
                chain.append(at)
                used.add(at)
                at = next((x for x in best.get(at, ()) if x not in used), None)
        return pd.DataFrame({"match_id": match["match_id"].iloc[0], "place": np.arange(len(chain)), "track_id": chain})

    wanted = seeds.select("match_id").distinct()
    starts = parts.select("match_id", F.col("track_id").alias("later"), "t_start")
    links = link_candidates(parts.join(wanted, "match_id", "left_semi"), longest, **gates).join(starts, ["match_id", "later"])
    first = seeds.select("match_id", F.col("track_id").alias("earlier"), F.lit(None).cast("int").alias("later"), F.lit(None).cast("double").alias("cost"), F.lit(None).cast("double").alias("t_start"))
    kind = dict(parts.dtypes)["match_id"]
    rows = first.unionByName(links.select(first.columns))
    return rows.groupBy("match_id").applyInPandas(run, f"match_id {kind}, place int, track_id int")


def fragments(tracked: DataFrame, t: str = "t") -> DataFrame:
    """One row per track: its ends, with box height and velocity there."""
    return tracked.groupBy("match_id", "track_id").agg(
        F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.min_by(F.struct("x", "y"), t).alias("head"), F.max_by(F.struct("x", "y"), t).alias("tail"),
        F.avg("height").alias("height"), ((F.max_by("x", t) - F.min_by("x", t)) / F.nullif(F.max(t) - F.min(t), F.lit(0.0))).alias("vx"),
        ((F.max_by("y", t) - F.min_by("y", t)) / F.nullif(F.max(t) - F.min(t), F.lit(0.0))).alias("vy"))


def link_candidates(parts: DataFrame, longest: float = 3.0, overlap: float = 0.2, radius: float = 1.5, speed: float = 4.0) -> DataFrame:
    """(match_id, earlier, later, cost): fragments that begin shortly after another ends, near where it was heading."""
    later = parts.select("match_id", F.col("track_id").alias("later"), "t_start", F.col("head").alias("to"), F.col("height").alias("later_height"))
    earlier = parts.select("match_id", F.col("track_id").alias("earlier"), (F.col("t_end") - overlap).alias("lo"), (F.col("t_end") + longest).alias("hi"), "t_end", "tail", "height", "vx", "vy")
    pairs = ts.range_join(later, earlier, ["match_id"], "t_start", "lo", "hi", longest + overlap, closed=True).where("earlier <> later")
    dt = F.greatest(F.lit(0.0), F.col("t_start") - F.col("t_end"))
    ahead = F.least(dt, F.lit(1.0))
    away = F.hypot(F.col("to.x") - F.col("tail.x") - F.coalesce("vx", F.lit(0.0)) * ahead, F.col("to.y") - F.col("tail.y") - F.coalesce("vy", F.lit(0.0)) * ahead)
    reach = F.col("height") * (radius + speed * dt)
    return pairs.where(away <= reach).select("match_id", "earlier", "later", (away / reach + 0.1 * dt).alias("cost"))


def stitch(parts: DataFrame, **gates: float) -> DataFrame:
    """(match_id, track_id, chain_id): each fragment has one successor at most, cheapest links first; a chain is named by its first fragment."""

    def run(match: pd.DataFrame) -> pd.DataFrame:
        nxt, before = {}, {}
        for a, b in match.dropna(subset=["cost"]).sort_values(["cost", "earlier", "later"])[["earlier", "later"]].astype(int).itertuples(index=False):
            if a not in nxt and b not in before:
                nxt[a], before[b] = b, a
        names = {}
        for k in sorted(match.loc[match["cost"].isna(), "earlier"].astype(int)):
            first, seen = k, {k}
            while first in before and before[first] not in seen:
                first = before[first]
                seen.add(first)
            names[k] = first
        return pd.DataFrame({"match_id": match["match_id"].iloc[0], "track_id": list(names), "chain_id": list(names.values())})

    nodes = parts.select("match_id", F.col("track_id").alias("earlier"), F.lit(None).cast("int").alias("later"), F.lit(None).cast("double").alias("cost"))
    kind = dict(parts.dtypes)["match_id"]
    return nodes.unionByName(link_candidates(parts, **gates)).groupBy("match_id").applyInPandas(run, f"match_id {kind}, track_id int, chain_id int")


def identity_measures(tracked: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(match_id, truth_id, coverage, switches, dominant_share): both sides by millisecond, each truth box with its best overlapping track."""
    key = lambda df, p: df.select("match_id", F.rint(F.col("t") * 1000).cast("long").alias("ms"), F.col("track_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in BOX])
    both = key(truth, "truth").join(key(tracked, "own"), ["match_id", "ms"], "left")
    overlap = exprs.box_iou([F.col(f"truth_{c}") for c in BOX], [F.col(f"own_{c}") for c in BOX])
    best = both.withColumn("iou", overlap).groupBy("match_id", "ms", "truth_id").agg(F.max(F.struct("iou", "own_id")).alias("b")).withColumn("own", F.when(F.col("b.iou") >= least, F.col("b.own_id")))
    w = Window.partitionBy("match_id", "truth_id").orderBy("ms")
    was = F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = best.withColumn("switch", (F.col("own") != was).cast("int"))
    share = seen.groupBy("match_id", "truth_id", "own").agg(F.count(F.lit(1)).alias("n")).where("own IS NOT NULL").groupBy("match_id", "truth_id").agg((F.max("n") / F.sum("n")).alias("dominant_share"))
    return seen.groupBy("match_id", "truth_id").agg((F.count("own") / F.count(F.lit(1))).alias("coverage"), F.coalesce(F.sum("switch"), F.lit(0)).alias("switches")).join(share, ["match_id", "truth_id"], "left")
