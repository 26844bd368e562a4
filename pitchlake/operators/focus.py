"""Tracks around a point or a box: neighbours, the track that a user means, keepers, and what a match's tracks cover.

All partition by match. A match's requests (boxes, times) are joined to its samples by key, and one aggregate for each
track, then one for each match, chooses: nothing is sorted as a whole and nothing comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.functions import exprs

BOX = ("x1", "y1", "x2", "y2")


# --- players near a point in time and space ---------------------------------------------------------------------


def neighbours(points: DataFrame, samples: DataFrame, keys: Sequence[str], t: str, sample_t: str, bin_s: float) -> DataFrame:
    """Each point with every sample of its own time bin and the two beside it, by an equi-join on the bin.

    Columns of the samples other than the keys must not clash with the points'.
    """
    at = F.floor(F.col(t) / bin_s).cast("long")
    spread = points.withColumn("_bin", F.explode(F.array(at - 1, at, at + 1)))
    placed = samples.withColumn("_bin", F.floor(F.col(sample_t) / bin_s).cast("long"))
    return spread.join(placed, [*keys, "_bin"]).drop("_bin")


def centroids(pairs: DataFrame, point: Sequence[str], x: str, y: str, distance: Column, radius: float) -> DataFrame:
    """(point, n_near, cx, cy): the mean place of the samples within ``radius``, or of all if fewer than two are."""
    near = distance <= radius
    rows = pairs.groupBy(*point).agg(
        F.count_if(near).alias("n_near"), *[F.avg(c).alias(f"all_{c}") for c in (x, y)], *[F.avg(F.when(near, F.col(c))).alias(f"near_{c}") for c in (x, y)])
    chosen = lambda c: F.when(F.col("n_near") >= 2, F.col(f"near_{c}")).otherwise(F.col(f"all_{c}"))
    return rows.select(*point, "n_near", chosen(x).alias("cx"), chosen(y).alias("cy"))


def engaged(pairs: DataFrame, point: Sequence[str], distance: Column, tie: str, radius: float, count: int) -> DataFrame:
    """The ``count`` samples nearest to each point within ``radius``, with their place; points with one alone have none."""
    w = Window.partitionBy(*point)
    rows = pairs.withColumn("distance", distance).where(F.col("distance") <= radius)
    rows = rows.withColumn("place", F.row_number().over(w.orderBy("distance", tie))).where(F.col("place") <= count)
    return rows.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n >= 2").drop("_n")


# --- the track that a user means --------------------------------------------------------------------------------


def _roi() -> list[Column]:
    return [F.col(f"roi_{c}") for c in BOX]


def _centre(box: Sequence[Column]) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def _measures() -> dict[str, Column]:
    """IoU, whether the box's centre lies in the wanted box, and how far the centres are apart."""
    box, roi = [F.col(c) for c in BOX], _roi()
    (cx, cy), (ux, uy) = _centre(box), _centre(roi)
    inside = cx.between(roi[0], roi[2]) & cy.between(roi[1], roi[3])
    return {"iou": exprs.box_iou(roi, box), "inside": F.coalesce(inside.cast("int"), F.lit(0)), "away": F.hypot(cx - ux, cy - uy)}


def track_at_box(boxes: DataFrame, requests: DataFrame, window_s: float = 0.5, reach: float = 1.5, retry_s: float | None = None) -> DataFrame:
    """(match_id, track_id): the track under a wanted box near its time; matches without any have no row.

    With ``retry_s`` tracks up to that far in time are taken where none within ``window_s`` fits.

    Each track's sample nearest in time (the earlier of two) counts if it is within ``window_s``, and overlaps, lies in
    the box or is at most ``reach`` diagonals away. Most overlap wins, then lying inside, then being near, then the
    lower id. ``boxes`` is (match_id, track_id, t, x1, y1, x2, y2); ``requests`` (match_id, roi_t, roi_x1, ...).
    """
    rows = boxes.join(requests, "match_id").where(F.abs(F.col("t") - F.col("roi_t")) <= max(window_s, retry_s or 0.0))
    nearest = rows.groupBy("match_id", "track_id", "roi_t", *[f"roi_{c}" for c in BOX]).agg(
        F.min_by(F.struct(*BOX), F.struct(F.abs(F.col("t") - F.col("roi_t")), F.col("t"))).alias("box"),
        (F.min(F.abs(F.col("t") - F.col("roi_t"))) <= window_s).cast("int").alias("soon")).select("*", "box.*").drop("box")
    scored = nearest.withColumns(_measures())
    roi = _roi()
    diagonal = F.greatest(F.hypot(roi[2] - roi[0], roi[3] - roi[1]), F.lit(1.0))
    fit = scored.where((F.col("iou") > 0) | (F.col("inside") == 1) | (F.col("away") <= reach * diagonal))
    return fit.groupBy("match_id").agg(F.max_by("track_id", F.struct("soon", "iou", "inside", -F.col("away"), -F.col("track_id"))).alias("track_id"))


def early_target(boxes: DataFrame, requests: DataFrame, window_t: float = 3.0) -> DataFrame:
    """(match_id, track_id): the track that lies best under a wanted box over a match's first seconds.

    Ranked by the best overlap, the mean overlap, the share of samples inside, the mean distance and the number of
    samples; the lower id wins ties.
    """
    rows = boxes.where(F.col("t") <= window_t).join(requests, "match_id").withColumns(_measures())
    tracks = rows.groupBy("match_id", "track_id").agg(
        F.max("iou").alias("best"), F.avg("iou").alias("mean"), F.avg("inside").alias("share"), F.avg("away").alias("away"), F.count(F.lit(1)).alias("n"))
    rank = F.struct("best", "mean", "share", -F.col("away"), "n", -F.col("track_id"))
    return tracks.groupBy("match_id").agg(F.max_by("track_id", rank).alias("track_id"))


def track_spans(samples: DataFrame) -> DataFrame:
    """(match_id, track_id, first_t, last_t, n)."""
    return samples.groupBy("match_id", "track_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n"))


def longest_tracks(spans: DataFrame) -> DataFrame:
    """(match_id, track_id) of the longest track of each match; the lower id wins ties."""
    rank = F.struct(F.col("last_t") - F.col("first_t"), -F.col("track_id"))
    return spans.groupBy("match_id").agg(F.max_by("track_id", rank).alias("track_id"))


def select_focus(requests: DataFrame, boxes: DataFrame, identities: DataFrame, window_s: float = 0.5, retry_s: float = 3.0) -> DataFrame:
    """(match_id, method, track_id): a wanted id, the identity it was stitched into, the track under a box, or the longest.

    ``requests`` is (match_id, focus_track_id, roi_t, roi_x1, ...), either part null; with neither the method is "none".
    A box that no track fits within ``window_s`` (two frame steps, half a second at least) is tried again within ``retry_s``.
    ``identities`` is (match_id, track_id, source_track_id), one row for each fragment of an identity.
    """
    spans = track_spans(boxes)
    exact = spans.select("match_id", F.col("track_id").alias("exact_id"))
    sources = identities.groupBy("match_id", "source_track_id").agg(F.min("track_id").alias("stitched_id"))
    wanted_box = requests.where("roi_x1 IS NOT NULL").select("match_id", "roi_t", *[f"roi_{c}" for c in BOX])
    under = track_at_box(boxes, wanted_box, window_s, retry_s=retry_s).withColumnRenamed("track_id", "roi_id")
    longest = longest_tracks(spans).withColumnRenamed("track_id", "longest_id")
    same = lambda right, c: (F.col("r.match_id") == F.col(f"{right}.match_id")) & (F.col("r.focus_track_id") == F.col(f"{right}.{c}"))
    rows = requests.alias("r").join(exact.alias("e"), same("e", "exact_id"), "left").join(sources.alias("s"), same("s", "source_track_id"), "left")
    rows = rows.select("r.*", "exact_id", "stitched_id").join(under, "match_id", "left").join(longest, "match_id", "left")
    by_box = F.col("roi_x1").isNotNull()
    method = F.when(F.col("exact_id").isNotNull(), "track_id").when(F.col("stitched_id").isNotNull(), "track_id_stitched").when(
        by_box & F.col("roi_id").isNotNull(), "roi").when(by_box & F.col("longest_id").isNotNull(), "fallback_longest").otherwise("none")
    chosen = F.coalesce("exact_id", "stitched_id", F.when(by_box, F.coalesce("roi_id", "longest_id")))
    return rows.select("match_id", method.alias("method"), chosen.alias("track_id"))


# --- keepers, coverage, sample times ----------------------------------------------------------------------------


def keeper_like(samples: DataFrame, near_line: Column, window_us: int, least: float = 0.6) -> DataFrame:
    """``samples`` (match_id, track_id, us, ...) with keeper_share, the share of the track's samples within the window
    that are near the goal line, and keeper_like."""
    w = Window.partitionBy("match_id", "track_id").orderBy("us").rangeBetween(-window_us, window_us)
    rows = samples.withColumn("keeper_share", F.avg(near_line.cast("double")).over(w))
    return rows.withColumn("keeper_like", F.col("keeper_share") >= least)


def keepers_by_zone(samples: DataFrame, zone: float = 0.18, least: float = 0.8, fewest: int = 10, apart: float = 0.05) -> DataFrame:
    """(match_id, track_id, team): tracks of no team (2) that live in one goal area join the team that defends it.

    The field's ends are the 1st and 99th percentile of all places; a team defends the end nearer to its median.
    Matches whose medians are closer than ``apart`` of the field have no rows. ``samples``: (match_id, track_id, team, x).
    """
    ends = samples.groupBy("match_id").agg(
        F.percentile("x", F.lit(0.01)).alias("lo"), F.percentile("x", F.lit(0.99)).alias("hi"), *[F.median(F.when(F.col("team") == k, F.col("x"))).alias(f"m{k}") for k in (0, 1)])
    span = F.greatest(F.lit(1.0), F.col("hi") - F.col("lo"))
    ends = ends.withColumn("span", span).where(F.abs(F.col("m0") - F.col("m1")) >= apart * F.col("span"))
    loose = samples.where("team = 2").join(ends, "match_id").groupBy("match_id", "track_id", "m0", "m1").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("x") <= F.col("lo") + zone * F.col("span")).cast("double")).alias("left"),
        F.avg((F.col("x") >= F.col("hi") - zone * F.col("span")).cast("double")).alias("right"))
    left_team = F.when(F.col("m0") < F.col("m1"), 0).otherwise(1)
    team = F.when(F.col("left") >= least, left_team).when(F.col("right") >= least, 1 - left_team)
    return loose.where(F.col("n") >= fewest).select("match_id", "track_id", team.alias("team")).where("team IS NOT NULL")


def coverage(samples: DataFrame, windows: DataFrame, keys: Sequence[str], step: float, max_gap: float, tolerance: float) -> DataFrame:
    """(keys, coverage): share of the steps from start to end at which the ball is seen.

    It is seen at a time when the samples around it are at most ``max_gap`` apart, or the nearer one is within
    ``tolerance``. ``windows`` is (keys, start, end); an empty window has 0.
    """
    n = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / step)).cast("int")
    grid = windows.where("end > start").withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1))).select(*keys, (F.col("start") + F.col("_i") * step).alias("_t"), F.lit(1).alias("_asked"))
    both = grid.unionByName(samples.select(*keys, F.col("t").alias("_t"), F.lit(0).alias("_asked")))
    seen = F.when(F.col("_asked") == 0, F.col("_t"))
    w = Window.partitionBy(*keys).orderBy("_t")  # its range frames take all rows of one time
    before = F.max(seen).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(seen).over(Window.partitionBy(*keys).orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = both.withColumn("_before", before).withColumn("_after", after).where("_asked = 1")
    near = F.least(F.col("_t") - F.col("_before"), F.col("_after") - F.col("_t"))
    visible = F.coalesce(F.col("_after") - F.col("_before") <= max_gap, F.lit(False)) | F.coalesce(near <= tolerance, F.lit(False))
    shares = rows.groupBy(*keys).agg(F.avg(visible.cast("double")).alias("coverage"))
    return windows.select(*keys).join(shares, list(keys), "left").fillna(0.0, ["coverage"])


def sample_times(samples: DataFrame, hz: float, most: int, extra: int, tolerance: float, fewest: int = 2) -> DataFrame:
    """(match_id, t, extra): times at which to look at a match, so that every track is seen ``fewest`` times if possible.

    The first are the centres of equal bins over all tracks; then, longest track first, tracks seen too rarely get
    times spread over their own samples, up to ``extra`` in a match. One match is one task.
    """

    def run(match: pd.DataFrame) -> pd.DataFrame:
        tracks = [g["t"].sort_values().to_numpy(float) for _, g in match.groupby("track_id")]
        start, end = match["t"].min(), match["t"].max()
        n = int(np.clip(np.ceil((end - start) * hz), 1, max(1, most)))
        times = start + (np.arange(n) + 0.5) * (end - start) / n
        added: list[float] = []

        def seen(track: np.ndarray) -> int:
            at = np.concatenate([times, added])
            right = np.clip(np.searchsorted(track, at), 0, len(track) - 1)
            return int((np.minimum(abs(track[right] - at), abs(track[np.maximum(right - 1, 0)] - at)) <= tolerance).sum())

        for track in sorted((t for t in tracks if seen(t) < fewest), key=lambda t: t[0] - t[-1]):
            missing = max(0, min(fewest - seen(track), extra - len(added)))
            shares = np.linspace(0, 1, fewest - seen(track) + 2)[1:-1][:missing] if missing else []
            added += [float(track[round(s * (len(track) - 1))]) for s in shares]
        at = np.unique(np.concatenate([times, added]))
        return pd.DataFrame({"match_id": match["match_id"].iloc[0], "t": at, "extra": ~np.isin(at, times)})

    kind = dict(samples.dtypes)["match_id"]
    return samples.select("match_id", "track_id", "t").groupBy("match_id").applyInPandas(run, f"match_id {kind}, t double, extra boolean")


def match_summary(samples: DataFrame, ball: DataFrame) -> DataFrame:
    """(match_id, tracks, samples, ball_detections, duration_s, longest_track_id) of a match's tracks."""
    spans = track_spans(samples)
    counted = spans.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("tracks"), F.sum("n").alias("samples"), F.round(F.max("last_t") - F.min("first_t"), 3).alias("duration_s"))
    seen = ball.groupBy("match_id").agg(F.count(F.lit(1)).alias("ball_detections"))
    longest = longest_tracks(spans).withColumnRenamed("track_id", "longest_track_id")
    return counted.join(longest, "match_id").join(seen, "match_id", "left").fillna(0, ["ball_detections"])
