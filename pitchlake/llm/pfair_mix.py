"""Mixing sources to target weights by Pfair scheduling.

Documents are numbered within their source and cut into blocks of ``block`` documents; every slot of the
mixture holds one block. A source of weight w should have f(t) = w t blocks after t slots. Block k is
released at the slot floor(f^-1(k)) and due by ceil(f^-1(k + 1)); among the released blocks the earliest
deadline goes first, so at every slot a source is less than one block ahead of or behind f. When a source
has no blocks left, f goes on with the weights of the others scaled up: nothing is dropped or repeated.

The slots are cut into frames. At a frame's ends the counts are f rounded to whole blocks (largest
remainders), which keeps every frame feasible by itself: frames are scheduled in parallel.

The driver sees one row per source (weights are given per source, so there are few; more than ``MOST_SOURCES`` are
an error); documents and blocks stay in Spark. Numbering uses sub-buckets of a source, which grow in number and in
rows with the square root of the source, so that a source with a third of all rows is no hot key.

Defined results: a null source is a source of its own; a source without a given weight gets the mean of the
given ones (1 if none); weights of zero or less are an error; repeated rows are mixed each; null texts are
kept; empty tables give no rows; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAME = 4096
MOST_SOURCES = 4096
EPS = 1e-9


def fluid(blocks: dict, weights: dict) -> tuple[np.ndarray, dict]:
    """Times at which a source runs out, and how many blocks each source should have by then."""
    left, done = {s: float(n) for s, n in blocks.items() if n}, {s: 0.0 for s in blocks}
    times, counts, now = [0.0], {s: [0.0] for s in blocks}, 0.0
    while left:
        total = sum(weights[s] for s in left)
        last = min(left, key=lambda s: (left[s] / weights[s], str(s)))
        span = left[last] * total / weights[last]
        for s in list(left):
            step = left[s] if s == last else min(left[s], span * weights[s] / total)
            done[s] += step
            left[s] -= step
            if left[s] <= EPS:
                done[s] = float(blocks[s])
                del left[s]
        now += span
        times.append(now)
        for s in blocks:
            counts[s].append(done[s])
    return np.array(times), {s: np.array(c) for s, c in counts.items()}


def inverse(times: np.ndarray, counts: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The first time at which the source should have k blocks."""
    i = np.clip(np.searchsorted(counts, k, "left"), 1, len(counts) - 1)
    a, b = counts[i - 1], counts[i]
    return times[i - 1] + np.where(b > a, (k - a) / np.where(b > a, b - a, 1), 0) * (times[i] - times[i - 1])


def whole_counts(t: int, times: np.ndarray, counts: dict, blocks: dict) -> dict:
    """f(t) rounded up or down so that the counts sum to t."""
    f = {s: float(np.interp(t, times, c)) for s, c in counts.items()}
    low = {s: min(int(np.floor(x + EPS)), blocks[s]) for s, x in f.items()}
    order = sorted(f, key=lambda s: (-(f[s] - low[s]), str(s)))
    for s in order[:t - sum(low.values())]:
        low[s] += 1
    return low


def schedule_frame(start: int, end: int, times: np.ndarray, counts: dict, blocks: dict) -> list[tuple]:
    """(source, block, slot) of the slots from start to end: earliest deadline first among the released."""
    before, after = (whole_counts(t, times, counts, blocks) for t in (start, end))
    releases: list[list] = [[] for _ in range(end - start)]
    for s in blocks:
        k = np.arange(before[s], after[s])
        if len(k):
            release = np.floor(inverse(times, counts[s], k) + EPS).astype(int)
            due = np.ceil(inverse(times, counts[s], k + 1) - EPS).astype(int)
            for b, r, d in zip(k.tolist(), release.tolist(), due.tolist()):
                releases[min(max(r, start), end - 1) - start].append((min(d, end), str(s), b, s))
    ready: list[tuple] = []
    out = []
    for slot in range(start, end):
        for x in releases[slot - start]:
            heapq.heappush(ready, x)
        _, _, b, s = heapq.heappop(ready)
        out.append((s, b, slot))
    return out


def mixed_positions(docs: DataFrame, weights: dict | None = None, block: int = 64, id_col: str = "doc_id", source_col: str = "source", tie: Column | None = None) -> DataFrame:
    """(row, source_n, block, slot, position): each row of ``docs``, as a struct, and where it stands in the mixture.

    ``tie`` orders rows of one id, so that a task that is run again places them alike, and spreads null ids.
    """
    spark = docs.sparkSession
    weights = dict(weights or {})
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    default = float(np.mean(list(weights.values()))) if weights else 1.0
    sizes = {r[0]: r[1] for r in docs.groupBy(F.col(source_col)).agg(F.count(F.lit(1))).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    names = sorted(sizes, key=lambda s: (s is not None, s))
    number = {s: i for i, s in enumerate(names)}
    blocks = {number[s]: -(-n // block) for s, n in sizes.items()}
    by_number = {number[s]: float(weights.get(s, default)) for s in sizes}
    times, counts = fluid(blocks, by_number)
    total = sum(blocks.values())
    most = max(sizes.values(), default=0)
    n_buckets = most // max(512, 4 * math.isqrt(most)) + 1

    # one row a source, MOST_SOURCES at most, so it may be broadcast
    table = spark.createDataFrame([(s, number[s]) for s in names], f"name {docs.schema[source_col].dataType.simpleString()}, source_n int")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), (F.lit(0) if tie is None else tie).alias("tie"), F.col(source_col).alias("source"))
    rows = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).select("row", "id", "tie", "source_n", F.pmod(F.when(F.col("id").isNull(), F.xxhash64("tie")).otherwise(F.xxhash64("id")), F.lit(n_buckets)).alias("bucket"))
    bucket = rows.groupBy("source_n", "bucket").count()
    so_far = Window.partitionBy("source_n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucket.select("source_n", "bucket", F.coalesce(F.sum("count").over(so_far), F.lit(0)).alias("start"))
    within = Window.partitionBy("source_n", "bucket").orderBy(F.xxhash64("id"), "id", "tie")
    numbered = rows.join(starts, ["source_n", "bucket"]).withColumn("place", F.col("start") + F.row_number().over(within) - 1)
    numbered = numbered.select("row", "source_n", "place", F.floor(F.col("place") / block).alias("block"))

    def frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for f in part["id"]:
                yield pd.DataFrame(schedule_frame(f * FRAME, min((f + 1) * FRAME, total), times, counts, blocks), columns=["source_n", "block", "slot"])

    slots = spark.range(-(-total // FRAME)).mapInPandas(frames, "source_n int, block long, slot long")
    return numbered.join(slots, ["source_n", "block"]).select("row", "source_n", "block", "slot", (F.col("slot") * block + F.col("place") % block).alias("position"))


def mix_plan(docs: DataFrame, weights: dict | None = None, block: int = 64) -> DataFrame:
    """(doc_id, source, block, slot, position) of every row."""
    placed = mixed_positions(docs.select("doc_id", "source"), weights, block)
    return placed.select("row.doc_id", "row.source", "block", "slot", "position")


def mix_sources(docs: DataFrame, weights: dict | None = None, block: int = 64) -> DataFrame:
    """All rows and columns of ``docs``, laid out in the order of the mixture."""
    placed = mixed_positions(docs, weights, block, tie=F.xxhash64("text") if "text" in docs.columns else None).select("row", "position")
    return placed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")
