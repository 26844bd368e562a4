"""Structured Streaming forms of the batch operators: the sources are folders of files, lateness is bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitchlake.operators.tracker import Settings, Tracker
from pitchlake.operators.tracking import BOX, track_frames
from pitchlake.sources import schemas

#: The longest look-ahead of a batch operator; a live result is final after it.
LOOK_AHEAD = "60 seconds"


def read_samples(spark: SparkSession, path: str, schema: str = schemas.PLAYERS, files: int = 8, stride: int = 1) -> DataFrame:
    """Player samples as they arrive, a bounded number of files a batch; ``stride`` keeps every n-th 25th of a second."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.where(F.rint(F.col("t") * 25) % stride == 0).withColumn("ts", F.timestamp_seconds("t"))


def tumbling(rows: DataFrame, keys: list[str], every: str, value: str, late: str = LOOK_AHEAD) -> DataFrame:
    """Count and mean of each window, once the watermark has passed it."""
    return rows.withWatermark("ts", late).groupBy(*keys, F.window("ts", every)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(*keys, F.col("window.start").alias("start"), "n", "mean")


def sessions(rows: DataFrame, keys: list[str], gap: str, late: str = LOOK_AHEAD) -> DataFrame:
    """Chains of rows with no longer gap than ``gap``: the streaming form of islands."""
    return rows.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(rows: DataFrame, key: str, late: str = LOOK_AHEAD) -> DataFrame:
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def live_ball(rows: DataFrame, limit: float, gate: float, alpha: float = 0.5, beta: float = 0.3) -> DataFrame:
    """(match_id, t, x, y): a constant-velocity filter whose state outlives the batches; far detections are dropped until a second of silence."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, x, y, vx, vy = state.get if state.exists else (None, 0.0, 0.0, 0.0, 0.0)
        for part in parts:
            out = []
            for t, mx, my in part.sort_values("t")[["t", "x", "y"]].itertuples(index=False):
                if last is not None and t <= last:
                    continue
                dt = t - last if last is not None else 0.0
                px, py = x + vx * min(dt, 0.5), y + vy * min(dt, 0.5)
                near = ((mx - px) ** 2 + (my - py) ** 2) ** 0.5 <= gate + limit * dt
                if last is None or dt > 1.0:
                    x, y, vx, vy = mx, my, 0.0, 0.0
                elif near:
                    x, y = px + alpha * (mx - px), py + alpha * (my - py)
                    vx, vy = vx + beta * (mx - px) / dt, vy + beta * (my - py) / dt
                else:
                    continue
                last = t
                out.append((key[0], t, x, y))
            if last is not None:
                state.update((float(last), float(x), float(y), float(vx), float(vy)))
            yield pd.DataFrame(out, columns=["match_id", "t", "x", "y"])

    kind = dict(rows.dtypes)["match_id"]
    return rows.groupBy("match_id").applyInPandasWithState(run, f"match_id {kind}, t double, x double, y double", "last double, x double, y double, vx double, vy double", "append", GroupStateTimeout.NoTimeout)


def live_tracks(rows: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(match_id, frame, det, track_id): ``tracking.track`` as frames arrive, its tracks kept as state between batches.

    A match's frames must come in order and a frame whole, as a file of frames does; frames at or before the last one are
    dropped as late. The state is the packed tracker, bounded by the tracks alive. After a restart from the checkpoint the
    tracks go on as in the batch form.
    """
    settings = settings or Settings()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker.unpack(bytes(state.get[0])) if state.exists else Tracker(settings)
        whole = pd.concat(list(parts))
        if tracker.last is not None:
            whole = whole[whole["frame"] > tracker.last]
        found = pd.DataFrame(track_frames(tracker, whole), columns=["frame", "det", "track_id"])
        state.update((tracker.pack(),))
        yield found.assign(match_id=key[0])[["match_id", "frame", "det", "track_id"]]

    kind = dict(rows.dtypes)
    looks = ["look"] if "look" in kind else []
    schema = f"match_id {kind['match_id']}, frame {kind['frame']}, det {kind['det']}, track_id int"
    return rows.select("match_id", "frame", "det", *BOX, "conf", *looks).groupBy("match_id").applyInPandasWithState(run, schema, "tracker binary", "append", GroupStateTimeout.NoTimeout)


def write_once(rows: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """All that is there now, then stop; a restart goes on from the checkpoint."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def upsert_batches(rows: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Each micro-batch is merged into a table that is partitioned by the first key: the latest row of every key wins.

    Only the partitions that a batch touches are read and written again; their other rows stay. A batch that is
    run again after a failure gives the same table.
    """

    def replace(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        changed = batch
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            stored = spark.read.schema(batch.schema).parquet(path)
            changed = batch.unionByName(stored.join(batch.select(keys[0]).distinct(), keys[0], "left_semi").select(batch.columns))
        latest = changed.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), "ts").alias("r")).select("r.*")
        # what is read is about to be replaced, so the new rows are written beside it first
        latest.write.mode("overwrite").parquet(f"{path}.merging")
        merged = spark.read.schema(batch.schema).parquet(f"{path}.merging")
        merged.write.partitionBy(keys[0]).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    return rows.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
