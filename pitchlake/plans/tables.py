
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track samples: (event_id, track, us, t, x, y, state)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("track"), micros("ts").alias("us"), (micros("ts") / 1e6).alias("t"),
        F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("int").alias("y"), F.col("event_type").alias("state"),
    )


#: The same rows in DuckDB.
TRACKS_SQL = """tracks AS (SELECT event_id, user_id AS track, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t, value AS x,
    CAST(json_extract_string(props, '$.k') AS INT) AS y, event_type AS state FROM events)"""
