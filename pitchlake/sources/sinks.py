"""Writers: partitioned Parquet, JSON and JSON lines, CSV, appends and partition replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.operators import timeseries as ts


def write_tracks(df: DataFrame, path: str) -> None:
    """One folder per match, samples in order of track and time."""
    df.repartition("match_id").sortWithinPartitions("match_id", "track_id", "t").write.partitionBy("match_id").mode("overwrite").parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_lines(df: DataFrame, path: str, order: str | None = None) -> None:
    rows = df.orderBy(order) if order else df
    rows.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_bookmarks_csv(df: DataFrame, path: str) -> None:
    """Arrays become comma-joined text."""
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in arrays}).write.mode("overwrite").csv(path, header=True)


def command_lines(df: DataFrame, keys: list[str], order: str, values: list[str], line: Column) -> DataFrame:
    """A text line for each row whose values differ from the row before."""
    return ts.change_capture(df, keys, order, values).select(*keys, order, line.alias("value"))


def append_logs(df: DataFrame, path: str, least: str = "normal") -> None:
    """Log rows at or above a level of detail."""
    rank = F.create_map(F.lit("minimal"), F.lit(0), F.lit("normal"), F.lit(1), F.lit("detailed"), F.lit(2))
    df.where(F.coalesce(F.try_element_at(rank, F.col("detail_level")), F.lit(1)) <= F.element_at(rank, F.lit(least))).write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Delete-then-insert of the partitions that ``df`` holds."""
    df.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
