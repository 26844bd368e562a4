"""Readers and row builders: Parquet, JSON documents, CSV rosters, JDBC, and lenient reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pitchlake.sources import schemas

#: Header names that a roster file may use.
ROSTER_ALIASES = {
    "player_name": ("player_name", "name", "player", "full_name"),
    "jersey_number": ("jersey_number", "jersey", "number", "shirt_number", "shirt", "kit_number"),
    "position": ("position", "pos", "field_position"), "email": ("email", "e_mail", "e-mail", "email_address"), "team_side": ("team_side", "side", "team"),
}


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Player samples joined to their track's metadata; floats are widened before any arithmetic."""
    players = spark.read.schema(schemas.PLAYERS).parquet(f"{path}/players")
    meta = spark.read.schema(schemas.TRACK_META).parquet(f"{path}/track_meta")
    wide = players.select("match_id", "track_id", "t", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "conf")])
    return wide.join(meta, ["match_id", "track_id"], "left").withColumn("team", F.coalesce("team", F.lit(-1)))


def track_rows(spark: SparkSession, match_id: str, track_id: int, rows: list[tuple]) -> DataFrame:
    """Samples of one track from (t, x1, y1, x2, y2[, conf]) rows; a missing confidence is 1."""
    if any(len(r) < 5 for r in rows):
        raise ValueError("a track row needs t, x1, y1, x2 and y2")
    full = [(match_id, track_id, *map(float, r[:5]), float(r[5]) if len(r) > 5 else 1.0) for r in rows]
    return spark.createDataFrame(full, schemas.PLAYERS.replace("float", "double")).orderBy("t")


def ball_rows(spark: SparkSession, match_id: str, rows: list[tuple]) -> DataFrame:
    """Ball rows (t, x, y[, w, h, conf]); missing sizes are 0, a missing confidence 1."""
    full = [(match_id, *map(float, r[:3]), *(float(v) for v in (*r[3:6], *(0.0, 0.0, 1.0)[len(r) - 3:]))) for r in rows]
    return spark.createDataFrame(full, schemas.BALL_RAW.replace("float", "double")).orderBy("t")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document by an explicit schema; a missing path is an empty table, broken rows are left out."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path, multiLine=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def first_document(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of several candidate paths that holds readable rows."""
    found = spark.createDataFrame([], schema)
    for path in paths:
        found = read_document(spark, path, schema)
        if not found.isEmpty():
            break
    return found


#: Files that mark a folder as a run. Fixed values.
RUN_FILES = ("analysis_bookmarks.json", "analysis_events.json", "tracks.npz", "progress.json")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, modified, n_bytes) of all files below a folder, by Spark's own listing and without their contents; a missing one is empty."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException:
        return spark.createDataFrame([], "folder string, name string, modified timestamp, n_bytes long")
    parts = F.split("path", "/")
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.element_at(parts, -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("n_bytes"))


def newest_runs(files: DataFrame, limit: int = 300) -> DataFrame:
    """(folder, modified) of the ``limit`` newest runs: folders that hold one of ``RUN_FILES``, by their latest file (ties by name)."""
    runs = files.groupBy("folder").agg(F.max("modified").alias("modified"), F.bool_or(F.col("name").isin(*RUN_FILES)).alias("is_run")).where("is_run")
    return runs.select("folder", "modified").orderBy(F.desc("modified"), "folder").limit(limit)


def thumbnails(files: DataFrame, interval_s: float = 10.0) -> DataFrame:
    """(folder, name, t) of the pictures in folders named thumbs: the time from the number that starts a name, else from its place by name."""
    rows = files.where(F.col("folder").endswith("/thumbs") & F.col("name").endswith(".jpg"))
    place = F.row_number().over(Window.partitionBy("folder").orderBy("name"))
    number = F.regexp_extract("name", r"^(\d+)", 1).try_cast("long")
    return rows.select("folder", "name", F.round(F.greatest(F.lit(0), F.coalesce(number, place) - 1) * interval_s, 2).alias("t"))


def nullable(rows: DataFrame, fields: dict[str, str], defaults: dict | None = None) -> DataFrame:
    """Loosely typed rows with a column for each field: values that are no such type are null, then the field's default; missing columns too."""
    known = {name: F.col(name).try_cast(kind) if name in rows.columns else F.lit(None).cast(kind) for name, kind in fields.items()}
    filled = {name: F.coalesce(c, F.lit(defaults[name]).cast(fields[name])) if defaults and name in defaults else c for name, c in known.items()}
    return rows.select(*[c.alias(name) for name, c in filled.items()])


def read_roster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a roster CSV with any known header names.

    A row needs a name and a number; of rows with one side and number the first counts, the others are rejected.
    Of several columns for one field the first counts.
    """
    raw = spark.read.csv(path, header=True)
    names = {c: c.strip().lower().replace(" ", "_") for c in raw.columns}
    known = {alias: target for target, aliases in ROSTER_ALIASES.items() for alias in aliases}
    chosen = {known[n]: c for c, n in reversed(names.items()) if n in known}
    rows = raw.select(*[F.col(f"`{c}`").alias(target) for target, c in chosen.items()])
    for missing in ROSTER_ALIASES.keys() - set(rows.columns):
        rows = rows.withColumn(missing, F.lit(None).cast("string"))
    rows = rows.select(*[F.trim(F.col(c)).alias(c) for c in ROSTER_ALIASES]).withColumn("line", F.monotonically_increasing_id())
    valid = (F.coalesce("player_name", F.lit("")) != "") & (F.coalesce("jersey_number", F.lit("")) != "")
    firsts = rows.where(valid).groupBy("team_side", "jersey_number").agg(F.min("line").alias("line")).select("line")
    return rows.join(firsts, "line", "left_semi"), rows.join(firsts, "line", "left_anti").withColumn("reason", F.when(valid, "duplicate").otherwise("missing"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    """A relational table, read in ranges of a numeric column when bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()
