"""Working tables: what several steps of one job share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: While a working table is written, joins on more than the key that rows are dealt by leave them where they are, and
#: shuffles are deleted when it is done, not when the driver happens to collect its garbage.
WRITING = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def setting(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def kept(df: DataFrame, by: str | None = None, tasks: int = 1) -> DataFrame:
    """``df`` computed once, written as Parquet to the folder of ``spark.checkpoint.dir`` and read back.

    So lost executors lose nothing, plans stay short, and the planner knows the table's true size: after explodes and
    Python it takes a large table for a small one otherwise and broadcasts it through the driver. A single-process local
    session may leave the folder unset and gets a temporary one.

    With ``by`` the rows are put in ``tasks`` buckets by that column, so that windows, groups and joins by it (and more)
    find them dealt and shuffle nothing. Each task writes the buckets of its rows: one, if they are dealt so already. The
    table leaves the catalog at once, its files stay.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and (not sc.master.startswith("local") or "cluster" in sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="pitchlake-"))
    path = f"{sc.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    with setting(spark, WRITING):
        if by is None:
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        name = f"spark_catalog.default.kept_{uuid.uuid4().hex}"
        df.write.format("parquet").option("compression", "zstd").bucketBy(tasks, by).option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table
