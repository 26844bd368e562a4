"""Exact duplicate removal with a heavy-hitter split.

Digests of the normalised texts are written once. A frequent-items sketch (``approx_top_k``, a
mergeable Misra-Gries summary that is combined on the map side) names at most ``heavy`` candidate
digests. Their exact sizes and winners are computed over all rows and broadcast (at most ``heavy``
rows), so that rows of frequent digests never move. All other digests are rarer than the sketch's
error bound and use an ordinary shuffle.

Defined results: null texts count as empty; of equal texts the smallest id stays; rows that share
that id (repeated rows) all stay; a null id is smaller than any other; an empty table gives no rows;
other columns of the input are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import materialise
from pitchlake.llm.repeats import NO_ID


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1024) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    ``heavy`` bounds the broadcast table of winners; it changes the route of a row, never its result.
    """
    rows = materialise(docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256")), "digests")
    candidates = (
        rows.agg(F.expr(f"approx_top_k(text_sha256, {heavy}, {heavy * 16})").alias("top"))
        .select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("text_sha256"))
    )
    group = (F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = rows.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(*group)
    winners = materialise(winners.limit(heavy), "winners")  # as many as candidates: the limit states the bound, it cuts nothing
    frequent = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    ordinary = rest.join(rest.groupBy("text_sha256").agg(*group), "text_sha256")
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return frequent.unionByName(ordinary).select(
        real("doc_id"), real("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; a row stays by its id and its text, since ids may repeat."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha256"))
    own = F.sha2(normalised(docs["text"]), 256)
    return docs.join(kept, (own == kept["kept_sha256"]) & docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
