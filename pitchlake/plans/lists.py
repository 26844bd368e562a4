"""The list queries and client views of the catalog, over the driver's tables, each with its SQL.

A list of one match, job or tenant is bound to every one of them at once: the page is taken for each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.operators import control
from pitchlake.plans.registry import query
from pitchlake.plans.tables import table

#: name: (table, where, keys, order, limit, columns); the same text serves Spark and DuckDB.
LISTS = {
    "feedback_list": ("lineitem", "l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 10", "l_suppkey", "l_shipdate DESC, l_orderkey, l_linenumber", 20, "l_suppkey, l_orderkey, l_linenumber"),
    "match_job_list": ("orders", "o_orderstatus = 'O'", "o_custkey", "o_orderdate DESC, o_orderkey", 5, "o_custkey, o_orderkey"),
    "job_log_list": ("lineitem", "l_returnflag = 'N' AND l_tax >= 0.02", "l_orderkey", "l_shipdate DESC, l_linenumber", 3, "l_orderkey, l_linenumber"),
    "job_bookmark_list": ("events", "event_type <> 'view'", "user_id", "ts, event_id", 10, "user_id, event_id"),
    "notification_list": ("events", "event_type = 'error'", "user_id", "ts DESC, event_id", 5, "user_id, event_id"),
    "match_list": ("customer", "c_mktsegment IS NOT NULL", "c_nationkey", "c_acctbal DESC, c_custkey", 10, "c_nationkey, c_custkey"),
    "roster_list": ("part", "p_size > 0", "p_brand", "p_type, length(CAST(p_size AS STRING)), CAST(p_size AS STRING), p_partkey", 1000000, "p_brand, p_partkey"),
    "model_version_list": ("part", "p_retailprice >= 1000", "p_type", "p_retailprice DESC, p_partkey", 3, "p_type, p_partkey"),
    "tenant_list": ("region", "r_name IS NOT NULL", "r_regionkey", "r_name", 1, "r_regionkey, r_name"),
    "user_list": ("supplier", "s_acctbal >= 0", "s_nationkey", "s_name, s_suppkey", 1000000, "s_nationkey, s_suppkey"),
    "membership_list": ("customer", "c_acctbal > 0", "c_mktsegment", "c_custkey DESC", 25, "c_mktsegment, c_custkey"),
    "tenant_match_list": ("customer", "c_acctbal >= 1000", "c_nationkey", "c_custkey DESC", 8, "c_nationkey, c_custkey"),
    "share_list": ("orders", "o_orderpriority = '1-URGENT'", "o_custkey", "o_orderdate DESC, o_orderkey", 1000000, "o_custkey, o_orderkey"),
}


def _ordering(text: str) -> list[Column]:
    parts = text.replace("(CAST(p_size AS STRING))", "(#)").split(", ")
    column = lambda p: F.expr(p.replace("(#)", "(CAST(p_size AS STRING))").removesuffix(" DESC"))
    return [column(p).desc() if p.endswith(" DESC") else column(p) for p in parts]


def _list(name: str, source: str, where: str, key: str, order: str, limit: int, columns: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = control.page_per(table(spark, sf_dir, source).where(where), [key], _ordering(order), limit)
        return rows.select(*columns.split(", "), "place", "has_more")

    run.__name__ = name
    return query(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order.replace('STRING', 'VARCHAR')}) AS place, count(*) OVER (PARTITION BY {key}) AS n FROM {source} WHERE {where})
SELECT {columns}, place, n > {limit} AS has_more FROM n WHERE place <= {limit}
""")(run)


for _name, _spec in LISTS.items():
    _list(_name, *_spec)


@query("""
SELECT c.c_custkey, c.c_name, n.n_name, greatest(c.c_acctbal, CAST(n.n_regionkey AS DOUBLE)) AS updated FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE c.c_mktsegment = 'BUILDING'
""")
def tenant_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with their accounts; the later of the two changes counts."""
    members = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("user_id"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("updated_at"))
    users = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("user_id"), "n_name", F.col("n_regionkey").cast("double").alias("user_updated_at"))
    return control.members_with_users(members, users, "BUILDING").select("c_custkey", "c_name", "n_name", F.col("updated").alias("updated"))


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, count(*) AS n_logs, count(*) FILTER (event_type = 'error') AS n_errors, arg_max(event_id, (ts, event_id)) AS last_log, max(CASE WHEN event_type = 'error' THEN event_id END) AS last_error FROM l WHERE n <= 20 GROUP BY 1
""")
def job_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of each job's latest logs."""
    logs = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.col("event_type").alias("level"), "ts")
    rows = control.diagnostics(logs, "ts", "event_id", 20)
    return rows.withColumnRenamed("job_id", "user_id")


@query("""
WITH e AS (SELECT user_id // 50 AS match_id, user_id % 2 AS team, event_type, value FROM events),
 s AS (SELECT match_id, team, count(*) FILTER (event_type = 'click') AS counted, max(CASE WHEN event_type = 'purchase' AND value > 90 THEN value END) AS shots, sum(value) FILTER (event_type = 'view') AS distance_m, avg(value) FILTER (event_type = 'error') AS avg_speed_mps FROM e GROUP BY ALL)
SELECT match_id, team, metric, round(v, 4) AS value FROM (SELECT match_id, team, unnest(['shots', 'distance', 'avg_speed']) AS metric, unnest([coalesce(shots, CAST(counted AS DOUBLE)), distance_m / 1000, avg_speed_mps * 3.6]) AS v FROM s)
""")
def team_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison metrics in the units shown, with event counts where a statistic is missing."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 50).alias("match_id"), (F.col("user_id") % 2).alias("team"), "event_type", "value")
    of = lambda kind, c="value": F.when(F.col("event_type") == kind, F.col(c))
    known = e.groupBy("match_id", "team").agg(
        F.count(of("click")).alias("shot_events"), F.max(F.when(F.col("value") > 90, of("purchase"))).alias("shots"), F.sum(of("view")).alias("distance_m"), F.avg(of("error")).alias("avg_speed_mps"))
    return control.shown_metrics(known, ["match_id", "team"]).withColumn("value", F.round("value", 4))


@query("""
SELECT event_id, event_type, greatest(-52.5, least(52.5, value * 1.2 - 60)) AS x, greatest(-34.0, least(34.0, CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50)) AS y FROM events WHERE event_type IN ('purchase', 'error')
""")
def shot_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("value") * 1.2 - 60).alias("x"), (F.get_json_object("props", "$.k").cast("double") - 50).alias("y"))
    return control.shots_on_pitch(e, "event_type", ("purchase", "error"))


@query("""
WITH p AS (SELECT user_id, user_id % 2 AS team, sum(CASE WHEN event_type = 'purchase' THEN value END) AS distance FROM events GROUP BY 1)
SELECT user_id, team, distance, row_number() OVER (PARTITION BY team ORDER BY coalesce(distance, -1e9) DESC, user_id) AS place, greatest(1.0, max(coalesce(distance, 0)) OVER ()) AS scale FROM p
""")
def player_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players of each team by a column, those without it last, and the scale of the bars."""
    # summed in the order of events: equal series have equal sums, and others don't change places with the order of partial sums
    bought = F.sort_array(F.collect_list(F.when((F.col("event_type") == "purchase") & F.col("value").isNotNull(), F.struct("event_id", "value"))))
    total = F.when(F.size("bought") > 0, F.aggregate("bought", F.lit(0.0), lambda a, r: a + r["value"]))
    p = table(spark, sf_dir, "events").groupBy("user_id", (F.col("user_id") % 2).alias("team")).agg(bought.alias("bought")).select("user_id", "team", total.alias("distance"))
    return control.sorted_players(p, "distance", "user_id")


@query("""
SELECT user_id, list_sort(list(DISTINCT event_type)) [1] AS first_type, count(DISTINCT event_type) AS n_types, count(DISTINCT date_trunc('day', ts)) AS n_days FROM events GROUP BY 1
""")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the filters of an event list offer."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.date_trunc("day", "ts").alias("day"))
    found = control.offered(e, ["user_id"], ["event_type", "day"])
    return found.select("user_id", F.element_at("event_type", 1).alias("first_type"), F.size("event_type").cast("long").alias("n_types"), F.size("day").cast("long").alias("n_days"))


@query("""
SELECT doc_id, flag, level FROM (SELECT doc_id, unnest(['calibration', 'teams', 'ball']) AS flag, unnest([CASE WHEN n_chars % 5 = 0 THEN 'danger' WHEN (n_chars % 100) / 100.0 >= 0.75 THEN 'ok' WHEN (n_chars % 100) / 100.0 >= 0.45 THEN 'warn' ELSE 'danger' END,
 CASE WHEN n_chars % 101 >= 85 THEN 'ok' WHEN n_chars % 101 >= 60 THEN 'warn' ELSE 'danger' END, CASE WHEN n_chars % 97 >= 70 THEN 'ok' WHEN n_chars % 97 >= 45 THEN 'warn' ELSE 'danger' END]) AS level FROM documents)
""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(n % 5 != 0, (n % 100) / 100.0).alias("calibration"), (n % 101).alias("teams"), (n % 97).alias("ball"))
    return control.quality_levels(d, ["doc_id"])


@query()
def auto_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A greedy reel of each user's events; its fold is held against a plain loop in the tests."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("match_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("excitement"), (F.col("event_id") % 17 + 3.0).alias("length"))
    return control.auto_picked(e, 60.0)
