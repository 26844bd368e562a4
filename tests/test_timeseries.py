import numpy as np
from pyspark.sql import functions as F

from pitchlake.operators import timeseries as ts


def test_asof_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 2.0)], "k string, t double")
    right = spark.createDataFrame([("a", 1.0, "x"), ("a", 4.0, "y"), ("b", 3.0, "z")], "k string, u double, s string")
    got = {(r["k"], r["t"]): r["s"] for r in ts.asof_backward(left, right, ["k"], "t", "u").select("k", "t", "asof.s").collect()}
    assert got == {("a", 1.0): "x", ("a", 5.0): "y", ("b", 2.0): None}
    first = ts.asof_backward(left, right, ["k"], "t", "u", fall_back_to_first=True).where("k = 'b'").select("asof.s").first()[0]
    assert first == "z"


def test_nearest_prefers_the_earlier_of_two(spark):
    left = spark.createDataFrame([("a", 2.0), ("a", 9.0)], "k string, t double")
    right = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, u double")
    got = {r["t"]: r["u"] for r in ts.asof_nearest(left, right, ["k"], "t", "u", 1.5).select("t", "asof.u").collect()}
    assert got == {2.0: 1.0, 9.0: None}


def test_grid_interpolates_and_respects_gaps(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 10.0), ("a", 9.0, 90.0)], "k string, t double, x double")
    got = {r["g"]: r["x"] for r in ts.resample_grid(rows, ["k"], "t", ["x"], 0.5, 2.0, 0.1).collect()}
    assert got[1] == 5.0 and got[2] == 10.0 and got[8] is None and got[18] == 90.0 and len(got) == 19


def test_chain_and_running_end_differ(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 1, 2), ("a", 9, 12), ("a", 20, 21)], "k string, s int, e int")
    merged = sorted((r["s"], r["e"], r["n_merged"]) for r in ts.merge_intervals(rows, ["k"], "s", "e").collect())
    assert merged == [(0, 12, 3), (20, 21, 1)]
    islands = [r["island"] for r in ts.islands_by_gap(rows, ["k"], "s", 3).orderBy("s").collect()]
    assert islands == [1, 1, 2, 3]


def test_debounce_compares_with_the_last_kept(spark):
    rows = spark.createDataFrame([("a", t) for t in (0.0, 0.3, 0.5, 1.5)], "k string, t double")
    assert [r["t"] for r in ts.debounce(rows, ["k"], "t", 0.4).orderBy("t").collect()] == [0.0, 0.5, 1.5]


def test_range_join_has_no_nested_loop(spark):
    points = spark.range(100).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("t"))
    spans = spark.createDataFrame([("a", 10.0, 20.0, 1), ("a", 15.0, 40.0, 2)], "k string, s double, e double, n int")
    joined = ts.range_join(points, spans, ["k"], "t", "s", "e", 10.0)
    assert joined.groupBy("n").count().orderBy("n").collect() == [(1, 10), (2, 25)]
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


def test_folds(spark):
    row = spark.range(1).select(ts.ema(F.array(F.lit(1.0), F.lit(0.0)), 0.4).alias("e"), ts.slew(F.array(F.lit(0.0), F.lit(5.0), F.lit(1.0)), 2.0).alias("s")).first()
    np.testing.assert_allclose(row["e"], [0.4, 0.24])
    assert row["s"] == [0.0, 2.0, 1.0]


def test_envelope_is_the_largest_slow_curve_below(spark):
    values = [5.0, 0.0, 7.0, 7.0, 1.0]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    got = [r["envelope"] for r in ts.lipschitz_below(rows, ["k"], "i", "v", 2.0).orderBy("i").collect()]
    assert got == [min(v + 2.0 * abs(i - j) for j, v in enumerate(values)) for i in range(5)]
