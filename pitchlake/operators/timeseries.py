"""Generic relational operators on time series: grids, as-of joins, islands, range joins, folds.

All are DataFrame to DataFrame and partition by ``keys`` (a match, or a match and a track); nothing crosses keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def asof_backward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, right_t: str, name: str = "asof", fall_back_to_first: bool = False, keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Each left row with a struct of the last right row at or before its time; null when there is none.

    One shuffle for both sides: they are put in one order and the last right row is carried forward. With
    ``fall_back_to_first`` a row before all right rows gets the first one. See ``asof_each`` for ``keep``.
    """
    return asof_each(left, {name: (right, right_t, fall_back_to_first)}, keys, t, keep)


def asof_each(left: DataFrame, rights: dict[str, tuple[DataFrame, str, bool]], keys: Sequence[str], t: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``asof_backward`` with several right sides, (rows, time, whether to fall back to the first) by the struct's name, in one order.

    ``keep`` is applied to all sides as one table in place of the shuffle; it may write them where their keys' rows meet.
    """
    payload = {name: F.struct(*right.columns) for name, (right, *_) in rights.items()}
    kinds = {"_left": left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType} | {f"_{name}": rights[name][0].select(s.alias("s")).schema["s"].dataType for name, s in payload.items()}
    filled = lambda own, s: [s.alias(c) if c == own else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]
    both = left.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), *filled("_left", F.struct(*left.columns)))
    for name, (right, right_t, _) in rights.items():
        both = both.unionByName(right.select(*keys, F.col(right_t).alias("_t"), F.lit(0).alias("_side"), *filled(f"_{name}", payload[name])))
    both = both.repartition(*keys) if keep is None else keep(both)
    order = Window.partitionBy(*keys).orderBy("_t", "_side")
    found = {}
    for name, (*_, fall_back_to_first) in rights.items():
        found[name] = F.last(f"_{name}", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        if fall_back_to_first:
            # before the first right row the first of the whole key; a frame from each row to the end would be quadratic
            found[name] = F.coalesce(found[name], F.first(f"_{name}", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    both = both.withColumns({f"_found_{name}": c for name, c in found.items()}).where("_side = 1")
    # keys as they are and not out of the struct, so that later steps know how the rows are dealt
    return both.select(*[F.col(c) if c in keys else F.col("_left")[c].alias(c) for c in left.columns], *[F.col(f"_found_{name}").alias(name) for name in found])


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, right_t: str, tolerance: float | None = None, name: str = "asof") -> DataFrame:
    """Each left row with the right row nearest in time within ``tolerance``; the earlier one wins ties."""
    kind = right.select(F.struct(*right.columns).alias("s")).schema["s"].dataType
    both = left.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(kind).alias("_right")).unionByName(
        right.select(*keys, F.col(right_t).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_left"), F.struct(*right.columns).alias("_right"))
    )
    order = Window.partitionBy(*keys).orderBy("_t", "_side")
    before = F.last("_right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_right", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("_before", before).withColumn("_after", after).where("_side = 1")
    gap_before, gap_after = F.col("_t") - F.col("_before")[right_t], F.col("_after")[right_t] - F.col("_t")
    best = F.when(gap_after < F.coalesce(gap_before, F.lit(float("inf"))), F.col("_after")).otherwise(F.coalesce("_before", "_after"))
    rows = rows.withColumn("_best", best)
    if tolerance is not None:
        rows = rows.withColumn("_best", F.when(F.abs(F.col("_best")[right_t] - F.col("_t")) <= tolerance, F.col("_best")))
    return rows.select("_left.*", F.col("_best").alias(name))


def resample_grid(samples: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], step: float, max_gap: float, tolerance: float) -> DataFrame:
    """(keys, g, grid_t, values, observed) on the regular grid g * step between each key's first and last sample.

    Every pair of neighbouring samples fills the grid points between them, so there is neither a join nor a
    driver loop: one window, then an explode. A grid point is observed when its neighbours are at most
    ``max_gap`` apart or one of them lies within ``tolerance``; other points are null.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    rows = samples.select(*keys, F.col(t).alias("_t"), *values, F.lead(t).over(w).alias("_next"), F.lag(t).over(w).alias("_prev"), *[F.lead(v).over(w).alias(f"_next_{v}") for v in values])
    first = F.ceil(F.col("_t") / step - 1e-9).cast("long")
    last = F.coalesce(F.ceil(F.col("_next") / step - 1e-9).cast("long") - 1, F.floor(F.col("_t") / step + 1e-9).cast("long"))
    rows = rows.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    rows = rows.withColumn("g", F.explode(F.sequence("_first", "_last"))).withColumn("grid_t", F.col("g") * step)
    span = F.col("_next") - F.col("_t")
    share = F.when(span > 0, (F.col("grid_t") - F.col("_t")) / span).otherwise(0.0)
    near = F.least(F.abs(F.col("grid_t") - F.col("_t")), F.coalesce(F.abs(F.col("_next") - F.col("grid_t")), F.lit(float("inf"))))
    observed = F.coalesce(span <= max_gap, F.lit(False)) | (near <= tolerance)
    lerp = [F.when(F.col("observed"), F.col(v) + F.coalesce((F.col(f"_next_{v}") - F.col(v)) * F.col("_share"), F.lit(0.0))).alias(v) for v in values]
    return rows.withColumn("observed", observed).withColumn("_share", share).select(*keys, "g", "grid_t", *lerp, "observed")


def islands_by_gap(df: DataFrame, keys: Sequence[str], t: str, gap, name: str = "island", tie: Sequence[str] = ()) -> DataFrame:
    """Numbers runs of rows in which each is within ``gap`` of the row before it (a chain, not a fixed window)."""
    w = Window.partitionBy(*keys).orderBy(t, *tie)
    new = F.when(F.col(t) - F.lag(t).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def islands_by_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows with one value (null equals null)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_value", value)
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col("_value").eqNullSafe(F.lag("_value").over(w))).cast("int"))
    return out.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_value")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, gap=0) -> DataFrame:
    """Union of intervals: one joins when it starts within ``gap`` of the furthest end so far (not of the row before)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(F.col(start) - reach <= gap, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged")).drop("_island")


def range_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, start: str, end: str, bucket, how: str = "inner", closed: bool = False, nulls: bool = True) -> DataFrame:
    """Points within [start, end) by an equi-join on time buckets and a residual test, never by a nested loop.

    Interval columns that clash with the points' must be renamed before. ``bucket`` should be near the usual
    length of an interval: each interval is repeated once for every bucket that it touches. A null key equals a null
    one; without ``nulls`` it equals none, and sides that are dealt by the keys already stay as they are.
    """
    last = F.col(end) if closed else F.greatest(F.col(start), F.col(end))
    spread = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket).cast("long"), F.floor(last / bucket).cast("long"))))
    spread = spread.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    placed = points.withColumn("_at", F.floor(F.col(t) / bucket).cast("long"))
    test = (F.col("_at") == F.col("_bucket")) & (F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end) if closed else F.col(t) < F.col(end))
    for k in keys:
        test &= F.col(k).eqNullSafe(F.col(f"_r_{k}")) if nulls else F.col(k) == F.col(f"_r_{k}")
    out = placed.join(spread, test, how)
    return out.drop("_at", "_bucket", *[f"_r_{k}" for k in keys])


def kept_by_debounce(times: Column, gap) -> Column:
    """Of a sorted array of times those that are at least ``gap`` after the last one kept: a fold, where lag() would be wrong."""
    return F.aggregate(times, F.array().cast("array<double>"), lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= gap), F.array_append(kept, x.cast("double"))).otherwise(kept))


def debounce(df: DataFrame, keys: Sequence[str], t: str, gap) -> DataFrame:
    """(keys, t): the times that stay.

    A time further than ``gap`` from the one before it always stays, so the fold starts anew there and its arrays
    hold one dense stretch, not a key's whole series.
    """
    dense = islands_by_gap(df.where(F.col(t).isNotNull()).select(*keys, F.col(t).cast("double").alias(t)), keys, t, gap, name="_stretch")
    folded = dense.groupBy(*keys, "_stretch").agg(F.sort_array(F.collect_list(t)).alias("_times"))
    return folded.select(*keys, F.explode(kept_by_debounce(F.col("_times"), gap)).alias(t))


def best_apart(df: DataFrame, keys: Sequence[str], t: str, score: str, gap) -> DataFrame:
    """The rows of ``df``, a few a key, of which none is within ``gap`` of another: a later one replaces the first kept one that it is near to if it scores more, else it goes."""
    row = F.struct(F.col(t).alias("_t"), F.col(score).alias("_score"), F.struct(*df.columns).alias("_row"))
    kind = df.select(F.array(row).alias("a")).schema["a"].dataType

    def take(kept: Column, r: Column) -> Column:
        near = F.try_element_at(F.filter(kept, lambda k: F.abs(k["_t"] - r["_t"]) < gap), F.lit(1))
        swapped = F.transform(kept, lambda k: F.when(k["_t"] == near["_t"], r).otherwise(k))
        return F.when(near.isNull(), F.array_append(kept, r)).when(r["_score"] > near["_score"], swapped).otherwise(kept)

    folded = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return folded.select(F.explode(F.aggregate("_rows", F.array().cast(kind), take)).alias("_kept")).select("_kept._row.*")


def fold_rows(df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, Callable], types: str = "double") -> DataFrame:
    """``df`` with columns that fold over each key's rows in order: each function maps a sorted pandas frame to an array.

    One pass and one task a key, in time linear in its rows; for long series, where the array forms below would copy
    the array at each step. A key's rows must fit into a task, as one match's do.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return rows.assign(**{name: fold(rows) for name, fold in columns.items()})

    schema = T.StructType([*df.schema.fields, *[T.StructField(name, T._parse_datatype_string(types)) for name in columns]])
    return df.groupBy(*keys).applyInPandas(run, schema)


def followed(values: np.ndarray, step: float) -> np.ndarray:
    """Each value follows the one before it by at most ``step``."""
    out = np.array(values, float)
    for i in range(1, len(out)):
        out[i] = out[i - 1] + min(max(out[i] - out[i - 1], -step), step)
    return out


def smoothed(values: np.ndarray, alpha: float, start: float | None = None) -> np.ndarray:
    """Exponential moving average, from ``start`` or the first value."""
    out = np.array(values, float)
    last = out[0] if start is None and len(out) else start
    for i, x in enumerate(out):
        out[i] = last = alpha * x + (1 - alpha) * last
    return out


def ema(values: Column, alpha: float) -> Column:
    """Exponential moving average of a short array, from 0; see ``fold_rows`` for long series."""
    step = lambda acc, x: F.array_append(acc, alpha * x + (1 - alpha) * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))
    return F.aggregate(values, F.array().cast("array<double>"), step)


def slew(values: Column, step: float) -> Column:
    """A short array whose neighbours differ by at most ``step``; see ``fold_rows`` for long series."""
    def follow(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.array_append(acc, F.when(last.isNull(), x).otherwise(last + F.greatest(F.lit(-step), F.least(F.lit(step), x - last))))
    return F.aggregate(values, F.array().cast("array<double>"), follow)


def lipschitz_below(df: DataFrame, keys: Sequence[str], i: str, value: str, step: float, name: str = "envelope") -> DataFrame:
    """The greatest curve below ``value`` whose slope is at most ``step`` a row, in closed form from two running minima."""
    w = Window.partitionBy(*keys).orderBy(i)
    ahead = F.min(F.col(value) - step * F.col(i)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + step * F.col(i)
    behind = F.min(F.col(value) + step * F.col(i)).over(Window.partitionBy(*keys).orderBy(F.desc(i)).rowsBetween(Window.unboundedPreceding, 0)) - step * F.col(i)
    return df.withColumn(name, F.least(ahead, behind))


def local_maxima(df: DataFrame, keys: Sequence[str], t: str, value: str, k: float = 3.0) -> DataFrame:
    """Rows above both neighbours (the first of a plateau) and above median + k * 1.4826 * MAD of their key."""
    w = Window.partitionBy(*keys).orderBy(t)
    med = df.groupBy(*keys).agg(F.median(value).alias("_med"))
    mad = df.join(med, list(keys)).groupBy(*keys).agg(F.first("_med").alias("_med"), F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    rows = df.withColumn("_up", F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(True))).withColumn("_down", F.coalesce(F.col(value) >= F.lead(value).over(w), F.lit(True)))
    level = F.col("_med") + k * (1.4826 * F.col("_mad") + 1e-12)
    return rows.join(mad, list(keys)).where(F.col("_up") & F.col("_down") & (F.col(value) >= level)).withColumn("threshold", level).drop("_up", "_down", "_med", "_mad")


def robust_threshold(value: str, k: float) -> tuple[Column, callable]:
    """Median, and a function of it that gives median + k * MAD: two passes by nature."""
    return F.median(value), lambda med: med + k * (F.median(F.abs(F.col(value) - med)) + 1e-9)


def velocity(df: DataFrame, keys: Sequence[str], t_us: str, values: Sequence[str], window_us: int) -> DataFrame:
    """Mean velocity per second between the first and last sample within +-window of each row (integer microseconds)."""
    w = Window.partitionBy(*keys).orderBy(t_us).rangeBetween(-window_us, window_us)
    span = (F.last(t_us).over(w) - F.first(t_us).over(w)) / 1e6
    return df.withColumns({f"v_{v}": F.when(span > 0, (F.last(v).over(w) - F.first(v).over(w)) / span).otherwise(0.0) for v in values})


def gaps(df: DataFrame, keys: Sequence[str], t: str, longest) -> DataFrame:
    """(keys, gap_start, gap_end) where two neighbouring samples are more than ``longest`` apart."""
    w = Window.partitionBy(*keys).orderBy(t)
    return df.select(*keys, F.col(t).alias("gap_start"), F.lead(t).over(w).alias("gap_end")).where(F.col("gap_end") - F.col("gap_start") > longest)


def block_mean_squares(df: DataFrame, keys: Sequence[str], index: str, value: str, hop: int) -> DataFrame:
    """(keys, block, rms): mean square of each block of ``hop`` rows, then the root of the mean of two neighbouring blocks."""
    blocks = df.groupBy(*keys, F.floor(F.col(index) / hop).alias("block")).agg(F.avg(F.col(value) * F.col(value)).alias("_ms"))
    w = Window.partitionBy(*keys).orderBy("block")
    return blocks.select(*keys, "block", F.sqrt((F.col("_ms") + F.coalesce(F.lag("_ms").over(w), F.col("_ms"))) / 2).alias("rms"))


def change_capture(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Only rows whose values differ from those of the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    state = F.struct(*values)
    return df.withColumn("_now", state).withColumn("_was", F.lag(state).over(w)).where(~F.col("_now").eqNullSafe(F.col("_was"))).drop("_now", "_was")


def dense_bins(df: DataFrame, keys: Sequence[str], bin_col: str, n_bins: Column, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates for every bin from 0 to n_bins - 1, empty ones with 0. ``n_bins`` is an aggregate over a key's rows."""
    counted = df.groupBy(*keys, bin_col).agg(*[a.alias(c) for c, a in aggregates.items()])
    frame = df.groupBy(*keys).agg(n_bins.alias("_n")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)).alias(bin_col))
    return frame.join(counted, [*keys, bin_col], "left").fillna(0, list(aggregates))
