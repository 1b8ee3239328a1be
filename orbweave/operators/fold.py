"""Ordered clamped sums: what a cell's log-odds are after a sequence of updates.

One update is x -> min(high, max(low, x + delta)). Updates compose to functions of the same form, so a batch of them is three
numbers; they don't commute, so they must be combined in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.keys import TreeSetting


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def fold_column(ordered: Column, s: TreeSetting, start: Column | float = 0.0) -> Column:
    """Folds an array of deltas, in its order, from a starting value."""
    first = start if isinstance(start, Column) else F.lit(float(start))
    return F.aggregate(ordered, first.cast("double"), lambda x, d: clamp(x + d, s.log_odds_min, s.log_odds_max))


def summary_column(ordered: Column, s: TreeSetting) -> Column:
    """The composed update (delta, low, high) of an array of deltas in order."""
    none = F.struct(F.lit(0.0).alias("delta"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    return F.aggregate(
        ordered,
        none,
        lambda m, d: F.struct((m["delta"] + d).alias("delta"), clamp(m["low"] + d, s.log_odds_min, s.log_odds_max).alias("low"), clamp(m["high"] + d, s.log_odds_min, s.log_odds_max).alias("high")),
    )


def apply_summary(x: Column, m: Column) -> Column:
    return F.least(m["high"], F.greatest(m["low"], x + m["delta"]))


def fold(updates: DataFrame, keys: list[str], order: list[str], s: TreeSetting, delta: str = "delta", start: DataFrame | None = None) -> DataFrame:
    """keys, log_odds after all updates of each cell in order; start: log-odds of known cells, the others start at 0.

    With one order column a cell gathers its updates, a number each, and folds them at once. With more, a cell may have any number of updates: those are summarised by
    runs of a frame (the first order column) first, so what is gathered for a cell is a number a frame.
    """
    if len(order) == 1:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(order[0], delta))), lambda r: r[delta])
        every = updates.groupBy(*keys).agg(ordered.alias("runs"))
        if start is None:
            return every.select(*keys, fold_column(F.col("runs"), s).alias("log_odds"))
        every = every.join(start.select(*keys, F.col("log_odds").alias("_start")), keys, "full")
        return every.select(*keys, fold_column(F.coalesce("runs", F.array().cast(every.schema["runs"].dataType)), s, F.coalesce("_start", F.lit(0.0))).alias("log_odds"))
    by_frame = updates.groupBy(*keys, order[0]).agg(F.array_sort(F.collect_list(F.struct(*order[1:], delta))).alias("run"))
    part = by_frame.select(*keys, order[0], summary_column(F.transform("run", lambda r: r[delta]), s).alias("m"))
    every = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order[0], "m"))).alias("runs"))
    if start is not None:
        every = every.join(start.select(*keys, F.col("log_odds").alias("_start")), keys, "full")
        first = F.coalesce("_start", F.lit(0.0))
    else:
        first = F.lit(0.0)
    folded = F.aggregate(F.coalesce("runs", F.array().cast(every.schema["runs"].dataType)), first.cast("double"), lambda x, r: apply_summary(x, r["m"]))
    return every.select(*keys, folded.alias("log_odds"))
