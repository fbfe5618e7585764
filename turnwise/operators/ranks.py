"""Exact quantiles and ranks of values in few, large groups.

There are about ten metrics and as many values per metric as sessions, so the
metric alone is a hot key.  Values are first counted (which combines map-side),
then cut at approximate quantiles into buckets; only the counts per bucket are
summed per metric, and rows are ordered inside one bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per group; a bucket of a billion distinct values then holds some hundred thousand.
BUCKETS = 1024


def value_counts(df: DataFrame, group: str, value: str, weight: str | None = None) -> DataFrame:
    amount = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(group, value).agg(amount.alias("_n"))


def _bucketed(counts: DataFrame, group: str, value: str, buckets: int) -> DataFrame:
    """Attach a bucket number to every distinct value."""
    side = max(2, math.isqrt(buckets))
    points = [i / side**2 for i in range(1, side**2)]
    # One row of cuts per metric.  Whether it is broadcast is left to the optimiser's
    # size check; the join is on the metric name.
    # The filter keeps `_n` in this branch too, so that both sides ask for the very
    # same shuffle and Spark runs the input once.
    cuts = counts.filter(F.col("_n") >= 0).groupBy(group).agg(
        F.percentile_approx(value, points, 20_000).alias("_cuts")
    )
    coarse = F.transform(F.sequence(F.lit(side), F.lit(side**2 - 1), F.lit(side)), lambda i: F.get("_cuts", i - 1))
    cuts = cuts.withColumn("_coarse", coarse)
    return counts.join(cuts, group).withColumn("_bucket", _bucket_of(F.col(value), side)).drop("_cuts", "_coarse")


def _bucket_of(value: Column, side: int) -> Column:
    """How many of the ``side``^2 - 1 cuts lie below: first every ``side``-th, then those between."""
    block = F.size(F.filter("_coarse", lambda cut: cut < value))
    return block * side + F.size(F.filter(F.slice("_cuts", block * side + 1, side - 1), lambda cut: cut < value))


def cumulative_counts(
    df: DataFrame, group: str, value: str, *, weight: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """(group, value, n, at_or_below, total): exact cumulative count per distinct value.

    With ``weight`` rows count that much, so rows of weight 0 are only ranked.
    """
    rows = _bucketed(value_counts(df, group, value, weight), group, value, buckets)
    up_to = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(group, "_bucket")
        .agg(F.sum("_n").alias("_in_bucket"))
        .select(
            group,
            "_bucket",
            F.coalesce(F.sum("_in_bucket").over(up_to), F.lit(0)).alias("_below"),
            F.sum("_in_bucket").over(Window.partitionBy(group)).alias("total"),
        )
    )
    inside = (
        Window.partitionBy(group, "_bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("_local", F.sum("_n").over(inside))
        .join(offsets, [group, "_bucket"])
        .select(
            group,
            value,
            F.col("_n").alias("n"),
            (F.col("_local") + F.col("_below")).alias("at_or_below"),
            "total",
        )
    )


def exact_quantiles(
    df: DataFrame,
    group: str,
    value: str,
    probabilities: Sequence[float],
    *,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(group, total, q array): linearly interpolated quantiles, ends included.

    The quantile of p lies between the values at 0-based ranks floor(p*(n-1)) and
    the next one; a distinct value covers the ranks [at_or_below - n, at_or_below).
    """
    ranked = cumulative_counts(df, group, value, buckets=buckets)
    picks = []
    for i, p in enumerate(probabilities):
        place = F.lit(p) * (F.col("total") - 1)
        low, high = F.floor(place), F.ceil(place)
        first, last = F.col("at_or_below") - F.col("n"), F.col("at_or_below")
        picks.append(F.max(F.when((first <= low) & (low < last), F.col(value))).alias(f"_lo{i}"))
        picks.append(F.max(F.when((first <= high) & (high < last), F.col(value))).alias(f"_hi{i}"))
    found = ranked.groupBy(group).agg(F.max("total").alias("total"), *picks)
    out = []
    for i, p in enumerate(probabilities):
        place = F.lit(p) * (F.col("total") - 1)
        share = place - F.floor(place)
        out.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share)
    return found.select(group, "total", F.array(*out).alias("q"))
