"""Thresholds derived from observed sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.model import BOOTSTRAP_SESSIONS, KEY
from turnwise.operators.ranks import exact_quantiles

#: Metrics where a small value is the bad one.
LOW_IS_BAD = ("read_edit_ratio",)


def first_sessions(reports: DataFrame, *, n: int = BOOTSTRAP_SESSIONS) -> DataFrame:
    """The first ``n`` finished sessions (a top-n, not a global sort)."""
    return reports.orderBy("ended_at", KEY).limit(n)


def observations(reports: DataFrame) -> DataFrame:
    """(metric, value) of the calibrated metrics; parse_health is not one of them."""
    return reports.select(F.explode("metrics").alias("metric_name", "value")).filter(
        F.col("metric_name") != "parse_health"
    )


def quantile_thresholds(
    values: DataFrame, *, low_is_bad: Sequence[str] = LOW_IS_BAD
) -> DataFrame:
    """p80 and p95 per metric, or p20 and p5 where small values are bad."""
    q = exact_quantiles(values, "metric_name", "value", [0.05, 0.20, 0.80, 0.95])
    low = F.col("metric_name").isin(*low_is_bad) if low_is_bad else F.lit(False)
    return q.select(
        "metric_name",
        F.col("total").alias("n"),
        F.when(low, F.col("q")[1]).otherwise(F.col("q")[2]).alias("warn"),
        F.when(low, F.col("q")[0]).otherwise(F.col("q")[3]).alias("critical"),
    )


def clamp(
    thresholds: DataFrame,
    caps: Mapping[str, tuple[float, float]],
    *,
    low_is_bad: Sequence[str] = LOW_IS_BAD,
) -> DataFrame:
    """Limit derived values by the configured ones.

    High-is-bad: warn is at most, critical at least the cap; low-is-bad the
    other way round.  Metrics without a cap stay as derived.
    """
    warn, critical = F.col("warn"), F.col("critical")
    out_w, out_c = F.when(F.lit(False), warn), F.when(F.lit(False), critical)
    for name, (cap_w, cap_c) in sorted(caps.items()):
        here, low = F.col("metric_name") == name, name in low_is_bad
        bound_w = F.greatest if low else F.least
        bound_c = F.least if low else F.greatest
        out_w = out_w.when(here, bound_w(warn, F.lit(float(cap_w))))
        out_c = out_c.when(here, bound_c(critical, F.lit(float(cap_c))))
    return thresholds.withColumns({"warn": out_w.otherwise(warn), "critical": out_c.otherwise(critical)})


def bootstrap(
    reports: DataFrame,
    caps: Mapping[str, tuple[float, float]],
    *,
    n: int = BOOTSTRAP_SESSIONS,
    frozen: DataFrame | None = None,
) -> DataFrame:
    """Thresholds from the first ``n`` sessions; empty until there are that many.

    Once derived they are kept: pass the stored table as ``frozen`` and it is
    returned unchanged.
    """
    if frozen is not None:
        return frozen
    sample = first_sessions(reports, n=n)
    enough = sample.agg(F.count("*").alias("_have")).filter(F.col("_have") >= n)
    derived = clamp(quantile_thresholds(observations(sample)), caps)
    # `enough` has one row or none.
    return derived.join(F.broadcast(enough)).drop("_have")


def recalibrate(
    reports: DataFrame,
    metrics: Sequence[str] = ("read_edit_ratio", "stop_phrase", "reasoning_loop"),
    *,
    by_direction: bool = False,
) -> DataFrame:
    """p80 and p95 of three metrics over a whole corpus.

    ``by_direction`` uses p20 and p5 for metrics where small values are bad.
    """
    values = observations(reports).filter(F.col("metric_name").isin(*metrics))
    return quantile_thresholds(values, low_is_bad=LOW_IS_BAD if by_direction else ())
