"""Lookups over stored reports: filters, lists, differences, cross-tabs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import bands
from turnwise.model import HISTORY_THRESHOLDS, KEY
from turnwise.operators.metrics import long_metrics

Thresholds = Mapping[str, tuple[float | None, float | None, bool]]


def metric_severity(thresholds: Thresholds = HISTORY_THRESHOLDS) -> Column:
    return bands.by_table(F.col("metric_name"), F.col("value"), thresholds, critical="crit")


def report_severity(thresholds: Thresholds = HISTORY_THRESHOLDS) -> Column:
    """Worst band over the report's metrics map, without exploding it."""
    banded = F.transform(
        F.map_entries("metrics"),
        lambda e: bands.rank(bands.by_table(e["key"], e["value"], thresholds, critical="crit")),
    )
    return bands.from_rank(F.coalesce(F.array_min(banded), F.lit(2)), critical="crit")


def apply_filters(
    reports: DataFrame,
    *,
    project: str | None = None,
    since: dt.date | None = None,
    until: dt.date | None = None,
    severity: str | None = None,
    model: str | None = None,
    permission_mode: str | None = None,
    task_type: str | None = None,
    thresholds: Thresholds = HISTORY_THRESHOLDS,
) -> DataFrame:
    """Reports that match every given condition; nulls never match."""
    rows = reports
    if project is not None:
        rows = rows.filter((F.col("project_name") == project) | (F.col("project_hash") == project))
    if since is not None:
        rows = rows.filter(F.to_date("started_at") >= F.lit(since))
    if until is not None:
        rows = rows.filter(F.to_date("started_at") <= F.lit(until))
    for name, wanted in (("model", model), ("permission_mode", permission_mode)):
        if wanted is not None:
            rows = rows.filter(F.col(name) == wanted)
    if severity is not None:
        rows = rows.filter(report_severity(thresholds) == severity)
    if task_type is not None:
        rows = rows.filter(F.col("session_task_type") == task_type)
    return rows


def top_metrics(n: int = 2) -> Column:
    """``name=value`` of the n largest metrics by size, ties by name."""
    ranked = F.array_sort(
        F.transform(
            F.map_entries("metrics"),
            lambda e: F.struct((-F.abs(e["value"])).alias("k"), e["key"].alias("m"), e["value"].alias("v")),
        )
    )
    text = F.array_join(
        F.transform(
            F.slice(ranked, 1, n),
            lambda s: F.concat(s["m"], F.lit("="), F.format_string("%.2f", s["v"])),
        ),
        ", ",
    )
    return F.when(F.size("metrics") > 0, text).otherwise("—")


def session_list(reports: DataFrame, *, thresholds: Thresholds = HISTORY_THRESHOLDS) -> DataFrame:
    """Display row per report."""
    return reports.select(
        KEY,
        bands.short_id(F.col("session_id")).alias("short_id"),
        bands.project_label(F.col("project_name"), F.col("project_hash")).alias("project"),
        F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("started_at"),
        bands.duration_text(F.col("duration_seconds")).alias("duration"),
        report_severity(thresholds).alias("severity"),
        F.coalesce("model", F.lit("—")).alias("model"),
        F.coalesce("permission_mode", F.lit("—")).alias("permission_mode"),
        top_metrics().alias("metrics_summary"),
        F.coalesce("session_task_type", F.lit("—")).alias("task_type"),
    )


def session_diff(reports: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Metrics of two sessions side by side, with the change where both have one."""
    sides = {
        side: long_metrics(reports.filter(F.col(KEY) == key), KEY).select(
            "metric_name", F.col("value").alias(f"value_{side}")
        )
        for side, key in (("a", key_a), ("b", key_b))
    }
    return _diff(sides["a"], sides["b"], ["metric_name"])


def diff_pairs(reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same difference for many pairs at once; ``pairs`` has key_a, key_b."""
    sides = {}
    for side in ("a", "b"):
        held = reports.select(F.col(KEY).alias(f"key_{side}"), F.explode("metrics").alias("metric_name", f"value_{side}"))
        sides[side] = pairs.join(held, f"key_{side}")
    return _diff(sides["a"], sides["b"], ["key_a", "key_b", "metric_name"])


def diff_following(reports: DataFrame, group: Column, day: Column) -> DataFrame:
    """Each report against that of the same group on the next calendar day.

    One shuffle by group and a look at the following row: a group has at most one report
    a day, so its rows are as many as its days.
    """
    order = Window.partitionBy("_group").orderBy("_day")
    rows = reports.select(group.alias("_group"), day.alias("_day"), KEY, "metrics")
    after = F.lead(F.struct("_day", KEY, "metrics")).over(order)
    rows = rows.withColumn("_b", after).filter(F.col("_b._day") == F.date_add("_day", 1))
    names = F.array_union(F.map_keys("metrics"), F.map_keys("_b.metrics"))
    rows = rows.select(KEY, "metrics", "_b", F.explode(names).alias("metric_name"))
    a, b = F.try_element_at("metrics", F.col("metric_name")), F.try_element_at("_b.metrics", F.col("metric_name"))
    return rows.select(
        F.col(KEY).alias("key_a"),
        F.col(f"_b.{KEY}").alias("key_b"),
        "metric_name",
        a.alias("value_a"),
        b.alias("value_b"),
        (b - a).alias("delta"),
        F.when(b.isNull(), "b").when(a.isNull(), "a").alias("absent_in"),
    )


def _diff(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "full").select(
        *on,
        "value_a",
        "value_b",
        (F.col("value_b") - F.col("value_a")).alias("delta"),
        F.when(F.col("value_b").isNull(), "b").when(F.col("value_a").isNull(), "a").alias("absent_in"),
    )


def diff_header(reports: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """(field, session A, session B) of the report header."""
    fields = {
        "session_id": F.col("session_id"),
        "project": bands.project_label(F.col("project_name"), F.col("project_hash")),
        "model": F.coalesce("model", F.lit("—")),
        "permission_mode": F.coalesce("permission_mode", F.lit("—")),
        "started_at": F.date_format("started_at", "yyyy-MM-dd HH:mm"),
        "duration": bands.duration_text(F.col("duration_seconds")),
        "events": F.col("event_count").cast("string"),
        "severity": report_severity(),
    }
    rows = reports.filter(F.col(KEY).isin(key_a, key_b)).select(
        KEY,
        "duration_seconds",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("pos"), F.lit(n).alias("field"), c.alias("value"))
                    for i, (n, c) in enumerate(fields.items())
                ]
            )
        ),
    )
    is_a, is_b = F.col(KEY) == key_a, F.col(KEY) == key_b
    out = rows.groupBy("pos", "field").agg(
        F.max(F.when(is_a, F.col("value"))).alias("session_a"),
        F.max(F.when(is_b, F.col("value"))).alias("session_b"),
        (
            F.max(F.when(is_b, F.col("duration_seconds")))
            - F.max(F.when(is_a, F.col("duration_seconds")))
        ).alias("_d"),
    )
    change = F.concat(F.lit(" ("), bands.signed(F.col("_d"), 0, "s"), F.lit(")"))
    return (
        out.withColumn(
            "session_b",
            F.when(F.col("field") == "duration", F.concat("session_b", change)).otherwise(
                F.col("session_b")
            ),
        )
        .orderBy("pos")
        .select("field", "session_a", "session_b")
    )


def metric_detail(reports: DataFrame, *, thresholds: Thresholds = HISTORY_THRESHOLDS) -> DataFrame:
    """Every metric of every given report with its band."""
    return long_metrics(reports, KEY, "session_id").withColumn(
        "severity", metric_severity(thresholds)
    )


def severity_heatmap(reports: DataFrame, *, thresholds: Thresholds = HISTORY_THRESHOLDS) -> DataFrame:
    """Per session and metric: the value under its band, and the band's maximum."""
    rows = metric_detail(reports, thresholds=thresholds).drop("session_id")
    peak = F.max("value").over(Window.partitionBy(KEY, "severity"))
    held = rows.withColumn("column_max", peak)
    return held.select(
        KEY,
        "metric_name",
        *[
            F.when(F.col("severity") == s, F.col("value")).alias(f"{s}_value")
            for s in ("ok", "warn", "crit")
        ],
        "column_max",
        F.try_divide("value", "column_max").alias("share_of_max"),
    )


def task_cross_tab(reports: DataFrame) -> DataFrame:
    """(metric, task label): mean value, its share of the label's largest mean."""
    label = F.coalesce("session_task_type", F.lit("(unclassified)"))
    means = (
        reports.select(label.alias("task_type"), F.explode("metrics").alias("metric_name", "value"))
        .groupBy("metric_name", "task_type")
        .agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    )
    peak = F.max("mean").over(Window.partitionBy("task_type"))
    return means.withColumn("column_max", peak)


def task_cross_table(reports: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Metrics as rows, task labels as columns, mean values."""
    tab = task_cross_tab(reports).groupBy("metric_name")
    return (tab.pivot("task_type", labels) if labels else tab.pivot("task_type")).agg(F.first("mean"))
