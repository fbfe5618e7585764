"""Severity bands, labels and small display formats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.model import DEFAULTS, MIN_CELL_N, MetricConfig


def high_is_bad(value: Column, warn: float, critical: float) -> Column:
    return F.when(value >= critical, "critical").when(value >= warn, "warn").otherwise("ok")


def low_is_bad(value: Column, warn: float, critical: float) -> Column:
    return F.when(value < critical, "critical").when(value < warn, "warn").otherwise("ok")


def by_table(
    metric: Column,
    value: Column,
    table: Mapping[str, tuple[float | None, float | None, bool]],
    *,
    critical: str = "critical",
) -> Column:
    """Band ``value`` by its metric's row of ``table``; metrics not listed are ok."""
    out = F.when(F.lit(False), "ok")
    for name, (warn, crit, low) in sorted(table.items()):
        here = metric == name

        def beyond(limit: float, low: bool = low) -> Column:
            return (value < limit) if low else (value >= limit)

        if crit is not None:
            out = out.when(here & beyond(crit), critical)
        if warn is not None:
            out = out.when(here & beyond(warn), "warn")
    return out.otherwise("ok")


def rank(severity: Column) -> Column:
    """0 critical, 1 warn, 2 ok, so that the minimum is the worst."""
    return F.when(severity.isin("critical", "crit"), 0).when(severity == "warn", 1).otherwise(2)


def from_rank(r: Column, critical: str = "critical") -> Column:
    return F.when(r == 0, critical).when(r == 1, "warn").otherwise("ok")


def ratio_severity(calls: Column, ratio: Column, cfg: MetricConfig = DEFAULTS) -> Column:
    return F.when(calls < cfg.ratio_min_calls, "ok").otherwise(
        low_is_bad(ratio, cfg.ratio_warn, cfg.ratio_critical)
    )


def ratio_label(calls: Column, ratio: Column, cfg: MetricConfig = DEFAULTS) -> Column:
    return F.when(calls < cfg.ratio_min_calls, "warming up").otherwise(
        F.format_string("R:E %.1f", ratio)
    )


def stop_severity(hits: Column, cfg: MetricConfig = DEFAULTS) -> Column:
    return high_is_bad(hits, cfg.stop_warn, cfg.stop_critical)


def loop_severity(calls: Column, rate: Column, cfg: MetricConfig = DEFAULTS) -> Column:
    return F.when(calls < cfg.loop_min_calls, "ok").otherwise(
        high_is_bad(rate, cfg.loop_warn, cfg.loop_critical)
    )


def health_critical(lines: Column, events: Column, confidence: Column, cfg: MetricConfig) -> Column:
    enough = (lines >= cfg.health_min_lines) | (events >= cfg.health_min_lines)
    return enough & (confidence < cfg.health_critical)


def direction_word(delta: Column) -> Column:
    return F.when(delta > 0, "rose").when(delta < 0, "fell").otherwise("held steady")


def trend_arrow(delta: Column) -> Column:
    return F.when(delta > 0, "↗").when(delta < 0, "↘").otherwise("→")


def n_bucket(n: Column) -> Column:
    return F.when(n < 5, "n<5").when(n < 10, "5-9").when(n < 25, "10-24").otherwise("25+")


def guarded(n: Column, min_n: int = MIN_CELL_N) -> Column:
    return n >= min_n


def sentinel(min_n: int = MIN_CELL_N) -> str:
    return f"n<{min_n}"


def iso_week(day: Column) -> Column:
    return F.format_string(
        "%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day)
    )


def duration_text(seconds: Column) -> Column:
    total = seconds.cast("long")
    minutes, hours = F.floor(total / 60), F.floor(total / 3600)
    return (
        F.when(total < 60, F.format_string("%ds", total))
        .when(minutes < 60, F.format_string("%dm%02ds", minutes, total % 60))
        .otherwise(F.format_string("%dh%02dm", hours, minutes % 60))
    )


def short_id(session_id: Column, length: int = 12) -> Column:
    return F.left(F.regexp_replace(session_id, "^agent-", ""), F.lit(length))


def signed(value: Column, digits: int = 2, suffix: str = "") -> Column:
    return F.concat(
        F.when(value >= 0, "+").otherwise(""), F.format_string(f"%.{digits}f{suffix}", value)
    )


def project_label(name: Column, project_hash: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(project_hash, F.lit("")), F.lit("—"))
