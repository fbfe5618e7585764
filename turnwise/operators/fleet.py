"""Roll-ups of live and stored sessions by project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import bands
from turnwise.model import KEY
from turnwise.operators.ranks import cumulative_counts


def project_key(name: str = "project_name", digest: str = "project_hash") -> Column:
    return F.coalesce(
        F.nullif(F.col(name), F.lit("")),
        F.nullif(F.left(digest, F.lit(8)), F.lit("")),
        F.lit("(unknown)"),
    )


def session_ranks(snapshot_rows: DataFrame) -> DataFrame:
    """Worst band per session over its metric snapshots."""
    return snapshot_rows.groupBy(KEY).agg(
        F.min(bands.rank(F.col("severity"))).alias("severity_rank")
    )


def project_rollup(sessions: DataFrame, snapshot_rows: DataFrame) -> DataFrame:
    """Per project: sessions, worst band, latest activity, and the metric values of
    the session that is worst in each metric (ties: lowest session key).

    ``sessions``: session_key, project_key, updated_at.
    """
    ranked = sessions.join(session_ranks(snapshot_rows), KEY, "left")
    heads = ranked.groupBy("project_key").agg(
        F.count("*").alias("sessions"),
        F.coalesce(F.min("severity_rank"), F.lit(2)).alias("severity_rank"),
        F.max("updated_at").alias("updated_at"),
    )
    rank = bands.rank(F.col("severity"))
    cells = (
        snapshot_rows.join(sessions.select(KEY, "project_key"), KEY)
        .groupBy("project_key", "metric_name")
        .agg(F.min_by("value", F.struct(rank.alias("r"), F.col(KEY).alias("k"))).alias("value"))
    )
    values = cells.groupBy("project_key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_name", "value")))).alias(
            "metrics"
        )
    )
    return heads.join(values, "project_key", "left").withColumn(
        "severity", bands.from_rank(F.col("severity_rank"))
    )


def overlay_stored(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Live project rows, completed by stored projects that are not live."""
    rest = stored.join(live.select("project_key"), "project_key", "left_anti")
    return live.withColumn("origin", F.lit("live")).unionByName(
        rest.withColumn("origin", F.lit("stored")), allowMissingColumns=True
    )


def recent_projects(sessions: DataFrame, metrics: DataFrame, *, limit: int) -> DataFrame:
    """The ``limit`` most recently active projects with their newest session's metrics.

    ``sessions``: session_key, project_hash, project_name, last_event_time.
    """
    newest = F.struct("last_event_time", KEY)
    heads = (
        sessions.withColumn("project_key", project_key())
        .groupBy("project_key")
        .agg(
            F.count("*").alias("session_count"),
            F.max("last_event_time").alias("last_event_time"),
            F.max_by(KEY, newest).alias(KEY),
            F.max_by("project_hash", newest).alias("project_hash"),
            F.max_by("project_name", newest).alias("project_name"),
        )
        .orderBy(F.col("last_event_time").desc(), "project_key")
        .limit(limit)
    )
    held = metrics.join(heads.select(KEY), KEY, "left_semi").groupBy(KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_name", "value")))).alias(
            "metrics"
        )
    )
    return heads.join(held, KEY, "left")


def fleet_counters(sessions: DataFrame, snapshot_rows: DataFrame) -> DataFrame:
    """One row: critical, warn and ok sessions, all sessions, projects."""
    rows = sessions.join(session_ranks(snapshot_rows), KEY, "left")
    rank = F.coalesce("severity_rank", F.lit(2))
    return rows.agg(
        F.count_if(rank == 0).alias("critical"),
        F.count_if(rank == 1).alias("warn"),
        F.count_if(rank == 2).alias("ok"),
        F.count("*").alias("sessions"),
        F.count_distinct(F.nullif("project_key", F.lit(""))).alias("projects"),
    )


def worst_first(rows: DataFrame, *, limit: int, id_column: str = KEY) -> DataFrame:
    """Top rows by band, then recency, then id, with the total beside them."""
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy("severity_rank", F.col("updated_at").desc(), id_column).limit(limit)
    # `total` is a one-row aggregate.
    return top.join(F.broadcast(total))


def baseline_percentile(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Percent of stored values at or below each current value, per metric.

    ``current``: session_key, metric_name, value; ``baseline``: metric_name,
    value.  Both are ranked together in one distributed cumulative count; joining
    every current with every stored value would grow with their product.
    """
    both = baseline.select("metric_name", "value", F.lit(1).alias("_w")).unionByName(
        current.select("metric_name", "value", F.lit(0).alias("_w"))
    )
    ranked = cumulative_counts(both, "metric_name", "value", weight="_w")
    rows = current.join(ranked, ["metric_name", "value"]).filter(F.col("total") > 0)
    return rows.select(
        KEY,
        "metric_name",
        "value",
        F.bround(F.col("at_or_below") * 100 / F.col("total")).cast("int").alias("percentile"),
    )
