"""Report and processed-session tables: upsert, delete, lookups, versions on disk."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.model import KEY
from turnwise.operators import reports as R
from turnwise.operators.fleet import recent_projects  # noqa: F401  (store query)
from turnwise.sources.buckets import KeyedTable, _hadoop


class AmbiguousSession(LookupError):
    """A bare session id names sessions under several roots."""


# ------------------------------------------------------------------ changes


def upsert(old: DataFrame, new: DataFrame, *, keys: Sequence[str] = (KEY,), order: str = "updated_at") -> DataFrame:
    """Union in which the row with the latest ``order`` per key wins.

    The winner is a max_by over the packed row: one partial row per key and task.
    """
    keys = list(keys)
    rows = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*rows.columns)
    )


def replace_children(old: DataFrame, new: DataFrame, sessions: DataFrame) -> DataFrame:
    """Metric rows of ``sessions`` replaced as a whole by the new ones."""
    return old.join(sessions.select(KEY).distinct(), KEY, "left_anti").unionByName(
        new, allowMissingColumns=True
    )


def upsert_processed(
    sessions: DataFrame, metrics: DataFrame, new_sessions: DataFrame, new_metrics: DataFrame
) -> tuple[DataFrame, DataFrame]:
    return upsert(sessions, new_sessions), replace_children(metrics, new_metrics, new_sessions)


def delete_sessions(
    sessions: DataFrame, metrics: DataFrame, keys: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remove sessions together with their metrics."""
    gone = keys.select(KEY).distinct()
    return sessions.join(gone, KEY, "left_anti"), metrics.join(gone, KEY, "left_anti")


# ------------------------------------------------------------------ lookups


def list_reports(
    reports: DataFrame, *, since: dt.datetime | None = None, until: dt.datetime | None = None
) -> DataFrame:
    """Valid reports in [since, until] by start time; invalid rows are left out."""
    good, _ = R.migrate_reports(reports)
    if since is not None:
        good = good.filter(F.col("started_at") >= R._stamp(since))
    if until is not None:
        good = good.filter(F.col("started_at") <= R._stamp(until))
    return good.orderBy("started_at", KEY)


def get_report(reports: DataFrame, identifier: str) -> DataFrame:
    """The report with this key, or with this id if only one session has it."""
    exact = reports.filter(F.col(KEY) == identifier)
    if exact.limit(1).count():
        return exact
    found = reports.filter(F.col("session_id") == identifier)
    # Two keys are enough to know, so at most two rows reach the driver.
    if found.select(KEY).distinct().limit(2).count() > 1:
        raise AmbiguousSession(f"{identifier!r} names several sessions; give the session key")
    return found


def resolve_keys(sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(identifier, root_id) -> session_key: a key as such, id under a root, else newest.

    ``wanted``: identifier, root_id (nullable).
    """
    plain = wanted.filter(~F.col("identifier").contains(":"))
    full = wanted.filter(F.col("identifier").contains(":")).select(
        "identifier", "root_id", F.col("identifier").alias(KEY)
    )
    held = sessions.select(
        F.col("session_id").alias("identifier"), F.col("root_id").alias("_root"), KEY, "updated_at"
    )
    found = (
        plain.join(held, "identifier")
        .filter(F.col("root_id").isNull() | (F.col("root_id") == F.col("_root")))
        .groupBy("identifier", "root_id")
        .agg(F.max_by(KEY, F.struct("updated_at", KEY)).alias(KEY))
    )
    return full.unionByName(found)


def with_metrics(sessions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sessions, newest first, each with its metric rows sorted by name."""
    held = metrics.groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct("metric_name", "value", "severity", "label"))).alias(
            "metrics"
        )
    )
    return sessions.join(held, KEY, "left").orderBy(F.col("last_event_time").desc(), KEY)


def by_path(sessions: DataFrame, path: str) -> DataFrame:
    return sessions.filter(F.col("path") == path).limit(1)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, file, label, rationale) from a label file."""
    raw = spark.read.option("multiLine", "true").json(path)
    return raw.select(F.inline("sessions"))


# ----------------------------------------------------------------- versions


def versions(spark: SparkSession, base: str) -> list[int]:
    """Complete versions of a table folder, oldest first, bucketed or written whole."""
    system, where = _hadoop(spark, base)
    if not system.exists(where):
        return []
    bucketed = KeyedTable(spark, base).versions()
    if bucketed:
        return bucketed
    # one listing for all versions
    done = system.globStatus(_hadoop(spark, f"{base}/version=*/_SUCCESS")[1])
    return sorted(int(status.getPath().getParent().getName().split("=")[1]) for status in done)


def read_latest(spark: SparkSession, base: str) -> DataFrame | None:
    bucketed = KeyedTable(spark, base).read()
    if bucketed is not None:
        return bucketed
    found = versions(spark, base)
    return spark.read.parquet(f"{base}/version={found[-1]:09d}") if found else None


def write_version(df: DataFrame, base: str, version: int | None = None) -> int:
    """Write a new version beside the old ones; readers only see finished versions.

    Giving the version makes a repeated write (a replayed batch) harmless.
    """
    spark = df.sparkSession
    if version is None:
        found = versions(spark, base)
        version = found[-1] + 1 if found else 1
    df.write.mode("overwrite").parquet(f"{base}/version={version:09d}")
    return version
