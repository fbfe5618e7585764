"""Thresholds that are learnt once: observed sessions and derived limits as stored tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.model import BOOTSTRAP_SESSIONS, KEY
from turnwise.operators import calibrate as B
from turnwise.operators import metrics as M
from turnwise.sources import stores
from turnwise.sources.buckets import KeyedTable


def frozen_thresholds(spark: SparkSession, base: str) -> DataFrame | None:
    """The limits derived under ``base``, null as long as there are none."""
    return stores.read_latest(spark, f"{base}/thresholds")


def observed_sessions(spark: SparkSession, base: str) -> DataFrame | None:
    return KeyedTable(spark, f"{base}/observed", buckets=1).read()


def observe(
    spark: SparkSession,
    base: str,
    finished: DataFrame,
    caps: Mapping[str, tuple[float, float]],
    *,
    n: int = BOOTSTRAP_SESSIONS,
) -> DataFrame | None:
    """Count finished sessions towards the first ``n``; at ``n`` derive the limits and keep them.

    ``finished`` are reports (session_key, ended_at, metrics) of one run, taken in order of
    their end behind those of earlier runs.  A session counts once, whichever run brings
    it again; the table of the observed never holds more than ``n`` rows.  Once limits
    are there nothing is read or written any more.  Returns them, or null before.
    """
    frozen = frozen_thresholds(spark, base)
    if frozen is not None:
        return frozen
    table = KeyedTable(spark, f"{base}/observed", buckets=1)
    held = table.read()
    have = 0 if held is None else held.count()
    fresh = finished.select(KEY, "ended_at", "metrics")
    if held is not None:
        fresh = fresh.join(held.select(KEY), KEY, "left_anti")
    # a run that stopped between the two tables has all rows already
    if have < n:
        some = B.first_sessions(fresh, n=n - have)
        table.upsert(some.withColumn("updated_at", F.lit(have)))
        held = table.read()
        have = held.count()
    if have < n:
        return None
    limits = B.bootstrap(held, caps, n=n)
    stores.write_version(limits, f"{base}/thresholds", 1)
    return frozen_thresholds(spark, base)


def snapshots_while_observing(spark: SparkSession, base: str, rows: DataFrame, *, n: int = BOOTSTRAP_SESSIONS) -> DataFrame:
    """Metric rows with severities held back until the limits are there."""
    if frozen_thresholds(spark, base) is not None:
        return rows
    held = observed_sessions(spark, base)
    return M.clamp_while_learning(rows, 0 if held is None else held.count(), n)
