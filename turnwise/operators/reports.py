"""Session reports: time windows, identity, validation, lifecycle state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import variants as V
from turnwise.model import (
    BLOCKS_PER_LINE,
    CHUNK,
    DEFAULTS,
    KEY,
    LEGACY_ROOT,
    LOOP_PHRASES,
    SEQ,
    STOP_PHRASES,
    MetricConfig,
    Phrase,
)
from turnwise.operators import metrics as M
from turnwise.operators import normalize as N
from turnwise.operators import turns as T
from turnwise.operators.ordered import beside, with_key_minimum

SCHEMA_VERSION = 2
REQUIRED = (
    "schema_version",
    "session_id",
    "session_key",
    "root_id",
    "project_hash",
    "started_at",
    "ended_at",
    "duration_seconds",
    "event_count",
    "parse_confidence",
    "metrics",
)


# ---------------------------------------------------------------- identity


def root_id(path: Column) -> Column:
    return F.concat(F.lit("root-"), F.left(F.sha2(path, 256), F.lit(12)))


def session_key(root: Column, session_id: Column) -> Column:
    """``root:session``; null when either part is empty, so the row can be set aside."""
    return F.when(
        (F.length(root) > 0) & (F.length(session_id) > 0), F.concat_ws(":", root, session_id)
    )


def legacy_session_key(session_id: Column) -> Column:
    return session_key(F.lit(LEGACY_ROOT), session_id)


def split_session_key(key: Column) -> Column:
    """struct<root_id, session_id>, null for keys without two non-empty parts."""
    root, rest = F.substring_index(key, ":", 1), F.substring(key, F.instr(key, ":") + 1, F.length(key))
    fine = (F.instr(key, ":") > 1) & (F.length(rest) > 0)
    return F.when(fine, F.struct(root.alias("root_id"), rest.alias("session_id")))


def match_roots(paths: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Attach the configured root that contains ``path``; the longest one wins.

    Roots are a handful of configured directories, so they become literals and
    the match is a plain projection.
    """
    choices = F.lit(None).cast("string")
    for root in sorted({r.rstrip("/") for r in roots}, key=len):
        inside = (F.col("path") == root) | F.col("path").startswith(root + "/")
        choices = F.when(inside, F.lit(root)).otherwise(choices)
    return paths.withColumn("root_path", choices).withColumns(
        {
            "root_id": F.when(F.col("root_path").isNotNull(), root_id(F.col("root_path"))),
            "root_label": F.col("root_path"),
        }
    )


def longest_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root_path, root_id, root_label: for each path the longest root that holds it.

    Any number of roots (column ``root_path``): a path's folders become rows and meet the
    roots in an equal join, so no path is compared with every root.  Paths without a root
    stay, with nulls; a path that is a root itself is inside it.
    """
    named = roots.select(F.rtrim(F.col("root_path"), F.lit("/")).alias("root_path")).distinct()
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    whole = paths.select("path").distinct()
    held = whole.select("path", F.explode(folders).alias("root_path")).join(named, "root_path")
    found = held.groupBy("path").agg(F.max_by("root_path", F.length("root_path")).alias("root_path"))
    return whole.join(found, "path", "left").withColumns(
        {
            "root_id": F.when(F.col("root_path").isNotNull(), root_id(F.col("root_path"))),
            "root_label": F.col("root_path"),
        }
    )


def project_hash(path: Column) -> Column:
    """Directory right under ``projects/``, else 16 hex digits of the path's hash."""
    found = F.regexp_extract(path, r"(?:^|/)projects/([^/]+)", 1)
    return F.when(found != "", found).otherwise(F.left(F.sha2(path, 256), F.lit(16)))


def unknown_layout(paths: DataFrame) -> DataFrame:
    """Drift rows for paths whose project had to be derived from the path itself."""
    return paths.filter(~F.col("path").rlike(r"(?:^|/)projects/[^/]+")).select(
        "path", F.lit("warn").alias("level"), F.lit("project_layout_unknown").alias("code")
    )


def project_names(
    hashes: DataFrame, events: DataFrame | None = None, overrides: DataFrame | None = None
) -> DataFrame:
    """Display name per project: override, else first working directory, else hash[:8].

    ``events`` needs project_hash, an ordering (ts, session_key, seq) and
    system_payload.
    """
    out = hashes.select("project_hash").distinct()
    names: list[Column] = []
    if overrides is not None:
        named = overrides.filter(F.length("project_name") > 0).groupBy("project_hash").agg(
            F.min("project_name").alias("_override")
        )
        out = out.join(named, "project_hash", "left")
        names.append(F.col("_override"))
    if events is not None:
        base = F.substring_index(
            F.regexp_replace(V.string(V.field(F.col("system_payload"), "$.cwd")), "/+$", ""), "/", -1
        )
        seen = (
            events.filter(F.col("kind") == "system")
            .withColumn("_name", base)
            .filter(F.length("_name") > 0)
            .groupBy("project_hash")
            .agg(F.min_by("_name", F.struct("ts", KEY, SEQ)).alias("_cwd"))
        )
        out = out.join(seen, "project_hash", "left")
        names.append(F.col("_cwd"))
    return out.select(
        "project_hash",
        F.coalesce(*names, F.left("project_hash", F.lit(8))).alias("project_name"),
    )


# ------------------------------------------------------------- time windows


def end_of_day(bound: dt.datetime) -> dt.datetime:
    """An upper bound given as a bare date means the end of that day."""
    bare = bound.hour == bound.minute == bound.second == 0
    return bound.replace(hour=23, minute=59, second=59) if bare else bound


def standard_windows(now: dt.datetime) -> list[tuple[str, dt.datetime, dt.datetime]]:
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    return [
        ("today", midnight, now),
        ("7d", now - dt.timedelta(days=7), now),
        ("30d", now - dt.timedelta(days=30), now),
    ]


def _utc(bound: dt.datetime) -> str:
    if bound.tzinfo is not None:
        bound = bound.astimezone(dt.timezone.utc)
    return bound.strftime("%Y-%m-%d %H:%M:%S.%f")


def _stamp(bound: dt.datetime) -> Column:
    return F.lit(_utc(bound)).cast("timestamp")


def in_window(
    events: DataFrame,
    start: dt.datetime | None,
    end: dt.datetime | None,
    *,
    cutoff: bool = False,
) -> DataFrame:
    """Events inside [start, end], wherever they stand in their session.

    With ``cutoff`` a session also stops at its first event after ``end``, even
    if later events fall inside again (a reader that stops there sees no more).
    """
    rows = events
    if end is not None:
        after = F.when(F.col("ts") > _stamp(end), F.col(SEQ))
        if cutoff:
            rows = with_key_minimum(rows, after, "_stop")
            rows = rows.filter(F.col("_stop").isNull() | (F.col(SEQ) < F.col("_stop"))).drop("_stop")
        rows = rows.filter(F.col("ts") <= _stamp(end))
    if start is not None:
        rows = rows.filter(F.col("ts") >= _stamp(start))
    return rows


def fan_out_windows(
    events: DataFrame, windows: Sequence[tuple[str, dt.datetime, dt.datetime]], *, cutoff: bool = False
) -> DataFrame:
    """Events once per window that contains them, with a ``window`` column.

    The windows are a few fixed periods: each event is compared with all of them
    in one projection, and the transcripts are read once for all.
    """
    table = F.array(
        *[
            F.struct(F.lit(n).alias("window"), _stamp(a).alias("_from"), _stamp(b).alias("_to"))
            for n, a, b in windows
        ]
    )
    if not cutoff:
        if windows:
            # reaches the scan: nothing outside all windows is read further
            low, high = min(a for _, a, _ in windows), max(b for _, _, b in windows)
            events = events.filter(F.col("ts").between(_stamp(low), _stamp(high)))
        fits = F.filter(table, lambda w: (F.col("ts") >= w["_from"]) & (F.col("ts") <= w["_to"]))
        rows = events.withColumn("_w", F.explode(fits))
        return rows.withColumn("window", F.col("_w.window")).drop("_w")
    rows = events.withColumn("_w", F.explode(table)).withColumn("window", F.col("_w.window"))
    after = F.when(F.col("ts") > F.col("_w._to"), F.col(SEQ))
    rows = with_key_minimum(rows, after, "_stop", keys=["window", KEY])
    return rows.filter(
        (F.col("_stop").isNull() | (F.col(SEQ) < F.col("_stop")))
        & (F.col("ts") >= F.col("_w._from"))
        & (F.col("ts") <= F.col("_w._to"))
    ).drop("_w", "_stop")


def outcomes_until(
    outcomes: DataFrame, events: DataFrame, ends: Sequence[tuple[str, dt.datetime]]
) -> DataFrame:
    """Line outcomes a reader has seen when it stops at the first event after an end.

    One copy per named end, in the ``window`` column.  The line being read at the
    stop counts as read but has no outcome yet.
    """
    table = F.array(
        *[F.struct(F.lit(n).alias("window"), _stamp(b).alias("_to")) for n, b in ends]
    )
    late = F.filter(table, lambda w: F.col("ts") > w["_to"])
    stops = (
        events.select(KEY, SEQ, F.explode(late).alias("_w"))
        .groupBy(KEY, "_w.window")
        .agg(F.floor(F.min(SEQ) / BLOCKS_PER_LINE).alias("_stop_line"))
    )
    by_chunk = outcomes.select(KEY, CHUNK).distinct().join(stops, KEY)
    rows = outcomes.withColumn("window", F.explode(F.array(*[F.lit(n) for n, _ in ends])))
    rows = rows.join(by_chunk, [KEY, CHUNK, "window"], "left")
    return (
        rows.filter(F.col("_stop_line").isNull() | (F.col("line_no") <= F.col("_stop_line")))
        .withColumn("ok", F.when(~F.col("line_no").eqNullSafe(F.col("_stop_line")), F.col("ok")))
        .drop("_stop_line")
    )


# ------------------------------------------------------------------ reports


def identity_columns(rows: DataFrame) -> DataFrame:
    """Add root_id, root_label and project_hash where the input has none."""
    have = set(rows.columns)
    defaults = {
        "root_id": F.lit(LEGACY_ROOT),
        "root_label": F.lit(None).cast("string"),
        "project_hash": F.lit("unknown"),
        "project_name": F.lit(None).cast("string"),
        "model": F.lit(None).cast("string"),
        "permission_mode": F.lit(None).cast("string"),
    }
    return rows.withColumns({k: v for k, v in defaults.items() if k not in have})


def session_snapshots(
    events: DataFrame,
    outcomes: DataFrame | None = None,
    *,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    cutoff: bool = False,
    metrics: Sequence[str] | None = None,
    registry: M.MetricRegistry | None = None,
    cfg: MetricConfig = DEFAULTS,
    stop: Sequence[Phrase] = STOP_PHRASES,
    loop: Sequence[Phrase] = LOOP_PHRASES,
) -> DataFrame:
    """All metric columns of every session with an event in the window."""
    seen = in_window(events, start, end, cutoff=cutoff)
    if outcomes is not None:
        held = outcomes
        if cutoff and end is not None:
            held = outcomes_until(outcomes, events, [("", end)]).drop("window")
        stats = N.parse_stats(held, window=cfg.confidence_window)
    else:
        stats = None
    return M.snapshots(
        seen, stats, metrics=metrics, registry=registry, cfg=cfg, stop=stop, loop=loop
    )


def session_reports(
    events: DataFrame,
    outcomes: DataFrame | None = None,
    *,
    identity: DataFrame | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    cutoff: bool = False,
    metrics: Sequence[str] | None = None,
    registry: M.MetricRegistry | None = None,
    cfg: MetricConfig = DEFAULTS,
    stop: Sequence[Phrase] = STOP_PHRASES,
    loop: Sequence[Phrase] = LOOP_PHRASES,
    labels: bool = True,
    wide: DataFrame | None = None,
    extras: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """One report per session with at least one event in the window.

    ``wide`` may hold what :func:`session_snapshots` gave for the same options, ``extras``
    the computed rows of user metrics.

    ``identity`` may give session_key -> session_id, root and project columns,
    model and permission mode.
    """
    seen = in_window(events, start, end, cutoff=cutoff)
    if wide is None:
        wide = session_snapshots(
            events, outcomes, start=start, end=end, cutoff=cutoff, metrics=metrics, registry=registry, cfg=cfg, stop=stop, loop=loop
        )
    chosen = [m for m in (registry or M.MetricRegistry()).select(metrics) if m in M.METRICS]
    rows = wide.withColumn("metrics", M.report_map(chosen))
    for name in (registry or M.MetricRegistry()).select(metrics):
        if registry is not None and registry.is_extra(name):
            extra = (extras or {}).get(name)
            extra = registry.compute_extra(name, seen) if extra is None else extra
            extra = extra.select(KEY, F.col("value").alias("_x"))
            rows = rows.join(extra, KEY, "left").withColumn(
                "metrics",
                F.when(
                    F.col("_x").isNotNull(),
                    F.map_concat("metrics", F.create_map(F.lit(name), F.col("_x"))),
                ).otherwise(F.col("metrics")),
            )
            rows = rows.drop("_x")
    if labels:
        rows = beside(rows, T.session_label(T.turns(seen)))
    else:
        rows = rows.withColumns(
            {"n_turns": F.lit(0), "session_task_type": F.lit(None).cast("string")}
        )
    if identity is not None:
        rows = rows.join(identity, KEY, "left")
    return build_report(identity_columns(rows))


def build_report(rows: DataFrame) -> DataFrame:
    """The stored report columns from a row with identity, times and metrics."""
    sid = F.col("session_id") if "session_id" in rows.columns else F.col(KEY)
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        KEY,
        sid.alias("session_id"),
        F.coalesce("root_id", F.lit(LEGACY_ROOT)).alias("root_id"),
        "root_label",
        "project_hash",
        "project_name",
        "model",
        "permission_mode",
        "started_at",
        "ended_at",
        seconds_between(F.col("started_at"), F.col("ended_at")).alias("duration_seconds"),
        "event_count",
        "parse_confidence",
        "metrics",
        "session_task_type",
        "n_turns",
        "last_resolved_at",
    )


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def window_reports(
    events: DataFrame,
    windows: Sequence[tuple[str, dt.datetime, dt.datetime]],
    *,
    outcomes: DataFrame | None = None,
    cutoff: bool = False,
    cfg: MetricConfig = DEFAULTS,
    stop: Sequence[Phrase] = STOP_PHRASES,
    loop: Sequence[Phrase] = LOOP_PHRASES,
) -> DataFrame:
    """Session reports for several overlapping windows, with a ``window`` column."""
    keys = ["window", KEY]
    rows = fan_out_windows(events, windows, cutoff=cutoff)
    stats = None
    if outcomes is not None:
        if cutoff:
            seen = outcomes_until(outcomes, events, [(n, b) for n, _, b in windows])
        else:
            names = F.array(*[F.lit(n) for n, _, _ in windows])
            seen = outcomes.withColumn("window", F.explode(names))
        stats = N.parse_stats(seen, window=cfg.confidence_window, keys=keys)
    wide = M.snapshots(rows, stats, cfg=cfg, stop=stop, loop=loop, keys=keys)
    return wide.select(
        *keys,
        "started_at",
        "ended_at",
        "event_count",
        "parse_confidence",
        M.report_map().alias("metrics"),
    )


def empty_windows(reports: DataFrame, windows: Sequence[str]) -> DataFrame:
    """(window, sessions) for every window, also those without a session."""
    spark = reports.sparkSession
    labels = spark.createDataFrame([(w,) for w in windows], "window string")
    counts = reports.groupBy("window").agg(F.count("*").alias("_n"))
    return labels.join(counts, "window", "left").select(
        "window", F.coalesce("_n", F.lit(0)).alias("sessions")
    )


# ------------------------------------------------- validation and migration


def migrate_reports(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows in the current version, rejected rows with a reason).

    Version 1 rows get the legacy root and a key built from it.
    """
    have = set(raw.columns)
    rows = raw.withColumns({c: F.lit(None) for c in (*REQUIRED, "root_label") if c not in have})
    old = F.col("schema_version") < 2
    rows = rows.withColumns(
        {
            KEY: F.when(old, legacy_session_key(F.col("session_id"))).otherwise(F.col(KEY)),
            "root_id": F.when(old, LEGACY_ROOT).otherwise(F.col("root_id")),
            "root_label": F.when(~old, F.col("root_label")),
        }
    )
    reason = (
        F.when(F.col("schema_version").isNull(), "missing schema_version")
        .when(F.col("schema_version") > SCHEMA_VERSION, "newer schema_version")
        .when(F.col("schema_version") < 1, "unsupported schema_version")
    )
    for name in REQUIRED:
        if name != "schema_version":
            reason = reason.when(F.col(name).isNull(), f"missing {name}")
    rows = rows.withColumn("_reason", reason)
    good = (
        rows.filter(F.col("_reason").isNull())
        .withColumn("schema_version", F.lit(SCHEMA_VERSION))
        .drop("_reason")
    )
    bad = rows.filter(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")
    return good, bad


def migrate_processed(sessions: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-key version 1 processed tables (bare session ids) under the legacy root."""
    new_key = legacy_session_key(F.col("session_id"))
    return (
        sessions.withColumn(KEY, new_key).withColumn("root_id", F.lit(LEGACY_ROOT)),
        metrics.withColumn(KEY, new_key).drop("session_id"),
    )


# ---------------------------------------------------------------- lifecycle


def last_activity(reports: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Latest resolved event time, never before the file's own time."""
    rows = reports
    if files is not None:
        rows = rows.join(files.select(KEY, "file_mtime"), KEY, "left")
    base = F.col("file_mtime") if files is not None else F.lit(None).cast("timestamp")
    return rows.withColumn("last_activity", F.greatest(base, F.col("last_resolved_at")))


def lifecycle_state(
    rows: DataFrame, now: dt.datetime, *, cfg: MetricConfig = DEFAULTS
) -> DataFrame:
    """``silence_seconds`` and ``state`` (active, stale, evicted) at ``now``."""
    silence = seconds_between(F.col("last_activity"), _stamp(now))
    return rows.withColumn("silence_seconds", F.greatest(silence, F.lit(0.0))).withColumn(
        "state",
        F.when(F.col("silence_seconds") >= cfg.evict_after, "evicted")
        .when(F.col("silence_seconds") >= cfg.stale_after, "stale")
        .otherwise("active"),
    )


def fleet_size(states: DataFrame) -> DataFrame:
    """Live sessions and evictions, as one row."""
    return states.agg(
        F.count_if(F.col("state") != "evicted").alias("cohort_size"),
        F.count_if(F.col("state") == "evicted").alias("eviction_churn"),
    )


def needs_root_label(reports: DataFrame) -> DataFrame:
    """One row: whether ids alone are ambiguous (several roots, or a repeated id)."""
    return reports.agg(
        (
            (F.count_distinct("root_id") > 1) | (F.count("*") != F.count_distinct("session_id"))
        ).alias("show_root")
    )


def corpus_unhealthy(reports: DataFrame, floor: float = 0.9) -> DataFrame:
    return reports.agg(
        F.coalesce(F.bool_or(F.col("parse_confidence") < floor), F.lit(False)).alias("unhealthy")
    )
