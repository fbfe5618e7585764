"""Whole jobs: normalise once into tables, then compute everything from those."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.model import DEFAULTS, KEY, MetricConfig
from turnwise.operators import metrics as M
from turnwise.operators import normalize as N
from turnwise.operators import reports as R
from turnwise.operators import segments as S
from turnwise.sources import files, sinks
from turnwise.sources.buckets import KeyedTable
from turnwise.sources.lines import index_of, new_lines, quarantine, read_lines, session_identity
from turnwise.streaming.live import narrow_parsed, wide_columns


#: Up to so many changed files are named one by one; beyond, the folder is read and joined.
LISTED_FILES = 100_000


def normalise_to_table(lines: DataFrame, path: str, *, dedup: str = "message") -> DataFrame:
    """Parse the lines once and keep the result as a table.

    Reports read the events about ten times with different columns; from a
    columnar table each of these scans takes only what it needs, while a lazy
    parse would run the JSON work every time.  The raw text is not kept.
    """
    parsed = N.parse_lines(lines, dedup=dedup)
    shaped = parsed.withColumn("fingerprint", N.fingerprint(F.col("_v"))).drop("_v", "line")
    shaped.write.mode("overwrite").parquet(path)
    return lines.sparkSession.read.parquet(path)


def isolated_metrics(
    registry: M.MetricRegistry, names: Sequence[str], events: DataFrame, where: str
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each user metric as a written table of its own, and drift rows of those that fail.

    One that raises, while it is planned or while it runs, costs its own values only.
    """
    spark = events.sparkSession
    found: dict[str, DataFrame] = {}
    failed = []
    for name in names:
        path = f"{where}/{name}"
        try:
            registry.compute_extra(name, events).write.mode("overwrite").parquet(path)
            found[name] = spark.read.parquet(path)
        except Exception as problem:  # noqa: BLE001 - whatever a user metric raises
            context = json.dumps({"collector": name, "exception_type": type(problem).__name__})
            failed.append((None, "error", "collector", "collector_unexpected_exception", None, context))
    schema = f"{KEY} string, level string, source string, code string, line_no long, context string"
    return found, spark.createDataFrame(failed, schema)


# -------------------------------------------------------------- session state


def state_rows(parsed: DataFrame, **options: Any) -> tuple[DataFrame, DataFrame]:
    """(segments, ids) of parsed lines: what a later run or a stream goes on from.

    ids: session, message id and the first line that has it.
    """
    segments = S.chunk_segments(narrow_parsed(parsed, **options))
    ids = parsed.filter(F.col("message_id").isNotNull()).groupBy(KEY, "message_id")
    return segments, ids.agg(F.min("line_no").alias("line_no"))


def read_state(spark: SparkSession, base: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The stored (segments, ids); the stream takes them as ``initial`` and ``known``."""
    return KeyedTable(spark, f"{base}/segments").read(), KeyedTable(spark, f"{base}/ids").read()


def mark_known(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """Lines parsed with ``dedup="none"``, repeats settled against ``known`` and each other.

    A repeated line is one that went well, has one event's credit and gives none.
    """
    lines = parsed.filter(F.col("message_id").isNotNull()).select(KEY, "message_id", "line_no")
    firsts = lines.unionByName(known).groupBy(KEY, "message_id").agg(
        F.min("line_no").alias("_first"), F.max("line_no").alias("_last")
    )
    firsts = firsts.filter(F.col("_first") < F.col("_last")).drop("_last")
    repeats = lines.join(firsts, [KEY, "message_id"]).filter(F.col("line_no") > F.col("_first"))
    repeats = repeats.select(KEY, "line_no", F.lit(True).alias("_repeat"))
    again = F.coalesce("_repeat", F.lit(False))
    rows = parsed.join(repeats, [KEY, "line_no"], "left")
    settled = {
        "blocks": F.when(again, F.filter("blocks", lambda b: F.lit(False))).otherwise(F.col("blocks")),
        "missing": F.when(again, F.filter("missing", lambda m: m == "timestamp")).otherwise(F.col("missing")),
        "parsed_events": F.when(again, 1).otherwise(F.col("parsed_events")),
        "ok": again | F.col("ok"),
        "duplicate": again,
    }
    return rows.withColumns(settled).drop("_repeat")


def advanced(segments: DataFrame, chosen: Sequence[str], cfg: MetricConfig = DEFAULTS) -> DataFrame:
    """Wide session rows, with metrics and label, from all segments of the sessions."""
    rows = wide_columns(S.session_rows(segments, cfg), cfg).filter("event_count > 0")
    return rows.withColumn("metrics", M.report_map(chosen)).withColumn("n_turns", F.nullif("turns", F.lit(0)))


# --------------------------------------------------------------------- ingest


def _renewed(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """Identity of sessions that went on: as stored, else as the new lines say.

    A project that had no name but its hash takes the one the new lines give it.
    """
    names = ["session_id", "root_id", "root_label", "project_hash", "project_name"]
    only = ["model", "permission_mode"]
    old = held.select(KEY, *only, *[F.col(c).alias(f"_{c}") for c in (*names, "file_mtime")])
    rows = fresh.select(KEY, *names, "file_mtime").join(old, KEY, "full")
    unnamed = F.col("_project_name").eqNullSafe(F.left("_project_hash", F.lit(8)))
    settled = {c: F.coalesce(f"_{c}", c) for c in names}
    settled["project_name"] = F.when(unnamed, F.coalesce("project_name", "_project_name")).otherwise(
        F.coalesce("_project_name", "project_name")
    )
    settled["file_mtime"] = F.greatest("_file_mtime", "file_mtime")
    return rows.select(KEY, *only, *[v.alias(c) for c, v in settled.items()])


def _lines_of(spark: SparkSession, todo: DataFrame, paths: str | Sequence[str], roots) -> DataFrame:
    """Whole lines of the files in ``todo``."""
    if todo.count() <= LISTED_FILES:
        # few files: name them to the scan, so that it opens no others
        named = [row.uri for row in todo.select("uri").toLocalIterator()]
        return read_lines(spark, named, roots=roots, partial=False)
    lines = read_lines(spark, paths, roots=roots, partial=False)
    return lines.join(todo.select("path"), "path", "left_semi")


def _parsed(
    spark: SparkSession, todo: DataFrame, paths: Any, roots: Any, where: str, *, done: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(parsed lines, lines without a key); ``done`` limits them to lines past its counts."""
    if todo.count():
        lines = _lines_of(spark, todo, paths, roots)
    else:
        lines = read_lines(spark, paths, roots=roots).filter(F.lit(False))
    lines, bad = quarantine(lines)
    if done is not None:
        lines = new_lines(lines, done)
    return normalise_to_table(lines, where, dedup="message" if done is None else "none"), bad


def ingest(
    spark: SparkSession,
    paths: str | Sequence[str],
    base: str,
    *,
    roots: Sequence[str] | None = None,
    overrides: DataFrame | None = None,
    force: bool = False,
    **options: Any,
) -> dict[str, DataFrame]:
    """Bring the processed tables under ``base`` up to date with the files.

    Only files that are new or changed since the stored record are read, and of one that
    has only grown, only the lines behind those it had are parsed: its sessions go on
    from their stored segments.  That holds for the built-in metrics over whole sessions;
    user metrics and time windows need all events, so then a grown file is parsed whole.
    Tables are written by bucket; running it again without changes rewrites nothing.
    """
    listing = files.list_files(spark, paths)
    sessions_table, metrics_table = (KeyedTable(spark, f"{base}/{n}") for n in ("sessions", "metrics"))
    index_table = KeyedTable(spark, f"{base}/files", keys=["path"])
    segments_table, ids_table = (KeyedTable(spark, f"{base}/{n}") for n in ("segments", "ids"))

    def result() -> dict[str, DataFrame]:
        found = {"sessions": sessions_table.read(), "metrics": metrics_table.read()}
        return {n: df for n, df in found.items() if df is not None}

    stored = sessions_table.read()
    todo = listing if stored is None else files.changed_files(listing, stored, force=force)
    known = sessions_table.versions()
    version = known[-1] + 1 if known else 1
    # versions beyond the last whole run are from one that stopped; they are written again
    index = index_table.as_of(known[-1]) if known else None
    where = f"{base}/changed/version={version:09d}"
    ladder = files.climb(todo, None if force else index)
    todo = todo.join(ladder.drop("size"), "path")
    todo.write.mode("overwrite").parquet(where)
    todo = spark.read.schema(todo.schema).parquet(where)
    if not todo.count():
        return result()
    registry = options.get("registry") or M.MetricRegistry()
    chosen = registry.select(options.get("metrics"))
    plain = not any(registry.is_extra(n) for n in chosen)
    plain = plain and not any(options.get(n) for n in ("start", "end", "cutoff"))
    phrases = {n: options[n] for n in ("stop", "loop") if n in options}
    plain = plain and not phrases and options.get("cfg", DEFAULTS) == DEFAULTS and options.get("labels", True)
    # a file without a whole line so far has no session yet
    begun = index.filter("lines_done > 0") if plain and index is not None else todo.limit(0)
    grown = todo.filter("appended").join(begun.select("path"), "path", "left_semi")
    whole = todo.join(grown.select("path"), "path", "left_anti")

    # ---- files read as a whole
    parsed, bad = _parsed(spark, whole, paths, roots, f"{base}/parsed/version={version:09d}")
    events, outcomes = N.events(parsed), N.line_outcomes(parsed)
    who = session_identity(parsed, overrides, events)
    seen_events = R.in_window(events, options.get("start"), options.get("end"), cutoff=options.get("cutoff", False))
    extras, failed = isolated_metrics(
        registry, [n for n in chosen if registry.is_extra(n)], seen_events, f"{base}/extra/version={version:09d}"
    )
    options["metrics"] = [n for n in chosen if n in extras or not registry.is_extra(n)]
    built_in = [m for m in options["metrics"] if m in M.METRICS]
    # computed once, for the reports and for the metrics table, with the same options
    wide = R.session_snapshots(events, outcomes, **{k: v for k, v in options.items() if k != "labels"})
    place = f"{base}/snapshots/version={version:09d}"
    wide.write.mode("overwrite").parquet(place)
    wide = spark.read.parquet(place)
    reports = R.session_reports(
        events, outcomes, identity=who.drop("path", "file_mtime"), wide=wide, extras=extras, **options
    )
    metrics = M.snapshot_rows(wide, chosen=built_in)
    for rows in extras.values():
        metrics = metrics.unionByName(
            rows.withColumns({"severity": F.lit("ok"), "label": F.lit(None).cast("string")})
        )
    segments, ids = state_rows(parsed)
    lines_done = index_of(parsed)
    seen, drift = parsed.select(KEY).distinct(), N.drift_events(parsed, events).unionByName(failed)
    paths_of = who.select(KEY, "path", "file_mtime")

    # ---- files that have only grown
    more = None
    if grown.count():
        at = known[-1]
        tail, worse = _parsed(
            spark, grown, paths, roots, f"{base}/tails/version={version:09d}", done=index.select("path", "lines_done")
        )
        bad = bad.unionByName(worse)
        touched = index.join(grown.select("path"), "path", "left_semi").select(KEY, "path")
        held = stored.join(touched.select(KEY), KEY, "left_semi")
        old_ids = ids_table.as_of(at).join(touched, KEY, "left_semi")
        tail = mark_known(tail, old_ids.select(KEY, "message_id", "line_no"))
        settled = f"{base}/settled/version={version:09d}"
        tail.write.mode("overwrite").parquet(settled)
        tail = spark.read.schema(tail.schema).parquet(settled)
        tail_events = N.events(tail)
        new_segments, new_ids = state_rows(tail)
        before = segments_table.as_of(at).join(touched, KEY, "left_semi")
        all_segments = before.unionByName(new_segments)
        place = f"{base}/advanced/version={version:09d}"
        all_segments.write.mode("overwrite").parquet(place)
        all_segments = spark.read.schema(all_segments.schema).parquet(place)
        rows = advanced(all_segments, built_in)
        identity = _renewed(held, session_identity(tail, overrides, tail_events))
        more = R.build_report(rows.join(identity.drop("file_mtime"), KEY))
        metrics = metrics.unionByName(M.snapshot_rows(rows, chosen=built_in))
        segments = segments.unionByName(all_segments)
        all_ids = old_ids.select(KEY, "message_id", "line_no").unionByName(new_ids)
        ids = ids.unionByName(all_ids.groupBy(KEY, "message_id").agg(F.min("line_no").alias("line_no")))
        counted = index.join(touched, "path", "left_semi").select("path", "lines_done")
        counted = counted.unionByName(index_of(tail)).groupBy("path").agg(F.max("lines_done").alias("lines_done"))
        lines_done = lines_done.unionByName(counted)
        tail_drift = N.drift_events(tail, tail_events)
        held_drift = sinks.read_drift(spark, f"{base}/drift").join(touched, KEY, "left_semi")
        drift = drift.unionByName(held_drift.select(drift.columns)).unionByName(tail_drift)
        seen = seen.unionByName(touched.select(KEY))
        paths_of = paths_of.unionByName(touched.join(identity.select(KEY, "file_mtime"), KEY, "left"))
    if more is not None:
        reports = reports.unionByName(more)

    # ---- tables, the sessions last: a run that stops before is simply done again
    files_now = todo.select("path", "size", "mtime").join(lines_done.withColumnRenamed("lines_done", "lines"), "path", "left")
    sessions = (
        reports.join(paths_of, KEY, "left")
        .join(files_now, "path", "left")
        .withColumn("updated_at", F.current_timestamp())
        .withColumnRenamed("ended_at", "last_event_time")
    )
    place = f"{base}/new/version={version:09d}"
    sessions.write.mode("overwrite").parquet(place)
    sessions = spark.read.schema(sessions.schema).parquet(place)
    kept = todo.select("path", "size", "mtime", "full_blocks", "last_sha", "chain_sha", "rest_sha")
    kept = kept.join(lines_done, "path", "left").withColumn("lines_done", F.coalesce("lines_done", F.lit(0)))
    kept = kept.join(paths_of.select(KEY, "path"), "path", "left")
    touched = seen.distinct()
    index_table.replace(kept, kept, version=version)
    segments_table.replace(segments, touched, version=version)
    ids_table.replace(ids, touched, version=version)
    metrics_table.replace(metrics, sessions, version=version)
    # A version's drift replaces what an earlier version said of the same files.
    sinks.write_drift_version(drift, seen, f"{base}/drift", version)
    bad.select("path", "line_no").write.mode("overwrite").parquet(f"{base}/quarantine/version={version:09d}")
    sessions_table.upsert(sessions, version=version)
    return result()
