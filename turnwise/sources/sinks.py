"""Writers and the row shapes they write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import variants as V
from turnwise.model import KEY


def iso(ts: Column) -> Column:
    """ISO-8601 with a UTC offset; fractions only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts) % 1_000_000
    return F.concat(
        whole,
        F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""),
        F.lit("+00:00"),
    )


def event_json(event_rows: DataFrame) -> DataFrame:
    """One JSON text per event: kind, payload, session_id, timestamp."""
    kind = F.col("kind")
    said = F.to_json(F.struct("text", "token_count"))
    payload = (
        F.when(kind == "assistant", said)
        .when(kind == "user", F.to_json(F.struct("text")))
        .when(
            kind == "tool_call",
            F.to_json(F.struct("file_path", "input", "tool_name", "tool_use_id")),
        )
        .when(
            kind == "tool_result",
            F.to_json(F.struct("is_error", "output", "tool_use_id", "truncated")),
        )
        .when(
            kind == "thinking",
            F.to_json(F.struct(F.col("thinking_len").alias("length"), "redacted", "signature", "text")),
        )
        .otherwise(
            F.to_json(
                F.to_variant_object(
                    F.map_concat(
                        F.coalesce(V.entries(F.col("system_payload")), F.expr("cast(map() as map<string,variant>)")),
                        F.create_map(F.lit("subkind"), F.col("subkind").cast("variant")),
                    )
                )
            )
        )
    )
    head = F.to_json(F.struct("kind"))
    tail = F.to_json(
        F.struct(F.col("event_session_id").alias("session_id"), iso(F.col("ts")).alias("timestamp"))
    )
    return event_rows.withColumn(
        "json",
        F.concat(
            F.substring(head, F.lit(1), F.length(head) - 1),
            F.lit(',"payload":'),
            payload,
            F.lit(","),
            F.substring(tail, F.lit(2), F.length(tail)),
        ),
    )


def export_events(event_rows: DataFrame, path: str) -> None:
    event_json(event_rows).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def cohort_csv_rows(cells: DataFrame, dimension: str) -> DataFrame:
    """Unguarded cells with six decimals."""
    six = {c: F.format_string("%.6f", c) for c in ("mean", "stdev", "min_value", "max_value")}
    return cells.select(
        F.col("dimension_value").alias(dimension),
        "metric_name",
        six["mean"].alias("mean"),
        six["stdev"].alias("stdev"),
        "n",
        six["min_value"].alias("min"),
        six["max_value"].alias("max"),
    )


def write_cohort_csv(cells: DataFrame, dimension: str, path: str) -> None:
    rows = cohort_csv_rows(cells, dimension).orderBy(dimension, "metric_name")
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_cohort_json(cells: DataFrame, header: DataFrame, path: str) -> None:
    """Cells as JSON lines under ``cells``, the one-row header under ``header``."""
    shaped = cells.select(
        "dimension_value",
        "metric_name",
        "mean",
        "stdev",
        "n",
        F.col("min_value").alias("min"),
        F.col("max_value").alias("max"),
    )
    shaped.orderBy("dimension_value", "metric_name").write.mode("overwrite").json(f"{path}/cells")
    header.withColumn("schema_version", F.lit(1)).write.mode("overwrite").json(f"{path}/header")


def session_report_rows(
    reports: DataFrame,
    snapshot_rows: DataFrame,
    recent: DataFrame | None = None,
    *,
    explain: bool = False,
    with_root: bool = False,
) -> DataFrame:
    """Report row per session with its metric snapshots nested.

    Metrics and recent hits per session are a dozen and at most five rows, so the
    nested lists are small.  Without ``explain`` the notes on hits are left out.
    """
    metric = F.struct(F.col("metric_name").alias("name"), "value", "label", "severity")
    nested = snapshot_rows.groupBy(KEY).agg(F.array_sort(F.collect_list(metric)).alias("metrics"))
    rows = reports.drop("metrics").join(nested, KEY, "left")
    columns = ["session_id", "started_at", "ended_at", "event_count", "parse_confidence", "metrics"]
    if recent is not None:
        hit = F.struct(
            "message_index", "start", "phrase", "category", "matched", "context_snippet", "intent"
        )
        hits = recent.groupBy(KEY).agg(F.array_sort(F.collect_list(hit)).alias("recent_hits"))
        if not explain:
            hits = hits.withColumn(
                "recent_hits", F.transform("recent_hits", lambda h: h.dropFields("intent"))
            )
        rows = rows.join(hits, KEY, "left")
        columns.append("recent_hits")
    if with_root:
        columns += [KEY, "root_id", "root_label"]
    return rows.select(F.lit("session_report").alias("kind"), *columns)


def write_reports_json(rows: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def write_windows_json(window_rows: DataFrame, path: str) -> None:
    write_reports_json(window_rows, path, partition_by=["window"])


def write_drift(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("code").parquet(path)


def write_drift_version(rows: DataFrame, seen: DataFrame, path: str, version: int) -> None:
    """Drift rows of one ingest and the sessions it read; doing it again replaces both."""
    rows.write.mode("overwrite").parquet(f"{path}/rows/version={version:09d}")
    seen.select(KEY).write.mode("overwrite").parquet(f"{path}/seen/version={version:09d}")


def read_drift(spark: SparkSession, path: str) -> DataFrame:
    """Per session, the drift rows of the last ingest that read it; without one, all."""
    rows = spark.read.parquet(f"{path}/rows")
    last = spark.read.parquet(f"{path}/seen").groupBy(KEY).agg(F.max("version").alias("version"))
    held = rows.join(last, [KEY, "version"], "left_semi").select(rows.columns)
    return held.unionByName(rows.filter(F.col(KEY).isNull())).drop("version")


def write_events(event_rows: DataFrame, path: str) -> None:
    """Event table by day, so date bounds prune folders."""
    event_rows.withColumn("event_date", F.to_date("ts")).write.mode("overwrite").partitionBy(
        "event_date"
    ).parquet(path)


def write_snapshots(snapshot_rows: DataFrame, path: str) -> None:
    """Append one tick's metric snapshots as JSON lines."""
    snapshot_rows.withColumn("kind", F.lit("snapshot")).write.mode("append").json(path)
