"""Transcript files -> numbered lines."""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions import variants as V
from turnwise.model import CHUNK, CHUNK_SPAN, KEY, LEGACY_ROOT
from turnwise.operators import reports as R
from turnwise.operators.normalize import parse_timestamp


def _plain_path(path: Column) -> Column:
    """File path without scheme and escapes."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^file:/+", "/")


def session_stem(path: Column) -> Column:
    # only the name is searched, from its start
    return F.regexp_extract(F.substring_index(path, "/", -1), r"^([^/]+?)(?:\.[^./]*)?$", 1)


def file_key(path: Column) -> Column:
    """The file's stem and a mark of its folder; null without a stem."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    stem = F.nullif(session_stem(path), F.lit(""))
    return F.concat(stem, F.lit("@"), F.substring(F.md5(folder), 1, 12))


#: About 200 bytes a row, so at most some 200 MB; at the usual 128 MB a split that
#: is about 128 TB of text.
MAX_BROADCAST_SPLITS = 1_000_000


def _bytes_of(spark: SparkSession, name: str, default: str) -> int:
    value = spark.conf.get(name, default).lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = "".join(c for c in value if c.isdigit())
    return int(digits) * next((units[c] for c in value if c in units), 1)


#: The number of tasks that list many folders.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextlib.contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Inside, a few tasks a core list many folders; by default each folder is a task of its own."""
    before = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, str(8 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(LISTING) if before is None else spark.conf.set(LISTING, before)


def _split_bound(files: DataFrame) -> int:
    """Upper bound on the input splits: one per file and one per full split.

    A split is as large as the setting says unless the input is too small for as many
    as there are cores; names of files stay in the JVM.
    """
    spark = files.sparkSession
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = _bytes_of(spark, "spark.sql.files.maxPartitionBytes", "134217728")
    cost = _bytes_of(spark, "spark.sql.files.openCostInBytes", "4194304")
    count = len(files._jdf.inputFiles())
    asked = spark.conf.get("spark.sql.files.minPartitionNum", None)
    parts = int(asked) if asked else spark.sparkContext.defaultParallelism
    per_part = (size + count * cost) // max(parts, 1)
    return count + size // max(1, min(split, max(cost, per_part)))


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    roots: Sequence[str] | None = None,
    span: int = CHUNK_SPAN,
    glob: str = "*.jsonl",
    partial: bool = True,
) -> DataFrame:
    """One row per line of every transcript under ``paths`` (files, folders, globs).

    Every file is a session of its own: files of one name in different folders have
    different keys.  ``complete`` is false for a last line without its line end, which
    may still be being written; without ``partial`` it is left for a later read.

    Lines are numbered without moving them: Spark's row id already grows in file
    order inside a split, so it is enough to know each split's first id and how
    many lines the file's earlier splits hold.  That is a count per split, one
    small row each, joined back, and no file is one task.  The counts are broadcast
    when the number of splits, known from the file listing, is small enough;
    otherwise the join shuffles.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    with few_listing_tasks(spark):
        files = (
            spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .option("lineSep", "\n")
            .text(paths)
        )
    raw = (
        files.select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("_uri"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.col("_metadata.file_size").alias("_size"),
            F.col("_metadata.file_modification_time").alias("file_mtime"),
            F.monotonically_increasing_id().alias("_id"),
        )
    )
    if _split_bound(files) <= MAX_BROADCAST_SPLITS:
        small = F.broadcast
    else:
        def small(df: DataFrame) -> DataFrame:
            return df
    whole = Window.partitionBy("_uri")
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        raw.groupBy("_uri", "_block")
        .agg(
            F.min("_id").alias("_first"),
            F.count("*").alias("_n"),
            F.sum(F.octet_length("line") + 1).alias("_bytes"),
        )
        .select(
            "_uri",
            "_block",
            "_first",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"),
            F.sum("_n").over(whole).alias("_lines"),
            F.sum("_bytes").over(whole).alias("_ends"),
        )
    )
    rows = raw.join(small(splits), ["_uri", "_block"]).withColumns(
        {
            "line_no": F.col("_id") - F.col("_first") + F.col("_skip") + 1,
            "path": _plain_path(F.col("_uri")),
        }
    )
    # with a line end behind every line, lines and line ends fill the file exactly
    last = (F.col("line_no") == F.col("_lines")) & (F.col("_ends") > F.col("_size"))
    rows = rows.withColumn("complete", ~last)
    if not partial:
        rows = rows.filter("complete")
    rows = rows.withColumn("session_id", session_stem(F.col("path")))
    if roots:
        rows = R.match_roots(rows, roots)
        rows = rows.withColumn("root_id", F.coalesce("root_id", F.lit(LEGACY_ROOT)))
    else:
        rows = rows.withColumns(
            {"root_id": F.lit(LEGACY_ROOT), "root_label": F.lit(None).cast("string")}
        )
    return rows.select(
        R.session_key(F.col("root_id"), file_key(F.col("path"))).alias(KEY),
        "session_id",
        "root_id",
        "root_label",
        "path",
        "line_no",
        "complete",
        F.floor(F.col("line_no") / span).alias(CHUNK),
        "line",
        "file_mtime",
    )


def quarantine(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with a usable key, lines without one)."""
    return lines.filter(F.col(KEY).isNotNull()), lines.filter(F.col(KEY).isNull())


def session_identity(lines: DataFrame, overrides: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """session_key -> id, root, path, file time, project hash and name."""
    heads = lines.groupBy(KEY).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("session_id", "root_id", "root_label", "path")],
        F.max("file_mtime").alias("file_mtime"),
    )
    heads = heads.withColumn("project_hash", R.project_hash(F.col("path")))
    if events is not None:
        events = events.filter(F.col("kind") == "system").join(
            heads.select(KEY, "project_hash"), KEY
        )
    names = R.project_names(heads, events, overrides)
    return heads.join(names, "project_hash", "left")


def first_timestamps(lines: DataFrame) -> DataFrame:
    """Per session, the ``timestamp`` field of its first non-blank line (or null)."""
    stamp = V.string(V.field(F.try_parse_json("line"), "$.timestamp"))
    return (
        lines.filter(F.length(F.trim("line")) > 0)
        .groupBy(KEY)
        .agg(F.min_by(stamp, "line_no").alias("_stamp"))
        .select(KEY, parse_timestamp(F.col("_stamp")).alias("first_ts"))
    )


def started_between(
    lines: DataFrame, start: dt.datetime | None, end: dt.datetime | None
) -> DataFrame:
    """Drop whole sessions whose first line lies outside [start, end]; unknown ones stay."""
    if start is None and end is None:
        return lines
    first = F.col("first_ts")
    outside = F.lit(False)
    if start is not None:
        outside = outside | (first < R._stamp(start))
    if end is not None:
        outside = outside | (first > R._stamp(end))
    dropped = first_timestamps(lines).filter(outside).select(KEY)
    return lines.join(dropped, KEY, "left_anti")


def _complete(lines: DataFrame) -> DataFrame:
    return lines.filter("complete") if "complete" in lines.columns else lines


def new_lines(lines: DataFrame, file_index: DataFrame) -> DataFrame:
    """Complete lines past what ``file_index`` (path, lines_done) says was already read."""
    done = file_index.select("path", "lines_done")
    rows = _complete(lines).join(done, "path", "left")
    return rows.filter(F.col("line_no") > F.coalesce("lines_done", F.lit(0))).drop("lines_done")


def index_of(lines: DataFrame) -> DataFrame:
    """(path, lines_done) after all complete lines given have been read."""
    return _complete(lines).groupBy("path").agg(F.max("line_no").alias("lines_done"))
