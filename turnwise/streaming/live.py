"""Live sessions: per-session state over a stream of transcript rows.

Two queries follow each other.  The first turns each micro-batch into segments
(:mod:`turnwise.operators.segments`), one row per session and chunk, with plain batch
expressions: JSON parsing, phrase counts, repeated message ids, windows.  The second
keeps a session's state, which is its merged segment, and advances it by the new
segments; it sees a few rows per session and batch, however many lines there were.

Message ids that were seen lie in a table by batch; a segment is the same whenever its
batch is done again, and the state knows its segments by their place, so nothing counts
twice.
"""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from turnwise.functions import text
from turnwise.functions.text import keyword
from turnwise.model import (
    BLOCKS_PER_LINE,
    CHUNK,
    DEFAULTS,
    KEY,
    LOOP_PHRASES,
    SEQ,
    STOP_PHRASES,
    TASK_KEYWORDS,
    MetricConfig,
    Phrase,
)
from turnwise.operators import metrics as M
from turnwise.operators import normalize as N
from turnwise.operators import segments as S
from turnwise.sources import stores
from turnwise.sources.buckets import KeyedTable

# ------------------------------------------------------------------- inputs

#: A row of a bundle: a session's closed chunk with its whole text.
BUNDLE = "session string, chunk long, value string"


def bundle_chunks(lines: DataFrame) -> DataFrame:
    """Lines (session, chunk, line_no, line) -> closed chunks as ``stream_lines`` takes them bundled.

    A chunk's lines are in order of their numbers, each with its line end, as in a file.
    One group is one chunk, whose size the shipper bounds.
    """
    line = F.struct("line_no", F.coalesce("line", F.lit("")).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    text_ = F.concat(F.array_join(ordered, "\n"), F.lit("\n"))
    return lines.groupBy("session", F.col("chunk").cast("long").alias("chunk")).agg(text_.alias("value"))


def stream_lines(
    spark: SparkSession,
    folder: str,
    *,
    max_bytes: int = 256 << 20,
    span: int = 65_536,
    glob: str = "*.jsonl",
    bundled: bool = False,
) -> DataFrame:
    """Closed transcript chunks from a landing folder, as a stream of lines.

    Files are ``<folder>/<session id>/<chunk no>.jsonl``, or any one file in
    ``<folder>/session=<session id>/chunk=<chunk no>/``; the shipper closes a
    chunk at some megabytes and never appends to it.  With ``bundled`` they are
    Parquet files of many sessions' chunks, a row each (``BUNDLE``), so that small
    chunks are not small files.  Line numbers are chunk
    number * 2^22 + line in the chunk, which grows with the session; a chunk or a
    session too large for that stops the stream with an error.
    """
    source = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("maxBytesPerTrigger", str(max_bytes))
    )
    if bundled:
        raw = source.format("parquet").schema(BUNDLE).load(folder)
        session, number = F.col("session"), F.col("chunk")
    else:
        raw = source.format("text").option("wholetext", "true").load(folder)
        path = F.col("_metadata.file_path")
        named = path.rlike(r"/session=[^/]+/chunk=\d+/[^/]+$")
        session = F.when(named, F.regexp_extract(path, r"/session=([^/]+)/chunk=", 1))
        session = F.coalesce(session, F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
        number = F.when(named, F.regexp_extract(path, r"/chunk=(\d+)/[^/]+$", 1))
        number = F.coalesce(number, F.regexp_extract(path, r"(\d+)\.jsonl$", 1)).cast("long")
    rows = raw.select(
        session.alias("session_id"),
        number.alias("_part"),
        F.col("_metadata.file_modification_time").alias("file_mtime"),
        F.posexplode(F.split("value", "\r\n|\n|\r")).alias("_pos", "line"),
    )
    fits = (F.col("_pos") < (1 << 22) - 1) & F.col("_part").between(0, (1 << 16) - 1)
    number = F.shiftleft("_part", 22) + F.col("_pos") + 1
    rows = rows.withColumn(
        "line_no", F.when(fits, number).otherwise(F.raise_error(F.lit("chunk too large to number its lines")))
    )
    return rows.select(
        F.concat(F.lit("root-legacy:"), "session_id").alias(KEY),
        "session_id",
        "line_no",
        F.floor(F.col("line_no") / span).alias(CHUNK),
        "line",
        "file_mtime",
    )


NARROW = (
    f"{KEY} string, {SEQ} long, line_no long, kind string, ts timestamp, ts_resolved boolean, "
    "message_id string, tool_name string, category string, file_path string, stop_hits int, "
    "loop_hits int, visible_len int, signature_len int, hidden boolean, keyword_label string, "
    f"line_ok boolean, line_events long, {CHUNK} long"
)


def _keyword_label(body: Column) -> Column:
    out = F.when(F.lit(False), "mixed")
    for name, words in TASK_KEYWORDS:
        out = out.when(body.rlike(keyword(words)), name)
    return out.otherwise("mixed")


def narrow_events(
    events: DataFrame,
    *,
    stop: Sequence[Phrase] = STOP_PHRASES,
    loop: Sequence[Phrase] = LOOP_PHRASES,
) -> DataFrame:
    """Event rows reduced to what the state needs (no text)."""
    said = (F.col("kind") == "assistant") & (F.length("text") > 0)

    def hits(phrases: Sequence[Phrase]) -> Column:
        return F.when(said, text.hit_total(text.hit_counts(F.col("text"), phrases)))

    have = set(events.columns)
    extra = {
        "line_no": F.floor(F.col(SEQ) / BLOCKS_PER_LINE),
        "message_id": F.lit(None).cast("string"),
        "line_ok": F.lit(None).cast("boolean"),
        "line_events": F.lit(None).cast("long"),
    }
    rows = events.withColumns({k: v for k, v in extra.items() if k not in have})
    return rows.select(
        KEY,
        SEQ,
        "line_no",
        "kind",
        "ts",
        "ts_resolved",
        "message_id",
        "tool_name",
        F.when(F.col("kind") == "tool_call", M.tool_category(F.col("tool_name"))).alias("category"),
        "file_path",
        hits(stop).cast("int").alias("stop_hits"),
        hits(loop).cast("int").alias("loop_hits"),
        F.when(F.col("kind") == "thinking", F.col("thinking_len")).alias("visible_len"),
        F.when(F.col("kind") == "thinking", F.length("signature")).alias("signature_len"),
        F.col("redacted").alias("hidden"),
        F.when(F.col("kind") == "user", _keyword_label(F.coalesce("text", F.lit("")))).alias(
            "keyword_label"
        ),
        "line_ok",
        "line_events",
        F.col(CHUNK).cast("long").alias(CHUNK),
    )


def narrow_lines(lines: DataFrame, **phrases: Any) -> DataFrame:
    """Lines parsed and exploded to narrow rows: one for the line, one per event.

    No joins, so it works on a stream; repeated message ids are found in state.
    """
    parsed = N.parse_lines(lines, dedup="none")
    events = N.events(parsed)
    outcome = parsed.select(
        KEY,
        (F.col("line_no") * BLOCKS_PER_LINE - 1).alias(SEQ),
        "line_no",
        F.lit("line").alias("kind"),
        "ts",
        "ts_resolved",
        "message_id",
        F.col("ok").alias("line_ok"),
        F.col("parsed_events").cast("long").alias("line_events"),
        F.col(CHUNK).cast("long").alias(CHUNK),
    )
    return narrow_events(events, **phrases).unionByName(outcome, allowMissingColumns=True)


def narrow_parsed(parsed: DataFrame, **phrases: Any) -> DataFrame:
    """Narrow rows of lines whose repeats are known already (``normalise_to_table``)."""
    events = narrow_events(N.events(parsed), **phrases).withColumn("repeated", F.lit(False))
    outcome = parsed.select(
        KEY,
        (F.col("line_no") * BLOCKS_PER_LINE - 1).alias(SEQ),
        "line_no",
        F.lit("line").alias("kind"),
        "ts",
        "ts_resolved",
        "message_id",
        F.col("ok").alias("line_ok"),
        F.col("parsed_events").cast("long").alias("line_events"),
        F.col(CHUNK).cast("long").alias(CHUNK),
        F.col("duplicate").alias("repeated"),
    )
    return events.unionByName(outcome, allowMissingColumns=True)


def tombstones(changes: DataFrame) -> DataFrame:
    """Control rows that end a session at once; ``changes`` has session_key and change."""
    return changes.filter(F.col("change") == "DELETE").select(
        KEY, F.lit(2**62).alias(SEQ), F.lit("delete").alias("kind")
    )


# ----------------------------------------------------------------- segments


def _known_ids(spark: SparkSession, base: str, batch_id: int) -> DataFrame | None:
    """Message ids of earlier batches: session, id, first line, bucket."""
    if not stores.versions(spark, f"{base}/ids"):
        return None
    schema = f"{KEY} string, message_id string, line_no long, version int, bucket int"
    held = spark.read.schema(schema).option("basePath", f"{base}/ids").parquet(f"{base}/ids")
    # a batch that is done again does not know its own ids
    return held.filter(F.col("version") < batch_id)


def mark_repeats(rows: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows without those of repeated lines, ids that are new).

    A line repeats if another line, earlier in these rows or in ``known``, has its message
    id.  It stays as a line, as one that went well with one event.  Only ids that do
    repeat are joined to the rows.
    """
    ids = rows.filter(F.col("message_id").isNotNull()).groupBy(KEY, "message_id").agg(
        F.min("line_no").alias("line_no"), F.max("line_no").alias("_last")
    )
    if known is not None:
        before = known.groupBy(KEY, "message_id").agg(F.min("line_no").alias("_before"))
        ids = ids.join(before, [KEY, "message_id"], "left")
    else:
        ids = ids.withColumn("_before", F.lit(None).cast("long"))
    first = F.coalesce("_before", "line_no")
    fresh = ids.filter(F.col("_before").isNull()).select(KEY, "message_id", "line_no")
    several = ids.filter((first != F.col("line_no")) | (first != F.col("_last")))
    several = several.select(KEY, "message_id", first.alias("_first"))
    named = rows.filter(F.col("message_id").isNotNull()).join(several, [KEY, "message_id"], "left")
    named = named.withColumn("repeated", F.coalesce(F.col("_first") != F.col("line_no"), F.lit(False)))
    named = named.filter(~F.col("repeated") | (F.col("kind") == "line")).withColumns(
        {
            "line_ok": F.when(F.col("repeated"), True).otherwise(F.col("line_ok")),
            "line_events": F.when(F.col("repeated"), 1).otherwise(F.col("line_events")),
        }
    )
    plain = rows.filter(F.col("message_id").isNull()).withColumn("repeated", F.lit(False))
    return plain.unionByName(named.drop("_first")), fresh


#: Folders that one batch's ids are dealt to, so that a batch reads those of its sessions.
ID_BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(ID_BUCKETS)).cast("int")


def write_segments(base: str, *, cfg: MetricConfig = DEFAULTS, known: DataFrame | None = None):
    """``foreachBatch`` function: narrow rows of a batch -> its segments, ids and controls.

    All of it is planned as one batch: windows per (session, chunk), no row in Python.
    The version is the batch id; a batch that is done again gives the same segments.
    ``known`` may hold ids (session_key, message_id, line_no) read before the stream.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # parsed once; what follows reads narrow rows, three times
        batch.write.mode("overwrite").parquet(f"{base}/rows")
        batch = spark.read.schema(batch.schema).parquet(f"{base}/rows")
        rows = batch.filter(F.col("kind") != "delete")
        buckets = [r[0] for r in rows.select(_bucket()).distinct().collect()]
        seen = _known_ids(spark, base, batch_id)
        if seen is not None:
            seen = seen.filter(F.col("bucket").isin(buckets)).select(KEY, "message_id", "line_no")
        if known is not None:
            more = known.filter(_bucket().isin(buckets)).select(KEY, "message_id", "line_no")
            seen = more if seen is None else seen.unionByName(more)
        kept, fresh = mark_repeats(rows, seen)
        found = S.chunk_segments(kept, cfg).withColumn("deleted", F.lit(False))
        gone = batch.filter(F.col("kind") == "delete").select(KEY).distinct()
        gone = gone.withColumns({"from_seq": F.lit(2**62), "deleted": F.lit(True)})
        # ids first: a reader of segments may go on as soon as they are there
        stored = fresh.withColumn("bucket", _bucket()).repartition("bucket")
        stored.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/ids/version={batch_id:09d}")
        stores.write_version(found.unionByName(gone, allowMissingColumns=True), f"{base}/segments", batch_id)

    return write


def segment_stream(spark: SparkSession, base: str) -> DataFrame:
    """The segments written under ``base``, as a stream."""
    return spark.readStream.schema(f"{S.SEGMENT}, deleted boolean").parquet(f"{base}/segments/version=*")


def cut_available(rows: DataFrame, base: str, checkpoint: str, **options: Any) -> None:
    """Turn the narrow rows that the source holds now into segments, then stop."""
    stream = (
        rows.writeStream.option("checkpointLocation", f"{checkpoint}/segments")
        .trigger(availableNow=True)
        .foreachBatch(write_segments(base, **options))
        .start()
    )
    stream.awaitTermination()


# -------------------------------------------------------------------- state

OUTPUT = ", ".join(
    [S.SEGMENT, "row_type string", "state string", "closed boolean", "problems string"]
    + ["visible_chars_median double", "signature_chars_median double"]
)


def _median(lengths: list[tuple[int, int]]) -> float | None:
    """Median of (length, count) pairs."""
    lengths = sorted(lengths)
    total = sum(n for _, n in lengths)
    if not total:
        return None

    def at(place: int) -> int:
        for value, n in lengths:
            if place < n:
                return value
            place -= n
        raise IndexError(place)

    return (at((total - 1) // 2) + at(total // 2)) / 2.0


class SessionState(StatefulProcessor):
    """A session as the merged segment of all it has sent, advanced segment by segment.

    ``parts`` holds the segments, those of a call by the place of the first.  One that comes
    late is put in its place and the session is merged again; one that is there already
    changes nothing.  A metric
    that cannot take a segment keeps what it had; the others go on, and ``problems`` of
    the row says which failed.
    """

    def __init__(self, cfg: MetricConfig = DEFAULTS, *, timers: bool = True):
        self.cfg = cfg
        self.timers = timers
        #: metrics that could not take the segments of this call
        self.failed: list[dict[str, str]] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.main = handle.getValueState("main", "segment string, state string")
        self.parts = handle.getMapState("parts", "from_seq long", "segment string")
        self.lengths = handle.getMapState("lengths", "what string, size long", "n long")

    # -- state

    def _load(self) -> tuple[S.Segment | None, str]:
        if not self.main.exists():
            return None, "active"
        text_, state = self.main.get()
        return json.loads(text_), state

    def _save(self, held: S.Segment, state: str) -> None:
        self.main.update((json.dumps(held), state))

    def _bump(self, by: Counter) -> None:
        for key, n in by.items():
            held = self.lengths.getValue(key)[0] if self.lengths.containsKey(key) else 0
            self.lengths.updateValue(key, (int(held) + n,))

    def _stored(self) -> list[S.Segment]:
        """All segments of the session, in the order of their places."""
        parts = (part for _, (text_,) in self.parts.iterator() for part in json.loads(text_))
        return sorted(parts, key=lambda x: x["from_seq"])

    def _take(self, found: list[S.Segment], held: S.Segment | None) -> S.Segment | None:
        """Put segments into their places and merge them into the session.

        What lies behind all that is held cannot be there already; only for the rest are
        the stored segments looked at.  One call stores its segments as one entry.
        """
        self.failed = []
        found = sorted(found, key=lambda x: x["from_seq"])
        end = None if held is None else held["to_seq"]
        late = end is not None and any(x["from_seq"] <= end for x in found)
        stored = self._stored() if late else []
        places, fresh, sizes = {x["from_seq"] for x in stored}, [], Counter()
        for segment in found:
            if segment["from_seq"] in places:
                continue
            places.add(segment["from_seq"])
            for what, values, counts in (("visible", *S.LENGTHS[:2]), ("signature", *S.LENGTHS[2:])):
                for size, n in zip(segment[values], segment[counts]):
                    sizes[what, size] += n
                segment[values], segment[counts] = [], []
            fresh.append(segment)
        if not fresh:
            return held
        self._bump(sizes)
        self.parts.updateValue((fresh[0]["from_seq"],), (json.dumps(fresh),))
        # segments of one call may overlap as well: one that begins before the end so far is late
        if held is not None and fresh[0]["from_seq"] <= held["to_seq"]:
            whole = sorted(stored + fresh, key=lambda x: x["from_seq"])
        else:
            whole = ([] if held is None else [held]) + fresh
        return functools.reduce(lambda a, b: S.merge(a, b, self.cfg, self.failed), whole)

    # -- output

    def _frame(self, row: dict[str, Any]) -> pd.DataFrame:
        return pd.DataFrame([row])

    def _row(self, held: S.Segment, row_type: str, state: str) -> pd.DataFrame:
        by: dict[str, list[tuple[int, int]]] = {"visible": [], "signature": []}
        for (what, size), (n,) in self.lengths.iterator():
            by[what].append((int(size), int(n)))
        out = held | {
            "row_type": row_type,
            "state": state,
            "closed": row_type == "final",
            "problems": json.dumps(self.failed) if self.failed else None,
            "visible_chars_median": _median(by["visible"]),
            "signature_chars_median": _median(by["signature"]),
        }
        return self._frame(out)

    def _finish(self, held: S.Segment) -> pd.DataFrame:
        out = self._row(held, "final", "evicted")
        for state in (self.main, self.parts, self.lengths):
            state.clear()
        return out

    def _schedule(self, held: S.Segment, now_ms: int) -> None:
        if not self.timers:
            return
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        resolved = held["resolved_us"]
        quiet_from = now_ms if resolved is None else min(now_ms, resolved // 1000)
        for wait in (self.cfg.stale_after, self.cfg.evict_after):
            self.handle.registerTimer(max(quiet_from + wait * 1000, now_ms + 1))

    # -- entry points called by Spark

    def _segments(self, frame: pd.DataFrame) -> list[S.Segment]:
        return [S.unpack(row) for row in frame.to_dict("records")]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):
        found, deleted = [], False
        for frame in rows:
            gone = frame["deleted"].fillna(False).astype(bool)
            deleted = deleted or bool(gone.any())
            found += self._segments(frame[~gone])
        before, state = self._load()
        held = self._take(found, before)
        if held is None:
            return
        if deleted:
            yield self._finish(held)
            return
        # only an event with a readable time brings a quiet session back
        if before is None or (held["resolved_us"] or 0) > (before["resolved_us"] or 0):
            state = "active"
        self._save(held, state)
        self._schedule(held, timerValues.getCurrentProcessingTimeInMs() if self.timers else 0)
        yield self._row(held, "live", state)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any):
        held, _ = self._load()
        self.failed = []
        if held is None:
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        if held["resolved_us"] is None:
            # no readable time: the later of the two timers ends the session
            over = not any(True for _ in self.handle.listTimers())
        else:
            over = now - held["resolved_us"] // 1000 >= self.cfg.evict_after * 1000
        if over:
            yield self._finish(held)
        else:
            self._save(held, "stale")
            yield self._row(held, "live", "stale")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """Take over a session: its stored segments, or one row of counters as a segment."""
        if "from_seq" in initialState.columns:
            found = self._segments(initialState)
        else:
            found = [S.unpack(_from_counters(key[0], row)) for row in initialState.to_dict("records")[:1]]
        held = self._take(found, self._load()[0])
        if held is not None:
            self._save(held, "active")

    def close(self) -> None:
        pass


class PackedState(SessionState):
    """The same state between rows of few columns: a segment or a session as JSON text.

    A session's rows come to Python and go back as small frames of their own, whose cost
    is by column; Spark packs and unpacks whole batches.
    """

    def _frame(self, row: dict[str, Any]) -> pd.DataFrame:
        return pd.DataFrame({KEY: [row[KEY]], "row": [json.dumps(row)]})

    def _segments(self, frame: pd.DataFrame) -> list[S.Segment]:
        return [S.unpack(json.loads(text_)) for text_ in frame["segment"]]


def packed(segments: DataFrame) -> DataFrame:
    """Segments as ``PackedState`` takes them; ``deleted`` stays a column where there is one."""
    rest = [c for c in ("deleted",) if c in segments.columns]
    held = F.to_json(F.struct(*[c for c in S.FIELDS if c in segments.columns])).alias("segment")
    return segments.select(KEY, "from_seq", *rest, held)


def _from_counters(key: str, row: dict[str, Any]) -> dict[str, Any]:
    """A segment before all others from a row of counters; what it does not say is empty."""
    tail = []
    for category, name in (("read", "reads"), ("research", "research"), ("mutation", "mutations"), ("other", "other")):
        n = row.get(name)
        tail += [category] * (0 if n is None or n != n else int(n))
    times = {}
    for field, name in zip(S.TIMES, ("started_at", "ended_at", "last_resolved_at"), strict=True):
        at = row.get(name)
        times[field] = None if at is None or at is pd.NaT else at.value // 1000
    return {**row, **times, KEY: key, "chunk": -1, "from_seq": -1, "to_seq": -1, "categories": tail}


# ------------------------------------------------------------------ pipeline


def label_columns(rows: DataFrame, cfg: MetricConfig = DEFAULTS) -> DataFrame:
    """The severities and labels that metric rows are made of, beside ``with_metrics``."""
    rows = rows.withColumn("missing_fields", F.lit(None).cast("map<string,bigint>"))
    return M.with_parse_health(rows, cfg).withColumns({**M.stop_columns(cfg), **M.thinking_columns()})


def wide_columns(rows: DataFrame, cfg: MetricConfig = DEFAULTS) -> DataFrame:
    return label_columns(with_metrics(rows, cfg), cfg)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def live_metrics(
    segments: DataFrame,
    *,
    cfg: MetricConfig = DEFAULTS,
    timers: bool = True,
    initial: DataFrame | None = None,
) -> DataFrame:
    """A stream of segments -> live and final session rows with all metric columns.

    Late segments count like any other and at their own place; a segment that comes twice
    counts once.  ``initial`` are the stored segments of sessions that began before.
    """
    use_rocksdb(segments.sparkSession)
    if initial is not None and "from_seq" in initial.columns:
        initial = packed(initial)
    out = packed(segments).groupBy(KEY).transformWithStateInPandas(
        statefulProcessor=PackedState(cfg, timers=timers),
        outputStructType=StructType.fromDDL(f"{KEY} string, row string"),
        outputMode="Update",
        timeMode="ProcessingTime" if timers else "None",
        **({"initialState": initial.groupBy(KEY)} if initial is not None else {}),
    )
    out = out.select(F.from_json("row", OUTPUT, {"mode": "FAILFAST"}).alias("row")).select("row.*")
    return with_metrics(S.session_columns(out), cfg)


def with_metrics(rows: DataFrame, cfg: MetricConfig = DEFAULTS) -> DataFrame:
    """Ratios, bands and labels from the counters, by the batch column functions."""
    per = F.greatest(F.col("mutations"), F.lit(1))
    rows = rows.withColumns(
        {
            "tool_calls": F.col("calls"),
            "classified": F.col("reads") + F.col("research") + F.col("mutations"),
            "read_edit_ratio": F.col("reads") / per,
            "research_mutation_ratio": (F.col("reads") + F.col("research")) / per,
            "stop_phrase": F.col("messages_with_hit") / F.greatest(F.col("messages"), F.lit(1)),
            "thinking": F.coalesce(F.try_divide("visible_blocks", "thinking_blocks"), F.lit(0.0)),
            "parse_health": F.col("parse_confidence"),
        }
    )
    rows = rows.withColumns({**M.read_edit_columns(cfg), **M.loop_columns(cfg)})
    return rows.withColumn("metrics", M.report_map())


#: Versions of the session table that stay readable.
KEPT_VERSIONS = 8


def merge_batch(base: str, *, keep: int = KEPT_VERSIONS, cfg: MetricConfig = DEFAULTS):
    """``foreachBatch`` function: a tick.

    The batch's snapshots go to the tick log, its latest row per session into the next
    version of the session table, where only the buckets of its sessions are written.
    Both are named by the batch id, so a replayed batch writes the same again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the state advanced once; what follows reads its rows
        batch.write.mode("overwrite").parquet(f"{base}/changes")
        batch = spark.read.schema(batch.schema).parquet(f"{base}/changes")
        if "problems" in batch.columns:
            note = "array<struct<collector:string,exception_type:string>>"
            bad = batch.select(KEY, F.explode(F.from_json("problems", note)).alias("_p"))
            drift = bad.select(
                KEY,
                F.lit("error").alias("level"),
                F.lit("collector").alias("source"),
                F.lit("collector_unexpected_exception").alias("code"),
                F.to_json("_p").alias("context"),
            )
            stores.write_version(drift, f"{base}/drift", batch_id)
            batch = batch.drop("problems")
        # a session has several rows if it goes on and ends in one batch: the last one counts
        order = F.struct((F.col("row_type") == "final").alias("f"), "event_count")
        rows = label_columns(batch, cfg)
        names = ("row_type", "state", "event_count")
        snapshots = M.snapshot_rows(rows, keys=(KEY, *names)).groupBy(KEY, "metric_name")
        snapshots = snapshots.agg(F.max_by(F.struct("value", "severity", "label", *names), order).alias("s"))
        stores.write_version(snapshots.select(KEY, "metric_name", "s.*"), f"{base}/ticks", batch_id)
        stamped = batch.withColumn(
            "updated_at",
            F.struct(F.lit(batch_id).alias("b"), (F.col("row_type") == "final").alias("f"), "event_count"),
        )
        table = KeyedTable(spark, base)
        table.upsert(stamped, version=batch_id + 1)
        table.vacuum(keep)

    return write


def read_ticks(spark: SparkSession, base: str) -> DataFrame:
    """The tick log: tick (batch id), session, metric, value, severity, label, state."""
    held = spark.read.option("basePath", f"{base}/ticks").parquet(f"{base}/ticks")
    return held.withColumnRenamed("version", "tick")


def fleet_by_tick(ticks: DataFrame) -> DataFrame:
    """tick, seen, new, ended, live: the fleet's size and churn.

    A session is live from its first tick until the tick that ends it.  There is one row
    a tick before anything is summed up in order.
    """
    per = ticks.filter(F.col("metric_name") == "parse_health").select(KEY, "tick", "row_type")
    span = per.groupBy(KEY).agg(F.min("tick").alias("tick"))
    begun = span.groupBy("tick").agg(F.count("*").alias("new"))
    seen = per.groupBy("tick").agg(
        F.count("*").alias("seen"), F.count_if(F.col("row_type") == "final").alias("ended")
    )
    rows = seen.join(begun, "tick", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    until = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("live", F.sum(F.col("new") - F.col("ended")).over(until))


def run_available(
    rows: DataFrame,
    base: str,
    checkpoint: str,
    *,
    cfg: MetricConfig = DEFAULTS,
    known: DataFrame | None = None,
    **options: Any,
) -> None:
    """Process what the source holds now, then stop; the checkpoints carry the rest.

    Narrow rows become segments beside the session table, in the folder ``base`` with
    ``-state`` behind its name; the segments then advance the sessions.
    """
    spark = rows.sparkSession
    cut_available(rows, f"{base}-state", checkpoint, cfg=cfg, known=known)
    if not stores.versions(spark, f"{base}-state/segments"):
        return
    stream = (
        live_metrics(segment_stream(spark, f"{base}-state"), cfg=cfg, **options)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{checkpoint}/sessions")
        .trigger(availableNow=True)
        .foreachBatch(merge_batch(base, cfg=cfg))
        .start()
    )
    stream.awaitTermination()
