"""Per-session quality metrics.

Input everywhere is the ``events`` model: session_key, chunk, seq, kind, ts plus
the payload columns a metric needs.  Anything that does not depend on order is
one ``groupBy`` with partial aggregation; the ordered parts (last calls, blind
edits, bursts) go through ``operators.ordered``.

``keys`` is the grouping identity, by default the session; the multi-window
report passes (window, session).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import bands, text
from turnwise.model import (
    CHUNK,
    DEFAULTS,
    KEY,
    LOOP_PHRASES,
    METRICS,
    MUTATION_TOOLS,
    READ_TOOLS,
    RESEARCH_TOOLS,
    SEQ,
    STOP_PHRASES,
    WRITE_TOOLS,
    MetricConfig,
    Phrase,
)
from turnwise.operators.ordered import beside, longest_run, newest, of_chunks, running_sum

Keys = Sequence[str]


def tool_category(tool: Column) -> Column:
    return (
        F.when(tool.isin(*READ_TOOLS), "read")
        .when(tool.isin(*RESEARCH_TOOLS), "research")
        .when(tool.isin(*MUTATION_TOOLS), "mutation")
        .otherwise("other")
    )


def tool_calls(events: DataFrame, keys: Keys = (KEY,)) -> DataFrame:
    return events.filter((F.col("kind") == "tool_call") & F.col("tool_name").isNotNull()).select(
        *keys, CHUNK, SEQ, "tool_name", "file_path", tool_category(F.col("tool_name")).alias("category")
    )


# --------------------------------------------------------- read/edit ratio


def window_counts(
    events: DataFrame, *, cfg: MetricConfig = DEFAULTS, keys: Keys = (KEY,)
) -> DataFrame:
    """Category counts over each session's last ``window_size`` tool calls."""
    calls = tool_calls(events, keys).select(*keys, CHUNK, SEQ, "category")
    is_cat = {c: F.col("category") == c for c in ("read", "research", "mutation", "other")}
    out = newest(calls, cfg.window_size, keys=keys).groupBy(*keys).agg(
        F.count_if(is_cat["read"]).alias("reads"),
        F.count_if(is_cat["research"]).alias("research"),
        F.count_if(is_cat["mutation"]).alias("mutations"),
        F.count_if(is_cat["other"]).alias("other"),
        F.count("*").alias("window_calls"),
    )
    per = F.greatest(F.col("mutations"), F.lit(1))
    return out.withColumns(
        {
            "classified": F.col("reads") + F.col("research") + F.col("mutations"),
            "read_edit_ratio": F.col("reads") / per,
            "research_mutation_ratio": (F.col("reads") + F.col("research")) / per,
        }
    )


def rolling_ratio(
    events: DataFrame, *, cfg: MetricConfig = DEFAULTS, keys: Keys = (KEY,)
) -> DataFrame:
    """The ratio after every tool call, over the ``window_size`` calls up to it.

    A trailing frame only reaches into earlier chunks for the first rows of a
    chunk.  Each chunk therefore takes along the last ``window_size`` calls that
    precede it and drops them again after the frame has been evaluated.
    """
    keys = list(keys)
    calls = running_sum(
        tool_calls(events, keys).select(*keys, CHUNK, SEQ, "category"), F.lit(1), "call_no", keys=keys
    )
    # Blocks of `span` consecutive calls, each padded with the window before it.
    span = max(4096, 4 * cfg.window_size)
    place = F.col("call_no") - 1
    home = F.floor(place / span)
    spill = (place % span >= span - cfg.window_size + 1)
    padded = calls.withColumn(
        "_block", F.explode(F.when(spill, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    frame = Window.partitionBy(*keys, "_block").orderBy("call_no").rowsBetween(
        1 - cfg.window_size, 0
    )
    count = {
        c: F.sum(F.when(F.col("category") == c, 1).otherwise(0)).over(frame)
        for c in ("read", "research", "mutation")
    }
    out = (
        padded.withColumns({"reads": count["read"], "research": count["research"], "mutations": count["mutation"]})
        .filter(F.col("_block") == home)
        .drop("_block", "category")
    )
    per = F.greatest(F.col("mutations"), F.lit(1))
    return out.withColumns(
        {
            "read_edit_ratio": F.col("reads") / per,
            "research_mutation_ratio": (F.col("reads") + F.col("research")) / per,
        }
    )


def blind_edits(
    events: DataFrame, *, cfg: MetricConfig = DEFAULTS, keys: Keys = (KEY,)
) -> DataFrame:
    """One row per mutation with a path: call number, last read of that path, blind.

    Calls move once, to their (session, chunk); there they get their number and the
    last look at the same file.  Only summaries of a chunk, and of a file in a chunk,
    cross chunks: how many calls came before, and when the file was last looked at.
    """
    keys, start = list(keys), Window.unboundedPreceding
    columns = [*keys, CHUNK, SEQ, "category", "file_path"]
    calls = tool_calls(events, keys).select(*columns)
    looked = F.when(F.col("category").isin("read", "research"), F.col("_n"))
    here = Window.partitionBy(*keys, CHUNK).orderBy(SEQ)
    of_file = Window.partitionBy(*keys, CHUNK, "file_path").orderBy(SEQ).rowsBetween(start, -1)
    local = calls.withColumn("_n", F.row_number().over(here)).withColumn("_seen", F.max(looked).over(of_file))
    # always true: the branches below then ask for the very same shuffle, which runs once
    local = local.filter(F.hash(*columns) >= F.lit(-(1 << 31)))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(start, -1)
    base = local.groupBy(*keys, CHUNK).agg(F.max("_n").alias("_calls"))
    base = base.select(*keys, CHUNK, F.coalesce(F.sum("_calls").over(earlier), F.lit(0)).alias("_base"))
    touched = local.filter(
        F.col("file_path").isNotNull() & F.col("category").isin("read", "research", "mutation")
    )
    chunks = Window.partitionBy(*keys, "file_path").orderBy(CHUNK).rowsBetween(start, -1)
    files = touched.groupBy(*keys, CHUNK, "file_path").agg(F.max(looked).alias("_last"))
    carried = of_chunks(files, base, keys).select(
        *keys, CHUNK, "file_path", "_base", F.max(F.col("_last") + F.col("_base")).over(chunks).alias("_carry")
    )
    rows = touched.filter(F.col("category") == "mutation").join(carried.hint("merge"), [*keys, CHUNK, "file_path"])
    gap = F.col("call_no") - F.col("last_read")
    return (
        rows.withColumn("call_no", F.col("_n") + F.col("_base"))
        .withColumn("last_read", F.coalesce(F.col("_seen") + F.col("_base"), "_carry"))
        .withColumn("blind", gap.isNull() | (gap > cfg.blind_edit_window))
        .drop("category", "_n", "_seen", "_base", "_carry")
    )


def read_edit(
    events: DataFrame, *, cfg: MetricConfig = DEFAULTS, keys: Keys = (KEY,)
) -> DataFrame:
    """The read/edit metric with its details, one row per session with tool calls."""
    keys = list(keys)
    calls = events.filter((F.col("kind") == "tool_call") & F.col("tool_name").isNotNull())
    totals = calls.groupBy(*keys).agg(*_mutation_counts())
    blind = blind_edits(events, cfg=cfg, keys=keys).groupBy(*keys).agg(
        F.count_if("blind").alias("blind_mutations")
    )
    rows = (
        window_counts(events, cfg=cfg, keys=keys)
        .join(totals, keys)
        .join(blind, keys, "left")
        .withColumn("blind_mutations", F.coalesce("blind_mutations", F.lit(0)))
    )
    return rows.withColumns(read_edit_columns(cfg))


def _mutation_counts() -> list[Column]:
    call = F.col("kind") == "tool_call"
    mutation = call & F.col("tool_name").isin(*MUTATION_TOOLS)
    return [
        F.count_if(mutation).alias("mutations_total"),
        F.count_if(mutation & F.col("file_path").isNotNull()).alias("mutations_with_path"),
        F.count_if(call & F.col("tool_name").isin(*WRITE_TOOLS)).alias("write_calls"),
    ]


def read_edit_columns(cfg: MetricConfig = DEFAULTS) -> dict[str, Column]:
    """Derived columns from the read/edit counters; shared with the stream."""
    total = F.col("mutations_total")
    tracked = F.coalesce(F.try_divide("mutations_with_path", total), F.lit(1.0))
    return {
        "edit_calls": total - F.col("write_calls"),
        "tracking_confidence": tracked,
        "blind_edit_rate": F.coalesce(F.try_divide("blind_mutations", total), F.lit(0.0)),
        "blind_edit_label": F.when(tracked < cfg.tracking_floor, "insufficient data"),
        "write_precision": F.try_divide("write_calls", total),
        "read_edit_severity": bands.ratio_severity(F.col("classified"), F.col("read_edit_ratio"), cfg),
        "read_edit_label": bands.ratio_label(F.col("classified"), F.col("read_edit_ratio"), cfg),
    }


# ------------------------------------------------------------ text metrics


def spoken(events: DataFrame, keys: Keys = (KEY,)) -> DataFrame:
    """Assistant messages with text, the unit of both phrase metrics."""
    return events.filter((F.col("kind") == "assistant") & (F.length("text") > 0)).select(
        *keys, CHUNK, SEQ, "text"
    )


def stop_phrases(
    events: DataFrame,
    *,
    phrases: Sequence[Phrase] = STOP_PHRASES,
    cfg: MetricConfig = DEFAULTS,
    keys: Keys = (KEY,),
) -> DataFrame:
    """Share of messages with a marker, hit counts overall and by category."""
    keys = list(keys)
    counted = spoken(events, keys).select(
        *keys, "text", text.hit_counts(F.col("text"), phrases).alias("_stop")
    )
    return counted.groupBy(*keys).agg(*_stop_counts(phrases)).withColumns(stop_columns(cfg))


def _stop_counts(phrases: Sequence[Phrase]) -> list[Column]:
    """Aggregates over ``text`` and ``_stop`` (null on rows that are no message)."""
    categories = sorted({p.category for p in phrases})
    per_category = []
    for c in categories:
        first, *rest = [F.col("_stop")[i] for i, p in enumerate(phrases) if p.category == c]
        per_category.append(F.coalesce(F.sum(sum(rest, first)), F.lit(0)))
    total = text.hit_total(F.col("_stop"))
    return [
        F.count_if(F.length("text") > 0).alias("messages"),
        F.count_if(total > 0).alias("messages_with_hit"),
        F.sum(total).alias("hits"),
        F.map_filter(
            F.map_from_arrays(F.array(*[F.lit(c) for c in categories]), F.array(*per_category)),
            lambda _, n: n > 0,
        ).alias("hits_by_category"),
    ]


def stop_columns(cfg: MetricConfig = DEFAULTS) -> dict[str, Column]:
    return {
        "stop_phrase": F.col("messages_with_hit") / F.greatest(F.col("messages"), F.lit(1)),
        "stop_phrase_severity": bands.stop_severity(F.col("hits"), cfg),
        "stop_phrase_label": F.format_string("%d stop-phrase hit(s)", F.col("hits")),
    }


def phrase_hits(
    events: DataFrame,
    *,
    phrases: Sequence[Phrase] = STOP_PHRASES,
    around: int = 40,
    keys: Keys = (KEY,),
) -> DataFrame:
    """One row per hit: message number, phrase, offsets, matched text and context."""
    keys = list(keys)
    numbered = running_sum(spoken(events, keys), F.lit(1), "message_index", keys=keys)
    return hits_in(numbered, phrases=phrases, around=around, keep=[*keys, CHUNK, SEQ, "message_index"])


def hits_in(
    df: DataFrame, *, phrases: Sequence[Phrase], around: int = 40, keep: Sequence[str]
) -> DataFrame:
    """Phrase hits in the ``text`` column of any table (no shuffle)."""
    body = F.col("text")
    found = df.filter(body.rlike(text.any_pattern(phrases)))
    per_phrase = F.array(
        *[
            F.struct(
                F.lit(p.text).alias("phrase"),
                F.lit(p.category).alias("category"),
                F.lit(p.intent).cast("string").alias("intent"),
                text.hit_spans(body, p).alias("spans"),
            )
            for p in phrases
        ]
    )
    return (
        found.withColumn("_p", F.explode(per_phrase))
        .withColumn("_s", F.explode("_p.spans"))
        .select(
            *keep,
            "_p.phrase",
            "_p.category",
            "_p.intent",
            "_s.start",
            "_s.end",
            F.col("_s.matched").alias("matched"),
            text.snippet(body, F.col("_s.start"), F.col("_s.end"), around).alias("context_snippet"),
        )
    )


def recent_hits(hits: DataFrame, n: int = 5, *, keys: Keys = (KEY,)) -> DataFrame:
    """Each session's last ``n`` hits by (message, start, phrase)."""
    return newest(hits, n, keys=keys, order=["message_index", "start", "phrase"])


def last_intent(hits: DataFrame, *, keys: Keys = (KEY,)) -> DataFrame:
    """The note on each session's most recent hit."""
    return hits.groupBy(*keys).agg(
        F.max_by("intent", F.struct("message_index", "start", "phrase")).alias("intent")
    )


def reasoning_loops(
    events: DataFrame,
    *,
    phrases: Sequence[Phrase] = LOOP_PHRASES,
    cfg: MetricConfig = DEFAULTS,
    keys: Keys = (KEY,),
) -> DataFrame:
    """Self-corrections per 1000 tool calls and the longest run of such messages."""
    keys = list(keys)
    said = (F.col("kind") == "assistant") & (F.length("text") > 0)
    rows = events.filter((F.col("kind") == "tool_call") | said).select(
        *keys, "kind", F.when(said, _loop_hits(phrases)).alias("_loop")
    )
    return (
        rows.groupBy(*keys)
        .agg(*_loop_counts())
        .join(bursts(events, phrases=phrases, keys=keys), keys, "left")
        .withColumn("max_burst", F.coalesce("max_burst", F.lit(0)))
        .withColumns(loop_columns(cfg))
    )


def _loop_hits(phrases: Sequence[Phrase]) -> Column:
    return text.hit_total(text.hit_counts(F.col("text"), phrases))


def _loop_counts() -> list[Column]:
    return [
        F.coalesce(F.sum("_loop"), F.lit(0)).alias("loop_matches"),
        F.count_if(F.col("kind") == "tool_call").alias("tool_calls"),
    ]


def bursts(
    events: DataFrame, *, phrases: Sequence[Phrase] = LOOP_PHRASES, keys: Keys = (KEY,)
) -> DataFrame:
    """Longest run of consecutive messages that contain a phrase (a yes/no test)."""
    hit = F.col("text").rlike(text.any_pattern(phrases))
    rows = spoken(events, keys).select(*keys, CHUNK, SEQ, hit.alias("_said"))
    return longest_run(rows, F.col("_said"), "max_burst", keys=keys)


def loop_columns(cfg: MetricConfig = DEFAULTS) -> dict[str, Column]:
    rate = F.col("loop_matches") * 1000.0 / F.greatest(F.col("tool_calls"), F.lit(1))
    unit = F.when(F.col("tool_calls") < cfg.loop_min_calls, "warming up").otherwise("tool calls")
    return {
        "reasoning_loop": rate,
        "reasoning_loop_severity": bands.loop_severity(F.col("tool_calls"), rate, cfg),
        "reasoning_loop_label": F.format_string("%.1f/1k %s", rate, unit),
    }


# ----------------------------------------------------- thinking and prompts


def thinking(events: DataFrame, *, keys: Keys = (KEY,)) -> DataFrame:
    """Visible and redacted reasoning blocks with exact median lengths.

    ``median`` keeps one counter per distinct length, not per block.
    """
    rows = events.filter(F.col("kind") == "thinking").groupBy(*keys).agg(*_thinking_counts())
    return rows.withColumns(thinking_columns())


def _thinking_counts() -> list[Column]:
    block = F.col("kind") == "thinking"
    shown = block & ~F.coalesce(F.col("redacted"), F.lit(False))
    size = F.when(shown & (F.col("thinking_len") > 0), F.col("thinking_len"))
    sign = F.when(block & (F.length("signature") > 0), F.length("signature"))
    return [
        F.count_if(block).alias("thinking_blocks"),
        F.count_if(shown).alias("visible_blocks"),
        F.median(size).alias("visible_chars_median"),
        F.median(sign).alias("signature_chars_median"),
    ]


def thinking_columns() -> dict[str, Column]:
    some = F.col("thinking_blocks") > 0
    return {
        "redacted_blocks": F.col("thinking_blocks") - F.col("visible_blocks"),
        "thinking": F.coalesce(F.try_divide("visible_blocks", "thinking_blocks"), F.lit(0.0)),
        "thinking_label": F.when(
            some, F.format_string("%d/%d visible", "visible_blocks", "thinking_blocks")
        ).otherwise("no thinking blocks"),
    }


def prompts(events: DataFrame, *, keys: Keys = (KEY,)) -> DataFrame:
    return events.groupBy(*keys).agg(F.count_if(F.col("kind") == "user").alias("prompts"))


# ------------------------------------------------------------ parse health


def parse_health(
    stats: DataFrame, event_counts: DataFrame, *, cfg: MetricConfig = DEFAULTS, keys: Keys = (KEY,)
) -> DataFrame:
    """Band of the rolling parse confidence; field counts only when critical."""
    rows = stats.join(event_counts.select(*keys, "event_count"), list(keys), "left")
    return with_parse_health(rows, cfg)


def with_parse_health(rows: DataFrame, cfg: MetricConfig = DEFAULTS) -> DataFrame:
    bad = bands.health_critical(
        F.col("total_lines"),
        F.coalesce(F.col("event_count"), F.lit(0)),
        F.col("parse_confidence"),
        cfg,
    )
    return rows.withColumns(
        {
            "parse_health": F.col("parse_confidence"),
            "parse_health_severity": F.when(bad, "critical").otherwise("ok"),
            "parse_health_label": F.when(bad, "schema drift detected").otherwise("parse healthy"),
            "missing_fields": F.when(bad, F.col("missing_fields")),
        }
    )


# ------------------------------------------------------- selection and shape


class MetricRegistry:
    """Built-in and user metrics by name.

    A user metric is a function from the events DataFrame to (session_key,
    value); its name has to contain a dot, as ``team.metric``.
    """

    def __init__(self) -> None:
        self._extra: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        if name in METRICS or name in self._extra:
            raise ValueError(f"metric {name!r} is already registered")
        if "." not in name:
            raise ValueError(f"a user metric needs a dotted name, got {name!r}")
        if not callable(fn):
            raise TypeError(f"metric {name!r} is not callable")
        self._extra[name] = fn

    def names(self) -> list[str]:
        return [*METRICS, *self._extra]

    def select(self, wanted: Sequence[str] | None = None) -> list[str]:
        """Validate a selection; ``parse_health`` is always part of it."""
        chosen = list(METRICS if wanted is None else wanted)
        unknown = [n for n in chosen if n not in self.names()]
        if unknown:
            raise ValueError(f"unknown metrics: {', '.join(sorted(unknown))}")
        if len(set(chosen)) != len(chosen):
            raise ValueError("a metric is listed twice")
        return ["parse_health", *[n for n in chosen if n != "parse_health"]]

    def compute_extra(self, name: str, events: DataFrame) -> DataFrame:
        return self._extra[name](events).select(
            KEY, F.lit(name).alias("metric_name"), F.col("value").cast("double").alias("value")
        )

    def is_extra(self, name: str) -> bool:
        return name in self._extra


def snapshots(
    events: DataFrame,
    stats: DataFrame | None = None,
    *,
    metrics: Sequence[str] | None = None,
    registry: MetricRegistry | None = None,
    cfg: MetricConfig = DEFAULTS,
    stop: Sequence[Phrase] = STOP_PHRASES,
    loop: Sequence[Phrase] = LOOP_PHRASES,
    keys: Keys = (KEY,),
) -> DataFrame:
    """Wide per-session row: values, severities, labels and details of every metric.

    All order-free counts of all metrics come from one aggregation over the
    events; only the last calls, the blind edits and the bursts are branches of
    their own.  ``stats`` is ``normalize.parse_stats``; without it the parse
    confidence is 1.  Metrics that were not selected are not planned.
    """
    keys = list(keys)
    chosen = (registry or MetricRegistry()).select(metrics)
    said = (F.col("kind") == "assistant") & (F.length("text") > 0)
    aggs = [
        F.count("*").alias("event_count"),
        F.min_by("ts", SEQ).alias("started_at"),
        F.max_by("ts", SEQ).alias("ended_at"),
        F.max(F.when(F.col("ts_resolved"), F.col("ts"))).alias("last_resolved_at"),
    ]
    counted = {}
    if "prompts" in chosen:
        aggs.append(F.count_if(F.col("kind") == "user").alias("prompts"))
    if "read_edit_ratio" in chosen:
        aggs += _mutation_counts()
    if "stop_phrase" in chosen:
        counted["_stop"] = F.when(said, text.hit_counts(F.col("text"), stop))
        aggs += _stop_counts(stop)
    if "reasoning_loop" in chosen:
        counted["_loop"] = F.when(said, _loop_hits(loop))
        aggs += _loop_counts()
    if "thinking" in chosen:
        aggs += _thinking_counts()
    if "stop_phrase" in chosen:
        # Texts that are not assistant messages do not count as messages.
        counted["text"] = F.when(said, F.col("text"))
    rows = events.withColumns(counted).groupBy(*keys).agg(*aggs)
    if stats is None:
        rows = rows.withColumns(
            {
                "parse_confidence": F.lit(1.0),
                "parse_health": F.lit(1.0),
                "parse_health_severity": F.lit("ok"),
                "parse_health_label": F.lit("parse healthy"),
            }
        )
    else:
        rows = with_parse_health(beside(rows, stats, keys), cfg)
    if "read_edit_ratio" in chosen:
        blind = blind_edits(events, cfg=cfg, keys=keys).groupBy(*keys).agg(
            F.count_if("blind").alias("blind_mutations")
        )
        none = {c: F.coalesce(F.col(c), F.lit(0)) for c in (*_WINDOW_COUNTS, "blind_mutations")}
        ratios = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in _WINDOW_RATIOS}
        rows = (
            beside(beside(rows, window_counts(events, cfg=cfg, keys=keys), keys), blind, keys)
            .withColumns({**none, **ratios})
            .withColumns(read_edit_columns(cfg))
        )
    if "stop_phrase" in chosen:
        rows = rows.withColumns(stop_columns(cfg))
    if "reasoning_loop" in chosen:
        rows = (
            beside(rows, bursts(events, phrases=loop, keys=keys), keys)
            .withColumn("max_burst", F.coalesce("max_burst", F.lit(0)))
            .withColumns(loop_columns(cfg))
        )
    if "thinking" in chosen:
        rows = rows.withColumns(thinking_columns())
    return rows


_WINDOW_COUNTS = ("reads", "research", "mutations", "other", "window_calls", "classified")
_WINDOW_RATIOS = ("read_edit_ratio", "research_mutation_ratio")


def report_map(chosen: Sequence[str] | None = None) -> Column:
    """map<metric, value> under report names, from a wide snapshot row.

    write_precision needs a mutation, the blind rate enough known paths, the
    research ratio a mutation in the window; thinking and prompts are renamed and
    left out when there was nothing to measure.
    """
    chosen = MetricRegistry().select(chosen)
    items: list[tuple[str, Column]] = []
    items.append(("parse_health", F.col("parse_health")))
    if "read_edit_ratio" in chosen:
        items += [
            ("read_edit_ratio", F.col("read_edit_ratio")),
            ("write_precision", F.col("write_precision")),
            ("blind_edit_rate", F.when(F.col("blind_edit_label").isNull(), F.col("blind_edit_rate"))),
            (
                "research_mutation_ratio",
                F.when(F.col("mutations") > 0, F.col("research_mutation_ratio")),
            ),
        ]
    if "stop_phrase" in chosen:
        items.append(("stop_phrase", F.col("stop_phrase")))
    if "reasoning_loop" in chosen:
        items.append(("reasoning_loop", F.col("reasoning_loop")))
    if "thinking" in chosen:
        seen = F.col("thinking_blocks") > 0
        items += [
            ("thinking_visible_ratio", F.when(seen, F.col("thinking"))),
            ("thinking_visible_chars_median", F.when(seen, F.col("visible_chars_median"))),
            ("thinking_signature_chars_median", F.when(seen, F.col("signature_chars_median"))),
        ]
    if "prompts" in chosen:
        items.append(("user_turns", F.when(F.col("prompts") > 0, F.col("prompts"))))
    pairs = F.array(
        *[F.struct(F.lit(n).alias("k"), v.cast("double").alias("v")) for n, v in sorted(items, key=lambda x: x[0])]
    )
    return F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))


def long_metrics(reports: DataFrame, *keep: str) -> DataFrame:
    """(session_key, ..., metric_name, value) from rows with a ``metrics`` map."""
    cols = keep or (KEY,)
    return reports.select(*cols, F.explode("metrics").alias("metric_name", "value"))


def snapshot_rows(wide: DataFrame, *, keys: Keys = (KEY,), chosen: Sequence[str] | None = None) -> DataFrame:
    """Long form with value, severity and label, one row per session and metric."""
    columns = {
        "parse_health": ("parse_health", "parse_health_severity", "parse_health_label"),
        "read_edit_ratio": ("read_edit_ratio", "read_edit_severity", "read_edit_label"),
        "stop_phrase": ("stop_phrase", "stop_phrase_severity", "stop_phrase_label"),
        "reasoning_loop": ("reasoning_loop", "reasoning_loop_severity", "reasoning_loop_label"),
        "thinking": ("thinking", None, "thinking_label"),
        "prompts": ("prompts", None, None),
    }
    names = [n for n in MetricRegistry().select(chosen) if n in columns]
    rows = [
        F.struct(
            F.lit(n).alias("metric_name"),
            F.col(columns[n][0]).cast("double").alias("value"),
            (F.col(columns[n][1]) if columns[n][1] else F.lit("ok")).alias("severity"),
            (
                F.col(columns[n][2])
                if columns[n][2]
                else F.format_string("%d user turns", F.col("prompts"))
            ).alias("label"),
        )
        for n in names
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))


def clamp_while_learning(rows: DataFrame, observed: int, target: int) -> DataFrame:
    """Severity ok and a tagged label until calibration is complete; health keeps its own."""
    if observed >= target:
        return rows
    learning = F.col("metric_name") != "parse_health"
    tag = f"[bootstrap {observed + 1}/{target}]"
    return rows.withColumns(
        {
            "severity": F.when(learning, "ok").otherwise(F.col("severity")),
            "label": F.when(
                learning,
                F.when(F.length("label") > 0, F.concat("label", F.lit(f" {tag}"))).otherwise(tag),
            ).otherwise(F.col("label")),
        }
    )


def value_trend(ticks: DataFrame, *, keys: Keys = (KEY, "metric_name"), order: str = "tick") -> DataFrame:
    """Last three values of a metric per session and the direction of the last step.

    ``ticks`` holds one row per (session, metric, tick).
    """
    keys = list(keys)
    last = newest(ticks.select(*keys, order, "value"), 3, keys=keys, order=[order])
    grouped = last.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(order, "value"))), lambda s: s["value"]
        ).alias("history")
    )
    step = F.when(
        F.size("history") >= 2,
        F.element_at("history", -1) - F.try_element_at("history", F.lit(-2)),
    ).otherwise(0.0)
    return grouped.withColumn("arrow", bands.trend_arrow(step))
