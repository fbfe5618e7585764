"""Session segments: what a stretch of a session adds to its metrics, composable.

A segment is one row about consecutive rows of a session.  Two neighbouring segments
merge into the segment of both, in any grouping, so a session can be cut anywhere: by
chunk, by micro-batch, by run.  What depends on order is kept as far as a neighbour can
still change it, and that is bounded by the windows of the metrics:

* the last ``window_size`` tool categories and ``confidence_window`` line outcomes;
* edits among the first ``blind_edit_window`` calls whose file was not looked at before
  in the segment, and the looks among its last calls.  All other edits are settled;
* the run of self-corrections at the start, at the end, and the longest;
* the tool counts before the first prompt, the labels of the turns between two prompts,
  and the counts of the turn still open at the end.

:func:`chunk_segments` builds one segment per (session, chunk) with window expressions
and one shuffle; :func:`fold` merges a session's segments as a tree, so a session with
millions of chunks is not one task either.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.model import (
    CHUNK,
    DEFAULTS,
    KEY,
    SEQ,
    TASK_LABELS,
    TURN_LOOKUP_TOOLS,
    TURN_MUTATION_TOOLS,
    MetricConfig,
)

Segment = dict[str, Any]

COUNTS = (
    "event_count calls mutations_total mutations_with_path write_calls blind_mutations messages "
    "messages_with_hit hits loop_matches thinking_blocks visible_blocks prompts total_lines "
    "parsed_events duplicate_count"
).split()
TIMES = ("first_us", "last_us", "resolved_us")
RUNS = ("run_first", "run_last", "run_max")
_TURN = ("calls", "mutations", "bash", "lookups")
HEAD = tuple(f"head_{c}" for c in _TURN)
TAIL = tuple(f"tail_{c}" for c in _TURN)
LENGTHS = ("visible_sizes", "visible_counts", "signature_sizes", "signature_counts")

#: Columns of a segment; ``votes`` counts closed turns by label, in the order of TASK_LABELS.
SEGMENT = ", ".join(
    [f"{KEY} string", f"{CHUNK} long", "from_seq long", "to_seq long"]
    + [f"{c} long" for c in (*COUNTS, *TIMES, *RUNS, *HEAD, *TAIL)]
    + ["tail_keyword string", "votes array<long>", "categories array<string>", "outcomes array<boolean>"]
    + ["look_paths array<string>", "look_backs array<long>", "edit_paths array<string>", "edit_nos array<long>"]
    + [f"{c} array<long>" for c in LENGTHS]
)
FIELDS = [part.split()[0] for part in SEGMENT.split(", ")]
_LISTS = ("votes", "categories", "outcomes", "look_paths", "look_backs", "edit_paths", "edit_nos", *LENGTHS)


# --------------------------------------------------------------------- build


def chunk_segments(rows: DataFrame, cfg: MetricConfig = DEFAULTS) -> DataFrame:
    """Narrow rows (``streaming.live.NARROW``) -> one segment per (session, chunk).

    The first window brings a chunk's rows together; all others partition finer, so
    nothing is shuffled again.  A row of kind ``line`` is the outcome of a line, with
    ``repeated`` true if an earlier line had its message id.
    """
    here, start = [KEY, CHUNK], Window.unboundedPreceding
    order = Window.partitionBy(*here).orderBy(SEQ).rowsBetween(start, 0)
    whole = Window.partitionBy(*here)
    kind, tool, category, path = (F.col(c) for c in ("kind", "tool_name", "category", "file_path"))

    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    marks = {
        "_line": flag(kind == "line"),
        "_call": flag((kind == "tool_call") & tool.isNotNull()),
        "_user": flag(kind == "user"),
        "_said": flag((kind == "assistant") & F.col("loop_hits").isNotNull()),
    }
    rows = rows.withColumns(marks)
    is_line, call, user, said = (F.col(c) for c in marks)
    loop = flag(said & (F.col("loop_hits") > 0))
    number = lambda test: F.sum(test.cast("long")).over(order)
    rows = rows.withColumns(
        {"_n": number(call), "_u": number(user), "_miss": number(said & ~loop), "_l": number(is_line)}
    )
    rows = rows.withColumns(
        {f"_all{c}": F.max(c).over(whole) for c in ("_n", "_u", "_miss", "_l")}
    )
    look = flag(call & category.isin("read", "research") & path.isNotNull())
    edit = flag(call & (category == "mutation") & path.isNotNull())
    of_file = Window.partitionBy(*here, "file_path").orderBy(SEQ).rowsBetween(start, -1)
    rows = rows.withColumns(
        {
            "_look": look,
            "_edit": edit,
            "_seen": F.max(F.when(look, F.col("_n"))).over(of_file),
            "_run": F.sum(loop.cast("long")).over(Window.partitionBy(*here, "_miss")),
            "_vis": F.when((kind == "thinking") & ~flag(F.col("hidden")) & (F.col("visible_len") > 0), F.col("visible_len")),
            "_sig": F.when((kind == "thinking") & (F.col("signature_len") > 0), F.col("signature_len")),
        }
    )
    for size, times in (("_vis", "_vis_n"), ("_sig", "_sig_n")):
        same = Window.partitionBy(*here, size)
        # the count of a length, on the first row that has it
        first = F.row_number().over(same.orderBy(SEQ)) == 1
        rows = rows.withColumn(times, F.when(F.col(size).isNotNull() & first, F.count(size).over(same)))
    of_turn = Window.partitionBy(*here, "_u")
    tools = {
        "calls": call,
        "mutations": call & tool.isin(*TURN_MUTATION_TOOLS),
        "bash": call & (tool == "bash"),
        "lookups": call & tool.isin(*TURN_LOOKUP_TOOLS),
    }
    rows = rows.withColumns({f"_turn_{c}": F.sum(flag(t).cast("long")).over(of_turn) for c, t in tools.items()})
    rows = rows.withColumn("_label", turn_label("_turn_", F.col("keyword_label")))
    back, n, seen = F.col("_all_n") - F.col("_n"), F.col("_n"), F.col("_seen")
    reach = cfg.blind_edit_window
    event = ~is_line
    us = F.unix_micros("ts")
    open_ = F.col("_edit") & seen.isNull() & (n <= reach)
    late = F.col("_edit") & ((seen.isNotNull() & (n - seen > reach)) | (seen.isNull() & (n > reach)))
    near = F.col("_look") & (back < reach)
    closed = user & (F.col("_u") < F.col("_all_u"))

    def listed(test: Column, place: Column, value: Column) -> Column:
        found = F.array_sort(F.collect_list(F.when(test, F.struct(place.alias("p"), value.alias("v")))))
        return F.transform(found, lambda x: x["v"])

    def total(test: Column) -> Column:
        return F.count_if(flag(test))

    at_head, at_tail = F.col("_u") == 0, (F.col("_u") == F.col("_all_u")) & user
    sums = {
        "event_count": total(event),
        "calls": total(call),
        "mutations_total": total(call & (category == "mutation")),
        "mutations_with_path": total(F.col("_edit")),
        "write_calls": total(call & (tool == "write")),
        "blind_mutations": total(late),
        "messages": total(said),
        "messages_with_hit": total(said & (F.col("stop_hits") > 0)),
        "hits": F.sum(F.when(said, F.col("stop_hits"))),
        "loop_matches": F.sum(F.when(said, F.col("loop_hits"))),
        "thinking_blocks": total(kind == "thinking"),
        "visible_blocks": total((kind == "thinking") & ~flag(F.col("hidden"))),
        "prompts": total(user),
        "total_lines": total(is_line),
        "parsed_events": F.sum(F.when(is_line, F.col("line_events"))),
        "duplicate_count": total(is_line & F.col("repeated")),
    }
    aggs = [F.min(SEQ).alias("from_seq"), F.max(SEQ).alias("to_seq")]
    aggs += [F.coalesce(sums[c], F.lit(0)).cast("long").alias(c) for c in COUNTS]
    aggs += [
        F.min_by(us, F.when(event, F.col(SEQ))).alias("first_us"),
        F.max_by(us, F.when(event, F.col(SEQ))).alias("last_us"),
        F.max(F.when(event & F.col("ts_resolved"), us)).alias("resolved_us"),
        F.coalesce(F.max(F.when(said & (F.col("_miss") == 0), F.col("_run"))), F.lit(0)).alias("run_first"),
        F.coalesce(F.max(F.when(said & (F.col("_miss") == F.col("_all_miss")), F.col("_run"))), F.lit(0)).alias("run_last"),
        F.coalesce(F.max(F.when(said, F.col("_run"))), F.lit(0)).alias("run_max"),
    ]
    aggs += [F.coalesce(F.max(F.when(at_head, F.col(f"_turn_{c}"))), F.lit(0)).alias(f"head_{c}") for c in _TURN]
    aggs += [F.coalesce(F.max(F.when(at_tail, F.col(f"_turn_{c}"))), F.lit(0)).alias(f"tail_{c}") for c in _TURN]
    aggs += [
        F.max(F.when(at_tail, F.col("keyword_label"))).alias("tail_keyword"),
        F.array(*[total(closed & (F.col("_label") == label)) for label in TASK_LABELS]).alias("votes"),
        listed(call & (back < cfg.window_size), n, category).alias("categories"),
        listed(is_line & (F.col("_all_l") - F.col("_l") < cfg.confidence_window), F.col("_l"), F.col("line_ok")).alias("outcomes"),
        listed(near, n, path).alias("look_paths"),
        listed(near, n, back).alias("look_backs"),
        listed(open_, n, path).alias("edit_paths"),
        listed(open_, n, n).alias("edit_nos"),
    ]
    for size, times, sizes, counts in (("_vis", "_vis_n", *LENGTHS[:2]), ("_sig", "_sig_n", *LENGTHS[2:])):
        has = F.col(times).isNotNull()
        aggs.append(listed(has, F.col(size), F.col(size).cast("long")).alias(sizes))
        aggs.append(listed(has, F.col(size), F.col(times)).alias(counts))
    return rows.groupBy(*here).agg(*aggs).select(*FIELDS)


def turn_label(prefix: str, keyword: Column) -> Column:
    """A turn's label from its tool counts ``<prefix>calls`` and so on, else from its prompt."""
    calls, edits, bash, lookups = (F.col(f"{prefix}{c}") for c in _TURN)
    return (
        F.when((edits >= 3) & (bash == 0), "mutation_heavy")
        .when((bash >= 1) & (edits >= 1), "debug_loop")
        .when(calls == 0, "planning")
        .when((bash == 0) & (edits < 2) & (lookups > 2 * edits), "exploration")
        .otherwise(F.coalesce(keyword, F.lit("mixed")))
    )


# --------------------------------------------------------------------- merge


def unpack(row: dict[str, Any]) -> Segment:
    """A segment from a row of any source: lists for arrays, None for missing values."""
    out: Segment = {}
    for name in FIELDS:
        value = row.get(name)
        if name in _LISTS:
            out[name] = [] if value is None or isinstance(value, float) else list(value)
        elif value is None or value != value:
            out[name] = 0 if name in COUNTS or name in RUNS or name in HEAD or name in TAIL else None
        else:
            out[name] = value if isinstance(value, str) else int(value)
    if not out["votes"]:
        out["votes"] = [0] * len(TASK_LABELS)
    # JSON knows no numpy types
    for name in ("votes", "look_backs", "edit_nos", *LENGTHS):
        out[name] = [int(x) for x in out[name]]
    out["outcomes"] = [bool(x) for x in out["outcomes"]]
    return out


def _label(turn: tuple[int, ...], keyword: str | None) -> str:
    calls, edits, bash, lookups = turn
    if edits >= 3 and not bash:
        return "mutation_heavy"
    if bash and edits:
        return "debug_loop"
    if not calls:
        return "planning"
    if not bash and edits < 2 and lookups > 2 * edits:
        return "exploration"
    return keyword or "mixed"


def _counts(a: Segment, b: Segment, cfg: MetricConfig) -> Segment:
    return {c: a[c] + b[c] for c in COUNTS if c != "blind_mutations"}


def _times(a: Segment, b: Segment, cfg: MetricConfig) -> Segment:
    return {
        "first_us": b["first_us"] if a["first_us"] is None else a["first_us"],
        "last_us": a["last_us"] if b["last_us"] is None else b["last_us"],
        "resolved_us": max((x["resolved_us"] for x in (a, b) if x["resolved_us"] is not None), default=None),
    }


def _outcomes(a: Segment, b: Segment, cfg: MetricConfig) -> Segment:
    return {"outcomes": (a["outcomes"] + b["outcomes"])[-cfg.confidence_window :]}


def _edits(a: Segment, b: Segment, cfg: MetricConfig) -> Segment:
    """The last calls; edits open at the start of ``b`` meet the looks at the end of ``a``."""
    reach, blind = cfg.blind_edit_window, a["blind_mutations"] + b["blind_mutations"]
    looks: dict[str, int] = {}
    for path, back in zip(a["look_paths"], a["look_backs"]):
        looks[path] = min(back, looks.get(path, back))
    paths, numbers = list(a["edit_paths"]), list(a["edit_nos"])
    for path, no in zip(b["edit_paths"], b["edit_nos"]):
        back = looks.get(path)
        if back is not None and back + no <= reach:
            continue
        if back is None and a["calls"] + no <= reach:
            paths.append(path)
            numbers.append(a["calls"] + no)
        else:
            blind += 1
    later = set(b["look_paths"])
    kept = [(p, n + b["calls"]) for p, n in looks.items() if p not in later and n + b["calls"] < reach]
    return {
        "categories": (a["categories"] + b["categories"])[-cfg.window_size :],
        "blind_mutations": blind,
        "edit_paths": paths,
        "edit_nos": numbers,
        "look_paths": [p for p, _ in kept] + b["look_paths"],
        "look_backs": [n for _, n in kept] + b["look_backs"],
    }


def _runs(a: Segment, b: Segment, cfg: MetricConfig) -> Segment:
    """Runs of self-corrections."""
    return {
        "run_first": a["run_first"] + (b["run_first"] if a["run_first"] == a["messages"] else 0),
        "run_last": b["run_last"] + (a["run_last"] if b["run_last"] == b["messages"] else 0),
        "run_max": max(a["run_max"], b["run_max"], a["run_last"] + b["run_first"]),
    }


def _turns(a: Segment, b: Segment, cfg: MetricConfig) -> Segment:
    """The turn open at the end of ``a`` goes on with ``b`` until the first prompt of ``b``."""
    votes = [x + y for x, y in zip(a["votes"], b["votes"], strict=True)]
    joint = tuple(a[t if a["prompts"] else h] + b[h] for t, h in zip(TAIL, HEAD))
    if a["prompts"]:
        head, tail, keyword = tuple(a[h] for h in HEAD), joint, a["tail_keyword"]
        if b["prompts"]:
            votes[TASK_LABELS.index(_label(joint, a["tail_keyword"]))] += 1
            tail, keyword = tuple(b[t] for t in TAIL), b["tail_keyword"]
    else:
        head, tail, keyword = joint, tuple(b[t] for t in TAIL), b["tail_keyword"]
    return {"votes": votes, "tail_keyword": keyword, **dict(zip(HEAD, head)), **dict(zip(TAIL, tail))}


def _lengths(a: Segment, b: Segment, cfg: MetricConfig) -> Segment:
    out: Segment = {}
    for sizes, counts in (LENGTHS[:2], LENGTHS[2:]):
        sums: Counter = Counter()
        for part in (a, b):
            for size, n in zip(part[sizes], part[counts]):
                sums[size] += n
        out[sizes] = sorted(sums)
        out[counts] = [sums[size] for size in out[sizes]]
    return out


#: What is merged apart from each other: the columns and how two neighbours join.
GROUPS = {
    "counts": (tuple(c for c in COUNTS if c != "blind_mutations"), _counts),
    "times": (TIMES, _times),
    "parse_health": (("outcomes",), _outcomes),
    "read_edit_ratio": (
        ("categories", "blind_mutations", "edit_paths", "edit_nos", "look_paths", "look_backs"),
        _edits,
    ),
    "reasoning_loop": (RUNS, _runs),
    "turns": (("votes", "tail_keyword", *HEAD, *TAIL), _turns),
    "thinking": (LENGTHS, _lengths),
}


def merge(a: Segment, b: Segment, cfg: MetricConfig = DEFAULTS, failed: list[dict[str, str]] | None = None) -> Segment:
    """The segment of ``a`` followed by ``b``.

    With a list ``failed`` a group that raises keeps its values of ``a`` and is noted
    there; the other groups go on.
    """
    out: Segment = {KEY: a[KEY], CHUNK: a[CHUNK], "from_seq": a["from_seq"], "to_seq": b["to_seq"]}
    for name, (columns, join) in GROUPS.items():
        try:
            out.update(join(a, b, cfg))
        except Exception as problem:  # noqa: BLE001 - whatever a broken segment raises
            if failed is None:
                raise
            failed.append({"collector": name, "exception_type": type(problem).__name__})
            out.update({c: a[c] for c in columns})
    return out


# ---------------------------------------------------------------------- fold


def _fold_runs(batches: Iterator[pa.RecordBatch], cfg: MetricConfig) -> Iterator[pa.RecordBatch]:
    """Merge neighbouring rows of one session and group; rows come in order."""
    held: Segment | None = None
    mark: tuple | None = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            here = (row[KEY], row["_group"])
            if here == mark:
                held = merge(held, unpack(row), cfg)
                continue
            if held is not None:
                done.append(held)
            held, mark = unpack(row), here
        yield pa.RecordBatch.from_pylist(done, schema=batch.schema.remove(batch.schema.get_field_index("_group")))
        schema = batch.schema
    if held is not None:
        yield pa.RecordBatch.from_pylist([held], schema=schema.remove(schema.get_field_index("_group")))


def fold(segments: DataFrame, cfg: MetricConfig = DEFAULTS, fan: int = 64) -> DataFrame:
    """One segment per session, merged in levels of ``fan`` chunks; lengths are left out.

    ``segments`` should be a written table: its largest chunk number is asked for.
    """
    empty = F.array().cast("array<long>")
    rows = segments.select(*FIELDS).withColumns({c: empty for c in LENGTHS})
    top = rows.agg(F.max(CHUNK)).first()[0] or 0
    wide = 1
    while True:
        wide *= fan
        placed = rows.withColumn("_group", F.floor(F.col(CHUNK) / wide))
        ordered = placed.repartition(KEY, "_group").sortWithinPartitions(KEY, "_group", "from_seq")
        rows = ordered.mapInArrow(lambda batches: _fold_runs(batches, cfg), SEGMENT)
        if top < wide:
            return rows


def length_medians(segments: DataFrame) -> DataFrame:
    """Per session, the exact medians of the lengths of shown blocks and of signatures."""
    def side(sizes: str, counts: str) -> Column:
        shown = F.lit(sizes == LENGTHS[0]).alias("shown")
        return F.transform(F.arrays_zip(sizes, counts), lambda x: F.struct(shown, x[sizes].alias("size"), x[counts].alias("n")))

    both = segments.select(KEY, F.explode(F.concat(side(*LENGTHS[:2]), side(*LENGTHS[2:]))).alias("x"))
    both = both.select(KEY, "x.*").groupBy(KEY, "shown", "size").agg(F.sum("n").alias("n"))

    def median(shown: bool) -> Column:
        return F.percentile(F.when(F.col("shown") == shown, F.col("size")), 0.5, F.col("n"))

    return both.groupBy(KEY).agg(
        median(True).alias("visible_chars_median"), median(False).alias("signature_chars_median")
    )


def session_columns(folded: DataFrame) -> DataFrame:
    """Counter columns of folded segments, for ``streaming.live.with_metrics``.

    ``closed`` (boolean) says whether the turn still open at the end counts.
    """
    def when(column: str) -> Column:
        return F.timestamp_micros(column)

    tail = F.when(F.col("closed") & (F.col("prompts") > 0), turn_label("tail_", F.col("tail_keyword")))
    votes = F.array(
        *[
            F.struct(
                (F.col("votes")[i] + F.coalesce(tail == label, F.lit(False)).cast("long")).alias("n"),
                F.lit(label).alias("label"),
            )
            for i, label in enumerate(TASK_LABELS)
        ]
    )
    of = lambda name: F.size(F.filter("categories", lambda c: c == name)).cast("long")
    turns = F.aggregate("_votes", F.lit(0).cast("long"), lambda s, v: s + v["n"])
    rows = folded.withColumn("_votes", votes).withColumn("turns", turns).withColumn("_top", F.array_max("_votes"))
    clear = (F.col("turns") >= 2) & (F.col("_top.n") * 2 > F.col("turns"))
    lines = F.size("outcomes")
    ok = F.size(F.filter("outcomes", lambda x: x))
    return rows.withColumns(
        {
            "blind_mutations": F.col("blind_mutations") + F.size("edit_paths"),
            "max_burst": F.col("run_max"),
            "high_water": F.col("to_seq"),
            "reads": of("read"),
            "research": of("research"),
            "mutations": of("mutation"),
            "other": of("other"),
            "window_calls": F.size("categories").cast("long"),
            "started_at": when("first_us"),
            "ended_at": when("last_us"),
            "last_resolved_at": when("resolved_us"),
            "parse_confidence": F.when(lines > 0, ok / lines).otherwise(1.0),
            "session_task_type": F.when(
                F.col("turns") > 0, F.when(clear, F.col("_top.label")).otherwise("mixed")
            ),
        }
    ).drop(
        "_votes", "_top", *RUNS, *TIMES, *HEAD, *TAIL, "tail_keyword", "votes", "categories", "outcomes",
        "look_paths", "look_backs", "edit_paths", "edit_nos", *LENGTHS, "from_seq", "to_seq", "closed", CHUNK,
    )


def session_rows(segments: DataFrame, cfg: MetricConfig = DEFAULTS) -> DataFrame:
    """Sessions from a table of their segments, every turn closed."""
    rows = session_columns(fold(segments, cfg).withColumn("closed", F.lit(True)))
    return rows.join(length_medians(segments), KEY, "left")
