"""Transcript lines -> typed events, line outcomes and drift rows.

Input of :func:`parse_lines` (see ``sources.lines``): ``session_key, session_id,
line_no, chunk, line, file_mtime`` plus anything the caller wants to keep.

All work on a line is one narrow projection: the line is parsed to VARIANT once,
its content blocks become an array of event structs, and whatever was missing
becomes an array of field names.  Repeated message ids are searched on narrow rows
(session, line, id); the ids that do repeat are joined to the parsed lines, which move
only when those ids are too many to broadcast.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import variants as V
from turnwise.model import (
    BLOCKS_PER_LINE,
    CHUNK,
    KEY,
    KNOWN_SHAPES,
    SEQ,
    STRUCTURAL_KINDS,
    TOOL_ALIASES,
)
from turnwise.operators.ordered import beside, newest

# Wall-clock fallback for timestamps is the file time, so reruns agree.
_ISO = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?"
    r"(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
)

_BLOCK = (
    "array<struct<kind:string,text:string,token_count:bigint,tool_name:string,"
    "tool_name_raw:string,tool_use_id:string,input:variant,file_path:string,output:string,"
    "is_error:boolean,truncated:boolean,thinking_len:int,redacted:boolean,signature:string,"
    "subkind:string,system_payload:variant,missing:array<string>>>"
)

EVENT_COLUMNS = (
    "text token_count tool_name tool_name_raw tool_use_id input file_path output is_error "
    "truncated thinking_len redacted signature subkind system_payload"
).split()

_SYSTEM_ENVELOPE = ("type", "timestamp", "session_id", "subtype", "subkind")


def canonical_tool(raw: Column) -> Column:
    names = ", ".join(f"'{raw_name}', '{name}'" for raw_name, name in TOOL_ALIASES.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({names})"), raw), raw)


def parse_timestamp(text: Column) -> Column:
    return F.when(text.rlike(_ISO), text.try_cast("timestamp"))


# ------------------------------------------------------------------ blocks
#
# Lambdas are evaluated without sharing common subexpressions, so a block goes
# through two of them: the first reads each member once into a typed struct, the
# second builds the event from those plain fields.

_MEMBERS = (
    "type text name id input thinking signature redacted tool_use_id content is_error truncated"
).split()


def _typed_block(block: Column) -> Column:
    """Members of a content block with their types checked."""

    def m(name: str) -> Column:
        return block[name]

    parts = F.transform(V.elements(m("content")), lambda item: V.string(V.field(item, "$.text")))
    return F.struct(
        V.string(m("type")).alias("type"),
        V.string(m("text")).alias("text"),
        V.string(m("name")).alias("name"),
        V.string(m("id")).alias("id"),
        F.when(V.is_object(m("input")), m("input")).alias("input"),
        V.string(m("thinking")).alias("thinking"),
        V.string(m("signature")).alias("signature"),
        F.coalesce(V.boolean(m("redacted")), F.lit(False)).alias("redacted"),
        V.string(m("tool_use_id")).alias("tool_use_id"),
        F.coalesce(V.string(m("content")), F.array_join(parts, "\n")).alias("output"),
        F.when(m("is_error").isNotNull(), V.truthy(m("is_error"))).otherwise(False).alias("is_error"),
        F.when(m("truncated").isNotNull(), V.truthy(m("truncated"))).alias("truncated"),
    )


def _event(missing: Column, **values: Column) -> Column:
    """One event struct; columns not given are null."""
    cols = [values.get(n, F.lit(None)).alias(n) for n in ("kind", *EVENT_COLUMNS)]
    return F.struct(*cols, missing.alias("missing")).cast(_BLOCK[len("array<") : -1])


def _none() -> Column:
    return F.array().cast("array<string>")


def _block_event(b: Column, speaker: Column, usage: Column) -> Column:
    """The event of a typed block, or a struct with no kind that names what is missing.

    Each output column is decided by the block's class, so the struct is built once.
    """
    hidden = b["redacted"] | F.coalesce(b["thinking"] == "[redacted]", F.lit(False))
    by_assistant = speaker == "assistant"
    is_text = b["type"] == "text"
    is_call = by_assistant & (b["type"] == "tool_use")
    is_thought = by_assistant & (b["type"] == "thinking")
    is_result = ~by_assistant & (b["type"] == "tool_result")
    lost = (
        F.when(is_text, F.when(b["text"].isNull(), "text"))
        .when(
            is_call,
            F.when(b["name"].isNull(), "tool_name").when(b["id"].isNull(), "tool_use_id"),
        )
        .when(is_thought, F.when(~hidden & b["thinking"].isNull(), "thinking"))
        .when(is_result, F.when(b["tool_use_id"].isNull(), "tool_use_id"))
        .otherwise("content.type")
    )
    kind = (
        F.when(is_text, speaker)
        .when(is_call, "tool_call")
        .when(is_thought, "thinking")
        .when(is_result, "tool_result")
    )
    shown = F.when(hidden, F.lit("")).otherwise(b["thinking"])
    held = F.when(is_call, F.coalesce(b["input"], F.parse_json(F.lit("{}"))))
    return _event(
        F.when(lost.isNotNull(), F.array(lost))
        .when(is_call & b["input"].isNull(), F.array(F.lit("input")))
        .otherwise(_none()),
        kind=F.when(lost.isNull(), kind),
        text=F.when(is_text, b["text"]).when(is_thought, shown),
        token_count=F.when(is_text & by_assistant, usage),
        tool_name=F.when(is_call, canonical_tool(b["name"])),
        tool_name_raw=F.when(is_call, b["name"]),
        tool_use_id=F.when(is_call, b["id"]).when(is_result, b["tool_use_id"]),
        input=held,
        file_path=F.when(is_call, V.string(V.field(b["input"], "$.file_path"))),
        output=F.when(is_result, b["output"]),
        is_error=F.when(is_result, b["is_error"]),
        truncated=F.when(is_result, b["truncated"]),
        thinking_len=F.when(is_thought, F.length(shown)),
        redacted=F.when(is_thought, hidden),
        signature=F.when(is_thought, b["signature"]),
    )


def _listed(items: Column, speaker: Column, usage: Column) -> Column:
    objects = F.filter(
        F.transform(items, lambda b: V.members(b, *_MEMBERS)), lambda b: b.isNotNull()
    )
    return F.transform(
        F.transform(objects, _typed_block), lambda b: _block_event(b, speaker, usage)
    )


def _flat(kind: Column, text: Column, tool: Column, arguments: Column, result: Column) -> Column:
    """Events of a line that carries its content in top-level keys."""
    by_assistant = kind == "assistant"
    held = F.when(V.is_object(arguments), arguments).otherwise(F.parse_json(F.lit("{}")))
    said = F.when(text.isNotNull(), _event(_none(), kind=kind, text=text))
    called = F.when(
        by_assistant & tool.isNotNull(),
        _event(
            _none(),
            kind=F.lit("tool_call"),
            tool_name=canonical_tool(tool),
            tool_name_raw=tool,
            tool_use_id=F.lit(""),
            input=held,
            file_path=V.string(V.field(arguments, "$.file_path")),
        ),
    )
    returned = F.when(
        ~by_assistant & ~V.is_null(result),
        _event(
            _none(),
            kind=F.lit("tool_result"),
            tool_use_id=F.lit(""),
            is_error=F.lit(False),
            output=F.coalesce(V.string(result), F.to_json(result)),
        ),
    )
    return F.array_compact(F.array(said, called, returned))


def _system(v: Column, subtype: Column, subkind: Column) -> Column:
    name = V.first_truthy(subtype, subkind)
    extras = F.map_filter(V.entries(v), lambda k, _: ~k.isin(*_SYSTEM_ENVELOPE))
    label = F.when(V.truthy(name), F.coalesce(V.string(name), F.lit("unknown")))
    return F.array(
        _event(
            _none(),
            kind=F.lit("system"),
            subkind=F.coalesce(label, F.lit("unknown")),
            system_payload=F.to_variant_object(extras),
        )
    )


# ------------------------------------------------------------------- lines

_TOP = (
    "type role timestamp ts session_id session message content text tool tool_input tool_result "
    "subtype subkind"
).split()


def parse_lines(lines: DataFrame, *, dedup: str = "message") -> DataFrame:
    """One row per non-blank line: class, outcome, event blocks, missing fields.

    ``dedup``: ``message`` drops later lines of a session that repeat a message
    id (the default), ``corpus`` looks at all sessions together, ``block`` and
    ``none`` keep all lines here.
    """
    if dedup not in ("message", "corpus", "block", "none"):
        raise ValueError(f"unknown dedup mode {dedup!r}")
    rows = V.pin(_read_fields(lines))
    rows = V.pin(_classify(rows))
    rows = V.pin(_build_blocks(rows))
    return _settle(_mark_duplicates(rows, lines, dedup))


def _clean(line: Column) -> Column:
    """Valid UTF-8 without white space at the ends."""
    valid = F.make_valid_utf8(line)
    return F.when(valid.startswith("{") & valid.endswith("}"), valid).otherwise(
        F.regexp_replace(valid, r"(?U)^\s+|\s+$", "")
    )


def _read_fields(lines: DataFrame) -> DataFrame:
    """Parse each line once and take the members the normaliser looks at."""
    rows = V.pin(V.pin(lines).withColumn("line", _clean(F.col("line")))).filter(F.length("line") > 0)
    rows = V.pin(rows.withColumn("_v", F.try_parse_json("line")))
    return V.pin(rows.withColumn("_o", V.members(F.col("_v"), *_TOP)))


def _classify(rows: DataFrame) -> DataFrame:
    o = F.col("_o")
    rows = V.pin(
        rows.withColumns(
            {
                "line_kind": F.coalesce(V.string(o["type"]), V.string(o["role"])),
                "_m": V.members(o["message"], "id", "content", "usage"),
                "_list": V.elements(o["content"]),
                "_text": V.string(o["text"]),
                "_tool": V.string(o["tool"]),
                "_stamp": V.first_truthy(o["timestamp"], o["ts"]),
                "_session": V.string(V.first_truthy(o["session_id"], o["session"])),
            }
        )
    )
    kind, talk = F.col("line_kind"), F.col("line_kind").isin("assistant", "user")
    has_flat = F.col("_text").isNotNull() | F.when(
        kind == "assistant", F.col("_tool").isNotNull()
    ).otherwise(~V.is_null(o["tool_result"]))
    line_class = (
        F.when(F.col("_v").isNull(), "malformed")
        .when(o.isNull(), "not_object")
        .when(kind.isNull(), "missing_type")
        .when(kind == "system", "system")
        .when(kind.isin(*STRUCTURAL_KINDS), "structural")
        .when(~talk, "unknown_type")
        .when(F.col("_m").isNotNull(), "message")
        .when(F.col("_list").isNotNull(), "flat_list")
        .when(has_flat, "flat")
        .otherwise("flat_missing")
    )
    stamp = V.string(F.col("_stamp"))
    return rows.withColumns(
        {
            "line_class": line_class,
            "message_id": F.when(talk, V.string(F.col("_m.id"))),
            "_body": V.string(F.col("_m.content")),
            "_usage": V.integer(V.field(F.col("_m.usage"), "$.output_tokens")),
            "_stamp_text": stamp,
            "_parsed_ts": parse_timestamp(stamp),
            "event_session_id": F.when(F.length("_session") > 0, F.col("_session")).otherwise(
                F.col("session_id")
            ),
        }
    )


def _build_blocks(rows: DataFrame) -> DataFrame:
    kind, line_class, o = F.col("line_kind"), F.col("line_class"), F.col("_o")
    rows = rows.withColumn(
        "_items",
        F.when(line_class == "message", V.elements(F.col("_m.content"))).when(
            line_class == "flat_list", F.col("_list")
        ),
    )
    rows = V.pin(rows)
    usage = F.when(line_class == "message", F.col("_usage"))
    one_text = F.array(
        _event(
            _none(),
            kind=kind,
            text=F.col("_body"),
            token_count=F.when(kind == "assistant", F.col("_usage")),
        )
    )
    blocks = (
        F.when((line_class == "message") & F.col("_body").isNotNull(), one_text)
        .when(line_class.isin("message", "flat_list"), _listed(F.col("_items"), kind, usage))
        .when(
            line_class == "flat",
            _flat(kind, F.col("_text"), F.col("_tool"), o["tool_input"], o["tool_result"]),
        )
        .when(line_class == "system", _system(F.col("_v"), o["subtype"], o["subkind"]))
    )
    empty_user = (
        (line_class == "message")
        & (kind == "user")
        & F.col("_body").isNull()
        & (F.size(F.filter(F.coalesce("_items", F.array().cast("array<variant>")), V.is_object)) == 0)
    )
    line_missing = (
        F.when(line_class == "malformed", F.lit("__json__"))
        .when(line_class == "not_object", F.lit("__object__"))
        .when(line_class.isin("missing_type", "unknown_type"), F.lit("type"))
        .when(line_class == "flat_missing", F.lit("message"))
        .when(empty_user, F.lit("text"))
    )
    dispatched = ~line_class.isin("malformed", "not_object", "missing_type")
    no_time = dispatched & (
        V.is_null(F.col("_stamp"))
        | F.coalesce((F.length("_stamp_text") > 0) & F.col("_parsed_ts").isNull(), F.lit(False))
    )
    return rows.withColumns(
        {
            "_blocks": F.coalesce(blocks, F.array().cast(_BLOCK)),
            "ts": F.coalesce("_parsed_ts", "file_mtime"),
            "ts_resolved": F.col("_parsed_ts").isNotNull(),
            "_line_missing": F.when(line_missing.isNotNull(), F.array(line_missing)).otherwise(
                _none()
            ),
            "_no_time": F.when(no_time, F.array(F.lit("timestamp"))).otherwise(_none()),
        }
    ).drop(
        "_o", "_m", "_list", "_text", "_tool", "_stamp", "_session", "_body", "_usage",
        "_stamp_text", "_parsed_ts", "_items",
    )


def _settle(rows: DataFrame) -> DataFrame:
    """Events, missing fields and outcome of a line, now that repeats are known."""
    duplicate, line_class = F.col("duplicate"), F.col("line_class")
    kept = F.filter("_blocks", lambda b: b["kind"].isNotNull())
    lost = F.flatten(F.transform("_blocks", lambda b: b["missing"]))
    rows = V.pin(
        rows.withColumns(
            {
                "blocks": F.when(duplicate, F.array().cast(_BLOCK)).otherwise(kept),
                "missing": F.when(duplicate, F.col("_no_time")).otherwise(
                    F.concat("_no_time", "_line_missing", lost)
                ),
            }
        )
    )
    made = F.size("blocks")
    credited = (
        F.when(duplicate | line_class.isin("structural", "system"), 1)
        .when(line_class.isin("message", "flat_list"), F.greatest(made, F.lit(1)))
        .when(line_class == "flat", made)
        .otherwise(0)
    )
    return rows.withColumns({"parsed_events": credited, "ok": credited > 0}).drop(
        "_blocks", "_line_missing", "_no_time", "_pin"
    )


def _message_ids(lines: DataFrame) -> DataFrame:
    """(session, line, message id) by a narrow parse of the lines that can hold an id.

    A member name is written as it is or with an escape, so other lines are not parsed.
    """
    rows = V.pin(V.pin(lines).withColumn("line", _clean(F.col("line"))))
    rows = V.pin(rows.filter(F.col("line").contains('"id"') | F.col("line").contains("\\u")))
    top = V.members(F.try_parse_json("line"), "type", "role", "message")
    rows = V.pin(rows.select(KEY, "line_no", top.alias("_o")))
    kind = F.coalesce(V.string(F.col("_o.type")), V.string(F.col("_o.role")))
    found = V.string(V.members(F.col("_o.message"), "id")["id"])
    rows = rows.select(KEY, "line_no", F.when(kind.isin("assistant", "user"), found).alias("message_id"))
    return V.pin(rows).drop("_pin").filter(F.col("message_id").isNotNull())


def _mark_duplicates(rows: DataFrame, lines: DataFrame, dedup: str) -> DataFrame:
    """Add ``duplicate``: an earlier line already carried this message id.

    The first line of each id that occurs more than once comes from a plain aggregate
    over narrow rows, which combines map-side however often an id repeats.  Only those
    ids are joined; lines without an id carry a key of their own, so none is hot.
    """
    if dedup in ("none", "block"):
        return rows.withColumn("duplicate", F.lit(False))
    scope = [KEY] if dedup == "message" else []
    firsts = (
        _message_ids(lines)
        .groupBy(*scope, "message_id")
        .agg(F.min(F.struct(KEY, "line_no")).alias("_first"), F.count("*").alias("_n"))
        .filter(F.col("_n") > 1)
        .select(*scope, F.col("message_id").alias("_id"), F.lit(True).alias("_has_id"), "_first")
    )
    own = F.concat_ws("/", KEY, F.col("line_no").cast("string"))
    rows = rows.withColumns(
        {
            "_id": F.coalesce("message_id", own),
            "_has_id": F.col("message_id").isNotNull(),
        }
    )
    here = F.struct(F.col(KEY).alias(KEY), F.col("line_no").alias("line_no"))
    return (
        rows.join(firsts, [*scope, "_id", "_has_id"], "left")
        .withColumn("duplicate", F.coalesce(F.col("_first") != here, F.lit(False)))
        .drop("_id", "_has_id", "_first")
    )


def events(parsed: DataFrame, *, keep: Sequence[str] = (), dedup: str = "message") -> DataFrame:
    """One row per event, in the fixed event schema."""
    rows = parsed.select(
        KEY,
        "session_id",
        "event_session_id",
        CHUNK,
        "line_no",
        *keep,
        "ts",
        "ts_resolved",
        "message_id",
        F.posexplode("blocks").alias("block_no", "_b"),
    )
    out = rows.select(
        KEY,
        "session_id",
        "event_session_id",
        CHUNK,
        "line_no",
        "block_no",
        (F.col("line_no") * BLOCKS_PER_LINE + F.col("block_no")).alias(SEQ),
        *keep,
        "ts",
        "ts_resolved",
        "message_id",
        F.col("_b.kind").alias("kind"),
        *[F.col(f"_b.{c}").alias(c) for c in EVENT_COLUMNS],
    )
    return _drop_repeated_blocks(out) if dedup == "block" else out


def _drop_repeated_blocks(rows: DataFrame) -> DataFrame:
    """Keep the first of identical blocks under one message id."""
    body = F.sha2(
        F.to_json(
            F.struct(
                "kind", "text", "tool_name_raw", "tool_use_id", "output", F.to_json("input").alias("i")
            )
        ),
        256,
    )
    ids = rows.filter(F.col("message_id").isNotNull()).select(
        KEY, SEQ, "message_id", body.alias("_body")
    )
    firsts = ids.groupBy(KEY, "message_id", "_body").agg(F.min(SEQ).alias(SEQ))
    repeats = ids.join(firsts, [KEY, SEQ], "left_anti")
    return rows.join(repeats, [KEY, SEQ], "left_anti")


def line_outcomes(parsed: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    return parsed.select(
        KEY, CHUNK, "line_no", *keep, "ok", "duplicate", "parsed_events", "missing", "line_class"
    )


# ------------------------------------------------------------- parse stats


def parse_stats(outcomes: DataFrame, *, window: int = 200, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Per session: line and event counts, both confidences, missing-field counts."""
    keys = list(keys)
    totals = outcomes.groupBy(*keys).agg(
        F.count("*").alias("total_lines"),
        F.sum("parsed_events").alias("parsed_events"),
        F.count_if("duplicate").alias("duplicate_count"),
        F.least(F.lit(1.0), F.sum("parsed_events") / F.count("*")).alias("session_confidence"),
    )
    said = outcomes.filter(F.col("ok").isNotNull()).select(*keys, CHUNK, "line_no", "ok")
    recent = (
        newest(said, window, keys=keys, order=["line_no"])
        .groupBy(*keys)
        .agg((F.count_if("ok") / F.count("*")).alias("parse_confidence"))
    )
    fields = missing_fields(outcomes, keys=keys).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "n")))).alias(
            "missing_fields"
        )
    )
    return (
        beside(beside(totals, recent, keys), fields, keys)
        .withColumn("parse_confidence", F.coalesce("parse_confidence", F.lit(1.0)))
    )


def missing_fields(outcomes: DataFrame, *, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """(session, field, n): how often each expected field was absent.

    Field names come from a fixed list of about a dozen, so the map built from
    this table per session stays small.
    """
    return (
        outcomes.select(*keys, F.explode("missing").alias("field"))
        .groupBy(*keys, "field")
        .agg(F.count("*").alias("n"))
    )


# ------------------------------------------------------------ fingerprints


def _shape_hash(shape: dict[str, str]) -> str:
    names = sorted(shape)
    text = json.dumps([names, [[n, shape[n]] for n in names]], separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def known_fingerprints(shapes: Iterable[dict[str, str]] = KNOWN_SHAPES) -> list[str]:
    return sorted({_shape_hash(s) for s in shapes})


def _type_name(schema: Column) -> Column:
    digits = F.regexp_extract(schema, r"^DECIMAL\((\d+),(\d+)\)", 1).try_cast("int")
    scale = F.regexp_extract(schema, r"^DECIMAL\((\d+),(\d+)\)", 2).try_cast("int")
    return (
        F.when(schema == "STRING", "str")
        .when(schema == "BIGINT", "int")
        .when((scale == 0) & (digits >= 19), "int")
        .when(schema == "BOOLEAN", "bool")
        .when(schema == "VOID", "NoneType")
        .when(schema.startswith("OBJECT"), "dict")
        .when(schema.startswith("ARRAY"), "list")
        .otherwise("float")
    )


def _json_string(text: Column) -> Column:
    """JSON string literal in ASCII, as hashing needs one fixed spelling."""
    quoted = F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)

    def escape(char: Column) -> Column:
        point = F.ascii(char)
        high = F.shiftright(point - 0x10000, 10) + 0xD800
        low = (point - 0x10000).bitwiseAND(0x3FF) + 0xDC00

        def unit(code: Column) -> Column:
            return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

        return (
            F.when(point < 128, char)
            .when(point < 0x10000, unit(point))
            .otherwise(F.concat(unit(high), unit(low)))
        )

    return (
        F.when(text.rlike(r"^[A-Za-z0-9_.-]*\z"), F.concat(F.lit('"'), text, F.lit('"')))
        .when(quoted.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(quoted, ""), escape), ""))
        .otherwise(quoted)
    )


def fingerprint(v: Column) -> Column:
    """16 hex digits over an object's sorted keys and their JSON types.

    Lambdas share no subexpressions, so each step is a pass of its own: a member's type
    is asked for once, its name quoted once.
    """
    members = F.array_sort(F.transform(F.map_entries(V.entries(v)), lambda e: _member(e["key"], V.json_type(e["value"]))))
    quoted = F.transform(members, lambda m: F.struct(_json_string(m["k"]).alias("q"), _type_name(m["t"]).alias("t")))
    parts = F.transform(
        quoted, lambda m: F.struct(m["q"].alias("q"), F.concat(F.lit("["), m["q"], F.lit(',"'), m["t"], F.lit('"]')).alias("typed"))
    )
    # one array of structs for both lists; taking a field of it is no pass of its own
    whole = F.transform(
        F.array(parts),
        lambda p: F.concat(
            F.lit("[["), F.array_join(p["q"], ","), F.lit("],["), F.array_join(p["typed"], ","), F.lit("]]")
        ),
    )
    return F.left(F.sha2(whole[0], 256), F.lit(16))


def _member(name: Column, schema: Column) -> Column:
    return F.struct(name.alias("k"), schema.alias("t"))


def unknown_fingerprints(
    parsed: DataFrame, *, known: Sequence[str] | None = None, sampled: bool = False
) -> DataFrame:
    """(session, fingerprint, first line, lines): shapes outside the known list.

    Every line is looked at; ``sampled=True`` keeps only the first ten decoded
    lines and every 500th line of a session.
    """
    if "fingerprint" not in parsed.columns:
        parsed = parsed.withColumn("fingerprint", fingerprint(F.col("_v")))
    rows = parsed.filter(~F.col("line_class").isin("malformed", "not_object"))
    if sampled:
        from turnwise.operators.ordered import running_sum

        first = Window.partitionBy(KEY).orderBy("line_no")
        burst = (
            rows.select(KEY, "line_no", "fingerprint")
            .withColumn("_rank", F.row_number().over(first))
            .filter("_rank <= 10")
            .drop("_rank")
        )
        counted = running_sum(
            parsed.select(KEY, CHUNK, "line_no", "line_class", "fingerprint"),
            F.lit(1),
            "_line",
            order=["line_no"],
        )
        stride = counted.filter(
            (F.col("_line") % 500 == 0) & ~F.col("line_class").isin("malformed", "not_object")
        ).select(KEY, "line_no", "fingerprint")
        rows = burst.unionByName(stride)
    known = known_fingerprints() if known is None else list(known)
    return (
        rows.filter(~F.col("fingerprint").isin(*known))
        .groupBy(KEY, "fingerprint")
        .agg(F.min("line_no").alias("first_line_no"), F.countDistinct("line_no").alias("lines"))
    )


# ------------------------------------------------------------------- drift


def unknown_tools(event_rows: DataFrame) -> DataFrame:
    """(session, tool, first seq): tool names outside the canonical list, once each."""
    names = sorted(set(TOOL_ALIASES) | set(TOOL_ALIASES.values()))
    return (
        event_rows.filter((F.col("kind") == "tool_call") & ~F.col("tool_name_raw").isin(*names))
        .groupBy(KEY, F.col("tool_name_raw").alias("tool_name"))
        .agg(F.min(SEQ).alias("first_seq"))
    )


def _drift(df: DataFrame, level: str, code: str, line: Column, **context: Column) -> DataFrame:
    return df.select(
        KEY,
        F.lit(level).alias("level"),
        F.lit("parser").alias("source"),
        F.lit(code).alias("code"),
        line.cast("long").alias("line_no"),
        F.to_json(F.struct(*[c.alias(n) for n, c in context.items()])).alias("context"),
    )


def drift_events(parsed: DataFrame, event_rows: DataFrame) -> DataFrame:
    """Warnings the parser would log, as rows: level, source, code, line, context."""
    line = F.col("line_no")
    by_class = {
        "malformed": ("malformed_line", {"reason": F.lit("invalid JSON")}),
        "not_object": ("malformed_line", {"reason": F.lit("not an object")}),
        "missing_type": ("missing_type", {"reason": F.lit("no type or role")}),
        "unknown_type": ("unknown_type", {"type": F.col("line_kind")}),
        "flat_missing": ("missing_message", {"type": F.col("line_kind")}),
    }
    codes = F.coalesce(
        *[F.when(F.col("line_class") == k, F.lit(code)) for k, (code, _) in by_class.items()]
    )
    reasons = F.coalesce(
        *[
            F.when(F.col("line_class") == k, F.to_json(F.struct(*[c.alias(n) for n, c in ctx.items()])))
            for k, (_, ctx) in by_class.items()
        ]
    )
    lines = parsed.filter(F.col("line_class").isin(*by_class)).select(
        KEY,
        F.lit("warn").alias("level"),
        F.lit("parser").alias("source"),
        codes.alias("code"),
        line.cast("long").alias("line_no"),
        reasons.alias("context"),
    )
    repeats = _drift(
        parsed.filter("duplicate"), "info", "duplicate_message", line, message_id=F.col("message_id")
    )
    shapes = _drift(
        unknown_fingerprints(parsed),
        "warn",
        "unknown_fingerprint",
        F.col("first_line_no"),
        fingerprint=F.col("fingerprint"),
    )
    tools = _drift(
        unknown_tools(event_rows),
        "info",
        "unknown_tool",
        F.floor(F.col("first_seq") / BLOCKS_PER_LINE),
        tool_name=F.col("tool_name"),
    )
    return lines.unionByName(repeats).unionByName(shapes).unionByName(tools)


def typed_field(
    df: DataFrame, payload: str, name: str, expected: str, *, required: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Checked lookup of ``payload.name``; returns (rows with the value, drift rows).

    ``expected`` is a JSON type: string, integer, boolean, object or array.  The
    value is null on a missing key and on a wrong type; both leave a drift row.
    """
    getters = {
        "string": (V.is_string, lambda v: V.string(v)),
        "integer": (lambda v: F.coalesce(V.json_type(v) == "BIGINT", F.lit(False)), V.integer),
        "boolean": (lambda v: F.coalesce(V.json_type(v) == "BOOLEAN", F.lit(False)), V.boolean),
        "object": (V.is_object, lambda v: F.when(V.is_object(v), v)),
        "array": (V.is_array, V.elements),
    }
    matches, get = getters[expected]
    raw = V.field(F.col(payload), f"$.{name}")
    rows = df.withColumn(name, get(raw))
    wrong = df.filter(raw.isNotNull() & ~matches(raw)).select(
        KEY,
        F.lit("warn").alias("level"),
        F.lit("type_mismatch").alias("code"),
        F.lit(name).alias("field"),
        V.json_type(raw).alias("actual"),
    )
    if not required:
        return rows, wrong
    absent = df.filter(raw.isNull()).select(
        KEY,
        F.lit("warn").alias("level"),
        F.lit("missing_required").alias("code"),
        F.lit(name).alias("field"),
        F.lit(None).cast("string").alias("actual"),
    )
    return rows, wrong.unionByName(absent)
