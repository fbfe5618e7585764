"""Redaction of text columns, stable id tokens and shifted times."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.model import CHUNK, KEY, SEQ
from turnwise.operators.ordered import running_sum
from turnwise.sources.session import written

REDACTED = "[REDACTED]"
# Fixed value: where shifted sessions start.
BASE_TIME = dt.datetime(2026, 1, 1)

# Home folders, to be replaced by one neutral path.
HOME_PATTERNS = (r"/Users/[^/\s\"']+", r"/home/[^/\s\"']+", r"(?<![A-Za-z0-9_])~(?=/)")
HOME = "/home/user"

# Credentials known by their prefix.
SECRET_PATTERNS = (
    r"sk-[A-Za-z0-9_\-]{16,}",
    r"gh[poasu]_[A-Za-z0-9]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"xox[bporas]-[A-Za-z0-9\-]{10,}",
)

# A word of 32 characters or more, unless the whole run is a commit hash or a UUID.
_WORD = r"[A-Za-z0-9_\-]"
_HEX = r"[0-9a-fA-F]"
_LETTER = r"[\p{L}\p{N}_]"
_START = rf"(?:(?<!{_LETTER})(?=[A-Za-z0-9_])|(?<={_LETTER})(?=-))"
_END = rf"(?:(?<=[A-Za-z0-9_])(?!{_LETTER})|(?<=-)(?={_LETTER}))"
_WHOLE = rf"-*(?!{_WORD}|{_LETTER})"
LONG_TOKEN = (
    rf"{_START}(?![0-9a-f]{{40}}{_WHOLE})"
    rf"(?!{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}{_WHOLE})"
    rf"{_WORD}{{32,}}{_END}"
)

# Fixed value: a project folder and its hash.
PROJECT_SEGMENT = r"((?:\.claude|claude)/projects/)([A-Za-z0-9_\-]{16,})"

#: Rules (pattern, replacement, text that must occur) for tables whose secrets are
#: ``name = "value"`` and mail addresses.
DOCUMENT_RULES = (
    (r'\b(token|secret|key|password)(\s*=\s*)"[^"]+"', r'$1$2"[REDACTED]"', '"'),
    (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[REDACTED]", "@"),
)


def _replace(text: Column, pattern: str, replacement: str, needs: str) -> Column:
    """Replace, but only look for the pattern in texts that contain ``needs``."""
    return F.when(text.contains(needs), F.regexp_replace(text, pattern, replacement)).otherwise(text)


def _step(pattern: str, replacement: str, needs: str):
    return lambda t: _replace(t, pattern, replacement, needs)


def redact(text: Column, *, extra: Sequence[tuple[str, str, str]] = ()) -> Column:
    """Home paths, known secrets, then ``extra`` rules, then any other long token.

    Most texts hold none of these, so a plain substring test (a run of 32 word
    characters for the last rule) comes before each search.  The steps are nested
    in one-element transforms, so every step reads the result of the one before
    once and not a copy of its expression.
    """
    rules = [
        *zip(HOME_PATTERNS, [HOME] * 3, ("/Users/", "/home/", "~/"), strict=True),
        *zip(SECRET_PATTERNS, [REDACTED] * 4, ("sk-", "gh", "AKIA", "xox"), strict=True),
        *extra,
    ]
    out = F.array(text)
    for rule in rules:
        out = F.transform(out, _step(*rule))
    return F.transform(
        out,
        lambda t: F.when(
            t.rlike(rf"{_WORD}{{32}}"), F.regexp_replace(t, LONG_TOKEN, REDACTED)
        ).otherwise(t),
    )[0]


def redact_columns(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    return df.withColumns({c: redact(F.col(c), **options) for c in columns})


def stable_tokens(df: DataFrame, column: str, prefix: str, *, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Add ``<column>_token``: ``prefix-n`` numbered per session by first use.

    The first use of an id is a plain minimum; numbering runs over the distinct
    ids in chunks, and the join back is on (session, id, chunk).
    """
    keys = list(keys)
    used = df.filter(F.col(column).isNotNull())
    first = used.groupBy(*keys, column).agg(
        F.min(F.struct(F.col(SEQ).alias("s"), F.col(CHUNK).alias("c"))).alias("_f")
    )
    order = first.select(*keys, column, F.col("_f.s").alias(SEQ), F.col("_f.c").alias(CHUNK))
    numbered = running_sum(order, F.lit(1), "_n", keys=keys).select(*keys, column, "_n")
    places = used.select(*keys, column, CHUNK).distinct().join(numbered, [*keys, column])
    return (
        df.join(places, [*keys, column, CHUNK], "left")
        .withColumn(
            f"{column}_token", F.when(F.col("_n").isNotNull(), F.concat(F.lit(f"{prefix}-"), F.col("_n")))
        )
        .drop("_n")
    )


def project_tokens(df: DataFrame, *columns: str) -> DataFrame:
    """Rewrite ``projects/<hash>`` segments to ``projects/fixture-n`` per session.

    Numbers follow the first use over all ``columns`` in their order.  A text may name
    several projects, so the segments are numbered as rows and put back by a list of
    the projects named in that row.
    """
    found = F.flatten(
        F.array(
            *(F.coalesce(F.regexp_extract_all(F.col(c), F.lit(PROJECT_SEGMENT), F.lit(2)), F.array().cast("array<string>")) for c in columns)
        )
    )
    named = df.select(KEY, CHUNK, SEQ, F.posexplode(found).alias("_pos", "_hash"))
    first = named.groupBy(KEY, "_hash").agg(
        F.min(F.struct(F.col(SEQ).alias("s"), F.col("_pos").alias("p"), F.col(CHUNK).alias("c"))).alias("_f")
    )
    order = first.select(
        KEY, "_hash", F.col("_f.s").alias(SEQ), F.col("_f.p").alias("_pos"), F.col("_f.c").alias(CHUNK)
    )
    numbered = running_sum(order, F.lit(1), "_n", order=[SEQ, "_pos"]).select(KEY, "_hash", "_n")
    places = named.select(KEY, "_hash", CHUNK).distinct().join(numbered, [KEY, "_hash"])
    per_row = (
        named.select(KEY, CHUNK, SEQ, "_hash")
        .distinct()
        .join(places, [KEY, "_hash", CHUNK])
        .groupBy(KEY, SEQ)
        .agg(F.collect_list(F.struct("_hash", "_n")).alias("_map"))
    )
    rows = df.join(per_row, [KEY, SEQ], "left")

    def swapped(column: str) -> Column:
        return F.aggregate(
            "_map",
            F.col(column),
            lambda acc, m: F.regexp_replace(
                acc,
                F.concat(F.lit(r"((?:\.claude|claude)/projects/)"), m["_hash"], F.lit(r"(?![A-Za-z0-9_\-])")),
                F.concat(F.lit("$1fixture-"), m["_n"].cast("string")),
            ),
        )

    return rows.withColumns({c: F.coalesce(swapped(c), F.col(c)) for c in columns}).drop("_map")


def shift_times(df: DataFrame, *, base: dt.datetime = BASE_TIME, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Move every session to start at ``base``, keeping all distances.

    The first time per (session, chunk) is folded to one start per session and
    joined back by chunk.
    """
    keys = list(keys)
    heads = df.groupBy(*keys, CHUNK).agg(F.min_by("ts", SEQ).alias("_t"), F.min(SEQ).alias("_s"))
    starts = heads.select(
        *keys, CHUNK, F.min_by("_t", "_s").over(Window.partitionBy(*keys)).alias("_start")
    )
    origin = F.lit(base.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    moved = F.timestamp_micros(
        F.unix_micros(origin) + F.unix_micros("ts") - F.unix_micros("_start")
    )
    return df.join(starts, [*keys, CHUNK]).withColumn("ts", moved).drop("_start")


#: String columns of an event, and those that hold JSON.
TEXTS = ("text", "file_path", "output", "signature", "message_id", "session_id", "event_session_id", "tool_name_raw", "subkind")
NESTED = ("input", "system_payload")

# Members whose text is a time to shift or a tool id to replace.
TIME_KEYS = ("timestamp", "ts", "created_at", "updated_at", "time")
TOOL_ID_KEYS = ("tool_use_id", "tool_call_id")


def _shifted_members(text: Column, offset: Column) -> Column:
    """Times under a time member, moved by ``offset`` microseconds, in JSON text."""
    member = r'("(?:' + "|".join(TIME_KEYS) + r')":")(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[^"]*)(")'
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(member), F.lit(2)))

    def move(acc: Column, old: Column) -> Column:
        moved = F.timestamp_micros(F.unix_micros(old.try_cast("timestamp")) + offset)
        new = F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        return F.replace(acc, F.concat(F.lit(':"'), old, F.lit('"')), F.concat(F.lit(':"'), F.coalesce(new, old), F.lit('"')))

    return F.when(F.size(found) > 0, F.aggregate(found, text, move)).otherwise(text)


def _projects_in(column: str) -> Column:
    found = F.regexp_extract_all(F.col(column), F.lit(PROJECT_SEGMENT), F.lit(2))
    return F.coalesce(found, F.array().cast("array<string>"))


def _numbered_projects(column: str, numbers: Column) -> Column:
    """The text with each project's hash replaced by its number, in one pass over its parts."""
    text, pattern = F.col(column), F.lit(PROJECT_SEGMENT)
    between, names = F.split(text, PROJECT_SEGMENT, -1), _projects_in(column)
    heads = F.regexp_extract_all(text, pattern, F.lit(1))
    shown = F.zip_with(heads, names, lambda h, n: F.concat(h, F.lit("fixture-"), F.element_at(numbers, n).cast("string")))
    parts = F.zip_with(F.slice(between, 1, F.size(names)), shown, lambda b, s: F.concat(b, s))
    swapped = F.concat(F.array_join(parts, ""), F.element_at(between, -1))
    return F.when(F.size(names) > 0, swapped).otherwise(text)


def token_context(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """session, seq, _start, _tool, _projects: what a row's ids and times turn into.

    ``rows`` are read once, for narrow rows of a tool id or a project each; all are
    numbered per session by first use in one aggregate.  The result has a row per event,
    so what comes back to the events is one join on a unique key.
    """
    def token(kind: str, value: Column, pos: Column) -> Column:
        return F.struct(F.lit(kind).alias("token"), value.alias("value"), pos.cast("int").alias("pos"))

    named = F.transform(F.flatten(F.array(*map(_projects_in, columns))), lambda v, i: token("project", v, i))
    plain = F.array(token("row", F.lit(None).cast("string"), F.lit(0)))
    own = F.array(token("tool", F.col("tool_use_id"), F.lit(0)))
    tool = F.when(F.col("tool_use_id").isNotNull(), own).otherwise(F.slice(own, 1, 0))
    items = rows.select(KEY, CHUNK, SEQ, "ts", F.explode(F.concat(plain, tool, named)).alias("_t"))
    items = written(items.select(KEY, CHUNK, SEQ, "ts", "_t.*"), "tokens")
    used = items.filter("token <> 'row'")
    first = used.groupBy(KEY, "token", "value").agg(
        F.min(F.struct(F.col(SEQ).alias("s"), F.col("pos").alias("p"), F.col(CHUNK).alias("c"))).alias("_f")
    )
    order = first.select(
        KEY, "token", "value", F.col("_f.s").alias(SEQ), F.col("_f.p").alias("pos"), F.col("_f.c").alias(CHUNK)
    )
    numbered = running_sum(order, F.lit(1), "n", keys=[KEY, "token"], order=[SEQ, "pos"]).select(KEY, "token", "value", "n")
    heads = items.filter("token = 'row'").groupBy(KEY, CHUNK).agg(F.min_by("ts", SEQ).alias("_t"), F.min(SEQ).alias("_s"))
    starts = heads.select(KEY, CHUNK, F.min_by("_t", "_s").over(Window.partitionBy(KEY)).alias("_start"))
    known = used.join(numbered, [KEY, "token", "value"]).groupBy(KEY, CHUNK, SEQ).agg(
        F.max(F.when(F.col("token") == "tool", F.concat(F.lit("tool-"), F.col("n").cast("string")))).alias("_tool"),
        F.map_from_entries(
            F.collect_set(F.when(F.col("token") == "project", F.struct("value", "n")))
        ).alias("_projects"),
    )
    whole = items.filter("token = 'row'").select(KEY, CHUNK, SEQ).join(starts, [KEY, CHUNK])
    return written(whole.join(known, [KEY, CHUNK, SEQ], "left").drop(CHUNK), "token-context")


def anonymize_events(event_rows: DataFrame, **options) -> DataFrame:
    """The event table with every text redacted, ids tokenised and times shifted.

    Projects are numbered over all columns before anything is redacted, nested values
    are rewritten by member name in their JSON text, and a nested value that would no
    longer parse is an error, not a null.  The events are read twice: once for their ids,
    which are numbered and written, and once to be rewritten.
    """
    texts = [c for c in TEXTS if c in event_rows.columns]
    nested = [c for c in NESTED if c in event_rows.columns]
    rows = event_rows.withColumns({c: F.to_json(c) for c in nested})
    rows = rows.join(token_context(rows, [*texts, *nested]), [KEY, SEQ])
    rows = rows.withColumns({c: _numbered_projects(c, F.col("_projects")) for c in (*texts, *nested)})
    origin = F.lit(BASE_TIME.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    offset = F.unix_micros(origin) - F.unix_micros("_start")
    rows = rows.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + offset))
    rows = rows.withColumns({c: _shifted_members(F.col(c), offset) for c in nested})
    ids = r'("(?:' + "|".join(TOOL_ID_KEYS) + r')":")[^"]*(")'
    known = F.col("_tool")
    swap = {
        c: F.when(known.isNotNull(), F.regexp_replace(F.col(c), F.lit(ids), F.concat(F.lit("$1"), known, F.lit("$2")))).otherwise(
            F.regexp_replace(F.col(c), ids, "$1tool-0$2")
        )
        for c in nested
    }
    rows = rows.withColumns(swap).withColumn("tool_use_id", known)
    rows = redact_columns(rows, [*texts, *nested], **options)

    def parsed(column: str) -> Column:
        value = F.try_parse_json(column)
        broken = F.raise_error(F.concat(F.lit(f"redaction broke {column}: "), F.col(column))).cast("variant")
        return F.when(F.col(column).isNotNull() & value.isNull(), broken).otherwise(value)

    return rows.withColumns({c: parsed(c) for c in nested}).select(*event_rows.columns)
