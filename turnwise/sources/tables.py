"""Other tables seen as transcripts: the adapters the query catalogue runs on.

``events`` (event_id, ts, user_id, event_type, props) becomes tool calls,
``conversations`` (conv_id, turn, role, text) becomes messages, and ``events`` is
also rendered as raw transcript lines of every accepted shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.model import CHUNK, CHUNK_SPAN, KEY, SEQ

_TOOLS = {"view": "read", "click": "grep", "purchase": "edit", "signup": "write", "error": "bash"}

_EMPTY = {
    "text": "string",
    "token_count": "bigint",
    "tool_name": "string",
    "file_path": "string",
    "thinking_len": "int",
    "redacted": "boolean",
    "signature": "string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _with_missing(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.withColumns(
        {c: F.lit(None).cast(t) for c, t in _EMPTY.items() if c not in have}
        | ({} if "ts_resolved" in have else {"ts_resolved": F.lit(True)})
    )


def _raw_events(spark: SparkSession, folder: str, span: int) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias(SEQ),
        F.floor(F.col("event_id") / span).alias(CHUNK),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        _k().alias("k"),
    )


def _spread(rows: DataFrame) -> DataFrame:
    """The narrow rows dealt to more tasks than the file has splits.

    An event is some ten bytes in its file and a long line once it is rendered and parsed,
    so splits by size are few and long.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, SEQ, "user_id", "ts")


def tool_events(
    spark: SparkSession, folder: str, *, per_day: bool = False, span: int = CHUNK_SPAN
) -> DataFrame:
    """Every event a tool call; a session is a user, or a user's day."""
    rows = _raw_events(spark, folder, span)
    tool = F.coalesce(*[F.when(F.col("event_type") == e, t) for e, t in _TOOLS.items()])
    user = F.col("user_id").cast("string")
    key = F.concat(user, F.lit("-"), F.date_format("ts", "yyyy-MM-dd")) if per_day else user
    return _with_missing(
        rows.select(
            key.alias(KEY),
            "user_id",
            CHUNK,
            SEQ,
            "ts",
            F.lit("tool_call").alias("kind"),
            tool.alias("tool_name"),
            F.when(F.col("k") % 17 != 0, F.concat(F.lit("f"), F.col("k") % 10)).alias("file_path"),
        )
    )


#: Prompt texts used when an event stands for a user message.
PROMPTS = ("please fix this", "add a test", "why is it slow", "outline the work", "hello there")


def prompted_events(spark: SparkSession, folder: str, *, span: int = CHUNK_SPAN) -> DataFrame:
    """Events with prompts: sign-ups open a turn, all others are tool calls."""
    rows = _raw_events(spark, folder, span)
    is_user = F.col("event_type") == "signup"
    tool = F.coalesce(*[F.when(F.col("event_type") == e, t) for e, t in _TOOLS.items()])
    prompt = F.array(*[F.lit(p) for p in PROMPTS])[F.col("k") % len(PROMPTS)]
    return _with_missing(
        rows.select(
            F.col("user_id").cast("string").alias(KEY),
            "user_id",
            CHUNK,
            SEQ,
            "ts",
            F.when(is_user, "user").otherwise("tool_call").alias("kind"),
            F.when(~is_user, tool).alias("tool_name"),
            F.when(is_user, prompt).alias("text"),
            F.when(~is_user & (F.col("k") % 17 != 0), F.concat(F.lit("f"), F.col("k") % 10)).alias(
                "file_path"
            ),
        )
    )


def conversation_events(spark: SparkSession, folder: str, *, span: int = CHUNK_SPAN) -> DataFrame:
    """Conversation turns as messages; a session is a conversation."""
    rows = table(spark, folder, "conversations")
    return _with_missing(
        rows.select(
            F.col("conv_id").cast("string").alias(KEY),
            F.floor(F.col("turn") / span).alias(CHUNK),
            F.col("turn").alias(SEQ),
            (F.timestamp_seconds(F.lit(1704067200)) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"))).alias("ts"),
            F.col("role").alias("kind"),
            "text",
        )
    )


def transcript_lines(spark: SparkSession, folder: str, *, span: int = CHUNK_SPAN) -> DataFrame:
    """``events`` as transcript lines of all shapes; a session is a user.

    view: wrapped assistant line with a Read call, an id on every fifth k
    (so ids repeat); click: text, Grep call and reasoning block; purchase: flat
    Edit call; signup: wrapped user message; error: by k % 3 cut-off JSON, an
    unknown type, or a structural line.
    """
    rows = _spread(_raw_events(spark, folder, span))
    k, stamp = F.col("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    path = F.when(k % 17 != 0, F.concat(F.lit("f"), k % 10))
    sid = F.col("user_id").cast("string")

    def line(**fields: Column) -> Column:
        head = {"timestamp": stamp, "session_id": sid}
        return F.to_json(F.struct(*[c.alias(n) for n, c in {**fields, **head}.items()]))

    def call(name: str) -> Column:
        return F.struct(
            F.lit("tool_use").alias("type"),
            F.concat(F.lit("t"), F.col(SEQ)).alias("id"),
            F.lit(name).alias("name"),
            F.struct(path.alias("file_path")).alias("input"),
        )

    view = line(
        type=F.lit("assistant"),
        message=F.struct(
            F.when(k % 5 == 0, F.concat(F.lit("m"), k)).alias("id"),
            F.array(call("Read")).alias("content"),
        ),
    )
    thought = F.when(k % 3 == 0, "[redacted]").otherwise(F.repeat(F.lit("x"), k + 1))
    parts = F.concat_ws(
        ",",
        F.to_json(F.struct(F.lit("text").alias("type"), F.lit("looking").alias("text"))),
        F.to_json(call("Grep")),
        F.to_json(
            F.struct(
                F.lit("thinking").alias("type"),
                thought.alias("thinking"),
                F.repeat(F.lit("s"), k % 7).alias("signature"),
            )
        ),
    )
    click = F.concat(
        F.lit('{"type":"assistant","timestamp":"'),
        stamp,
        F.lit('","session_id":"'),
        sid,
        F.lit('","message":{"usage":{"output_tokens":'),
        k.cast("string"),
        F.lit('},"content":['),
        parts,
        F.lit("]}}"),
    )
    purchase = line(
        type=F.lit("assistant"),
        tool=F.lit("Edit"),
        tool_input=F.struct(path.alias("file_path")),
    )
    signup = line(
        type=F.lit("user"),
        message=F.struct(F.lit("user").alias("role"), F.lit("add a test").alias("content")),
    )
    error = (
        F.when(k % 3 == 0, F.lit('{"type":"assistant","time'))
        .when(k % 3 == 1, line(type=F.lit("mystery")))
        .otherwise(line(type=F.lit("progress")))
    )
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", view)
        .when(kind == "click", click)
        .when(kind == "purchase", purchase)
        .when(kind == "signup", signup)
        .otherwise(error)
    )
    return rows.select(
        sid.alias(KEY),
        sid.alias("session_id"),
        F.lit("root-legacy").alias("root_id"),
        F.concat(F.lit("/data/projects/p"), F.col("user_id") % 20, F.lit("/"), sid, F.lit(".jsonl")).alias("path"),
        F.col(SEQ).alias("line_no"),
        CHUNK,
        text.alias("line"),
        F.timestamp_seconds(F.lit(1704067200)).alias("file_mtime"),
    )


def conversation_lines(spark: SparkSession, folder: str, *, span: int = CHUNK_SPAN) -> DataFrame:
    """``conversations`` as transcript lines of the rarer shapes; a session is a conversation.

    By turn % 5: a user line with a tool result in parts; a system line with a working
    folder; an assistant line of role, ts and a list of content; a user line without a
    time; a flat assistant line that names another session.
    """
    rows = table(spark, folder, "conversations")
    turn, said = F.col("turn"), F.coalesce("text", F.lit(""))
    sid = F.col("conv_id").cast("string")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + turn * 60)
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def line(**fields: Column) -> Column:
        return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))

    def part(value: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), value.alias("text"))

    result = F.struct(
        F.lit("tool_result").alias("type"),
        F.concat(F.lit("t"), turn).alias("tool_use_id"),
        F.array(part(said), part(F.lit("more"))).alias("content"),
        (turn % 2 == 0).alias("is_error"),
    )
    shapes = (
        line(type=F.lit("user"), timestamp=stamp, session=sid, message=F.struct(F.array(result).alias("content"))),
        line(type=F.lit("system"), timestamp=stamp, subtype=F.lit("note"), cwd=F.lit("/home/user/x")),
        line(role=F.lit("assistant"), ts=stamp, content=F.array(part(said))),
        line(type=F.lit("user"), message=F.struct(said.alias("content"))),
        line(type=F.lit("assistant"), timestamp=stamp, session_id=F.lit("other"), text=said),
    )
    text = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        text = F.when(turn % 5 == i, shape).otherwise(text)
    return rows.select(
        sid.alias(KEY),
        sid.alias("session_id"),
        F.lit("root-legacy").alias("root_id"),
        F.concat(F.lit("/data/projects/c/"), sid, F.lit(".jsonl")).alias("path"),
        turn.cast("long").alias("line_no"),
        F.floor(turn / span).alias(CHUNK),
        text.alias("line"),
        F.timestamp_seconds(F.lit(1704067200)).alias("file_mtime"),
    )


def day_reports(spark: SparkSession, folder: str, *, span: int = CHUNK_SPAN) -> DataFrame:
    """Reports over user-days, with project, model and mode taken from the user id."""
    from turnwise.operators.reports import session_reports

    events = tool_events(spark, folder, per_day=True, span=span)
    user = F.split(F.col(KEY), "-")[0].cast("int")
    reports = session_reports(events, labels=False)
    return reports.withColumns(
        {
            "project_hash": F.concat(F.lit("project-"), user % 20),
            "project_name": F.when(user % 3 == 0, F.concat(F.lit("name-"), user % 20)),
            "model": F.when(user % 4 != 0, F.concat(F.lit("model-"), user % 4)),
            "permission_mode": F.when(user % 5 != 0, F.concat(F.lit("mode-"), user % 2)),
            "session_task_type": F.when(
                user % 7 != 0, F.element_at(F.array(F.lit("planning"), F.lit("mixed")), user % 2 + 1)
            ),
        }
    )


def talk_reports(spark: SparkSession, folder: str, *, stop, loop) -> DataFrame:
    """Reports over conversations whose metrics vary: phrases, prompts and line outcomes.

    Conversations start on one of twelve days; a turn is a line that went well unless its
    text's length is a multiple of 7.  Models and two metrics of their own come from the
    conversation's number: ``team.tier`` is constant per model, ``team.only_<model>``
    exists for one model alone.
    """
    from turnwise.operators.reports import session_reports

    number = F.col(KEY).cast("int")
    events = conversation_events(spark, folder)
    day = F.make_dt_interval(number % 12 + 7)
    events = events.withColumn("ts", F.col("ts") + day)
    size = F.coalesce(F.length("text"), F.lit(0))
    outcomes = events.select(
        KEY,
        CHUNK,
        F.col(SEQ).alias("line_no"),
        (size % 7 != 0).alias("ok"),
        F.lit(False).alias("duplicate"),
        F.when(size % 7 != 0, 1).otherwise(0).alias("parsed_events"),
        F.array().cast("array<string>").alias("missing"),
        F.lit("message").alias("line_class"),
    )
    reports = session_reports(events, outcomes, stop=stop, loop=loop, labels=False)
    model = number % 3
    own = F.map_from_arrays(
        F.array(F.lit("team.tier"), F.concat(F.lit("team.only_"), model.cast("string"))),
        F.array(model.cast("double"), (number % 10).cast("double")),
    )
    return reports.withColumns(
        {
            "model": F.concat(F.lit("model-"), model),
            "metrics": F.map_concat("metrics", own),
        }
    )
