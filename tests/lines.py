"""Small transcripts written for the tests, in the accepted line shapes."""

import datetime as dt
import json

from pyspark.sql import functions as F

BASE = dt.datetime(2026, 1, 1, 12, 0, 0, tzinfo=dt.timezone.utc)
LINE_SCHEMA = (
    "session_key string, session_id string, line_no long, chunk long, line string, file_mtime timestamp"
)


def at(seconds):
    return (BASE + dt.timedelta(seconds=seconds)).isoformat().replace("+00:00", "Z")


def assistant(i, *blocks, mid=None, tokens=None):
    message = {"role": "assistant", "content": list(blocks)}
    if mid is not None:
        message["id"] = mid
    if tokens is not None:
        message["usage"] = {"output_tokens": tokens}
    return {"type": "assistant", "timestamp": at(i), "session_id": "s", "message": message}


def user(i, content, mid=None):
    message = {"role": "user", "content": content}
    if mid is not None:
        message["id"] = mid
    return {"type": "user", "timestamp": at(i), "session_id": "s", "message": message}


def text(t):
    return {"type": "text", "text": t}


def tool(name, path=None, use_id="t"):
    return {
        "type": "tool_use",
        "id": use_id,
        "name": name,
        "input": {"file_path": path} if path else {},
    }


def frame(spark, sessions, span=1000):
    """{session: [line or dict]} -> lines DataFrame."""
    rows = []
    for sid, items in sessions.items():
        for n, item in enumerate(items, 1):
            line = item if isinstance(item, str) else json.dumps(item)
            rows.append((sid, sid, n, n // span, line, BASE))
    return spark.createDataFrame(rows, LINE_SCHEMA)


__all__ = ["F", "BASE", "assistant", "at", "frame", "text", "tool", "user"]
