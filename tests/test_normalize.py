import lines as L
from pyspark.sql import functions as F

from turnwise.operators import metrics as M
from turnwise.operators import normalize as N


def by_line(df, *cols):
    return {r["line_no"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_line_classes_and_outcomes(spark):
    lines = [
        L.user(0, "hello", mid="m1"),
        L.assistant(1, L.text("hi"), L.tool("Read", "f1"), mid="m2", tokens=5),
        L.assistant(2, L.text("again"), mid="m2"),
        "{bad",
        "[1]",
        {"x": 1},
        {"type": "zzz", "timestamp": L.at(3)},
        {"type": "progress", "timestamp": L.at(3)},
        {"role": "user", "ts": L.at(3), "session": "q", "content": [L.text("p")]},
        {"type": "assistant", "timestamp": L.at(4), "tool": "Edit", "tool_input": {"file_path": "f"}},
        {"type": "assistant", "timestamp": L.at(5), "broken": True},
        {"type": "system", "timestamp": L.at(5), "subtype": "init", "cwd": "/a/b"},
        {"type": "assistant", "timestamp": L.at(6), "message": {"content": []}},
        {"type": "user", "timestamp": L.at(7), "message": {"content": 5}},
        "   ",
    ]
    parsed = N.parse_lines(L.frame(spark, {"s": lines}))
    got = by_line(parsed, "line_class", "ok", "parsed_events", "missing")
    assert got == {
        1: ("message", True, 1, []),
        2: ("message", True, 2, []),
        3: ("message", True, 1, []),
        4: ("malformed", False, 0, ["__json__"]),
        5: ("not_object", False, 0, ["__object__"]),
        6: ("missing_type", False, 0, ["type"]),
        7: ("unknown_type", False, 0, ["type"]),
        8: ("structural", True, 1, []),
        9: ("flat_list", True, 1, []),
        10: ("flat", True, 1, []),
        11: ("flat_missing", False, 0, ["message"]),
        12: ("system", True, 1, []),
        13: ("message", True, 1, []),
        14: ("message", True, 1, ["text"]),
    }
    stats = N.parse_stats(N.line_outcomes(parsed)).first()
    assert (stats.total_lines, stats.parsed_events, stats.duplicate_count) == (14, 10, 1)
    assert stats.missing_fields["type"] == 2
    kinds = [r.kind for r in N.events(parsed).orderBy("seq").collect()]
    assert kinds == ["user", "assistant", "tool_call", "user", "tool_call", "system"]


def test_block_types(spark):
    lines = [
        L.assistant(
            0,
            {"type": "thinking", "thinking": "abc", "signature": "xy"},
            {"type": "thinking", "thinking": "[redacted]"},
            {"type": "thinking", "redacted": True},
            {"type": "thinking"},
            {"type": "tool_use", "name": "Grep", "id": "t1"},
            {"type": "tool_use", "name": 5, "id": "t1"},
            {"type": "tool_use", "name": "Grep"},
            {"type": "image"},
            {"type": "text", "text": 7},
            "loose",
        ),
        L.user(
            1,
            [
                {"type": "tool_result", "tool_use_id": "t1", "content": [L.text("a"), L.text("b"), 3]},
                {"type": "tool_result", "tool_use_id": "t1", "content": "c", "is_error": 1, "truncated": ""},
                {"type": "tool_result", "content": "c"},
            ],
        ),
    ]
    parsed = N.parse_lines(L.frame(spark, {"s": lines}))
    missing = by_line(parsed, "missing")
    assert missing[1] == (["thinking", "input", "tool_name", "tool_use_id", "content.type", "text"],)
    assert missing[2] == (["tool_use_id"],)
    rows = N.events(parsed).orderBy("seq").collect()
    thought = [(r.thinking_len, r.redacted, r.signature) for r in rows if r.kind == "thinking"]
    assert thought == [(3, False, "xy"), (0, True, None), (0, True, None)]
    results = [(r.output, r.is_error, r.truncated) for r in rows if r.kind == "tool_result"]
    assert results == [("a\nb", False, None), ("c", True, False)]


def test_timestamps(spark):
    lines = [
        {"type": "progress", "timestamp": "2026-01-01T00:00:00Z"},
        {"type": "progress", "timestamp": "2026-01-01T02:00:00+02:00"},
        {"type": "progress", "timestamp": "2026-02-30"},
        {"type": "progress", "timestamp": 5},
        {"type": "progress", "timestamp": "", "ts": "2026-01-01"},
        {"type": "progress"},
    ]
    got = by_line(N.parse_lines(L.frame(spark, {"s": lines})), "ts_resolved", "missing")
    assert [got[i][0] for i in range(1, 7)] == [True, True, False, False, True, False]
    assert [got[i][1] for i in range(1, 7)] == [[], [], ["timestamp"], [], [], ["timestamp"]]


def test_dedup_scopes(spark):
    first = [L.assistant(i, L.text(f"t{i}"), mid=f"m{i}") for i in range(15)]
    repeat = [L.assistant(20 + i, L.text("x"), mid=f"m{i}") for i in range(5)]
    sessions = {"a": first + repeat, "b": [L.assistant(0, L.text("y"), mid="m1"), L.assistant(1, L.text("z"))]}
    frame = L.frame(spark, sessions, span=4)
    one = N.parse_lines(frame)
    assert one.filter("duplicate").groupBy("session_key").count().collect() == [("a", 5)]
    assert N.events(one).count() == 17
    corpus = N.parse_lines(frame, dedup="corpus")
    assert corpus.filter("duplicate").count() == 6
    assert N.parse_lines(frame, dedup="none").filter("duplicate").count() == 0
    block = N.events(N.parse_lines(frame, dedup="block"), dedup="block")
    assert block.count() == 22


def test_fingerprints(spark):
    known = N.known_fingerprints()
    lines = [
        L.user(0, "x"),
        {"type": "a", "timestamp": "t", "session_id": "s", "text": ""},
        {"n": 1, "f": 1.5, "é": None, "b": True, "l": [], "type": "x"},
        {},
    ]
    parsed = N.parse_lines(L.frame(spark, {"s": lines}))
    got = by_line(parsed.withColumn("fp", N.fingerprint(F.col("_v"))), "fp")
    assert got[1][0] in known and got[2][0] in known
    shape = {"n": "int", "f": "float", "é": "NoneType", "b": "bool", "l": "list", "type": "str"}
    assert got[3][0] == N.known_fingerprints([shape])[0]
    assert got[4][0] == N.known_fingerprints([{}])[0]


def test_rolling_confidence_only_sees_recent_lines(spark):
    lines = [L.user(i, "x") for i in range(300)] + ["{"] * 100
    stats = N.parse_stats(N.line_outcomes(N.parse_lines(L.frame(spark, {"s": lines}, span=50)))).first()
    assert stats.parse_confidence == 0.5
    assert stats.session_confidence == 0.75


def test_unknown_tools_once_per_session(spark):
    lines = [L.assistant(i, L.tool("Mystery"), L.tool("bash"), L.tool("Read", "f")) for i in range(3)]
    rows = N.unknown_tools(N.events(N.parse_lines(L.frame(spark, {"s": lines})))).collect()
    assert [r.tool_name for r in rows] == ["Mystery"]


def test_drift_session_is_critical(spark):
    lines = [L.assistant(i, L.text("fine")) for i in range(45)]
    lines += [{"type": "assistant", "timestamp": L.at(100 + i), "broken": True} for i in range(10)]
    parsed = N.parse_lines(L.frame(spark, {"s": lines}))
    row = M.snapshots(N.events(parsed), N.parse_stats(N.line_outcomes(parsed))).first()
    assert round(row.parse_confidence, 2) == 0.82
    assert row.parse_health_severity == "critical"
    assert row.missing_fields == {"message": 10}
