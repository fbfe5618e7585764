import datetime as dt
import json
import os

import lines as L
import pytest
from pyspark.sql import functions as F

from turnwise.operators import metrics as M
from turnwise.operators import normalize as N
from turnwise.operators import reports as R
from turnwise.plans.pipeline import ingest
from turnwise.sources import files, stores
from turnwise.sources import lines as S
from turnwise.sources import sinks


def write(folder, name, items):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as handle:
        for item in items:
            handle.write((item if isinstance(item, str) else json.dumps(item)) + "\n")
    return path


def test_lines_keep_file_order_across_splits(spark, tmp_path):
    write(tmp_path / "p", "big.jsonl", [f'{{"n": {i}, "pad": "{"x" * 40}"}}' for i in range(5000)])
    write(tmp_path / "p" / "deep er", "small+1.jsonl", ['{"n": 0}', '{"n": 1}'])
    write(tmp_path / "p", "other.txt", ["no"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = S.read_lines(spark, str(tmp_path), span=100)
        assert rows.rdd.getNumPartitions() > 5
        n = F.get_json_object("line", "$.n").cast("int")
        bad = rows.filter(n + 1 != F.col("line_no"))
        assert rows.count() == 5002 and bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    names = {r.session_id for r in rows.select("session_id").distinct().collect()}
    assert names == {"big", "small+1"}
    small = rows.filter(F.col("session_id") == "small+1").first()
    assert small.path == str(tmp_path / "p" / "deep er" / "small+1.jsonl")


def test_undecodable_bytes_are_replaced(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_bytes(b'{"type":"user","message":{"content":"a\xffb"}}\n')
    rows = N.events(N.parse_lines(S.read_lines(spark, str(path)))).collect()
    assert rows[0].text == "a�b"


def test_listing_prefix_and_changes(spark, tmp_path):
    a = write(tmp_path, "a.jsonl", ["1" * 100])
    write(tmp_path, "b.jsonl", ["2" * 100])
    write(tmp_path, "c.jsonl", ["3" * 100])
    first = files.list_files(spark, str(tmp_path))
    old = first.join(files.prefix_hashes(first), "path").select("path", "size", "prefix_sha", "prefix_bytes")
    old = spark.createDataFrame(old.collect(), old.schema)
    with open(a, "a", encoding="utf-8") as handle:
        handle.write("more\n")
    write(tmp_path, "b.jsonl", ["9" * 300])
    os.remove(tmp_path / "c.jsonl")
    write(tmp_path, "d.jsonl", ["new"])
    now = files.list_files(spark, str(tmp_path))
    asked = now.join(old.select("path", "prefix_bytes"), "path", "left").withColumn(
        "n", F.coalesce("prefix_bytes", "size")
    )
    now = now.join(files.prefix_hashes(asked, F.col("n")).select("path", "prefix_sha"), "path")
    got = {os.path.basename(r.path): r.change for r in files.classify_changes(old, now).collect()}
    assert got == {"a.jsonl": "APPEND", "b.jsonl": "ROTATE", "c.jsonl": "DELETE", "d.jsonl": "NEW"}


def test_a_rewrite_behind_the_first_bytes_is_seen(spark, tmp_path):
    path = write(tmp_path, "a.jsonl", ["1" * 6000, "old"])
    first = files.list_files(spark, str(tmp_path))
    old = first.join(files.prefix_hashes(first), "path").select("path", "size", "prefix_sha", "prefix_bytes")
    old = spark.createDataFrame(old.collect(), old.schema)
    assert old.first().prefix_bytes == os.path.getsize(path)
    write(tmp_path, "a.jsonl", ["1" * 6000, "new", "more"])
    now = files.list_files(spark, str(tmp_path))
    asked = now.join(old.select("path", "prefix_bytes"), "path")
    now = now.join(files.prefix_hashes(asked, F.col("prefix_bytes")).select("path", "prefix_sha"), "path")
    assert files.classify_changes(old, now).first().change == "ROTATE"


def test_walk_batches_leave_no_file_out(spark):
    listing = spark.range(1000).selectExpr("concat('/logs/', id) as path")
    batches = files.walk_batches(listing, max_files=100)
    assert batches.count() == 1000
    sizes = [r["count"] for r in batches.groupBy("batch").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200
    assert files.walk_batches(listing.limit(0)).count() == 0


def test_files_of_one_name_are_sessions_of_their_own(spark, tmp_path):
    write(tmp_path / "p1", "agent-1.jsonl", session(3))
    write(tmp_path / "p2", "agent-1.jsonl", session(1))
    lines = S.read_lines(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")], roots=[str(tmp_path)])
    assert lines.select("session_key").distinct().count() == 2
    assert lines.select("session_key", "line_no").distinct().count() == lines.count()
    parsed = N.parse_lines(lines)
    reports = R.session_reports(N.events(parsed), N.line_outcomes(parsed), labels=False).collect()
    assert sorted(r.event_count for r in reports) == [4, 6]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_half_written_line_is_read_once_it_is_complete(spark, tmp_path, end):
    path = tmp_path / "s.jsonl"
    path.write_bytes(f'{{"n": "é"}}{end}{{"n": 2}}{end}{{"n"'.encode())
    lines = S.read_lines(spark, str(path))
    assert [r.complete for r in lines.orderBy("line_no").collect()] == [True, True, False]
    index = S.index_of(lines)
    index = spark.createDataFrame(index.collect(), index.schema)
    assert index.first().lines_done == 2 and S.new_lines(lines, index).count() == 0
    with open(path, "a", encoding="utf-8", newline="") as handle:
        handle.write(f": 3}}{end}")
    assert S.new_lines(S.read_lines(spark, str(path)), index).first().line_no == 3
    assert S.read_lines(spark, str(path), partial=False).count() == 3


def session(n, edits=1):
    out = [L.user(0, "add a thing", mid="u")]
    for i in range(n):
        out.append(L.assistant(1 + i, L.tool("Read", f"f{i}"), mid=f"m{i}"))
    for i in range(edits):
        out.append(L.assistant(100 + i, L.tool("Edit", "f0"), mid=f"e{i}"))
    out.append({"type": "system", "timestamp": L.at(200), "subtype": "x", "cwd": "/home/me/tool/"})
    return out


def test_ingest_is_incremental(spark, tmp_path):
    root, base = tmp_path / "logs" / "projects" / "hash1", str(tmp_path / "out")
    write(root, "one.jsonl", session(4))
    write(root, "two.jsonl", session(6))
    first = ingest(spark, str(root), base)
    rows = {r.session_id: r for r in first["sessions"].collect()}
    assert rows["one"].metrics["read_edit_ratio"] == 4.0
    assert (rows["one"].project_hash, rows["one"].project_name) == ("hash1", "tool")
    assert rows["two"].event_count == 9
    again = ingest(spark, str(root), base)
    assert stores.versions(spark, f"{base}/sessions") == [1]
    assert again["sessions"].count() == 2
    write(root, "one.jsonl", session(4, edits=2))
    third = ingest(spark, str(root), base)
    assert stores.versions(spark, f"{base}/sessions") == [1, 2]
    rows = {r.session_id: r for r in third["sessions"].collect()}
    assert rows["one"].metrics["read_edit_ratio"] == 2.0 and len(rows) == 2
    metric = third["metrics"].filter("metric_name = 'read_edit_ratio'").count()
    assert metric == 2


def test_ingest_options_drift_and_failing_metrics(spark, tmp_path):
    root, base = tmp_path / "logs", str(tmp_path / "out")
    write(root, "one.jsonl", [*session(4), "{broken"])
    registry = M.MetricRegistry()
    registry.register("team.events", lambda ev: ev.groupBy("session_key").agg(F.count("*").alias("value")))
    registry.register("team.planned", lambda ev: ev.select("no_such_column"))
    registry.register("team.run", lambda ev: ev.select("session_key", F.raise_error(F.lit("x")).cast("double").alias("value")))
    wanted = ["prompts", "team.events", "team.planned", "team.run"]
    for _ in range(2):
        out = ingest(spark, str(root), base, registry=registry, metrics=wanted, force=True)
    names = sorted(r.metric_name for r in out["metrics"].collect())
    assert names == ["parse_health", "prompts", "team.events"]
    held = out["sessions"].first().metrics
    assert set(held) == {"parse_health", "user_turns", "team.events"} and held["team.events"] == 7
    drift = [(r.code, r.context) for r in sinks.read_drift(spark, f"{base}/drift").collect()]
    assert [c for c, _ in drift].count("malformed_line") == 1
    failed = {json.loads(x)["collector"] for c, x in drift if c == "collector_unexpected_exception"}
    assert failed == {"team.planned", "team.run"}


def test_time_window_and_cut_off(spark):
    start = dt.datetime(2026, 1, 1, 23, 50, tzinfo=dt.timezone.utc)

    def line(i):
        at = (start + dt.timedelta(minutes=i)).isoformat()
        return {"type": "user", "timestamp": at, "message": {"content": "x"}}

    items = [line(i) for i in range(21)]
    items.insert(15, line(-1))
    parsed = N.parse_lines(L.frame(spark, {"s": items}, span=4))
    events, outcomes = N.events(parsed), N.line_outcomes(parsed)
    midnight = dt.datetime(2026, 1, 2)
    late = R.session_reports(events, outcomes, start=midnight, labels=False).first()
    assert late.event_count == 11 and late.started_at == dt.datetime(2026, 1, 2)
    early = R.session_reports(events, outcomes, end=midnight, cutoff=True, labels=False).first()
    assert early.event_count == 11
    plain = R.session_reports(events, outcomes, end=midnight, labels=False).first()
    assert plain.event_count == 12
    outside = R.session_reports(events, outcomes, start=dt.datetime(2027, 1, 1), labels=False)
    assert outside.count() == 0


def test_keys_and_roots(spark):
    df = spark.createDataFrame([("r", "s"), ("", "s"), ("r", "")], "r string, s string")
    keys = df.select(R.session_key(F.col("r"), F.col("s")).alias("k"))
    assert [r.k for r in keys.collect()] == ["r:s", None, None]
    parts = spark.createDataFrame([("r:a:b",), ("x",), (":b",)], "k string").select(
        R.split_session_key(F.col("k")).alias("p")
    )
    assert [r.p for r in parts.collect()] == [("r", "a:b"), None, None]
    paths = spark.createDataFrame([("/a/b/c.jsonl",), ("/ab/c.jsonl",)], "path string")
    got = R.match_roots(paths, ["/a", "/a/b"]).collect()
    assert [r.root_path for r in got] == ["/a/b", None]


def test_store_lookups(spark):
    rows = spark.createDataFrame(
        [("r1:a", "a", 1), ("r2:a", "a", 2), ("r1:b", "b", 3)], "session_key string, session_id string, n int"
    )
    assert stores.get_report(rows, "r2:a").first().n == 2
    assert stores.get_report(rows, "b").first().n == 3
    with pytest.raises(stores.AmbiguousSession):
        stores.get_report(rows, "a")


def test_labels_and_export(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text(json.dumps({"version": 1, "sessions": [{"session_id": "s", "file": "f", "label": "mixed"}]}))
    assert stores.read_labels(spark, str(path)).first().label == "mixed"
    parsed = N.parse_lines(L.frame(spark, {"s": session(1)}))
    sinks.export_events(N.events(parsed), str(tmp_path / "x"))
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "x")).collect()]
    assert {r["kind"] for r in rows} == {"user", "tool_call", "system"}
    call = next(r for r in rows if r["kind"] == "tool_call" and r["payload"]["tool_name"] == "read")
    assert call["payload"] == {
        "file_path": "f0", "input": {"file_path": "f0"}, "tool_name": "read", "tool_use_id": "t"
    }
    system = next(r for r in rows if r["kind"] == "system")
    assert system["payload"] == {"cwd": "/home/me/tool/", "subkind": "x"}
    assert system["timestamp"] == "2026-01-01T12:03:20+00:00"
