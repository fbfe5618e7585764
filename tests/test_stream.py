import json
import os
import time

import lines as L
from pyspark.sql import functions as F

from turnwise.model import MetricConfig
from turnwise.operators import normalize as N
from turnwise.operators import reports as R
from turnwise.sources import stores
from turnwise.sources import tables as tab
from turnwise.streaming import live


def transcript(sid):
    out = [L.user(0, "please explain", mid="u1")]
    for i in range(30):
        tool = ["Read", "Grep", "Edit", "Bash"][(i * 7 + len(sid)) % 4]
        out.append(L.assistant(1 + i, L.text("actually yes" if i % 3 else "ok"), L.tool(tool, f"f{i % 4}"), mid=f"m{i % 25}"))
        if i % 9 == 8:
            out.append(L.user(1 + i, "fix it", mid=f"u{i}"))
    out.append("{broken")
    out.append(L.assistant(50, {"type": "thinking", "thinking": "abcd", "signature": "s"}))
    return out


def land(folder, sid, part, items):
    os.makedirs(f"{folder}/{sid}", exist_ok=True)
    with open(f"{folder}/{sid}/{part}.jsonl", "w", encoding="utf-8") as handle:
        handle.write("\n".join(i if isinstance(i, str) else json.dumps(i) for i in items))


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    sessions = {"a": transcript("a"), "bb": transcript("bb")}
    folder, base, check = (str(tmp_path / n) for n in ("in", "live", "check"))
    for part in range(3):
        for sid, items in sessions.items():
            land(folder, sid, part, items[part * 12 : (part + 1) * 12 if part < 2 else None])
        rows = live.narrow_lines(live.stream_lines(spark, folder))
        live.run_available(rows, base, check, timers=False)
    got = {r.session_key.split(":")[1]: r for r in stores.read_latest(spark, base).collect()}
    parsed = N.parse_lines(L.frame(spark, sessions))
    want = {r.session_key: r for r in R.session_reports(N.events(parsed), N.line_outcomes(parsed)).collect()}
    assert set(got) == set(want)
    for sid, report in want.items():
        assert got[sid].event_count == report.event_count
        assert got[sid].metrics == report.metrics
        assert got[sid].parse_confidence == report.parse_confidence
        assert got[sid].duplicate_count == 5


def test_chunks_out_of_order_are_all_counted(spark, tmp_path):
    folder, base, check = (str(tmp_path / n) for n in ("in", "live", "check"))
    items = [L.user(i, "add it", mid=f"u{i}") for i in range(5)]
    for part, some in ((1, items[3:]), (0, items[:3])):
        land(folder, "late", part, some)
        live.run_available(live.narrow_lines(live.stream_lines(spark, folder)), base, check, timers=False)
    assert stores.read_latest(spark, base).first().event_count == 5


def test_silent_session_is_finished_by_its_timer(spark, tmp_path):
    folder, base, check = (str(tmp_path / n) for n in ("in", "live", "check"))
    land(folder, "old", 0, [L.user(0, "plan it"), L.assistant(1, L.text("done"))])
    rows = live.narrow_lines(live.stream_lines(spark, folder))
    cfg = MetricConfig(stale_after=300, evict_after=2100)
    live.cut_available(rows, f"{base}-state", check, cfg=cfg)
    stream = (
        live.live_metrics(live.segment_stream(spark, f"{base}-state"), cfg=cfg)
        .writeStream.outputMode("update")
        .option("checkpointLocation", check)
        .trigger(processingTime="1 second")
        .foreachBatch(live.merge_batch(base))
        .start()
    )
    try:
        for _ in range(90):
            time.sleep(1)
            found = stores.read_latest(spark, base)
            if found is not None and found.filter("row_type = 'final'").count():
                break
        row = stores.read_latest(spark, base).first()
    finally:
        stream.stop()
    assert (row.row_type, row.state, row.turns, row.session_task_type) == ("final", "evicted", 1, "mixed")


def test_delete_ends_a_session_and_initial_state_is_taken_over(spark, tmp_path):
    events = tab._with_missing(
        spark.createDataFrame(
            [("k", 0, 100 + i, L.BASE, "tool_call", t, "f") for i, t in enumerate(["read", "edit"])],
            "session_key string, chunk long, seq long, ts timestamp, kind string, tool_name string, file_path string",
        )
    )
    changes = spark.createDataFrame([("k", "DELETE")], "session_key string, change string")
    live.narrow_events(events).unionByName(live.tombstones(changes), allowMissingColumns=True).write.parquet(
        str(tmp_path / "in")
    )
    initial = spark.createDataFrame(
        [("k", 5, 3, 3, 0)], "session_key string, calls long, event_count long, reads long, mutations long"
    )
    source = spark.readStream.schema(live.NARROW).parquet(str(tmp_path / "in"))
    live.run_available(source, str(tmp_path / "live"), str(tmp_path / "c"), timers=False, initial=initial)
    row = stores.read_latest(spark, str(tmp_path / "live")).filter(F.col("row_type") == "final").first()
    assert (row.calls, row.reads, row.mutations, row.event_count) == (7, 4, 1, 5)
