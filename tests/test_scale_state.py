import json

import pandas as pd
from test_live_state import Clock, processor, segment, send

from turnwise.model import KEY
from turnwise.operators import segments as S
from turnwise.streaming import live


def test_segments_of_one_call_are_one_entry_and_nothing_is_asked_for():
    state, asked = processor(), []
    state.parts.containsKey = lambda key: asked.append(key)
    first = [segment(i, calls=1, visible_sizes=[5], visible_counts=[1]) for i in range(1, 41)]
    (row,) = send(state, Clock(1), *first)
    assert (row.calls, len(state.parts), state.lengths[("visible", 5)]) == (40, 1, (40,))
    # behind all that is held, in one more entry
    (row,) = send(state, Clock(2), *[segment(i, calls=1) for i in range(41, 61)])
    assert (row.calls, len(state.parts), asked) == (60, 2, [])


def test_late_and_repeated_segments_in_one_call():
    state = processor()
    send(state, Clock(1), *[segment(i, calls=1, categories=["read"]) for i in (2, 6)])
    some = [segment(2, calls=1), segment(4, calls=1, categories=["mutation"]), segment(4, calls=1), segment(9, calls=1)]
    (row,) = send(state, Clock(2), *some)
    assert (row.calls, row.categories, row.to_seq) == (4, ["read", "mutation", "read"], 9)


def test_packed_rows_say_the_same(spark):
    rows = [segment(i, calls=i, resolved=i, categories=["read", None], tail_keyword='"x"\n', outcomes=[True, False]) for i in (1, 2)]
    frame = live.packed(spark.createDataFrame(rows, f"{S.SEGMENT}, deleted boolean")).toPandas()
    plain, state = processor(), live.PackedState()
    state.init(plain.handle)
    (want,) = plain.handleInputRows(("k",), iter([pd.DataFrame(rows)]), Clock(1))
    (got,) = state.handleInputRows(("k",), iter([frame]), Clock(1))
    assert list(got.columns) == [KEY, "row"]
    assert json.loads(got["row"][0]) == json.loads(json.dumps(want.to_dict("records")[0]))


def test_lines_are_dealt_to_all_cores(spark, tmp_path):
    from turnwise.sources import tables as tab

    rows = spark.range(50).selectExpr(
        "id event_id", "timestamp_seconds(id) ts", "id % 3 user_id", "'view' event_type", "1.0D value", "'{\"k\": 1}' props"
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    lines = tab.transcript_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    assert lines.count() == 50


def test_late_chunks_land_as_few_files(spark, tmp_path, monkeypatch):
    from turnwise.plans import catalog

    # 40 sessions of two events in each of four chunks; one session has no name, one event no kind
    rows = spark.range(320).selectExpr(
        "(id div 80) * 4096 + id % 80 event_id", "timestamp_seconds(id) ts", "nullif(id % 40, 7) user_id",
        "IF(id = 100, NULL, IF(id % 80 < 40, 'purchase', 'view')) event_type", "1.0D value",
        "concat('{\"k\": ', id % 3 + 1, '}') props",
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(catalog, "_fresh", lambda spark, name: f"{tmp_path}/{name}")
    got = {r.session_key: r for r in catalog.QUERIES["streamed_late_chunks"](spark, str(tmp_path)).collect()}
    landed = list((tmp_path / "late" / "in").rglob("part-*"))
    assert len(landed) <= 2 * max(4, spark.sparkContext.defaultParallelism)
    assert set(got) == {f"root-legacy:{i}" for i in range(40) if i != 7} | {"root-legacy:__HIVE_DEFAULT_PARTITION__"}
    # 100 is 20 of the second chunk: a purchase without its kind is no event
    assert {k: (r.event_count, r.mutations_total) for k, r in got.items() if (r.event_count, r.mutations_total) != (8, 4)} == {
        "root-legacy:20": (7, 3)
    }


def test_bundled_chunks_are_the_lines_of_their_files(spark, tmp_path):
    texts = {("a", 1): "x\ny\n", ("a", 0): "one\n\nthree\n", ("b", 3): "\u00e9\r\nlast\n"}
    rows = [(s, c, i, line) for (s, c), text in texts.items() for i, line in enumerate(text[:-1].split("\n"))]
    rows = [(s, c, i, line or None) for s, c, i, line in reversed(rows)]
    bundles = live.bundle_chunks(spark.createDataFrame(rows, "session string, chunk long, line_no long, line string"))
    assert {(r.session, r.chunk): r.value for r in bundles.collect()} == texts
    bundles.coalesce(1).write.parquet(f"{tmp_path}/bundles")
    for (session, chunk), text in texts.items():
        (tmp_path / "files" / session).mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / session / f"{chunk}.jsonl").write_bytes(text.encode())
    found = []
    for name, how in (("files", {}), ("bundles", {"glob": "*.parquet", "bundled": True})):
        stream = live.stream_lines(spark, f"{tmp_path}/{name}", **how).drop("file_mtime")
        out = stream.writeStream.format("memory").queryName(f"lines_{name}").trigger(availableNow=True)
        out.option("checkpointLocation", f"{tmp_path}/check-{name}").start().awaitTermination()
        found.append(sorted(map(tuple, spark.table(f"lines_{name}").collect())))
    assert found[0] == found[1] and len(found[0]) == 3 + 4 + 3
