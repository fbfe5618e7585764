"""Ingest that goes on: tails, buckets, file marks, and a stream that takes over."""

import json
import os

import lines as L
import pytest
from pyspark.sql import functions as F

from turnwise.model import KEY
from turnwise.operators import normalize as N
from turnwise.operators import segments as S
from turnwise.plans import pipeline
from turnwise.plans.pipeline import ingest, read_state
from turnwise.sources import files, sinks, stores
from turnwise.sources.buckets import KeyedTable
from turnwise.streaming import live


def append(path, items, end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8") as handle:
        for item in items:
            handle.write((item if isinstance(item, str) else json.dumps(item)) + end)


def session(n, seed=0):
    out = [L.user(0, "please fix it", mid="u")]
    for i in range(n):
        tool = ["Read", "Grep", "Edit", "Bash", "Odd"][(i * 7 + seed) % 5]
        out.append(L.assistant(1 + i, L.text("actually" if i % 3 else "ok"), L.tool(tool, f"f{i % 4}"), mid=f"m{i % 20}"))
        if i % 9 == 8:
            out.append(L.user(1 + i, "add it"))
        if i % 11 == 3:
            out.append(L.assistant(1 + i, {"type": "thinking", "thinking": "x" * (i % 5), "signature": "s"}))
    out.append("{broken")
    out.append({"type": "system", "timestamp": L.at(200 + n), "subtype": "x", "cwd": "/home/me/tool/"})
    return out


def plain(df, *drop):
    """Rows without what depends on when they were made; maps as lists."""
    rows = []
    for row in df.drop("updated_at", *drop).collect():
        row = row.asDict()
        rows.append({k: sorted(v.items()) if isinstance(v, dict) else v for k, v in row.items()})
    return sorted(rows, key=str)


def test_a_grown_file_goes_on_from_its_segments(spark, tmp_path, monkeypatch):
    root, parts, once = tmp_path / "logs" / "projects" / "p", str(tmp_path / "parts"), str(tmp_path / "once")
    one, two = session(40), session(25, 3)
    parsed_lines = []
    parse = pipeline.normalise_to_table

    def counted(lines, path, **options):
        out = parse(lines, path, **options)
        parsed_lines.append(out.count())
        return out

    monkeypatch.setattr(pipeline, "normalise_to_table", counted)
    append(str(root / "one.jsonl"), one[:17])
    append(str(root / "two.jsonl"), two)
    ingest(spark, str(root), parts)
    assert parsed_lines == [17 + len(two)]
    append(str(root / "one.jsonl"), one[17:30])
    append(str(root / "one.jsonl"), ['{"half'], end="")
    ingest(spark, str(root), parts)
    assert parsed_lines[1:] == [0, 13]
    append(str(root / "one.jsonl"), ['": 1}', *one[30:]])
    append(str(root / "three.jsonl"), session(3))
    grown = ingest(spark, str(root), parts)
    assert parsed_lines[3:] == [len(session(3)), 1 + len(one) - 30]
    fresh = ingest(spark, str(root), once)
    assert plain(grown["sessions"]) == plain(fresh["sessions"])
    assert plain(grown["metrics"]) == plain(fresh["metrics"])
    for name in ("segments", "ids"):
        tables = [KeyedTable(spark, f"{b}/{name}").read() for b in (parts, once)]
        if name == "segments":
            tables = [S.session_rows(t) for t in tables]
        assert plain(tables[0]) == plain(tables[1])
    drift = [sinks.read_drift(spark, f"{b}/drift") for b in (parts, once)]
    codes = [sorted(r.code for r in d.collect()) for d in drift]
    assert [c for c in codes[0] if c != "unknown_tool"] == [c for c in codes[1] if c != "unknown_tool"]
    assert set(codes[0]) == set(codes[1])
    # nothing new: nothing is written
    versions = stores.versions(spark, f"{parts}/sessions")
    ingest(spark, str(root), parts)
    assert stores.versions(spark, f"{parts}/sessions") == versions == [1, 2, 3]


def test_a_rewritten_file_is_read_as_a_whole(spark, tmp_path):
    path, base = str(tmp_path / "logs" / "a.jsonl"), str(tmp_path / "out")
    append(path, session(10))
    ingest(spark, str(tmp_path / "logs"), base)
    os.remove(path)
    append(path, session(30, 2))
    found = ingest(spark, str(tmp_path / "logs"), base)
    fresh = ingest(spark, str(tmp_path / "logs"), str(tmp_path / "fresh"))
    assert plain(found["sessions"]) == plain(fresh["sessions"])
    assert KeyedTable(spark, f"{base}/files", keys=["path"]).read().first().lines_done == len(session(30, 2))


def test_climbing_reads_what_is_new(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(bytes(range(256)) * 40)
    climb = lambda index: files.climb(files.list_files(spark, str(tmp_path)), index, block=1000).first()

    def known(row):
        return spark.createDataFrame([row.asDict()], f"path string, size long, {files.LADDER}, appended boolean, bytes_read long")

    first = climb(None)
    assert (first.full_blocks, first.appended, first.bytes_read) == (10, False, 10_240)
    with open(path, "ab") as handle:
        handle.write(b"y" * 1500)
    second = climb(known(first))
    # the last block and the rest are checked, the rest and the growth are hashed
    assert second.appended and second.full_blocks == 11 and second.bytes_read == 240 + 1000 + 240 + 1500
    assert second.chain_sha == climb(None).chain_sha
    data = bytearray(path.read_bytes())
    data[10_100] ^= 1
    path.write_bytes(bytes(data) + b"z")
    assert not climb(known(first)).appended
    path.write_bytes(bytes(data[:500]))
    cut = climb(known(second))
    assert not cut.appended and cut.full_blocks == 0


def rows(spark, pairs, stamp):
    return spark.createDataFrame([(k, v, stamp) for k, v in pairs], f"{KEY} string, n int, updated_at int")


def test_one_key_rewrites_one_bucket(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=16)
    table.upsert(rows(spark, [(f"k{i}", i) for i in range(400)], 1))
    assert len(table.manifest()["written"]) == 16
    table.upsert(rows(spark, [("k7", 70)], 2))
    held = table.manifest()
    assert len(held["written"]) == 1 and sorted(set(held["held"].values())) == [1, 2]
    table.delete(rows(spark, [("k8", 0)], 3))
    table.upsert(rows(spark, [("k9", 0)], 0))
    found = {r[KEY]: r.n for r in table.read().collect()}
    assert len(found) == 399 and found["k7"] == 70 and found["k9"] == 9 and "k8" not in found
    # earlier versions stay as they were
    assert {r[KEY]: r.n for r in table.read(1).collect()}["k7"] == 7
    assert table.of_keys(rows(spark, [("k7", 0), ("no", 0)], 0)).first().n == 70
    before = plain(table.read())
    assert table.vacuum(keep=1) > 0 and table.versions() == [4]
    assert plain(table.read()) == before
    assert table.vacuum(keep=1) == 0


def test_a_writer_that_stops_leaves_no_trace(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    table.upsert(rows(spark, [("a", 1), ("b", 2)], 1), version=1)
    with monkeypatch.context() as broken:
        broken.setattr(KeyedTable, "_write_manifest", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            table.upsert(rows(spark, [("a", 9)], 2), version=2)
    assert table.versions() == [1] and {r.n for r in table.read().collect()} == {1, 2}
    # the same version again, twice, is the same table
    for _ in range(2):
        table.upsert(rows(spark, [("a", 5)], 2), version=2)
        assert {r.n for r in table.read().collect()} == {5, 2}
    assert table.versions() == [1, 2]


def test_new_columns_and_empty_tables(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    assert table.read() is None and table.manifest() is None
    table.upsert(rows(spark, [], 1))
    assert table.read().count() == 0
    table.upsert(rows(spark, [("a", 1), ("b", 1), ("c", 1)], 1))
    table.upsert(rows(spark, [("b", 2)], 2).withColumn("more", F.lit("x")))
    assert {(r[KEY], r.n, r.more) for r in table.read().collect()} == {("a", 1, None), ("b", 2, "x"), ("c", 1, None)}
    with pytest.raises(LookupError):
        KeyedTable(spark, str(tmp_path / "u")).delete(rows(spark, [], 1))


@pytest.mark.parametrize("cut", [1, 23, 44])
def test_a_stream_takes_over_from_stored_state(spark, tmp_path, cut):
    """First lines by batch, the others by stream: equal to all of them by batch."""
    items = {"a": session(40), "b": session(12, 4)}
    lines = L.frame(spark, items, span=8)
    first = N.parse_lines(lines.filter(F.col("line_no") <= cut))
    segments, ids = pipeline.state_rows(first)
    base = str(tmp_path / "out")
    KeyedTable(spark, f"{base}/segments", buckets=4).replace(segments, segments)
    KeyedTable(spark, f"{base}/ids", buckets=4).replace(ids, ids)
    initial, known = read_state(spark, base)
    live.narrow_lines(lines.filter(F.col("line_no") > cut)).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(live.NARROW).parquet(str(tmp_path / "in"))
    live.run_available(source, str(tmp_path / "live"), str(tmp_path / "c"), timers=False, initial=initial, known=known)
    got = {r[KEY]: r.asDict() for r in stores.read_latest(spark, str(tmp_path / "live")).collect()}
    S.chunk_segments(live.narrow_parsed(N.parse_lines(lines))).write.parquet(str(tmp_path / "all"))
    all_ = spark.read.parquet(str(tmp_path / "all"))
    want = S.session_columns(S.fold(all_).withColumn("closed", F.lit(False))).join(S.length_medians(all_), KEY, "left")
    want = {r[KEY]: r.asDict() for r in live.with_metrics(want).collect()}
    assert set(got) == {k for k, v in items.items() if len(v) > cut}
    for key, row in got.items():
        same = set(row) & set(want[key]) - {"chunk"}
        assert {c: row[c] for c in same} == {c: want[key][c] for c in same}
        assert len(same) >= 50  # counters, times, windows, bands and labels
