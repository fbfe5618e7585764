"""The state of one session by itself, against a state store that is a dictionary."""

import json

import pandas as pd
from pyspark.sql import functions as F

from turnwise.model import KEY
from turnwise.operators import metrics as M
from turnwise.operators import reports as R
from turnwise.operators import segments as S
from turnwise.streaming import live


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map(dict):
    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *a):
        return Value()

    def getMapState(self, *a):
        return Map()

    def listTimers(self):
        return iter(sorted(self.timers))

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, seconds):
        self.now = seconds * 1000

    def getCurrentProcessingTimeInMs(self):
        return self.now


def segment(at, *, resolved=None, **fields):
    base = S.unpack({KEY: "k", "chunk": at, "from_seq": at, "to_seq": at, "first_us": at, "last_us": at})
    return base | {"resolved_us": resolved, "event_count": 1, "deleted": False} | fields


def processor():
    out = live.SessionState()
    out.init(Handle())
    return out


def send(state, clock, *segments):
    return [f.iloc[0] for f in state.handleInputRows(("k",), iter([pd.DataFrame(list(segments))]), clock)]


def test_only_a_readable_time_brings_a_stale_session_back():
    state, start = processor(), 1_000_000
    (row,) = send(state, Clock(start), segment(1, resolved=start * 10**6))
    assert (row.row_type, row.state) == ("live", "active")
    assert sorted(state.handle.timers) == [(start + 300) * 1000, (start + 2100) * 1000]
    (row,) = [f.iloc[0] for f in state.handleExpiredTimer(("k",), Clock(start + 301), None)]
    assert (row.row_type, row.state) == ("live", "stale")
    # an event without a readable time counts, but the session stays quiet
    (row,) = send(state, Clock(start + 400), segment(2))
    assert (row.state, row.event_count) == ("stale", 2)
    # nor does one that is older than the last
    (row,) = send(state, Clock(start + 410), segment(3, resolved=(start - 50) * 10**6))
    assert (row.state, row.event_count) == ("stale", 3)
    (row,) = send(state, Clock(start + 420), segment(4, resolved=(start + 420) * 10**6))
    assert (row.state, row.event_count) == ("active", 4)
    (row,) = [f.iloc[0] for f in state.handleExpiredTimer(("k",), Clock(start + 2521), None)]
    assert (row.row_type, row.state) == ("final", "evicted")
    assert list(state.handleExpiredTimer(("k",), Clock(start + 9999), None)) == []


def test_a_file_that_is_read_again_counts_once():
    state = processor()
    parts = [segment(i, calls=1, categories=["read"], visible_sizes=[5], visible_counts=[2]) for i in (1, 2, 3)]
    send(state, Clock(1), *parts[:2])
    # rotated or truncated: the same lines come again, and more
    (row,) = send(state, Clock(2), *parts)
    assert (row.event_count, row.calls, row.categories) == (3, 3, ["read"] * 3)
    assert state.lengths[("visible", 5)] == (6,)
    assert row.visible_chars_median == 5.0


def test_late_segments_take_their_place():
    parts = [
        segment(1, prompts=1, tail_keyword="planning", tail_calls=0),
        segment(2, calls=1, categories=["read"], look_paths=["f"], look_backs=[0], head_calls=1, head_lookups=1),
        segment(3, calls=1, categories=["mutation"], mutations_total=1, mutations_with_path=1, edit_paths=["f"], edit_nos=[1], head_calls=1, head_mutations=1),
        segment(4, prompts=1, tail_keyword="mixed"),
    ]
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1]):
        state = processor()
        for i in order:
            (row,) = send(state, Clock(1), dict(parts[i]))
        assert row.categories == ["read", "mutation"]
        # the file was looked at one call before
        assert (row.blind_mutations, row.edit_paths) == (0, [])
        # one turn between the prompts: two calls, one lookup, one edit
        assert sum(row.votes) == 1 and row.tail_keyword == "mixed"


def test_a_control_row_ends_a_session():
    state = processor()
    send(state, Clock(1), segment(1))
    gone = {c: None for c in S.FIELDS} | {KEY: "k", "from_seq": 2**62, "deleted": True}
    (row,) = send(state, Clock(2), segment(2), gone)
    assert (row.row_type, row.event_count, row.closed) == ("final", 2, True)
    assert not state.main.exists() and not state.parts and not state.lengths
    # an end for a session nobody knows says nothing
    assert send(processor(), Clock(1), gone) == []


def test_initial_segments_and_counters():
    state = processor()
    state.handleInitialState(("k",), pd.DataFrame([segment(2, calls=2), segment(1, calls=1)]), Clock(1))
    (row,) = send(state, Clock(1), segment(3))
    assert (row.event_count, row.calls, row.from_seq) == (3, 3, 1)
    state = processor()
    state.handleInitialState(("k",), pd.DataFrame([{KEY: "k", "calls": 5, "reads": 3, "event_count": 9}]), Clock(1))
    (row,) = send(state, Clock(1), segment(3))
    assert (row.event_count, row.calls, row.categories) == (10, 5, ["read"] * 3)


def test_ticks_done_twice_count_once(spark, tmp_path):
    base = str(tmp_path / "live")
    rows = [S.unpack({KEY: k, "chunk": 0, "from_seq": 1, "to_seq": 1, "event_count": 4, "calls": c}) for k, c in (("a", 1), ("b", 2), ("c", 3))]
    rows = [r | {"categories": ["read"] * r["calls"]} for r in rows]
    segments = spark.createDataFrame(rows, S.SEGMENT)

    def tick(number, keys, ended=()):
        some = segments.filter(F.col(KEY).isin(*keys)).withColumn("closed", F.lit(False))
        wide = live.with_metrics(S.session_columns(some).join(S.length_medians(some), KEY, "left"))
        ended = F.col(KEY).isin(*ended)
        wide = wide.withColumns(
            {"row_type": F.when(ended, "final").otherwise("live"), "state": F.lit("active"), "reads": F.col("reads") + number}
        )
        live.merge_batch(base, keep=2)(live.with_metrics(wide), number)

    tick(0, ["a"])
    tick(1, ["a", "b"], ended=["a"])
    tick(1, ["a", "b"], ended=["a"])
    tick(2, ["b", "c"])
    ticks = live.read_ticks(spark, base)
    found = {r.tick: (r.seen, r.new, r.ended, r.live) for r in live.fleet_by_tick(ticks).collect()}
    assert found == {0: (1, 1, 0, 1), 1: (2, 1, 1, 1), 2: (2, 1, 0, 2)}
    trend = M.value_trend(ticks.filter("metric_name = 'read_edit_ratio'"))
    assert {r[KEY]: r.history for r in trend.collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0], "c": [5.0]}
    from turnwise.sources import stores

    assert {r[KEY]: r.reads for r in stores.read_latest(spark, base).collect()} == {"a": 2, "b": 4, "c": 5}
    assert stores.versions(spark, base) == [2, 3]


def test_longest_root_wins(spark):
    paths = spark.createDataFrame([(p,) for p in ("/a/b/c.jsonl", "/a/x.jsonl", "/ab/c.jsonl", "/a", "rel/y", "/a/x.jsonl")], "path string")
    roots = spark.createDataFrame([("/a/",), ("/a/b",), ("/a",), ("rel",), ("/z",)], "root_path string")
    found = {r.path: r.root_path for r in R.longest_roots(paths, roots).collect()}
    assert found == {"/a/b/c.jsonl": "/a/b", "/a/x.jsonl": "/a", "/ab/c.jsonl": None, "/a": "/a", "rel/y": "rel"}
    same = R.match_roots(paths, ["/a/", "/a/b", "rel", "/z"]).distinct()
    assert {r.path: (r.root_path, r.root_id) for r in same.collect()} == {
        r.path: (r.root_path, r.root_id) for r in R.longest_roots(paths, roots).collect()
    }
    assert R.longest_roots(paths, roots.limit(0)).filter("root_path is not null").count() == 0


def test_limits_are_learnt_once(spark, tmp_path):
    from turnwise.plans import calibration

    base, caps = str(tmp_path / "limits"), {"stop_phrase": (1.0, 3.0)}

    def finished(*items):
        rows = [(k, end, {"stop_phrase": float(v), "parse_health": 1.0}) for k, end, v in items]
        return spark.createDataFrame(rows, f"{KEY} string, ended_at int, metrics map<string,double>")

    def observe(*items):
        out = calibration.observe(spark, base, finished(*items), caps, n=4)
        return None if out is None else {r.metric_name: (r.n, round(r.warn, 9), round(r.critical, 9)) for r in out.collect()}

    assert observe(("a", 1, 0), ("b", 2, 10)) is None
    rows = spark.createDataFrame([("a", "stop_phrase", "warn", "x")], f"{KEY} string, metric_name string, severity string, label string")
    assert calibration.snapshots_while_observing(spark, base, rows, n=4).first().label == "x [bootstrap 3/4]"
    # the same sessions again count once
    assert observe(("a", 1, 0), ("b", 2, 10)) is None
    assert calibration.observed_sessions(spark, base).count() == 2
    limits = observe(("e", 9, 99), ("c", 5, 20), ("d", 6, 30))
    assert limits == {"stop_phrase": (4, 1.0, 28.5)}
    assert calibration.observed_sessions(spark, base).count() == 4
    # later sessions change nothing
    assert observe(("f", 10, 1_000)) == limits
    assert calibration.snapshots_while_observing(spark, base, rows, n=4).first().label == "x"


def test_a_metric_that_fails_costs_its_own_values_only(spark, tmp_path):
    state = processor()
    send(state, Clock(1), segment(1, calls=1, categories=["read"], messages=1, run_first=1, run_last=1, run_max=1))
    # votes of a wrong length break the turns, a missing list of looks the read/edit ratio
    bad = segment(2, calls=1, categories=["mutation"], messages=1, run_first=1, run_last=1, run_max=1, votes=[1])
    (row,) = send(state, Clock(2), bad)
    assert (row.event_count, row.calls, row.run_max, row.categories) == (2, 2, 2, ["read", "mutation"])
    assert json.loads(row.problems) == [{"collector": "turns", "exception_type": "ValueError"}]
    assert sum(row.votes) == 0
    (row,) = send(state, Clock(3), segment(3, calls=1, categories=["read"]))
    assert row.problems is None and row.calls == 3
    rows = spark.createDataFrame([row.to_dict() | {"problems": json.dumps([{"collector": "turns", "exception_type": "E"}])}], live.OUTPUT)
    live.merge_batch(str(tmp_path / "live"))(live.with_metrics(S.session_columns(rows)), 0)
    drift = spark.read.parquet(str(tmp_path / "live" / "drift")).first()
    assert (drift.code, json.loads(drift.context)["collector"]) == ("collector_unexpected_exception", "turns")
