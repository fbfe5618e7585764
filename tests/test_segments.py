"""Segments: any cut of a session, merged in any grouping, equals the batch operators."""

import functools
import random

import lines as L
import pytest
from pyspark.sql import functions as F

from turnwise.model import KEY, MetricConfig
from turnwise.operators import metrics as M
from turnwise.operators import normalize as N
from turnwise.operators import reports as R
from turnwise.operators import segments as S
from turnwise.operators import turns as T
from turnwise.streaming import live

CFG = MetricConfig(window_size=7, blind_edit_window=4, confidence_window=9)
TOOLS = ["Read", "Grep", "Edit", "Write", "Bash", "MultiEdit", "Glob", "NotebookEdit", "Odd"]
SAID = ["ok", "actually no", "oh wait", "should I continue", "fine", "actually"]


def transcript(seed, size):
    rng = random.Random(seed)
    out = []
    for i in range(size):
        kind = rng.random()
        mid = f"m{rng.randint(0, size)}" if rng.random() < 0.5 else None
        if kind < 0.1:
            out.append(L.user(i, rng.choice(["fix it", "why", "plan", "add", "hm"]), mid=mid))
        elif kind < 0.2:
            out.append(rng.choice(["{broken", {"type": "mystery"}, {"type": "progress"}]))
        elif kind < 0.3:
            size_ = rng.choice([0, 3, 5, 5, 9])
            out.append(L.assistant(i, {"type": "thinking", "thinking": "x" * size_, "signature": "s" * rng.randint(0, 3)}, mid=mid))
        else:
            blocks = [L.tool(rng.choice(TOOLS), rng.choice(["a", "b", "c", None])) for _ in range(rng.randint(0, 2))]
            if rng.random() < 0.6:
                blocks.append(L.text(rng.choice(SAID)))
            out.append(L.assistant(i, *blocks, mid=mid) if blocks else L.user(i, "go", mid=mid))
    return out


SESSIONS = {f"s{n}": transcript(n, size) for n, size in enumerate([1, 2, 5, 12, 30, 60, 90])}
COUNTERS = [
    "event_count", "calls", "mutations_total", "mutations_with_path", "write_calls", "blind_mutations",
    "messages", "messages_with_hit", "hits", "loop_matches", "thinking_blocks", "visible_blocks", "prompts",
    "total_lines", "parsed_events", "duplicate_count", "reads", "research", "mutations", "other", "window_calls",
    "max_burst", "turns", "session_task_type", "started_at", "ended_at", "last_resolved_at", "parse_confidence",
    "visible_chars_median", "signature_chars_median",
]


def batch_rows(spark):
    """The same columns by the batch operators."""
    parsed = N.parse_lines(L.frame(spark, SESSIONS, span=17))
    events, stats = N.events(parsed), N.parse_stats(N.line_outcomes(parsed), window=CFG.confidence_window)
    wide = M.snapshots(events, stats, cfg=CFG)
    labels = T.session_label(T.turns(events)).withColumnRenamed("n_turns", "turns")
    calls = M.tool_calls(events).groupBy(KEY).agg(F.count("*").alias("calls"))
    stats = stats.select(KEY, "total_lines", "parsed_events", "duplicate_count", "parse_confidence")
    kept = [c for c in COUNTERS if c in wide.columns and c not in stats.columns]
    rows = stats.join(wide.select(KEY, *kept), KEY, "left").join(labels, KEY, "left").join(calls, KEY, "left")
    return {r[KEY]: r.asDict() for r in rows.collect()}


def plain(row):
    """Missing counts are zero: a session without events has no batch row to say so."""
    none = ("session_task_type", "started_at", "ended_at", "last_resolved_at", "visible_chars_median", "signature_chars_median")
    return {c: row[c] if c in none else row[c] or 0 for c in COUNTERS}


@pytest.fixture(scope="module")
def expected(spark):
    return {k: plain(r) for k, r in batch_rows(spark).items()}


def narrow(spark, span):
    kept, _ = live.mark_repeats(live.narrow_lines(L.frame(spark, SESSIONS, span=span)), None)
    return kept


@pytest.mark.parametrize("span", [1, 3, 17, 1000])
def test_any_cut_equals_batch(spark, expected, tmp_path, span):
    S.chunk_segments(narrow(spark, span), CFG).write.parquet(str(tmp_path / "s"))
    segments = spark.read.parquet(str(tmp_path / "s"))
    found = live.with_metrics(S.session_rows(segments, CFG), CFG)
    assert {r[KEY]: plain(r.asDict()) for r in found.collect()} == expected
    assert found.filter("metrics is null").count() == 0


def test_tree_folds_equal_one_pass(spark, tmp_path):
    S.chunk_segments(narrow(spark, 1), CFG).write.parquet(str(tmp_path / "s"))
    segments = spark.read.parquet(str(tmp_path / "s"))
    rows = lambda fan: sorted(S.fold(segments, CFG, fan=fan).collect(), key=lambda r: r[KEY])
    assert rows(2) == rows(64) == rows(7)


def test_merge_is_associative(spark):
    rows = [S.unpack(r.asDict()) for r in S.chunk_segments(narrow(spark, 2), CFG).collect()]
    rng = random.Random(3)
    merge = lambda a, b: S.merge(a, b, CFG)

    def any_grouping(parts):
        if len(parts) == 1:
            return parts[0]
        cut = rng.randint(1, len(parts) - 1)
        return merge(any_grouping(parts[:cut]), any_grouping(parts[cut:]))

    for session in SESSIONS:
        parts = sorted((r for r in rows if r[KEY] == session), key=lambda r: r["from_seq"])
        whole = functools.reduce(merge, parts)
        for _ in range(10):
            assert any_grouping(parts) == whole
        assert len(whole["look_paths"]) < CFG.blind_edit_window + 1 and len(whole["edit_paths"]) <= CFG.blind_edit_window


def test_one_shuffle(spark):
    plan = S.chunk_segments(narrow(spark, 17).filter("kind <> 'x'").select("*"), CFG)
    text = plan._jdf.queryExecution().executedPlan().toString()
    # the repeats need theirs; building segments adds one on (session, chunk)
    assert text.count(f"hashpartitioning({KEY}") - text.count("message_id") <= text.count("Exchange hashpartitioning")
    assert sum("chunk#" in part.split("]")[0] for part in text.split("Exchange hashpartitioning")[1:]) == 1


def test_empty(spark, tmp_path):
    rows = spark.createDataFrame([], live.NARROW).withColumn("repeated", F.lit(False))
    S.chunk_segments(rows).write.parquet(str(tmp_path / "s"))
    assert S.session_rows(spark.read.parquet(str(tmp_path / "s"))).count() == 0
