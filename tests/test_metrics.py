import random

import lines as L
import pytest
from pyspark.sql import functions as F

from turnwise.functions import text
from turnwise.model import KEY, LOOP_PHRASES, STOP_PHRASES, Phrase
from turnwise.operators import metrics as M
from turnwise.operators import normalize as N
from turnwise.operators import ordered, ranks
from turnwise.operators import turns as T

SCHEMA = (
    "session_key string, chunk long, seq long, ts timestamp, ts_resolved boolean, kind string, "
    "text string, tool_name string, file_path string, thinking_len int, redacted boolean, signature string"
)


def calls(spark, items, span=7):
    rows = [
        ("s", i // span, i, L.BASE, True, "tool_call", None, t, p, None, None, None)
        for i, (t, p) in enumerate(items)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def messages(spark, texts, span=3):
    rows = [
        ("s", i // span, i, L.BASE, True, "assistant", t, None, None, None, None, None)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def simulate(items, window=50, lookback=20):
    """Straightforward single-list evaluation to compare with."""
    cats = {"read": "read", "grep": "research", "edit": "mutation", "write": "mutation"}
    seen, blind, tail = {}, 0, []
    for n, (tool, path) in enumerate(items, 1):
        c = cats.get(tool, "other")
        tail = [*tail, c][-window:]
        if c == "mutation" and path is not None:
            blind += path not in seen or n - seen[path] > lookback
        elif c in ("read", "research") and path is not None:
            seen[path] = n
    return tail.count("read") / max(tail.count("mutation"), 1), blind


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_read_edit_matches_simulation_for_any_chunking(spark, span):
    rng = random.Random(7)
    items = [
        (rng.choice(["read", "grep", "edit", "write", "bash"]), rng.choice([None, "a", "b", "c", "d"]))
        for _ in range(160)
    ]
    ratio, blind = simulate(items)
    row = M.read_edit(calls(spark, items, span)).first()
    assert row.read_edit_ratio == pytest.approx(ratio)
    assert row.blind_mutations == blind
    rolling = M.rolling_ratio(calls(spark, items, span)).orderBy("seq").collect()
    for i in (0, 49, 50, 120, 159):
        assert rolling[i].read_edit_ratio == pytest.approx(simulate(items[: i + 1])[0])


def test_healthy_and_degraded_sessions(spark):
    healthy = [("read", f"f{i}") for i in range(8)] + [("grep", None), ("edit", "f1")]
    row = M.read_edit(calls(spark, healthy)).first()
    assert (row.read_edit_ratio, row.read_edit_severity) == (8.0, "ok")
    degraded = [("read", "a"), ("read", "b")] + [("edit", "c")] * 9
    row = M.read_edit(calls(spark, degraded)).first()
    assert (round(row.read_edit_ratio, 2), row.read_edit_severity) == (0.22, "critical")
    assert row.read_edit_label == "R:E 0.2"


def test_untracked_paths_are_insufficient(spark):
    row = M.read_edit(calls(spark, [("edit", None)] * 3 + [("edit", "a")])).first()
    assert row.blind_edit_label == "insufficient data"
    assert row.tracking_confidence == 0.25


def test_word_boundaries(spark):
    words = Phrase("actually")
    rows = messages(spark, ["Actually, no", "factually", "éactually", "actually_x", "(actually)"])
    counts = rows.select(text.hit_total(text.hit_counts(F.col("text"), [words]))).collect()
    assert [c[0] for c in counts] == [1, 0, 0, 0, 1]


def test_phrase_modes_offsets_and_context(spark):
    phrases = [
        Phrase("let's pause here", "stop"),
        Phrase("wait", "sub", None, "substring"),
        Phrase("a+b", "lit"),
        Phrase(r"\d{2,}", "num", None, "regex"),
    ]
    body = "é" * 50 + " let's pause here, await a+b 123 " + "z" * 50
    rows = M.phrase_hits(messages(spark, [body]), phrases=phrases).orderBy("start").collect()
    assert [(r.phrase, r.matched, r.start, r.end) for r in rows] == [
        (p, m, body.index(m), body.index(m) + len(m))
        for p, m in [
            ("let's pause here", "let's pause here"),
            ("wait", "wait"),
            ("a+b", "a+b"),
            (r"\d{2,}", "123"),
        ]
    ]
    for r in rows:
        assert r.context_snippet == body[max(0, r.start - 40) : r.end + 40]


def test_stop_phrases_default_table(spark):
    said = ["This is a known limitation and future work.", "All done.", "Should I continue?", ""]
    row = M.stop_phrases(messages(spark, said), phrases=STOP_PHRASES).first()
    assert (row.messages, row.messages_with_hit, row.hits) == (3, 2, 3)
    assert row.stop_phrase_severity == "critical"
    assert row.hits_by_category == {"known_limitation": 2, "permission_seeking": 1}


def test_loops_count_overlapping_phrases_and_bursts(spark):
    said = ["hmm actually", "fine", "actually", "oh wait", "no wait", "fine", "Correction: x"]
    row = M.reasoning_loops(messages(spark, said, span=2), phrases=LOOP_PHRASES).first()
    assert (row.loop_matches, row.max_burst) == (6, 3)
    assert row.reasoning_loop == 6000.0


def test_custom_phrases(spark):
    kept, dropped = text.coerce_phrases(["x", {"text": "y", "mode": "odd"}, {"mode": "word"}, 5])
    assert [(p.text, p.mode, p.category) for p in kept] == [("x", "word", "custom"), ("y", "word", "custom")]
    assert len(dropped) == 2


def test_thinking_medians(spark):
    blocks = [(10, False, "aa"), (30, False, "bbbb"), (0, True, None), (0, False, "")]
    rows = [
        ("s", 0, i, L.BASE, True, "thinking", None, None, None, n, r, g)
        for i, (n, r, g) in enumerate(blocks)
    ]
    row = M.thinking(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row.thinking_blocks, row.visible_blocks, row.visible_chars_median) == (4, 3, 20.0)
    assert row.signature_chars_median == 3.0


def test_registry_rules():
    registry = M.MetricRegistry()
    registry.register("team.x", lambda events: events)
    with pytest.raises(ValueError):
        registry.register("team.x", lambda events: events)
    with pytest.raises(ValueError):
        registry.register("plain", lambda events: events)
    assert registry.select(["prompts"]) == ["parse_health", "prompts"]
    with pytest.raises(ValueError):
        registry.select(["nope"])


def test_report_map_rules(spark):
    row = M.snapshots(calls(spark, [("read", "a")])).select(M.report_map().alias("m")).first()
    assert set(row.m) == {"parse_health", "read_edit_ratio", "blind_edit_rate", "stop_phrase", "reasoning_loop"}
    assert row.m["blind_edit_rate"] == 0.0


def test_turns_end_where_the_next_begins(spark):
    lines = [
        L.assistant(0, L.text("before")),
        L.user(1, "please fix it"),
        L.assistant(2, L.tool("Bash"), L.tool("Edit", "f")),
        L.user(5, [L.text("one"), L.text("two")]),
        L.assistant(9, L.tool("Read", "f")),
    ]
    for span in (1, 1000):
        events = N.events(N.parse_lines(L.frame(spark, {"s": lines}, span=span)))
        rows = T.turns(events).orderBy("turn_no").collect()
        assert [r.task_type for r in rows] == ["debug_loop", "planning", "exploration"]
        assert [(r.ended_at - r.started_at).seconds for r in rows] == [4, 0, 4]
        assert [r.event_count for r in rows] == [3, 1, 2]
        label = T.session_label(T.turns(events)).first()
        assert (label.n_turns, label.session_task_type) == (3, "mixed")


def test_ordered_helpers_do_not_depend_on_chunks(spark):
    rng = random.Random(3)
    flags = [rng.random() < 0.6 for _ in range(100)]
    best = run = 0
    for f in flags:
        run = run + 1 if f else 0
        best = max(best, run)
    for span in (1, 9, 500):
        df = spark.createDataFrame(
            [("s", i // span, i, f) for i, f in enumerate(flags)],
            "session_key string, chunk long, seq long, f boolean",
        )
        assert ordered.longest_run(df, F.col("f"), "n").first().n == best
        sums = ordered.running_sum(df, F.col("f").cast("int"), "t").orderBy("seq").collect()
        assert [r.t for r in sums] == [sum(flags[: i + 1]) for i in range(100)]
        last = ordered.last_before(df, F.when(F.col("f"), F.col("seq")), "p", keys=["session_key"])
        want = [max((j for j in range(i) if flags[j]), default=None) for i in range(100)]
        assert [r.p for r in last.orderBy("seq").collect()] == want


def test_exact_quantiles_for_any_bucket_count(spark):
    rng = random.Random(5)
    values = [float(rng.choice([0, 0, 0, rng.randint(1, 50), rng.random()])) for _ in range(201)]
    df = spark.createDataFrame([("m", v) for v in values], "g string, v double")
    ordered_values = sorted(values)
    for buckets in (2, 16, 256):
        q = ranks.exact_quantiles(df, "g", "v", [0.05, 0.5, 0.95], buckets=buckets).first().q
        for p, got in zip([0.05, 0.5, 0.95], q):
            place = p * 200
            lo, hi = int(place), min(int(place) + 1, 200)
            want = ordered_values[lo] + (ordered_values[hi] - ordered_values[lo]) * (place - lo)
            assert got == pytest.approx(want)


def test_last_rows_come_from_the_last_chunks_alone(spark):
    """A session in 1,000 chunks: few rows are ranked, and they are the right ones."""
    rows = spark.range(20_000, numPartitions=50).select(
        F.when(F.col("id") % 10 == 3, "small").otherwise("hot").alias(KEY),
        F.floor(F.col("id") / 20).alias("chunk"),
        F.col("id").alias("seq"),
    )
    kept = ordered.latest_chunks(rows, 50)
    ranked = rows.join(kept, [KEY, "chunk"], "left_semi").groupBy(KEY).count().collect()
    # at most the rows asked for and one chunk
    assert {r[KEY]: r["count"] for r in ranked} == {"hot": 54, "small": 50}
    last = {r[KEY]: r.s for r in ordered.newest(rows, 50).groupBy(KEY).agg(F.sort_array(F.collect_list("seq")).alias("s")).collect()}
    assert last["hot"] == [i for i in range(20_000) if i % 10 != 3][-50:]
    assert last["small"] == [i for i in range(20_000) if i % 10 == 3][-50:]
    plain = ordered.newest(rows.drop("chunk"), 50)
    assert plain.exceptAll(ordered.newest(rows, 50).drop("chunk")).count() == 0
