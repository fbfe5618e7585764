"""Conversational turns, their labels, and how well labels agree with people.

A turn can be as large as a session, so it is never gathered into one row: the
turn table holds counts, and the ordered tool list is a table of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import keyword
from turnwise.model import (
    AGREEMENT_GATE,
    CHUNK,
    KEY,
    SEQ,
    TASK_KEYWORDS,
    TASK_LABELS,
    TURN_LOOKUP_TOOLS,
    TURN_MUTATION_TOOLS,
)
from turnwise.operators.ordered import running_sum

Keys = Sequence[str]


def number_turns(events: DataFrame, *, keys: Keys = (KEY,)) -> DataFrame:
    """Add ``turn_no``: each user event opens a turn; events before the first are dropped."""
    opens = F.when(F.col("kind") == "user", 1).otherwise(0)
    return running_sum(events, opens, "turn_no", keys=keys).filter(F.col("turn_no") > 0)


def turns(events: DataFrame, *, keys: Keys = (KEY,)) -> DataFrame:
    """One labelled row per turn.

    A turn that is followed by another ends when that one starts; the last turn
    of a session ends with its last event.
    """
    keys = list(keys)
    narrow = events.select(*keys, CHUNK, SEQ, "kind", "ts", "tool_name", "text")
    is_call = (F.col("kind") == "tool_call") & (F.length("tool_name") > 0)
    # An opening prompt also goes to the turn it closes, so that one aggregation
    # sees a turn's own rows and the start of the next.
    here = F.struct(F.col("turn_no").alias("turn"), F.lit(False).alias("closes"))
    prior = F.struct((F.col("turn_no") - 1).alias("turn"), F.lit(True).alias("closes"))
    spread = number_turns(narrow, keys=keys).select(
        *keys,
        CHUNK,
        SEQ,
        "kind",
        "ts",
        "tool_name",
        "text",
        F.explode(
            F.when(F.col("kind") == "user", F.array(here, prior)).otherwise(F.array(here))
        ).alias("_t"),
    )
    own = ~F.col("_t.closes")
    out = (
        spread.filter(F.col("_t.turn") > 0)
        .groupBy(*keys, F.col("_t.turn").alias("turn_no"))
        .agg(
            F.min_by("ts", SEQ).alias("started_at"),
            F.coalesce(
                F.max(F.when(~own, F.col("ts"))), F.max_by("ts", F.when(own, F.col(SEQ)))
            ).alias("ended_at"),
            F.coalesce(F.min_by("text", SEQ), F.lit("")).alias("user_message_text"),
            F.count_if(own).alias("event_count"),
            F.count_if(is_call).alias("n_tool_calls"),
            F.count_if(is_call & F.col("tool_name").isin(*TURN_MUTATION_TOOLS)).alias("n_mutations"),
            F.count_if(is_call & (F.col("tool_name") == "bash")).alias("n_bash"),
            F.count_if(is_call & F.col("tool_name").isin(*TURN_LOOKUP_TOOLS)).alias("n_lookups"),
        )
    )
    return out.withColumn("task_type", task_label())


def task_label(text: str = "user_message_text") -> Column:
    """Label from the tool counts, else from words in the opening prompt."""
    edits, bash, lookups = F.col("n_mutations"), F.col("n_bash"), F.col("n_lookups")
    label = (
        F.when((edits >= 3) & (bash == 0), "mutation_heavy")
        .when((bash >= 1) & (edits >= 1), "debug_loop")
        .when(F.col("n_tool_calls") == 0, "planning")
        .when((bash == 0) & (edits < 2) & (lookups > 2 * edits), "exploration")
    )
    for name, words in TASK_KEYWORDS:
        label = label.when(F.col(text).rlike(keyword(words)), name)
    return label.otherwise("mixed")


def turn_tools(events: DataFrame, *, keys: Keys = (KEY,)) -> DataFrame:
    """(session, turn, position, tool): every turn's tool calls in order."""
    keys = list(keys)
    calls = number_turns(events.select(*keys, CHUNK, SEQ, "kind", "tool_name"), keys=keys).filter(
        (F.col("kind") == "tool_call") & (F.length("tool_name") > 0)
    )
    return running_sum(calls, F.lit(1), "tool_no", keys=[*keys, "turn_no"]).select(
        *keys, "turn_no", "tool_no", SEQ, CHUNK, "tool_name"
    )


def turn_tool_lists(events: DataFrame, *, keys: Keys = (KEY,)) -> DataFrame:
    """(session, turn, part, tools array): the ordered list, cut at chunk borders.

    A turn inside one chunk has one part, which is its whole list; an array is
    never longer than a chunk.
    """
    keys = list(keys)
    return (
        turn_tools(events, keys=keys)
        .groupBy(*keys, "turn_no", F.col(CHUNK).alias("part"))
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("tool_no", "tool_name"))),
                lambda s: s["tool_name"],
            ).alias("tool_calls")
        )
    )


def session_label(turn_rows: DataFrame, *, keys: Keys = (KEY,)) -> DataFrame:
    """Label held by more than half of a session's labelled turns, else mixed."""
    keys = list(keys)
    votes = (
        turn_rows.filter(F.col("task_type").isNotNull())
        .groupBy(*keys, "task_type")
        .agg(F.count("*").alias("_n"))
    )
    tally = votes.groupBy(*keys).agg(
        F.sum("_n").alias("n_turns"),
        F.max_by("task_type", F.struct("_n", "task_type")).alias("_top"),
        F.max("_n").alias("_top_n"),
    )
    clear = (F.col("n_turns") >= 2) & (F.col("_top_n") * 2 > F.col("n_turns"))
    return tally.select(
        *keys, "n_turns", F.when(clear, F.col("_top")).otherwise("mixed").alias("session_task_type")
    )


def label_timeline(turn_rows: DataFrame, *, keys: Keys = (KEY,)) -> DataFrame:
    """Turn labels in order, as rows."""
    return turn_rows.filter(F.col("task_type").isNotNull()).select(*keys, "turn_no", "task_type")


# ----------------------------------------------------------- calibration


def confusion(labelled: DataFrame, *, actual: str = "label", predicted: str = "predicted") -> DataFrame:
    return labelled.groupBy(
        F.col(actual).alias("actual"), F.col(predicted).alias("predicted")
    ).agg(F.count("*").alias("n"))


def confusion_matrix(
    labelled: DataFrame,
    labels: Sequence[str] = TASK_LABELS,
    *,
    actual: str = "label",
    predicted: str = "predicted",
) -> DataFrame:
    """Actual labels as rows, predicted labels as columns."""
    return (
        labelled.groupBy(F.col(actual).alias("actual"))
        .pivot(predicted, list(labels))
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def precision_recall(pairs: DataFrame) -> DataFrame:
    """Per label: true positives, precision and recall (0 where undefined)."""
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("actual").alias("label"),
                    F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"),
                    F.col("n").alias("as_actual"),
                    F.lit(0).cast("long").alias("as_predicted"),
                ),
                F.struct(
                    F.col("predicted").alias("label"),
                    F.lit(0).cast("long").alias("tp"),
                    F.lit(0).cast("long").alias("as_actual"),
                    F.col("n").alias("as_predicted"),
                ),
            )
        )
    )
    sums = sides.groupBy("label").agg(
        F.sum("tp").alias("tp"),
        F.sum("as_actual").alias("_a"),
        F.sum("as_predicted").alias("_p"),
    )
    return sums.select(
        "label",
        "tp",
        F.coalesce(F.try_divide("tp", "_p"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", "_a"), F.lit(0.0)).alias("recall"),
    )


def agreement(labelled: DataFrame, *, actual: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: sessions, correct ones, share, and whether the gate is met."""
    right = F.count_if(F.col(actual) == F.col(predicted))
    share = F.coalesce(F.try_divide(right, F.count("*")), F.lit(0.0))
    return labelled.agg(
        F.count("*").alias("sessions"),
        right.alias("correct"),
        share.alias("agreement"),
        (share >= AGREEMENT_GATE).alias("passes"),
    )


def misclassified(labelled: DataFrame, *, actual: str = "label", predicted: str = "predicted") -> DataFrame:
    return labelled.filter(~F.col(actual).eqNullSafe(F.col(predicted)))
