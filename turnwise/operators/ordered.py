"""Ordered operators that do not put a whole session into one task.

A plain ``Window.partitionBy(session).orderBy(seq)`` sorts each session in one
task; a session holding a third of all rows would be that task.  These operators
work in two levels instead:

1. inside a (session, chunk) group, whose size the chunk span bounds;
2. across chunks, on one small summary row per (session, chunk).

The summaries come from a partial aggregation, and the join back is on
(session, chunk), so no join key is larger than a chunk either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.model import CHUNK, KEY, SEQ

_START = Window.unboundedPreceding


def beside(rows: DataFrame, other: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Left join of one row per session to another, by merging both.

    Such tables grow with the sessions.  A report has about ten of them; each would pass
    for small by itself, and together they would lie in the driver as broadcasts.
    """
    return rows.join(other.hint("merge"), list(keys), "left")


def of_chunks(df: DataFrame, chunks: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of rows to one row per (keys, chunk), by merging both.

    The rows lie by (keys, chunk) already, and a table of chunks grows with the sessions
    as one of sessions does (``beside``).
    """
    return df.join(chunks.hint("merge"), [*keys, CHUNK], how)


def running_sum(
    df: DataFrame,
    value: Column,
    out: str,
    *,
    keys: Sequence[str] = (KEY,),
    order: Sequence[str] = (SEQ,),
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the rows up to and including this one."""
    keys = list(keys)
    here = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(_START, 0)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(_START, -1)
    base = (
        df.groupBy(*keys, CHUNK)
        .agg(F.sum(value).alias("_chunk_sum"))
        .select(*keys, CHUNK, F.coalesce(F.sum("_chunk_sum").over(before), F.lit(0)).alias("_base"))
    )
    return (
        of_chunks(df.withColumn("_local", F.sum(value).over(here)), base, keys)
        .withColumn(out, F.col("_local") + F.col("_base"))
        .drop("_local", "_base")
    )


def last_before(
    df: DataFrame,
    value: Column,
    out: str,
    *,
    keys: Sequence[str],
    order: Sequence[str] = (SEQ,),
) -> DataFrame:
    """Add ``out`` = largest non-null ``value`` among strictly earlier rows.

    ``value`` has to grow with the order (an index or a time), so that "largest"
    is also "latest".
    """
    keys = list(keys)
    here = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(_START, -1)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(_START, -1)
    carry = (
        df.groupBy(*keys, CHUNK)
        .agg(F.max(value).alias("_chunk_last"))
        .select(*keys, CHUNK, F.max("_chunk_last").over(before).alias("_carry"))
    )
    return (
        of_chunks(df.withColumn("_local", F.max(value).over(here)), carry, keys)
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry")
    )


def latest_chunks(df: DataFrame, n: int, *, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """(keys, chunk) of the last chunks that together hold a key's last ``n`` rows.

    From a count per chunk: a chunk stays while fewer than ``n`` rows come after it.
    """
    keys = list(keys)
    later = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(_START, -1)
    counts = df.groupBy(*keys, CHUNK).agg(F.count("*").alias("_rows"))
    after = F.coalesce(F.sum("_rows").over(later), F.lit(0))
    return counts.withColumn("_after", after).filter(F.col("_after") < n).select(*keys, CHUNK)


def newest(
    df: DataFrame, n: int, *, keys: Sequence[str] = (KEY,), order: Sequence[str] = (SEQ,)
) -> DataFrame:
    """Keep each key's last ``n`` rows.

    Where there are chunks, only the last ones that hold ``n`` rows are ranked: at most
    ``n`` rows and one chunk of a key meet in one task, however many splits its rows
    come from.  ``order`` has to grow with the chunk.  Without chunks Spark prunes to
    ``n`` rows per key inside every map task (window group limit).
    """
    if CHUNK in df.columns:
        df = of_chunks(df, latest_chunks(df, n, keys=keys), keys, "left_semi")
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def with_key_minimum(
    df: DataFrame, value: Column, out: str, *, keys: Sequence[str] = (KEY,)
) -> DataFrame:
    """Add ``out`` = minimum of ``value`` over the whole key, null when it has none."""
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    lows = (
        df.groupBy(*keys, CHUNK)
        .agg(F.min(value).alias("_chunk_min"))
        .select(*keys, CHUNK, F.min("_chunk_min").over(whole).alias(out))
    )
    return of_chunks(df, lows, keys)


def longest_run(
    df: DataFrame, hit: Column, out: str, *, keys: Sequence[str] = (KEY,)
) -> DataFrame:
    """Per key, the longest run of consecutive rows where ``hit`` holds.

    Rows between two misses share a running miss count; the run length is a
    plain count by that number, which combines map-side however long the run.
    """
    keys = list(keys)
    narrow = df.select(*keys, CHUNK, SEQ, F.coalesce(hit, F.lit(False)).alias("_hit"))
    marked = running_sum(narrow, F.when(F.col("_hit"), 0).otherwise(1), "_misses", keys=keys)
    runs = marked.groupBy(*keys, "_misses").agg(F.count_if("_hit").alias("_run"))
    return runs.groupBy(*keys).agg(F.max("_run").alias(out))
