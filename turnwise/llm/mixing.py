"""Operator 5: a mix of sources at target weights.

Every document gets a hash-random key.  Within a source the documents are in the order
of that key; distributed prefix sums of their word counts say where each one lies, and
a source's exact budget is cut there: whole rounds first, then the next words in order.

Defined cases: a null or empty text has size 0 and is never taken from; the null source
is a source, last in order; equal rows are separate documents (which of them lies first
makes no difference to the result); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.llm.common import WORD, saved, text_of

#: Fixed values of the mix: weights in source order, repeating.
WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, key and text_hash; the only pass over the texts."""
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string"), "text")).alias("key"),
        F.xxhash64("text").alias("text_hash"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: one row per source.

    The level L at which the sums of min(most * size, weight * L) reach the budget is
    found from running sums over the sources in the order of most * size / weight; this
    is what resharing the excess by weight, again and again, ends at.
    """
    total = saved(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = (
        total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("capped", F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    )
    level = (F.col("budget") - F.coalesce("capped", F.lit(0.0))) / F.col("open")
    # the first source, in order, that its level does not fill sets the level of the rest
    rows = rows.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    level = F.first("level", ignorenulls=True).over(
        full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    # no such source: every source is full
    target = F.least("cap", F.coalesce(F.col("weight") * F.col("set"), F.col("cap")))
    return rows.withColumn("set", level).select(
        "source", "source_size", F.greatest(target, F.lit(0.0)).alias("target")
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    rows_per_chunk: int = 500,
    most_chunks: int = 65_536,
) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, taken: one row per document.

    A source of any size is spread over chunks of its key's range: keys are uniform, so
    chunks are even, and a chunk's offset comes from one sum per (source, chunk).
    """
    sized = saved(sizes(docs, seed))
    chunks = min(most_chunks, max(1, -(-sized.count() // rows_per_chunk)))
    plan = saved(targets(sized, weights, share, most))
    part = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(chunks)
    placed = sized.withColumn("chunk", F.shiftright(part, 32).cast("int"))
    sums = placed.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    offsets = saved(
        offsets.join(plan, offsets["source"].eqNullSafe(plan["source"])).select(
            offsets["source"].alias("_source"), F.col("chunk").alias("_chunk"), "before", "source_size", "target"
        )
    )
    inside = (
        Window.partitionBy("source", "chunk")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = placed.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = local.join(
        offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("chunk") == F.col("_chunk"))
    )
    budget = F.floor(F.col("target"))
    rounds = F.floor(budget / F.greatest("source_size", F.lit(1)))
    rest = budget - rounds * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("local")))
    return rows.select(
        "doc_id",
        "source",
        "text_hash",
        "size",
        "source_size",
        "target",
        (rounds * F.col("size") + part).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows: a document once per full round, and its first words where the cut is.

    Columns are those of ``docs``; ``n_chars``, where there is one, is counted again.
    """
    plan = mix(docs, **options).where("size > 0")
    plan = saved(
        plan.groupBy("doc_id", "text_hash", "size")
        .agg(F.count("*").alias("rows"), F.sum("taken").alias("words"))
        .where("words > 0")
    )
    plan = plan.withColumnsRenamed({c: f"plan_{c}" for c in plan.columns})
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").alias("own_id"),
        F.xxhash64("text").alias("own_hash"),
    )

    def joined(some: DataFrame) -> DataFrame:
        return rows.join(
            some,
            F.col("own_id").eqNullSafe(F.col("plan_doc_id")) & (F.col("own_hash") == F.col("plan_text_hash")),
        )

    # equal rows were added up: one of them stands for all
    several = saved(plan.where("plan_rows > 1"))
    found = joined(plan.where("plan_rows = 1")).unionAll(joined(several).dropDuplicates(["own_id", "own_hash"]))
    full, rest = F.expr("plan_words div plan_size"), F.col("plan_words") % F.col("plan_size")
    parts = F.concat(
        F.array_repeat(F.col("plan_size"), full.cast("int")),
        F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")),
    )
    found = found.withColumn("part", F.explode(parts))
    space = WORD.replace("[^", "[")[:-1]
    first = F.concat(F.lit(f"^(?:{space}*+{WORD}+){{"), F.col("part").cast("string"), F.lit("}+"))
    text = F.col("row.text")
    text = F.when(F.col("part") == F.col("plan_size"), text).otherwise(F.call_function("regexp_extract", text, first, F.lit(0)))
    found = found.withColumn("new_text", text)
    again = {"text": F.col("new_text"), "n_chars": F.char_length("new_text").cast("long")}
    return found.select(*(again.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
