"""Connected components of a graph given as pairs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import discard, saved


def _with_least(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (u, v) and the least neighbour of u, and the tables they are in.

    A hub is a minimum and a join Spark splits.
    """
    edges = saved(edges)
    least = saved(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(least, "u"), [edges, least]


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``pairs`` (columns u, v); root is the least node.

    Large stars hang all greater neighbours on the least one, small stars all smaller
    ones; the rounds grow with the logarithm of the longest path.  Every half round is
    one written table, removed when the next is there; the last one holds the result.
    Raises if the rounds do not suffice, rather than stop early.
    """
    edges = saved(pairs.where("u <> v").select("u", "v").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, used = _with_least(both.distinct())
        large = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # every edge now goes from the greater to the smaller node
        joined, halfway = _with_least(large.where("u <> v").distinct())
        discard(edges, *used)
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = saved(small.where("u <> v").distinct())
        discard(*halfway)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out = saved(roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()))
            discard(edges)
            return out
        before = now
    raise RuntimeError("components did not settle")
