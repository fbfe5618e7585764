"""Operator 1: exact duplicates by content-defined chunk recipes.

A text is cut where its own content says so, every distinct chunk gets an identifier
that is verified against the chunk's content, and two texts are equal when their
ordered identifier lists are.  Chunk content is moved once, reduced to distinct chunks
before the shuffle; from then on a document is a list of 8 bytes per chunk.
DataFrame functions only.

Defined cases: a null text is an empty one; empty texts form one group; of equal rows
(same id, same text) exactly one stays; a null id loses against any other, and a group
of null ids only keeps one of them, with a null keep_id.  Columns other than
``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.llm.common import saved, text_of


def chunk_pattern(least: int = 256, most: int = 2048) -> str:
    """Chunks end at the first sentence or line end after ``least`` characters.

    Boundaries depend on nearby text only, so texts that differ in one place share the
    chunks elsewhere.  Without such an end a chunk stops at ``most`` characters.
    """
    return rf"(?s).{{{least},{most}}}?(?:[.!?]\s|\n)|.{{1,{most}}}"


def _chunks(pattern: str) -> Column:
    return F.regexp_extract_all(text_of(), F.lit(pattern), F.lit(0))


def clashing_chunks(docs: DataFrame, pattern: str, key: Callable[[Column], Column]) -> DataFrame:
    """Chunks whose key some other content has too, numbered: key, chunk, number.

    Every distinct chunk of the corpus is compared; only those that clash are kept,
    which with a 64-bit key is next to none.
    """
    pieces = docs.select(F.explode(_chunks(pattern)).alias("chunk"))
    pieces = pieces.select(key(F.col("chunk")).alias("key"), "chunk").distinct()
    shared = saved(pieces.groupBy("key").count().where("count > 1").select("key"))
    if shared.isEmpty():
        return shared.select("key", F.lit("").alias("chunk"), F.lit(0).alias("number"))
    by_key = Window.partitionBy("key").orderBy("chunk")
    return saved(
        pieces.join(shared, "key", "left_semi").withColumn("number", F.row_number().over(by_key))
    )


def recipes(
    docs: DataFrame,
    pattern: str | None = None,
    key: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """doc_id, recipe (list of verified identifiers) and text_sha256 of every row."""
    pattern = pattern or chunk_pattern()
    docs = docs.select("doc_id", "text")
    clashes = clashing_chunks(docs, pattern, key)
    digest = F.sha2(text_of(), 256).alias("text_sha256")
    keys = F.transform(_chunks(pattern), lambda c: F.struct(key(c).alias("key"), F.lit(0).alias("number")))
    listed = docs.select("doc_id", digest, keys.alias("recipe"))
    if clashes.isEmpty():
        # no clash in the whole corpus: a key alone identifies its chunk
        return listed.withColumn("recipe", F.col("recipe.key"))
    # Only chunks are looked up, by key and content; the identifier is key and number.
    placed = docs.select(
        "doc_id", digest, F.posexplode_outer(_chunks(pattern)).alias("pos", "chunk")
    ).withColumn("key", key(F.col("chunk")))
    placed = placed.join(clashes, ["key", "chunk"], "left").select(
        "doc_id", "text_sha256", "pos", "key", F.coalesce("number", F.lit(0)).alias("number")
    )
    # Equal rows have equal chunks, so a set per (id, digest) is one row's list.
    lists = saved(
        placed.groupBy("doc_id", "text_sha256").agg(
            F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "key", "number"))).alias("found")
        )
    )
    ordered = F.transform(
        F.array_sort("found"), lambda x: F.struct(x["key"].alias("key"), x["number"].alias("number"))
    )
    rows = listed.drop("recipe").alias("a").join(
        lists.withColumn("recipe", ordered).alias("b"),
        F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
        & (F.col("a.text_sha256") == F.col("b.text_sha256")),
    )
    return rows.select("a.doc_id", "b.recipe", "a.text_sha256")


def exact_duplicates(
    docs: DataFrame,
    pattern: str | None = None,
    key: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows of one id and recipe are counted first, groups next, so a group of any size
    is sums in every task; the join back is on tables whose skew Spark can split.
    """
    same = saved(
        recipes(docs, pattern, key)
        .groupBy("doc_id", "recipe", "text_sha256")
        .agg(F.count("*").alias("copies"))
    )
    groups = saved(
        same.groupBy("recipe").agg(
            F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")
        )
    )
    joined = same.join(groups, "recipe").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )
