"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.sources.session import scratch_dir

#: The white space that separates words, as a character class.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Whether the shuffle files of a statement are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back.

    The written table cuts the lineage: a lost executor costs a reread, never a
    recomputation that could split or order the rows differently.  The shuffle files of
    the write go with it; they would stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/turnwise-llm/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._saved_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove the files of ``saved`` tables that nothing will read again."""
    for table in tables:
        where = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table._saved_at)
        where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of finished statements that nothing refers to.

    It finds them when the driver's JVM collects its garbage, which may be long after.
    """
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else unchanged."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def hash_sample(rows: DataFrame, label: str, per_label: int, *identity: str) -> DataFrame:
    """About ``per_label`` rows of every value of ``label``, by a hash of ``identity``.

    A row's place is a number from 0 to 1; those below 1.5 * per_label / count stay, so
    no label is gathered or sorted anywhere.  Column ``place`` orders what is left.
    """
    counts = saved(rows.groupBy(label).agg(F.count("*").alias("_count")))
    placed = rows.withColumn("place", F.pmod(F.xxhash64(*identity), F.lit(1 << 40)) / float(1 << 40))
    kept = placed.join(counts, label).where(F.col("place") * F.col("_count") < 1.5 * per_label)
    return kept.drop("_count")
