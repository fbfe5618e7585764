"""Operator 2: lines that many documents share, by levelled sorted runs of line hashes.

Batches of documents go through one after the other.  The runs hold, per line hash, in
how many documents of earlier batches it was seen, sorted by hash; ``fanout`` runs of
one level are merged into one of the next.  A hash that reaches the limit is closed:
later batches anti-join the closed hashes and add only what is left.

Defined cases: a null or empty text is one empty line; lines without a key (nothing
but white space) always stay; a line repeated in one document counts once there;
every row is a document, repeated rows and null ids too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import SPACES, discard, lower_ascii, saved, text_of


def line_keys(docs: DataFrame, least_chars: int = 1, batches: int = 4) -> DataFrame:
    """doc_id, text_hash, batch, keys: the 128-bit key hash of each line, null if too short."""
    stripped = F.transform(
        F.split(lower_ascii(text_of()), "\n"), lambda x: F.trim(x, F.lit(SPACES))
    )
    keys = F.transform(stripped, lambda x: F.when(F.char_length(x) >= least_chars, F.md5(x)))
    text_hash = F.xxhash64("text")
    return docs.select(
        "doc_id",
        text_hash.alias("text_hash"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch"),
        keys.alias("keys"),
    )


class LineRuns:
    """Levels of sorted runs (key, n); ``closed`` are the keys that reached the limit."""

    def __init__(self, min_docs: int, fanout: int = 4):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.closed: list[DataFrame] = []
        self.tables: list[DataFrame] = []

    def _sorted(self, counts: DataFrame) -> DataFrame:
        self.tables.append(saved(counts.sortWithinPartitions("key")))
        return self.tables[-1]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionAll(run)
        return rows.groupBy("key").agg(F.sum("n").alias("n"))

    def _unclosed(self, rows: DataFrame) -> DataFrame:
        for run in self.closed:
            rows = rows.join(run, "key", "left_anti")
        return rows

    def add(self, batch: DataFrame) -> None:
        """Count a batch's keys (column ``keys``), leave out closed ones, add a run."""
        counts = (
            batch.select(F.explode(F.array_distinct("keys")).alias("key"))
            .where("key is not null")
            .groupBy("key")
            .agg(F.count("*").alias("n"))
        )
        self.levels[0].append(self._sorted(self._unclosed(counts)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge a level's runs into one of the next; keys at the limit become closed."""
        merged = self._sorted(self._merged(self.levels[level]))
        self.levels[level] = []
        self.closed.append(self._sorted(merged.where(F.col("n") >= self.min_docs).select("key")))
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(merged.where(F.col("n") < self.min_docs))

    def frequent(self) -> DataFrame:
        """All keys found in at least ``min_docs`` documents so far."""
        runs = [run for level in self.levels for run in level]
        found = self._unclosed(self._merged(runs)).where(F.col("n") >= self.min_docs).select("key")
        for run in self.closed:
            found = found.unionAll(run)
        return found


def drop_shared_lines(
    docs: DataFrame, min_docs: int = 10, least_chars: int = 1, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` in place of the lines.

    Line hashes travel, texts are joined once with one flag list per document.  A very
    common line is one key of a join that Spark splits; its counts are sums.
    """
    keys = saved(line_keys(docs, least_chars, batches), "batch")
    runs = LineRuns(min_docs, fanout)
    for number in range(batches):
        runs.add(keys.where(F.col("batch") == number))
    frequent = saved(runs.frequent().withColumn("drop", F.lit(True)))
    lines = keys.select("doc_id", "text_hash", F.posexplode("keys").alias("pos", "key"))
    found = lines.where("key is not null").join(frequent, "key")
    # Rows with the same id and text have the same lines: a set is one row's list.
    drops = saved(
        found.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("places"))
    )
    discard(keys, frequent, *runs.tables)
    drops = drops.withColumn("places", F.sort_array("places"))
    # the row itself is one column, so no name of its can clash
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").alias("own_id"),
        F.xxhash64("text").alias("own_hash"),
        text_of().alias("own_text"),
    )
    drops = drops.withColumnsRenamed({"doc_id": "drop_id", "text_hash": "drop_hash"})
    rows = rows.join(
        drops,
        F.col("own_id").eqNullSafe(F.col("drop_id")) & (F.col("own_hash") == F.col("drop_hash")),
        "left",
    )
    rows = rows.withColumn("lines", F.split("own_text", "\n"))
    # the kept stretches between two dropped places, so the work is linear in the lines
    none = F.array().cast("array<int>")
    before = F.concat(F.array(F.lit(-1)), F.coalesce("places", none))
    until = F.array_append(F.coalesce("places", none), F.size("lines"))
    stretches = F.zip_with(before, until, lambda a, b: F.slice(F.col("lines"), a + 2, b - a - 1))
    kept = F.when(F.col("places").isNull(), F.col("own_text")).otherwise(F.array_join(F.flatten(stretches), "\n"))
    results = ("kept_text", "n_lines", "n_dropped")
    return rows.select(
        *(F.col(f"row.`{c}`") for c in docs.columns if c not in results),
        kept.alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )
