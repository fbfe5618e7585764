"""Operator 9: document fingerprints by order MinHash.

A text is a row of words; its k-mers of words are numbered by occurrence, so that a
repeated one counts again.  For each of ``size`` hash functions the ``tuple_size``
numbered k-mers with the least hashes are taken, put back into text order, and hashed
together.  Two fingerprints agree in a place when both the k-mers and their order do,
so likeness follows edit distance, not just shared words.

Neighbours in the order of ids are found by one range of rows per task: each range also
gets the first row of the next one, so every text moves once.

Defined cases: a null text is an empty one; texts without words share one fingerprint,
as equal texts always do; a text with fewer than k words is one k-mer; a null id is the
smallest; rows with one id are ordered by the hash of their text; a single row is its
own next document; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import saved

#: Words longer than this (text without spaces) are taken character by character.
LONGEST = 32
#: K-mers hashed at once.
BLOCK = 1 << 14


class _WordHashes(dict):
    """Hashes of words, computed when first asked for."""

    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


class OrderMinHash:
    """Fingerprints of ``size`` places of 16 bits."""

    def __init__(self, k: int = 2, tuple_size: int = 2, size: int = 64, seed: int = 1):
        self.k, self.tuple_size, self.size = k, tuple_size, size
        draw = np.random.default_rng(seed)
        self.factor = draw.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = draw.integers(0, 1 << 63, size, dtype=np.uint64)
        self.mix = draw.integers(0, 1 << 63, max(k, tuple_size), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._words = _WordHashes()

    def _symbols(self, text: str) -> np.ndarray:
        """A 64-bit hash per word."""
        words = text.split()
        if words and max(map(len, words)) > LONGEST:
            words = [p for w in words for p in ([w] if len(w) <= LONGEST else w)]
        if len(self._words) > 300_000:
            self._words.clear()
        return np.fromiter(map(self._words.__getitem__, words), np.uint64, len(words))

    def _numbered(self, symbols: np.ndarray) -> np.ndarray:
        """A hash per k-mer and occurrence."""
        k = min(self.k, len(symbols))
        mers = np.zeros(len(symbols) - k + 1, np.uint64)
        for i in range(k):
            mers = (mers ^ (mers >> np.uint64(29))) * self.mix[i] + symbols[i : len(symbols) - k + 1 + i]
        ranked = np.sort(mers)
        again = ranked[1:][ranked[1:] == ranked[:-1]]
        if len(again):
            # only k-mers that occur more than once need a number
            where = np.flatnonzero(np.isin(mers, again))
            order = where[np.argsort(mers[where], kind="stable")]
            ranked = mers[order]
            start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            number = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
            mers[order] += number.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        mers = (mers ^ (mers >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return mers ^ (mers >> np.uint64(32))

    def fingerprint(self, text: str) -> np.ndarray:
        symbols = self._symbols(text)
        if not len(symbols):
            return np.zeros(self.size, np.uint16)
        mers = self._numbered(symbols)
        take = min(self.tuple_size, len(mers))
        places = np.empty((self.size, 0), np.int64)
        least = np.empty((self.size, 0), np.uint64)
        for start in range(0, len(mers), BLOCK):
            part = mers[start : start + BLOCK]
            hashes = part[None, :] * self.factor[:, None]
            hashes += self.shift[:, None]
            here = np.empty((self.size, min(take, len(part))), np.int64)
            low = np.empty(here.shape, np.uint64)
            rows = np.arange(self.size)
            for i in range(here.shape[1]):
                here[:, i] = hashes.argmin(axis=1)
                low[:, i] = hashes[rows, here[:, i]]
                hashes[rows, here[:, i]] = np.iinfo(np.uint64).max
            places = np.concatenate([places, here + start], axis=1)
            least = np.concatenate([least, low], axis=1)
            if places.shape[1] > take:
                best = np.argsort(least, axis=1, kind="stable")[:, :take]
                places, least = np.take_along_axis(places, best, 1), np.take_along_axis(least, best, 1)
        places.sort(axis=1)
        out = np.zeros(self.size, np.uint64)
        for i in range(take):
            out = (out ^ (out >> np.uint64(31))) * self.mix[i] + mers[places[:, i]]
        return (out * self.mix[0] >> np.uint64(48)).astype(np.uint16)


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Share of the places where two fingerprints agree."""
    return float((one == two).mean())


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _compare(batches: Iterator[pa.RecordBatch], options: dict) -> Iterator[pa.RecordBatch]:
    """Rows in order; a row is answered when the next one is there.  Guests only answer."""
    maker = OrderMinHash(**options)
    hexed = lambda f: f.astype(">u2").tobytes().hex()
    waiting: tuple | None = None
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for doc_id, text, guest in zip(batch["doc_id"], batch["text"], batch["guest"]):
            text = text.as_py()
            own = maker.fingerprint(text)
            if waiting is not None:
                w_id, w_text, w_own = waiting
                changed = edited(w_text, text)
                other = maker.fingerprint(changed)
                digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                row = (w_id, len(w_text), digest, hexed(w_own), hexed(other), likeness(w_own, other), likeness(w_own, own))
                for column, value in zip(out, row):
                    column.append(value)
            waiting = None if guest.as_py() else (doc_id.as_py(), text, own)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in _RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
    if waiting is not None:
        raise AssertionError("a range of rows came without the first row of the next")


class _Cuts:
    """Borders of ranges in the order (place, tie); an id that many rows have gets several.

    ``found`` are quantiles of the places.  A place that is k of them is cut k times, at
    even steps of the tie, which is a hash of the text.
    """

    def __init__(self, found: list[float]):
        self.places, self.times = np.unique(np.array(found, float), return_counts=True)
        self.before = np.concatenate([[0], np.cumsum(self.times)])

    def number(self, places: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """A row's range, 0 for the greatest place and tie."""
        at = np.searchsorted(self.places, places)
        passed = self.before[at]
        if len(self.places):
            own = np.minimum(at, len(self.places) - 1)
            step = np.floor((ties.astype(float) / 2.0**64 + 0.5) * self.times[own])
            step = 1 + np.clip(step, 0, self.times[own] - 1).astype(np.int64)
            passed = passed + np.where((at < len(self.places)) & (self.places[own] == places), step, 0)
        return self.before[-1] - passed


def fingerprints(docs: DataFrame, rows_per_range: int = 2_000, most_ranges: int = 10_000, **options) -> DataFrame:
    """One row per document: its own and its edited text's fingerprint, and likenesses.

    Rows are cut into ranges of the order (id descending, then the text's hash), at
    approximate quantiles of the ids and, where many rows have one id or none, evenly
    inside it.  Equal rows stay together.  The driver holds one cut and one first row's id a
    range, at most ``most_ranges`` of them; where exactly the cuts lie changes no result.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("text").alias("tie"),
    )
    # null is the smallest id; as a double it only decides the range
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    narrow = saved(rows.select(place.alias("place"), "doc_id", "tie"))
    count = narrow.count()
    if not count:
        return spark.createDataFrame([], _RESULT)
    ranges = min(most_ranges, max(1, count // rows_per_range))
    shares = [i / ranges for i in range(1, ranges)]
    found = narrow.agg(F.percentile_approx("place", shares, 20 * ranges).alias("c")).first()["c"] if shares else []
    cuts = _Cuts(found)

    @F.pandas_udf("int")
    def number(places: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(cuts.number(places.to_numpy(), ties.to_numpy()))

    order = F.struct("place", "doc_id", "tie")
    firsts = narrow.withColumn("range", number("place", "tie")).groupBy("range").agg(F.max(order).alias("first"))
    first = {r["range"]: r["first"] for r in firsts.collect()}
    names = sorted(first)
    # the first row of a range is also the guest at the end of the one before
    hosts = spark.createDataFrame(
        [(names[i - 1], first[name]["doc_id"], first[name]["tie"]) for i, name in enumerate(names)],
        "host int, g_id bigint, g_tie bigint",
    )
    # at most one row per range: small by construction
    visiting = rows.join(
        F.broadcast(hosts), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie"))
    ).dropDuplicates(["host"])
    columns = ["doc_id", "text", "tie", "range", "guest"]
    placed = rows.withColumn("place", place).withColumn("range", number("place", "tie")).withColumn("guest", F.lit(False))
    visiting = visiting.withColumn("range", F.col("host")).withColumn("guest", F.lit(True))
    dealt = placed.select(*columns).unionAll(visiting.select(*columns)).repartition(len(names), "range")
    ordered = dealt.sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return ordered.mapInArrow(lambda batches: _compare(batches, options), _RESULT)
