"""Operator 12: ranked lexical search by grouping documents under presence masks.

Items are searched in blocks of bounded text.  For a block, every document becomes the
list of its terms that any item asks for; that table is written once and gives the
counts that weights need.  Then documents go by in blocks: presence bitmaps, one row a
term, say which of an item's terms each document holds, and documents with the same mask
are one group.  A mask's score is at most the sum of its terms' highest parts in the
block, so masks are taken by descending bound, until the bound is below the score of the
item's last place so far.  Each task keeps its best rows per item; their ranking is one
window over a few rows a task.

Terms without weight (floor of the logarithm is 0) can give no score and are left out of
the masks.

Defined cases: a null text has no terms; an item without terms has no result; each row of
the item table is an item and each row of the documents a document, repeated ones too;
equal scores go by ascending doc_id, null ids last; an empty table gives an empty result;
a very long text is one row; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from turnwise.llm.common import saved

#: In ASCII only digits and letters belong to a term, A-Z as a-z.
_TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Text of the items searched at once, in bytes.
ITEM_BYTES = 1 << 20
#: Terms times documents of a block.
CELLS = 1 << 23

_LISTED = "doc_id bigint, n bigint, terms array<int>, times array<int>"
_BEST = "item int, doc_id bigint, score bigint"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def _listed(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Per document with terms: how many it has, and those that items ask for."""
    place = vocabulary.value
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sizes, found = [], []
            for text in part["text"].to_pylist():
                words = terms_of(text)
                sizes.append(len(words))
                found.append(np.fromiter((x for x in map(place.get, words) if x is not None), np.int64))
            home = np.repeat(np.arange(len(found)), [len(f) for f in found])
            key, times = np.unique(home << 32 | np.concatenate(found), return_counts=True)
            ends = np.searchsorted(key >> 32, np.arange(len(found) + 1)).astype("i4")
            rows = pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array((key & 0xFFFFFFFF).astype("i4"))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype("i4"))),
                ],
                ["doc_id", "n", "terms", "times"],
            )
            yield rows.filter(pa.array(np.array(sizes) > 0))


def _counted(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    """A task's number of documents of each term; -1 stands for documents, -2 for terms in all."""
    df, documents, length = np.zeros(terms, np.int64), 0, 0
    for batch in batches:
        ends = batch["terms"].offsets.to_numpy()
        df += np.bincount(batch["terms"].values.to_numpy()[ends[0] : ends[-1]], minlength=terms)
        documents += batch.num_rows
        length += int(batch["n"].to_numpy().sum())
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(held, [-1, -2])), pa.array(np.append(df[held], [documents, length]))], ["term", "count"]
    )


class _Places:
    """An item's best rows so far: (score, doc_id) in order, null ids last among equals."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """A lower score has no place any more."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows += zip(scores.tolist(), ids)
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        del self.rows[self.k :]


def masks_of(presence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks (a row of booleans each) and every document's mask number."""
    bits = np.packbits(presence, axis=0, bitorder="little")
    rows = np.ascontiguousarray(bits.T)
    if rows.shape[1] <= 8:
        wide = np.zeros((len(rows), 8), np.uint8)
        wide[:, : rows.shape[1]] = rows
        found, number = np.unique(wide.view("<u8").ravel(), return_inverse=True)
        rows = found.astype("<u8").view(np.uint8).reshape(-1, 8)
    else:
        found, number = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_inverse=True)
        rows = found.view(np.uint8).reshape(len(found), -1)
    return np.unpackbits(rows, axis=1, count=len(presence), bitorder="little").astype(bool), number


def search_block(presence: np.ndarray, part: np.ndarray, weights: np.ndarray, ids: list, places: _Places) -> int:
    """Give the item's places to the block's documents; returns how many were scored.

    ``part`` is, per term and document, what a weight is multiplied by.
    """
    masks, number = masks_of(presence)
    most = weights * part.max(axis=1).astype(np.int64)
    bound = masks.astype(np.int64) @ most
    order = np.argsort(-bound, kind="stable")
    by_mask = np.argsort(number, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(masks)))])
    at = scored = 0
    while at < len(order) and bound[order[at]] >= places.least():
        # masks go through a few at a time, until they hold some tens of documents
        here, held = [], 0
        while at < len(order) and held < 32 and bound[order[at]] >= places.least():
            mask = order[at]
            here.append(by_mask[ends[mask] : ends[mask + 1]])
            held += len(here[-1])
            at += 1
        docs = np.concatenate(here)
        scores = weights @ part[:, docs].astype(np.int64)
        scored += len(docs)
        good = np.flatnonzero(scores >= places.least())
        # more than enough for all places, ties included
        if len(good) > 4 * places.k:
            least = np.partition(scores[good], -places.k)[-places.k]
            good = good[scores[good] >= least]
        places.add(scores[good], [ids[d] for d in docs[good].tolist()])
    return scored


def _searched(batches: Iterator[pa.RecordBatch], query, k: int) -> Iterator[pa.RecordBatch]:
    items, weights, documents, length = query.value
    places = [_Places(k) for _ in items]
    step = max(64, CELLS // max(1, len(weights)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            block = batch.slice(start, step)
            size, ends = block.num_rows, block["terms"].offsets.to_numpy()
            terms, times = (block[c].values.to_numpy()[ends[0] : ends[-1]].astype(np.int64) for c in ("terms", "times"))
            home = np.repeat(np.arange(size), np.diff(ends))
            m = 10 + (90 * block["n"].to_numpy() * documents) // length
            value = (1_000_000_000 * times) // (1000 * times + 8 * m[home])
            row = np.full(len(weights), -1)
            held = np.unique(terms)
            row[held] = np.arange(len(held))
            part = np.zeros((len(held), size), np.int32)
            part[row[terms], home] = value
            presence = np.zeros((len(held), size), bool)
            presence[row[terms], home] = True
            ids = block["doc_id"].to_pylist()
            for item, own in enumerate(items):
                own = own[(row[own] >= 0) & (weights[own] > 0)]
                if len(own):
                    search_block(presence[row[own]], part[row[own]], weights[own], ids, places[item])
    rows = [(item, d, s) for item, p in enumerate(places) for s, d in p.rows]
    arrays = list(zip(*rows)) or [(), (), ()]
    types = (pa.int32(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types)], ["item", "doc_id", "score"])


def _item_blocks(items: DataFrame, item_bytes: int) -> Iterator[list[Row]]:
    """The items (columns item_id, text), about ``item_bytes`` of text at a time."""
    items = items.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // item_bytes)
    # the number of a row in the block tells repeated rows apart
    for block in range(blocks):
        dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block
        yield items.where(dealt & F.col("text").isNotNull()).collect()


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    id_type = items.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id bigint, score bigint")
    for found in _item_blocks(items, item_bytes):
        place: dict[bytes, int] = {}
        asked = [
            np.array([place.setdefault(t, len(place)) for t in dict.fromkeys(terms_of(text))], np.int64)
            for _, text in found
        ]
        if not place:
            continue
        vocabulary = spark.sparkContext.broadcast(place)
        listed = saved(docs.mapInArrow(lambda b, v=vocabulary: _listed(b, v), _LISTED))
        size = len(place)
        counts = listed.mapInArrow(lambda b, size=size: _counted(b, size), "term bigint, count bigint")
        counts = counts.groupBy("term").agg(F.sum("count").alias("count")).toPandas()
        count = dict(zip(counts["term"].tolist(), counts["count"].tolist()))
        documents, length = count.get(-1, 0), count.get(-2, 0)
        if not documents:
            continue
        weights = np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * count.get(t, 0) + 1))) for t in range(size)], np.int64
        )
        query = spark.sparkContext.broadcast((asked, weights, documents, length))
        best = listed.mapInArrow(lambda b, q=query: _searched(b, q, k), _BEST)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(
            [(n, item_id) for n, (item_id, _) in enumerate(found)],
            f"item int, item_id {id_type.simpleString()}",
        )
        # as many names as items in the block
        joined = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = out.unionAll(saved(joined))
    return out
