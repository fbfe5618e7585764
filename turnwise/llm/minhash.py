"""Operator 11: near duplicates by many universal hash minima, banded.

A document is the set of its word shingles, as sorted 64-bit hashes; equal sets are one
class.  A set has ``BANDS`` times ``ROWS`` minima of hashes ``a * x + b`` modulo 2^32.
Classes that agree in all rows of a band are candidates.  Two sets of similarity s agree
in a band with probability s^7, so of links at 0.80 one in 10^8 meets in none of the 80
bands, while sets at 0.1 meet once in 10^5 pairs: candidates do not run together.

Classes of equal band keys are linked to the least one where they are found (a task then
keeps that one), so a key that a third of all classes have is a few rows a task.  The
components of these links are candidate parts, cut to tiles of bounded size; only sets with candidates move.  In a tile
signatures are held against each other first: a pair at 0.80 passes but once in 10^10.
What passes is decided by exact intersection of the full sets.  A tile gives back a
spanning forest of its links; components come from alternating large and small stars.

Defined cases: a null text is an empty one; without words a document has no shingles,
links with nothing and is its own component; fewer words than a shingle are one shingle;
repeated rows are documents of one class; a null id never becomes a component's id
unless all its ids are null; ``kept`` compares null ids as equal; an empty table gives
an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import saved
from turnwise.llm.components import components
from turnwise.llm.near_dup import tile_rows

WORDS = 2
#: Similarity in percent.
LINK = 80
BANDS, ROWS = 80, 7
#: Minima that are compared in a tile, and in how many a pair must agree at least.
CHECKED, AGREE = 128, 66
#: Band keys of a bucket, about, and shingles of one side of a tile.
BUCKET, TILE = 4_000_000, 2_000_000
SLOT_BITS = 27

_SEED = np.random.Generator(np.random.PCG64(11))
_A = _SEED.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _SEED.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD = [np.uint64(x | 1) for x in _SEED.integers(1 << 62, 1 << 63, 8, dtype=np.uint64).tolist()]


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


class ShingleSets:
    """Sorted distinct hashes of the word shingles of texts."""

    def __init__(self, words: int = WORDS):
        self.words, self._known = words, {}

    def of(self, text: str | None) -> np.ndarray:
        # on bytes, lower() changes A-Z only and split() knows just the six ASCII spaces
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self._known
        if len(known) > 300_000:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word, 11)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.words, len(words))
        mixed = np.full(len(words) - size + 1, size, np.uint64)
        for i in range(size):
            mixed = _stirred(mixed + hashes[i : len(words) - size + 1 + i] * _ODD[2])
        return np.unique(mixed)


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes(), 11), "<i8").tolist())


def minima(shingles: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """The first ``count`` hash minima of a set, a few hashes at a time to stay in cache."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty(count, np.uint32)
    step = max(1, 65_536 // max(1, len(x)))
    room = np.empty((min(step, count), len(x)), np.uint32)
    for start in range(0, count, step):
        stop = min(start + step, count)
        hashes = room[: stop - start]
        np.multiply(_A[start:stop, None], x, out=hashes)
        hashes += _B[start:stop, None]
        hashes.min(axis=1, out=out[start:stop])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[3]
    for i in range(ROWS):
        key = _stirred(key + rows[:, i] * _ODD[4])
    return key.view(np.int64)


def least_partner(link: int = LINK) -> int:
    """Smaller sets link with no other set: n of n + 1 shingles would not be enough."""
    return -(-link // (100 - link))


class _Seen(set):
    """Classes a task has dealt with; forgetting some only costs repeated work."""

    def new(self, item) -> bool:
        if item in self:
            return False
        if len(self) > 500_000:
            self.clear()
        self.add(item)
        return True


_ROW = "doc_id bigint, text_hash bigint, n bigint, name bigint, name2 bigint, bands array<bigint>"


def _set_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """A row per document; a class brings its band keys once per task."""
    maker, seen, least = ShingleSets(words), _Seen(), least_partner()
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            sizes, names, seconds, bands = [], [], [], []
            for text in part["text"]:
                shingles = maker.of(text.as_py())
                name, second = class_of(shingles) if len(shingles) else (0, 0)
                sizes.append(len(shingles))
                names.append(name)
                seconds.append(second)
                new = len(shingles) >= least and seen.new((name, second))
                bands.append(band_keys(minima(shingles)) if new else np.empty(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype("i4")
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    part["text_hash"],
                    *(pa.array(x, pa.int64()) for x in (sizes, names, seconds)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands))),
                ],
                ["doc_id", "text_hash", "n", "name", "name2", "bands"],
            )


def _chained(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One (key, name) of each key, the least, and links of its other classes to that one."""
    order = np.lexsort((names, keys))
    keys, names = keys[order], names[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
    least = names[first][np.cumsum(first) - 1]
    link = names != least
    pairs = np.unique(np.column_stack([least[link], names[link]]), axis=0)
    return keys[first], names[first], pairs


_PACKED = "bucket int, c0 binary, c1 binary"


def _key_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Band keys packed by bucket, one class per key; links found on the way have bucket -1."""

    def packed(held: list) -> pa.RecordBatch:
        keys, names, pairs = _chained(*(np.concatenate(c) for c in zip(*held)))
        home = keys.view(np.uint64) % np.uint64(buckets)
        order = np.argsort(home, kind="stable")
        found, starts = np.unique(home[order], return_index=True)
        cuts = list(zip(starts, np.append(starts[1:], len(order))))
        columns = [[a[order[s:e]].tobytes() for s, e in cuts] for a in (keys, names)]
        rows = [[*found.tolist(), -1], *([*c, p.tobytes()] for c, p in zip(columns, pairs.T.copy()))]
        types = (pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], ["bucket", "c0", "c1"])

    held, size = [], 0
    for batch in batches:
        bands = batch["bands"]
        ends = bands.offsets.to_numpy()
        held.append((bands.values.to_numpy()[ends[0] : ends[-1]], np.repeat(batch["name"].to_numpy(), np.diff(ends))))
        size += len(held[-1][0])
        if size > BUCKET // 2:
            yield packed(held)
            held, size = [], 0
    if size:
        yield packed(held)


def _bucket_links(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    one, two = (np.concatenate([np.frombuffer(b, np.int64) for b in frame[c]]) for c in ("c0", "c1"))
    pairs = np.column_stack([one, two]) if key[0] < 0 else _chained(one, two)[2]
    return pd.DataFrame(pairs, columns=["u", "v"])


def candidate_parts(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """name, part: classes that share a band key are in one part; without others, none."""
    banded = rows.where(F.size("bands") > 0).select("name", "bands")
    # as many buckets as the keys need, so none grows with the input
    buckets = 1 + BANDS * banded.count() // bucket
    keys = banded.mapInArrow(lambda b: _key_rows(b, buckets), _PACKED)
    # links found on the way are spread by what they are; each row is bounded
    spread = F.when(F.col("bucket") < 0, -1 - F.pmod(F.hash("c0"), F.lit(buckets))).otherwise(F.col("bucket"))
    links = keys.withColumn("home", spread).groupBy("home").applyInPandas(_bucket_links, "u bigint, v bigint")
    return saved(components(links)).withColumnsRenamed({"node": "name", "root": "part"})


def _slots(names: DataFrame) -> np.ndarray:
    """A bit for each candidate's slot: a table of fixed size, filled by one aggregate."""
    slot = F.col("name").bitwiseAND((1 << SLOT_BITS) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(31).cast("int"))
    words = names.select(F.shiftright(slot, 5).cast("int").alias("word"), bit.alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (SLOT_BITS - 5), np.uint32)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return table


def _full_sets(batches: Iterator[pa.RecordBatch], slots, words: int) -> Iterator[pa.RecordBatch]:
    """The set of each class that may have candidates, once per task."""
    maker, seen, table = ShingleSets(words), _Seen(), slots.value
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows = []
            for text in batch["text"].slice(start, 256):
                shingles = maker.of(text.as_py())
                if not len(shingles):
                    continue
                name = class_of(shingles)
                slot = name[0] & ((1 << SLOT_BITS) - 1)
                if int(table[slot >> 5]) >> (slot & 31) & 1 and seen.new(name):
                    rows.append((*name, shingles.tobytes()))
            columns = list(zip(*rows)) or [(), (), ()]
            types = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["name", "name2", "shingles"]
            )


def tile_forest(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with ``side``, of those across sides."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    size = sizes[order]
    sides = None if side is None else side[order]
    signatures = np.stack([minima(sets[i], CHECKED).astype(np.uint8) for i in order.tolist()])
    label = np.arange(len(sets))
    last = np.searchsorted(size, 100 * size // LINK, side="right")
    links = []
    for i in range(len(sets)):
        others = np.arange(i + 1, last[i])
        others = others[label[others] != label[i]]
        if sides is not None:
            others = others[sides[others] != sides[i]]
        own = sets[order[i]]
        for start in range(0, len(others), 4096):
            some = others[start : start + 4096]
            agree = np.count_nonzero(signatures[some] == signatures[i], axis=1)
            for j in some[agree >= AGREE].tolist():
                if label[j] == label[i]:
                    continue
                other = sets[order[j]]
                at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                both = int(np.count_nonzero(other[at] == own))
                if 100 * both >= LINK * (len(own) + len(other) - both):
                    links.append((int(order[i]), int(order[j])))
                    label[label == label[j]] = label[i]
    return links


def _tile(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    # tasks that met copies of one text each bring its set
    frame = frame.drop_duplicates(["class", "side"])
    sets = [np.frombuffer(b, np.uint64) for b in frame["shingles"]]
    found = tile_forest(sets, frame["side"].to_numpy() if key[1] != key[2] else None)
    names = frame["class"].tolist()
    # a tree of links goes on as a star around its least class, which settles sooner
    home: dict[int, list[int]] = {}
    for i, j in found:
        small, large = sorted((home.setdefault(i, [i]), home.setdefault(j, [j])), key=len)
        large.extend(small)
        home.update(dict.fromkeys(small, large))
    stars = []
    for tree in {id(t): t for t in home.values()}.values():
        least, *others = sorted(names[i] for i in tree)
        stars += [(least, other) for other in others]
    return pd.DataFrame(stars, columns=["u", "v"], dtype=object)


def near_copies(docs: DataFrame, words: int = WORDS, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    rows = saved(docs.mapInArrow(lambda b: _set_rows(b, words), _ROW))
    hexed = F.concat(F.lpad(F.hex("name"), 16, "0"), F.lpad(F.hex("name2"), 16, "0"))
    classes = rows.where("n > 0").groupBy("name", "name2").agg(F.max("n").alias("n"), F.min("doc_id").alias("least"))
    classes = saved(classes.withColumn("class", hexed))
    parts = candidate_parts(rows, bucket)
    # narrow rows are placed first; a set then moves to the join and to its tiles
    narrow = classes.select("name", "name2", "n", F.lit(None).cast("binary").alias("shingles"))
    placed = tile_rows(narrow, parts, tile).drop("shingles").select(
        "name",
        "name2",
        "part",
        F.concat_ws("/", "band_a", "tile_a").alias("a"),
        F.concat_ws("/", "band_b", "tile_b").alias("b"),
        "side",
    )
    placed = saved(placed)
    slots = docs.sparkSession.sparkContext.broadcast(_slots(placed.select("name")))
    sets = docs.select("text").mapInArrow(lambda b: _full_sets(b, slots, words), "name bigint, name2 bigint, shingles binary")
    tiles = sets.join(placed, ["name", "name2"]).withColumn("class", hexed).drop("name", "name2")
    links = saved(tiles.groupBy("part", "a", "b").applyInPandas(_tile, "u string, v string"))
    roots = components(links)
    named = classes.join(roots, classes["class"] == roots["node"], "left")
    named = saved(named.select("name", "name2", "least", F.coalesce("root", "class").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("name", "name2", "component_id")
    found = rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "name", "name2")
    linked = found.where("n_shingles > 0").join(named, ["name", "name2"])
    alone = found.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "text_hash", "n_shingles", "component_id"]
    both = linked.select(*columns).unionAll(alone.select(*columns))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
