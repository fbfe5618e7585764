"""Operator 3: near duplicates by an n-gram Jaccard join over size-banded tiles.

A document is the set of its five-word shingles, as sorted 64-bit hashes; equal sets
are one class.  Classes that can link at all are brought together first: of a set of n
shingles, the n - ceil(0.75 n) + 1 rarest ones must hold one that a partner's have too,
whatever the order, as long as it is the same for all.  The order is by document count
for a bounded list of the most common shingles, by hash for the rest.

Classes that share such a shingle form candidate groups.  By chance a group can hold much
that cannot link, so it is first cut with bitmaps alone, a thirty-second of the sets: bit
counts bound every overlap from above, and classes whose bounds allow a link form the
groups that count.  Only their sets are written and move, once, to tiles of bounded size:
the whole group, or pairs of blocks of neighbouring size bands.  In a tile, bitmaps bound
overlaps again, and what passes is decided by exact intersection of the sorted arrays.
Pairs already connected in a tile need no second proof, so a tile gives back a spanning
forest of its links and a group of thousands of copies never becomes all its pairs.  No
link is lost.  Tables in the scratch folder go when the next ones are written.

Defined cases: a null text is an empty one; without words a document has no shingles,
links with nothing and is its own component; fewer than five words are one shingle;
repeated rows are documents of one class; a null id never becomes a component's id
unless all its ids are null; extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import discard, release, saved
from turnwise.llm.components import components

WORDS = 5
#: Similarity in percent.
LINK = 75
#: At most so many shingles are ordered by their count; the list is sent to every task.
MOST_COMMON = 1 << 20
#: Slots of the table that says which classes have candidates; sent to every task.
SLOT_BITS = 27
#: Shingles of one tile's side.
TILE = 2_000_000
#: A tile of bitmaps stands for so many times the shingles; a class counts as this many at least.
BITMAP_TILES, BITMAP_LEAST = 4, 256
#: Bits of a class's bitmap: twice its shingles, a power of two within these (as logarithms).
LEAST_BITS, MOST_BITS = 6, 15
#: Text whose shingles share a bucket, about five million of them.
BUCKET_BYTES = 32 << 20

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self):
        self._words = _WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        # bytes: lower() changes A-Z only, split() knows exactly the six ASCII spaces
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self._words) > 300_000:
            self._words.clear()
        hashes = np.fromiter(map(self._words.__getitem__, words), np.uint64, len(words))
        size = min(WORDS, len(words))
        mixed = np.full(len(words) - size + 1, size, np.uint64)
        for i in range(size):
            mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX[i] + hashes[i : len(words) - size + 1 + i]
        mixed = (mixed ^ (mixed >> np.uint64(33))) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
        mixed.sort()
        return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    return tuple(int(x) for x in np.frombuffer(digest, "<i8"))


def _width(n: int) -> int:
    return 1 << max(LEAST_BITS, min(MOST_BITS, (2 * n - 1).bit_length()))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Shingles as bits of 64-bit words; the wider bitmap of a larger set folds to a narrower one."""
    width = _width(len(shingles))
    bits = np.zeros(width, np.uint8)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def prefix_size(n: int) -> int:
    return n - -(-LINK * n // 100) + 1


class _Seen(set):
    """Classes a task has dealt with; forgetting some only costs repeated work."""

    def new(self, item) -> bool:
        if item in self:
            return False
        if len(self) > 500_000:
            self.clear()
        self.add(item)
        return True


def _packed(columns: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of equal-length arrays, dealt to buckets by the first one's low bits, as bytes."""
    home = (columns[0].astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    columns, home = [c[order] for c in columns], home[order]
    names, starts = np.unique(home, return_index=True)
    ends = np.append(starts[1:], len(home))
    data = [pa.array([c[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for c in columns]
    yield pa.RecordBatch.from_arrays(
        [pa.array(names.astype(np.int32)), *data], ["bucket", *(f"c{i}" for i in range(len(columns)))]
    )


def _count_pass(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    maker, seen, held, size = Shingles(), _Seen(), [], 0
    for batch in batches:
        for text in batch["text"]:
            shingles = maker.of(text.as_py())
            if len(shingles) and seen.new(class_of(shingles)):
                held.append((shingles >> np.uint64(32)).astype(np.uint32))
                size += len(shingles)
                if size > 2_000_000:
                    yield from _packed([np.concatenate(held)], buckets)
                    held, size = [], 0
    if held:
        yield from _packed([np.concatenate(held)], buckets)


def _common_of_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    parts = np.sort(np.concatenate([np.frombuffer(b, np.uint32) for b in frame["c0"]]))
    start = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
    count = np.diff(np.append(start, len(parts)))
    return pd.DataFrame({"token": parts[start][count > 1].astype(np.int64), "n": count[count > 1].astype(np.int64)})


def common_shingles(docs: DataFrame, buckets: int, most: int = MOST_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles (upper 32 bits, sorted) and their level, log2 of the count.

    All documents are counted; the list takes whole levels from the top while at most
    ``most`` shingles are in them.
    """
    dealt = docs.select("text").mapInArrow(lambda b: _count_pass(b, buckets), "bucket int, c0 binary")
    # buckets hold many shingles each, so none is larger than the others
    counts = dealt.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(
        _common_of_bucket, "token bigint, n bigint"
    )
    counts = saved(counts.withColumn("level", F.floor(F.log2("n")).cast("int")))
    levels = {r["level"]: r["count"] for r in counts.groupBy("level").count().collect()}
    least, total = 64, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > most:
            break
        least = level
    chosen = counts.where(F.col("level") >= least).select("token", "level").toArrow()
    discard(counts)
    tokens = chosen["token"].to_numpy().astype(np.uint32)
    order = np.argsort(tokens)
    return tokens[order], chosen["level"].to_numpy()[order].astype(np.int16)


class _Order:
    """Levels of shingles: 0 for those not on the list."""

    def __init__(self, tokens: np.ndarray, levels: np.ndarray):
        self.tokens, self.levels = tokens, levels
        self.may = np.zeros(1 << 24, bool)
        self.may[tokens >> np.uint32(8)] = True

    def level(self, shingles: np.ndarray) -> np.ndarray:
        out = np.zeros(len(shingles), np.int16)
        upper = (shingles >> np.uint64(32)).astype(np.uint32)
        where = np.flatnonzero(self.may[upper >> np.uint32(8)])
        if len(where):
            at = np.minimum(np.searchsorted(self.tokens, upper[where]), len(self.tokens) - 1)
            hit = self.tokens[at] == upper[where]
            out[where[hit]] = self.levels[at[hit]]
        return out


def _prefix_pass(batches: Iterator[pa.RecordBatch], buckets: int, common) -> Iterator[pa.RecordBatch]:
    """Postings of rare prefix shingles, edges to common ones (bucket -1: class, shingle) and
    bitmaps of classes (bucket -2: both names, size, words)."""
    maker, seen, order = Shingles(), _Seen(), _Order(*common.value)
    rare: list[tuple] = []
    hot: list[tuple] = []
    named: list[tuple] = []
    kinds = ["bucket", "c0", "c1", "c2", "c3"]

    def row(bucket: int, *columns: np.ndarray) -> pa.RecordBatch:
        data = [c.tobytes() for c in columns] + [b""] * (4 - len(columns))
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([d], pa.binary()) for d in data)], kinds)

    def flush():
        if rare:
            tokens, names, sizes = (np.concatenate(c) for c in zip(*rare))
            for batch in _packed([tokens, names, sizes], buckets):
                empty = pa.array([b""] * batch.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, empty], kinds)
        if hot:
            names, tokens = (np.concatenate(c) for c in zip(*hot))
            yield row(-1, tokens, names)
        if named:
            both, sizes, bits = zip(*named)
            yield row(-2, np.array(both, np.int64), np.array(sizes, np.int32), np.concatenate(bits))
        rare.clear()
        hot.clear()
        named.clear()

    size = 0
    for batch in batches:
        for text in batch["text"]:
            shingles = maker.of(text.as_py())
            n = len(shingles)
            if not n:
                continue
            name = class_of(shingles)
            if not seen.new(name):
                continue
            named.append((name, n, bitmap(shingles)))
            level = order.level(shingles)
            first = np.argsort(level, kind="stable")[: prefix_size(n)]
            low = first[level[first] == 0]
            rare.append((shingles[low], np.full(len(low), name[0], np.int64), np.full(len(low), n, np.int32)))
            high = first[len(low) :]
            if len(high):
                hot.append((np.full(len(high), name[0], np.int64), shingles[high]))
            size += len(first)
            if size > 1_000_000:
                yield from flush()
                size = 0
    yield from flush()


def _chains_of_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    """Neighbours in size among the classes of each shingle; far sizes cannot link."""
    tokens = np.concatenate([np.frombuffer(b, np.uint64) for b in frame["c0"]])
    names = np.concatenate([np.frombuffer(b, np.int64) for b in frame["c1"]])
    sizes = np.concatenate([np.frombuffer(b, np.int32) for b in frame["c2"]])
    # most shingles are in one document only; sort the others
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    same = tokens[1:] == tokens[:-1]
    part = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.arange(len(order))
    t, c, s = tokens[inverse[part]], names[part], sizes[part]
    by = np.lexsort((c, s, t))
    t, c, s = t[by], c[by], s[by].astype(np.int64)
    link = (t[1:] == t[:-1]) & (c[1:] != c[:-1]) & (100 * s[:-1] >= LINK * s[1:])
    pairs = np.unique(np.column_stack([c[:-1][link], c[1:][link]]), axis=0)
    return pd.DataFrame(pairs, columns=["u", "v"])


_EDGES = "u bigint, v bigint, hot boolean, name2 bigint, n int, bits binary"


def _bitmaps(frame: pd.DataFrame) -> pd.DataFrame:
    """The packed bitmaps of classes as rows of their own."""
    out = []
    for names, sizes, words in zip(frame["c0"], frame["c1"], frame["c2"]):
        names, sizes = np.frombuffer(names, np.int64).reshape(-1, 2), np.frombuffer(sizes, np.int32)
        widths = [_width(n) for n in sizes.tolist()]
        ends = np.cumsum(widths) // 8
        bits = [words[e - w // 8 : e] for e, w in zip(ends.tolist(), widths)]
        out.append(pd.DataFrame({"u": names[:, 0], "name2": names[:, 1], "n": sizes, "bits": bits}))
    out = pd.concat(out)
    out["v"], out["hot"] = 0, False
    return out


def candidate_groups(docs: DataFrame, buckets: int, tile: int = TILE) -> DataFrame:
    """name (64 bits of a class), part: classes that may link are in one part.

    Sharing a shingle of the prefix brings classes together, bitmaps take them apart again.
    """
    sc = docs.sparkSession.sparkContext
    common = sc.broadcast(common_shingles(docs, buckets))
    postings = docs.select("text").mapInArrow(
        lambda b: _prefix_pass(b, buckets, common), "bucket int, c0 binary, c1 binary, c2 binary, c3 binary"
    )
    # common shingles are nodes of their own, so no one gathers their classes
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("c1"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    postings = postings.withColumn("home", spread).repartition(buckets, "home")

    def pairs(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows := frame[frame["bucket"] >= 0]):
            found.append(_chains_of_bucket(rows).assign(hot=False))
        if len(hot := frame[frame["bucket"] == -1]):
            u = np.concatenate([np.frombuffer(b, np.int64) for b in hot["c1"]])
            v = np.concatenate([np.frombuffer(b, np.uint64) for b in hot["c0"]]).view(np.int64)
            found.append(pd.DataFrame({"u": u, "v": v, "hot": True}))
        found = [f.assign(name2=0, n=0, bits=None) for f in found]
        if len(named := frame[frame["bucket"] == -2]):
            found.append(_bitmaps(named))
        return pd.concat(found)[["u", "v", "hot", "name2", "n", "bits"]]

    both = saved(postings.groupBy("home").applyInPandas(pairs, _EDGES))
    edges = both.where("bits is null").select("u", "v", "hot")
    roots = components(edges)
    classes = edges.select(F.col("u").alias("name")).unionAll(edges.where("not hot").select(F.col("v").alias("name")))
    placed = saved(classes.distinct().join(roots, F.col("name") == F.col("node")).select("name", F.col("root").alias("part")))
    several = saved(placed.groupBy("part").count().where("count > 1").select("part"))
    groups = saved(placed.join(several, "part"))
    discard(roots, placed, several)
    named = both.where("bits is not null")
    named = named.select(F.col("u").alias("name"), "name2", F.col("n").cast("bigint").alias("n"), F.col("bits").alias("shingles"))
    places = tile_places(named, groups, BITMAP_TILES * tile, BITMAP_LEAST)
    may = saved(_tiled(named, places, buckets, lambda frame: _tile_bitmaps(frame), "u bigint, v bigint"))
    discard(both, groups, places)
    roots = components(may)
    discard(may)
    groups = saved(roots.select(F.col("node").alias("name"), F.col("root").alias("part")))
    discard(roots)
    return groups


def _slots(candidates: DataFrame) -> np.ndarray:
    """A bit for each candidate's slot: a table of fixed size, filled by one aggregate."""
    slot = F.col("name").bitwiseAND((1 << SLOT_BITS) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(31).cast("int"))
    words = candidates.select(F.shiftright(slot, 5).cast("int").alias("word"), bit.alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (SLOT_BITS - 5), np.uint32)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return table


_DOC = "doc_id bigint, text_hash bigint, n bigint, name bigint, name2 bigint, shingles binary"


def _set_pass(batches: Iterator[pa.RecordBatch], slots) -> Iterator[pa.RecordBatch]:
    """A narrow row per document; a class with candidates brings its set once per task."""
    maker, seen, table = Shingles(), _Seen(), slots.value
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sizes, names, seconds, sets = [], [], [], []
            for text in part["text"]:
                shingles = maker.of(text.as_py())
                name, second = class_of(shingles) if len(shingles) else (0, 0)
                slot = name & ((1 << SLOT_BITS) - 1)
                may = len(shingles) and int(table[slot >> 5]) >> (slot & 31) & 1
                sizes.append(len(shingles))
                names.append(name)
                seconds.append(second)
                sets.append(shingles.tobytes() if may and seen.new((name, second)) else None)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["text_hash"], *(pa.array(x, pa.int64()) for x in (sizes, names, seconds)), pa.array(sets, pa.binary())],
                ["doc_id", "text_hash", "n", "name", "name2", "shingles"],
            )


def _forest(size: np.ndarray, rows: list[np.ndarray], sides: np.ndarray | None, proves) -> list[tuple[int, int]]:
    """A spanning forest of the links among classes in the order of their sizes.

    ``rows`` are their bitmaps.  Every bit one of two has alone stands for a shingle at
    least that the other lacks, which bounds an overlap from above; ``proves`` (i, j,
    needed) decides what passes, if it is there.
    """
    label = np.arange(len(size))
    last = np.searchsorted(size, 100 * size // LINK, side="right")
    widths = np.array([len(r) for r in rows])
    folded, width, begin = None, 0, 0
    links = []
    for i in range(len(size)):
        if last[i] <= i + 1:
            continue
        if widths[i] != width:
            # those a set can link with are as wide or, as widths grow with sizes, wider
            width, begin = int(widths[i]), i
            end = int(last[np.searchsorted(widths, width, side="right") - 1])
            folded = np.stack([np.bitwise_or.reduce(r.reshape(-1, width), axis=0) for r in rows[begin:end]])
        others = np.arange(i + 1, last[i])
        others = others[label[others] != label[i]]
        if sides is not None:
            others = others[sides[others] != sides[i]]
        if not len(others):
            continue
        needed = -(-LINK * (size[i] + size[others]) // (100 + LINK))
        own, theirs = folded[i - begin], folded[others - begin]
        alone = np.bitwise_count(own & ~theirs).sum(axis=1, dtype=np.int64)
        alone2 = np.bitwise_count(~own & theirs).sum(axis=1, dtype=np.int64)
        most = np.minimum(size[i] - alone, size[others] - alone2)
        for j, need in zip(others[most >= needed].tolist(), needed[most >= needed].tolist()):
            if label[j] != label[i] and (proves is None or proves(i, j, need)):
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def tile_links(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with ``side``, of those across sides."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")

    def proves(i: int, j: int, need: int) -> bool:
        own, other = sets[order[i]], sets[order[j]]
        at = np.minimum(np.searchsorted(other, own), len(other) - 1)
        return int((other[at] == own).sum()) >= need

    links = _forest(sizes[order], [bitmap(sets[i]) for i in order], None if side is None else side[order], proves)
    return [(int(order[i]), int(order[j])) for i, j in links]


def _groups(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray | None]]:
    """Each group of a tile or of several small tiles, and the sides where it has two."""
    for (_, a, b), group in frame.groupby(["part", "a", "b"], sort=False):
        if len(group) > 1:
            yield group, group["side"].to_numpy() if a != b else None


def _tile(frame: pd.DataFrame) -> pd.DataFrame:
    links = []
    for group, side in _groups(frame):
        names = group["class"].tolist()
        sets = [np.frombuffer(b, np.uint64) for b in group["shingles"]]
        links += [(names[i], names[j]) for i, j in tile_links(sets, side)]
    return pd.DataFrame(links, columns=["u", "v"], dtype=object)


def _tile_bitmaps(frame: pd.DataFrame) -> pd.DataFrame:
    """Pairs of classes whose bitmaps allow a link, as a spanning forest."""
    links = []
    for group, side in _groups(frame):
        group = group.sort_values("n", kind="stable")
        names = group["name"].tolist()
        rows = [np.frombuffer(b, np.uint64) for b in group["shingles"]]
        sides = None if side is None else group["side"].to_numpy()
        links += [(names[i], names[j]) for i, j in _forest(group["n"].to_numpy(), rows, sides, None)]
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def _tiled(sets: DataFrame, places: DataFrame, buckets: int, links, schema: str) -> DataFrame:
    """``links`` of every tile's rows; tiles of whole groups are dealt to ``buckets``, many to one call."""
    rows = _moved(sets, places).select(
        "*",
        F.concat_ws("/", "band_a", "tile_a").alias("a"),
        F.concat_ws("/", "band_b", "tile_b").alias("b"),
        F.concat(F.lpad(F.hex("name"), 16, "0"), F.lpad(F.hex("name2"), 16, "0")).alias("class"),
        F.when(F.col("band_a") < 0, F.pmod(F.xxhash64("part"), F.lit(buckets))).otherwise(F.col("part")).alias("home"),
    ).select("home", "part", "a", "b", "side", "name", "n", "class", "shingles")
    return rows.groupBy("home", "a", "b").applyInPandas(links, schema)


def tile_places(sets: DataFrame, groups: DataFrame, tile: int = TILE, least: int = 0) -> DataFrame:
    """The tiles of each class, a row each: part, band_a, band_b, tile_a, tile_b, side.

    A group of up to ``tile`` shingles is one tile.  A larger one is cut into size bands
    of ratio 1.34 (only neighbouring ones can link) and each band into blocks by hash.
    """
    # where a set goes is decided on narrow rows; a class that several tasks brought counts once
    weight = F.greatest("n", F.lit(least))
    narrow = sets.select("name", "name2", "n").distinct().join(groups, "name")
    rows = saved(narrow.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(1.34)).cast("int")))
    total = saved(rows.groupBy("part").agg(F.sum(weight).alias("total")))
    bands = rows.groupBy("part", "band").agg(F.sum(weight).alias("w")).join(total, "part").where(F.col("total") > tile)
    blocks = F.ceil(F.col("w") / tile).cast("int").alias("blocks")
    bands = saved(bands.select("part", "band", blocks))
    small = rows.join(total.where(F.col("total") <= tile).select("part"), "part").select(
        "part", F.lit(-1).alias("band_a"), F.lit(-1).alias("band_b"), F.lit(0).alias("tile_a"), F.lit(0).alias("tile_b"), F.lit(0).alias("side"), "name", "name2"
    )
    big = rows.join(bands, ["part", "band"]).withColumn("block", F.pmod("name2", F.col("blocks")).cast("int"))
    beside = bands.select("part", F.col("band").alias("band_b"), F.col("blocks").alias("blocks_b"))
    # a block meets every block of its own band and of the two next to it
    near = F.array(*(F.col("band") + i for i in (-1, 0, 1)))
    big = big.withColumn("band_b", F.explode(near)).join(beside, ["part", "band_b"])
    big = big.withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
    own, other = F.struct("band", F.col("block").alias("block")), F.struct(F.col("band_b").alias("band"), F.col("block_b").alias("block"))
    first, second = F.least(own, other), F.greatest(own, other)
    big = big.select(
        "part",
        first["band"].alias("band_a"),
        second["band"].alias("band_b"),
        first["block"].alias("tile_a"),
        second["block"].alias("tile_b"),
        F.when(own == first, 0).otherwise(1).alias("side"),
        "name",
        "name2",
    )
    places = saved(small.unionAll(big))
    discard(rows, total, bands)
    return places


def _moved(sets: DataFrame, places: DataFrame) -> DataFrame:
    # the sets themselves move once to their class and once to its tiles
    return sets.dropDuplicates(["name", "name2"]).join(places, ["name", "name2"])


def tile_rows(sets: DataFrame, groups: DataFrame, tile: int = TILE) -> DataFrame:
    """Each class's set, once per tile it belongs to (see ``tile_places``)."""
    return _moved(sets.select("name", "name2", "shingles"), tile_places(sets, groups, tile))


def near_duplicates(docs: DataFrame, buckets: int | None = None, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id."""
    spark = docs.sparkSession
    release(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    # as many buckets as the text needs, so none grows with the input
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    buckets = buckets or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    groups = candidate_groups(docs, buckets, tile)
    slots = spark.sparkContext.broadcast(_slots(groups))
    rows = saved(docs.mapInArrow(lambda b: _set_pass(b, slots), _DOC))
    sets = rows.where("shingles is not null").select("name", "name2", "n", "shingles")
    places = tile_places(sets, groups, tile)
    links = saved(_tiled(sets, places, buckets, lambda frame: _tile(frame), "u string, v string"))
    narrow = saved(rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "name", "name2"))
    discard(rows, places, groups)
    roots = components(links)
    hexed = F.concat(F.lpad(F.hex("name"), 16, "0"), F.lpad(F.hex("name2"), 16, "0"))
    classes = narrow.where("n_shingles > 0").groupBy("name", "name2").agg(F.min("doc_id").alias("least"))
    classes = saved(classes.withColumn("class", hexed))
    rooted = saved(
        classes.join(roots, classes["class"] == roots["node"], "left").withColumn("root", F.coalesce("root", "class"))
    )
    ids = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = saved(rooted.join(ids, "root").select("name", "name2", "component_id"))
    discard(links, roots, classes, rooted, ids)
    classes = linked
    linked = narrow.where("n_shingles > 0").join(classes, ["name", "name2"])
    alone = narrow.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "text_hash", "n_shingles", "component_id"]
    return linked.select(*columns).unionAll(alone.select(*columns))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id; all without words."""
    found = saved(near_duplicates(docs, **options))
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("text_hash"))
    linked = found.where("n_shingles > 0")
    # a component without any id is told by its text
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("-/"), F.col("text_hash").cast("string")))
    kept = saved(
        linked.groupBy(group.alias("group"))
        .agg(F.min_by(F.struct("doc_id", "text_hash"), order).alias("keep"))
        .select("keep.*")
    )
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("bigint").alias("own_id"),
        F.xxhash64("text").alias("own_hash"),
    )
    counts = found.where("n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1").drop("count")
    repeated = saved(counts)
    same = ["doc_id", "text_hash"]
    both = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    single = saved(kept.join(repeated, both(kept, repeated), "left_anti"))
    several = saved(kept.join(repeated, both(kept, repeated), "left_semi"))
    discard(found, kept, repeated)

    def joined(some: DataFrame) -> DataFrame:
        some = some.withColumnsRenamed({c: f"keep_{c}" for c in same})
        return rows.join(
            some,
            F.col("own_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("own_hash") == F.col("keep_text_hash")),
            "left_semi",
        )

    wordless = rows.where(~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    # of equal rows one stays
    once = joined(several).dropDuplicates(["own_id", "own_hash"])
    return joined(single).unionAll(once).unionAll(wordless).select("row.*")
