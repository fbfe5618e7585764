"""Operator 13: alignment of two tokenizers over the same bytes, and counts of the links.

A text is read by a byte-level tokenizer (A) and a piece tokenizer (B).  Where a token
of both ends there is a shared cut; cuts part the tokens into groups.  They are found by
divide and conquer: a common end near the middle of an interval, by bisection of the
other side's ends, then both halves; an interval without one is a leaf, a group.

At a space behind a letter, digit or mark both tokenizers end a token whatever stands
around it, so a text is first cut there, and a worker aligns equal segments once.

Every A and B token of a group are linked.  In how many documents an id pair is linked
is one count over all documents.  The most common pairs, at most ``most_listed``, go to
all tasks as sorted arrays; occurrences of all other pairs meet their count in a join.

Defined cases: null and empty texts, and texts whose tokens do not give back their bytes
with a space in front, have no tokens, zeros and an empty digest; repeated rows and null
ids are documents of their own; a text without any cut is one group; an empty table
gives an empty result; other columns are not looked at unless named in ``keep``.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from turnwise.llm.common import saved

#: Pairs whose counts are sent to every task, 17 bytes each.
MOST_LISTED = 1 << 20
#: Texts aligned, and rows returned, at once.
ROWS = 128
_SEGMENT = re.compile(r"(?s).+?[\w.,;:!?](?= )|.+")
_ENDS = re.compile(r"[\w.,;:!?]")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def split_at_shared(
    ends_a: np.ndarray, ends_b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Groups (first a, behind last a, first b, behind last b) of many intervals, in order.

    All intervals go side by side.  A round looks for an end of A near the middle of each,
    by bisection in the ends of B; an interval that has one is halved there and both
    halves go on, one without is a group.
    """
    leaves = []
    while len(a0):
        middle, width = (a0 + a1 - 1) // 2, a1 - a0
        cut_a, cut_b = np.full(len(a0), -1), np.full(len(a0), -1)

        def found(which: np.ndarray, i: np.ndarray) -> np.ndarray:
            """Bisect for the ends ``i``; notes those that B shares inside the interval."""
            inside = (i >= a0[which]) & (i < a1[which] - 1)
            j = np.searchsorted(ends_b, ends_a[np.where(inside, i, 0)])
            j = np.minimum(j, len(ends_b) - 1)
            hit = inside & (j < b1[which] - 1) & (ends_b[j] == ends_a[np.where(inside, i, 0)])
            cut_a[which[hit]], cut_b[which[hit]] = i[hit], j[hit]
            return hit

        open_, step = np.flatnonzero((width > 1) & (b1 - b0 > 1)), 0
        while len(open_) and step < 32:
            # the middle, then one to the right, one to the left, and so on outwards
            hit = found(open_, middle[open_] + (step + 1) // 2 * (1 if step % 2 else -1))
            step += 1
            open_ = open_[~hit & (step <= width[open_])]
        for n in open_.tolist():
            # far from the middle: all ends of a long interval at once, the nearest first
            i = np.arange(a0[n], a1[n] - 1)
            i = i[np.argsort(np.abs(i - middle[n]), kind="stable")]
            j = np.minimum(np.searchsorted(ends_b, ends_a[i]), len(ends_b) - 1)
            shared = np.flatnonzero((ends_b[j] == ends_a[i]) & (j < b1[n] - 1))
            if len(shared):
                cut_a[n], cut_b[n] = i[shared[0]], j[shared[0]]
        leaf = cut_a < 0
        leaves.append([x[leaf] for x in (a0, a1, b0, b1)])
        a0, a1, b0, b1, cut_a, cut_b = (x[~leaf] for x in (a0, a1, b0, b1, cut_a, cut_b))
        a0, a1 = np.concatenate([a0, cut_a + 1]), np.concatenate([cut_a + 1, a1])
        b0, b1 = np.concatenate([b0, cut_b + 1]), np.concatenate([cut_b + 1, b1])
    groups = [np.concatenate(x) for x in zip(*leaves)] if leaves else [a0, a1, b0, b1]
    order = np.argsort(groups[0], kind="stable")
    return tuple(x[order] for x in groups)


def shared_groups(ends_a: Sequence[int], ends_b: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """The groups of one text from the byte ends of its tokens."""
    one, two = np.asarray(ends_a, np.int64), np.asarray(ends_b, np.int64)
    whole = (np.array([x]) for x in (0, len(one), 0, len(two)))
    return list(zip(*(x.tolist() for x in split_at_shared(one, two, *whole))))


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Aligner:
    """Two tokenizers and the segments a worker has aligned, at most ``remembered`` letters."""

    def __init__(self, path_a: str, path_b: str, remembered: int = 20_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in names]
        self.b = lib = sentencepiece.SentencePieceProcessor(model_file=path_b)
        ids = range(lib.get_piece_size())
        self.bytes_b = [
            bytes([int(lib.id_to_piece(i)[3:5], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace("▁", " ").encode()
            for i in ids
        ]
        self.wide_a, self.wide_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        inner = [p for p in map(lib.id_to_piece, ids) if "▁" in p.lstrip("▁") or "\n" in p and len(p) > 1]
        if inner:
            raise ValueError("a piece reaches across a word or line border")
        # behind a line end, which no longer piece contains, a segment stands as in its text
        self.head = len(lib.encode("\n"))
        self.remembered, self.held = remembered, 0
        self.place: dict[str, int] = {}
        self.written: list[str] = []
        #: of each segment: the counts, where its linked pairs start and end in ``pairs``,
        #: and in how many places it was met
        self.counts = np.zeros((1024, 7), np.int64)
        self.pairs, self.times = np.zeros(4096, np.int64), np.ones(4096, np.int64)
        self.filled = 0
        self.broken: set[int] = set()

    def _forget(self) -> None:
        """Keep the half of the segments that was met most often, none that was met once."""
        met = self.counts[: len(self.written), 6]
        kept = np.argsort(-met, kind="stable")[: len(met) // 2]
        kept = np.sort(kept[met[kept] > 1])
        names = list(self.place)
        names = [names[i] for i in kept.tolist()]
        self.broken = {new for new, old in enumerate(kept.tolist()) if old in self.broken}
        self.place = dict(zip(names, range(len(names))))
        self.written = [self.written[i] for i in kept.tolist()]
        counts = self.counts[kept]
        many = counts[:, 5] - counts[:, 4]
        index = np.arange(many.sum()) + np.repeat(counts[:, 4] - np.cumsum(many) + many, many)
        self.pairs, self.times, self.filled = self.pairs[index], self.times[index], len(index)
        counts[:, 4], counts[:, 5], counts[:, 6] = np.cumsum(many) - many, np.cumsum(many), 0
        self.counts = counts
        self.held = sum(map(len, names)) + 40 * len(names)

    def _ids_a(self, segments: list[str]) -> list[list[int]]:
        """Ids by A, many segments in one call.

        A segment that ends as ``_SEGMENT`` asks is cut there whatever follows, and all
        begin with a space, so the ids of some in a row are those of each.
        """
        out: list[list[int]] = [[]] * len(segments)
        ends_well = [n for n, s in enumerate(segments) if _ENDS.match(s[-1])]
        runs = [ends_well[i : i + 64] for i in range(0, len(ends_well), 64)]
        runs += [[n] for n, s in enumerate(segments) if not _ENDS.match(s[-1])]
        found = self.a.encode_batch_fast(["".join([segments[n] for n in run]) for run in runs], add_special_tokens=False)
        for run, encoding in zip(runs, found):
            ids = encoding.ids
            ends = np.cumsum(self.wide_a[np.array(ids, np.int64)])
            borders = np.cumsum([len(segments[n].encode()) for n in run])
            behind = np.searchsorted(ends, borders, side="right").tolist()
            for n, i, j in zip(run, [0, *behind], behind):
                out[n] = ids[i:j]
        return out

    def _broken(self, segments: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[int]:
        """Segments whose tokens do not give back their bytes."""
        return [
            n
            for n, (segment, a, b) in enumerate(zip(segments, ids_a, ids_b))
            if not segment.encode() == b"".join([self.bytes_a[i] for i in a]) == b"".join([self.bytes_b[i] for i in b])
        ]

    def _learn(self, segments: list[str]) -> None:
        """Encode and align new segments, side by side."""
        ids_a = self._ids_a(segments)
        ids_b = [ids[self.head :] for ids in self.b.encode(["\n" + s for s in segments], num_threads=1)]
        first = len(self.written)
        self.place.update(zip(segments, range(first, first + len(segments))))
        self.held += sum(map(len, segments)) + 40 * len(segments)
        flat_a, flat_b = (list(chain.from_iterable(ids)) for ids in (ids_a, ids_b))
        na, nb, a, b = (np.array(x, np.int64) for x in (list(map(len, ids_a)), list(map(len, ids_b)), flat_a, flat_b))
        ends_a, ends_b = np.cumsum(self.wide_a[a]), np.cumsum(self.wide_b[b])
        behind_a, behind_b = np.cumsum(na), np.cumsum(nb)
        # all at once: the bytes as a whole, and that every segment ends where it should
        data = "".join(segments).encode()
        whole = all(b"".join([t[i] for i in x]) == data for t, x in ((self.bytes_a, flat_a), (self.bytes_b, flat_b)))
        if not whole or not np.array_equal(ends_a[behind_a - 1], ends_b[behind_b - 1]) or (na * nb == 0).any():
            broken = set(self._broken(segments, ids_a, ids_b))
            self.broken.update(first + n for n in broken)
            ids_a, ids_b = ([[] if n in broken else x for n, x in enumerate(ids)] for ids in (ids_a, ids_b))
            flat_a, flat_b = (list(chain.from_iterable(ids)) for ids in (ids_a, ids_b))
            na, nb, a, b = (np.array(x, np.int64) for x in (list(map(len, ids_a)), list(map(len, ids_b)), flat_a, flat_b))
            ends_a, ends_b = np.cumsum(self.wide_a[a]), np.cumsum(self.wide_b[b])
            behind_a, behind_b = np.cumsum(na), np.cumsum(nb)
        some = na > 0
        borders = (x[some] for x in (behind_a - na, behind_a, behind_b - nb, behind_b))
        a0, a1, b0, b1 = split_at_shared(ends_a, ends_b, *borders)
        la, lb = a1 - a0, b1 - b0
        home = np.searchsorted(behind_a, a0, side="right")
        groups = np.bincount(home, minlength=len(segments))
        links = np.zeros(len(segments), np.int64)
        np.add.at(links, home, la * lb)
        # every linked occurrence is a pair, but in a large group a pair of ids stands once
        size = np.where(la * lb <= 256, la * lb, 0)
        which = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        codes = a[a0[which] + at // lb[which]] << 32 | b[b0[which] + at % lb[which]]
        many = np.zeros(len(segments), np.int64)
        np.add.at(many, home, size)
        behind = np.cumsum(many)
        starts, stops, times = behind - many, behind, np.ones(len(codes), np.int64)
        for n in np.unique(home[size == 0]).tolist():
            # such a segment's pairs go behind all others
            own, often = [codes[starts[n] : stops[n]]], [np.ones(many[n], np.int64)]
            for g in np.flatnonzero((home == n) & (size == 0)).tolist():
                sides = (np.unique(x, return_counts=True) for x in (a[a0[g] : a1[g]], b[b0[g] : b1[g]]))
                (x, nx), (y, ny) = sides
                own.append((x[:, None] << 32 | y).ravel())
                often.append((nx[:, None] * ny).ravel())
            starts[n] = len(codes)
            codes, times = np.concatenate([codes, *own]), np.concatenate([times, *often])
            stops[n] = len(codes)
        text_a, text_b = ([self.names[i] for i in x] for x in (flat_a, flat_b))
        shown = [
            f"{text_a[i]}|{text_b[k]}" if j - i == 1 and m - k == 1 else ",".join(text_a[i:j]) + "|" + ",".join(text_b[k:m])
            for i, j, k, m in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist())
        ]
        last = np.cumsum(groups)
        self.written += [";".join(shown[i:j]) for i, j in zip((last - groups).tolist(), last.tolist())]
        end = len(self.written)
        self.counts = _room(self.counts, end)
        self.counts[first:end, :6] = np.column_stack([na, nb, groups, links, starts + self.filled, stops + self.filled])
        end = self.filled + len(codes)
        self.pairs, self.times = _room(self.pairs, end), _room(self.times, end)
        self.pairs[self.filled : end], self.times[self.filled : end] = codes, times
        self.filled = end

    def align(self, texts: Sequence[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts and groups of each text; then text number, pair and times of all linked pairs.

        A pair is ``a << 32 | b``; each stands once for each text that holds it, in order.
        """
        if self.held > self.remembered:
            self._forget()
        parts = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
        new = list(dict.fromkeys([s for p in parts for s in p if s not in self.place]))
        if new:
            self._learn(new)
        get = self.place.__getitem__
        places = [list(map(get, p)) for p in parts]
        if self.broken:
            places = [[] if self.broken.intersection(p) else p for p in places]
        written = self.written
        texts_of = [";".join([written[i] for i in p]) for p in places]
        sizes = np.array([len(p) for p in places])
        at = np.fromiter(chain.from_iterable(places), np.int64, int(sizes.sum()))
        self.counts[: len(written), 6] += np.bincount(at, minlength=len(written))
        home, behind = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)
        sums = np.zeros((len(at) + 1, 4), np.int64)
        np.cumsum(self.counts[at, :4], axis=0, out=sums[1:])
        counts = sums[behind] - sums[behind - sizes]
        starts, ends = self.counts[at, 4], self.counts[at, 5]
        many = ends - starts
        index = np.arange(many.sum()) + np.repeat(starts - np.cumsum(many) + many, many)
        pairs, times, home = self.pairs[index], self.times[index], np.repeat(home, many)
        # text and pair in one number: a pair takes as many values as the vocabularies allow
        wide = len(self.bytes_b)
        key = (home * len(self.bytes_a) + (pairs >> 32)) * wide + (pairs & 0xFFFFFFFF)
        if (times == 1).all():
            key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
            times = np.diff(np.append(first, len(key)))
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times = np.add.reduceat(times[order], first)
        key = key[first]
        rest, b = np.divmod(key, wide)
        home, a = np.divmod(rest, len(self.bytes_a))
        return counts, texts_of, home, a << 32 | b, times


def _room(rows: np.ndarray, size: int) -> np.ndarray:
    """``rows`` with place for ``size``, doubled as often as needed."""
    while len(rows) < size:
        rows = np.concatenate([rows, np.zeros((max(1024, len(rows)), *rows.shape[1:]), np.int64)])
    return rows


@functools.lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker, so that tasks share the tokenizers and what they learnt."""
    return Aligner(path_a, path_b)


def _aligned(
    batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, kept: list[str], keep_groups: bool
) -> Iterator[pa.RecordBatch]:
    aligner = _aligner(path_a, path_b)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            counts, groups, home, pairs, times = aligner.align(part["text"].to_pylist())
            columns = {c: part[c] for c in kept}
            for k, name in enumerate(_COUNTS):
                columns[name] = pa.array(counts[:, k])
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            columns["groups_sha256"] = pa.array(digests, pa.string())
            ends = pa.array(np.searchsorted(home, np.arange(part.num_rows + 1)).astype("i4"))
            columns["pairs"] = pa.ListArray.from_arrays(ends, pa.array(pairs))
            columns["times"] = pa.ListArray.from_arrays(ends, pa.array(times))
            if keep_groups:
                columns["groups"] = pa.array(groups, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def align_texts(
    docs: DataFrame, path_a: str, path_b: str, keep: Sequence[str] = ("doc_id",), keep_groups: bool = True
) -> DataFrame:
    """``keep`` columns, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times and groups.

    ``pairs`` are the document's distinct linked id pairs as ``a << 32 | b``, ``times``
    how often each is linked.  No shuffle.
    """
    kept = [c for c in keep if c not in (*_COUNTS, "groups_sha256", "pairs", "times", "groups")]
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, "text"])))
    schema = StructType([rows.schema[c] for c in kept])
    for name in _COUNTS:
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string").add("pairs", ArrayType(LongType())).add("times", ArrayType(LongType()))
    if keep_groups:
        schema = schema.add("groups", "string")
    return rows.mapInArrow(lambda batches: _aligned(batches, path_a, path_b, kept, keep_groups), schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (no other pair of its A id has more)."""
    counts = saved(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a_id = F.shiftright("pair", 32)
    # one row an id of vocabulary A
    highest = counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("highest"))
    joined = counts.withColumn("a_id", a_id).join(highest, "a_id")
    return joined.select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _listed(counts: DataFrame, most: int) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The least level (log2 of the count) of the list, and the list: whole levels from the top."""
    sizes = {r["level"]: r["count"] for r in counts.groupBy("level").count().collect()}
    least, total = 64, 0
    for level in sorted(sizes, reverse=True):
        total += sizes[level]
        if total > most:
            break
        least = level
    chosen = counts.where(F.col("level") >= least).select("pair", "n", "best").toArrow()
    order = np.argsort(chosen["pair"].to_numpy())
    return least, tuple(chosen[c].to_numpy()[order] for c in ("pair", "n", "best"))


def _scored(batches: Iterator[pa.RecordBatch], listed) -> Iterator[pa.RecordBatch]:
    pairs, n, best = listed.value
    for batch in batches:
        own, times = batch["pairs"], batch["times"]
        ends = own.offsets.to_numpy()
        codes, often = (x.values.to_numpy()[ends[0] : ends[-1]] for x in (own, times))
        home = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        known = np.zeros(len(codes), bool)
        score, top = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        if len(pairs) and len(codes):
            at = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
            known = pairs[at] == codes
            score = np.where(known, n[at] * often, 0)
            top = np.where(known & best[at], often, 0)
        sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
        np.add.at(sums[0], home, top)
        np.add.at(sums[1], home, score)
        rest = np.concatenate([[0], np.cumsum(np.bincount(home[~known], minlength=batch.num_rows))]).astype("i4")
        columns = {c: batch[c] for c in batch.schema.names if c not in ("pairs", "times")} | {
            "n_best": pa.array(sums[0]),
            "count_sum": pa.array(sums[1]),
            "pairs": pa.ListArray.from_arrays(pa.array(rest), pa.array(codes[~known])),
            "times": pa.ListArray.from_arrays(pa.array(rest), pa.array(often[~known])),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def score_links(aligned: DataFrame, most_listed: int = MOST_LISTED) -> DataFrame:
    """``aligned`` with n_best and count_sum in place of pairs and times.

    Pairs on the list are looked up where the document is.  The others move as narrow
    rows, one per document and pair, and come back as one row per document.
    """
    sc = aligned.sparkSession.sparkContext
    rows = saved(aligned.withColumn("_row", F.monotonically_increasing_id()))
    counts = saved(pair_counts(rows).withColumn("level", F.floor(F.log2("n")).cast("int")))
    least, found = _listed(counts, most_listed)
    listed = sc.broadcast(found)
    names = [c for c in rows.columns if c not in ("pairs", "times")]
    schema = StructType([rows.schema[c] for c in names])
    schema = schema.add("n_best", "long").add("count_sum", "long")
    schema = schema.add("pairs", ArrayType(LongType())).add("times", ArrayType(LongType()))
    part = saved(rows.select(*names, "pairs", "times").mapInArrow(lambda b: _scored(b, listed), schema))
    open_ = part.where(F.size("pairs") > 0).select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    open_ = open_.select("_row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("often"))
    met = open_.join(counts.where(F.col("level") < least), "pair")
    more = met.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("more_best"),
        F.sum(F.col("often") * F.col("n")).alias("more_sum"),
    )
    done = part.join(more, "_row", "left")
    added = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    own = [F.col(f"`{c}`") for c in names if c != "_row"]
    return done.select(*own, added("n_best", "more_best"), added("count_sum", "more_sum"))
