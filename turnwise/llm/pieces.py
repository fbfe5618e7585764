"""Operator 8: encoding and decoding with merge-type SentencePiece vocabularies.

A segment's symbols start as single characters.  All adjacent pairs that are pieces go
on an agenda ordered by score, then by place; the best pair is merged, its neighbours
form new pairs, and so on until the agenda is empty.  What is no piece becomes bytes.

A text is first cut where no piece of the vocabulary can reach across (checked when the
model is read), so a worker encodes equal segments once.  Texts run in Arrow batches;
the new segments of a batch are merged together, and each is held against the
sentencepiece library.

Defined cases: a null text is an empty one; an empty text is the two control ids and
decodes to the empty text; equal rows give equal results; other columns pass unchanged
(a column named like a result is replaced).
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

SPACE = "▁"


class PieceModel:
    """The pieces of a model file, and encoding and decoding by them.

    ``remembered`` bounds the segments whose ids a worker keeps, ``widest`` the length
    up to which segments are merged side by side.
    """

    NONE = np.iinfo(np.int32).max

    def __init__(self, path: str, remembered: int = 400_000, widest: int = 48, check: bool = True):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.remembered, self.widest, self.checked = remembered, widest, check
        self.id: dict[str, int] = {}
        score: dict[str, float] = {}
        self.surface: list[bytes] = []
        self.is_byte = np.zeros(lib.get_piece_size(), bool)
        self.silent = np.zeros(lib.get_piece_size(), bool)
        self.byte_id = [-1] * 256
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.is_byte[i] = i, True
                self.surface.append(bytes([value]))
            elif lib.is_control(i) or lib.is_unused(i):
                self.silent[i] = True
                self.surface.append(b"")
            elif lib.is_unknown(i):
                self.surface.append(" \u2047 ".encode())
            else:
                self.id[piece], score[piece] = i, lib.get_score(i)
                self.surface.append(piece.replace(SPACE, " ").encode())
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        long = [p for p in self.id if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long) or any("\n" in p for p in long):
            raise ValueError("a piece reaches across a word or line border")
        if lib.normalize(" a\tBÀﬁ\n ") != SPACE + SPACE + "a\tBÀﬁ\n" + SPACE:
            raise ValueError("the model changes characters, which is not supported")
        self._cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self._known: dict[str, bytes] = {}
        # every way to make a piece of two: key of the two ids, place in score order, new id
        order = {s: n for n, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = sorted(
            (self.id[p[:k]] << 32 | self.id[p[k:]], order[score[p]], self.id[p])
            for p in long
            for k in range(1, len(p))
            if p[:k] in self.id and p[k:] in self.id
        )
        self._pair = np.array([p[0] for p in pairs] + [np.iinfo(np.int64).max])
        self._place = np.array([p[1] for p in pairs] + [self.NONE], np.int32)
        self._made = np.array([p[2] for p in pairs] + [-1], np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pairs stand in the list of pairs; its last place for no piece."""
        key = (left << 32) | np.maximum(right, 0)
        at = np.searchsorted(self._pair[:-1], key)
        return np.where((self._pair[at] == key) & (left >= 0) & (right >= 0), at, len(self._pair) - 1)

    def _merge(self, segments: list[str]) -> list[bytes]:
        """Ids of segments of one length, merged side by side.

        A row's agenda holds the place in score order of each adjacent pair.  Every step
        takes each row's best (the leftmost among equals), merges it and looks up the
        two pairs that are new.
        """
        width, get = len(segments[0]), self.id.get
        letters = "".join(segments)
        symbols = np.array([get(c, -1) for c in letters], np.int64).reshape(len(segments), width)
        # a symbol without an id (it becomes bytes) is named by its place in the text
        unnamed = symbols < 0
        if unnamed.any():
            symbols = np.where(unnamed, -2 - np.arange(symbols.size).reshape(symbols.shape), symbols)
        rows, out = np.arange(len(segments)), [b""] * len(segments)
        found = self._look_up(symbols[:, :-1], symbols[:, 1:])
        agenda = np.concatenate([self._place[found], np.full((len(rows), 1), self.NONE, np.int32)], axis=1)
        while True:
            best = agenda.argmin(axis=1)
            here = np.arange(len(rows))
            going = agenda[here, best] < self.NONE
            for row, line in zip(rows[~going].tolist(), symbols[~going].tolist()):
                out[row] = self._bytes(line, letters)
            rows, symbols, agenda, best = rows[going], symbols[going], agenda[going], best[going]
            if not len(rows):
                return out
            here = np.arange(len(rows))
            made = self._made[self._look_up(symbols[here, best], symbols[here, best + 1])]
            later = np.arange(symbols.shape[1] - 1) > best[:, None]
            symbols = np.where(later, symbols[:, 1:], symbols[:, :-1])
            agenda = np.where(later, agenda[:, 1:], agenda[:, :-1])
            symbols[here, best] = made
            last = best == symbols.shape[1] - 1
            follower = symbols[here, np.minimum(best + 1, symbols.shape[1] - 1)]
            place = self._place[self._look_up(made, follower)]
            agenda[here, best] = np.where(last, self.NONE, place)
            first = best == 0
            place = self._place[self._look_up(symbols[here, np.maximum(best - 1, 0)], made)]
            agenda[here[~first], best[~first] - 1] = place[~first]

    def _bytes(self, line: list[int], letters: str) -> bytes:
        ids: list[int] = []
        for symbol in line:
            if symbol >= 0:
                ids.append(symbol)
            elif self.byte_id[0] >= 0:
                ids.extend(self.byte_id[b] for b in letters[-2 - symbol].encode())
            else:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merge_long(self, segment: str) -> bytes:
        """One long segment: the agenda as a heap, so the work stays near linear."""
        symbols = [self.id.get(c, -2 - i) for i, c in enumerate(segment)]
        count = len(symbols)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        alive = [True] * count

        def pairs(lefts: list[int]) -> list[tuple[int, int, int, int, int]]:
            lefts = [x for x in lefts if x >= 0 and after[x] < count]
            a = np.array([symbols[x] for x in lefts], np.int64)
            b = np.array([symbols[after[x]] for x in lefts], np.int64)
            found = self._look_up(a, b)
            rows = zip(self._place[found].tolist(), lefts, a.tolist(), b.tolist(), self._made[found].tolist())
            return [r for r in rows if r[0] < self.NONE]

        agenda = pairs(list(range(count)))
        heapq.heapify(agenda)
        while agenda:
            _, left, a, b, made = heapq.heappop(agenda)
            right = after[left]
            # stale unless both symbols are still what the pair was made of
            if not alive[left] or right >= count or symbols[left] != a or symbols[right] != b:
                continue
            symbols[left], alive[right] = made, False
            after[left] = after[right]
            if after[left] < count:
                before[after[left]] = left
            for pair in pairs([before[left], left]):
                heapq.heappush(agenda, pair)
        return self._bytes([s for s, a in zip(symbols, alive) if a], segment)

    def _learn(self, segments: set[str]) -> None:
        """Encode new segments and hold them against the library."""
        by_length: dict[int, list[str]] = {}
        for segment in segments:
            by_length.setdefault(len(segment), []).append(segment)
        for length, group in by_length.items():
            if length > self.widest:
                self._known.update((s, self._merge_long(s)) for s in group)
            else:
                self._known.update(zip(group, self._merge(group)))
        if self.checked:
            # behind a line end, which no piece contains, a segment stands as in its text
            group = list(segments)
            head = len(self.library.encode("\n"))
            theirs = self.library.encode(["\n" + s.replace(SPACE, " ") for s in group], num_threads=1)
            for segment, ids in zip(group, theirs):
                if struct.pack(f"<{len(ids) - head}I", *ids[head:]) != self._known[segment]:
                    raise AssertionError(f"ids differ from the library's: {segment[:80]!r}")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """All ids of each text, with begin and end, as little-endian 32-bit integers."""
        cut, known = self._cut.findall, self._known
        begin, end = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        out = []
        for start in range(0, len(texts), 64):
            parts = [cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts[start : start + 64]]
            if len(known) > self.remembered:
                known.clear()
            new = set().union(*parts).difference(known)
            if new:
                self._learn(new)
            out.extend(begin + b"".join(map(known.__getitem__, p)) + end for p in parts)
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Text of any ids, without the space that encoding puts in front."""
        ids = np.asarray(ids, np.int64)
        ids = ids[~self.silent[ids]]
        if not len(ids):
            return ""
        surface = self.surface
        data = b"".join([surface[i] for i in ids.tolist()])
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = "".join(
                _read(b"".join(surface[i] for i in run)) if of_bytes else b"".join(surface[i] for i in run).decode()
                for of_bytes, run in itertools.groupby(ids.tolist(), key=self.is_byte.__getitem__)
            )
        return text[1:] if text.startswith(" ") and not self.is_byte[ids[0]] and ids[0] != self.unknown else text


def _read(run: bytes) -> str:
    """Bytes as UTF-8, one U+FFFD for each byte that is not part of a character."""
    out = []
    while run:
        try:
            out.append(run.decode())
            break
        except UnicodeDecodeError as bad:
            out.append(run[: bad.start].decode() + "�")
            run = run[bad.start + 1 :]
    return "".join(out)


#: Texts encoded, and rows returned, at once.
ROWS = 256


def _encoded(
    batches: Iterator[pa.RecordBatch], model_path: str, kept: list[str], keep_ids: bool, check: bool
) -> Iterator[pa.RecordBatch]:
    model = PieceModel(model_path, check=check)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            ids = model.encode_batch([t or "" for t in part["text"].to_pylist()])
            decoded = [model.decode(np.frombuffer(b, "<u4")) for b in ids]
            columns = {c: part[c] for c in kept} | {
                "n_tokens": pa.array([len(b) // 4 for b in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
            }
            if keep_ids:
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype("i4"))
                ends = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])]).astype("i4")
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), flat)
                columns["decoded"] = pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def encode_texts(
    docs: DataFrame, model_path: str, keep_ids: bool = True, check: bool = True, keep: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256, and ids and decoded if kept.

    ``keep`` names the columns of ``docs`` to return, all by default.  No shuffle; memory
    is that of one Arrow batch, the results of ``ROWS`` texts and the segments remembered.
    """
    results = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results]
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, "text"])))
    schema = StructType([rows.schema[c] for c in kept])
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if keep_ids:
        schema = schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")
    return rows.mapInArrow(lambda batches: _encoded(batches, model_path, kept, keep_ids, check), schema)
