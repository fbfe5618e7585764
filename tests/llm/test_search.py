"""Operators 11, 12 and 13 against plain Python on small tables with every odd case."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from turnwise.llm import alignment, lexical, minhash

SCHEMA = "doc_id bigint, text string, score bigint, rank string, n bigint, row string, pairs string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, near and exact copies."""
    base = passage(1, 60)
    rows = [(1, None), (2, ""), (3, base), (4, base), (4, base), (None, base), (None, None), (5, " \t\n"), (6, "one two")]
    rows += [(7, "ONE  two"), (8, "Ünder ÜNDER x"), (9, passage(9, 9_000)), (10, passage(9, 9_000) + " end"), (11, "one")]
    rows += [(12, "a b c d e"), (13, "a b c d e f"), (14, "▁ x"), (15, "x" * 3_000), (16, "<|endoftext|> </s>  a ")]
    for i in range(20, 60):
        words = base.split()
        for j in random.Random(i).sample(range(60), i % 5):
            words[j] = f"w{i}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "r", 2, "x", "p") for i, t in odd_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- near duplicates ---------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))) if words else frozenset()


def expected_components(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                group = [group[a] if g == group[b] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return sorted(((i, len(s), least[g], i == least[g]) for (i, _), s, g in zip(rows, sets, group)), key=str)


@pytest.mark.parametrize("bucket,tile", [(minhash.BUCKET, minhash.TILE), (300, 200)])
def test_components_of_links(docs, bucket, tile):
    found = minhash.near_copies(docs, bucket=bucket, tile=tile).drop("text_hash").collect()
    assert sorted(map(tuple, found), key=str) == expected_components(odd_rows())


def test_minima_estimate_similarity():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.8, 0.95):
        found = []
        for _ in range(30):
            union = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
            both = int(300 * share)
            one, two = (np.sort(union[x]) for x in (np.r_[:both, both : (both + 300) // 2], np.r_[:both, (both + 300) // 2 : 300]))
            found.append(np.mean(minhash.minima(one) == minhash.minima(two)))
        assert abs(np.mean(found) - share) < 0.02


def test_links_just_at_the_limit_meet():
    # 40 of 50 shingles: every pair must share a band and pass the signatures
    rng = np.random.default_rng(6)
    for _ in range(300):
        union = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
        one, two = np.sort(union[:45]), np.sort(union[5:])
        assert np.isin(minhash.band_keys(minhash.minima(one)), minhash.band_keys(minhash.minima(two))).any()
        assert minhash.tile_forest([one, two]) in ([(0, 1)], [(1, 0)])


def test_equal_keys_are_chained():
    keys, names, pairs = minhash._chained(np.array([5, 7, 5, 5, 9, 7]), np.array([3, 1, 1, 1, 4, 1]))
    assert keys.tolist() == [5, 7, 9] and names.tolist() == [1, 1, 4] and pairs.tolist() == [[1, 3]]


# --- search ------------------------------------------------------------------


def expected_search(rows, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = [collections.Counter(pattern.findall((t or "").translate(LOWER))) for _, t in rows]
    n = [sum(c.values()) for c in words]
    documents, length = sum(x > 0 for x in n), sum(n)
    df = collections.Counter(t for c in words for t in c)
    out = []
    for item_id, text in items:
        asked = set(pattern.findall((text or "").translate(LOWER)))
        scored = []
        for (doc_id, _), c, size in zip(rows, words, n):
            score = 0
            for t in asked & set(c):
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (10 + (90 * size * documents) // length)))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort(key=lambda r: r[:3])
        out += [(item_id, place, r[3], -r[0]) for place, r in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "one TWO x"), (2, None), (3, ""), (4, passage(1, 40)), (5, passage(9, 300)), (6, "nowhere"), (7, "ünder?ÜNDER"), (8, "a-b.c"), (8, "a-b.c"), (None, "w20 w21")]


@pytest.mark.parametrize("item_bytes,cells", [(lexical.ITEM_BYTES, lexical.CELLS), (700, 1)])
def test_search(spark, docs, monkeypatch, item_bytes, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    items = spark.createDataFrame([(i, t, 1, "r") for i, t in ITEMS], "item_id bigint, text string, score int, rank string")
    found = lexical.search(docs, items, item_bytes=item_bytes).collect()
    assert sorted(map(tuple, found), key=str) == expected_search(odd_rows(), ITEMS)


@pytest.mark.parametrize("terms", [5, 40, 90])
def test_masks_stop_early_and_lose_nothing(terms):
    rng = np.random.default_rng(terms)
    size = 3_000
    presence = rng.random((terms, size)) < rng.uniform(0.01, 0.5, terms)[:, None]
    part = np.where(presence, rng.integers(1, 900_000, (terms, size)), 0).astype(np.int32)
    part[:, ::7] = part[:, :1] * presence[:, ::7]
    weights = rng.integers(1, 9_000, terms)
    places = lexical._Places(10)
    ids = [None if i % 50 == 3 else size - i // 2 for i in range(size)]
    scored = lexical.search_block(presence, part, weights, ids, places)
    scores = weights @ part.astype(np.int64)
    order = sorted(range(size), key=lambda d: (-scores[d], ids[d] is None, ids[d] or 0))[:10]
    assert places.rows == [(scores[d], ids[d]) for d in order]
    assert scored < size
    masks, number = lexical.masks_of(presence)
    assert (masks[number].T == presence).all() and len(masks) == len({c.tobytes() for c in presence.T})


# --- alignment ---------------------------------------------------------------


def expected_alignment(texts):
    """Whole texts by both libraries, shared ends by sets, links written out."""
    tool = alignment.Aligner(*PATHS)
    rows, links = [], []
    for text in texts:
        groups, one, two = [], [], []
        if text:
            one, two = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
            bytes_of = [[tool.bytes_a[i] for i in one], [tool.bytes_b[i] for i in two]]
            if any(b"".join(b) != (" " + text).encode() for b in bytes_of):
                one, two = [], []
            else:
                ends = [np.cumsum([len(t) for t in b]).tolist() for b in bytes_of]
                a = b = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    i, j = ends[0].index(cut) + 1, ends[1].index(cut) + 1
                    groups.append((one[a:i], two[b:j]))
                    a, b = i, j
        found = collections.Counter((x, y) for p, q in groups for x in p for y in q)
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append((len(one), len(two), len(groups), sum(found.values()), written))
        links.append(found)
    count = collections.Counter(pair for found in links for pair in found)
    top = collections.Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return [
        (*r[:4], hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "", sum(n for p, n in f.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in f.items()))
        for r, f in zip(rows, links)
    ]


@pytest.mark.parametrize("most_listed", [alignment.MOST_LISTED, 40, 0])
def test_alignment(docs, most_listed):
    rows = odd_rows()
    aligned = alignment.align_texts(docs, *PATHS, keep=["doc_id", "score", "pairs"])
    assert aligned.columns[:2] == ["doc_id", "score"]
    scored = alignment.score_links(aligned, most_listed).drop("groups", "score").collect()
    expected = [(i, *r) for (i, _), r in zip(rows, expected_alignment([t for _, t in rows]))]
    assert sorted(map(tuple, scored), key=str) == sorted(expected, key=str)


def test_segments_equal_whole_texts():
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "a", "B", "é", "1", "22", ".", ",", "'s", "\t", " ", "　", "漢", "\x1c", "x", "the", "́", "_", "🎉", "\r\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(1_500)]
    texts += ["▁", "a ▁b", " ", "  ", "x ", " ab cd "]
    counts, groups, home, pairs, times = alignment.Aligner(*PATHS).align(texts)
    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
    assert [(*c, d) for c, d in zip(counts.tolist(), digests)] == [r[:5] for r in expected_alignment(texts)]
    assert np.array_equal(np.bincount(home, times, len(texts)), counts[:, 3])


def test_shared_groups():
    rng = random.Random(2)
    for _ in range(500):
        size = rng.randint(1, 60)
        ends = [sorted({size, *rng.sample(range(1, size + 1), rng.randint(0, size))}) for _ in range(2)]
        found = alignment.shared_groups(*ends)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        assert [ends[0][g[1] - 1] for g in found] == [ends[1][g[3] - 1] for g in found] == cuts
        assert [g[0] for g in found[1:]] == [g[1] for g in found[:-1]] and found[0][0] == found[0][2] == 0


def test_large_groups_are_counted_by_distinct_ids():
    tool = alignment.Aligner(*PATHS)
    text = "日" * 40 + "a" * 2_000
    counts, groups, home, pairs, times = tool.align([text, text + text])
    for k in range(2):
        expected = collections.Counter()
        for group in groups[k].split(";"):
            a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
            expected.update(x << 32 | y for x in a for y in b)
        assert dict(zip(pairs[home == k].tolist(), times[home == k].tolist())) == expected


def test_empty_tables(spark, docs, empty):
    assert minhash.near_copies(empty).count() == 0
    assert alignment.score_links(alignment.align_texts(empty, *PATHS)).count() == 0
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(docs, items.where(F.lit(False))).count() == 0


def test_ranges_of_an_id_that_many_rows_have():
    from turnwise.llm.fingerprint import _Cuts

    rng = np.random.default_rng(8)
    places = np.sort(np.concatenate([np.full(4_000, -np.inf), rng.integers(0, 3_000, 4_000).astype(float), np.full(2_000, 77.0)]))
    ties = rng.integers(-(1 << 63), (1 << 63) - 1, len(places))
    found = [places[len(places) * i // 50] for i in range(1, 50)]
    number = _Cuts(found).number(places, ties)
    assert np.bincount(number).max() < 2.5 * len(places) / 50
    # ranges follow the order: later places and ties never have a greater number
    order = np.lexsort((ties, places))
    assert (np.diff(number[order]) <= 0).all() and number.min() >= 0
    assert _Cuts([]).number(places, ties).max() == 0
