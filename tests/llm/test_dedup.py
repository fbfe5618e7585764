"""Operators 1, 2, 3 and 5 against plain Python on small tables with every odd case."""

import collections
import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from turnwise.llm import common, exact_dedup, line_dedup, mixing, near_dup
from turnwise.llm.components import components

SCHEMA = "doc_id bigint, text string, source string, key string, row string, n_chars bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, near and exact copies."""
    base = passage(1, 80)
    rows = [(1, None), (2, ""), (3, base), (4, base), (4, base), (None, base), (None, None), (5, " \t\n"), (6, "one two")]
    rows += [(7, "ONE two"), (8, "Ünder ÜNDER x"), (9, passage(9, 30_000)), (10, passage(9, 30_000) + " end")]
    for i in range(20, 50):
        words = base.split()
        for j in random.Random(i).sample(range(80), i % 4):
            words[j] = f"w{i}"
        rows.append((i, "\n".join([" Shared LINE \r", " ".join(words), "", f"own {i}", "shared line"])))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else f"s{(i or 0) % 3}", "k", "r", len(t or "")) for i, t in odd_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def expected_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        left = True
        for i in ids:
            kept = i == keep and left
            left = left and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, weak):
    # a weak key makes nearly all chunks clash; the verified identifiers tell them apart
    key = (lambda c: F.length(c).cast("bigint") % 7) if weak else F.xxhash64
    found = exact_dedup.exact_duplicates(docs, exact_dedup.chunk_pattern(8, 40), key)
    assert sorted(map(tuple, found.collect()), key=str) == expected_exact(odd_rows())


def test_chunks_rebuild_texts(spark):
    texts = [t or "" for _, t in odd_rows()] + ["x" * 50_000, "a. b? c! \n" * 3_000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    parts = F.regexp_extract_all("text", F.lit(exact_dedup.chunk_pattern()), F.lit(0))
    assert rows.where(F.array_join(parts, "") != F.col("text")).count() == 0


def expected_lines(rows, least):
    counts = collections.Counter()
    strip = " \t\n\x0b\x0c\r"
    keys = [[x.translate(LOWER).strip(strip) for x in (t or "").split("\n")] for _, t in rows]
    for k in keys:
        counts.update(set(k) - {""})
    out = []
    for (i, t), k in zip(rows, keys):
        lines = (t or "").split("\n")
        kept = [x for x, y in zip(lines, k) if y == "" or counts[y] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(4, 2), (1, 4), (7, 3)])
def test_lines(docs, batches, fanout):
    found = line_dedup.drop_shared_lines(docs, min_docs=4, batches=batches, fanout=fanout)
    assert found.columns[:6] == docs.columns
    found = found.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, found), key=str) == expected_lines(odd_rows(), 4)


def shingles(text):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def expected_near(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                group = [group[a] if g == group[b] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return sorted(((i, len(s), least[g]) for (i, _), s, g in zip(rows, sets, group)), key=str)


@pytest.mark.parametrize("tile", [near_dup.TILE, 300])
def test_near(docs, tile):
    found = near_dup.near_duplicates(docs, buckets=3, tile=tile).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect()), key=str) == expected_near(odd_rows())


def test_near_keeps_one_of_each(docs):
    kept = near_dup.drop_near_duplicates(docs, buckets=3)
    assert kept.columns == docs.columns
    expected = {(i, c) for i, n, c in expected_near(odd_rows()) if n}
    groups = {c for _, c in expected}
    with_words = [r.doc_id for r in kept.collect() if WORDS.search(r.text or "")]
    assert sorted(with_words, key=str) == sorted(groups, key=str)


def test_tile_links_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = []
    for i in range(120):
        keep = base[rng.random(400) > rng.choice([0.02, 0.08, 0.15])][: rng.integers(5, 400)]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, rng.integers(0, 60), dtype=np.uint64)])))
    side = rng.integers(0, 2, len(sets))

    def groups(links):
        home = list(range(len(sets)))
        for a, b in links:
            home = [home[a] if h == home[b] else h for h in home]
        return {frozenset(i for i in range(len(home)) if home[i] == h) for h in home}

    plain = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
    ]
    found = near_dup.tile_links(sets)
    assert set(found) <= set(plain) | {(b, a) for a, b in plain} and groups(found) == groups(plain)
    across = near_dup.tile_links(sets, side)
    assert groups(across) == groups([(a, b) for a, b in plain if side[a] != side[b]])


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(200, 260)]
    pairs += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()))
    home = {x: x for p in pairs for x in p}
    for _ in range(70):
        for a, b in pairs:
            home[a] = home[b] = min(home[a], home[b])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == {x: home[x] for x in linked}


def test_mix(docs):
    rows = mixing.mix(docs, rows_per_chunk=7).collect()
    assert len(rows) == len(odd_rows())
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    names = sorted((s for s in by_source if s is not None)) + [None]
    sizes = [sum(r["size"] for r in by_source[s]) for s in names]
    target, open_ = [0.0] * len(names), set(range(len(names)))
    left = 1.5 * sum(sizes)
    while open_:
        share = {i: left * (5, 2, 1)[i % 3] / sum((5, 2, 1)[j % 3] for j in open_) for i in open_}
        full = [i for i in open_ if share[i] > 2 * sizes[i]]
        for i in full or open_:
            target[i] = 2.0 * sizes[i] if full else share[i]
        left -= sum(target[i] for i in full)
        open_ = open_ - set(full) if full else set()
    for s, want, size in zip(names, target, sizes):
        group = by_source[s]
        assert all(r.source_size == size and abs(r.target - want) < 1e-6 * max(1, want) for r in group)
        assert abs(sum(r.taken for r in group) - want) <= 1
        assert all(0 <= r.taken <= 2 * r["size"] for r in group)
    again = mixing.mix(docs.repartition(3), rows_per_chunk=1000).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixed_documents_hold_the_words_taken(docs):
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.taken
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.source] += len(WORDS.findall(r.text))
        assert r.n_chars == len(r.text)
    assert words == collections.Counter({k: v for k, v in taken.items() if v})


def test_empty_tables(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert line_dedup.drop_shared_lines(empty).count() == 0
    assert near_dup.near_duplicates(empty).count() == 0
    assert near_dup.drop_near_duplicates(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def _near_texts():
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = words(5)
    # forty texts with one shingle in common, and two pairs of near copies
    rows = [(i, " ".join(words(20) + shared + words(20))) for i in range(40)]
    for i in (100, 200):
        text = words(60)
        rows += [(i, " ".join(text)), (i + 1, " ".join(text[:-1] + words(1)))]
    return rows


def test_one_shared_shingle_moves_no_sets(spark):
    docs = spark.createDataFrame(_near_texts(), "doc_id bigint, text string").repartition(3)
    for tile in (near_dup.TILE, 50):
        groups = near_dup.candidate_groups(docs, 3, tile).collect()
        assert len(groups) == 4 and len({r.part for r in groups}) == 2
        found = near_dup.near_duplicates(docs, buckets=3, tile=tile)
        assert {r.doc_id: r.component_id for r in found.collect()} == {i: 100 * (i // 100) if i >= 100 else i for i, _ in _near_texts()}


def test_near_duplicates_leave_narrow_tables_only(spark, tmp_path, monkeypatch):
    # a folder of its own: other runs may write to the shared one
    monkeypatch.setattr(common, "scratch_dir", lambda spark: str(tmp_path))
    docs = spark.createDataFrame(_near_texts(), "doc_id bigint, text string")
    near_dup.near_duplicates(docs, buckets=3).count()
    folder = f"{tmp_path}/turnwise-llm"
    left = os.listdir(folder)
    columns = [set(spark.read.parquet(f"{folder}/{name}").columns) for name in left]
    assert len(left) == 2 and all("shingles" not in c for c in columns), columns


def test_bitmaps_allow_every_link():
    import numpy as np

    rng = np.random.default_rng(4)
    sets = []
    for n in (3, 4, 40, 63, 64, 65, 300, 9000, 30000):
        base = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        for share in (0.0, 0.05, 0.12, 0.2):
            sets.append(np.unique(np.concatenate([base[rng.random(n) >= share], rng.integers(0, 1 << 62, 2, dtype=np.uint64)])))
    sets = sorted((s for s in sets if len(s)), key=len)
    sizes = np.array([len(s) for s in sets])
    home = list(range(len(sets)))
    for a, b in near_dup._forest(sizes, [near_dup.bitmap(s) for s in sets], None, None):
        home = [home[a] if h == home[b] else h for h in home]
    linked = 0
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])):
                linked += 1
                assert home[a] == home[b]
    assert linked > 10 and len(set(home)) > 5
