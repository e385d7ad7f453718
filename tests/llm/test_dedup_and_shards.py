"""Exact dedup, near duplicates and shards against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import SF, TABLE, documents, jaccard_links, table

from pyspark.sql import functions as F

from rosterforge.llm import exact_dedup, near_dups, sharding
from rosterforge.llm.components import components


def test_exact_groups_of_odd_rows(spark):
    df = documents(spark, (1, "Ab"), (2, "aB"), (3, "é"), (4, "É"), (5, None), (6, ""), (7, "x" * 300_000), (8, "X" * 300_000), (8, "x" * 300_000), (None, "ab"))
    rows = exact_dedup.exact_groups(df).collect()
    assert len(rows) == 10
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert {(r.keep_id, r.group_size) for r in (by[1] + by[2] + by[None])} == {(2, 3)}
    assert by[3][0].group_size == by[4][0].group_size == 1 and by[6][0].group_size == 2
    assert by[5][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted(r.kept for r in by[8]) == [False, True] and not by[7][0].kept
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_exact_dedup_of_whole_table(spark):
    docs = table(spark)
    rows = {r.doc_id: r for r in exact_dedup.op1_exact_dedup(spark, SF).collect()}
    groups = defaultdict(list)
    for i, t in docs.items():
        groups[(t or "").encode().lower()].append(i)
    for text, ids in groups.items():
        for i in ids:
            assert (rows[i].keep_id, rows[i].group_size, rows[i].kept, rows[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(text).hexdigest())
    kept = exact_dedup.drop_copies(spark.read.parquet(TABLE))
    assert {r.doc_id for r in kept.collect()} == {max(x) for x in groups.values()} and kept.columns == spark.read.parquet(TABLE).columns


def test_directory_splits_overfull_buckets(spark):
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    hashes = [*(k << 57 for k in range(8)), (1 << 60) + 1, (1 << 60) + 2, 8 << 60, (8 << 60) + 1, 15 << 60]  # first bits: 0000 eight times, 0001, 1000, 1111
    directory, depth = exact_dedup.bucket_directory(spark.createDataFrame([(signed(h),) for h in hashes], "hash long"), capacity=4)
    made = {r.slot: (r.depth, r.bucket) for r in directory.collect()}
    assert depth == 5 and len(made) == 20  # prefixes without keys have no bucket
    assert [made[h >> 59] for h in hashes] == [(5, 0)] * 4 + [(5, 1)] * 4 + [(4, 2)] * 2 + [(1, 16)] * 3


def test_index_of_hashes_that_collide(spark):
    """With a hash of the length alone, chains tell texts apart by their bytes, and overfull buckets are split."""
    docs = [(i, t) for i, t in enumerate(["aa", "bb", "AA", "cc", "", None, "bB", "ccc", "x" * 5, "y" * 5] + ["z" * k for k in range(6, 60)])]
    df = documents(spark, *docs, (1, "bb"))
    weak = lambda c: F.shiftleft(F.length(c).cast("long"), 56)
    plain = {tuple(r) for r in exact_dedup.exact_groups(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    rows = exact_dedup.exact_groups(df, capacity=8, hashed=weak).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == plain and len(rows) == len(docs) + 1
    of = {r.doc_id: r for r in rows}
    assert [of[i].chain for i in (0, 1, 2, 3, 4, 8, 9)] == [0, 1, 0, 2, 0, 0, 1]
    assert max(Counter(r.bucket for r in {r.text_sha256: r for r in rows}.values()).values()) <= 10 and len({r.bucket for r in rows}) >= 7
    kept = exact_dedup.drop_copies(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_, k, _ in plain if k)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (200, 200)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 90, 90: 90, 95: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(spark, df, **options):
    return {r.doc_id: r for r in near_dups.near_duplicates(df, **options).collect()}


def check_links(found, docs):
    links, classes = jaccard_links(docs)
    assert {i: r.n_links for i, r in found.items()} == links
    assert {i: r.class_id for i, r in found.items()} == classes


def test_near_duplicates_of_whole_table(spark):
    check_links(near(spark, spark.read.parquet(TABLE)), table(spark))


def test_near_duplicates_of_a_large_group(spark):
    """A few hundred variants of one text, over several blocks, beside others and short texts."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    docs = {}
    for i in range(300):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = f"v{rng.randrange(50)}"
        docs[i] = " ".join(words)
    docs |= {1000 + i: " ".join(f"z{rng.randrange(9999)}" for _ in range(60)) for i in range(40)}
    docs |= {2000: "a b", 2001: "A  b", 2002: "a", 2003: None, 2004: " \n", 2005: "a b c d e"}
    check_links(near(spark, documents(spark, *docs.items())), docs)


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(50))
    df = documents(spark, (1, text), (1, text), (1, "another text with other words entirely"), (None, text + " more"), (5, text + " more"))
    rows = near_dups.near_duplicates(df).collect()
    assert sorted(r.n_links for r in rows) == [0, 3, 3, 3, 3]
    assert near_dups.near_duplicates(df.limit(0)).count() == 0


def test_prefixes_are_shortened_until_the_recall(spark):
    assert near_dups.shortest_prefix(0.8) == 5 and near_dups.shortest_prefix(0.8, recall=0.99) == 8 and near_dups.shortest_prefix(0.8, recall=0.999) == 7
    with pytest.raises(ValueError, match="trees"):
        near_dups.shortest_prefix(0.8, trees=2)
    rng = np.random.default_rng(2)
    rows, matches = [], []
    for k in range(100):
        both = rng.integers(0, 1 << 63, 330, np.uint64)
        near = 2 if k % 2 else 14  # similarity of about 0.98, or of 0.91
        for i, s in ((2 * k, both[near:300]), (2 * k + 1, both[: 300 - near])):
            high, low = near_dups.labels(np.unique(s)).T.tolist()
            rows.append((i, high, low))
        matches.append((2 * k + 1, [2 * k] * 4))
    sets = spark.createDataFrame(rows, "set_id long, high array<long>, low array<long>")
    found = spark.createDataFrame(matches, "id long, pivots array<long>")
    assert near_dups.prefix_length(found, sets, 0.8) == 7  # none but the pair taken to be there is near the least similarity
    assert near_dups.prefix_length(found.limit(0), sets, 0.8) == 5 and near_dups.prefix_length(found, sets, 0.8, recall=0.99) == 8


def test_prefixes_depend_on_every_match(spark):
    n, rng = 2300, np.random.default_rng(5)
    pairs = spark.range(n).selectExpr("2 * id AS a", "2 * id + 1 AS b").orderBy(F.xxhash64("a", "b")).collect()
    rows = []
    for k, (a, b) in enumerate(pairs):
        one = rng.integers(0, 1 << 16, 256).astype("<u2")
        other = one.copy()
        if k >= 2000:  # the 300 pairs of largest hash are no closer than need be
            other[rng.choice(256, 51, replace=False)] ^= 1
        rows += [(i, x.view("<i8")[:32].tolist(), x.view("<i8")[32:].tolist()) for i, x in ((a, one), (b, other))]
    sets = spark.createDataFrame(rows, "set_id long, high array<long>, low array<long>")
    found = spark.createDataFrame([(b, [a] * 4) for a, b in pairs], "id long, pivots array<long>")
    assert near_dups.prefix_length(found, sets, 0.8) == 6


def test_labels_agree_as_often_as_sets_do():
    rng = np.random.default_rng(4)
    shares = []
    for _ in range(60):
        both = rng.integers(0, 1 << 63, 300, np.uint64)
        shares.append(near_dups.agreement(near_dups.labels(np.unique(both[:250])), near_dups.labels(np.unique(both[50:]))))
    assert abs(np.mean(shares) - 200 / 300) < 0.015


def test_forest_finds_pairs_at_the_threshold():
    """Of pairs a little above the least similarity all share a prefix of the shortest length."""
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 240, np.uint64)
        a, b = np.unique(both[:220]), np.unique(np.concatenate([both[20:220], both[220:]]))
        missed += not np.any(near_dups.shared_length(near_dups.labels(a), near_dups.labels(b)) >= 5)
    assert missed == 0


def test_matches_are_those_of_the_sorted_labels(spark):
    """Over few tasks and many, with a prefix that very many sets have: what is joined at each length are the sets with one prefix."""
    rng = random.Random(6)
    rows = [(i, [rng.choice([5, 5, 5 << 16, i]), 7 + i // 250], [rng.choice([0, 1 << 48, i]), i]) for i in range(500)]
    sets = spark.createDataFrame(rows, "set_id long, high array<long>, low array<long>")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found = near_dups.matched(sets, 5)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        for length in (5, 8):
            edges = []
            for tree in range(2):
                prefixes = defaultdict(list)
                for i, high, low in rows:
                    prefixes[tree, high[tree], low[tree] >> (16 * (8 - length))].append(i)
                edges += [(min(ids), i) for ids in prefixes.values() for i in ids if i != min(ids)]
            expected, made = (components(df) for df in (spark.createDataFrame(edges, "a long, b long"), near_dups.matches(found, length, 5)))
            assert sorted(map(tuple, made.collect())) == sorted(map(tuple, expected.collect()))


def test_links_between_blocks_grow_with_the_group(spark, monkeypatch):
    """Near copies of one text: as many rows across blocks as sets, and a few links for each pair of blocks."""
    kept = []
    monkeypatch.setattr(near_dups, "across_blocks", lambda *x, own=near_dups.across_blocks: kept.append(near_dups.written(own(*x), "kept")) or kept[-1])
    for n in (500, 1000, 2000):
        docs = [(i, " ".join(f"w{k}" if k != 20 + i % 60 else f"v{i}" for k in range(100))) for i in range(n)]
        found = near(spark, documents(spark, *docs))
        assert {r.class_id for r in found.values()} == {0} and all(r.n_links == n - 1 for r in found.values())
        rows = kept[-1].collect()
        assert sum(r.root is None for r in rows) == n and sum(r.root is not None for r in rows) <= (n // 64 + 1) ** 2


def test_jump_hash():
    keys = np.arange(20_000)
    before, after = sharding.jump(keys, 24), sharding.jump(keys, 25)
    moved = before != after
    assert set(after[moved]) == {24} and 0.03 < moved.mean() < 0.05
    assert np.bincount(before, minlength=24).min() > 700 and sharding.jump(np.array([5, -7]), 1).tolist() == [0, 0]

    def plain(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b

    assert sharding.jump(np.array([1, 99, 123456789, -5]), 24).tolist() == [plain(k % 2**64, 24) for k in (1, 99, 123456789, -5)]


def test_shards_of_whole_table(spark):
    docs = table(spark)
    rows = sharding.op7_sharding(spark, SF).collect()
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key") and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(spark):
    df = documents(spark, (None, None), (3, "é"), (3, "é"), (-1, ""))
    rows = sharding.shard_documents(df).collect()
    assert Counter(r.size for r in rows) == {8: 2, 10: 2} and len({(r.shard, r.slot) for r in rows}) == 4
    assert sharding.shard_documents(df.limit(0)).count() == 0
