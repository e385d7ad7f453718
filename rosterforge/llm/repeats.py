"""Suffix-array dedup: the bytes of all texts that are covered by a long string which starts anywhere else too.

A string of WIDTH bytes that is in two places has the same anchor in both: the place of the least hash among its short substrings. So
strings are compared only within what has an anchor's substring in common. Of an anchor, the strings that choose it start side by side;
what they cover is its passage. Equal passages are counted before anything is compared. Different passages of one anchor go to a shard,
which sorts all suffixes of its passages (Larsson-Sadakane: groups of equal prefixes are refined by the ranks of what follows, which
doubles the length each time), takes the common prefixes of neighbours (Kasai), and where an anchor's passages fill several shards, looks
the strings of one up in the others' suffix arrays by binary search.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, drop_written, whole, works, written

#: Bytes of a string that counts as a repeat, and of the substrings of which an anchor has the least hash.
WIDTH, GRAM = 200, 32
#: Bytes of text in a block; of passages in a bucket, whose shards one task compares; of a shard.
BLOCK, BUCKET, SHARD = 4 << 20, 4 << 20, 1 << 20
#: Passages of an anchor from which on they are cut to those of STEPS strings, which are dealt out by what these have in common, so that no task gets all passages of an anchor.
MANY, STEPS = 4096, (8, 1)
_SEGMENT = 1 << 16
_rng = np.random.default_rng(13)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` (a power of 2) bytes from each place on."""
    x, m = _BYTE[data], 1
    while m < gram:
        x = x[:-m] * np.uint64(pow(0x9E3779B97F4A7C15, m, 1 << 64)) + x[m:]
        m *= 2
    return mix(x)


def anchors(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, first, last, hash): the anchors of the texts that end at `ends`, the first and last start of the strings that choose each, and the hash of its substring.

    Where a text is cut into segments, an anchor may come twice with other strings.
    """
    w, low = width - gram + 1, np.uint64((1 << 20) - 1)
    out = []
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(data))  # bytes to the end of the text
    for a in range(0, len(data) - width + 1, _SEGMENT):
        n = min(_SEGMENT, len(data) - width + 1 - a)
        hashes = gram_hashes(data[a : a + n + width - 1], gram)
        rows = -(-len(hashes) // w)
        key = np.full(rows * w, ~np.uint64(0))
        key[: len(hashes)] = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        key = key.reshape(rows, w)
        forward = np.minimum.accumulate(key, axis=1).ravel()
        backward = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        chosen = (np.minimum(backward[:n], forward[w - 1 : w - 1 + n]) & low).astype(np.int64)
        chosen[left[a : a + n] < width] = -1
        begins = np.flatnonzero(np.diff(chosen, prepend=-2))
        last = np.append(begins[1:], n) - 1
        real = chosen[begins] >= 0
        begins, last = begins[real], last[real]
        out.append((chosen[begins] + a, begins + a, last + a, hashes[chosen[begins]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The places of data in the order of their suffixes.

    Larsson-Sadakane: sorted by 7 bytes first (and whether they are there); then in each step only the suffixes of groups that are not single are sorted again, by the rank of what follows.
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(9) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n], rank[order] = -1, first
    h = 7
    single = new & np.append(new[1:], True)
    open_ = np.flatnonzero(~single)  # places in the order whose group is not single
    while len(open_):
        at = order[open_]
        code = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        by = np.argsort(code, kind="stable")
        at, code = at[by], code[by]
        order[open_] = at
        new = np.concatenate([[True], code[1:] != code[:-1]])
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = WIDTH, lanes: int = 8192) -> np.ndarray:
    """Of each place, how many bytes, `most` at most, its suffix has in common with the one before it in the order.

    Kasai: in the order of the text, a suffix has at most one byte less in common than the one a place before. The places are cut into lanes that go on side by side.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out, have = np.zeros(n, np.int64), np.zeros(lanes, np.int64)
    rows = -(-n // lanes)
    begin = np.arange(lanes) * rows
    for k in range(rows):
        i = begin[: np.searchsorted(begin, n - k)] + k
        j = before[i]
        h = np.maximum(have[: len(i)] - 1, 0)
        h[j < 0] = 0
        go = np.flatnonzero((j >= 0) & (h < most))
        while len(go):
            x, y = i[go] + h[go], j[go] + h[go]
            inside = (x < n) & (y < n)
            go = go[inside][data[x[inside]] == data[y[inside]]]
            h[go] += 1
            go = go[h[go] < most]
        out[i] = have[: len(i)] = h
    return out


def packed_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as numbers that sort like them; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + len(data) + 1]
    return key


def look_up(words: np.ndarray, order: np.ndarray, other: np.ndarray, places: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Whether each string of `width` bytes at `places` of another shard (its packed words: other) is at one of the places in `order`, sorted by their strings, of the first.

    Binary search by 8 bytes at a time, within the range that the bytes before have left.
    """
    low, high = np.zeros(len(places), np.int64), np.full(len(places), len(order), np.int64)
    open_ = np.arange(len(places))
    for k in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        wanted = other[places[open_] + k]
        ends = []
        for strictly in (False, True):
            a, z = low[open_], high[open_].copy()
            while (going := a < z).any():
                mid = (a + z) >> 1
                found = words[order[np.minimum(mid, len(order) - 1)] + k]
                less = (found <= wanted if strictly else found < wanted) & going
                a, z = np.where(less, mid + 1, a), np.where(going & ~less, mid, z)
            ends.append(a)
        low[open_], high[open_] = ends
        open_ = open_[low[open_] < high[open_]]
    out = np.zeros(len(places), bool)
    out[open_] = True
    return out


def repeated_starts(passages: list[bytes], counts: list[int], width: int = WIDTH, shard: int = SHARD) -> list[np.ndarray]:
    """Of each of several different passages, which of its starts have a string that starts elsewhere too: in any of them, itself included, or in another copy of itself (counts: how many there are)."""
    parts, size = [[]], 0
    for k, p in enumerate(passages):
        if size + len(p) > shard and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append(k)
        size += len(p)
    made, out = [], [np.full(max(0, len(p) - width + 1), c > 1) for p, c in zip(passages, counts, strict=True)]
    for part in parts:
        lengths = np.array([len(passages[k]) for k in part], np.int64)
        data = np.frombuffer(b"".join(passages[k] for k in part), np.uint8)
        begins = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(part)), lengths)
        valid = np.arange(len(data)) - begins[owner] <= lengths[owner] - width
        order = suffix_array(data)
        string = np.cumsum(common_prefixes(data, order, width)[order] < width) - 1  # the number of each suffix's first `width` bytes
        order, string = order[valid[order]], string[valid[order]]
        first = np.diff(string, prepend=-1) > 0
        hit = np.bincount(string) > 1
        made.append((packed_words(data) if len(parts) > 1 else None, order, string, first, hit, begins, lengths))
    for x, y in itertools.permutations(range(len(made)), 2):  # the shards of one bucket
        (words, order, _, first, _, _, _), (other, at, string, of, hit, _, _) = made[x], made[y]
        hit[string[of][look_up(words, order[first], other, at[of], width)]] = True
    for part, (_, order, string, _, hit, begins, lengths) in zip(parts, made, strict=True):
        places = np.zeros(int(lengths.sum()), bool)
        places[order] = hit[string]
        for k, a, n in zip(part, begins.tolist(), lengths.tolist(), strict=True):
            out[k] |= places[a : a + max(0, n - width + 1)]
    return out


def runs_of(hit: np.ndarray) -> np.ndarray:
    """First and last place of each run of true values, as a flat array."""
    change = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    change[1::2] -= 1
    return change.astype(np.int32)


def covered(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs that intervals cover; those that touch are one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(begin[1:] > end[:-1]) + 1
    return (begin[np.concatenate([[0], new])], end[np.append(new - 1, len(end) - 1)]) if len(begin) else (begin, end)


HELD = "block long, ids array<long>, lengths array<int>, payload binary"
HELD_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])
FOUND = "block long, gram long, same binary, anchor int, first int, last int"
FOUND_ARROW = pa.schema([("block", pa.int64()), ("gram", pa.int64()), ("same", pa.binary()), ("anchor", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
PASSAGES = "gram long, same binary, n long, shift int, passage binary"
PASSAGES_ARROW = pa.schema([("gram", pa.int64()), ("same", pa.binary()), ("n", pa.int64()), ("shift", pa.int32()), ("passage", pa.binary())])
RUNS = "gram long, same binary, runs array<int>"
RUNS_ARROW = pa.schema([("gram", pa.int64()), ("same", pa.binary()), ("runs", pa.list_(pa.int32()))])
PARTS = "of_gram long, of_same binary, begin int, gram long, same binary, n long, shift int, passage binary"
PARTS_ARROW = pa.schema([("of_gram", pa.int64()), ("of_same", pa.binary()), ("begin", pa.int32()), *PASSAGES_ARROW])
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
REMOVED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def table(schema: pa.Schema, columns) -> pa.Table:
    return pa.Table.from_arrays([x if isinstance(x, pa.Array | pa.ChunkedArray) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def text_of(row: pa.Table) -> tuple[bytes, np.ndarray]:
    """The texts of a block's row, one after the other, and where each ends."""
    lengths = row.column("lengths")[0].values.to_numpy()
    return zstandard.ZstdDecompressor().decompress(row.column("payload")[0].as_py()), np.cumsum(lengths, dtype=np.int64)


def held_blocks(docs: DataFrame, key: str, text: str, block: int) -> DataFrame:
    """The texts as blocks: a row with its documents' ids and lengths, and the bytes of all of them."""

    def run(batches):
        works("repeats")
        packer = zstandard.ZstdCompressor(level=3)
        for number, held in blocks(batches, 1, block):
            texts = held.column(1).combine_chunks()
            joined = b"".join(texts.to_pylist())
            lengths = np.array([len(x) for x in texts.to_pylist()], np.int32)
            yield table(HELD_ARROW, ([number], pa.array([held.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), [packer.compress(joined)])).to_batches()[0]

    return docs.select(docs[key].cast("long").alias("doc_id"), whole(docs[text]).cast("binary").alias("text")).mapInArrow(run, HELD)


def found_anchors(held: DataFrame, width: int, gram: int) -> DataFrame:
    """The anchors of each block. same: a digest of the passage and of the anchor's place in it."""

    def run(batches):
        works("repeats")
        for batch in batches:
            for k in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(k, 1)])
                joined, ends = text_of(row)
                anchor, first, last, hashes = anchors(np.frombuffer(joined, np.uint8), ends, width, gram)
                shift = (anchor - first).tolist()
                same = [xxhash.xxh3_128_digest(joined[a : z + width], s) for a, z, s in zip(first.tolist(), last.tolist(), shift, strict=True)]
                columns = np.full(len(anchor), row.column("block")[0].as_py()), hashes.view(np.int64), same, anchor.astype(np.int32), first.astype(np.int32), last.astype(np.int32)
                yield from table(FOUND_ARROW, columns).to_batches(max_chunksize=50_000)

    return held.mapInArrow(run, FOUND)


def fetch(width: int):
    """Of a block, the passages that are asked for."""

    def run(key, held, asked):
        joined, _ = text_of(held)
        first, last, anchor = (asked.column(c).to_pylist() for c in ("first", "last", "anchor"))
        return table(PASSAGES_ARROW, (asked.column("gram"), asked.column("same"), asked.column("n"), [x - a for x, a in zip(anchor, first, strict=True)], [joined[a : z + width] for a, z in zip(first, last, strict=True)]))

    return run


def narrower(passages: DataFrame, width: int, step: int) -> DataFrame:
    """Passages cut into parts of at most `step` strings each, which begin `step` k to `step` (k + 1) - 1 bytes before the anchor. A part goes by k and what all such strings of it have in common, so equal strings still meet."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in PARTS_ARROW]
            for gram, same, n, shift, passage in zip(*(batch.column(c).to_pylist() for c in ("gram", "same", "n", "shift", "passage")), strict=True):
                last = len(passage) - width
                for k in range((shift - last) // step, shift // step + 1):
                    lowest, highest = shift - (k + 1) * step + 1, shift - k * step
                    a, z = max(0, lowest), min(last, highest)
                    core = xxhash.xxh3_64_intdigest(passage[highest : lowest + width], k & 0xFFFFFFFF) - (1 << 63)
                    own = passage[a : z + width]
                    row = (gram, same, a, core, xxhash.xxh3_128_digest(own, shift - a), n, shift - a, own)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield from table(PARTS_ARROW, out).to_batches(max_chunksize=10_000)

    return passages.select("gram", "same", "n", "shift", "passage").mapInArrow(run, PARTS)


def compare(width: int, shard: int):
    """Of a bucket's passages, the runs of starts of strings that are elsewhere too."""

    def run(key, held):
        works("repeats")
        found = repeated_starts(held.column("passage").to_pylist(), held.column("n").to_pylist(), width, shard)
        some = [k for k, x in enumerate(found) if x.any()]
        return table(RUNS_ARROW, (held.column("gram").take(some), held.column("same").take(some), pa.array([runs_of(found[k]) for k in some], pa.list_(pa.int32()))))

    return run


def repeated(passages: DataFrame, width: int, bucket: int = BUCKET, shard: int = SHARD, many: int = MANY, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(gram, same, runs) of a written table of different passages (gram, same, n: how many there are, shift: the anchor's place, passage): the runs of starts whose strings are elsewhere too."""
    size = F.length("passage")
    by_gram = written(passages.groupBy("gram").agg(F.count("*").alias("passages")), "repeats-counts", tidy=True)
    counted = passages.join(by_gram, "gram")
    alone = counted.where("passages = 1 AND n > 1").select("gram", "same", F.array(F.lit(0), size - width).alias("runs"))
    few = counted.where(F.col("passages").between(2, many) if steps else F.col("passages") > 1)
    total = few.agg(F.sum(size)).first()[0] or 0
    dealt = few.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(total // bucket + 1)))
    out = alone.union(dealt.select("bucket", "gram", "same", "n", "passage").groupBy("bucket").applyInArrow(compare(width, shard), RUNS))
    crowded = counted.where(F.col("passages") > many)
    if steps and not crowded.isEmpty():
        parts = written(narrower(crowded, width, steps[0]), "repeats-parts", tidy=True)
        merged = written(parts.groupBy("gram", "same").agg(F.sum("n").alias("n"), F.first("shift").alias("shift"), F.first("passage").alias("passage")), "repeats-merged", tidy=True)
        inner = repeated(merged, width, bucket, shard, many, steps[1:])
        back = parts.select("of_gram", "of_same", "begin", "gram", "same").join(inner, ["gram", "same"])
        runs = F.transform("runs", lambda x: x + F.col("begin"))
        out = out.union(back.groupBy("of_gram", "of_same").agg(F.flatten(F.collect_list(runs)).alias("runs")).select(F.col("of_gram").alias("gram"), F.col("of_same").alias("same"), "runs"))  # as many parts as a passage has
    return out


def removed(width: int):
    """Of a block's texts, what is left and what was removed. A passage without runs is repeated as a whole."""

    def run(key, held, asked):
        joined, ends = text_of(held)
        first, last = (asked.column(c).to_numpy().astype(np.int64) for c in ("first", "last"))
        runs = asked.column("runs")
        every = runs.is_null().to_numpy(zero_copy_only=False)
        some = [np.asarray(x, np.int64) for x in runs.filter(runs.is_valid()).to_pylist()]
        base = np.repeat(first[~every], [len(x) // 2 for x in some]) if some else np.zeros(0, np.int64)
        flat = np.concatenate(some).reshape(-1, 2) if some else np.zeros((0, 2), np.int64)
        begin, end = np.concatenate([first[every], base + flat[:, 0]]), np.concatenate([last[every], base + flat[:, 1]]) + width
        owner = np.searchsorted(ends, begin, "right")  # texts are set one place apart, so that runs of two do not touch
        begin, end = covered(begin + owner, end + owner)
        cuts = np.searchsorted(begin, np.append(0, ends + np.arange(1, len(ends) + 1)))
        rows, at = [], 0
        for k, (i, stop) in enumerate(zip(held.column("ids")[0].as_py(), ends.tolist(), strict=True)):
            gone = list(zip((begin[cuts[k] : cuts[k + 1]] - k).tolist(), (end[cuts[k] : cuts[k + 1]] - k).tolist(), strict=True))
            kept, here = hashlib.sha256(), at
            for a, z in gone:
                kept.update(joined[here:a])
                here = z
            kept.update(joined[here:stop])
            rows.append((i, stop - at, sum(z - a for a, z in gone), len(gone), kept.hexdigest(), [x - at for both in gone for x in both]))
            at = stop
        return table(REMOVED_ARROW, zip(*rows, strict=True))

    return run


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, block: int = BLOCK, bucket: int = BUCKET, shard: int = SHARD, many: int = MANY
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin and end of each removed run, flat) of each text, as UTF-8 bytes.

    A byte goes if a string of `width` bytes covers it that starts anywhere else too, in the same text or another one; strings do not cross texts and are judged on the texts as they are. What is left may cut a
    character in two. A null text is empty; texts shorter than `width` stay; repeated rows are copies of each other, so each loses all of a text that long; a null doc_id is kept; an empty table gives no
    rows; further columns are left out.

    Each block of texts is written once, packed. Anchors are told apart by hashes of 64 bits, passages by digests of 128. A very frequent anchor's passages are counted before the shuffle, and cut finer where too many
    are different.
    """
    held = written(held_blocks(docs, key, text, block), "repeats-texts")
    every = written(found_anchors(held, width, gram), "repeats-anchors")
    # counts are written before they are joined, so that Spark can split the join's part of a very frequent anchor
    again = written(every.groupBy("gram").agg(F.count("*").alias("places")).where("places > 1").select("gram"), "repeats-again", tidy=True)
    found = written(every.join(again, "gram", "left_semi"), "repeats-found", tidy=True)
    drop_written(every)
    counted = found.groupBy("gram", "same").agg(F.count("*").alias("n"), F.min(F.struct("block", "first", "last", "anchor")).alias("one"))
    classes = written(counted, "repeats-classes", tidy=True)
    by_gram = written(classes.groupBy("gram").agg((F.count("*") > 1).alias("several")), "repeats-several", tidy=True)
    told = written(classes.join(by_gram, "gram"), "repeats-told", tidy=True)
    asked = told.where("several").select(F.col("one.block").alias("at"), "gram", "same", "n", "one.first", "one.last", "one.anchor")
    passages = written(held.groupBy("block").cogroup(asked.groupBy("at")).applyInArrow(fetch(width), PASSAGES), "repeats-passages", tidy=True)
    runs = repeated(passages, width, bucket, shard, many).union(told.where("NOT several").select("gram", "same", F.lit(None).cast("array<int>").alias("runs")))
    runs = written(runs, "repeats-runs", tidy=True)
    gone = found.select("block", "gram", "same", "first", "last").join(runs, ["gram", "same"]).select(F.col("block").alias("at"), "first", "last", "runs")
    return held.groupBy("block").cogroup(gone.groupBy("at")).applyInArrow(removed(width), REMOVED)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("spans")


OP13_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT r, doc_id, b, octet_length(b) AS n_bytes FROM t),
places AS (SELECT r, i, md5(b[i:i + {WIDTH - 1}]) AS h FROM (SELECT r, b, unnest(range(1, n_bytes - {WIDTH - 2})) AS i FROM n WHERE n_bytes >= {WIDTH})),
again AS (SELECT h FROM places GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM places SEMI JOIN again USING (h)),
runs AS (SELECT r, i, sum(CASE WHEN step <= {WIDTH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM starts),
gone AS (SELECT r, k, min(i) AS a, max(i) + {WIDTH} AS z FROM runs GROUP BY r, k),
removed AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM gone GROUP BY r),
left_over AS (
    SELECT r, a AS z, lag(z, 1, 1) OVER (PARTITION BY r ORDER BY a) AS a FROM (SELECT r, a, z FROM gone UNION ALL SELECT r, n_bytes + 1, n_bytes + 1 FROM n)
),
kept AS (SELECT r, string_agg(CASE WHEN p.z > p.a THEN hex(n.b[p.a:p.z - 1]) ELSE '' END, '' ORDER BY p.a, p.z) AS h FROM left_over p JOIN n USING (r) GROUP BY r)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM n JOIN kept USING (r) LEFT JOIN removed USING (r)
"""
