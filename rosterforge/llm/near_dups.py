"""Similarity join on word shingles: MinHash LSH forest, then exact Jaccard similarity.

Texts with the same shingles are one text from the start. Each text has a label in each tree of the forest: the minima of its shingles under a few hash
functions, one after the other. The labels of a tree, sorted, are a trie: neighbours in the order share the longest prefixes. Texts are candidates where such a prefix is long
enough; what is enough is shortened from the whole label until the recall is reached. Candidates are joined to groups, and within a group every pair that shares a shingle is
compared exactly, in blocks of bounded size, so that neither pairs nor groups are ever listed in one task.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Remembered
from .common import LOWER, UPPER, aside, documents, drop_written, one_of_repeats, row_keys, whole, works, written
from .components import components

WORDS_EACH = 5
#: Similarity as a fraction, so that the comparison is exact: 0.8.
SIMILARITY = (4, 5)
TREES, RECALL = 32, 0.99999
#: A label has so many minima, of 16 bits each.
LONGEST = 8
#: Groups are cut into blocks of about this many texts, yet into no more than BLOCKS until blocks would have more than LARGEST texts or HEAVIEST shingles.
BLOCK, BLOCKS, LARGEST, HEAVIEST = 64, 64, 2048, 2_000_000
#: Bits of the map that tells documents that are no candidates: 2 MB.
MAP_BITS = 1 << 24


def chance(similarity: float, length: int, trees: int = TREES) -> float:
    """The probability that two texts of that similarity share a prefix of that length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def shortest_prefix(similarity: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The length beyond which prefixes need not be shortened: there even pairs at the least similarity have the recall."""
    for length in range(LONGEST, 0, -1):
        if chance(similarity, length, trees) >= recall:
            return length
    raise ValueError("the forest has too few trees for that recall")


@functools.cache
def _word_hashes() -> Remembered:
    return Remembered(lambda w: xxhash.xxh3_64_intdigest(w), 50_000)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible pattern."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingles(text: str, each: int = WORDS_EACH) -> np.ndarray:
    """The sorted 64-bit hashes of a text's shingles: of each run of so many words, or of all words if there are fewer; words are lower-cased in A-Z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    size = min(each, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
    return np.unique(mixed(out))


@functools.cache
def _factors(trees: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return tuple(rng.integers(0, 1 << 32, trees * LONGEST, np.uint32) | np.uint32(1) for _ in range(2))


def labels(found: np.ndarray, trees: int = TREES) -> np.ndarray:
    """The label of a set of shingles in each tree, as two 64-bit numbers (trees x 2): each minimum is one of 32 bits, of which a hash of 16 goes into the label."""
    multiply, add = _factors(trees)
    low, high = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(trees * LONGEST, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(found), 256):
            product = low[k : k + 256, None] * multiply
            product ^= product >> np.uint32(15)
            product += high[k : k + 256, None] * add
            least = np.minimum(least, product.min(axis=0))
        least *= np.uint32(0x9E3779B1)
    pairs = (least >> np.uint32(16)).astype(np.uint64).reshape(trees, 2, LONGEST // 2)
    shifts = np.arange(LONGEST // 2 - 1, -1, -1, dtype=np.uint64) * np.uint64(16)
    return (pairs << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)


def shared_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima two labels (n x 2) have in common from the first on."""
    differ = (a ^ b).view(np.uint64)
    out = np.zeros(len(a), np.int64)
    for k in range(LONGEST):
        half, place = divmod(k, LONGEST // 2)
        same = differ[:, half] >> np.uint64(64 - 16 * (place + 1)) == 0
        out += same & (out == k)
    return out


def sketches(docs: DataFrame, key: str, text: str, trees: int = TREES, each: int = WORDS_EACH, carried: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, set_id, n, high, low) and the long columns carried: set_id is a hash of all the text's shingles, n their number, high and low the halves of its label in each tree (none for a text without words)."""

    def run(batches):
        works("near", _word_hashes.cache_clear)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [shingles(t, each) for t in part.column(1).to_pylist()]
                ids = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in found]
                made = [labels(s, trees) if len(s) else np.zeros((0, 2), np.int64) for s in found]
                halves = [pa.array([m[:, k] for m in made], pa.list_(pa.int64())) for k in range(2)]
                columns = [part.column(0), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array([len(s) for s in found], pa.int32()), *halves, *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "set_id", "n", "high", "low", *more])

    more = list(carried or {})
    columns = ", ".join(["doc_id long, set_id long, n int, high array<long>, low array<long>", *(f"{c} long" for c in more)])
    return docs.select(docs[key].cast("long").alias("doc_id"), whole(docs[text]).alias("text"), *(c.alias(n) for n, c in (carried or {}).items())).mapInArrow(run, columns)


def matched(sets: DataFrame, least: int) -> DataFrame:
    """(id, pivots): sets that share a prefix of `least` minima or more with a neighbour among a tree's sorted labels, and for each length from `least` to LONGEST
    the smallest set that shares a prefix of that length with it (itself, if none is smaller).

    Labels are dealt out by ranges and sorted there, so that a prefix that very many sets have goes to as many tasks as it fills; in a batch, sets with one prefix stand together. Where a
    range ends, its last label meets the first one of the next range: two rows a task.
    """
    lengths = range(least, LONGEST + 1)

    def run(batches):
        before, part, first = None, None, None
        for batch in batches:
            tree, high, low, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "high", "low", "set_id"))
            if not len(ids):
                continue
            now = (tree, np.stack([high, low], axis=1), ids)
            part = int(batch.column("part")[0].as_py())
            if before is None:
                first = tuple(x[:1] for x in now)
            else:  # the last of the batch before goes on with the first of this one
                now = tuple(np.concatenate([x[-1:], y]) for x, y in zip(before, now, strict=True))
            tree, label, ids = before = now
            shared = np.where(tree[1:] == tree[:-1], shared_length(label[1:], label[:-1]), 0)
            pivots = []
            for n in lengths:
                begins = np.concatenate([[0], np.flatnonzero(shared < n) + 1])
                pivots.append(np.repeat(np.minimum.reduceat(ids, begins), np.diff(begins, append=len(ids))))
            at = np.flatnonzero(pivots[0] != ids)
            flat = np.stack(pivots, axis=1)[at].ravel()
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(lengths)), pa.array(flat)), none, none, none, none, none], names)
        if before is not None:
            ends = [(part, side, int(t[k]), *x[k].tolist(), int(i[k])) for side, k, (t, x, i) in ((0, 0, first), (1, -1, before))]
            part, side, tree, high, low, ids = (pa.array(c, pa.int64()) for c in zip(*ends, strict=True))
            yield pa.RecordBatch.from_arrays([ids, pa.nulls(2, pa.list_(pa.int64())), part, side, tree, high, low], names)

    names = ["id", "pivots", "part", "side", "tree", "high", "low"]
    each = sets.select("set_id", F.posexplode(F.arrays_zip("high", "low")).alias("tree", "label")).select("tree", "label.high", "label.low", "set_id")
    dealt = each.repartitionByRange("tree", "high", "low", "set_id").sortWithinPartitions("tree", "high", "low", "set_id").withColumn("part", F.spark_partition_id())
    made = written(dealt.mapInArrow(run, "id long, pivots array<long>, part long, side long, tree long, high long, low long"), "near-matched")
    ends = sorted((r.part, r.side, r.tree, r.high, r.low, r.id) for r in made.where("part IS NOT NULL").collect())  # two rows a task
    meet = []
    for x, y in zip(ends, ends[1:], strict=False):
        if x[1] == 1 and y[1] == 0 and x[2] == y[2]:
            shared = int(shared_length(np.array([x[3:5]]), np.array([y[3:5]]))[0])
            meet += [(x[5], [min(x[5], y[5]) if shared >= n else x[5] for n in lengths]), (y[5], [min(x[5], y[5]) if shared >= n else y[5] for n in lengths])]
    return made.where("part IS NULL").select("id", "pivots").union(sets.sparkSession.createDataFrame(meet, "id long, pivots array<long>"))


def matches(found: DataFrame, length: int, least: int) -> DataFrame:
    """(a, b) of what matched() gives, each once: sets and the smallest that they share a prefix of that length with."""
    return found.select(F.col("pivots")[length - least].alias("a"), F.col("id").alias("b")).where("a != b").distinct()


def prefix_length(found: DataFrame, sets: DataFrame, similarity: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The length of the prefixes that make two sets candidates: shortened from whole labels until the recall that matches show is that asked for.

    Of all matches of a length, each pair's similarity is what its labels have in common, its chance of sharing such a prefix follows, and one over it is the number of pairs for each
    found. A pair below the least similarity counts as none, and one pair at the least similarity is taken to be there in any case. At shortest_prefix() all pairs have the recall.
    """
    least = shortest_prefix(similarity, trees, recall)
    if least == LONGEST:
        return least
    pairs = found.select("id", F.posexplode("pivots").alias("at", "pivot")).where("at > 0 AND pivot != id").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.bit_or(F.expr("shiftleft(1, at)")).alias("lengths"))
    of = lambda side: sets.select(F.col("set_id").alias(side), F.col("high").alias(f"high_{side}"), F.col("low").alias(f"low_{side}")).hint("merge")  # noqa: E731  neither side is bounded
    labelled = pairs.join(of("a"), "a").join(of("b"), "b").select("lengths", "high_a", "low_a", "high_b", "low_b")
    counts = labelled.mapInArrow(_agreeing, "lengths int, same int").groupBy("lengths", "same").agg(F.count("*").alias("n")).collect()  # a row for each set of lengths and number of minima
    lengths, same, n = (np.array([r[k] for r in counts], np.int64) for k in range(3))
    alike = same / (trees * LONGEST)
    for length in range(LONGEST, least, -1):
        at = (lengths >> (length - least) & 1 == 1) & (alike > similarity - 0.05)
        there = n[at] / chance(np.maximum(alike[at], similarity), length, trees)
        if (1 + n[at].sum()) / (1 / chance(similarity, length, trees) + there.sum()) >= recall:
            return length
    return least


def _agreeing(batches):
    """Of each pair of labels: how many minima they have in common."""
    for batch in batches:
        a_high, a_low, b_high, b_low = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("high_a", "low_a", "high_b", "low_b"))
        same = sum((x.astype("<i8").view("<u2") == y.astype("<i8").view("<u2")).sum(axis=1) for x, y in ((a_high, b_high), (a_low, b_low)))
        yield pa.RecordBatch.from_arrays([batch.column("lengths"), pa.array(same.astype(np.int32))], ["lengths", "same"])


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """The share of minima that two sets' labels have in common."""
    return float((a.astype("<i8").view("<u2") == b.astype("<i8").view("<u2")).mean())


def seat(ids: np.ndarray) -> np.ndarray:
    """The place of each doc_id in a bit map of MAP_BITS bits."""
    return (mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(MAP_BITS)).astype(np.int64)


def bit_map(ids: DataFrame) -> np.ndarray:
    """Of one column of longs (nulls aside): which places are taken. Each task marks its own map, and the driver gets the places of at most MAP_BITS bits."""

    def run(batches):
        marks = np.zeros(MAP_BITS, bool)
        for batch in batches:
            marks[seat(batch.column(0).drop_null().to_numpy(zero_copy_only=False))] = True
        packed = np.packbits(marks).view("<i8")
        found = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(packed[found])], ["at", "bits"])

    rows = ids.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()  # MAP_BITS / 64 rows at most
    words = np.zeros(MAP_BITS // 64, "<i8")
    words[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return words.view(np.uint8)


def shingle_sets(docs: DataFrame, key: str, text: str, candidates: DataFrame, each: int = WORDS_EACH) -> DataFrame:
    """(set_id, grp, block, blocks, copies, hashes) of the candidates (set_id, rep, ...): the shingles as packed 64-bit numbers.

    A bit map of the candidates' doc_ids, of a fixed size, goes to every task, which makes sets of the documents that may be candidates; the join with the candidates leaves the right ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(candidates.select("rep")))  # MAP_BITS bits

    def run(batches):
        works("near", _word_hashes.cache_clear)
        marks = shared.value
        for batch in batches:
            ids = batch.column(0)
            at = seat(ids.fill_null(0).to_numpy(zero_copy_only=False))
            may = (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(may))
            for a in range(0, batch.num_rows, 500):
                found = [shingles(t, each) for t in batch.column(1).slice(a, 500).to_pylist()]
                own = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 500), pa.array(own), pa.array([s.tobytes() for s in found], pa.binary())], ["doc_id", "own", "hashes"])

    made = docs.select(docs[key].cast("long").alias("doc_id"), whole(docs[text]).alias("text")).mapInArrow(run, "doc_id long, own long, hashes binary")
    # neither side is bounded; a copy of the candidate's own text would give the same set again
    joined = made.join(candidates.hint("merge"), (made["own"] == candidates["set_id"]) & made["doc_id"].eqNullSafe(candidates["rep"]))
    return joined.select("set_id", "grp", "block", "blocks", "copies", "hashes")


def compare(left: list[np.ndarray], right: list[np.ndarray], similarity: tuple[int, int]) -> list[tuple[int, np.ndarray]]:
    """For each set of `left` with a partner: its place and the places of the sets of `right` that are as similar. An index of right's hashes counts what is shared."""
    if not left or not right:
        return []
    sizes = np.array([len(s) for s in right])
    hashes, owners = np.concatenate(right), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owners = hashes[order], owners[order]
    up, down = similarity
    out = []
    for k, s in enumerate(left):
        begin, end = np.searchsorted(hashes, s, "left"), np.searchsorted(hashes, s, "right")
        count = end - begin
        total = int(count.sum())
        if not total:
            continue
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(total)
        shared = np.bincount(owners[at], minlength=len(right))
        alike = np.flatnonzero((shared > 0) & (shared * down >= up * (len(s) + sizes - shared)))
        if len(alike):
            out.append((k, alike))
    return out


class _Roots(dict):
    """Union-find by smallest member."""

    def find(self, x: int) -> int:
        while self.setdefault(x, x) != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)


def within_blocks(sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(set_id, root, texts, copies) of each set: the smallest set_id that links within its block lead to, its partners in the block, and how many rows they stand for."""

    def block(rows: list[tuple]):
        ids, counts, found = [r[0] for r in rows], np.array([r[1] for r in rows]), [np.frombuffer(r[2], np.uint64) for r in rows]
        roots, mine = _Roots(), {i: (0, 0) for i in ids}
        for k, alike in compare(found, found, similarity):
            alike = alike[alike != k]
            mine[ids[k]] = len(alike), int(counts[alike].sum())
            for j in alike.tolist():
                roots.join(ids[k], ids[j])
        return [(i, roots.find(i), *mine[i]) for i in ids]

    def run(batches):
        now, rows, out = None, [], []
        for batch in batches:
            for grp, at, *row in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "set_id", "copies", "hashes")), strict=True):
                if (grp, at) != now:
                    out += block(rows)
                    now, rows = (grp, at), []
                if not rows or rows[-1][0] != row[0]:  # rows that repeat doc_id and text give a set again
                    rows.append(tuple(row))
            if len(out) > 20_000:
                yield _long_columns(out, names)
                out = []
        yield _long_columns(out + block(rows), names)

    names = ["set_id", "root", "texts", "copies"]
    dealt = sets.select("grp", "block", "set_id", "copies", "hashes").repartition("grp", "block").sortWithinPartitions("grp", "block", "set_id")
    return dealt.mapInArrow(run, "set_id long, root long, texts long, copies long")


def across_blocks(sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(set_id, root, texts, copies): for each set of a group of several blocks one row with its partners in all other blocks, and links (set_id, root) between roots of blocks, without counts.

    sets: with the column root of within_blocks(). A task has a whole block and meets the sets of all other blocks, some at a time. So a set is counted in one place, and there are no more links
    than it takes to connect the roots of two blocks.
    """

    def meet(own: list[tuple], others: list[tuple], at: int, texts: np.ndarray, copies: np.ndarray, roots: _Roots, links: set):
        weights = np.array([r[3] for r in others])
        for k, alike in compare([r[4] for r in own], [r[4] for r in others], similarity):
            texts[k] += len(alike)
            copies[k] += weights[alike].sum()
            for j in alike.tolist():
                x, y = roots.find(own[k][2]), roots.find(others[j][2])
                if others[j][0] > at and x != y:  # the pair of blocks is met twice, and gives links once
                    links.add((max(x, y), min(x, y)))
                    roots.join(x, y)

    def run(batches):
        now, own, others, held, state, last, out = None, [], [], 0, (), None, []

        def flush():
            nonlocal others, held
            if others:
                meet(own, others, now[1], *state)
            others, held = [], 0

        def done():
            flush()
            if not state:
                return []
            texts, copies, _, links = state
            return [*((r[1], None, int(t), int(c)) for r, t, c in zip(own, texts, copies, strict=True)), *((a, b, None, None) for a, b in sorted(links))]

        for batch in batches:
            for grp, to, *row in zip(*(batch.column(c).to_pylist() for c in ("grp", "to", "block", "set_id", "root", "copies", "hashes")), strict=True):
                if (grp, to) != now:
                    out += done()
                    now, own, state, last = (grp, to), [], (), None
                if row[1] == last:  # rows that repeat doc_id and text give a set again
                    continue
                last = row[1]
                row[4] = np.frombuffer(row[4], np.uint64)
                if row[0] == to:
                    own.append(tuple(row))
                    continue
                if not state:
                    state = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), _Roots(), set()
                others.append(tuple(row))
                held += len(row[4])
                if len(others) >= LARGEST or held >= HEAVIEST:
                    flush()
            if len(out) > 20_000:
                yield _long_columns(out, names)
                out = []
        yield _long_columns(out + done(), names)

    names = ["set_id", "root", "texts", "copies"]
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = sets.where("blocks > 1").withColumn("to", F.explode(every)).select("grp", "to", "block", "set_id", "root", "copies", "hashes", (F.col("block") != F.col("to")).alias("other"))
    return dealt.repartition("grp", "to").sortWithinPartitions("grp", "to", "other", "set_id").mapInArrow(run, "set_id long, root long, texts long, copies long")


def _long_columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, trees: int = TREES, recall: float = RECALL, carried: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, n_text_links, n_shingles, class_key, and the long columns carried.

    Two documents are linked if their sets of five-word shingles (all words, if fewer; A-Z lower-cased) have a Jaccard similarity of 4/5 or more. A class is what
    links lead to; class_id is its smallest doc_id (null ones aside), class_key a number that no other class has, whatever ids repeat. n_links counts the other documents linked to this one, n_text_links the other sets of shingles. Texts
    without words, nulls too, are alike: one class. Rows that repeat are documents of their own; an empty table gives no rows; further columns are left out.

    Shingles and sets of shingles are told apart by hashes of 64 bits. Linked pairs are missed only where the forest misses them; see prefix_length().
    """
    found = written(sketches(docs, key, text, trees, carried=carried), "near-sketches")
    sets = written(
        found.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("high").alias("high"), F.first("low").alias("low")), "near-sets"
    )
    least = similarity[0] / similarity[1]
    shortest = shortest_prefix(least, trees, recall)
    alike = matched(sets, shortest)
    groups = components(matches(alike, prefix_length(alike, sets, least, trees, recall), shortest))
    members = groups.join(sets.select("set_id", "rep", F.col("size").alias("copies"), "n").hint("merge"), F.col("id") == F.col("set_id")).select("set_id", F.col("component").alias("grp"), "rep", "copies", "n")
    sizes = written(members.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("weight")), "near-groups")
    needed = F.greatest(F.ceil(F.col("members") / LARGEST), F.ceil(F.col("weight") / HEAVIEST))
    blocks = F.greatest(needed, F.least(F.ceil(F.col("members") / BLOCK), F.lit(BLOCKS))).cast("int")
    candidates = written(members.join(sizes, "grp").select("set_id", "grp", "rep", "copies", blocks.alias("blocks"), F.pmod(F.xxhash64("set_id"), blocks).cast("int").alias("block")), "near-candidates")
    hashed = written(shingle_sets(docs, key, text, candidates), "near-hashes")
    inner = written(within_blocks(hashed, similarity), "near-inner")
    rooted = hashed.where("blocks > 1").join(inner.select("set_id", "root").hint("merge"), "set_id")
    outer = written(across_blocks(rooted, similarity), "near-outer")
    drop_written(hashed)
    classes = components(outer.where("root IS NOT NULL").select("root", "set_id").toDF("a", "b"))
    counted = inner.union(outer.where("root IS NULL")).groupBy("set_id").agg(F.max("root").alias("root"), F.sum("texts").alias("texts"), F.sum("copies").alias("copies"))
    known = (
        sets.select("set_id", "rep", "size", "n")
        .join(counted, "set_id", "left")
        .withColumn("root", F.coalesce("root", "set_id"))
        .join(classes.withColumnRenamed("id", "root"), "root", "left")
        .withColumn("component", F.coalesce("component", "root"))
    )
    totals = written(known.groupBy("component").agg(F.min("rep").alias("class_id"), F.sum("size").alias("class_size")), "near-totals")
    by_set = written(
        known.join(totals, "component").select(
            "set_id", "class_id", "class_size", F.col("component").alias("class_key"), (F.col("size") - 1 + F.coalesce("copies", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"), F.col("n").alias("n_shingles")
        ),
        "near-classes",
    )
    documents_of = written(found.select("doc_id", "set_id", *(carried or {})), "near-documents")
    for table in (found, sets, alike, sizes, candidates, inner, outer, totals):
        drop_written(table)  # what is returned reads the other two
    return documents_of.join(by_set.hint("merge"), "set_id").select("doc_id", "class_id", "class_size", "n_links", "n_text_links", "n_shingles", "class_key", *(carried or {}))


@aside
def keep_one_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each class one row stays, of the smallest doc_id (one without doc_id only where no row of the class has any)."""
    names = ["__none", "__id", "__hash"]
    keys = row_keys(docs[key], whole(docs[text]))
    found = near_duplicates(docs, key, text, carried={"hash": keys["__hash"]}).where("class_size > 1")
    members = written(found.select("class_key", *[c.alias(n) for n, c in (row_keys(F.col("doc_id"), F.lit("")) | {"__hash": F.col("hash")}).items()]).groupBy("class_key", *names).count(), "near-members")
    stays = members.groupBy("class_key").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    gone = written(members.join(stays, names, "left_anti").select(*names), "near-gone")
    again = written(members.where("count > 1").join(stays, names, "left_semi").select(*names), "near-again")
    rows = docs.withColumns(keys).join(gone, names, "left_anti")
    return one_of_repeats(rows, names, again).select(*docs.columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("class_key")


OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {WORDS_EACH} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {WORDS_EACH - 2}), lambda i: array_to_string(ws[i:i + {WORDS_EACH - 1}], ' ')) END)) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(sh, '|')) AS set_id FROM s),
g AS (SELECT doc_id, unnest(sh) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {SIMILARITY[1]} * c >= {SIMILARITY[0]} * (x.n + y.n - c)
  UNION ALL SELECT x.doc_id, y.doc_id FROM n x JOIN n y ON x.n = 0 AND y.n = 0 AND x.doc_id <> y.doc_id),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
class AS (SELECT doc_id, min(r) AS class_id, count(*) AS class_size FROM reach GROUP BY 1),
counted AS (SELECT a AS doc_id, count(*) AS n_links, count(DISTINCT CASE WHEN x.set_id <> y.set_id THEN y.set_id END) AS n_text_links FROM links JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b GROUP BY 1)
SELECT doc_id, class_id, class_size, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links, CAST(n AS INTEGER) AS n_shingles FROM n JOIN class USING (doc_id) LEFT JOIN counted USING (doc_id)"""
