"""Scores of texts under a causal self-attention model over subword ids, and under word counts.

A text is its words, lower-cased in A-Z, and an end. The model sees each word's subword ids; frequent pairs of them are one symbol, and rare ids are
spelled in bytes, so that every text has a probability. Counts come from all training texts, of words and of symbols after symbols. Attention is learned from every symbol of every training text once,
whatever the size of the table: each text belongs to one of a few rounds, tasks each learn from their texts of a round, and after it their tables are averaged.
"""

from __future__ import annotations

import base64
import functools
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import BYTES, CHOICES, CLASSES, END, OPENING, PER, Model, Room, blocks, descend, gathered, pieces, scored, start
from .common import documents, whole, written

RANKS = "byte_bpe_50k.tiktoken"
SYMBOLS = 2048
#: Rounds of learning, which share the training texts out; rate of the first round; numbers of a slice of the tables, which are averaged slice by slice on executors.
ROUNDS, RATE, SLICE = 2, 0.05, 4096
#: Words by falling count that every scoring task holds, at most, and their bytes; the others' counts are joined.
HEAD, HEAD_BYTES = 200_000, 64
#: Words whose symbols a worker remembers, about, and as many older ones. Words of over HEAD_BYTES are not remembered.
KNOWN = 200_000
#: Symbols counted at a time, and symbols whose shares are worked out at a time.
COUNTED, SHARED = 1 << 21, 256
FOLDS = 10
#: The token that ends each text: no word, as words hold no white space.
STOP = b"\n"


@functools.cache
def subwords(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def subword_ids(words: list[bytes], path: str) -> np.ndarray:
    """The ids of the words, each after one space."""
    return subwords(path).encode_to_numpy((b" " + b" ".join(words)).decode("utf-8", "replace")) if words else np.zeros(0, np.uint32)


class Alphabet:
    """Symbols: END, the 256 bytes, and the units given: an id, or a pair of ids that follow each other in a word (vocabulary size * (first + 1) + second). From a word's begin on, two ids that
    are such a pair have its symbol; any other id has its own, or is spelled in bytes."""

    def __init__(self, chosen: list[int], path: str):
        self.chosen, self.path = chosen, path
        enc = subwords(path)
        self.size = enc.n_vocab
        own = {i: BYTES + 1 + k for k, i in enumerate(chosen)}
        alone = [[own[i]] if i in own else [1 + b for b in enc.decode_single_token_bytes(i)] for i in range(self.size)]
        pairs = {divmod(i - self.size, self.size): k for i, k in own.items() if i >= self.size}
        #: Symbols of all ids, then of the pairs; where those of an id or pair begin, and how many they are.
        self.pool = np.array([*itertools.chain.from_iterable(alone), *pairs.values()], "<u2")
        self.many = np.array([*map(len, alone), *(1 for _ in pairs)], np.int64)
        self.begin = np.cumsum(self.many) - self.many
        #: The places of ids in a table of pairs (0: in none), and in it the places of pairs in those (0: no pair).
        self.place = np.zeros(self.size, np.int64)
        there = sorted({i for pair in pairs for i in pair})
        self.place[there] = np.arange(1, len(there) + 1)
        self.paired = np.zeros((len(there) + 1, len(there) + 1), np.int32)
        for k, (x, y) in enumerate(pairs):
            self.paired[self.place[x], self.place[y]] = self.size + k
        #: Packed symbols of words: those looked up last, and older ones.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        #: Whether a symbol begins a word, as the end does too.
        first = (i if i < self.size else i // self.size - 1 for i in chosen)
        self.opens = np.array([True, *(b == 32 for b in range(BYTES)), *(enc.decode_single_token_bytes(i)[:1] == b" " for i in first)])

    def spelled(self, words: list[bytes]) -> list[bytes]:
        """Each word's symbols, packed, by work on the ids of all words together."""
        ids, owner = ids_of(words, self.path)
        ids = ids.astype(np.int64)
        place = self.place[ids]
        pair = self.paired[place[:-1], place[1:]]
        pair[owner[1:] != owner[:-1]] = 0
        found, at = pair > 0, np.arange(len(pair))
        begins = found.copy()
        begins[1:] &= ~found[:-1]
        joined = np.flatnonzero(found & ((at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0))  # where pairs overlap, the first of them, the third and so on
        ids[joined] = pair[joined]
        stays = np.ones(len(ids), bool)
        stays[joined + 1] = False
        ids, owner = ids[stays], owner[stays]
        many = self.many[ids]
        ends = np.cumsum(many)
        packed = self.pool[np.arange(ends[-1]) + np.repeat(self.begin[ids] - ends + many, many)].tobytes()
        cuts = [0, *(2 * ends[np.flatnonzero(owner[1:] != owner[:-1])]).tolist(), len(packed)]
        return [packed[x:y] for x, y in itertools.pairwise(cuts)]

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """Each word's symbols, packed. Those of words that are not remembered are found together."""
        missing = [w for w, found in zip(words, map(self.known.get, words), strict=True) if found is None]
        if missing:
            again = list(map(self.older.get, missing))
            new = [w for w, found in zip(missing, again, strict=True) if found is None]
            self.known.update(zip(missing, again, strict=True))
            if new:
                self.known.update(zip(new, self.spelled(new), strict=True))
        found = list(map(self.known.__getitem__, words))
        for w in missing:
            if len(w) > HEAD_BYTES:
                self.known.pop(w, None)
        if len(self.known) >= KNOWN:
            self.older, self.known = self.known, {}
        return found

    def spell(self, words: list[bytes]) -> bytes:
        """The words' symbols, packed."""
        return b"".join(self.look_up(words))

    def sequence(self, words: list[bytes]) -> np.ndarray:
        return sequence(self.spell(words))


def sequence(packed: bytes) -> np.ndarray:
    """The packed symbols between an END and another."""
    made = np.full(len(packed) // 2 + 2, END, np.int32)
    made[1:-1] = np.frombuffer(packed, "<u2")
    return made


@functools.lru_cache(1)
def alphabet(chosen: tuple[int, ...], path: str) -> Alphabet:
    return Alphabet(list(chosen), path)


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as words_of() has them, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    real = pc.greater(pc.binary_length(flat), 0)  # white space at a text's begin or end leaves an empty piece
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real).cast(pa.binary()), np.diff(upto[ends])


def listed(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist()


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) of a column text, an end per text among them. Each task counts what it has read before anything is shuffled."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2500):
                texts = batch.column(0).slice(a, 2500)
                seen = words_in(texts)[0].value_counts()
                yield pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], ["word", "c"])
                yield pa.RecordBatch.from_arrays([pa.array([STOP], pa.binary()), pa.array([len(texts)], pa.int64())], ["word", "c"])

    return train.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def ids_of(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The words' ids and the place of each one's word. All words are encoded at once, as one text: no subword reaches over the space before a word."""
    ids = subword_ids(words, path)
    owner = np.cumsum(opening_ids(path)[ids]) - 1
    if len(words) and owner[-1] + 1 != len(words):  # odd white space inside words has been joined with the space between them
        each = [subword_ids([w], path) for w in words]
        ids, owner = np.concatenate(each), np.repeat(np.arange(len(words)), [len(x) for x in each])
    return ids, owner


def counted_ids(batch, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (word, c) without ends: the words' ids, the place of each one's word, and the counts."""
    words, c = listed(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
    real = np.array([w != STOP for w in words], bool)
    words, c = [w for w in words if w != STOP], c[real]
    return *ids_of(words, path), c


@functools.lru_cache(2)
def opening_ids(path: str) -> np.ndarray:
    """Which ids begin with a space."""
    enc = subwords(path)
    return np.array([enc.decode_single_token_bytes(i)[:1] == b" " for i in range(enc.n_vocab)])


def frequent_units(counts: DataFrame, path: str, n: int) -> list[int]:
    """The n units of an Alphabet that save most symbols in the counted words: an id saves its bytes but one, a pair of ids one symbol."""
    size = subwords(path).n_vocab

    def run(batches):
        spared = np.array([len(subwords(path).decode_single_token_bytes(i)) - 1 for i in range(size)])
        for batch in batches:
            ids, owner, c = counted_ids(batch, path)
            ids, inside = ids.astype(np.int64), np.flatnonzero(owner[1:] == owner[:-1])
            units, at = np.unique(np.concatenate([ids, size * (ids[inside] + 1) + ids[inside + 1]]), return_inverse=True)
            saved = np.bincount(at, weights=np.concatenate([c[owner] * spared[ids], c[owner[inside]]]), minlength=len(units))
            yield pa.RecordBatch.from_arrays([pa.array(units), pa.array(saved.astype(np.int64))], ["unit", "saved"])

    by_unit = counts.mapInArrow(run, "unit long, saved long").groupBy("unit").agg(F.sum("saved").alias("saved"))
    return [r.unit for r in by_unit.where("saved > 0").orderBy(F.desc("saved"), "unit").limit(n).collect()]


def symbol_counts(train: DataFrame, n: int) -> np.ndarray:
    """How often each of n symbols follows each (n x n) in all rows of a column symbols, END standing for the begin of a text too. Each task counts what it reads in a table of that size."""

    def run(batches):
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            ends = bytes(2)
            packed = ends + ends.join(batch.column(0).to_pylist()) + ends  # END is 0
            s = np.frombuffer(packed, "<u2")
            for a in range(0, len(s) - 1, COUNTED):
                part = s[a : a + COUNTED + 1].astype(np.int64)
                total += np.bincount(part[:-1] * n + part[1:], minlength=n * n)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["pair", "c"])

    pairs = train.mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()  # n * n rows at most
    table = np.zeros(n * n)
    table[pairs["pair"].to_numpy()] = pairs["c"].to_numpy()
    return table.reshape(n, n)


def shares(after: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's fixed tables. Half an occurrence of each pair of symbols is shared out by how many kinds of symbols each one follows (Kneser-Ney).

    The most frequent symbols that begin a word are dealt out to the first classes in turn, the others to the rest.
    """
    n = len(after)
    overall = after.sum(axis=0) + 0.1
    overall /= overall.sum()
    back = (after > 0).sum(axis=0) + 0.1
    back /= back.sum()
    classes = np.empty(n, np.int64)
    order = np.argsort(-overall, kind="stable")
    for kind, begin, size in ((True, 0, OPENING), (False, OPENING, CLASSES - OPENING)):
        own = order[opens[order] == kind]
        classes[own] = begin + np.arange(len(own)) % size
    by_class, inside, of_class = np.zeros((n, CLASSES)), np.empty((n, n), np.float32), np.eye(CLASSES)[classes]
    for a in range(0, n, SHARED):  # some symbols' rows at a time, as the driver is to hold few tables of that size
        c = after[a : a + SHARED]
        total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        p = np.where(total > 0, (np.maximum(c - 0.5, 0) + 0.5 * kinds * back) / np.maximum(total, 1), back)
        by_class[a : a + SHARED] = p @ of_class
        inside[a : a + SHARED] = np.log(p) - np.log(by_class[a : a + SHARED, classes])
    by_class = np.maximum(by_class, 1e-30).reshape(n, CHOICES - 1, PER)
    by_group = by_class.sum(axis=2)
    after = np.log(np.concatenate([by_group[:, None], by_class / by_group[:, :, None]], axis=1))
    return after.astype(np.float32), inside, classes


def text_scores(model: Model, sequences: list[np.ndarray], room: Room | None = None) -> np.ndarray:
    """log10 probability of each sequence, which begins and ends with END."""
    last, then, first, begins = blocks(sequences)
    p = np.where(then >= 0, scored(model, last, then, first, room), 0.0).sum(axis=1)
    return np.add.reduceat(p, begins) / math.log(10)


def taught(model: Model, train: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """The model after learning from all texts of a column symbols. A text's hash says in which round it is learned from, once; the tasks' tables are averaged by the numbers of symbols."""
    spark = train.sparkSession
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(Model(*model.learned(), model.after, None, model.classes))

        def run(batches, shared=shared, r=r):
            own = shared.value
            own = Model(*(getattr(own, f).copy() for f in Model.LEARNED), own.after, own.inside, own.classes)
            n = 0

            def parts():
                nonlocal n
                for batch in batches:
                    for packed in batch.column(0).to_pylist():
                        s = sequence(packed)
                        n += len(s) - 1
                        yield from pieces(s)

            descend(own, gathered(parts()), rate / (1 + 2 * r))
            if n:
                flat = np.concatenate([t.ravel() for t in own.learned()])
                cut = [flat[a : a + SLICE].astype(float) * n for a in range(0, len(flat), SLICE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int64()), pa.array([n] * len(cut), pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary())], ["slice", "n", "sums"])

        def add(batches):
            found: dict[int, tuple[int, np.ndarray]] = {}
            for batch in batches:
                for k, n, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    m, so_far = found.get(k, (0, 0.0))
                    found[k] = m + n, so_far + np.frombuffer(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([x.tobytes() for _, x in found.values()], pa.binary())], ["slice", "n", "sums"]
            )

        columns = "slice long, n long, sums binary"
        of_round = train.where(F.pmod(F.xxhash64("symbols"), F.lit(rounds)) == r)
        made = sorted(of_round.mapInArrow(run, columns).repartition("slice").mapInArrow(add, columns).collect())  # the tables once: 800 KB
        if made:
            flat = np.concatenate([np.frombuffer(x.sums) / x.n for x in made])
            at, tables = 0, []
            for t in model.learned():
                tables.append(flat[at : at + t.size].reshape(t.shape).astype(np.float32))
                at += t.size
            model = Model(*tables, model.after, model.inside, model.classes)
        shared.unpersist()
    return model


def head_words(counts: DataFrame, most: int = HEAD) -> tuple[dict[bytes, int], Column]:
    """Words of a count above a bound and of no more than HEAD_BYTES, and the condition that they meet. The bound is the least, in a scale of quarter powers of 2, that leaves no more than `most`."""
    step = F.floor(F.log2("c") * 4)
    histogram = {r.step: r.n for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    bound = max(histogram, default=-1) + 1
    total = 0
    while bound > 0 and total + histogram.get(bound - 1, 0) <= most:
        bound -= 1
        total += histogram.get(bound, 0)
    chosen = (step >= bound) & (F.octet_length("word") <= HEAD_BYTES)
    rows = counts.where(chosen).toArrow()
    return dict(zip(rows["word"].to_numpy().tolist(), rows["c"].to_numpy().tolist(), strict=True)), chosen


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_symbols.

    Texts whose crc32(doc_id as text) is divisible by 10 are held out; the others are learned from (a null doc_id counts as the text "None").
    base_score: sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over a text's tokens, its words and one end. score: log10 probability of the same tokens under the model, by n_symbols symbols.
    A null text counts as empty: the end alone. Repeated rows are learned from and scored as often as they occur; without training texts all counts are 0, and the model has equal
    shares. An empty table gives no rows; further columns are left out.
    """
    path = path or public_tokenizers.path(RANKS)
    spark = docs.sparkSession
    named = docs.select(docs[key].cast("long").alias("doc_id"), whole(docs[text]).alias("text"))
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))) % FOLDS == 0
    train = named.where(~out).select("text")
    counts = written(word_counts(train), "lm-words")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least = math.log10(totals.n + 0.1 * (totals.v + 1))
    chosen = frequent_units(counts, path, SYMBOLS - BYTES - 1)
    head, in_head = head_words(counts)
    known = spark.sparkContext.broadcast(head)  # HEAD words at most

    def spelled(batches):
        head, letters = known.value, alphabet(tuple(chosen), path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                words, sizes = words_in(part.column(1))
                seen = words.dictionary_encode()  # each different word is looked up once
                different = [*listed(seen.dictionary), STOP]
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                begins = ends - sizes
                own = np.full(ends[-1], len(different) - 1)  # each text's last one is an end
                of_word = np.ones(len(own), bool)
                of_word[ends - 1] = False
                own[of_word] = seen.indices.to_numpy()
                c = np.fromiter(map(head.get, different, itertools.repeat(0)), np.int64, len(different))[own]
                base = np.where(c > 0, np.log10(c + 0.1) - least, 0.0)
                rare = np.flatnonzero(c == 0)
                spelling = pa.array([*letters.look_up(different[:-1]), b""], pa.large_binary()).take(pa.array(own))
                at = np.frombuffer(spelling.buffers()[1], np.int64)[np.append(begins, ends[-1])]
                symbols = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(at), spelling.buffers()[2]]).cast(pa.binary())
                upto = np.searchsorted(rare, np.append(begins, ends[-1])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([held_out(i) for i in part.column(0).to_pylist()], pa.bool_()), pa.array(sizes), pa.array(np.add.reduceat((c > 0).astype(np.int64), begins)),
                        pa.array(np.add.reduceat(base, begins)), symbols, pa.ListArray.from_arrays(pa.array(upto), pa.array(different, pa.binary()).take(pa.array(own[rare]))),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "symbols", "rare"],
                )

    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, symbols binary, rare array<binary>"
    made = written(named.mapInArrow(spelled, columns).withColumn("row", F.monotonically_increasing_id()), "lm-symbols")  # each text is spelled once, and read for counts, learning and scores
    known_rows = made.where(~F.col("held_out")).select("symbols")
    model = start(*shares(symbol_counts(known_rows, BYTES + 1 + len(chosen)), alphabet(tuple(chosen), path).opens))
    shared = spark.sparkContext.broadcast(taught(model, known_rows))  # tables of a fixed size

    def run(batches):
        room = Room()
        for batch in batches:
            for a in range(0, batch.num_rows, 250):
                part = batch.slice(a, 250)
                sequences = [sequence(x) for x in part.column("symbols").to_pylist()]
                p = pa.array(text_scores(shared.value, sequences, room))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], p, pa.array([len(x) - 1 for x in sequences], pa.int64())], [*part.schema.names[:-1], "score", "n_symbols"])

    columns = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_symbols long"
    scores = made.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "symbols").mapInArrow(run, columns)
    rare = made.select("row", F.explode("rare").alias("word"))
    tail = counts.where(~in_head)
    base = F.log10(F.coalesce("c", F.lit(0)) + 0.1) - least
    more = rare.join(tail.hint("merge"), "word", "left").groupBy("row").agg(F.count("c").alias("known"), F.sum(base).alias("base"))
    return scores.join(more.hint("merge"), "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(totals.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score", "n_symbols",
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
