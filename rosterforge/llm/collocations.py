"""Phrase collocation mining by hierarchical pair naming.

Each frequent word of a language has a name. In the sequence of names, each pair of neighbours that is frequent over all texts gets a
name of its own, and a sequence of pairs' names takes the place of that of words; two neighbouring pairs overlap in all but their ends,
so naming them in turn names the phrases that are one word longer. A name points to its two parents, the phrase without its last word
and the one without its first: cuts are looked up along the parents, and a phrase is part of a longer one if it is a parent.

Texts are kept as blocks of numbers of the block's own lists of words and pairs. Only those lists, with counts, are dealt out by word or
pair, and the names come back to the blocks that have them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, blocks, documents, whole, works, written

#: Words of a phrase at most, the least count of a phrase, what is reported of a language, and the share (in per cent) of a phrase's count at which a longer one takes its place.
LONGEST, LEAST, MOST, SHARE = 3, 10, 2000, 50
#: Bytes of text in a block, and pairs of blocks in a bucket, in which one task names pairs.
BLOCK, IN_BUCKET = 8 << 20, 2_000_000
#: Parts of a language of which the first rows are taken before its first rows are.
PARTS = 64
#: A-Z to a-z, tab to space, and whatever ends a piece to a line feed between spaces.
TO_LOWER = bytes.maketrans((UPPER + "\t.,;:!?\x0b\x0c\r").encode(), (LOWER + " " + "\n" * 9).encode())
BREAK, NOTHING = 0, 1  # numbers of the end of a piece, and of nothing between two spaces


class Numbers(dict):
    """Numbers of a language's words in a block; `listed` has the words of all languages in order."""

    def __init__(self, lang: str, listed: list[tuple[str, bytes]]):
        super().__init__({b"\n": BREAK, b"": NOTHING})
        self.lang, self.listed = lang, listed

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.listed) + 2
        self.listed.append((self.lang, word))
        return number


SPELLED = "block long, sequence binary, local int, lang string, word string, n long"
SPELLED_ARROW = pa.schema([("block", pa.int64()), ("sequence", pa.binary()), ("local", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def squeeze(x: np.ndarray) -> bytes:
    """An array of one integer type, its bytes by place, so that small numbers take little room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def unsqueeze(packed: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def spelled(docs: DataFrame, text: str, lang: str, block: int) -> DataFrame:
    """Two kinds of rows, by block: its sequence of numbers (0 between pieces), and its words (local, lang, word, n) with their counts."""

    def run(batches):
        works("collocations")
        for number, held in blocks(batches, 0, block):
            listed: list[tuple[str, bytes]] = []
            by_lang: dict[str, Numbers] = {}
            parts = [np.zeros(1, np.int32)]
            for at in range(0, held.num_rows, 500):
                part = held.slice(at, 500)
                for x, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    numbers = by_lang.get(name) or by_lang.setdefault(name, Numbers(name, listed))
                    tokens = x.translate(TO_LOWER).replace(b"\n", b" \n ").split(b" ")
                    parts.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
                    parts.append(parts[0])
            sequence = np.concatenate(parts)
            sequence = sequence[sequence != NOTHING]
            sequence = np.where(sequence > NOTHING, sequence - 1, 0).astype(np.int32)
            n = np.bincount(sequence, minlength=len(listed) + 1)[1:]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([squeeze(sequence)], pa.binary()), *(pa.nulls(1, f.type) for f in list(SPELLED_ARROW)[2:])], schema=SPELLED_ARROW)
            for at in range(0, len(listed), 50_000):
                cut = slice(at, at + 50_000)
                langs, words = [x for x, _ in listed[cut]], [w.decode() for _, w in listed[cut]]
                columns = [np.full(len(words), number), pa.nulls(len(words), pa.binary()), np.arange(1, len(listed) + 1, dtype=np.int32)[cut], langs, words, n[cut]]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, SPELLED_ARROW, strict=True)], schema=SPELLED_ARROW)

    return docs.select(whole(docs[text]).cast("binary").alias("text"), F.coalesce(docs[lang], F.lit("und")).alias("lang")).mapInArrow(run, SPELLED)


PAIRED = "block long, sequence binary, bucket int, first int, left binary, right binary, n binary"
PAIRED_ARROW = pa.schema([("block", pa.int64()), ("sequence", pa.binary()), ("bucket", pa.int32()), ("first", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("n", pa.binary())])


def neighbours(buckets: int, with_sequence: bool):
    """Makes of a block's sequence and its numbers' names the sequence of pairs and, by bucket, the list of distinct pairs."""

    def run(key, held: pa.Table, named: pa.Table) -> pa.Table:
        block = key[0].as_py()
        sequence = unsqueeze(held.column("sequence")[0].as_py(), "<i4")
        local, names = named.column("local").to_numpy(), named.column("name").to_numpy()
        place = np.zeros(int(max(sequence.max(initial=0), local.max(initial=0))) + 1, np.int64)
        place[local] = np.arange(1, len(local) + 1)
        dense = place[sequence]
        left, right = dense[:-1], dense[1:]
        there = (left > 0) & (right > 0)
        codes = left[there] * (len(local) + 1) + right[there]
        pairs, at, n = np.unique(codes, return_inverse=True, return_counts=True)
        first, second = names[pairs // (len(local) + 1) - 1], names[pairs % (len(local) + 1) - 1]
        mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        bucket = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((second, first, bucket))
        begins = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        out: list[list] = [[] for _ in PAIRED_ARROW]
        if with_sequence:
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(1, len(order) + 1, dtype=np.int32)
            following = np.zeros(len(sequence), np.int32)
            following[:-1][there] = rank[at]
            for column, value in zip(out, (block, squeeze(following), None, None, None, None, None), strict=True):
                column.append(value)
        for a, z in zip(begins.tolist(), [*begins[1:].tolist(), len(order)], strict=False):
            own = order[a:z]
            row = (block, None, int(bucket[own[0]]), a + 1, squeeze(first[own]), squeeze(second[own]), squeeze(n[own]))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, PAIRED_ARROW, strict=True)], schema=PAIRED_ARROW)

    return run


NAMED = "name long, left long, right long, f long, block long, local int"
NAMED_ARROW = pa.schema([("name", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("f", pa.int64()), ("block", pa.int64()), ("local", pa.int32())])


def name_pairs(least: int):
    """Of the lists of a bucket's pairs: the frequent ones with a name and their count, and for each block the names of those that it has."""

    def run(key, held):
        lists = [[unsqueeze(x, "<i8") for x in held.column(c).to_pylist()] for c in ("left", "right", "n")]
        sizes = [len(x) for x in lists[0]]
        left, right, n = (np.concatenate(x) for x in lists)
        local = np.concatenate([np.arange(a, a + s, dtype=np.int32) for a, s in zip(held.column("first").to_pylist(), sizes, strict=True)])
        block = np.repeat(held.column("block").to_numpy(), sizes)
        order = np.lexsort((right, left))
        left, right, n, local, block = left[order], right[order], n[order], local[order], block[order]
        begins = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        f = np.add.reduceat(n, begins)
        frequent = np.flatnonzero(f >= least)
        name = np.full(len(begins), -1)
        name[frequent] = (np.int64(key[0].as_py()) << 32) + np.arange(len(frequent))
        each = np.repeat(name, np.diff(begins, append=len(left)))
        back = np.flatnonzero(each >= 0)
        none = lambda size, kind: pa.nulls(size, kind)
        of, size = begins[frequent], len(frequent)
        columns = [
            (name[frequent], each[back]), (left[of], none(len(back), pa.int64())), (right[of], none(len(back), pa.int64())), (f[frequent], none(len(back), pa.int64())), (none(size, pa.int64()), block[back]), (none(size, pa.int32()), local[back]),
        ]
        parts = [pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(c, NAMED_ARROW, strict=True)], schema=NAMED_ARROW) for c in zip(*columns, strict=True)]
        return pa.concat_tables(parts)

    return run


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n), levels): the words of each language, and for each length from 1 a table (name, left, right, lang, phrase, last, before, after) of the phrases found `least` times or more.

    left, right: the names of the parents in the level before (none for words). before: the counts of the phrase's first word, first two words and so on; after: those of the phrase, of it without its first
    word and so on. A null lang is `und`, a null text empty.
    """
    first = written(spelled(docs, text, lang, block), "phrases-words", tidy=True)
    in_blocks = first.where("local IS NOT NULL")
    counts = written(in_blocks.groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrases-counts", tidy=True)
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counts.where(F.col("f") >= least).withColumn("name", F.monotonically_increasing_id())
    none = F.lit(None).cast("long")
    level = written(frequent.select("name", none.alias("left"), none.alias("right"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("before"), F.array("f").alias("after")), "phrases-1")
    names = level.select("lang", F.col("phrase").alias("word"), "name")
    back = written(in_blocks.select("block", "local", "lang", "word").join(names, ["lang", "word"]).select(F.col("block").alias("at"), "local", "name"), "phrases-names", tidy=True)
    words = counts.agg(F.sum("f")).first()[0] or 0
    levels, sequences, buckets = [level], first.where("sequence IS NOT NULL").select("block", "sequence"), words // IN_BUCKET + 1
    for k in range(2, longest + 1):
        paired = sequences.groupBy("block").cogroup(back.groupBy("at")).applyInArrow(neighbours(buckets, k < longest), PAIRED)
        paired = written(paired, f"phrases-pairs-{k}", tidy=True)
        named = paired.where("bucket IS NOT NULL").drop("sequence").groupBy("bucket").applyInArrow(name_pairs(least), NAMED)
        named = written(named, f"phrases-named-{k}", tidy=True)
        of_left = level.select(F.col("name").alias("left"), "lang", F.col("phrase").alias("head"), F.col("before").alias("heads"))
        of_right = level.select(F.col("name").alias("right"), F.col("last").alias("tail"), F.col("after").alias("tails"))
        found = named.where("block IS NULL").select("name", "left", "right", "f").join(of_left, "left").join(of_right, "right")
        phrase, f = F.concat_ws(" ", "head", "tail"), F.array("f")
        level = written(found.select("name", "left", "right", "lang", phrase.alias("phrase"), F.col("tail").alias("last"), F.concat("heads", f).alias("before"), F.concat(f, "tails").alias("after")), f"phrases-{k}", tidy=True)
        levels.append(level)
        sequences = paired.where("sequence IS NOT NULL").select("block", "sequence")
        back = named.where("block IS NOT NULL").select(F.col("block").alias("at"), "local", "name")
    return totals, levels


def scored(level: DataFrame, words: int) -> DataFrame:
    """name, lang, phrase, a, l, r, score of phrases of `words` words, by their lowest-scoring cut, of equal ones the first. Decimals of 38 digits hold the products of counts up to 10^16."""
    exact = lambda c: c.cast("decimal(19,0)")
    a = F.col("after")[0]
    square = (exact(a) * exact(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    cut = lambda k: F.struct(F.expr(f"cast(square div (cast(before[{k - 1}] as decimal(19,0)) * cast(after[{k}] as decimal(19,0))) as long)").alias("score"), F.lit(k).alias("k"), F.col("before")[k - 1].alias("l"), F.col("after")[k].alias("r"))
    best = F.array_min(F.array(*[cut(k) for k in range(1, words)]))
    return level.withColumn("square", square).select("name", "lang", "phrase", a.alias("a"), best.alias("cut")).select("name", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, most: int | None = MOST, share: int = SHARE, block: int = BLOCK
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's phrases of 2 to `longest` words, counted `least` times or more, the first `most` (all, with rank null, where that is None).

    Words are lower-cased (A-Z), between spaces and tabs, and phrases do not reach over `.,;:!?` or line ends. score: of the lowest-scoring cut, a * a / (l * r) in millionths. A phrase that is contained in a longer
    one goes if that has `share` per cent of its count. Order: score and count descending, then phrase. A null lang is `und`; null and empty texts have no words; repeated rows count each; without texts no rows.
    Further columns are left out.
    """
    totals, levels = phrases(docs, text, lang, longest, least, block)
    tables = []
    for k, level in enumerate(levels[1:], 2):
        found = scored(level, k)
        if k < longest:  # the most frequent longer phrase that contains it is one word longer
            longer = levels[k].select(F.explode(F.array("left", "right")).alias("name"), F.col("after")[0].alias("f")).groupBy("name").agg(F.max("f").alias("longer"))
            found = found.join(longer, "name", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
        tables.append(found)
    left = reduce(DataFrame.union, tables)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if most is None:
        ranked = left.withColumn("rank", F.lit(None).cast("long"))
    else:
        parts = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        some = parts.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("at") <= most)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP11_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
lists AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, p, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM lists),
runs AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY p ORDER BY i)),
grams AS (
    SELECT lang, 1 AS k, x AS phrase, count(*) AS f FROM runs GROUP BY ALL
    UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM runs WHERE y IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM runs WHERE z IS NOT NULL GROUP BY ALL
),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
cuts AS (
    SELECT c.lang, c.k, c.phrase, c.a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
    FROM cand c CROSS JOIN (VALUES (1), (2)) AS s(j)
    JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
    JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')
    WHERE j < c.k
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (
    SELECT lang, inside, max(a) AS f FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inside FROM cand WHERE k = 3) GROUP BY ALL
),
kept AS (
    SELECT b.* FROM best b LEFT JOIN longer o ON b.k = 2 AND o.lang = b.lang AND o.inside = b.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
