"""Cross-tokenizer alignment: two encodings of each text cut into groups where both end, and how often their tokens overlap.

A dangling-suffix transducer walks over both encodings: of the two, one leads, and what is not matched yet of its last token is the
residual. The other side's next token either eats up a part of the residual, all of it (a group ends), or more, so that it leads from
then on. The residual always belongs to one token, so each step is one pair of overlapping tokens, and what a step does depends on
the residual and the next token only.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SPACE, byte_characters
from .common import blocks, documents, whole, works, written

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block: what a task holds of links at a time, and what shares one list of distinct pairs.
BLOCK = 4 << 20
#: Stretches of text whose alignment a worker remembers, and as many older ones; steps of the transducer that it remembers, of either side. About 130 MB.
STRETCHES, STEPS = 110_000, 50_000
#: A space that follows white space, or begins a text: there the two encodings need not end together.
INSIDE = re.compile(rf"^ |[{SPACE}] ")
SPACES = re.compile(f"[{SPACE}]")
#: A mark before a stretch that no space precedes; no text has it.
MARK = "\ud800"
#: Ends of words and lines at which both encodings are cut, if no piece holds both sides of one: a stop after a letter and before a space, line or end, and a line feed between others than white space.
CUT = re.compile(rf"(?<=[^\W\d_²³¹])[.,;:!?](?= |\n[^{SPACE}]|\Z)|(?<=[^{SPACE}])\n(?=[^{SPACE}])")
HELD = re.compile(r"[^\W\d_²³¹][.,;:!?]|\n")


class ByteTokens:
    """Byte-level BPE of a tokenizers file, without special tokens; the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = byte_characters()
        ids = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if all(c in of for c in t)}
        raw = lambda m: bytes(of[c] for c in ("".join(m.split(" ")) if isinstance(m, str) else "".join(m)))
        made = [ids[raw(m)] for m in model["merges"]]
        if made != sorted(made) or len(ids) != 256 + len(made):
            raise ValueError("the vocabulary's ids are not in the order of its merges")
        self.bytes = {i: t for t, i in ids.items()}
        order = {t: k for k, t in enumerate(sorted(ids, key=ids.get))}
        self.known = [ids[t] for t in order]
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=order, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        known = self.known
        return [[known[k] for k in self.encoding.encode_ordinary(t)] for t in texts]


class PieceTokens:
    """BPE of a sentencepiece model with byte fallback, which puts a space before each text; the bytes of each id."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") or HELD.search(p) for p in pieces):
            raise ValueError("a piece goes on after a word's or line's end")
        self.bytes = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.space = self.model.piece_to_id("▁")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Of stretches, with the space before each, or of those with MARK without."""
        made = self.model.encode([t[1:] if t[:1] == MARK else t for t in texts], num_threads=1)
        return [(self._bare(t[1], x) if t[0] == MARK else x) if t else [self.space] for t, x in zip(texts, made, strict=True)]

    def _bare(self, first: str, ids: list[int]) -> list[int]:
        """Without the space that the model puts before a text: one piece by itself before a line feed, else part of what it makes with a stop."""
        return ids[1:] if first == "\n" or ids[0] == self.space else [self.model.piece_to_id(first)]


class Transducer:
    """Walks over two encodings of one byte string."""

    def __init__(self, a: dict[int, bytes], b: dict[int, bytes]):
        self.bytes = (a, b)
        self.steps: tuple[dict, dict] = ({}, {})  # by the side that leads: (residual, next token of the other side) -> (side that leads now, residual)

    def step(self, side: int, residual: bytes, token: int) -> tuple[int, bytes] | None:
        """What is left when the side that does not lead adds a token; None where the bytes differ."""
        add = self.bytes[1 - side][token]
        n = min(len(add), len(residual))
        found = None if add[:n] != residual[:n] else (side, residual[n:]) if n < len(residual) else (1 - side, add[n:])
        steps = self.steps[side]
        if len(steps) >= STEPS:
            steps.clear()
        steps[residual, token] = found
        return found

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[int]] | None:
        """(where groups end in a and b, pairs of overlapping tokens as a << 32 | b) of two encodings; None where they do not spell the same bytes."""
        by_a, (after_a, after_b), step = self.bytes[0], self.steps, self.step
        ends, links, i, j = [], [], 0, 0
        n_a, n_b, link, end = len(a), len(b), links.append, ends.append
        y = 0
        while i < n_a:
            x = a[i]
            i += 1
            side, residual = 0, by_a[x]
            while residual:
                if side:
                    if i == n_a:
                        return None
                    x = token = a[i]
                    i += 1
                    known = after_b
                else:
                    if j == n_b:
                        return None
                    y = token = b[j]
                    j += 1
                    known = after_a
                link(x << 32 | y)
                if (found := known.get((residual, token)) or step(side, residual, token)) is None:
                    return None
                side, residual = found
            end((i, j))
        return None if j < n_b else (ends, links)


#: Of a stretch: numbers of a's tokens, of b's tokens and of groups, the groups as text, its links packed as a << 32 | b.
Stretch = tuple[int, int, int, str, bytes]


class Aligner:
    def __init__(self, a: str, b: str):
        self.a, self.b = ByteTokens(a), PieceTokens(b)
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        self.new: dict[str, Stretch | None] = {}
        self.old: dict[str, Stretch | None] = {}

    def stretch(self, a: list[int], b: list[int]) -> Stretch | None:
        found = self.transducer.align(a, b)
        if found is None:
            return None
        ends, links = found
        if len(ends) == 1:
            said = f"{','.join(map(str, a))}|{','.join(map(str, b))}"
        else:
            parts, i, j = [], 0, 0
            for x, y in ends:
                one = x - i == 1 == y - j
                parts.append(f"{a[i]}|{b[j]}" if one else f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
                i, j = x, y
            said = ";".join(parts)
        return len(a), len(b), len(ends), said, struct.pack(f"<{len(links)}q", *links)

    def known(self, asked: set[str]) -> dict[str, Stretch | None]:
        """The stretches by their text without the space before it. Those not remembered are encoded together."""
        out, missing = {}, []
        for text in asked:
            if text in self.new:
                out[text] = self.new[text]
            elif text in self.old:
                out[text] = self.new[text] = self.old[text]
            else:
                missing.append(text)
        for text, a, b in zip(missing, self.a.encode([t[1:] if t[:1] == MARK else f" {t}" for t in missing]), self.b.encode(missing), strict=True):
            out[text] = made = self.stretch(a, b)
            if len(text) <= 64:
                self.new[text] = made
        if len(self.new) >= STRETCHES:
            self.old, self.new = self.new, {}
        return out


def stretches(text: str) -> list[str]:
    """What stands between single spaces, and, with MARK before it, what a CUT parts from what is before: no token of either side reaches over the begin of a stretch. A space after white space is part of a stretch."""
    if not INSIDE.search(text):
        return CUT.sub(rf" {MARK}\g<0>", text).split(" ")
    parts = text.split(" ")
    out = [parts[0]]
    for p in parts[1:]:
        if not out[-1] or SPACES.match(out[-1][-1]):
            out[-1] += f" {p}"
        else:
            out.append(p)
    return out


@functools.cache
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary, local int, a int, b int, n long"


def aligned(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", block: int = BLOCK, with_groups: bool = False) -> DataFrame:
    """Two kinds of rows, by block: of each document, its numbers, groups and links, as numbers of the block's pairs; and the block's distinct pairs (local, a, b, n) with their numbers of links."""
    schema = [x.split(" ") for x in ALIGNED.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = pa.schema([(name, kinds[kind]) for name, kind in schema])

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in types], schema=types)

    def run(batches):
        works("alignment", aligner.cache_clear)
        own = aligner(a, b)
        for number, held in blocks(batches, 1, block):
            ids, numbers, links = held.column(0).to_pylist(), [], []
            texts = held.column(1)
            for at in range(0, len(ids), 500):
                for part in texts.slice(at, 500).to_pylist():
                    asked = stretches(part) if part else []
                    known = own.known(set(asked))
                    found = [known[x] for x in asked]
                    if not found or None in found:
                        numbers.append((0, 0, 0, "", "" if with_groups else None))
                        links.append(b"")
                        continue
                    n_a, n_b, n_groups, said, linked = zip(*found, strict=True)
                    said = ";".join(said)
                    numbers.append((sum(n_a), sum(n_b), sum(n_groups), hashlib.sha256(said.encode()).hexdigest(), said if with_groups else None))
                    links.append(b"".join(linked))
            sizes = [len(x) // 8 for x in links]
            pairs, local, n = np.unique(np.frombuffer(b"".join(links), "<i8"), return_inverse=True, return_counts=True)
            local, ends = local.astype("<u4"), np.cumsum([0, *sizes]).tolist()
            packed = [local[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)]
            n_a, n_b, n_groups, sha, said = zip(*numbers, strict=True)
            for at in range(0, len(ids), 2000):
                cut = slice(at, at + 2000)
                yield rows(
                    len(ids[cut]), block=[number] * len(ids[cut]), doc_id=ids[cut], n_a=n_a[cut], n_b=n_b[cut], n_groups=n_groups[cut], n_links=sizes[cut], groups_sha256=sha[cut], groups=said[cut], links=packed[cut]
                )
            for at in range(0, len(pairs), 50_000):
                cut = slice(at, at + 50_000)
                yield rows(len(pairs[cut]), block=np.full(len(pairs[cut]), number), local=np.arange(len(pairs), dtype=np.int32)[cut], a=pairs[cut] >> 32, b=pairs[cut] & 0xFFFFFFFF, n=n[cut])

    return docs.select(docs[key].cast("long").alias("doc_id"), whole(docs[text]).alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best) of a table (a, b, n): the links that hold a pair of ids linked, and whether no other pair of its b has more."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most")).withColumnRenamed("b", "of")
    return counts.join(most, counts["b"] == most["of"]).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def weigh(key, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one block with the sums over their links, from the counts of the block's pairs."""
    size = (max(pairs.column("local").to_pylist()) + 1) if len(pairs) else 0
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    local = pairs.column("local").to_numpy()
    count[local], best[local] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    sums, bests = [], []
    for packed in docs.column("links").to_pylist():
        at = np.frombuffer(packed, "<u4")
        sums.append(int(count[at].sum()))
        bests.append(int(best[at].sum()))
    out = docs.drop_columns(["block", "links"]).append_column("n_best", pa.array(bests, pa.int64()))
    return out.append_column("count_sum", pa.array(sums, pa.int64()))


def align(docs: DataFrame, a: str | None = None, b: str | None = None, key: str = "doc_id", text: str = "text", block: int = BLOCK, with_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum (and groups, the groups as text); and a, b, count, best of each pair of ids that is linked anywhere.

    a: a tokenizers file with byte-level BPE, of space and text; b: a sentencepiece model, which puts the space there itself; executors read both. A text that is null or empty, or that one of them does not
    spell byte by byte (one with U+2581), has no tokens: zeros, and '' for its groups. Repeated rows give repeated rows, a null doc_id is kept, an empty table gives no rows, further columns are left out.

    Pairs are counted by block first, so that a pair of very frequent tokens is one row a block; counts come back to the blocks that have the pair.
    """
    a, b = a or public_tokenizers.path(BYTES), b or public_tokenizers.path(PIECES)
    both = written(aligned(docs, a, b, key, text, block, with_groups), "aligned", tidy=True)
    in_blocks = both.where("local IS NOT NULL").select("block", "local", "a", "b", "n")
    counts = written(pair_counts(in_blocks), "aligned-pairs", tidy=True)
    back = in_blocks.join(counts, ["a", "b"]).select(F.col("block").alias("at"), "local", "count", "best")
    more = ["groups"] if with_groups else []
    rows = both.where("local IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *more, "links")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " + ("groups string, " if with_groups else "") + "n_best long, count_sum long"
    return rows.groupBy("block").cogroup(back.groupBy("at")).applyInArrow(weigh, schema), counts


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))[0]
