"""Byte-level BPE over tables of documents: encoding, decoding and token counts."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CHUNK, REMEMBERED, Encoder, Remembered, json_encoder, rank_encoder
from .common import documents, map_texts, works

RANKS, MODEL = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: Chunks whose tables of prefixes a worker remembers, and as many older ones: about 300 MB.
TABLES = 500_000
#: A text with more tokens than this is over the limit.
LIMIT = 1024
_memories: dict[tuple, Remembered] = {}


def forget() -> None:
    _memories.clear()
    rank_encoder.cache_clear()
    json_encoder.cache_clear()


def memory(kind: str, path: str, make: Callable, limit: int = REMEMBERED) -> Remembered:
    """What a worker remembers of chunks from one task to the next."""
    return _memories.setdefault((kind, path), Remembered(make, limit))


def packed(encoder: Encoder, path: str) -> Remembered:
    """A chunk's ids as little-endian unsigned 32-bit integers."""
    return memory("packed", path, encoder.packed)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers), n_tokens, decoded (binary: the bytes that the ids stand for).

    path: a file of ranks that all executors can read. Special tokens are ordinary text. Repeated rows give repeated rows, a null text
    no ids, an empty table no rows; further columns are left out.
    """

    def make(texts: list[str]) -> dict[str, list]:
        works("tokens", forget)
        encoder = rank_encoder(path, pattern)
        known = packed(encoder, path).__getitem__
        ids = [b"".join(map(known, CHUNK.findall(x))) for x in texts]
        return {"ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": [encoder.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]}

    return map_texts(docs, make, "ids binary, n_tokens long, decoded binary", key, text)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """What encode() gives, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    made = encode(docs, path or public_tokenizers.path(RANKS), pattern)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))


def count_tokens(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_bytes: how many of the text's bytes its first `limit` tokens hold.

    path: a tokenizers file with byte-level BPE that all executors can read; its added tokens count one where they stand in a text. Counts and limits are read from the chunks' tables of prefixes.
    A null text has no tokens; repeated rows give repeated rows, an empty table no rows; further columns are left out.
    """
    path = path or public_tokenizers.path(MODEL)

    def make(texts: list[str]) -> dict[str, list]:
        works("tokens", forget)
        encoder, added = json_encoder(path, pattern)
        known = memory("tables", path, encoder.table, TABLES)
        special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        out: dict[str, list] = {"n_bytes": [], "n_tokens": [], "over_limit": [], "limit_bytes": []}
        for x in texts:
            parts = list(chunks(x, special))
            counts = [1 if c in added else known[c][0][-1] for c in parts]
            size, tokens = len(x.encode()), sum(counts)
            held = size if tokens <= limit else held_bytes(known, added, parts, counts, limit)
            for name, value in zip(out, (size, tokens, tokens > limit, held), strict=True):
                out[name].append(value)
        return out

    return map_texts(docs, make, "n_bytes long, n_tokens long, over_limit boolean, limit_bytes long", key, text)


def chunks(text: str, special: re.Pattern | None) -> list[str]:
    """The chunks of a text; an added token is one by itself."""
    if special is None or not special.search(text):
        return CHUNK.findall(text)
    out, at = [], 0
    for m in special.finditer(text):
        out += [*CHUNK.findall(text[at : m.start()]), m[0]]
        at = m.end()
    return out + CHUNK.findall(text[at:])


def held_bytes(known: Remembered, added: dict[str, int], parts: list[str], counts: list[int], limit: int) -> int:
    """The bytes of the first `limit` tokens: whole chunks, and of the chunk in which the limit falls the tokens that its table leaves when its last ones are taken away."""
    ends = list(itertools.accumulate(counts))
    whole = next(i for i, n in enumerate(ends) if n > limit)
    rest = limit - (ends[whole - 1] if whole else 0)
    at = 0
    if parts[whole] not in added:
        tokens, lengths = known[parts[whole]]
        at = len(tokens) - 1
        while tokens[at] > rest:
            at -= lengths[at]
    return sum(len(c.encode()) for c in parts[:whole]) + at


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
