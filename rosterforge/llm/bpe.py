"""Byte-level BPE by dynamic programming over prefixes.

The BPE encoding of a byte string's prefix ends in one token only, and that token and the encoding of what stands before it are
all that is needed to extend the prefix. So the table of each prefix's last token *is* the encoding of all prefixes: bytes can be
appended, tokens counted up to any place, and the part behind an edit encoded anew from the place of the edit.
"""

from __future__ import annotations

import base64
import bisect
import functools
import itertools
import json
import re
import struct
from array import array
from collections.abc import Callable

import regex

#: White space as the pattern's \s has it; Python's own \s also has \x1c to \x1f.
SPACE = r"\t-\r \x85\xa0  -     　"
#: No piece of the pattern reaches over the end of one of these.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: So many chunks of a worker's texts are remembered, so many pieces' ids and so many pieces' tables, and as many older ones of each. About 120 MB without the tables.
REMEMBERED, PIECES, LENGTHS = 100_000, 250_000, 50_000
#: Pairs of tokens of which it is remembered whether one follows the other.
PAIRS = 200_000
ID = 256


class Vocabulary:
    """Tokens by id, their ids by bytes, and the rank at which two tokens merge."""

    def __init__(self, tokens: dict[bytes, int], ranks: dict[bytes, int]):
        """ranks: of each token, the place of its merge; smaller merges first. Single bytes have none or one below all merges."""
        self.ids, self.ranks = tokens, {t: (-1 if len(t) == 1 else r) for t, r in ranks.items()}
        self.bytes = {i: t for t, i in tokens.items()}
        self.sizes = {i: len(t) for t, i in tokens.items()}
        self.longest = max(map(len, tokens))
        self.parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.fits: dict[int, bool] = {}
        self.shift = max(tokens.values()).bit_length()
        self.trie: dict = {}  # by byte; the id of the token that ends at a node is at ID
        for token, i in tokens.items():
            if self.made(token):
                node = self.trie
                for b in token:
                    node = node.setdefault(b, {})
                node[ID] = i

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None for a byte, or for what merges never make."""
        if token not in self.parts:
            self.parts[token] = self._split(token)
        return self.parts[token]

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        found = [(token[:k], token[k:]) for k in range(1, len(token)) if token[:k] in self.ranks and token[k:] in self.ranks]
        return next((p for p in found if all(len(x) == 1 or self.split(x) for x in p) and self._together(*p, self.ranks[token])), None)

    def _together(self, left: bytes, right: bytes, before: int) -> bool:
        """Whether left and right stand side by side at the time of rank `before`: no merge across their border comes earlier.

        Merges are undone, latest first, on whichever side of the border has the later one, as far as single bytes. The two tokens at the
        border at each time must not have merged before one of them became part of something larger.
        """
        while True:
            if (rank := self.ranks.get(left + right, before)) < before:
                return False
            a, b = self.ranks[left], self.ranks[right]
            if len(left) == 1 and len(right) == 1:
                return True
            if a > b:
                left, before = self.split(left)[1], a
            else:  # of equal merges the left one came first: here a merge across the border at the same rank would have won
                right, before = self.split(right)[0], b + 1

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of the bytes of two tokens is these two."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        known = self.fits[left << self.shift | right] = self._together(self.bytes[left], self.bytes[right], 1 << 60)
        return known

    def made(self, token: bytes) -> bool:
        return token in self.ids and (len(token) == 1 or self.split(token) is not None)


class Prefixes:
    """A byte string's table of last tokens: last[i] is the id of the token that ends the encoding of the first i bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[int] = [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Adds bytes at the end. Tokens that reach over the old end begin less than the longest token before it."""
        old = len(self.data)
        self.data += data
        self.last += [-1] * len(data)
        self._fill(max(0, old - self.vocabulary.longest + 1))

    def replace(self, begin: int, end: int, data: bytes) -> int:
        """Puts data in the place of the bytes from begin to end. What stands before begin is not encoded again, nor what stands behind the place where old and new tables agree over more
        than the longest token: the table goes on from there as it was. Gives that place."""
        old = self.last[end + 1 :]
        self.data = self.data[:begin] + data + self.data[end:]
        self.last[begin + 1 :] = [-1] * (len(self.data) - begin)
        return self._fill(max(0, begin - self.vocabulary.longest + 1), begin + len(data), old)

    def _fill(self, first: int, edited: int | None = None, old: list[int] | None = None) -> int:
        """Fills in the places of the table that are -1, from tokens that begin at `first` or later. old: what the table had behind the place `edited`."""
        v, text, last = self.vocabulary, self.data, self.last
        trie, fits, follows, shift, size, agreed = v.trie, v.fits, v.follows, v.shift, len(self.data), 0
        for begin in range(first, size):
            node, end, left = trie, begin, last[begin] << shift
            while end < size and (node := node.get(text[end])) is not None:
                end += 1
                if last[end] < 0 and (token := node.get(ID)) is not None:
                    if not begin or (fits[pair] if (pair := left | token) in fits else follows(left >> shift, token)):
                        last[end] = token
            if last[begin + 1] < 0:
                raise ValueError(f"no token for {text[begin : begin + 1]!r}")
            if old is not None and begin >= edited:
                agreed = agreed + 1 if last[begin + 1] == old[begin - edited] else 0
                if agreed > v.longest:
                    last[begin + 2 :] = old[begin + 1 - edited :]
                    return begin + 1
        return size

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first `end` bytes."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(token := self.last[at])
            at -= len(self.vocabulary.bytes[token])
        return out[::-1]

    def counts(self) -> list[int]:
        """The number of tokens of each prefix, the empty one first."""
        out = [0]
        for i, n in enumerate(self.lengths()[1:], 1):
            out.append(out[i - n] + 1)
        return out

    def lengths(self) -> list[int]:
        """The bytes of the token that ends each prefix's encoding, 0 for the empty one."""
        size = self.vocabulary.sizes
        return [0, *(size[t] for t in self.last[1:])]

    def within(self, budget: int) -> int:
        """The longest prefix, in bytes, such that it and all shorter ones have no more than `budget` tokens."""
        return next((i - 1 for i, n in enumerate(self.counts()) if n > budget), len(self.data))


class Remembered(dict):
    """What `make` gives for a string, remembered for the next time. When the memory is full it becomes the older one, from which what is asked for again comes back."""

    def __init__(self, make: Callable, limit: int = REMEMBERED):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, asked: str):
        if (made := self.older.get(asked)) is None:
            made = self.make(asked)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        if len(asked) <= 64:
            self[asked] = made
        return made


class Encoder:
    """Encodes texts: the pattern's pieces by Prefixes, each text's chunks by what is remembered of them."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"(?!\S)", rf"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]"))
        self.known = Remembered(self.piece_ids, PIECES)
        self.lengths = Remembered(lambda piece: Prefixes(vocabulary, piece.encode()).lengths()[1:], LENGTHS)

    def piece_ids(self, piece: str) -> bytes:
        """The ids of a piece, packed as little-endian unsigned 32-bit integers."""
        v, data = self.vocabulary, piece.encode()
        ids = [v.ids[data]] if v.made(data) else Prefixes(v, data).ids()  # the whole piece may be one token
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, chunk: str) -> bytes:
        return b"".join([self.known[piece] for piece in self.pieces.findall(chunk)])

    def table(self, chunk: str) -> tuple:
        """Of each prefix of a chunk's bytes, the empty one first: the number of its tokens, and the bytes of its last token. A prefix that ends in a piece counts as the pieces before it and the part of that one."""
        counts, lengths = [0], [0]
        for piece in self.pieces.findall(chunk):
            own = self.lengths[piece]
            for n in own:
                counts.append(counts[-n] + 1)
            lengths += own
        return (bytes(counts), bytes(lengths)) if len(counts) <= 256 else (array("I", counts), array("I", lengths))

    def chunk_ids(self, chunk: str) -> list[int]:
        data = self.packed(chunk)
        return list(struct.unpack(f"<{len(data) // 4}I", data))

    def ids(self, text: str) -> list[int]:
        return [i for c in CHUNK.findall(text) for i in self.chunk_ids(c)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


class Text:
    """A text that is appended to and edited: its chunks, of which only those near a change are cut and encoded again."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.chunks = encoder, CHUNK.findall(text)

    def __str__(self) -> str:
        return "".join(self.chunks)

    def ids(self) -> list[int]:
        return [i for c in self.chunks for i in self.encoder.chunk_ids(c)]

    def append(self, text: str) -> None:
        n = sum(map(len, self.chunks))
        self.replace(n, n, text)

    def replace(self, begin: int, end: int, text: str) -> tuple[int, int]:
        """Puts text in the place of the characters from begin to end. Gives the numbers of the first chunk cut anew and of the one behind the last.

        Where a chunk ends depends on what stands before the next one's first two characters, so cutting starts two chunks before the change. It ends at the first place behind the change where a chunk ended before too, as
        from there on both cuts go on alike.
        """
        ends = list(itertools.accumulate(map(len, self.chunks)))
        first = max(0, bisect.bisect_left(ends, begin) - 1)
        start = ends[first - 1] if first else 0
        after = bisect.bisect_left(ends, end)  # the chunks up to this one may be changed
        old = "".join(self.chunks[first : after + 1])
        new, stop, at = old[: begin - start] + text + old[end - start :], after + 1, 0
        made: list[str] = []
        behind = begin - start + len(text)
        while True:
            rest = "".join(self.chunks[stop : stop + 2])
            made, at, ended = [], 0, None
            known = {e - start - (end - begin) + len(text): k + 1 for k, e in enumerate(ends[after:stop], after)}
            for m in CHUNK.finditer(new + rest):
                made.append(m[0])
                at = m.end()
                if at >= behind and at in known and (at < len(new + rest) or stop >= len(self.chunks)):
                    ended = known[at]
                    break
            if ended is not None or stop >= len(self.chunks):
                ended = len(self.chunks) if ended is None else ended
                break
            new, stop = new + rest, stop + 2
        self.chunks[first:ended] = made
        return first, first + len(made)


@functools.cache
def rank_encoder(path: str, pattern: str) -> Encoder:
    """Of a file of ranks: base64 of a token's bytes, its rank, which is its id too."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Encoder(Vocabulary(ranks, ranks), pattern)


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in the .json vocabularies: printable ones for themselves, others for the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@functools.cache
def json_encoder(path: str, pattern: str) -> tuple[Encoder, dict[str, int]]:
    """Of a tokenizers file with byte-level BPE: the encoder, and the added tokens, which are matched in texts before all else."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    of = byte_characters()
    raw = lambda s: bytes(of[c] for c in s)
    tokens = {raw(t): i for t, i in model["model"]["vocab"].items() if all(c in of for c in t)}
    ranks = {t: -1 for t in tokens if len(t) == 1}
    for rank, merge in enumerate(model["model"]["merges"]):
        ranks[raw("".join(merge.split(" ") if isinstance(merge, str) else merge))] = rank
    return Encoder(Vocabulary(tokens, ranks), pattern), {t["content"]: t["id"] for t in model["added_tokens"]}
