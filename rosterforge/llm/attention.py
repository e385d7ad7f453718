"""A small causal self-attention model of symbols in numpy: scores of blocks of positions, and their gradients.

A symbol is a byte, a frequent subword or a frequent pair of subwords. The next symbol's group of classes, and its class within the group, come from attention over the symbols so far, added to
the log shares that they have after the last symbol; within its class the symbol has the share that it has after the last symbol. So a position is normalised over the groups and over the classes of
one, not over all classes. Queries, keys and values are rows of tables by symbol, so a position costs some look-ups and the small products of attention itself.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import as_strided

#: The first OPENING classes hold the symbols that begin a word, and END; the others those that go on with one.
WIDTH, CLASSES, OPENING = 16, 256, 128
#: Classes are in PER groups of PER that follow each other, either all of opening classes or all of others. A choice is among groups (the first) or among the classes of a group.
PER = 16
CHOICES = 1 + CLASSES // PER
#: Positions are scored in blocks of STEP; a window is a block and the one before it, so windows overlap and each position is scored once.
STEP = 16
#: Blocks worked on at a time.
BATCH = 256
#: Positions of a part of a sequence that is learned from, a multiple of STEP, and of a step of learning.
LONGEST, POSITIONS = 512, 4096
#: Numbers of a table that a step changes at a time, few enough to stay in a core's cache.
CACHED = 8192
END, BYTES = 0, 256


@dataclass
class Model:
    """Tables of a model over n symbols: query, key, value (n x WIDTH), near (2 STEP, by distance), out (CHOICES x WIDTH x PER), and those fixed by counts:
    after (n x CHOICES x PER, log share of a group after a symbol, and of a class within its group), inside (n x n, log share of a symbol within its class after another) and classes (n)."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    near: np.ndarray
    out: np.ndarray
    after: np.ndarray
    inside: np.ndarray
    classes: np.ndarray

    LEARNED = ("query", "key", "value", "near", "out")

    def learned(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in self.LEARNED]


def start(after: np.ndarray, inside: np.ndarray, classes: np.ndarray, seed: int = 11) -> Model:
    """A model that says what the counts say, before it has learned anything."""
    rng, n = np.random.default_rng(seed), len(classes)
    table = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    near = -0.1 * np.arange(2 * STEP, dtype=np.float32)
    return Model(table(n, WIDTH), table(n, WIDTH), table(n, WIDTH), near, np.zeros((CHOICES, WIDTH, PER), np.float32), after, inside, classes)


#: From a query back to a key of its window; keys after the query are not seen.
DISTANCE = np.arange(STEP)[:, None] + STEP - np.arange(2 * STEP)[None, :]
HIDDEN = np.where(DISTANCE >= 0, 0, -1e9).astype(np.float32)


def blocks(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences of symbols, each of which begins with one that is not foretold: last symbols and next ones (-1: none) by block, which
    blocks begin a sequence, and the first block of each sequence."""
    counts = np.array([-(-(len(s) - 1) // STEP) for s in sequences])
    begins = np.cumsum(counts) - counts
    last, then = np.zeros(counts.sum() * STEP, np.intp), np.full(counts.sum() * STEP, -1, np.intp)
    for s, b in zip(sequences, (begins * STEP).tolist(), strict=True):
        last[b : b + len(s) - 1], then[b : b + len(s) - 1] = s[:-1], s[1:]
    first = np.zeros(counts.sum(), bool)
    first[begins[counts > 0]] = True
    return last.reshape(-1, STEP), then.reshape(-1, STEP), first, begins


class Room:
    """Memory that the steps of a task use again, by name: new pages for each step's tables would cost as much as the work done in them."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, dtype: np.dtype, *shape: int) -> np.ndarray:
        n, own = math.prod(shape), self.held.get(name)
        if own is None or len(own) < n or own.dtype != dtype:
            own = self.held[name] = np.empty(n + n // 4, dtype)
        return own[:n].reshape(shape)


#: Numbers of a block in a table by block, query and key of the window. So many that a block's keys lie at an even distance for all queries that see them, those of the block and of the next one.
CELLS = 2 * STEP * STEP + STEP


def by_query(table: np.ndarray, k: int) -> np.ndarray:
    """Of such a table, the first k blocks' queries by the keys of their window."""
    return as_strided(table, (k, STEP, 2 * STEP), (CELLS * table.itemsize, 2 * STEP * table.itemsize, table.itemsize))


def by_key(table: np.ndarray, k: int) -> np.ndarray:
    """Of such a table, the first k blocks' keys by the queries that see them; a block after these is read too."""
    return as_strided(table[STEP:], (k, STEP, 2 * STEP), (CELLS * table.itemsize, table.itemsize, 2 * STEP * table.itemsize))


def pairs_of(table: np.ndarray, k: int) -> np.ndarray:
    """Of rows by position, those of k blocks, each with the block after it."""
    return as_strided(table, (k, 2 * STEP, table.shape[1]), (STEP * table.strides[0], *table.strides))


def side_by_side(m: Model) -> np.ndarray:
    return np.concatenate([m.query, m.key, m.value], axis=1)


def attend(table: np.ndarray, near: np.ndarray, last: np.ndarray, first: np.ndarray, room: Room):
    """Attention of each block's positions over its window, the block before it and itself: the table of weights, not yet divided by their sums, their sums, what is read, and queries, keys and
    values by position, with an empty block before them and one after them."""
    k, dtype = len(last), table.dtype
    seen = room("seen", dtype, (k + 2) * STEP, 3 * WIDTH)
    seen[:STEP] = seen[-STEP:] = 0
    table.take(last.ravel(), axis=0, out=seen[STEP:-STEP], mode="clip")
    seen[:, :WIDTH] *= dtype.type(WIDTH**-0.5)
    cells = room("weights", dtype, (k + 1) * CELLS)
    cells[k * CELLS :] = 0
    by_block, weights, window = cells[: k * CELLS].reshape(k, CELLS), by_query(cells, k), pairs_of(seen, k)
    np.matmul(seen[STEP:-STEP, :WIDTH].reshape(k, STEP, WIDTH), window[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1), out=weights)
    by_block[:, -STEP:] = 0
    by_block += np.append(near[np.maximum(DISTANCE, 0)] + HIDDEN, np.zeros(STEP, near.dtype))
    np.minimum(by_block, 30, out=by_block)
    np.exp(by_block, out=by_block)
    weights[first, :, :STEP] = 0
    sums = rows(weights)
    read = np.matmul(weights, window[:, :, 2 * WIDTH :], out=room("read", dtype, k, STEP, WIDTH))
    read /= sums
    return cells, sums, read.reshape(-1, WIDTH), seen


def rows(table: np.ndarray) -> np.ndarray:
    """The sums of rows, as a column."""
    return table @ np.ones((table.shape[-1], 1), table.dtype)


def by_group(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The order of positions by the groups of their classes, the classes in that order, and (choice, begin, end) of each group that is there."""
    order = np.argsort((classes // PER).astype(np.uint8), kind="stable")
    classes = classes[order]
    ends = np.searchsorted(classes // PER, np.arange(CHOICES))
    return order, classes, [(k, a, b) for k, (a, b) in enumerate(itertools.pairwise(ends.tolist()), 1) if b > a]


def logits(m: Model, flat: np.ndarray, x: np.ndarray, own: np.ndarray, there: list[tuple[int, int, int]], room: Room | None = None) -> np.ndarray:
    """Of positions by group: those of all groups, and those of the classes of its own. flat: what attention reads, x: last symbols, own: classes."""
    after = m.after.reshape(-1, PER)
    at = x * CHOICES
    made = (room or Room())("logits", flat.dtype, 2, len(flat), PER)
    np.matmul(flat, m.out[0], out=made[0])
    made[0] += after.take(at, axis=0)
    at += own // PER + 1
    for k, a, b in there:
        np.matmul(flat[a:b], m.out[k], out=made[1, a:b])
    made[1] += after.take(at, axis=0)
    return made


def chosen(own: np.ndarray) -> np.ndarray:
    """Where a table of logits has those of each position's own group and class."""
    at = np.arange(2 * len(own)) * PER
    at[: len(own)] += own // PER
    at[len(own) :] += own % PER
    return at


def scored(m: Model, last: np.ndarray, then: np.ndarray, first: np.ndarray, room: Room | None = None) -> np.ndarray:
    """Log probability of the next symbol, by block and position; without meaning where there is none."""
    out, room, table = np.zeros(last.shape), room or Room(), side_by_side(m)
    for a in range(0, len(last), BATCH):
        # one block more than are scored, to be looked back at
        z, back = min(a + BATCH, len(last)), min(a, 1)
        flat = attend(table, m.near, last[a - back : z], first[a - back : z], room)[2][back * STEP :]
        y = np.maximum(then[a:z].ravel(), 0)
        order, own, there = by_group(m.classes[y])
        x, y = last[a:z].ravel()[order], y[order]
        both = logits(m, flat.take(order, axis=0), x, own, there, room)
        p = both.ravel()[chosen(own)].reshape(2, -1).sum(axis=0) + m.inside[x, y]
        p -= np.log(rows(np.exp(both, out=both)).prod(axis=0))[:, 0]
        out[a:z].reshape(-1)[order] = p
    return out


def gradients(m: Model, last: np.ndarray, then: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of the mean negative log probability of groups and classes, by LEARNED."""
    tables, *others = steps(m, side_by_side(m), last, then, first, Room())
    return [*np.split(tables, 3, axis=1), *others]


def steps(m: Model, table: np.ndarray, last: np.ndarray, then: np.ndarray, first: np.ndarray, room: Room) -> list[np.ndarray]:
    """gradients(), with query, key and value side by side in a table, and their gradients likewise."""
    k, dtype = len(last), table.dtype
    cells, sums, flat, seen = attend(table, m.near, last, first, room)
    x, y = last.ravel(), then.ravel()
    order, own, there = by_group(m.classes[np.maximum(y, 0)])
    none, share = np.flatnonzero(y[order] < 0), dtype.type(1 / max(1, int((y >= 0).sum())))
    ordered = flat.take(order, axis=0, out=room("ordered", dtype, *flat.shape), mode="clip")
    both = logits(m, ordered, x[order], own, there, room)
    np.exp(both, out=both)
    both *= share / rows(both)
    both.reshape(-1)[chosen(own)] -= share
    both[:, none] = 0
    d_out = np.zeros_like(m.out)
    np.matmul(ordered.T, both[0], out=d_out[0])
    d_ordered = np.matmul(both[0], m.out[0].T, out=room("d_ordered", dtype, *flat.shape))
    for g, a, b in there:
        np.matmul(ordered[a:b].T, both[1, a:b], out=d_out[g])
        d_ordered[a:b] += both[1, a:b] @ m.out[g].T
    d_read = room("d_read", dtype, (k + 1) * STEP, WIDTH)
    d_read[-STEP:] = 0
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    d_flat = d_ordered.take(back, axis=0, out=d_read[:-STEP], mode="clip")
    d_flat /= sums.reshape(-1, 1)
    d_cells = room("d_weights", dtype, (k + 1) * CELLS)
    d_cells[k * CELLS :] = 0
    d_cells[: k * CELLS].reshape(k, CELLS)[:, -STEP:] = 0
    d_scores, window = by_query(d_cells, k), pairs_of(seen, k)
    np.matmul(d_flat.reshape(k, STEP, WIDTH), window[:, :, 2 * WIDTH :].transpose(0, 2, 1), out=d_scores)
    d_scores -= np.einsum("ij,ij->i", d_flat, flat).reshape(k, STEP, 1)
    d_cells *= cells
    by_position = room("by_position", dtype, k, STEP, 3 * WIDTH)
    np.matmul(d_scores, window[:, :, WIDTH : 2 * WIDTH], out=by_position[:, :, :WIDTH])
    # a block's keys are those of the next block's window too, unless that begins a sequence: its weights are 0 then
    np.matmul(by_key(d_cells, k), pairs_of(seen[STEP:], k)[:, :, :WIDTH], out=by_position[:, :, WIDTH : 2 * WIDTH])
    np.matmul(by_key(cells, k), pairs_of(d_read, k), out=by_position[:, :, 2 * WIDTH :])
    by_symbol = np.argsort(x.astype(np.uint16) if len(table) <= 1 << 16 else x, kind="stable")
    x = x[by_symbol]
    begins = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    sorted_ = by_position.reshape(-1, 3 * WIDTH).take(by_symbol, axis=0, out=room("by_symbol", dtype, k * STEP, 3 * WIDTH), mode="clip")
    tables = room("d_tables", dtype, *table.shape)
    tables[:] = 0
    tables[x[begins]] = np.add.reduceat(sorted_, begins)
    tables[:, :WIDTH] *= dtype.type(WIDTH**-0.5)
    near = np.bincount(np.maximum(DISTANCE, 0).ravel(), weights=d_scores.sum(axis=0).ravel(), minlength=2 * STEP).astype(np.float32)
    return [tables, near, d_out]


def pieces(sequence: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, bool]]:
    """Parts of a sequence that together foretell each of its symbols once, and whether the part's first block is only there to be looked back at: blocks and windows are those of the whole sequence."""
    for a in range(0, len(sequence) - 1, longest):
        yield sequence[max(0, a - STEP) : a + longest + 1], a > 0


def gathered(parts: Iterable[tuple[np.ndarray, bool]], positions: int = POSITIONS) -> Iterator[list[tuple[np.ndarray, bool]]]:
    """The parts in lists of at least so many positions, but for the last."""
    own, n = [], 0
    for part in parts:
        own.append(part)
        n += len(part[0])
        if n >= positions:
            yield own
            own, n = [], 0
    if own:
        yield own


def descend(m: Model, batches: Iterable[list[tuple[np.ndarray, bool]]], rate: float) -> None:
    """One step of Adam for each batch of parts."""
    together = side_by_side(m)
    m.query, m.key, m.value = np.split(together, 3, axis=1)
    flat, room = [t.reshape(-1) for t in (together, m.near, m.out)], Room()
    moments = [[np.zeros_like(t), np.zeros_like(t)] for t in flat]
    for step, parts in enumerate(batches, 1):
        last, then, first, begins = blocks([s for s, _ in parts])
        then[begins[[goes_on for _, goes_on in parts]]] = -1
        for whole, gradient, both in zip(flat, steps(m, together, last, then, first, room), moments, strict=True):
            gradient = gradient.reshape(-1)
            for a in range(0, len(whole), CACHED):
                t, g, one, two = (x[a : a + CACHED] for x in (whole, gradient, *both))
                by = g * g
                by *= 0.01
                two *= 0.99
                two += by
                g *= 0.1
                one *= 0.9
                one += g
                np.sqrt(two, out=by)
                by *= (1 - 0.99**step) ** -0.5
                by += 1e-8
                np.divide(one, by, out=by)
                by *= rate / (1 - 0.9**step)
                t -= by


def learn(m: Model, sequences: list[np.ndarray], rate: float, batch: int = 16) -> None:
    """One pass of Adam over sequences."""
    descend(m, ([(s, False) for s in sequences[a : a + batch]] for a in range(0, len(sequences), batch)), rate)
