"""Similar sets among a bounded number of sets, by a signature tree.

Every set has a bitmap of its tokens. A node holds the OR of the bitmaps below it
and the least and largest size below it. Two nodes are traversed together: the
pair is dropped when the bits that their ORs share allow too small an overlap for
the smallest sizes below them, when the size ranges are too far apart, or when
all sets below are known to belong together.

``similar_pairs`` and ``linked`` have the sets themselves: a column per token that two
of them hold makes bitmaps exact, and the bottom of the tree decides. Where such
bitmaps would take more than ``BITMAP_BYTES``, columns share bits, and the pairs found
are counted. ``possible_pairs`` has hashed bitmaps only. Wherever bits are shared,
tokens that fell on a taken bit are counted, and the bound grows by the smaller
count of the two sides, so that no similar pair is lost.

Node pairs are traversed depth first, in steps bounded by bytes, so memory follows
the bitmaps and not the number of open pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 8
#: Node pairs that are opened at a time, and bytes of bitmaps compared in one step.
STEP = 1 << 12
STEP_BYTES = 1 << 21
#: Bytes of all bitmaps at the bottom of a tree of exact bitmaps.
BITMAP_BYTES = 1 << 26


def needed(na, nb, percent: int):
    """Least overlap of sets of these sizes that are ``percent`` similar."""
    return -(-percent * (na + nb) // (100 + percent))


def bitmaps(sets: list[np.ndarray], most_bytes: int | None = None) -> tuple[np.ndarray, bool]:
    """One row of 64-bit words per set, and whether every shared token has a bit of its own."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts >= 2
    number = np.cumsum(shared) - 1
    keep = shared[place]
    column = number[place[keep]]
    row = np.repeat(np.arange(len(sets)), lengths)[keep]
    words = max(1, -(-int(shared.sum()) // 64))
    most = max(1, (BITMAP_BYTES if most_bytes is None else most_bytes) // (8 * len(sets)))
    exact = words <= most
    if not exact:
        words = most
        column = column % (words * 64)
    out = np.zeros((len(sets), words * 8), np.uint8)
    np.bitwise_or.at(out, (row, column >> 3), np.uint8(1) << (column & 7).astype(np.uint8))
    return out.view(np.uint64), exact


class Level:
    """Nodes of one level: OR of bitmaps, size range, tokens without a bit of their own, range of groups."""

    def __init__(self, bits, low, high, extra, first, last):
        self.bits, self.low, self.high, self.extra = bits, low, high, extra
        self.first, self.last = first, last

    def above(self) -> Level:
        starts = np.arange(0, len(self.low), FAN)
        return Level(
            np.bitwise_or.reduceat(self.bits, starts, axis=0),
            np.minimum.reduceat(self.low, starts),
            np.maximum.reduceat(self.high, starts),
            np.maximum.reduceat(self.extra, starts),
            np.minimum.reduceat(self.first, starts),
            np.maximum.reduceat(self.last, starts),
        )

    def possible(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Where sets below nodes ``a`` and ``b`` can be similar and are not known to be linked."""
        ok = (100 * self.high[a] >= percent * self.low[b]) & (100 * self.high[b] >= percent * self.low[a])
        known = (self.first[a] == self.last[a]) & (self.first[b] == self.last[b]) & (self.first[a] == self.first[b])
        at = np.flatnonzero(ok & ~known)
        a, b = a[at], b[at]
        share = np.minimum(self.extra[a], self.extra[b])
        step = max(1, STEP_BYTES // self.bits[:1].nbytes)
        for lo in range(0, len(a), step):
            some = slice(lo, lo + step)
            both = self.bits[a[some]]
            both &= self.bits[b[some]]
            share[some] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        return at[share >= needed(self.low[a], self.low[b], percent)]


class Tree:
    """All levels over a bottom level."""

    def __init__(self, bottom: Level):
        self.levels = [bottom]
        while len(self.levels[-1].low) > FAN:
            self.levels.append(self.levels[-1].above())

    def regroup(self, groups: np.ndarray) -> None:
        """Set the groups of the sets at the bottom, while a traversal is under way."""
        first = last = groups
        for level in self.levels:
            level.first, level.last = first, last
            starts = np.arange(0, len(first), FAN)
            first, last = np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts)

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs a < b of different groups at the bottom that pass every bound, a step at a time."""
        bottom = self.levels[0]
        a, b = np.triu_indices(len(self.levels[-1].low))
        waiting = [(len(self.levels) - 1, a, b)]
        step = np.arange(FAN)
        while waiting:
            depth, a, b = waiting.pop()
            if len(a) > STEP:
                waiting.append((depth, a[STEP:], b[STEP:]))
                a, b = a[:STEP], b[:STEP]
            kept = self.levels[depth].possible(a, b, percent)
            a, b = a[kept], b[kept]
            if depth:
                below = len(self.levels[depth - 1].low)
                a = (a[:, None, None] * FAN + step[None, :, None] + np.zeros((1, 1, FAN), np.int64)).ravel()
                b = (b[:, None, None] * FAN + step[None, None, :] + np.zeros((1, FAN, 1), np.int64)).ravel()
                fine = (a < below) & (b < below) & (a <= b)
                if fine.any():
                    waiting.append((depth - 1, a[fine], b[fine]))
                continue
            fine = (a < b) & (bottom.first[a] != bottom.first[b]) & (bottom.low[a] > 0)
            if fine.any():
                yield a[fine], b[fine]


class _Sets:
    """Sets in the order of their tree."""

    def __init__(self, sets: list[np.ndarray], groups: np.ndarray, percent: int, most_bytes: int | None):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.order = np.lexsort((self.sizes, groups))
        self.sets, self.percent = sets, percent
        own, self.groups = self.sizes[self.order], groups[self.order]
        bits, self.exact = bitmaps([sets[i] for i in self.order], most_bytes)
        # At the bottom low is the size; with exact bits, what is left reaches the needed overlap.
        extra = np.zeros_like(own) if self.exact else own - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.tree = Tree(Level(bits, own, own, extra, self.groups, self.groups))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index arrays of similar pairs, a step at a time."""
        for a, b in self.tree.pairs(self.percent):
            a, b = self.order[a], self.order[b]
            if not self.exact:
                found = [
                    len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))
                    for x, y in zip(a.tolist(), b.tolist())
                ]
                fine = np.array(found) >= needed(self.sizes[a], self.sizes[b], self.percent)
                a, b = a[fine], b[fine]
            yield a, b


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.empty(0, np.int64)
    return np.concatenate([none, *[p[0] for p in parts]]), np.concatenate([none, *[p[1] for p in parts]])


def similar_pairs(
    sets: list[np.ndarray], groups: np.ndarray, percent: int, most_bytes: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Index arrays (a, b) of all pairs of different groups that are at least ``percent`` similar.

    Similar means 100 * overlap >= percent * union; empty sets are similar to nothing.
    """
    return _joined(list(_Sets(sets, groups, percent, most_bytes).pairs()))


def linked(
    sets: list[np.ndarray], groups: np.ndarray, percent: int, most_bytes: int | None = None
) -> np.ndarray:
    """For every group 0, 1, ... the smallest group that links of its sets lead to.

    Pairs of sets that are linked by now are not looked at again, so a large set of
    near copies does not take all its pairs.
    """
    root = np.arange(int(groups.max(initial=-1)) + 1)
    some = _Sets(sets, groups, percent, most_bytes)
    for a, b in some.pairs():
        changed = False
        for x, y in np.unique(np.sort(np.stack([root[groups[a]], root[groups[b]]], axis=1), axis=1), axis=0).tolist():
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                changed = True
        while changed and (root[root] != root).any():
            root = root[root]
        if changed:
            some.tree.regroup(root[some.groups])
    return root


def signature(tokens: np.ndarray, per_token: int = 4) -> bytes:
    """Hashed bitmap of a set, of ``per_token`` to twice as many bits per token."""
    width = max(64, 1 << int(per_token * len(tokens)).bit_length())
    out = np.zeros(width >> 3, np.uint8)
    at = (tokens & np.uint64(width - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return out.tobytes()


def size_band(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Sizes of similar sets are in the same band or in neighbouring ones."""
    return np.floor(np.log(sizes) / max(np.log(100 / percent) * 1.0001, 1e-6)).astype(np.int64)


def possible_pairs(signatures: list[bytes], sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index arrays of pairs that may be ``percent`` similar, by their hashed bitmaps.

    Sizes are above 0. Sets are compared band by band, with bitmaps folded to the
    narrowest of the two bands.
    """
    bands = size_band(sizes, percent)
    out = []
    for band in np.unique(bands):
        some = np.flatnonzero((bands == band) | (bands == band + 1))
        some = some[np.argsort(sizes[some], kind="stable")]
        width = min(len(signatures[i]) for i in some)
        bits = np.stack(
            [np.bitwise_or.reduce(np.frombuffer(signatures[i], np.uint64).reshape(-1, width >> 3), axis=0) for i in some]
        )
        own = sizes[some]
        extra = own - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        each = np.arange(len(some))
        a, b = _joined(list(Tree(Level(bits, own, own, extra, each, each)).pairs(percent)))
        out.append(np.stack([some[a], some[b]]))
    a, b = np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1) if out else np.empty((2, 0), np.int64)
    return a, b
