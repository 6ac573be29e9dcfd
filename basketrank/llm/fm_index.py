"""A two-way FM index over a delimited vocabulary, searched with one error.

The vocabulary is written as ``$w1$w2$...$`` with its words in code-point order. A
direction of the index holds the Burrows-Wheeler transform of that text, so a
pattern is matched from its end, one character a step, and stands for an interval
of suffix ranks. ``$`` sorts first and like the word behind it, so the interval of a
whole word ``$w$`` is the number of the word.

The index has two directions, one over the words and one over the reversed words. A
search scheme for one error needs both: the right half is matched exactly and then
extended to the left with the error in the left half, and the other way round. No
search turns round after it began, so each keeps the interval of its own direction.

Steps are done for all patterns at once with NumPy.
"""

from __future__ import annotations

import numpy as np

#: Patterns searched at a time; bounds the memory of the branches.
PATTERNS = 16_384


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters in a row, and where each word starts (with the end as last)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return flat, np.concatenate([[0], ends])


class Direction:
    """One direction of the index; ``words`` are distinct and sorted."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        flat, self.starts = code_points(words)
        self.alphabet = np.unique(flat)
        self.letters = np.searchsorted(self.alphabet, flat) + 1
        self.sigma = len(self.alphabet)
        size = len(flat) + self.n + 1
        text = np.zeros(size, np.int64)
        text[np.arange(len(flat)) + np.repeat(np.arange(self.n), np.diff(self.starts)) + 1] = self.letters
        order = self._suffix_order(text)
        before = text[order - 1]
        # Nothing stands before the first delimiter.
        before[order == 0] = self.sigma + 1
        self.before = before.astype(np.uint16)
        rows = np.argsort(self.before, kind="stable")
        self.size = size
        self.keys = self.before[rows].astype(np.int64) * (size + 1) + rows

    def _suffix_order(self, text: np.ndarray) -> np.ndarray:
        """Ranks by doubling; every delimiter has a rank of its own, so suffixes are told apart there."""
        ends = text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text + self.n)
        step = 1
        while True:
            behind = np.zeros_like(rank)
            behind[:-step] = rank[step:] + 1
            key = rank * (int(behind.max()) + 1) + behind
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            if new[-1] == len(text) - 1:
                return order
            rank = np.empty_like(rank)
            rank[order] = new
            step *= 2

    def extend(self, char: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Bound of the interval of ``char`` + pattern from a bound of the pattern's."""
        return np.searchsorted(self.keys, char * (self.size + 1) + rank) + (char > 0)

    def codes(self, flat: np.ndarray) -> np.ndarray:
        """Codes of characters; one that no word has gets a code that never matches."""
        at = np.minimum(np.searchsorted(self.alphabet, flat), max(0, self.sigma - 1))
        known = self.alphabet[at] == flat if self.sigma else np.zeros(len(flat), bool)
        return np.where(known, at + 1, self.sigma + 2)

    def branches(self, lo: np.ndarray, hi: np.ndarray):
        """(state, letter, lo, hi): all letters that can stand before each interval."""
        narrow = np.flatnonzero(hi - lo <= self.sigma)
        widths = (hi - lo)[narrow]
        state = np.repeat(narrow, widths)
        skipped = np.repeat(np.cumsum(widths) - widths, widths)
        letter = self.before[np.repeat(lo[narrow], widths) + np.arange(len(state)) - skipped].astype(np.int64)
        pairs = np.unique(state * (self.sigma + 2) + letter)
        state, letter = pairs // (self.sigma + 2), pairs % (self.sigma + 2)
        real = (letter > 0) & (letter <= self.sigma)
        wide = np.flatnonzero(hi - lo > self.sigma)
        state = np.concatenate([state[real], np.repeat(wide, self.sigma)])
        letter = np.concatenate([letter[real], np.tile(np.arange(1, self.sigma + 1), len(wide))])
        low, high = self.extend(letter, lo[state]), self.extend(letter, hi[state])
        some = low < high
        return state[some], letter[some], low[some], high[some]

    def one_error(self, patterns: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) numbers of all words one insertion, deletion or replacement away.

        The last ``exact`` characters of a pattern are matched as they are; the
        error is in what stands before them. Pairs are distinct and sorted.
        """
        found = [
            self._search(patterns[i : i + PATTERNS], exact[i : i + PATTERNS], i)
            for i in range(0, len(patterns), PATTERNS)
        ]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(part) for part in zip(*found))

    def _search(self, patterns: list[str], exact: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        flat, starts = code_points(patterns)
        codes = self.codes(flat)
        who = np.arange(len(patterns))
        lo = np.zeros(len(who), np.int64)
        hi = np.full(len(who), self.n + 1, np.int64)
        for step in range(int(exact.max(initial=0))):
            go = np.flatnonzero(step < exact[who])
            char = codes[starts[who[go] + 1] - 1 - step]
            lo[go], hi[go] = self.extend(char, lo[go]), self.extend(char, hi[go])
            keep = lo < hi
            who, lo, hi = who[keep], lo[keep], hi[keep]
        # Pattern, place of the next character (below 0: all are matched), interval.
        clean = (who, np.diff(starts)[who] - exact[who] - 1, lo, hi)
        erred = tuple(np.zeros(0, np.int64) for _ in range(4))
        hits: list[np.ndarray] = []
        while len(clean[0]) or len(erred[0]):
            who, place, lo, hi = erred
            # An empty place is a word's start, where only a delimiter may follow.
            at_start = place < 0
            char = np.where(at_start, 0, codes[starts[who] + np.maximum(place, 0)])
            lo, hi = self.extend(char, lo), self.extend(char, hi)
            some = lo < hi
            done = some & at_start
            hits.append(who[done] * self.n + lo[done])
            on = some & ~at_start
            states = [(who[on], place[on] - 1, lo[on], hi[on])]
            if len(clean[0]):
                who, place, lo, hi = clean
                inside = place >= 0
                char = np.where(inside, codes[starts[who] + np.maximum(place, 0)], -1)
                state, letter, low, high = self.branches(lo, hi)
                states.append((who[state], place[state], low, high))  # an inserted letter
                states.append((who[inside], place[inside] - 1, lo[inside], hi[inside]))  # a missing one
                same = letter == char[state]
                other = ~same & inside[state]
                states.append((who[state[other]], place[state[other]] - 1, low[other], high[other]))
                clean = (who[state[same]], place[state[same]] - 1, low[same], high[same])
            erred = tuple(np.concatenate(part) for part in zip(*states))
        pairs = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        return pairs // max(1, self.n) + first, pairs % max(1, self.n)


class TwoWayIndex:
    """Both directions over a vocabulary; ``words`` are distinct and sorted."""

    def __init__(self, words: list[str], left: bool = True, right: bool = True):
        """``left`` and ``right`` say which halves will be matched exactly."""
        self.words = words
        self.forward = Direction(words) if right else None
        self.backward = None
        if left:
            turned = [w[::-1] for w in words]
            self.turned_order = np.array(sorted(range(len(words)), key=turned.__getitem__), np.int64)
            self.backward = Direction([turned[i] for i in self.turned_order])

    def by_left_half(self, patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (pattern, word) whose first ``len // 2`` characters agree, one error behind them."""
        exact = np.array([len(p) // 2 for p in patterns], np.int64)
        who, word = self.backward.one_error([p[::-1] for p in patterns], exact)
        return who, self.turned_order[word]

    def by_right_half(self, patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that agree on the other characters, one error before them; none of
        those that :meth:`by_left_half` gives."""
        exact = np.array([len(p) - len(p) // 2 for p in patterns], np.int64)
        who, word = self.forward.one_error(patterns, exact)
        flat, starts = code_points(patterns)
        codes = self.forward.codes(flat)
        half = np.diff(starts)[who] // 2
        room = np.diff(self.forward.starts)[word]
        alike = np.flatnonzero(room >= half)
        for step in range(int(half.max(initial=0))):
            left = step < half[alike]
            same = np.ones(len(alike), bool)
            a = alike[left]
            same[left] = codes[starts[who[a]] + step] == self.forward.letters[self.forward.starts[word[a]] + step]
            alike = alike[same]
        keep = np.ones(len(who), bool)
        keep[alike] = False
        return who[keep], word[keep]
