"""Merges of adjacent symbols in the order of their scores, by an agenda of symbol pairs.

The best pair of the agenda (the smallest rank, the leftmost of equals) is merged, and its
two neighbours enter the agenda anew, until no pair of the vocabulary is left. Words of up
to ``WIDE`` symbols have their agendas side by side as rows of a matrix, so that a step
merges one pair of every word; a longer word has a heap, whose work grows with its length
times the logarithm of it.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

#: the rank of a pair that does not merge
NONE = np.int32(2_147_483_647)
#: symbols of a word in the matrix, by steps so that short words take narrow rows
WIDTHS = (8, 16, 32, 64)
WIDE = WIDTHS[-1]
#: words in one matrix, which bounds its memory
ROWS = 50_000
_mixer = np.uint64(0x9E3779B97F4A7C15)


class Agenda:
    """Pairs of symbols that merge: what they become, and their rank.

    Symbols are numbers from 0; those from ``symbols`` on merge with nothing.
    """

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        """``pairs`` names the rank and the merged symbol of each (left, right)."""
        self.pairs = pairs
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        ranks = np.array([r for r, _ in pairs.values()], np.int32)
        made = np.array([m for _, m in pairs.values()], np.int32)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        self.made = np.full(1 << bits, -1, np.int32)
        rest, at = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            # of the keys that want one free slot the first gets it, the others move on
            _, first = np.unique(at[rest], return_index=True)
            placed = rest[first][self.slots[at[rest[first]]] < 0]
            self.slots[at[placed]] = keys[placed]
            self.ranks[at[placed]], self.made[at[placed]] = ranks[placed], made[placed]
            rest = rest[self.slots[at[rest]] != keys[rest]]
            at[rest] = (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _mixer) >> self.shift).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged symbols of pairs; a negative symbol merges with nothing."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -1
        at = self._slot(keys)
        seen = self.slots[at]
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while todo.size:
            at[todo] = (at[todo] + 1) & self.mask
            seen = self.slots[at[todo]]
            todo = todo[(seen != keys[todo]) & (seen >= 0)]
        hit = self.slots[at] == keys
        return np.where(hit & (keys >= 0), self.ranks[at], NONE), self.made[at]

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words ``symbols``, of ``sizes`` symbols each, fully merged: symbols and sizes."""
        begins = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        counts = np.zeros(len(sizes), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            for i in range(0, len(rows), ROWS):
                some = rows[i:i + ROWS]
                cells = np.arange(width)
                filled = cells < sizes[some, None]
                matrix = np.full((len(some), width + 1), -1, np.int32)
                matrix[:, :width][filled] = symbols[(begins[some, None] + cells)[filled]]
                left = self._merge_rows(matrix)
                counts[some] = (left >= 0).sum(1)
                parts.append((some, left[left >= 0]))
            low = width
        for row in np.flatnonzero(sizes > WIDE):
            one = np.array(self.merge_one(symbols[begins[row]:begins[row + 1]].tolist()), np.int32)
            counts[row] = len(one)
            parts.append((np.array([row]), one))
        ends = np.cumsum(counts)
        merged = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for some, found in parts:
            merged[ragged(ends[some] - counts[some], counts[some])] = found
        return merged, counts

    def _merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols with an empty last cell; what a merge swallows becomes -1.

        Cells are addressed by their place in the flat matrix. Left of a row lies the last
        cell of the row above, which is empty, so no border needs a test.
        """
        n, width = symbols.shape
        flat = symbols.reshape(-1)
        flat_ranks, flat_made = self.look(flat, np.roll(flat, -1))
        ranks = flat_ranks.reshape(n, width)
        after = np.arange(1, n * width + 1)
        before = np.arange(-1, n * width - 1)
        rows = np.arange(n)
        while rows.size:
            at = rows * width + ranks[rows].argmin(1)
            going = flat_ranks[at] < NONE
            rows, at = rows[going], at[going]
            gone = after[at]
            flat[at] = flat_made[at]
            flat[gone], flat_ranks[gone] = -1, NONE
            after[at] = following = after[gone]
            before[following % len(before)] = at
            flat_ranks[at], flat_made[at] = self.look(flat[at], flat[following % len(flat)])
            back = before[at]
            flat_ranks[back], flat_made[back] = self.look(flat[back], flat[at])
        return symbols

    def merge_one(self, symbols: list[int]) -> list[int]:
        """One word of any length, by a heap."""
        pairs, n = self.pairs, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(*pairs[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in pairs]
        agenda = [(rank, i, made, p) for rank, made, i, p in agenda]
        heapify(agenda)
        while agenda:
            _, i, made, pair = heappop(agenda)
            j = after[i]
            if j >= n or (symbols[i], symbols[j]) != pair:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (pair := (symbols[left], symbols[right])) in pairs:
                    rank, made = pairs[pair]
                    heappush(agenda, (rank, left, made, pair))
        return [s for s in symbols if s >= 0]


def ragged(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places begins[i], begins[i] + 1, ..., ``counts[i]`` of them, for each i in turn."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begins - ends + counts, counts) + np.arange(total)
