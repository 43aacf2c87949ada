"""A run-compressed Burrows-Wheeler index with sampled run ends, and matching statistics over it.

The text is an array of small integers that consists of members, each closed by a symbol of its own.
The index keeps one entry for each run of the transform: its symbol, its start, how often the symbol
came before, and the text positions at its two ends. Patterns stream backwards, all of them together:
a step inside a run follows the last-to-first mapping; otherwise it goes on from the end of the run
before or the start of the run after, whichever shares the longer prefix with the present match.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class RunIndex:
    def __init__(self, text: np.ndarray):
        n = len(text)
        self.text = text.astype(np.int64)
        padded = np.concatenate([self.text + 1, np.zeros(4, dtype=np.int64)])
        width = int(padded.max()).bit_length()
        if 4 * width > 63:
            raise ValueError("too many symbols")
        keys = padded[:n]
        for i in range(1, 4):
            keys = keys << width | padded[i:i + n]
        # Prefix doubling: a rank is the first slot of its group, and only slots of groups not yet single are sorted again.
        slots, items, depth = np.arange(n), np.arange(n), 4
        order, rank, self.ranks = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64), []
        while True:
            by_key = np.argsort(keys)
            items, keys = items[by_key], keys[by_key]
            alike = np.concatenate([[False], keys[1:] == keys[:-1]])
            order[slots], rank[items] = items, slots[np.maximum.accumulate(np.where(alike, 0, np.arange(len(slots))))]
            shared = alike | np.append(alike[1:], False)
            slots, items = slots[shared], items[shared]
            if not len(slots):
                break
            self.ranks.append((depth, rank.astype(np.int32)))
            keys = rank[items] * (n + 1) + np.where(items + depth < n, rank[np.minimum(items + depth, n - 1)] + 1, 0)
            depth *= 2
        before = self.text[order - 1]  # the first position wraps to the last symbol
        starts = np.nonzero(np.concatenate([[True], before[1:] != before[:-1]]))[0]
        ends = np.append(starts[1:], n) - 1
        self.starts, self.heads, self.count = starts, before[starts], len(starts)
        self.at_start, self.at_end = order[starts], order[ends]
        self.ends = ends
        lengths = ends - starts + 1
        self.run_of = np.repeat(np.arange(self.count), lengths)
        by_symbol = np.argsort(self.heads, kind="stable")  # runs of a symbol in order, symbols in order
        total = np.cumsum(lengths[by_symbol]) - lengths[by_symbol]
        self.base = np.empty(self.count, dtype=np.int64)  # rank that the first row of the run maps to
        self.base[by_symbol] = total
        self.sorted_runs = self.heads[by_symbol] * self.count + by_symbol

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the common prefix of two suffixes; exact below `limit`, and no less than it otherwise."""
        n, total = len(self.text), np.zeros(len(a), dtype=np.int64)
        for depth, rank in reversed(self.ranks):
            at = np.nonzero(limit >= depth)[0]  # ranks beyond the limit are not needed
            if not len(at):
                continue
            x, y = a[at] + total[at], b[at] + total[at]
            same = (np.maximum(x, y) < n) & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]) & (x != y)
            total[at[same]] += depth
        for step in range(3):
            at = np.nonzero(limit > step)[0]
            x, y = a[at] + total[at], b[at] + total[at]
            same = (np.maximum(x, y) < n) & (self.text[np.minimum(x, n - 1)] == self.text[np.minimum(y, n - 1)])
            total[at[same]] += 1
        return total

    def _step(self, symbol: np.ndarray, at: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The matches one symbol further to the left."""
        run = self.run_of[at]
        off = np.nonzero(self.heads[run] != symbol)[0]
        if len(off):
            at, place, length = at.copy(), place.copy(), length.copy()
            wanted = symbol[off]
            high = np.searchsorted(self.sorted_runs, wanted * self.count + run[off])
            up, down = self.sorted_runs[np.maximum(high - 1, 0)], self.sorted_runs[np.minimum(high, self.count - 1)]
            has_up = (high > 0) & (up // self.count == wanted)
            has_down = (high < self.count) & (down // self.count == wanted)
            above, below = up % self.count, down % self.count
            up_end, down_end = self.at_end[above], self.at_start[below]
            # The longer common prefix is only looked for where both sides are there or something was matched.
            best_up, best_down = np.where(has_up, 0, -1), np.where(has_down, 0, -1)
            held = length[off] > 0
            ask_up, ask_down = np.nonzero(has_up & held)[0], np.nonzero(has_down & held)[0]
            pick = off[np.concatenate([ask_up, ask_down])]
            shares = self.common(place[pick], np.concatenate([up_end[ask_up], down_end[ask_down]]), length[pick])
            best_up[ask_up], best_down[ask_down] = shares[:len(ask_up)], shares[len(ask_up):]
            take_up, none = best_up >= best_down, ~(has_up | has_down)
            run[off] = np.where(none, run[off], np.where(take_up, above, below))
            at[off] = np.where(none, at[off], np.where(take_up, self.ends[above], self.starts[below]))
            place[off] = np.where(none, place[off], np.where(take_up, up_end, down_end))
            length[off] = np.where(none, -1, np.minimum(length[off], np.maximum(best_up, best_down)))
        moved = length >= 0
        at = np.where(moved, self.base[run] + at - self.starts[run], at)
        place = np.where(moved, (place - 1) % len(self.text), place)
        return at, place, length + 1

    def matching_statistics(self, patterns: np.ndarray, reach: int | None = None) -> np.ndarray:
        """For rows of symbols (negative: none), the longest match that begins at each place.

        With `reach`, only matches longer than this that cover the place of this number are wanted: places after it
        are left out, and a row where none can come any more is given up, and zero from there.
        """
        rows, width = patterns.shape
        out = np.zeros((rows, width if reach is None else reach + 1), dtype=np.int64)
        size = width - np.argmax(patterns[:, ::-1] != -1, axis=1)  # a row takes part from its last symbol on
        least = np.argmax(patterns != -1, axis=1) + (reach or 0)  # where the first match that is wanted ends
        who = np.argsort(-size, kind="stable")
        begun = np.searchsorted(-size[who], -np.arange(width), side="left")
        state = np.zeros(rows, dtype=np.int64), np.full(rows, self.at_start[0], dtype=np.int64), np.zeros(rows, dtype=np.int64)
        for j in range(width - 1, -1, -1):
            if reach is None or j > reach:
                m = begun[j]
                if m:
                    for old, new in zip(state, self._step(patterns[who[:m], j], *(x[:m] for x in state))):
                        old[:m] = new
                if reach is None:
                    out[who, j] = state[2]
                continue
            state = self._step(patterns[who, j], *state)
            alive = state[2] + j > least[who]
            if not alive.all():
                who, state = who[alive], tuple(x[alive] for x in state)
                if not len(who):
                    break
            out[who, j] = state[2]
        return out
