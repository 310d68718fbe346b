"""Cheapest edits that turn a sequence of messages into a dialogue, by a Viterbi recursion that runs in parallel chunks.

States are what has been written so far: nothing (0), a system message (1), a user's (2), an assistant's (3). Every state
allows one role that may be inserted or given: user, but assistant after user. Costs run backward: ``costs[i, x]`` is the
least cost of the rows from i on and of the end, in state x before row i. A chunk does not wait for the one behind it but
starts from a speculative vector of zeros; all chunks take a step at once. Where the true vector turns out to differ from
the assumed one by more than a constant, the chunk runs again, until all differ by constants; these are added up in
the end ("rank convergence": after a few rows the vector depends on its start by a constant only).
"""

from __future__ import annotations

import numpy as np

CHUNK = 64
KEEP_S, KEEP_U, KEEP_A, KEEP_NONE = range(4)
NEXT = np.array([2, 2, 3, 2])  # state after the role that may be inserted
END = np.array([0, 4, 2, 0])  # costs where a conversation ends: what is begun is completed by insertions
FAR = 1 << 40
INSERT, RENAME, DELETE = 2, 2, 3
ROLE_OF_STATE = (None, "system", "user", "assistant")
D, K, R = range(3)
LETTERS = "DKR"
_KEPT = np.full((4, 4), -1)  # state after a row of a class is kept in a state
_KEPT[KEEP_S, 0] = 1
_KEPT[KEEP_U, [0, 1, 3]] = 2
_KEPT[KEEP_A, 2] = 3
CLASS = {"s": KEEP_S, "u": KEEP_U, "a": KEEP_A}


def step(after: np.ndarray, kind: np.ndarray, must_go: np.ndarray, fee: np.ndarray) -> np.ndarray:
    """Costs before rows, from the costs after them (both n x 4)."""
    delete, keep, rename = options(after, kind, must_go, fee)
    best = np.minimum(np.minimum(delete, keep), rename)
    for _ in range(2):  # no more than two insertions in a row help
        best = np.minimum(best, INSERT + best[:, NEXT])
    return best


def options(after, kind, must_go, fee) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    to = _KEPT[kind]
    stays = np.where(must_go, FAR, fee)[:, None]
    keep = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), FAR) + stays
    return after + DELETE, keep, after[:, NEXT] + RENAME + stays


class Costs:
    """Backward costs of rows; ``last`` marks rows where a conversation ends. Where the final row is none of these,
    the rows after it are unknown here and ``end`` are the costs assumed for them."""

    def __init__(self, kind: np.ndarray, must_go: np.ndarray, fee: np.ndarray, last: np.ndarray, end=(0, 0, 0, 0)):
        self.kind, self.must_go, self.fee, self.last = kind, must_go, fee.astype(np.int64), last
        n = self.n = len(kind)
        self.end = np.array(end, np.int64)
        self.costs = np.zeros((n, 4), np.int64)
        self.chunks = -(-n // CHUNK)
        self.passes = 0
        if not n:
            return
        first = np.arange(self.chunks) * CHUNK
        stop = np.minimum(first + CHUNK, n)
        ends = last[stop - 1]
        assumed = np.zeros((self.chunks, 4), np.int64)
        assumed[-1] = self.end
        rerun = np.arange(self.chunks)
        while len(rerun):
            self.passes += 1
            self._run(rerun, first, stop, assumed)
            true = np.vstack([self.costs[first[1:]], self.end[None]])
            shift = true - assumed
            rerun = np.flatnonzero(~ends & (shift != shift[:, :1]).any(axis=1))
            assumed[rerun] = true[rerun]
        inner = np.maximum.accumulate(np.where(last, np.arange(n), -1))  # last end so far
        tail = np.where(inner[stop - 1] >= first, inner[stop - 1] + 1, first)  # rows from here on know the end by assumption
        shift, carried = np.where(ends, 0, (true - assumed)[:, 0]).tolist(), 0
        for c in range(self.chunks - 1, -1, -1):
            carried = 0 if ends[c] else shift[c] + carried
            if carried:
                self.costs[tail[c] : stop[c]] += carried
            if tail[c] > first[c]:
                carried = 0

    def _run(self, chunks, first, stop, assumed) -> None:
        now = assumed[chunks].copy()
        for t in range(CHUNK - 1, -1, -1):
            inside = np.flatnonzero(first[chunks] + t < stop[chunks])
            row = first[chunks[inside]] + t
            now[inside] = np.where(self.last[row][:, None], END, now[inside])
            now[inside] = step(now[inside], self.kind[row], self.must_go[row], self.fee[row])
            self.costs[row] = now[inside]

    def moves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row and state: how many insertions come first, what then happens to the row, and the state after.

        Of equally cheap edits the one whose letter is least: D, I, K, R."""
        after = np.vstack([self.costs[1:], self.end[None]])
        after[self.last] = END
        delete, keep, rename = options(after, self.kind, self.must_go, self.fee)
        by_insertion = (INSERT + self.costs[:, NEXT] == self.costs) & (delete != self.costs)
        what = np.where(delete == self.costs, D, np.where(keep == self.costs, K, R))
        to = np.where(what == D, np.arange(4), np.where(what == K, _KEPT[self.kind], NEXT))
        inserted = np.zeros((self.n, 4), np.int64)
        for _ in range(2):
            what, to = np.where(by_insertion, what[:, NEXT], what), np.where(by_insertion, to[:, NEXT], to)
            inserted = np.where(by_insertion, 1 + inserted[:, NEXT], inserted)
        return inserted, what, to

    def states(self, to: np.ndarray, begins: np.ndarray, start: int = 0) -> np.ndarray:
        """The state before each row, and at the very end; ``begins`` marks rows where a conversation begins."""
        first = np.arange(self.chunks) * CHUNK
        stop = np.minimum(first + CHUNK, self.n)
        out = np.zeros((self.n + 1, 4), np.int64)  # from each state that a chunk may begin with
        now = np.tile(np.arange(4), (self.chunks, 1))
        for t in range(CHUNK):
            inside = np.flatnonzero(first + t < stop)
            row = first[inside] + t
            now[inside] = np.where(begins[row][:, None], 0, now[inside])
            out[row] = now[inside]
            now[inside] = np.take_along_axis(to[row], now[inside], 1)
        state, begin = start, np.zeros(self.chunks, np.int64)
        for c, exits in enumerate(now.tolist()):
            begin[c] = state
            state = exits[state]
        out[self.n] = state
        return out[np.arange(self.n + 1), np.append(np.repeat(begin, stop - first), 0)]


def exits(costs: Costs) -> list[int]:
    """The state after all rows, from each state before them."""
    _, _, to = costs.moves()
    none = np.zeros(costs.n, bool)
    return [int(costs.states(to, none, x)[-1]) for x in range(4)]
