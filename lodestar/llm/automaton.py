"""Finite automata over bytes, run on many pieces at once.

A piece of text is read without knowing in which state the automaton enters
it: for every possible entry state it yields the exit state and what was
counted on the way. Such functions compose, and composing is associative, so a
text of any length can be read in pieces anywhere and in any order, and put
together from one small row for each piece.

Pieces are cut into lanes of LANE bytes, and all lanes step together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LANE = 128


@dataclass(frozen=True)
class Automaton:
    """classes: the class of each byte, 0 for bytes that change nothing;
    step[class, state]: the next state; counts[c][class, state]: 1 where
    reading the byte in that state adds to counter c (two counters at most)."""

    classes: np.ndarray
    step: np.ndarray
    counts: tuple[np.ndarray, ...]

    @property
    def states(self) -> int:
        return self.step.shape[1]

    def table(self) -> np.ndarray:
        """Next state and counts of class * states + state in one byte."""
        packed = self.step.astype(np.uint8)
        for c, counted in enumerate(self.counts):
            packed = packed | counted.astype(np.uint8) << (6 + c)
        return packed.ravel()


class Pieces:
    """Byte strings cut into lanes, with the function of every lane."""

    def __init__(self, automaton: Automaton, texts: list[bytes]):
        self.automaton, self.sizes = automaton, np.array([len(t) for t in texts], np.int64)
        self.lanes = -(-self.sizes // LANE)
        self.first = np.cumsum(self.lanes) - self.lanes
        classes = automaton.classes[np.frombuffer(b"".join(texts), np.uint8)]
        padded = np.zeros(int(self.lanes.sum()) * LANE, np.uint8)
        at = 0
        for place, size in zip((self.first * LANE).tolist(), self.sizes.tolist(), strict=True):
            padded[place : place + size] = classes[at : at + size]
            at += size
        self.bytes = padded.reshape(-1, LANE)
        #: Pieces by falling number of lanes, so those with a j-th lane are a prefix.
        self.order = np.argsort(-self.lanes, kind="stable")
        self.exits, self.counts = self._functions()

    def _functions(self) -> tuple[np.ndarray, np.ndarray]:
        """By lane and entry state: the exit state, and the counts."""
        states, table = self.automaton.states, self.automaton.table()
        columns = np.ascontiguousarray(self.bytes.T) * np.uint8(states)
        state = np.tile(np.arange(states, dtype=np.uint8), (len(self.bytes), 1))
        counts = np.zeros((len(self.automaton.counts), *state.shape), np.uint8)
        for column in columns:
            found = table[column[:, None] + state]
            state = found & 63
            for c in range(len(counts)):
                counts[c] += found >> (6 + c) & 1
        return state, counts

    def _active(self):
        """j, and the pieces that have a j-th lane."""
        sizes = -self.lanes[self.order]
        for j in range(int(self.lanes.max(initial=0))):
            yield j, self.order[: np.searchsorted(sizes, -j, "left")]

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """By piece and entry state: exit state, and counts by counter."""
        states = self.automaton.states
        state = np.tile(np.arange(states), (len(self.sizes), 1))
        counts = np.zeros((len(self.automaton.counts), *state.shape), np.int64)
        for j, some in self._active():
            lane = (self.first[some] + j)[:, None]
            for c in range(len(counts)):
                counts[c][some] += self.counts[c][lane, state[some]]
            state[some] = self.exits[lane, state[some]]
        return state, counts

    def entered(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By lane: the state it is entered in, and what the first counter has
        then, for pieces entered in the states `start`."""
        state, count = start.copy(), np.zeros(len(self.sizes), np.int64)
        states, before = np.zeros(len(self.bytes), np.int64), np.zeros(len(self.bytes), np.int64)
        for j, some in self._active():
            lane = self.first[some] + j
            states[lane], before[lane] = state[some], count[some]
            count[some] += self.counts[0][lane, state[some]]
            state[some] = self.exits[lane, state[some]]
        return states, before

    def find(self, start: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """By piece, the place of the byte that adds number `wanted` (from 0) to
        the first counter; 0 for a negative number, the piece's size beyond
        its last. `wanted` has a row for each set of numbers."""
        states, before = self.entered(start)
        out = np.where(wanted < 0, 0, self.sizes)
        total = np.zeros(len(self.sizes), np.int64)
        some = self.lanes > 0
        last = (self.first + self.lanes - 1)[some]
        total[some] = before[last] + self.counts[0][last, states[last]]
        for row, numbers in enumerate(wanted):
            hit = np.flatnonzero((numbers >= 0) & (numbers < total))
            # The last lane entered with at most that many: `before` rises within a piece.
            key = np.repeat(np.arange(len(self.sizes)), self.lanes) * (int(total.max(initial=0)) + 1) + before
            lane = np.searchsorted(key, hit * (int(total.max(initial=0)) + 1) + numbers[hit], "right") - 1
            out[row, hit] = (lane - self.first[hit]) * LANE + self._within(lane, states[lane], numbers[hit] - before[lane])
        return out

    def _within(self, lane: np.ndarray, state: np.ndarray, number: np.ndarray) -> np.ndarray:
        table, states = self.automaton.table(), self.automaton.states
        place, count = np.full(len(lane), LANE), np.zeros(len(lane), np.int64)
        for t in range(LANE):
            found = table[self.bytes[lane, t].astype(np.int64) * states + state]
            counted = (found >> 6 & 1).astype(bool)
            place[counted & (count == number)] = t
            count += counted
            state = (found & 63).astype(np.int64)
        return place
