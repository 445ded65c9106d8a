"""Generalised suffix automaton over sequences of hashable symbols, with matching statistics."""

from __future__ import annotations


class SuffixAutomaton:
    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, transitions: dict, link: int, length: int) -> int:
        self.next.append(transitions)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, at: int, symbol, to: int) -> int:
        """A copy of ``to`` for the strings that reach it from ``at`` or shorter."""
        copy = self._state(dict(self.next[to]), self.link[to], self.length[at] + 1)
        self.link[to] = copy
        while at >= 0 and self.next[at].get(symbol) == to:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def add(self, sequence) -> None:
        """Adds all factors of one more sequence."""
        last = 0
        for symbol in sequence:
            to = self.next[last].get(symbol)
            if to is not None:
                last = to if self.length[to] == self.length[last] + 1 else self._split(last, symbol, to)
                continue
            new, at = self._state({}, 0, self.length[last] + 1), last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = new
                at = self.link[at]
            if at >= 0:
                to = self.next[at][symbol]
                self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, symbol, to)
            last = new

    def matches(self, sequence) -> list[int]:
        """For each position, the length of the longest factor that ends there and has been added."""
        out, state, size = [], 0, 0
        next_, link, length = self.next, self.link, self.length
        for symbol in sequence:
            to = next_[state].get(symbol)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = next_[state].get(symbol)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out
