"""Longest runs of tokens that a text shares with others, in linear time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

#: no token: it ends a text, so that no run crosses two
END = object()


class RunIndex:
    """All runs of some token sequences as a suffix automaton: a state for each class of runs with the same ends."""

    def __init__(self, texts: Sequence[Sequence[str]]):
        self.moves: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for text in texts:
            for token in (*text, END):
                last = self._grow(last, token)

    def _grow(self, last: int, token) -> int:
        new = len(self.size)
        self.moves.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        state = last
        while state >= 0 and token not in self.moves[state]:
            self.moves[state][token] = new
            state = self.link[state]
        if state >= 0:
            after = self.moves[state][token]
            if self.size[after] == self.size[state] + 1:
                self.link[new] = after
            else:
                split = len(self.size)
                self.moves.append(dict(self.moves[after]))
                self.size.append(self.size[state] + 1)
                self.link.append(self.link[after])
                self.link[after] = self.link[new] = split
                while state >= 0 and self.moves[state].get(token) == after:
                    self.moves[state][token] = split
                    state = self.link[state]
        return new

    def runs_ending(self, text: Sequence[str]) -> list[int]:
        """For each position, tokens of the longest run that ends there and is in a text."""
        state, length, out = 0, 0, []
        for token in text:
            while state and token not in self.moves[state]:
                state = self.link[state]
                length = self.size[state]
            if token in self.moves[state]:
                state = self.moves[state][token]
                length += 1
            else:
                length = 0
            out.append(length)
        return out


def longest_runs(text: Sequence[str], others: Sequence[Sequence[str]]) -> list[int]:
    """For each position of ``text``, tokens of the longest run from there that one of ``others`` holds."""
    return RunIndex([o[::-1] for o in others]).runs_ending(text[::-1])[::-1]


def shared_phrases(text: Sequence[str], others: Sequence[Sequence[str]], counts: Callable[[str], bool], least: int) -> list[tuple[int, int]]:
    """Phrases (position, tokens) taken from the left: the longest run at a place, of two tokens or more and with ``least`` that count."""
    found, at = [], 0
    lengths = longest_runs(text, others)
    while at < len(text):
        size = lengths[at]
        if size >= 2 and sum(map(counts, text[at : at + size])) >= least:
            found.append((at, size))
            at += size
        else:
            at += 1
    return found
