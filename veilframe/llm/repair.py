"""Re-Pair grammar compression of id sequences in numpy, many rules a round, until no pair pays for a rule.

A round ranks all pairs that occur ``LEAST`` times or more by their number of occurrences.  An occurrence is
replaced where its pair ranks above both pairs that it overlaps, so the most frequent pair of a round loses
all its occurrences, and others are replaced beside it; a pair with fewer than ``LEAST`` such
places waits for a later round.  Runs of one symbol count and lose every second pair.  A rule costs three numbers (two
parts and an expansion length) and each place saves one, so rules pay from ``LEAST`` places on; there is no other limit.
Pairs once below ``LEAST`` stay there, so later rounds sort only what is frequent or new.  While that is much, the sequence is
closed up after a round, so that neighbours stand side by side; then it is linked both ways.
"""

from __future__ import annotations

import numpy as np

#: places from which a rule saves more than it costs
LEAST = 4
#: rules with expansions up to this length are kept expanded by a reader
SHORT = 64

_NONE = np.int32(2**31 - 1)


def _odd_places(first: np.ndarray) -> np.ndarray:
    """Mask over pairs of one symbol in ascending order, of which ``first`` start a run: whether one stands at an odd place of its run."""
    place = np.arange(len(first))
    return (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 1


def _ranked(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs that occur ``LEAST`` times or more, the most frequent first; for each place its pair's rank, else ``_NONE``)."""
    places = len(left).bit_length()
    keys = left.astype(np.int64) << bits | right
    if 2 * bits + places < 64:  # key and place in one number: sorting numbers is faster than sorting places
        packed = np.sort(keys << places | np.arange(len(keys)))
        order, in_order = packed & (1 << places) - 1, packed >> places
    else:
        order = np.argsort(keys, kind="stable")
        in_order = keys[order]
    first = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
    counts = np.diff(first, append=len(keys))
    often = np.flatnonzero(counts >= LEAST)
    often = often[np.argsort(-counts[often], kind="stable")]
    rank = np.full(len(first), _NONE, np.int32)
    rank[often] = np.arange(len(often), dtype=np.int32)
    own = np.empty(len(keys), np.int32)
    own[order] = np.repeat(rank, counts)
    return in_order[first[often]], own


def compress(ids: np.ndarray, end: int, first_new: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k stands for symbol first_new + k and holds two symbols. ``end`` is never part of a pair."""
    symbols = np.append(ids, np.uint32(end)).astype(np.int32)  # the last slot ends it
    rules, n_rules = [], 0

    def replace(where: np.ndarray, own: np.ndarray, pairs: np.ndarray, bits: int) -> np.ndarray:
        """Makes rules of the pairs with ``LEAST`` of the places (``own``: their ranks); returns the places replaced."""
        nonlocal n_rules
        enough = np.bincount(own, minlength=len(pairs)) >= LEAST
        number = (np.cumsum(enough) + (first_new + n_rules - 1)).astype(np.int32)
        made = pairs[enough]
        rules.append(np.stack([made >> bits, made & (1 << bits) - 1], 1))
        n_rules += len(made)
        fine = enough[own]
        where = where[fine]
        symbols[where] = number[own[fine]]
        return where

    # while much is open: neighbours stand side by side, what is replaced is closed up
    open_, at = np.ones(len(symbols) - 1, bool), None
    while at is None:
        n, inner = len(symbols) - 1, symbols != end
        keep = open_ & inner[:-1] & inner[1:]
        again = np.flatnonzero((symbols[:-1] == symbols[1:]) & keep)
        if len(again):
            keep[again[_odd_places((again == 0) | (symbols[again - 1] != symbols[again]))]] = False
        now = np.flatnonzero(keep)
        bits = (first_new + n_rules).bit_length()
        pairs, own = _ranked(symbols[now], symbols[now + 1], bits)
        if not len(pairs):
            break
        ranks = np.full(n + 2, _NONE, np.int32)
        ranks[now + 1] = own
        mine = ranks[1:-1]
        where = np.flatnonzero((mine < ranks[:-2]) & (mine < ranks[2:]))
        where = replace(where, mine[where], pairs, bits)
        alive = np.ones(n + 1, bool)
        alive[where + 1] = False
        # open from now on: what was frequent, what touches a new symbol, and what a run has skipped
        open_ = mine != _NONE
        open_[again] = open_[where[where > 0] - 1] = True
        symbols, open_ = symbols[alive], open_[alive[:-1]]
        if 8 * len(found := np.flatnonzero(open_)) < len(open_):
            at = found
    if at is not None:  # little is open: the sequence stays where it is, linked both ways; slot n ends it
        n = len(symbols) - 1
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        alive, ranks = np.ones(n, bool), np.full(n + 2, _NONE, np.int32)  # slots n and -1: no pair
        while True:
            left, right = symbols.take(at), symbols.take(after.take(at))
            keep = (left != end) & (right != end)
            same = np.flatnonzero((left == right) & keep)
            again = at[same]
            if len(again):
                back = before[again]
                keep[same[_odd_places((back < 0) | (symbols[back] != symbols[again]))]] = False
            at, left, right = at[keep], left[keep], right[keep]
            bits = (first_new + n_rules).bit_length()
            pairs, own = _ranked(left, right, bits)
            if not len(pairs):
                break
            at, own = at[own != _NONE], own[own != _NONE]
            ranks[at] = own
            chosen = np.flatnonzero((own < ranks.take(before.take(at))) & (own < ranks.take(after.take(at))))
            ranks[at] = _NONE
            where = replace(at[chosen], own[chosen], pairs, bits)
            gone = after[where]
            alive[gone] = False
            after[where] = follower = after[gone]
            before[follower] = where
            at = np.sort(np.concatenate([at, again, before[where]]))
            at = at[(at >= 0) & (at != np.concatenate([[-1], at[:-1]]))]
            at = at[alive[at]]
        symbols = np.append(symbols[:-1][alive], np.int32(end))
    return symbols[:-1], np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def _copy_ranges(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches source[start : start + size], one after the other."""
    ends = np.cumsum(sizes)
    return source[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _levels(rules: np.ndarray, first_new: int):
    """Per level of rules whose parts are known: (their numbers, sizes of all symbols so far)."""
    sizes = np.ones(first_new + len(rules), np.int64)
    sizes[first_new:] = 0
    waiting = np.arange(len(rules))
    while len(waiting):
        parts = sizes[rules[waiting]]
        ready = parts.all(1)
        now, waiting = waiting[ready], waiting[~ready]
        if not len(now):
            raise ValueError("rules that hold themselves")
        sizes[first_new + now] = parts[ready].sum(1)
        yield now, sizes
    yield np.zeros(0, np.int64), sizes


def expansion_lengths(rules: np.ndarray, first_new: int) -> np.ndarray:
    """Ids that each symbol, vocabulary and rules, stands for."""
    for _, sizes in _levels(rules, first_new):
        pass
    return sizes


class Grammar:
    """Expands symbols. Expansions up to ``SHORT`` lie in one array; longer rules are opened until only such are left."""

    def __init__(self, rules: np.ndarray, first_new: int):
        self.first_new, self.rules = first_new, rules
        self.starts = np.arange(first_new + len(rules))
        self.flat = np.arange(first_new)
        for now, self.sizes in _levels(rules, first_new):
            now = now[self.sizes[first_new + now] <= SHORT]
            lengths = self.sizes[first_new + now]
            parts = rules[now].ravel()
            self.starts[first_new + now] = len(self.flat) + np.cumsum(lengths) - lengths
            self.flat = np.concatenate([self.flat, _copy_ranges(self.flat, self.starts[parts], self.sizes[parts])])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        long = self.sizes.take(symbols) > SHORT
        if long.any():
            parts = symbols[long]
            owners = np.arange(len(parts))
            while len(at := np.flatnonzero(self.sizes.take(parts) > SHORT)):
                times = np.ones(len(parts), np.int64)
                times[at] = 2
                rules = self.rules[parts[at] - self.first_new]
                parts, owners = np.repeat(parts, times), np.repeat(owners, times)
                where = at + np.arange(len(at))
                parts[where], parts[where + 1] = rules.T
            times = np.ones(len(symbols), np.int64)
            times[long] = np.bincount(owners)
            symbols, long = np.repeat(symbols, times), np.repeat(long, times)
            symbols[long] = parts
        return _copy_ranges(self.flat, self.starts.take(symbols), self.sizes.take(symbols))
