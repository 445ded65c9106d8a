"""Byte-level BPE over whole texts by way of pieces that surely start and end with a match, in numpy.

The split pattern of the public vocabularies starts a match at every single space between characters other than
white space, at punctuation after an ASCII letter or digit, and before and after a line feed that something else than
white space follows.  A text can be cut there and its pieces encoded alone, with the same ids.  Equal pieces
are encoded once: a hash table of bounded size remembers their ids.  What the table gives is held
against the text: a text whose ids do not decode to its own bytes (two pieces with one hash) is encoded anew.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from ._common import _BYTE_VALUES, range_hashes

#: characters of text encoded together; bounds a worker's memory. Longer texts are cut into segments at spaces
WINDOW_CHARS = 1_000_000
#: bytes of joined pieces given to the backend at once
JOINED_BYTES = 32_768
#: slots of the table (a power of two), entries and ids after which it is emptied
SLOT_BITS, MOST_ENTRIES, MOST_IDS = 21, 1_000_000, 4_000_000

_SAFE_SPACE = re.compile("(?<=[!-~]) (?=[!-~])")
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_ALNUM, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = True
_STOP[list(b'.,;:!?)]}"')] = True
_LETTER, _PAIR = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_PAIR[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True
#: what a piece starts with: inside a text a space, or something else; a text's start
_SPACE, _OTHER, _TEXT = 1, 2, 3


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the stretches [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _blank_like(b0: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Whether a character of two or three bytes may be white space: U+0085, U+00A0, U+1000 on, parts of U+2000 on, U+3000."""
    low = (b1 == 0x80) & ((b2 < 0x90) | ((b2 >= 0xA8) & (b2 < 0xB0))) | ((b1 == 0x81) & (b2 >= 0x90))
    return (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)) | (b0 == 0xE1) | (b0 == 0xE2) & low | (b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)


def cut_spaces(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of spaces in UTF-8 ``data`` that surely start a match; ``first``: where texts start."""
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at < len(data) - 1)]
    edge = np.zeros(len(data) + 1, bool)
    edge[first] = True
    at = at[~edge[at] & ~edge[at + 1]]
    before, after = data[at - 1], data[at + 1]
    ok = _PLAIN[before] & _PLAIN[after]
    other = np.flatnonzero(~ok & (_PLAIN[before] | (before >= 0x80)) & (_PLAIN[after] | (after >= 0x80)))
    if len(other):
        padded = np.concatenate([np.zeros(4, np.uint8), data, np.zeros(4, np.uint8)])
        p = at[other] + 4
        three = padded[p - 2] & 0xC0 == 0x80  # the character before has three bytes or more
        left = np.where(three, _blank_like(padded[p - 3], padded[p - 2], padded[p - 1]), _blank_like(padded[p - 2], padded[p - 1], padded[p]))
        right = _blank_like(padded[p + 1], padded[p + 2], padded[p + 3])
        ok[other] = ~((padded[p - 1] >= 0x80) & left) & ~((padded[p + 1] >= 0x80) & right)
    return at[ok]


def cut_marks(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each byte the kind of piece that starts there, 0 for none; ``first``: where texts start."""
    mark = np.zeros(len(data), np.uint8)
    mark[1:][_ALNUM[data[:-1]] & _STOP[data[1:]]] = _OTHER
    line = np.flatnonzero(data[:-1] == 10)
    edge = np.zeros(len(data), bool)
    edge[first] = True
    line = line[_PLAIN[data[line + 1]] & ~edge[line + 1]]
    mark[line] = mark[line + 1] = _OTHER
    mark[cut_spaces(data, first)] = _SPACE
    mark[first] = _TEXT  # a cut at the end of a text is the next one's start
    return mark


def words_alone(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each stretch of UTF-8 ``raw`` (from one start to the next) is letters only, after one space at most: a single match.

    Letters are those of ASCII and of U+00C0 to U+017F and U+0400 to U+047F, where only two signs are none.
    """
    pair = _PAIR[raw]
    second = np.concatenate([[False], pair[:-1]])  # sure to be there: a stretch holds whole characters
    odd = ~(_LETTER[raw] | pair | second)
    sign = np.flatnonzero(second & ((raw == 0x97) | (raw == 0xB7)))
    odd[sign[raw[sign - 1] == 0xC3]] = True
    space = raw[starts] == 32
    odd[starts[space]] = False
    return ~np.logical_or.reduceat(odd, starts) & (np.diff(starts, append=len(raw)) > space)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Record batches a few rows at a time: Python objects are made of no more than that at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back_memory() -> None:
    """Returns what loading a vocabulary has freed to the system, where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


class _Table:
    """Hash to stretch of ids: open addressing, a whole array of hashes looked up or put in at a time."""

    def __init__(self):
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.starts, self.sizes = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
        self.clear()

    def clear(self) -> None:
        self.keys[:] = 0
        self.entries, self.used, self.ids = 0, 0, np.empty(1 << 16, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 for those that are not there."""
        slots = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        found = self.keys[slots]
        out = np.where(found == hashes, slots, -1)
        todo = np.flatnonzero((found != hashes) & (found != 0))
        while len(todo):
            slots[todo] = now = slots[todo] + 1 & (1 << SLOT_BITS) - 1
            found = self.keys[now]
            hit = found == hashes[todo]
            out[todo[hit]] = now[hit]
            todo = todo[~hit & (found != 0)]
        return out

    def put(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Adds distinct new hashes with their ids, one stretch after the other."""
        if self.used + len(ids) > len(self.ids):
            grown = np.empty(2 * (self.used + len(ids)), np.int32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.entries += len(hashes)
        slots = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            now = slots[todo]
            free = self.keys[now] == 0
            self.keys[now[free]] = hashes[todo[free]]  # of several for one slot, the last one stays
            won = np.zeros(len(todo), bool)
            won[free] = self.keys[now[free]] == hashes[todo[free]]
            self.starts[now[won]], self.sizes[now[won]] = starts[todo[won]], sizes[todo[won]]
            todo = todo[~won]
            slots[todo] = slots[todo] + 1 & (1 << SLOT_BITS) - 1


class PieceEncoder:
    """Texts to ids as little-endian uint32 bytes.

    ``encode_texts`` gives the ids of each of some texts; ``tokens`` holds the bytes of each id.  Texts that hold one of
    the strings ``whole`` are given to it as they are: such strings are ids of their own, found before the pattern.
    ``encode_matches``, where there is one, gives (ids, their numbers) of stretches of UTF-8, each a single match of the
    pattern; new pieces that are words alone go to it.
    """

    def __init__(self, encode_texts: Callable[[list[str]], list], tokens: list[bytes], whole: tuple[str, ...] = (), encode_matches: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None):
        self._encode_texts, self._table, self._whole, self._encode_matches = encode_texts, _Table(), whole, encode_matches
        self._flat = np.frombuffer(b"".join(tokens), np.uint8)
        self._lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self._starts = np.cumsum(self._lengths) - self._lengths

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids."""
        return self._flat[ranges(self._starts[ids], self._lengths[ids])]

    def _plainly(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x, np.int64) for x in self._encode_texts(texts)]

    def _joined(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, line: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, sizes in ids), encoded many in a text; with ``line`` a line feed stands before each."""
        ends = np.cumsum(sizes + line)
        raw = np.full(int(ends[-1]) if len(ends) else 0, 10, np.uint8)
        raw[ranges(ends - sizes, sizes)] = data[ranges(starts, sizes)]
        raw = raw.tobytes()
        cuts = [0, *ends[np.flatnonzero(np.diff(ends // JOINED_BYTES))].tolist(), len(raw)]
        found = self._plainly([raw[a:b].decode() for a, b in zip(cuts, cuts[1:]) if b > a])
        ids = np.concatenate([np.zeros(0, np.int64), *found])
        if not len(ends):
            return ids, ends
        at = np.cumsum(self._lengths[ids])
        last = np.searchsorted(at, ends)
        begin = np.concatenate([[0], last[:-1] + 1])
        if last[-1] >= len(at) or (at[last] != ends).any() or line and (at[begin] != ends - sizes).any():
            raise AssertionError("a piece was not encoded alone")
        counts = last + 1 - begin - line
        return ids[ranges(begin + line, counts)], counts

    def _encode_new(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, sizes in ids). Pieces that start with a space or something else (``kinds``) are joined, others encoded alone."""
        order, ids, counts = [], [], []
        if self._encode_matches:
            raw, at = data[ranges(starts, sizes)], np.cumsum(sizes) - sizes
            alone = words_alone(raw, at)
            own, kinds = np.flatnonzero(alone), np.where(alone, 0, kinds)
            for part, to in zip(self._encode_matches(raw[np.repeat(alone, sizes)], sizes[own]), (ids, counts)):
                to.append(part)
            order.append(own)
        for kind, line in ((_SPACE, 0), (_OTHER, 1)):
            own = np.flatnonzero(kinds == kind)
            for part, to in zip(self._joined(data, starts[own], sizes[own], line), (ids, counts)):
                to.append(part)
            order.append(own)
        own = np.flatnonzero(kinds == _TEXT)
        alone = self._plainly([data[a : a + n].tobytes().decode() for a, n in zip(starts[own].tolist(), sizes[own].tolist())])
        ids, counts = np.concatenate([*ids, *alone]), np.concatenate([*counts, np.fromiter(map(len, alone), np.int64, len(alone))])
        back = np.argsort(np.concatenate([*order, own]))
        return ids[ranges((np.cumsum(counts) - counts)[back], counts[back])], counts[back]

    def _encode_window(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each text in them)."""
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        text_ends = np.cumsum(lengths)
        if not text_ends[-1]:
            return np.zeros(0, np.int64), np.zeros(len(raws), np.int64)
        data = np.frombuffer(b"".join(raws), np.uint8)
        first = (text_ends - lengths)[lengths > 0]
        mark = cut_marks(data, first)
        starts = np.flatnonzero(mark)
        ends = np.append(starts[1:], len(data))
        hashes = range_hashes(_BYTE_VALUES[data], starts, ends)
        hashes[hashes == 0] = 1
        table = self._table
        if table.entries > MOST_ENTRIES or table.used > MOST_IDS:
            table.clear()
        slots = table.find(hashes)
        missing = np.flatnonzero(slots < 0)
        spilled, spilled_at = None, None
        if len(missing):
            new, one = np.unique(hashes[missing], return_index=True)
            one = missing[one]
            kinds = mark[starts[one]]
            kinds[(kinds == _OTHER) & ~_PLAIN[data[starts[one]]]] = _TEXT
            followed = np.append(mark[starts[1:]], _TEXT)[one]
            kinds[(followed != _SPACE) & ~_PLAIN[data[ends[one] - 1]]] = _TEXT  # it may end in white space
            ids, counts = self._encode_new(data, starts[one], ends[one] - starts[one], kinds)
            if len(new) < (1 << SLOT_BITS) * 3 // 4 - table.entries and len(ids) < MOST_IDS:
                table.put(new, ids, counts)
                slots[missing] = table.find(hashes[missing])
            else:  # a window with more new pieces than the table takes keeps them to itself
                spilled, spilled_at = ids, np.searchsorted(new, hashes[missing])
        if spilled is None:
            sizes = table.sizes[slots].astype(np.int64)
            out = table.ids[ranges(table.starts[slots].astype(np.int64), sizes)].astype(np.int64)
        else:
            both = np.concatenate([table.ids[: table.used], spilled])
            sizes, begin = table.sizes[slots].astype(np.int64), table.starts[slots].astype(np.int64)
            sizes[missing], begin[missing] = counts[spilled_at], (table.used + np.cumsum(counts) - counts)[spilled_at]
            out = both[ranges(begin, sizes)]
        by_text = np.searchsorted(starts, text_ends)  # pieces up to each text's end
        id_ends = np.concatenate([[0], np.cumsum(sizes)])[by_text]
        decoded = self.decode(out)
        if len(decoded) == len(data) and (decoded == data).all():
            return out, id_ends
        fresh = self._plainly([r.decode() for r in raws])  # a hash that two pieces share
        table.clear()
        return np.concatenate(fresh), np.cumsum([len(x) for x in fresh])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Texts above a window are cut at spaces where a match surely starts."""
        out: list[list[bytes]] = [[] for _ in texts]
        raws, owners, chars = [], [], 0

        def flush() -> None:
            nonlocal chars
            if raws:
                ids, ends = self._encode_window(raws)
                flat, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
                for k, a, b in zip(owners, [0, *ends], ends):
                    out[k].append(flat[a:b])
                raws.clear(), owners.clear()
                chars = 0

        for k, text in enumerate(texts):
            at = 0
            if any(x in text for x in self._whole):
                out[k].append(self._plainly([text.encode("utf-8", "replace").decode()])[0].astype("<u4").tobytes())
                continue
            while at < len(text):
                cut = _SAFE_SPACE.search(text, at + WINDOW_CHARS) if len(text) - at > WINDOW_CHARS else None
                end = cut.start() if cut else len(text)
                if end - at > 4 * WINDOW_CHARS:  # hardly a space in it: nothing to remember
                    flush()
                    out[k].append(self._plainly([text[at:end].encode("utf-8", "replace").decode()])[0].astype("<u4").tobytes())
                    at = end
                    continue
                raws.append(text[at:end].encode("utf-8", "replace"))
                owners.append(k)
                chars += end - at
                at = end
                if chars >= WINDOW_CHARS:
                    flush()
        flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def windows(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list[bytes]]]:
        """(first column, texts, ids) of record batches (id, text), a window at a time."""
        keys, texts, chars = [], [], 0
        for part in slices(batches):
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                keys.append(key)
                texts.append(text)
                chars += len(text)
                if chars >= WINDOW_CHARS:
                    yield keys, texts, self.encode(texts)
                    keys, texts, chars = [], [], 0
        if keys:
            yield keys, texts, self.encode(texts)
