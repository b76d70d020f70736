"""Phrases of word sequences by recompression: equal passages get the same phrases inside.

The words of some texts are one array, with a *wall* before, between and after the texts. A word is named by a hash of its bytes. In
each round runs of one symbol are named by the symbol and the number of its repeats; then symbols are parted into left and right
ones by a bit of a hash of name and round, and a left symbol followed by a right one becomes a symbol named by both. Names come from
content alone, so every task gives equal words equal names without a table of names.

Every symbol carries the span of words that it depends on, ``low`` to ``high``: its own words and the spans of all neighbours that a
decision about it has looked at. Nothing outside has a say, so two equal stretches of words hold the same symbols wherever that span
lies within the stretch. A symbol of ``TARGET`` words, or in a run of more than ``LONGEST`` words, is closed: it joins nothing any
more and needs no further look. A wall is closed and depends on everything.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

ROUNDS, RUN_ROUNDS = 5, 3
TARGET = 6
LONGEST = 11
STRIDE = 25
FAR = 1 << 60

_step, _one, _two, _odd = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_base = np.uint64(0x9E6C63D0876A9A35)
_back = np.uint64(pow(int(_base), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = x + _step
    x = (x ^ (x >> np.uint64(30))) * _one
    x = (x ^ (x >> np.uint64(27))) * _two
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of texts: ``data`` has them with one space between, walls as words of their own; ``start``, ``stop``: byte offsets of each."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\x00 " + b" \x00 ".join(texts) + b" \x00", dtype=np.uint8)
        at = np.cumsum([0, *(len(t) + 3 for t in texts)])
        white = (raw == 32) | ((raw >= 9) & (raw <= 13))
        keep = ~white
        keep[1:] |= ~white[:-1]
        flat = raw[keep]
        gap = white[keep]
        flat[gap] = 32
        gaps = np.flatnonzero(gap)
        self.data = flat.tobytes()
        self.start, self.stop = np.append(0, gaps + 1), np.append(gaps, len(flat))
        self.walls = np.searchsorted(self.start, np.cumsum(keep)[at] - 1)
        self.counts = np.diff(self.walls) - 1
        place = np.arange(len(flat)) - np.repeat(self.start, np.diff(np.append(self.start, len(flat))))
        key = mixed(np.arange(int(place.max()) + 1, dtype=np.uint64)) | np.uint64(1)
        part = key[place] * (flat.astype(np.uint64) + np.uint64(1))
        part[gaps] = 0
        self.names = mixed(np.add.reduceat(part, self.start) + (self.stop - self.start).astype(np.uint64))

    def hash_of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the names of the words ``first`` to ``end - 1``, from sums over all words before."""
        n = len(self.names)
        power, back = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n, x, dtype=np.uint64))) for x in (_base, _back))
        sums = np.append(np.uint64(0), np.cumsum(self.names * power[:-1]))
        return (sums[np.clip(end, 0, n)] - sums[np.clip(first, 0, n)]) * back[np.clip(first, 0, n)]


class Symbols:
    """The symbols of a word array, ``start`` to ``stop`` in words, after all rounds."""

    def __init__(self, names: np.ndarray, walls: np.ndarray):
        n = len(names)
        self.name, self.start, self.stop = names.copy(), np.arange(n), np.arange(1, n + 1)
        self.low, self.high, self.closed = self.start.copy(), self.stop.copy(), np.zeros(n, dtype=bool)
        self.low[walls], self.high[walls], self.closed[walls] = -FAR, FAR, True
        for k in range(ROUNDS):
            if k < RUN_ROUNDS:
                self.join_runs()
            self.join_pairs(k + 1)
            self.closed |= self.stop - self.start >= TARGET

    def keep(self, first: np.ndarray, last: np.ndarray) -> None:
        """Symbol k is now what ``first[k]`` to ``last[k]`` were; names and spans stand at ``first``."""
        self.stop = self.stop[last]
        self.name, self.start, self.low, self.high, self.closed = (x[first] for x in (self.name, self.start, self.low, self.high, self.closed))

    def join_runs(self) -> None:
        same = (self.name[1:] == self.name[:-1]) & ~self.closed[1:] & ~self.closed[:-1]
        first = np.flatnonzero(np.append(True, ~same))
        last = np.append(first[1:], len(self.name)) - 1
        many, fits, open_ = last > first, self.stop[last] - self.start[first] <= LONGEST, ~self.closed[first]
        for a, b in zip(first[many & ~fits], last[many & ~fits], strict=True):
            self.close_run(a, b)
        looks = open_ & fits | open_ & ~many  # each looks at the symbols before and after the run; walls stand at both ends
        a, b = first[looks], last[looks]
        low, high = np.minimum.reduceat(self.low, first)[looks], np.maximum.reduceat(self.high, first)[looks]
        low, high = np.minimum(low, np.minimum(self.low[a - 1], self.low[b + 1])), np.maximum(high, np.maximum(self.high[a - 1], self.high[b + 1]))
        self.low[a], self.high[a] = low, high
        new = many & fits
        a = first[new]
        self.name[a] = mixed(self.name[a] * _odd + (last[new] - a + 1).astype(np.uint64))
        whole = ~many | fits
        into = np.zeros(len(self.name), dtype=bool)
        into[first] = True
        ends = np.zeros(len(self.name), dtype=bool)
        ends[last] = True
        loose = np.repeat(~whole, last - first + 1)
        self.keep(np.flatnonzero(into | loose), np.flatnonzero(ends | loose))

    def close_run(self, a: int, b: int) -> None:
        """A run too long for one symbol: a member is known to be in it by the symbols that exceed ``LONGEST`` up to its own, the first
        ones by those from the symbol before the run on."""
        m = LONGEST // int(self.stop[a] - self.start[a]) + 1
        for x, least in ((self.low, np.min), (self.high, np.max)):
            first = least(x[a - 1:a + m])
            rest = least(np.lib.stride_tricks.sliding_window_view(x[a:b + 1], m), axis=1)
            x[a + m - 1:b + 1] = rest
            x[a:a + m - 1] = first
        self.closed[a:b + 1] = True

    def join_pairs(self, turn: int) -> None:
        coin = (mixed(self.name + np.full(1, turn, dtype=np.uint64) * _odd) & np.uint64(1)).astype(bool)
        left, right = coin & ~self.closed, ~coin & ~self.closed
        size = self.stop - self.start
        pair = left[:-1] & right[1:] & (size[:-1] + size[1:] <= LONGEST)
        a = np.flatnonzero(pair)
        low, high = self.low.copy(), self.high.copy()
        for i, j in ((left, 1), (right, -1)):  # pairs look at each other, all others at the neighbour they can't join
            i = np.flatnonzero(i)
            self.low[i], self.high[i] = np.minimum(low[i], low[i + j]), np.maximum(high[i], high[i + j])
        self.name[a] = mixed(mixed(self.name[a]) * _odd + self.name[a + 1])
        first = np.ones(len(size), dtype=bool)
        first[a + 1] = False
        last = np.ones(len(size), dtype=bool)
        last[a] = False
        self.keep(np.flatnonzero(first), np.flatnonzero(last))

    def chosen(self, p: np.ndarray, width: int) -> np.ndarray:
        """For each stretch of ``width`` words from ``p`` on, the symbol of the least hash whose span lies within it, or -1."""
        order, start = mixed(self.name ^ _odd), np.append(self.start, FAR)
        found, least = np.full(len(p), -1), np.full(len(p), np.iinfo(np.uint64).max)
        at, todo = np.searchsorted(self.start, p), np.arange(len(p))
        while len(todo):
            i, x = at[todo], p[todo]
            better = (self.low[i] >= x) & (self.high[i] <= x + width) & (order[i] < least[todo])
            found[todo[better]], least[todo[better]] = i[better], order[i[better]]
            at[todo] = i + 1
            todo = todo[start[i + 1] < x + width]
        return found


def window_groups(words: Words, width: int):
    """Arrays ``(text, start, count, name, digest)``: windows ``start`` to ``start + count - 1`` of a text that have one name.

    A window chooses a symbol. Where the symbol begins, counted from the window's start and parted by ``STRIDE``, says which words all
    windows of that part have in common: more than half of the window. Symbol, part and a hash of these words are the name of the window.
    A window without any symbol is a group of its own, named by its words. ``digest`` is of all words of the group.
    """
    symbols = Symbols(words.names, words.walls)
    free = np.maximum(words.counts - width + 1, 0)
    base = words.walls[:-1] + 1
    text = np.repeat(np.arange(len(free)), free)
    p = np.arange(free.sum()) - np.repeat(np.cumsum(free) - free, free) + base[text]
    found = symbols.chosen(p, width)
    stride = min(STRIDE, (width + 1) // 2)
    part = (symbols.start[found] - p) // stride
    new = np.ones(len(p), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (found[1:] < 0) | (text[1:] != text[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(p)))
    data, begin, end = words.data, words.start[p[first]].tolist(), words.stop[p[first] + count + width - 2].tolist()
    digests = b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(begin, end, strict=True)])
    pair = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
    chosen, part = found[first], part[first]
    begin = symbols.start[chosen]
    common = words.hash_of(begin - part * stride, begin - np.minimum(part * stride + stride, width) + 1 + width)
    name = mixed(mixed(symbols.name[chosen] + part.astype(np.uint64)) * _odd + common).view(np.int64)
    return text[first], p[first] - base[text[first]], count, np.where(chosen < 0, pair[:, 1], name), pair[:, 0]
