"""Vectorised 64-bit hashes of spans of a tape of bytes, and a table of distinct spans that compares bytes."""

from __future__ import annotations

import numpy as np
import xxhash

GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a span that are read eight at a time for all spans at once; the rest of longer ones is read span by span.
STEP, IN_STEP = 8, 96
#: The lowest k bytes of a word.
LOW = np.array([(1 << 8 * k) - 1 for k in range(STEP + 1)], np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start .. start + len - 1 of every span, one after another."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def words_of(tape: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of a tape on, as numbers; zeros follow its end."""
    padded = np.concatenate([tape, np.zeros(STEP, np.uint8)])
    return np.ndarray(len(tape) + 1, "<u8", padded, 0, (1,))


def span_hashes(tape: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hashes of spans: the state is scrambled after every eight bytes, so equal hashes of different spans are chance."""
    at = words_of(tape)
    h = scramble(lens.astype(np.uint64) + GOLD)
    own = np.arange(len(starts))
    for lo in range(0, IN_STEP, STEP):
        own = own[lens[own] > lo] if lo else np.flatnonzero(lens > 0)
        if not len(own):
            return h
        with np.errstate(over="ignore"):
            h[own] = scramble((h[own] * GOLD) ^ (at[starts[own] + lo] & LOW[np.minimum(lens[own] - lo, STEP)]))
    raw = memoryview(np.ascontiguousarray(tape))
    for i in own[lens[own] > IN_STEP].tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] + IN_STEP : starts[i] + lens[i]], seed=int(h[i]))
    return h


class SpanTable:
    """Distinct spans, numbered as they come. Open addressing by hash; a span is known only if all its bytes agree."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.bits, self.n, self.used = 12, 0, 0
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.hashes, self.starts, self.lens = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool = np.zeros(1 << 14, np.uint8)

    def bytes_of(self, numbers: np.ndarray) -> np.ndarray:
        """The bytes of the numbers, one after another."""
        return self.pool[spans(self.starts[numbers], self.lens[numbers])]

    @property
    def held(self) -> int:
        return self.slots.nbytes + self.hashes.nbytes * 3 + self.pool.nbytes

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _same(self, tape: np.ndarray, starts: np.ndarray, lens: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether spans are the bytes of the numbers."""
        same = self.lens[number] == lens
        left, right, own = words_of(tape), np.ndarray(len(self.pool) - STEP, "<u8", self.pool, 0, (1,)), np.flatnonzero(same)
        theirs = self.starts[number]
        for lo in range(0, IN_STEP, STEP):
            own = own[lens[own] > lo]
            if not len(own):
                return same
            differ = (left[starts[own] + lo] ^ right[theirs[own] + lo]) & LOW[np.minimum(lens[own] - lo, STEP)]
            same[own[differ != 0]] = False
            own = own[differ == 0]
        for i in own[lens[own] > IN_STEP].tolist():
            same[i] = np.array_equal(tape[starts[i] : starts[i] + lens[i]], self.pool[theirs[i] : theirs[i] + lens[i]])
        return same

    def find(self, tape: np.ndarray, starts: np.ndarray, lens: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of each span, -1 where it is new."""
        slot, found, todo = self._home(h), np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(todo):
            number = self.slots[slot[todo]]
            there = number >= 0
            todo, number = todo[there], number[there].astype(np.int64)
            hit = self.hashes[number] == h[todo]
            asked, named = todo[hit], number[hit]
            right = self._same(tape, starts[asked], lens[asked], named)
            found[asked[right]] = named[right]
            todo = todo[found[todo] < 0]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return found

    def _place(self, numbers: np.ndarray) -> None:
        slot, todo = self._home(self.hashes[numbers]), numbers
        while len(todo):  # all that have no place yet try their slot; the first of each free slot gets it
            free = np.flatnonzero(self.slots[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.slots[slot[won]] = todo[won]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _add(self, tape: np.ndarray, starts: np.ndarray, lens: np.ndarray, h: np.ndarray) -> None:
        """Spans that are new and of different hashes."""
        n, size = self.n + len(h), self.used + int(lens.sum())
        if n > len(self.hashes):
            self.hashes, self.starts, self.lens = (np.concatenate([x, np.zeros(n, x.dtype)]) for x in (self.hashes, self.starts, self.lens))
        if size + 2 * STEP > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(size + 2 * STEP, np.uint8)])
        ends = np.cumsum(lens)
        self.pool[self.used : size] = tape[spans(starts, lens)]
        own = slice(self.n, n)
        self.hashes[own], self.starts[own], self.lens[own] = h, self.used + ends - lens, lens
        self.n, self.used, new = n, size, np.arange(self.n, n, dtype=np.int32)
        if 2 * n > len(self.slots):
            self.bits = (4 * n).bit_length()
            self.slots, new = np.full(1 << self.bits, -1, np.int32), np.arange(n, dtype=np.int32)
        self._place(new)

    def numbers(self, tape: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each span, and the places of the spans that were new, in the order of their numbers."""
        h = span_hashes(tape, starts, lens)
        found, added = self.find(tape, starts, lens, h), []
        while len(fresh := np.flatnonzero(found < 0)):  # once more only if different spans have one hash
            _, first = np.unique(h[fresh], return_index=True)
            new = fresh[first]
            self._add(tape, starts[new], lens[new], h[new])
            added.append(new)
            found[fresh] = self.find(tape, starts[fresh], lens[fresh], h[fresh])
        return found, np.concatenate([np.zeros(0, np.int64), *added])
