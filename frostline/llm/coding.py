"""Encoding whole texts by their segments: each distinct segment is encoded once a worker, and kept with its ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .hashing import SpanTable, spans

#: Bytes that a worker's known segments and their ids take before they are forgotten, if nothing else is said.
KNOWN_BYTES = 32 << 20


def cuts_of(tape: np.ndarray) -> np.ndarray:
    """Places of spaces before anything that no engine takes for white space: there, any tokenization has a boundary.

    The tape is UTF-8, with a line break at its end. The few characters of the lead bytes below that share their second
    byte with white space count as such, which only makes segments longer.
    """
    space = np.flatnonzero(tape == 0x20)
    lead = tape[space + 1]
    fit = lead > 0x20
    for first, second in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A,)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        at = np.flatnonzero(lead == first)
        fit[at] = ~np.isin(tape[space[at] + 2], second)
    return space[fit]


class SegmentCoder:
    """learn(before, segments) gives the ids of before + segment for new segments: all ids in a row, and their numbers.

    A text's first segment stands alone; every other one has the space before it, under which it is known.
    """

    def __init__(self, learn: Callable[[str, list[str]], tuple[np.ndarray, np.ndarray]], kind, most: int | None = None):
        self.learn, self.kind, self.most = learn, np.dtype(kind), KNOWN_BYTES if most is None else most
        self.table = SpanTable()
        self.forget()

    def forget(self) -> None:
        self.table.clear()
        self.ids, self.used = np.zeros(1 << 12, self.kind), 0
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, ids: np.ndarray, n: np.ndarray) -> None:
        end = self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(end, self.kind)])
        self.ids[self.used : end] = ids
        self.at, self.n = np.concatenate([self.at, self.used + np.cumsum(n) - n]), np.concatenate([self.n, n])
        self.used = end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each whole text has."""
        if self.table.held + self.ids.nbytes + 2 * self.at.nbytes > self.most:
            self.forget()
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        tape = b"\n".join([*raws, b"", b""])  # two more bytes may be looked at
        text = lambda a, b: tape[a:b].decode("utf-8", "surrogatepass")
        tape_ = np.frombuffer(tape, np.uint8)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
        heads = np.cumsum(sizes) - sizes
        cuts = cuts_of(tape_[:-1])
        starts = np.sort(np.concatenate([heads, cuts + 1]))
        ends = np.append(starts[1:], sizes.sum()) - 1
        is_head = np.zeros(len(starts), bool)
        is_head[np.searchsorted(starts, heads)] = True
        body = np.flatnonzero(~is_head)
        number, new = self.table.numbers(tape_, starts[body], (ends - starts)[body])
        if len(new):
            self._keep(*self.learn(" ", [text(a, b) for a, b in zip(starts[body][new].tolist(), ends[body][new].tolist(), strict=True)]))
        first = [text(a, b) for a, b in zip(heads.tolist(), ends[is_head].tolist(), strict=True)]
        place = {t: i for i, t in enumerate(dict.fromkeys(first))}
        head_ids, head_n = self.learn("", list(place))
        which = np.fromiter(map(place.__getitem__, first), np.int64, len(first))
        n = np.zeros(len(starts), np.int64)
        n[body], n[is_head] = self.n[number], head_n[which]
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), self.kind)
        out[spans(at[body], n[body])] = self.ids[spans(self.at[number], n[body])]
        out[spans(at[is_head], n[is_head])] = head_ids[spans((np.cumsum(head_n) - head_n)[which], n[is_head])]
        return out, np.add.reduceat(n, np.flatnonzero(is_head)) if len(texts) else np.zeros(0, np.int64)

    def encode_each(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each whole text."""
        ids, n = self.encode(texts)
        data, ends = ids.tobytes(), (np.cumsum(n) * self.kind.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
